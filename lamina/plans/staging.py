"""Cutting lineage between rounds, and ranks without a window over everything."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _folder(spark: SparkSession) -> str:
    """This application's folder below that of ``spark.checkpoint.dir``; only a local session without one makes its own."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not named:
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lamina-"))
        named = context._jsc.sc().getCheckpointDir().get()
    return f"{named.rstrip('/')}/lamina-{context.applicationId}"


def staged(frame: DataFrame) -> DataFrame:
    """``frame`` written as Parquet in the shared folder and read back: each row is made once, lineage is cut, and lost executors lose nothing."""
    path = f"{_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Deletes what this application has staged; frames that are made from it can no longer be run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(frame: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``frame`` with ``name``, its rows' places (from 1) in the order of ``keys``: ranges are sorted each by itself, and their sizes added up."""
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(frame.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}  # one row per partition
    before, offsets = 0, {}
    for part in sorted(sizes):
        offsets[part] = before
        before += sizes[part]
    pairs: list[Column] = [F.lit(x) for part, n in offsets.items() for x in (part, n)]
    base = F.element_at(F.create_map(*pairs), F.col("_part")) if pairs else F.lit(0)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return dealt.withColumn(name, (place + base).cast("long")).drop("_part")
