"""Shared plumbing: staging in the cluster's shared folder, sizing, and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_COLUMN = "text"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one is made only where the session names none and is local, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lamina-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/lamina/{what}-{uuid.uuid4().hex}"


#: Rows of an Arrow batch: rows hold whole texts, and a batch stands in memory on both sides of the pipe to Python.
BATCH_ROWS, _SPARK_DEFAULT = 4_000, 10_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches from Spark's default; a count that someone has set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == _SPARK_DEFAULT:
        spark.conf.set(key, str(BATCH_ROWS))


def stage(frame: DataFrame, what: str) -> DataFrame:
    """Write ``frame`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = frame.sparkSession
    bounded_batches(spark)
    path = new_folder(spark, what)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def estimated_bytes(frame: DataFrame) -> int:
    """The optimizer's size estimate, which for file scans is the size of the files."""
    return int(str(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(frame: DataFrame, bytes_each: int) -> int:
    """At least the session's shuffle partitions, and enough that each gets about ``bytes_each`` of the input files.

    Where the optimizer has no estimate (its default is then beyond any input), the texts' own bytes are added up.
    """
    bounded_batches(frame.sparkSession)
    size = estimated_bytes(frame)
    if size >= 1 << 50:
        size = frame.agg(F.sum(F.octet_length(TEXT_COLUMN))).first()[0] or 0
    return max(shuffle_partitions(frame.sparkSession), -(-size // bytes_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows of ``counts`` (word, n) of highest ``n``, of equal ones those of the smallest words; all rows if there are fewer.

    A histogram of classes of n, 9 % wide, is looked at first: whole classes are taken as they are, and what is left is filled from the next one in order,
    so that no more than ``most`` rows leave the executors, whatever their number.
    """
    kind = F.floor(F.log2(F.col("n").cast("double")) * 8)
    whole, total, cut = None, 0, None
    for row in counts.groupBy(kind.alias("kind")).count().orderBy(F.desc("kind")).collect():
        if total + row["count"] > most:
            cut = row.kind
            break
        whole, total = row.kind, total + row["count"]
    taken = counts.filter(kind >= whole) if whole is not None else counts.limit(0)
    if cut is None or total == most:
        return taken
    return taken.unionByName(counts.filter(kind == cut).orderBy(F.desc("n"), "word").limit(most - total))
