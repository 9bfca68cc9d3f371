"""Connected components of a distributed list of links, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common


def _empty(frame: DataFrame) -> bool:
    return not frame.limit(1).count()


def _roots(links: DataFrame) -> DataFrame:
    """(node, root): every node that has a lower neighbour points to the lowest; pointers are doubled until they end at roots."""
    up = common.stage(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "parents")
    while True:
        higher = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        jumped = common.stage(up.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "parents")
        up = jumped.select("node", "root")
        if _empty(jumped.filter("moved")):
            return up


def components(links: DataFrame) -> DataFrame:
    """For ``links`` (a, b) of 64-bit nodes: (node, label), with one label (a node's number) per component; only linked nodes have a row.

    Each pass hangs all nodes under the lowest neighbours' roots and keeps the links between different roots, so links at least halve
    their ends; a hub costs one row per link, added up before the shuffle.
    """
    links = common.stage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = None
    while not _empty(links):
        roots = _roots(links)
        if labels is None:
            heads = links.select(F.col("a").alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("label"))
            labels = common.stage(roots.select("node", F.col("root").alias("label")).unionByName(heads), "labels")
        else:
            moved = roots.select(F.col("node").alias("label"), F.col("root"))
            labels = common.stage(labels.join(moved, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        mapped = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b")
        links = common.stage(mapped.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("label"))
