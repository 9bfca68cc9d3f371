"""Walks of layer trees (id, parent_id, is_group, place, opacity, visible) by pointer doubling.

A value is folded along every folder's path to its root: in each round a folder takes over what its pointer's folder has folded and points to where
that one points, so a path of n folders needs log2(n) joins by id. Only nodes that others name as their parent go through the rounds; all others, however many
stand in one folder, meet what their parent has folded in one join at the end, whose folded side Spark broadcasts where it is small.
Nodes that no root reaches (in or below a cycle, or below a parent that is missing) never end and are left out, as in a walk from the roots down.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.plans.staging import ranked, staged

#: For each value its start at a node, and how a node's part and what stands above it are put together.
Values = dict[str, tuple[Column, Callable[[Column, Column], Column]]]


def _doubled(nodes: DataFrame, values: Values) -> DataFrame:
    """(id, ``values``) of each of ``nodes`` (id, _up, ``values``) that a root reaches through them."""
    open_, done, left, steps = nodes, None, None, 1
    while True:
        ended = open_.filter("_up IS NULL")
        done = ended if done is None else done.unionByName(ended)
        open_ = open_.filter("_up IS NOT NULL")
        if not open_.limit(1).count():
            return done.drop("_up")
        # no path has more steps than there are nodes: what goes on then goes in a circle
        left = nodes.select("id").distinct().count() if left is None else left
        if steps > 2 * left:
            return done.drop("_up")
        # what a pointer's node has folded: finished ones, which point nowhere, and open ones
        above = done.unionByName(open_).select(F.col("id").alias("_up"), F.col("_up").alias("_next"), *[F.col(name).alias(f"_{name}") for name in values])
        folded = [join(F.col(name), F.col(f"_{name}")).alias(name) for name, (_, join) in values.items()]
        open_ = staged(open_.join(above, "_up").select("id", F.col("_next").alias("_up"), *folded))
        steps *= 2


def rooted(tree: DataFrame, values: Values, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep``, ``values``) of each node that a root reaches."""
    start = tree.select("id", *keep, F.col("parent_id").alias("_up"), *[e.alias(name) for name, (e, _) in values.items()])
    parents = start.filter("_up IS NOT NULL").select(F.col("_up").alias("id")).distinct()
    folders = staged(start.drop(*keep).join(parents, "id", "left_semi"))
    above = _doubled(folders, values).select(F.col("id").alias("_up"), *[F.col(name).alias(f"_{name}") for name in values])
    folded = [join(F.col(name), F.col(f"_{name}")).alias(name) for name, (_, join) in values.items()]
    return start.filter("_up IS NULL").drop("_up").unionByName(start.join(above, "_up").select("id", *keep, *folded))


def _both(a: Column, b: Column) -> Column:
    return a & b


def _either(a: Column, b: Column) -> Column:
    return a | b


def _product(a: Column, b: Column) -> Column:
    return a * b


def _below_first(a: Column, b: Column) -> Column:
    return F.concat(b, a)


def effective_opacity(tree: DataFrame) -> DataFrame:
    """(id, opacity, visible, depth): products and conjunctions over all folders above."""
    got = rooted(tree, {"opacity": (F.col("opacity"), _product), "visible": (F.col("visible"), _both), "nodes": (F.lit(1), lambda a, b: a + b)})
    return got.select("id", F.round("opacity", 9).alias("opacity"), "visible", (F.col("nodes") - 1).alias("depth"))


def visible_leaves(tree: DataFrame) -> DataFrame:
    return rooted(tree, {"visible": (F.col("visible"), _both)}, ("is_group",)).filter("visible AND NOT is_group").select("id")


def folder_mask_product(tree: DataFrame) -> DataFrame:
    """(id, coverage): the product of all folders' mask levels above a leaf, masks being their places."""
    level = F.when(F.col("is_group"), (1 + F.col("place") % 4) / F.lit(4.0)).otherwise(F.lit(1.0))
    return rooted(tree, {"coverage": (level, _product)}, ("is_group",)).filter("NOT is_group").select("id", F.round("coverage", 9).alias("coverage"))


def depth_first(tree: DataFrame) -> DataFrame:
    """(id, rank): the order of a walk that takes children by place, of equal places by id; places are compared as numbers of any size."""
    key = F.array(F.struct(F.col("place").cast("long").alias("place"), "id"))
    return ranked(rooted(tree, {"path": (key, _below_first)}), ["path"], "rank").select("id", "rank")


def descendants(tree: DataFrame, root: str) -> DataFrame:
    return rooted(tree, {"inside": (F.col("id") == root, _either)}).filter((F.col("inside")) & (F.col("id") != root)).select("id")


def topmost_selected(tree: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """Of a selection, what is not inside a selected folder."""
    chosen = F.col("id").isin(*ids)
    return rooted(tree, {"n": (chosen.cast("int"), lambda a, b: a + b)}).filter(chosen & (F.col("n") == 1)).select("id").distinct()


def common_folder(tree: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """The deepest folder above all of ``ids``, whose paths are as long as the tree is deep."""
    paths = rooted(tree, {"path": (F.array("id"), _below_first)}).filter(F.col("id").isin(*ids))
    above = paths.select("id", F.posexplode("path").alias("depth", "folder")).filter(~F.col("folder").isin(*ids))
    met = above.groupBy("folder", "depth").agg(F.countDistinct("id").alias("n")).filter(F.col("n") == len(ids))
    return met.orderBy(F.desc("depth")).limit(1).select(F.col("folder").alias("id"))


def subtree_copy(tree: DataFrame, root: str) -> DataFrame:
    """A subtree's copy: (id, parent_id) with new ids; links to parents inside the copy follow, others stay."""
    inside = staged(rooted(tree, {"inside": (F.col("id") == root, _either)}, ("parent_id",)).filter("inside").select("id", "parent_id"))
    parents = inside.select(F.col("id").alias("parent_id"), F.lit(True).alias("copied"))
    return inside.join(parents, "parent_id", "left").select(F.concat(F.lit("copy-"), "id").alias("id"), F.when(F.col("copied"), F.concat(F.lit("copy-"), "parent_id")).otherwise(F.col("parent_id")).alias("parent_id"))


def violations(tree: DataFrame, deepest: int = 64) -> DataFrame:
    """Rows of a tree that break its rules: repeated ids, missing parents, parents that are no folders, too many folders above, and what no root reaches (cycles)."""
    found = staged(rooted(tree, {"nodes": (F.lit(1), lambda a, b: a + b)}))
    parents = tree.select(F.col("id").alias("parent_id"), F.col("is_group").alias("folder"))
    named = lambda rule, rows: rows.select(F.lit(rule).alias("rule"), "id")
    out = named("repeated", tree.groupBy("id").count().filter("count > 1"))
    out = out.unionByName(named("orphan", tree.filter("parent_id IS NOT NULL").join(parents, "parent_id", "left_anti")))
    out = out.unionByName(named("not a folder", tree.join(parents.filter("NOT folder"), "parent_id")))
    out = out.unionByName(named("deep", found.filter(F.col("nodes") - 1 > deepest)))
    return out.unionByName(named("unreachable", tree.join(found.select("id").distinct(), "id", "left_anti")))


def mask_chain(layers: DataFrame) -> DataFrame:
    """(layer_id, coverage): each layer's mask is the one two below it in its document; levels multiply down the chain."""
    under = layers.select("document_id", (F.col("z") + 2).alias("z"), F.col("layer_id").alias("parent_id"))
    chain = layers.join(under, ["document_id", "z"], "left").select(F.col("layer_id").alias("id"), "parent_id", "opacity")
    return rooted(chain, {"coverage": (F.col("opacity"), _product)}).select(F.col("id").alias("layer_id"), F.round("coverage", 9).alias("coverage"))
