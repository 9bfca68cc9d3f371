"""Connected regions of rasters of any size, and their outlines as ordered loops.

Each tile labels its own pixels; tiles that touch send each other one link for every two labels that meet at their common side, and the links are contracted until each region
has one label: the smallest place (row, then column) in it. So a flood fill that winds through a whole raster costs a few joins of labels, not a walk.

Outlines are the sides of pixels that a region ends at, directed so that it lies to their right. Straight runs of sides become one edge; each edge knows the next by an equi-join at
its corner, and lists are ranked by pointer doubling: an edge's loop is the least edge it ever comes to, its place the number of steps from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.operators import kernels
from lamina.plans.staging import staged

TILE = 256
#: A place is one number: its row times this, plus its column.
ROW = 1 << 31


def _local(y: np.ndarray, x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For pixels in order of (y, x): the first pixel of each one's region of equal ``c``, by label passing along runs and between rows."""
    n = len(y)
    place = y.astype(np.int64) * ROW + x
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    # runs within rows first, then one link for each two runs that touch
    begins = np.ones(n, bool)
    begins[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1) | (c[1:] != c[:-1])
    run = np.cumsum(begins) - 1
    head = np.flatnonzero(begins)
    above = np.searchsorted(place, place - ROW)
    above[above == n] = 0
    met = (place[above] == place - ROW) & (c[above] == c)
    pairs = np.unique(np.stack([run[np.flatnonzero(met)], run[above[met]]], axis=1), axis=0) if met.any() else np.zeros((0, 2), np.int64)
    parent = np.arange(len(head))
    for a, b in pairs.tolist():
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    roots = np.array([root(i) for i in range(len(head))], np.int64)
    return place[head[roots[run]]]


def contracted(links: DataFrame) -> DataFrame:
    """(image_id, a, label) for the ends of ``links`` (image_id, a, b): the smallest end of each connected part.

    In each pass every node hangs below its smallest neighbour, pointers are doubled to their ends, and links between different ends go on.
    """
    keys = ["image_id"]
    links = staged(links.filter("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = None
    while links.limit(1).count():
        up = staged(links.groupBy(*keys, "a").agg(F.min("b").alias("up")))
        while True:
            higher = up.select(*keys, F.col("a").alias("up"), F.col("up").alias("higher"))
            jumped = staged(up.join(higher, [*keys, "up"], "left").select(*keys, "a", F.coalesce("higher", "up").alias("up"), F.col("higher").isNotNull().alias("moved")))
            up = jumped.drop("moved")
            if not jumped.filter("moved").limit(1).count():
                break
        if labels is None:
            labels = up.withColumnRenamed("up", "label")
        else:
            moved = up.select(*keys, F.col("a").alias("label"), F.col("up").alias("to"))
            old = labels.join(moved, [*keys, "label"], "left").select(*keys, "a", F.coalesce("to", "label").alias("label"))
            labels = staged(old.unionByName(up.withColumnRenamed("up", "label").join(labels.select(*keys, "a"), [*keys, "a"], "left_anti")))
        at = lambda c: up.select(*keys, F.col("a").alias(c), F.col("up").alias(f"{c}_up"))
        mapped = links.join(at("a"), [*keys, "a"], "left").join(at("b"), [*keys, "b"], "left").select(*keys, F.coalesce("a_up", "a").alias("a"), F.coalesce("b_up", "b").alias("b"))
        links = staged(mapped.filter("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return labels if labels is not None else links.select(*keys, "a", F.col("b").alias("label"))


def labelled(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """``pixels`` (image_id, y, x, c) with ``region``: the smallest place of the 4-connected region of equal ``c`` that a pixel is in; places must not repeat."""

    def local(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x", "ascending")])
        y, x, c = (table.column(k).to_numpy() for k in ("y", "x", "c"))
        return table.select(["image_id", "y", "x", "c"]).append_column("part", pa.array(_local(y, x, c)))

    rows = pixels.select(F.col("image_id").cast("long").alias("image_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("c").cast("int").alias("c"))
    tiled = rows.withColumn("ty", F.floor(F.col("y") / tile)).withColumn("tx", F.floor(F.col("x") / tile))
    parts = staged(tiled.groupBy("image_id", "ty", "tx").applyInArrow(local, "image_id long, y int, x int, c int, part long"))
    links = None
    for axis in ("y", "x"):
        last = parts.filter(F.pmod(F.col(axis), F.lit(tile)) == tile - 1).select("image_id", "c", *[(F.col(k) + 1 if k == axis else F.col(k)).alias(k) for k in ("y", "x")], F.col("part").alias("a"))
        first = parts.filter(F.pmod(F.col(axis), F.lit(tile)) == 0).select("image_id", "c", "y", "x", F.col("part").alias("b"))
        met = last.join(first, ["image_id", "c", "y", "x"]).select("image_id", "a", "b").distinct()
        links = met if links is None else links.unionByName(met)
    labels = contracted(links).withColumnRenamed("a", "part")
    return parts.join(labels, ["image_id", "part"], "left").select("image_id", "y", "x", "c", F.coalesce("label", "part").alias("region"))


def flooded(pixels: DataFrame, seeds: DataFrame, tolerance: int, tile: int = TILE) -> DataFrame:
    """(image_id, y, x) of the pixels (r, g, b, a) that a path of matching ones joins with their image's seed (image_id, y, x): all channels within the tolerance of the seed's."""
    seeded = pixels.join(seeds, ["image_id", "y", "x"]).select("image_id", *[F.col(c).alias(f"{c}_") for c in "rgba"])
    near = F.lit(True)
    for c in "rgba":
        near = near & (F.abs(F.col(c) - F.col(f"{c}_")) <= tolerance)
    matching = pixels.join(seeded, "image_id").filter(near).select("image_id", "y", "x", F.lit(1).alias("c"))
    regions = staged(labelled(matching, tile))
    wanted = regions.join(seeds, ["image_id", "y", "x"]).select("image_id", "region")
    return regions.join(wanted, ["image_id", "region"]).select("image_id", "y", "x")


#: Steps of the four directions: right, down, left, up.
_STEPS = ((1, 0), (0, 1), (-1, 0), (0, -1))


def edges(region: DataFrame) -> DataFrame:
    """(image_id, d, x0, y0, x1, y1): the straight edges of a region (image_id, y, x), which lies to their right; d is their direction."""
    # a pixel's sides from the top, clockwise: the neighbour beyond, and the corner where the side begins
    sides = F.array(*[F.struct(F.lit(d).alias("d"), (F.col("y") + ny).alias("ny"), (F.col("x") + nx).alias("nx"), (F.col("x") + cx).alias("cx"), (F.col("y") + cy).alias("cy")) for d, (ny, nx, cx, cy) in enumerate(((-1, 0, 0, 0), (0, 1, 1, 0), (1, 0, 1, 1), (0, -1, 0, 1)))])
    units = region.select("image_id", F.explode(sides).alias("s")).select("image_id", "s.*")
    open_ = units.join(region.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx")), ["image_id", "ny", "nx"], "left_anti")
    along = F.when(F.col("d") == 0, F.col("cx")).when(F.col("d") == 1, F.col("cy")).when(F.col("d") == 2, -F.col("cx")).otherwise(-F.col("cy"))
    line = F.when(F.col("d") % 2 == 0, F.col("cy")).otherwise(F.col("cx"))
    # sides that follow each other on a line are one edge; where two pixels meet at a corner only, no side goes straight on
    by = Window.partitionBy("image_id", "d", "line").orderBy("at")
    runs = open_.withColumn("line", line).withColumn("at", along).withColumn("run", F.col("at") - F.row_number().over(by))
    ends = runs.groupBy("image_id", "d", "line", "run").agg(F.min_by(F.struct("cx", "cy"), "at").alias("a"), F.max_by(F.struct("cx", "cy"), "at").alias("b"))
    dx, dy = (F.element_at(F.array(*[F.lit(s[i]) for s in _STEPS]), F.col("d") + 1) for i in (0, 1))
    return ends.select("image_id", "d", F.col("a.cx").alias("x0"), F.col("a.cy").alias("y0"), (F.col("b.cx") + dx).alias("x1"), (F.col("b.cy") + dy).alias("y1"))


def loops(region: DataFrame) -> DataFrame:
    """(image_id, loop, seq, x, y): the corners of a region's outlines in order, clockwise about what they enclose; a loop is named by its least edge, with which it begins."""
    # an edge is one number: its first corner by row and column, and its direction
    named = edges(region).withColumn("id", (F.col("y0").cast("long") * ROW + F.col("x0")) * 4 + F.col("d"))
    after = named.select("image_id", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("d").alias("next_d"), F.col("id").alias("next"))
    # of two ways on, the turn to the right keeps to the same pixel
    right = F.pmod(F.col("next_d") - F.col("d"), F.lit(4)) == 1
    choice = named.join(after, ["image_id", "x1", "y1"]).groupBy("image_id", "id").agg(F.max_by("next", right.cast("int")).alias("next"))
    first = staged(choice)
    walk = first.withColumn("least", F.col("id"))
    while True:
        ahead = walk.select("image_id", F.col("id").alias("next"), F.col("next").alias("far"), F.col("least").alias("other"))
        stepped = staged(walk.join(ahead, ["image_id", "next"]).select("image_id", "id", F.col("far").alias("next"), F.least("least", "other").alias("least"), (F.col("other") < F.col("least")).alias("moved")))
        walk = stepped.drop("moved")
        if not stepped.filter("moved").limit(1).count():
            break
    # from each edge on to the loop's last one, whose next is the least
    loop = walk.select("image_id", "id", F.col("least").alias("loop"))
    left = staged(first.join(loop, ["image_id", "id"]).select("image_id", "id", "loop", F.when(F.col("next") != F.col("loop"), F.col("next")).alias("next"), F.when(F.col("next") != F.col("loop"), 1).otherwise(0).cast("long").alias("left")))
    while left.filter("next IS NOT NULL").limit(1).count():
        ahead = left.select("image_id", F.col("id").alias("next"), F.col("next").alias("far"), F.col("left").alias("more"))
        left = staged(left.join(ahead, ["image_id", "next"], "left").select("image_id", "id", "loop", F.col("far").alias("next"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    sizes = left.groupBy("image_id", "loop").agg(F.max("left").alias("most"))
    ranked = left.join(sizes, ["image_id", "loop"]).select("image_id", "id", "loop", (F.col("most") - F.col("left")).alias("seq"))
    return named.join(ranked, ["image_id", "id"]).select("image_id", "loop", "seq", F.col("x0").alias("x"), F.col("y0").alias("y"))


def smoothed(corners: DataFrame, tolerance: float = 1.6, rounds: int = 3) -> DataFrame:
    """(image_id, loop, seq, x, y): each loop simplified to within the tolerance, then its corners cut ``rounds`` times; a task holds one loop's corners."""

    def smooth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).sort_by("seq")
        points = list(zip(table.column("x").to_pylist(), table.column("y").to_pylist(), strict=True))
        kept = np.array(kernels.simplified([*points, points[0]], tolerance)[:-1], float)
        for _ in range(rounds if len(kept) > 2 else 0):
            after = np.roll(kept, -1, axis=0)
            kept = np.stack([0.75 * kept + 0.25 * after, 0.25 * kept + 0.75 * after], axis=1).reshape(-1, 2)
        n = len(kept)
        yield pa.RecordBatch.from_arrays([pa.array([table.column(c)[0].as_py()] * n, pa.int64()) if c else pa.array(np.arange(n)) for c in ("image_id", "loop", "")] + [pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["image_id", "loop", "seq", "x", "y"])

    rows = corners.select(F.col("image_id").cast("long").alias("image_id"), "loop", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.groupBy("image_id", "loop").applyInArrow(smooth, "image_id long, loop long, seq long, x double, y double")
