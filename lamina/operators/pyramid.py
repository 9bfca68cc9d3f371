"""Reduced copies: a pyramid of exact halvings of each raster, as rows (image_id, level, y, x, values).

A halving is as large as its source rounded up, and resampled by a Lanczos filter of three lobes along rows, then along columns. A pixel's middle lies between two
source pixels, so all pixels have the same twelve weights. Colours fade into nothing beyond the edges (the same wherever a raster is cut) and are kept within their
alpha; masks go on as their last pixel.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.plans.sql import Dialect, Text, num
from lamina.plans.staging import staged

LOBES, MOST_LEVELS = 3, 6


def taps() -> list[tuple[int, float]]:
    """(distance from twice the pixel's place, weight): twelve source pixels, weights summing to 1."""
    sinc = lambda t: math.sin(math.pi * t) / (math.pi * t)
    raw = [(d, sinc((d - 0.5) / 2) * sinc((d - 0.5) / 2 / LOBES)) for d in range(1 - 2 * LOBES, 2 * LOBES + 1)]
    total = sum(w for _, w in raw)
    return [(d, w / total) for d, w in raw]


def _pass(rows: DataFrame, sizes: DataFrame, axis: str, size: str, values: list[str], mask: bool) -> DataFrame:
    """One axis halved: each source pixel goes to the six pixels that it is a part of, with its weight."""
    at = F.col(axis)
    own = rows.join(sizes, "image_id")
    if mask:
        # the first and the last pixel stand for what is beyond them as well
        reach = 2 * LOBES
        copies = F.when((at == 0) | (at == F.col(size) - 1), F.sequence(F.when(at == 0, -reach).otherwise(at), F.when(at == F.col(size) - 1, at + reach).otherwise(at))).otherwise(F.array(at))
        own = own.withColumn(axis, F.explode(copies))
        at = F.col(axis)
    parts = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("weight")) for d, w in taps()])
    sent = own.withColumn("tap", F.explode(parts)).filter(F.pmod(at - F.col("tap.d"), F.lit(2)) == 0)
    to = ((at - F.col("tap.d")) / 2).cast("int")
    placed = sent.withColumn("to", to).filter((F.col("to") >= 0) & (F.col("to") < F.floor((F.col(size) + 1) / 2)))
    other = "x" if axis == "y" else "y"
    sums = placed.groupBy("image_id", other, F.col("to").alias(axis)).agg(*[F.sum(F.col(v) * F.col("tap.weight")).alias(v) for v in values])
    return sums.select("image_id", "y", "x", *values)


def halved(pixels: DataFrame, sizes: DataFrame, mask: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rasters (image_id, y, x, r, g, b, a; masks: v) of ``sizes`` (image_id, height, width) at half the size, and those sizes."""
    values = ["v"] if mask else list("rgba")
    sums = _pass(_pass(pixels, sizes, "x", "width", values, mask), sizes, "y", "height", values, mask)
    whole = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.round(F.col(v), 6) + 0.5))).cast("int")
    rounded = sums.select("image_id", "y", "x", *[whole(v).alias(v) for v in values])
    if not mask:
        # ringing beyond a pixel's alpha would glow
        rounded = rounded.select("image_id", "y", "x", *[F.least(c, "a").alias(c) for c in "rgb"], "a")
    half = lambda c: F.floor((F.col(c) + 1) / 2).cast("int").alias(c)
    return rounded, sizes.select("image_id", half("height"), half("width"))


def pyramid(pixels: DataFrame, sizes: DataFrame, levels: int = MOST_LEVELS, mask: bool = False) -> DataFrame:
    """(image_id, level, y, x, values) for levels 1 to ``levels``, each made from the one before; images end at one pixel."""
    out, rows, size = None, pixels, sizes
    for level in range(1, levels + 1):
        open_ = size.filter("height > 1 OR width > 1")
        rows, size = halved(rows.join(open_.select("image_id"), "image_id", "left_semi"), open_, mask)
        rows, size = staged(rows), staged(size)
        named = rows.select("image_id", F.lit(level).alias("level"), *rows.columns[1:])
        out = named if out is None else out.unionByName(named)
    return out


def halved_sql(levels: int, mask: bool = False, width: int = 4, height: int = 4) -> Text:
    """The last of ``levels`` halvings: each pixel asks for its 144 source pixels at once."""

    def text(d: Dialect) -> str:
        weights = ", ".join(f"({k}, {num(w)})" for k, w in taps())
        source, w, h = "SELECT * FROM {px} p", width, height
        for _ in range(levels):
            place = lambda axis, n: f"greatest(0, least({n - 1}, 2 * o.{axis} + t{axis}.d))" if mask else f"2 * o.{axis} + t{axis}.d"
            grid = f"SELECT i.image_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT DISTINCT image_id FROM ({source}) q) i, range({(h + 1) // 2}) ys(y), range({(w + 1) // 2}) xs(x)"
            sums = ", ".join(f"coalesce(sum(tx.w * ty.w * s.{v}), 0e0) AS {v}" for v in ("v" if mask else "rgba"))
            joined = f"SELECT o.image_id, o.y, o.x, {sums} FROM ({grid}) o, (VALUES {weights}) tx(d, w), (VALUES {weights}) ty(d, w), ({source}) s WHERE s.image_id = o.image_id AND s.y = {place('y', h)} AND s.x = {place('x', w)} GROUP BY o.image_id, o.y, o.x"
            whole = lambda v: f"CAST(greatest(0, least(255, floor(round({v}, 6) + 0.5e0))) AS INT)"
            kept = f"{whole('v')} AS v" if mask else ", ".join([*(f"least({whole(c)}, {whole('a')}) AS {c}" for c in "rgb"), f"{whole('a')} AS a"])
            source, w, h = f"SELECT image_id, y, x, {kept} FROM ({joined}) j", (w + 1) // 2, (h + 1) // 2
        return f"SELECT image_id, y, x, {'v' if mask else 'r, g, b, a'} FROM ({source}) z"

    return text
