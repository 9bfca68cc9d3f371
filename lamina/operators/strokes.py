"""Paint laid down along strokes: an integral of optical density over the distance travelled, so that it does not hang on how often a pointer was asked.

``points`` (stroke_id, seq, x, y, radius, hardness, tail): the way of each stroke in order; ``tail`` marks the end that is still provisional. ``canvases`` (stroke_id, width, height).

A soft tip's density at a distance is -ln(1 - coverage); along a segment it is integrated by eight-point Gauss-Legendre quadrature over the part
that the tip reaches, and divided by the spacing of dabs. Densities add up over segments, and coverage is 1 - exp(-density). A hard tip
covers by the nearest segment alone. Segments meet pixels through tiles: each gives the tiles that its reach touches, and tiles are dealt out and sorted, so that a task
goes through one tile after the other, however many there are: it holds a tile's sums and some thousand pairs of segments and pixels, and pixels out of reach are left at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lamina.plans.sql import Dialect, Text, num

TILE, FALLOFF, MOST = 16, 2.5, 20.0
#: Places and weights of the eight-point rule, of which the other half mirrors these.
NODES = (0.1834346425, 0.5255324099, 0.7966664774, 0.9602898565)
WEIGHTS = (0.3626837834, 0.3137066459, 0.2223810345, 0.1012285363)
#: Dabs lie this share of the diameter apart, at least a quarter pixel; hard tips and soft ones.
SPACING = (0.015, 0.025)
#: Pairs of segments and pixels that a task works on at once.
PAIRS = 1 << 18


def segments(points: DataFrame) -> DataFrame:
    """(stroke_id, seq, x0, y0, x1, y1, radius, hardness, tail): the ways between points; a stroke of one point is a segment without length."""
    order = Window.partitionBy("stroke_id").orderBy("seq")
    ends = points.select("*", F.lead("x").over(order).alias("x1"), F.lead("y").over(order).alias("y1"), F.lead("tail").over(order).alias("next_tail"), F.row_number().over(order).alias("n"))
    alone = F.col("x1").isNull() & (F.col("n") == 1)
    kept = ends.filter(F.col("x1").isNotNull() | alone)
    return kept.select("stroke_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce("x1", "x").alias("x1"), F.coalesce("y1", "y").alias("y1"), "radius", "hardness", F.coalesce("next_tail", "tail").alias("tail"))


def _distance(px: Column, py: Column) -> Column:
    """From a point to a segment."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    along = (px - F.col("x0")) * dx + (py - F.col("y0")) * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along / F.greatest(dx * dx + dy * dy, F.lit(1e-12))))
    ex, ey = px - F.col("x0") - t * dx, py - F.col("y0") - t * dy
    return F.sqrt(ex * ex + ey * ey)


def touched(ways: DataFrame, canvases: DataFrame, tile: int = TILE) -> DataFrame:
    """``ways`` with each tile (ty, tx) of the canvas that has pixels within reach (radius, and half a pixel for hard tips), and the canvas's size."""
    reach = F.col("radius") + F.lit(0.5)
    spans = {}
    for axis, size in (("x", "width"), ("y", "height")):
        low, high = F.least(f"{axis}0", f"{axis}1") - reach, F.greatest(f"{axis}0", f"{axis}1") + reach
        first, last = F.greatest(F.lit(0), F.floor(low / tile)).cast("int"), F.least(F.floor((F.col(size) - 1) / tile), F.floor(high / tile)).cast("int")
        spans[axis] = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    tiled = ways.join(canvases, "stroke_id").select("*", F.explode(spans["y"]).alias("ty")).select("*", F.explode(spans["x"]).alias("tx"))
    middle = lambda t: (F.col(t) + 0.5) * tile
    # a tile whose middle is farther than the reach and half its diagonal has no pixel within it
    return tiled.filter(_distance(middle("tx"), middle("ty")) <= reach + tile * 0.7072)


def met(ways: DataFrame, canvases: DataFrame, tile: int = TILE) -> DataFrame:
    """``ways`` with each pixel (y, x) of the canvas whose middle is within reach."""
    places = touched(ways, canvases, tile).select("*", F.explode(F.sequence(F.lit(0), F.lit(tile * tile - 1))).alias("i"))
    pixels = places.select("*", (F.col("ty") * tile + F.floor(F.col("i") / tile)).cast("int").alias("y"), (F.col("tx") * tile + F.col("i") % tile).cast("int").alias("x"))
    near = pixels.filter("x < width AND y < height").withColumn("distance", _distance(F.col("x") + 0.5, F.col("y") + 0.5))
    return near.filter(F.col("distance") < F.col("radius") + F.lit(0.5)).drop("ty", "tx", "i", "width", "height")


def _soft(squared: np.ndarray, radius: np.ndarray, hardness: np.ndarray) -> np.ndarray:
    """The tip's density at a squared distance."""
    t = np.clip((np.sqrt(squared) / radius - hardness) / (1 - hardness), 0.0, 1.0)
    floor = np.exp(-FALLOFF)
    cover = np.maximum(0.0, (np.exp(-FALLOFF * t * t) - floor) / (1 - floor))
    return -np.log(np.maximum(1 - cover, 0.001))


def densities(px: np.ndarray, py: np.ndarray, dx: np.ndarray, dy: np.ndarray, radius: np.ndarray, hardness: np.ndarray) -> np.ndarray:
    """The density of a soft tip led along each segment (dx, dy), at a point (px, py) from its beginning."""
    length = np.sqrt(dx * dx + dy * dy)
    moving = length >= 1e-6
    ux, uy = (np.divide(d, length, out=np.zeros_like(d), where=moving) for d in (dx, dy))
    along = px * ux + py * uy
    ex, ey = px - along * ux, py - along * uy
    across = ex * ex + ey * ey
    reach = np.sqrt(np.maximum(radius * radius - across, 0.0))
    low = np.maximum(0.0, along - reach)
    half = (np.minimum(length, along + reach) - low) / 2
    out = np.zeros(len(px))
    led = np.flatnonzero(moving & (across < radius * radius) & (half > 0))
    if len(led):
        r, h, c, middle, part = radius[led], hardness[led], across[led], (low + half - along)[led], half[led]
        total = np.zeros(len(led))
        for n, w in zip(NODES, WEIGHTS, strict=True):
            for side in (-1.0, 1.0):
                at = middle + side * n * part
                total += w * _soft(c + at * at, r, h)
        out[led] = total * part / np.maximum(0.25, 2 * r * SPACING[1])
    still = np.flatnonzero(~moving)
    if len(still):
        out[still] = _soft(across[still], radius[still], hardness[still])
    return out


def _laid(part: pa.RecordBatch, group: np.ndarray, tile: int) -> tuple[np.ndarray, ...]:
    """What the segments of ``part`` lay on the pixels of their tiles, by number of the tile (``group``): hit, solid, and sums and maxima of what is settled and of the tail."""
    column = lambda name: part.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
    x0, y0, radius, hardness, width, height, ty, tx = (column(c) for c in ("x0", "y0", "radius", "hardness", "width", "height", "ty", "tx"))
    dx, dy = column("x1") - x0, column("y1") - y0
    i = np.arange(tile * tile)
    x, y = tx[:, None] * tile + i % tile, ty[:, None] * tile + i // tile
    px, py = x + 0.5 - x0[:, None], y + 0.5 - y0[:, None]
    t = np.clip((px * dx[:, None] + py * dy[:, None]) / np.maximum(dx * dx + dy * dy, 1e-12)[:, None], 0.0, 1.0)
    distance = np.sqrt((px - t * dx[:, None]) ** 2 + (py - t * dy[:, None]) ** 2)
    row, place = np.nonzero((distance < radius[:, None] + 0.5) & (x < width[:, None]) & (y < height[:, None]))
    # a hardness that is no number counts as the greatest
    solid = ~(hardness < 1)[row]
    d = np.empty(len(row))
    d[solid] = np.clip(radius[row[solid]] - distance[row[solid], place[solid]] + 0.5, 0.0, 1.0)
    soft = ~solid
    of = row[soft]
    d[soft] = densities(px[of, place[soft]], py[of, place[soft]], dx[of], dy[of], radius[of], hardness[of])
    flat, size = group[row] * tile * tile + place, (int(group[-1]) + 1) * tile * tile
    hit, hard = np.zeros(size, bool), np.zeros(size, bool)
    hit[flat], hard[flat[solid]] = True, True
    out = [hit, hard]
    for tail in (False, True):
        chosen = pc.fill_null(pc.equal(part.column("tail"), tail), False).to_numpy(zero_copy_only=False)[row]
        at, values, greatest = flat[chosen], d[chosen], np.zeros(size)
        np.maximum.at(greatest, at, values)
        # of no values bincount makes whole numbers
        out += [np.bincount(at, values, size).astype(np.float64), greatest]
    return tuple(a.reshape(-1, tile * tile) for a in out)


def _summed(tile: int, made: pa.Schema):
    """Pixels of tiles that come in order: a tile's sums are kept until the next one begins."""

    def pixels(keys: pa.RecordBatch, laid: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        """(stroke_id, y, x, settled, whole) of the hit pixels of the tiles ``keys``."""
        group, place = np.nonzero(laid[0])
        hard, sum0, max0, sum1, max1 = (a[group, place] for a in laid[1:])
        soft = lambda d: 1 - np.exp(-np.minimum(d, MOST))
        ty, tx = (keys.column(c).to_numpy()[group] for c in ("ty", "tx"))
        columns = [keys.column("stroke_id").take(pa.array(group)), pa.array((ty * tile + place // tile).astype(np.int32)), pa.array((tx * tile + place % tile).astype(np.int32))]
        columns += [pa.array(np.where(hard, max0, soft(sum0))), pa.array(np.where(hard, np.maximum(max0, max1), soft(sum0 + sum1)))]
        return pa.RecordBatch.from_arrays(columns, schema=made)

    def joined(open_: tuple[np.ndarray, ...], first: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        return tuple(how(a, b) for how, a, b in zip((np.logical_or, np.logical_or, np.add, np.maximum, np.add, np.maximum), open_, first, strict=True))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, PAIRS // (tile * tile))
        key, open_ = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                keys = part.select(["stroke_id", "ty", "tx"])
                begins = np.ones(part.num_rows, bool)
                begins[1:] = np.any([pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in keys.columns], axis=0)
                with np.errstate(all="ignore"):
                    laid = _laid(part, np.cumsum(begins) - 1, tile)
                tiles = keys.take(pa.array(np.flatnonzero(begins)))
                if key is not None:
                    if key.equals(tiles.slice(0, 1)):
                        for a, b in zip(laid, joined(open_, tuple(a[0] for a in laid)), strict=True):
                            a[0] = b
                    else:
                        yield pixels(key, tuple(a[None] for a in open_))
                key, open_ = tiles.slice(tiles.num_rows - 1), tuple(a[-1].copy() for a in laid)
                if tiles.num_rows > 1:
                    yield pixels(tiles.slice(0, tiles.num_rows - 1), tuple(a[:-1] for a in laid))
        if key is not None:
            yield pixels(key, tuple(a[None] for a in open_))

    return summed


def painted(points: DataFrame, canvases: DataFrame, tile: int = TILE) -> DataFrame:
    """(stroke_id, y, x, settled, preview): coverage by what is settled, and in bytes with the provisional tail, of each pixel within reach."""
    numbers = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1", "radius", "hardness")]
    parts = touched(segments(points).filter("hardness IS NOT NULL"), canvases, tile).select("stroke_id", "ty", "tx", *numbers, "tail", "width", "height")
    made = StructType([parts.schema["stroke_id"], *StructType.fromDDL("y int, x int, settled double, whole double")])
    keys = ["stroke_id", "ty", "tx"]
    laid = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_summed(tile, to_arrow_schema(made)), made)
    return laid.select("stroke_id", "y", "x", F.round(F.col("settled") + 3e-9, 6).alias("settled"), F.floor(F.round(F.col("whole") * 255, 6) + 0.5).cast("int").alias("preview"))


def blur_painted(pixels: DataFrame, blurred: DataFrame, coverage: DataFrame, keys: list[str]) -> DataFrame:
    """Blur brush: ``pixels`` with their ``blurred`` copy laid over them through a stroke's ``coverage`` (``keys``, y, x, settled); other pixels stay."""
    other = blurred.select(*keys, "y", "x", *[F.col(c).alias(f"{c}_") for c in "rgba"])
    joined = pixels.join(other, [*keys, "y", "x"]).join(coverage.select(*keys, "y", "x", "settled"), [*keys, "y", "x"], "left")
    c = F.coalesce("settled", F.lit(0.0))
    return joined.select(*keys, "y", "x", *[F.floor(F.round(F.col(k) * (1 - c) + F.col(f"{k}_") * c, 6) + 0.5).cast("int").alias(k) for k in "rgba"])


def painted_sql() -> Text:
    """``painted`` without tiles: each pixel of the canvas meets each segment of its stroke, and the nodes are rows that are added up."""

    def text(d: Dialect) -> str:
        nodes = ", ".join(f"({side * n!r}e0, {w!r}e0)" for n, w in zip(NODES, WEIGHTS, strict=True) for side in (-1, 1))
        floor = f"exp(-{num(FALLOFF)})"
        t = lambda dist: f"greatest(0e0, least(1e0, ({dist} / radius - hardness) / (1e0 - hardness)))"
        soft = lambda dist: f"-ln(greatest(1e0 - greatest(0e0, (exp(-{num(FALLOFF)} * pow({t(dist)}, 2)) - {floor}) / (1e0 - {floor})), 0.001e0))"
        return f"""
WITH p AS (SELECT *, lead(x) OVER o AS x1, lead(y) OVER o AS y1, lead(tail) OVER o AS t1, count(*) OVER (PARTITION BY stroke_id) AS n FROM {{points}} q WINDOW o AS (PARTITION BY stroke_id ORDER BY seq)),
s AS (SELECT stroke_id, seq, x AS x0, y AS y0, coalesce(x1, x) AS x1, coalesce(y1, y) AS y1, radius, hardness, coalesce(t1, tail) AS tail FROM p WHERE x1 IS NOT NULL OR n = 1),
m AS (SELECT *, sqrt(pow(x1 - x0, 2) + pow(y1 - y0, 2)) AS length FROM s),
c AS (SELECT stroke_id, x, unnest(range(height)) AS y FROM (SELECT *, unnest(range(width)) AS x FROM {{canvases}} q) r),
a AS (SELECT m.*, c.x, c.y, c.x + 0.5e0 - x0 AS px, c.y + 0.5e0 - y0 AS py FROM m JOIN c ON c.stroke_id = m.stroke_id),
b AS (SELECT *, CASE WHEN length < 1e-6 THEN 0e0 ELSE (px * (x1 - x0) + py * (y1 - y0)) / length END AS along FROM a),
e AS (SELECT *, greatest(0e0, px * px + py * py - along * along) AS across, sqrt(pow(px - greatest(0e0, least(length, along)) * CASE WHEN length < 1e-6 THEN 0e0 ELSE (x1 - x0) / length END, 2)
  + pow(py - greatest(0e0, least(length, along)) * CASE WHEN length < 1e-6 THEN 0e0 ELSE (y1 - y0) / length END, 2)) AS distance FROM b),
f AS (SELECT *, sqrt(greatest(radius * radius - across, 0e0)) AS reach FROM e WHERE distance < radius + 0.5e0),
g AS (SELECT *, greatest(0e0, along - reach) AS low, least(length, along + reach) AS high FROM f),
h AS (
  SELECT stroke_id, x, y, tail, CASE WHEN hardness >= 1 THEN greatest(0e0, least(1e0, radius - distance + 0.5e0)) WHEN length < 1e-6 THEN {soft('distance')} WHEN across < radius * radius AND high > low THEN
    (SELECT sum(w * ({soft('sqrt(across + pow((low + high) / 2 + node * (high - low) / 2 - along, 2))')})) FROM (VALUES {nodes}) rule(node, w)) * (high - low) / 2 / greatest(0.25e0, 2e0 * radius * {num(SPACING[1])}) ELSE 0e0 END AS d, hardness >= 1 AS solid FROM g
), i AS (
  SELECT stroke_id, y, x, bool_or(solid) AS solid, coalesce(sum(d) FILTER (WHERE NOT tail), 0e0) AS s0, coalesce(sum(d) FILTER (WHERE tail), 0e0) AS s1, coalesce(max(d) FILTER (WHERE NOT tail), 0e0) AS m0, coalesce(max(d) FILTER (WHERE tail), 0e0) AS m1 FROM h GROUP BY stroke_id, y, x
)
SELECT stroke_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(CASE WHEN solid THEN m0 ELSE 1e0 - exp(-least(s0, {num(MOST)})) END + 3e-9, 6) AS settled,
  CAST(floor(round(255e0 * CASE WHEN solid THEN greatest(m0, m1) ELSE 1e0 - exp(-least(s0 + s1, {num(MOST)})) END, 6) + 0.5e0) AS INT) AS preview FROM i
"""

    return text
