"""Queries that write tables' rows as blocks of layered files and read them back, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.plans.sql import Dialect, Text
from lamina.sources import psd_blocks

WIDTH, HEIGHT, STEPS, ROWS = 12, 10, 16, 4


def texts(turns: DataFrame) -> DataFrame:
    """(id, text, font, size, anchor_x, runs, longest, colours, error) of ``turns`` (id, text) written and read as text layers."""
    read = psd_blocks.texts(psd_blocks.conversation_blocks(turns), ["id"])
    runs = F.col("runs")
    return read.select("id", "text", "font", "size", "anchor_x", F.size(runs).cast("int").alias("runs"), F.array_max(F.transform(runs, lambda r: r["length"])).alias("longest"), F.array_join(F.transform(runs, lambda r: F.concat_ws("/", r["font"], r["size"].cast("string"), r["green"].cast("string"))), ",").alias("styles"), "error")


def texts_sql() -> Text:
    def text(d: Dialect) -> str:
        units = "len(text) + len(regexp_replace(text, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
        plain = "regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^[\\x{{feff}}]+', '')"
        return (
            f"SELECT id, {plain} AS text, CASE WHEN u // 3 > 0 THEN 'Serif-Book' ELSE 'Sans (Bold)' END AS font, CASE WHEN u // 3 > 0 THEN 20e0 + 2 * (id % 7) ELSE 49e0 END AS size, CAST(id % 50 AS DOUBLE) AS anchor_x, "
            "CASE WHEN u // 3 > 0 THEN 2 ELSE 1 END AS runs, CAST(u - u // 3 AS INT) AS longest, CASE WHEN u // 3 > 0 THEN 'Serif-Book/' || CAST(20e0 + 2 * (id % 7) AS VARCHAR) || '/0.25,' ELSE '' END || 'Sans (Bold)/49.0/1.0' AS styles, CAST(NULL AS VARCHAR) AS error "
            f"FROM (SELECT *, {units} AS u FROM {{turns}} t) q"
        )

    return text


def coverage(vectors: DataFrame) -> DataFrame:
    """(id, y, x, c): how much of each pixel the paths of ``vectors`` (id, embedding) cover, written and read as vector masks."""
    sized = lambda rows: rows.withColumn("width", F.lit(WIDTH)).withColumn("height", F.lit(HEIGHT))
    knots = sized(psd_blocks.knots(psd_blocks.vector_blocks(vectors), ["id"]).filter("error IS NULL"))
    return psd_blocks.coverage(psd_blocks.flattened(knots, ["id"], STEPS), sized(vectors.select("id")), ["id"], ROWS)


def coverage_sql() -> Text:
    """Curves, crossings and stretches straight from the vectors, each in its closed form."""

    def text(d: Dialect) -> str:
        around = ((0.3, 0.3), (0.7, 0.3), (0.7, 0.7), (0.3, 0.7))
        at = lambda k, i, j: f"floor(({around[k % 4][j]!r}e0 + 0.25e0 * CAST(embedding[{6 * (k % 4) + 2 * i + j + 1}] AS DOUBLE)) * 16777216e0 + 0.5e0) / 16777216e0 * {(WIDTH, HEIGHT)[j]}e0"
        curves = " UNION ALL ".join("SELECT id, " + ", ".join(f"{at(k + (n > 1), (1, 2, 0, 1)[n], j)} AS {'xy'[j]}{n}" for n in range(4) for j in range(2)) + " FROM {vectors} v" for k in range(4))
        point = lambda c, t: f"(pow(1e0 - {t}, 3) * {c}0 + 3e0 * pow(1e0 - {t}, 2) * {t} * {c}1 + 3e0 * (1e0 - {t}) * {t} * {t} * {c}2 + pow({t}, 3) * {c}3)"
        a, b = f"(k / {STEPS}e0)", f"((k + 1) / {STEPS}e0)"
        lines = f"SELECT id, {point('x', a)} AS ax, {point('y', a)} AS ay, {point('x', b)} AS bx, {point('y', b)} AS b_y FROM (SELECT *, unnest(range({STEPS})) AS k FROM ({curves}) c) q"
        scans = f"SELECT id, s, ax + ((s + 0.5e0) / {ROWS}e0 - ay) * (bx - ax) / (b_y - ay) AS x, CASE WHEN b_y > ay THEN 1 ELSE -1 END AS turn FROM ({lines}) l, range({HEIGHT * ROWS}) r(s) WHERE least(ay, b_y) <= (s + 0.5e0) / {ROWS}e0 AND (s + 0.5e0) / {ROWS}e0 < greatest(ay, b_y)"
        spans = f"SELECT *, sum(turn) OVER w AS winding, lead(x) OVER w AS stop FROM ({scans}) c WINDOW w AS (PARTITION BY id, s ORDER BY x, turn)"
        part = "greatest(0e0, least(stop, px + 1e0) - greatest(x, px * 1e0))"
        cells = f"SELECT id, CAST(s // {ROWS} AS INT) AS y, CAST(px AS INT) AS x, {part} AS part FROM ({spans}) z, range({WIDTH}) p(px) WHERE winding <> 0 AND stop > px AND x < px + 1"
        return f"SELECT * FROM (SELECT id, y, x, round(sum(part) / {ROWS}e0 + 3e-9, 6) AS c FROM ({cells}) q GROUP BY id, y, x) r WHERE c > 0"

    return text
