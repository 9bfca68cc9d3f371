"""Aggregates over pixels: weighted histograms and what is read off them, densities, means and bounding boxes."""

from __future__ import annotations

import math

from lamina.functions import color as c
from lamina.plans.sql import Dialect, Text, num, steps


def histogram() -> Text:
    """(image_id, channel, bin, weight): channel 0 is the mean of the others; a pixel weighs its alpha. Only bins with weight have rows."""

    def text(d: Dialect) -> str:
        value = lambda k: f"CAST(least(255e0, round({k} * 255e0 / a)) AS INT)"
        parts = [f"SELECT image_id, {i + 1} AS channel, {value(k)} AS bin, a / 255e0 AS w FROM {{px}} p WHERE a > 0 UNION ALL SELECT image_id, 0, {value(k)}, a / 765e0 FROM {{px}} p WHERE a > 0" for i, k in enumerate("rgb")]
        return f"SELECT image_id, channel, bin, round(sum(w), 6) AS weight FROM ({' UNION ALL '.join(parts)}) u GROUP BY image_id, channel, bin"

    return text


def total_histogram() -> Text:
    """(channel, bin, weight) of all images together."""
    return lambda d: f"SELECT channel, bin, round(sum(weight), 6) AS weight FROM ({histogram()(d)}) h GROUP BY channel, bin"


def auto_levels(share: float = 0.001) -> Text:
    """(image_id, channel, black, white): the first bins from each end where the running sum passes ``share`` of the total, if they are apart."""

    def text(d: Dialect) -> str:
        running = f"SELECT *, sum(weight) OVER (PARTITION BY image_id, channel ORDER BY bin) AS up, sum(weight) OVER (PARTITION BY image_id, channel ORDER BY bin DESC) AS down, sum(weight) OVER (PARTITION BY image_id, channel) AS total FROM ({histogram()(d)}) h"
        ends = f"SELECT image_id, channel, min(CASE WHEN up > total * {num(share)} THEN bin END) AS black, max(CASE WHEN down > total * {num(share)} THEN bin END) AS white FROM ({running}) r GROUP BY image_id, channel"
        return f"SELECT image_id, channel, black, white FROM ({ends}) e WHERE black < white"

    return text


def neutral_gamma() -> Text:
    """(image_id, channel, gamma): what brings the stretched histogram's mean to the middle."""

    def text(d: Dialect) -> str:
        joined = f"SELECT h.image_id, h.channel, sum(h.weight * least(1e0, greatest(0e0, (h.bin - e.black) / ((e.white - e.black) * 1e0)))) / sum(h.weight) AS mean FROM ({histogram()(d)}) h JOIN ({auto_levels()(d)}) e ON e.image_id = h.image_id AND e.channel = h.channel WHERE h.channel > 0 GROUP BY h.image_id, h.channel"
        return f"SELECT image_id, channel, round(least(9.99e0, greatest(0.1e0, ln(mean) / ln(0.5e0))), 6) AS gamma FROM ({joined}) j WHERE mean > 0 AND mean < 1"

    return text


def display_scale() -> Text:
    """(channel, scale): the histogram's peak, or four times the 95th percentile of its inner bins, if that is less."""

    def text(d: Dialect) -> str:
        ranked = f"SELECT *, row_number() OVER (PARTITION BY channel, (bin BETWEEN 1 AND 254) ORDER BY weight) AS n, count(*) OVER (PARTITION BY channel, (bin BETWEEN 1 AND 254)) AS m FROM ({total_histogram()(d)}) h WHERE weight > 0"
        typical = "max(CASE WHEN bin BETWEEN 1 AND 254 AND n = CAST(floor((m - 1) * 0.95e0) AS INT) + 1 THEN weight END)"
        return f"SELECT channel, round(least(max(weight), coalesce(4e0 * {typical}, max(weight))), 6) AS scale FROM ({ranked}) r GROUP BY channel"

    return text


def vectorscope(side: int = 64) -> Text:
    """(row, col, weight): alpha by hue and saturation on a plane."""

    def text(d: Dialect) -> str:
        levels = [
            {f"{k}1": c.straight(k) for k in "rgb"},
            {"mx": c.high("r1", "g1", "b1"), "mn": c.low("r1", "g1", "b1")},
            {"ch": "mx - mn"},
            {"hue": c.hue_degrees("r1", "g1", "b1", "mx", "ch", 1e-4)},
            {"px_": f"0.5e0 + cos(hue / 180e0 * {num(math.pi)}) * (ch / nullif(mx, 0)) * 0.48e0", "py_": f"0.5e0 + sin(hue / 180e0 * {num(math.pi)}) * (ch / nullif(mx, 0)) * 0.48e0"},
            # the plane's cells; a place within 1e-9 of an edge goes to the cell above in both engines
            {"col_": f"CAST(least({num(side - 1)}, greatest(0e0, floor(px_ * {num(side)} + 1e-9))) AS INT)", "row_": f"CAST(least({num(side - 1)}, greatest(0e0, floor(py_ * {num(side)} + 1e-9))) AS INT)"},
        ]
        inner = steps("{px}", levels, "*", "WHERE a > 0 AND ch > 1e-4 AND mx > 1e-4")
        return f"SELECT row_ AS row, col_ AS col, round(sum(a / 255e0), 6) AS weight FROM ({inner}) i GROUP BY row_, col_"

    return text


def grey_world() -> Text:
    """(image_id, red, green, blue): means in linear light where there is coverage."""

    def text(d: Dialect) -> str:
        inner = steps("{px}", [{f"{k}1": c.straight(k) for k in "rgb"}, {f"{k}2": c.linear(f"{k}1") for k in "rgb"}], "*", "WHERE a > 0")
        return f"SELECT image_id, round(avg(r2), 9) AS red, round(avg(g2), 9) AS green, round(avg(b2), 9) AS blue FROM ({inner}) i GROUP BY image_id"

    return text


def white_balance(warm: float = 0.3, tint_side: float = 0.15, tint_green: float = 0.15) -> Text:
    """(image_id, temperature, tint): the gains' two axes, by Cramer's rule, that make the grey-world mean neutral."""

    def text(d: Dialect) -> str:
        a = {"a1": f"{num(warm)} * red", "b1": f"{num(tint_side)} * red + {num(tint_green)} * green", "c1": "green - red", "a2": f"-{num(warm)} * blue", "b2": f"{num(tint_side)} * blue + {num(tint_green)} * green", "c2": "green - blue"}
        return steps(f"({grey_world()(d)}) m", [a, {"dt": "a1 * b2 - a2 * b1"}], "image_id, round(100e0 * (c1 * b2 - c2 * b1) / dt, 5) AS temperature, round(100e0 * (a1 * c2 - a2 * c1) / dt, 5) AS tint", "WHERE red > 1e-4 AND green > 1e-4 AND blue > 1e-4 AND abs(dt) > 1e-8")

    return text


def bounds(where: str = "a > 0") -> Text:
    """(image_id, x0, y0, x1, y1), half-open."""
    return lambda d: f"SELECT image_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM {{px}} p WHERE {where} GROUP BY image_id"


def trim(tolerance: int = 10, edges: tuple[bool, bool, bool, bool] = (True, True, True, True), width: int = 4, height: int = 4) -> Text:
    """Bounds of what differs from the top left corner's colour; edges not asked for stay. A uniform image has no row."""
    left, top, right, bottom = edges

    def text(d: Dialect) -> str:
        corner = "SELECT image_id AS ref_id, " + ", ".join(f"{k} AS {k}_ref" for k in "rgba") + " FROM {px} q WHERE x = 0 AND y = 0"
        same = " AND ".join(f"abs(p.{k} - f.{k}_ref) <= {tolerance}" for k in "rgba")
        pick = lambda on, e, other: e if on else str(other)
        return f"SELECT p.image_id, {pick(left, 'min(p.x)', 0)} AS x0, {pick(top, 'min(p.y)', 0)} AS y0, {pick(right, 'max(p.x) + 1', width)} AS x1, {pick(bottom, 'max(p.y) + 1', height)} AS y1 FROM {{px}} p JOIN ({corner}) f ON f.ref_id = p.image_id WHERE NOT ({same}) GROUP BY p.image_id"

    return text


def cell_means(cell: int) -> Text:
    """(image_id, cy, cx, tone): mean luma of each cell's covered pixels."""

    def text(d: Dialect) -> str:
        inner = steps("{px}", [{f"{k}1": c.straight(k) for k in "rgb"}], "*", "WHERE a > 0")
        return f"SELECT image_id, CAST({d.div('y', str(cell))} AS INT) AS cy, CAST({d.div('x', str(cell))} AS INT) AS cx, round(avg({c.luma()}), 6) AS tone FROM ({inner}) i GROUP BY image_id, CAST({d.div('y', str(cell))} AS INT), CAST({d.div('x', str(cell))} AS INT)"

    return text


def block_average(cell: int) -> Text:
    """Box halving or any whole-number reduction: (image_id, y, x, r, g, b, a)."""
    mean = lambda k: f"CAST(round(avg({k})) AS INT) AS {k}"
    return lambda d: f"SELECT image_id, y2 AS y, x2 AS x, {', '.join(mean(k) for k in 'rgba')} FROM (SELECT *, CAST({d.div('y', str(cell))} AS INT) AS y2, CAST({d.div('x', str(cell))} AS INT) AS x2 FROM {{px}} p) q GROUP BY image_id, y2, x2"


def mask_background(width: int = 8, height: int = 8) -> Text:
    """Whether the border's mean reaches the middle: what a mask is outside its own pixels."""
    return lambda d: f"SELECT image_id, CASE WHEN sum(v) * 2 >= count(*) * 255 THEN 255 ELSE 0 END AS background FROM {{px}} p WHERE x IN (0, {width - 1}) OR y IN (0, {height - 1}) GROUP BY image_id"


def selected_count(region: Text) -> Text:
    return lambda d: f"SELECT image_id, count(*) AS n FROM ({region(d)}) r GROUP BY image_id"


def glyph_match(cell: int = 2, glyphs: tuple[float, ...] = tuple(i / 9 for i in range(10))) -> Text:
    """For each cell the glyph whose coverage is nearest to its darkness, the first of equals."""

    def text(d: Dialect) -> str:
        table = d.array([num(g) for g in glyphs])
        tried = f"SELECT image_id, cy, cx, g, abs({d.at(table, 'g')} - (1e0 - tone)) AS off FROM (SELECT *, {d.explode(d.series('0', str(len(glyphs) - 1)), 'g')} FROM ({cell_means(cell)(d)}) m) e"
        ranked = f"SELECT *, row_number() OVER (PARTITION BY image_id, cy, cx ORDER BY off, g) AS n FROM ({tried}) t"
        return f"SELECT image_id, cy, cx, CAST(g AS INT) AS glyph FROM ({ranked}) r WHERE n = 1"

    return text


def running_budget(limit: float) -> Text:
    """(o_custkey, o_orderkey, used): rows of orders up to where the running total of their prices passes ``limit``."""
    return lambda d: f"SELECT o_custkey, o_orderkey, round(used, 2) AS used FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM {{orders}} o) s WHERE used <= {num(limit)}"
