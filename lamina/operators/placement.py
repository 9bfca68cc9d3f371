"""Layers' places and links, and edits that are replayed: sampling policy, drag boxes, margins, following, mask links, undo, curve points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.detail import detail_radius, effects_radius
from lamina.operators.forest import rooted
from lamina.plans.sql import Dialect, Text, num, steps
from lamina.plans.staging import staged


def sampling_policy() -> Text:
    """How a layer is drawn: straight across where it is upright at full size or asks for it, low when it shrinks, else as the layer says."""
    base = "SELECT layer_id, CASE layer_id % 4 WHEN 0 THEN 'nearest' WHEN 1 THEN 'medium' ELSE 'high' END AS sampling, (1 + layer_id % 9) / 5e0 AS factor, layer_id % 2 = 1 AS upright FROM {layers} l"
    return lambda d: f"SELECT layer_id, CASE WHEN sampling = 'nearest' OR (upright AND abs(factor - 1e0) < 0.001e0) THEN 'none' WHEN factor <= 1 THEN 'low' ELSE sampling END AS quality FROM ({base}) b"


def drag_box() -> Text:
    """The box of a drag from an anchor to a point in whole pixels: square for even events, about the anchor for every third."""
    base = "SELECT event_id, x * 1e0 AS ax, y * 1e0 AS ay, round(x + (value - 50e0) / 3e0) - x AS dx, round(y - value / 7e0) - y AS dy FROM {heat} h"
    square = "SELECT event_id, ax, ay, CASE WHEN event_id % 2 = 1 THEN dx WHEN dx < 0 THEN -greatest(abs(dx), abs(dy)) ELSE greatest(abs(dx), abs(dy)) END AS dx, CASE WHEN event_id % 2 = 1 THEN dy WHEN dy < 0 THEN -greatest(abs(dx), abs(dy)) ELSE greatest(abs(dx), abs(dy)) END AS dy FROM (" + base + ") b"
    middle = "event_id % 3 = 0"
    return lambda d: f"SELECT event_id, CASE WHEN {middle} THEN ax - abs(dx) ELSE least(ax, ax + dx) END AS x0, CASE WHEN {middle} THEN ay - abs(dy) ELSE least(ay, ay + dy) END AS y0, abs(dx) * CASE WHEN {middle} THEN 2e0 ELSE 1e0 END AS width, abs(dy) * CASE WHEN {middle} THEN 2e0 ELSE 1e0 END AS height FROM ({square}) s"


def grown_for_blur(width: int = 8, height: int = 8) -> Text:
    """Bounds a layer needs before a filter spreads it: three sigma for a Gaussian and a bloom, half the distance for motion, and 2 more."""
    margin = "CASE layer_id % 4 WHEN 0 THEN 3e0 * (layer_id % 7) + 2e0 WHEN 1 THEN (layer_id % 11) / 2e0 + 2e0 WHEN 2 THEN 3e0 * (layer_id % 5) + 2e0 ELSE 0e0 END"
    return lambda d: f"SELECT layer_id, CAST(-m AS INT) AS x0, CAST(-m AS INT) AS y0, CAST({width} + m AS INT) AS x1, CAST({height} + m AS INT) AS y1 FROM (SELECT layer_id, ceil({margin}) AS m FROM {{layers}} l) b"


def radii() -> Text:
    """Radii of detail and effects by slider and scale, within their limits."""
    base = "least(64e0, greatest(0.5e0, (0.5e0 + value / 100e0 * 2.5e0) * CASE WHEN x > 0 THEN x * 1e0 ELSE 1e0 END))"
    return lambda d: f"SELECT event_id, round({base}, 6) AS detail, CAST(floor(least(64e0, greatest(1e0, {base})) + 0.5e0) AS INT) AS effects FROM {{heat}} h"


def radius_pair(slider: float, scale: float) -> tuple[float, int]:
    """The same for one slider."""
    return detail_radius(slider, scale), effects_radius(detail_radius(slider, scale))


def random_steps(n: int = 3) -> Text:
    """States of the linear congruential generator (1664525, 1013904223, modulo 2**32) after 1 to n steps from each event's number."""
    levels = [{f"s{k + 1}": f"(s{k} * CAST(1664525 AS BIGINT) + 1013904223) % 4294967296"} for k in range(n)]
    return lambda d: steps("(SELECT event_id, CAST(event_id AS BIGINT) * 2654435 % 4294967296 AS s0 FROM {heat} h) z", levels, "event_id, " + ", ".join(f"s{k + 1}" for k in range(n)))


def curve_points() -> Text:
    """Curves (user_id, k, x, y) of at least two points, by x, with ends at 0 and 255 put in where there are none."""

    def text(d: Dialect) -> str:
        points = "SELECT user_id, event_id, CAST(least(255e0, floor(value * 2.6e0)) AS INT) AS x, CAST(event_id % 256 AS INT) AS y FROM {heat} h"
        ranked = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x, event_id) AS k, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS n FROM ({points}) p"
        every = f"SELECT user_id, 1 AS part, k, x, y FROM ({ranked}) a WHERE n > 1 UNION ALL SELECT user_id, 0, 0, 0, y FROM ({ranked}) b WHERE n > 1 AND k = 1 AND x <> 0 UNION ALL SELECT user_id, 2, 0, 255, y FROM ({ranked}) c WHERE n > 1 AND back = 1 AND x <> 255"
        return f"SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY part, k) AS INT) AS k, x, y FROM ({every}) e"

    return text


def dirty_union() -> Text:
    """The box around all boxes touched, by user."""
    return lambda d: "SELECT user_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM {heat} h GROUP BY user_id"


def _unit_map(p: str) -> dict[str, str]:
    """The matrix that maps the unit square to where ``p``'s origin, size, rotation and flips put it."""
    sx, sy = f"({p}w * CASE WHEN {p}fx THEN -1e0 ELSE 1e0 END)", f"({p}h * CASE WHEN {p}fy THEN -1e0 ELSE 1e0 END)"
    cos, sin = f"cos(radians({p}rot))", f"sin(radians({p}rot))"
    return {f"{p}a": f"{sx} * {cos}", f"{p}b": f"{sx} * {sin}", f"{p}c": f"-{sy} * {sin}", f"{p}d": f"{sy} * {cos}", f"{p}tx": f"{p}x + {p}w / 2e0 - ({sx} * {cos} - {sy} * {sin}) / 2e0", f"{p}ty": f"{p}y + {p}h / 2e0 - ({sx} * {sin} + {sy} * {cos}) / 2e0"}


def following() -> Text:
    """(layer_id, x, y, w, h, rot, fy): a layer carried along as the one it follows moves, turns and is scaled; shear is dropped, the flip across kept."""

    def text(d: Dialect) -> str:
        own = "layer_id % 50 * 1e0 AS ox, layer_id % 31 * 1e0 AS oy, 10e0 + layer_id % 13 AS ow, 8e0 + layer_id % 7 AS oh, (layer_id % 12) * 30e0 AS orot, layer_id % 5 = 0 AS ofx, layer_id % 3 = 0 AS ofy"
        old = "20e0 + layer_id % 9 AS qx, 5e0 AS qy, 30e0 AS qw, 24e0 AS qh, (layer_id % 4) * 15e0 AS qrot, false AS qfx, false AS qfy"
        new = "25e0 AS nx, 12e0 + layer_id % 6 AS ny, 45e0 AS nw, 36e0 AS nh, (layer_id % 4) * 15e0 + 40e0 AS nrot, false AS nfx, layer_id % 2 = 0 AS nfy"
        levels = [_unit_map("o"), _unit_map("q"), _unit_map("n"), {"det": "qa * qd - qb * qc"}]
        # own, then the old one's inverse, then the new one
        inverse = {"ia": "qd / det", "ib": "-qb / det", "ic": "-qc / det", "id": "qa / det"}
        shift = {"itx": "-(qtx * ia + qty * ic)", "ity": "-(qtx * ib + qty * id)"}
        one = {"ua": "oa * ia + ob * ic", "ub": "oa * ib + ob * id", "uc": "oc * ia + od * ic", "ud": "oc * ib + od * id", "utx": "otx * ia + oty * ic + itx", "uty": "otx * ib + oty * id + ity"}
        two = {"ma": "ua * na + ub * nc", "mb": "ua * nb + ub * nd", "mc": "uc * na + ud * nc", "md": "uc * nb + ud * nd", "mtx": "utx * na + uty * nc + ntx", "mty": "utx * nb + uty * nd + nty"}
        sign = "CASE WHEN ofx THEN -1e0 ELSE 1e0 END"
        placed = [{"angle": f"atan2(mb * {sign}, ma * {sign})"}, {"along": "-mc * sin(angle) + md * cos(angle)", "rw": "sqrt(ma * ma + mb * mb)", "px": "(ma + mc) / 2e0 + mtx", "py": "(mb + md) / 2e0 + mty", "deg": "angle * 180e0 / pi()"}]
        out = "layer_id, round(px - rw / 2e0, 5) + 0e0 AS x, round(py - abs(along) / 2e0, 5) + 0e0 AS y, round(rw, 5) AS w, round(abs(along), 5) AS h, round(deg + round(round((orot - deg) / 360e0, 9)) * 360e0, 5) + 0e0 AS rot, along < 0 AS fy"
        return steps(f"(SELECT layer_id, {own}, {old}, {new} FROM {{layers}} l) z", [*levels, inverse, shift, one, two, *placed], out)

    return text


# Links from layers to the layers that mask them

LINKS = "SELECT layer_id AS id, CASE WHEN layer_id % 97 = 5 THEN -1 WHEN layer_id % 89 = 3 THEN layer_id WHEN z > 2 AND layer_id % 4 <> 1 THEN lag(layer_id, 2) OVER (PARTITION BY document_id ORDER BY z) END AS source_id, layer_id % 41 = 0 AS is_group, layer_id % 43 = 0 AS is_adjustment FROM {layers} l"
_RULES = (
    "SELECT 'unknown' AS rule, k.id FROM links k LEFT JOIN links s ON s.id = k.source_id WHERE k.source_id IS NOT NULL AND s.id IS NULL UNION ALL SELECT 'source', k.id FROM links k JOIN links s ON s.id = k.source_id WHERE s.is_group OR s.is_adjustment "
    "UNION ALL SELECT 'folder', id FROM links WHERE is_group AND source_id IS NOT NULL UNION ALL SELECT 'endless', k.id FROM links k LEFT JOIN w ON w.id = k.id JOIN links s ON s.id = k.source_id WHERE w.id IS NULL UNION ALL SELECT 'long', id FROM w WHERE n > 256"
)


def mask_link_violations() -> Text:
    """Links that break a rule: an unknown source, one that is a folder or adjusts, a folder with a source, a chain without end or of more than 256."""
    walk = "SELECT k.id, 1 AS n FROM links k LEFT JOIN links s ON s.id = k.source_id WHERE s.id IS NULL UNION ALL SELECT k.id, w.n + 1 FROM w JOIN links k ON k.source_id = w.id WHERE k.id <> k.source_id"
    return lambda d: f"WITH RECURSIVE links AS ({LINKS}), w AS ({walk}) {_RULES}"


def mask_link_frames(layers: DataFrame) -> DataFrame:
    """The same in Spark, by pointer doubling along the links."""
    links = staged(layers.sparkSession.sql(LINKS, layers=layers))
    known = links.select(F.col("id").alias("source_id"), F.lit(True).alias("found"))
    tree = links.join(known, "source_id", "left").select("id", F.when(F.col("found"), F.col("source_id")).alias("parent_id"))
    walked = staged(rooted(tree, {"n": (F.lit(1), lambda a, b: a + b)}))
    return layers.sparkSession.sql("WITH links AS (SELECT * FROM {links} a), w AS (SELECT * FROM {w} b) " + _RULES, links=links, w=walked)


# Undo and redo

_KINDS = "SELECT user_id, event_id, ts, CASE WHEN event_id % 5 = 1 THEN 'undo' WHEN event_id % 5 = 3 THEN 'redo' ELSE 'edit' END AS kind FROM {heat} h"


def history() -> Text:
    """(user_id, past, future, current): the stacks after all of a user's edits, undos and redos, and the edit that is current (0: none)."""

    def text(d: Dialect) -> str:
        if d.spark:
            begin = "named_struct('past', CAST(array() AS array<bigint>), 'future', CAST(array() AS array<bigint>))"
            tail = "slice(acc.{0}, 1, size(acc.{0}) - 1)"
            step = (
                "CASE WHEN e.kind = 'edit' THEN named_struct('past', concat(acc.past, array(CAST(e.event_id AS BIGINT))), 'future', CAST(array() AS array<bigint>)) "
                f"WHEN e.kind = 'undo' AND size(acc.past) > 0 THEN named_struct('past', {tail.format('past')}, 'future', concat(acc.future, slice(acc.past, size(acc.past), 1))) "
                f"WHEN e.kind = 'redo' AND size(acc.future) > 0 THEN named_struct('past', concat(acc.past, slice(acc.future, size(acc.future), 1)), 'future', {tail.format('future')}) ELSE acc END"
            )
            return f"SELECT user_id, CAST(size(s.past) AS BIGINT) AS past, CAST(size(s.future) AS BIGINT) AS future, coalesce(try_element_at(s.past, -1), 0) AS current FROM (SELECT user_id, aggregate(array_sort(collect_list(struct(ts, event_id, kind))), {begin}, (acc, e) -> {step}) AS s FROM ({_KINDS}) k GROUP BY user_id) q"
        ranked = f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ({_KINDS}) q"
        pop = "list_slice(w.{0}, 1, len(w.{0}) - 1)"
        past = f"CASE WHEN n.kind = 'edit' THEN list_append(w.past, CAST(n.event_id AS BIGINT)) WHEN n.kind = 'undo' AND len(w.past) > 0 THEN {pop.format('past')} WHEN n.kind = 'redo' AND len(w.future) > 0 THEN list_append(w.past, w.future[-1]) ELSE w.past END"
        future = f"CASE WHEN n.kind = 'edit' THEN CAST([] AS BIGINT[]) WHEN n.kind = 'undo' AND len(w.past) > 0 THEN list_append(w.future, w.past[-1]) WHEN n.kind = 'redo' AND len(w.future) > 0 THEN {pop.format('future')} ELSE w.future END"
        walk = f"n AS ({ranked}), w AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS past, CAST([] AS BIGINT[]) AS future FROM n UNION ALL SELECT n.user_id, n.k, {past}, {future} FROM w JOIN n ON n.user_id = w.user_id AND n.k = w.k + 1)"
        return f"WITH RECURSIVE {walk} SELECT user_id, CAST(len(past) AS BIGINT) AS past, CAST(len(future) AS BIGINT) AS future, coalesce(past[-1], 0) AS current FROM (SELECT *, max(k) OVER (PARTITION BY user_id) AS top FROM w) t WHERE k = top"

    return text
