"""Small edits of settings and metadata as queries: eyedroppers, hue bands, curve nudges, tile covers, halos, units and clipping upkeep."""

from __future__ import annotations

from lamina.functions import color as c
from lamina.plans.sql import Dialect, Text, num, steps


def levels_eyedropper(mode: str, black: float = 0, white: float = 255) -> Text:
    """(image_id, r, g, b): from each image's first pixel with coverage, the new black, white or gamma of its three channels."""

    def text(d: Dialect) -> str:
        first = "(SELECT image_id, r, g, b, a FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y, x) AS n FROM {px} p WHERE a > 0) q WHERE n = 1)"
        value = lambda k: f"{c.straight(k)} * 255e0"
        if mode == "black":
            made = {f"{k}9": f"least({num(white - 1)}, greatest(0e0, {value(k)}))" for k in "rgb"}
        elif mode == "white":
            made = {f"{k}9": f"greatest({num(black + 1)}, least(255e0, {value(k)}))" for k in "rgb"}
        else:
            share = {k: f"(({value(k)} - {num(black)}) / {num(white - black)})" for k in "rgb"}
            made = {f"{k}9": f"CASE WHEN {s} > 0 AND {s} < 1 THEN least(9.99e0, greatest(0.1e0, ln(greatest(1e-9, {s})) / ln(0.5e0))) ELSE 1e0 END" for k, s in share.items()}
        return steps(first, [made], "image_id, " + ", ".join(f"round({k}9, 6) AS {k}" for k in "rgb"))

    return text


def hue_band_moved(width: float = 30, falloff: float = 30) -> Text:
    """(event_id, start, first, last, end): bands of hue centred on each event's value, wrapped to a circle."""
    wrap = lambda e: f"round(({e}) % 360e0 + CASE WHEN ({e}) % 360e0 < 0 THEN 360e0 ELSE 0e0 END, 6)"
    w, f = num(width / 2), num(width / 2 + falloff)
    return lambda d: f"SELECT event_id, {wrap(f'value - {f}')} AS start, {wrap(f'value - {w}')} AS first, {wrap(f'value + {w}')} AS last, {wrap(f'value + {f}')} AS end_ FROM {{heat}} h"


def hue_weights(band: tuple[float, float, float, float] = (315, 345, 15, 45)) -> Text:
    """(event_id, weight): how strongly a band claims each event's value as a hue."""
    start = band[0]
    ahead = lambda x: (x - start) % 360

    def text(d: Dialect) -> str:
        at = {"pos": c.forward(num(start), "value")}
        return steps("{heat}", [at], f"event_id, round({c.band_weight('pos', ahead(band[1]), ahead(band[2]), ahead(band[3]))}, 6) AS weight")

    return text


def saturation_law(amount: float) -> Text:
    return lambda d: f"SELECT event_id, round({c.saturated('(value / 500e0)', amount)}, 6) AS saturation FROM {{heat}} h"


def curve_nudged(points: tuple[tuple[float, float], ...] = ((0, 0), (64, 60), (128, 140), (255, 255)), delta: float = 8) -> Text:
    """(event_id, x, y): the control point nearest to each event's value as a tone, the first of equals, moved up."""

    def text(d: Dialect) -> str:
        tried = " UNION ALL ".join(f"SELECT event_id, {i} AS i, {num(x)} AS x, {num(y)} AS y, abs(value / 2e0 - {num(x)}) AS off FROM {{heat}} h" for i, (x, y) in enumerate(points))
        return f"SELECT event_id, x, least(255e0, greatest(0e0, y + {num(delta)})) AS y FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY off, i) AS n FROM ({tried}) t) r WHERE n = 1"

    return text


def tile_cover(edge: int = 50, reach: float = 5) -> Text:
    """(user_id, ty, tx): tiles that the boxes of a path's segments (hour, value), grown by the brush, touch."""

    def text(d: Dialect) -> str:
        path = "SELECT user_id, x * 20e0 AS x0, value AS y0, lead(x * 20e0) OVER (PARTITION BY user_id ORDER BY event_id) AS x1, lead(value) OVER (PARTITION BY user_id ORDER BY event_id) AS y1 FROM {heat} h"
        low, high = (lambda a, b: f"CAST(floor((least({a}, {b}) - {num(reach)}) / {num(edge)}) AS INT)"), (lambda a, b: f"CAST(floor((greatest({a}, {b}) + {num(reach)}) / {num(edge)}) AS INT)")
        rows = f"SELECT user_id, tx0, tx1, {d.explode(d.series('ty0', 'ty1'), 'ty')} FROM (SELECT user_id, {low('x0', 'x1')} AS tx0, {high('x0', 'x1')} AS tx1, {low('y0', 'y1')} AS ty0, {high('y0', 'y1')} AS ty1 FROM ({path}) p WHERE x1 IS NOT NULL) b"
        return f"SELECT DISTINCT user_id, CAST(ty AS INT) AS ty, CAST(tx AS INT) AS tx FROM (SELECT user_id, ty, {d.explode(d.series('tx0', 'tx1'), 'tx')} FROM ({rows}) r) t"

    return text


def largest_halo() -> Text:
    """(document_id, halo): the widest margin that any visible layer's adjustment reads beyond a tile; by its id as a radius."""
    return lambda d: "SELECT document_id, CAST(max(3 * (layer_id % 8) + 2) AS INT) AS halo FROM {layers} l WHERE is_visible GROUP BY document_id"


def units(resolution: float = 300) -> Text:
    """(p_partkey, inches, centimetres, points, percent): sizes of parts as pixels in other units."""
    return lambda d: f"SELECT p_partkey, round(p_size / {num(resolution)}, 6) AS inches, round(p_size * 2.54e0 / {num(resolution)}, 6) AS centimetres, round(p_size * 72e0 / {num(resolution)}, 6) AS points, round(p_size * 100e0 / 50e0, 6) AS percent FROM {{part}} p"


def detached_clips() -> Text:
    """Layers clipped to a base (here ids that are no multiple of 3) whose run below has no base, as none stands at the bottom."""

    def text(d: Dialect) -> str:
        runs = "SELECT *, sum(CASE WHEN layer_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bases FROM {layers} l"
        return f"SELECT layer_id FROM ({runs}) r WHERE layer_id % 3 <> 0 AND bases = 0"

    return text


def digit_pairs(gap_seconds: float = 1800) -> Text:
    """(user_id, first_id, second_id): events that follow within a gap combine in pairs; each is used once, from the start of its run."""

    def text(d: Dialect) -> str:
        micros = "unix_micros(CAST(ts AS TIMESTAMP))" if d.spark else "epoch_us(ts)"
        marked = f"SELECT user_id, event_id, {micros} AS t, CASE WHEN {micros} - lag({micros}) OVER (PARTITION BY user_id ORDER BY ts, event_id) < {int(gap_seconds * 1e6)} THEN 0 ELSE 1 END AS s FROM {{heat}} h"
        runs = f"SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ({marked}) m"
        placed = f"SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS n, lead(event_id) OVER (PARTITION BY user_id, run ORDER BY t, event_id) AS after FROM ({runs}) r"
        return f"SELECT user_id, event_id AS first_id, after AS second_id FROM ({placed}) p WHERE n % 2 = 1 AND after IS NOT NULL"

    return text


def homography_columns() -> Text:
    """(id, g, h): the perspective terms of quads, 0 for parallelograms."""

    def text(d: Dialect) -> str:
        sums = {"sx": "x0 - x1 + x2 - x3", "sy": "y0 - y1 + y2 - y3", "ux": "x1 - x2", "vx": "x3 - x2", "uy": "y1 - y2", "vy": "y3 - y2"}
        flat = "(abs(sx) <= 1e-9 AND abs(sy) <= 1e-9) OR abs(dt) <= 1e-12"
        return steps("{quads}", [sums, {"dt": "ux * vy - vx * uy"}], f"id, round(CASE WHEN {flat} THEN 0e0 ELSE (sx * vy - vx * sy) / nullif(dt, 0) END, 6) + 0e0 AS g, round(CASE WHEN {flat} THEN 0e0 ELSE (ux * sy - sx * uy) / nullif(dt, 0) END, 6) + 0e0 AS h")

    return text
