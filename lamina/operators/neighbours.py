"""Sliding frames over grey rasters (image_id, y, x, v) of a known size: box means, Gaussians, minima and maxima, gradients, guided filter.

Row and column passes are windows partitioned by image and line, so their shuffles carry one image's lines and not whole frames.
"""

from __future__ import annotations

import math

from lamina.functions import color as c
from lamina.plans.sql import Dialect, Text, num

ROW, COLUMN = ("y", "x"), ("x", "y")


def _frame(line: tuple[str, str], r: int) -> str:
    return f"(PARTITION BY image_id, {line[0]} ORDER BY {line[1]} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)"


def _line(line: tuple[str, str]) -> str:
    return f"(PARTITION BY image_id, {line[0]} ORDER BY {line[1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"


def _box_pass(source: str, e: str, out: str, line: tuple[str, str], r: int, size: int) -> str:
    """Mean over 2r + 1 places; the first and last value stand in for what lies outside."""
    at = line[1]
    before, after = f"greatest(0, {r} - {at})", f"greatest(0, {at} + {r} - {size - 1})"
    return (
        f"SELECT *, (sum({e}) OVER {_frame(line, r)} + first_value({e}) OVER {_line(line)} * {before} + last_value({e}) OVER {_line(line)} * {after}) / {num(2 * r + 1)} AS {out} FROM ({source}) {out}_t"
    )


def box(source: str, e: str, out: str, r: int, width: int, height: int) -> str:
    return _box_pass(_box_pass(source, e, f"{out}_h", ROW, r, width), f"{out}_h", out, COLUMN, r, height)


def box_blur(r: int, width: int = 8, height: int = 8) -> Text:
    return lambda d: f"SELECT image_id, y, x, round(v2, 6) AS v FROM ({box('SELECT image_id, y, x, v * 1e0 AS v FROM {px} p', 'v', 'v2', r, width, height)}) b"


def taps(sigma: float) -> list[float]:
    """Normalised weights at distances -3 sigma to 3 sigma, rounded to whole places."""
    r = max(1, round(3 * sigma))
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def _gauss_pass(source: str, e: str, out: str, line: tuple[str, str], weights: list[float], edge: str) -> str:
    """A weighted sum of lags and leads; past the edge stands the edge's value, or 0."""
    r, w = len(weights) // 2, f"(PARTITION BY image_id, {line[0]} ORDER BY {line[1]})"
    ends = {"before": f"first_value({e}) OVER {_line(line)}", "after": f"last_value({e}) OVER {_line(line)}"} if edge == "clamp" else {"before": "0e0", "after": "0e0"}
    terms = [f"{num(weights[r])} * {e}"]
    for k in range(1, r + 1):
        terms += [f"{num(weights[r - k])} * coalesce(lag({e}, {k}) OVER {w}, {ends['before']})", f"{num(weights[r + k])} * coalesce(lead({e}, {k}) OVER {w}, {ends['after']})"]
    return f"SELECT *, {' + '.join(terms)} AS {out} FROM ({source}) {out}_t"


def gauss(source: str, e: str, out: str, sigma: float, edge: str = "clamp") -> str:
    w = taps(sigma)
    return _gauss_pass(_gauss_pass(source, e, f"{out}_h", ROW, w, edge), f"{out}_h", out, COLUMN, w, edge)


def gaussian_blur(sigma: float, edge: str = "clamp") -> Text:
    return lambda d: f"SELECT image_id, y, x, round(v2, 6) AS v FROM ({gauss('SELECT image_id, y, x, v * 1e0 AS v FROM {px} p', 'v', 'v2', sigma, edge)}) b"


def extreme(source: str, e: str, out: str, r: int, kind: str, width: int, height: int) -> str:
    """Maximum over a truncated square, or minimum, which is 0 where the square leaves the image."""
    one = f"SELECT *, {kind}({e}) OVER {_frame(ROW, r)} AS {out}_h FROM ({source}) {out}_s"
    two = f"SELECT *, {kind}({out}_h) OVER {_frame(COLUMN, r)} AS {out}_v FROM ({one}) {out}_t"
    value = f"{out}_v" if kind == "max" else f"CASE WHEN x < {r} OR y < {r} OR x > {width - 1 - r} OR y > {height - 1 - r} THEN 0 ELSE {out}_v END"
    return f"SELECT *, {value} AS {out} FROM ({two}) {out}_u"


def sliding(kind: str, r: int, width: int = 8, height: int = 8) -> Text:
    return lambda d: f"SELECT image_id, y, x, CAST(v2 AS INT) AS v FROM ({extreme('SELECT image_id, y, x, v FROM {px} p', 'v', 'v2', r, kind, width, height)}) b"


def stroke_ring(r: int, inside: bool = False, width: int = 8, height: int = 8) -> Text:
    """Coverage of a stroke: the grown shape without the shape, or the shape without the shrunk one."""

    def text(d: Dialect) -> str:
        grown = extreme("SELECT image_id, y, x, v FROM {px} p", "v", "v2", r, "min" if inside else "max", width, height)
        return f"SELECT image_id, y, x, CAST({'v - v2' if inside else 'v2 - v'} AS INT) AS v FROM ({grown}) b"

    return text


def binary_morphology(kind: str, steps: int, width: int = 8, height: int = 8) -> Text:
    """Erode or dilate the pixels of at least 128 by whole steps over eight neighbours, frames cut at the image's edge."""

    def text(d: Dialect) -> str:
        k = "max" if kind == "dilate" else "min"
        one = f"SELECT *, {k}(m) OVER {_frame(ROW, steps)} AS m2 FROM (SELECT image_id, y, x, CASE WHEN v >= 128 THEN 1 ELSE 0 END AS m FROM {{px}} p) s"
        return f"SELECT image_id, y, x, {k}(m2) OVER {_frame(COLUMN, steps)} AS m FROM ({one}) t"

    return text


def prefix_sums() -> Text:
    return lambda d: "SELECT image_id, y, x, CAST(sum(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM {px} p"


def edge_strength(r: int = 1) -> Text:
    """Mean absolute difference to the eight neighbours at distance ``r`` that lie in the image."""

    def text(d: Dialect) -> str:
        w = "(PARTITION BY image_id, y ORDER BY x)"
        around = f"SELECT image_id, y, x, v, lag(v, {r}) OVER {w} AS p0, v AS p1, lead(v, {r}) OVER {w} AS p2 FROM {{px}} p"
        up = "(PARTITION BY image_id, x ORDER BY y)"
        lagged = ", ".join(f"lag(p{i}, {r}) OVER {up} AS u{i}, lead(p{i}, {r}) OVER {up} AS d{i}" for i in range(3))
        all_ = [f"u{i}" for i in range(3)] + [f"d{i}" for i in range(3)] + ["p0", "p2"]
        total, n = " + ".join(f"coalesce(abs({k} - v), 0)" for k in all_), " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE 1 END" for k in all_)
        return f"SELECT image_id, y, x, round(({total}) / (({n}) * 1e0), 6) AS edge FROM (SELECT *, {lagged} FROM ({around}) a) b"

    return text


def sharpen(amount: float, r: int, masking: float, width: int = 8, height: int = 8) -> Text:
    """Unsharp mask, faded where edges are weaker than ``masking``."""

    def text(d: Dialect) -> str:
        blurred = box("SELECT image_id, y, x, v * 1e0 AS v FROM {px} p", "v", "v2", r, width, height)
        weight = c.clamp(f"e.edge / {num(max(masking, 1e-6))}")
        return f"SELECT b.image_id, b.y, b.x, CAST(round(least(255e0, greatest(0e0, b.v + {num(amount)} * (b.v - b.v2) * {weight}))) AS INT) AS v FROM ({blurred}) b JOIN ({edge_strength(1)(d)}) e ON e.image_id = b.image_id AND e.y = b.y AND e.x = b.x"

    return text


def local_contrast(texture: float, clarity: float, width: int = 8, height: int = 8) -> Text:
    """Detail against means of radius 1 and 4, added to the tone."""

    def text(d: Dialect) -> str:
        fine = box("SELECT image_id, y, x, v / 255e0 AS t FROM {px} p", "t", "fine", 1, width, height)
        coarse = box(fine, "t", "coarse", 4, width, height)
        return f"SELECT image_id, y, x, round({c.clamp(f't + {num(texture / 100)} * (t - fine) + {num(clarity / 100)} * (t - coarse)')}, 6) AS v FROM ({coarse}) b"

    return text


def glow(amount: float, spread: float = 20, level: float = 40, width: int = 8, height: int = 8) -> Text:
    """What lies above a threshold, blurred and added."""
    edge = 0.55 + 0.4 * level / 100

    def text(d: Dialect) -> str:
        bright = "SELECT image_id, y, x, v / 255e0 AS t, " + c.clamp(f"(v / 255e0 - {num(edge)}) / {num(max(0.05, 1 - edge))}") + " AS s FROM {px} p"
        return f"SELECT image_id, y, x, round({c.clamp(f't + s2 * {num(amount / 100)}')}, 6) AS v FROM ({box(bright, 's', 's2', max(1, round(5 * (1 + spread / 100))), width, height)}) b"

    return text


def tonal_contrast(amount: float, shadows: float = 50, midtones: float = 50, highlights: float = 50, r: int = 2, width: int = 8, height: int = 8) -> Text:
    """Detail against a blurred base, by the base's tone."""

    def text(d: Dialect) -> str:
        blurred = box("SELECT image_id, y, x, v / 255e0 AS t FROM {px} p", "t", "base", r, width, height)
        dark, light = f"(1e0 - {c.smooth_between(0.15, 0.5, 'base')})", c.smooth_between(0.5, 0.85, "base")
        weighted = f"SELECT *, {dark} AS wd, {light} AS wl FROM ({blurred}) b"
        weight = f"({num(shadows)} * wd + {num(midtones)} * (1e0 - wd - wl) + {num(highlights)} * wl) / 100e0"
        tanh = "(1e0 - 2e0 / (exp(12e0 * (t - base)) + 1e0))"
        return f"SELECT image_id, y, x, round({c.clamp(f't + 0.18e0 * {tanh} * {weight} * {num(amount / 50)} * (4e0 * t * (1e0 - t))')}, 6) AS v FROM ({weighted}) w"

    return text


def guided(r: int, epsilon: float, width: int = 8, height: int = 8) -> Text:
    """The guided filter of an image by itself: local linear models from box means of it and its square, averaged."""

    def text(d: Dialect) -> str:
        base = "SELECT image_id, y, x, t, t * t AS tt FROM (SELECT image_id, y, x, v / 255e0 AS t FROM {px} p) q"
        means = box(box(base, "t", "m", r, width, height), "tt", "mm", r, width, height)
        model = f"SELECT *, (mm - m * m) / (mm - m * m + {num(epsilon)}) AS ka FROM ({means}) q"
        model = f"SELECT *, m * (1e0 - ka) AS kb FROM ({model}) q"
        return f"SELECT image_id, y, x, round(ka2 * t + kb2, 6) AS v FROM ({box(box(model, 'ka', 'ka2', r, width, height), 'kb', 'kb2', r, width, height)}) z"

    return text


def matte(contrast: float, shift: float) -> Text:
    """Contrast and edge shift of a mask, as a linear remap about the middle."""
    return lambda d: f"SELECT image_id, y, x, CAST(round(255e0 * {c.clamp(f'(v / 255e0 - 0.5e0) * {num(1 + contrast / 25)} + 0.5e0 + {num(shift / 200)}')}) AS INT) AS v FROM {{px}} p"


def feather(region: Text, amount: float) -> Text:
    """Soft coverage of a region of grey rasters: a Gaussian of half the amount."""
    return lambda d: f"SELECT image_id, y, x, round(c2, 6) AS coverage FROM ({gauss(f'SELECT p.image_id, p.y, p.x, CASE WHEN s.image_id IS NULL THEN 0e0 ELSE 1e0 END AS c FROM {{px}} p LEFT JOIN ({region(d)}) s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x', 'c', 'c2', amount / 2)}) b"


def shape_effect(kind: str, size: float, dx: int = 0, dy: int = 0) -> Text:
    """Coverage of a layer effect over a grey shape: drop shadow, inner shadow, outer glow or inner glow; a shifted shape is 0 outside."""

    def text(d: Dialect) -> str:
        shifted = kind in ("drop_shadow", "inner_shadow") and (dx or dy)
        base = f"SELECT p.image_id, p.y, p.x, p.v / 255e0 AS s, coalesce(q.v, 0) / 255e0 AS m FROM {{px}} p LEFT JOIN {{px}} q ON q.image_id = p.image_id AND q.x = p.x - {dx} AND q.y = p.y - {dy}" if shifted else "SELECT image_id, y, x, v / 255e0 AS s, v / 255e0 AS m FROM {px} p"
        e = {"drop_shadow": "m2", "outer_glow": "m2 * (1e0 - s)", "inner_glow": "s * (1e0 - m2)", "inner_shadow": "s * (1e0 - m2)"}[kind]
        return f"SELECT image_id, y, x, round({e}, 6) AS coverage FROM ({gauss(base, 'm', 'm2', size / 2)}) b"

    return text
