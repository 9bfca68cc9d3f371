"""Detail work on whole frames of premultiplied pixels (image_id, y, x, r, g, b, a): scan lines, noise reduction, sharpening, glow, effects in order, copies.

Neighbourhoods are windows within one image's lines, or joins by image and place.
"""

from __future__ import annotations

from lamina.functions import color as c
from lamina.operators import adjust as A
from lamina.operators import neighbours as N
from lamina.operators.compose import flatten
from lamina.plans.sql import Dialect, Text, num, steps

RGB = "rgb"
_PIXELS = "SELECT image_id, y, x, r, g, b, a, " + ", ".join(f"coalesce({c.straight(k)}, 0e0) AS {k}1" for k in RGB) + " FROM {px} p"
#: The same with the luma of each pixel, 0 where it is clear.
_LUMA = f"SELECT *, {c.luma()} AS lum FROM ({_PIXELS}) s"
#: The middles of the eight hue families, in degrees.
FAMILIES = (0, 30, 60, 120, 180, 240, 270, 300)


def effects_radius(base: float, scale: float = 1) -> int:
    """Whole pixels, from 1 to 64."""
    return int(min(64.0, max(1.0, base * (scale if scale > 0 else 1))) + 0.5)


def detail_radius(slider: float, scale: float = 1) -> float:
    return min(64.0, max(0.5, (0.5 + slider / 100 * 2.5) * (scale if scale > 0 else 1)))


def _bytes(names: tuple[str, str, str]) -> str:
    """Straight channels back to premultiplied bytes."""
    return "image_id, y, x, " + ", ".join(f"{c.premultiplied(n, k)} AS {k}" for k, n in zip(RGB, names, strict=True)) + ", a"


def _edge(source: str, e: str, out: str, r: int) -> str:
    """``out``: the mean absolute difference of ``e`` to those of the eight places at distance ``r`` that lie in the image."""
    row, column = "(PARTITION BY image_id, y ORDER BY x)", "(PARTITION BY image_id, x ORDER BY y)"
    one = f"SELECT *, lag({e}, {r}) OVER {row} AS {out}0, {e} AS {out}1, lead({e}, {r}) OVER {row} AS {out}2 FROM ({source}) {out}s"
    above = ", ".join(f"lag({out}{i}, {r}) OVER {column} AS {out}u{i}, lead({out}{i}, {r}) OVER {column} AS {out}d{i}" for i in range(3))
    around = [f"{out}{k}" for k in ("0", "2", "u0", "u1", "u2", "d0", "d1", "d2")]
    total, n = " + ".join(f"coalesce(abs({k} - {e}), 0e0)" for k in around), " + ".join(f"CASE WHEN {k} IS NULL THEN 0e0 ELSE 1e0 END" for k in around)
    return f"SELECT *, coalesce(({total}) / nullif({n}, 0), 0e0) AS {out} FROM (SELECT *, {above} FROM ({one}) {out}t) {out}v"


def scanlines(spacing: int = 2, wobble: float = 1.5, dots: float = 0.4, dark: tuple[int, int, int] = (10, 20, 30), light: tuple[int, int, int] = (230, 255, 240), width: int = 4) -> Text:
    """Lines of a tube's beam: each line's tone along it is the mean of the rows it covers, pushed sideways; the beam is wider where it is lighter, and may break into beads."""
    middle = spacing / 2

    def text(d: Dialect) -> str:
        line = f"CAST({d.div('y', str(spacing))} AS BIGINT)"
        wave = "sin(line * 0.45e0) * 0.7e0 + sin(line * 1.7e0 + 1.3e0) * 0.3e0"
        lined = f"SELECT *, {line} AS line FROM ({_LUMA}) l"
        scan = f"SELECT image_id, line, x + CAST(round({num(wobble)} * ({wave})) AS BIGINT) AS x, avg({c.clamp('lum')}) AS t FROM ({lined}) m WHERE a > 0 GROUP BY image_id, line, x + CAST(round({num(wobble)} * ({wave})) AS BIGINT)"
        along = f"((x + 0.5e0) % {num(spacing)} - {num(middle)})"
        placed = f"SELECT *, {along} * {num(dots)} AS across, CAST(least(greatest(round(x - {along} * {num(dots)}), 0e0), {num(width - 1)}) AS BIGINT) AS at_x, abs(y - line * {spacing} + 0.5e0 - {num(middle)}) AS off FROM ({lined}) n"
        lit = f"SELECT p.*, coalesce(s.t, 0e0) AS t FROM ({placed}) p LEFT JOIN ({scan}) s ON s.image_id = p.image_id AND s.line = p.line AND s.x = p.at_x"
        levels = [{"cover": c.clamp(f"{num(middle)} * (0.2e0 + 0.5e0 * sqrt(t)) - sqrt(off * off + across * across) + 0.5e0")}]
        levels += [{f"{k}9": f"{num(lo / 255)} + (({num(lo / 255)} + {num((hi - lo) / 255)} * t) * 1.35e0 - {num(lo / 255)}) * cover" for k, lo, hi in zip(RGB, dark, light, strict=True)}]
        return steps(f"({lit}) z", levels, "image_id, y, x, " + ", ".join(f"CAST(round(round({c.clamp(f'{k}9')} * a, 6)) AS INT) AS {k}" for k in RGB) + ", a")

    return text


def colour_noise(amount: float, detail: float = 50, smoothness: float = 50, width: int = 4, height: int = 4) -> Text:
    """Saturation moves towards its mean over a square, less so where it differs much from it."""
    r = effects_radius(1 + smoothness / 40)

    def text(d: Dialect) -> str:
        base = steps(f"({_PIXELS}) z", A._hsl(), "image_id, y, x, r, g, b, a, h, l, CASE WHEN a > 0 THEN s ELSE 0e0 END AS sat")
        local = f"({num(amount / 100)} * (1e0 - {num(detail / 100)} * least(1e0, abs(sat - mean) * 4e0)))"
        return steps(f"({N.box(base, 'sat', 'mean', r, width, height)}) z", [{"s": f"sat * (1e0 - {local}) + mean * {local}"}, *A._from_hsl("h", "s", "l")], _bytes(("r9", "g9", "b9")))

    return text


def _sharpen_mask(edge: str, detail: float, masking: float) -> str:
    threshold = masking / 100 * 0.35
    return c.clamp(f"({edge} * {num(0.5 + detail / 100)} - {num(threshold)}) / {num(max(0.04, 0.35 - threshold * 0.5))}")


def sharpened(amount: float, radius: float = 40, detail: float = 25, masking: float = 10, width: int = 4, height: int = 4) -> Text:
    """Luma against its mean over a square, added where edges are strong; colours keep their hue."""
    r = effects_radius(detail_radius(radius))

    def text(d: Dialect) -> str:
        both = _edge(N.box(_LUMA, "lum", "mean", r, width, height), "lum", "edge", r)
        target = f"lum + (lum - mean) * {num(amount / 100)} * {_sharpen_mask('edge', detail, masking)} * {num(0.5 + detail / 100)}"
        return steps(f"({both}) z", A._to_luminance(target, ("r1", "g1", "b1"), ("r9", "g9", "b9")), _bytes(("r9", "g9", "b9")))

    return text


def sharpen_overlay(radius: float = 40, detail: float = 25, masking: float = 10) -> Text:
    """The mask of ``sharpened``, shown in grey."""
    r = effects_radius(detail_radius(radius))
    grey = f"CASE WHEN a > 0 THEN CAST(round(round({_sharpen_mask('edge', detail, masking)} * a, 6)) AS INT) ELSE {{k}} END"
    return lambda d: "SELECT image_id, y, x, " + ", ".join(f"{grey.replace('{k}', k)} AS {k}" for k in RGB) + f", a FROM ({_edge(_LUMA, 'lum', 'edge', r)}) z"


def glow_added(glow: float, sigma: float = 1.0) -> Text:
    """A blurred copy's light, added under the pixel's own coverage."""

    def text(d: Dialect) -> str:
        blurred = "SELECT image_id, y, x, r, g, b, a, r * 1e0 AS fr, g * 1e0 AS fg, b * 1e0 AS fb FROM {px} p"
        for k in RGB:
            blurred = N.gauss(blurred, f"f{k}", f"l{k}", sigma)
        return "SELECT image_id, y, x, " + ", ".join(f"CAST(round(round(least(a * 1e0, {k} + round(round(l{k}, 6)) * {num(glow / 100 * 2.5)} * a / 255e0), 6)) AS INT) AS {k}" for k in RGB) + f", a FROM ({blurred}) z"

    return text


def effects_in_order(colors: dict[str, tuple[int, int, int]] | None = None, opacity: float = 0.5, width: int = 4, height: int = 4) -> Text:
    """A layer with all its effects: shadow, outer glow, outside stroke, pixels, overlay, inner glow, inner shadow, inside stroke, each over what is below."""
    colors = colors or {"shadow": (0, 0, 0), "outer": (255, 240, 120), "stroke": (20, 60, 200), "overlay": (200, 30, 30), "inner": (255, 255, 255), "hollow": (10, 10, 60), "inside": (0, 200, 90)}

    def text(d: Dialect) -> str:
        shape = "(SELECT image_id, y, x, a AS v FROM {px} shape)"
        parts = {
            "shadow": N.shape_effect("drop_shadow", 2, 1, 1)(d), "outer": N.shape_effect("outer_glow", 2)(d), "stroke": f"SELECT image_id, y, x, v / 255e0 AS coverage FROM ({N.stroke_ring(1, False, width, height)(d)}) s",
            "overlay": "SELECT image_id, y, x, v / 255e0 AS coverage FROM {px} o", "inner": N.shape_effect("inner_glow", 2)(d), "hollow": N.shape_effect("inner_shadow", 2, 1, 0)(d),
            "inside": f"SELECT image_id, y, x, v / 255e0 AS coverage FROM ({N.stroke_ring(1, True, width, height)(d)}) s",
        }
        joined = "SELECT p.image_id, p.y, p.x, p.r, p.g, p.b, p.a, " + ", ".join(f"e_{n}.coverage * {num(opacity)} AS c_{n}" for n in parts) + " FROM {px} p"
        for n, e in parts.items():
            joined += f" JOIN ({e.replace('{px}', shape)}) e_{n} ON e_{n}.image_id = p.image_id AND e_{n}.y = p.y AND e_{n}.x = p.x"
        levels, at = [{"r_0": "0e0", "g_0": "0e0", "b_0": "0e0", "a_0": "0e0"}], 0
        for n in ("shadow", "outer", "stroke", None, "overlay", "inner", "hollow", "inside"):
            one = {k: (f"{k} / 255e0" if n is None else f"{num(v / 255)} * c_{n}") + f" + {k}_{at} * (1e0 - {'a / 255e0' if n is None else f'c_{n}'})" for k, v in zip("rgba", (*(colors[n] if n else (0, 0, 0)), 255), strict=True)}
            at += 1
            levels.append({f"{k}_{at}": e for k, e in one.items()})
        return steps(f"({joined}) z", levels, "image_id, y, x, " + ", ".join(f"round({k}_{at}, 6) AS {k}" for k in "rgba"))

    return text


def cleared(middle: tuple[float, float] = (1.5, 1.5), reach: float = 2) -> Text:
    """Pixels without what a soft selection covers (destination-out)."""
    kept = "(1e0 - " + c.clamp(f"{num(reach)} - sqrt((x - {num(middle[0])}) * (x - {num(middle[0])}) + (y - {num(middle[1])}) * (y - {num(middle[1])}))") + ")"
    return lambda d: "SELECT image_id, y, x, " + ", ".join(f"CAST(round(round({k} * {kept}, 6)) AS INT) AS {k}" for k in "rgba") + " FROM {px} p"


def copied_merged(middle: tuple[float, float] = (4, 4), radii: tuple[float, float] = (3, 2.5)) -> Text:
    """All visible layers as one, through an elliptic selection, cut to the selection's bounds; places are counted from there."""
    (cx, cy), (rx, ry) = middle, radii
    x0, y0 = int(cx - rx), int(cy - ry)
    inside = f"(pow((x + 0.5e0 - {num(cx)}) / {num(rx)}, 2) + pow((y + 0.5e0 - {num(cy)}) / {num(ry)}, 2) <= 1)"
    return lambda d: f"SELECT document_id, y - {y0} AS y, x - {x0} AS x, CASE WHEN {inside} THEN v ELSE 0e0 END AS v, CASE WHEN {inside} THEN a ELSE 0e0 END AS a FROM ({flatten()(d)}) f WHERE x >= {x0} AND x < {num(cx + rx)} AND y >= {y0} AND y < {num(cy + ry)}"


def ring_statistics(left: int = 3, top: int = 2, width: int = 3, height: int = 3) -> Text:
    """(image_id, n, mean, detail) of the places around a hole: their mean, and how much they differ from their four neighbours (0.9 of the root mean square)."""

    def text(d: Dialect) -> str:
        row, column = "(PARTITION BY image_id, y ORDER BY x)", "(PARTITION BY image_id, x ORDER BY y)"
        around = [f"{f}(v) OVER {w}" for w in (row, column) for f in ("lag", "lead")]
        near = f"SELECT image_id, y, x, v, {', '.join(f'{e} AS n{i}' for i, e in enumerate(around))} FROM {{px}} p"
        total, n = " + ".join(f"coalesce(n{i}, 0)" for i in range(4)), " + ".join(f"CASE WHEN n{i} IS NULL THEN 0e0 ELSE 1e0 END" for i in range(4))
        hole = f"x BETWEEN {left} AND {left + width - 1} AND y BETWEEN {top} AND {top + height - 1}"
        ring = f"x BETWEEN {left - 1} AND {left + width} AND y BETWEEN {top - 1} AND {top + height} AND NOT ({hole})"
        return f"SELECT image_id, count(*) AS n, round(avg(v), 6) AS mean, round(0.9e0 * sqrt(avg(d * d)), 6) AS detail FROM (SELECT *, v - ({total}) / ({n}) AS d FROM ({near}) q) w WHERE {ring} GROUP BY image_id"

    return text


def mixer_weights() -> Text:
    """How much each hue family shares a pixel's hue; neighbours overlap."""

    def text(d: Dialect) -> str:
        hue = steps(f"({_PIXELS}) z", A._hsl(), "image_id, y, x, h", "WHERE a > 0")
        return "SELECT image_id, y, x, " + ", ".join(f"round(greatest(0e0, 1e0 - least(abs(h - {k}), 360e0 - abs(h - {k})) / 40e0), 6) AS w{k}" for k in FAMILIES) + f" FROM ({hue}) q"

    return text


def hsb_kept() -> Text:
    """Colours of an image in reading order as hue, saturation and brightness: greys keep the hue and black the saturation of what came before, 0 at first."""

    def text(d: Dialect) -> str:
        levels = [{"mx": c.high("r1", "g1", "b1"), "mn": c.low("r1", "g1", "b1")}, {"ch": "mx - mn"}, {"h0": "CASE WHEN ch > 0 THEN " + c.hue_degrees("r1", "g1", "b1", "mx", "ch", 0) + " END", "s0": "CASE WHEN mx > 0 THEN ch / mx END"}]
        known = steps(f"({_PIXELS}) z", levels, "image_id, y, x, h0, s0, mx", "WHERE a > 0")
        last = (lambda e: f"last_value({e}) IGNORE NULLS" if d.spark else f"last_value({e} IGNORE NULLS)")
        w = "(PARTITION BY image_id ORDER BY y, x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return f"SELECT image_id, y, x, round(coalesce({last('h0')} OVER {w}, 0e0), 6) AS hue, round(coalesce({last('s0')} OVER {w}, 0e0), 6) AS saturation, round(mx, 6) AS brightness FROM ({known}) k"

    return text


def sampled_hue(x: int, y: int) -> Text:
    """The hue at a point of a layer, where the colour is not near grey."""

    def text(d: Dialect) -> str:
        levels = [{"mx": c.high("r1", "g1", "b1"), "mn": c.low("r1", "g1", "b1")}, {"ch": "mx - mn"}, {"h0": c.hue_degrees("r1", "g1", "b1", "mx", "ch", 0)}]
        return steps(f"(SELECT * FROM ({_PIXELS}) f WHERE x = {x} AND y = {y} AND a > 0) z", levels, "image_id, round(h0, 6) AS hue", "WHERE ch > 0.02e0 * mx")

    return text
