"""Compositing: blend modes and the ordered fold of layers over each other, masks, clipping stacks and adjustment layers.

Pixels of layers (document_id, z, y, x, s, sa, opacity, blend_mode) are gathered per place in order of z and folded by one expression, in which each
element is drawn over what is below. One shuffle by document and place brings them together.
"""

from __future__ import annotations

from lamina.functions import color as c
from lamina.plans.sql import Dialect, Text, num

#: The separable modes as functions of the backdrop b and the source s, both straight.
SEPARABLE = {
    "Normal": "s",
    "Darken": "least(b, s)",
    "Multiply": "b * s",
    "Color Burn": "CASE WHEN b >= 1 THEN 1e0 WHEN s <= 0 THEN 0e0 ELSE 1e0 - least(1e0, (1e0 - b) / nullif(s, 0)) END",
    "Linear Burn": "greatest(0e0, b + s - 1e0)",
    "Lighten": "greatest(b, s)",
    "Screen": "b + s - b * s",
    "Color Dodge": "CASE WHEN b <= 0 THEN 0e0 WHEN s >= 1 THEN 1e0 ELSE least(1e0, b / nullif(1e0 - s, 0)) END",
    "Linear Dodge (Add)": "least(1e0, b + s)",
    "Overlay": "CASE WHEN b <= 0.5e0 THEN 2e0 * b * s ELSE 1e0 - 2e0 * (1e0 - b) * (1e0 - s) END",
    "Soft Light": "CASE WHEN s <= 0.5e0 THEN b - (1e0 - 2e0 * s) * b * (1e0 - b) WHEN b <= 0.25e0 THEN b + (2e0 * s - 1e0) * (((16e0 * b - 12e0) * b + 4e0) * b - b) ELSE b + (2e0 * s - 1e0) * (sqrt(b) - b) END",
    "Hard Light": "CASE WHEN s <= 0.5e0 THEN 2e0 * b * s ELSE 1e0 - 2e0 * (1e0 - b) * (1e0 - s) END",
    "Vivid Light": "CASE WHEN s <= 0 THEN CASE WHEN b >= 1 THEN 1e0 ELSE 0e0 END WHEN s >= 1 THEN CASE WHEN b <= 0 THEN 0e0 ELSE 1e0 END WHEN s <= 0.5e0 THEN 1e0 - least(1e0, (1e0 - b) / nullif(2e0 * s, 0)) ELSE least(1e0, b / nullif(2e0 - 2e0 * s, 0)) END",
    "Linear Light": "least(1e0, greatest(0e0, b + 2e0 * s - 1e0))",
    "Pin Light": "CASE WHEN s <= 0.5e0 THEN least(b, 2e0 * s) ELSE greatest(b, 2e0 * s - 1e0) END",
    "Hard Mix": "CASE WHEN b + s >= 1 THEN 1e0 ELSE 0e0 END",
    "Difference": "abs(b - s)",
    "Exclusion": "b + s - 2e0 * b * s",
    "Subtract": "greatest(0e0, b - s)",
    "Divide": "CASE WHEN s <= 0 THEN CASE WHEN b <= 0 THEN 0e0 ELSE 1e0 END ELSE least(1e0, b / nullif(s, 0)) END",
}
#: The component modes: which of source and backdrop gives hue, saturation and luminosity.
COMPONENT = ("Hue", "Saturation", "Color", "Luminosity")


def blended(mode: str, b: str, s: str) -> str:
    """The mode's colour for backdrop and source expressions."""
    import re

    return re.sub(r"\b([bs])\b", lambda m: f"({b})" if m[1] == "b" else f"({s})", SEPARABLE[mode])


def blend_table(steps_: int = 5) -> Text:
    """(mode, b, s, result) of all separable modes on a grid of backdrops and sources."""

    def text(d: Dialect) -> str:
        grid = f"SELECT i / {num(steps_)} AS b, j / {num(steps_)} AS s FROM (SELECT *, {d.explode(d.series('0', str(steps_)), 'j')} FROM (SELECT {d.explode(d.series('0', str(steps_)), 'i')}) one) two"
        return " UNION ALL ".join(f"SELECT '{mode}' AS mode, round(b, 6) AS b, round(s, 6) AS s, round(CAST({e} AS DOUBLE), 6) AS result FROM ({grid}) g" for mode, e in SEPARABLE.items())

    return text


def _lum(*rgb: str) -> str:
    return f"(0.3e0 * ({rgb[0]}) + 0.59e0 * ({rgb[1]}) + 0.11e0 * ({rgb[2]}))"


def component_blend(mode: str) -> Text:
    """Hue, Saturation, Color or Luminosity of source pixels over backdrop pixels with equal keys, as straight bytes.

    Saturation is stretched to the other colour's spread, then luminosity is set and colours are pulled back into range.
    """

    def text(d: Dialect) -> str:
        from lamina.plans.sql import steps

        joined = "(SELECT p.image_id, p.y, p.x, " + ", ".join(f"{c.straight(f'p.{k}', 'p.a')} AS b{k}, {c.straight(f'q.{k}', 'q.a')} AS s{k}" for k in "rgb") + " FROM {px} p JOIN {over} q ON q.image_id = p.image_id + 1 AND q.y = p.y AND q.x = p.x WHERE p.a > 0 AND q.a > 0)"
        colour, other = {"Hue": ("s", "b"), "Saturation": ("b", "s"), "Color": ("s", "s"), "Luminosity": ("b", "b")}[mode]
        light = "s" if mode == "Luminosity" else "b"
        spread = lambda k: (f"greatest({k}r, {k}g, {k}b)", f"least({k}r, {k}g, {k}b)")
        (cm, cn), (om, on) = spread(colour), spread(other)
        out = [{"cm": cm, "cn": cn, "om": om, "on_": on, "lt": _lum(*(f"{light}{k}" for k in "rgb"))}]
        out += [{f"k{k}": f"CASE WHEN cm > cn THEN ({colour}{k} - cn) * (om - on_) / nullif(cm - cn, 0) ELSE 0e0 END" if colour != other else f"{colour}{k}" for k in "rgb"}]
        out += [{"dl": f"lt - {_lum('kr', 'kg', 'kb')}"}, {f"l{k}": f"k{k} + dl" for k in "rgb"}, {"ll": _lum("lr", "lg", "lb"), "mx": "greatest(lr, lg, lb)", "mn": "least(lr, lg, lb)"}]
        out += [{f"m{k}": f"CASE WHEN mn < 0 THEN ll + (l{k} - ll) * ll / nullif(ll - mn, 0) ELSE l{k} END" for k in "rgb"}]
        out += [{f"n{k}": f"CASE WHEN mx > 1 THEN ll + (m{k} - ll) * (1e0 - ll) / nullif(mx - ll, 0) ELSE m{k} END" for k in "rgb"}]
        return steps(joined, out, "image_id, y, x, " + ", ".join(f"round({c.clamp(f'n{k}')} + 3e-9, 5) AS {k}" for k in "rgb"))

    return text


def _mode_case(mode: str, b: str, s: str) -> str:
    return "CASE " + mode + " " + " ".join(f"WHEN '{m}' THEN {blended(m, b, s)}" for m in SEPARABLE) + " END"


def layer_pixels(masked: bool = False) -> Text:
    """Grey layers of documents as premultiplied source s and alpha sa; a mask, where asked for, is the layer's mirror image."""

    def text(d: Dialect) -> str:
        alpha = "least(1e0, (p.x + 1) / 4e0) * l.opacity" + (" * (m.v / 255e0)" if masked else "")
        mask = " JOIN {px} m ON m.image_id = p.image_id AND m.y = p.y AND m.x = 7 - p.x" if masked else ""
        return f"SELECT l.document_id, l.layer_id, l.z, p.y, p.x, p.v / 255e0 AS sc, {alpha} AS sa, l.blend_mode FROM {{layers}} l JOIN {{px}} p ON p.image_id = l.layer_id{mask} WHERE l.is_visible"

    return text


def _over(b: str, ba: str, s: str, sa: str, mode: str) -> tuple[str, str]:
    """Premultiplied colour and alpha of a straight source over a premultiplied backdrop."""
    straight = f"CASE WHEN {ba} > 0 THEN least(1e0, {b} / nullif({ba}, 0)) ELSE 0e0 END"
    mixed = _mode_case(mode, straight, s)
    return f"{sa} * ((1e0 - {ba}) * {s} + {ba} * ({mixed})) + {b} * (1e0 - {sa})", f"{sa} + {ba} * (1e0 - {sa})"


def flatten(masked: bool = False, pixels: Text | None = None, digits: int = 6) -> Text:
    """(document_id, y, x, v, a): all visible layers from the bottom up."""

    def text(d: Dialect) -> str:
        source = (pixels or layer_pixels(masked))(d)
        if d.spark:
            v, a = _over("acc.v", "acc.a", "e.sc", "e.sa", "e.blend_mode")
            fold = f"aggregate(array_sort(collect_list(struct(z, sc, sa, blend_mode))), named_struct('v', 0e0, 'a', 0e0), (acc, e) -> named_struct('v', {v}, 'a', {a}))"
            return f"SELECT document_id, y, x, round(f.v + 3e-9, {digits}) AS v, round(f.a + 3e-9, {digits}) AS a FROM (SELECT document_id, y, x, {fold} AS f FROM ({source}) s GROUP BY document_id, y, x) g"
        v, a = _over("w.v", "w.a", "n.sc", "n.sa", "n.blend_mode")
        ranked = f"SELECT *, row_number() OVER (PARTITION BY document_id, y, x ORDER BY z, sc, sa) AS k FROM ({source}) s"
        walk = f"n AS ({ranked}), w AS (SELECT document_id, y, x, CAST(0 AS BIGINT) AS k, 0e0 AS v, 0e0 AS a FROM (SELECT DISTINCT document_id, y, x FROM n) o UNION ALL SELECT n.document_id, n.y, n.x, n.k, {v}, {a} FROM w JOIN n ON n.document_id = w.document_id AND n.y = w.y AND n.x = w.x AND n.k = w.k + 1)"
        return f"WITH RECURSIVE {walk} SELECT document_id, y, x, round(v + 3e-9, {digits}) AS v, round(a + 3e-9, {digits}) AS a FROM (SELECT *, max(k) OVER (PARTITION BY document_id, y, x) AS top FROM w) t WHERE k = top"

    return text


def over_fold() -> Text:
    """Source-over within each order: lines by number, with discount as alpha and quantity as colour; ties are ordered by all values."""

    def text(d: Dialect) -> str:
        pixels = lambda _: "SELECT l_orderkey AS document_id, 0 AS y, 0 AS x, l_linenumber AS z, l_quantity / 50e0 AS sc, l_discount * 10e0 AS sa, 'Normal' AS blend_mode FROM {lineitem} l"
        return f"SELECT document_id AS l_orderkey, v, a FROM ({flatten(False, pixels, 5)(d)}) f"

    return text


def point_query(document: int, y: int, x: int) -> Text:
    """One place of the composite: the filter goes below the fold."""
    return lambda d: f"SELECT * FROM ({flatten(False, lambda dd: f'SELECT * FROM ({layer_pixels()(dd)}) s WHERE document_id = {document} AND y = {y} AND x = {x}')(d)}) f"


def merged_down(upto: int) -> Text:
    """Only the layers up to ``upto``, as one, with the bounds of what they cover."""
    return lambda d: f"SELECT document_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, round(sum(a), 4) AS covered FROM ({flatten(False, lambda dd: f'SELECT * FROM ({layer_pixels()(dd)}) s WHERE z <= {upto}', 12)(d)}) f WHERE a > 0 GROUP BY document_id"


def clipping_stacks() -> Text:
    """(document_id, base_id, n, covered): runs of layers clipped to the one below; a layer is clipped where its id is not a multiple of 3.

    Members keep the base's coverage: colours are composed on it and its alpha is what shows.
    """

    def text(d: Dialect) -> str:
        starts = "SELECT *, CASE WHEN layer_id % 3 = 0 OR z = 1 THEN 1 ELSE 0 END AS starts FROM {layers} l WHERE is_visible"
        stacks = f"SELECT *, sum(starts) OVER (PARTITION BY document_id ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stack FROM ({starts}) s"
        based = f"SELECT *, first_value(layer_id) OVER (PARTITION BY document_id, stack ORDER BY z) AS base_id, first_value(opacity) OVER (PARTITION BY document_id, stack ORDER BY z) AS base_opacity FROM ({stacks}) t"
        return f"SELECT document_id, base_id, CAST(count(*) AS BIGINT) AS n, round(max(base_opacity), 6) AS coverage, round(sum(CASE WHEN layer_id = base_id THEN 0e0 ELSE opacity END), 6) AS members FROM ({based}) b GROUP BY document_id, stack, base_id"

    return text


def adjusted_fold(gamma: float = 1.4) -> Text:
    """A fold in which layers with an id that is a multiple of 4 are adjustment layers: they map all below by a gamma, at their opacity."""

    def text(d: Dialect) -> str:
        pixels = f"SELECT *, layer_id % 4 = 0 AS adjusts FROM ({layer_pixels()(d)}) q"
        def step(b: str, ba: str, e: str) -> tuple[str, str]:
            v, a = _over(b, ba, f"{e}.sc", f"{e}.sa", f"{e}.blend_mode")
            straight = f"CASE WHEN {ba} > 0 THEN least(1e0, {b} / nullif({ba}, 0)) ELSE 0e0 END"
            mapped = f"{b} + {e}.sa * ({ba} * pow({straight}, {num(1 / gamma)}) - {b})"
            return f"CASE WHEN {e}.adjusts THEN {mapped} ELSE {v} END", f"CASE WHEN {e}.adjusts THEN {ba} ELSE {a} END"

        if d.spark:
            v, a = step("acc.v", "acc.a", "e")
            fold = f"aggregate(array_sort(collect_list(struct(z, sc, sa, blend_mode, adjusts))), named_struct('v', 0e0, 'a', 0e0), (acc, e) -> named_struct('v', {v}, 'a', {a}))"
            return f"SELECT document_id, y, x, round(f.v, 6) AS v, round(f.a, 6) AS a FROM (SELECT document_id, y, x, {fold} AS f FROM ({pixels}) s GROUP BY document_id, y, x) g"
        v, a = step("w.v", "w.a", "n")
        ranked = f"SELECT *, row_number() OVER (PARTITION BY document_id, y, x ORDER BY z) AS k FROM ({pixels}) s"
        return (
            f"WITH RECURSIVE n AS ({ranked}), w AS (SELECT document_id, y, x, CAST(0 AS BIGINT) AS k, 0e0 AS v, 0e0 AS a FROM (SELECT DISTINCT document_id, y, x FROM n) o UNION ALL SELECT n.document_id, n.y, n.x, n.k, {v}, {a} FROM w JOIN n ON n.document_id = w.document_id AND n.y = w.y AND n.x = w.x AND n.k = w.k + 1) "
            "SELECT document_id, y, x, round(v, 6) AS v, round(a, 6) AS a FROM (SELECT *, max(k) OVER (PARTITION BY document_id, y, x) AS top FROM w) t WHERE k = top"
        )

    return text


def matte(color: tuple[int, int, int]) -> Text:
    """Pixels over an opaque colour, as an encoder without alpha wants them."""
    return lambda d: "SELECT image_id, y, x, " + ", ".join(f"CAST(round({k} + {v} * (255e0 - a) / 255e0) AS INT) AS {k}" for k, v in zip("rgb", color, strict=True)) + " FROM {px} p"


def effect_margin() -> Text:
    """How far layer effects reach beyond a layer: by its opacity and id as size, distance and glow."""
    return lambda d: "SELECT layer_id, CAST(ceil(greatest(layer_id % 9 * 1e0, layer_id % 7 + 3e0 * (layer_id % 5), 3e0 * opacity)) + 2 AS INT) AS margin FROM {layers} l"


def shadow_offset() -> Text:
    """Offset of a shadow at an angle (degrees, here the layer's id) and distance."""
    return lambda d: "SELECT layer_id, round(-cos(radians(layer_id * 1e0)) * (layer_id % 20), 6) + 0e0 AS dx, round(sin(radians(layer_id * 1e0)) * (layer_id % 20), 6) + 0e0 AS dy FROM {layers} l"
