"""The compositor as one recursive query for DuckDB: stacks are composed one by one, then drawn one after the other; ``scene`` is held against it."""

from __future__ import annotations

from lamina.operators.compose import SEPARABLE, blended
from lamina.plans.sql import DUCK, Dialect, Text, steps

_RGB = ("r", "g", "b")


def _channels(text: str, sep: str = ", ") -> str:
    """``text`` for each colour, for which ``@`` stands."""
    return sep.join(text.replace("@", c) for c in _RGB)


def _mix() -> list[dict[str, str]]:
    """Columns or_, og_, ob_: the colour of mode m for the backdrop b and the source s, straight."""
    separable = lambda c: "CASE m " + " ".join(f"WHEN '{mode}' THEN {blended(mode, f'b{c}', f's{c}')}" for mode in SEPARABLE) + " END"
    lum = lambda k: f"(0.3e0 * {k}r + 0.59e0 * {k}g + 0.11e0 * {k}b)"
    out = [{"bn": "least(br, bg, bb)", "bx": "greatest(br, bg, bb)", "sn": "least(sr, sg, sb)", "sx": "greatest(sr, sg, sb)", "lt": f"CASE WHEN m = 'Luminosity' THEN {lum('s')} ELSE {lum('b')} END"}]
    out += [{f"k{c}": f"CASE m WHEN 'Hue' THEN coalesce((s{c} - sn) * (bx - bn) / nullif(sx - sn, 0), 0e0) WHEN 'Saturation' THEN coalesce((b{c} - bn) * (sx - sn) / nullif(bx - bn, 0), 0e0) WHEN 'Color' THEN s{c} ELSE b{c} END" for c in _RGB}]
    out += [{"dl": f"lt - {lum('k')}"}, {f"l{c}": f"k{c} + dl" for c in _RGB}, {"ln": "least(lr, lg, lb)", "lx": "greatest(lr, lg, lb)"}]
    out += [{f"v{c}": f"CASE WHEN ln < 0 THEN lt + (l{c} - lt) * lt / (lt - ln) ELSE l{c} END" for c in _RGB}]
    out += [{f"t{c}": f"CASE WHEN lx > 1 THEN lt + (v{c} - lt) * (1e0 - lt) / (lx - lt) ELSE v{c} END" for c in _RGB}]
    out += [{f"o{c}_": f"CASE WHEN m IN ('Hue', 'Saturation', 'Color', 'Luminosity') THEN greatest(0e0, least(1e0, t{c})) ELSE {separable(c)} END" for c in _RGB}]
    return out


def _adjusted(x: str) -> str:
    linear = f"(CASE WHEN {x} <= 0.04045e0 THEN {x} / 12.92e0 ELSE pow(({x} + 0.055e0) / 1.055e0, 2.4e0) END)"
    light = f"pow(greatest(0e0, {linear} * pow(2e0, params[1]) + params[2]), 1e0 / params[3])"
    encoded = f"greatest(0e0, least(1e0, CASE WHEN {light} <= 0.0031308e0 THEN {light} * 12.92e0 ELSE 1.055e0 * pow({light}, 1e0 / 2.4e0) - 0.055e0 END))"
    spread = f"pow(greatest(0e0, least(1e0, ({x} * 255e0 - params[1]) / greatest(1e-9, params[2] - params[1]))), 1e0 / params[3])"
    return f"CASE adjustment WHEN 'Levels' THEN greatest(0e0, least(1e0, (params[4] + (params[5] - params[4]) * {spread}) / 255e0)) WHEN 'Exposure' THEN {encoded} ELSE 1e0 - {x} END"


#: Layers in order, what clips them, and their samples: (document_id, y, x, layer_id, r, g, b, a) premultiplied under their own mask.
_SCENE = f"""
l AS (SELECT * FROM {{layers}} q), c AS (SELECT * FROM {{canvases}} q),
w AS (
  SELECT layer_id, opacity AS total, visible AS shown, [CAST(place AS BIGINT), layer_id] AS path, CASE WHEN is_group AND has_mask THEN [layer_id] ELSE CAST([] AS BIGINT[]) END AS folders FROM l WHERE parent_id IS NULL
  UNION ALL
  SELECT l.layer_id, w.total * l.opacity, w.shown AND l.visible, list_concat(w.path, [CAST(l.place AS BIGINT), l.layer_id]), list_concat(w.folders, CASE WHEN l.is_group AND l.has_mask THEN [l.layer_id] ELSE CAST([] AS BIGINT[]) END)
  FROM w JOIN l ON l.parent_id = w.layer_id
),
d AS (SELECT l.*, w.total, w.folders, row_number() OVER (PARTITION BY document_id ORDER BY path) AS z FROM l JOIN w ON w.layer_id = l.layer_id WHERE shown AND NOT is_group),
-- a clipped layer is in its base's stack if all between them are
up AS (
  SELECT layer_id, layer_id AS base, document_id, z, parent_id FROM d WHERE mask_source IS NULL AND adjustment IS NULL
  UNION ALL
  SELECT d.layer_id, up.base, d.document_id, d.z, d.parent_id FROM up JOIN d ON d.document_id = up.document_id AND d.z = up.z + 1 AND d.mask_source = up.base AND d.parent_id IS NOT DISTINCT FROM up.parent_id
),
k AS (SELECT layer_id, base FROM up WHERE layer_id <> base),
live AS (
  SELECT layer_id, mask_source AS clip_id FROM l WHERE mask_source IS NOT NULL AND layer_id NOT IN (SELECT layer_id FROM k)
  UNION ALL
  SELECT live.layer_id, l.mask_source FROM live JOIN l ON l.layer_id = live.clip_id WHERE l.mask_source IS NOT NULL AND l.layer_id NOT IN (SELECT layer_id FROM k)
),
clips AS (
  SELECT layer_id, clip_id FROM live WHERE layer_id IN (SELECT layer_id FROM d)
  UNION ALL SELECT layer_id, unnest(folders) FROM d WHERE layer_id NOT IN (SELECT layer_id FROM k)
),
grids AS (
  SELECT p.layer_id, p.y, p.x, p.r / 255e0 AS r, p.g / 255e0 AS g, p.b / 255e0 AS b, p.a / 255e0 AS a, CASE WHEN l.has_mask THEN coalesce(m.v, 0) / 255e0 ELSE 1e0 END AS m
  FROM {{pixels}} p JOIN l ON l.layer_id = p.layer_id AND NOT l.is_group AND l.adjustment IS NULL LEFT JOIN {{masks}} m ON m.layer_id = p.layer_id AND m.y = p.y AND m.x = p.x
  UNION ALL SELECT m.layer_id, m.y, m.x, 1e0, 1e0, 1e0, 1e0, m.v / 255e0 FROM {{masks}} m JOIN l ON l.layer_id = m.layer_id AND l.has_mask AND (l.is_group OR l.adjustment IS NOT NULL)
),
asked AS (
  SELECT l.*, c.width, c.height, unnest(range(c.height)) AS y FROM l JOIN c ON c.document_id = l.document_id
), spots AS (SELECT *, unnest(range(width)) AS x FROM asked),
turned AS (
  SELECT *, round(cos(radians(rotation)) * (x + 0.5e0 - ox - w / 2) + sin(radians(rotation)) * (y + 0.5e0 - oy - h / 2), 9) AS u,
    round(cos(radians(rotation)) * (y + 0.5e0 - oy - h / 2) - sin(radians(rotation)) * (x + 0.5e0 - ox - w / 2), 9) AS v FROM spots
), placed AS (
  SELECT document_id, layer_id, y, x, nearest, grid_w, grid_h, is_group, u, v, w, h,
    round((CASE WHEN flip_x THEN -u ELSE u END / w + 0.5e0) * grid_w, 9) AS gx, round((CASE WHEN flip_y THEN -v ELSE v END / h + 0.5e0) * grid_h, 9) AS gy FROM turned
), within AS (
  SELECT *, CASE WHEN nearest THEN CASE WHEN gx >= 0 AND gx < grid_w AND gy >= 0 AND gy < grid_h THEN 1e0 ELSE 0e0 END
    ELSE greatest(0e0, least(1e0, 0.5e0 + w / 2 - abs(u))) * greatest(0e0, least(1e0, 0.5e0 + h / 2 - abs(v))) END AS inside FROM placed
), near AS (
  SELECT q.*, CASE WHEN nearest THEN floor(gx) ELSE floor(gx - 0.5e0) + i END AS ux, CASE WHEN nearest THEN floor(gy) ELSE floor(gy - 0.5e0) + j END AS uy,
    CASE WHEN nearest THEN CASE WHEN i + j = 0 THEN 1e0 ELSE 0e0 END
    ELSE (CASE WHEN i = 1 THEN gx - 0.5e0 - floor(gx - 0.5e0) ELSE 1 - (gx - 0.5e0 - floor(gx - 0.5e0)) END) * (CASE WHEN j = 1 THEN gy - 0.5e0 - floor(gy - 0.5e0) ELSE 1 - (gy - 0.5e0 - floor(gy - 0.5e0)) END) END AS weight
  FROM within q, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) corner(i, j) WHERE inside > 0
), samples AS (
  SELECT n.document_id, n.layer_id, n.y, n.x, max(inside) AS inside, bool_or(n.is_group) AS is_group, sum(weight * r) AS r, sum(weight * g) AS g, sum(weight * b) AS b, sum(weight * a) AS a, sum(weight * m) AS m
  FROM near n JOIN grids s ON s.layer_id = n.layer_id AND s.x = greatest(0, least(grid_w - 1, ux)) AND s.y = greatest(0, least(grid_h - 1, uy)) WHERE weight > 0
  GROUP BY n.document_id, n.layer_id, n.y, n.x
), own AS (
  SELECT s.document_id, s.layer_id, s.y, s.x, {", ".join(f"s.{c} * s.inside * s.m * CASE WHEN s.is_group THEN 1e0 ELSE w.total END AS {c}" for c in (*_RGB, "a"))} FROM samples s JOIN w ON w.layer_id = s.layer_id
)"""


def flattened() -> Text:
    """(document_id, y, x, r, g, b, a) of each place where anything shows."""

    def text(d: Dialect) -> str:
        straight = ", ".join(f"CASE WHEN o.a > 0 THEN least(1e0, o.{c} / o.a) ELSE 0e0 END AS {c}" for c in _RGB)
        shown = f"""shown AS (
  SELECT o.document_id, o.y, o.x, d.z, CASE WHEN k.base IS NULL THEN d.layer_id ELSE k.base END AS stack, k.base IS NOT NULL AS member, d.blend_mode AS m, {straight},
    o.a * coalesce((SELECT product(coalesce(f.a, 0e0)) FROM clips LEFT JOIN own f ON f.layer_id = clips.clip_id AND f.layer_id NOT IN (SELECT layer_id FROM l WHERE adjustment IS NOT NULL) AND f.document_id = o.document_id AND f.y = o.y AND f.x = o.x WHERE clips.layer_id = d.layer_id), 1e0) AS a,
    d.adjustment, d.params
  FROM own o JOIN d ON d.layer_id = o.layer_id LEFT JOIN k ON k.layer_id = d.layer_id WHERE d.adjustment IS NULL OR k.base IS NOT NULL OR d.mask_source IS NULL
), drawn AS (
  SELECT * FROM shown WHERE a > 0
  UNION ALL
  SELECT p.document_id, p.y, p.x, d.z, coalesce(k.base, d.layer_id), k.base IS NOT NULL, d.blend_mode, 0e0, 0e0, 0e0, d.total, d.adjustment, d.params
  FROM (SELECT DISTINCT document_id, y, x FROM shown WHERE a > 0) p JOIN d ON d.document_id = p.document_id AND d.adjustment IS NOT NULL AND NOT d.has_mask LEFT JOIN k ON k.layer_id = d.layer_id
  WHERE k.base IS NOT NULL OR d.mask_source IS NULL
)"""
        # within each stack, members in order change the base's colours
        members = "members AS (SELECT *, row_number() OVER (PARTITION BY document_id, y, x, stack ORDER BY z) AS i FROM drawn WHERE member)"
        adjusts = lambda x: _adjusted(x)
        base = "SELECT document_id, y, x, z, stack, m AS mode, r, g, b, a AS cover, CAST(0 AS BIGINT) AS i FROM drawn WHERE NOT member AND adjustment IS NULL"
        meet = "(SELECT s.document_id, s.y, s.x, s.z, s.stack, s.mode, s.cover, n.i, n.m, n.a, s.r AS br, s.g AS bg, s.b AS bb, n.adjustment, n.params, n.r AS nr, n.g AS ng, n.b AS nb FROM stacks s JOIN members n ON n.document_id = s.document_id AND n.y = s.y AND n.x = s.x AND n.stack = s.stack AND n.i = s.i + 1)"
        levels = [{f"s{c}": f"CASE WHEN adjustment IS NULL THEN n{c} ELSE {adjusts(f'b{c}')} END" for c in _RGB}, *_mix()]
        step = steps(meet, levels, "document_id, y, x, z, stack, mode, " + _channels("b@ + a * (o@_ - b@)") + ", cover, i")
        stacks = f"stacks AS ({base} UNION ALL {step})"
        items = f"""items AS (
  SELECT *, row_number() OVER (PARTITION BY document_id, y, x ORDER BY z) AS i FROM (
    SELECT document_id, y, x, z, mode AS m, r, g, b, cover AS a, CAST(NULL AS VARCHAR) AS adjustment, CAST(NULL AS DOUBLE[]) AS params FROM stacks QUALIFY row_number() OVER (PARTITION BY document_id, y, x, stack ORDER BY i DESC) = 1
    UNION ALL SELECT document_id, y, x, z, m, r, g, b, a, adjustment, params FROM drawn WHERE NOT member AND adjustment IS NOT NULL) q
)"""
        start = "SELECT DISTINCT document_id, y, x, CAST(0 AS BIGINT) AS i, 0e0 AS r, 0e0 AS g, 0e0 AS b, 0e0 AS a FROM drawn"
        meet = "(SELECT w.document_id, w.y, w.x, n.i, n.m, n.a AS na, n.adjustment, n.params, w.a AS wa, " + _channels("w.@ AS w@, CASE WHEN w.a > 0 THEN least(1e0, w.@ / w.a) ELSE 0e0 END AS b@, n.@ AS n@_") + " FROM composite w JOIN items n ON n.document_id = w.document_id AND n.y = w.y AND n.x = w.x AND n.i = w.i + 1)"
        levels = [{f"s{c}": f"CASE WHEN adjustment IS NULL THEN n{c}_ ELSE {adjusts(f'b{c}')} END" for c in _RGB}, *_mix()]
        out = _channels("CASE WHEN adjustment IS NULL THEN na * ((1e0 - wa) * s@ + wa * o@_) + w@ * (1e0 - na) ELSE w@ + na * (wa * o@_ - w@) END")
        step = steps(meet, levels, f"document_id, y, x, i, {out}, CASE WHEN adjustment IS NULL THEN na + wa * (1e0 - na) ELSE wa END")
        composite = f"composite AS ({start} UNION ALL {step})"
        bytes_ = ", ".join(f"CAST(floor(round({c} * 255e0, 6) + 0.5e0) AS INT) AS {c}" for c in (*_RGB, "a"))
        last = f"SELECT document_id, y, x, {bytes_} FROM composite QUALIFY row_number() OVER (PARTITION BY document_id, y, x ORDER BY i DESC) = 1"
        return f"WITH RECURSIVE {_SCENE}, {shown}, {members}, {stacks}, {items}, {composite} SELECT * FROM ({last}) f WHERE a > 0"

    return text


def merged(selected: str) -> Text:
    """Only the leaves for which ``selected`` holds, with the origin of what they cover."""

    def text(d: Dialect) -> str:
        flat = flattened()(d).replace("SELECT * FROM {layers} q", f"SELECT * FROM {{layers}} q WHERE is_group OR {selected}")
        bounds = f"SELECT *, min(x) OVER (PARTITION BY document_id) AS ox, min(y) OVER (PARTITION BY document_id) AS oy FROM ({flat}) f"
        return f"SELECT document_id, ox, oy, y - oy AS y, x - ox AS x, r, g, b, a FROM ({bounds}) g"

    return text


def copied() -> Text:
    """Each layer's pixels as they lie on the document under a selection."""

    def text(d: Dialect) -> str:
        bytes_ = ", ".join(f"CAST(floor(round(255e0 * s.{c} * s.inside * n.c, 6) + 0.5e0) AS INT) AS {c}" for c in (*_RGB, "a"))
        return f"WITH RECURSIVE {_SCENE} SELECT * FROM (SELECT s.layer_id, s.y, s.x, {bytes_} FROM samples s JOIN l ON l.layer_id = s.layer_id AND NOT l.is_group AND l.adjustment IS NULL JOIN {{selection}} n ON n.document_id = s.document_id AND n.y = s.y AND n.x = s.x) q WHERE a > 0"

    return text


__all__ = ["DUCK", "copied", "flattened", "merged"]
