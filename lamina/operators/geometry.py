"""Coordinate maps and resampling: flips, shifts, affine and lens maps, homographies, chromatic shifts, guides and crops."""

from __future__ import annotations

import math

from lamina.functions import color as c
from lamina.plans.sql import Dialect, Text, num, steps

CHANNELS = ("r", "g", "b", "a")


def flip(horizontal: bool = True, width: int = 4, height: int = 4) -> Text:
    place = (f"y, {width - 1} - x AS x" if horizontal else f"{height - 1} - y AS y, x")
    return lambda d: f"SELECT image_id, {place}, r, g, b, a FROM {{px}} p"


def _bilinear(d: Dialect, sources: str, sx: str = "sx", sy: str = "sy") -> str:
    """Samples at (sx, sy), pixel middles at whole numbers; what lies outside is 0. Each output row meets its four neighbours by an equi-join."""
    corners = " UNION ALL ".join(
        f"SELECT image_id, y, x, CAST(floor({sx}) AS BIGINT) + {i} AS ux, CAST(floor({sy}) AS BIGINT) + {j} AS uy, ({f'{sx} - floor({sx})' if i else f'1e0 - ({sx} - floor({sx}))'}) * ({f'{sy} - floor({sy})' if j else f'1e0 - ({sy} - floor({sy}))'}) AS w FROM ({sources}) s"
        for j in (0, 1)
        for i in (0, 1)
    )
    sums = ", ".join(f"CAST(round(round(sum(coalesce(t.w * q.{k}, 0e0)), 9)) AS INT) AS {k}" for k in CHANNELS)
    return f"SELECT t.image_id, t.y, t.x, {sums} FROM ({corners}) t LEFT JOIN {{px}} q ON q.image_id = t.image_id AND q.x = t.ux AND q.y = t.uy GROUP BY t.image_id, t.y, t.x"


def lens_distortion(k: float, width: int = 4, height: int = 4) -> Text:
    """Radial distortion: places move towards or from the middle by the square of their distance."""
    cx, cy = width / 2, height / 2

    def text(d: Dialect) -> str:
        dx, dy = f"(x + 0.5e0 - {num(cx)})", f"(y + 0.5e0 - {num(cy)})"
        scale = f"(1e0 - {num(k)} * ({dx} * {dx} + {dy} * {dy}) / {num(cx * cx + cy * cy)})"
        return _bilinear(d, f"SELECT image_id, y, x, {num(cx)} + {dx} * {scale} - 0.5e0 AS sx, {num(cy)} + {dy} * {scale} - 0.5e0 AS sy FROM {{px}} p")

    return text


def shifted(dx: float, dy: float) -> Text:
    return lambda d: _bilinear(d, f"SELECT image_id, y, x, x - {num(dx)} AS sx, y - {num(dy)} AS sy FROM {{px}} p")


def affine(matrix: tuple[float, float, float, float, float, float], nearest: bool = True) -> Text:
    """Each output place is looked up through the inverse of (a, b, c, d, tx, ty): x' = a x + c y + tx, y' = b x + d y + ty."""
    a, b, e, f, tx, ty = matrix
    det = a * f - b * e

    def text(d: Dialect) -> str:
        u, v = f"(x + 0.5e0 - {num(tx)})", f"(y + 0.5e0 - {num(ty)})"
        sx, sy = f"({num(f / det)} * {u} - {num(e / det)} * {v}) - 0.5e0", f"({num(a / det)} * {v} - {num(b / det)} * {u}) - 0.5e0"
        if not nearest:
            return _bilinear(d, f"SELECT image_id, y, x, {sx} AS sx, {sy} AS sy FROM {{px}} p")
        inner = f"SELECT image_id, y, x, CAST(floor(round({sx} + 0.5e0, 9)) AS BIGINT) AS ux, CAST(floor(round({sy} + 0.5e0, 9)) AS BIGINT) AS uy FROM {{px}} p"
        return f"SELECT t.image_id, t.y, t.x, q.r, q.g, q.b, q.a FROM ({inner}) t JOIN {{px}} q ON q.image_id = t.image_id AND q.x = t.ux AND q.y = t.uy"

    return text


def placed(centre: tuple[float, float], size: tuple[float, float], degrees: float, flips: tuple[bool, bool], width: int, height: int) -> tuple[float, ...]:
    """The matrix that takes an image's pixels to a document: scaled with flips, turned about the centre."""
    sx, sy = size[0] / width * (-1 if flips[0] else 1), size[1] / height * (-1 if flips[1] else 1)
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    a, b, e, f = cos * sx, sin * sx, -sin * sy, cos * sy
    return a, b, e, f, centre[0] - a * width / 2 - e * height / 2, centre[1] - b * width / 2 - f * height / 2


def homography(corners: list[tuple[float, float]]) -> tuple[float, ...]:
    """(a, b, x0, d, e, y0, g, h): the unit square's corners, clockwise from the top left, go to ``corners``; affine if they are a parallelogram."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = corners
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    g = h = 0.0
    if max(abs(sx), abs(sy)) > 1e-9:
        ux, vx, uy, vy = x1 - x2, x3 - x2, y1 - y2, y3 - y2
        det = ux * vy - vx * uy
        if abs(det) > 1e-12:
            g, h = (sx * vy - vx * sy) / det, (ux * sy - sx * uy) / det
    return x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h


def perspective(corners: list[tuple[float, float]], width: int = 4, height: int = 4) -> Text:
    """A warp to a quad: output places go through the inverse homography and are sampled between pixels."""
    a, b, x0, d_, e, y0, g, h = homography(corners)
    m = ((a, b, x0), (d_, e, y0), (g, h, 1.0))
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    inv = [[minor(j, i) for j in range(3)] for i in range(3)]

    def text(d: Dialect) -> str:
        row = lambda r: f"({num(r[0])} * (x + 0.5e0) + {num(r[1])} * (y + 0.5e0) + {num(r[2])})"
        return _bilinear(d, f"SELECT image_id, y, x, {row(inv[0])} / {row(inv[2])} * {num(width)} - 0.5e0 AS sx, {row(inv[1])} / {row(inv[2])} * {num(height)} - 0.5e0 AS sy FROM {{px}} p")

    return text


def chromatic(strength: float, width: int = 4, height: int = 4) -> Text:
    """Red and blue are read a little further in and out along the row, by the square of the distance from the middle."""
    cx, cy = width / 2, height / 2

    def text(d: Dialect) -> str:
        radial = f"sqrt((x + 0.5e0 - {num(cx)}) * (x + 0.5e0 - {num(cx)}) + (y + 0.5e0 - {num(cy)}) * (y + 0.5e0 - {num(cy)})) / {num(math.hypot(cx, cy))}"
        levels = [{"ra": radial}, {"sh": f"{num(strength)} * ra * ra * 2.5e0"}, {"rx": f"least({width - 1}, greatest(0, CAST(round(x - sh) AS INT)))", "bx": f"least({width - 1}, greatest(0, CAST(round(x + sh) AS INT)))"}]
        inner = steps("{px}", levels, "*")
        r = c.premultiplied("least(1e0, i.nr)", "r")
        joined = f"SELECT i.image_id, i.y, i.x, i.r, i.g, i.b, i.a, p.r / greatest(1e0, p.a) AS nr, q.b / greatest(1e0, q.a) AS nb FROM ({inner}) i JOIN {{px}} p ON p.image_id = i.image_id AND p.y = i.y AND p.x = i.rx JOIN {{px}} q ON q.image_id = i.image_id AND q.y = i.y AND q.x = i.bx"
        return f"SELECT image_id, y, x, {r.replace('i.nr', 'nr')} AS r, {c.premultiplied(c.straight('g'), 'g')} AS g, {c.premultiplied('least(1e0, nb)', 'b')} AS b, a FROM ({joined}) j"

    return text


def clone_stamp(dx: int, dy: int, region: Text) -> Text:
    """Inside a region pixels come from an offset place, where there is one."""

    def text(d: Dialect) -> str:
        pick = ", ".join(f"CASE WHEN s.image_id IS NOT NULL AND q.image_id IS NOT NULL THEN q.{k} ELSE p.{k} END AS {k}" for k in CHANNELS)
        return f"SELECT p.image_id, p.y, p.x, {pick} FROM {{px}} p LEFT JOIN ({region(d)}) s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x LEFT JOIN {{px}} q ON q.image_id = p.image_id AND q.x = p.x + {dx} AND q.y = p.y + {dy}"

    return text


def lifted(dx: int, dy: int, region: Text, keep: bool = False) -> Text:
    """Selected pixels are moved over the others; what they leave is clear, unless a copy is kept."""

    def text(d: Dialect) -> str:
        under = f"SELECT p.image_id, p.y, p.x, " + ", ".join(f"CASE WHEN s.image_id IS NULL OR {'true' if keep else 'false'} THEN p.{k} ELSE 0 END AS {k}" for k in CHANNELS) + f" FROM {{px}} p LEFT JOIN ({region(d)}) s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x"
        over = f"SELECT p.image_id, p.y + {dy} AS y, p.x + {dx} AS x, p.r, p.g, p.b, p.a FROM {{px}} p JOIN ({region(d)}) s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x"
        drawn = ", ".join(f"CAST(round(coalesce(o.{k}, 0) + u.{k} * (255e0 - coalesce(o.a, 0)) / 255e0) AS INT) AS {k}" for k in CHANNELS)
        return f"SELECT u.image_id, u.y, u.x, {drawn} FROM ({under}) u LEFT JOIN ({over}) o ON o.image_id = u.image_id AND o.y = u.y AND o.x = u.x"

    return text


def thumbnail(side: int = 2, width: int = 4) -> Text:
    """Nearest pixels on a smaller grid."""
    step = width / side
    return lambda d: f"SELECT image_id, CAST(floor(y / {num(step)}) AS INT) AS y, CAST(floor(x / {num(step)}) AS INT) AS x, r, g, b, a FROM {{px}} p WHERE x % {int(step)} = {int(step) // 2} AND y % {int(step)} = {int(step) // 2}"


def mip_level() -> Text:
    """Of parts as layers drawn at a scale of 1 / size: the level of halvings, at most 6."""
    return lambda d: "SELECT p_partkey, CAST(least(6e0, greatest(0e0, floor(log2(CAST(p_size AS DOUBLE))))) AS INT) AS level FROM {part} p"


def canvas_offset(anchor: tuple[float, float], grow: tuple[int, int]) -> Text:
    """Layers' origins after a canvas grows about an anchor (0, 0.5 or 1 on each axis); offsets are floored."""
    return lambda d: f"SELECT layer_id, CAST(layer_id % 40 + {math.floor(grow[0] * anchor[0])} AS BIGINT) AS ox, CAST(layer_id % 30 + {math.floor(grow[1] * anchor[1])} AS BIGINT) AS oy FROM {{layers}} l"


def guides(offset: float, scale: float, size: float) -> Text:
    """Guides (axis by z, position by id), scaled, moved and mirrored."""
    return lambda d: f"SELECT layer_id, CASE WHEN z % 2 = 0 THEN 'vertical' ELSE 'horizontal' END AS axis, round(CASE WHEN z % 2 = 0 THEN {num(size)} - (layer_id % 100 * {num(scale)} + {num(offset)}) ELSE layer_id % 100 * {num(scale)} + {num(offset)} END, 6) AS position FROM {{layers}} l"


def grid_lines(length: float, step: float, major: int) -> Text:
    """(i, position, is_major) of a layout grid."""
    return lambda d: f"SELECT CAST(i AS INT) AS i, CAST(round(i * {num(step)}) AS INT) AS position, i % {major} = 0 AS is_major FROM (SELECT {d.explode(d.series('0', str(int(length // step))), 'i')}) g"


def brush_coverage(radius: float = 2.5, flow: float = 0.8) -> Text:
    """(image_id, y, x, coverage): soft dabs along each image's stroke, accumulated as 1 - product(1 - dab).

    A stroke's points are the places of an image's five largest values, in order of value and place.
    """

    def text(d: Dialect) -> str:
        points = "SELECT image_id, x AS cx, y AS cy FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY v DESC, y, x) AS n FROM {grey} q) r WHERE n <= 5"
        dist = f"sqrt((p.x - s.cx) * (p.x - s.cx) * 1e0 + (p.y - s.cy) * (p.y - s.cy)) / {num(radius)}"
        dab = f"{num(flow)} * exp(-2.5e0 * least(1e0, {dist}) * least(1e0, {dist}))"
        return f"SELECT p.image_id, p.y, p.x, round(1e0 - exp(sum(ln(1e0 - {dab}))), 6) AS coverage FROM {{grey}} p JOIN ({points}) s ON s.image_id = p.image_id WHERE abs(p.x - s.cx) <= {num(radius)} AND abs(p.y - s.cy) <= {num(radius)} GROUP BY p.image_id, p.y, p.x"

    return text


def dab_spacing(spacing: float) -> Text:
    """(user_id, k, value): dabs at equal distances along each user's path of values in order of time; the remainder carries over segments."""

    def text(d: Dialect) -> str:
        path = "SELECT user_id, event_id, value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM {heat} h"
        run = "SELECT *, sum(abs(after - value)) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM (" + path.replace("ORDER BY ts, event_id", "ORDER BY event_id") + ") p WHERE after IS NOT NULL"
        span = f"SELECT *, CAST(floor((ended - abs(after - value)) / {num(spacing)} + 1e-9) AS BIGINT) + 1 AS k0, CAST(floor(ended / {num(spacing)} + 1e-9) AS BIGINT) AS k1 FROM ({run}) r"
        each = f"SELECT *, {d.explode(d.series('k0', 'k1'), 'k')} FROM ({span}) s WHERE k1 >= k0"
        return f"SELECT user_id, CAST(k AS BIGINT) AS k, round(value + (after - value) * ((k * {num(spacing)} - (ended - abs(after - value))) / nullif(abs(after - value), 0)), 5) AS value FROM ({each}) e"

    return text


def chaikin() -> Text:
    """One round of corner cutting on each image's ring of its four corner values: (image_id, n, v)."""

    def text(d: Dialect) -> str:
        ring = "SELECT image_id, CASE WHEN x = 0 AND y = 0 THEN 0 WHEN x = 7 AND y = 0 THEN 1 WHEN x = 7 AND y = 7 THEN 2 ELSE 3 END AS n, v FROM {grey} g WHERE x IN (0, 7) AND y IN (0, 7)"
        nxt = f"SELECT *, coalesce(lead(v) OVER (PARTITION BY image_id ORDER BY n), first_value(v) OVER (PARTITION BY image_id ORDER BY n)) AS w FROM ({ring}) r"
        return f"SELECT image_id, 2 * n AS n, round(0.75e0 * v + 0.25e0 * w, 4) AS v FROM ({nxt}) a UNION ALL SELECT image_id, 2 * n + 1, round(0.25e0 * v + 0.75e0 * w, 4) FROM ({nxt}) b"

    return text


def catmull_rom(t: float = 0.5) -> Text:
    """(user_id, event_id, value): the centripetal curve through four successive values, at a share ``t`` between the middle two."""

    def text(d: Dialect) -> str:
        w = "(PARTITION BY user_id ORDER BY event_id)"
        four = f"SELECT user_id, event_id, lag(value) OVER {w} AS p0, value AS p1, lead(value) OVER {w} AS p2, lead(value, 2) OVER {w} AS p3 FROM {{heat}} h"
        knots = [{"k1": "sqrt(abs(p1 - p0))"}, {"k2": "k1 + sqrt(abs(p2 - p1))"}, {"k3": "k2 + sqrt(abs(p3 - p2))"}, {"u": f"k1 + {num(t)} * (k2 - k1)"}]
        mix = lambda a, b, s, e: f"(({e} - u) * {a} + (u - {s}) * {b}) / nullif({e} - {s}, 0)"
        curve = [{"a1": mix("p0", "p1", "0e0", "k1"), "a2": mix("p1", "p2", "k1", "k2"), "a3": mix("p2", "p3", "k2", "k3")}, {"b1": mix("a1", "a2", "0e0", "k2"), "b2": mix("a2", "a3", "k1", "k3")}, {"cv": mix("b1", "b2", "k1", "k2")}]
        return steps(f"({four})", [*knots, *curve], "user_id, event_id, round(cv, 5) AS value", "WHERE cv IS NOT NULL")

    return text
