"""Predicates, selections as regions, and set operations on them. A region is a frame (image_id, y, x); no selection is None, not an empty one."""

from __future__ import annotations

from lamina.functions import color as c
from lamina.plans.sql import Dialect, Text, num, steps

KEYS = "image_id, y, x"
CHANNELS = ("r", "g", "b", "a")


def _reference(seed: tuple[int, int], radius: int) -> str:
    """Each image's rounded mean of the box about ``seed`` (x, y), clipped to the image."""
    sx, sy = seed
    means = ", ".join(f"CAST(floor((sum({k}) + floor(count(*) / 2e0)) / count(*)) AS INT) AS {k}_ref" for k in CHANNELS)
    return f"SELECT image_id AS ref_id, {means} FROM {{px}} p WHERE x BETWEEN {sx - radius} AND {sx + radius} AND y BETWEEN {sy - radius} AND {sy + radius} GROUP BY image_id"


def _near(tolerance: int, px: str = "p", ref: str = "f") -> str:
    return " AND ".join(f"abs({px}.{k} - {ref}.{k}_ref) <= {tolerance}" for k in CHANNELS)


def wand(seed: tuple[int, int], tolerance: int = 32, radius: int = 0) -> Text:
    """All pixels within the tolerance of the seed's colour in every channel."""
    return lambda d: f"SELECT p.image_id, p.y, p.x FROM {{px}} p JOIN ({_reference(seed, radius)}) f ON p.image_id = f.ref_id WHERE {_near(tolerance)}"


def wand_contiguous(seed: tuple[int, int], tolerance: int = 32, width: int = 4, height: int = 4, radius: int = 0) -> Text:
    """Those that a path of matching neighbours joins to the seed.

    Regions of matching pixels are found for a whole image at once in one array value: ``width * height`` rounds at most of growing a set of cell
    numbers would be needed for a path that winds; each round joins matching cells to neighbours in the set, and ends by a fixpoint.
    """
    sx, sy = seed
    cells = width * height

    def text(d: Dialect) -> str:
        match = f"SELECT p.image_id, p.y, p.x FROM {{px}} p JOIN ({_reference(seed, radius)}) f ON p.image_id = f.ref_id WHERE {_near(tolerance)}"
        collected = f"SELECT image_id, {'collect_list' if d.spark else 'list'}(y * {width} + x) AS m FROM ({match}) q GROUP BY image_id"
        if d.spark:
            near = f"exists(s, j -> (abs(i - j) = {width}) OR (abs(i - j) = 1 AND i div {width} = j div {width}))"
            grow = f"aggregate(sequence(1, {cells}), filter(m, i -> i = {sy * width + sx}), (s, k) -> filter(m, i -> array_contains(s, i) OR {near}))"
            return f"SELECT image_id, CAST(i div {width} AS INT) AS y, CAST(i % {width} AS INT) AS x FROM (SELECT image_id, explode({grow}) AS i FROM ({collected}) c) e"
        return (
            f"WITH RECURSIVE m AS ({match}), w AS (SELECT image_id, y, x FROM m WHERE x = {sx} AND y = {sy} UNION SELECT m.image_id, m.y, m.x FROM w JOIN m ON m.image_id = w.image_id AND abs(m.x - w.x) + abs(m.y - w.y) = 1) "
            "SELECT image_id, y, x FROM w"
        )

    return text


def _colours(colours: list[tuple[int, int, int]], fuzz: int) -> str:
    if not colours:
        return "false"
    return "(" + " OR ".join("(" + " AND ".join(f"abs({k}1 - {v}) <= {fuzz}" for k, v in zip("rgb", colour, strict=True)) + ")" for colour in colours) + ")"


def color_range(include: list[tuple[int, int, int]], exclude: list[tuple[int, int, int]] = (), fuzz: int = 40, invert: bool = False) -> Text:
    """Straight colours near any of ``include`` and none of ``exclude``; clear pixels are near nothing."""

    def text(d: Dialect) -> str:
        byte = {f"{k}1": f"CAST({d.div(f'{k} * 255 + ' + d.div('a', '2'), 'nullif(a, 0)')} AS INT)" for k in "rgb"}
        hit = f"(a > 0 AND {_colours(list(include), fuzz)} AND NOT {_colours(list(exclude), fuzz)})"
        return steps("{px}", [byte], KEYS, f"WHERE {'NOT ' if invert else ''}coalesce({hit}, false)")

    return text


def threshold(which: str) -> Text:
    """Dark (under 128) or white pixels of a grey raster."""
    return lambda d: f"SELECT {KEYS} FROM {{px}} p WHERE v {'<' if which == 'dark' else '>='} 128"


def opaque() -> Text:
    return lambda d: f"SELECT {KEYS} FROM {{px}} p WHERE a >= 128"


def inside_rotated(centre: tuple[float, float], size: tuple[float, float], degrees: float) -> Text:
    """Pixels whose middle lies in a rotated rectangle."""
    import math

    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))

    def text(d: Dialect) -> str:
        u, v = f"(x + 0.5e0 - {num(centre[0])})", f"(y + 0.5e0 - {num(centre[1])})"
        return f"SELECT {KEYS} FROM {{px}} p WHERE abs({u} * {num(cos)} + {v} * {num(sin)}) <= {num(size[0] / 2)} AND abs({v} * {num(cos)} - {u} * {num(sin)}) <= {num(size[1] / 2)}"

    return text


def ellipse(centre: tuple[float, float], radii: tuple[float, float]) -> Text:
    return lambda d: f"SELECT {KEYS} FROM {{px}} p WHERE pow((x + 0.5e0 - {num(centre[0])}) / {num(radii[0])}, 2e0) + pow((y + 0.5e0 - {num(centre[1])}) / {num(radii[1])}, 2e0) <= 1e0"


def polygon(points: list[tuple[float, float]]) -> Text:
    """Even-odd: a ray to the right crosses the outline an odd number of times."""

    def text(d: Dialect) -> str:
        edges = list(zip(points, [*points[1:], points[0]], strict=True))
        crosses = [f"CASE WHEN ({num(y0)} > y + 0.5e0) <> ({num(y1)} > y + 0.5e0) AND x + 0.5e0 < {num(x0)} + (y + 0.5e0 - {num(y0)}) * {num((x1 - x0) / (y1 - y0))} THEN 1 ELSE 0 END" for (x0, y0), (x1, y1) in edges if y0 != y1]
        return f"SELECT {KEYS} FROM {{px}} p WHERE ({' + '.join(crosses)}) % 2 = 1"

    return text


def union() -> Text:
    return lambda d: f"SELECT {KEYS} FROM {{one}} a UNION SELECT {KEYS} FROM {{two}} b"


def subtract() -> Text:
    return lambda d: f"SELECT {KEYS} FROM {{one}} a EXCEPT SELECT {KEYS} FROM {{two}} b"


def intersect() -> Text:
    return lambda d: f"SELECT {KEYS} FROM {{one}} a INTERSECT SELECT {KEYS} FROM {{two}} b"


def inverse() -> Text:
    """All pixels of ``px`` that are not in ``one``."""
    return lambda d: f"SELECT p.image_id, p.y, p.x FROM {{px}} p LEFT ANTI JOIN {{one}} a ON a.image_id = p.image_id AND a.y = p.y AND a.x = p.x" if d.spark else f"SELECT p.image_id, p.y, p.x FROM {{px}} p ANTI JOIN {{one}} a ON a.image_id = p.image_id AND a.y = p.y AND a.x = p.x"


def moved(dx: int, dy: int) -> Text:
    return lambda d: f"SELECT image_id, y + {dy} AS y, x + {dx} AS x FROM {{one}} a"


def expanded(radius: float, width: int, height: int) -> Text:
    """All pixels of the canvas within ``radius`` of the region: each sends itself to the disc's offsets."""
    r = int(radius)
    disc = [(dx, dy) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dx * dx + dy * dy <= radius * radius]

    def text(d: Dialect) -> str:
        offsets = d.array([str((dy + r) * (2 * r + 1) + dx + r) for dx, dy in disc])
        spread = f"SELECT image_id, y, x, {d.explode(offsets, 'o')} FROM {{one}} a"
        placed = f"SELECT image_id, CAST(y + {d.div('o', str(2 * r + 1))} - {r} AS INT) AS y, CAST(x + o % {2 * r + 1} - {r} AS INT) AS x FROM ({spread}) s"
        return f"SELECT DISTINCT {KEYS} FROM ({placed}) t WHERE x BETWEEN 0 AND {width - 1} AND y BETWEEN 0 AND {height - 1}"

    return text


def outline() -> Text:
    """Directed unit edges between a region and what is outside it, clockwise: from (x0, y0) to (x1, y1)."""
    sides = ((0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0))

    def text(d: Dialect) -> str:
        anti = "LEFT ANTI JOIN" if d.spark else "ANTI JOIN"
        parts = [f"SELECT image_id, x + {x0} AS x0, y + {y0} AS y0, x + {x1} AS x1, y + {y1} AS y1 FROM (SELECT p.* FROM {{one}} p {anti} {{one}} q ON q.image_id = p.image_id AND q.x = p.x + {dx} AND q.y = p.y + {dy}) e" for dx, dy, x0, y0, x1, y1 in sides]
        return " UNION ALL ".join(parts)

    return text


def blended_by_coverage(changed: Text, region: Text) -> Text:
    """Masked write-back: pixels of the region are changed, the others stay."""

    def text(d: Dialect) -> str:
        return (
            f"SELECT p.image_id, p.y, p.x, " + ", ".join(f"CASE WHEN s.image_id IS NULL THEN p.{k} ELSE n.{k} END AS {k}" for k in CHANNELS) + f" FROM {{px}} p JOIN ({changed(d)}) n ON n.image_id = p.image_id AND n.y = p.y AND n.x = p.x LEFT JOIN ({region(d)}) s ON s.image_id = p.image_id AND s.y = p.y AND s.x = p.x"
        )

    return text


def convexity() -> Text:
    """Of quads (id, x0, y0 .. x3, y3), whether all turns go the same way."""

    def text(d: Dialect) -> str:
        turn = lambda i: f"(x{(i + 1) % 4} - x{i}) * (y{(i + 2) % 4} - y{(i + 1) % 4}) - (y{(i + 1) % 4} - y{i}) * (x{(i + 2) % 4} - x{(i + 1) % 4})"
        turns = [turn(i) for i in range(4)]
        return f"SELECT id, ({' AND '.join(f'{t} > 0' for t in turns)}) OR ({' AND '.join(f'{t} < 0' for t in turns)}) AS is_convex FROM {{quads}} q"

    return text


__all__ = ["c"]
