"""Sequential and iterative kernels, one image or tile at a time in NumPy, applied in Arrow batches.

These are what column expressions cannot say: each place depends on results at places before it. Frames are grouped by image (or tile) and one
group is one raster of bounded size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "image_id long, y int, x int, v double"


def per_image(px: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], schema: str = SCHEMA) -> DataFrame:
    """``kernel`` on each image of (image_id, y, x, v), as an array of doubles."""

    def group(table: pa.Table) -> pa.Table:
        y, x, v = (table.column(k).to_numpy() for k in ("y", "x", "v"))
        plane = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
        plane[y, x] = v
        out = kernel(plane)
        return pa.table({"image_id": table.column("image_id"), "y": table.column("y"), "x": table.column("x"), "v": pa.array(out[y, x].astype(float))})

    return px.select("image_id", "y", "x", "v").groupBy("image_id").applyInArrow(group, schema)


#: Error diffusion as (right, down, weight) and the divisor.
DIFFUSIONS = {"Floyd-Steinberg": (((1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)), 16), "Atkinson": (((1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (0, 2, 1)), 8)}


def error_diffusion(name: str = "Floyd-Steinberg", levels: int = 2, strength: float = 1.0) -> Callable[[np.ndarray], np.ndarray]:
    """Each place is rounded to a level and its error goes on to places not yet met; every other row runs backwards."""
    taps, divisor = DIFFUSIONS[name]

    def kernel(plane: np.ndarray) -> np.ndarray:
        out = plane / 255.0
        height, width = out.shape
        for y in range(height):
            direction = -1 if y % 2 else 1
            for x in range(width)[::direction]:
                old = out[y, x]
                new = np.floor(min(1.0, max(0.0, old)) * (levels - 1) + 0.5) / (levels - 1)
                out[y, x] = new
                for right, down, weight in taps:
                    tx, ty = x + direction * right, y + down
                    if 0 <= tx < width and ty < height:
                        out[ty, tx] += (old - new) * strength * weight / divisor
        return out * 255.0

    return kernel


def _halved(value: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of two by two places: of the known ones, or, where there are none, of the hole; and where that is."""
    height, width = value.shape
    pad = ((0, height % 2), (0, width % 2))
    cells = lambda x: np.pad(x, pad).reshape((height + 1) // 2, 2, (width + 1) // 2, 2).sum(axis=(1, 3))
    known, hole = cells((~inside).astype(float)), cells(inside.astype(float))
    sums = np.where(known > 0, cells(np.where(inside, 0, value)), cells(np.where(inside, value, 0)))
    return sums / np.maximum(np.where(known > 0, known, hole), 1), known == 0


def relaxed(value: np.ndarray, inside: np.ndarray, sweeps: int = 300, factor: float = 1.8, deepest: int = 16) -> np.ndarray:
    """Successive over-relaxation of the places ``inside``, as if row by row: those of one anti-diagonal do not touch and go at once.

    Frames beyond 32 places a side start from the solution at half their size, and 40 sweeps do.
    """
    out = value.astype(float).copy()
    height, width = out.shape
    if min(height, width) > 32 and deepest:
        small, small_inside = _halved(out, inside)
        coarse = relaxed(small, small_inside, sweeps, factor, deepest - 1)
        y, x = np.nonzero(inside & np.repeat(np.repeat(small_inside, 2, 0), 2, 1)[:height, :width])
        out[y, x], sweeps = coarse[y // 2, x // 2], 40
    wide, n = np.pad(out, 1), np.pad(np.ones((height, width)), 1)
    ys, xs = np.nonzero(inside)
    lines = [(ys[on] + 1, xs[on] + 1) for k in np.unique(ys + xs) for on in [ys + xs == k]]
    near = lambda m, y, x: m[y, x - 1] + m[y, x + 1] + m[y - 1, x] + m[y + 1, x]
    counts = [near(n, y, x) for y, x in lines]
    for _ in range(sweeps):
        for (y, x), count in zip(lines, counts, strict=True):
            wide[y, x] += factor * (near(wide, y, x) / count - wide[y, x])
    return wide[1:-1, 1:-1]


def membrane(hole: Callable[[np.ndarray], np.ndarray], sweeps: int = 300, factor: float = 1.8) -> Callable[[np.ndarray], np.ndarray]:
    """Fills a hole with the smoothest surface that meets its rim, from the mean of what is known."""

    def kernel(plane: np.ndarray) -> np.ndarray:
        inside = hole(plane)
        if not inside.any() or inside.all():
            return plane
        return relaxed(np.where(inside, plane[~inside].mean(), plane), inside, sweeps, factor)

    return kernel


class _Draws:
    """A linear congruential generator of 32 bits."""

    def __init__(self, seed: int):
        self.state = seed

    def below(self, n: int) -> int:
        self.state = (self.state * 1664525 + 1013904223) & 0xFFFFFFFF
        return self.state % n


class _Fill:
    """Content-aware filling of one frame from its rim inwards."""

    TRIES, FARTHEST = 24, 64

    def __init__(self, plane: np.ndarray, hole: np.ndarray, seed: int):
        self.out, self.known, self.draws = plane.astype(float).copy(), ~hole, _Draws(seed)
        height, width = plane.shape
        self.reach = 2 if min(height, width) >= 5 else 0
        size = 2 * self.reach + 1
        whole = np.lib.stride_tricks.sliding_window_view(np.pad(self.known, self.reach), (size, size)).all(axis=(2, 3))
        self.donor, self.donors = whole, [tuple(p) for p in np.argwhere(whole).tolist()]
        self.source: dict[tuple[int, int], tuple[int, int]] = {}

    def beside(self, place: tuple[int, int]) -> list[tuple[int, int]]:
        """Left, right, above and below, within the frame."""
        y, x = place
        return [(b, a) for b, a in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= b < self.out.shape[0] and 0 <= a < self.out.shape[1]]

    def usable(self, place: tuple[int, int]) -> bool:
        return 0 <= place[0] < self.out.shape[0] and 0 <= place[1] < self.out.shape[1] and bool(self.donor[place])

    def cost(self, place: tuple[int, int], donor: tuple[int, int]) -> float:
        """The mean square difference of what is known around a place to what is around the donor, whose neighbourhood lies in the frame."""
        r, (y, x), (v, u) = self.reach, place, donor
        up, left = max(-r, -y), max(-r, -x)
        down, right = min(r, self.out.shape[0] - 1 - y), min(r, self.out.shape[1] - 1 - x)
        here = (slice(y + up, y + down + 1), slice(x + left, x + right + 1))
        there = self.out[v + up : v + down + 1, u + left : u + right + 1]
        seen = self.known[here]
        return float(np.square(self.out[here] - there)[seen].mean()) if seen.any() else float("inf")

    def choose(self, place: tuple[int, int]) -> tuple[int, int]:
        """The best of the neighbours' sources carried along, random donors, and places ever nearer to the best so far; the first of equals."""
        best, least = None, float("inf")
        carried = [(s[0] + place[0] - n[0], s[1] + place[1] - n[1]) for n in self.beside(place) for s in [self.source.get(n, n)]]
        drawn = [self.donors[self.draws.below(len(self.donors))] for _ in range(self.TRIES)]
        for donor in [d for d in carried if self.usable(d)] + drawn:
            if best is None or (cost := self.cost(place, donor)) < least:
                best, least = donor, self.cost(place, donor) if best is None else cost
        best, distance = best or self.donors[0], self.FARTHEST
        while distance:
            across = self.draws.below(2 * distance + 1) - distance
            down = self.draws.below(2 * distance + 1) - distance
            near = (best[0] + down, best[1] + across)
            if self.usable(near) and (cost := self.cost(place, near)) < least:
                best, least = near, cost
            distance //= 2
        return best

    def run(self) -> np.ndarray:
        missing = [tuple(p) for p in np.argwhere(~self.known).tolist()]
        waiting = deque(p for p in missing if any(self.known[n] for n in self.beside(p)))
        met = set(waiting)
        while waiting:
            place = waiting.popleft()
            self.source[place] = self.choose(place)
            self.out[place], self.known[place] = self.out[self.source[place]], True
            fresh = [n for n in self.beside(place) if not self.known[n] and n not in met]
            met.update(fresh)
            waiting.extend(fresh)
        return self.out


def best_patch(hole: Callable[[np.ndarray], np.ndarray], seed: int = 0x6D2B79F5) -> Callable[[np.ndarray], np.ndarray]:
    """Content-aware fill: from the rim inwards, each place of a hole takes the middle of the donor patch that is most like what is known around it.

    Donors are carried along from neighbours, drawn at random, and sought ever nearer to the best one. Draws come from a fixed generator, so results repeat.
    """

    def kernel(plane: np.ndarray) -> np.ndarray:
        inside = hole(plane)
        fill = _Fill(plane, inside, seed)
        return fill.run() if inside.any() and fill.donors else plane

    return kernel


def _box_mean(plane: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of 2 r + 1; what lies outside is as the nearest place inside."""
    for axis in (1, 0):
        wide = np.pad(plane, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        plane = np.lib.stride_tricks.sliding_window_view(wide, 2 * r + 1, axis=axis).mean(axis=-1)
    return plane


def luminance_noise(amount: float, detail: float = 50, contrast: float = 0) -> Callable[[np.ndarray], np.ndarray]:
    """Noise reduction of tone, in reading order: a place moves towards its mean, less so at edges, which are measured on what has been done so far."""
    r = int(min(64.0, max(1.0, 1 + amount / 50)) + 0.5)

    def kernel(plane: np.ndarray) -> np.ndarray:
        luma = plane.astype(float) / 255
        mean = _box_mean(luma, r)
        height, width = luma.shape
        for y in range(height):
            for x in range(width):
                around = luma[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
                edge = np.abs(around - luma[y, x]).sum() / max(1, around.size - 1)
                local = amount / 100 * (1 - detail / 100 * min(1.0, edge * 6))
                old = luma[y, x]
                luma[y, x] = old * (1 - local) + mean[y, x] * local + contrast / 100 * 0.25 * (old - mean[y, x])
        return np.floor(np.clip(luma, 0, 1) * 255 + 0.5)

    return kernel


def smudge(path: list[tuple[float, float]], radius: int, strength: float) -> Callable[[np.ndarray], np.ndarray]:
    """Each dab of a stroke lays down what the brush carries, which is what it left at the dab before: at first, what lies under the stroke's start."""

    def kernel(plane: np.ndarray) -> np.ndarray:
        wide = np.pad(plane.astype(float), radius + 1)
        inside = np.pad(np.ones(plane.shape, bool), radius + 1)
        dy, dx = np.mgrid[-radius : radius + 1, -radius : radius + 1]
        u = np.hypot(dx, dy) / radius
        weight = np.where(u < 1, (1 - np.minimum(u, 1)) ** 2 * (1 + 2 * np.minimum(u, 1)), 0) * strength

        def under(point: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
            x, y = (int(np.floor(v + 0.5)) + radius + 1 for v in point)
            return np.clip(y + dy, 0, wide.shape[0] - 1), np.clip(x + dx, 0, wide.shape[1] - 1)

        carried = wide[under(path[0])]
        for point in path[1:]:
            at = under(point)
            touched = inside[at] & (weight > 0)
            painted = wide[at] + (carried - wide[at]) * weight
            carried = np.where(touched, painted, carried)
            rows, columns = at[0][touched], at[1][touched]
            wide[rows, columns] = np.clip(np.floor(painted[touched] + 0.5), 0, 255)
        return wide[radius + 1 : -radius - 1, radius + 1 : -radius - 1]

    return kernel


def liquify(path: list[tuple[float, float]], radius: float, strength: float) -> Callable[[np.ndarray], np.ndarray]:
    """Offsets add up along a stroke and the original is read once, between pixels, at the end."""

    def kernel(plane: np.ndarray) -> np.ndarray:
        height, width = plane.shape
        yy, xx = np.mgrid[:height, :width].astype(float)
        ox, oy = np.zeros_like(xx), np.zeros_like(yy)
        for (x0, y0), (x1, y1) in zip(path, path[1:], strict=False):
            u = np.minimum(np.hypot(xx - x1, yy - y1) / radius, 1)
            weight = (1 - u) ** 2 * (1 + 2 * u) * strength
            ox += weight * (x1 - x0)
            oy += weight * (y1 - y0)
        sx, sy = np.clip(xx - ox, 0, width - 1), np.clip(yy - oy, 0, height - 1)
        x0, y0 = np.minimum(sx.astype(int), width - 2), np.minimum(sy.astype(int), height - 2)
        fx, fy = sx - x0, sy - y0
        top = plane[y0, x0] * (1 - fx) + plane[y0, x0 + 1] * fx
        return top * (1 - fy) + (plane[y0 + 1, x0] * (1 - fx) + plane[y0 + 1, x0 + 1] * fx) * fy

    return kernel


def trilinear_cube(cube: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """Colours (n, 3) in 0 to 1 through a cube indexed [blue, green, red], blended between the eight nearest entries."""
    top = cube.shape[0] - 1

    def look(colors: np.ndarray) -> np.ndarray:
        at = np.clip(colors, 0, 1) * top
        lo = np.minimum(at.astype(int), top - 1)
        f = at - lo
        out = np.zeros((len(colors), 3))
        for corner in range(8):
            bits = np.array([corner & 1, corner >> 1 & 1, corner >> 2 & 1])
            weight = np.prod(np.where(bits, f, 1 - f), axis=1)
            i = lo + bits
            out += weight[:, None] * cube[i[:, 2], i[:, 1], i[:, 0]]
        return out

    return look


def trace_loops(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Directed unit edges, clockwise about what they enclose, as loops of corners; where two loops meet, the right turn keeps them apart."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x0, y0, x1, y1 in sorted(edges, key=lambda e: (e[1], e[0])):
        out.setdefault((x0, y0), []).append((x1 - x0, y1 - y0))
    loops = []
    for start in sorted(out, key=lambda p: (p[1], p[0])):
        while out[start]:
            at, loop, heading, first = start, [], None, None
            while True:
                choices = out[at]
                if heading is None:
                    step = choices[0]
                else:
                    hx, hy = heading
                    step = next(s for s in ((-hy, hx), (hx, hy), (hy, -hx), (-hx, -hy)) if s in choices)
                choices.remove(step)
                if step != heading:
                    loop.append(at)
                first, heading = first or step, step
                at = (at[0] + step[0], at[1] + step[1])
                if at == start:
                    break
            loops.append(loop[1:] if heading == first and len(loop) > 1 else loop)
    return loops


def simplified(points: list[tuple[float, float]], tolerance: float = 1.6) -> list[tuple[float, float]]:
    """Douglas-Peucker: of a polyline, the points that are needed to stay within the tolerance."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    p = np.array(points, float)
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        length = np.hypot(*d)
        rel = p[a + 1 : b] - p[a]
        off = np.abs(rel[:, 0] * d[1] - rel[:, 1] * d[0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        i = int(off.argmax())
        if off[i] > tolerance:
            keep.add(a + 1 + i)
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return [points[i] for i in sorted(keep)]


def leashed(points: list[tuple[float, float]], radius: float) -> list[tuple[float, float]]:
    """A pointer on a string: it stays until the pointer is further than ``radius``, then follows at that distance."""
    at, out = points[0], [points[0]]
    for x, y in points[1:]:
        dx, dy = x - at[0], y - at[1]
        far = (dx * dx + dy * dy) ** 0.5
        if far > radius:
            at = (at[0] + dx * (far - radius) / far, at[1] + dy * (far - radius) / far)
            out.append(at)
    return out
