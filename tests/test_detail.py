"""Detail and placement operators against plain loops over pixels and rows, which share no text with the queries."""

import math

import numpy as np
import pytest

from lamina.operators import detail, forest, kernels, placement
from lamina.plans import catalogue
from lamina.sources import views

Q = catalogue.queries()


@pytest.fixture(scope="module")
def frames(spark, sf_dir):
    """The first 25 images as (4, 4, 4) arrays of premultiplied bytes."""
    out = {i: np.zeros((4, 4, 4), int) for i in range(25)}
    for r in views.RGBA.frame(spark, sf_dir).filter("image_id < 25").collect():
        out[r.image_id][r.y, r.x] = (r.r, r.g, r.b, r.a)
    return out


def got(spark, sf_dir, name, channels="rgba"):
    out = {i: np.zeros((4, 4, len(channels))) for i in range(25)}
    for r in Q[name](spark, sf_dir).filter("image_id < 25").collect():
        out[r.image_id][r.y, r.x] = [r[c] for c in channels]
    return out


def clamp(v):
    return min(1.0, max(0.0, v))


def half_up(v):
    return math.floor(v + 0.5 + 1e-9)


def straight(p):
    return [min(1.0, c / p[3]) if p[3] else 0.0 for c in p[:3]]


def luma(rgb):
    return 0.2126 * rgb[0] + 0.7152 * rgb[1] + 0.0722 * rgb[2]


def lumas(f):
    return np.array([[luma(straight(p)) for p in row] for row in f])


def box(plane, r):
    h, w = plane.shape
    mean = lambda line, k: sum(line[min(len(line) - 1, max(0, j))] for j in range(k - r, k + r + 1)) / (2 * r + 1)
    rows = np.array([[mean(plane[y], x) for x in range(w)] for y in range(h)])
    return np.array([[mean(rows[:, x], y) for x in range(w)] for y in range(h)])


def edge(plane, y, x, r):
    near = [abs(plane[y + dy, x + dx] - plane[y, x]) for dy in (-r, 0, r) for dx in (-r, 0, r) if (dy or dx) and 0 <= y + dy < plane.shape[0] and 0 <= x + dx < plane.shape[1]]
    return sum(near) / len(near) if near else 0.0


def lifted(rgb, target):
    y, t = luma(rgb), clamp(target)
    if abs(t - y) < 1e-8:
        return rgb
    if y < 1e-8:
        return [t] * 3 if t > y else rgb
    return [clamp(v * t / y) for v in rgb]


def same(a, b, slack=0):
    assert all(np.abs(a[i] - b[i]).max() <= slack for i in b)


@pytest.mark.parametrize(("name", "wobble", "dots", "dark", "light"), [("scanlines", 1.5, 0.4, (10, 20, 30), (230, 255, 240)), ("scanlines_plain", 0, 0, (0, 0, 0), (255, 255, 255))])
def test_scanlines(spark, sf_dir, frames, name, wobble, dots, dark, light):
    want = {}
    for i, f in frames.items():
        out, tone = f.copy(), lumas(f)
        for line in (0, 1):
            wave = math.sin(line * 0.45) * 0.7 + math.sin(line * 1.7 + 1.3) * 0.3
            shift = round(wobble * wave)
            scan = []
            for x in range(4):
                seen = [clamp(tone[y, x - shift]) for y in (2 * line, 2 * line + 1) if 0 <= x - shift < 4 and f[y, x - shift][3]]
                scan.append(sum(seen) / len(seen) if seen else 0.0)
            for y in (2 * line, 2 * line + 1):
                for x in range(4):
                    if not f[y, x][3]:
                        continue
                    along = (x + 0.5) % 2 - 1
                    t = scan[min(3, max(0, half_up(x - along * dots)))]
                    cover = clamp(0.2 + 0.5 * math.sqrt(t) - math.hypot(abs(y - 2 * line + 0.5 - 1), along * dots) + 0.5)
                    for k in range(3):
                        lo, hi = dark[k] / 255, light[k] / 255
                        out[y, x][k] = half_up(clamp(lo + ((lo + (hi - lo) * t) * 1.35 - lo) * cover) * f[y, x][3])
        want[i] = out
    same(got(spark, sf_dir, name), want)


def test_sharpening_and_its_mask(spark, sf_dir, frames):
    r = round(0.5 + 0.4 * 2.5)
    assert detail.effects_radius(detail.detail_radius(40)) == 2 == r + (r == 1)
    r, threshold, sharp, shown = 2, 0.1 * 0.35, {}, {}
    for i, f in frames.items():
        plane = lumas(f)
        mean, a, b = box(plane, r), f.copy(), f.copy()
        for y in range(4):
            for x in range(4):
                if not f[y, x][3]:
                    continue
                mask = clamp((edge(plane, y, x, r) * 0.75 - threshold) / max(0.04, 0.35 - threshold * 0.5))
                b[y, x][:3] = half_up(mask * f[y, x][3])
                target = clamp(plane[y, x] + (plane[y, x] - mean[y, x]) * 1.2 * mask * 0.75)
                a[y, x][:3] = [half_up(v * f[y, x][3]) for v in lifted(straight(f[y, x]), target)]
        sharp[i], shown[i] = a, b
    same(got(spark, sf_dir, "sharpened"), sharp)
    same(got(spark, sf_dir, "sharpen_overlay"), shown)


def test_colour_noise(spark, sf_dir, frames):
    import colorsys

    want, r = {}, detail.effects_radius(1 + 50 / 40)
    for i, f in frames.items():
        hls = np.array([[colorsys.rgb_to_hls(*straight(p)) for p in row] for row in f])
        sat, out = np.where(f[:, :, 3] > 0, hls[:, :, 2], 0.0), f.copy()
        mean = box(sat, r)
        for y in range(4):
            for x in range(4):
                if f[y, x][3]:
                    local = 0.6 * (1 - 0.5 * min(1.0, abs(sat[y, x] - mean[y, x]) * 4))
                    rgb = colorsys.hls_to_rgb(hls[y, x][0], hls[y, x][1], sat[y, x] * (1 - local) + mean[y, x] * local)
                    out[y, x][:3] = [half_up(clamp(v) * f[y, x][3]) for v in rgb]
        want[i] = out
    same(got(spark, sf_dir, "colour_noise"), want, 1)


def test_luminance_noise_reads_its_own_results():
    rng = np.random.default_rng(0)
    plane = rng.integers(0, 256, (9, 7)).astype(float)
    done, mean = plane / 255, box(plane / 255, 2)
    for y in range(9):
        for x in range(7):
            local = 0.6 * (1 - 0.4 * min(1.0, edge(done, y, x, 1) * 6))
            done[y, x] = done[y, x] * (1 - local) + mean[y, x] * local + 0.2 * 0.25 * (done[y, x] - mean[y, x])
    assert (kernels.luminance_noise(60, 40, 20)(plane) == np.floor(np.clip(done, 0, 1) * 255 + 0.5)).all()
    flat = np.full((6, 6), 77.0)
    assert (kernels.luminance_noise(80)(flat) == flat).all()


def test_glow_and_clearing(spark, sf_dir, frames):
    w = np.exp(-np.arange(-3, 4) ** 2 / 2.0)
    w /= w.sum()
    lit, clear = {}, {}
    for i, f in frames.items():
        wide = np.pad(f[:, :, :3].astype(float), [(3, 3), (3, 3), (0, 0)], mode="edge")
        blur = np.array([[sum(w[j] * w[k] * wide[y + j, x + k] for j in range(7) for k in range(7)) for x in range(4)] for y in range(4)])
        a, b = f.copy(), f.copy()
        for y in range(4):
            for x in range(4):
                alpha = f[y, x][3]
                a[y, x][:3] = [half_up(min(alpha, c + half_up(light) * 1.0 * alpha / 255)) for c, light in zip(f[y, x][:3], blur[y, x], strict=True)]
                b[y, x] = [half_up(c * (1 - clamp(2 - math.hypot(x - 1.5, y - 1.5)))) for c in f[y, x]]
        lit[i], clear[i] = a, b
    same(got(spark, sf_dir, "glow_added"), lit, 1)
    same(got(spark, sf_dir, "cleared_selection"), clear)


def test_effects_lie_in_order(spark, sf_dir, frames):
    """Coverage of each effect from its definition, then one fold."""
    w = np.exp(-np.arange(-3, 4) ** 2 / 2.0)
    w /= w.sum()

    def blur(m):
        wide = np.pad(m, 3, mode="edge")
        return np.array([[sum(w[j] * w[k] * wide[y + j, x + k] for j in range(7) for k in range(7)) for x in range(4)] for y in range(4)])

    def moved(m, dx, dy):
        return np.array([[m[y - dy, x - dx] if 0 <= y - dy < 4 and 0 <= x - dx < 4 else 0.0 for x in range(4)] for y in range(4)])

    def around(m, pick, outside):
        wide = np.pad(m, 1, constant_values=outside)
        return np.array([[pick(wide[y : y + 3, x : x + 3]) for x in range(4)] for y in range(4)])

    want = {}
    for i, f in frames.items():
        s = f[:, :, 3] / 255
        layers = [((0, 0, 0), blur(moved(s, 1, 1))), ((255, 240, 120), blur(s) * (1 - s)), ((20, 60, 200), around(s, np.max, 0.0) - s), None, ((200, 30, 30), s), ((255, 255, 255), s * (1 - blur(s))), ((10, 10, 60), s * (1 - blur(moved(s, 1, 0)))), ((0, 200, 90), s - around(s, np.min, 0.0))]
        out = np.zeros((4, 4, 4))
        for layer in layers:
            if layer is None:
                out = f / 255 + out * (1 - s[:, :, None])
            else:
                c = 0.5 * layer[1][:, :, None]
                out = np.array([*[v / 255 for v in layer[0]], 1.0]) * c + out * (1 - c)
        want[i] = out
    same(got(spark, sf_dir, "effects_in_order"), want, 2e-6)


def test_hues_saturations_and_families(spark, sf_dir, frames):
    import colorsys

    kept, weights, at = {}, {}, {}
    for r in Q["hsb_kept"](spark, sf_dir).filter("image_id < 25").collect():
        kept[r.image_id, r.y, r.x] = (r.hue, r.saturation, r.brightness)
    for r in Q["mixer_weights"](spark, sf_dir).filter("image_id < 25").collect():
        weights[r.image_id, r.y, r.x] = [r[f"w{k}"] for k in detail.FAMILIES]
    for r in Q["sampled_hue"](spark, sf_dir).filter("image_id < 25").collect():
        at[r.image_id] = r.hue
    for i, f in frames.items():
        hue = sat = 0.0
        for y in range(4):
            for x in range(4):
                if not f[y, x][3]:
                    assert (i, y, x) not in kept
                    continue
                rgb = straight(f[y, x])
                h, s, v = colorsys.rgb_to_hsv(*rgb)
                hue, sat = h * 360 if max(rgb) > min(rgb) else hue, s if v > 0 else sat
                assert kept[i, y, x] == pytest.approx((hue, sat, v), abs=2e-6)
                degrees = h * 360
                assert weights[i, y, x] == pytest.approx([max(0.0, 1 - min(abs(degrees - k), 360 - abs(degrees - k)) / 40) for k in (0, 30, 60, 120, 180, 240, 270, 300)], abs=2e-6)
                if (x, y) == (1, 2):
                    assert (i in at) == (s > 0.02) and (i not in at or at[i] == pytest.approx(degrees, abs=2e-6))


def test_ring_statistics(spark, sf_dir):
    planes = {i: np.zeros((8, 8)) for i in range(25)}
    for r in views.GREY.frame(spark, sf_dir).filter("image_id < 25").collect():
        planes[r.image_id][r.y, r.x] = r.v
    for r in Q["ring_statistics"](spark, sf_dir).filter("image_id < 25").collect():
        p, ring = planes[r.image_id], [(y, x) for y in range(1, 6) for x in range(2, 7) if not (2 <= y <= 4 and 3 <= x <= 5)]
        off = [p[y, x] - (p[y - 1, x] + p[y + 1, x] + p[y, x - 1] + p[y, x + 1]) / 4 for y, x in ring]
        assert r.n == len(ring) == 16 and r["mean"] == pytest.approx(np.mean([p[a] for a in ring]), abs=1e-5) and r.detail == pytest.approx(0.9 * math.sqrt(np.mean(np.square(off))), abs=1e-5)


def test_undo_and_redo(spark, sf_dir):
    events = sorted(views.HEAT.frame(spark, sf_dir).collect(), key=lambda r: (r.user_id, r.ts, r.event_id))
    stacks: dict = {}
    for e in events:
        past, future = stacks.setdefault(e.user_id, ([], []))
        kind = {1: "undo", 3: "redo"}.get(e.event_id % 5, "edit")
        if kind == "edit":
            past.append(e.event_id)
            future.clear()
        elif kind == "undo" and past:
            future.append(past.pop())
        elif kind == "redo" and future:
            past.append(future.pop())
    assert {r.user_id: (r.past, r.future, r.current) for r in Q["undo_redo"](spark, sf_dir).collect()} == {u: (len(p), len(f), p[-1] if p else 0) for u, (p, f) in stacks.items()}


def test_boxes_steps_and_radii(spark, sf_dir):
    events = {r.event_id: r for r in views.HEAT.frame(spark, sf_dir).collect()}
    away = lambda v: math.copysign(math.floor(abs(v) + 0.5), v)
    for r in Q["drag_box"](spark, sf_dir).collect():
        e = events[r.event_id]
        dx, dy = away(e.x + (e.value - 50) / 3) - e.x, away(e.y - e.value / 7) - e.y
        if r.event_id % 2 == 0:
            side = max(abs(dx), abs(dy))
            dx, dy = (-side if dx < 0 else side), (-side if dy < 0 else side)
        want = (e.x - abs(dx), e.y - abs(dy), 2 * abs(dx), 2 * abs(dy)) if r.event_id % 3 == 0 else (min(e.x, e.x + dx), min(e.y, e.y + dy), abs(dx), abs(dy))
        assert (r.x0, r.y0, r.width, r.height) == want
    for r in Q["random_steps"](spark, sf_dir).collect():
        s, seen = r.event_id * 2654435 % (1 << 32), []
        for _ in range(3):
            s = (s * 1664525 + 1013904223) % (1 << 32)
            seen.append(s)
        assert [r.s1, r.s2, r.s3] == seen
    for r in Q["radii"](spark, sf_dir).collect():
        fine, whole = placement.radius_pair(events[r.event_id].value, events[r.event_id].x)
        assert r.detail == pytest.approx(fine, abs=1e-6) and r.effects == whole


def test_curves_have_both_ends(spark, sf_dir):
    curves: dict = {}
    for r in sorted(Q["curve_points"](spark, sf_dir).collect(), key=lambda r: (r.user_id, r.k)):
        curves.setdefault(r.user_id, []).append((r.k, r.x, r.y))
    points: dict = {}
    for e in views.HEAT.frame(spark, sf_dir).collect():
        points.setdefault(e.user_id, []).append((min(255, math.floor(e.value * 2.6)), e.event_id, e.event_id % 256))
    for user, own in points.items():
        own = [(x, y) for x, _, y in sorted(own)]
        if len(own) < 2:
            assert user not in curves
            continue
        want = [(0, own[0][1])] * (own[0][0] != 0) + own + [(255, own[-1][1])] * (own[-1][0] != 255)
        assert curves[user] == [(k, x, y) for k, (x, y) in enumerate(want, 1)]


def test_following_moves_corners_along(spark, sf_dir):
    """Where no shear arises, the four corners go where the old place's inverse and the new place take them."""

    def unit(x, y, w, h, rot, fx, fy):
        t, sx, sy = math.radians(rot), -w if fx else w, -h if fy else h
        m = np.array([[sx * math.cos(t), -sy * math.sin(t)], [sx * math.sin(t), sy * math.cos(t)]])
        return m, np.array([x + w / 2, y + h / 2]) - m @ [0.5, 0.5]

    rows = Q["following"](spark, sf_dir).collect()
    for r in rows:
        k = r.layer_id
        own = unit(k % 50, k % 31, 10 + k % 13, 8 + k % 7, k % 12 * 30, k % 5 == 0, k % 3 == 0)
        old = unit(20 + k % 9, 5, 30, 24, k % 4 * 15, False, False)
        new = unit(25, 12 + k % 6, 45, 36, k % 4 * 15 + 40, False, k % 2 == 0)
        got_ = unit(r.x, r.y, r.w, r.h, r.rot, k % 5 == 0, r.fy)
        for corner in ([0, 0], [1, 0], [0, 1], [1, 1]):
            p = own[0] @ corner + own[1]
            q = new[0] @ np.linalg.solve(old[0], p - old[1]) + new[1]
            assert got_[0] @ corner + got_[1] == pytest.approx(q, abs=1e-3)


def test_walks_of_deep_and_broken_trees(spark):
    """A path of 300 folders, a cycle, what hangs below it, and a missing parent."""
    rows = [(str(i), str(i - 1) if i else None, True, i, 0.999, i != 150) for i in range(301)] + [("c1", "c2", True, 1, 1.0, True), ("c2", "c1", True, 1, 1.0, True), ("below", "c1", False, 1, 1.0, True), ("lost", "nowhere", False, 1, 1.0, True)]
    tree = spark.createDataFrame(rows, "id string, parent_id string, is_group boolean, place int, opacity double, visible boolean").repartition(5)
    got_ = {r.id: r for r in forest.effective_opacity(tree).collect()}
    assert set(got_) == {str(i) for i in range(301)}
    assert all(r.depth == int(i) and r.visible == (int(i) < 150) and r.opacity == pytest.approx(0.999 ** (int(i) + 1), abs=1e-8) for i, r in got_.items())
    rules = {(r.rule, r.id) for r in forest.violations(tree).collect()}
    assert {("unreachable", x) for x in ("c1", "c2", "below", "lost")} | {("orphan", "lost")} | {("deep", str(i)) for i in range(65, 301)} == rules
    assert [r.id for r in sorted(forest.depth_first(tree).collect(), key=lambda r: r.rank)] == [str(i) for i in range(301)]
    assert {r.id for r in forest.descendants(tree, "298").collect()} == {"299", "300"} and forest.common_folder(tree, ("300", "7")).first().id == "6"


def test_mask_links(spark):
    rows = [(1, i, i, 1.0) for i in range(1, 40)]
    layers = spark.createDataFrame(rows, "document_id int, layer_id int, z int, opacity double")
    got_ = {(r.rule, r.id) for r in placement.mask_link_frames(layers).collect()}
    source = {i: -1 if i % 97 == 5 else i if i % 89 == 3 else i - 2 if i > 2 and i % 4 != 1 else None for i in range(1, 40)}
    want = {("unknown", i) for i, s in source.items() if s is not None and s not in source} | {("source", i) for i, s in source.items() if s in source and (s % 41 == 0 or s % 43 == 0)}

    def ends(i, seen=()):
        return source[i] is None or source[i] not in source or (i not in seen and ends(source[i], (*seen, i)))

    want |= {("endless", i) for i in source if not ends(i)}
    assert got_ == want and ("endless", 3) in got_ and ("unknown", 5) in got_


def test_membranes_by_plain_sweeps():
    """Row by row over single places, and from half the size beyond 32 places a side."""
    rng = np.random.default_rng(0)

    def plain(value, inside, sweeps):
        out = value.astype(float).copy()
        h, w = out.shape
        if h > 32 and w > 32:
            small, hole = np.zeros(((h + 1) // 2, (w + 1) // 2)), np.zeros(((h + 1) // 2, (w + 1) // 2), bool)
            for y in range(small.shape[0]):
                for x in range(small.shape[1]):
                    cell = [(b, a) for b in (2 * y, 2 * y + 1) for a in (2 * x, 2 * x + 1) if b < h and a < w]
                    known = [out[c] for c in cell if not inside[c]]
                    hole[y, x] = not known
                    small[y, x] = np.mean(known or [out[c] for c in cell])
            small = plain(small, hole, sweeps)
            for y in range(h):
                for x in range(w):
                    if inside[y, x] and hole[y // 2, x // 2]:
                        out[y, x] = small[y // 2, x // 2]
            sweeps = 40
        for _ in range(sweeps):
            for y in range(h):
                for x in range(w):
                    if inside[y, x]:
                        near = [out[b, a] for b, a in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= b < h and 0 <= a < w]
                        out[y, x] += 1.8 * (sum(near) / len(near) - out[y, x])
        return out

    for h, w, sweeps in ((7, 9, 20), (35, 38, 12)):
        plane, inside = rng.integers(0, 256, (h, w)).astype(float), np.zeros((h, w), bool)
        inside[2 : h - 2, 3 : w - 1] = True
        inside[0, 0] = True
        start = np.where(inside, 99.0, plane)
        assert np.abs(kernels.relaxed(start, inside, sweeps) - plain(start, inside, sweeps)).max() < 1e-6


def test_smudging_drags_a_spot():
    plane = np.zeros((9, 15))
    plane[4, 3] = 200
    dragged = kernels.smudge([(3, 4), (4, 4), (5, 4), (6, 4)], 3, 1.0)(plane)
    assert dragged[4, 6] == 200 and not dragged[4, 7:].any() and (kernels.smudge([(3, 4), (6, 4)], 3, 0.0)(plane) == plane).all()
    soft = kernels.smudge([(3, 4), (4, 4), (5, 4)], 3, 0.5)(plane)
    assert soft[4, 5] == 50


def test_filling_takes_what_fits():
    """A pattern of period three, whose donors are all exact, and the generator's first numbers."""
    y, x = np.mgrid[:20, :20]
    plane = ((x + 2 * y) % 3 * 80).astype(float)
    hole = np.zeros((20, 20), bool)
    hole[7:11, 8:12] = True
    assert (kernels.best_patch(lambda _: hole)(np.where(hole, 0, plane)) == plane).mean() > 0.99
    draws = kernels._Draws(1)
    assert [draws.below(1 << 32) for _ in range(2)] == [1015568748, 1586005467]
