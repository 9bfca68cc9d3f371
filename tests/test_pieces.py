"""Tiles, reduced copies, regions, outlines, queues, text styles, floating merges and the blocks of layered files against plain loops."""

import collections
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.operators import forest, kernels, pyramid, queues, regions, scene, tiles
from lamina.sources import psd, psd_blocks
from tests.test_scene import LAYERS, Loops, layer


def plane_rows(planes, values="v"):
    return [(i, y, x, *(np.atleast_1d(p[y, x]).tolist())) for i, p in planes.items() for y in range(p.shape[0]) for x in range(p.shape[1])]


def as_planes(rows, sizes):
    out = {i: np.full(s, np.nan) for i, s in sizes.items()}
    for i, y, x, v in rows:
        out[i][y, x] = v
    return out


@pytest.fixture(scope="module")
def rasters(spark):
    rng = np.random.default_rng(0)
    shapes = {0: (1, 1), 1: (7, 30), 2: (33, 20), 3: (16, 16), 4: (1, 40)}
    planes = {i: rng.integers(0, 256, s).astype(float) for i, s in shapes.items()}
    pixels = spark.createDataFrame(plane_rows(planes), "image_id long, y int, x int, v double").cache()
    sizes = spark.createDataFrame([(i, *s) for i, s in shapes.items()], "image_id long, height int, width int")
    return planes, pixels, sizes


@pytest.mark.parametrize(("tile", "halo"), [(8, 3), (5, 5), (3, 7), (64, 2)])
def test_a_spatial_operator_by_tiles_is_that_of_whole_images(rasters, tile, halo):
    planes, pixels, sizes = rasters
    cut = tiles.to_tiles(pixels, sizes, tile)
    for kernel in (tiles.box_mean(halo), tiles.greatest(halo)):
        got = as_planes(tiles.to_pixels(tiles.spatial(cut, kernel, halo, tile)).select("image_id", "y", "x", "v").collect(), {i: p.shape for i, p in planes.items()})
        assert all(np.allclose(got[i], kernel(p), atol=1e-9) for i, p in planes.items())


def test_only_what_a_change_reaches_is_done_again(spark, rasters):
    planes, pixels, sizes = rasters
    tile, halo = 4, 2
    moved = pixels.withColumn("v", F.when(F.expr("image_id = 2 AND y = 17 AND x = 9"), 0.0).otherwise(F.col("v")))
    before, after = (tiles.to_tiles(p, sizes, tile) for p in (pixels, moved))
    changed = tiles.changed_tiles(before, after)
    assert [tuple(r) for r in changed.select("image_id", "ty", "tx").collect()] == [(2, 4, 2)]
    kernel = tiles.box_mean(halo)
    old = tiles.spatial(before, kernel, halo, tile)
    fresh = tiles.recomputed(old, after, changed, kernel, halo, tile)
    want = {i: p.copy() for i, p in planes.items()}
    want[2][17, 9] = 0
    got = as_planes(tiles.to_pixels(fresh).select("image_id", "y", "x", "v").collect(), {i: p.shape for i, p in planes.items()})
    assert all(np.allclose(got[i], kernel(p), atol=1e-9) for i, p in want.items())
    assert tiles.around(changed, halo, tile).count() == 9 and tiles._needed(after, tiles.around(changed, halo, tile), halo, tile).count() <= 25 < after.count()


def test_small_tiles_are_worked_on_together(spark):
    """A kernel is called for many tiles at once; batches that end within a tile change nothing."""
    rng = np.random.default_rng(1)
    planes = {i: rng.integers(0, 256, (9, 10)).astype(float) for i in range(40)}
    pixels = spark.createDataFrame(plane_rows(planes), "image_id long, y int, x int, v double").cache()
    sizes = spark.createDataFrame([(i, 9, 10) for i in planes], "image_id long, height int, width int")
    together = tiles.spatial(tiles.to_tiles(pixels, sizes, 4), lambda window: np.full_like(window, window.size), 2, 4)
    assert tiles.to_pixels(together).agg(F.max("v")).first()[0] > 8 * 8
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        kernel = tiles.box_mean(2)
        got = as_planes(tiles.to_pixels(tiles.spatial(tiles.to_tiles(pixels, sizes, 4), kernel, 2, 4)).collect(), {i: p.shape for i, p in planes.items()})
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert all(np.allclose(got[i], kernel(p), atol=1e-9) for i, p in planes.items())


# reduced copies


def halve(plane, mask):
    weights = np.array([w for _, w in pyramid.taps()])

    def along(p):
        padded = np.pad(p, ((0, 0), (5, 7)), mode="edge") if mask else np.pad(p, ((0, 0), (5, 7)))
        return np.stack([(padded[:, 2 * i : 2 * i + 12] * weights).sum(axis=1) for i in range((p.shape[1] + 1) // 2)], axis=1)

    return np.clip(np.floor(np.round(along(along(plane).T).T, 6) + 0.5), 0, 255)


def test_pyramids(spark):
    """Three levels of odd and even sizes; colours stay within their alpha, flat ones are kept inside."""
    rng = np.random.default_rng(1)
    images = {0: rng.integers(0, 256, (13, 9, 4)), 1: np.full((8, 20, 4), 255), 2: rng.integers(0, 256, (1, 1, 4))}
    for p in images.values():
        p[..., :3] = np.minimum(p[..., :3], p[..., 3:])
    pixels = spark.createDataFrame(plane_rows(images), "image_id long, y int, x int, r int, g int, b int, a int")
    sizes = spark.createDataFrame([(i, *p.shape[:2]) for i, p in images.items()], "image_id long, height int, width int")
    got = collections.defaultdict(dict)
    for r in pyramid.pyramid(pixels, sizes, 3).collect():
        got[r.image_id, r.level][r.y, r.x] = (r.r, r.g, r.b, r.a)
    for i, p in images.items():
        for level in (1, 2, 3):
            if max(p.shape[:2]) == 1:
                assert (i, level) not in got
                continue
            p = np.stack([halve(p[..., c].astype(float), False) for c in range(4)], axis=2)
            p[..., :3] = np.minimum(p[..., :3], p[..., 3:])
            assert got[i, level] == {(y, x): tuple(p[y, x].astype(int)) for y in range(p.shape[0]) for x in range(p.shape[1])}
    assert got[1, 1][2, 5] == (255, 255, 255, 255) and abs(sum(w for _, w in pyramid.taps()) - 1) < 1e-12
    masks = spark.createDataFrame(plane_rows({0: images[0][..., 0], 1: np.full((5, 7), 200)}), "image_id long, y int, x int, v int")
    sizes = spark.createDataFrame([(0, 13, 9), (1, 5, 7)], "image_id long, height int, width int")
    got = {(r.image_id, r.y, r.x): r.v for r in pyramid.pyramid(masks, sizes, 2, True).filter("level = 2").collect()}
    want = halve(halve(images[0][..., 0].astype(float), True), True)
    assert all(got[0, y, x] == want[y, x] for y in range(4) for x in range(3)) and {v for (i, _, _), v in got.items() if i == 1} == {200}


# regions and outlines


def flood_labels(plane):
    out, label = {}, {}
    for y, x in sorted(zip(*np.nonzero(plane >= 0), strict=True)):
        if (y, x) in out:
            continue
        stack = [(y, x)]
        out[y, x] = (y, x)
        while stack:
            a, b = stack.pop()
            for p in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= p[0] < plane.shape[0] and 0 <= p[1] < plane.shape[1] and p not in out and plane[p] == plane[y, x]:
                    out[p] = (y, x)
                    stack.append(p)
    return out, label


@pytest.mark.parametrize("tile", [1, 3, 8, 64])
def test_regions_are_those_of_a_flood_fill(spark, tile):
    rng = np.random.default_rng(tile)
    planes = {0: rng.integers(-1, 2, (20, 17)), 1: rng.integers(0, 2, (9, 40)), 2: np.zeros((12, 12), int), 3: np.indices((10, 10)).sum(axis=0) % 2}
    rows = [(i, y, x, c) for i, y, x, c in plane_rows(planes) if c >= 0]
    got = {(r.image_id, r.y, r.x): r.region for r in regions.labelled(spark.createDataFrame(rows, "image_id long, y int, x int, c int"), tile).collect()}
    assert got == {(i, y, x): int(a) * regions.ROW + int(b) for i, p in planes.items() for (y, x), (a, b) in flood_labels(p)[0].items()}


def winding(n, turn):
    """A corridor one pixel wide that goes up and down through a whole square; walls between its columns."""
    open_ = np.zeros((n, n), bool)
    open_[:, ::2] = True
    for k, x in enumerate(range(1, n, 2)):
        open_[(0 if k % 2 else n - 1), x] = True
    return open_ if turn else open_.T


def test_a_region_that_winds_through_a_million_pixels(spark):
    n = 1001
    open_ = winding(n, True)
    ys, xs = np.nonzero(open_)
    pixels = spark.range(n * n).selectExpr("0L AS image_id", f"CAST(id DIV {n} AS INT) AS y", f"CAST(id % {n} AS INT) AS x")
    path = pixels.withColumn("open", F.expr(f"x % 2 = 0 OR (x % 4 = 1 AND y = {n - 1}) OR (x % 4 = 3 AND y = 0)"))
    shaded = path.selectExpr("image_id", "y", "x", *[f"CASE WHEN open THEN 100 + (y + x) % 5 ELSE 0 END AS {c}" for c in "rgb"], "255 AS a")
    got = regions.flooded(shaded, spark.createDataFrame([(0, 0, 0)], "image_id long, y int, x int"), 8, 256)
    assert got.count() == len(ys) and got.agg(F.sum("y"), F.sum("x"), F.sum(F.expr("CAST(y AS LONG) * x"))).first()[:] == (int(ys.sum()), int(xs.sum()), int((ys.astype(np.int64) * xs).sum()))


def loop_key(points):
    i = points.index(min(points, key=lambda p: (p[1], p[0])))
    return tuple(points[i:] + points[:i])


def test_outlines_are_ordered_loops(spark):
    """Blocks, holes, corners that touch, and noise: the same loops as traced one by one."""
    rng = np.random.default_rng(4)
    ring = np.ones((9, 9), int)
    ring[3:6, 2:7] = 0
    ring[4, 4] = 1
    planes = {0: np.ones((1, 1), int), 1: np.eye(5, dtype=int), 2: ring, 3: rng.integers(0, 2, (14, 11)), 4: (rng.random((30, 25)) < 0.8).astype(int), 5: winding(13, False).astype(int)}
    region = spark.createDataFrame([(i, y, x) for i, y, x, c in plane_rows(planes) if c], "image_id long, y int, x int")
    found = collections.defaultdict(list)
    for r in regions.loops(region).orderBy("image_id", "loop", "seq").collect():
        found[r.image_id, r.loop].append((r.x, r.y))
    for i, p in planes.items():
        inside = lambda y, x: 0 <= y < p.shape[0] and 0 <= x < p.shape[1] and p[y, x]  # noqa: B023, E731
        sides = []
        for y, x in zip(*np.nonzero(p), strict=True):
            y, x = int(y), int(x)
            sides += [e for e, out in (((x, y, x + 1, y), not inside(y - 1, x)), ((x + 1, y, x + 1, y + 1), not inside(y, x + 1)), ((x + 1, y + 1, x, y + 1), not inside(y + 1, x)), ((x, y + 1, x, y), not inside(y, x - 1))) if out]
        want = sorted(loop_key([tuple(map(int, c)) for c in loop]) for loop in kernels.trace_loops(sides))
        assert sorted(loop_key(v) for (j, _), v in found.items() if j == i) == want


def test_smoothed_loops(spark):
    """A jagged disc becomes a round loop near it; a single pixel keeps to its square."""
    disc = [(0, y, x) for y in range(41) for x in range(41) if (y - 20) ** 2 + (x - 20) ** 2 <= 300]
    got = regions.smoothed(regions.loops(spark.createDataFrame([*disc, (1, 5, 5)], "image_id long, y int, x int"))).collect()
    away = [math.hypot(r.x - 20.5, r.y - 20.5) for r in got if r.image_id == 0]
    assert len(away) > 30 and max(away) < 300**0.5 + 2 and min(away) > 300**0.5 - 2.5
    assert all(5 <= r.x <= 6 and 5 <= r.y <= 6 for r in got if r.image_id == 1)


# trees


def test_places_of_any_size_and_hot_folders(spark):
    """Order beyond a million, a folder with most of the nodes, and equal places."""
    rows = [("a", None, 1), ("b", None, 2), *[(f"n{i}", "a" if i % 10 else "b", p) for i, p in enumerate(random.Random(0).sample(range(10**12), 3000))], ("t1", "b", 5), ("t2", "b", 5), ("u1", "t2", 1), ("u2", "t1", 9), ("big", "a", 1_000_001), ("small", "a", 200_000)]
    tree = spark.createDataFrame([(i, p, i in ("a", "b", "t1", "t2"), place, 0.5, True) for i, p, place in rows], "id string, parent_id string, is_group boolean, place long, opacity double, visible boolean")
    got = [r.id for r in forest.depth_first(tree).orderBy("rank").collect()]
    children = collections.defaultdict(list)
    for i, p, place in rows:
        children[p].append((place, i))
    want = []

    def walk(node):
        for _, i in sorted(children[node]):
            want.append(i)
            walk(i)

    walk(None)
    assert got == want and got.index("small") < got.index("big")


# queues and styles


def test_queues_admit_as_a_loop_does(spark):
    rng = random.Random(3)
    rows = []
    for q in range(12):
        for s in range(rng.choice([0, 1, 5, 300])):
            rows.append((q, s * 7 + q, rng.choice([1, 5, 40, 90, 200]), rng.choice([1, 3, 20, 80]), rng.choice([None] * 9 + ["damaged"])))
    rows += [(20, i, 100 - i, 1, None) for i in range(40)] + [(21, 1, None, 4, None), (21, 2, 0, 4, None), (21, 3, 5, 40_000, None), (21, 4, 10, 10, None)]
    got = {(r.queue_id, r.seq): (r.status, r.used) for r in queues.admitted(spark.createDataFrame(rows, "queue_id long, seq long, width long, height long, error string").repartition(5), 1000, 30_000).collect()}
    used = collections.Counter()
    for q, s, w, h, e in sorted(rows, key=lambda r: r[:2]):
        status = "unreadable" if e or not w or not h else "too large" if max(w, h) > 30_000 or w * h > 1000 - used[q] else "imported"
        used[q] += w * h if status == "imported" else 0
        assert got.pop((q, s)) == (status, used[q])
    assert not got


def test_headers_are_probed(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 64, 32)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc4\x00\x03x\xff\xc2\x00\x0b\x08" + struct.pack(">HH", 7, 9) + b"\x01"
    files = [png, b"8BPS\0\2" + bytes(6) + struct.pack(">HII", 3, 11, 22), jpeg, png[:18], jpeg[:9], b"", b"GIF89a", None]
    rows = spark.createDataFrame([(1, i, f"f{i}", bytearray(f) if f is not None else None) for i, f in enumerate(files)], "queue_id long, seq long, path string, content binary")
    got = {r.seq: (r.width, r.height, r.error is None) for r in queues.probed(rows).collect()}
    assert [got[i] for i in range(3)] == [(64, 32, True), (22, 11, True), (9, 7, True)] and all(got[i] == (None, None, False) for i in range(3, 8))


def test_styles_are_those_of_an_array_of_units(spark):
    rng = random.Random(5)
    runs, edits, want = [], [], {}
    for t in range(40):
        n = rng.choice([1, 2, 9, 60])
        units, at = [], 0
        while at < n:
            length, style = min(n - at, rng.randint(1, 12)), (rng.choice("ab"), rng.choice(["1", None]), "x")
            runs.append((t, at, length, *style))
            units += [list(style) for _ in range(length)]
            at += length
        for seq in range(rng.choice([0, 1, 40])):
            first, last, k = rng.randint(-3, n + 3), rng.randint(-3, n + 5), rng.randrange(3)
            value = rng.choice(["a", "b", None])
            edits.append((t, seq, first, last, queues.ATTRIBUTES[k], value))
            for i in range(max(0, first), min(n, last)):
                units[i][k] = value
        out = []
        for i, u in enumerate(units):
            if out and out[-1][2:] == u:
                out[-1][1] += 1
            else:
                out.append([i, 1, *u])
        want[t] = [tuple(o) for o in out]
    got = collections.defaultdict(list)
    styles = "font string, size string, colour string"
    found = queues.restyled(spark.createDataFrame(runs, f"text_id long, start long, length long, {styles}"), spark.createDataFrame(edits, "text_id long, seq long, first long, last long, attribute string, value string"))
    for r in found.orderBy("text_id", "start").collect():
        got[r.text_id].append((r.start, r.length, r.font, r.size, r.colour))
    assert dict(got) == want


# floating pixels


@pytest.mark.parametrize("box", [((1.0, 1.0, 4.0, 4.0), 0.0), ((-2.0, 3.0, 3.0, 2.0), 0.0), ((2.0, -1.5, 4.0, 5.0), 30.0)])
def test_floating_pixels_are_merged_into_a_grown_grid(spark, box):
    rng = np.random.default_rng(6)
    own, loose = ({(y, x): tuple(min(int(v), a) for v in rng.integers(0, 256, 3)) + (a,) for y in range(4) for x in range(4) for a in [int(rng.integers(1, 256))]} for _ in range(2))
    schema = "layer_id long, y int, x int, r int, g int, b int, a int"
    frame = lambda pixels: spark.createDataFrame([(5, *k, *v) for k, v in pixels.items()], schema)
    source = layer(5, box=(1.0, 1.0, 4.0, 4.0), grid=(4, 4), flips=(True, False), nearest=False)
    over = layer(5, box=box[0], rotation=box[1], grid=(4, 4), nearest=False)
    layers, floats = (spark.createDataFrame([r], LAYERS) for r in (source, over))
    placed, merged = scene.floating_merged(layers, frame(own), floats, frame(loose))
    new = placed.first()
    got = {(r.y, r.x): (r.r, r.g, r.b, r.a) for r in merged.collect()}
    loops = Loops(floats.collect(), {(5, *k): v for k, v in loose.items()}, {}, (0, 0))
    want = {}
    # the grown grid is flipped like its source: places are taken from the document
    for y in range(new.grid_h):
        for x in range(new.grid_w):
            px, py = new.ox + new.w - (x + 0.5) * new.w / new.grid_w, new.oy + (y + 0.5) * new.h / new.grid_h
            sx, sy = 3 - math.floor(px - 1.0), math.floor(py - 1.0)
            below = np.array(own.get((sy, sx), (0, 0, 0, 0)), float)
            top = loops.sample(floats.first(), px, py)
            top = np.zeros(4) if top is None else top * 255
            want[y, x] = top + below * (1 - top[3] / 255)
    assert new.w == new.grid_w and new.h == new.grid_h
    assert all(np.abs(np.array(got.get(k, (0, 0, 0, 0))) - v).max() <= 0.51 for k, v in want.items())
    assert set(got) <= set(want)


# blocks of layered files


def uni(s):
    return struct.pack(">I", len(s.encode("utf-16-be")) // 2) + s.encode("utf-16-be")


def name(s):
    return struct.pack(">I", 0) + s.encode() if len(s) == 4 else struct.pack(">I", len(s)) + s.encode()


def descriptor(items):
    return uni("") + name("null") + struct.pack(">I", len(items)) + b"".join(name(k) + v for k, v in items)


def box(left, top, right, bottom):
    return b"Objc" + descriptor([(k, b"UntF#Pnt" + struct.pack(">d", v)) for k, v in (("Left", left), ("Top ", top), ("Rght", right), ("Btom", bottom))])


def engine_data(text, fonts, runs, lengths, justification=0):
    escape = lambda b: b.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    string = lambda s: b"(" + escape(b"\xfe\xff" + s.encode("utf-16-be")) + b")"
    sheets = b" ".join(b"<< /StyleSheet << /StyleSheetData << /Font %d /FontSize %.2f /AutoLeading false /Leading 20 /Tracking 50 /FauxBold false /FillColor << /Type 1 /Values [ 1.0 %.1f .5 0.25 ] >> >> >> >>" % r for r in runs)
    return (
        b"\n\n<< /EngineDict << /Editor << /Text " + string(text) + b" >> /ParagraphRun << /RunArray [ << /ParagraphSheet << /Properties << /Justification %d >> >> >> ] >> %% a remark >>\n" % justification
        + b" /StyleRun << /RunArray [ " + sheets + b" ] /RunLengthArray [ " + b" ".join(b"%d" % n for n in lengths) + b" ] >> >> /ResourceDict << /FontSet [ " + b" ".join(b"<< /Name " + string(f) + b" /Synthetic 0 >>" for f in fonts) + b" ] /Hex <feff0041> /Null null >> >>"
    )


def text_block(text, fonts, runs, lengths, matrix=(2.0, 0.0, 0.0, 2.0, 30.0, 40.0), extra=(), justification=0, words="Txt "):
    raw = engine_data(text, fonts, runs, lengths, justification)
    items = [("boundsRef", b"obj " + struct.pack(">I", 2) + b"prop" + uni("") + name("Lyr ") + name("Txt ") + b"indx" + struct.pack(">i", 1)), (words, b"TEXT" + uni(text)), ("Ornt", b"enum" + name("Ornt") + name("Hrzn")), ("list", b"VlLs" + struct.pack(">I", 2) + b"long\0\0\0\1bool\1"), *extra, ("EngineData", b"tdta" + struct.pack(">I", len(raw)) + raw)]
    return struct.pack(">H6dH", 1, *matrix, 50) + struct.pack(">I", 16) + descriptor(items) + struct.pack(">HI", 1, 16) + descriptor([("warpStyle", b"enum" + name("warpStyle") + name("warpNone"))])


RUNS, LENGTHS, FONTS = [(0, 12.0, 0.5), (1, 24.5, 1.0)], [5, 9], ["Älpha-Bold", "Beta(1)"]


def test_text_of_layered_files(spark):
    """Runs, fonts, sizes, places and frames come back; sheared and vertical text is none; damaged blocks are rows with an error."""
    text = "Hé(l)\\lo\r😀 wide"
    turned = (0.0, -3.0, 3.0, 0.0, 1.0, 2.0)
    good = text_block(text, FONTS, RUNS, LENGTHS)
    framed = text_block("x y", FONTS, RUNS[:1], [3], turned, [("bounds", box(1, 2, 101, 52)), ("boundingBox", box(1, 2, 31, 12))], 2)
    blocks = [{"TySh": good}, {"tySh": framed}, {"TySh": text_block(text, FONTS, RUNS, LENGTHS, (2.0, 1.0, 0.0, 2.0, 0.0, 0.0))}, {"TySh": good.replace(b"Hrzn", b"Vrtc")}, {"levl": b""}, {}, None]
    blocks += [{"TySh": good[:n]} for n in range(0, len(good) - 120, 37)] + [{"TySh": b"\0\2" + good[2:]}, {"TySh": good.replace(b"/EngineDict <<", b"/EngineDict >>")}, {"TySh": good.replace(b"<< /Editor", b"<< " * 80 + b"/Editor")}]
    frame = spark.createDataFrame([(i, None if b is None else {k: bytearray(v) for k, v in b.items()}) for i, b in enumerate(blocks)], "z int, blocks map<string,binary>")
    got = {r.z: r for r in psd_blocks.texts(frame, ["z"]).collect()}
    assert not {2, 3, 4, 5, 6} & got.keys() and all(got[i].error and got[i].text is None for i in range(7, len(blocks)))
    first = got[0]
    assert first.error is None and first.text == "Hé(l)\\lo\n😀 wide" and (first.font, first.size, first.alignment, first.rotation, first.flip_y) == ("Älpha-Bold", 24.0, "left", 0.0, False)
    assert [(r.start, r.length, r.font, r.size, r.red, r.green, r.blue) for r in first.runs] == [(0, 5, "Älpha-Bold", 24.0, 0.5, 0.5, 0.25), (5, 9, "Beta(1)", 49.0, 1.0, 0.5, 0.25)]
    assert (first.anchor_x, first.anchor_y, first.tracking, first.leading, first.box_width, first.notes) == (30.0, 40.0, 50 * 24 / 1000, 40.0, None, ["several styles"])
    second = got[1]
    assert second.alignment == "center" and (second.box_width, second.box_height) == (300.0, 150.0) and second.rotation == pytest.approx(90)
    assert (second.anchor_x, second.anchor_y) == pytest.approx((1 - 3 * 2, 2 + 3 * 1))


def knot(kind, *points):
    return struct.pack(">h6i", kind, *(round(v * (1 << 24)) for x, y in points for v in (y, x)))


def path_block(*subpaths):
    """Closed subpaths of knots (incoming, own, outgoing)."""
    return struct.pack(">II", 3, 0) + struct.pack(">h24x", 6) + b"".join(struct.pack(">hh22x", 0 if closed else 3, len(ks)) + b"".join(knot(1 if closed else 4, *k) for k in ks) for closed, ks in subpaths) + struct.pack(">h24x", 8)


def corner(x, y):
    return ((x, y),) * 3


def winding_coverage(lines, width, height, rows=4):
    out = np.zeros((height, width))
    for s in range(height * rows):
        at = (s + 0.5) / rows
        crossings = sorted((x0 + (at - y0) * (x1 - x0) / (y1 - y0), 1 if y1 > y0 else -1) for x0, y0, x1, y1 in lines if min(y0, y1) <= at < max(y0, y1))
        turns = 0
        for (x, turn), (end, _) in zip(crossings, crossings[1:], strict=False):
            turns += turn
            if turns:
                for px in range(max(0, math.floor(x)), min(width, math.ceil(end))):
                    out[s // rows, px] += max(0.0, min(end, px + 1) - max(x, px)) / rows
    return out


def test_paths_of_layered_files(spark):
    """A triangle, a curved blob over a square wound the same way and a hole wound against it, partly beyond the canvas, and an open path: coverage as by a plain scan."""
    blob = [((0.2, 0.1), (0.5, -0.1), (0.8, 0.1)), ((0.9, 0.3), (0.7, 0.7), (0.6, 0.9)), ((0.4, 0.9), (0.3, 0.6), (0.1, 0.4))]
    square, hole = [corner(*p) for p in ((0.4, 0.4), (1.2, 0.4), (1.2, 0.95), (0.4, 0.95))], [corner(*p) for p in ((0.5, 0.5), (0.5, 0.8), (0.8, 0.8), (0.8, 0.5))]
    blocks = [{"vmsk": path_block((True, [corner(0.1, 0.1), corner(0.9, 0.2), corner(0.3, 0.95)]))}, {"vsms": path_block((True, blob), (True, square), (True, hole))}, {"vmsk": path_block((False, [corner(0.0, 0.0), corner(1.0, 0.5), corner(0.0, 1.0)]))}, {"vmsk": b"short"}, {"vmsk": path_block((True, square), (True, hole))}]
    frame = spark.createDataFrame([(i, {k: bytearray(v) for k, v in b.items()}) for i, b in enumerate(blocks)], "z int, blocks map<string,binary>")
    knots = psd_blocks.knots(frame, ["z"])
    assert {(r.z, r.subpath): r["count"] for r in knots.groupBy("z", "subpath").count().collect()} == {(0, 0): 3, (1, 0): 3, (1, 1): 4, (1, 2): 4, (2, 0): 3, (4, 0): 4, (4, 1): 4}
    canvases = spark.createDataFrame([(i, 23, 17) for i in range(5)], "z int, width int, height int")
    lines = psd_blocks.flattened(knots.join(canvases, "z"), ["z"]).cache()
    cover = {(r.z, r.y, r.x): r.c for r in psd_blocks.coverage(lines, canvases, ["z"]).collect()}
    for z in (0, 1, 2, 4):
        want = winding_coverage([(r.x0, r.y0, r.x1, r.y1) for r in lines.filter(f"z = {z}").collect()], 23, 17)
        got = np.array([[cover.get((z, y, x), 0.0) for x in range(23)] for y in range(17)])
        assert want.sum() > 20 and np.abs(got - want).max() < 2e-6
    first = knots.filter("z = 1 AND subpath = 0 AND seq = 1").first()
    assert (first.x, first.in_x, first.out_y) == pytest.approx((0.7, 0.9, 0.9), abs=1e-6)
    # a hole is wound against what it is cut from
    assert (4, 10, 14) not in cover and cover[4, 14, 20] == 1.0 == cover[1, 14, 20]


def test_adjustments_of_layered_files(spark):
    levels = struct.pack(">H", 2) + b"".join(struct.pack(">5H", *v) for v in ((10, 240, 0, 255, 150), (300, 20, 0, 400, 5), (0, 255, 0, 255, 100), (0, 255, 255, 0, 2000))) + bytes(300)
    curves = b"\0" + struct.pack(">HH", 4, 2) + struct.pack(">H4H", 2, 30, 20, 200, 180) + struct.pack(">H2H", 1, 9, 9)
    hue = struct.pack(">HBx3h3h", 2, 0, 1, 2, 3, -10, 20, 30) + b"".join(struct.pack(">4h3h", 315 + 60 * i, 345 + 60 * i, 15 + 60 * i, 45 + 60 * i, i, -i, 2 * i) for i in range(6))
    blocks = [{"levl": levels}, {"curv": curves}, {"hue2": hue}, {"hue ": b"\0\2\1" + hue[3:16]}, {"levl": b"\0"}, {"curv": curves[:6]}, {"curv": b"\0\0\7"}]
    frame = spark.createDataFrame([(i, {k: bytearray(v) for k, v in b.items()}) for i, b in enumerate(blocks)], "z int, blocks map<string,binary>")
    got = collections.defaultdict(dict)
    for r in psd_blocks.adjustments(frame, ["z"]).collect():
        got[r.z][r.part, r.name] = r.value if r.error is None else r.error
    assert got[0]["RGB", "gamma"] == 1.5 and (got[0]["Red", "black"], got[0]["Red", "white"], got[0]["Red", "gamma"], got[0]["Red", "out_white"]) == (253, 255, 0.1, 255) and got[0]["Blue", "gamma"] == 9.99
    assert got[1] == {("RGB", "0"): 30, ("RGB", "20"): 30, ("RGB", "180"): 200, ("RGB", "255"): 200}
    assert got[2]["Master", "hue"] == -10 and got[2]["Magentas", "falloff_start"] == (315 + 300) % 360 and got[2]["Cyans", "lightness"] == 6
    assert got[3] == {("Colorize", "hue"): 1, ("Colorize", "saturation"): 2, ("Colorize", "lightness"): 3}
    assert all(isinstance(v, str) for z in (4, 5, 6) for v in got[z].values()) and {4, 5, 6} <= got.keys()


def test_blocks_go_along_with_layers():
    """A layer record's additional blocks are read with its pixels."""
    block = text_block("hi", FONTS, RUNS[:1], [2])
    info = b"8BIMTySh" + struct.pack(">I", len(block)) + block + b"\0" * (len(block) % 2) + b"8BIMzzzz" + struct.pack(">I", 4) + b"skip"
    extra = struct.pack(">II", 0, 0) + b"\x03txt" + info
    record = struct.pack(">4iH", 0, 0, 1, 1, 3) + b"".join(struct.pack(">hI", c, 3) for c in range(3)) + b"8BIMnorm" + struct.pack(">BBBxI", 255, 0, 0, len(extra)) + extra
    layers = struct.pack(">h", 1) + record + b"\0\0\x40" * 3
    file = b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, 1, 1, 8, 3) + struct.pack(">II", 0, 0) + struct.pack(">II", len(layers) + 4, len(layers)) + layers
    (row,) = psd.read(file)
    assert row["blocks"].keys() == {"TySh"} and psd_blocks.text_of(row["blocks"]["TySh"])["text"] == "hi"


def test_batches_of_layered_files_are_opened_in_pieces():
    """However many rows or bytes a batch has, only a bounded piece of it is opened at once; rows keep their order, and a row of any size comes by itself."""
    blocks = [b"x" * (3_000_000 if i == 700 else 100) for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array([[("TySh", b)] for b in blocks], pa.map_(pa.string(), pa.binary()))], names=["id", "blocks"])
    pieces = list(psd_blocks._pieces(iter([batch.slice(0, 0), batch])))
    assert [i for p in pieces for i in p.column("id").to_pylist()] == list(range(2000))
    assert all(p.num_rows <= 512 and (p.num_rows == 1 or p.nbytes <= 1 << 20) for p in pieces)
