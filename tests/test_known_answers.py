"""Known answers of single operators, and properties that hold for any input."""

import duckdb
import numpy as np
import pytest

from lamina.functions import color
from lamina.operators import adjust, compose, kernels, select, stats, trees
from lamina.plans.sql import DUCK, run


def pixels(spark, rows, width=None):
    """Rows of (r, g, b, a) of one image, in reading order."""
    width = width or len(rows)
    return spark.createDataFrame([(0, i // width, i % width, *map(int, p)) for i, p in enumerate(rows)], "image_id long, y int, x int, r int, g int, b int, a int")


def channels(frame):
    return [tuple(r) for r in frame.orderBy("y", "x").select("r", "g", "b", "a").collect()]


RAMP = [(0, 0, 0, 255), (64, 64, 64, 255), (128, 128, 128, 255), (255, 255, 255, 255), (64, 32, 0, 128), (0, 0, 0, 0)]


def test_levels_black_and_white(spark):
    got = channels(adjust.apply(pixels(spark, RAMP), adjust.levels({"black": 64, "white": 128})))
    assert [p[0] for p in got[:3]] == [0, 0, 255] and [p[3] for p in got] == [p[3] for p in RAMP]


def test_levels_gamma(spark):
    got = channels(adjust.apply(pixels(spark, RAMP), adjust.levels({"gamma": 2})))
    assert abs(got[1][0] - 128) <= 1 and abs(got[2][0] - 181) <= 1


def test_levels_reversed_output(spark):
    got = channels(adjust.apply(pixels(spark, RAMP), adjust.levels({"out_black": 255, "out_white": 0})))
    assert got[0][0] == 255 and got[4] == (64, 96, 128, 128) and got[5] == (0, 0, 0, 0)


def test_levels_are_normalised():
    black, gamma, white, low, high = adjust.level_range(300, float("nan"), -1, -100, 400)
    assert black < white and gamma == 1 and (low, high) == (0, 255)


def test_histogram_weighs_alpha(spark):
    got = {(r.channel, r.bin): r.weight for r in run(stats.histogram(), {"px": pixels(spark, [(255, 0, 0, 255), (0, 128, 0, 128), (0, 0, 0, 0)])}).collect()}
    assert got[1, 255] == 1 and got[2, 255] == pytest.approx(128 / 255, abs=1e-6)
    assert sum(w for (c, _), w in got.items() if c == 0) == pytest.approx(1 + 128 / 255, abs=1e-5)


@pytest.mark.parametrize(("mode", "want"), [("Normal", 0.8), ("Multiply", 0.32), ("Screen", 0.88), ("Overlay", 0.64), ("Darken", 0.4), ("Lighten", 0.8), ("Difference", 0.4), ("Color Dodge", 1), ("Color Burn", 0.25)])
def test_blend_modes_over_grey(mode, want):
    assert duckdb.sql(f"select {compose.blended(mode, '0.4e0', '0.8e0')}").fetchall()[0][0] == pytest.approx(want, abs=0.02)


def test_wand_tolerance(spark):
    px = pixels(spark, [(100, 100, 100, 255), (132, 132, 132, 255), (133, 133, 133, 255), (100, 100, 100, 222)])
    for tolerance, want in ((0, {0}), (32, {0, 1}), (33, {0, 1, 2, 3})):
        assert {r.x for r in run(select.wand((0, 0), tolerance), {"px": px}).collect()} == want


def test_wand_stripes(spark):
    rows = [(255, 0, 0, 255) if x < 3 or x >= 6 else (0, 0, 255, 255) for _ in range(4) for x in range(10)]
    px = pixels(spark, rows, 10)
    assert {r.x for r in run(select.wand_contiguous((1, 2), 32, 10, 4), {"px": px}).collect()} == {0, 1, 2}
    assert {r.x for r in run(select.wand((1, 2)), {"px": px}).collect()} == {0, 1, 2, 6, 7, 8, 9}
    assert not run(select.wand((40, 2)), {"px": px}).count()


def test_wand_mean_of_a_box(spark):
    px = pixels(spark, [(255, 255, 255, 255) if i == 12 else (0, 0, 0, 255) for i in range(25)], 5)
    assert {r.y * 5 + r.x for r in run(select.wand((2, 2), 10), {"px": px}).collect()} == {12}
    assert {r.y * 5 + r.x for r in run(select.wand((2, 2), 30, 1), {"px": px}).collect()} == set(range(25)) - {12}


def test_trim_block(spark):
    px = pixels(spark, [(255, 0, 0, 255) if 2 <= x < 17 and 4 <= y < 15 else (0, 0, 0, 0) for y in range(20) for x in range(20)], 20)
    assert tuple(run(stats.trim(0, width=20, height=20), {"px": px}).select("x0", "y0", "x1", "y1").first()) == (2, 4, 17, 15)
    assert not run(stats.trim(0), {"px": pixels(spark, [(9, 9, 9, 255)] * 4, 2)}).count()


def test_noise_keeps_clear_pixels_and_repeats(spark):
    px = pixels(spark, [(128, 128, 128, 255) if x < 16 else (0, 0, 0, 0) for _ in range(8) for x in range(32)], 32)
    one, two = (channels(adjust.apply(px, adjust.add_noise(10, seed=7))) for _ in range(2))
    reds = {p[0] for p in one if p[3]}
    assert one == two and len(reds) > 5 and min(reds) >= 112 and max(reds) <= 144 and all(p == (0, 0, 0, 0) for p in one if not p[3])
    assert all(p[0] == p[1] == p[2] for p in channels(adjust.apply(px, adjust.add_noise(10, mono=True))))


def test_grain_of_a_piece_is_the_whole_one_s(spark):
    whole = pixels(spark, [(128, 128, 128, 255)] * 1600, 40)
    piece = pixels(spark, [(128, 128, 128, 255)] * 400, 20)
    a = {(r.y, r.x): r.r for r in adjust.apply(whole, adjust.grain(60)).collect()}
    b = {(r.y, r.x): r.r for r in adjust.apply(piece, adjust.grain(60, origin=(10, 10))).collect()}
    assert b == {(y, x): a[y + 10, x + 10] for y in range(20) for x in range(20)}
    assert channels(adjust.apply(piece, adjust.grain(60, seed=8))) != channels(adjust.apply(piece, adjust.grain(60)))


def test_hash_values():
    for x, want in ((1, 1753845952), (77, 170770769), (4294967295, 1734902346)):
        text = f"SELECT CAST({x} AS BIGINT) AS v"
        for level in color.mix32(DUCK, "v"):
            text = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in level.items())} FROM ({text})"
        assert duckdb.sql(f"SELECT h FROM ({text})").fetchall()[0][0] == want


def test_invert_twice_and_neutral_settings_change_nothing(spark):
    px = pixels(spark, RAMP)
    assert channels(adjust.apply(adjust.apply(px, adjust.invert()), adjust.invert())) == RAMP
    for neutral in (adjust.levels(), adjust.curves(), adjust.hue_saturation({}), adjust.color_balance(), adjust.camera_raw()):
        assert all(abs(a - b) <= 1 for p, q in zip(channels(adjust.apply(px, neutral)), RAMP, strict=True) for a, b in zip(p, q, strict=True))


def test_bayer_matrices_nest():
    assert adjust.bayer(2) == [0, 2, 3, 1] and sorted(adjust.bayer(8)) == list(range(64)) and adjust.bayer(8)[:4] == [0, 32, 8, 40]


def test_bad_trees_are_rejected(spark):
    rows = [("A", "B", True), ("B", "A", True), ("C", "none", False), ("D", None, False), ("E", "D", False)]
    tree = spark.createDataFrame([(i, p, g, k, 1.0, True) for k, (i, p, g) in enumerate(rows)], "id string, parent_id string, is_group boolean, place int, opacity double, visible boolean")
    got = {(r.rule, r.id) for r in run(trees.violations(), {"tree": tree}).collect()}
    assert {("unreachable", "A"), ("unreachable", "B"), ("orphan", "C"), ("not a folder", "E")} <= got


def test_dithering_has_levels_only_and_keeps_the_mean():
    plane = np.full((32, 32), 96.0)
    out = kernels.error_diffusion()(plane)
    assert set(np.unique(out)) <= {0.0, 255.0} and abs(out.mean() - 96) < 6


def test_membrane_fills_a_plane_exactly():
    y, x = np.mgrid[:9, :9]
    plane = (3 * x + 2 * y).astype(float)
    hole = (abs(x - 4) < 3) & (abs(y - 4) < 3)
    broken = np.where(hole, 0, plane)
    assert np.abs(kernels.membrane(lambda _: hole)(broken) - plane).max() < 1e-6


def test_content_fill_takes_what_is_there_and_repeats():
    rng = np.random.default_rng(1)
    plane = np.tile(rng.integers(0, 255, (1, 12)).astype(float), (12, 1))
    hole = np.zeros((12, 12), bool)
    hole[4:7, 4:7] = True
    fill = kernels.best_patch(lambda _: hole)
    out = fill(np.where(hole, 0, plane))
    assert set(out[hole]) <= set(plane[~hole]) and (out == fill(np.where(hole, 0, plane))).all()


def test_outlines_and_paths():
    square = [(0, 0, 1, 0), (1, 0, 1, 1), (1, 1, 0, 1), (0, 1, 0, 0)]
    assert kernels.trace_loops(square) == [[(0, 0), (1, 0), (1, 1), (0, 1)]]
    two = [(x0 + d, y0 + d, x1 + d, y1 + d) for d in (0, 1) for x0, y0, x1, y1 in square]
    assert sorted(map(len, kernels.trace_loops(two))) == [4, 4]
    assert kernels.simplified([(0, 0), (1, 0.1), (2, 0), (2, 5)], 1) == [(0, 0), (2, 0), (2, 5)]
    assert kernels.leashed([(0, 0), (1, 0), (5, 0)], 2) == [(0, 0), (3.0, 0.0)]


def test_cube_of_the_identity():
    n = 5
    b, g, r = np.meshgrid(*[np.linspace(0, 1, n)] * 3, indexing="ij")
    colors = np.random.default_rng(0).random((50, 3))
    assert np.allclose(kernels.trilinear_cube(np.stack([r, g, b], -1))(colors), colors)
