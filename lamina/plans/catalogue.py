"""All registered raster queries by name."""

from __future__ import annotations

from lamina.operators import adjust as A
from lamina.operators import compose as C
from lamina.operators import detail as D
from lamina.operators import edits as E
from lamina.operators import forest as T
from lamina.operators import geometry as M
from lamina.operators import kernels as K
from lamina.operators import neighbours as N
from lamina.operators import placement as P
from lamina.operators import pyramid as Y
from lamina.operators import queues as U
from lamina.operators import records as X
from lamina.operators import regions as B
from lamina.operators import scene as O
from lamina.operators import scene_sql as OS
from lamina.operators import select as S
from lamina.operators import stats as G
from lamina.operators import strokes as W
from lamina.operators import tiles as I
from lamina.operators import trees as R
from lamina.plans.sql import Query, Source, Text
from lamina.plans.staging import staged
from lamina.sources import package as K_
from lamina.sources import psd_queries as F
from lamina.sources import views as V

RGBA = {"px": V.RGBA}

MAPS = {
    "levels": A.levels({"black": 20, "white": 230, "gamma": 1.2}, ({"gamma": 0.8}, {"black": 10}, {"out_white": 240})),
    "curves": A.curves([(0, 0), (64, 48), (192, 210), (255, 255)], (A.LINE, [(0, 10), (255, 245)], A.LINE)),
    "curves_lut": A.tone_table(A.curve_table([(0, 0), (90, 120), (255, 255)])),
    "parametric_curve": A.tone_table(A.parametric_curve(20, -30, 25, -10)),
    "exposure": A.exposure(0.7, 0.02, 1.1),
    "gradient_map": A.gradient_map((0.1, 0.0, 0.3), (1.0, 0.9, 0.6)),
    "black_white": A.black_white(),
    "black_white_tint": A.black_white(tint=(42, 0.25)),
    "color_balance": A.color_balance((0.1, -0.05, 0.0), (0.2, 0.0, -0.1), (0.0, 0.05, 0.1)),
    "invert": A.invert(),
    "clamp_to_alpha": A.clamp_to_alpha(),
    "hue_saturation_direct": A.hue_saturation({"Master": (10, 20, 5), "Reds": (-20, -30, 0), "Blues": (15, 40, -10)}),
    "hue_saturation_colorize": A.hue_saturation({}, (210, 40, 10)),
    "camera_raw_light": A.camera_raw((1.05, 1.0, 0.95), 0.3, 15, -30, 25, 10, -10, 20, 5),
    "calibration": A.calibration(10, (20, 10), (-15, 5), (30, -20), 3),
    "dehaze": A.dehaze(40),
    "dehaze_negative": A.dehaze(-30),
    "vignette": A.vignette(4, 4, -40, 30, 20, 60, 50),
    "vignette_color_priority": A.vignette(4, 4, -40, 30, 20, 60, 0, 1),
    "colored_vignette": A.colored_vignette((0, 0, 4, 4), 60, (0.8, 0.2, 0.1), 20, 0, 50, 30),
    "colored_vignette_fills": A.colored_vignette((0, 0, 4, 4), 60, (0.8, 0.2, 0.1), 20, 0, 50, 30, True),
    "lens_vignette": A.lens_vignette(4, 4, 30, 40),
    "defringe": A.defringe(60, (270, 330), 40, (60, 120)),
    "clip_overlay": A.clip_overlay(),
    "add_noise_uniform": A.add_noise(20),
    "add_noise_gaussian": A.add_noise(15, True, False, 11),
    "add_noise_mono": A.add_noise(20, False, True, 5, (3, -2)),
    "grain": A.grain(60),
    "bayer_dither": A.ordered_dither(8, 2),
    "bayer_dither_4": A.ordered_dither(4, 3),
    "halftone": A.halftone("dots"),
    "halftone_lines": A.halftone("lines", 3, 30),
    "pattern_fill": A.pattern_fill(),
    "quantize": A.quantize(5),
    "dot_matrix": A.dot_matrix(),
    "solid_fill": A.fill((200, 40, 90), 0.6),
    "linear_gradient": A.gradient((255, 0, 0), (0, 64, 255), (0, 0), (4, 3)),
    "radial_gradient": A.gradient((255, 255, 255), (10, 20, 30), (2, 2), (4, 4), True),
}

GREY, BOTH = {"px": V.GREY}, {"px": V.GREY, "layers": V.LAYERS}
ELLIPSE = S.ellipse((2, 2), (1.5, 1.8))
POLYGON = S.polygon([(0.2, 0.4), (3.7, 0.9), (2.2, 3.6)])
WAND = S.wand((1, 1), 40, 1)


def _table(name: str) -> Source:
    return Source(lambda d: "SELECT * FROM " + ("{" + name + "}" if d.spark else name), (name,))


def _region(text: Text, source: Source = V.RGBA) -> Source:
    """A region of the raster view as a source of its own."""
    return Source(lambda d: text(d).replace("{px}", f"({source.sql(d)})"), source.tables)


QUADS = Source(
    lambda d: "SELECT p_partkey AS id, 0e0 AS x0, 0e0 AS y0, 10e0 AS x1, p_size % 5 - 2e0 AS y1, 10e0 - p_size % 7 AS x2, 10e0 AS y2, p_size % 11 - 3e0 AS x3, 8e0 - p_size % 9 AS y3 FROM " + ("{part}" if d.spark else "part"), ("part",)
)
REGIONS = {"one": _region(WAND), "two": _region(ELLIPSE)}

SELECTIONS = {
    "wand_noncontiguous": Query(WAND, RGBA),
    "wand_contiguous": Query(S.wand_contiguous((1, 1), 48), RGBA),
    "color_range": Query(S.color_range([(120, 130, 125), (90, 140, 160)], [(128, 128, 128)], 30), RGBA),
    "color_range_inverted": Query(S.color_range([(120, 130, 125)], [], 40, True), RGBA),
    "mask_dark": Query(S.threshold("dark"), GREY),
    "mask_white": Query(S.threshold("white"), GREY),
    "opaque_pixels": Query(S.opaque(), RGBA),
    "rotated_hit_test": Query(S.inside_rotated((2, 2), (3, 1.5), 33), RGBA),
    "ellipse_selection": Query(ELLIPSE, RGBA),
    "polygon_selection": Query(POLYGON, RGBA),
    "selection_union": Query(S.union(), REGIONS),
    "selection_subtract": Query(S.subtract(), REGIONS),
    "selection_intersect": Query(S.intersect(), REGIONS),
    "selection_inverse": Query(S.inverse(), {"px": V.RGBA, "one": REGIONS["one"]}),
    "selection_moved": Query(S.moved(2, -1), {"one": REGIONS["one"]}),
    "selection_expanded": Query(S.expanded(1.5, 4, 4), {"one": REGIONS["one"]}),
    "selection_outline": Query(S.outline(), {"one": REGIONS["one"]}),
    "masked_write_back": Query(S.blended_by_coverage(A.invert(), ELLIPSE), RGBA),
    "quad_convexity": Query(S.convexity(), {"quads": QUADS}),
    "selected_count": Query(G.selected_count(WAND), RGBA),
}
STATISTICS = {
    "levels_histogram": Query(G.histogram(), RGBA),
    "levels_histogram_total": Query(G.total_histogram(), RGBA),
    "auto_levels_endpoints": Query(G.auto_levels(), RGBA),
    "auto_levels_gamma": Query(G.neutral_gamma(), RGBA),
    "histogram_display_scale": Query(G.display_scale(), RGBA),
    "vectorscope": Query(G.vectorscope(), RGBA),
    "gray_world": Query(G.grey_world(), RGBA),
    "white_balance": Query(G.white_balance(), RGBA),
    "alpha_bounds": Query(G.bounds(), RGBA),
    "coverage_bounds": Query(G.bounds("v >= 140"), GREY),
    "trim_rect": Query(G.trim(12), RGBA),
    "trim_rect_edges": Query(G.trim(12, (True, False, True, False)), RGBA),
    "cell_mean_tone": Query(G.cell_means(2), RGBA),
    "block_average": Query(G.block_average(2), RGBA),
    "mask_background": Query(G.mask_background(), GREY),
    "glyph_match": Query(G.glyph_match(), RGBA),
    "running_budget": Query(G.running_budget(900_000), {"orders": _table("orders")}),
}
WINDOWS = {
    "box_blur_replicated": Query(N.box_blur(3), GREY),
    "gaussian_blur": Query(N.gaussian_blur(1.2), GREY),
    "layer_blur": Query(N.gaussian_blur(1.0, "zero"), GREY),
    "sliding_max": Query(N.sliding("max", 2), GREY),
    "sliding_min": Query(N.sliding("min", 1), GREY),
    "dilate_stroke_ring": Query(N.stroke_ring(1), GREY),
    "erode_stroke_ring": Query(N.stroke_ring(1, True), GREY),
    "binary_dilate": Query(N.binary_morphology("dilate", 1), GREY),
    "binary_erode": Query(N.binary_morphology("erode", 2), GREY),
    "prefix_sums": Query(N.prefix_sums(), GREY),
    "edge_strength": Query(N.edge_strength(), GREY),
    "sharpen": Query(N.sharpen(0.8, 1, 12), GREY),
    "texture_clarity": Query(N.local_contrast(40, 25), GREY),
    "glow": Query(N.glow(50), GREY),
    "tonal_contrast": Query(N.tonal_contrast(40), GREY),
    "guided_filter": Query(N.guided(2, 0.01), GREY),
    "matte_contrast": Query(N.matte(30, 10), GREY),
    "feather": Query(N.feather(S.threshold("white"), 2), GREY),
    "drop_shadow": Query(N.shape_effect("drop_shadow", 2, 1, 1), GREY),
    "inner_shadow": Query(N.shape_effect("inner_shadow", 2, 1, 0), GREY),
    "outer_glow": Query(N.shape_effect("outer_glow", 3), GREY),
    "inner_glow": Query(N.shape_effect("inner_glow", 2), GREY),
}
COMPOSITES = {
    "blend_modes": Query(C.blend_table(), {}),
    **{f"blend_{m.lower()}": Query(C.component_blend(m), {"px": V.RGBA, "over": V.RGBA}) for m in C.COMPONENT},
    "flatten": Query(C.flatten(), BOTH),
    "flatten_masked": Query(C.flatten(True), BOTH),
    "over_fold": Query(C.over_fold(), {"lineitem": _table("lineitem")}),
    "point_query": Query(C.point_query(3, 4, 5), BOTH),
    "merge_down": Query(C.merged_down(6), BOTH),
    "clipping_stacks": Query(C.clipping_stacks(), {"layers": V.LAYERS}),
    "adjustment_layers": Query(C.adjusted_fold(), BOTH),
    "jpeg_matte": Query(C.matte((255, 240, 200)), RGBA),
    "effect_margin": Query(C.effect_margin(), {"layers": V.LAYERS}),
    "shadow_offset": Query(C.shadow_offset(), {"layers": V.LAYERS}),
}
TREE, LAYERS, HEAT = {"tree": V.TREE}, {"layers": V.LAYERS}, {"heat": V.HEAT}
#: The tree with rows that break each rule.
BAD_TREE = Source(
    lambda d: V.TREE.sql(d) + " UNION ALL SELECT 'R1', NULL, true, 1, 1e0, true UNION ALL SELECT 'X1', 'nowhere', false, 2, 1e0, true UNION ALL SELECT 'X2', 'C5', false, 3, 1e0, true UNION ALL SELECT 'Y1', 'Y2', true, 4, 1e0, true UNION ALL SELECT 'Y2', 'Y1', true, 5, 1e0, true",
    V.TREE.tables,
)
TREES = {
    "tree_effective_opacity": Query(R.effective_opacity(), TREE, T.effective_opacity),
    "visible_leaves": Query(R.visible_leaves(), TREE, T.visible_leaves),
    "depth_first_order": Query(R.depth_first(), TREE, T.depth_first),
    "descendants": Query(R.descendants("R2"), TREE, lambda t: T.descendants(t, "R2")),
    "lowest_common_folder": Query(R.common_folder(("N0", "N5", "N10")), TREE, lambda t: T.common_folder(t, ("N0", "N5", "N10"))),
    "topmost_selected": Query(R.topmost_selected(("R1", "N3", "C7", "C20", "N8")), TREE, lambda t: T.topmost_selected(t, ("R1", "N3", "C7", "C20", "N8"))),
    "siblings": Query(R.siblings(), TREE),
    "tree_violations": Query(R.violations(), {"tree": BAD_TREE}, T.violations),
    "folder_mask_product": Query(R.folder_mask_product(), TREE, T.folder_mask_product),
    "live_mask_chain": Query(R.mask_chain(), LAYERS, T.mask_chain),
    "subtree_copy": Query(R.remapped_copy("N5"), TREE, lambda t: T.subtree_copy(t, "N5")),
    "snap_nearest": Query(R.snap_nearest(6), HEAT),
    "rect_overlap_join": Query(R.overlapping_boxes(), {"part": _table("part")}),
    "patch_replacement": Query(R.patched(), GREY),
    "missing_assets": Query(R.missing_assets(), BOTH),
    "next_free_name": Query(R.next_free_name(), LAYERS),
    "layer_reorder": Query(R.reordered(), LAYERS),
    "nearest_patch_score": Query(R.nearest_patch(), GREY),
}
GEOMETRY = {
    "flip_horizontal": Query(M.flip(True), RGBA),
    "flip_vertical": Query(M.flip(False), RGBA),
    "lens_distortion": Query(M.lens_distortion(0.2), RGBA),
    "subpixel_shift": Query(M.shifted(0.5, 0.25), RGBA),
    "affine_nearest": Query(M.affine(M.placed((2, 2), (5, 4.5), 30, (True, False), 4, 4)), RGBA),
    "affine_bilinear": Query(M.affine(M.placed((2.1, 1.9), (4.5, 3.7), -20, (False, False), 4, 4), False), RGBA),
    "perspective_warp": Query(M.perspective([(0.3, 0.2), (3.8, 0.5), (3.5, 3.9), (0.1, 3.4)]), RGBA),
    "chromatic_shift": Query(M.chromatic(0.45), RGBA),
    "clone_stamp": Query(M.clone_stamp(1, -1, ELLIPSE), RGBA),
    "lift_and_move": Query(M.lifted(1, 1, ELLIPSE), RGBA),
    "lift_and_copy": Query(M.lifted(-1, 0, ELLIPSE, True), RGBA),
    "thumbnail": Query(M.thumbnail(), RGBA),
    "mip_level": Query(M.mip_level(), {"part": _table("part")}),
    "canvas_offset": Query(M.canvas_offset((0.5, 1), (15, 8)), LAYERS),
    "guides": Query(M.guides(5, 1.5, 200), LAYERS),
    "grid_lines": Query(M.grid_lines(500, 12.5, 4), {}),
    "brush_coverage": Query(M.brush_coverage(), {"grey": V.GREY}),
    "dab_spacing": Query(M.dab_spacing(75), HEAT),
    "chaikin": Query(M.chaikin(), {"grey": V.GREY}),
    "catmull_rom": Query(M.catmull_rom(), HEAT),
}
RECORDS = {
    "hex_colours": Query(X.hex_colours(), RGBA),
    "parsed_colours": Query(X.parsed_colours(), RGBA),
    "layer_names": Query(X.layer_names(), {"documents": _table("documents")}),
    "valid_names": Query(X.valid_names(), {"documents": _table("documents")}),
    "blend_keys": Query(X.blend_keys(), {"orders": _table("orders")}),
    "dimensions": Query(X.dimensions(), {"orders": _table("orders")}),
    "manifest_violations": Query(X.manifest_violations(), LAYERS),
    "package_digest": Query(X.package_digest(), LAYERS),
    "debounce": Query(X.debounced(3600), HEAT),
    "distinct_until_changed": Query(X.changed_only(), HEAT),
    "foreign_changes": Query(X.foreign_changes(), HEAT),
    "latest_wins": Query(X.latest_wins(), HEAT),
    "transactions": Query(X.transactions(), HEAT),
    "history_cap": Query(X.history_cap(), HEAT),
    "retained_once": Query(X.retained_once(), HEAT),
    "backoff": Query(X.backoff(), HEAT),
    "heat_histogram": Query(X.heat_histogram(), HEAT),
    "text_runs": Query(X.text_runs(), {"conversations": _table("conversations")}),
}
EDITS = {
    "levels_eyedropper_black": Query(E.levels_eyedropper("black"), RGBA),
    "levels_eyedropper_white": Query(E.levels_eyedropper("white"), RGBA),
    "levels_eyedropper_grey": Query(E.levels_eyedropper("grey", 10, 240), RGBA),
    "hue_band_moved": Query(E.hue_band_moved(), HEAT),
    "hue_band_weight": Query(E.hue_weights(), HEAT),
    "saturation_law": Query(E.saturation_law(40), HEAT),
    "curve_nudge": Query(E.curve_nudged(), HEAT),
    "segment_tile_cover": Query(E.tile_cover(), HEAT),
    "largest_halo": Query(E.largest_halo(), LAYERS),
    "unit_conversion": Query(E.units(), {"part": _table("part")}),
    "detached_clips": Query(E.detached_clips(), LAYERS),
    "digit_pairs": Query(E.digit_pairs(), HEAT),
    "homography": Query(E.homography_columns(), {"quads": QUADS}),
}

DETAIL = {
    "scanlines": Query(D.scanlines(), RGBA),
    "scanlines_plain": Query(D.scanlines(2, 0, 0, (0, 0, 0), (255, 255, 255)), RGBA),
    "colour_noise": Query(D.colour_noise(60), RGBA),
    "sharpened": Query(D.sharpened(120), RGBA),
    "sharpen_overlay": Query(D.sharpen_overlay(), RGBA),
    "glow_added": Query(D.glow_added(40), RGBA),
    "effects_in_order": Query(D.effects_in_order(), RGBA),
    "cleared_selection": Query(D.cleared(), RGBA),
    "copy_merged": Query(D.copied_merged(), BOTH),
    "ring_statistics": Query(D.ring_statistics(), GREY),
    "mixer_weights": Query(D.mixer_weights(), RGBA),
    "hsb_kept": Query(D.hsb_kept(), RGBA),
    "sampled_hue": Query(D.sampled_hue(1, 2), RGBA),
}
PLACEMENT = {
    "sampling_policy": Query(P.sampling_policy(), LAYERS),
    "drag_box": Query(P.drag_box(), HEAT),
    "grown_for_blur": Query(P.grown_for_blur(), LAYERS),
    "radii": Query(P.radii(), HEAT),
    "random_steps": Query(P.random_steps(), HEAT),
    "curve_points": Query(P.curve_points(), HEAT),
    "dirty_union": Query(P.dirty_union(), HEAT),
    "following": Query(P.following(), LAYERS),
    "mask_link_violations": Query(P.mask_link_violations(), LAYERS, P.mask_link_frames),
    "undo_redo": Query(P.history(), HEAT),
}

#: A soft ellipse on each canvas.
SPOT = Source(
    lambda d: f"SELECT document_id, y, x, greatest(0e0, least(1e0, 1.4e0 - ((x - 3.5e0) * (x - 3.5e0) + (y - 3e0) * (y - 3e0)) / 9e0)) AS c FROM (SELECT document_id, y, {d.explode(d.series('0', '7'), 'x')} FROM (SELECT document_id, {d.explode(d.series('0', '6'), 'y')} FROM ({V.SCENE['canvases'].sql(d)}) c) r) p",
    ("embeddings",),
)
SCENES = {
    "scene_flatten": Query(OS.flattened(), V.SCENE, O.flattened),
    "scene_merged": Query(OS.merged("layer_id % 4 <> 3"), V.SCENE, lambda layers, *rest: O.merged(layers.selectExpr("*", "layer_id % 4 <> 3 AS selected"), *rest)),
    "scene_copied": Query(OS.copied(), V.SCENE | {"selection": SPOT}, lambda layers, pixels, masks, canvases, selection: O.copied(layers, pixels, canvases, selection)),
}

#: Users' events are the points of strokes, six of each, with tips of all kinds; each stroke has a canvas.
STROKES = {
    "points": Source(
        lambda d: f"SELECT user_id * 1000 + CAST({d.div('k - 1', '6')} AS BIGINT) AS stroke_id, k AS seq, hour(ts) * 1.3e0 AS x, value / 20e0 AS y, 0.8e0 + user_id % 5 AS radius, CASE WHEN user_id % 4 = 0 THEN 1e0 ELSE (user_id % 10) / 11e0 END AS hardness, k % 6 = 0 AS tail "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {'{events}' if d.spark else 'events'} e) q",
        ("events",),
    ),
    "canvases": Source(
        lambda d: f"SELECT DISTINCT user_id * 1000 + CAST({d.div('k - 1', '6')} AS BIGINT) AS stroke_id, 32 AS width, 26 AS height FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM {'{events}' if d.spark else 'events'} e) q",
        ("events",),
    ),
}
SIZES = Source(lambda d: f"SELECT DISTINCT image_id, 8 AS height, 8 AS width FROM ({V.GREY.sql(d)}) g", ("embeddings",))
SMALL = Source(lambda d: f"SELECT DISTINCT image_id, 4 AS height, 4 AS width FROM ({V.RGBA.sql(d)}) g", ("embeddings",))
#: The rasters after a change of some pixels of every third.
TOUCHED = Source(lambda d: f"SELECT image_id, y, x, CASE WHEN image_id % 3 = 0 AND y < 2 AND x = 6 THEN 255 - v ELSE v END AS v FROM ({V.GREY.sql(d)}) g", ("embeddings",))
SEEDS = Source(lambda d: f"SELECT DISTINCT image_id, 1 AS y, 1 AS x FROM ({V.RGBA.sql(d)}) g", ("embeddings",))
#: Orders are files of their customers' queues.
FILES = Source(
    lambda d: "SELECT o_custkey AS queue_id, o_orderkey AS seq, CAST(o_orderkey % 977 * 37 AS BIGINT) AS width, CAST(floor(o_totalprice / 40e0) AS BIGINT) AS height, CASE WHEN o_orderstatus = 'P' THEN 'damaged' END AS error FROM " + ("{orders}" if d.spark else "orders"),
    ("orders",),
)
_UNITS = "CAST(length(text) AS BIGINT)"
RUNS = Source(
    lambda d: f"SELECT conv_id * 1000 + turn AS text_id, CAST(i * 40 AS BIGINT) AS start, least(40, {_UNITS} - i * 40) AS length, concat('font', i % 2) AS font, concat('', 10 + i % 3) AS size, 'black' AS colour FROM (SELECT *, {d.explode(d.series('0', 'CAST(floor((length(text) - 1) / 40e0) AS BIGINT)'), 'i')} FROM {'{conversations}' if d.spark else 'conversations'} c WHERE length(text) > 0) r",
    ("conversations",),
)
STYLINGS = Source(
    lambda d: f"SELECT conv_id * 1000 + turn AS text_id, CAST(k AS BIGINT) AS seq, (k * 37 + turn * 11 + conv_id * 5) % (length(text) + 9) - 4 AS first, (k * 37 + turn * 11 + conv_id * 5) % (length(text) + 9) + (k * 29 + conv_id) % 90 - 12 AS last, CASE k % 3 WHEN 0 THEN 'font' WHEN 1 THEN 'size' ELSE 'colour' END AS attribute, "
    f"CASE k % 3 WHEN 0 THEN concat('font', k % 2) WHEN 1 THEN concat('', 10 + k % 4) ELSE 'red' END AS value FROM (SELECT *, {d.explode(d.series('0', '11'), 'k')} FROM {'{conversations}' if d.spark else 'conversations'} c WHERE length(text) > 0) r",
    ("conversations",),
)

TURNS = Source(lambda d: f"SELECT conv_id * 1000 + turn AS id, text FROM {'{conversations}' if d.spark else 'conversations'} c WHERE length(text) > 0", ("conversations",))
VECTORS = Source(lambda d: f"SELECT vec_id AS id, embedding FROM {'{embeddings}' if d.spark else 'embeddings'} e WHERE vec_id IS NOT NULL AND embedding IS NOT NULL", ("embeddings",))
#: Layer records of packages with fields that break each rule, by their ids.
MANIFESTS = Source(
    lambda d: "SELECT *, CASE WHEN isGroup IS NULL THEN CASE WHEN layer_id % 31 = 5 THEN 'other.png' ELSE concat(id, '.png') END END AS imageFile FROM (SELECT layer_id, concat('p', document_id) AS package, CAST(1 + document_id % 13 AS INT) AS version, CAST(CASE WHEN document_id % 17 = 3 THEN 0 ELSE 800 END AS INT) AS width, 600 AS height, place AS z, "
    "concat('L', CASE WHEN layer_id % 53 = 7 THEN layer_id - 1 ELSE layer_id END) AS id, CASE WHEN layer_id % 29 = 4 THEN '  ' WHEN layer_id % 23 <> 6 THEN concat('Layer ', layer_id) END AS name, CASE WHEN is_group THEN true END AS isGroup, "
    "CASE WHEN layer_id % 37 = 3 THEN 1.5e0 WHEN layer_id % 5 <> 0 THEN opacity END AS opacity, CASE WHEN layer_id % 41 = 9 THEN 'nowhere' WHEN layer_id % 41 = 10 THEN concat('L', layer_id) WHEN parent_id IS NOT NULL THEN concat('L', parent_id) END AS parentID, "
    f"CASE WHEN mask_source IS NOT NULL THEN concat('L', mask_source) END AS maskSourceID FROM ({V.SCENE['layers'].sql(d)}) l) r",
    ("embeddings",),
)


def _package_rules(d) -> str:
    """The rules of packages over records as they were written."""
    r = "(SELECT * FROM {records} q WHERE version <= 11)"
    since = {"isGroup": 2, "opacity": 3, "maskSourceID": 5}
    rules = [
        f"SELECT package, 'size' AS rule, package AS id FROM (SELECT DISTINCT package, width FROM {r} a) b WHERE width < 1",
        f"SELECT package, 'opacity', id FROM {r} a WHERE opacity < 0 OR opacity > 1",
        f"SELECT package, 'repeated id', id FROM {r} a GROUP BY package, id HAVING count(*) > 1",
        f"SELECT package, 'file name', id FROM {r} a WHERE imageFile <> concat(id, '.png')",
        f"SELECT package, 'name', id FROM {r} a WHERE name IS NULL OR trim(name) = ''",
        f"SELECT a.package, 'parent', a.id FROM {r} a LEFT JOIN {r} b ON b.package = a.package AND b.id = a.parentID WHERE a.parentID IS NOT NULL AND b.isGroup IS NULL",
        *[f"SELECT package, '{f} before {v}', id FROM {r} a WHERE version < {v} AND {f} IS NOT NULL" for f, v in since.items()],
    ]
    return " UNION ALL ".join(rules)


def _tiled(px, sizes):
    return I.to_pixels(I.spatial(I.to_tiles(px, sizes, 5), I.box_mean(3), 3, 5)).selectExpr("image_id", "y", "x", "round(v, 6) AS v")


def _recomputed(px, touched, sizes):
    before, after = (staged(I.to_tiles(p, sizes, 4)) for p in (px, touched))
    results = I.spatial(before, I.box_mean(1), 1, 4)
    return I.to_pixels(I.recomputed(results, after, I.changed_tiles(before, after), I.box_mean(1), 1, 4)).selectExpr("image_id", "y", "x", "round(v, 6) AS v")


PIECES = {
    "brush_strokes": Query(W.painted_sql(), STROKES, W.painted),
    "tiled_box_blur": Query(N.box_blur(3), {"px": V.GREY, "sizes": SIZES}, _tiled),
    "tiles_recomputed": Query(lambda d: N.box_blur(1)(d).replace("{px}", "{touched}"), {"px": V.GREY, "touched": TOUCHED, "sizes": SIZES}, _recomputed),
    "halved_colours": Query(Y.halved_sql(1), {"px": V.RGBA, "sizes": SMALL}, lambda px, sizes: Y.halved(px, sizes)[0]),
    "pyramid_colours": Query(Y.halved_sql(2), {"px": V.RGBA, "sizes": SMALL}, lambda px, sizes: Y.pyramid(px, sizes, 2).filter("level = 2").drop("level")),
    "pyramid_masks": Query(Y.halved_sql(2, True, 8, 8), {"px": V.GREY, "sizes": SIZES}, lambda px, sizes: Y.pyramid(px.select("image_id", "y", "x", "v"), sizes, 2, True).filter("level = 2").drop("level")),
    "region_flood": Query(S.wand_contiguous((1, 1), 48), {"px": V.RGBA, "seeds": SEEDS}, lambda px, seeds: B.flooded(px, seeds, 48, 3)),
    "import_queue": Query(U.admitted_sql(60_000_000), {"files": FILES}, lambda files: U.admitted(files, 60_000_000)),
    "text_restyled": Query(U.restyled_sql(), {"runs": RUNS, "edits": STYLINGS}, U.restyled),
    "package_violations": Query(_package_rules, {"records": MANIFESTS}, lambda records: K_.violations(K_.parsed(K_.written(records), "project"))),
    "layered_texts": Query(F.texts_sql(), {"turns": TURNS}, F.texts),
    "layered_paths": Query(F.coverage_sql(), {"vectors": VECTORS}, F.coverage),
}

QUERIES: dict[str, Query] = {name: Query(text, RGBA) for name, text in MAPS.items()} | SELECTIONS | STATISTICS | WINDOWS | COMPOSITES | TREES | GEOMETRY | RECORDS | EDITS | DETAIL | PLACEMENT | SCENES | PIECES


def _kernel(make) -> object:
    """A kernel over the grey rasters, which SQL cannot say; rows only."""
    return lambda spark, sf_dir: K.per_image(V.GREY.frame(spark, sf_dir), make()).selectExpr("image_id", "y", "x", "round(v, 4) AS v")


def _hole(plane):
    """The middle of a raster."""
    hole = plane < 0
    hole[2:5, 3:6] = True
    return hole


KERNELS = {
    "error_diffusion_floyd": _kernel(lambda: K.error_diffusion("Floyd-Steinberg")),
    "error_diffusion_atkinson": _kernel(lambda: K.error_diffusion("Atkinson", 3)),
    "heal_membrane": _kernel(lambda: K.membrane(_hole, 60)),
    "content_fill": _kernel(lambda: K.best_patch(_hole)),
    "luminance_noise": _kernel(lambda: K.luminance_noise(60, 40, 20)),
    "smudge": _kernel(lambda: K.smudge([(1, 1), (3, 2), (6, 5)], 3, 0.8)),
    "liquify": _kernel(lambda: K.liquify([(1, 1), (3, 2), (6, 5)], 3, 0.5)),
}


def queries() -> dict:
    return {name: q.spark for name, q in QUERIES.items()} | KERNELS


def oracle_sql() -> dict[str, str]:
    return {name: q.duckdb() for name, q in QUERIES.items()}
