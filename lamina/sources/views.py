"""Raster views of the driver's tables: images, grey rasters, layers, event heat and a folder tree."""

from __future__ import annotations

from lamina.plans.sql import DUCK, Dialect, Source


def _t(d: Dialect, name: str) -> str:
    return "{" + name + "}" if d.spark else name


def _byte(x: str) -> str:
    return f"CAST(greatest(0e0, least(255e0, floor(CAST({x} AS DOUBLE) * 256e0 + 128e0))) AS INT)"


def _rgba(d: Dialect) -> str:
    """4 x 4 images: four components in a row are a pixel's red, green, blue and alpha; some pixels are made opaque, some clear."""
    e = f"SELECT vec_id, embedding, {d.explode(d.series('0', '15'), 'i')} FROM {_t(d, 'embeddings')}"
    at = lambda k: _byte(d.at("embedding", f"4 * i + {k}"))
    raw = f"SELECT vec_id AS image_id, CAST(i AS INT) % 4 AS x, CAST({d.div('i', '4')} AS INT) AS y, {at(0)} AS r0, {at(1)} AS g0, {at(2)} AS b0, {at(3)} AS a0 FROM ({e}) e"
    a = "CAST(CASE WHEN (x + y) % 5 = 0 THEN 255 WHEN (image_id + x) % 7 = 0 THEN 0 ELSE a0 END AS INT)"
    pre = lambda c: f"CAST({d.div(f'{c}0 * a + 127', '255')} AS INT) AS {c}"
    return f"SELECT image_id, y, x, {pre('r')}, {pre('g')}, {pre('b')}, a FROM (SELECT *, {a} AS a FROM ({raw}) p) q"


def _grey(d: Dialect) -> str:
    """8 x 8 grey rasters."""
    e = f"SELECT vec_id, label, embedding, {d.explode(d.series('0', '63'), 'i')} FROM {_t(d, 'embeddings')}"
    return f"SELECT vec_id AS image_id, label, CAST({d.div('i', '8')} AS INT) AS y, CAST(i AS INT) % 8 AS x, {_byte(d.at('embedding', 'i'))} AS v FROM ({e}) e"


def _layers(d: Dialect) -> str:
    """A label's images within 400 ids are a document, so documents grow in number and not in size; its images are layers from the bottom up, with opacity and blend mode by id."""
    modes = ("Normal", "Multiply", "Screen", "Overlay", "Darken", "Lighten", "Difference", "Soft Light", "Hard Light", "Linear Dodge (Add)")
    cases = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(modes))
    return (
        f"SELECT label + 10 * CAST({d.div('vec_id', '400')} AS BIGINT) AS document_id, vec_id AS layer_id, CAST(row_number() OVER (PARTITION BY label, {d.div('vec_id', '400')} ORDER BY vec_id) AS INT) AS z, "
        f"CAST(1 + vec_id % 10 AS DOUBLE) / 10e0 AS opacity, CASE vec_id % 10 {cases} END AS blend_mode, vec_id % 11 <> 0 AS is_visible FROM {_t(d, 'embeddings')}"
    )


def _heat(d: Dialect) -> str:
    """Events on a plane: hour of the day and user, with their values."""
    return f"SELECT event_id, user_id, CAST(hour(ts) AS INT) AS x, CAST(user_id AS INT) AS y, event_type, value, ts FROM {_t(d, 'events')}"


def _tree(d: Dialect) -> str:
    """Folders: regions, nations and customers, with opacity and visibility by key."""
    return (
        f"SELECT concat('R', r_regionkey) AS id, CAST(NULL AS STRING) AS parent_id, true AS is_group, CAST(r_regionkey AS INT) AS place, 0.9e0 AS opacity, r_regionkey <> 3 AS visible FROM {_t(d, 'region')} "
        f"UNION ALL SELECT concat('N', n_nationkey), concat('R', n_regionkey), true, CAST(n_nationkey AS INT), 0.5e0 + CAST(n_nationkey % 5 AS DOUBLE) / 10e0, n_nationkey % 7 <> 2 FROM {_t(d, 'nation')} "
        f"UNION ALL SELECT concat('C', c_custkey), concat('N', c_nationkey), false, CAST(c_custkey AS INT), 0.25e0 + CAST(c_custkey % 4 AS DOUBLE) / 8e0, c_custkey % 5 <> 1 FROM {_t(d, 'customer')}"
    )


def _scene_layers(d: Dialect) -> str:
    """Layers of documents with places, folders (one for every four layers, each second one in the one before), clipping, live masks and adjustments, by their ids."""
    modes = ("Normal", "Darken", "Multiply", "Color Burn", "Linear Burn", "Lighten", "Screen", "Color Dodge", "Linear Dodge (Add)", "Overlay", "Soft Light", "Hard Light", "Vivid Light", "Linear Light", "Pin Light", "Hard Mix", "Difference", "Exclusion", "Subtract", "Divide", "Hue", "Saturation", "Color", "Luminosity")
    cases = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(modes))
    kind = f"CASE CAST({d.div('layer_id', '10')} AS BIGINT) % 3 WHEN 0 THEN 'Invert' WHEN 1 THEN 'Levels' ELSE 'Exposure' END"
    params = f"CASE CAST({d.div('layer_id', '10')} AS BIGINT) % 3 WHEN 1 THEN {d.array(['20e0', '220e0', '1.3e0', '10e0', '250e0'])} WHEN 2 THEN {d.array(['0.5e0', '0.01e0', '1.1e0'])} END"
    inner = f"SELECT *, CAST({d.div('(z - 1)', '4')} AS BIGINT) AS f FROM ({_layers(d)}) l"
    named = f"SELECT *, first_value(layer_id) OVER (PARTITION BY document_id, f ORDER BY z) AS base, lag(layer_id, 5) OVER (PARTITION BY document_id ORDER BY z) AS far FROM ({inner}) n"
    leaves = (
        "SELECT document_id, layer_id, -(1 + document_id * 1000 + f) AS parent_id, false AS is_group, CAST(z AS BIGINT) AS place, is_visible AS visible, opacity, "
        f"CASE layer_id % 24 {cases} END AS blend_mode, CAST(layer_id % 7 AS DOUBLE) - 1.5e0 AS ox, CAST(layer_id % 5 AS DOUBLE) - 1e0 AS oy, CAST(3 + layer_id % 4 AS DOUBLE) AS w, CAST(4 + layer_id % 3 AS DOUBLE) AS h, "
        "CAST(layer_id % 4 AS DOUBLE) * 30e0 AS rotation, layer_id % 2 = 0 AS flip_x, layer_id % 3 = 0 AS flip_y, layer_id % 4 = 1 AS nearest, 4 AS grid_w, 4 AS grid_h, layer_id % 3 = 1 AS has_mask, "
        "CASE WHEN (z - 1) % 4 IN (1, 2) AND layer_id % 3 <> 0 THEN base WHEN layer_id % 13 = 5 THEN far END AS mask_source, "
        f"CASE WHEN layer_id % 10 = 4 THEN {kind} END AS adjustment, CASE WHEN layer_id % 10 = 4 THEN {params} END AS params FROM ({named}) q"
    )
    folders = (
        "SELECT document_id, -(1 + document_id * 1000 + f) AS layer_id, CASE WHEN f % 2 = 1 THEN -(document_id * 1000 + f) END AS parent_id, true AS is_group, 4 * f + 1 AS place, f % 7 <> 6 AS visible, "
        "CAST(10 - f % 3 AS DOUBLE) / 10e0 AS opacity, 'Normal' AS blend_mode, 0.5e0 AS ox, -0.5e0 AS oy, 8e0 AS w, 8e0 AS h, CAST(f * 10 AS DOUBLE) AS rotation, false AS flip_x, false AS flip_y, false AS nearest, 4 AS grid_w, 4 AS grid_h, "
        f"f % 3 = 0 AS has_mask, CAST(NULL AS BIGINT) AS mask_source, CAST(NULL AS STRING) AS adjustment, CAST(NULL AS {'ARRAY<DOUBLE>' if d.spark else 'DOUBLE[]'}) AS params FROM (SELECT DISTINCT document_id, f FROM ({inner}) i) g"
    )
    return f"{leaves} UNION ALL {folders}"


def _scene_pixels(d: Dialect) -> str:
    return f"SELECT image_id AS layer_id, y, x, r, g, b, a FROM ({_rgba(d)}) p WHERE image_id % 10 <> 4"


def _scene_masks(d: Dialect) -> str:
    """Masks of layers are their images' alphas mirrored; those of folders are slopes."""
    return (
        f"SELECT image_id AS layer_id, y, 3 - x AS x, a AS v FROM ({_rgba(d)}) p WHERE image_id % 3 = 1 "
        f"UNION ALL SELECT layer_id, CAST({d.div('i', '4')} AS INT) AS y, CAST(i AS INT) % 4 AS x, CAST((i * 23 - layer_id * 7) % 256 AS INT) AS v FROM (SELECT layer_id, {d.explode(d.series('0', '15'), 'i')} FROM ({_scene_layers(d)}) l WHERE is_group AND has_mask) m"
    )


def _scene_canvases(d: Dialect) -> str:
    return f"SELECT DISTINCT document_id, 8 AS width, 7 AS height FROM ({_layers(d)}) l"


RGBA = Source(_rgba, ("embeddings",))
SCENE = {"layers": Source(_scene_layers, ("embeddings",)), "pixels": Source(_scene_pixels, ("embeddings",)), "masks": Source(_scene_masks, ("embeddings",)), "canvases": Source(_scene_canvases, ("embeddings",))}
GREY = Source(_grey, ("embeddings",))
LAYERS = Source(_layers, ("embeddings",))
HEAT = Source(_heat, ("events",))
TREE = Source(_tree, ("region", "nation", "customer"))
__all__ = ["DUCK", "GREY", "HEAT", "LAYERS", "RGBA", "SCENE", "TREE"]
