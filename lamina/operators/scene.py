"""The compositor: layers of any size and place, folders, masks, live masks, clipping stacks and adjustment layers, as one raster of each document.

Frames:

* ``layers`` (document_id, layer_id, parent_id, is_group, place, visible, opacity, blend_mode, ox, oy, w, h, rotation, flip_x, flip_y, nearest, grid_w, grid_h,
  has_mask, mask_source, adjustment, params): ``place`` orders siblings from the bottom up, ``ox`` to ``rotation`` place the pixel grid on the document
  (unrotated bounds, degrees clockwise about their centre), ``mask_source`` is the layer whose alpha clips this one, ``adjustment`` one of ``ADJUSTMENTS`` with its ``params``.
* ``pixels`` (layer_id, y, x, r, g, b, a): premultiplied bytes. ``masks`` (layer_id, y, x, v) in the same grid; a folder has a mask only.
* ``canvases`` (document_id, width, height).

Places of the document ask for what they sample, so only pixels that are drawn meet: each layer gives the places of its turned bounds, each place its (up to four)
neighbours in the layer's grid, and those are looked up by an equi-join. Masks of all folders above and live masks are further rasters at the same places
whose product is taken. What is drawn at a place is then folded in order by one expression: a stack's members are composed on the opaque colours
of its base, whose coverage is what shows, and the stack is blended as one when the next one begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.operators import forest
from lamina.operators.compose import COMPONENT, SEPARABLE, blended
from lamina.plans.staging import staged

ADJUSTMENTS = ("Invert", "Levels", "Exposure")
_BASE, _CLIPPED, _ADJUSTS, _ADJUSTS_STACK, _ENDS = range(5)
_RGB = ("r", "g", "b")
_PLACED = ("ox", "oy", "w", "h", "cos", "sin", "flip_x", "flip_y", "nearest", "grid_w", "grid_h")


def _let(value: str, name: str, body: str) -> str:
    """``body`` in which ``name`` stands for ``value``, taken once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _lum(k: str) -> str:
    return f"(0.3e0 * {k}r + 0.59e0 * {k}g + 0.11e0 * {k}b)"


def _spread(k: str) -> str:
    return f"(greatest({k}r, {k}g, {k}b) - least({k}r, {k}g, {k}b))"


def _stretched(k: str, c: str, other: str) -> str:
    return f"CASE WHEN {_spread(k)} > 0 THEN ({k}{c} - least({k}r, {k}g, {k}b)) * {_spread(other)} / {_spread(k)} ELSE 0e0 END"


def mixed(v: str) -> str:
    """The colour (r, g, b) of ``v`` (mode m, backdrop br, bg, bb, source sr, sg, sb; straight), by any of the 24 modes."""
    channel = lambda c: f"CASE {v}.m " + " ".join(f"WHEN '{m}' THEN {blended(m, f'{v}.b{c}', f'{v}.s{c}')}" for m in SEPARABLE) + " END"
    b, s = f"{v}.b", f"{v}.s"
    kept = lambda c: f"CASE {v}.m WHEN 'Hue' THEN {_stretched(s, c, b)} WHEN 'Saturation' THEN {_stretched(b, c, s)} WHEN 'Color' THEN {s}{c} ELSE {b}{c} END"
    light = f"CASE {v}.m WHEN 'Luminosity' THEN {_lum(s)} ELSE {_lum(b)} END"
    lit = "named_struct(" + ", ".join(f"'{c}', k.{c} + k.l - {_lum('k.')}" for c in _RGB) + ", 'l', k.l)"
    low, high = "least(n.r, n.g, n.b)", "greatest(n.r, n.g, n.b)"
    # what left the range is drawn back towards the luminosity
    inside = lambda c: f"(n.l + (n.{c} - n.l) * CASE WHEN {low} < 0 THEN n.l / (n.l - {low}) ELSE 1e0 END * CASE WHEN {high} > 1 THEN (1e0 - n.l) / ({high} - n.l) ELSE 1e0 END)"
    whole = _let("named_struct(" + ", ".join(f"'{c}', {kept(c)}" for c in _RGB) + f", 'l', {light})", "k", _let(lit, "n", "named_struct(" + ", ".join(f"'{c}', greatest(0e0, least(1e0, {inside(c)}))" for c in _RGB) + ")"))
    names = ", ".join(f"'{m}'" for m in COMPONENT)
    return f"CASE WHEN {v}.m IN ({names}) THEN {whole} ELSE named_struct(" + ", ".join(f"'{c}', {channel(c)}" for c in _RGB) + ") END"


def adjusted(kind: str, p: str, x: str) -> str:
    """An adjustment of one straight component: Levels (black, white, gamma, out black, out white in bytes), Exposure (stops, offset, gamma) in linear light, Invert."""
    at = lambda i: f"{p}[{i}]"
    unit = f"least(1e0, greatest(0e0, ({x} * 255e0 - {at(0)}) / greatest(1e-9, {at(1)} - {at(0)})))"
    levels = f"least(1e0, greatest(0e0, ({at(3)} + (({at(4)}) - ({at(3)})) * pow({unit}, 1e0 / {at(2)})) / 255e0))"
    linear = f"CASE WHEN {x} <= 0.04045e0 THEN {x} / 12.92e0 ELSE pow(({x} + 0.055e0) / 1.055e0, 2.4e0) END"
    light = f"pow(greatest(0e0, ({linear}) * pow(2e0, {at(0)}) + {at(1)}), 1e0 / {at(2)})"
    exposure = _let(light, "t", "least(1e0, greatest(0e0, CASE WHEN t <= 0.0031308e0 THEN t * 12.92e0 ELSE 1.055e0 * pow(t, 1e0 / 2.4e0) - 0.055e0 END))")
    return f"CASE {kind} WHEN 'Levels' THEN {levels} WHEN 'Exposure' THEN {exposure} ELSE 1e0 - {x} END"


def _fold(entries: str) -> str:
    """The fold of ``entries`` (kind, stack, m, r, g, b, a, adjustment, params) in order: struct (r, g, b, a), premultiplied."""
    zero = "named_struct('r', 0e0, 'g', 0e0, 'b', 0e0, 'a', 0e0, 'gr', 0e0, 'gg', 0e0, 'gb', 0e0, 'ga', 0e0, 'm', 'Normal', 'stack', -1L)"
    in_stack = f"e.kind IN ({_CLIPPED}, {_ADJUSTS_STACK})"
    composite = lambda c: f"CASE WHEN acc.a > 0 THEN least(1e0, acc.{c} / acc.a) ELSE 0e0 END"
    below = lambda c: f"CASE WHEN {in_stack} THEN acc.g{c} ELSE {composite(c)} END"
    source = lambda c: f"CASE e.kind WHEN {_CLIPPED} THEN e.{c} WHEN {_ADJUSTS} THEN {adjusted('e.adjustment', 'e.params', f'({composite(c)})')} WHEN {_ADJUSTS_STACK} THEN {adjusted('e.adjustment', 'e.params', f'acc.g{c}')} ELSE acc.g{c} END"
    given = f"named_struct('m', CASE WHEN e.kind IN ({_BASE}, {_ENDS}) THEN acc.m ELSE e.m END, " + ", ".join(f"'b{c}', {below(c)}, 's{c}', {source(c)}" for c in _RGB) + ")"
    # one colour is mixed in each step: a stack's over what is below it when it ends, a member's or an adjustment's over what it changes
    ended = "named_struct(" + ", ".join(f"'{c}', acc.ga * ((1e0 - acc.a) * acc.g{c} + acc.a * o.{c}) + acc.{c} * (1e0 - acc.ga)" for c in _RGB) + ", 'a', acc.ga + acc.a * (1e0 - acc.ga), "
    ended += ", ".join(f"'g{c}', e.{c}" for c in _RGB) + ", 'ga', e.a, 'm', e.m, 'stack', e.stack)"
    kept = ", ".join(f"'{c}', acc.{c}" for c in (*_RGB, "a"))
    member = f"named_struct({kept}, " + ", ".join(f"'g{c}', acc.g{c} + e.a * (o.{c} - acc.g{c})" for c in _RGB) + ", 'ga', acc.ga, 'm', acc.m, 'stack', acc.stack)"
    changed = "named_struct(" + ", ".join(f"'{c}', acc.{c} + e.a * (acc.a * o.{c} - acc.{c})" for c in _RGB) + ", 'a', acc.a, 'gr', 0e0, 'gg', 0e0, 'gb', 0e0, 'ga', 0e0, 'm', 'Normal', 'stack', -1L)"
    mix = _let(given, "v", mixed("v"))
    step = f"CASE WHEN {in_stack} AND acc.stack <> e.stack THEN acc ELSE {_let(mix, 'o', f'CASE WHEN {in_stack} THEN {member} WHEN e.kind = {_ADJUSTS} THEN {changed} ELSE {ended} END')} END"
    ends = f"named_struct('z', 0L, 'kind', {_ENDS}, 'stack', -1L, 'm', 'Normal', 'r', 0e0, 'g', 0e0, 'b', 0e0, 'a', 0e0, 'adjustment', CAST(NULL AS STRING), 'params', CAST(NULL AS ARRAY<DOUBLE>))"
    # an adjustment of the composite finds all stacks below it ended
    listed = f"concat(flatten(transform({entries}, e -> CASE WHEN e.kind = {_ADJUSTS} THEN array({ends}, e) ELSE array(e) END)), array({ends}))"
    return f"aggregate({listed}, {zero}, (acc, e) -> {step})"


def _snapped(t: Column) -> Column:
    """To 9 digits, in doubles: whole and half pixels are met exactly, whatever the last digits of sines."""
    return F.rint(t * 1e9) / 1e9


def _angled(layers: DataFrame) -> DataFrame:
    """Layers whose rotation's sine and cosine are taken once, before their places are made."""
    return layers.withColumns({"cos": F.cos(F.radians("rotation")), "sin": F.sin(F.radians("rotation"))})


def _turned() -> dict[str, Column]:
    """A point (px, py) of the document in a layer's own grid (gx, gy), and how much of its pixel lies within the layer's bounds."""
    c = F.col
    dx, dy = F.col("px") - (c("ox") + c("w") / 2), F.col("py") - (c("oy") + c("h") / 2)
    u, v = _snapped(c("cos") * dx + c("sin") * dy), _snapped(c("cos") * dy - c("sin") * dx)
    inside = lambda t, size: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + size / 2 - F.abs(t)))
    along = lambda t, flip, size, n: _snapped((F.when(flip, -1.0).otherwise(1.0) * t / size + 0.5) * n)
    gx, gy = along(u, c("flip_x"), c("w"), c("grid_w")), along(v, c("flip_y"), c("h"), c("grid_h"))
    hard = ((gx >= 0) & (gx < c("grid_w")) & (gy >= 0) & (gy < c("grid_h"))).cast("double")
    return {"gx": gx, "gy": gy, "within": F.when(c("nearest"), hard).otherwise(inside(u, c("w")) * inside(v, c("h")))}


def _on_document(x: Column, y: Column) -> tuple[Column, Column]:
    """The point of the document where a place (x, y) of a layer's grid lies."""
    angle = F.radians("rotation")
    away = lambda at, n, size, flip: F.when(F.col(flip), -1.0).otherwise(1.0) * (at / F.col(n) - 0.5) * F.col(size)
    u, v = away(x, "grid_w", "w", "flip_x"), away(y, "grid_h", "h", "flip_y")
    return F.col("ox") + F.col("w") / 2 + F.cos(angle) * u - F.sin(angle) * v, F.col("oy") + F.col("h") / 2 + F.sin(angle) * u + F.cos(angle) * v


def _dealt(rows: DataFrame) -> DataFrame:
    """Lines (layer_id, y) of places, dealt out before their places are made: lines are few and small, and Spark would join them into one task, which then makes all places."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "layer_id", "y")


def sampled(places: DataFrame, layers: DataFrame, grids: DataFrame, keys: list[str]) -> DataFrame:
    """``grids`` (layer_id, y, x, values) at ``places`` (``keys``, layer_id, px, py): per key and layer, the values between pixels, and ``within``."""
    return _sampled(places.join(_angled(layers).select("layer_id", *_PLACED), "layer_id"), grids, keys)


def _sampled(places: DataFrame, grids: DataFrame, keys: list[str]) -> DataFrame:
    """``sampled`` at places that know their layers' own (``_PLACED``).

    Between pixels values are bilinear, and repeat beyond the grid's edge; the nearest one is taken where a layer says so.
    """
    names = [c for c in grids.columns if c not in ("layer_id", "y", "x")]
    put = places.select(*keys, "layer_id", "nearest", "grid_w", "grid_h", *[e.alias(n) for n, e in _turned().items()]).filter("within > 0")
    # the pixel before the point on each axis, and how far the point is on from its middle
    first = lambda g: F.when(F.col("nearest"), F.floor(g)).otherwise(F.floor(F.col(g) - 0.5))
    on = lambda g: F.when(F.col("nearest"), 0.0).otherwise(F.col(g) - 0.5 - F.floor(F.col(g) - 0.5))
    put = put.select("*", first("gx").alias("_x"), first("gy").alias("_y"), on("gx").alias("_u"), on("gy").alias("_v"))
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (0, 1), (1, 1))]))
    at = lambda axis, step, n: F.greatest(F.lit(0), F.least(F.col(n) - 1, F.col(axis) + F.col(step))).cast("int")
    part = lambda t, step: F.when(F.col(step) == 1, F.col(t)).otherwise(1 - F.col(t))
    near = put.select("*", corners.alias("c")).select(*keys, "layer_id", "within", at("_y", "c.j", "grid_h").alias("_y"), at("_x", "c.i", "grid_w").alias("_x"), (part("_u", "c.i") * part("_v", "c.j")).alias("weight")).filter("weight > 0")
    met = near.join(grids.withColumnsRenamed({"y": "_y", "x": "_x"}), ["layer_id", "_y", "_x"])
    return met.groupBy(*keys, "layer_id").agg(F.first("within").alias("within"), *[F.sum(F.col("weight") * F.col(n)).alias(n) for n in names])


def _grids(layers: DataFrame, pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """All rasters with their masks, as parts of 1: (layer_id, y, x, r, g, b, a, m); folders and adjustments are opaque where their mask is."""
    with_mask = layers.filter("has_mask").select("layer_id", "is_group", "adjustment")
    own = pixels.join(layers.filter("NOT is_group AND adjustment IS NULL").select("layer_id", "has_mask"), "layer_id").join(masks.withColumnRenamed("v", "m"), ["layer_id", "y", "x"], "left")
    of_pixels = own.select("layer_id", "y", "x", *[(F.col(c) / 255.0).alias(c) for c in (*_RGB, "a")], F.when(F.col("has_mask"), F.coalesce(F.col("m") / 255.0, F.lit(0.0))).otherwise(1.0).alias("m"))
    alone = masks.join(with_mask.filter("is_group OR adjustment IS NOT NULL").select("layer_id"), "layer_id")
    return of_pixels.unionByName(alone.select("layer_id", "y", "x", *[F.lit(1.0).alias(c) for c in (*_RGB, "a")], (F.col("v") / 255.0).alias("m")))


def _places(layers: DataFrame, canvases: DataFrame) -> DataFrame:
    """Where a layer may be drawn: (document_id, layer_id, y, x, px, py) and ``_PLACED``, the pixels of its turned bounds on the canvas."""
    far = lambda a, b: (F.abs("cos") * F.col(a) + F.abs("sin") * F.col(b)) / 2 + 1
    spans = {}
    for axis, origin, size, other, limit in (("x", "ox", "w", "h", "width"), ("y", "oy", "h", "w", "height")):
        middle = F.col(origin) + F.col(size) / 2
        first, last = F.greatest(F.lit(0), F.floor(middle - far(size, other))).cast("int"), F.least(F.col(limit) - 1, F.ceil(middle + far(size, other))).cast("int")
        spans[axis] = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    rows = _dealt(_angled(layers).join(canvases, "document_id").select("document_id", "layer_id", *_PLACED, spans["x"].alias("xs"), F.explode(spans["y"]).alias("y")))
    return rows.select("document_id", "layer_id", *_PLACED, "y", F.explode("xs").alias("x")).select("*", (F.col("x") + 0.5).alias("px"), (F.col("y") + 0.5).alias("py"))


def ordered(layers: DataFrame) -> DataFrame:
    """Visible leaves with ``total`` (opacity through all folders), ``folders`` above that have masks, ``z`` in the document's order, and ``stack``.

    ``stack`` is the base's id for a base and the layers clipped to it: those that stand right above it, one after the other, in its folder.
    """
    tree = layers.select(F.col("layer_id").alias("id"), "parent_id", "is_group", "opacity", "visible", "place", "has_mask")
    step = F.array(F.struct(F.col("place").cast("long").alias("place"), F.col("id").alias("id")))
    folders = F.when(F.col("is_group") & F.col("has_mask"), F.array("id")).otherwise(F.array().cast("array<bigint>"))
    below = lambda a, b: F.concat(b, a)
    found = forest.rooted(tree, {"total": (F.col("opacity"), lambda a, b: a * b), "shown": (F.col("visible"), lambda a, b: a & b), "path": (step, below), "folders": (folders, below)})
    joined = staged(layers.join(found.withColumnRenamed("id", "layer_id"), "layer_id"))
    drawn = joined.filter("shown AND NOT is_group").withColumn("z", F.row_number().over(Window.partitionBy("document_id").orderBy("path")).cast("long"))
    head = F.when(F.col("adjustment").isNotNull() & F.col("mask_source").isNull(), -F.col("z")).otherwise(F.coalesce("mask_source", "layer_id"))
    walk = Window.partitionBy("document_id").orderBy("z")
    headed = drawn.withColumn("head", head)
    parent = F.coalesce(F.col("parent_id"), F.lit(-1))
    begins = ~(F.col("head").eqNullSafe(F.lag("head").over(walk)) & parent.eqNullSafe(F.lag(parent).over(walk)))
    runs = headed.withColumn("run", F.sum(begins.cast("int")).over(walk))
    based = runs.withColumn("base", F.first("layer_id").over(Window.partitionBy("document_id", "run").orderBy("z")))
    drawn = based.withColumn("stack", F.when(F.col("base") == F.coalesce("mask_source", "layer_id"), F.col("base"))).drop("head", "run", "base")
    hidden = joined.filter("NOT (shown AND NOT is_group)").withColumn("z", F.lit(None).cast("long")).withColumn("stack", F.lit(None).cast("long"))
    return staged(drawn.unionByName(hidden))


def live_sources(layers: DataFrame) -> DataFrame:
    """(layer_id, clip_id): all layers whose alpha clips a layer, through any chain of links, in or out of sight; members of stacks have none, nor have layers whose links go in a circle."""
    links = layers.select(F.col("layer_id").alias("id"), F.when(F.col("stack").isNull() | (F.col("stack") == F.col("layer_id")), F.col("mask_source")).alias("parent_id"))
    # a layer that is not there covers nothing, so what it clips does not show
    missing = links.select(F.col("parent_id").alias("id")).filter("id IS NOT NULL").distinct().join(links.select("id"), "id", "left_anti")
    links = links.unionByName(missing.withColumn("parent_id", F.lit(None).cast("long")))
    paths = forest.rooted(links, {"path": (F.array("id"), lambda a, b: F.concat(a, b))})
    return paths.select(F.col("id").alias("layer_id"), F.explode(F.slice("path", 2, 1 << 30)).alias("clip_id"))


def _own(samples: DataFrame, layers: DataFrame, keys: list[str]) -> DataFrame:
    """What layers show of themselves: premultiplied colours and alpha under their own mask, bounds and total opacity."""
    shown = F.col("within") * F.col("m") * F.col("total")
    return samples.join(layers.select("layer_id", "total"), "layer_id").select(*keys, "layer_id", *[(F.col(c) * shown).alias(c) for c in (*_RGB, "a")])


def entries(layers: DataFrame, pixels: DataFrame, masks: DataFrame, canvases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, y, x, z, kind, stack, m, r, g, b, a, adjustment, params): what is drawn at each place, colours straight, a with all that clips it; and the layers in order."""
    known = ordered(layers)
    live = live_sources(known)
    drawn = known.filter("z IS NOT NULL")
    folders = drawn.select("layer_id", F.explode("folders").alias("clip_id"))
    stacked = (F.col("stack").isNotNull()) & (F.col("stack") != F.col("layer_id"))
    # a stack's members are clipped with their base
    members = drawn.filter(stacked).select("layer_id")
    clips = staged(live.join(drawn.select("layer_id"), "layer_id").unionByName(folders).join(members, "layer_id", "left_anti"))
    wanted = known.join(drawn.select("layer_id").unionByName(clips.select(F.col("clip_id").alias("layer_id"))).distinct(), "layer_id")
    keys = ["document_id", "y", "x"]
    samples = _sampled(_places(wanted, canvases), _grids(layers, pixels, masks), keys)
    # a folder's opacity is in the total of what it holds, its mask is not
    totals = known.withColumn("total", F.when(F.col("is_group"), F.lit(1.0)).otherwise(F.col("total")))
    own = staged(_own(samples, totals, keys))
    # adjustments have no pixels to clip others with
    cover = own.join(known.filter("adjustment IS NULL").select("layer_id"), "layer_id").select(*keys, F.col("layer_id").alias("clip_id"), F.col("a").alias("cover"))
    held = own.join(clips, "layer_id").join(cover, [*keys, "clip_id"], "left").groupBy(*keys, "layer_id").agg(F.product(F.coalesce("cover", F.lit(0.0))).alias("cover"))
    shown = own.join(drawn.select("layer_id", "z", "stack", "blend_mode", "adjustment", "params", "mask_source"), "layer_id").join(held, [*keys, "layer_id"], "left")
    kind = F.when(F.col("adjustment").isNotNull(), F.when(stacked, _ADJUSTS_STACK).otherwise(_ADJUSTS)).otherwise(F.when(stacked, _CLIPPED).otherwise(_BASE))
    row = [*keys, "z", kind.alias("kind"), F.coalesce("stack", "layer_id").alias("stack"), F.col("blend_mode").alias("m")]
    # an adjustment that is clipped by a layer below it without being in its stack has no place of its own
    drawable = F.col("adjustment").isNull() | stacked | F.col("mask_source").isNull()
    straight = [F.when(F.col("a") > 0, F.least(F.lit(1.0), F.col(c) / F.col("a"))).otherwise(0.0).alias(c) for c in _RGB]
    return shown.filter(drawable).select(*row, *straight, (F.col("a") * F.coalesce("cover", F.lit(1.0))).alias("a"), "adjustment", "params").filter("a > 0"), drawn


def flattened(layers: DataFrame, pixels: DataFrame, masks: DataFrame, canvases: DataFrame) -> DataFrame:
    """(document_id, y, x, r, g, b, a): premultiplied bytes of each place where anything shows."""
    drawn, order = entries(layers, pixels, masks, canvases)
    stacked = F.col("stack").isNotNull() & (F.col("stack") != F.col("layer_id"))
    everywhere = order.filter("adjustment IS NOT NULL AND NOT has_mask").filter(stacked | F.col("mask_source").isNull())
    whole = everywhere.select("document_id", F.struct("z", F.when(stacked, _ADJUSTS_STACK).otherwise(_ADJUSTS).alias("kind"), F.coalesce("stack", "layer_id").alias("stack"), F.col("blend_mode").alias("m"), *[F.lit(0.0).alias(c) for c in _RGB], F.col("total").alias("a"), "adjustment", "params").alias("e"))
    lists = whole.groupBy("document_id").agg(F.collect_list("e").alias("more"))
    at = drawn.groupBy("document_id", "y", "x").agg(F.collect_list(F.struct("z", "kind", "stack", "m", *_RGB, "a", "adjustment", "params")).alias("list")).join(lists, "document_id", "left")
    sorted_ = F.array_sort(F.when(F.col("more").isNull(), F.col("list")).otherwise(F.concat("list", "more")))
    folded = at.withColumn("list", sorted_).select("document_id", "y", "x", F.expr(_fold("list")).alias("f"))
    return folded.select("document_id", "y", "x", *[F.floor(F.round(F.col(f"f.{c}") * 255, 6) + 0.5).cast("int").alias(c) for c in (*_RGB, "a")]).filter("a > 0")


def merged(layers: DataFrame, pixels: DataFrame, masks: DataFrame, canvases: DataFrame) -> DataFrame:
    """The selected layers (``selected``) flattened by themselves and cut to what they cover: rows as of ``flattened`` with the new layer's origin (ox, oy) and places in it."""
    flat = staged(flattened(layers.filter("selected OR is_group").drop("selected"), pixels, masks, canvases))
    bounds = flat.groupBy("document_id").agg(F.min("x").alias("ox"), F.min("y").alias("oy"))
    return flat.join(bounds, "document_id").select("document_id", "ox", "oy", (F.col("y") - F.col("oy")).alias("y"), (F.col("x") - F.col("ox")).alias("x"), *_RGB, "a")


def baked(layers: DataFrame, pixels: DataFrame, masks: DataFrame) -> DataFrame:
    """(layer_id, y, x, r, g, b, a): pixels of the layers with a live mask, in their own grids, with what the mask hides taken away for good; their raster masks stay apart.

    Each pixel's middle is a point of the document, where the alphas of all layers of the chain are read.
    """
    known = ordered(layers)
    live = live_sources(known.withColumn("stack", F.lit(None).cast("long")))
    targets = pixels.join(live.select("layer_id").distinct(), "layer_id").join(layers.select("layer_id", "ox", "oy", "w", "h", "rotation", "flip_x", "flip_y", "grid_w", "grid_h"), "layer_id")
    px, py = _on_document(F.col("x") + 0.5, F.col("y") + 0.5)
    points = targets.select(F.col("layer_id").alias("target"), "y", "x", px.alias("px"), py.alias("py"))
    asked = points.join(live.select(F.col("layer_id").alias("target"), F.col("clip_id").alias("layer_id")), "target")
    keys = ["target", "y", "x"]
    cover = _own(sampled(asked, known, _grids(layers, pixels, masks), keys), known, keys).select(*keys, "layer_id", F.col("a").alias("cover"))
    product = asked.select(*keys, "layer_id").join(cover, [*keys, "layer_id"], "left").groupBy(*keys).agg(F.product(F.coalesce("cover", F.lit(0.0))).alias("cover"))
    joined = pixels.join(product.withColumnRenamed("target", "layer_id"), ["layer_id", "y", "x"])
    return joined.select("layer_id", "y", "x", *[F.floor(F.round(F.col(c) * F.col("cover"), 6) + 0.5).cast("int").alias(c) for c in (*_RGB, "a")])


def copied(layers: DataFrame, pixels: DataFrame, canvases: DataFrame, selection: DataFrame) -> DataFrame:
    """(layer_id, y, x, r, g, b, a): each layer's own pixels as they lie on the document, without masks, opacity or effects, under the coverage c of ``selection`` (document_id, y, x, c)."""
    leaves = layers.filter("NOT is_group AND adjustment IS NULL")
    keys = ["document_id", "y", "x"]
    samples = _sampled(_places(leaves, canvases), pixels.select("layer_id", "y", "x", *_RGB, "a"), keys).join(selection, keys)
    shown = F.col("within") * F.col("c")
    out = samples.select("layer_id", "y", "x", *[F.floor(F.round(F.col(c) * shown, 6) + 0.5).cast("int").alias(c) for c in (*_RGB, "a")])
    return out.filter("a > 0")


def masks_in_grids(layers: DataFrame, masks: DataFrame, placements: DataFrame) -> DataFrame:
    """(layer_id, y, x, v): masks with a placement of their own (``placements``: layer_id, ox to nearest, grid_w, grid_h) in their layers' grids; outside, a mask goes on as its edge is: white if the mean of its edge pixels is at least 127.5.
    """
    at_edge = (F.col("x") == 0) | (F.col("y") == 0) | (F.col("x") == F.col("grid_w") - 1) | (F.col("y") == F.col("grid_h") - 1)
    edges = masks.join(placements.select("layer_id", "grid_w", "grid_h"), "layer_id").filter(at_edge).groupBy("layer_id").agg(F.when(F.avg("v") >= 127.5, 255.0).otherwise(0.0).alias("background"))
    grids = layers.join(placements.select("layer_id"), "layer_id").select("layer_id", "ox", "oy", "w", "h", "rotation", "flip_x", "flip_y", "grid_w", "grid_h", F.explode(F.sequence(F.lit(0), F.col("grid_h") - 1)).alias("y"))
    grids = _dealt(grids).select("*", F.explode(F.sequence(F.lit(0), F.col("grid_w") - 1)).alias("x"))
    px, py = _on_document(F.col("x") + 0.5, F.col("y") + 0.5)
    points = grids.select("layer_id", "y", "x", px.alias("px"), py.alias("py"))
    asked = points.select("layer_id", F.col("y").alias("at_y"), F.col("x").alias("at_x"), "px", "py")
    found = sampled(asked, placements, masks.select("layer_id", "y", "x", "v"), ["at_y", "at_x"])
    joined = points.select("layer_id", F.col("y").alias("at_y"), F.col("x").alias("at_x")).join(edges, "layer_id").join(found, ["layer_id", "at_y", "at_x"], "left")
    value = F.coalesce(F.col("v") * F.col("within") + F.col("background") * (1 - F.col("within")), F.col("background"))
    return joined.select("layer_id", F.col("at_y").alias("y"), F.col("at_x").alias("x"), F.floor(F.round(value, 6) + 0.5).cast("int").alias("v"))


def grown(layers: DataFrame, floats: DataFrame) -> DataFrame:
    """(layer_id, x0, y0, x1, y1): each layer's grid grown to whole pixels by what its floating raster (``floats``: layer_id and a place as of ``layers``) covers."""
    units = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0.0, 1.0) for j in (0.0, 1.0)]))
    corners = floats.select("*", units.alias("c"))
    px, py = _on_document(F.col("c.i") * F.col("grid_w"), F.col("c.j") * F.col("grid_h"))
    points = corners.select("layer_id", px.alias("px"), py.alias("py")).join(_angled(layers).select("layer_id", *_PLACED), "layer_id")
    at = _turned()
    placed = points.select("layer_id", "grid_w", "grid_h", at["gx"].alias("gx"), at["gy"].alias("gy"))
    low, high = (lambda c: F.floor(F.round(F.min(c), 6))), (lambda c: F.ceil(F.round(F.max(c), 6)))
    spans = placed.groupBy("layer_id", "grid_w", "grid_h").agg(low("gx").alias("lx"), low("gy").alias("ly"), high("gx").alias("hx"), high("gy").alias("hy"))
    return spans.select("layer_id", F.least("lx", F.lit(0)).cast("int").alias("x0"), F.least("ly", F.lit(0)).cast("int").alias("y0"), F.greatest("hx", "grid_w").cast("int").alias("x1"), F.greatest("hy", "grid_h").cast("int").alias("y1"))


def floating_merged(layers: DataFrame, pixels: DataFrame, floats: DataFrame, floating: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Floating rasters (``floats``, ``floating`` pixels, both by layer_id) drawn onto their layers' own grids, which grow by what they cover: the layers so placed, and their pixels.

    The grown layer lies where the old one did: its size grows with its grid, and its middle is that of the grown grid.
    """
    spans = staged(grown(layers, floats))
    joined = layers.join(spans, "layer_id")
    lines = joined.select("*", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"))
    grid = _dealt(lines).withColumnRenamed("y", "at_y").select("*", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("at_x"))
    px, py = _on_document(F.col("at_x") + 0.5, F.col("at_y") + 0.5)
    points = grid.select("layer_id", "at_y", "at_x", px.alias("px"), py.alias("py"))
    over = sampled(points, floats, floating.select("layer_id", "y", "x", *_RGB, "a"), ["at_y", "at_x"])
    top = over.select("layer_id", F.col("at_y").alias("y"), F.col("at_x").alias("x"), *[(F.col(c) * F.col("within")).alias(f"{c}_") for c in (*_RGB, "a")])
    below = pixels.join(spans.select("layer_id"), "layer_id", "left_semi").select("layer_id", "y", "x", *_RGB, "a")
    both = below.join(top, ["layer_id", "y", "x"], "full").join(spans, "layer_id")
    value = lambda c: F.coalesce(f"{c}_", F.lit(0.0)) + F.coalesce(c, F.lit(0)) * (1 - F.coalesce("a_", F.lit(0.0)) / 255)
    out = both.select("layer_id", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *[F.floor(F.round(value(c), 6) + 0.5).cast("int").alias(c) for c in (*_RGB, "a")])
    cx, cy = _on_document((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2)
    wide, high = (F.col("x1") - F.col("x0")) * F.col("w") / F.col("grid_w"), (F.col("y1") - F.col("y0")) * F.col("h") / F.col("grid_h")
    new = {"ox": cx - wide / 2, "oy": cy - high / 2, "w": wide, "h": high, "grid_w": F.col("x1") - F.col("x0"), "grid_h": F.col("y1") - F.col("y0")}
    placed = joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in layers.columns])
    return placed, out.filter("a > 0")
