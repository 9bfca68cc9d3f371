"""What layered files keep beside pixels: text, vector paths and adjustments, from the additional blocks of layer records.

Binary blocks are read by small recursive readers in Arrow batches; a block that is damaged gives a row with ``error`` and never stops a job. Paths go on as rows: Bezier
knots are flattened and scan-converted by joins, windows and sums.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.sources.psd import _Cursor

#: How many items a descriptor or list may have, and bytes a block.
MOST_ITEMS, MOST_BYTES, MOST_TEXT = 10_000, 8_000_000, 100_000
#: Bytes and rows that are opened as Python's own values at once; a row of more goes by itself.
OPENED_BYTES, OPENED_ROWS = 1 << 20, 512
#: Identifiers of blocks, by kind.
TEXT_BLOCKS, PATH_BLOCKS = ("TySh", "tySh"), ("vmsk", "vsms")
ADJUSTMENT_BLOCKS = ("levl", "curv", "hue2", "hue ")
BANDS = ("Reds", "Yellows", "Greens", "Cyans", "Blues", "Magentas")
_DEEPEST = 64


class Descriptor:
    """Reads a descriptor into dicts, lists, numbers, strings and bytes; ``ValueError`` if it is damaged."""

    def __init__(self, data: bytes, at: int = 0):
        self.c = _Cursor(data)
        self.c.at = at

    def _count(self) -> int:
        n = self.c.read("I")
        if n > MOST_ITEMS:
            raise ValueError("a descriptor has too many items")
        return n

    def unicode(self) -> str:
        n = self.c.read("I")
        if n > 1_000_000:
            raise ValueError("a string is too long")
        return self.c.take(2 * n).decode("utf-16-be", "replace")

    def name(self) -> str:
        """A length and as many letters, or four letters where the length is 0."""
        n = self.c.read("I")
        if n > MOST_ITEMS:
            raise ValueError("a name is too long")
        return self.c.take(n or 4).decode("latin-1")

    def items(self, depth: int = 0) -> dict:
        if depth > _DEEPEST:
            raise ValueError("a descriptor is nested too deeply")
        self.unicode()
        self.name()
        return {self.name(): self.value(depth) for _ in range(self._count())}

    def versioned(self) -> dict:
        if self.c.read("I") != 16:
            raise ValueError("unknown version of a descriptor")
        return self.items()

    def _reference(self) -> None:
        for _ in range(self._count()):
            form = self.c.take(4)
            if form in (b"Idnt", b"indx"):
                self.c.take(4)
                continue
            self.unicode()
            # how many names follow, and whether a number ends it
            names = {b"prop": 2, b"Clss": 1, b"Enmr": 3, b"rele": 1, b"name": 0}.get(form)
            if names is None:
                raise ValueError("an unknown reference")
            for _ in range(names):
                self.name()
            if form == b"rele":
                self.c.take(4)

    def value(self, depth: int = 0):
        kind = self.c.take(4)
        if kind == b"doub":
            return self.c.read("d")
        if kind == b"UntF":
            self.c.take(4)
            return self.c.read("d")
        if kind == b"long":
            return self.c.read("i")
        if kind == b"comp":
            return self.c.read("q")
        if kind == b"bool":
            return bool(self.c.read("B"))
        if kind == b"TEXT":
            return self.unicode()
        if kind == b"enum":
            self.name()
            return self.name()
        if kind in (b"tdta", b"alis"):
            n = self.c.read("I")
            if n > MOST_BYTES:
                raise ValueError("data is too long")
            return self.c.take(n)
        if kind in (b"Objc", b"GlbO"):
            return self.items(depth + 1)
        if kind == b"VlLs":
            return [self.value(depth + 1) for _ in range(self._count())]
        if kind == b"obj ":
            self._reference()
            return None
        if kind in (b"type", b"GlbC"):
            self.unicode()
            self.name()
            return None
        raise ValueError(f"unknown kind of item {kind!r}")


_TOKEN = re.compile(rb"\s*(?:%[^\r\n]*\s*)*(?:(<<)|(>>)|(\[)|(\])|/([^\x00-\x20/<>\[\]()]*)|(<[^>]*>)|(\((?:[^\\()]|\\[\s\S])*\))|([-+.0-9][-+.0-9eE]*)|(true|false|null)(?=[\x00-\x20/<>\[\]()]|$))")


def _spelled(raw: bytes) -> str:
    """A string of the engine's dictionary: escapes undone, UTF-16 behind its mark, Latin-1 else."""
    octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() and m[1][:1] < b"8" else {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"\n": b"", b"\r": b""}.get(m[1], m[1])
    data = re.sub(rb"\\([0-7]{1,3}|[\s\S])", octal, raw)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("latin-1")


def engine(data: bytes):
    """The text engine's dictionary as dicts, lists, numbers, strings and truths."""
    at = data.find(b"<<")
    if at < 0:
        raise ValueError("there is no dictionary")
    open_: list = []
    while True:
        token = _TOKEN.match(data, at)
        if token is None:
            raise ValueError("the dictionary is damaged")
        at = token.end()
        kind = token.lastindex
        if kind in (1, 3):
            if len(open_) >= _DEEPEST:
                raise ValueError("the dictionary is nested too deeply")
            open_.append(({} if kind == 1 else [], []))
            continue
        if kind == 5 and isinstance(open_[-1][0], dict) and not open_[-1][1]:
            open_[-1][1].append(token[5].decode("latin-1"))
            continue
        if kind in (2, 4):
            value, waiting = open_.pop()
            if isinstance(value, dict) != (kind == 2) or waiting:
                raise ValueError("the dictionary is damaged")
            if not open_:
                return value
        elif kind == 5:
            value = token[5].decode("latin-1")
        elif kind == 6:
            value = _spelled(bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", token[6]).decode()[: len(re.sub(rb"[^0-9A-Fa-f]", b"", token[6])) // 2 * 2]))
        elif kind == 7:
            value = _spelled(token[7][1:-1])
        elif kind == 8:
            value = float(token[8])
        else:
            value = {b"true": True, b"false": False}.get(token[9], "")
        holder, waiting = open_[-1]
        if isinstance(holder, list):
            holder.append(value)
        elif waiting:
            holder[waiting.pop()] = value
        else:
            raise ValueError("the dictionary is damaged")


def at_path(value, *keys):
    """The value below keys of dicts and places of lists, or None."""
    for k in keys:
        if isinstance(value, dict):
            value = value.get(k)
        elif isinstance(value, list) and isinstance(k, int) and k < len(value):
            value = value[k]
        else:
            return None
    return value


def _unit(v: float) -> float:
    return min(255.0, max(0.0, v)) / 255 if v > 1 else min(1.0, max(0.0, v))


def _colour(values) -> list[float]:
    numbers = [v for v in values or [] if isinstance(v, float)]
    if len(numbers) >= 3:
        return [_unit(v) for v in (numbers[1:4] if len(numbers) >= 4 else numbers)]
    return [_unit(numbers[0])] * 3 if numbers else [0.0] * 3


TEXT_ROW = (
    "text string, font string, size double, red double, green double, blue double, tracking double, leading double, alignment string, rotation double, flip_y boolean, "
    "anchor_x double, anchor_y double, box_width double, box_height double, runs array<struct<start:int,length:int,font:string,size:double,red:double,green:double,blue:double>>, notes array<string>"
)


def text_of(block: bytes) -> dict | None:
    """A text layer's words, first style, runs and place; None if it is none that can be retyped (vertical, sheared, unevenly scaled)."""
    if len(block) > MOST_BYTES:
        return None
    c = _Cursor(block)
    if c.read("H") != 1:
        raise ValueError("unknown version of a text block")
    xx, xy, yx, yy, tx, ty = (c.read("d") for _ in range(6))
    if not all(map(math.isfinite, (xx, xy, yx, yy, tx, ty))) or c.read("H") != 50:
        raise ValueError("a text block is damaged")
    reader = Descriptor(block, c.at)
    words = reader.versioned()
    scale = math.hypot(xx, yx)
    if words.get("Ornt") == "Vrtc" or scale <= 1e-6:
        return None
    cos, sin = xx / scale, yx / scale
    across, down = cos * xy + sin * yy, -sin * xy + cos * yy
    if abs(down) <= 1e-6 or max(abs(across), abs(scale - abs(down))) > 0.02 * max(scale, abs(down)):
        return None
    notes = []
    if len(block) - reader.c.at >= 2 and reader.c.read("H") == 1:
        try:
            if reader.versioned().get("warpStyle") not in (None, "warpNone", "none"):
                notes.append("warp omitted")
        except ValueError:
            pass
    raw = words.get("EngineData")
    style = engine(raw) if isinstance(raw, bytes) else None
    text = words.get("Txt ", words.get("Txt")) or at_path(style, "EngineDict", "Editor", "Text") or ""
    text = text.lstrip("\ufeff\0").rstrip("\0").replace("\r\n", "\n").replace("\r", "\n")
    units = len(text.encode("utf-16-le")) // 2
    if not text or units > MOST_TEXT:
        return None
    fonts = [at_path(f, "Name") for f in at_path(style, "ResourceDict", "FontSet") or []]

    def sheet(run) -> dict:
        data = at_path(run, "StyleSheet", "StyleSheetData") or {}
        i = data.get("Font", 0.0)
        size = data.get("FontSize", 12.0)
        r, g, b = _colour(at_path(data, "FillColor", "Values"))
        return {"font": fonts[round(i)] if isinstance(i, float) and 0 <= round(i) < len(fonts) else None, "size": min(2000.0, max(1.0, size * scale)), "red": r, "green": g, "blue": b}

    listed = at_path(style, "EngineDict", "StyleRun", "RunArray") or []
    lengths = [int(n) for n in at_path(style, "EngineDict", "StyleRun", "RunLengthArray") or []]
    runs, start = [], 0
    for i, run in enumerate(listed):
        n = min(lengths[i] if i < len(lengths) else units - start, units - start)
        runs.append({"start": start, "length": n, **sheet(run)})
        start += n
    first = at_path(listed, 0, "StyleSheet", "StyleSheetData") or {}
    own = sheet(listed[0]) if listed else {"font": None, "size": min(2000.0, max(1.0, 12 * scale)), "red": 0.0, "green": 0.0, "blue": 0.0}
    if any(sheet(r) != own for r in listed[1:]):
        notes.append("several styles")
    if first.get("FauxBold") is True or first.get("FauxItalic") is True:
        notes.append("faux style omitted")
    tracking, leading = first.get("Tracking", 0.0), first.get("Leading")
    justified = at_path(style, "EngineDict", "ParagraphRun", "RunArray", 0, "ParagraphSheet", "Properties", "Justification")
    sides = {0: "left", 1: "right", 2: "center"}
    if round(justified or 0) not in sides:
        notes.append("justified as left")
    out = {"text": text, **own, "tracking": min(1000.0, max(-100.0, tracking * own["size"] / 1000)), "leading": min(5000.0, leading * scale) if first.get("AutoLeading") is False and leading and leading > 0 else None}
    out |= {"alignment": sides.get(round(justified or 0), "left"), "rotation": math.degrees(math.atan2(sin, cos)), "flip_y": down < 0, "anchor_x": tx, "anchor_y": ty, "box_width": None, "box_height": None, "runs": runs, "notes": notes}
    side = lambda box, k: box.get(k, box.get(k.strip()))
    frame, glyphs = (words.get(k) for k in ("bounds", "boundingBox"))
    if isinstance(frame, dict) and isinstance(glyphs, dict):
        try:
            (fx, fy, fw, fh), (_, _, gw, gh) = ((side(b, "Left"), side(b, "Top "), side(b, "Rght") - side(b, "Left"), side(b, "Btom") - side(b, "Top ")) for b in (frame, glyphs))
        except TypeError:
            return out
        if fw > max(1, gw + 4) and fh > max(1, gh + 4):
            sign = math.copysign(1.0, down)
            out |= {"box_width": fw * scale, "box_height": fh * scale, "anchor_x": scale * (cos * fx - sin * sign * fy) + tx, "anchor_y": scale * (sin * fx + cos * sign * fy) + ty}
    return out


def knots_of(block: bytes) -> list[dict]:
    """Knots of all subpaths in order: subpath, seq, closed, and the incoming, own and outgoing points as parts of the canvas."""
    out, subpath, left, closed = [], -1, 0, True
    for at in range(8, len(block) - 25, 26):
        kind = struct.unpack_from(">h", block, at)[0]
        if kind in (0, 3):
            subpath, closed = subpath + 1, kind == 0
            left = struct.unpack_from(">h", block, at + 2)[0]
        elif kind in (1, 2, 4, 5) and left > 0:
            left -= 1
            fixed = struct.unpack_from(">6i", block, at + 2)
            out.append({"subpath": subpath, "seq": len(out), "closed": closed, **{k: v / (1 << 24) for k, v in zip(("in_y", "in_x", "y", "x", "out_y", "out_x"), fixed, strict=True)}})
    return out


def adjustment_of(key: str, block: bytes) -> list[dict]:
    """Settings of an adjustment layer as (kind, part, name, value) rows in order."""
    out: list[dict] = []

    def add(kind: str, part: str, **values: float) -> None:
        out.extend({"kind": kind, "part": part, "name": n, "value": float(v)} for n, v in values.items())

    if key == "levl":
        if len(block) < 292:
            raise ValueError("levels are cut off")
        for i, part in enumerate(("RGB", "Red", "Green", "Blue")):
            black, white, out_black, out_white, gamma = struct.unpack_from(">5H", block, 2 + 10 * i)
            low = min(max(black, 0), 253)
            add("Levels", part, black=low, white=min(255, max(white, low + 2)), out_black=min(out_black, 255), out_white=min(out_white, 255), gamma=min(9.99, max(0.1, gamma / 100)))
    elif key == "curv":
        c = _Cursor(block)
        c.at = 1 if block[:1] == b"\0" else 0
        if c.read("H") not in (1, 4):
            raise ValueError("unknown version of curves")
        for i in range(min(4, c.read("H"))):
            points = sorted((min(255, x), min(255, y)) for y, x in (struct.unpack(">2H", c.take(4)) for _ in range(c.read("H"))))
            if len(points) < 2:
                continue
            if points[0][0] != 0:
                points.insert(0, (0, points[0][1]))
            if points[-1][0] != 255:
                points.append((255, points[-1][1]))
            for x, y in points:
                add("Curves", ("RGB", "Red", "Green", "Blue")[i], **{str(x): y})
    else:
        if len(block) < 16:
            raise ValueError("hue and saturation are cut off")
        colorize = block[2] != 0
        three = lambda at: dict(zip(("hue", "saturation", "lightness"), struct.unpack_from(">3h", block, at), strict=True))
        add("Hue/Saturation", "Colorize" if colorize else "Master", **three(4 if colorize else 10))
        for i, band in enumerate(() if colorize else BANDS):
            at = 16 + 14 * i
            if at + 14 > len(block):
                break
            degrees = (v % 360 for v in struct.unpack_from(">4h", block, at))
            add("Hue/Saturation", band, **dict(zip(("falloff_start", "range_start", "range_end", "falloff_end"), degrees, strict=True)), **three(at + 8))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` in pieces of at most ``OPENED_ROWS`` rows and ``OPENED_BYTES``, so that what Python holds of them does not hang on how many rows a batch has."""
    todo: list[pa.RecordBatch] = []
    for batch in batches:
        todo.append(batch)
        while todo:
            piece = todo.pop()
            if piece.num_rows > 1 and (piece.num_rows > OPENED_ROWS or piece.get_total_buffer_size() > OPENED_BYTES and piece.nbytes > OPENED_BYTES):
                half = piece.num_rows // 2
                todo += [piece.slice(half), piece.slice(0, half)]
            elif piece.num_rows:
                yield piece


def _parsed(layers: DataFrame, keys: list[str], names: tuple[str, ...], schema: str, read: Callable[[str, bytes], list[dict]]) -> DataFrame:
    """Rows that ``read`` makes of the first of the blocks ``names`` of each layer (``keys``, blocks); a damaged one is a row with ``error`` alone."""
    fields = layers.select(*keys).schema
    made = pa.schema([])

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            rows: list[dict] = []
            for r in batch.to_pylist():
                own = {k: r[k] for k in keys}
                blocks = dict(r["blocks"] or [])
                key = next((n for n in names if n in blocks), None)
                if key is None:
                    continue
                try:
                    rows += [own | found | {"error": None} for found in read(key, blocks[key])]
                except (ValueError, KeyError, IndexError, TypeError, struct.error, RecursionError) as e:
                    rows.append(own | {"error": str(e) or type(e).__name__})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=made)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    whole = StructType([*fields, *StructType.fromDDL(schema), *StructType.fromDDL("error string")])
    made = to_arrow_schema(whole)
    return layers.select(*keys, "blocks").mapInArrow(parsed, whole)


def texts(layers: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each text layer of ``layers`` (``keys``, blocks map<string, binary>): ``TEXT_ROW`` and ``error``."""
    return _parsed(layers, keys, TEXT_BLOCKS, TEXT_ROW, lambda _, block: [t] if (t := text_of(block)) else [])


def knots(layers: DataFrame, keys: list[str]) -> DataFrame:
    return _parsed(layers, keys, PATH_BLOCKS, "subpath int, seq int, closed boolean, in_y double, in_x double, y double, x double, out_y double, out_x double", lambda _, block: knots_of(block))


def adjustments(layers: DataFrame, keys: list[str]) -> DataFrame:
    return _parsed(layers, keys, ADJUSTMENT_BLOCKS, "kind string, part string, name string, value double", adjustment_of)


def flattened(paths: DataFrame, keys: list[str], steps: int = 16) -> DataFrame:
    """(``keys``, x0, y0, x1, y1): ``paths`` (``keys``, width, height, and the columns of ``knots``) as short lines in pixels; each subpath ends where it began."""
    order = Window.partitionBy(*keys, "subpath").orderBy("seq")
    whole = Window.partitionBy(*keys, "subpath").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    last = F.lead("seq").over(order).isNull()
    ends = paths.select("*", *[ahead(c).alias(f"to_{c}") for c in ("in_x", "in_y", "x", "y")], last.alias("last"))
    # an open subpath is closed by a straight line, as filling asks for
    straight = F.col("last") & ~F.col("closed")
    first, second = {}, {}
    for c, size in (("x", "width"), ("y", "height")):
        first[c] = F.when(straight, F.col(c)).otherwise(F.col(f"out_{c}")) * F.col(size)
        second[c] = F.when(straight, F.col(f"to_{c}")).otherwise(F.col(f"to_in_{c}")) * F.col(size)

    def at(c: str, size: str, t: Column) -> Column:
        u = 1 - t
        return u * u * u * F.col(c) * F.col(size) + 3 * u * u * t * first[c] + 3 * u * t * t * second[c] + t * t * t * F.col(f"to_{c}") * F.col(size)

    cut = ends.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    here, there = F.col("k") / float(steps), (F.col("k") + 1) / float(steps)
    return cut.select(*keys, at("x", "width", here).alias("x0"), at("y", "height", here).alias("y0"), at("x", "width", there).alias("x1"), at("y", "height", there).alias("y1"))


def coverage(lines: DataFrame, canvases: DataFrame, keys: list[str], rows: int = 4) -> DataFrame:
    """(``keys``, y, x, c): how much of each pixel of the canvas (``keys``, width, height) the closed ``lines`` enclose, by non-zero winding.

    Each line gives its crossings with ``rows`` scan lines a pixel row; along a scan line the windings are added up from the left, and each
    stretch with winding gives the pixels that it covers their exact parts.
    """
    placed = lines.join(canvases, keys)
    low, high = F.least("y0", "y1") * rows - 0.5, F.greatest("y0", "y1") * rows - 0.5
    # scan lines s with low <= s < high, s + 0.5 being where they lie in parts of a row
    first, last = F.greatest(F.lit(0), F.ceil(low)).cast("int"), F.least(F.col("height") * rows, F.ceil(high)).cast("int") - 1
    crossed = placed.withColumn("s", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    at = F.col("x0") + ((F.col("s") + 0.5) / rows - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossings = crossed.select(*keys, "width", "s", at.alias("x"), F.when(F.col("y1") > F.col("y0"), 1).otherwise(-1).alias("turn"))
    line = Window.partitionBy(*keys, "s").orderBy("x", "turn")
    spans = crossings.select("*", F.sum("turn").over(line).alias("winding"), F.lead("x").over(line).alias("end")).filter("winding <> 0 AND end > x AND end > 0 AND x < width")
    begin, end = F.greatest(F.lit(0.0), F.col("x")), F.least(F.col("width").cast("double"), F.col("end"))
    cells = spans.select(*keys, "s", begin.alias("begin"), end.alias("end"), F.explode(F.sequence(F.floor(begin).cast("int"), F.greatest(F.floor(begin), F.ceil(end) - 1).cast("int"))).alias("px"))
    part = F.least(F.col("end"), F.col("px") + 1.0) - F.greatest(F.col("begin"), F.col("px").cast("double"))
    sums = cells.groupBy(*keys, F.floor(F.col("s") / rows).cast("int").alias("y"), F.col("px").alias("x")).agg((F.sum(part) / rows).alias("c"))
    return sums.select(*keys, "y", "x", F.round(F.col("c") + 3e-9, 6).alias("c")).filter("c > 0")


# writing


def _text(s: str) -> bytes:
    data = s.encode("utf-16-be", "surrogatepass")
    return struct.pack(">I", len(data) // 2) + data


def _name(s: str) -> bytes:
    return (struct.pack(">I", 0) if len(s) == 4 else struct.pack(">I", len(s))) + s.encode("latin-1")


def _items(values: dict[str, bytes]) -> bytes:
    return _text("") + _name("null") + struct.pack(">I", len(values)) + b"".join(_name(k) + v for k, v in values.items())


def _string(s: str) -> bytes:
    raw = (b"\xfe\xff" + s.encode("utf-16-be", "surrogatepass")).replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return b"(" + raw + b")"


def write_text(text: str, fonts: list[str], runs: list[tuple[int, int, float, tuple[float, float, float]]], matrix: tuple[float, ...]) -> bytes:
    """A text layer's block: ``runs`` are (length in UTF-16 units, place of the font, size, colour); ``matrix`` takes text space to the document."""
    sheets = b" ".join(b"<< /StyleSheet << /StyleSheetData << /Font %d /FontSize %s /FillColor << /Type 1 /Values [ 1.0 %s %s %s ] >> >> >> >>" % (f, repr(float(size)).encode(), *(repr(float(c)).encode() for c in colour)) for _, f, size, colour in runs)
    lengths = b" ".join(b"%d" % r[0] for r in runs)
    names = b" ".join(b"<< /Name " + _string(f) + b" >>" for f in fonts)
    raw = b"<< /EngineDict << /Editor << /Text " + _string(text) + b" >> /StyleRun << /RunArray [ " + sheets + b" ] /RunLengthArray [ " + lengths + b" ] >> >> /ResourceDict << /FontSet [ " + names + b" ] >> >>"
    words = {"Txt ": b"TEXT" + _text(text), "Ornt": b"enum" + _name("Ornt") + _name("Hrzn"), "EngineData": b"tdta" + struct.pack(">I", len(raw)) + raw}
    return struct.pack(">H6dHI", 1, *matrix, 50, 16) + _items(words) + struct.pack(">HI", 1, 16) + _items({"warpStyle": b"enum" + _name("warpStyle") + _name("warpNone")})


def write_path(subpaths: list[tuple[bool, list[tuple[tuple[float, float], ...]]]]) -> bytes:
    """A vector mask's block: for each subpath whether it is closed, and its knots' incoming, own and outgoing points (x, y) as parts of the canvas."""
    out = [struct.pack(">II", 3, 0), struct.pack(">h24x", 6)]
    for closed, knots_ in subpaths:
        out.append(struct.pack(">hh22x", 0 if closed else 3, len(knots_)))
        out += [struct.pack(">h6i", 1 if closed else 4, *(math.floor(v * (1 << 24) + 0.5) for x, y in points for v in (y, x))) for points in knots_]
    return b"".join(out)


def _blocks(rows: DataFrame, key: str, kind: str, write: Callable[[dict], bytes]) -> DataFrame:
    """(``key``, blocks): the block that ``write`` makes of each row."""
    schema = pa.schema([(key, pa.int64()), ("blocks", pa.map_(pa.string(), pa.binary()))])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([[(kind, write(r))] for r in batch.to_pylist()], schema.field("blocks").type)], schema=schema)

    return rows.mapInArrow(written, f"{key} long, blocks map<string,binary>")


def conversation_blocks(turns: DataFrame) -> DataFrame:
    """Turns (id, text) as text layers: two runs of fonts and sizes by their ids."""

    def block(r: dict) -> bytes:
        text = r["text"]
        units = len(text.encode("utf-16-le")) // 2
        first = units // 3
        runs = [(first, 0, 10 + r["id"] % 7, (0.5, 0.25, 0.0)), (units - first, 1, 24.5, (1.0, 1.0, 0.0))]
        return write_text(text, ["Serif-Book", "Sans (Bold)"], runs if first else runs[1:], (2.0, 0.0, 0.0, 2.0, float(r["id"] % 50), 8.0))

    return _blocks(turns.select(F.col("id").cast("long").alias("id"), "text"), "id", "TySh", block)


def vector_blocks(vectors: DataFrame) -> DataFrame:
    """Vectors (id, embedding) as closed paths of four knots about the canvas's middle: each knot's point and handles are six components."""

    def block(r: dict) -> bytes:
        v = r["embedding"]
        around = ((0.3, 0.3), (0.7, 0.3), (0.7, 0.7), (0.3, 0.7))
        return write_path([(True, [tuple((x + 0.25 * v[6 * k + 2 * i], y + 0.25 * v[6 * k + 2 * i + 1]) for i in range(3)) for k, (x, y) in enumerate(around)])])

    return _blocks(vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")), "id", "vmsk", block)
