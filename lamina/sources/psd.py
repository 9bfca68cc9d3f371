"""Layered PSD and PSB files as a data source: ``spark.read.format("layered").load(path)`` after ``register(spark)``.

One row per layer, from the bottom up, with its record and premultiplied pixels as bytes; one partition per file. 8-bit RGB only. With the
option ``crop`` (x, y, width, height) rows outside are skipped as run-length rows are unpacked, so that they take no memory.
"""

from __future__ import annotations

import glob
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, z int, name string, parent int, section int, x0 int, y0 int, width int, height int, blend_key string, opacity int, clipping boolean, hidden boolean, resolution double, rgba binary, mask binary, blocks map<string,binary>"

#: The additional blocks that go along with a layer (text, paths, shapes, fills and adjustments); ``psd_blocks`` reads them.
BLOCKS = ("TySh", "tySh", "vmsk", "vsms", "vogk", "vstk", "SoCo", "levl", "curv", "hue2", "hue ")


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the file is cut off")
        self.at += n
        return self.data[self.at - n : self.at]

    def read(self, kind: str) -> int:
        return struct.unpack(">" + kind, self.take(struct.calcsize(kind)))[0]


def unpack_bits(data: bytes, length: int) -> bytes:
    """One run-length row: n >= 0 copies n + 1 bytes, n < 0 repeats one byte 1 - n times, -128 is nothing."""
    out, at = bytearray(), 0
    while len(out) < length:
        n = struct.unpack("b", data[at : at + 1])[0]
        at += 1
        if n >= 0:
            out += data[at : at + n + 1]
            at += n + 1
        elif n != -128:
            out += data[at : at + 1] * (1 - n)
            at += 1
    return bytes(out[:length])


def channel(data: bytes, width: int, height: int, large: bool, rows: range, columns: range) -> np.ndarray:
    """A channel's plane, of which only ``rows`` and ``columns`` are kept."""
    kind = struct.unpack(">H", data[:2])[0]
    if kind == 0:
        plane = np.frombuffer(data, np.uint8, width * height, 2).reshape(height, width)
        return plane[rows.start : rows.stop, columns.start : columns.stop]
    if kind != 1:
        raise ValueError("only raw and run-length channels are read")
    step = 4 if large else 2
    counts = struct.unpack(f">{height}{'I' if large else 'H'}", data[2 : 2 + step * height])
    at, out = 2 + step * height, np.zeros((len(rows), len(columns)), np.uint8)
    for y, n in enumerate(counts):
        if y in rows:
            out[y - rows.start] = np.frombuffer(unpack_bits(data[at : at + n], width), np.uint8)[columns.start : columns.stop]
        at += n
    return out


def _record(c: _Cursor, large: bool) -> dict:
    top, left, bottom, right = (c.read("i") for _ in range(4))
    channels = [(c.read("h"), c.read("Q" if large else "I")) for _ in range(c.read("H"))]
    if c.take(4) != b"8BIM":
        raise ValueError("a layer record is damaged")
    key, opacity, clipping, flags = c.take(4).decode("latin-1"), c.read("B"), c.read("B"), c.read("B")
    c.take(1)
    end = c.read("I") + c.at
    mask, mask_length = None, c.read("I")
    mask_end = c.at + mask_length
    if mask_length >= 20:
        mask = (*(c.read("i") for _ in range(4)), c.read("B"))
    c.at = mask_end
    c.take(c.read("I"))
    name = c.take(c.read("B")).decode("mac-roman")
    c.at += -(len(name) + 1) % 4
    section, blocks = 0, {}
    while c.at + 12 <= end and c.data[c.at : c.at + 4] in (b"8BIM", b"8B64"):
        wide = c.take(4) == b"8B64"
        info = c.take(4)
        payload = c.take(c.read("Q" if wide else "I"))
        c.at += len(payload) % 2
        if info == b"luni":
            name = payload[4 : 4 + 2 * struct.unpack(">I", payload[:4])[0]].decode("utf-16-be").rstrip("\0")
        elif info in (b"lsct", b"lsdk"):
            section = struct.unpack(">I", payload[:4])[0]
        elif info.decode("latin-1") in BLOCKS:
            blocks[info.decode("latin-1")] = payload
    c.at = end
    return {"box": (left, top, right, bottom), "channels": channels, "key": key, "opacity": opacity, "clipping": bool(clipping), "hidden": bool(flags & 2), "mask": mask, "name": name, "section": section, "blocks": blocks}


def _resolution(data: bytes) -> float:
    c = _Cursor(data)
    while c.at + 12 <= len(data) and c.take(4) == b"8BIM":
        number, name = c.read("H"), c.take(c.read("B"))
        c.at += (len(name) + 1) % 2
        payload = c.take(c.read("I"))
        c.at += len(payload) % 2
        if number == 1005 and len(payload) >= 4:
            return min(9600.0, max(1.0, struct.unpack(">I", payload[:4])[0] / 65536))
    return 72.0


def parents(sections: list[int]) -> list[int | None]:
    """For each place from the bottom, that of its folder: a divider (3) opens one, a folder's own record (1 or 2) closes it."""
    out: list[int | None] = [None] * len(sections)
    pending: list[list[int]] = [[]]
    for z, section in enumerate(sections):
        if section == 3:
            pending.append([])
            continue
        if section in (1, 2):
            if len(pending) == 1:
                raise ValueError("a folder closes that was not opened")
            for child in pending.pop():
                out[child] = z
        pending[-1].append(z)
    if len(pending) > 1:
        raise ValueError("a folder is not closed")
    return out


def read(data: bytes, crop: tuple[int, int, int, int] | None = None) -> list[dict]:
    c = _Cursor(data)
    if c.take(4) != b"8BPS":
        raise ValueError("not a layered file")
    version = c.read("H")
    if version not in (1, 2):
        raise ValueError("unknown version")
    large = version == 2
    c.take(6)
    c.read("H")
    height, width, depth, mode = c.read("I"), c.read("I"), c.read("H"), c.read("H")
    if depth != 8 or mode != 3 or not (0 < width <= 30_000 and 0 < height <= 30_000):
        raise ValueError("only 8-bit RGB up to 30,000 a side is read")
    c.take(c.read("I"))
    resolution = _resolution(c.take(c.read("I")))
    long_ = "Q" if large else "I"
    if c.read(long_) < 4:
        return []
    c.read(long_)
    records = [_record(c, large) for _ in range(abs(c.read("h")))]
    above = parents([r["section"] for r in records])
    out = []
    for z, r in enumerate(records):
        left, top, right, bottom = r["box"]
        x0, y0, x1, y1 = left, top, right, bottom
        if crop:
            x0, y0, x1, y1 = max(left, crop[0]), max(top, crop[1]), min(right, crop[0] + crop[2]), min(bottom, crop[1] + crop[3])
        w, h = max(0, x1 - x0), max(0, y1 - y0)
        planes, mask = {}, None
        for number, length in r["channels"]:
            raw = c.take(length)
            if number in (0, 1, 2, -1) and w and h:
                planes[number] = channel(raw, right - left, bottom - top, large, range(y0 - top, y1 - top), range(x0 - left, x1 - left))
            elif number == -2 and r["mask"]:
                mt, ml, mb, mr, default = r["mask"]
                grid = np.full((h, w), default, np.uint8)
                if mr > ml and mb > mt:
                    patch = channel(raw, mr - ml, mb - mt, large, range(mb - mt), range(mr - ml))
                    ys, xs = slice(max(y0, mt), min(y1, mb)), slice(max(x0, ml), min(x1, mr))
                    if ys.stop > ys.start and xs.stop > xs.start:
                        grid[ys.start - y0 : ys.stop - y0, xs.start - x0 : xs.stop - x0] = patch[ys.start - mt : ys.stop - mt, xs.start - ml : xs.stop - ml]
                mask = grid.tobytes()
        rgba = None
        if {0, 1, 2} <= planes.keys():
            a = planes.get(-1, np.full((h, w), 255, np.uint8)).astype(int)
            rgba = np.dstack([*[((planes[k].astype(int) * a + 127) // 255) for k in range(3)], a]).astype(np.uint8).tobytes()
        if r["section"] != 3:
            out.append({"z": z, "name": r["name"], "parent": above[z], "section": r["section"], "x0": x0, "y0": y0, "width": w, "height": h, "blend_key": r["key"], "opacity": r["opacity"], "clipping": r["clipping"], "hidden": r["hidden"], "resolution": resolution, "rgba": rgba, "mask": mask, "blocks": r["blocks"]})
    return out


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(glob.glob(options["path"]))
        self.crop = tuple(int(v) for v in options["crop"].split(",")) if "crop" in options else None

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            rows = read(f.read(), self.crop)
        for r in rows:
            yield (partition.path, *(r[k] for k in ("z", "name", "parent", "section", "x0", "y0", "width", "height", "blend_key", "opacity", "clipping", "hidden", "resolution", "rgba", "mask", "blocks")))


class LayeredSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "layered"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LayeredSource)
