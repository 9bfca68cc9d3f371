"""Rasters as tables of square tiles, spatial operators tile by tile with a margin of their neighbours, and what has to be done again after a change.

A tile is a row (image_id, ty, tx, y0, x0, height, width, wide, data): its place, its first pixel, the size of its whole image, its own width and its values as packed
little-endian doubles, row by row. A spatial operator whose result at a place hangs on no more than ``halo`` pixels around it is the same by tiles as by whole images: each tile sends its neighbours the strips that
they need, and a tile's window ends where its image does, so that the operator's own rule holds at edges. After a change only tiles within the halo
of a changed tile are done again; the others' rows are taken over as they are. Rows are dealt out and sorted by tiles, and a task works on as many tiles at once as its
batches hold, so that small tiles do not cost a call each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.plans.staging import staged

TILE = 256
#: Values that are put together at once, or one tile's.
MOST_VALUES = 1 << 20
KEYS = ["image_id", "ty", "tx"]
SCHEMA = "image_id long, ty int, tx int, y0 int, x0 int, height int, width int, wide int, data binary"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
Kernel = Callable[[np.ndarray], np.ndarray]


def _shape(ty: int, tx: int, height: int, width: int, tile: int) -> tuple[int, int]:
    return min(tile, height - ty * tile), min(tile, width - tx * tile)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of tiles with their values."""
    *columns, values = zip(*rows, strict=True)
    return _batch([np.array(c) for c in columns], np.concatenate([v.ravel() for v in values]), np.array([v.size for v in values]))


def _batch(columns: list[np.ndarray], values: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
    """Rows of tiles: all columns but the last, and the values of all of them, one tile after another."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(8 * sizes, out=offsets[1:])
    data = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values, "<f8"))])
    kinds = (np.int64, *[np.int32] * 7)
    return pa.RecordBatch.from_arrays([*[pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], data], names=_NAMES)


def _values(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of ``data``, one after another, and where each row's begin and the last one's end."""
    column = column.cast(pa.large_binary())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0), offsets - offsets[0]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view("<f8"), (offsets - offsets[0]) // 8


def _pieces(sizes: np.ndarray) -> Iterator[slice]:
    """Slices of tiles of ``sizes`` values that hold at most ``MOST_VALUES``, or one tile."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MOST_VALUES, "right")))
        yield slice(at, stop)
        at = stop


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted ``batches`` cut anew, so that none ends within a tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in KEYS]
        other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        last = int(other[-1]) + 1 if len(other) else 0
        goes_on = held and all(held[0].column(c)[0].as_py() == k[0] for c, k in zip(KEYS, keys, strict=True))
        if not last and (goes_on or not held):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _by_tiles(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """What ``work`` makes of the rows of whole tiles, in the order of tiles."""

    def worked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches):
            yield from work(table)

    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(worked, SCHEMA)


def _begins(keys: list[np.ndarray]) -> np.ndarray:
    """Where the rows of each tile begin."""
    changes = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.concatenate([[0], np.flatnonzero(changes) + 1])


def to_tiles(pixels: DataFrame, sizes: DataFrame, tile: int = TILE) -> DataFrame:
    """Tiles of ``pixels`` (image_id, y, x, v) on images of ``sizes`` (image_id, height, width); places without a pixel are 0."""

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        image, ty, tx, y, x, height, width, v = (table.column(c).to_numpy() for c in ("image_id", "ty", "tx", "y", "x", "height", "width", "v"))
        first = _begins([image, ty, tx])
        high, wide = np.minimum(tile, height - ty * tile)[first], np.minimum(tile, width - tx * tile)[first]
        ends = np.append(first, len(image))
        for part in _pieces(high.astype(np.int64) * wide):
            at, rows = first[part], slice(ends[part.start], ends[part.stop])
            size = high[part].astype(np.int64) * wide[part]
            start = np.cumsum(size) - size
            of = np.repeat(np.arange(len(at)), np.diff(ends[part.start : part.stop + 1]))
            values = np.zeros(int(size.sum()))
            values[start[of] + (y[rows] - ty[rows] * tile) * wide[part][of] + x[rows] - tx[rows] * tile] = v[rows]
            yield _batch([image[at], ty[at], tx[at], ty[at] * tile, tx[at] * tile, height[at], width[at], wide[part]], values, size)

    rows = pixels.join(sizes, "image_id").filter("y >= 0 AND x >= 0 AND y < height AND x < width")
    named = rows.select(F.col("image_id").cast("long").alias("image_id"), F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("v").cast("double").alias("v"))
    return _by_tiles(named, packed)


def to_pixels(tiles: DataFrame) -> DataFrame:
    """(image_id, y, x, v) of all places of ``tiles``."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, ends = _values(batch.column("data"))
            for part in _pieces(np.diff(ends)):
                size = np.diff(ends[part.start : part.stop + 1])
                image, y0, x0, wide = (np.repeat(batch.column(c).to_numpy()[part], size) for c in ("image_id", "y0", "x0", "wide"))
                at = np.arange(len(image)) - np.repeat(np.cumsum(size) - size, size)
                columns = [pa.array(image), pa.array((y0 + at // wide).astype(np.int32)), pa.array((x0 + at % wide).astype(np.int32)), pa.array(values[ends[part.start] : ends[part.stop]])]
                yield pa.RecordBatch.from_arrays(columns, names=["image_id", "y", "x", "v"])

    return tiles.select(*_NAMES).mapInArrow(opened, "image_id long, y int, x int, v double")


def _rows(table: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    """Each row of tiles: all columns but the last, and its values as a raster."""
    values, ends = _values(table.column("data"))
    for i, row in enumerate(zip(*(table.column(c).to_numpy().tolist() for c in _NAMES[:-1]), strict=True)):
        yield *row, values[ends[i] : ends[i + 1]].reshape(-1, row[-1])


def _sent(tile: int, halo: int) -> Callable:
    """Cuts each tile into what it and its neighbours need: (image_id, ty, tx) of the receiver, and the strip with its place."""

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = -(-halo // tile)
        rows, held = [], 0
        for batch in batches:
            for image, ty0, tx0, y0, x0, height, width, w, values in _rows(batch):
                h = values.shape[0]
                for ty in range(max(0, ty0 - reach), ty0 + reach + 1):
                    for tx in range(max(0, tx0 - reach), tx0 + reach + 1):
                        if ty * tile >= height or tx * tile >= width:
                            continue
                        high, wide = _shape(ty, tx, height, width, tile)
                        # the receiver's window, cut to this tile
                        top, bottom = max(y0, ty * tile - halo), min(y0 + h, ty * tile + high + halo)
                        left, right = max(x0, tx * tile - halo), min(x0 + w, tx * tile + wide + halo)
                        if top < bottom and left < right:
                            part = values[top - y0 : bottom - y0, left - x0 : right - x0]
                            rows.append((image, ty, tx, top, left, height, width, right - left, part))
                            held += part.size
                if held >= MOST_VALUES:
                    yield _table(rows)
                    rows, held = [], 0
            if rows:
                yield _table(rows)
                rows, held = [], 0

    return strips


def spatial(tiles: DataFrame, kernel: Kernel, halo: int, tile: int = TILE, only: DataFrame | None = None) -> DataFrame:
    """``kernel`` of whole rasters by tiles; of all of them, or of those of ``only`` (image_id, ty, tx).

    The kernel is given windows of one shape, as the last two axes of an array, and returns one of the same shape; what it says within ``halo`` of a window's inner edges is not used.
    """

    def made(waiting: list[tuple], h: int, w: int, top: int, left: int) -> pa.RecordBatch:
        out = kernel(np.stack([window for *_, window in waiting]))[:, top : top + h, left : left + w]
        columns = [np.array(c) for c in zip(*(row for row, _ in waiting), strict=True)]
        return _batch(columns, out.ravel(), np.full(len(waiting), h * w))

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list[tuple]] = {}
        last, window, top, left = None, None, 0, 0
        for image, ty, tx, y0, x0, height, width, _, part in _rows(table):
            if (image, ty, tx) != last:
                last = image, ty, tx
                h, w = _shape(ty, tx, height, width, tile)
                top, left = max(0, ty * tile - halo), max(0, tx * tile - halo)
                window = np.zeros((min(height, ty * tile + h + halo) - top, min(width, tx * tile + w + halo) - left))
                # windows of one shape, whose tiles lie in them at one place, are worked on together once enough of them are whole
                shape = h, w, ty * tile - top, tx * tile - left, *window.shape
                alike = waiting.setdefault(shape, [])
                if len(alike) * window.size >= MOST_VALUES:
                    yield made(alike, *shape[:4])
                    alike.clear()
                alike.append(((image, ty, tx, ty * tile, tx * tile, height, width, w), window))
            window[y0 - top : y0 - top + part.shape[0], x0 - left : x0 - left + part.shape[1]] = part
        for shape, alike in waiting.items():
            yield made(alike, *shape[:4])

    strips = _needed(tiles, only, halo, tile) if only is not None else tiles
    sent = strips.select(*_NAMES).mapInArrow(_sent(tile, halo), SCHEMA)
    if only is not None:
        sent = sent.join(only.select("image_id", "ty", "tx").distinct(), ["image_id", "ty", "tx"], "left_semi")
    return _by_tiles(sent, done)


def around(changed: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """(image_id, ty, tx) of the tiles within ``halo`` of ``changed`` ones."""
    reach = -(-halo // tile)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    near = changed.select("image_id", "tx", F.explode(F.transform(steps, lambda d: F.col("ty") + d)).alias("ty"))
    return near.select("image_id", "ty", F.explode(F.transform(steps, lambda d: F.col("tx") + d)).alias("tx")).distinct()


def _needed(tiles: DataFrame, only: DataFrame, halo: int, tile: int) -> DataFrame:
    """The tiles that those of ``only`` are made from."""
    return tiles.join(around(only, halo, tile), ["image_id", "ty", "tx"], "left_semi")


def changed_tiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id, ty, tx) of ``after``'s tiles that ``before`` has not, or not with the same values."""
    keys = ["image_id", "ty", "tx", "data"]
    return after.select(*keys).join(before.select(*keys), keys, "left_anti").drop("data")


def recomputed(results: DataFrame, tiles: DataFrame, changed: DataFrame, kernel: Kernel, halo: int, tile: int = TILE) -> DataFrame:
    """``results`` of ``kernel`` brought up to date: ``tiles`` now hold, of which ``changed`` (image_id, ty, tx) are not those ``results`` were made from."""
    again = staged(around(changed, halo, tile).join(tiles.select("image_id", "ty", "tx"), ["image_id", "ty", "tx"], "left_semi"))
    fresh = spatial(tiles, kernel, halo, tile, again)
    return results.join(again, ["image_id", "ty", "tx"], "left_anti").select(*_NAMES).unionByName(fresh)


# kernels of whole rasters, the last two axes of an array


def _beside(plane: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Widths of a margin of ``n`` at both ends of rows."""
    return [(0, 0)] * (plane.ndim - 1) + [(n, n)]


def _across(along: Kernel) -> Kernel:
    """First along rows, then along columns."""
    return lambda plane: along(along(plane).swapaxes(-1, -2)).swapaxes(-1, -2)


def box_mean(radius: int) -> Kernel:
    """Means over squares, lines repeated at edges; first along rows, then along columns."""

    def along(plane: np.ndarray) -> np.ndarray:
        padded = np.pad(plane, _beside(plane, radius), mode="edge")
        sums = np.cumsum(np.pad(padded, [(0, 0)] * (plane.ndim - 1) + [(1, 0)]), axis=-1)
        return (sums[..., 2 * radius + 1 :] - sums[..., : -2 * radius - 1]) / (2 * radius + 1)

    return _across(along)


def greatest(reach: int) -> Kernel:
    """The greatest value within a square; places beyond the edges play no part."""

    def along(plane: np.ndarray) -> np.ndarray:
        padded = np.pad(plane, _beside(plane, reach), constant_values=-np.inf)
        return np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1, axis=-1).max(axis=-1)

    return _across(along)
