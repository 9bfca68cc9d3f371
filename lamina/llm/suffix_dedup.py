"""Removal of repeated passages by sorting suffixes, exactly: every byte is removed that a ``LENGTH``-byte string covers which starts earlier.

Sorting all suffixes of a corpus in one order would compare strings that differ at once. Here they are first dealt out by content: of the
``LENGTH - GRAM + 1`` grams (strings of ``GRAM`` bytes) in a window of ``LENGTH`` bytes, the one of least hash is its anchor, so equal windows have
equal anchors at equal offsets, and one anchor serves a whole interval of neighbouring windows.

1. Anchors (about 32 for 1,000 bytes) are shuffled by gram, packed in blobs. Only grams that stand twice or more go on.
2. Documents with such anchors send for each its context, the bytes of all windows that the anchor serves.
3. Contexts of a gram are put in order by deep-shallow sorting (``deepshallow``). Equal ones are neighbours: all but the earliest
   are repeats as a whole. If a gram has several different contexts, the suffixes at all windows of each one's earliest place are sorted as well, to
   ``LENGTH`` bytes: of those equal, all but the earliest are repeats.
4. Repeats return to their documents as byte intervals, which are united and cut out.

A gram that stands more than ``HOT`` times among different neighbours (a common line) would bring all of its contexts to one task. Its contexts are
cut into single windows, each dealt out by a hash of all its bytes.

Before the shuffles of steps 1 and 2, each batch keeps one of equal grams and of equal contexts, so that a passage in a third of all
documents is sent on once per batch. Texts are shuffled once, by document; both joins read that shuffle.

Defined results: documents are ordered by ``doc_id``, rows of equal ``doc_id`` by a hash of their texts, and rows without ``doc_id`` come last, each a
document of its own; rows of equal ``doc_id`` (or of none) and equal text are the same document and get the same result; null and empty texts, and those under ``LENGTH`` bytes,
lose nothing; an empty table gives no rows; a text of any length is treated whole, in pieces; other columns pass through ``remove_repeats`` whatever
their names. Hashes of grams only bring together what is then compared byte by byte; texts of one id are told apart by 120 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm import textarray as ta
from lamina.llm.deepshallow import eights, sort_groups

LENGTH, GRAM = 100, 40
PART_BYTES = 12 << 20
PIECE = 1 << 20
_LAST = (1 << 63) - 1
_TIE_BITS = 60
#: A document is named by its id and 120 bits of its text's SHA-256 (see ``_keyed``).
NAME = ("doc", "tie", "rest")
ANCHOR = np.dtype([("gram", "u8"), ("doc", "i8"), ("tie", "i8"), ("rest", "i8"), ("at", "i8"), ("low", "i2"), ("high", "i2")])
SPAN = np.dtype([("first", "i8"), ("last", "i8")])
#: Of a gram's hash so many bits go along with its part's number; grams that agree in them are told apart later, by their contexts.
_GRAM_BITS = 40
_WITNESS = 255
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOB = "kind int, part int, doc long, tie long, rest long, blob binary"
#: A gram that stands more often has its windows dealt out one by one, by all of their bytes; the most frequent such grams are named to the tasks.
HOT, HOT_GRAMS = 8192, 1_000_000


def _deflated(arrays: list[np.ndarray]) -> bytes:
    parts = [np.array([len(a) for a in arrays], "<i8").tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts + [np.ascontiguousarray(a).tobytes() for a in arrays]))


def _inflated(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw, out = zstandard.ZstdDecompressor().decompress(blob), []
    at = 8 * len(kinds)
    for n, kind in zip(np.frombuffer(raw, "<i8", len(kinds)).tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


_FIELDS = ("<i8", "<i8", "<i8", "<i8", "<u4", "u1", "<i8", "u1", "u1", "u1")


def pack_anchors(rows: np.ndarray, data: np.ndarray | None = None) -> bytes:
    """Anchors in the order of documents and places, with bytes that go with them. Documents are named once, places are differences."""
    at = rows["at"]
    head = np.append(0, _cuts(*(rows[k] for k in NAME)))
    doc, tie, rest = (rows[k][head] for k in NAME)
    step = np.diff(at, prepend=0)
    step[head] = at[head]
    counts = np.diff(np.append(head, len(rows)))
    return _deflated(
        [np.diff(doc, prepend=0), tie, rest, counts, rows["gram"].astype("<u4"), (rows["gram"] >> np.uint64(32)).astype("u1"), step, rows["low"].astype("u1"), rows["high"].astype("u1"), np.zeros(0, "u1") if data is None else data]
    )


def unpack_anchors(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    doc, tie, rest, counts, low_gram, high_gram, step, low, high, data = _inflated(blob, _FIELDS)
    out = np.empty(len(step), ANCHOR)
    for k, x in zip(NAME, (np.cumsum(doc), tie, rest), strict=True):
        out[k] = np.repeat(x, counts)
    out["gram"] = low_gram.astype("u8") | (high_gram.astype("u8") << np.uint64(32))
    total = np.cumsum(step)
    first = np.cumsum(counts) - counts
    out["at"] = total - np.repeat(total[first] - step[first], counts)
    out["low"], out["high"] = low, high
    out["low"][low == _WITNESS] = -1
    return out, data


def pack_spans(name: np.ndarray, spans: np.ndarray) -> bytes:
    """``spans`` with the ``NAME`` fields of the documents they lie in."""
    return _deflated([np.diff(name["doc"], prepend=0), name["tie"], name["rest"], spans["first"], spans["last"] - spans["first"]])


def unpack_spans(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    doc, tie, rest, first, length = _inflated(blob, ("<i8",) * 5)
    spans, name = np.empty(len(doc), SPAN), np.empty(len(doc), [(k, "i8") for k in NAME])
    spans["first"], spans["last"] = first, first + length
    name["doc"], name["tie"], name["rest"] = np.cumsum(doc), tie, rest
    return name, spans


def _order(anchors: np.ndarray, *first: np.ndarray) -> np.ndarray:
    """Sorted by ``first``, then by place in the corpus."""
    return np.lexsort((anchors["at"], *(anchors[k] for k in reversed(NAME)), *reversed(first)))


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts of about ``PIECE`` bytes: row, place in ``data``, gram hash, and least and greatest distance from its windows' starts."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none, none.astype(np.uint64), none, none
    running = ta.prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    hashes = ta.span_hash(running, at, at + gram)
    best = (hashes >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width, reach = length - gram + 1, 1
    while 2 * reach <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < width:
        best = np.minimum(best[: len(best) - (width - reach)], best[width - reach :])
    place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    inside = np.arange(n) + length <= offsets[row + 1]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new & inside)
    ends = np.flatnonzero(inside & np.append(new[1:] | ~inside[1:], True))
    p = place[first]
    return row[first], p, hashes[p], p - ends, p - first


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, where the bytes begin in the first row's text); a long text comes in pieces that share length - 1 bytes."""
    for a, b in ta.groups(offsets, PIECE):
        first, last = int(offsets[a]), int(offsets[b])
        if last - first <= 2 * PIECE:
            yield a, data[first:last], offsets[a : b + 1] - first, 0
            continue
        for at in range(first, last - length + 1, PIECE):
            own = data[at : min(at + PIECE + length - 1, last)]
            yield a, own, np.array([0, len(own)]), at - first


def _anchors(name: list[np.ndarray], data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> np.ndarray:
    out = []
    for a, own, bounds, base in _pieces(data, offsets, length):
        row, place, hashes, low, high = anchors_of(own, bounds, length, gram)
        part = np.empty(len(row), ANCHOR)
        part["gram"], part["at"], part["low"], part["high"] = hashes >> np.uint64(64 - _GRAM_BITS), place - bounds[row] + base, low, high
        for k, x in zip(NAME, name, strict=True):
            part[k] = x[a + row]
        out.append(part)
    return np.concatenate(out) if out else np.zeros(0, ANCHOR)


def _cuts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted keys change."""
    change = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.flatnonzero(change) + 1


def _anchor_blobs(kind: int, parts: np.ndarray, rows: np.ndarray, n: np.ndarray | None = None) -> list[tuple]:
    """One blob of ``rows`` for each of their ``parts``, with the numbers ``n`` of some."""
    if not len(rows):
        return []
    order = _order(rows, parts)
    return [(kind, int(parts[own[0]]), None, None, None, pack_anchors(rows[own], None if n is None else n[own].astype("<u4").view("u1"))) for own in np.split(order, _cuts(parts[order]))]


def _span_blobs(name: np.ndarray, spans: np.ndarray, parts: int) -> list[tuple]:
    if not len(name):
        return []
    route = _spread(name, parts)
    order = np.lexsort((spans["first"], *(name[k] for k in reversed(NAME)), route))
    return [(_KNOWN, int(route[own[0]]), None, None, None, pack_spans(name[own], spans[own])) for own in np.split(order, _cuts(route[order]))]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows, strict=True) if rows else ([],) * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "part", *NAME, "blob"])


def _route(gram: np.ndarray, parts: int) -> np.ndarray:
    return (gram % np.uint64(parts)).astype(np.int64)


def _spread(name: np.ndarray, parts: int) -> np.ndarray:
    """A part for each document, whether or not it has an id."""
    return (ta.mix(name["doc"].astype(np.uint64) ^ ta.mix(name["tie"].astype(np.uint64))) % np.uint64(parts)).astype(np.int64)


#: Kinds of rows between the steps: anchors or contexts to be compared; what is known already, for its document; and grams that stand very often.
_OPEN, _KNOWN, _OFTEN = 0, 1, 2


def _send_anchors(parts: int, length: int, gram: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(3))
            found = _anchors([batch.column(i).to_numpy() for i in range(3)], data, offsets, length, gram)
            if not len(found):
                continue
            found = found[np.argsort(found["gram"], kind="stable")]
            same = found["gram"][1:] == found["gram"][:-1]
            twice = np.append(same, False) | np.append(False, same)
            head = np.append(True, ~same)
            # of grams met twice here, one goes on as a witness; it is marked by a negative ``low``, as it needs no answer
            witness = found[head]
            witness["low"] = np.where(twice[head], -1, witness["low"])
            rows = _anchor_blobs(_OPEN, _route(witness["gram"], parts), witness, np.diff(np.append(np.flatnonzero(head), len(found))))
            known = found[twice]
            yield _batch(rows + _anchor_blobs(_KNOWN, _spread(known, parts), known))

    return send


_GRAMS = np.dtype([("gram", "i8"), ("n", "i8")])


def _repeated(parts: int, hot: int):
    """Of one part's anchors, those whose gram stands twice, dealt out by document; and the grams that stand more than ``hot`` times."""

    def repeated(table: pa.Table) -> pa.Table:
        kind, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        part = table.column("part")[0].as_py()
        out = [(_KNOWN, part, None, None, None, b) for b, k in zip(blobs, kind, strict=True) if k == _KNOWN]
        opened = [unpack_anchors(b) for b, k in zip(blobs, kind, strict=True) if k == _OPEN]
        if opened:
            rows, n = np.concatenate([a for a, _ in opened]), np.concatenate([x.view("<u4") for _, x in opened])
            by = np.argsort(rows["gram"], kind="stable")
            rows, n = rows[by], n[by]
            same = rows["gram"][1:] == rows["gram"][:-1]
            head = np.flatnonzero(np.append(True, ~same))
            total = np.add.reduceat(n.astype(np.int64), head)
            if (total > hot).any():
                often = np.empty(int((total > hot).sum()), _GRAMS)
                often["gram"], often["n"] = rows["gram"][head][total > hot], total[total > hot]
                out.append((_OFTEN, part, None, None, None, often.tobytes()))
            twice = np.append(same, False) | np.append(False, same)
            rows = rows[twice & (rows["low"] >= 0)]
            out += _anchor_blobs(_KNOWN, _spread(rows, parts), rows)
        return pa.Table.from_batches([_batch(out)])

    return repeated


def _anchors_per_document(table: pa.Table) -> pa.Table:
    """One row per document, with all of its anchors."""
    rows = np.concatenate([unpack_anchors(b)[0] for b in table.column("blob").to_pylist()])
    rows = rows[_order(rows)]
    out = [(_KNOWN, 0, *(int(own[0][k]) for k in NAME), pack_anchors(own)) for own in np.split(rows, _cuts(*(rows[k] for k in NAME))) if len(own)]
    return pa.Table.from_batches([_batch(out)])


def _spans_per_document(table: pa.Table) -> pa.Table:
    """One row per document, with the union of its intervals."""
    name, spans = (np.concatenate(x) for x in zip(*map(unpack_spans, table.column("blob").to_pylist()), strict=True))
    order = np.lexsort((spans["first"], *(name[k] for k in reversed(NAME))))
    out = [(_KNOWN, 0, *(int(name[k][own[0]]) for k in NAME), united(spans[own]).tobytes()) for own in np.split(order, _cuts(*(name[k][order] for k in NAME))) if len(own)]
    return pa.Table.from_batches([_batch(out)])


def _padded(pieces: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([*pieces, np.zeros(8, np.uint8)])


def _gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The strings of ``data`` after each other."""
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    return data[np.repeat(starts - begin, lengths) + np.arange(total)]


def _spans(anchors: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(anchors), SPAN)
    out["first"], out["last"] = anchors["at"] - anchors["high"], anchors["at"] - anchors["low"] + length
    return out


def _equal_contexts(anchors: np.ndarray, data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A mask of the anchors that repeat an earlier one's whole context; ``data`` has each one's context at ``starts``."""
    sizes = (anchors["high"] - anchors["low"] + length).astype(np.int64)
    key = np.lexsort((anchors["high"], anchors["low"], anchors["gram"]))
    k = anchors[key]
    new = np.append(True, (k["gram"][1:] != k["gram"][:-1]) | (k["low"][1:] != k["low"][:-1]) | (k["high"][1:] != k["high"][:-1]))
    groups = np.empty(len(anchors), np.int64)
    groups[key] = np.cumsum(new) - 1
    order, equal = sort_groups(data, starts, sizes, groups)
    return _not_earliest(anchors, order, equal)


def _not_earliest(anchors: np.ndarray, order: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """In each run of equal strings, all but that which stands first in the corpus (a row that is repeated stands where the first one does)."""
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(~equal) - 1
    by = _order(anchors, run)
    head = np.flatnonzero(np.append(True, run[by][1:] != run[by][:-1]))
    first, own = anchors[by[head]][run[by]], anchors[by]
    out = np.empty(len(order), bool)
    out[by] = np.logical_or.reduce([own[k] != first[k] for k in (*NAME, "at")])
    return out


def _split(found: np.ndarray, begin: np.ndarray, hot: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors and where their contexts begin; those of the ``hot`` grams (sorted) are replaced by one for each of their windows.

    Such an anchor has a hash of its window's bytes for its gram, so what one gram has gathered parts by content; equal windows still meet.
    """
    place = np.minimum(np.searchsorted(hot, found["gram"]), len(hot) - 1)
    often = np.flatnonzero(hot[place] == found["gram"])
    if not len(often):
        return found, begin
    n = (found["high"][often] - found["low"][often] + 1).astype(np.int64)
    each = np.repeat(often, n)
    step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    windows, at = found[each], begin[each] + step
    windows["high"] -= step.astype("i2")
    windows["low"] = windows["high"]
    hashes = np.full(len(each), length, np.uint64)
    for depth in range(0, length, 8):
        hashes = ta.mix(hashes + eights(data, at + depth, np.full(len(at), length - depth)) * _STEP)
    windows["gram"] = hashes >> np.uint64(64 - _GRAM_BITS)
    rest = np.delete(np.arange(len(found)), often)
    return np.concatenate([found[rest], windows]), np.concatenate([begin[rest], at])


def _send_contexts(parts: int, length: int, hot: np.ndarray):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(0))
            wanted = batch.column(1)
            first = 0
            while first < batch.num_rows:
                anchors, starts, last, held = [], [], first, 0
                # contexts of about 8 * PIECE bytes are compared at once
                while last < batch.num_rows and held < 8 * PIECE:
                    own = unpack_anchors(wanted[last].as_py())[0]
                    anchors.append(own)
                    starts.append(offsets[last] + own["at"] - own["high"])
                    held += len(own) * (length + 30)
                    last += 1
                found, begin, padded = np.concatenate(anchors), np.concatenate(starts).astype(np.int64), _padded([data])
                if len(hot):
                    found, begin = _split(found, begin, hot, padded, length)
                repeats = _equal_contexts(found, padded, begin, length)
                rows = _span_blobs(found[repeats], _spans(found[repeats], length), parts)
                new = np.flatnonzero(~repeats)
                sizes = (found["high"] - found["low"] + length).astype(np.int64)
                route = _route(found["gram"][new], parts)
                order = _order(found[new], route)
                for own in np.split(order, _cuts(route[order])):
                    pick = new[own]
                    rows.append((_OPEN, int(route[own[0]]), None, None, None, pack_anchors(found[pick], _gather(data, begin[pick], sizes[pick]))))
                yield _batch(rows)
                first = last

    return send


def _resolve(parts: int, length: int):
    """Repeats among one part's contexts, as intervals dealt out by document."""

    def resolve(table: pa.Table) -> pa.Table:
        kind, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        part = table.column("part")[0].as_py()
        out = [(_KNOWN, part, None, None, None, b) for k, b in zip(kind, blobs, strict=True) if k == _KNOWN]
        opened = [unpack_anchors(b) for b, k in zip(blobs, kind, strict=True) if k == _OPEN]
        if not opened:
            return pa.Table.from_batches([_batch(out)])
        anchors, data = np.concatenate([a for a, _ in opened]), _padded([d for _, d in opened])
        sizes = (anchors["high"] - anchors["low"] + length).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        repeats = _equal_contexts(anchors, data, starts, length)
        names, spans = [anchors[repeats]], [_spans(anchors[repeats], length)]
        # what is left of each gram, if there are several: all suffixes that begin a window
        left = np.flatnonzero(~repeats)
        left = left[np.argsort(anchors["gram"][left], kind="stable")]
        gram = anchors["gram"][left]
        same = gram[1:] == gram[:-1]
        several = np.append(same, False) | np.append(False, same)
        left, number = left[several], np.cumsum(np.append(True, ~same))[several]
        windows = (anchors["high"][left] - anchors["low"][left] + 1).astype(np.int64)
        total, first = np.cumsum(windows), 0
        while first < len(left):
            last = int(np.searchsorted(total, (total[first - 1] if first else 0) + 400_000, "right"))
            last = max(last, first + 1)
            while last < len(left) and number[last] == number[last - 1]:
                last += 1
            own, n = left[first:last], windows[first:last]
            each = np.repeat(np.arange(len(own)), n)
            step = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            base = anchors[own[each]]
            offset = base["high"].astype(np.int64) - step
            order, equal = sort_groups(data, starts[own[each]] + step, np.full(len(each), length), number[first:last][each] * 256 + offset)
            again = _not_earliest(base, order, equal)
            cut = np.empty(int(again.sum()), SPAN)
            cut["first"] = base["at"][again] - offset[again]
            cut["last"] = cut["first"] + length
            names.append(base[again])
            spans.append(cut)
            first = last
        return pa.Table.from_batches([_batch(out + _span_blobs(np.concatenate(names), np.concatenate(spans), parts))])

    return resolve


def united(spans: np.ndarray) -> np.ndarray:
    """Maximal intervals of the union, in order; those that touch are one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans["first"], kind="stable")]
    reach = np.maximum.accumulate(spans["last"])
    head = np.append(True, spans["first"][1:] > reach[:-1])
    out = np.empty(int(head.sum()), SPAN)
    out["first"], out["last"] = spans["first"][head], reach[np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)]
    return out


def _keyed(docs: DataFrame, *others) -> DataFrame:
    """``docs`` with the document's name, no part of which is ever null, so that all joins read one shuffle.

    It is the id, 60 bits of the text's SHA-256, under a bit that puts rows without an id after all others, and 60 more bits.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = F.sha2(text, 256)
    tie, rest = (F.coalesce(F.conv(F.substring(digits, at, _TIE_BITS // 4), 16, 10).cast("long"), F.lit(0).cast("long")) for at in (1, 1 + _TIE_BITS // 4))
    none = F.when(F.col("doc_id").isNull(), 1 << _TIE_BITS).otherwise(0)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), (tie + none).alias("tie"), rest.alias("rest"), text.alias("text"), *others)


def _often(repeated: DataFrame) -> np.ndarray:
    """The ``HOT_GRAMS`` most frequent of the grams that stand more than ``HOT`` times, sorted; 8 bytes of each reach the driver."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                grams = np.frombuffer(blob, _GRAMS)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(grams[k])) for k in ("gram", "n")], names=["word", "n"])

    found = repeated.filter(F.col("kind") == _OFTEN).select("blob").mapInArrow(ta.lean(unpacked), "word long, n long")
    return np.sort(np.array([r.word for r in common.most_frequent(found, HOT_GRAMS).collect()], np.uint64))


def with_spans(docs: DataFrame, *others, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc, tie, rest, text, ``others`` and ``spans``: the intervals to remove, null where nothing repeats."""
    parts, name = common.parts_for(docs, PART_BYTES), list(NAME)
    keyed = _keyed(docs, *others)
    dealt = _keyed(docs).mapInArrow(ta.lean(_send_anchors(parts, length, gram)), _BLOB)
    repeated = common.stage(dealt.groupBy("part").applyInArrow(ta.lean(_repeated(parts, HOT)), _BLOB), "anchors")
    wanted = repeated.filter(F.col("kind") == _KNOWN).groupBy("part").applyInArrow(ta.lean(_anchors_per_document), _BLOB).select(*name, F.col("blob").alias("wanted"))
    # all columns go along, so that this join's shuffle of the texts is the last join's as well
    contexts = keyed.join(wanted, name).select("text", "wanted", *keyed.columns[4:]).mapInArrow(ta.lean(_send_contexts(parts, length, _often(repeated))), _BLOB)
    found = contexts.groupBy("part").applyInArrow(ta.lean(_resolve(parts, length)), _BLOB)
    per_document = found.groupBy("part").applyInArrow(ta.lean(_spans_per_document), _BLOB).select(*name, F.col("blob").alias("spans"))
    return keyed.join(per_document, name, "left")


def _spans_of(spans: bytes | None) -> np.ndarray:
    return np.frombuffer(spans or b"", SPAN)


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256, of the bytes that stay."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(1))
            removed, counts, sums = [], [], []
            for i, blobs in enumerate(batch.column(2).to_pylist()):
                text, spans = data[offsets[i] : offsets[i + 1]], _spans_of(blobs)
                total, at = hashlib.sha256(), 0
                for first, last in spans.tolist():
                    total.update(text[at:first])
                    at = last
                total.update(text[at:])
                removed.append(int((spans["last"] - spans["first"]).sum()))
                counts.append(len(spans))
                sums.append(total.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = with_spans(docs, F.col("doc_id").cast("long").alias("doc_id"), length=length, gram=gram)
    return found.select("doc_id", "text", "spans").mapInArrow(ta.lean(digested), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _cut(text: np.ndarray, spans: np.ndarray) -> str:
    """The text without ``spans``; a character of which some bytes stay stays whole."""
    keep, at = [], 0
    for first, last in spans.tolist():
        while first < last and text[first] & 0xC0 == 0x80:
            first += 1
        while last > first and last < len(text) and text[last] & 0xC0 == 0x80:
            last -= 1
        keep.append(text[at:first])
        at = last
    return np.concatenate([*keep, text[at:]]).tobytes().decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeats cut out of ``text``, and ``n_chars``, if there is one, counted anew; a null text stays null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(1))
            texts = batch.column(1).to_pylist()
            out = [_cut(data[offsets[i] : offsets[i + 1]], _spans_of(blobs)) if blobs else texts[i] for i, blobs in enumerate(batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], schema=pa.schema([batch.schema.field(0), pa.field("text", pa.string())]))

    row = F.struct(*[docs[c] for c in docs.columns if c != "text"], docs["text"].isNull().alias("_null")).alias("_row")
    found = with_spans(docs, row, length=length, gram=gram).select("_row", "text", "spans")
    texts = found.mapInArrow(ta.lean(cut), found.select("_row", "text").schema)
    new = F.when(~F.col("_row._null"), F.col("text"))
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns if c != "text"} | {"text": new}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(new.isNull(), columns["n_chars"]).otherwise(F.char_length(new)).cast(docs.schema["n_chars"].dataType)
    return texts.select(*[columns[c].alias(c) for c in docs.columns])
