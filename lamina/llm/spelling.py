"""Grouping of spelling variants by a symmetric-delete join.

Words are counted over all texts. Every word emits itself and its distinct single deletions as keys; words that share a key are joined and held
against each other exactly: they are near if one character is inserted, deleted or replaced. A word's form is its most frequent near word, if that is
at least ``DOMINANCE`` times as frequent; forms are followed to the last by joins that double the way (counts grow along it, so it ends).

Two words that are near share exactly one key: that of equal length have only one common deletion, that of lengths one apart share the shorter word.
So each near pair is met once. Words of up to ``SHORT`` characters carry themselves to their keys; longer ones, whose deletions
would be as long as they are, send 64-bit hashes of deletions with the places that give them, and words are looked up for what has met only. Pairs of which one word is longer than ``SHORT`` come from
there, all others from the strings. A key has at most as many words as there are characters to insert at each of its places.

Defined results: null texts have no words, a null ``doc_id`` counts as the empty string, every row is counted, repeated ones too; an empty table, or one without words often
enough, gives no rows; other columns play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm import textarray as ta

#: Of the runs, those whose checksum with their document this divides lose a character.
NOISE = 199
LEAST_LENGTH, LEAST_COUNT, DOMINANCE = 6, 5, 5
SHORT = 48
_HELD = 300_000
_LEAD = 0xC3


def _crc_steps() -> np.ndarray:
    """The remainder of each byte moved out of the register, from the checksum's polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_STEPS = _crc_steps()


def checksums(data: np.ndarray, first: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of each span of bytes after the text whose crc32 is ``before``: symbol by symbol, over all spans at once."""
    state, length = ~before.astype(np.uint32), end - first
    order = np.argsort(-np.minimum(length, 65), kind="stable")
    at, sizes, out = first[order], length[order], state[order]
    reach = np.searchsorted(-sizes, -np.arange(1, 65), "right")
    for k, m in enumerate(reach[reach > 0].tolist()):
        out[:m] = _STEPS[(out[:m] ^ data[at[:m] + k]) & 0xFF] ^ (out[:m] >> np.uint32(8))
    out = ~out
    for i in np.flatnonzero(sizes > 64).tolist():
        out[i] = zlib.crc32(data[at[i] + 64 : at[i] + sizes[i]].tobytes(), int(out[i]))
    result = np.empty_like(out)
    result[order] = out
    return result


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and lengths in code points of the maximal runs of A-Z, a-z and U+00C0 to U+00FF in lower-cased UTF-8; none crosses two texts."""
    small = (data >= 0x61) & (data <= 0x7A)
    lead = data == _LEAD
    inside = small | lead
    inside[1:] |= lead[:-1]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    start[heads] = inside[heads]
    first = np.flatnonzero(start)
    stop = np.append(inside[:-1] & ~inside[1:], inside[-1:])
    tails = offsets[1:][(offsets[1:] > 0)] - 1
    if len(data):
        stop[tails] = inside[tails]
    end = np.flatnonzero(stop) + 1
    two = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=two[1:])
    return first, end, end - first - (two[end] - two[first])


def _small(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)


def _words(data: np.ndarray, offsets: np.ndarray, ids: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of at least ``LEAST_LENGTH`` characters of some texts, and their counts."""
    data = _small(data)
    first, end, length = runs(data, offsets)
    kept = length >= LEAST_LENGTH
    first, end, length = first[kept], end[kept], length[kept]
    before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    sums = checksums(data, first, end, before[np.searchsorted(offsets, first, "right") - 1])
    noisy = sums % np.uint32(NOISE) == 0
    changed: list[bytes] = []
    for a, b, n, h in zip(first[noisy].tolist(), end[noisy].tolist(), length[noisy].tolist(), sums[noisy].tolist(), strict=True):
        if n > LEAST_LENGTH:
            run = data[a:b].tobytes().decode()
            changed.append((run[: h % n] + run[h % n + 1 :]).encode())
    more = np.frombuffer(b"".join(changed), np.uint8)
    sizes = np.cumsum([0, *map(len, changed)])
    data = np.concatenate([data, more])
    shift = len(data) - len(more)
    first, end = (np.concatenate([x[~noisy], y + shift]) for x, y in ((first, sizes[:-1]), (end, sizes[1:])))
    if not len(first):
        return [], np.zeros(0, np.int64)
    at, inverse, _ = ta.distinct(data, first, end)
    return [data[a:b].tobytes() for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)], np.bincount(inverse, minlength=len(at))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur at least ``LEAST_COUNT`` times; workers add up before the shuffle, holding about ``_HELD`` words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in held], pa.string())
            counts = pa.array(list(held.values()), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([words, counts], names=["word", "n"])

        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in ta.groups(offsets, 4 << 20):
                words, counts = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ids[a:b])
                for word, n in zip(words, counts.tolist(), strict=True):
                    held[word] = held.get(word, 0) + n
                if len(held) > _HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("doc_id"), docs["text"].cast("string").alias("text"))
    found = rows.mapInArrow(ta.lean(counted), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def deletions(word: Column) -> Column:
    """The distinct strings that ``word`` gives without one of its characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))))


def _short_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of near words, a < b, neither longer than ``SHORT``."""
    own = words.filter(F.length("word") <= SHORT)
    # ``own``: whether the key is the word itself; such a key meets deletions only
    keys = own.select("word", F.lit(True).alias("own"), F.col("word").alias("key")).unionByName(own.select("word", F.lit(False).alias("own"), F.explode(deletions(F.col("word"))).alias("key")))
    x, y = keys.alias("x"), keys.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.word") < F.col("y.word")))
    near = F.col("x.own") | F.col("y.own") | (F.levenshtein("x.word", "y.word", 1) == 1)
    return met.filter(near).select(F.col("x.word").alias("a"), F.col("y.word").alias("b"))


_KEY = np.dtype([("key", "i8"), ("lo", "i4"), ("hi", "i4")])


def _long_keys(word: str) -> np.ndarray:
    """Keys of a word's distinct deletions, each with the first and the last place that gives it; the word's own key has place -1."""
    codes = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    n = len(codes)
    running, (power, inverse) = ta.prefix_hash(codes), ta.powers(n)
    edge = np.append(True, codes[1:] != codes[:-1])
    lo = np.flatnonzero(edge)
    hi = np.append(lo[1:], n) - 1
    # what follows the place moves one to the left
    moved = (running[n] - running[lo + 1]) * inverse[1]
    out = np.empty(len(lo) + 1, _KEY)
    out["key"][0], out["lo"][0], out["hi"][0] = (running[n : n + 1] * power[1]).view(np.int64)[0], -1, -1
    out["key"][1:], out["lo"][1:], out["hi"][1:] = ((running[lo] + moved) * power[1]).view(np.int64), lo, hi
    return out


def _long_pairs(words: DataFrame) -> DataFrame:
    """(a, b) of near words, a < b, of which at least one is longer than ``SHORT``."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _long_keys(word)
                for at in range(0, len(found), 65_536):
                    part = found[at : at + 65_536]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array([node] * n, pa.string()), pa.array([len(word)] * n, pa.int32()), *(pa.array(np.ascontiguousarray(part[c])) for c in ("key", "lo", "hi"))], names=["node", "size", "key", "lo", "hi"])

    long = words.filter(F.length("word") >= SHORT).select(F.sha2("word", 256).alias("node"), "word")
    sent = long.mapInArrow(ta.lean(keys), "node string, size int, key long, lo int, hi int")
    x, y = sent.alias("x"), sent.alias("y")
    size_x, size_y = F.col("x.size"), F.col("y.size")
    # places of x and y that give the same deletion overlap if and only if one replacement leads from one to the other
    replaced = (size_x == size_y) & (F.col("x.lo") >= 0) & (F.col("y.lo") >= 0) & (F.col("x.lo") <= F.col("y.hi")) & (F.col("y.lo") <= F.col("x.hi"))
    shorter = (size_x + 1 == size_y) & (F.col("x.lo") < 0) & (F.col("y.lo") >= 0)
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.node") != F.col("y.node")) & (((F.col("x.node") < F.col("y.node")) & replaced) | shorter))
    pairs = met.filter(F.greatest(size_x, size_y) > SHORT).select(F.col("x.node").alias("x"), F.col("y.node").alias("y")).distinct()
    named = pairs.join(long.select(F.col("node").alias("x"), F.col("word").alias("wx")), "x").join(long.select(F.col("node").alias("y"), F.col("word").alias("wy")), "y")
    return named.filter(F.levenshtein("wx", "wy", 1) == 1).select(F.least("wx", "wy").alias("a"), F.greatest("wx", "wy").alias("b"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b, each once, of all ``words`` (word) that differ by one inserted, deleted or replaced character."""
    return _short_pairs(words).unionByName(_long_pairs(words))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form (word, form): each step follows forms twice as far."""
    up = common.stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        higher = up.select(F.col("word").alias("root"), F.col("root").alias("higher"))
        jumped = common.stage(up.join(higher, "root", "left").select("word", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "spelling-roots")
        up = jumped.select("word", "root")
        if not jumped.filter("moved").limit(1).count():
            return up


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs`` (doc_id, text)."""
    words = common.stage(count_words(docs), "spelling-words")
    pairs = common.stage(near_pairs(words.select("word")), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # the greatest count, of equal ones the smallest word
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    joined = words.join(best, "word", "left")
    often = -F.col("best.less") >= DOMINANCE * F.col("n")
    named = common.stage(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(named.filter("form IS NOT NULL").select("word", "form"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
