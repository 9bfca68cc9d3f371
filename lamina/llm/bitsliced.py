"""Exact top-k by inner product on a bit-sliced index.

Candidates are cut into blocks. Each block keeps, for every dimension, the bit slices of its quantised components: slice j is a bitmap that has
a bit for each row of the block, shifted so that all values are non-negative. For a query the slices are added up in bitmap arithmetic: a
dimension's slices enter the sum once for each set bit of the query's quantised component, at the place of the product, by ripple-carry
adders over whole bitmaps; negative components go into a second sum, subtracted at the end. The result is a bit-sliced score of every row.
Selection goes from the most significant slice down: rows with the bit set are all taken as long as they are no more than k, else the rest are
out; what is left at the last slice are the rows of the boundary score.

Quantised scores leave out low bits, so a row's score differs from its quantised one by at most a known bound. All rows whose bounds reach the
k-th best lower bound are resolved by exact integer inner products; so results are exact whatever the number of slices.

Defined results: rows whose vector or id is null, that are empty or hold a null or non-finite component, take no part;
vectors meet those of their own length only; a row is not its own candidate, nor is any other row of the same id; ties go to the smaller id and repeated ids are each listed,
and a repeated query has k rows for each time it stands; components of any finite size take part exactly (where sums do not fit into 64 bits, the bitmaps are
made from whole numbers of any length), and a score beyond 64 bits is given as the nearest number of 64 bits, by which it is ranked; fewer candidates than k give as many rows; an empty table gives none; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm import common
from lamina.llm import textarray as ta

BLOCK, QUERIES = 32_768, 64
#: Low bits left out of candidates' components and of the query's in the slices; with none left out, slices are exact already.
CANDIDATE_SHIFT, QUERY_SHIFT = 0, 0


_MOST = (1 << 63) - 1
_LARGEST = float(np.finfo(float).max)


def whole(values: np.ndarray, other: float) -> np.ndarray:
    """Integers from whole-numbered doubles: of 64 bits where inner products with components up to ``other`` fit into them, else of any length."""
    if max(float(np.abs(values).max(initial=0)), 1.0) * max(other, 1.0) * max(values.shape[-1], 1) < 2.0**61:
        return values.astype(np.int64)
    return np.array([int(x) for x in values.reshape(-1)], object).reshape(values.shape)


class Slices:
    """The bit-sliced index of a block of integer vectors (rows, dimensions)."""

    def __init__(self, values: np.ndarray, shift: int = CANDIDATE_SHIFT):
        self.values, self.n = values, len(values)
        coarse = values >> shift
        self.low = coarse.min(axis=0)
        shifted = (coarse - self.low).T
        self.widths = [int(x).bit_length() for x in shifted.max(axis=1)]
        words = -(-self.n // 64)
        self.words, self.shift = words, shift

        def bitmap(bits: np.ndarray) -> np.ndarray:
            padded = np.zeros(words * 64, np.uint8)
            padded[: self.n] = bits
            return np.packbits(padded, bitorder="little").view(np.uint64)

        self.slices = [[bitmap((column >> j) & 1) for j in range(width)] for column, width in zip(shifted, self.widths, strict=True)]

    def _add(self, total: list[np.ndarray], part: list[np.ndarray], at: int) -> None:
        """total += part << at, slice by slice with carries."""
        carry = None
        for j, x in enumerate(part):
            place = at + j
            while len(total) <= place:
                total.append(np.zeros(self.words, np.uint64))
            y = total[place]
            both = x ^ y
            if carry is None:
                total[place], carry = both, x & y
            else:
                total[place], carry = both ^ carry, (x & y) | (carry & both)
        place = at + len(part)
        while carry is not None and carry.any():
            if len(total) <= place:
                total.append(carry)
                return
            total[place], carry = total[place] ^ carry, total[place] & carry
            place += 1

    def scores(self, query: np.ndarray, shift: int = QUERY_SHIFT) -> tuple[list[np.ndarray], int]:
        """Bit slices of the quantised scores, all shifted to be non-negative, and the constant to add to them."""
        coarse = query >> shift
        constant = int((coarse * self.low).sum())
        plus: list[np.ndarray] = []
        minus: list[np.ndarray] = []
        for weight, part in zip(coarse.tolist(), self.slices, strict=True):
            side, size, at = (plus, weight, 0) if weight >= 0 else (minus, -weight, 0)
            while size:
                if size & 1:
                    self._add(side, part, at)
                size >>= 1
                at += 1
        width = max(len(plus), len(minus)) + 1
        if minus:
            # plus + (2**width - 1 - minus) = plus - minus + 2**width - 1
            ones = [~m for m in minus] + [np.full(self.words, ~np.uint64(0))] * (width - len(minus))
            self._add(plus, ones, 0)
            constant -= (1 << width) - 1
        return plus, constant

    def bits(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])

    def _valid(self) -> np.ndarray:
        valid = np.zeros(self.words * 64, np.uint8)
        valid[: self.n] = 1
        return np.packbits(valid, bitorder="little").view(np.uint64)

    def select(self, slices: list[np.ndarray], k: int) -> tuple[np.ndarray, int]:
        """The bitmap of rows that certainly are among the top k, with all those tied at the boundary; and the boundary's score."""
        taken, tied, boundary = np.zeros(self.words, np.uint64), self._valid(), 0
        for j in range(len(slices) - 1, -1, -1):
            high = tied & slices[j]
            n = int(np.bitwise_count(taken | high).sum())
            if n >= k:
                tied = high
                boundary |= 1 << j
            else:
                taken |= high
                tied &= ~slices[j]
        return taken | tied, boundary

    def at_least(self, slices: list[np.ndarray], least: int) -> np.ndarray:
        """The bitmap of rows whose score is at least ``least``."""
        valid = self._valid()
        if least <= 0:
            return valid
        if least.bit_length() > len(slices):
            return np.zeros(self.words, np.uint64)
        above, tied = np.zeros(self.words, np.uint64), valid
        for j in range(len(slices) - 1, -1, -1):
            if least >> j & 1:
                tied = tied & slices[j]
            else:
                above |= tied & slices[j]
                tied = tied & ~slices[j]
        return above | tied

    def top(self, query: np.ndarray, k: int, t: int = QUERY_SHIFT) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best exact scores, with all ties of the last, and the scores."""
        slices, constant = self.scores(query, t)
        _, boundary = self.select(slices, min(k, self.n))
        # scores that are beyond 64 bits are equal
        boundary = min(boundary, (_MOST >> (self.shift + t)) - constant) if boundary + constant > -(_MOST >> (self.shift + t)) else 0
        # x = (cx << s) + rx with 0 <= rx < 2**s, likewise q: q.x - (cq.cx << s + t) = sum((cq << t) rx + rq x), bounded per query
        s = self.shift
        coarse = (query >> t) << t
        rest = query - coarse
        most = np.where(coarse > 0, coarse * ((1 << s) - 1), 0).sum() + (rest * self.values.max(axis=0)).sum()
        least = np.where(coarse < 0, coarse * ((1 << s) - 1), 0).sum() + (rest * self.values.min(axis=0)).sum()
        slack = (int(most - least) >> (s + t)) + 1 if most > least else 0
        rows = self.bits(self.at_least(slices, boundary - slack))
        exact = np.minimum(np.maximum(self.values[rows] @ query, -_MOST - 1), _MOST).astype(np.int64)
        if len(rows) > k:
            kth = np.partition(exact, len(exact) - k)[len(exact) - k]
            rows, exact = rows[exact >= kth], exact[exact >= kth]
        return rows, exact


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and ``v`` array<double> = floor(scale * x), whole numbers, of the rows that take part."""
    scaled = lambda x: F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(-_LARGEST)), F.lit(_LARGEST))
    # doubles of that size are whole
    v = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    finite = F.forall("embedding", lambda x: F.coalesce((F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).filter(finite).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _packed(vectors: DataFrame, rows: int, blocks: int) -> DataFrame:
    """(block, ids binary, values binary): rows dealt to blocks by hash, so none grows with a hot key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, sizes = [], [], 0

        def out() -> pa.RecordBatch:
            width = len(values[0][0])
            i, v = np.concatenate(ids), np.concatenate(values)
            ids.clear()
            values.clear()
            return pa.RecordBatch.from_arrays([pa.array([i.astype("<i8").tobytes()]), pa.array([v.astype("<f4" if (v == v.astype("<f4")).all() else "<f8").tobytes()]), pa.array([width], pa.int32())], names=["ids", "vectors", "width"])

        for batch in batches:
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                own = lengths[first : first + rows]
                for width in np.unique(own):
                    keep = pa.array(own == width)
                    chosen = part.filter(keep)
                    v = chosen.column(1).flatten().to_numpy().reshape(-1, width)
                    if values and len(values[0][0]) != width or sizes + len(v) > rows and values:
                        yield out()
                        sizes = 0
                    if width:
                        ids.append(chosen.column(0).to_numpy())
                        values.append(v)
                        sizes += len(v)
        if values:
            yield out()

    packed = vectors.repartition(blocks).mapInArrow(ta.lean(pack), "ids binary, vectors binary, width int")
    return common.stage(packed.withColumn("number", F.monotonically_increasing_id()), "blocks")


def _doubles(ids: bytes, values: bytes, width: int) -> np.ndarray:
    """A packed block's vectors; they are of four bytes where that is exact."""
    return np.frombuffer(values, "<f4" if len(values) * 2 == len(ids) * width else "<f8").reshape(-1, width).astype(float)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each of ``queries`` (vec_id, v) its k best among ``vectors`` (vec_id, v): query_id, rank, vec_id, score.

    Both sides are packed into blocks; every block of candidates meets every block of the stated queries, and gives at most k rows
    for each query. Query blocks are sent to each candidate block by its number; few candidate blocks are sent out several times, each for a
    share of the queries, so that all cores have work. No side is broadcast.
    """
    parts = common.shuffle_partitions(vectors.sparkSession)
    left = _packed(vectors, BLOCK, max(1, -(-vectors.count() // BLOCK)))
    right = _packed(queries, QUERIES, max(1, -(-queries.count() // QUERIES)))
    copies = max(1, min(2 * parts // max(1, left.count()), right.count()))
    numbers = left.select("number", "width")
    asked = right.select("width", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"), F.col("number").alias("query_block"), F.pmod(F.xxhash64("number"), F.lit(copies)).cast("int").alias("share"))
    if numbers.count() < 10_000:
        sent = asked.join(F.broadcast(numbers), "width")
    else:
        # nearly all blocks have one width: query blocks are dealt out over the parts, each of which gets all blocks' numbers
        dealt_out = F.pmod(F.xxhash64("query_block"), F.lit(parts)).cast("int")
        sent = asked.withColumn("salt", dealt_out).join(numbers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["width", "salt"])
    asked = sent.select("number", "share", "query_ids", "query_vectors", "query_block")
    dealt = left.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    met = dealt.join(asked.hint("shuffle_merge"), ["number", "share"]).select("ids", "vectors", "width", "query_ids", "query_vectors", "query_block")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (b"", None, None)
        for batch in batches:
            for ids, values, width, query_ids, query_values, query_block in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                asked_for, own, doubles = _doubles(query_ids, query_values, width), np.frombuffer(ids, "<i8"), _doubles(ids, values, width)
                asked_for = whole(asked_for, float(np.abs(doubles).max(initial=0)))
                kind = asked_for.dtype
                if known[0] != values or known[1] != kind:
                    known = (values, kind, Slices(doubles.astype(np.int64) if kind != object else whole(doubles, float("inf"))))
                index = known[2]
                found: list[tuple[np.ndarray, ...]] = []
                for place, (q, v) in enumerate(zip(np.frombuffer(query_ids, "<i8").tolist(), asked_for, strict=True)):
                    same = int((own == q).sum())
                    rows, scores = index.top(v, k + same)
                    other = own[rows] != q
                    rows, scores = rows[other], scores[other]
                    order = np.lexsort((own[rows], -scores))[:k] if kind != object else np.array(sorted(range(len(rows)), key=lambda i: (-int(scores[i]), own[rows[i]]))[:k], np.int64)  # noqa: B023
                    found.append((np.full(len(order), q), own[rows[order]], scores[order], np.full(len(order), query_block), np.full(len(order), place)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score", "query_block", "place"])

    every = met.mapInArrow(ta.lean(best), "query_id long, vec_id long, score long, query_block long, place long")
    rank = F.row_number().over(Window.partitionBy("query_block", "place").orderBy(F.desc("score"), "vec_id"))
    return every.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
