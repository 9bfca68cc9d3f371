"""Near-duplicate detection by BagMinHash signatures of word-shingle multisets, banded, with exact checks of multiset overlap.

A document is a multiset of shingles of ``SHINGLE`` words (all words, if it has fewer). Weights are discretised to counts 1, 2, 3, ...; levels
are arranged in dyadic blocks [0,1), [1,2), [2,4), [4,8), ... Each block of each shingle has a Poisson process whose rate is its number of
levels; a point falls at a time, into one of ``BANDS * ROWS`` components, and onto one level, each of whose bits chooses a half of what is left of the block.
A document sees the points on levels below its count; of the one block per shingle that its count cuts, at most half of the points fall above it and are
drawn in vain (the process is not split in two, which would spare those draws and change no result). Component i of the
signature is the earliest time of its points; it is equal for two documents with a probability of exactly their weighted Jaccard similarity.
Points are made in order of time and a process ends as soon as it is past the latest of its document's current component minima,
so that a shingle of a long document seldom costs more than its first point.

Documents that agree in all ``ROWS`` components of a band share a bucket. Links are verified on whole texts: sum of minima >= 0.8 * sum of maxima.
Members of a bucket are not paired with each other: first each meets the bucket's most central one; components of the verified links are then
contracted, and only buckets that still hold several components go on. There, members outside the largest component become pivots that meet
members of other components, first some and then all that are left, until no pair of different components in a bucket is left that could be a link. What
could be is bounded exactly: a shingle that no other open text has is no part of any minimum, so near copies with many edits of
their own are ruled out by their weights, one by one or as pairs, before anything is compared.

Defined results: equal texts are one class, whatever their ids; a text without words (or null) is a class of its own; a null ``doc_id`` is a member
like any other, and the class id is the smallest id in the class that is not null; repeated rows get equal classes; an empty table gives no rows;
``deduplicate`` keeps the input's columns whatever their names. What decides is compared and not hashed: shingles of verified pairs by the characters of
their words, texts by SHA-256 where their 64-bit hashes agree. Hashes of shingles only choose candidates and bound what could be similar from above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import common, components
from lamina.llm import textarray as ta

SHINGLE, BANDS, ROWS = 5, 25, 4
#: Least similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
_SHINGLE = np.dtype([("hash", "u8"), ("node", "i8"), ("count", "i4")])
_STEP, _COMPONENT, _LEVEL = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _places(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last word of each shingle of rows whose words have these bounds."""
    per_row = np.diff(bounds)
    n = np.where(per_row >= width, per_row - (width - 1), (per_row > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), n)
    first = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(len(row))
    return row, first, np.minimum(first + width, bounds[row + 1])


def exact_shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and count of each row's distinct shingles, sorted by row and number; within a call, shingles have one number if their words are equal by their bytes."""
    starts, ends, bounds = ta.words_by_row(data, offsets)
    row, first, last = _places(bounds, width)
    if not len(row):
        return row, row, row
    at, word, _ = ta.distinct(data, starts, ends)
    # words have numbers from 1 on, 0 stands after the last; as many as fit 62 bits are numbered together
    bits = int(len(at)).bit_length()
    number, used = np.zeros(len(row), np.int64), 0
    for k in range(width):
        if used + bits > 62:
            values, number = np.unique(number, return_inverse=True)
            used = int(len(values)).bit_length()
        place = first + k
        number = (number << bits) | np.where(place < last, word[np.minimum(place, len(word) - 1)] + 1, 0)
        used += bits
    _, number = np.unique(number, return_inverse=True)
    key, counts = np.unique(row * np.int64(number.max() + 1) + number, return_counts=True)
    return key // (number.max() + 1), key % (number.max() + 1), counts


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each row's distinct shingles, sorted by row."""
    starts, ends, bounds = ta.words_by_row(data, offsets)
    words = ta.word_hash(data, starts, ends)
    running = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * ta.powers(len(words))[0][: len(words)], out=running[1:])
    row, first, last = _places(bounds, width)
    hashes = ta.span_hash(running, first, last)
    _, at, counts = np.unique(hashes ^ ta.mix(row.astype(np.uint64) + _LEVEL), return_index=True, return_counts=True)
    order = np.argsort(row[at], kind="stable")
    at = at[order]
    return row[at], hashes[at], counts[order]


def _blocks(counts: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """The dyadic blocks of levels: which shingles reach into each, its first level and its size."""
    which, first, size = np.arange(len(counts)), 0, 1
    while len(which):
        yield which, first, size
        first, size = first + size, (first + size)
        which = which[counts[which] > first]


def signatures(row: np.ndarray, hashes: np.ndarray, counts: np.ndarray, rows: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(rows, m) earliest times; rows without shingles stay infinite."""
    minima = np.full((rows, m), np.inf)
    weight = np.bincount(row, counts, rows)
    parts = [(which, np.full(len(which), first), np.full(len(which), size)) for which, first, size in _blocks(counts)]
    if not parts:
        return minima
    which, first, size = (np.concatenate(p) for p in zip(*parts, strict=True))
    seed = ta.mix(hashes[which] + (first.astype(np.uint64) + np.uint64(1)) * _LEVEL)
    doc, covered, rate = row[which], counts[which] - first, size.astype(float)
    # the time by which most documents have a point in each component; those that have not go on
    bound = m / np.maximum(weight, 1) * (np.log(m) + 1.0)
    time, number = np.zeros(len(seed)), np.zeros(len(seed), np.uint64)
    flat = minima.reshape(-1)

    def arrivals(seed: np.ndarray, number: np.ndarray, rate: np.ndarray) -> np.ndarray:
        draw = (ta.mix(seed + number * _STEP) >> np.uint64(11)).astype(float)
        return -np.log((draw + 0.5) / (1 << 53)) / rate

    time = arrivals(seed, number, rate)
    while True:
        near = np.flatnonzero(time <= bound[doc])
        while len(near):
            s, k, d = seed[near], number[near], doc[near]
            point = ta.mix(s + k * _STEP)
            component = ((ta.mix(point ^ _COMPONENT) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            level = (ta.mix(point ^ _LEVEL) & (size[near] - 1).astype(np.uint64)).astype(np.int64)
            seen = level < covered[near]
            np.minimum.at(flat, d[seen] * m + component[seen], time[near][seen])
            number[near] = k + np.uint64(1)
            time[near] += arrivals(s, number[near], rate[near])
            latest = minima.max(axis=1)
            np.minimum(bound, latest, out=bound)
            near = near[time[near] <= bound[d]]
        open_ = (weight > 0) & np.isinf(minima.max(axis=1))
        if not open_.any():
            return minima
        bound[open_] *= 1.5
        bound[~open_] = -1.0


def band_keys(minima: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents, bands): a 64-bit hash of the band's number and components."""
    bits = minima.view(np.uint64).reshape(len(minima), bands, rows)
    key = np.broadcast_to(ta.mix(np.arange(bands, dtype=np.uint64) + np.uint64(77)), (len(minima), bands)).copy()
    for i in range(rows):
        key = ta.mix(key * _STEP + bits[:, :, i])
    return key


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))


def node_of(text: Column) -> Column:
    return F.xxhash64(text)


def digest_of(text: Column) -> Column:
    return F.sha2(text, 256)


def told_apart(worded: DataFrame, nodes: DataFrame) -> DataFrame | None:
    """(node, digest, other): numbers for texts whose own (of ``nodes``: node, low and high digest) other texts have as well; None if there are none, as in all but huge or crafted tables."""
    meeting = nodes.filter("low <> high").select("node")
    if not meeting.limit(1).count():
        return None
    texts = common.stage(worded.select(node_of(F.col("text")).alias("node"), digest_of(F.col("text")).alias("digest")).join(meeting, "node").distinct(), "meeting")
    salt = 0
    while True:
        odd = texts.withColumn("other", F.xxhash64(F.lit(salt), "digest"))
        taken = nodes.select("node").unionByName(odd.select(F.col("other").alias("node")))
        if not taken.groupBy("node").count().filter("count > 1").limit(1).count():
            return odd
        salt += 1


def with_nodes(rows: DataFrame, odd: DataFrame | None) -> DataFrame:
    """``rows`` (text) with the column ``node``: the number of its text, null for texts without words."""
    own = rows.withColumn("node", F.when(has_words(F.col("text")), node_of(F.col("text"))))
    if odd is None:
        return own
    other = odd.select(F.col("node").alias("_met"), F.col("digest").alias("_digest"), "other")
    joined = own.join(other, (F.col("node") == F.col("_met")) & (digest_of(F.col("text")) == F.col("_digest")), "left")
    return joined.withColumn("node", F.coalesce("other", "node")).drop("_met", "_digest", "other")


def signature_keys(worded: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(node, keys) of every one of ``worded`` (node, text), as often as its text stands; a bucket is a band's key."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(1))
            for a, b in ta.groups(offsets):
                own = offsets[a : b + 1] - offsets[a]
                found = band_keys(signatures(*shingles(data[offsets[a] : offsets[b]], own), b - a, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(found.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["node", "keys"])

    return worded.select("node", "text").mapInArrow(ta.lean(keys), "node long, keys array<long>")


def overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``least``, the sum of minima of their ``texts`` (node, text), and ``similar``: whether that is 0.8 of the sum of maxima."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                nodes, at = np.unique(np.concatenate([a, b]), return_index=True)
                column = pa.chunked_array([part.column(2), part.column(3)]).combine_chunks().take(pa.array(at))
                data, offsets = ta.bytes_of(column)
                row, numbers, counts = exact_shingles(data, offsets)
                bounds = np.searchsorted(row, np.arange(len(nodes) + 1))
                weight = np.bincount(row, counts, len(nodes)).astype(np.int64)
                sums, good = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
                for i, (x, y) in enumerate(zip(np.searchsorted(nodes, a).tolist(), np.searchsorted(nodes, b).tolist(), strict=True)):
                    hx, hy = numbers[bounds[x] : bounds[x + 1]], numbers[bounds[y] : bounds[y + 1]]
                    place = np.searchsorted(hx, hy)
                    place[place == len(hx)] = 0
                    both = hx[place] == hy if len(hx) else np.zeros(len(hy), bool)
                    least = int(np.minimum(counts[bounds[x] + place[both]], counts[bounds[y] + np.flatnonzero(both)]).sum())
                    sums[i] = least
                    good[i] = DENOMINATOR * least >= NUMERATOR * (int(weight[x] + weight[y]) - least) and least > 0
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sums), pa.array(good)], names=["a", "b", "least", "similar"])

    ta_, tb = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(ta_, "a").join(tb, "b").select("a", "b", "text_a", "text_b").mapInArrow(ta.lean(checked), "a long, b long, least long, similar boolean")


_WEIGHT = np.dtype([("node", "i8"), ("w", "i8"), ("s", "i8")])
_BLOB = "kind int, part int, blob binary"


def _blobs(kind: int, parts: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """One packed row for each part."""
    by = np.argsort(parts, kind="stable")
    own = [x for x in np.split(by, np.flatnonzero(np.diff(parts[by])) + 1) if len(x)]
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(own), pa.int32()), pa.array([int(parts[x[0]]) for x in own], pa.int32()), pa.array([rows[x].tobytes() for x in own], pa.binary())], names=["kind", "part", "blob"])


def _weight_rows(node: np.ndarray, w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """One row per node, sums over equal ones."""
    nodes, at = np.unique(node, return_inverse=True)
    out = np.empty(len(nodes), _WEIGHT)
    out["node"], out["w"], out["s"] = nodes, np.bincount(at, w, len(nodes)), np.bincount(at, s, len(nodes))
    return out


def shared_weights(texts: DataFrame) -> DataFrame:
    """(node, w, s): the weight of each text's shingles, and of those that stand in at least one other of ``texts`` as well.

    For any two of the texts, the sum of minima is at most the least s. Shingles go to parts by hash, packed in blobs; a batch that has one
    twice settles it itself and sends one witness on. What is settled goes to parts by node, packed likewise.
    """
    parts = common.shuffle_partitions(texts.sparkSession)

    def by_node(rows: np.ndarray) -> pa.RecordBatch:
        return _blobs(1, (ta.mix(rows["node"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64), rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(1))
            for a, b in ta.groups(offsets, 4 << 20):
                row, hashes, counts = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                node = batch.column(0)[a:b].to_numpy()
                order = np.argsort(hashes, kind="stable")
                row, hashes, counts = row[order], hashes[order], counts[order]
                same = hashes[1:] == hashes[:-1]
                twice, head = np.append(same, False) | np.append(False, same), np.append(True, ~same)
                yield by_node(_weight_rows(node, np.bincount(row, counts, b - a), np.bincount(row[twice], counts[twice], b - a)))
                sent = np.empty(int(head.sum()), _SHINGLE)
                sent["hash"], sent["node"], sent["count"] = hashes[head], node[row[head]], np.where(twice[head], 0, counts[head])
                yield _blobs(0, ((sent["hash"] >> np.uint64(33)) % np.uint64(parts)).astype(np.int64), sent)

    def settle(table: pa.Table) -> pa.Table:
        kind, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        out = [b for b, k in zip(blobs, kind, strict=True) if k == 1]
        result = [pa.RecordBatch.from_arrays([pa.array([1] * len(out), pa.int32()), pa.array([table.column("part")[0].as_py()] * len(out), pa.int32()), pa.array(out, pa.binary())], names=["kind", "part", "blob"])]
        opened = [np.frombuffer(b, _SHINGLE) for b, k in zip(blobs, kind, strict=True) if k == 0]
        if opened:
            rows = np.concatenate(opened)
            rows = rows[np.argsort(rows["hash"], kind="stable")]
            same = rows["hash"][1:] == rows["hash"][:-1]
            rows = rows[np.append(same, False) | np.append(False, same)]
            result.append(by_node(_weight_rows(rows["node"], np.zeros(len(rows)), rows["count"])))
        return pa.Table.from_batches(result)

    def total(table: pa.Table) -> pa.Table:
        rows = np.concatenate([np.frombuffer(b, _WEIGHT) for b in table.column("blob").to_pylist()])
        rows = _weight_rows(rows["node"], rows["w"], rows["s"])
        return pa.table({k: np.ascontiguousarray(rows[k]) for k in ("node", "w", "s")})

    settled = texts.select("node", "text").mapInArrow(ta.lean(send), _BLOB).groupBy("part").applyInArrow(ta.lean(settle), _BLOB)
    return settled.groupBy("part").applyInArrow(ta.lean(total), "node long, w long, s long")


def _may_link(minima: Column) -> Column:
    """Whether a member and a pivot can have ``minima`` as their sum of minima and be similar."""
    return (DENOMINATOR + NUMERATOR) * minima >= NUMERATOR * (F.col("w") + F.col("pivot_w"))


def _central() -> Column:
    """Orders members: those that share most of their weight are likely nearest to what all others are copies of."""
    return F.struct((F.col("s") / F.col("w")).alias("part"), *[F.col(c).alias(c) for c in ("node", "label", "w", "s", "inner")])


def _as_pivots(chosen: DataFrame) -> DataFrame:
    return chosen.select("bucket", *[F.col(f"p.{c}").alias(f"pivot_{c}") for c in ("node", "label", "w", "s", "inner")])


def _tested(met: DataFrame, texts: DataFrame) -> DataFrame:
    pairs = met.select(F.least("node", "pivot_node").alias("a"), F.greatest("node", "pivot_node").alias("b")).distinct()
    return common.stage(overlaps(pairs, texts), "overlaps")


#: Shares of the members outside their bucket's largest component that are pivots in each round, by hash; the last takes all that are left.
_SHARES = (1 / 16, 1.0)


def links(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, label) of the components among the buckets ``shared`` (bucket, band, keys, node), each with at least two nodes."""
    weights = common.stage(shared_weights(texts), "weights")
    rows = shared.join(weights, "node").withColumn("label", F.col("node")).withColumn("inner", F.lit(None).cast("long"))
    # at first each bucket has one pivot, its most central member; ``inner``: what a member shares with it
    pivots = common.stage(_as_pivots(rows.groupBy("bucket").agg(F.max(_central()).alias("p"))), "pivots")
    met = rows.join(pivots, "bucket").filter("node <> pivot_node")
    found = _tested(met.filter(_may_link(F.least("s", "pivot_s"))), texts)
    inner = found.select("a", "b", F.col("least").alias("inner"))
    with_inner = met.drop("inner").withColumn("a", F.least("node", "pivot_node")).withColumn("b", F.greatest("node", "pivot_node")).join(inner, ["a", "b"], "left")
    rows = with_inner.select("bucket", "band", "keys", "node", "w", "s", "inner")
    found = found.filter("similar").select("a", "b")
    labels = components.components(found)
    # of a sum of minima one part lies within the first pivot, the other in shingles outside it that others have as well
    within = F.least("inner", "pivot_inner") + F.least(F.col("s") - F.col("inner"), F.col("pivot_s") - F.col("pivot_inner"))
    bound = F.least(F.col("s"), F.col("pivot_s"), F.when(F.col("inner").isNotNull() & F.col("pivot_inner").isNotNull(), within))
    # two members that share several buckets meet in the first of them
    earlier = F.exists(F.zip_with(F.slice("keys", 1, F.col("band")), F.slice("pivot_keys", 1, F.col("band")), lambda x, y: x == y), lambda same: same)
    for share in _SHARES:
        named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        top = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1").select("bucket", F.col("top.label").alias("top"))
        turn = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) < int(share * (1 << 20))
        rows = common.stage(named.join(top, "bucket").withColumn("is_pivot", (F.col("label") != F.col("top")) & turn).drop("top"), "members")
        pivots = rows.filter("is_pivot").select("bucket", *[F.col(c).alias(f"pivot_{c}") for c in ("node", "label", "w", "s", "inner", "keys")])
        # of two pivots, one meets the other
        fresh = ~F.col("is_pivot") | (F.col("node") < F.col("pivot_node"))
        met = rows.join(pivots, "bucket").filter((F.col("label") != F.col("pivot_label")) & fresh & _may_link(bound) & ~earlier)
        more = _tested(met, texts).filter("similar").select("a", "b")
        if more.limit(1).count():
            found = found.unionByName(more)
            labels = components.components(found)
        # pivots have met all others of their buckets
        rows = rows.filter("NOT is_pivot").drop("label", "is_pivot")
    return labels


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame | None]:
    """Per distinct text with words: node, ``root`` (the class's node of smallest id), ``root_id`` and ``class_id``; and how ``with_nodes`` is to tell texts apart."""
    texts = docs.select("doc_id", "text").filter(has_words(F.col("text")))
    digest = digest_of(F.col("text"))
    nodes = common.stage(texts.groupBy(node_of(F.col("text")).alias("node")).agg(F.min("doc_id").alias("first_id"), F.min(digest).alias("low"), F.max(digest).alias("high")), "nodes")
    odd = told_apart(texts, nodes)
    worded = with_nodes(texts, odd)
    if odd is not None:
        nodes = common.stage(worded.groupBy("node").agg(F.min("doc_id").alias("first_id")), "nodes")
    nodes = nodes.select("node", "first_id")
    # one row for each text before bands are taken apart, so that copies cost a row each and not one for each band
    signed = common.stage(signature_keys(worded, bands, rows).groupBy("node").agg(F.first("keys").alias("keys")), "signatures")
    rows_ = signed.select("node", F.posexplode("keys").alias("band", "bucket"))
    several = rows_.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("bucket")
    shared = common.stage(rows_.join(several, "bucket").join(signed, "node"), "shared")
    wanted = shared.select("node").distinct().join(nodes, "node")
    same = (F.col("t.node") == F.col("w.node")) & F.col("t.doc_id").eqNullSafe(F.col("w.first_id"))
    compared = worded.alias("t").join(wanted.alias("w"), same, "left_semi").select("node", "text")
    labels = links(shared, common.stage(compared, "texts").dropDuplicates(["node"]))
    joined = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"), F.col("node").alias("node"))
    roots = joined.groupBy("label").agg(F.min(order).alias("root"))
    return common.stage(joined.join(roots, "label").select("node", "first_id", F.col("root.node").alias("root"), F.col("root.id").alias("class_id")), "classes"), odd


def assign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, class_id."""
    found, odd = classes(docs, bands, rows)
    own = with_nodes(docs.select("doc_id", "text"), odd).select("doc_id", "node")
    joined = own.join(found.select("node", "class_id"), "node", "left")
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).cast("long").alias("class_id"))


def deduplicate(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row of each class, that of its smallest id; rows without words stay."""
    found, odd = classes(docs, bands, rows)
    heads = found.filter("node = root").select(F.col("node").alias("_head"), F.col("class_id").alias("_id"))
    own = with_nodes(docs.select(F.struct(*docs.columns).alias("_row"), docs["text"].alias("text"), docs["doc_id"].alias("_doc")), odd).drop("text")
    kept = own.join(heads, (F.col("node") == F.col("_head")) & F.col("_doc").eqNullSafe(F.col("_id")))
    # of rows of equal text and id one stays, whichever; tasks choose among their own first
    kept = kept.groupBy("node", "_doc").agg(F.first("_row").alias("_row")).select("_row.*")
    return kept.unionByName(own.filter("node IS NULL").select("_row.*"))
