"""Language-model scoring by masked pseudo-likelihood with a bidirectional window network.

Words (runs of other than space and 09 to 0D) are counted over all documents. The most frequent ones have ids of their own, the rest share a
quarter of the ids by hash. There are as many ids as give each word that occurs ``OWN`` times its own, from ``WORDS`` to ``MOST_WORDS``, which bounds
the model that each task sends. A sharing word's probability is its id's times its own count's share of the id's, so every word of the corpus counts as
often as it occurs and probabilities sum to one over the corpus's words; as context, words of one id look alike. The network sees the ``REACH`` words on either side of a hidden one: each position has its own embedding table, the sum
goes through tanh, and a two-level softmax gives the class and the word within it. Training hides every position of every
document in one of its rounds; each task (of at least about ``TASK_WORDS`` words) runs Adagrad from the common parameters over all of its documents,
and the results are averaged by tokens in a tree, so what training gathers grows with the corpus while the model does not. A document's score is the sum,
over all its words, of the log probability of the word given both sides.

Defined results: null and empty texts have no words, the score 0 and no mean; words at a text's ends see padding; repeated rows are scored alike
and count as often as they stand; a null ``doc_id`` stays null; an empty table gives no rows (the untrained network is uniform); other columns play no
part. Texts of any length are scored whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm import textarray as ta

WORDS, MOST_WORDS, OWN = 2048, 8192, 50
REACH, WIDTH = 2, 32
ROUNDS, RATE, STEP = 2, 0.15, 4096
#: Words of a document that are hidden in the same round.
_RUN = 256
_OFFSETS = tuple(o for o in range(-REACH, REACH + 1) if o)
_CHUNK = 16_384
#: Words whose outputs stay in a core's cache together.
_CACHED = 4096
#: Words whose classes' members are taken together.
_TOGETHER = 1536
#: Words whose embeddings move together, and places of a word from which on they are added up in one product.
_MOVED, _OFTEN = 1024, 8
_HELD = 400_000
#: Bytes whose words are hashed together: the arrays of twice as many are big enough to be given back to the system and cleared again each time.
_HASHED = 1 << 17


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, bounds = ta.words_by_row(data, offsets)
    return ta.word_hash(data, starts, ends).view(np.int64), bounds


def _by_part(words: np.ndarray, values: np.ndarray, parts: int) -> tuple[np.ndarray, list[pa.Array]]:
    """The parts that words go to by hash, and per part its words and their values, packed in the order in which they stand."""
    part = (ta.mix(words.view(np.uint64)) >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    return full.astype(np.int32), [pa.array([x[bounds[p] : bounds[p + 1]].tobytes() for p in full], pa.binary()) for x in (words[order], values[order])]


def count_words(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(word, n): 64-bit hashes of words and their counts over all documents; workers add up before the shuffle, which packs them by part."""
    dealt_to = parts or common.parts_for(docs, 16 << 20)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        words, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        words, inverse = np.unique(words, return_inverse=True)
        return words, np.bincount(inverse, n).astype(np.int64)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            part, blobs = _by_part(*merged(held), dealt_to)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(part), *blobs], names=["part", "words", "n"])

        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(0))
            for a, b in ta.groups(offsets, _HASHED):
                held.append(np.unique(_word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[0], return_counts=True))
                if sum(len(w) for w, _ in held) > _HELD:
                    held[:] = [merged(held)]
                    if len(held[0][0]) > _HELD // 2:
                        yield out()
        if held:
            yield out()

    def summed(table: pa.Table) -> pa.Table:
        words, n = (np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in table.column(c)]) for c in ("words", "n"))
        return pa.table(dict(zip(("word", "n"), merged([(words, n)]), strict=True)))

    return docs.select("text").mapInArrow(ta.lean(counts), "part int, words binary, n binary").groupBy("part").applyInArrow(ta.lean(summed), "word long, n long")


def rare_ids(size: int) -> int:
    """How many of ``size`` ids are shared."""
    return size // 4


class _Places:
    """Where words (hashes) are in an array of such that rises: a table by their first bits says where to begin."""

    def __init__(self, words: np.ndarray):
        self.words, bits = np.append(words, np.iinfo(np.int64).max), len(words).bit_length() + 3
        self.shift = np.uint64(64 - bits)
        self.first = np.append(0, np.cumsum(np.bincount(self._key(words), minlength=1 << bits)))

    def _key(self, words: np.ndarray) -> np.ndarray:
        return ((words.view(np.uint64) ^ np.uint64(1 << 63)) >> self.shift).view(np.int64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        """As ``np.searchsorted``."""
        place = self.first.take(self._key(words))
        on = np.flatnonzero(self.words.take(place) < words)
        while len(on):
            place[on] += 1
            on = on[self.words[place[on]] < words[on]]
        return place


class Vocabulary:
    """Ids 0 .. size - 1: the frequent words by falling count, then the shared ones."""

    def __init__(self, frequent: list[int], totals: list[int]):
        self.own, self.size = len(frequent), len(totals)
        order = np.argsort(np.array(frequent, np.int64), kind="stable")
        self.sorted, self.ids = np.array(frequent, np.int64)[order], order.astype(np.uint16)
        self.places: _Places | None = None
        self.unigram = np.array(totals, float)
        #: What a shared id's log probability is lowered by before a word's own log count is added.
        self.log_total = np.zeros(self.size)
        shared = slice(self.size - rare_ids(self.size), None)
        self.log_total[shared] = np.log(np.maximum(self.unigram[shared], 1))

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and which of the words share theirs."""
        self.places = self.places or _Places(self.sorted)
        rare, place = np.uint64(rare_ids(self.size)), self.places(hashes)
        sharing = self.places.words.take(place) != hashes
        sharing |= place == self.own
        out = np.append(self.ids, np.uint16(0)).take(place)
        out[sharing] = self.size - int(rare) + (ta.mix(hashes[sharing].view(np.uint64)) % rare).astype(np.int64)
        return out, sharing


def build_vocabulary(counts: DataFrame) -> Vocabulary:
    """At most ``MOST_WORDS`` numbers reach the driver: the frequent words, and how often each shared id's words occur."""
    often, size = counts.filter(F.col("n") >= OWN).count(), WORDS
    while size < MOST_WORDS and size - rare_ids(size) < often:
        size *= 2
    rare = rare_ids(size)
    frequent = sorted(((r.word, r.n) for r in common.most_frequent(counts, size - rare).collect()), key=lambda x: (-x[1], x[0]))
    known = np.sort(np.array([w for w, _ in frequent], np.int64))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(rare, np.int64)
        for batch in batches:
            h, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sharing = ~np.isin(h, known)
            np.add.at(total, (ta.mix(h[sharing].view(np.uint64)) % np.uint64(rare)).astype(np.int64), n[sharing])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rare)), pa.array(total)], names=["slot", "n"])

    totals = [n for _, n in frequent] + [0] * (size - len(frequent))
    for r in counts.mapInArrow(ta.lean(slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        totals[size - rare + r.slot] = r.n
    return Vocabulary([w for w, _ in frequent], totals)


def _tanh(z: np.ndarray) -> np.ndarray:
    """In place, by exponentials: 1 - 2 / (1 + exp(2z)), to 1e-7, faster than NumPy's own."""
    z += z
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    z += 1
    np.divide(-2, z, out=z)
    z += 1
    return z


def _exponentials(x: np.ndarray, fill: Callable[[np.ndarray], object]) -> tuple[np.ndarray, np.ndarray | float]:
    """The sums of the rows' exponentials, as a column, and what was taken off the rows first; the exponentials are left in place of ``x``.

    Rows have their largest taken off only where exponentials turn out too large or all too small; ``fill`` makes ``x`` again for that.
    """
    ones, top = np.ones((x.shape[1], 1), np.float32), 0.0
    with np.errstate(over="ignore", invalid="ignore"):
        sums = np.exp(x, out=x) @ ones
    if not (sums.min() > 1e-30 and sums.max() < 1e30):
        fill(x)
        top = x.max(axis=1, keepdims=True)
        x -= top
        sums = np.exp(x, out=x) @ ones
    return sums, top


def _cells(x: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` in one line, and where each row's ``which`` is in it."""
    return x.reshape(-1), which + np.arange(0, x.size, x.shape[1])


def _log_of(x: np.ndarray, which: np.ndarray, fill: Callable[[np.ndarray], object]) -> np.ndarray:
    """Each row's log softmax at its ``which``; ``x`` is used up."""
    line, cells = _cells(x, which)
    got = line.take(cells)
    sums, top = _exponentials(x, fill)
    return got - np.ravel(top) - np.log(sums[:, 0])


def _softmax_error(x: np.ndarray, which: np.ndarray, n: int, fill: Callable[[np.ndarray], object]) -> np.ndarray:
    """The gradient of -log softmax at ``which`` over ``n``, in place of ``x``, whose rows are words."""
    x *= 1 / (_exponentials(x, fill)[0] * np.float32(n))
    line, cells = _cells(x, which)
    line[cells] -= np.float32(1 / n)
    return x


def _shapes(words: int) -> dict[str, tuple[int, ...]]:
    classes = 1 << (words.bit_length() - 1) // 2
    members = words // classes
    return {"tables": (words + 1, len(_OFFSETS), WIDTH), "bias": (WIDTH,), "class_layer": (WIDTH + 1, classes), "member_layers": (classes, WIDTH + 1, members)}


class Network:
    """Parameters in one float32 vector, with views of its parts. Id ``words`` is padding. A word's class is its id modulo ``classes``.

    A word's embeddings at all positions lie side by side, and a layer's biases are its last row, so that each is read and moved at once.
    """

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        self.words = next(w for w in (WORDS << i for i in range(17)) if self.size(w) >= len(flat))
        for name, shape in _shapes(self.words).items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size
        self.context = self.tables.swapaxes(0, 1)
        self.to_class, self.class_bias = self.class_layer[:-1], self.class_layer[-1]
        self.to_member, self.member_bias = self.member_layers[:, :-1], self.member_layers[:, -1]
        self.classes, _, self.members = self.to_member.shape

    @classmethod
    def size(cls, words: int = WORDS) -> int:
        return sum(int(np.prod(s)) for s in _shapes(words).values())

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 7) -> Network:
        """Small random embeddings; output biases at the words' own frequencies."""
        net = cls(np.zeros(cls.size(len(unigram)), np.float32))
        rng = np.random.default_rng(seed)
        net.context[:] = rng.normal(0, 0.1, net.context.shape)
        p = (unigram + 0.5) / (unigram + 0.5).sum()
        by_class = p.reshape(net.members, net.classes).T
        net.class_bias[:] = np.log(by_class.sum(axis=1))
        net.member_bias[:] = np.log(by_class)
        return net

    def hidden(self, first: np.ndarray, at: np.ndarray, z: np.ndarray) -> np.ndarray:
        """In ``z``, the hidden values of the words at ``at``; ``first`` holds the numbers of each place's first embedding."""
        rows, near = self.tables.reshape(-1, WIDTH), np.empty_like(z)
        for j, o in enumerate(_OFFSETS):
            # every id has its row: clipping only spares a copy
            rows[j:].take(first[at + o], axis=0, out=near if j else z, mode="clip")
            if j:
                z += near
        z += self.bias
        return _tanh(z)

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """The order that sorts words by class, their classes and members in it, and where each class begins."""
        kind = (target % self.classes).astype(np.uint16)
        order = np.argsort(kind, kind="stable")
        kind = kind[order].astype(np.intp)
        return order, kind, (target // self.classes)[order].astype(np.intp), np.searchsorted(kind, np.arange(self.classes + 1)).tolist()

    def _with_ones(self, first: np.ndarray, at: np.ndarray, z: np.ndarray, out: np.ndarray) -> np.ndarray:
        """In ``z`` the hidden values of each word, in ``out`` the same as a row that ends with a one."""
        out[:, :-1] = self.hidden(first, at, z)
        out[:, -1] = 1
        return out

    def _together(self, bounds: list[int]) -> Iterator[range]:
        """Some classes at a time that have few words together."""
        first = 0
        while first < self.classes:
            last = min(max(first + 1, bisect_right(bounds, bounds[first] + _TOGETHER) - 1), self.classes)
            if bounds[last] > bounds[first]:
                yield range(first, last)
            first = last

    def _member_outputs(self, h: np.ndarray, bounds: list[int], classes: range, out: np.ndarray) -> np.ndarray:
        """In ``out``, the outputs of the members of ``classes`` for these classes' words."""
        start = bounds[classes.start]
        for c in classes:
            a, b = bounds[c], bounds[c + 1]
            if b > a:
                np.dot(h[a:b], self.member_layers[c], out=out[a - start : b - start])
        return out

    def log_probabilities(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the word at each of ``at``, given those around it."""
        out = np.empty(len(at))
        for first in range(0, len(at), _CHUNK):
            own = at[first : first + _CHUNK]
            low, high = int(own.min()) - REACH, int(own.max()) + REACH + 1
            order, kind, member, bounds = self._by_class(padded[own])
            place, h, got = own[order] - low, np.empty((len(own), WIDTH + 1), np.float32), np.empty(len(own))
            z = np.empty((_CACHED, WIDTH), np.float32)
            numbers = padded[low:high].astype(np.intp) * len(_OFFSETS)
            for begin in range(0, len(own), _CACHED):
                some = slice(begin, begin + _CACHED)
                part = self._with_ones(numbers, place[some], z[: len(place[some])], h[some])
                got[some] = _log_of(part @ self.class_layer, kind[some], partial(np.matmul, part, self.class_layer))
            for classes in self._together(bounds):
                words, fill = slice(bounds[classes.start], bounds[classes.stop]), partial(self._member_outputs, h, bounds, classes)
                got[words] += _log_of(fill(np.empty((words.stop - words.start, self.members), np.float32)), member[words], fill)
            out[first + order] = got
        return out

    def step(self, squares: Network, padded: np.ndarray, at: np.ndarray, rate: float) -> None:
        """One Adagrad step on the words at ``at``, which rises; ``squares`` holds the sums of squared gradients."""
        n, low, high = len(at), int(at[0]) - REACH, int(at[-1]) + REACH + 1
        padded, at = padded[low:high], at - low
        order, kind, member, bounds = self._by_class(padded[at])
        place, numbers = at[order], padded.astype(np.intp) * len(_OFFSETS)
        h, gradient = np.empty((n, WIDTH + 1), np.float32), np.zeros((WIDTH + 1, self.classes), np.float32)
        z, dh = np.empty((n, WIDTH), np.float32), np.empty((n, WIDTH), np.float32)
        for first in range(0, n, _CACHED):
            own = slice(first, first + _CACHED)
            part = self._with_ones(numbers, place[own], z[own], h[own])
            d = _softmax_error(part @ self.class_layer, kind[own], n, partial(np.matmul, part, self.class_layer))
            np.matmul(d, self.to_class.T, out=dh[own])
            gradient += part.T @ d
        for classes in self._together(bounds):
            start, words, fill = bounds[classes.start], slice(bounds[classes.start], bounds[classes.stop]), partial(self._member_outputs, h, bounds, classes)
            e = _softmax_error(fill(np.empty((words.stop - start, self.members), np.float32)), member[words], n, fill)
            back, members = np.empty((len(e), WIDTH), np.float32), np.zeros((len(classes), WIDTH + 1, self.members), np.float32)
            for c in classes:
                a, b = bounds[c], bounds[c + 1]
                if b > a:
                    own = e[a - start : b - start]
                    np.dot(own, self.to_member[c].T, out=back[a - start : b - start])
                    np.dot(h[a:b].T, own, out=members[c - classes.start])
            dh[words] += back
            # other classes' words do not read these layers, so they move while they are in the core's cache
            moved = slice(classes.start, classes.stop)
            _move(self.member_layers[moved], squares.member_layers[moved], members, rate)
        _move(self.class_layer, squares.class_layer, gradient, rate)
        z *= z
        np.subtract(1, z, out=z)
        dh *= z
        _move(self.bias, squares.bias, np.ones(n, np.float32) @ dh, rate)
        dz = np.zeros((len(padded) + 2 * REACH, WIDTH), np.float32)
        dz[place + REACH] = dh
        self._move_embeddings(squares, padded, dz, rate)

    def _move_embeddings(self, squares: Network, seen: np.ndarray, dz: np.ndarray, rate: float) -> None:
        """``dz``: the gradients of the sums at the places of ``seen``, with ``REACH`` places more on either side.

        A word's gradient at all positions is the sum over its places; words go by falling number of places, some at a time that stay in a core's cache.
        """
        by = np.argsort(seen, kind="stable")
        words = seen[by]
        head = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        n = np.diff(np.append(head, len(by)))
        falling = np.argsort(-n, kind="stable")
        head, n, words = head[falling], n[falling], words[head[falling]].astype(np.intp)
        # a word seen at place p took part in the sum at p - o as what stands o places on
        around, width = np.array([REACH - o for o in _OFFSETS]), len(_OFFSETS) * WIDTH

        def rows(places: np.ndarray) -> np.ndarray:
            return dz.take(places[:, None] + around, axis=0, mode="clip").reshape(len(places), width)

        total, own = (x.tables.reshape(len(x.tables), width) for x in (squares, self))
        for first in range(0, len(words), _MOVED):
            some = slice(first, first + _MOVED)
            at, count, which = head[some], n[some], words[some]
            gradient = rows(by[at])
            often = int(np.searchsorted(-count, -_OFTEN, "left"))
            if often:
                many = rows(np.concatenate([by[a : a + m] for a, m in zip(at[:often].tolist(), count[:often].tolist(), strict=True)]))
                ends = np.cumsum(count[:often]).tolist()
                for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                    gradient[i] = np.ones(b - a, np.float32) @ many[a:b]
            for k in range(1, min(int(count[often]), _OFTEN) if often < len(count) else 0):
                more = int(np.searchsorted(-count, -k, "left"))
                gradient[often:more] += rows(by[at[often:more] + k])
            change = gradient * gradient
            change += total.take(which, axis=0)
            total[which] = change
            moved = own.take(which, axis=0)
            moved -= _change(gradient, change, change, rate)
            own[which] = moved


def _move(own: np.ndarray, total: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """Parameters ``own``, whose sums of squared gradients are ``total``."""
    change = gradient * gradient
    total += change
    own -= _change(gradient, total, change, rate)


def _change(gradient: np.ndarray, total: np.ndarray, out: np.ndarray, rate: float) -> np.ndarray:
    """Adagrad's change for the sums of squares ``total``, in ``out``."""
    np.add(total, np.float32(1e-10), out=out)
    np.sqrt(out, out=out)
    np.divide(gradient, out, out=out)
    out *= np.float32(rate)
    return out


def _padded(ids: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents' ids with REACH paddings before each and at the end; places of the words; and words per document."""
    docs = [np.frombuffer(b or b"", np.uint16) for b in ids]
    n = np.array([len(d) for d in docs], np.int64)
    gap = np.full(REACH, words, np.uint16)
    padded = np.concatenate([x for d in docs for x in (gap, d)] + [gap])
    at = np.arange(int(n.sum())) + np.repeat(REACH * np.arange(1, len(docs) + 1), n)
    return padded, at, n


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int]]:
    yield from ta.groups(ta.bytes_of(batch.column(column))[1])


def token_ids(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, ``ids``: the words' ids as 16-bit numbers, ``rare``: the hashes of those that share an id, and ``row``, a number of the row."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = int(TaskContext.get().partitionId()) << 33
        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(1))
            for a, b in ta.groups(offsets, _HASHED):
                hashes, bounds = _word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                got, sharing = vocabulary(hashes)
                rare, to = hashes[sharing], np.append(0, np.cumsum(sharing))[bounds]
                blobs = [pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()) for x, at in ((got, bounds), (rare, to))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *blobs, pa.array(np.arange(row, row + b - a))], names=["doc_id", "ids", "rare", "row"])
                row += b - a

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ta.lean(ids), "doc_id long, ids binary, rare binary, row long")


_BLOCK = 8192
_DEALT = "part int, block long, words binary, at binary"


def rare_logs(tokens: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """(row, logs): the sum of the log counts of the row's words that share an id, where it is not zero.

    Words and counts are dealt by hash, packed by part; what goes back is packed by blocks of rows.
    """

    def packed(words: np.ndarray, block: int, at: np.ndarray) -> pa.RecordBatch:
        part, blobs = _by_part(words, at, parts)
        return pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), block)), *blobs], names=["part", "block", "words", "at"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(0))
            words, row, n = data.view(np.int64), batch.column(1).to_numpy(), np.diff(offsets) // 8
            block, at = np.repeat(row // _BLOCK, n), np.repeat(row % _BLOCK, n).astype(np.uint16)
            for b in np.unique(block):
                here = block == b
                yield packed(words[here], b, at[here])

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield packed(batch.column(0).to_numpy(), -1, batch.column(1).to_numpy())

    def looked_up(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_numpy()
        words, at = table.column("words"), table.column("at")
        counted = np.flatnonzero(blocks < 0)
        w, n = (np.concatenate([np.frombuffer(x[int(i)].as_buffer(), np.int64) for i in counted] or [np.zeros(0, np.int64)]) for x in (words, at))
        order = np.argsort(w)
        places, logs = _Places(w[order]), np.log(n[order])
        out: list[tuple[int, bytes, bytes]] = []
        for i in np.flatnonzero(blocks >= 0):
            rows = np.frombuffer(at[int(i)].as_buffer(), np.uint16)
            # rows rise, as they were dealt
            head = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            sums = np.add.reduceat(logs.take(places(np.frombuffer(words[int(i)].as_buffer(), np.int64))), head)
            out.append((int(blocks[i]), rows[head].tobytes(), sums.tobytes()))
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "at": pa.array([x[1] for x in out], pa.binary()), "logs": pa.array([x[2] for x in out], pa.binary())})

    def by_row(table: pa.Table) -> pa.Table:
        sums = np.zeros(_BLOCK)
        for at, logs in zip(table.column("at"), table.column("logs"), strict=True):
            np.add.at(sums, np.frombuffer(at.as_buffer(), np.uint16), np.frombuffer(logs.as_buffer()))
        rows = np.flatnonzero(sums)
        return pa.table({"row": pa.array(rows + table.column("block")[0].as_py() * _BLOCK), "logs": pa.array(sums[rows])})

    dealt = tokens.select("rare", "row").mapInArrow(ta.lean(asked), _DEALT).union(counts.mapInArrow(ta.lean(known), _DEALT))
    logs = dealt.groupBy("part").applyInArrow(ta.lean(looked_up), "block long, at binary, logs binary")
    return logs.groupBy("block").applyInArrow(ta.lean(by_row), "row long, logs double")


def _hidden(ids: list[bytes], number: int, rounds: int, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """What round ``number`` trains on: the runs of words that it hides with the ``REACH`` words around them, and the hidden words' places therein.

    Runs of ``_RUN`` words take turns; which comes first hangs on the document's words. Over all ``rounds`` each word is hidden once.
    """
    padded, at, n = _padded(ids, words)
    runs = -(-n // _RUN)
    of = np.repeat(np.arange(len(n)), runs)
    run = np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)
    turn = np.array([zlib.crc32(b or b"") for b in ids], np.int64)[of] + run
    hidden = np.zeros(len(padded), bool)
    hidden[at] = np.repeat(turn % rounds == number % rounds, np.minimum(_RUN, n[of] - run * _RUN))
    near = hidden.copy()
    for o in range(1, REACH + 1):
        near[o:] |= hidden[:-o]
        near[:-o] |= hidden[o:]
    return padded[near], np.flatnonzero(hidden[near])


_PIECE = 16_384
#: Words of a training task, at least: a task sends its whole model, so models must be few beside the words.
TASK_WORDS = 4 << 20
#: Models that are averaged at a time: a tree, so that none gathers more, whatever their number.
FAN_IN = 64
_PARAMETERS = "piece int, group int, values binary, weight double"


def _added(table: pa.Table) -> pa.Table:
    """The weighted mean of one piece's parameters in one group."""
    weights = np.array(table.column("weight").to_pylist())
    total = weights.sum()
    mean = sum(np.frombuffer(v, np.float32).astype(float) * (w / total) for v, w in zip(table.column("values").to_pylist(), weights, strict=True))
    return pa.table({"piece": table.column("piece")[:1], "group": table.column("group")[:1], "values": pa.array([mean.astype(np.float32).tobytes()]), "weight": pa.array([total])})


def train(tokens: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Fit to all of ``tokens``; each round sends the driver one model, of ``Network.size(vocabulary.size)`` numbers."""
    net = Network.start(vocabulary.unigram)
    tasks = max(1, int(vocabulary.unigram.sum()) // TASK_WORDS)
    for number in range(rounds):
        flat = net.flat.copy()

        def local(batches: Iterator[pa.RecordBatch], flat: np.ndarray = flat, number: int = number) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, squares, seen = Network(flat.copy()), Network(np.zeros(len(flat), np.float32)), 0
            for batch in batches:
                for a, b in _slices(batch, 0):
                    padded, hidden = _hidden(batch.column(0)[a:b].to_pylist(), number, rounds, own.words)
                    for first in range(0, len(hidden), STEP):
                        own.step(squares, padded, hidden[first : first + STEP], RATE)
                    seen += len(hidden)
            if seen:
                group = int(TaskContext.get().partitionId())
                pieces = range(-(-len(flat) // _PIECE))
                columns = (pa.array(list(pieces), pa.int32()), pa.array([group] * len(pieces), pa.int32()), pa.array([own.flat[i * _PIECE : (i + 1) * _PIECE].tobytes() for i in pieces]), pa.array([float(seen)] * len(pieces)))
                yield pa.RecordBatch.from_arrays(list(columns), names=["piece", "group", "values", "weight"])

        trained = tokens.select("ids").coalesce(tasks).mapInArrow(ta.lean(local), _PARAMETERS)
        mean, left = trained, tasks
        while left > 1 or mean is trained:
            mean = mean.withColumn("group", F.floor(F.col("group") / FAN_IN).cast("int")).groupBy("piece", "group").applyInArrow(ta.lean(_added), _PARAMETERS)
            left = -(-left // FAN_IN)
        rows = sorted((r.piece, bytes(r["values"])) for r in mean.collect())
        if not rows:
            continue
        net = Network(np.frombuffer(b"".join(v for _, v in rows), np.float32).copy())
    return net


def score(tokens: DataFrame, net: Network, vocabulary: Vocabulary, logs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, pseudo_log_likelihood (a sum), mean_log_likelihood; ``logs`` is what ``rare_logs`` returns."""
    flat, totals = net.flat, vocabulary.log_total

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(flat)
        for batch in batches:
            for a, b in _slices(batch, 1):
                padded, at, n = _padded(batch.column(1)[a:b].to_pylist(), own.words)
                log_p = own.log_probabilities(padded, at) - totals[padded[at]]
                total = np.bincount(np.repeat(np.arange(len(n)), n), log_p, len(n))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n), pa.array(total), batch.column(2)[a:b]], names=["doc_id", "n_tokens", "network", "row"])

    out = tokens.select("doc_id", "ids", "row").mapInArrow(ta.lean(scored), "doc_id long, n_tokens long, network double, row long").join(logs, "row", "left")
    out = out.select("doc_id", "n_tokens", (F.col("network") + F.coalesce("logs", F.lit(0.0))).alias("pseudo_log_likelihood"))
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("pseudo_log_likelihood") / F.col("n_tokens")))


def score_documents(docs: DataFrame) -> DataFrame:
    """Count, train and score over all of ``docs``."""
    parts = common.parts_for(docs, 16 << 20)
    counts = common.stage(count_words(docs, parts), "counts")
    vocabulary = build_vocabulary(counts)
    tokens = common.stage(token_ids(docs, vocabulary), "tokens")
    logs = rare_logs(tokens, counts, parts)
    return score(tokens, train(tokens, vocabulary), vocabulary, logs)
