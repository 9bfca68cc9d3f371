"""BPE encoding through a minimal acyclic transducer of frequent words, and decoding.

Words are counted over all documents; the ``LEXICON_WORDS`` most frequent ones are compiled into a minimal automaton whose equal suffixes
are shared. Its transitions add up integers: along a word's path they sum to the word's number, under which its ids stand (a transducer
over the integers and addition). The driver ships the compiled file with ``addFile``; workers memory-map it, so that those of one machine
share its pages, and walk it for all distinct words of a batch at once. Words that it lacks are merged exactly, by rank, many at a time.

The ids are those of the tokenizers library for a BPE model with ``</w>`` word ends, NFC and lower case, without added special tokens; a
special token's own string within a text gives its id, as there. Decoding without a decoder joins token strings by one space, as there.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows and documents of any ``doc_id`` are each encoded;
an empty table gives an empty lexicon and no rows; a text of any length is encoded whole; other columns pass through untouched, but for
those named ``input_ids`` or ``n_tokens``, which the result's replace. Words are told apart by their characters, never by hashes alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import common, pretokens
from lamina.llm import textarray as ta

LEXICON_WORDS = 32_768
_WORD_LENGTH = 48
_COUNTED = 200_000


def normal(text: str) -> str:
    """NFC, then lower case character by character (a final sigma stays a plain one)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where visible, else one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Merges:
    """A BPE model: vocabulary, ranks of pairs, and exact merging of many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.vocabulary.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocabulary.items(), *self.special.items()]:
            self.tokens[i] = token
        characters = byte_characters()
        self.inner = np.array([self.vocabulary[c] for c in characters], np.int64)
        self.last = np.array([self.vocabulary[c + self.end] for c in characters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([self.vocabulary[a] << 32 | self.vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([self.vocabulary[a + b] for a, b in pairs], np.int64)
        self._index(keys, np.arange(len(keys)), made)

    def _index(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """An open-addressing table, filled round by round; a key lies within ``probes`` slots of its home."""
        bits = max(4, int(len(keys)).bit_length() + 3)
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.slot_key, self.slot_rank, self.slot_made = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        rest, self.probes = np.arange(len(keys)), 0
        while len(rest):
            slot = (self._home(keys[rest]) + self.probes) % size
            free = self.slot_key[slot] < 0
            _, one = np.unique(np.where(free, slot, -1), return_index=True)
            one = one[free[one]]
            self.slot_key[slot[one]], self.slot_rank[slot[one]], self.slot_made[slot[one]] = keys[rest[one]], ranks[rest[one]], made[rest[one]]
            rest = np.delete(rest, one)
            self.probes += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair its rank, or a large number, and what it merges into."""
        keys = left << 32 | right
        rank, made = np.full(len(keys), 1 << 40, np.int64), np.zeros(len(keys), np.int64)
        home = self._home(keys)
        open_ = np.arange(len(keys))
        for step in range(self.probes):
            slot = (home[open_] + step) % len(self.slot_key)
            found = self.slot_key[slot]
            hit = found == keys[open_]
            rank[open_[hit]], made[open_[hit]] = self.slot_rank[slot[hit]], self.slot_made[slot[hit]]
            open_ = open_[~hit & (found >= 0)]
            if not len(open_):
                break
        return rank, made

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids after each other, and how many each has.

        Each round merges, in every word that still has a known pair, all places of its pair of lowest rank from left to right.
        """
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        counts = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        ids = self.inner[raw]
        ids[np.cumsum(counts) - 1] = self.last[raw[np.cumsum(counts) - 1]]
        word = np.repeat(np.arange(len(words)), counts)
        done_word, done_ids, done_place = [], [], []
        while len(ids):
            rank, made = np.full(len(ids), 1 << 40, np.int64), np.zeros(len(ids), np.int64)
            inner = word[1:] == word[:-1]
            at = np.flatnonzero(inner)
            rank[at], made[at] = self._ranks(ids[at], ids[at + 1])
            begin = np.flatnonzero(np.append(True, ~inner))
            low = np.minimum.reduceat(rank, begin)
            size = np.diff(np.append(begin, len(ids)))
            low = np.repeat(low, size)
            over = low == 1 << 40
            if over.any():
                done_word.append(word[over])
                done_ids.append(ids[over])
                keep = ~over
                ids, word, rank, made, low = ids[keep], word[keep], rank[keep], made[keep], low[keep]
                if not len(ids):
                    break
            take = rank == low
            # of places that overlap (equal neighbours), every second one of a run
            touching = take[1:] & take[:-1]
            if touching.any():
                place = np.flatnonzero(take)
                fresh = np.append(True, np.diff(place) != 1)
                order = np.arange(len(place)) - np.repeat(np.flatnonzero(fresh), np.diff(np.append(np.flatnonzero(fresh), len(place))))
                take[place[order % 2 == 1]] = False
            ids = np.where(take, made, ids)
            keep = np.append(True, ~take[:-1])
            ids, word = ids[keep], word[keep]
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))


def compile_automaton(words: list[str]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of distinct ``words``, whose numbers (in code point order) are sums of transition outputs.

    Words come in order; what no later word can change is replaced by an equal state met before, so suffixes are shared as they arise.
    """
    words = sorted(words)
    letters = sorted({c for w in words for c in w if ord(c) < 1 << 16})
    symbol = {c: i for i, c in enumerate(letters)}
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    moves: list[tuple[tuple[int, int], ...]] = []
    reach: list[int] = []

    def settle(node: tuple[bool, list]) -> int:
        final, out = node
        key = (final, tuple(out))
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(final)
            moves.append(tuple(out))
            reach.append(final + sum(reach[t] for _, t in out))
        return state

    path: list[list] = [[False, []]]
    taken: list[int] = []
    for word in words:
        spelled = [symbol[c] for c in word if c in symbol]
        if len(spelled) != len(word):
            continue
        common = 0
        while common < len(taken) and common < len(spelled) and taken[common] == spelled[common]:
            common += 1
        while len(path) - 1 > common:
            state = settle(tuple(path.pop()))
            path[-1][1].append((taken.pop(), state))
        for s in spelled[common:]:
            path.append([False, []])
            taken.append(s)
        path[-1][0] = True
    while len(path) > 1:
        state = settle(tuple(path.pop()))
        path[-1][1].append((taken.pop(), state))
    root = settle(tuple(path.pop()))
    width = len(letters) + 1
    follow, output = np.full((len(finals), width), -1, np.int32), np.zeros((len(finals), width), np.int32)
    for state, out in enumerate(moves):
        before = int(finals[state])
        for s, target in out:
            follow[state, s], output[state, s] = target, before
            before += reach[target]
    symbols = np.full(1 << 16, width - 1, np.int32)
    symbols[[ord(c) for c in letters]] = np.arange(len(letters))
    return {"follow": follow, "output": output, "final": np.array(finals, np.int32), "symbols": symbols, "root": np.array([root], np.int32)}


_ARRAYS = ("follow", "output", "final", "symbols", "root", "id_begin", "ids")


def save_lexicon(path: str, words: list[str], merges: Merges) -> None:
    """One file: a line of JSON with the arrays' shapes, then the arrays."""
    arrays = compile_automaton(words)
    spelled = sorted(w for w in words if all(ord(c) < 1 << 16 for c in w))
    ids, counts = merges.merge(spelled)
    arrays |= {"id_begin": np.append(0, np.cumsum(counts)).astype(np.int32), "ids": ids.astype(np.int32)}
    head = json.dumps({k: arrays[k].shape for k in _ARRAYS}).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    with open(path, "wb") as f:
        f.write(head)
        for k in _ARRAYS:
            f.write(np.ascontiguousarray(arrays[k]).tobytes())


class Lexicon:
    """A compiled lexicon, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = f.readline()
        at, a = len(head), {}
        for name, shape in json.loads(head).items():
            size = int(np.prod(shape))
            a[name] = np.asarray(np.memmap(path, np.int32, "r", at, tuple(shape))) if size else np.zeros(shape, np.int32)
            at += 4 * size
        self.width = a["follow"].shape[1]
        self.follow, self.output = a["follow"].reshape(-1), a["output"].reshape(-1)
        self.final, self.symbols, self.root = a["final"], np.array(a["symbols"]), int(a["root"][0])
        self.id_begin, self.ids = np.array(a["id_begin"]), np.array(a["ids"])

    def numbers(self, codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each span's number in the lexicon, or -1."""
        out = np.full(len(first), -1, np.int64)
        alive = np.arange(len(first))
        state, total = np.full(len(first), self.root, np.int64), np.zeros(len(first), np.int64)
        place = first.copy()
        while len(alive):
            ended = place == end[alive]
            if ended.any():
                here = ended & (self.final[state] == 1)
                out[alive[here]] = total[here]
                keep = ~ended
                alive, state, total, place = alive[keep], state[keep], total[keep], place[keep]
            code = codes[place]
            cell = state * self.width + np.where(code < 1 << 16, self.symbols[code & 0xFFFF], self.width - 1)
            state = self.follow[cell].astype(np.int64)
            total = total + self.output[cell]
            keep = state >= 0
            alive, state, total, place = alive[keep], state[keep], total[keep], place[keep] + 1
        return out


class WordEncoder:
    """Ids of whole texts. ``bounds`` and ``ids`` of the last call: each text's ids."""

    def __init__(self, merges: Merges, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon
        self.listed = pretokens.Ragged(np.int64)
        if lexicon is not None:
            self.listed.extend(lexicon.ids, np.diff(lexicon.id_begin))
        self.merged = pretokens.Ragged(np.int64)
        self.distinct = pretokens.Distinct(lambda words: self.merged.extend(*merges.merge(words)), self.merged.clear)
        self.specials = re.compile("(" + "|".join(map(re.escape, merges.special)) + ")") if merges.special else None

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 bounds of each text's."""
        if self.specials and any(s in t for s in self.merges.special for t in texts):
            return self._with_specials(texts)
        lower = [normal(t) for t in texts]
        codes, starts = ta.code_points(lower)
        first, end = pretokens.word_spans(codes, starts)
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        at, inverse, hashes = ta.distinct(codes, first, end)
        first_of, end_of = first[at], end[at]
        number = self.lexicon.numbers(codes, first_of, end_of) if self.lexicon is not None else np.full(len(at), -1, np.int64)
        unseen = number < 0
        row = self.distinct.of_distinct("\n".join(lower), codes, hashes[unseen], first_of[unseen], end_of[unseen])
        counts = np.zeros(len(at), np.int64)
        counts[~unseen], counts[unseen] = self.listed.count[number[~unseen]], self.merged.count[row]
        flat = np.zeros(counts.sum(), np.int64)
        of_unseen = np.repeat(unseen, counts)
        flat[~of_unseen], flat[of_unseen] = self.listed.take(number[~unseen])[0], self.merged.take(row)[0]
        all_words = pretokens.Ragged(np.int64)
        all_words.extend(flat, counts)
        ids, bounds = all_words.take(inverse)
        return ids, bounds[np.searchsorted(first, starts)]

    def _with_specials(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = []
        for text in texts:
            pieces = [np.array([self.merges.special[p]]) if p in self.merges.special else self([p])[0] for p in self.specials.split(text) if p]
            each.append(np.concatenate(pieces) if pieces else np.zeros(0, np.int64))
        return np.concatenate(each), np.cumsum([0, *map(len, each)])


@cache
def _merges(tokenizer: str) -> Merges:
    return Merges(tokenizer)


@cache
def _encoder(tokenizer: str, lexicon: str) -> WordEncoder:
    return WordEncoder(_merges(tokenizer), Lexicon(SparkFiles.get(lexicon)) if lexicon else None)


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    _, offsets = ta.bytes_of(column)
    for a, b in ta.groups(offsets):
        yield a, b, [t or "" for t in column[a:b].to_pylist()]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; workers add up before the shuffle."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for _, _, texts in _slices(batch.column(0)):
                lower = [normal(t) for t in texts]
                codes, starts = ta.code_points(lower)
                first, end = pretokens.word_spans(codes, starts)
                short = end - first <= _WORD_LENGTH
                first, end = first[short], end[short]
                if len(first):
                    joined = "\n".join(lower)
                    at, inverse, _ = ta.distinct(codes, first, end)
                    for a, b, k in zip(first[at].tolist(), end[at].tolist(), np.bincount(inverse).tolist(), strict=True):
                        total[joined[a:b]] += k
                if len(total) > _COUNTED:
                    yield flush()
        if total:
            yield flush()

    return docs.select("text").mapInArrow(ta.lean(counts), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ship_lexicon(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of ``docs``, at most ``most``, and ship the file; returns its name."""
    top = [r.word for r in common.most_frequent(common.stage(count_words(docs), "words"), most).collect()]
    context = docs.sparkSession.sparkContext
    folder = os.path.join(os.path.realpath(tempfile.gettempdir()), f"lexicons-{context.applicationId}")
    os.makedirs(folder, exist_ok=True)
    draft = f"{folder}/draft"
    save_lexicon(draft, top, _merges(tokenizer))
    with open(draft, "rb") as f:
        name = f"lexicon-{hashlib.file_digest(f, 'sha256').hexdigest()[:24]}.bin"
    os.replace(draft, f"{folder}/{name}")
    context.addFile(f"{folder}/{name}")
    return name


def encode(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> DataFrame:
    """``docs`` without its text and with ``input_ids`` array<int> and ``n_tokens`` long."""
    lexicon = ship_lexicon(docs, tokenizer, most)
    others = [c for c in docs.columns if c not in ("text", "input_ids", "n_tokens")]
    out = docs.select(*others).schema.add("input_ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType())

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, lexicon)
        for batch in batches:
            for a, b, texts in _slices(batch.column(0)):
                ids, bounds = encoder(texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
                rest = [batch.column(i)[a:b] for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(np.diff(bounds))], names=out.fieldNames())

    return docs.select("text", *others).mapInArrow(ta.lean(encoded), out)


def decode_ids(merges: Merges, ids: list[int]) -> str:
    return " ".join(merges.tokens[i] for i in ids)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` (doc_id, input_ids) as doc_id and ``decoded`` string; null ids decode to the empty text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(tokenizer)
        for batch in batches:
            texts = [decode_ids(merges, ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "input_ids").mapInArrow(ta.lean(decoded), "doc_id long, decoded string")


def digests(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, of the ids as they are made, which are then dropped."""
    lexicon = ship_lexicon(docs, tokenizer, most)

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, lexicon)
        numbers = [b"%d" % i for i in range(len(encoder.merges.tokens))]
        tokens = [t.encode() for t in encoder.merges.tokens]
        for batch in batches:
            for a, b, texts in _slices(batch.column(1)):
                ids, bounds = encoder(texts)
                flat = ids.tolist()
                sums: tuple[list[str], list[str]] = ([], [])
                for i in range(b - a):
                    own = flat[bounds[i] : bounds[i + 1]]
                    for out, names in zip(sums, (numbers, tokens), strict=True):
                        out.append(hashlib.sha256(b" ".join([names[j] for j in own])).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(bounds)), pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ta.lean(digested), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
