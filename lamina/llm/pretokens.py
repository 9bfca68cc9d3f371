"""Splitting batches of texts into pre-tokens, and looking each distinct one up once."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np

from lamina.llm import textarray as ta

_APOSTROPHE = 0x27


def _contractions(codes: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes ``at``, those that begin 's 't 'm 'd 're 've 'll within their text, and their lengths."""
    padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
    one, two = padded[at + 1], padded[at + 2]
    room = ends - at
    short = (room > 1) & np.isin(one, [ord(c) for c in "stmd"])
    pair = (room > 2) & (((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l"))))
    length = np.where(short, 2, np.where(pair, 3, 0))
    return at[length > 0], length[length > 0]


def _runs(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds = ta.classes()[codes]
    new = np.ones(len(codes), bool)
    new[1:] = kinds[1:] != kinds[:-1]
    new[starts[:-1][starts[:-1] < len(codes)]] = True
    return kinds, new


def _split_contractions(codes: np.ndarray, starts: np.ndarray, begin: np.ndarray, new: np.ndarray) -> None:
    at = np.flatnonzero((codes == _APOSTROPHE) & begin & new)
    if len(at):
        ends = starts[np.searchsorted(starts, at, "right")]
        at, length = _contractions(codes, ends, at)
        begin[at + 1] = False
        after = at + length
        begin[after[after < len(codes)]] = True


def byte_level_spans(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pre-tokens of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    ``starts``: where each text begins in ``codes``, and the total; texts stand directly after each other.
    """
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds, new = _runs(codes, starts)
    begin = new.copy()
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(codes))
    is_start = np.zeros(len(codes) + 1, bool)
    is_start[starts] = True
    inner = (kinds[first] == ta.SPACE) & ~is_start[end]
    last = end[inner] - 1
    begin[last] = True
    begin[last[codes[last] == 0x20] + 1] = False
    _split_contractions(codes, starts, begin, new)
    first = np.flatnonzero(begin)
    return first, np.append(first[1:], len(codes))


def word_spans(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matches of ``'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^\\s\\p{L}\\p{N}]+``."""
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kinds, new = _runs(codes, starts)
    begin = new | (kinds == ta.NUMBER)
    _split_contractions(codes, starts, begin, new)
    first = np.flatnonzero(begin)
    end = np.append(first[1:], len(codes))
    kept = kinds[first] != ta.SPACE
    return first[kept], end[kept]


class Distinct:
    """Numbers distinct spans, and hands the strings not met before to ``store``, in the order of their numbers.

    Spans are looked up by hash and compared with what is remembered; those whose hash another string has are looked up by their own symbols.
    At most about ``most`` strings are remembered; beyond that ``forget`` is called and all are met anew, which costs time and changes
    no result.
    """

    def __init__(self, store: Callable[[list[str]], None], forget: Callable[[], None], most: int = 400_000):
        self.store, self.forget, self.most = store, forget, most
        self._clear()

    def _clear(self) -> None:
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.spelled, self.odd = Ragged(np.uint32), {}

    def rows(self, text: str, codes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each span its number, valid until the next call."""
        if not len(first):
            return np.zeros(0, np.int64)
        at, inverse, hashes = ta.distinct(codes, first, end)
        return self.of_distinct(text, codes, hashes, first[at], end[at])[inverse]

    def of_distinct(self, text: str, codes: np.ndarray, hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same for spans that are distinct."""
        if len(self.spelled.count) > self.most:
            self._clear()
            self.forget()
        row, length = np.full(len(hashes), -1, np.int64), end - first
        met = np.zeros(len(hashes), bool)
        if len(self.keys):
            place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            met = self.keys[place] == hashes
            at = np.flatnonzero(met)
            known = self.numbers[place[at]]
            same = self.spelled.count[known] == length[at]
            same[same] = ta.equal_spans(codes, first[at[same]], self.spelled.flat, self.spelled.begin[known[same]], length[at[same]])
            row[at[same]] = known[same]
        fresh = np.flatnonzero(~met)
        new = fresh[np.unique(hashes[fresh], return_index=True)[1]]
        base = len(self.spelled.count)
        row[new] = base + np.arange(len(new))
        more: list[int] = []
        for i in np.flatnonzero(row < 0).tolist():
            symbols = codes[first[i] : end[i]].tobytes()
            if symbols not in self.odd:
                self.odd[symbols] = base + len(new) + len(more)
                more.append(i)
            row[i] = self.odd[symbols]
        if len(new):
            keys = np.concatenate([self.keys, hashes[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.numbers = keys[order], np.concatenate([self.numbers, row[new]])[order]
        added = np.append(new, more).astype(np.int64)
        if len(added):
            n = length[added]
            self.spelled.extend(codes[np.repeat(first[added] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n)
            self.store([text[a:b] for a, b in zip(first[added].tolist(), end[added].tolist(), strict=True)])
        return row


class Ragged:
    """A growing list of integer sequences in two arrays."""

    def __init__(self, kind):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.flat, self.begin, self.count = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def extend(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(counts) - counts])
        self.count = np.concatenate([self.count, counts])
        self.flat = np.concatenate([self.flat, flat.astype(self.kind)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of ``rows`` after each other, and the bounds of each."""
        counts = self.count[rows]
        bounds = np.zeros(len(rows) + 1, np.int64)
        np.cumsum(counts, out=bounds[1:])
        return self.flat[np.repeat(self.begin[rows] - bounds[:-1], counts) + np.arange(bounds[-1])], bounds


def library_tokenizer(path: str):
    """The tokenizers library's tokenizer of a file, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
