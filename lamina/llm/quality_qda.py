"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of whole documents.

Statistics come from the text alone. Both classes' counts, sums and sums of products are added up over all training rows by the workers;
from these the driver makes class means and covariances, shrinks each covariance towards the pooled one and that towards a multiple of the
identity (in standardised coordinates), and keeps the inverse Cholesky factors. A score is the logistic function of the difference of the
classes' log densities (half Mahalanobis distances and log determinants) and log priors.

Defined results: a null or empty text has the statistics of no words, and a score like any other; a null ``doc_id`` has no label and is not held
out; of several labels of a document the lowest counts; a repeated row counts as often as it stands; with one class only, or no labels at all,
every score is the share of label 1 in training, or 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm import textarray as ta

#: Shrinkage of a class's covariance towards the pooled one, and of that towards the identity.
TO_POOLED, TO_IDENTITY = 0.1, 0.05
FEATURES = ("words", "word_length", "word_length_spread", "symbols", "upper", "digits", "exclamations", "marks", "distinct", "repeated", "single", "lines", "capitals")
_LOWER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _BANG, _MARK, _HIGH, _BREAK, _REST = range(10)


def _kinds() -> np.ndarray:
    out = np.full(256, _REST, np.uint8)
    for kind, characters in ((_LOWER, map(chr, range(97, 123))), (_UPPER, map(chr, range(65, 91))), (_DIGIT, "0123456789"), (_SPACE, " \t\r\v\f"), (_SYMBOL, "#*$%&|<>"), (_BANG, "!"), (_MARK, ".,;:?'\"()-")):
        for c in characters:
            out[ord(c)] = kind
    out[ord("\n")] = _BREAK
    out[0xC0:] = _HIGH
    return out


_KIND = _kinds()


def features_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of transformed statistics for each text of the batch."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(row * 10 + _KIND[data], minlength=10 * n).reshape(n, 10).astype(float)
    starts, ends, bounds = ta.words_by_row(data, offsets)
    words = np.diff(bounds).astype(float)
    word_row = np.repeat(np.arange(n), np.diff(bounds))
    length = (ends - starts).astype(float)
    total, squares = np.bincount(word_row, length, n), np.bincount(word_row, length * length, n)
    mean = total / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean * mean, 0))
    hashes = ta.word_hash(data, starts, ends)
    twice = np.zeros(len(hashes), bool)
    if len(hashes):
        twice[1:] = (hashes[1:] == hashes[:-1]) & (word_row[1:] == word_row[:-1])
    own = np.unique(hashes ^ ta.mix(word_row.astype(np.uint64)), return_index=True)[1]
    distinct = np.bincount(word_row[own], minlength=n)
    smoothed = words + 10  # so that few words do not make extreme rates
    letters = kinds[:, _LOWER] + kinds[:, _UPPER] + kinds[:, _HIGH]
    first_upper = np.bincount(word_row, _KIND[data[starts]] == _UPPER, n) if len(starts) else np.zeros(n)
    rate = lambda x: np.log1p(100 * x / smoothed)
    return np.column_stack(
        [
            np.log1p(words),
            np.log1p(mean),
            np.log1p(spread),
            rate(kinds[:, _SYMBOL]),
            np.log((kinds[:, _UPPER] + 0.5) / (letters + 10)),
            rate(kinds[:, _DIGIT]),
            rate(kinds[:, _BANG]),
            rate(kinds[:, _MARK]),
            np.log((distinct + 10) / smoothed),
            rate(np.bincount(word_row, twice, n)),
            rate(np.bincount(word_row, length == 1, n)),
            rate(kinds[:, _BREAK]),
            np.log((first_upper + 1) / smoothed),
        ]
    )


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and ``features`` array<double> of every whole text."""

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(1))
            for a, b in ta.groups(offsets):
                values = features_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * len(FEATURES)), pa.array(values.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists], names=["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(ta.lean(computed), "doc_id long, features array<double>")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Discriminant:
    """Standardisation, and of each class the mean, inverse Cholesky factor, half log determinant and log prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    constants: list[float]
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        z = (x - self.centre) / self.scale
        log0, log1 = (c - 0.5 * np.square((z - m) @ f.T).sum(axis=1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True))
        return 1 / (1 + np.exp(-np.clip(log1 - log0, -700, 700)))


def fit(sums: dict[int, np.ndarray], to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """``sums``: for each class the sum over its rows of (1, x)(1, x)'."""
    d = len(FEATURES)
    counts = [sums[c][0, 0] if c in sums else 0.0 for c in (0, 1)]
    share = counts[1] / sum(counts) if sum(counts) else 0.5
    if min(counts) < 2:
        return Discriminant(np.zeros(d), np.ones(d), [], [], [], share)
    means = [sums[c][0, 1:] / n for c, n in enumerate(counts)]
    scatter = [sums[c][1:, 1:] - n * np.outer(m, m) for c, (n, m) in enumerate(zip(counts, means, strict=True))]
    pooled = sum(scatter) / sum(counts)
    centre, scale = means[1], np.sqrt(np.maximum(np.diag(pooled), 1e-12))
    to_unit = np.outer(scale, scale)
    factors, constants, at = [], [], []
    for n, m, s in zip(counts, means, scatter, strict=True):
        cov = (1 - to_pooled) * (s / n) / to_unit + to_pooled * pooled / to_unit
        cov = (1 - to_identity) * cov + to_identity * max(np.trace(cov) / d, 1e-6) * np.eye(d)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(n / sum(counts)) - np.log(np.diag(lower)).sum()))
        at.append((m - centre) / scale)
    return Discriminant(centre, scale, at, factors, constants, share)


def train(features: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit to all rows of ``features`` that have a label and are not held out; 2 * 105 numbers reach the driver."""
    d = len(FEATURES)
    target = labels.filter("quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = features.filter(~held_out()).join(target, "doc_id").select("quality", "features")
    upper = np.triu_indices(d + 1)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            quality = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([np.ones(len(quality)), batch.column(1).flatten().to_numpy().reshape(-1, d)])
            for c in (0, 1):
                own = x[quality == c]
                total[c] = total.get(c, 0) + own.T @ own
        for c, m in total.items():
            flat = m[upper]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(flat), c)), pa.array(np.arange(len(flat))), pa.array(flat)], names=["class", "place", "value"])

    sums: dict[int, np.ndarray] = {}
    for r in rows.mapInArrow(ta.lean(added), "class long, place long, value double").groupBy("class", "place").agg(F.sum("value").alias("value")).collect():
        m = sums.setdefault(r["class"], np.zeros((d + 1, d + 1)))
        i, j = upper[0][r.place], upper[1][r.place]
        m[i, j] = m[j, i] = r.value
    return fit(sums)


def score(features: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    out = features.mapInArrow(ta.lean(scored), "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` (doc_id, quality) and score all of ``docs``; statistics are computed once."""
    features = common.stage(with_features(docs), "features")
    return score(features, train(features, labels))
