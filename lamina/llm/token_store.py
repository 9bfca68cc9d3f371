"""Token-id output: Arrow files whose batches are fixed-size lists, so that sequence i is found by arithmetic and mapped without a copy.

A store is a set of shards in ascending ``doc_id`` order. Each shard has two Arrow files:

* ``*.tokens.arrow``: ``input_ids`` fixed-size-list<uint16 or uint32>[sequence] and ``mask`` fixed-size-list<uint8>[sequence / 8], a bit for
  each id, the lowest first, in record batches of ``BATCH`` sequences each, uncompressed. Ids and packed masks are read as views of the file's
  map. The ids of the shard's documents follow each other; the last sequence is padded with 0 under bits of 0.
* ``*.docs.arrow``: ``doc_id``, ``start`` (within the shard) and ``n_tokens``.

Defined results: a null text is encoded as an empty one and so has the end id only; documents of equal ``doc_id`` stand next to each other
in the order of a hash of their texts (so that they, or all that have none, are spread over shards like any others); a null ``doc_id`` comes before all others; an empty table makes a store without shards; other columns play no part.
A task that is run again writes files of another name, and only those of the attempt that Spark commits are in the manifest.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.llm import common, pretokens
from lamina.llm import textarray as ta

SEQUENCE, BATCH = 2048, 128
SHARD_BYTES = 24 << 20
MANIFEST = "shard int, tokens_path string, docs_path string, n_docs long, n_tokens long"


class ByteLevelEncoder:
    """The library's ids of whole texts: pre-tokens are found here, and the library encodes each distinct one.

    Pre-tokens of one space and letters are the same ones again when joined, so the library gets many of them as one string; a byte-level
    token has a character for each byte, by which its ids are dealt out to the pre-tokens.
    """

    def __init__(self, path: str):
        self.library = pretokens.library_tokenizer(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.width = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.ids = pretokens.Ragged(self.width)
        self.distinct = pretokens.Distinct(self._store, self.ids.clear)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _store(self, texts: list[str]) -> None:
        plain = np.fromiter((t[0] == " " and t[1:].isalpha() for t in texts), bool, len(texts))
        if plain.any():
            joined = [t for t, p in zip(texts, plain, strict=True) if p]
            ids = np.concatenate(self._batch(["".join(joined[i : i + 512]) for i in range(0, len(joined), 512)]))
            ends = np.cumsum([len(t.encode()) for t in joined])
            last = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1
            plain_counts = np.diff(last, prepend=0)
        else:
            ids, plain_counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        others = self._batch([t for t, p in zip(texts, plain, strict=True) if not p])
        counts = np.zeros(len(texts), np.int64)
        counts[plain], counts[~plain] = plain_counts, [len(o) for o in others]
        flat = np.zeros(counts.sum(), np.int64)
        of_plain = np.repeat(plain, counts)
        flat[of_plain] = ids
        if others:
            flat[~of_plain] = np.concatenate(others)
        self.ids.extend(flat, counts)

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 bounds of each text's."""
        if any(s in t for s in self.special for t in texts):
            each = self._batch(texts)
            return np.concatenate(each).astype(self.width), np.cumsum([0, *map(len, each)])
        codes, starts = ta.code_points(texts, "")
        first, end = pretokens.byte_level_spans(codes, starts)
        ids, bounds = self.ids.take(self.distinct.rows("".join(texts), codes, first, end))
        return ids, bounds[np.searchsorted(first, starts)]


@cache
def _encoder(path: str) -> ByteLevelEncoder:
    return ByteLevelEncoder(path)


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _schema(width, sequence: int) -> pa.Schema:
    kind = pa.uint16() if width == np.uint16 else pa.uint32()
    return pa.schema([pa.field("input_ids", pa.list_(kind, sequence), False), pa.field("mask", pa.list_(pa.uint8(), -(-sequence // 8)), False)])


class ShardWriter:
    """Writes one shard; holds at most one batch of ids."""

    def __init__(self, folder: str, width, sequence: int):
        self.name = f"{folder}/{uuid.uuid4().hex}"
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        self.files, self.path = files, f"{path}/{self.name.rpartition('/')[2]}"
        self.sequence, self.schema = sequence, _schema(width, sequence)
        self.sink = files.open_output_stream(self.path + ".tokens.arrow")
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.rest = np.zeros(0, width)
        self.written = 0
        self.docs: list[tuple[list, np.ndarray]] = []

    def _put(self, ids: np.ndarray, real: int) -> None:
        mask = np.packbits((np.arange(len(ids)) < real).reshape(-1, self.sequence), axis=1, bitorder="little")
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), n) for x, n in ((ids, self.sequence), (mask, mask.shape[1]))]
        self.out.write_batch(pa.record_batch([c.cast(f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema))
        self.written += real

    def add(self, doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.docs.append((doc_ids, np.diff(bounds)))
        self.rest = np.concatenate([self.rest, ids])
        step = self.sequence * BATCH
        at = 0
        while len(self.rest) - at >= step:
            self._put(self.rest[at : at + step], step)
            at += step
        self.rest = self.rest[at:].copy()

    def close(self) -> tuple[str, str, int, int]:
        if real := len(self.rest):
            self._put(np.concatenate([self.rest, np.zeros(-real % self.sequence, self.rest.dtype)]), real)
        self.out.close()
        self.sink.close()
        lengths = np.concatenate([n for _, n in self.docs]) if self.docs else np.zeros(0, np.int64)
        table = pa.table({"doc_id": pa.array([d for ids, _ in self.docs for d in ids], pa.int64()), "start": np.cumsum(lengths) - lengths, "n_tokens": lengths})
        with self.files.open_output_stream(self.path + ".docs.arrow") as sink, pa.ipc.new_file(sink, table.schema) as out:
            out.write_table(table)
        return self.name + ".tokens.arrow", self.name + ".docs.arrow", len(lengths), self.written


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = 2, sequence: int = SEQUENCE) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write a store below ``folder``; returns its manifest, one row per shard in order."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        writer, shard = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(2)[0].as_py()
            writer = writer or ShardWriter(folder, encoder.width, sequence)
            _, offsets = ta.bytes_of(batch.column(1))
            for a, b in ta.groups(offsets):
                ids, bounds = encoder([t or "" for t in batch.column(1)[a:b].to_pylist()])
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], encoder.width(end_id))
                    bounds = bounds + np.arange(len(bounds))
                writer.add(batch.column(0)[a:b].to_pylist(), ids, bounds)
        if writer:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (np.int32(shard), *writer.close())], names=["shard", "tokens_path", "docs_path", "n_docs", "n_tokens"])

    parts = common.parts_for(docs, SHARD_BYTES)
    # the last key deals out rows that are equal in all
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("copy"))
        .repartitionByRange(parts, "doc_id", "tie", "copy")
        .sortWithinPartitions("doc_id", "tie", "text")
        .select("doc_id", "text", F.spark_partition_id().alias("shard"))
    )
    return common.stage(ordered.mapInArrow(ta.lean(shards), MANIFEST), "manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``: ids in all shards before; a running sum over one small row per shard."""
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


class Shard:
    """Random access to one shard; local files are memory-mapped and slices are views of the map."""

    def __init__(self, tokens_path: str):
        files, path = _open(tokens_path)
        self.file = pa.ipc.open_file(pa.memory_map(path) if files.type_name == "local" else files.open_input_file(path))
        self.sequence = self.file.schema.field("input_ids").type.list_size

    def sequences(self, batch: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a batch, of shape (sequences, length), and their masks, a bit for each id (``unpacked`` makes booleans of them); both are views."""
        got = self.file.get_batch(batch)
        ids, mask = (got.column(i).flatten().to_numpy(zero_copy_only=True).reshape(got.num_rows, -1) for i in (0, 1))
        return ids, mask

    def unpacked(self, mask: np.ndarray) -> np.ndarray:
        """Booleans, true for real ids, from packed masks."""
        return np.unpackbits(mask, axis=-1, count=self.sequence, bitorder="little").view(bool)

    def sequence_at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        ids, mask = self.sequences(i // BATCH)
        return ids[i % BATCH], mask[i % BATCH]

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, in pieces that do not cross a batch."""
        step = self.sequence * BATCH
        while n > 0:
            ids = self.file.get_batch(start // step).column(0).flatten().to_numpy(zero_copy_only=True)
            piece = ids[start % step : start % step + n]
            yield piece
            start, n = start + len(piece), n - len(piece)


def read_documents(manifest: DataFrame) -> DataFrame:
    """From a store's files, per document: doc_id, start (in the whole store), n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["tokens_path"])
                files, path = _open(row["docs_path"])
                with files.open_input_file(path) as source:
                    index = pa.ipc.open_file(source).read_all()
                for part in index.to_batches(max_chunksize=10_000):
                    sums = []
                    for start, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                        crc = 0
                        for piece in shard.tokens(start, n):
                            crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(part.column(1).to_numpy() + row["base"]), part.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    spread = starts(manifest).repartition(common.shuffle_partitions(manifest.sparkSession), "shard")
    return spread.select("shard", "tokens_path", "docs_path", "base").mapInArrow(ta.lean(documents), "doc_id long, start long, n_tokens long, ids_crc32 long")
