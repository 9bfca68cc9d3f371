"""Audit of how sources differ from each other and from their language, by term frequencies added up in DuckDB shard by shard.

Tasks count the terms of whole texts by (lang, source, term), add up what they hold and deal it out to shards by a hash of lang and term. In
each shard DuckDB adds the counts up in SQL and keeps the terms of each language that stand in at least ``LEAST_DOCS`` of its documents;
all sources of a term are then in one piece of one shard. Spark adds up the totals of groups. With them, each piece is taken by DuckDB
again: probabilities, sums over pairs of sources, and the ``TOP`` terms of each group, which Spark adds up and ranks.

Sums over pairs are over terms that occur. A pair (p's, q's) of sources without the term has the same divergence f(p0, q0) for all such terms, so a sum over all V terms
is V f(p0, q0), plus f(p, q0) - f(p0, q0) for each term of the one, f(p0, q) - f(p0, q0) for each term of the other, and for terms of both
f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0). So no piece is larger than the counts that there are, and only terms that two sources share are joined.
All arithmetic is of integers: 64 bits where numbers are below 2 ** 63 by their meaning, 128 bits for sums and quotients of counts.

Defined results: null texts, langs and sources are empty strings; each row is a document, repeated ones too; a language without kept terms has pairs of divergence 0 and
no terms; an empty table gives no rows; other columns play no part.
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

LEAST_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Bytes of input for each shard, rows that a task holds, rows of a piece, and pairs of sources whose sums are held at a time.
SHARD_BYTES, _HELD, PIECE, PAIRS = 24 << 20, 400_000, 400_000, 1_000_000
_COUNTS = ("lang", "source", "term", "n", "docs")


def _duckdb():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": "", "preserve_insertion_order": False})


def _added(con, tables: list[pa.Table]) -> pa.Table:
    """Equal (lang, source, term) of some counts are one row."""
    con.register("parts", pa.concat_tables(tables))
    return con.sql("SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM parts GROUP BY lang, source, term").to_arrow_table()


def _terms(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Per group and distinct term of some texts: the group, the term's number; the terms; counts and documents."""
    data = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    inside = ((data >= 0x61) & (data <= 0x7A)) | (data >= 0x80)
    begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    begins[:-1] = inside
    begins[1:-1] &= ~inside[:-1]
    ends[1:] = inside
    ends[1:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[edge], ends[edge] = inside[edge], inside[edge - 1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends)
    if not len(first):
        return group[:0], group[:0], pa.array([], pa.string()), first, first
    at, inverse, _ = ta.distinct(data, first, end)
    row = np.searchsorted(offsets, first, "right") - 1
    by_row, n = np.unique(row * np.int64(len(at)) + inverse, return_counts=True)
    key = group[by_row // len(at)] * np.int64(len(at)) + by_row % len(at)
    keys, place = np.unique(key, return_inverse=True)
    size = np.cumsum(np.append(0, end[at] - first[at]))
    flat = data[np.repeat(first[at] - size[:-1], np.diff(size)) + np.arange(size[-1])]
    spelled = pa.StringArray.from_buffers(len(at), pa.py_buffer(size.astype(np.int32)), pa.py_buffer(flat))
    return keys // len(at), keys % len(at), spelled, np.bincount(place, n).astype(np.int64), np.bincount(place)


_BLOB = "shard int, blob binary"


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def _opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def shard_counts(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): counts of terms, added up by tasks as far as they hold them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, held = _duckdb(), []

        def dealt(table: pa.Table) -> Iterator[pa.RecordBatch]:
            con.register("counts", table)
            rows = con.sql(f"SELECT (hash(lang, term) % {shards})::INTEGER AS shard, * FROM counts ORDER BY shard, lang, source, term").to_arrow_table()
            shard = rows.column("shard").to_numpy()
            bounds = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(1, np.int64)
            blobs = [_packed(rows.drop_columns("shard").slice(a, b - a)) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[bounds[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        for batch in batches:
            data, offsets = ta.bytes_of(batch.column(2))
            groups: dict[tuple[str, str], int] = {}
            group = np.array([groups.setdefault(g, len(groups)) for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            lang, source = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            for a, b in ta.groups(offsets, 4 << 20):
                of, term, spelled, n, documents = _terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], group[a:b])
                held.append(pa.table([lang.take(pa.array(of)), source.take(pa.array(of)), spelled.take(pa.array(term)), pa.array(n), pa.array(documents)], names=list(_COUNTS)))
                if sum(t.num_rows for t in held) > _HELD:
                    held[:] = [_added(con, held)]
                    if held[0].num_rows > _HELD // 2:
                        yield from dealt(held.pop())
        if held:
            yield from dealt(_added(con, held))

    return docs.mapInArrow(ta.lean(counted), _BLOB)


_KEPT = "lang string, terms long, totals binary, counts binary"


def kept_counts(shard_rows: DataFrame) -> DataFrame:
    """Pieces of the kept terms' counts: lang, number of terms, packed (source, total) and packed (source, term, n); a piece has all sources of its terms."""

    def added(table: pa.Table) -> pa.Table:
        con = _duckdb()
        # a hot term has a row for each task and source, so what is held is added up on the way
        held, rows, most = [], 0, 4 * _HELD
        for blob in table.column("blob"):
            held.append(_opened(blob.as_py()))
            rows += held[-1].num_rows
            if rows > most:
                held = [_added(con, held)]
                rows = held[0].num_rows
                most = max(4 * _HELD, 2 * rows)
        con.register("all_counts", _added(con, held))
        kept = con.sql(
            f"""SELECT lang, source, term, n FROM (SELECT *, sum(docs) OVER (PARTITION BY lang, term) AS in_docs FROM all_counts)
            WHERE in_docs >= {LEAST_DOCS} ORDER BY lang, term, source"""
        ).to_arrow_table()
        con.register("kept", kept)
        out: list[tuple[str, int, bytes, bytes]] = []
        if kept.num_rows:
            edges = con.sql("SELECT lang, term, count(*) AS n FROM kept GROUP BY lang, term ORDER BY lang, term").to_arrow_table()
            langs, sizes = edges.column("lang").to_pylist(), np.cumsum(edges.column("n").to_numpy())
            first, begin = 0, 0
            for i, lang in enumerate(langs):
                if i + 1 == len(langs) or langs[i + 1] != lang or sizes[i + 1] - begin > PIECE:
                    part = kept.slice(begin, int(sizes[i]) - begin)
                    con.register("part", part)
                    totals = con.sql("SELECT source, sum(n)::BIGINT AS n FROM part GROUP BY source").to_arrow_table()
                    out.append((lang, i + 1 - first, _packed(totals), _packed(part.drop_columns("lang"))))
                    first, begin = i + 1, int(sizes[i])
        kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
        columns = zip(*out, strict=True) if out else ((), (), (), ())
        return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _KEPT.split(", ")])

    return shard_rows.groupBy("shard").applyInArrow(ta.lean(added), _KEPT)


def _totals(pieces: DataFrame) -> DataFrame:
    """(lang, source, n) of each piece."""

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = _opened(blob)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * part.num_rows, pa.string()), *(part.column(c).combine_chunks() for c in ("source", "n"))], names=["lang", "source", "n"])

    return pieces.select("lang", "totals").mapInArrow(ta.lean(opened), "lang string, source string, n long")


_SUMS = "part string, lang string, source string, item string, value decimal(38,0)"
_F = "((({0}) - ({1})) * (({0}) - ({1})) // ({1}))"


def piece_sums(pieces: DataFrame) -> DataFrame:
    """Of ``pieces`` (lang, counts, v, total, groups: the language's sources and their totals): what its terms add to each pair, and each group's ``TOP`` terms."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duckdb()
        for batch in batches:
            for row in batch.to_pylist():
                lang, v = row["lang"], row["v"]
                groups = pa.table({"source": [g["source"] for g in row["groups"]], "total": pa.array([g["total"] for g in row["groups"]], pa.int64())})
                con.register("sent_groups", groups)
                con.register("sent_counts", _opened(row["counts"]))
                con.execute(f"CREATE OR REPLACE TEMP TABLE g AS SELECT row_number() OVER () AS i, source, total, (1 + {SCALE}::HUGEINT // (total::HUGEINT + {v}))::BIGINT AS p0 FROM sent_groups")
                con.execute(f"CREATE OR REPLACE TEMP TABLE k AS SELECT g.i, c.term, c.n, g.p0, (1 + {SCALE}::HUGEINT * (c.n + 1) // (g.total::HUGEINT + {v}))::BIGINT AS p FROM sent_counts c JOIN g USING (source)")
                terms = con.sql(
                    f"""WITH l AS (SELECT term, (1 + {SCALE}::HUGEINT * (sum(n) + 1) // ({row["total"]}::HUGEINT + {v}))::BIGINT AS q FROM k GROUP BY term),
                    f AS (SELECT k.i, term, {_F.format("k.p", "l.q")} AS value FROM k JOIN l USING (term) WHERE k.p > l.q)
                    SELECT 'term' AS part, g.source, term AS item, value::DECIMAL(38, 0) AS value
                    FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value DESC, term) AS place FROM f) JOIN g USING (i) WHERE place <= {TOP}"""
                ).to_arrow_table()
                found = [terms]
                step = max(1, PAIRS // max(1, groups.num_rows))
                for first in range(1, groups.num_rows + 1, step):
                    # p's of a block of sources; their terms against all others' zero counts, others' terms against theirs, and what both have
                    block = f"BETWEEN {first} AND {first + step - 1}"
                    alone = _F.format("a.p0", "b.p0")
                    found.append(
                        con.sql(
                            f"""WITH h AS (SELECT i, p, p0, count(*) AS times FROM k GROUP BY i, p, p0), s AS (
                            SELECT a.i AS i, b.i AS j, sum(a.times * ({_F.format("a.p", "b.p0")} - {alone})) AS value FROM h a JOIN g b ON a.i <> b.i WHERE a.i {block} GROUP BY a.i, b.i
                            UNION ALL
                            SELECT a.i, b.i, sum(b.times * ({_F.format("a.p0", "b.p")} - {alone})) FROM g a JOIN h b ON a.i <> b.i WHERE a.i {block} GROUP BY a.i, b.i
                            UNION ALL
                            SELECT a.i, b.i, sum({_F.format("a.p", "b.p")} - {_F.format("a.p", "b.p0")} - {_F.format("a.p0", "b.p")} + {alone})
                            FROM k a JOIN k b ON a.term = b.term AND a.i <> b.i WHERE a.i {block} GROUP BY a.i, b.i)
                            SELECT 'pair' AS part, x.source, y.source AS item, sum(s.value)::DECIMAL(38, 0) AS value
                            FROM s JOIN g x ON x.i = s.i JOIN g y ON y.i = s.j GROUP BY x.source, y.source"""
                        ).to_arrow_table()
                    )
                for out in found:
                    if out.num_rows:
                        columns = [out.column(c).combine_chunks() for c in ("part", "source", "item", "value")]
                        yield pa.RecordBatch.from_arrays([columns[0], pa.array([lang] * out.num_rows, pa.string()), *columns[1:3], columns[3].cast(pa.decimal128(38, 0))], names=[f.split()[0] for f in _SUMS.split(", ")])

    return pieces.select("lang", "counts", "v", "total", "groups").mapInArrow(ta.lean(summed), _SUMS)


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    pieces = common.stage(kept_counts(shard_counts(rows, common.parts_for(rows, SHARD_BYTES))), "divergence-counts")
    sizes = _totals(pieces).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = pieces.groupBy("lang").agg(F.sum("terms").alias("v"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = common.stage(groups.select("lang", "source", F.coalesce("n", F.lit(0)).cast("long").alias("total"), F.coalesce("v", F.lit(0)).cast("long").alias("v")), "divergence-groups")
    # one row for each language: its sources' totals are sent to its pieces, by broadcast only if Spark finds them small
    of_lang = groups.groupBy("lang", "v").agg(F.sum("total").alias("total"), F.collect_list(F.struct("source", "total")).alias("groups"))
    sums = common.stage(piece_sums(pieces.select("lang", "counts").join(of_lang, "lang")), "divergence-sums")

    zero = f"1 + (CAST({SCALE} AS DECIMAL(38, 0)) DIV (%s.total + %s.v))"
    x, y = groups.alias("x"), groups.alias("y")
    pairs = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") != F.col("y.source"))).select(F.col("x.lang").alias("lang"), F.col("x.source").alias("source"), F.col("y.source").alias("item"), F.col("x.v").alias("v"), *(F.when(F.col(f"{s}.v") > 0, F.expr(zero % (s, s))).otherwise(F.lit(1)).cast("long").alias(c) for s, c in (("x", "p0"), ("y", "q0"))))
    added = sums.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("more"))
    value = F.expr("CAST(v AS DECIMAL(20, 0)) * (((p0 - q0) * (p0 - q0)) DIV q0)") + F.coalesce("more", F.lit(0))
    of_pairs = pairs.join(added, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = of_pairs.withColumn("rank", F.row_number().over(by))
    terms = sums.filter("part = 'term'").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"))
    return ranked.unionByName(terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= TOP))
