"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target in words: a share of the total by weight, capped at ``MOST`` times its size, the excess shared again by weight. A
document is then wanted target / source size times: its whole copies are certain, the fraction left is rounded so that the source's words
stay what they should be. Two documents meet; as many words as make one of them integral move from one to the other, the direction drawn so
that each keeps its expected copies; the one still fractional meets the next. Documents meet first within buckets of about ``BUCKET``
(by hash, so that a hot source is spread like any other), then what each bucket has left meets in a reduction tree, ``FAN_IN`` buckets to one,
until one document per source is left, which goes to the nearer side. So a source misses its target by at most half a document, and every
draw hangs on hashes of rows alone: reruns agree, however rows are dealt out.

Defined results: null and empty texts have size 0 and are taken 0 times; a null source is a source, last in order; a source without words has
target 0; repeated rows are one unit, and each gets as many copies as another or one more (as many of them in every run, however rows lie); null ids
are ids; an empty table gives no rows; ``mix`` keeps the input's columns whatever their names and types.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lamina.llm import common
from lamina.llm import textarray as ta

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
BUCKET, FAN_IN = 2048, 64
BROADCAST_SOURCES = 2_000
_SEED = np.uint64(0x5DEECE66D)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` (one row each) with ``rank``, from 0 in code point order, null last; no task holds more than its range."""
    spark = sources.sparkSession
    keys = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(common.shuffle_partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = common.stage(dealt, "sources")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = {r.part: r["count"] for r in dealt.groupBy(part.alias("part")).count().collect()}  # one row per partition
    before, offsets = 0, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    table = F.create_map(*[F.lit(x).cast("long") for pair in offsets for x in pair]) if offsets else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return dealt.withColumn("rank", F.element_at(table, part) + place).drop("at")


def targets(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: source, rank, n, source_size, target, of ``units`` (source, size, and how often, m). ``weights`` repeat along the ranks.

    The water level, at which a source of weight w gets w * level or its cap, is found by Newton steps from below: each is one sum over the
    sources, and the set of capped sources only grows.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("n"))
    ranked = _ranked(sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = common.stage(ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most)), "ranked")
    total, all_weights = ranked.agg(F.sum("source_size"), F.sum(F.when(F.col("cap") > 0, F.col("weight")))).first()
    level, goal = 0.0, share * (total or 0)
    if goal and all_weights:
        level, capped = goal / all_weights, -1
        while True:
            full = F.col("cap") <= F.col("weight") * level
            used, free, n = ranked.agg(F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.sum(full.cast("long"))).first()
            if n == capped or not free:
                break
            capped, level = n, (goal - used) / free
        if not free:
            level = float("inf")
    target = F.when(F.col("cap") > 0, F.least(F.col("cap"), F.col("weight") * level)).otherwise(0.0)
    return common.stage(ranked.select("source", "rank", "n", "source_size", target.alias("target")), "targets")


def settle(hashes: np.ndarray, sizes: np.ndarray, shares: np.ndarray, last: bool) -> np.ndarray:
    """Pivotal rounding of one group: 0 or 1 for each unit, and its share for the one left over (if ``last``, that is rounded).

    Long documents meet first and many short ones after them, in whose small steps the long ones become integral: what is left is short.
    """
    out = shares.astype(float)
    order = np.lexsort((hashes, -sizes))
    draws = (ta.mix(hashes.astype(np.uint64) ^ _SEED)[order] >> np.uint64(11)).astype(float) / (1 << 53)
    held = -1
    for i, draw in zip(order.tolist(), draws.tolist(), strict=True):
        if held < 0:
            held = i
            continue
        a, b, size_a, size_b = out[held], out[i], float(sizes[held]), float(sizes[i])
        up, down = min((1 - a) * size_a, b * size_b), min(a * size_a, (1 - b) * size_b)
        if draw * (up + down) < down:  # ``held`` gains ``up`` words with chance down / (up + down)
            full, empty = (1 - a) * size_a <= b * size_b, (1 - a) * size_a >= b * size_b
            out[held], out[i] = 1.0 if full else a + up / size_a, 0.0 if empty else b - up / size_b
        else:
            full, empty = (1 - b) * size_b <= a * size_a, (1 - b) * size_b >= a * size_a
            out[i], out[held] = 1.0 if full else b + down / size_b, 0.0 if empty else a - down / size_a
        held = next((x for x in (held, i) if 0 < out[x] < 1), -1)
    if last and held >= 0:
        out[held] = float(out[held] >= 0.5)
    return out


def _round(last: bool) -> Callable[[pa.Table], pa.Table]:
    def group(table: pa.Table) -> pa.Table:
        shares = settle(*(table.column(c).to_numpy() for c in ("h", "size", "left")), last)
        return table.set_column(table.schema.get_field_index("left"), "left", pa.array(shares))

    return group


def allocate(units: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``units`` (source, size, h and any others; h a hash of the row) with source_size, target and ``copies`` int, one row for each.

    Equal rows (of one h, source and size) are one unit with their number's multiple of the copies, so that a row that is repeated without
    end is added up before it is shuffled; they share the copies by their places in the table's partitions.
    """
    units = common.stage(units.withColumn("_at", F.monotonically_increasing_id()), "units")
    part, same = F.shiftright("_at", 33).alias("_part"), ["h", "source", "size"]
    counts = common.stage(units.groupBy(*same, part).agg(F.count("*").alias("_here")), "counts")
    groups = counts.groupBy(*same).agg(F.sum("_here").alias("m"))
    per_source = targets(groups, weights, share, most)
    few = per_source.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    side = per_source.select(F.col("source").alias("_source"), "rank", "n", "source_size", "target")
    joined = groups.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    wanted = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("whole", F.floor(wanted).cast("int")).withColumn("left", (wanted - F.floor(wanted)) * F.col("m"))
    joined = joined.withColumn("sure", F.floor("left")).withColumn("left", F.col("left") - F.col("sure"))
    joined = joined.withColumn("buckets", F.ceil(F.col("n") / BUCKET)).withColumn("bucket", F.pmod(F.col("h"), F.col("buckets"))).drop("n")
    joined = common.stage(joined, "groups")
    result = [joined.filter("left <= 0 OR left >= 1")]
    rest = joined.filter("left > 0 AND left < 1")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rest.schema])
    level = joined.agg(F.max("buckets")).first()[0] or 1
    while True:
        one = level <= 1
        done = common.stage(rest.groupBy("rank", "bucket").applyInArrow(ta.lean(_round(one)), schema), "rounded")
        result.append(done.filter("left <= 0 OR left >= 1"))
        if one:
            break
        level = -(-level // FAN_IN)
        rest = done.filter("left > 0 AND left < 1").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    out = result[0]
    for r in result[1:]:
        out = out.unionByName(r)
    settled = out.select(*[F.col(c).alias(f"_{c}") for c in same], "whole", "source_size", "target", (F.col("sure") + F.col("left")).cast("long").alias("more"))
    equal = lambda *more: [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*same, *more)]
    before = F.coalesce(F.sum("_here").over(Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = counts.withColumn("_before", before).join(settled, _all(equal())).select(*[f"_{c}" for c in same], "_part", "whole", "source_size", "target", F.least(F.greatest(F.col("more") - F.col("_before"), F.lit(0)), F.col("_here")).alias("_more"))
    placed = units.withColumn("_in", part).join(shares, _all([*equal(), F.col("_in") == F.col("_part")]))
    place = F.row_number().over(Window.partitionBy("_h", "_source", "_size", "_part").orderBy("_at"))
    copies = (F.col("whole") + (place <= F.col("_more")).cast("int")).cast("int")
    return placed.withColumn("copies", copies).select(*[c for c in units.columns if c != "_at"], "source_size", "target", "copies")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _has_map(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType) or isinstance(kind, T.StructType) and any(_has_map(f.dataType) for f in kind)


def _row_hash(docs: DataFrame, columns: list[str]) -> Column:
    """A hash of ``columns``; those with maps, which have no hash, take part as JSON."""
    return F.xxhash64(F.lit(17), *[F.to_json(F.struct(docs[c].alias("c"))) if _has_map(docs.schema[c].dataType) else docs[c] for c in columns])


def units_of(docs: DataFrame, *others: str) -> DataFrame:
    return docs.select(*others, F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _row_hash(docs, ["doc_id", "source", "text"]).alias("h"))


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (words: copies times size)."""
    return allocate(units_of(docs, "doc_id"), weights, share, most).withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken. Rows are staged with a number, by which they get their copies."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), docs["source"].cast("string").alias("source"), word_count(docs["text"]).alias("size"), _row_hash(docs, docs.columns).alias("h"), F.monotonically_increasing_id().alias("_id"))
    rows = common.stage(own, "rows")
    taken = allocate(rows.select("_id", "source", "size", "h"), weights, share, most).filter("copies > 0").select("_id", "copies")
    return rows.select("_row", "_id").join(taken, "_id").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")
