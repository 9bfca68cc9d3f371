"""Orders of work that hang on what came before: files admitted under a pixel budget, and edits of text styles over ranges.

Neither is walked in one place. Admission is a prefix sum over ranges of the queue, begun again behind each file that does not fit; what covers a piece of text last is found
through dyadic blocks of its places, so that an edit of any length is a few rows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lamina.plans.sql import Dialect, Text
from lamina.plans.staging import staged

#: Pixels of a document, and of a side.
BUDGET, MOST_SIDE = 400_000_000, 30_000


def running(frame: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """``frame`` with ``name``: the sum of ``value`` over the rows of its ``key`` up to its own in ``order``, of which none is equal.

    Ranges of (key, order) are added up each by itself, and what stands in earlier ranges is added to them, so no key's rows need meet in one task.
    """
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(frame.repartitionByRange(parts, key, order).withColumn("_part", F.spark_partition_id()))
    totals = dealt.groupBy(key, "_part").agg(F.sum(value).alias("_total"))
    before = totals.select(key, "_part", (F.sum("_total").over(Window.partitionBy(key).orderBy("_part")) - F.col("_total")).alias("_before"))
    own = F.sum(value).over(Window.partitionBy(key, "_part").orderBy(order))
    return dealt.withColumn("_own", own).join(before, [key, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_own", "_before", "_part")


def admitted(files: DataFrame, budget: int = BUDGET, most_side: int = MOST_SIDE) -> DataFrame:
    """(queue_id, seq, status, used) of ``files`` (queue_id, seq, width, height, error): what becomes of each file of a queue in order.

    A file is ``unreadable`` if it has an error or no size, ``too large`` if a side or its pixels are more than what is left of the budget when its turn comes, and ``imported``
    otherwise; ``used``: pixels of its queue's document after its turn. What does not fit takes nothing, and smaller files behind it may fit.
    """
    size = F.col("width").cast("long") * F.col("height")
    bad = F.col("error").isNotNull() | F.col("width").isNull() | F.col("height").isNull() | (F.col("width") < 1) | (F.col("height") < 1)
    rows = staged(files.select("queue_id", "seq", F.when(bad, "unreadable").when((F.col("width") > most_side) | (F.col("height") > most_side), "too large").alias("status"), F.when(bad, 0).otherwise(size).alias("size")))
    left = rows.select("queue_id").distinct().withColumn("left", F.lit(budget).cast("long"))
    open_, taken = rows.filter("status IS NULL").drop("status"), None
    while True:
        # the budget only shrinks, so what is beyond it now will never fit
        summed = running(open_.join(left, "queue_id").filter("size <= left"), "queue_id", "seq", "size", "sum")
        over = staged(summed.filter("sum > left").groupBy("queue_id").agg(F.min("seq").alias("first_over")))
        met = summed.join(over, "queue_id", "left")
        now = staged(met.filter("first_over IS NULL OR seq < first_over").select("queue_id", "seq", "size"))
        taken = now if taken is None else staged(taken.unionByName(now))
        if not over.limit(1).count():
            break
        spent = now.groupBy("queue_id").agg(F.sum("size").alias("spent"))
        left = staged(left.join(over, "queue_id").join(spent, "queue_id", "left").select("queue_id", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left")))
        open_ = staged(met.filter("seq > first_over").select("queue_id", "seq", "size"))
    imported = taken.select("queue_id", "seq", F.lit(True).alias("fits"), F.col("size").alias("takes"))
    judged = rows.join(imported, ["queue_id", "seq"], "left")
    status = F.coalesce("status", F.when(F.col("fits"), "imported").otherwise("too large"))
    done = judged.select("queue_id", "seq", status.alias("status"), F.coalesce("takes", F.lit(0)).cast("long").alias("takes"))
    return running(done, "queue_id", "seq", "takes", "used").select("queue_id", "seq", "status", "used")


def admitted_sql(budget: int, most_side: int = MOST_SIDE) -> Text:
    """``admitted`` as a loop: one file of each queue after the other."""

    def text(d: Dialect) -> str:
        bad = "error IS NOT NULL OR width IS NULL OR height IS NULL OR width < 1 OR height < 1"
        named = f"SELECT queue_id, seq, {bad} AS bad, width > {most_side} OR height > {most_side} AS wide, CAST(width AS BIGINT) * height AS size, row_number() OVER (PARTITION BY queue_id ORDER BY seq) AS k FROM {{files}} f"
        step = f"CASE WHEN n.bad THEN 'unreadable' WHEN n.wide OR n.size > {budget} - w.used THEN 'too large' ELSE 'imported' END"
        used = f"w.used + CASE WHEN n.bad OR n.wide OR n.size > {budget} - w.used THEN 0 ELSE n.size END"
        return (
            f"WITH RECURSIVE n AS ({named}), w AS (SELECT DISTINCT queue_id, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS k, '' AS status, CAST(0 AS BIGINT) AS used FROM n "
            f"UNION ALL SELECT n.queue_id, CAST(n.seq AS BIGINT), n.k, {step}, {used} FROM w JOIN n ON n.queue_id = w.queue_id AND n.k = w.k + 1) SELECT queue_id, seq, status, used FROM w WHERE k > 0"
        )

    return text


def _png(data: bytes) -> tuple[int, int]:
    return struct.unpack(">II", data[16:24])


def _layered(data: bytes) -> tuple[int, int]:
    height, width = struct.unpack(">II", data[14:22])
    return width, height


def _jpeg(data: bytes) -> tuple[int, int]:
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
        # frames but for the tables that share their range
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    raise ValueError("no frame")


#: How files of each kind begin.
_KINDS = ((b"\x89PNG\r\n\x1a\n", _png), (b"8BPS", _layered), (b"\xff\xd8", _jpeg))


def probed(files: DataFrame) -> DataFrame:
    """``files`` (queue_id, seq, path, content) with the sizes that their headers tell, read once; what tells none has an ``error`` (queue_id, seq, path, width, height, error)."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(3):
                data = content.as_buffer().to_pybytes() if content.is_valid else b""
                read = next((f for magic, f in _KINDS if data.startswith(magic)), None)
                try:
                    if read is None:
                        raise ValueError("unknown kind of file")
                    out.append((*read(data), None))
                except (ValueError, struct.error) as e:
                    out.append((None, None, str(e)))
            columns = [batch.column(i) for i in range(3)] + [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["queue_id", "seq", "path", "width", "height", "error"])

    rows = files.select(F.col("queue_id").cast("long").alias("queue_id"), F.col("seq").cast("long").alias("seq"), F.col("path").cast("string").alias("path"), "content")
    return rows.mapInArrow(sizes, "queue_id long, seq long, path string, width long, height long, error string")


ATTRIBUTES = ("font", "size", "colour")


def restyled(runs: DataFrame, edits: DataFrame, attributes: tuple[str, ...] = ATTRIBUTES) -> DataFrame:
    """(text_id, start, length, ``attributes``): ``runs`` (the same) after ``edits`` (text_id, seq, first, last, attribute, value) of ranges [first, last) in UTF-16 units, in order.

    Runs are split where edits begin and end; of the edits of an attribute that cover a piece the last one holds; neighbours that are then alike are one run. Edits are cut to their text, and empty ones change nothing.
    """
    bounds = runs.groupBy("text_id").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("length")).alias("high"))
    cut = edits.join(bounds, "text_id").select("text_id", "seq", F.greatest("first", "low").alias("first"), F.least("last", "high").alias("last"), "attribute", "value").filter("first < last")
    marks = runs.select("text_id", F.col("start").alias("at")).unionByName(bounds.select("text_id", F.col("high").alias("at"))).unionByName(cut.select("text_id", F.explode(F.array("first", "last")).alias("at"))).distinct()
    order = Window.partitionBy("text_id").orderBy("at")
    pieces = staged(marks.select("text_id", "at", (F.row_number().over(order) - 1).cast("long").alias("place"), F.lead("at").over(order).alias("end")))
    places = pieces.select("text_id", "at", "place")
    spans = cut.join(places.select("text_id", F.col("at").alias("first"), F.col("place").alias("i")), ["text_id", "first"]).join(places.select("text_id", F.col("at").alias("last"), F.col("place").alias("j")), ["text_id", "last"])
    # [i, j) as blocks of 2 ** k places: at each size at most the first and the last of those that remain
    each = spans.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(F.col("j") - F.col("i"), F.lit(1)))).cast("int"))))
    width = F.expr("shiftleft(1L, k)")
    low, high = F.ceil(F.col("i") / width).cast("long"), F.floor(F.col("j") / width).cast("long")
    both = F.array(F.when((low < high) & (low % 2 == 1), low), F.when((high % 2 == 1) & (high - 1 >= low + low % 2), high - 1))
    blocks = each.select("text_id", "attribute", "seq", "value", "k", F.explode(both).alias("block")).filter("block IS NOT NULL")
    last = blocks.groupBy("text_id", "attribute", "k", "block").agg(F.max(F.struct("seq", "value")).alias("edit"))
    real = pieces.filter("end IS NOT NULL")
    above = real.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(40)))).select("text_id", "at", "k", F.expr("shiftright(place, k)").alias("block"))
    levels = last.select("text_id", "k").distinct()
    held = above.join(levels, ["text_id", "k"], "left_semi").join(last, ["text_id", "k", "block"]).groupBy("text_id", "at").pivot("attribute", list(attributes)).agg(F.max("edit"))
    # the run that a piece was cut from is the last one that begins at or before it
    given = real.join(runs.select("text_id", F.col("start").alias("at"), F.col("length"), *attributes), ["text_id", "at"], "left")
    upto = Window.partitionBy("text_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    based = given.select("text_id", "at", "end", *[F.last(F.when(F.col("length").isNotNull(), F.struct(a)), True).over(upto).alias(a) for a in attributes])
    edited = held.select("text_id", "at", *[F.col(a).alias(f"_{a}") for a in attributes])
    styled = based.join(edited, ["text_id", "at"], "left").select("text_id", "at", "end", *[F.when(F.col(f"_{a}").isNotNull(), F.col(f"_{a}.value")).otherwise(F.col(f"{a}.{a}")).alias(a) for a in attributes])
    by = Window.partitionBy("text_id").orderBy("at")
    same = F.lit(True)
    for a in attributes:
        same = same & F.col(a).eqNullSafe(F.lag(a).over(by))
    islands = styled.withColumn("_run", F.sum((~(same & F.lag("at").over(by).isNotNull())).cast("int")).over(by))
    merged = islands.groupBy("text_id", "_run").agg(F.min("at").alias("start"), F.max("end").alias("_end"), *[F.first(a).alias(a) for a in attributes])
    return merged.select("text_id", F.col("start").cast("long").alias("start"), (F.col("_end") - F.col("start")).cast("long").alias("length"), *attributes)


def restyled_sql(attributes: tuple[str, ...] = ATTRIBUTES) -> Text:
    """``restyled`` with one row for each unit of each text."""

    def text(d: Dialect) -> str:
        latest = ", ".join(f"CASE WHEN max(e.seq) FILTER (WHERE e.attribute = '{a}') IS NOT NULL THEN max_by(e.value, e.seq) FILTER (WHERE e.attribute = '{a}') ELSE any_value(u.{a}) END AS {a}" for a in attributes)
        units = "SELECT *, unnest(range(start, start + length)) AS unit FROM {runs} r"
        styled = f"SELECT u.text_id, u.unit, {latest} FROM ({units}) u LEFT JOIN {{edits}} e ON e.text_id = u.text_id AND u.unit >= e.first AND u.unit < e.last GROUP BY u.text_id, u.unit"
        order = "(PARTITION BY text_id ORDER BY unit)"
        alike = " AND ".join(f"{a} IS NOT DISTINCT FROM lag({a}) OVER {order}" for a in attributes)
        marked = f"SELECT *, CASE WHEN lag(unit) OVER {order} IS NOT NULL AND {alike} THEN 0 ELSE 1 END AS begins FROM ({styled}) s"
        runs = f"SELECT *, sum(begins) OVER (PARTITION BY text_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ({marked}) m"
        return f"SELECT text_id, CAST(min(unit) AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS length, {', '.join(f'any_value({a}) AS {a}' for a in attributes)} FROM ({runs}) q GROUP BY text_id, run"

    return text
