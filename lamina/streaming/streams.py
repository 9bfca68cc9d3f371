"""The incremental operators on Structured Streaming: debouncing, changed digests, latest-wins, and running totals with a provisional tail."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def debounced(events: DataFrame, gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """(key, started, ended, n): bursts of events (key, ts) ended by a quiet gap; state is dropped once the watermark is past it."""
    return events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("key", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def changed(events: DataFrame) -> DataFrame:
    """Events (key, seq, digest) whose digest differs from the key's last one; a null digest (a half-written file) changes nothing."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            if row.digest is not None and row.digest == row.digest and row.digest != last:
                last = row.digest
                kept.append((key[0], row.seq, last))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(kept, columns=["key", "seq", "digest"])

    return events.groupBy("key").applyInPandasWithState(step, "key string, seq long, digest string", "last string", "append", GroupStateTimeout.NoTimeout)


def latest(events: DataFrame) -> DataFrame:
    """(key, payload): the payload of the highest sequence number, updated as events (key, seq, payload) come."""
    return events.groupBy("key").agg(F.max_by("payload", "seq").alias("payload"))


def stroke_lengths(points: DataFrame) -> DataFrame:
    """(stroke, settled, provisional): a stroke's length up to its last but one point, and with its last, which may still move.

    Points (stroke, seq, x, y) come in order within a stroke; the tail is replaced in every trigger.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        settled, px, py, tail, seen = state.get if state.exists else (0.0, 0.0, 0.0, 0.0, 0)
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():
            settled += tail
            tail = ((row.x - px) ** 2 + (row.y - py) ** 2) ** 0.5 if seen else 0.0
            px, py, seen = float(row.x), float(row.y), seen + 1
        state.update((settled, px, py, tail, seen))
        yield pd.DataFrame([(key[0], settled, settled + tail)], columns=["stroke", "settled", "provisional"])

    return points.groupBy("stroke").applyInPandasWithState(step, "stroke string, settled double, provisional double", "settled double, x double, y double, tail double, seen long", "update", GroupStateTimeout.NoTimeout)


def touched_tiles(changes: DataFrame, edge: int = 256, halo: int = 0) -> DataFrame:
    """(image_id, ty, tx): tiles that changed rectangles (image_id, x0, y0, x1, y1), grown by a halo, reach: what is to be made anew."""
    span = lambda a, b: F.explode(F.sequence(F.floor((F.col(a) - halo) / edge), F.floor((F.col(b) - 1 + halo) / edge)))
    return changes.withColumn("ty", span("y0", "y1")).withColumn("tx", span("x0", "x1")).select("image_id", "ty", "tx").distinct()
