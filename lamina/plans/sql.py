"""Queries written once for Spark SQL and for DuckDB.

A ``Query`` is SQL text with ``{name}`` for each source frame. Where the two engines spell something differently, the text is made by a
function of the dialect. In Spark the sources are DataFrames and all work is left to Catalyst; in DuckDB they are subqueries, so the
same text is the query's own oracle in another engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    name: str

    @property
    def spark(self) -> bool:
        return self.name == "spark"

    def xor(self, a: str, b: str) -> str:
        return f"(({a}) ^ ({b}))" if self.spark else f"xor(CAST({a} AS BIGINT), CAST({b} AS BIGINT))"

    def shr(self, a: str, n: int) -> str:
        return f"shiftright({a}, {n})" if self.spark else f"(CAST({a} AS BIGINT) >> {n})"

    def band(self, a: str, b: str) -> str:
        return f"(({a}) & ({b}))"

    def div(self, a: str, b: str) -> str:
        """Integer division of non-negative numbers."""
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def array(self, values: list) -> str:
        return ("array(" if self.spark else "list_value(") + ", ".join(values) + ")"

    def at(self, array: str, index: str) -> str:
        """Element ``index``, from 0."""
        return f"element_at({array}, CAST({index} AS INT) + 1)" if self.spark else f"list_extract({array}, CAST({index} AS INT) + 1)"

    def mul32(self, a: str, k: int) -> str:
        """(a * k) modulo 2**32 for 0 <= a < 2**32, by halves of k, so that nothing overflows 64 bits."""
        low, high, mask = k & 0xFFFF, k >> 16, 0xFFFFFFFF
        return f"((({a}) * CAST({low} AS BIGINT) + ((({a}) * CAST({high} AS BIGINT)) & 65535) * 65536) & {mask})"

    def series(self, first: str, last: str) -> str:
        return f"sequence({first}, {last})" if self.spark else f"generate_series({first}, {last})"

    def explode(self, array: str, alias: str) -> str:
        """A select-list item with a row for each element."""
        return f"explode({array}) AS {alias}" if self.spark else f"unnest({array}) AS {alias}"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")
Text = Callable[[Dialect], str]


def num(x: float) -> str:
    """A double literal in both engines."""
    text = repr(float(x))
    text = text if "e" in text else text + "e0"
    return f"({text})" if x < 0 else text


def run(text: Text, frames: dict[str, DataFrame]) -> DataFrame:
    """``text`` in Spark over ``frames``."""
    session = next(iter(frames.values())).sparkSession
    return session.sql(text(SPARK), **frames)


@dataclass(frozen=True)
class Query:
    """``text`` over ``sources``: for each name, how to get its frame in Spark and its SQL in DuckDB.

    With ``frames``, a function of the sources' DataFrames, Spark runs that instead, and the text is what it is held against.
    """

    text: Text
    sources: dict[str, Source] = field(default_factory=dict)
    frames: Callable[..., DataFrame] | None = None

    def spark(self, session: SparkSession, sf_dir: str) -> DataFrame:
        if self.frames:
            return self.frames(*[s.frame(session, sf_dir) for s in self.sources.values()])
        return session.sql(self.text(SPARK), **{name: s.frame(session, sf_dir) for name, s in self.sources.items()})

    def duckdb(self) -> str:
        return self.text(DUCK).format(**{name: f"({s.sql(DUCK)})" for name, s in self.sources.items()})


@dataclass(frozen=True)
class Source:
    """SQL over the driver's tables, by name."""

    sql: Text
    tables: tuple[str, ...]

    def frame(self, session: SparkSession, sf_dir: str) -> DataFrame:
        text = self.sql(SPARK)
        return session.sql(text, **{t: session.read.parquet(f"{sf_dir}/{t}.parquet") for t in self.tables})


def steps(source: str, levels: list[dict[str, str]], final: str, where: str = "") -> str:
    """Nested selects that add the columns of ``levels``, each as deep as what it is made from asks for."""
    depth: dict[str, int] = {}
    nested: list[list[str]] = []
    for level in levels:
        for column, e in level.items():
            at = max((depth[word] for word in set(re.findall(r"[A-Za-z_]\w*", e)) if word in depth), default=0)
            depth[column] = at + 1
            if len(nested) <= at:
                nested.append([])
            nested[at].append(f"{e} AS {column}")
    text = f"SELECT * FROM {source}"
    for columns in nested:
        text = f"SELECT *, {', '.join(columns)} FROM ({text}) t"
    return f"SELECT {final} FROM ({text}) t {where}"
