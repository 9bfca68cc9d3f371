"""Chat formatting by token-level assembly: turns are encoded by themselves, and reserved ids are spliced in between.

A turn is formatted as its header, its escaped text and ``END``. The headers of the three usual roles are one reserved id each; any other role
stands, escaped and encoded, between two reserved ids. Reserved ids follow the vocabulary's, so no text can be encoded to one. So that the
formatted text is as safe as its ids, control strings (``MARK``, the end of a turn, the tokenizer's special tokens) inside texts and roles get a
backslash before their second character, and backslashes one before them; what is escaped holds no control string, and each backslash in
it is followed by a character that stands for itself.

Rows are dealt out by ranges of (conversation, turn), so that a conversation of any length is spread over tasks, and sorted; a task encodes each
batch of texts at once and splices by prefix sums of lengths: they give where each segment begins, and the loss mask is the running sum of
+1 where an assistant's text begins and -1 where it ends. Output rows are pieces of whole turns with at most about ``PIECE`` ids (a longer turn stands alone);
(``part``, ``piece``) orders the pieces of a conversation. A piece that surely is a conversation is marked ``whole``.

Defined results: null texts and roles are empty; turns stand in the order of turn (null last), role, text, so rows that repeat stand next to each
other and all stay; rows of null ``conv_id`` are one conversation; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm import textarray as ta
from lamina.llm.token_store import ByteLevelEncoder

MARK, END = "###", "</turn>\n"
#: Roles with a reserved id of their own, and their headers; other roles stand between ``BEFORE_ROLE`` and ``AFTER_ROLE``.
HEADERS = {"system": f"{MARK} System: ", "user": f"{MARK} User: ", "assistant": f"{MARK} Assistant: "}
BEFORE_ROLE, AFTER_ROLE = f"{MARK} ", ": "
LEARNED = "assistant"
PIECE, PART_BYTES = 65_536, 16 << 20
PIECES = "conv_id long, part int, piece long, whole boolean, n_turns long, input_ids array<int>, loss_mask array<tinyint>"
_ROWS = 512


class Template:
    """A tokenizer whose special tokens are ordinary text, and the reserved ids after its own."""

    def __init__(self, path: str):
        self.encode = ByteLevelEncoder(path)
        self.controls = [MARK, END.strip(), *self.encode.special]
        self.encode.library.encode_special_tokens = True
        self.encode.special = {}
        names = [*HEADERS.values(), BEFORE_ROLE, AFTER_ROLE, END]
        self.first = self.encode.library.get_vocab_size(with_added_tokens=True)
        self.reserved = {s: self.first + i for i, s in enumerate(names)}
        self.strings = dict(enumerate(names, self.first))
        self.header = np.array([self.reserved[s] for s in [*HEADERS.values(), BEFORE_ROLE]], np.int64)
        self.after_role, self.end = self.reserved[AFTER_ROLE], self.reserved[END]

    def decode(self, segments: list[list[int]]) -> list[str]:
        """The texts of lists of ordinary ids."""
        return self.encode.library.decode_batch(segments, skip_special_tokens=False)


@cache
def template(path: str) -> Template:
    return Template(path)


_KNOWN = {header.removeprefix(BEFORE_ROLE).removesuffix(AFTER_ROLE): role for role, header in HEADERS.items()}
#: Matches, without width, where backslashes go in a role besides: a role may not end early, nor look like another one's header.
_IN_ROLE = f"(?=:)|^(?={'|'.join(_KNOWN)})"


def escaped(text: Column, controls: list[str], *more: str) -> Column:
    """``text`` with a backslash wherever one goes."""
    places = [f"(?<=\\Q{s[0]}\\E)(?=\\Q{s[1:]}\\E)" for s in controls]
    return F.regexp_replace(text, "|".join([*places, "(?=\\\\)", *more]), "\\\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation's formatted text, which needs no ids."""
    body = r"((?:[^\\]|\\.)*?)"
    found = re.compile(re.escape(BEFORE_ROLE) + body + re.escape(AFTER_ROLE) + body + re.escape(END), re.DOTALL)
    turns, at = [], 0
    while at < len(formatted):
        turn = found.match(formatted, at)
        if turn is None:
            raise ValueError(f"no turn begins at {at}")
        turns.append((_KNOWN.get(turn[1]) or unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return turns


def _splice(t: Template, kind: np.ndarray, roles: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all turns after each other, their loss mask, and the n + 1 bounds of the turns."""
    ids, bounds = t.encode(texts)
    n = np.diff(bounds)
    other = np.flatnonzero(kind == len(HEADERS))
    role_ids, role_bounds = t.encode([roles[i] for i in other]) if len(other) else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    head = np.ones(len(kind), np.int64)
    head[other] += 1 + np.diff(role_bounds)
    ends = np.cumsum(head + n + 1)
    starts = ends - (head + n + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.int32)
    out[starts], out[ends - 1] = t.header[kind], t.end
    out[np.repeat(starts + head - bounds[:-1], n) + np.arange(len(ids))] = ids
    out[starts[other] + head[other] - 1] = t.after_role
    m = np.diff(role_bounds)
    out[np.repeat(starts[other] + 1 - role_bounds[:-1], m) + np.arange(len(role_ids))] = role_ids
    turn = np.zeros(len(out) + 1, np.int8)
    learned = np.flatnonzero((kind == list(HEADERS).index(LEARNED)) & (n > 0))
    turn[(starts + head)[learned]] += 1
    turn[ends[learned] - 1] -= 1
    return out, np.cumsum(turn[:-1], dtype=np.int8), np.append(starts, ends[-1:]) if len(ends) else np.zeros(1, np.int64)


class _Pieces:
    """Gathers a task's turns, conversation by conversation, and holds no more than one piece besides the batch."""

    def __init__(self, part: int):
        self.part, self.number, self.rows = part, 0, []
        self.ids, self.mask, self.turns, self.held = [], [], 0, 0
        self.conversation, self.begun, self.first, self.cut = None, False, True, False

    def _flush(self, whole: bool) -> None:
        ids, mask = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (self.ids, self.mask))
        self.rows.append((self.conversation, self.part, self.number, whole, self.turns, ids, mask))
        self.number += 1
        self.ids, self.mask, self.turns, self.held = [], [], 0, 0

    def close(self, last: bool) -> None:
        """Ends the conversation; the first and the last of a part may go on in other parts."""
        if self.begun and self.turns:
            self._flush(not (self.first or self.cut or last))
        self.first, self.cut, self.begun = self.first and not self.begun, False, False

    def add(self, conversation: int | None, ids: np.ndarray, mask: np.ndarray, bounds: np.ndarray) -> None:
        """Turns of one conversation."""
        if self.begun and conversation != self.conversation:
            self.close(False)
        self.conversation, self.begun = conversation, True
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if self.turns and self.held + b - a > PIECE:
                self._flush(False)
                self.cut = True
            self.ids.append(ids[a:b])
            self.mask.append(mask[a:b])
            self.turns, self.held = self.turns + 1, self.held + b - a

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        lists = []
        for i, kind in ((5, pa.int32()), (6, pa.int8())):
            offsets = np.cumsum([0, *(len(r[i]) for r in rows)]).astype(np.int32)
            lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[i] for r in rows]), kind)))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([*columns, *lists], names=[f.split()[0] for f in PIECES.split(", ")])


def assemble(conversations: DataFrame, path: str) -> DataFrame:
    """The formatted pieces (``PIECES``) of ``conversations`` (conv_id, turn, role, text) for the tokenizer of ``path``."""
    spark = conversations.sparkSession
    common.bounded_batches(spark)
    controls = template(path).controls
    role, text = F.coalesce(conversations["role"].cast("string"), F.lit("")), F.coalesce(conversations["text"].cast("string"), F.lit(""))
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role").asc()]
    # the last two spread rows that agree in all of that; they change no result, since equal rows are interchangeable
    dealt = rows.repartitionByRange(common.parts_for(rows, PART_BYTES), *by, F.substring("text", 1, 64), F.col("row")).sortWithinPartitions(*by, F.col("text"))
    ready = dealt.select("conv_id", kind_of(F.col("role")).alias("kind"), escaped(F.col("role"), controls, _IN_ROLE).alias("role"), escaped(F.col("text"), controls).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, out = template(path), _Pieces(TaskContext.get().partitionId())
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, _ROWS):
                batch = whole_batch.slice(at, _ROWS)
                ids, mask, bounds = _splice(t, batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
                conversation = batch.column(0).to_pylist()
                changes = [0, *(i for i in range(1, len(conversation)) if conversation[i] != conversation[i - 1]), len(conversation)]
                for a, b in zip(changes, changes[1:], strict=False):
                    out.add(conversation[a], ids, mask, bounds[a : b + 1])
                if out.rows:
                    yield out.batch()
        out.close(True)
        if out.rows:
            yield out.batch()

    return ready.mapInArrow(ta.lean(pieces), PIECES)


def kind_of(role: Column) -> Column:
    """A role's place among ``HEADERS``; behind them for any other."""
    out = F.lit(len(HEADERS))
    for i, name in enumerate(HEADERS):
        out = F.when(role == name, F.lit(i)).otherwise(out)
    return out


def write(conversations: DataFrame, folder: str, path: str) -> DataFrame:
    """Writes the pieces as Parquet in ``folder`` and returns them as read back."""
    assemble(conversations, path).write.parquet(folder)
    return conversations.sparkSession.read.schema(PIECES).parquet(folder)


_TEXTS = "conv_id long, part int, piece long, n_turns long, turns string, loss string, formatted string"


def texts(pieces: DataFrame, path: str) -> DataFrame:
    """Per piece, decoded from its ids and mask: ``turns`` (role, newline, text, newline of each turn), ``loss`` (all text under the mask) and ``formatted``."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = template(path)
        roles = {t.reserved[header]: role for role, header in HEADERS.items()}
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, _ROWS):
                batch = whole_batch.slice(at, _ROWS)
                lists, masks = batch.column(4), batch.column(5)
                ids, mask = lists.flatten().to_numpy(), masks.flatten().to_numpy()
                rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                # runs of ordinary ids that agree in their mask, and the reserved ids between them
                special = ids >= t.first
                edge = np.ones(len(ids), bool)
                edge[1:] = special[1:] | special[:-1] | (mask[1:] != mask[:-1]) | (rows[1:] != rows[:-1])
                first = np.flatnonzero(edge)
                last = np.append(first[1:], len(ids))
                plain = ~special[first] if len(first) else np.zeros(0, bool)
                strings = iter(t.decode([ids[a:b].tolist() for a, b in zip(first[plain].tolist(), last[plain].tolist(), strict=True)]))
                turns, loss, formatted = ([[] for _ in range(len(lists))] for _ in range(3))
                role, said, named = "", [], False
                for a, ordinary in zip(first.tolist(), plain.tolist(), strict=True):
                    i, row = int(ids[a]), int(rows[a])
                    s = next(strings) if ordinary else t.strings[i]
                    formatted[row].append(s)
                    if ordinary:
                        if named:
                            role = s
                        else:
                            said.append(s)
                            if mask[a]:
                                loss[row].append(unescaped(s))
                    elif i == t.end:
                        turns[row].append(f"{unescaped(role)}\n{unescaped(''.join(said))}\n")
                        said = []
                    elif i == t.after_role:
                        named = False
                    else:
                        role, named = roles.get(i, ""), i == t.reserved[BEFORE_ROLE]
                columns = [batch.column(i) for i in range(4)] + [pa.array(["".join(x) for x in c], pa.string()) for c in (turns, loss, formatted)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _TEXTS.split(", ")])

    return pieces.select("conv_id", "part", "piece", "n_turns", "input_ids", "loss_mask").mapInArrow(ta.lean(decoded), _TEXTS)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(pieces: DataFrame, path: str) -> DataFrame:
    """One row per conversation, as read from its pieces. Those in one piece are not shuffled; the pieces of others pass one task each in order, none held."""
    whole = texts(pieces.filter("whole"), path).select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, state = None, None

        def row() -> pa.RecordBatch:
            n, turns, chars, loss, formatted = state
            values = (now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in _DIGEST.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != now:
                    if state is not None:
                        yield row()
                    now, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += r["n_turns"]
                state[1].update(r["turns"].encode())
                state[2] += len(r["loss"])
                state[3].update(r["loss"].encode())
                state[4] += r["formatted_chars"]
        if state is not None:
            yield row()

    parts = texts(pieces.filter("NOT whole"), path).withColumn("formatted_chars", F.length("formatted").cast("long")).drop("formatted")
    ordered = parts.repartition(common.shuffle_partitions(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return whole.unionByName(ordered.mapInArrow(ta.lean(joined), _DIGEST))


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user's and an assistant's turn whose text holds a backslash and control strings."""
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
