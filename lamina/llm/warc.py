"""WARC archives: a writer with revisit records, and a reader that splits gzip files at members.

Each record is a gzip member of its own. A reading task owns the members that start within its byte range: it looks for gzip's magic bytes, and
takes a place as a member's start only if members follow each other from there on, each decoded whole with its checksum and beginning with a
``WARC/1.`` record, to the end of the file or for ``PROOF`` bytes. Where a payload holds members of its own, they stand literally only in stored
deflate blocks or extra fields, neither of which reaches that far, and what follows them there is no member. From the first
one the task goes from member to member, past the end of its range for the last one. No index is needed, and ranges may be cut anywhere.

Defined results: a null payload is an empty one; payloads under ``LEAST_REVISIT`` bytes are always written in full; of records with equal longer
payloads, the one with the largest id is the response, and where that id is repeated (or all ids are null), every row that holds it is one;
a null id stays null and never is the response of others; an empty table gives no archive and no rows; other columns play no part. In archives of
others, headers may be of any length and have any optional field; all records of a member that holds several are read, at the member's place; a member
without content has no record; zeros after the last member are padding; payloads that are archives are payloads; a member that is cut off, or has
content that is no record, raises an error; records without a payload digest or length have those of their blocks, and page ids are null but
where record ids end in a number.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import common
from lamina.llm import textarray as ta

LEAST_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
PIECE = 1 << 18
#: More than a stored deflate block or an extra field holds.
PROOF = 1 << 16
#: So many of the most frequent payloads are broadcast by digest; the others, all less frequent, are joined by a shuffle.
BROADCAST_PAYLOADS = 50_000
_MAGIC = b"\x1f\x8b\x08"
_DATE = datetime(2000, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary, path string, offset long"


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").rpartition(":")[2]
    return int(number) if number.lstrip("-").isdigit() else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not compressed. ``digest``: SHA-1 of the payload in hex; WARC headers spell it in base 32."""
    length = 0 if revisit else len(payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + "".join(c for c in url or "" if c not in "\r\n"),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response" if revisit else "Content-Type: text/html",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    text = "\r\n".join([*head, f"Content-Length: {length}", "", ""]).encode("utf-8", "surrogatepass")
    return text + (b"" if revisit else payload) + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload (UTF-8 bytes), payload_digest, refers_to: the response's id for rows that revisit it."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("payload_digest", F.sha1("payload")).withColumn("key", F.when(F.octet_length("payload") >= least, F.col("payload_digest")))
    # of each long payload that occurs twice or more: the response; rows are counted before they are shuffled
    counts = base.filter("key IS NOT NULL").groupBy(F.col("key").alias("word")).agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1")
    counts = common.stage(counts, "payloads")
    often = common.most_frequent(counts, BROADCAST_PAYLOADS)
    found = base.join(F.broadcast(often.drop("n")), F.col("key") == F.col("word"), "left").drop("word")
    if counts.count() > BROADCAST_PAYLOADS:
        rest = counts.join(F.broadcast(often.select("word")), "word", "left_anti").select("word", F.col("response").alias("other"))
        seldom = F.col("key").isNotNull() & F.col("response").isNull()
        by_shuffle = found.filter(seldom).join(rest, F.col("key") == F.col("word"), "left").withColumn("response", F.col("other")).drop("word", "other")
        found = found.filter(~seldom).unionByName(by_shuffle)
    return found.select("page_id", "url", "payload", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, level: int = 3) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as gzip WARC files below ``folder``; returns the manifest (path, size, records).

    A task that is run again writes other names; only files of committed attempts are in the manifest.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = sink = None
        path, size, records = "", 0, 0

        def closed() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "size", "records"])

        for batch in batches:
            _, offsets = ta.bytes_of(batch.column(2))
            for a, b in ta.groups(offsets):
                for page_id, url, payload, digest, refers_to in zip(*(batch.column(i)[a:b].to_pylist() for i in range(5)), strict=True):
                    if sink is None:
                        path, size, records = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        files, local = _files(folder)
                        files.create_dir(local, recursive=True)
                        sink = files.open_output_stream(f"{local}/{path.rpartition('/')[2]}", compression=None)
                    data = member(record_bytes(page_id, url, payload, digest, refers_to, refers_to is not None), level)
                    sink.write(data)
                    size, records = size + len(data), records + 1
                    if size >= ARCHIVE_BYTES:
                        yield closed()
                        sink = None
        if sink is not None:
            yield closed()

    return common.stage(with_revisits(pages, least).mapInArrow(ta.lean(archives), "path string, size long, records long"), "archives")


def splits(manifest: DataFrame, size: int = SPLIT_BYTES) -> DataFrame:
    """(path, first, last) byte ranges that cover the files of ``manifest`` (path, size)."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long")))
    return manifest.filter("size > 0").select("path", "size", first.alias("first")).select("path", "first", F.least(F.col("first") + size, F.col("size")).alias("last"))


class _Source:
    """Reads a file piece by piece, at any place."""

    def __init__(self, path: str):
        files, local = _files(path)
        self.file = files.open_input_file(local)
        self.size = self.file.size()

    def read(self, at: int, n: int = PIECE) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at)


class _Member:
    """The member at ``at``, inflated piece by piece; ``after`` is where it ends, once it has."""

    def __init__(self, source: _Source, at: int):
        self.source, self.at, self.place, self.after = source, at, at, None
        self.unpacker, self.waiting = zlib.decompressobj(31), b""

    def read(self, most: int = 4 * PIECE) -> bytes:
        """At least one and at most ``most`` bytes more, or none at the end. EOFError: the file ends within the member; zlib.error: it is none."""
        while self.after is None:
            if not self.waiting:
                self.waiting = self.source.read(self.place)
                self.place += len(self.waiting)
            ended = not self.waiting
            got = self.unpacker.decompress(self.waiting, most)
            self.waiting = self.unpacker.unconsumed_tail
            if self.unpacker.eof:
                self.after = self.place - len(self.unpacker.unused_data)
            if got:
                return got
            if ended and self.after is None:
                raise EOFError(f"a member is cut off at {self.at}")
        return b""


def _padding(source: _Source, at: int) -> bool:
    """Whether there are only zeros from ``at`` on."""
    size = 16
    while at < source.size:
        piece, size = source.read(at, size), PIECE
        if piece.strip(b"\0"):
            return False
        at += len(piece)
    return True


def _begins_records(source: _Source, at: int) -> bool:
    """Whether members with WARC records follow each other from ``at`` on, for ``PROOF`` bytes or to the end of the file."""
    place = at
    while place < source.size and place - at < PROOF:
        member, head = _Member(source, place), b""
        try:
            head = member.read()
            while head and len(head) < 7 and (more := member.read()):
                head += more
            if head and not head.startswith(b"WARC/1."):
                return False
            while member.after is None:
                member.read()
        except EOFError:
            # nothing inflated before the file ended: that tells only of the members before, which were whole records
            return head.startswith(b"WARC/1.") if head else place > at
        except zlib.error:
            return place > at and _padding(source, place)
        place = member.after
    return True


def first_member(source: _Source, first: int, last: int) -> int | None:
    """The first member that starts in [first, last); the file's first byte needs no proof."""
    if first == 0 and source.size:
        return 0
    at = first
    while at < last:
        # two bytes more, for magic bytes that cross the piece's end
        piece = source.read(at, min(PIECE, last - at) + 2)
        place = piece.find(_MAGIC)
        while place >= 0 and at + place < last:
            if _begins_records(source, at + place):
                return at + place
            place = piece.find(_MAGIC, place + 1)
        at += PIECE
    return None


def _headers(head: bytes) -> dict[str, str]:
    """Fields by lower-case name; a line that begins with white space goes on with the one before."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        fields[name] = value.strip()
    return fields


def records_of(member: _Member) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and block of each record of a member, whose content is held one record at a time."""
    data = b""
    while True:
        data = data.lstrip(b"\r\n")
        while b"\r\n\r\n" not in data and (more := member.read()):
            data = (data + more).lstrip(b"\r\n")
        if not data:
            return
        head, gap, data = data.partition(b"\r\n\r\n")
        if not gap or not head.startswith(b"WARC/1."):
            raise ValueError(f"the member at {member.at} has content that is no record")
        fields = _headers(head)
        length, pieces, held = int(fields["content-length"]), [data], len(data)
        while held < length and (more := member.read()):
            pieces.append(more)
            held += len(more)
        if held < length:
            raise ValueError(f"a record of the member at {member.at} is shorter than it says")
        data = b"".join(pieces)
        block, data = data[:length], data[length:]
        yield fields, block


def read(spark: SparkSession, ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that start within ``ranges`` (path, first, last): ``RECORD``; the payload is null for revisits, or if not asked for.

    A response's payload is held against its digest and length, where its headers name both.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def out() -> pa.RecordBatch:
            nonlocal held
            held = 0
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64())
            names = [f.split()[0] for f in RECORD.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            for path, first, last in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                source = _Source(path)
                at = first_member(source, first, last)
                while at is not None and at < last:
                    member = _Member(source, at)
                    for fields, block in records_of(member):
                        kind, named = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        digest = base64.b32decode(named).hex() if len(named) == 32 else hashlib.sha1(block).hexdigest()
                        size = int(fields.get("warc-payload-length", len(block)))
                        if kind == "response" and "warc-payload-length" in fields and (hashlib.sha1(block).hexdigest() != digest or len(block) != size):
                            raise ValueError(f"{path}: the payload at {at} differs from its digest")
                        rows.append((_page(fields.get("warc-record-id")), size, digest, kind, _page(fields.get("warc-refers-to")), fields.get("warc-target-uri"), block if payloads and kind != "revisit" else None, path, at))
                        held += len(block) * payloads + 200
                        if held > 4 << 20:
                            yield out()
                    at = member.after if member.after < source.size and not _padding(source, member.after) else None
        if rows:
            yield out()

    count = max(common.shuffle_partitions(spark), 1)
    return ranges.select("path", "first", "last").repartition(count, "path", "first").mapInArrow(ta.lean(records), RECORD)
