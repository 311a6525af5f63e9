"""Web archives: writing with revisit records, and a splittable reader.

Writing: every record is a gzip member of its own, so archives can be read from any record.
Spark's text sink writes the members, which gives its commit protocol (a lost task leaves
nothing behind); the separator it puts after each row is an empty gzip member, so the files
are plain gzip. Of pages with equal payloads only one carries the payload.

Reading takes two passes over byte ranges of the files.

1. A task scans its range for the gzip magic. A candidate is a member that decodes, with a
   correct checksum, and is followed by the magic or the end of the file. Archives inside a
   stored record give candidates too, so nothing tells yet which ones are the archive's. From
   each candidate members follow each other to the first one beyond the range, its exit.
2. Members of the archive follow each other from the start of the file on: the exit of one
   range is the entry of the next. Ranges are walked by file and in order, with some bytes for
   each candidate. A task then reads its range from its entry on. It owns the records that
   start inside the range and reads the last of them to its end. It holds one block and one
   record.
"""

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import Tuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The gzip magic with the deflate method, and a complete empty gzip member.
MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = ("record_id string, record_type string, target_uri string, date string, "
          "payload_digest string, refers_to string, payload_bytes long, payload binary")


def _member(record_id: str, uri: str | None, payload: bytes, refers_to: str | None,
            date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = head if refers_to else head + payload
    fields = [
        ("WARC-Type", "revisit" if refers_to else "response"),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _one_line(uri)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", f"<{refers_to}>" if refers_to else None),
        ("WARC-Profile", PROFILE if refers_to else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    record = VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _one_line(uri: str | None) -> str | None:
    """Control characters and spaces would end or change a header line."""
    if uri is None:
        return None
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in uri)


def _member_column(record_id: Column, uri: Column, payload: Column, refers_to: Column,
                   date: str) -> Column:
    @F.arrow_udf("binary")
    def made(batches: Iterator[Tuple[pa.Array, pa.Array, pa.Array, pa.Array]]
             ) -> Iterator[pa.Array]:
        for columns in batches:
            rows = zip(*columns)
            yield pa.array([_member(*(v.as_py() for v in row), date) for row in rows],
                           pa.binary())

    return made(record_id, uri, payload, refers_to)


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url",
                  html: str = "html", min_bytes: int = 0,
                  date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record per row to the new folder ``path``.

    Of rows with equal payloads of ``min_bytes`` or more, the one with the largest page_id
    is a response and the others revisit it. A missing html is an empty payload, a missing
    url leaves the line out. Rows without a page_id never are what others revisit unless no
    row of the group has one; then, and where rows share the largest page_id, all of these
    are responses. Other columns are not read. An empty table gives an archive without
    records.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    named = pages.select(
        F.col(page_id).cast("string").alias("id"), F.col(page_id).alias("number"),
        F.col(url).alias("uri"), payload.alias("payload"))
    rows = named.withColumn(
        "digest", F.when(F.length("payload") >= min_bytes, F.sha2("payload", 256)))
    # The rebalance keeps the join's exchanges its own, so a payload with very many rows can
    # be split there.
    first = (
        rows.filter("digest is not null").groupBy("digest")
        .agg(F.max("number").alias("first"), F.count(F.lit(1)).alias("rows"))
        .filter("rows > 1").select("digest", "first").hint("rebalance")
    )
    joined = rows.join(first, "digest", "left")
    urn = F.concat(F.lit("urn:page:"), F.coalesce("id", F.lit("null")))
    same = F.col("first").isNull() | F.col("number").eqNullSafe(F.col("first"))
    refers = F.when(~same, F.concat(F.lit("urn:page:"), F.col("first").cast("string")))
    members = joined.select(
        _member_column(urn, F.col("uri"), F.col("payload"), refers, date)
        .cast("string").alias("value"))
    # In this encoding every byte is one character.
    separator = EMPTY_MEMBER.decode("latin-1")
    members.write.option("encoding", "ISO-8859-1").option("lineSep", separator).text(path)


# --- reading --------------------------------------------------------------------------------


class _Blocks:
    """Bytes of a file by offset, through one block at a time."""

    def __init__(self, path: str, block: int):
        scheme, _, rest = path.partition(":")
        if scheme == "file" and not rest.startswith("//"):
            path = f"file://{rest}"
        if scheme == "s3a":
            path = f"s3:{rest}"
        files, name = pyarrow.fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(name)
        self.size, self.block = self.file.size(), block
        self.start, self.data = 0, b""

    def at(self, offset: int, least: int = 1) -> memoryview:
        """What is held from ``offset`` on, at least ``least`` bytes unless the file ends."""
        if not self.start <= offset <= offset + least <= self.start + len(self.data):
            self.start = offset
            self.data = self.file.read_at(max(self.block, least), offset)
        return memoryview(self.data)[offset - self.start :]


# Bytes that are unpacked at a time: what follows a member in them is copied.
STEP = 16 << 10


def _magics(blocks: _Blocks, offset: int, end: int) -> Iterator[int]:
    """All places in [offset, end) where the magic starts."""
    while offset < end:
        held = len(blocks.at(offset, len(MAGIC)))
        data, at = blocks.data, offset - blocks.start
        found = data.find(MAGIC, at, at + held)
        while found >= 0 and blocks.start + found < end:
            # The block may be another one when the next place is asked for.
            offset = blocks.start + found + 1
            yield offset - 1
            held = len(blocks.at(offset, len(MAGIC)))
            data, at = blocks.data, offset - blocks.start
            found = data.find(MAGIC, at, at + held)
        if offset + held >= blocks.size or found >= 0:
            return
        offset += max(1, held - len(MAGIC) + 1)


def _unpacked(blocks: _Blocks, offset: int) -> Iterator[bytes | int]:
    """Parts of the content of the member at ``offset``, then its end.

    The end is that of the file for a member that the file cuts off, and None if there is no
    member.
    """
    unpacker, at = zlib.decompressobj(31), offset
    while not unpacker.eof:
        data = blocks.at(at)[:STEP]
        if not len(data):
            yield blocks.size
            return
        try:
            yield unpacker.decompress(data)
        except zlib.error:
            yield None
            return
        at += len(data)
    end = at - len(unpacker.unused_data)
    yield end if bytes(blocks.at(end, len(MAGIC))[: len(MAGIC)]) in (b"", MAGIC) else None


def _end(blocks: _Blocks, offset: int) -> int | None:
    """End of the member at ``offset``; None if there is no member."""
    last = None
    for last in _unpacked(blocks, offset):
        pass
    return last


def candidates(blocks: _Blocks, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Members that start in [start, end), and the first place from ``end`` on that members
    following each other from there reach."""
    ends = {at: _end(blocks, at) for at in _magics(blocks, start, end)}
    exits: dict[int, int] = {}
    for at in sorted(ends, reverse=True):
        after = ends[at]
        found = after if after is None or after >= end else exits.get(after)
        if found is not None:
            exits[at] = found
    starts = sorted(exits)
    return np.array(starts, np.int64), np.array([exits[at] for at in starts], np.int64)


def entry(starts: np.ndarray, exits: np.ndarray, expected: int, end: int) -> tuple[int | None, int]:
    """Where the archive enters a range that ends at ``end``, and where the next one.

    ``expected`` is the exit of the ranges before. Where no member starts there (what is
    between members is damaged) the archive goes on with the next candidate.
    """
    place = int(np.searchsorted(starts, expected))
    if expected >= end or place == len(starts):
        return None, expected
    return int(starts[place]), int(exits[place])


def records(blocks: _Blocks, offset: int, end: int) -> Iterator[bytes]:
    """Records of members that follow each other from ``offset`` on and start before ``end``.

    A record that is cut off by the end of the file raises an error.
    """
    while offset < end:
        parts, is_record, after = [], None, None
        for part in _unpacked(blocks, offset):
            if not isinstance(part, bytes):
                after = part
                break
            if is_record is not False:
                parts.append(part)
            if is_record is None and sum(map(len, parts)) >= 7:
                is_record = b"".join(parts).startswith(b"WARC/1.")
                if not is_record:
                    parts.clear()
        if after is None:
            return
        if is_record:
            record = b"".join(parts)
            if after == blocks.size and not _whole(blocks, offset):
                raise ValueError(f"record at byte {offset} is cut off by the end of the file")
            yield record
        offset = after


def _whole(blocks: _Blocks, offset: int) -> bool:
    """Whether the last member of a file ends."""
    unpacker = zlib.decompressobj(31)
    while not unpacker.eof:
        data = blocks.at(offset)[:STEP]
        if not len(data):
            return False
        unpacker.decompress(data)
        offset += len(data)
    return True


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    pairs = (line.partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(record: bytes) -> tuple:
    """The columns of SCHEMA; a payload that does not match its digest raises an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields.get("content-length", 0))]
    kind = fields.get("warc-type")
    payload, length = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if kind == "revisit":  # the headers tell of the payload that is elsewhere
            length = int(_fields(http).get("content-length", 0))
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        payload = None
    elif digest != (own := base64.b32encode(hashlib.sha1(payload).digest()).decode()):
        if digest is not None:
            raise ValueError(f"payload of {fields.get('warc-record-id')} has digest {own}")
        digest = own
    bare = lambda name: (fields.get(name) or "").strip("<>") or None
    return (bare("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"),
            digest, bare("warc-refers-to"), length, payload)


def _scan_ranges(block: int):
    """Ranges (path, start, end) with their candidates, as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(column.to_pylist() for column in batch.columns)):
                found = candidates(_Blocks(path, block), start, end)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([start], pa.int64()), pa.array([end], pa.int64()),
                     *(pa.array([values.tobytes()], pa.binary()) for values in found)],
                    ["path", "start", "end", "starts", "exits"])

    return run


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges by file and start to (path, entry, end) of those that the archive enters."""
    current, expected = None, 0
    for batch in batches:
        rows = []
        for path, _, end, starts, exits in zip(*(c.to_pylist() for c in batch.columns)):
            if path != current:
                current, expected = path, 0
            at, expected = entry(
                np.frombuffer(starts, np.int64), np.frombuffer(exits, np.int64), expected, end)
            if at is not None:
                rows.append((path, at, end))
        path, at, end = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(path, pa.string()), pa.array(at, pa.int64()), pa.array(end, pa.int64())],
            ["path", "entry", "end"])


def _read_ranges(block: int, batch_bytes: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for path, start, end in zip(*(column.to_pylist() for column in batch.columns)):
                for record in records(_Blocks(path, block), start, end):
                    rows.append(parse(record))
                    held += len(record)
                    if held > batch_bytes:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def read_archive(spark: SparkSession, path: str, split_bytes: int = 32 << 20,
                 block_bytes: int = 1 << 20) -> DataFrame:
    """Records of all archives under ``path``, whatever their file names.

    Executors open the files through pyarrow (local and shared file systems, HDFS with
    libhdfs, S3, GCS). Revisits have no payload; their payload_bytes and payload_digest are
    those of the record they refer to. An archive without records gives an empty table.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    files = files.filter("length > 0")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    ranges = files.select("path", "length", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))
    ).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split_bytes, "length"))
    tasks = min(100_000, max(1, -(-total // split_bytes)) * 2)
    scanned = ranges.repartition(tasks).mapInArrow(
        _scan_ranges(block_bytes),
        "path string, start long, end long, starts binary, exits binary")
    linked = scanned.repartition("path").sortWithinPartitions("path", "start").mapInArrow(
        _link, "path string, entry long, end long")
    schema = pa.schema([
        (name, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[kind])
        for name, kind in (part.split() for part in SCHEMA.split(", "))])
    return linked.repartition(tasks).mapInArrow(
        _read_ranges(block_bytes, 16 << 20, schema), SCHEMA)
