"""Archives: round trips, byte ranges of any size, and records that only look like one."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import warc
from ledgerlens.llm.queries import QUERIES
from ledgerlens.session import work_folder


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_query_against_the_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    payloads = {r["page_id"]: (r["html"] or "").encode() for r in pages}
    last = {}
    for page, payload in payloads.items():
        last[payload] = max(page, last.get(payload, page))
    want = {(page, len(payload), digest(payload),
             "response" if last[payload] == page else "revisit",
             None if last[payload] == page else last[payload])
            for page, payload in payloads.items()}
    got = QUERIES["op1_warc"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    assert {tuple(r) for r in got} == want


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


ROWS = [(1, "http://a/ b\r\nX: y", "<p>ä</p>"), (2, None, "<p>ä</p>"), (3, "http://c", None),
        (4, "http://d", ""), (5, "http://e", "x" * 300_000), (None, "http://f", "<p>ä</p>"),
        (None, "http://g", "alone"), (6, "http://h", "same"), (6, "http://h", "same")]


def test_edge_rows(spark):
    path = work_folder(spark, "warc-test")
    pages = pages_of(spark, ROWS).withColumns({"digest": F.lit(1), "first": F.lit(2)})
    warc.write_archive(pages, path)
    got = sorted(((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"],
                   r["payload_digest"]) for r in warc.read_archive(spark, path).collect()),
                 key=str)
    a, same, long = digest("<p>ä</p>".encode()), digest(b"same"), digest(b"x" * 300_000)
    assert got == sorted([
        ("urn:page:1", "revisit", "urn:page:2", 9, a), ("urn:page:2", "response", None, 9, a),
        ("urn:page:3", "revisit", "urn:page:4", 0, digest(b"")),
        ("urn:page:4", "response", None, 0, digest(b"")),
        ("urn:page:5", "response", None, 300_000, long),
        ("urn:page:6", "response", None, 4, same), ("urn:page:6", "response", None, 4, same),
        ("urn:page:null", "response", None, 5, digest(b"alone")),
        ("urn:page:null", "revisit", "urn:page:2", 9, a)], key=str)
    uri = {r["record_id"]: r["target_uri"] for r in warc.read_archive(spark, path).collect()}
    assert uri["urn:page:1"] == "http://a/%20b%0D%0AX:%20y" and uri["urn:page:2"] is None


def test_small_payloads_are_all_responses(spark):
    path = work_folder(spark, "warc-test")
    warc.write_archive(pages_of(spark, ROWS), path, min_bytes=10)
    found = warc.read_archive(spark, path)
    assert {r["record_type"] for r in found.collect()} == {"response"}


def test_empty_table(spark):
    path = work_folder(spark, "warc-test")
    warc.write_archive(pages_of(spark, []), path)
    assert warc.read_archive(spark, path).collect() == []


def walked(file, split):
    """Ids of the records, range by range."""
    blocks, found, expected = warc._Blocks(str(file.as_uri()), 100), [], 0
    for start in range(0, blocks.size, split):
        end = min(blocks.size, start + split)
        at, expected = warc.entry(*warc.candidates(blocks, start, end), expected, end)
        if at is not None:
            found += [warc.parse(r)[0] for r in warc.records(blocks, at, end)]
    return found


@pytest.mark.parametrize("inside", [1, 15, 16, 60, 200])
def test_archives_inside_a_record_stay_there(spark, inside, tmp_path):
    """Stored, not packed, so that every member of the inner archive looks like a member."""
    inner = b"".join(warc._member(f"urn:in{i}", None, bytes(30), None, "d") for i in range(inside))
    outer = gzip.decompress(warc._member("urn:outer", None, inner, None, "d"))
    around = [warc._member(f"urn:{i}", None, b"x" * 300, None, "d") for i in range(2)]
    file = Path(tmp_path) / "a.warc.gz"
    file.write_bytes(around[0] + gzip.compress(outer, compresslevel=0) + around[1])
    for split in (61, 1000, 4000, 1 << 20):
        assert walked(file, split) == ["urn:0", "urn:outer", "urn:1"]
    got = warc.read_archive(spark, tmp_path.as_uri(), split_bytes=1000).collect()
    assert sorted(r["record_id"] for r in got) == ["urn:0", "urn:1", "urn:outer"]


@pytest.mark.parametrize("split", [7, 64, 1000, 1 << 30])
def test_ranges_of_any_size_give_every_record_once(spark, split, tmp_path):
    """Among them members with the magic inside: one stored, not packed, and one of another kind."""
    inner = warc._member("urn:inner", None, b"inner", None, "d")
    members = [warc._member(f"urn:{i}", None, bytes([i]) * i * 40, None, "d") for i in range(12)]
    record = gzip.decompress(warc._member("urn:outer", None, b"ab" + inner * 3, None, "d"))
    members.insert(5, gzip.compress(record, compresslevel=0))
    members.insert(3, gzip.compress(b"no record" * 9))
    file = Path(tmp_path) / "a.warc.gz"
    file.write_bytes(b"".join(m + warc.EMPTY_MEMBER * (i % 2) for i, m in enumerate(members)))
    found = walked(file, split)
    assert sorted(found) == sorted(["urn:outer", *(f"urn:{i}" for i in range(12))])
    got = warc.read_archive(spark, tmp_path.as_uri(), split_bytes=max(64, split)).collect()
    assert sorted(r["record_id"] for r in got) == sorted(found)
    assert gzip.decompress(file.read_bytes())  # plain gzip to everyone else


def test_damage_is_an_error(spark, tmp_path):
    member = warc._member("urn:a", None, b"payload" * 50, None, "d")
    (Path(tmp_path) / "cut.warc.gz").write_bytes(member[:-20])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archive(spark, tmp_path.as_uri()).collect()
    wrong = gzip.decompress(member).replace(b"payloadpayload", b"PAYLOADpayload", 1)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(wrong)
