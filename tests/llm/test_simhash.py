"""SimHash groups against fingerprints and pairs made one by one."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import simhash
from ledgerlens.llm.components import components
from ledgerlens.llm.queries import QUERIES


def plain_fingerprint(text, words=3):
    found = re.findall(rb"[^\x20\x09-\x0D]+",
                       re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles or [b" ".join(found)]]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, bits):
    """Smallest key reachable, by comparing all pairs."""
    keys = sorted(prints)
    parent = {key: key for key in keys}

    def find(key):
        while parent[key] != key:
            key = parent[key]
        return key

    values = np.array([prints[k] for k in keys], np.uint64)
    for a in range(len(keys)):
        for b in np.flatnonzero(np.bitwise_count(values[a + 1 :] ^ values[a]) <= bits) + a + 1:
            x, y = find(keys[a]), find(keys[b])
            parent[max(x, y)] = min(x, y)
    return {key: find(key) for key in keys}


def test_query_against_all_pairs(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in
             spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {key: plain_fingerprint(text) for key, text in texts.items()}
    groups = plain_groups(prints, 3)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
           for r in QUERIES["op2_simhash"](spark, sf_dir).collect()}
    assert got == {k: (f"{prints[k]:016x}", groups[k]) for k in texts}


def test_long_text_and_majority():
    text = " ".join(f"w{i % 4001}" for i in range(70_000))  # more shingles than a lane holds
    hashes = np.array(simhash.shingle_hashes(text.encode(), 3), np.uint64)
    assert int(simhash.majority(hashes, np.array([len(hashes)]))[0]) == plain_fingerprint(text)


@pytest.mark.parametrize("rule", [
    simhash.Rule(), simhash.Rule(bucket_rows=3), simhash.Rule(bits=6, blocks=9),
    simhash.Rule(bits=1, blocks=2, bucket_rows=5)])
def test_chains_of_near_values(spark, rule):
    """Fingerprints around few centres, so buckets are large and cut into parts."""
    draw = random.Random(3)
    values = set()
    for _ in range(4):
        centre = draw.getrandbits(64)
        for _ in range(60):
            value = centre
            for _ in range(draw.randint(0, 5)):
                value ^= 1 << draw.randrange(64)
            values.add(value)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sorted(signed.values()))],
                                  "doc_id long, fingerprint long")
    by_id = {i: s & (1 << 64) - 1 for i, s in enumerate(sorted(signed.values()))}
    got = {r["doc_id"]: r["component_id"] for r in simhash.group(frame, rule).collect()}
    assert got == plain_groups(by_id, rule.bits)


def test_pivots_never_discard_a_link():
    draw = np.random.default_rng(1)
    value = draw.integers(0, 1 << 63, 300).astype(np.uint64)
    near = value ^ (np.uint64(1) << draw.integers(0, 64, 300).astype(np.uint64))
    a, b = simhash.spanning_links(np.repeat(np.arange(300), 2),
                                  np.stack([value, near], axis=1).ravel(), 3)
    assert len(a) == 300


def test_edge_rows(spark):
    rows = [(1, "A b c d"), (2, "a B  c\td"), (3, None), (4, ""), (4, ""), (None, "a b c d"),
            (None, "one of its own"), (7, " "), (8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"fingerprint": F.lit("old"), "component_id": F.lit(-1), "root": F.lit(0)})
    found = simhash.near_duplicates(docs).collect()
    got = sorted(((r["doc_id"], r["component_id"]) for r in found), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 3), (4, 3), (None, 1), (None, None),
                          (7, 7), (8, 8)], key=str)
    assert {r["fingerprint"] for r in found if r["doc_id"] in (3, 4)} == {0}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_a_path_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(100, 164)] + [(0, i) for i in range(1, 50)]
    links += [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300), (-5, -4), (-4, -5)]
    frame = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["root"] for r in components(frame, "a", "b").collect()}
    want = {i: 100 for i in range(101, 165)} | {i: 0 for i in range(1, 50)}
    want |= {200 + i: 200 for i in range(1, 9)} | {-4: -5}
    assert got == want
