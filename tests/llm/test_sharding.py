"""The hash tree: one law, even shares, and movement only where weights change."""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import sharding
from ledgerlens.llm.queries import QUERIES


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in
             spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op6_sharding"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    slots = {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert r["law"] == "key" and 0 <= r["shard"] < 8
        assert r["grown_shard"] in (r["shard"], 8)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def keys(spark, n=40_000):
    return spark.range(n).select(F.xxhash64(F.lit(1), "id").alias("key"))


def shares(spark, node):
    found = keys(spark).groupBy(sharding.descend(F.col("key"), node).alias("s")).count().collect()
    return {r["s"]: r["count"] / 40_000 for r in found}


def test_shares_follow_weights(spark):
    weights = [1.0, 2.0, 0.0, 3.0, 1.0, 1.0]
    got = shares(spark, sharding.tree(weights))
    assert set(got) == {0, 1, 3, 4, 5}
    for shard, share in got.items():
        assert abs(share - weights[shard] / 8) < 0.01


def moves(spark, before, after):
    pairs = keys(spark).select(sharding.descend(F.col("key"), before).alias("a"),
                               sharding.descend(F.col("key"), after).alias("b"))
    return {(r["a"], r["b"]) for r in pairs.filter("a != b").distinct().collect()}


@pytest.mark.parametrize("base", [1, 5, 8])
def test_every_added_shard_takes_rows_only_into_itself(spark, base):
    """The law and the shares for every count from the base to 20."""
    trees = [sharding.tree([1.0] * base)]
    while len(sharding.numbers(trees[-1])) < 20:
        trees.append(sharding.grow(trees[-1], [1.0]))
    columns = [sharding.descend(F.col("key"), node).alias(f"n{i}") for i, node in enumerate(trees)]
    rows = keys(spark).select(columns).collect()
    for i, node in enumerate(trees):
        counts = Counter(r[i] for r in rows)
        assert sorted(counts) == list(range(base + i))
        assert all(abs(n * (base + i) / 40_000 - 1) < 0.12 for n in counts.values())
        assert not i or all(r[i] in (r[i - 1], base + i - 1) for r in rows)
    assert sharding.numbers(sharding.grow(trees[0], [1.0] * 3)) == list(range(base + 3))


def plain_shard(key, node):
    """The draws one by one, with the hash as the xxhash library has it."""
    if node.shard is not None:
        return node.shard
    draws = []
    for i, child in enumerate(node.children):
        h = 42
        for part in (struct.pack("<i", sharding.SEED), child.name.encode(), struct.pack("<q", key)):
            h = xxhash.xxh64_intdigest(part, h)
        draws.append((-math.log(((h >> 11) + 0.5) / 2.0**53) / child.weight, i))
    return plain_shard(key, node.children[min(draws)[1]])


def test_draws_one_by_one(spark):
    node = sharding.grow(sharding.tree([1.0, 2.5, 0.0, 3.0, 1.0, 1.0, 0.25]), [2.0, 1.0])
    rows = keys(spark, 3000).select("key", sharding.descend(F.col("key"), node).alias("s")).collect()
    assert all(plain_shard(r["key"], node) == r["s"] for r in rows)


def test_movement_stays_where_weights_change(spark):
    """Less weight in shard 1: its rack loses rows, and nothing moves among the others."""
    changed = [1.0, 0.5, *[1.0] * 6]
    found = moves(spark, sharding.tree([1.0] * 8), sharding.tree(changed))
    assert found and all(a in (0, 1, 2, 3) for a, _ in found)
    assert all(not (a > 3 or (a in (2, 3) and b in (2, 3))) for a, b in found)


def test_edge_rows(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, None), (None, ""), (3, "é" * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"shard": F.lit(99), "size": F.lit(0), "_key": F.lit(5)})
    now = sharding.tree([1.0])
    for per_range in (1, 20_000):
        got = sharding.shards(docs, now, now, rows_per_range=per_range).collect()
        assert sorted(r["slot"] for r in got) == list(range(6))
        assert {r["shard"] for r in got} == {0}
        assert sorted(r["size"] for r in got) == [1, 1, 2, 2, 2, 19]
        assert sum(r["text_crc32"] == 0 for r in got) == 2
    assert sharding.shards(docs.limit(0), now, now).collect() == []
    both = sharding.shards(docs, sharding.tree([1.0] * 8), sharding.tree([1.0] * 9)).collect()
    assert len({r["shard"] for r in both if r["doc_id"] is None}) == 1
