"""The mix against a plain version with exact fractions."""

from __future__ import annotations

import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import mixing
from ledgerlens.llm.queries import QUERIES


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    """Share, set those above their limit to it, and share the excess again."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode())
    names += [None] if None in sizes else []
    weight = {n: Fraction(weights[i % len(weights)]) for i, n in enumerate(names)}
    left, free, out = Fraction(sum(sizes.values())), set(names), {}
    while free:
        whole = sum(weight[n] for n in free)
        above = [n for n in free if left * weight[n] / whole > epochs * sizes[n]]
        if not above:
            return out | {n: left * weight[n] / whole for n in free}
        for n in above:
            out[n] = Fraction(epochs * sizes[n])
            left -= out[n]
            free.discard(n)
    return out


def check(rows, docs, weights=(5, 2, 1)):
    sizes = {}
    for _, text, source in docs:
        sizes[source] = sizes.get(source, 0) + words(text)
    want = plain_targets(sizes, weights)
    assert len(rows) == len(docs)
    assert sorted((str(r["doc_id"]), r["size"]) for r in rows) == sorted(
        (str(i), words(text)) for i, text, _ in docs)
    taken = dict.fromkeys(sizes, 0)
    for row in rows:
        source = row["source"]
        assert row["source_size"] == sizes[source]
        assert row["target"] == pytest.approx(float(want[source]))
        assert 0 <= row["taken"] <= 3 * row["size"]
        taken[source] += row["taken"]
    for source in sizes:
        assert abs(taken[source] - want[source]) <= Fraction(1, 2) + Fraction(1, 10**6)


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, source string")


DOCS = [(i, "w " * (i % 13), f"s{i % 7}" if i % 3 else "hot") for i in range(400)]
EDGES = [(1, None, "a"), (2, "", "a"), (3, "x y", None), (3, "x y", None), (None, "p q r", "b"),
         (None, "p q r", "b"), (5, "one\x85two\x0b three", "é"), (6, "t " * 3000, "z"), (7, "k", "")]


@pytest.mark.parametrize("per_range", [20_000, 7, 1])
@pytest.mark.parametrize("docs", [DOCS, EDGES])
def test_mix_against_plain(spark, docs, per_range):
    rule = mixing.Mix(rows_per_range=per_range)
    first = mixing.plan(frame(spark, docs), rule)[0].collect()
    check(first, docs)
    again = mixing.plan(frame(spark, docs).repartition(5), rule)[0].collect()
    assert sorted(map(repr, first)) == sorted(map(repr, again))


@pytest.mark.parametrize("per_range", [20_000, 5])
def test_rows_come_as_often_as_they_are_taken(spark, per_range):
    rule = mixing.Mix(rows_per_range=per_range)
    docs = frame(spark, DOCS).withColumns({"size": F.lit("old"), "epochs": F.col("doc_id")})
    taken = {r["doc_id"]: -(-r["taken"] // r["size"]) if r["size"] else 0
             for r in mixing.plan(docs, rule)[0].collect()}
    mixed = mixing.mixture(docs, rule)
    assert mixed.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in taken.items() if n}
    assert mixed.filter("size != 'old' or epochs != doc_id").count() == 0


def test_empty_tables_and_empty_texts(spark):
    empty = frame(spark, DOCS).limit(0)
    assert mixing.plan(empty)[0].collect() == [] == mixing.mixture(empty).collect()
    rows = mixing.plan(frame(spark, [(1, None, "a"), (2, " ", None)]))[0].collect()
    assert [(r["size"], r["target"], r["taken"]) for r in rows] == [(0, 0.0, 0)] * 2
    assert mixing.mixture(frame(spark, [(1, None, "a")])).collect() == []


def test_main_path_is_native(spark):
    plan = mixing.mixture(frame(spark, DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in
            spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    source = {i: s for i, _, s in docs}
    rows = [{**r.asDict(), "source": source[r["doc_id"]]}
            for r in QUERIES["op7_mixing"](spark, sf_dir).collect()]
    check(rows, docs)
