"""Positive-unlabelled learning: its risk, what it learns, and its edges."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import toxicity
from ledgerlens.llm.queries import QUERIES


def test_step_is_the_gradient_of_the_risk():
    draw = np.random.default_rng(1)
    positive = np.arange(40) < 15
    loss = lambda s: np.logaddexp(0, s)

    def risk(s, prior):
        clean = loss(s[~positive]).mean() - prior * loss(s[positive]).mean()
        return (prior * loss(-s[positive]).mean() + clean if clean >= 0 else -clean), clean

    seen = set()
    for prior in (0.1, 0.9):
        for shift in (-6, 0, 4):
            scores = draw.normal(size=40) + np.where(positive, shift + 4, shift)
            value, clean = risk(scores, prior)
            seen.add(clean < 0)
            step = toxicity.risk_step(scores, positive, prior)
            for i in (0, 7, 20, 39):
                moved = scores.copy()
                moved[i] += 1e-6
                assert (risk(moved, prior)[0] - value) / 1e-6 == pytest.approx(step[i], abs=1e-5)
    assert seen == {True, False}


def synthetic(n=1200):
    """Every eighth text has two of a few marked words; a third of those are confirmed."""
    draw = np.random.default_rng(2)
    rows = []
    for i in range(n):
        text = [f"word{j}" for j in draw.integers(0, 300, 40)]
        if i % 8 == 0:
            text[5], text[9] = f"vile{draw.integers(3)}", f"Foul{draw.integers(3)}!"
        rows.append((i, " ".join(text)))
    return rows


def test_unlabelled_toxic_texts_are_found(spark):
    rows = synthetic()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame(
        [(i, int(i % 8 == 0)) for i, _ in rows if i % 3 == 0] + [(None, 1), (99_999, 1), (3, None)],
        "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = docs.select("doc_id", toxicity.score_column(F.col("text"), model, spark).alias("s"))
    other = [r for r in scored.collect() if r["doc_id"] % 3]
    assert np.mean([r["s"] >= 0.5 for r in other if r["doc_id"] % 8 == 0]) > 0.95
    assert np.mean([r["s"] >= 0.5 for r in other if r["doc_id"] % 8]) < 0.02
    again = toxicity.fit(docs.repartition(3), labels)
    assert np.array_equal(model.weights, again.weights)


def test_samples_are_bounded(spark):
    rows = synthetic(600)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i, _ in rows],
                                   "doc_id long, toxic int")
    rule = toxicity.Learning(positives=40, unlabelled=200, classifiers=1)
    model = toxicity.fit(docs, labels, rule)
    assert model.weights.shape == (1, 1 << rule.feature_bits)


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None), (2, ""), (2, ""), (None, "x"), (4, "y " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, None)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.filter("toxic = 1"), labels.filter("toxic = 0")):
        model = toxicity.fit(docs, some)
        got = docs.select(toxicity.score_column(F.col("text"), model, spark)).collect()
        assert len(got) == 5 and all(0 <= r[0] <= 1 for r in got)
        assert docs.limit(0).select(
            toxicity.score_column(F.col("text"), model, spark)).collect() == []
    assert toxicity.fit(docs.limit(0), labels).constants.size == 0


def test_query_finds_held_out_toxic_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, sf_dir).collect()
    assert len(rows) == 10_000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    found = [r["predicted"] for r in held if toxic[r["doc_id"]]]
    wrong = [r["predicted"] for r in held if not toxic[r["doc_id"]]]
    assert np.mean(found) > 0.85 and np.mean(wrong) < 0.05
