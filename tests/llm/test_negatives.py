"""Hard negatives against a plain search, in one and in many blocks."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import negatives
from ledgerlens.llm.queries import QUERIES


def plain(rows, rule):
    usable = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(
                x is None or not math.isfinite(x) for x in vector):
            continue
        own = (label, [math.floor(rule.scale * x) for x in vector])
        usable[vec_id] = min(usable.get(vec_id, own), own)
    out = []
    for anchor, (label, v) in usable.items():
        if anchor % rule.anchors_every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in usable.items()
                 if len(w) == len(v) and i != anchor}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if usable[i][0] == label][: rule.positives]:
            within = [i for i in order if usable[i][0] != label
                      and rule.low * score[p] <= 100 * score[i] <= rule.high * score[p]]
            out += [(anchor, p, rank, i, score[p], score[i])
                    for rank, i in enumerate(within[: rule.negatives], 1)]
    return sorted(out)


def run(spark, rows, rule):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame = frame.withColumns({"rank": F.lit(1), "score": F.lit(2), "anchor.id": F.lit(3)})
    found = negatives.hard_negatives(frame.repartition(4), rule)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id",
                             "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def vectors(n, width, labels, seed, spread=0.5):
    draw = random.Random(seed)
    centre = [draw.gauss(0, 0.3) for _ in range(width)]
    return [(i, [float(int(1000 * (c + draw.gauss(0, spread))) / 1024) for c in centre],
             draw.choice(labels)) for i in range(n)]


@pytest.mark.parametrize("rule,labels", [
    (negatives.Rule(), [0, 1, 2]),
    (negatives.Rule(anchors_every=7, block=9, chunk=16, pending=50), [0, 0, 0, 0, 1]),
    (negatives.Rule(anchors_every=5, positives=3, negatives=6, low=10, high=80), [1, 2]),
    (negatives.Rule(anchors_every=3, scale=4, chunk=50), [1, 2, 3]),
])
def test_all_windows(spark, rule, labels):
    rows = vectors(300, 6, labels, 3)
    want = plain(rows, rule)
    assert len(want) > 20
    assert run(spark, rows, rule) == want


def test_ties_and_copies(spark):
    """Hundreds of equal rows: ids decide, and copies of a row count once."""
    rows = [(i, [1.0, 0.5] if i % 3 else [1.0, 0.55], i % 2) for i in range(400)]
    rule = negatives.Rule(anchors_every=20, chunk=32, pending=100, block=7)
    assert run(spark, rows + rows[:50], rule) == plain(rows, rule)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 0.9], 1), (2, [0.8, 0.8], 2), (3, None, 1),
            (4, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2),
            (7, [None, 1.0], 2), (8, [], 1), (9, [1.0], 2), (50, [], 1), (51, [], 2),
            (100, [-1.0, 0.2], 1), (101, [-0.5, 0.1], 3), (150, [1e4, 1e5], 1),
            (151, [9e3, 1e5], 1), (152, [7e3, 9e4], 2), (2, [0.7, 0.7], 2)]
    rule = negatives.Rule()
    want = plain(rows, rule)
    assert {r[0] for r in want} >= {0, 50, 150}
    assert run(spark, rows, rule) == want
    assert run(spark, [], rule) == []
    assert run(spark, [(1, [1.0], 1)], rule) == []
    assert run(spark, [(0, [1.0], 1), (1, [1e30], 1)], rule) == []


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"],
             (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in
            spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op11_negatives"](spark, sf_dir).collect())
    assert got == plain(rows, negatives.Rule())
