"""Vector groups against all pairs, with every part of the index made small."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import vectors
from ledgerlens.llm.queries import QUERIES


def plain(rows, cosine):
    """n_links and component_id by comparing all pairs in double precision."""
    usable = {}
    for at, (_, vector, label) in enumerate(rows):
        if label is None or not vector or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = np.array(vector, np.float64)
        if np.abs(v).max() > 0:
            v = v / np.abs(v).max()
            usable[at] = v / np.sqrt((v * v).sum())
    parent = list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    places = sorted(usable)
    for n, a in enumerate(places):
        for b in places[n + 1 :]:
            if rows[a][2] == rows[b][2] and len(usable[a]) == len(usable[b]) and (
                    float(usable[a] @ usable[b]) >= cosine):
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    first = {}
    for at, row in enumerate(rows):
        if row[0] is not None:
            first[find(at)] = min(first.get(find(at), row[0]), row[0])
    out = []
    for at, row in enumerate(rows):
        component = first.get(find(at))
        out.append((row[0], links[at], component, row[0] == component))
    return sorted(out, key=repr)


def run(spark, rows, rule):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    frame = frame.withColumns({"unit": F.lit(1), "key": F.lit("x"), "n_links": F.lit(-1)})
    found = vectors.near_duplicates(frame.repartition(3), rule).collect()
    return sorted((tuple(r) for r in found), key=repr)


def clustered(n=420, width=12, seed=4):
    """Copies, chains of near ones, and loose vectors; one label has most of them."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(6, width))
    rows = []
    for i in range(n):
        if i % 7 == 0:
            v = draw.normal(size=width)
        elif i % 7 == 1:
            v = centres[0]
        else:
            v = centres[i % 6] + draw.normal(size=width) * 0.16
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 5 == 0)))
    return rows


@pytest.mark.parametrize("rule", [
    vectors.Rule(),
    vectors.Rule(per_list=20, lists=16, codes=4, subspaces=3),
    vectors.Rule(per_list=20, lists=9, block=16, sample=60),
    vectors.Rule(cosine=0.9, per_list=5, lists=40, codes=2, subspaces=1, block=50),
])
def test_all_pairs(spark, rule):
    rows = clustered()
    want = plain(rows, rule.cosine)
    assert sum(n for _, n, _, _ in want) > 1000
    assert run(spark, rows, rule) == want


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [3.0, 0.0], 1), (2, [3.0, 0.0], 1), (3, [1.0, 0.0], 2),
            (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1),
            (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (None, [2.0, 0.0], 1),
            (None, [0.0, 5.0], 1), (None, [0.0, 5.0], 3), (11, [1.0, 0.0, 0.0], 1),
            (12, [1e38, 0.0], 2), (13, [1e-38, 0.0], 2), (14, [-1.0, 0.0], 2)]
    want = plain(rows, 0.98)
    got = run(spark, rows, vectors.Rule())
    none = [(i, n, c) for i, n, c, _ in got if i is None]
    assert [(i, n, c) for i, n, c, _ in got] == [(i, n, c) for i, n, c, _ in want]
    assert len(none) == 3
    assert run(spark, [], vectors.Rule()) == []
    assert [r[1] for r in run(spark, [(1, None, None)], vectors.Rule())] == [0]


def test_nothing_within_reach_is_left_out():
    """Probes and table distances against all pairs, whatever the index was fitted on."""
    draw = np.random.default_rng(8)
    points = draw.normal(size=(500, 16))
    points = np.concatenate([points, points + draw.normal(size=points.shape) * 0.05])
    points /= np.sqrt((points**2).sum(axis=1))[:, None]
    rule = vectors.Rule(codes=5, subspaces=4)
    index = vectors.fit(points[:30], 12, rule)
    home = vectors.nearest(points, index.centres)
    row, centre = vectors.visited(points, home, index.centres, math.sqrt(2 - 2 * rule.cosine))
    probes = {*zip(row.tolist(), centre.tolist()), *enumerate(home.tolist())}
    a, b = np.nonzero(np.triu(points @ points.T >= rule.cosine, 1))
    assert len(a) > 400
    assert all((i, home[j]) in probes or (j, home[i]) in probes for i, j in zip(a, b))
    found = vectors.compare(points, points, index.centres[0], index, rule)
    assert {(i, j) for i, j in zip(*found) if i < j} == set(zip(a.tolist(), b.tolist()))


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in
            spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in QUERIES["op9_vectors"](spark, sf_dir).collect()), key=repr)
    assert got == plain(rows, 0.98)
