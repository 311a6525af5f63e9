"""Removal of repeated byte strings against a plain search, with small and large rules."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import suffixes
from ledgerlens.llm.queries import QUERIES

SMALL = suffixes.Rule(length=12, lead=6, per_range=40, per_splitter=4, slice_bytes=50)


def plain(rows, length):
    texts = [(text or "").encode() for _, text in rows]
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), data in zip(rows, texts):
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if counts[data[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.sum(np.diff(np.r_[0, gone.astype(int)]) == 1))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, rule):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.withColumns({"sha": F.lit("x"), "n_bytes": F.lit(-1), "key.one": F.lit(0)})
    found = suffixes.remove_repeats(frame.repartition(3), rule)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def corpus(seed, letters, passages=6, rows=150):
    """Texts that share passages, of few letters so that strings meet by chance too."""
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice(letters) for _ in range(n))
    shared = [text(draw.randint(8, 60)) for _ in range(passages)]
    out = []
    for doc_id in range(rows):
        parts = [text(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 4)):
            passage = draw.choice(shared)
            begin = draw.randint(0, len(passage) // 2)
            parts += [passage[begin:], text(draw.randint(0, 20))]
        out.append((doc_id, "".join(parts)))
    return out


@pytest.mark.parametrize("seed,letters,rule", [
    (1, "abcdefgh", SMALL),
    (2, "ab", SMALL),
    (3, "aé漢\0", SMALL),
    (4, "abcd", suffixes.Rule(length=12, lead=12, per_range=30, per_splitter=4, slice_bytes=7)),
    (5, "abcdef", suffixes.Rule(length=24, lead=5, per_range=25, per_splitter=2, shares=3)),
    (6, "abc", suffixes.Rule(length=20, lead=8)),
])
def test_every_repeated_byte_and_no_other(spark, seed, letters, rule):
    rows = corpus(seed, letters)
    want = plain(rows, rule.length)
    assert sum(r[2] for r in want) > 1000
    assert run(spark, rows, rule) == want


def test_passage_that_fills_several_ranges(spark, monkeypatch):
    """Half of all suffixes have the same leading bytes, with different contexts."""
    draw = random.Random(9)
    text = lambda n: "".join(draw.choice("abcdefghij") for _ in range(n))
    passage = text(44)
    rows = [(i, text(draw.randint(0, 25)) + passage + text(draw.randint(0, 25)))
            for i in range(400)]
    cuts = []
    shares = suffixes._shares
    monkeypatch.setattr(suffixes, "_shares", lambda *a: cuts.append(1) or shares(*a))
    rule = suffixes.Rule(length=40, lead=10, per_range=30, per_splitter=4)
    assert run(spark, rows, rule) == plain(rows, 40)
    assert len(cuts) > 1


def test_edge_rows(spark):
    long = "x" * 40 + "".join(map(str, range(3000)))
    rows = [(1, None), (2, ""), (None, "abcdefghijklm"), (None, "abcdefghijklm"),
            (3, "abcdefghijk"), (3, "abcdefghijk"), (4, "aaaaaaaaaaaaaaaaaaa"), (5, long),
            (6, long), (6, long + "!"), (7, "zabcdefghijkl"), (8, "é" * 6 + "q"), (9, "é" * 6)]
    assert run(spark, rows, SMALL) == plain(rows, 12)
    assert run(spark, [], SMALL) == []
    assert run(spark, [(1, None)], SMALL) == plain([(1, None)], 12)


def test_multikey_sort_is_the_order_of_the_strings():
    draw = random.Random(3)
    strings = [bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 40))) for _ in range(900)]
    strings += [b"a" * 40] * 60
    table = suffixes._padded(strings, 40)
    order = suffixes.multikey_sort(table)
    sorted_ = [table[i].tobytes() for i in order]
    assert sorted_ == sorted(row.tobytes() for row in table)
    shared = suffixes.common_prefixes(table, order)
    for i in range(1, len(sorted_)):
        a, b = sorted_[i - 1], sorted_[i]
        assert shared[i] == next((k for k in range(40) if a[k] != b[k]), 40)


def test_every_window_has_an_anchor_that_depends_on_it_alone():
    rule = suffixes.Rule(length=30, lead=10, slice_bytes=64)
    hasher = suffixes.Hasher(200)
    draw = random.Random(5)
    text = bytes(draw.choice(b"abc") for _ in range(700))
    inner = text[123:450]
    whole = set(suffixes.anchors(text, hasher, rule)[0].tolist())
    part = suffixes.anchors(inner, hasher, rule)[0]
    assert {p + 123 for p in part.tolist()} <= whole
    assert all(whole & set(range(i, i + rule.span + 1)) for i in range(len(text) - 29))


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted((tuple(r) for r in QUERIES["op13_suffixes"](spark, sf_dir).collect()), key=repr)
    assert got == plain([(r["doc_id"], r["text"]) for r in docs], 400)
