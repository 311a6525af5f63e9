"""The language model against exact counts, and the filter against its promises."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import lm
from ledgerlens.llm.queries import QUERIES


def tokens(text):
    lowered = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), None]


def plain(docs, train):
    counts = Counter(t for text in train for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in docs:
        found = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in found)
        out.append((doc_id, len(found), sum(counts[t] > 0 for t in found), n, base))
    return out


def check(rows, want):
    key = lambda r: (str(r[0]), r[1], r[2], round(r[4], 6))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"])
           for r in rows]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)


@pytest.mark.parametrize("head", [500_000, 40, 0])
def test_query_against_exact_counts(spark, sf_dir, head):
    """Also with few or no words broadcast, the others joined."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in table.collect()]
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    if head == 500_000:
        rows = QUERIES["op10_lm"](spark, sf_dir).collect()
        for r in rows:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    else:
        rule = lm.Rule(head=head, bucket_bytes=50_000)
        learned = table.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
        rows = lm.score(table, lm.learn(learned, rule), rule).collect()
    check(rows, plain(docs, train))
    assert all(r["score"] < 0 for r in rows)


def test_filter_keeps_every_count(spark, sf_dir):
    """No level is below the true one, and few are above; so scores are near exact ones."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm.learn(table, lm.Rule(bucket_bytes=100_000))
    texts = [(r["text"] or "").encode() for r in table.collect()]
    hashes = lm._Hashes()
    start = np.frombuffer(hashes[lm.START], np.uint64)[0]
    words, pairs = Counter(), Counter()
    for text in texts:
        found = lm.tokens(text, hashes)
        words.update(found.tolist())
        pairs.update(lm.pair_hashes(lm.before_of(found, start), found).tolist())
    assert (model.n_tokens, model.n_words, model.n_texts) == (
        sum(words.values()), len(words), len(texts))
    for counts in (words, pairs):
        keys = np.array(list(counts), np.uint64)
        true = lm.levels(np.array(list(counts.values())))
        level = model.filter.level(keys)
        assert (level >= true).all() and (level > true).mean() < 0.05
    absent = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert (model.filter.level(absent) > 0).mean() < 0.05


def test_a_small_filter_still_holds_everything(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm.learn(table, lm.Rule(max_bytes=4096, bucket_bytes=100_000))
    assert len(model.filter.parts) <= 4096 + 8 * (1 << model.filter.bucket_bits)
    assert lm.score(table, model).count() == table.count()


def test_model_predicts_text_better_than_single_words(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [r for r in QUERIES["op10_lm"](spark, sf_dir).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_probabilities_add_up_to_about_one():
    """Over all next words, with exact counts in place of the filter."""
    class Exact:
        def level(self, ngrams):
            return np.zeros(len(ngrams), np.int64)

    hashes = lm._Hashes()
    start = np.frombuffer(hashes[lm.START], np.uint64)[0]
    found = [lm.tokens(w, hashes)[:1] for w in (b"a", b"b", b"c")]
    nothing = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    out = lm._score_batch(found, Exact(), nothing, (0, 0, 3), 2.0, start)
    scores = [row["score"].as_py() for row in out]
    assert sum(10**s for s in scores) == pytest.approx(3 / 4)  # the fourth part is for others


def test_edge_rows(spark):
    docs = [(1, "A b"), (2, None), (3, ""), (3, ""), (None, "a B"), (5, "a " * 50_000), (6, "z\x85")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns(
        {"score": F.lit("x"), "row": F.lit(1), "word": F.lit(2)})
    train = frame.filter("doc_id < 6")
    for rule in (lm.Rule(), lm.Rule(head=0), lm.Rule(max_bytes=8)):
        rows = lm.score(frame, lm.learn(train, rule), rule).collect()
        check(rows, plain(docs, [t for i, t in docs if i is not None and i < 6]))
    nothing = lm.learn(frame.limit(0))
    check(lm.score(frame, nothing).collect(), plain(docs, []))
    assert lm.score(frame.limit(0), lm.learn(train)).collect() == []


@pytest.mark.parametrize("max_bytes", [60_000, 20_000])
def test_many_slices_give_the_scores_of_one(spark, sf_dir, max_bytes):
    """The filter keeps its bits a level however little of it is broadcast at once."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    whole = lm.learn(table, lm.Rule(bucket_bytes=20_000))
    sliced = lm.learn(table, lm.Rule(bucket_bytes=20_000, max_bytes=max_bytes))
    slices = list(sliced.slices())
    assert whole.parts is None and len(slices) > 1
    assert all(len(s.parts) <= max_bytes for s in slices)
    assert np.array_equal(np.concatenate([s.parts for s in slices]), whole.filter.parts)
    key = lambda r: (r["doc_id"], r["score"])
    assert sorted(lm.score(table, sliced).collect(), key=key) == sorted(
        lm.score(table, whole).collect(), key=key)


def test_buckets_larger_than_a_slice_have_several_parts(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = lm.learn(table, lm.Rule(max_bytes=60_000))
    absent = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    found = np.max([s.level(absent) for s in model.slices()], axis=0)
    assert (found > 0).mean() < 0.05
