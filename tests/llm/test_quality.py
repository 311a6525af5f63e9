"""Measures against plain counts; the cascade's order changes work, never verdicts."""

from __future__ import annotations

import itertools
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.llm import quality
from ledgerlens.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(line in lines[:i] for i, line in enumerate(lines)),
        "n_repeat_words": len(covered),
    }


tokens = st.sampled_from(["a", "b", "a b c", "é", "漢", "#", "$$", " ", "\n", "\n\n", "\t", "\x0b",
                          "\x85", "\x1c", "a\n", "b a\n"])


@settings(max_examples=400, deadline=None)
@given(st.lists(tokens, max_size=40).map(" ".join) | st.text(max_size=40))
def test_measures(text):
    document = quality.Document(text.encode("utf-8", "replace"))
    assert {m: getattr(document, m) for m in quality.MEASURES} == plain(
        text.encode("utf-8", "replace").decode())


def test_verdict_does_not_depend_on_the_order():
    texts = [b"", b"a " * 60, b"x" * 500, b" ".join(b"w%d" % i for i in range(80)),
             b" ".join(b"w%d ###" % i for i in range(80)), b"one line of it\n" * 30]
    for text in texts:
        kept = {quality.cascade(quality.Document(text), list(order))[0] is None
                for order in itertools.permutations(quality.RULES, 6)}
        assert len(kept) == 1


def test_rules_are_ordered_by_rejections_per_cost(spark):
    docs = spark.createDataFrame([(i, "a b c " * 30 if i % 2 else "w" * (i + 1)) for i in range(200)],
                                 "doc_id long, text string")
    measured = quality.estimate(docs)
    by_name = {m.name: m for m in measured}
    assert by_name["few_words"].rejected == 0.5 == by_name["repeated_words"].rejected
    assert all(m.seconds > 0 for m in measured)
    rules = quality.ordered(quality.RULES, measured)
    gains = [by_name[n].rejected / by_name[n].seconds for n, _ in rules]
    assert gains == sorted(gains, reverse=True)
    fixed = [quality.Measured("few_words", 1.0, 0.2), quality.Measured("repeated_words", 4.0, 0.9)]
    assert [n for n, _ in quality.ordered(quality.BASE, fixed)] == ["repeated_words", "few_words"]
    nothing = quality.estimate(docs.limit(0))
    assert {(m.seconds, m.rejected) for m in nothing} == {(0.0, 0.0)}


def test_cascade_stops_at_the_first_rejection():
    asked = []
    rules = [(n, lambda d, n=n: asked.append(n) or n == "b") for n in "abc"]
    assert quality.cascade(quality.Document(b""), rules) == ("b", 2) and asked == ["a", "b"]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "w " * 100_000)],
                                 "doc_id long, text string").withColumn("kept", F.lit("x"))
    verdict = quality.verdict_column(F.col("text"), quality.RULES, quality.MEASURES)
    got = {r["doc_id"]: r["v"] for r in docs.select("doc_id", verdict.alias("v")).collect()}
    assert not any(v["kept"] for v in got.values())
    assert got[1]["n_words"] == 0 and got[3]["n_repeat_words"] == 100_000
    assert docs.limit(0).select(verdict).collect() == []


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in
             spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op8_quality"](spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]]
        want = plain(text) if len(text or "") < 20_000 else {"n_words": len(WORD.findall(text))}
        assert {m: r[m] for m in want} == want
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_clean_documents_stay(spark):
    sf_dir = "/root/testdata/sf0.1"
    good = {r["doc_id"] for r in
            spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    rows = QUERIES["op8_quality"](spark, sf_dir).filter("not base_failed").collect()
    lost = [r["doc_id"] for r in rows if r["doc_id"] in good and not r["kept"]]
    assert lost == []
    assert sum(not r["kept"] for r in rows) > 200
