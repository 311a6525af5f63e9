"""Each stage against a plain version of itself, and the edges of all."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from ledgerlens.llm import mixing, secrets, simhash, toxicity
from ledgerlens.llm.queries import toxicity_model
from tests.llm.test_simhash import plain_fingerprint, plain_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stage(name):
    return dict(pipeline.STAGES)[name]


def test_toxic_documents_go(spark, sf_dir, docs):
    kept = stage("toxicity")(spark, docs, sf_dir)
    assert kept.columns == COLUMNS
    model = toxicity_model(spark, sf_dir, docs)
    scores = docs.select("doc_id", toxicity.score_column(F.col("text"), model, spark).alias("s"))
    want = {r["doc_id"] for r in scores.collect() if r["s"] < 0.5}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_one_document_of_each_group_stays(spark, sf_dir, docs):
    rows = docs.collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"], 3) for r in rows}
    groups = plain_groups(prints, 3)
    assert any(key != first for key, first in groups.items())
    kept = stage("near_duplicates")(spark, docs, sf_dir)
    assert kept.columns == COLUMNS
    got = {tuple(r) for r in kept.collect()}
    assert got == {tuple(r) for r in rows if groups[r["doc_id"]] == r["doc_id"]}
    assert len({r["text"] for r in kept.collect()}) == len(got)


def test_near_copies_go_and_others_stay(spark, sf_dir):
    words = [f"word{i}" for i in range(4000)]
    near = [*words[:200], "changed", *words[201:]]
    far = [f"other{i}" for i in range(4000)]
    assert (plain_fingerprint(" ".join(words)) ^ plain_fingerprint(" ".join(near))
            ).bit_count() <= 3
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((words, near, far, words))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, "
                                  "n_chars long")
    left = stage("near_duplicates")(spark, frame, sf_dir).collect()
    assert sorted(r["doc_id"] for r in left) == [0, 2]


def test_secrets_are_masked_and_every_document_stays(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = {r["doc_id"]: r for r in stage("secrets")(spark, docs, sf_dir).collect()}
    words = {w: i for i, w in enumerate(dict.fromkeys(secrets.COMMON), 1)}
    longest = max(map(len, words))
    changed = 0
    for row in docs.collect():
        text = row["text"]
        spans = secrets.find(text, secrets.Rule(), words, longest)
        inside = set()
        for _, start, end, _ in spans:
            inside |= set(range(start, end))
        out, before = [], False
        for i, char in enumerate(text):
            if i in inside and not before:
                out.append("[SECRET]")
            elif i not in inside:
                out.append(char)
            before = i in inside
        got = clean.pop(row["doc_id"])
        assert got["text"] == "".join(out) and got["n_chars"] == len(got["text"])
        changed += bool(spans)
    assert not clean and changed


def test_mixed_rows_come_as_often_as_they_are_taken(spark, sf_dir, docs):
    times = {r["doc_id"]: -(-r["taken"] // r["size"]) if r["size"] else 0
             for r in mixing.plan(docs)[0].collect()}
    mixed = stage("mixing")(spark, docs, sf_dir)
    assert mixed.columns == COLUMNS
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in times.items() if n}


def test_encoded_like_the_library(spark, sf_dir, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {r["doc_id"]: r["ids"] for r in stage("encoding")(spark, docs, sf_dir).collect()}
    for row in docs.collect():
        assert ids[row["doc_id"]] == library.encode(row["text"], add_special_tokens=False).ids


def test_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(function(spark, docs, sf_dir).collect(), docs.schema)
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    want = sorted((r["doc_id"], r["n_tokens"]) for r in last.collect())
    got = sorted((r["doc_id"], r["n_tokens"]) for r in pipeline.run(spark, sf_dir).collect())
    assert got == want and len(got) > 50


EDGES = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0),
         (None, "a b c d e f", None, "s", 11), (None, "a b c d e f", None, "s", 11),
         (5, "token = abcdef123456", "en", None, 20), (6, "w " * 30_000, "de", "t", 60_000)]


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_edge_rows(spark, sf_dir, name):
    frame = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string, "
                                  "n_chars long")
    # Names that a stage could want for itself.
    clash = {c: F.lit(1) for c in ("_score", "_mark", "_root", "fingerprint", "_row", "ids",
                                   "component_id", "size", "epochs", "_first_id", "_key", "a.b")}
    for docs in (frame, frame.withColumns(clash)):
        some = stage(name)(spark, docs, sf_dir)
        rows = some.collect()
        if name == "encoding":
            assert len(rows) == 7 and sum(r["n_tokens"] == 0 for r in rows) == 3
        else:
            assert some.columns == docs.columns
            if name == "near_duplicates":  # empty texts are one group
                ids = sorted((r["doc_id"] for r in rows), key=str)
                assert ids == [1, 5, 6, None]
            if name == "secrets":
                assert {r["text"] for r in rows if r["doc_id"] == 5} == {"[SECRET]"}
            if name in ("secrets", "toxicity"):
                assert len(rows) == 7
        assert stage(name)(spark, docs.limit(0), sf_dir).collect() == []
