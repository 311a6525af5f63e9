"""The transducers against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlens.llm import bpe
from ledgerlens.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
with open(PATH, encoding="utf-8") as file:
    MODEL = file.read()
ENCODER, DECODER = bpe.Encoder(MODEL), bpe.Decoder(MODEL)
LIBRARY = Tokenizer.from_file(PATH)


def library(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def same(text):
    ids = ENCODER.encode(text).tolist()
    return (ids, DECODER.decode(ids)) == library(text)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert same(text)


@pytest.mark.parametrize("text", [
    "", " ", "\n\t", "a", "It's we'll they'd 've", "naïve café Å Σίσυφος İstanbul ẞ",
    "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "<|endof", "x" * 5000, "漢字🙂" * 700,
    "1234567890" * 30, "the " * 30_000, "á" * 300, "\x00\x1c\x85　", "a\U0003d000b Ᲊa", "a\u1df6\u0301b",
])
def test_edges(text):
    assert same(text)


def test_windows_of_any_size_cut_alike():
    draw = random.Random(1)
    known = [t.removesuffix("</w>") for t in ENCODER.vocab]
    known = [t for t in known if t.isascii() and t.isalpha()]
    for _ in range(150):
        word = "".join(draw.choice(known) for _ in range(draw.randint(1, 60)))
        whole = ENCODER.merge([*word[:-1], word[-1] + "</w>"])
        for window in (1, 7, 100, None):
            assert list(ENCODER.tokens(word, window)) == whole


def test_long_words_are_cut_while_they_are_read():
    held = ENCODER.tokens("abcdefgh" * 100_000)
    assert [next(held) for _ in range(3)] == ENCODER.merge(list("abcdefgh" * 20))[:3]


def test_a_merge_before_its_parts_is_refused():
    model = ('{"model": {"vocab": {}, "end_of_word_suffix": "</w>", "merges": ["ab c", "a b"]},'
             ' "added_tokens": []}')
    with pytest.raises(ValueError):
        bpe.Encoder(model)


def test_plain_text_comes_back():
    plain = bpe.Decoder(MODEL, plain=True)
    assert plain.decode(ENCODER.encode("Größe, 漢字 🙂!").tolist()) == "größe , 漢字 🙂! "
    # A character cut in two by the ids is put together again, a lost half is replaced.
    ids = ENCODER.encode("🙂").tolist()
    assert plain.decode(ids, step=1) == "🙂 "


def test_columns(spark):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = bpe.load(spark, PATH)
    ids = docs.select("doc_id", bpe.encode_column(F.col("text"), model).alias("ids"))
    back = ids.select("doc_id", "ids", bpe.decode_column(F.col("ids"), model).alias("back"))
    got = {(r["doc_id"], tuple(r["ids"]), r["back"]) for r in back.collect()}
    found, text = library("Hello world")
    assert got == {(1, tuple(found), text), (2, (), ""), (3, (), "")}
    assert back.count() == 4
    lost = spark.createDataFrame([(None,), ([10**6],)], "ids array<int>")
    assert [r[0] for r in lost.select(bpe.decode_column(F.col("ids"), model)).collect()] == [
        None, ""]
    assert docs.limit(0).select(bpe.encode_column(F.col("text"), model)).collect() == []


def test_query_against_the_library(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in
             spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    rows = QUERIES["op4_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids, text = library(texts[row["doc_id"]] or "")
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == digest(" ".join(map(str, ids)))
        assert row["decoded_sha256"] == digest(text)
