"""Spelling variants against a search by deletions, with large groups cut and whole."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import spelling
from ledgerlens.llm.queries import QUERIES


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            mark = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % 97 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(counts):
    by_rest = defaultdict(set)
    for w in counts:
        by_rest[w].add(w)
        for i in range(len(w)):
            by_rest[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in by_rest.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda b: (-counts[b], b), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def run(spark, rows, rule=spelling.Rule()):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    frame = frame.withColumns({"word": F.lit("x"), "n": F.lit(1), "a.b": F.lit(2)})
    found = spelling.variants(frame.repartition(3), rule)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def texts(seed, letters, stems=60, docs=80):
    draw = random.Random(seed)
    words = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 8)))
             for _ in range(stems)]
    for w in words[: stems // 2] * 3:
        at, c = draw.randrange(len(w)), draw.choice(letters)
        words.append(draw.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:],
                                  w[:at] + c + w[at + 1 :]]))
    weights = [1 / (1 + i) for i in range(len(words))]
    return [(i, " ".join(w.upper() if draw.random() < 0.1 else w
                         for w in draw.choices(words, weights, k=60))) for i in range(docs)]


@pytest.mark.parametrize("letters,rule", [
    ("abcdefg", spelling.Rule()),
    ("ab", spelling.Rule(group_words=6)),
    ("abé", spelling.Rule(group_words=1, held_words=10)),
    ("abcÿÀ", spelling.Rule(group_words=20)),
])
def test_every_word_near_and_form(spark, letters, rule):
    rows = texts(len(letters), letters)
    want = plain(plain_words(rows))
    assert sum(r[4] for r in want) > 50 and any(r[2] != (r[1] or r[0]) for r in want) or (
        len(letters) != 2)
    assert run(spark, rows, rule) == want


def test_scan_finds_all_pairs():
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("abc") for _ in range(draw.randint(1, 7)))
                    for _ in range(400)})
    want = {(i, j) for j, b in enumerate(words) for i, a in enumerate(words[:j])
            if one_edit(a, b)}
    assert set(spelling.near_by_scan(words, 0)) == want
    led = sorted("xy" + w for w in words)
    got = list(spelling.near_by_scan(led, 2))
    assert len(got) == len(set(got)) and set(got) == want


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "hello hello hello hallo HALLO ÀÿÀÿÀ"), (3, "hello, x×y÷z"),
            (3, "hello, x×y÷z"), (3, "hello, x×y÷z"), (None, "àÿàÿà àÿàÿà àÿàÿà hallo"),
            (4, "w" * 5000 + " " + "w" * 4999), (5, ("w" * 5000 + " " + "w" * 4999 + " ") * 3)]
    want = plain(plain_words(rows))
    assert len(want) > 4
    assert run(spark, rows) == want
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted((tuple(r) for r in QUERIES["op12_spelling"](spark, sf_dir).collect()), key=repr)
    want = plain(plain_words([(r["doc_id"], r["text"]) for r in docs]))
    assert len(want) > 500 and got == want
