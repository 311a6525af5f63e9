"""Groups of spelling variants: words that differ by one code point.

1. Words are counted per task and added up.
2. Two words with one edit between them share the first or the last half of the shorter one,
   so words meet by those halves (from behind, words are read backwards).
3. In a group the sorted words are scanned once for all of them: after each code point of the
   current word there is a row of the banded edit matrix of every word that is still within
   one edit. The next word keeps the rows of the prefix it shares with this one. Where only
   the word itself is left, all words with that prefix are skipped.
4. Groups of more than ``group_words`` words are cut by what is left without one code point,
   which leaves groups as large as the alphabet, or the alphabet times the length.
5. Each word's near words are counted and the most frequent one is its form; forms are
   followed by pointer doubling.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_side
from ledgerlens.session import cut_lineage

# Fixed value: what a word is made of, in lower case.
LETTERS = "[a-zÀ-ÿ]"


@dataclass(frozen=True)
class Rule:
    """length, count: least code points and occurrences of a word.

    damage: of a crc32 that this divides, a code point of the word is deleted (0: never).
    factor: a form is at least this many times as frequent. group_words: see above.
    held_words: words that a task counts before it sends them on.
    """

    length: int = 5
    count: int = 3
    damage: int = 97
    factor: int = 2
    group_words: int = 100_000
    held_words: int = 300_000


def words_of(doc_id: str, text: bytes, runs: re.Pattern, rule: Rule) -> list[str]:
    """The words of a text, each as often as it occurs, with its deletions.

    Only words that are too short can be missing. Lower case of bytes changes A to Z alone.
    """
    found = runs.findall(text.lower().decode())
    if not rule.damage:
        return found
    seed, damaged = crc32(f"{doc_id}:".encode()), {}
    for run in set(found):
        mark = crc32(run.encode(), seed)
        if mark % rule.damage == 0:
            gap = mark % len(run)
            damaged[run] = run[:gap] + run[gap + 1 :]
    return [damaged.get(run, run) for run in found] if damaged else found


def _count(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"{LETTERS}{{{rule.length},}}")
        held: Counter = Counter()

        def sent():
            words = [word for word in held if len(word) >= rule.length]
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())],
                ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(*batch.columns):
                held.update(words_of(doc_id.as_py() or "", text.as_py() or b"", runs, rule))
                if len(held) > rule.held_words:
                    yield sent()
                    held.clear()
        yield sent()

    return run


def vocabulary(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id",
               text: str = "text") -> DataFrame:
    """word and n of all words that are long and frequent enough: a written table."""
    texts = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("binary"))
    counted = texts.mapInArrow(_count(rule), "word string, n long")
    return cut_lineage(
        counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rule.count),
        "vocabulary")


def near_by_scan(words: list[str], shared: int) -> Iterator[tuple[int, int]]:
    """(j, i), j < i, of sorted words with one edit between them after ``shared`` code points.

    A band holds three cells a row: the distances to the other word's prefixes with one code
    point fewer, as many, and one more. Prefixes that reach past its end differ there.
    """
    size = len(words)
    length = np.array([len(word) for word in words])
    # A row of nothing before the first code point, and two after the last.
    chars = np.zeros((int(length.max()) + 3, size), np.int32)
    for i, word in enumerate(words):
        chars[1 : len(word) + 1, i] = np.frombuffer(word.encode("utf-32-le"), np.int32)
    apart = chars[1:, 1:] != chars[1:, :-1]
    prefix = [0, *np.where(apart.any(axis=0), apart.argmax(axis=0), length[1:]).tolist(), 0]
    band = np.array([[1], [0], [1]], np.int8).repeat(size, axis=1)
    # Later words still within one edit, and their cells, by the code points read.
    rows = {shared: (np.arange(size), band)}
    j = 0
    while j < size:
        depth, end = max(prefix[j], shared), int(length[j])
        alive, cells = rows[depth]
        while depth < end and len(alive) > 1:
            new = cells + (chars[depth : depth + 3][:, alive] != chars[depth + 1, j])
            np.minimum(new[:2], cells[1:] + 1, out=new[:2])
            np.minimum(new[1], new[0] + 1, out=new[1])
            np.minimum(new[2], new[1] + 1, out=new[2])
            depth += 1
            kept = (new <= 1).any(axis=0) & (alive >= j)
            alive, cells = alive[kept], new[:, kept]
            rows[depth] = alive, cells
        if len(alive) > 1:
            step = length[alive] - depth + 1
            near = (step >= 0) & (step <= 2) & (alive > j)
            for i in alive[near][cells[step[near], np.flatnonzero(near)] == 1].tolist():
                yield j, i
            j += 1
            continue
        # Nothing later but words with this prefix is near it, and there is one at most.
        j += 1
        while j < size and prefix[j] >= depth:
            j += 1


def _accepted(kind: str, shared: int, a: str, b: str, group: str) -> bool:
    """Whether this is the one group in which the pair counts."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) // 2 != shared:
        return False
    front = next((k for k in range(len(short)) if short[k] != long[k]), len(short))
    if kind[0] == "b" and front >= shared:
        return False
    if len(kind) == 1:
        return True
    # Words of a part are as they were written: not read backwards.
    if kind[1] == "r":
        return len(a) == len(b) and f"{front}:{short[:front]}{short[front + 1:]}" == group
    return len(a) != len(b) and short == group


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind, shared, part, word and n, by group, to near words' counts and the best."""
    held: tuple | None = None
    words: list[str] = []
    counts: list[int] = []

    def found():
        best: dict[str, list] = {}
        if len(words) > 1:
            kind, shared, part = held
            backwards = kind == "b"
            read = [word[::-1] for word in words] if backwards else words
            order = sorted(range(len(read)), key=read.__getitem__)
            for j, i in near_by_scan([read[k] for k in order], shared if len(kind) == 1 else 0):
                j, i = order[j], order[i]
                if not _accepted(kind, shared, words[j], words[i], part):
                    continue
                for own, other in ((j, i), (i, j)):
                    held_best = best.setdefault(words[own], [0, 0, ""])
                    held_best[0] += 1
                    if (-counts[other], words[other]) < (-held_best[1], held_best[2]):
                        held_best[1:] = [counts[other], words[other]]
        rows = [(word, *values) for word, values in best.items()]
        columns = list(zip(*rows)) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
             pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
            ["word", "n_near", "near_n", "near"])

    for batch in batches:
        columns = [batch.column(name).to_pylist()
                   for name in ("kind", "shared", "part", "word", "n")]
        for kind, shared, part, word, n in zip(*columns):
            if (kind, shared, part) != held:
                if len(words) > 1:
                    yield found()
                held, words, counts = (kind, shared, part), [], []
            words.append(word)
            counts.append(n)
    if len(words) > 1:
        yield found()


def halves(words: DataFrame) -> DataFrame:
    """word, n, kind (f: from the front, b: from behind), shared and part of every group."""
    size = F.length("word")
    shared = F.array_distinct(F.array(F.floor(size / 2), F.floor((size - 1) / 2)))
    rows = words.withColumn("shared", F.explode(shared.cast("array<int>")))
    ends = F.array(
        F.struct(F.lit("f").alias("kind"), F.expr("left(word, shared)").alias("part")),
        F.struct(F.lit("b").alias("kind"), F.expr("right(word, shared)").alias("part")))
    return rows.select("word", "n", "shared", F.inline(ends))


def without_one(rows: DataFrame) -> DataFrame:
    """Rows of large groups by what is left of a word without one code point of its open part.

    ``r``: with the place, for words of the same length; ``d``: without, where a word that is
    one code point shorter joins as it is.
    """
    size = F.length("word")
    first = F.when(F.col("kind") == "f", F.col("shared") + 1).otherwise(F.lit(1))
    last = F.when(F.col("kind") == "f", size).otherwise(size - F.col("shared"))
    left = lambda at: F.concat(
        F.substring("word", F.lit(1), at - 1), F.substring("word", at + 1, size))
    places = F.sequence(first, last)
    replaced = F.transform(places, lambda at: F.struct(
        F.concat("kind", F.lit("r")).alias("kind"),
        F.concat((at - 1).cast("string"), F.lit(":"), left(at)).alias("part")))
    deleted = F.transform(
        F.array_distinct(F.concat(F.array("word"), F.transform(places, left))),
        lambda part: F.struct(F.concat("kind", F.lit("d")).alias("kind"), part.alias("part")))
    return rows.select("word", "n", "shared", F.inline(F.concat(replaced, deleted)))


def near_words(words: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """word, n_near, near and near_n (the most frequent near word) of words that have any.

    ``words`` is a written table of distinct words and their counts.
    """
    group = ["kind", "shared", "part"]
    rows = halves(words)
    large = cut_lineage(
        rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rule.group_words).select(*group), "large-groups")
    if not large.isEmpty():
        listed = small_side(large)
        cut = without_one(rows.join(listed, group, "left_semi"))
        rows = rows.join(listed, group, "left_anti").unionByName(cut)
    ordered = rows.repartition(*group).sortWithinPartitions(*group)
    found = ordered.mapInArrow(_scan, "word string, n_near long, near_n long, near string")
    # The struct orders by count, then by code points: of a negative count the least is first.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.near").alias("near"),
        (-F.col("best.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root of a table of word and form, where forms lead to no circle.

    Each round doubles the steps that a word has followed; each is written, and the last
    changes nothing.
    """
    current = cut_lineage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = current.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        moved = current.join(ahead, F.col("root") == F.col("_word"), "left")
        if moved.filter("_root IS NOT NULL").isEmpty():
            return current
        current = cut_lineage(
            moved.select("word", F.coalesce("_root", "root").alias("root")), "roots")


def variants(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id",
             text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    A missing text has no words, and a missing doc_id counts as empty text where a deletion
    is decided. Rows that repeat count again, ties of forms go to the word that is first in
    code-point order, other columns are left alone, and an empty table gives an empty one.
    """
    words = vocabulary(docs, rule, doc_id, text)
    near = cut_lineage(near_words(words, rule), "near")
    larger = F.col("near_n") >= rule.factor * F.col("n")
    found = cut_lineage(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(larger, F.col("near")).alias("form"),
            F.when(larger, F.col("near_n")).alias("form_n")), "forms")
    followed = roots(found.filter("form IS NOT NULL"))
    return found.join(followed, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
