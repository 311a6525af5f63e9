"""Quality rules as a cascade that stops at the first rule that rejects.

What a rule costs and how much it rejects is measured on a sample, each rule for itself;
rules are then asked in the order of rejection per cost. The order decides how much work is
done and never the verdict: a document is kept if no rule rejects it.
"""

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that count as symbols, and as white space in and around words.
SYMBOLS = "#*$%&|<>"
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


class Document:
    """A text with its measures, each made when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()  # bytes: ASCII white space only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        spaces = sum(self.text.count(c) for c in SPACE)
        return len(self.text.decode("utf-8", "replace")) - spaces

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.text.count(c.encode()) for c in SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [line for line in self.text.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) == len(windows):
            return 0
        covered, total = 0, 0  # words up to ``covered`` are counted
        for i, window in enumerate(windows):
            if counts[window] > 1:
                total += i + 3 - max(i, covered)
                covered = i + 3
        return total


# A rule rejects a document.
Rule = tuple[str, Callable[[Document], bool]]

BASE: list[Rule] = [
    ("few_words", lambda d: d.n_words < 50),
    ("repeated_words", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
]
FURTHER: list[Rule] = [
    ("long_words", lambda d: d.word_chars > 20 * d.n_words),
    ("short_words", lambda d: d.word_chars < 2 * d.n_words),
    ("many_symbols", lambda d: 10 * d.n_symbols > d.n_words),
    ("duplicate_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
]
RULES = BASE + FURTHER
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Measured:
    name: str
    seconds: float
    rejected: float


def estimate(docs: DataFrame, rules: list[Rule] = RULES, text: str = "text",
             sample: int = 2_000) -> list[Measured]:
    """Cost and share of rejections of each rule on about ``sample`` rows, by a hash.

    Every rule sees a fresh document, so what rules share is charged to each of them.
    Without rows all estimates are zero.
    """
    count = docs.count()
    share = min(1.0, sample / max(1, count))
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    hashed = F.pmod(F.xxhash64(content), F.lit(1_000_000)) / 1e6
    chosen = docs.select(content.alias("text")).filter(hashed < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seconds, rejected, rows = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for value in batch.column(0):
                content = value.as_py()
                rows += 1
                for i, (_, rejects) in enumerate(rules):
                    begin = time.perf_counter()
                    rejected[i] += rejects(Document(content))
                    seconds[i] += time.perf_counter() - begin
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(rules)), pa.int32()), pa.array(seconds, pa.float64()),
             pa.array(rejected, pa.int64()), pa.array([rows] * len(rules), pa.int64())],
            ["rule", "seconds", "rejected", "rows"])

    totals = chosen.mapInArrow(run, "rule int, seconds double, rejected long, rows long")
    found = {r["rule"]: r for r in totals.groupBy("rule").agg(
        F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"),
        F.sum("rows").alias("rows")).collect()}
    out = []
    for i, (name, _) in enumerate(rules):
        row = found.get(i)
        rows = max(1, row["rows"]) if row else 1
        out.append(Measured(name, row["seconds"] / rows if row else 0.0,
                            row["rejected"] / rows if row else 0.0))
    return out


def ordered(rules: list[Rule], measured: list[Measured]) -> list[Rule]:
    """Rules by rejections per cost; where that is equal, the cheaper one first."""
    by_name = {m.name: m for m in measured}
    gain = lambda m: m.rejected / max(m.seconds, 1e-9)
    return sorted(rules, key=lambda r: (-gain(by_name[r[0]]), by_name[r[0]].seconds))


def cascade(document: Document, rules: list[Rule]) -> tuple[str | None, int]:
    """The first rule that rejects, and how many were asked."""
    for asked, (name, rejects) in enumerate(rules, 1):
        if rejects(document):
            return name, asked
    return None, len(rules)


def verdict_column(text: Column, rules: list[Rule], measures: tuple[str, ...] = ()) -> Column:
    """Struct of kept, rejected_by, asked, and the measures that are asked for.

    A missing text is an empty one: no words, and rejected as soon as a rule wants some.
    """
    fields = [("kept", pa.bool_()), ("rejected_by", pa.string()), ("asked", pa.int32()),
              *((name, pa.int64()) for name in measures)]
    ddl = ", ".join(["kept: boolean", "rejected_by: string", "asked: int",
                     *(f"{name}: bigint" for name in measures)])

    @F.arrow_udf(f"struct<{ddl}>")
    def verdicts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for value in batch:
                document = Document(value.as_py() or b"")
                rejected_by, asked = cascade(document, rules)
                rows.append({"kept": rejected_by is None, "rejected_by": rejected_by,
                             "asked": asked,
                             **{name: getattr(document, name) for name in measures}})
            yield pa.array(rows, pa.struct(fields))

    return verdicts(text.cast("binary"))
