"""Scores of texts by a bigram model whose counts are held in a Bloom filter.

1. Words and pairs of words are hashed and counted: each task adds up what it reads, counts
   meet by the leading bits of the hash, in buckets that grow in number with the text. What
   a task has for a bucket travels as one packed row.
2. A count c enters the filter as its quantised logarithm: the n-gram is stored once for
   each level from 1 to 1 + floor(log2(c)). To look a count up, levels are probed until one
   is missing; the middle of the last level's range is taken. A bucket of n-grams has a part
   of the filter to itself, so the parts are made by independent tasks.
3. The filter takes about 8.7 bits for each level at any size. It is broadcast whole up to
   ``max_bytes``, else in slices of so many bytes: one pass over the texts a slice looks up
   the n-grams whose parts it holds, and the levels found travel with the texts.
4. The probability of a word after another is smoothed with that of the word alone, which
   adds one to its count: (c(v, w) + weight * p(w)) / (c(v) + weight).

Exact counts, which only the base score needs, come from two sides: the most frequent
words, of a bounded number, are broadcast; the rest of each document's words are joined.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import power_of_two, short_batches
from ledgerlens.session import cut_lineage, remove_folder, work_folder

SEED = 42
# What no word can be: the end of a text, and what stands before its first word.
END, START = b"\n", b"\t"
CACHED_WORDS = 60_000
FLUSH = 1_000_000


@dataclass(frozen=True)
class Rule:
    """max_bytes: of the filter that are broadcast at once. bucket_bytes: text per bucket of
    n-grams. head: words whose exact counts are broadcast."""

    weight: float = 2.0
    probes: int = 6
    bits_per_level: float = 8.7
    max_bytes: int = 1 << 28
    bucket_bytes: int = 2 << 20
    head: int = 500_000


# --- tokens ---------------------------------------------------------------------------------


class _Hashes(dict):
    """Hash of a word as eight bytes, kept up to a number of words."""

    def __missing__(self, word: bytes) -> bytes:
        found = xxhash.xxh64_intdigest(word, SEED).to_bytes(8, "little")
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


def tokens(text: bytes, hashes: _Hashes) -> np.ndarray:
    """Hashes of the words of a text (A-Z in lower case) and of the end."""
    words = text.lower().split()  # bytes: ASCII white space only
    words.append(END)
    return np.frombuffer(b"".join(map(hashes.__getitem__, words)), np.uint64)


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of hashes."""
    x = values + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hashes(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mixed(mixed(before, 1) ^ after, 2)


def before_of(found: np.ndarray, start: np.uint64) -> np.ndarray:
    """The token in front of each token of one text."""
    return np.concatenate([[start], found[:-1]]).astype(np.uint64)


# --- counts ---------------------------------------------------------------------------------


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _bucket(keys: np.ndarray, bits: int) -> np.ndarray:
    """Leading bits of an n-gram's hash."""
    if not bits:
        return np.zeros(len(keys), np.int32)
    return (keys >> np.uint64(64 - bits)).astype(np.int32)


COUNTS = "bucket int, size int, ngrams binary, rows binary"


def _count(bits: int):
    """Counts of single tokens (size 1) and pairs (2) of the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        start = np.frombuffer(hashes[START], np.uint64)[0]

        def send(single, pairs):
            for size, parts in ((1, single), (2, pairs)):
                keys, rows = _summed(parts, [np.ones(len(p), np.int64) for p in parts])
                # Keys are in order, so those of a bucket are together.
                buckets, first = np.unique(_bucket(keys, bits), return_index=True)
                ends = [*first[1:].tolist(), len(keys)]
                packed = [[values[a:b].tobytes() for a, b in zip(first.tolist(), ends)]
                          for values in (keys, rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets), pa.array(np.full(len(buckets), size, np.int32)),
                     *(pa.array(values, pa.binary()) for values in packed)],
                    ["bucket", "size", "ngrams", "rows"])

        single, pairs, held = [], [], 0
        for batch in batches:
            for value in batch.column(0):
                found = tokens(value.as_py() or b"", hashes)
                single.append(found)
                pairs.append(pair_hashes(before_of(found, start), found))
                held += len(found)
                if held > FLUSH:
                    yield from send(single, pairs)
                    single, pairs, held = [], [], 0
        yield from send(single, pairs)

    return run


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count)) of counts above zero."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def middle(level: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 for level 0."""
    low = np.ldexp(0.5, level)
    return np.where(level > 0, (3 * low - 1) / 2, 0.0)


BUCKETS = "bucket int, words binary, word_rows binary, pairs binary, pair_rows binary, " \
          "n_words long, n_tokens long, n_levels long"


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Total counts by bucket, of rows that are sorted by bucket."""
    held: dict = {1: ([], []), 2: ([], [])}
    current = None

    def done(bucket):
        words, word_rows = _summed(*held[1])
        pairs, pair_rows = _summed(*held[2])
        n_levels = int(levels(word_rows).sum() + levels(pair_rows).sum())
        row = [bucket, words.tobytes(), word_rows.tobytes(), pairs.tobytes(),
               pair_rows.tobytes(), len(words), int(word_rows.sum()), n_levels]
        kinds = [pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 3]
        names = [part.split()[0] for part in BUCKETS.split(", ")]
        for size in held:
            held[size] = ([], [])
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(row, kinds)], names)

    for batch in batches:
        for bucket, size, ngrams, rows in zip(*batch.columns):
            bucket = bucket.as_py()
            if current is not None and bucket != current:
                yield done(current)
            current, parts = bucket, held[size.as_py()]
            parts[0].append(np.frombuffer(ngrams.as_py(), np.uint64))
            parts[1].append(np.frombuffer(rows.as_py(), np.int64))
            if len(parts[0]) > 64:  # add up now and then
                held[size.as_py()] = tuple([part] for part in _summed(*parts))
    if current is not None:
        yield done(current)


# --- filter ---------------------------------------------------------------------------------


def positions(ngrams: np.ndarray, level, probes: int, part_bits: int) -> Iterator[np.ndarray]:
    """Places in a bucket's part of the filter, probe by probe."""
    item = mixed(ngrams + np.uint64(0x632BE59BD9B4E019) * np.asarray(level).astype(np.uint64), 3)
    step = mixed(item, 4) | np.uint64(1)
    for probe in range(probes):
        yield (item + np.uint64(probe) * step) % np.uint64(part_bits)


def fill(ngrams: np.ndarray, counts: np.ndarray, probes: int, part_bits: int,
         into: np.ndarray) -> None:
    """Stores n-grams with all levels up to that of their count; ``into`` has a byte per bit."""
    level = levels(counts)
    for j in range(1, int(level.max(initial=0)) + 1):
        for place in positions(ngrams[level >= j], j, probes, part_bits):
            into[place] = 1


def _build(probes: int, part_bits: int, bucket_bits: int, more: int):
    """Parts of the filter; a bucket of counts has 2 ** ``more`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one bucket's bytes at a time
                row = batch.slice(i, 1).to_pylist()[0]
                counted = [(np.frombuffer(row[ngrams], np.uint64),
                            np.frombuffer(row[rows], np.int64))
                           for ngrams, rows in (("words", "word_rows"), ("pairs", "pair_rows"))]
                first = row["bucket"] << more
                for bucket in range(first, first + (1 << more)):
                    bits = np.zeros(part_bits, np.uint8)
                    for ngrams, rows in counted:
                        if more:
                            own = _bucket(ngrams, bucket_bits) == bucket
                            ngrams, rows = ngrams[own], rows[own]
                        fill(ngrams, rows, probes, part_bits, bits)
                    packed = np.packbits(bits, bitorder="little").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())],
                        ["bucket", "part"])

    return run


@dataclass
class Filter:
    """parts: bits of buckets one after the other, each of ``part_bits`` bits.

    highest: the level that the count of all tokens has; a filter that is too full for its
    n-grams must not be asked for more. first: the bucket that ``parts`` begins with; a slice
    holds some of the buckets only, and n-grams of others have level 0 in it.
    """

    parts: np.ndarray
    part_bits: int
    bucket_bits: int
    probes: int
    highest: int
    first: int = 0

    def fields(self) -> tuple:
        """What is broadcast: executors need not have this class."""
        return (self.parts, self.part_bits, self.bucket_bits, self.probes, self.highest,
                self.first)

    def level(self, ngrams: np.ndarray) -> np.ndarray:
        """The highest level up to which all are stored; 0 if the first is missing."""
        out = np.zeros(len(ngrams), np.int64)
        bucket = _bucket(ngrams, self.bucket_bits) - self.first
        held = 8 * len(self.parts) // self.part_bits
        alive = np.flatnonzero((bucket >= 0) & (bucket < held))
        offset = bucket.astype(np.uint64) * np.uint64(self.part_bits)
        for j in range(1, self.highest + 1):
            if not len(alive):
                break
            keys, base = ngrams[alive], offset[alive]
            found = np.ones(len(alive), bool)
            for place in positions(keys, j, self.probes, self.part_bits):
                at = base[found] + place[found]
                bit = (self.parts[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                found[np.flatnonzero(found)[bit == 0]] = False
                if not found.any():
                    break
            alive = alive[found]
            out[alive] = j
        return out


@dataclass
class Looked:
    """Levels that were looked up before, of n-grams in order."""

    ngrams: np.ndarray
    levels: np.ndarray

    def level(self, ngrams: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.ngrams, ngrams)].astype(np.int64)


# --- scores ---------------------------------------------------------------------------------


@dataclass
class Model:
    """counts: the written table of buckets. Tokens and distinct tokens of the training text.

    filter: all of it if ``parts`` is None, else its first slice; the others are read from
    the written table of ``parts``.
    """

    counts: DataFrame
    filter: Filter
    n_texts: int
    n_tokens: int
    n_words: int
    parts: DataFrame | None = None

    def slices(self) -> Iterator[Filter]:
        """One after the other, so that no more than one is held."""
        f = self.filter
        yield f
        held = 8 * len(f.parts) // f.part_bits
        for first in range(held, 1 << f.bucket_bits, held):
            some = min(held, (1 << f.bucket_bits) - first)
            yield Filter(_joined(self.parts, f.part_bits, first, some), f.part_bits,
                         f.bucket_bits, f.probes, f.highest, first)


def _joined(parts: DataFrame, part_bits: int, first: int, held: int) -> np.ndarray:
    """The bytes of ``held`` buckets from ``first`` on."""
    size = part_bits // 8
    out = np.zeros(held * size, np.uint8)
    # A row has all n-grams of a bucket.
    with short_batches(parts.sparkSession, 8):
        made = parts.filter(F.col("bucket").between(first, first + held - 1)).toArrow()
    for bucket, part in zip(made.column("bucket"), made.column("part")):
        at = (bucket.as_py() - first) * size
        out[at : at + size] = np.frombuffer(part.as_buffer(), np.uint8)
    return out


def learn(texts: DataFrame, rule: Rule = Rule(), text: str = "text") -> Model:
    """Counts of all ``texts``; a missing text is an empty one, whose only token is the end."""
    content = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    n_texts, size = texts.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    bits = power_of_two(size, rule.bucket_bytes)
    counted = texts.select(content).mapInArrow(_count(bits), COUNTS)
    gathered = counted.repartition("bucket").sortWithinPartitions("bucket")
    with short_batches(texts.sparkSession):
        counts = cut_lineage(gathered.mapInArrow(_gather, BUCKETS), "ngram-counts")
    n_words, n_tokens, n_levels = counts.agg(
        *(F.coalesce(F.sum(c), F.lit(0)) for c in ("n_words", "n_tokens", "n_levels"))).first()
    whole = int(n_levels * rule.bits_per_level)
    # Buckets that are too large for a slice have several parts.
    more = power_of_two(whole >> bits, 8 * rule.max_bytes)
    bucket_bits = bits + more
    part_bits = max(64, whole // (1 << bucket_bits) // 8 * 8)
    held = min(1 << bucket_bits, max(1, 8 * rule.max_bytes // part_bits))
    parts = counts.mapInArrow(
        _build(rule.probes, part_bits, bucket_bits, more), "bucket int, part binary")
    sliced = held < 1 << bucket_bits
    if sliced:
        with short_batches(texts.sparkSession, 8):
            parts = cut_lineage(parts, "filter-parts")
    highest = int(levels(np.array([max(1, n_tokens)]))[0])
    filter_ = Filter(
        _joined(parts, part_bits, 0, held), part_bits, bucket_bits, rule.probes, highest)
    return Model(counts, filter_, n_texts, n_tokens, n_words, parts if sliced else None)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, rows in zip(batch.column(0), batch.column(1)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(words.as_py(), np.int64)),
                 pa.array(np.frombuffer(rows.as_py(), np.int64))], ["word", "rows"])


def word_counts(model: Model) -> DataFrame:
    """Exact counts of the training tokens: word (hash) and rows."""
    return model.counts.select("words", "word_rows").mapInArrow(
        _unpacked, "word long, rows long")


def head_of(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The words with at least so many rows that there are at most ``most`` of them.

    Gives their hashes in order, their rows, and that number of rows (a power of two).
    """
    level = F.floor(F.log2("rows")).cast("int")
    sizes = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    taken, least = 0, 62
    for row in sizes:
        if taken + row["count"] > most:
            break
        taken, least = taken + row["count"], row["level"]
    found = counts.filter(F.col("rows") >= F.lit(1 << least)).toArrow()
    word = np.concatenate([np.zeros(0, np.int64),
                           *(c.to_numpy() for c in found.column("word").chunks)])
    rows = np.concatenate([np.zeros(0, np.int64),
                           *(c.to_numpy() for c in found.column("rows").chunks)])
    order = np.argsort(word)
    return word[order], rows[order], 1 << least


SCORED = pa.struct([
    ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()),
    ("score", pa.float64()),
    ("rest", pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())])))])


def _score_batch(found: list[np.ndarray], filter_: Filter, head: tuple, totals: tuple,
                 weight: float, start: np.uint64) -> pa.StructArray:
    n_texts, n_tokens, n_words = totals
    sizes = np.array([len(f) for f in found])
    flat = np.concatenate(found)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    previous = np.concatenate([[start], flat[:-1]]).astype(np.uint64)
    previous[starts] = start
    words, number = np.unique(flat, return_inverse=True)
    whole = n_tokens + n_words + 1
    # The model: counts from the filter alone.
    single = middle(filter_.level(words))
    pairs, pair_number = np.unique(pair_hashes(previous, flat), return_inverse=True)
    together = middle(filter_.level(pairs))[pair_number]
    after = np.roll(single[number], 1)
    after[starts] = n_texts
    alone = (single[number] + 1) / whole
    chance = (together + weight * alone) / (np.maximum(after, together) + weight)
    score = np.add.reduceat(np.log10(chance), starts)
    # The base: exact counts of the words of the head; the others are handed on.
    keys, rows = head
    signed = words.view(np.int64)
    at = np.searchsorted(keys, signed)
    in_head = np.zeros(len(words), bool)
    inside = at < len(keys)
    in_head[inside] = keys[at[inside]] == signed[inside]
    exact = np.zeros(len(words))
    exact[in_head] = rows[at[in_head]]
    token_head = in_head[number]
    logs = np.where(token_head, np.log10((exact[number] + 1) / whole), 0.0)
    base = np.add.reduceat(logs, starts)
    known = np.add.reduceat(token_head.astype(np.int64), starts)
    text = np.repeat(np.arange(len(found)), sizes)[~token_head]
    rest = np.stack([text, number[~token_head]])
    rest, times = np.unique(rest, axis=1, return_counts=True) if rest.size else (
        rest, np.zeros(0, np.int64))
    ends = np.searchsorted(rest[0], np.arange(len(found) + 1))
    lists = pa.ListArray.from_arrays(
        pa.array(ends, pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(signed[rest[1]]), pa.array(times.astype(np.int64))], ["word", "times"]))
    return pa.StructArray.from_arrays(
        [pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score),
         lists], fields=list(SCORED))


def _score_column(text: Column, shared, totals: tuple, weight: float) -> Column:
    @F.arrow_udf("struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double, "
                 "rest: array<struct<word: bigint, times: bigint>>>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        filter_ = Filter(*shared.value["filter"])
        head, hashes = shared.value["head"], _Hashes()
        start = np.frombuffer(hashes[START], np.uint64)[0]
        give = lambda held: _score_batch(held, filter_, head, totals, weight, start)
        for batch in batches:
            held, size = [], 0
            for value in batch:
                held.append(tokens(value.as_py() or b"", hashes))
                size += len(held[-1])
                if size > FLUSH // 4:
                    yield give(held)
                    held, size = [], 0
            if held:
                yield give(held)

    return scored(text.cast("binary"))


def _looked_up(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with ``levels``, a byte for each token and for each pair.

    Every slice reads the table that the one before has written, which is then removed.
    """
    spark = docs.sparkSession
    current, before = docs.withColumn("levels", F.lit(None).cast("binary")), None
    for slice_ in model.slices():
        shared = spark.sparkContext.broadcast(slice_.fields())
        path = work_folder(spark, "levels")
        found = current.withColumn("levels", _levels_column(shared)(
            F.col("text").cast("binary"), F.col("levels")))
        found.write.parquet(path)
        current = spark.read.schema(found.schema).parquet(path)
        shared.destroy()
        if before:
            remove_folder(spark, before)
        before = path
    return current


def _levels_column(shared):
    @F.arrow_udf("binary")
    def looked(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        filter_, hashes = Filter(*shared.value), _Hashes()
        start = np.frombuffer(hashes[START], np.uint64)[0]

        def give(held, earlier):
            flat = np.concatenate([np.concatenate([f, pair_hashes(before_of(f, start), f)])
                                   for f in held])
            ngrams, number = np.unique(flat, return_inverse=True)
            level = filter_.level(ngrams).astype(np.uint8)[number]
            ends = np.cumsum([2 * len(f) for f in held])[:-1]
            return pa.array([(own if old is None else np.maximum(
                own, np.frombuffer(old, np.uint8))).tobytes()
                for own, old in zip(np.split(level, ends), earlier)], pa.binary())

        for texts, levels_ in batches:
            held, earlier, size = [], [], 0
            for value, old in zip(texts, levels_):
                held.append(tokens(value.as_py() or b"", hashes))
                earlier.append(old.as_py())
                size += len(held[-1])
                if size > FLUSH // 4:
                    yield give(held, earlier)
                    held, earlier, size = [], [], 0
            if held:
                yield give(held, earlier)

    return looked


def _looked(held: list[np.ndarray], found: list[bytes], start: np.uint64) -> Looked:
    """The levels ``found`` for the tokens and pairs of some texts, as a filter gives them."""
    flat = np.concatenate([np.concatenate([f, pair_hashes(before_of(f, start), f)])
                           for f in held])
    ngrams, first = np.unique(flat, return_index=True)
    return Looked(ngrams, np.frombuffer(b"".join(found), np.uint8)[first])


def _sliced_score_column(text: Column, levels_: Column, shared, totals: tuple,
                         weight: float) -> Column:
    @F.arrow_udf("struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double, "
                 "rest: array<struct<word: bigint, times: bigint>>>")
    def scored(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        head, hashes = shared.value, _Hashes()
        start = np.frombuffer(hashes[START], np.uint64)[0]
        give = lambda held, found: _score_batch(
            held, _looked(held, found, start), head, totals, weight, start)
        for texts, levels_ in batches:
            held, found, size = [], [], 0
            for value, level in zip(texts, levels_):
                held.append(tokens(value.as_py() or b"", hashes))
                found.append(level.as_py())
                size += len(held[-1])
                if size > FLUSH // 4:
                    yield give(held, found)
                    held, found, size = [], [], 0
            if held:
                yield give(held, found)

    return scored(text.cast("binary"), levels_)


def score(docs: DataFrame, model: Model, rule: Rule = Rule(), doc_id: str = "doc_id",
          text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row.

    A missing or empty text has one token, its end. Rows may repeat and ids may be missing;
    other columns are not read; an empty table gives an empty one. Without training text
    every count is zero.
    """
    spark = docs.sparkSession
    with short_batches(spark, 8):
        counts = cut_lineage(word_counts(model), "word-counts")
    words, rows, _ = head_of(counts, rule.head)
    totals = (model.n_texts, model.n_tokens, model.n_words)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if model.parts is None:
        shared = spark.sparkContext.broadcast(
            {"filter": model.filter.fields(), "head": (words, rows)})
        marked = named.select(
            "doc_id", _score_column(F.col("text"), shared, totals, rule.weight).alias("s"))
    else:
        shared = spark.sparkContext.broadcast((words, rows))
        marked = _looked_up(named, model).select("doc_id", _sliced_score_column(
            F.col("text"), F.col("levels"), shared, totals, rule.weight).alias("s"))
    with short_batches(spark):
        scored = cut_lineage(
            marked.select("doc_id", "s.*", F.monotonically_increasing_id().alias("row")), "scored")
    rest = scored.select("row", F.inline("rest"))
    exact = rest.join(counts, "word", "left").select(
        "row", "times", F.coalesce("rows", F.lit(0)).alias("rows"))
    whole = float(model.n_tokens + model.n_words + 1)
    added = exact.groupBy("row").agg(
        F.sum(F.when(F.col("rows") > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.col("rows") + 1) / F.lit(whole))).alias("more_base"))
    return scored.drop("rest").join(added, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.n_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        "score")
