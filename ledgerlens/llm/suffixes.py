"""Removal of byte strings that occur elsewhere, by sorted suffixes.

A byte goes if it is covered by a string of ``length`` bytes that also starts anywhere else.

1. Suffixes start at anchors: of the ``span + 1`` strings of ``lead`` bytes in a window of
   ``length`` bytes the one with the smallest hash. Equal windows have the same anchor, so
   no suffix between anchors has to be sorted: about two for each ``span`` bytes are left.
2. Only anchors whose leading bytes occur twice go on. What a window can hold around an
   anchor is its context: ``span`` bytes before it and ``length`` from it on. Equal contexts
   are counted map side and become one; all windows of one that occurs twice are repeated.
   Where all contexts of the same leading bytes do, nothing is left to compare.
3. Sampled splitters range-partition the other suffixes by their leading bytes. A range sorts
   its suffixes, and the reversed contexts before them, by multikey quicksort; from the
   common prefixes of neighbours in both orders follows which windows are equal.
4. Leading bytes that several splitters share fill more than a range, so a boundary would cut
   them. Their windows are compared across the boundaries by longer common strings: windows
   that begin l bytes before the anchor, l from a to b, have length - (b - a) bytes in common,
   which take the place of the leading bytes. Shares that are still too large are cut again,
   down to single windows, which only have to be counted.

Hashes only choose anchors and name contexts (128 bits with the leading bytes); an equality
of windows that are not part of equal contexts is found on the bytes themselves.
"""

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import short_batches, small_side
from ledgerlens.session import cut_lineage

_MIX = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
# The low bits of a hash that give way to the position, so that the leftmost is the smallest.
_PLACE = np.uint64((1 << 24) - 1)
# Strings that are sorted without another partition.
_FEW = 24


@dataclass(frozen=True)
class Rule:
    """length: bytes of a string that may occur only once. lead: leading bytes of a suffix.

    per_range: suffixes a range is meant for. per_splitter: suffixes sampled for each range.
    splitter_bytes: bound of the splitters that travel with the tasks (the sample has
    ``per_splitter`` times as many); beyond 80,000 ranges of 20,000 suffixes ranges grow.
    slice_bytes: bytes of a long text that are hashed at once.
    shares: parts into which windows of a suffix that fills several ranges are cut.
    """

    length: int = 400
    lead: int = 200
    per_range: int = 20_000
    per_splitter: int = 8
    splitter_bytes: int = 32 << 20
    slice_bytes: int = 1 << 20
    shares: int = 4

    @property
    def span(self) -> int:
        """The furthest that a window reaches back from its anchor."""
        return self.length - self.lead


class Hasher:
    """Hashes of substrings from running sums of a polynomial modulo 2^64."""

    def __init__(self, size: int):
        digests = b"".join(hashlib.blake2b(bytes([i]), digest_size=8).digest() for i in range(256))
        self.values = np.frombuffer(digests, "<u8") | np.uint64(1)
        self.powers = self._powers(_BASE, size + 1)
        self.inverse = self._powers(pow(_BASE, -1, 1 << 64), size + 1)

    @staticmethod
    def _powers(base: int, count: int) -> np.ndarray:
        out = np.full(count, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the substrings [begin, end)."""
        value = (sums[end] - sums[begin]) * self.inverse[begin]
        value ^= value >> np.uint64(32)
        value *= _MIX
        return value ^ (value >> np.uint64(29))


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` consecutive values, by running minima of blocks."""
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    last = len(values) - width + 1
    return np.minimum(back[:last], ahead[width - 1 : width - 1 + last])


def anchors(text: bytes, hasher: Hasher, rule: Rule) -> tuple[np.ndarray, ...]:
    """Positions of the anchors, hashes of their leading bytes and of their contexts."""
    size, span = len(text), rule.span
    places, keys, contexts = [], [], []
    for begin in range(0, size - rule.length + 1, rule.slice_bytes):
        # Windows that begin in [begin, end), and what the contexts of their anchors hold.
        end = min(begin + rule.slice_bytes, size - rule.length + 1)
        left, right = max(0, begin - span), min(size, end - 1 + span + rule.length)
        data = np.frombuffer(text, np.uint8, right - left, left)
        sums = hasher.sums(data)
        first = np.arange(begin - left, end - left + span)
        hashes = hasher.of(sums, first, first + rule.lead)
        ranked = (hashes & ~_PLACE) | np.arange(len(first), dtype=np.uint64)
        at = np.unique(window_minima(ranked, span + 1) & _PLACE).astype(np.int64)
        own = first[at]
        low = np.maximum(own - span, 0)
        high = np.minimum(own + rule.length, len(data))
        context = hasher.of(sums, low, high)
        context += ((own - low) * 4096 + (high - own)).astype(np.uint64) * _MIX
        places.append(own + left)
        keys.append(hashes[at].view(np.int64))
        contexts.append(context.view(np.int64))
    # The same anchor can be that of windows on both sides of a slice's end.
    place, once = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(keys)[once], np.concatenate(contexts)[once]


def _mark(rule: Rule, per_row: int = 50_000):
    """Rows of sha, n_bytes and text to rows of sha, n_bytes, part and lists of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(rule.slice_bytes + 2 * rule.length + 2 * rule.span)
        for batch in batches:
            heads, found = [], []
            for sha, size, text in zip(*batch.columns):
                lists = anchors(text.as_buffer().to_pybytes(), hasher, rule)
                for part, at in enumerate(range(0, len(lists[0]), per_row)):
                    heads.append((sha.as_py(), size.as_py(), part))
                    found.append([values[at : at + per_row] for values in lists])
            if not heads:
                continue
            edges = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, pa.array(np.concatenate(values), pa.int64()))
                     for values in zip(*found)]
            sha, size, part = zip(*heads)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sha, pa.string()), pa.array(size, pa.int64()),
                 pa.array(part, pa.int32()), *lists],
                ["sha", "n_bytes", "part", "places", "keys", "contexts"])

    return run


def _contexts(rule: Rule):
    """Rows of text and wanted anchors to rows of suffixes with what is before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "context", "n", "ahead", "back"]
        for batch in batches:
            for text, wanted in zip(*batch.columns):
                text = text.as_buffer().to_pybytes()
                fields = wanted.values
                place = fields.field("place").to_numpy()
                for at in range(0, len(place), 4096):
                    own = place[at : at + 4096].tolist()
                    ahead = [text[p : p + rule.length] for p in own]
                    back = [text[max(0, p - rule.span) : p][::-1] for p in own]
                    kept = [fields.field(name)[at : at + 4096] for name in names[:3]]
                    yield pa.RecordBatch.from_arrays(
                        [*kept, pa.array(ahead, pa.binary()), pa.array(back, pa.binary())], names)

    return run


def multikey_sort(strings: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of bytes: ternary quicksort, eight bytes at a time."""
    words = strings.view(">u8").astype(np.uint64)
    order = np.arange(len(strings))
    rest = [(0, len(strings), 0)]
    while rest:
        begin, end, depth = rest.pop()
        if end - begin < 2 or depth == words.shape[1]:
            continue
        own = order[begin:end]
        if end - begin <= _FEW:
            tails = [row.tobytes() for row in strings[own, 8 * depth :]]
            order[begin:end] = own[sorted(range(len(own)), key=tails.__getitem__)]
            continue
        word = words[own, depth]
        pivot = np.sort(word[[0, len(word) // 2, -1]])[1]
        less, same = word < pivot, word == pivot
        order[begin:end] = np.concatenate([own[less], own[same], own[~(less | same)]])
        middle = begin + int(less.sum())
        last = middle + int(same.sum())
        rest += [(begin, middle, depth), (middle, last, depth + 1), (last, end, depth)]
    return order


def common_prefixes(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it in the order (first: 0)."""
    shared = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 4096):
        own = strings[order[at - 1 : at + 4096]]
        apart = own[1:] != own[:-1]
        first = apart.argmax(axis=1)
        shared[at : at + 4096] = np.where(apart.any(axis=1), first, strings.shape[1])
    return shared


def _padded(strings: list[bytes], width: int) -> np.ndarray:
    width = -(-max(width, 1) // 8) * 8
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings),
                         np.uint8).reshape(len(strings), width)


def repeated_windows(ahead: list[bytes], back: list[bytes], low: int, high: int,
                     length: int) -> tuple[np.ndarray, np.ndarray]:
    """Furthest and nearest begin (bytes before the anchor, -1: none) of repeated windows.

    Each row is an anchor. Windows that begin l bytes before it, l from ``low`` to ``high``,
    are equal if l bytes of the reversed context and length - l of the suffix are.
    """
    furthest, nearest = (np.full(len(ahead), -1, np.int64) for _ in range(2))
    before = np.array([len(s) for s in back])
    behind = np.array([len(s) for s in ahead])
    orders = []
    for strings, width in ((ahead, length - low), (back, high)):
        table = _padded([s[:width] for s in strings], width)
        order = multikey_sort(table)
        orders.append((order, common_prefixes(table, order)))
    codes = np.empty((2, len(ahead)), np.int64)
    for begin in range(low, high + 1):
        for code, (order, shared), needed in zip(codes, orders, (length - begin, begin)):
            code[order] = np.cumsum(shared < needed)
        whole = np.flatnonzero((before >= begin) & (behind >= length - begin))
        if len(whole) < 2:
            continue
        code = codes[0, whole] * (len(ahead) + 1) + codes[1, whole]
        by_code = np.argsort(code, kind="stable")
        same = np.diff(code[by_code]) == 0
        twice = whole[by_code[np.r_[False, same] | np.r_[same, False]]]
        furthest[twice] = begin
        nearest[twice[nearest[twice] < 0]] = begin
    return furthest, nearest


def _lead(rule: Rule) -> F.Column:
    """What all windows of a row have in common: the order that ranges are cut in."""
    return F.concat(F.lpad(F.col("low").cast("string"), 8, "0").cast("binary"),
                    F.expr("substring(back, 1, low)"),
                    F.expr(f"substring(ahead, 1, {rule.length} - high)"))


def _place(splitters: list[bytes]):
    """Adds the range of each row; rows that several splitters are equal to are left out."""
    crossing = set(_repeated(splitters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = batch.column("lead").to_pylist()
            place = [None if s in crossing else bisect_right(splitters, s) for s in lead]
            names = [name for name in batch.schema.names if name != "lead"]
            placed = pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in names), pa.array(place, pa.int32())],
                [*names, "range"])
            yield placed.filter(placed.column("range").is_valid())

    return run


def _repeated(splitters: list[bytes]) -> list[bytes]:
    return sorted({a for a, b in zip(splitters, splitters[1:]) if a == b})


def _solve(rule: Rule):
    """Sorts one range after the other; gives the rows that occur once and have repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            at, ranges = 0, batch.column("range").to_numpy()
            ends = [*(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
            for end in ends:
                if held and held[0].column("range")[0].as_py() != ranges[at]:
                    yield from _solve_range(held, rule)
                    held = []
                if end > at:
                    held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from _solve_range(held, rule)

    return run


def _solve_range(held: list[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(held).combine_chunks()
    lows = rows["low"].to_numpy()
    for low in np.unique(lows):
        own = rows.filter(pa.array(lows == low))
        furthest, nearest = repeated_windows(
            own["ahead"].to_pylist(), own["back"].to_pylist(), int(low), own["high"][0].as_py(),
            rule.length)
        found = (furthest >= 0) & (own["n"].to_numpy() == 1)
        kept = own.select(["key", "context"]).filter(pa.array(found)).combine_chunks()
        for batch in kept.to_batches() if found.any() else ():
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(furthest[found]), pa.array(nearest[found])],
                ["key", "context", "furthest", "nearest"])


FOUND = "key long, context long, furthest long, nearest long"


def _splitters(rows: DataFrame, rule: Rule) -> list[bytes]:
    """Leading bytes that cut the rows into ranges, from a bounded sample."""
    count = rows.count()
    ranges = min(-(-count // rule.per_range), max(2, rule.splitter_bytes // rule.length))
    if ranges < 2:
        return []
    wanted = ranges * rule.per_splitter
    share = min(1.0, 2 * wanted / count)
    sample = rows.select("lead").sample(share, seed=13).orderBy(F.rand(13)).limit(wanted)
    taken = sorted(bytes(row["lead"]) for row in sample.collect())
    return taken[:: rule.per_splitter][1:] if taken else []


def partial_repeats(suffixes: DataFrame, rule: Rule) -> DataFrame:
    """Furthest and nearest begin of repeated windows, of contexts that occur once.

    ``suffixes`` is a written table of key, context, n (rows with that context), ahead and
    back. Every round cuts the strings that fill more than a range into shares.
    """
    rows = suffixes.withColumns({"low": F.lit(0), "high": F.lit(rule.span)})
    results = []
    while True:
        led = rows.withColumn("lead", _lead(rule))
        splitters = _splitters(led, rule)
        placed = led.mapInArrow(
            _place(splitters), f"{_ddl(rows)}, range int")
        ranged = placed.repartition(len(splitters) + 1, "range").sortWithinPartitions("range")
        results.append(cut_lineage(ranged.mapInArrow(_solve(rule), FOUND), "repeats"))
        crossing = _repeated(splitters)
        if not crossing:
            break
        listed = suffixes.sparkSession.createDataFrame(
            [(bytearray(s),) for s in crossing], "lead binary")
        hot = cut_lineage(led.join(F.broadcast(listed), "lead", "left_semi"), "crossing")
        whole, rows = _shares(hot, rule)
        results.append(whole)
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found.groupBy("key", "context").agg(
        F.max("furthest").alias("furthest"), F.min("nearest").alias("nearest"))


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)


def _shares(hot: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Windows of rows with the same lead, cut into shares with a longer lead.

    Gives the rows whose windows in a share are all repeated, since another row has the same
    ones, and the rows that are left to compare, once for each set of windows.
    """
    step = F.greatest(F.lit(1), F.ceil((F.col("high") - F.col("low") + 1) / rule.shares))
    starts = F.sequence(F.col("low"), F.col("high"), step.cast("int"))
    cut = hot.withColumn("_step", step.cast("int")).withColumn("_low", F.explode(starts))
    cut = cut.withColumns({
        "high": F.least(F.col("_low") + F.col("_step") - 1, "high").cast("int"),
        "low": F.col("_low"),
    }).drop("_low", "_step", "lead")
    cut = cut.filter(f"length(back) >= low AND length(ahead) >= {rule.length} - high")
    held = F.concat(F.expr("substring(back, 1, high)"), F.lit(b"|"),
                    F.expr(f"substring(ahead, 1, {rule.length} - low)"),
                    F.length(F.expr("substring(back, 1, high)")).cast("string").cast("binary"))
    cut = cut.withColumns({"lead_no": F.sha2(_lead(rule), 256), "own_no": F.sha2(held, 256)})
    slim = cut.select("key", "context", "n", "low", "high", "lead_no", "own_no",
                      F.length("back").alias("before"), F.length("ahead").alias("behind"))
    slim = cut_lineage(slim, "shares")
    sets = cut_lineage(
        slim.groupBy("lead_no", "own_no").agg(
            F.sum("n").alias("n"), F.min(F.struct("key", "context")).alias("first")), "sets")
    whole = slim.filter("n = 1").join(
        sets.filter("n > 1").select("lead_no", "own_no"), ["lead_no", "own_no"]).select(
        "key", "context", F.least("high", "before").cast("long").alias("furthest"),
        F.greatest("low", rule.length - F.col("behind")).cast("long").alias("nearest"))
    open_ = sets.groupBy("lead_no").agg(
        F.count(F.lit(1)).alias("sets"), F.count_if(F.col("n") == 1).alias("single")
    ).filter("sets > 1 AND single > 0").select("lead_no")
    chosen = sets.join(open_, "lead_no", "left_semi").select(
        "lead_no", "own_no", F.col("n").alias("_n"), "first.*")
    left = cut.drop("n").join(chosen, ["lead_no", "own_no", "key", "context"])
    names = ["key", "context", F.col("_n").alias("n"), "ahead", "back", "low", "high"]
    return whole, cut_lineage(left.select(*names), "left")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sha, text and repeated intervals to what is removed and what stays."""
    for batch in batches:
        rows = []
        for sha, text, repeats in zip(*batch.columns):
            data = text.as_buffer().to_pybytes()
            fields = repeats.values
            begin, end = (fields.field(name).to_numpy() for name in ("begin", "end"))
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], np.maximum.accumulate(end[order])
            starts = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]])
            begin, end = begin[starts], end[np.r_[starts[1:] - 1, len(end) - 1]]
            kept, at = hashlib.sha256(), 0
            for first, last in zip(begin.tolist(), end.tolist()):
                kept.update(data[at:first])
                at = last
            kept.update(data[at:])
            rows.append((sha.as_py(), int((end - begin).sum()), len(begin), kept.hexdigest()))
        if rows:
            sha, removed, spans, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sha), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(kept)], ["sha", "n_removed", "n_spans", "kept_sha256"])


def marks(marked: DataFrame) -> DataFrame:
    """part_no, place, key and context of the anchors whose leading bytes occur twice."""
    every = marked.select("part_no", F.inline(F.arrays_zip("places", "keys", "contexts"))).select(
        "part_no", F.col("places").alias("place"), F.col("keys").alias("key"),
        F.col("contexts").alias("context"))
    twice = every.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    # An exchange of its own, so that adaptive execution can split a key with very many rows.
    return every.join(twice.select("key").hint("rebalance"), "key", "left_semi")


def repeats(texts: DataFrame, marked: DataFrame, rule: Rule) -> DataFrame:
    """sha and repeated intervals (begin, end) of the texts that occur in one row only.

    ``texts`` has sha and text, ``marked`` is a written table of anchors by text and part.
    """
    chosen = cut_lineage(marks(marked), "marks")
    classes = cut_lineage(
        chosen.groupBy("key", "context").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("part_no", "place")).alias("first")),
        "contexts")
    open_ = classes.groupBy("key").agg(F.count_if(F.col("n") == 1).alias("single"),
                                       F.count(F.lit(1)).alias("contexts"))
    asked = open_.filter("single > 0 AND contexts > 1").select("key").hint("rebalance")
    compared = classes.join(asked, "key", "left_semi").select("key", "context", "n", "first.*")
    parts = marked.select("part_no", "sha", "n_bytes", "copies")
    wanted = cut_lineage(
        compared.join(parts, "part_no").groupBy("sha").agg(
            F.collect_list(F.struct("place", "key", "context", "n")).alias("wanted")), "wanted")
    once = texts.join(small_side(wanted.select("sha")), "sha", "left_semi").dropDuplicates(["sha"])
    held = once.join(wanted, "sha").select(F.col("text").cast("binary"), "wanted").mapInArrow(
        _contexts(rule), "key long, context long, n long, ahead binary, back binary")
    with short_batches(texts.sparkSession):
        suffixes = cut_lineage(held, "suffixes")
    partly = partial_repeats(suffixes, rule)
    fully = classes.filter("n > 1").select(
        "key", "context", F.lit(rule.span).cast("long").alias("furthest"),
        F.lit(0).cast("long").alias("nearest"))
    covered = chosen.join(fully.unionByName(partly), ["key", "context"])
    begin = F.greatest(F.lit(0), F.col("place") - F.col("furthest"))
    end = F.least("n_bytes", F.col("place") + rule.length - F.col("nearest"))
    return covered.join(parts.filter("copies = 1"), "part_no").groupBy("sha").agg(
        F.collect_list(F.struct(begin.alias("begin"), end.alias("end"))).alias("repeats"))


def remove_repeats(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A missing text counts as empty, and texts of fewer than ``length`` bytes keep all of
    theirs. Of texts of ``length`` bytes or more that occur in several rows nothing stays in
    any of them. Rows with the same or no doc_id come back as they are, other columns are
    left alone, and an empty table gives an empty one.
    """
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    base = base.withColumns({"sha": F.sha2("text", 256),
                             "n_bytes": F.octet_length("text").cast("long")})
    long = base.filter(F.col("n_bytes") >= rule.length)
    texts = long.select("sha", "text")
    lists = ("places", "keys", "contexts")
    found = long.select("sha", "n_bytes", F.col("text").cast("binary")).mapInArrow(
        _mark(rule), "sha string, n_bytes long, part int, places array<long>, "
        "keys array<long>, contexts array<long>")
    each = found.groupBy("sha", "part").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"),
        *[F.first(name).alias(name) for name in lists])
    with short_batches(docs.sparkSession):
        marked = cut_lineage(
            each.withColumn("part_no", F.monotonically_increasing_id()), "anchors")
    touched = cut_lineage(repeats(texts, marked, rule), "intervals")
    changed = texts.join(small_side(touched.select("sha")), "sha", "left_semi").join(
        touched, "sha").select("sha", F.col("text").cast("binary"), "repeats").mapInArrow(
        _cut, "sha string, n_removed long, n_spans long, kept_sha256 string")
    gone = marked.filter("copies > 1 AND part = 0").select(
        "sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"),
        F.sha2(F.lit(""), 256).alias("kept_sha256"))
    with short_batches(docs.sparkSession):
        verdicts = cut_lineage(gone.unionByName(changed), "verdicts")
    nothing = F.lit(0).cast("long")
    return base.select("doc_id", "sha", "n_bytes").join(verdicts, "sha", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", nothing).alias("n_removed"),
        F.coalesce("n_spans", nothing).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
