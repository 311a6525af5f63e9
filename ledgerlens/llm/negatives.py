"""Hard negatives of anchors by slots of scores.

Anchors are compared with all rows, a bounded block of anchors at a time. An anchor's
positives are its best rows of the same label; a positive with score p has the window of
scores from ``low`` * p to ``high`` * p (in hundredths), and wants the best rows of other
labels in it.

1. A pass over the rows keeps the best rows of the same label of each anchor, per task, and
   merges them.
2. The upper limits of an anchor's positives cut the scores into disjoint slots. A second
   pass keeps, per task, the best rows of other labels of each slot; what windows cannot
   hold is left out. Windows overlap, but each row is held by one slot only.
3. Slots are merged. In descending order a window is the slots from its upper limit on, so
   the best of a window are the first of that suffix, down to its lower limit.

Blocks of anchors go to the tasks by broadcast, one block at a time, so a task holds one
block whatever the number of anchors.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage

# Sums of products below this are exact as doubles.
_EXACT = 2.0**53
_LOWEST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Rule:
    """anchors_every: rows whose id it divides are anchors.

    scale: components become floor(scale * x). positives, negatives: how many are kept. low,
    high: hundredths of a positive's score. block: anchors that are compared at a time, about.
    chunk: rows that a task compares at a time. pending: finds that a task merges at a time.
    """

    anchors_every: int = 50
    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    block: int = 4_096
    chunk: int = 256
    pending: int = 200_000


def usable(rows: DataFrame, rule: Rule, vec_id: str = "vec_id", vector: str = "embedding",
           label: str = "label") -> DataFrame:
    """vec_id, label and vector (of whole numbers) of the rows that take part.

    Left out are rows without an id, a label or a vector, with a component that is null or
    not finite, and with components so large that an inner product might not be a long.
    """
    named = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
                        F.col(f"`{label}`").cast("long").alias("label"),
                        F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    limit = F.sqrt(F.lit(2.0**62) / F.greatest(F.lit(1), F.size("vector"))) - 2
    fits = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) * rule.scale < limit))
    whole = F.transform("vector", lambda x: F.floor(x * rule.scale))
    taking = named.filter("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return taking.filter(F.coalesce(fits, F.lit(False))).withColumn("vector", whole)


def _matrix(lists: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each width."""
    edges = lists.offsets.to_numpy()
    values = lists.values.to_numpy()
    widths = np.diff(edges)
    out = []
    for width in np.unique(widths):
        place = np.flatnonzero(widths == width)
        at = edges[place][:, None] + np.arange(width)[None, :]
        out.append((place, values[at]))
    return out


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers, exact."""
    most = (np.abs(left).max(initial=0).astype(float) * np.abs(right).max(initial=0)
            * max(1, left.shape[1]))
    if most < _EXACT:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    return left @ right.T


class Best:
    """The best rows by group: highest score, then smallest id; at most ``count`` of each.

    ``least`` is the lowest score that a group still takes.
    """

    def __init__(self, groups: int, count: int, pending: int):
        self.count, self.pending = count, pending
        self.least = np.full(groups, _LOWEST)
        self.held = np.empty((3, 0), np.int64)
        self.new: list[np.ndarray] = []

    def add(self, group: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        taken = score >= self.least[group]
        self.new.append(np.stack([group, score, row_id])[:, taken])
        if sum(found.shape[1] for found in self.new) > self.pending:
            self.merge()

    def merge(self) -> np.ndarray:
        joined = np.concatenate([self.held, *self.new], axis=1)
        joined = joined[:, np.lexsort((joined[2], -joined[1], joined[0]))]
        first = np.flatnonzero(np.diff(joined[0], prepend=_LOWEST))
        sizes = np.diff(np.r_[first, joined.shape[1]])
        rank = np.arange(joined.shape[1]) - np.repeat(first, sizes)
        last = joined[:, rank == self.count - 1]
        self.least[last[0]] = last[1]
        self.held, self.new = joined[:, rank < self.count], []
        return self.held


@dataclass(frozen=True)
class Block:
    """Anchors: id, label, vector and, in the second pass, limits of the slots.

    upper: (anchors, slots) highest scores of the slots, descending; a slot reaches down to
    above the next upper limit, the last one to ``least``. Unused slots have the lowest long.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]
    upper: np.ndarray | None = None
    least: np.ndarray | None = None

    @property
    def slots(self) -> int:
        return 1 if self.upper is None else self.upper.shape[1]


def _same_label(best: Best, block: Block, place, found, ids, labels) -> None:
    """Rows of the label of the anchors at ``place``, by anchor."""
    chosen = (labels[None, :] == block.labels[place][:, None]) & (
        ids[None, :] != block.ids[place][:, None]) & (found >= best.least[place][:, None])
    row, column = np.nonzero(chosen)
    best.add(place[row], found[row, column], ids[column])


def _other_labels(best: Best, block: Block, place, found, ids, labels) -> None:
    """Rows of other labels, by the slot of their score."""
    upper = block.upper[place]
    chosen = (labels[None, :] != block.labels[place][:, None]) & (
        found <= upper[:, :1]) & (found >= block.least[place][:, None])
    row, column = np.nonzero(chosen)
    score = found[row, column]
    slot = (score[:, None] <= upper[row]).sum(axis=1) - 1
    best.add(place[row] * block.slots + slot, score, ids[column])


def _compare(shared, rule: Rule):
    """Rows to the best of each anchor (first pass) or of each anchor's slots (second)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        first = block.upper is None
        best = Best(len(block.ids) * block.slots, rule.positives if first else rule.negatives,
                    rule.pending)
        take = _same_label if first else _other_labels
        for batch in batches:
            for at in range(0, batch.num_rows, rule.chunk):
                part = batch.slice(at, rule.chunk)
                ids, labels = (part.column(name).to_numpy() for name in ("vec_id", "label"))
                by_width = {m.shape[1]: (p, m) for p, m in _matrix(part.column("vector"))}
                for place, matrix in block.vectors:
                    if matrix.shape[1] in by_width:
                        own, rows = by_width[matrix.shape[1]]
                        take(best, block, place, scores(matrix, rows), ids[own], labels[own])
        group, score, row_id = best.merge()
        yield pa.RecordBatch.from_arrays(
            [pa.array(block.ids[group // block.slots]),
             pa.array((group % block.slots).astype(np.int32)), pa.array(score),
             pa.array(row_id)], ["anchor_id", "slot", "score", "vec_id"])

    return run


SCHEMA = "anchor_id long, slot int, score long, vec_id long"


def _first(found: DataFrame, count: int) -> DataFrame:
    """The best of all tasks, by anchor and slot."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= count)


def _limits(score: Column, rule: Rule) -> tuple[Column, Column]:
    """Lowest and highest score of the window of a positive."""
    low = F.ceil(score.cast("decimal(38,0)") * rule.low / 100).cast("long")
    high = F.floor(score.cast("decimal(38,0)") * rule.high / 100).cast("long")
    return low, high


def _blocks(anchors: DataFrame, rule: Rule) -> Iterator[list]:
    """Bounded blocks of the rows of a written table of distinct ids, by a hash."""
    count = math.ceil(anchors.count() / (0.9 * rule.block))
    for number in range(count):
        own = F.pmod(F.xxhash64("vec_id"), F.lit(count)) == number
        yield anchors.filter(own).orderBy("vec_id").collect()


def _block(rows: list, upper=None, least=None) -> Block:
    ids, labels = (np.array([row[name] for row in rows], np.int64) for name in ("vec_id", "label"))
    vectors = _matrix(pa.array([row["vector"] for row in rows], pa.list_(pa.int64())))
    return Block(ids, labels, vectors, upper, least)


def positives(rows: DataFrame, block: Block, rule: Rule) -> DataFrame:
    """anchor_id, positive_id, positive_score and the limits of its window."""
    shared = rows.sparkSession.sparkContext.broadcast(block)
    found = _first(rows.mapInArrow(_compare(shared, rule), SCHEMA), rule.positives)
    low, high = _limits(F.col("score"), rule)
    return cut_lineage(found.select(
        "anchor_id", F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"), low.alias("low"), high.alias("high")),
        "positives")


def slots_of(block: Block, limits: list, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Upper limits of the slots of each anchor, and the least score any window takes.

    ``limits`` has a row per anchor and positive with a window that can hold a score.
    """
    place = {int(row_id): k for k, row_id in enumerate(block.ids)}
    upper = np.full((len(block.ids), rule.positives), _LOWEST)
    least = np.full(len(block.ids), np.iinfo(np.int64).max, np.int64)
    by_anchor: dict[int, set] = {}
    for row in limits:
        k = place[row["anchor_id"]]
        by_anchor.setdefault(k, set()).add(row["high"])
        least[k] = min(least[k], row["low"])
    for k, highs in by_anchor.items():
        upper[k, : len(highs)] = sorted(highs, reverse=True)
    return upper, least


def answers(wanted: DataFrame, slots: DataFrame, rule: Rule) -> DataFrame:
    """The best negatives of each window from the best of the anchor's slots.

    ``slots`` has at most positives x negatives rows an anchor, so they fit into one array.
    In descending order, the rows from a window's upper limit on are its slots and the lower
    ones.
    """
    entry = F.struct((-F.col("score")).alias("less"), "vec_id", "score")
    held = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(entry)).alias("held"))
    joined = wanted.join(held, "anchor_id")
    suffix = F.filter("held", lambda x: x["score"] <= F.col("high"))
    best = F.filter(F.slice(suffix, 1, rule.negatives), lambda x: x["score"] >= F.col("low"))
    return joined.select("anchor_id", "positive_id", "positive_score",
                         F.posexplode(best).alias("rank", "negative")).select(
        "anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"),
        F.col("negative.vec_id").alias("negative_id"), "positive_score",
        F.col("negative.score").alias("negative_score"))


def hard_negatives(rows: DataFrame, rule: Rule = Rule(), vec_id: str = "vec_id",
                   vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Rows that :func:`usable` leaves out take no part. Of rows with the same id that with the
    smallest label, then vector, takes part. Only vectors of the same width are compared.
    Other columns are left alone; a table without anchors, or empty, gives an empty one.
    """
    taking = usable(rows, rule, vec_id, vector, label)
    first = F.min(F.struct("label", "vector")).alias("first")
    held = cut_lineage(taking.groupBy("vec_id").agg(first).select("vec_id", "first.*"), "vectors")
    anchors = cut_lineage(held.filter(F.col("vec_id") % rule.anchors_every == 0), "anchors")
    spark = rows.sparkSession
    found = spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, "
        "positive_score long, negative_score long")
    for listed in _blocks(anchors, rule):
        if not listed:
            continue
        wanted = positives(held, _block(listed), rule)
        able = wanted.filter("low <= high")
        shared = spark.sparkContext.broadcast(
            _block(listed, *slots_of(_block(listed), able.collect(), rule)))
        slots = _first(held.mapInArrow(_compare(shared, rule), SCHEMA), rule.negatives)
        found = found.unionByName(cut_lineage(answers(able, slots, rule), "negatives"))
    return found
