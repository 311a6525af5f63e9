"""Boosted trees whose rounds read packed bins.

Spark's trees keep an integer for each input of a row, read all rows for each level of each
tree, and add every input of a row to four totals one by one. Here inputs are binned by the
same thresholds and packed, several to a number of 16 bits; numpy adds up a pack at a time,
and only the rows of the smaller half of each split are added up: the other half is what is
left of the totals of both. The trees are Spark's, and so is the model that comes out.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, SparkContext, StorageLevel, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import CHECKPOINT_DIR, remove_folder, work_folder

# Functions travel to the executors with their tasks, so the package need not be there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Cells of a pack: the bins of its inputs, multiplied. Totals of a pack stay in the near caches.
CELLS = 1024
# Rows that a worker looks at together, and rows that a task of a pass reads at most.
BLOCK_ROWS = 131_072
PASS_ROWS = 4_000_000
# Thresholds come from a sample of so many rows, as Spark's do (or the square of the bins).
SAMPLED = 10_000
# Rows that are added up at a time: their numbers stay in the near caches.
CHUNK_ROWS = 32_768
# Totals of packs with so large a chance of the same cell in two rows are kept in so many lanes,
# so that a sum need not wait for the one before.
LANES, LANED_SKEW = 4, 0.05
# Gains below this share of the mean square are what rounding leaves of equal totals.
ROUNDING = 1e-12
# Trees after which the margins are written to the checkpoint folder.
KEPT_ROUNDS = 10
# Partial totals that come to the driver without being added up before.
DIRECT_TASKS = 64
ROOT = 1
# The totals of a bin: rows, weight, weighted target, weighted square of the target.
ROWS, WEIGHT, TARGET, SQUARE = range(4)


class BoostedTrees(GBTClassifier):
    """Spark's classifier, with rounds of its own where all rows and inputs enter each tree.

    With held-out rows, bags, subsets of inputs or bounds on the rows of a leaf, Spark trains.
    """

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        rows = dataset.count() if _covered(self) else 0
        if not rows:
            return super()._fit(dataset)
        inputs, categories = _inputs(dataset, self.getFeaturesCol())
        if any(arity > min(self.getMaxBins(), rows) for arity in categories.values()):
            return super()._fit(dataset)
        trained = _train(self, dataset, rows, inputs, categories)
        return self._copyValues(_model(self, trained, inputs))


def _covered(trees: GBTClassifier) -> bool:
    return (
        not trees.isDefined(trees.validationIndicatorCol)
        and trees.getSubsamplingRate() == 1.0
        and trees.getFeatureSubsetStrategy() == "all"
        and trees.getMinInstancesPerNode() == 1
        and trees.getMinWeightFractionPerNode() == 0.0
        and trees.getMaxBins() <= CELLS
    )


def _inputs(dataset: DataFrame, features: str) -> tuple[int, dict[int, int]]:
    """The number of inputs, and of the categories of those that have some."""
    known = dataset.schema[features].metadata.get("ml_attr", {})
    groups = known.get("attrs", {})
    categories = {attr["idx"]: 2 for attr in groups.get("binary", [])}
    for attr in groups.get("nominal", []):
        count = len(attr["vals"]) if "vals" in attr else attr.get("num_vals")
        if count:
            categories[attr["idx"]] = count
    size = known.get("num_attrs") or sum(map(len, groups.values()))
    return size or dataset.select(features).first()[0].size, categories


# -- bins and packs ----------------------------------------------------------------


def thresholds_of(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between values, about the same weight apart."""
    found, place = np.unique(values, return_inverse=True)
    if len(found) - 1 <= most:
        return (found[:-1] + found[1:]) / 2
    held = np.bincount(place, weights)
    stride = weights.sum() / (most + 1)
    chosen, before, wanted = [], held[0], stride
    for index in range(1, len(found)):
        after = before + held[index]
        if abs(before - wanted) < abs(after - wanted):
            chosen.append((found[index - 1] + found[index]) / 2)
            wanted += stride
        before = after
    return np.array(chosen)


def _skew(bins: np.ndarray) -> float:
    """The chance that two rows have the same bin."""
    counts = np.unique(bins, return_counts=True)[1]
    return float(((counts / len(bins))**2).sum())


@dataclass(frozen=True)
class Layout:
    """Bins of each input, and which inputs share a pack.

    ``thresholds`` has None for an input whose values are its categories. ``skew`` is the
    chance that two rows have the same bin: even inputs share a pack with skewed ones, since
    adding to the same cell again and again has to wait for the sum before.
    """

    thresholds: list[np.ndarray | None]
    arities: list[int]
    skew: list[float]
    groups: list[list[int]] = field(init=False)

    def __post_init__(self):
        # An input that is the same in all rows decides nothing.
        left = sorted((i for i, size in enumerate(self.arities) if size > 1),
                      key=lambda i: self.skew[i]) or [0]
        groups = []
        while left:
            group = [left.pop(0)]
            size = self.arities[group[0]]
            for one in reversed(left[:]):
                if size * self.arities[one] <= CELLS:
                    group.append(one)
                    left.remove(one)
                    size *= self.arities[one]
            groups.append(group)
        object.__setattr__(self, "groups", groups)

    def shape(self, group: int) -> tuple[int, ...]:
        return tuple(self.arities[one] for one in self.groups[group])

    def lanes(self, group: int) -> int:
        return LANES if math.prod(self.skew[i] for i in self.groups[group]) > LANED_SKEW else 1

    def starts(self) -> np.ndarray:
        """Where the bins of each input begin among all bins, and how many those are."""
        return np.concatenate([[0], np.cumsum(self.arities)]).astype(int)

    def pack(self, x: np.ndarray) -> np.ndarray:
        """A row of numbers for each pack, of a matrix with a row for each input."""
        packed = np.zeros((len(self.groups), x.shape[1]), np.uint16)
        for group, members in enumerate(self.groups):
            for one in members:
                limits = self.thresholds[one]
                if limits is None:
                    bins = x[one].astype(np.int64)
                    if np.any(bins != x[one]) or bins.min() < 0 or bins.max() >= self.arities[one]:
                        raise ValueError(f"input {one} has values that are no categories")
                else:
                    bins = np.searchsorted(limits, x[one])
                packed[group] = packed[group] * self.arities[one] + bins.astype(np.uint16)
        return packed

    def unpacked(self, totals: list[np.ndarray]) -> np.ndarray:
        """Totals by cell of each pack as totals by bin of each input."""
        starts = self.starts()
        leading = totals[0].shape[:-1]
        found = np.zeros((*leading, starts[-1]))
        for group, members in enumerate(self.groups):
            cells = totals[group].reshape(*leading, *self.shape(group))
            axes = range(len(leading), cells.ndim)
            for place, one in enumerate(members):
                others = tuple(a for a in axes if a != len(leading) + place)
                found[..., starts[one]:starts[one + 1]] = cells.sum(axis=others)
        return found

    def side(self, split: Split) -> tuple[int, np.ndarray]:
        """The pack that decides a split, and which of its cells go left."""
        for group, members in enumerate(self.groups):
            if split.input in members:
                break
        shape = self.shape(group)
        place = members.index(split.input)
        bins = np.arange(math.prod(shape)) // math.prod(shape[place + 1:]) % shape[place]
        return group, split.left[bins]


@dataclass(frozen=True)
class Split:
    """An input and which of its bins go left."""

    input: int
    left: np.ndarray
    gain: float


# -- in the workers ------------------------------------------------------------------


def _packed(layout: Layout) -> Callable:
    """Batches of rows as blocks: a row each of packs, signs of the labels and weights."""
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            x, w, y = _numbers(batch, len(layout.arities))
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("labels must be 0 or 1")
            if not (np.isfinite(w) & (w >= 0)).all():
                raise ValueError("weights must be finite and not negative")
            if not np.isfinite(x).all():
                raise ValueError("inputs must be finite numbers")
            held.append((layout.pack(np.ascontiguousarray(x.T)), (2 * y - 1).astype(np.int8), w))
            size += len(w)
            if size >= BLOCK_ROWS:
                yield _stored(held)
                held, size = [], 0
        if size:
            yield _stored(held)
    return pack


def _numbers(table: pa.RecordBatch | pa.Table, inputs: int) -> list[np.ndarray]:
    """Columns as arrays, the first one, of arrays, as a matrix."""
    vectors, *others = table.columns
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if np.any(np.diff(vectors.offsets) != inputs):
        raise ValueError(f"rows must have {inputs} inputs")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return [flat.reshape(-1, inputs), *(np.asarray(other, float) for other in others)]


def _stored(held: list[tuple]) -> pa.RecordBatch:
    parts = [np.concatenate(part, axis=-1).tobytes() for part in zip(*held)]
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.binary()) for part in parts], ["packs", "signs", "weights"])


def _block(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    signs, weights = np.frombuffer(row["signs"], np.int8), np.frombuffer(row["weights"])
    return np.frombuffer(row["packs"], np.uint16).reshape(-1, len(signs)), signs, weights


def _nodes(packed: np.ndarray, sides: dict[int, tuple]) -> dict[int, np.ndarray | None]:
    """The rows of the nodes that are not split; None stands for all rows."""
    rows: dict[int, np.ndarray | None] = {ROOT: None}
    for node in sorted(sides):
        group, left = sides[node]
        inside = rows.pop(node)
        if inside is None:
            goes = left[packed[group]]
            rows[2 * node], rows[2 * node + 1] = np.flatnonzero(goes), np.flatnonzero(~goes)
        else:
            goes = left[packed[group].take(inside)]
            rows[2 * node], rows[2 * node + 1] = inside[goes], inside[~goes]
    return rows


def _margins(layout: Layout, tree: dict[int, Split], values: dict[int, float]) -> Callable:
    """Margins with what a tree adds to them; of blocks, or of blocks and the margins before."""
    def add(pair: tuple) -> np.ndarray:
        (packed, signs, _), before = pair if isinstance(pair[0], tuple) else (pair, None)
        margins = np.zeros(len(signs)) if before is None else before.copy()
        sides = {node: layout.side(split) for node, split in tree.items()}
        for node, inside in _nodes(packed, sides).items():
            if inside is None:
                margins += values[node]
            else:
                margins[inside] += values[node]
        return margins
    return add


def _residuals(signs: np.ndarray, margins: np.ndarray) -> np.ndarray:
    """Minus the slope of the logistic loss; far on the wrong side it is 4."""
    with np.errstate(over="ignore"):
        return 4.0 * signs / (1.0 + np.exp(2.0 * signs * margins))


def _totals(layout: Layout, tree: dict[int, Split], wanted: list[int], kinds: list[int]) -> Callable:
    """Totals of some kinds by node and bin of the wanted nodes, one array for a task."""
    def add_up(pairs: Iterable) -> Iterator[np.ndarray]:
        sides = {node: layout.side(split) for node, split in tree.items()}
        groups = range(len(layout.groups))
        sizes = [math.prod(layout.shape(group)) for group in groups]
        lanes = [layout.lanes(group) for group in groups]
        places = [np.arange(CHUNK_ROWS) % lanes[group] * sizes[group] for group in groups]
        sums = [np.zeros((len(wanted), len(kinds), lanes[g] * sizes[g])) for g in groups]
        for pair in pairs:
            (packed, signs, weights), margins = pair if isinstance(pair[0], tuple) else (pair, None)
            target = signs.astype(float) if margins is None else _residuals(signs, margins)
            first = weights * target
            values = {ROWS: None, WEIGHT: weights, TARGET: first, SQUARE: first * target}
            rows = _nodes(packed, sides)
            for place, node in enumerate(wanted):
                inside = rows[node]
                for begin in range(0, len(signs) if inside is None else len(inside), CHUNK_ROWS):
                    chunk = slice(begin, begin + CHUNK_ROWS)
                    if inside is not None:
                        chunk = inside[chunk]
                    parts = [None if values[kind] is None else values[kind][chunk] for kind in kinds]
                    for group in groups:
                        cells = packed[group][chunk].astype(np.intp)
                        if lanes[group] > 1:
                            cells += places[group][:len(cells)]
                        total = sums[group][place]
                        for kind, part in enumerate(parts):
                            total[kind] += np.bincount(cells, part, total.shape[1])
        yield layout.unpacked([
            total.reshape(*total.shape[:2], lanes[group], sizes[group]).sum(axis=2)
            for group, total in enumerate(sums)])
    return add_up


# -- on the driver ---------------------------------------------------------------------


@dataclass
class Node:
    """Totals of a node's rows, and how it is split if it is."""

    totals: np.ndarray
    split: Split | None = None

    @property
    def value(self) -> float:
        return self.totals[TARGET] / self.totals[WEIGHT] if self.totals[WEIGHT] > 0 else 0.0

    @property
    def mean_square(self) -> float:
        return self.totals[SQUARE] / self.totals[WEIGHT] if self.totals[WEIGHT] > 0 else 0.0

    @property
    def impurity(self) -> float:
        return max(0.0, self.mean_square - self.value**2)

    @property
    def pure(self) -> bool:
        return self.impurity <= ROUNDING * self.mean_square


def best_split(layout: Layout, bins: np.ndarray, node: Node, least: float) -> tuple | None:
    """The split with the largest gain and the totals of its left side, None without a gain.

    Bins of categories are put in the order of their mean targets.
    """
    starts, size = layout.starts(), max(layout.arities)
    place = starts[:-1, None] + np.arange(size)
    place[np.arange(size) >= np.array(layout.arities)[:, None]] = starts[-1]  # a bin of nothing
    each = np.concatenate([bins, np.zeros((4, 1))], axis=1)[:, place]
    order = np.broadcast_to(np.arange(size), place.shape).copy()
    named = [one for one, limits in enumerate(layout.thresholds) if limits is None]
    if named:
        weight = each[WEIGHT, named]
        means = np.divide(each[TARGET, named], weight, where=weight > 0,
                          out=np.full(weight.shape, np.inf))
        order[named] = np.argsort(means, axis=1, kind="stable")
        each = np.take_along_axis(each, order[None], axis=2)
    left = np.cumsum(each, axis=2)
    right = left[:, :, -1:] - left
    both = (left[ROWS] > 0) & (right[ROWS] > 0) & (left[WEIGHT] > 0) & (right[WEIGHT] > 0)
    # What the left side has more than its share; the right side has as much less.
    more = left[TARGET] - node.value * left[WEIGHT]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = more**2 * (1 / left[WEIGHT] + 1 / right[WEIGHT]) / node.totals[WEIGHT]
    gain = np.where(both, gain, -1.0)
    one, last = np.unravel_index(np.argmax(gain), gain.shape)
    found = float(gain[one, last])
    if found <= ROUNDING * node.mean_square or found < least:
        return None
    goes = np.zeros(layout.arities[one], bool)
    goes[order[one, :last + 1]] = True
    return Split(int(one), goes, found), left[:, one, last]


def _grown(layout: Layout, summed: Callable, depth: int, least: float) -> dict[int, Node]:
    """One tree, level by level; ``summed`` reads the rows for the totals by bin."""
    bins = {ROOT: summed({}, [ROOT])[0]}
    first = bins[ROOT][:, slice(*layout.starts()[[layout.groups[0][0], layout.groups[0][0] + 1]])]
    nodes = {ROOT: Node(first.sum(axis=1))}
    for level in range(depth):
        tree = {number: node.split for number, node in nodes.items() if node.split}
        pairs = []
        for number in sorted(bins):
            found = None if nodes[number].pure else best_split(
                layout, bins[number], nodes[number], least)
            if not found:
                continue
            nodes[number].split, left = found
            tree[number] = nodes[number].split
            nodes[2 * number] = Node(left)
            nodes[2 * number + 1] = Node(nodes[number].totals - left)
            pairs.append((number, 2 * number, 2 * number + 1))
        if level + 1 == depth:
            break
        open_pairs = [(above, *sorted(two, key=lambda n: nodes[n].totals[ROWS]))
                      for above, *two in pairs if not all(nodes[n].pure for n in two)]
        if not open_pairs:
            break
        less = [small for _, small, _ in open_pairs]
        sums = summed(tree, less)
        below = {}
        for (above, small, large), found in zip(open_pairs, sums):
            rest = bins[above] - found
            rest[1:, rest[ROWS] == 0] = 0  # nothing is left there, whatever rounding says
            below[small], below[large] = found, rest
        bins = below
    return nodes


def _single(rdd: RDD) -> RDD:
    """Items pickled one by one, so that tables can be put side by side as they are stored."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _fixed(dataset: DataFrame) -> DataFrame:
    """The same rows, whose exchange is made once and not for each use."""
    session, query = dataset.sparkSession, dataset._jdf.queryExecution()
    found = session._jsparkSession.internalCreateDataFrame(query.toRdd(), dataset._jdf.schema(), False)
    return DataFrame(found, session)


def _checkpoints(dataset: DataFrame) -> None:
    """Sees to it that the context has a checkpoint folder."""
    spark = dataset.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        work_folder(spark, "boosting")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get(CHECKPOINT_DIR))


def _train(trees: GBTClassifier, dataset: DataFrame, rows: int, inputs: int,
           categories: dict[int, int]) -> tuple[Layout, list[dict[int, Node]], list[float]]:
    spark, context = dataset.sparkSession, dataset.sparkSession.sparkContext
    _checkpoints(dataset)
    weight = trees.isDefined(trees.weightCol) and trees.getWeightCol()
    table = _fixed(dataset).select(
        vector_to_array(trees.getFeaturesCol()).alias("x"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        F.col(trees.getLabelCol()).cast("double").alias("y"))
    share = max(trees.getMaxBins()**2, SAMPLED) / rows
    picked = table.sample(share, trees.getSeed()) if share < 1 else table
    x, w = _numbers(picked.select("x", "w").toArrow(), inputs)
    most = min(trees.getMaxBins(), rows) - 1
    limits = [None if one in categories else thresholds_of(x[:, one], w, most)
              for one in range(inputs)]
    layout = Layout(
        limits, [categories[i] if t is None else len(t) + 1 for i, t in enumerate(limits)],
        [_skew(x[:, i] if t is None else np.searchsorted(t, x[:, i]))
         for i, t in enumerate(limits)])

    constant: list[np.ndarray] = []
    held: list[RDD] = []
    written: list[RDD] = []

    def keep(rdd: RDD, write: bool) -> RDD:
        held.append(_single(rdd).persist(StorageLevel.MEMORY_AND_DISK_DESER))
        if write:
            held[-1].checkpoint()
            written.append(held[-1])
        return held[-1]

    def drop(*done: RDD) -> None:
        for kept in done:
            held.remove(kept)
            kept.unpersist()

    def remove(*done: RDD) -> None:
        """Margins that are not written go back to the last written ones, so those stay."""
        for kept in done:
            written.remove(kept)
            if kept.isCheckpointed():
                remove_folder(spark, kept.getCheckpointFile())

    def summed_over(data: RDD) -> Callable:
        tasks = max(context.defaultParallelism, -(-rows // PASS_ROWS))
        grouped = data.coalesce(tasks) if data.getNumPartitions() > tasks else data

        def summed(tree: dict[int, Split], wanted: list[int]) -> np.ndarray:
            kinds = [ROWS, WEIGHT, TARGET, SQUARE]
            known = constant if not tree else []
            parts = grouped.mapPartitions(_totals(layout, tree, wanted, kinds[TARGET if known else 0:]))
            several = grouped.getNumPartitions() > DIRECT_TASKS
            found = parts.treeReduce(np.add) if several else sum(parts.collect())
            if tree:
                return found
            # Rows and weights of the root are those of the first tree.
            found = np.concatenate([found[:, :0], *known, found], axis=1)
            constant[:] = [found[:, :TARGET]]
            return found
        return summed

    rate = trees.getStepSize()
    grown, shares = [], []
    try:
        # Written, since rows that are made again could come in another order than margins.
        packed = table.mapInArrow(_packed(layout), "packs binary, signs binary, weights binary")
        blocks = keep(packed.rdd.map(_block), True)
        blocks.foreach(lambda _: None)
        margins = None
        for number in range(trees.getMaxIter()):
            before = margins
            data = blocks
            if grown:
                last = grown[-1]
                split = {n: node.split for n, node in last.items() if node.split}
                values = {n: shares[-1] * node.value for n, node in last.items() if not node.split}
                told = blocks if before is None else blocks.zip(before)
                margins = keep(
                    told.map(_margins(layout, split, values)), number % KEPT_ROUNDS == 0)
                data = blocks.zip(margins)
            grown.append(_grown(
                layout, summed_over(data), trees.getMaxDepth(), trees.getMinInfoGain()))
            shares.append(rate if number else 1.0)
            if before is not None:
                drop(before)
            remove(*written[1:-1])
    finally:
        drop(*held)
        remove(*written)
    return layout, grown, shares


def _model(trees: GBTClassifier, trained: tuple, inputs: int) -> GBTClassificationModel:
    """The trees as a model of Spark's."""
    layout, grown, shares = trained
    context = SparkContext.getOrCreate()
    jvm, gateway = context._jvm, context._gateway
    tree, impurity = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.mllib.tree.impurity

    def doubles(values: Iterable[float]):
        values = list(values)
        array = gateway.new_array(jvm.double, len(values))
        for place, value in enumerate(values):
            array[place] = float(value)
        return array

    def made(nodes: dict[int, Node], number: int):
        node = nodes[number]
        value, count = float(node.value), int(node.totals[ROWS])
        stats = impurity.VarianceCalculator(doubles(node.totals[WEIGHT:]), count)
        if not node.split:
            return tree.LeafNode(value, float(node.impurity), stats)
        limits = layout.thresholds[node.split.input]
        if limits is None:
            how = tree.CategoricalSplit(
                node.split.input, doubles(np.flatnonzero(node.split.left)), len(node.split.left))
        else:
            how = tree.ContinuousSplit(
                node.split.input, float(limits[np.flatnonzero(node.split.left)[-1]]))
        return tree.InternalNode(
            value, float(node.impurity), float(node.split.gain), made(nodes, 2 * number),
            made(nodes, 2 * number + 1), how, stats)

    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    models = gateway.new_array(kind, len(grown))
    for place, nodes in enumerate(grown):
        models[place] = kind(f"{trees.uid}_{place}", made(nodes, ROOT), inputs)
    return GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(
        trees.uid, models, doubles(shares), inputs, 2))
