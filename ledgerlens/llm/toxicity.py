"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text is only unlabelled, toxic text
among it. With the share ``prior`` of toxic documents, the risk of a classifier is

    prior * E_pos[loss(+)]  +  max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

The second part estimates the risk on clean text; it cannot be below zero, so when it is,
a step leads back up instead of fitting the unlabelled text ever closer.

Several linear classifiers over hashed words and word beginnings are trained with numpy, as
groups on the executors; each leaves another part of a bounded sample out, and of its
features takes those that positives have significantly more often. Only weights come to the
driver (a fixed number of features times the number of classifiers). The score is the mean
probability over the classifiers.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import small_side
from ledgerlens.session import cut_lineage

# Fixed value: stripped from both ends of a word.
MARKS = b".,;:!?\"'()[]{}#$%&*|<>-_/=+~`^@\\"
CACHED_WORDS = 60_000
CHUNK = 200


@dataclass(frozen=True)
class Learning:
    """positives, unlabelled: at most about this many rows are sampled, by a hash.

    deviations: by how many standard deviations a feature must be more frequent in the
    positives than in the unlabelled texts, with ``least_documents`` positives at least.
    """

    positives: int = 4_000
    unlabelled: int = 12_000
    classifiers: int = 3
    feature_bits: int = 18
    least_documents: int = 3
    deviations: float = 4.0
    epochs: int = 200
    rate: float = 0.05
    decay: float = 2e-4
    seed: int = 5


class _Words(dict):
    """Features of a word: itself and its first 4, 5 and 6 bytes; kept up to a number of words."""

    def __init__(self, bits: int):
        self.mask = (1 << bits) - 1

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        bare = word.strip(MARKS) or word
        parts = (bare, *(b"%d %b" % (size, bare[:size]) for size in (4, 5, 6)))
        found = tuple({zlib.crc32(part) & self.mask for part in parts})
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


def features(text: bytes, words: _Words) -> set[int]:
    """Hashed words that occur in a text, in lower case without marks around them."""
    return set().union(*map(words.__getitem__, text.lower().split()))


def feature_column(text: Column, bits: int) -> Column:
    @F.arrow_udf("array<int>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _Words(bits)
        for batch in batches:
            for first in range(0, len(batch), CHUNK):  # sent on before all are made
                some = batch.slice(first, CHUNK)
                yield pa.array([np.array(sorted(features(value.as_py() or b"", words)), np.int32)
                                for value in some], pa.list_(pa.int32()))

    return found(text.cast("binary"))


def risk_step(scores: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the risk by each row's score, or of its correction where it is due."""
    chance = 1 / (1 + np.exp(-np.clip(scores, -30, 30)))
    n_pos, n_unl = max(1, positive.sum()), max(1, (~positive).sum())
    loss = np.logaddexp(0, scores)  # of calling a row toxic when it is clean
    clean = loss[~positive].sum() / n_unl - prior * loss[positive].sum() / n_pos
    clean_step = np.where(positive, -prior * chance / n_pos, chance / n_unl)
    if clean < 0:
        return -clean_step
    return clean_step + np.where(positive, prior * (chance - 1) / n_pos, 0)


def chosen(flat: np.ndarray, is_positive: np.ndarray, positive: np.ndarray,
           rule: Learning) -> np.ndarray:
    """Which features are significantly more frequent in the positives."""
    n_pos, n_unl = positive.sum(), (~positive).sum()
    in_pos = np.bincount(flat[is_positive], minlength=1 << rule.feature_bits)
    in_unl = np.bincount(flat[~is_positive], minlength=1 << rule.feature_bits)
    share = (in_unl + 0.5) / (n_unl + 1)
    deviation = np.sqrt(n_pos * share * (1 - share) + 0.5)
    return (in_pos >= rule.least_documents) & (
        in_pos - n_pos * share >= rule.deviations * deviation)


def train(rows: list[np.ndarray], positive: np.ndarray, prior: float,
          rule: Learning) -> tuple[np.ndarray, float]:
    """Weights by feature, and the constant."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate([np.zeros(0, np.int32), *rows])
    kept = chosen(flat, np.repeat(positive, sizes), positive, rule)
    number = np.cumsum(kept) - 1
    use = kept[flat]
    row, column = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)[use], number[flat[use]]
    width = int(kept.sum())
    weights, constant = np.zeros(width), np.log(prior / (1 - prior))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rule.epochs + 1):
        scores = np.bincount(row, weights[column], len(rows)) + constant
        by_row = risk_step(scores, positive, prior)
        gradient = np.append(np.bincount(column, by_row[row], width) + rule.decay * weights,
                             by_row.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = rule.rate * (first / (1 - 0.9**step)) / (
            np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        constant -= move[-1]
    out = np.zeros(1 << rule.feature_bits, np.float32)
    out[kept] = weights
    return out, float(constant)


@dataclass(frozen=True)
class Model:
    """weights: (classifiers, features). Without any, every score is 0."""

    weights: np.ndarray
    constants: np.ndarray
    bits: int


def _trainer(prior: float, rule: Learning):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # Copies of a text teach it once.
        group = group.drop_duplicates(["order", "positive"]).sort_values(["order", "positive"])
        positive = group["positive"].to_numpy(bool)
        if not positive.any() or positive.all():
            return pd.DataFrame({"weights": [], "constant": []})
        weights, constant = train(list(group["features"]), positive, prior, rule)
        return pd.DataFrame({"weights": [weights.tobytes()], "constant": [constant]})

    return run


def fit(docs: DataFrame, labels: DataFrame, rule: Learning = Learning(),
        doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learns from ``labels`` (doc_id and label, 1 is toxic) and the texts of ``docs``.

    A document counts as positive if any of its labels is 1; labels that are missing and
    labels without a document teach nothing. Without a positive, or without a label that is
    not 1, the model scores 0 throughout. Other columns are not read.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    by_id = cut_lineage(
        marked.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_label")), "labels")
    n_labels, n_pos = by_id.agg(
        F.count("*"), F.count_if(F.col("_label") == 1)).first()
    empty = Model(np.zeros((0, 1 << rule.feature_bits), np.float32), np.zeros(0),
                  rule.feature_bits)
    n_docs = docs.count()
    if not n_pos or n_pos == n_labels or not n_docs:
        return empty
    share = lambda bound, count: min(1.0, bound / count)
    spread = lambda *names: F.pmod(
        F.xxhash64(F.lit(rule.seed), *names), F.lit(1_000_000)) / 1e6
    positives = cut_lineage(
        by_id.filter((F.col("_label") == 1) & (spread("_id") < share(rule.positives, n_pos)))
        .select("_id"), "positives")
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    joined = texts.join(small_side(positives, 2 * rule.positives),
                        F.col("id") == F.col("_id"), "left")
    roles = F.array_compact(F.array(
        F.when(F.col("_id").isNotNull(), F.lit(True)),
        F.when(spread("id", "text") < share(rule.unlabelled, n_docs), F.lit(False))))
    order = F.xxhash64("text")
    rows = joined.withColumn("roles", roles).filter(F.size("roles") > 0).select(
        order.alias("order"), "roles",
        feature_column(F.col("text"), rule.feature_bits).alias("features"))
    # A classifier leaves the texts of its own number out, unless it is the only one.
    own = F.pmod("order", F.lit(rule.classifiers))
    numbers = F.array(*map(F.lit, range(rule.classifiers)))
    parts = F.filter(numbers, lambda n: (n != own) | F.lit(rule.classifiers == 1))
    rows = rows.select("order", F.explode("roles").alias("positive"), "features").select(
        "*", F.explode(parts.cast("array<int>")).alias("part"))
    models = rows.groupBy("part").applyInPandas(
        _trainer(n_pos / n_labels, rule), "weights binary, constant double").collect()
    if not models:
        return empty
    models = sorted(models, key=lambda m: bytes(m["weights"]))
    return Model(np.stack([np.frombuffer(m["weights"], np.float32) for m in models]),
                 np.array([m["constant"] for m in models]), rule.feature_bits)


def score_column(text: Column, model: Model, session) -> Column:
    """Probability from 0 to 1 that a text is toxic; a missing text counts as empty."""
    shared = session.sparkContext.broadcast((model.weights, model.constants))
    bits = model.bits

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, constants = shared.value
        words = _Words(bits)
        for batch in batches:
            out = []
            for value in batch:
                if not len(constants):
                    out.append(0.0)
                    continue
                found = np.fromiter(features(value.as_py() or b"", words), np.int64)
                found.sort()
                sums = weights[:, found].sum(axis=1, dtype=np.float64) + constants
                out.append(float((1 / (1 + np.exp(-np.clip(sums, -30, 30)))).mean()))
            yield pa.array(out, pa.float64())

    return scores(text.cast("binary"))
