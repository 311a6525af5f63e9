"""Near-duplicate vectors by product quantisation.

Vectors with the same label are linked when their cosine is at least ``cosine``. On unit
vectors that is a distance of at most r = sqrt(2 - 2 * cosine).

1. Vectors are scaled to length one; equal ones of a label become one member with a count.
2. Coarse centres and residual codebooks are fitted on a bounded sample.
3. Every member is listed at its nearest centre, as the codes of its residual's subspaces and
   the length of what the codes leave out. It visits every list in which a vector within r of
   it can be: the plane between the two centres must be at most r away. Of two centres, only
   members of the one with the lower number visit the other.
4. In a list, table look-ups give the distance of a visitor to each member's code; by the
   triangle inequality a pair is discarded if that exceeds r by more than what the member's
   code leaves out. The survivors' cosines are computed in double precision.
5. A list gives the number of links of each member, and as many links as connect them;
   numbers are added up and links become components.

Probes and table distances only discard pairs that cannot be linked, so nothing is lost,
whatever the sample. A list with more than ``block`` rows is compared block by block, each
pair of blocks by a group of its own.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.components import components
from ledgerlens.llm.simhash import _roots
from ledgerlens.session import cut_lineage

# What rounding can add to a distance or take from it.
SLACK = 1e-6


@dataclass(frozen=True)
class Rule:
    """sample: at most about this many vectors are used to fit the index, by a hash.

    per_list: vectors of the whole table for each coarse centre, of which there are at most
    ``lists``.
    """

    cosine: float = 0.98
    sample: int = 10_000
    per_list: int = 1_000
    lists: int = 256
    subspaces: int = 8
    codes: int = 64
    block: int = 2_048
    rounds: int = 10
    seed: int = 3


@dataclass(frozen=True)
class Index:
    """centres: (lists, width). codebooks: (subspaces, codes, width of a subspace)."""

    centres: np.ndarray
    codebooks: np.ndarray

    @property
    def edges(self) -> np.ndarray:
        return np.linspace(0, self.centres.shape[1], len(self.codebooks) + 1).astype(int)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    distance = (centres**2).sum(axis=1)[None, :] - 2 * points @ centres.T
    return distance.argmin(axis=1)


def clusters(points: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """Centres by Lloyd's rounds from distinct points; fewer if there are fewer points."""
    distinct = np.unique(points, axis=0)
    order = np.random.default_rng(seed).permutation(len(distinct))
    centres = distinct[order[:count]]
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        sizes = np.bincount(own, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def fit(points: np.ndarray, lists: int, rule: Rule) -> Index:
    """Index of unit vectors, all of one width."""
    centres = clusters(points, lists, rule.rounds, rule.seed)
    rest = points - centres[nearest(points, centres)]
    width = points.shape[1]
    subspaces = max(1, min(rule.subspaces, width))
    edges = np.linspace(0, width, subspaces + 1).astype(int)
    widest = int(np.diff(edges).max())
    books = np.zeros((subspaces, rule.codes, widest))
    for m in range(subspaces):
        found = clusters(rest[:, edges[m] : edges[m + 1]], rule.codes, rule.rounds, rule.seed)
        # Codebooks with fewer codes repeat the first one, which is never nearer.
        padded = np.concatenate([found, np.repeat(found[:1], rule.codes - len(found), axis=0)])
        books[m, :, : found.shape[1]] = padded
    return Index(centres, books)


def codes_of(rest: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Codes of residuals, and the length of what they leave out."""
    edges = index.edges
    codes = np.zeros((len(rest), len(index.codebooks)), np.uint8)
    left = np.zeros(len(rest))
    for m, book in enumerate(index.codebooks):
        part = rest[:, edges[m] : edges[m + 1]]
        own = book[:, : part.shape[1]]
        codes[:, m] = nearest(part, own)
        left += ((part - own[codes[:, m]]) ** 2).sum(axis=1)
    return codes, np.sqrt(left)


def visited(points: np.ndarray, home: np.ndarray, centres: np.ndarray,
            reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, centre) of the higher lists that hold anything within ``reach`` of a point."""
    squared = ((points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :]
               - 2 * points @ centres.T)
    between = np.sqrt(np.maximum(
        (centres**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :]
        - 2 * centres @ centres.T, 0))
    gap = squared - squared[np.arange(len(points)), home][:, None]
    near = gap <= 2 * (reach + SLACK) * between[home] + SLACK
    near &= np.arange(len(centres))[None, :] > home[:, None]
    return np.nonzero(near)


def _place(shared, reach: float):
    """Rows of members at home and as visitors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                if not part.num_rows:
                    continue
                node, label, unit, weight = part.columns
                points = np.stack(unit.to_numpy(zero_copy_only=False)).astype(np.float64)
                home = nearest(points, index.centres)
                row, centre = visited(points, home, index.centres, reach)
                rows = np.concatenate([np.arange(len(points)), row])
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [node.take(at), label.take(at),
                     pa.array(np.concatenate([home, centre]), pa.int32()),
                     pa.array(np.arange(len(rows)) < len(points)),
                     unit.take(at), weight.take(at)],
                    ["node", "label", "list", "home", "unit", "weight"])

    return run


def compare(points: np.ndarray, base: np.ndarray, centre: np.ndarray, index: Index,
            rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(point, base) pairs with a cosine of at least ``rule.cosine``."""
    reach = math.sqrt(max(0.0, 2 - 2 * rule.cosine))
    codes, left = codes_of(base - centre, index)
    rest, edges = points - centre, index.edges
    tables = []
    for m, book in enumerate(index.codebooks):
        part = rest[:, edges[m] : edges[m + 1]]
        own = book[:, : part.shape[1]]
        tables.append((part**2).sum(axis=1)[:, None] + (own**2).sum(axis=1)[None, :]
                      - 2 * part @ own.T)
    limit = (reach + left + SLACK) ** 2 + SLACK
    found_a, found_b = [], []
    step = max(1, 2_000_000 // max(1, len(base)))
    for first in range(0, len(points), step):
        last = min(len(points), first + step)
        distance = np.zeros((last - first, len(base)))
        for m, table in enumerate(tables):
            distance += table[first:last][:, codes[:, m]]
        a, b = np.nonzero(distance <= limit[None, :])
        for some in range(0, len(a), 100_000):
            x, y = points[first + a[some : some + 100_000]], base[b[some : some + 100_000]]
            linked = (x * y).sum(axis=1) >= rule.cosine
            found_a.append(first + a[some : some + 100_000][linked])
            found_b.append(b[some : some + 100_000][linked])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def _link(shared, rule: Rule):
    """One pair of blocks of a list: links of its members by number, and enough to connect."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        index = shared.value
        base = group[group["is_base"]].sort_values("node")
        points = group[~group["is_base"]].sort_values(["home", "node"])
        out = {"node": [], "links": [], "other": []}
        if len(base) and len(points):
            a, b = compare(np.stack(points["unit"]), np.stack(base["unit"]),
                           index.centres[int(group["list"].iloc[0])], index, rule)
            nodes = np.concatenate([points["node"], base["node"]]).astype(np.int64)
            weights = np.concatenate([points["weight"], base["weight"]]).astype(np.int64)
            b = b + len(points)
            other = nodes[a] != nodes[b]
            a, b = a[other], b[other]
            visitor = ~points["home"].to_numpy(bool)[a]
            links = np.zeros(len(nodes), np.int64)
            # Two members at home meet twice, once from either side.
            np.add.at(links, a, weights[b])
            np.add.at(links, b[visitor], weights[a[visitor]])
            by_node, number = np.unique(nodes, return_inverse=True)
            total = np.bincount(number, links, len(by_node)).astype(np.int64)
            parent = np.arange(len(by_node))
            x, y = number[a], number[b]
            while len(x):
                x, y = _roots(parent, x), _roots(parent, y)
                apart = x != y
                x, y = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
                np.minimum.at(parent, x, y)
            root = by_node[_roots(parent, np.arange(len(by_node)))]
            some = (total > 0) | (root != by_node)
            out = {"node": by_node[some], "links": total[some], "other": root[some]}
        return pd.DataFrame(out)

    return run


def unit(vector: list | None) -> np.ndarray | None:
    """The vector scaled to length one, in double precision; None if it links with nothing.

    That is so for a missing or empty vector, one of length zero, and one that holds a null
    or a number that is not finite.
    """
    if not vector or None in vector:
        return None
    values = np.array(vector, np.float64)
    largest = np.abs(values).max()
    if not np.isfinite(largest) or largest == 0:  # the largest of NaN and others is NaN
        return None
    values /= largest  # so that squares neither overflow nor vanish
    return values / np.sqrt((values * values).sum())


def unit_column(vector: Column) -> Column:
    """:func:`unit` of each vector."""

    @F.arrow_udf("array<double>")
    def units(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([unit(value.as_py()) for value in batch], pa.list_(pa.float64()))

    return units(vector)


def near_duplicates(vectors: DataFrame, rule: Rule = Rule(), vec_id: str = "vec_id",
                    embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Vectors without a label, and those that :func:`unit` refuses, link with nothing: no links,
    and a component of their own. Vectors of different widths are never linked. Rows with
    the same vector count as linked with each other. A missing vec_id never names a
    component unless the whole component is without one; repeated rows come back repeated;
    an empty table gives an empty one.
    """
    rows = cut_lineage(
        vectors.select(
            F.col(vec_id).alias("vec_id"), F.col(label).alias("label"),
            unit_column(F.when(F.col(label).isNotNull(), F.col(embedding))).alias("unit"),
        ).withColumn("key", F.when(
            F.col("unit").isNotNull(), F.sha2(F.concat_ws(",", F.col("unit").cast(
                "array<string>"), F.col("label").cast("string")), 256))),
        "vectors",
    )
    usable = rows.filter("unit is not null")
    members = cut_lineage(
        usable.groupBy("key").agg(
            F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"),
            F.first("label").alias("label"), F.first("unit").alias("unit"),
        ).withColumn("node", F.xxhash64("key")),
        "members",
    )
    spark = vectors.sparkSession
    widths = members.select(F.size("unit").alias("width")).distinct().sort("width").collect()
    if not widths:
        return _alone(rows)
    found = [_links(spark, members.filter(F.size("unit") == w["width"]), rule) for w in widths]
    links = cut_lineage(reduce(DataFrame.unionByName, found), "vector-links")
    roots = components(links, "node", "other")
    numbers = links.groupBy("node").agg(F.sum("links").alias("links")).hint("rebalance")
    rooted = members.select("key", "node", "first_id", "weight").join(numbers, "node", "left")
    rooted = rooted.join(
        roots.select(F.col("node").alias("_node"), "root"), F.col("node") == F.col("_node"),
        "left").select(
        "key", "first_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("root"))
    rooted = cut_lineage(rooted, "vector-roots")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).hint("rebalance")
    named = cut_lineage(
        rooted.join(least, "root").select("key", "n_links", "component_id"), "vector-names")
    linked = rows.filter("key is not null").join(named, "key").select(
        "vec_id", "n_links", "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(_alone(rows))


def _alone(rows: DataFrame) -> DataFrame:
    return rows.filter("key is null").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"))


def _matrix(units: DataFrame) -> np.ndarray:
    """The vectors of a bounded table, as rows."""
    found = units.toArrow().column(0)
    flat = np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in found.chunks)])
    return flat.reshape(len(found), -1)


def _links(spark, members: DataFrame, rule: Rule) -> DataFrame:
    """node, links, other of members of one width."""
    count = members.count()
    share = min(1.0, rule.sample / count)
    hashed = F.pmod(F.xxhash64(F.lit(rule.seed), F.col("key")), F.lit(1_000_000)) / 1e6
    sample = members.filter(hashed <= share).sort("key").limit(2 * rule.sample).select("unit")
    points = _matrix(sample)
    if not len(points):
        points = _matrix(members.sort("key").limit(1).select("unit"))
    lists = max(1, min(rule.lists, count // rule.per_list))
    shared = spark.sparkContext.broadcast(fit(points, lists, rule))
    reach = math.sqrt(max(0.0, 2 - 2 * rule.cosine))
    placed = cut_lineage(
        members.select("node", F.xxhash64("label").alias("label"), "unit", "weight").mapInArrow(
            _place(shared, reach),
            "node long, label long, list int, home boolean, unit array<double>, weight long"),
        "placed")
    # Home rows are the base, all rows of a list are compared with it, both block by block.
    sizes = placed.groupBy("label", "list").agg(
        F.ceil(F.count_if("home") / rule.block).cast("int").alias("base_blocks"),
        F.ceil(F.count(F.lit(1)) / rule.block).cast("int").alias("blocks"),
    ).filter("base_blocks > 0").hint("rebalance")
    sized = placed.join(sizes, ["label", "list"])
    mixed = F.xxhash64(F.lit(rule.seed), F.col("node"))
    base_block = F.pmod(mixed, F.col("base_blocks")).cast("int")
    block = F.pmod(mixed, F.col("blocks")).cast("int")
    as_point = F.transform(
        F.sequence(F.lit(0), F.col("base_blocks") - 1),
        lambda other: F.struct(other.alias("base_at"), block.alias("at"),
                               F.lit(False).alias("is_base")))
    as_base = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(base_block.alias("base_at"), other.alias("at"),
                               F.lit(True).alias("is_base")))
    dealt = sized.select(
        "node", "label", "list", "home", "unit", "weight",
        F.inline(F.when(F.col("home"), F.concat(as_point, as_base)).otherwise(as_point)))
    return dealt.groupBy("label", "list", "base_at", "at").applyInPandas(
        _link(shared, rule), "node long, links long, other long")
