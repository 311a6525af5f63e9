"""Connected components of a table of links, in rounds of joins and aggregations."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage


def _least(links: DataFrame, node: str, other: str) -> DataFrame:
    """Smallest ``other`` of each ``node``.

    The rebalance puts an exchange of its own between the aggregation and the join that
    follows, so that adaptive execution can split a node with very many links there.
    """
    return links.groupBy(node).agg(F.min(other).alias("_least")).hint("rebalance")


def _large(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = _least(both, "hi", "lo").select(
        F.col("hi").alias("lo"), F.least("hi", "_least").alias("_least")
    )
    return links.join(least, "lo").select("hi", F.col("_least").alias("lo")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    moved = links.join(_least(links, "hi", "lo"), "hi")
    ends = F.array(
        F.struct(F.col("lo").alias("hi"), F.col("_least").alias("lo")),
        F.struct("hi", F.col("_least").alias("lo")),
    )
    return moved.select(F.inline(ends)).filter("hi > lo").distinct()


def components(links: DataFrame, first: str, second: str) -> DataFrame:
    """Node and root (smallest node of its component) of all nodes but the roots.

    ``first`` and ``second`` are long columns without nulls. Alternates the large-star and
    the small-star step until the links no longer change, which takes a number of rounds
    about logarithmic in the longest path. Each round is written to the shared folder, so a
    lost executor costs a re-read. An empty table of links gives an empty result.
    """
    current = cut_lineage(
        links.select(
            F.greatest(first, second).alias("hi"), F.least(first, second).alias("lo")
        )
        .filter("hi > lo")
        .distinct(),
        "links",
    )
    seen = _state(current)
    while seen[0]:
        half = cut_lineage(_large(current), "links")
        current = cut_lineage(_small(half), "links")
        state = _state(current)
        if state == seen:
            break
        seen = state
    return current.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _state(links: DataFrame) -> tuple:
    """Number and order-free digest of the links: one row."""
    mixed = F.xxhash64("hi", "lo")
    return tuple(
        links.agg(
            F.count("*"),
            F.coalesce(F.sum(F.shiftright(mixed, 20)), F.lit(0)),
            F.coalesce(F.sum(mixed.bitwiseAND(F.lit(0xFFFFF))), F.lit(0)),
        ).first()
    )
