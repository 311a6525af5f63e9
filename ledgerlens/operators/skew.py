"""Isolation of hot groups.

A window needs all rows of its partition in one task. That is fine for ordinary keys
and impossible for a key that holds a large part of the table. Operators with windows
therefore treat the two kinds apart:

* ordinary keys take one shuffle by key and a window over the rows;
* hot keys are first reduced to one row per key and second, which bounds the window by
  elapsed time and no longer by rows, and the result is looked up from the rows.

Both ways give the same values, so where the line is drawn never changes a result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage


@dataclass(frozen=True)
class HotRule:
    """A key is hot when it has more than ``rows`` rows.

    One pass keeps a summary of frequent items of at most ``tracked`` keys, in which tasks
    count and which are merged. It surely holds every key with more than 7 / ``tracked`` of
    all rows; smaller ones it holds as long as there is room. What it holds is counted
    exactly, and only rows of those keys.
    """

    rows: int = 1_000_000
    tracked: int = 100_000


DEFAULT_RULE = HotRule()


def _key_item(keys: list[str]) -> str:
    """What stands for a key in a summary; another key with the same one does no harm."""
    return f"xxhash64({', '.join(f'`{key}`' for key in keys)})"


def frequent_items(keys: list[str], tracked: int) -> Column:
    """Aggregate: the items of the most frequent keys and bounds of their rows, descending.

    The bounds (``count``) are never below the rows of a key, and above them by at most
    :func:`bound_error` times all rows.
    """
    return F.expr(f"approx_top_k({_key_item(keys)}, {tracked}, {tracked})")


def bound_error(tracked: int) -> float:
    """Share of all rows by which a summary of that size may be wrong."""
    return 3.5 / tracked


def heavy_items(keys: list[str], rule: HotRule) -> Column:
    """Aggregate: the items of keys that may have more than ``rule.rows`` rows."""
    frequent = frequent_items(keys, rule.tracked)
    return F.filter(frequent, lambda x: x["count"] > rule.rows)["item"]


def rows_with_items(df: DataFrame, keys: list[str], items: list[int]) -> DataFrame:
    """The rows whose key has one of the items; ``items`` is bounded by the summary."""
    listed = df.sparkSession.createDataFrame([(item,) for item in items], "_item long")
    marked = df.withColumn("_item", F.expr(_key_item(keys)))
    return marked.join(F.broadcast(listed), "_item", "left_semi").drop("_item")


def hot_keys(
    df: DataFrame, keys: list[str], rule: HotRule = DEFAULT_RULE, items: list[int] | None = None
) -> DataFrame | None:
    """A written table of the keys with more than ``rule.rows`` rows; None if there are none.

    This looks at the data at once, at the key columns and nothing else, unless a look has
    found the ``items`` already. Where nothing is frequent, nothing else is read or written.
    """
    if items is None:
        if df.count() <= rule.rows:
            return None
        items = df.agg(heavy_items(keys, rule)).first()[0]
    if not items:
        return None
    sizes = rows_with_items(df.select(*keys), keys, items).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"))
    found = cut_lineage(sizes.filter(F.col("_rows") > rule.rows).select(*keys), "hot-keys")
    return None if found.isEmpty() else found


def if_small(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def _other(key: str) -> str:
    return f"_other_{key}"


def same_key(keys: list[str]) -> Column:
    """Equality with the other side of a join that also matches missing values."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(_other(key)))
    return condition


def other_side(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with its keys renamed, as the right side for :func:`same_key`."""
    return df.withColumnsRenamed({key: _other(key) for key in keys})


def split_hot(
    df: DataFrame, keys: list[str], rule: HotRule | None = DEFAULT_RULE,
    items: list[int] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys and rows of hot keys; the latter ``None`` if no key is hot.

    Without a rule no key is taken as hot, for callers that know their keys. ``items`` is
    what a look has found (:func:`heavy_items`).
    """
    found = hot_keys(df, keys, rule, items) if rule else None
    if found is None:
        return df, None
    listed = if_small(other_side(found, keys))
    return (
        df.join(listed, same_key(keys), "left_anti"),
        df.join(listed, same_key(keys), "left_semi"),
    )


def look_up(
    rows: DataFrame, table: DataFrame, keys: list[str], match_missing: bool = True
) -> DataFrame:
    """Left join on ``keys`` (one table row per key); adds the other table columns.

    Without ``match_missing`` this is a plain equality join, which can use an existing
    partitioning of the rows.

    Where the keys contain a time, a hot entity spreads over its seconds. Should a single
    second still be hot, adaptive execution splits the row side of this join.
    """
    added = [name for name in table.columns if name not in keys]
    if match_missing:
        joined = rows.join(other_side(table, keys), same_key(keys), "left")
    else:
        joined = rows.join(table, keys, "left")
    return joined.selectExpr(*[f"`{name}`" for name in (*rows.columns, *added)])
