"""Mixing sources to target weights, with DataFrame functions only.

1. Every row gets a hash-random key of 63 bits, the same in every run.
2. Sources get targets: shares of all words by weight, at most ``epochs`` times their own
   words; what is above is shared again by weight among the others.
3. Within each source the key space is cut into ranges. Words are summed by source and
   range (map side first), running sums over the ranges find the one range in which the
   budget of the source ends, and only the rows of that range are sorted for the exact cut.

No task sees more of a source than one range, whatever share of the rows it holds, and
texts are never shuffled. Tables with one row per source are broadcast only after their
size was checked.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import power_of_two, small_side, word_count
from ledgerlens.session import cut_lineage


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in the order of their names (null last), repeating."""

    weights: tuple[float, ...] = (5, 2, 1)
    epochs: int = 3
    seed: int = 7
    rows_per_range: int = 20_000


def mix_key(doc_id: str, text: str, seed: int) -> Column:
    """Hash-random key of a row; rows equal in id and text have the same."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), 1)


def targets(sizes: DataFrame, rule: Mix = Mix()) -> DataFrame:
    """Budget of each source from its words: ``sizes`` has source and source_size.

    The highest level L for which all min(epochs * size, weight * L) together make the sum
    of all sizes: sources are put in the order in which they reach their limit, and the
    level after the first k of them is what is left divided by the weights left. The
    windows hold one row per source, all in one task, and the sum over the weights left takes
    a time that grows with the square of the sources: meant for up to 20,000 of them. More
    give the same results, but slowly.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in rule.weights])
    number = F.row_number().over(by_name) - 1
    weighted = sizes.select(
        "source", "source_size", number.alias("source_no")
    ).withColumns({
        "_weight": F.get(listed, F.col("source_no") % len(rule.weights)),
        "_limit": (F.col("source_size") * rule.epochs).cast("double"),
    })
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), "source_no")
    earlier = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_limit.rowsBetween(0, Window.unboundedFollowing)
    whole = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_limit").over(earlier), F.lit(0.0))
    levelled = weighted.withColumn("_level", left / F.sum("_weight").over(onwards))
    free = F.col("_weight") * F.col("_level") < F.col("_limit")
    level = F.min(F.when(free, F.struct(F.col("_limit") / F.col("_weight"), "source_no", "_level"))
                  ).over(whole)["_level"]
    # Without a free source all are at their limit, which only happens if there are no words.
    target = F.least("_limit", F.coalesce(F.col("_weight") * level, F.col("_limit")))
    budget = F.round(target).cast("long")
    fits = F.col("source_size") > 0
    return levelled.withColumn("target", target).withColumn("_budget", budget).select(
        "source", "source_no", "source_size", "target",
        F.when(fits, F.expr("_budget div source_size")).otherwise(0).alias("epochs"),
        F.when(fits, F.col("_budget") % F.col("source_size")).otherwise(0).alias("rest"),
    )


def _with_sources(rows: DataFrame, sources: DataFrame, source: str) -> DataFrame:
    renamed = small_side(sources.withColumnRenamed("source", "_source"))
    return rows.join(renamed, F.col(source).eqNullSafe(F.col("_source")), "left").drop("_source")


def plan(docs: DataFrame, rule: Mix = Mix(), doc_id: str = "doc_id", text: str = "text",
         source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Rows with the words the mix takes of them, and sources with their cuts.

    Rows: doc_id, source, size, source_size, target, taken; one per row of ``docs``. A row
    is taken whole ``epochs`` times, and once more as far as the rest of the budget goes in
    the order of the keys, so the words taken of a source are its target rounded. A missing
    text has size 0 and nothing is taken of it; a missing source is a source of its own;
    rows equal in id and text follow each other in any order, which gives the same rows; an
    empty table gives empty ones.

    Sources: source, epochs, cut_key (the largest key of which the rest takes anything).
    """
    rows = cut_lineage(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
            word_count(text).alias("size"), mix_key(doc_id, text, rule.seed).alias("key")),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(targets(sizes, rule), "mix-sources")
    bits = power_of_two(rows.count(), rule.rows_per_range)
    reach = F.shiftrightunsigned("key", 63 - bits) if bits else F.lit(0).cast("long")
    ranged = _with_sources(rows, sources, "source").withColumn("_range", reach)
    sums = ranged.groupBy("source_no", "_range", "rest").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source_no").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_sum").over(earlier), F.lit(0))
    cuts = cut_lineage(
        sums.withColumn("_start", start)
        .filter("_start <= rest and rest < _start + _sum")
        .select(F.col("source_no").alias("_no"), F.col("_range").alias("_cut"), "_start"),
        "mix-cuts",
    )
    placed = ranged.join(small_side(cuts), F.col("source_no") == F.col("_no"), "left")
    whole = F.col("size") * F.col("epochs")
    # Sources without words have no cut, and nothing to take.
    outside = placed.filter("_cut is null or _range != _cut").withColumn(
        "taken", whole + F.when(F.col("_range") < F.col("_cut"), F.col("size")).otherwise(0))
    sorted_rows = Window.partitionBy("source_no").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    own = F.col("_start") + F.coalesce(F.sum("size").over(sorted_rows), F.lit(0))
    more = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("_own")))
    inside = placed.filter("_range = _cut").withColumn("_own", own).withColumn(
        "taken", whole + more)
    last = inside.filter("_own < rest").groupBy(F.col("source_no").alias("_no")).agg(
        F.max("key").alias("cut_key"))
    # Without such a row in the range of the cut, the ranges before it end at its start.
    ends = sources.join(small_side(cuts), F.col("source_no") == F.col("_no"), "left").drop("_no")
    ends = ends.join(last, F.col("source_no") == F.col("_no"), "left")
    lower = (F.shiftleft("_cut", 63 - bits) if bits else F.lit(0)) - 1
    names = ["doc_id", "source", "size", "source_size", "target", "taken"]
    return (
        outside.select(*names).unionByName(inside.select(*names)),
        ends.select("source", "epochs", F.coalesce("cut_key", lower, F.lit(-1)).alias("cut_key")),
    )


def mixture(docs: DataFrame, rule: Mix = Mix(), doc_id: str = "doc_id", text: str = "text",
            source: str = "source") -> DataFrame:
    """The rows of the mix, with the columns of ``docs``.

    A row comes once per epoch in which the mix takes it; documents are not cut, so the last
    one of a source may exceed the budget, and rows equal in id and text go together. Rows
    without words are not taken.
    """
    cuts = cut_lineage(plan(docs, rule, doc_id, text, source)[1], "mix-ends")
    names = docs.columns
    keyed = docs.select(
        F.struct(*[F.col(f"`{name}`") for name in names]).alias("_row"), F.col(source).alias("_name"),
        (word_count(text) > 0).alias("_any"), mix_key(doc_id, text, rule.seed).alias("_key"))
    placed = keyed.join(
        small_side(cuts), F.col("_name").eqNullSafe(F.col("source")), "left")
    times = F.col("epochs") + (F.col("_key") <= F.col("cut_key")).cast("long")
    taken = placed.filter(F.col("_any") & (times > 0)).withColumn("_times", times)
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")
