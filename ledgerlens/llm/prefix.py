"""Running sums over groups of any size without a window over a whole group."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import power_of_two

ROWS_PER_RANGE = 20_000


def before(rows: DataFrame, part: str, key: str, ties: list[str], amount: Column,
           per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds ``_before``: the sum of ``amount`` over the earlier rows of the same ``part``.

    ``rows`` is a written table, read twice; ``key`` is a long that is spread evenly (a
    hash), and the order within a part is by key, then by ``ties``. The keys are cut into
    ranges by their leading bits, of about ``per_range`` rows of the whole table each, so a
    part that holds a third of all rows is spread over a third of that many tasks. Sums of
    the ranges are aggregated map side; only they meet in a window by part, and rows meet
    in a window by part and range.
    """
    bits = power_of_two(rows.count(), per_range)
    reach = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    ranged = rows.withColumns({"_range": reach, "_amount": amount})
    sums = ranged.groupBy(part, "_range").agg(F.sum("_amount").alias("_sum"))
    earlier = Window.partitionBy(part).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col(part).alias("_part"), F.col("_range").alias("_start_range"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast("long").alias("_start"),
    )
    inside = Window.partitionBy(part, "_range").orderBy(key, *ties).rowsBetween(
        Window.unboundedPreceding, -1)
    own = ranged.withColumn("_own", F.coalesce(F.sum("_amount").over(inside), F.lit(0)))
    matched = own.join(
        starts, (F.col(part) == F.col("_part")) & (F.col("_range") == F.col("_start_range")))
    return matched.withColumn("_before", (F.col("_own") + F.col("_start")).cast("long")).drop(
        "_range", "_amount", "_part", "_start_range", "_start", "_own")
