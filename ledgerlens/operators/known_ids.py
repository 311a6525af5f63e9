"""Which ids a table of many runs may hold already, without reading the table.

Every run leaves an index of the ids it wrote: for each day Bloom filters in blocks of 32,768
bits, and the least and the largest id. An id sets seven bits of one block. A later run looks
its ids up in the blocks of the days whose ids reach as far; only what passes there is
compared with the rows themselves, and only with the days it was found in.

An index row is (day, run, power, block, ids, least, most, bits): a day of a run has 2^power
blocks, with ten to twenty bits for each id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.skew import if_small
from ledgerlens.session import cut_lineage

BLOCK_BITS = 32_768
BITS_PER_ID = 10
SCHEMA = ("day DATE, power INT, block BIGINT, ids BIGINT, least BIGINT, most BIGINT, "
          "bits BINARY, run STRING")


def _block(ident: str, power: Column) -> Column:
    """Block of an id: the leading bits of its hash."""
    mixed = F.xxhash64(ident)
    # Two shifts, since a shift by 64 is one by 0.
    return F.call_function("shiftrightunsigned", F.shiftrightunsigned(mixed, 1), 63 - power)


def _places(ident: str) -> Column:
    """Bits of an id in its block."""
    first, second = F.xxhash64(ident), F.xxhash64(ident, F.lit(1))
    parts = [(first, k) for k in range(3)] + [(second, k) for k in range(4)]
    return F.array(*[
        F.shiftrightunsigned(mixed, 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1))
        for mixed, k in parts])


def index_rows(rows: DataFrame, ident: str, day: str) -> DataFrame:
    """The index of the ids of a written table, by day."""
    ids = rows.select(F.col(ident).alias("id"), F.col(day).alias("day")).filter("id IS NOT NULL")
    needed = F.count(F.lit(1)) * BITS_PER_ID / BLOCK_BITS
    days = cut_lineage(
        ids.groupBy("day").agg(
            F.count(F.lit(1)).alias("ids"), F.min("id").alias("least"),
            F.max("id").alias("most"),
            F.greatest(F.lit(0), F.ceil(F.log2(needed))).cast("int").alias("power")), "days")
    placed = ids.join(if_small(days), ids["day"].eqNullSafe(days["day"])).select(
        days["day"], "power", "ids", "least", "most", _block("id", F.col("power")).alias("block"),
        F.explode(_places("id")).alias("place"))
    return placed.groupBy("day", "power", "block", "ids", "least", "most").agg(
        F.bitmap_construct_agg("place").alias("bits"))


def maybe_known(rows: DataFrame, ident: str, index: DataFrame) -> DataFrame:
    """(id, day) of the ids that the index lets through; every known id is among them."""
    ids = rows.select(F.col(ident).alias("id")).filter("id IS NOT NULL").distinct()
    ends = ids.agg(F.min("id"), F.max("id")).first()
    if ends[0] is None:
        return index.select(F.lit(None).cast("bigint").alias("id"), "day").limit(0)
    near = index.filter((F.col("most") >= ends[0]) & (F.col("least") <= ends[1]))
    powers = sorted(row["power"] for row in near.select("power").distinct().collect())
    if not powers:
        return index.select(F.lit(None).cast("bigint").alias("id"), "day").limit(0)
    asked = ids.withColumn("power", F.explode(F.array(*map(F.lit, powers))))
    asked = asked.withColumns({"block": _block("id", F.col("power")), "places": _places("id")})
    bit = "(cast(conv(hex(substring(bits, cast(p div 8 AS int) + 1, 1)), 16, 10) AS int)"
    found = asked.join(near, ["power", "block"]).filter("id BETWEEN least AND most").filter(
        F.expr(f"forall(places, p -> shiftright({bit}), cast(p % 8 AS int)) & 1 = 1)"))
    return found.select("id", "day").distinct()


def known(rows: DataFrame, ident: str, index: DataFrame, table: DataFrame, day: str) -> DataFrame:
    """The ids of ``rows`` that ``table``, whose folders are by ``day``, holds: exact.

    Of the table the ids are read, of the days only in which any was let through.
    """
    asked = cut_lineage(maybe_known(rows, ident, index), "asked-ids")
    days = [row["day"] for row in asked.select("day").distinct().collect()]
    there = table.filter(F.col(day).isin(days)) if days else table.limit(0)
    held = there.select(F.col(ident).alias("id"), F.col(day).alias("day"))
    return asked.join(held, ["id", "day"], "left_semi").select("id").distinct()


def without_known(
    rows: DataFrame, ident: str, index: DataFrame, table: DataFrame, day: str
) -> DataFrame:
    """``rows`` whose id ``table`` does not hold yet; ``rows`` is a written table."""
    found = if_small(cut_lineage(known(rows, ident, index, table, day), "known-ids"))
    return rows.join(found, rows[ident] == found["id"], "left_anti")
