"""Small helpers that several operators share."""

import math
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: a word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def fold(doc_id: str, folds: int) -> Column:
    """Fold of a document: crc32 of its id as text; a missing id counts as empty text."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(name: str = "text") -> Column:
    """Words of a text; a missing text has none."""
    return F.regexp_count(text_or_empty(name), F.lit(WORD)).cast("long")


def small_side(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """``table`` with a broadcast hint if it has at most ``rows`` rows, else as it is.

    Counting reads the table once more, so it should be a written one.
    """
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def power_of_two(count: int, per_part: int) -> int:
    """Bits of the number of parts that hold about ``per_part`` of ``count`` rows each."""
    return max(0, math.ceil(math.log2(max(1, count / per_part))))


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Batches of at most that many rows for tables that are written inside.

    A worker, and the executor that feeds it, hold a batch of texts at a time.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
