"""Transaction files: CSV with malformed-row capture, and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.schema import CLEAN_SCHEMA, CORRUPT, RAW_COLUMNS, RAW_SCHEMA


def data_lines(lines: DataFrame, comment: str = "#") -> DataFrame:
    """Lines of a text table that hold a row: neither empty nor a comment."""
    text = F.col("value")
    return lines.filter((F.trim(text) != "") & ~text.startswith(comment))


def parse_rows(lines: DataFrame, schema: str = RAW_SCHEMA, corrupt: str = CORRUPT) -> DataFrame:
    """Typed columns and the raw line of malformed rows in ``corrupt``.

    A wrong number of fields, text where a number belongs and numbers out of range mark
    a row; its other fields stay as parsed. Every line is parsed in full whatever columns
    are used later, so column pruning cannot hide a malformed row as it does when a file
    is scanned as CSV directly.
    """
    full = f"{schema}, {corrupt} STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    # As a generator the parsed row is computed once; as a plain column it would be parsed
    # again for every filter that looks at its fields.
    return data_lines(lines).select(F.inline(F.array(F.from_csv("value", full, options))))


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw transactions of all files under ``path`` (a glob works too)."""
    return parse_rows(spark.read.text(path))


def is_corrupt(corrupt: str = CORRUPT) -> Column:
    return F.col(corrupt).isNotNull()


def corrupt_counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_rows"),
            F.count_if(is_corrupt()).alias("corrupt_rows")]


def corrupt_report(raw: DataFrame) -> DataFrame:
    return raw.agg(*corrupt_counts())


def well_formed(raw: DataFrame) -> DataFrame:
    return raw.filter(~is_corrupt()).select(*RAW_COLUMNS)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless CSV with a DDL schema; lines that start with # are comments."""
    return spark.read.schema(schema).option("comment", "#").csv(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLEAN_SCHEMA).parquet(path)


def read_clean_by_day(spark: SparkSession, path: str) -> DataFrame:
    """Clean rows kept in folders by day, with the day as a column that prunes folders."""
    return spark.read.schema(f"{CLEAN_SCHEMA}, tx_date DATE").parquet(path)


def read_clean_by_run(spark: SparkSession, path: str) -> DataFrame:
    """Clean rows kept in folders by day and run; both columns prune folders."""
    return spark.read.schema(f"{CLEAN_SCHEMA}, tx_date DATE, run STRING").parquet(path)


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
