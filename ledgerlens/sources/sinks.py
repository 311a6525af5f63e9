"""Parquet output, file counts and tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_plan(
    spark: SparkSession, path: str, target_mb: int = 256, compression: float = 3
) -> DataFrame:
    """Size of the files under ``path`` and how many output files they make.

    Only the file listing is read, not the content. ``compression`` is input size over
    output size; an empty folder still gives one file.
    """
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .select("length")
        )
    except AnalysisException as missing:
        raise FileNotFoundError(path) from missing
    total = F.coalesce(F.sum("length"), F.lit(0))
    needed = F.ceil(total / compression / (1024 * 1024) / target_mb)
    return files.agg(
        F.count(F.lit(1)).alias("files_in"),
        total.alias("bytes_in"),
        F.greatest(F.lit(1), needed).cast("int").alias("files_out"),
    )


def planned_files(spark: SparkSession, path: str, target_mb: int, compression: float) -> int:
    return file_plan(spark, path, target_mb, compression).first()["files_out"]


def write_parquet(
    df: DataFrame, path: str, files: int | None = None, partition_by: list[str] | None = None
) -> None:
    """Replace ``path``, with ``files`` output files where given.

    Rows are spread over the files by a shuffle of their own, so the number of files never
    throttles the stage that computes them. With ``partition_by`` the rows of a folder come
    together first, and only the folders that get rows are replaced; adaptive execution cuts
    a folder with very many rows into several tasks and files, of the size it advises.
    """
    spread = df
    if partition_by:
        spread = df.hint("rebalance", *partition_by)
    elif files:
        spread = df.repartition(files)
    writer = spread.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def export_rows(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """A subset for use outside Spark: one file as long as it is small, else several.

    ``df`` is computed twice: once to count its rows.
    """
    write_parquet(df, path, files=max(1, -(-df.count() // rows_per_file)))


def write_sum(df: DataFrame, column: str, path: str) -> None:
    """Total of a column as a one-row table."""
    df.agg(F.sum(column).alias("result")).write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, table: str, path: str) -> None:
    """Table in the session catalog with its files at ``path``."""
    df.write.mode("overwrite").option("path", path).saveAsTable(table)


def save_bucketed(
    df: DataFrame, table: str, path: str, keys: list[str], order: list[str], buckets: int
) -> None:
    """Table in the session catalog whose files are by bucket of the keys, each sorted.

    Windows and joins by the keys need no exchange then, however often the table is read. A
    bucket is one file, so that Spark can rely on its order; ``buckets`` should leave a bucket
    a few hundred megabytes. A key with very many rows makes its bucket large: such tables
    are better read through operators that split hot keys.
    """
    spread = df.repartition(buckets, *keys)
    writer = spread.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys, *order)
    writer.option("path", path).saveAsTable(table)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
