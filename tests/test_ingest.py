from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens import schema, session
from ledgerlens.operators import quality
from ledgerlens.plans import jobs
from ledgerlens.session import cut_lineage, work_folder
from ledgerlens.sources import readers, sinks

LINES = """# comment

1,2019-08-22 06:51:03,10,711,70.91,24663,0,0,0
2,2019-08-22 24:00:00,-1,711,70.91,24663,0,0,0
3,2019-08-22 05:10:37,0,Err,103.19,18637,0,0,0
4,2019-08-22 05:10:37,0
5,2019-08-22 05:10:37,0,1,103.19,18637,0,0,0,extra
6,2019-08-22 05:10:37,99999999999,1,103.19,18637,0,0,0
7,,,1,,,,,
7,2019-08-22 05:10:38,1,1,5.0,1,0,1,1
"""


@pytest.fixture
def lines(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "2019-08-22.txt").write_text(LINES)
    return str(folder)


def test_malformed_rows_are_marked(spark, lines):
    raw = readers.read_raw(spark, lines)
    assert raw.columns == [*schema.RAW_COLUMNS, "_corrupt"]
    assert readers.corrupt_report(raw).first().asDict() == {"total_rows": 8, "corrupt_rows": 4}
    kept = readers.well_formed(raw)
    assert sorted(r["transaction_id"] for r in kept.collect()) == [1, 2, 7, 7]
    # Selecting few columns must not bring malformed rows back.
    assert kept.select("transaction_id").count() == 4
    bad = raw.filter(readers.is_corrupt()).filter("transaction_id = 3").first()
    assert (bad["terminal_id"], bad["tx_amount"]) == (None, 103.19)


def test_rows_are_parsed_once(spark, lines):
    plan = readers.well_formed(readers.read_raw(spark, lines)).filter("customer_id > 3")
    assert plan._jdf.queryExecution().executedPlan().toString().count("from_csv(") == 1


def test_clean_job(spark, lines, tmp_path):
    target = str(tmp_path / "clean")
    report = jobs.clean(spark, lines, target, report=True)
    assert (report["total_rows"], report["corrupt_rows"], report["rows_checked"]) == (8, 4, 4)
    assert report["duplicates"] == 1
    assert report["bad_tx_datetime"] == report["bad_tx_amount"] == report["bad_tx_fraud"] == 1
    assert report["bad_customer_id"] == 2
    rows = {r["transaction_id"]: r for r in readers.read_clean(spark, target).collect()}
    # The row of id 7 without a time comes first, is chosen, and turns out invalid.
    assert sorted(rows) == [1, 2]
    assert rows[2]["tx_datetime"] == datetime(2019, 8, 22, 23, 59, 59)
    assert rows[2]["customer_id"] == -1 and rows[1]["tx_fraud"] is False
    jobs.clean(spark, lines, target, dedup_first=False)
    assert readers.read_clean(spark, target).count() == 3


def test_copies_are_dropped_before_the_shuffle(spark):
    copies = spark.range(50_000).selectExpr("1 AS transaction_id", "id % 7 AS value", "id AS rest")
    kept = quality.first_of_each(copies, ["transaction_id"], ["value"])
    assert [tuple(r) for r in kept.collect()] == [(1, 0, 0)]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_quality_report_of_nothing(spark):
    empty = quality.repair_time(
        quality.repair_unknown(spark.createDataFrame([], schema.RAW_SCHEMA))
    )
    assert set(quality.quality_report(empty).first().asDict().values()) == {0}


def test_long_report_has_rates(spark):
    report = spark.createDataFrame([(4, 1, 0)], "rows_checked BIGINT, a BIGINT, b BIGINT")
    got = {r["check"]: (r["bad_rows"], r["rate"]) for r in quality.quality_long(report).collect()}
    assert got == {"a": (1, 0.25), "b": (0, 0.0)}


def test_sum_of_csv_files(spark, tmp_path):
    for name, text in {"a.csv": "# x\n1\n2\n", "b.csv": "40\n\n# y\n"}.items():
        (tmp_path / name).write_text(text)
    jobs.sum_csv(spark, f"{tmp_path}/*.csv", f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").first()["result"] == 43


def test_file_plan(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    assert sinks.planned_files(spark, str(folder), 1, 1) == 1
    (folder / "a.bin").write_bytes(b"x" * (3 * 1024 * 1024))
    (folder / "sub").mkdir()
    (folder / "sub" / "b.bin").write_bytes(b"x" * 1024)
    plan = sinks.file_plan(spark, str(folder), 1, 1).first()
    assert (plan["files_in"], plan["files_out"]) == (2, 4)
    assert sinks.planned_files(spark, str(folder), 1, 0.2) == 16
    with pytest.raises(FileNotFoundError):
        sinks.planned_files(spark, str(tmp_path / "missing"), 1, 1)


def test_file_count_of_outputs(spark, tmp_path):
    df = spark.range(0, 1000, 1, 20)
    for files in (1, 3, 12):
        path = tmp_path / f"out{files}"
        sinks.write_parquet(df, str(path), files)
        assert len(list(path.glob("*.parquet"))) == files
    by_day = df.withColumn("day", F.col("id") % 2)
    sinks.write_parquet(by_day, str(tmp_path / "days"), partition_by=["day"])
    assert {p.name for p in (tmp_path / "days").glob("day=*")} == {"day=0", "day=1"}


def test_work_folder_follows_the_cluster_setting(spark):
    root = spark.conf.get(session.CHECKPOINT_DIR, None)
    first, second = work_folder(spark, "x"), work_folder(spark, "x")
    assert first != second
    if root:
        assert first.startswith(root)


class _Context:
    master = "local[2]"
    folder = None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, path):
        self.folder = path


class _Unset:
    sparkContext = _Context()

    class conf:
        @staticmethod
        def get(key, default):
            return default


def test_work_folder_without_a_setting():
    fake = _Unset()
    first = work_folder(fake, "x")
    assert first.startswith(fake.sparkContext.folder)
    assert work_folder(fake, "y").startswith(fake.sparkContext.folder)


def test_cut_lineage_keeps_rows_and_types(spark):
    df = spark.range(10).selectExpr("id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "1 AS one")
    cut = cut_lineage(df, "test")
    assert cut.dtypes == df.dtypes
    assert sorted(cut.collect()) == sorted(df.collect())
    assert "Range" not in cut._jdf.queryExecution().executedPlan().toString()


def test_clean_scan_reads_only_what_is_needed(spark, tmp_path):
    path = str(tmp_path / "clean")
    sinks.write_parquet(spark.createDataFrame([], schema.CLEAN_SCHEMA), path)
    plan = (
        readers.read_clean(spark, path).filter("tx_amount >= 100").select("customer_id")
        ._jdf.queryExecution().executedPlan().toString()
    )
    assert "GreaterThanOrEqual(tx_amount,100.0)" in plan
    assert "ReadSchema: struct<customer_id:int,tx_amount:double>" in plan


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Cluster:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_folder(Cluster(), "x")


def test_report_with_valid_rows_first(spark, lines, tmp_path):
    first = jobs.clean(spark, lines, str(tmp_path / "a"), report=True)
    second = jobs.clean(spark, lines, str(tmp_path / "b"), report=True, dedup_first=False)
    assert first == second and len(first) == 13


def test_small_exports_are_one_file(spark, tmp_path):
    path = tmp_path / "few"
    sinks.export_rows(spark.range(1000), str(path))
    assert len(list(path.glob("part-*"))) == 1
    sinks.export_rows(spark.range(1000), str(path), rows_per_file=300)
    assert len(list(path.glob("part-*"))) == 4
