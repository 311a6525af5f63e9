"""Ids of earlier runs: the index against the ids themselves, and runs that are repeated."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import known_ids
from ledgerlens.plans import jobs
from ledgerlens.session import cut_lineage
from ledgerlens.sources import readers, sinks

DAYS = [date(2024, 1, d) for d in (1, 2, 3)]


def ids_by_day(spark, sizes):
    """Ids that are spread over the days at random, of very different numbers."""
    rows = [(i * 7919 % 1_000_003, DAYS[d]) for d, n in enumerate(sizes)
            for i in range(sum(sizes[:d]), sum(sizes[: d + 1]))]
    return spark.createDataFrame(rows, "transaction_id BIGINT, tx_date DATE"), rows


def test_every_known_id_is_let_through_and_few_others(spark):
    table, rows = ids_by_day(spark, [20_000, 3, 700])
    index = cut_lineage(known_ids.index_rows(table, "transaction_id", "tx_date"), "index")
    powers = {r["day"]: r["power"] for r in index.select("day", "power").distinct().collect()}
    assert powers == {DAYS[0]: 3, DAYS[1]: 0, DAYS[2]: 0}
    asked = spark.range(1_000_003).select(F.col("id").alias("transaction_id")).sample(0.2, 1)
    held = {r[0] for r in asked.collect()}
    found = {tuple(r) for r in
             known_ids.maybe_known(asked, "transaction_id", index).collect()}
    there = {(i, day) for i, day in rows if i in held}
    assert len(there) > 3000 and there <= found
    assert len(found) - len(there) < 0.02 * len(held)
    exact = known_ids.known(asked, "transaction_id", index, table, "tx_date")
    assert {r["id"] for r in exact.collect()} == {i for i, _ in there}


def test_edges_of_the_index(spark):
    table, _ = ids_by_day(spark, [5, 5, 5])
    empty = table.limit(0)
    index = known_ids.index_rows(table.unionByName(
        spark.createDataFrame([(None, DAYS[0])], table.schema)), "transaction_id", "tx_date")
    assert known_ids.maybe_known(empty, "transaction_id", index).count() == 0
    assert known_ids.index_rows(empty, "transaction_id", "tx_date").count() == 0
    nothing = known_ids.index_rows(empty, "transaction_id", "tx_date")
    assert known_ids.maybe_known(table, "transaction_id", nothing).count() == 0
    rows = cut_lineage(table, "rows")
    assert known_ids.without_known(rows, "transaction_id", nothing, table, "tx_date").count() == 15
    assert known_ids.without_known(rows, "transaction_id", index, table, "tx_date").count() == 0


def write_run(spark, folder, ids, day):
    lines = [f"{i},2024-01-{day:02d} 12:00:00,1,1,5.0,1,0,0,0" for i in ids]
    spark.createDataFrame([(line,) for line in lines], "value STRING").write.text(folder)


def test_runs_keep_what_earlier_runs_wrote(spark, tmp_path):
    target = str(tmp_path / "clean")

    def stored():
        rows = readers.read_clean_by_run(spark, target).select("transaction_id", "run", "tx_date")
        return sorted((r[0], r[1], r[2].day) for r in rows.collect())

    for name, ids, day in (("a", [1, 2, 3, 3], 5), ("b", [3, 4], 6), ("c", [1, 9], 5)):
        write_run(spark, str(tmp_path / name), ids, day)
        jobs.clean_run(spark, str(tmp_path / name), target, name)
    want = [(1, "a", 5), (2, "a", 5), (3, "a", 5), (4, "b", 6), (9, "c", 5)]
    assert stored() == want
    # Again: nothing is doubled, and an index without rows lets through too much only.
    jobs.clean_run(spark, str(tmp_path / "b"), target, "b")
    assert stored() == want
    lost = spark.createDataFrame([(50, DAYS[0])], "transaction_id BIGINT, tx_date DATE")
    index = known_ids.index_rows(lost, "transaction_id", "tx_date").withColumn("run", F.lit("x"))
    sinks.write_parquet(index, f"{target}/_ids", None, ["run"])
    write_run(spark, str(tmp_path / "d"), [50], 1)
    jobs.clean_run(spark, str(tmp_path / "d"), target, "d")
    assert (50, "d", 1) in stored()


def test_only_days_with_likely_copies_are_read(spark, tmp_path, monkeypatch):
    table, _ = ids_by_day(spark, [3000, 3000, 3000])
    path = str(tmp_path / "rows")
    sinks.write_parquet(table, path, None, ["tx_date"])
    stored = spark.read.schema("transaction_id BIGINT, tx_date DATE").parquet(path)
    index = cut_lineage(known_ids.index_rows(stored, "transaction_id", "tx_date"), "index")
    some = stored.filter(F.col("tx_date") == DAYS[1]).limit(5)
    monkeypatch.setattr(known_ids, "BITS_PER_ID", 10)
    found = known_ids.known(cut_lineage(some, "some"), "transaction_id", index, stored, "tx_date")
    assert found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "PartitionFilters" in line and path in line]
    assert scans and all("tx_date" in line.split("PartitionFilters")[1][:200] for line in scans)
    assert all("ReadSchema: struct<transaction_id:bigint>" in line for line in scans)


@pytest.mark.parametrize("share", [95])
def test_a_day_with_nearly_all_rows_is_written_by_several_tasks(spark, tmp_path, share):
    rows = spark.range(0, 200_000, 1, 8).selectExpr(
        "sha2(string(id), 256) AS text", f"if(id % 100 < {share}, 1, 2 + id % 3) AS day")
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1m")
        sinks.write_parquet(rows, str(tmp_path / "out"), None, ["day"])
    finally:
        spark.conf.set(key, before)
    files = {d.name: len(list(d.glob("*.parquet"))) for d in (tmp_path / "out").glob("day=*")}
    assert files["day=1"] > 3 and set(files) == {"day=1", "day=2", "day=3", "day=4"}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200_000
