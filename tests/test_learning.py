from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from checks import views
from checks.windows import WARMUP, transactions
from ledgerlens.operators import boosting, evaluate, model
from ledgerlens.operators.skew import HotRule
from ledgerlens.plans import jobs, presets
from ledgerlens.session import claim_file
from ledgerlens.sources import readers, sinks
from tests.conftest import same_rows


def test_metrics_without_denominators_are_zero(spark):
    df = spark.createDataFrame([(0, 0.0, 5), (0, 0.0, 5)],
                               "tx_fraud INT, prediction DOUBLE, unix_time BIGINT")
    assert tuple(evaluate.binary_metrics(df).first()) == (0, 0, 0, 0.0, 0.0, 0.0, 0.0)
    assert tuple(evaluate.confusion(df).first()) == (0, 2, 0)


def test_metrics(spark):
    week = evaluate.WEEK
    rows = [(1, 1.0, 0), (1, 0.0, 1), (0, 1.0, 2), (0, 1.0, 2 * week), (0, 0.0, 9)]
    df = spark.createDataFrame(rows, "tx_fraud INT, prediction DOUBLE, unix_time BIGINT")
    got = evaluate.binary_metrics(df).first()
    assert (got["tp"], got["fp"], got["fn"]) == (1, 2, 1)
    assert (got["precision"], got["recall"]) == (pytest.approx(1 / 3), 0.5)
    assert got["f1_score"] == pytest.approx(0.4) and got["avg_fp_per_week"] == 1.0


RUNS = [(1, "a", 0.4), (2, "b", None), (3, "c", 0.6), (4, "d", 0.6), (5, "e", 0.7)]


@pytest.fixture
def runs(spark):
    rows = [(n, name, "test_f1_score", f1) for n, name, f1 in RUNS if f1 is not None]
    rows += [(n, name, "test_recall", 0.5) for n, name, _ in RUNS]
    return spark.createDataFrame(rows, "run_number INT, run_name STRING, metric STRING, value DOUBLE")


def test_champions_beat_all_runs_before(runs):
    got = evaluate.champions(runs).orderBy("run_number").collect()
    assert [r["is_champion"] for r in got] == [1, 0, 1, 0, 1]
    assert [r["best_before"] for r in got] == [0.0, 0.4, 0.4, 0.6, 0.6]
    assert evaluate.best_run(runs).first()["run_number"] == 5
    assert evaluate.best_run(runs.filter("run_number < 5")).first()["run_number"] == 3
    assert evaluate.best_run(runs.filter("run_number = 2")).first()["run_name"] == "b"
    assert evaluate.next_run_number(runs).first()["run_number"] == 6


def test_time_split(spark):
    df = spark.createDataFrame([(t,) for t in [*range(10), None]], "unix_time BIGINT")
    for error in (0.0, 0.001):
        sides = model.add_time_split(df, "unix_time", 0.8, error).groupBy("split").count()
        assert {r["split"]: r["count"] for r in sides.collect()} == {
            "train": 8, "test": 2, None: 1
        }


def test_class_weight_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0,)] * 5 + [(1,)] * 2, "tx_fraud INT")
    weights = {r["tx_fraud"]: r["weight"] for r in model.add_class_weight(df).collect()}
    assert weights == {0: 1.0, 1: 2.0}
    with pytest.raises(Exception, match="both classes"):
        model.add_class_weight(df.filter("tx_fraud = 0")).collect()


def test_feature_table_is_the_same_with_hot_keys(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    plain = jobs.feature_table(tx, WARMUP, rule=None)
    hot = jobs.feature_table(tx, WARMUP, rule=HotRule(rows=3))
    assert plain.columns == presets.feature_columns()
    assert same_rows(plain, hot)


def test_fixed_features_differ_only_where_meant(spark, sf_dir):
    tx = transactions(spark, sf_dir)
    trained, fixed = (jobs.feature_table(tx, WARMUP, fixed=f) for f in (False, True))
    same = [c for c in trained.columns if not c.startswith(("term_", "fraud_"))]
    assert same_rows(trained.select(same), fixed.select(same))
    assert not same_rows(trained, fixed)
    risks = [c for c in fixed.columns if "_risk_" in c]
    for name in risks:
        assert fixed.filter((F.col(name) < 0) | (F.col(name) > 1)).count() == 0


def test_jobs_from_transactions_to_model(spark, sf_dir, tmp_path):
    clean, table = str(tmp_path / "clean"), str(tmp_path / "features")
    tx = transactions(spark, sf_dir).withColumn(
        "tx_datetime", F.col("tx_datetime").cast("timestamp")
    )
    sinks.write_parquet(tx, clean)
    jobs.features(spark, clean, table, warmup=WARMUP)
    stored = spark.read.parquet(table)
    assert stored.columns == presets.feature_columns()
    begin = views.tx_events(spark, sf_dir).agg(F.min("unix_time")).first()[0]
    assert stored.count() == views.tx_events(spark, sf_dir).filter(
        F.col("unix_time") >= begin + WARMUP
    ).count()
    training = jobs.training_table(stored)
    assert len(training.columns) == 65
    assert len(model.model_inputs(training)) == 54

    runs, models = str(tmp_path / "runs"), str(tmp_path / "models")
    first = jobs.train(spark, table, models, runs, maxIter=2, maxDepth=3)
    second = jobs.train(spark, table, models, runs, maxIter=2, maxDepth=3)
    assert (first["run_number"], second["run_number"]) == (1, 2)
    assert not second["best"]
    assert spark.read.parquet(first["inputs"]).count() == 54
    test_rows = sum(r["predicted_0"] + r["predicted_1"] for r in first["confusion"])
    assert 0 < test_rows < stored.count()
    logged = spark.read.parquet(runs)
    assert logged.count() == 16
    assert {r["metric"] for r in logged.filter("run_number = 1").collect()} == {
        f"{side}_{m}" for side in ("train", "test") for m in evaluate.METRICS
    }

    fitted = model.load_model(first["model"])
    importance = model.feature_importance(fitted, fitted.transform(training))
    assert importance.count() == 54
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert model.top_features(importance, 5).count() == 5


def test_categories_enter_the_vector(spark, sf_dir):
    tx = views.tx_events(spark, sf_dir).withColumn("hour", F.hour("tx_datetime"))
    pipeline = model.boosted_trees(["tx_amount"], weight=None, categories=["hour"], maxIter=1,
                                   maxDepth=2)
    scored = pipeline.fit(tx).transform(tx)
    assert scored.schema["features"].metadata["ml_attr"]["num_attrs"] == 25


def test_boosting_ends_when_held_out_rows_gain_nothing(spark):
    rows = small_table(spark)
    held = model.add_validation(rows, "transaction_id", 0.3)
    assert 30 < held.filter("validation").count() < 90
    assert same_rows(held, model.add_validation(rows.repartition(3), "transaction_id", 0.3))
    fitted = model.boosted_trees(
        ["kind"], weight=None, validation="validation", validationTol=0.05).fit(held)
    assert 1 <= fitted.stages[-1].getNumTrees < 50
    whole = model.boosted_trees(["kind"], weight=None, maxIter=20).fit(rows)
    assert whole.stages[-1].getNumTrees == 20
    assert fitted.transform(rows).filter("prediction != tx_fraud").count() == 0


def test_forests_in_a_session_that_observes(spark):
    rows = small_table(spark)
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 200
    forest = model.random_forest(["kind"], weight=None, numTrees=3, featureSubsetStrategy="all")
    scored = model.fitted(forest, rows).transform(rows)
    assert scored.filter("prediction != tx_fraud").count() == 0


def small_table(spark):
    rows = [(i, i % 4, int(i % 4 == 2), i * 1000) for i in range(200)]
    return spark.createDataFrame(rows, "transaction_id INT, kind INT, tx_fraud INT, unix_time BIGINT")


def test_runs_are_never_overwritten(spark, tmp_path):
    models, runs = str(tmp_path / "models"), str(tmp_path / "runs")
    params = {"split_error": 0, "maxIter": 1, "maxDepth": 2}
    first = jobs.train_table(spark, small_table(spark), models, runs, **params)
    assert first["run_number"] == 1 and first["best"]
    assert sum(r["predicted_0"] + r["predicted_1"] for r in first["confusion"]) == 40
    # A runs table elsewhere does not know the model that is there.
    with pytest.raises(FileExistsError, match="run-1"):
        jobs.train_table(spark, small_table(spark), models, str(tmp_path / "other"), **params)
    # A path that cannot be read as a table is an error, not an empty table.
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part.parquet").write_text("no table")
    with pytest.raises(Exception):
        jobs.train_table(spark, small_table(spark), models, str(tmp_path / "broken"), **params)


def test_trainings_at_the_same_time_get_numbers_of_their_own(spark, tmp_path):
    models, runs = str(tmp_path / "models"), str(tmp_path / "runs")
    table = small_table(spark).cache()
    train = lambda _: jobs.train_table(
        spark, table, models, runs, split_error=0, maxIter=1, maxDepth=2)
    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(train, range(4)))
    assert sorted(f["run_number"] for f in found) == [1, 2, 3, 4]
    logged = spark.read.parquet(runs).groupBy("run_number").count().collect()
    assert {r["run_number"]: r["count"] for r in logged} == dict.fromkeys([1, 2, 3, 4], 8)
    assert all(Path(f["model"]).exists() for f in found)
    # A number that was claimed by a training that failed stays unused.
    claim_file(spark, f"{runs}/_claims/run-5")
    assert train(0)["run_number"] == 6


def test_a_file_is_claimed_once(spark, tmp_path):
    path = str(tmp_path / "deep" / "claim")
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(lambda _: claim_file(spark, path), range(64))) == 1


def test_features_since_a_day_read_only_what_they_need(spark, sf_dir, tmp_path):
    source = str(tmp_path / "by-day")
    tx = transactions(spark, sf_dir).withColumn("tx_datetime", F.col("tx_datetime").cast("timestamp"))
    early = tx.withColumn("tx_datetime", F.expr("tx_datetime - INTERVAL 200 DAYS"))
    both = tx.unionByName(early).withColumn(jobs.DAY, F.to_date("tx_datetime"))
    sinks.write_parquet(both, source, partition_by=[jobs.DAY])
    last = tx.agg(F.to_date(F.max("tx_datetime"))).first()[0]
    read = jobs.recent(readers.read_clean_by_day(spark, source), last)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tx_date" in plan
    assert read.count() < both.count()
    target = str(tmp_path / "features")
    jobs.features(spark, source, target, by_day=True)
    whole = spark.read.parquet(target)
    kept, some = whole.count(), whole.filter(F.col("tx_date") == last).collect()
    assert kept == tx.count() and some  # the early rows are the warm-up
    # Days are replaced one by one; the others stay.
    jobs.features(spark, source, target, by_day=True, since=last)
    again = spark.read.parquet(target)
    assert again.count() == kept
    assert sorted(map(repr, again.filter(F.col("tx_date") == last).collect())) == sorted(
        map(repr, some))


def test_jobs_remove_their_work_tables(spark, sf_dir, tmp_path):
    from pathlib import Path

    from ledgerlens import session

    clean = str(tmp_path / "clean")
    sinks.write_parquet(transactions(spark, sf_dir).withColumn(
        "tx_datetime", F.col("tx_datetime").cast("timestamp")), clean)
    made = []
    session._OPEN_SPACES.append(made)
    try:
        jobs.features(spark, clean, str(tmp_path / "features"), warmup=0)
    finally:
        session._OPEN_SPACES.remove(made)
    assert made and not any(Path(path.removeprefix("file:")).exists() for path in made)


def test_the_warm_up_of_late_days_begins_with_the_table(spark, sf_dir, tmp_path):
    """With the default warm-up of 30 days nothing is left of the given 30 days, since or not."""
    source = str(tmp_path / "by-day")
    tx = transactions(spark, sf_dir).withColumn("tx_datetime", F.col("tx_datetime").cast("timestamp"))
    sinks.write_parquet(
        tx.withColumn(jobs.DAY, F.to_date("tx_datetime")), source, partition_by=[jobs.DAY])
    first, last = tx.agg(
        F.to_date(F.min("tx_datetime")), F.to_date(F.max("tx_datetime"))).first()
    for name, since in (("whole", None), ("late", first + timedelta(days=10))):
        jobs.features(spark, source, str(tmp_path / name), by_day=True, since=since)
        assert not list((tmp_path / name).glob("tx_date=*"))
    week = 7 * 86400
    for name, since in (("whole", None), ("late", first + timedelta(days=10))):
        jobs.features(spark, source, str(tmp_path / name), week, by_day=True, since=since)
    whole = spark.read.parquet(str(tmp_path / "whole"))
    late = spark.read.parquet(str(tmp_path / "late"))
    assert same_rows(late, whole.filter(F.col("tx_date") >= first + timedelta(days=10)))


def test_training_rows_are_spread_by_their_number(spark, monkeypatch):
    """One file, which is read in one part, is trained on in parts of bounded rows, and the
    vectors are made below the exchange."""
    rows = spark.range(0, 4000, 1, 1).selectExpr(
        "id AS transaction_id", "double(id % 7) AS a", "int(id % 2) AS b",
        "int(id % 7 > 3) AS tx_fraud", "1D AS weight")
    monkeypatch.setattr(model, "ROWS_A_TASK", 100)
    seen = []
    fit = model.GBTClassifier.fit
    monkeypatch.setattr(model.GBTClassifier, "fit", lambda self, df, *more: (
        seen.append(df), fit(self, df, *more))[1])
    pipeline = model.boosted_trees(["a", "b"], maxIter=2)
    found = model.fitted(pipeline, rows)
    assert seen[0].columns == ["features", "tx_fraud", "weight"]
    parts = [len(part) for part in seen[0].rdd.glom().collect()]
    assert len(parts) == 40 and sum(parts) == 4000 and max(parts) < 200
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.index("UDF")
    scored = found.transform(rows)
    assert scored.filter("prediction <> tx_fraud").isEmpty()
    names = {row["feature"] for row in model.feature_importance(found, scored).collect()}
    assert names == {"a", "b"}


def noisy_table(spark, rows):
    """Labels that many inputs decide together, and chance."""
    hashed = [f"pmod(xxhash64(id, {i}), 1000)" for i in range(5)]
    table = spark.range(0, rows, 1, 4).selectExpr(
        "id AS transaction_id", f"double({hashed[0]}) AS a", f"double({hashed[1]} % 5) AS b",
        f"int({hashed[2]} % 24) AS hour", "0D AS same", f"1D + {hashed[3]} % 3 AS weight")
    return table.selectExpr(
        "*", f"int(a / 1000 + hour % 5 / 5 + b / 9 + {hashed[4].replace('id', 'transaction_id')}"
        " / 1000 > 1.5) AS tx_fraud")


def test_boosted_trees_are_those_of_spark(spark):
    """Same splits and predictions, with categories, weights and an input without values."""
    rows = noisy_table(spark, 3000).cache()
    pipeline = model.boosted_trees(
        ["a", "b", "same"], categories=["hour"], maxIter=6, maxDepth=4)
    *front, trees = pipeline.getStages()
    vectors = Pipeline(stages=front).fit(rows).transform(rows)
    ours, theirs = trees.fit(vectors), super(boosting.BoostedTrees, trees)._fit(vectors)
    assert ours.treeWeights == theirs.treeWeights == [1.0] + [0.1] * 5
    assert ours.trees[0].toDebugString.split("\n")[1:] == theirs.trees[0].toDebugString.split("\n")[1:]
    assert abs(ours.totalNumNodes - theirs.totalNumNodes) <= 4  # splits of no gain but rounding
    both = theirs.transform(ours.transform(vectors).select(
        vector_to_array("probability").alias("ours"), "features"))
    gap = F.abs(F.col("ours")[1] - vector_to_array("probability")[1])
    assert both.agg(F.max(gap)).first()[0] < 1e-9
    assert ours.featureImportances.toArray() == pytest.approx(
        theirs.featureImportances.toArray(), abs=1e-9)


def test_boosted_trees_read_packed_bins(spark, monkeypatch):
    """Two bytes for several inputs of a row; the same result however rows and tasks are cut."""
    rows = noisy_table(spark, 3000).cache()
    pipeline = model.boosted_trees(["a", "b"], categories=["hour"], maxIter=3, maxDepth=3)
    seen = []
    train = boosting._train
    monkeypatch.setattr(boosting, "_train", lambda *given: seen.append(train(*given)) or seen[-1])
    whole = model.fitted(pipeline, rows)
    layout = seen[0][0]
    assert len(layout.arities) == 26 and len(layout.groups) <= 4
    assert sorted(sum(layout.groups, [])) == list(range(26))
    monkeypatch.setattr(model, "ROWS_A_TASK", 100)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "CHUNK_ROWS", 7)
    monkeypatch.setattr(boosting, "PASS_ROWS", 40)
    cut = model.fitted(pipeline, rows)
    scored = whole.transform(rows).select("transaction_id", F.col("rawPrediction").alias("one"))
    both = cut.transform(rows).join(scored, "transaction_id")
    gap = F.abs(vector_to_array("one")[1] - vector_to_array("rawPrediction")[1])
    assert both.agg(F.max(gap)).first()[0] < 1e-9


def test_boosted_trees_end_where_rounding_is_all_that_is_left(spark):
    """Leaves whose rows have the same target are not split by what rounding leaves of sums."""
    rows = spark.range(0, 3000, 1, 4).selectExpr(
        "id AS transaction_id", "int(id % 4) AS kind", "double(xxhash64(id) % 97) AS other",
        "int(id % 4 = 2) AS tx_fraud", "IF(id % 4 = 2, 3.1D, 1D) AS weight")
    found = model.fitted(model.boosted_trees(["kind", "other"], maxIter=30, maxDepth=7), rows)
    assert found.stages[-1].totalNumNodes == 30 * 5
    assert found.transform(rows).filter("prediction <> tx_fraud").isEmpty()


def test_boosted_trees_take_only_what_spark_takes(spark):
    rows = noisy_table(spark, 300)
    fit = model.boosted_trees(["a", "b"], maxIter=1).fit
    for wrong in ("2 AS tx_fraud", "1 AS tx_fraud, -1D AS weight", "1 AS tx_fraud, double('nan') AS a"):
        names = [part.split(" AS ")[1] for part in wrong.split(", ")]
        kept = [name for name in rows.columns if name not in names]
        with pytest.raises(Exception):
            fit(rows.selectExpr(*kept, *wrong.split(", ")))
    with pytest.raises(Exception):
        fit(rows.filter("false"))
