"""Split, class weights, model pipelines and feature importance on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.boosting import BoostedTrees
from ledgerlens.operators.derive import in_stable_sample
from ledgerlens.operators.explore import approx_quantile, exact_quantiles
from ledgerlens.operators.sketches import written_quantile
from ledgerlens.schema import NOT_MODEL_INPUTS

# Training parameters of the two model sizes.
STANDARD_MODEL = {"maxIter": 50, "maxDepth": 5, "stepSize": 0.1, "seed": 42}
LARGE_MODEL = {"maxIter": 100, "maxDepth": 7, "stepSize": 0.1, "seed": 42}
# Parameters of a forest: every tree sees a bag of rows and, at each split, some inputs.
FOREST = {"numTrees": 50, "maxDepth": 7, "subsamplingRate": 0.7, "featureSubsetStrategy": "auto",
          "seed": 42}


def add_time_split(
    df: DataFrame, time: str, share: float = 0.8, error: float = 0.0
) -> DataFrame:
    """Column ``split``: ``train`` up to the time that ``share`` of the rows do not
    exceed, ``test`` after it, null without a time.

    With ``error`` 0 the threshold is exact; otherwise it comes from a sketch with that
    rank error.
    """
    if error > 0:
        found = approx_quantile(df, time, share, error)
    else:
        row = exact_quantiles(df, time, [share]).first()
        found = row["value"] if row else None
    threshold = F.lit(found).cast("double" if error > 0 else "bigint")
    side = F.when(F.col(time) <= threshold, "train").when(F.col(time) > threshold, "test")
    return df.withColumn("split", side)


def add_sketched_split(
    df: DataFrame, time: str, sketches: DataFrame, share: float = 0.8
) -> DataFrame:
    """:func:`add_time_split` with the threshold of stored sketches of the time
    (:mod:`ledgerlens.operators.sketches`), for instance by day.

    The rows are not looked at, and nothing comes to the driver. The threshold is written
    once: a sketch merged again could give another one within its error.
    """
    threshold = written_quantile(sketches, time, share).scalar()
    side = F.when(F.col(time) <= threshold, "train").when(F.col(time) > threshold, "test")
    return df.withColumn("split", side)


def class_ratio(df: DataFrame, label: str = "tx_fraud") -> DataFrame:
    """Negatives per positive, rounded half to even; fails when a class is missing."""
    counted = df.agg(
        F.count_if(F.col(label) == 0).alias("negatives"),
        F.count_if(F.col(label) == 1).alias("positives"),
    )
    missing = (F.col("negatives") == 0) | (F.col("positives") == 0)
    ratio = F.bround(F.col("negatives").cast("double") / F.col("positives").cast("double"))
    failure = F.raise_error("class weights need both classes")
    return counted.select(
        "negatives", "positives", F.when(missing, failure).otherwise(ratio).alias("ratio")
    )


def add_class_weight(df: DataFrame, label: str = "tx_fraud") -> DataFrame:
    ratio = class_ratio(df, label).select("ratio").scalar()
    return df.withColumn("weight", F.when(F.col(label) == 1, ratio).otherwise(1.0))


VALIDATION = "validation"


def add_validation(df: DataFrame, key: str, share: float = 0.1, seed: int = 7) -> DataFrame:
    """Column ``validation``: whether a row is held out of the training, by a digest of its
    key, to tell when boosting has learned enough."""
    held_out = F.coalesce(in_stable_sample(key, share, seed), F.lit(False))
    return df.withColumn(VALIDATION, held_out)


def model_inputs(df: DataFrame, also_out: list[str] | None = None) -> list[str]:
    skipped = {*NOT_MODEL_INPUTS, *(also_out or [])}
    return [name for name in df.columns if name not in skipped]


def to_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """All model inputs as doubles, in one projection."""
    return df.withColumns({name: F.col(name).cast("double") for name in columns})


def boosted_trees(
    inputs: list[str],
    label: str = "tx_fraud",
    weight: str | None = "weight",
    categories: list[str] | None = None,
    validation: str | None = None,
    **params,
) -> Pipeline:
    """Vector of the inputs, then gradient-boosted trees. Fit it by :func:`fitted`.

    ``categories`` are indexed and one-hot encoded in front of the vector. With a
    ``validation`` column (:func:`add_validation`) boosting ends when its rows are no longer
    predicted better; the rows' places in the trees are kept between rounds and written to
    the checkpoint folder every ten, so a lost executor costs ten rounds at most.
    """
    if validation:
        params = {"validationIndicatorCol": validation, "cacheNodeIds": True,
                  "checkpointInterval": 10, **params}
    trees = BoostedTrees(
        labelCol=label, featuresCol="features", **{**STANDARD_MODEL, **params}
    )
    return _on_vector(inputs, categories, trees, weight)


def random_forest(
    inputs: list[str],
    label: str = "tx_fraud",
    weight: str | None = "weight",
    categories: list[str] | None = None,
    **params,
) -> Pipeline:
    """Vector of the inputs, then bagged trees that each look at some of the inputs.

    The trees do not depend on each other: a pass over the rows grows a level of many of
    them at once, where boosting needs passes for each tree in turn. Fit it by :func:`fitted`.
    """
    trees = RandomForestClassifier(
        labelCol=label, featuresCol="features", **{**FOREST, **params}
    )
    return _on_vector(inputs, categories, trees, weight)


# Training rows that one task holds at most: boosting keeps them in memory, and every task of
# every round reads its share there (of 55 inputs about 700 bytes a row).
ROWS_A_TASK = 250_000


def spread(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df``, which has ``rows`` rows, in parts of about :data:`ROWS_A_TASK` by its key.

    Files that compress well are read in few parts, whatever the number of their rows.
    """
    parts = max(-(-rows // ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, key)


def fitted(pipeline: Pipeline, rows: DataFrame, key: str = "transaction_id") -> PipelineModel:
    """The pipeline fitted to the rows, its trees on vectors that are made once and spread by
    ``key``.

    Trees look at the vectors several times before they keep them in memory; what they look
    at are the files of the exchange that spreads them.

    Forests keep a summary of their training, which holds on to the session; once anything
    is observed in the session, such a model cannot be sent to the executors. A copy has no
    summary.
    """
    *front, trees = pipeline.getStages()
    encoded = Pipeline(stages=front).fit(rows)
    used = [trees.getFeaturesCol(), trees.getLabelCol()]
    for name in ("weightCol", "validationIndicatorCol"):
        if trees.hasParam(name) and trees.isDefined(name) and trees.getOrDefault(name):
            used.append(trees.getOrDefault(name))
    vectors = spread(encoded.transform(rows).select(*used, key), key, rows.count()).select(*used)
    return PipelineModel(stages=[*encoded.stages, trees.fit(vectors)]).copy()


def _on_vector(
    inputs: list[str], categories: list[str] | None,
    trees: GBTClassifier | RandomForestClassifier, weight: str | None,
) -> Pipeline:
    stages = []
    vectors = []
    for name in categories or []:
        indexer = StringIndexer(inputCol=name, outputCol=f"{name}_idx", handleInvalid="keep")
        encoder = OneHotEncoder(inputCols=[f"{name}_idx"], outputCols=[f"{name}_vec"])
        stages += [indexer, encoder]
        vectors.append(f"{name}_vec")
    assembler = VectorAssembler(inputCols=[*inputs, *vectors], outputCol="features")
    if weight:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[*stages, assembler, trees])


def scaled_components(inputs: list[str], categories: list[str], k: int = 20) -> Pipeline:
    """Encoding, scaling to unit deviation and principal components."""
    indexes = [f"{name}_idx" for name in categories]
    vectors = [f"{name}_vec" for name in categories]
    return Pipeline(
        stages=[
            StringIndexer(inputCols=categories, outputCols=indexes, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexes, outputCols=vectors),
            VectorAssembler(inputCols=[*inputs, *vectors], outputCol="features"),
            StandardScaler(
                inputCol="features", outputCol="scaled_features", withStd=True, withMean=True
            ),
            PCA(k=k, inputCol="scaled_features", outputCol="pca_features"),
        ]
    )


def save_model(model: PipelineModel, path: str) -> None:
    """Writes to a new folder; one that exists is an error."""
    model.write().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_importance(model: PipelineModel, scored: DataFrame) -> DataFrame:
    """(feature, importance) with the names Spark keeps in the vector metadata.

    One row per model input: tens of rows, known before the job starts.
    """
    groups = scored.schema["features"].metadata["ml_attr"]["attrs"].values()
    names = {attr["idx"]: attr["name"] for group in groups for attr in group}
    weights = model.stages[-1].featureImportances
    rows = [(names[i], float(weights[i])) for i in range(len(names))]
    return scored.sparkSession.createDataFrame(rows, "feature STRING, importance DOUBLE")


def top_features(importance: DataFrame, k: int = 20) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(k)
