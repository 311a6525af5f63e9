"""Cleans, thins, mixes and encodes the documents, one written stage after the other.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all
but the last return the columns of ``docs``. Missing texts count as empty ones, repeated
rows are handled as the operators of the stages say, and an empty table stays empty.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, mixing, secrets, simhash, toxicity
from ledgerlens.llm.common import read
from ledgerlens.llm.queries import toxicity_model
from ledgerlens.session import cut_lineage

#: SQL has neither the classifier nor the tokenizer; the tests hold each stage against a
#: plain version of itself.
ORACLE_SQL = None

#: Documents whose fingerprints differ in at most 3 bits are near-duplicates.
NEAR = simhash.Rule(words=3, bits=3)


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``docs`` has."""
    taken = {column.lower() for column in docs.columns}
    while name in taken:
        name += "_"
    return name


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{name}`") for name in docs.columns]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of these."""
    model = toxicity_model(spark, sf_dir, docs)
    name = _free(docs, "_score")
    scored = docs.withColumn(name, toxicity.score_column(F.col("text"), model, spark))
    return scored.filter(F.col(name) < 0.5).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id.

    Rows without a doc_id come after all others; of rows with the same id any one stays.
    Texts without words are a group.
    """
    number = _free(docs, "_number")
    marked = cut_lineage(docs.withColumn(number, F.monotonically_increasing_id()), "marked")
    grouped = simhash.near_duplicates(marked, NEAR, doc_id=number).select(
        F.col("doc_id").alias("_row"), "root")
    ids = marked.select(F.col(number).alias("_row"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "_row"))
    kept = ids.join(grouped, "_row").groupBy("root").agg(first.alias("first")).select(
        F.col("first._row").alias(number))
    return marked.join(kept, number, "left_semi").select(*_columns(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark; n_chars follows the text."""
    clean = docs.withColumn("text", secrets.redacted_column(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.col("n_chars").isNotNull() & F.col("text").isNotNull()
        clean = clean.withColumn("n_chars", F.when(
            changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*_columns(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights; a document comes once per epoch."""
    return mixing.mixture(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and what they decode to in the tokenizer's own writing."""
    model = bpe.load(spark, public_tokenizers.path("word_bpe_49k.json"))
    coded = docs.select("doc_id", "source", bpe.coded_column(F.col("text"), model).alias("coded"))
    return coded.select(
        "doc_id", "source", F.size("coded.ids").cast("long").alias("n_tokens"),
        F.col("coded.ids").alias("ids"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("secrets", without_secrets),
    ("mixing", mixed),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; every stage but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
