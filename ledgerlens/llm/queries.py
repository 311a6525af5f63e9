"""The queries over the given tables, and SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (
    bpe,
    lm,
    mixing,
    negatives,
    quality,
    secrets,
    sharding,
    simhash,
    spelling,
    suffixes,
    toxicity,
    vectors,
    warc,
)
from ledgerlens.llm.common import fold, read
from ledgerlens.session import work_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql=None):
    """Registers a query, with the SQL that gives its rows if there is one."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


# Five hexadecimal digits are four of base 32.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGEST = f"""array_to_string(list_transform(range(0, 32), lambda i: substr('{_BASE32}',
  cast((cast('0x' || substr(digest, 1 + 5 * (i // 4), 5) AS bigint) >> (15 - 5 * (i % 4))) & 31
       AS int) + 1, 1)), '')"""


@query(f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, octet_length(encode(html)) AS size, sha1(html) AS digest,
  max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, cast(size AS bigint) AS payload_bytes, {_DIGEST} AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> last THEN last END AS refers_to FROM s""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark, "archive")
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    page = lambda name: F.expr(f"try_cast(substring({name}, 10) as bigint)")
    return warc.read_archive(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"))


@query()
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = sharding.tree([1.0] * 8)
    placed = sharding.shards(read(spark, sf_dir, "documents"), now, sharding.grow(now, [1.0]))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         "slot", "grown_shard")


@query()
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = mixing.plan(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = bpe.load(spark, public_tokenizers.path("word_bpe_49k.json"))
    docs = read(spark, sf_dir, "documents")
    coded = docs.select("doc_id", bpe.coded_column(F.col("text"), model).alias("coded"))
    digits = F.concat_ws(" ", F.col("coded.ids").cast("array<string>"))
    return coded.select(
        "doc_id", F.size("coded.ids").cast("long").alias("n_tokens"),
        F.sha2(digits, 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"))


FOLDS = 5


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Learned from the labels and texts outside of fold 0."""
    learned = fold("doc_id", FOLDS) != 0
    return toxicity.fit(docs.filter(learned), read(spark, sf_dir, "labels").filter(learned))


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity_model(spark, sf_dir, docs)
    scored = docs.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"),
                         toxicity.score_column(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = docs.select("doc_id", secrets.span_column(F.col("text")).alias("found"))
    count = lambda kind: F.size(
        F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("found", lambda s: s["kind"] != "guess")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"))


_WORD = r"[^\x20\x09-\x0D]+"


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS words,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines
  FROM d),
w AS (SELECT doc_id, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM m),
t AS (SELECT *, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM w
  WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT *, CASE WHEN c IS NOT NULL
  AND count(*) OVER (PARTITION BY doc_id, a, b, c) > 1 THEN 1 ELSE 0 END AS starts FROM t),
e AS (SELECT doc_id, max(starts) OVER (PARTITION BY doc_id ORDER BY i
  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM r),
n AS (SELECT doc_id, cast(sum(inside) AS bigint) AS repeated FROM e GROUP BY doc_id),
base AS (SELECT m.doc_id, cast(len(words) AS bigint) AS n_words,
  cast(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS bigint) AS word_chars,
  cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
  cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines,
  coalesce(repeated, 0) AS n_repeat_words, len(lines) AS n_lines FROM m LEFT JOIN n USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR word_chars > 20 * n_words OR word_chars < 2 * n_words
  OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines) AS kept FROM f""")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rules = quality.ordered(quality.RULES, quality.estimate(docs))
    verdict = quality.verdict_column(F.col("text"), rules, quality.MEASURES).alias("v")
    base_failed = (F.col("n_words") < 50) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return docs.select("doc_id", verdict).select(
        "doc_id", *(F.col(f"v.{name}") for name in quality.MEASURES), "v.kept",
    ).withColumn("base_failed", base_failed)


@query("""WITH RECURSIVE u AS (SELECT vec_id, label, cast(embedding AS double[]) AS v,
  label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label
  AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.usable AND b.usable
  AND list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM u UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM u JOIN c ON c.a = u.vec_id LEFT JOIN n ON n.a = u.vec_id""")
def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


@query()
def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = lm.learn(docs.filter(fold("doc_id", 7) != 2))
    return lm.score(docs, model).withColumn("held_out", fold("doc_id", 7) == 2)


@query("""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, row_number() OVER () AS r, len(h) // 2 AS n FROM d),
s AS (SELECT r, unnest(range(0, n - 399)) AS i, h FROM n WHERE n >= 400),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM s),
t AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END
  AS opens FROM t),
k AS (SELECT *, sum(opens) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
e AS (SELECT r, span, min(i) AS b, max(i) + 400 AS e FROM k GROUP BY r, span),
q AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS kept_from FROM e),
z AS (SELECT r, cast(sum(e - b) AS bigint) AS n_removed, count(*) AS n_spans,
  string_agg(substr(h, 2 * kept_from + 1, 2 * (b - kept_from)), '' ORDER BY b)
    || substr(any_value(h), 2 * max(e) + 1) AS kept
  FROM q JOIN n USING (r) GROUP BY r)
SELECT doc_id, cast(n AS bigint) AS n_bytes, coalesce(n_removed, 0) AS n_removed,
 coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM n LEFT JOIN z USING (r)""")
def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, sf_dir, "documents"))


@query()
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


@query("""WITH u AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END
    AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
  cast(list_inner_product(a.v, b.v) AS bigint) AS score
  FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (
  PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.other_id AS positive_id, cast(row_number() OVER (
    PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS int) AS rank,
  n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3""")
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", moved))
