"""The registered queries of this subpackage, each next to its SQL twin where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import (
    collocations, exact, fingerprints, langid, license_rules, mixing, odd_sketch, pieces, resample, suffix_dedup, topk,
    toxicity, whitening,
)
from textwarden.llm.workers import reachable
from textwarden.plans.registry import Query


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; null without an id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def _remainder_is(key: str, modulus: int, value: int) -> Column:
    return F.coalesce(id_remainder(key, modulus) == value, F.lit(False))


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models from two thirds of the rows with a language; every row is predicted."""
    docs = _documents(spark, sf_dir)
    model = langid.train(docs.filter(id_remainder("doc_id", 3) != 1))
    return langid.predict(docs, model).withColumnRenamed("key", "doc_id").select(
        "doc_id", _remainder_is("doc_id", 3, 1).alias("held_out"), "lang_pred", "score",
        F.size("mixture").alias("n_languages"),
    )


def op2_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents weighed by how much more they look like those labelled good than like all."""
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample.resample(docs, resample.target_rows(docs, labels))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_documents(spark, sf_dir)).drop("spans")


#: Three words, 85 in 100.
_NEAR = odd_sketch.Settings(words=3, least=85)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(_documents(spark, sf_dir), _NEAR).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of four fifths of the ids are learned from; every document is scored."""
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(id_remainder("doc_id", 5) != 0)
    model = toxicity.train(docs, labels)
    return toxicity.score(docs, model).select(
        F.col("key").alias("doc_id"), _remainder_is("doc_id", 5, 0).alias("held_out"), "score", "predicted"
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_documents(spark, sf_dir))


#: The model file, read on the driver.
VOCABULARY_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def op7_sentence_pieces(spark: SparkSession, sf_dir: str, path: str = VOCABULARY_PATH) -> DataFrame:
    """Two distinct segmentations of every whole text, decoded again and held against it."""
    return pieces.round_trip(_documents(spark, sf_dir), pieces.read_vocabulary(path)).withColumnRenamed("key", "doc_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents is the history that is indexed, the other half is looked up."""
    return exact.exact_dedup(_documents(spark, sf_dir), id_remainder("doc_id", 2) == 0)


_EXACT_SQL = """
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.scan_licenses(_documents(spark, sf_dir))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = reachable(spark).read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, lambda id_: id_ % 20 == 0)


_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(_documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


#: Every phrase is counted, frequent or not: SQL need not know how to leave some out.
_COLLOCATION_SQL = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k:
         list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) AS ph FROM w
), f AS (
  SELECT lang, ph, count(*) AS f FROM g GROUP BY ALL
), total AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, ph, f AS a FROM f WHERE f >= 30 AND len(ph) >= 2
), inner_ AS (
  SELECT lang, a, len(ph) AS size, unnest(flatten(list_transform(range(2, len(ph)), lambda k:
         list_transform(range(1, len(ph) - k + 2), lambda i: ph[i:i + k - 1])))) AS ph FROM c
), best AS (
  SELECT lang, ph, max(a) AS b FROM inner_ GROUP BY ALL
), alone AS (
  SELECT c.* FROM c LEFT JOIN best USING (lang, ph) WHERE b IS NULL OR 100::HUGEINT * b < 80::HUGEINT * a
), cut AS (
  SELECT lang, ph, a, unnest(range(1, len(ph))) AS k FROM alone
), scored AS (
  SELECT cut.lang, cut.ph, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.ph = cut.ph[:k] JOIN f y ON y.lang = cut.lang AND y.ph = cut.ph[k + 1:]
), lowest AS (
  SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, score FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score::BIGINT AS score
FROM lowest JOIN total USING (lang) QUALIFY rank <= 2000
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(reachable(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_language_mixture": Query(op1_language_mixture),
    "op2_importance_resample": Query(op2_importance_resample),
    "op3_repeated_passages": Query(op3_repeated_passages),
    "op4_near_duplicates": Query(op4_near_duplicates),
    "op5_mixing": Query(op5_mixing),
    "op6_toxicity": Query(op6_toxicity),
    "op7_sentence_pieces": Query(op7_sentence_pieces),
    "op8_exact_dedup": Query(op8_exact_dedup, _EXACT_SQL),
    "op9_license_scan": Query(op9_license_scan),
    "op10_top_k": Query(op10_top_k, _TOP_K_SQL),
    "op11_document_fingerprints": Query(op11_document_fingerprints),
    "op12_collocations": Query(op12_collocations, _COLLOCATION_SQL),
    "op13_whitening": Query(op13_whitening),
}
