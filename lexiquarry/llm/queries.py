"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiquarry.llm import bpe, egojoin, licenses, minhash, mixing, quality, rules, sharding, toxicity, unigram


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"), shingle=2, percent=80)


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the public tokenizers, where they are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return egojoin.near_duplicates(spark, _table(spark, sf_dir, "embeddings"), cosine=0.9)


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents"), repeats=2.0)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(spark, _table(spark, sf_dir, "documents"), shards=24)


_QUERIES = (
    op1_embedding_near_dedup,
    op2_bpe_encode_decode,
    op3_license_scan,
    op4_quality_rules,
    op5_toxicity,
    op6_token_counts,
    op7_minhash_near_dedup,
    op8_temperature_mixing,
    op9_quality_classifier,
    op10_bounded_ring_sharding,
)


_CLASSES = """e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(id, other) AS (SELECT id, id FROM ids UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.other),
  least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""
_OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
  g AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v
    WHERE len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(x, lambda y: y <> 0)) > 0),
  links AS (SELECT l.vec_id AS a, r.vec_id AS b FROM g l JOIN g r ON l.vec_id < r.vec_id AND len(l.x) = len(r.x) AND list_dot_product(l.x, r.x) / (l.size * r.size) >= 0.9),
  ids AS (SELECT vec_id AS id FROM embeddings), {_CLASSES}, n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
  SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, component_id = id AS kept FROM least LEFT JOIN n ON n.a = id"""
_OP7 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
  t AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
  links AS (SELECT l.doc_id AS a, r.doc_id AS b FROM t l JOIN t r ON l.s = r.s AND l.doc_id < r.doc_id GROUP BY l.doc_id, r.doc_id, l.n, r.n HAVING 100 * count(*) >= 80 * (l.n + r.n - count(*))),
  ids AS (SELECT doc_id AS id FROM documents), {_CLASSES}
  SELECT id AS doc_id, len(s) AS n_shingles, component_id, component_id = id AS kept FROM least JOIN s ON s.doc_id = id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators without learning, tokenizers or a ring; they are small tables' checks, pair by pair."""
    return {"op1_embedding_near_dedup": _OP1, "op7_minhash_near_dedup": _OP7, "op8_temperature_mixing": mixing.SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}
