"""A training corpus from ``documents``: stages that filter, deduplicate, mix and encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexiquarry.llm import bpe, ftrl, minhash, mixing, quality, toxicity
from lexiquarry.llm.queries import tokenizer_file
from lexiquarry.llm.scratch import Scratch


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _scored(docs: DataFrame, features, weights) -> tuple[DataFrame, str]:
    """``docs`` with a score, and its column, whose name no column of ``docs`` has."""
    name, taken = "score", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return ftrl.score(docs, features, weights, name), name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts get the score of the bias; rows are judged one by one."""
    out, score = _scored(docs, quality.features, quality.learn(docs, _labels(spark, sf_dir)))
    return out.where(F.col(score) >= 0.5).drop(score)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not mark. Without usable labels every score is 0.5 and all stay."""
    features, weights = toxicity.learn(docs, _labels(spark, sf_dir))
    if not weights.any():
        return docs
    out, score = _scored(docs, features, weights)
    return out.where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class, on five-word shingles at similarity 0.8.

    Rows are told apart by their text: those that repeat a doc_id, or have none, take part as others do. Texts without words all stay.
    """
    return minhash.deduplicate(spark, docs, shingle=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as temperature mixing uses them: once at least, small sources up to twice. A null source is one of its own."""
    return mixing.expand(spark, docs, repeats=2.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text decoded from them, for each row; a null text counts as empty."""
    return bpe.encode_decode(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL expresses neither the learned stages nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of ``documents``; an empty table stays empty, columns beside those needed are carried along."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.keep(docs)
            scratch.drop(before)
    return docs
