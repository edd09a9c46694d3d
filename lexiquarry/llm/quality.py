"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL, scored as sparse dot products.

Tokens are runs of letters, of digits, or of one punctuation character, with
their case. Features are token unigrams and bigrams hashed to ``2 ** BITS``
buckets; a bigram of one token twice also counts in a bucket of its own. A
bucket's value is ``2 * sqrt(its share of the text's n-grams)``, so scores do
not follow the length of a text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lexiquarry.llm import ftrl, wordhash as W

PARAMS = ftrl.Params(bits=18, alpha=1.5, l1=0.2, epochs=6)
#: Labelled rows to learn from, at most.
SAMPLE = 6000

_KIND = np.arange(256)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_KIND[48:58] = 1
_TWICE = np.uint64(12345)


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = W.spans(raw, offsets, _KIND)
    one = W.hashes(raw, starts, ends)
    two, at = W.grams(one, first, 2, lone=False)
    n = np.diff(first)
    doc1, doc2 = np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), np.diff(at))
    same = np.zeros(len(one), bool)
    same[1:] = (one[1:] == one[:-1]) & (doc1[1:] == doc1[:-1])
    doc = np.concatenate((doc1, doc2, doc1[same]))
    value = np.concatenate((one, two, np.full(int(same.sum()), _TWICE)))
    doc, bucket, count = ftrl.summed(doc, value & np.uint64((1 << PARAMS.bits) - 1), PARAMS.bits)
    total = np.bincount(doc, count, minlength=len(n))
    return doc, bucket, 2 * np.sqrt(count / np.maximum(total[doc], 1))


def learn(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from the ``quality`` of labelled rows whose crc32(doc_id as text) mod 3 is not 1."""
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", F.col("quality").alias("label"))
    return ftrl.fit(docs, known, features, PARAMS, SAMPLE)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good quality likelier) and predicted for each row of ``docs``.

    Texts that are null, empty or blank have no features and get the score of
    the bias alone. Repeated rows are scored alike; a null doc_id is kept, not
    held out. Other columns are ignored. An empty table gives an empty result,
    and without usable labels every score is 0.5.
    """
    weights = learn(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = ftrl.score(rows, features, weights, "score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
