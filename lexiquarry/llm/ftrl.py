"""Logistic regression on hashed sparse features, trained by FTRL-Proximal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from lexiquarry.llm import wordhash as W
from lexiquarry.llm.scratch import small_batches


@dataclass(frozen=True)
class Params:
    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    epochs: int = 4


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, p: Params, seed: int = 5) -> np.ndarray:
    """Weights (the last is the bias) from rows of (bucket indices, values).

    Rows may be empty; with one class or no rows the bias alone is learned.
    The order of the updates is a seeded permutation per epoch, so equal input
    gives equal weights.
    """
    size = 1 << p.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(seed)
    data = [(np.append(i, size), np.append(v, 1.0)) for i, v in rows]
    for _ in range(p.epochs):
        for k in order.permutation(len(data)):
            i, v = data[k]
            zi, ni = z[i], n[i]
            l1 = np.full(len(i), p.l1)
            l1[-1] = 0
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))
            g = (1.0 / (1.0 + np.exp(-min(35.0, max(-35.0, float(w @ v))))) - labels[k]) * v
            up = ni + g * g
            z[i] += g - (np.sqrt(up) - np.sqrt(ni)) / p.alpha * w
            n[i] = up
    l1 = np.full(size + 1, p.l1)
    l1[-1] = 0
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2))


# --- Spark side -----------------------------------------------------------------------------

# A featuriser maps (UTF-8 bytes, offsets of the texts) to three arrays: text index, bucket and value.


def _grouped(features, raw, offsets):
    doc, bucket, value = features(raw, offsets)
    at = np.searchsorted(doc, np.arange(len(offsets)))
    return bucket.astype(np.int32), value.astype(np.float32), at


def _featured(features):
    @W.released
    def run(batches):
        for batch in batches:
            raw, offsets = W.texts(batch.column("text"))
            for a, b in W.chunks(offsets):
                bucket, value, at = _grouped(features, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                cut = lambda x: pa.array([x[at[i] : at[i + 1]].tobytes() for i in range(b - a)], pa.binary())
                own = batch.select(["doc_id", "label", "h"]).slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, cut(bucket), cut(value)], ["doc_id", "label", "h", "i", "v"])

    return run


def _trained(params: Params):
    @W.released
    def run(batches):
        rows = []
        for batch in batches:
            for d, y, i, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((d, y, np.frombuffer(i, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(float)))
        rows.sort(key=lambda r: r[0])
        w = train([(i, v) for _, _, i, v in rows], np.array([y for _, y, _, _ in rows], float), params)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype(np.float32).tobytes()], pa.binary())], ["w"])

    return run


def fit(docs: DataFrame, labels: DataFrame, features, params: Params, sample: int) -> np.ndarray:
    """Learn from at most ``sample`` rows of ``labels(doc_id, label)``, those of lowest id hash.

    The bound makes the join's broadcast side and the one training task safe at
    any input size. Null ids and labels are ignored; of several labels for an
    id the largest counts, and of several texts the one of lowest hash.
    """
    chosen = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text", F.xxhash64("text").alias("h"))
    table = small_batches(rows).mapInArrow(_featured(features), "doc_id long, label int, h long, i binary, v binary")
    table = table.groupBy("doc_id").agg(F.min(F.struct("h", "label", "i", "v")).alias("x")).select("doc_id", "x.label", "x.i", "x.v")
    got = table.repartition(1).mapInArrow(_trained(params), "w binary").collect()
    return np.frombuffer(bytes(got[0][0]), np.float32).astype(float) if got else np.zeros((1 << params.bits) + 1)


def _scored(features, weights, name: str):
    @W.released
    def run(batches):
        w = weights.value
        for batch in batches:
            raw, offsets = W.texts(batch.column("text"))
            out = np.empty(batch.num_rows)
            for a, b in W.chunks(offsets):
                doc, bucket, value = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out[a:b] = sigmoid(np.bincount(doc, w[bucket] * value, minlength=b - a) + w[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return run


def score(docs: DataFrame, features, weights: np.ndarray, name: str) -> DataFrame:
    """``docs`` with the column ``name``: the probability of label 1 for ``text``."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    return small_batches(docs).mapInArrow(_scored(features, sent, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def summed(doc: np.ndarray, bucket: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, bucket) in order, and how often each occurs."""
    key = np.sort((doc.astype(np.int64) << bits) | bucket.astype(np.int64))
    if not len(key):
        return key, key, key
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[at] >> bits, key[at] & ((1 << bits) - 1), np.diff(np.append(at, len(key)))
