"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.common import Batches, column_bytes, limit_batches, unused_name, word_hashes

BITS = 18
NGRAMS = 2
#: The most labelled rows that training gathers: the first by hash of doc_id. Scoring is never limited.
TRAIN_ROWS = 6000
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """`weights` has a weight for each of 2**bits buckets; `bias` stands apart."""

    weights: np.ndarray
    bias: float
    ngrams: int = NGRAMS


def ngram_buckets(text: bytes, ngrams: int = NGRAMS, bits: int = BITS) -> np.ndarray:
    """Bucket of every word n-gram of the whole text, n from 1 to `ngrams`; an n-gram of one repeated word also has its order's own bucket."""
    words = word_hashes(text).astype(np.uint64)
    out, gram = [], np.zeros(len(words), np.uint64)
    for n in range(1, min(ngrams, len(words)) + 1):
        gram = (gram[: len(words) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ words[n - 1 :]
        mixed = gram * np.uint64(0xBF58476D1CE4E5B9)
        out.append((mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits))
        if n > 1:
            same = np.all([words[i : len(words) - n + 1 + i] == words[: len(words) - n + 1] for i in range(1, n)], axis=0)
            out.append(np.full(int(same.sum()), n, np.uint64))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def sparse_rows(texts: list[bytes], ngrams: int = NGRAMS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, bucket and value of each entry: counts, scaled so that each non-empty row has length 1."""
    parts = [ngram_buckets(t, ngrams, bits) for t in texts]
    keys = np.concatenate([(np.int64(i) << bits) | p for i, p in enumerate(parts)]) if parts else np.zeros(0, np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    rows = keys >> bits
    norms = np.sqrt(np.bincount(rows, counts.astype(float) ** 2, len(texts)))
    return rows, keys & ((1 << bits) - 1), counts / norms[rows]


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    """Sparse dot products through the logistic function; an empty text scores by the bias alone."""
    rows, buckets, values = sparse_rows(texts, model.ngrams, len(model.weights).bit_length() - 1)
    return sigmoid(model.bias + np.bincount(rows, model.weights[buckets] * values, len(texts)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, ngrams: int = NGRAMS, epochs: int = 5, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001) -> Model:
    """Train on (buckets, values, label) rows in the order given, an update per row; without rows the model is neutral.

    Follow-the-regularised-leader: each coordinate keeps its sum of shifted gradients z and of squared gradients n, and its
    weight is the minimiser of the regularised linearised loss so far.
    """
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at: np.ndarray | slice, penalty: float = l1) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - penalty, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for buckets, values, label in rows:
            at, x = np.append(buckets, size), np.append(values, 1.0)
            w = weights(at)
            g = (sigmoid(np.dot(w, x)) - label) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    return Model(w[:size].astype(np.float32), float(w[size]), ngrams)


def training_texts(docs: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """The texts of the bounded table `chosen` (doc_id and `columns`), each id once. `chosen` is small enough to broadcast by construction."""
    found = docs.select(F.col("doc_id").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return found.select("doc_id", "text", *columns).dropDuplicates(["doc_id"])


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", keep: str = "true", max_rows: int = TRAIN_ROWS, bits: int = BITS, ngrams: int = NGRAMS) -> Model:
    """Fit on the labelled documents for which the SQL condition `keep` (on doc_id) holds, `max_rows` at most.

    Rows with a null label or id teach nothing. Features are hashed on the executors; the driver receives `max_rows`
    sparse rows at most and makes the updates in order of the hash of doc_id.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).where(keep)
    chosen = usable.select("doc_id", F.col(label_col).alias("label")).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    limit_batches(docs.sparkSession)

    def run(batches: Batches) -> Batches:
        for b in batches:
            row, bucket, value = sparse_rows(column_bytes(b.column(1)), ngrams, bits)
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            blobs = [(bucket[i:j].astype(np.uint32).tobytes(), value[i:j].astype(np.float32).tobytes()) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.record_batch([b.column(0), b.column(2), pa.array([x for x, _ in blobs], pa.binary()), pa.array([x for _, x in blobs], pa.binary())], ["doc_id", "label", "buckets", "vals"])

    rows = training_texts(docs, chosen, ["label"]).select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int")).mapInArrow(run, "doc_id long, label int, buckets binary, vals binary")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    views = [[np.frombuffer(x.as_buffer(), kind) for x in got[name]] for name, kind in (("buckets", np.uint32), ("vals", np.float32))]  # no copies on the driver
    model = fit_ftrl(list(zip(*views, got["label"].to_pylist(), strict=True)), bits, ngrams)
    del views, got
    pa.default_memory_pool().release_unused()  # the driver goes on for long
    return model


def score_texts(docs: DataFrame, spark: SparkSession, scorer, columns: list[str]) -> DataFrame:
    """`columns` of `docs` as they are and `score` (double) of the whole text of each row, by `scorer(list of bytes)`.

    A column of `docs` already named score is replaced. No shuffle: rows stay in their partitions.
    """
    limit_batches(spark)
    own = unused_name(columns, "__text")
    kept = docs.select(*[c for c in columns if c != "score"], F.col("text").alias(own))
    schema = kept.drop(own).withColumn("score", F.lit(0.0)).schema

    def run(batches: Batches) -> Batches:
        for b in batches:
            score = scorer(column_bytes(b.column(b.num_columns - 1)))
            yield pa.record_batch([*b.columns[:-1], pa.array(score, pa.float64())], [*b.schema.names[:-1], "score"])

    return kept.mapInArrow(run, schema)


def classify_quality(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """`columns` of each row and its `score` in 0 to 1: the likelihood of good quality, whole texts, null as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits weights, whatever the input
    return score_texts(docs, docs.sparkSession, lambda texts: scores(texts, shared.value), columns)
