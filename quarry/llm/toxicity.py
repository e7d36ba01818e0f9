"""Toxicity by non-negative positive-unlabelled learning: a linear numpy classifier from confirmed toxic and unlabelled texts.

With the class prior p, positives P and unlabelled texts U, the risk is p E_P[l(+)] + max(0, E_U[l(-)] - p E_P[l(-)]).
Where the part in max() turns negative, the classifier has begun to memorise; the update then goes the other way.

All unlabelled texts are learnt from: groups of about `GROUP` of them, dealt by hash, are each fitted with all positives in a
task of their own, and the mean of the models, weighted by their texts, is the classifier.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import LOWER, WORD, Batches, column_bytes, limit_batches
from quarry.llm.quality import score_texts, sigmoid, training_texts

BITS = 18
#: The most confirmed toxic texts that training gathers: the first by hash of doc_id.
POSITIVES = 3000
#: Unlabelled texts that are fitted together, about.
GROUP = 8000
#: Weights are added up as whole multiples of this, so that their order changes nothing.
_UNIT = 2.0**-18
THRESHOLD = 0.3
#: Lengths in bytes of the beginnings of words that are features besides the words.
PREFIXES = (5, 7)
MANY = 3
#: Features in fewer positive texts than this number and this share of them have no weight.
LEAST_TEXTS, LEAST_SHARE = 4, 0.01


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


def word_buckets(text: bytes, bits: int = BITS) -> np.ndarray:
    """The buckets of the distinct words of a whole text and of their first bytes; a bucket seen `MANY` times or more has a second one."""
    words = WORD.findall(text.translate(LOWER))
    if not words:
        return np.zeros(0, np.int64)
    whole = np.fromiter(map(crc32, words), np.uint64, len(words))
    begun = np.array(words, "S8").view("<u8")
    found = [whole] + [(begun & np.uint64((1 << 8 * n) - 1))[begun >> np.uint64(8 * n) > 0] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n) for n in PREFIXES]
    features, counts = np.unique(np.concatenate(found), return_counts=True)
    features = np.concatenate([features, features[counts >= MANY] ^ np.uint64(0x5BD1E9955BD1E995)])
    mixed = features * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ mixed >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)


def scores(texts: list[bytes], model: Model) -> np.ndarray:
    bits = len(model.weights).bit_length() - 1
    return sigmoid(np.array([model.bias + float(model.weights[word_buckets(t, bits)].sum(dtype=float)) for t in texts]).reshape(len(texts)))


def known_buckets(positive: list[np.ndarray], size: int) -> np.ndarray:
    """The buckets that may have a weight, ascending."""
    if not positive:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.bincount(np.concatenate(positive), minlength=size) >= min(max(LEAST_TEXTS, LEAST_SHARE * len(positive)), len(positive)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS, epochs: int = 12, batch: int = 512, rate: float = 0.2, l1: float = 1e-3, seed: int = 1) -> Model:
    """Minimise the non-negative risk under the logistic loss by mini-batches of AdaGrad steps; rows are sets of buckets.

    Without positives or without unlabelled rows there is nothing to learn: every text scores `prior`.
    """
    size = 1 << bits
    start = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    w, b = np.zeros(size), start
    if not positive or not unlabelled:
        return Model(w.astype(np.float32), b)
    known = np.zeros(size, bool)
    known[known_buckets(positive, size)] = True
    rows = [r[known[r]] for r in positive + unlabelled]
    squares, square_b = np.full(size, 1e-6), 1e-6
    mean_w, mean_b, averaged = np.zeros(size), 0.0, 0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        steps = max(1, -(-len(unlabelled) // batch))
        us = np.array_split(rng.permutation(len(unlabelled)) + len(positive), steps)
        ps = [rng.integers(0, len(positive), max(1, min(len(positive), batch // 2))) for _ in us]
        for p, u in zip(ps, us, strict=True):
            at = np.concatenate([p, u])
            sizes = np.fromiter((len(rows[i]) for i in at), np.int64, len(at))
            index = np.concatenate([rows[i] for i in at])
            of = np.repeat(np.arange(len(at)), sizes)
            g = sigmoid(b + np.bincount(of, w[index], len(at)))
            is_p = np.arange(len(at)) < len(p)
            loss_as_negative = -np.log(np.clip(1 - g, 1e-12, 1))
            negative_part = loss_as_negative[~is_p].mean() - prior * loss_as_negative[is_p].mean()
            by_u, by_p = np.where(is_p, 0, g / len(u)), np.where(is_p, prior * g / len(p), 0)  # gradients of l(-)
            d = np.where(is_p, prior * (g - 1) / len(p), 0) + by_u - by_p if negative_part >= 0 else by_p - by_u
            step = np.bincount(index, d[of], size)
            squares += step * step
            eta = rate / np.sqrt(squares)
            w -= eta * step
            w = np.sign(w) * np.maximum(np.abs(w) - eta * l1, 0)
            square_b += d.sum() ** 2
            b -= rate * d.sum() / np.sqrt(square_b)
            if epoch >= epochs // 2:  # the mean of the later steps is steadier than the last
                averaged += 1
                mean_w += (w - mean_w) / averaged
                mean_b += (b - mean_b) / averaged
    return Model(mean_w.astype(np.float32), float(mean_b))


def _positive_sets(docs: DataFrame, known: DataFrame, positives: int, bits: int) -> list[np.ndarray]:
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 1").select("doc_id").distinct().orderBy(*order).limit(positives).withColumn("p", F.lit(True))

    def run(batches: Batches) -> Batches:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([word_buckets(t, bits).astype(np.uint32).tobytes() for t in column_bytes(b.column(1))], pa.binary())], ["doc_id", "buckets"])

    rows = training_texts(docs, chosen, ["p"]).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, buckets binary")
    return [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows.orderBy(*order).toArrow()["buckets"].to_pylist()]


def _fit_groups(positive, known, prior: float, bits: int):
    """Of rows (g, order, buckets) sorted by group: each group's weights, as multiples of `_UNIT` times the group's rows; bucket -1 is the bias, -2 counts the rows."""

    def fitted(rows: list[bytes]) -> pa.RecordBatch:
        places = known.value  # models of the known buckets alone, by their place
        model = fit_nnpu(positive.value, [np.frombuffer(r, np.uint32).astype(np.int64) for r in rows], prior, max(len(places), 1).bit_length())
        used = np.flatnonzero(model.weights)
        values = np.concatenate([model.weights[used].astype(float), [model.bias]])
        whole = np.append(np.round(values / _UNIT).astype(np.int64) * len(rows), len(rows))
        return pa.record_batch([pa.array(np.concatenate([places[used], [-1, -2]])), pa.array(whole)], ["bucket", "weight"])

    def run(batches: Batches) -> Batches:
        now, rows = None, []
        for b in batches:
            for g, buckets in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g != now and rows:
                    yield fitted(rows)
                    rows = []
                now = g
                rows.append(buckets)
        if rows:
            yield fitted(rows)

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", keep: str = "true", positives: int = POSITIVES, bits: int = BITS, group: int = GROUP) -> Model:
    """Fit from documents labelled 1 and from unlabelled documents, for which the SQL condition `keep` on doc_id holds.

    Labels of 0 are never read as negatives; they only help to estimate the class prior, the share of 1 among labels kept.
    Every document for which `keep` holds serves as unlabelled, rows without an id and repeated rows too. The driver gathers
    the sets of buckets of at most `positives` texts, and a weight for each of the buckets that they have.
    """
    spark = docs.sparkSession
    labelled = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull()).where(keep).select("doc_id", F.col(label_col).alias("y"))
    prior = float(labelled.agg(F.avg("y")).first()[0] or 0.0)
    limit_batches(spark)
    sets = _positive_sets(docs, labelled, positives, bits)
    known = known_buckets(sets, 1 << bits)
    unlabelled = docs.where(f"coalesce({keep}, true)").select("text", F.xxhash64("doc_id", "text", F.monotonically_increasing_id()).alias("at"))  # rows that repeat are dealt apart
    n = unlabelled.count()
    if not len(known) or not n:
        return fit_nnpu([], [], prior, bits)
    groups = -(-n // group)
    place = np.full(1 << bits, -1, np.int32)
    place[known] = np.arange(len(known))

    def among_known(found: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = place[found]
        return at[at >= 0]

    places = spark.sparkContext.broadcast(known)
    own = spark.sparkContext.broadcast([among_known(s, place).astype(np.int64) for s in sets])
    lookup = spark.sparkContext.broadcast(place)

    def run(batches: Batches) -> Batches:
        for b in batches:
            texts = column_bytes(b.column(0))
            out = [among_known(word_buckets(t, bits), lookup.value).astype(np.uint32).tobytes() for t in texts]
            yield pa.record_batch([pa.array(b.column(1).to_numpy() % groups), b.column(1), pa.array(out, pa.binary())], ["g", "at", "buckets"])

    dealt = unlabelled.mapInArrow(run, "g long, at long, buckets binary")
    m = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fitted = dealt.repartition(m, "g").sortWithinPartitions("g", "at", "buckets").mapInArrow(_fit_groups(own, places, prior, bits), "bucket long, weight long")
    total = {r.bucket: r.weight for r in fitted.groupBy("bucket").agg(F.sum("weight").alias("weight")).collect()}
    rows = total.pop(-2)
    bias = total.pop(-1) / rows * _UNIT
    weights = np.zeros(1 << bits, np.float32)
    for bucket, weight in total.items():
        weights[bucket] = weight / rows * _UNIT
    return Model(weights, bias)


def classify_toxicity(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """`columns` of each row and its `score` in 0 to 1: the likelihood of being toxic, whole texts, null as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return score_texts(docs, docs.sparkSession, lambda texts: scores(texts, shared.value), columns)
