"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash alone cannot find them: at that similarity two fingerprints of 64 bits differ in ten bits on average, and balls of half
that radius have millions of variants. So candidates are texts that share a band: five minima of their shingles under five
orders. Of 24 bands, two texts of similarity 0.8 share none with a probability of 7 in 100,000, of 0.85 with 2 in a million;
nothing else is lost. Candidates are compared by their whole sets, so no link is invented.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.bloom import Bloom
from quarry.llm.common import LOWER, WORDS, Batches, column_bytes, limit_batches, stored
from quarry.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 24, 5
#: Rounds in which texts are compared with one of each meeting only, before all that still differ in component are.
STARS = 1
#: Pairs that a task compares before it yields candidates.
_PAIRS = 1 << 20
_BUCKETS = 128
_MIX = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) | np.uint64(1)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; fewer words than `width` are one shingle, no words none."""
    words = WORDS.findall(text.translate(LOWER))
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(h) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def bands(s: np.ndarray) -> np.ndarray:
    """`BANDS` keys (int64) of a set of shingles; none of an empty set."""
    if not len(s):
        return s
    s = s.view(np.uint64)
    s = s ^ s >> np.uint64(32)
    least = np.min([(s[i : i + 1024, None] * _MIX).min(axis=0) for i in range(0, len(s), 1024)], axis=0).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = (out ^ least[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def signature(s: np.ndarray) -> bytes:
    """How many shingles fall into each bucket, at most 255."""
    return np.minimum(np.bincount(s & _BUCKETS - 1, minlength=_BUCKETS), 255).astype(np.uint8).tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sets of 0.8 or more."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _counts(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, _BUCKETS)


def _may_be_similar(n: np.ndarray, m: np.ndarray, counts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """By sizes, and since a similarity of 0.8 leaves (n + m) / 9 or fewer shingles in only one of two sets."""
    differ = np.abs(counts.astype(np.int16) - others.astype(np.int16)).sum(axis=1, dtype=np.int64)
    return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (9 * differ <= n + m)


def _meetings(batches: Batches) -> Iterator[list[np.ndarray]]:
    """Columns of whole keys at a time, of rows (key, d, n, component, h) sorted by key."""
    held: list[pa.RecordBatch] = []

    def columns(t: pa.Table) -> list[np.ndarray]:
        return [*(t[i].to_numpy() for i in range(4)), _counts(t["h"])]

    for b in batches:
        if not b.num_rows:
            continue
        first, last = b.column(0)[0].as_py(), b.column(0)[-1].as_py()
        held.append(b)
        if first != last or held[0].column(0)[0].as_py() != last:
            t = pa.Table.from_batches(held)
            cut = int(np.searchsorted(t["key"].to_numpy(), last))
            yield columns(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield columns(pa.Table.from_batches(held))


def _all_pairs(batches: Batches) -> Batches:
    """Pairs (x < y) that meet, differ in component and may be similar."""
    xs, ys, waiting = [], [], 0

    def out() -> pa.RecordBatch:
        pairs = np.unique(np.stack([np.concatenate(xs), np.concatenate(ys)]), axis=1)
        return pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["x", "y"])

    for key, d, n, component, counts in _meetings(batches):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
        for s, e in zip(starts, np.append(starts[1:], len(key)), strict=True):
            for i in range(s, e - 1):
                r = np.flatnonzero(component[i + 1 : e] != component[i]) + i + 1
                other = d[r[_may_be_similar(n[r], n[i], counts[r], counts[i])]]
                if len(other):
                    xs.append(np.minimum(other, d[i]))
                    ys.append(np.maximum(other, d[i]))
                    waiting += len(other)
                if waiting >= _PAIRS:
                    yield out()
                    xs, ys, waiting = [], [], 0
    if xs:
        yield out()


def _sets(batches: Batches) -> Batches:
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([shingles(t).tobytes() for t in column_bytes(b.column(1))], pa.binary())], ["d", "s"])


def _verified(batches: Batches) -> Batches:
    for b in batches:
        a, c = ([np.frombuffer(x, np.int64) for x in b.column(i).to_pylist()] for i in (2, 3))
        ok = pa.array([similar(x, y) for x, y in zip(a, c, strict=True)], pa.bool_())
        yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])


def text_key(text: Column) -> Column:
    """64 bits that stand for a text; null is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _not_ruled_out(pairs: DataFrame, known: DataFrame, of: DataFrame) -> DataFrame:
    """Pairs (x, y) whose components differ and that sizes and signatures don't rule out."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                ok = pa.array(_may_be_similar(b.column(2).to_numpy(), b.column(3).to_numpy(), _counts(b.column(4)), _counts(b.column(5))))
                yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok)], ["x", "y"])

    apart = pairs
    for c in "xy":
        apart = apart.join(of.select(F.col("d").alias(c), F.col("component").alias(f"c{c}")), c)
    apart = apart.where("cx <> cy").select("x", "y")
    for c in "xy":
        apart = apart.join(known.select(F.col("d").alias(c), F.col("n").alias(f"n{c}"), F.col("h").alias(f"h{c}")), c)
    return apart.select("x", "y", "nx", "ny", "hx", "hy").mapInArrow(run, "x long, y long")


def merge_similar(docs: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """`d, component` of each text: those of `known` with the components that similar texts connect merged.

    `known` (d, component, n: long, h: binary, bands: array<long>) has a row for each text of `docs`, by `text_key`, with the
    number of its shingles, their `signature` and `bands`. A merged component has the smallest of its labels. In a meeting of
    a band, texts are first compared with one of them only, and components merged; meetings whose texts still differ in
    component are then compared in all. No meeting is brought together for that before.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(text_key(F.col(text_col)).alias("d"), F.col(text_col).alias("text"))
    of = known.select("d", "component")

    def mixed(rows: DataFrame) -> DataFrame:
        ends = [f(c).alias(f"{name}_{c}") for c in ("d", "component") for f, name in ((F.min, "least"), (F.max, "most"))]
        return rows.groupBy("key").agg(*ends).where("least_component <> most_component")

    rows = known.select(F.explode("bands").alias("key"), "d", "component")
    # Keys are stored before rows are joined with them: a join whose stage also aggregates could not split a key of very many rows.
    keys = stored(mixed(rows).select("key"), "mixed")
    rows = stored(rows.join(keys, "key", "left_semi").select("key", "d"), "meetings")
    for turn in range(STARS + 1):
        placed = rows.join(of, "d")
        still = stored(mixed(placed), "mixed")
        if turn < STARS:
            centre = still.select("key", F.col("most_d" if turn % 2 else "least_d").alias("e"))
            pairs = rows.join(centre, "key").where("d <> e").select(F.least("d", "e").alias("x"), F.greatest("d", "e").alias("y")).distinct()
            pairs = _not_ruled_out(pairs, known, of)
        else:
            met = placed.join(still.select("key"), "key", "left_semi").join(known.select("d", "n", "h"), "d").select("key", "d", "n", "component", "h")
            pairs = met.repartition(n, "key").sortWithinPartitions("key", "d").mapInArrow(_all_pairs, "x long, y long").distinct()
        pairs = stored(pairs, "candidates")
        if not pairs.take(1):
            continue
        wanted = stored(pairs.select(F.col("x").alias("d")).union(pairs.select("y")).distinct(), "wanted")
        sets = Bloom(wanted, "d").maybe(texts, "d").join(wanted, "d", "left_semi").groupBy("d").agg(F.first("text").alias("text")).mapInArrow(_sets, "d long, s binary")
        sets = stored(sets, "shingles")
        both = pairs.join(sets.toDF("x", "a"), "x").join(sets.toDF("y", "b"), "y").select("x", "y", "a", "b")
        links = both.mapInArrow(_verified, "u long, v long")
        u, v = (of.select(F.col("d").alias(c), F.col("component").alias(f"c{c}")) for c in "uv")
        merged = connected_components(links.join(u, "u").join(v, "v").select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        of = of.join(merged, of["component"] == merged["node"], "left").select("d", F.coalesce(merged["component"], of["component"]).alias("component"))
        of = stored(of, "merged")
    return of
