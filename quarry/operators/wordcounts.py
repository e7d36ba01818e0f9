"""Words counted row by row over Arrow batches; what leaves a task is small, so texts and their words are never shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, DoubleType, StringType, StructField, StructType

from quarry.functions import text as T
from quarry.operators.nearest import rounded

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: The letters beyond ASCII whose lower case (of single characters, as in the SQL) is ASCII: a dotted I and the Kelvin sign.
_WIDE = {"\u0130": "i", "\u212a": "k"}
_WIDE_BYTES = [(k.encode(), v.encode()) for k, v in _WIDE.items()]
_WORD = re.compile(rb"[a-z0-9]+")
_LONG_WORD = re.compile(rb"[a-z0-9]{3,}")
_STOP = [w.encode() for w in T.STOPWORDS]
#: Rows that a task holds before it passes them on.
_HELD = 100_000
#: Scores that a task makes at once.
_CELLS = 1_000_000


def lowered(text: bytes) -> bytes:
    text = text.translate(_LOWER)
    for k, v in _WIDE_BYTES:
        text = text.replace(k, v)
    return text


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(lowered(text))


def words_of(text: str) -> Column:
    """The same as a column."""
    return T.words(F.translate(text, "".join(_WIDE), "".join(_WIDE.values())))


def texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of one row after the other; null is empty."""
    return (v.as_py() or b"" for v in column.cast(pa.large_binary()))


def top_words(text: bytes, limit: int) -> list[bytes]:
    """The most frequent words of three letters or more, stopwords left out, ties in alphabetical order; in no order."""
    counts = Counter(_LONG_WORD.findall(lowered(text)))
    for w in _STOP:
        counts.pop(w, None)
    if len(counts) <= limit:
        return list(counts)
    least = sorted(counts.values())[-limit]
    many = [w for w, n in counts.items() if n > least]
    return many + sorted(w for w, n in counts.items() if n == least)[: limit - len(many)]


def own_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose doc_id no other row has, and the others if there are any. Only ids are shuffled to find out."""
    shared = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id"))
    if shared.isEmpty():
        return docs, None
    same = docs["doc_id"].eqNullSafe(shared["__id"])
    return docs.join(shared, same, "left_anti"), docs.join(shared, same, "left_semi")


def top_words_used(docs: DataFrame, limit: int = 12) -> DataFrame:
    """`lang, source, word`, distinct: the top words of the documents of each language and source; rows with one doc_id are ranked together."""
    own, shared = own_ids(docs)
    kinds = [docs.schema["lang"], docs.schema["source"]]
    out = StructType([*kinds, StructField("word", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()

        def rows() -> pa.RecordBatch:
            columns = zip(*seen, strict=True)
            arrays = [pa.array(c, k) for c, k in zip(columns, [*types, pa.binary()], strict=True)]
            return pa.RecordBatch.from_arrays([*arrays[:2], arrays[2].cast(pa.string())], ["lang", "source", "word"])

        for batch in batches:
            types = [batch.column(c).type for c in ("lang", "source")]
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts(batch.column("text")), strict=True):
                seen.update((lang, source, w) for w in top_words(text, limit))
                if len(seen) > _HELD:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    used = own.select("lang", "source", "text").mapInArrow(run, out)
    if shared is not None:
        found = shared.select("doc_id", "lang", "source", F.explode(F.filter(words_of("text"), lambda w: (F.length(w) >= 3) & ~w.isin(T.STOPWORDS))).alias("word"))
        ranked = found.groupBy("doc_id", "lang", "source", "word").agg(F.count("*").alias("n"))
        best = Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "word", "lang", "source")
        used = used.union(ranked.withColumn("p", F.row_number().over(best)).where(F.col("p") <= limit).select("lang", "source", "word"))
    return used.distinct()


def document_counts(docs: DataFrame, vocabulary: list[str]) -> tuple[int, int, dict[str, int]]:
    """Of the documents that have words: their number, the sum of their lengths, and in how many each word of the vocabulary is."""
    index = {w.encode(): i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        found: Counter = Counter()
        for batch in batches:
            for text in texts(batch.column("text")):
                if w := words(text):
                    n += 1
                    length += len(w)
                    found.update(set(map(index.get, w)))
        found.pop(None, None)
        # The totals go under -1 and -2.
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *found], pa.int64()), pa.array([n, length, *found.values()], pa.int64())], ["i", "n"])

    sums = {r.i: r.n for r in docs.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return sums.pop(-1, 0), sums.pop(-2, 0), {vocabulary[i]: n for i, n in sums.items()}


def best_scored(docs: DataFrame, query_ids: list, query_id: DataType, asked: list[tuple[int, str, float]], mean_length: float, k1: float, b: float, top: int) -> DataFrame:
    """`query_id, doc_id, score`: of each task, the `top` documents of each query by BM25, equals by id, nulls last.

    `asked` has the queries' places in `query_ids`, their words and weights (times the inverse document frequency). A task
    scores documents together while the table of documents and queries, and the products to add, are below `_CELLS`.
    """
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, w, _ in asked}))}
    index = {w.encode(): i for w, i in vocabulary.items()}
    rows = sorted((vocabulary[w], q, x) for q, w, x in asked)
    of_word, of_query = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    weight = np.array([r[2] for r in rows])
    n_of = np.bincount(of_word, minlength=len(vocabulary))
    starts = np.cumsum(n_of) - n_of
    n_queries = len(query_ids)
    out = StructType([StructField("query_id", query_id), StructField("doc_id", docs.schema["doc_id"].dataType), StructField("score", DoubleType())])
    query_type = to_arrow_type(query_id)

    def scores(lengths: list[int], counts: list[list[tuple[int, int]]]) -> np.ndarray:
        doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        word, tf = np.array([x for c in counts for x in c], np.int64).reshape(-1, 2).T
        under = tf + k1 * (1 - b + b * np.array(lengths)[doc] / mean_length)
        n = n_of[word]
        at = np.repeat(starts[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        part = weight[at] * np.repeat(tf, n) * (k1 + 1) / np.repeat(under, n)
        # Added in the order of the words, so that equal documents have equal sums.
        return np.bincount(np.repeat(doc, n) * n_queries + of_query[at], part, len(counts) * n_queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: tuple | None = None
        least = np.zeros(n_queries)

        def add(ids: list, kind: pa.DataType, lengths: list[int], counts: list) -> None:
            nonlocal best
            total = scores(lengths, counts)
            at = np.flatnonzero((total > 0) & (total.reshape(-1, n_queries) >= least - 2e-6).ravel())
            d, q = np.divmod(at, n_queries)
            new = q, rounded(total[at]), pa.array([ids[i] for i in d.tolist()], kind)
            if best:
                new = np.concatenate([best[0], q]), np.concatenate([best[1], new[1]]), pa.concat_arrays([best[2], new[2]])
            rank = pc.rank(new[2], "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
            order = np.lexsort((rank, -new[1], new[0]))
            q = new[0][order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            order = order[place < top]
            best = new[0][order], new[1][order], new[2].take(pa.array(order))
            last = place[place < top] == top - 1
            least[best[0][last]] = best[1][last]

        for batch in batches:
            kind = batch.column("doc_id").type
            ids, lengths, counts, products = [], [], [], 0
            for i, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                w = words(text)
                found = Counter(map(index.get, w))
                found.pop(None, None)
                if found:
                    ids.append(i)
                    lengths.append(len(w))
                    counts.append(sorted(found.items()))
                    products += int(n_of[list(found)].sum())
                    if max(products, len(ids) * n_queries) >= _CELLS:
                        add(ids, kind, lengths, counts)
                        ids, lengths, counts, products = [], [], [], 0
            if ids:
                add(ids, kind, lengths, counts)
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([query_ids[i] for i in best[0].tolist()], query_type), best[2], pa.array(best[1])], ["query_id", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, out)
