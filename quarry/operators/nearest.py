"""Exact nearest vectors by cosine: vectors packed into matrices, and pairs of matrices reduced to the best of each query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DataType, DoubleType, IntegerType, StructField, StructType

#: Norms outside of these bounds (zero, infinite, not a number) are left to the exact formula.
_NORMS = 1e-100, 1e100
#: Pairs whose exact cosines are made at once.
_AT_ONCE = 1 << 16


def rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    """Half away from zero at the decimal, as DuckDB rounds; what isn't finite stays."""
    scaled = np.abs(x) * 10.0**places
    with np.errstate(invalid="ignore"):
        whole = np.trunc(scaled)
        return np.where(np.isfinite(x), np.copysign(whole + (scaled - whole >= 0.5), x) / 10.0**places + 0.0, x)


def packed(rows: DataFrame, limit: int) -> DataFrame:
    """`ids, size, data`: up to `limit` vectors of one size in a row, their doubles one after the other; size -1 if they are null or hold nulls.

    Takes an id and a vector. The ids of a row are in order, nulls last.
    """
    kind = rows.schema[0].dataType
    out = StructType([StructField("ids", ArrayType(kind)), StructField("size", IntegerType()), StructField("data", BinaryType())])

    def row(size: int, ids: list[pa.Array], data: list[np.ndarray]) -> pa.RecordBatch:
        together = pa.concat_arrays(ids)
        order = pc.sort_indices(together, null_placement="at_end")
        matrix = np.concatenate(data)[order.to_numpy()]
        lists = pa.ListArray.from_arrays(pa.array([0, len(together)], pa.int32()), together.take(order))
        return pa.RecordBatch.from_arrays([lists, pa.array([size], pa.int32()), pa.array([matrix.tobytes()], pa.binary())], ["ids", "size", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            lists = batch.column(1)
            values = lists.values
            ends = lists.offsets.to_numpy()
            sizes = np.diff(ends).astype(np.int64)
            sizes[np.asarray(lists.is_null())] = -1
            flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            if values.null_count:
                nulls = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))])
                sizes[nulls[ends[1:]] > nulls[ends[:-1]]] = -1
            for size in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == size)
                ids, data = held.setdefault(size, ([], []))
                for at in range(0, len(of), limit):
                    part = of[at : at + limit]
                    matrix = flat[ends[part][:, None] + np.arange(max(size, 0))]
                    room = limit - sum(map(len, ids))
                    for a, b in ((0, room), (room, len(part))):
                        if a < min(b, len(part)):
                            ids.append(batch.column(0).take(pa.array(part[a:b])))
                            data.append(matrix[a:b])
                        if sum(map(len, ids)) == limit:
                            yield row(size, ids, data)
                            ids.clear()
                            data.clear()
        for size, (ids, data) in held.items():
            if ids:
                yield row(size, ids, data)

    return rows.mapInArrow(run, out)


def _norms(m: np.ndarray) -> np.ndarray:
    """Squares are added in order, as the SQL does."""
    total = np.zeros(len(m))
    for k in range(m.shape[1]):
        total += m[:, k] * m[:, k]
    return np.sqrt(total)


def best(q: np.ndarray, v: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of q, rows of v and their rounded cosines: of each row of q the `top` best, equals by the order of v.

    Single precision finds those that may be among the best, by a bound on its error; double precision decides.
    """
    size = q.shape[1]
    with np.errstate(all="ignore"):
        lq, lv = _norms(q), _norms(v)
        plain_q, plain_v = ((x > _NORMS[0]) & (x < _NORMS[1]) for x in (lq, lv))
        s = np.where(plain_q[:, None], q / lq[:, None], 0).astype(np.float32) @ np.where(plain_v[:, None], v / lv[:, None], 0).astype(np.float32).T
        s[:, ~plain_v] = -np.inf
        # The best of each group of columns are scores too, so the last of their `top` best is a bound from below.
        groups = max(64, 2 * top)
        width = s.shape[1] // groups
        if width > 1:
            heads = s[:, : width * groups].reshape(len(s), width, groups).max(axis=1)
            least = np.partition(heads, -top, axis=1)[:, -top]
        else:
            least = np.full(len(s), -np.inf, np.float32)
        least = least - np.float32(2e-6 + size * 2.0**-21)
        s[:, ~plain_v] = np.inf
        may = s >= least[:, None]
        may[~plain_q] = True
        at = np.flatnonzero(may)
        qt, vt = np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
        kept = []
        # A query's candidates may fall into two slices, which does no harm: the best of all of it are among the best of each.
        for start in range(0, len(at), _AT_ONCE):
            i, j = np.divmod(at[start : start + _AT_ONCE], len(v))
            dot = np.zeros(len(i))
            for k in range(size):
                dot += vt[k][j] * qt[k][i]
            cosine = rounded(dot / (lv[j] * lq[i]))
            order = np.lexsort((j, -np.where(np.isnan(cosine), np.inf, cosine), ~np.isnan(cosine), i))  # NaN is the greatest
            i = i[order]
            first = order[np.arange(len(i)) - np.searchsorted(i, i) < top]
            kept.append((np.divmod(at[start : start + _AT_ONCE], len(v))[0][first], j[first], cosine[first]))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def best_of_pairs(pairs: DataFrame, vec_id: DataType, query_id: DataType, top: int) -> DataFrame:
    """`query_id, vec_id, cosine` of what may be among the `top`, from rows of packed vectors and packed queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                ids, q_ids = (batch.column(c)[r].values for c in ("ids", "q_ids"))
                size, q_size = (batch.column(c)[r].as_py() for c in ("size", "q_size"))
                if size == q_size and size >= 0:
                    q, v = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float64).reshape(len(x), size) for c, x in (("q_data", q_ids), ("data", ids)))
                    i, j, cosine = best(q, v, top)
                    found = pa.array(cosine)
                else:
                    n = min(top, len(ids))
                    i, j = np.repeat(np.arange(len(q_ids)), n), np.tile(np.arange(n), len(q_ids))
                    found = pa.nulls(len(i), pa.float64())
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(i)), ids.take(pa.array(j)), found], ["query_id", "vec_id", "cosine"])

    return pairs.mapInArrow(run, StructType([StructField("query_id", query_id), StructField("vec_id", vec_id), StructField("cosine", DoubleType())]))
