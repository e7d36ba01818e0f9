"""Exact removal of long byte strings that occur more than once in a corpus, from suffix order and longest previous factors.

A suffix array of the whole corpus fits no machine, so the corpus is cut where equal strings are cut alike. Of every window of
`length` bytes the k-gram with the least hash is its anchor; equal windows have equal anchors at equal places. Only anchors
that occur more than once matter. Their surroundings, `length - k` bytes before and `length` bytes from the anchor on, are
brought together by anchor. There the suffixes of all surroundings are put in order column by column from the right, each
column by one stable radix pass over the order of the next, with the longest common prefixes of neighbours kept along. In
suffix order the previous and next smaller positions give each suffix its longest previous factor: it reaches `length` exactly
if one of the two lies in the run of neighbours with common prefixes of `length` or more.

Anchors at very many places (a licence line, a passage in every third text) are not brought to one task. Equal surroundings
become one, the earliest, by a partial aggregation. Then each is compared, byte by byte and where it lies, with the commonest
of its key, which is joined to it: of the windows on which both agree, the earliest place is the least of a partial aggregation,
and all other places are later copies. What is left of a surroundings shares more with its like than with the commonest, and
goes on under a key that is longer by the byte at which it parted, until no key has many places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.bloom import Bloom
from quarry.llm.common import Batches, column_bytes, limit_batches, stored

LENGTH = 400
GRAM = 64
#: Places of one anchor, and of one longer key, whose surroundings one task orders; those of keys with more are compared with the earliest.
CROWD, HUGE = 500, 500
#: Surroundings that are ordered together, whole anchors at a time.
TOGETHER = 12_000
_BASE = 0x9E3779B97F4A7C15
_CHUNK = 1 << 20


@lru_cache(maxsize=1)
def _powers(n: int = _CHUNK + 4096) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, np.uint64(b), np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    powers, inverse = _powers()
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1]
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ h >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the anchors of all windows of `length` bytes: of each the least hash, the last of equals."""
    if gram >= length:
        raise ValueError("the anchor must be shorter than the window")
    width, data = length - gram + 1, np.frombuffer(text, np.uint8)
    where, what = [], []
    for start in range(0, len(data) - length + 1, _CHUNK - 2 * length):
        h = _gram_hashes(data[start : start + _CHUNK], gram)
        if len(h) < width:
            break
        index = np.arange(len(h), dtype=np.uint64)
        keys = (h & ~np.uint64(_CHUNK - 1)) | (np.uint64(_CHUNK - 1) - index)
        padded = np.full(-(-len(h) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(h)] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(h) - width + 1
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        at = np.unique(_CHUNK - 1 - (least & np.uint64(_CHUNK - 1)).astype(np.int64))
        where.append(at + start)
        what.append(h[at])
    if not where:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, first = np.unique(np.concatenate(where), return_index=True)
    return at, np.concatenate(what)[first].view(np.int64)


def previous_smaller(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each value the last place before it, from `first` on, with a smaller value; first - 1 where there is none."""
    at = np.arange(len(values)) - 1
    todo = np.flatnonzero(at >= first)
    while len(todo):
        todo = todo[values[at[todo]] >= values[todo]]
        at[todo] = at[at[todo]]  # all between are larger than the value jumped from
        at[todo] = np.maximum(at[todo], first[todo] - 1)
        todo = todo[at[todo] >= first[todo]]
    return at


def _has_previous_factor(rank: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a suffix has an earlier one in its run: the previous or the next smaller position lies in it. `starts`: of the runs."""
    m = len(rank)
    sizes = np.diff(np.append(starts, m))
    first, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
    before = previous_smaller(rank, first)
    after = m - 1 - previous_smaller(rank[::-1], (m - end)[::-1])[::-1]
    return (before >= first) | (after < end)


def repeated_windows(columns: np.ndarray, groups: np.ndarray, rank: np.ndarray, length: int, later_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """First and last start column of the windows of each member that repeat within its group; first > last: none.

    columns[c, m]: byte c of member m, 256 where it has none. Members are sorted by group; `rank` orders their positions in
    the corpus. With `later_only` the earliest window of each run of equals doesn't count as repeated.
    """
    n, m = columns.shape
    groups = groups.astype(np.int64)
    groups = (np.cumsum(np.concatenate([[0], groups[1:] != groups[:-1]]))).astype(np.uint16 if m < 65536 else np.uint32)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    first, last = np.full(m, n, np.int64), np.full(m, -1, np.int64)
    for c in range(n - 1, -1, -1):
        b = columns[c][order]
        by_byte = np.argsort(b, kind="stable")
        step = by_byte[np.argsort(groups[by_byte], kind="stable")]  # members of a group keep its places, so groups[i] is that of place i
        order, b = order[step], b[step]
        same = np.zeros(m, bool)
        same[1:] = (groups[1:] == groups[:-1]) & (b[1:] == b[:-1]) & (b[1:] < 256)
        now = np.zeros(m + 1, np.int32)
        at = np.flatnonzero(same)
        lo, hi = step[at - 1] + 1, step[at]
        close = lo == hi
        now[at[close]] = common[hi[close]] + 1
        if not close.all():
            far = ~close
            bounds = np.stack([lo[far], hi[far] + 1], axis=1).ravel()
            now[at[far]] = np.minimum.reduceat(common, bounds)[::2] + 1
        common = now
        if c > n - length:
            continue
        long = common[:m] >= length
        if not long.any():
            continue
        run = long | np.append(long[1:], False)  # a neighbour has a common prefix of `length` or more
        found = order[run]
        if later_only:
            found = found[_has_previous_factor(rank[found], np.flatnonzero(~long[run]))]
        first[found] = c
        last[found] = np.maximum(last[found], c)
    return first, last


def merge_spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; spans that touch are one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    begins = np.concatenate([[True], lo[1:] > reach[:-1]])
    return lo[begins], reach[np.append(np.flatnonzero(begins)[1:] - 1, len(lo) - 1)]


def cut(text: bytes, lo: list[int], hi: list[int]) -> bytes:
    """What is left of a text without the given disjoint ascending spans."""
    return b"".join(text[a:b] for a, b in zip([0, *hi], [*lo, len(text)], strict=True))


def _key(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(7), text).alias("d2")]


def _anchor_rows(length: int, gram: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            whats, d1, d2, places = [], [], [], []
            for i, text in enumerate(column_bytes(b.column(2))):
                what, counts = np.unique(anchors(text, length, gram)[1], return_counts=True)
                whats.append(what)
                places.append(counts)
                d1.append(np.full(len(what), b.column(0)[i].as_py(), np.int64))
                d2.append(np.full(len(what), b.column(1)[i].as_py(), np.int64))
            if whats:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in (whats, d1, d2, places)], ["a", "d1", "d2", "places"])

    return run


def _surroundings(length: int, gram: int) -> Callable[[Batches], Batches]:
    """From (d1, d2, first_id, text, wanted anchors): a row for each anchor and distinct surroundings in the text."""
    schema = pa.schema([("a", pa.int64()), ("crowded", pa.bool_()), ("first_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("at", pa.binary()), ("first", pa.int32()), ("ahead", pa.int32()), ("bytes", pa.binary())])
    before = length - gram

    def run(batches: Batches) -> Batches:
        for b in batches:
            for row in b.to_pylist():
                text = row["text"].encode() if isinstance(row["text"], str) else bytes(row["text"] or b"")
                at, what = anchors(text, length, gram)
                wanted = {w["a"]: w["crowded"] for w in row["wanted"]}
                places: dict[tuple[int, int, bytes], list[int]] = {}
                for p, a in zip(at.tolist(), what.tolist(), strict=True):
                    if a in wanted:
                        lo = max(0, p - before)
                        places.setdefault((a, p - lo, text[lo : p + length]), []).append(p)
                rows = [(a, wanted[a], row["first_id"], row["d1"], row["d2"], np.array(ps, "<i4").tobytes(), ps[0], ahead, s) for (a, ahead, s), ps in places.items()]
                for i in range(0, len(rows), 2048):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 2048], strict=True), schema, strict=True)], schema=schema)

    return run


_SPANS = "d1 long, d2 long, lo long, hi long"


def _emit(spans: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(lo) for _, _, lo, _ in spans]
    columns = [np.repeat(np.array([s[i] for s in spans], np.int64), sizes) for i in (0, 1)] + [np.concatenate([s[i] for s in spans]).astype(np.int64) for i in (2, 3)]
    return pa.record_batch([pa.array(c) for c in columns], [f.split()[0] for f in _SPANS.split(", ")])


def _order_groups(length: int, gram: int, later_only: bool) -> Callable[[Batches], Batches]:
    """Over rows sorted by anchor: whole anchors together, then their repeated windows as spans."""
    before = length - gram

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        a = rows["a"].to_numpy()
        m = len(a)
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        at = [np.frombuffer(x, "<i4").astype(np.int64) for x in rows["at"].to_pylist()]
        several = np.array([len(x) > 1 for x in at])
        alone = np.repeat(np.diff(np.append(starts, m)) == 1, np.diff(np.append(starts, m))) & ~several
        if alone.any():  # copies of one text only, or hashes that collided
            rows, at, several = rows.filter(pa.array(~alone)), [x for x, y in zip(at, alone, strict=True) if not y], several[~alone]
            a, m = a[~alone], int((~alone).sum())
        if not m:
            return
        columns = np.full((before + length, m), 256, np.uint16)
        ahead = rows["ahead"].to_numpy()
        for i, (n, s) in enumerate(zip(ahead.tolist(), rows["bytes"].to_pylist(), strict=True)):
            columns[before - n : before - n + len(s), i] = np.frombuffer(s, np.uint8)
        ids = [rows[c].to_pylist() for c in ("first_id", "d1", "d2")]
        by_place = sorted(range(m), key=lambda i: (ids[0][i] is not None, ids[0][i] or 0, ids[1][i], ids[2][i], at[i][0]))
        rank = np.empty(m, np.int64)
        rank[by_place] = np.arange(m)
        first, last = repeated_windows(columns, a, rank, length, later_only)
        low = before - ahead.astype(np.int64)  # the first column that a member has
        high = np.array([len(s) for s in rows["bytes"].to_pylist()]) + low
        spans = []
        for i in range(m):
            lo = [at[i][:1] - before + first[i]] if last[i] >= 0 else []
            hi = [at[i][:1] - before + last[i] + length] if last[i] >= 0 else []
            if several[i] and high[i] - low[i] >= length:  # the same surroundings again in this text
                again = at[i][1:] if later_only else at[i]
                lo.append(again - before + low[i])
                hi.append(again - before + high[i])
            if lo:
                spans.append((ids[1][i], ids[2][i], *merge_spans(np.concatenate(lo), np.concatenate(hi))))
        if spans:
            yield _emit(spans)

    def run(batches: Batches) -> Batches:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= TOGETHER:
                t = pa.Table.from_batches(held)
                a = t["a"].to_numpy()
                edge = int(np.searchsorted(a, a[-1]))
                if edge:
                    yield from solve(t.slice(0, edge))
                    held = t.slice(edge).combine_chunks().to_batches()
                    n -= edge
        if held:
            yield from solve(pa.Table.from_batches(held))

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


_ROWS = "first_id long, d1 long, d2 long, at binary, first int, ahead int, bytes binary, weight long, lft int, rgt int"
_PARTED = f"agreed boolean, a long, low int, high int, {_ROWS}"
_KINDS = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in schema.split(", ")])


def _record(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _against_commonest(length: int, gram: int) -> Callable[[Batches], Batches]:
    """From rows with the commonest of their key as `e`: the windows on which both agree, and rows under the longer keys that may share more.

    A key stands for an anchor with `lft` bytes before it and `rgt` bytes after it, and for the windows that have them all; a
    window is named by how many of its bytes lie before the anchor, from `low` to `high`.
    """
    around, schema = length - gram, _arrow(_PARTED)

    def run(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for row in b.to_pylist():
                e, a = row.pop("e"), row.pop("a")
                own = [row[f.split()[0]] for f in _ROWS.split(", ")]
                s, t = np.frombuffer(row["bytes"], np.uint8), np.frombuffer(e["bytes"], np.uint8)
                ahead, lft, rgt = row["ahead"], row["lft"], row["rgt"]
                left = min(_common(s[:ahead][::-1], t[: e["ahead"]][::-1]), around)
                right = min(_common(s[ahead:], t[e["ahead"] :]) - gram, around)
                if left < lft or right < rgt:  # only the key's hash is the same: next time the row meets its like without the commonest
                    out.append((False, None, None, None, *own))
                    continue
                low, high = max(lft, around - right), min(left, around - rgt)
                if low <= high:
                    out.append((True, a, low, high, *own[:-4], None, *own[-3:]))
                if left + 1 <= min(around - rgt, ahead):
                    out.append((False, None, None, None, *own[:-2], left + 1, rgt))
                if right + 1 <= min(around - lft, len(s) - ahead - gram):
                    out.append((False, None, None, None, *own[:-2], lft, right + 1))
            for i in range(0, len(out), 4096):
                yield _record(out[i : i + 4096], schema)

    return run


#: Rows whose windows are summed up together.
_SUMMED = 1 << 14


def _least_places(around: int) -> Callable[[Batches], Batches]:
    """Of each key and window, the earliest place in some rows and how many have it."""
    schema = _arrow("a long, w int, known boolean, first_id long, d1 long, d2 long, first int, n long")

    def summed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows.sort(key=lambda r: (r[3] is not None, r[3] or 0, *r[4:]))
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, (a, low, high, *_) in enumerate(rows):
            owner, n = found.setdefault(a, (np.full(around + 1, -1), np.zeros(around + 1, np.int64)))
            part = owner[low : high + 1]
            part[part < 0] = i
            n[low : high + 1] += 1
        out = [(a, w, rows[i][3] is not None, *rows[i][3:], n) for a, (owner, ns) in found.items() for w, (i, n) in enumerate(zip(owner.tolist(), ns.tolist(), strict=True)) if n]
        for i in range(0, len(out), 8192):
            yield _record(out[i : i + 8192], schema)

    def run(batches: Batches) -> Batches:
        held: list[tuple] = []
        for b in batches:
            held += zip(*[c.to_pylist() for c in b.columns], strict=True)
            if len(held) >= _SUMMED:
                yield from summed(held)
                held = []
        if held:
            yield from summed(held)

    return run


def _owners(batches: Batches) -> Batches:
    """Of each key the runs of repeated windows that have one earliest place: rows of (low, high, has an id, first_id, d1, d2, first) in 64 bits each."""
    for b in batches:
        out = []
        for windows in b.column(1).to_pylist():
            runs: list[list[int]] = []
            for x in sorted(windows, key=lambda x: x["w"]):
                if x["n"] < 2:
                    continue
                p = x["p"]
                place = [int(p["first_id"] is not None), p["first_id"] or 0, p["d1"], p["d2"], p["first"]]
                if runs and runs[-1][1] == x["w"] - 1 and runs[-1][2:] == place:
                    runs[-1][1] = x["w"]
                else:
                    runs.append([x["w"], x["w"], *place])
            out.append(np.array(runs, np.int64).tobytes())
        yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], ["a", "runs"])


def _later_windows(length: int, later_only: bool) -> Callable[[Batches], Batches]:
    """From windows on which rows agree, with the `runs` of their key: the spans of the repeated ones."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            spans, known, held = [], None, np.zeros((0, 7), np.int64)
            for first_id, d1, d2, first, low, high, runs in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if runs != known:
                    known, held = runs, np.frombuffer(runs, np.int64).reshape(-1, 7)
                lo, hi = np.maximum(held[:, 0], low), np.minimum(held[:, 1], high)
                ok = lo <= hi
                if later_only:
                    ok &= (held[:, 2:] != np.array([first_id is not None, first_id or 0, d1, d2, first], np.int64)).any(axis=1)
                if ok.any():
                    spans.append((d1, d2, *merge_spans(first - hi[ok], first + length - lo[ok])))
            if spans:
                yield _emit(spans)

    return run


def _equal_surroundings(rows: DataFrame, length: int, later_only: bool) -> tuple[DataFrame, DataFrame]:
    """Spans of surroundings that occur more than once, whole; and the earliest row of each, with its number as `weight`."""
    same = ["a", "ahead", "bytes"]
    place = F.struct(F.col("first_id").isNotNull().alias("known"), "first_id", "d1", "d2", "first")
    counted = rows.groupBy(*same).agg(F.sum(F.octet_length("at") / 4).cast("long").alias("weight"), F.min(place).alias("least")).where("weight > 1")
    counted = stored(counted, "equal")  # a table of its own, so that the join of surroundings in very many rows can be split
    marked = stored(rows.join(counted, same, "left").withColumn("earliest", F.coalesce(place == F.col("least"), F.lit(True))), "surroundings")

    def run(batches: Batches) -> Batches:
        for b in batches:
            spans = []
            for row in b.to_pylist():
                lo = np.frombuffer(row["at"], "<i4").astype(np.int64) - row["ahead"]
                lo = lo[1:] if later_only and row["earliest"] else lo
                if len(lo):
                    spans.append((row["d1"], row["d2"], *merge_spans(lo, lo + row["size"])))
            if spans:
                yield _emit(spans)

    whole = marked.where(F.col("weight").isNotNull() & (F.octet_length("bytes") >= length)).select("d1", "d2", "at", "ahead", "earliest", F.octet_length("bytes").alias("size"))
    kept = marked.where("earliest").select("first_id", "d1", "d2", F.substring("at", 1, 4).alias("at"), "first", "ahead", "bytes", F.coalesce("weight", F.lit(1)).cast("long").alias("weight"))
    return whole.mapInArrow(run, _SPANS), kept


def _halves(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Surroundings of crowded anchors under two longer keys each.

    A window reaches `half` bytes or more beyond its anchor on at least one side, so equal windows share the anchor with
    as many bytes after it, or with as many before it.
    """
    half = -(-(length - gram) // 2)
    after = F.when(F.octet_length("bytes") - F.col("ahead") >= gram + half, F.struct(F.lit(0).alias("lft"), F.lit(half).alias("rgt")))
    before = F.when(F.col("ahead") >= half, F.struct(F.lit(half).alias("lft"), F.lit(0).alias("rgt")))
    return rows.select("*", F.explode(F.array_compact(F.array(after, before))).alias("k")).select("*", "k.lft", "k.rgt").select([f.split()[0] for f in _ROWS.split(", ")])


def _shared_keys(rows: DataFrame, gram: int, huge: int) -> DataFrame:
    """Rows under the hash `a` of their key, where another place has it, and whether more places than `huge` have it."""
    key = F.xxhash64("lft", "rgt", F.substring(F.col("bytes"), F.col("ahead") - F.col("lft") + 1, F.col("lft") + F.lit(gram) + F.col("rgt")))
    rows = rows.withColumn("a", key)
    shared = rows.groupBy("a").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(shared.select("a", (F.col("n") > huge).alias("crowded")), "a")


def _crowded_spans(rows: DataFrame, length: int, gram: int, later_only: bool, huge: int, order: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Spans around crowded anchors. Each round parts what shares a key; keys grow by a byte or more, so the rounds end."""
    whole, rows = _equal_surroundings(rows, length, later_only)
    spans, rows = [whole], _halves(rows, length, gram)
    while True:
        rows = stored(_shared_keys(rows, gram, huge), "refined")
        spans.append(order(rows.where("not crowded")))
        crowded = rows.where("crowded").drop("crowded")
        if not crowded.take(1):
            break
        rank = F.struct((-F.col("weight")).alias("weight"), F.col("first_id").isNotNull().alias("known"), "first_id", "d1", "d2", "first", "ahead", "bytes")
        commonest = crowded.groupBy("a").agg(F.min(rank).alias("e"))
        parted = stored(crowded.join(commonest, "a").mapInArrow(_against_commonest(length, gram), _PARTED), "parted")
        agreed = parted.where("agreed").select("a", "low", "high", "first_id", "d1", "d2", "first")
        least = agreed.mapInArrow(_least_places(length - gram), "a long, w int, known boolean, first_id long, d1 long, d2 long, first int, n long")
        least = least.groupBy("a", "w").agg(F.min(F.struct("known", "first_id", "d1", "d2", "first")).alias("p"), F.sum("n").alias("n"))
        least = least.select("a", F.struct("w", "n", F.struct("p.first_id", "p.d1", "p.d2", "p.first").alias("p")).alias("x"))
        runs = least.groupBy("a").agg(F.collect_list("x").alias("least")).mapInArrow(_owners, "a long, runs binary")  # windows of one anchor: one for each byte around it
        spans.append(agreed.join(runs, "a").select("first_id", "d1", "d2", "first", "low", "high", "runs").mapInArrow(_later_windows(length, later_only), _SPANS))
        rows = parted.where("not agreed").drop("agreed", "a", "low", "high")
    out = spans[0]
    for s in spans[1:]:
        out = out.union(s)
    return out


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, later_only: bool = False, crowd: int = CROWD, huge: int = HUGE) -> DataFrame:
    """For each distinct text with a repeated string: `d1, d2, first_id, text, lo, hi` (arrays of disjoint ascending spans).

    A byte is in a span if it is covered by a string of `length` bytes that starts elsewhere too, in another text or the
    same; with `later_only` the earliest place of each string, by (smallest doc_id of its text, place), stays out. Exact
    copies count as one text here. Texts are told apart by 128 bits of hash, which fail for any two of 10**12 texts with a
    probability of 10**-15; strings are told apart by their bytes. Of anchors and texts, only those are shuffled again that may
    be, or have, shared anchors.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    keyed = docs.select(*_key(F.col(text_col)), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    rows = keyed.select("d1", "d2", "text").mapInArrow(_anchor_rows(length, gram), "a long, d1 long, d2 long, places long")
    of = F.struct("d1", "d2")
    shared = rows.groupBy("a").agg(F.min(of).alias("least"), F.max(of).alias("most"), F.max("places").alias("twice"), F.sum("places").alias("n")).where("least <> most or twice > 1")
    shared = stored(shared.select("a", (F.col("n") > crowd).alias("crowded")), "shared-anchors")
    wanted = Bloom(shared, "a").maybe(rows, "a").join(shared, "a").groupBy("d1", "d2").agg(F.collect_set(F.struct("a", "crowded")).alias("wanted"))
    wanted = stored(wanted, "wanted")
    texts = Bloom(wanted, "d1").maybe(keyed, "d1").groupBy("d1", "d2").agg(F.min("id").alias("first_id"), F.first("text").alias("text"))
    held = stored(texts.join(wanted, ["d1", "d2"]), "shared-texts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    around = held.mapInArrow(_surroundings(length, gram), "a long, crowded boolean, first_id long, d1 long, d2 long, at binary, first int, ahead int, bytes binary")
    ordered = lambda rows: rows.repartition(n, "a").sortWithinPartitions("a").mapInArrow(_order_groups(length, gram, later_only), _SPANS)
    spans = ordered(around.where("not crowded"))
    if held.where(F.exists("wanted", lambda w: w["crowded"])).take(1):
        spans = spans.union(_crowded_spans(around.where("crowded"), length, gram, later_only, huge, ordered))
    merged = spans.groupBy("d1", "d2").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    return held.drop("wanted").join(merged, ["d1", "d2"])


def _cut_rows() -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for row in b.to_pylist():
                text = (row["text"] or "").encode()
                lo, hi = merge_spans(np.array([s["lo"] for s in row["spans"]], np.int64), np.array([s["hi"] for s in row["spans"]], np.int64))
                out.append((row["d1"], row["d2"], [{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], cut(text, lo.tolist(), hi.tolist())))
            span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), span, pa.binary()))], ["d1", "d2", "removed", "kept"])

    return run


def removed_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", later_only: bool = False, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, huge: int = HUGE) -> DataFrame:
    """All rows and columns of `docs` as the struct `__row`, with `removed` (array of lo, hi: disjoint ascending byte spans) and `kept` (binary: the other bytes).

    Removed are all bytes that a repeated string of `length` bytes covers; with `later_only` the first copy of each stays,
    by (doc_id, place), null ids before all. Exact copies of a text of `length` bytes or more go whole: all of them, or with
    `later_only` all but those with the smallest id. Null, empty and shorter texts keep all they have.
    """
    spans = repeated_spans(docs, text_col, id_col, length, gram, later_only, crowd, huge)
    cuts = stored(spans.select("d1", "d2", "text", "spans").mapInArrow(_cut_rows(), "d1 long, d2 long, removed array<struct<lo: long, hi: long>>, kept binary"), "cuts")
    names = docs.columns
    own = docs.select(F.struct(*[F.col(c) for c in names]).alias("__row"), *_key(F.col(text_col)), F.col(id_col).cast("long").alias("__id"))
    sized = docs.select(*_key(F.col(text_col)), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("__n"), F.col(id_col).cast("long").alias("__id")).where(F.col("__n") >= length)
    copies = sized.groupBy("d1", "d2").agg(F.count("*").alias("__copies"), F.min("__id").alias("__first")).where("__copies > 1")
    decided = stored(cuts.join(copies, ["d1", "d2"], "full"), "decided")  # a table of its own, so that the join of a text in very many rows can be split
    touched = Bloom(decided, "d1")
    rows = touched.maybe(own, "d1").join(decided, ["d1", "d2"], "left")
    gone = F.col("__copies").isNotNull()
    if later_only:
        gone = gone & ~F.col("__id").eqNullSafe(F.col("__first"))
    text = F.coalesce(F.col(f"__row.`{text_col}`"), F.lit("")).cast("binary")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.octet_length(text).cast("long").alias("hi")))
    none = F.array().cast("array<struct<lo: long, hi: long>>")
    rows = rows.select("__row", F.when(gone, whole).otherwise(F.coalesce("removed", none)).alias("removed"), F.when(gone, F.lit(b"")).otherwise(F.coalesce("kept", text)).alias("kept"))
    return rows.union(touched.never(own, "d1").select("__row", none.alias("removed"), text.alias("kept")))


def readable(kept: Column) -> Column:
    """Kept bytes as text. Where a cut divides a character, its remaining bytes go too."""

    @F.pandas_udf("string")
    def decoded(column: pd.Series) -> pd.Series:
        return column.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return F.when(F.is_valid_utf8(kept), kept.cast("string")).otherwise(decoded(kept))


def dedup_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, huge: int = HUGE) -> DataFrame:
    """`doc_id, n_bytes, n_removed, n_spans, kept_sha256, text` of every row, from `removed_spans`; `text` is what is left, as text.

    Null and empty texts, and texts shorter than `length`, keep all they have; a null text gives an empty one. Of exact copies all bytes go.
    """
    rows = removed_spans(docs.select("doc_id", "text"), length=length, gram=gram, crowd=crowd, huge=huge)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return rows.select(
        F.col("__row.doc_id").alias("doc_id"),
        F.octet_length(F.coalesce("__row.text", F.lit(""))).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        readable(F.col("kept")).alias("text"),
    )


def remove_later_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD, huge: int = HUGE) -> DataFrame:
    """All rows and columns of `docs`, without the later copies of strings of `length` bytes in `text_col`; each first copy stays.

    First is by (doc_id, place), null ids before all. Where a cut divides a character, its remaining bytes go too. Exact
    copies of a text of `length` bytes or more become empty, but for one with the smallest id (all of those with that id).
    Null texts stay null.
    """
    rows = removed_spans(docs, text_col, id_col, True, length, gram, crowd, huge)
    old = F.col(f"__row.`{text_col}`")
    text = F.when(F.size("removed") == 0, old).otherwise(readable(F.col("kept")))
    return rows.select(*[text.alias(c) if c == text_col else F.col(f"__row.`{c}`").alias(c) for c in docs.columns])
