"""Byte-level BPE in two tiers: a minimal perfect hash resolves pre-tokens that are in the vocabulary; the rest are merged
with a heap over linked bytes."""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import Batches, column_texts, limit_batches, unused_name

#: A worker remembers the ids of this many pre-tokens of at most so many characters before it forgets the older half, which
#: bounds its memory whatever the texts hold; results don't depend on it.
REMEMBERED, LONGEST = 600_000, 48


def load_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file with a base64 token and its rank in each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if token}
_SPREAD, _MIX, _ONES = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys fill n slots, a slot is found from one 64-bit hash and its bucket's displacement.

    Keys outside the set also reach a slot, so a lookup compares the key stored there.
    """

    def __init__(self, keys: list[bytes], load: int = 4, seed: int = 7) -> None:
        self.n, self.seed = len(keys), seed
        self.buckets = max(1, -(-self.n // load))
        hashes = np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], np.uint64)
        if len(np.unique(hashes)) != self.n:
            raise ValueError("keys repeat, or their hashes do")
        bucket = self._bucket(hashes)
        members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])
        free: int | None = None
        self.shift, taken, self.slots = np.zeros(self.buckets, np.int64), np.zeros(self.n, bool), np.full(self.n, -1, np.int64)
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            if not len(members[b]):
                break
            own, first = hashes[members[b]], 0
            if len(own) == 1:  # a lone key names its slot
                free = int(np.flatnonzero(~taken)[0]) if free is None else free + 1 + int(np.flatnonzero(~taken[free + 1 :])[0])
                self.shift[b], taken[free], self.slots[free] = -free - 1, True, members[b][0]
                continue
            while True:  # try displacements in blocks
                shifts = np.arange(first, first + 64)
                slots = self._slot(own[None, :], shifts[:, None])
                ordered = np.sort(slots, axis=1)
                fits = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fits.any():
                    chosen = int(fits.argmax())
                    self.shift[b] = shifts[chosen]
                    taken[slots[chosen]] = True
                    self.slots[slots[chosen]] = members[b]
                    break
                first += 64
        self.keys = [keys[i] for i in self.slots]
        self.shifts = self.shift.tolist()

    def _bucket(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(40)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, hashes: np.ndarray, shift: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (shift.astype(np.uint64) * np.uint64(_SPREAD))) * np.uint64(_MIX)
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def find(self, key: bytes) -> int:
        """The key's place in the list given, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key, self.seed)
        d = self.shifts[(h >> 40) % self.buckets]
        slot = -d - 1 if d < 0 else ((h ^ (d * _SPREAD & _ONES)) * _MIX & _ONES) // (1 << 32) % self.n
        return int(self.slots[slot]) if self.keys[slot] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the pair of lowest rank is joined first, the leftmost of equals. A heap holds the pairs, bytes are linked."""
    n = len(piece)
    get = ranks.get
    end = list(range(1, n + 2))  # the part that starts here ends there
    before = list(range(-1, n))
    now = [-1] * (n + 1)  # the rank of the pair that starts here, if it stands
    heap = []
    for i in range(n - 1):
        if (r := get(piece[i : i + 2])) is not None:
            now[i] = r
            heap.append(r << 32 | i)
    heapify(heap)
    while heap:
        top = heappop(heap)
        i = top & 0xFFFFFFFF
        if now[i] != top >> 32:
            continue  # the pair no longer stands
        j = end[i]
        end[i] = stop = end[j]
        now[j] = now[i] = -1
        if stop < n:
            before[stop] = i
            if (r := get(piece[i : end[stop]])) is not None:
                now[i] = r
                heappush(heap, r << 32 | i)
        if i:
            p = before[i]
            if (r := get(piece[p:stop])) is not None:
                now[p] = r
                heappush(heap, r << 32 | p)
            else:
                now[p] = -1
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class _Remembered(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, token: str) -> bytes:
        ids = self.older.get(token)
        if ids is None:
            ids = self.codec.encode_token(token.encode("utf-8"))
            if len(token) > LONGEST:
                return ids
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        self[token] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary; texts are split by `pattern` and each match is encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        whole = list(ranks)
        self.hash = PerfectHash(whole)
        self.whole_ids = [int(ranks[t]).to_bytes(4, "little") for t in whole]
        self.tokens: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.remembered = _Remembered(self)

    def encode_token(self, piece: bytes) -> bytes:
        at = self.hash.find(piece)
        if at >= 0:
            return self.whole_ids[at]
        ids = merge(piece, self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.remembered.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    return Codec(load_ranks(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """`columns` (default doc_id) and `ids` (binary, little-endian unsigned 32-bit), `decoded` (binary): the whole text encoded, and the ids decoded again.

    Null and empty texts have no ids. Special tokens are ordinary text. No shuffle; repeated rows give repeated results.
    Columns named ids or decoded are replaced. The vocabulary file must exist on the executors.
    """
    return _each_text(docs, path, pattern, text_col, columns, lambda c, ids: (ids, c.decode(ids)), "ids binary, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """As `encode_documents`, with `n_tokens, ids_sha256, decoded_sha256` in place of the ids and the bytes."""

    def digest(c: Codec, ids: bytes) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()

    return _each_text(docs, path, pattern, text_col, columns, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _each_text(docs: DataFrame, path: str, pattern: str, text_col: str, columns: list[str] | None, make, added: str) -> DataFrame:
    spark = docs.sparkSession
    limit_batches(spark)
    new = spark.createDataFrame([], added).schema
    columns = [c for c in columns or ["doc_id"] if c not in new.names]
    own = unused_name(columns, "__text")
    kept = docs.select(*columns, F.col(text_col).alias(own))
    schema = kept.drop(own).schema
    for f in new:
        schema.add(f)

    def run(batches: Batches) -> Batches:
        c = codec(path, pattern)
        for b in batches:
            made = [make(c, c.encode(t)) for t in column_texts(b.column(b.num_columns - 1))]
            extra = [pa.array([m[i] for m in made]) if made else pa.nulls(0) for i in range(len(new))]
            yield pa.record_batch([*b.columns[:-1], *[x.cast({"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}[f.dataType.simpleString()]) for x, f in zip(extra, new, strict=True)]], schema.names)

    return kept.mapInArrow(run, schema)
