"""Sum-of-squares online packing of tokenised documents into windows of fixed length."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import Batches, column_texts, limit_batches

WINDOW = 2048
#: Partially filled windows that may be open at once in a task. When there are more, all of them are merged by cutting pieces,
#: which loses no token and pads nothing; so memory is bounded by MOST_OPEN * WINDOW ids of four bytes, 64 MB.
MOST_OPEN = 8192
#: Sequence ids of a task start at its partition's number times this.
SEQUENCES = 1 << 33
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long"


class Packer:
    """Places pieces into windows one at a time; `levels[h]` counts the open windows filled to h.

    A piece of s tokens may open a window (level 0) or go to any level h <= window - s that is in use. Moving a window from
    level h to h + s changes the sum of squares of the counts by 2 * (levels[h + s] - levels[h]) + 2, where a full or an empty
    window counts nothing; the least change wins, the fullest level of equals.
    """

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN) -> None:
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.at: list[list[list]] = [[] for _ in range(window + 1)]  # open windows by level: lists of pieces
        self.open = 0

    def choose(self, size: int) -> int:
        """The level to place a piece of `size` at."""
        below = self.levels[: self.window - size + 1]
        after = self.levels[size:].copy()
        after[-1] = 0
        change = 2 * (after - below) + 2
        change[0] = 2 * after[0] + 1
        change[-1] = 1 - 2 * below[-1] if self.window > size else 0
        usable = below > 0
        usable[0] = True
        best = change[usable].min()
        return int(np.flatnonzero(usable & (change == best))[-1])

    def add(self, piece: tuple) -> Iterator[list]:
        """piece: (document, start, ids). Yields windows that are done."""
        size = len(piece[2])
        if size == self.window:
            yield [piece]
            return
        level = self.choose(size)
        if level:
            pieces = self.at[level].pop()
            self.levels[level] -= 1
            self.open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            yield pieces
            return
        self.at[level + size].append(pieces)
        self.levels[level + size] += 1
        self.open += 1
        if self.open > self.most_open:
            yield from self.merge(last=False)

    def merge(self, last: bool = True) -> Iterator[list]:
        """Fill windows up with what other open windows hold, cutting pieces where a window ends.

        What is left is less than a window: it stays open, or, at the end, leaves in sequences whose lengths are powers of
        two and need no padding.
        """
        rest = [p for level in range(self.window - 1, 0, -1) for pieces in self.at[level] for p in pieces]
        self.at = [[] for _ in range(self.window + 1)]
        self.levels[:] = 0
        self.open = 0
        left = sum(len(p[2]) for p in rest)
        now, room = [], self.window
        rest.reverse()
        while rest and (left >= room or last):
            if not now:
                room = self.window if left >= self.window else 1 << left.bit_length() - 1
            doc, start, ids = rest.pop()
            if len(ids) > room:
                rest.append((doc, start + room, ids[room:]))
                ids = ids[:room]
            now.append((doc, start, ids))
            room -= len(ids)
            left -= len(ids)
            if not room:
                yield now
                now, room = [], self.window
        rest.reverse()
        if now or rest:
            now += rest
            level = sum(len(p[2]) for p in now)
            self.at[level].append(now)
            self.levels[level] += 1
            self.open = 1


def pack(documents: Iterator[tuple[object, np.ndarray]], window: int = WINDOW, most_open: int = MOST_OPEN) -> Iterator[list[tuple]]:
    """Windows of (document, start, ids) pieces, for (document, ids) in the order given. Documents longer than a window are cut into whole windows and a rest."""
    packer = Packer(window, most_open)
    for doc, ids in documents:
        for start in range(0, len(ids), window):
            yield from packer.add((doc, start, ids[start : start + window]))
    yield from packer.merge()


def added_tokens(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON file: they are split from a text before anything else and have ids of their own."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    at = re.search(r'"added_tokens"\s*:\s*', text)  # the vocabulary beside them would fill the driver's memory for nothing
    found = json.JSONDecoder().raw_decode(text, at.end())[0] if at else []
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in found):
        raise ValueError("only added tokens that match as they are")
    return {t["content"]: t["id"] for t in found}


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str, added: tuple[tuple[str, int], ...]):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    for content, _ in added:
        ranks.pop(content.encode(), None)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 1, window: int = WINDOW, most_open: int = MOST_OPEN, added: dict[str, int] | None = None) -> DataFrame:
    """A row for each piece of each row of `docs` (doc_id, text): see SCHEMA. `doc_tokens` counts `end_id`, which ends each document.

    The ids are those of the byte-level BPE whose ranks are in the file `path` on the executors; each of the `added` tokens
    in a text is split off and has its own id. Each input partition is packed on its own,
    without a shuffle: sequence ids start at the partition's number times 2**33, and a recomputed task repeats them. A null
    text is empty and has one token. `padded_length` is the sequence's length with padding: the window, or less at a power
    of two. Null and repeated ids are kept as they are.
    """
    special = tuple(sorted((added or {}).items()))
    limit_batches(docs.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Batches) -> Batches:
        encode = _encoder(path, pattern, special).encode_to_numpy
        sequence = TaskContext.get().partitionId() * SEQUENCES
        end = np.array([end_id], np.uint32)

        def documents() -> Iterator[tuple]:
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), column_texts(b.column(1)), strict=True):
                    ids = np.concatenate([encode(text, allowed_special="all", disallowed_special=()).astype(np.uint32), end]) if text else end
                    yield (doc, len(ids)), ids

        rows = []
        for pieces in pack(documents(), window, most_open):
            offset, total = 0, sum(len(ids) for _, _, ids in pieces)
            padded = total if total & (total - 1) == 0 else window
            for (doc, n), start, ids in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, sequence, offset, padded))
                offset += len(ids)
            sequence += 1
            if len(rows) >= 4096:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
