"""Merkle trees over the sections and paragraphs of a document: roots test equality, differing branches locate edits.

Leaves are phrases: runs of words that end where a paragraph (a line) ends, after a word whose CRC-32 is a multiple of 8, or
at 240 bytes. Sections are runs of paragraphs that end at a blank line or after a paragraph whose digest is a multiple of 4.
So all boundaries depend on the content near them, and an edit changes the nodes on its own branch only.

A fingerprint is text: the root (32 hex digits), a colon, and the sections separated by `/`; a section is its digest, `[` and
its paragraphs separated by `,`; a paragraph is its digest, `(` and its leaves, 8 hex digits and 2 for the length in bytes each.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quarry.llm.common import Batches, column_texts, limit_batches

PHRASE_BYTES = 240
#: Bytes of text in a range of neighbours, at most about.
RANGE_BYTES = 64 << 20
_WORDS = re.compile(rb"\S+\s*|\s+")

#: (digest, leaves) of a paragraph, where a leaf is (digest, bytes); (digest, paragraphs) of a section; (root, sections).
Paragraph = tuple[str, list[tuple[str, int]]]
Tree = tuple[str, list[tuple[str, list[Paragraph]]]]


def _phrases(line: bytes) -> Iterator[bytes]:
    start = at = 0
    for word in _WORDS.findall(line):
        while at + len(word) - start > PHRASE_BYTES:
            stop = at if at > start else start + PHRASE_BYTES
            yield line[start:stop]
            word = word[stop - at :] if stop > at else word
            start = at = stop
        at += len(word)
        if not zlib.crc32(word) & 7:
            yield line[start:at]
            start = at
    if at > start:
        yield line[start:at]


def _join(parts: list[str], size: int = 4) -> str:
    return hashlib.blake2b("".join(parts).encode(), digest_size=size).hexdigest()


def tree(text: str) -> Tree:
    """The tree of a whole text; an empty text has a root and no sections."""
    sections, section = [], []
    for line in text.encode("utf-8").splitlines(keepends=True) if text else []:
        leaves = [(f"{zlib.crc32(p):08x}", len(p)) for p in _phrases(line)]
        digest = _join([d + f"{n:02x}" for d, n in leaves])
        section.append((digest, leaves))
        if not int(digest, 16) & 3 or not line.strip():
            sections.append((_join([d for d, _ in section]), section))
            section = []
    if section:
        sections.append((_join([d for d, _ in section]), section))
    whole = hashlib.blake2b(text.encode("utf-8"), digest_size=8).hexdigest()  # 32-bit nodes alone would let unequal texts meet
    return _join([d for d, _ in sections], 8) + whole, sections


def fingerprint(t: Tree) -> str:
    root, sections = t
    return root + ":" + "/".join(d + "[" + ",".join(p + "(" + "".join(f"{x}{n:02x}" for x, n in leaves) for p, leaves in paragraphs) for d, paragraphs in sections)


def parse(text: str) -> Tree:
    root, _, rest = text.partition(":")
    sections = []
    for s in rest.split("/") if rest else []:
        d, _, paragraphs = s.partition("[")
        out = []
        for p in paragraphs.split(","):
            digest, _, leaves = p.partition("(")
            out.append((digest, [(leaves[i : i + 8], int(leaves[i + 8 : i + 10], 16)) for i in range(0, len(leaves), 10)]))
        sections.append((d, out))
    return root, sections


def _unmatched(a: list, b: list) -> tuple[list, list]:
    """Nodes (digest first) that the other side doesn't have, each as often as it is in excess."""
    if a == b:
        return [], []
    in_a, in_b = Counter(x[0] for x in a), Counter(x[0] for x in b)

    def over(nodes: list, other: Counter) -> list:
        left = Counter(other)
        out = []
        for x in nodes:
            if left[x[0]] > 0:
                left[x[0]] -= 1
            else:
                out.append(x)
        return out

    return over(a, in_b), over(b, in_a)


def likeness(a: Tree, b: Tree) -> float:
    """Share of the bytes of both trees that lie under equal nodes, from 0 to 1; equal roots give 1, whatever their size."""
    if a[0] == b[0]:
        return 1.0
    total = sum(n for t in (a, b) for _, s in t[1] for _, p in s for _, n in p)
    rest_a, rest_b = _unmatched(a[1], b[1])
    rest_a, rest_b = _unmatched([p for _, s in rest_a for p in s], [p for _, s in rest_b for p in s])
    rest_a, rest_b = _unmatched([x for _, p in rest_a for x in p], [x for _, p in rest_b for x in p])
    return 1 - sum(n for _, n in rest_a + rest_b) / total if total else 0.0


def locate_edits(old: Tree, new: Tree) -> list[tuple[int, int]]:
    """Byte spans of `new` under leaves that `old` doesn't have on any differing branch; adjacent spans are joined."""
    if old[0] == new[0]:
        return []
    sections = _unmatched(old[1], new[1])
    differing = [{id(x) for x in sections[1]}]
    paragraphs = _unmatched([p for _, s in sections[0] for p in s], [p for _, s in sections[1] for p in s])
    differing.append({id(x) for x in paragraphs[1]})
    leaves = _unmatched([x for _, p in paragraphs[0] for x in p], [x for _, p in paragraphs[1] for x in p])
    differing.append({id(x) for x in leaves[1]})
    at, out = 0, []
    for s in new[1]:
        for p in s[1]:
            for leaf in p[1]:
                if id(s) in differing[0] and id(p) in differing[1] and id(leaf) in differing[2]:
                    if out and out[-1][1] == at:
                        out[-1] = (out[-1][0], at + leaf[1])
                    else:
                        out.append((at, at + leaf[1]))
                at += leaf[1]
    return out


def fingerprint_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """`id_col, fingerprint` of every row, whole texts, null as empty; equal texts have equal fingerprints. No shuffle."""
    limit_batches(docs.sparkSession)
    kept = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = kept.drop("__text").withColumn("fingerprint", F.lit("")).schema

    def run(batches: Batches) -> Batches:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([fingerprint(tree(t)) for t in column_texts(b.column(1))], pa.string())], schema.names)

    return kept.mapInArrow(run, schema)


def with_next(docs: DataFrame, make, schema: str, partitions: int | None = None) -> DataFrame:
    """Rows `make(doc_id, text, next_text)` over (doc_id, text), where next is the next row in ascending (doc_id, text), after the last the first.

    Null ids come first, null texts are empty, a single row is its own next. One shuffle: rows go to ranges of doc_id, each of
    about `RANGE_BYTES` of text, and the first row of each range goes to the range before as well. The driver receives the
    bytes, bound and first id of each range, whose number grows with the input.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // RANGE_BYTES) + 1)
    fine = 8 * n  # by count first, then as many neighbours together as make up a share of the bytes
    bounds = docs.agg(F.percentile_approx("id", [i / fine for i in range(1, fine)], 10 * fine)).first()[0]
    bounds = np.array(sorted(set(bounds or [])), np.int64)

    @F.pandas_udf(IntegerType())
    def fine_range(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype("int32"))

    found = sorted(docs.groupBy(fine_range("id").alias("r")).agg(F.min("id"), F.sum(F.octet_length("text").cast("long") + 1)).collect())
    share = sum(r[2] for r in found) / n
    range_of_fine, firsts, held = np.zeros(len(bounds) + 1, np.int64), [], 0.0
    for r, first, size in found:
        if not firsts or held + size / 2 > share * len(firsts) and len(firsts) < n:
            firsts.append(first)
        range_of_fine[r] = len(firsts) - 1
        held += size
    before = {first: i - 1 for i, first in enumerate(firsts) if i}  # of the first row of a range: the range before
    if firsts:
        before[firsts[0]] = len(firsts) - 1

    @F.pandas_udf(ArrayType(IntegerType()))
    def ranges_of(ids: pd.Series) -> pd.Series:
        own = range_of_fine[np.searchsorted(bounds, ids.to_numpy(), side="right")]
        return pd.Series([[r, -1 - before[i]] if i in before else [r] for r, i in zip(own.tolist(), ids.tolist(), strict=True)])

    spread = docs.select("*", F.explode(ranges_of("id")).alias("to"))
    spread = spread.select("id", "no_id", "text", F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("r"), (F.col("to") < 0).alias("guest"))
    lined = spread.repartitionById(n, F.col("r")).sortWithinPartitions("r", "guest", "id", "text")

    def run(batches: Batches) -> Batches:
        last = None  # the row that still waits for its next
        for b in batches:
            out = []
            for i, no_id, text, r, guest in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if last is not None and last[2] == r:
                    out.append(make(last[0], last[1], text))
                last = None if guest else (None if no_id else i, text, r)
            if out:
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    arrow = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.split()[1]]) for f in schema.split(", ")])
    return lined.mapInArrow(run, schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of (doc_id, text): its fingerprint, that of an edited text, and likenesses.

    The edited text has its last quarter of code points replaced by as many first ones of the next row's text.
    Returns `doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`.
    """
    return with_next(docs, _edited_row, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _edited_row(doc_id: int | None, text: str, after: str) -> tuple:
    quarter = len(text) // 4
    edited = text[: len(text) - quarter] + after[:quarter]
    own, new = tree(text), tree(edited)
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), fingerprint(own), fingerprint(new), likeness(own, new), likeness(own, tree(after))
