"""A training-data pipeline over `documents`: quality, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of `documents`. A stage begins by deleting
the intermediate tables that the stage before it left in the shared folder, whose result is written by then.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm import packing, quality, simhash, suffix_dedup, toxicity
from quarry.llm.common import release, shared_dir, written
from quarry.llm.queries import RANKS, TOKENIZER

#: Passages of more than fifty words are this long or longer.
PASSAGE_BYTES = 200
#: The intermediate tables of the stage that ran last.
_left: list[str] = []


def _stage(f: Callable) -> Callable:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _left)
        before = set(written())
        out = f(spark, docs, sf_dir)
        _left[:] = [p for p in written() if p not in before]
        return out

    return run_stage


def _wrapped(docs: DataFrame) -> DataFrame:
    """Rows as one column beside the text, so that no column of theirs meets one that an operator adds."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")


def _whole(docs: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null texts are scored as empty."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _whole(docs, quality.classify_quality(_wrapped(docs), model, ["doc"]).where(F.col("score") >= quality.THRESHOLD))


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't flag."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _whole(docs, toxicity.classify_toxicity(_wrapped(docs), model, ["doc"]).where(F.col("score") < toxicity.THRESHOLD))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near-duplicates: by SimHash, or 0.8 similar on five-word shingles."""
    return simhash.keep_representatives(docs, similar=True)


@_stage
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of passages; `n_chars` follows the text."""
    kept = suffix_dedup.remove_later_copies(docs, length=PASSAGE_BYTES)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, added=packing.added_tokens(public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Trained classifiers, suffix order and byte-pair merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; the result of each is written under the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
