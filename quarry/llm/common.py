"""What the operators of this subpackage share: places for intermediate tables, Arrow batch limits, word hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows an Arrow batch may hold on its way to Python; with texts of 100 kB a batch stays under 64 MB.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: `spark.checkpoint.dir` of the session, or the context's checkpoint folder.

    Only a local master without either gets a fresh folder; on a cluster that would lie on one machine, so it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            return chosen.get()
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(configured)
    return configured


#: Tables that `stored` has written in this process and `release` has not deleted yet.
_WRITTEN: list[str] = []


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet under the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The tables that `stored` has written in this process and that are still there."""
    return list(_WRITTEN)


def release(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete tables of `stored`, all or those in `paths`; nothing that was built on them can be computed afterwards. Returns their number."""
    gone = written() if paths is None else [p for p in paths if p in _WRITTEN]
    for p in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(p)
    return len(gone)


def limit_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches sent to Python, so that very long texts cannot add up to gigabytes.

    Spark reads the setting when a result is computed, so it is left in the session.
    """
    spark.conf.set(_RECORDS, str(rows))


_RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Other Arrow batches for what is computed inside; the setting before holds again afterwards."""
    before = spark.conf.get(_RECORDS)
    spark.conf.set(_RECORDS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_RECORDS, before)


def column_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def column_texts(column: pa.Array) -> list[str]:
    return ["" if v is None else v for v in column.to_pylist()]


#: A word is a run of ASCII letters, digits and non-ASCII bytes; any other run of visible bytes is a word of its own.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x00-\x20]+")
#: Words of shingles: runs of bytes that are not white space.
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def word_hashes(text: bytes) -> np.ndarray:
    """CRC-32 of each lower-cased word, in order (uint32)."""
    words = WORD.findall(text.translate(LOWER))
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def unused_name(taken: list[str], name: str) -> str:
    """`name`, lengthened until no column has it (Spark's names ignore case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def held_out_of(folds: int, fold: int) -> str:
    """SQL for: this row belongs to the held-out fold (crc32 of the id's text modulo `folds`)."""
    return f"coalesce(crc32(cast(cast(doc_id as string) as binary)) % {folds} = {fold}, false)"


Batches = Iterator[pa.RecordBatch]
