"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, \v, \f and \r. bytes.split() cuts at exactly these six.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of an input folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share.

    It lies in ``spark.checkpoint.dir``; only where that is unset (local runs and
    tests) the setting is given a local folder first.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/lodestar-{uuid.uuid4().hex}"


def written(df: DataFrame, spark: SparkSession | None = None, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again.

    The table outlives any executor, so a lost one costs no recomputation of what
    led here.
    """
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Of a table's rows in one Arrow batch: bytes, and rows.
BATCH_BYTES, BATCH_ROWS = "4m", "4000"


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session.

    Ten thousand long texts are tens of megabytes, held by the JVM outside its heap and by
    Python, several times over while they are built; both keep what they once took.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def row_key():
    """A 64-bit hash that names a row by doc_id and text; equal rows share it."""
    return F.xxhash64("doc_id", text_or_empty())


def wide_row_key():
    """128 bits that name a row by doc_id and text: two hashes, chained in either order."""
    return F.struct(row_key().alias("a"), F.xxhash64(text_or_empty(), "doc_id").alias("b"))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores behind until no column of the table has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def arrow_texts(batch, index: int) -> list[str]:
    """A string column as a list, null as the empty string."""
    return [t if t is not None else "" for t in batch.column(index).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], index: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``most_bytes`` of the column ``index``; a longer text has a batch of its own.

    What Python makes of a batch (strings, words, spans) is a multiple of its texts,
    and a worker that is used again keeps the memory of its largest batch.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(index)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(ends):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most_bytes, side="right")))
            yield batch.slice(a, b - a)
            a = b


def small_side(df: DataFrame, most_rows: int) -> DataFrame:
    """A stored table, marked for broadcast only if it has at most so many rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= most_rows else df
