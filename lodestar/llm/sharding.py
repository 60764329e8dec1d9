"""Shuffled shards by a two-pass external shuffle.

Pass one scatters records over buckets of memory size by a seeded hash; pass two
sorts each bucket, runs a seeded Fisher-Yates shuffle over it, and writes it. The
buckets one after the other are one random order of all records. Dealing that
order out like cards gives shards whose row counts differ by one at most (the law
``rows``), and each record's place in its shard.

At scale: one shuffle of the records and one write. A task holds one bucket
(``bucket_bytes``); the number of buckets follows from the total size, which is
one aggregate. The table of bucket sizes has a row for each bucket and is joined
by Spark.

Records equal in id and text would all lie in one bucket. Where they fill more than
one, they are dealt to as many as they fill, by their place in the input; that place
is of a table (the input is written first), so that a repeated task deals alike.

Defined cases: a null text has no bytes (size 16, CRC of nothing); null doc_ids
are records like others; equal records keep all their rows; an empty table gives an
empty table; further columns travel along in ``write_shards``, one named like a column
of the operator under that name with an underscore behind. Results depend on the seed
and the rows alone, not on files or partitions, but for equal records that fill more
than a bucket.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import small_side, written

N_SHARDS = 40
SEED = 20_240_229
#: Of text and overhead in one bucket; a worker holds a bucket a few times over.
BUCKET_BYTES = 8 << 20
OVERHEAD = 16
#: Bucket sizes are broadcast up to so many buckets (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_BUCKETS = 200_000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: from the last place down, swap with a random place not above."""
    order = np.arange(n)
    picks = (rng.random(max(0, n - 1)) * np.arange(n, 1, -1)).astype(np.int64)
    for i, j in zip(range(n - 1, 0, -1), picks.tolist()):
        order[i], order[j] = order[j], order[i]
    return order


def record_size(col: str = "text"):
    """UTF-8 bytes of the text plus 16."""
    return (F.coalesce(F.octet_length(col), F.lit(0)) + F.lit(OVERHEAD)).cast("long")


def _dealt(docs: DataFrame, seed: int, bucket_bytes: int, buckets: int | None) -> DataFrame:
    """bucket and record (a struct of all columns)."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"))
    same, size = F.xxhash64(F.lit(seed), "record.doc_id", "record.text"), record_size("record.text")
    sizes = packed.groupBy(same.alias("same")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n"))
    large = F.when((F.col("n") > 1) & (F.col("bytes") > bucket_bytes), F.col("same"))
    groups = written(sizes.groupBy(large.alias("same")).agg(F.sum("bytes").alias("bytes")))  # those of one record or few are one row
    if buckets is None:
        buckets = max(1, -(-(groups.agg(F.sum("bytes").alias("n")).first()["n"] or 0) // bucket_bytes))
    crowded = groups.where("same is not null").select("same", F.ceil(F.col("bytes") / bucket_bytes).alias("spread"))
    keyed = packed.withColumn("same", same)
    if crowded.isEmpty():
        salted = keyed.withColumn("salt", F.lit(0).cast("long"))
    else:
        placed = written(keyed).withColumn("at", F.monotonically_increasing_id())
        salted = placed.join(small_side(crowded, BROADCAST_BUCKETS), "same", "left").withColumn("salt", F.pmod(F.xxhash64("at"), F.coalesce("spread", F.lit(1))))
    # Without a salt the bucket is that of the record's own hash.
    return salted.select(F.pmod(F.when(F.col("salt") == 0, F.col("same")).otherwise(F.xxhash64("same", "salt")), F.lit(buckets)).cast("int").alias("bucket"), "record")


def shuffle_records(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, buckets: int | None = None) -> DataFrame:
    """bucket, place (from 0 in its bucket after the shuffle) and record (a struct of all columns) of every row."""
    dealt = _dealt(docs, seed, bucket_bytes, buckets)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def shuffled(key, table):
        record = table.column("record").combine_chunks()
        record = record.chunk(0) if isinstance(record, pa.ChunkedArray) else record
        crc = pa.array([zlib.crc32((t or "").encode()) for t in record.field(text_at).to_pylist()], pa.int64())
        by = pa.table({"id": record.field(id_at), "crc": crc}).append_column("at", pa.array(np.arange(table.num_rows)))
        ordered = by.sort_by([("id", "ascending"), ("crc", "ascending"), ("at", "ascending")]).column("at")
        order = fisher_yates(table.num_rows, np.random.default_rng([seed, int(key[0].as_py())]))
        out = table.take(ordered.take(pa.array(order)))
        return out.append_column("place", pa.array(np.arange(table.num_rows), pa.int64()))

    schema = T.StructType([*dealt.schema.fields, T.StructField("place", T.LongType())])
    return dealt.groupBy("bucket").applyInArrow(shuffled, schema)


def write_shards(docs: DataFrame, shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write all records in shuffled order and return the written table with ``shard`` and ``slot`` (law ``rows``)."""
    names = docs.columns
    stored = written(shuffle_records(docs, seed, bucket_bytes))
    sizes = stored.groupBy("bucket").agg(F.count("*").alias("n"))
    # Running totals of the bucket sizes: buckets are grouped by a thousand, so no task sees all of them at once.
    grouped = sizes.withColumn("block", F.floor(F.col("bucket") / 1000))
    blocks = grouped.groupBy("block").agg(F.sum("n").alias("block_n"))
    before = blocks.withColumn("before", F.sum("block_n").over(Window.orderBy("block")) - F.col("block_n")).drop("block_n")
    within = grouped.withColumn("within", F.sum("n").over(Window.partitionBy("block").orderBy("bucket")) - F.col("n"))
    starts = written(within.join(before, "block").select("bucket", (F.col("before") + F.col("within")).alias("first")))
    starts = small_side(starts, BROADCAST_BUCKETS)
    at = F.col("first") + F.col("place")
    own = [F.col("record")[c].alias(c if c.lower() not in ("shard", "slot") else f"{c}_") for c in names]
    return stored.join(starts, "bucket").select(*own, F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def shard_report(docs: DataFrame, shards: int = N_SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Shard and slot of each record, with its size and CRC as read back from the written buckets; ``shard_files`` writes the shards."""
    laid = write_shards(docs.select("doc_id", "text"), shards, seed, bucket_bytes)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return laid.select("doc_id", record_size().alias("size"), crc.cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_files(laid: DataFrame, path: str) -> None:
    """Write the shards as folders shard=0.. of Parquet files, each file in slot order."""
    laid.repartition("shard", F.floor(F.col("slot") / 50_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
