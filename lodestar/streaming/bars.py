"""Bars and signals as streams; the batch functions do the work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_stream(trades: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Bars of a stream (symbol, ts, price), each emitted once when no more of it can come."""
    timed = trades.where("price > 0").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", width), "symbol").agg(F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "ts").alias("c"), F.count("*").cast("double").alias("v"))
    return out.select("symbol", F.unix_seconds(F.col("window.start")).alias("t"), "o", "h", "l", "c", "v")


SIGNAL = "symbol string, t long, kind string, state string"


def signal_stream(states: DataFrame) -> DataFrame:
    """Transitions of (symbol, t, eligible, state): rows that aren't eligible, and rows older than the last, change nothing."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (None, -1)
        out = []
        for row in pd.concat(list(frames)).sort_values("t").itertuples():
            if not row.eligible or row.t <= seen:
                continue
            now = None if row.state is None or row.state != row.state else row.state
            if now != last:
                out.append((key[0], row.t, "activated" if last is None else "cleared" if now is None else "changed", now))
            last, seen = now, row.t
        state.update((last, seen))
        yield pd.DataFrame(out, columns=["symbol", "t", "kind", "state"])

    return states.groupBy("symbol").applyInPandasWithState(step, SIGNAL, "last string, seen long", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what its source has now; the result as a table in memory (for small outputs and tests)."""
    from lodestar.sources.shared import shared_folder

    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def scan_batches(stream: DataFrame, scan, path: str, checkpoint: str):
    """Apply ``scan`` to each micro-batch and write its rows under the batch's number: a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
