"""Readers of what was published: histories of transitions and snapshots."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_SHOWN = 500


def read_history(spark: SparkSession, path: str, limit: int = 100, schema: str = "event_id long, t long, symbol string, kind string, state string") -> DataFrame:
    """The newest events first, 1 to 500; a torn line is left out."""
    held = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return held.where(F.isnull("_broken") & F.col("event_id").isNotNull()).drop("_broken").orderBy(F.desc("event_id")).limit(max(1, min(MOST_SHOWN, limit)))


def newest_events(path: str | Path, limit: int = 100) -> list[dict]:
    """The same without Spark, for a history on the driver: no more than so many events are held."""

    def whole() -> Iterator[dict]:
        for line in lines:
            try:
                event = json.loads(line)
            except ValueError:
                continue
            if isinstance(event, dict) and isinstance(event.get("event_id"), int):
                yield event

    try:
        with open(path, encoding="utf-8", errors="replace") as lines:
            return heapq.nlargest(max(1, min(MOST_SHOWN, limit)), whole(), key=lambda e: e["event_id"])
    except FileNotFoundError:
        return []


def read_snapshot(path: str | Path) -> dict | None:
    """A published snapshot; None if there is none, or if it isn't an object."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None
