"""Panels from the given tables, and the settings that the catalogue uses with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import ScanConfig, StrengthConfig
from lodestar.operators import decide, strength
from lodestar.operators import scan as scans
from lodestar.sources import bars

STEP = 21_600
BENCHMARK, SECONDARY = "click", "view"
STRENGTH = StrengthConfig.for_interval(STEP)
WEEK = 604_800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.ohlcv(trades(spark, sf_dir), bars.DAY)


def six_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.ohlcv(trades(spark, sf_dir), STEP)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (brand), t (Monday), c (mean unit price), v: every brand's weeks; the join's small side is broadcast by its size."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity").join(part, "l_partkey")
    week = (F.floor((bars.epoch(F.col("l_shipdate")) - 345_600) / WEEK) * WEEK + 345_600).cast("long")
    return items.groupBy("symbol", week.alias("t")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("c"), F.sum("l_quantity").alias("v"))


def scored(spark: SparkSession, sf_dir: str, secondary: str | None = None) -> DataFrame:
    return strength.relative_strength(six_hours(spark, sf_dir), BENCHMARK, STEP, STRENGTH, secondary)


#: The panel's settings: one factor, six-hour bars.
SETTINGS = ScanConfig(benchmark=BENCHMARK, step=STEP, secondary=None, strength=STRENGTH)


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan's rows that have a score, at every completed bar."""
    return scans.scan(six_hours(spark, sf_dir), daily(spark, sf_dir), SETTINGS).where("score is not null")


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule, symbol, t (entry bar), direction, trigger_score, beta: a volatility-free stand-in rule, dense enough to measure.

    A symbol is active while its medium residual sum is beyond its own robust scale.
    """
    rows = scored(spark, sf_dir)
    z = F.col("z_medium")
    states = rows.select(F.lit("residual_scale").alias("rule"), "symbol", "t", F.lit(True).alias("eligible"), F.when(F.abs(z) >= 1, F.lit("residual_scale")).alias("state"), F.when(F.abs(z) >= 1, F.when(z > 0, "LONG").otherwise("SHORT")).alias("direction"), z.alias("trigger_score"), "beta")
    return decide.transitions(states).where(F.col("kind").isin("activated", "changed")).withColumn("t", F.col("t") + STEP)
