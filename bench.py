"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS], and the replay of 300 closes of 40 and 60 made-up markets; prints one JSON line.

A first job that isn't counted starts the session; the made-up markets are tables before
the replay is timed.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import CURRENT, ScanConfig
from lodestar.operators import research, scan
from lodestar.plans import catalogue
from lodestar.sources import bars
from lodestar.sources.shared import shared_folder

HEADLINES = (
    "ohlcv_daily", "ohlcv_6h", "market_structure", "aligned_returns", "ols_beta", "robust_beta_one_factor", "loo_factor", "strength_rank", "residual_momentum_percentile", "universe_topk", "candle_version_asof", "json_context",
    "rs_score", "rs_score_two_factor", "setup_label", "active_triggers", "forward_outcomes",
)
CLOSES, AHEAD = 300, 24


def made(spark: SparkSession, size: int) -> tuple[DataFrame, DataFrame]:
    """Hourly and daily bars of made-up markets, as tables."""
    path = shared_folder(spark)
    whole = bars.demo_markets(spark, size)
    whole.where(F.col("t") >= bars.DEMO_END - CLOSES * 3600).write.parquet(f"{path}/hourly")
    bars.rollup(whole, 3600).write.parquet(f"{path}/daily")
    return spark.read.parquet(f"{path}/hourly"), spark.read.parquet(f"{path}/daily")


def replay(hourly: DataFrame, daily: DataFrame) -> DataFrame:
    """The rule ``strong_discovery`` at each of the last closes, with what came after: symbol, t, direction, returns."""
    config = ScanConfig()
    rows = scan.scan(hourly, daily, config)
    spec = research.Specification("D", "discovery", "strong_discovery")
    found = research.spec_transitions(research.spec_triggers({CURRENT: rows}, (spec,)))
    return research.outcomes(found.where("kind <> 'cleared'"), hourly, config.benchmark, config.step, (AHEAD,), secondary=config.secondary)


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1_000_000).selectExpr("id % 7 k", "id v").groupBy("k").sum("v").collect()
    jobs = {name: (lambda q=catalogue.queries()[name]: q(spark, where)) for name in HEADLINES} | {f"replay_{n}_markets_{CLOSES}_closes": (lambda tables=made(spark, n): replay(*tables)) for n in (40, 60)}
    took: dict[str, float] = {}
    for name, job in jobs.items():
        began = time.time()
        job().write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries and replays, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": where.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
