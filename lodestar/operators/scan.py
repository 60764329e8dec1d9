"""The scan: scores, gates, daily structure, setups and ranks at every completed bar, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import BROAD_FACTOR, ScanConfig
from lodestar.functions.scalars import band_position, pivot_position
from lodestar.operators import decide, strength, structure

#: Names of the model, alone and with the broad factor.
MODEL = "robust_ewma_empirical_discovery_v2"
MODEL_BROAD = MODEL + "+broad_alt_l1o"


def scan(bars: DataFrame, daily: DataFrame, config: ScanConfig, since: int | None = None, mids: DataFrame | None = None, as_of: int | None = None) -> DataFrame:
    """A row for each symbol but the benchmark and each common bar t (from ``since`` on).

    Prices are the bar's close, or a live mid (``mids``: symbol, price, prior_price); what is
    confirmed always comes from closes. ``as_of`` is the time of the scan, by default each
    bar's own close; a bar that isn't the last one to close by then is stale.
    """
    step, benchmark = config.step, config.benchmark
    there = {r["symbol"] for r in bars.where(F.col("symbol").isin(benchmark, config.secondary or benchmark)).select("symbol").distinct().collect()}
    if benchmark not in there:
        raise ValueError(f"the benchmark {benchmark} has no bars")
    broad = config.secondary == BROAD_FACTOR
    factor = decide.leave_one_out(bars, benchmark, step, config.strength.least_constituents) if broad else None
    second = config.secondary if not broad and config.secondary in there else None
    rows = strength.evaluated(bars, benchmark, step, config.strength, second, factor, since)
    at = F.lit(as_of) if as_of is not None else F.col("t") + step
    rows = strength.gated(rows, strength.alignment_at(bars, benchmark, step), step, config.strength, at)
    if broad:
        rows = rows.join(factor.select("symbol", "t", F.col("least_others").alias("constituents")), ["symbol", "t"], "left")
    else:
        rows = rows.withColumn("constituents", F.when((F.col("symbol") != F.lit(second or "")) & F.lit(second is not None), 1).cast("long"))
    own = Window.partitionBy("symbol").orderBy("t")
    closes = bars.select("symbol", "t", F.col("c").alias("closed_price"), F.lag("c").over(own).alias("closed_prior"))
    rows = rows.join(closes, ["symbol", "t"])
    if mids is None:
        rows = rows.withColumns({"price": F.col("closed_price"), "prior_price": F.col("closed_prior")})
    else:
        rows = rows.join(mids.select("symbol", "price", "prior_price"), "symbol")
    rows = structure.structure_at(rows.withColumn("as_of", at.cast("long")), daily, config.structure)
    levels = {n: F.col(n) for n in structure.LEVELS}
    rows = rows.withColumns({
        "market_usable": F.col("pivot").isNotNull() & (F.size("daily_flags") == 0), "model_version": F.lit(MODEL_BROAD if broad else MODEL), "input_cutoff": F.col("t") + step,
        "cpr_position": F.when(F.col("pivot").isNull(), "unavailable").otherwise(band_position(F.col("price"), F.col("bottom"), F.col("top"))),
        "pivot_position": F.when(F.col("pivot").isNull(), "unavailable").otherwise(pivot_position(F.col("price"), levels)),
    })
    judged = decide.assess(rows, config.decision).withColumn("_usable_score", F.when(F.col("rs_usable"), F.col("score")))
    return decide.strength_ranks(judged, "_usable_score").drop("_usable_score")


def last_rows(rows: DataFrame) -> DataFrame:
    """Each symbol's last row: the scan of a time at which some bars are missing."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("t")))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n")
