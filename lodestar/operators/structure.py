"""Daily structure at every session: levels, range, volatility, width regime. One window partition by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import StructureConfig
from lodestar.functions.scalars import band_position, pivot_levels, pivot_position, true_range
from lodestar.sources.bars import DAY


def with_levels(daily: DataFrame) -> DataFrame:
    """Adds each session's levels (they hold for the next one)."""
    return daily.withColumns(pivot_levels(F.col("h"), F.col("l"), F.col("c")))


def ranges(daily: DataFrame) -> DataFrame:
    own = Window.partitionBy("symbol").orderBy("t")
    return daily.withColumn("tr", F.when(F.lag("c").over(own).isNotNull(), true_range(F.col("h"), F.col("l"), F.lag("c").over(own))))


def wilder_atr(daily: DataFrame, config: StructureConfig = StructureConfig()) -> DataFrame:
    """Adds tr and atr: the mean of the first true ranges of the history, then Wilder's smoothing."""
    p = config.atr_period
    back = Window.partitionBy("symbol").orderBy("t").rowsBetween(-(config.history - 2), 0)
    trs = F.collect_list("tr").over(back)  # skips the null of a series' first bar
    seed = F.aggregate(F.slice("trs", 1, p), F.lit(0.0), lambda a, x: a + x) / p
    smooth = F.aggregate(F.slice("trs", p + 1, config.history), seed, lambda a, x: (a * (p - 1) + x) / p)
    return ranges(daily).withColumn("trs", trs).withColumn("atr", F.when(F.size("trs") >= p, smooth)).drop("trs")


def realized_volatility(daily: DataFrame, config: StructureConfig = StructureConfig()) -> DataFrame:
    """Adds volatility: the sample deviation of the last daily log returns, a year of 365 days."""
    own = Window.partitionBy("symbol").orderBy("t")
    last = own.rowsBetween(-(config.volatility_period - 1), 0)
    r = daily.withColumn("r", F.log(F.col("c") / F.lag("c").over(own)))
    return r.withColumn("volatility", F.when(F.count("r").over(last) == config.volatility_period, F.stddev_samp("r").over(last) * F.sqrt(F.lit(365.0)))).drop("r")


def width_regime(daily: DataFrame, config: StructureConfig = StructureConfig()) -> DataFrame:
    """Adds width_percentile (share of earlier widths at most this one) and width_regime."""
    before = Window.partitionBy("symbol").orderBy("t").rowsBetween(-config.width_history, -1)
    levelled = daily if "width" in daily.columns else with_levels(daily)
    share = F.aggregate("ws", F.lit(0.0), lambda a, w: a + F.when(w <= F.col("width"), 1.0).otherwise(0.0)) / F.size("ws")
    out = levelled.withColumn("ws", F.collect_list("width").over(before)).withColumn("width_percentile", F.when(F.size("ws") >= config.least_width_history, share)).drop("ws")
    p = F.col("width_percentile")
    return out.withColumn("width_regime", F.when(p.isNull(), "unknown").when(p <= 0.25, "tight").when(p >= 0.75, "wide").otherwise("normal"))


def quality_flags(daily: DataFrame, as_of) -> DataFrame:
    """symbol and flags of its daily history at ``as_of`` (epoch seconds), in fixed order."""
    own = Window.partitionBy("symbol").orderBy("t")
    facts = daily.withColumn("gap", F.col("t") - F.lag("t").over(own)).groupBy("symbol").agg(
        F.count("*").alias("n"), F.max("t").alias("last"), F.bool_or(F.col("t") % DAY != 0).alias("off"), F.coalesce(F.bool_or(F.col("gap") != DAY), F.lit(False)).alias("gap")
    )
    midnight = F.floor(F.lit(as_of) / DAY) * DAY if not hasattr(as_of, "cast") else F.floor(as_of / DAY) * DAY
    named = {"insufficient_daily_history": F.col("n") < 2, "stale_daily_structure": F.col("last") != midnight - DAY, "invalid_daily_session": F.col("off"), "daily_history_gap": F.col("gap")}
    return facts.select("symbol", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in named.items()))).alias("flags"))


def market_structure(daily: DataFrame, config: StructureConfig = StructureConfig()) -> DataFrame:
    """For each session t: the levels that the session before left, position of its close, distances in ATR."""
    own = Window.partitionBy("symbol").orderBy("t")
    all_of = width_regime(realized_volatility(wilder_atr(with_levels(daily), config), config), config)
    names = ["pivot", "bottom", "top", "r1", "r2", "r3", "s1", "s2", "s3", "atr", "volatility", "width", "width_percentile", "width_regime"]
    moved = all_of.select("symbol", "t", F.col("c").alias("price"), *(F.lag(n).over(own).alias(n) for n in names)).where("pivot is not null")
    at = {n: F.col(n) for n in names}
    usable = F.col("atr") > 0
    distance = {n: F.when(usable, (F.col("price") - F.col(n)) / F.col("atr")) for n in ("pivot", "r1", "r2", "r3", "s1", "s2", "s3")}
    return moved.withColumns({"cpr_position": band_position(F.col("price"), F.col("bottom"), F.col("top")), "pivot_position": pivot_position(F.col("price"), at), "distances": F.create_map(*(x for n, d in distance.items() for x in (F.lit(n), d)))})


LEVELS = ("pivot", "bottom", "top", "r1", "r2", "r3", "s1", "s2", "s3", "atr", "volatility", "width", "width_percentile", "width_regime")


def structure_at(times: DataFrame, daily: DataFrame, config: StructureConfig = StructureConfig()) -> DataFrame:
    """The rows of ``times`` (symbol, as_of, ...) with the levels of the last session closed by then, and daily_flags.

    Sessions and times are sorted together by symbol, so this is an as-of join without a
    range. Fewer than two sessions leave no levels. Flags: insufficient, stale, off the
    day's grid, a gap in the history up to then.
    """
    own = Window.partitionBy("symbol").orderBy("t")
    sofar = own.rowsBetween(Window.unboundedPreceding, 0)
    whole = width_regime(realized_volatility(wilder_atr(with_levels(daily), config), config), config)
    faults = whole.withColumns({"_n": F.row_number().over(own), "_off": F.max(F.col("t") % DAY != 0).over(sofar), "_step": F.col("t") - F.lag("t").over(own)})
    known = faults.withColumn("_gap", F.coalesce(F.max(F.col("_step") != DAY).over(sofar), F.lit(False)))
    fact = F.struct("t", "_n", "_off", "_gap", *LEVELS)
    kept = F.struct(*times.columns)
    both = known.select("symbol", (F.col("t") + DAY).alias("_at"), F.lit(0).alias("_kind"), fact.alias("_fact"), F.lit(None).cast(times.schema).alias("_row"))
    both = both.unionByName(times.select("symbol", F.col("as_of").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(known.select(fact.alias("x")).schema["x"].dataType).alias("_fact"), kept.alias("_row")))
    last = F.last("_fact", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumn("_last", last).where("_kind = 1").select("_row.*", F.col("_last").alias("_f"))
    enough = F.coalesce(F.col("_f._n") >= 2, F.lit(False))
    midnight = F.floor(F.col("as_of") / DAY) * DAY
    named = {"stale_daily_structure": F.col("_f.t") != midnight - DAY, "invalid_daily_session": F.col("_f._off"), "daily_history_gap": F.col("_f._gap")}
    flags = F.when(enough, F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in named.items())))).otherwise(F.array(F.lit("insufficient_daily_history")))
    return met.select(*times.columns, flags.alias("daily_flags"), *(F.when(enough, F.col(f"_f.{n}")).alias(n) for n in LEVELS))
