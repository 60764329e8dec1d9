"""The catalogue: one query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.config import CURRENT
from lodestar.functions import scalars
from lodestar.operators import archive, board, context, decide, events, research, scan, strength, structure
from lodestar.plans import panels
from lodestar.plans.panels import BENCHMARK, SECONDARY, STEP, STRENGTH
from lodestar.sinks import report
from lodestar.sources import bars

HORIZONS = (1, 4)
COST = 10.0
OUT = ("symbol", "t")


def r6(*names: str) -> list[Column]:
    return [F.round(F.col(n).cast("double"), 6).alias(n) for n in names]


def ohlcv_daily(spark, d):
    return panels.daily(spark, d).select(*OUT, *r6(*"ohlcv"))


def ohlcv_6h(spark, d):
    return panels.six_hours(spark, d).select(*OUT, *r6(*"ohlcv"))


def daily_rollup(spark, d):
    return bars.rollup(panels.six_hours(spark, d), STEP).select(*OUT, *r6(*"ohlcv"))


def completed_bars(spark, d):
    own = panels.six_hours(spark, d)
    as_of = own.agg(F.max("t").alias("as_of"))
    return own.join(F.broadcast(as_of)).where(F.col("t") + STEP <= F.col("as_of")).select(*OUT, *r6("c"))  # one row


def bar_validity(spark, d):
    raw = panels.table(spark, d, "events").select(F.col("event_type").alias("symbol"), *(F.col("value").alias(c) for c in "ohlc"), F.lit(1.0).alias("v"))
    return raw.groupBy("symbol", bars.valid_bar().alias("valid")).agg(F.count("*").alias("n"))


def cpr_levels(spark, d):
    return structure.with_levels(panels.daily(spark, d)).select(*OUT, *r6("pivot", "bc", "tc", "bottom", "top", "width"))


def floor_pivots(spark, d):
    return structure.with_levels(panels.daily(spark, d)).select(*OUT, *r6("pivot", "r1", "r2", "r3", "s1", "s2", "s3"))


def positions(spark, d):
    return structure.market_structure(panels.daily(spark, d)).select(*OUT, "cpr_position", "pivot_position")


def wilder_atr(spark, d):
    return structure.wilder_atr(panels.daily(spark, d)).select(*OUT, *r6("tr", "atr"))


def realized_vol(spark, d):
    return structure.realized_volatility(panels.daily(spark, d)).select(*OUT, *r6("volatility"))


def width_percentile_regime(spark, d):
    return structure.width_regime(panels.daily(spark, d)).select(*OUT, *r6("width_percentile"), "width_regime")


def level_distance_atr(spark, d):
    own = structure.market_structure(panels.daily(spark, d))
    return own.select(*OUT, F.explode("distances").alias("level", "distance")).select(*OUT, "level", *r6("distance"))


def daily_quality_flags(spark, d):
    own = panels.daily(spark, d)
    as_of = own.agg(F.max("t") + 2 * bars.DAY).first()[0] or 0
    return structure.quality_flags(own, as_of).select("symbol", F.array_join("flags", ",").alias("flags"))


def aligned_returns(spark, d):
    return strength.runs(strength.aligned(panels.six_hours(spark, d), BENCHMARK), STEP).select(*OUT, *r6("rc", "rb"))


def contiguous_suffix(spark, d):
    rows = strength.runs(strength.aligned(panels.six_hours(spark, d), BENCHMARK), STEP)
    last = rows.groupBy("symbol", "run").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    return last.groupBy("symbol").agg(F.max_by(F.struct("n", "first", "last"), "run").alias("x")).select("symbol", "x.*")


def alignment_ratio(spark, d):
    return strength.alignment_ratio(panels.six_hours(spark, d), BENCHMARK, STEP).select("symbol", "common", "expected", *r6("ratio"))


def _windows(spark, d):
    return strength.look_back(strength.runs(strength.aligned(panels.six_hours(spark, d), BENCHMARK, SECONDARY), STEP), STRENGTH)


def robust_scale(spark, d):
    return strength.robust_scale(_windows(spark, d), "ra", "location", "scale").select(*OUT, "n", *r6("location", "scale"))


def winsorized_returns(spark, d):
    cut = strength.winsorized(_windows(spark, d), "ra", "cut", 2.0)  # a narrow limit, so that values are cut
    return cut.select(*OUT, F.round(scalars.total(F.col("cut")), 6).alias("total"), F.size(F.filter(F.zip_with("cut", "ra", lambda a, b: a != b), lambda x: x)).cast("long").alias("n_cut"))


def ewma_weights(spark, d):
    sizes = _windows(spark, d).select("n").distinct()
    return sizes.select("n", F.posexplode(scalars.ewma_weights(F.col("n"), STRENGTH.half_life)).alias("i", "weight")).select("n", F.col("i").cast("long").alias("i"), F.round("weight", 9).alias("weight"))


def ols_beta(spark, d):
    rows = strength.runs(strength.aligned(panels.six_hours(spark, d), BENCHMARK), STEP).where("rc is not null")
    fit = rows.groupBy("symbol").agg(F.count("*").alias("n"), F.regr_slope("rc", "rb").alias("beta"), F.regr_intercept("rc", "rb").alias("alpha"), F.regr_r2("rc", "rb").alias("r_squared"), F.regr_sxx("rc", "rb").alias("sxx"), F.regr_syy("rc", "rb").alias("syy"))
    rest = F.sqrt(F.col("syy") * (1 - F.col("r_squared")) / (F.col("n") - 2))
    return fit.withColumns({"residual_volatility": rest, "beta_error": rest / F.sqrt("sxx")}).select("symbol", "n", *r6("beta", "alpha", "r_squared", "residual_volatility", "beta_error"))


def robust_beta_one_factor(spark, d):
    return panels.scored(spark, d).select(*OUT, *r6("beta", "alpha", "r_squared", "residual_volatility", "beta_error", "n_eff"))


def robust_beta_two_factor(spark, d):
    return panels.scored(spark, d, SECONDARY).select(*OUT, *r6("beta", "beta_2", "alpha", "r_squared", "beta_error", "beta_2_error", "g_beta"))


def factor_residuals(spark, d):
    return panels.scored(spark, d).select(*OUT, F.posexplode("residuals").alias("i", "residual")).select(*OUT, F.col("i").cast("long").alias("i"), *r6("residual"))


def horizon_robust_z(spark, d):
    names = [f"{k}_{h}" for h in ("short", "medium", "long") for k in ("z", "sum", "pct")]
    return panels.scored(spark, d).select(*OUT, *r6(*names))


def persistence_acceleration(spark, d):
    return panels.scored(spark, d).select(*OUT, *r6("persistence", "acceleration"))


def rs_score(spark, d):
    return panels.scored(spark, d).select(*OUT, *r6("raw_score", "raw_discovery"))


def rs_score_two_factor(spark, d):
    return panels.scored(spark, d, SECONDARY).select(*OUT, "score", "discovery", F.array_join("flags", ",").alias("flags"))


def loo_factor(spark, d):
    own = decide.leave_one_out(panels.weekly(spark, d), "Brand#11", panels.WEEK, 20)
    return own.where("f is not null").select(*OUT, "others", *r6("f"))


def loo_level(spark, d):
    return decide.leave_one_out(panels.weekly(spark, d), "Brand#11", panels.WEEK, 20).where("f is not null").select(*OUT, *r6("s"), "least_others")


def rs_score_broad(spark, d):
    own = panels.six_hours(spark, d)
    factor = decide.leave_one_out(own, BENCHMARK, STEP, 3)
    return strength.relative_strength(own, BENCHMARK, STEP, STRENGTH, factor=factor).select(*OUT, *r6("beta", "beta_2"), "score", F.array_join("flags", ",").alias("flags"))


def _changes(spark, d):
    own = Window.partitionBy("symbol").orderBy("t")
    w = panels.weekly(spark, d)
    return w.withColumn("score", F.when(F.col("t") - F.lag("t").over(own) == panels.WEEK, F.round(F.log(F.col("c") / F.lag("c").over(own)), 3)))


def strength_rank(spark, d):
    return decide.strength_ranks(_changes(spark, d)).select(*OUT, F.col("strong_rank").cast("long").alias("strong_rank"), F.col("weak_rank").cast("long").alias("weak_rank"))


def breadth(spark, d):
    return decide.breadth(panels.scored(spark, d), "score").select("t", "panel", "usable", *r6("positive", "strong", "median_score"))


def breadth_weekly(spark, d):
    return decide.breadth(_changes(spark, d)).select("t", "panel", "usable", *r6("positive", "strong", "median_score"))


def residual_momentum_percentile(spark, d):
    return decide.average_rank_percentile(_changes(spark, d), "score", "percentile").select(*OUT, *r6("percentile"))


def volume_context(spark, d):
    """Last day's notional against the median of up to 20 whole day blocks before, at the last bar."""
    own = panels.six_hours(spark, d)
    block = F.floor((F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("t"))) - 1) / 4)
    days = own.withColumn("block", block).groupBy("symbol", "block").agg(F.sum(F.col("c") * F.col("v")).alias("notional"), F.count("*").alias("n")).where("block <= 20 and (n = 4 or block = 0)")
    out = days.groupBy("symbol").agg(F.max(F.when(F.col("block") == 0, F.col("notional"))).alias("notional"), F.median(F.when(F.col("block") > 0, F.col("notional"))).alias("base"))
    return out.select("symbol", F.round("notional", 4).alias("notional"), F.round(F.try_divide(F.col("notional"), F.col("base")), 6).alias("relative"))


def universe_topk(spark, d):
    rows = panels.weekly(spark, d).withColumn("notional", F.round(F.col("c") * F.col("v"), 2))
    return decide.select_universe(rows, 8, ("Brand#11", "Brand#22")).select(*OUT)


def setup_label(spark, d):
    rows = panels.scan(spark, d)
    return rows.select(*OUT, "label", "direction", *r6("strength"), "confirmation", "tier", F.array_join("reasons", "; ").alias("reasons"), F.array_join("blockers", "; ").alias("blockers"))


def active_triggers(spark, d):
    return decide.triggers(panels.scan(spark, d)).select("rule", *OUT, "eligible", "state", "direction", *r6("trigger_score"))


def rule_transitions(spark, d):
    return panels.activations(spark, d).select("rule", *OUT, "kind", "direction", *r6("trigger_score"))


def archive_event_counts(spark, d):
    rows = panels.scan(spark, d)
    return archive.event_counts(archive.seeded(decide.transitions(decide.triggers(rows))))


def _outcomes(spark, d):
    return events.forward_outcomes(panels.activations(spark, d), panels.six_hours(spark, d).withColumn("t", F.col("t") + STEP), BENCHMARK, STEP, HORIZONS)


def forward_outcomes(spark, d):
    return _outcomes(spark, d).select(*OUT, "direction", F.col("horizon").cast("long").alias("horizon"), *r6("gross", "adjusted"), "missing")


def _rates(spark, d):
    """A settlement every six hours; its rate follows from the bar's count."""
    return panels.six_hours(spark, d).select("symbol", "t", ((F.col("v") % 7 - 3) / 10_000).alias("rate"))


def _funded(spark, d):
    own = panels.six_hours(spark, d).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    return events.funding_costs(_outcomes(spark, d), _rates(spark, d), STEP, own["a"] or 0, own["b"] or 0)


def funding_cost(spark, d):
    return _funded(spark, d).select(*OUT, F.col("horizon").cast("long").alias("horizon"), "direction", *r6("funding"))


def net_event_metrics(spark, d):
    out = events.metrics(_funded(spark, d), ["horizon"], COST)
    return out.select(F.col("horizon").cast("long").alias("horizon"), "n", "missing", *r6("win_rate", "average_win", "average_loss", "expectancy", "profit_factor", "mean_deviation_ratio", "time_mean"))


def _plan(spark, d):
    own = panels.six_hours(spark, d).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    return events.calendar_plan(float(own["a"] or 0), float((own["b"] or 0) + STEP))


def calendar_partition(spark, d):
    return _outcomes(spark, d).groupBy("horizon", events.partition(_plan(spark, d)).alias("part")).agg(F.count("*").alias("n")).select(F.col("horizon").cast("long").alias("horizon"), "part", "n")


def score_buckets(spark, d):
    return panels.scored(spark, d).groupBy(events.buckets(F.round("z_medium", 6), [0.5, 1.0, 2.0]).alias("bucket")).agg(F.count("*").alias("n"))


def feature_buckets(spark, d):
    return panels.scored(spark, d).groupBy(events.buckets(F.round("acceleration", 6), [-1.0, 0.0, 1.0], True).alias("bucket")).agg(F.count("*").alias("n"))


def cohort_metrics(spark, d):
    out = events.cohort_metrics(_funded(spark, d), COST, ("direction", "symbol"))
    return out.select("cohort", "value", "n", "missing", *r6("win_rate", "expectancy"))


def block_bootstrap_ci(spark, d):
    found = events.block_bootstrap(_funded(spark, d).where("horizon = 4"), COST)
    return spark.createDataFrame([found or (None, None)], "low double, high double")


def _versions(spark, d):
    """Daily bars as three scans saw them: each revises a few."""
    own = panels.daily(spark, d)
    revised = lambda scan: own.where((F.col("t") / bars.DAY) % 3 == scan % 3).withColumns({"c": F.round(F.col("c") * (1 + scan / 100), 4), "scan": F.lit(scan)})
    return own.withColumn("scan", F.lit(1)).unionByName(revised(2)).unionByName(revised(3))


def candle_version_asof(spark, d):
    return archive.versions_as_of(_versions(spark, d), 2).select(*OUT, *r6("c"))


def first_version_prices(spark, d):
    return archive.first_versions(_versions(spark, d)).select(*OUT, *r6("c"))


def changed_versions(spark, d):
    new = panels.daily(spark, d).withColumn("c", F.when(F.col("symbol") == BENCHMARK, F.col("c") + 1).otherwise(F.col("c")))
    return archive.changed_versions(_versions(spark, d).where("scan = 1"), new, 2).select(*OUT, *r6("c"), F.col("scan").cast("long").alias("scan"))


def replay_audit(spark, d):
    now = panels.activations(spark, d).select("rule", *OUT, "trigger_score")
    then = now.where("symbol <> 'view'").withColumn("trigger_score", F.when(F.col("symbol") == "purchase", F.col("trigger_score") + 1).otherwise(F.col("trigger_score")))
    return archive.audit(now, then).select("rule", *OUT, "mismatch")


def gate_funnel(spark, d):
    rows = panels.scored(spark, d).where("score is not null")
    gates = {"strength": F.abs("raw_score") >= 2, "persistence": F.abs("persistence") >= 0.4, "both": (F.abs("raw_score") >= 2) & (F.abs("persistence") >= 0.4)}
    counts = rows.groupBy("symbol").agg(F.count("*").alias("usable"), *(F.count_if(c).alias(k) for k, c in gates.items()))
    return counts.withColumn("binding", F.when(F.col("strength") <= F.col("persistence"), "strength").otherwise("persistence"))


def json_context(spark, d):
    props = panels.table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.from_json("props", "k double").alias("x"), "value")
    return props.groupBy("symbol").agg(F.count("x.k").alias("n"), *[F.round(F.avg("x.k"), 6).alias("mean_k")], F.round(F.max("x.k"), 6).alias("max_k"))


def newest_bars(spark, d):
    return archive.newest(panels.six_hours(spark, d), 5).select(*OUT, *r6("c"))


def merged_bars(spark, d):
    own = panels.six_hours(spark, d)
    seen = own.withColumn("observed_at", F.col("t") + STEP).unionByName(own.withColumns({"c": F.col("c") + 1, "observed_at": F.col("t") + STEP - 60})).unionByName(own.where(F.col("symbol") == BENCHMARK).withColumns({"c": F.col("c") + 2, "observed_at": F.col("t") + 2 * STEP}))
    return archive.merged(seen, STEP).select(*OUT, *r6("c"), "verified")


def market_structure(spark, d):
    own = structure.market_structure(panels.daily(spark, d))
    return own.select(*OUT, *r6("pivot", "bottom", "top", "r1", "s1", "atr", "volatility", "width"), "width_regime", "cpr_position", "pivot_position")


# --- gates ---


def _gappy(spark, d):
    """The panel with gaps in two series, the benchmark's among them, and one that stops early."""
    own = panels.six_hours(spark, d)
    last = own.agg(F.max("t").alias("m")).first()["m"] or 0
    place = F.floor(F.col("t") / STEP)
    gone = ((F.col("symbol") == "view") & (place % 11 == 3)) | ((F.col("symbol") == "purchase") & (F.col("t") > last - 10 * STEP)) | ((F.col("symbol") == BENCHMARK) & (place % 53 == 5))
    return own.where(~gone), last


def _gappy_days(spark, d):
    own = panels.daily(spark, d)
    last = own.agg(F.max("t").alias("m")).first()["m"] or 0
    return own.where(~((F.col("symbol") == "view") & (F.floor(F.col("t") / bars.DAY) % 9 == 4)) & ~((F.col("symbol") == "purchase") & (F.col("t") > last - 3 * bars.DAY)))


def _gates():
    return F.size(F.filter("flags", lambda f: f == strength.STALE)).alias("gates")


def usability_gates(spark, d):
    own, _ = _gappy(spark, d)
    rows = strength.gated(strength.evaluated(own, BENCHMARK, STEP, STRENGTH), strength.alignment_at(own, BENCHMARK, STEP), STEP, STRENGTH)
    return rows.select(*OUT, F.col("bars").cast("long").alias("bars"), *r6("ratio"), _gates(), "reason", F.col("rs_usable").alias("usable"))


def stale_scan(spark, d):
    own, _ = _gappy(spark, d)
    newest = own.agg(F.max("t").alias("m")).first()["m"] or 0
    rows = scan.last_rows(scan.scan(own, panels.daily(spark, d), panels.SETTINGS, as_of=newest + STEP))
    return rows.select(*OUT, _gates(), F.col("rs_usable").alias("usable"))


def daily_gates(spark, d):
    times = panels.six_hours(spark, d).select("symbol", (F.col("t") + STEP).alias("as_of"))
    return structure.structure_at(times, _gappy_days(spark, d)).select("symbol", "as_of", F.array_join("daily_flags", ",").alias("flags"), *r6("pivot"))


# --- the board ---


def alert_states(spark, d):
    return panels.scan(spark, d).withColumn("alert", board.alert_state()).where("alert is not null").select(*OUT, "alert.label", "alert.direction", F.round("alert.strength", 6).alias("strength"))


def filter_counts(spark, d):
    return board.filter_counts(panels.scan(spark, d)).where("filter <> 'FLAGGED'")


def gate_verdicts(spark, d):
    return board.gate_verdict(panels.scan(spark, d)).select(*OUT, "strength_ok", "persistence_ok", "structure_ok")


def board_funnel(spark, d):
    return board.funnel(panels.scan(spark, d)).select("t", "scored", "strength", "persistence", "structure")


def board_order(spark, d):
    return panels.scan(spark, d).select(*OUT, F.col("strong_rank").cast("long").alias("place"))


def breadth_figures(spark, d):
    names = ("positive_rs_ratio", "strong_rs_ratio", "median_rs_score", "median_discovery_score")
    return report.breadth(panels.scan(spark, d), keys=("t",)).select("t", "usable_assets", "confirmed_candidates", "early_discoveries", "strong_discoveries", *r6(*names))


# --- contexts ---


def market_contexts(spark, d):
    mid = panels.six_hours(spark, d).groupBy("symbol").agg(F.max_by("c", "t").alias("mid"))
    text = lambda c: c.cast("string")
    raw = mid.select("symbol", text(F.col("mid") * 100).alias("dayNtlVlm"), text(F.col("mid")).alias("midPx"), *(F.lit(None).cast("string").alias(c) for c in ("markPx", "funding", "openInterest", "premium")), F.array(text(F.col("mid") * 0.999), text(F.col("mid") * 1.001)).alias("impactPxs"))
    out = context.market_context(raw, panels.daily(spark, d))
    return out.select("symbol", F.round("day_notional", 4).alias("day_notional"), F.round("impact_spread_bps", 6).alias("spread"), F.round("relative_notional", 6).alias("relative"))


def live_universe(spark, d):
    part = panels.table(spark, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.round(F.sum("p_retailprice"), 2).alias("x"))
    markets = part.select("name", F.col("name").endswith("5").alias("isDelisted"), F.format_string("%.2f", "x").alias("dayNtlVlm"))
    return context.live_universe(markets, 6, ("Brand#11", "Brand#22")).select("name", F.round("notional", 2).alias("notional"), F.col("place").cast("long").alias("place"))


def session_opens(spark, d):
    last = panels.six_hours(spark, d).agg(F.max("t").alias("m")).first()["m"] or 0
    return context.session_open(panels.daily(spark, d), last + 3600).select("symbol", *r6("session_open"))


def admission(spark, d):
    days = _gappy_days(spark, d)
    first = panels.daily(spark, d).agg(F.min("t").alias("m")).first()["m"] or 0
    return context.admission(days, days, first + 2 * bars.DAY).select("symbol", "completed", "admitted")


def volume_blocks(spark, d):
    return context.day_blocks(panels.six_hours(spark, d), STEP).select(*OUT, F.round("day_notional", 4).alias("day_notional"), F.round("relative_notional", 6).alias("relative"))


# --- research ---


def _closes(spark, d):
    """Bars by the time of their close, as activations are."""
    return panels.six_hours(spark, d).withColumn("t", F.col("t") + STEP)


def model_outcomes(spark, d):
    two = panels.scored(spark, d, SECONDARY).select("symbol", (F.col("t") + STEP).alias("t"), "beta", "beta_2", "g_beta")
    found = panels.activations(spark, d).drop("beta").join(two, ["symbol", "t"])
    out = research.outcomes(found, _closes(spark, d), BENCHMARK, STEP, HORIZONS, secondary=SECONDARY)
    return out.select(*OUT, F.col("horizon").cast("long").alias("horizon"), *r6("gross", "model_adjusted"))


def broad_forward(spark, d):
    entries = panels.activations(spark, d).select("symbol", F.col("t").alias("entry_t"), F.explode(F.array(*map(F.lit, HORIZONS))).alias("horizon"))
    own = _closes(spark, d).where(F.col("symbol") != BENCHMARK)
    members = own.select(F.col("t").alias("entry_t"), "symbol")
    out = research.broad_forward(entries, members, own, STEP, 2)
    return out.select("symbol", F.col("entry_t").alias("t"), F.col("horizon").cast("long").alias("horizon"), *r6("broad"))


def _specs(spark, d):
    specs = tuple(s for s in research.COMPARISON if s.model == CURRENT)
    return research.spec_triggers({CURRENT: panels.scan(spark, d)}, specs)


def spec_evaluations(spark, d):
    size = panels.scan(spark, d).groupBy("t").agg((F.count("*") + 1).alias("panel"))
    return research.evaluations(_specs(spark, d), size).select("spec_id", "t", "evaluated", "usable", "active", "unavailable")


def trigger_features(spark, d):
    shown = ("rs_score", "discovery_score", "residual_momentum_24h", "residual_momentum_percentile", "positive_rs_breadth", "completed_structure", "trigger_threshold")
    return _specs(spark, d).where("state is not null").select("spec_id", *OUT, *(F.round(F.col("features")[n], 6).alias(n) for n in shown))


def persistence_study(spark, d):
    out = research.persistence_study(panels.scored(spark, d), panels.six_hours(spark, d), BENCHMARK, STEP, None, (4, 8), (4,), 4)
    return out.select(*OUT, *r6("p4", "p8", "momentum", "fwd4"))


def fold_counts(spark, d):
    found = _outcomes(spark, d)
    out = None
    for i, (_, test_from, test_to) in enumerate(_plan(spark, d)["folds"]):
        one = found.withColumn("part", research.split(test_from, test_to)).where("part is not null").withColumn("fold", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(F.col("horizon").cast("long").alias("horizon"), "fold", "part").agg(F.count("*").alias("n"))


def signal_stream(spark, d):
    from lodestar.sources.shared import shared_folder
    from lodestar.streaming import bars as streams

    z = F.col("z_medium")
    states = panels.scored(spark, d).select("symbol", "t", F.lit(True).alias("eligible"), F.when(F.abs(z) >= 1, F.when(z > 0, "LONG").otherwise("SHORT")).alias("state"))
    path = shared_folder(spark)
    states.write.parquet(path)
    return streams.drained(streams.signal_stream(spark.readStream.schema(states.schema).parquet(path)), spark, "signal_stream")


def bars_stream(spark, d):
    from lodestar.streaming import bars as streams

    source = panels.table(spark, d, "events")
    rows = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    own = streams.daily_stream(rows.select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price")))
    return streams.drained(own, spark, "bars_stream", "complete").select(*OUT, *r6(*"ohlcv"))


QUERIES = (
    ohlcv_daily, ohlcv_6h, daily_rollup, completed_bars, bar_validity, cpr_levels, floor_pivots, positions, wilder_atr, realized_vol, width_percentile_regime,
    level_distance_atr, daily_quality_flags, market_structure, aligned_returns, contiguous_suffix, alignment_ratio, robust_scale, winsorized_returns, ewma_weights, ols_beta,
    robust_beta_one_factor, robust_beta_two_factor, factor_residuals, horizon_robust_z, persistence_acceleration, rs_score, rs_score_two_factor, rs_score_broad, loo_factor,
    loo_level, strength_rank, breadth, breadth_weekly, residual_momentum_percentile, volume_context, universe_topk, setup_label, active_triggers, rule_transitions,
    archive_event_counts, forward_outcomes, funding_cost, net_event_metrics, calendar_partition, score_buckets, feature_buckets, cohort_metrics, block_bootstrap_ci,
    usability_gates, stale_scan, daily_gates, alert_states, filter_counts, gate_verdicts, board_funnel, board_order, breadth_figures, market_contexts, live_universe, session_opens,
    admission, volume_blocks, model_outcomes, broad_forward, spec_evaluations, trigger_features, persistence_study, fold_counts,
    candle_version_asof, first_version_prices, changed_versions, replay_audit, gate_funnel, json_context, newest_bars, merged_bars, signal_stream, bars_stream,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
