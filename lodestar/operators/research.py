"""The event study: specifications, features, transitions, outcomes, coverage and summaries.

Everything is keyed by specification, time and horizon, so all specifications and
horizons come from one scan a factor model.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.config import BROAD, CURRENT, DecisionConfig
from lodestar.operators import decide, events


@dataclass(frozen=True)
class Specification:
    spec_id: str
    label: str
    rule: str
    model: str = CURRENT


# The comparison of five, and the thresholds of the rule that ranks.
COMPARISON = (
    Specification("H1", "Frozen H1", "confirmed_candidate"),
    Specification("D1", "Persistence-free discovery", "strong_discovery"),
    Specification("H5", "Discovery plus completed structure", "h5_discovery_structure"),
    Specification("B1", "24h residual-momentum baseline", "residual_momentum_baseline"),
    Specification("H6", "H5 with BTC plus broad-alt factor", "h5_discovery_structure", BROAD),
)
MOMENTUM = 0.80
# The names of the features.
FEATURES = (
    "rs_score", "discovery_score", "persistence", "acceleration", "beta", "beta_standard_error", "secondary_beta", "secondary_primary_beta", "beta_r_squared",
    "cpr_width_percentile", "relative_notional_volume", "day_notional_volume", "impact_spread_bps", "funding_rate", "open_interest", "positive_rs_breadth",
    "residual_momentum_24h", "residual_momentum_percentile", "secondary_factor_constituents", "completed_structure", "trigger_threshold",
)
#: Where the features that are a scan's own columns come from.
COLUMNS = {
    "rs_score": "score", "discovery_score": "discovery", "persistence": "persistence", "acceleration": "acceleration", "beta": "beta", "beta_standard_error": "beta_error", "secondary_beta": "beta_2", "secondary_primary_beta": "g_beta",
    "beta_r_squared": "r_squared", "cpr_width_percentile": "width_percentile", "relative_notional_volume": "relative_notional", "day_notional_volume": "day_notional", "impact_spread_bps": "impact_spread_bps", "funding_rate": "funding_rate",
    "open_interest": "open_interest", "positive_rs_breadth": "breadth", "residual_momentum_24h": "sum_medium", "residual_momentum_percentile": "momentum", "secondary_factor_constituents": "constituents",
}


def _threshold(config: DecisionConfig) -> Column:
    rule = F.col("rule")
    return F.when(rule == "confirmed_candidate", config.candidate).when(rule == "residual_momentum_baseline", MOMENTUM).when(rule == "early_discovery", config.early).otherwise(config.strong).cast("double")


def model_triggers(rows: DataFrame, rules: tuple[str, ...], model: str, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """The rules' states on one model's scan, with model, entry price and the features of active ones (contexts where the scan has them)."""
    usable = F.col("rs_usable")
    known = rows.withColumn("breadth", F.avg(F.when(usable, (F.col("score") > 0).cast("double"))).over(Window.partitionBy("t")))
    missing = [c for c in COLUMNS.values() if c not in known.columns and c != "momentum"]
    known = known.withColumns({c: F.lit(None).cast("double") for c in missing})
    carry = (*dict.fromkeys(c for c in COLUMNS.values()), "closed_price", "price", "model_version", "top", "bottom", "pivot")
    states = decide.triggers(known, rules, config, model == BROAD, carry)
    side = F.when(F.col("closed_price").isNotNull(), decide.side(F.col("closed_price")))
    made = {n: F.col(c).cast("double") for n, c in COLUMNS.items()} | {"completed_structure": F.when(side == F.col("direction"), 1.0).otherwise(0.0), "trigger_threshold": _threshold(config)}
    features = F.create_map(*(x for n in FEATURES for x in (F.lit(n), made[n])))
    return states.select("rule", F.lit(model).alias("model"), "symbol", "t", "eligible", "state", "direction", "trigger_score", F.coalesce("closed_price", "price").alias("entry_price"), "model_version", "beta", "beta_2", "g_beta", F.when(F.col("state").isNotNull(), features).alias("features"))


def registry(spark: SparkSession, specs: tuple[Specification, ...] = COMPARISON) -> DataFrame:
    """spec_id, spec_label, rule, model: a row for each specification."""
    return spark.createDataFrame([(s.spec_id, s.label, s.rule, s.model) for s in specs], "spec_id string, spec_label string, rule string, model string")


def spec_triggers(scans: dict[str, DataFrame], specs: tuple[Specification, ...] = COMPARISON, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """The states of all specifications; scans: a model's name and its scan."""
    out = None
    for model in dict.fromkeys(s.model for s in specs):
        own = model_triggers(scans[model], tuple(dict.fromkeys(s.rule for s in specs if s.model == model)), model, config)
        out = own if out is None else out.unionByName(own)
    return out.join(F.broadcast(registry(out.sparkSession, specs)), ["rule", "model"])  # a row a specification


def spec_transitions(states: DataFrame) -> DataFrame:
    return decide.transitions(states, ("spec_id", "symbol"))


def evaluations(states: DataFrame, panel: DataFrame) -> DataFrame:
    """spec_id, t, evaluated, usable, factor_available, active, unavailable, model_versions. panel: (t, panel), the benchmark counted."""
    own = states.groupBy("spec_id", "spec_label", "rule", "model", "t").agg(
        F.count("*").alias("evaluated"), F.count_if("eligible").alias("usable"), F.count_if(F.col("eligible") & F.col("beta_2").isNotNull()).alias("factor_available"),
        F.count_if(F.col("state").isNotNull()).alias("active"), F.sort_array(F.collect_set("model_version")).alias("model_versions"),
    )
    return own.join(panel, "t").withColumn("unavailable", F.greatest(F.col("panel") - 1, F.col("evaluated")) - F.col("usable")).drop("panel")


def coverage(rows: DataFrame) -> DataFrame:
    """evaluated, usable and factor_available rows of a scan."""
    usable = F.col("rs_usable")
    return rows.agg(F.count("*").alias("evaluated"), F.count_if(usable).alias("usable"), F.count_if(usable & F.col("beta_2").isNotNull()).alias("factor_available"))


def broad_forward(entries: DataFrame, members: DataFrame, bars: DataFrame, step: int, least: int) -> DataFrame:
    """symbol, entry_t, horizon, broad: what the other members at the entry made on average, summed over the steps to the exit.

    entries: symbol, entry_t, horizon; members: (entry_t, symbol), fixed at the entry. Each
    (entry, step) is summed over its members once, and a symbol's own return is taken out.
    Null where a step has fewer than ``least`` others.
    """
    own = Window.partitionBy("symbol").orderBy("t")
    r = bars.select("symbol", "t", F.when(F.col("t") - F.lag("t").over(own) == step, F.log(F.col("c") / F.lag("c").over(own))).alias("r")).where("r is not null")
    due = entries.select("entry_t", F.explode(F.sequence(F.col("entry_t") + step, F.col("entry_t") + F.col("horizon") * step, F.lit(step).cast("long"))).alias("t")).distinct()
    totals = due.join(members, "entry_t").join(r, ["symbol", "t"]).groupBy("entry_t", "t").agg(F.sum("r").alias("total"), F.count("*").alias("n"))
    steps = entries.select("symbol", "entry_t", "horizon", F.explode(F.sequence(F.col("entry_t") + step, F.col("entry_t") + F.col("horizon") * step, F.lit(step).cast("long"))).alias("t"))
    mine = steps.join(totals, ["entry_t", "t"], "left").join(r, ["symbol", "t"], "left")
    others = F.coalesce("n", F.lit(0)) - F.when(F.col("r").isNotNull(), 1).otherwise(0)
    mean = F.when(others >= least, (F.col("total") - F.coalesce("r", F.lit(0.0))) / others)
    summed = mine.withColumn("mean", mean).groupBy("symbol", "entry_t", "horizon").agg(F.sum("mean").alias("broad"), F.count("mean").alias("have"))
    return summed.select("symbol", "entry_t", "horizon", F.when(F.col("have") == F.col("horizon"), F.col("broad")).alias("broad"))


def outcomes(activations: DataFrame, bars: DataFrame, benchmark: str, step: int, horizons: tuple[int, ...], secondary: str | None = None, members: DataFrame | None = None, least: int = 5) -> DataFrame:
    """Activations (symbol, t: the bar whose close is the entry, beta, beta_2, g_beta, ...) with gross, benchmark, adjusted and model_adjusted returns.

    The model's secondary is a symbol, or with ``members`` (t, symbol) the mean of a
    fixed membership. Without a secondary beta the model is the benchmark's alone.
    """
    out = events.forward_outcomes(activations, bars, benchmark, step, horizons)
    bench = bars.where(F.col("symbol") == benchmark).select("t", F.col("c").alias("b"))
    if members is not None:
        entries = out.select("symbol", F.col("t").alias("entry_t"), "horizon").distinct()
        moved = broad_forward(entries, members.select(F.col("t").alias("entry_t"), "symbol").distinct(), bars.where(F.col("symbol") != benchmark), step, least)
        out = out.join(moved.select("symbol", F.col("entry_t").alias("t"), "horizon", F.col("broad").alias("_move")), ["symbol", "t", "horizon"], "left")
    elif secondary is not None:
        series = bars.where(F.col("symbol") == secondary).select("t", F.col("c").alias("s"))
        out = out.join(series.withColumnRenamed("s", "_s0"), "t", "left").join(series.select(F.col("t").alias("exit_t"), F.col("s").alias("_s1")), "exit_t", "left").withColumn("_move", F.log(F.col("_s1") / F.col("_s0"))).drop("_s0", "_s1")
    else:
        out = out.withColumn("_move", F.lit(None).cast("double"))
    market = F.log(F.col("bench_exit") / F.col("bench_entry"))
    two = F.col("beta_2").isNotNull() & F.col("g_beta").isNotNull()
    model = F.when(two, F.col("adjusted") - F.col("beta_2") * (F.col("_move") - F.col("g_beta") * market)).otherwise(F.col("adjusted"))
    return out.withColumns({"benchmark_return": F.col("bench_exit") / F.col("bench_entry") - 1, "model_adjusted": F.when(F.col("gross").isNotNull(), model)}).drop("_move")


OUTCOMES = {"asset_return": "gross", "btc_beta_adjusted_return": "adjusted", "model_factor_adjusted_return": "model_adjusted"}


def split(boundary: float, until: float | None = None) -> Column:
    """test from the boundary on, train if the exit lies before it; null for what straddles it, or ends after ``until``."""
    out = F.when(F.col("t") >= boundary, "test").when(F.col("exit_t") < boundary, "train")
    return out if until is None else F.when((F.col("t") < until) & (F.col("exit_t") < until), out)


def summary(found: DataFrame, plan: dict, cost_bps: float, keys: tuple[str, ...] = ("spec_id", "horizon"), include_holdout: bool = False) -> dict[str, DataFrame]:
    """Tables by name: parts, folds, cohorts, missing, counts. Nothing of the holdout is in them unless it is released."""
    keys = list(keys)
    parted = found.withColumn("part", events.partition(plan))
    seen = parted.where(F.col("part").isin("train", "test", *(("holdout",) if include_holdout else ())))
    development = parted.where(F.col("part").isin("train", "test"))
    shown = seen.unionByName(development.withColumn("part", F.lit("all")))
    named = lambda d, k: {label: events.metrics(d, k, cost_bps, column).withColumn("outcome", F.lit(label)) for label, column in OUTCOMES.items()}
    union = lambda tables: _union(list(tables.values()))
    folds = _union([found.withColumns({"fold": F.lit(i), "part": split(test_from, test_to)}).where(F.col("part").isNotNull() & (F.col("t") >= start)) for i, (start, test_from, test_to) in enumerate(plan["folds"])])
    test = parted.where("part = 'test'").withColumn("spread", events.buckets(F.col("features")["impact_spread_bps"], [5.0, 15.0], True))
    cohorts = F.explode(F.array(*(F.struct(F.lit(c).alias("cohort"), F.col(c).cast("string").alias("value")) for c in ("direction", "symbol", "spread"))))
    missing = seen.groupBy(*keys).agg(*(F.count_if(F.isnull(c)).alias(n) for n, c in (("asset", "gross"), ("btc_factor", "adjusted"), ("full_factor", "model_adjusted"), ("funding", "funding"))))
    counts = parted.groupBy(*keys).agg(F.count_if(F.col("part").isin("train", "test")).alias("events"), F.count_if((F.col("part") == "purged") & (F.col("t") >= plan["start"]) & (F.col("t") < plan["holdout_start"])).alias("purged"))
    return {
        "parts": union(named(shown, [*keys, "part"])),
        "folds": union(named(folds, [*keys, "fold", "part"])),
        "cohorts": events.metrics(test.withColumn("_c", cohorts).select("*", "_c.cohort", "_c.value").drop("_c"), [*keys, "cohort", "value"], cost_bps),
        "missing": missing,
        "counts": counts,
        "events": seen,
    }


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def persistence_study(rows: DataFrame, bars: DataFrame, benchmark: str, step: int, secondary: str | None, windows: tuple[int, ...] = (12, 24, 48, 72, 168), horizons: tuple[int, ...] = (24, 72, 168), momentum: int = 24) -> DataFrame:
    """symbol, t, p<window>, momentum, fwd<horizon>: sign persistence of residuals over several windows against the residual return ahead.

    rows: a scan's (symbol, t, residuals, beta, beta_2, g_beta). What lies ahead is a
    difference of prefix sums of log returns, at exact times only.
    """
    own = Window.partitionBy("symbol").orderBy("t")
    closes = bars.select("symbol", "t", F.log("c").alias("l"))
    series = lambda s, name: closes.where(F.col("symbol") == s).select("t", F.col("l").alias(name))
    sign = lambda w: F.aggregate(F.slice("residuals", F.size("residuals") - w + 1, w), F.lit(0.0), lambda a, r: a + F.signum(r)) / w
    wide = rows.where(F.size("residuals") >= max(*windows, momentum)).select("symbol", "t", "beta", "beta_2", "g_beta", *(sign(w).alias(f"p{w}") for w in windows), F.aggregate(F.slice("residuals", F.size("residuals") - momentum + 1, momentum), F.lit(0.0), lambda a, r: a + r).alias("momentum"))
    for h in horizons:
        ahead = closes.select("symbol", "t", F.when(F.lead("t", h).over(own) - F.col("t") == h * step, F.lead("l", h).over(own) - F.col("l")).alias("a"))
        moves = [series(benchmark, "l")] + ([series(secondary, "l")] if secondary else [])
        over = [m.withColumn("m", F.when(F.lead("t", h).over(Window.partitionBy(F.lit(0)).orderBy("t")) - F.col("t") == h * step, F.lead("l", h).over(Window.partitionBy(F.lit(0)).orderBy("t")) - F.col("l"))).select("t", F.col("m").alias(f"m{i}")) for i, m in enumerate(moves)]  # one symbol's series
        wide = wide.join(ahead, ["symbol", "t"], "left")
        for m in over:
            wide = wide.join(m, "t", "left")
        rest = F.col("a") - F.col("beta") * F.col("m0")
        if secondary:
            rest = rest - F.coalesce(F.col("beta_2") * (F.col("m1") - F.col("g_beta") * F.col("m0")), F.lit(0.0))
        wide = wide.withColumn(f"fwd{h}", rest).drop("a", "m0", "m1")
    return wide.drop("beta", "beta_2", "g_beta")
