"""From measures to decisions: factors of the cross-section, ranks, labels, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import DecisionConfig


def leave_one_out(bars: DataFrame, benchmark: str, step: int, least: int) -> DataFrame:
    """symbol, t, r, others, s, least_others: the mean return of all other symbols at each time, and its index level.

    One window by time gives totals; a symbol's own return is taken out, so nothing is
    joined to itself. A time with fewer than ``least`` others ends a segment; levels and
    least_others are those of the unbroken segment since.
    """
    own = Window.partitionBy("symbol").orderBy("t")
    some = bars.where(F.col("symbol") != benchmark)
    r = some.withColumn("r", F.when(F.col("t") - F.lag("t").over(own) == step, F.log(F.col("c") / F.lag("c").over(own))))
    now = Window.partitionBy("t")
    out = r.withColumn("others", (F.count("r").over(now) - F.when(F.col("r").isNotNull(), 1).otherwise(0)).cast("long"))
    mean = F.try_divide(F.sum("r").over(now) - F.coalesce("r", F.lit(0.0)), F.col("others"))
    out = out.withColumn("f", F.when(F.col("others") >= least, mean))
    out = out.withColumn("segment", F.sum(F.when(F.col("f").isNull() | (F.col("t") - F.lag("t").over(own) != step), 1).otherwise(0)).over(own))
    within = Window.partitionBy("symbol", "segment").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    level = 100 * F.exp(F.sum(F.coalesce("f", F.lit(0.0))).over(within))
    return out.withColumns({"s": level, "least_others": F.min(F.when(F.col("f").isNotNull(), F.col("others"))).over(within)}).select("symbol", "t", "r", "others", "f", "s", "least_others")


def strength_ranks(rows: DataFrame, score: str = "score") -> DataFrame:
    """Adds strong_rank, and weak_rank in exactly the reverse order."""
    now = Window.partitionBy("t")
    usable = F.when(F.col(score).isNotNull(), True)
    strong = F.row_number().over(Window.partitionBy("t", usable).orderBy(F.desc(score), "symbol"))
    weak = F.row_number().over(Window.partitionBy("t", usable).orderBy(F.asc(score), F.desc("symbol")))
    return rows.withColumns({"strong_rank": F.when(usable, strong), "weak_rank": F.when(usable, weak), "panel": F.count("*").over(now)})


def average_rank_percentile(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Ties share their mean rank; zero to one; null where fewer than two values."""
    n = F.count(value).over(Window.partitionBy("t"))
    below = F.rank().over(Window.partitionBy("t", F.col(value).isNull()).orderBy(value)) - 1
    ties = F.count("*").over(Window.partitionBy("t", value))
    return rows.withColumn(out, F.when(F.col(value).isNotNull() & (n >= 2), (below + (ties - 1) / 2) / (n - 1)))


def breadth(rows: DataFrame, score: str = "score", config: DecisionConfig = DecisionConfig()) -> DataFrame:
    usable = F.col(score).isNotNull()
    share = lambda c: F.avg(F.when(usable, c.cast("double")))
    return rows.groupBy("t").agg(F.count("*").alias("panel"), F.count(score).alias("usable"), share(F.col(score) > 0).alias("positive"), share(F.abs(score) >= config.candidate).alias("strong"), F.median(score).alias("median_score"))


def select_universe(rows: DataFrame, size: int, required: tuple[str, ...], by: str = "notional") -> DataFrame:
    """At each t the required symbols and the largest others, ``size`` in all; the whole panel if it is no larger."""
    if size < len(set(required)):
        raise ValueError("the universe is smaller than the required symbols")
    first = F.when(F.col("symbol").isin(list(required)), 0).otherwise(1) if required else F.lit(1)
    rank = F.row_number().over(Window.partitionBy("t").orderBy(first, F.desc(F.coalesce(by, F.lit(0.0))), "symbol"))
    return rows.withColumn("place", rank).where(F.col("place") <= size).drop("place")


def side(price: Column) -> Column:
    up = (price > F.col("top")) & (price > F.col("pivot"))
    down = (price < F.col("bottom")) & (price < F.col("pivot"))
    return F.when(up, "LONG").when(down, "SHORT").otherwise("NONE")


def assess(rows: DataFrame, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Adds label, direction, strength, confirmation, tier, reasons, blockers.

    Needs score, discovery, persistence, levels (top, bottom, pivot, r1, s1), price,
    prior_price, closed_price, closed_prior; market_usable and rs_usable.
    """
    score, per = F.col("score"), F.col("persistence")
    found = F.coalesce(F.col("discovery"), score)
    live, closed = side(F.col("price")), F.when(F.col("closed_price").isNotNull(), side(F.col("closed_price"))).otherwise("NONE")
    long_, short = (score >= config.candidate) & (per >= config.persistence), (score <= -config.candidate) & (per <= -config.persistence)
    up = lambda now, before: F.coalesce((F.col(before) <= F.col("r1")) & (F.col(now) > F.col("r1")), F.lit(False))
    down = lambda now, before: F.coalesce((F.col(before) >= F.col("s1")) & (F.col(now) < F.col("s1")), F.lit(False))
    size, found_size = F.least(F.lit(100.0), F.abs(score) * 10), F.least(F.lit(100.0), F.abs(found) * 10)
    more = lambda crossed: F.when(crossed, F.least(F.lit(100.0), size + 10)).otherwise(size)
    way = F.when(found > 0, "LONG").otherwise("SHORT")

    def made(label, direction, strength, confirmation, tier, reasons=(), blockers=()):
        texts = lambda xs: F.array_compact(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs))).cast("array<string>") if xs else F.array().cast("array<string>")
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(text(label).alias("label"), text(direction).alias("direction"), (strength if isinstance(strength, Column) else F.lit(strength)).cast("double").alias("strength"), text(confirmation).cast("string").alias("confirmation"), text(tier).cast("string").alias("tier"), texts(reasons).alias("reasons"), texts(blockers).alias("blockers"))

    empty = F.array().cast("array<string>")
    lists = {n: F.coalesce(F.col(n), empty) if n in rows.columns else empty for n in ("daily_flags", "flags")}
    why = F.array_compact(F.array(F.col("reason"))) if "reason" in rows.columns else empty
    grade = "CANDIDATE_GRADE"
    unknown = [made("INSUFFICIENT_DATA", "NONE", 0.0, None, None).withField("blockers", b) for b in (lists["daily_flags"], F.concat(lists["flags"], why))]
    threshold = f"confirmed candidate score has not cleared {config.candidate:g}"
    if_ = lambda c, t: F.when(c, F.lit(t))
    choice = (
        F.when(~F.col("market_usable"), unknown[0])
        .when(~F.col("rs_usable") | score.isNull() | per.isNull(), unknown[1])
        .when(long_ & (closed == "LONG"), made("LONG_CANDIDATE", "LONG", more(up("closed_price", "closed_prior")), "CONFIRMED", grade, ("persistent beta-adjusted strength", "completed bar closed above TC", "completed bar closed above daily pivot", if_(up("closed_price", "closed_prior"), "fresh completed close above R1")), (if_(live != "LONG", "current mid has moved back inside confirmed bullish structure"),)))
        .when(short & (closed == "SHORT"), made("SHORT_CANDIDATE", "SHORT", more(down("closed_price", "closed_prior")), "CONFIRMED", grade, ("persistent beta-adjusted weakness", "completed bar closed below BC", "completed bar closed below daily pivot", if_(down("closed_price", "closed_prior"), "fresh completed close below S1")), (if_(live != "SHORT", "current mid has moved back inside confirmed bearish structure"),)))
        .when(long_ & (live == "LONG"), made("LONG_CANDIDATE", "LONG", size, "PROVISIONAL", grade, ("persistent beta-adjusted strength", "current mid above TC and pivot", if_(up("price", "prior_price"), "fresh R1 mid-price cross")), ("awaiting completed-bar confirmation",)))
        .when(short & (live == "SHORT"), made("SHORT_CANDIDATE", "SHORT", size, "PROVISIONAL", grade, ("persistent beta-adjusted weakness", "current mid below BC and pivot", if_(down("price", "prior_price"), "fresh S1 mid-price cross")), ("awaiting completed-bar confirmation",)))
        .when(score >= config.candidate, made("WATCH", "LONG", size, None, grade, ("strong RS",), (if_(per < config.persistence, "persistence has not cleared the long threshold"), if_((live != "LONG") & (closed != "LONG"), "neither current mid nor completed close has bullish structure"))))
        .when(score <= -config.candidate, made("WATCH", "SHORT", size, None, grade, ("weak RS",), (if_(per > -config.persistence, "persistence has not cleared the short threshold"), if_((live != "SHORT") & (closed != "SHORT"), "neither current mid nor completed close has bearish structure"))))
        .when(F.abs(found) >= config.strong, made("WATCH", way, found_size, None, "STRONG_DISCOVERY", ("strong persistence-free RS discovery",), (threshold,)))
        .when(F.abs(found) >= config.early, made("WATCH", way, found_size, None, "EARLY_DISCOVERY", ("early persistence-free RS discovery",), (threshold,)))
        .otherwise(made("NEUTRAL", "NONE", found_size, None, None, (), ("discovery score is below the early threshold",)))
    )
    return rows.withColumn("setup", choice).select("*", "setup.*").drop("setup")


RULES = ("confirmed_candidate", "early_discovery", "strong_discovery", "h5_discovery_structure", "residual_momentum_baseline")


def triggers(rows: DataFrame, rules: tuple[str, ...] = RULES, config: DecisionConfig = DecisionConfig(), needs_secondary: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(rule, symbol, t, eligible, state, direction, trigger_score): a row for each rule and row; state null where the rule is silent.

    Only eligible rows have a state. ``needs_secondary``: rows without a secondary beta
    aren't eligible. ``carry``: further columns to keep; momentum is the rank among usable rows.
    """
    unknown = set(rules) - set(RULES)
    if unknown or not rules:
        raise ValueError(f"unknown or no rules: {sorted(unknown)}")
    ranked = average_rank_percentile(rows.withColumn("_sum", F.when(F.col("rs_usable"), F.col("sum_medium"))), "_sum", "momentum")
    found, closed = F.col("discovery"), side(F.col("closed_price"))
    way = F.when(found > 0, "LONG").otherwise("SHORT")
    base = F.col("rs_usable") & F.col("closed_price").isNotNull()
    if needs_secondary:
        base = base & F.col("beta_2").isNotNull()
    hit = {
        "confirmed_candidate": (base & F.col("market_usable"), F.when(F.col("label").endswith("CANDIDATE") & (F.col("confirmation") == "CONFIRMED"), F.col("label")), F.col("direction"), F.col("score")),
        "early_discovery": (base, F.when(F.abs(found) >= config.early, "early_discovery"), way, found),
        "strong_discovery": (base, F.when(F.abs(found) >= config.strong, "strong_discovery"), way, found),
        "h5_discovery_structure": (base & F.col("market_usable"), F.when((F.abs(found) >= config.strong) & (closed == way), "h5_discovery_structure"), way, found),
        "residual_momentum_baseline": (base, F.when(((F.col("momentum") >= 0.8) & (F.col("sum_medium") > 0)) | ((F.col("momentum") <= 0.2) & (F.col("sum_medium") < 0)), "residual_momentum_baseline"), F.when(F.col("sum_medium") > 0, "LONG").otherwise("SHORT"), F.col("z_medium")),
    }

    def said(rule: str) -> Column:
        eligible, state, direction, score = hit[rule]
        active = eligible & state.isNotNull() & score.isNotNull()
        return F.struct(F.lit(rule).alias("rule"), eligible.alias("eligible"), *(F.when(active, x).alias(n) for n, x in (("state", state), ("direction", direction), ("trigger_score", score))))

    each = F.explode(F.array(*(said(r) for r in dict.fromkeys(rules))))
    return ranked.select("symbol", "t", *carry, each.alias("x")).select("x.rule", "symbol", "t", "x.eligible", "x.state", "x.direction", "x.trigger_score", *carry)


def transitions(states: DataFrame, keys: tuple[str, ...] = ("rule", "symbol")) -> DataFrame:
    """Adds kind to the rows where the state changes: activated, changed or cleared. Rows that aren't eligible keep the state before."""
    own = Window.partitionBy(*keys).orderBy("t")
    now = F.when(F.col("state").isNotNull(), F.concat_ws("|", "state", "direction"))
    seen = states.where("eligible").withColumn("_now", now).withColumn("_before", F.lag("_now").over(own))
    kind = F.when(F.col("_now").eqNullSafe(F.col("_before")), None).when(F.col("_before").isNull(), "activated").when(F.col("_now").isNull(), "cleared").otherwise("changed")
    return seen.withColumn("kind", kind).where("kind is not null").drop("_now", "_before")
