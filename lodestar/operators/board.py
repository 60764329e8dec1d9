"""What a board shows of a scan: order, filters, counts, distances, and which gate holds a row back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.config import DecisionConfig

#: Null sorts below any value of its column by these.
SENTINELS = {"score": -99.0, "discovery": -99.0, "persistence": -9.0, "structure": -9.0, "width_percentile": -1.0}
LABELS = ("LONG_CANDIDATE", "SHORT_CANDIDATE", "WATCH", "NEUTRAL", "INSUFFICIENT_DATA")
FILTERS = ("ALL", "FLAGGED", "CONFIRMED", "PROVISIONAL", "LONG_WATCH", "SHORT_WATCH", "EARLY_DISCOVERY", "STRONG_DISCOVERY", "CANDIDATE_GRADE", *LABELS)


def ordered(rows: DataFrame) -> DataFrame:
    """Ranked rows first, the strongest before the weaker; what has no score comes last."""
    return rows.orderBy(F.isnull("strong_rank"), F.desc_nulls_last("score"), "symbol")


def sorted_by(rows: DataFrame, column: str, descending: bool = True) -> DataFrame:
    key = F.coalesce(F.col(column), F.lit(SENTINELS[column])) if column in SENTINELS else F.col(column)
    return rows.orderBy(key.desc() if descending else key.asc(), "symbol")


def matches(name: str) -> Column:
    """Whether a row passes a filter."""
    whole = {
        "ALL": F.lit(True), "FLAGGED": F.size("flags") > 0, "CONFIRMED": F.col("confirmation") == "CONFIRMED", "PROVISIONAL": F.col("confirmation") == "PROVISIONAL",
        "LONG_WATCH": (F.col("label") == "WATCH") & (F.col("direction") == "LONG"), "SHORT_WATCH": (F.col("label") == "WATCH") & (F.col("direction") == "SHORT"),
    }
    tiers = ("EARLY_DISCOVERY", "STRONG_DISCOVERY", "CANDIDATE_GRADE")
    return F.coalesce(whole[name] if name in whole else F.col("tier") == name if name in tiers else F.col("label") == name, F.lit(False))


def visible(rows: DataFrame, name: str = "ALL", search: str = "") -> DataFrame:
    wanted = search.strip().lower()
    return rows.where(matches(name) & F.lower("symbol").contains(wanted))


def filter_counts(rows: DataFrame, keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """keys, filter, n: every filter's rows, from one pass."""
    each = F.explode(F.filter(F.array(*(F.when(matches(f), F.lit(f)) for f in FILTERS)), lambda x: x.isNotNull())).alias("filter")
    return rows.select(*keys, each).groupBy(*keys, "filter").agg(F.count("*").alias("n"))


def missing_reasons(excluded: DataFrame) -> DataFrame:
    """reason, symbols: who is held out of the cross-section, by why."""
    return excluded.where("reason is not null").groupBy("reason").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))


def band_distance(price: Column, flags: Column = None) -> Column:
    """Signed distance of a price from the band in ATR; zero inside, null without an ATR or with flags."""
    top, bottom = (price - F.col("top")) / F.col("atr"), (price - F.col("bottom")) / F.col("atr")
    usable = (F.col("atr") > 0) & ((F.size(flags) == 0) if flags is not None else F.lit(True))
    return F.when(usable, F.when(top > 0, top).when(bottom < 0, bottom).when(top.isNotNull() & bottom.isNotNull(), F.lit(0.0)))


def gate_verdict(rows: DataFrame, config: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Adds strength_ok, persistence_ok, structure_ok: which gates a row clears in its own direction; null without a score or persistence."""
    way = F.when(F.col("direction") == "LONG", 1).when(F.col("direction") == "SHORT", -1).when(F.col("score") >= 0, 1).otherwise(-1)
    price = F.when(F.col("confirmation") == "CONFIRMED", F.col("closed_price")).otherwise(F.col("price"))
    side = F.when((price > F.col("top")) & (price > F.col("pivot")), 1).when((price < F.col("bottom")) & (price < F.col("pivot")), -1).otherwise(0)
    known = F.col("score").isNotNull() & F.col("persistence").isNotNull()
    checks = {"strength_ok": F.abs("score") >= config.candidate, "persistence_ok": (F.signum("persistence") == way) & (F.abs("persistence") >= config.persistence), "structure_ok": F.coalesce(side == way, F.lit(False))}
    return rows.withColumns({n: F.when(known, c) for n, c in checks.items()})


def funnel(rows: DataFrame, config: DecisionConfig = DecisionConfig(), keys: tuple[str, ...] = ("t",)) -> DataFrame:
    """keys, scored, strength, persistence, structure, binding: how many clear each gate, and the first of the tightest."""
    outside = F.coalesce((F.col("price") > F.col("top")) | (F.col("price") < F.col("bottom")), F.lit(False)) & F.col("market_usable")
    gates = {"strength": F.abs("score") >= config.candidate, "persistence": F.abs("persistence") >= config.persistence, "structure": outside}
    counts = rows.where("rs_usable").groupBy(*keys).agg(F.count("*").alias("scored"), *(F.count_if(c).alias(n) for n, c in gates.items()))
    least = F.least(*gates)
    return counts.withColumn("binding", F.when(F.col("strength") == least, "strength").when(F.col("persistence") == least, "persistence").otherwise("structure"))


ALERTS = ("LONG_CANDIDATE", "SHORT_CANDIDATE")


def alert_state() -> Column:
    """What enters the stream of signals: confirmed candidates only; null for any other row, a mid-price preview included."""
    state = F.struct("label", "direction", "confirmation", "strength", "score", "reasons", "cpr_position", "pivot_position")
    return F.when(F.col("label").isin(*ALERTS) & (F.col("confirmation") == "CONFIRMED"), state)


def snapshot_transitions(before: DataFrame, after: DataFrame) -> DataFrame:
    """symbol, kind, now, then: how the alert states of two scans differ; symbols of either count, and a new score alone is no change."""
    old, new = (d.select("symbol", alert_state().alias(n)) for d, n in ((before, "then"), (after, "now")))
    met = old.join(new, "symbol", "full_outer")
    same = (F.col("now.label") == F.col("then.label")) & (F.col("now.direction") == F.col("then.direction"))
    kind = F.when(F.isnull("then") & F.isnotnull("now"), "activated").when(F.isnotnull("then") & F.isnull("now"), "cleared").when(F.isnotnull("now") & ~same, "changed")
    return met.withColumn("kind", kind).where("kind is not null").select("symbol", "kind", "now", "then")
