"""What surrounds a panel: market contexts, universes, admission, session opens, and the panel itself.

Contexts are research inputs; none of them enters a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import finite
from lodestar.sources.bars import DAY

#: Completed days whose median is the base of a day's notional, and daily bars that a symbol needs.
BASE_DAYS = 20
LEAST_DAILY = 2


def optional_number(x: Column) -> Column:
    """The number that a text says; null for anything else, and for what isn't finite."""
    parsed = x.try_cast("double")
    return F.when(finite(parsed), parsed)


def typical_notional(daily: DataFrame) -> DataFrame:
    """symbol, base: the median of volume times typical price over the last completed days that traded."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("t")))
    last = daily.withColumn("_n", newest).where((F.col("_n") <= BASE_DAYS) & (F.col("v") > 0))
    return last.groupBy("symbol").agg(F.median(F.col("v") * (F.col("h") + F.col("l") + F.col("c")) / 3).alias("base"))


def spread_bps(bid: Column, ask: Column, mid: Column) -> Column:
    """Ask less bid over the mid price, or over their mean where there is no positive mid."""
    middle = F.when(mid > 0, mid).otherwise((bid + ask) / 2)
    return F.when(finite(bid) & finite(ask) & (middle > 0) & (ask >= bid), (ask - bid) / middle * 10_000)


def market_context(raw: DataFrame, daily: DataFrame) -> DataFrame:
    """Normalised contexts of raw ones (symbol, dayNtlVlm, midPx, markPx, funding, openInterest, premium: text; impactPxs: array of text)."""
    named = {"day_notional": "dayNtlVlm", "mid": "midPx", "mark": "markPx", "funding_rate": "funding", "open_interest": "openInterest", "premium": "premium"}
    own = raw.select("symbol", *(optional_number(F.col(k)).alias(n) for n, k in named.items()), F.when(F.size("impactPxs") == 2, F.col("impactPxs")).alias("impact"))
    bid, ask = (F.get("impact", F.lit(i)).try_cast("double") for i in (0, 1))
    joined = own.join(typical_notional(daily), "symbol", "left")
    return joined.withColumns({"impact_spread_bps": spread_bps(bid, ask, F.col("mid")), "relative_notional": F.when(F.col("base") > 0, F.col("day_notional") / F.col("base"))}).drop("impact", "base")


def paired(meta: DataFrame, contexts: DataFrame) -> DataFrame:
    """Rows of two lists paired by place: meta (entries: array of structs) and contexts (contexts: array of structs), a row each.

    The place is the only key there is, so lists of different lengths are an error.
    """
    met = meta.select("entries").join(F.broadcast(contexts.select("contexts")))  # one row each
    same = F.when(F.size("entries") == F.size("contexts"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("universe and contexts differ in length: "), F.size("entries"), F.lit(" and "), F.size("contexts"))))
    zipped = met.where(same).select(F.explode(F.arrays_zip("entries", "contexts")).alias("x"))
    return zipped.select("x.entries.*", "x.contexts.*")


class UniverseError(ValueError):
    """The metadata doesn't allow a choice of markets."""


def live_universe(markets: DataFrame, size: int, required: tuple[str, ...]) -> DataFrame:
    """name, notional, place: the largest tradable markets by a day's notional, with the required ones in place of the last.

    markets: name, isDelisted, dayNtlVlm (text). What can't be read is an error, never left out.
    """
    required = tuple(dict.fromkeys(required))
    if size < max(1, len(required)):
        raise UniverseError(f"{size} markets can't hold {', '.join(required)}")
    notional = optional_number(F.col("dayNtlVlm"))
    open_ = markets.where(~F.coalesce("isDelisted", F.lit(False))).withColumn("notional", notional)
    facts = open_.agg(F.count_if(F.isnull("name")).alias("nameless"), F.count_if(F.isnull("notional") | (F.col("notional") < 0)).alias("unread"), F.collect_set(F.when(F.col("name").isin(list(required)), F.col("name"))).alias("found")).first()
    if facts["nameless"] or facts["unread"]:
        raise UniverseError(f"{facts['nameless']} markets without a name, {facts['unread']} without a sound notional")
    if missing := [r for r in required if r not in facts["found"]]:
        raise UniverseError(f"not tradable: {', '.join(missing)}")
    # The required ones first, then the largest: the same set as replacing the last ones.
    kept = open_.withColumn("_must", F.col("name").isin(list(required)) if required else F.lit(False)).orderBy(F.desc("_must"), F.desc("notional"), "name").limit(size)
    return kept.select("name", "notional").withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("notional"), "name")))  # ``size`` rows


def session_open(daily: DataFrame, as_of) -> DataFrame:
    """symbol, session_open: the open of the day that is still forming; the one thing read from an unfinished bar."""
    forming = daily.where((F.col("t") <= as_of) & (F.col("t") + DAY > as_of))
    return forming.groupBy("symbol").agg(F.max_by("o", "t").alias("session_open"))


def admission(candidates: DataFrame, daily: DataFrame, as_of: int, benchmark: str | None = None) -> DataFrame:
    """symbol, completed, admitted, reason: candidates with two completed daily bars or more are scanned. Without the benchmark there is no panel."""
    done = daily.where(F.col("t") + DAY <= as_of).groupBy("symbol").agg(F.count("*").alias("completed"))
    out = candidates.select("symbol").distinct().join(done, "symbol", "left").withColumn("completed", F.coalesce("completed", F.lit(0)))
    out = out.withColumn("admitted", F.col("completed") >= LEAST_DAILY).withColumn("reason", F.when(~F.col("admitted"), F.lit(f"fewer than {LEAST_DAILY} completed daily bars")))
    if benchmark is not None and not out.where((F.col("symbol") == benchmark) & F.col("admitted")).limit(1).count():
        raise UniverseError(f"the benchmark {benchmark} has no usable bars")
    return out


def panel(symbols: DataFrame, mids: DataFrame, prior: DataFrame, daily: DataFrame, contexts: DataFrame, as_of: int, benchmark: str) -> DataFrame:
    """symbol, price, prior_price, session_open and the context of each symbol with a mid price; the benchmark's has to be there."""
    priced = symbols.select("symbol").join(mids.select("symbol", F.col("mid").alias("price")), "symbol")
    if not priced.where(F.col("symbol") == benchmark).limit(1).count():
        raise UniverseError(f"no mid price for the benchmark {benchmark}")
    out = priced.join(prior.select("symbol", "prior_price"), "symbol", "left").join(session_open(daily, as_of), "symbol", "left")
    return out.join(contexts, "symbol", "left")


def guarded(rows: DataFrame, contexts: DataFrame, keys: tuple[str, ...] = ("symbol", "t")) -> DataFrame:
    """The rows with their context (keys, observed_at, ...) by exact key. A context observed after t, or at no known time, is an error."""
    met = rows.join(contexts.withColumn("_known", F.lit(True)), list(keys), "left")
    in_time = F.coalesce(F.col("observed_at") <= F.col("t"), F.lit(False))
    sound = F.when(F.col("_known").isNull() | in_time, F.lit(True)).otherwise(F.raise_error(F.lit("a context was observed after the event that it is used for")))
    return met.where(sound).drop("_known")


def day_blocks(bars: DataFrame, step: int) -> DataFrame:
    """symbol, t, day_notional, relative_notional at every bar: the last day's bars against the median of up to 20 whole blocks before.

    Blocks are counted back from each bar: a prefix sum gives any block as a difference,
    so a bar carries 21 numbers and not 21 days of bars.
    """
    per_day = max(1, -(-DAY // step))
    own = Window.partitionBy("symbol").orderBy("t")
    summed = bars.withColumns({"k": F.row_number().over(own), "total": F.sum(F.col("c") * F.col("v")).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    at = [F.coalesce(F.lag("total", per_day * i).over(own), F.lit(0.0)) for i in range(1, BASE_DAYS + 2)]
    held = summed.withColumn("ends", F.array(F.col("total"), *at))
    whole = F.least(F.lit(BASE_DAYS), F.greatest(F.lit(0), F.floor(F.col("k") / per_day) - 1)).cast("int")
    blocks = F.transform(F.slice("ends", 2, whole), lambda x, i: x - F.get("ends", i + 2))
    ordered = F.array_sort(blocks)
    base = (F.get(ordered, F.floor((whole - 1) / 2).cast("int")) + F.get(ordered, F.floor(whole / 2).cast("int"))) / 2
    out = held.withColumns({"day_notional": F.get("ends", F.lit(0)) - F.get("ends", F.lit(1)), "_base": F.when(whole > 0, base)})
    return out.select("symbol", "t", "day_notional", F.when(F.col("_base") > 0, F.col("day_notional") / F.col("_base")).alias("relative_notional"))
