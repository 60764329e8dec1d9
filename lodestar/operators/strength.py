"""Relative strength at every bar: alignment, look-backs, factor models, scores, and the gates in front of them.

All points in time come from one plan, so a scan and a backtest are the same: a
symbol's bars are cut into blocks of time with the look-back before each, and a block
is scored as a whole (``scoring``). A block has a bounded number of bars, however long
a history is, and a bar lies in two blocks at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import StrengthConfig
from lodestar.functions.scalars import median, population_deviation
from lodestar.operators import scoring
from lodestar.operators.scoring import TINY

#: Look-backs to a block of time: the bars of one before it are read twice.
BLOCK = 8
STALE = "stale_or_misaligned"


def aligned(bars: DataFrame, benchmark: str, secondary: str | None = None) -> DataFrame:
    """symbol, t, c, b (the benchmark's close), s (the secondary's, null where missing) at common times.

    The benchmark is one symbol out of all, so its side is small; Spark broadcasts it by its measured size.
    """
    one = lambda symbol, name: bars.where(F.col("symbol") == symbol).select("t", F.col("c").alias(name))
    out = bars.where(F.col("symbol") != benchmark).select("symbol", "t", "c").join(one(benchmark, "b"), "t")
    out = out.join(one(secondary, "s"), "t", "left") if secondary else out.withColumn("s", F.lit(None).cast("double"))
    return out.withColumn("s", F.when(F.col("symbol") != F.lit(secondary or ""), F.col("s"))).select("symbol", "t", "c", "b", "s")


def runs(rows: DataFrame, step: int) -> DataFrame:
    """Adds run (number of the unbroken run) and log returns rc, rb, rs, which never bridge a gap."""
    own = Window.partitionBy("symbol").orderBy("t")
    joined = (F.col("t") - F.lag("t").over(own)) == step
    change = lambda c: F.when(joined, F.log(F.col(c) / F.lag(c).over(own)))
    marked = rows.withColumn("new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumns({"rc": change("c"), "rb": change("b"), "rs": change("s")})
    return marked.withColumn("run", F.sum("new").over(own)).drop("new")


def look_back(rows: DataFrame, config: StrengthConfig) -> DataFrame:
    """symbol, t, n, ra, rb, rs: the last returns at each bar that has enough of them; rs null unless complete."""
    back = Window.partitionBy("symbol", "run").orderBy("t").rowsBetween(-(config.preferred_returns - 1), 0)
    some = rows.where("rc is not null")
    held = some.withColumn("xs", F.collect_list(F.struct("rc", "rb", "rs")).over(back)).where(F.size("xs") >= config.required_returns)
    pick = lambda c: F.transform("xs", lambda x: x[c])
    return held.select("symbol", "t", F.size("xs").alias("n"), pick("rc").alias("ra"), pick("rb").alias("rb"), F.when(~F.exists("xs", lambda x: x["rs"].isNull()), pick("rs")).alias("rs"))


def robust_scale(df: DataFrame, xs: str, location: str, scale: str) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation; the plain deviation where that vanishes."""
    df = df.withColumn(location, median(F.col(xs)))
    df = df.withColumn("_mad", 1.4826 * median(F.transform(xs, lambda x: F.abs(x - F.col(location)))))
    return df.withColumn(scale, F.when((F.col("_mad") <= TINY) & (F.size(xs) >= 2), population_deviation(F.col(xs))).otherwise(F.col("_mad"))).drop("_mad")


def winsorized(df: DataFrame, xs: str, out: str, limit: float) -> DataFrame:
    df = robust_scale(df, xs, "_m", "_s")
    cut = F.transform(xs, lambda x: F.greatest(F.col("_m") - limit * F.col("_s"), F.least(x, F.col("_m") + limit * F.col("_s"))))
    return df.withColumn(out, F.when(F.col("_s") <= TINY, F.col(xs)).otherwise(cut)).drop("_m", "_s")


# --- alignment -------------------------------------------------------------------------------


def _before(times: DataFrame, series: DataFrame) -> DataFrame:
    """(symbol, x) -> also n: how many times t of one series lie before x. Sorted together; no range join."""
    both = times.select("symbol", F.col("x").alias("at"), F.lit(0).alias("kind")).unionByName(series.select(F.lit(None).cast("string").alias("symbol"), F.col("t").alias("at"), F.lit(1).alias("kind")))
    # One series and a few times a symbol; ties: the asked time comes first, so what lies at it isn't before it.
    counted = both.withColumn("n", F.sum("kind").over(Window.partitionBy(F.lit(0)).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    return counted.where("kind = 0").select("symbol", F.col("at").alias("x"), "n").distinct()


def alignment_ratio(bars: DataFrame, benchmark: str, step: int) -> DataFrame:
    """symbol, common, expected, ratio over the stretch that both series span."""
    b = bars.where(F.col("symbol") == benchmark).select("t")
    ends = b.agg(F.min("t").alias("b0"), F.max("t").alias("b1"))
    own = bars.where(F.col("symbol") != benchmark).groupBy("symbol").agg(F.min("t").alias("a0"), F.max("t").alias("a1"))
    span = own.join(F.broadcast(ends)).select("symbol", F.greatest("a0", "b0").alias("first"), F.least("a1", "b1").alias("last"))  # one row
    inside = bars.join(span, "symbol").where(F.col("t").between(F.col("first"), F.col("last")))
    counted = inside.join(b.withColumn("hit", F.lit(1)), "t", "left").groupBy("symbol", "first", "last").agg(F.count("*").alias("n"), F.count("hit").alias("common"))
    until = _before(span.select("symbol", (F.col("last") + 1).alias("x")), b).select("symbol", F.col("n").alias("until"))
    since = _before(span.select("symbol", F.col("first").alias("x")), b).select("symbol", F.col("n").alias("since"))
    n_b = until.join(since, "symbol").select("symbol", (F.col("until") - F.col("since")).alias("n_b"))
    expected = F.floor((F.col("last") - F.col("first")) / step) + 1
    return counted.join(n_b, "symbol").select("symbol", "common", expected.alias("expected"), (F.col("common") / F.greatest(F.lit(1), expected, "n", "n_b")).alias("ratio"))


def alignment_at(bars: DataFrame, benchmark: str, step: int) -> DataFrame:
    """symbol, t, ratio: at every common bar the share of common bars so far, of all that either series has or the grid expects."""
    own = Window.partitionBy("symbol").orderBy("t")
    b = bars.where(F.col("symbol") == benchmark).withColumn("ib", F.row_number().over(own)).select("t", "ib")
    b0 = bars.where(F.col("symbol") == benchmark).agg(F.min("t").alias("b0"))
    some = bars.where(F.col("symbol") != benchmark).select("symbol", "t").join(F.broadcast(b0))  # one row
    counted = some.withColumns({"n_a": F.sum(F.when(F.col("t") >= F.col("b0"), 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)), "a0": F.min("t").over(Window.partitionBy("symbol"))})
    earlier = _before(counted.groupBy("symbol").agg(F.min("a0").alias("x")), b).select("symbol", F.col("n").alias("earlier"))
    met = counted.join(b, "t").join(earlier, "symbol").withColumns({"common": F.row_number().over(own), "first": F.greatest("a0", "b0")})
    expected = F.floor((F.col("t") - F.col("first")) / step) + 1
    return met.select("symbol", "t", (F.col("common") / F.greatest(F.lit(1), expected, "n_a", F.col("ib") - F.col("earlier"))).alias("ratio"))


# --- scores ----------------------------------------------------------------------------------

_SCORED = "symbol string, t long, bars int, residuals array<double>, " + ", ".join(f"{n} double" for n in scoring.FIGURES)


def _blocks(rows: DataFrame, step: int, config: StrengthConfig) -> DataFrame:
    """The rows with block: that of their own time, and the next one where they belong to its look-back."""
    back = config.preferred_returns * step
    width = BLOCK * back
    here = F.floor(F.col("t") / width).cast("long")
    return rows.withColumn("block", F.explode(F.sequence(here, F.floor((F.col("t") + back) / width).cast("long"))))


def evaluated(bars: DataFrame, benchmark: str, step: int, config: StrengthConfig, secondary: str | None = None, factor: DataFrame | None = None, since: int | None = None) -> DataFrame:
    """A row for each symbol and common bar t: bars (of its unbroken run, as many as are used), and all figures where they suffice.

    ``since``: only bars from there on (a live scan asks for the last one). The secondary factor is another symbol's series, or ``factor`` (symbol, t, s) with a series for each symbol.
    """
    rows = aligned(bars, benchmark, secondary)
    if factor is not None:
        rows = rows.drop("s").join(factor.select("symbol", "t", "s"), ["symbol", "t"], "left").select("symbol", "t", "c", "b", "s")
    width = BLOCK * config.preferred_returns * step

    def score(key, table):
        block = key[1].as_py()
        table = table.sort_by("t")
        t, run = table.column("t").to_numpy(), table.column("run").to_numpy()
        ra, rb, rs = (table.column(c).to_numpy().astype(float) for c in ("rc", "rb", "rs"))  # null becomes NaN
        mine = (t // width == block) & (t >= (t.min(initial=0) if since is None else since))
        size, residuals = np.ones(len(t), np.int32), [None] * len(t)
        figures = {n: np.full(len(t), np.nan) for n in scoring.FIGURES}
        for at in np.split(np.arange(len(t)), np.nonzero(np.diff(run))[0] + 1) if len(t) else []:
            held = at[~np.isnan(ra[at])]  # returns: all but a run's first bar
            size[held] = np.minimum(np.arange(len(held)) + 1, config.preferred_returns) + 1
            wanted = np.nonzero(mine[held])[0]
            found, rest = scoring.run_scored(ra[held], rb[held], rs[held], wanted, config)
            for n in scoring.FIGURES:
                figures[n][held[wanted]] = found[n]
            for i, r in zip(held[wanted].tolist(), rest):
                residuals[i] = r
        some = np.nonzero(mine)[0]
        columns = [pa.array([key[0].as_py()] * len(some), pa.string()), pa.array(t[some]), pa.array(size[some]), pa.array([residuals[i] for i in some.tolist()], pa.list_(pa.float64()))]
        columns += [pa.array(figures[n][some], pa.float64(), from_pandas=True) for n in scoring.FIGURES]
        return pa.table(columns, names=["symbol", "t", "bars", "residuals", *scoring.FIGURES])

    cut = _blocks(runs(rows, step), step, config).select("symbol", "block", "t", "run", "rc", "rb", "rs")
    out = cut.groupBy("symbol", "block").applyInArrow(score, _SCORED)
    two = secondary is not None or factor is not None
    high = lambda b, e: F.coalesce(F.col(e) > F.greatest(F.lit(0.25), F.abs(b) * 0.5), F.lit(False))
    fitted = F.col("beta").isNotNull()
    unavailable = F.col("beta_2").isNull() & (F.col("symbol") != F.lit(secondary or "")) if two else F.lit(False)
    flags = {"secondary_factor_unavailable": (F.col("bars") > config.required_returns) & unavailable, "low_beta_fit": fitted & (F.col("r_squared") < 0.05), "high_beta_uncertainty": fitted & (high("beta", "beta_error") | high("beta_2", "beta_2_error")), "near_zero_residual_volatility": fitted & (F.col("residual_volatility") <= TINY)}
    return out.withColumn("flags", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items()))))


def relative_strength(bars: DataFrame, benchmark: str, step: int, config: StrengthConfig, secondary: str | None = None, factor: DataFrame | None = None) -> DataFrame:
    """The rows of ``evaluated`` that have a model."""
    return evaluated(bars, benchmark, step, config, secondary, factor).where("beta is not null")


def gated(rows: DataFrame, alignment: DataFrame, step: int, config: StrengthConfig, as_of: Column | None = None) -> DataFrame:
    """Adds ratio, reason and rs_usable to rows of ``evaluated``, and puts the gates' flags before the others.

    ``stale_or_misaligned`` says that too little is aligned, that the last common bar is
    older than the one that closes at ``as_of`` (by default each bar's own close), or
    that the history is too short; the first two may both say it.
    """
    needed = config.required_returns + 1
    known = rows.join(alignment, ["symbol", "t"], "left").withColumn("_at", as_of if as_of is not None else F.col("t") + step)
    misaligned, stale = F.col("ratio") < config.least_alignment, F.col("_at") - (F.col("t") + step) >= step
    short = F.col("bars") < needed
    own = F.array_compact(F.array(F.when(misaligned, F.lit(STALE)), F.when(stale, F.lit(STALE)), F.when(short & ~misaligned & ~stale, F.lit(STALE))))
    reason = (
        F.when(short, F.concat(F.lit(f"need {needed} contiguous aligned bars; got "), F.col("bars")))
        .when(F.col("beta").isNull(), "unable to estimate beta from valid benchmark returns")
        .when(F.col("score").isNull(), "insufficient usable variation for multi-horizon score")
    )
    flagged = known.withColumns({"reason": reason, "flags": F.concat(own, "flags")}).drop("_at")
    return flagged.withColumn("rs_usable", F.col("score").isNotNull() & ~F.array_contains("flags", STALE))
