"""Bars: from trades, from fixtures, and the gates in front of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import finite

#: Bar sizes in seconds and their names.
INTERVALS = {60: "1m", 180: "3m", 300: "5m", 900: "15m", 1800: "30m", 3600: "1h", 7200: "2h", 14400: "4h", 28800: "8h", 43200: "12h"}
DAY = 86_400


def interval_name(seconds: int) -> str:
    if seconds not in INTERVALS:
        raise ValueError(f"no bar size of {seconds} seconds")
    return INTERVALS[seconds]


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone, read as UTC."""
    return F.unix_seconds(ts.cast("timestamp"))


def ohlcv(trades: DataFrame, seconds: int) -> DataFrame:
    """symbol, t (bar start, epoch seconds), o, h, l, c, v from (symbol, ts, price). One partial aggregate, one shuffle."""
    rows = trades.where(F.col("price") > 0).withColumn("s", epoch(F.col("ts")))
    start = (F.floor(F.col("s") / seconds) * seconds).cast("long")
    return rows.groupBy("symbol", start.alias("t")).agg(
        F.min_by("price", "ts").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "ts").alias("c"), F.count("*").cast("double").alias("v")
    )


def valid_bar() -> Column:
    """Finite values, positive prices, high and low around open and close, no negative volume."""
    prices = [F.col(c) for c in "ohlc"]
    ok = F.lit(True)
    for x in [*prices, F.col("v")]:
        ok = ok & finite(x)
    for x in prices:
        ok = ok & (x > 0)
    return F.coalesce(ok & (F.col("h") >= F.greatest(*prices)) & (F.col("l") <= F.least(*prices)) & (F.col("v") >= 0), F.lit(False))


def completed(bars: DataFrame, seconds: int, as_of) -> DataFrame:
    """Bars that had closed by ``as_of`` (epoch seconds)."""
    return bars.where(F.col("t") + seconds <= as_of)


def without_duplicates(bars: DataFrame, keys: tuple[str, ...] = ("symbol", "t")) -> DataFrame:
    """The same rows; reading them fails if a bar occurs twice."""
    n = F.count("*").over(Window.partitionBy(*keys))
    checked = F.when(n > 1, F.raise_error(F.lit("duplicate bar timestamps"))).otherwise(F.lit(True))
    return bars.withColumn("_once", checked).where("_once").drop("_once")


def rollup(bars: DataFrame, seconds: int, into: int = DAY) -> DataFrame:
    """Larger bars, only from complete sets of smaller ones."""
    start = (F.floor(F.col("t") / into) * into).cast("long")
    groups = bars.groupBy("symbol", start.alias("day")).agg(
        F.min_by("o", "t").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "t").alias("c"), F.sum("v").alias("v"), F.count("*").alias("n")
    )
    return groups.where(F.col("n") == into // seconds).drop("n").withColumnRenamed("day", "t")


def parse_time(x: Column) -> Column:
    """Epoch seconds from Unix milliseconds or from ISO text with a zone; text without a zone is refused."""
    zoned = x.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    number = x.rlike(r"^-?[0-9]+(\.[0-9]+)?$")
    refused = F.raise_error(F.concat(F.lit("timestamp without zone: "), x)).cast("double")
    return F.when(x.isNull(), F.lit(None)).when(number, x.cast("double") / 1000).when(zoned, F.unix_micros(F.to_timestamp(x)) / 1e6).otherwise(refused)


_CANDLE = "struct<t:string,timestamp:string,o:double,open:double,h:double,high:double,l:double,low:double,c:double,close:double,v:double,volume:double>"
_FIXTURE = f"as_of string, interval_seconds int, assets map<string,struct<price:double,session_open:double,prior_price:double,daily:array<{_CANDLE}>,intraday:array<{_CANDLE}>>>"


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """symbol, series (daily or intraday), t, o, h, l, c, v, price, prior_price, session_open: closed bars of a JSON panel."""
    panel = spark.read.option("multiLine", True).schema(_FIXTURE).json(path)
    as_of = parse_time(F.col("as_of"))
    assets = panel.select(as_of.alias("as_of"), F.coalesce("interval_seconds", F.lit(3600)).alias("step"), F.explode("assets").alias("symbol", "a"))
    series = None
    for name, step in (("daily", F.lit(DAY)), ("intraday", F.col("step"))):
        one = assets.select("symbol", F.lit(name).alias("series"), "as_of", step.alias("step"), "a.price", "a.prior_price", "a.session_open", F.explode(f"a.{name}").alias("x"))
        series = one if series is None else series.unionByName(one)
    pick = lambda short, long: F.coalesce(F.col(f"x.{short}"), F.col(f"x.{long}"))
    bars = series.select(
        "symbol", "series", "as_of", "step", "price", "prior_price", "session_open", parse_time(pick("t", "timestamp")).cast("long").alias("t"),
        pick("o", "open").alias("o"), pick("h", "high").alias("h"), pick("l", "low").alias("l"), pick("c", "close").alias("c"), F.coalesce(pick("v", "volume"), F.lit(0.0)).alias("v"),
    )
    checked = F.when(valid_bar(), F.lit(True)).otherwise(F.raise_error(F.lit("invalid bar")))
    closed = bars.where(F.col("t") + F.col("step") <= F.col("as_of")).where(checked).drop("as_of", "step")
    return without_duplicates(closed, ("symbol", "series", "t"))


# Fixed values of the made-up panel: first prices, moves, and when it ends.
FIRST = {"BTC": 95_000.0, "SOL": 160.0, "ETH": 3000.0}
DEMO_END = 1_786_078_800


def demo_panel(spark: SparkSession, bars: int = 1001, end: int = DEMO_END) -> DataFrame:
    """Three made-up hourly series: a benchmark and two that follow it."""
    i = spark.range(bars).select(F.col("id").alias("i"), (F.lit(end - bars * 3600) + F.col("id") * 3600).alias("t"))
    b = F.lit(0.00015) + 0.003 * F.sin(F.col("i") / 13)
    moves = {"BTC": b, "SOL": 1.7 * b + 0.0016 + 0.0008 * F.sin(F.col("i") / 5), "ETH": 1.1 * b - 0.0005 + 0.0007 * F.sin(F.col("i") / 7)}
    rows = i.select("i", "t", F.explode(F.create_map(*(x for s, r in moves.items() for x in (F.lit(s), F.struct(F.lit(FIRST[s]).alias("first"), r.alias("r")))))).alias("symbol", "m"))
    own = Window.partitionBy("symbol").orderBy("i")
    priced = rows.withColumn("c", F.col("m.first") * F.exp(F.sum("m.r").over(own))).withColumn("o", F.coalesce(F.lag("c").over(own), F.col("m.first")))
    return priced.select("symbol", "t", "o", (F.greatest("o", "c") * 1.001).alias("h"), (F.least("o", "c") * 0.999).alias("l"), "c", (F.lit(1e6) + 10 * F.col("i")).alias("v"))


def demo_markets(spark: SparkSession, size: int, bars: int = 1001, end: int = DEMO_END) -> DataFrame:
    """The made-up benchmark and its follower, and as many variations of the third series as make ``size`` markets."""
    three = demo_panel(spark, bars, end)
    i = (F.col("t") - (end - bars * 3600)) / 3600
    n = spark.range(size - 2).select(F.col("id").alias("n"))
    scale = 1 + 0.01 * F.sin(i / (5 + F.col("n")) + F.col("n"))
    many = three.where("symbol = 'SOL'").join(F.broadcast(n))  # a row a market
    alts = many.select(F.format_string("ALT%02d", "n").alias("symbol"), "t", *((F.col(c) * scale).alias(c) for c in "ohlc"), "v")
    return three.where("symbol <> 'SOL'").unionByName(alts)


def read_funding(spark: SparkSession, path: str) -> DataFrame:
    """symbol, t, rate, step, coverage_start, coverage_end; rates off the grid, not finite or repeated are errors."""
    schema = "interval_seconds int, coverage_start string, coverage_end string, rates map<string,array<struct<timestamp:string,rate:double>>>"
    raw = spark.read.option("multiLine", True).schema(schema).json(path)
    top = raw.select(F.col("interval_seconds").alias("step"), parse_time(F.col("coverage_start")).alias("coverage_start"), parse_time(F.col("coverage_end")).alias("coverage_end"), F.explode("rates").alias("symbol", "xs"))
    rows = top.select("symbol", "step", "coverage_start", "coverage_end", F.explode("xs").alias("x")).select("symbol", parse_time(F.col("x.timestamp")).alias("t"), "x.rate", "step", "coverage_start", "coverage_end")
    sound = finite(F.col("rate")) & (F.col("t") % F.col("step") == 0)
    checked = F.when(sound, F.lit(True)).otherwise(F.raise_error(F.lit("unsound funding rate")))
    return without_duplicates(rows.where(checked).withColumn("t", F.col("t").cast("long")))
