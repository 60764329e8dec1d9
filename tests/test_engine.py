"""Hand-computed values of the time-series engine, and its SQL on the small tables."""

from __future__ import annotations

import math

import pytest

from lodestar.config import DecisionConfig, StrengthConfig
from lodestar.operators import archive, decide, events, structure
from lodestar.plans import catalogue, oracle
from lodestar.sources import bars


def test_levels(spark):
    df = spark.createDataFrame([("a", 0, 100.0, 110.0, 90.0, 105.0, 1.0)], "symbol string, t long, o double, h double, l double, c double, v double")
    r = structure.with_levels(df).first()
    assert [round(r[k], 4) for k in ("pivot", "bottom", "top", "r1", "s1")] == [101.6667, 100.0, 103.3333, 113.3333, 93.3333]


def test_wilder_atr(spark):
    rows = [(100, 102, 98, 100), (100, 105, 99, 104), (104, 108, 103, 107), (107, 111, 105, 106), (106, 110, 100, 101)]
    df = spark.createDataFrame([("a", i * 86400, *map(float, r), 1.0) for i, r in enumerate(rows)], "symbol string, t long, o double, h double, l double, c double, v double")
    from lodestar.config import StructureConfig

    out = structure.wilder_atr(df, StructureConfig(atr_period=3)).orderBy("t").collect()
    assert out[-1]["atr"] == pytest.approx(64 / 9) and out[2]["atr"] is None


def test_settings_are_checked():
    with pytest.raises(ValueError):
        StrengthConfig(short=24, medium=24)
    with pytest.raises(ValueError):
        DecisionConfig(early=4.0)
    assert StrengthConfig.for_interval(21_600).required_returns == 88


def test_leave_one_out(spark):
    rows = [(s, t, 100 * (1 + g) ** t) for s, g in (("x", 0.0), ("A", 0.01), ("B", 0.02), ("C", 0.03)) for t in range(4)]
    out = decide.leave_one_out(spark.createDataFrame(rows, "symbol string, t long, c double"), "x", 1, 2).where("symbol = 'A' and t = 2").first()
    assert out["f"] == pytest.approx((math.log(1.02) + math.log(1.03)) / 2) and out["others"] == 2


def test_expectancy(spark):
    rows = [("a", 1, 2, "LONG", 0.03, 0.0), ("a", 2, 3, "SHORT", 0.01, 0.0), ("a", 3, 4, "LONG", 0.02, 0.0), ("a", 4, 5, "LONG", -0.005, 0.0), ("a", 5, 6, "LONG", None, 0.0)]
    r = events.metrics(spark.createDataFrame(rows, "symbol string, t long, exit_t long, direction string, gross double, funding double"), ["symbol"], 10.0).first()
    assert r["expectancy"] == pytest.approx(0.00775) and r["n"] == 4 and r["missing"] == 1


def test_average_rank(spark):
    out = decide.average_rank_percentile(spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, 3.0)], "t long, x double"), "x", "p").orderBy("x").collect()
    assert [r["p"] for r in out] == [0.0, 0.5, 0.5, 1.0]


def test_transitions_keep_state_where_not_eligible(spark):
    rows = [("r", "a", 1, True, "s", "LONG"), ("r", "a", 2, False, None, None), ("r", "a", 3, True, "s", "LONG"), ("r", "a", 4, True, "s", "SHORT"), ("r", "a", 5, True, None, None)]
    out = decide.transitions(spark.createDataFrame(rows, "rule string, symbol string, t long, eligible boolean, state string, direction string")).orderBy("t")
    assert [(r["t"], r["kind"]) for r in out.collect()] == [(1, "activated"), (4, "changed"), (5, "cleared")]


def test_first_active_time_is_seeded(spark):
    """Evaluations that find nothing leave no history; what is active at the first time with any is seeded."""
    rows = [("r", "a", 1, True, None, None), ("r", "a", 2, True, "s", "LONG"), ("r", "b", 2, True, "s", "LONG"), ("r", "b", 3, True, None, None), ("r", "c", 3, True, "s", "SHORT")]
    df = spark.createDataFrame(rows, "rule string, symbol string, t long, eligible boolean, state string, direction string")
    out = archive.seeded(decide.transitions(df))
    assert sorted((r["symbol"], r["t"], r["kind"]) for r in out.collect()) == [("a", 2, "seeded"), ("b", 2, "seeded"), ("b", 3, "cleared"), ("c", 3, "activated")]
    assert archive.event_counts(out).first().asDict() == {"rule": "r", "seeded": 2, "activated": 1, "changed": 0, "cleared": 1}


def test_duplicates_fail(spark):
    with pytest.raises(Exception, match="duplicate"):
        bars.without_duplicates(spark.createDataFrame([("a", 1), ("a", 1)], "symbol string, t long")).collect()


def test_every_sql_has_a_query():
    assert set(oracle.oracle_sql()) <= set(catalogue.queries())


@pytest.mark.parametrize("name", ["ohlcv_daily", "cpr_levels", "wilder_atr", "loo_factor", "universe_topk"])
def test_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "lineitem", "part"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = catalogue.queries()[name](spark, sf)
    names = sorted(found.columns)
    rel = con.execute(oracle.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    clean = lambda v: None if v is None else round(float(v), 5) if isinstance(v, float) else v
    wanted = sorted(str([clean(r[cols.index(c)]) for c in names]) for r in rel.fetchall())
    assert sorted(cols) == names and sorted(str([clean(r[c]) for c in names]) for r in found.collect()) == wanted
