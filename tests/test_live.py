"""The live loop, the archive, sources and sinks on the made-up panel."""

from __future__ import annotations

import json
import math
from dataclasses import replace

import pytest

from lodestar import config as settings
from lodestar.operators import archive, context
from lodestar.sinks import report, server
from lodestar.sources import bars, files, live
from lodestar.streaming.live import BarCache, LiveLoop

END = 1_786_078_800  # 2026-08-07T05:00Z


@pytest.fixture(scope="module")
def series(spark):
    hourly = bars.demo_panel(spark)
    daily = bars.rollup(hourly, 3600)
    return {"1h": [tuple(r) for r in hourly.select(*"symbol t o h l c v".split()).collect()], "1d": [tuple(r) for r in daily.select(*"symbol t o h l c v".split()).collect()]}


class Made:
    """A source over the made-up series that can be told to fail."""

    def __init__(self, series, now=END):
        self.series, self.now, self.without = series, now, set()

    def bars(self, symbol, interval, start, end):
        return [b for b in self.series[interval] if b[0] == symbol and start <= b[1] <= end]

    def mids(self):
        if "mids" in self.without:
            raise live.SourceError("no prices")
        return {s: max((b for b in self.series["1h"] if b[0] == s and b[1] < self.now), key=lambda b: b[1])[5] for s in ("BTC", "ETH", "SOL")}

    def markets(self):
        return [{"name": s} for s in ("BTC", "ETH", "SOL")], [{"dayNtlVlm": "1000000", "midPx": "10", "impactPxs": ["9.99", "10.01"]} for _ in range(3)]


CONFIG = settings.ScanConfig(strength=settings.StrengthConfig(least_constituents=1))


def test_first_archive_of_the_made_up_panel(spark, series, tmp_path):
    source = Made(series)
    loop = LiveLoop(spark, source, str(tmp_path), CONFIG, now=lambda: END, sleep=lambda s: None)
    assert loop.tick(END, True), loop.status.error
    status = loop.archive.status()
    assert status["evaluations"] == 5 and status["observations"] == 7 and status["events"] == 7 and sum(m["seeded"] for m in status["models"].values()) == 7
    assert status["last_completed_bar"] == END and status["unavailable_states"] == 0
    loop.archive.check()
    shown = files.read_snapshot(tmp_path / "scanner_latest.json")
    assert shown["schema_version"] == 5 and {r["symbol"] for r in shown["rows"]} == {"ETH", "SOL"} and shown["breadth"]["usable_assets"] == 2
    assert loop.shown_status()["ready"]
    # The same bar again changes nothing, and neither does a tick of the fast tier.
    assert loop.tick(END, True) and loop.tick(END + 20, False) and loop.archive.status() == status
    # A refresh that can't get prices stays due, and is made up for.
    source.without.add("mids")
    assert not loop.tick(END + 3600, True) and loop.due and not loop.shown_status()["ready"]
    source.without.clear()
    assert loop.tick(END + 3600, False) and not loop.due


def test_uncommitted_refresh_is_committed_first(spark, series, tmp_path):
    loop = LiveLoop(spark, Made(series), str(tmp_path), CONFIG, now=lambda: END, sleep=lambda s: None)
    record, calls = loop.archive.record, []

    def fails(*a, **k):
        calls.append(1)
        if len(calls) == 1:
            raise OSError("disk is full")
        return record(*a, **k)

    loop.archive.record = fails
    assert not loop.tick(END, True) and loop.pending is not None and loop.archive.newest() is None
    assert loop.tick(END, False) and loop.pending is None and loop.archive.newest()[0] == END


def scan_of(spark, states):
    return spark.createDataFrame([(s, y, e, *x) for s, y, e, x in states], "spec_id string, symbol string, eligible boolean, state string, direction string, trigger_score double")


def test_archive_keeps_order_states_and_revisions(spark, tmp_path):
    a = archive.Archive(spark, str(tmp_path / "a"))
    bar = lambda c: spark.createDataFrame([("x", 60, 0, 1.0, 2.0, 0.5, c, 1.0), ("x", 60, 60, 1.0, 2.0, 0.5, 1.5, 1.0)], "symbol string, interval int, t long, o double, h double, l double, c double, v double")
    panel = spark.createDataFrame([("x",)], "symbol string")
    judged = spark.createDataFrame([("S", 1)], "spec_id string, usable int")
    on, off, none = ("s", "LONG", 1.0), (None, None, None), (None, None, None)
    put = lambda t, c, states, conf="{}": a.record(t, t, conf, bar(c), panel, scan_of(spark, states), judged)
    assert put(100, 1.0, [("S", "x", True, on), ("S", "y", True, on), ("S", "z", True, off)])
    assert not put(100, 1.0, [("S", "x", True, off)])
    assert put(200, 1.1, [("S", "x", False, none), ("S", "y", True, off), ("S", "z", True, on)])
    with pytest.raises(archive.ArchiveError):
        put(150, 1.0, [("S", "x", True, on)])
    with pytest.raises(archive.ArchiveError):
        put(300, 1.0, [("S", "x", True, on)], '{"other":1}')
    assert put(300, 1.1, [("S", "x", True, ("s", "SHORT", 2.0)), ("S", "y", True, off), ("S", "z", True, on)])
    found = sorted((r["as_of"], r["symbol"], r["kind"]) for r in a.read("events").collect())
    assert found == [(100, "x", "seeded"), (100, "y", "seeded"), (200, "y", "cleared"), (200, "z", "activated"), (300, "x", "changed")]
    held = {r["symbol"]: (r["direction"], r["updated"]) for r in a.read("states").where("as_of = 200").collect()}
    assert held == {"x": ("LONG", 100), "z": ("LONG", 200)} and a.status()["unavailable_states"] == 0
    assert a.read("versions").where("t = 0").count() == 2 and a.read("versions").where("t = 60").count() == 1
    close = lambda df: df.where("t = 0").first()["c"]
    assert close(a.bars_at(100)) == 1.0 and close(a.bars_at(300)) == 1.1 and close(a.first_closes(60)) == 1.0
    # An attempt that broke off before its scan was committed isn't seen.
    scan_of(spark, [("S", "q", True, on)]).write.parquet(str(tmp_path / "a" / "observations" / "as_of=400"))
    assert a.read("observations").where("symbol = 'q'").count() == 0
    again = lambda wrong: lambda bars, panel, as_of: a.read("observations").where(f"as_of = {as_of}").withColumn("trigger_score", __import__("pyspark").sql.functions.col("trigger_score") + wrong)
    assert a.replay(again(0.0)).count() == 0
    mismatches = a.replay(again(0.1))
    assert mismatches.count() == a.read("observations").count()
    with pytest.raises(report.ReplayMismatch):
        report.replay_report(tmp_path / "replay.json", mismatches, 3)
    assert json.loads((tmp_path / "replay.json").read_text())["audit"]["scans"] == 3


def test_bars_are_final_only_when_seen_closed(spark):
    cache = BarCache(spark, 60, 2)
    bar = lambda t, c: ("x", t, c, c, c, c, 1.0)
    cache.merge([bar(0, 1.0), bar(60, 2.0)], 100)
    assert [r["t"] for r in cache.frame(1000).collect()] == [0]  # the second was still forming when it was seen
    cache.merge([bar(60, 3.0)], 120)
    cache.merge([bar(60, 9.0)], 110)
    assert cache.held["x", 60][5] == 3.0
    cache.merge([bar(60, 4.0), bar(120, 5.0)], 130)
    assert set(cache.held) == {("x", 60), ("x", 120)} and cache.held["x", 60][5] == 4.0 and cache.since("x", 200, 9) == 0 and cache.since("y", 600, 9) == 60
    assert cache.times == {"x": {60, 120}} and cache.completed("x", 1000) == 1 and cache.completed("x", 100) == cache.completed("y", 1000) == 0


def test_paced_source_asks_again():
    class Shy:
        left = 2

        def bars(self, *a):
            self.left -= 1
            return [("x", 0, 1, 1, 1, 1, 0)] if self.left < 0 else []

    waits, clock = [], [0.0]

    def sleep(s):
        waits.append(round(s, 6))
        clock[0] += s

    paced = live.Paced(Shy(), sleep=sleep, clock=lambda: clock[0])
    assert paced.bars("x", "1h", 0, 1) and waits == [0.4, 0.8]
    with pytest.raises(live.LoadShed):
        live.Paced(type("No", (), {"bars": lambda *a: []})(), sleep=lambda s: None).bars("x", "1h", 0, 1)


def test_http_answers_must_name_what_was_asked():
    row = {"t": 3_600_000, "s": "x", "i": "1h", "o": "1", "h": "2", "l": "1", "c": "2", "v": "3"}
    source = live.HttpSource("http://nowhere", sleep=lambda s: None, post=lambda p: [row])
    assert source.bars("x", "1h", 0, 1) == [("x", 3600, 1.0, 2.0, 1.0, 2.0, 3.0)]
    for asked in (("y", "1h"), ("x", "1d")):
        with pytest.raises(live.SourceError):
            source.bars(*asked, 0, 1)
    tried = []

    def flaky(p):
        tried.append(1)
        if len(tried) < 3:
            raise OSError("reset")
        return {"x": "1.5"}

    assert live.HttpSource("u", sleep=lambda s: None, post=flaky).mids() == {"x": 1.5}
    for bad in ({"x": "nan"}, {"x": "0"}, {"x": "-1"}):
        with pytest.raises(live.SourceError):
            live.HttpSource("u", sleep=lambda s: None, post=lambda p: bad).mids()  # noqa: B023
    with pytest.raises(live.SourceError):
        live.parsed_bar("x", row | {"l": "3"})


def made_source():
    class Two:
        def bars(self, symbol, interval, start, end):
            return [(symbol, start, 1.0, 2.0, 1.0, 2.0, 0.0)]

    return Two()


def test_bars_data_source(spark):
    spark.dataSource.register(live.BarsDataSource)
    found = spark.read.format("lodestar_bars").options(symbols="a, b", interval="1h", start="60", end="120", factory="tests.test_live:made_source").load()
    assert sorted((r["symbol"], r["t"]) for r in found.collect()) == [("a", 60), ("b", 60)]


def test_live_universe(spark):
    rows = [("BTC", False, "5"), ("A", False, "9"), ("B", False, "7"), ("C", True, "99"), ("D", False, "7"), ("R", False, "1")]
    df = spark.createDataFrame(rows, "name string, isDelisted boolean, dayNtlVlm string")
    pick = lambda size, *need: [r["name"] for r in context.live_universe(df, size, need).orderBy("place").collect()]
    assert pick(3, "BTC") == ["A", "B", "BTC"] and pick(3, "BTC", "R") == ["A", "BTC", "R"] and pick(9, "BTC") == ["A", "B", "D", "BTC", "R"]
    for size, need in ((1, ("BTC", "R")), (3, ("C",)), (0, ())):
        with pytest.raises(context.UniverseError):
            pick(size, *need)
    with pytest.raises(context.UniverseError):
        context.live_universe(df.union(spark.createDataFrame([("Z", False, "oops")], df.schema)), 3, ())


def test_contexts(spark):
    raw = spark.createDataFrame([("x", "200", "10", ["9", "11"]), ("y", "inf", None, ["9", "11"]), ("z", "abc", "0", ["11", "9"]), ("w", None, "10", ["9"])], "symbol string, dayNtlVlm string, midPx string, impactPxs array<string>")
    for c in ("markPx", "funding", "openInterest", "premium"):
        raw = raw.selectExpr("*", f"cast(null as string) {c}")
    daily = spark.createDataFrame([("x", i * 86400, 1.0, 4.0, 1.0, 1.0, v) for i, v in enumerate([1000.0] + [10.0, 30.0, 0.0, 20.0] * 5)], "symbol string, t long, o double, h double, l double, c double, v double")
    got = {r["symbol"]: (r["day_notional"], r["impact_spread_bps"], r["relative_notional"]) for r in context.market_context(raw, daily).collect()}
    assert got == {"x": (200.0, 2000.0, 5.0), "y": (None, 2000.0, None), "z": (None, None, None), "w": (None, None, None)}
    with pytest.raises(Exception, match="observed after"):
        context.guarded(spark.createDataFrame([("x", 5)], "symbol string, t long"), spark.createDataFrame([("x", 5, 6)], "symbol string, t long, observed_at long")).collect()
    with pytest.raises(Exception, match="differ in length"):
        context.paired(spark.createDataFrame([([("a",)],)], "entries array<struct<name:string>>"), spark.createDataFrame([([("1",), ("2",)],)], "contexts array<struct<v:string>>")).collect()
    days = spark.createDataFrame([("x", 0, 1.0), ("x", 86400, 2.0), ("y", 0, 3.0)], "symbol string, t long, o double")
    assert [tuple(r) for r in context.session_open(days, 86400 + 5).collect()] == [("x", 2.0)]
    found = {r["symbol"]: r["admitted"] for r in context.admission(days, days, 2 * 86400).collect()}
    assert found == {"x": True, "y": False}


def test_settings_file():
    text = '[scanner]\ninterval_seconds = 3600\n[relative_strength]\nwinsor_mad = 5.0\nsecondary_benchmark = "SOL"\n[decision]\nearly_discovery_score = 2.0\n[live]\nuniverse_size = 5\n'
    own = settings.read_settings(text)
    assert own.strength.winsor == 5.0 and own.secondary == "SOL" and own.decision.early == 2.0 and own.live.universe_size == 5 and own.strength.beta_window == 720
    assert settings.read_settings("", 21_600).strength.required_returns == 88
    for bad in ("[other]\nx = 1", "[scanner]\nnope = 1", "scanner = 3", "[decision]\nearly_discovery_score = 9.0", "[live]\nuniverse_size = true", "[relative_strength]\nmin_alignment_ratio = 0.0"):
        with pytest.raises(ValueError):
            settings.read_settings(bad)
    with pytest.raises(ValueError):
        settings.read_settings("[scanner]\ninterval_seconds = 60", 3600)
    assert settings.for_model(settings.ScanConfig(), settings.BROAD).secondary == settings.BROAD_FACTOR
    with pytest.raises(ValueError):
        settings.for_model(settings.ScanConfig(), "none")


def test_publishing(spark, tmp_path, monkeypatch):
    report.publish_json(tmp_path / "a" / "x.json", {"b": 1})
    assert (tmp_path / "a" / "x.json").stat().st_mode & 0o777 == 0o644
    monkeypatch.setattr(report.os, "replace", lambda a, b: (_ for _ in ()).throw(PermissionError("no")))
    with pytest.raises(PermissionError, match="no"):
        report.publish(tmp_path / "a" / "x.json", "other")
    monkeypatch.undo()
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["x.json"] and json.loads((tmp_path / "a" / "x.json").read_text()) == {"b": 1}
    assert report.canonical_json({"b": 1, "a": [1, None]}) == '{"a":[1,null],"b":1}'
    with pytest.raises(ValueError):
        report.canonical_json(math.nan)
    with pytest.raises(SystemExit):
        report.writable("/proc/nowhere")
    one = report.identity()
    assert len(one["source_hash"]) == 64 and one == report.identity()
    (tmp_path / "h.jsonl").write_text('{"event_id": 1, "symbol": "a"}\n{"event_id": 3, "symbol": "c"}\n{"event_id": 2, "symbol": "b"}\n{"event_id": 4, "sym')
    assert [r["symbol"] for r in files.read_history(spark, str(tmp_path / "h.jsonl"), 2).collect()] == ["c", "b"]
    assert files.read_snapshot(tmp_path / "none.json") is None
    text = report.page({"as_of": "now", "rows": [{"symbol": "<b>", "market": {}, "rs": {}, "setup": {"label": "WATCH", "reasons": ["a & b"]}}]})
    assert "&lt;b&gt;" in text and "a &amp; b" in text and "<script" not in text


def test_server_is_read_only(tmp_path):
    import http.client
    import threading

    status = {"running": True, "ready": True, "failures": 0}
    view = server.View(tmp_path, lambda: status)
    bound = server.server(view, 0)
    threading.Thread(target=bound.serve_forever, daemon=True).start()

    def ask(path, method="GET"):
        link = http.client.HTTPConnection("127.0.0.1", bound.server_port, timeout=10)
        link.request(method, path)
        got = link.getresponse()
        body = got.read()
        link.close()
        assert got.getheader("Cache-Control") == "no-store" and "default-src 'none'" in got.getheader("Content-Security-Policy")
        return got.status, json.loads(body) if got.getheader("Content-Type").startswith("application/json") else body.decode()

    try:
        assert ask("/")[0] == ask("/api/snapshot")[0] == ask("/ready")[0] == 503 and ask("/health") == (200, {"ok": False}) and ask("/api/signals") == (200, [])
        report.publish_json(tmp_path / "scanner_latest.json", {"as_of": "now"})
        report.publish(tmp_path / "scanner_latest.html", "<p>page</p>")
        (tmp_path / "signal_history.jsonl").write_text("".join(f'{{"event_id": {i}}}\n' for i in range(600)) + '[1]\n{"event_id": "x"}\n{"event_id": 9')
        assert ask("/") == (200, "<p>page</p>") and ask("/api/snapshot") == (200, {"as_of": "now"}) and ask("/livez") == (200, {"ok": True}) and ask("/health") == (200, {"ok": True})
        shown = lambda query: [e["event_id"] for e in ask(f"/api/signals{query}")[1]]
        assert shown("?limit=2") == [599, 598] and len(shown("?limit=x")) == len(shown("")) == 50 and len(shown("?limit=9999")) == 500 and shown("?limit=-3") == [599]
        assert ask("/ready")[0] == 200 and ask("/api/status")[1]["loop"] == "live"
        status["failures"] = 1
        assert ask("/ready")[0] == 503 and ask("/api/status")[1]["loop"] == "failing"
        status["running"] = False
        assert ask("/api/status")[1]["loop"] == "off" and server.View(tmp_path).state() == {"loop": "off"}
        assert ask("/none")[0] == 404 and {ask("/", m)[0] for m in ("POST", "PUT", "DELETE", "PATCH")} == {405}
    finally:
        bound.shutdown()
        bound.server_close()
    for port, host in ((0, "127.0.0.1"), (70_000, "127.0.0.1"), (80, " ")):
        with pytest.raises(ValueError):
            server.serve(tmp_path, port, host)


def test_loop_tells_whether_it_runs(spark, series, tmp_path):
    loop = LiveLoop(spark, Made(series), str(tmp_path), CONFIG, now=lambda: END, sleep=lambda s: None)
    seen = []
    loop.tick = lambda as_of, refresh: seen.append((loop.status.running, refresh)) or True
    loop.due = False
    loop.run(lambda: len(seen) == 2)
    assert seen == [(True, True), (True, False)] and not loop.status.running
