"""A versioned archive of bars, its replay, and the tables around it."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.sources.shared import shared_folder


def changed_versions(stored: DataFrame, new: DataFrame, scan: int) -> DataFrame:
    """Rows to append: bars of this scan that differ from the latest version stored."""
    latest = versions_as_of(stored, scan)
    old = latest.select("symbol", "t", F.struct("o", "h", "l", "c", "v").alias("_old"))
    now = F.struct("o", "h", "l", "c", "v")
    return new.join(old, ["symbol", "t"], "left").where(~now.eqNullSafe(F.col("_old"))).drop("_old").withColumn("scan", F.lit(scan))


def versions_as_of(versions: DataFrame, scan) -> DataFrame:
    """Each bar as the last scan up to ``scan`` saw it: an aggregate, no join of versions with each other."""
    return versions.where(F.col("scan") <= scan).groupBy("symbol", "t").agg(F.max_by(F.struct("o", "h", "l", "c", "v"), "scan").alias("x")).select("symbol", "t", "x.*")


def versions_for_scans(versions: DataFrame, scans: DataFrame) -> DataFrame:
    """(scan, symbol, t, ...): each listed scan's own bars (scan, symbol, t) in the version it saw."""
    met = scans.join(versions.withColumnRenamed("scan", "seen"), ["symbol", "t"]).where(F.col("seen") <= F.col("scan"))
    return met.groupBy("scan", "symbol", "t").agg(F.max_by(F.struct("o", "h", "l", "c", "v"), "seen").alias("x")).select("scan", "symbol", "t", "x.*")


def first_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("symbol", "t").agg(F.min_by("c", "scan").alias("c"))


def audit(replayed: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("rule", "symbol", "t"), tolerance: float = 1e-8) -> DataFrame:
    """Every key where replay and archive disagree, and how: missing, unexpected, or score."""
    a, b = replayed.select(*keys, F.col("trigger_score").alias("now"), F.lit(1).alias("_a")), stored.select(*keys, F.col("trigger_score").alias("then"), F.lit(1).alias("_b"))
    met = a.join(b, list(keys), "full_outer")
    kind = F.when(F.col("_b").isNull(), "unexpected").when(F.col("_a").isNull(), "missing").when(~F.coalesce(F.abs(F.col("now") - F.col("then")) <= tolerance, F.col("now").isNull() & F.col("then").isNull()), "score")
    return met.withColumn("mismatch", kind).where("mismatch is not null").drop("_a", "_b")


def seeded(states: DataFrame) -> DataFrame:
    """Transitions with the first time at which a rule has anything active told apart: what is active then was seeded, not activated.

    Evaluations before it that found nothing make no transition, and so don't count as the first.
    """
    first = F.min("t").over(Window.partitionBy("rule"))
    return states.withColumn("kind", F.when((F.col("t") == first) & (F.col("kind") == "activated"), "seeded").otherwise(F.col("kind")))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("rule").pivot("kind", ["seeded", "activated", "changed", "cleared"]).count().na.fill(0)


def newest(rows: DataFrame, per_symbol: int) -> DataFrame:
    """The newest bars of each symbol."""
    place = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("t")))
    return rows.withColumn("_n", place).where(F.col("_n") <= per_symbol).drop("_n")


def merged(observed: DataFrame, step: int) -> DataFrame:
    """One bar for each time from observations (… observed_at): a bar seen after its close beats any seen before, later ones win."""
    verified = F.col("t") + step <= F.col("observed_at")
    place = F.row_number().over(Window.partitionBy("symbol", "t").orderBy(F.desc(verified), F.desc("observed_at")))
    return observed.withColumns({"verified": verified, "_n": place}).where("_n = 1").drop("_n")


# --- the archive of scans ----------------------------------------------------------------------

#: Version of the tables below; another one is refused.
SCHEMA = 2
TABLES = ("scans", "versions", "panel", "observations", "evaluations", "events", "states")


class ArchiveError(ValueError):
    pass


class Archive:
    """Scans as committed partitions of Parquet tables: ``<table>/as_of=<epoch>``.

    A scan's tables are written first and its row of ``scans`` last; only what a row of
    ``scans`` names is read, so an attempt that broke off leaves nothing, and a repeated
    one replaces its partitions.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        try:
            return bool(self.spark.read.parquet(self._path(table)).columns)
        except AnalysisException:
            return False

    def scans(self) -> DataFrame | None:
        return self.spark.read.parquet(self._path("scans")) if self._exists("scans") else None

    def newest(self) -> tuple[int, str] | None:
        """Time and configuration hash of the newest scan; a scan of another schema is an error."""
        scans = self.scans()
        if scans is None:
            return None
        last = scans.orderBy(F.desc("as_of")).first()
        if last["schema_version"] != SCHEMA:
            raise ArchiveError(f"the archive has schema {last['schema_version']}, not {SCHEMA}")
        return last["as_of"], last["config_hash"]

    def read(self, table: str) -> DataFrame | None:
        """The committed rows of a table."""
        scans = self.scans()
        if scans is None or not self._exists(table):
            return None
        return self.spark.read.parquet(self._path(table)).join(F.broadcast(scans.select("as_of")), "as_of", "left_semi")  # a row a scan

    def check(self) -> None:
        """Every committed scan has its provenance, and its configuration has the hash that is stored."""
        scans = self.scans()
        if scans is None:
            return
        bad = scans.where(F.isnull("config_json") | F.isnull("observed_at") | (F.sha2("config_json", 256) != F.col("config_hash")) | (F.col("schema_version") != SCHEMA)).select("as_of").limit(5).collect()
        if bad:
            raise ArchiveError(f"scans without provenance, or with another configuration than their hash says: {[r['as_of'] for r in bad]}")

    def record(self, as_of: int, observed_at: int, config_json: str, bars: DataFrame, panel: DataFrame, states: DataFrame, evaluations: DataFrame, identity: dict | None = None) -> bool:
        """Store a scan; False if it is stored already. Older scans and other configurations are errors.

        bars: symbol, interval, t, o, h, l, c, v; panel: symbol and further columns; states:
        the specifications' rows at this scan (spec_id, symbol, eligible, state, direction,
        trigger_score, entry_price, features, ...); evaluations: a row a specification.
        """
        config_hash = hashlib.sha256(config_json.encode()).hexdigest()
        newest = self.newest()
        if newest and as_of < newest[0]:
            raise ArchiveError(f"a scan of {as_of} comes after one of {newest[0]}")
        if newest and config_hash != newest[1]:
            raise ArchiveError("the configuration isn't the one that the archive was begun with")
        if newest and as_of == newest[0]:
            return False
        put = lambda table, df: df.write.mode("overwrite").parquet(f"{self._path(table)}/as_of={as_of}")
        stored = self.read("versions")
        old = None if stored is None else stored.groupBy("symbol", "interval", "t").agg(F.max_by(F.struct("o", "h", "l", "c", "v"), "as_of").alias("_old"))
        now = F.struct("o", "h", "l", "c", "v")
        fresh = bars if old is None else bars.join(old, ["symbol", "interval", "t"], "left").where(~now.eqNullSafe(F.col("_old"))).drop("_old")
        put("versions", fresh.select("symbol", "interval", "t", "o", "h", "l", "c", "v"))
        put("panel", panel)
        active = states.where("state is not null")
        put("observations", active.drop("eligible"))
        put("evaluations", evaluations)
        before, seen = self.read("states"), self.read("observations")
        current = active.select("spec_id", "symbol", F.struct("state", "direction").alias("now"))
        none = active.select("spec_id", "symbol", "state", "direction", F.lit(0).cast("long").alias("updated")).limit(0)
        held = before.where(F.col("as_of") == newest[0]) if before is not None else none
        previous = held.select("spec_id", "symbol", F.struct("state", "direction").alias("then"), "updated")
        history = (seen.select("spec_id").distinct() if seen is not None else current.select("spec_id").limit(0)).withColumn("known", F.lit(True))
        judged = states.where("eligible").select("spec_id", "symbol").distinct().withColumn("judged", F.lit(True))
        met = current.join(previous, ["spec_id", "symbol"], "full_outer").join(judged, ["spec_id", "symbol"], "left").join(history, "spec_id", "left")
        first = F.when(F.col("known"), "activated").otherwise("seeded")
        kind = F.when(F.isnull("then") & F.isnotnull("now"), first).when(F.isnull("now") & F.isnotnull("then"), "cleared").when(~F.col("now").eqNullSafe(F.col("then")), "changed")
        told = met.withColumn("kind", F.when(F.col("judged"), kind)).where("kind is not null")
        put("events", told.select("spec_id", "symbol", "kind", F.col("now.state").alias("state"), F.col("now.direction").alias("direction"), F.col("then.state").alias("state_before"), F.col("then.direction").alias("direction_before")))
        # What wasn't judged keeps its state, and when that was last judged.
        kept = met.withColumn("held", F.when(F.col("judged"), F.col("now")).otherwise(F.col("then"))).where("held is not null")
        put("states", kept.select("spec_id", "symbol", F.col("held.state").alias("state"), F.col("held.direction").alias("direction"), F.when(F.col("judged"), F.lit(as_of)).otherwise(F.col("updated")).cast("long").alias("updated")))
        row = {"observed_at": observed_at, "config_json": config_json, "config_hash": config_hash, "schema_version": SCHEMA, "source_hash": (identity or {}).get("source_hash"), "code_revision": (identity or {}).get("code_revision")}
        schema = "observed_at long, config_json string, config_hash string, schema_version int, source_hash string, code_revision string"
        put("scans", self.spark.createDataFrame([tuple(row.values())], schema).coalesce(1))
        return True

    def status(self) -> dict:
        """Newest scan, rows of every table, and the figures of each specification."""
        newest = self.newest()
        tables = {t: self.read(t) for t in TABLES}
        out = {"schema_version": SCHEMA, "last_completed_bar": newest and newest[0], **{t: tables[t].count() if tables[t] is not None else 0 for t in TABLES if t != "states"}, "active_states": 0, "unavailable_states": 0, "models": {}}
        if newest is None:
            return out
        states = tables["states"].where(F.col("as_of") == newest[0])
        count = lambda df, *more: {r["spec_id"]: r.asDict() for r in df.groupBy("spec_id").agg(F.count("*").alias("n"), *more).collect()}  # noqa: E731  a row a specification
        held = count(states, F.count_if(F.col("updated") < newest[0]).alias("unavailable"))
        kinds = count(tables["events"], *(F.count_if(F.col("kind") == k).alias(k) for k in ("seeded", "activated", "changed", "cleared")))
        runs, observed = count(tables["evaluations"]), count(tables["observations"])
        for spec in sorted(runs):
            events = kinds.get(spec, {})
            out["models"][spec] = {"evaluations": runs[spec]["n"], "observations": observed.get(spec, {}).get("n", 0), "events": events.get("n", 0), "seeded": events.get("seeded", 0), "activations": events.get("activated", 0), "changes": events.get("changed", 0), "clearings": events.get("cleared", 0), "active_states": held.get(spec, {}).get("n", 0), "unavailable_states": held.get(spec, {}).get("unavailable", 0)}
        out["active_states"] = sum(m["active_states"] for m in out["models"].values())
        out["unavailable_states"] = sum(m["unavailable_states"] for m in out["models"].values())
        return out

    def bars_at(self, as_of: int, versions: DataFrame | None = None) -> DataFrame:
        """symbol, interval, t, o..v as the scan of ``as_of`` saw them."""
        seen = (self.read("versions") if versions is None else versions).where(F.col("as_of") <= as_of)
        return seen.groupBy("symbol", "interval", "t").agg(F.max_by(F.struct("o", "h", "l", "c", "v"), "as_of").alias("x")).select("symbol", "interval", "t", "x.*")

    def first_closes(self, interval: int) -> DataFrame:
        """symbol, t, c as they were first observed: later corrections don't rewrite outcomes."""
        own = self.read("versions").where(F.col("interval") == interval)
        return own.groupBy("symbol", "t").agg(F.min_by("c", "as_of").alias("c"))

    def replay(self, rescan) -> DataFrame:
        """spec_id, symbol, as_of, mismatch: what ``rescan(bars, panel, as_of)`` (the specifications' rows again) has otherwise than the archive.

        A scan's membership and bar versions are its own, so scans are replayed one by one.
        Each is a job that writes its rows to the shared folder, and the audit reads them
        all: no plan grows with the number of scans.
        """
        self.check()
        if self.newest() is None:
            raise ArchiveError("there is nothing to replay")
        versions, panels, folder = self.read("versions"), self.read("panel"), shared_folder(self.spark)
        for r in self.scans().select("as_of").orderBy("as_of").collect():  # a row a scan
            panel = panels.where(F.col("as_of") == r["as_of"]).drop("as_of")
            bars = self.bars_at(r["as_of"], versions).join(panel.select("symbol").distinct(), "symbol", "left_semi")
            own = rescan(bars, panel, r["as_of"]).where("state is not null")
            own.select("spec_id", "symbol", "direction", F.col("trigger_score").cast("double")).write.parquet(f"{folder}/as_of={r['as_of']}")
        again = self.spark.read.schema("spec_id string, symbol string, direction string, trigger_score double, as_of long").parquet(folder)
        stored = self.read("observations").select("spec_id", "symbol", "direction", "trigger_score", F.col("as_of").cast("long").alias("as_of"))
        return audit_directions(again, stored)


def audit_directions(replayed: DataFrame, stored: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Where replay and archive disagree: an observation missing or unexpected, or another score or direction."""
    keys = ["spec_id", "symbol", "as_of"]
    a, b = replayed.select(*keys, F.struct("trigger_score", "direction").alias("now")), stored.select(*keys, F.struct("trigger_score", "direction").alias("then"))
    met = a.join(b, keys, "full_outer")
    differs = (F.abs(F.col("now.trigger_score") - F.col("then.trigger_score")) > tolerance) | (F.col("now.direction") != F.col("then.direction"))
    kind = F.when(F.isnull("then"), "unexpected").when(F.isnull("now"), "missing").when(differs, "score or direction differs")
    return met.withColumn("mismatch", kind).where("mismatch is not null").select(*keys, "mismatch")


def replay_entries(observations: DataFrame, scans: DataFrame, transitions: DataFrame, step: int) -> DataFrame:
    """Observations that were activated or changed (the seeded ones are counted elsewhere), with the bar whose close is the first at or after the scan was observed."""
    kinds = transitions.select("spec_id", "symbol", "as_of", "kind")
    met = observations.join(kinds, ["spec_id", "symbol", "as_of"], "left").join(F.broadcast(scans.select("as_of", "observed_at")), "as_of")  # a row a scan
    close = (F.ceil(F.col("observed_at") / step) * step).cast("long")
    return met.where(F.col("kind").isin("activated", "changed")).withColumns({"t": close - step, "entry_close": close, "entry_delay": close - F.col("observed_at")})
