"""What leaves the engine: snapshots, reports, pages and exports, each published in one step.

Only results of bounded size come here: a scan's rows at one time (a row a symbol), and
aggregates.
"""

from __future__ import annotations

import datetime
import hashlib
import html
import json
import math
import os
import subprocess
import tempfile
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.config import DecisionConfig, ScanConfig
from lodestar.operators import board, research

# Versions of the documents.
SNAPSHOT, BACKTEST, REPLAY = 5, 4, 1
NAMES = {"candidate": "candidate_rs_score", "persistence": "candidate_persistence", "early": "early_discovery_score", "strong": "strong_discovery_score"}


def iso(seconds: float) -> str:
    return datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc).isoformat()


def canonical_json(value) -> str:
    """One text for equal values: keys sorted, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, default=str)


def publish(path: str | Path, text: str) -> None:
    """Write a file so that readers see the old one or the new one; a failure leaves nothing behind and keeps its own error."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=target.parent, prefix=f".{target.name}-", delete=False) as part:
        try:
            part.write(text)
            part.flush()
            os.fsync(part.fileno())
            os.chmod(part.name, 0o644)
            os.replace(part.name, target)
        except BaseException as error:
            try:
                os.unlink(part.name)
            except OSError as second:
                error.add_note(f"and {part.name} is still there: {second}")
            raise


def publish_json(path: str | Path, value) -> None:
    publish(path, json.dumps(value, indent=2, sort_keys=True, allow_nan=False, default=str))


def writable(folder: str | Path) -> None:
    """Raise before anything runs if nothing can be published there."""
    try:
        Path(folder).mkdir(parents=True, exist_ok=True)
        with tempfile.TemporaryFile(dir=folder):
            pass
    except OSError as error:
        raise SystemExit(f"{folder} can't be written to: {error}") from error


def identity(folder: str | Path | None = None) -> dict:
    """A hash of the package's source files, by path and content, and the revision if there is one."""
    top = Path(folder) if folder else Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for file in sorted(top.rglob("*.py")):
        digest.update(file.relative_to(top).as_posix().encode() + b"\0" + file.read_bytes() + b"\0")
    try:
        revision = subprocess.run(["git", "-C", str(top), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5, check=True).stdout.strip() or None
    except (OSError, subprocess.SubprocessError):
        revision = None
    return {"source_hash": digest.hexdigest(), "code_revision": revision}


def _plain(value):
    """Rows and maps as JSON has them; what isn't finite is null."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def breadth(rows: DataFrame, config: DecisionConfig = DecisionConfig(), keys: tuple[str, ...] = ()) -> DataFrame:
    """All figures of the cross-section: of usable rows, and counts of labels over all."""
    score, found = F.when(F.col("rs_usable"), F.col("score")), F.when(F.col("rs_usable"), F.col("discovery"))
    share = lambda c: F.avg(F.when(score.isNotNull(), c.cast("double")))
    candidate = F.col("label").endswith("CANDIDATE")
    return rows.groupBy(*keys).agg(
        F.count(score).alias("usable_assets"), share(score > 0).alias("positive_rs_ratio"), share(F.abs(score) >= config.candidate).alias("strong_rs_ratio"), F.median(score).alias("median_rs_score"),
        F.count_if(candidate & (F.col("confirmation") == "CONFIRMED")).alias("confirmed_candidates"), F.count_if(candidate & (F.col("confirmation") == "PROVISIONAL")).alias("provisional_candidates"),
        F.count_if(F.col("tier") == "EARLY_DISCOVERY").alias("early_discoveries"), F.count_if(F.col("tier") == "STRONG_DISCOVERY").alias("strong_discoveries"), F.median(found).alias("median_discovery_score"),
    )


MARKET = ("cpr_position", "pivot_position", "width_regime", "width_percentile", "atr", "volatility", "pivot", "bottom", "top", "r1", "r2", "r3", "s1", "s2", "s3", "daily_flags", "session_open")
STRENGTH = ("score", "discovery", "beta", "alpha", "r_squared", "residual_volatility", "beta_error", "beta_2", "beta_2_error", "g_beta", "n_eff", "persistence", "acceleration", "z_short", "z_medium", "z_long", "sum_short", "sum_medium", "sum_long", "pct_short", "pct_medium", "pct_long", "ratio", "flags", "reason", "model_version", "constituents")
SETUP = ("label", "direction", "strength", "confirmation", "tier", "reasons", "blockers", "closed_price")


def snapshot(rows: DataFrame, config: ScanConfig, as_of: int) -> dict:
    """The document of one scan: a row a symbol in the board's order, the figures of the cross-section, and the thresholds that made the labels."""
    part = lambda names: F.struct(*(F.col(n) for n in names if n in rows.columns))
    shown = board.ordered(rows).select(
        "symbol", "price", "strong_rank", "weak_rank", "input_cutoff", (F.col("rs_usable") & F.col("market_usable")).alias("data_available"), part(MARKET).alias("market"), part(STRENGTH).alias("rs"), part(SETUP).alias("setup")
    )
    gates = {NAMES[k]: v for k, v in asdict(config.decision).items()} | {"bar_interval_seconds": config.step} | {f"{h}_horizon_seconds": getattr(config.strength, h) * config.step for h in ("short", "medium", "long")}
    found = [_plain(r) for r in shown.collect()]  # a row a symbol
    model = found[0]["rs"].get("model_version") if found else None
    return {"schema_version": SNAPSHOT, "as_of": iso(as_of), "gates": gates, "model_version": model, "breadth": _plain(breadth(rows, config.decision).first()), "rows": found}


COLUMNS = ("Asset", "RS score", "CPR position", "CPR width", "Pivot position", "Setup", "Confirmation", "Why / blocker")


def page(document: dict, title: str = "Scan") -> str:
    """A page without scripts of a snapshot; every text is escaped."""
    said = lambda x: html.escape(str(x if x is not None else "—").replace("_", " "))
    body = []
    for row in document["rows"]:
        market, rs, setup = row["market"], row["rs"], row["setup"]
        score = rs.get("score")
        cells = [said(row["symbol"]), "—" if score is None else f"{score:.2f}", *(said(market.get(k)) for k in ("cpr_position", "width_regime", "pivot_position")), said(setup["label"]), said(setup.get("confirmation")).lower(), html.escape("; ".join(setup.get("reasons") or setup.get("blockers") or []))]
        body.append("<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>")
    head = "".join(f"<th>{html.escape(c)}</th>" for c in COLUMNS)
    return f"<!doctype html><html><head><meta charset=utf-8><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><p>As of {html.escape(document['as_of'])}. Labels for research, not orders.</p><table><thead><tr>{head}</tr></thead><tbody>{''.join(body)}</tbody></table></body></html>"


def export_history(events: DataFrame, path: str | Path) -> int:
    """The stream of transitions as lines of JSON in the order of event_id, in one step; how many there are."""
    lines = [json.dumps(_plain(r), sort_keys=True, default=str) for r in events.orderBy("event_id").toLocalIterator()]
    publish(path, "".join(f"{line}\n" for line in lines))
    return len(lines)


def _records(table: DataFrame) -> list[dict]:
    return [_plain(r) for r in table.orderBy(*[c for c in table.columns if c in ("spec_id", "horizon", "outcome", "part", "fold", "cohort", "value")]).collect()]  # aggregates


def study(found: DataFrame, plan: dict, cost_bps: float, include_holdout: bool = False) -> dict:
    """The tables of ``research.summary`` as a document, with the interval of each outcome by specification and horizon left to ``events.block_bootstrap``."""
    tables = research.summary(found, plan, cost_bps, include_holdout=include_holdout)
    return {"holdout": {"released": include_holdout}, **{n: _records(t) for n, t in tables.items() if n != "events"}}


def backtest_report(path: str | Path, found: DataFrame, plan: dict, config: ScanConfig, cost_bps: float, as_of: int, coverage: dict, include_holdout: bool = False, specs=research.COMPARISON, funding: str | None = None) -> dict:
    """Publish the event study; the holdout is withheld unless it is released."""
    document = {
        "schema_version": BACKTEST, "source_identity": identity(), "as_of": iso(as_of), "bar_interval_seconds": config.step, "round_trip_cost_bps": cost_bps, "calendar_partitions": plan, "effective_config": asdict(config),
        "specifications": [asdict(s) for s in specs], "funding": funding or "not supplied; zero assumption", "coverage": coverage, "results": study(found, plan, cost_bps, include_holdout),
    }
    publish_json(path, document)
    return document


class ReplayMismatch(ValueError):
    pass


def replay_report(path: str | Path, mismatches: DataFrame, scans: int, results: dict | None = None) -> dict:
    """Publish what a replay found, and raise after that if it differs from the archive."""
    found = [_plain(r) for r in mismatches.orderBy("as_of", "spec_id", "symbol").limit(10_000).collect()]
    document = {"schema_version": REPLAY, "audit": {"scans": scans, "mismatch_count": mismatches.count(), "mismatches": found}, "results": results or {}}
    publish_json(path, document)
    if found:
        raise ReplayMismatch(f"{document['audit']['mismatch_count']} observations differ from the archive; see {path}")
    return document
