"""Frozen settings with bounds, and the strict reader of their TOML file; values become literals in plans."""

from __future__ import annotations

import math
import tomllib
from dataclasses import dataclass, field, fields, replace


def count(default: int):
    """A setting that is a whole number from one up."""
    return field(default=default, metadata={"whole": True, "low": 1})


def number(default: float, low: float = -math.inf, high: float = math.inf, open_low: bool = False):
    """A setting that is a finite number between the bounds; ``open_low``: the lower one is not allowed itself."""
    return field(default=default, metadata={"whole": False, "low": low, "high": high, "open": open_low})


class Checked:
    """Checks every field that has bounds, then the rules between fields."""

    def __post_init__(self) -> None:
        for f in fields(self):
            bound, value = f.metadata, getattr(self, f.name)
            if "low" not in bound:
                continue
            kind = int if bound["whole"] else (int, float)
            sound = isinstance(value, kind) and not isinstance(value, bool) and math.isfinite(value)
            if not sound or value < bound["low"] or value > bound.get("high", math.inf) or (bound.get("open") and value == bound["low"]):
                raise ValueError(f"{type(self).__name__}.{f.name} can't be {value!r}")
        for text, holds in self.rules().items():
            if not holds:
                raise ValueError(f"{type(self).__name__}: {text}")

    def rules(self) -> dict[str, bool]:
        return {}


@dataclass(frozen=True)
class StructureConfig(Checked):
    atr_period: int = count(14)
    volatility_period: int = count(20)
    width_history: int = count(120)
    least_width_history: int = count(20)
    #: Daily bars that a point in time looks back on; ATR depends on where it starts.
    history: int = count(140)


@dataclass(frozen=True)
class StrengthConfig(Checked):
    beta_window: int = count(720)
    least_beta_points: int = count(240)
    half_life: int = count(168)
    persistence_window: int = count(24)
    short: int = count(4)
    medium: int = count(24)
    long: int = count(168)
    least_alignment: float = number(0.95, 0, 1, open_low=True)
    least_windows: int = count(60)
    winsor: float = number(6.0, 0, open_low=True)
    least_constituents: int = count(5)

    def rules(self) -> dict[str, bool]:
        return {"horizons must rise": self.short < self.medium < self.long, "beta_window holds least_beta_points": self.beta_window >= self.least_beta_points}

    @classmethod
    def for_interval(cls, seconds: int, **other) -> StrengthConfig:
        """The profile that keeps durations: 30 and 10 days, 24 h, 4 h, 24 h, 7 days, half-life 7 days."""
        bars = lambda hours: max(1, math.ceil(hours * 3600 / seconds))
        return cls(**{"beta_window": bars(720), "least_beta_points": bars(240), "half_life": bars(168), "persistence_window": bars(24), "short": bars(4), "medium": bars(24), "long": bars(168)} | other)

    @property
    def preferred_returns(self) -> int:
        return max(self.beta_window, self.persistence_window, self.long + self.least_windows)

    @property
    def required_returns(self) -> int:
        return max(self.least_beta_points, self.persistence_window, self.long + self.least_windows)


@dataclass(frozen=True)
class DecisionConfig(Checked):
    candidate: float = number(3.5)
    persistence: float = number(0.40, 0, 1)
    early: float = number(2.5, 0, open_low=True)
    strong: float = number(3.0)

    def rules(self) -> dict[str, bool]:
        return {"early <= strong <= candidate": self.early <= self.strong <= self.candidate}


@dataclass(frozen=True)
class LiveConfig(Checked):
    universe_size: int = count(60)
    fast_seconds: float = number(20.0, 0, open_low=True)
    settle_seconds: float = number(30.0, 0)
    bars_window: int = count(722)
    daily_window: int = count(140)
    least_gap: float = number(0.12, 0)


@dataclass(frozen=True)
class ScanConfig(Checked):
    benchmark: str = "BTC"
    step: int = count(3600)
    secondary: str | None = "ETH"
    structure: StructureConfig = StructureConfig()
    strength: StrengthConfig = StrengthConfig()
    decision: DecisionConfig = DecisionConfig()
    live: LiveConfig = LiveConfig()

    def rules(self) -> dict[str, bool]:
        named = lambda x: isinstance(x, str) and bool(x.strip())
        return {"benchmark needs a name": named(self.benchmark), "secondary needs a name, or none": self.secondary is None or named(self.secondary)}


# The sections and keys of the file, and the settings that they mean.
SECTIONS = {
    "scanner": {"benchmark": "benchmark", "interval_seconds": "step"},
    "market_structure": {"atr_period": "atr_period", "realized_vol_period": "volatility_period", "width_history": "width_history", "minimum_width_history": "least_width_history"},
    "relative_strength": {
        "beta_window": "beta_window", "min_beta_points": "least_beta_points", "beta_half_life_bars": "half_life", "persistence_window": "persistence_window", "short_horizon_bars": "short", "medium_horizon_bars": "medium",
        "long_horizon_bars": "long", "min_alignment_ratio": "least_alignment", "min_empirical_windows": "least_windows", "winsor_mad": "winsor", "broad_alt_min_constituents": "least_constituents", "secondary_benchmark": "secondary", "bar_interval_seconds": "step",
    },
    "decision": {"candidate_rs_score": "candidate", "candidate_persistence": "persistence", "early_discovery_score": "early", "strong_discovery_score": "strong"},
    "live": {"universe_size": "universe_size", "fast_interval_seconds": "fast_seconds", "settle_seconds": "settle_seconds", "hourly_window": "bars_window", "daily_window": "daily_window", "min_gap_seconds": "least_gap"},
}
HOUR = 3600


def read_settings(text: str, step: int | None = None) -> ScanConfig:
    """The settings of a TOML text. Unknown sections and keys are errors, and so is another bar size than ``step``, if given."""
    raw = tomllib.loads(text)
    strange = [s for s in raw if s not in SECTIONS] + [f"{s}.{k}" for s, own in raw.items() if s in SECTIONS for k in (own if isinstance(own, dict) else [""]) if k not in SECTIONS[s]]
    if strange:
        raise ValueError(f"settings that don't exist: {', '.join(sorted(strange))}")
    known = {s: {SECTIONS[s][k]: v for k, v in raw.get(s, {}).items()} for s in SECTIONS}
    top, strength = known["scanner"], known["relative_strength"]
    size = top.get("step", step or HOUR)
    if size != (step or size) or strength.pop("step", size) != size:
        raise ValueError(f"bars of {size} seconds don't fit the input's")
    other = {"secondary": strength.pop("secondary")} if "secondary" in strength else {}
    return replace(
        ScanConfig(), **(top | {"step": size}), **other, structure=StructureConfig(**known["market_structure"]), strength=replace(StrengthConfig.for_interval(size), **strength), decision=DecisionConfig(**known["decision"]), live=LiveConfig(**known["live"])
    )


def load_settings(path: str, step: int | None = None) -> ScanConfig:
    with open(path, encoding="utf-8") as f:
        return read_settings(f.read(), step)


#: The two factor models, and the secondary that each takes.
CURRENT, BROAD = "btc_eth", "btc_broad_alt"
BROAD_FACTOR = "BROAD_ALT_L1O"


def for_model(config: ScanConfig, model: str) -> ScanConfig:
    """The settings with a factor model's secondary."""
    secondaries = {CURRENT: "ETH", BROAD: BROAD_FACTOR}
    if model not in secondaries:
        raise ValueError(f"no factor model {model}")
    return replace(config, secondary=secondaries[model])
