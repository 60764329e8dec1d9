"""The scores of one stretch of a symbol's bars, for many bars at once, over arrays.

A bar's look-back is a row of a matrix; medians, winsorising and weighted moments are
taken for all rows together. Medians of sliding windows have no form in built-in
functions that doesn't copy each window into each row, so this runs as grouped Arrow
batches (see ``strength.evaluated``, which bounds a group).
"""

from __future__ import annotations

import numpy as np

from lodestar.config import StrengthConfig

TINY = 1e-12
SMALL = 1e-18
#: Rows of a matrix that are worked on together.
ROWS = 64
HORIZONS = ("short", "medium", "long")
FIGURES = (
    "g_beta", "beta", "alpha", "beta_2", "n_eff", "residual_volatility", "r_squared", "beta_error", "beta_2_error",
    *(f"{k}_{h}" for h in HORIZONS for k in ("z", "sum", "pct")), "persistence", "acceleration", "raw_score", "raw_discovery", "score", "discovery",
)


def location_scale(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and 1.4826 times the median absolute deviation of each row; the plain deviation where that vanishes."""
    middle = np.median(x, axis=1)
    scale = 1.4826 * np.median(np.abs(x - middle[:, None]), axis=1)
    flat = scale <= TINY
    if flat.any() and x.shape[1] >= 2:
        scale[flat] = x[flat].std(axis=1)
    return middle, scale


def winsorized(x: np.ndarray, limit: float) -> np.ndarray:
    middle, scale = location_scale(x)
    reach = np.where(scale <= TINY, np.inf, limit * scale)
    return np.clip(x, (middle - reach)[:, None], (middle + reach)[:, None])


def weights(n: int, half_life: int) -> np.ndarray:
    raw = 0.5 ** ((n - 1 - np.arange(n)) / half_life)
    return raw / raw.sum()


def factor_model(y: np.ndarray, x: np.ndarray, z: np.ndarray | None, w: np.ndarray, limit: float) -> dict[str, np.ndarray]:
    """Coefficients from winsorised inputs, diagnostics from the raw ones; NaN where there is none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        centred = lambda v: (v - (v @ w)[:, None], v @ w)
        (yc, my), (xc, mx) = centred(winsorized(y, limit)), centred(winsorized(x, limit))
        vx, cxy = (xc * xc) @ w, (xc * yc) @ w
        beta, beta_2, mz = cxy / vx, np.full(len(y), np.nan), np.zeros(len(y))
        vz = det = np.full(len(y), np.nan)
        if z is not None:
            zc, mz = centred(winsorized(z, limit))
            vz, cxz, czy = (zc * zc) @ w, (xc * zc) @ w, (zc * yc) @ w
            det = vx * vz - cxz * cxz
            two = det > SMALL
            beta = np.where(two, (cxy * vz - czy * cxz) / det, beta)
            beta_2 = np.where(two, (czy * vx - cxy * cxz) / det, np.nan)
        known = vx > SMALL
        beta, beta_2 = np.where(known, beta, np.nan), np.where(known, beta_2, np.nan)
        second = np.nan_to_num(beta_2)
        alpha = my - beta * mx - second * mz
        rest = y - alpha[:, None] - beta[:, None] * x - (second[:, None] * z if z is not None else 0.0)
        cut = winsorized(rest, limit)
        variance = np.maximum(0.0, ((cut - (cut @ w)[:, None]) ** 2) @ w)
        spread = ((y - (y @ w)[:, None]) ** 2) @ w
        n_eff = np.full(len(y), 1 / (w * w).sum())
        floored = lambda v: np.maximum(v, SMALL)
        fit = np.where(spread > SMALL, np.clip(1 - ((rest * rest) @ w) / spread, 0, 1), np.where(known, 0.0, np.nan))
        error = np.where(np.isnan(beta_2), np.sqrt(variance / floored(n_eff * vx)), np.sqrt(variance * vz / floored(n_eff * det)))
        error_2 = np.where(np.isnan(beta_2), np.nan, np.sqrt(variance * vx / floored(n_eff * det)))
    return {"beta": beta, "alpha": alpha, "beta_2": beta_2, "n_eff": n_eff, "residual_volatility": np.sqrt(variance), "r_squared": fit, "beta_error": error, "beta_2_error": error_2}


def horizon(rest: np.ndarray, bars: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z, sum and percentile of the last ``bars`` residuals against all earlier windows of that length, by prefix sums."""
    k, n = rest.shape
    if n < bars + least:
        return (np.full(k, np.nan),) * 3
    sums = np.concatenate([np.zeros((k, 1)), np.cumsum(rest, axis=1)], axis=1)
    windows = sums[:, bars:] - sums[:, :-bars]
    now, past = windows[:, -1], windows[:, :-1]
    scale = location_scale(past)[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(scale <= TINY, np.where(np.abs(now) <= TINY, 0.0, np.nan), now / scale)
    below, level = (past < now[:, None]).sum(axis=1), (past == now[:, None]).sum(axis=1)
    return z, now, (below + 0.5 * level) / past.shape[1]


def persistence(rest: np.ndarray, window: int) -> np.ndarray:
    last = rest[:, -window:]
    moved = np.abs(last) > 1e-15
    n = moved.sum(axis=1)
    signs = (np.sign(last) * moved).sum(axis=1)
    return np.where(n >= max(4, window // 3), signs / np.maximum(n, 1), np.nan)


def acceleration(rest: np.ndarray, short: int, medium: int, volatility: np.ndarray) -> np.ndarray:
    if rest.shape[1] < medium:
        return np.full(len(rest), np.nan)
    shift = rest[:, -short:].mean(axis=1) - rest[:, -medium:-short].mean(axis=1)
    scale = volatility * (1 / short + 1 / (medium - short)) ** 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale <= TINY, np.where(np.abs(shift) <= TINY, 0.0, np.nan), shift / scale)


def windows_scored(ra: np.ndarray, rb: np.ndarray, rs: np.ndarray | None, config: StrengthConfig) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """All figures of look-backs given as rows, and their residuals; rs: the secondary's returns, or None."""
    w = weights(min(config.beta_window, ra.shape[1]), config.half_life)
    tail = lambda x: x[:, -len(w) :]
    rest_of, g = None, np.full(len(ra), np.nan)
    if rs is not None:  # the part of the secondary that the benchmark doesn't explain, over this symbol's own window
        g = factor_model(tail(rs), tail(rb), None, w, config.winsor)["beta"]
        rest_of = rs - np.nan_to_num(g)[:, None] * rb
    out = factor_model(tail(ra), tail(rb), None if rest_of is None else tail(rest_of), w, config.winsor)
    if rest_of is not None and np.isnan(g).any():  # without that part the model has one factor
        alone = np.isnan(g)
        for name, value in factor_model(tail(ra[alone]), tail(rb[alone]), None, w, config.winsor).items():
            out[name][alone] = value
    out["g_beta"] = g
    rest = ra - out["beta"][:, None] * rb
    if rest_of is not None:
        rest = rest - np.nan_to_num(out["beta_2"])[:, None] * rest_of
    for name, bars in zip(HORIZONS, (config.short, config.medium, config.long)):
        out[f"z_{name}"], out[f"sum_{name}"], out[f"pct_{name}"] = horizon(rest, bars, config.least_windows)
    out["persistence"] = persistence(rest, config.persistence_window)
    out["acceleration"] = acceleration(rest, config.short, config.medium, out["residual_volatility"])
    third = lambda v: np.clip(v / 3, -1, 1)
    parts = 0.15 * third(out["z_short"]) + 0.35 * third(out["z_medium"]) + 0.30 * third(out["z_long"]) + 0.05 * third(out["acceleration"])
    out["raw_score"] = np.clip(10 * (parts + 0.15 * np.clip(out["persistence"], -1, 1)), -10, 10)
    out["raw_discovery"] = np.clip(10 * parts / 0.85, -10, 10)
    for name in ("score", "discovery"):  # to two places, ties to even on the exact binary value
        out[name] = np.array([round(v, 2) if v == v else np.nan for v in out[f"raw_{name}"].tolist()])
    return out, rest


def run_scored(ra: np.ndarray, rb: np.ndarray, rs: np.ndarray, wanted: np.ndarray, config: StrengthConfig) -> tuple[dict[str, np.ndarray], list[np.ndarray | None]]:
    """Figures at the wanted places of an unbroken run of returns; NaN, and no residuals, where the history is too short. rs may have NaN."""
    most, least = config.preferred_returns, config.required_returns
    figures = {name: np.full(len(wanted), np.nan) for name in FIGURES}
    residuals: list[np.ndarray | None] = [None] * len(wanted)
    gaps = np.concatenate([[0], np.cumsum(np.isnan(rs))])
    size = np.minimum(wanted + 1, most)
    whole = gaps[wanted + 1] - gaps[wanted + 1 - size] == 0
    # Rows of one length, with or without the secondary, are worked on together.
    order = np.lexsort((wanted, whole, size))
    order = order[size[order] >= least]
    cuts = np.nonzero((np.diff(size[order]) != 0) | (np.diff(whole[order]) != 0))[0] + 1
    for group in np.split(order, cuts) if len(order) else []:
        n, two = int(size[group[0]]), bool(whole[group[0]])
        for a in range(0, len(group), ROWS):
            some = group[a : a + ROWS]
            first = wanted[some] - n + 1
            cut = lambda x: np.lib.stride_tricks.sliding_window_view(x, n)[first]  # noqa: E731, B023
            found, rest = windows_scored(cut(ra), cut(rb), cut(rs) if two else None, config)
            for name in FIGURES:
                figures[name][some] = found[name]
            for i, r in zip(some.tolist(), rest):
                residuals[i] = r
    return figures, residuals
