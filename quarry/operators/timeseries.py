"""Grouped kernels over whole series: detrended fluctuation, multifractal spectra, wavelets, cross-correlation, recurrence, surrogates.

A series is one group's history, which a task can hold; the number of series is what grows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarry.operators.market import returns
from quarry.registry import query
from quarry.sources.market import daily_bars, hourly_bars

Q = (-4.0, -2.0, 0.0, 2.0, 4.0)


def fluctuations(x: np.ndarray, scales: list[int], q: tuple[float, ...] = Q, order: int = 1) -> np.ndarray:
    """F_q(s): q-th order means of the residual variance of the profile in windows of each scale, from both ends."""
    profile = np.cumsum(x - x.mean())
    out = np.full((len(q), len(scales)), np.nan)
    for j, s in enumerate(scales):
        n = len(profile) // s
        if n < 1 or s <= order + 1:
            continue
        parts = np.concatenate([profile[: n * s].reshape(n, s), profile[len(profile) - n * s :].reshape(n, s)])
        basis = np.vander(np.arange(s) / s, order + 1)
        fit, *_ = np.linalg.lstsq(basis, parts.T, rcond=None)
        variance = np.maximum(((parts.T - basis @ fit) ** 2).mean(axis=0), 1e-300)
        for i, power in enumerate(q):
            out[i, j] = np.exp(0.5 * np.log(variance).mean()) if power == 0 else (variance ** (power / 2)).mean() ** (1 / power)
    return out


def slopes(f: np.ndarray, scales: list[int]) -> np.ndarray:
    """Generalised Hurst exponents: slopes of ln F_q against ln s over the scales that have values."""
    out = []
    for row in f:
        ok = np.isfinite(row) & (row > 0)
        out.append(np.polyfit(np.log(np.array(scales)[ok]), np.log(row[ok]), 1)[0] if ok.sum() >= 2 else np.nan)
    return np.array(out)


def multifractal(x: np.ndarray, scales: list[int], q: tuple[float, ...] = Q) -> dict[str, float]:
    """Hurst exponent (q = 2), spread of exponents, and width and asymmetry of the singularity spectrum."""
    h = slopes(fluctuations(x, scales, q), scales)
    tau = np.array(q) * h - 1
    alpha = np.gradient(tau, np.array(q))
    f = np.array(q) * alpha - tau
    peak = int(np.nanargmax(f)) if np.isfinite(f).any() else 0
    width = float(np.nanmax(alpha) - np.nanmin(alpha)) if np.isfinite(alpha).any() else np.nan
    left, right = alpha[peak] - np.nanmin(alpha), np.nanmax(alpha) - alpha[peak]
    return {"hurst": float(h[list(q).index(2.0)]), "delta_h": float(np.nanmax(h) - np.nanmin(h)), "width": width, "asymmetry": float((left - right) / (left + right)) if left + right > 0 else 0.0}


def rescaled_range(x: np.ndarray, scales: list[int]) -> float:
    """Hurst exponent by rescaled ranges."""
    points = []
    for s in scales:
        n = len(x) // s
        if n < 1:
            continue
        parts = x[: n * s].reshape(n, s)
        walk = np.cumsum(parts - parts.mean(axis=1, keepdims=True), axis=1)
        deviation = parts.std(axis=1)
        ok = deviation > 0
        if ok.any():
            points.append((np.log(s), np.log(((walk.max(axis=1) - walk.min(axis=1))[ok] / deviation[ok]).mean())))
    return float(np.polyfit(*zip(*points, strict=True), 1)[0]) if len(points) >= 2 else np.nan


def haar_energy(x: np.ndarray, levels: int = 4) -> list[float]:
    """Share of the energy in the detail coefficients of each level of a Haar transform."""
    energy, a = [], x.astype(float)
    for _ in range(levels):
        if len(a) < 2:
            energy.append(0.0)
            continue
        a = a[: len(a) // 2 * 2].reshape(-1, 2)
        energy.append(float(((a[:, 0] - a[:, 1]) ** 2 / 2).sum()))
        a = a.sum(axis=1) / np.sqrt(2)
    total = sum(energy)
    return [e / total if total > 0 else 0.0 for e in energy]


def detrended_cross_correlation(x: np.ndarray, y: np.ndarray, s: int) -> float:
    """Correlation of two profiles' residuals in windows of s."""
    n = min(len(x), len(y)) // s
    if n < 1 or s < 4:
        return np.nan
    px, py = np.cumsum(x - x.mean())[: n * s].reshape(n, s), np.cumsum(y - y.mean())[: n * s].reshape(n, s)
    basis = np.vander(np.arange(s) / s, 2)
    rx, ry = (p.T - basis @ np.linalg.lstsq(basis, p.T, rcond=None)[0] for p in (px, py))
    below = np.sqrt((rx**2).mean() * (ry**2).mean())
    return float((rx * ry).mean() / below) if below > 0 else 0.0


def recurrence_rate(x: np.ndarray, epsilon: float) -> float:
    """Share of pairs of values, each with itself too, that are within epsilon; by sorting, not over all pairs."""
    s = np.sort(x)
    within = np.searchsorted(s, s + epsilon, side="right") - np.searchsorted(s, s - epsilon, side="left")
    return float(within.sum() / len(s) ** 2) if len(s) else 0.0


def histogram_entropy(x: np.ndarray, bins: int = 4) -> float:
    """Entropy in bits of the histogram over equal bins."""
    counts, _ = np.histogram(x, bins)
    p = counts[counts > 0] / max(1, counts.sum())
    return float(-(p * np.log2(p)).sum())


def surrogate(x: np.ndarray, seed: int, kind: str = "shuffle") -> np.ndarray:
    """A shuffled series, or one of the same spectrum with random phases."""
    rng = np.random.default_rng(seed)
    if kind == "shuffle":
        return rng.permutation(x)
    f = np.fft.rfft(x)
    phases = np.exp(2j * np.pi * rng.random(len(f)))
    phases[0] = 1
    if len(x) % 2 == 0:
        phases[-1] = 1
    return np.fft.irfft(f * phases, len(x))


def binomial_cascade(levels: int, p: float) -> np.ndarray:
    """A multiplicative cascade of 2**levels values; its spectrum is wide unless p is one half."""
    x = np.ones(1)
    for _ in range(levels):
        x = np.stack([x * p, x * (1 - p)], axis=1).ravel()
    return x


def series_features(r: DataFrame, value: str, scales: list[int] | None = None) -> DataFrame:
    """One row per symbol: multifractal measures, rescaled range, wavelet energies, entropy and recurrence of its series by ts.

    Nulls are left out. Series shorter than twice the largest scale have null exponents.
    """
    scales = scales or [8, 16, 32, 64]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("ts")[value].dropna().to_numpy(float)
        row: dict[str, object] = {"symbol": g["symbol"].iloc[0], "n": len(x)}
        enough = len(x) >= 2 * max(scales)
        m = multifractal(x, scales) if enough else dict.fromkeys(("hurst", "delta_h", "width", "asymmetry"))
        row |= m | {"rescaled_range": rescaled_range(x, scales) if enough else None, "entropy": histogram_entropy(x) if len(x) else None}
        row |= {f"energy_{i + 1}": e for i, e in enumerate(haar_energy(x))} | {"recurrence": recurrence_rate(x, 0.1 * float(x.std())) if len(x) else None}
        return pd.DataFrame([row])

    schema = "symbol string, n long, hurst double, delta_h double, width double, asymmetry double, rescaled_range double, entropy double, energy_1 double, energy_2 double, energy_3 double, energy_4 double, recurrence double"
    return r.select("symbol", "ts", value).groupBy("symbol").applyInPandas(one, schema)


@query("series_features")
def _features(spark, sf):
    return series_features(returns(hourly_bars(spark, sf)), "log_return")


def rolling_exponents(r: DataFrame, value: str, size: int = 128, step: int = 32) -> DataFrame:
    """Hurst exponents of windows of `size` values every `step` values, per symbol."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts").dropna()
        x, ts = g[value].to_numpy(float), g["ts"].to_numpy()
        at = range(0, len(x) - size + 1, step)
        if not at:
            return pd.DataFrame()
        return pd.DataFrame({"symbol": [g["symbol"].iloc[0]] * len(at), "ts": [ts[i + size - 1] for i in at], "hurst": [float(slopes(fluctuations(x[i : i + size], [8, 16, 32], (2.0,)), [8, 16, 32])[0]) for i in at]})

    return r.select("symbol", "ts", value).groupBy("symbol").applyInPandas(one, "symbol string, ts timestamp_ntz, hurst double")


@query("rolling_exponents")
def _rolling(spark, sf):
    return rolling_exponents(returns(daily_bars(spark, sf)), "log_return")


# more kernels


def moving_average_fluctuations(x: np.ndarray, scales: list[int], q: tuple[float, ...] = Q, place: float = 0.0) -> np.ndarray:
    """F_q(s) of the profile less its moving average; `place` 0 takes the average backward, 0.5 centred, 1 forward."""
    profile = np.cumsum(x - x.mean())
    out = np.full((len(q), len(scales)), np.nan)
    for j, s in enumerate(scales):
        if s < 2 or len(profile) < 2 * s:
            continue
        average = np.convolve(profile, np.ones(s) / s, "valid")
        first = int(round((s - 1) * (1 - place)))
        rest = profile[first : first + len(average)] - average
        n = len(rest) // s
        variance = np.maximum(rest[: n * s].reshape(n, s).var(axis=1), 1e-300)
        for i, power in enumerate(q):
            out[i, j] = np.exp(0.5 * np.log(variance).mean()) if power == 0 else (variance ** (power / 2)).mean() ** (1 / power)
    return out


def cross_fluctuations(x: np.ndarray, y: np.ndarray, scales: list[int], q: tuple[float, ...] = Q, order: int = 1) -> np.ndarray:
    """F_q(s) of two series: q-th order means of the absolute covariance of their windows' residuals; the windows are not summed up first."""
    n_all = min(len(x), len(y))
    out = np.full((len(q), len(scales)), np.nan)
    for j, s in enumerate(scales):
        n = n_all // s
        if n < 1 or s <= order + 1:
            continue
        basis = np.vander(np.arange(s) / s, order + 1)
        rests = []
        for z in (x, y):
            parts = z[: n * s].reshape(n, s).T
            rests.append(parts - basis @ np.linalg.lstsq(basis, parts, rcond=None)[0])
        covariance = np.maximum(np.abs((rests[0] * rests[1]).mean(axis=0)), 1e-300)
        for i, power in enumerate(q):
            out[i, j] = np.exp(0.5 * np.log(covariance).mean()) if power == 0 else (covariance ** (power / 2)).mean() ** (1 / power)
    return out


def partition_function(measure: np.ndarray, sizes: list[int], q: tuple[float, ...] = Q) -> np.ndarray:
    """Sums of q-th powers of the masses of boxes; q = 0 counts boxes with mass, q = 1 is the exponential of minus the entropy."""
    mass = np.abs(measure) / max(np.abs(measure).sum(), 1e-300)
    out = np.full((len(q), len(sizes)), np.nan)
    for j, s in enumerate(sizes):
        n = len(mass) // s
        if n < 1:
            continue
        p = mass[: n * s].reshape(n, s).sum(axis=1)
        p = p[p > 0]
        for i, power in enumerate(q):
            out[i, j] = len(p) if power == 0 else np.exp((p * np.log(p)).sum()) if power == 1 else (p**power).sum()
    return out


def robust_slope(x: np.ndarray, y: np.ndarray) -> float:
    """Theil-Sen slope: the median of the slopes between all points of a short list of scales."""
    i, j = np.triu_indices(len(x), 1)
    ok = x[i] != x[j]
    return float(np.median((y[j] - y[i])[ok] / (x[j] - x[i])[ok])) if ok.any() else np.nan


def generalized_hurst(x: np.ndarray, q: float = 2.0, lags: range = range(1, 6)) -> float:
    """Slope of the q-th moments of increments against the lag, over q, cut to 0 to 1.5."""
    walk = np.cumsum(x)
    moments = [np.mean(np.abs(walk[k:] - walk[:-k]) ** q) for k in lags if len(walk) > k]
    if len(moments) < 2 or min(moments) <= 0:
        return 0.0
    return float(np.clip(np.polyfit(np.log(list(lags)[: len(moments)]), np.log(moments), 1)[0] / q, 0.0, 1.5))


def circular_autocorrelation(x: np.ndarray) -> float:
    """Correlation of each value with the next, the last with the first."""
    d = x - x.mean()
    below = (d * d).sum()
    return float((d * np.roll(d, -1)).sum() / below) if below > 0 else 0.0


def block_shuffle(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    blocks = [x[i : i + size] for i in range(0, len(x), size)]
    return np.concatenate([blocks[i] for i in np.random.default_rng(seed).permutation(len(blocks))]) if blocks else x


def amplitude_adjusted_surrogate(x: np.ndarray, seed: int, rounds: int = 10) -> np.ndarray:
    """A series with the values of x and about its spectrum: phases of the shuffled series, values by rank, in turns."""
    ordered, size = np.sort(x), np.abs(np.fft.rfft(x))
    out = np.random.default_rng(seed).permutation(x)
    for _ in range(rounds):
        f = np.fft.rfft(out)
        out = ordered[np.argsort(np.argsort(np.fft.irfft(size * np.exp(1j * np.angle(f)), len(x)), kind="stable"), kind="stable")]
    return out


def bootstrap_interval(x: np.ndarray, statistic, count: int, level: float, seed: int, block: int = 16) -> tuple[float, float]:
    """Interval of a statistic over series made of blocks drawn with replacement."""
    rng = np.random.default_rng(seed)
    n = -(-len(x) // block)
    values = [statistic(np.concatenate([x[i : i + block] for i in rng.integers(0, max(1, len(x) - block + 1), n)])[: len(x)]) for _ in range(count)]
    return tuple(float(v) for v in np.quantile(values, [(1 - level) / 2, (1 + level) / 2]))


def simulate(kind: str, n: int, seed: int, scale: float = 0.01, strength: float = 0.3) -> np.ndarray:
    """Returns of a model: gaussian, mrw (noise times the exponential of a slow process), msm (switching volatility components), mmar (noise in cascade time)."""
    rng = np.random.default_rng(seed)
    noise = rng.normal(size=n)
    if kind == "gaussian":
        return scale * noise
    if kind == "mrw":
        slow = np.zeros(n)
        for i, e in enumerate(rng.normal(size=n)):
            slow[i] = (0.98 * slow[i - 1] if i else 0.0) + strength * 0.2 * e
        return scale * np.exp(slow - slow.var()) * noise
    if kind == "msm":
        volatility = np.ones(n)
        for k in range(5):
            switches = np.cumsum(rng.random(n) < min(1.0, 0.5 / 2**k))
            volatility *= rng.choice([1 - strength, 1 + strength], switches[-1] + 1)[switches]
        return scale * np.sqrt(volatility) * noise
    if kind == "mmar":
        time = binomial_cascade(int(np.ceil(np.log2(max(n, 2)))), 0.5 - strength / 2)[:n]
        return scale * np.sqrt(time / time.mean()) * noise
    raise ValueError(f"no model {kind}")


def compare_with_surrogates(x: np.ndarray, scales: list[int], seed: int, count: int = 5) -> dict[str, float]:
    """Spectrum widths of a series, of its shuffles, of a surrogate of equal values and spectrum, and of its clipped values."""
    width = lambda z: multifractal(z, scales)["width"]
    low, high = np.quantile(x, [0.01, 0.99])
    return {"width": width(x), "shuffled": float(np.mean([width(surrogate(x, seed + i)) for i in range(count)])), "adjusted": width(amplitude_adjusted_surrogate(x, seed)), "clipped": width(np.clip(x, low, high))}


@query("series_surrogates")
def _surrogates(spark, sf):
    def one(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values("ts")["log_return"].dropna().to_numpy(float)
        return pd.DataFrame([{"symbol": g["symbol"].iloc[0], **compare_with_surrogates(x, [8, 16, 32], 1)}]) if len(x) >= 64 else pd.DataFrame()

    r = returns(hourly_bars(spark, sf)).select("symbol", "ts", "log_return")
    return r.groupBy("symbol").applyInPandas(one, "symbol string, width double, shuffled double, adjusted double, clipped double")


# scales, checks and forecasts


def scale_grid(length: int, lowest: int | None = None, highest: int | None = None, count: int = 12, order: int = 1, segments: int = 4) -> list[int]:
    """Distinct whole scales, evenly spaced by their logarithm, that leave `segments` windows of a series of that length."""
    low = lowest or max(8, order + 3)
    high = highest or max(low, length // segments)
    if not 0 < low <= high <= length or count < 1:
        raise ValueError(f"no scales from {low} to {high} for a series of {length}")
    if low == high or count == 1:
        return [low]
    return sorted({min(high, max(low, round(low * (high / low) ** (i / (count - 1))))) for i in range(count)})


def scaling_diagnostic(points: list[tuple[int, float]], robust: bool = False, lowest: int | None = None, highest: int | None = None, least: int = 3) -> dict[str, float]:
    """Slope, intercept and fit of the logarithm of a fluctuation against that of the scale, by least squares or Theil-Sen; points without a positive finite value are left out."""
    kept = sorted((s, v) for s, v in points if s > 0 and np.isfinite(v) and v > 0 and (lowest is None or s >= lowest) and (highest is None or s <= highest))
    if len(kept) < least:
        raise ValueError(f"{len(kept)} scales; {least} are needed")
    x, y = (np.log(np.array(c, float)) for c in zip(*kept, strict=True))
    slope = robust_slope(x, y) if robust else float(np.polyfit(x, y, 1)[0])
    intercept = float(np.median(y - slope * x)) if robust else float(y.mean() - slope * x.mean())
    total = float(((y - y.mean()) ** 2).sum())
    rest = float(((y - slope * x - intercept) ** 2).sum())
    return {"slope": slope, "intercept": intercept, "r2": 1 - rest / total if total > 0 else 1.0, "scales": len(kept), "lowest": kept[0][0], "highest": kept[-1][0]}


def finite_size_check(x: np.ndarray, scales: list[int], seed: int, count: int = 10, short: int = 512) -> dict[str, float]:
    """Spectrum width and Hurst exponent of a series beside the mean and deviation of those of Gaussian series of its length, mean and deviation; `bias` is the width's excess."""
    rng = np.random.default_rng(seed)
    own = multifractal(x, scales)
    controls = [multifractal(rng.normal(x.mean(), x.std() or 1.0, len(x)), scales) for _ in range(count)]
    out = {"n": len(x), "is_short": float(len(x) < short)}
    for k in ("width", "hurst"):
        v = np.array([c[k] for c in controls])
        out |= {k: own[k], f"{k}_control": float(v.mean()), f"{k}_deviation": float(v.std())}
    return out | {"bias": out["width"] - out["width_control"]}


def extreme_sensitivity(x: np.ndarray, scales: list[int], low: float = 0.05, high: float = 0.95, method: str = "winsorized") -> dict[str, float]:
    """Spectrum of a series, of the same with its extremes cut to quantiles (or left out), and the mean distance of their measures."""
    a, b = np.quantile(x, [low, high])
    if method not in ("winsorized", "trimmed"):
        raise ValueError(f"no method {method}")
    changed = np.clip(x, a, b) if method == "winsorized" else x[(x >= a) & (x <= b)]
    own, other = multifractal(x, scales), multifractal(changed, scales)
    keys = ("hurst", "width", "asymmetry")
    return {"n": len(changed), **{k: own[k] for k in keys}, **{f"{k}_changed": other[k] for k in keys}, "sensitivity": float(np.mean([abs(own[k] - other[k]) for k in keys]))}


def switching_volatility(steps: int, seed: int, base: float = 0.01, components: int = 4, switch: float = 0.1, low: float = 0.7, high: float = 1.3) -> np.ndarray:
    """Volatility of a product of components that are low or high and are drawn anew with a probability at each step."""
    rng = np.random.default_rng(seed)
    state = rng.integers(0, 2, components)
    out = np.empty(steps)
    for i in range(steps):
        drawn = rng.random(components) < switch
        state = np.where(drawn, rng.integers(0, 2, components), state)
        out[i] = base * np.sqrt(np.prod(np.where(state == 1, high, low)))
    return out


def volatility_forecast(horizon: int, paths: int, seed: int, **parameters: float) -> dict[str, float]:
    """Mean and 5, 50 and 95 % quantiles of the volatility at the horizon, over paths with seeds from `seed` on."""
    last = np.array([switching_volatility(horizon, seed + i, **parameters)[-1] for i in range(paths)])
    return {"mean": float(last.mean()), **dict(zip(("p05", "p50", "p95"), (float(v) for v in np.quantile(last, [0.05, 0.5, 0.95])), strict=True))}


def modes(x: np.ndarray) -> dict[str, object]:
    """Energies of a series' empirical modes, by the optional library PyEMD; without it the series is its one mode, and the result says so."""
    try:
        from PyEMD import EMD
    except ImportError:
        parts, missing = [np.asarray(x, float)], "PyEMD"
    else:
        parts, missing = list(EMD().emd(np.asarray(x, float))), ""
    whole = np.sum(parts, axis=0) if len(x) else np.zeros(0)
    return {"components": parts, "energies": [float((p * p).sum()) for p in parts], "error": float(np.abs(whole - x).max()) if len(x) else 0.0, "missing": missing}


def shuffled_training(values: list, train: list[int], seed: int = 0, kind: str = "all", patch: int = 4) -> list:
    """The values with those at the places of training in another order, all or whole patches of them (in reverse); no other value moves."""
    own = [values[i] for i in train]
    if kind == "all":
        own = [own[i] for i in np.random.default_rng(seed).permutation(len(own))]
    elif kind == "patches":
        own = [v for i in reversed(range(0, len(own), max(1, patch))) for v in own[i : i + max(1, patch)]]
    elif kind != "none":
        raise ValueError(f"no shuffle {kind}")
    out = list(values)
    for i, v in zip(train, own, strict=True):
        out[i] = v
    return out


def book_spectra(book: DataFrame, scales: list[int]) -> DataFrame:
    """Per symbol of `book_series` rows: Hurst exponents and spectrum widths of spread and imbalance, the scaling of the waiting
    times' partition sums at q = 2, and the exponent of the depths' common fluctuations; null for series shorter than two of the largest windows."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["ts", "seq", "spread", "bid_depth", "ask_depth"])
        row: dict[str, object] = {"symbol": g["symbol"].iloc[0], "n": len(g)}
        names = ["spread_hurst", "spread_width", "imbalance_hurst", "imbalance_width", "waiting_slope", "depth_exponent"]
        if len(g) < 2 * max(scales):
            return pd.DataFrame([row | dict.fromkeys(names)])
        for c in ("spread", "imbalance"):
            m = multifractal(g[c].to_numpy(float), scales)
            row |= {f"{c}_hurst": m["hurst"], f"{c}_width": m["width"]}
        sums = partition_function(g["seconds"].to_numpy(float), scales, (2.0,))[0]
        depth = cross_fluctuations(g["bid_depth"].to_numpy(float), g["ask_depth"].to_numpy(float), scales, (2.0,))
        return pd.DataFrame([row | {"waiting_slope": scaling_diagnostic(list(zip(scales, sums, strict=True)), least=2)["slope"], "depth_exponent": float(slopes(depth, scales)[0])}])

    schema = "symbol string, n long, spread_hurst double, spread_width double, imbalance_hurst double, imbalance_width double, waiting_slope double, depth_exponent double"
    return book.groupBy("symbol").applyInPandas(one, schema)


@query("book_spectra")
def _book_spectra(spark, sf):
    from quarry.operators.relations import book_series
    from quarry.sources.market import book_depths, book_rows

    return book_spectra(book_series(book_depths(book_rows(spark, sf))), [8, 16, 32, 64])
