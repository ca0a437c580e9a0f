"""Forecasters fitted per series in grouped pandas functions: Theta, ETS, seasonal AR; detectors."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.series import BacktestError

SEASON = 12
#: Suffix windows of daily series, in days.
WEEKS = tuple(range(14, 57, 7))


def naive(y: np.ndarray, h: int, sp: int = SEASON) -> np.ndarray:
    return np.array([y[len(y) - sp + i % sp] for i in range(h)])


def theta(y: np.ndarray, h: int, sp: int = SEASON) -> np.ndarray:
    """Standard theta: multiplicative deseasonalisation, SES with an estimated first level, half the trend's slope as drift."""
    n = len(y)
    season = np.ones(sp)
    if n >= 2 * sp and (y > 0).all():
        half = sp // 2
        kernel = np.r_[0.5, np.ones(sp - 1), 0.5] / sp if sp % 2 == 0 else np.ones(sp) / sp
        trend = np.convolve(y, kernel, mode="valid")
        ratio = y[half : half + len(trend)] / trend
        at = (np.arange(half, half + len(trend))) % sp
        season = np.array([ratio[at == k].mean() for k in range(sp)])
        season /= season.mean()
    x = y / season[np.arange(n) % sp]
    slope = np.polyfit(np.arange(n), x, 1)[0]
    ses = fit_ets(x, SES, sp)
    a, level = ses["p"][0], ses["state"][0]
    steps = np.arange(h)
    drift = slope / 2 * (steps + (1 - (1 - a) ** n) / a)
    return (level + drift) * season[(n + steps) % sp]


ETS_SPECS = [
    (e, t, d, s)
    for e, (t, d), s in itertools.product("AM", (("N", False), ("A", False), ("A", True)), "NAM")
    if not (e == "A" and s == "M")
]


#: Simple exponential smoothing as a specification.
SES = ("A", "N", False, "N")
#: Bounds of the weight, of the trend's and the season's weight as shares of what the first leaves them, and of damping.
LOW, HIGH = np.array([1e-4, 1e-4, 1e-4, 0.8]), np.array([0.9999, 0.9999, 0.9999, 0.98])
#: Steps of a fit; one that still gains more than SETTLED a step then has not converged.
STEPS, SETTLED = 60, 1e-3


def _ets_pass(y, spec, sp, smooth, state):
    """The state recursion of many candidates (rows) at once: errors, one-step means, last states.

    smooth has the columns alpha, beta, gamma, phi; state has level, trend and the season from the first point on.
    """
    e, t, _, s = spec
    alpha, beta, gamma, phi = smooth.T
    level, trend, season = state[:, 0].copy(), state[:, 1].copy(), state[:, 2:].T.copy()
    errors, means = np.empty((len(y), len(state))), np.empty((len(y), len(state)))
    for i, v in enumerate(y):
        base = level + phi * trend if t == "A" else level
        c = season[i % sp]
        mu = base + c if s == "A" else base * c if s == "M" else base
        err = v - mu
        means[i], errors[i] = mu, err
        scaled = err / c if s == "M" else err
        level = base + alpha * scaled
        if t == "A":
            trend = phi * trend + beta * scaled
        if s != "N":
            season[i % sp] = c + gamma * (err if s == "A" else err / base)
    if e == "M":
        errors = errors / means
    return errors.T, means.T, np.column_stack([level, trend, season.T])


def _first_states(y, spec, sp):
    """Level, trend and season to begin a search with: means of the first seasons."""
    _, t, _, s = spec
    n = len(y)
    level = y[: sp if s != "N" else min(n, 10)].mean()
    trend = (y[sp : 2 * sp].mean() - y[:sp].mean()) / sp if n >= 2 * sp and t == "A" else 0.0
    if s == "N":
        return level, trend, np.zeros(sp)
    table = y[: n // sp * sp].reshape(-1, sp)
    mean = table.mean(1, keepdims=True)
    season = (table - mean).mean(0) if s == "A" else (table / mean).mean(0)
    return level, trend, season


def fit_ets(y: np.ndarray, spec, sp: int = SEASON) -> dict | None:
    """Weights and first states of greatest likelihood; None if the model does not apply, fit or converge.

    With errors scaled by the geometric mean of the one-step means (multiplicative errors) the likelihood is a sum of
    squares: damped Gauss-Newton steps, their derivatives and trial steps each one pass over all candidates, from
    the two best points of a grid. The season's last state follows from the others (sum 0, or mean 1); k counts
    it all the same, and the variance of the errors.
    """
    e, t, damped, s = spec
    n = len(y)
    if s != "N" and n < 2 * sp or (e == "M" or s == "M") and (y <= 0).any():
        return None
    unit = float(np.abs(y).mean()) or 1.0
    level, trend, season = _first_states(y, spec, sp)
    used = np.array([True, t == "A", s != "N", damped])
    weights, n_season = int(used.sum()), sp - 1 if s != "N" else 0
    low = np.r_[LOW[used], np.full(1 + (t == "A") + n_season, -np.inf)]
    high = np.r_[HIGH[used], np.full(1 + (t == "A") + n_season, np.inf)]

    def spread(x):
        """Rows of free values to weights and first states."""
        w = np.tile([0.0, 0.0, 0.0, 1.0], (len(x), 1))
        w[:, used] = x[:, :weights]
        smooth = np.column_stack([w[:, 0], w[:, 1] * w[:, 0], w[:, 2] * (1 - w[:, 0]), w[:, 3]])
        state = np.zeros((len(x), 2 + sp))
        state[:, 0] = x[:, weights] * unit
        if t == "A":
            state[:, 1] = x[:, weights + 1] * unit
        if s != "N":
            free = x[:, x.shape[1] - n_season :] * (unit if s == "A" else 1.0)
            state[:, 2:] = np.column_stack([free, (0.0 if s == "A" else sp) - free.sum(1)])
        return smooth, state

    def residuals(x):
        """Scaled errors of rows of free values, and n times the logarithm of their mean square; inf where invalid."""
        with np.errstate(all="ignore"):
            errors, means, _ = _ets_pass(y, spec, sp, *spread(x))
            if e == "M":
                errors = np.where((means > 0).all(1, keepdims=True), errors * np.exp(np.log(np.abs(means)).mean(1, keepdims=True)), np.inf)
            square = (errors**2).sum(1)
            return errors, np.where(np.isfinite(square), n * np.log(np.maximum(square, 1e-300) / n), np.inf)

    def settle(x, r, f):
        damping = 1e-2
        for _ in range(STEPS):
            h = 1e-6 * np.maximum(1.0, np.abs(x)) * np.where(x >= high - 1e-5, -1, 1)
            moved, _ = residuals(x + np.diag(h))
            with np.errstate(all="ignore"):
                jac = (moved - r) / h[:, None]
            jac[~np.isfinite(jac).all(1)] = 0
            slope = jac @ r
            jac[(x <= low) & (slope > 0) | (x >= high) & (slope < 0)] = 0  # held at its bound
            gram = jac @ jac.T
            scale = np.diag(np.maximum(np.diag(gram), max(1e-9 * np.diag(gram).max(), 1e-200)))
            tries = damping * 10.0 ** np.arange(-2, 5)
            trial = np.clip(x - np.linalg.solve(gram + tries[:, None, None] * scale, np.tile((jac @ r)[:, None], (len(tries), 1, 1)))[..., 0], low, high)
            rows, values = residuals(trial)
            k = int(np.argmin(values))
            gain = f - values[k]
            if gain > 0:
                x, r, f, damping = trial[k], rows[k], values[k], min(max(tries[k], 1e-9), 1e6)
            if gain <= 1e-5:
                return x, r, f, True
        return x, r, f, gain <= SETTLED

    grid = list(itertools.product((0.05, 0.3, 0.7), (0.05, 0.3) if t == "A" else (0.0,), (0.02, 0.1, 0.4) if s != "N" else (0.0,), (0.9, 0.97) if damped else (1.0,)))
    first = np.r_[level / unit, [trend / unit] * (t == "A"), season[: n_season] / (unit if s == "A" else 1.0)]
    starts = np.array([np.r_[np.array(p)[used], first] for p in grid])
    rows, values = residuals(starts)
    ends = [settle(starts[k], rows[k], values[k]) for k in np.argsort(values, kind="stable")[:2] if np.isfinite(values[k])]
    ends = [end for end in ends if end[3]]
    if not ends:
        return None
    x, _, f, _ = min(ends, key=lambda end: end[2])
    smooth, state = spread(x[None])
    last = _ets_pass(y, spec, sp, smooth, state)[2][0]
    if not np.isfinite(last).all() or s == "M" and (last[2:] <= 0).any():
        return None
    k = weights + 1 + (t == "A") + (sp if s != "N" else 0) + 1
    aic = float(f) + 2 * k
    return {
        "spec": spec, "aic": aic, "aicc": aic + 2 * k * (k + 1) / max(1, n - k - 1), "p": tuple(smooth[0].tolist()),
        "state": (float(last[0]), float(last[1]), last[2:].tolist()), "n": n, "loglik": -float(f) / 2, "k": k,
    }


def ets_name(spec) -> str:
    return spec[0] + spec[1] + ("d" if spec[2] else "") + spec[3]


def auto_ets(y: np.ndarray, sp: int = SEASON, criterion: str = "aic") -> dict:
    """The first spec with the least criterion; ValueError if none fits."""
    fits = [f for f in (fit_ets(y, s, sp) for s in ETS_SPECS) if f is not None]
    if not fits:
        raise ValueError("no ETS model fits")
    return min(fits, key=lambda f: f[criterion])


def ets_forecast(fit: dict, h: int, sp: int = SEASON) -> np.ndarray:
    level, trend, season = fit["state"]
    phi, (e, t, damped, s) = fit["p"][3], fit["spec"]
    out, total = [], 0.0
    for i in range(1, h + 1):
        total += phi**i
        base = level + (trend * total if t == "A" else 0.0)
        c = season[(fit["n"] + i - 1) % sp]
        out.append(base + c if s == "A" else base * c if s == "M" else base)
    return np.array(out)


def seasonal_ar(y: np.ndarray, h: int, sp: int = SEASON) -> np.ndarray:
    """A reduced ARIMA: seasonal difference, then an AR(p), p <= 3 by AICc, fitted by conditional least squares."""
    if len(y) < 2 * sp + 4:
        return naive(y, h, sp)
    d = y[sp:] - y[:-sp]
    best = None
    for p in range(4):
        x = np.column_stack([np.ones(len(d) - p)] + [d[p - j - 1 : len(d) - j - 1] for j in range(p)])
        coef, *_ = np.linalg.lstsq(x, d[p:], rcond=None)
        rss = float(((d[p:] - x @ coef) ** 2).sum())
        n, k = len(d) - p, p + 2
        score = n * math.log(max(rss, 1e-300) / n) + 2 * k + 2 * k * (k + 1) / max(1, n - k - 1)
        if best is None or score < best[0]:
            best = (score, p, coef)
    _, p, coef = best
    d, y = list(d), list(y)
    for _ in range(h):
        nxt = coef[0] + sum(coef[1 + j] * d[-1 - j] for j in range(p))
        d.append(nxt)
        y.append(y[-sp] + nxt)
    return np.array(y[-h:])


MODELS = {
    "naive": naive,
    "theta": theta,
    "auto_ets": lambda y, h, sp=SEASON: ets_forecast(auto_ets(y, sp), h, sp),
    "auto_arima": seasonal_ar,
}


def backtest(monthly: DataFrame, models: tuple[str, ...] = tuple(MODELS), initial: int = 72, step: int = 12, test: int = 12) -> DataFrame:
    """phrase, model, fold, mase: every model refitted on every expanding window, one task for each phrase and model.

    Raises BacktestError if there is no series or one is too short for a fold.
    """
    short = monthly.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("phrase", "n").alias("phrase"), F.min("n").alias("n")).first()
    if short["n"] is None:
        raise BacktestError("no series to backtest")
    if short["n"] < initial + test:
        raise BacktestError(f"{short['phrase']} has {short['n']} months, a fold needs {initial + test}")
    rows = monthly.select("phrase", "period", F.col("queries").cast("double").alias("queries")).withColumn("model", F.explode(F.array(*map(F.lit, models))))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("period")
        y, model, phrase = g["queries"].to_numpy(float), g["model"].iloc[0], g["phrase"].iloc[0]
        out = []
        for fold, cut in enumerate(range(initial, len(y) - test + 1, step)):
            train, real = y[:cut], y[cut : cut + test]
            scale = np.abs(np.diff(train)).mean()
            f = MODELS[model](train, test)
            out.append((phrase, model, fold, float(np.abs(real - f).mean() / scale) if scale else None))
        return pd.DataFrame(out, columns=["phrase", "model", "fold", "mase"])

    return rows.groupBy("phrase", "model").applyInPandas(run, "phrase string, model string, fold int, mase double")


def backtest_table(folds: DataFrame) -> DataFrame:
    return folds.groupBy("phrase", "model").agg(F.median("mase").alias("mase_median"), F.count(F.lit(1)).alias("n_folds"))


def ets_structure(monthly: DataFrame, sp: int = SEASON, criterion: str = "aic") -> DataFrame:
    """phrase, spec, aic, aicc, level, trend, seasonal, by_month: the ETS model chosen on the whole series.

    by_month holds the last season's states from January on: the season that starts with the first point of the series,
    turned by that point's month. Without a season it is all zeros.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("period")
        phrase = g["phrase"].iloc[0]
        try:
            f = auto_ets(g["queries"].to_numpy(float), sp, criterion)
        except ValueError:
            return pd.DataFrame([(phrase, *[None] * 7)], columns=cols)
        seasonal = [float(x) for x in f["state"][2]] if f["spec"][3] != "N" else None
        by_month = np.roll(seasonal or [0.0] * sp, g["month"].iloc[0] - 1).tolist()
        return pd.DataFrame([(phrase, ets_name(f["spec"]), f["aic"], f["aicc"], float(f["state"][0]), float(f["state"][1]), seasonal, by_month)], columns=cols)

    cols = ["phrase", "spec", "aic", "aicc", "level", "trend", "seasonal", "by_month"]
    kind = "phrase string, spec string, aic double, aicc double, level double, trend double, seasonal array<double>, by_month array<double>"
    return monthly.select("phrase", "period", F.month("period").alias("month"), F.col("queries").cast("double").alias("queries")).groupBy("phrase").applyInPandas(run, kind)


def ic_grid(daily: DataFrame, windows: tuple[int, ...] = WEEKS, sp: int = 7) -> DataFrame:
    """phrase, days, seasonal, aic, aicc, loglik, k (parameters): the best seasonal and the best non-seasonal model of each suffix window."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y = g.sort_values("day")["count"].to_numpy(float)
        out = []
        for days in windows:
            part = y[-days:]
            for seasonal in (False, True):
                fits = [f for f in (fit_ets(part, s, sp) for s in ETS_SPECS if (s[3] != "N") == seasonal) if f is not None] if len(y) >= days else []
                if fits:
                    b = min(fits, key=lambda f: f["aic"])
                    out.append((g["phrase"].iloc[0], days, seasonal, b["aic"], b["aicc"], b["loglik"], b["k"]))
        return pd.DataFrame(out, columns=["phrase", "days", "seasonal", "aic", "aicc", "loglik", "k"])

    return daily.groupBy("phrase").applyInPandas(run, "phrase string, days int, seasonal boolean, aic double, aicc double, loglik double, k int")


def ic_deltas(grid: DataFrame) -> DataFrame:
    """phrase, days, d_loglik, d_k, d_aic, d_aicc: the seasonal model's values less the non-seasonal one's, from ic_grid().

    NULL where one of the two is missing. A negative d_aic speaks for a season.
    """
    at = lambda c, seasonal: F.max(F.when(F.col("seasonal") == seasonal, F.col(c)))
    names = ("loglik", "k", "aic", "aicc")
    return grid.groupBy("phrase", "days").agg(*[(at(c, True) - at(c, False)).alias(f"d_{c}") for c in names])


def stability(monthly: DataFrame, drops: tuple[int, ...] = (3, 6), sp: int = SEASON) -> DataFrame:
    """phrase, drop, status, level_shift, profile_corr of ETS refits on truncated series; 'not_measurable' if none fits."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y, phrase = g.sort_values("period")["queries"].to_numpy(float), g["phrase"].iloc[0]
        out = []
        for k in drops:
            try:
                a, b = auto_ets(y, sp), auto_ets(y[: len(y) - k], sp)
            except ValueError:
                out.append((phrase, k, "not_measurable", None, None))
                continue
            la, lb = float(a["state"][0]), float(b["state"][0])
            sa, sb = np.array(a["state"][2]), np.array(b["state"][2])
            corr = float(np.corrcoef(sa, sb)[0, 1]) if sa.std() > 0 and sb.std() > 0 else None
            out.append((phrase, k, "measured", (lb - la) / la if la else None, corr))
        return pd.DataFrame(out, columns=["phrase", "drop", "status", "level_shift", "profile_corr"])

    rows = monthly.select("phrase", "period", F.col("queries").cast("double").alias("queries"))
    return rows.groupBy("phrase").applyInPandas(run, "phrase string, drop int, status string, level_shift double, profile_corr double")


def chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees > x), by the series or continued fraction of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def autocorrelations(x: np.ndarray, lags: int) -> np.ndarray:
    c = x - x.mean()
    return np.array([(c[k:] * c[: len(c) - k]).sum() for k in range(1, lags + 1)]) / (c * c).sum()


def q_statistic(rho: np.ndarray, n: int) -> float:
    """Ljung-Box statistic of the first autocorrelations."""
    return float(n * (n + 2) * (rho**2 / (n - np.arange(1, len(rho) + 1))).sum())


def strongest_period(x: np.ndarray, least: int = 4) -> int | None:
    """Period of most power between `least` and a third of the series; None if there is none.

    Power is averaged over half-overlapping Hann windows of half the series (Welch), so periods are what half the series
    divided by whole numbers rounds to: coarse on short series.
    """
    n, w = len(x), len(x) // 2
    if w < 2:
        return None
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(w) / w)
    parts = [x[a : a + w] for a in range(0, n - w + 1, w - w // 2)]
    power = sum(np.abs(np.fft.rfft((part - part.mean()) * hann)) ** 2 for part in parts)
    found = [(power[k], -k, round(w / k)) for k in range(1, len(power)) if least <= round(w / k) <= n // 3]
    best = max(found, default=(0.0,))
    return best[2] if best[0] > 0 else None


def seen_by(x: np.ndarray, lag: int = 7, level: float = 0.05) -> dict[str, object]:
    """What each detector says of a period of `lag` in one series; a detector that cannot work says no.

    acf: the autocorrelation at the lag leaves Bartlett's band. q: the Ljung-Box statistic up to the lag is significant
    (one candidate, so that correction for many tests changes nothing). period: the strongest of the periodogram.
    aic, aicc: the ETS model of least criterion has a season.
    """
    out = {"acf": False, "q": False, "period": None, "aic": False, "aicc": False}
    n = len(x)
    if n <= lag or not np.isfinite(x).all() or x.std() == 0:
        return out
    rho = autocorrelations(x, lag)
    band = 1.959964 * math.sqrt((1 + 2 * (rho[:-1] ** 2).sum()) / n)
    out |= {"acf": bool(abs(rho[-1]) > band), "q": chi2_tail(q_statistic(rho, n), lag) < level, "period": strongest_period(x)}
    fits = [f for f in (fit_ets(x, spec, lag) for spec in ETS_SPECS) if f]
    for criterion in ("aic", "aicc") if fits else ():
        out[criterion] = min(fits, key=lambda f: f[criterion])["spec"][3] != "N"
    return out


SEEN = "acf boolean, q boolean, period int, aic boolean, aicc boolean"


def detectors(daily: DataFrame, windows: tuple[int, ...] = WEEKS, lag: int = 7) -> DataFrame:
    """phrase, days, acf, q, period, aic, aicc: seen_by() of the suffix windows of each series; no of windows that are too long."""
    each = daily.select("phrase", "day", F.col("count").cast("double").alias("count"), F.explode(F.array(*map(F.lit, windows))).alias("days"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        y, days = g.sort_values("day")["count"].to_numpy(float), int(key[1])
        seen = seen_by(y[-days:] if len(y) >= days else y[:0], lag)
        return pd.DataFrame([[key[0], days, *seen.values()]], columns=["phrase", "days", *seen]).astype({"period": "Int32"})

    return each.groupBy("phrase", "days").applyInPandas(run, f"phrase string, days int, {SEEN}")


def weekly_verdict(daily: DataFrame, windows: tuple[int, ...] = WEEKS, lag: int = 7, level: float = 0.05) -> DataFrame:
    """phrase, days, acf, q, p, weekly: whether a weekly period shows in each suffix window; short windows say no."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        y, out = g.sort_values("day")["count"].to_numpy(float), []
        for days in windows:
            x = y[-days:]
            if len(y) < days or days <= lag or x.std() == 0:
                out.append((g["phrase"].iloc[0], days, None, None, None, False))
                continue
            rho = autocorrelations(x, lag)
            q = q_statistic(rho, len(x))
            p = chi2_tail(q, lag)
            out.append((g["phrase"].iloc[0], days, float(rho[-1]), q, p, bool(p < level and rho[-1] > 1.96 / math.sqrt(len(x)))))
        return pd.DataFrame(out, columns=["phrase", "days", "acf", "q", "p", "weekly"])

    return daily.groupBy("phrase").applyInPandas(run, "phrase string, days int, acf double, q double, p double, weekly boolean")


#: Made-up series: the weekly profile kept, flattened, and nothing but noise of the whole series' spread.
CONDITIONS = ("seasonal", "flat", "noise")


def made_up(y: np.ndarray, condition: str, n: int, rng, sp: int = 7) -> np.ndarray:
    """n points with the level and the noise of y under one of CONDITIONS."""
    if condition == "noise":
        return rng.normal(y.mean(), y.std(), n)
    at = np.arange(len(y)) % sp
    profile = np.array([y[at == k].mean() for k in range(sp)])
    noise = math.sqrt(((y - profile[at]) ** 2).sum() / max(1, len(y) - sp))
    shape = profile / profile.mean() if condition == "seasonal" else np.ones(sp)
    return y.mean() * shape[np.arange(n) % sp] + rng.normal(0, noise, n)


def structure_flips(daily: DataFrame, reps: int = 100, days: tuple[int, int] = (56, 42), sp: int = 7, seed: int = 32) -> DataFrame:
    """phrase, condition, criterion, reps, seen_long, seen_short, flips: how often ETS has a season on made-up series.

    Each repetition draws a series of days[0] points from the phrase's level, profile and noise and cuts it to days[1]. It has
    its own seed, so repetitions are independent tasks. Series of fewer than sp + 1 points, or without level, give no row.
    """
    series = daily.groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("day", F.col("count").cast("double").alias("v")))).alias("s"))
    rows = series.select("phrase", F.transform("s", lambda x: x["v"]).alias("y"))
    rows = rows.where((F.size("y") > sp) & F.exists("y", lambda v: v != 0))
    rows = rows.withColumn("condition", F.explode(F.array(*map(F.lit, CONDITIONS)))).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    rows = rows.withColumn("seed", F.pmod(F.xxhash64("phrase", "condition", "rep", F.lit(seed)), F.lit(2**31)))
    # a repetition costs two whole model searches: few rows, dealt to all cores by count, as their bytes would fit one task
    rows = rows.repartition(4 * daily.sparkSession.sparkContext.defaultParallelism, "phrase", "condition", "rep")

    def run(batches):
        for pdf in batches:
            out = []
            for phrase, condition, y, s in zip(pdf["phrase"], pdf["condition"], pdf["y"], pdf["seed"]):
                x = made_up(np.asarray(y, float), condition, days[0], np.random.default_rng(int(s)), sp)
                fits = [[f for f in (fit_ets(part, spec, sp) for spec in ETS_SPECS) if f] for part in (x, x[: days[1]])]
                for criterion in ("aic", "aicc"):
                    seen = [bool(some) and min(some, key=lambda f: f[criterion])["spec"][3] != "N" for some in fits]
                    out.append((phrase, condition, criterion, *seen))
            yield pd.DataFrame(out, columns=["phrase", "condition", "criterion", "long", "short"])

    seen = rows.select("phrase", "condition", "y", "seed").mapInPandas(run, "phrase string, condition string, criterion string, long boolean, short boolean")
    return seen.groupBy("phrase", "condition", "criterion").agg(
        F.count(F.lit(1)).alias("reps"), F.count_if("long").alias("seen_long"), F.count_if("short").alias("seen_short"), F.count_if(F.col("long") != F.col("short")).alias("flips")
    )


def results_block(summary: DataFrame, baseline: str = "naive") -> DataFrame:
    """One row: the model with the least median error, the baseline's, and their ratio."""
    best = F.min_by(F.struct("model", "mase_median"), F.struct("mase_median", "model"))
    base = F.max(F.when(F.col("model") == baseline, F.col("mase_median")))
    d = summary.agg(best.alias("b"), base.alias("baseline_mase"))
    return d.select(F.col("b.model").alias("model"), F.col("b.mase_median").alias("mase"), "baseline_mase", F.try_divide(F.col("b.mase_median"), "baseline_mase").alias("ratio"))
