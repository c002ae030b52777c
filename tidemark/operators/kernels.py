"""Recursions in time that windows can't express, one series for each group: Holt-Winters and two-state regimes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed values of the model: smoothing weights that are tried.
GRID = np.array([(a, b, g) for a in (0.1, 0.3, 0.5, 0.7) for b in (0.05, 0.1, 0.3) for g in (0.1, 0.3, 0.5)])


def smooth(y: np.ndarray, period: int) -> tuple[float, float, np.ndarray, float, np.ndarray]:
    """Level, trend, season and mean error of the best weights of GRID, and the one-step errors, all weights side by side.

    The first season sets the state; the recursion and the errors start after it.
    """
    a, b, g = GRID.T
    level, trend = np.full(len(GRID), y[:period].mean()), np.full(len(GRID), (y[period : 2 * period].mean() - y[:period].mean()) / period)
    season = np.tile(y[:period] - y[:period].mean(), (len(GRID), 1))
    errors = []
    for i in range(period, len(y)):
        s = season[:, i % period].copy()
        errors.append(level + trend + s - y[i])
        new = a * (y[i] - s) + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        season[:, i % period] = g * (y[i] - new) + (1 - g) * s
        level = new
    e = np.array(errors)
    best = int(np.abs(e).mean(axis=0).argmin())
    return float(level[best]), float(trend[best]), season[best], float(np.abs(e[:, best]).mean()), e[:, best]


def holt_winters(long: DataFrame, period: int = 7, horizon: int = 3) -> DataFrame:
    """WN20: additive Holt-Winters; the smoothing weights of smallest one-step error out of a grid. A series is one group."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("date")["value"].to_numpy(float)
        name = pdf["series_id"].iloc[0]
        if len(y) < 2 * period:
            return pd.DataFrame({"series_id": [name], "predicted": [float(y.mean())], "mae": [0.0], "n": [len(y)]})
        level, trend, season, mae, _ = smooth(y, period)
        return pd.DataFrame({"series_id": [name], "predicted": [level + horizon * trend + season[(len(y) + horizon - 1) % period]], "mae": [mae], "n": [len(y)]})

    return long.groupBy("series_id").applyInPandas(fit, "series_id string, predicted double, mae double, n long")


def enhanced_report(long: DataFrame, periods: DataFrame, horizons: tuple = (1, 3, 7, 14), least: int = 14) -> DataFrame:
    """WN23: Holt-Winters at the detected period (series_id, period) for several horizons, with a band of 1.96 deviations of its errors.

    Series with fewer than `least` rows, or two periods, get no forecast.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, period = pdf.sort_values("date")["value"].to_numpy(float), int(pdf["period"].iloc[0])
        out = []
        if len(y) >= max(least, 2 * period):
            level, trend, season, _, errors = smooth(y, period)
            for h in horizons:
                x, band = level + h * trend + season[(len(y) + h - 1) % period], 1.96 * float(errors.std()) * h**0.5
                out.append((pdf["series_id"].iloc[0], h, x, x - band, x + band))
        kinds = {"series_id": "string", "horizon": "int32", "predicted": "float64", "lower": "float64", "upper": "float64"}
        return pd.DataFrame(out, columns=list(kinds)).astype(kinds)

    return long.join(periods, "series_id").groupBy("series_id").applyInPandas(fit, "series_id string, horizon int, predicted double, lower double, upper double")


def regimes(long: DataFrame, rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """WN33: two-state Gaussian regimes by expectation maximisation with a Hamilton filter and a standard smoother.

    A row for each day: the chance of the state with the higher mean, the longest mean stay of the two states, and the days fitted.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        y = pdf["value"].to_numpy(float)
        n = len(y)
        high = y > np.median(y)
        mean = np.array([y[~high].mean(), y[high].mean() if high.any() else y.mean()])
        var = np.full(2, max(y.var(), 1e-9))
        move, start, last = np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.5, 0.5]), -np.inf
        for _ in range(rounds):
            like = np.exp(-((y[:, None] - mean) ** 2) / (2 * var)) / np.sqrt(2 * np.pi * var) + 1e-300
            f, scale = np.zeros((n, 2)), np.zeros(n)
            for t in range(n):
                p = (start if t == 0 else f[t - 1] @ move) * like[t]
                scale[t] = p.sum()
                f[t] = p / scale[t]
            b = np.ones((n, 2))
            for t in range(n - 2, -1, -1):
                b[t] = move @ (like[t + 1] * b[t + 1]) / scale[t + 1]
            post = f * b
            post /= post.sum(axis=1, keepdims=True)
            if n > 1:
                pair = np.einsum("ti,ij,tj->ij", f[:-1], move, (like * b)[1:] / scale[1:, None])
                move = pair / pair.sum(axis=1, keepdims=True)
            start = post[0]
            weight = post.sum(axis=0) + 1e-12
            mean = (post * y[:, None]).sum(axis=0) / weight
            var = np.maximum((post * (y[:, None] - mean) ** 2).sum(axis=0) / weight, 1e-9)
            total = np.log(scale).sum()
            if abs(total - last) < tolerance:
                break
            last = total
        stay = float((1 / np.maximum(1 - np.diag(move), 1e-6)).max())
        return pd.DataFrame({"series_id": pdf["series_id"], "date": pdf["date"], "p_high": post[:, int(mean.argmax())], "sojourn": stay, "n_obs": n})

    return long.groupBy("series_id").applyInPandas(fit, "series_id string, date date, p_high double, sojourn double, n_obs long")
