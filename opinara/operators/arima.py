"""ARIMA forecasts, one bounded series per task group.

A seasonal model multiplies its short and its seasonal polynomial. Coefficients minimise the conditional sum of squares, with
shocks before the first full row at 0; all candidate vectors of a step run through the recursion side by side.
"""

from __future__ import annotations

from itertools import product
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from .series import period_means, prepare_series

SCHEMA = ("series_id string, last_ds date, step int, yhat double, yhat_lower double, yhat_upper double, "
          "error string")
EDGE = 0.99     # largest partial autocorrelation of shocks
GRID = 19       # starting values for each of them
STEPS = 200


def _polynomial(short: np.ndarray, seasonal: np.ndarray, s: int) -> np.ndarray:
    """Coefficients 1, a1, a2, ... of the product of a short and a seasonal polynomial."""
    season = np.zeros(len(seasonal) * s + 1)
    season[0] = 1.0
    if len(seasonal):
        season[s::s] = seasonal
    return np.convolve(np.concatenate([[1.0], short]), season)


def _difference(y: np.ndarray, d: int, seasonal_d: int, s: int):
    """Differenced series and what is needed to undo it, innermost last."""
    undo = []
    if len(y) <= seasonal_d * s + d + 2:
        raise ValueError(f"{len(y)} points are too few for differences of season {s}")
    for _ in range(seasonal_d):
        undo.append((s, y[-s:].copy()))
        y = y[s:] - y[:-s]
    for _ in range(d):
        undo.append((1, y[-1:].copy()))
        y = np.diff(y)
    return y, undo


def _invertible(partial: np.ndarray) -> np.ndarray:
    """Moving-average weights from partial autocorrelations inside (-1, 1): all roots lie outside the unit circle."""
    out = np.zeros(0)
    for r in partial:
        out = np.concatenate([out + r * out[::-1], [r]])
    return out


def _lag_set(short: int, seasonal: int, s: int) -> list[int]:
    """Lags of a product of a short and a seasonal polynomial."""
    return sorted({i + j * s for i in range(short + 1) for j in range(seasonal + 1)} - {0})


class _Model:
    """Conditional sum of squares of one differenced series.

    Parameters: the constant, short and seasonal autoregression, and the partial autocorrelations of short and
    seasonal shocks, which keep the shocks invertible (at most EDGE). Shocks before the first full row are 0.
    """

    def __init__(self, w: np.ndarray, order: tuple[int, int, int, int], s: int):
        self.w, self.s = w, s
        self.p, self.ap, self.q, self.aq = order    # short and seasonal orders
        self.start, self.lags = self.p + self.ap * s, _lag_set(self.q, self.aq, s)
        self.free = 1 + self.p + self.ap
        self.size = self.free + self.q + self.aq
        if len(w) - self.start < self.size + 1:
            raise ValueError(f"{len(w)} differenced points are too few for {self.size} coefficients from lag {self.start} on")

    def polynomials(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ar = _polynomial(-v[1: 1 + self.p], -v[1 + self.p: self.free], self.s)
        ma = v[self.free:]
        return ar, _polynomial(_invertible(ma[:self.q]), _invertible(ma[self.q:]), self.s)

    def shocks(self, many: np.ndarray) -> np.ndarray:
        """Shocks for parameter vectors in rows, all at once: one column each."""
        polys = [self.polynomials(v) for v in many]
        rows = np.stack([np.convolve(self.w, ar)[self.start: len(self.w)] - v[0] for v, (ar, _) in zip(many, polys, strict=True)],
                        axis=1)
        ma = np.stack([m for _, m in polys], axis=1)    # one row per lag
        for t in range(1, len(rows) if self.lags else 0):
            for j in self.lags:
                if j <= t:
                    rows[t] -= ma[j] * rows[t - j]
        return rows

    def _jacobian(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = np.diag(np.full(self.size, 1e-6))
        many = self.shocks(np.vstack([v[None], v + step, v - step]))
        n = self.size
        return many[:, 0], (many[:, 1: 1 + n] - many[:, 1 + n:]) / 2e-6

    def _start(self) -> tuple[float, np.ndarray]:
        """The best of a grid of shock weights, all run side by side; the other coefficients follow by least squares."""
        grid = np.array(list(product(np.linspace(-0.9, 0.9, GRID), repeat=self.size - self.free)))
        base = np.hstack([np.zeros((len(grid), self.free)), grid.reshape(len(grid), -1)])
        step = 1e-6 * np.eye(self.size)[:self.free]
        moved = [base, *(base + x for x in step), *(base - x for x in step)]
        rows = self.shocks(np.vstack(moved)).reshape(-1, len(moved), len(grid))
        slopes = (rows[:, 1: 1 + self.free] - rows[:, 1 + self.free:]) / 2e-6
        for i in range(len(grid)):
            base[i, :self.free] -= np.linalg.lstsq(slopes[:, :, i], rows[:, 0, i], rcond=None)[0]
        costs = (self.shocks(base) ** 2).sum(axis=0)
        best = int(costs.argmin())
        return float(costs[best]), base[best]

    def fit(self) -> np.ndarray:
        """Levenberg-Marquardt inside the box, from the best of a grid of shock weights."""
        low = np.concatenate([np.full(self.free, -np.inf), np.full(self.size - self.free, -EDGE)])
        cost, v = self._start()
        damping = 1e-6
        for _ in range(STEPS):
            own, jacobian = self._jacobian(v)
            slope = jacobian.T @ own
            held = ((v <= low) & (slope > 0)) | ((v >= -low) & (slope < 0))     # at the edge and pushing outwards
            go = np.flatnonzero(~held)
            normal = jacobian[:, go].T @ jacobian[:, go]
            scale = np.maximum(np.diag(normal), 1e-12)
            move = np.linalg.lstsq(normal + damping * np.diag(scale), -slope[go], rcond=None)[0]
            new = v.copy()
            new[go] = np.clip(v[go] + move, low[go], -low[go])
            now = float((self.shocks(new[None]) ** 2).sum())
            if now <= cost:
                done = np.abs(new - v).max() < 1e-12 * (1 + np.abs(v).max())
                cost, v, damping = now, new, damping / 10
                if done:
                    break
            elif damping > 1e12:
                break
            else:
                damping *= 10
        return v


def forecast_values(y: np.ndarray, order=(1, 1, 1), seasonal=(0, 0, 0, 0), periods: int = 90,
                    width: float = 0.95):
    """Mean path and interval of one series."""
    (p, d, q), (sp, sd, sq, s) = order, seasonal
    if not s:
        sp = sd = sq = 0
    w, undo = _difference(np.asarray(y, dtype=float), d, sd, s)
    model = _Model(w, (p, sp, q, sq), s)
    v = model.fit()
    ar, ma = model.polynomials(v)
    shocks = model.shocks(v[None])[:, 0]
    sigma = float(np.sqrt(np.mean(shocks**2)))
    path, e = list(w), [0.0] * len(w)
    e[model.start:] = list(shocks)
    for _ in range(periods):
        nxt = v[0] - sum(a * path[-j] for j, a in enumerate(ar[1:], 1))
        nxt += sum(m * (e[-j] if j <= len(e) else 0.0) for j, m in enumerate(ma[1:], 1))
        path.append(nxt)
        e.append(0.0)
    mean = np.array(path[len(w):])
    psi = np.zeros(periods)
    for j in range(periods):
        psi[j] = (ma[j] if j < len(ma) else 0.0) - sum(ar[k] * psi[j - k] for k in range(1, min(j, len(ar) - 1) + 1))
    for lag, tail in reversed(undo):
        out = np.concatenate([tail, mean])
        weights = psi.copy()
        for i in range(periods):
            out[lag + i] += out[i]
            if i >= lag:
                weights[i] += weights[i - lag]
        mean, psi = out[lag:], weights
    margin = NormalDist().inv_cdf(0.5 + width / 2) * sigma * np.sqrt(np.cumsum(psi**2))
    return mean, mean - margin, mean + margin


def fit_arima(series: DataFrame, order=(1, 1, 1), seasonal=(0, 0, 0, 0), periods: int = 90,
              freq: str = "D", width: float = 0.95, min_points: int = 10) -> DataFrame:
    """ARIMA means and intervals for every series; dates follow ``freq``.

    A group is one series of period means, so its size is bounded by the calendar.
    Coefficients come from the conditional sum of squares, in at most STEPS steps.  A series that cannot be fitted is one row
    with its ``error`` and no step.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        try:
            if len(pdf) < min_points:
                raise ValueError(f"{len(pdf)} points, at least {min_points} are needed")
            mean, low, high = forecast_values(pdf["y"].to_numpy(), order, seasonal, periods, width)
        except (ValueError, np.linalg.LinAlgError) as why:
            return pd.DataFrame({
                "series_id": pdf["series_id"].iloc[:1], "last_ds": pdf["ds"].iloc[-1], "step": pd.array([None], "Int32"),
                "yhat": np.nan, "yhat_lower": np.nan, "yhat_upper": np.nan, "error": str(why)}).replace({np.nan: None})
        return pd.DataFrame({
            "series_id": pdf["series_id"].iloc[0], "last_ds": pdf["ds"].iloc[-1],
            "step": np.arange(1, periods + 1, dtype="int32"), "yhat": mean, "yhat_lower": low,
            "yhat_upper": high, "error": None})

    raw = series.select("series_id", "ds", "y").groupBy("series_id").applyInPandas(fit, SCHEMA)
    return raw.select(
        "series_id", C.next_period_end(F.col("last_ds"), F.col("step"), freq).alias("ds"), "step",
        "yhat", "yhat_lower", "yhat_upper", "error")


def arima_trend(forecast: DataFrame, series: DataFrame) -> DataFrame:
    """Trend summary: mean change per step, 30th and 90th values, alerts."""
    current = series.groupBy("series_id").agg(F.max_by("y", "ds").alias("current_sentiment"))
    last = F.max("step")
    failed = forecast.where("error is not null").select("series_id", "error")
    g = forecast.where("error is null").groupBy("series_id").agg(
        last.alias("steps"), F.max_by("yhat", "step").alias("_end"),
        F.min_by("yhat", "step").alias("_start"), F.stddev_samp("yhat").alias("volatility"),
        F.map_from_entries(F.collect_list(F.struct("step", "yhat"))).alias("_path"))
    g = g.withColumn("slope", (F.col("_end") - F.col("_start")) / F.col("steps"))

    def at(k):
        return F.element_at("_path", F.least(F.lit(k), F.col("steps")))

    return g.join(failed, "series_id", "full").join(current, "series_id").select(
        "series_id",
        F.when(F.col("slope").isNull(), None).when(F.col("slope") > 0.01, "Improving").when(F.col("slope") < -0.01, "Declining")
        .otherwise("Stable").alias("trend_direction"),
        "slope", "current_sentiment", "volatility", at(30).alias("predicted_30"),
        at(90).alias("predicted_90"), (F.col("_end") < 0).alias("turns_negative"),
        (F.col("slope") < -0.02).alias("rapid_decline"), "error")


def arima_report(df: DataFrame, order=(1, 1, 1), seasonal=(0, 0, 0, 0), periods: int = 90, freq: str = "D",
                 min_samples: int = 5) -> DataFrame:
    """End-to-end result per aspect; a series that cannot be forecast says why.

    This model knows neither change points nor anomalies, so both counts are 0.
    """
    series = materialize(prepare_series(df, freq, min_samples, method="arima"), "series")
    named = period_means(df, freq).select("series_id").distinct()
    points = series.groupBy("series_id").agg(F.count("*").alias("data_points"))
    trend = arima_trend(fit_arima(series, order, seasonal, periods, freq), series)
    out = named.join(points, "series_id", "left").join(trend, "series_id", "left").na.fill(0, ["data_points"])
    ok = F.col("slope").isNotNull()
    few = F.format_string("Insufficient data: only %d data points (need at least 10)", F.col("data_points"))
    return out.withColumns({
        "changepoint_count": F.lit(0).cast("bigint"), "anomaly_count": F.lit(0).cast("bigint"), "success": ok,
        "alert_count": F.when(ok, F.col("turns_negative").cast("int") + F.col("rapid_decline").cast("int")),
        "error": F.when(ok, None).when(F.col("data_points") < 10, few).otherwise(F.col("error"))})
