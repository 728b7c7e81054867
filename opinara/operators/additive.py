"""Additive forecast with change points and Fourier seasons, for all series in one plan.

A scaled series is a line, hinges at up to 25 change points over the first 80 % of its time, and sine and cosine
pairs of a week (3) and a year (10). Slopes at change points and seasonal weights are shrunk by their scales, as normal
priors would, so the fit solves one system of penalised normal equations per series. Its Gram matrix is summed in Spark: each Arrow
batch adds up what it holds of a series, and equal places are summed. Solving and predicting run in Arrow batches.

The interval is normal. In the future its variance grows by what change points of the past's frequency and mean size add.
Defined results: a series with fewer than `min_points` points or a single date is left out; a constant series is forecast as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .series import _sid

CHANGEPOINTS = 25
RANGE = 0.8             # share of the time that may hold change points
WEEK, YEAR = (7.0, 3), (365.25, 10)     # period in days, pairs
_META = ("d0", "d1", "scale", "noise", "n", "hinges", "weekly", "yearly")
_META_SQL = "d0 int, d1 int, scale double, noise double, n bigint, hinges int, weekly boolean, yearly boolean"


def design(day: np.ndarray, d0: int, d1: int, hinges: int, weekly: bool, yearly: bool) -> tuple[np.ndarray, int]:
    """Columns of the model for days since 1970 and how many of them are trend."""
    t = (day - d0) / (d1 - d0)
    at = RANGE * np.arange(1, hinges + 1) / (hinges + 1)
    columns = [np.ones_like(t)[:, None], t[:, None], np.maximum(0.0, t[:, None] - at)]
    for (period, pairs), used in ((WEEK, weekly), (YEAR, yearly)):
        if used:
            angle = 2 * np.pi * day[:, None] * np.arange(1, pairs + 1) / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.hstack(columns), 2 + hinges


def penalties(width: int, hinges: int, noise: float, changepoint: float, seasonality: float) -> np.ndarray:
    scales = np.full(width, seasonality)
    scales[2: 2 + hinges] = changepoint
    out = noise / scales**2
    out[:2] = 0.0
    return out


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, pd.DataFrame]]:
    for pdf in batches:
        yield from pdf.groupby("series_id", sort=False)


def _model_columns(series: DataFrame, hinges: int, weekly: bool | None, yearly: bool | None, min_points: int) -> DataFrame:
    """Series with what their models share: time range, scale, noise, and the columns in use."""
    w = _sid()
    day = F.unix_date("ds")
    x, y = day.cast("double"), F.col("y")
    n = F.count("y").over(w)
    sxx, sxy, syy = (F.call_function(f, y, x).over(w) for f in ("regr_sxx", "regr_sxy", "regr_syy"))
    scale = F.max(F.abs("y")).over(w)
    scale = F.when(scale > 0, scale).otherwise(1.0)
    return series.where(y.isNotNull()).select(
        "series_id", "ds", "y", day.alias("day"), F.min(day).over(w).alias("d0"), F.max(day).over(w).alias("d1"),
        scale.alias("scale"), (F.greatest(F.lit(0.0), syy - F.try_divide(sxy * sxy, sxx)) / n / (scale * scale)).alias("noise"),
        n.alias("n"), F.least(F.lit(hinges), F.floor(n * RANGE) - 1).cast("int").alias("hinges"),
        (n > 14 if weekly is None else F.lit(weekly)).alias("weekly"),
        (n > 365 if yearly is None else F.lit(yearly)).alias("yearly"),
    ).where((F.col("n") >= min_points) & (F.col("d1") > F.col("d0")))


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for series, pdf in _groups(batches):
        meta = pdf.iloc[0]
        x, _ = design(pdf["day"].to_numpy(float), *(meta[c] for c in ("d0", "d1", "hinges", "weekly", "yearly")))
        own = np.hstack([x, (pdf["y"].to_numpy() / meta["scale"])[:, None]])
        yield pd.DataFrame({"series_id": [series], **{c: [meta[c]] for c in _META}, "gram": [(own.T @ own).ravel()]})


def fit_piecewise(series: DataFrame, changepoint: float = 0.05, seasonality: float = 1.0, hinges: int = CHANGEPOINTS,
                  weekly: bool | None = None, yearly: bool | None = None, min_points: int = 10) -> DataFrame:
    """One model per series: what it was fitted on, its weights, residual deviation and mean size of slope changes.

    A week counts above 14 points and a year above 365, unless said otherwise.
    """
    rows = _model_columns(series, hinges, weekly, yearly, min_points)
    parts = rows.drop("ds").mapInPandas(_grams, f"series_id string, {_META_SQL}, gram array<double>")
    keys = ["series_id", *_META]
    sums = parts.select(*keys, F.posexplode("gram").alias("i", "x")).groupBy(*keys, "i").agg(F.sum("x").alias("x"))
    whole = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("gram"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            weights, deviations, changes = [], [], []
            for r in pdf.itertuples(index=False):
                size = int(np.sqrt(len(r.gram)))
                gram = np.array(r.gram).reshape(size, size)
                x, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
                # a noiseless line still needs a system of full rank
                ridge = penalties(size - 1, r.hinges, max(r.noise, 1e-9), changepoint, seasonality)
                beta = np.linalg.solve(x + np.diag(ridge), xy)
                sse = max(0.0, yy - 2 * beta @ xy + beta @ x @ beta)
                weights.append(beta)
                deviations.append(np.sqrt(sse / r.n) * r.scale)
                changes.append(np.abs(beta[2: 2 + r.hinges]).mean() * r.scale if r.hinges else 0.0)
            yield pdf.drop(columns="gram").assign(weights=weights, deviation=deviations, change=changes)

    return whole.mapInPandas(solve, f"series_id string, {_META_SQL}, weights array<double>, deviation double, change double")


def _predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for series, pdf in _groups(batches):
        meta = pdf.iloc[0]
        day = pdf["day"].to_numpy(float)
        x, trend = design(day, *(meta[c] for c in ("d0", "d1", "hinges", "weekly", "yearly")))
        weights = np.array(meta["weights"]) * meta["scale"]
        line = x[:, :trend] @ weights[:trend]
        ahead = np.maximum(0.0, (day - meta["d1"]) / (meta["d1"] - meta["d0"]))
        rate = meta["hinges"] / RANGE
        spread = np.sqrt(meta["deviation"] ** 2 + 2 * meta["change"] ** 2 * rate * ahead**3 / 3)
        yield pdf[["series_id", "ds", "y", "is_future"]].assign(yhat=x @ weights, trend=line, spread=spread)


def piecewise_forecast(series: DataFrame, periods: int = 90, freq: str = "D", width: float = 0.95, **params) -> DataFrame:
    """History and future of every series, in the columns of `series.fit_forecast`.

    `params` are those of `fit_piecewise`; `periods` counts periods of `freq`.
    """
    models = fit_piecewise(series, **params)
    model = ["d0", "d1", "scale", "hinges", "weekly", "yearly", "weights", "deviation", "change"]
    past = series.where("y is not null").select("series_id", "ds", "y").join(models, "series_id").select(
        "series_id", "ds", "y", F.lit(False).alias("is_future"), *model)
    future = models.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).select(
        "series_id", C.next_period_end(F.date_from_unix_date("d1"), F.col("step"), freq).alias("ds"),
        F.lit(None).cast("double").alias("y"), F.lit(True).alias("is_future"), *model)
    out = past.unionByName(future).withColumn("day", F.unix_date("ds")).mapInPandas(
        _predicted, "series_id string, ds date, y double, is_future boolean, yhat double, trend double, spread double")
    margin = F.col("spread") * NormalDist().inv_cdf(0.5 + width / 2)
    return out.select("series_id", "ds", "y", "yhat", (F.col("yhat") - margin).alias("yhat_lower"),
                      (F.col("yhat") + margin).alias("yhat_upper"), "trend", "is_future")
