"""Aspect time series, all of them in one plan.

Mentions are averaged per (series, period) first.  A series then has at most one row per
calendar period, so the windows and folds below work on bounded groups however many
mentions an aspect has.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize

ASPECT = "aspect_term_normalized"
MAX_GAP_DAYS = {"D": 7, "W": 28, "M": 60}


def _sid():
    return Window.partitionBy("series_id")


def _by_ds():
    return _sid().orderBy("ds")


def _prefix():
    return _by_ds().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def period_means(df: DataFrame, freq: str = "D", key: str = ASPECT) -> DataFrame:
    """``(series_id, ds, y, n)``; the mean is rounded, so it does not depend on the order
    of summation."""
    return df.groupBy(F.col(key).alias("series_id"), C.period_end("date", freq).alias("ds")).agg(
        F.round(F.avg("sentiment_score"), 9).alias("y"), F.count("*").alias("n"))


def volume_filter(series: DataFrame, min_samples: int = 5, min_periods: int = 10) -> DataFrame:
    """Periods with enough mentions, of series with enough such periods."""
    return (series.where(F.col("n") >= min_samples)
            .withColumn("_p", F.count("*").over(_sid()))
            .where(F.col("_p") >= min_periods).drop("_p"))


def three_sigma(series: DataFrame, method: str = "additive") -> DataFrame:
    """Outlier filter: sample deviation, inclusive ("additive"), or population z-score,
    strict ("arima"; a constant series keeps nothing)."""
    mean = F.avg("y").over(_sid())
    if method == "additive":
        keep = F.abs(F.col("y") - mean) <= 3 * F.stddev_samp("y").over(_sid())
    else:
        keep = F.try_divide(F.abs(F.col("y") - mean), F.stddev_pop("y").over(_sid())) < 3
    return series.withColumn("_keep", keep).where("_keep").drop("_keep")


def segments(series: DataFrame, freq: str = "D") -> DataFrame:
    """Number the stretches between gaps wider than the frequency allows."""
    gap = F.datediff("ds", F.lag("ds").over(_by_ds())) > MAX_GAP_DAYS.get(freq, 7)
    return series.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn(
        "segment", F.sum("_new").over(_prefix()).cast("int")).drop("_new")


def longest_segment(segmented: DataFrame, min_points: int = 10) -> DataFrame:
    """The longest stretch of every series, the first of equals.

    A series without gaps is kept as it is; one with gaps needs ``min_points`` points.
    """
    seg = Window.partitionBy("series_id", "segment")
    sized = segmented.withColumns({
        "_n": F.count("*").over(seg),
        "_segs": F.max("segment").over(_sid()),
    })
    best = F.max(F.struct("_n", (-F.col("segment")).alias("neg"))).over(_sid())
    return (
        sized.withColumn("_best", best)
        .where((F.col("_best._n") == F.col("_n"))
               & (F.col("segment") == -F.col("_best.neg"))
               & ((F.col("_segs") == 0) | (F.col("_n") >= min_points)))
        .drop("_n", "_segs", "_best", "segment")
    )


def prepare_series(df: DataFrame, freq: str = "D", min_samples: int = 5, min_periods: int = 10,
                   method: str = "additive", key: str = ASPECT) -> DataFrame:
    """Period means, volume filter, outlier filter, longest continuous stretch."""
    return (
        period_means(df, freq, key)
        .transform(volume_filter, min_samples, min_periods)
        .transform(three_sigma, method)
        .transform(segments, freq)
        .transform(longest_segment)
    )


def series_quality(series: DataFrame, freq: str = "D", min_samples: int = 5) -> DataFrame:
    """Coverage, continuity and volume of each series' periods."""
    step = {"D": 1, "W": 7}.get(freq)
    span = (F.datediff(F.max("ds"), F.min("ds")) / step if step
            else F.round(F.months_between(F.max("ds"), F.min("ds"))))
    whole = series.groupBy("series_id").agg((span + 1).cast("bigint").alias("total_periods"))
    kept = segments(series.where(F.col("n") >= min_samples), freq)
    runs = kept.groupBy("series_id", "segment").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    q = runs.groupBy("series_id").agg(
        F.sum("k").alias("periods_with_data"), F.max("k").alias("longest_segment"),
        F.sum("n").alias("mentions"))
    return whole.join(q, "series_id").withColumns({
        "coverage_pct": C.percent(F.col("periods_with_data"), F.col("total_periods")),
        "continuity_pct": C.percent(F.col("longest_segment"), F.col("total_periods")),
        "avg_volume": F.col("mentions") / F.col("periods_with_data"),
    })


# ---------------------------------------------------------------- change points

def changepoints(series: DataFrame, drift: float = 0.5, threshold: float = 3.0,
                 min_points: int = 10) -> DataFrame:
    """Two-sided cumulative sums of z-scores with reset after each detection.

    The recursion runs as a fold over the sorted points of a series (one per calendar
    period at most), inside the JVM.
    """
    z = F.round((F.col("y") - F.avg("y").over(_sid())) / F.stddev_pop("y").over(_sid()), 9)
    points = (
        series.withColumns({"_n": F.count("*").over(_sid()), "_sd": F.stddev_pop("y").over(_sid())})
        .where((F.col("_n") >= min_points) & (F.col("_sd") > 0))
        .withColumn("z", z)
        .groupBy("series_id")
        .agg(F.array_sort(F.collect_list(F.struct("ds", "z"))).alias("pts"))
    )
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"),
                     F.array().cast("array<date>").alias("found"))

    def step(acc, p):
        up = F.greatest(F.lit(0.0), acc["up"] + p["z"] - drift)
        down = F.greatest(F.lit(0.0), acc["down"] - p["z"] - drift)
        hit = (up > threshold) | (down > threshold)
        return F.struct(
            F.when(hit, 0.0).otherwise(up).alias("up"),
            F.when(hit, 0.0).otherwise(down).alias("down"),
            F.when(hit, F.array_append(acc["found"], p["ds"])).otherwise(acc["found"]).alias("found"),
        )

    tail = F.slice("pts", 2, F.size("pts"))
    return points.select("series_id", F.explode(F.aggregate(tail, start, step, lambda a: a["found"]))
                         .alias("ds"))


# ---------------------------------------------------------------- decomposition

def decompose(series: DataFrame, period: int = 7) -> DataFrame:
    """Additive trend, seasonal and residual parts of series with two periods or more.

    The trend is a centred moving average (half weights at the ends of an even window),
    its missing ends continued by the line through the nearest ``period`` values.
    """
    h = period // 2
    idx = series.withColumns({
        "i": F.row_number().over(_by_ds()) - 1, "_n": F.count("*").over(_sid()),
    }).where(F.col("_n") >= 2 * period)
    if period % 2:
        raw = F.sum("y").over(_by_ds().rowsBetween(-h, h)) / period
    else:
        raw = (F.sum("y").over(_by_ds().rowsBetween(-(h - 1), h - 1))
               + (F.lag("y", h).over(_by_ds()) + F.lead("y", h).over(_by_ds())) / 2) / period
    inner = (F.col("i") >= h) & (F.col("i") <= F.col("_n") - 1 - h)
    t = idx.withColumn("t", F.when(inner, raw))
    front = (F.col("i") >= h) & (F.col("i") < h + period)
    back = (F.col("i") > F.col("_n") - 1 - h - period) & (F.col("i") <= F.col("_n") - 1 - h)

    def line(cond):
        x, y = F.when(cond, F.col("i").cast("double")), F.when(cond, F.col("t"))
        return F.regr_intercept(y, x).over(_sid()) + F.regr_slope(y, x).over(_sid()) * F.col("i")

    trend = F.when(F.col("i") < h, line(front)).when(
        F.col("i") > F.col("_n") - 1 - h, line(back)).otherwise(F.col("t"))
    d = t.withColumn("trend", trend).withColumn("_d", F.col("y") - F.col("trend"))
    phase = F.avg("_d").over(Window.partitionBy("series_id", F.pmod("i", F.lit(period))))
    d = d.withColumn("_s", phase)
    first = F.when(F.col("i") < period, F.col("_s"))
    return d.withColumn("seasonal", F.col("_s") - F.avg(first).over(_sid())).select(
        "series_id", "ds", F.col("y").alias("observed"), "trend", "seasonal",
        (F.col("y") - F.col("trend") - F.col("seasonal")).alias("residual"))


# ---------------------------------------------------------------- forecast

def _phase(freq: str):
    """Seasonal position of a period: weekday, week of a four-week cycle, or month."""
    if freq == "D":
        return F.dayofweek("ds")
    if freq == "W":
        return F.pmod(F.floor(F.unix_date("ds") / 7), F.lit(4)).cast("int")
    return F.month("ds")


def fit_forecast(series: DataFrame, periods: int = 90, freq: str = "D", changepoint: float = 0.05,
                 seasonality: float = 1.0, width: float = 0.95, min_points: int = 10) -> DataFrame:
    """Additive forecast: line plus seasonal means plus a normal interval.

    A closed-form stand-in for a Bayesian additive model, computed for every series by
    aggregates.  ``seasonality`` scales how much the seasonal means count against their
    sample size; ``changepoint`` is the share of the recent slope (last 30 points) in the
    future slope.  Seasonality needs more than 14 points.  ``periods`` counts periods of
    ``freq``.
    """
    z = NormalDist().inv_cdf(0.5 + width / 2)
    x = F.datediff("ds", F.col("_d0")).cast("double")
    hist = (
        series.withColumns({"_n": F.count("*").over(_sid()), "_d0": F.min("ds").over(_sid())})
        .where(F.col("_n") >= min_points)
        .withColumns({"x": x, "_back": F.row_number().over(_sid().orderBy(F.desc("ds")))})
    )
    recent = F.col("_back") <= 30
    hist = hist.withColumns({
        "_b": F.coalesce(F.regr_slope("y", "x").over(_sid()), F.lit(0.0)),
        "_a": F.regr_intercept("y", "x").over(_sid()),
        "_rb": F.coalesce(F.regr_slope(F.when(recent, F.col("y")), F.when(recent, F.col("x"))).over(_sid()),
                          F.lit(0.0)),
    }).withColumn("trend", F.col("_a") + F.col("_b") * F.col("x")).withColumn("phase", _phase(freq))
    ph = Window.partitionBy("series_id", "phase")
    k = F.count("*").over(ph)
    shrunk = F.avg(F.col("y") - F.col("trend")).over(ph) * k / (k + 1.0 / seasonality)
    hist = hist.withColumn("season", F.when(F.col("_n") > 14, shrunk).otherwise(0.0))
    hist = hist.withColumn("yhat", F.col("trend") + F.col("season")).withColumn(
        "_sd", F.stddev_samp(F.col("y") - F.col("yhat")).over(_sid()))
    past = hist.select("series_id", "ds", "y", "yhat", "trend", "_sd",
                       F.lit(False).alias("is_future"))

    model = hist.groupBy("series_id").agg(
        F.max("ds").alias("_last"), F.max_by("trend", "ds").alias("_t0"), F.max("_b").alias("_b"),
        F.max("_rb").alias("_rb"), F.max("_sd").alias("_sd"))
    season = hist.groupBy("series_id", "phase").agg(F.max("season").alias("season"))
    slope = (1 - changepoint) * F.col("_b") + changepoint * F.col("_rb")
    ahead = model.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(periods)))).withColumn(
        "ds", C.next_period_end(F.col("_last"), F.col("step"), freq)).withColumn(
        "phase", _phase(freq))
    future = (
        ahead.join(season, ["series_id", "phase"], "left")
        .withColumn("trend", F.col("_t0") + slope * F.datediff("ds", "_last"))
        .select("series_id", "ds", F.lit(None).cast("double").alias("y"),
                (F.col("trend") + F.coalesce("season", F.lit(0.0))).alias("yhat"), "trend", "_sd",
                F.lit(True).alias("is_future"))
    )
    margin = z * F.coalesce("_sd", F.lit(0.0))
    return past.unionByName(future).select(
        "series_id", "ds", "y", "yhat", (F.col("yhat") - margin).alias("yhat_lower"),
        (F.col("yhat") + margin).alias("yhat_upper"), "trend", "is_future")


def trend_analysis(forecast: DataFrame, as_of: str | None = None) -> DataFrame:
    """Slope of the last 30 trend points, volatility, 30/90-step values and alerts.

    The future starts after ``as_of``, by default after the last historical period.
    """
    last = F.max(F.when(~F.col("is_future"), F.col("ds"))).over(_sid())
    f = forecast.withColumns({
        "_as_of": F.lit(as_of).cast("date") if as_of else last,
        "_back": F.row_number().over(_sid().orderBy(F.desc("ds"))),
    }).withColumn("_fut", F.col("ds") > F.col("_as_of"))
    f = f.withColumn("_fi", F.sum(F.col("_fut").cast("int")).over(_prefix()) - 1)
    near = F.col("_back") <= 30
    g = f.groupBy("series_id").agg(
        F.coalesce(F.regr_slope(F.when(near, F.col("trend")),
                                F.when(near, -F.col("_back").cast("double"))), F.lit(0.0)).alias("slope"),
        F.stddev_samp("yhat").alias("volatility"),
        F.max_by("yhat", "ds").alias("current_sentiment"),
        F.max(F.when(F.col("_fut"), F.col("_fi"))).alias("_last_fi"),
        F.sort_array(F.collect_list(F.when(F.col("_fut"), F.struct("_fi", "yhat")))).alias("_path"),
        F.min(F.when(F.col("_fut") & (F.col("yhat") < 0), F.col("ds"))).alias("negative_from"),
    )

    def at(k):
        return F.get("_path", F.least(F.lit(k), F.col("_last_fi")).cast("int"))["yhat"]

    rapid = F.col("slope") < -0.02
    return g.select(
        "series_id",
        F.when(F.col("slope") > 0.01, "Improving").when(F.col("slope") < -0.01, "Declining")
        .otherwise("Stable").alias("trend_direction"),
        "slope", "volatility", "current_sentiment", at(30).alias("predicted_30"),
        at(90).alias("predicted_90"), "negative_from", rapid.alias("rapid_decline"),
        (F.col("negative_from").isNotNull().cast("int") + rapid.cast("int")).alias("alert_count"))


def forecast_anomalies(series: DataFrame, forecast: DataFrame) -> DataFrame:
    """History outside the forecast interval, with a score relative to its width."""
    bands = forecast.select("series_id", "ds", "yhat", "yhat_lower", "yhat_upper")
    y = F.col("y")
    return series.join(bands, ["series_id", "ds"], "left").withColumns({
        "is_anomaly": (y < F.col("yhat_lower")) | (y > F.col("yhat_upper")),
        "anomaly_score": F.abs(y - F.col("yhat"))
        / (F.col("yhat_upper") - F.col("yhat_lower") + 1e-6),
    })


def top_anomalies(series: DataFrame, forecast: DataFrame, n: int = 20) -> DataFrame:
    return (forecast_anomalies(series, forecast).where("is_anomaly")
            .orderBy(F.desc("anomaly_score"), "series_id", "ds").limit(n))


def batch_forecast(df: DataFrame, top: int = 5, periods: int = 90, freq: str = "D",
                   min_samples: int = 5) -> DataFrame:
    """Comparison table of the most mentioned aspects' forecasts."""
    names = (df.groupBy(ASPECT).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), ASPECT).limit(top).select(ASPECT))
    series = prepare_series(df.join(F.broadcast(names), ASPECT, "left_semi"), freq, min_samples)
    return trend_analysis(fit_forecast(series, periods, freq)).select(
        F.col("series_id").alias("aspect"), F.col("current_sentiment").alias("current"),
        F.col("trend_direction").alias("trend"), "slope", F.col("predicted_30").alias("forecast_30"),
        F.col("predicted_90").alias("forecast_90"), F.col("alert_count").alias("alerts"))


def forecast_report(df: DataFrame, periods: int = 90, freq: str = "D", min_samples: int = 5,
                    params: dict | None = None, model: str = "additive") -> DataFrame:
    """End-to-end result per aspect; a series that cannot be forecast says why.

    `model` is "additive" (line and seasonal means), "piecewise" (hinges and Fourier seasons) or "arima", whose result has the
    columns of `arima.arima_report`; `params` are those of the model.
    """
    from .additive import piecewise_forecast
    from .arima import arima_report

    if model == "arima":
        return arima_report(df, periods=periods, freq=freq, min_samples=min_samples, **(params or {}))
    fit = {"additive": fit_forecast, "piecewise": piecewise_forecast}[model]
    wide = period_means(df, freq)
    volume = wide.groupBy("series_id").agg(
        C.count_if(F.col("n") >= min_samples).alias("usable_periods"))
    series = materialize(prepare_series(df, freq, min_samples), "series")
    forecast = materialize(fit(series, periods, freq, **(params or {})), "forecast")
    points = series.groupBy("series_id").agg(F.count("*").alias("data_points"))
    breaks = changepoints(series).groupBy("series_id").agg(F.count("*").alias("changepoint_count"))
    odd = forecast_anomalies(series, forecast).groupBy("series_id").agg(
        C.count_if(F.coalesce("is_anomaly", F.lit(False))).alias("anomaly_count"))
    out = volume
    for part in (points, breaks, odd, trend_analysis(forecast)):
        out = out.join(part, "series_id", "left")
    ok = F.col("slope").isNotNull()
    few = F.format_string("Insufficient data after volume filtering: only %d periods with >=%d reviews",
                          F.col("usable_periods"), F.lit(min_samples))
    return out.withColumns({
        "success": ok,
        "error": F.when(ok, None).when(F.col("usable_periods") < 10, few)
        .otherwise("No continuous time segment found with sufficient data"),
    }).na.fill(0, ["data_points", "changepoint_count", "anomaly_count"])


PERIOD_DAYS = {"D": 1, "W": 7, "M": 28}


def forecast_backtest(series: DataFrame, holdout: int = 6, freq: str = "D", **params) -> DataFrame:
    """MAE and RMSE on the last ``holdout`` periods of each series.

    The horizon follows from the dates, so held-out points behind a gap are scored too.  ``held_out`` counts the
    points kept back, ``points`` those a forecast covers: 0 for a series whose rest is too short to fit.
    """
    back = F.row_number().over(_sid().orderBy(F.desc("ds")))
    split = materialize(series.withColumn("_back", back), "split")
    train = split.where(F.col("_back") > holdout).drop("_back")
    test = split.where(F.col("_back") <= holdout).select("series_id", "ds", "y")
    reach = split.groupBy("series_id").agg(F.datediff(
        F.max("ds"), F.max(F.when(F.col("_back") > holdout, F.col("ds")))).alias("days"))
    days = reach.agg(F.max("days")).scalar()
    steps = F.ceil(F.coalesce(days, F.lit(0)) / PERIOD_DAYS[freq])
    horizon = max(holdout, split.sparkSession.range(1).select(steps).first()[0])
    pred = fit_forecast(train, horizon, freq, **params).where("is_future").select(
        "series_id", "ds", "yhat")
    err = F.col("y") - F.col("yhat")
    return test.join(pred, ["series_id", "ds"], "left").groupBy("series_id").agg(
        F.count("*").alias("held_out"), F.count("yhat").alias("points"), F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"))
