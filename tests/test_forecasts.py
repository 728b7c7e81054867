"""Forecast models against plain numpy on literal series."""

import datetime as dt

import numpy as np
import pytest

from opinara.operators import additive, arima, series

DAY = dt.date(1970, 1, 1)


def frame(spark, values, start=dt.date(2020, 1, 1), step=1, name="a"):
    rows = [(name, start + dt.timedelta(days=step * i), float(y), 9) for i, y in enumerate(values)]
    return spark.createDataFrame(rows, "series_id string, ds date, y double, n long").repartition(3)


def solved(values, start, changepoint=0.05, seasonality=1.0):
    """Weights by penalised least squares on stacked rows, instead of the summed Gram matrix."""
    day = np.array([(start + dt.timedelta(days=i) - DAY).days for i in range(len(values))], float)
    y = np.asarray(values, float)
    scale = np.abs(y).max() or 1.0
    hinges = min(25, int(len(y) * 0.8) - 1)
    weekly, yearly = len(y) > 14, len(y) > 365
    x, trend = additive.design(day, day[0], day[-1], hinges, weekly, yearly)
    line = np.polyfit(day - day[0], y / scale, 1)
    noise = max(np.mean((y / scale - np.polyval(line, day - day[0])) ** 2), 1e-9)
    root = np.sqrt(additive.penalties(x.shape[1], hinges, noise, changepoint, seasonality))
    beta = np.linalg.lstsq(np.vstack([x, np.diag(root)]), np.concatenate([y / scale, np.zeros(len(root))]), rcond=None)[0]
    return day, beta * scale, (day[0], day[-1], hinges, weekly, yearly), trend


def test_weights_equal_stacked_least_squares(spark):
    """800 days: a bend, a week and a year, noise; all columns are in use."""
    rng, t = np.random.default_rng(1), np.arange(800)
    y = 0.3 + 0.001 * t - 0.003 * np.maximum(0, t - 300) + 0.2 * np.sin(2 * np.pi * t / 7) + 0.3 * np.cos(2 * np.pi * t / 365.25)
    y += rng.normal(size=800) * 0.05
    start = dt.date(2020, 1, 1)
    day, beta, meta, trend = solved(y, start)
    out = additive.piecewise_forecast(frame(spark, y), 60).orderBy("ds").collect()
    ahead = np.concatenate([day, day[-1] + np.arange(1, 61)])
    x, _ = additive.design(ahead, *meta)
    assert [r["yhat"] for r in out] == pytest.approx(x @ beta, abs=1e-7)
    assert [r["trend"] for r in out] == pytest.approx(x[:, :trend] @ beta[:trend], abs=1e-7)
    assert [r["is_future"] for r in out] == [False] * 800 + [True] * 60 and x.shape[1] == 2 + 25 + 6 + 20
    t = np.arange(800, 860)     # the bend and both seasons go on
    want = 0.3 + 0.001 * t - 0.003 * (t - 300) + 0.2 * np.sin(2 * np.pi * t / 7) + 0.3 * np.cos(2 * np.pi * t / 365.25)
    assert np.abs(np.array([r["yhat"] for r in out[800:]]) - want).max() < 0.15
    widths = [r["yhat_upper"] - r["yhat_lower"] for r in out]
    assert widths[0] == pytest.approx(widths[799]) and widths[-1] > widths[800] > widths[799]


def test_seasons_follow_the_number_of_points(spark):
    def used(n, **params):
        r = additive.fit_piecewise(frame(spark, np.sin(np.arange(n))), **params).first()
        return r["weekly"], r["yearly"], r["hinges"], len(r["weights"])

    assert used(14) == (False, False, 10, 12) and used(15) == (True, False, 11, 19)
    assert used(365) == (True, False, 25, 33) and used(366) == (True, True, 25, 53)
    assert used(20, weekly=False, yearly=True, hinges=3) == (False, True, 3, 25)


def test_stronger_priors_move_less(spark):
    y = np.where(np.arange(200) < 100, 0.0, 1.0) + 0.3 * np.sin(2 * np.pi * np.arange(200) / 7)
    def model(**p):
        return additive.fit_piecewise(frame(spark, y), **p).first()
    assert model(changepoint=0.001)["change"] < model(changepoint=0.5)["change"]
    weak, strong = (model(seasonality=s)["weights"][-6:] for s in (10.0, 0.01))
    assert np.abs(strong).sum() < np.abs(weak).sum()


def test_constant_short_and_broken_series(spark):
    data = (frame(spark, [0.5] * 40).unionByName(frame(spark, [0.0] * 20, name="zero")).unionByName(
        frame(spark, [1.0] * 9, name="short")).unionByName(frame(spark, [0.1] * 12, step=0, name="one day")))
    out = additive.piecewise_forecast(data, 5).collect()
    assert {r["series_id"] for r in out} == {"a", "zero"}
    assert all(r["yhat"] == pytest.approx(0.5 if r["series_id"] == "a" else 0.0, abs=1e-6) for r in out)
    assert additive.piecewise_forecast(data.limit(0), 5).collect() == []


def test_several_batches_add_up(spark, monkeypatch):
    """A series that is spread over many Arrow batches has the weights of one."""
    y = np.cumsum(np.random.default_rng(3).normal(size=120))
    one = additive.fit_piecewise(frame(spark, y)).first()["weights"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        many = additive.fit_piecewise(frame(spark, y)).first()["weights"]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    assert many == pytest.approx(one, rel=1e-9, abs=1e-9)


def test_trend_and_anomalies_take_the_forecast(spark):
    y = np.linspace(1, -1, 60)
    y[30] = 3.0
    s = frame(spark, y)
    forecast = additive.piecewise_forecast(s, 30)
    trend = series.trend_analysis(forecast).first()
    assert trend["trend_direction"] == "Declining" and trend["negative_from"] is not None
    odd = series.forecast_anomalies(s, forecast).where("is_anomaly").collect()
    assert [r["ds"] for r in odd] == [dt.date(2020, 1, 31)]


# ---------------------------------------------------------------- ARIMA

def explicit_shocks(w, c, short, seasonal, theta, season_theta, s):
    """Shocks of a product model, lag by lag."""
    start, e = len(short) + len(seasonal) * s, {}
    own = [1.0, *(-x for x in short)], [1.0, *(-x for x in seasonal)]
    past = [1.0, *theta], [1.0, *season_theta]
    for t in range(start, len(w)):
        x = sum(a * b * w[t - i - j * s] for i, a in enumerate(own[0]) for j, b in enumerate(own[1])) - c
        x -= sum(a * b * e.get(t - i - j * s, 0.0) for i, a in enumerate(past[0]) for j, b in enumerate(past[1]) if i or j)
        e[t] = x
    return e


def simulated(n, c, short, seasonal, theta, season_theta, s, seed):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n + 100), []
    for t in range(n + 100):
        at = lambda i: w[i] if i >= 0 else 0.0
        x = c + e[t] + theta * (e[t - 1] if t else 0) + season_theta * (e[t - s] if t >= s else 0)
        x += theta * season_theta * (e[t - s - 1] if t > s else 0)
        w.append(x + short * at(t - 1) + seasonal * at(t - s) - short * seasonal * at(t - s - 1))
    return np.array(w[100:])


def test_product_models_multiply_their_polynomials():
    rng = np.random.default_rng(0)
    w = rng.normal(size=60)
    model = arima._Model(w, (2, 1, 1, 1), 4)
    many = rng.uniform(-0.8, 0.8, (5, model.size))
    got = model.shocks(many)
    for i, v in enumerate(many):
        want = explicit_shocks(w, v[0], v[1:3], v[3:4], v[4:5], v[5:6], 4)
        assert got[:, i] == pytest.approx(list(want.values()), abs=1e-10)
    short = arima._invertible(np.array([0.99, -0.99, 0.5]))
    assert (np.abs(np.roots([1.0, *short])) < 1).all()


def test_seasonal_fit_is_a_minimum():
    """No vector of a wide random search, each polished coordinate by coordinate, has fewer squares."""
    truth = (0.2, 0.6, 0.5, 0.4, 0.3)
    w = simulated(400, *truth, 4, 5)
    model = arima._Model(w, (1, 1, 1, 1), 4)
    fitted = model.fit()

    def cost(v):
        return sum(x * x for x in explicit_shocks(w, v[0], v[1:2], v[2:3], v[3:4], v[4:5], 4).values())

    best = cost(fitted)
    rng = np.random.default_rng(2)
    starts = [np.array(truth), *rng.uniform(-0.9, 0.9, (4, 5))]
    for v in starts:
        step = 0.2
        now = (model.shocks(v[None]) ** 2).sum()
        while step > 1e-5:
            moves = np.vstack([v + step * x for x in (*np.eye(5), *-np.eye(5))])
            moves[:, 3:] = moves[:, 3:].clip(-arima.EDGE, arima.EDGE)
            costs = (model.shocks(moves) ** 2).sum(axis=0)
            if costs.min() < now:
                now, v = costs.min(), moves[costs.argmin()]
            else:
                step /= 2
        assert best <= now + 1e-6
    assert fitted == pytest.approx(truth, abs=0.25)


def test_seasonal_forecast_follows_the_recursion():
    w = simulated(120, 0.1, 0.5, 0.3, 0.4, 0.2, 6, 9)
    model = arima._Model(w, (1, 1, 1, 1), 6)
    c, short, seasonal, theta, season_theta = model.fit()
    e = explicit_shocks(w, c, [short], [seasonal], [theta], [season_theta], 6)
    path = list(w)
    for t in range(120, 130):
        path.append(c + short * path[t - 1] + seasonal * path[t - 6] - short * seasonal * path[t - 7] + theta * e.get(t - 1, 0)
                    + season_theta * e.get(t - 6, 0) + theta * season_theta * e.get(t - 7, 0))
    mean, low, high = arima.forecast_values(w, (1, 0, 1), (1, 0, 1, 6), 10)
    assert mean == pytest.approx(path[120:], abs=1e-9)
    sigma = np.sqrt(np.mean(np.square(list(e.values()))))
    assert (high - mean)[0] == pytest.approx(1.959963985 * sigma) and ((high - low)[1:] >= (high - low)[:-1] - 1e-12).all()


def test_noise_around_a_mean_keeps_shocks_invertible():
    y = np.random.default_rng(4).normal(size=200)
    w = np.diff(y)
    v = arima._Model(w, (1, 0, 1, 0), 0).fit()
    assert v[2] == pytest.approx(-arima.EDGE, abs=0.1) and abs(v[2]) <= arima.EDGE


def test_report_by_model(spark):
    """Three models over the same mentions; too short a series says why under each."""
    rng = np.random.default_rng(8)
    rows = [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(rng.normal() * 0.1 - 0.01 * i)) for i in range(60) for _ in range(5)]
    rows += [("b", dt.date(2020, 1, 1), 0.5)] * 9
    df = spark.createDataFrame(rows, "aspect_term_normalized string, date date, sentiment_score double")
    got = {m: {r["series_id"]: r for r in series.forecast_report(df, 20, "D", 5, model=m).collect()}
           for m in ("additive", "piecewise", "arima")}
    for m, by in got.items():
        assert by["a"]["success"] and by["a"]["error"] is None and by["a"]["data_points"] == 60
        assert not by["b"]["success"] and by["b"]["error"].startswith("Insufficient data")
    assert got["additive"]["a"]["slope"] != got["piecewise"]["a"]["slope"]
    assert got["arima"]["b"]["error"] == "Insufficient data: only 0 data points (need at least 10)"
    assert got["arima"]["a"]["turns_negative"] and got["arima"]["a"]["anomaly_count"] == 0
    with pytest.raises(KeyError):
        series.forecast_report(df, model="other")
