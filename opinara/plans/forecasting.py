"""Registered queries: time series and forecasts."""

from __future__ import annotations

from statistics import NormalDist

from ..operators import additive, arima, series as ts
from ..session import materialize
from . import base_sql as B
from .registry import clean, query, rounded, table

A = "aspect_term_normalized"
Z95 = NormalDist().inv_cdf(0.975)


def _label(freq):
    return {"D": "date", "W": "week + 6", "M": "last_day(date)"}[freq]


def prep_cte(freq: str, min_samples: int, method: str = "additive") -> str:
    gap = ts.MAX_GAP_DAYS[freq]
    keep = ("abs(y - mu) <= 3 * sd" if method == "additive" else "abs(y - mu) / nullif(sp, 0) < 3")
    return (
        f"pm as materialized (select {A} as series_id, {_label(freq)} as ds, round(avg("
        f"sentiment_score), 9) as y, count(*) as n from clean group by 1, 2), "
        f"vf as (select * from pm where n >= {min_samples} qualify count(*) over (partition by "
        "series_id) >= 10), "
        "st as (select *, avg(y) over w as mu, stddev_samp(y) over w as sd, stddev_pop(y) over w as sp "
        "from vf window w as (partition by series_id)), "
        f"ol as (select series_id, ds, y, n from st where {keep}), "
        f"gp as (select *, cast(coalesce(ds - lag(ds) over (partition by series_id order by ds) > {gap}, "
        "false) as integer) as nw from ol), "
        "sg as materialized (select series_id, ds, y, n, cast(sum(nw) over (partition by series_id "
        "order by ds) as integer) as segment from gp), "
        "sz as (select series_id, segment, count(*) as k from sg group by 1, 2), "
        "bs as (select series_id, segment, k, count(*) over (partition by series_id) as segs from sz "
        "qualify row_number() over (partition by series_id order by k desc, segment) = 1), "
        "ser as materialized (select series_id, ds, y, n from sg join bs using (series_id, segment) "
        "where segs = 1 or k >= 10) "
    )


def _weekly(spark, sf):
    return ts.prepare_series(clean(spark, sf), "W", 3)


def _monthly(spark, sf):
    return ts.prepare_series(clean(spark, sf), "M", 5)


@query("prepare_series", B.CLEAN_MORE + prep_cte("W", 3) + "select * from ser")
def _(spark, sf):
    return _weekly(spark, sf)


@query("prepare_series_arima", B.CLEAN_MORE + prep_cte("M", 5, "arima") + "select * from ser")
def _(spark, sf):
    return ts.prepare_series(clean(spark, sf), "M", 5, method="arima")


@query("series_segments", B.CLEAN_MORE + prep_cte("W", 5) + "select * from sg")
def _(spark, sf):
    return (ts.period_means(clean(spark, sf), "W").transform(ts.volume_filter, 5)
            .transform(ts.three_sigma).transform(ts.segments, "W"))


@query("longest_segment", B.CLEAN_MORE + prep_cte("W", 5) + "select series_id, count(*) as points, "
       "min(ds) as first_ds, max(ds) as last_ds from ser group by 1")
def _(spark, sf):
    from pyspark.sql import functions as F

    return ts.prepare_series(clean(spark, sf), "W", 5).groupBy("series_id").agg(
        F.count("*").alias("points"), F.min("ds").alias("first_ds"), F.max("ds").alias("last_ds"))


@query("series_quality", B.CLEAN_MORE + prep_cte("W", 5) + ", wh as (select series_id, cast((max(ds) - "
       "min(ds)) / 7 + 1 as bigint) as total_periods from pm group by 1), kp as (select *, cast("
       "coalesce(ds - lag(ds) over (partition by series_id order by ds) > 28, false) as integer) as nw "
       "from pm where n >= 5), ks as (select *, sum(nw) over (partition by series_id order by ds) as "
       "segment from kp), rn as (select series_id, segment, count(*) as k, sum(n) as n from ks group by "
       "1, 2), q as (select series_id, cast(sum(k) as bigint) as periods_with_data, max(k) as "
       "longest_segment, cast(sum(n) as bigint) as mentions from rn group by 1) select *, round(100.0 * "
       "periods_with_data / total_periods, 6) as coverage_pct, round(100.0 * longest_segment / "
       "total_periods, 6) as continuity_pct, round(mentions / periods_with_data, 6) as avg_volume "
       "from wh join q using (series_id)")
def _(spark, sf):
    return rounded(ts.series_quality(ts.period_means(clean(spark, sf), "W"), "W", 5), 6)


CUSUM = (
    ", zs as materialized (select series_id, ds, round((y - avg(y) over w) / "
    "stddev_pop(y) over w, 9) as z, row_number() over (partition by series_id order by ds) as i "
    "from ser window w as (partition by series_id) qualify count(*) over (partition by series_id) "
    ">= 10 and stddev_pop(y) over (partition by series_id) > 0), "
    "cs as (select series_id, i, 0.0::double as up, 0.0::double as down, false as hit from zs where "
    "i = 1 union all select n.series_id, n.i, case when h then 0 else u end, case when h then 0 else "
    "d end, h from (select zs.series_id, zs.i, greatest(0, up + z - 0.5) as u, greatest(0, down - z "
    "- 0.5) as d, greatest(0, up + z - 0.5) > 3 or greatest(0, down - z - 0.5) > 3 as h from cs join "
    "zs on zs.series_id = cs.series_id and zs.i = cs.i + 1) n) ")
CLEAN_RECURSIVE = B.CLEAN_MORE.replace("with ", "with recursive ", 1)


@query("changepoints", CLEAN_RECURSIVE + prep_cte("W", 3) + CUSUM +
       "select series_id, ds from cs join zs using (series_id, i) where hit")
def _(spark, sf):
    return ts.changepoints(_weekly(spark, sf))


def decompose_cte(period: int) -> str:
    h = period // 2
    if period % 2:
        raw = f"sum(y) over (w rows between {h} preceding and {h} following) / {period}"
    else:
        raw = (f"(sum(y) over (w rows between {h - 1} preceding and {h - 1} following) + "
               f"(lag(y, {h}) over w + lead(y, {h}) over w) / 2) / {period}")
    front = f"i >= {h} and i < {h + period}"
    back = f"i > n - 1 - {h + period} and i <= n - 1 - {h}"
    return (
        f", ix as (select series_id, ds, y, cast(row_number() over w - 1 as double) as i, count(*) over "
        f"(partition by series_id) as n from ser window w as (partition by series_id order by ds)), "
        f"tr as (select *, case when i >= {h} and i <= n - 1 - {h} then {raw} end as t from ix where n "
        f">= {2 * period} window w as (partition by series_id order by ds)), "
        f"ln as (select series_id, regr_slope(t, i) filter (where {front}) as fb, regr_intercept(t, i) "
        f"filter (where {front}) as fa, regr_slope(t, i) filter (where {back}) as bb, "
        f"regr_intercept(t, i) filter (where {back}) as ba from tr group by 1), "
        f"dt as (select series_id, ds, y, i, case when i < {h} then fa + fb * i when i > n - 1 - {h} "
        "then ba + bb * i else t end as trend from tr join ln using (series_id)), "
        f"ph as (select series_id, i % {period} as p, avg(y - trend) as s from dt group by 1, 2), "
        "ce as (select series_id, avg(s) as m from ph group by 1) "
        "select series_id, ds, round(y, 6) as observed, round(trend, 6) as trend, round(s - m, 6) as "
        "seasonal, round(y - trend - (s - m), 6) as residual from dt join ph on ph.series_id = "
        f"dt.series_id and p = i % {period} join ce on ce.series_id = dt.series_id"
    ).replace("select series_id, ds, round(y", "select dt.series_id, ds, round(y")


@query("decompose", B.CLEAN_MORE + prep_cte("W", 3) + decompose_cte(4))
def _(spark, sf):
    return rounded(ts.decompose(_weekly(spark, sf), 4), 6)


@query("decompose_odd", B.CLEAN_MORE + prep_cte("W", 3) + decompose_cte(7))
def _(spark, sf):
    return rounded(ts.decompose(_weekly(spark, sf), 7), 6)


def forecast_cte(periods: int, source: str = "ser") -> str:
    """Monthly additive forecast."""
    return (
        f", fx as (select series_id, ds, y, count(*) over w as n, cast(ds - min(ds) over w as double) as "
        f"x, row_number() over (partition by series_id order by ds desc) as bk from {source} window w as "
        "(partition by series_id)), "
        "fm as (select series_id, regr_slope(y, x) as b, regr_intercept(y, x) as a, "
        "regr_slope(y, x) filter (where bk <= 30) as rb, count(*) as n from fx group by 1 having "
        "count(*) >= 10), "
        "ft as (select fx.series_id, ds, y, a + b * x as trend, month(ds) as phase, fm.n, b, rb from fx "
        "join fm on fm.series_id = fx.series_id), "
        "fs as (select series_id, phase, case when max(n) > 14 then avg(y - trend) * count(*) / "
        "(count(*) + 1.0) else 0 end as season from ft group by 1, 2), "
        "fh as (select ft.series_id, ds, y, trend + season as yhat, trend from ft join fs on "
        "ft.series_id = fs.series_id and ft.phase = fs.phase), "
        "fv as (select series_id, stddev_samp(y - yhat) as sd from fh group by 1), "
        "fl as (select series_id, max(ds) as last, arg_max(trend, ds) as t0, max(b) as b, max(rb) as rb "
        "from ft group by 1), "
        "ff as (select series_id, last_day(last + to_months(cast(step as integer))) as ds, last, t0, b, "
        f"rb from (select *, unnest(range(1, {periods + 1})) as step from (select series_id, "
        "cast(date_trunc('month', last) as date) as last, last as real_last, t0, b, rb from fl))), "
        "fu as (select ff.series_id, ff.ds, cast(null as double) as y, ff.t0 + (0.95 * ff.b + 0.05 * "
        "ff.rb) * (ff.ds - fl.last) + coalesce(season, 0) as yhat, ff.t0 + (0.95 * ff.b + 0.05 * ff.rb) "
        "* (ff.ds - fl.last) as trend from ff join fl on fl.series_id = ff.series_id left join fs on "
        "fs.series_id = ff.series_id and fs.phase = month(ff.ds)), "
        "fc as materialized (select series_id, ds, y, yhat, yhat - "
        f"{Z95!r} * sd as yhat_lower, yhat + {Z95!r} * sd as yhat_upper, trend, is_future from "
        "(select *, false as is_future from fh union all select *, true from fu) join fv using "
        "(series_id)) "
    )


FC = B.CLEAN_MORE + prep_cte("M", 5) + forecast_cte(12)
FC_COLS = ("series_id, ds, round(y, 6) as y, round(yhat, 6) as yhat, round(yhat_lower, 6) as "
           "yhat_lower, round(yhat_upper, 6) as yhat_upper, round(trend, 6) as trend, is_future")


def _forecast(spark, sf):
    return ts.fit_forecast(_monthly(spark, sf), 12, "M")


@query("forecast_additive", FC + f"select {FC_COLS} from fc")
def _(spark, sf):
    return rounded(_forecast(spark, sf), 6)


TREND = (
    ", fr as (select *, row_number() over (partition by series_id order by ds desc) as bk, sum(cast("
    "is_future as integer)) over (partition by series_id order by ds) - 1 as fi from fc), "
    "tg as (select series_id, regr_slope(trend, -bk) filter (where bk <= 30) as slope, "
    "stddev_samp(yhat) as volatility, arg_max(yhat, ds) as cur, max(fi) filter (where is_future) as lf, "
    "min(ds) filter (where is_future and yhat < 0) as negative_from from fr group by 1), "
    "ta as (select series_id, case when slope > 0.01 then 'Improving' when slope < -0.01 then "
    "'Declining' else 'Stable' end as trend_direction, round(slope, 6) as slope, round(volatility, 6) "
    "as volatility, round(cur, 6) as current_sentiment, round((select yhat from fr where is_future and "
    "fr.series_id = tg.series_id and fi = least(30, lf)), 6) as predicted_30, round((select yhat from "
    "fr where is_future and fr.series_id = tg.series_id and fi = least(90, lf)), 6) as predicted_90, "
    "negative_from, slope < -0.02 as rapid_decline, cast(negative_from is not null as integer) + "
    "cast(slope < -0.02 as integer) as alert_count from tg) ")


@query("trend_analysis", FC + TREND + "select * from ta")
def _(spark, sf):
    return rounded(ts.trend_analysis(_forecast(spark, sf)), 6)


@query("forecast_anomalies", FC + "select series_id, ds, ser.y, n, round(yhat, 6) as yhat, "
       "round(yhat_lower, 6) as yhat_lower, round(yhat_upper, 6) as yhat_upper, ser.y < yhat_lower or "
       "ser.y > yhat_upper as is_anomaly, round(abs(ser.y - yhat) / (yhat_upper - yhat_lower + 1e-6), "
       "6) as anomaly_score from ser left join fc using (series_id, ds)")
def _(spark, sf):
    s = materialize(_monthly(spark, sf), "series")
    out = rounded(ts.forecast_anomalies(s, ts.fit_forecast(s, 12, "M")).drop("y"), 6)
    return out.join(s.select("series_id", "ds", "y"), ["series_id", "ds"])


@query("batch_forecast", B.CLEAN_MORE + prep_cte("M", 5) + f", tp as (select {A} as series_id from "
       "clean group by 1 order by count(*) desc, 1 limit 5), s5 as (select ser.* from ser semi join tp "
       "using (series_id))" + forecast_cte(24, "s5") + TREND +
       "select series_id as aspect, current_sentiment as current, trend_direction as trend, slope, "
       "predicted_30 as forecast_30, predicted_90 as forecast_90, alert_count as alerts from ta")
def _(spark, sf):
    return rounded(ts.batch_forecast(table(clean(spark, sf), A, "date", "sentiment_score"), 5, 24, "M"), 6)


@query("forecast_report", CLEAN_RECURSIVE + prep_cte("M", 5) + CUSUM + forecast_cte(12) + TREND +
       ", vo as (select series_id, count(*) filter (where n >= 5) as usable_periods from pm group by 1), "
       "dp as (select series_id, count(*) as data_points from ser group by 1), cp as (select series_id, "
       "count(*) as k from cs where hit group by 1), ac as (select series_id, count(*) filter (where "
       "ser.y < yhat_lower or ser.y > yhat_upper) as k from ser join fc using (series_id, ds) group by 1) "
       "select series_id, usable_periods, coalesce(data_points, 0) as data_points, coalesce(cp.k, 0) as "
       "changepoint_count, coalesce(ac.k, 0) as anomaly_count, ta.* exclude (series_id), ta.slope is not "
       "null as success, case when ta.slope is not null then null when usable_periods < 10 then "
       "'Insufficient data after volume filtering: only ' || usable_periods || ' periods with >=5 reviews' "
       "else 'No continuous time segment found with sufficient data' end as error from vo left join dp "
       "using (series_id) left join cp using (series_id) left join ac using (series_id) left join ta using "
       "(series_id)")
def _(spark, sf):
    return rounded(ts.forecast_report(table(clean(spark, sf), A, "date", "sentiment_score"), 12, "M", 5), 6)


def piecewise_cte(freq: str, periods: int) -> str:
    """Piecewise additive forecast: columns, normal equations, elimination column by column, predictions."""
    t = "((day - d0) / (d1 - d0))"
    pairs = [("n > 14", 7.0, 3), ("n > 365", 365.25, 10)]
    waves = [f"case when {used} then list_transform(range(1, {k + 1}), lambda k: {fn}(2 * pi() * day * k / {period})) else [] end"
             for used, period, k in pairs for fn in ("sin", "cos")]
    columns = (f"list_concat([1.0::double, {t}], list_transform(range(1, hinges + 1), lambda j: greatest(0.0, {t} - 0.8 * j / "
               f"(hinges + 1))), {', '.join(waves)})")
    ahead = {"D": "last + cast(step as integer)", "W": "last + cast(7 * step as integer)",
             "M": "last_day(cast(date_trunc('month', last) as date) + to_months(cast(step as integer)))"}[freq]
    return (
        ", mt as (select series_id, ds, y, cast(ds - date '1970-01-01' as double) as day from ser), "
        "mm as (select series_id, min(day) as d0, max(day) as d1, max(ds) as last, count(*) as n, case when max(abs(y)) > 0 then "
        "max(abs(y)) else 1.0 end as scale, greatest(0, regr_syy(y, day) - regr_sxy(y, day) * regr_sxy(y, day) / "
        "regr_sxx(y, day)) / count(*) as sq, least(25, cast(floor(count(*) * 0.8) - 1 as integer)) as hinges from mt group by 1 "
        "having count(*) >= 10), "
        f"xs as materialized (select series_id, ds, y, {columns} as x from mt join mm using (series_id)), "
        "cl as materialized (select series_id, i, list(x[i] order by ds) as c from xs, lateral (select unnest(range(1, len(x) + "
        "1)) as i) group by 1, 2), "
        "ys as (select series_id, list(y / scale order by ds) as c from xs join mm using (series_id) group by 1), "
        "gm as (select a.series_id, a.i, list(list_dot_product(a.c, b.c) + case when a.i = b.i and a.i > 2 then "
        "greatest(sq / (scale * scale), 1e-9) / case when a.i <= 2 + hinges then 0.05 * 0.05 else 1.0 end else 0 end order by "
        "b.i) as g, any_value(list_dot_product(a.c, ys.c)) as b from cl a join cl b on a.series_id = b.series_id join ys on "
        "ys.series_id = a.series_id join mm on mm.series_id = a.series_id group by 1, 2), "
        "gj as (select series_id, 0::bigint as k, list(list_append(g, b) order by i) as m from gm group by 1 union all "
        "select series_id, k + 1, list_transform(m, lambda r, i: case when i = k + 1 then p else list_transform(r, lambda v, c: "
        "v - r[k + 1] * p[c]) end) from (select *, list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) as p from gj where "
        "k < len(m)) as reduced), "
        "be as materialized (select series_id, list_transform(m, lambda r: r[len(r)]) as beta from gj where k = len(m)), "
        "de as (select series_id, sqrt(avg(pow(y - scale * list_dot_product(x, beta), 2))) as dev, any_value(case when hinges > 0 "
        "then scale * list_avg(list_transform(beta[3:2 + hinges], lambda b: abs(b))) else 0 end) as chg from xs join be using "
        "(series_id) join mm using (series_id) group by 1), "
        f"fd as (select series_id, {ahead} as ds, null::double as y, true as is_future from mm, range(1, {periods + 1}) as s(step)), "
        "al as (select *, cast(ds - date '1970-01-01' as double) as day from (select series_id, ds, y, false as is_future from xs "
        "union all select * from fd) join mm using (series_id)), "
        f"pr as (select series_id, ds, y, is_future, scale * list_dot_product({columns}, beta) as yhat, scale * list_dot_product("
        f"{columns}[1:2 + hinges], beta[1:2 + hinges]) as trend, {Z95!r} * sqrt(dev * dev + 2 * chg * chg * hinges / 0.8 * "
        "pow(greatest(0, (day - d1) / (d1 - d0)), 3) / 3) as margin from al join be using (series_id) join de using (series_id)) "
        "select series_id, ds, round(y, 6) as y, round(yhat, 6) as yhat, round(yhat - margin, 6) as yhat_lower, "
        "round(yhat + margin, 6) as yhat_upper, round(trend, 6) as trend, is_future from pr")


for _name, _freq, _least, _periods in (("daily", "D", 1, 90), ("weekly", "W", 3, 26), ("monthly", "M", 5, 12)):
    @query(f"forecast_piecewise_{_name}", CLEAN_RECURSIVE + prep_cte(_freq, _least) + piecewise_cte(_freq, _periods))
    def _(spark, sf, freq=_freq, least=_least, periods=_periods):
        s = materialize(ts.prepare_series(clean(spark, sf), freq, least), "series")
        return rounded(additive.piecewise_forecast(s, periods, freq), 6)


@query("forecast_backtest", B.CLEAN_MORE + prep_cte("M", 5) + ", bk as (select *, row_number() over "
       "(partition by series_id order by ds desc) as back from ser), trn as (select series_id, ds, y from "
       "bk where back > 6)" + forecast_cte(48, "trn") + "select bk.series_id, count(*) as held_out, "
       "count(yhat) as points, "
       "round(avg(abs(bk.y - yhat)), 6) as mae, round(sqrt(avg((bk.y - yhat) * (bk.y - yhat))), 6) as rmse "
       "from bk left join fc on fc.series_id = bk.series_id and fc.ds = bk.ds and is_future where back <= 6 "
       "group by 1")
def _(spark, sf):
    return rounded(ts.forecast_backtest(_monthly(spark, sf), 6, "M"), 6)


def _filtered(x: str) -> str:
    """`x` divided by the shocks' polynomial 1 + th B."""
    return (f"list_transform(range(1, len({x}) + 1), lambda t: list_sum(list_transform(range(0, t), lambda k: "
            f"pow(-th, k) * {x}[t - k])))")


def _at_shock(source: str) -> str:
    """For each row's `th`: the other coefficients by least squares, the shocks, their squares and the slope of that in th."""
    return (
        f"(select *, list_dot_product(e, e) as s, -list_dot_product(e, {_filtered('le')}) as g from (select *, list_prepend("
        "0.0::double, e[1:len(e) - 1]) as le from (select *, list_transform(fy, lambda v, i: v - c * fa[i] - phi * fb[i]) as e "
        "from (select *, (ay * bb - bt * ab) / (aa * bb - ab * ab) as c, (bt * aa - ay * ab) / (aa * bb - ab * ab) as phi from ("
        "select *, list_dot_product(fa, fa) as aa, list_dot_product(fa, fb) as ab, list_dot_product(fb, fb) as bb, "
        "list_dot_product(fa, fy) as ay, list_dot_product(fb, fy) as bt from (select *, "
        f"{_filtered('x')} as fy, {_filtered('o')} as fa, {_filtered('l')} as fb from {source}) as q1) as q2) as q3) as q4) as q5)")


# ARIMA(1,1,1): the shocks' weight by a grid, then by halving where the slope of the squares changes its sign.
ARIMA_111 = (
    CLEAN_RECURSIVE + prep_cte("M", 5, "arima") + ", d as (select series_id, ds, y, y - lag(y) over (partition by series_id order "
    "by ds) as d from ser), wl as (select series_id, max(ds) as last, arg_max(y, ds) as y0, count(*) as n, list(d order by ds) "
    "filter (where d is not null) as w from d group by 1), "
    "se as materialized (select series_id, last, y0, w[len(w)] as d0, w[2:len(w)] as x, w[1:len(w) - 1] as l, "
    "list_transform(w[2:len(w)], lambda v: 1.0::double) as o from wl where n >= 10), "
    f"gr as (select * from {_at_shock('(select se.*, (i - 9) / 10.0::double as th from se, range(0, 19) as r(i)) as starts')} as q "
    "qualify row_number() over (partition by series_id order by s) = 1), "
    "bi as (select series_id, last, y0, d0, x, l, o, greatest(-0.99, th - 0.1) as lo, least(0.99, th + 0.1) as hi, 0 as step from gr "
    "union all select series_id, last, y0, d0, x, l, o, case when g > 0 then lo else th end, case when g > 0 then th else hi end, "
    f"step + 1 from {_at_shock('(select *, (lo + hi) / 2 as th from bi where step < 60) as halves')} as q), "
    f"ft as materialized (select * from {_at_shock('(select *, (lo + hi) / 2 as th from bi where step = 60) as ends')} as q), "
    "ah as (select series_id, 0 as step, y0 as y, d0 as d, e[len(e)] as shock, 0.0::double as cum, 1.0::double as psi, 0.0::double as "
    "v, sqrt(s / len(e)) as sd, c, phi, th, last from ft union all select series_id, step + 1, y + c + phi * d + th * shock, c + phi "
    "* d + th * shock, 0.0::double, cum + psi, case when step = 0 then phi + th else psi * phi end, v + (cum + psi) * (cum + psi), sd, "
    "c, phi, th, last from ah where step < 12), "
    "fa as materialized (select series_id, last_day(cast(date_trunc('month', last) as date) + to_months(cast(step as integer))) as "
    f"ds, cast(step as integer) as step, y as yhat, y - {Z95!r} * sd * sqrt(v) as yhat_lower, y + {Z95!r} * sd * sqrt(v) as "
    "yhat_upper, null::varchar as error from ah where step > 0 union all select series_id, null, null, null, null, null, n || "
    "' points, at least 10 are needed' from wl where n < 10) ")


@query("forecast_arima", ARIMA_111 + "select series_id, ds, step, round(yhat, 4) as yhat, round(yhat_lower, 4) as yhat_lower, "
       "round(yhat_upper, 4) as yhat_upper, error from fa")
def _(spark, sf):
    s = ts.prepare_series(clean(spark, sf), "M", 5, method="arima")
    return rounded(arima.fit_arima(s, (1, 1, 1), periods=12, freq="M"), 4)


TREND_111 = (
    ARIMA_111 + ", tg as (select series_id, (arg_max(yhat, step) - arg_min(yhat, step)) / 12 as slope, stddev_samp(yhat) as vol, "
    "arg_max(yhat, step) as ye, max(error) as error from fa group by 1), tt as (select series_id, case when slope > 0.01 then "
    "'Improving' when slope < -0.01 then 'Declining' when slope is not null then 'Stable' end as trend_direction, round(slope, 4) as "
    "slope, round(y0, 4) as current_sentiment, round(vol, 4) as volatility, round(ye, 4) as predicted_30, round(ye, 4) as "
    "predicted_90, ye < 0 as turns_negative, tg.slope < -0.02 as rapid_decline, error from tg join wl using (series_id)) ")


@query("arima_trend", TREND_111 + "select * from tt")
def _(spark, sf):
    s = materialize(ts.prepare_series(clean(spark, sf), "M", 5, method="arima"), "series")
    return rounded(arima.arima_trend(arima.fit_arima(s, (1, 1, 1), periods=12, freq="M"), s), 4)


@query("forecast_report_arima", TREND_111 + "select series_id, coalesce(n, 0) as data_points, 0::bigint as changepoint_count, "
       "0::bigint as anomaly_count, tt.* exclude (series_id, error), slope is not null as success, cast(turns_negative as integer) + "
       "cast(rapid_decline as integer) as alert_count, case when slope is not null then null when coalesce(n, 0) < 10 then "
       "'Insufficient data: only ' || coalesce(n, 0) || ' data points (need at least 10)' else error end as error from (select distinct "
       "series_id from pm) left join wl using (series_id) left join tt using (series_id)")
def _(spark, sf):
    mentions = table(clean(spark, sf), A, "date", "sentiment_score")
    return rounded(ts.forecast_report(mentions, 12, "M", 5, {"order": (1, 1, 1)}, model="arima"), 4)


ARIMA_110 = (
    CLEAN_RECURSIVE + prep_cte("M", 5, "arima") + ", d as (select series_id, ds, y, y - lag(y) over w as d from ser "
    "window w as (partition by series_id order by ds)), l as (select *, lag(d) over (partition by series_id order by ds) "
    "as p from d), f as (select series_id, regr_slope(d, p) as a, regr_intercept(d, p) as c, max(ds) as last, "
    "arg_max(y, ds) as y0, arg_max(d, ds) as d0, count(*) as n from l group by 1 having count(*) >= 10), "
    "e as (select series_id, stddev_pop(d - c - a * p) as sd from l join f using (series_id) where p is not null group "
    "by 1), r as (select series_id, 0 as step, y0 as y, d0 as d, 0.0::double as cum, 1.0::double as pw, 0.0::double as v, a, c, last from f union "
    "all select series_id, step + 1, y + c + a * d, c + a * d, cum + pw, pw * a, v + (cum + pw) * (cum + pw), a, c, last "
    "from r where step < 12) ")


@query("forecast_arima_110", ARIMA_110 + "select r.series_id, last_day(cast(date_trunc('month', last) as date) + "
       "to_months(cast(step as integer))) as ds, cast(step as integer) as step, round(y, 6) as yhat, "
       f"round(y - {Z95!r} * sd * sqrt(v), 6) as yhat_lower, round(y + {Z95!r} * sd * sqrt(v), 6) as yhat_upper from r "
       "join e using (series_id) where step > 0")
def _(spark, sf):
    s = ts.prepare_series(clean(spark, sf), "M", 5, method="arima")
    out = arima.fit_arima(s, (1, 1, 0), periods=12, freq="M")
    return rounded(out.where("error is null").drop("error"), 6)
