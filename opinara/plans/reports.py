"""Registered queries: aggregates, top-k, set operations, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analytics as ana
from ..operators import mining
from ..operators import preprocess as pre
from ..operators import profiles
from ..operators.quantiles import exact_quantiles
from ..session import materialize
from ..sources import fixtures as fx
from . import base_sql as B
from .registry import ANALYSED, clean, full, query, rounded, table

A = "aspect_term_normalized"
POL = ("count(*) filter (where sentiment = 'Positive') as positive, "
       "count(*) filter (where sentiment = 'Negative') as negative, "
       "count(*) filter (where sentiment = 'Neutral') as neutral, count(*) as total")


def _p(s, name):
    return f"round(100.0 * count(*) filter (where sentiment = '{s}') / count(*), 9) as {name}"


@query("kpis", B.CLEAN + "select count(*) as mention_count, count(distinct parent_asin) as "
       f"product_count, count(distinct {A}) as aspect_count, round(avg(confidence), 9) as "
       f"avg_confidence, {_p('Positive', 'pct_positive')}, {_p('Negative', 'pct_negative')}, "
       f"{_p('Neutral', 'pct_neutral')} from clean")
def _(spark, sf):
    return rounded(ana.kpis(clean(spark, sf)))


@query("value_counts", B.CLEAN + "select sentiment as value, count(*) as n, "
       "round(count(*) / sum(count(*)) over (), 9) as share from clean group by 1")
def _(spark, sf):
    return rounded(ana.value_counts(clean(spark, sf), "sentiment"))


@query("aspect_frequencies", B.CLEAN + f"select {A} as value, count(*) as n, "
       "round(count(*) / sum(count(*)) over (), 9) as share from clean group by 1")
def _(spark, sf):
    return rounded(ana.value_counts(clean(spark, sf), A))


@query("top_aspects", B.CLEAN + f"select {A}, count(*) as n from clean group by 1 "
       "order by n desc, 1 limit 20")
def _(spark, sf):
    return ana.top_values(clean(spark, sf), A, 20)


@query("topn_semi_join", B.CLEAN_MORE + f"t as (select {A} from clean group by 1 order by count(*) "
       f"desc, 1 limit 5) select review_id, {A}, sentiment_score from clean semi join t using ({A})")
def _(spark, sf):
    return ana.restrict_to_top(table(clean(spark, sf), "review_id", A, "sentiment_score"), A, 5).select("review_id", A, "sentiment_score")


@query("aspect_summary", B.CLEAN + f"select {A}, {POL}, round((count(*) filter (where sentiment = "
       "'Positive') - count(*) filter (where sentiment = 'Negative')) / count(*), 9) as score "
       "from clean group by 1 order by total desc, 1 limit 10")
def _(spark, sf):
    return rounded(ana.aspect_summary(clean(spark, sf)))


@query("sentiment_ratio", B.CLEAN + f"select {A}, {POL}, round(100.0 * positive / "
       f"nullif(positive + negative, 0), 9) as positive_ratio from clean group by 1")
def _(spark, sf):
    return rounded(ana.sentiment_ratio(clean(spark, sf)))


@query("product_top_aspects", B.CLEAN + f"select parent_asin, {A}, count(*) as mention_count, "
       "round(avg(sentiment_score), 9) as avg_sentiment, cast(sum(is_positive) as bigint) as positive, "
       "cast(sum(is_negative) as bigint) as negative, cast(sum(is_neutral) as bigint) as neutral, "
       f"cast(row_number() over (partition by parent_asin order by count(*) desc, {A}) as integer) "
       f"as rank from clean group by 1, 2 qualify rank <= 10")
def _(spark, sf):
    return rounded(ana.product_top_aspects(clean(spark, sf)))


@query("aspect_product_matrix", B.CLEAN_MORE + f"ta as (select {A} from clean group by 1 order by "
       "count(*) desc, 1 limit 15), tp as (select parent_asin from clean group by 1 order by "
       f"count(*) desc, 1 limit 10) select {A}, parent_asin, round(avg(sentiment_score), 9) as "
       f"avg_sentiment from clean semi join ta using ({A}) semi join tp using (parent_asin) "
       "group by 1, 2")
def _(spark, sf):
    return rounded(ana.aspect_product_matrix(
        table(clean(spark, sf), A, "parent_asin", "sentiment_score")))


@query("product_comparison", B.CLEAN + "select parent_asin, max(title) as title, count(*) as "
       "mention_count, count(distinct review_id) as review_count, round(avg(sentiment_score), 9) as "
       f"avg_sentiment, {_p('Positive', 'pct_positive')}, {_p('Negative', 'pct_negative')}, "
       f"count(distinct {A}) as unique_aspects, round(avg(confidence), 9) as avg_confidence "
       "from clean group by 1")
def _(spark, sf):
    return rounded(ana.product_comparison(full(spark, sf)))


@query("category_stats", B.CLEAN + "select main_category as category, count(*) as mention_count, "
       "count(distinct parent_asin) as product_count, round(avg(sentiment_score), 9) as avg_sentiment, "
       "cast(sum(is_positive) as bigint) as positive_count, cast(sum(is_negative) as bigint) as "
       f"negative_count, round(avg(confidence), 9) as avg_confidence, {_p('Positive', 'pct_positive')}, "
       f"{_p('Negative', 'pct_negative')} from clean where main_category is not null group by 1")
def _(spark, sf):
    return rounded(ana.category_stats(full(spark, sf)))


@query("product_cards", B.CLEAN + "select parent_asin, max(title) as title, max(main_category) as "
       "main_category, max(average_rating) as average_rating, count(*) as mention_count, "
       f"round(avg(sentiment_score), 9) as avg_sentiment, {_p('Positive', 'pct_positive')}, "
       f"{_p('Negative', 'pct_negative')}, count(distinct {A}) as unique_aspects from clean group by 1")
def _(spark, sf):
    return rounded(ana.product_cards(full(spark, sf)))


PRODUCT_STATS = ("select parent_asin, count(*) as mention_count, round(avg(sentiment_score), 9) as "
                 "avg_sentiment_score, cast(sum(is_positive) as bigint) as positive_count, "
                 "cast(sum(is_negative) as bigint) as negative_count, cast(sum(is_neutral) as bigint) "
                 "as neutral_count, max(title) as title, max(main_category) as main_category, "
                 "max(average_rating) as average_rating from clean group by 1")


@query("product_stats", B.CLEAN + PRODUCT_STATS)
def _(spark, sf):
    return rounded(ana.product_stats(full(spark, sf)))


@query("product_explorer", B.CLEAN_MORE + f"s as ({PRODUCT_STATS}), ch as (select * from s where "
       "mention_count >= 10 and average_rating between 1.5 and 4.5 and contains(lower(title), 'bolt') "
       "order by mention_count desc, parent_asin limit 20), "
       f"p as (select parent_asin, sentiment, {A}, row_number() over (partition by parent_asin, "
       f"sentiment order by count(*) desc, {A}) as rk from clean group by 1, 2, 3 qualify rk <= 3), "
       f"l as (select parent_asin, string_agg({A}, ', ' order by rk) filter (where sentiment = "
       f"'Positive') as tp, string_agg({A}, ', ' order by rk) filter (where sentiment = 'Negative') "
       "as tn from p group by 1) select ch.*, coalesce(tp, '') as top_positive, coalesce(tn, '') as "
       "top_negative from ch left join l using (parent_asin)")
def _(spark, sf):
    return rounded(ana.product_explorer(
        clean(spark, sf), 10, (1.5, 4.5), "BOLT", products=fx.products(spark, sf)))


@query("product_index", B.CLEAN + "select parent_asin, count(*) as mention_count, max(title) as title "
       "from clean group by 1")
def _(spark, sf):
    return ana.product_index(full(spark, sf))


@query("sentiment_trend", B.CLEAN + "select week as period, sentiment, count(*) as n from clean "
       "group by 1, 2")
def _(spark, sf):
    return ana.sentiment_trend(clean(spark, sf), "W")


@query("score_trend", B.CLEAN + "select year_month as period, round(avg(sentiment_score), 9) as "
       "avg_sentiment, count(*) as n from clean group by 1")
def _(spark, sf):
    return rounded(ana.score_trend(clean(spark, sf), "M"))


@query("aspect_evolution", B.CLEAN_MORE + f"t as (select {A} from clean group by 1 order by count(*) "
       f"desc, 1 limit 5) select week + 6 as period, {A}, count(*) as n from clean semi join t "
       f"using ({A}) group by 1, 2")
def _(spark, sf):
    return ana.aspect_evolution(table(clean(spark, sf), A, "date"))


@query("product_aspect_daily", B.CLEAN + f"select parent_asin, date, {A}, "
       "round(avg(sentiment_score), 9) as avg_sentiment, count(*) as n from clean group by 1, 2, 3")
def _(spark, sf):
    return rounded(ana.product_aspect_daily(clean(spark, sf)))


@query("aspect_by_sentiment", B.CLEAN + f"select parent_asin, {A}, {POL}, cast(row_number() over "
       f"(partition by parent_asin order by count(*) desc, {A}) as integer) as rank from clean "
       "group by 1, 2 qualify rank <= 10")
def _(spark, sf):
    return ana.aspect_by_sentiment(clean(spark, sf))


REVIEW_AGG = ("select review_id, sum(sentiment_score * confidence) / nullif(sum(confidence), 0) as "
              "sentiment_score, max(rating) as rating, case when count(*) filter (where sentiment = "
              "'Negative') >= greatest(count(*) filter (where sentiment = 'Neutral'), count(*) filter "
              "(where sentiment = 'Positive')) then 'Negative' when count(*) filter (where sentiment "
              "= 'Neutral') >= count(*) filter (where sentiment = 'Positive') then 'Neutral' else "
              "'Positive' end as sentiment, count(*) as aspect_count from clean group by 1")
RA = B.CLEAN_MORE + f"ra as ({REVIEW_AGG}) "


def _ra(spark, sf):
    """Review scores rounded once, so both engines compare the same numbers."""
    return rounded(ana.review_aggregate(clean(spark, sf)))


RAR = B.CLEAN_MORE + (f"ra0 as ({REVIEW_AGG}), ra as (select * replace (round(sentiment_score, 9) as "
                      "sentiment_score) from ra0) ")


@query("review_aggregate", RAR + "select * from ra")
def _(spark, sf):
    return _ra(spark, sf)


COH = ("(rating >= 4 and sentiment_score > 0) or (rating <= 2 and sentiment_score < 0) or "
       "(rating = 3 and abs(sentiment_score) < 0.3)")
DIV = "(rating >= 4 and sentiment_score < -0.3) or (rating <= 2 and sentiment_score > 0.3)"


@query("coherence_metrics", RAR + "select round(corr(rating, sentiment_score), 6) as pearson, "
       f"round(100.0 * count(*) filter (where {COH}) / count(*), 6) as coherence_pct, "
       f"round(100.0 * count(*) filter (where {DIV}) / count(*), 6) as divergence_pct, "
       "round(avg(aspect_count), 6) as avg_aspects, count(*) as review_count from ra")
def _(spark, sf):
    return rounded(ana.coherence_metrics(_ra(spark, sf)), 6)


@query("divergent_reviews", RAR + "select review_id, sentiment_score, rating, sentiment, aspect_count "
       f"from ra where {DIV} order by review_id limit 10")
def _(spark, sf):
    return ana.divergent_reviews(_ra(spark, sf))


@query("stats_by_rating", RAR + "select rating, count(*) as n, round(avg(sentiment_score), 3) as mean, "
       "round(median(sentiment_score), 3) as median, round(stddev_samp(sentiment_score), 3) as std, "
       "round(min(sentiment_score), 3) as min, round(max(sentiment_score), 3) as max from ra group by 1")
def _(spark, sf):
    return ana.stats_by_rating(table(_ra(spark, sf)))


@query("box_stats", RAR + ", q as (select rating, count(*) as n, quantile_cont(sentiment_score, 0.25) "
       "as q1, quantile_cont(sentiment_score, 0.5) as median, quantile_cont(sentiment_score, 0.75) as "
       "q3 from ra group by 1) select rating, n, round(q1, 6) as q1, round(median, 6) as median, "
       "round(q3, 6) as q3, round(q1 - 1.5 * (q3 - q1), 6) as lower_fence, round(q3 + 1.5 * (q3 - q1), "
       "6) as upper_fence, (select count(*) from ra where ra.rating = q.rating and (sentiment_score < "
       "q1 - 1.5 * (q3 - q1) or sentiment_score > q3 + 1.5 * (q3 - q1))) as outliers from q")
def _(spark, sf):
    return rounded(ana.box_stats(table(_ra(spark, sf)), "rating", "sentiment_score"), 6)


@query("hist2d", RAR + "select cast(least(floor((rating - 1) * 10 / 4), 9) as integer) as x_bin, "
       "cast(least(floor((sentiment_score + 1) * 20 / 2), 19) as integer) as y_bin, count(*) as n "
       "from ra group by 1, 2")
def _(spark, sf):
    return ana.hist2d(_ra(spark, sf), "rating", "sentiment_score", (1.0, 5.0), (-1.0, 1.0))


@query("hist1d", "with d as (select length(text) as n_chars from documents), c as (select * from d "
       "where n_chars <= (select quantile_cont(n_chars, 0.95) from d)), e as (select min(n_chars) lo, "
       "max(n_chars) hi from c) select cast(least(floor((n_chars - lo) * 50 / cast(hi - lo as double)), "
       "49) as integer) as bin, count(*) as n, cast(min(n_chars) as double) as min_value, "
       "cast(max(n_chars) as double) as max_value from c, e group by 1")
def _(spark, sf):
    d = fx.documents(spark, sf).select(F.length("text").alias("n_chars"))
    return ana.hist1d(d, "n_chars")


PROFILED = {"review_id": False, "rating": True, "title": False, "user_id": False,
            "parent_asin": False, "helpful_vote": True}


def _profile_sql(col, numeric):
    tail = (f"round(avg({col}), 6) as mean, cast(min({col}) as double) as min, "
            f"cast(max({col}) as double) as max" if numeric else
            "cast(null as double) as mean, cast(null as double) as min, cast(null as double) as max")
    return (f"select '{col}' as \"column\", {str(numeric).lower()} as \"numeric\", count(*) - "
            f"count({col}) as nulls, count(distinct {col}) as distinct_values, {tail} from reviews")


@query("profile_columns", B.REVIEWS + " union all ".join(
    _profile_sql(c, n) for c, n in PROFILED.items()))
def _(spark, sf):
    return rounded(ana.profile_columns(fx.reviews(spark, sf).select(*PROFILED)), 6)


@query("reviews_per_month", "select cast(date_trunc('month', o_orderdate) as date) as period, "
       "count(*) as n from orders group by 1")
def _(spark, sf):
    return ana.reviews_per_period(fx.table(spark, sf, "orders"), "o_orderdate", "M")


@query("reviews_per_day", B.EVENTS + "select cast(ts as date) as period, count(*) as n from ev "
       "group by 1")
def _(spark, sf):
    return ana.reviews_per_period(fx.event_reviews(spark, sf), "ts", "D")


@query("reviews_per_user", B.EVENTS + "select user_id, count(*) as n from ev group by 1")
def _(spark, sf):
    return ana.reviews_per_user(fx.event_reviews(spark, sf))


@query("normalization_report", B.CLEAN_MORE + "r as (select (select count(distinct lower(aspect_term)) "
       f"from mentions) as b, (select count(distinct {A}) from clean) as a), "
       f"v as (select {A}, count(distinct aspect_term) as k from clean group by 1 having k > 1 "
       f"order by k desc, 1 limit 10), "
       f"t as (select {A}, count(*) as k from clean group by 1 order by k desc, 1 limit 20), "
       f"u as (select {A}, count(*) as k from clean where {A} = lower(trim(aspect_term)) group by 1 "
       "order by k desc, 1 limit 20) "
       "select 'reduction' as section, 'original_aspects' as item, cast(b as double) as value from r "
       "union all select 'reduction', 'normalized_aspects', a from r "
       "union all select 'reduction', 'reduction', b - a from r "
       "union all select 'reduction', 'reduction_pct', round(100.0 * (b - a) / b, 9) from r "
       f"union all select 'top_aspects', {A}, k from t union all select 'variants', {A}, k from v "
       f"union all select 'unmapped', {A}, k from u")
def _(spark, sf):
    return rounded(pre.normalization_report(
        fx.mentions(spark, sf), table(clean(spark, sf), A, "aspect_term")))


@query("aspect_variants", B.CLEAN_MORE + f"p as (select {A}, aspect_term, row_number() over (partition "
       f"by {A} order by aspect_term) as k from clean group by 1, 2) select {A}, count(*) as "
       "variant_count, string_agg(aspect_term, ', ' order by aspect_term) filter (where k <= 5) as "
       "sample_variants from p group by 1 having variant_count > 1 order by variant_count desc, 1 "
       "limit 10")
def _(spark, sf):
    return pre.aspect_variants(clean(spark, sf))


@query("impute_median", B.REVIEWS_MORE + "m as (select parent_asin, median(rating) as md from reviews "
       "where parent_asin is not null group by 1) select review_id, coalesce(rating, md) as rating "
       "from reviews left join m using (parent_asin)")
def _(spark, sf):
    return ana.impute_rating_median(fx.reviews(spark, sf)).select("review_id", "rating")


@query("forecast_scope", B.CLEAN + f"select {A}, count(*) as n, round(count(*) * 100.0 / "
       "sum(count(*)) over (), 9) as share_pct from clean group by 1 qualify n >= 50 "
       "order by n desc, 1 limit 20")
def _(spark, sf):
    return rounded(ana.forecast_scope(clean(spark, sf)))


@query("classification_report", RAR + ", c as (select case when rating >= 4 then 'positive' when "
       "rating <= 2 then 'negative' else 'neutral' end as l, lower(sentiment) as p from ra), "
       "k as (select distinct l as label from c union select distinct p from c), "
       "s as (select label, (select count(*) from c where l = label) as support, (select count(*) from "
       "c where p = label) as predicted, (select count(*) from c where p = label and l = label) as tp "
       "from k), pr as (select label, coalesce(tp / nullif(predicted, 0), 0) as p, coalesce(tp / "
       "nullif(support, 0), 0) as r, support from s) select label, round(p, 9) as precision, "
       "round(r, 9) as recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) as f1, support "
       "from pr")
def _(spark, sf):
    pairs = _ra(spark, sf).select(C.rating_label().alias("label"),
                                  F.lower("sentiment").alias("prediction"))
    return rounded(ana.classification_report(pairs))


@query("universal_concerns", B.CLEAN_MORE + f"k as (select main_category, {A}, row_number() over "
       f"(partition by main_category order by count(*) desc, {A}) as rk from clean where sentiment = "
       "'Negative' and main_category is not null group by 1, 2 qualify rk <= 5), n as (select "
       "count(distinct main_category) as total from clean where sentiment = 'Negative') "
       f"select {A}, count(*) as categories, min(main_category) as first_category, "
       "count(*) >= max(total) * 0.7 as universal, count(*) = 1 as specific from k, n group by 1")
def _(spark, sf):
    return ana.universal_concerns(table(full(spark, sf), *ANALYSED))


@query("duplicate_ratio", "select count(*) as row_count, (select count(*) from (select distinct text, "
       "lang from documents)) as distinct_rows, round(1 - (select count(*) from (select distinct text, "
       "lang from documents)) / count(*), 9) as duplicate_ratio from documents")
def _(spark, sf):
    return rounded(ana.duplicate_ratio(fx.documents(spark, sf).select("text", "lang")))


@query("join_ground_truth", B.REVIEWS + "select review_id, rating, parent_asin, case when doc_id is not null then "
       "cast(to_json({'quality': quality, 'toxic': toxic}) as varchar) end as \"aspects_json_GT\" from reviews left join labels on review_id = "
       "cast(doc_id as varchar)")
def _(spark, sf):
    truth = fx.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.to_json(F.struct("quality", "toxic")).alias("aspects_json"))
    from ..operators.text import join_ground_truth

    pred = fx.reviews(spark, sf).select("review_id", "rating", "parent_asin")
    return join_ground_truth(pred, truth)


# ---------------------------------------------------------------- full column profiles

_LINES = {"l_orderkey": "number", "l_partkey": "number", "l_linenumber": "number", "l_quantity": "number",
          "l_extendedprice": "number", "l_discount": "number", "l_returnflag": "other", "l_linestatus": "other", "l_shipdate": "time"}


def _full_profile_sql(name: str, kind: str, distinct: str) -> str:
    number = f"cast({name} as double)" if kind == "number" else "null::double"
    moment = f"cast({name} as timestamp)" if kind == "time" else "null::timestamp"
    parts = ", ".join(f"round(quantile_cont({number}, {p}), 7) as {q}" for q, p in profiles.QUARTILES.items())
    return (f"select '{name}' as \"column\", '{kind}' as kind, count(*) as rows, count(*) - count({name}) as nulls, {distinct}, "
            f"round(avg({number}), 7) as mean, round(stddev_samp({number}), 7) as std, round(min({number}), 7) as min, "
            f"round(max({number}), 7) as max, {parts}, min({moment}) as first_time, max({moment}) as last_time from lineitem")


def _plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_time", "last_time")})


@query("profile_full", " union all ".join(
    _full_profile_sql(c, k, f"count(distinct {c}) as distinct_values") for c, k in _LINES.items()))
def _(spark, sf):
    return _plain(rounded(profiles.profile_exact(fx.table(spark, sf, "lineitem").select(*_LINES)), 7))


# Quartiles and distinct counts come from sketches: SQL has the exact ones, the query says whether its own are near enough.
@query("profile_merged", "select * exclude (distinct_values, q25, q50, q75), true as distinct_near, case when kind = 'number' then "
       "true end as quartiles_near from (" + " union all ".join(
           _full_profile_sql(c, k, f"count(distinct {c}) as distinct_values") for c, k in _LINES.items()) + ")")
def _(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(*_LINES).withColumn("month", F.trunc("l_shipdate", "month"))
    stored = materialize(profiles.profile_periods(lines, "month"), "profiles")
    merged = materialize(profiles.merge_profiles(stored).drop("frequent"), "merged")
    around = {f"{q}_{side}": min(1.0, max(0.0, p + d)) for q, p in profiles.QUARTILES.items()
              for side, d in (("low", -profiles.RANK_ERROR), ("high", profiles.RANK_ERROR))}
    each = lines.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                                           for c, k in _LINES.items() if k == "number"])))
    bounds = exact_quantiles(each, ["column"], "v", around).drop("n")
    exact = profiles.profile_exact(lines.drop("month")).select("column", F.col("distinct_values").alias("_d"))
    near = F.abs(F.col("distinct_values") - F.col("_d")) <= profiles.DISTINCT_ERROR * F.col("_d") + 1
    quartiles = F.lit(True)
    for q in profiles.QUARTILES:
        quartiles = quartiles & F.col(q).between(F.col(f"{q}_low") - 1e-9, F.col(f"{q}_high") + 1e-9)
    out = merged.join(bounds, "column", "left").join(exact, "column").withColumns({
        "distinct_near": near, "quartiles_near": F.when(F.col("kind") == "number", quartiles)})
    return _plain(rounded(out.drop("_d", "distinct_values", *profiles.QUARTILES, *around), 7))


@query("top_aspect_maps", B.CLEAN + f", k as (select main_category, {A}, count(*) as k from clean where main_category is not null "
       f"group by 1, 2), r as (select *, row_number() over (partition by main_category order by k desc, {A}) as rank from k) select "
       f"main_category, string_agg({A} || '=' || k, ',' order by rank) as aspects, max(k) filter (where rank = 1) as most from r where "
       "rank <= 5 group by 1")
def _(spark, sf):
    counts = full(spark, sf).where("main_category is not null").groupBy("main_category", A).agg(F.count("*").alias("k"))
    maps = mining._top_map(counts, "main_category", A, 5, "aspects")
    entries = F.transform(F.map_entries("aspects"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return maps.select("main_category", F.array_join(entries, ",").alias("aspects"), F.map_values("aspects")[0].alias("most"))
