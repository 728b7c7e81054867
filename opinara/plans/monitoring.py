"""Registered queries: rolling windows, alerts, fake-review flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..operators import analytics as ana
from ..operators import fraud
from ..operators import windows as win
from ..sources import fixtures as fx
from . import base_sql as B
from .core import BASIC
from .registry import clean, query, rounded, table

A = "aspect_term_normalized"


def roll_cte(days: int) -> str:
    """Daily scores and their rolling mean."""
    return (f"daily as (select parent_asin, date, sum(sentiment_score) as s, count(*) as n, "
            f"max(title) as title, max(main_category) as main_category from clean group by 1, 2), "
            f"roll as (select *, sum(s) over w / sum(n) over w as rolling from daily window w as "
            f"(partition by parent_asin order by date - date '1970-01-01' range between {days - 1} "
            f"preceding and current row)) ")


# One row per mention, numbered from the newest, as in the row-offset definition.
def offset_cte(days: int) -> str:
    return (roll_cte(days) + f", pts as (select parent_asin, c.date, rolling, row_number() over "
            "(partition by parent_asin order by c.date desc, review_id desc, pos desc, "
            f"{A} desc) as rn, count(*) over (partition by parent_asin) as total from clean c join "
            "roll using (parent_asin, date)), "
            f"ends as (select parent_asin, max(total) as mention_count, max(date) as last_date, "
            f"max(case when rn = 1 then rolling end) as recent, max(case when rn = case when total > "
            f"{days} then {days + 1} else total end then rolling end) as previous from pts group by 1) ")


@query("rolling_sentiment", B.CLEAN_MORE + roll_cte(7) +
       "select parent_asin, date, n as mention_count, round(rolling, 9) as rolling from roll")
def _(spark, sf):
    return rounded(win.rolling_sentiment(clean(spark, sf)))


@query("sentiment_shifts", B.CLEAN_MORE + offset_cte(7) +
       "select parent_asin, round((recent - previous) / abs(previous), 6) as sentiment_change, "
       "round(recent, 6) as recent_sentiment, round(previous, 6) as previous_sentiment, last_date as "
       "alert_date, mention_count from ends where mention_count >= 5 and previous > 0 and "
       "(recent - previous) / abs(previous) < -0.2")
def _(spark, sf):
    return rounded(al.sentiment_shifts(clean(spark, sf)), 6)


@query("sentiment_shifts_days", B.CLEAN_MORE + roll_cte(7) +
       ", m as (select parent_asin, max(date) as last_date, sum(n) as mention_count from daily group "
       "by 1), e as (select parent_asin, last_date, max(m.mention_count) as mention_count, "
       "arg_max(rolling, date) as recent, coalesce(arg_max(rolling, date) filter (where date <= "
       "last_date - 7), arg_min(rolling, date)) as previous from roll join m using (parent_asin) "
       "group by 1, 2) select parent_asin, round((recent - previous) / abs(previous), 6) as "
       "sentiment_change, round(recent, 6) as recent_sentiment, round(previous, 6) as "
       "previous_sentiment, last_date as alert_date, cast(mention_count as bigint) as mention_count "
       "from e where mention_count >= 5 and previous > 0 and "
       "(recent - previous) / abs(previous) < -0.2")
def _(spark, sf):
    return rounded(al.sentiment_shifts(clean(spark, sf), previous="days"), 6)


DROPS = (offset_cte(7) + ", al as (select *, (recent - previous) / abs(previous) as ch from ends where "
         "mention_count >= 5 and previous > 0 and (recent - previous) / abs(previous) < -0.2), "
         f"pc as (select parent_asin, {A}, count(*) as n, count(*) filter (where sentiment = 'Negative')"
         " as neg, max(title) as title, max(main_category) as cat from clean join al using "
         "(parent_asin) where date >= last_date - 7 group by 1, 2), "
         f"ng as (select parent_asin, string_agg({A}, ', ' order by neg desc, {A}) as names from "
         f"(select * from pc where neg > 0 qualify row_number() over (partition by parent_asin order "
         f"by neg desc, {A}) <= 3) group by 1), "
         "drops as (select 'Sentiment Drop' as alert_type, case when ch < -0.5 then 'High' else "
         "'Medium' end as severity, parent_asin as product_asin, max(title) as product_title, max(cat) "
         "as category, round(max(ch), 6) as sentiment_change, round(max(recent), 6) as "
         "recent_sentiment, round(max(previous), 6) as previous_sentiment, max(last_date) as "
         "alert_date, cast(sum(n) as bigint) as mention_count_period, coalesce(max(names), '') as "
         "top_negative_aspects from al join pc using (parent_asin) left join ng using (parent_asin) "
         "group by 1, 2, 3) ")


@query("sentiment_drops", B.CLEAN_MORE + DROPS + "select * from drops")
def _(spark, sf):
    return rounded(al.sentiment_drops(clean(spark, sf), products=fx.products(spark, sf)), 6)


TRENDS = ("cut as (select max(date) - 30 as c from clean), ct as (select main_category as category, "
          "avg(sentiment_score) filter (where date > c) as rs, avg(sentiment_score) filter (where date "
          "<= c) as hs, count(*) filter (where date > c) as rn, count(*) filter (where date <= c) as hn, "
          "count(*) filter (where date > c and sentiment = 'Negative') as neg from clean, cut where "
          "main_category is not null group by 1), trends as (select category, round(rs, 6) as "
          "recent_sentiment, round(hs, 6) as historical_sentiment, rn as recent_mention_count, hn as "
          "historical_mention_count, round(100.0 * neg / rn, 6) as recent_pct_negative, "
          "round(case when hs <> 0 then (rs - hs) / abs(hs) else 0 end, 6) as change, "
          "case when (rs - hs) / abs(hs) > 0.1 then 'Improving' when (rs - hs) / abs(hs) < -0.1 then "
          "'Declining' else 'Stable' end as trend from ct where rn >= 20 and hn >= 20) ")


@query("category_trends", B.CLEAN_MORE + TRENDS + "select * from trends")
def _(spark, sf):
    return rounded(al.category_trends(
        clean(spark, sf), min_mentions=20, products=fx.products(spark, sf)), 6)


def emerging_cte(days: int, k: int, older: str) -> str:
    return (f"hi as (select max(date) - {days} as c from clean), "
            f"nw as (select {A} from clean, hi where date > c except select {A} from clean, hi where "
            f"date <= c {older}), "
            f"rc as (select clean.* from clean semi join nw using ({A}), hi where date > c), "
            f"tp as (select {A}, string_agg(t, ', ' order by n desc, parent_asin) as names from (select "
            f"{A}, parent_asin, coalesce(max(title), parent_asin) as t, count(*) as n from rc group by "
            f"1, 2 qualify row_number() over (partition by {A} order by count(*) desc, parent_asin) "
            f"<= 3) group by 1), "
            f"emerging as (select {A} as aspect, count(*) as mention_count, round(avg(sentiment_score), "
            "6) as avg_sentiment, round(100.0 * count(*) filter (where sentiment = 'Negative') / "
            "count(*), 6) as pct_negative, count(distinct parent_asin) as unique_products, max(names) "
            f"as top_products, min(date) as first_seen from rc join tp using ({A}) group by 1 having "
            f"count(*) >= {k}) ")


@query("emerging_aspects", B.CLEAN_MORE + emerging_cte(4, 2, "and date > c - 4") +
       "select * from emerging")
def _(spark, sf):
    return rounded(al.emerging_aspects(clean(spark, sf), 4, 2, products=fx.products(spark, sf)), 6)


@query("emerging_aspects_all_history", B.CLEAN_MORE + emerging_cte(45, 1, "") +
       "select * from emerging")
def _(spark, sf):
    return rounded(al.emerging_aspects(
        clean(spark, sf), 45, 1, against="all", products=fx.products(spark, sf)), 6)


@query("emerging_set", B.CLEAN_MORE + f"c as (select max(date) - 45 as c from clean) select {A}, "
       f"min(date) as first_seen from clean, c group by {A}, c having min(date) > c")
def _(spark, sf):
    return al.emerging_set(table(clean(spark, sf), "aspect_term_normalized", "date"), 45)


DIVERGE = ("dv as (select parent_asin as product_asin, max(title) as product_title, "
           "max(main_category) as category, max(average_rating) as pr, avg((sentiment_score + 1) / 2 * "
           "4 + 1) as sr, count(*) as mention_count from clean group by 1 having count(*) >= 10), "
           "diverge as (select product_asin, product_title, category, pr as product_rating, "
           "round(sr, 6) as sentiment_rating, mention_count, round(abs(pr - sr), 6) as divergence, "
           "case when pr > sr then 'Rating higher than sentiment' else 'Sentiment higher than rating' "
           "end as interpretation from dv where abs(pr - sr) >= 1.5) ")


@query("rating_divergence", B.CLEAN_MORE + DIVERGE + "select * from diverge")
def _(spark, sf):
    return rounded(al.rating_divergence(clean(spark, sf), products=fx.products(spark, sf)), 6)


@query("alert_summary", B.CLEAN_MORE + DROPS + ", " + TRENDS + ", " +
       emerging_cte(45, 1, "and date > c - 45") + ", " + DIVERGE +
       "select 'sentiment_drops' as report, count(*) as alerts from drops union all "
       "select 'category_trends', count(*) from trends union all "
       "select 'emerging_aspects', count(*) from emerging union all "
       "select 'rating_divergence', count(*) from diverge")
def _(spark, sf):
    return al.alert_summary(al.alert_report(
        clean(spark, sf), fx.products(spark, sf), category_trends={"min_mentions": 20},
        emerging_aspects={"lookback_days": 45, "min_mentions": 1}))


@query("momentum", B.CLEAN_MORE + offset_cte(14) + ", l as (select parent_asin, rolling, "
       "cast(-rn as double) as x from pts where rn <= 14) select parent_asin, round(case when count(*) "
       "< 14 then 0.0 else regr_slope(rolling, x) end, 6) as momentum from l group by 1")
def _(spark, sf):
    return rounded(win.momentum(clean(spark, sf)), 6)


@query("user_activity_7d", B.EVENTS_MORE + "c as (select review_id, user_id, count(*) over (partition "
       "by user_id order by epoch_us(ts) range between 604799999999 preceding and current row) as n "
       "from ev) select review_id, user_id, n as reviews_in_window, n > 5 as high_activity from c")
def _(spark, sf):
    return win.user_activity(fx.event_reviews(spark, sf))


@query("fake_reviews", B.REVIEWS_MORE + "c as (select *, " +
       BASIC.format("trim(coalesce(title, '') || ' ' || coalesce(text, ''))") + " as review_clean from "
       "reviews), u as (select user_id, (count(asin) > 100 or count(distinct rating) = 1) as beh from "
       "reviews where user_id is not null group by 1), "
       "f as (select review_id, length(review_clean) as review_length, len(list_filter("
       "string_split(review_clean, ' '), lambda w: w <> '')) as word_count, regexp_matches("
       "review_clean, 'mg|ml|chemical|compound|pharmaceutical|extract|formula|study') as tech_flag, "
       "len(text) - len(replace(text, '!', '')) > 5 as exclamation_flag, regexp_matches(review_clean, "
       "'great great|buy buy') as rep, coalesce(beh, false) as behavior_flag, (not verified_purchase) "
       "and coalesce(helpful_vote, 0) = 0 and not has_image as trust from c left join u using "
       "(user_id)) select review_id, cast(review_length as integer) as review_length, cast(word_count "
       "as integer) as word_count, tech_flag, exclamation_flag, word_count > 500 or rep or tech_flag "
       "or exclamation_flag as content_flag, behavior_flag, word_count > 500 or rep or tech_flag or "
       "exclamation_flag or behavior_flag or trust as fake_flag from f")
def _(spark, sf):
    return fraud.detect_fake_reviews(fx.reviews(spark, sf)).select(
        "review_id", "review_length", "word_count", "tech_flag", "exclamation_flag",
        "content_flag", "behavior_flag", "fake_flag")


@query("fake_flag_summary", B.EVENTS_MORE + "u as (select user_id, count(*) as n, count(distinct "
       "rating) as k from ev group by 1) select count(*) as reviews, count(*) filter (where n > 70) as "
       "heavy_users, count(*) filter (where k = 1) as mono_rating from ev join u using (user_id)")
def _(spark, sf):
    ev = fx.event_reviews(spark, sf)
    users = ev.groupBy("user_id").agg(F.count("*").alias("n"), F.min("rating").alias("lo"),
                                      F.max("rating").alias("hi"))
    return users.agg(
        F.sum("n").alias("reviews"),
        F.coalesce(F.sum(F.when(F.col("n") > 70, F.col("n"))), F.lit(0)).alias("heavy_users"),
        F.coalesce(F.sum(F.when(F.col("lo") == F.col("hi"), F.col("n"))), F.lit(0))
        .alias("mono_rating"))


@query("rating_correlations", B.REVIEWS + "select round(corr(rating, length(text)), 6) as "
       "corr_review_length, round(corr(rating, helpful_vote), 6) as corr_helpful_vote from reviews")
def _(spark, sf):
    r = fx.reviews(spark, sf).withColumn("review_length", F.length("text"))
    return rounded(ana.rating_correlations(r, ["review_length", "helpful_vote"]), 6)
