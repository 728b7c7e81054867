"""Registered queries: MLlib models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import mining, topics
from ..operators import text as tx
from ..session import materialize, scratch_path
from ..sources import fixtures as fx
from ..sources import sinks
from ..streaming import alerts, ingest, jobs
from . import base_sql as B
from .core import TOKENS
from .language import ASPECT_WORDS, EXTRACT, OPINIONS
from .registry import query, rounded


def _texts(spark, sf):
    return fx.reviews(spark, sf).select("review_id", "text", "lang")


def _mentions(spark, sf):
    """Mentions extracted from the document texts, with the language as category."""
    t = _texts(spark, sf)
    found = tx.extract_aspects(t, ASPECT_WORDS, OPINIONS).withColumnRenamed(
        "term", "aspect_term_normalized")
    return (found.withColumn("sentiment_score", C.sentiment_score())
            .join(t.select("review_id", F.col("lang").alias("main_category")), "review_id"))


def _vectors(spark, sf):
    return mining.embed_texts(_texts(spark, sf))


@query("seeded_sample", "select doc_id, lang from documents order by md5(cast(doc_id as varchar) || ':42'),"
       " doc_id limit 100")
def _(spark, sf):
    return mining.seeded_sample(fx.documents(spark, sf).select("doc_id", "lang"), "doc_id", 100)


@query("embed_texts")
def _(spark, sf):
    return _vectors(spark, sf)


@query("pca_2d")
def _(spark, sf):
    return rounded(mining.pca_2d(fx.table(spark, sf, "embeddings")), 6)


@query("kmeans_vectors")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return mining.kmeans(e, 10, key="vec_id").groupBy("cluster").agg(F.count("*").alias("size"))


@query("kmeans_profile")
def _(spark, sf):
    return mining.kmeans_profile(_mentions(spark, sf), _texts(spark, sf), _vectors(spark, sf), 8)


@query("lda_topics")
def _(spark, sf):
    return mining.lda_topics(_mentions(spark, sf), _texts(spark, sf), 10)


@query("category_topics")
def _(spark, sf):
    return mining.category_topics(_mentions(spark, sf), _texts(spark, sf), 5)


# Hashed start, words from it, then one round of sharing out and summing, topic by topic.
EM_STEP = (
    EXTRACT + ", ng as (select distinct review_id, lang as cat from asp join reviews using (review_id) where sentiment = 'Negative' "
    "and lang is not null), nt as (select review_id, cat, unnest(" + TOKENS.format("text") + ") as word from reviews join ng using "
    "(review_id)), c0 as materialized (select cat, review_id, word, count(*) as n from nt group by all), nd as (select cat, "
    "count(distinct review_id) as d from c0 group by 1 having count(distinct review_id) >= 20), cn as materialized (select c0.* from c0 "
    "join (select cat, word, count(*) as f from c0 group by all) using (cat, word) join nd using (cat) where f >= 2 and f <= 0.5 * d), "
    "zs as (select unnest(range(0, 3)) as z), st as materialized (select cat, review_id, z, u / sum(u) over (partition by cat, "
    "review_id) as p from (select cat, review_id, z, 1 + list_sum(list_transform(range(1, 5), lambda i: (instr('123456789abcdef', "
    "md5(review_id || ':' || z)[i:i])) * pow(16, 4 - i))) / 65536 as u from (select distinct cat, review_id from cn), zs)), "
    "w0 as (select cat, word, z, sum(n * p) + 0.01 as s from cn join st using (cat, review_id) group by all), q0 as materialized "
    "(select cat, word, z, s / sum(s) over (partition by cat, z) as q from w0), sh as (select cat, review_id, word, z, n * p * q / "
    "sum(p * q) over (partition by cat, review_id, word) as c from cn join st using (cat, review_id) join q0 using (cat, word, z)), "
    "w1 as (select cat, word, z, sum(c) + 0.01 as s from sh group by all) ")


@query("topic_words_step", EM_STEP + "select cat as main_category, word, cast(z as integer) as topic, round(s / sum(s) over (partition "
       "by cat, z), 8) as p from w1")
def _(spark, sf):
    words, _ = topics.em_topics(topics.topic_counts(_mentions(spark, sf), _texts(spark, sf)), 3, 1)
    return rounded(topics.by_topic(words, "q", 3), 8)


def _category_topics(spark, sf):
    return topics.category_topics(_mentions(spark, sf), _texts(spark, sf), 5, rounds=10)


@query("topics_by_category")
def _(spark, sf):
    return rounded(_category_topics(spark, sf).withColumn("probabilities", F.transform("probabilities", lambda p: F.round(p, 6))), 6)


@query("topic_concerns")
def _(spark, sf):
    return topics.topic_concerns(materialize(_category_topics(spark, sf), "topics"))


@query("classify_reviews")
def _(spark, sf):
    labels = fx.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("review_id"),
        F.when(F.col("toxic") == 1, 1.0).when(F.col("quality") == 1, 5.0).otherwise(3.0).alias("rating"))
    data = _texts(spark, sf).join(labels, "review_id")
    return rounded(mining.classification_scores(data), 6)


@query("topic_report")
def _(spark, sf):
    path = scratch_path(spark, "topic-report")
    t = _texts(spark, sf)
    counted = materialize(mining.counted_words(t), "counted")
    tables = mining.topic_report(_mentions(spark, sf), t, mining.embed_texts(t, counted=counted), counted=counted)
    out = None
    for name in sinks.write_report(tables, path):
        part = spark.read.json(f"{path}/{name}").agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("report"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- streams

def _stream(spark, sf):
    raw = jobs.read_stream(spark, sf, "events.parquet", fx.table(spark, sf, "events").schema)
    return jobs.scored_events(raw.select(
        F.col("event_id").cast("string").alias("review_id"), F.col("user_id").cast("string").alias("user_id"),
        (F.col("event_id") % 5 + 1).cast("double").alias("rating"), F.col("event_type").alias("main_category"),
        "ts"))


SCORED_EV = (B.EVENTS_MORE + "sv as (select *, case when rating >= 4 then 'Positive' when rating <= 2 then "
             "'Negative' else 'Neutral' end as sentiment, (rating - 3) / 2 as sentiment_score from ev), "
             "wm as (select max(ts) - interval 1 day as wm from sv) ")


def _plain_times(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("stream_ingest", SCORED_EV + "select review_id, user_id, ts, sentiment from sv")
def _(spark, sf):
    out = jobs.run_to_table(jobs.dedup_stream(_stream(spark, sf)), "ingest")
    return out.select("review_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "sentiment")


@query("stream_trend_tumbling", SCORED_EV + "select date_trunc('day', ts)::timestamp as start, "
       "date_trunc('day', ts)::timestamp + interval 1 day as \"end\", sentiment, count(*) as n, "
       "round(avg(sentiment_score), 9) as avg_sentiment from sv, wm group by 1, 2, 3, wm having "
       "date_trunc('day', ts)::timestamp + interval 1 day <= wm")
def _(spark, sf):
    return rounded(_plain_times(jobs.run_to_table(jobs.trend_stream(_stream(spark, sf)), "tumbling")))


@query("stream_trend_sliding", SCORED_EV + ", sl as (select sv.*, date_trunc('day', ts)::timestamp - "
       "interval 1 day * k as start from sv, (values (0), (1)) t(k)) select start, start + interval 2 day "
       "as \"end\", sentiment, count(*) as n, round(avg(sentiment_score), 9) as avg_sentiment from sl, wm "
       "group by 1, 2, 3, wm having start + interval 2 day <= wm")
def _(spark, sf):
    s = jobs.trend_stream(_stream(spark, sf), "2 days", "1 day")
    return rounded(_plain_times(jobs.run_to_table(s, "sliding")))


@query("stream_trend_session", SCORED_EV + ", ss as (select user_id, ts, sum(cast(coalesce(ts - p > interval "
       "6 hour, true) as integer)) over (partition by user_id order by ts) as s from (select *, lag(ts) "
       "over (partition by user_id order by ts) as p from sv)) select user_id, min(ts) as start, max(ts) + "
       "interval 6 hour as \"end\", count(*) as n from ss, wm group by user_id, s, wm having max(ts) + "
       "interval 6 hour <= wm")
def _(spark, sf):
    return _plain_times(jobs.run_to_table(jobs.session_stream(_stream(spark, sf)), "session"))


@query("stream_window_means", SCORED_EV + "select main_category as series_id, time_bucket(interval 6 hour, "
       "ts::timestamp, timestamp '1970-01-01') + interval 6 hour as ds, round(avg(sentiment_score), 9) as y "
       "from sv, wm group by 1, 2, wm having ds <= wm")
def _(spark, sf):
    s = jobs.window_means(_stream(spark, sf), "main_category", "6 hours")
    return rounded(jobs.run_to_table(s, "means").withColumn("ds", F.col("ds").cast("timestamp_ntz")))


CUSUM_WALK = (
    SCORED_EV.replace("with ", "with recursive ", 1) + ", mn as (select main_category as series_id, time_bucket(interval "
    "6 hour, ts::timestamp, timestamp '1970-01-01') + interval 6 hour as ds, avg(sentiment_score) as y from sv, wm group "
    "by 1, 2, wm having ds <= wm), nu as (select *, row_number() over (partition by series_id order by ds) as i from mn), "
    "wk as (select distinct series_id, null::timestamp as ds, 0::bigint as i, 0.0::double as mean, 0.0::double as m2, "
    "0.0::double as up, 0.0::double as down, null::varchar as direction from nu union all "
    "select series_id, ds, i, mean + (y - mean) / i, m2 + (y - mean) * (y - (mean + (y - mean) / i)), "
    "case when greatest(u, d) > 2.0 and live then 0 else u end, case when greatest(u, d) > 2.0 and live then 0 else d end, "
    "case when greatest(u, d) > 2.0 and live then case when u >= d then 'up' else 'down' end end from (select *, "
    "case when live then greatest(0, up + z - 0.5) else up end as u, case when live then greatest(0, down - z - 0.5) else "
    "down end as d from (select wk.series_id, nu.ds, nu.i, nu.y, mean, m2, up, down, wk.i >= 10 and m2 > 0 as live, "
    "case when m2 > 0 then (nu.y - mean) / sqrt(m2 / wk.i) end as z from wk join nu on nu.series_id = wk.series_id and "
    "nu.i = wk.i + 1))) ")


@query("stream_cusum", CUSUM_WALK + "select series_id, ds, direction from wk where direction is not null")
def _(spark, sf):
    path = scratch_path(spark, "closed-windows")
    means = jobs.window_means(_stream(spark, sf), "main_category", "6 hours")
    jobs.run_to_table(means, "means", path=path)
    closed = spark.readStream.schema(means.schema).parquet(path)
    hits = jobs.run_to_table(jobs.cusum_stream(closed, threshold=2.0), "cusum")
    return hits.withColumn("ds", F.col("ds").cast("timestamp_ntz"))


@query("session_batch", SCORED_EV + ", ss as (select user_id, ts, sum(cast(coalesce(ts - p > interval "
       "6 hour, true) as integer)) over (partition by user_id order by ts) as s from (select *, lag(ts) "
       "over (partition by user_id order by ts) as p from sv)) select user_id, min(ts) as start, "
       "count(*) as n from ss group by user_id, s")
def _(spark, sf):
    ev = jobs.scored_events(fx.event_reviews(spark, sf))
    return (ev.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id")
            .agg(F.count("*").alias("n"))
            .select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n"))


@query("stream_scored_ingest", EXTRACT + "select * from asp")
def _(spark, sf):
    raw = jobs.read_stream(spark, sf, "documents.parquet", fx.table(spark, sf, "documents").schema)
    reviews = raw.select(F.col("doc_id").cast("string").alias("review_id"), "text")
    return ingest.run_scored_ingest(reviews, scratch_path(spark, "scored"),
                                    score=lambda batch: tx.extract_aspects(batch, ASPECT_WORDS, OPINIONS))


# Daily means per user; islands without a gap of more than three days, walked row by row.
ALERT_WALK = (
    SCORED_EV.replace("with ", "with recursive ", 1) + ", mn as (select user_id as series_id, time_bucket(interval 1 day, "
    "ts::timestamp, timestamp '1970-01-01') + interval 1 day as ds, avg(sentiment_score) as y from sv, wm group by 1, 2, wm having "
    "ds <= wm), gp as (select *, coalesce(ds - lag(ds) over w > interval 3 day, true) as fresh, lead(ds) over w as nx from mn window w "
    "as (partition by series_id order by ds)), nu as materialized (select *, row_number() over (partition by series_id order by ds) "
    "as i from gp), wk as (select series_id, ds, 0::bigint as i, 0::bigint as n, 0.0::double as mean, 0.0::double as m2, 0.0::double "
    "as up, 0.0::double as down, null::varchar as turn, null::double as fell, null::double as y from nu where i = 1 union all select "
    "series_id, ds, i, n + 1, mean + (y - mean) / (n + 1), m2 + (y - mean) * (y - (mean + (y - mean) / (n + 1))), case when "
    "greatest(u, d) > 2.0 and live then 0 else u end, case when greatest(u, d) > 2.0 and live then 0 else d end, case when greatest(u, "
    "d) > 2.0 and live then case when u >= d then 'up' else 'down' end end, case when n >= 3 and mean - y >= 0.5 then y - mean end, y "
    "from (select *, case when live then greatest(0, up + z - 0.5) else up end as u, case when live then greatest(0, down - z - 0.5) "
    "else down end as d from (select *, n >= 3 and m2 > 0 as live, case when m2 > 0 then (y - mean) / sqrt(m2 / n) end as z from ("
    "select wk.series_id, nu.ds, nu.i, nu.y, case when fresh then 0 else n end as n, case when fresh then 0.0 else mean end as mean, "
    "case when fresh then 0.0 else m2 end as m2, case when fresh then 0.0 else up end as up, case when fresh then 0.0 else down end as "
    "down from wk join nu on nu.series_id = wk.series_id and nu.i = wk.i + 1)))) ")


@query("stream_alerts", ALERT_WALK + "select series_id, ds, turn as kind, round(y, 9) as value from wk where turn is not null union "
       "all select series_id, ds, 'drop', round(fell, 9) from wk where fell is not null union all select series_id, ds + interval 3 "
       "day, 'silent', null from nu where nx - ds > interval 3 day or (nx is null and ds + interval 3 day <= (select max(ds) from mn))")
def _(spark, sf):
    path = scratch_path(spark, "closed-days")
    means = jobs.window_means(_stream(spark, sf), "user_id", "1 day")
    jobs.run_to_table(means, "means", path=path)
    closed = spark.readStream.schema(means.schema).parquet(path)
    with alerts.timed_state(spark):
        found = jobs.run_to_table(alerts.alert_stream(closed, 3.0, threshold=2.0, warmup=3), "alerts")
    return rounded(found.withColumn("ds", F.col("ds").cast("timestamp_ntz")))
