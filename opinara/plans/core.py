"""Registered queries: preparation, filters, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicons as L
from ..operators import filters as flt
from ..operators import preprocess as pre
from ..sources import fixtures as fx
from . import base_sql as B
from .registry import clean, full, query, rounded

FULL_COLS = ("review_id, parent_asin, user_id, rating, timestamp, pos, aspect_term, "
             "aspect_term_normalized, sentiment, confidence, title, main_category, "
             "average_rating, try_cast(price as double) as price, has_metadata, sentiment_score, "
             "year_month, week, date, year, month, day_of_week, is_positive, is_negative, "
             "is_neutral")


def _tidy(df):
    keep = [c.split(" as ")[-1] for c in FULL_COLS.split(", ")]
    return df.withColumn("price", C.price_value("price")).select(*keep)


@query("preprocess", B.CLEAN + f"select {FULL_COLS} from clean")
def _(spark, sf):
    return _tidy(full(spark, sf))


@query("normalize_aspects",
       B.NORMED + "select aspect_term, aspect_term_normalized, count(*) as mention_count "
                  "from normed group by 1, 2")
def _(spark, sf):
    return (pre.normalize_aspects(fx.mentions(spark, sf))
            .groupBy("aspect_term", "aspect_term_normalized")
            .agg(F.count(F.lit(1)).alias("mention_count")))


@query("merge_metadata",
       f"with {B.MENTIONS_CTE}, {B.PRODUCTS_CTE} "
       "select review_id, parent_asin, pos, aspect_term, confidence, title, main_category, "
       "average_rating, title is not null as has_metadata "
       "from mentions left join products using (parent_asin)")
def _(spark, sf):
    return pre.merge_metadata(fx.mentions(spark, sf), fx.products(spark, sf)).select(
        "review_id", "parent_asin", "pos", "aspect_term", "confidence", "title",
        "main_category", "average_rating", "has_metadata")


@query("metadata_coverage",
       f"with {B.MENTIONS_CTE}, {B.PRODUCTS_CTE} "
       "select count(*) as mention_count, count(title) as with_metadata, "
       "count(*) - count(title) as without_metadata, "
       "round(100.0 * count(title) / count(*), 9) as coverage_pct "
       "from mentions left join products using (parent_asin)")
def _(spark, sf):
    return rounded(pre.metadata_coverage(
        pre.merge_metadata(fx.mentions(spark, sf), fx.products(spark, sf))))


@query("dedup_mentions",
       B.NORMED.rstrip() + ", " + B.CLEAN_CTE.split(",\nclean as")[0] +
       " select review_id, aspect_term_normalized, pos, aspect_term, sentiment, confidence "
       "from deduped")
def _(spark, sf):
    return pre.dedup_mentions(pre.normalize_aspects(fx.mentions(spark, sf))).select(
        "review_id", "aspect_term_normalized", "pos", "aspect_term", "sentiment", "confidence")


@query("dedup_reviews", B.REVIEWS + "select distinct title, text, rating from reviews")
def _(spark, sf):
    return fx.reviews(spark, sf).select("title", "text", "rating").dropDuplicates()


@query("filter_confidence", B.MENTIONS + "select review_id, pos, confidence from mentions "
                                         "where confidence >= 0.5")
def _(spark, sf):
    return pre.min_confidence(fx.mentions(spark, sf)).select("review_id", "pos", "confidence")


@query("filter_generic",
       B.NORMED + "select review_id, pos, aspect_term_normalized from normed where "
       f"aspect_term_normalized not in ({B.in_list(L.EXCLUDED_ASPECTS)})")
def _(spark, sf):
    return pre.exclude_generic(pre.normalize_aspects(fx.mentions(spark, sf))).select(
        "review_id", "pos", "aspect_term_normalized")


@query("filter_year_month",
       B.MENTIONS + "select review_id, pos, timestamp from mentions "
                    "where year(timestamp) = 1997 and month(timestamp) = 12")
def _(spark, sf):
    return flt.filter_year_month(fx.mentions(spark, sf), 1997, 12).select(
        "review_id", "pos", "timestamp")


@query("filter_verified", B.MENTIONS + "select review_id, pos from mentions where verified_purchase")
def _(spark, sf):
    return flt.verified_only(fx.mentions(spark, sf)).select("review_id", "pos")


@query("dropna", B.REVIEWS + "select review_id, rating, parent_asin from reviews "
                             "where rating is not null and parent_asin is not null")
def _(spark, sf):
    return flt.require_non_null(fx.reviews(spark, sf), ["rating", "parent_asin"]).select(
        "review_id", "rating", "parent_asin")


@query("empty_reviews",
       B.REVIEWS + "select review_id, coalesce(title, '') as title from reviews "
                   "where regexp_replace(coalesce(title, ''), '\\s+', '', 'g') = ''")
def _(spark, sf):
    return flt.empty_text(fx.reviews(spark, sf), "title").select(
        "review_id", F.coalesce("title", F.lit("")).alias("title"))


@query("filter_date_range",
       B.CLEAN + "select review_id, aspect_term_normalized, date from clean "
                 "where date between date '1997-03-01' and date '1997-09-30'")
def _(spark, sf):
    return flt.filter_by_date_range(clean(spark, sf), "1997-03-01", "1997-09-30").select(
        "review_id", "aspect_term_normalized", "date")


@query("filter_dims",
       B.CLEAN + "select review_id, aspect_term_normalized, main_category, sentiment from clean "
                 "where main_category = 'ECONOMY' and sentiment = 'Negative'")
def _(spark, sf):
    return flt.filter_dims(full(spark, sf), category="ECONOMY", sentiment="Negative").select(
        "review_id", "aspect_term_normalized", "main_category", "sentiment")


@query("global_filters",
       B.CLEAN + "select review_id, aspect_term_normalized, date, confidence from clean "
                 "where date between date '1996-01-01' and date '1998-12-31' and confidence >= 0.7 "
                 "and main_category = 'SMALL' and sentiment = 'Positive'")
def _(spark, sf):
    return flt.apply_global_filters(
        full(spark, sf), "1996-01-01", "1998-12-31", 0.7, "SMALL", "All", "Positive"
    ).select("review_id", "aspect_term_normalized", "date", "confidence")


@query("title_search", B.PRODUCTS + "select parent_asin, title from products "
                                    "where lower(title) like '%widget%'")
def _(spark, sf):
    return flt.title_search(fx.products(spark, sf), "WIDGET").select("parent_asin", "title")


@query("drop_suspicious",
       B.REVIEWS + "select review_id, rating, length(text) as n from reviews where not ("
       "length(text) < 10 or length(text) > 2000 "
       "or coalesce(rating = 1 and contains(lower(text), 'great'), false) "
       "or coalesce(rating = 5 and contains(lower(text), 'terrible'), false))")
def _(spark, sf):
    return flt.drop_suspicious(fx.reviews(spark, sf)).select(
        "review_id", "rating", F.length("text").cast("bigint").alias("n"))


@query("rating_label",
       B.REVIEWS + "select case when rating >= 4 then 'positive' when rating <= 2 then 'negative' "
                   "else 'neutral' end as label, count(*) as n from reviews group by 1")
def _(spark, sf):
    return (fx.reviews(spark, sf).groupBy(C.rating_label().alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("review_full",
       B.REVIEWS + "select review_id, trim(coalesce(title, '') || ' ' || coalesce(text, '')) "
                   "as review_full from reviews")
def _(spark, sf):
    return fx.reviews(spark, sf).select("review_id", C.review_full().alias("review_full"))


@query("fill_unknown",
       B.REVIEWS + "select review_id, coalesce(parent_asin, 'UNKNOWN') as parent_asin, "
                   "coalesce(user_id, 'UNKNOWN') as user_id from reviews")
def _(spark, sf):
    return flt.fill_unknown(fx.reviews(spark, sf)).select("review_id", "parent_asin", "user_id")


@query("validate_reviews",
       B.REVIEWS_MORE + "v as (select *, trim(regexp_replace(" +
       "replace(" * 9 + "text" +
       ", '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), "
       "'&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')" +
       ", '\\s+', ' ', 'g')) as t2, "
       "case when verified_purchase then cast(helpful_vote as varchar) "
       "else cast(helpful_vote as varchar) || ' out of 10' end as hv, "
       "rating + case when has_image then 0 else 2 end as r2 from reviews) "
       "select review_id, parent_asin, case when r2 between 1 and 5 then r2 end as rating, "
       "cast(date as timestamp) as timestamp, t2 as text, title, verified_purchase, user_id, "
       "helpful_vote as helpful_yes, "
       "case when not verified_purchase and helpful_vote is not null then 10 end as helpful_total, "
       "regexp_full_match(parent_asin, '[A-Za-z0-9]{10}') as valid_asin, "
       "length(trim(coalesce(title, ''))) > 0 as has_title, "
       "cast(quarter(date) as integer) as quarter from v where length(t2) >= 10")
def _(spark, sf):
    votes = F.col("helpful_vote").cast("string")
    raw = fx.reviews(spark, sf).withColumns({
        "timestamp": F.col("date").cast("timestamp_ntz"),
        "helpful_vote": F.when(F.col("verified_purchase"), votes)
        .otherwise(F.concat(votes, F.lit(" out of 10"))),
        "rating": F.col("rating") + F.when(F.col("images").isNull(), 2).otherwise(0),
    })
    return flt.validate_reviews(raw)


# ---------------------------------------------------------------- scalar functions

@query("sentiment_score",
       B.MENTIONS + "select review_id, pos, case sentiment when 'Positive' then confidence when "
                    "'Negative' then -confidence else 0.0::double end as sentiment_score "
                    "from mentions")
def _(spark, sf):
    return fx.mentions(spark, sf).select("review_id", "pos",
                                         C.sentiment_score().alias("sentiment_score"))


@query("sentiment_flags",
       B.MENTIONS + "select review_id, pos, cast(sentiment = 'Positive' as integer) as is_positive, "
                    "cast(sentiment = 'Negative' as integer) as is_negative, "
                    "cast(sentiment = 'Neutral' as integer) as is_neutral from mentions")
def _(spark, sf):
    return fx.mentions(spark, sf).withColumns(C.sentiment_flags()).select(
        "review_id", "pos", "is_positive", "is_negative", "is_neutral")


@query("calendar_fields",
       "select o_orderkey, cast(date_trunc('month', o_orderdate) as date) as year_month, "
       "cast(date_trunc('week', o_orderdate) as date) as week, "
       "cast(o_orderdate as date) as date, cast(year(o_orderdate) as integer) as year, "
       "cast(month(o_orderdate) as integer) as month, dayname(o_orderdate) as day_of_week "
       "from orders")
def _(spark, sf):
    return C.calendar_fields(fx.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"),
                             "o_orderdate").drop("o_orderdate")


@query("period_labels",
       "select o_orderkey, cast(o_orderdate as date) as day, "
       "cast(date_trunc('week', o_orderdate) as date) as week_start, "
       "cast(date_trunc('week', o_orderdate) as date) + 6 as week_end, "
       "cast(date_trunc('month', o_orderdate) as date) as month_start, "
       "last_day(o_orderdate) as month_end from orders")
def _(spark, sf):
    d = "o_orderdate"
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", C.period_end(d, "D").alias("day"), C.period_start(d, "W").alias("week_start"),
        C.period_end(d, "W").alias("week_end"), C.period_start(d, "M").alias("month_start"),
        C.period_end(d, "M").alias("month_end"))


@query("parse_ts",
       "with raw as (select event_id, ts, case event_id % 3 when 0 then "
       "cast(epoch_ms(ts) as varchar) when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') "
       "else 'n/a' end as t from events) select event_id, "
       "case event_id % 3 when 0 then date_trunc('millisecond', ts) "
       "when 1 then date_trunc('second', ts) end as parsed from raw")
def _(spark, sf):
    ts = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 3 == 0, F.unix_millis(ts).cast("string")).when(
        F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise("n/a")
    return fx.table(spark, sf, "events").withColumn("raw", raw).select(
        "event_id", C.parse_timestamp("raw").cast("timestamp_ntz").alias("parsed"))


@query("price_missing",
       B.PRODUCTS + "select count(*) as products, count(*) filter (where try_cast(price as double) "
                    "is null) as missing_price, round(100.0 * count(*) filter (where "
                    "try_cast(price as double) is null) / count(*), 9) as missing_pct, "
                    "round(avg(try_cast(price as double)), 6) as avg_price from products")
def _(spark, sf):
    p = C.price_value("price")
    return fx.products(spark, sf).agg(
        F.count(F.lit(1)).alias("products"), C.count_if(p.isNull()).alias("missing_price"),
        F.round(C.percent(C.count_if(p.isNull()), F.count(F.lit(1))), 9).alias("missing_pct"),
        F.round(F.avg(p), 6).alias("avg_price"))


@query("truncate_text",
       "select doc_id, case when length(text) > 50 then substring(text, 1, 47) || '...' else text "
       "end as short, case when length(text) > 300 then substring(text, 1, 300) || '...' "
       "else text end as snippet, substring(text, 1, 500) as stored from documents")
def _(spark, sf):
    return fx.documents(spark, sf).select(
        "doc_id", C.ellipsize("text", 50).alias("short"), C.cut("text", 300).alias("snippet"),
        F.substring("text", 1, 500).alias("stored"))


@query("scrub_pii",
       "select doc_id, regexp_replace(regexp_replace(text, '[\\w\\.-]+@[\\w\\.-]+', "
       "'[REDACTED_EMAIL]', 'g'), '\\+?\\d[\\d\\-\\s]{6,}\\d', '[REDACTED_PHONE]', 'g') as text "
       "from documents")
def _(spark, sf):
    return fx.documents(spark, sf).select("doc_id", C.scrub_pii("text").alias("text"))


BASIC = ("trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), "
         "'http\\S+|www\\S+', '', 'g'), '<br\\s*/?>', ' ', 'g'), '[^a-z\\s]', '', 'g'), "
         "'\\s+', ' ', 'g'))")
FULL_CLEAN = ("array_to_string(list_filter(string_split(lower(trim(regexp_replace(regexp_replace("
              "regexp_replace(coalesce({0}, ''), 'http\\S+|www\\S+', '', 'g'), "
              "'[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))), ' '), "
              f"lambda w: w <> '' and w not in ({B.in_list(L.STOP_WORDS)})), ' ')")
TOKENS = ("list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), "
          f"lambda w: length(w) > 2 and w not in ({B.in_list(L.STOP_WORDS)}))")


@query("clean_text_basic", "select page_id, " + BASIC.format("html") + " as clean from pages")
def _(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", C.clean_text_basic("html").alias("clean"))


@query("clean_text_full", "select doc_id, " + FULL_CLEAN.format("text") + " as clean from documents")
def _(spark, sf):
    return fx.documents(spark, sf).select("doc_id", C.clean_text_full("text").alias("clean"))


@query("topic_tokens", "select doc_id, array_to_string(" + TOKENS.format("text") +
       ", ' ') as tokens from documents")
def _(spark, sf):
    return fx.documents(spark, sf).select(
        "doc_id", F.array_join(C.topic_tokens("text"), " ").alias("tokens"))


@query("text_lengths",
       "select doc_id, length(text) as n_chars, len(list_filter(regexp_split_to_array(trim("
       "regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')) as n_words from documents")
def _(spark, sf):
    return fx.documents(spark, sf).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"),
        F.size(C.words(F.trim(F.regexp_replace("text", r"\s+", " ")))).cast("bigint").alias("n_words"))


@query("repetition_flag",
       "with t as (select doc_id, list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', "
       "'g')), ' '), lambda w: w <> '') as w from documents), "
       "g as (select doc_id, unnest(list_transform(range(1, len(w)), "
       "lambda i: w[i] || ' ' || w[i + 1])) as gram from t), "
       "r as (select distinct doc_id from (select doc_id, gram from g group by 1, 2 "
       "having count(*) >= 3)) "
       "select d.doc_id, r.doc_id is not null as repetition_flag "
       "from documents d left join r using (doc_id)")
def _(spark, sf):
    return fx.documents(spark, sf).select(
        "doc_id", C.repeats_ngram("text").alias("repetition_flag"))


@query("format_cols",
       "select o_orderkey, format('{:.1f}%', o_totalprice / 7777) as pct, "
       "format('{:.2f}', o_totalprice / 7777) as score from orders")
def _(spark, sf):
    x = F.col("o_totalprice") / 7777
    return fx.table(spark, sf, "orders").select(
        "o_orderkey", C.format_percentage(x).alias("pct"), C.format_score(x).alias("score"))


@query("cosine_similarity",
       "with e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), "
       "u as (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e), "
       "m as (select label, i, avg(x) as x from u group by 1, 2), "
       "c as (select label, list(x order by i) as c from m group by 1) "
       "select vec_id, round(list_cosine_similarity(v, c), 6) as cosine from e join c using (label)")
def _(spark, sf):
    from ..operators.retrieval import label_centroids

    e = fx.table(spark, sf, "embeddings")
    return e.join(label_centroids(e), "label").select(
        "vec_id", F.round(C.cosine("embedding", "centroid"), 6).alias("cosine"))
