"""Registered queries: text, JSON, extraction, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analytics as ana
from ..operators import filters as flt
from ..operators import fraud, pipelines
from ..operators import preprocess as pre
from ..operators import spans
from ..operators import text as tx
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import readers, sinks
from . import base_sql as B
from .core import BASIC, FULL_CLEAN, TOKENS
from .registry import clean, query, rounded

# Words that do occur in the test texts, in place of real aspects and opinions.
ASPECT_WORDS = ["ther", "thin", "tion", "ment", "keit", "ing", "ble"]
OPINIONS = {"that": 0.8, "was": -0.6, "que": 0.5, "die": -0.9, "with": 0.3, "from": -0.2}
NEGATORS = ["it", "la", "der"]

OPS = "op(word, weight) as (values " + ", ".join(
    f"('{w}', {x}::double)" for w, x in OPINIONS.items()) + ")"
WORDS_CTE = ("tk as (select review_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), "
             "'[^a-z0-9]+'), lambda w: w <> '') as w from reviews), "
             "tw as (select review_id, unnest(w) as word, generate_subscripts(w, 1) - 1 as i from tk)")


@query("detect_text_col", B.REVIEWS + "select 'review_id' as \"column\", median(length(review_id)) as "
       "median_length, median(length(review_id)) > 20 as is_text from reviews union all select 'title', "
       "median(length(title)), median(length(title)) > 20 from reviews union all select 'comment', "
       "median(length(text)), median(length(text)) > 20 from reviews")
def _(spark, sf):
    r = fx.reviews(spark, sf).select("review_id", "title", F.col("text").alias("comment"))
    return tx.text_column_lengths(r).select(
        "column", "median_length", (F.col("median_length") > 20).alias("is_text"))


# Scored reviews: mentions packed per review.  Neutral ones leave their fields out, and
# the JSON of every review by a user ending in 77 is broken.
def _scored(spark, sf):
    entry = F.struct(
        F.col("pos"), F.col("aspect_term"), F.col("sentiment"), F.col("confidence"),
        F.col("timestamp"))
    neutral = F.col("sentiment") == C.NEUTRAL
    packed = fx.mentions(spark, sf).groupBy("review_id", "parent_asin", "user_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda s: F.struct(
            s["aspect_term"].alias("term"),
            F.when(s["sentiment"] != C.NEUTRAL, s["sentiment"]).alias("sentiment"),
            F.when(s["sentiment"] != C.NEUTRAL, s["confidence"]).alias("confidence"),
        )).alias("aspects"))
    js = F.to_json("aspects")
    return packed.withColumn("aspects_json", F.when(
        F.col("user_id").endswith("77"), F.concat(F.lit("[{"), js)).otherwise(js))


EXPLODED = ("ex as (select review_id, parent_asin, user_id, cast(row_number() over (partition by "
            "review_id order by pos, aspect_term, sentiment, confidence, timestamp) - 1 as integer) as "
            "pos, aspect_term, sentiment, case when sentiment = 'Neutral' then 1.0 else confidence end "
            "as confidence from mentions)")


@query("explode_aspects", f"with {B.MENTIONS_CTE}, {EXPLODED} select * exclude (user_id) from ex "
       "where user_id not like '%77'")
def _(spark, sf):
    return tx.explode_aspects(_scored(spark, sf))


@query("zip_aspects", f"with {B.MENTIONS_CTE}, {EXPLODED} select * exclude (user_id, parent_asin) "
       "from ex")
def _(spark, sf):
    s = _scored(spark, sf)
    lists = s.select("review_id", F.col("aspects.term").alias("aspects"),
                     F.col("aspects.sentiment").alias("sentiments"),
                     F.col("aspects.confidence").alias("confidence"))
    return tx.zip_aspects(lists)


@query("aspects_to_json", f"with {B.MENTIONS_CTE} select review_id, '[' || string_agg('{{\"term\":\"' "
       "|| aspect_term || '\"' || case when sentiment = 'Neutral' then '' else ',\"sentiment\":\"' || "
       "sentiment || '\"' end || '}', ',' order by pos, aspect_term, sentiment, confidence, timestamp) "
       "|| ']' as aspects_json from mentions group by 1")
def _(spark, sf):
    s = _scored(spark, sf).withColumn("aspects", F.transform("aspects", lambda a: F.struct(
        a["term"].alias("term"), a["sentiment"].alias("sentiment"))))
    return s.select("review_id", tx.aspects_to_json("aspects").alias("aspects_json"))


@query("scored_to_mentions", f"with {B.MAP_CTE}, {B.MENTIONS_CTE}, {EXPLODED}, n as (select ex.*, "
       "coalesce(canonical, lower(trim(aspect_term))) as aspect_term_normalized from ex left join "
       "aspect_map on lower(trim(aspect_term)) = variant where user_id not like '%77'), d as (select * "
       "from n qualify row_number() over (partition by review_id, aspect_term_normalized order by pos) "
       "= 1) select review_id, aspect_term_normalized, sentiment, confidence from d where confidence "
       f">= 0.5 and aspect_term_normalized not in ({B.in_list(pre.L.EXCLUDED_ASPECTS)})")
def _(spark, sf):
    return pipelines.scored_to_mentions(_scored(spark, sf)).select(
        "review_id", "aspect_term_normalized", "sentiment", "confidence")


@query("inference_summary", B.MENTIONS + "select count(distinct review_id) as reviews, count(*) as "
       "total_aspects, round(count(*) / count(distinct review_id), 9) as avg_aspects from mentions")
def _(spark, sf):
    return rounded(ana.inference_summary(_scored(spark, sf)))


@query("advanced_preprocess", B.REVIEWS_MORE + "m as (select parent_asin, median(rating) as md from "
       "reviews where parent_asin is not null group by 1), i as (select reviews.* replace "
       "(coalesce(rating, md) as rating) from reviews left join m using (parent_asin)) select review_id, "
       "rating, " + FULL_CLEAN.format("text") + " as text from i where not (length(text) < 10 or "
       "length(text) > 2000 or coalesce(rating = 1 and contains(lower(text), 'great'), false) or "
       "coalesce(rating = 5 and contains(lower(text), 'terrible'), false))")
def _(spark, sf):
    return pipelines.advanced_preprocess(fx.reviews(spark, sf)).select("review_id", "rating", "text")


@query("explore_preprocess", B.REVIEWS_MORE + "c as (select *, " +
       BASIC.format("trim(coalesce(title, '') || ' ' || coalesce(text, ''))") + " as review_clean from "
       "reviews where rating is not null) select review_id, coalesce(parent_asin, 'UNKNOWN') as "
       "parent_asin, coalesce(user_id, 'UNKNOWN') as user_id, review_clean, cast(length(review_clean) as "
       "integer) as review_length, cast(len(list_filter(string_split(review_clean, ' '), lambda w: w <> "
       "'')) as integer) as word_count from c")
def _(spark, sf):
    return pipelines.explore_preprocess(fx.reviews(spark, sf)).select(
        "review_id", "parent_asin", "user_id", "review_clean", "review_length", "word_count")


EXTRACT = (B.REVIEWS_MORE + OPS + ", " + WORDS_CTE + ", ht as (select tw.*, op.word is not null as "
           f"is_op, weight, tw.word in ({B.in_list(ASPECT_WORDS)}) as is_asp from tw left join op on "
           "op.word = tw.word where op.word is not null or tw.word in "
           f"({B.in_list(ASPECT_WORDS)})), nr as (select *, last_value(case when is_op then i end ignore "
           "nulls) over (w rows between unbounded preceding and 1 preceding) as pi, last_value(weight "
           "ignore nulls) over (w rows between unbounded preceding and 1 preceding) as pw, "
           "first_value(case when is_op then i end ignore nulls) over (w rows between 1 following and "
           "unbounded following) as ni, first_value(weight ignore nulls) over (w rows between 1 "
           "following and unbounded following) as nw from ht window w as (partition by review_id order "
           "by i)), ds as (select *, coalesce(i - pi, 6) as dp, coalesce(ni - i, 6) as dn from nr where "
           "is_asp), dd as (select *, least(dp, dn) as d, case when dp <= dn then pw else nw end as wt "
           "from ds), asp as (select review_id, cast(i as integer) as token_pos, word as term, case when "
           "d <= 5 and wt > 0 then 'Positive' when d <= 5 and wt < 0 then 'Negative' else 'Neutral' end "
           "as sentiment, case when d <= 5 then round(1 - (d - 1) * 0.1::double, 2) else 0.5::double end "
           "as confidence from dd) ")


def _extract(spark, sf):
    return tx.extract_aspects(fx.reviews(spark, sf), ASPECT_WORDS, OPINIONS)


@query("extract_aspects", EXTRACT + "select * from asp")
def _(spark, sf):
    return _extract(spark, sf)


@query("score_reviews", EXTRACT + "select r.review_id, count(asp.term) as aspects, "
       "coalesce(string_agg(term || ':' || sentiment, ',' order by token_pos), '') as terms from reviews "
       "r left join asp on asp.review_id = r.review_id group by 1")
def _(spark, sf):
    s = tx.score_reviews(fx.reviews(spark, sf).select("review_id", "text"), aspects=ASPECT_WORDS,
                         opinions=OPINIONS)
    return s.select("review_id", F.size("aspects").cast("bigint").alias("aspects"), F.array_join(
        F.transform("aspects", lambda a: F.concat(a["term"], F.lit(":"), a["sentiment"])), ",")
        .alias("terms"))


def keyword_scorer():
    """Smallest possible model: known words are neutral aspects."""
    known = set(ASPECT_WORDS)

    def score(texts):
        out = []
        for text in texts:
            seen = [w for w in text.lower().split() if w in known]
            out.append([{"term": w, "sentiment": "Neutral", "confidence": 0.5} for w in seen])
        return out

    return score


@query("extract_with_scorer", B.REVIEWS_MORE + "w as (select review_id, unnest(regexp_split_to_array("
       "lower(text), '\\s+')) as word from reviews) select r.review_id, count(word) as aspects from "
       f"reviews r left join (select * from w where word in ({B.in_list(ASPECT_WORDS)})) k on "
       "k.review_id = r.review_id where trim(text) <> '' group by 1")
def _(spark, sf):
    return tx.score_with_model(fx.reviews(spark, sf), keyword_scorer).select(
        "review_id", F.size("aspects").cast("bigint").alias("aspects"))


POLARITY = (B.REVIEWS_MORE + OPS + ", " + WORDS_CTE + ", pv as (select *, lag(word) over (partition by "
            "review_id order by i) as prev from tw), pl as (select review_id, avg(case when prev in "
            f"({B.in_list(NEGATORS)}) then -weight else weight end) as p from pv join op using (word) "
            "group by 1), pol as (select reviews.*, round(coalesce(p, 0), 9) as polarity from reviews "
            "left join pl using (review_id)) ")


def _polar(spark, sf):
    return rounded(tx.text_polarity(fx.reviews(spark, sf), opinions=OPINIONS, negations=NEGATORS))


@query("text_polarity", POLARITY + "select review_id, polarity from pol")
def _(spark, sf):
    return _polar(spark, sf).select("review_id", "polarity")


@query("rating_mismatch", POLARITY + "select review_id, coalesce((rating >= 4 and polarity < 0) or "
       "(rating <= 2 and polarity > 0), false) as mismatch from pol")
def _(spark, sf):
    return fraud.rating_mismatch(_polar(spark, sf)).select("review_id", "mismatch")


@query("word_frequency", "with w as (select unnest(" + TOKENS.format("text") + ") as word from "
       "documents) select word, count(*) as n from w group by 1 order by n desc, 1 limit 20")
def _(spark, sf):
    return tx.word_frequency(fx.documents(spark, sf))


@query("vocabulary", "with t as (select doc_id, " + TOKENS.format("text") + " as w from documents), "
       "d as (select * from t where len(w) > 0), u as (select distinct doc_id, unnest(w) as term from d) "
       "select term, count(*) as df from u group by 1 having df >= 2 and df <= 0.5 * (select count(*) "
       "from d)")
def _(spark, sf):
    return tx.vocabulary(fx.documents(spark, sf))


def tfidf_sql(table, key, features, bigrams=False):
    grams = ("list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
             if bigrams else "w")
    return (f"t as (select {key}, {TOKENS.format('text')} as w from {table}), g as (select {key}, "
            f"unnest({grams}) as term from t), tf as (select {key}, term, count(*) as tf from g group by "
            f"1, 2), vo as (select term, ln((1 + (select count(*) from {table})) / (1 + count(*))) + 1 "
            f"as idf from tf group by 1 order by sum(tf) desc, term limit {features}), "
            f"wt as (select {key}, term, tf, tf * idf as w from tf join vo using (term)), "
            f"tfidf as (select {key}, term, tf, w / sqrt(sum(w * w) over (partition by {key})) as weight "
            "from wt) ")


@query("tfidf_terms", "with " + tfidf_sql("documents", "doc_id", 500, True) +
       "select doc_id, term, tf, round(weight, 6) as weight from tfidf")
def _(spark, sf):
    return rounded(tx.tfidf(fx.documents(spark, sf), "doc_id", max_features=500,
                            ngram=(1, 2)), 6)


@query("nfkc_clean", "select doc_id, " + FULL_CLEAN.format("nfc_normalize(text)") +
       " as clean from documents")
def _(spark, sf):
    return tx.nfkc(fx.documents(spark, sf).select("doc_id", "text")).select(
        "doc_id", C.clean_text_full("text").alias("clean"))


# ---------------------------------------------------------------- sources and sinks

@query("src_parquet", B.PRODUCTS + "select parent_asin, title, main_category, average_rating from "
                                   "products")
def _(spark, sf):
    path = scratch_path(spark, "products")
    fx.products(spark, sf).write.parquet(path)
    return readers.read_products(spark, path).drop("price")


@query("src_jsonl", B.REVIEWS + "select review_id, rating, title, text, asin, parent_asin, user_id, "
       "helpful_vote, verified_purchase, has_image, date from reviews")
def _(spark, sf):
    path = scratch_path(spark, "reviews-json")
    millis = (F.unix_date("date").cast("bigint") * 86_400_000).cast("string")
    (fx.reviews(spark, sf).withColumn("timestamp", millis).drop("date", "lang").write.json(path))
    return readers.read_reviews(spark, path).select(
        "review_id", "rating", "title", "text", "asin", "parent_asin", "user_id", "helpful_vote",
        "verified_purchase", F.col("images").isNotNull().alias("has_image"),
        F.col("timestamp").cast("date").alias("date"))


@query("src_csv", B.REVIEWS + "select review_id, rating, text, user_id, parent_asin from reviews")
def _(spark, sf):
    path = scratch_path(spark, "scored-csv")
    r = fx.reviews(spark, sf).select(
        "review_id", "rating", "text", F.col("date").cast("string").alias("timestamp"), "user_id",
        "parent_asin", F.lit("[]").alias("aspects_json"))
    r.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_scored_csv(spark, path).select(
        "review_id", "rating", "text", "user_id", "parent_asin")


@query("src_mentions", B.CLEAN + "select review_id, aspect_term_normalized, date, sentiment_score "
                                 "from clean")
def _(spark, sf):
    path = scratch_path(spark, "mentions")
    sinks.save_preprocessed(clean(spark, sf).drop("year", "month"), path)
    return readers.read_mentions(spark, path).select(
        "review_id", "aspect_term_normalized", "date", "sentiment_score")


@query("sink_csv", B.CLEAN + "select year, month, count(*) as n from clean group by 1, 2")
def _(spark, sf):
    path = scratch_path(spark, "results-csv")
    sinks.write_results(clean(spark, sf).select("review_id", "aspect_term", "timestamp"), path)
    return (spark.read.option("header", True).schema(
        "review_id string, aspect_term string, timestamp string, year int, month int").csv(path)
        .groupBy("year", "month").agg(F.count("*").alias("n")))


@query("sink_parquet", B.CLEAN + "select year_month, count(*) as n from clean group by 1")
def _(spark, sf):
    path = scratch_path(spark, "clean-parquet")
    sinks.save_preprocessed(clean(spark, sf), path)
    return spark.read.parquet(path).groupBy("year_month").agg(F.count("*").alias("n"))


@query("incremental_append", B.REVIEWS + "select review_id, strftime(date, '%Y-%m') as year_month "
                                         "from reviews")
def _(spark, sf):
    path = scratch_path(spark, "incremental")
    r = fx.reviews(spark, sf).select("review_id", "rating", "date")
    sinks.append_incremental(r.where(F.col("date") < "2020-07-01"), path, "date")
    for _ in range(2):
        sinks.append_incremental(r, path, "date")
    return spark.read.parquet(path).select("review_id", F.col("year_month").cast("string"))


@query("report_sink", B.CLEAN + "select 'sentiment' as report, count(distinct sentiment) as rows from "
       "clean union all select 'categories', count(distinct aspect_term_normalized) from clean")
def _(spark, sf):
    path = scratch_path(spark, "report")
    c = clean(spark, sf)
    tables = {"sentiment": ana.value_counts(c, "sentiment"),
              "categories": ana.value_counts(c, "aspect_term_normalized"),
              "empty": c.where("confidence > 2")}
    out = None
    for name in sinks.write_report(tables, path):
        part = spark.read.json(f"{path}/{name}").agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("report"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


# Words and what stands between them in turn: running lengths give the places.
SPANS = (B.REVIEWS_MORE + "lw as (select review_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w, regexp_extract_all("
         "lower(text), '[^a-z0-9]+') as g, regexp_matches(lower(text), '^[a-z0-9]') as at_once from reviews), "
         "pt as (select review_id, unnest(w) as word, generate_subscripts(w, 1) as i, unnest(case when at_once then list_prepend('', g) "
         "else g end) as gap from lw), ln as (select review_id, word, i, sum(length(word) + length(coalesce(gap, ''))) over (partition "
         "by review_id order by i rows unbounded preceding) as upto from pt where word is not null) ")


@query("aspect_spans", SPANS + "select review_id, cast(i - 1 as integer) as token_pos, word as term, cast(upto - length(word) as "
       f"integer) as start, cast(upto as integer) as \"end\" from ln where word in ({B.in_list(ASPECT_WORDS)})")
def _(spark, sf):
    return spans.with_spans(fx.reviews(spark, sf).select("review_id", "text"), terms=ASPECT_WORDS).drop("text")
