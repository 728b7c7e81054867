"""Registered queries: neighbours, retrieval, prompts, answers, cache."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import answers as ans
from ..operators import density, embedder
from ..operators import retrieval as ret
from ..operators import similarity as sim
from ..operators import textindex
from ..operators import vectorstore as store
from ..session import materialize, scratch_path
from ..sources import fixtures as fx
from ..sources import readers, sinks
from . import base_sql as B
from .core import TOKENS
from .registry import query, rounded

VECTORS = ("e as (select vec_id, label, cast(embedding as double[]) as v from embeddings), "
           "u as (select label, unnest(v) as x, generate_subscripts(v, 1) as i from e), "
           "m as (select label, i, avg(x) as x from u group by 1, 2), "
           "cen as (select label, list(x order by i) as c from m group by 1) ")
RANK = "cast(row_number() over (partition by question_id order by score desc, review_id) as integer)"
SCORES = (VECTORS + ", sc as (select cast(cen.label as bigint) as question_id, cast(vec_id as varchar) "
          "as review_id, e.label as owner, round(list_cosine_similarity(c, v), 9) as score from e, cen) ")


def _corpus(spark, sf):
    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("review_id"),
        F.col("label").cast("string").alias("parent_asin"), "embedding")


def _label_questions(spark, sf):
    """One question per product: the mean of all its vectors."""
    return ret.label_centroids(fx.table(spark, sf, "embeddings")).select(
        F.col("label").cast("bigint").alias("question_id"),
        F.col("label").cast("string").alias("parent_asin"), F.col("centroid").alias("embedding"))


@query("embedding_table", "select cast(vec_id as varchar) as review_id, cast(label as varchar) as "
       "parent_asin, date '2020-01-01' + cast(vec_id % 366 as integer) as date, substring("
       "regexp_replace(regexp_replace(text, '[\\w\\.-]+@[\\w\\.-]+', '[REDACTED_EMAIL]', 'g'), "
       "'\\+?\\d[\\d\\-\\s]{6,}\\d', '[REDACTED_PHONE]', 'g'), 1, 300) as text_preview, "
       "cast(len(embedding) as integer) as dims, 1.0::double as norm from embeddings left join documents on "
       "doc_id = vec_id")
def _(spark, sf):
    path = scratch_path(spark, "embeddings")
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("vec_id"), "text")
    e = fx.table(spark, sf, "embeddings").join(docs, "vec_id", "left").select(
        F.col("vec_id").alias("review_id"), F.col("label").alias("parent_asin"), "text", "embedding",
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("vec_id") % 366).cast("int")).alias("date"))
    sinks.persist_embeddings(ret.build_corpus(e), path)
    sinks.persist_embeddings(e.limit(0), path)  # refused: the table exists
    return readers.load_embeddings(spark, path).select(
        "review_id", "parent_asin", "date", "text_preview", F.size("embedding").alias("dims"),
        F.round(ret.C.l2_norm("embedding"), 4).alias("norm"))


@query("knn_topk", f"with {SCORES} select question_id, review_id, score, {RANK} as rank from sc "
                   "qualify rank <= 10")
def _(spark, sf):
    return ret.retrieve_top_k(_corpus(spark, sf), _label_questions(spark, sf), 10)


@query("knn_product", f"with {SCORES} select question_id, review_id, score, {RANK} as rank from sc "
                      "where owner = question_id qualify rank <= 8")
def _(spark, sf):
    return ret.retrieve_top_k(_corpus(spark, sf), _label_questions(spark, sf), 8, same_product=True)


@query("knn_post_filter", f"with {SCORES}, t as (select *, {RANK} as rk from sc qualify rk <= 50) "
       f"select question_id, review_id, score, {RANK} as rank from t where owner = question_id "
       "qualify rank <= 8")
def _(spark, sf):
    c, q = _corpus(spark, sf), _label_questions(spark, sf)
    return ret.post_filter_product(ret.retrieve_top_k(c, q, 50), c, q, 8).select(
        "question_id", "review_id", "score", "rank")


@query("density_outliers", f"with {VECTORS}, p as (select a.vec_id as id, b.vec_id as nbr, round(sqrt("
       "greatest(0, 2 - 2 * list_cosine_similarity(a.v, b.v))), 9) as d from e a join e b on a.vec_id <> "
       "b.vec_id), k as (select * from p qualify row_number() over (partition by id order by d, nbr) <= "
       "10), c as (select id, max(d) as cd from k group by 1), n as (select k.id, avg(c.cd) as m from k "
       "join c on c.id = k.nbr group by 1) select c.id as vec_id, round(cd, 6) as core_distance, "
       "round(cd / m, 6) as density_ratio from c join n using (id)")
def _(spark, sf):
    return rounded(sim.density_outliers(fx.table(spark, sf, "embeddings"), k=10), 6)


@query("dbscan", f"with recursive {VECTORS}, adj as materialized (select a.vec_id as a, b.vec_id as b "
       "from e a join e b on round(1 - list_cosine_similarity(a.v, b.v), 9) <= 0.7), core as "
       "materialized (select a as id from adj group by 1 having count(*) >= 5), ca as materialized "
       "(select a, b from adj semi join core on core.id = a where b in (select id from core)), "
       "r as (select id, id as root from core union select ca.b, r.root from r join ca on ca.a = r.id), "
       "rt as (select id, min(root) as root from r group by 1), bd as (select a as id, min(root) as "
       "root from adj join rt on rt.id = b where a not in (select id from core) group by 1) "
       "select vec_id, coalesce(rt.root, bd.root, -1) as cluster from e left join rt on rt.id = vec_id "
       "left join bd on bd.id = vec_id")
def _(spark, sf):
    return sim.dbscan(fx.table(spark, sf, "embeddings"), eps=0.7, min_points=5)


# Prim's algorithm over the matrix of mutual reachability distances, one vector a step.
TREE_SQL = (
    f"with recursive {VECTORS}, p as (select a.vec_id as id, b.vec_id as nbr, round(sqrt(greatest(0, 2 - 2 * "
    "list_cosine_similarity(a.v, b.v))), 9) as d from e a join e b on a.vec_id <> b.vec_id), k as (select * from p qualify "
    "row_number() over (partition by id order by d, nbr) <= 10), c as materialized (select id, max(d) as cd from k group by 1), "
    "ix as materialized (select id, row_number() over (order by id) as i from c), "
    "w as (select x.i, y.i as j, greatest(d, a.cd, b.cd) as w from p join c a on a.id = p.id join c b on b.id = p.nbr join ix x "
    "on x.id = p.id join ix y on y.id = p.nbr union all select i, i, 1e9 from ix), "
    "mat as materialized (select i, list(w order by j) as ws from w group by 1), "
    "tr as (select 1::bigint as i, 0::bigint as step, ws as best, [1::bigint] as seen, 0.0::double as weight from mat where i = 1 "
    "union all select n.i, n.step, list_transform(n.best, lambda b, k: least(b, mat.ws[k])), list_append(n.seen, n.i), n.weight "
    "from (select list_position(masked, list_min(masked)) as i, step + 1 as step, best, seen, list_min(masked) as weight from ("
    "select *, list_transform(best, lambda b, k: case when list_contains(seen, k) then 1e9 else b end) as masked from tr where "
    "len(seen) < len(best)) as open) as n join mat on mat.i = n.i) ")


def _density_tree(spark, sf):
    reps, _ = sim.distinct_vectors(fx.table(spark, sf, "embeddings"), "vec_id", "embedding")
    return density.spanning_tree(reps, 10)


@query("density_tree", TREE_SQL + "select round(weight, 6) as weight, count(*) as edges from tr where step > 0 group by 1")
def _(spark, sf):
    _, tree = _density_tree(spark, sf)
    return tree.groupBy(F.round("dist", 6).alias("weight")).agg(F.count("*").alias("edges"))


@query("density_clusters")
def _(spark, sf):
    return rounded(density.density_clusters(fx.table(spark, sf, "embeddings"), min_size=10), 6)


@query("indexed_topk", f"with {SCORES} select question_id, review_id, score, {RANK} as rank from sc qualify rank <= 8")
def _(spark, sf):
    path = scratch_path(spark, "vector-table")
    corpus = _corpus(spark, sf)
    later = F.col("review_id").cast("bigint") % 366 >= 183     # the second half of the days is added afterwards
    store.build_index(corpus.where(~later), path)
    store.add_rows(corpus.where(later), path)
    return store.search(spark, path, _label_questions(spark, sf), 8)


# ---------------------------------------------------------------- text questions

def _questions(spark, sf):
    """Each benchmark text is asked about one of the products."""
    asin = F.concat(F.lit("B"), F.lpad((F.col("item_id") % 20).cast("string"), 9, "0"))
    return fx.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"), asin.alias("asin"),
        asin.alias("parent_asin"))


def _texts(spark, sf):
    return fx.reviews(spark, sf).select("review_id", "parent_asin", "text", "date")


ASIN = "'B' || lpad(cast(item_id % 20 as varchar), 9, '0')"
SCRUBBED = ("regexp_replace(regexp_replace(text, '[\\w\\.-]+@[\\w\\.-]+', '[REDACTED_EMAIL]', 'g'), "
            "'\\+?\\d[\\d\\-\\s]{6,}\\d', '[REDACTED_PHONE]', 'g')")
SEARCH = (
    B.REVIEWS_MORE + f"safe as (select review_id, parent_asin, date, {SCRUBBED} as text from reviews), "
    "tk as (select review_id, parent_asin as p, " + TOKENS.format("text") + " as w from safe), "
    "tf as (select review_id, p, term, count(*) as tf from (select review_id, p, unnest(w) as term from tk) group by all), "
    "vo as (select term, ln((1 + (select count(*) from reviews)) / (1 + count(*))) + 1 as idf from tf group by 1), "
    "wt as (select review_id, p, term, tf * idf as w from tf join vo using (term)), "
    f"qk as (select item_id as question_id, {ASIN} as p, " + TOKENS.format("text") + " as w from benchmark), "
    "qf as (select question_id, p, term, count(*) as tf from (select question_id, p, unnest(w) as term from qk) group by all), "
    "qw as (select question_id, p, term, tf * idf as qw from qf join vo using (term)), "
    "nr as (select review_id, sqrt(sum(w * w)) as nrm from wt group by 1), "
    "nq as (select question_id, sqrt(sum(qw * qw)) as qnrm from qw group by 1), "
    "ps as (select question_id, review_id, round(any_value(d) / (any_value(nrm) * any_value(qnrm)), 9) as score from "
    "(select question_id, review_id, sum(qw * w) as d from wt join qw using (p, term) group by 1, 2) join nr using "
    "(review_id) join nq using (question_id) group by 1, 2), "
    f"found as materialized (select *, {RANK} as rank from ps qualify rank <= 20), "
    "snip as materialized (select question_id, review_id, score, rank, substring(text, 1, 1000) as text, "
    "date from found join safe using (review_id) where trim(substring(text, 1, 1000)) <> '') "
)
RERANK = (
    SEARCH + ", rd as (select question_id, review_id, text from snip union all select item_id, null, text "
    "from benchmark), rk as (select question_id, review_id, " + TOKENS.format("text") + " as w from rd), "
    "rg as (select question_id, review_id, unnest(w) as term from rk), rf as (select question_id, "
    "review_id, term, count(*) as tf from rg group by 1, 2, 3), rs as (select question_id, count(*) as n "
    "from rd group by 1), rw as (select question_id, review_id, term, tf * (ln((1 + n) / (1 + count(*) "
    "over (partition by question_id, term))) + 1) as w from rf join rs using (question_id)), "
    "rq as (select question_id, term, w as qw from rw where review_id is null), "
    "dt as (select question_id, review_id, sum(w * coalesce(qw, 0)) as dot, sqrt(sum(w * w)) as nrm from "
    "rw left join rq using (question_id, term) group by 1, 2), "
    "rr as (select d.question_id, d.review_id, round(d.dot / (d.nrm * q.nrm), 9) as rerank_score from dt d "
    "join dt q on q.question_id = d.question_id and q.review_id is null where d.review_id is not null), "
    "best0 as (select snip.* exclude (rank), coalesce(rerank_score, 0) as rerank_score, "
    "cast(row_number() over (partition by question_id order by coalesce(rerank_score, 0) desc, score "
    "desc, review_id) as integer) as nr from snip left join rr using (question_id, review_id)), "
    "best as materialized (select * exclude (nr), nr as rank from best0 where nr <= 8) "
)


@query("product_corpus", B.REVIEWS_MORE + f"safe as (select review_id, parent_asin, date, {SCRUBBED} as text from reviews) select "
       "review_id, text, date from safe where parent_asin = 'B000000003'")
def _(spark, sf):
    return ret.product_corpus(_texts(spark, sf), "B000000003").select("review_id", "text", "date")


@query("question_topk_text")
def _(spark, sf):
    """Text questions against an index of text vectors, with one fitted encoder for both."""
    path = scratch_path(spark, "text-index")
    texts = _texts(spark, sf).withColumn("text", F.coalesce("text", F.lit("")))
    model = embedder.fit(texts.withColumn("text", C.scrub_pii("text")), dims=64)
    model.save(spark, f"{path}/model")
    store.build_index(texts, path, encode=model.transform)
    asked = embedder.Embedder.load(spark, f"{path}/model").transform(_questions(spark, sf), "question_id", "question")
    return rounded(store.search(spark, path, asked, 8), 6)


def _snips(spark, sf):
    t = _texts(spark, sf)
    return materialize(ret.snippets(ret.tfidf_search(_questions(spark, sf), t, 20), t), "found")


def _best(spark, sf):
    return ret.tfidf_rerank(_snips(spark, sf), _questions(spark, sf), 8)


@query("tfidf_search", SEARCH + "select question_id, review_id, score, rank from found")
def _(spark, sf):
    return ret.tfidf_search(_questions(spark, sf), _texts(spark, sf), 20)


@query("text_index_search", SEARCH + "select question_id, review_id, score, rank from found")
def _(spark, sf):
    path = scratch_path(spark, "text-postings")
    textindex.build_text_index(_texts(spark, sf), path)
    return textindex.search_text_index(spark, path, _questions(spark, sf), 20)


@query("tfidf_rerank", RERANK + "select question_id, review_id, rank, round(rerank_score, 6) as "
                                "rerank_score from best")
def _(spark, sf):
    return rounded(_best(spark, sf).select("question_id", "review_id", "rank", "rerank_score"), 6)


def overlap(question: pd.Series, text: pd.Series) -> pd.Series:
    """Simplest pair scorer: share of the question's words that the text has."""
    def one(q, t):
        a, b = set(q.lower().split()), set(t.lower().split())
        return len(a & b) / len(a) if a else 0.0

    return pd.Series([one(q, t) for q, t in zip(question, text)])


@query("rerank_topk", SEARCH + ", qs as (select item_id as question_id, list_distinct(list_filter("
       "regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) as qw from benchmark), rs as "
       "(select snip.*, len(list_filter(qw, lambda w: list_contains(regexp_split_to_array(lower(text), "
       "'\\s+'), w))) / len(qw) as s from snip join qs using (question_id)) select question_id, "
       "review_id, round(s, 6) as rerank_score, cast(row_number() over (partition by question_id order "
       "by s desc, score desc, review_id) as integer) as rank from (select * exclude (rank) from rs) "
       "qualify rank <= 8")
def _(spark, sf):
    out = ret.rerank_topk(_snips(spark, sf), _questions(spark, sf), overlap, 8)
    return rounded(out.select("question_id", "review_id", "rerank_score", "rank"), 6)


@query("rerank_keep_order", SEARCH + "select question_id, review_id, rank from snip where rank <= 8")
def _(spark, sf):
    return ret.rerank_topk(_snips(spark, sf), _questions(spark, sf), None, 8).select(
        "question_id", "review_id", "rank")


def entry_sql(index, chars):
    return (f"'[' || cast({index} as varchar) || '] review_id=' || review_id || ' date=' || "
            f"coalesce(cast(date as varchar), 'None') || ': ' || case when length(text) > {chars} then "
            f"substring(text, 1, {chars}) || '...' else text end")


@query("prompt_context", RERANK + "select question_id, count(*) as snippets, string_agg(" +
       entry_sql("rank - 1", 300) + ", chr(10) order by rank) as context from best where rank <= 6 "
       "group by 1")
def _(spark, sf):
    return ans.prompt_context(_best(spark, sf))


STEPS = ", ".join(f"({i}, {c}, {n})" for i, (c, n) in enumerate(ans.PACK_STEPS))


def pack_sql(allowed):
    return (
        f", steps(step, chars, n) as (values {STEPS}), en as (select question_id, step, chars, n, rank, "
        + entry_sql("rank - 1", 1).replace("length(text) > 1 then substring(text, 1, 1)",
                                           "length(text) > chars then substring(text, 1, chars)") +
        " as line from best, steps where rank <= n), pr as (select question_id, step, chars, n, "
        f"{B.lit(ans.INSTRUCTION).replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))} || "
        "'QUESTION: ' || max(b.text) || chr(10) || chr(10) || 'SNIPPETS:' || chr(10) || string_agg(line, "
        "chr(10) order by rank) as prompt from en join benchmark b on item_id = question_id group by 1, "
        "2, 3, 4), pack as (select question_id, chars as snippet_chars, n as max_snippets, prompt, "
        f"length(prompt) <= {allowed * 4} as fits from pr where length(prompt) <= {allowed * 4} or step = "
        f"{len(ans.PACK_STEPS) - 1} qualify row_number() over (partition by question_id order by step) "
        "= 1) ")


@query("prompt_pack", RERANK + pack_sql(230) + "select * from pack")
def _(spark, sf):
    return ans.prompt_pack(_best(spark, sf), _questions(spark, sf), 230)


EXTRACTIVE = (
    ", xt as (select question_id, count(*) as n, string_agg(substring(text, 1, 300), chr(10) || '---' || "
    "chr(10) order by rank) as t from best where rank <= 3 group by 1), ext as (select item_id as "
    f"question_id, case when n is null then '{ans.NO_CONTEXT}' else '[Extractive Summary] Top ' || n || "
    "' relevant review excerpts:' || chr(10) || chr(10) || t end as answer, case when n is null then "
    "'no_context' else 'extractive_fallback' end as method from benchmark left join xt on question_id = "
    "item_id) ")


@query("extractive_answer", RERANK + EXTRACTIVE + "select * from ext")
def _(spark, sf):
    return ans.extractive_answer(_questions(spark, sf), _best(spark, sf))


# ---------------------------------------------------------------- answers

def _conversation_answers(spark, sf):
    """Every assistant turn in one of four answer forms, and the user turns of its
    conversation as its snippets."""
    conv = fx.table(spark, sf, "conversations")
    every = conv.where("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), "conv_id", "text")
    safe = F.regexp_replace("text", "[^a-zA-Z ]", "")
    js = F.concat(F.lit('{"summary": "'), safe, F.lit(
        '", "pros": ["soft"], "cons": [], "evidence": [{"index": 0, "excerpt": "x"}]}'))
    form = F.col("question_id") % 4
    answer = F.when(form == 0, js).when(form == 1, F.concat(F.lit("Sure: "), js, F.lit(" done"))).when(
        form == 2, F.concat(F.lit("Answer: "), F.col("text"),
                            F.lit(" [0] [1] [1] [9]\nEvidence: [0] quoted"))).otherwise("see [1]")
    order = Window.partitionBy("conv_id").orderBy("turn")
    users = conv.where("role = 'user'").select(
        "conv_id", F.row_number().over(order).alias("rank"), F.col("turn").cast("string").alias("review_id"), "text",
        F.lit("2024-01-01").cast("date").alias("date"), (1 / (1 + F.col("turn"))).alias("score"))
    return (every.select("question_id", answer.alias("answer")),
            every.select("question_id", "conv_id").join(users, "conv_id").drop("conv_id"))


ANSWERS = (
    "with la as (select conv_id * 100 + turn as question_id, conv_id, text from conversations where role = 'assistant'), "
    "js as (select *, '{\"summary\": \"' || regexp_replace(text, '[^a-zA-Z ]', '', 'g') || "
    "'\", \"pros\": [\"soft\"], \"cons\": [], \"evidence\": [{\"index\": 0, \"excerpt\": \"x\"}]}' as j "
    "from la), an as (select question_id, case question_id % 4 when 0 then j when 1 then 'Sure: ' "
    "|| j || ' done' when 2 then 'Answer: ' || text || ' [0] [1] [1] [9]' || chr(10) || "
    "'Evidence: [0] quoted' else 'see [1]' end as answer from js), ut as (select conv_id, "
    "cast(row_number() over (partition by conv_id order by turn) as integer) as rank, cast(turn as "
    "varchar) as review_id, text, date '2024-01-01' as date, 1 / (1 + turn) as score from conversations "
    "where role = 'user'), us as (select question_id, ut.* exclude (conv_id) from la join ut using (conv_id)) ")
CITED = (", ci as (select distinct question_id, cast(unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1)) "
         "as integer) as index from an), cs as (select ci.question_id, index, " +
         entry_sql("rank - 1", 300) + " as snippet from ci join us on us.question_id = ci.question_id and "
         "rank - 1 = index) ")


@query("parse_answer_json", ANSWERS + "select question_id, regexp_replace(json_extract_string("
       "regexp_extract(answer, '(?s)\\{.*\\}'), '$.summary'), '^$', '') as summary, "
       "json_extract_string(regexp_extract(answer, '(?s)\\{.*\\}'), '$.pros[0]') as pro, "
       "cast(json_extract_string(regexp_extract(answer, '(?s)\\{.*\\}'), '$.evidence[0].index') as "
       "integer) as first_index from an where question_id % 4 < 2 union all select question_id, null, "
       "null, null from an where question_id % 4 >= 2")
def _(spark, sf):
    a, _ = _conversation_answers(spark, sf)
    s = F.col("structured")
    return ans.parse_answer_json(a).select(
        "question_id", s["summary"].alias("summary"), F.get(s["pros"], 0).alias("pro"),
        F.get(s["evidence"], 0)["index"].alias("first_index"))


@query("extract_citations", ANSWERS + CITED + "select * from cs")
def _(spark, sf):
    return ans.extract_citations(*_conversation_answers(spark, sf))


@query("parse_answer_evidence", ANSWERS + CITED + ", pa as (select question_id, regexp_extract(answer, "
       "'(?is)Answer:\\s*(.*?)\\s*Evidence:\\s*(.*)$', 1) as body from an where question_id % 4 = 2), "
       "ev as (select question_id, string_agg(index || '=' || trim(regexp_extract(snippet, "
       "'(?s)^[^:]*:(.*)$', 1)), '|' order by index) as evidence from cs group by 1) select question_id, "
       "trim(split_part(trim(body), chr(10), 1)) as summary, coalesce(evidence, '') as evidence from pa "
       "left join ev using (question_id)")
def _(spark, sf):
    out = ans.parse_answer_evidence(*_conversation_answers(spark, sf))
    return out.withColumn("evidence", F.array_join(F.transform(
        "evidence", lambda e: F.concat(e["index"].cast("string"), F.lit("="), e["excerpt"])), "|"))


@query("guard_answer", ANSWERS + ", fb as (select question_id, count(*) as n, string_agg(text, chr(10) || "
       "'---' || chr(10) order by rank) as t from us where rank <= 3 group by 1) select question_id, case "
       "when length(trim(answer)) < 40 and n is not null then '[Fallback summary] Top ' || n || ' complaint "
       "excerpts:' || chr(10) || t else answer end as answer, length(trim(answer)) < 40 as fallback from "
       "an left join fb using (question_id)")
def _(spark, sf):
    return ans.guard_answer(*_conversation_answers(spark, sf))


@query("snippets_json", ANSWERS + "select question_id, count(*) as n, string_agg(review_id || '|' || text || '|' || "
       "strftime(date, '%Y-%m-%d') || '|' || cast(round(score * 1000) as integer), ';' order by "
       "rank) as items from us group by 1")
def _(spark, sf):
    _, s = _conversation_answers(spark, sf)
    back = F.from_json("snippets_json", "array<struct<review_id:string,text:string,date:string,score:double>>")
    return ans.snippets_json(s).select(
        "question_id", F.size(back).cast("bigint").alias("n"),
        F.array_join(F.transform(back, lambda s: F.concat_ws("|", s["review_id"], s["text"], s["date"], F.round(
            s["score"] * 1000).cast("int").cast("string"))), ";").alias("items"))


EPOCH, DAY = 1_700_000_000, 86_400


def _cache(spark, sf):
    return fx.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("asin"),
        F.lower(F.trim("text")).alias("question"),
        F.concat("role", F.lit("-"), F.col("turn").cast("string")).alias("answer"),
        (F.col("conv_id") % 14 * DAY + EPOCH).alias("created_at"))


@query("answer_cache_lookup", "with ca as (select conv_id, lower(trim(text)) as q, role || '-' || turn as "
       f"answer, conv_id % 14 * {DAY} + {EPOCH} as created_at from conversations), qs as (select conv_id * "
       "100 + turn as question_id, conv_id, lower(trim('  ' || text || ' ')) as q from conversations where "
       "role <> 'assistant'), nw as (select conv_id, q, max({'c': created_at, 'a': answer}) as x from ca "
       "group by 1, 2) select question_id, 'c' || qs.conv_id as asin, case when "
       f"{EPOCH + 14 * DAY} - x.c <= {7 * DAY} then x.a end as answer, case when {EPOCH + 14 * DAY} - x.c "
       f"<= {7 * DAY} then x.c end as created_at, case when {EPOCH + 14 * DAY} - x.c <= {7 * DAY} then "
       "'hit' else 'miss' end as event_type from qs left join nw on nw.conv_id = qs.conv_id and nw.q = "
       "qs.q")
def _(spark, sf):
    asked = fx.table(spark, sf, "conversations").where("role <> 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("asin"),
        F.concat(F.lit("  "), F.col("text"), F.lit(" ")).alias("question"))
    return ans.answer_cache_lookup(asked, _cache(spark, sf), EPOCH + 14 * DAY)


@query("cache_metrics", "select count(*) filter (where event_type = 'click') as hit_count, count(*) filter "
       "(where event_type = 'error') as miss_count, cast(max(epoch_us(ts)) filter (where event_type in "
       "('click', 'error')) // 1000000 as bigint) as last_event_ts, (select count(*) from conversations) "
       f"as entry_count, (select max(conv_id % 14 * {DAY} + {EPOCH}) from conversations) as last_updated "
       "from events")
def _(spark, sf):
    kind = F.col("event_type")
    ev = fx.table(spark, sf, "events").select(
        F.when(kind == "click", "hit").when(kind == "error", "miss").otherwise(kind).alias("event_type"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"))
    return ans.cache_metrics(ev, _cache(spark, sf))


QA_SQL = (
    RERANK + pack_sql(230) + EXTRACTIVE + ", hit as (select item_id as question_id from "
    "benchmark where item_id % 7 = 3), ids as (select question_id, string_agg(review_id, ',' order by rank) as "
    "review_ids, count(*) as n from best group by 1) select item_id as question_id, case when "
    "hit.question_id is not null then 'cached' else ext.answer end as answer, case when "
    "hit.question_id is not null then 'cached' else ext.method end as method, case when "
    "hit.question_id is null then max_snippets end as max_snippets, case when hit.question_id is null "
    "then snippet_chars end as snippet_chars, case when hit.question_id is null then review_ids end as review_ids, "
    "case when hit.question_id is null then n end as n_sources "
    "from benchmark left join hit on hit.question_id = item_id "
    "left join ext on ext.question_id = item_id left join pack on pack.question_id = item_id "
    "left join ids on ids.question_id = item_id")


def _answered(spark, sf, index=None):
    q = _questions(spark, sf).drop("parent_asin")
    # a seventh of the questions has been answered before, for the same product
    cache = q.where("question_id % 7 = 3").select(
        "asin", "question", F.lit("cached").alias("answer"), F.lit(EPOCH).cast("bigint").alias("created_at"))
    out = ans.qa_batch(q, _texts(spark, sf), cache, EPOCH + DAY, allowed_tokens=230, index=index)
    items = F.from_json("sources", "array<struct<review_id:string>>")
    return out.withColumn("n_sources", F.size(items).cast("bigint")).withColumn(
        "n_sources", F.when(F.col("sources").isNotNull(), F.col("n_sources"))).drop("sources")


@query("qa_batch", QA_SQL)
def _(spark, sf):
    return _answered(spark, sf)


@query("qa_batch_indexed", QA_SQL)
def _(spark, sf):
    path = scratch_path(spark, "text-postings")
    textindex.build_text_index(_texts(spark, sf), path)
    return _answered(spark, sf, path)
