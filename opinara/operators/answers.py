"""Prompts, answers, citations and the answer cache, for a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schemas import STRUCTURED_ANSWER
from ..session import materialize

# Texts of the extractive answers.
NO_CONTEXT = "No relevant reviews found for this product."
EXTRACT_HEAD = "[Extractive Summary] Top %d relevant review excerpts:\n\n"
FALLBACK_HEAD = "[Fallback summary] Top %d complaint excerpts:\n"
INSTRUCTION = ("Summarise the main points of the following product reviews and cite them as [n]. "
               "If they do not say enough, reply 'Insufficient evidence.'\n\n")
SEPARATOR = "\n---\n"

# The shrinking steps (characters per snippet, snippets), first fit wins.
PACK_STEPS = [(300, 6), (150, 6), (80, 6), (80, 5), (80, 4), (80, 3), (80, 2)]


def entry(index: Column, chars: int) -> Column:
    """One numbered context line."""
    return F.concat(F.lit("["), index.cast("string"), F.lit("] review_id="), F.col("review_id"),
                    F.lit(" date="), F.coalesce(F.col("date").cast("string"), F.lit("None")),
                    F.lit(": "), C.cut("text", chars))


def _joined(value: Column, sep: str, cond: Column | None = None) -> Column:
    item = F.struct("rank", value.alias("x"))
    item = item if cond is None else F.when(cond, item)
    return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]), sep)


def prompt_context(snips: DataFrame, n: int = 6, chars: int = 300) -> DataFrame:
    """The first ``n`` snippets of every question as numbered lines."""
    top = snips.where(F.col("rank") <= n)
    return top.groupBy("question_id").agg(
        F.count("*").alias("snippets"), _joined(entry(F.col("rank") - 1, chars), "\n").alias("context"))


def prompt_pack(snips: DataFrame, questions: DataFrame, allowed_tokens: int = 128,
                instruction: str = INSTRUCTION) -> DataFrame:
    """The prompt with the first shrinking step whose length fits four characters a token.

    All steps are measured in one aggregate; only the chosen one is assembled.
    """
    head = F.length(F.lit(instruction)) + F.length(F.concat(
        F.lit("QUESTION: "), F.col("question"), F.lit("\n\nSNIPPETS:\n")))
    top = snips.where(F.col("rank") <= 6)
    sums = [
        F.sum(F.when(F.col("rank") <= n, F.length(entry(F.col("rank") - 1, chars)) + 1)).alias(f"_{i}")
        for i, (chars, n) in enumerate(PACK_STEPS)
    ]
    lines = top.groupBy("question_id").agg(
        *sums, *[_joined(entry(F.col("rank") - 1, chars), "\n", F.col("rank") <= n).alias(f"_t{i}")
                 for i, (chars, n) in enumerate(PACK_STEPS)])
    q = questions.select("question_id", "question").join(lines, "question_id")
    chosen, last = None, len(PACK_STEPS) - 1
    for i in range(last):
        fits = head + F.col(f"_{i}") - 1 <= allowed_tokens * 4
        chosen = F.when(fits, i) if chosen is None else chosen.when(fits, i)
    q = q.withColumn("_step", chosen.otherwise(last))
    texts = F.array(*[F.col(f"_t{i}") for i in range(last + 1)])
    chars = F.array(*[F.lit(c) for c, _ in PACK_STEPS])
    count = F.array(*[F.lit(n) for _, n in PACK_STEPS])
    prompt = F.concat(F.lit(instruction), F.lit("QUESTION: "), F.col("question"),
                      F.lit("\n\nSNIPPETS:\n"), F.get(texts, F.col("_step")))
    return q.select("question_id", F.get(chars, F.col("_step")).alias("snippet_chars"),
                    F.get(count, F.col("_step")).alias("max_snippets"), prompt.alias("prompt"),
                    (F.length(prompt) <= allowed_tokens * 4).alias("fits"))


def extractive_answer(questions: DataFrame, snips: DataFrame, top: int = 3, chars: int = 300) -> DataFrame:
    """Answer from the best excerpts; a question without snippets says so."""
    best = snips.where(F.col("rank") <= top)
    text = best.groupBy("question_id").agg(
        F.count("*").cast("int").alias("_n"),
        _joined(F.substring("text", 1, chars), SEPARATOR).alias("_text"))
    return questions.select("question_id").join(text, "question_id", "left").select(
        "question_id",
        F.when(F.col("_n").isNull(), NO_CONTEXT)
        .otherwise(F.concat(F.format_string(EXTRACT_HEAD, "_n"), F.col("_text"))).alias("answer"),
        F.when(F.col("_n").isNull(), "no_context").otherwise("extractive_fallback").alias("method"))


def guard_answer(answers: DataFrame, snips: DataFrame, min_chars: int = 40) -> DataFrame:
    """Replace an answer that is too short or only repeats the first snippet."""
    best = snips.where(F.col("rank") <= 3)
    text = best.groupBy("question_id").agg(
        F.count("*").cast("int").alias("_n"), _joined(F.col("text"), SEPARATOR).alias("_text"),
        F.max(F.when(F.col("rank") == 1, entry(F.lit(0), 300))).alias("_first"))
    a = F.trim("answer")
    bad = (F.length(a) < min_chars) | (a == F.trim("_first"))
    return answers.join(text, "question_id", "left").select(
        "question_id",
        F.when(bad & F.col("_n").isNotNull(),
               F.concat(F.format_string(FALLBACK_HEAD, "_n"), F.col("_text")))
        .otherwise(F.col("answer")).alias("answer"),
        F.coalesce(bad, F.lit(False)).alias("fallback"))


# ---------------------------------------------------------------- parsing

def parse_answer_json(answers: DataFrame) -> DataFrame:
    """The JSON object of an answer: the whole text, else from the first to the last brace."""
    def valid(text):
        return F.when(F.trim(text).startswith("{") & F.try_parse_json(text).isNotNull(), text)

    inner = F.regexp_extract("answer", r"(?s)\{.*\}", 0)
    body = F.coalesce(valid(F.col("answer")), valid(inner))
    return answers.withColumn("structured", F.when(
        body.isNotNull(), F.from_json(body, STRUCTURED_ANSWER)))


def citations(answers: DataFrame) -> DataFrame:
    """Distinct cited numbers ``(question_id, index)``."""
    nums = F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), 1)
    return answers.select("question_id", F.explode(F.array_distinct(
        F.transform(nums, lambda x: x.try_cast("int")))).alias("index")).where("index is not null")


def extract_citations(answers: DataFrame, snips: DataFrame) -> DataFrame:
    """Cited snippets as numbered lines; numbers out of range drop out."""
    lines = snips.select("question_id", (F.col("rank") - 1).alias("index"),
                         entry(F.col("rank") - 1, 300).alias("snippet"))
    return citations(answers).join(lines, ["question_id", "index"])


def parse_answer_evidence(answers: DataFrame, snips: DataFrame) -> DataFrame:
    """Summary and cited excerpts of an "Answer: ... Evidence: ..." text.

    Answers without the label drop out.
    """
    both = r"(?is)Answer:\s*(.*?)\s*Evidence:\s*(.*)$"
    body = F.when(F.col("answer").rlike(both), F.regexp_extract("answer", both, 1)).when(
        F.col("answer").contains("Answer:"), F.regexp_extract("answer", r"(?s)Answer:\s*(.*)$", 1))
    heads = answers.select("question_id", F.trim(F.get(F.split(F.trim(body), "\n"), F.lit(0)))
                           .alias("summary")).where("summary is not null")
    excerpt = F.trim(F.regexp_extract("snippet", r"(?s)^[^:]*:(.*)$", 1))
    cited = extract_citations(answers, snips).groupBy("question_id").agg(
        F.array_sort(F.collect_list(F.struct("index", excerpt.alias("excerpt")))).alias("evidence"))
    return heads.join(cited, "question_id", "left").select(
        "question_id", "summary",
        F.coalesce("evidence", F.array().cast("array<struct<index:int,excerpt:string>>"))
        .alias("evidence"))


def snippets_json(snips: DataFrame) -> DataFrame:
    """A question's snippets as JSON text, dates in ISO form."""
    item = F.struct("review_id", "text", F.date_format("date", "yyyy-MM-dd").alias("date"), "score")
    return snips.groupBy("question_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("s")))),
                              lambda x: x["s"])).alias("snippets_json"))


# ---------------------------------------------------------------- cache

def answer_cache_lookup(questions: DataFrame, cache: DataFrame, now: int,
                        ttl_seconds: int = 7 * 24 * 3600) -> DataFrame:
    """Newest cached answer per question, if it is young enough, with hit or miss."""
    norm = C.normalize_question("question")
    newest = cache.groupBy("asin", norm.alias("_q")).agg(
        F.max(F.struct("created_at", "answer")).alias("_c"))
    q = questions.withColumn("_q", norm)
    fresh = F.lit(now) - F.col("_c.created_at") <= ttl_seconds
    return q.join(newest, ["asin", "_q"], "left").select(
        "question_id", "asin",
        F.when(fresh, F.col("_c.answer")).alias("answer"),
        F.when(fresh, F.col("_c.created_at")).alias("created_at"),
        F.when(fresh, "hit").otherwise("miss").alias("event_type"))


def cache_metrics(events: DataFrame, cache: DataFrame) -> DataFrame:
    """Hits, misses, last event, entries and last update in one row."""
    kind = F.col("event_type")
    e = events.where(kind.isin("hit", "miss")).agg(
        C.count_if(kind == "hit").alias("hit_count"), C.count_if(kind == "miss").alias("miss_count"),
        F.max("ts").alias("last_event_ts"))
    c = cache.agg(F.count("*").alias("entry_count"), F.max("created_at").alias("last_updated"))
    return e.select(*[F.coalesce(x, F.lit(0)).alias(x) for x in ("hit_count", "miss_count")],
                    "last_event_ts",
                    c.select("entry_count").scalar().alias("entry_count"),
                    c.select("last_updated").scalar().alias("last_updated"))


def qa_batch(questions: DataFrame, texts: DataFrame, cache: DataFrame, now: int, search_k: int = 20,
             k: int = 8, allowed_tokens: int = 512, index: str | None = None) -> DataFrame:
    """Answer a table of questions: cache, search, rerank, pack, answer.

    ``questions`` has ``question_id, asin, question``; ``texts`` has ``review_id, parent_asin, text, date``.  A cached
    answer wins; the other questions get an extractive answer from the reranked, scrubbed snippets of their own
    product.  ``sources`` lists the snippets behind an answer as JSON, ``review_ids`` their keys by rank.  With the path of an
    `index` (`textindex.build_text_index`) the search reads its postings instead of counting the corpus again.
    """
    from .retrieval import snippets, tfidf_rerank, tfidf_search
    from .textindex import search_text_index

    looked = materialize(answer_cache_lookup(questions, cache, now), "looked")
    asked = questions.join(looked.where("event_type = 'miss'"), "question_id", "left_semi").withColumn(
        "parent_asin", F.col("asin"))
    hits = search_text_index(texts.sparkSession, index, asked, search_k) if index else tfidf_search(asked, texts, search_k)
    found = snippets(hits, texts)
    best = materialize(tfidf_rerank(materialize(found, "found"), asked, k), "best")
    keys = best.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", "review_id"))), lambda x: x["review_id"]), ",").alias("review_ids"))
    made = extractive_answer(asked, best).join(
        prompt_pack(best, asked, allowed_tokens).select("question_id", "max_snippets", "snippet_chars"),
        "question_id", "left").join(keys, "question_id", "left").join(
        snippets_json(best).withColumnRenamed("snippets_json", "sources"), "question_id", "left")
    return looked.select("question_id", "event_type", F.col("answer").alias("_cached")).join(
        made, "question_id", "left").select(
        "question_id", F.coalesce("_cached", "answer").alias("answer"),
        F.when(F.col("event_type") == "hit", "cached").otherwise(F.col("method")).alias("method"),
        "max_snippets", "snippet_chars", "review_ids", "sources")


def cache_rows(questions: DataFrame, answered: DataFrame, now: int) -> DataFrame:
    """New answers as rows of the cache: asin, question, answer, created_at; cached ones are not written again."""
    fresh = answered.where("method <> 'cached'").select("question_id", "answer")
    return questions.join(fresh, "question_id").select(
        "asin", C.normalize_question("question").alias("question"), "answer", F.lit(now).cast("bigint").alias("created_at"))
