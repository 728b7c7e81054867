"""A persisted text index: postings in blocks that know their largest weight, so that search skips blocks exactly.

Texts of a product are dealt into blocks of about `BLOCK` by hash. For each (product, word, block) one row holds the
postings, weights already divided by the text's norm, and the largest of them. A search adds up the largest weights of a question's words
block by block: no text of a block scores more. The best block or two of each question are scored first, which gives
its k-th score so far; then only blocks whose bound reaches it are read in full. Postings are written once; a search reads the
rows of the asked products and words and moves no text.

Weights are those of `retrieval.tfidf_search`, with document frequencies over the whole corpus, and so are the results.
Defined results: texts without product or words answer nothing; a question without known words finds nothing; rows without an id
are not indexed; an index is built anew when the corpus changes, since frequencies change with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import materialize
from .retrieval import _rank

BLOCK = 128         # texts of a product in one block, about
FIRST = 2           # blocks of a question that are scored first
TEXTS = 20_000      # texts, about, for which a product's words go to one more task
FOLDERS = 64        # folders of the table, by hash of the product
SLACK = 1e-9        # scores are rounded to nine digits


def _folder(product: str):
    return F.pmod(F.xxhash64(product), F.lit(FOLDERS)).cast("int")


def build_text_index(texts: DataFrame, path: str, product: str = "parent_asin") -> None:
    """Write document frequencies and blocked postings of all texts."""
    rows = texts.where(F.col("review_id").isNotNull())
    # a text moves once, as its words, to where they are counted
    words = rows.select("review_id", F.col(product).alias("p"), C.topic_tokens(C.scrub_pii("text")).alias("words")).repartition("review_id")
    counts = words.select("review_id", "p", F.explode("words").alias("term")).groupBy("review_id", "p", "term").agg(F.count("*").alias("tf"))
    counts = materialize(counts, "postings")
    n = texts.count()
    idf = counts.groupBy("term").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf"))
    idf.write.parquet(f"{path}/words")
    idf = texts.sparkSession.read.parquet(f"{path}/words")
    # only texts of a product can be found
    weighted = counts.where("p is not null").join(idf, "term").select("review_id", "p", "term", (F.col("tf") * F.col("idf")).alias("w"))
    weighted = materialize(weighted, "weights")
    norms = weighted.groupBy("review_id", "p").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    sizes = norms.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("bigint").alias("blocks"))
    # a text's block goes with its norm; postings then move once, and a product's words to several tasks
    placed = norms.join(sizes, "p").select("review_id", "p", "norm", F.pmod(F.xxhash64("review_id"), F.col("blocks")).alias("block"))
    part = F.pmod(F.xxhash64("term"), F.lit(-(-n // TEXTS) or 1)).cast("int")
    postings = weighted.join(placed, ["review_id", "p"]).select(
        "p", "term", "block", "review_id", (F.col("w") / F.col("norm")).alias("w"), _folder("p").alias("folder"), part.alias("_part"))
    (postings.repartition("folder", "p", "_part").groupBy("folder", "p", "_part", "term", "block").agg(
        F.max("w").alias("most"), F.collect_list(F.struct("review_id", "w")).alias("postings"))
     .select("p", "term", "block", "most", "postings", "folder").sortWithinPartitions("folder", "p", "term", "block")
     .write.partitionBy("folder").parquet(f"{path}/postings"))


def _scores(postings: DataFrame, k: int) -> DataFrame:
    """Best `k` texts of each question from the rows of its words."""
    each = postings.select("question_id", "qw", "qnorm", F.explode("postings").alias("x"))
    dots = each.groupBy("question_id", F.col("x.review_id").alias("review_id")).agg(
        F.round(F.sum(F.col("qw") * F.col("x.w")) / F.max("qnorm"), 9).alias("score"))
    return _rank(dots, k)


def search_text_index(spark: SparkSession, path: str, questions: DataFrame, k: int = 20, product: str = "parent_asin") -> DataFrame:
    """Top-k ``(question_id, review_id, score, rank)`` of the question's product, as `retrieval.tfidf_search` gives it."""
    idf = spark.read.parquet(f"{path}/words")
    asked = questions.select("question_id", F.col(product).alias("p"), F.explode(C.topic_tokens("question")).alias("term")).groupBy(
        "question_id", "p", "term").agg(F.count("*").alias("tf"))
    words = asked.join(idf, "term").withColumn("qw", F.col("tf") * F.col("idf"))
    norms = words.groupBy("question_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    words = materialize(words.join(norms, "question_id").where("p is not null").select(
        "question_id", "p", "term", "qw", "qnorm", _folder("p").alias("folder")), "asked")
    folders = [r[0] for r in words.select("folder").distinct().collect()]     # FOLDERS at most
    table = spark.read.parquet(f"{path}/postings").where(F.col("folder").isin(folders))
    key = ["folder", "p", "term"]
    # bounds need no posting: the scan leaves that column out
    bounds = materialize(table.select(*key, "block", "most").join(words, key).groupBy("question_id", "block").agg(
        (F.sum(F.col("qw") * F.col("most")) / F.max("qnorm")).alias("bound")), "bounds")
    best = Window.partitionBy("question_id").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= FIRST).select("question_id", "block")
    some = _scores(table.join(words, key).join(first, ["question_id", "block"]), k)
    floor = some.where(F.col("rank") == k).select("question_id", F.col("score").alias("floor"))
    reach = bounds.join(floor, "question_id", "left").where(
        F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK)).select("question_id", "block")
    return _scores(table.join(words, key).join(materialize(reach, "reach"), ["question_id", "block"]), k)
