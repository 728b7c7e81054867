"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, scratch_path
from . import (bpestream, chat, decontam, exactdedup, langid, licenses, ngramjoin, packing, periodic, sharding, tokenids,
               toxicity, turnrepair)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the queries; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


@_query("op1_chat_format")
def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


@_query("op2_license_scan", licenses.sql())
def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query("op3_packing")
def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary(), end_id=1)


@_query("op4_token_ids")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    tokenids.write(_table(spark, sf_dir, "documents"), path, vocabulary(), end_id=0)
    return tokenids.read(spark, path)


@_query("op5_sharding", sharding.sql())
def shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


@_query("op6_decontamination", decontam.sql())
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op7_ngram_join", ngramjoin.sql())
def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op8_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.bucket("doc_id", 5) != 0))
    return langid.identify(docs, model).select(
        "doc_id", (langid.bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score",
        "cross_entropy", "rejected")


@_query("op9_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(langid.bucket("doc_id", 3) != 1))
    return toxicity.score(docs, model).select(
        "doc_id", (langid.bucket("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits", "n_quoted")


@_query("op10_exact_dedup", exactdedup.sql())
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.group_copies(_table(spark, sf_dir, "documents"))


@_query("op11_bpe_stream")
def bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpestream.digests(bpestream.encode_documents(
        _table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), decoded=True))


@_query("op12_periodic_runs")
def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(periodic.planted(_table(spark, sf_dir, "documents"))))


@_query("op13_turn_repair", turnrepair.sql())
def turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return turnrepair.digests(turnrepair.repair(turnrepair.damage(turns)), turns)
