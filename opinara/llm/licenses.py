"""License scans by diagonal voting.

Texts and license templates become sequences of words. All rolling k-grams of a text are hashed; Spark joins the hashes to the
places where templates hold the same k-gram. A hit at word p of the text and place q of the template votes for diagonal p - q.
Votes are added up per diagonal, diagonals of a template at most SLACK apart are merged (a word put in or left out shifts
the rest), and a span is verified: its k-grams must be the template's word for word, and cover at least COVERAGE of
the template's places.

A few base phrases are templates of one k-gram, so each of their places is one hit. Templates are fixed values, so their
table may be broadcast; hashes that no template holds are dropped where they are made, by the table's own keys.

Defined results: a null text is an empty text; words as in `arrays`; every row has its own result, rows that repeat an id
too; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from . import arrays

K = 3
SLACK = 2
COVERAGE = 0.7

#: fixed values: phrases of which every place counts, and their labels
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: fixed values: notices of public licenses, and their labels
NOTICES = [
    ("licensed under the apache license version 2.0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license v 2.0", "mpl-2.0"),
    ("licensed under cc by nc 4.0", "cc-by-nc"),
    ("licensed under cc by sa 4.0", "cc-by-sa"),
    ("creative commons attribution 4.0 international license", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _split(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def template_grams(base=BASE, notices=NOTICES) -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, base, places, k, place, k-gram) of every place; a template shorter than K is one k-gram."""
    rows = []
    for number, (text, label, is_base) in enumerate([(*b, True) for b in base] + [(*n, False) for n in notices]):
        words = _split(text)
        k = len(words) if is_base else min(K, len(words))
        places = len(words) - k + 1
        rows += [(number, label, is_base, places, k, q, " ".join(words[q: q + k])) for q in range(places)]
    return rows


def _hash_grams(grams: list[str]) -> np.ndarray:
    data, offsets = arrays.buffers(pa.array(grams, pa.string()))
    words = arrays.Words(data, offsets, 0, len(grams))
    return np.array([arrays.whole(words.hashes[words.bounds[i]: words.bounds[i + 1]]) for i in range(len(grams))], np.uint64)


def _roll(keys: dict[int, np.ndarray]):
    """Per text: the number of words, and (k, word, hash, words) of the k-grams some template holds."""
    schema = pa.list_(pa.struct([("k", pa.int32()), ("p", pa.int64()), ("h", pa.int64()), ("gram", pa.string())]))

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: arrays.Lookup(own) for k, own in keys.items()}
        for batch in batches:
            data, offsets = arrays.buffers(batch.column("_text"))
            counts, hits = [], []
            for first, last in arrays.blocks(offsets):
                words = arrays.Words(data, offsets, first, last)
                owner = np.repeat(np.arange(last - first), words.counts)
                found: list[list] = [[] for _ in range(last - first)]
                for k, table in tables.items():
                    grams = arrays.rolling(words.hashes, k)
                    for p in table.hits(grams).tolist():
                        d = int(owner[p])
                        if d == owner[p + k - 1]:
                            raw = data[offsets[first] + words.starts[p]: offsets[first] + words.ends[p + k - 1]]
                            found[d].append({"k": k, "p": p - int(words.bounds[d]), "h": int(grams[p].view(np.int64)),
                                             "gram": " ".join(_split(raw.tobytes().decode("utf-8", "replace")))})
                counts.append(words.counts)
                hits += found
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n.astype(np.int64)), pa.array(hits, schema)],
                                             ["_id", "n_words", "hits"])

    return roll


def _votes(docs: DataFrame, key: str, text: str, base, notices) -> tuple[DataFrame, DataFrame]:
    """(rows of the texts with their word counts, every hit of a row on a template)."""
    spark = docs.sparkSession
    rows = template_grams(base, notices)
    hashes = _hash_grams([r[-1] for r in rows])
    keys = {k: hashes[[r[4] == k for r in rows]] for k in sorted({r[4] for r in rows})}
    templates = spark.createDataFrame(
        [(*r, int(h.view(np.int64))) for r, h in zip(rows, hashes, strict=True)],
        "template int, label string, base boolean, places int, k int, q int, gram string, h bigint")
    kind = dict(docs.dtypes)[key]
    schema = f"_id {kind}, n_words bigint, hits array<struct<k:int,p:bigint,h:bigint,gram:string>>"
    scanned = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(_roll(keys), schema)
    # row numbers are fixed by writing them
    scanned = materialize(scanned.withColumn("_row", F.monotonically_increasing_id()), "license-hits")
    hits = scanned.select("_row", F.explode("hits").alias("hit")).select("_row", "hit.*")
    votes = hits.join(F.broadcast(templates), ["k", "h"]).where(hits["gram"] == templates["gram"])
    return scanned, votes.select("_row", "template", "label", "base", "places", "k", "p", "q")


def _spans(votes: DataFrame) -> DataFrame:
    """Verified spans: _row, label, base, start, end (words, end excluded), coverage."""
    diagonals = votes.withColumn("d", F.col("p") - F.col("q")).groupBy(
        "_row", "template", "label", "base", "places", "k", "d").agg(
        F.collect_set("q").alias("qs"), F.min("p").alias("low"), F.max("p").alias("high"))
    order = Window.partitionBy("_row", "template").orderBy("d")
    step = F.col("d") - F.lag("d").over(order)
    # places of a one-gram template are spans of their own
    fresh = F.when(step.isNull() | (step > SLACK) | (F.col("places") == 1), 1).otherwise(0)
    merged = diagonals.withColumn("fresh", fresh).withColumn("band", F.sum("fresh").over(order)).groupBy(
        "_row", "template", "label", "base", "places", "k", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("covered"),
        F.min("low").alias("start"), F.max("high").alias("high"))
    return merged.withColumn("coverage", F.col("covered") / F.col("places")).where(F.col("coverage") >= COVERAGE).select(
        "_row", "label", "base", "start", (F.col("high") + F.col("k")).alias("end"), "coverage")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """One row per verified span: key, label, base, start, end, coverage."""
    scanned, votes = _votes(docs, key, text, base, notices)
    return _spans(votes).join(scanned.select("_row", F.col("_id").alias(key)), "_row").select(
        key, "label", "base", "start", "end", "coverage")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """One row per row of `docs`: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    scanned, votes = _votes(docs, key, text, base, notices)
    found = _spans(votes).groupBy("_row").agg(
        F.count_if("base").alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"))
    return scanned.drop("hits").join(found, "_row", "left").select(
        F.col("_id").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def sql(table: str = "documents", base=BASE, notices=NOTICES) -> str:
    """The rows of `scan` in DuckDB SQL."""
    places = ", ".join(f"({t}, '{label}', {str(b).lower()}, {n}, {k}, {q}, '{gram}')"
                       for t, label, b, n, k, q, gram in template_grams(base, notices))
    return f"""
        with templates(template, label, base, places, k, q, gram) as (values {places}),
        words as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from {table}
        ), grams as (
            select doc_id, k, unnest(range(0, len(w) - k + 1)) as p, array_to_string(w[p + 1:p + k], ' ') as gram
            from words cross join (select distinct k from templates) where len(w) >= k
        ), votes as (select doc_id, template, label, base, places, k, q, p from grams join templates using (k, gram)),
        diagonals as (
            select doc_id, template, label, base, places, k, p - q as d, list(distinct q) as qs, min(p) as low, max(p) as high
            from votes group by all
        ), steps as (
            select *, case when places > 1 and d - lag(d) over o <= {SLACK} then 0 else 1 end as fresh
            from diagonals window o as (partition by doc_id, template order by d)
        ), bands as (
            select *, sum(fresh) over (partition by doc_id, template order by d) as band from steps
        ), spans as (
            select doc_id, label, base, min(low) as start, len(list_distinct(flatten(list(qs)))) / places::double as coverage
            from bands group by doc_id, template, label, base, places, k, band having coverage >= {COVERAGE}
        ), found as (
            select doc_id, count(*) filter (where base) as n_base, min(start) filter (where base) as first_word,
                   max(start) filter (where base) as last_word,
                   string_agg(distinct label, ',' order by label) filter (where base) as base_labels,
                   string_agg(distinct label, ',' order by label) as labels, max(coverage) as score
            from spans group by doc_id
        )
        select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0) as score
        from words left join found using (doc_id)"""
