"""The corpus operators against brute force, and on nulls, ties, repeats, empty tables and clashing columns."""

import collections
import itertools
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from opinara.llm import (arrays, chat, decontam, exactdedup, langid, licenses, ngramjoin, packing, queries, sharding,
                         tokenids, tokens, toxicity)
from opinara.session import scratch_path

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id bigint, text string, lang string, _id string, part string, n bigint, start string, h string"
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def make(spark, rows):
    """(id, text) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", "y", 7, "z", "w") for i, t in rows], SCHEMA)


def vocabulary():
    return queries.vocabulary()


def real(spark, n=60):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(n)
    return [(r[0], r[1]) for r in docs.collect()]


ODD = [(1, None), (2, ""), (3, "  \n"), (4, "a"), (None, "a b"), (5, "Ünï cödé 日本 x"), (5, "again"), (5, "again"),
       (6, "word " * 60_000), (7, "…—!?")]


# ---------------------------------------------------------------- words and tokens

def test_words_match_the_pattern():
    import pyarrow as pa

    texts = [t for _, t in ODD] + ["Don't STOP—now", "end", "of"]
    data, offsets = arrays.buffers(pa.array(texts, pa.string()))
    for first, last in arrays.blocks(offsets, 64):
        block = arrays.Words(data, offsets, first, last)
        assert block.counts.tolist() == [len(words(t)) for t in texts[first:last]]
    every = arrays.Words(data, offsets, 0, len(texts))
    flat = [w for t in texts for w in words(t)]
    seen = dict(zip(flat, every.hashes.tolist(), strict=True))
    assert [seen[w] for w in flat] == every.hashes.tolist() and len(set(seen.values())) == len(seen)


def test_long_words_hash_alike_across_runs(monkeypatch):
    import pyarrow as pa

    data, offsets = arrays.buffers(pa.array(["ab " + "x" * 50 + " cd ab"], pa.string()))
    whole = arrays.Words(data, offsets, 0, 1).hashes
    monkeypatch.setattr(arrays, "RUN", 4)
    assert arrays.Words(data, offsets, 0, 1).hashes.tolist() == whole.tolist()


def test_tokens_are_those_of_the_whole_text():
    encoder = tokens.encoder(vocabulary())
    texts = ["a  b c", "x \n y", " lead", "trail ", "a b", "don't 's  x\t y", "<|endoftext|> hi<|endoftext|>x", "",
             "日本 語", "a.\nB, c!\nd", "x\n\ny", "  ", "end.\n", "a ½ b² c", "A" * 500 + " b"]
    for text in texts:
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want, text


# ---------------------------------------------------------------- chat

def cheapest(roles):
    """Cost of the cheapest repair by search over all short plans."""
    best = {0: 0}
    def close(costs):
        changed = True
        while changed:
            changed = False
            for s, c in list(costs.items()):
                for to in chat.LEGAL[s]:
                    if c + chat.INSERT < costs.get(to, 99):
                        costs[to] = c + chat.INSERT
                        changed = True
        return costs
    for role in roles:
        after = {}
        change = chat.NAME_UNKNOWN if role == 0 else chat.RELABEL
        for s, c in close(dict(best)).items():
            for to in chat.LEGAL[s]:
                after[to] = min(after.get(to, 99), c + (0 if to == role else change))
            if s:
                after[s] = min(after.get(s, 99), c + chat.MERGE + (0 if s == role else change))
        best = after
    done = close(dict(best))
    return min(done[f] for f in chat.FINAL)


def test_role_repair_is_legal_and_cheapest():
    for n in range(1, 6):
        for roles in itertools.product(range(5), repeat=n):
            steps = chat.repair(list(roles))
            assert [t for t, *_ in steps if t >= 0] == list(range(n))
            assert sum(c for *_, c in steps) == cheapest(roles)
            state = 0
            for _, action, role, _ in steps:
                if "merge" in action:
                    assert role == state
                else:
                    assert role in chat.LEGAL[state]
                state = role
            assert state in chat.FINAL


def test_chats_in_chunks_equal_chats_in_one_piece(spark):
    rng = np.random.default_rng(5)
    roles = ["system", "user", "Assistant ", "tool", "bot", None]
    rows = [(1, i, roles[rng.integers(6)], f"t{i}") for i in range(60)]
    rows += [(2, 0, "user", f"tie{i}") for i in range(50)] + [(None, None, "user", None), (3, 1, "user", "q"), (3, 1, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("part", __import__(
        "pyspark.sql.functions", fromlist=["lit"]).lit(1))
    def text_of(chunk):
        out = chat.format_chats(df, chunk=chunk).toPandas().sort_values(["part", "step"])
        return {-1 if pd.isna(k) else k: ("".join(g["rendered"]), g["cost"].sum()) for k, g in out.groupby("conv_id", dropna=False)}
    one, many = text_of(10_000), text_of(7)
    assert len(one) == 4
    for key in one:
        assert one[key][1] == many[key][1]
    assert many[3][0] == "<|user|>\nq\nq<|end|>\n"    # every row comes out
    ones = [chat.ROLES.index((r or "").strip().lower()) if (r or "").strip().lower() in chat.ROLES else 0 for _, _, r, _ in rows[:60]]
    assert one[1][1] == cheapest(ones)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_repeated_turns_stay_where_no_number_or_id_names_them(spark):
    rows = [(None, 0, "system", "s")] * 3 + [(None, None, "user", "yes")] * 40 + [(None, None, "bot", None), (None, None, "bot", "")]
    rows += [(1, 0, "user", "q"), *[(1, None, "user", "yes")] * 25, *[(1, None, "assistant", "ok")] * 30, (1, None, "user", "no")]
    rows += [(2, 0, "user", None), (2, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    seen = []
    for chunk in (4, 7, 10_000):
        out = chat.format_chats(df, chunk=chunk).toPandas().sort_values(["part", "step"])
        assert (out["action"] != "insert").sum() == len(rows)
        assert len(out[["conv_id", "part", "step"]].drop_duplicates()) == len(out)
        seen.append({-1 if pd.isna(k) else k: "".join(g["rendered"]) for k, g in out.groupby("conv_id", dropna=False)})
        assert seen[-1][1].count("yes") == 25 and seen[-1][1].count("ok") == 30 and seen[-1][-1].count("yes") == 40
        costs = out.groupby("conv_id", dropna=False)["cost"].sum().to_dict()
        seen[-1]["costs"] = sorted(costs.values())
        if chunk == 4:
            assert out.groupby(["conv_id", "part"], dropna=False).size().max() <= 4 * chunk
    assert seen[0]["costs"] == seen[1]["costs"] == seen[2]["costs"]


# ---------------------------------------------------------------- licenses

def test_license_scan(spark):
    notice = "Licensed under the Apache License, Version 2.0"
    rows = [*ODD, (20, f"x {notice} y"), (21, "licensed under the big apache license version 2.0"), (22, "licensed under the"),
            (23, "CC BY cc-by GENERAL public\nlicense"), (24, "all rights reserved " * 3)]
    got = {r["doc_id"]: r for r in licenses.scan(make(spark, rows)).collect()}
    assert licenses.scan(make(spark, rows)).count() == len(rows)
    assert got[1]["n_words"] == 0 and got[1]["first_word"] is None and got[1]["score"] == 0
    assert (got[20]["labels"], got[20]["n_base"], got[20]["score"]) == ("apache-2.0", 0, 1.0)
    assert got[22]["labels"] == ""
    assert (got[23]["n_base"], got[23]["first_word"], got[23]["last_word"], got[23]["base_labels"]) == (3, 0, 4, "cc-by,gpl")
    assert (got[24]["n_base"], got[24]["last_word"]) == (3, 6)
    span = [r for r in licenses.spans(make(spark, [(1, f"one two {notice}")])).collect() if not r["base"]]
    assert [(r["start"], r["end"], r["label"]) for r in span] == [(2, 10, "apache-2.0")]
    assert licenses.scan(make(spark, [])).count() == 0


# ---------------------------------------------------------------- packing and token files

def test_windows_use_every_piece_once_and_fill():
    rng = np.random.default_rng(1)
    counts = collections.Counter(rng.integers(1, 2048, 3000).tolist())
    used = collections.Counter()
    windows = 0
    for chosen, times in packing.choose_windows(dict(counts)):
        assert sum(n * c for n, c in chosen.items()) <= 2048
        windows += times
        used.update({n: c * times for n, c in chosen.items()})
    assert used == counts
    room = []  # first fit decreasing
    for n in sorted(counts.elements(), reverse=True):
        k = next((i for i, r in enumerate(room) if r >= n), None)
        if k is None:
            room.append(2048 - n)
        else:
            room[k] -= n
    assert windows <= 1.01 * len(room) + 1


@pytest.mark.parametrize("capacity", [1, 7, 12, 30])
def test_closest_fill_is_optimal(capacity):
    counts = {3: 2, 5: 1, 8: 2, 11: 1}
    best = max(s for take in itertools.product(*(range(c + 1) for c in counts.values()))
               if (s := sum(n * t for n, t in zip(counts, take, strict=True))) <= capacity)
    chosen = packing._closest(counts, capacity)
    assert sum(n * c for n, c in chosen.items()) == best and all(c <= counts[n] for n, c in chosen.items())


def test_packing(spark, monkeypatch):
    monkeypatch.setattr(packing, "CELL", 3)
    rows = [*ODD, *[(100 + i, "same text") for i in range(20)], *real(spark, 40)]
    got = packing.pack_documents(make(spark, rows), vocabulary(), 1, 256).toPandas()
    encode = tokens.encoder(vocabulary()).encode
    want = collections.Counter()
    for i, text in rows:
        ids = encode(text or "") + np.array([1], "<u4").tobytes()
        want.update((i, s, zlib.crc32(ids[4 * s: 4 * s + 1024]), len(ids) // 4) for s in range(0, len(ids) // 4, 256))
    assert want == collections.Counter((None if pd.isna(a) else int(a), b, c, d) for a, b, c, d in got[
        ["doc_id", "start", "ids_crc32", "doc_tokens"]].itertuples(index=False))
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 256
    assert packing.pack_documents(make(spark, []), vocabulary()).count() == 0


def test_assembled_sequences(spark):
    pieces = packing.cut_pieces(make(spark, real(spark, 20)), vocabulary(), 1, 128, with_ids=True)
    for r in packing.assemble(packing.place_pieces(pieces, 128), 128).collect():
        size = len(r["ids"]) // 4
        assert size == (128 if r["n_tokens"] & (r["n_tokens"] - 1) else r["n_tokens"])


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenids, "PART_ROWS", 20)
    monkeypatch.setattr(tokenids, "SEGMENT_BYTES", 4000)
    rows = [*ODD, *real(spark, 80)]
    path = scratch_path(spark, "ids")
    tokenids.write(make(spark, rows), path, vocabulary(), 0)
    got = tokenids.read(spark, path, with_ids=True).toPandas()
    encode = tokens.encoder(vocabulary()).encode
    want = sorted((i is not None, i or 0, encode(t or "") + b"\0\0\0\0") for i, t in rows)
    assert len(got) == len(rows)
    got = got.sort_values("start")
    assert got["start"].tolist() == [0, *got["n_tokens"].cumsum().tolist()[:-1]]
    assert [i for i in got["doc_id"].fillna(-1).tolist()] == [i if has else -1 for has, i, _ in want]
    assert sorted(bytes(x) for x in got["ids"]) == sorted(x for *_, x in want)
    assert [zlib.crc32(bytes(x)) for x in got["ids"]] == got["ids_crc32"].tolist()
    one = tokenids.lookup(spark, path, [5]).collect()
    assert sorted(bytes(r["ids"]) for r in one) == sorted(x for _, i, x in want if i == 5)
    with pytest.raises(ValueError):
        tokenids._open(bytes(spark.read.parquet(f"{path}/segments").first()["body"]), 1)
    empty = scratch_path(spark, "ids")
    tokenids.write(make(spark, []), empty, vocabulary(), 0)
    assert tokenids.read(spark, empty).count() == 0


# ---------------------------------------------------------------- sharding

@pytest.mark.parametrize("limit", [300, 5_000, 1 << 30])
def test_sharding_equals_its_sql(spark, limit):
    rows = [(i, "x" * (i * 37 % 900)) for i in range(300)] + [(None, "ab"), (7, None), (7, "y" * 400)]
    df = make(spark, rows)
    got = sharding.assign(df, limit).toPandas()
    documents = df.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(sharding.sql(limit)).df()
    key = lambda d: sorted(map(str, d[sorted(d.columns)].astype({"doc_id": "Int64"}).itertuples(index=False)))
    assert len(got) == len(rows) and key(got) == key(want)
    assert (got.groupby("shard_id")["n_bytes"].sum() <= limit).all() or got["oversize"].any()
    assert sharding.assign(make(spark, [])).count() == 0


def test_written_shards_hold_every_row(spark):
    rows = [(i, "x" * 50) for i in range(100)]
    path = scratch_path(spark, "shards")
    sharding.write_shards(make(spark, rows), path, 600)
    back = spark.read.parquet(f"{path}/shards").toPandas()
    assert sorted(back["doc_id"]) == list(range(100)) and back.groupby("shard_id").size().max() <= 12


# ---------------------------------------------------------------- decontamination

def weighted(a, b):
    a, b = collections.Counter(a), collections.Counter(b)
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def shingle(w):
    return [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: rng.choice(vocab, n).tolist()
    items = [(i, say(int(n))) for i, n in enumerate([5, 8, 20, 40, 60, 60, 60])] + [(90, ["w1", "w2", "w3"])]
    docs = []
    for i in range(80):
        body = say(120)
        own = list(items[i % 8][1])
        for _ in range(i % 4):
            if len(own) > 5:
                own[rng.integers(len(own))] = "changed"
        docs.append((i, body[:50] + own + body[50:]))
    docs += [(200, items[3][1]), (201, items[3][1][:36]), (202, items[4][1] * 2)]
    want = set()
    for d, body in docs:
        for n, item in items:
            size = len(item) if len(item) < 5 else min(len(item), len(body))
            if len(body) < 5 <= len(item):
                continue
            scores = [weighted(shingle(body[s:s + size]), shingle(item)) for s in range(len(body) - size + 1)]
            if scores and max(scores) >= 0.8:
                want.add((d, n, scores.index(max(scores)), round(max(scores), 9)))
    frame = make(spark, [(d, " ".join(b).upper() + ".") for d, b in docs] + [(None, None), (300, ""), (0, " ".join(docs[0][1]))])
    bench = spark.createDataFrame([(n, ", ".join(w)) for n, w in items] + [(91, None), (92, "")], "item_id bigint, text string")
    got = decontam.find(frame, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["start"], round(r["similarity"], 9)) for r in got} == want
    assert len(got) == len(want)
    kept = {r["doc_id"] for r in decontam.keep_clean(frame, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, *_ in want} | {None, 300}
    assert decontam.find(frame, bench.limit(0)).count() == 0 and decontam.find(make(spark, []), bench).count() == 0
    assert decontam.keep_clean(frame, bench.limit(0)).count() == len(docs) + 3


def test_hamming_blocks_reach_the_whole_radius():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"v{x}" for x in rng.integers(0, 500, 30)) for _ in range(40)]
    index = decontam.Index(list(range(40)), texts, 0.8)
    for item in range(40):
        for bits in range(decontam.RADIUS + 1):
            flipped = index.prints[item]
            for bit in rng.choice(64, bits, replace=False):
                flipped = flipped ^ np.uint64(1 << int(bit))
            _, found = index.within_radius(np.zeros(1, np.int64), np.array([flipped]))
            assert item in found


# ---------------------------------------------------------------- near duplicates

def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = [rng.integers(0, 300, 80).tolist() for _ in range(12)]
    texts = []
    for i in range(150):
        own = [f"w{x}" for x in base[i % 12]]
        for _ in range(int(rng.integers(0, 4))):
            own[rng.integers(80)] = f"n{rng.integers(9)}"
        texts.append(" ".join(own))
    rows = [*enumerate(texts), (900, None), (901, ""), (902, "one two"), (903, "One, TWO!"), (None, "x"), (902, "one two")]
    rows += [(None, texts[3] + " more"), (None, texts[3] + " more"), (None, "lone words of nobody else here"), (None, None)]
    keys = list(dict.fromkeys(rows))
    sets = [set(shingle(words(t))) for _, t in keys]
    n = range(len(keys))
    near = {(a, b) for a in n for b in n if a != b and sets[a] and sets[b]
            and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    root = list(n)
    for _ in sets:
        for a, b in near:
            root[a] = root[b] = min(root[a], root[b])
    least = [min((keys[j][0] for j in n if root[j] == root[i] and keys[j][0] is not None), default=None) for i in n]
    links = collections.Counter(a for a, _ in near)
    got = ngramjoin.near_duplicates(make(spark, rows)).collect()
    want = [(keys[i][0], least[i], links[i], len(sets[i])) for i in n]
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got)
    con = duckdb.connect()
    con.sql("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(map(str, con.sql(ngramjoin.sql()).fetchall())) == sorted(str(tuple(r)) for r in got)
    root = {i: keys[root[i]][0] for i in range(154)}
    kept = sorted(r["doc_id"] for r in ngramjoin.keep_one(make(spark, rows[:154])).collect())
    assert kept == sorted(set(root.values()))
    assert ngramjoin.near_duplicates(make(spark, [])).count() == 0


def test_one_row_of_each_class_stays(spark):
    one, two = ([f"{c}{i}" for i in range(60)] for c in "ab")
    near = lambda w, i: " ".join([*w[:-1], f"z{i}"])
    clean = [" ".join(f"{c}{i}" for i in range(40)) for c in "cdef"]
    rows = [(1, near(one, 0)), (2, near(one, 1)), (2, clean[0]), (3, near(two, 0)), (3, near(two, 1)), (3, near(two, 1)),
            (None, near(one, 2)), (None, near(two, 2)), (None, clean[1]), (None, clean[2]), (None, clean[2] + " end"),
            (4, clean[3]), (4, clean[3]), (None, None), (None, "..."), (None, "..."), (5, "")]
    kept = collections.Counter((r["doc_id"], r["text"]) for r in ngramjoin.keep_one(make(spark, rows)).collect())
    twos = [r for r in kept if (r[1] or "").startswith("b0 ")]
    assert len(twos) == 1 and twos[0] in rows[3:6]
    tails = [r for r in kept if (r[1] or "").startswith(clean[2])]
    assert len(tails) == 1
    assert kept == collections.Counter([(1, near(one, 0)), (2, clean[0]), *twos, (None, clean[1]), *tails, (4, clean[3]), *rows[13:]])
    assert ngramjoin.keep_one(make(spark, rows)).columns == make(spark, rows).columns
    got = ngramjoin.near_duplicates(make(spark, rows)).where("doc_id = 2").collect()
    assert sorted((r["class_id"], r["n_links"]) for r in got) == [(1, 2), (2, 0)]


def test_hot_group_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngramjoin, "CHUNK", 16)
    text = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*text[:i], f"c{i}", *text[i + 1:]])) for i in range(90)]
    got = ngramjoin.near_duplicates(make(spark, rows)).collect()
    sets = [set(shingle(words(t))) for _, t in rows]
    for r in got:
        assert r["class_id"] == 0
        own = sets[r["doc_id"]]
        assert r["n_links"] == sum(len(own & s) >= 0.8 * len(own | s) for s in sets) - 1


def test_prefix_length_keeps_the_recall():
    length = ngramjoin.prefix_length()
    assert 1 - (1 - 0.8 ** length) ** ngramjoin.TREES >= ngramjoin.TARGET
    assert 1 - (1 - 0.8 ** (length + 1)) ** ngramjoin.TREES < ngramjoin.TARGET


# ---------------------------------------------------------------- language, toxicity

def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(langid.bucket("doc_id", 5) != 0))
    held = docs.where(langid.bucket("doc_id", 5) == 0)
    both = held.join(langid.identify(held, model), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in both]) > 0.95
    assert not any(r["rejected"] for r in both)
    odd = langid.identify(make(spark, [*ODD, (50, "zqxj wvkk qzzx jjqk xwqv zkqj " * 20)]), model).collect()
    assert {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in odd if r["doc_id"] in (1, 2, 3, 7)} == {
        i: ("und", True) for i in (1, 2, 3, 7)}
    assert [r["rejected"] for r in odd if r["doc_id"] == 50] == [True]
    assert langid.keep_identified(make(spark, [(1, None), (2, both[0]["text"])]), model).count() == 1
    empty = langid.fit(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identify(docs, empty).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0


def test_short_texts_of_unlearned_languages_are_rejected(spark):
    import pyarrow as pa

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    rng = np.random.default_rng(6)
    strange = ["kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 3,
               "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem " * 3,
               "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine " * 3,
               "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 400))]
    texts = pa.array([t[:n] for t in strange for n in (50, 100, 200, 300)])
    assert all(model.predict(texts)[3])
    entropy, sizes = model.entropies(texts)
    # whichever language were the nearest one
    limits = model.mean + model.slack + model.spread / np.sqrt(sizes)[:, None]
    assert len(model.languages) == 4 and (entropy > limits).all()
    own = docs.where("lang is not null").select("text").toPandas()["text"].dropna()
    cuts = pa.array([t[:n] for t in own if len(t) > 300 for n in (50, 100, 200, 300)])
    assert np.mean(model.predict(cuts)[3]) < 0.01


def test_kneser_ney_sums_to_one():
    import pyarrow as pa

    text = "abracadabra bar cab abba"
    data, offsets = arrays.buffers(pa.array([text]))
    chars, whose = langid._characters(data, offsets, 0, 1)
    at = np.flatnonzero(whose >= 0)
    grams, counts = np.unique(np.stack([chars[at - j] for j in range(langid.ORDER - 1, -1, -1)], axis=1), axis=0,
                              return_counts=True)
    model = langid._estimate({"xx": (grams, counts)})
    letters = sorted(set(chars[at].tolist()))
    for context in ("abra", "  ab", "zzzz"):
        line = np.array([[ord(c) for c in context] + [x] for x in [*letters, 0x4E00]], np.uint32)
        total = sum(float(np.exp(model.positions(row, np.array([langid.ORDER - 1]))[0, 0])) for row in line)
        assert total == pytest.approx(1.0, abs=1e-5)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    terms = [toxicity.Term("idiot", False, 1), toxicity.Term("worthless", False, 2), toxicity.Term("lowei", True, 0),
             toxicity.Term("scum", False, 0)]
    machine = toxicity.Automaton(terms)
    rng = np.random.default_rng(0)
    tries = ["idiot", "idiots", "1diot", "idot", "idiotic", "worthles", "wrthlss", "woorthlesss", "scum", "scam", "lowei", "loweixyz",
             "lowe", "x"]
    for t in ("idiot", "worthless", "scum", "lowei"):
        for _ in range(200):
            w = list(t)
            for _ in range(rng.integers(1, 4)):
                k = rng.integers(len(w) + 1)
                [lambda: w.insert(k, "xioel"[rng.integers(5)]), lambda: w.__delitem__(slice(k, k + 1)),
                 lambda: w.__setitem__(slice(k, k + 1), "xioel"[rng.integers(5)])][rng.integers(3)]()
            tries.append("".join(w) or "x")
    codes = np.array([ord(c) for c in " ".join(tries)])
    cls = machine.classes()[codes]
    starts = np.flatnonzero((cls > 0) & np.concatenate([[True], cls[:-1] == 0]))
    hit, _ = machine.read(cls, starts)
    want = [i for i, w in enumerate(tries) if any(
        distance(w, t.text) <= t.edits if not t.open else w.startswith(t.text) for t in terms)]
    assert hit.tolist() == want


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "su", "te") for b in ("ran", "dil", "pos", "tuv", "mel", "gor")]
    say = lambda n: rng.choice(vocab, n).tolist()
    rows, labels = [], []
    for i in range(400):
        body, bad = say(60), i % 4 == 0
        if bad:
            for k in rng.integers(0, 60, 4):
                body[k] = ["blockhead", "nitwit"][int(k) % 2]
        rows.append((i, " ".join(body)))
        labels.append((i, 1, int(bad)))
    docs = make(spark, rows)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (0, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    assert {"blockhead", "nitwit"} <= {t.text for t in model.automaton.terms}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 4 == 0) for i in got)
    plain = " ".join(say(20))
    tries = make(spark, [(1, f"{plain} you blockhead you nitwit blockhead"), (2, f"{plain} blockhaed blokhead nitwitt blockheed"),
                         (3, f'{plain} he said "blockhead"'), (4, f"{plain} blockhead"), (5, None), (6, "")])
    near = {r["doc_id"]: r for r in toxicity.score(tries, model).collect()}
    assert near[1]["score"] >= 0.7 and near[2]["n_hits"] >= 3 and near[2]["score"] > near[5]["score"]
    assert near[3]["score"] < near[4]["score"] and near[3]["n_quoted"] == 1
    assert near[5]["score"] == near[6]["score"] < 0.5
    assert toxicity.score(make(spark, []), model).count() == 0
    bare = toxicity.fit(docs, marks.limit(0), terms=["oaf"])
    assert toxicity.score(docs, bare).count() == 400


def plain_score(model, text):
    """Evidence of a text by hand: exact or misspelled words of the lexicon, without any context."""
    seen, total = collections.Counter(), 0.0
    for w in re.findall(r"[^\W_]+", text.lower()):
        found = min(((distance(w, t.text), -1 * i, t) for i, t in enumerate(model.automaton.terms)
                     if (w.startswith(t.text) if t.open else distance(w, t.text) <= t.edits)), default=None, key=lambda x: x[:2])
        if found:
            seen[w] += 1
            total += found[2].weight / seen[w] * (1.0, 0.5, 0.3)[0 if found[2].open else found[0]]
    return total


def test_evidence_equals_brute_force():
    terms = [toxicity.Term("blockhead", False, 2, 0.8), toxicity.Term("nitw", True, 0, 0.5), toxicity.Term("oaf", False, 0)]
    model = toxicity.Model(toxicity.Automaton(terms), np.zeros(toxicity.FEATURES + 1))
    rng = np.random.default_rng(6)
    words_ = ["blockhead", "blokhead", "blockheda", "nitwit", "nitwits", "nitwitted", "oaf", "oafs", "plain", "word-blockhead", "x", "42"]
    texts = [" ".join(rng.choice(words_, rng.integers(0, 25))) for _ in range(200)]
    features, _, _ = model.features(pa.array(texts))
    assert np.expm1(features[:, 0]) == pytest.approx([plain_score(model, t) for t in texts])


def test_forms_of_a_stem_count_each_and_quotes_end_where_they_end(spark):
    model = toxicity.Model(toxicity.Automaton([toxicity.Term("nitw", True, 0)]), np.zeros(toxicity.FEATURES + 1))
    long = " ".join(["calm"] * 120)
    texts = ["nitwit nitwit nitwit", "nitwit nitwits nitwitted", f'so "{long} nitwit {long}" end', f'so "{long} nitwit {long} end']
    features, hits, quoted = model.features(pa.array(texts))
    assert features[1, 0] == pytest.approx(np.log1p(3)) and features[0, 0] == pytest.approx(np.log1p(1 + 1 / 2 + 1 / 3))
    assert hits.tolist() == [3, 3, 1, 1] and quoted.tolist() == [0, 0, 1, 0]


def test_lexicon_has_no_size_and_reads_words_as_scores_do():
    names = ["".join(p) for p in itertools.product("bdfg", "aeiou", "klm", "aeiou")][:260]
    counts = {p: (50, 0) for n in names for p in toxicity._pieces(n)}
    assert len(toxicity.choose_terms(counts, 100, 1000)) > 200
    assert toxicity._words("a block-head, l'eau!") == ["a", "block", "head", "l", "eau"]


def test_toxicity_rule_and_recall(spark):
    """Held-out rows follow from the id, predictions from the score; recall and precision on the given table."""
    out = queries.QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.01")
    rows = out.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"] and r["toxic"] is not None]
    assert sum(r["predicted"] for r in held if r["toxic"]) >= 0.85 * sum(r["toxic"] for r in held)
    assert sum(r["predicted"] for r in held if not r["toxic"]) <= 0.01 * len(held)


# ---------------------------------------------------------------- exact copies

def test_exact_copies(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (9, None), (8, " \n"), (7, "c"), (7, "c"), (None, "c"), (None, "d"), (4, "a b")]
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"])
           for r in exactdedup.group_copies(make(spark, rows)).collect()}
    by = {i: v for (i, _), v in got.items() if i is not None}
    assert by == {3: (2, 3, False), 1: (2, 3, False), 2: (2, 3, True), 9: (8, 2, False), 8: (8, 2, True), 7: (7, 3, True),
                  4: (4, 1, True)}
    assert sorted((v for (i, _), v in got.items() if i is None), key=str) == [(7, 3, False), (None, 1, True)]
    kept = exactdedup.drop_copies(make(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["2", "4", "7", "8", "None"]
    assert exactdedup.drop_copies(make(spark, rows)).columns == SCHEMA.replace(" bigint", "").replace(" string", "").split(", ")
    assert exactdedup.group_copies(make(spark, [])).count() == 0


# ---------------------------------------------------------------- queries

TABLES = "documents benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_equal_their_sql(spark, name):
    got = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLES:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    plain = lambda rows: sorted(str(tuple(r)) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_contracts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    encode = tokens.encoder(vocabulary()).encode
    start = 0
    for r in sorted(queries.QUERIES["op4_token_ids"](spark, SF).collect(), key=lambda r: r["doc_id"]):
        ids = encode(docs[r["doc_id"]]) + b"\0\0\0\0"
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += r["n_tokens"]
    rows = queries.QUERIES["op8_language_id"](spark, SF).collect()
    assert {r["doc_id"]: r["held_out"] for r in rows} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
