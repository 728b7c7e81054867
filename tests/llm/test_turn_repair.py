"""The auction against exhaustive search and against the SQL twin, in one chunk and in many."""

import hashlib
import itertools
import random

import duckdb
import pytest

from opinara.llm import turnrepair as tr

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ["user", "assistant", "system", "tool", "User", "", None]
TEXTS = ["Yes.", "No!", "Why?", "cut off", "", " \n", None, "done. \t", "a.b"]


def rows(count, longest, seed, nulls=True):
    rng = random.Random(seed)
    out = []
    for c in range(count):
        conv = None if nulls and c == 0 else c
        n = rng.randrange(0, longest + 1)
        for t in range(n):
            role = rng.choice(ROLES) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            text = rng.choice(TEXTS) if rng.random() < 0.4 else f"text {rng.randrange(50)}."
            turn = None if nulls and t == 0 and rng.random() < 0.2 else t + (t > 5)
            out.append((conv, turn, role, text))
            if rng.random() < 0.05:
                out.append((conv, turn, role, text))
    return out


def oracle(data):
    con = duckdb.connect()
    con.sql("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    if data:
        con.executemany("insert into conversations values (?, ?, ?, ?)", data)
    rel = con.sql(tr.sql())
    return sorted((dict(zip(rel.columns, r)) for r in rel.fetchall()), key=lambda r: str(r["conv_id"]))


def ours(spark, data, chunk=tr.CHUNK):
    turns = spark.createDataFrame(data, SCHEMA).repartition(3)
    out = tr.digests(tr.repair(tr.damage(turns), chunk=chunk), turns)
    return sorted((r.asDict() for r in out.collect()), key=lambda r: str(r["conv_id"]))


def brute(turns, ending):
    """All edit sequences of a short conversation with at most two insertions before each turn and at the end."""
    best = None
    options = [["D"] if t.must_go else ["D", "K", "R"] for t in turns]
    for inserts in itertools.product(range(3), repeat=len(turns) + 1):
        for letters in itertools.product(*options):
            state, cost, audit = tr.START, 0, ""
            for n, letter, turn in zip(inserts, (*letters, None), (*turns, None)):
                for _ in range(n):
                    state, cost, audit = tr._NEXT[state], cost + tr.INSERT, audit + "I"
                if letter is None:
                    break
                audit += letter
                if letter == "D":
                    cost += tr.DELETE * turn.times
                    continue
                cost += tr.TRUNCATED * turn.cut
                if letter == "R":
                    state, cost = tr._NEXT[state], cost + tr.RELABEL
                else:
                    state = tr._KEEP.get((state, turn.initial))
                if state is None:
                    break
            if state in (tr.START, tr.ASSISTANT) and (best is None or (cost, audit) < best):
                best = cost, audit
    return best


@pytest.mark.parametrize("block", [1, 2, 16])
def test_auction_equals_exhaustive_search(monkeypatch, block):
    monkeypatch.setattr(tr, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(60):
        turns = [tr.Turn(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3, rng.choice([1, 1, 3]))
                 for _ in range(rng.randrange(1, 5))]
        lattice = tr.Lattice(turns, tr.ENDING)
        letters, state = lattice.trace([tr.START])[tr.START]
        cost, audit = brute(turns, tr.ENDING)
        assert lattice.price[tr.START] == cost
        assert letters + "I" * (tr.ENDING[state] // tr.INSERT) == audit


def test_prices_are_feasible_and_exact_at_borders():
    rng = random.Random(2)
    turns = [tr.Turn(rng.choice("suat"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(400)]
    lattice = tr.Lattice(turns, tr.ENDING)
    exact = [0] * (4 * len(turns)) + list(tr.ENDING)
    for row in range(len(turns) - 1, -1, -1):
        own = [tr.INFINITE] * 4
        for _ in range(4):
            own = [min(own[to] + c if not step else exact[4 * (row + 1) + to] + c for _, step, to, c in arcs)
                   for arcs in lattice.arcs[row]]
        exact[4 * row: 4 * row + 4] = own
    for node, price in enumerate(lattice.price):
        assert price <= exact[node]
        if node % (4 * tr.BLOCK) < 4:
            assert price == exact[node]


def test_transfers_compose():
    rng = random.Random(6)
    turns = [tr.Turn(rng.choice("suat"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(30)]
    first, second, whole = (tr.transfer(x) for x in (turns[:13], turns[13:], turns))
    for s, e in itertools.product(range(4), repeat=2):
        assert whole[4 * s + e] == min(tr.INFINITE, *(first[4 * s + k] + second[4 * k + e] for k in range(4)))


def test_equals_sql(spark):
    data = rows(150, 14, 1)
    assert ours(spark, data) == oracle(data)


@pytest.mark.parametrize("chunk", [3, 7])
def test_conversations_in_chunks_equal_sql(spark, chunk):
    data = rows(25, 60, chunk, nulls=False)
    assert ours(spark, data, chunk) == oracle(data)


def test_chunks_of_repeated_numbers_equal_one_piece(spark):
    """Many rows of one number, and of none: cut by share of the hashes, with the result of one chunk."""
    rng = random.Random(9)
    data = [(1, rng.choice([None, 0, 0, 1]), rng.choice(ROLES), f"t{rng.randrange(40)}{rng.choice(['.', ''])}") for _ in range(160)]
    data += [(None, None, "user", "same.")] * 70 + [(2, 5, "assistant", "x.")]
    assert ours(spark, data, 4) == ours(spark, data)
    same = [r for r in ours(spark, data, 4) if r["conv_id"] is None][0]
    damaged = tr.damage(spark.createDataFrame([(None, None, "user", "same.")], SCHEMA)).count()
    assert same["duplicate"] == 70 * damaged - 1 and same["audit"] == "K" + "D" * (70 * damaged - 1) + "I"


def test_every_kind_of_row(spark):
    data = [(None, None, None, None), (1, 0, "user", None), (2, 1, None, "hi."), (3, 0, "user", "x" * 300_000 + "."), (4, 0, "user", "")]
    turns = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as _c", "2 as edits", "3 as _a", "4 as cost")
    out = tr.digests(tr.repair(tr.damage(turns)), turns)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted((r.asDict() for r in out.collect()), key=lambda r: str(r["conv_id"])) == oracle(data)
    empty = turns.limit(0)
    assert tr.digests(tr.repair(tr.damage(empty)), empty).collect() == []
    gone = spark.createDataFrame([(7, t, "user", "a.") for t in range(1)], SCHEMA)
    kept = tr.digests(tr.repair(tr.damage(gone).limit(0)), gone).first()
    assert tuple(kept) == (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_carry_texts(spark):
    turns = spark.createDataFrame([("c", 0, "system", "Be kind."), ("c", 1, "user", "Hi."), ("c", 2, "user", "cut"),
                                   ("c", 3, "user", "Hi.")], SCHEMA.replace("conv_id long", "conv_id string"))
    part = tr.repair(turns).first()
    assert part["conv_id"] == "c" and part["cost"] == 3 + 3 + 4
    assert [(e["action"], e["fault"], e["role"], e["text"]) for e in part["edits"]] == [
        ("keep", None, "system", "Be kind."), ("keep", None, "user", "Hi."), ("rerole", "truncated", "assistant", "cut"),
        ("delete", "duplicate", "user", None)]
