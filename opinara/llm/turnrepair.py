"""Repair of damaged conversations by the auction algorithm for shortest paths.

A conversation's turns, in order, are edited so that their roles read `(s?(ua)+)?` by initials: a turn is kept, given the
role user or assistant, or deleted, and empty turns may be inserted. Blank and repeated turns must go; a turn without an
end mark costs more if it stays. That is a shortest path over a lattice of (turn, state), the state being the initial before.

The auction algorithm holds a price for each node, never more than an arc's cost above the price it leads to, and one
path from an origin. At the end of the path it either extends along an arc that costs exactly the difference, or, if
there is none, raises the node's price to the least cost over its arcs and contracts. Origins are all states at every BLOCK
turns, from the end to the start, with prices kept: a path is done when it meets an origin that is done, so work stays
in a block, and a block's prices start at the least price of the border behind it, which no arc contradicts. At the end
the prices are the dual solution; an arc is tight if it costs the difference of its prices. Exactly the cheapest sequences
of edits run over tight arcs alone, so the tight arcs that lead to the end are traced by the least letter.

A conversation of any length is cut into chunks of about CHUNK turns. For conversations of several chunks, auctions give each chunk's cost
from state to state; their chain backwards gives the prices at every border, with which each chunk's tight arcs lead
from every entry to an exit, and the chain forwards fixes the entries. Both chains stream rows of a few numbers. The texts are
shuffled once, when chunks are put in order. Turns said in an earlier chunk come with it as digests.

Defined results: turns are ordered by number, null first, then by a hash of role and text, role and text; null roles and
texts are one blank; rows that are equal in all four columns count each, and come next to each other; null conversation ids are
one conversation; an empty table gives an empty result; extra columns do not matter, the id may have any type. A repeat is
told by a 128-bit digest of role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CHUNK = 4096
BLOCK = 16
LISTED = 10_000                 # crowded cells that are sent to all tasks; more are joined
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
INFINITE = 1 << 60

START, SYSTEM, USER, ASSISTANT = range(4)   # states: the initial before, START before any
STATES = 4
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_KEEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: cost of the empty turns that end a conversation, from each state
ENDING = (0, 2 * INSERT, INSERT, 0)
_GOOD = {"su", "ua", "au"}
_ACTION = {"D": "delete", "I": "insert", "K": "keep", "R": "rerole"}
FINE, BLANK, CUT = range(3)

Arc = tuple[str, int, int, int]     # letter, turns consumed, state after, cost


class Turn(NamedTuple):
    initial: str
    must_go: bool
    cut: bool
    times: int = 1


@cache
def _arcs(turn: Turn) -> tuple[tuple[Arc, ...], ...]:
    """Arcs from each state over this turn, by letter; an inserted turn stands before it."""
    out = []
    for state in range(STATES):
        arcs: list[Arc] = [("D", 1, state, DELETE * turn.times), ("I", 0, _NEXT[state], INSERT)]
        if not turn.must_go:
            more = TRUNCATED if turn.cut else 0
            if (state, turn.initial) in _KEEP:
                arcs.append(("K", 1, _KEEP[state, turn.initial], more))
            arcs.append(("R", 1, _NEXT[state], RELABEL + more))
        out.append(tuple(arcs))
    return tuple(out)


# ---------------------------------------------------------------- the auction

class Lattice:
    """Nodes (turn, state) of a chunk, node number turn * 4 + state; `ending` is the cost from each state after the last turn."""

    def __init__(self, turns: list[Turn], ending: Iterable[int], entries: Iterable[int] = range(STATES)):
        self.n = len(turns)
        self.arcs = [_arcs(t) for t in turns]
        end = STATES * self.n
        self.price = [INFINITE] * end + [min(x, INFINITE) for x in ending]
        self._reduce()
        done = [False] * end + [True] * STATES
        for row in range((self.n - 1) // BLOCK * BLOCK, -1, -BLOCK):
            after = STATES * min(row + BLOCK, self.n)
            least = min(self.price[after: after + STATES])
            for node in range(STATES * row, after):
                if self.price[node] < INFINITE:
                    self.price[node] = least
            for state in (entries if row == 0 else range(STATES)):
                node = STATES * row + state
                if self.price[node] < INFINITE:
                    self._auction(node, done)
                    done[node] = True

    def _reduce(self) -> None:
        """Nodes without a way to the end keep an infinite price and take no part."""
        price = self.price
        for row in range(self.n - 1, -1, -1):
            base = STATES * row
            changed = True
            while changed:
                changed = False
                for state, arcs in enumerate(self.arcs[row]):
                    if price[base + state] == INFINITE and any(
                            price[base + STATES * step + to] < INFINITE for _, step, to, _ in arcs):
                        price[base + state] = 0
                        changed = True

    def _auction(self, origin: int, done: list[bool]) -> None:
        price, all_arcs, path = self.price, self.arcs, [origin]
        while not done[path[-1]]:
            node = path[-1]
            row, state = divmod(node, STATES)
            base = node - state
            least, best = INFINITE, -1
            for _, step, to, cost in all_arcs[row][state]:
                head = base + STATES * step + to
                if cost + price[head] < least:
                    least, best = cost + price[head], head
            if price[node] < least:         # nothing costs just the difference: raise the price, contract
                price[node] = least
                if len(path) > 1:
                    path.pop()
            else:
                path.append(best)

    def _tight(self, row: int, state: int) -> Iterator[tuple[str, int]]:
        node = STATES * row + state
        if self.price[node] < INFINITE:
            for letter, step, to, cost in self.arcs[row][state]:
                head = STATES * (row + step) + to
                if self.price[node] == cost + self.price[head]:
                    yield letter, head

    def trace(self, entries: Iterable[int]) -> dict[int, tuple[str, int]]:
        """For each entry state the least letters over tight arcs to the end, and the state there."""
        ends = [False] * (STATES * self.n) + [p < INFINITE for p in self.price[STATES * self.n:]]
        for row in range(self.n - 1, -1, -1):
            changed = True
            while changed:                  # insertions lead to states of the same turn
                changed = False
                for state in range(STATES):
                    node = STATES * row + state
                    if not ends[node] and any(ends[head] for _, head in self._tight(row, state)):
                        ends[node] = changed = True
        out = {}
        for entry in entries:
            if not ends[entry]:
                continue
            node, letters = entry, []
            while node < STATES * self.n:
                letter, node = min(x for x in self._tight(*divmod(node, STATES)) if ends[x[1]])
                letters.append(letter)
            out[entry] = "".join(letters), node - STATES * self.n
        return out


def transfer(turns: list[Turn]) -> list[int]:
    """Cost over a chunk from each state to each state, row by row; INFINITE where there is no way."""
    columns = [Lattice(turns, [0 if s == to else INFINITE for s in range(STATES)]).price[:STATES] for to in range(STATES)]
    return [columns[to][start] for start in range(STATES) for to in range(STATES)]


# ---------------------------------------------------------------- rows

def _digest(role: str, text: str) -> bytes:
    head = role.encode()
    return hashlib.blake2b(len(head).to_bytes(8, "little") + head + text.encode(), digest_size=16).digest()


def _state_of_text(text: str) -> int:
    seen = text.rstrip(" \t\n\v\f\r")
    return BLANK if not seen else FINE if seen[-1] in ".!?" else CUT


def _prepared(kind: str):
    """Adds the state of the text and the digest; equal rows of a batch become one with their number."""
    schema = (f"_conv {kind}, _c string, _a bigint, _turn bigint, _h bigint, _role string, _text string, "
              "_times bigint, _fault int, _digest binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[tuple, int] = {}
            times: dict[int, int] = {}
            keys = zip(*(batch.column(c).to_pylist() for c in ("_c", "_turn", "_role", "_text")), strict=True)
            rows = []
            for i, key in enumerate(keys):
                at = first.setdefault(key, i)
                times[at] = times.get(at, 0) + 1
                if at == i:
                    rows.append(key)
            batch = batch.take(pa.array(list(times), pa.int64()))
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(list(times.values()), pa.int64()),
                pa.array([_state_of_text(text) for _, _, _, text in rows], pa.int32()),
                pa.array([_digest(role, text) for _, _, role, text in rows], pa.binary())],
                names=[*batch.schema.names, "_times", "_fault", "_digest"])

    return run, schema


def _in_order(rows: DataFrame) -> DataFrame:
    order = ["_c", "_a", "_b", "_kind", F.asc_nulls_first("_turn"), "_h", "_role"]
    return rows.repartition("_c", "_a", "_b").sortWithinPartitions(*order, *(["_text"] if "_text" in rows.columns else []))


class _Part(NamedTuple):
    key: tuple[str, int, int]
    kind: pa.DataType | None    # of the conversation id
    header: dict
    rows: list[dict]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[_Part]:
    """Chunks of a sorted partition; equal rows become one."""
    part: _Part | None = None
    for batch in batches:
        kind = batch.schema.field("_conv").type if "_conv" in batch.schema.names else None
        for row in batch.to_pylist():
            key = row["_c"], row["_a"], row["_b"]
            if part is None or part.key != key:
                if part is not None and part.rows:
                    yield part
                part = _Part(key, kind, {}, [])
            if row["_kind"] == 0:
                part.header.update(row)
                continue
            if part.rows and all(part.rows[-1][c] == row[c] for c in ("_turn", "_digest")):
                part.rows[-1]["_times"] += row["_times"]
            else:
                part.rows.append(row)
    if part is not None and part.rows:
        yield part


def _faults(part: _Part) -> list[tuple[dict, str, int]]:
    """(row, fault, how often) of a chunk's rows, in order."""
    said = set(part.header.get("_seen") or ())
    out = []
    for row in part.rows:
        times = row["_times"]
        if row["_fault"] == BLANK:
            out.append((row, "blank", times))
        else:
            if row["_digest"] not in said:
                said.add(row["_digest"])
                out.append((row, "truncated" if row["_fault"] == CUT else "", 1))
                times -= 1
            if times:
                out.append((row, "duplicate", times))
    return out


def _turns(found: list[tuple[dict, str, int]]) -> list[Turn]:
    return [Turn(row["_role"][:1], fault in ("blank", "duplicate"), fault == "truncated", times) for row, fault, times in found]


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        costs = transfer(_turns(_faults(part)))
        yield pa.RecordBatch.from_pydict(_key(part) | {"_costs": pa.array([costs], pa.list_(pa.int64()))})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        found = Lattice(_turns(_faults(part)), part.header["_ending"]).trace(range(STATES))
        exits = [found[s][1] if s in found else -1 for s in range(STATES)]
        yield pa.RecordBatch.from_pydict(_key(part) | {"_exits": pa.array([exits], pa.list_(pa.int32()))})


def _key(part: _Part) -> dict[str, pa.Array]:
    c, a, b = part.key
    return {"_c": pa.array([c], pa.string()), "_a": pa.array([a], pa.int64()), "_b": pa.array([b], pa.int64())}


def _chained(batches: Iterator[pa.RecordBatch], column: str, out: str, kind: pa.DataType, step, first) -> Iterator[pa.RecordBatch]:
    """Streams the chunks of each conversation: writes the value before a chunk, then steps over it."""
    conv, value = None, first
    for batch in batches:
        values = []
        for c, own in zip(batch.column("_c").to_pylist(), batch.column(column).to_pylist(), strict=True):
            if c != conv:
                conv, value = c, first
            values.append(value)
            value = step(own, value)
        yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("_c", "_a", "_b")} | {out: pa.array(values, kind)})


def _backwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def step(costs: list[int], ending: list[int]) -> list[int]:
        return [min(INFINITE, *(costs[STATES * s + e] + ending[e] for e in range(STATES))) for s in range(STATES)]

    return _chained(batches, "_costs", "_ending", pa.list_(pa.int64()), step, list(ENDING))


def _forwards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _chained(batches, "_exits", "_entry", pa.int32(), lambda exits, state: exits[state], START)


_EDIT = pa.struct([("action", pa.string()), ("times", pa.int64()), ("fault", pa.string()), ("turn", pa.int64()),
                   ("role", pa.string()), ("text", pa.string())])
_EDIT_SQL = "array<struct<action: string, times: bigint, fault: string, turn: bigint, role: string, text: string>>"
_COUNTS = ("rows", "first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal", "cost")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    for part in _parts(batches):
        header, found = part.header, _faults(part)
        entry = header.get("_entry") or START
        letters, state = Lattice(_turns(found), header.get("_ending") or ENDING, [entry]).trace([entry])[entry]
        if not header or header["_last"]:
            letters += "I" * (ENDING[state] // INSERT)
        edits, cost, at, now = [], 0, 0, entry
        for letter in letters:
            if letter == "I":
                now, cost = _NEXT[now], cost + INSERT
                edits.append({"action": "insert", "times": 1, "role": _NAME[now], "text": ""})
                continue
            row, fault, times = found[at]
            role, text, at = row["_role"], row["_text"], at + 1
            if letter == "D":
                text, cost = None, cost + DELETE * times
            else:
                cost += TRUNCATED if fault == "truncated" else 0
                if letter == "R":
                    now, cost = _NEXT[now], cost + RELABEL
                    role = _NAME[now]
                else:
                    now = _KEEP[now, role[:1]]
            edits.append({"action": _ACTION[letter], "times": times, "fault": fault or None, "turn": row["_turn"],
                          "role": role, "text": text})
        out.append((part.rows[0]["_conv"], *part.key, header.get("_parts") or 1, *_counts(found), cost,
                    found[0][0]["_role"][:1], found[-1][0]["_role"][:1], edits))
        held += len(edits)
        if held >= _HELD:
            yield _batch(out, part.kind)
            out, held = [], 0
    if out:
        yield _batch(out, part.kind)


_HELD = 2000    # edits of a batch, about


def _batch(parts: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.string(), *[pa.int64()] * (3 + len(_COUNTS)), pa.string(), pa.string(), pa.list_(_EDIT)]
    names = ["_conv", "_c", "_a", "_b", "_parts", *_COUNTS, "first_initial", "last_initial", "edits"]
    columns = map(list, zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _counts(found: list[tuple[dict, str, int]]) -> tuple:
    rows, illegal, before = 0, 0, None
    number = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    turns = [row["_turn"] for row, _, _ in found if row["_turn"] is not None]
    for row, fault, times in found:
        own = row["_role"][:1]
        if before is not None:
            illegal += before + own not in _GOOD
        illegal += (times - 1) * (own + own not in _GOOD)
        before = own
        rows += times
        if fault:
            number[fault] += times
    return rows, min(turns, default=None), max(turns, default=None), len(set(turns)), *number.values(), illegal


# ---------------------------------------------------------------- on Spark

def damage(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows damaged by crc32 of `conv:turn` modulo 20; null roles and texts, and nulls in that key, are one blank."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(filled(conv), F.lit(":"), filled(turn))) % 20
    own = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(filled(text), "[.!?]", "")).otherwise(filled(text))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return turns.select(conv, turn, F.when(kind == 4, "user").otherwise(filled(role)).alias(role), own.alias(text),
                        F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of a conversation: counts of what was found, the cost and the edits in order.

    Chunks of a conversation come in the order of (_a, _b); `_parts` is their number. A deleted turn has no text.
    """
    kind = dict(turns.dtypes)[conv]
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text)}
    rows = turns.select(
        F.col(conv).alias("_conv"), F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("_c"),
        F.coalesce(F.floor(F.col(turn) / chunk), F.lit(-(1 << 62))).cast("bigint").alias("_a"),
        F.col(turn).cast("bigint").alias("_turn"), F.xxhash64(filled[role], filled[text]).alias("_h"),
        filled[role].alias("_role"), filled[text].alias("_text"))
    cells = materialize(rows.groupBy("_c", "_a").agg(F.count("*").alias("_n")), "cells")
    crowded = cells.where(F.col("_n") > 2 * chunk).select("_c", "_a", F.ceil(F.col("_n") / chunk).cast("bigint").alias("_shares"))
    several = cells.groupBy("_c").agg(F.count("*").alias("_k")).where("_k > 1").select("_c")

    run, schema = _prepared(kind)
    ready = rows.mapInArrow(run, schema)
    n = crowded.count()
    if n:   # many turns of one range of numbers: by number and share of the hashes
        share = F.floor((F.col("_h") / F.lit(2.0 ** 64) + 0.5) * F.col("_shares")).cast("bigint")
        own = F.coalesce(F.pmod(F.col("_turn"), F.lit(chunk)), F.lit(0)) * F.lit(1 << 40) + share
        ready = ready.join(F.broadcast(crowded) if n <= LISTED else crowded, ["_c", "_a"], "left").withColumn(
            "_b", F.coalesce(own, F.lit(0))).drop("_shares")
        several = several.union(crowded.select("_c")).distinct()
    else:
        ready = ready.withColumn("_b", F.lit(0).cast("bigint"))
    headers = _headers(ready, several) if n or several.limit(1).count() else None
    ready = ready.withColumn("_kind", F.lit(1))
    if headers is not None:
        ready = ready.unionByName(headers, allowMissingColumns=True)
    return _in_order(ready).mapInArrow(_repaired, (
        f"_conv {kind}, _c string, _a bigint, _b bigint, _parts bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)
        + f", first_initial string, last_initial string, edits {_EDIT_SQL}")).withColumnRenamed("_conv", conv)


def _headers(ready: DataFrame, several: DataFrame) -> DataFrame:
    """What a chunk of a long conversation must know of the others: entry, prices behind it, turns said before it."""
    key = ["_c", "_a", "_b"]
    slim = materialize(ready.join(several, "_c", "left_semi").drop("_conv", "_text").withColumn("_kind", F.lit(1)), "slim")
    said = slim.where(F.col("_fault") != BLANK).select(*key, "_digest").distinct()
    first = said.groupBy("_c", "_digest").agg(F.min(F.struct("_a", "_b")).alias("_first"), F.count("*").alias("_k"))
    seen = (said.join(first.where("_k > 1"), ["_c", "_digest"]).where(F.struct("_a", "_b") > F.col("_first"))
            .groupBy(*key).agg(F.collect_list("_digest").alias("_seen")))
    heads = slim.select(*key).distinct().join(seen, key, "left").withColumn("_kind", F.lit(0))
    heads = materialize(heads, "heads")

    def over(heads: DataFrame, fn, schema: str) -> DataFrame:
        return _in_order(slim.unionByName(heads, allowMissingColumns=True)).mapInArrow(fn, schema)

    def along(frame: DataFrame, fn, schema: str, down: bool) -> DataFrame:
        order = [F.col(c).desc() if down else F.col(c) for c in ("_a", "_b")]
        return frame.repartition("_c").sortWithinPartitions("_c", *order).mapInArrow(fn, schema)

    own = "_c string, _a bigint, _b bigint, "
    costs = over(heads, _transfers, own + "_costs array<bigint>")
    heads = materialize(heads.join(along(costs, _backwards, own + "_ending array<bigint>", True), key), "heads")
    exits = over(heads, _exits, own + "_exits array<int>")
    heads = heads.join(along(exits, _forwards, own + "_entry int", False), key)
    ends = heads.groupBy("_c").agg(F.count("*").alias("_parts"), F.max(F.struct("_a", "_b")).alias("_end"))
    heads = heads.join(ends, "_c").withColumn("_last", F.struct("_a", "_b") == F.col("_end")).drop("_end")
    return materialize(heads, "heads")


# ---------------------------------------------------------------- digests

def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its chunks in order."""
    conv, state = None, None
    out: list[tuple] = []

    def close() -> None:
        low, high = state["low"], state["high"]
        out.append((conv, 0 if low is None else high - low + 1 - state["turns"], *(state[c] for c in _SUMMED[1:]),
                    "".join(state["audit"]), state["sha"] or state["hash"].hexdigest()))

    def flushed() -> pa.RecordBatch:
        types = [pa.string(), *[pa.int64()] * len(_SUMMED), pa.string(), pa.string()]
        names = ["_c", "gaps", *_SUMMED[1:], "audit", "repaired_sha256"]
        columns = [pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for row in batch.to_pylist():
            if state is None or row["_c"] != conv:
                if state is not None:
                    close()
                conv = row["_c"]
                state = dict.fromkeys(_SUMMED, 0) | {"low": None, "high": None, "last": None, "audit": [], "sha": None,
                                                     "hash": hashlib.sha256(), "any": False}
            for c in _SUMMED:
                state[c] += row[c]
            if row["first_turn"] is not None:
                state["turns"] -= state["high"] == row["first_turn"]
                state["low"] = row["first_turn"] if state["low"] is None else state["low"]
                state["high"] = row["last_turn"]
            if state["last"] is not None:
                state["illegal"] += state["last"] + row["first_initial"] not in _GOOD
            state["last"] = row["last_initial"]
            state["audit"].append(row["audit"])
            if row["_parts"] == 1:
                state["sha"] = row["_sha"]
            elif row["_piece"]:
                state["hash"].update((("\n" if state["any"] else "") + row["_piece"]).encode())
                state["any"] = True
        if out:
            yield flushed()
    if state is not None:
        close()
        yield flushed()


_SUMMED = ("turns", "blank", "duplicate", "truncated", "illegal", "cost")


def digests(repaired: DataFrame, original: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation of `original`, from the chunks that `repair` gave.

    A conversation of one chunk is digested where it is; only the texts of longer ones meet in order, and stream. A digest of
    all its text is by definition one pass, whatever the length.
    """
    stays = F.filter("edits", lambda e: e["action"] != "delete")
    text = F.array_join(F.transform(stays, lambda e: F.concat(e["role"], F.lit(":"), e["text"])), "\n")
    letter = F.transform("edits", lambda e: F.repeat(F.upper(F.substring(e["action"], 1, 1)), e["times"].cast("int")))
    one = F.col("_parts") == 1
    pieces = repaired.select(
        "_c", "_a", "_b", "_parts", *[c for c in _COUNTS if c != "rows"], "first_initial", "last_initial",
        F.array_join(letter, "").alias("audit"), F.when(one, F.sha2(text, 256)).alias("_sha"), F.when(~one, text).alias("_piece"))
    whole = pieces.repartition("_c").sortWithinPartitions("_c", "_a", "_b").mapInArrow(_whole, (
        "_c string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
        "audit string, repaired_sha256 string"))
    ids = original.select(conv).distinct().withColumn(
        "_c", F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")))
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(whole, "_c", "left").select(
        conv, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in zero],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def sql() -> str:
    """DuckDB SQL for the digests of the damaged `conversations`: cheapest edits per state, turn by turn, as text cost + letters."""
    def add(cost: str, letter: str, state: str) -> str:
        return f"lpad(cast(cast({state}[1:9] as bigint) + {cost} as varchar), 9, '0') || {state}[10:] || '{letter}'"

    def when(initial: str, state: str) -> str:
        return f"case when fault < 2 and initial = '{initial}' then {add('more', 'K', state)} end"

    def named(state: str) -> str:
        return f"case when fault < 2 then {add('3 + more', 'R', state)} end"

    return rf"""
with recursive filled as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
hashed as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, 8 * strlen(k)),
      lambda i: ((ord(k[i // 8 + 1]) >> (i % 8)) & 1)::bigint)),
    lambda c, b: xor(c >> 1, case when (xor(c, b) & 1) = 1 then 3988292384 else 0 end)), 4294967295) % 20 as d from filled),
damaged as (
  select conv_id, turn, case when d = 4 then 'user' else role end as role,
    case when d = 1 then '' when d = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from hashed, range(0, 2) as copies(c) where d <> 0 and (c = 0 or d = 3)),
ordered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as n, role[1:1] as initial from damaged),
judged as (
  select *, case when not regexp_matches(text, '[^ 	-
]') then 3
      when row_number() over (partition by conv_id, role, text order by n) > 1 then 2
      when not regexp_matches(text, '[.!?][ 	-
]*$') then 1 else 0 end as fault,
    lag(initial) over (partition by conv_id order by n) || initial as pair from ordered),
facts as (
  select conv_id, count(*) as n_rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 3) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 1) as truncated,
    count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal from judged group by conv_id),
walk as (
  select conv_id, n_rows, 0::bigint as n, repeat('0', 9) as x0, null::varchar as x1, null::varchar as x2, null::varchar as x3,
    repeat('0', 8) || '3I' as y2, repeat('0', 8) || '6II' as y3 from facts
  union all
  select conv_id, n_rows, n, x0, x1, x2, x3, y2, least(x3, {add('3', 'I', 'y2')}) as y3 from (
    select *, least(x2, {add('3', 'I', 'x0')}, {add('3', 'I', 'x1')}, {add('3', 'I', 'x3')}) as y2 from (
      select conv_id, n_rows, n, {add('4', 'D', 'x0')} as x0,
        least({add('4', 'D', 'x1')}, {when('s', 'x0')}) as x1,
        least({add('4', 'D', 'y2')}, {when('u', 'x0')}, {when('u', 'x1')}, {when('u', 'y3')},
              {named('x0')}, {named('x1')}, {named('y3')}) as x2,
        least({add('4', 'D', 'y3')}, {when('a', 'y2')}, {named('y2')}) as x3
      from (select w.conv_id, w.n_rows, j.n, w.x0, w.x1, w.y2, w.y3, j.fault, j.initial,
              case when j.fault = 1 then 3 else 0 end as more
            from walk w join judged j on j.conv_id is not distinct from w.conv_id and j.n = w.n + 1) as step) as took) as closed),
best as (select conv_id, least(x0, y3) as found from walk where n = n_rows),
letters as (
  select conv_id, found, place, found[9 + place: 9 + place] as letter
  from best, lateral (select unnest(range(1, length(found) - 8)) as place) as places),
placed as (
  select *, count(*) filter (letter <> 'I') over w as n, count(*) filter (letter <> 'D') over w as m
  from letters window w as (partition by conv_id order by place)),
spoken as (
  select p.conv_id, p.place, p.letter, p.m, j.role, j.text,
    max(case when p.m = 1 and p.letter = 'K' and j.initial = 's' then 1 else 0 end) over (partition by p.conv_id) as system
  from placed p left join judged j on j.conv_id is not distinct from p.conv_id and j.n = p.n and p.letter <> 'I'
  where p.letter <> 'D'),
said as (
  select conv_id, string_agg(case when letter = 'K' then role when (m - system) % 2 = 1 then 'user' else 'assistant' end
    || ':' || case when letter = 'I' then '' else text end, chr(10) order by place) as repaired from spoken group by conv_id)
select c.conv_id, coalesce(f.gaps, 0)::bigint as gaps, coalesce(f.blank, 0)::bigint as blank,
  coalesce(f.duplicate, 0)::bigint as duplicate, coalesce(f.truncated, 0)::bigint as truncated,
  coalesce(f.illegal, 0)::bigint as illegal, coalesce(cast(b.found[1:9] as bigint), 0) as cost,
  coalesce(b.found[10:], '') as audit, sha256(coalesce(s.repaired, '')) as repaired_sha256
from (select distinct conv_id from conversations) c
left join facts f on f.conv_id is not distinct from c.conv_id
left join best b on b.conv_id is not distinct from c.conv_id
left join said s on s.conv_id is not distinct from c.conv_id"""
