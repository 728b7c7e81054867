"""Chat formatting: the cheapest repair of turn roles, then rendering.

A conversation must follow an automaton: an optional system message, then user and assistant in turn, where an assistant may
call a tool that answers it. Its states are the role of the last message. A turn may be kept, relabelled, or merged into the
message before it, and empty messages may be inserted; each has a cost, and dynamic programming over the automaton finds the
cheapest sequence. Ties are settled by fixed preference: fewer insertions, then keep, merge, relabel, relabel and merge.

The cost of consuming a turn is a small matrix over states, and matrices compose, so a conversation of any length is cut
into chunks of about CHUNK turns: each chunk's matrix is computed by itself, the chain of matrices of one conversation fixes the
state at every border, and each chunk is then repaired between its two border states. A conversation that holds a third
of all turns is spread over its chunks; only one 5 x 5 matrix per chunk meets in one task.

The result has one row per repaired turn. Concatenating `rendered` in the order of (part, step) gives the rendered conversation.

Defined results: turns are ordered by number (null last), then by a hash of role and text, role and text; every row is a
turn of its own, however often it is repeated, and the automaton merges repeats; roles are compared in lower case without blanks around, any other or null role
is unknown and must be relabelled, at a lower cost; a null text is empty; a null conversation id is a conversation of its
own; an empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

CHUNK = 4096
ROLES = ("", "system", "user", "assistant", "tool")   # states: the role of the last message, "" before any
#: which messages may follow
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2, 4), 4: (3,)}
FINAL = (2, 3)
INSERT, MERGE, RELABEL, NAME_UNKNOWN = 2, 1, 3, 1
UNKNOWN = 0
_ACTIONS = ("keep", "merge", "relabel", "relabel_merge")


@cache
def _insertions(state: int) -> dict[int, tuple[int, tuple[int, ...]]]:
    """Cheapest empty messages from a state to every state: (cost, roles)."""
    best: dict[int, tuple[int, tuple[int, ...]]] = {}
    queue: list[tuple[int, tuple[int, ...], int]] = [(0, (), state)]
    while queue:
        cost, path, at = heapq.heappop(queue)
        if at in best:
            continue
        best[at] = (cost, path)
        for role in LEGAL[at]:
            heapq.heappush(queue, (cost + INSERT, (*path, role), role))
    return best


@cache
def _moves(role: int) -> dict[tuple[int, int], tuple[int, int, int, tuple[int, ...]]]:
    """(state, state after a turn of this role): (cost, insertions, action, inserted roles), the preferred one."""
    best: dict[tuple[int, int], tuple[int, int, int, tuple[int, ...]]] = {}
    change = NAME_UNKNOWN if role == UNKNOWN else RELABEL
    for state in range(len(ROLES)):
        for at, (cost, path) in _insertions(state).items():
            options = [(to, 0 if to == role else change, 0 if to == role else 2) for to in LEGAL[at]]
            if at:
                options.append((at, MERGE + (0 if at == role else change), 1 if at == role else 3))
            for to, extra, action in options:
                move = (cost + extra, len(path), action, path)
                if (state, to) not in best or move < best[state, to]:
                    best[state, to] = move
    return best


@cache
def _costs(role: int) -> np.ndarray:
    """Cost from each state to each state over one turn."""
    out = np.full((len(ROLES), len(ROLES)), np.inf)
    for (a, b), move in _moves(role).items():
        out[a, b] = move[0]
    return out


def transfer(roles: list[int]) -> np.ndarray:
    """Cost from each state to each state over all the given turns."""
    total = np.where(np.eye(len(ROLES)) > 0, 0.0, np.inf)
    for role in roles:
        total = (total[:, :, None] + _costs(role)[None, :, :]).min(axis=1)
    return total


def _ending() -> np.ndarray:
    """Cost of the insertions that end a conversation, from each state."""
    return np.array([min(_insertions(s)[f][0] for f in FINAL) for s in range(len(ROLES))], float)


def repair(roles: list[int], entry: int = 0, leave: int | None = None) -> list[tuple[int, str, int, int]]:
    """The cheapest repair: (turn or -1, action, role, cost) in order.

    Without `leave` the conversation ends here, and messages may be inserted after the last turn.
    """
    costs = [np.where(np.arange(len(ROLES)) == entry, 0.0, np.inf)]
    for role in roles:
        costs.append((costs[-1][:, None] + _costs(role)).min(axis=0))
    tail: tuple[int, ...] = ()
    if leave is None:
        leave = int(np.argmin(costs[-1] + _ending()))
        tail = min((_insertions(leave)[f] for f in FINAL))[1]
    path, state = [], leave
    for i in range(len(roles) - 1, -1, -1):
        moves = _moves(roles[i])
        _, _, move, before = min(
            (costs[i][a] + moves[a, state][0], moves[a, state][1:], moves[a, state], a)
            for a in range(len(ROLES)) if (a, state) in moves)
        path.append((i, move, state))
        state = before
    out = []
    for i, (cost, n, action, inserted), role in reversed(path):
        out += [(-1, "insert", r, INSERT) for r in inserted]
        out.append((i, _ACTIONS[action], role, cost - n * INSERT))
    return out + [(-1, "insert", r, INSERT) for r in tail]


def render(steps: list[tuple[int, str, int, int]], texts: list[str], first: bool, last: bool) -> list[str]:
    """Text of each step; a message is `<|role|>`, its texts, `<|end|>`."""
    out = []
    for n, (turn, action, role, _) in enumerate(steps):
        text = texts[turn] if turn >= 0 else ""
        if action in ("merge", "relabel_merge"):
            out.append("\n" + text)
        else:
            out.append(("" if first and n == 0 else "<|end|>\n") + f"<|{ROLES[role]}|>\n" + text)
    if last and out:
        out[-1] += "<|end|>\n"
    return out


# ---------------------------------------------------------------- on Spark

def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole (conversation, chunk) groups of a sorted partition."""
    held: list[pd.DataFrame] = []
    key = None
    for pdf in batches:
        if not len(pdf):
            continue
        keys = (pdf["_c"] + "\x00" + pdf["_chunk"]).to_numpy(object)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for a, b in zip(cuts, [*cuts[1:], len(pdf)], strict=True):
            own = keys[a]
            if key is not None and own != key:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            key = own
            held.append(pdf.iloc[a:b])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """Each row as often as it was given."""
    times = group["_times"].to_numpy()
    return group if (times == 1).all() else group.iloc[np.repeat(np.arange(len(group)), times)]


def _transfers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for group in _groups(batches):
        yield pd.DataFrame({"_c": [group["_c"].iloc[0]], "_chunk": [group["_chunk"].iloc[0]],
                            "costs": [transfer(_repeated(group)["_role"].tolist()).ravel().tolist()]})


def _borders(pdf: pd.DataFrame) -> pd.DataFrame:
    """States before and after each chunk of a conversation, from the chain of its matrices."""
    pdf = pdf.sort_values("_chunk")
    matrices = [np.array(x).reshape(len(ROLES), -1) for x in pdf["costs"]]
    costs = [np.where(np.arange(len(ROLES)) == 0, 0.0, np.inf)]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    state = int(np.argmin(costs[-1] + _ending()))
    states = [state]
    for before, m in zip(reversed(costs[:-1]), reversed(matrices), strict=True):
        state = int(np.argmin(before + m[:, state]))
        states.append(state)
    states.reverse()
    n = len(pdf)
    return pd.DataFrame({"_c": pdf["_c"].to_numpy(), "_chunk": pdf["_chunk"].to_numpy(), "entry": states[:-1],
                         "leave": states[1:], "last": [i == n - 1 for i in range(n)]})


_COLUMNS = ("_conv", "part", "step", "turn", "action", "role", "cost", "rendered")
_FLUSH = 4000  # output rows a frame


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    for group in _groups(batches):
        convs, chunks, roles, turns, texts, entries, leaves, lasts = (
            _repeated(group)[c].tolist() for c in ("_conv", "_chunk", "_role", "_turn", "_text", "entry", "leave", "last"))
        alone = pd.isna(entries[0])
        entry = 0 if alone else int(entries[0])
        last = alone or bool(lasts[0])
        steps = repair(roles, entry, None if last else int(leaves[0]))
        for n, ((turn, action, role, cost), text) in enumerate(zip(steps, render(steps, texts, entry == 0, last), strict=True)):
            number = None if turn < 0 or pd.isna(turns[turn]) else int(turns[turn])
            rows.append((convs[0], chunks[0], n, number, action, ROLES[role], cost, text))
        if len(rows) >= _FLUSH:
            yield _frame(rows)
            rows = []
    if rows:
        yield _frame(rows)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = dict(zip(_COLUMNS, map(list, zip(*rows, strict=True)), strict=True))
    return pd.DataFrame(columns | {"turn": pd.array(columns["turn"], "Int64")})


def _in_order(rows: DataFrame) -> DataFrame:
    order = ["_c", "_chunk", F.asc_nulls_last("_turn"), "_h", F.asc_nulls_last("_as"), F.asc_nulls_last("_text")]
    return rows.repartition("_c", "_chunk").sortWithinPartitions(*order)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 chunk: int = CHUNK) -> DataFrame:
    """One row per repaired turn: conv, part, step, turn, action, role, cost, rendered."""
    as_ = F.lower(F.trim(F.col(role)))
    known = F.coalesce(*[F.when(as_ == name, i) for i, name in enumerate(ROLES) if i], F.lit(UNKNOWN))
    rows = turns.select(
        F.col(conv).alias("_conv"), F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("_c"),
        F.col(turn).cast("bigint").alias("_turn"), as_.alias("_as"), known.alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"), F.col(role).alias("_raw"), F.col(text).isNull().alias("_none"))
    # equal rows travel as one with their number; they are interchangeable
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_times")).drop("_raw", "_none")
    rows = rows.withColumn("_h", F.xxhash64("_as", "_text"))
    # chunks sort as text: range of turn numbers (null last); in a crowded range also the number and a share of the hashes
    wide = F.when(F.col("_turn").isNull(), "z").otherwise(F.concat(
        F.when(F.col("_turn") < 0, "a").otherwise("b"),
        F.lpad((F.floor(F.col("_turn") / chunk) + F.when(F.col("_turn") < 0, F.lit(1 << 53)).otherwise(0)).cast("string"), 17, "0")))
    rows = materialize(rows.withColumn("_range", wide), "turns")
    sizes = rows.groupBy("_c", "_range").agg(F.sum("_times").alias("_n"))
    crowded = sizes.where(F.col("_n") > 2 * chunk).withColumn("_shares", F.ceil(F.col("_n") / chunk).cast("bigint")).drop("_n")
    share = F.floor((F.col("_h") / F.lit(2.0 ** 64) + 0.5) * F.col("_shares")).cast("bigint")
    number = F.coalesce(F.pmod(F.col("_turn"), F.lit(chunk)), F.lit(0))
    fine = F.concat_ws("/", "_range", F.lpad(number.cast("string"), 9, "0"), F.lpad(share.cast("string"), 12, "0"))
    rows = rows.join(crowded, ["_c", "_range"], "left").withColumn(
        "_chunk", F.when(F.col("_shares").isNotNull(), fine).otherwise(F.col("_range")))
    # a row given more than a chunk's times stands in chunks of its own, after its share's rows before it and before those after it
    often = (F.col("_times") > chunk) & F.col("_shares").isNotNull()
    hashes = rows.where(often).groupBy("_c", "_chunk").agg(F.collect_set("_h").alias("_often"))
    below = F.size(F.filter("_often", lambda x: x < F.col("_h"))) * 2 + F.array_contains("_often", F.col("_h")).cast("int")
    pieces = F.ceil(F.col("_times") / chunk).cast("bigint")
    rows = rows.join(hashes, ["_c", "_chunk"], "left").select(
        "*", F.explode(F.when(often, F.sequence(F.lit(0).cast("bigint"), pieces - 1)).otherwise(
            F.array(F.lit(0).cast("bigint")))).alias("_piece"))
    rows = rows.withColumns({
        "_chunk": F.when(F.col("_often").isNull(), F.col("_chunk")).otherwise(F.concat_ws(
            "/", "_chunk", F.lpad(below.cast("string"), 9, "0"), F.lpad(F.col("_piece").cast("string"), 12, "0"))),
        "_times": F.when(often, F.least(F.lit(chunk), F.col("_times") - F.col("_piece") * chunk)).otherwise(F.col("_times")),
    }).drop("_shares", "_range", "_often", "_piece")

    several = rows.select("_c", "_chunk").distinct().groupBy("_c").count().where("count > 1").select("_c")
    slim = rows.select("_c", "_chunk", "_turn", "_h", "_as", "_role", "_times", F.lit("").alias("_text")).join(several, "_c", "left_semi")
    borders = (_in_order(slim).mapInPandas(_transfers, "_c string, _chunk string, costs array<double>")
               .groupBy("_c").applyInPandas(_borders, "_c string, _chunk string, entry int, leave int, last boolean"))
    kind = dict(turns.dtypes)[conv]
    schema = (f"_conv {kind}, part string, step bigint, turn bigint, action string, role string, cost bigint, rendered string")
    return (_in_order(rows.join(borders, ["_c", "_chunk"], "left")).mapInPandas(_repaired, schema)
            .withColumnRenamed("_conv", conv))
