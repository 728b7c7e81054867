"""Toxicity scores from a lexicon with misspellings and the words around each hit.

The lexicon is a trie of terms, whole words or stems that may go on, learned from labelled rows (and given ones). Each
term tolerates a number of edits by its length. The Levenshtein automata of all terms are intersected with the trie once,
by a subset construction over (trie node, edits) pairs, and give one table of transitions: a word is read in one pass, most
words leave the table after two or three letters, and all words of a block are read side by side.

Every hit is scored in its context window: a hit inside quotation marks or after a word of reporting
counts little, one beside a word of address counts more, a misspelled one less than an exact one. A logistic model over the sum, the
densest window, the density and the share of quoted hits turns this into a probability.

Learning reads a bounded sample: at most about SAMPLE_ROWS labelled rows of at most SAMPLE_CHARS characters, by hash of
the id over all labels. A term must occur in many *different* surroundings in toxic texts, so that copies of one text
do not make its words toxic; purity alone decides how many terms there are. Stems have STEM letters, and open ones tolerate no edits.
Each form of a stem is evidence of its own; the n-th time of the same word counts 1 / n. Scoring reads every text in full.

Defined results: an empty or null text has no hits and scores as such; without labelled rows of both kinds only given
terms count, and a fixed model is used; a null label is no label, repeated labels of an id count as toxic if one is; rows
that repeat an id, or have none, are scored each; a very long text is a block of its own; extra columns do not matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays

SAMPLE_ROWS = 12_000
SAMPLE_CHARS = 20_000
SURROUNDINGS = 10        # different ones a learned term needs
PURITY = 0.15            # share of clean texts with the term, against that of toxic texts, at most
SURE = 0.01              # at and below this a term counts in full
STEM = (4, 10)           # lengths of stems
WINDOW = 10              # words on either side
_RUNS = re.compile(r"[^\W_]+")
_MARKS = "\"“”„«»"
_REPORT = frozenset("said says say called calls call wrote writes quote quoted quotes word words term phrase dit sagte nannte dijo".split())
_ADDRESS = frozenset("you your youre ur u tu toi vous du dich dir ihr euch ti te usted".split())
FEATURES = 4


@dataclass(frozen=True)
class Term:
    text: str
    open: bool   # a stem: anything may follow
    edits: int
    weight: float = 1.0


def allowance(text: str, open_: bool) -> int:
    """Edits tolerated: short terms and stems none, since too many words lie close to them."""
    return 0 if open_ or len(text) < 5 else 1 if len(text) < 9 else 2


class Automaton:
    """All Levenshtein automata of the terms, intersected with their trie, as one table of transitions."""

    def __init__(self, terms: Iterable[Term]):
        self.terms = sorted(set(terms), key=lambda t: (t.text, t.open))
        letters = sorted({c for t in self.terms for c in t.text})
        self.letters = {c: i + 1 for i, c in enumerate(letters)}
        self.other = len(letters) + 1
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        most = [0]
        for i, term in enumerate(self.terms):
            node = 0
            most[0] = max(most[0], term.edits)
            for c in term.text:
                nxt = children[node].get(self.letters[c])
                if nxt is None:
                    nxt = len(children)
                    children[node][self.letters[c]] = nxt
                    children.append({})
                    ends.append([])
                    most.append(0)
                node = nxt
                most[node] = max(most[node], term.edits)
            ends[node].append(i)

        def closed(pairs: Iterable[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            """With letters left out, fewest edits per node; a negative node is a stem that has been read."""
            best: dict[int, int] = {}
            todo = list(pairs)
            while todo:
                node, e = todo.pop()
                if e > (most[node] if node >= 0 else 9) or best.get(node, 99) <= e:
                    continue
                best[node] = e
                if node >= 0:
                    todo += [(child, e + 1) for child in children[node].values()]
                    todo += [(-1 - t, e) for t in ends[node] if self.terms[t].open and e <= self.terms[t].edits]
            return frozenset(best.items())

        def step(state: frozenset[tuple[int, int]], letter: int) -> frozenset[tuple[int, int]]:
            out = []
            for node, e in state:
                out.append((node, e if node < 0 else e + 1))  # one letter too many
                if node >= 0:
                    out += [(child, e + (c != letter)) for c, child in children[node].items()]
            return closed(out)

        begin = closed([(0, 0)])
        numbers = {frozenset(): 0, begin: 1}
        rows, queue = [[0] * (self.other + 1)], [begin]
        while queue:
            state = queue.pop(0)
            row = [0]
            for letter in range(1, self.other + 1):
                nxt = step(state, letter)
                if nxt not in numbers:
                    numbers[nxt] = len(numbers)
                    queue.append(nxt)
                row.append(numbers[nxt])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.term = np.full(len(numbers), -1, np.int32)
        self.edits = np.zeros(len(numbers), np.int32)
        for state, number in numbers.items():
            found = [(e, t) for node, e in state if node >= 0 for t in ends[node] if e <= self.terms[t].edits]
            found += [(e, -1 - node) for node, e in state if node < 0]
            if found:
                self.edits[number], self.term[number] = min(found)
        self._classes: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_classes": None}

    def classes(self) -> np.ndarray:
        """Letter number of every code point, 0 outside words; made once per worker."""
        if self._classes is None:
            table = np.zeros(0x110000, np.int16)
            for code in range(0x20000):
                c = chr(code)
                if c.isalnum():
                    table[code] = self.letters.get(c.lower(), self.other)
            table[0x20000:0x323B0] = self.other
            self._classes = table
        return self._classes

    def read(self, cls: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of words, states they end in) of the words that are within the edits of a term."""
        live, state, place = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
        hits: list[np.ndarray] = []
        states: list[np.ndarray] = []
        padded = np.concatenate([cls, [0]])
        while len(live):
            letter = padded[place]
            over = letter == 0
            done = over & (self.term[state] >= 0)
            if done.any():
                hits.append(live[done])
                states.append(state[done])
            state = self.table[state, letter]
            keep = ~over & (state > 0)
            live, state, place = live[keep], state[keep], place[keep] + 1
        if not hits:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        words, ended = np.concatenate(hits), np.concatenate(states)
        order = np.argsort(words)
        return words[order], ended[order]


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, 3.0, 1.5, 1.0, -2.0]))

    def features(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, hits and quoted hits of every text."""
        data, offsets = arrays.buffers(column)
        n = len(offsets) - 1
        out, hits, quoted = np.zeros((n, FEATURES)), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for first, last in arrays.blocks(offsets):
            raw = data[offsets[first]: offsets[last]]
            codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
            begins = np.flatnonzero((raw & 0xC0) != 0x80)
            ends = np.searchsorted(begins, offsets[first: last + 1] - offsets[first])
            self._block(codes, ends, out[first: last], hits[first: last], quoted[first: last])
        return out, hits, quoted

    def _block(self, codes: np.ndarray, bounds: np.ndarray, out: np.ndarray, hits: np.ndarray, quoted: np.ndarray) -> None:
        inside = self.automaton.classes()[codes]
        filled = bounds[:-1] < bounds[1:]
        # a gap between texts, so that no word runs on into the next text
        gaps = np.arange(len(bounds) - 1)
        document = np.repeat(gaps, np.diff(bounds))
        cls = np.zeros(len(codes) + len(gaps), np.int16)
        cls[np.arange(len(codes)) + document] = inside
        is_word = cls > 0
        opens = is_word.copy()
        opens[1:] &= ~is_word[:-1]
        starts = np.flatnonzero(opens)
        closes = is_word.copy()
        closes[:-1] &= ~is_word[1:]
        ends = np.flatnonzero(closes) + 1
        first_word = np.searchsorted(starts, bounds[:-1] + gaps)
        n_words = np.diff(np.append(first_word, len(starts)))
        words, states = self.automaton.read(cls, starts)
        if not len(words):
            return
        marks = np.flatnonzero(np.isin(codes, [ord(c) for c in _MARKS]))
        owner = np.searchsorted(bounds + np.arange(len(bounds)), starts[words], "right") - 1
        for d in np.unique(owner[filled[owner]]).tolist():
            own = np.flatnonzero(owner == d)
            text_start, text_end = int(bounds[d]), int(bounds[d + 1])
            held = 0
            values = np.empty(len(own))
            again: Counter = Counter()
            places = words[own] - first_word[d]
            for j, k in enumerate(own.tolist()):
                at = int(starts[words[k]]) - d
                before = bytes(codes[max(text_start, at - 60): at].tobytes()).decode("utf-32-le").lower().split()[-6:]
                after = bytes(codes[at: min(text_end, at + 60)].tobytes()).decode("utf-32-le").lower().split()[1:4]
                n_marks = np.searchsorted(marks, at) - np.searchsorted(marks, text_start)
                follow = np.searchsorted(marks, text_end) - np.searchsorted(marks, at)
                told = (n_marks % 2 == 1 and follow > 0) or not _REPORT.isdisjoint(w.strip(".,:;!?\"'") for w in before)
                addressed = not _ADDRESS.isdisjoint(w.strip(".,:;!?\"'") for w in before[-3:] + after)
                edits = int(self.automaton.edits[states[k]])
                term = int(self.automaton.term[states[k]])
                word = codes[at: int(ends[words[k]]) - d].tobytes()
                again[word] += 1  # a repeated line is no new evidence: the n-th time of a word counts 1 / n
                weight = self.automaton.terms[term].weight / again[word]
                value = weight * (1.0, 0.5, 0.3)[min(edits, 2)] * (0.25 if told else 1.0) * (1.5 if addressed else 1.0)
                values[j] = value
                held += told
            sums = np.concatenate([[0.0], np.cumsum(values)])
            near = sums[np.searchsorted(places, places + WINDOW, "right")] - sums[np.searchsorted(places, places - WINDOW)]
            out[d] = (np.log1p(values.sum()), np.log1p(near.max()),
                      min(1.0, 20.0 * values.sum() / max(1, int(n_words[d]))), held / len(own))
            hits[d], quoted[d] = len(own), held

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.weights[0] + features @ self.weights[1:]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


# ---------------------------------------------------------------- learning

def _words(text: str) -> list[str]:
    """Runs of letters and digits, as scoring reads them."""
    return _RUNS.findall(text.lower())


def _pieces(word: str) -> list[str]:
    """The word itself, and its stems, marked with a star."""
    return [word, *[word[:n] + "*" for n in range(STEM[0], min(STEM[1], len(word)) + 1)]] if len(word) >= 4 else []


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[str, set[int]] = defaultdict(set)
        for text in batch.column("text").to_pylist():
            words = ["", *_words(text or ""), ""]
            for i in range(1, len(words) - 1):
                around = hash_pair(words[i - 1], words[i + 1])
                for piece in _pieces(words[i]):
                    found[piece].add(around)
        pairs = [(p, a) for p, own in found.items() for a in own]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for p, _ in pairs], pa.string()),
                                          "around": pa.array([a for _, a in pairs], pa.int64())})


def hash_pair(a: str, b: str) -> int:
    import zlib

    return zlib.crc32(a.encode()) << 31 | zlib.crc32(b.encode()) >> 1


def _count_texts(pieces: frozenset[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                own = {p for w in set(_words(text or "")) for p in _pieces(w)}
                seen.update((p, toxic) for p in own & pieces)
            yield pa.RecordBatch.from_pydict({
                "piece": pa.array([p for p, _ in seen], pa.string()), "toxic": pa.array([t for _, t in seen], pa.int32()),
                "n": pa.array(list(seen.values()), pa.int64())})

    return count


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> list[Term]:
    """Terms from {piece: (toxic texts, clean texts)}: pure pieces, each family by its longest stem that keeps it whole."""
    impure = {p: (b / max(1, clean)) / (a / max(1, toxic)) for p, (a, b) in counts.items() if a}
    pure = {p: counts[p][0] for p, x in impure.items() if x <= PURITY}
    out: list[tuple[int, Term]] = []
    taken: list[str] = []
    for piece in sorted((p for p in pure if p.endswith("*")), key=lambda p: (len(p), p)):
        stem = piece[:-1]
        if any(stem.startswith(t) for t in taken):
            continue
        taken.append(stem)
        while True:  # the longest continuation that loses next to nothing
            longer = [p for p in pure if p.endswith("*") and len(p) == len(stem) + 2 and p.startswith(stem)
                      and pure[p] >= 0.95 * pure[piece]]
            if not longer:
                break
            stem = longer[0][:-1]
        open_ = pure.get(stem, 0) < 0.95 * pure[stem + "*"]
        weight = min(1.0, math.log(max(impure[stem + "*"], 1e-9)) / math.log(SURE))
        out.append((pure[piece], Term(stem, open_, allowance(stem, open_), weight)))
    return [t for _, t in sorted(out, key=lambda x: (-x[0], x[1].text))]


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Weights with the constant first, by Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        terms: Iterable[str] = (), rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and weights from the labelled rows given."""
    given = [Term(t.lower(), False, allowance(t, False)) for t in terms]
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_id"))
             .agg(F.max(F.col(label).cast("int")).alias("toxic")))
    share = min(1.0, rows / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) / F.lit(1_000_000.0) < share)
    # about `rows` ids by the line above, whatever the input: safe to broadcast
    texts = docs.where(F.length(text) <= SAMPLE_CHARS).select(F.col(key).alias("_id"), F.col(text).alias("text")).join(
        F.broadcast(drawn), "_id").select("text", "toxic")

    around = (texts.where("toxic = 1").select("text").mapInArrow(_surroundings, "piece string, around bigint").distinct()
              .groupBy("piece").count().where(F.col("count") >= SURROUNDINGS))
    pieces = frozenset(r["piece"] for r in around.collect())
    learned: list[Term] = []
    if pieces:
        counted: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for r in (texts.mapInArrow(_count_texts(pieces), "piece string, toxic int, n bigint")
                  .groupBy("piece", "toxic").agg(F.sum("n").alias("n")).collect()):
            counted[r["piece"]][1 - r["toxic"]] += r["n"]
        totals = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
        learned = choose_terms({p: (a, b) for p, (a, b) in counted.items()}, totals.get(1, 0), totals.get(0, 0))
    model = Model(Automaton([*given, *learned]))

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for batch in batches:
            values = shared.value.features(batch.column("text"))[0]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *[pa.array(values[:, j]) for j in range(FEATURES)]],
                                             ["toxic", *[f"x{j}" for j in range(FEATURES)]])

    seen = texts.mapInArrow(measure, "toxic int, " + ", ".join(f"x{j} double" for j in range(FEATURES))).toPandas()
    shared.unpersist()
    if seen["toxic"].nunique() == 2:
        model.weights = _logistic(seen[[f"x{j}" for j in range(FEATURES)]].to_numpy(), seen["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, score, n_hits, n_quoted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            values, hits, quoted = shared.value.features(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(shared.value.score(values)), pa.array(hits),
                                              pa.array(quoted)], ["_id", "score", "n_hits", "n_quoted"])

    kind = dict(docs.dtypes)[key]
    return (docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
            .mapInArrow(run, f"_id {kind}, score double, n_hits bigint, n_quoted bigint").withColumnRenamed("_id", key))
