"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its inverse as a state machine.

Merges are applied lowest rank first, so what follows a place can change tokens before it, but only so far. Take
two runs over texts that agree up to a place. Their tokens agree up to some boundary, and that boundary moves left only
when one run merges the last common token u with the token v that starts there: by |u|, through a rule (u, v). The
next such rule (u', v') has a higher rank, and its v' is u or has grown from u by later rules. So the boundary moves at
most as far as the heaviest such chain of rules, each weighing |u|. `lookahead` finds it in one pass over the merge
list (145 symbols for the vocabulary of the query, 129 for a byte-level one of 50,000).

The transducer therefore keeps a window of symbols. Whenever it is full, the window is merged and the tokens that end
`lookahead` symbols before its end are emitted: nothing that follows can change them. The rest stays, and since
no merge crosses a final boundary, encoding goes on from there. The window has a fixed size, so a word of any length is
encoded in constant memory. Words shorter than the window are merged once, and frequent short pieces are looked up.

Texts run through the normaliser and the splitting rule of the vocabulary file, which the tokenizers library
applies; both act between ASCII blanks independently, and a longer stretch without a blank is fed in blocks that end where neither
can tell. The vocabulary must drop white space (checked when it is loaded).

Decoding maps each id to its bytes and an incremental UTF-8 machine turns them into text, block by block; its state is
the bytes of an unfinished character and whether anything was emitted yet.

Defined results: a null or empty text has no ids and decodes to an empty text; null keys and repeated rows are
encoded like any other row; special tokens inside a text are their ids; ids outside the vocabulary decode to
nothing; an empty table gives an empty result; extra columns do not matter, the key may have any type.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

KEPT_PIECES = 350_000   # pieces whose ids a worker keeps
KEPT_LENGTH = 32
LONG = 4096             # characters without a blank that are encoded at once
STRIDE = 1 << 16        # characters of text, or ids, handled at once
SCANNED = 40            # symbols up to which merges are found by scanning

_BLANK = " "
_NO_RULE = 1 << 30
_PLAIN = "\u024f"       # up to here letters are composed, and their lower case is one letter or no letter at all


def lookahead(merges: Iterable[tuple[str, str]], end: str = "") -> int:
    """Symbols after a token that suffice to settle it, for merges in order of rank.

    Raises if a rule uses a token before the rule that makes it, or makes one twice: the argument needs both.
    """
    def size(token: str) -> int:
        return len(token.removesuffix(end)) if end else len(token)

    chain: dict[str, int] = {}   # heaviest chain whose last rule has this left side
    grown: dict[str, int] = {}   # the same over the tokens this one has grown from, up to the rule that extended each
    made: set[str] = set()
    most = 0
    for left, right in merges:
        if any(size(x) > 1 and x not in made for x in (left, right)) or left + right in made:
            raise ValueError("merges are not in the order in which they were learned")
        weight = size(left) + max(chain.get(right, 0), grown.get(right, 0))
        chain[left] = max(chain.get(left, 0), weight)
        grown[left + right] = max(chain[left], grown.get(left, 0))
        made.add(left + right)
        most = max(most, weight)
    return most


class Merges:
    """The merge list of a vocabulary over ids of symbols."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in (
                "dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("a plain byte-pair vocabulary is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.lookahead = lookahead(pairs, self.end)
        self.ranks = {(self.ids[a], self.ids[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.sizes = {i: len(t.removesuffix(self.end)) if self.end else len(t) for t, i in self.ids.items()}

    def symbols(self, letters: str, ends: bool) -> list[int]:
        """Ids of single letters; the last one of a word has its own symbol. Unknown letters have none."""
        try:
            found = list(map(self.ids.__getitem__, letters))
            if ends and letters and self.end:
                found[-1] = self.ids[letters[-1] + self.end]
            return found
        except KeyError:
            names = [*letters[:-1], letters[-1] + self.end * ends]
            return [self.ids[c] for c in names if c in self.ids]

    def merge(self, symbols: list[int]) -> list[int]:
        return self._scan(list(symbols)) if len(symbols) <= SCANNED else self._queue(symbols)

    def _scan(self, ids: list[int]) -> list[int]:
        rank, made = self.ranks.get, self.made
        ranks = [rank(pair, _NO_RULE) for pair in zip(ids, ids[1:])]
        while ranks:
            first = min(ranks)
            if first == _NO_RULE:
                break
            i = ranks.index(first)
            ids[i] = made[first]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank((ids[i], ids[i + 1]), _NO_RULE)
            if i:
                ranks[i - 1] = rank((ids[i - 1], ids[i]), _NO_RULE)
        return ids

    def _queue(self, symbols: list[int]) -> list[int]:
        ranks, ids, n = self.ranks, list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(ranks[pair], i, pair) for i, pair in enumerate(zip(ids, ids[1:])) if pair in ranks]
        heapq.heapify(queue)
        while queue:
            first, i, pair = heapq.heappop(queue)
            j = after[i]
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j], after[i] = self.made[first], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (ids[a], ids[b]) in ranks:
                    heapq.heappush(queue, (ranks[ids[a], ids[b]], a, (ids[a], ids[b])))
        return [x for x in ids if x >= 0]


class Transducer:
    """One word at a time: symbols go in as they come, ids come out as soon as they are final."""

    def __init__(self, merges: Merges, window: int | None = None):
        self.merges = merges
        self.window = max(window or 0, 4 * merges.lookahead, 2)
        self.held: list[int] = []

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        for symbol in symbols:
            self.held.append(symbol)
            if len(self.held) >= self.window:
                yield from self._settled()

    def _settled(self) -> Iterator[int]:
        at, final = 0, len(self.held) - self.merges.lookahead
        for token in self.merges.merge(self.held):
            if at + self.merges.sizes[token] > final:
                break
            at += self.merges.sizes[token]
            yield token
        del self.held[:at]

    def finish(self) -> list[int]:
        held, self.held = self.held, []
        return self.merges.merge(held)


# ---------------------------------------------------------------- texts to ids

@cache
def _joining() -> frozenset[str]:
    """Characters that normalisation may join to the one before them."""
    seconds = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in map(chr, range(0x110000)):
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            seconds.add(chr(int(parts[1], 16)))
    return frozenset(seconds)


def _starts(c: str) -> bool:
    return c.isascii() or not (unicodedata.combining(c) or c in _joining())


_MARK = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def _cut(text: str, at: int) -> tuple[int, bool]:
    """The first place from `at` on where a stretch can be divided, and whether a word goes on across it."""
    for i in range(max(at, 4), len(text) - 4):
        around = text[i - 4: i + 4]
        if around.isalpha():
            if _starts(text[i]):
                return i, True
        elif _MARK.issuperset(around):
            return i, True
        elif text[i] in "0123456789" and text[i - 1].isascii():
            return i, False
    return len(text), False


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        whole = Tokenizer.from_file(path)
        self.split = whole.pre_tokenizer.pre_tokenize_str
        self.normal = whole.normalizer.normalize_str if whole.normalizer else str
        self.merges = Merges(stored["model"])
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in stored["added_tokens"]):
            raise ValueError("special tokens must be matched as they stand")
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        names = sorted(self.special, key=lambda x: (-len(x), x))
        self.divide = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else lambda x: [x]
        if [w for w, _ in self.split(self.normal("x y\n\tz\r "))] != ["x", "y", "z"]:
            raise ValueError("the vocabulary must drop white space")
        self.kept: dict[str, bytes] = _Kept(self)

    def word(self, letters: str) -> list[int]:
        """Ids of one word, given as the letters that stand for its bytes."""
        symbols = self.merges.symbols(letters, True)
        if len(symbols) <= SCANNED:
            return self.merges._scan(symbols)
        run = Transducer(self.merges)
        return [*run.feed(symbols), *run.finish()]

    def stretch(self, text: str) -> Iterator[int]:
        """Ids of a text, whatever stands in it, in constant memory beyond the text."""
        for n, part in enumerate(self.divide(text)):
            if n % 2:
                yield self.special[part]
            elif len(part) <= LONG:
                for word, _ in self.split(self.normal(part)):
                    yield from self.word(word)
            else:
                yield from self._blocks(part)

    def _blocks(self, text: str) -> Iterator[int]:
        run, at, open_word, last = Transducer(self.merges), 0, False, ""
        while at < len(text):
            to, goes_on = _cut(text, at + LONG)
            words = [w for w, _ in self.split(self.normal(text[at:to]))]
            for i, word in enumerate(words):
                if i or not open_word:
                    if last:
                        yield from run.feed(self.merges.symbols(last, True))
                        last = ""
                    yield from run.finish()
                # the last letter waits: it has another symbol if the word ends here
                yield from run.feed(self.merges.symbols(last + word[:-1], False))
                last = word[-1]
            at, open_word = to, goes_on and bool(words)
        if last:
            yield from run.feed(self.merges.symbols(last, True))
        yield from run.finish()

    def blocks(self, text: str) -> Iterator[bytes]:
        """Ids of a text in blocks."""
        at = 0
        while at < len(text):
            to = text.find(_BLANK, at + STRIDE) if len(text) - at > STRIDE else -1
            to = len(text) if to < 0 else to
            yield b"".join(map(self.kept.__getitem__, text[at:to].split(_BLANK)))
            at = to

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.blocks(text or ""))


class _Kept(dict):
    """Ids of the pieces between blanks."""

    def __init__(self, encoder: Encoder):
        super().__init__({"": b""})
        self.encoder = encoder
        self.letters = dict(enumerate(tokens._byte_letters()))

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            ids = self._word(piece)
        elif "\n" in piece:
            return b"".join(map(self.__getitem__, piece.split("\n")))
        elif piece[-1] in _MARK and piece[:-1].isalpha():   # the word is kept, not each of its forms
            return self[piece[:-1]] + self[piece[-1]]
        else:
            ids = _packed(self.encoder.stretch(piece))
        if len(self) < KEPT_PIECES and len(piece) <= KEPT_LENGTH:
            self[piece] = ids
        return ids

    def _word(self, piece: str) -> bytes:
        """Letters only; what the library would normalise in another way than `lower` goes to the library."""
        low = piece.lower()
        if len(piece) > LONG or max(piece) > _PLAIN or not low.isalpha():
            return _packed(self.encoder.stretch(piece))
        return _packed(self.encoder.word(low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)))


def _packed(ids: Iterable[int]) -> bytes:
    ids = ids if isinstance(ids, list) else list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


# ---------------------------------------------------------------- ids to text

def _byte_of() -> dict[str, int]:
    return {letter: b for b, letter in enumerate(tokens._byte_letters())}


class Decoder:
    """Bytes of ids in, text out, as soon as its characters are complete.

    By the file's own rule: without one, tokens stand as they are with a blank between; a byte-level rule restores
    bytes. `words` restores bytes in both cases, with a blank after each word.
    """

    def __init__(self, path: str, words: bool = False):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        rule = stored.get("decoder")
        if rule and rule["type"] != "ByteLevel":
            raise ValueError("an unknown decoding rule")
        end, byte = stored["model"].get("end_of_word_suffix") or "", _byte_of()
        self.parted = not rule and not words
        names = {i: t for t, i in stored["model"]["vocab"].items()} | {t["id"]: t["content"] for t in stored["added_tokens"]}
        special = {t["id"] for t in stored["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (max(names, default=-1) + 1)
        for i, name in names.items():
            if self.parted:
                self.bytes[i] = b" " + name.encode()
            elif i in special or not set(name.removesuffix(end) if end else name) <= byte.keys():
                self.bytes[i] = name.encode()
            elif end and name.endswith(end):
                self.bytes[i] = bytes(byte[c] for c in name.removesuffix(end)) + b" "
            else:
                self.bytes[i] = bytes(byte[c] for c in name)

    def blocks(self, ids: np.ndarray) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        first = self.parted
        for at in range(0, len(ids), STRIDE):
            some = ids[at: at + STRIDE]
            some = some[some < len(self.bytes)]
            data = b"".join(map(self.bytes.__getitem__, some.tolist()))
            if first and data:
                data, first = data[1:], False
            yield machine.decode(data)
        yield machine.decode(b"", True)

    def decode(self, ids: bytes | np.ndarray) -> str:
        return "".join(self.blocks(np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids)))


_workers: dict[tuple, Encoder | Decoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives a task."""
    if ("in", path) not in _workers:
        _workers["in", path] = Encoder(path)
    return _workers["in", path]


def decoder(path: str, words: bool = False) -> Decoder:
    if ("out", path, words) not in _workers:
        _workers["out", path, words] = Decoder(path, words)
    return _workers["out", path, words]


# ---------------------------------------------------------------- on Spark

def _lists(found: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int64)
    ids = np.frombuffer(b"".join(found), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
                     decoded: bool = False) -> DataFrame:
    """One row per row of `docs`: its key, n_tokens and ids; with `decoded` also the text that the ids decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches):
            found = [encoder(vocabulary).encode(t.as_py()) for t in batch.column("_text")]
            columns = {"_id": batch.column("_id"), "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()),
                       "ids": _lists(found)}
            if decoded:
                columns["decoded"] = pa.array(map(decoder(vocabulary).decode, found), pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"_id {dict(docs.dtypes)[key]}, n_tokens bigint, ids array<int>" + ", decoded string" * decoded
    return (docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, schema)
            .withColumnRenamed("_id", key))


def decode_documents(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids",
                     words: bool = False) -> DataFrame:
    """One row per row of `encoded`: its key and the text of its ids; null ids decode to an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = decoder(vocabulary, words)
        for batch in tokens.slices(batches):
            found = [machine.decode(np.array([i for i in x.as_py() or () if i is not None and i >= 0], "<u4"))
                     for x in batch.column("_ids")]
            yield pa.RecordBatch.from_pydict({"_id": batch.column("_id"), "text": pa.array(found, pa.string())})

    return (encoded.select(F.col(key).alias("_id"), F.col(ids).alias("_ids"))
            .mapInArrow(run, f"_id {dict(encoded.dtypes)[key]}, text string").withColumnRenamed("_id", key))


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Key, n_tokens, and the digests of the ids and of the decoded text."""
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(key, "n_tokens", F.sha2(listed, 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
