"""Token ids of whole texts, by the tokenizers library and a byte-level vocabulary file, in Arrow batches.

Such a vocabulary splits text by a pattern before it merges anything, and that pattern always cuts before a single
blank between two other characters, around a single line feed between two others, and between letters and a final
punctuation mark, whatever surrounds them. So a text's ids are those of its pieces one after another, and a piece
that comes again is looked up. The first pieces a worker meets are kept, up to a fixed number; later ones that are
not among them are encoded each time, so memory is bounded and frequent words cost one look-up.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa

from . import arrays

KEPT_PIECES = 250_000
SLICE = 500  # documents whose ids are held at once
KEPT_LENGTH = 32

_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ".,:;!?"

_workers: dict[str, Encoder] = {}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _BesideSpace(Exception):
    """A blank stands beside white space: the text must be cut by the pattern."""


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary (a fixed rule of the format)."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class _Pieces(dict):
    """Ids of pieces, with the blank before them or without."""

    def __init__(self, encoder: Encoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _BesideSpace
        if piece.isalpha():
            ids = self.encoder.word(self.lead + piece)
        elif piece[-1] in _MARKS and piece[:-1].isalpha():
            ids = self[piece[:-1]] + self.encoder.marks[piece[-1]]
        else:
            line, feed, rest = piece.partition("\n")
            if line and rest and not line[-1].isspace() and not rest[0].isspace():
                ids = self[line] + self.encoder.marks["\n"] + self.encoder.heads[rest]
            else:
                ids = self.encoder.plain(self.lead + piece)
        if len(self) < KEPT_PIECES and len(piece) <= KEPT_LENGTH:
            self[piece] = ids
        return ids


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        letters = _byte_letters()
        self.letters = dict(enumerate(letters))
        self.blank = letters[32]
        self.marks = {c: self.plain(c) for c in _MARKS + "\n"}
        self.heads = _Pieces(self, "")
        self.tails = _Pieces(self, " ")

    def plain(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def word(self, word: str) -> bytes:
        """Letters only, perhaps after a blank: nothing to split, so the merges alone decide."""
        spelled = (word.replace(" ", self.blank) if word.isascii()
                   else word.encode().decode("latin-1").translate(self.letters))
        return _packed([t.id for t in self.merge(spelled)])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        head, *tail = text.split(" ")
        try:
            return (self.heads[head] if head else b"") + b"".join(map(self.tails.__getitem__, tail))
        except _BesideSpace:
            head, *tail = _CUT.split(text)
            kept = self.tails
            return self.plain(head) + b"".join(
                [kept[p] if not p[-1].isspace() else self.plain(" " + p) for p in tail])


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives a task."""
    if path not in _workers:
        _workers[path] = Encoder(path)
    return _workers[path]


def release() -> None:
    """Drop the worker's encoders: called where a worker turns to work without tokens."""
    if _workers:
        _workers.clear()
        arrays.trim()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most SLICE rows: ids take more room than text."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def encode_column(column: pa.Array, path: str) -> list[bytes]:
    """Ids of each text of a string column; a null text has none."""
    encode = encoder(path).encode
    return [encode(text.as_py() or "") for text in column]
