"""Places of aspect terms in a text, as a table function for lateral joins."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L

SPAN = "token_pos int, term string, start int, end int"


def find_spans(text: str | None, terms: frozenset[str]) -> Iterator[tuple[int, str, int, int]]:
    """(number of the word, term, start, end) of each word that is a term; characters count from 0, the end is past the last.

    Words are runs of ASCII letters and digits in lower case, as `text.tokens` has them. Where lower case is longer than
    the character it comes from, places are those of the original text.
    """
    text = text or ""
    low = text.lower()
    place = range(len(text) + 1)
    if len(low) != len(text):
        place = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
    for number, word in enumerate(re.finditer("[a-z0-9]+", low)):
        if word.group() in terms:
            yield number, word.group(), place[word.start()], place[word.end() - 1] + 1


def aspect_spans(terms: Iterable[str] | None = None):
    """The table function of a text column: one row per span. It runs in Arrow batches and can be registered for SQL."""
    known = frozenset(terms or (v for vs in L.ASPECT_VARIANTS.values() for v in vs))

    class AspectSpans:
        def eval(self, text: str):
            yield from find_spans(text, known)

    return F.udtf(AspectSpans, returnType=SPAN, useArrow=True)


def with_spans(df: DataFrame, col: str = "text", terms: Iterable[str] | None = None) -> DataFrame:
    """Each row once per span, by a lateral join; rows without a span drop out."""
    return df.lateralJoin(aspect_spans(terms)(F.col(col).outer()))
