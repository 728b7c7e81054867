"""Column expressions.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicons import STOP_WORDS

POSITIVE, NEGATIVE, NEUTRAL = "Positive", "Negative", "Neutral"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- sentiment

def sentiment_score(sentiment="sentiment", confidence="confidence") -> Column:
    """Confidence signed by polarity; neutral counts as zero."""
    s, c = _col(sentiment), _col(confidence)
    return F.when(s == POSITIVE, c).when(s == NEGATIVE, -c).otherwise(F.lit(0.0))


def sentiment_flags(sentiment="sentiment") -> dict[str, Column]:
    s = _col(sentiment)
    return {
        "is_positive": (s == POSITIVE).cast("int"),
        "is_negative": (s == NEGATIVE).cast("int"),
        "is_neutral": (s == NEUTRAL).cast("int"),
    }


def to_star_scale(score="sentiment_score") -> Column:
    """Map [-1, 1] onto [1, 5]."""
    return (_col(score) + 1) / 2 * 4 + 1


def rating_label(rating="rating") -> Column:
    r = _col(rating)
    return F.when(r >= 4, "positive").when(r <= 2, "negative").otherwise("neutral")


def count_if(cond: Column) -> Column:
    return F.sum(cond.cast("bigint"))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


# ---------------------------------------------------------------- calendar

def period_start(d: Column | str, freq: str) -> Column:
    d = _col(d)
    if freq == "D":
        return d.cast("date")
    return F.trunc(d, {"W": "week", "M": "month"}[freq])


def period_end(d: Column | str, freq: str) -> Column:
    """Label a day with the last day of its day, Monday-Sunday week or month."""
    d = _col(d).cast("date")
    if freq == "D":
        return d
    if freq == "W":
        return F.next_day(F.date_sub(d, 1), "SUN")
    return F.last_day(d)


def next_period_end(d: Column, steps: Column, freq: str) -> Column:
    if freq == "D":
        return F.date_add(d, steps)
    if freq == "W":
        return F.date_add(d, steps * 7)
    return F.last_day(F.add_months(F.trunc(d, "month"), steps))


def day_number(d: Column | str) -> Column:
    return F.unix_date(_col(d).cast("date"))


def calendar_fields(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    d = F.col(ts).cast("date")
    return df.withColumns(
        {
            "year_month": F.trunc(d, "month"),
            "week": F.trunc(d, "week"),
            "date": d,
            "year": F.year(d),
            "month": F.month(d),
            "day_of_week": F.date_format(d, "EEEE"),
        }
    )


def parse_timestamp(c: Column | str) -> Column:
    """Epoch milliseconds, else a timestamp string, else null."""
    c = _col(c)
    return F.coalesce(F.timestamp_millis(c.try_cast("bigint")), F.try_to_timestamp(c))


# ---------------------------------------------------------------- text

def ellipsize(c: Column | str, n: int = 50) -> Column:
    """At most ``n`` characters, the dots included."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def cut(c: Column | str, n: int) -> Column:
    """``n`` characters followed by dots when something was cut off."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def review_full(title="title", text="text") -> Column:
    return F.trim(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "),
                           F.coalesce(_col(text), F.lit(""))))


# Patterns of the text rules.
URL_PATTERN = r"http\S+|www\S+"
EMAIL_PATTERN = r"[\w\.-]+@[\w\.-]+"
PHONE_PATTERN = r"\+?\d[\d\-\s]{6,}\d"


def scrub_pii(c: Column | str) -> Column:
    """Redact e-mail addresses, then phone numbers.

    An address holds an at sign: texts without one skip its pattern, which tries every suffix of every word.
    """
    c = _col(c)
    return F.regexp_replace(
        F.when(F.contains(c, F.lit("@")), F.regexp_replace(c, EMAIL_PATTERN, "[REDACTED_EMAIL]")).otherwise(c),
        PHONE_PATTERN,
        "[REDACTED_PHONE]",
    )


def clean_text_basic(c: Column | str) -> Column:
    """Lower case, no URLs, line-break tags to spaces, letters only, single spaces."""
    t = F.lower(F.coalesce(_col(c), F.lit("")))
    t = F.regexp_replace(t, URL_PATTERN, "")
    t = F.regexp_replace(t, r"<br\s*/?>", " ")
    t = F.regexp_replace(t, r"[^a-z\s]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def words(c: Column | str) -> Column:
    """Tokens of a single-spaced text; the empty text has none."""
    c = _col(c)
    return F.filter(F.split(c, " "), lambda w: w != "")


def clean_text_full(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """URLs and punctuation out, lower case, stop words out.  Unicode letters stay.

    Compatibility normalisation (NFKC) is a separate vectorised step, see
    ``operators.text.nfkc``.
    """
    t = F.regexp_replace(F.coalesce(_col(c), F.lit("")), URL_PATTERN, "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_\s]", " ")
    t = F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
    stop = list(stop_words or STOP_WORDS)
    return F.array_join(F.filter(words(t), lambda w: ~w.isin(stop)), " ")


def topic_tokens(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower-case alphanumeric tokens of three or more characters, stop words out."""
    stop = list(stop_words or STOP_WORDS)
    raw = F.split(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^a-z0-9]+")
    return F.filter(raw, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and hand it to ``fn``.

    A column used inside a lambda is recomputed for every element; a lambda variable
    is not.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams of a token array."""

    def build(t):
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - (n - 1)))
        return F.coalesce(
            F.transform(starts, lambda i: F.array_join(F.slice(t, i, n), " ")),
            F.array().cast("array<string>"),
        )

    return let(tokens, build)


def repeats_ngram(c: Column | str, n: int = 2, threshold: int = 3) -> Column:
    """True when some n-gram occurs ``threshold`` times or more.

    The n-grams are sorted inside the row, so equal ones become neighbours and no
    token ever has to be shuffled.
    """
    tokens = words(F.regexp_replace(F.trim(_col(c)), r"\s+", " "))

    def repeated(grams):
        idx = F.when(F.size(grams) >= threshold,
                     F.sequence(F.lit(1), F.size(grams) - (threshold - 1)))
        return F.exists(
            idx, lambda i: F.get(grams, i - 1) == F.get(grams, i + (threshold - 2))
        )

    return F.coalesce(let(F.sort_array(ngrams(tokens, n)), repeated), F.lit(False))


def format_percentage(c: Column | str) -> Column:
    return F.format_string("%.1f%%", _col(c).cast("double"))


def format_score(c: Column | str) -> Column:
    return F.format_string("%.2f", _col(c).cast("double"))


def normalize_question(c: Column | str) -> Column:
    return F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))


def decode_entities(c: Column | str) -> Column:
    """The common HTML entities; the ampersand goes last so nothing is decoded twice."""
    out = _col(c)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
                         ("&middot;", "·"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


# ---------------------------------------------------------------- numbers, vectors

def price_value(c: Column | str) -> Column:
    """Text price to double; anything that is no number becomes null."""
    return _col(c).try_cast("double")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column | str) -> Column:
    """Unit vector; a zero vector stays as it is."""
    a = _col(a)
    norm = F.coalesce(F.nullif(l2_norm(a), F.lit(0.0)), F.lit(1.0))
    return let(norm, lambda n: F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))
