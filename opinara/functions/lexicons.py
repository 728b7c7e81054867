"""Fixed dictionaries.  Each one is far below a thousand entries, so a broadcast of
any of them has a proven bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Canonical aspect -> surface variants.
ASPECT_VARIANTS = {
    "color": ["color", "colors", "colour", "colours", "shade", "shades", "tint"],
    "quality": ["quality", "qualities"],
    "smell": ["smell", "smells", "scent", "scents", "fragrance", "fragrances",
              "aroma", "aromas", "odor", "odour"],
    "price": ["price", "prices", "cost", "costs", "pricing", "value"],
    "packaging": ["package", "packages", "packaging", "container", "containers",
                  "box", "boxes"],
    "texture": ["texture", "textures", "consistency", "feel"],
    "size": ["size", "sizes", "amount", "quantity"],
    "bottle": ["bottle", "bottles", "jar", "jars", "tube", "tubes"],
    "product": ["product", "products", "item", "items"],
    "usage": ["use", "uses", "usage", "application", "applications"],
    "skin": ["skin", "skins", "complexion"],
    "hair": ["hair", "hairs"],
    "effect": ["effect", "effects", "result", "results"],
    "ingredient": ["ingredient", "ingredients", "formula", "formulation"],
    "brand": ["brand", "brands", "company"],
    "delivery": ["delivery", "shipping", "shipment"],
    "lasting": ["lasting", "longevity", "duration", "long-lasting", "longlasting"],
}

# Aspects too generic to analyse.
EXCLUDED_ASPECTS = ["thing", "things", "stuff", "something", "anything", "everything",
                    "it", "this", "that", "these", "those", "one", "ones"]
EXCLUDED_ASPECTS_EXTENDED = EXCLUDED_ASPECTS + ["part", "parts", "piece", "pieces"]

# Technical words of the content flag.
JARGON_WORDS = ["mg", "ml", "chemical", "compound", "pharmaceutical", "extract",
                "formula", "study"]

# English function words.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his "
    "himself she her hers herself it its itself they them their theirs themselves what "
    "which who whom this that these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how "
    "all any both each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now"
).split()

# Opinion words of the shipped lexicon scorer, with weights in [-1, 1].
OPINION_WORDS = {
    "excellent": 1.0, "perfect": 1.0, "amazing": 0.9, "love": 0.9, "great": 0.8,
    "beautiful": 0.8, "good": 0.7, "nice": 0.6, "soft": 0.4, "fine": 0.4,
    "terrible": -1.0, "awful": -1.0, "worst": -1.0, "hate": -0.9, "horrible": -0.9,
    "broken": -0.8, "bad": -0.7, "poor": -0.6, "weak": -0.5, "cheap": -0.4,
}
NEGATIONS = ["not", "no", "never", "without", "hardly"]


def _values(spark: SparkSession, rows: list[str], names: str) -> DataFrame:
    return spark.sql(f"select * from values {', '.join(rows)} as t({names})")


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def aspect_map(spark: SparkSession, variants: dict[str, list[str]] | None = None) -> DataFrame:
    """``(variant, canonical)`` rows."""
    rows = [
        f"({quote(v)}, {quote(canonical)})"
        for canonical, group in (variants or ASPECT_VARIANTS).items()
        for v in group
    ]
    return _values(spark, rows, "variant, canonical")


def word_list(spark: SparkSession, words: list[str], name: str = "word") -> DataFrame:
    return _values(spark, [f"({quote(w)})" for w in words], name)


def weight_table(spark: SparkSession, weights: dict[str, float]) -> DataFrame:
    """``(word, weight)`` rows of a polarity lexicon."""
    rows = [f"({quote(w)}, cast({x} as double))" for w, x in weights.items()]
    return _values(spark, rows, "word, weight")
