"""Aspect spans against the extractor and by place."""

from opinara.operators import spans
from opinara.operators.text import extract_aspects

TERMS = ["battery", "screen", "k"]


def test_places_in_the_original_text(spark):
    rows = [("a", "Battery, SCREEN! batteryx battery."), ("b", ""), ("c", None), ("d", "İİ battery"), ("e", "é-battery/Screen 10K K"),
            ("f", "K screen")]
    df = spark.createDataFrame(rows, "review_id string, text string")
    found = spans.with_spans(df, terms=TERMS).collect()
    texts = dict(rows)
    assert {r["review_id"] for r in found} == {"a", "d", "e", "f"}
    for r in found:
        assert texts[r["review_id"]][r["start"]: r["end"]].lower() == r["term"]
    assert [(r["start"], r["end"], r["token_pos"]) for r in found if r["review_id"] == "a"] == [(0, 7, 0), (9, 15, 1), (26, 33, 3)]
    assert len([r for r in found if r["review_id"] == "a"]) == 3


def test_terms_are_those_of_the_extractor(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("cast(doc_id as string) as review_id", "text")
    terms = ["ther", "tion", "ing", "keit"]
    ours = sorted((r["review_id"], r["token_pos"], r["term"]) for r in spans.with_spans(df, terms=terms).collect())
    theirs = sorted((r["review_id"], r["token_pos"], r["term"]) for r in extract_aspects(df, terms).collect())
    assert ours == theirs and len(ours) > 100


def test_sql_lateral_join(spark):
    spark.udtf.register("aspect_spans", spans.aspect_spans(TERMS))
    spark.createDataFrame([("x", "good battery")], "id string, t string").createOrReplaceTempView("span_texts")
    row = spark.sql("select id, s.* from span_texts, lateral aspect_spans(t) s").first()
    assert tuple(row) == ("x", 1, "battery", 5, 12)
