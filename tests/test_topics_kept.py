"""Topics per category write mentions once and read their texts once."""

from opinara.operators import mining


def test_topics_of_categories_write_mentions_once_and_keep_counted_texts(spark, monkeypatch):
    tables, kept, plain = [], [], mining.materialize

    def note(df, name="stage"):
        tables.append((name, plain(df, name)))
        return tables[-1][1]

    monkeypatch.setattr(mining, "materialize", note)

    class Noted(mining.LDA):
        def fit(self, dataset, params=None):
            kept.append(dataset.storageLevel.useDisk)
            return super().fit(dataset, params)

    monkeypatch.setattr(mining, "LDA", Noted)
    rows = [(f"{c}{i}", f"{c}one {c}two word{i % 5} word{(i + 1) % 5}", c) for c in "xy" for i in range(24)]
    texts = spark.createDataFrame([r[:2] for r in rows], "review_id string, text string")
    mentions = spark.createDataFrame([(r[0], "Negative", r[2], "taste") for r in rows] * 2 + [("x0", "Positive", "x", "happy")],
                                     "review_id string, sentiment string, main_category string, aspect_term_normalized string")
    found = mining.category_topics(mentions, texts, 2, max_iter=1).collect()
    assert {r["main_category"] for r in found} == {"x", "y"} and kept == [True, True]
    assert all(r["top_aspects"] in (None, {"taste": 2 * r["document_count"]}) for r in found if r["document_count"] <= 24)
    assert [name for name, _ in tables].count("cells") == 1
    assert sum(r["k"] for r in dict(tables)["cells"].collect()) == 97
