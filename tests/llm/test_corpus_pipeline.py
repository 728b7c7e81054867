"""Every stage of the pipeline against what it must keep, each on its own input."""

import collections

import corpus_pipeline
from opinara.llm import queries
from opinara.session import materialize

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_join", "decontamination", "packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = materialize(stage(spark, docs, SF), name)
        assert kept.columns == columns
        before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, kept))
        assert after.items() <= before.items()
        seen.append((before, after))
        docs = kept
    assert seen[0][0] == seen[0][1]  # no junk in this table
    bare = lambda t: "".join(t.split(" ")).translate({c: None for c in range(9, 14)})
    groups = collections.defaultdict(list)
    for i, t in seen[1][0].items():
        groups[bare(t)].append((-len(t), i))
    assert set(seen[1][1]) == {min(g)[1] for g in groups.values()}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(packed["doc_id"]) == set(seen[-1][1])
    assert packed.groupby("doc_id")["length"].sum().eq(packed.groupby("doc_id")["doc_tokens"].first()).all()
    assert packed.groupby("sequence_id")["length"].sum().le(2048).all()


def test_run_is_the_stages_in_order(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == queries.QUERIES["op3_packing"](spark, SF).columns and got.count() > 0
