"""The stages one after another on the smallest tables, each against what it promises."""

import corpus_pipeline
from packlens.llm import queries
from packlens.llm.common import materialize, read_table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "substrings", "mixing", "encoding"]
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), f"test-{name}")
        counts[name] = docs.count()
        if name != "encoding":
            assert docs.columns == before.columns
    assert counts["near_duplicates"] <= counts["quality"] < 200
    assert counts["substrings"] == counts["near_duplicates"]
    assert counts["encoding"] == counts["mixing"]
    assert docs.where("not decodes").count() == 0


def test_registered():
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert {q.split("_")[0] for q in queries.queries()} == {f"op{i}" for i in range(1, 14)}
