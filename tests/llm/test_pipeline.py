"""The pipeline's stages on the smallest table: each keeps the columns and its decisions take effect."""

from pyspark.sql import functions as F

import corpus_pipeline
from atrium.llm.common import materialise, table, word_count

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), f"test-{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            n = out.count()
            assert 0 < n <= (2 * before if name == "mix" else before)
            if name == "near_duplicates":
                assert out.select("doc_id").distinct().count() == n
            if name == "mix":
                share = out.agg(F.sum(word_count("text"))).first()[0] / docs.agg(F.sum(word_count("text"))).first()[0]
                assert abs(share - 1.5) < 0.05
            before, docs = n, out
    assert out.where("not decoded").isEmpty() and out.select("doc_id").distinct().count() <= before


def test_registry():
    from atrium.llm import queries

    assert set(queries.QUERIES) >= {"pipeline"} and sum(q.startswith("op") for q in queries.QUERIES) == 13
