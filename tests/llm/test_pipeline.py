"""The pipeline on the smallest data set: each stage keeps columns and rows it should."""

import corpus_pipeline
from reelbook.llm.common import read_table
from reelbook.llm.queries import ORACLES, QUERIES
from reelbook.session import stage

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read_table(spark, FOLDER, "documents")
    before = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        after = stage(step(spark, before, FOLDER), "test")
        assert after.schema.names == docs.schema.names
        assert 0 < after.count() <= before.count()
        assert after.exceptAll(before).count() == 0, name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, FOLDER)
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
    assert packed.exceptAll(corpus_pipeline.run(spark, FOLDER)).count() == 0


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(ORACLES) <= set(QUERIES)
