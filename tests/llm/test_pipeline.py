import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def test_stages_keep_columns_and_run_agrees(spark):
    from tidewin.llm.support import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, SF), "test", "zstd")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[-1] > 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    key = lambda df: sorted((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert key(last) == key(corpus_pipeline.run(spark, SF))


def test_stages_take_odd_documents(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, SF)
    assert docs.count() > 0
    empty = odd.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, step in corpus_pipeline.STAGES:
        empty = step(spark, empty, SF)
    assert empty.count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
