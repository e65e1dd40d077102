"""The corpus pipeline: its stages in order, and what they leave."""

import corpus_pipeline
from helixframe.llm import decontaminate, ngram_join
from helixframe.llm.common import saved, table

D = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_join", "decontaminate", "mix", "shard"]
    docs = table(spark, D, "documents")
    names = docs.columns
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        new = saved(f(spark, docs, D))
        assert new.columns == names
        ids, old = {r["doc_id"] for r in new.select("doc_id").collect()}, {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids <= old and len(ids) > 0.5 * len(old)
        if k == 1:
            assert ngram_join.near_duplicates(new).where("n_links > 0").count() == 0
        if k == 2:
            assert decontaminate.search(decontaminate.build_index(new), table(spark, D, "benchmark")).where("size(spans) > 0").count() == 0
        docs = new
    last = corpus_pipeline.STAGES[-1][1](spark, docs, D)
    assert last.count() == docs.count()
