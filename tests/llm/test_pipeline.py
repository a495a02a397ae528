"""The pipeline's stages, each judged on its own input."""

import os

import pytest

import corpus_pipeline
from crawlscope.llm import decontaminate, jaccard, lines
from crawlscope.llm.store import save
from crawlscope.sources.tables import load

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")
def test_stages_act_on_what_the_one_before_kept(spark):
    docs = load(spark, SF, "documents")
    given, sizes = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, given = given, save(stage(spark, given, SF), name)
        sizes.append(given.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert given.columns == docs.columns
            assert given.join(before, "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            assert lines.removals(given).count() <= before.count()
        if name == "ngram_jaccard":
            assert jaccard.near_duplicates(given, 5, 80).where("doc_id != component_id").count() == 0
        if name == "benchmark_decontamination":
            assert decontaminate.report(given, load(spark, SF, "benchmark")).where("contaminated").count() == 0
            final = given.count()
    assert sizes == sorted(sizes[:4], reverse=True) + sizes[4:]
    assert given.select("doc_id").distinct().count() == final
    assert sizes[0] < docs.count() and sizes[-1] > 0
