"""The pipeline's stages on a small corpus, each against a plain reading of it."""

import os

import pytest

import corpus_pipeline
from pavement.llm import pii

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, spark.createDataFrame(list(before.values()), docs.schema), FOLDER)
        assert after.columns == docs.columns
        rows = {r.doc_id: r for r in after.collect()}
        assert set(rows) <= set(before) and len(rows) > 0.5 * len(before), name
        if name in ("quality_rules", "near_dedup"):
            assert all(rows[i] == before[i] for i in rows)
        elif name == "decontamination":
            assert len(rows) == len(before) and all(len(rows[i].text) == rows[i].n_chars for i in rows)
            assert any(rows[i].text != before[i].text for i in rows)
        elif name == "personal_data":
            assert all(rows[i].text == pii.redact(before[i].text, pii.all_spans(before[i].text)) for i in rows)
        before = rows
    last = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(list(before.values()), docs.schema), FOLDER).collect()
    assert {r.doc_id for r in last} == set(before) and all(len(r.ids) == 4 * r.n_tokens for r in last)
