"""Queries next to their SQL, and the pipeline stage by stage."""

import pytest
from oracle import DATA, compare, duck

import corpus_pipeline
from edgeloom.llm import decontaminate, line_templates, rules_quality, set_join
from edgeloom.llm.queries import ORACLE, QUERIES

SF_DIR = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    result = compare(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLE[name])
    assert result in (None, "EMPTY"), result


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = seen
        seen = stage(spark, before, SF_DIR)
        assert seen.columns == columns and seen.dtypes == docs.dtypes, name
        seen = spark.createDataFrame(seen.collect(), docs.schema)
        now = {r.doc_id for r in seen.select("doc_id").collect()}
        if name == "quality classifier":
            model = rules_quality.train(before, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
            want = {r.doc_id for r in rules_quality.score_documents(before, model).where("predicted = 1").collect()}
        elif name == "line dedup":
            want = ids
            text = {r.doc_id: r.text for r in line_templates.drop_recurring_lines(before).collect()}
            assert {r.doc_id: r.text for r in seen.collect()} == text
        elif name == "n-gram Jaccard join":
            want = {r.component_id for r in set_join.similar_documents(before, 5, 80).collect()}
        else:
            bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
            want = ids - {r.doc_id for r in decontaminate.find_passages(before, bench).collect()}
        assert now == want, name
        ids = now
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in packed} == ids and all(r.padding is None or r.padding >= 0 for r in packed)
