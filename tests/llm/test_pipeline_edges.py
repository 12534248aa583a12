"""The whole pipeline on an empty table, and on nulls, empty, repeated and long rows with columns of clashing names."""

import pytest

import corpus_pipeline
from tests.llm.test_llm import DOC, EDGES, FOLDER


def folder(spark, path, docs):
    docs.write.parquet(f"{path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_run_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], DOC)
    out = corpus_pipeline.run(spark, folder(spark, tmp_path, docs))
    assert out.count() == 0 and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(out.columns)


def test_stages_on_edge_rows(spark, tmp_path):
    # The learner needs labelled texts, so the edge rows stand among those of the table.
    whole = spark.read.parquet(f"{FOLDER}/documents.parquet")
    edges = spark.createDataFrame([(r[0] if r[0] is None else r[0] + 10**6, *r[1:]) for r in EDGES], DOC)
    sf_dir = folder(spark, tmp_path, edges.unionByName(whole, allowMissingColumns=True))
    docs = corpus_pipeline.table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, sf_dir), "edges")
        assert docs.columns == columns, name
    texts = [r.text for r in docs.filter("doc_id >= 1000000 OR doc_id IS NULL").collect()]
    # Rows without words take no part in the mix; of the passage and its copies one row at most stays.
    assert all(t and t.strip() for t in texts)
    assert len([t for t in texts if "common30" in t.lower()]) <= 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
