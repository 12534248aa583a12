"""Labelled texts without words: they teach the bias only, and stop neither the learner nor the pipeline."""

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tidemark.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table():
    texts = [None, "", " \t", "...", "good words here", "nasty words here"]
    return [(i, texts[i % 6], "en", "s", 1) for i in range(120)], [(i, int(i % 6 == 5)) for i in range(120)]


def test_training_on_texts_without_words():
    column = pa.array(["", "nasty words", "...", "good words"])
    rows = [tuple(x[:3]) for x in (toxicity.features(column, i, i + 1) for i in range(4))]
    model, before = toxicity.fresh(1), toxicity.fresh(1)
    toxicity.train(model, rows, np.array([0, 1, 0, 0], np.float32), 0.25, epochs=3)  # before, an IndexError
    assert not np.array_equal(model.stems, before.stems) and np.isfinite(model.flat()).all()
    alone = toxicity.fresh(1)
    toxicity.train(alone, rows[:1], np.array([0], np.float32), 0.0, epochs=1)
    assert alone.bias < 0 and all(np.array_equal(a, b) for a, b in zip(alone.parameters(), toxicity.fresh(1).parameters()))


def test_op8_fits_and_scores_them(spark):
    docs, labels = table()
    docs = spark.createDataFrame(docs, DOCS)
    model, thresholds = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(docs, model, thresholds).collect()}
    assert len(got) == 120 and len({got[i].score for i in range(120) if i % 6 < 4}) == 1 and got[5].score > got[4].score


def test_pipeline_stage_keeps_them(spark, tmp_path):
    docs, labels = table()
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    name, stage = corpus_pipeline.STAGES[0]
    kept = {r.doc_id for r in stage(spark, corpus_pipeline.table(spark, str(tmp_path), "documents"), str(tmp_path)).collect()}
    assert name == "toxicity" and kept >= {i for i in range(120) if i % 6 == 4}
