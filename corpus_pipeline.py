"""Corpus pipeline: named stages over documents, each written and read again before the next.

Every stage but the last returns the columns of its input, whatever others stand beside doc_id, text, source and n_chars. An empty table gives
an empty result in each. Rows that repeat a doc_id, null ids among them, are rows of their own. Null texts count as empty; texts without words
leave at the mix at the latest, which takes no words of them. Texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, ngram_join, token_output, toxicity
from tidemark.llm.common import keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language; learned from labels of documents still there."""
    return toxicity.keep_clean(docs, *toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with other numbers, names or units."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as the words that the mix takes of it; documents of which none are taken leave."""
    return mixing.mix_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files; returns what is read back from them."""
    return token_output.token_output(docs)


STAGES = [("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_leaks), ("source mixing", mix_sources),
          ("token output", write_tokens)]
#: A trained classifier and a random mix are among the stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the documents of sf_dir: what is read back from the token files, one row per document of the mix.

    Tables between stages are kept in the shared folder, so a lost executor costs tasks of one stage only.
    """
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = keep(docs, name.replace(" ", "-"))
    return docs
