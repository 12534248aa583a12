"""Line deduplication over content-defined chunks of lines.

A chunk ends after a line where a rolling hash over the hashes of it and the two lines before is 0 modulo DIVISOR, and at the end of the text.
Boundaries depend on the lines around them alone, so an inserted line moves no boundary further on. Chunks of two or more lines
that occur more than once in the corpus are compared byte by byte; the first occurrence stays, the others go.

A chunk rule alone misses runs that share a chunk with other lines, so every pair of neighbouring lines is looked up the same way: a run
of two or more lines that also stands at an earlier place is the union of such pairs, and none is missed.

Only hashes are grouped at first. The bytes of chunks whose hash repeats are fetched by document key and grouped by content, so a
chunk that stands in a third of all documents is one group that partial aggregation has shrunk before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep

DIVISOR = 4
#: Factors of the line before and the one before that.
ROLL = (31, 961)
_KEPT = "doc_id long, n_lines long, n_chunks long, n_removed long, kept_sha256 string, n_repeated long, unrepeated_sha256 string"


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def with_chunks(rows: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """Adds lines and chunks, an array of (first line, number of lines)."""
    hashed = rows.withColumn("lines", F.split("text", "\n")).withColumn("hashes", F.transform("lines", line_hash))
    last = F.size("lines") - 1

    def ends(i: Column) -> Column:
        rolled = F.get("hashes", i)
        for back, factor in enumerate(ROLL, 1):
            rolled = rolled + factor * F.when(i >= back, F.get("hashes", F.greatest(i - back, F.lit(0)))).otherwise(0)
        return (i == last) | (rolled % divisor == 0)

    bounds = hashed.withColumn("bounds", F.filter(F.sequence(F.lit(0), last), ends))
    return bounds.withColumn("chunks", F.transform("bounds", lambda b, j: F.struct(
        F.when(j == 0, 0).otherwise(F.get("bounds", F.greatest(j - 1, F.lit(0))) + 1).alias("first"), b.alias("last")))).withColumn(
        "chunks", F.transform("chunks", lambda c: F.struct(c["first"].alias("first"), (c["last"] - c["first"] + 1).alias("n")))).drop("hashes", "bounds")


def chunk_text(c: Column) -> Column:
    return F.array_join(F.slice("lines", c["first"] + 1, c["n"]), "\n")


def line_pairs() -> Column:
    """(first line, 2) of every two neighbouring lines."""
    last = F.size("lines") - 2
    firsts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(firsts, lambda i: F.struct(i.alias("first"), F.lit(2).alias("n")))


def removed_runs(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, text_key, first, n, pair: the chunks (pair: the line pairs) that an earlier place in (doc_id, line) order holds too (kept).

    Chunks are compared with chunks and pairs with pairs. A place that overlaps the first one is not a copy of it.
    """
    rows = with_chunks(keyed(docs), divisor)

    def marked(runs: Column, pair: bool) -> Column:
        return F.transform(runs, lambda c: F.struct(c["first"].alias("first"), c["n"].alias("n"), F.lit(pair).alias("pair"),
                                                    F.xxhash64(chunk_text(c), F.lit(pair)).alias("hash")))

    runs = F.concat(marked(F.filter("chunks", lambda c: c["n"] >= 2), False), marked(line_pairs(), True))
    run = ["first", "n", "pair", "hash"]
    places = keep(rows.select("doc_id", "text_key", F.explode(runs).alias("c")).select("doc_id", "text_key", *[f"c.{x}" for x in run]), "line-chunks")
    often = keep(places.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash"), "line-often")
    wanted = (places.join(often.hint("merge"), "hash", "left_semi").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*run)).alias("chunks"))
              .withColumnsRenamed({"doc_id": "id", "text_key": "key"}))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    texts = keyed(docs).join(wanted.hint("merge"), same).withColumn("lines", F.split("text", "\n"))
    fetched = keep(texts.select("doc_id", "text_key", F.explode(F.transform("chunks", lambda c: F.struct(
        *[c[x].alias(x) for x in run], chunk_text(c).alias("body")))).alias("c"))
        .select("doc_id", "text_key", *[f"c.{x}" for x in run], "c.body"), "line-bodies")
    place = F.struct("doc_id", "first", "text_key")
    group = ["hash", "pair", "body"]
    first = keep(fetched.groupBy(*group).agg(F.min(place).alias("stays"), F.count("*").alias("times")).where("times > 1").drop("times"), "line-first")
    overlaps = (F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key"))
                & (F.col("first") < F.col("stays.first") + F.col("n")))
    gone = fetched.join(first.hint("merge"), group).where(~overlaps)
    return keep(gone.select("doc_id", "text_key", "first", "n", "pair").distinct(), "line-gone")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, chunks, firsts, runs, pairs in zip(*(c.to_pylist() for c in batch.columns)):
            lines = text.split("\n")
            gone = bytearray(len(lines)), bytearray(len(lines))
            for first, n, pair in zip(firsts or (), runs or (), pairs or ()):
                gone[pair][first:first + n] = b"\x01" * n
            kept = [hashlib.sha256("\n".join(x for x, g in zip(lines, some) if not g).encode()).hexdigest() for some in gone]
            out.append((doc, len(lines), chunks, sum(gone[0]), kept[0], sum(gone[1]), kept[1]))
        columns = list(zip(*out)) if out else [()] * 7
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _KEPT.split(", ")])


def line_dedup(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_chunks, n_removed (lines of chunks), kept_sha256 (of the kept lines joined by line
    feeds), n_repeated (lines in runs of two or more lines that also stand at an earlier place), unrepeated_sha256 (of the others).

    Lines end at line feeds; a null or empty text is one empty line. Single-line chunks always stay in kept_sha256, the result that the
    SQL states; unrepeated_sha256 has every repeated run of two or more lines removed, at any chunk boundaries. The first occurrence in
    (doc_id, line) order stays, null ids first; rows alike in id and text are treated alike. Other columns are not read. An empty
    input gives an empty result.
    """
    gone = (removed_runs(docs, divisor).groupBy("doc_id", "text_key")
            .agg(F.collect_list(F.struct("first", "n", "pair")).alias("gone")).withColumnsRenamed({"doc_id": "id", "text_key": "key"}))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    rows = with_chunks(keyed(docs), divisor).select("doc_id", "text_key", "text", F.size("chunks").cast("long").alias("n_chunks"))
    return rows.join(gone.hint("merge"), same, "left").select(
        "doc_id", "text", "n_chunks", F.col("gone.first").alias("firsts"), F.col("gone.n").alias("runs"), F.col("gone.pair").alias("pairs")).mapInArrow(_digests, _KEPT)
