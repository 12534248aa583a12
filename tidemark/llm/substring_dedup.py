"""Substring deduplication by hashes of content-defined reference blocks, in place of a greedy relative Lempel-Ziv parse.

Every document is compared with the documents of smaller id. The index holds reference blocks: for each window of WINDOW words its
anchor is the smallest hash among its GRAM-word grams, and a block is a maximal run of windows with one anchor. Equal passages have
equal blocks whatever surrounds them. No longest match is extended and nothing reaches over the edge of a block.

* A block that also stands in a smaller document is known: so are all its windows.
* Blocks differ only at the edges of passages. A block whose anchor occurs elsewhere with other content lies at such an edge, and
  there each window is looked up by itself.

So a window is looked up alone only near edges, the index has about one row for every 18 words, and the result is that of
comparing all windows, up to collisions: block and window keys are 128-bit hashes of content, which are not compared byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordhash
from tidemark.llm.common import keep

WINDOW, GRAM = 50, 16
_TABLE = wordhash.separators()
_BLOCKS = "doc_id long, text_key long, anchor long, content long, first int, windows int"
_WINDOWS = "doc_id long, text_key long, anchor long, content long, first int"
_KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _blocks(window: int, gram: int):
    """Rows (doc_id, text_key, text) to the blocks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, column = (batch.column(i) for i in range(3))
            for a, b in wordhash.slices(column):
                words = wordhash.Words(column, a, b, _TABLE)
                counts = np.diff(words.bounds) - window + 1  # windows of each text
                if (counts < 1).all():
                    continue
                rolling = wordhash.Rolling(words.hashes())
                grams = rolling.windows(np.arange(len(words.starts) - gram + 1), gram)
                anchors = wordhash.sliding_min(grams, window - gram + 1)
                counts = np.maximum(counts, 0)
                text = np.repeat(np.arange(b - a), counts)
                at = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + words.bounds[text]
                anchor = anchors[at]
                opens = np.ones(len(at), bool)
                opens[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
                first = np.flatnonzero(opens)
                windows = np.diff(np.append(first, len(at)))
                text = text[first]
                rows = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), keys.take(rows), _long(anchor[first]), _long(rolling.windows(at[first], windows + window - 1)),
                     pa.array((at[first] - words.bounds[text]).astype(np.int32)), pa.array(windows.astype(np.int32))],
                    names=[f.split()[0] for f in _BLOCKS.split(", ")])

    return run


def _windows(window: int):
    """Rows (doc_id, text_key, text, blocks to look up) to one row per window of these blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, column, blocks = (batch.column(i) for i in range(4))
            for a, b in wordhash.slices(column, wordhash.SLICE // 4):
                words = wordhash.Words(column, a, b, _TABLE)
                rolling = wordhash.Rolling(words.hashes())
                part = blocks.slice(a, b - a)
                flat = part.flatten()
                first, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
                text = np.repeat(np.arange(b - a), np.asarray(part.value_lengths()))
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
                content = rolling.windows(place + words.bounds[text[row]], window)
                rows = pa.array(text[row] + a)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), keys.take(rows), flat.field(2).take(pa.array(row)), _long(content), pa.array(place.astype(np.int32))],
                    names=[f.split()[0] for f in _WINDOWS.split(", ")])

    return run


def _kept(spans: list[tuple[int, int]] | None, text: bytes | None, window: int) -> tuple[list[bytes], int, int]:
    """Kept words, all words, removed words; a span is a first word and its number of windows."""
    words = (text or b"").split()
    if not spans:
        return words, len(words), 0
    edge = np.zeros(len(words) + 1, np.int64)
    for first, windows in spans:
        edge[first] += 1
        edge[first + windows + window - 1] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    return [words[i] for i in np.flatnonzero(~gone)], len(words), int(gone.sum())


def _digests(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digests = [], [], []
            for text, firsts, windows in zip(*(batch.column(i) for i in (1, 2, 3))):
                spans = list(zip(firsts.as_py(), windows.as_py())) if firsts.is_valid else None
                kept, count, gone = _kept(spans, text.as_py(), window)
                n.append(count)
                removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                                             names=[f.split()[0] for f in _KEPT.split(", ")])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text_key, first, windows: runs of windows whose words also start in a document of smaller id (kept).

    Rows alike in id and text share their spans; rows with a null id have none and lend none.
    """
    rows = keyed(docs)
    blocks = keep(rows.where("doc_id is not null").mapInArrow(_blocks(window, gram), _BLOCKS), "rlz-blocks")
    known = keep(blocks.groupBy("anchor", "content").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
                 .where("source < last").drop("last"), "rlz-known")
    mixed = keep(blocks.groupBy("anchor").agg(F.min("content").alias("a"), F.max("content").alias("b"), F.min("doc_id").alias("c"), F.max("doc_id").alias("d"))
                 .where("a < b and c < d").select("anchor", F.lit(True).alias("mixed")), "rlz-mixed")
    factor = F.coalesce(F.col("source") < F.col("doc_id"), F.lit(False))
    parsed = keep(blocks.join(known, ["anchor", "content"], "left").join(mixed, "anchor", "left")
                  .select("doc_id", "text_key", "anchor", "first", "windows", factor.alias("factor"), "mixed").where("factor or mixed"), "rlz-parsed")
    edges = (parsed.where("not factor").groupBy("doc_id", "text_key")
             .agg(F.collect_list(F.struct("first", "windows", "anchor")).alias("blocks")))
    texts = rows.where("doc_id is not null")
    looked = keep(texts.join(edges, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "blocks")
                  .mapInArrow(_windows(window), _WINDOWS), "rlz-windows")
    seen = keep(looked.groupBy("anchor", "content").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"))
                .where("source < last").drop("last"), "rlz-seen")
    single = (looked.join(seen, ["anchor", "content"]).where("source < doc_id")
              .select("doc_id", "text_key", "first", F.lit(1).alias("windows")))
    return keep(parsed.where("factor").select("doc_id", "text_key", "first", "windows").unionByName(single), "rlz-spans")


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space).

    A word goes when a window of `window` words that covers it also starts in a row of smaller doc_id, judged on the input. Null
    and empty texts have no words; repeated ids are not smaller than each other, so copies under one id all stay; rows with a
    null id keep all words. Other columns are not read. An empty input gives an empty result.
    """
    spans = (duplicate_spans(docs, window, gram).groupBy("doc_id", "text_key")
             .agg(F.collect_list("first").alias("firsts"), F.collect_list("windows").alias("runs"))
             .withColumnsRenamed({"doc_id": "span_id", "text_key": "span_key"}))
    rows = keyed(docs).join(spans, (F.col("doc_id") == F.col("span_id")) & (F.col("text_key") == F.col("span_key")), "left")
    return rows.select("doc_id", "text", "firsts", "runs").mapInArrow(_digests(window), _KEPT)
