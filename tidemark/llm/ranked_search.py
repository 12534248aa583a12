"""Ranked lexical search of all documents for a set of query items, by presence-mask grouping.

The score of a document for an item is the sum over the item's terms (repeats included) of w * ((10^9 * tf) div (10^3 * tf + 8 * m)),
where w depends on the term's document frequency and m on the document's length against the mean.

1. One pass over the texts keeps, per document, its number of terms and the numbers and frequencies of those terms that some item
   holds. Items are taken in blocks of at most BLOCK_TERMS distinct terms and BLOCK_BYTES of text, a pass for each block, so what is
   sent to the tasks is bounded however many items there are.
2. Counts over all documents (documents with terms, all terms, documents by term) give weights and mean length.
3. Each task holds a batch of documents as one presence bitmap per term. For an item, the bitmaps of its terms are turned into one
   mask per document, and equal masks are grouped: their documents hold the same of the item's terms. A mask's maximum score adds up the
   largest contributions its terms have in the batch. Masks are evaluated in falling order of their maximum until the best documents
   found so far in the task beat what the rest can reach. No pair of document and item leaves a task but a task's own best.
4. The best of all tasks are ranked per item, first within salted groups of tasks.

Items and documents are rows: repeated rows are ranked each for itself, rows of equal id side by side. Null and empty texts have no
terms, so such items get no rows and such documents none either. Equal scores go by ascending document id, null ids last; equal rows in
any order. An empty table gives an empty result. Columns other than the ids and texts are not read. Texts are hashed in slices of whole
documents, longer documents in pieces cut between terms. All arithmetic is in 64-bit integers, as long as
75 * (terms of a document) * (number of documents) stays below 2^63.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch
from tidemark.llm.wordhash import PUNCTUATION, SLICE, Words, separators, slices

TOP = 10
BLOCK_TERMS = 200_000
BLOCK_BYTES = 8 << 20
#: Documents of a batch times terms of the longest item: bits unpacked at a time.
MASK_BITS = 1 << 25
BATCH = 16_384
#: Masks are evaluated in steps of this many documents at first, doubling.
STEP = 64
#: Tasks whose results are ranked together before the last ranking.
GROUP = 64
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_UPPER = {c: c + 32 for c in range(65, 91)}


def terms(text: str | None) -> list[str]:
    return [t.translate(_UPPER) for t in TERM.findall(text or "")]


@dataclass
class Block:
    """Items of one block: row ids, and the terms of each as numbers into `vocabulary` with their repeats."""

    ids: list
    vocabulary: list[str]
    items: list[tuple[np.ndarray, np.ndarray]]


def item_blocks(items: DataFrame, most_terms: int = BLOCK_TERMS, most_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Items that have terms, in blocks; one item may exceed the bounds by itself. The driver holds one block and one partition."""
    ids, known, found, held = [], {}, [], 0
    for item_id, text in items.select("item_id", "text").toLocalIterator():
        own = terms(text)
        if not own:
            continue
        if found and (held + len(text) > most_bytes or len(known) + len(own) > most_terms):
            yield Block(ids, list(known), found)
            ids, known, found, held = [], {}, [], 0
        numbers, repeats = np.unique([known.setdefault(t, len(known)) for t in own], return_counts=True)
        ids.append(item_id)
        found.append((numbers, repeats))
        held += len(text)
    if found:
        yield Block(ids, list(known), found)


class Lookup:
    """Finds the words of Arrow texts among a fixed vocabulary: by hash, then byte by byte."""

    def __init__(self, vocabulary: list[str]) -> None:
        raw = [t.encode() for t in vocabulary]
        self.table = separators(PUNCTUATION)
        words = Words(pa.array(vocabulary, pa.large_string()), 0, len(raw), np.zeros(256, bool))
        hashes = words.hashes()
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        if len(self.hashes) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two query terms share a hash")  # one in 10^9 for a full block; a smaller block parts them
        self.data, self.starts = words.data, words.starts
        self.lengths = words.ends - words.starts

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place among the words, number of the term) of each word that is a term."""
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        places = np.flatnonzero(self.hashes[at] == hashes)
        found = self.order[at[places]]
        lengths = words.ends[places] - words.starts[places]
        same = lengths == self.lengths[found]
        places, found, lengths = places[same], found[same], lengths[same]
        if len(places):
            ends = np.cumsum(lengths)
            step = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
            unlike = words.data[step + np.repeat(words.starts[places], lengths)] != self.data[step + np.repeat(self.starts[found], lengths)]
            same = np.add.reduceat(unlike, ends - lengths) == 0
            places, found = places[same], found[same]
        return places, found


def _parts(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about `limit` bytes; a longer text comes in pieces under the same row, cut where no term is cut."""
    cut_at = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    for begin, end in slices(texts, limit):
        part = texts.slice(begin, end - begin)
        if end - begin > 1 or part.nbytes <= 2 * limit or not part[0].is_valid:
            yield begin, part
            continue
        data, at = memoryview(part[0].as_buffer()), 0
        while at < len(data):
            stop = cut_at.search(data, min(len(data), at + limit))
            to = stop.start() if stop else len(data)
            yield begin, pa.array([bytes(data[at:to]).decode()], texts.type)
            at = to


def _postings(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = None
        for batch in batches:
            lookup = lookup or Lookup(vocabulary.value)
            size = len(lookup.order)
            n = np.zeros(batch.num_rows, np.int64)
            keys: list[np.ndarray] = []
            for begin, part in _parts(batch.column(1)):
                words = Words(part, 0, len(part), lookup.table, lower=True)
                counts = np.diff(words.bounds)
                n[begin:begin + len(counts)] += counts
                places, found = lookup.find(words)
                rows = np.searchsorted(words.bounds, places, "right") - 1 + begin
                keys.append(rows * size + found)
            held, tf = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_counts=True)
            bounds = np.searchsorted(held, np.arange(batch.num_rows + 1, dtype=np.int64) * size).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.ListArray.from_arrays(bounds, (held % size).astype(np.int32)),
                 pa.ListArray.from_arrays(bounds, tf)], names=["doc_id", "n", "term", "tf"])

    return run


def postings(docs: DataFrame, block: Block) -> DataFrame:
    """Per document with terms: doc_id, n, and the block's terms in it (ascending) with their frequencies."""
    shipped = docs.sparkSession.sparkContext.broadcast(block.vocabulary)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        _postings(shipped), f"doc_id {kind}, n long, term array<int>, tf array<long>").where("n > 0")


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(df[seen])], names=["term", "df"])

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Best:
    """The best rows found so far for one item: scores and ids, at most TOP, best first."""

    def __init__(self, top: int) -> None:
        self.top, self.rows = top, []

    def floor(self) -> int:
        """The score that a further document must reach; ties at the floor may still win by id."""
        return self.rows[-1][0] if len(self.rows) == self.top else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        floor = self.floor()
        new = [(int(s), d) for s, d in zip(scores, ids) if s >= floor]
        if new:
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))[:self.top]


class Batch:
    """Documents of one batch: contributions by (document, term), presence bitmaps by term."""

    def __init__(self, ids: pa.Array, n: np.ndarray, bounds: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray,
                 documents: int, total: int) -> None:
        self.ids, self.count, self.size = ids, len(n), len(weights)
        rows = np.repeat(np.arange(len(n)), np.diff(bounds))
        m = 25 + (75 * n * documents) // total
        self.value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[rows]))
        self.keys = rows * self.size + term  # ascending, as documents and their terms are
        order = np.argsort(term, kind="stable")
        self.seen, begins = np.unique(term[order], return_index=True)
        self.most = np.zeros(self.size, np.int64)
        if len(order):
            self.most[self.seen] = np.maximum.reduceat(self.value[order], begins)
        bits = np.zeros((len(self.seen), len(n)), bool)
        bits[np.searchsorted(self.seen, term), rows] = True
        self.bitmaps = np.packbits(bits, axis=1)

    def scores(self, docs: np.ndarray, numbers: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        wanted = (docs[:, None] * self.size + numbers[None, :]).ravel()
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        values = np.where(self.keys[at] == wanted, self.value[at], 0)
        return (values.reshape(len(docs), len(numbers)) * repeats).sum(axis=1)

    def search(self, numbers: np.ndarray, repeats: np.ndarray, best: Best) -> None:
        at = np.searchsorted(self.seen, numbers)
        present = np.flatnonzero(self.most[numbers] > 0)  # terms without weight change no score
        present = present[at[present] < len(self.seen)]
        most = self.most[numbers[present]] * repeats[present]
        if most.sum() < best.floor():
            return
        # Bitmaps of terms become masks of documents: one row of bytes a document.
        bits = np.unpackbits(self.bitmaps[at[present]], axis=1, count=self.count)
        masks = np.ascontiguousarray(np.packbits(bits, axis=0).T)
        wide = np.zeros((self.count, -(-masks.shape[1] // 8) * 8), np.uint8)
        wide[:, :masks.shape[1]] = masks
        words = wide.view(np.uint64)
        order = np.lexsort(words.T) if words.shape[1] > 1 else np.argsort(words[:, 0], kind="stable")
        fresh = np.ones(self.count, bool)
        fresh[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
        begins = np.flatnonzero(fresh)
        ends = np.append(begins[1:], self.count)
        reach = most @ bits[:, order[begins]].astype(np.int64)
        by_reach = np.argsort(-reach, kind="stable")
        by_reach = by_reach[:np.searchsorted(-reach[by_reach], -max(1, best.floor()), "right")]
        sizes = np.cumsum(ends[by_reach] - begins[by_reach])
        done, step = 0, STEP
        while done < len(by_reach) and reach[by_reach[done]] >= best.floor():
            to = max(done + 1, int(np.searchsorted(sizes, (sizes[done - 1] if done else 0) + step, "right")))
            docs = np.concatenate([order[begins[g]:ends[g]] for g in by_reach[done:to]])
            scores = self.scores(docs, numbers[present], repeats[present])
            good = np.flatnonzero(scores >= best.floor())
            if len(good) > best.top:  # keep ties with the last place, the ids decide
                cut = np.partition(scores[good], len(good) - best.top)[len(good) - best.top]
                good = good[scores[good] >= cut]
            best.add(scores[good], self.ids.take(pa.array(docs[good])).to_pylist())
            done, step = to, step * 2


def _search(shipped, documents: int, total: int, top: int, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shipped.value
        best = [Best(top) for _ in items]
        rows = max(64, min(batch_rows, MASK_BITS // max(len(numbers) for numbers, _ in items)))
        kind = None
        for record in batches:
            kind = record.schema.field(0).type
            for begin in range(0, record.num_rows, rows):
                part = record.slice(begin, rows)
                term = part.column(2)
                bounds = term.offsets.to_numpy() - term.offsets[0].as_py()
                batch = Batch(part.column(0), part.column(1).to_numpy(), bounds, term.flatten().to_numpy(zero_copy_only=False).astype(np.int64),
                              part.column(3).flatten().to_numpy(zero_copy_only=False), weights, documents, total)
                if not len(batch.keys):
                    continue
                for (numbers, repeats), found in zip(items, best):
                    batch.search(numbers, repeats, found)
        out = [(i, s, d) for i, found in enumerate(best) for s, d in found.rows]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int32()), pa.array([r[2] for r in out], kind), pa.array([r[1] for r in out], pa.int64()),
                 pa.array(np.full(len(out), TaskContext.get().partitionId() // GROUP), pa.int32())], names=["item", "doc_id", "score", "part"])

    return run


def _ranked(rows: DataFrame, top: int, *group: str) -> DataFrame:
    window = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, most_terms: int = BLOCK_TERMS, batch_rows: int = BATCH) -> DataFrame:
    """Per item its `top` best documents with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    kinds = {c: f.schema[c].dataType.simpleString() for f, c in ((docs, "doc_id"), (items, "item_id"))}
    scratch = Scratch(spark, "search")
    results = None
    for number, block in enumerate(item_blocks(items, most_terms)):
        kept = scratch.keep(postings(docs, block), f"postings-{number}")
        size = len(block.vocabulary)
        totals = kept.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("total")).first()
        if not totals.documents:
            scratch.drop(f"postings-{number}")
            break
        counts = kept.select("term").mapInArrow(_frequencies(size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        weights = np.zeros(size, np.int64)
        for term, df in counts.collect():  # bounded by the block's terms
            weights[term] = weight(totals.documents, df)
        shipped = spark.sparkContext.broadcast((block.items, weights))
        found = kept.mapInArrow(_search(shipped, totals.documents, totals.total, top, batch_rows),
                                f"item int, doc_id {kinds['doc_id']}, score long, part int")
        best = _ranked(_ranked(found, top, "item", "part"), top, "item")
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kinds['item_id']}")
        ranked = scratch.keep(best.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), f"best-{number}")
        scratch.drop(f"postings-{number}")
        results = ranked if results is None else results.unionByName(ranked)
    if results is None:
        return spark.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    return results
