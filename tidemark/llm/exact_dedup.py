"""Exact deduplication by Grace hashing.

1. Every task collapses the equal texts it reads with an open-addressing table that compares whole contents. A table that
   outgrows its budget is emptied into the output and started anew, so memory is bounded and a group that holds a third of
   all rows leaves each task as a few rows. The result is kept as a table: one row per document with the key of its local
   group, one row with the content per local group.
2. The local groups are shuffled by content hash. Each task resolves its bucket: what does not fit the table is parted by
   further bits of the digest into spill files, recursively, until every part fits.
3. Documents learn the outcome of their local group by an equi-join on its key, which no hot group dominates.

Spill files lie where Spark puts a Python worker's spills (SPARK_LOCAL_DIRS); they belong to one task attempt, are never read
by another, and go with it, so a lost executor costs a rerun of its tasks only.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import keep

SPACES = b" \t\n\x0b\x0c\r"
BUDGET = 64 << 20
FANOUT = 16
_GROUP = "row_key long, doc_id long, rep_key long, hash long, content binary, best_chars long, best_id long, best_key long, rows long"
_ANSWER = "rep_key long, keep_id long, keep_key long, group_size long, text_sha256 string"


class ContentTable:
    """Open addressing with linear probing; a hit needs equal hashes and equal whole contents."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.bytes = 0

    def entry(self, key: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = key & mask
        while (found := self.slots[at]) >= 0:
            if self.hashes[found] == key and self.contents[found] == content:
                return found
            at = (at + 1) & mask
        self.slots[at] = found = len(self.contents)
        self.hashes.append(key)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return found

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for number, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = number


def better(a: tuple, b: tuple) -> tuple:
    """The row that stays: most code points, then smallest id (null last), then smallest row key. Rows are (chars, id, key)."""
    return min(a, b, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))


def digest_key(content: bytes) -> tuple[bytes, int]:
    digest = hashlib.sha256(content).digest()
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def collapse(budget: int):
    """Step 1: a task's rows to one row per document and one per local group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        table, groups = ContentTable(), []

        def emptied():
            rows = [(None, None, g[0], h, c, *g[1], g[2]) for g, h, c in zip(groups, table.hashes, table.contents)]
            for i in range(0, len(rows), 1000):
                yield _batch(rows[i:i + 1000], _GROUP)

        for batch in batches:
            members = []
            for doc, text, chars in zip(*(c.to_pylist() for c in batch.columns)):
                content = (text or b"").translate(None, SPACES)
                number = table.entry(digest_key(content)[1], content)
                row = (chars or 0, doc, key)
                if number == len(groups):
                    groups.append([key, row, 0])
                group = groups[number]
                group[1], group[2] = better(group[1], row), group[2] + 1
                members.append((key, doc, group[0], None, None, None, None, None, None))
                key += 1
                if table.bytes > budget:
                    yield from emptied()
                    table, groups = ContentTable(), []
            yield _batch(members, _GROUP)
        yield from emptied()

    return run


def resolve(budget: int):
    """Step 2: the local groups of one bucket to the outcome of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for rep, content, chars, best, best_key, rows in zip(*(c.to_pylist() for c in batch.columns)):
                    yield content, (chars, best, best_key), rows, [rep]

        answer = []
        with ExitStack() as stack:
            for row in _grace(records(), budget, 0, stack):
                answer.append(row)
                if len(answer) == 10_000:
                    yield _batch(answer, _ANSWER)
                    answer = []
        if answer:
            yield _batch(answer, _ANSWER)

    return run


def _grace(records: Iterable, budget: int, depth: int, stack: ExitStack) -> Iterator[tuple]:
    """Outcome of each local group among the records; parts that outgrow the budget go through spill files."""
    table, groups, parts = ContentTable(), [], None
    for content, best, rows, reps in records:
        digest, key = digest_key(content)
        if parts is None:
            number = table.entry(key, content)
            if number == len(groups):
                groups.append([best, rows, reps, digest])
            else:
                group = groups[number]
                group[0], group[1] = better(group[0], best), group[1] + rows
                group[2] += reps
            table.bytes += 16
            if table.bytes > budget and len(groups) > 1 and depth < 24:
                folder = stack.enter_context(tempfile.TemporaryDirectory(prefix="grace-", dir=_spill_root()))
                parts = [open(f"{folder}/{depth}-{i}", "w+b") for i in range(FANOUT)]
                for group, kept in zip(groups, table.contents):
                    pickle.dump((kept, *group[:3]), parts[group[3][8 + depth] % FANOUT])
                table, groups = ContentTable(), []
        else:
            pickle.dump((content, best, rows, reps), parts[digest[8 + depth] % FANOUT])
    for (_, keep_id, keep_key), rows, reps, digest in groups:
        for rep in reps:
            yield rep, keep_id, keep_key, rows, digest.hex()
    for part in parts or ():
        with part:
            part.seek(0)
            yield from _grace(_unpickled(part), budget, depth + 1, stack)


def _unpickled(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _spill_root() -> str | None:
    return (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None


_TYPES = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


def grace_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, and all empty texts form one group. The row with
    the most code points of original text stays, then the smallest id (null ids last), and of rows alike in both exactly one.
    Other columns are not read. An empty input gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"),
                       F.char_length(F.col(text_col)).cast("long").alias("chars"))
    local = keep(rows.mapInArrow(collapse(budget), _GROUP), "grace")
    groups = (local.where("content is not null")
              .select("rep_key", "content", "best_chars", "best_id", "best_key", "rows", "hash").repartition("hash").drop("hash"))
    answer = groups.mapInArrow(resolve(budget), _ANSWER)
    members = local.where("content is null").select("row_key", "doc_id", "rep_key")
    return members.join(answer, "rep_key").select(
        "doc_id", "keep_id", "group_size", (F.col("row_key") == F.col("keep_key")).alias("kept"), "text_sha256")
