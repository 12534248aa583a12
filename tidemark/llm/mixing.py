"""Mixing sources to target weights.

The words of every source form one stream, packed into blocks of BLOCK words. Each source's target is turned into block slots;
the slots are drawn multinomially over the output shards (the joint draw of shards and sources, given each source's total, so
that a source always meets its target). Slot j of a source is block perm(j) of its epoch j // blocks, where perm is a
pseudorandom permutation of block numbers; slots and blocks are joined by number. As a target is at most twice its source, no
block is taken more than twice. The words of each block are brought to its slots and written in files by shard (write_shards); what the
mix takes of a row is counted from these files.

A stream position needs running sums within a source that may hold a third of all rows, so sums are taken over about
sqrt(rows) hash chunks per source, then inside each chunk.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, Scratch, fresh_path, keep, words

BLOCK = 128
SHARD_BLOCKS = 4096
#: Slots that one task draws.
PART_SLOTS = 1 << 16
#: The shards are written in so many passes, so that a part of the mix only is in shuffle files at once.
WAVES = 4
#: Weights by rank of the source, repeating.
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source_key, source_no, source_size, target of every source, by water-filling.

    Each round gives what is left to the open sources by weight and closes those above `most` times their size. Closed sources
    stay closed, as the level only rises; a round closes one at least, so it ends. Only sums over sources reach the driver.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    ranked = (totals.withColumn("source_no", F.row_number().over(Window.orderBy("source_key")) - 1)
              .select("source_key", "source_no", "source_size", weight.alias("weight"),
                      (F.col("source_size") * most).alias("cap")))
    ranked = keep(ranked, "mix-sources")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, closed = 0.0, -1
    while True:
        is_closed = F.col("cap") <= F.col("weight") * level
        n, spent, open_weight = ranked.agg(
            F.count(F.when(is_closed, 1)), F.coalesce(F.sum(F.when(is_closed, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~is_closed, F.col("weight"))), F.lit(0.0))).first()
        if n == closed or not open_weight:
            break
        closed, level = n, (total - spent) / open_weight
    return ranked.withColumn("target", F.least(F.col("cap"), F.col("weight") * level) if open_weight else F.col("cap"))


def draw(total: int, shards: int, key: bytes, begin: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(shard, first slot, slots) of a multinomial draw of total slots over equally likely shards, empty ones left out.

    Halves the shards again and again with one seeded binomial each, so shards begin to end - 1 can be had alone.
    """
    open_ = [(0, shards, total, 0)]
    while open_:
        low, high, slots, start = open_.pop()
        if not slots or high <= begin or low >= end:
            continue
        if high - low == 1:
            yield low, start, slots
            continue
        middle = (low + high) // 2
        seed = int.from_bytes(hashlib.sha256(key + b"%d:%d" % (low, high)).digest()[:16], "little")
        left = int(np.random.Generator(np.random.Philox(seed)).binomial(slots, (middle - low) / (high - low)))
        open_ += [(middle, high, slots - left, start + left), (low, middle, left, start)]


def permuted(index: np.ndarray, size: int, key: bytes) -> np.ndarray:
    """A keyed permutation of range(size): four Feistel rounds on the next even number of bits, walked until inside."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.sha256(key).digest(), "<u8")

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed = mixed * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= size).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


def _slots(seed: int):
    """Rows (source_no, blocks, slots, shards) to one row per slot: source_no, shard, slot, block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for no, blocks, part, parts, slots, shards in frame.itertuples(index=False):
                key = b"%d/%d/" % (seed, no)
                for shard, start, count in draw(slots, shards, key, part * shards // parts, (part + 1) * shards // parts):
                    slot = np.arange(start, start + count, dtype=np.int64)
                    block = np.empty_like(slot)
                    for epoch in np.unique(slot // blocks):
                        at = slot // blocks == epoch
                        block[at] = permuted(slot[at] % blocks, blocks, key + b"epoch %d" % epoch)
                    yield pd.DataFrame({"source_no": no, "shard": shard, "slot": slot, "block": block})

    return run


def plan(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 0, block: int = BLOCK,
         weights: tuple[int, ...] = WEIGHTS, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sizes (row_key, doc_id, source, size, source_size, target), pieces (row_key, doc_id, text_key, source_no, block, at: place in the
    block, first word, words), slots (source_no, shard, slot, block).

    docs needs row_key, doc_id, source and text. Sources weigh by rank in code point order, null last.
    """
    spark = docs.sparkSession
    key = F.struct(F.col("source").isNull().alias("missing"), F.coalesce("source", F.lit("")).alias("name"))
    sizes = keep(docs.select("row_key", "doc_id", "source", key.alias("source_key"), text_key(), word_count(F.col("text")).alias("size")),
                 "mix-sizes")
    targets = keep(source_targets(sizes, share, most, weights).select("source_key", "source_no", "source_size", "target"),
                   "mix-targets")
    chunks = math.isqrt(sizes.count()) + 1
    rows = sizes.join(targets, "source_key").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))
    by_chunk = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("source_no", "chunk").agg(F.sum("size").alias("chunk_size"))
              .withColumn("chunk_start", F.coalesce(F.sum("chunk_size").over(by_chunk), F.lit(0))).drop("chunk_size"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "size", "text_key", "row_key").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = rows.where("size > 0").join(starts, ["source_no", "chunk"]).withColumn(
        "start", F.col("chunk_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    blocks = F.explode(F.sequence((F.col("start") / block).cast("long"), ((F.col("start") + F.col("size") - 1) / block).cast("long")))
    own = ["row_key", "doc_id", "text_key", "source_no"]
    pieces = placed.select(*own, "start", "size", blocks.alias("block")).select(
        *own, "block", F.greatest(F.lit(0), F.col("start") - F.col("block") * block).alias("at"),
        F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("first"),
        F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")).alias("end"))
    pieces = pieces.withColumn("words", F.col("end") - F.col("first")).drop("end")
    with_blocks = (targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block))
                   .withColumn("slots", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")))
    all_slots = with_blocks.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, math.ceil(all_slots / shard_blocks))
    cut = F.least(F.lit(shards), F.ceil(F.col("slots") / PART_SLOTS))
    parts = with_blocks.where("slots > 0").select("source_no", "blocks", F.explode(F.sequence(F.lit(0), cut - 1)).alias("part"),
                                                  cut.alias("parts"), "slots", F.lit(shards).alias("shards"))
    # A row here is some thousand slots later on: adaptive execution, which sees small rows, keeps a stated number of partitions.
    slots = (parts.repartition(all_slots // PART_SLOTS + 8, "source_no", "part")
             .mapInPandas(_slots(seed), "source_no long, shard long, slot long, block long"))
    described = sizes.join(targets, "source_key").select("row_key", "doc_id", "source", "size", "source_size", "target")
    return described, pieces, slots


def text_key() -> Column:
    """With doc_id the key of a row's text; rows alike in both are alike in all that is taken from them."""
    return F.xxhash64("source", "text").alias("text_key")


def write_shards(docs: DataFrame, pieces: DataFrame, slots: DataFrame, waves: int = WAVES) -> DataFrame:
    """The mix, written in the shared folder by shard and read again: source_no, slot, words (of the slot's block, joined by one
    space), of (row_key and number of words of each piece, in order), shard."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    # Both sides grow with the input. Sizes after Python are guesses, so the planner is told not to broadcast.
    placed = scratch.keep(pieces.join(slots.hint("merge"), ["source_no", "block"]).drop("block"), "placed")
    # Plain columns without nulls as the key (the text's hash covers the source, another key apart): texts are shuffled by it once, for
    # the join and for taking one of the rows alike in id and text, which hold their pieces together.
    whole = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none")]
    wanted = placed.groupBy(*whole, "text_key").agg(F.collect_list(
        F.struct("row_key", "source_no", "shard", "slot", "at", "first", "words")).alias("pieces"))
    texts = docs.select(*whole, text_key(), "text").where(word_count(F.col("text")) > 0)
    key = ["id", "none", "text_key"]
    rows = texts.join(wanted.hint("merge"), key).dropDuplicates(key)

    def cut(own: Column) -> Column:
        part = lambda p: F.slice(own, (p["first"] + 1).cast("int"), p["words"].cast("int"))
        return F.transform("pieces", lambda p: F.struct(
            *[p[c].alias(c) for c in ("row_key", "source_no", "shard", "slot", "at")],
            F.size(part(p)).cast("long").alias("n"), F.array_join(part(p), " ").alias("words")))

    cuts = rows.select(F.inline(F.flatten(F.transform(F.array(words(F.col("text"))), cut))))
    parts, path = fresh_path(spark, "mix-cuts"), fresh_path(spark, "mix-shards")
    cuts.withColumn("wave", F.col("shard") % waves).write.option("compression", "zstd").partitionBy("wave").parquet(parts)
    spark.sparkContext._jvm.System.gc()  # as in keep
    scratch.drop("placed")
    of_wave = spark.read.schema(cuts.schema.add("wave", "long")).parquet(parts)
    for wave in range(waves):
        dealt = of_wave.where(F.col("wave") == wave).repartition("shard").groupBy("shard", "source_no", "slot").agg(
            F.array_sort(F.collect_list(F.struct("at", "row_key", "n", "words"))).alias("all"))
        out = dealt.select("source_no", "slot", F.array_join("all.words", " ").alias("words"),
                           F.transform("all", lambda p: F.struct(p["row_key"].alias("row_key"), p["n"].alias("n"))).alias("of"), "shard")
        out.write.mode("append").option("compression", "zstd").partitionBy("shard").parquet(path)
        spark.sparkContext._jvm.System.gc()
        scratch.paths["wave"] = f"{parts}/wave={wave}"
        scratch.drop("wave")
    return spark.read.schema(out.schema).parquet(path)


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row_key"), *columns)


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken.

    size counts words (null: 0), source_size sums them, target is the source's share of the mix, taken the words of this row
    that the written mix holds, repeats counted; rows without words take none. Rows that repeat a doc_id count as rows of their own.
    A null source is a source. Columns other than doc_id, source and text are not read. An empty input gives an empty result.
    """
    sizes, pieces, slots = plan(keyed(docs, "doc_id", "source", "text"), share, most, seed)
    written = write_shards(docs, pieces, slots)
    taken = written.select(F.inline("of")).groupBy("row_key").agg(F.sum("n").alias("taken"))
    return sizes.join(taken, "row_key", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mix_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The mix itself with the columns of docs: each row's text is the words taken from it, a block taken twice standing twice.

    Unlike in mix(), no shards are written: a later stage gets whole documents. Words are joined by one space and n_chars, where there is such a column, is counted anew. Rows of which nothing is taken
    (also null and empty texts) leave. The mix is as large as `share` of the input.
    """
    rows = keep(docs.withColumn("tidemark_row", F.monotonically_increasing_id()), "mix-rows")
    _, pieces, slots = plan(rows.select(F.col("tidemark_row").alias("row_key"), "doc_id", "source", "text"), share, most, seed)
    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    by_row = pieces.join(times.hint("merge"), ["source_no", "block"]).groupBy(F.col("row_key").alias("tidemark_of")).agg(
        F.array_sort(F.collect_list(F.struct("first", "words", "times"))).alias("tidemark_pieces"))
    text = F.array_join(F.flatten(F.transform("tidemark_pieces", lambda p: F.flatten(F.array_repeat(
        F.slice("tidemark_words", (p["first"] + 1).cast("int"), p["words"].cast("int")), p["times"].cast("int"))))), " ")
    mixed = (rows.join(by_row.hint("merge"), F.col("tidemark_row") == F.col("tidemark_of"))
             .withColumn("tidemark_words", words(F.col("text"))).withColumn("text", text))
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(*docs.columns)
