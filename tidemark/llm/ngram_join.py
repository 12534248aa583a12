"""N-gram Jaccard join: sets of word n-grams, prefix filtering in a rare-first order, each pair verified once.

1. N-grams are counted over all documents in a table of fixed size (hash buckets; 16 MB, whatever the input), which tasks fill and
   which are added in blocks, near ones first. The order of n-grams is by bucket count, then hash: rare first up to bucket
   collisions, and the same total order everywhere, which is all the prefix filter needs.
2. Every document becomes its set size, a 128-bit set key, its prefix and the counts of its set in 256 hash ranges. Equal sets are
   one class from here on and only one row of a class goes on.
3. Prefix n-grams are grouped by hash. One that two classes hold gives a pair. One that more hold is compared in a star with its
   first class. Those whose classes are then still in many components are compared with a few more classes at a time, in rounds
   that go on while each at least halves what is apart. The pairs still across components are compared one by one, so no link
   between components is missed while groups of near copies cost a fixed number of comparisons a member and round. Texts that share
   a rare n-gram without being near copies are not joined up by rounds: they cost all their pairs that pass the filters.
4. Pairs pass the length filter, the positional filter (where the order is known) and a suffix filter (set counts by hash
   range bound the overlap); what remains is distinct and is verified from the texts.
5. Links become components by label propagation with shortcuts.

Sides that grow with the corpus meet in merge joins at every size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordhash
from tidemark.llm.common import Scratch, keep

WORDS, PERCENT = 5, 75
SKETCH_BITS = 22
SKETCH = 1 << SKETCH_BITS
#: Counts travel and are added in blocks of this many; partial tables of this many tasks first.
SKETCH_BLOCK = 1 << 16
SKETCH_TREE = 64
RANGES = 256
#: Rows of an n-gram that all its rows are compared with at a time; with more rows than this outside its largest component it takes such a round.
HEADS = 8
_TABLE = wordhash.separators()
_U = np.uint64
_SETS = "row_key long, doc_id long, text_key long, n long, key_a long, key_b long, prefix array<bigint>, ranges array<smallint>"


def sets_of(column: pa.Array, begin: int, end: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and n-gram hashes of the sets of rows begin..end, sorted by both, distinct.

    A text with fewer words than an n-gram has all its words as its one element, one without words has none.
    """
    words = wordhash.Words(column, begin, end, _TABLE, lower=True)
    counts = np.diff(words.bounds)
    grams = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(end - begin), grams)
    at = np.arange(len(row)) - np.repeat(np.cumsum(grams) - grams, grams) + words.bounds[row]
    hashes = wordhash.Rolling(words.hashes()).windows(at, np.minimum(counts, width)[row])
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    return row[new], hashes[new]


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for a, b in wordhash.slices(batch.column(0)):
                seen, times = np.unique(_buckets(sets_of(batch.column(0), a, b, width)[1]), return_counts=True)
                counts[seen] += times.astype(np.uint32)
        blocks = counts.reshape(-1, SKETCH_BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), TaskContext.get().partitionId() // SKETCH_TREE)),
                                          pa.array([zlib.compress(blocks[i].tobytes(), 1) for i in used], pa.binary())], names=["block", "part", "counts"])

    return run


def _add_counts(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SKETCH_BLOCK, np.uint32)
    for packed in rows["counts"]:
        part = np.frombuffer(zlib.decompress(packed), np.uint32)
        total = np.where(total > ~part, np.uint32(2**32 - 1), total + part)  # a full counter stays full: only the order hangs on it
    return pd.DataFrame({"block": [key[0]], "part": [0], "counts": [zlib.compress(total.tobytes(), 1)]})


def gram_counts(texts: DataFrame, width: int) -> np.ndarray:
    """The table of bucket counts; SKETCH numbers come to the driver."""
    shape = "block long, part long, counts binary"
    parts = texts.select("text").mapInArrow(_sketch(width), shape)
    near = parts.groupBy("block", "part").applyInPandas(_add_counts, shape)
    counts = np.zeros((SKETCH // SKETCH_BLOCK, SKETCH_BLOCK), np.uint32)
    for block, _, packed in near.groupBy("block").applyInPandas(_add_counts, shape).collect():
        counts[block] = np.frombuffer(zlib.decompress(packed), np.uint32)
    return counts.ravel()


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def _sets(sketch, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, key = sketch.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, keys, column = (batch.column(i) for i in range(3))
            for a, b in wordhash.slices(column):
                row, hashes = sets_of(column, a, b, width)
                n = np.bincount(row, minlength=b - a)
                begins = np.cumsum(n) - n
                full = np.flatnonzero(n)
                key_a, key_b = np.zeros(b - a, _U), np.zeros(b - a, _U)
                if len(full):
                    key_a[full] = np.add.reduceat(wordhash.mix(hashes), begins[full])
                    key_b[full] = np.add.reduceat(wordhash.mix(hashes ^ _U(0x9E3779B97F4A7C15)), begins[full])
                ranges = np.bincount(row * RANGES + (hashes >> _U(42)).astype(np.int64) % RANGES, minlength=(b - a) * RANGES)
                order = np.argsort((row << 40) + counts[_buckets(hashes)].astype(np.int64), kind="stable")
                place = np.arange(len(row)) - begins[row]
                take = np.where(n > 0, prefix_length(n, percent), 0)
                prefix = hashes[order][place < take[row]]
                ends = np.concatenate(([0], np.cumsum(take))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + b - a)), ids.slice(a, b - a), keys.slice(a, b - a), pa.array(n.astype(np.int64)),
                     pa.array(key_a.view(np.int64)), pa.array(key_b.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix.view(np.int64))),
                     pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * RANGES), pa.array(np.minimum(ranges, 32767).astype(np.int16)))],
                    names=["row_key", "doc_id", "text_key", "n", "key_a", "key_b", "prefix", "ranges"])
                key += b - a

    return run


def _verify(width: int, percent: int):
    """Rows (a, b, text of a, text of b) to the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            for begin, end in wordhash.slices(right, wordhash.SLICE // 2):
                for a in range(begin, end, 256):  # the left texts may be long
                    b = min(end, a + 256)
                    (row_l, hash_l), (row_r, hash_r) = sets_of(left, a, b, width), sets_of(right, a, b, width)
                    row, hashes = np.concatenate((row_l, row_r)), np.concatenate((hash_l, hash_r))
                    order = np.lexsort((hashes, row))
                    row, hashes = row[order], hashes[order]
                    both = row[1:][(row[1:] == row[:-1]) & (hashes[1:] == hashes[:-1])]
                    shared = np.bincount(both, minlength=b - a)
                    union = np.bincount(row, minlength=b - a) - shared
                    linked = pa.array((100 * shared >= percent * union) & (union > 0))
                    yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a).filter(linked) for i in (0, 1)], names=["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """v, component (smallest vertex reachable) of every vertex of the links a, b.

    Each round gives a vertex the smallest label around it, then the label of that label; ends when nothing changes.
    """
    scratch = Scratch(links.sparkSession, "components")
    edges = scratch.keep(links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w"))), "edges")
    labels = scratch.keep(edges.groupBy("v").agg(F.min("w").alias("low")).select("v", F.least("v", "low").alias("component")), "labels")
    while True:
        around = (edges.join(labels.withColumnsRenamed({"v": "w"}), "w").groupBy("v").agg(F.min("component").alias("low")))
        lower = scratch.keep(labels.join(around, "v").select("v", "component", F.least("component", "low").alias("low")), "lower")
        scratch.drop("labels")
        # The label is a vertex itself: take its label too.
        jumps = lower.select(F.col("v").alias("low"), F.col("low").alias("next"))
        new = scratch.keep(lower.join(jumps, "low").select("v", F.least("low", "next").alias("next"), "component"), "labels")
        scratch.drop("lower")
        changed = new.where("next < component").limit(1).count()
        labels = new.select("v", F.col("next").alias("component"))
        if not changed:
            scratch.drop("edges")
            return labels


def long_enough(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def overlap_needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(percent * (a + b) / (100 + percent) - 1e-9)


class Join:
    """The join over one table of documents; sets and classes are kept tables. Each table goes once it has been used up."""

    def __init__(self, docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> None:
        self.width, self.percent = width, percent
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "join")
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
                                 F.coalesce("text", F.lit("")).cast("string").alias("text"))
        shared = self.spark.sparkContext.broadcast(gram_counts(self.texts, width))
        wide = self.scratch.keep(self.texts.mapInArrow(_sets(shared, width, percent), _SETS), "wide")
        self.sets = self.scratch.keep(wide.select("row_key", "doc_id", "text_key", "n", "key_a", "key_b"), "sets")
        self.classes = self.scratch.keep(self.sets.where("n > 0").groupBy("key_a", "key_b", "n").agg(
            F.min("row_key").alias("rep"), F.min("doc_id").alias("first_id"), F.count("*").alias("members")), "classes")
        self.reps = self.scratch.keep(wide.join(self.classes.select("rep").hint("merge"), F.col("row_key") == F.col("rep"), "left_semi")
                                      .select("row_key", "doc_id", "text_key", "n", "prefix", "ranges"), "reps")
        self.scratch.drop("wide")

    def links(self) -> DataFrame:
        """a, b: classes (by the row key of their representative) that link, each pair once; enough of them to give the components.

        To be called once: it uses up the prefixes.
        """
        keep_, drop = self.scratch.keep, self.scratch.drop
        prefixes = self.reps.select("row_key", "n", F.posexplode("prefix").alias("place", "gram"))
        grams = keep_(prefixes.groupBy("gram").agg(F.count("*").alias("held"), F.min("row_key").alias("a"), F.max("row_key").alias("b"))
                      .where("held > 1"), "grams")
        many = keep_(prefixes.join(grams.where("held > 2").select(F.col("gram").alias("wanted")).hint("merge"), F.col("gram") == F.col("wanted"), "left_semi"), "many")
        reps = keep_(self.reps.drop("prefix"), "slim")
        drop("reps")
        heads = keep_(many.groupBy("gram").agg(F.min(F.struct("row_key", "n", "place")).alias("head")), "heads")
        star = many.join(heads.hint("merge"), "gram").where("row_key != head.row_key").where(self._may_link("n", "place", "head.n", "head.place"))
        pairs = self._filtered(grams.where("held = 2").select("a", "b").unionByName(star.select(F.col("head.row_key").alias("a"), F.col("row_key").alias("b"))), reps)
        pairs = keep_(pairs, "pairs-0")
        drop("grams", "heads")
        self.found = ["first"]
        links = self._verified(pairs, reps, "first")
        left = self._apart(many, links, "left-0")
        drop("many")
        # Groups that are still in many components: heads at a time against all, as long as that joins them up.
        before, number = None, 0
        while True:
            wide = left.where(F.col("minor") > HEADS)
            todo = wide.agg(F.sum("minor")).first()[0] or 0
            if not todo or before and 2 * todo > before:
                break
            before, number = todo, number + 1
            new = keep_(self._filtered(self._headed(wide, number).join(pairs, ["a", "b"], "left_anti"), reps), f"headed-{number}")
            self.found.append(f"more-{number}")
            links = links.unionByName(self._verified(new, reps, f"more-{number}"))
            pairs = keep_(pairs.unionByName(new), f"pairs-{number}")
            left = self._apart(left.drop("component", "big", "minor"), links, f"left-{number}")
            drop(f"headed-{number}", f"pairs-{number - 1}", f"left-{number - 1}")
        # What is left: all pairs across components. Rows of a gram's largest component meet those of the others only. All filters stand
        # in the join on the n-gram itself, so that no pair that fails one becomes a row.
        left = left.join(reps.select("row_key", "ranges").hint("merge"), "row_key")
        other = left.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("row_key", "n", "place", "component", "ranges")])
        once = (F.col("component_b") == F.col("big")) | (F.col("row_key") < F.col("row_key_b"))
        across = left.where("component != big").join(other, "gram").where("component != component_b").where(once).where(self._may_link("n", "place", "n_b", "place_b"))
        across = across.where(self._may_overlap("n", "ranges", "n_b", "ranges_b"))
        across = across.select(F.least("row_key", "row_key_b").alias("a"), F.greatest("row_key", "row_key_b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
        across = keep_(across, "across")
        drop(f"left-{number}", f"pairs-{number}")
        self.found.append("last")
        links = links.unionByName(self._verified(across, reps, "last"))
        drop("across", "slim")
        return links

    def _apart(self, held: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Rows of the n-grams whose classes the links leave in several components, with component, the largest one of the n-gram (big)
        and how many rows are outside it (minor)."""
        placed = self.scratch.keep(held.join(components(links).withColumnRenamed("v", "row_key"), "row_key", "left")
                                   .withColumn("component", F.coalesce("component", "row_key")), "placed")
        sizes = placed.groupBy("gram", "component").agg(F.count("*").alias("c")).groupBy("gram").agg(
            F.max(F.struct("c", "component")).alias("most"), F.sum("c").alias("members"))
        sizes = sizes.select("gram", F.col("most.component").alias("big"), (F.col("members") - F.col("most.c")).alias("minor")).where("minor > 0")
        left = self.scratch.keep(placed.join(sizes.hint("merge"), "gram"), name)
        self.scratch.drop("placed")
        return left

    def _headed(self, wide: DataFrame, number: int) -> DataFrame:
        """Distinct pairs a < b of each row with up to HEADS rows of each of its n-grams, those of other components that may link.

        Heads go by a hash of the row, so n-grams held by the same rows mostly have the same heads; others in each round.
        """
        order = F.xxhash64("row_key", F.lit(number))
        heads = wide.groupBy("gram", F.pmod(order, F.lit(HEADS)).alias("slot")).agg(F.min(F.struct(order.alias("order"), "row_key", "n", "place", "component")).alias("head"))
        heads = heads.groupBy("gram").agg(F.collect_list("head").alias("heads"))
        fits = F.filter("heads", lambda h: (h["component"] != F.col("component"))
                        & self._may(F.col("n"), F.col("place"), h["n"], h["place"]))
        met = wide.join(heads.hint("merge"), "gram").select("row_key", F.transform(fits, lambda h: h["row_key"]).alias("met")).where("size(met) > 0")
        met = met.groupBy("row_key").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met"))
        met = met.select("row_key", F.explode("met").alias("head"))
        return met.select(F.least("row_key", "head").alias("a"), F.greatest("row_key", "head").alias("b")).distinct()

    def _may_link(self, n: str, place: str, n_b: str, place_b: str) -> Column:
        return self._may(F.col(n), F.col(place), F.col(n_b), F.col(place_b))

    def _may(self, a: Column, place: Column, b: Column, place_b: Column) -> Column:
        """Length filter, and positional filter for the first n-gram a pair shares: what follows it bounds the overlap."""
        most = F.least(a - place, b - place_b)
        return long_enough(a, b, self.percent) & (most >= overlap_needed(a, b, self.percent))

    def _filtered(self, pairs: DataFrame, reps: DataFrame) -> DataFrame:
        """Distinct pairs that pass the length and the suffix filter."""
        slim = reps.select("row_key", "n", "ranges").hint("merge")
        rows = pairs.distinct().join(slim.withColumnsRenamed({"row_key": "a", "n": "n_a", "ranges": "r_a"}), "a")
        rows = rows.join(slim.withColumnsRenamed({"row_key": "b", "n": "n_b", "ranges": "r_b"}), "b").where(long_enough(F.col("n_a"), F.col("n_b"), self.percent))
        return rows.where(self._may_overlap("n_a", "r_a", "n_b", "r_b")).select("a", "b")

    def _may_overlap(self, n: str, ranges: str, n_b: str, ranges_b: str) -> Column:
        """Suffix filter: set counts by hash range bound the overlap."""
        bound = F.aggregate(F.zip_with(ranges, ranges_b, lambda x, y: F.least(x, y).cast("int")), F.lit(0), lambda s, x: s + x)
        bound = F.when(F.array_max(ranges) >= 32767, F.least(n, n_b)).otherwise(bound)  # a count that did not fit bounds nothing
        return bound >= overlap_needed(F.col(n), F.col(n_b), self.percent)

    def _verified(self, pairs: DataFrame, reps: DataFrame, name: str) -> DataFrame:
        keep_, drop = self.scratch.keep, self.scratch.drop
        wanted = keep_(pairs.select(F.col("a").alias("row_key")).union(pairs.select("b")).distinct()
                       .join(reps.select("row_key", "doc_id", "text_key").hint("merge"), "row_key").withColumnsRenamed({"doc_id": "id", "text_key": "key"}), "wanted")
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
        texts = keep_(self.texts.join(wanted.hint("merge"), same).select("row_key", "text").dropDuplicates(["row_key"]), "texts")
        drop("wanted")
        rows = pairs.join(texts.withColumnsRenamed({"row_key": "b", "text": "text_b"}).hint("merge"), "b")
        rows = rows.join(texts.withColumnsRenamed({"row_key": "a", "text": "text_a"}).hint("merge"), "a").select("a", "b", "text_a", "text_b")
        links = keep_(rows.mapInArrow(_verify(self.width, self.percent), "a long, b long"), name)
        drop("texts")
        return links

    def result(self) -> DataFrame:
        keep_, drop = self.scratch.keep, self.scratch.drop
        parts = components(self.links())
        drop(*self.found)
        named = keep_(self.classes.join(parts.withColumnsRenamed({"v": "rep"}), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "named")
        drop("classes")
        lowest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
        answer = keep_(named.join(keep_(lowest, "lowest"), "component").select("key_a", "key_b", "n", "component_id", "component"), "answer")
        drop("named", "lowest")
        rows = self.sets.drop("row_key").join(answer.hint("merge"), ["key_a", "key_b", "n"], "left")
        return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                           "text_key", "component")


def jaccard_join(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (distinct n-grams of lower-cased words), component_id.

    Rows link when 100 * intersection >= percent * union of their sets; component_id is the smallest doc_id reachable. Texts with
    fewer words than an n-gram are one element; null and wordless texts have none and keep their own id. Repeated rows are one
    class. Null ids are passed over for component_id unless a component has no other. Other columns are not read. An empty
    input gives an empty result.
    """
    return Join(docs, width, percent).result().drop("text_key", "component")


def keep_one(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each component: that of the smallest doc_id (null last, then by a hash of the text).

    Rows go by id and text together, so a text unlike the others stays under whatever id. Of rows alike in both one stays, any of them.
    Rows without words all stay. An empty input gives an empty result; columns may have any names but tidemark_id, tidemark_key,
    tidemark_stays and tidemark_text.
    """
    rows = Join(docs, width, percent).result().where("n_shingles > 0")
    places = keep(rows.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("times")), "join-places")
    best = places.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best"))
    marked = places.join(best.hint("merge"), "component").withColumn(
        "stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")))
    act = keep(marked.where("not stays or times > 1").select(F.col("doc_id").alias("tidemark_id"), F.col("text_key").alias("tidemark_key"),
                                                             F.col("stays").alias("tidemark_stays")), "join-act")
    keyed = docs.withColumn("tidemark_text", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("tidemark_id")) & (F.col("tidemark_text") == F.col("tidemark_key"))
    single = keyed.join(act.hint("merge"), same, "left_anti").select(*docs.columns)
    repeated = keyed.join(act.where("tidemark_stays"), same).groupBy("tidemark_id", "tidemark_key").agg(F.first(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(repeated.select("row.*"))
