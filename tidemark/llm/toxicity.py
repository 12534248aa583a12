"""Toxicity: a convolutional text classifier in numpy.

A word is the sum of two hashed embeddings, of the word and of its first four bytes (so unseen forms of a known stem still tell).
Filters of widths 1, 2 and 3 slide over the words, each keeps its maximum over the whole text, and a linear layer makes the score.
All labelled rows teach: they are dealt into groups of about GROUP_ROWS by a hash of their id, each group is learned in a task from
the common weights, and the changes are averaged, number by number over the groups that changed it, before the next round. Scoring
is one pass over all texts with the weights as a broadcast of fixed size. The score is calibrated on rows kept out of the fit, and a
threshold is set for each language on the same rows; both from sums that Spark makes. Only weights and sums come to the driver.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import wordhash
from tidemark.llm.common import keep
from tidemark.operators.ordering import running_totals

WORD_ROWS, STEM_ROWS, STEM_BYTES, WIDTH, FILTERS, WIDTHS = 1 << 15, 1 << 13, 4, 16, 16, (1, 2, 3)
#: Rows of a group, epochs where one group is all, and rounds of an epoch each where there are more.
GROUP_ROWS, EPOCHS, ROUNDS = 6000, 8, 6
#: One row in so many calibrates and is not learned.
CALIBRATION = 5
#: Bits of the table of labelled ids, and of one of its rows; it is of this size whatever the input.
ID_BITS, ID_WORD = 24, 6
#: Changes travel and are added in blocks of this many numbers; those of this many groups first.
WEIGHT_BLOCK, WEIGHT_TREE = 1 << 14, 64
#: Places of a long text that are convolved at a time.
PLACES = 1 << 16
#: Share of words whose own embedding is left out in training, so stems learn to tell alone.
WORD_DROPOUT = 0.4
THRESHOLD = 0.7
_TABLE = wordhash.separators(wordhash.PUNCTUATION)
_PAD = max(WIDTHS) - 1


@dataclass
class Model:
    words: np.ndarray
    stems: np.ndarray
    filters: list[np.ndarray]  # (width, WIDTH, FILTERS) each
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def parameters(self) -> list[np.ndarray]:
        return [self.words, self.stems, *self.filters, *self.biases, self.out]

    def flat(self) -> np.ndarray:
        return np.concatenate([*(p.ravel() for p in self.parameters()), [self.bias]]).astype(np.float64)

    def add(self, change: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p += change[at:at + p.size].reshape(p.shape).astype(np.float32)
            at += p.size
        self.bias += float(change[at])


def fresh(seed: int) -> Model:
    rng = np.random.default_rng(seed)

    def normal(*shape, by):
        return (rng.standard_normal(shape) * by).astype(np.float32)

    words = np.vstack([normal(WORD_ROWS, WIDTH, by=0.1), np.zeros((1, WIDTH), np.float32)])  # the last row: a word left out
    return Model(words, normal(STEM_ROWS, WIDTH, by=0.1),
                 [normal(w, WIDTH, FILTERS, by=(2 / (w * WIDTH)) ** 0.5) for w in WIDTHS],
                 [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(FILTERS * len(WIDTHS), by=0.1), 0.0)


def features(column: pa.Array, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word rows, stem rows and which places are words, each text followed by padding; and the first place of each text."""
    words = wordhash.Words(column, begin, end, _TABLE, lower=True)
    counts = np.diff(words.bounds)
    first = words.bounds[:-1] + _PAD * np.arange(end - begin)
    at = np.arange(len(words.starts)) + np.repeat(_PAD * np.arange(end - begin), counts)
    n = len(words.starts) + _PAD * (end - begin)
    word, stem, real = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    word[at] = words.hashes() % np.uint64(WORD_ROWS)
    stem[at] = words.hashes(STEM_BYTES) % np.uint64(STEM_ROWS)
    real[at] = True
    return word, stem, real, first


def convolve(model: Model, word, stem, real) -> list[np.ndarray]:
    """Rectified filter responses at every place; zero at padding."""
    x = model.words[word] + model.stems[stem]
    x[~real] = 0
    out = []
    for filters, bias in zip(model.filters, model.biases):
        y = x @ filters[0]
        for j in range(1, len(filters)):
            y[:-j] += x[j:] @ filters[j]
        y += bias
        np.maximum(y, 0, out=y)
        y[~real] = 0
        out.append(y)
    return out


def pool(model: Model, word, stem, real) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best response of each filter over one text and the first place that has it; PLACES at a time, however long the text."""
    best, where = None, None
    for a in range(0, len(word), PLACES):
        parts = [y[:PLACES] for y in convolve(model, *(x[a:a + PLACES + _PAD] for x in (word, stem, real)))]
        each = [y.argmax(axis=0) for y in parts]
        at, top = np.concatenate(each), np.concatenate([y[x, np.arange(FILTERS)] for x, y in zip(each, parts)])
        if best is None:
            best, where = top, at
        else:
            where = np.where(top > best, a + at, where)
            best = np.maximum(best, top)
    return best, np.split(where, len(WIDTHS))


def logits(model: Model, column: pa.Array, begin: int, end: int) -> np.ndarray:
    word, stem, real, first = features(column, begin, end)
    if end - begin == 1:
        return (pool(model, word, stem, real)[0] @ model.out + model.bias).reshape(1)
    pooled = [np.maximum.reduceat(y, first, axis=0) for y in convolve(model, word, stem, real)]
    return np.concatenate(pooled, axis=1) @ model.out + model.bias


def score_column(model: Model, column: pa.Array) -> np.ndarray:
    """Calibrated scores of all rows; null counts as empty."""
    parts = [logits(model, column, a, b) for a, b in wordhash.slices(column, 1 << 20)]
    z = np.concatenate(parts) if parts else np.empty(0)
    return 1 / (1 + np.exp(-np.clip(model.scale * z.astype(float) + model.shift, -40, 40)))


def _sum_rows(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(at, kind="stable")
    rows, first = np.unique(at[order], return_index=True)
    return rows, np.add.reduceat(values[order], first, axis=0) if len(rows) else values


def train(model: Model, rows: list, labels: np.ndarray, share: float, epochs: int = EPOCHS, batch: int = 32, rate: float = 2e-3, seed: int = 0) -> None:
    """Adam on the log loss, both labels weighing alike (share: that of label 1 among all rows). Max pooling sends each filter's
    gradient to one place of a text. The rows are their words, stems and places as in `features`; the model changes in place."""
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in model.parameters()]
    bias_moments, step = [0.0, 0.0], 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            grads = [np.zeros_like(p) if i > 1 else None for i, p in enumerate(model.parameters())]
            bias_grad, picked, touched = 0.0, order[at:at + batch], []
            for i in picked:
                word, stem, real = rows[i]
                word = np.where(rng.random(len(word), np.float32) < WORD_DROPOUT, WORD_ROWS, word)
                pooled, where = pool(model, word, stem, real)
                p = 1 / (1 + np.exp(-(pooled @ model.out + model.bias)))
                slope = np.float32((p - labels[i]) * weight[i] / len(picked))
                grads[-1] += slope * pooled
                bias_grad += slope
                back = slope * model.out * (pooled > 0)
                for k, width in enumerate(WIDTHS):
                    own = back[k * FILTERS:(k + 1) * FILTERS]
                    grads[2 + len(WIDTHS) + k] += own
                    # Only a filter with a response has its place at a word; a text without words has no place to look at.
                    told = np.flatnonzero(own)
                    for j in range(width):
                        used = told[real[where[k][told] + j]]
                        if len(used):
                            place = where[k][used] + j
                            at_word, at_stem, by = word[place], stem[place], own[used]
                            grads[2 + k][j, :, used] += by[:, None] * (model.words[at_word] + model.stems[at_stem])
                            touched.append((at_word, at_stem, by[:, None] * model.filters[k][j][:, used].T))
            if touched:
                at_word, at_stem, to = (np.concatenate(x) for x in zip(*touched))
                own_word = at_word != WORD_ROWS  # the row of words left out stays zero
                sums = [_sum_rows(at_word[own_word], to[own_word]), _sum_rows(at_stem, to)]
            step += 1
            correct = rate * (1 - 0.999 ** step) ** 0.5 / (1 - 0.9 ** step)
            for i, (p, (m, v)) in enumerate(zip(model.parameters(), moments)):
                if i < 2:  # embeddings: only the rows that were touched
                    if touched and len(sums[i][0]):
                        at_rows, g = sums[i]
                        m[at_rows] = 0.9 * m[at_rows] + 0.1 * g
                        v[at_rows] = 0.999 * v[at_rows] + 0.001 * g * g
                        p[at_rows] -= correct * m[at_rows] / (np.sqrt(v[at_rows]) + 1e-8)
                else:
                    m += 0.1 * (grads[i] - m)
                    v += 0.001 * (grads[i] ** 2 - v)
                    p -= correct * m / (np.sqrt(v) + 1e-8)
            bias_moments = [0.9 * bias_moments[0] + 0.1 * bias_grad, 0.999 * bias_moments[1] + 0.001 * bias_grad ** 2]
            model.bias -= float(correct * bias_moments[0] / (bias_moments[1] ** 0.5 + 1e-8))


def _changes(weights, share: float, epochs: int, seed: int):
    """Rows (part, toxic, text), each part in one stretch, to what learning each part changes, in blocks."""

    def learned(part: int, rows: list, labels: list) -> Iterator[pa.RecordBatch]:
        model = Model(**copy.deepcopy(weights.value))
        before = model.flat()
        train(model, rows, np.array(labels, np.float32), share, epochs, seed=seed + part)
        change = model.flat() - before
        change = np.concatenate((change, np.zeros(-len(change) % WEIGHT_BLOCK))).reshape(-1, WEIGHT_BLOCK)
        used = np.flatnonzero(change.any(axis=1))
        packed = [_pack(change[i], (change[i] != 0).astype(np.int32)) for i in used]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), part // WEIGHT_TREE)), pa.array(np.full(len(used), part)),
                                          pa.array(packed, pa.binary())], names=["block", "near", "part", "change"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, labels = None, [], []
        for batch in batches:
            column = batch.column(2)
            for i, (part, toxic) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if part != at:
                    if rows:
                        yield from learned(at, rows, labels)
                    at, rows, labels = part, [], []
                word, stem, real, _ = features(column, i, i + 1)
                rows.append((word.astype(np.int32), stem.astype(np.int16), real))
                labels.append(toxic)
        if rows:
            yield from learned(at, rows, labels)

    return run


def _pack(total: np.ndarray, groups: np.ndarray) -> bytes:
    return zlib.compress(total.tobytes() + groups.tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(packed)
    return np.frombuffer(data, np.float64, WEIGHT_BLOCK), np.frombuffer(data, np.int32, WEIGHT_BLOCK, 8 * WEIGHT_BLOCK)


def _add_changes(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total, groups = np.zeros(WEIGHT_BLOCK), np.zeros(WEIGHT_BLOCK, np.int32)
    for packed in rows.sort_values("part")["change"]:
        one, of = _unpack(packed)
        total, groups = total + one, groups + of
    return pd.DataFrame({"block": [key[0]], "near": [0], "part": [rows["part"].min()], "change": [_pack(total, groups)]})


def learn(taught: DataFrame, groups: int, share: float, seed: int = 0) -> Model:
    """The model learned from the rows part, toxic, text of a kept table whose parts are one stretch of one file each."""
    model = fresh(seed)
    shape = "block long, near long, part long, change binary"
    rows = taught.select(F.col("part").cast("long"), "toxic", "text")
    for number in range(1 if groups == 1 else ROUNDS):
        weights = taught.sparkSession.sparkContext.broadcast(vars(model))
        parts = rows.mapInArrow(_changes(weights, share, EPOCHS if groups == 1 else 1, seed + number * 1_000_003), shape)
        near = parts.groupBy("block", "near").applyInPandas(_add_changes, shape)
        change = np.zeros((-(-len(model.flat()) // WEIGHT_BLOCK), WEIGHT_BLOCK))
        for block, _, _, packed in near.groupBy("block").applyInPandas(_add_changes, shape).collect():
            total, of = _unpack(packed)
            change[block] = total / np.maximum(of, 1)
        model.add(change.ravel())
        weights.destroy()
    return model


def calibrate(model: Model, held: DataFrame) -> None:
    """Scale and shift of the score: regularised logistic fit of the held-back labels on the logit z, both labels weighing alike.

    Newton's method; each step is one row of sums over all rows.
    """
    n, ones = held.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if ones in (0, n):
        return
    z, a, b = F.col("z"), 1.0, 0.0
    weight = F.when(F.col("toxic") == 1, 0.5 / ones).otherwise(0.5 / (n - ones))
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.least(F.greatest(a * z + b, F.lit(-40.0)), F.lit(40.0))))
        g, h = weight * (p - F.col("toxic")), weight * F.greatest(p * (1 - p), F.lit(1e-6))
        gz, g1, hzz, hz, h1 = held.agg(F.sum(g * z), F.sum(g), F.sum(h * z * z), F.sum(h * z), F.sum(h)).first()
        step = np.linalg.solve(np.array([[hzz + 1e-3, hz], [hz, h1 + 1e-3]]), np.array([gz + 1e-3 * (a - 1), g1 + 1e-3 * b]))
        a, b = float(a - step[0]), float(b - step[1])
        if np.abs(step).max() < 1e-9:
            break
    model.scale, model.shift = max(a, 1e-3), b


def language_thresholds(scored: DataFrame, default: float = THRESHOLD) -> dict[str, float]:
    """The threshold with the best F1 on all rows of each language (lang, score, toxic); of equal ones the nearest to the default.

    A threshold is the middle between two neighbouring scores, or the default. Languages with one label only keep the default.
    """
    values = scored.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("toxic").alias("ones"))
    whole = {r.lang: r for r in scored.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("ones"), F.min("score").alias("low"),
             F.count_if(F.col("score") >= default).alias("said"), F.sum(F.when(F.col("score") >= default, F.col("toxic")).otherwise(0)).alias("right")).collect()}
    open_ = {k: r for k, r in whole.items() if 0 < r.ones < r.n}
    found = dict.fromkeys(whole, default)
    if not open_:
        return found
    totals = scored.sparkSession.createDataFrame([(k, r.ones, r.low) for k, r in open_.items()], "lang string, positives long, low double")
    run = running_totals(values, [F.desc("score")], {"said": F.col("n"), "right": F.col("ones")}, ("lang",)).join(F.broadcast(totals), "lang")
    f1 = F.round(2 * F.col("right") / (F.col("said") + F.col("positives")), 12)
    best = {r.lang: r.best for r in run.where("score > low").groupBy("lang").agg(
        F.max(F.struct(f1.alias("f1"), (-F.abs(F.col("score") - default)).alias("near"), "score")).alias("best")).collect()}
    cuts = scored.sparkSession.createDataFrame([(k, x.score) for k, x in best.items()], "lang string, cut double")
    below = {r.lang: r.below for r in values.join(F.broadcast(cuts), "lang").where("score < cut").groupBy("lang").agg(F.max("score").alias("below")).collect()}
    for k, x in best.items():
        r = open_[k]
        if x.f1 > round(2 * r.right / max(1, r.said + r.ones), 12):
            found[k] = (x.score + below[k]) / 2
    return found


def fold(doc_id):
    """crc32 of the id as text modulo 3; rows at 1 are held out. A null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def _logits(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**weights.value)
        for batch in batches:
            z = np.concatenate([logits(model, batch.column(2), a, b) for a, b in wordhash.slices(batch.column(2), 1 << 20)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(z.astype(np.float64))], names=["lang", "toxic", "z"])

    return run


def likely_labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs without most rows whose doc_id is not in known, so that their texts need not be shuffled; no row that is in known is lost.

    Hashes of the known ids set bits of a table of fixed size, which goes to all tasks.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS))
    word, place = F.shiftright(bit, ID_WORD), F.pmod(bit, F.lit(1 << ID_WORD)).cast("int")
    table = known.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType)).select(word.alias("word"), place.alias("place")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("bits"))
    near = docs.withColumn("word", word).join(F.broadcast(table), "word")
    return near.where(F.getbit("bits", place) == 1).select(*docs.columns)


def fit(docs: DataFrame, labels: DataFrame, seed: int = 0, group_rows: int = GROUP_ROWS) -> tuple[Model, dict[str, float]]:
    """Model and thresholds by language, from all labelled documents outside the held-out fold, whole texts.

    Null labels and ids teach nothing; of repeated ids one label is used, and each row of that id teaches. One row in CALIBRATION, by a
    hash of the id, calibrates. Without labels the model is untrained. Only texts that a table of fixed size takes to be labelled are shuffled.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id")) != 1).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    groups = max(1, -(-known.count() * (CALIBRATION - 1) // (CALIBRATION * group_rows)))
    hashed = F.xxhash64("doc_id", F.lit(seed))
    part = F.when(F.pmod(hashed, F.lit(CALIBRATION)) == 0, -1).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit("part")), F.lit(groups)))
    taught = docs.where(fold(F.col("doc_id")) != 1).select("doc_id", F.coalesce("text", F.lit("")).cast("string").alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    taught = likely_labelled(taught, known).join(known.hint("merge"), "doc_id").withColumn("part", part.cast("int"))
    # Each group is one partition. Calibrating rows are dealt out by their id: nothing is added up over their order.
    files = max(groups, 8)
    taught = taught.withColumn("deal", F.when(F.col("part") < 0, F.pmod(hashed, F.lit(files))).otherwise(F.col("part")).cast("int"))
    taught = keep(taught.repartitionById(files, F.col("deal")).sortWithinPartitions("part", hashed, "doc_id", F.xxhash64("text")).drop("deal", "doc_id"), "toxicity-taught")
    learned = taught.where("part >= 0")
    n, ones = learned.agg(F.count("*"), F.sum("toxic")).first()
    if not n:
        return fresh(seed), {}
    model = learn(learned, groups, ones / n, seed)
    weights = spark.sparkContext.broadcast(vars(model))
    held = keep(taught.where("part < 0").select("lang", "toxic", "text").mapInArrow(_logits(weights), "lang string, toxic int, z double"), "toxicity-held")
    calibrate(model, held)
    score = 1 / (1 + F.exp(-F.least(F.greatest(model.scale * F.col("z") + model.shift, F.lit(-40.0)), F.lit(40.0))))
    return model, language_thresholds(held.select("lang", "toxic", score.alias("score")))


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**weights.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score_column(model, batch.column(0)))],
                                             names=[*batch.schema.names[1:], "score"])

    return run


def score(docs: DataFrame, model: Model, thresholds: dict[str, float]) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, threshold (of the language), rejected.

    The score comes from the text alone; lang only picks the threshold (0.7 for a null or unknown one). Null texts score as
    empty ones. Columns other than doc_id, text and lang are not read. An empty input gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    scored = rows.mapInArrow(_score(shared), "doc_id long, lang string, score double")
    pairs = [x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))]
    by_language = F.coalesce(F.create_map(*pairs)[F.coalesce("lang", F.lit(""))], F.lit(THRESHOLD)) if pairs else F.lit(THRESHOLD)
    scored = scored.withColumn("threshold", by_language)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("rejected"))


def _keep_clean(weights, thresholds: dict[str, float], text: int, lang: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**weights.value)
        for batch in batches:
            cut = np.array([thresholds.get(x or "", THRESHOLD) for x in batch.column(lang).to_pylist()])
            yield batch.filter(pa.array(score_column(model, batch.column(text)) < cut))

    return run


def keep_clean(docs: DataFrame, model: Model, thresholds: dict[str, float]) -> DataFrame:
    """docs, all columns, without the rows whose score reaches the threshold of their language."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    return docs.mapInArrow(_keep_clean(shared, thresholds, docs.columns.index("text"), docs.columns.index("lang")), docs.schema)
