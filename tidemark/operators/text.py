"""Term features over coded-event descriptions and plain text."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.calendar import month_start
from tidemark.operators.events import in_window, snapshots_by_entity, step_of
from tidemark.operators.ordering import attach

WORD = r"[\p{L}\p{N}_]+"  # fixed value: a token is a run of letters, digits and underscores


def terms(text: Column, stop_words: list[str] = ()) -> Column:
    """Lower-cased words without stop words, followed by their bigrams; the whole text is used."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(*stop_words))
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, pairs)


def document_codes(rows: DataFrame, doc: list[str], codes: str, event: str, date: str) -> DataFrame:
    """Per document and code of `codes`, an array of (FAMILY, CODE): EVENTS (distinct ids), NULL_EVENT_ROWS, LAST_EVENT.

    Rows are reduced to distinct events before they are counted. An event without an id is no event but is reported.
    """
    keys = [*doc, "FAMILY", "CODE"]
    each = rows.select(*doc, event, date, F.inline(codes)).filter("trim(CODE) <> ''")
    once = each.groupBy(*keys, event).agg(F.count("*").alias("_n"), F.max(date).alias("_d"))
    return once.groupBy(*keys).agg(F.count(event).alias("EVENTS"), F.sum(F.when(F.col(event).isNull(), F.col("_n")).otherwise(0)).alias("NULL_EVENT_ROWS"),
                                   F.max("_d").alias("LAST_EVENT"))


def document_coverage(rows: DataFrame, documents: DataFrame, doc: list[str], event: str, date: str) -> DataFrame:
    """The same three numbers per document, whatever its codes; documents without rows have 0 events."""
    once = rows.groupBy(*doc, event).agg(F.count("*").alias("_n"), F.max(date).alias("_d"))
    seen = once.groupBy(*doc).agg(F.count(event).alias("EVENTS"), F.sum(F.when(F.col(event).isNull(), F.col("_n")).otherwise(0)).alias("NULL_EVENT_ROWS"),
                                  F.max("_d").alias("LAST_EVENT"))
    return documents.select(*doc).join(seen, doc, "left").fillna(0, ["EVENTS", "NULL_EVENT_ROWS"])


def text_terms(texts: DataFrame, text: str, stop_words: list[str] = ()) -> DataFrame:
    """Terms of each distinct text, with their repeats _k."""
    return texts.select(text).distinct().withColumn("TERM", F.explode(terms(F.col(text), stop_words))).groupBy(text, "TERM").agg(F.count("*").alias("_k"))


def weighted_terms(rows: DataFrame, doc: list[str], text: str, weight: str, stop_words: list[str] = (), names: DataFrame | None = None) -> DataFrame:
    """Event-weighted term counts per document. Each distinct description is tokenised once.

    `names`: text_terms of all texts, where the caller knows them without a pass over the rows.
    """
    names = text_terms(rows, text, stop_words) if names is None else names
    return rows.join(names, text).groupBy(*doc, "TERM").agg(F.sum(F.col(weight) * F.col("_k")).alias("TF"))


def vocabulary(counts: DataFrame, doc: list[str], documents: DataFrame, max_terms: int) -> DataFrame:
    """Most frequent terms (ties by term) with document frequency and smoothed IDF ln((1+n)/(1+df)) + 1.

    `counts` and `documents` hold the training part only.
    """
    top = counts.groupBy("TERM").agg(F.sum("TF").alias("FREQUENCY"), F.count("*").alias("DF")).orderBy(F.desc("FREQUENCY"), "TERM").limit(max_terms)
    n = documents.select(*doc).distinct().agg(F.count("*").alias("DOCS"))
    return attach(top, n, []).withColumn("IDF", F.ln((1 + F.col("DOCS")) / (1 + F.col("DF"))) + 1)


def tfidf(counts: DataFrame, vocab: DataFrame, doc: list[str]) -> DataFrame:
    """Sublinear TF-IDF, scaled to unit length per document (a window holds at most the vocabulary)."""
    raw = counts.join(vocab.select("TERM", "IDF"), "TERM").withColumn("_x", (1 + F.ln("TF")) * F.col("IDF"))
    norm = F.sqrt(F.sum(F.col("_x") * F.col("_x")).over(W.partitionBy(*doc)))
    return raw.select(*doc, "TERM", (F.col("_x") / norm).alias("TFIDF"))


def fan_out(grid: DataFrame, values: DataFrame) -> DataFrame:
    """Document values on every (snapshot, step) that refers to the document."""
    return grid.join(values, ["PATIENT_ID", "AS_OF_DATE"])


def fan_out_by_entity(values: DataFrame, snapshots: DataFrame, steps: int = 12) -> DataFrame:
    """fan_out on the month-end grid, without the grid: one row per document meets the array of its entity's snapshots.

    values: one row per (PATIENT_ID, AS_OF_DATE) and further columns. The result stays partitioned by entity. A snapshot refers to the
    document of its cutoff and to those of the month ends in its window.
    """
    day = F.col("AS_OF_DATE")
    joined = values.join(snapshots_by_entity(snapshots.select("PATIENT_ID", "END_DT"), steps), "PATIENT_ID")
    own = F.filter(in_window(day), lambda s: (day == s["END_DT"]) | ((day == F.last_day(day)) & (day < month_start(s["END_DT"]))))
    rows = joined.withColumn("END_DT", F.explode(F.transform(own, lambda s: s["END_DT"])))
    return rows.select("PATIENT_ID", "END_DT", step_of("AS_OF_DATE").alias("TIME_STEP"), *[c for c in values.columns if c != "PATIENT_ID"])


def salience(positions: DataFrame, snapshots: DataFrame, steps: int = 12) -> DataFrame:
    """Mean TF-IDF over all positions, zeros included, and number of non-zero positions per term."""
    n = snapshots.agg(F.count("*").alias("_s"))
    g = positions.groupBy("TERM").agg(F.sum("TFIDF").alias("_t"), F.count("*").alias("NONZERO_POSITIONS"))
    return attach(g, n, []).select("TERM", (F.col("_t") / (F.col("_s") * steps)).alias("MEAN_TFIDF"), "NONZERO_POSITIONS")


def trend(positions: DataFrame, snapshots: DataFrame, steps: int = 12) -> DataFrame:
    """Coverage, mean absolute monthly change and recent-minus-early level on the dense grid.

    Absent months are zeros; a month without its neighbour contributes its own value to that change.
    A window holds at most `steps` rows of one snapshot and term.
    """
    w = W.partitionBy("PATIENT_ID", "END_DT", "TERM").orderBy("TIME_STEP")
    s, x = F.col("TIME_STEP"), F.col("TFIDF")
    newer, older = F.lag("TIME_STEP").over(w), F.lead("TIME_STEP").over(w)
    r = positions.select("PATIENT_ID", "END_DT", "TERM", "TIME_STEP", "TFIDF", newer.alias("a"), older.alias("b"), F.lead("TFIDF").over(w).alias("y"))
    down = F.when(F.col("b") == s + 1, F.abs(x - F.col("y"))).when(s < steps - 1, x).otherwise(0.0)
    up = F.when((s > 0) & ((F.col("a").isNull()) | (F.col("a") < s - 1)), x).otherwise(0.0)
    per = r.groupBy("PATIENT_ID", "END_DT", "TERM").agg(
        F.sum(down + up).alias("c"), F.sum(F.when(s < 3, x).otherwise(0.0)).alias("n"), F.sum(F.when(s >= steps - 3, x).otherwise(0.0)).alias("o"), F.count("*").alias("m"))
    g = per.groupBy("TERM").agg(F.count("*").alias("k"), F.sum("m").alias("m"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("o").alias("o"))
    return trend_shares(g, snapshots, steps)


def trend_shares(sums: DataFrame, snapshots: DataFrame, steps: int = 12) -> DataFrame:
    """The columns of `trend` from the sums of each term: snapshots k, months m, changes c, newest n and oldest o levels."""
    n = F.col("_s")
    return attach(sums, snapshots.agg(F.count("*").alias("_s")), []).select(
        "TERM", (100 * F.col("k") / n).alias("SNAPSHOT_COVERAGE_PCT"), (100 * F.col("m") / (n * steps)).alias("MONTH_COVERAGE_PCT"),
        (F.col("c") / (n * (steps - 1))).alias("MEAN_ABS_CHANGE"), ((F.col("n") - F.col("o")) / (n * 3)).alias("RECENT_MINUS_EARLY"))


#: Texts times vocabulary terms that go to the tasks as one matrix; larger dictionaries are joined. Numbers of the arrays a task works on.
MATRIX_NUMBERS, WORK_NUMBERS = 4_000_000, 500_000


@dataclass
class TermMatrix:
    """Repeats of each vocabulary term in each text that has one, and the terms' IDF."""

    texts: list[str]
    terms: list[str]
    repeats: np.ndarray  # texts x terms
    idf: np.ndarray


def term_matrix(names: DataFrame, vocab: DataFrame, text: str) -> TermMatrix | None:
    """From the few `text_terms` of a dictionary and a bounded vocabulary; None where the matrix were too large to send."""
    chosen = {r.TERM: r.IDF for r in vocab.select("TERM", "IDF").collect()}
    used = names.filter(F.col("TERM").isin(list(chosen)))
    texts = used.select(text).distinct()
    if texts.limit(MATRIX_NUMBERS // max(1, len(chosen)) + 1).count() > MATRIX_NUMBERS // max(1, len(chosen)):
        return None
    rows = used.collect()
    terms, own = sorted(chosen), sorted({r[text] for r in rows})
    repeats = np.zeros((len(own), len(terms)))
    at, column = {x: i for i, x in enumerate(own)}, {x: i for i, x in enumerate(terms)}
    for r in rows:
        repeats[at[r[text]], column[r.TERM]] += r["_k"]
    return TermMatrix(own, terms, repeats, np.array([chosen[x] for x in terms], float))


def month_documents(documents: DataFrame, snapshots: DataFrame, steps: int = 12) -> DataFrame:
    """(PATIENT_ID, END_DT, DOCS): the documents of each snapshot with their TIME_STEP and ITEMS, arrays of (text, weight)."""
    rows = fan_out_by_entity(documents.select("PATIENT_ID", "AS_OF_DATE", "ITEMS"), snapshots, steps)
    return rows.groupBy("PATIENT_ID", "END_DT").agg(F.collect_list(F.struct("TIME_STEP", "ITEMS")).alias("DOCS"))


def _levels(matrix: TermMatrix, batch: pa.RecordBatch, steps: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of `month_documents` in pieces, with the TF-IDF of their documents: piece x step x term, 0 where the document has not the term."""
    texts, (size, terms) = pa.array(matrix.texts, pa.string()), matrix.repeats.shape
    piece = max(1, WORK_NUMBERS // (steps * max(1, size, terms)))
    for first in range(0, batch.num_rows, piece):
        part = batch.slice(first, piece)
        docs = part.column("DOCS")
        step, items = docs.flatten().flatten()
        text, weight = items.flatten().flatten()
        place = pc.fill_null(pc.index_in(text, texts), -1).to_numpy(zero_copy_only=False)
        own = np.repeat(np.arange(len(items)), pc.list_value_length(items).to_numpy(zero_copy_only=False))
        used = place >= 0
        weights = np.zeros((len(items), size))
        np.add.at(weights, (own[used], place[used]), weight.to_numpy(zero_copy_only=False)[used])
        tf = weights @ matrix.repeats
        x = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * matrix.idf, 0.0)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        out = np.zeros((part.num_rows, steps, terms))
        row = np.repeat(np.arange(part.num_rows), pc.list_value_length(docs).to_numpy(zero_copy_only=False))
        out[row, step.to_numpy(zero_copy_only=False)] = x / np.where(norm > 0, norm, 1)
        yield part, out


def term_summaries(documents: DataFrame, matrix: TermMatrix, steps: int = 12) -> DataFrame:
    """Mean TF-IDF over the steps and share of active steps of each snapshot and term it has, from `month_documents`."""
    shared = documents.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value.terms, pa.string())
        for batch in batches:
            for part, level in _levels(shared.value, batch, steps):
                active = (level > 0).sum(axis=1)
                row, term = np.nonzero(active)
                yield pa.RecordBatch.from_arrays([part.column("PATIENT_ID").take(pa.array(row)), part.column("END_DT").take(pa.array(row)), names.take(pa.array(term)),
                                                  pa.array(level.sum(axis=1)[row, term] / steps), pa.array(active[row, term] / steps)],
                                                 names=["PATIENT_ID", "END_DT", "TERM", "MEAN_12", "ACTIVE_FRACTION"])
    return documents.mapInArrow(run, "PATIENT_ID string, END_DT date, TERM string, MEAN_12 double, ACTIVE_FRACTION double")


def term_trend(documents: DataFrame, matrix: TermMatrix, snapshots: DataFrame, steps: int = 12) -> DataFrame:
    """`trend` from `month_documents`: each task adds up its snapshots, one row a term leaves it."""
    shared = documents.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((5, len(shared.value.terms)))
        for batch in batches:
            for _, level in _levels(shared.value, batch, steps):
                active = (level > 0).sum(axis=1)
                sums += [(active > 0).sum(axis=0), active.sum(axis=0), np.abs(np.diff(level, axis=1)).sum(axis=(0, 1)),
                         level[:, :3].sum(axis=(0, 1)), level[:, steps - 3:].sum(axis=(0, 1))]
        columns = [pa.array(sums[i].astype(np.int64 if i < 2 else np.float64)) for i in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array(shared.value.terms, pa.string()), *columns], names=["TERM", "k", "m", "c", "n", "o"])
    parts = documents.mapInArrow(run, "TERM string, k long, m long, c double, n double, o double")
    return trend_shares(parts.groupBy("TERM").agg(*[F.sum(c).alias(c) for c in "kmcno"]).filter("k > 0"), snapshots, steps)
