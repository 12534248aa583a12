"""Operators over monthly sequences: masks, blocks, timing, descriptors, history checks and tokens."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

KEY = ["PATIENT_ID", "END_DT"]
# Least-squares weights of twelve months, newest first: (5.5 - step) / 143.
SLOPE_MID, SLOPE_NORM = 5.5, 143.0
STEPS = 12


def window_sum(low: int, high: int, value: str = "VALUE", step: str = "TIME_STEP") -> Column:
    """Sum of the values of steps low..high-1 inside a grouped aggregation."""
    return F.coalesce(F.sum(F.when((F.col(step) >= low) & (F.col(step) < high), F.col(value))), F.lit(0))


def representation(counts: DataFrame, kind: str) -> DataFrame:
    """Tall forms of a 12-step sequence: monthly, without_step0, quarterly, annual, windows, flattened (a column per step and category)."""
    by = [*KEY, "CATEGORY"]
    step = F.col("TIME_STEP")
    if kind in ("monthly", "without_step0", "flattened"):
        rows = counts if kind != "without_step0" else counts.filter(step > 0)
        part = F.format_string("m%02d", step) if kind != "flattened" else F.format_string("m%02d_%s", step, "CATEGORY")
        return rows.select(*by, part.alias("PART"), "VALUE")
    if kind == "quarterly":
        return counts.groupBy(*by, F.concat(F.lit("q"), F.floor(step / 3).cast("string")).alias("PART")).agg(F.sum("VALUE").alias("VALUE"))
    if kind == "annual":
        return counts.groupBy(*by).agg(F.sum("VALUE").alias("VALUE")).withColumn("PART", F.lit("annual"))
    if kind == "windows":
        inside = F.explode(F.filter(F.array(*[F.lit(w) for w in (1, 3, 6, 12)]), lambda w: step < w)).alias("w")
        rows = counts.select(*by, "VALUE", inside)
        return rows.groupBy(*by, F.concat(F.lit("w"), F.col("w").cast("string")).alias("PART")).agg(F.sum("VALUE").alias("VALUE"))
    raise ValueError(f"unknown representation {kind}")


def representation_totals(cells: DataFrame, by: str, name: str, names: DataFrame) -> DataFrame:
    """ROWS and TOTAL of each PART of all forms of `representation` (KIND), from rows with the monthly counts M0, M1, .. of a snapshot and category.

    `by` is the column of `cells` that stands for the category; `names` gives its name. Counts of all parts are gathered per category in
    one pass; only these few rows are named and dealt out to the parts.
    """
    spans = {f"q{q}": (3 * q, 3 * q + 3) for q in range(STEPS // 3)} | {f"w{w}": (0, w) for w in (1, 3, 6, 12)}
    spans |= {f"m{i}": (i, i + 1) for i in range(STEPS)}
    total = lambda a, b: sum((F.col(f"M{i}") for i in range(a + 1, b)), F.col(f"M{a}"))
    distinct = {at: part for part, at in spans.items()}  # some spans stand for several parts
    per = cells.groupBy(by).agg(*[F.count_if(total(a, b) > 0).alias(f"_n_{a}_{b}") for a, b in distinct], *[F.sum(f"M{i}").alias(f"_t{i}") for i in range(STEPS)])
    per = per.join(F.broadcast(names), by)

    def part(kind, label, a, b):
        amount = sum((F.col(f"_t{i}") for i in range(a + 1, b)), F.col(f"_t{a}"))
        return F.struct(F.lit(kind).alias("KIND"), label.alias("PART"), F.col(f"_n_{a}_{b}").alias("ROWS"), amount.alias("TOTAL"))
    month = lambda i: F.lit(f"m{i:02d}")
    parts = [part("monthly", month(i), i, i + 1) for i in range(STEPS)] + [part("without_step0", month(i), i, i + 1) for i in range(1, STEPS)]
    parts += [part("flattened", F.concat_ws("_", month(i), name), i, i + 1) for i in range(STEPS)]
    parts += [part("quarterly", F.lit(k), *at) for k, at in spans.items() if k[0] == "q"] + [part("annual", F.lit("annual"), 0, STEPS)]
    parts += [part("windows", F.lit(k), *at) for k, at in spans.items() if k[0] == "w"]
    rows = per.select(F.inline(F.array(*parts))).filter("ROWS > 0")
    return rows.groupBy("KIND", "PART").agg(F.sum("ROWS").alias("ROWS"), F.sum("TOTAL").alias("TOTAL"))


def block_summaries(rows: DataFrame, by: list[str]) -> DataFrame:
    """The columns of `wide_block_summaries` from the counts M0, M1, .. of rows without unknown values; 0 where there is no cell.

    Sums are built from each other, so that the code made for a row stays small enough to be compiled.
    """
    blocks = rows.select(*by, F.col("M0").alias("_first"), *[sum((F.col(f"M{3 * i + j}") for j in (1, 2)), F.col(f"M{3 * i}")).alias(f"_b{i}") for i in range(4)])
    b = [F.col(f"_b{i}") for i in range(4)]
    newest = {1: F.col("_first"), 3: b[0], 6: b[0] + b[1], 12: b[0] + b[1] + b[2] + b[3]}
    return blocks.select(*by, *[F.log1p(x.cast("double")).alias(f"BLOCK_{i}") for i, x in enumerate(b)],
                         *[F.log1p(x.cast("double")).alias(f"NEWEST_{n}") for n, x in newest.items()])


def mask_groups(periods: DataFrame, observed: str) -> DataFrame:
    """MASK of each snapshot by its periods' flag: all_padded, partly_covered or fully_covered."""
    per = periods.groupBy(*KEY).agg(F.count_if(observed).alias("_n"), F.count("*").alias("_all"))
    group = F.when(F.col("_n") == 0, "all_padded").when(F.col("_n") == F.col("_all"), "fully_covered").otherwise("partly_covered")
    return per.select(*KEY, group.alias("MASK"))


def wide_block_summaries(rows: DataFrame, by: list[str], values: list[Column], held: list[Column]) -> DataFrame:
    """log1p sums of four blocks and of the newest 1, 3, 6 and 12 steps, from rows with a value for each step (null: no cell, or unknown).

    `held` says which steps have a cell. A sum of unknown values only is null where no other step of the row has a cell.
    """
    spans = [(f"BLOCK_{i}", 3 * i, 3 * i + 3) for i in range(4)] + [(f"NEWEST_{n}", 0, n) for n in (1, 3, 6, 12)]

    def total(low, high):
        known = F.coalesce(*values[low:high], *[F.when(h, F.lit(0.0)) for h in held[:low] + held[high:]], F.lit(None).cast("double"))
        return F.when(known.isNotNull(), sum((F.coalesce(v, F.lit(0.0)) for v in values[low:high]), F.lit(0.0)))
    return rows.select(*by, *[F.log1p(total(a, b)).alias(n) for n, a, b in spans])


def timing(counts: DataFrame, by: list[str], complete: Column | None = None) -> DataFrame:
    """Months since last activity (12 if none), active months, recent-minus-older mean and monthly slope.

    Sparse input is enough: missing months are zero. Null where the 12 positions are not all valid.
    """
    v, s = F.col("VALUE"), F.col("TIME_STEP")
    last = F.coalesce(F.min(F.when(v > 0, s)), F.lit(12))
    active = F.count_if(v > 0)
    contrast = window_sum(0, 3) / 3 - window_sum(3, 12) / 9
    slope = F.coalesce(F.sum(v * (F.lit(SLOPE_MID) - s)), F.lit(0.0)) / SLOPE_NORM
    out = counts.groupBy(*by).agg(last.alias("MONTHS_SINCE_LAST"), active.alias("ACTIVE_MONTHS"),
                                  contrast.alias("RECENT_CONTRAST"), slope.alias("SLOPE"),
                                  (last < 3).alias("RECENT_3"), (last < 6).alias("RECENT_6"))
    return out


def descriptors(rows: DataFrame, by: list[str], valid: str = "VALID") -> DataFrame:
    """Current value, mean, population SD and slope over the valid steps, in one aggregation of moment sums."""
    ok = F.col(valid)
    s = F.col("TIME_STEP").cast("double")
    x = F.col("VALUE").cast("double")
    add = lambda e: F.coalesce(F.sum(F.when(ok, e)), F.lit(0.0))
    m = rows.groupBy(*by).agg(
        F.max(F.when(F.col("TIME_STEP") == 0, x)).alias("CURRENT"), F.greatest(F.count_if(ok), F.lit(1)).alias("n"),
        add(x).alias("sx"), add(x * x).alias("sxx"), add(s).alias("st"), add(s * s).alias("stt"), add(s * x).alias("stx"))
    mean = F.col("sx") / F.col("n")
    tmean = F.col("st") / F.col("n")
    var = F.greatest(F.lit(0.0), F.col("sxx") / F.col("n") - mean * mean)
    slope = (F.col("stx") - F.col("st") * mean) / F.greatest(F.lit(1.0), F.col("stt") - F.col("st") * tmean)
    return m.select(*by, "CURRENT", mean.alias("MEAN"), F.sqrt(var).alias("SD"), slope.alias("SLOPE"))


def top_codes(counts: DataFrame, k: int) -> DataFrame:
    """The k largest categories per snapshot-month, ties by name; DROPPED counts the rest of the month."""
    w = W.partitionBy(*KEY, "TIME_STEP").orderBy(F.desc("VALUE"), "CATEGORY")
    size = W.partitionBy(*KEY, "TIME_STEP")
    r = counts.withColumn("POSITION", F.row_number().over(w)).withColumn(
        "DROPPED", F.greatest(F.lit(0), F.count("*").over(size) - k))
    return r.filter(F.col("POSITION") <= k)


def code_tokens(snapshots: DataFrame, counts: DataFrame, vocabulary: DataFrame, k: int, n: int = 12) -> DataFrame:
    """(step, position, token, bucket): top codes as ids, 1 unknown, 2 an empty month; bucket is clipped log2.

    vocabulary: (CATEGORY, TOKEN_ID) with ids from 3.
    """
    known = top_codes(counts, k).join(vocabulary, "CATEGORY", "left")
    bucket = F.least(F.lit(7), F.floor(F.log2(F.col("VALUE"))) + 1).cast("int")
    tokens = known.select(*KEY, "TIME_STEP", "POSITION", F.coalesce("TOKEN_ID", F.lit(1)).alias("TOKEN_ID"), bucket.alias("BUCKET"))
    months = snapshots.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("TIME_STEP"))
    empty = months.join(tokens.select(*KEY, "TIME_STEP").distinct(), [*KEY, "TIME_STEP"], "left_anti").select(
        *KEY, "TIME_STEP", F.lit(1).alias("POSITION"), F.lit(2).alias("TOKEN_ID"), F.lit(0).alias("BUCKET"))
    return tokens.unionByName(empty)


def adjacent_pairs(snapshots: DataFrame, max_gap: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Neighbouring snapshots of an entity 1..max_gap calendar months apart: all, and a hash-ordered sample.

    Keys are unique, so an entity's window holds at most one row per cutoff date.
    """
    w = W.partitionBy("PATIENT_ID").orderBy("END_DT")
    later = F.lead("END_DT").over(w)
    gap = (F.year("LATER") - F.year("END_DT")) * 12 + F.month("LATER") - F.month("END_DT")
    pairs = snapshots.select("PATIENT_ID", "END_DT", later.alias("LATER")).filter("LATER IS NOT NULL").withColumn("GAP", gap)
    pairs = pairs.filter(F.col("GAP").between(1, max_gap))
    name = F.to_json(F.array("PATIENT_ID", F.col("END_DT").cast("string"), F.col("LATER").cast("string")))
    pairs = pairs.withColumn("DIGEST", F.sha2(name, 256))
    return pairs, pairs.orderBy("DIGEST").limit(limit)


def overlap_agreement(pairs: DataFrame, counts: DataFrame, features: int, n: int = 12, min_pairs: int = 3,
                      min_varying: int = 20, threshold: float = 0.99) -> DataFrame:
    """Agreement of shared interior months of adjacent snapshots under both step orders.

    Sparse: cells absent on both sides are equal zeros and are counted arithmetically. A feature counts as
    varying for a pair when either side changes over the compared months.
    """
    hyp = F.explode(F.array(F.lit("newest_first"), F.lit("oldest_first"))).alias("HYPOTHESIS")
    p = pairs.select("PATIENT_ID", "END_DT", "LATER", "GAP", hyp)
    newest = F.col("HYPOTHESIS") == "newest_first"
    # BASE identifies a compared month; the shift goes to the later or to the earlier snapshot.
    months = F.lit(n - 2) - F.col("GAP")
    cells = counts.groupBy(*KEY, "TIME_STEP", "CATEGORY").agg(F.sum("VALUE").alias("VALUE"))
    early = p.join(cells, KEY).select("PATIENT_ID", "END_DT", "LATER", "GAP", "HYPOTHESIS", "CATEGORY",
                                      F.when(newest, F.col("TIME_STEP")).otherwise(F.col("TIME_STEP") - F.col("GAP")).alias("BASE"),
                                      F.col("VALUE").alias("A"), F.lit(0).cast("long").alias("B"))
    late = p.join(cells.withColumnRenamed("END_DT", "LATER"), ["PATIENT_ID", "LATER"]).select(
        "PATIENT_ID", "END_DT", "LATER", "GAP", "HYPOTHESIS", "CATEGORY",
        F.when(newest, F.col("TIME_STEP") - F.col("GAP")).otherwise(F.col("TIME_STEP")).alias("BASE"),
        F.lit(0).cast("long").alias("A"), F.col("VALUE").alias("B"))
    pair = ["PATIENT_ID", "END_DT", "LATER", "GAP", "HYPOTHESIS"]
    both = early.unionByName(late).filter((F.col("BASE") >= 1) & (F.col("BASE") <= months))
    both = both.groupBy(*pair, "CATEGORY", "BASE").agg(F.sum("A").alias("A"), F.sum("B").alias("B"))
    equal = F.col("A") == F.col("B")
    per = both.groupBy(*pair, "CATEGORY").agg(
        F.count("*").alias("active"), F.count_if(equal).alias("same"), F.min("A").alias("a0"), F.max("A").alias("a1"),
        F.min("B").alias("b0"), F.max("B").alias("b1"))
    # With fewer active months than compared months, zeros belong to both sides' ranges.
    full = F.col("active") == months
    low = lambda c: F.when(full, F.col(c)).otherwise(0)
    varying = (months > 1) & ((F.col("a1") > low("a0")) | (F.col("b1") > low("b0")))
    per = per.withColumn("v", varying)
    pick = lambda c: F.coalesce(F.sum(F.when(F.col("v"), F.col(c))), F.lit(0))
    found = per.groupBy(*pair).agg(F.sum("active").alias("active"), F.sum("same").alias("same"),
                                   pick("active").alias("va"), pick("same").alias("vs"))
    j = p.join(found, pair, "left").fillna(0, ["active", "same", "va", "vs"]).withColumn("cells", months * features)
    t = j.groupBy("HYPOTHESIS").agg(
        F.sum("cells").alias("FINITE"), F.sum(F.col("cells") - F.col("active") + F.col("same")).alias("EQUAL"),
        F.sum("active").alias("ACTIVE"), F.sum("same").alias("ACTIVE_EQUAL"), F.sum("va").alias("VARYING"),
        F.sum("vs").alias("VARYING_EQUAL"), F.count("*").alias("PAIRS"), F.count_if(F.col("va") > 0).alias("INFORMATIVE_PAIRS"))
    ratio = F.col("VARYING_EQUAL") / F.nullif(F.col("VARYING"), F.lit(0))
    enough = (F.col("INFORMATIVE_PAIRS") >= min_pairs) & (F.col("VARYING") >= min_varying)
    status = F.when(~enough, "INCONCLUSIVE").when(ratio >= threshold, "CORROBORATED").otherwise("CONTRADICTED")
    return t.select(*t.columns, ratio.alias("AGREEMENT"), status.alias("STATUS"))


#: Category vectors up to this many numbers travel to the tasks; a larger dictionary is joined instead.
VECTOR_NUMBERS = 4_000_000


def semantic_windows(counts: DataFrame, dictionary: DataFrame, recent: int = 2) -> DataFrame:
    """Per snapshot and window (RECENT: steps 0..recent, or older): LOG_SUM of the counts and their weighted mean vector M.

    dictionary: CATEGORY, E (one length). Only (category number, count) pairs are shuffled; the vectors meet them after it, as one matrix
    product per batch. A dictionary over VECTOR_NUMBERS is joined by category and then summed vector by vector.
    """
    window = (F.col("TIME_STEP") <= recent).alias("RECENT")
    table = dictionary.select("CATEGORY", "E")
    size = table.agg(F.count("*").alias("n"), F.max(F.size("E")).alias("d")).first()
    if not size.n:
        raise ValueError("the dictionary holds no vector")
    if size.n * size.d > VECTOR_NUMBERS:
        w = counts.groupBy(*KEY, window, "CATEGORY").agg(F.sum("VALUE").alias("n")).join(table, "CATEGORY")
        cells = w.select(*KEY, "RECENT", "n", F.posexplode("E").alias("k", "e")).groupBy(*KEY, "RECENT", "k").agg(
            F.sum(F.col("n") * F.col("e")).alias("x"), F.sum("n").alias("s"))
        g = cells.groupBy(*KEY, "RECENT").agg(F.max("s").alias("s"), F.array_sort(F.collect_list(F.struct("k", "x"))).alias("r"))
        return g.select(*KEY, "RECENT", F.log1p("s").alias("LOG_SUM"), F.transform("r", lambda c: c["x"] / F.col("s")).alias("M"))
    rows = table.orderBy("CATEGORY").collect()  # bounded by VECTOR_NUMBERS
    numbers = counts.sparkSession.createDataFrame([(r.CATEGORY, i) for i, r in enumerate(rows)], "CATEGORY string, i int")
    shipped = counts.sparkSession.sparkContext.broadcast(np.array([r.E for r in rows], float))
    pairs = counts.join(F.broadcast(numbers), "CATEGORY").groupBy(*KEY, window).agg(
        F.collect_list("i").alias("i"), F.collect_list("VALUE").alias("v"), F.sum("VALUE").alias("s"))

    def mean(batches):
        vectors = shipped.value
        for batch in batches:
            parts = []
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own, v = part.column("i"), part.column("v")
                x = np.zeros((part.num_rows, len(vectors)))
                where = np.repeat(np.arange(part.num_rows), np.diff(own.offsets.to_numpy()))
                np.add.at(x, (where, own.flatten().to_numpy()), v.flatten().to_numpy().astype(float))
                parts.append((x @ vectors) / x.sum(axis=1, keepdims=True))
            m = np.concatenate(parts) if parts else np.zeros((0, vectors.shape[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*KEY, "RECENT", "s")), pa.array(list(m), pa.list_(pa.float64()))],
                                             names=[*KEY, "RECENT", "s", "M"])
    done = pairs.mapInArrow(mean, "PATIENT_ID string, END_DT date, RECENT boolean, s long, M array<double>")
    return done.select(*KEY, "RECENT", F.log1p("s").alias("LOG_SUM"), "M")
