"""Weights, quality ledgers, fitted transforms, association measures and shift, over tall features.

Everything that can be is computed on value histograms (one row per feature, value and label), which are
built by one partially aggregated pass and are far smaller than the rows they summarise.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators.ordering import attach, mid_ranks, ranked, value_table, weighted_quantiles
from tidemark.session import settle, settle_table

KEY = ["PATIENT_ID", "END_DT"]
# Quality thresholds, scale floors and flags of the feature contracts.
MIN_OBSERVED, MAX_MISSING, MIN_NONZERO = 20, 0.95, 10
NEAR_CONSTANT, LOW_VARIANCE = 0.995, 1e-6
COUNT_SCALE_FLOOR, VALUE_SCALE_FLOOR = 1.0, 1e-6


def entity_weights(rows: DataFrame, by: tuple = ()) -> DataFrame:
    """ENTITY_SHARE = 1 / rows of the entity; WEIGHT is the same scaled to mean 1 (per `by` group)."""
    by = list(by)
    per = rows.groupBy("PATIENT_ID", *by).agg(F.count("*").alias("_n"))
    whole = per.groupBy(*by).agg((F.sum("_n") / F.count("*")).alias("_mean"))
    per = attach(per, whole, by).select("PATIENT_ID", *by, (1 / F.col("_n")).alias("ENTITY_SHARE"),
                                        (F.col("_mean") / F.col("_n")).alias("WEIGHT"))
    return rows.join(per, ["PATIENT_ID", *by])


def class_weight(weighted: DataFrame, label: str = "RESP", weight: str = "WEIGHT") -> DataFrame:
    """Positive-class weight for balance none, sqrt and full, from weighted totals."""
    w = F.col(weight)
    sums = weighted.agg(F.sum(F.when(F.col(label) == 0, w)).alias("n"), F.sum(F.when(F.col(label) == 1, w)).alias("p"))
    ratio = F.col("n") / F.col("p")
    pick = lambda name, v: F.struct(F.lit(name).alias("BALANCE"), v.alias("POSITIVE_WEIGHT"))
    return sums.select(F.inline(F.array(pick("none", F.lit(1.0)), pick("sqrt", F.sqrt(ratio)), pick("full", ratio))))


def histogram(rows: DataFrame, *by: str, weight: str = "WEIGHT") -> DataFrame:
    """Weight W and row count N per (by.., VALUE); null values form their own row."""
    return rows.groupBy(*by, "VALUE").agg(F.sum(weight).alias("W"), F.count("*").alias("N"))


@dataclass(frozen=True)
class SparseRows:
    """Rows numbered POS = 1..n in key order, each with a map of its non-zero cells; every other declared feature is 0 there.

    Zeros are never written out: a feature's zero cell is what its other values leave of the totals.
    """

    rows: DataFrame
    names: tuple[str, ...]
    n: int

    @property
    def cells(self) -> DataFrame:
        """(POS, the rows' columns, FEATURE, VALUE) of the non-zero cells of declared features."""
        keep = [c for c in self.rows.columns if c != "COUNTS"]
        cells = self.rows.select(*keep, F.explode("COUNTS").alias("FEATURE", "VALUE")).withColumn("VALUE", F.col("VALUE").cast("double"))
        return cells.filter((F.col("VALUE") != 0) & F.col("FEATURE").isin(*self.names))

    def per_feature(self, totals: DataFrame) -> DataFrame:
        return totals.withColumn("FEATURE", F.explode(F.array(*[F.lit(n) for n in self.names])))


def sparse_rows(packed: DataFrame, names, key: tuple = tuple(KEY)) -> SparseRows:
    """Number the rows of a table with a COUNTS map (null: no non-zero cell) once; kept, as several passes follow."""
    kept = settle_table(ranked(packed, [F.col(k) for k in key], "POS"))
    return SparseRows(kept, tuple(names), kept.count())


def sparse_histogram(sparse: SparseRows, *by: str, weight: str | None = None) -> DataFrame:
    """(FEATURE, by.., VALUE, W, N) like `histogram`, W being N where no weight is named."""
    w = F.sum(weight) if weight else F.count("*").cast("double")
    seen = sparse.cells.groupBy("FEATURE", *by, "VALUE").agg(w.alias("W"), F.count("*").alias("N"))
    used = seen.groupBy("FEATURE", *by).agg(F.sum("W").alias("_w"), F.sum("N").alias("_n"))
    whole = sparse.per_feature(sparse.rows.groupBy(*by).agg(w.alias("W"), F.count("*").alias("N")))
    left = whole.join(used, ["FEATURE", *by], "left")
    zero = left.select("FEATURE", *by, F.lit(0.0).alias("VALUE"), (F.col("W") - F.coalesce("_w", F.lit(0.0))).alias("W"),
                       (F.col("N") - F.coalesce("_n", F.lit(0))).alias("N"))
    return seen.unionByName(zero.filter("N > 0"))


def _first_gap(cells: DataFrame, n: int, place: Column, block: int) -> DataFrame:
    """(FEATURE, GAP): the first of the places 0..n - 1 at which the feature has no cell; absent where its first cell is not at 0.

    Two steps of about sqrt(n): blocks that are full from the start on, then the cells of the first block that is not.
    """
    at = cells.select("FEATURE", place.alias("_p")).withColumn("_b", F.floor(F.col("_p") / block))
    size = F.least(F.lit(block), F.lit(n) - F.col("_b") * block)
    full = at.groupBy("FEATURE", "_b").agg(F.count("*").alias("c")).filter(F.col("c") == size)
    order = lambda c: F.row_number().over(W.partitionBy("FEATURE").orderBy(c)) - 1
    lead = full.withColumn("_i", order("_b")).filter("_i = _b").groupBy("FEATURE").agg(F.count("*").alias("_lead"))
    inner = at.join(lead, "FEATURE", "left").fillna(0, ["_lead"]).filter(F.col("_b") == F.col("_lead"))
    run = inner.withColumn("_i", order("_p")).filter(F.col("_p") - F.col("_lead") * block == F.col("_i"))
    found = at.select("FEATURE").distinct().join(lead, "FEATURE", "left").join(run.groupBy("FEATURE").agg(F.count("*").alias("_run")), "FEATURE", "left")
    return found.select("FEATURE", (F.coalesce("_lead", F.lit(0)) * block + F.coalesce("_run", F.lit(0))).alias("GAP"))


def sparse_value_table(sparse: SparseRows, weight: str = "WEIGHT") -> DataFrame:
    """`value_table` per FEATURE. Tie edges are the weights at the first and last POS of a value: plain numbers, hashed not sorted."""
    cells, n = sparse.cells, sparse.n
    seen = cells.groupBy("FEATURE", "VALUE").agg(F.sum(weight).alias("W"), F.count("*").alias("N"), F.min("POS").alias("_a"), F.max("POS").alias("_z"))
    used = seen.groupBy("FEATURE").agg(F.sum("W").alias("_w"), F.sum("N").alias("_n"))
    block = max(1, int(n ** 0.5))
    first = _first_gap(cells, n, F.col("POS") - 1, block).withColumnRenamed("GAP", "_f")
    last = _first_gap(cells, n, n - F.col("POS"), block).withColumnRenamed("GAP", "_l")
    whole = sparse.per_feature(sparse.rows.agg(F.sum(weight).alias("W"), F.count("*").alias("N")))
    left = whole.join(used, "FEATURE", "left").join(first, "FEATURE", "left").join(last, "FEATURE", "left").fillna(0, ["_w", "_n", "_f", "_l"])
    zero = left.select("FEATURE", F.lit(0.0).alias("VALUE"), (F.col("W") - F.col("_w")).alias("W"), (F.col("N") - F.col("_n")).alias("N"),
                       (F.col("_f") + 1).alias("_a"), (n - F.col("_l")).alias("_z")).filter("N > 0")
    at = sparse.rows.select("POS", F.col(weight).alias("_x"))
    table = seen.unionByName(zero)
    table = table.join(at.select(F.col("POS").alias("_a"), F.col("_x").alias("W_FIRST")), "_a")
    return table.join(at.select(F.col("POS").alias("_z"), F.col("_x").alias("W_LAST")), "_z").select("FEATURE", "VALUE", "W", "W_FIRST", "W_LAST", "N")


def moments(hist: DataFrame, by: list[str], x: Column, w: Column) -> DataFrame:
    """Weighted mean and population variance in two passes over the small histogram."""
    mean = hist.groupBy(*by).agg((F.sum(w * x) / F.sum(w)).alias("MEAN"), F.sum(w).alias("SUM_W"))
    dev = hist.join(mean, by).withColumn("_d", x - F.col("MEAN"))
    return dev.groupBy(*by).agg(F.max("MEAN").alias("MEAN"), F.max("SUM_W").alias("SUM_W"),
                                (F.sum(w * F.col("_d") * F.col("_d")) / F.max("SUM_W")).alias("VAR"))


def duplicate_features(rows: DataFrame) -> DataFrame:
    """(FEATURE, DUPLICATE_OF): identical content over all keys, the smallest name being kept.

    Fingerprints are sums of two independent hashes of (key, value), so no feature is ever collected;
    features with equal fingerprints are then compared cell by cell.
    """
    cell = [*[F.col(k) for k in KEY], F.col("VALUE")]
    big = "decimal(38,0)"
    prints = rows.groupBy("FEATURE").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cell).cast(big)).alias("a"),
                                         F.sum(F.xxhash64(F.lit(7), *cell).cast(big)).alias("b"))
    first = prints.groupBy("n", "a", "b").agg(F.min("FEATURE").alias("DUPLICATE_OF"), F.count("*").alias("c")).filter("c > 1")
    pairs = prints.join(first, ["n", "a", "b"]).filter("FEATURE <> DUPLICATE_OF").select("FEATURE", "DUPLICATE_OF")
    # Only the cells of features with equal fingerprints are shuffled; pairs are as few as the declared features.
    pairs = settle(pairs)
    left = rows.join(F.broadcast(pairs), "FEATURE")
    kept = F.broadcast(pairs.select(F.col("DUPLICATE_OF").alias("FEATURE")).distinct())
    right = rows.join(kept, "FEATURE", "left_semi").select(*KEY, F.col("FEATURE").alias("DUPLICATE_OF"), F.col("VALUE").alias("_v"))
    same = F.coalesce(F.col("VALUE").eqNullSafe(F.col("_v")), F.lit(False))
    checked = left.join(right, [*KEY, "DUPLICATE_OF"], "left").groupBy("FEATURE", "DUPLICATE_OF").agg(F.count_if(~same).alias("_bad"))
    return checked.filter("_bad = 0").select("FEATURE", "DUPLICATE_OF")


def quality_ledger(rows: DataFrame) -> DataFrame:
    """Weighted quality row per count feature; exclusions are decided by QUALITY_REASON, the rest are flags."""
    seen = F.col("VALUE").isNotNull()
    hist = histogram(rows, "FEATURE")
    obs = hist.filter(seen)
    base = hist.groupBy("FEATURE").agg(
        F.sum("N").alias("_rows"), F.coalesce(F.sum(F.when(seen, F.col("N"))), F.lit(0)).alias("OBSERVED_CELLS"),
        (F.coalesce(F.sum(F.when(~seen, F.col("W"))), F.lit(0.0)) / F.sum("W")).alias("MISSING_FRACTION"),
        F.max("VALUE").alias("RAW_MAX"), F.min("VALUE").alias("_min"),
        (F.max(F.when(seen, F.col("W"))) / F.sum(F.when(seen, F.col("W")))).alias("OBSERVED_MODE_FRACTION"))
    raw = moments(obs, ["FEATURE"], F.col("VALUE"), F.col("W")).select("FEATURE", F.col("MEAN").alias("RAW_MEAN"), F.sqrt("VAR").alias("RAW_SD"))
    logs = moments(obs, ["FEATURE"], F.log1p("VALUE"), F.col("W")).select("FEATURE", F.col("VAR").alias("LOG_COUNT_VARIANCE"))
    values = value_table(rows.filter(seen), "VALUE", "WEIGHT", KEY, ("FEATURE",))
    q = weighted_quantiles(values, "VALUE", [0.5, 0.95, 0.99], ("FEATURE",))
    at = lambda p: F.max(F.when(F.col("Q") == p, F.col("QUANTILE")))
    q = q.groupBy("FEATURE").agg(at(0.5).alias("RAW_Q50"), at(0.95).alias("RAW_Q95"), at(0.99).alias("RAW_Q99"))
    people = rows.groupBy("FEATURE", "PATIENT_ID").agg(F.max(seen.cast("int")).alias("o"), F.max((F.col("VALUE") > 0).cast("int")).alias("z"))
    people = people.groupBy("FEATURE").agg(F.sum("o").alias("OBSERVED_PATIENTS"), F.coalesce(F.sum("z"), F.lit(0)).alias("NONZERO_PATIENTS"))
    j = base.join(raw, "FEATURE", "left").join(logs, "FEATURE", "left").join(q, "FEATURE", "left").join(people, "FEATURE").join(
        duplicate_features(rows), "FEATURE", "left")
    reason = (F.when(F.col("OBSERVED_CELLS") == 0, "all_missing_in_fit")
              .when((F.col("RAW_MAX") == F.col("_min")) & (F.col("OBSERVED_CELLS") == F.col("_rows")), "constant_in_fit")
              .when(F.col("DUPLICATE_OF").isNotNull(), "exact_duplicate_in_fit").otherwise("eligible"))
    return j.withColumn("QUALITY_REASON", reason).withColumn(
        "NEAR_CONSTANT", F.col("OBSERVED_MODE_FRACTION") >= NEAR_CONSTANT).withColumn(
        "LOW_VARIANCE", F.col("LOG_COUNT_VARIANCE") <= LOW_VARIANCE).drop("_rows", "_min")


def quality_gate(rows: DataFrame, total_rows: DataFrame) -> DataFrame:
    """Unweighted gate with ordered reasons; `total_rows` is a one-row count ALL_ROWS."""
    seen = F.col("VALUE").isNotNull()
    g = rows.groupBy("FEATURE").agg(
        F.count_if(seen).alias("OBSERVED"), F.count_if(seen & (F.col("VALUE") != 0)).alias("NONZERO"),
        F.min("VALUE").alias("lo"), F.max("VALUE").alias("hi"))
    g = attach(g, total_rows, []).withColumn("MISSING_FRACTION", 1 - F.col("OBSERVED") / F.col("ALL_ROWS"))
    g = g.join(duplicate_features(rows), "FEATURE", "left")
    reason = (F.when(F.col("OBSERVED") == 0, "all_missing").when(F.col("OBSERVED") < MIN_OBSERVED, "insufficient_observations")
              .when(F.col("MISSING_FRACTION") > MAX_MISSING, "high_missingness").when(F.col("lo") == F.col("hi"), "constant_observed_values")
              .when(F.col("NONZERO") < MIN_NONZERO, "insufficient_nonzero_support")
              .when(F.col("DUPLICATE_OF").isNotNull(), "exact_duplicate").otherwise("eligible"))
    return g.select("FEATURE", "OBSERVED", "NONZERO", "MISSING_FRACTION", reason.alias("QUALITY_REASON"), "DUPLICATE_OF")


def medians(rows: DataFrame, value: str = "VALUE", groups: tuple = ("FEATURE",)) -> DataFrame:
    """Exact medians of the observed values through the distributed quantile."""
    unit = rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("N"))
    unit = unit.select(*groups, value, F.col("N").cast("double").alias("W"), F.lit(1.0).alias("W_FIRST"), F.lit(1.0).alias("W_LAST"))
    return weighted_quantiles(unit, value, [0.5], tuple(groups)).select(*groups, F.col("QUANTILE").alias("MEDIAN"))


def kind_value(kind: Column, value: Column) -> Column:
    """Counts enter as log1p, everything else unchanged."""
    return F.when(kind == "count", F.log1p(value)).otherwise(value)


def fit_transform(rows: DataFrame) -> DataFrame:
    """Frozen state per feature (FEATURE, KIND, MEDIAN, CENTER, SCALE, MISSING_FRACTION); binary stays untouched."""
    t = rows.withColumn("VALUE", kind_value(F.col("KIND"), F.col("VALUE")))
    hist = t.groupBy("FEATURE", "KIND", "VALUE").agg(F.count("*").cast("double").alias("W"))
    state = hist.select("FEATURE", "KIND").distinct().join(medians(t), "FEATURE", "left").fillna(0.0, ["MEDIAN"])
    full = hist.join(state, ["FEATURE", "KIND"])
    m = moments(full, ["FEATURE"], F.coalesce("VALUE", "MEDIAN"), F.col("W"))
    miss = hist.groupBy("FEATURE").agg((F.sum(F.when(F.col("VALUE").isNull(), F.col("W")).otherwise(0.0)) / F.sum("W")).alias("MISSING_FRACTION"))
    sd = F.sqrt("VAR")
    center = F.when(F.col("KIND") == "binary", 0.0).otherwise(F.col("MEAN"))
    scale = (F.when(F.col("KIND") == "binary", 1.0).when(F.col("KIND") == "count", F.greatest(sd, F.lit(COUNT_SCALE_FLOOR)))
             .otherwise(F.greatest(sd, F.lit(VALUE_SCALE_FLOOR))))
    return state.join(m, "FEATURE").join(miss, "FEATURE").select(
        "FEATURE", "KIND", "MEDIAN", center.alias("CENTER"), scale.alias("SCALE"), "MISSING_FRACTION")


def apply_transform(rows: DataFrame, state: DataFrame, valid: Column | None = None) -> DataFrame:
    """Impute, transform and scale with a frozen state; positions outside the mask become 0."""
    j = rows.join(state.select("FEATURE", "KIND", "MEDIAN", "CENTER", "SCALE"), "FEATURE")
    z = (F.coalesce(kind_value(F.col("KIND"), F.col("VALUE")), F.col("MEDIAN")) - F.col("CENTER")) / F.col("SCALE")
    return j.withColumn("Z", F.when(valid, z).otherwise(0.0) if valid is not None else z)


def standardise(rows: DataFrame) -> DataFrame:
    """Median-impute and standardise per feature; MISSING marks the imputed cells."""
    state = rows.join(medians(rows), "FEATURE")
    filled = state.withColumn("_x", F.coalesce("VALUE", "MEDIAN"))
    m = moments(filled.groupBy("FEATURE", "_x").agg(F.count("*").cast("double").alias("W")), ["FEATURE"], F.col("_x"), F.col("W"))
    sd = F.sqrt("VAR")
    return filled.join(m.select("FEATURE", "MEAN", F.when(sd > 0, sd).otherwise(1.0).alias("_sd")), "FEATURE").withColumn(
        "Z", (F.col("_x") - F.col("MEAN")) / F.col("_sd")).withColumn("MISSING", F.col("VALUE").isNull())


def binned_mutual_information(rows: DataFrame, bins: int, entities: DataFrame, label: str = "RESP") -> DataFrame:
    """MI of label and quantile bin per feature, with the entity-count bias correction.

    `rows` carries WEIGHT; `entities` is a one-row count ENTITIES.
    """
    values = value_table(rows, "VALUE", "WEIGHT", KEY, ("FEATURE",))
    return binned_information(values, histogram(rows, "FEATURE", label), bins, entities, label)


def binned_information(values: DataFrame, hist: DataFrame, bins: int, entities: DataFrame, label: str = "RESP") -> DataFrame:
    """The same from a value table and a histogram by label."""
    points = [i / bins for i in range(1, bins)]
    edges = weighted_quantiles(values, "VALUE", points, ("FEATURE",)).groupBy("FEATURE").agg(F.collect_set("QUANTILE").alias("E"))
    hist = hist.join(edges, "FEATURE")
    code = F.size(F.filter("E", lambda e: e <= F.col("VALUE")))
    joint = hist.groupBy("FEATURE", code.alias("B"), label).agg(F.sum("W").alias("w"))
    info = _mutual_information(joint, ["B"], label)
    return attach(info, entities, []).withColumn("CORRECTED_MI", F.greatest(
        F.lit(0.0), F.col("MI") - (F.col("OCCUPIED") - 1) / (2 * F.col("ENTITIES"))))


def _mutual_information(joint: DataFrame, cell: list[str], label: str) -> DataFrame:
    """Sum of p ln(p / (px py)) per feature from joint weights w per (FEATURE, cell.., label)."""
    total = joint.groupBy("FEATURE").agg(F.sum("w").alias("t"))
    x = joint.groupBy("FEATURE", *cell).agg(F.sum("w").alias("x"))
    y = joint.groupBy("FEATURE", label).agg(F.sum("w").alias("y"))
    j = joint.join(x, ["FEATURE", *cell]).join(y, ["FEATURE", label]).join(total, "FEATURE").filter("w > 0")
    part = F.col("w") / F.col("t") * F.ln(F.col("w") * F.col("t") / (F.col("x") * F.col("y")))
    cells = x.filter("x > 0").groupBy("FEATURE").agg(F.count("*").alias("OCCUPIED"))
    return j.groupBy("FEATURE").agg(F.sum(part).alias("MI")).join(cells, "FEATURE")


def discrete_mutual_information(rows: DataFrame, label: str = "RESP") -> DataFrame:
    return discrete_information(rows.groupBy("FEATURE", "VALUE", label).agg(F.count("*").alias("N")), label)


def discrete_information(hist: DataFrame, label: str = "RESP") -> DataFrame:
    """The same from a histogram by label."""
    return _mutual_information(hist.select("FEATURE", "VALUE", label, F.col("N").alias("w")), ["VALUE"], label)


def rank_correlation(rows: DataFrame, weight: str | None = None, label: str = "RESP") -> DataFrame:
    """(Weighted) correlation of mid-ranks with a binary label, from the value histogram."""
    w = F.sum(weight) if weight else F.count("*").cast("double")
    return rank_correlation_of(rows.filter(F.col("VALUE").isNotNull()).groupBy("FEATURE", "VALUE", label).agg(w.alias("W")), label)


def rank_correlation_of(hist: DataFrame, label: str = "RESP") -> DataFrame:
    """The same from weights W per (FEATURE, VALUE, label)."""
    ranks = mid_ranks(hist.groupBy("FEATURE", "VALUE").agg(F.sum("W").alias("W")), "VALUE", "W", ("FEATURE",))
    h = hist.join(ranks.select("FEATURE", "VALUE", "MID_SHARE"), ["FEATURE", "VALUE"])
    mean = h.groupBy("FEATURE").agg((F.sum(F.col("W") * F.col("MID_SHARE")) / F.sum("W")).alias("mx"),
                                    (F.sum(F.col("W") * F.col(label)) / F.sum("W")).alias("my"))
    d = h.join(mean, "FEATURE").withColumn("dx", F.col("MID_SHARE") - F.col("mx")).withColumn("dy", F.col(label) - F.col("my"))
    s = lambda a, b: F.sum(F.col("W") * F.col(a) * F.col(b))
    return d.groupBy("FEATURE").agg(s("dx", "dy").alias("c"), (s("dx", "dx") * s("dy", "dy")).alias("v")).select(
        "FEATURE", F.when(F.col("v") > 0, F.col("c") / F.sqrt("v")).otherwise(0.0).alias("CORRELATION"))


def presence_association(rows: DataFrame, label: str = "RESP") -> DataFrame:
    """Phi, chi-square without correction and smallest expected cell of presence against the label."""
    return presence_of(rows.filter(F.col("VALUE").isNotNull()).groupBy("FEATURE", "VALUE", label).agg(F.count("*").alias("N")), label)


def presence_of(hist: DataFrame, label: str = "RESP") -> DataFrame:
    """The same from row counts N per (FEATURE, VALUE, label)."""
    p, y = F.col("VALUE") != 0, F.col(label) == 1
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("N"))), F.lit(0)).cast("double")
    c = hist.groupBy("FEATURE").agg(F.sum("N").cast("double").alias("n"), count(p & y).alias("a"), count(p).alias("r"), count(y).alias("k"))
    n, a, r, k = (F.col(x) for x in "nark")
    spread = r * (n - r) * k * (n - k)
    phi = F.when(spread > 0, (n * a - r * k) / F.sqrt(spread))
    low = F.least(r, n - r) * F.least(k, n - k) / n
    return c.select("FEATURE", phi.alias("PHI"), (n * phi * phi).alias("CHI2"), F.when(spread > 0, low).alias("MIN_EXPECTED"))


#: Partial sums that are added together before the last addition.
TREE = 64
#: Distinct (feature, value) pairs whose ranks travel to the tasks; beyond it ranks are joined to the cells.
RANK_TABLE = 2_000_000
DENSE_ROWS = 4096


def _add_arrays(parts: DataFrame, *by: str) -> DataFrame:
    """Sum of the arrays R of each row number I: within groups of TREE partials first, so no task gets all of them."""
    def add(key, group):
        return pd.DataFrame({"I": [key[0]], "P": [key[1] if len(key) > 1 else 0], "R": [np.sum(np.stack(group["R"].to_numpy()), axis=0)]})
    near = parts.groupBy("I", F.floor(F.col("P") / TREE).alias("P")).applyInPandas(add, "I int, P long, R array<double>")
    return near.groupBy("I").applyInPandas(add, "I int, P long, R array<double>")


def _triangle(matrix: np.ndarray, part: int) -> pa.RecordBatch:
    rows = [matrix[i, i:] for i in range(len(matrix))]
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows)), pa.int32()), pa.array(np.full(len(rows), part), pa.int64()),
                                       pa.array(rows, pa.list_(pa.float64()))], names=["I", "P", "R"])


def gram(vectors: DataFrame, column: str, size: int) -> DataFrame:
    """Sum of outer products of (1, x), upper triangle as rows (I, J, S), from one partial matrix per task.

    The size is the declared vocabulary, so a partial holds half of (size + 1) squared numbers whatever the rows; it leaves the task as
    one array per row of the triangle.
    """
    def partial(batches):
        acc = np.zeros((size + 1, size + 1))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            x = np.hstack([np.ones((len(x), 1)), x])
            acc += x.T @ x
        yield _triangle(acc, TaskContext.get().partitionId())
    return _cells(vectors.select(column).mapInArrow(partial, "I int, P long, R array<double>"))


def _cells(parts: DataFrame) -> DataFrame:
    return _add_arrays(parts).select("I", F.posexplode("R").alias("k", "S")).select("I", (F.col("I") + F.col("k")).alias("J"), "S")


def sparse_gram(sparse: SparseRows, ranks: dict[str, tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """The same straight from the maps of non-zero cells, which are scattered into a block of rows at a time; nothing is exploded.

    With `ranks` (ascending values and their numbers per feature) cells count as these numbers instead of their values.
    """
    names = sparse.names
    shipped = sparse.rows.sparkSession.sparkContext.broadcast(ranks)

    def partial(batches):
        place = {n: i for i, n in enumerate(names, 1)}
        table = shipped.value
        acc = np.zeros((len(names) + 1, len(names) + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, DENSE_ROWS):
                part = batch.slice(at, DENSE_ROWS)
                keys, values = part.column(0), part.column(1)
                counts = np.diff(keys.offsets.to_numpy())
                coded = keys.flatten().dictionary_encode()
                column = np.array([place.get(n, 0) for n in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
                value = values.flatten().to_numpy(zero_copy_only=False).astype(float)
                if table is not None:
                    value = value.copy()
                    for name in {names[i - 1] for i in np.unique(column) if i}:
                        own = column == place[name]
                        seen, numbers = table[name]
                        value[own] = np.where(value[own] != 0, numbers[np.searchsorted(seen, value[own])], 0.0)
                x = np.zeros((part.num_rows, len(names) + 1))
                x[np.repeat(np.arange(part.num_rows), counts), column] = value
                x[:, 0] = 1.0
                acc += x.T @ x
        yield _triangle(acc, TaskContext.get().partitionId())
    counts = F.coalesce("COUNTS", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<long>")))
    maps = sparse.rows.select(F.map_keys(counts).alias("k"), F.map_values(counts).cast("array<double>").alias("v"))
    return _cells(maps.mapInArrow(partial, "I int, P long, R array<double>"))


def sparse_rank_gram(sparse: SparseRows) -> DataFrame | None:
    """Gram matrix of average ranks, each less its feature's rank of 0, which changes no correlation and keeps zeros zero.

    None where there are too many distinct values to send their ranks to the tasks.
    """
    ranks = settle(mid_ranks(sparse_histogram(sparse).select("FEATURE", "VALUE", "N"), "VALUE", "N", ("FEATURE",)))
    if ranks.count() > RANK_TABLE:
        return None
    table = {}
    for name, own in ranks.select("FEATURE", "VALUE", "MID_RANK").toPandas().sort_values("VALUE").groupby("FEATURE"):
        values, numbers = own["VALUE"].to_numpy(float), own["MID_RANK"].to_numpy(float)
        zero = numbers[values == 0]
        table[name] = values, numbers - (zero[0] if len(zero) else 0.0)
    return sparse_gram(sparse, table)


def correlated_pairs(vectors: DataFrame, column: str, names: list[str], threshold: float) -> DataFrame:
    """Feature pairs with |Pearson r| at or above the threshold (pass rank vectors for Spearman)."""
    return pairs_of(gram(vectors, column, len(names)), names, threshold)


def pairs_of(matrix: DataFrame, names, threshold: float) -> DataFrame:
    """The same from the upper triangle (I, J, S) of a Gram matrix of (1, x)."""
    # A matrix over the declared vocabulary, read several times below: kept once instead of recomputed.
    g = settle(matrix)
    n = g.filter("I = 0 AND J = 0").select(F.col("S").alias("n"))
    mean = g.filter("I = 0").select("J", "S")
    diag = g.filter("I = J").select("I", "S")
    a = g.filter("I > 0 AND I < J").select("I", "J", F.col("S").alias("xy"))
    a = a.join(mean.select(F.col("J").alias("I"), F.col("S").alias("x")), "I").join(mean.select("J", F.col("S").alias("y")), "J")
    a = a.join(diag.select("I", F.col("S").alias("xx")), "I").join(diag.select(F.col("I").alias("J"), F.col("S").alias("yy")), "J")
    a = attach(a, n, [])
    nx = lambda s, u, v: F.col("n") * F.col(s) - F.col(u) * F.col(v)
    r = nx("xy", "x", "y") / F.sqrt(F.nullif(nx("xx", "x", "x") * nx("yy", "y", "y"), F.lit(0.0)))
    label = F.array(*[F.lit(x) for x in names])
    out = a.select(F.element_at(label, F.col("I")).alias("FEATURE_A"), F.element_at(label, F.col("J")).alias("FEATURE_B"), r.alias("CORRELATION"))
    return out.filter(F.abs("CORRELATION") >= threshold)


def vectors(rows: DataFrame, value: str, names: list[str]) -> DataFrame:
    """One array per snapshot in vocabulary order; at most one value per declared name is gathered."""
    packed = rows.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("FEATURE", value))).alias("_m"))
    return packed.select(*KEY, F.transform(F.array(*[F.lit(x) for x in names]), lambda f: F.coalesce(
        F.try_element_at("_m", f).cast("double"), F.lit(0.0))).alias("X"))


def log_vector(names: list[str]) -> Column:
    """log1p of a row's COUNTS in vocabulary order, 0 for what the map (or no map) does not hold: no cell is written out or gathered."""
    return F.array(*[F.log1p(F.coalesce(F.try_element_at("COUNTS", F.lit(n)), F.lit(0)).cast("double")) for n in names])


def with_ranks(rows: DataFrame) -> DataFrame:
    """Replace values by their average rank within the feature."""
    ranks = mid_ranks(rows.groupBy("FEATURE", "VALUE").agg(F.count("*").alias("N")), "VALUE", "N", ("FEATURE",))
    return rows.join(ranks.select("FEATURE", "VALUE", "MID_RANK"), ["FEATURE", "VALUE"])


def shift(rows: DataFrame, weighted: bool = True) -> DataFrame:
    """TRAIN against VALIDATION per feature on log1p totals; weighted by pooled SD or scaled by the TRAIN SD.

    `rows` carries SPLIT and, when weighted, WEIGHT.
    """
    both = rows.filter(F.col("SPLIT").isin("train", "validation"))
    if not weighted:
        both = both.withColumn("WEIGHT", F.lit(1.0))
    return shift_of(histogram(both, "FEATURE", "SPLIT"), weighted)


def shift_of(hist: DataFrame, weighted: bool = True) -> DataFrame:
    """The same from weights W per (FEATURE, SPLIT, VALUE)."""
    m = moments(hist, ["FEATURE", "SPLIT"], F.log1p("VALUE"), F.col("W"))
    share = hist.groupBy("FEATURE", "SPLIT").agg((F.sum(F.when(F.col("VALUE") > 0, F.col("W")).otherwise(0.0)) / F.sum("W")).alias("P"))
    m = m.join(share, ["FEATURE", "SPLIT"])
    at = lambda split, c: F.max(F.when(F.col("SPLIT") == split, F.col(c)))
    w = m.groupBy("FEATURE").agg(*[at(s, c).alias(f"{s[0]}_{c}") for s in ("train", "validation") for c in ("MEAN", "VAR", "P")])
    scale = F.sqrt((F.col("t_VAR") + F.col("v_VAR")) / 2) if weighted else F.sqrt("t_VAR")
    return w.select("FEATURE", F.col("t_MEAN").alias("TRAIN_MEAN"), F.col("v_MEAN").alias("VALIDATION_MEAN"),
                    F.when(scale > 0, (F.col("v_MEAN") - F.col("t_MEAN")) / scale).otherwise(0.0).alias("STANDARDIZED_DIFFERENCE"),
                    F.col("t_P").alias("TRAIN_NONZERO"), F.col("v_P").alias("VALIDATION_NONZERO"))
