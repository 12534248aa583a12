"""Ranking and evaluation of scored snapshots: deciles, top shares, curves, thresholds and calibration."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.scalar import key_hash
from tidemark.operators.ordering import attach, decile, ranked, running_totals

KEY = ["PATIENT_ID", "END_DT"]


def capacity(rows: Column, percent: Column | int) -> Column:
    """max(1, ceil(percent / 100 * rows)) in whole-number arithmetic."""
    return F.greatest(F.lit(1), F.ceil(rows * percent / 100).cast("long"))


def label_blind_rank(df: DataFrame, score: str, groups: tuple = ()) -> DataFrame:
    """RANK by score descending; ties by SHA-256 of the key, then the key. Labels are never consulted."""
    order = [F.col(score).desc(), F.col("_tie"), *[F.col(k) for k in KEY]]
    return ranked(df.withColumn("_tie", key_hash(*KEY)), order, "RANK", groups).drop("_tie")


def with_decile(df: DataFrame, score: str, groups: tuple = ()) -> DataFrame:
    """Adds RANK, N (group size) and DECILE, 1 being the highest scores."""
    ranks = label_blind_rank(df, score, groups)
    sizes = ranks.groupBy(*groups).agg(F.count("*").alias("N"))
    return attach(ranks, sizes, list(groups)).withColumn("DECILE", decile(F.col("RANK"), F.col("N")))


def decile_table(df: DataFrame, score: str, label: str = "RESP", groups: tuple = ()) -> DataFrame:
    """Counts, rates, shares and cumulative figures per decile; ten rows per group."""
    groups = list(groups)
    per = with_decile(df, score, tuple(groups)).groupBy(*groups, "DECILE").agg(
        F.count("*").alias("ROWS"), F.sum(label).alias("POSITIVES"), F.max("N").alias("N"),
        F.min(score).alias("MIN_SCORE"), F.max(score).alias("MAX_SCORE"))
    run = W.partitionBy(*groups).orderBy("DECILE").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*groups)
    per = per.withColumn("CUM_ROWS", F.sum("ROWS").over(run)).withColumn("CUM_POSITIVES", F.sum("POSITIVES").over(run))
    per = per.withColumn("ALL_POSITIVES", F.sum("POSITIVES").over(whole))
    prevalence = F.nullif(F.col("ALL_POSITIVES") / F.col("N"), F.lit(0.0))
    rate = F.col("POSITIVES") / F.col("ROWS")
    cum_rate = F.col("CUM_POSITIVES") / F.col("CUM_ROWS")
    some = F.nullif(F.col("ALL_POSITIVES"), F.lit(0))
    return per.select(*per.columns, rate.alias("RATE"), (F.col("POSITIVES") / some).alias("SHARE"),
                      (rate / prevalence).alias("LIFT"), (F.col("CUM_POSITIVES") / some).alias("CUM_RECALL"),
                      cum_rate.alias("CUM_PRECISION"), (cum_rate / prevalence).alias("CUM_LIFT"))


def top_k_table(deciles: DataFrame, groups: tuple = ()) -> DataFrame:
    """Top 10, 20 and 30 percent as projections of the decile table."""
    return deciles.filter("DECILE <= 3").select(
        *groups, (F.col("DECILE") * 10).alias("PERCENT"), F.col("CUM_ROWS").alias("SELECTED"),
        F.col("CUM_POSITIVES").alias("CAPTURED"), F.col("CUM_RECALL").alias("RECALL"),
        F.col("CUM_PRECISION").alias("PRECISION"), F.col("CUM_LIFT").alias("LIFT"))


def top_share(df: DataFrame, score: str, percents: list[int], ties: list[Column], label: str = "RESP",
              groups: tuple = ()) -> DataFrame:
    """Exact capacity max(1, ceil(share * N)) with the given stable tie order; reports boundary ties."""
    groups = list(groups)
    ranks = ranked(df, [F.col(score).desc(), *ties], "RANK", tuple(groups))
    sizes = ranks.groupBy(*groups).agg(F.count("*").alias("N"), F.sum(label).alias("P"))
    rows = attach(ranks, sizes, groups)
    # One row per distinct score first: the boundary is then found without looking at single rows again.
    picks = F.explode(F.array(*[F.struct(F.lit(p).alias("PERCENT"), capacity(F.col("N"), p).alias("K")) for p in percents]))
    chosen = rows.select(*groups, "RANK", "N", "P", F.col(score).alias("_s"), F.col(label).alias("_y"), picks.alias("_p"))
    chosen = chosen.select(*groups, "RANK", "N", "P", "_s", "_y", "_p.*")
    inside = F.col("RANK") <= F.col("K")
    per = chosen.groupBy(*groups, "PERCENT", "_s").agg(
        F.max("N").alias("N"), F.max("P").alias("P"), F.max("K").alias("K"), F.count("*").alias("_n"),
        F.count_if(inside).alias("_c"), F.sum(F.when(inside, F.col("_y")).otherwise(0)).alias("_y"))
    at = F.struct("_s", "_n", "_c")
    cut = per.groupBy(*groups, "PERCENT").agg(
        F.max("N").alias("ROWS"), F.max("P").alias("POSITIVES"), F.max("K").alias("SELECTED"), F.sum("_y").alias("CAPTURED"),
        F.min(F.when(F.col("_c") > 0, at)).alias("_b"))
    precision = F.col("CAPTURED") / F.col("SELECTED")
    some = F.nullif(F.col("POSITIVES"), F.lit(0))
    return cut.select(*groups, "PERCENT", "ROWS", "POSITIVES", "SELECTED", "CAPTURED", precision.alias("PRECISION"),
                      (F.col("CAPTURED") / some).alias("RECALL"), (precision / (some / F.col("ROWS"))).alias("LIFT"),
                      F.col("_b._s").alias("CUTOFF_SCORE"), F.col("_b._n").alias("TIED_AT_CUTOFF"), F.col("_b._c").alias("TIED_SELECTED"))


def curve(df: DataFrame, score: str, label: str = "RESP", weight: Column | None = None, groups: tuple = ()) -> DataFrame:
    """Operating points, one per distinct score from high to low, so tied scores are never split.

    P and N are the (weighted) positives and negatives at the score, CUM_P and CUM_N those at or above it.
    """
    w = weight if weight is not None else F.lit(1).cast("long")
    y = F.col(label)
    points = df.groupBy(*groups, score).agg(F.sum(F.when(y == 1, w).otherwise(0)).alias("P"),
                                            F.sum(F.when(y == 0, w).otherwise(0)).alias("N"))
    return running_totals(points, [F.col(score).desc()], {"CUM_P": F.col("P"), "CUM_N": F.col("N")}, groups)


def curve_totals(points: DataFrame, groups: tuple = ()) -> DataFrame:
    totals = points.groupBy(*groups).agg(F.sum("P").alias("ALL_P"), F.sum("N").alias("ALL_N"))
    return attach(points, totals, list(groups))


def curve_metrics(points: DataFrame, groups: tuple = ()) -> DataFrame:
    """AP (non-interpolated), ROC-AUC (ties count half) per group; null where undefined."""
    full = curve_totals(points, groups)
    precision = F.col("CUM_P") / (F.col("CUM_P") + F.col("CUM_N"))
    ap = F.sum(F.col("P") / F.nullif(F.col("ALL_P"), F.lit(0)) * F.coalesce(precision, F.lit(0.0)))
    pairs = F.sum(F.col("N") * (F.col("CUM_P") - F.col("P") / 2)) / F.nullif(F.max("ALL_P") * F.max("ALL_N"), F.lit(0))
    return full.groupBy(*groups).agg(
        (F.max("ALL_P") + F.max("ALL_N")).alias("ROWS"), F.max("ALL_P").alias("POSITIVES"),
        ap.alias("AP"), pairs.alias("AUC"))


def pr_area(points: DataFrame, score: str) -> DataFrame:
    """Trapezoidal area under precision against recall, starting at (recall 0, precision 1).

    The previous point of a distinct score is (CUM_P - P, CUM_N - N), so no row has to look at a neighbour.
    """
    prev_n = F.col("CUM_P") - F.col("P") + F.col("CUM_N") - F.col("N")
    prev = F.when(prev_n == 0, 1.0).otherwise((F.col("CUM_P") - F.col("P")) / F.nullif(prev_n, F.lit(0)))
    here = F.col("CUM_P") / (F.col("CUM_P") + F.col("CUM_N"))
    return curve_totals(points).agg(F.sum(F.col("P") / F.col("ALL_P") * (prev + here) / 2).alias("PR_AREA"))


def curve_points(points: DataFrame, groups: tuple = ()) -> DataFrame:
    """Precision, recall, true and false positive rate per distinct score."""
    full = curve_totals(points, groups)
    return full.withColumn("PRECISION", F.col("CUM_P") / (F.col("CUM_P") + F.col("CUM_N"))).withColumn(
        "RECALL", F.col("CUM_P") / F.nullif(F.col("ALL_P"), F.lit(0))).withColumn(
        "FPR", F.col("CUM_N") / F.nullif(F.col("ALL_N"), F.lit(0)))


def best_f1(points: DataFrame, score: str, groups: tuple = ()) -> DataFrame:
    """Threshold of maximum F1 over distinct scores; equal F1 values keep the highest threshold."""
    f1 = 2 * F.col("CUM_P") / (F.col("ALL_P") + F.col("CUM_P") + F.col("CUM_N"))
    best = curve_totals(points, groups).groupBy(*groups).agg(F.max(F.struct(f1.alias("f1"), F.col(score).alias("s"))).alias("b"))
    return best.select(*groups, F.col("b.s").alias("THRESHOLD"), F.col("b.f1").alias("F1"))


def fractional_top(points: DataFrame, score: str, percent: int, groups: tuple = ()) -> DataFrame:
    """Top share where the tied boundary group is taken in proportion instead of by an arbitrary order."""
    groups = list(groups)
    full = curve_totals(points, tuple(groups)).withColumn("K", capacity(F.col("ALL_P") + F.col("ALL_N"), percent))
    above = F.col("CUM_P") - F.col("P") + F.col("CUM_N") - F.col("N")
    taken = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("K") - above) / (F.col("P") + F.col("N"))))
    done = full.groupBy(*groups).agg(F.sum(F.col("P") * taken).alias("CAPTURED"), F.max("K").alias("K"),
                                     F.max("ALL_P").alias("POSITIVES"), F.max(F.col("ALL_P") + F.col("ALL_N")).alias("ROWS"))
    precision = F.col("CAPTURED") / F.col("K")
    return done.withColumn("PRECISION", precision).withColumn("LIFT", precision / (F.col("POSITIVES") / F.col("ROWS")))


def confusion(df: DataFrame, score: str, threshold: float, label: str = "RESP", groups: tuple = ()) -> DataFrame:
    """Confusion counts at a fixed threshold; ratios with an empty denominator are 0."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    c = df.groupBy(*groups).agg(F.count_if(hit & y).alias("TP"), F.count_if(hit & ~y).alias("FP"),
                                F.count_if(~hit & y).alias("FN"), F.count_if(~hit & ~y).alias("TN"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("TP", "FP", "FN", "TN"))
    return c.select(*c.columns, ratio(tp, tp + fp).alias("PRECISION"), ratio(tp, tp + fn).alias("RECALL"),
                    ratio(2 * tp, 2 * tp + fp + fn).alias("F1"), ratio(tn, tn + fp).alias("SPECIFICITY"),
                    ratio(tp + tn, tp + fp + fn + tn).alias("ACCURACY"))


def probability_losses(df: DataFrame, score: str, label: str = "RESP", groups: tuple = (), clip: float = 1e-15) -> DataFrame:
    """Brier score and log loss with clipped probabilities."""
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(score)))
    y = F.col(label)
    loss = -(y * F.ln(p) + (1 - y) * F.ln(1 - p))
    return df.groupBy(*groups).agg(F.avg((F.col(score) - y) * (F.col(score) - y)).alias("BRIER"), F.avg(loss).alias("LOG_LOSS"))


def calibration(df: DataFrame, score: str, bins: int = 10, label: str = "RESP") -> DataFrame:
    """Fixed-width bins with empty ones kept, each carrying its share of the expected calibration error."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    found = df.groupBy(b.alias("BIN")).agg(F.count("*").alias("n"), F.avg(score).alias("MEAN_PROBABILITY"),
                                           F.avg(label).alias("OBSERVED_RATE"))
    spine = df.agg(F.count("*").alias("ALL_ROWS")).select("ALL_ROWS", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("BIN"))
    full = spine.join(found, "BIN", "left").withColumn("ROWS", F.coalesce("n", F.lit(0)))
    gap = F.coalesce(F.col("ROWS") / F.col("ALL_ROWS") * F.abs(F.col("MEAN_PROBABILITY") - F.col("OBSERVED_RATE")), F.lit(0.0))
    return full.select("BIN", (F.col("BIN") / bins).alias("LOWER"), ((F.col("BIN") + 1) / bins).alias("UPPER"), "ROWS",
                       "MEAN_PROBABILITY", "OBSERVED_RATE", gap.alias("ECE_PART"))


def boundary_ties(df: DataFrame, score: str, percents: tuple = (10, 20, 30), groups: tuple = ()) -> DataFrame:
    """Rows sharing the boundary score and how many of them were selected."""
    ties = [key_hash(*KEY), *[F.col(k) for k in KEY]]
    return top_share(df, score, list(percents), ties, groups=groups).select(
        *groups, "PERCENT", "SELECTED", "CUTOFF_SCORE", "TIED_AT_CUTOFF", "TIED_SELECTED",
        (F.col("TIED_AT_CUTOFF") > F.col("TIED_SELECTED")).alias("CROSSES"))


def competition_rank(table: DataFrame, value: str, blocked: str | None = None) -> DataFrame:
    """Rank of models (equal values share the smallest rank), blocked or null values unranked at the end."""
    usable = F.col(value).isNotNull() & (~F.col(blocked) if blocked else F.lit(True))
    keyed = table.withColumn("_v", F.when(usable, F.col(value)))
    return keyed.withColumn("MODEL_RANK", F.when(F.col("_v").isNotNull(), F.rank().over(W.orderBy(F.col("_v").desc_nulls_last())))).drop("_v")


def best_by(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """Winner per group: the row with the smallest order tuple, by one aggregation without sorting."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*groups).agg(F.min_by(row, F.struct(*order)).alias("_w")).select("_w.*")


def latest_snapshot(rows: DataFrame, label: str = "RESP") -> DataFrame:
    """The latest snapshot of each entity. A latest key that stands there twice is refused when the result is read, not picked from."""
    per = rows.groupBy("PATIENT_ID", "END_DT").agg(F.max(label).alias(label), F.count("*").alias("_n"))
    last = per.groupBy("PATIENT_ID").agg(F.max("END_DT").alias("END_DT"), F.max_by(label, "END_DT").alias(label), F.max_by("_n", "END_DT").alias("_n"))
    refused = F.raise_error(F.concat(F.lit("duplicate latest key of entity "), F.col("PATIENT_ID")))
    return last.select("PATIENT_ID", "END_DT", F.when(F.col("_n") > 1, refused.cast(rows.schema[label].dataType)).otherwise(F.col(label)).alias(label))
