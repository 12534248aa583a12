"""Vocabularies, feature lists, redundancy and model-based selection."""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.scalar import hash_int
from tidemark.operators import evaluation as evl
from tidemark.operators.association import COUNT_SCALE_FLOOR, moments
from tidemark.operators.ordering import attach, ranked, running_totals
from tidemark.session import settle, settle_table

KEY = ["PATIENT_ID", "END_DT"]


def rank_stability(scores: DataFrame) -> DataFrame:
    """Mean, SD and number of fold ranks per feature from (FEATURE, FOLD, SCORE); a fold holds one row per feature."""
    r = scores.withColumn("r", F.rank().over(W.partitionBy("FOLD").orderBy(F.desc("SCORE"), "FEATURE")))
    return r.groupBy("FEATURE").agg(F.avg("r").alias("MEAN_RANK"), F.stddev_samp("r").alias("SD_RANK"), F.count("*").alias("FOLDS"))


def train_support(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Distinct training entities per feature; pairs are deduplicated before counting."""
    pairs = rows.select("FEATURE", "PATIENT_ID").distinct().join(train.select("PATIENT_ID").distinct(), "PATIENT_ID", "left_semi")
    return pairs.groupBy("FEATURE").agg(F.count("*").alias("SUPPORT"))


def capped_vocabulary(support: DataFrame, columns: int, reserved: int = 1) -> DataFrame:
    """Best supported features as count/recent pairs within a column budget, ties by name."""
    pairs = (columns - reserved) // 2
    top = support.orderBy(F.desc("SUPPORT"), "FEATURE").limit(pairs)
    top = top.withColumn("POSITION", F.row_number().over(W.orderBy(F.desc("SUPPORT"), "FEATURE")))
    return top.withColumn("MEASURE", F.explode(F.array(F.lit("COUNT"), F.lit("RECENT"))))


def top_k_flag(features: DataFrame, score: str, k: int, name: str = "FEATURE_NAME") -> DataFrame:
    """Flag the k best features; the table keeps its own order column. One row per declared feature."""
    return features.withColumn("SELECTED", F.row_number().over(W.orderBy(F.desc(score), name)) <= k)


def components(edges: DataFrame) -> DataFrame:
    """Connected components (NODE, COMPONENT) by minimum-label propagation with pointer jumping.

    Edges come from a feature-pair table, at most features squared. Each round is checkpointed; labels only fall, so it ends.
    """
    both = edges.select(F.col("FEATURE_A").alias("u"), F.col("FEATURE_B").alias("v"))
    both = settle(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("c").alias("n")), "v").groupBy("u").agg(F.min("n").alias("n"))
        step = labels.join(near, "u").select("u", F.least("c", "n").alias("m"), F.col("c").alias("old"))
        jump = labels.select(F.col("u").alias("m"), F.col("c").alias("up"))
        new = settle(step.join(jump, "m").select("u", F.least("m", "up").alias("c"), "old"))
        labels = new.select("u", "c")
        if new.filter("c <> old").limit(1).count() == 0:
            return labels.select(F.col("u").alias("NODE"), F.col("c").alias("COMPONENT"))


def greedy_prune(ranking: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keep features in rank order unless correlated with a better kept one (REDUNDANT_WITH, the best such).

    Decided in parallel rounds: an open feature whose better neighbours are all rejected is kept; an open
    feature with a kept better neighbour is rejected. Equivalent to the sequential rule, one row per feature.
    Ranks are distinct, so every round decides at least the best open feature and the loop ends.
    """
    sym = settle(pairs.select(F.col("FEATURE_A").alias("a"), F.col("FEATURE_B").alias("b")))
    sym = sym.unionByName(sym.select(F.col("b").alias("a"), F.col("a").alias("b")))
    r = settle(ranking.select("FEATURE", "RANK"))
    better = settle(sym.join(r.select(F.col("FEATURE").alias("a"), F.col("RANK").alias("ra")), "a")
                    .join(r.select(F.col("FEATURE").alias("b"), F.col("RANK").alias("rb")), "b").filter("rb < ra").select("a", "b", "rb"))
    state = r.withColumn("STATE", F.lit("open"))
    while True:
        around = better.join(state.select(F.col("FEATURE").alias("b"), F.col("STATE").alias("sb")), "b").groupBy(F.col("a").alias("FEATURE")).agg(
            F.min_by("b", F.when(F.col("sb") == "kept", F.col("rb"))).alias("BY"), F.count_if(F.col("sb") == "kept").alias("k"),
            F.count_if(F.col("sb") == "open").alias("o"))
        if state.filter("STATE = 'open'").limit(1).count() == 0:
            return state.join(around.select("FEATURE", "BY"), "FEATURE", "left").select(
                "FEATURE", "RANK", "STATE", F.when(F.col("STATE") == "redundant", F.col("BY")).alias("REDUNDANT_WITH"))
        is_open = F.col("STATE") == "open"
        kept, waiting = F.coalesce("k", F.lit(0)) > 0, F.coalesce("o", F.lit(0)) > 0
        state = settle(state.join(around, "FEATURE", "left").select(
            "FEATURE", "RANK", F.when(is_open & kept, "redundant").when(is_open & ~waiting, "kept").otherwise(F.col("STATE")).alias("STATE")))


def filter_list(ranking: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """Filter selection in rank order: STATE kept, redundant (with a better kept feature), zero_information or over_limit.

    ranking: FEATURE, RANK, MI. Features without information and those after the limit are not kept, so they make no other redundant.
    """
    informed = ranking.filter(F.round("MI", 9) > 0)
    chosen = greedy_prune(informed, pairs).filter("STATE = 'kept'").orderBy("RANK").limit(limit).select("FEATURE", "RANK")
    chosen = settle(chosen)
    sym = pairs.select(F.col("FEATURE_A").alias("a"), F.col("FEATURE_B").alias("b"))
    sym = sym.unionByName(sym.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = (sym.join(chosen.select(F.col("FEATURE").alias("b"), F.col("RANK").alias("rb")), "b")
            .join(ranking.select(F.col("FEATURE").alias("a"), F.col("RANK").alias("ra")), "a").filter("rb < ra"))
    by = near.groupBy(F.col("a").alias("FEATURE")).agg(F.min_by("b", "rb").alias("BY"))
    all_ = ranking.join(by, "FEATURE", "left").join(chosen.select("FEATURE", F.lit(True).alias("kept")), "FEATURE", "left")
    state = (F.when(F.col("kept"), "kept").when(F.col("BY").isNotNull(), "redundant").when(F.round("MI", 9) <= 0, "zero_information")
             .otherwise("over_limit"))
    return all_.select("FEATURE", "RANK", state.alias("STATE"), F.when(state == "redundant", F.col("BY")).alias("REDUNDANT_WITH"))


def stratified_folds(entities: DataFrame, k: int, seed: str, label: str = "RESP") -> DataFrame:
    """Balanced folds of entities within each label stratum, by hash order."""
    keyed = entities.withColumn("_h", hash_int(F.concat(F.lit(seed + "|"), "PATIENT_ID")))
    r = ranked(keyed, [F.col("_h"), F.col("PATIENT_ID")], "_r", (label,))
    return r.select("PATIENT_ID", label, F.pmod(F.col("_r") - 1, F.lit(k)).cast("int").alias("FOLD"))


def one_standard_error(table: DataFrame) -> DataFrame:
    """Choices from (CANDIDATE, FEATURES, MEAN_AP, SE_AP): best, smallest within one SE, next smaller, all."""
    row = F.struct("CANDIDATE", "FEATURES", "MEAN_AP", "SE_AP")
    best = table.agg(F.min_by(row, F.struct(-F.col("MEAN_AP"), F.col("FEATURES"), F.col("CANDIDATE"))).alias("b"))
    near = attach(table, best, []).filter(F.col("MEAN_AP") >= F.col("b.MEAN_AP") - F.col("b.SE_AP"))
    one = near.agg(F.min_by(row, F.struct(F.col("FEATURES"), -F.col("MEAN_AP"))).alias("o"), F.max("b").alias("b"))
    small = attach(table, one, []).filter(F.col("FEATURES") < F.col("o.FEATURES")).agg(
        F.max_by("CANDIDATE", "FEATURES").alias("s"))
    done = attach(one, small, [])
    pick = lambda n, c: F.struct(F.lit(n).alias("CHOICE"), c.alias("CANDIDATE"))
    return done.select(F.inline(F.array(pick("proxy_best", F.col("b.CANDIDATE")), pick("proxy_one_se", F.col("o.CANDIDATE")),
                                        pick("one_smaller", F.col("s")), pick("all_eligible", F.lit("all_eligible"))))).filter("CANDIDATE IS NOT NULL")


def _design(columns: list[int], center: list[float] | None = None, scale: list[float] | None = None) -> Column:
    """The chosen entries of X as one array, centred and scaled; a single expression however many columns there are."""
    center, scale = center or [0.0] * len(columns), scale or [1.0] * len(columns)
    want = F.array(*[F.struct(F.lit(c + 1).alias("i"), F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for c, m, s in zip(columns, center, scale)])
    return F.transform(want, lambda z: (F.element_at("X", z["i"]) - z["m"]) / z["s"])


def _fit(rows: DataFrame, columns: list[int], reg: float, mix: float = 0.0, iterations: int = 1000, center=None, scale=None, standard=True):
    data = rows.select(F.col("RESP").cast("double").alias("label"), F.col("WEIGHT").cast("double").alias("w"),
                       array_to_vector(_design(columns, center, scale)).alias("features"))
    return LogisticRegression(weightCol="w", regParam=reg, elasticNetParam=mix, maxIter=iterations, tol=1e-6, standardization=standard).fit(data)


def score_rows(rows: DataFrame, coefficients, columns: list[int], intercept: float, center=None, scale=None) -> DataFrame:
    """Apply a fitted linear model as one expression."""
    parts = F.zip_with(_design(columns, center, scale), F.array(*[F.lit(float(c)) for c in coefficients]), lambda x, c: x * c)
    z = F.aggregate(parts, F.lit(float(intercept)), lambda total, x: total + x)
    return rows.withColumn("SCORE", 1 / (1 + F.exp(-z)))


def fold_ledger(hist: DataFrame, folds: int) -> DataFrame:
    """What each training side of a grouped cross-validation says of each feature, from one histogram of the whole.

    hist: weights W and counts N per (FEATURE, FOLD, RESP, VALUE). Rows of a fold enter the sums of all other hold-outs, so rows are read
    once however many folds there are. Per (HOLDOUT, FEATURE): ELIGIBLE (not constant), CENTER and SCALE of the log1p values, AP of the
    feature ranked upwards and downwards, and RANK by the better of both (eligible first, ties by name).
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda h: h != F.col("FOLD"))
    cells = hist.withColumn("HOLDOUT", F.explode(others)).groupBy("HOLDOUT", "FEATURE", "VALUE").agg(
        F.sum(F.when(F.col("RESP") == 1, F.col("W")).otherwise(0.0)).alias("P"), F.sum(F.when(F.col("RESP") == 0, F.col("W")).otherwise(0.0)).alias("N"))
    cells = settle(cells)
    groups = ["HOLDOUT", "FEATURE"]
    form = moments(cells, groups, F.log1p("VALUE"), F.col("P") + F.col("N")).select(
        *groups, F.col("MEAN").alias("CENTER"), F.greatest(F.sqrt("VAR"), F.lit(COUNT_SCALE_FLOOR)).alias("SCALE"))
    whole = cells.groupBy(*groups).agg(F.sum("P").alias("TP"), F.sum("N").alias("TN"), (F.max("VALUE") > F.min("VALUE")).alias("ELIGIBLE"))
    run = running_totals(cells, [F.col("VALUE").desc()], {"CP": F.col("P"), "CN": F.col("N")}, tuple(groups)).join(whole, groups)
    part = lambda p, n: F.when(F.col("P") > 0, F.col("P") / F.col("TP") * (p / (p + n))).otherwise(0.0)
    low_p, low_n = F.col("TP") - F.col("CP") + F.col("P"), F.col("TN") - F.col("CN") + F.col("N")
    ap = run.groupBy(*groups).agg(F.sum(part(F.col("CP"), F.col("CN"))).alias("AP_UP"), F.sum(part(low_p, low_n)).alias("AP_DOWN"))
    table = whole.select(*groups, "ELIGIBLE").join(form, groups).join(ap, groups)
    order = W.partitionBy("HOLDOUT").orderBy(F.desc("ELIGIBLE"), F.round(F.greatest("AP_UP", "AP_DOWN"), 9).desc(), "FEATURE")  # one row per declared feature
    return table.withColumn("RANK", F.row_number().over(order))


def candidate_sizes(eligible: int, sizes: tuple[int, ...]) -> list[int]:
    """Sizes cut to the eligible features, and all of them."""
    return sorted({min(k, eligible) for k in sizes} | {eligible})


def grouped_cv(rows: DataFrame, ledger: DataFrame, names: list[str], folds: int, sizes: tuple[int, ...], reg: float) -> DataFrame:
    """AP and top-decile lift per (fold, size): rank, transform and fit on the other folds, score the held-out one.

    rows: KEY, RESP, WEIGHT, FOLD, X (log1p values in the order of names); kept compressed for the loop of fits. Of the ledger, one row per
    fold and declared feature comes to the driver.
    """
    rows = settle_table(rows)
    place = {n: i for i, n in enumerate(names)}
    by_fold = [[] for _ in range(folds)]
    for r in ledger.filter("ELIGIBLE").select("HOLDOUT", "RANK", "FEATURE", "CENTER", "SCALE").collect():
        by_fold[r.HOLDOUT].append((r.RANK, place[r.FEATURE], r.CENTER, r.SCALE))
    scored = None
    for fold, found in enumerate(by_fold):
        found.sort()
        fit_rows, held = rows.filter(F.col("FOLD") != fold), rows.filter(F.col("FOLD") == fold)
        for size in candidate_sizes(len(found), sizes):
            _, columns, center, scale = map(list, zip(*found[:size]))
            model = _fit(fit_rows, columns, reg, center=center, scale=scale)
            part = score_rows(held, model.coefficients, columns, model.intercept, center, scale).select(
                *KEY, "RESP", "WEIGHT", "FOLD", F.lit(size).alias("FEATURES"), "SCORE")
            scored = part if scored is None else scored.unionByName(part)
    groups = ("FOLD", "FEATURES")
    ap = evl.curve_metrics(evl.curve(scored, "SCORE", weight=F.col("WEIGHT"), groups=groups), groups)
    lift = evl.top_share(scored, "SCORE", [10], [F.col(k) for k in KEY], groups=groups)
    return ap.select(*groups, "AP").join(lift.select(*groups, "LIFT"), list(groups))


def balanced(rows: DataFrame) -> DataFrame:
    """Rows with WEIGHT scaled so that both classes weigh the same; only the class totals reach the driver."""
    totals = {r.RESP: r.w for r in rows.groupBy("RESP").agg(F.sum("WEIGHT").alias("w")).collect()}
    factor = F.lit(1.0)
    for label, weight in totals.items():
        factor = F.when(F.col("RESP") == label, sum(totals.values()) / (len(totals) * weight)).otherwise(factor)
    return rows.withColumn("WEIGHT", F.col("WEIGHT") * factor)
