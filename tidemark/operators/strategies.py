"""Filter, wrapper and embedded selection, refitted on every training side of a grouped cross-validation and on all rows.

A scope is one fit population: scope h holds all rows outside fold h, scope WHOLE all rows. Ledgers of all scopes come from one histogram by
fold; only what each scope says of the declared features (never rows) reaches the driver, where it steers the model fits.
"""

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.operators import association as asc, evaluation as evl, selection as sel
from tidemark.session import settle

WHOLE = -1
SCOPED = ["SCOPE", "FEATURE"]
KEY = ["PATIENT_ID", "END_DT"]
#: Coefficients up to this size count as zero.
DEAD = 1e-8


@dataclass(frozen=True)
class Settings:
    """List lengths, redundancy threshold and model parameters of the three strategies."""

    filter_list: int = 100
    shortlist: int = 100
    wrapper_list: int = 50
    embedded_list: int = 100
    step: float = 0.25
    redundancy: float = 0.95
    elastic_strength: float = 0.1
    elastic_mix: float = 0.5
    trees: int = 128
    depth: int = 6
    leaf: int = 15
    iterations: int = 2000
    seed: int = 42


def _scopes(folds: int) -> Column:
    """The scopes that a row of FOLD belongs to."""
    return F.filter(F.sequence(F.lit(WHOLE), F.lit(folds - 1)), lambda s: s != F.col("FOLD"))


def in_scope(rows: DataFrame, scope: int) -> DataFrame:
    return rows if scope == WHOLE else rows.filter(F.col("FOLD") != scope)


def scope_duplicates(sparse: asc.SparseRows, folds: int) -> DataFrame:
    """(SCOPE, FEATURE, DUPLICATE_OF): same values in all rows of the scope as the feature of smallest name.

    Fingerprints per fold are sums, so those of a scope are sums of them; what they bring together is compared cell by cell.
    """
    big = "decimal(38,0)"
    at = [F.col("POS"), F.col("VALUE")]
    prints = sparse.cells.groupBy("FEATURE", "FOLD").agg(
        F.count("*").alias("n"), F.sum(F.xxhash64(*at).cast(big)).alias("a"), F.sum(F.xxhash64(F.lit(7), *at).cast(big)).alias("b"))
    prints = settle(prints.withColumn("SCOPE", F.explode(_scopes(folds))).groupBy(*SCOPED).agg(
        F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")))
    same = ["SCOPE", "n", "a", "b"]
    first = prints.groupBy(*same).agg(F.min("FEATURE").alias("DUPLICATE_OF"), F.count("*").alias("c")).filter("c > 1")
    pairs = settle(prints.join(first, same).filter("FEATURE <> DUPLICATE_OF").select(*SCOPED, "DUPLICATE_OF"))
    cells = sparse.cells.select("POS", "FOLD", "FEATURE", "VALUE")
    mine = cells.join(pairs, "FEATURE").filter("FOLD <> SCOPE")
    other = cells.select("POS", F.col("FEATURE").alias("DUPLICATE_OF"), F.col("VALUE").alias("_v"))
    checked = mine.join(other, ["POS", "DUPLICATE_OF"], "left").groupBy(*SCOPED, "DUPLICATE_OF").agg(
        F.count_if(~F.col("VALUE").eqNullSafe(F.col("_v"))).alias("_bad"))
    return checked.filter("_bad = 0").drop("_bad")


def scope_ledger(sparse: asc.SparseRows, folds: int) -> DataFrame:
    """One row per (SCOPE, declared feature): support, QUALITY_REASON, transform, label effect, information and RANK among the eligible.

    sparse: rows with FOLD and RESP, one per entity. CENTER and SCALE are mean and population SD of the log1p values; EFFECT is the
    difference of the class means in units of SCALE; RANK goes by information, ties by name, and is null for features that fail the gate.
    """
    hist = settle(asc.sparse_histogram(sparse, "FOLD", "RESP"))
    cells = settle(hist.withColumn("SCOPE", F.explode(_scopes(folds))).groupBy(*SCOPED, "RESP", "VALUE").agg(F.sum("N").alias("N")))
    base = cells.groupBy(*SCOPED).agg(
        F.sum("N").alias("OBSERVED"), F.coalesce(F.sum(F.when(F.col("VALUE") != 0, F.col("N"))), F.lit(0)).alias("NONZERO"),
        F.min("VALUE").alias("LOW"), F.max("VALUE").alias("HIGH"))
    log = F.log1p("VALUE")
    form = asc.moments(cells, SCOPED, log, F.col("N")).select(*SCOPED, F.col("MEAN").alias("CENTER"), F.sqrt("VAR").alias("_sd"))
    of = lambda y, x: F.sum(F.when(F.col("RESP") == y, x))
    effect = cells.groupBy(*SCOPED).agg((of(1, log * F.col("N")) / of(1, F.col("N")) - of(0, log * F.col("N")) / of(0, F.col("N"))).alias("_gap"))
    info = asc.discrete_information(cells.select(F.struct(*SCOPED).alias("FEATURE"), "VALUE", "RESP", "N")).select("FEATURE.*", "MI")
    table = base.join(form, SCOPED).join(effect, SCOPED).join(info, SCOPED).join(scope_duplicates(sparse, folds), SCOPED, "left")
    reason = (F.when(F.col("OBSERVED") < asc.MIN_OBSERVED, "insufficient_observations").when(F.col("LOW") == F.col("HIGH"), "constant_observed_values")
              .when(F.col("NONZERO") < asc.MIN_NONZERO, "insufficient_nonzero_support")
              .when(F.col("DUPLICATE_OF").isNotNull(), "exact_duplicate").otherwise("eligible"))
    scale = F.when(F.col("LOW") == F.col("HIGH"), 1.0).otherwise(F.col("_sd"))
    table = table.withColumn("QUALITY_REASON", reason).withColumn("SCALE", scale).withColumn("EFFECT", F.col("_gap") / F.col("SCALE"))
    eligible = F.col("QUALITY_REASON") == "eligible"
    order = W.partitionBy("SCOPE", eligible).orderBy(F.round("MI", 9).desc(), "FEATURE")  # one row per declared feature
    return table.withColumn("RANK", F.when(eligible, F.row_number().over(order))).select(
        *SCOPED, "OBSERVED", "NONZERO", "LOW", "HIGH", "QUALITY_REASON", "DUPLICATE_OF", "CENTER", "SCALE", "EFFECT", "MI", "RANK")


def scope_pairs(sparse: asc.SparseRows, scopes: list[int], threshold: float) -> DataFrame:
    """(SCOPE, FEATURE_A, FEATURE_B, CORRELATION) with |Spearman| at or above the threshold in the rows of each scope."""
    names = list(sparse.names)
    parts = []
    for scope in scopes:
        own = asc.sparse_rows(in_scope(sparse.rows, scope).drop("POS"), names)
        matrix = asc.sparse_rank_gram(own)
        if matrix is None:
            value = F.coalesce(F.try_element_at("COUNTS", F.col("FEATURE")), F.lit(0)).cast("double")
            cells = own.rows.withColumn("FEATURE", F.explode(F.array(*[F.lit(n) for n in names]))).withColumn("VALUE", value).drop("COUNTS")
            matrix = asc.gram(asc.vectors(asc.with_ranks(cells), "MID_RANK", names), "X", len(names))
        parts.append(asc.pairs_of(matrix, names, threshold).withColumn("SCOPE", F.lit(scope)))
    return reduce(DataFrame.unionByName, parts)


def filter_lists(ledger: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """(SCOPE, FEATURE, RANK, SELECTED, REASON, REDUNDANT_WITH) of eligible features: by information, without those near a better one.

    All scopes are pruned together, a feature of a scope being one name. Features without information and those over the limit are not
    chosen and make no other redundant.
    """
    name = lambda c: F.concat(F.col("SCOPE").cast("string"), F.lit("|"), F.col(c))
    order = settle(ledger.filter("RANK IS NOT NULL").select(*SCOPED, "RANK", "MI"))
    near = settle(pairs.select("SCOPE", "FEATURE_A", "FEATURE_B"))
    state = sel.greedy_prune(order.filter(F.round("MI", 9) > 0).select(name("FEATURE").alias("FEATURE"), "RANK"),
                             near.select(name("FEATURE_A").alias("FEATURE_A"), name("FEATURE_B").alias("FEATURE_B")))
    kept = order.withColumn("_n", name("FEATURE")).join(state.filter("STATE = 'kept'").select(F.col("FEATURE").alias("_n")), "_n")
    place = F.row_number().over(W.partitionBy("SCOPE").orderBy("RANK"))  # at most one row per declared feature
    chosen = settle(kept.withColumn("_p", place).filter(F.col("_p") <= limit).select(*SCOPED, "RANK"))
    both = near.unionByName(near.select("SCOPE", F.col("FEATURE_B").alias("FEATURE_A"), F.col("FEATURE_A").alias("FEATURE_B")))
    better = (both.join(chosen.select("SCOPE", F.col("FEATURE").alias("FEATURE_B"), F.col("RANK").alias("_rb")), ["SCOPE", "FEATURE_B"])
              .join(order.select("SCOPE", F.col("FEATURE").alias("FEATURE_A"), F.col("RANK").alias("_ra")), ["SCOPE", "FEATURE_A"]).filter("_rb < _ra")
              .groupBy("SCOPE", F.col("FEATURE_A").alias("FEATURE")).agg(F.min_by("FEATURE_B", "_rb").alias("REDUNDANT_WITH")))
    full = order.join(better, SCOPED, "left").join(chosen.select(*SCOPED, F.lit(True).alias("_kept")), SCOPED, "left")
    reason = (F.when(F.col("_kept"), "selected").when(F.col("REDUNDANT_WITH").isNotNull(), "spearman_redundancy")
              .when(F.round("MI", 9) <= 0, "zero_estimated_mutual_information").otherwise("below_selection_cutoff"))
    return full.select(*SCOPED, "RANK", F.coalesce("_kept", F.lit(False)).alias("SELECTED"), reason.alias("REASON"), "REDUNDANT_WITH")


def embedded_lists(components: DataFrame, limit: int) -> DataFrame:
    """Mean of the two component ranks per (SCOPE, FEATURE), and the first `limit` features that count in one of them.

    components: SCOPE, FEATURE, COEFFICIENT, IMPORTANCE, one row per eligible feature. Ties (to 9 digits) share the average rank; features
    with a coefficient of zero and no importance hold a rank and a RANK of their own but are never selected.
    """
    rows = components.withColumn("_c", F.round(F.abs("COEFFICIENT"), 9)).withColumn("_i", F.round("IMPORTANCE", 9))
    mid = lambda c: F.rank().over(W.partitionBy("SCOPE").orderBy(F.desc(c))) + (F.count("*").over(W.partitionBy("SCOPE", c)) - 1) / 2
    rows = rows.withColumn("MEAN_RANK", (mid("_c") + mid("_i")) / 2)
    dead = (F.abs("COEFFICIENT") <= DEAD) & (F.col("IMPORTANCE") <= 0)
    order = lambda *by: F.row_number().over(W.partitionBy("SCOPE", *by).orderBy("MEAN_RANK", "FEATURE"))
    rows = rows.withColumn("_dead", dead).withColumn("RANK", order()).withColumn("SELECTED", ~F.col("_dead") & (order("_dead") <= limit))
    reason = F.when(F.col("SELECTED"), "selected").when(F.col("_dead"), "zero_importance_in_both_models").otherwise("below_selection_cutoff")
    return rows.select(*SCOPED, "COEFFICIENT", "IMPORTANCE", "MEAN_RANK", "RANK", "SELECTED", reason.alias("REASON"))


def fold_frequency(choices: DataFrame, ledger: DataFrame, folds: int, *by: str) -> DataFrame:
    """Per declared feature (and `by`): in how many training sides it was selected, and how often it passed the gate there.

    choices: SCOPE, FEATURE, SELECTED and `by`. SELECTED of the result is that of the fit on all rows.
    """
    fold = F.col("SCOPE") != WHOLE
    whole = lambda c: F.coalesce(F.bool_or(~fold & F.col(c)), F.lit(False))
    gate = ledger.groupBy("FEATURE").agg((F.count_if(fold & (F.col("QUALITY_REASON") == "eligible")) / folds).alias("FOLD_ELIGIBILITY_FREQUENCY"))
    per = choices.groupBy("FEATURE", *by).agg(whole("SELECTED").alias("SELECTED"), F.count_if(fold & F.col("SELECTED")).alias("FOLD_SELECTION_COUNT"))
    return per.join(gate, "FEATURE").withColumn("FOLD_SELECTION_FREQUENCY", F.col("FOLD_SELECTION_COUNT") / folds)


class ScopeFits:
    """Models of one scope: rows standardised by the scope's own ledger, classes weighing the same.

    rows: KEY, RESP, FOLD, X (log1p values in the order of names), kept. state: feature to (CENTER, SCALE, RANK, MI) of the scope.
    """

    def __init__(self, rows: DataFrame, scope: int, names: list[str], state: dict, settings: Settings):
        self.settings, self.place, self.state = settings, {n: i for i, n in enumerate(names)}, state
        self.order = sorted(state, key=lambda n: state[n].RANK)
        self.rows = settle(sel.balanced(in_scope(rows, scope).withColumn("WEIGHT", F.lit(1.0))))
        self.held = rows.filter(F.col("FOLD") == scope)
        self.size, self.rate = self.rows.agg(F.count("*"), F.avg("RESP")).first()

    def _columns(self, names):
        return [self.place[n] for n in names], [self.state[n].CENTER for n in names], [self.state[n].SCALE for n in names]

    def linear(self, names: list[str], strength: float = 1.0, mix: float = 0.0):
        """Logistic model on standardised columns; strength divides the penalty by the number of rows, as the loss is an average."""
        columns, center, scale = self._columns(names)
        return sel._fit(self.rows, columns, 1 / (strength * self.size), mix, self.settings.iterations, center, scale, standard=False)

    def wrapper(self, keep: int) -> list[tuple[str, int, float | None]]:
        """(feature, elimination rank, |coefficient| of the last model) of the shortlist; survivors have rank 1."""
        left = self.order[:self.settings.shortlist]
        step, removed = max(1, int(self.settings.step * len(left))), []
        while len(left) > keep:
            weight = dict(zip(left, map(abs, self.linear(left).coefficients)))
            out = sorted(left, key=lambda n: (weight[n], n))[:min(step, len(left) - keep)]
            removed.append(out)
            left = [n for n in left if n not in set(out)]
        last = zip(left, self.linear(left).coefficients) if left else ()
        return [(n, 1, abs(float(c))) for n, c in last] + [(n, k, None) for k, out in enumerate(reversed(removed), 2) for n in out]

    def embedded(self) -> list[tuple[str, float, float]]:
        """(feature, elastic-net coefficient, forest importance) of the eligible features."""
        s = self.settings
        if not self.order:
            return []
        net = self.linear(self.order, s.elastic_strength, s.elastic_mix).coefficients
        data = self.rows.select(F.col("RESP").cast("double").alias("label"), F.col("WEIGHT").alias("w"),
                                array_to_vector(sel._design(*self._columns(self.order))).alias("features"))
        forest = RandomForestClassifier(numTrees=s.trees, maxDepth=s.depth, seed=s.seed, weightCol="w", minInstancesPerNode=s.leaf).fit(data)
        return [(n, float(net[i]), float(forest.featureImportances[i])) for i, n in enumerate(self.order)]

    def scores(self, names: list[str]) -> DataFrame:
        """Rows outside the scope with SCORE of a ridge model on the chosen features; the mean label where none is chosen."""
        if not names:
            return self.held.withColumn("SCORE", F.lit(float(self.rate)))
        columns, center, scale = self._columns(names)
        model = self.linear(names)
        return sel.score_rows(self.held, model.coefficients, columns, model.intercept, center, scale)


def states(ledger: DataFrame) -> dict[int, dict]:
    """Per scope what the eligible features are transformed and ranked by; one row per scope and declared feature reaches the driver."""
    found = defaultdict(dict)
    for r in ledger.filter("RANK IS NOT NULL").select(*SCOPED, "CENTER", "SCALE", "RANK", "MI").collect():
        found[r.SCOPE][r.FEATURE] = r
    return found


def wrapper_table(fits: dict[int, ScopeFits], spark, keep: int) -> DataFrame:
    """(SCOPE, FEATURE, SHORTLIST_MI, RFE_RANK, FINAL_ABS_COEFFICIENT, RANK, SELECTED) of the shortlists."""
    rows = [(s, n, fit.state[n].MI, rank, c) for s, fit in fits.items() for n, rank, c in fit.wrapper(keep)]
    table = spark.createDataFrame(rows, "SCOPE int, FEATURE string, SHORTLIST_MI double, RFE_RANK int, FINAL_ABS_COEFFICIENT double")
    order = W.partitionBy("SCOPE").orderBy("RFE_RANK", F.coalesce("FINAL_ABS_COEFFICIENT", F.lit(0.0)).desc(), "FEATURE")
    return table.withColumn("RANK", F.row_number().over(order)).withColumn("SELECTED", F.col("RFE_RANK") == 1)


def embedded_table(fits: dict[int, ScopeFits], spark, limit: int) -> DataFrame:
    rows = [(s, *r) for s, fit in fits.items() for r in fit.embedded()]
    return embedded_lists(spark.createDataFrame(rows, "SCOPE int, FEATURE string, COEFFICIENT double, IMPORTANCE double"), limit)


def strategy_choices(sparse: asc.SparseRows, ledger: DataFrame, fits: dict[int, ScopeFits], settings: Settings) -> DataFrame:
    """(STRATEGY, SCOPE, FEATURE, RANK, SELECTED) of the three strategies in the scopes of `fits`; kept, at most one row per feature each."""
    spark, scopes = ledger.sparkSession, sorted(fits)
    own = ledger.filter(F.col("SCOPE").isin(scopes))
    tables = {"filter": filter_lists(own, scope_pairs(sparse, scopes, settings.redundancy), settings.filter_list),
              "wrapper": wrapper_table(fits, spark, settings.wrapper_list), "embedded": embedded_table(fits, spark, settings.embedded_list)}
    return settle(reduce(DataFrame.unionByName, [t.select(F.lit(n).alias("STRATEGY"), *SCOPED, "RANK", "SELECTED") for n, t in tables.items()]))


def strategy_diagnostics(choices: DataFrame, fits: dict[int, ScopeFits]) -> DataFrame:
    """Per (STRATEGY, FOLD): rows scored, features, AP, prevalence, precision and lift of the top tenth, tied scores taken in proportion.

    Every strategy, and all eligible features, is scored by the same ridge model fitted outside the fold.
    """
    chosen = defaultdict(list)
    for r in choices.filter("SELECTED").orderBy("RANK", "FEATURE").collect():
        chosen[r.STRATEGY, r.SCOPE].append(r.FEATURE)
    parts = []
    for scope, fit in fits.items():
        if scope == WHOLE:
            continue
        for strategy in ("filter", "wrapper", "embedded", "all_eligible"):
            names = fit.order if strategy == "all_eligible" else chosen[strategy, scope]
            parts.append(fit.scores(names).select(*KEY, "RESP", "SCORE", F.lit(strategy).alias("STRATEGY"), F.lit(scope).alias("FOLD"),
                                                  F.lit(len(names)).alias("FEATURES"), F.lit(fit.size).alias("FIT_ROWS")))
    groups = ["STRATEGY", "FOLD", "FEATURES", "FIT_ROWS"]
    points = settle(evl.curve(reduce(DataFrame.unionByName, parts), "SCORE", groups=tuple(groups)))
    size = points.groupBy(*groups).agg(F.sum(F.col("P") + F.col("N")).alias("ROWS"), (F.sum("P") / F.sum(F.col("P") + F.col("N"))).alias("PREVALENCE"))
    top = evl.fractional_top(points, "SCORE", 10, tuple(groups)).select(*groups, "PRECISION", "LIFT")
    return size.join(evl.curve_metrics(points, tuple(groups)).select(*groups, "AP"), groups).join(top, groups)
