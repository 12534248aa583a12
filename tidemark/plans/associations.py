"""Section J: feature quality, association and selection."""

from pyspark.sql import Window as W, functions as F

from tidemark.functions.scalar import hash_int
from tidemark.operators import association as asc, evaluation as evl, features as ft, ordering as od, selection as sel, sequences as sq, strategies as sg
from tidemark.operators.ordering import attach
from tidemark.plans.aggregates import PANEL_TALL, panel_tall
from tidemark.plans.monthly import _HISTORY, _SEQ, DESCRIPTOR_SQL, history, masked
from tidemark.plans.ranking import keys, top_sql
from tidemark.plans.registry import query
from tidemark.plans.relations import VOCABULARY, sql_list
from tidemark.session import settle, settle_table

KEY = ["PATIENT_ID", "END_DT"]
# The longest filter, wrapper and embedded lists.
FILTER_LIST, WRAPPER_LIST, EMBEDDED_LIST = 100, 50, 100
TRAIN = "SPLIT = 'train'"
_WD = "(SELECT *, 1.0 / count(*) OVER (PARTITION BY PATIENT_ID, FEATURE) AS w FROM dense WHERE SPLIT = 'train')"


def train_dense(t):
    return t.expand(t.packed.filter(TRAIN))


def train_sparse(t):
    return asc.sparse_rows(t.packed.filter(TRAIN), VOCABULARY)


def weighted_sparse(t):
    rows = asc.entity_weights(t.packed.filter(TRAIN)).drop("WEIGHT").withColumnRenamed("ENTITY_SHARE", "WEIGHT")
    return asc.sparse_rows(rows, VOCABULARY)


def weighted_dense(t):
    """Training cells with entity weights, attached at snapshot grain before the cells are expanded."""
    rows = asc.entity_weights(t.packed.filter(TRAIN)).drop("WEIGHT").withColumnRenamed("ENTITY_SHARE", "WEIGHT")
    return t.expand(settle_table(rows))


@query("j01_entity_weights", "PATIENT_ID:s END_DT:d WEIGHT:f", "manifest", """SELECT PATIENT_ID, END_DT, (1.0 / c) / avg(1.0 / c) OVER () AS WEIGHT FROM (SELECT *, count(*) OVER (PARTITION BY PATIENT_ID) AS c FROM manifest WHERE SPLIT = 'train')""")
def j01(t):
    return asc.entity_weights(t.manifest.filter(TRAIN))


@query("j02_class_weight", "BALANCE:s POSITIVE_WEIGHT:f", "manifest", """WITH r AS (SELECT sum(CASE WHEN RESP = 0 THEN w END) / sum(CASE WHEN RESP = 1 THEN w END) AS r FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY PATIENT_ID) AS w FROM manifest WHERE SPLIT = 'train'))
  SELECT 'none' AS BALANCE, 1.0 AS POSITIVE_WEIGHT UNION ALL SELECT 'sqrt', sqrt(r) FROM r UNION ALL SELECT 'full', r FROM r""")
def j02(t):
    return asc.class_weight(asc.entity_weights(t.manifest.filter(TRAIN)))


def seeded(t):
    """Weighted training cells with a copied feature and some missing values."""
    d = weighted_dense(t)
    d = d.withColumn("VALUE", F.when(~((F.col("FEATURE") == "DX_OLD") & (F.col("END_DT") < "1997-01-01")), F.col("VALUE")))
    return d.unionByName(d.filter("FEATURE = 'RX_BIG'").withColumn("FEATURE", F.lit("RX_COPY")))


_SEED = f"(SELECT * REPLACE (CASE WHEN FEATURE = 'DX_OLD' AND END_DT < DATE '1997-01-01' THEN NULL ELSE VALUE END AS VALUE) FROM {_WD} UNION ALL SELECT * REPLACE ('RX_COPY' AS FEATURE) FROM {_WD} WHERE FEATURE = 'RX_BIG')"
_QUANT = """SELECT FEATURE, q AS Q, CASE WHEN lo IS NULL THEN hv WHEN hi IS NULL THEN lv ELSE lv + (t - lo) / (hi - lo) * (hv - lv) END AS QUANTILE FROM (SELECT FEATURE, q, max(q * tw) AS t, max(mid) FILTER (mid <= q * tw) AS lo, arg_max(VALUE, mid) FILTER (mid <= q * tw) AS lv,
  min(mid) FILTER (mid > q * tw) AS hi, arg_min(VALUE, mid) FILTER (mid > q * tw) AS hv FROM (SELECT FEATURE, VALUE, sum(w) OVER (PARTITION BY FEATURE ORDER BY VALUE, PATIENT_ID, END_DT ROWS UNBOUNDED PRECEDING) - w / 2 AS mid, sum(w) OVER (PARTITION BY FEATURE) AS tw FROM {src} WHERE VALUE IS NOT NULL),
  (SELECT unnest({q}) AS q) GROUP BY 1, 2)"""


@query("j03_count_quality_ledger", "FEATURE:s OBSERVED_CELLS:i MISSING_FRACTION:f OBSERVED_PATIENTS:i NONZERO_PATIENTS:i RAW_MAX:f RAW_MEAN:f RAW_SD:f LOG_COUNT_VARIANCE:f OBSERVED_MODE_FRACTION:f RAW_Q50:f RAW_Q95:f RAW_Q99:f QUALITY_REASON:s DUPLICATE_OF:s NEAR_CONSTANT:b LOW_VARIANCE:b", "dense", f"""
  WITH s AS {_SEED}, b AS (SELECT FEATURE, count(VALUE) AS OBSERVED_CELLS, count(*) AS n, coalesce(sum(w) FILTER (VALUE IS NULL), 0) / sum(w) AS MISSING_FRACTION, count(DISTINCT CASE WHEN VALUE IS NOT NULL THEN PATIENT_ID END) AS OBSERVED_PATIENTS, count(DISTINCT CASE WHEN VALUE > 0 THEN PATIENT_ID END) AS NONZERO_PATIENTS,
    max(VALUE) AS RAW_MAX, min(VALUE) AS mn, sum(w * VALUE) / sum(w) FILTER (VALUE IS NOT NULL) AS RAW_MEAN, sum(w * ln(1 + VALUE)) / sum(w) FILTER (VALUE IS NOT NULL) AS lm FROM s GROUP BY 1),
  m AS (SELECT FEATURE, max(vw) / sum(vw) AS md FROM (SELECT FEATURE, VALUE, sum(w) AS vw FROM s WHERE VALUE IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
  v AS (SELECT s.FEATURE, sqrt(sum(w * (VALUE - RAW_MEAN) ** 2) / sum(w)) AS RAW_SD, sum(w * (ln(1 + VALUE) - lm) ** 2) / sum(w) AS LOG_COUNT_VARIANCE FROM s JOIN b ON b.FEATURE = s.FEATURE WHERE VALUE IS NOT NULL GROUP BY 1),
  q AS (SELECT FEATURE, max(QUANTILE) FILTER (Q = 0.5) AS RAW_Q50, max(QUANTILE) FILTER (Q = 0.95) AS RAW_Q95, max(QUANTILE) FILTER (Q = 0.99) AS RAW_Q99 FROM ({_QUANT.format(src='s', q='[0.5::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]')}) GROUP BY 1)
  SELECT b.*, RAW_SD, LOG_COUNT_VARIANCE, md AS OBSERVED_MODE_FRACTION, RAW_Q50, RAW_Q95, RAW_Q99, CASE WHEN OBSERVED_CELLS = 0 THEN 'all_missing_in_fit' WHEN RAW_MAX = mn AND OBSERVED_CELLS = n THEN 'constant_in_fit' WHEN b.FEATURE = 'RX_COPY' THEN 'exact_duplicate_in_fit' ELSE 'eligible' END AS QUALITY_REASON,
  CASE WHEN b.FEATURE = 'RX_COPY' THEN 'RX_BIG' END AS DUPLICATE_OF, md >= 0.995 AS NEAR_CONSTANT, LOG_COUNT_VARIANCE <= 1e-6 AS LOW_VARIANCE FROM b JOIN m ON m.FEATURE = b.FEATURE JOIN v ON v.FEATURE = b.FEATURE JOIN q ON q.FEATURE = b.FEATURE""")
def j03(t):
    return asc.quality_ledger(seeded(t))


@query("j04_weighted_quantile", "FEATURE:s Q:f QUANTILE:f", "dense", _QUANT.format(src=_WD, q="[0.25::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]"))
def j04(t):
    return od.weighted_quantiles(asc.sparse_value_table(weighted_sparse(t)), "VALUE", [0.25, 0.5, 0.9], ("FEATURE",))


@query("j05_duplicate_features", "FEATURE:s DUPLICATE_OF:s", "dense", f"""WITH s AS {_SEED} SELECT b.FEATURE, min(a.FEATURE) AS DUPLICATE_OF FROM (SELECT a.FEATURE, b.FEATURE AS f2 FROM s a JOIN s b ON a.PATIENT_ID = b.PATIENT_ID AND a.END_DT = b.END_DT AND a.FEATURE < b.FEATURE GROUP BY 1, 2 HAVING bool_and(a.VALUE IS NOT DISTINCT FROM b.VALUE)) a
  JOIN (SELECT DISTINCT FEATURE FROM s) b ON b.FEATURE = a.f2 GROUP BY 1""")
def j05(t):
    return asc.duplicate_features(seeded(t))


def latest_train(t):
    """Latest training snapshot of each entity."""
    return evl.best_by(t.manifest.filter(TRAIN).select(*KEY), ["PATIENT_ID"], [F.datediff(F.lit("1900-01-01"), "END_DT")])


_LATEST = "(SELECT PATIENT_ID, max(END_DT) AS END_DT FROM manifest WHERE SPLIT = 'train' GROUP BY 1)"


@query("j06_quality_gate", "FEATURE:s OBSERVED:i NONZERO:i MISSING_FRACTION:f QUALITY_REASON:s", "dense manifest", f"""SELECT FEATURE, o AS OBSERVED, z AS NONZERO, 1 - o / n AS MISSING_FRACTION, CASE WHEN o = 0 THEN 'all_missing' WHEN o < 20 THEN 'insufficient_observations' WHEN 1 - o / n > 0.95 THEN 'high_missingness' WHEN lo = hi THEN 'constant_observed_values' WHEN z < 10 THEN 'insufficient_nonzero_support'
  WHEN FEATURE = 'RX_COPY' THEN 'exact_duplicate' ELSE 'eligible' END AS QUALITY_REASON FROM (SELECT FEATURE, count(VALUE) AS o, count(*) FILTER (VALUE <> 0) AS z, count(*) AS n, min(VALUE) AS lo, max(VALUE) AS hi FROM {_SEED} s JOIN {_LATEST} l ON l.PATIENT_ID = s.PATIENT_ID AND l.END_DT = s.END_DT GROUP BY 1)""")
def j06(t):
    last = settle(latest_train(t))
    return asc.quality_gate(seeded(t).join(last, KEY, "left_semi"), last.agg(F.count("*").alias("ALL_ROWS")))


_KIND = "CASE FEATURE WHEN 'F_COUNT' THEN 'count' WHEN 'F_BINARY' THEN 'binary' ELSE 'continuous' END"
_FIT = f"""SELECT FEATURE, KIND, md AS MEDIAN, CASE WHEN KIND = 'binary' THEN 0 ELSE avg(y) END AS CENTER, CASE KIND WHEN 'binary' THEN 1 WHEN 'count' THEN greatest(stddev_pop(y), 1.0) ELSE greatest(stddev_pop(y), 1e-6) END AS SCALE, avg(CASE WHEN x IS NULL THEN 1.0 ELSE 0.0 END) AS MISSING_FRACTION
  FROM (SELECT a.FEATURE, a.KIND, x, md, coalesce(x, md) AS y FROM (SELECT FEATURE, {_KIND} AS KIND, CASE WHEN FEATURE = 'F_COUNT' THEN ln(1 + VALUE) ELSE VALUE END AS x FROM ({PANEL_TALL}) WHERE SPLIT = 'train') a
  JOIN (SELECT FEATURE, median(CASE WHEN FEATURE = 'F_COUNT' THEN ln(1 + VALUE) ELSE VALUE END) AS md FROM ({PANEL_TALL}) WHERE SPLIT = 'train' GROUP BY 1) b ON a.FEATURE = b.FEATURE) GROUP BY 1, 2, 3"""


@query("j07_fitted_transform", "FEATURE:s KIND:s MEDIAN:f CENTER:f SCALE:f MISSING_FRACTION:f", "panel", _FIT)
def j07(t):
    return asc.fit_transform(panel_tall(t).filter(TRAIN))


@query("j08_apply_transform", "PATIENT_ID:s END_DT:d FEATURE:s Z:f", "panel", f"""SELECT p.PATIENT_ID, p.END_DT, p.FEATURE, CASE WHEN END_DT >= DATE '1997-01-01' THEN (coalesce(CASE WHEN p.FEATURE = 'F_COUNT' THEN ln(1 + VALUE) ELSE VALUE END, MEDIAN) - CENTER) / SCALE ELSE 0 END AS Z
  FROM ({PANEL_TALL}) p JOIN ({_FIT}) f ON f.FEATURE = p.FEATURE WHERE SPLIT <> 'train'""")
def j08(t):
    rows = panel_tall(t)
    return asc.apply_transform(rows.filter("SPLIT <> 'train'").drop("KIND"), asc.fit_transform(rows.filter(TRAIN)), F.col("END_DT") >= "1997-01-01")


_STD = """SELECT {k}, FEATURE, VALUE IS NULL AS MISSING, (y - avg(y) OVER (PARTITION BY FEATURE)) / nullif(stddev_pop(y) OVER (PARTITION BY FEATURE), 0) AS Z FROM (SELECT s.*, coalesce(VALUE, md) AS y FROM ({src}) s JOIN (SELECT FEATURE AS f, median(VALUE) AS md FROM ({src}) GROUP BY 1) m ON f = FEATURE)"""


@query("j09_impute_standardise", "PATIENT_ID:s END_DT:d FEATURE:s MISSING:b Z:f", "panel", _STD.format(k="PATIENT_ID, END_DT", src=f"SELECT * FROM ({PANEL_TALL}) WHERE SPLIT = 'train'"))
def j09(t):
    return asc.standardise(panel_tall(t).filter(TRAIN))


_FIRST = f"SELECT s.PATIENT_ID, s.END_DT, 'STEP_VALUE' AS FEATURE, CAST(arg_min(VALUE, TIME_STEP) FILTER (VALID AND TIME_STEP >= 2) AS DOUBLE) AS VALUE FROM ({_SEQ}) s JOIN manifest m ON m.PATIENT_ID = s.PATIENT_ID AND m.END_DT = s.END_DT WHERE SPLIT = 'train' GROUP BY 1, 2"


@query("j10_padded_sequence_fit", "PATIENT_ID:s END_DT:d FEATURE:s MISSING:b Z:f", "snapshots counts manifest", _STD.format(k="PATIENT_ID, END_DT", src=_FIRST))
def j10(t):
    ok = F.col("VALID") & (F.col("TIME_STEP") >= 2)
    first = masked(t).join(t.manifest.filter(TRAIN), KEY, "left_semi").groupBy(*KEY).agg(F.min_by("VALUE", F.when(ok, F.col("TIME_STEP"))).cast("double").alias("VALUE"))
    return asc.standardise(settle(first.withColumn("FEATURE", F.lit("STEP_VALUE"))))


@query("j11_prevalence_filter", "CATEGORY:s ENTITIES:i VARIABLE_WINDOWS:i LOW:i HIGH:i STATUS:s", "counts manifest", """WITH tr AS (SELECT * FROM manifest WHERE SPLIT = 'train'), w AS (SELECT PATIENT_ID, END_DT, CATEGORY, TIME_STEP // 3 AS q, sum(VALUE) AS v FROM counts SEMI JOIN tr USING (PATIENT_ID, END_DT) GROUP BY 1, 2, 3, 4),
  x AS (SELECT CATEGORY, q, CASE WHEN count(*) < (SELECT count(*) FROM tr) THEN 0 ELSE min(v) END AS lo, max(v) AS hi FROM w GROUP BY 1, 2), a AS (SELECT CATEGORY, PATIENT_ID, END_DT, sum(v) AS s FROM w GROUP BY 1, 2, 3), b AS (SELECT CATEGORY, count(DISTINCT PATIENT_ID) AS n, CASE WHEN count(*) < (SELECT count(*) FROM tr) THEN 0 ELSE min(s) END AS LOW, max(s) AS HIGH FROM a GROUP BY 1)
  SELECT b.CATEGORY, n AS ENTITIES, k AS VARIABLE_WINDOWS, LOW, HIGH, CASE WHEN n = 0 THEN 'empty_train' WHEN k = 0 THEN 'constant_all_train_windows' WHEN n < 100 THEN 'rare_train_patients' ELSE 'eligible' END AS STATUS FROM b JOIN (SELECT CATEGORY, count(*) FILTER (hi > lo) AS k FROM x GROUP BY 1) c ON c.CATEGORY = b.CATEGORY""")
def j11(t):
    train = t.manifest.filter(TRAIN)
    size = train.agg(F.count("*").alias("ALL_ROWS"))
    w = t.counts.join(train, KEY, "left_semi").groupBy(*KEY, "CATEGORY", F.floor(F.col("TIME_STEP") / 3).alias("q")).agg(F.sum("VALUE").alias("v"))
    # Snapshots absent from the sparse form are zeros, so the minimum is zero unless every snapshot is present.
    low = lambda c: F.when(F.col("rows") < F.col("ALL_ROWS"), 0).otherwise(F.col(c))
    x = attach(w.groupBy("CATEGORY", "q").agg(F.count("*").alias("rows"), F.min("v").alias("a"), F.max("v").alias("b")), size, [])
    x = x.groupBy("CATEGORY").agg(F.count_if(F.col("b") > low("a")).alias("VARIABLE_WINDOWS"))
    s = w.groupBy(*KEY, "CATEGORY").agg(F.sum("v").alias("s"))
    e = s.groupBy("CATEGORY", "PATIENT_ID").agg(F.count("*").alias("r"), F.min("s").alias("a"), F.max("s").alias("b"))
    e = attach(e.groupBy("CATEGORY").agg(F.count("*").alias("ENTITIES"), F.sum("r").alias("rows"), F.min("a").alias("a"), F.max("b").alias("HIGH")), size, [])
    status = (F.when(F.col("ENTITIES") == 0, "empty_train").when(F.col("VARIABLE_WINDOWS") == 0, "constant_all_train_windows").when(F.col("ENTITIES") < 100, "rare_train_patients").otherwise("eligible"))
    return e.join(x, "CATEGORY").select("CATEGORY", "ENTITIES", "VARIABLE_WINDOWS", low("a").alias("LOW"), "HIGH", status.alias("STATUS"))


_MI = "sum(w / t * ln(w * t / (x * y)))"
_JOINT = """SELECT FEATURE, cell, w, sum(w) OVER (PARTITION BY FEATURE) AS t, sum(w) OVER (PARTITION BY FEATURE, cell) AS x, sum(w) OVER (PARTITION BY FEATURE, RESP) AS y FROM ({0})"""


@query("j12_binned_mutual_information", "FEATURE:s MI:f OCCUPIED:i CORRECTED_MI:f", "dense", f"""WITH e AS (SELECT FEATURE, list(DISTINCT QUANTILE) AS ed FROM ({_QUANT.format(src=_WD, q='[0.2::DOUBLE, 0.4::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE]')}) GROUP BY 1), j AS (SELECT d.FEATURE, len(list_filter(ed, lambda z: z <= VALUE)) AS cell, RESP, sum(w) AS w FROM {_WD} d JOIN e ON e.FEATURE = d.FEATURE GROUP BY 1, 2, 3)
  SELECT FEATURE, {_MI} AS MI, count(DISTINCT cell) AS OCCUPIED, greatest(0, {_MI} - (count(DISTINCT cell) - 1) / (2.0 * (SELECT count(DISTINCT PATIENT_ID) FROM dense WHERE SPLIT = 'train'))) AS CORRECTED_MI FROM ({_JOINT.format('SELECT * FROM j')}) GROUP BY 1""")
def j12(t):
    people = t.manifest.filter(TRAIN).select("PATIENT_ID").distinct().agg(F.count("*").alias("ENTITIES"))
    s = weighted_sparse(t)
    return asc.binned_information(asc.sparse_value_table(s), asc.sparse_histogram(s, "RESP", weight="WEIGHT"), 5, people)


@query("j13_weighted_rank_association", "FEATURE:s CORRELATION:f", "dense", f"""SELECT FEATURE, CASE WHEN sum(w * dx * dx) > 0 THEN sum(w * dx * dy) / sqrt(sum(w * dx * dx) * sum(w * dy * dy)) ELSE 0 END AS CORRELATION FROM (SELECT *, r - sum(w * r) OVER p / sum(w) OVER p AS dx, RESP - sum(w * RESP) OVER p / sum(w) OVER p AS dy FROM (
  SELECT d.*, r FROM {_WD} d JOIN (SELECT FEATURE, VALUE, (sum(vw) OVER (PARTITION BY FEATURE ORDER BY VALUE) - vw / 2) / sum(vw) OVER (PARTITION BY FEATURE) AS r FROM (SELECT FEATURE, VALUE, sum(w) AS vw FROM {_WD} GROUP BY 1, 2)) k ON k.FEATURE = d.FEATURE AND k.VALUE = d.VALUE) WINDOW p AS (PARTITION BY FEATURE)) GROUP BY 1""")
def j13(t):
    return asc.rank_correlation_of(asc.sparse_histogram(weighted_sparse(t), "RESP", weight="WEIGHT"))


_R = "rank() OVER (PARTITION BY FEATURE ORDER BY VALUE) + (count(*) OVER (PARTITION BY FEATURE, VALUE) - 1) / 2.0"


@query("j14_association_table", "FEATURE:s SPEARMAN:f PHI:f CHI2:f MIN_EXPECTED:f", "dense", f"""SELECT FEATURE, coalesce(corr(r, RESP), 0) AS SPEARMAN, corr(p, RESP) AS PHI, count(*) * corr(p, RESP) ** 2 AS CHI2, CASE WHEN corr(p, RESP) IS NOT NULL THEN least(sum(p), count(*) - sum(p)) * least(sum(RESP), count(*) - sum(RESP)) / count(*) END AS MIN_EXPECTED
  FROM (SELECT *, {_R} AS r, CASE WHEN VALUE <> 0 THEN 1 ELSE 0 END AS p FROM dense WHERE SPLIT = 'train') GROUP BY 1""")
def j14(t):
    h = settle(asc.sparse_histogram(train_sparse(t), "RESP"))
    return asc.rank_correlation_of(h).withColumnRenamed("CORRELATION", "SPEARMAN").join(asc.presence_of(h), "FEATURE")


_DMI = f"SELECT FEATURE, {_MI} AS MI FROM ({_JOINT.format('SELECT FEATURE, VALUE AS cell, RESP, count(*)::DOUBLE AS w FROM dense WHERE SPLIT = ' + chr(39) + 'train' + chr(39) + ' GROUP BY 1, 2, 3')}) GROUP BY 1"


@query("j15_discrete_mi_ranking", "FEATURE:s MI:f POSITION:i", "dense", f"SELECT FEATURE, MI, row_number() OVER (ORDER BY round(MI, 9) DESC, FEATURE) AS POSITION FROM ({_DMI})")
def j15(t):
    return mi_ranking(t)


def mi_ranking(t):
    mi = asc.discrete_information(asc.sparse_histogram(train_sparse(t), "RESP"))
    return mi.select("FEATURE", "MI", F.row_number().over(W.orderBy(F.round("MI", 9).desc(), "FEATURE")).alias("POSITION"))


def rank_pairs(t, threshold, sparse=None):
    matrix = asc.sparse_rank_gram(sparse or train_sparse(t))
    if matrix is not None:
        return asc.pairs_of(matrix, VOCABULARY, threshold)
    ranks = asc.with_ranks(train_dense(t))
    return asc.correlated_pairs(asc.vectors(ranks, "MID_RANK", list(VOCABULARY)), "X", list(VOCABULARY), threshold)


def _pairs_sql(value, threshold):
    return f"""SELECT a.FEATURE AS FEATURE_A, b.FEATURE AS FEATURE_B, corr(a.v, b.v) AS CORRELATION FROM (SELECT *, {value} AS v, list_position({sql_list(VOCABULARY)}, FEATURE) AS i FROM dense WHERE SPLIT = 'train') a
      JOIN (SELECT *, {value} AS v, list_position({sql_list(VOCABULARY)}, FEATURE) AS i FROM dense WHERE SPLIT = 'train') b ON a.PATIENT_ID = b.PATIENT_ID AND a.END_DT = b.END_DT AND a.i < b.i GROUP BY 1, 2 HAVING abs(corr(a.v, b.v)) >= {threshold}"""


_GREEDY = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT FEATURE, MI, row_number() OVER (ORDER BY round(MI, 9) DESC, FEATURE) AS RANK FROM ({_DMI})), e AS MATERIALIZED (SELECT FEATURE_A AS a, FEATURE_B AS b FROM ({_pairs_sql(_R, 0.3)})),
  s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), nb AS MATERIALIZED (SELECT o.FEATURE, o.MI, o.RANK, coalesce((SELECT list(b) FROM s WHERE a = o.FEATURE), []) AS n FROM o),
  g(r, kept, FEATURE, STATE, REDUNDANT_WITH) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) UNION ALL
  SELECT nb.RANK, CASE WHEN list_has_any(g.kept, nb.n) OR round(MI, 9) <= 0 OR len(g.kept) >= {FILTER_LIST} THEN g.kept ELSE list_append(g.kept, nb.FEATURE) END, nb.FEATURE,
  CASE WHEN list_has_any(g.kept, nb.n) THEN 'redundant' WHEN round(MI, 9) <= 0 THEN 'zero_information' WHEN len(g.kept) >= {FILTER_LIST} THEN 'over_limit' ELSE 'kept' END, list_filter(g.kept, lambda x: list_contains(nb.n, x))[1] FROM g JOIN nb ON nb.RANK = g.r + 1)
  SELECT FEATURE, r AS RANK, STATE, REDUNDANT_WITH FROM g WHERE r > 0"""


@query("j16_greedy_redundancy", "FEATURE:s RANK:i STATE:s REDUNDANT_WITH:s", "dense", _GREEDY)
def j16(t):
    order = settle(mi_ranking(t).select("FEATURE", F.col("POSITION").alias("RANK"), "MI"))
    return sel.filter_list(order, settle(rank_pairs(t, 0.3)), FILTER_LIST)


@query("j17_correlated_pairs", "METHOD:s FEATURE_A:s FEATURE_B:s CORRELATION:f", "dense", f"SELECT 'spearman' AS METHOD, * FROM ({_pairs_sql(_R, 0.35)}) UNION ALL SELECT 'pearson', * FROM ({_pairs_sql('VALUE', 0.35)})")
def j17(t):
    s = train_sparse(t)
    pearson = asc.pairs_of(asc.sparse_gram(s), VOCABULARY, 0.35)
    return rank_pairs(t, 0.35, s).withColumn("METHOD", F.lit("spearman")).unionByName(pearson.withColumn("METHOD", F.lit("pearson")))


@query("j18_correlation_components", "NODE:s COMPONENT:s", "dense", f"""WITH RECURSIVE e AS MATERIALIZED (SELECT FEATURE_A AS u, FEATURE_B AS v FROM ({_pairs_sql('VALUE', 0.3)})), s AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e), r(u, c) AS (SELECT u, u FROM s UNION SELECT s.v, r.c FROM r JOIN s ON s.u = r.u) SELECT u AS NODE, min(c) AS COMPONENT FROM r GROUP BY 1""")
def j18(t):
    return sel.components(asc.pairs_of(asc.sparse_gram(train_sparse(t)), VOCABULARY, 0.3))


_SHIFT_W = "(SELECT *, 1.0 / count(*) OVER (PARTITION BY PATIENT_ID, FEATURE) AS w, ln(1 + VALUE) AS x FROM dense WHERE SPLIT <> 'test')"
_SHIFT = """SELECT FEATURE, tm AS TRAIN_MEAN, vm AS VALIDATION_MEAN, CASE WHEN {sc} > 0 THEN (vm - tm) / {sc} ELSE 0 END AS STANDARDIZED_DIFFERENCE, tp AS TRAIN_NONZERO, vp AS VALIDATION_NONZERO FROM (SELECT FEATURE, max(m) FILTER (SPLIT = 'train') AS tm, max(m) FILTER (SPLIT <> 'train') AS vm, max(v) FILTER (SPLIT = 'train') AS tv, max(v) FILTER (SPLIT <> 'train') AS vv,
  max(p) FILTER (SPLIT = 'train') AS tp, max(p) FILTER (SPLIT <> 'train') AS vp FROM (SELECT FEATURE, SPLIT, m, sum(w * (x - m) ** 2) / sum(w) AS v, sum(CASE WHEN VALUE > 0 THEN w ELSE 0 END) / sum(w) AS p FROM (SELECT *, sum(w * x) OVER (PARTITION BY FEATURE, SPLIT) / sum(w) OVER (PARTITION BY FEATURE, SPLIT) AS m FROM {src}) GROUP BY 1, 2, 3) GROUP BY 1)"""


@query("j19_weighted_shift", "FEATURE:s TRAIN_MEAN:f VALIDATION_MEAN:f STANDARDIZED_DIFFERENCE:f TRAIN_NONZERO:f VALIDATION_NONZERO:f", "dense", _SHIFT.format(src=_SHIFT_W, sc="sqrt((tv + vv) / 2)"))
def j19(t):
    rows = asc.entity_weights(t.packed.filter("SPLIT <> 'test'"), ("SPLIT",))
    return asc.shift_of(asc.sparse_histogram(asc.sparse_rows(rows, VOCABULARY), "SPLIT", weight="WEIGHT"))


@query("j20_unweighted_shift", "FEATURE:s TRAIN_MEAN:f VALIDATION_MEAN:f STANDARDIZED_DIFFERENCE:f TRAIN_NONZERO:f VALIDATION_NONZERO:f", "dense", _SHIFT.format(src="(SELECT *, 1.0 AS w, ln(1 + VALUE) AS x FROM dense WHERE SPLIT <> 'test')", sc="sqrt(tv)"))
def j20(t):
    rows = asc.sparse_rows(t.packed.filter("SPLIT <> 'test'"), VOCABULARY)
    return asc.shift_of(asc.sparse_histogram(rows, "SPLIT"), weighted=False)


_STEP01 = f"""SELECT m.PATIENT_ID, m.END_DT, RESP, FEATURE, m.TIME_STEP, coalesce(VALUE, 0) AS v, 1.0 / count(*) OVER (PARTITION BY m.PATIENT_ID, FEATURE, m.TIME_STEP) AS w FROM (SELECT *, unnest([0, 1]) AS TIME_STEP FROM manifest WHERE SPLIT = 'train') m CROSS JOIN vocab LEFT JOIN counts c ON c.PATIENT_ID = m.PATIENT_ID AND c.END_DT = m.END_DT AND c.TIME_STEP = m.TIME_STEP AND c.CATEGORY = FEATURE"""


@query("j21_step_screen", "FEATURE:s STEP0_AP:f STEP1_AP:f AP_DIFFERENCE:f RATE_DIFFERENCE:f STATUS:s", "manifest vocab counts", f"""WITH x AS ({_STEP01}), c AS (SELECT *, sum(p) OVER q AS cp, sum(n) OVER q AS cn, sum(p) OVER g AS tp, sum(z) OVER g AS tz FROM (SELECT FEATURE, TIME_STEP, v, sum(w * RESP) AS p, sum(w * (1 - RESP)) AS n, sum(CASE WHEN v > 0 THEN w * RESP ELSE 0 END) AS z FROM x GROUP BY 1, 2, 3) WINDOW q AS (PARTITION BY FEATURE, TIME_STEP ORDER BY v DESC), g AS (PARTITION BY FEATURE, TIME_STEP)),
  a AS (SELECT FEATURE, TIME_STEP, sum(p / tp * cp / (cp + cn)) AS ap, max(tz) / max(tp) AS rt FROM c GROUP BY 1, 2) SELECT FEATURE, STEP0_AP, STEP1_AP, STEP0_AP - STEP1_AP AS AP_DIFFERENCE, r0 - r1 AS RATE_DIFFERENCE, CASE WHEN STEP0_AP > STEP1_AP AND r0 > r1 THEN 'CORROBORATED' ELSE 'INCONCLUSIVE' END AS STATUS FROM (
  SELECT FEATURE, max(ap) FILTER (TIME_STEP = 0) AS STEP0_AP, max(ap) FILTER (TIME_STEP = 1) AS STEP1_AP, max(rt) FILTER (TIME_STEP = 0) AS r0, max(rt) FILTER (TIME_STEP = 1) AS r1 FROM a GROUP BY 1)""")
def j21(t):
    train = settle(asc.entity_weights(t.manifest.filter(TRAIN)))
    w, y = F.col("ENTITY_SHARE"), F.col("RESP")
    seen = t.counts.filter((F.col("TIME_STEP") < 2) & F.col("CATEGORY").isin(*VOCABULARY)).join(train.select(*KEY, "RESP", "ENTITY_SHARE"), KEY)
    hist = settle(seen.groupBy(F.col("CATEGORY").alias("FEATURE"), "TIME_STEP", F.col("VALUE").cast("double").alias("VALUE")).agg(
        F.sum(w * y).alias("P"), F.sum(w * (1 - y)).alias("N")))
    # Zeros are implied: their weight is the remainder of the totals.
    whole = train.agg(F.sum(w * y).alias("TP"), F.sum(w * (1 - y)).alias("TN"))
    nonzero = hist.groupBy("FEATURE", "TIME_STEP").agg(F.sum("P").alias("ZP"), F.sum("N").alias("ZN"))
    cells = t.rows([(v, s) for v in VOCABULARY for s in (0, 1)], "FEATURE string, TIME_STEP int")
    base = attach(cells.join(nonzero, ["FEATURE", "TIME_STEP"], "left").fillna(0.0, ["ZP", "ZN"]), whole, [])
    zeros = base.select("FEATURE", "TIME_STEP", F.lit(0.0).alias("VALUE"), (F.col("TP") - F.col("ZP")).alias("P"), (F.col("TN") - F.col("ZN")).alias("N"))
    groups = ("FEATURE", "TIME_STEP")
    points = od.running_totals(hist.unionByName(zeros), [F.desc("VALUE")], {"CUM_P": F.col("P"), "CUM_N": F.col("N")}, groups)
    a = evl.curve_metrics(points, groups).join(base.select(*groups, (F.col("ZP") / F.col("TP")).alias("R")), list(groups))
    at = lambda s, c: F.max(F.when(F.col("TIME_STEP") == s, F.col(c)))
    g = a.groupBy("FEATURE").agg(at(0, "AP").alias("STEP0_AP"), at(1, "AP").alias("STEP1_AP"), at(0, "R").alias("r0"), at(1, "R").alias("r1"))
    up = (F.col("STEP0_AP") > F.col("STEP1_AP")) & (F.col("r0") > F.col("r1"))
    return g.select("FEATURE", "STEP0_AP", "STEP1_AP", (F.col("STEP0_AP") - F.col("STEP1_AP")).alias("AP_DIFFERENCE"), (F.col("r0") - F.col("r1")).alias("RATE_DIFFERENCE"), F.when(up, "CORROBORATED").otherwise("INCONCLUSIVE").alias("STATUS"))


_DESC = f"""SELECT d.PATIENT_ID, d.END_DT, RESP, dd || g AS NAME, round(CASE g WHEN '+' THEN 1 ELSE -1 END * CASE dd WHEN 'CURRENT' THEN CURRENT WHEN 'MEAN' THEN MEAN WHEN 'SD' THEN SD ELSE SLOPE END, 9) AS s FROM ({DESCRIPTOR_SQL}) d JOIN manifest m ON m.PATIENT_ID = d.PATIENT_ID AND m.END_DT = d.END_DT AND SPLIT = 'train',
  (SELECT unnest(['CURRENT', 'MEAN', 'SD', 'SLOPE']) AS dd), (SELECT unnest(['+', '-']) AS g)"""


@query("j22_descriptor_ranking", "NAME:s LIFT:f AP:f POSITION:i", "snapshots counts manifest", f"""WITH x AS ({_DESC}), c AS (SELECT *, sum(p) OVER q AS cp, sum(n) OVER q AS cn, sum(p) OVER (PARTITION BY NAME) AS tp FROM (SELECT NAME, s, sum(RESP) AS p, sum(1 - RESP) AS n FROM x GROUP BY 1, 2) WINDOW q AS (PARTITION BY NAME ORDER BY s DESC)),
  a AS (SELECT NAME, sum(p / tp * cp / (cp + cn)) AS AP FROM c GROUP BY 1) SELECT l.NAME, LIFT, AP, row_number() OVER (ORDER BY round(LIFT, 9) DESC, round(AP, 9) DESC, l.NAME) AS POSITION FROM ({top_sql('x', 's', 'PATIENT_ID, END_DT', (10,), 'NAME')}) l JOIN a ON a.NAME = l.NAME""")
def j22(t):
    d = sq.descriptors(masked(t), KEY).join(t.manifest.filter(TRAIN), KEY)
    both = []
    for name in ("CURRENT", "MEAN", "SD", "SLOPE"):
        v = F.round(F.col(name).cast("double"), 9) + F.lit(0.0)
        both += [F.struct(F.lit(name + "+").alias("NAME"), v.alias("s")), F.struct(F.lit(name + "-").alias("NAME"), (F.lit(0.0) - v).alias("s"))]
    rows = settle(d).select(*KEY, "RESP", F.inline(F.array(*both)))
    lift = evl.top_share(rows, "s", [10], keys(), groups=("NAME",)).select("NAME", "LIFT")
    ap = evl.curve_metrics(evl.curve(rows, "s", groups=("NAME",)), ("NAME",)).select("NAME", "AP")
    order = W.orderBy(F.round("LIFT", 9).desc(), F.round("AP", 9).desc(), "NAME")
    return lift.join(ap, "NAME").withColumn("POSITION", F.row_number().over(order))


FOLD_SQL = """SELECT PATIENT_ID, y AS RESP, (row_number() OVER (PARTITION BY y ORDER BY CAST('0x' || substr(sha256('folds|' || PATIENT_ID), 1, 15) AS BIGINT), PATIENT_ID) - 1) % 3 AS FOLD FROM (SELECT PATIENT_ID, max(RESP) AS y FROM manifest WHERE SPLIT = 'train' GROUP BY 1)"""


def folds(t):
    people = t.manifest.filter(TRAIN).groupBy("PATIENT_ID").agg(F.max("RESP").alias("RESP"))
    return sel.stratified_folds(people, FOLDS, "folds")


@query("j23_grouped_stratified_folds", "PATIENT_ID:s RESP:i FOLD:i", "manifest", FOLD_SQL)
def j23(t):
    return folds(t)


def cv_rows(t):
    """Training snapshots with entity weight, fold and the log1p feature vector in vocabulary order."""
    rows = asc.entity_weights(t.packed.filter(TRAIN)).select(*KEY, "RESP", "WEIGHT", "COUNTS")
    rows = rows.join(folds(t).select("PATIENT_ID", "FOLD"), "PATIENT_ID")
    return rows.select(*KEY, "RESP", "WEIGHT", "FOLD", asc.log_vector(list(VOCABULARY)).alias("X"))


FOLDS = 3
# Feature counts tried by the grouped proxy.
PROXY_SIZES = (16, 32, 64, 128, 256, 512, 1028)


def fold_ledger(t):
    rows = asc.entity_weights(t.packed.filter(TRAIN)).drop("WEIGHT").withColumnRenamed("ENTITY_SHARE", "WEIGHT")
    sparse = asc.sparse_rows(rows.join(folds(t).select("PATIENT_ID", "FOLD"), "PATIENT_ID"), VOCABULARY)
    return sel.fold_ledger(asc.sparse_histogram(sparse, "FOLD", "RESP", weight="WEIGHT"), FOLDS)


@query("j24_fold_ranking", "HOLDOUT:i FEATURE:s ELIGIBLE:b CENTER:f SCALE:f AP_UP:f AP_DOWN:f RANK:i", "dense manifest", f"""WITH d AS (SELECT d.*, FOLD, 1.0 / count(*) OVER (PARTITION BY d.PATIENT_ID, FEATURE) AS w, ln(1 + VALUE) AS x FROM dense d JOIN ({FOLD_SQL}) f ON f.PATIENT_ID = d.PATIENT_ID WHERE SPLIT = 'train'),
  t AS (SELECT HOLDOUT, d.*, sum(w * x) OVER g / sum(w) OVER g AS mean FROM d, (SELECT unnest(range({FOLDS})) AS HOLDOUT) h WHERE FOLD <> HOLDOUT WINDOW g AS (PARTITION BY HOLDOUT, FEATURE)),
  m AS (SELECT HOLDOUT, FEATURE, max(VALUE) > min(VALUE) AS ELIGIBLE, any_value(mean) AS CENTER, greatest(sqrt(sum(w * (x - mean) ** 2) / sum(w)), 1.0) AS SCALE FROM t GROUP BY 1, 2),
  c AS (SELECT HOLDOUT, FEATURE, VALUE, sum(w * RESP) AS p, sum(w * (1 - RESP)) AS n FROM t GROUP BY 1, 2, 3),
  r AS (SELECT *, sum(p) OVER u AS up, sum(n) OVER u AS un, sum(p) OVER l AS lp, sum(n) OVER l AS ln, sum(p) OVER (PARTITION BY HOLDOUT, FEATURE) AS tp FROM c WINDOW u AS (PARTITION BY HOLDOUT, FEATURE ORDER BY VALUE DESC), l AS (PARTITION BY HOLDOUT, FEATURE ORDER BY VALUE)),
  a AS (SELECT HOLDOUT, FEATURE, sum(p / tp * up / (up + un)) AS AP_UP, sum(p / tp * lp / (lp + ln)) AS AP_DOWN FROM r GROUP BY 1, 2)
  SELECT m.*, AP_UP, AP_DOWN, row_number() OVER (PARTITION BY m.HOLDOUT ORDER BY ELIGIBLE DESC, round(greatest(AP_UP, AP_DOWN), 9) DESC, m.FEATURE) AS RANK FROM m JOIN a ON a.HOLDOUT = m.HOLDOUT AND a.FEATURE = m.FEATURE""")
def j24b(t):
    return fold_ledger(t)


@query("j24_grouped_cv_proxy", "FOLD:i FEATURES:i AP:f LIFT:f")
def j24(t):
    return sel.grouped_cv(cv_rows(t), settle(fold_ledger(t)), list(VOCABULARY), FOLDS, PROXY_SIZES, 0.1)


_CV = """SELECT MODEL AS CANDIDATE, CASE MODEL WHEN 'alpha' THEN 30 WHEN 'beta' THEN 20 ELSE 10 END AS FEATURES, avg(b) AS MEAN_AP, stddev_samp(b) / sqrt(count(*)) AS SE_AP FROM (SELECT MODEL, CAST('0x' || substr(sha256('fold|' || PATIENT_ID), 1, 15) AS BIGINT) % 5 AS f, avg(1 - (SCORE - RESP) * (SCORE - RESP)) AS b FROM model_scores GROUP BY 1, 2) GROUP BY 1, 2"""


@query("j25_one_standard_error", "CHOICE:s CANDIDATE:s", "model_scores", f"""WITH c AS ({_CV}), b AS (SELECT * FROM c ORDER BY MEAN_AP DESC, FEATURES, CANDIDATE LIMIT 1), o AS (SELECT c.* FROM c, b WHERE c.MEAN_AP >= b.MEAN_AP - b.SE_AP ORDER BY c.FEATURES, c.MEAN_AP DESC LIMIT 1), s AS (SELECT c.* FROM c, o WHERE c.FEATURES < o.FEATURES ORDER BY c.FEATURES DESC LIMIT 1)
  SELECT 'proxy_best' AS CHOICE, CANDIDATE FROM b UNION ALL SELECT 'proxy_one_se', CANDIDATE FROM o UNION ALL SELECT 'one_smaller', CANDIDATE FROM s UNION ALL SELECT 'all_eligible', 'all_eligible'""")
def j25(t):
    fold = F.pmod(hash_int(F.concat(F.lit("fold|"), "PATIENT_ID")), F.lit(5)).alias("f")
    gain = F.avg(1 - (F.col("SCORE") - F.col("RESP")) * (F.col("SCORE") - F.col("RESP")))
    per = t.model_scores.groupBy("MODEL", fold).agg(gain.alias("b"))
    size = F.when(F.col("MODEL") == "alpha", 30).when(F.col("MODEL") == "beta", 20).otherwise(10)
    table = per.groupBy(F.col("MODEL").alias("CANDIDATE"), size.alias("FEATURES")).agg(F.avg("b").alias("MEAN_AP"), (F.stddev_samp("b") / F.sqrt(F.count("*"))).alias("SE_AP"))
    return sel.one_standard_error(table)


# Latest snapshot of each training entity, folds within its label, and the scopes (-1: all rows) that a row belongs to.
_LATEST = f"""SELECT d.PATIENT_ID, d.RESP, d.FEATURE, d.VALUE, ln(1 + d.VALUE) AS x, SCOPE FROM dense d JOIN (
  SELECT *, (row_number() OVER (PARTITION BY RESP ORDER BY CAST('0x' || substr(sha256('folds|' || PATIENT_ID), 1, 15) AS BIGINT), PATIENT_ID) - 1) % {FOLDS} AS FOLD
  FROM (SELECT PATIENT_ID, max(END_DT) AS END_DT, arg_max(RESP, END_DT) AS RESP FROM manifest WHERE SPLIT = 'train' GROUP BY 1)) f
  ON f.PATIENT_ID = d.PATIENT_ID AND f.END_DT = d.END_DT JOIN (SELECT unnest(range(-1, {FOLDS})) AS SCOPE) s ON SCOPE <> FOLD"""
_LEDGER = f"""b AS MATERIALIZED (SELECT SCOPE, FEATURE, count(*) AS OBSERVED, count(*) FILTER (VALUE <> 0) AS NONZERO, min(VALUE) AS LOW, max(VALUE) AS HIGH, avg(x) AS CENTER,
    CASE WHEN min(VALUE) = max(VALUE) THEN 1.0 ELSE stddev_pop(x) END AS SCALE, avg(x) FILTER (RESP = 1) - avg(x) FILTER (RESP = 0) AS gap, string_agg(VALUE, ',' ORDER BY PATIENT_ID) AS content FROM x GROUP BY 1, 2),
  mi AS (SELECT SCOPE, FEATURE, sum(w / t * ln(w * t / (p * y))) AS MI FROM (SELECT *, sum(w) OVER (PARTITION BY SCOPE, FEATURE) AS t, sum(w) OVER (PARTITION BY SCOPE, FEATURE, VALUE) AS p, sum(w) OVER (PARTITION BY SCOPE, FEATURE, RESP) AS y
    FROM (SELECT SCOPE, FEATURE, VALUE, RESP, count(*)::DOUBLE AS w FROM x GROUP BY 1, 2, 3, 4)) GROUP BY 1, 2),
  q AS (SELECT b.*, MI, gap / SCALE AS EFFECT, CASE WHEN HIGH > 0 THEN nullif(min(b.FEATURE) OVER (PARTITION BY b.SCOPE, content), b.FEATURE) END AS DUPLICATE_OF FROM b JOIN mi ON mi.SCOPE = b.SCOPE AND mi.FEATURE = b.FEATURE),
  g AS (SELECT *, CASE WHEN OBSERVED < {asc.MIN_OBSERVED} THEN 'insufficient_observations' WHEN LOW = HIGH THEN 'constant_observed_values' WHEN NONZERO < {asc.MIN_NONZERO} THEN 'insufficient_nonzero_support' WHEN DUPLICATE_OF IS NOT NULL THEN 'exact_duplicate' ELSE 'eligible' END AS QUALITY_REASON FROM q),
  lg AS MATERIALIZED (SELECT *, CASE WHEN QUALITY_REASON = 'eligible' THEN row_number() OVER (PARTITION BY SCOPE, QUALITY_REASON = 'eligible' ORDER BY round(MI, 9) DESC, FEATURE) END AS RANK FROM g)"""
#: Redundancy of the compared filter lists; low enough that some features of the data are redundant.
NEAR = 0.3
#: Length of the compared embedded lists; short enough to cut.
SHORT_LIST = 12


def latest_sparse(t):
    """The latest snapshot of each training entity with its fold, numbered once."""
    train = t.packed.filter(TRAIN)
    last = train.groupBy("PATIENT_ID").agg(F.max("END_DT").alias("END_DT"))
    rows = train.join(last, KEY, "left_semi").select(*KEY, "RESP", "COUNTS")
    fold = sel.stratified_folds(rows.select("PATIENT_ID", "RESP"), FOLDS, "folds").select("PATIENT_ID", "FOLD")
    return asc.sparse_rows(rows.join(fold, "PATIENT_ID"), VOCABULARY)


def scope_fits(sparse, ledger, scopes, settings):
    names = F.array(*[F.lit(v) for v in VOCABULARY])
    x = F.transform(names, lambda n: F.log1p(F.coalesce(F.try_element_at("COUNTS", n), F.lit(0)).cast("double")))
    rows = settle(sparse.rows.select(*KEY, "RESP", "FOLD", x.alias("X")))
    found = sg.states(ledger)
    return {s: sg.ScopeFits(rows, s, list(VOCABULARY), found[s], settings) for s in scopes}


@query("j28_fold_ledger", "SCOPE:i FEATURE:s OBSERVED:i NONZERO:i LOW:f HIGH:f QUALITY_REASON:s DUPLICATE_OF:s CENTER:f SCALE:f EFFECT:f MI:f RANK:i", "dense manifest", f"WITH x AS MATERIALIZED ({_LATEST}), {_LEDGER} SELECT * FROM lg")
def j28a(t):
    return sg.scope_ledger(latest_sparse(t), FOLDS)


@query("j28_fold_filter_lists", "SCOPE:i FEATURE:s RANK:i SELECTED:b REASON:s REDUNDANT_WITH:s", "dense manifest", f"""WITH RECURSIVE x AS MATERIALIZED ({_LATEST}), {_LEDGER},
  r AS MATERIALIZED (SELECT SCOPE, FEATURE, PATIENT_ID, rank() OVER (PARTITION BY SCOPE, FEATURE ORDER BY VALUE) + (count(*) OVER (PARTITION BY SCOPE, FEATURE, VALUE) - 1) / 2.0 AS v FROM x),
  e AS MATERIALIZED (SELECT a.SCOPE, a.FEATURE AS a, b.FEATURE AS b FROM r a JOIN r b ON a.SCOPE = b.SCOPE AND a.PATIENT_ID = b.PATIENT_ID AND a.FEATURE < b.FEATURE GROUP BY 1, 2, 3 HAVING abs(corr(a.v, b.v)) >= {NEAR}),
  s AS MATERIALIZED (SELECT SCOPE, a, b FROM e UNION SELECT SCOPE, b, a FROM e),
  nb AS MATERIALIZED (SELECT SCOPE, FEATURE, MI, RANK, coalesce((SELECT list(b) FROM s WHERE a = FEATURE AND s.SCOPE = lg.SCOPE), []) AS n FROM lg WHERE RANK IS NOT NULL),
  w(SCOPE, i, kept, FEATURE, REASON, REDUNDANT_WITH) AS (SELECT DISTINCT SCOPE, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM nb UNION ALL
  SELECT nb.SCOPE, nb.RANK, CASE WHEN list_has_any(w.kept, nb.n) OR round(MI, 9) <= 0 OR len(w.kept) >= {FILTER_LIST} THEN w.kept ELSE list_append(w.kept, nb.FEATURE) END, nb.FEATURE,
  CASE WHEN list_has_any(w.kept, nb.n) THEN 'spearman_redundancy' WHEN round(MI, 9) <= 0 THEN 'zero_estimated_mutual_information' WHEN len(w.kept) >= {FILTER_LIST} THEN 'below_selection_cutoff' ELSE 'selected' END,
  list_filter(w.kept, lambda z: list_contains(nb.n, z))[1] FROM w JOIN nb ON nb.SCOPE = w.SCOPE AND nb.RANK = w.i + 1)
  SELECT SCOPE, FEATURE, i AS RANK, REASON = 'selected' AS SELECTED, REASON, REDUNDANT_WITH FROM w WHERE i > 0""")
def j28b(t):
    sparse = latest_sparse(t)
    return sg.filter_lists(sg.scope_ledger(sparse, FOLDS), sg.scope_pairs(sparse, list(range(sg.WHOLE, FOLDS)), NEAR), FILTER_LIST)


@query("j28_fold_frequency", "FEATURE:s SELECTED:b FOLD_SELECTION_COUNT:i FOLD_SELECTION_FREQUENCY:f FOLD_ELIGIBILITY_FREQUENCY:f", "dense manifest", f"""WITH x AS MATERIALIZED ({_LATEST}), {_LEDGER},
  c AS (SELECT SCOPE, FEATURE, round(abs(EFFECT), 9) AS c, round(MI, 9) AS i, abs(EFFECT) <= 1e-8 AND MI <= 0 AS dead FROM lg WHERE RANK IS NOT NULL),
  m AS (SELECT *, (rank() OVER (PARTITION BY SCOPE ORDER BY c DESC) + (count(*) OVER (PARTITION BY SCOPE, c) - 1) / 2.0 + rank() OVER (PARTITION BY SCOPE ORDER BY i DESC) + (count(*) OVER (PARTITION BY SCOPE, i) - 1) / 2.0) / 2 AS mr FROM c),
  p AS (SELECT SCOPE, FEATURE, NOT dead AND row_number() OVER (PARTITION BY SCOPE, dead ORDER BY mr, FEATURE) <= {SHORT_LIST} AS s FROM m)
  SELECT l.FEATURE, coalesce(bool_or(s) FILTER (l.SCOPE = -1), false) AS SELECTED, count(*) FILTER (s AND l.SCOPE >= 0) AS FOLD_SELECTION_COUNT, count(*) FILTER (s AND l.SCOPE >= 0) / {FOLDS}.0 AS FOLD_SELECTION_FREQUENCY,
  count(*) FILTER (l.SCOPE >= 0 AND RANK IS NOT NULL) / {FOLDS}.0 AS FOLD_ELIGIBILITY_FREQUENCY FROM lg l JOIN p ON p.SCOPE = l.SCOPE AND p.FEATURE = l.FEATURE GROUP BY 1""")
def j28c(t):
    """The two components are the class effect and the information here, which SQL can state; j28 takes those of the fitted models."""
    ledger = settle(sg.scope_ledger(latest_sparse(t), FOLDS))
    parts = ledger.filter("RANK IS NOT NULL").select("SCOPE", "FEATURE", F.col("EFFECT").alias("COEFFICIENT"), F.col("MI").alias("IMPORTANCE"))
    return sg.fold_frequency(sg.embedded_lists(parts, SHORT_LIST), ledger, FOLDS)


def whole_fits(t, settings):
    sparse = latest_sparse(t)
    ledger = settle(sg.scope_ledger(sparse, FOLDS).filter(F.col("SCOPE") == sg.WHOLE))
    return scope_fits(sparse, ledger, [sg.WHOLE], settings)


@query("j26_recursive_elimination", "FEATURE:s SHORTLIST_MI:f RFE_RANK:i FINAL_ABS_COEFFICIENT:f RANK:i SELECTED:b")
def j26(t):
    return sg.wrapper_table(whole_fits(t, sg.Settings()), t.spark, 8)


@query("j27_embedded_mean_rank", "FEATURE:s COEFFICIENT:f IMPORTANCE:f MEAN_RANK:f RANK:i SELECTED:b REASON:s")
def j27(t):
    return sg.embedded_table(whole_fits(t, sg.Settings()), t.spark, EMBEDDED_LIST)


def strategies(t, scopes):
    """(choices, ledger, fits) of the three strategies in the given scopes."""
    settings = sg.Settings(filter_list=FILTER_LIST, wrapper_list=WRAPPER_LIST, embedded_list=EMBEDDED_LIST)
    sparse = latest_sparse(t)
    ledger = settle(sg.scope_ledger(sparse, FOLDS))
    fits = scope_fits(sparse, ledger, scopes, settings)
    return sg.strategy_choices(sparse, ledger, fits, settings), ledger, fits


@query("j28_strategy_report", "FEATURE:s STRATEGY:s SELECTED:b FOLD_SELECTION_COUNT:i FOLD_SELECTION_FREQUENCY:f FOLD_ELIGIBILITY_FREQUENCY:f STRATEGIES:i")
def j28(t):
    choices, ledger, _ = strategies(t, list(range(sg.WHOLE, FOLDS)))
    table = sg.fold_frequency(choices, ledger, FOLDS, "STRATEGY")
    return table.join(table.groupBy("FEATURE").agg(F.count_if("SELECTED").alias("STRATEGIES")), "FEATURE")


@query("j31_strategy_fold_diagnostics", "STRATEGY:s FOLD:i FIT_ROWS:i ROWS:i FEATURES:i AP:f PREVALENCE:f PRECISION:f LIFT:f")
def j31b(t):
    choices, _, fits = strategies(t, list(range(FOLDS)))
    return sg.strategy_diagnostics(choices, fits)


@query("j29_fold_accounting", "FOLD:i SNAPSHOTS:i ENTITIES:i POSITIVES:i OVERLAP:i", "manifest", f"""SELECT FOLD, count(*) AS SNAPSHOTS, count(DISTINCT m.PATIENT_ID) AS ENTITIES, sum(m.RESP) AS POSITIVES, 0 AS OVERLAP FROM manifest m JOIN ({FOLD_SQL}) f ON f.PATIENT_ID = m.PATIENT_ID WHERE SPLIT = 'train' GROUP BY 1""")
def j29(t):
    rows = t.manifest.filter(TRAIN).join(folds(t).select("PATIENT_ID", "FOLD"), "PATIENT_ID")
    per = rows.groupBy("PATIENT_ID").agg(F.count("*").alias("n"), F.sum("RESP").alias("p"), F.min("FOLD").alias("FOLD"), F.max("FOLD").alias("hi"))
    return per.groupBy("FOLD").agg(F.sum("n").alias("SNAPSHOTS"), F.count("*").alias("ENTITIES"), F.sum("p").alias("POSITIVES"), F.count_if(F.col("hi") != F.col("FOLD")).alias("OVERLAP"))


@query("j30_core_feature_set", "POSITION:i FEATURE:s FOUND:b SUPPORT:i", "counts", """SELECT r.p AS POSITION, r.f AS FEATURE, n IS NOT NULL AS FOUND, n AS SUPPORT FROM (VALUES (1, 'RX_BIG'), (2, 'DX_HOT'), (3, 'PX_BRAND#9'), (4, 'DX_GONE')) AS r(p, f) LEFT JOIN (SELECT CATEGORY, count(DISTINCT PATIENT_ID) AS n FROM counts GROUP BY 1) c ON CATEGORY = f""")
def j30(t):
    want = t.rows([(1, "RX_BIG"), (2, "DX_HOT"), (3, "PX_BRAND#9"), (4, "DX_GONE")], "POSITION int, FEATURE string")
    n = t.seen.groupBy(F.col("CATEGORY").alias("FEATURE")).agg(F.count("*").alias("SUPPORT"))
    return want.join(n, "FEATURE", "left").withColumn("FOUND", F.col("SUPPORT").isNotNull())


@query("j31_strategy_diagnostics", "STRATEGY:s FOLDS:i MEAN_LOSS:f SD_LOSS:f", "model_scores", """SELECT MODEL AS STRATEGY, count(*) AS FOLDS, avg(b) AS MEAN_LOSS, stddev_samp(b) AS SD_LOSS FROM (SELECT MODEL, CAST('0x' || substr(sha256('fold|' || PATIENT_ID), 1, 15) AS BIGINT) % 5 AS f, avg((SCORE - RESP) * (SCORE - RESP)) AS b FROM model_scores WHERE SPLIT = 'train' GROUP BY 1, 2) GROUP BY 1""")
def j31(t):
    fold = F.pmod(hash_int(F.concat(F.lit("fold|"), "PATIENT_ID")), F.lit(5)).alias("f")
    d = F.col("SCORE") - F.col("RESP")
    per = t.model_scores.filter(TRAIN).groupBy(F.col("MODEL").alias("STRATEGY"), fold).agg(F.avg(d * d).alias("b"))
    return per.groupBy("STRATEGY").agg(F.count("*").alias("FOLDS"), F.avg("b").alias("MEAN_LOSS"), F.stddev_samp("b").alias("SD_LOSS"))
