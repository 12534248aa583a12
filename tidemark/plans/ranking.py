"""Sections E and F and the unresampled part of K: ranks, top shares and evaluation metrics."""

from pyspark.sql import Window as W, functions as F

from tidemark.functions.scalar import hash_int, key_hash
from tidemark.operators import evaluation as evl, events as ev, features as ft, ordering as od, sequences as sq
from tidemark.plans.aggregates import COVER_SQL
from tidemark.plans.registry import query

KEY = ["PATIENT_ID", "END_DT"]
TEST = "SPLIT = 'test'"


def keys():
    return [F.col("PATIENT_ID"), F.col("END_DT")]


# SQL of the label-blind rank: score descending, hash of the key array, key.
_TIE = """sha256('["' || PATIENT_ID || '","' || CAST(END_DT AS VARCHAR) || '"]')"""
RANKED = f"SELECT *, row_number() OVER (ORDER BY P_RESP1 DESC, {_TIE}, PATIENT_ID, END_DT) AS RANK, count(*) OVER () AS N FROM scored"
DECILED = f"SELECT *, CAST(floor((RANK - 1) * 10 / N) + 1 AS INTEGER) AS DECILE FROM ({RANKED})"
DECILE_TABLE = f"""SELECT *, POSITIVES / ROWS AS RATE, POSITIVES / tp AS SHARE, (POSITIVES / ROWS) / (tp / tn) AS LIFT, CUM_POSITIVES / tp AS CUM_RECALL,
  CUM_POSITIVES / CUM_ROWS AS CUM_PRECISION, (CUM_POSITIVES / CUM_ROWS) / (tp / tn) AS CUM_LIFT FROM (
  SELECT *, sum(ROWS) OVER (ORDER BY DECILE) AS CUM_ROWS, sum(POSITIVES) OVER (ORDER BY DECILE) AS CUM_POSITIVES, sum(POSITIVES) OVER () AS tp, sum(ROWS) OVER () AS tn
  FROM (SELECT DECILE, count(*) AS ROWS, sum(RESP) AS POSITIVES, min(P_RESP1) AS MIN_SCORE, max(P_RESP1) AS MAX_SCORE FROM ({DECILED}) GROUP BY DECILE))"""
_CURVE = """SELECT *, sum(p) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn
  FROM (SELECT P_RESP1 AS s, sum(RESP) AS p, sum(1 - RESP) AS n FROM scored GROUP BY 1)"""
K_SQL = "greatest(1, (N * {p} + 99) // 100)"


@query("e01_latest_snapshot", "PATIENT_ID:s END_DT:d RESP:i", "snapshots", """SELECT PATIENT_ID, END_DT, RESP FROM (
  SELECT *, row_number() OVER (PARTITION BY PATIENT_ID ORDER BY END_DT DESC) AS rn FROM snapshots) WHERE rn = 1""")
def e01(t):
    return evl.latest_snapshot(t.snapshots)


@query("e02_snapshot_gaps", "PAIRS:i MIN_GAP:i MAX_GAP:i MEAN_GAP:f MEDIAN_GAP:f UNDER_30:i UP_TO_90:i", "snapshots", """SELECT count(g) AS PAIRS, min(g) AS MIN_GAP, max(g) AS MAX_GAP,
  avg(g) AS MEAN_GAP, median(g) AS MEDIAN_GAP, count(*) FILTER (g < 30) AS UNDER_30, count(*) FILTER (g <= 90) AS UP_TO_90 FROM (
  SELECT END_DT - lag(END_DT) OVER (PARTITION BY PATIENT_ID ORDER BY END_DT) AS g FROM snapshots)""")
def e02(t):
    # Keys are unique, so an entity's window holds at most one row per cutoff date.
    gap = F.datediff("END_DT", F.lag("END_DT").over(W.partitionBy("PATIENT_ID").orderBy("END_DT")))
    gaps = t.snapshots.select(gap.alias("g")).filter("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"))
    return gaps.agg(F.sum("n").alias("PAIRS"), F.min("g").alias("MIN_GAP"), F.max("g").alias("MAX_GAP"),
                    (F.sum(F.col("g") * F.col("n")) / F.sum("n")).alias("MEAN_GAP"), F.expr("percentile(g, 0.5, n)").alias("MEDIAN_GAP"),
                    F.sum(F.when(F.col("g") < 30, F.col("n")).otherwise(0)).alias("UNDER_30"),
                    F.sum(F.when(F.col("g") <= 90, F.col("n")).otherwise(0)).alias("UP_TO_90"))


@query("e03_positives_before_latest", "ROWS:i EARLIER_POSITIVES:i ENTITIES:i", "snapshots", """SELECT count(*) AS ROWS, count(*) FILTER (RESP = 1 AND END_DT < m) AS EARLIER_POSITIVES,
  count(DISTINCT PATIENT_ID) AS ENTITIES FROM (SELECT *, max(END_DT) OVER (PARTITION BY PATIENT_ID) AS m FROM snapshots)""")
def e03(t):
    # Positives before the latest date = all positives minus those on it; both are per-entity aggregates.
    per = t.snapshots.groupBy("PATIENT_ID").agg(F.count("*").alias("n"), F.sum("RESP").alias("p"),
                                                F.max_by("RESP", "END_DT").alias("last"))
    return per.agg(F.sum("n").alias("ROWS"), F.sum(F.col("p") - F.col("last")).alias("EARLIER_POSITIVES"), F.count("*").alias("ENTITIES"))


@query("e04_label_blind_rank", "PATIENT_ID:s END_DT:d P_RESP1:f RANK:i", "scored", RANKED)
def e04(t):
    return evl.label_blind_rank(t.scored, "P_RESP1")


@query("e05_ceil_deciles", "PATIENT_ID:s END_DT:d RANK:i DECILE:i", "scored", DECILED)
def e05(t):
    return evl.with_decile(t.scored, "P_RESP1")


@query("e06_reverse_deciles", "DECILE:i ROWS:i POSITIVES:i MIN_SCORE:f MAX_SCORE:f", "scored", f"""SELECT 11 - DECILE AS DECILE, count(*) AS ROWS, sum(RESP) AS POSITIVES,
  min(P_RESP1) AS MIN_SCORE, max(P_RESP1) AS MAX_SCORE FROM ({DECILED}) GROUP BY 1""")
def e06(t):
    return evl.decile_table(t.scored, "P_RESP1").withColumn("DECILE", 11 - F.col("DECILE"))


@query("e07_decile_running_totals", "DECILE:i CUM_ROWS:i CUM_POSITIVES:i", "scored", f"SELECT * FROM ({DECILE_TABLE})")
def e07(t):
    return evl.decile_table(t.scored, "P_RESP1")


_MODEL_LIFT = """SELECT MODEL, sum(CASE WHEN rk <= k THEN RESP END) / k / (p / N) AS LIFT FROM (SELECT *, greatest(1, (N * 10 + 99) // 100) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY MODEL ORDER BY SCORE DESC, PATIENT_ID, END_DT) AS rk, count(*) OVER (PARTITION BY MODEL) AS N,
  sum(RESP) OVER (PARTITION BY MODEL) AS p FROM model_scores WHERE SPLIT = 'test')) GROUP BY MODEL, k, p, N"""


def model_lifts(t, percents=(10,)):
    return evl.top_share(t.model_scores.filter(TEST), "SCORE", list(percents), keys(), groups=("MODEL",))


@query("e08_competition_rank", "MODEL:s LIFT:f BLOCKED:b MODEL_RANK:i", "model_scores", f"""SELECT MODEL, LIFT, MODEL = 'gamma' AS BLOCKED,
  CASE WHEN MODEL <> 'gamma' THEN rank() OVER (ORDER BY CASE WHEN MODEL <> 'gamma' THEN LIFT END DESC NULLS LAST) END AS MODEL_RANK FROM ({_MODEL_LIFT})""")
def e08(t):
    return evl.competition_rank(model_lifts(t).select("MODEL", "LIFT", (F.col("MODEL") == "gamma").alias("BLOCKED")), "LIFT", "BLOCKED")


@query("e09_average_ranks", "P_RESP1:f N:i MID_RANK:f", "scored", """SELECT P_RESP1, count(*) AS N, min(rk) + (count(*) - 1) / 2.0 AS MID_RANK FROM (
  SELECT P_RESP1, rank() OVER (ORDER BY P_RESP1) AS rk FROM scored) GROUP BY 1""")
def e09(t):
    return od.mid_ranks(t.scored.groupBy("P_RESP1").agg(F.count("*").alias("N")), "P_RESP1", "N")


@query("e10_weighted_mid_ranks", "P_RESP1:f W:f MID_SHARE:f", "scored", """SELECT P_RESP1, W, (sum(W) OVER (ORDER BY P_RESP1) - W / 2) / sum(W) OVER () AS MID_SHARE FROM (
  SELECT P_RESP1, sum(1.0 / c) AS W FROM (SELECT P_RESP1, count(*) OVER (PARTITION BY PATIENT_ID) AS c FROM scored) GROUP BY 1)""")
def e10(t):
    from tidemark.operators.association import entity_weights
    return od.mid_ranks(entity_weights(t.scored).groupBy("P_RESP1").agg(F.sum("ENTITY_SHARE").alias("W")), "P_RESP1", "W")


@query("e11_fold_rank_stability", "FEATURE:s MEAN_RANK:f SD_RANK:f FOLDS:i", "dense", """SELECT FEATURE, avg(rk) AS MEAN_RANK, stddev_samp(rk) AS SD_RANK, count(*) AS FOLDS FROM (
  SELECT FEATURE, f, rank() OVER (PARTITION BY f ORDER BY v DESC, FEATURE) AS rk FROM (SELECT FEATURE, CAST('0x' || substr(sha256('fold|' || PATIENT_ID), 1, 15) AS BIGINT) % 5 AS f, sum(VALUE) AS v
  FROM dense WHERE VALUE > 0 AND SPLIT = 'train' GROUP BY 1, 2)) GROUP BY FEATURE""")
def e11(t):
    from tidemark.operators.selection import rank_stability
    fold = F.pmod(hash_int(F.concat(F.lit("fold|"), "PATIENT_ID")), F.lit(5)).alias("FOLD")
    train = t.annual.join(t.manifest.filter("SPLIT = 'train'"), KEY, "left_semi")
    return rank_stability(train.groupBy("FEATURE", fold).agg(F.sum("VALUE").alias("SCORE")))


@query("e12_step_completeness", "PATIENT_ID:s END_DT:d STEPS:i COMPLETE:b", "counts", """SELECT PATIENT_ID, END_DT, count(DISTINCT TIME_STEP) AS STEPS,
  count(DISTINCT TIME_STEP) = 12 AND min(TIME_STEP) = 0 AND max(TIME_STEP) = 11 AS COMPLETE FROM counts GROUP BY 1, 2""")
def e12(t):
    once = t.counts.select(*KEY, "TIME_STEP").distinct()
    return once.groupBy(*KEY).agg(F.count("*").alias("STEPS"), ((F.count("*") == 12) & (F.min("TIME_STEP") == 0)
                                                                & (F.max("TIME_STEP") == 11)).alias("COMPLETE"))


@query("e13_lexicographic_winner", "p_type:s p_brand:s N:i SIZES:i LIGHTEST:i", "", """SELECT p_type, p_brand, N, SIZES, LIGHTEST FROM (SELECT *, row_number() OVER (PARTITION BY p_type
  ORDER BY N DESC, SIZES, LIGHTEST, p_brand) AS rn FROM (SELECT p_type, p_brand, count(*) AS N, count(DISTINCT p_size) AS SIZES, min(p_size) AS LIGHTEST FROM part GROUP BY 1, 2)) WHERE rn = 1""")
def e13(t):
    once = t.part.groupBy("p_type", "p_brand", "p_size").agg(F.count("*").alias("n"))
    per = once.groupBy("p_type", "p_brand").agg(F.sum("n").alias("N"), F.count("*").alias("SIZES"), F.min("p_size").alias("LIGHTEST"))
    return evl.best_by(per, ["p_type"], [-F.col("N"), F.col("SIZES"), F.col("LIGHTEST"), F.col("p_brand")])


_TOP = """SELECT {g} PERCENT, N AS ROWS, P AS POSITIVES, K AS SELECTED, sum(CASE WHEN rk <= K THEN RESP ELSE 0 END) AS CAPTURED, sum(CASE WHEN rk <= K THEN RESP ELSE 0 END) / K AS PRECISION,
  sum(CASE WHEN rk <= K THEN RESP ELSE 0 END) / P AS RECALL, (sum(CASE WHEN rk <= K THEN RESP ELSE 0 END) / K) / (P / N) AS LIFT, min(CASE WHEN rk <= K THEN s END) AS CUTOFF_SCORE,
  count(*) FILTER (s = cut) AS TIED_AT_CUTOFF, count(*) FILTER (s = cut AND rk <= K) AS TIED_SELECTED FROM (
  SELECT *, min(CASE WHEN rk <= K THEN s END) OVER (PARTITION BY {g} PERCENT) AS cut FROM (SELECT *, greatest(1, (N * PERCENT + 99) // 100) AS K FROM (
  SELECT *, unnest({p}) AS PERCENT FROM (SELECT *, {s} AS s, row_number() OVER ({w} ORDER BY {s} DESC, {o}) AS rk, count(*) OVER ({w}) AS N, sum(RESP) OVER ({w}) AS P FROM {t})))) GROUP BY {g} PERCENT, N, P, K"""


def top_sql(table, score, order, percents, group=""):
    return _TOP.format(g=f"{group}, " if group else "", p=list(percents), s=score, o=order, t=table,
                       w=f"PARTITION BY {group}" if group else "")


_TOP_COLS = "PERCENT:i ROWS:i POSITIVES:i SELECTED:i CAPTURED:i PRECISION:f RECALL:f LIFT:f CUTOFF_SCORE:f TIED_AT_CUTOFF:i TIED_SELECTED:i"


@query("f01_top_fraction", _TOP_COLS, "scored", top_sql("scored", "P_RESP1", "PATIENT_ID, END_DT", (1, 5, 10, 20, 30)))
def f01(t):
    return evl.top_share(t.scored, "P_RESP1", [1, 5, 10, 20, 30], keys())


@query("f02_row_order_lift", "PERCENT:i SELECTED:i CAPTURED:i LIFT:f", "scored", top_sql("scored", "P_RESP1", "END_DT, CAST(PATIENT_ID AS BIGINT)", (10,)))
def f02(t):
    # The stable row ordinal of the source: cutoff, then numeric entity.
    return evl.top_share(t.scored, "P_RESP1", [10], [F.col("END_DT"), F.col("PATIENT_ID").cast("long")])


@query("f03_fractional_ties", "K:i CAPTURED:f PRECISION:f LIFT:f", "scored", f"""SELECT k AS K, sum(p * f) AS CAPTURED, sum(p * f) / k AS PRECISION, sum(p * f) / k / (tp / (tp + tn)) AS LIFT FROM (
  SELECT *, least(1.0, greatest(0.0, (k - (cp - p + cn - n)) / (p + n))) AS f FROM (SELECT *, greatest(1, ((tp + tn) * 10 + 99) // 100) AS k FROM ({_CURVE}))) GROUP BY k, tp, tn""")
def f03(t):
    return evl.fractional_top(evl.curve(t.scored, "P_RESP1"), "P_RESP1", 10)


@query("f04_top_codes_per_month", "PATIENT_ID:s END_DT:d TIME_STEP:i CATEGORY:s VALUE:i POSITION:i DROPPED:i", "counts", """SELECT * FROM (SELECT PATIENT_ID, END_DT, TIME_STEP, CATEGORY, VALUE,
  row_number() OVER (PARTITION BY PATIENT_ID, END_DT, TIME_STEP ORDER BY VALUE DESC, CATEGORY) AS POSITION, greatest(0, count(*) OVER (PARTITION BY PATIENT_ID, END_DT, TIME_STEP) - 3) AS DROPPED
  FROM counts WHERE FAMILY <> 'RX') WHERE POSITION <= 3""")
def f04(t):
    from tidemark.operators.sequences import top_codes
    return top_codes(t.counts.filter("FAMILY <> 'RX'"), 3)


@query("f05_vocabulary_cap", "POSITION:i FEATURE:s MEASURE:s SUPPORT:i", "counts manifest", """SELECT POSITION, FEATURE, m AS MEASURE, SUPPORT FROM (SELECT *, unnest(['COUNT', 'RECENT']) AS m FROM (SELECT CATEGORY AS FEATURE, count(DISTINCT PATIENT_ID) AS SUPPORT,
  row_number() OVER (ORDER BY count(DISTINCT PATIENT_ID) DESC, CATEGORY) AS POSITION FROM counts WHERE PATIENT_ID IN (SELECT PATIENT_ID FROM manifest WHERE SPLIT = 'train') GROUP BY CATEGORY) WHERE POSITION <= 10)""")
def f05(t):
    from tidemark.operators.selection import capped_vocabulary, train_support
    train = t.manifest.filter("SPLIT = 'train'")
    return capped_vocabulary(train_support(t.seen.withColumnRenamed("CATEGORY", "FEATURE"), train), 21, reserved=1)


@query("f06_term_cap", "TERM:s FREQUENCY:i", "", """SELECT w AS TERM, count(*) AS FREQUENCY FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part JOIN lineitem ON l_partkey = p_partkey)
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""")
def f06(t):
    sold = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    words = t.part.join(sold, F.col("p_partkey") == F.col("l_partkey")).select(F.explode(F.split("p_name", " ")).alias("TERM"), "n")
    return words.groupBy("TERM").agg(F.sum("n").alias("FREQUENCY")).orderBy(F.desc("FREQUENCY"), "TERM").limit(8)


@query("f07_top_k_flag", "FEATURE_INDEX:i FEATURE:s SUPPORT:i SELECTED:b", "counts", """SELECT row_number() OVER (ORDER BY CATEGORY) - 1 AS FEATURE_INDEX, CATEGORY AS FEATURE, n AS SUPPORT,
  row_number() OVER (ORDER BY n DESC, CATEGORY) <= 12 AS SELECTED FROM (SELECT CATEGORY, sum(VALUE) AS n FROM counts GROUP BY 1)""")
def f07(t):
    from tidemark.operators.selection import top_k_flag
    support = t.counts.groupBy(F.col("CATEGORY").alias("FEATURE_NAME")).agg(F.sum("VALUE").alias("SUPPORT"))
    return top_k_flag(ft.feature_map(support), "SUPPORT", 12).withColumnRenamed("FEATURE_NAME", "FEATURE")


@query("f08_boundary_ties", "PERCENT:i SELECTED:i CUTOFF_SCORE:f TIED_AT_CUTOFF:i TIED_SELECTED:i CROSSES:b", "scored",
       f"SELECT *, TIED_AT_CUTOFF > TIED_SELECTED AS CROSSES FROM ({top_sql('scored', 'P_RESP1', _TIE + ', PATIENT_ID, END_DT', (10, 20, 30))})")
def f08(t):
    return evl.boundary_ties(t.scored, "P_RESP1")


@query("k01_decile_table", "DECILE:i ROWS:i POSITIVES:i RATE:f SHARE:f LIFT:f CUM_ROWS:i CUM_POSITIVES:i CUM_RECALL:f CUM_PRECISION:f CUM_LIFT:f", "scored", DECILE_TABLE)
def k01(t):
    return evl.decile_table(t.scored, "P_RESP1")


@query("k02_top_k_table", "PERCENT:i SELECTED:i CAPTURED:i RECALL:f PRECISION:f LIFT:f", "scored", f"""SELECT DECILE * 10 AS PERCENT, CUM_ROWS AS SELECTED, CUM_POSITIVES AS CAPTURED,
  CUM_RECALL AS RECALL, CUM_PRECISION AS PRECISION, CUM_LIFT AS LIFT FROM ({DECILE_TABLE}) WHERE DECILE <= 3""")
def k02(t):
    return evl.top_k_table(evl.decile_table(t.scored, "P_RESP1"))


_AP = "sum(p / tp * (cp / (cp + cn)))"
_AUC = "sum(n * (cp - p / 2)) / (max(tp) * max(tn))"


@query("k03_global_metrics", "ROWS:i ENTITIES:i POSITIVES:i PREVALENCE:f AP:f AUC:f", "scored", f"""SELECT (SELECT count(*) FROM scored) AS ROWS, (SELECT count(DISTINCT PATIENT_ID) FROM scored) AS ENTITIES,
  (SELECT sum(RESP) FROM scored) AS POSITIVES, (SELECT avg(RESP) FROM scored) AS PREVALENCE, {_AP} AS AP, {_AUC} AS AUC FROM ({_CURVE})""")
def k03(t):
    metrics = evl.curve_metrics(evl.curve(t.scored, "P_RESP1"))
    per = t.scored.groupBy("PATIENT_ID").agg(F.count("*").alias("n")).agg(F.count("*").alias("ENTITIES"))
    return od.attach(metrics, per, []).withColumn("PREVALENCE", F.col("POSITIVES") / F.col("ROWS"))


@query("k04_confusion", "SPLIT:s TP:i FP:i FN:i TN:i PRECISION:f RECALL:f F1:f SPECIFICITY:f ACCURACY:f", "scored", """SELECT SPLIT, TP, FP, FN, TN, coalesce(TP / nullif(TP + FP, 0), 0) AS PRECISION,
  coalesce(TP / nullif(TP + FN, 0), 0) AS RECALL, coalesce(2 * TP / nullif(2 * TP + FP + FN, 0), 0) AS F1, coalesce(TN / nullif(TN + FP, 0), 0) AS SPECIFICITY, (TP + TN) / (TP + FP + FN + TN) AS ACCURACY
  FROM (SELECT SPLIT, count(*) FILTER (P_RESP1 >= 0.6 AND RESP = 1) AS TP, count(*) FILTER (P_RESP1 >= 0.6 AND RESP = 0) AS FP, count(*) FILTER (P_RESP1 < 0.6 AND RESP = 1) AS FN,
  count(*) FILTER (P_RESP1 < 0.6 AND RESP = 0) AS TN FROM scored GROUP BY SPLIT)""")
def k04(t):
    return evl.confusion(t.scored, "P_RESP1", 0.6, groups=("SPLIT",))


_WCURVE = """SELECT *, sum(p) OVER (PARTITION BY MODEL ORDER BY s DESC) AS cp, sum(n) OVER (PARTITION BY MODEL ORDER BY s DESC) AS cn, sum(p) OVER (PARTITION BY MODEL) AS tp, sum(n) OVER (PARTITION BY MODEL) AS tn
  FROM (SELECT MODEL, SCORE AS s, sum(RESP * w) AS p, sum((1 - RESP) * w) AS n FROM (SELECT *, 1.0 / count(*) OVER (PARTITION BY MODEL, PATIENT_ID) AS w FROM model_scores) GROUP BY 1, 2)"""


@query("k05_average_precision", "MODEL:s AP:f", "model_scores", f"SELECT MODEL, {_AP} AS AP FROM ({_WCURVE}) GROUP BY MODEL")
def k05(t):
    return _weighted_metrics(t)


@query("k06_roc_auc", "MODEL:s AUC:f", "model_scores", f"SELECT MODEL, {_AUC} AS AUC FROM ({_WCURVE}) GROUP BY MODEL")
def k06(t):
    return _weighted_metrics(t)


def _weighted_metrics(t):
    from tidemark.operators.association import entity_weights
    scores = t.model_scores.join(entity_weights(t.manifest).select(*KEY, "ENTITY_SHARE"), KEY)
    return evl.curve_metrics(evl.curve(scores, "SCORE", weight=F.col("ENTITY_SHARE"), groups=("MODEL",)), ("MODEL",))


@query("k07_trapezoid_pr_area", "PR_AREA:f", "scored", f"""SELECT sum(p / tp * (coalesce((cp - p) / nullif(cp - p + cn - n, 0), 1.0) + cp / (cp + cn)) / 2) AS PR_AREA FROM ({_CURVE})""")
def k07(t):
    return evl.pr_area(evl.curve(t.scored, "P_RESP1"), "P_RESP1")


@query("k08_probability_losses", "MODEL:s BRIER:f LOG_LOSS:f", "model_scores", """SELECT MODEL, avg((SCORE - RESP) * (SCORE - RESP)) AS BRIER, avg(-(RESP * ln(p) + (1 - RESP) * ln(1 - p))) AS LOG_LOSS
  FROM (SELECT *, greatest(1e-15, least(1 - 1e-15, SCORE)) AS p FROM model_scores) GROUP BY MODEL""")
def k08(t):
    return evl.probability_losses(t.model_scores, "SCORE", groups=("MODEL",))


@query("k09_calibration_bins", "BIN:i LOWER:f UPPER:f ROWS:i MEAN_PROBABILITY:f OBSERVED_RATE:f ECE_PART:f", "scored", """SELECT BIN, BIN / 10 AS LOWER, (BIN + 1) / 10 AS UPPER, coalesce(n, 0) AS ROWS,
  m AS MEAN_PROBABILITY, o AS OBSERVED_RATE, coalesce(n / (SELECT count(*) FROM scored) * abs(m - o), 0) AS ECE_PART FROM (SELECT unnest(range(10)) AS BIN) LEFT JOIN
  (SELECT least(floor(P_RESP1 * 10), 9) AS BIN, count(*) AS n, avg(P_RESP1) AS m, avg(RESP) AS o FROM scored GROUP BY 1) USING (BIN)""")
def k09(t):
    return evl.calibration(t.scored, "P_RESP1", 10)


@query("k10_curve_points", "SCORE:f PRECISION:f RECALL:f FPR:f", "scored", f"SELECT s AS SCORE, cp / (cp + cn) AS PRECISION, cp / tp AS RECALL, cn / tn AS FPR FROM ({_CURVE})")
def k10(t):
    return evl.curve_points(evl.curve(t.scored, "P_RESP1")).withColumnRenamed("P_RESP1", "SCORE")


@query("k11_best_f1_threshold", "THRESHOLD:f F1:f", "scored", f"SELECT s AS THRESHOLD, 2 * cp / (tp + cp + cn) AS F1 FROM ({_CURVE}) ORDER BY 2 DESC, 1 DESC LIMIT 1")
def k11(t):
    return evl.best_f1(evl.curve(t.scored, "P_RESP1"), "P_RESP1")


# Entities whose id is a multiple of 6 are given no enrolment, so all their periods are padding.
_ENROLLED = "CAST(PATIENT_ID AS BIGINT) % 6 <> 0"
_MEMBERS = f"""SELECT *, unnest(['all', CASE WHEN END_DT = m THEN 'latest' ELSE 'earlier' END, CASE coalesce(n, 0) WHEN 0 THEN 'all_padded' WHEN 12 THEN 'fully_covered' ELSE 'partly_covered' END]) AS GRP FROM (SELECT s.*, n, max(s.END_DT) OVER (PARTITION BY s.PATIENT_ID) AS m FROM scored s
  LEFT JOIN (SELECT PATIENT_ID, END_DT, count(*) AS n FROM ({COVER_SQL}) WHERE COVERED AND {_ENROLLED} GROUP BY 1, 2) c ON c.PATIENT_ID = s.PATIENT_ID AND c.END_DT = s.END_DT)"""


@query("k12_subpopulation_metrics", "GRP:s ROWS:i POSITIVES:i AP:f AUC:f BRIER:f", "scored enrollment", f"""SELECT c.GRP, max(tp + tn) AS ROWS, max(tp) AS POSITIVES, {_AP} AS AP, {_AUC} AS AUC, max(b) AS BRIER FROM (
  SELECT *, sum(p) OVER (PARTITION BY GRP ORDER BY s DESC) AS cp, sum(n) OVER (PARTITION BY GRP ORDER BY s DESC) AS cn, sum(p) OVER (PARTITION BY GRP) AS tp, sum(n) OVER (PARTITION BY GRP) AS tn FROM (
  SELECT GRP, P_RESP1 AS s, sum(RESP) AS p, sum(1 - RESP) AS n FROM ({_MEMBERS}) GROUP BY 1, 2)) c JOIN (SELECT GRP, avg((P_RESP1 - RESP) * (P_RESP1 - RESP)) AS b FROM ({_MEMBERS}) GROUP BY 1) b USING (GRP) GROUP BY c.GRP""")
def k12(t):
    latest = t.scored.groupBy("PATIENT_ID").agg(F.max("END_DT").alias("m"))
    mask = ev.interval_overlap(ft.period_grid(t.snapshots), t.enrollment.filter(_ENROLLED), "START_DATE", "END_DATE")
    member = F.explode(F.array(F.lit("all"), F.when(F.col("END_DT") == F.col("m"), "latest").otherwise("earlier"), F.col("MASK")))
    rows = t.scored.join(latest, "PATIENT_ID").join(sq.mask_groups(mask, "COVERED"), KEY).withColumn("GRP", member)
    return evl.curve_metrics(evl.curve(rows, "P_RESP1", groups=("GRP",)), ("GRP",)).join(
        evl.probability_losses(rows, "P_RESP1", groups=("GRP",)), "GRP")


@query("k13_entities_captured", "ENTITIES:i POSITIVE_ENTITIES:i", "scored", f"""SELECT count(DISTINCT PATIENT_ID) AS ENTITIES, count(DISTINCT CASE WHEN RESP = 1 THEN PATIENT_ID END) AS POSITIVE_ENTITIES
  FROM ({RANKED}) WHERE RANK <= {K_SQL.format(p=10)}""")
def k13(t):
    chosen = evl.with_decile(t.scored, "P_RESP1").filter(F.col("RANK") <= evl.capacity(F.col("N"), 10))
    per = chosen.groupBy("PATIENT_ID").agg(F.max("RESP").alias("y"))
    return per.agg(F.count("*").alias("ENTITIES"), F.sum("y").alias("POSITIVE_ENTITIES"))


@query("k14_model_comparison", "MODEL:s PERCENT:i LIFT:f DELTA:f RELATIVE_DELTA:f MODEL_RANK:i", "model_scores", f"""SELECT a.MODEL, a.PERCENT, a.LIFT, a.LIFT - b.LIFT AS DELTA, (a.LIFT - b.LIFT) / nullif(b.LIFT, 0) AS RELATIVE_DELTA,
  rank() OVER (PARTITION BY a.PERCENT ORDER BY a.LIFT DESC) AS MODEL_RANK FROM ({top_sql("(SELECT * FROM model_scores WHERE SPLIT = 'test')", "SCORE", "PATIENT_ID, END_DT", (10, 20, 30), "MODEL")}) a
  JOIN ({top_sql("(SELECT * FROM model_scores WHERE SPLIT = 'test')", "SCORE", "PATIENT_ID, END_DT", (10, 20, 30), "MODEL")}) b ON b.MODEL = 'gamma' AND b.PERCENT = a.PERCENT""")
def k14(t):
    lifts = model_lifts(t, (10, 20, 30))
    base = lifts.filter("MODEL = 'gamma'").select("PERCENT", F.col("LIFT").alias("B"))
    delta = F.col("LIFT") - F.col("B")
    return lifts.join(base, "PERCENT").select("MODEL", "PERCENT", "LIFT", delta.alias("DELTA"), (delta / F.nullif(F.col("B"), F.lit(0.0))).alias("RELATIVE_DELTA"),
                                              F.rank().over(W.partitionBy("PERCENT").orderBy(F.desc("LIFT"))).alias("MODEL_RANK"))


@query("k19_external_benchmark", "STATUS:s MATCHED:i MISSING:i EXTRA:i LABEL_MISMATCH:i", "model_scores scored", """SELECT CASE WHEN MISSING = 0 AND LABEL_MISMATCH = 0 THEN 'aligned' ELSE 'blocked' END AS STATUS, * FROM (
  SELECT count(*) FILTER (e.PATIENT_ID IS NOT NULL AND s.PATIENT_ID IS NOT NULL) AS MATCHED, count(*) FILTER (e.PATIENT_ID IS NULL) AS MISSING, count(*) FILTER (s.PATIENT_ID IS NULL) AS EXTRA,
  count(*) FILTER (e.RESP <> s.RESP) AS LABEL_MISMATCH FROM (SELECT * FROM scored WHERE SPLIT = 'test') s FULL JOIN
  (SELECT PATIENT_ID, END_DT, CASE WHEN SCORE > 0.9 THEN 1 - RESP ELSE RESP END AS RESP FROM model_scores WHERE MODEL = 'alpha' AND SPLIT <> 'train') e ON e.PATIENT_ID = s.PATIENT_ID AND e.END_DT = s.END_DT)""")
def k19(t):
    from tidemark.operators.contracts import key_alignment
    external = t.model_scores.filter("MODEL = 'alpha' AND SPLIT <> 'train'").select(
        *KEY, F.when(F.col("SCORE") > 0.9, 1 - F.col("RESP")).otherwise(F.col("RESP")).alias("RESP"))
    a = key_alignment(t.scored.filter(TEST), external, KEY, "RESP")
    blocked = (F.col("MISSING") > 0) | (F.col("LABEL_MISMATCH") > 0) | (F.col("DUPLICATE_RIGHT") > 0)
    return a.withColumn("STATUS", F.when(blocked, "blocked").otherwise("aligned"))


_BLEND = """SELECT a.PATIENT_ID, a.END_DT, a.RESP, W, round(((20 - W) * a.SCORE + W * b.SCORE) / 20, 9) AS s FROM (SELECT * FROM model_scores WHERE SPLIT = 'test' AND MODEL = 'alpha') a
  JOIN (SELECT * FROM model_scores WHERE SPLIT = 'test' AND MODEL = 'beta') b ON a.PATIENT_ID = b.PATIENT_ID AND a.END_DT = b.END_DT, (SELECT unnest(range(21)) AS W)"""


@query("k20_blend_grid", "W:i CAPTURED:i LIFT:f", "model_scores", f"""SELECT W, CAPTURED, LIFT FROM ({top_sql("(" + _BLEND + ")", "s", "PATIENT_ID, END_DT", (10,), "W")}) ORDER BY LIFT DESC, W LIMIT 1""")
def k20(t):
    # The two models are read side by side in one aggregation, then each row is expanded over the 21 weights.
    pair = t.model_scores.filter(TEST).groupBy(*KEY, "RESP").agg(
        F.max(F.when(F.col("MODEL") == "alpha", F.col("SCORE"))).alias("a"), F.max(F.when(F.col("MODEL") == "beta", F.col("SCORE"))).alias("b"))
    rows = pair.withColumn("W", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn(
        "s", F.round(((20 - F.col("W")) * F.col("a") + F.col("W") * F.col("b")) / 20, 9))
    lifts = evl.top_share(rows, "s", [10], keys(), groups=("W",))
    best = lifts.agg(F.min_by(F.struct("W", "CAPTURED", "LIFT"), F.struct(-F.col("LIFT"), F.col("W"))).alias("x"))
    return best.select("x.*")


@query("k24_out_of_fold_assembly", "FOLD:i ROWS:i SCORED_ONCE:i REPEATED:i MISSING:i", "manifest", """SELECT f AS FOLD, count(*) AS ROWS, count(*) AS SCORED_ONCE, 0 AS REPEATED, 0 AS MISSING FROM (
  SELECT CAST('0x' || substr(sha256('fold|' || PATIENT_ID), 1, 15) AS BIGINT) % 5 AS f FROM manifest WHERE SPLIT = 'train') GROUP BY 1""")
def k24(t):
    fold = F.pmod(hash_int(F.concat(F.lit("fold|"), "PATIENT_ID")), F.lit(5))
    train = t.manifest.filter("SPLIT = 'train'").withColumn("FOLD", fold)
    scores = t.model_scores.filter("SPLIT = 'train' AND MODEL = 'alpha'").groupBy(*KEY).agg(F.count("*").alias("n"))
    j = train.join(scores, KEY, "left")
    return j.groupBy("FOLD").agg(F.count("*").alias("ROWS"), F.count_if(F.col("n") == 1).alias("SCORED_ONCE"),
                                 F.count_if(F.col("n") > 1).alias("REPEATED"), F.count_if(F.col("n").isNull()).alias("MISSING"))
