"""Section L and the resampled part of K: splits, samples, bootstrap and reliance."""

from pyspark.sql import Window as W, functions as F

from tidemark.functions.scalar import total
from tidemark.operators import evaluation as evl, features as ft, ordering as od, resample as rs
from tidemark.operators.contracts import exact_join
from tidemark.operators.ordering import attach
from tidemark.plans.ranking import TEST, keys
from tidemark.plans.registry import query
from tidemark.session import settle

KEY = ["PATIENT_ID", "END_DT"]
TRAIN = "SPLIT = 'train'"
DRAWS = 1000
LEAST = 800  # valid draws of a reliable interval


def H(*parts):
    """SQL of the 60-bit hash of parts joined by a bar."""
    return "CAST('0x' || substr(sha256(" + " || '|' || ".join(parts) + "), 1, 15) AS BIGINT)"


_KEYS = ("PATIENT_ID", "CAST(END_DT AS VARCHAR)")


def _quota_sql(src, seed, names, bounds):
    cases = " ".join(f"WHEN r <= ceil(n * {b} / 100) THEN '{a}'" for a, b in zip(names, bounds))
    return f"SELECT PATIENT_ID, RESP, CASE {cases} ELSE '{names[-1]}' END AS PART FROM (SELECT *, row_number() OVER (PARTITION BY RESP ORDER BY {H(repr(seed), 'PATIENT_ID')}, PATIENT_ID) AS r, count(*) OVER (PARTITION BY RESP) AS n FROM ({src}))"


_STRATA = "SELECT PATIENT_ID, max(RESP) AS RESP FROM snapshots GROUP BY 1"
_TSTRATA = "SELECT PATIENT_ID, max(RESP) AS RESP FROM manifest WHERE SPLIT = 'train' GROUP BY 1"


def strata(rows):
    return rows.groupBy("PATIENT_ID").agg(F.max("RESP").alias("RESP"))


@query("l01_stratified_entity_split", "PATIENT_ID:s RESP:i PART:s", "snapshots", _quota_sql(_STRATA, "split1", ["train", "validation", "test"], [70, 85]))
def l01(t):
    return rs.quota_split(strata(t.snapshots), "split1", ["train", "validation", "test"], [70, 85])


@query("l02_inherited_hash_split", "PATIENT_ID:s SPLIT:s INHERITED:b", "snapshots manifest", """SELECT s.PATIENT_ID, coalesce(p.SPLIT, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'validation' ELSE 'test' END) AS SPLIT, p.SPLIT IS NOT NULL AS INHERITED
  FROM (SELECT DISTINCT PATIENT_ID, CAST('0x' || substr(sha256('42:' || PATIENT_ID), 1, 16) AS UBIGINT) / 18446744073709551616.0 AS u FROM snapshots) s LEFT JOIN (SELECT DISTINCT PATIENT_ID, SPLIT FROM manifest WHERE CAST(PATIENT_ID AS BIGINT) % 2 = 0) p ON p.PATIENT_ID = s.PATIENT_ID""")
def l02(t):
    known = t.manifest.filter(F.col("PATIENT_ID").cast("long") % 2 == 0)
    return rs.inherited_split(t.snapshots.select("PATIENT_ID").distinct(), known, 42)


@query("l03_split_alignment", "STATUS:s SPLIT:s ROWS:i", "snapshots manifest", """SELECT CASE WHEN m.PATIENT_ID IS NULL THEN 'missing' ELSE 'matched' END AS STATUS, SPLIT, count(*) AS ROWS FROM snapshots s LEFT JOIN (SELECT * FROM manifest WHERE CAST(PATIENT_ID AS BIGINT) % 23 <> 0) m ON m.PATIENT_ID = s.PATIENT_ID AND m.END_DT = s.END_DT GROUP BY 1, 2""")
def l03(t):
    m = t.manifest.filter(F.col("PATIENT_ID").cast("long") % 23 != 0).select(*KEY, "SPLIT")
    return exact_join(t.snapshots.select(*KEY), m, KEY).groupBy("STATUS", "SPLIT").agg(F.count("*").alias("ROWS"))


_ROLES = _quota_sql(_TSTRATA, "roles", ["fit", "stop", "rank"], [60, 80])


def roles(t):
    return rs.quota_split(strata(t.manifest.filter(TRAIN)), "roles", ["fit", "stop", "rank"], [60, 80])


def ranking_rows(t):
    """Latest snapshot of each ranking entity whose date is shared by at least two of them."""
    r = roles(t).filter("PART = 'rank'").select("PATIENT_ID")
    last = t.manifest.filter(TRAIN).join(r, "PATIENT_ID", "left_semi").groupBy("PATIENT_ID").agg(F.max("END_DT").alias("END_DT"))
    shared = last.groupBy("END_DT").agg(F.count("*").alias("n")).filter("n >= 2").select("END_DT")
    return last.join(shared, "END_DT", "left_semi")


_RANKROWS = f"SELECT PATIENT_ID, END_DT FROM (SELECT *, count(*) OVER (PARTITION BY END_DT) AS n FROM (SELECT m.PATIENT_ID, max(END_DT) AS END_DT FROM manifest m JOIN ({_ROLES}) r ON r.PATIENT_ID = m.PATIENT_ID AND PART = 'rank' WHERE SPLIT = 'train' GROUP BY 1)) WHERE n >= 2"


@query("l04_internal_roles", "PATIENT_ID:s END_DT:d ROLE:s RANK_EVALUATE:b", "manifest", f"""SELECT m.PATIENT_ID, m.END_DT, PART AS ROLE, x.PATIENT_ID IS NOT NULL AS RANK_EVALUATE FROM manifest m JOIN ({_ROLES}) r ON r.PATIENT_ID = m.PATIENT_ID LEFT JOIN ({_RANKROWS}) x ON x.PATIENT_ID = m.PATIENT_ID AND x.END_DT = m.END_DT WHERE SPLIT = 'train'""")
def l04(t):
    rows = t.manifest.filter(TRAIN).select(*KEY).join(roles(t).select("PATIENT_ID", F.col("PART").alias("ROLE")), "PATIENT_ID")
    chosen = ranking_rows(t).withColumn("_x", F.lit(True))
    return rows.join(chosen, KEY, "left").withColumn("RANK_EVALUATE", F.coalesce("_x", F.lit(False)))


@query("l05_entity_hash_sample", "PATIENT_ID:s END_DT:d", "manifest", """SELECT PATIENT_ID, END_DT FROM manifest WHERE SPLIT = 'train' AND PATIENT_ID IN (SELECT PATIENT_ID FROM (SELECT DISTINCT PATIENT_ID FROM manifest WHERE SPLIT = 'train') ORDER BY sha256('7:' || PATIENT_ID), PATIENT_ID LIMIT 90)
  ORDER BY sha256('7|' || PATIENT_ID || '|' || CAST(END_DT AS VARCHAR)), PATIENT_ID, END_DT LIMIT 300""")
def l05(t):
    return rs.entity_sample(t.manifest.filter(TRAIN).select(*KEY), 7, 90, 300)


def _draw_sql(src, seed, draws=DRAWS):
    return f"""(WITH en AS (SELECT PATIENT_ID, row_number() OVER (ORDER BY {H(repr(seed), 'PATIENT_ID')}, PATIENT_ID) - 1 AS s FROM (SELECT DISTINCT PATIENT_ID FROM ({src}))), pk AS (SELECT d, {H(repr(seed), 'CAST(d AS VARCHAR)', 'CAST(s AS VARCHAR)')} % (SELECT count(*) FROM en) AS s FROM en, (SELECT unnest(range({draws})) AS d))
      SELECT d AS DRAW, PATIENT_ID, count(*) AS M FROM pk JOIN en ON en.s = pk.s GROUP BY 1, 2)"""


_TESTROWS = "SELECT * FROM model_scores WHERE SPLIT = 'test'"


def draws(t):
    return rs.cluster_draws(t.manifest.filter(TEST), DRAWS, "boot")


@query("l06_cluster_draws", "DRAW:i PATIENT_ID:s M:i", "manifest", "SELECT * FROM " + _draw_sql("SELECT * FROM manifest WHERE SPLIT = 'test'", "boot"))
def l06(t):
    return draws(t)


_DONOR = f"SELECT PATIENT_ID, END_DT, lead(PATIENT_ID, 1, fst) OVER (PARTITION BY END_DT ORDER BY h, PATIENT_ID) AS DONOR_ID FROM (SELECT *, first_value(PATIENT_ID) OVER (PARTITION BY END_DT ORDER BY h, PATIENT_ID) AS fst FROM (SELECT *, {H(repr('donor'), *_KEYS)} AS h FROM manifest))"


@query("l07_same_date_donors", "PATIENT_ID:s END_DT:d DONOR_ID:s", "manifest", _DONOR)
def l07(t):
    return rs.donors(t.manifest, "END_DT", "donor")


@query("l08_within_stratum_permutation", "PATIENT_ID:s END_DT:d P_RESP1:f PERMUTED:f", "scored", f"""SELECT a.PATIENT_ID, a.END_DT, a.P_RESP1, b.P_RESP1 AS PERMUTED FROM (SELECT *, row_number() OVER (PARTITION BY END_DT ORDER BY PATIENT_ID) AS r FROM scored) a JOIN (SELECT *, row_number() OVER (PARTITION BY END_DT ORDER BY {H(repr('perm'), *_KEYS)}, PATIENT_ID) AS r FROM scored) b
  ON a.END_DT = b.END_DT AND a.r = b.r""")
def l08(t):
    return rs.permute_within(t.scored, "END_DT", "perm", "P_RESP1")


@query("l09_apply_donor_trajectories", "FAMILY:s ROWS:i CHANGED:i", "manifest counts", f"""WITH d AS ({_DONOR}), f AS (SELECT PATIENT_ID, END_DT, FAMILY, string_agg(CATEGORY || ':' || VALUE || '@' || TIME_STEP, ',' ORDER BY CATEGORY, TIME_STEP) AS s FROM counts GROUP BY 1, 2, 3) SELECT x.fam AS FAMILY, count(*) AS ROWS, count(*) FILTER (a.s IS DISTINCT FROM b.s) AS CHANGED
  FROM (SELECT *, unnest(['RX', 'DX', 'PX']) AS fam FROM d) x LEFT JOIN f a ON a.PATIENT_ID = x.PATIENT_ID AND a.END_DT = x.END_DT AND a.FAMILY = fam LEFT JOIN f b ON b.PATIENT_ID = DONOR_ID AND b.END_DT = x.END_DT AND b.FAMILY = fam GROUP BY 1""")
def l09(t):
    pairs = rs.donors(t.manifest, "END_DT", "donor")
    # A trajectory is at most one cell per (category, step); cells are compared, never packed.
    own = t.counts.select(*KEY, "FAMILY", "CATEGORY", "TIME_STEP", F.col("VALUE").alias("a"))
    given = pairs.join(t.counts.withColumnRenamed("PATIENT_ID", "DONOR_ID").select("DONOR_ID", "END_DT", "FAMILY", "CATEGORY", "TIME_STEP", F.col("VALUE").alias("b")), ["DONOR_ID", "END_DT"])
    cells = own.join(given.drop("DONOR_ID"), [*KEY, "FAMILY", "CATEGORY", "TIME_STEP"], "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    changed = cells.select(*KEY, "FAMILY").distinct().groupBy("FAMILY").agg(F.count("*").alias("CHANGED"))
    names = t.rows([("RX",), ("DX",), ("PX",)], "FAMILY string").join(changed, "FAMILY", "left").fillna(0, ["CHANGED"])
    return attach(names, t.manifest.agg(F.count("*").alias("ROWS")), [])


@query("l10_panel_refresh", "PATIENT_ID:s END_DT:d SPLIT:s ORIGIN:s", "manifest", """SELECT PATIENT_ID, END_DT, SPLIT, CASE WHEN SPLIT = 'validation' THEN 'frozen' WHEN END_DT < DATE '1999-01-01' THEN 'kept' ELSE 'added' END AS ORIGIN FROM manifest WHERE SPLIT = 'train' OR (SPLIT = 'validation' AND END_DT < DATE '1999-01-01')""")
def l10(t):
    # The earlier panel ended in 1998: its validation rows stay exactly, TRAIN may only grow.
    old = t.manifest.filter("END_DT < '1999-01-01'")
    frozen = old.filter("SPLIT = 'validation'").select(*KEY, "SPLIT", F.lit("frozen").alias("ORIGIN"))
    seen = old.filter(TRAIN).select(*KEY, F.lit("kept").alias("o"))
    train = t.manifest.filter(TRAIN).select(*KEY, "SPLIT").join(seen, KEY, "left")
    train = train.join(frozen.select("PATIENT_ID").distinct(), "PATIENT_ID", "left_anti")
    return frozen.unionByName(train.select(*KEY, "SPLIT", F.coalesce("o", F.lit("added")).alias("ORIGIN")))


@query("l11_inner_split", "PATIENT_ID:s ATTEMPT:i SIDE:s", "manifest", f"""WITH x AS (SELECT PATIENT_ID, RESP, a AS ATTEMPT, CASE WHEN row_number() OVER (PARTITION BY a ORDER BY {H(repr('inner'), 'CAST(a AS VARCHAR)', 'PATIENT_ID')}, PATIENT_ID) <= ceil(count(*) OVER (PARTITION BY a) * 20 / 100.0) THEN 'inner_validation' ELSE 'inner_train' END AS SIDE FROM ({_TSTRATA}), (SELECT unnest(range(100)) AS a))
  SELECT PATIENT_ID, ATTEMPT, SIDE FROM x WHERE ATTEMPT = (SELECT min(ATTEMPT) FROM (SELECT ATTEMPT FROM (SELECT ATTEMPT, SIDE, min(RESP) < max(RESP) AS ok FROM x GROUP BY 1, 2) WHERE ok GROUP BY 1 HAVING count(*) = 2))""")
def l11(t):
    return rs.inner_split(strata(t.manifest.filter(TRAIN)), 20, "inner")


_DRAWS_T = _draw_sql("SELECT * FROM manifest WHERE SPLIT = 'test'", "boot")
# Draw -1 is the data itself: every entity once.
_DRAWS_T = f"(SELECT * FROM {_DRAWS_T} UNION ALL SELECT DISTINCT -1 AS DRAW, PATIENT_ID, 1 AS M FROM manifest WHERE SPLIT = 'test')"
_BOOT = f"""(WITH dr AS {_DRAWS_T}, r AS (SELECT d.DRAW, s.MODEL, s.RESP, M, coalesce(sum(M) OVER (PARTITION BY d.DRAW, s.MODEL ORDER BY SCORE DESC, s.PATIENT_ID, END_DT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf, sum(M) OVER (PARTITION BY d.DRAW, s.MODEL) AS N, sum(M * RESP) OVER (PARTITION BY d.DRAW, s.MODEL) AS P
  FROM ({_TESTROWS}) s JOIN dr d ON d.PATIENT_ID = s.PATIENT_ID), k AS (SELECT *, unnest([10, 20, 30]) AS PERCENT FROM r), g AS (SELECT *, greatest(1, (N * PERCENT + 99) // 100) AS K FROM k)
  SELECT DRAW, MODEL, PERCENT, K, N, P, sum(least(M, greatest(K - bf, 0)) * RESP) AS CAPTURED, CASE WHEN P > 0 AND P < N THEN sum(least(M, greatest(K - bf, 0)) * RESP) / K / (P / N) END AS LIFT FROM g GROUP BY DRAW, MODEL, PERCENT, K, N, P)"""


def weights(t):
    return settle(rs.cluster_weights(t.manifest.filter(TEST), DRAWS, "boot"))


def lifts(t):
    return rs.bootstrap_lifts(t.model_scores.filter(TEST), weights(t), DRAWS, [10, 20, 30])


@query("k15_paired_lift_draws", "DRAW:i MODEL:s PERCENT:i K:i CAPTURED:i LIFT:f", "manifest model_scores", f"SELECT * FROM {_BOOT}")
def k15(t):
    return lifts(t)


_IV = f"""SELECT {{by}}, max(d) FILTER (DRAW = -1) AS DELTA, count(d) FILTER (DRAW >= 0) AS VALID_DRAWS, count(d) FILTER (DRAW >= 0) >= {LEAST} AS RELIABLE, CASE WHEN count(d) FILTER (DRAW >= 0) >= {LEAST} THEN quantile_cont(d, 0.025) FILTER (DRAW >= 0) END AS LOWER, CASE WHEN count(d) FILTER (DRAW >= 0) >= {LEAST} THEN quantile_cont(d, 0.975) FILTER (DRAW >= 0) END AS UPPER,
  CASE WHEN count(d) FILTER (DRAW >= 0) < {LEAST} THEN 'unreliable' WHEN quantile_cont(d, 0.025) FILTER (DRAW >= 0) > 0 THEN 'above' WHEN quantile_cont(d, 0.975) FILTER (DRAW >= 0) < 0 THEN 'below' ELSE 'includes_zero' END AS INTERVAL_SIGN FROM ({{src}}) GROUP BY {{by}}"""
_IVC = "DELTA:f VALID_DRAWS:i RELIABLE:b LOWER:f UPPER:f INTERVAL_SIGN:s"


def paired(table, by, value, a, b):
    """Per-draw difference of two models, null when either is undefined."""
    at = lambda m: F.max(F.when(F.col("MODEL") == m, F.col(value)))
    return table.groupBy(*by).agg((at(a) - at(b)).alias("d"))


@query("k15_paired_lift_intervals", "PERCENT:i " + _IVC, "manifest model_scores", _IV.format(by="PERCENT", src=f"SELECT DRAW, PERCENT, max(LIFT) FILTER (MODEL = 'alpha') - max(LIFT) FILTER (MODEL = 'gamma') AS d FROM {_BOOT} GROUP BY 1, 2"))
def k15b(t):
    return rs.intervals(paired(lifts(t), ["DRAW", "PERCENT"], "LIFT", "alpha", "gamma"), "d", ["PERCENT"], DRAWS)


_BCURVE = f"""(WITH dr AS {_DRAWS_T}, c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER g AS tp, sum(n) OVER g AS tn FROM (SELECT DRAW, MODEL, SCORE AS s, sum(M * RESP) AS p, sum(M * (1 - RESP)) AS n FROM ({_TESTROWS}) s JOIN dr d ON d.PATIENT_ID = s.PATIENT_ID GROUP BY 1, 2, 3) WINDOW w AS (PARTITION BY DRAW, MODEL ORDER BY s DESC), g AS (PARTITION BY DRAW, MODEL))
  SELECT DRAW, MODEL, sum(p / tp * cp / (cp + cn)) AS AP, sum(n * (cp - p / 2)) / (max(tp) * max(tn)) AS AUC FROM c GROUP BY 1, 2)"""


@query("k16_paired_curve_intervals", "METRIC:s " + _IVC, "manifest model_scores", _IV.format(by="METRIC", src=f"SELECT 'AP' AS METRIC, DRAW, max(AP) FILTER (MODEL = 'alpha') - max(AP) FILTER (MODEL = 'beta') AS d FROM {_BCURVE} GROUP BY 2 UNION ALL SELECT 'AUC', DRAW, max(AUC) FILTER (MODEL = 'alpha') - max(AUC) FILTER (MODEL = 'beta') FROM {_BCURVE} GROUP BY 2"))
def k16(t):
    m = rs.bootstrap_curves(t.model_scores.filter(TEST), weights(t), DRAWS)
    tall = m.select("DRAW", "MODEL", F.inline(F.array(F.struct(F.lit("AP").alias("METRIC"), F.col("AP").alias("v")), F.struct(F.lit("AUC").alias("METRIC"), F.col("AUC").alias("v")))))
    return rs.intervals(paired(tall, ["DRAW", "METRIC"], "v", "alpha", "beta"), "d", ["METRIC"], DRAWS)


@query("k17_interval_reliability", "PERCENT:i REQUESTED:i VALID_DRAWS:i SINGLE_CLASS:i RELIABLE:b INTERVAL_SIGN:s", "manifest model_scores", f"SELECT *, {DRAWS} - VALID_DRAWS AS SINGLE_CLASS, {DRAWS} AS REQUESTED FROM (" + _IV.format(by="PERCENT", src=f"SELECT DRAW, PERCENT, max(LIFT) FILTER (MODEL = 'beta') - max(LIFT) FILTER (MODEL = 'alpha') AS d FROM {_BOOT} GROUP BY 1, 2") + ")")
def k17(t):
    iv = rs.intervals(paired(lifts(t), ["DRAW", "PERCENT"], "LIFT", "beta", "alpha"), "d", ["PERCENT"], DRAWS)
    return iv.select("*", F.lit(DRAWS).alias("REQUESTED"), (DRAWS - F.col("VALID_DRAWS")).alias("SINGLE_CLASS"))


_PROBE = f"""SELECT a.PATIENT_ID, a.END_DT, a.RESP, p AS PROBE, r AS REPEAT, p || '/' || r AS PR, a.SCORE AS BASE, CASE WHEN r < 3 AND {H('p', 'CAST(r AS VARCHAR)', 'a.PATIENT_ID', 'CAST(a.END_DT AS VARCHAR)')} % 4 < CASE p WHEN 'rx' THEN 1 WHEN 'dx' THEN 2 ELSE 3 END THEN b.SCORE ELSE a.SCORE END AS s FROM (SELECT * FROM ({_TESTROWS}) WHERE MODEL = 'alpha') a
  JOIN (SELECT * FROM ({_TESTROWS}) WHERE MODEL = 'gamma') b ON a.PATIENT_ID = b.PATIENT_ID AND a.END_DT = b.END_DT, (SELECT unnest(['rx', 'dx', 'px']) AS p), (SELECT unnest(range(4)) AS r)"""


@query("k21_permutation_reliance", "PROBE:s MEAN_AP_DROP:f SD_AP_DROP:f MEAN_LIFT_DROP:f CHANGED_FRACTION:f REPEATS:i", "model_scores", f"""WITH x AS ({_PROBE}), c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY PR) AS tp FROM (SELECT PR, s, sum(RESP) AS p, sum(1 - RESP) AS n FROM x GROUP BY 1, 2) WINDOW w AS (PARTITION BY PR ORDER BY s DESC)),
  ap AS (SELECT PR, sum(p / tp * cp / (cp + cn)) AS AP FROM c GROUP BY 1), lf AS (SELECT PR, sum(CASE WHEN rk <= k THEN RESP ELSE 0 END) / k / (P / N) AS LIFT FROM (SELECT *, greatest(1, (N * 10 + 99) // 100) AS k FROM (SELECT *, row_number() OVER (PARTITION BY PR ORDER BY s DESC, PATIENT_ID, END_DT) AS rk, count(*) OVER (PARTITION BY PR) AS N, sum(RESP) OVER (PARTITION BY PR) AS P FROM x)) GROUP BY PR, k, P, N),
  ch AS (SELECT PR, PROBE, REPEAT, avg(CASE WHEN s <> BASE THEN 1.0 ELSE 0.0 END) AS ch FROM x GROUP BY 1, 2, 3), al AS (SELECT PROBE, REPEAT, AP, LIFT, ch FROM ch JOIN ap ON ap.PR = ch.PR JOIN lf ON lf.PR = ch.PR)
  SELECT a.PROBE, avg(b.AP - a.AP) AS MEAN_AP_DROP, stddev_samp(b.AP - a.AP) AS SD_AP_DROP, avg(b.LIFT - a.LIFT) AS MEAN_LIFT_DROP, avg(a.ch) AS CHANGED_FRACTION, count(*) AS REPEATS FROM al a JOIN al b ON b.PROBE = a.PROBE AND b.REPEAT = 3 WHERE a.REPEAT < 3 GROUP BY 1""")
def k21(t):
    # Score tables keyed by (probe, repeat): the last repeat of each probe is the unpermuted baseline.
    at = lambda m: F.max(F.when(F.col("MODEL") == m, F.col("SCORE")))
    pair = t.model_scores.filter(TEST).groupBy(*KEY, "RESP").agg(at("alpha").alias("BASE"), at("gamma").alias("ALT"))
    rows = pair.withColumn("PROBE", F.explode(F.array(*[F.lit(p) for p in ("rx", "dx", "px")]))).withColumn("REPEAT", F.explode(F.sequence(F.lit(0), F.lit(3))))
    from tidemark.functions.scalar import hash_int
    h = F.pmod(hash_int(F.concat_ws("|", "PROBE", "REPEAT", "PATIENT_ID", F.col("END_DT").cast("string"))), F.lit(4))
    cut = F.when(F.col("PROBE") == "rx", 1).when(F.col("PROBE") == "dx", 2).otherwise(3)
    rows = rows.withColumn("s", F.when((F.col("REPEAT") < 3) & (h < cut), F.col("ALT")).otherwise(F.col("BASE")))
    g = ("PROBE", "REPEAT")
    ap = evl.curve_metrics(evl.curve(rows, "s", groups=g), g).select(*g, "AP")
    lift = evl.top_share(rows, "s", [10], keys(), groups=g).select(*g, "LIFT")
    change = rows.groupBy(*g).agg(F.avg((F.col("s") != F.col("BASE")).cast("double")).alias("ch"))
    a = ap.join(lift, list(g)).join(change, list(g))
    base = a.filter("REPEAT = 3").select("PROBE", F.col("AP").alias("ap0"), F.col("LIFT").alias("l0"))
    j = a.filter("REPEAT < 3").join(base, "PROBE").withColumn("d", F.col("ap0") - F.col("AP")).withColumn("e", F.col("l0") - F.col("LIFT"))
    return j.groupBy("PROBE").agg(F.avg("d").alias("MEAN_AP_DROP"), F.stddev_samp("d").alias("SD_AP_DROP"), F.avg("e").alias("MEAN_LIFT_DROP"), F.avg("ch").alias("CHANGED_FRACTION"), F.count("*").alias("REPEATS"))


_SEED_RANKS = """SELECT k.CATEGORY, SEED, rank() OVER (PARTITION BY SEED ORDER BY n DESC) + (count(*) OVER (PARTITION BY SEED, n) - 1) / 2.0 AS INTERNAL_RANK, rank() OVER (PARTITION BY SEED ORDER BY tot DESC) + (count(*) OVER (PARTITION BY SEED, tot) - 1) / 2.0 AS TRAIN_RANK,
  row_number() OVER (PARTITION BY SEED ORDER BY n DESC, k.CATEGORY) AS pi, row_number() OVER (PARTITION BY SEED ORDER BY tot DESC, k.CATEGORY) AS pt FROM (SELECT CATEGORY, TIME_STEP % 3 AS SEED, sum(VALUE) AS n FROM counts GROUP BY 1, 2) k JOIN (SELECT CATEGORY, sum(VALUE) AS tot FROM counts GROUP BY 1) z ON z.CATEGORY = k.CATEGORY"""


def seed_ranks(t):
    """Feature ranks by importance per seed next to the overall training rank; one row per (feature, seed)."""
    per = t.counts.groupBy("CATEGORY", (F.col("TIME_STEP") % 3).alias("SEED")).agg(F.sum("VALUE").alias("n"))
    j = per.join(per.groupBy("CATEGORY").agg(F.sum("n").alias("tot")), "CATEGORY")
    mid = lambda c: F.rank().over(W.partitionBy("SEED").orderBy(F.desc(c))) + (F.count("*").over(W.partitionBy("SEED", c)) - 1) / 2
    pos = lambda c: F.row_number().over(W.partitionBy("SEED").orderBy(F.desc(c), "CATEGORY"))
    return j.select("CATEGORY", "SEED", mid("n").alias("INTERNAL_RANK"), mid("tot").alias("TRAIN_RANK"), pos("n").alias("pi"), pos("tot").alias("pt"))


@query("k22_rank_importance_agreement", "SEED:i FEATURES:i TOP_OVERLAP:i SPEARMAN:f", "counts", f"SELECT SEED, count(*) AS FEATURES, count(*) FILTER (pi <= 10 AND pt <= 10) AS TOP_OVERLAP, corr(INTERNAL_RANK, TRAIN_RANK) AS SPEARMAN FROM ({_SEED_RANKS}) GROUP BY 1")
def k22(t):
    return seed_ranks(t).groupBy("SEED").agg(F.count("*").alias("FEATURES"), F.count_if((F.col("pi") <= 10) & (F.col("pt") <= 10)).alias("TOP_OVERLAP"), F.corr("INTERNAL_RANK", "TRAIN_RANK").alias("SPEARMAN"))


@query("k23_probe_plan", "KIND:s PROBE:s FEATURE:s", "counts", f"""WITH f AS (SELECT CATEGORY AS FEATURE, row_number() OVER (ORDER BY sum(VALUE) DESC, CATEGORY) AS r, count(*) OVER () AS n FROM counts GROUP BY 1), s AS (SELECT *, r <= 5 AS top, r > n - 3 AS low FROM f),
  q AS (SELECT *, row_number() OVER (ORDER BY {H(repr('probe'), 'FEATURE')}, FEATURE) AS hr FROM s WHERE NOT top AND NOT low)
  SELECT 'feature' AS KIND, 'top_train_rank' AS PROBE, FEATURE FROM s WHERE top UNION ALL SELECT 'feature', 'lowest_train_rank', FEATURE FROM s WHERE low UNION ALL SELECT 'feature', 'random_remaining', FEATURE FROM q WHERE hr <= 4
  UNION ALL SELECT 'family', substr(FEATURE, 1, 2), FEATURE FROM s UNION ALL SELECT 'tercile', CASE WHEN r <= (n // 3) + CASE WHEN n % 3 > 0 THEN 1 ELSE 0 END THEN 'top' WHEN r <= 2 * (n // 3) + least(n % 3, 2) THEN 'middle' ELSE 'bottom' END, FEATURE FROM s""")
def k23(t):
    f = t.counts.groupBy(F.col("CATEGORY").alias("FEATURE")).agg(F.sum("VALUE").alias("v"))
    f = f.select("FEATURE", F.row_number().over(W.orderBy(F.desc("v"), "FEATURE")).alias("r"), F.count("*").over(W.partitionBy(F.lit(1))).alias("n"))
    r, n = F.col("r"), F.col("n")
    role = F.when(r <= 5, "top_train_rank").when(r > n - 3, "lowest_train_rank")
    rest = F.row_number().over(W.partitionBy("PROBE").orderBy(rs.seeded_hash("probe", "FEATURE"), "FEATURE"))
    single = f.withColumn("PROBE", F.coalesce(role, F.lit("random_remaining"))).withColumn("h", rest).filter("PROBE <> 'random_remaining' OR h <= 4")
    # Three parts differ in size by at most one, the larger ones first.
    third, extra = F.floor(n / 3), n % 3
    part = F.when(r <= third + F.least(extra, F.lit(1)), "top").when(r <= 2 * third + F.least(extra, F.lit(2)), "middle").otherwise("bottom")
    pick = lambda kind, df: df.select(F.lit(kind).alias("KIND"), "PROBE", "FEATURE")
    return (pick("feature", single).unionByName(pick("family", f.withColumn("PROBE", F.substring("FEATURE", 1, 2))))
            .unionByName(pick("tercile", f.withColumn("PROBE", part))))
