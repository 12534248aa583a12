"""Section N: fingerprints, change checks and the experiment ledger."""

from pyspark.sql import Window as W, functions as F

from tidemark.operators import evaluation as evl, lineage as ln
from tidemark.plans.ranking import _AP, _WCURVE, keys, top_sql
from tidemark.plans.registry import hash_sql, query, row_sql

KEY = ["PATIENT_ID", "END_DT"]


@query("n01_relation_hash", "FAMILY:s ROWS:i HASH:s", "code_map", f"""SELECT FAMILY, count(*) AS ROWS, {hash_sql('h')} AS HASH
  FROM (SELECT FAMILY, {row_sql('FAMILY', 'CODE', 'CATEGORY')} AS h FROM code_map) GROUP BY 1""")
def n01(t):
    return ln.relation_hash(t.code_map.select("FAMILY", "CODE", "CATEGORY"), "FAMILY")


_DIGEST = """SELECT sum(n) AS ROWS, sha256(string_agg(h, chr(10) ORDER BY c)) AS DIGEST FROM (SELECT substr(b, 1, 3) AS c, sha256(string_agg(h, chr(10) ORDER BY b)) AS h, sum(n) AS n FROM (
  SELECT substr(sha256(l), 1, 6) AS b, sha256(string_agg(l, chr(10) ORDER BY l)) AS h, count(*) AS n FROM ({0}) GROUP BY 1) GROUP BY 1)"""
_LINES = """SELECT PATIENT_ID || '|' || CAST(END_DT AS VARCHAR) || '|' || RESP AS l FROM snapshots"""


def line_digest(df, *cols):
    return ln.digest(df, F.concat_ws("|", *[F.col(c).cast("string") for c in cols]))


@query("n02_ordered_digest", "ROWS:i DIGEST:s", "snapshots", _DIGEST.format(_LINES))
def n02(t):
    return line_digest(t.snapshots, *KEY, "RESP")


@query("n03_train_scope_fingerprint", "ROWS:i DIGEST:s", "manifest", _DIGEST.format("SELECT DISTINCT PATIENT_ID AS l FROM manifest WHERE SPLIT = 'train'"))
def n03(t):
    return line_digest(t.manifest.filter("SPLIT = 'train'").select("PATIENT_ID").distinct(), "PATIENT_ID")


@query("n04_mutation_check", "LOST:i GAINED:i", "code_map", """SELECT (SELECT count(*) FROM code_map WHERE FAMILY = 'PX') AS LOST, (SELECT count(*) FROM code_map WHERE FAMILY = 'PX') AS GAINED""")
def n04(t):
    after = t.code_map.withColumn("CATEGORY", F.when(F.col("FAMILY") == "PX", F.lower("CATEGORY")).otherwise(F.col("CATEGORY")))
    return ln.changed_rows(t.code_map, after)


_LEDGER = top_sql("(SELECT *, MODEL || '/' || SPLIT AS g FROM model_scores)", "SCORE", "PATIENT_ID, END_DT", (10,), "g")


@query("n06_experiment_ledger", "BLOCK:s MODEL:s LIFT:f CONSISTENT:b DELTA_LIFT:f ADDITIONAL_CAPTURES:i", "model_scores", f"""WITH x AS (SELECT split_part(g, '/', 1) AS MODEL, split_part(g, '/', 2) AS BLOCK, LIFT, CAPTURED FROM ({_LEDGER}))
  SELECT x.BLOCK, x.MODEL, x.LIFT, x.MODEL <> 'beta' AS CONSISTENT, x.LIFT - b.LIFT AS DELTA_LIFT, x.CAPTURED - b.CAPTURED AS ADDITIONAL_CAPTURES FROM x JOIN x b ON b.BLOCK = x.BLOCK AND b.MODEL = 'gamma'""")
def n06(t):
    lifts = evl.top_share(t.model_scores, "SCORE", [10], keys(), groups=("MODEL", "SPLIT"))
    reported = F.col("LIFT") + F.when(F.col("MODEL") == "beta", 0.5).otherwise(0.0)
    return ln.ledger(lifts.select(F.col("SPLIT").alias("BLOCK"), "MODEL", (F.col("MODEL") == "gamma").alias("IS_BASELINE"), "ROWS", "POSITIVES", "SELECTED", "CAPTURED", reported.alias("REPORTED_LIFT")))


@query("n07_comparable_groups", "PLAN_ID:s VISIT_TYPE:s VERSION:i LINES:i CHANGE:i", "mx", """SELECT PLAN_ID, VISIT_TYPE, VERSION, LINES, LINES - lag(LINES) OVER (PARTITION BY PLAN_ID, VISIT_TYPE ORDER BY VERSION) AS CHANGE FROM (SELECT *, count(*) OVER (PARTITION BY PLAN_ID, VISIT_TYPE) AS c FROM (
  SELECT PLAN_ID, VISIT_TYPE, year(SERVICE_DATE) AS VERSION, count(*) AS LINES FROM mx WHERE NOT (PLAN_ID = '1-URGENT' AND year(SERVICE_DATE) > 1995) GROUP BY 1, 2, 3)) WHERE c >= 2""")
def n07(t):
    # One row per version of a comparison group; groups with a single version are not comparable.
    rows = t.mx.filter(~((F.col("PLAN_ID") == "1-URGENT") & (F.year("SERVICE_DATE") > 1995)))
    v = rows.groupBy("PLAN_ID", "VISIT_TYPE", F.year("SERVICE_DATE").alias("VERSION")).agg(F.count("*").alias("LINES"))
    many = v.groupBy("PLAN_ID", "VISIT_TYPE").agg(F.count("*").alias("c")).filter("c >= 2").drop("c")
    w = W.partitionBy("PLAN_ID", "VISIT_TYPE").orderBy("VERSION")
    return v.join(many, ["PLAN_ID", "VISIT_TYPE"]).withColumn("CHANGE", F.col("LINES") - F.lag("LINES").over(w))


@query("n08_run_comparison", "POSITION:i MODEL:s METRIC:s VALUE:f", "model_scores", f"""WITH a AS (SELECT MODEL, {_AP} AS ap FROM ({_WCURVE.replace('FROM model_scores)', "FROM model_scores WHERE SPLIT = 'validation')")}) GROUP BY 1), b AS (SELECT MODEL, avg((SCORE - RESP) * (SCORE - RESP)) AS br FROM model_scores WHERE SPLIT = 'validation' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY ap DESC, MODEL) AS POSITION FROM a JOIN b USING (MODEL))
  SELECT POSITION, MODEL, 'AP' AS METRIC, ap AS VALUE FROM r UNION ALL SELECT POSITION, MODEL, 'BRIER', br FROM r""")
def n08(t):
    from tidemark.operators.association import entity_weights
    rows = t.model_scores.filter("SPLIT = 'validation'").join(entity_weights(t.manifest.filter("SPLIT = 'validation'")).select(*KEY, "ENTITY_SHARE"), KEY)
    ap = evl.curve_metrics(evl.curve(rows, "SCORE", weight=F.col("ENTITY_SHARE"), groups=("MODEL",)), ("MODEL",)).select("MODEL", "AP")
    runs = ap.join(evl.probability_losses(rows, "SCORE", groups=("MODEL",)), "MODEL")
    saved = runs.select("MODEL", F.col("AP").alias("k"), F.array(F.struct(F.lit("AP").alias("METRIC"), F.col("AP").alias("VALUE")), F.struct(F.lit("BRIER").alias("METRIC"), F.col("BRIER").alias("VALUE"))).alias("metrics"))
    order = F.row_number().over(W.orderBy(F.desc("k"), "MODEL"))
    return saved.withColumn("POSITION", order).select("POSITION", "MODEL", F.inline("metrics"))


@query("n09_metrics_to_tall", "ROW_ID:i SPLIT:s METRIC:s VALUE:f", "dirty", """SELECT ROW_ID, lower(trim(SPLIT_TXT)) AS SPLIT, METRIC, v AS VALUE FROM (SELECT ROW_ID, SPLIT_TXT, unnest(['num', 'birth', 'resp']) AS METRIC, try_cast(unnest([NUM_TXT, BIRTH_TXT, RESP_TXT]) AS DOUBLE) AS v FROM dirty) WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v)""")
def n09(t):
    tall = t.dirty.select("ROW_ID", F.lower(F.trim("SPLIT_TXT")).alias("SPLIT"), F.col("NUM_TXT").alias("num"), F.col("BIRTH_TXT").alias("birth"), F.col("RESP_TXT").alias("resp")).unpivot(
        ["ROW_ID", "SPLIT"], ["num", "birth", "resp"], "METRIC", "TEXT")
    v = F.col("TEXT").try_cast("double")
    return tall.withColumn("VALUE", v).filter(F.col("VALUE").isNotNull() & ~F.isnan("VALUE") & (F.abs("VALUE") < float("inf")))
