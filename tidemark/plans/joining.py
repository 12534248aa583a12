"""Sections C and G: joins and set operations."""

from pyspark.sql import functions as F

from tidemark.functions.calendar import count_window_start, recent_window
from tidemark.functions.scalar import hash_int, total
from tidemark.operators import cohort as co, contracts as ct, events as ev, evaluation as evl, features as ft, ordering as od, sequences as sq
from tidemark.operators.ordering import attach
from tidemark.plans.aggregates import COVER_SQL, DECISION_SQL, covered, decisions
from tidemark.plans.ranking import TEST, keys
from tidemark.plans.registry import hash_sql, query, row_sql

KEY = ["PATIENT_ID", "END_DT"]
_STEP = "(year(s.END_DT) - year({d})) * 12 + month(s.END_DT) - month({d})"
_WINDOW = "FILL_DATE <= s.END_DT AND FILL_DATE >= date_trunc('month', s.END_DT) - INTERVAL 11 MONTH"


@query("c01_code_category_join", "PATIENT_ID:s CATEGORY:s N:i", "rx code_map", """SELECT PATIENT_ID, CATEGORY, count(*) AS N FROM rx JOIN code_map ON FAMILY = 'RX' AND CODE = NDC11 GROUP BY 1, 2""")
def c01(t):
    days = t.rx.groupBy("PATIENT_ID", F.lit("RX").alias("FAMILY"), F.col("NDC11").alias("CODE")).agg(F.count("*").alias("n"))
    return ev.map_codes(days, t.code_map).groupBy("PATIENT_ID", "CATEGORY").agg(F.sum("n").alias("N"))


@query("c02_dimension_left_join", "n_name:s RESULT:s N:i UNKNOWN:i", "rx", """SELECT n_name, RESULT, count(*) AS N, count(*) FILTER (s_suppkey IS NULL) AS UNKNOWN FROM rx
  LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) ON CAST(s_suppkey AS VARCHAR) = PRESCRIBER_NPI LEFT JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""")
def c02(t):
    s = t.supplier.filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").cast("string").alias("PRESCRIBER_NPI"), "s_nationkey", F.lit(1).alias("_k"))
    rows = t.rx.groupBy("PRESCRIBER_NPI", "RESULT").agg(F.count("*").alias("c"))
    j = rows.join(s, "PRESCRIBER_NPI", "left").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return j.groupBy("n_name", "RESULT").agg(F.sum("c").alias("N"), F.sum(F.when(F.col("_k").isNull(), F.col("c")).otherwise(0)).alias("UNKNOWN"))


@query("c03_asof_window_join", "PATIENT_ID:s END_DT:d FILL_DATE:d NDC11:s N:i", "snapshots rx", f"""SELECT s.PATIENT_ID, s.END_DT, FILL_DATE, NDC11, count(*) AS N FROM snapshots s JOIN rx r
  ON r.PATIENT_ID = s.PATIENT_ID AND {_WINDOW} GROUP BY 1, 2, 3, 4""")
def c03(t):
    days = t.rx.groupBy("PATIENT_ID", "FILL_DATE", "NDC11").agg(F.count("*").alias("N"))
    return ev.asof_join(t.snapshots.select(*KEY), days, "FILL_DATE")


@query("c04_entity_bounds_prune", "PATIENT_ID:s FILL_DATE:d EVENT_ID:s", "snapshots rx", """SELECT r.PATIENT_ID, FILL_DATE, EVENT_ID FROM rx r JOIN (SELECT PATIENT_ID, min(date_trunc('month', END_DT) - INTERVAL 11 MONTH) AS a, max(END_DT) AS b
  FROM snapshots GROUP BY 1) k ON k.PATIENT_ID = r.PATIENT_ID AND FILL_DATE BETWEEN a AND b""")
def c04(t):
    return ev.prune_by_bounds(t.rx, ev.entity_bounds(t.snapshots), "FILL_DATE").select("PATIENT_ID", "FILL_DATE", "EVENT_ID")


@query("c05_global_bounds_prune", "PATIENT_ID:s SERVICE_DATE:d EVENT_ID:s", "snapshots mx", """SELECT PATIENT_ID, SERVICE_DATE, EVENT_ID FROM mx WHERE SERVICE_DATE BETWEEN
  (SELECT min(date_trunc('month', END_DT) - INTERVAL 11 MONTH) FROM snapshots) AND (SELECT max(END_DT) FROM snapshots)""")
def c05(t):
    return ev.prune_by_global_bounds(t.mx, t.snapshots, "SERVICE_DATE").select("PATIENT_ID", "SERVICE_DATE", "EVENT_ID")


@query("c06_interval_overlap", "PATIENT_ID:s END_DT:d TIME_STEP:i PERIOD_START:d PERIOD_END:d COVERED:b", "snapshots enrollment", COVER_SQL)
def c06(t):
    return covered(t)


@query("c07_forward_horizon", "PATIENT_ID:s END_DT:d", "snapshots mx", "SELECT DISTINCT s.PATIENT_ID, s.END_DT FROM snapshots s JOIN mx m ON m.PATIENT_ID = s.PATIENT_ID AND SERVICE_DATE > END_DT AND SERVICE_DATE <= END_DT + 90")
def c07(t):
    return ev.with_followup(t.snapshots, t.mx, "SERVICE_DATE")


@query("c08_one_row_bounds", "PATIENT_ID:s END_DT:d MAX_END:d DAYS_BEFORE:i", "snapshots", "SELECT PATIENT_ID, END_DT, m AS MAX_END, m - END_DT AS DAYS_BEFORE FROM snapshots, (SELECT max(END_DT) AS m FROM snapshots)")
def c08(t):
    return attach(t.snapshots, t.snapshots.agg(F.max("END_DT").alias("MAX_END")), []).withColumn("DAYS_BEFORE", F.datediff("MAX_END", "END_DT"))


@query("c09_step_spine", "PATIENT_ID:s END_DT:d TIME_STEP:i", "snapshots", "SELECT PATIENT_ID, END_DT, unnest(range(12)) AS TIME_STEP FROM snapshots")
def c09(t):
    return ft.spine(t.snapshots.select(*KEY))


@query("c10_spine_zero_fill", "PATIENT_ID:s END_DT:d TIME_STEP:i VALUE:i", "snapshots counts", """SELECT s.PATIENT_ID, s.END_DT, i AS TIME_STEP, coalesce(n, 0) AS VALUE FROM (SELECT *, unnest(range(12)) AS i FROM snapshots) s
  LEFT JOIN (SELECT PATIENT_ID, END_DT, TIME_STEP, sum(VALUE) AS n FROM counts GROUP BY 1, 2, 3) c ON c.PATIENT_ID = s.PATIENT_ID AND c.END_DT = s.END_DT AND c.TIME_STEP = i""")
def c10(t):
    return ft.filled_spine(t.snapshots, t.counts)


@query("c11_unknown_snapshots", "PATIENT_ID:s END_DT:d CATEGORY:s VALUE:i", "counts snapshots", """SELECT PATIENT_ID, END_DT, CATEGORY, sum(VALUE) AS VALUE FROM counts c WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.RESP = 0 AND s.PATIENT_ID = c.PATIENT_ID AND s.END_DT = c.END_DT) GROUP BY 1, 2, 3""")
def c11(t):
    return t.counts.join(t.snapshots.filter("RESP = 0"), KEY, "left_anti").groupBy(*KEY, "CATEGORY").agg(F.sum("VALUE").alias("VALUE"))


_PRIOR = """SELECT PATIENT_ID, CASE WHEN CAST(PATIENT_ID AS BIGINT) % 19 = 0 THEN END_DT + 1 ELSE END_DT END AS END_DT, CASE WHEN CAST(PATIENT_ID AS BIGINT) % 13 = 0 THEN 1 - RESP ELSE RESP END AS RESP
  FROM snapshots WHERE CAST(PATIENT_ID AS BIGINT) % 11 <> 0"""


def prior(t):
    """An earlier state of the population: some entities missing, some keys moved, some labels flipped."""
    k = F.col("PATIENT_ID").cast("long")
    return t.snapshots.filter(k % 11 != 0).select(
        "PATIENT_ID", F.when(k % 19 == 0, F.date_add("END_DT", 1)).otherwise(F.col("END_DT")).alias("END_DT"),
        F.when(k % 13 == 0, 1 - F.col("RESP")).otherwise(F.col("RESP")).alias("RESP"))


@query("c12_exact_coverage_join", "PATIENT_ID:s END_DT:d RESP:i SCORE:f STATUS:s", "snapshots model_scores", f"""SELECT coalesce(p.PATIENT_ID, m.PATIENT_ID) AS PATIENT_ID, coalesce(p.END_DT, m.END_DT) AS END_DT, p.RESP, SCORE,
  CASE WHEN m.PATIENT_ID IS NULL THEN 'missing' WHEN p.PATIENT_ID IS NULL THEN 'extra' ELSE 'matched' END AS STATUS FROM ({_PRIOR}) p FULL JOIN (SELECT * FROM model_scores WHERE MODEL = 'alpha') m ON m.PATIENT_ID = p.PATIENT_ID AND m.END_DT = p.END_DT""")
def c12(t):
    return ct.exact_join(prior(t), t.model_scores.filter("MODEL = 'alpha'").select(*KEY, "SCORE"), KEY)


@query("c13_key_label_audit", "MATCHED:i MISSING:i EXTRA:i LABEL_MISMATCH:i DUPLICATE_LEFT:i DUPLICATE_RIGHT:i BAD_LABEL:i", "snapshots", f"""SELECT count(*) FILTER (a.PATIENT_ID IS NOT NULL AND b.PATIENT_ID IS NOT NULL) AS MATCHED,
  count(*) FILTER (b.PATIENT_ID IS NULL) AS MISSING, count(*) FILTER (a.PATIENT_ID IS NULL) AS EXTRA, count(*) FILTER (a.RESP IS DISTINCT FROM b.RESP AND a.PATIENT_ID IS NOT NULL AND b.PATIENT_ID IS NOT NULL) AS LABEL_MISMATCH,
  0 AS DUPLICATE_LEFT, 0 AS DUPLICATE_RIGHT, 0 AS BAD_LABEL FROM snapshots a FULL JOIN ({_PRIOR}) b ON a.PATIENT_ID = b.PATIENT_ID AND a.END_DT = b.END_DT""")
def c13(t):
    return ct.key_alignment(t.snapshots, prior(t), KEY, "RESP")


@query("c14_tensor_key_audit", "STATUS:s SNAPSHOTS:i", "snapshots counts", """SELECT CASE WHEN n IS NULL THEN 'no_rows' WHEN n < 12 THEN 'incomplete' ELSE 'complete' END AS STATUS, count(*) AS SNAPSHOTS FROM snapshots s
  LEFT JOIN (SELECT PATIENT_ID, END_DT, count(DISTINCT TIME_STEP) AS n FROM counts GROUP BY 1, 2) c ON c.PATIENT_ID = s.PATIENT_ID AND c.END_DT = s.END_DT GROUP BY 1""")
def c14(t):
    steps = t.counts.select(*KEY, "TIME_STEP").distinct().groupBy(*KEY).agg(F.count("*").alias("n"), F.max("TIME_STEP").alias("hi"))
    j = t.snapshots.select(*KEY, F.lit(1).alias("_s")).join(steps, KEY, "full")
    status = (F.when(F.col("_s").isNull(), "unknown_snapshot").when(F.col("n").isNull(), "no_rows").when(F.col("n") < 12, "incomplete").otherwise("complete"))
    return j.groupBy(status.alias("STATUS")).agg(F.count("*").alias("SNAPSHOTS"))


@query("c15_population_diff", "SPLIT:s CHANGE:s ROWS:i HASH:s", "snapshots manifest", f"""SELECT SPLIT, CHANGE, count(*) AS ROWS, {hash_sql('h')} AS HASH FROM (SELECT SPLIT, CHANGE, {row_sql('SPLIT', 'CHANGE', 'PATIENT_ID', 'D', 'B', 'A')} AS h FROM (
  SELECT coalesce(a.PATIENT_ID, b.PATIENT_ID) AS PATIENT_ID, CAST(coalesce(a.END_DT, b.END_DT) AS VARCHAR) AS D, CAST(b.RESP AS VARCHAR) AS B, CAST(a.RESP AS VARCHAR) AS A, CASE WHEN b.PATIENT_ID IS NULL THEN 'added' WHEN a.PATIENT_ID IS NULL THEN 'removed'
  WHEN a.RESP <> b.RESP THEN 'label_changed' ELSE 'unchanged' END AS CHANGE FROM snapshots a FULL JOIN ({_PRIOR}) b ON a.PATIENT_ID = b.PATIENT_ID AND a.END_DT = b.END_DT) LEFT JOIN (SELECT DISTINCT PATIENT_ID, SPLIT FROM manifest) USING (PATIENT_ID)) GROUP BY 1, 2""")
def c15(t):
    return co.population_diff(t.snapshots, prior(t), t.manifest.select("PATIENT_ID", "SPLIT").distinct())


@query("c16_removal_reasons", "REASON:s ROWS:i", "snapshots rx mx", f"""SELECT CASE WHEN s.PATIENT_ID IS NULL THEN 'missing' WHEN d.PATIENT_ID IS NULL THEN 'outside_window' WHEN PRIOR_INITIATION = 1 THEN 'prior_event' WHEN RETAIN = 0 THEN 'unobserved_negative' ELSE 'retained' END AS REASON, count(*) AS ROWS
  FROM ({_PRIOR}) p LEFT JOIN snapshots s ON s.PATIENT_ID = p.PATIENT_ID AND s.END_DT = p.END_DT LEFT JOIN ({DECISION_SQL}) d ON d.PATIENT_ID = p.PATIENT_ID AND d.END_DT = p.END_DT GROUP BY 1""")
def c16(t):
    return co.removal_reasons(prior(t), t.snapshots, decisions(t)).groupBy("REASON").agg(F.count("*").alias("ROWS"))


@query("c17_frozen_key_restriction", "PATIENT_ID:s FILLS:i", "manifest rx", "SELECT PATIENT_ID, count(*) AS FILLS FROM rx WHERE PATIENT_ID IN (SELECT PATIENT_ID FROM manifest WHERE SPLIT = 'test') GROUP BY 1")
def c17(t):
    frozen = t.manifest.filter(TEST).select("PATIENT_ID").distinct()
    return t.rx.join(frozen, "PATIENT_ID", "left_semi").groupBy("PATIENT_ID").agg(F.count("*").alias("FILLS"))


@query("c18_holdout_candidates", "CANDIDATES:i OUTSIDE_ENTITY:i OUTSIDE_SNAPSHOT:i LATER:i HORIZON_ELIGIBLE:i OUTSIDE_ENTITIES:i", "snapshots rx", """WITH frozen AS (SELECT * FROM snapshots WHERE CAST(PATIENT_ID AS BIGINT) % 3 = 0 AND END_DT < DATE '1999-01-01'), f AS (SELECT max(END_DT) AS m FROM frozen), x AS (
  SELECT s.PATIENT_ID, s.END_DT, s.PATIENT_ID NOT IN (SELECT PATIENT_ID FROM frozen) AS oe, NOT EXISTS (SELECT 1 FROM frozen z WHERE z.PATIENT_ID = s.PATIENT_ID AND z.END_DT = s.END_DT) AS os, s.END_DT > m AS lt,
  s.END_DT + 90 <= (SELECT max(FILL_DATE) FROM rx) AS he FROM snapshots s, f) SELECT count(*) AS CANDIDATES, count(*) FILTER (oe) AS OUTSIDE_ENTITY, count(*) FILTER (os) AS OUTSIDE_SNAPSHOT, count(*) FILTER (lt) AS LATER,
  count(*) FILTER (lt AND he) AS HORIZON_ELIGIBLE, count(DISTINCT CASE WHEN oe THEN PATIENT_ID END) AS OUTSIDE_ENTITIES FROM x""")
def c18(t):
    frozen = t.snapshots.filter((F.col("PATIENT_ID").cast("long") % 3 == 0) & (F.col("END_DT") < "1999-01-01"))
    j = (t.snapshots.select(*KEY).join(frozen.select("PATIENT_ID").distinct().withColumn("_e", F.lit(1)), "PATIENT_ID", "left")
         .join(frozen.select(*KEY, F.lit(1).alias("_k")), KEY, "left"))
    j = attach(attach(j, frozen.agg(F.max("END_DT").alias("m")), []), t.rx.agg(F.max("FILL_DATE").alias("o")), [])
    later = F.col("END_DT") > F.col("m")
    per = j.groupBy("PATIENT_ID").agg(F.count("*").alias("n"), total(F.col("_e").isNull()).alias("oe"), total(F.col("_k").isNull()).alias("os"),
                                      total(later).alias("lt"), total(later & (F.date_add("END_DT", 90) <= F.col("o"))).alias("he"))
    return per.agg(F.sum("n").alias("CANDIDATES"), F.sum("oe").alias("OUTSIDE_ENTITY"), F.sum("os").alias("OUTSIDE_SNAPSHOT"), F.sum("lt").alias("LATER"),
                   F.sum("he").alias("HORIZON_ELIGIBLE"), F.count_if(F.col("oe") > 0).alias("OUTSIDE_ENTITIES"))


PAIR_SQL = """SELECT *, sha256('["' || PATIENT_ID || '","' || CAST(END_DT AS VARCHAR) || '","' || CAST(LATER AS VARCHAR) || '"]') AS DIGEST FROM (SELECT *, (year(LATER) - year(END_DT)) * 12 + month(LATER) - month(END_DT) AS GAP
  FROM (SELECT PATIENT_ID, END_DT, lead(END_DT) OVER (PARTITION BY PATIENT_ID ORDER BY END_DT) AS LATER FROM manifest WHERE SPLIT = 'train')) WHERE GAP BETWEEN 1 AND 9"""


@query("c19_adjacent_pair_sample", "PATIENT_ID:s END_DT:d LATER:d GAP:i DIGEST:s", "manifest", PAIR_SQL + " ORDER BY DIGEST LIMIT 200")
def c19(t):
    return sq.adjacent_pairs(t.manifest.filter("SPLIT = 'train'"), 9, 200)[1]


@query("c20_description_left_join", "CODE:s DESCRIPTION:s N:i", "mx", """SELECT PROCEDURE_CODE AS CODE, d AS DESCRIPTION, count(*) AS N FROM mx LEFT JOIN (SELECT p_brand, min(p_name) AS d FROM part WHERE p_brand <> 'Brand#7' GROUP BY 1) ON p_brand = PROCEDURE_CODE GROUP BY 1, 2""")
def c20(t):
    names = t.part.filter("p_brand <> 'Brand#7'").groupBy(F.col("p_brand").alias("CODE")).agg(F.min("p_name").alias("DESCRIPTION"))
    return t.mx.groupBy(F.col("PROCEDURE_CODE").alias("CODE")).agg(F.count("*").alias("N")).join(names, "CODE", "left")


@query("c21_exact_date_attribute", "PATIENT_ID:s END_DT:d ORDERS:i MATCHED:b", "snapshots", """SELECT s.PATIENT_ID, s.END_DT, n AS ORDERS, n IS NOT NULL AS MATCHED FROM snapshots s LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS p, last_day(CAST(o_orderdate AS DATE)) AS d, count(*) AS n FROM orders GROUP BY 1, 2) ON p = s.PATIENT_ID AND d = s.END_DT""")
def c21(t):
    a = t.orders.groupBy(F.col("o_custkey").cast("string").alias("PATIENT_ID"), F.last_day(F.col("o_orderdate").cast("date")).alias("END_DT")).agg(F.count("*").alias("ORDERS"))
    return t.snapshots.select(*KEY).join(a, KEY, "left").withColumn("MATCHED", F.col("ORDERS").isNotNull())


_GRID = "SELECT PATIENT_ID, END_DT, i AS TIME_STEP, CAST(END_DT - to_months(CAST(i AS INTEGER)) AS DATE) AS AS_OF_DATE FROM (SELECT *, unnest(range(12)) AS i FROM snapshots)"


@query("c22_grid_panel_lookup", "TIME_STEP:i RESOLVED:i UNRESOLVED:i", "snapshots rx", f"""SELECT TIME_STEP, count(p.PATIENT_ID) AS RESOLVED, count(*) - count(p.PATIENT_ID) AS UNRESOLVED FROM ({_GRID}) g LEFT JOIN
  (SELECT PATIENT_ID, AS_OF_DATE FROM ({_GRID}) WHERE day(AS_OF_DATE) <> 28 GROUP BY 1, 2) p ON p.PATIENT_ID = g.PATIENT_ID AND p.AS_OF_DATE = g.AS_OF_DATE GROUP BY 1""")
def c22(t):
    grid = ft.asof_grid(t.snapshots, "same_day_months")
    panel = ft.distinct_requests(grid).filter(F.dayofmonth("AS_OF_DATE") != 28).withColumn("_p", F.lit(1))
    j = grid.join(panel, ["PATIENT_ID", "AS_OF_DATE"], "left")
    return j.groupBy("TIME_STEP").agg(F.count("_p").alias("RESOLVED"), F.count_if(F.col("_p").isNull()).alias("UNRESOLVED"))


@query("c23_splitwise_alignment", "SPLIT:s ROWS:i MATCHED:i MISSING:i NON_UNIQUE:i LABEL_PROBLEM:i", "manifest snapshots", f"""SELECT SPLIT, count(*) AS ROWS, count(b.PATIENT_ID) AS MATCHED, count(*) FILTER (b.PATIENT_ID IS NULL) AS MISSING, 0 AS NON_UNIQUE, count(*) FILTER (b.RESP <> a.RESP) AS LABEL_PROBLEM
  FROM manifest a LEFT JOIN ({_PRIOR}) b ON a.PATIENT_ID = b.PATIENT_ID AND a.END_DT = b.END_DT GROUP BY 1""")
def c23(t):
    ext = prior(t).groupBy(*KEY).agg(F.count("*").alias("n"), F.min("RESP").alias("y"))
    j = t.manifest.join(ext, KEY, "left")
    return j.groupBy("SPLIT").agg(F.count("*").alias("ROWS"), F.count("n").alias("MATCHED"), F.count_if(F.col("n").isNull()).alias("MISSING"),
                                  F.count_if(F.col("n") > 1).alias("NON_UNIQUE"), F.count_if(F.col("y") != F.col("RESP")).alias("LABEL_PROBLEM"))


@query("c24_feature_block_assembly", "PATIENT_ID:s END_DT:d TOTAL:i DISTINCT_CATEGORIES:i F_SHARE:f PANEL_AVAILABLE:b", "manifest counts panel", """SELECT m.PATIENT_ID, m.END_DT, coalesce(n, 0) AS TOTAL, coalesce(k, 0) AS DISTINCT_CATEGORIES, coalesce(F_SHARE, 0) AS F_SHARE, IS_OBSERVED AS PANEL_AVAILABLE
  FROM manifest m LEFT JOIN (SELECT PATIENT_ID, END_DT, sum(VALUE) AS n, count(DISTINCT CATEGORY) AS k FROM counts GROUP BY 1, 2) c ON c.PATIENT_ID = m.PATIENT_ID AND c.END_DT = m.END_DT JOIN panel p ON p.PATIENT_ID = m.PATIENT_ID AND p.END_DT = m.END_DT""")
def c24(t):
    per = t.counts.groupBy(*KEY, "CATEGORY").agg(F.sum("VALUE").alias("v")).groupBy(*KEY).agg(F.sum("v").alias("TOTAL"), F.count("*").alias("DISTINCT_CATEGORIES"))
    panel = t.panel.select(*KEY, "F_SHARE", F.col("IS_OBSERVED").alias("PANEL_AVAILABLE"))
    return ct.exact_join(t.manifest.select(*KEY), panel, KEY).filter("STATUS = 'matched'").join(per, KEY, "left").fillna(0, ["TOTAL", "DISTINCT_CATEGORIES", "F_SHARE"])


# G: set operations -------------------------------------------------------------------------------

_TOKENS = """SELECT PATIENT_ID, FILL_DATE, 'CLAIMS_RX' AS CATEGORY, EVENT_ID AS ENTITY_KEY FROM rx WHERE RESULT <> 'R' UNION ALL SELECT PATIENT_ID, FILL_DATE, 'HCPS_RX', PRESCRIBER_NPI FROM rx WHERE RESULT <> 'R'
  UNION ALL SELECT PATIENT_ID, FILL_DATE, 'RX_CHANNEL_' || CHANNEL, EVENT_ID FROM rx WHERE RESULT <> 'R' UNION ALL SELECT PATIENT_ID, FILL_DATE, 'CLAIMS_RX_' || RESULT, EVENT_ID FROM rx"""


def tokens(t):
    """All token branches of one relation from a single scan; a branch keeps paid rows unless it is exempt."""
    paid = F.col("RESULT") != "R"
    one = lambda name, key, keep: F.struct(name.alias("CATEGORY"), F.col(key).alias("ENTITY_KEY"), keep.alias("_k"))
    branches = F.array(one(F.lit("CLAIMS_RX"), "EVENT_ID", paid), one(F.lit("HCPS_RX"), "PRESCRIBER_NPI", paid),
                       one(F.concat(F.lit("RX_CHANNEL_"), "CHANNEL"), "EVENT_ID", paid), one(F.concat(F.lit("CLAIMS_RX_"), "RESULT"), "EVENT_ID", F.lit(True)))
    return t.rx.select("PATIENT_ID", F.col("FILL_DATE").alias("EVENT_DATE"), F.inline(branches)).filter("_k").drop("_k")


@query("g01_token_branches", "PATIENT_ID:s END_DT:d CATEGORY:s VALUE:i RECENT_VALUE:i MAX_EVENT_DATE:d", "snapshots rx", f"""SELECT s.PATIENT_ID, s.END_DT, CATEGORY, count(DISTINCT ENTITY_KEY) AS VALUE, count(DISTINCT CASE WHEN FILL_DATE BETWEEN END_DT - INTERVAL 4 MONTH
  AND END_DT - INTERVAL 1 MONTH THEN ENTITY_KEY END) AS RECENT_VALUE, max(FILL_DATE) AS MAX_EVENT_DATE FROM snapshots s JOIN ({_TOKENS}) k ON k.PATIENT_ID = s.PATIENT_ID AND FILL_DATE BETWEEN END_DT - INTERVAL 12 MONTH AND END_DT GROUP BY 1, 2, 3""")
def g01(t):
    # Shuffled once, by entity: the distinct rows, the join and the members reuse that partitioning.
    members = tokens(t).repartition("PATIENT_ID").distinct()
    rows = ev.asof_join(t.snapshots.select(*KEY), members, "EVENT_DATE", 13, F.add_months("END_DT", -12))
    low, high = recent_window(F.col("END_DT"))
    return ev.distinct_members(rows, "CATEGORY", "ENTITY_KEY", F.col("EVENT_DATE").between(low, high))


@query("g02_row_kind_union", "ROW_KIND:s PATIENT_ID:s END_DT:d CATEGORY:s VALUE:i", "counts", """SELECT 'COVERAGE' AS ROW_KIND, PATIENT_ID, END_DT, NULL AS CATEGORY, sum(VALUE) AS VALUE FROM counts GROUP BY 2, 3
  UNION ALL SELECT 'FEATURE', PATIENT_ID, END_DT, CATEGORY, sum(VALUE) FROM counts GROUP BY 2, 3, 4""")
def g02(t):
    per = t.counts.groupBy(*KEY, "CATEGORY").agg(F.sum("VALUE").alias("VALUE")).withColumn("ROW_KIND", F.lit("FEATURE"))
    cover = t.counts.groupBy(*KEY).agg(F.sum("VALUE").alias("VALUE")).withColumn("ROW_KIND", F.lit("COVERAGE"))
    return per.unionByName(cover, allowMissingColumns=True)


@query("g03_two_source_union", "SOURCE_ID:s PATIENT_ID:s EVENT_DATE:d CHANNEL:s VISIT_TYPE:s", "rx mx", """SELECT 'RX:' || EVENT_ID AS SOURCE_ID, PATIENT_ID, FILL_DATE AS EVENT_DATE, CHANNEL, NULL AS VISIT_TYPE FROM rx WHERE RESULT = 'R'
  UNION ALL SELECT 'MX:' || EVENT_ID, PATIENT_ID, SERVICE_DATE, NULL, VISIT_TYPE FROM mx WHERE VISIT_TYPE = 'P'""")
def g03(t):
    a = t.rx.filter("RESULT = 'R'").select(F.concat(F.lit("RX:"), "EVENT_ID").alias("SOURCE_ID"), "PATIENT_ID", F.col("FILL_DATE").alias("EVENT_DATE"), "CHANNEL")
    b = t.mx.filter("VISIT_TYPE = 'P'").select(F.concat(F.lit("MX:"), "EVENT_ID").alias("SOURCE_ID"), "PATIENT_ID", F.col("SERVICE_DATE").alias("EVENT_DATE"), "VISIT_TYPE")
    return a.unionByName(b, allowMissingColumns=True)


_SEL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY MODEL ORDER BY SCORE DESC, PATIENT_ID, END_DT) AS rk, count(*) OVER (PARTITION BY MODEL) AS N FROM model_scores WHERE SPLIT = 'test') WHERE rk <= greatest(1, (N * 10 + 99) // 100)"""


def selected(t, models=("alpha", "beta")):
    rows = t.model_scores.filter(TEST).filter(F.col("MODEL").isin(*models))
    r = od.ranked(rows, [F.desc("SCORE"), *keys()], "RANK", ("MODEL",))
    sizes = r.groupBy("MODEL").agg(F.count("*").alias("N"))
    return r.join(sizes, "MODEL").filter(F.col("RANK") <= evl.capacity(F.col("N"), 10))


@query("g04_selected_set_overlap", "OVERLAP:s ROWS:i POSITIVES:i", "model_scores", f"""SELECT CASE WHEN a AND b THEN 'shared' WHEN a THEN 'lost' ELSE 'gained' END AS OVERLAP, count(*) AS ROWS, sum(RESP) AS POSITIVES FROM (
  SELECT PATIENT_ID, END_DT, max(RESP) AS RESP, bool_or(MODEL = 'alpha') AS a, bool_or(MODEL = 'beta') AS b FROM ({_SEL}) WHERE MODEL IN ('alpha', 'beta') GROUP BY 1, 2) GROUP BY 1""")
def g04(t):
    s = selected(t).groupBy(*KEY).agg(F.max("RESP").alias("y"), F.bool_or(F.col("MODEL") == "alpha").alias("a"), F.bool_or(F.col("MODEL") == "beta").alias("b"))
    kind = F.when(F.col("a") & F.col("b"), "shared").when(F.col("a"), "lost").otherwise("gained")
    return s.groupBy(kind.alias("OVERLAP")).agg(F.count("*").alias("ROWS"), F.sum("y").alias("POSITIVES"))


_FEAT_RANKS = """SELECT *, rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS r1, rank() OVER (ORDER BY k DESC) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS r2, row_number() OVER (ORDER BY n DESC, CATEGORY) AS p1, row_number() OVER (ORDER BY k DESC, CATEGORY) AS p2
  FROM (SELECT CATEGORY, sum(VALUE) AS n, count(DISTINCT PATIENT_ID) AS k FROM counts GROUP BY 1)"""


@query("g05_rank_list_agreement", "FEATURES:i TOP_OVERLAP:i OVERLAP_FRACTION:f SPEARMAN:f", "counts", f"SELECT count(*) AS FEATURES, count(*) FILTER (p1 <= 10 AND p2 <= 10) AS TOP_OVERLAP, count(*) FILTER (p1 <= 10 AND p2 <= 10) / 10 AS OVERLAP_FRACTION, corr(r1, r2) AS SPEARMAN FROM ({_FEAT_RANKS})")
def g05(t):
    from pyspark.sql import Window as W
    per = t.counts.groupBy("CATEGORY", "PATIENT_ID").agg(F.sum("VALUE").alias("v")).groupBy("CATEGORY").agg(F.sum("v").alias("n"), F.count("*").alias("k"))
    mid = lambda c: F.rank().over(W.orderBy(F.desc(c))) + (F.count("*").over(W.partitionBy(c)) - 1) / 2
    pos = lambda c: F.row_number().over(W.orderBy(F.desc(c), "CATEGORY"))
    r = per.select(mid("n").alias("r1"), mid("k").alias("r2"), pos("n").alias("p1"), pos("k").alias("p2"))
    both = F.count_if((F.col("p1") <= 10) & (F.col("p2") <= 10))
    return r.agg(F.count("*").alias("FEATURES"), both.alias("TOP_OVERLAP"), (both / 10).alias("OVERLAP_FRACTION"), F.corr("r1", "r2").alias("SPEARMAN"))


@query("g06_split_disjointness", "PAIR:s ENTITIES:i", "manifest", """WITH m AS (SELECT DISTINCT PATIENT_ID, CASE WHEN CAST(PATIENT_ID AS BIGINT) % 17 = 0 AND END_DT > DATE '1999-01-01' THEN 'test' ELSE SPLIT END AS s FROM manifest)
  SELECT a.s || '/' || b.s AS PAIR, count(*) AS ENTITIES FROM m a JOIN m b ON a.PATIENT_ID = b.PATIENT_ID AND a.s < b.s GROUP BY 1""")
def g06(t):
    moved = F.when((F.col("PATIENT_ID").cast("long") % 17 == 0) & (F.col("END_DT") > "1999-01-01"), "test").otherwise(F.col("SPLIT"))
    per = t.manifest.groupBy("PATIENT_ID").agg(F.array_sort(F.collect_set(moved)).alias("s")).filter(F.size("s") > 1)
    names = ("test", "train", "validation")
    pairs = F.array(*[F.when(F.array_contains("s", a) & F.array_contains("s", b), F.lit(f"{a}/{b}")) for i, a in enumerate(names) for b in names[i + 1:]])
    return per.select(F.explode(F.array_compact(pairs)).alias("PAIR")).groupBy("PAIR").agg(F.count("*").alias("ENTITIES"))


@query("g07_request_dedup", "POSITIONS:i REQUESTS:i REUSED:i", "snapshots", """SELECT count(*) AS POSITIONS, count(DISTINCT (PATIENT_ID, d)) AS REQUESTS, count(*) - count(DISTINCT (PATIENT_ID, d)) AS REUSED FROM (SELECT PATIENT_ID, CASE WHEN i = 0 THEN END_DT ELSE
  last_day(CAST(date_trunc('month', END_DT) - to_months(CAST(i AS INTEGER)) AS DATE)) END AS d FROM (SELECT *, unnest(range(12)) AS i FROM snapshots))""")
def g07(t):
    per = ft.asof_grid(t.snapshots, "month_end_history").groupBy("PATIENT_ID", "AS_OF_DATE").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("POSITIONS"), F.count("*").alias("REQUESTS"), (F.sum("n") - F.count("*")).alias("REUSED"))


@query("g08_feature_set_overlap", "SET_A:s SET_B:s SHARED:i", "", """WITH f AS (SELECT DISTINCT p_type AS s, p_brand || p_name AS f FROM part) SELECT a.s AS SET_A, b.s AS SET_B, count(*) AS SHARED FROM f a JOIN f b ON a.f = b.f GROUP BY 1, 2""")
def g08(t):
    # Each feature carries its set of strategies (a handful of names), so pairs are formed per feature, not per row.
    per = t.part.groupBy(F.concat("p_brand", "p_name").alias("f")).agg(F.collect_set("p_type").alias("s"))
    return per.select(F.explode("s").alias("SET_A"), "s").select("SET_A", F.explode("s").alias("SET_B")).groupBy("SET_A", "SET_B").agg(F.count("*").alias("SHARED"))
