"""Section D: aggregations over events, populations and features."""

from pyspark.sql import functions as F

from tidemark.functions.calendar import recent_window
from tidemark.functions.scalar import birth_year, total
from tidemark.operators import association as asc, cohort as co, evaluation as evl, events as ev, features as ft
from tidemark.operators.ordering import attach
from tidemark.operators.lineage import relation_hash
from tidemark.plans.registry import hash_sql, query, row_sql
from tidemark.plans.relations import VOCABULARY, sql_list
from tidemark.session import settle

KEY = ["PATIENT_ID", "END_DT"]


@query("d01_monthly_category_counts",
       "PATIENT_ID:s END_DT:d TIME_STEP:i FAMILY:s CATEGORY:s VALUE:i FIRST_EVENT_DATE:d LAST_EVENT_DATE:d",
       "counts", "SELECT * FROM counts")
def d01(t):
    return t.counts


@query("d02_entity_day_preaggregation", "PATIENT_ID:s EVENT_DATE:d FAMILY:s CODE:s N:i", "occurrences",
       "SELECT PATIENT_ID, EVENT_DATE, FAMILY, CODE, count(*) AS N FROM occurrences GROUP BY 1, 2, 3, 4")
def d02(t):
    return ev.daily_codes(t.rx, t.mx).groupBy("PATIENT_ID", "EVENT_DATE", "FAMILY", "CODE").agg(F.sum("N").alias("N"))


@query("d03_multi_value_explode", "SERVICE_DATE:d CODE:s OCCURRENCES:i", "mx", """SELECT SERVICE_DATE, tok AS CODE, count(*) AS OCCURRENCES FROM (
  SELECT SERVICE_DATE, unnest(string_split(DIAGNOSIS_CODES || '|', '|')) AS tok FROM mx) WHERE trim(tok) <> '' GROUP BY 1, 2""")
def d03(t):
    lists = t.mx.groupBy("SERVICE_DATE", F.concat("DIAGNOSIS_CODES", F.lit("|")).alias("CODE")).agg(F.count("*").alias("n"))
    return ev.explode_codes(lists, "CODE").groupBy("SERVICE_DATE", "CODE").agg(F.sum("n").alias("OCCURRENCES"))


def distinct_prescribers(t):
    """Distinct prescribers per (snapshot, channel) over the rolling year, and in the recent window."""
    pairs = t.rx.groupBy("PATIENT_ID", F.col("FILL_DATE").alias("EVENT_DATE"), F.col("CHANNEL").alias("CATEGORY"), "PRESCRIBER_NPI").agg(F.count("*").alias("n"))
    rows = ev.asof_join(t.snapshots.select(*KEY), pairs, "EVENT_DATE", 13, F.add_months("END_DT", -12))
    low, high = recent_window(F.col("END_DT"))
    return ev.distinct_members(rows, "CATEGORY", "PRESCRIBER_NPI", F.col("EVENT_DATE").between(low, high))


@query("d04_distinct_entity_summary", "PATIENT_ID:s END_DT:d CATEGORY:s VALUE:i RECENT_VALUE:i MAX_EVENT_DATE:d", "snapshots rx", """
  SELECT s.PATIENT_ID, s.END_DT, r.CHANNEL AS CATEGORY, count(DISTINCT PRESCRIBER_NPI) AS VALUE, count(DISTINCT CASE WHEN FILL_DATE
  BETWEEN END_DT - INTERVAL 4 MONTH AND END_DT - INTERVAL 1 MONTH THEN PRESCRIBER_NPI END) AS RECENT_VALUE, max(FILL_DATE) AS MAX_EVENT_DATE
  FROM snapshots s JOIN rx r ON r.PATIENT_ID = s.PATIENT_ID AND FILL_DATE BETWEEN END_DT - INTERVAL 12 MONTH AND END_DT GROUP BY 1, 2, 3""")
def d04(t):
    return distinct_prescribers(t)


@query("d05_recent_percentage", "PATIENT_ID:s END_DT:d ANNUAL:i RECENT:i RECENT_PERCENT:i", "counts", """SELECT *, CASE WHEN ANNUAL > 6 AND RECENT > 2
  THEN floor(100.0 * RECENT / ANNUAL + 0.5) ELSE 0 END AS RECENT_PERCENT FROM (SELECT PATIENT_ID, END_DT, sum(VALUE) AS ANNUAL,
  sum(CASE WHEN TIME_STEP BETWEEN 1 AND 3 THEN VALUE ELSE 0 END) AS RECENT FROM counts GROUP BY 1, 2)""")
def d05(t):
    n = F.size("IDS")
    s = t.windowed.groupBy(*KEY).agg(F.sum(n).alias("ANNUAL"), F.sum(F.when(F.col("TIME_STEP").between(1, 3), n).otherwise(0)).alias("RECENT"))
    ready = (F.col("ANNUAL") > 6) & (F.col("RECENT") > 2)
    return s.withColumn("RECENT_PERCENT", F.when(ready, F.floor(100.0 * F.col("RECENT") / F.col("ANNUAL") + 0.5)).otherwise(0))


@query("d06_request_coverage", "PATIENT_ID:s END_DT:d LAST_EVENT:d OBSERVED:b", "snapshots rx mx", """SELECT s.PATIENT_ID, s.END_DT, max(d) AS LAST_EVENT, max(d) IS NOT NULL AS OBSERVED FROM snapshots s
  LEFT JOIN (SELECT PATIENT_ID, FILL_DATE AS d FROM rx UNION ALL SELECT PATIENT_ID, SERVICE_DATE FROM mx) e
  ON e.PATIENT_ID = s.PATIENT_ID AND d <= END_DT AND d >= date_trunc('month', END_DT) - INTERVAL 2 MONTH GROUP BY 1, 2""")
def d06(t):
    days = t.rx.select("PATIENT_ID", F.col("FILL_DATE").alias("d")).unionByName(t.mx.select("PATIENT_ID", F.col("SERVICE_DATE").alias("d"))).distinct()
    last = ev.asof_join(t.snapshots.select(*KEY), days, "d", 3).groupBy(*KEY).agg(F.max("d").alias("LAST_EVENT"))
    return t.snapshots.select(*KEY).join(last, KEY, "left").withColumn("OBSERVED", F.col("LAST_EVENT").isNotNull())


@query("d07_age_conflict", "ID_TXT:s BIRTH_YEAR:i AGE:i CONFLICT:b", "dirty", """SELECT ID_TXT, CASE WHEN count(DISTINCT y) = 1 THEN min(y) END AS BIRTH_YEAR, CASE WHEN count(DISTINCT y) = 1 THEN 2000 - min(y) END AS AGE,
  count(DISTINCT y) > 1 AS CONFLICT FROM (SELECT ID_TXT, CASE WHEN yy BETWEEN 1940 AND 1960 THEN yy END AS y FROM (SELECT ID_TXT, coalesce(try_cast(BIRTH_TXT AS INTEGER), year(try_cast(BIRTH_TXT AS DATE))) AS yy
  FROM dirty)) WHERE ID_TXT IS NOT NULL GROUP BY 1""")
def d07(t):
    y = birth_year(F.col("BIRTH_TXT"))
    years = t.dirty.filter("ID_TXT IS NOT NULL").select("ID_TXT", F.when(y.between(1940, 1960), y).alias("y"))
    # One plausible year exactly when min and max agree, so no distinct count is needed.
    g = years.groupBy("ID_TXT").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    one = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    return g.select("ID_TXT", one.alias("BIRTH_YEAR"), (2000 - one).alias("AGE"), F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)).alias("CONFLICT"))


@query("d08_mapping_dedup", "FAMILY:s CODE:s CATEGORY:s", "code_map", "SELECT * FROM code_map")
def d08(t):
    return t.code_map


@query("d09_description_per_code", "CODE:s DESCRIPTION:s VARIANTS:i", "", """SELECT p_brand AS CODE, min(trim(p_name)) AS DESCRIPTION, count(DISTINCT trim(p_name)) AS VARIANTS FROM part GROUP BY 1""")
def d09(t):
    once = t.part.select(F.col("p_brand").alias("CODE"), F.trim("p_name").alias("d")).distinct()
    return once.groupBy("CODE").agg(F.min("d").alias("DESCRIPTION"), F.count("*").alias("VARIANTS"))


@query("d10_mapping_audit", "FAMILY:s PAIRS:i CODES:i CATEGORIES:i HASH:s", "code_map",
       f"SELECT FAMILY, count(*) AS PAIRS, count(DISTINCT CODE) AS CODES, count(DISTINCT CATEGORY) AS CATEGORIES, {hash_sql('h')} AS HASH FROM (SELECT *, {row_sql('FAMILY', 'CODE', 'CATEGORY')} AS h FROM code_map) GROUP BY 1")
def d10(t):
    rows = t.code_map.select("FAMILY", "CODE", "CATEGORY")
    sizes = rows.groupBy("FAMILY").agg(F.count_distinct("CODE").alias("CODES"), F.count_distinct("CATEGORY").alias("CATEGORIES"))
    return relation_hash(rows, "FAMILY").withColumnRenamed("ROWS", "PAIRS").join(sizes, "FAMILY")


@query("d11_reviewed_event_counts", "event_type:s EVENTS:i NULL_IDS:i", "", """SELECT event_type, count(DISTINCT CASE WHEN event_id % 13 <> 0 THEN event_id // 2 END) AS EVENTS,
  count(*) FILTER (event_id % 13 = 0) AS NULL_IDS FROM events GROUP BY 1""")
def d11(t):
    eid = F.when(F.col("event_id") % 13 != 0, F.floor(F.col("event_id") / 2))
    once = t.events.groupBy("event_type", eid.alias("e")).agg(F.count("*").alias("n"))
    return once.groupBy("event_type").agg(F.count("e").alias("EVENTS"), F.sum(F.when(F.col("e").isNull(), F.col("n")).otherwise(0)).alias("NULL_IDS"))


@query("d12_multi_window_sums", "PATIENT_ID:s END_DT:d CATEGORY:s W1:i W3:i W6:i W12:i STEPS:i", "counts", """SELECT PATIENT_ID, END_DT, CATEGORY, sum(CASE WHEN TIME_STEP < 1 THEN VALUE ELSE 0 END) AS W1,
  sum(CASE WHEN TIME_STEP < 3 THEN VALUE ELSE 0 END) AS W3, sum(CASE WHEN TIME_STEP < 6 THEN VALUE ELSE 0 END) AS W6, sum(VALUE) AS W12, count(DISTINCT TIME_STEP) AS STEPS FROM counts GROUP BY 1, 2, 3""")
def d12(t):
    w = lambda n: F.sum(F.when(F.col("TIME_STEP") < n, F.col("VALUE")).otherwise(0)).alias(f"W{n}")
    return t.counts.groupBy(*KEY, "CATEGORY").agg(w(1), w(3), w(6), w(12), F.count("*").alias("STEPS"))


BASKET_SQL = "SELECT PATIENT_ID, FILL_DATE, CASE WHEN CAST(PRESCRIBER_NPI AS BIGINT) % 7 = 0 THEN NULL ELSE RESULT <> 'R' OR CAST(NDC11 AS BIGINT) % 4 <> 0 END AS IS_GENERIC FROM rx"
BOUNDS_SQL = """SELECT o AS OBSERVED_THROUGH, least((SELECT max(END_DT) FROM snapshots), o - 90) AS UPPER_END, CAST(least((SELECT max(END_DT) FROM snapshots), o - 90) - INTERVAL 36 MONTH AS DATE) AS LOWER_END
  FROM (SELECT least((SELECT max(FILL_DATE) FROM rx), (SELECT max(SERVICE_DATE) FROM mx)) AS o)"""
DECISION_SQL = f"""WITH basket AS ({BASKET_SQL}), bnd AS ({BOUNDS_SQL}), pop AS (SELECT s.* FROM snapshots s, bnd WHERE END_DT > LOWER_END AND END_DT <= UPPER_END),
  fe AS (SELECT PATIENT_ID, min(FILL_DATE) AS FIRST_EVENT FROM basket WHERE IS_GENERIC = FALSE GROUP BY 1),
  lab AS (SELECT p.PATIENT_ID, p.END_DT, p.RESP AS ORIGINAL_RESP, FIRST_EVENT, CASE WHEN FIRST_EVENT > END_DT AND FIRST_EVENT <= END_DT + 90 THEN 1 ELSE 0 END AS RESP,
          CASE WHEN FIRST_EVENT <= END_DT THEN 1 ELSE 0 END AS PRIOR_INITIATION FROM pop p LEFT JOIN fe ON fe.PATIENT_ID = p.PATIENT_ID),
  obs AS (SELECT DISTINCT l.PATIENT_ID, l.END_DT FROM lab l JOIN mx m ON m.PATIENT_ID = l.PATIENT_ID AND SERVICE_DATE > END_DT AND SERVICE_DATE <= END_DT + 90 WHERE l.RESP = 0 AND PRIOR_INITIATION = 0)
  SELECT l.*, CASE WHEN o.PATIENT_ID IS NULL THEN 0 ELSE 1 END AS OBSERVED_NEGATIVE, CASE WHEN PRIOR_INITIATION = 0 AND (RESP = 1 OR o.PATIENT_ID IS NOT NULL) THEN 1 ELSE 0 END AS RETAIN
  FROM lab l LEFT JOIN obs o ON o.PATIENT_ID = l.PATIENT_ID AND o.END_DT = l.END_DT"""


def basket(t):
    generic = (F.col("RESULT") != "R") | (F.col("NDC11").cast("long") % 4 != 0)
    return t.rx.select("PATIENT_ID", "FILL_DATE", F.when(F.col("PRESCRIBER_NPI").cast("long") % 7 == 0, None).otherwise(generic).alias("IS_GENERIC"))


def limits(t):
    return co.bounds(t.snapshots, t.rx, t.mx, 36)


def decisions(t):
    return co.decide(co.bounded(t.snapshots, limits(t)), basket(t), t.mx)


@query("d13_first_qualifying_event", "PATIENT_ID:s FIRST_EVENT:d", "snapshots rx", f"""SELECT PATIENT_ID, min(FILL_DATE) AS FIRST_EVENT FROM ({BASKET_SQL}) WHERE IS_GENERIC = FALSE
  AND PATIENT_ID IN (SELECT PATIENT_ID FROM snapshots) GROUP BY 1""")
def d13(t):
    return co.first_event(basket(t), t.snapshots)


@query("d14_horizon_label", "PATIENT_ID:s END_DT:d ORIGINAL_RESP:i FIRST_EVENT:d RESP:i PRIOR_INITIATION:i OBSERVED_NEGATIVE:i RETAIN:i", "snapshots rx mx", DECISION_SQL)
def d14(t):
    return decisions(t)


@query("d15_population_bound", "OBSERVED_THROUGH:d UPPER_END:d LOWER_END:d", "snapshots rx mx", BOUNDS_SQL)
def d15(t):
    return limits(t)


@query("d16_cohort_audit", "BOUNDED_SNAPSHOTS:i SNAPSHOTS:i PATIENTS:i POSITIVES:i POSITIVE_PATIENTS:i POSITIVES_GAINED:i POSITIVES_LOST:i PRIOR_EXCLUSIONS:i UNOBSERVED_EXCLUSIONS:i", "snapshots rx mx", f"""
  SELECT count(*) AS BOUNDED_SNAPSHOTS, sum(RETAIN) AS SNAPSHOTS, count(DISTINCT CASE WHEN RETAIN = 1 THEN PATIENT_ID END) AS PATIENTS, sum(RETAIN * RESP) AS POSITIVES,
  count(DISTINCT CASE WHEN RETAIN = 1 AND RESP = 1 THEN PATIENT_ID END) AS POSITIVE_PATIENTS, count(*) FILTER (RETAIN = 1 AND ORIGINAL_RESP = 0 AND RESP = 1) AS POSITIVES_GAINED,
  count(*) FILTER (RETAIN = 1 AND ORIGINAL_RESP = 1 AND RESP = 0) AS POSITIVES_LOST, sum(PRIOR_INITIATION) AS PRIOR_EXCLUSIONS,
  count(*) FILTER (PRIOR_INITIATION = 0 AND RESP = 0 AND OBSERVED_NEGATIVE = 0) AS UNOBSERVED_EXCLUSIONS FROM ({DECISION_SQL})""")
def d16(t):
    return co.audit(decisions(t))


@query("d17_population_totals", "ROWS:i NULL_ID:i BAD_LABEL:i DUPLICATE_EXCESS:i", "dirty", """SELECT count(*) AS ROWS, count(*) FILTER (ID_TXT IS NULL) AS NULL_ID, count(*) FILTER (RESP_TXT IS NULL OR RESP_TXT NOT IN ('0', '1')) AS BAD_LABEL,
  count(*) - count(DISTINCT (coalesce(ID_TXT, '?'), DATE_TXT, coalesce(RESP_TXT, '?'))) AS DUPLICATE_EXCESS FROM dirty""")
def d17(t):
    per = t.dirty.groupBy("ID_TXT", "DATE_TXT", "RESP_TXT").agg(F.count("*").alias("n"))
    add = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    bad = F.col("RESP_TXT").isNull() | ~F.col("RESP_TXT").isin("0", "1")
    return per.agg(F.sum("n").alias("ROWS"), add(F.col("ID_TXT").isNull()).alias("NULL_ID"), add(bad).alias("BAD_LABEL"), F.sum(F.col("n") - 1).alias("DUPLICATE_EXCESS"))


def split_summary(rows, by):
    per = rows.groupBy(*by, "PATIENT_ID").agg(F.count("*").alias("n"), F.sum("RESP").alias("p"), F.min("END_DT").alias("a"), F.max("END_DT").alias("b"))
    return per.groupBy(*by).agg(F.sum("n").alias("SNAPSHOTS"), F.count("*").alias("ENTITIES"), F.sum("p").alias("POSITIVES"),
                                F.count_if(F.col("p") > 0).alias("POSITIVE_ENTITIES"), (F.sum("p") / F.sum("n")).alias("RATE"), F.min("a").alias("FIRST_DT"), F.max("b").alias("LAST_DT"))


_SUMMARY = """count(*) AS SNAPSHOTS, count(DISTINCT PATIENT_ID) AS ENTITIES, sum(RESP) AS POSITIVES, count(DISTINCT CASE WHEN RESP = 1 THEN PATIENT_ID END) AS POSITIVE_ENTITIES, avg(RESP) AS RATE,
  min(END_DT) AS FIRST_DT, max(END_DT) AS LAST_DT FROM manifest"""


@query("d18_split_summary", "SPLIT:s SNAPSHOTS:i ENTITIES:i POSITIVES:i POSITIVE_ENTITIES:i RATE:f", "manifest", f"SELECT SPLIT, {_SUMMARY} GROUP BY 1")
def d18(t):
    return split_summary(t.manifest, ["SPLIT"])


@query("d19_summary_with_total", "SPLIT:s SNAPSHOTS:i ENTITIES:i POSITIVES:i POSITIVE_ENTITIES:i RATE:f FIRST_DT:d LAST_DT:d", "manifest",
       f"SELECT CASE WHEN GROUPING(SPLIT) = 1 THEN 'ALL' ELSE SPLIT END AS SPLIT, {_SUMMARY} GROUP BY ROLLUP (SPLIT)")
def d19(t):
    # An entity lives in one split, so the total row is the sum of the per-split rows.
    s = split_summary(t.manifest, ["SPLIT"])
    add = lambda c: F.sum(c).alias(c)
    return s.rollup("SPLIT").agg(add("SNAPSHOTS"), add("ENTITIES"), add("POSITIVES"), add("POSITIVE_ENTITIES"), (F.sum("POSITIVES") / F.sum("SNAPSHOTS")).alias("RATE"),
                                 F.min("FIRST_DT").alias("FIRST_DT"), F.max("LAST_DT").alias("LAST_DT")).withColumn("SPLIT", F.coalesce("SPLIT", F.lit("ALL")))


@query("d20_month_split_profile", "MONTH:d BUCKET:s ROWS:i", "dirty", """SELECT CAST(date_trunc('month', try_cast(DATE_TXT AS DATE)) AS DATE) AS MONTH, CASE WHEN s IN ('train', 'validation', 'test') THEN s WHEN s IS NULL THEN 'missing' ELSE 'invalid' END AS BUCKET, count(*) AS ROWS
  FROM (SELECT DATE_TXT, lower(trim(SPLIT_TXT)) AS s FROM dirty WHERE NOT contains(DATE_TXT, ':')) GROUP BY 1, 2""")
def d20(t):
    s = F.lower(F.trim("SPLIT_TXT"))
    bucket = F.when(s.isin("train", "validation", "test"), s).when(s.isNull(), "missing").otherwise("invalid")
    rows = t.dirty.filter(~F.contains("DATE_TXT", F.lit(":")))
    return rows.groupBy(F.trunc(F.try_to_date("DATE_TXT", "yyyy-MM-dd"), "month").alias("MONTH"), bucket.alias("BUCKET")).agg(F.count("*").alias("ROWS"))


@query("d21_day_of_month_profile", "DAY:i ROWS:i HORIZON_COMPLETE:i", "rx", """SELECT day(FILL_DATE) AS DAY, count(*) AS ROWS, count(*) FILTER (FILL_DATE + 90 <= (SELECT max(FILL_DATE) FROM rx)) AS HORIZON_COMPLETE FROM rx GROUP BY 1""")
def d21(t):
    last = t.rx.agg(F.max("FILL_DATE").alias("m"))
    days = t.rx.groupBy("FILL_DATE").agg(F.count("*").alias("n"))
    return attach(days, last, []).groupBy(F.dayofmonth("FILL_DATE").alias("DAY")).agg(
        F.sum("n").alias("ROWS"), F.sum(F.when(F.date_add("FILL_DATE", 90) <= F.col("m"), F.col("n")).otherwise(0)).alias("HORIZON_COMPLETE"))


@query("d22_snapshots_per_entity", "BUCKET:s ENTITIES:i", "snapshots", """SELECT CASE WHEN n >= 5 THEN '5+' ELSE CAST(n AS VARCHAR) END AS BUCKET, count(*) AS ENTITIES FROM (SELECT PATIENT_ID, count(*) AS n FROM snapshots GROUP BY 1) GROUP BY 1""")
def d22(t):
    per = t.snapshots.groupBy("PATIENT_ID").agg(F.count("*").alias("n"))
    return per.groupBy(F.when(F.col("n") >= 5, "5+").otherwise(F.col("n").cast("string")).alias("BUCKET")).agg(F.count("*").alias("ENTITIES"))


@query("d23_multiplicity_by_class", "ENTITY_CLASS:i ENTITIES:i MEAN_SNAPSHOTS:f MAX_SNAPSHOTS:i", "snapshots", """SELECT c AS ENTITY_CLASS, count(*) AS ENTITIES, avg(n) AS MEAN_SNAPSHOTS, max(n) AS MAX_SNAPSHOTS
  FROM (SELECT PATIENT_ID, max(RESP) AS c, count(*) AS n FROM snapshots GROUP BY 1) GROUP BY 1""")
def d23(t):
    per = t.snapshots.groupBy("PATIENT_ID").agg(F.max("RESP").alias("ENTITY_CLASS"), F.count("*").alias("n"))
    return per.groupBy("ENTITY_CLASS").agg(F.count("*").alias("ENTITIES"), F.avg("n").alias("MEAN_SNAPSHOTS"), F.max("n").alias("MAX_SNAPSHOTS"))


PANEL_TALL = """SELECT PATIENT_ID, END_DT, RESP, SPLIT, IS_OBSERVED, MAX_EVENT_DATE, f AS FEATURE, CASE f WHEN 'F_COUNT' THEN F_COUNT WHEN 'F_BINARY' THEN F_BINARY ELSE F_SHARE END AS VALUE
  FROM panel, (SELECT unnest(['F_COUNT', 'F_BINARY', 'F_SHARE']) AS f)"""


def panel_tall(t):
    """Panel values as (key.., FEATURE, KIND, VALUE), expanded in place."""
    item = lambda n, k: F.struct(F.lit(n).alias("FEATURE"), F.lit(k).alias("KIND"), F.col(n).alias("VALUE"))
    return settle(t.panel).select(*KEY, "RESP", "SPLIT", "IS_OBSERVED", "MAX_EVENT_DATE",
                          F.inline(F.array(item("F_COUNT", "count"), item("F_BINARY", "binary"), item("F_SHARE", "continuous"))))


@query("d24_feature_value_quality", "FEATURE:s ROWS:i NULLS:i NEGATIVE:i FRACTIONAL:i NON_FINITE:i NON_ZERO:i LOW:f HIGH:f IS_CONSTANT:b", "panel", f"""SELECT FEATURE, count(*) AS ROWS, count(*) FILTER (VALUE IS NULL) AS NULLS,
  count(*) FILTER (VALUE < 0) AS NEGATIVE, count(*) FILTER (VALUE <> floor(VALUE)) AS FRACTIONAL, 0 AS NON_FINITE, count(*) FILTER (VALUE <> 0) AS NON_ZERO, min(VALUE) AS LOW, max(VALUE) AS HIGH,
  coalesce(min(VALUE) = max(VALUE), FALSE) AS IS_CONSTANT FROM ({PANEL_TALL}) GROUP BY 1""")
def d24(t):
    v = F.col("VALUE")
    return panel_tall(t).groupBy("FEATURE").agg(
        F.count("*").alias("ROWS"), F.count_if(v.isNull()).alias("NULLS"), F.count_if(v < 0).alias("NEGATIVE"), F.count_if(v != F.floor(v)).alias("FRACTIONAL"),
        F.count_if(F.isnan(v) | (F.abs(v) == float("inf"))).alias("NON_FINITE"), F.count_if(v != 0).alias("NON_ZERO"), F.min(v).alias("LOW"), F.max(v).alias("HIGH"),
        F.coalesce(F.min(v) == F.max(v), F.lit(False)).alias("IS_CONSTANT"))


@query("d25_feature_overlap", "FEATURE:s STATUS:s ACTIVITY:i", "counts vocab", """SELECT coalesce(v.FEATURE, c.CATEGORY) AS FEATURE, CASE WHEN c.CATEGORY IS NULL THEN 'no_activity' WHEN v.FEATURE IS NULL THEN 'out_of_vocabulary' ELSE 'both' END AS STATUS,
  coalesce(n, 0) AS ACTIVITY FROM (SELECT FEATURE FROM vocab UNION SELECT 'DX_RETIRED') v FULL JOIN (SELECT CATEGORY, sum(VALUE) AS n FROM counts GROUP BY 1) c ON c.CATEGORY = v.FEATURE""")
def d25(t):
    names = t.rows([(v,) for v in (*VOCABULARY, "DX_RETIRED")], "FEATURE string").withColumn("_v", F.lit(1))
    seen = t.counts.groupBy(F.col("CATEGORY").alias("FEATURE")).agg(F.sum("VALUE").alias("n"))
    status = F.when(F.col("n").isNull(), "no_activity").when(F.col("_v").isNull(), "out_of_vocabulary").otherwise("both")
    return names.join(seen, "FEATURE", "full").select("FEATURE", status.alias("STATUS"), F.coalesce("n", F.lit(0)).alias("ACTIVITY"))


@query("d26_train_support", "FEATURE:s SUPPORT:i", "counts manifest", """SELECT CATEGORY AS FEATURE, count(DISTINCT PATIENT_ID) AS SUPPORT FROM counts WHERE PATIENT_ID IN (SELECT PATIENT_ID FROM manifest WHERE SPLIT = 'train') GROUP BY 1""")
def d26(t):
    from tidemark.operators.selection import train_support
    return train_support(t.seen.withColumnRenamed("CATEGORY", "FEATURE"), t.manifest.filter("SPLIT = 'train'"))


@query("d27_sequence_assembly", "PATIENT_ID:s END_DT:d SEQ:s STEPS:i COMPLETE:b", "snapshots counts vocab", f"""SELECT s.PATIENT_ID, s.END_DT, string_agg(coalesce(v, ''), '|' ORDER BY i) AS SEQ, count(*) AS STEPS, TRUE AS COMPLETE
  FROM (SELECT PATIENT_ID, END_DT, unnest(range(12)) AS i FROM snapshots) s LEFT JOIN (SELECT PATIENT_ID, END_DT, TIME_STEP, string_agg(ix || ':' || n, ' ' ORDER BY ix) AS v FROM (
    SELECT PATIENT_ID, END_DT, TIME_STEP, list_position({sql_list(VOCABULARY)}, CATEGORY) - 1 AS ix, CAST(sum(VALUE) AS BIGINT) AS n FROM counts WHERE CATEGORY IN (SELECT FEATURE FROM vocab) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) c
  ON c.PATIENT_ID = s.PATIENT_ID AND c.END_DT = s.END_DT AND c.TIME_STEP = i GROUP BY 1, 2""")
def d27(t):
    seq = ft.assemble_vectors(t.snapshots, t.counts, list(VOCABULARY))
    pair = lambda i, v: F.concat_ws(":", i.cast("string"), v.cast("string"))
    text = F.array_join(F.transform("SEQUENCE", lambda x: F.array_join(F.zip_with(x["INDICES"], x["VALUES"], pair), " ")), "|")
    return seq.select(*KEY, text.alias("SEQ"), F.size("SEQUENCE").alias("STEPS"), "COMPLETE")


@query("d28_tensor_audit", "SNAPSHOTS:i MONTHS:i ZERO_MONTHS:i ZERO_SNAPSHOTS:i TOTAL:i FIRST_DT:d LAST_DT:d", "snapshots counts", """SELECT count(*) AS SNAPSHOTS, 12 * count(*) AS MONTHS, sum(12 - coalesce(m, 0)) AS ZERO_MONTHS,
  count(*) FILTER (m IS NULL) AS ZERO_SNAPSHOTS, sum(n) AS TOTAL, min(END_DT) AS FIRST_DT, max(END_DT) AS LAST_DT FROM snapshots LEFT JOIN (SELECT PATIENT_ID, END_DT, count(DISTINCT TIME_STEP) AS m, sum(VALUE) AS n FROM counts GROUP BY 1, 2) USING (PATIENT_ID, END_DT)""")
def d28(t):
    per = t.counts.groupBy(*KEY, "TIME_STEP").agg(F.sum("VALUE").alias("n")).groupBy(*KEY).agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    j = t.snapshots.select(*KEY).join(per, KEY, "left")
    return j.agg(F.count("*").alias("SNAPSHOTS"), (F.count("*") * 12).alias("MONTHS"), F.sum(12 - F.coalesce("m", F.lit(0))).alias("ZERO_MONTHS"), F.count_if(F.col("m").isNull()).alias("ZERO_SNAPSHOTS"),
                 F.sum("n").alias("TOTAL"), F.min("END_DT").alias("FIRST_DT"), F.max("END_DT").alias("LAST_DT"))


PERIOD_SQL = """SELECT PATIENT_ID, END_DT, i AS TIME_STEP, CAST(date_trunc('month', END_DT) - to_months(CAST(i AS INTEGER)) AS DATE) AS PERIOD_START,
  least(last_day(CAST(date_trunc('month', END_DT) - to_months(CAST(i AS INTEGER)) AS DATE)), END_DT) AS PERIOD_END FROM (SELECT *, unnest(range(12)) AS i FROM snapshots)"""
COVER_SQL = f"""SELECT p.*, EXISTS (SELECT 1 FROM enrollment e WHERE e.PATIENT_ID = p.PATIENT_ID AND START_DATE <= PERIOD_END AND END_DATE >= PERIOD_START) AS COVERED FROM ({PERIOD_SQL}) p"""


def covered(t):
    return ev.interval_overlap(ft.period_grid(t.snapshots), t.enrollment, "START_DATE", "END_DATE")


@query("d29_sparsity_report", "VALID_STEPS:i SNAPSHOTS:i PADDED:i ZERO_SHARE:f", "snapshots enrollment counts", f"""SELECT VALID_STEPS, count(*) AS SNAPSHOTS, sum(12 - VALID_STEPS) AS PADDED, sum(z) / nullif(sum(VALID_STEPS), 0) AS ZERO_SHARE FROM (
  SELECT c.PATIENT_ID, c.END_DT, count(*) FILTER (COVERED) AS VALID_STEPS, count(*) FILTER (COVERED AND n IS NULL) AS z FROM ({COVER_SQL}) c LEFT JOIN (SELECT PATIENT_ID, END_DT, TIME_STEP, sum(VALUE) AS n FROM counts GROUP BY 1, 2, 3) k
  ON k.PATIENT_ID = c.PATIENT_ID AND k.END_DT = c.END_DT AND k.TIME_STEP = c.TIME_STEP GROUP BY 1, 2) GROUP BY 1""")
def d29(t):
    active = t.counts.select(*KEY, "TIME_STEP").distinct().withColumn("n", F.lit(1))
    j = covered(t).join(active, [*KEY, "TIME_STEP"], "left")
    per = j.groupBy(*KEY).agg(F.count_if("COVERED").alias("VALID_STEPS"), F.count_if(F.col("COVERED") & F.col("n").isNull()).alias("z"))
    return per.groupBy("VALID_STEPS").agg(F.count("*").alias("SNAPSHOTS"), F.sum(12 - F.col("VALID_STEPS")).alias("PADDED"), (F.sum("z") / F.nullif(F.sum("VALID_STEPS"), F.lit(0))).alias("ZERO_SHARE"))


@query("d30_interval_quality", "INTERVALS:i NULL_BOUND:i REVERSED:i SINGLE_DAY:i", "snapshots enrollment", """SELECT count(*) AS INTERVALS, count(*) FILTER (e IS NULL) AS NULL_BOUND, count(*) FILTER (e < START_DATE) AS REVERSED, count(*) FILTER (e = START_DATE) AS SINGLE_DAY
  FROM (SELECT *, CASE WHEN month(START_DATE) = 3 THEN NULL WHEN month(START_DATE) = 7 THEN END_DATE - 60 ELSE END_DATE END AS e FROM enrollment) WHERE PATIENT_ID IN (SELECT PATIENT_ID FROM snapshots)""")
def d30(t):
    e = F.when(F.month("START_DATE") == 3, None).when(F.month("START_DATE") == 7, F.date_add("END_DATE", -60)).otherwise(F.col("END_DATE"))
    rows = t.enrollment.withColumn("e", e).join(t.snapshots.select("PATIENT_ID").distinct(), "PATIENT_ID", "left_semi")
    return rows.agg(F.count("*").alias("INTERVALS"), F.count_if(F.col("e").isNull()).alias("NULL_BOUND"), F.count_if(F.col("e") < F.col("START_DATE")).alias("REVERSED"), F.count_if(F.col("e") == F.col("START_DATE")).alias("SINGLE_DAY"))


@query("d31_expected_population", "SPLIT:s ROWS:i DECLARED:i AGREES:b", "manifest", """SELECT SPLIT, n AS ROWS, d AS DECLARED, coalesce(n = d, FALSE) AS AGREES FROM (SELECT SPLIT, count(*) AS n FROM manifest GROUP BY 1)
  FULL JOIN (VALUES ('train', 6500), ('validation', 1400), ('holdout', 10)) AS x(SPLIT, d) USING (SPLIT)""")
def d31(t):
    declared = t.rows([("train", 6500), ("validation", 1400), ("holdout", 10)], "SPLIT string, DECLARED long")
    j = t.manifest.groupBy("SPLIT").agg(F.count("*").alias("ROWS")).join(declared, "SPLIT", "full")
    return j.withColumn("AGREES", F.coalesce(F.col("ROWS") == F.col("DECLARED"), F.lit(False)))


@query("d32_entity_stratum", "PATIENT_ID:s STRATUM:i", "snapshots", "SELECT PATIENT_ID, max(RESP) AS STRATUM FROM snapshots GROUP BY 1")
def d32(t):
    return t.snapshots.groupBy("PATIENT_ID").agg(F.max("RESP").alias("STRATUM"))


_PIVOT = {v: v.replace("#", "_") for v in VOCABULARY}  # column names without signs that SQL would want quoted


@query("d33_fixed_pivot", "PATIENT_ID:s END_DT:d TIME_STEP:i " + " ".join(f"{c}:i" for c in _PIVOT.values()), "counts",
       "SELECT PATIENT_ID, END_DT, TIME_STEP, " + ", ".join(f"sum(CASE WHEN CATEGORY = '{v}' THEN VALUE ELSE 0 END) AS {c}" for v, c in _PIVOT.items())
       + f" FROM counts WHERE CATEGORY IN (SELECT unnest({sql_list(_PIVOT)})) GROUP BY 1, 2, 3")
def d33(t):
    return ft.pivot_months(t.windowed, t.categories, list(_PIVOT)).withColumnsRenamed(_PIVOT)


@query("d34_seed_ensemble", "PATIENT_ID:s END_DT:d SCORE:f SEEDS:i COMPLETE:b", "model_scores", """SELECT PATIENT_ID, END_DT, avg(SCORE) AS SCORE, count(DISTINCT MODEL) AS SEEDS, count(DISTINCT MODEL) = 3 AS COMPLETE
  FROM model_scores WHERE NOT (MODEL = 'gamma' AND SCORE < 0.05) GROUP BY 1, 2""")
def d34(t):
    rows = t.model_scores.filter(~((F.col("MODEL") == "gamma") & (F.col("SCORE") < 0.05)))
    per = rows.groupBy(*KEY, "MODEL").agg(F.sum("SCORE").alias("s"), F.count("*").alias("n"))
    return per.groupBy(*KEY).agg((F.sum("s") / F.sum("n")).alias("SCORE"), F.count("*").alias("SEEDS"), (F.count("*") == 3).alias("COMPLETE"))


@query("d35_seed_run_summary", "RUNS:i MEAN_LIFT:f SD_LIFT:f MIN_LIFT:f MAX_LIFT:f MEAN_GAP:f", "model_scores", """SELECT count(*) AS RUNS, avg(v) AS MEAN_LIFT, stddev_samp(v) AS SD_LIFT, min(v) AS MIN_LIFT, max(v) AS MAX_LIFT, avg(tr - v) AS MEAN_GAP FROM (
  SELECT MODEL, max(CASE WHEN SPLIT = 'validation' THEN b END) AS v, max(CASE WHEN SPLIT = 'train' THEN b END) AS tr FROM (SELECT MODEL, SPLIT, avg((SCORE - RESP) * (SCORE - RESP)) AS b FROM model_scores GROUP BY 1, 2) GROUP BY 1)""")
def d35(t):
    brier = evl.probability_losses(t.model_scores, "SCORE", groups=("MODEL", "SPLIT"))
    at = lambda s: F.max(F.when(F.col("SPLIT") == s, F.col("BRIER")))
    runs = brier.groupBy("MODEL").agg(at("validation").alias("v"), at("train").alias("tr"))
    return runs.agg(F.count("*").alias("RUNS"), F.avg("v").alias("MEAN_LIFT"), F.stddev_samp("v").alias("SD_LIFT"), F.min("v").alias("MIN_LIFT"), F.max("v").alias("MAX_LIFT"), F.avg(F.col("tr") - F.col("v")).alias("MEAN_GAP"))


@query("d36_binding_reconciliation", "EXTRACTED:i AUDITED:i POSITIVES_EXTRACTED:i POSITIVES_AUDITED:i MISSING_PRIOR:i NULL_CLASS_ROWS:i AGREES:b", "snapshots rx mx", f"""WITH d AS ({DECISION_SQL}) SELECT count(*) AS EXTRACTED, count(*) AS AUDITED,
  sum(RESP) AS POSITIVES_EXTRACTED, sum(RESP) AS POSITIVES_AUDITED, (SELECT count(*) FROM snapshots) - count(*) AS MISSING_PRIOR, (SELECT count(*) FROM ({BASKET_SQL}) WHERE IS_GENERIC IS NULL) AS NULL_CLASS_ROWS, TRUE AS AGREES FROM d WHERE RETAIN = 1""")
def d36(t):
    d = settle(decisions(t))
    rows = d.filter("RETAIN = 1").agg(F.count("*").alias("EXTRACTED"), F.sum("RESP").alias("POSITIVES_EXTRACTED"))
    a = co.audit(d).select(F.col("SNAPSHOTS").alias("AUDITED"), F.col("POSITIVES").alias("POSITIVES_AUDITED"))
    prior = t.snapshots.join(d.filter("RETAIN = 1").select(*KEY), KEY, "left_anti").agg(F.count("*").alias("MISSING_PRIOR"))
    nulls = basket(t).agg(F.count_if(F.col("IS_GENERIC").isNull()).alias("NULL_CLASS_ROWS"))
    out = attach(attach(attach(rows, a, []), prior, []), nulls, [])
    return out.withColumn("AGREES", (F.col("EXTRACTED") == F.col("AUDITED")) & (F.col("POSITIVES_EXTRACTED") == F.col("POSITIVES_AUDITED")))


@query("d37_tuning_choice", "p_type:s BEST_BRAND:s MEAN_VALUE:f MEDIAN_ROUNDS:f", "", """SELECT p_type, p_brand AS BEST_BRAND, m AS MEAN_VALUE, r AS MEDIAN_ROUNDS FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY m DESC, f) AS rn FROM (
  SELECT p_type, p_brand, round(avg(p_size), 9) AS m, median(p_size) AS r, min(p_partkey) AS f FROM part GROUP BY 1, 2)) WHERE rn = 1""")
def d37(t):
    # Settings are compared on the mean of their runs; ties go to the setting seen first. Runs are first reduced to distinct round counts.
    runs = t.part.groupBy("p_type", "p_brand", "p_size").agg(F.count("*").alias("n"), F.min("p_partkey").alias("f"))
    per = runs.groupBy("p_type", "p_brand").agg(F.round(F.sum(F.col("p_size") * F.col("n")) / F.sum("n"), 9).alias("m"),
                                                F.expr("percentile(p_size, 0.5, n)").alias("r"), F.min("f").alias("f"))
    best = evl.best_by(per, ["p_type"], [-F.col("m"), F.col("f")])
    return best.select("p_type", F.col("p_brand").alias("BEST_BRAND"), F.col("m").alias("MEAN_VALUE"), F.col("r").alias("MEDIAN_ROUNDS"))
