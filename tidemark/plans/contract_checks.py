"""Section B: projections, predicates and contracts."""

from pyspark.sql import functions as F

from tidemark.functions import scalar as sc
from tidemark.operators import contracts as ct, events as ev
from tidemark.plans.registry import query


@query("b01_snapshot_key_contract", "ROWS:i NULL_ID:i BLANK_ID:i PADDED_ID:i BAD_DATE:i DUPLICATE_EXCESS:i", "dirty", """
  SELECT count(*) AS ROWS, count(*) FILTER (ID_TXT IS NULL) AS NULL_ID, count(*) FILTER (trim(ID_TXT) = '') AS BLANK_ID,
    count(*) FILTER (trim(ID_TXT) <> ID_TXT AND trim(ID_TXT) <> '') AS PADDED_ID,
    count(*) FILTER (NOT (regexp_full_match(DATE_TXT, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(DATE_TXT AS DATE) IS NOT NULL)) AS BAD_DATE,
    count(*) - count(DISTINCT (coalesce(ID_TXT, '<null>'), DATE_TXT)) AS DUPLICATE_EXCESS FROM dirty""")
def b01(t):
    return ct.snapshot_key_report(t.dirty, "ID_TXT", "DATE_TXT")


@query("b02_strict_binary_label", "ROWS:i BAD_LABEL:i NULL_LABEL:i", "dirty", """SELECT count(*) AS ROWS,
  count(*) FILTER (RESP_TXT NOT IN ('0', '1')) AS BAD_LABEL, count(*) FILTER (RESP_TXT IS NULL) AS NULL_LABEL FROM dirty""")
def b02(t):
    y = F.col("RESP_TXT")
    return ct.violations(t.dirty, {"BAD_LABEL": ~y.isin("0", "1"), "NULL_LABEL": y.isNull()})


@query("b03_split_normalisation", "SPLIT:s ROWS:i ALLOWED:b", "dirty", """SELECT s AS SPLIT, count(*) AS ROWS, s IN ('train', 'validation', 'test') AS ALLOWED
  FROM (SELECT CASE WHEN lower(trim(SPLIT_TXT)) IN ('val', 'valid') THEN 'validation' ELSE lower(trim(SPLIT_TXT)) END AS s FROM dirty) GROUP BY s""")
def b03(t):
    return (t.dirty.groupBy(ct.normalise_split(F.col("SPLIT_TXT")).alias("SPLIT")).agg(F.count("*").alias("ROWS"))
            .withColumn("ALLOWED", F.col("SPLIT").isin(*ct.ALLOWED_SPLITS)))


@query("b04_code_normalisation", "FAMILY:s CODE:s N:i", "", """SELECT FAMILY, CASE FAMILY WHEN 'RX' THEN trim(raw) WHEN 'PX' THEN upper(trim(raw))
  ELSE replace(upper(trim(raw)), '.', '') END AS CODE, count(*) AS N FROM (
  SELECT ['RX', 'PX', 'DX'][p_partkey % 3 + 1] AS FAMILY, ' ' || lower(p_brand) || '.' || p_size || ' ' AS raw FROM part) GROUP BY 1, 2""")
def b04(t):
    raw = F.concat(F.lit(" "), F.lower("p_brand"), F.lit("."), F.col("p_size").cast("string"), F.lit(" "))
    fam = F.element_at(F.array(F.lit("RX"), F.lit("PX"), F.lit("DX")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.groupBy(fam.alias("FAMILY"), sc.clean_code(raw, fam).alias("CODE")).agg(F.count("*").alias("N"))


@query("b05_deepest_level", "LEVEL:s N:i", "", """SELECT coalesce(nullif(trim(l4), ''), nullif(trim(l3), ''), nullif(trim(l2), ''), nullif(trim(l1), '')) AS LEVEL,
  count(*) AS N FROM (SELECT p_type AS l1, p_brand AS l2, CASE WHEN p_size > 10 THEN p_name ELSE ' ' END AS l3,
  CASE WHEN p_size > 40 THEN p_name || '/' || p_size END AS l4 FROM part) GROUP BY 1""")
def b05(t):
    l3 = F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(" ")
    l4 = F.when(F.col("p_size") > 40, F.concat_ws("/", "p_name", "p_size"))
    level = sc.deepest_level(F.col("p_type"), F.col("p_brand"), l3, l4)
    return t.part.groupBy(level.alias("LEVEL")).agg(F.count("*").alias("N"))


@query("b06_first_list_item", "ITEM:s N:i", "", "SELECT trim(split_part(replace(p_name, ' ', ' ,'), ',', 1)) AS ITEM, count(*) AS N FROM part GROUP BY 1")
def b06(t):
    return t.part.groupBy(sc.first_item(F.replace("p_name", F.lit(" "), F.lit(" ,"))).alias("ITEM")).agg(F.count("*").alias("N"))


@query("b07_strict_boolean", "FLAG:i ROWS:i REJECTED:i", "dirty", """SELECT f AS FLAG, count(*) AS ROWS, count(*) FILTER (f IS NULL) AS REJECTED FROM (
  SELECT CASE WHEN FLAG_TXT IN ('1', 'TRUE', 'true') THEN 1 WHEN FLAG_TXT IN ('0', 'FALSE', 'false') THEN 0 END AS f FROM dirty) GROUP BY f""")
def b07(t):
    return t.dirty.select(sc.strict_flag(F.col("FLAG_TXT")).alias("FLAG")).groupBy("FLAG").agg(
        F.count("*").alias("ROWS"), F.count_if(F.col("FLAG").isNull()).alias("REJECTED"))


@query("b08_safe_numeric", "KIND:s ROWS:i VALUE_SUM:f", "dirty", """SELECT KIND, count(*) AS ROWS, sum(CASE WHEN KIND = 'valid' THEN v END) AS VALUE_SUM FROM (
  SELECT v, CASE WHEN NUM_TXT IS NULL THEN 'null' WHEN v IS NULL THEN 'unparseable' WHEN isnan(v) OR isinf(v) THEN 'non_finite'
  WHEN v < 0 OR v > 4000 THEN 'out_of_range' ELSE 'valid' END AS KIND FROM (SELECT NUM_TXT, try_cast(NUM_TXT AS DOUBLE) AS v FROM dirty)) GROUP BY KIND""")
def b08(t):
    value, kind = sc.try_number(F.col("NUM_TXT"), 0, 4000)
    return t.dirty.select(kind.alias("KIND"), value.alias("v")).groupBy("KIND").agg(
        F.count("*").alias("ROWS"), F.sum("v").alias("VALUE_SUM"))


@query("b09_birth_year", "BIRTH_YEAR:i N:i", "dirty", """SELECT coalesce(try_cast(BIRTH_TXT AS INTEGER), year(try_cast(BIRTH_TXT AS DATE))) AS BIRTH_YEAR,
  count(*) AS N FROM dirty GROUP BY 1""")
def b09(t):
    return t.dirty.groupBy(sc.birth_year(F.col("BIRTH_TXT")).alias("BIRTH_YEAR")).agg(F.count("*").alias("N"))


@query("b10_paid_predicate", "BRANCH:s MEMBERS:i", "rx", """SELECT BRANCH, count(*) AS MEMBERS FROM (
  SELECT DISTINCT 'CHANNEL' AS BRANCH, PATIENT_ID, CHANNEL AS m FROM rx WHERE RESULT IN ('A', 'N')
  UNION SELECT DISTINCT 'PRESCRIBER', PATIENT_ID, PRESCRIBER_NPI FROM rx WHERE RESULT IN ('A', 'N')
  UNION SELECT DISTINCT 'RESULT', PATIENT_ID, RESULT FROM rx) GROUP BY BRANCH""")
def b10(t):
    paid = F.col("RESULT").isin("A", "N")
    branch = lambda name, col, keep: F.struct(F.lit(name).alias("BRANCH"), F.col(col).alias("m"), keep.alias("keep"))
    rows = t.rx.select("PATIENT_ID", F.inline(F.array(
        branch("CHANNEL", "CHANNEL", paid), branch("PRESCRIBER", "PRESCRIBER_NPI", paid), branch("RESULT", "RESULT", F.lit(True)))))
    return rows.filter("keep").select("BRANCH", "PATIENT_ID", "m").distinct().groupBy("BRANCH").agg(F.count("*").alias("MEMBERS"))


@query("b11_availability_predicate", "event_type:s N:i LAST_AVAILABLE:s", "", """SELECT event_type, count(*) AS N, strftime(max(a), '%Y-%m-%d %H:%M:%S') AS LAST_AVAILABLE
  FROM (SELECT event_type, ts + to_hours(CAST(event_id % 72 AS INTEGER)) AS a FROM events) WHERE a < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1""")
def b11(t):
    available = F.expr("ts + make_dt_interval(0, cast(event_id % 72 as int), 0, 0)")
    end = F.lit("2024-01-15").cast("date")
    rows = t.events.select("event_type", available.alias("a")).filter(F.col("a") < F.date_add(end, 1).cast("timestamp_ntz"))
    return rows.groupBy("event_type").agg(F.count("*").alias("N"), F.date_format(F.max("a"), "yyyy-MM-dd HH:mm:ss").alias("LAST_AVAILABLE"))


@query("b12_value_list_filter", "event_type:s user_id:i N:i", "", """SELECT event_type, user_id, count(*) AS N FROM events
  WHERE event_type IN ('click', 'purchase') AND CAST(user_id AS VARCHAR) IN ('1', '2', '3', '5', '8') GROUP BY 1, 2""")
def b12(t):
    keep = F.col("event_type").isin("click", "purchase") & F.col("user_id").cast("string").isin("1", "2", "3", "5", "8")
    return t.events.filter(keep).groupBy("event_type", "user_id").agg(F.count("*").alias("N"))


@query("b14_stable_feature_name", "p_partkey:i NAME:s", "", """SELECT p_partkey, substr(regexp_replace(upper(x), '[^A-Z0-9]+', '_', 'g'), 1, 160) || '_' ||
  substr(sha256(x), 1, 12) || '_COUNT' AS NAME FROM (SELECT p_partkey, p_brand || ' / ' || p_name AS x FROM part)""")
def b14(t):
    return t.part.select("p_partkey", sc.stable_name(F.concat_ws(" / ", "p_brand", "p_name"), "COUNT").alias("NAME"))


_PARAMS = [("AGE", "AGE", None), ("FLAG", "Binary", None), ("SIZE", "Numeric", 30.0)]
_PARAM_SQL = "(VALUES ('AGE', 'AGE', NULL), ('FLAG', 'Binary', NULL), ('SIZE', 'Numeric', 30.0)) AS p(FEATURE, KIND, CAP)"


@query("b15_business_encoding", "p_partkey:i FEATURE:s ENCODED:f", "", f"""SELECT p_partkey, v.FEATURE, CASE WHEN VALUE IS NULL THEN NULL
  WHEN KIND = 'AGE' THEN ceil(VALUE / 10.0) WHEN KIND = 'Binary' THEN CASE WHEN VALUE > 0 THEN 1.0 ELSE 0.0 END
  WHEN VALUE > CAP THEN 1.0 ELSE VALUE / (CAP + 1) END AS ENCODED FROM (
    SELECT p_partkey, 'AGE' AS FEATURE, CAST(p_size AS DOUBLE) AS VALUE FROM part UNION ALL SELECT p_partkey, 'FLAG', p_size - 25 FROM part
    UNION ALL SELECT p_partkey, 'SIZE', CASE WHEN p_partkey % 11 <> 0 THEN p_size END FROM part) v JOIN {_PARAM_SQL} ON p.FEATURE = v.FEATURE""")
def b15(t):
    size = F.col("p_size").cast("double")
    value = lambda name, v: F.struct(F.lit(name).alias("FEATURE"), v.alias("VALUE"))
    tall = t.part.select("p_partkey", F.inline(F.array(value("AGE", size), value("FLAG", size - 25),
                                                       value("SIZE", F.when(F.col("p_partkey") % 11 != 0, size)))))
    return ct.encode_business(tall, t.rows(_PARAMS, "FEATURE string, KIND string, CAP double"))


@query("b16_parameter_contract", "FEATURE:s DECLARED:i BAD_CAP:i BAD_KIND:i STATUS:s", "", """SELECT *, CASE WHEN DECLARED > 1 THEN 'duplicate' WHEN BAD_CAP > 0 THEN 'bad_cap'
  WHEN BAD_KIND > 0 THEN 'bad_kind' ELSE 'ok' END AS STATUS FROM (SELECT p_name || p_partkey % 9 AS FEATURE, count(*) AS DECLARED, count(*) FILTER (p_size < 5) AS BAD_CAP,
  count(*) FILTER (p_type = 'LARGE') AS BAD_KIND FROM part GROUP BY 1)""")
def b16(t):
    kind = F.when(F.col("p_type") == "LARGE", "Other").otherwise("Numeric")
    return ct.parameter_report(t.part.select(F.concat("p_name", (F.col("p_partkey") % 9).cast("string")).alias("FEATURE"),
                                             kind.alias("KIND"), (F.col("p_size") - 5).cast("double").alias("CAP")))


@query("b17_json_feature_list", "p_brand:s FEATURE:s POSITIONS:i FORBIDDEN:b DUPLICATE:b", "", """SELECT p_brand, FEATURE, count(DISTINCT pos) AS POSITIONS,
  FEATURE IN ('OLD', 'NEW') AS FORBIDDEN, count(*) > 10 AS DUPLICATE FROM (SELECT p_brand, unnest([0, 1]) AS pos, upper(unnest(string_split(p_name, ' '))) AS FEATURE FROM part) GROUP BY 1, 2""")
def b17(t):
    text = F.concat(F.lit('["'), F.replace("p_name", F.lit(" "), F.lit('","')), F.lit('"]'))
    names = ct.json_names(t.part.select("p_brand", text.alias("j")), "j", ["p_brand"]).withColumn("FEATURE", F.upper("FEATURE"))
    once = names.groupBy("p_brand", "FEATURE", "POSITION").agg(F.count("*").alias("n"))
    return once.groupBy("p_brand", "FEATURE").agg(
        F.count("*").alias("POSITIONS"), F.first(F.col("FEATURE").isin("OLD", "NEW")).alias("FORBIDDEN"),
        (F.sum("n") > 10).alias("DUPLICATE"))


@query("b18_list_reconciliation", "NAME:s LEFT_POSITION:i RIGHT_POSITION:i STATUS:s", "", """SELECT NAME, l.p AS LEFT_POSITION, r.p AS RIGHT_POSITION,
  CASE WHEN r.n IS NULL THEN 'only_left' WHEN l.n IS NULL THEN 'only_right' WHEN l.n > 1 OR r.n > 1 THEN 'duplicate' WHEN l.p = r.p THEN 'same_position' ELSE 'moved' END AS STATUS
  FROM (SELECT p_brand || p_name AS NAME, min(p_partkey) AS p, count(*) AS n FROM part WHERE p_size <= 25 GROUP BY 1) l
  FULL JOIN (SELECT p_brand || p_name AS NAME, min(p_partkey + CASE WHEN p_size < 30 THEN 0 ELSE 1 END) AS p, count(*) AS n FROM part WHERE p_size >= 20 GROUP BY 1) r USING (NAME)""")
def b18(t):
    name = F.concat("p_brand", "p_name").alias("NAME")
    moved = F.col("p_partkey") + F.when(F.col("p_size") < 30, 0).otherwise(1)
    return ct.reconcile_lists(t.part.filter("p_size <= 25").select(name, F.col("p_partkey").alias("POSITION")),
                              t.part.filter("p_size >= 20").select(name, moved.alias("POSITION")))


@query("b19_feature_map_contract", "FAMILY:s FEATURES:i LOW:i HIGH:i CONTIGUOUS:b ALIAS_OK:b", "code_map", """SELECT FAMILY, count(*) AS FEATURES, min(i) AS LOW, max(i) AS HIGH,
  max(i) - min(i) + 1 = count(*) AS CONTIGUOUS, bool_and(regexp_full_match(printf('F%04d', i), 'F\\d{4}')) AS ALIAS_OK
  FROM (SELECT FAMILY, CATEGORY, CAST(row_number() OVER (ORDER BY CATEGORY) - 1 AS INTEGER) AS i FROM (SELECT DISTINCT FAMILY, CATEGORY FROM code_map)) GROUP BY FAMILY""")
def b19(t):
    from tidemark.operators.features import feature_map
    fmap = feature_map(t.code_map.select("FAMILY", F.col("CATEGORY").alias("FEATURE_NAME")).distinct())
    return fmap.groupBy("FAMILY").agg(
        F.count("*").alias("FEATURES"), F.min("FEATURE_INDEX").alias("LOW"), F.max("FEATURE_INDEX").alias("HIGH"),
        (F.max("FEATURE_INDEX") - F.min("FEATURE_INDEX") + 1 == F.count("*")).alias("CONTIGUOUS"),
        F.bool_and(F.col("FEATURE_COLUMN").rlike(r"^F\d{4}$")).alias("ALIAS_OK"))


@query("b21_long_aggregate_validity", "ROWS:i NULL_FIELD:i BAD_STEP:i BAD_VALUE:i OUT_OF_BIN:i AFTER_CUTOFF:i", "counts", """SELECT count(*) AS ROWS, 0 AS NULL_FIELD,
  count(*) FILTER (CATEGORY = 'RX_BIG' AND TIME_STEP = 11) AS BAD_STEP, count(*) FILTER (VALUE = 3) AS BAD_VALUE,
  count(*) FILTER (CATEGORY = 'RX_BIG' AND TIME_STEP = 11) AS OUT_OF_BIN, 0 AS AFTER_CUTOFF FROM counts""")
def b21(t):
    seeded = t.counts.withColumn("VALUE", F.when(F.col("VALUE") == 3, 2.5).otherwise(F.col("VALUE").cast("double"))).withColumn(
        "TIME_STEP", F.when((F.col("CATEGORY") == "RX_BIG") & (F.col("TIME_STEP") == 11), 12).otherwise(F.col("TIME_STEP")))
    v, step = F.col("VALUE"), F.col("TIME_STEP")
    return ct.violations(seeded, {
        "NULL_FIELD": F.col("CATEGORY").isNull() | v.isNull() | step.isNull(), "BAD_STEP": ~step.between(0, 11),
        "BAD_VALUE": (v <= 0) | (v != F.floor(v)) | (v != v.cast("float").cast("double")),
        "OUT_OF_BIN": (ev.step_of("FIRST_EVENT_DATE") != step) | (ev.step_of("LAST_EVENT_DATE") != step),
        "AFTER_CUTOFF": F.col("LAST_EVENT_DATE") > F.col("END_DT")})


@query("b22_asof_panel_validity", "ROWS:i UNOBSERVED_VALUE:i OBSERVED_NULL:i BAD_COUNT:i BAD_BINARY:i FUTURE_EVENT:i", "panel", """SELECT count(*) AS ROWS,
  count(*) FILTER (NOT obs AND F_COUNT IS NOT NULL) AS UNOBSERVED_VALUE, count(*) FILTER (obs AND F_COUNT IS NULL) AS OBSERVED_NULL,
  count(*) FILTER (F_COUNT < 0 OR F_COUNT <> floor(F_COUNT)) AS BAD_COUNT, count(*) FILTER (F_BINARY NOT IN (0, 1)) AS BAD_BINARY,
  count(*) FILTER (MAX_EVENT_DATE > END_DT) AS FUTURE_EVENT FROM (SELECT *, IS_OBSERVED AND NOT (SPLIT = 'test' AND F_COUNT > 8) AS obs FROM panel)""")
def b22(t):
    obs = F.col("IS_OBSERVED") & ~F.coalesce((F.col("SPLIT") == "test") & (F.col("F_COUNT") > 8), F.lit(False))
    seen = F.col("F_COUNT").isNotNull()
    return ct.violations(t.panel, {
        "UNOBSERVED_VALUE": ~obs & seen, "OBSERVED_NULL": obs & ~seen,
        "BAD_COUNT": (F.col("F_COUNT") < 0) | (F.col("F_COUNT") != F.floor("F_COUNT")),
        "BAD_BINARY": ~F.col("F_BINARY").isin(0, 1), "FUTURE_EVENT": F.col("MAX_EVENT_DATE") > F.col("END_DT")})


@query("b23_count_tensor_validity", "ROWS:i NEGATIVE:i FRACTIONAL:i NON_FINITE:i NONZERO_PADDING:i", "dense", """SELECT count(*) AS ROWS, 0 AS NEGATIVE, 0 AS FRACTIONAL, 0 AS NON_FINITE,
  count(*) FILTER (VALUE <> 0 AND END_DT < DATE '1997-01-01') AS NONZERO_PADDING FROM dense""")
def b23(t):
    v = F.col("VALUE")
    return ct.violations(t.dense, {
        "NEGATIVE": v < 0, "FRACTIONAL": v != F.floor(v), "NON_FINITE": F.isnan(v) | (F.abs(v) == float("inf")),
        "NONZERO_PADDING": (v != 0) & (F.col("END_DT") < "1997-01-01")})


@query("b24_raw_long_validity", "ROWS:i BAD_ANNUAL:i BAD_RECENT:i BAD_WINDOW:i REPEATED:i", "snapshots rx", """SELECT count(*) AS ROWS, 0 AS BAD_ANNUAL,
  count(*) FILTER (r > n) AS BAD_RECENT, 0 AS BAD_WINDOW, 0 AS REPEATED FROM (SELECT s.PATIENT_ID, s.END_DT, r.CHANNEL, count(DISTINCT PRESCRIBER_NPI) AS n,
  count(DISTINCT CASE WHEN FILL_DATE BETWEEN END_DT - INTERVAL 4 MONTH AND END_DT - INTERVAL 1 MONTH THEN PRESCRIBER_NPI END) AS r
  FROM snapshots s JOIN rx r ON r.PATIENT_ID = s.PATIENT_ID AND FILL_DATE BETWEEN END_DT - INTERVAL 12 MONTH AND END_DT GROUP BY 1, 2, 3)""")
def b24(t):
    from tidemark.plans.aggregates import distinct_prescribers
    rows = distinct_prescribers(t)
    per = rows.groupBy("PATIENT_ID", "END_DT", "CATEGORY").agg(
        F.count("*").alias("n"), F.first("VALUE").alias("VALUE"), F.first("RECENT_VALUE").alias("RECENT_VALUE"),
        F.max("MAX_EVENT_DATE").alias("MAX_EVENT_DATE"))
    return ct.violations(per, {
        "BAD_ANNUAL": F.col("VALUE") <= 0, "BAD_RECENT": (F.col("RECENT_VALUE") < 0) | (F.col("RECENT_VALUE") > F.col("VALUE")),
        "BAD_WINDOW": ~F.col("MAX_EVENT_DATE").between(F.add_months("END_DT", -12), F.col("END_DT")), "REPEATED": F.col("n") > 1})


@query("b25_score_range", "ROWS:i OUT_OF_RANGE:i NOT_FINITE:i NULL_SCORE:i", "scored", """SELECT count(*) AS ROWS, count(*) FILTER (p < 0 OR p > 1) AS OUT_OF_RANGE, 0 AS NOT_FINITE,
  count(*) FILTER (p IS NULL) AS NULL_SCORE FROM (SELECT CASE WHEN P_RESP1 > 0.05 THEN P_RESP1 * 1.1 END AS p FROM scored)""")
def b25(t):
    p = F.when(F.col("P_RESP1") > 0.05, F.col("P_RESP1") * 1.1)
    return ct.violations(t.scored.select(p.alias("p")), {
        "OUT_OF_RANGE": ~F.col("p").between(0, 1), "NOT_FINITE": F.isnan("p") | (F.abs("p") == float("inf")),
        "NULL_SCORE": F.col("p").isNull()})


@query("b26_dictionary_match", "NAME:s ENTRY:s MATCH:s", "", """WITH names AS (SELECT DISTINCT p_name AS NAME FROM part),
  entries AS (SELECT DISTINCT CASE WHEN length(p_name) > 9 THEN substr(p_name, 1, 9) ELSE p_name END AS ENTRY, length(p_name) > 9 AS CLIPPED FROM part WHERE p_size % 2 = 0),
  ex AS (SELECT DISTINCT NAME, ENTRY FROM names JOIN entries ON NAME = ENTRY),
  pairs AS (SELECT NAME, ENTRY FROM names n JOIN entries e ON CLIPPED AND starts_with(NAME, ENTRY) WHERE NAME NOT IN (SELECT NAME FROM ex) AND ENTRY NOT IN (SELECT ENTRY FROM ex)),
  pre AS (SELECT * FROM pairs WHERE NAME IN (SELECT NAME FROM pairs GROUP BY 1 HAVING count(*) = 1) AND ENTRY IN (SELECT ENTRY FROM pairs GROUP BY 1 HAVING count(*) = 1))
  SELECT NAME, coalesce(ex.ENTRY, pre.ENTRY) AS ENTRY, CASE WHEN ex.ENTRY IS NOT NULL THEN 'exact' WHEN pre.ENTRY IS NOT NULL THEN 'prefix' ELSE 'none' END AS MATCH
  FROM names LEFT JOIN ex USING (NAME) LEFT JOIN pre USING (NAME)""")
def b26(t):
    clipped = F.length("p_name") > 9
    entries = t.part.filter("p_size % 2 = 0").select(
        F.when(clipped, F.substring("p_name", 1, 9)).otherwise(F.col("p_name")).alias("ENTRY"), clipped.alias("CLIPPED")).distinct()
    return ct.match_dictionary(t.part.select(F.col("p_name").alias("NAME")).distinct(), entries)
