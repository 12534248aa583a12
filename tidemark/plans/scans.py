"""Section A: scans, sources and sinks."""

from pyspark.sql import functions as F

from tidemark.operators import evaluation as evl
from tidemark.plans.ranking import DECILE_TABLE
from tidemark.plans.registry import query
from tidemark.sources import sinks, tables
from tidemark.streaming import resume

_KEYED = """SELECT s.PATIENT_ID, s.END_DT, count(r.EVENT_ID) AS FILLS, max(r.FILL_DATE) AS LAST_FILL FROM snapshots s
  LEFT JOIN rx r ON r.PATIENT_ID = s.PATIENT_ID AND r.FILL_DATE <= s.END_DT
       AND r.FILL_DATE >= date_trunc('month', s.END_DT) - INTERVAL 11 MONTH GROUP BY 1, 2"""


def keyed_fills(t):
    """Keys-only extractor: fills in the twelve calendar months of each requested key."""
    from tidemark.operators import events as ev

    def extract(keys):
        days = t.rx.groupBy("PATIENT_ID", "FILL_DATE").agg(F.count("*").alias("n"))
        found = ev.asof_join(keys, days, "FILL_DATE").groupBy("PATIENT_ID", "END_DT").agg(
            F.sum("n").alias("FILLS"), F.max("FILL_DATE").alias("LAST_FILL"))
        return keys.join(found, ["PATIENT_ID", "END_DT"], "left").select(
            "PATIENT_ID", "END_DT", F.coalesce("FILLS", F.lit(0)).alias("FILLS"), "LAST_FILL")
    return extract


@query("a01_table_scan", "s_suppkey:i s_name:s s_nationkey:i s_acctbal:f", "", "SELECT * FROM supplier")
def a01(t):
    t.supplier.createOrReplaceTempView("scan_supplier")
    return tables.read_table(t.spark, "scan_supplier")


@query("a02_query_scan", "o_orderstatus:s N:i REVENUE:f", "", """SELECT o_orderstatus, count(*) AS N, sum(o_totalprice) AS REVENUE
  FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1""")
def a02(t):
    return tables.read_query(t.spark, "SELECT o_orderstatus, count(*) AS N, sum(o_totalprice) AS REVENUE FROM {orders} "
                             "WHERE o_orderdate >= TIMESTAMP_NTZ '1998-01-01' GROUP BY 1", orders=t.orders)


@query("a03_parquet_scan", "l_orderkey:i l_linenumber:i l_quantity:f", "",
       "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 48 AND l_returnflag = 'R'")
def a03(t):
    df = tables.read_parquet(t.spark, f"{t.sf_dir}/lineitem.parquet", tables.SCHEMAS["lineitem"])
    return df.filter("l_quantity > 48 AND l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query("a04_csv_literal_scan", "ID:s CODE:s", "", """SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS ID,
  CASE WHEN c_custkey % 5 = 0 THEN 'NA' WHEN c_custkey % 7 = 0 THEN 'NULL' ELSE c_mktsegment END AS CODE FROM customer""")
def a04(t):
    path = sinks.scratch_path(t.spark, "customers_csv")
    k = F.col("c_custkey")
    t.customer.select(F.lpad(k.cast("string"), 9, "0").alias("ID"), F.when(k % 5 == 0, "NA").when(k % 7 == 0, "NULL")
                      .otherwise(F.col("c_mktsegment")).alias("CODE")).write.option("header", True).csv(path)
    return tables.read_csv_literal(t.spark, path, ["ID", "CODE"])


@query("a09_create_only_export", "PATIENT_ID:s END_DT:d RESP:i", "snapshots", "SELECT PATIENT_ID, END_DT, RESP FROM snapshots")
def a09(t):
    return sinks.export_once(t.snapshots, sinks.scratch_path(t.spark, "snapshots"))


@query("a10_verified_publish", "ATTEMPT:i OUTCOME:s ROWS:i", "manifest", """SELECT ATTEMPT, OUTCOME, (SELECT count(*) FROM manifest) AS ROWS
  FROM (VALUES (1, 'created'), (2, 'unchanged')) AS v(ATTEMPT, OUTCOME)""")
def a10(t):
    path = sinks.scratch_path(t.spark, "published")
    outcomes = [sinks.publish(t.manifest, path), sinks.publish(t.manifest, path)]
    rows = t.spark.read.schema(t.manifest.schema).parquet(path).agg(F.count("*").alias("ROWS"))
    named = F.array(*[F.struct(F.lit(i + 1).alias("ATTEMPT"), F.lit(o).alias("OUTCOME")) for i, o in enumerate(outcomes)])
    return rows.select(F.inline(named), "ROWS")


@query("a11_chunked_payloads", "ARTIFACT_NAME:s CHUNK_INDEX:i CHUNK_COUNT:i BYTE_LENGTH:i SHA256:s PAYLOAD_BASE64:s", "", """
  SELECT CAST(page_id AS VARCHAR) AS ARTIFACT_NAME, i AS CHUNK_INDEX, n AS CHUNK_COUNT, strlen(html) AS BYTE_LENGTH, sha256(html) AS SHA256,
         substr(b, CAST(i * 2000 + 1 AS BIGINT), 2000) AS PAYLOAD_BASE64
  FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(1, CAST(ceil(length(b) / 2000.0) AS BIGINT)) AS n FROM (
    SELECT page_id, html, base64(encode(html)) AS b FROM pages)))""")
def a11(t):
    return sinks.to_chunks(t.pages, "page_id", "html", 2000)


@query("a11_reassembled_payloads", "ARTIFACT_NAME:s PAYLOAD:s VERIFIED:b", "",
       "SELECT CAST(doc_id AS VARCHAR) AS ARTIFACT_NAME, text AS PAYLOAD, TRUE AS VERIFIED FROM documents")
def a11b(t):
    return sinks.from_chunks(sinks.to_chunks(t.documents, "doc_id", "text", 4000))


@query("a12_chunk_inventory", "ARTIFACT_NAME:s MIN_CHUNK:i MAX_CHUNK:i CHUNK_ROWS:i DISTINCT_CHUNKS:i DECLARED_CHUNKS:i HASHES:i "
       "STORED_CHARACTERS:i BYTE_LENGTH:i", "", """
  SELECT CAST(doc_id AS VARCHAR) AS ARTIFACT_NAME, 0 AS MIN_CHUNK, n - 1 AS MAX_CHUNK, n AS CHUNK_ROWS, n AS DISTINCT_CHUNKS,
    n AS DECLARED_CHUNKS, 1 AS HASHES, c AS STORED_CHARACTERS, bytes AS BYTE_LENGTH FROM (SELECT doc_id, strlen(text) AS bytes,
    length(base64(encode(text))) AS c, greatest(1, CAST(ceil(length(base64(encode(text))) / 4000.0) AS BIGINT)) AS n FROM documents)""")
def a12(t):
    return sinks.chunk_inventory(sinks.to_chunks(t.documents, "doc_id", "text", 4000))


@query("a13_row_budget", "ROWS_SEEN:i WITHIN_BUDGET:b", "", "SELECT least(count(*), 5001) AS ROWS_SEEN, count(*) <= 5000 AS WITHIN_BUDGET FROM lineitem")
def a13(t):
    return tables.budget_report(t.lineitem.select("l_orderkey"), 5000)


_BATCHES = 4


@query("a14_resumable_extraction", "PATIENT_ID:s END_DT:d FILLS:i LAST_FILL:d BATCH:i RUN:s", "snapshots rx", f"""SELECT *, CASE WHEN BATCH < 2 THEN 'first' ELSE 'second' END AS RUN FROM (
  SELECT *, CAST('0x' || substr(sha256(PATIENT_ID || '|' || CAST(END_DT AS VARCHAR)), 1, 15) AS BIGINT) % {_BATCHES} AS BATCH FROM ({_KEYED}))""")
def a14(t):
    keys = t.snapshots.select("PATIENT_ID", "END_DT")
    store = resume.BatchStore(t.spark, sinks.scratch_path(t.spark, "fills"), "PATIENT_ID string, END_DT date, FILLS long, LAST_FILL date",
                              ["PATIENT_ID", "END_DT"], _BATCHES, "fills of twelve months")
    extract = keyed_fills(t)
    store.run(keys, extract, "first", most=2)  # as far as a run came that was cut short
    store.run(keys, extract, "second")
    return store.read().withColumnsRenamed({"batch": "BATCH", "run": "RUN"})


@query("a15_complete_entities", "PATIENT_ID:s END_DT:d", "snapshots", """SELECT PATIENT_ID, END_DT FROM snapshots WHERE PATIENT_ID NOT IN
  (SELECT PATIENT_ID FROM snapshots WHERE END_DT > DATE '1999-01-01' AND CAST(PATIENT_ID AS BIGINT) % 3 = 0)""")
def a15(t):
    done = t.snapshots.filter(~((F.col("END_DT") > "1999-01-01") & (F.col("PATIENT_ID").cast("long") % 3 == 0)))
    return resume.complete_entities(t.snapshots, done, "PATIENT_ID", ["PATIENT_ID", "END_DT"]).select("PATIENT_ID", "END_DT")


@query("a16_report_sink", "DECILE:i ROWS:i POSITIVES:i LIFT:f", "scored", DECILE_TABLE.replace("FROM scored", "FROM scored WHERE SPLIT = 'test'"))
def a16(t):
    path = sinks.scratch_path(t.spark, "deciles")
    table = evl.decile_table(t.scored.filter("SPLIT = 'test'"), "P_RESP1").select("DECILE", "ROWS", "POSITIVES", "LIFT")
    sinks.write_report(table, path)
    return t.spark.read.schema("DECILE int, ROWS long, POSITIVES long, LIFT double").option("header", True).csv(path)
