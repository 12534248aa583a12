"""Scans with declared schemas. Nothing is inferred; identifiers stay text."""

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def read_parquet(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """File or directory scan; filters and column choice reach the reader."""
    return spark.read.schema(schema).parquet(path)


def read_named(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet", SCHEMAS[name])


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Catalog table or temporary view."""
    return spark.table(name)


def read_query(spark: SparkSession, sql: str, **views: DataFrame) -> DataFrame:
    """SQL over the named views; the statement is planned together with its sources."""
    return spark.sql(sql, **views) if views else spark.sql(sql)


def read_warehouse_query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """Same contract for a JDBC warehouse: the statement runs at the source."""
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def read_csv_literal(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All-text CSV scan: NA, NULL and leading zeros are data, only an empty unquoted field is null."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").csv(path))


def within_budget(df: DataFrame, max_rows: int) -> DataFrame:
    """Row-budget guard: counts at most max_rows + 1 rows and refuses instead of truncating."""
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"source holds more than {max_rows} rows")
    return df


def budget_report(df: DataFrame, max_rows: int) -> DataFrame:
    """Lazy form of the guard: one row with the seen count and the verdict."""
    return (df.limit(max_rows + 1).agg(F.count("*").alias("ROWS_SEEN"))
            .withColumn("WITHIN_BUDGET", F.col("ROWS_SEEN") <= max_rows))
