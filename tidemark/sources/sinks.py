"""Create-only and verified exports, chunked payload tables and aggregate reports."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.lineage import relation_hash
from tidemark.session import shared_folder

CHUNK_CHARACTERS = 50_000  # fixed value: base64 characters per stored chunk


def scratch_path(spark: SparkSession, name: str) -> str:
    """New folder below the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/tidemark/{uuid.uuid4().hex}/{name}"


def export_once(df: DataFrame, path: str) -> DataFrame:
    """Write a new parquet export; an existing one is never touched."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _filesystem(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(df: DataFrame, path: str) -> str:
    """Immutable publish: `created`, or `unchanged` when the same content is already there.

    New content is staged beside the destination, verified by fingerprint and renamed into place.
    """
    spark = df.sparkSession
    expected = relation_hash(df).first()
    try:
        present = spark.read.schema(df.schema).parquet(path)
    except AnalysisException:
        present = None
    if present is not None:
        if relation_hash(present).first() != expected:
            raise ValueError(f"{path} already holds different content")
        return "unchanged"
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(staging)
    if relation_hash(spark.read.schema(df.schema).parquet(staging)).first() != expected:
        raise ValueError("staged content differs from its source; the source is not deterministic")
    source, fs = _filesystem(spark, staging)
    target, _ = _filesystem(spark, path)
    if not fs.rename(source, target):
        raise ValueError(f"{path} appeared while publishing")
    return "created"


def to_chunks(df: DataFrame, name: str, payload: str, size: int = CHUNK_CHARACTERS) -> DataFrame:
    """Whole payloads as fixed-size base64 chunks with index, count, byte length and hash."""
    data = F.encode(F.col(payload), "UTF-8")
    text = F.base64(data)
    full = df.select(
        F.col(name).cast("string").alias("ARTIFACT_NAME"), F.octet_length(data).cast("long").alias("BYTE_LENGTH"),
        F.sha2(data, 256).alias("SHA256"), F.regexp_replace(text, "[\r\n]", "").alias("_b64"))
    count = F.greatest(F.lit(1), F.ceil(F.length("_b64") / size)).cast("int")
    full = full.withColumn("CHUNK_COUNT", count).withColumn(
        "CHUNK_INDEX", F.explode(F.sequence(F.lit(0), F.col("CHUNK_COUNT") - 1)))
    return full.withColumn("PAYLOAD_BASE64", F.substring(
        F.col("_b64"), F.col("CHUNK_INDEX") * size + 1, F.lit(size))).drop("_b64")


def from_chunks(chunks: DataFrame) -> DataFrame:
    """Re-assemble payloads; VERIFIED is false, and the payload null, when a chunk is missing, repeated or altered."""
    parts = chunks.groupBy("ARTIFACT_NAME").agg(
        F.array_sort(F.collect_list(F.struct("CHUNK_INDEX", "PAYLOAD_BASE64"))).alias("parts"),
        F.count("*").alias("n"), F.count_distinct("CHUNK_INDEX").alias("d"), F.max("CHUNK_COUNT").alias("want"),
        F.min("SHA256").alias("SHA256"), F.max("SHA256").alias("h2"), F.max("BYTE_LENGTH").alias("BYTE_LENGTH"))
    data = F.try_to_binary(F.array_join(F.col("parts.PAYLOAD_BASE64"), ""), F.lit("base64"))
    parts = parts.withColumn("data", data)
    good = ((F.col("n") == F.col("want")) & (F.col("d") == F.col("want")) & (F.col("SHA256") == F.col("h2"))
            & (F.sha2("data", 256) == F.col("SHA256")) & (F.octet_length("data") == F.col("BYTE_LENGTH")))
    good = F.coalesce(good, F.lit(False))
    return parts.select("ARTIFACT_NAME", F.when(good, F.decode("data", "UTF-8")).alias("PAYLOAD"), good.alias("VERIFIED"))


def chunk_inventory(chunks: DataFrame) -> DataFrame:
    """Integrity figures per artifact: chunk range, distinct chunks, hashes and stored bytes."""
    return chunks.groupBy("ARTIFACT_NAME").agg(
        F.min("CHUNK_INDEX").alias("MIN_CHUNK"), F.max("CHUNK_INDEX").alias("MAX_CHUNK"),
        F.count("*").alias("CHUNK_ROWS"), F.count_distinct("CHUNK_INDEX").alias("DISTINCT_CHUNKS"),
        F.max("CHUNK_COUNT").alias("DECLARED_CHUNKS"), F.count_distinct("SHA256").alias("HASHES"),
        F.sum(F.length("PAYLOAD_BASE64")).alias("STORED_CHARACTERS"), F.max("BYTE_LENGTH").alias("BYTE_LENGTH"))


def write_report(table: DataFrame, path: str, fmt: str = "csv") -> None:
    """Aggregate report as one CSV or JSON file; tables carrying entity rows are refused."""
    if "PATIENT_ID" in table.columns:
        raise ValueError("reports hold aggregates only")
    writer = table.coalesce(1).write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)
