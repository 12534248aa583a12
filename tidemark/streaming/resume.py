"""Incremental keyed batches: only keys absent from the store are computed."""

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.scalar import hash_int
from tidemark.operators.lineage import relation_hash


def missing_keys(requests: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    return requests.select(*key).distinct().join(store.select(*key), key, "left_anti")


def complete(requests: DataFrame, store: DataFrame, extractor: Callable[[DataFrame], DataFrame],
             key: list[str]) -> DataFrame:
    """Stored rows of the requested keys plus freshly extracted rows of the missing ones."""
    wanted = requests.select(*key).distinct()
    kept = store.join(wanted, key, "left_semi")
    return kept.unionByName(extractor(missing_keys(requests, store, key)).select(*store.columns))


def coverage(requested: DataFrame, returned: DataFrame, key: list[str]) -> DataFrame:
    """Missing, extra and duplicate keys of an extraction; all zero when it is exact."""
    a = requested.select(*key).distinct().withColumn("q", F.lit(1))
    b = returned.groupBy(*key).agg(F.count("*").alias("n"))
    j = a.join(b, key, "full")
    return j.agg(F.count_if(F.col("n").isNull()).alias("MISSING"), F.count_if(F.col("q").isNull()).alias("EXTRA"),
                 F.count_if(F.col("n") > 1).alias("DUPLICATE"))


def append_missing(requests: DataFrame, path: str, schema: str, extractor: Callable[[DataFrame], DataFrame],
                   key: list[str], chunk_no: int) -> int:
    """Persisted form: extract the missing keys, verify exact coverage, append as one chunk partition.

    A chunk is written to its own partition folder in overwrite mode, so a rerun after a failure repeats it.
    Returns the number of keys added.
    """
    spark = requests.sparkSession
    chunk = f"{path}/chunk_no={chunk_no}"
    try:
        store = spark.read.schema(schema + ", chunk_no int").parquet(path).filter(F.col("chunk_no") != chunk_no)
        todo = missing_keys(requests, store, key)
    except AnalysisException:
        todo = requests.select(*key).distinct()
    extractor(todo).write.mode("overwrite").parquet(chunk)
    written = spark.read.schema(schema).parquet(chunk)
    faults = coverage(todo, written, key).first()
    if any(faults):
        raise ValueError(f"chunk {chunk_no} does not cover its keys: {faults}")
    return written.select(*key).count()


class BatchStore:
    """Durable result of a keyed extraction, filled batch by batch and resumable at any point.

    Keys fall into a fixed number of batches by hash. A batch is extracted, written to its own folder, read back, checked (exactly its
    keys, each once) and then committed by a record of its row count and content hash. What has no record does not count: a run that was
    cut short while writing leaves a folder that the next run writes anew, and a committed batch is never extracted again. The first
    record's identity (requested keys, batch count, name of the extraction) must fit, so stores of other requests are refused.
    Only commit records, one per batch, reach the driver.
    """

    RECORD = "batch int, run string, rows long, hash string, identity string"

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], batches: int, name: str) -> None:
        self.spark, self.path, self.schema, self.key, self.batches, self.name = spark, path.rstrip("/"), schema, key, batches, name

    def _folder(self, batch: int) -> str:
        return f"{self.path}/rows/batch={batch}"

    def records(self) -> list:
        try:
            rows = self.spark.read.schema(self.RECORD).parquet(f"{self.path}/commits/*").collect()
        except AnalysisException:
            return []
        return sorted(rows, key=lambda r: r.batch)

    def _identity(self, requests: DataFrame) -> str:
        r = relation_hash(requests.select(*self.key)).first()
        return f"{self.name}|{','.join(self.key)}|{self.batches}|{r.ROWS}|{r.HASH}"

    def _intact(self, record) -> bool:
        found = relation_hash(self.spark.read.schema(self.schema).parquet(self._folder(record.batch))).first()
        return (found.ROWS, found.HASH) == (record.rows, record.hash)

    def run(self, requests: DataFrame, extractor: Callable[[DataFrame], DataFrame], run: str, most: int | None = None) -> list[int]:
        """Extract and commit the missing batches, at most `most` of them; returns their numbers."""
        wanted = requests.select(*self.key).distinct()
        identity, records = self._identity(wanted), self.records()
        if any(r.identity != identity for r in records):
            raise ValueError(f"{self.path} belongs to other requests")
        if damaged := [r.batch for r in records if not self._intact(r)]:
            raise ValueError(f"committed batches differ from their records: {damaged}")
        keyed = wanted.withColumn("batch", F.pmod(hash_int(F.concat_ws("|", *[F.col(k).cast("string") for k in self.key])), F.lit(self.batches)))
        todo = sorted(set(range(self.batches)) - {r.batch for r in records})[:most]
        for batch in todo:
            keys = keyed.filter(F.col("batch") == batch).select(*self.key)
            extractor(keys).write.mode("overwrite").parquet(self._folder(batch))
            written = self.spark.read.schema(self.schema).parquet(self._folder(batch))
            if any(faults := coverage(keys, written, self.key).first()):
                raise ValueError(f"batch {batch} does not cover its keys: {faults}")
            found = relation_hash(written).first()
            record = self.spark.createDataFrame([(batch, run, found.ROWS, found.HASH, identity)], self.RECORD)
            record.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/{batch}")
        return todo

    def read(self) -> DataFrame:
        """Rows of committed batches, with the batch and the run that extracted it."""
        records = self.records()
        columns = [*self.spark.createDataFrame([], self.schema).columns, "batch", "run"]
        if not records:
            return self.spark.createDataFrame([], self.schema + ", batch int, run string")
        rows = self.spark.read.schema(self.schema + ", batch int").option("basePath", f"{self.path}/rows").parquet(*[self._folder(r.batch) for r in records])
        runs = self.spark.createDataFrame([(r.batch, r.run) for r in records], "batch int, run string")
        return rows.join(F.broadcast(runs), "batch").select(*columns)  # one record per batch


def complete_entities(snapshots: DataFrame, done: DataFrame, entity: str, key: list[str]) -> DataFrame:
    """Snapshots of entities whose every snapshot is done."""
    marked = snapshots.join(done.select(*key).distinct().withColumn("_d", F.lit(1)), key, "left")
    whole = marked.groupBy(entity).agg(F.count("*").alias("n"), F.count("_d").alias("m")).filter("n = m")
    return snapshots.join(whole, entity, "left_semi")
