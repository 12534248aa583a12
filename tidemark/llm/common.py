"""What the operators of this folder share: inputs, tables kept in the cluster's shared folder, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words, as a class body of Java and RE2 patterns.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only a local master may go without: it then gets a folder of its own, as in tests.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark-llm/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, codec: str = "snappy", path: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    Cuts the lineage with rows that outlive any executor, and fixes what a later step must see unchanged (row keys,
    partition-wise sums). Callers of a long-lived session delete the folder `tidemark-llm` between runs.
    """
    path = path or fresh_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    # Spark removes shuffle files once the driver's garbage collector finds their plans dead. The rows are safe in the table now.
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Kept tables of one operator, dropped by name once all that reads them is kept itself. So none is gone that a retry needs."""

    def __init__(self, spark: SparkSession, prefix: str) -> None:
        self.spark, self.prefix = spark, prefix
        self.paths: dict[str, str] = {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        if name in self.paths:
            raise ValueError(f"{name} is still kept")
        self.paths[name] = fresh_path(self.spark, f"{self.prefix}-{name}")
        return keep(df, name, path=self.paths[name])

    def drop(self, *names: str) -> None:
        context = self.spark.sparkContext
        for name in names:
            path = context._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for null. split leaves empty strings at the ends only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
