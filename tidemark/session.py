"""Session defaults and the one place where lineage is cut."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "tidemark", **conf) -> SparkSession:
    """Session for tests and benchmarks; a cluster supplies its own and is used as given."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
               .config("spark.ui.showConsoleProgress", "false").config("spark.ui.enabled", "false"))
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may go without and then gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder; survives the loss of executors.

    Used where a later step refers to partition numbers or where a loop would let the plan grow.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def settle_table(df: DataFrame) -> DataFrame:
    """df as Parquet in the cluster's shared folder, for large tables that several passes read: compressed, which a checkpoint is not."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
