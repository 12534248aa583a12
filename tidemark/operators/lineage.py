"""Content fingerprints, change checks and the experiment ledger."""

from pyspark.sql import Column, DataFrame, functions as F


def _field(name: str, kind: str) -> Column:
    """A value with its length before it; a null keeps its place, so values cannot move between columns unseen."""
    column = F.col(f"`{name}`")
    if kind == "binary":
        text = F.base64(column)
    else:
        text = F.to_json(column) if kind.startswith(("array", "map", "struct")) else column.cast("string")
    return F.coalesce(F.concat(F.lit("v"), F.char_length(text).cast("string"), F.lit(":"), text), F.lit("n;"))


def relation_hash(df: DataFrame, *by: str) -> DataFrame:
    """Row count and order-free hash, per group where named: two sums over parts of a SHA-256 per row, so repeated rows do not cancel."""
    row = F.sha2(F.concat(F.lit(""), *[_field(name, kind) for name, kind in df.dtypes]), 256)
    parts = [F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16)]
    return df.groupBy(*by).agg(F.count("*").alias("ROWS"), F.concat_ws("-", *parts).alias("HASH"))


def digest(df: DataFrame, line: Column) -> DataFrame:
    """Ordered canonical digest of unique lines, as a tree over the first 6 and 3 hex digits of the line hash.

    A leaf sorts about rows / 16.7 million lines, an inner node and the root at most 4096 digests each.
    """
    def fold(name):
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", name))), lambda x: x[name]), "\n"), 256)
    lines = df.select(line.alias("l")).withColumn("b", F.substring(F.sha2("l", 256), 1, 6))
    leaf = lines.groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("l")), "\n"), 256).alias("h"), F.count("*").alias("n"))
    node = leaf.groupBy(F.substring("b", 1, 3).alias("c")).agg(fold("h").alias("h"), F.sum("n").alias("n"))
    return node.withColumnRenamed("c", "b").agg(F.sum("n").alias("ROWS"), fold("h").alias("DIGEST"))


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows lost and gained between two states of a relation, multiplicities included."""
    columns = before.columns
    a = before.groupBy(*columns).agg(F.count("*").alias("a"), F.lit(0).cast("long").alias("b"))
    b = after.select(*columns).groupBy(*columns).agg(F.lit(0).cast("long").alias("a"), F.count("*").alias("b"))
    both = a.unionByName(b).groupBy(*columns).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return both.agg(F.coalesce(F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))), F.lit(0)).alias("LOST"),
                    F.coalesce(F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))), F.lit(0)).alias("GAINED"))


def ledger(results: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Check reported lifts and attach deltas to the baseline row of the same comparison block.

    Input: BLOCK, MODEL, IS_BASELINE, ROWS, POSITIVES, SELECTED, CAPTURED, REPORTED_LIFT.
    """
    lift = (F.col("CAPTURED") / F.col("SELECTED")) / (F.col("POSITIVES") / F.col("ROWS"))
    checked = results.withColumn("LIFT", lift).withColumn(
        "CONSISTENT", F.abs(F.col("REPORTED_LIFT") - F.col("LIFT")) <= tolerance)
    base = checked.filter("IS_BASELINE").select("BLOCK", F.col("LIFT").alias("BASE_LIFT"),
                                                F.col("CAPTURED").alias("BASE_CAPTURED"))
    return checked.join(base, "BLOCK", "left").select(
        "BLOCK", "MODEL", "LIFT", "CONSISTENT", (F.col("LIFT") - F.col("BASE_LIFT")).alias("DELTA_LIFT"),
        (F.col("CAPTURED") - F.col("BASE_CAPTURED")).alias("ADDITIONAL_CAPTURES"))
