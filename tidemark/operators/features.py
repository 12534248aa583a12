"""Feature maps, sequences and per-snapshot summaries."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.calendar import asof_date

KEY = ["PATIENT_ID", "END_DT"]


def feature_map(names: DataFrame) -> DataFrame:
    """Contiguous index and F%04d alias by name. The vocabulary is small by contract, one row per feature."""
    index = F.row_number().over(W.orderBy("FEATURE_NAME")) - 1
    return names.withColumn("FEATURE_INDEX", index).withColumn("FEATURE_COLUMN", F.format_string("F%04d", F.col("FEATURE_INDEX")))


def steps(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def spine(snapshots: DataFrame, n: int = 12) -> DataFrame:
    """Each snapshot once per step, expanded in place.

    Spark sizes the rows as if they were not expanded and would send them to the driver for a broadcast, hence the hint.
    """
    return snapshots.withColumn("TIME_STEP", steps(n)).hint("merge")


def filled_spine(snapshots: DataFrame, counts: DataFrame, n: int = 12) -> DataFrame:
    """Monthly totals with inactive months kept as zero."""
    per = counts.groupBy(*KEY, "TIME_STEP").agg(F.sum("VALUE").alias("VALUE"))
    return spine(snapshots.select(*KEY), n).join(per, [*KEY, "TIME_STEP"], "left").fillna(0, ["VALUE"])


def pivot_months(lists: DataFrame, categories: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Wide monthly table over a declared vocabulary, from event lists: one aggregation, no long table before it."""
    place = F.array_position(F.array(*[F.lit(v) for v in vocabulary]), F.col("CATEGORY")).cast("int")
    declared = categories.select("ID", place.alias("_p")).filter("_p > 0")
    rows = lists.withColumn("ID", F.explode("IDS")).join(F.broadcast(declared), "ID")
    return rows.groupBy(*KEY, "TIME_STEP").agg(*[F.count_if(F.col("_p") == i).alias(v) for i, v in enumerate(vocabulary, 1)])


def assemble(rows: DataFrame, step: str, values: list[str], n: int) -> DataFrame:
    """One ordered array of steps per snapshot; COMPLETE when each step occurs exactly once."""
    items = F.array_sort(F.collect_list(F.struct(F.col(step), F.array(*[F.col(v) for v in values]).alias("V"))))
    out = rows.groupBy(*KEY).agg(items.alias("SEQUENCE"))
    return out.withColumn("COMPLETE", F.transform("SEQUENCE", lambda x: x[step]) == F.sequence(F.lit(0), F.lit(n - 1)))


def assemble_vectors(snapshots: DataFrame, counts: DataFrame, names: list[str], n: int = 12) -> DataFrame:
    """One sparse feature vector per step and snapshot: SEQUENCE of (TIME_STEP, INDICES, VALUES), steps without activity empty.

    Indices are places in `names`. A snapshot gathers its active cells only, at most n times the vocabulary; nothing is padded before
    the shuffle. COMPLETE when no cell lies outside the n steps.
    """
    index = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("CATEGORY")) - 1
    cells = counts.filter(F.col("CATEGORY").isin(*names)).groupBy(*KEY, "TIME_STEP", index.cast("int").alias("i")).agg(F.sum("VALUE").alias("v"))
    own = cells.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("TIME_STEP", "i", "v"))).alias("CELLS"))
    kept = F.coalesce("CELLS", F.array().cast(own.schema["CELLS"].dataType))

    def step(s):
        at = F.filter("CELLS", lambda c: c["TIME_STEP"] == s)
        return F.struct(s.alias("TIME_STEP"), F.transform(at, lambda c: c["i"]).alias("INDICES"), F.transform(at, lambda c: c["v"]).alias("VALUES"))
    out = snapshots.select(*KEY).join(own, KEY, "left").withColumn("CELLS", kept)
    inside = F.forall("CELLS", lambda c: c["TIME_STEP"].between(0, n - 1))
    return out.select(*KEY, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), step).alias("SEQUENCE"), inside.alias("COMPLETE"))


def asof_grid(snapshots: DataFrame, policy: str, n: int = 12) -> DataFrame:
    """(snapshot, step, AS_OF_DATE)."""
    return spine(snapshots.select(*KEY), n).withColumn("AS_OF_DATE", asof_date(F.col("END_DT"), F.col("TIME_STEP"), policy))


def period_grid(snapshots: DataFrame, n: int = 12) -> DataFrame:
    """Monthly periods of a snapshot, the newest ending at the cutoff."""
    rows = spine(snapshots.select(*KEY), n)
    start = F.add_months(F.trunc("END_DT", "month"), -F.col("TIME_STEP"))
    return rows.withColumn("PERIOD_START", start).withColumn("PERIOD_END", F.least(F.last_day(start), F.col("END_DT")))


def quarters(periods: DataFrame, covered: str | None = None) -> DataFrame:
    """Quarter q joins months 3q..3q+2: outer bounds and the OR of their masks."""
    aggs = [F.min("PERIOD_START").alias("PERIOD_START"), F.max("PERIOD_END").alias("PERIOD_END")]
    if covered:
        aggs.append(F.bool_or(covered).alias(covered))
    return periods.groupBy(*KEY, F.floor(F.col("TIME_STEP") / 3).cast("int").alias("QUARTER")).agg(*aggs)


def distinct_requests(grid: DataFrame) -> DataFrame:
    """Unique (entity, as-of date) pairs: overlapping snapshots share their months."""
    return grid.select("PATIENT_ID", "AS_OF_DATE").distinct()
