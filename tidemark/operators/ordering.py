"""Distributed running totals and ranks: no window ever holds a whole table or a whole hot group."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import settle

_PARTITION_SHIFT = 33  # fixed value: monotonically_increasing_id keeps the partition number above this bit


def running_totals(df: DataFrame, order: list, sums: dict[str, Column], groups: tuple = ()) -> DataFrame:
    """Add inclusive running sums per group along `order`, in two phases.

    Rows are range partitioned on (groups, order), so one group, even one holding most rows, is spread
    over many tasks. Each task sums its own stretch; the few per-stretch totals are accumulated and
    added back. `order` must be total for a deterministic result.
    """
    groups = list(groups)
    by = [F.col(g) for g in groups] + list(order)
    staged = df.select("*", *[c.alias(f"_x_{n}") for n, c in sums.items()])
    staged = staged.repartitionByRange(*by).sortWithinPartitions(*by)
    staged = settle(staged.withColumn("_at", F.monotonically_increasing_id()))
    staged = staged.withColumn("_part", F.shiftright("_at", _PARTITION_SHIFT))
    stretch = groups + ["_part"]
    before = W.partitionBy(*groups).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = staged.groupBy(*stretch).agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in sums])
    offsets = offsets.select(*stretch, *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = W.partitionBy(*stretch).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    local = staged.select("*", *[F.sum(f"_x_{n}").over(inside).alias(f"_l_{n}") for n in sums])
    return local.join(offsets, stretch).select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def ranked(df: DataFrame, order: list, name: str = "RANK", groups: tuple = ()) -> DataFrame:
    """1-based position along a total order, per group."""
    return running_totals(df, order, {name: F.lit(1).cast("long")}, groups)


def mid_ranks(values: DataFrame, value: str, weight: str, groups: tuple = ()) -> DataFrame:
    """Average ranks of tied values, from a table holding one row per distinct value.

    Adds MID_RANK = (weight below) + (weight + 1) / 2 for unit weights and
    MID_SHARE = (cumulative weight - weight / 2) / total weight for any weights.
    """
    groups = list(groups)
    run = running_totals(values, [F.col(value)], {"_cum": F.col(weight)}, tuple(groups))
    totals = run.groupBy(*groups).agg(F.sum(weight).alias("_all"))
    run = attach(run, totals, groups)
    w = F.col(weight)
    return run.select(*values.columns, (F.col("_cum") - w + (w + 1) / 2).alias("MID_RANK"),
                      ((F.col("_cum") - w / 2) / F.col("_all")).alias("MID_SHARE"))


def value_table(df: DataFrame, value: str, weight: str, key: list[str], groups: tuple = ()) -> DataFrame:
    """Collapse rows to distinct values before any ordering: weight sum and the weights at both tie edges."""
    key_tuple = F.struct(*key)
    return df.groupBy(*groups, value).agg(
        F.sum(weight).alias("W"), F.min_by(weight, key_tuple).alias("W_FIRST"),
        F.max_by(weight, key_tuple).alias("W_LAST"), F.count("*").alias("N"))


def weighted_quantiles(values: DataFrame, value: str, points: list[float], groups: tuple = ()) -> DataFrame:
    """Weighted quantiles by linear interpolation between the cumulative midpoints of single rows.

    Input is a `value_table`: between the first and the last row of a tie the curve is flat, so the
    two tie edges describe it exactly. Output: group columns, Q (point), QUANTILE.
    """
    groups = list(groups)
    run = running_totals(values, [F.col(value)], {"_cum": F.col("W")}, tuple(groups))
    totals = run.groupBy(*groups).agg(F.max("_cum").alias("_all"))
    edges = F.explode(F.array(F.col("_cum") - F.col("W") + F.col("W_FIRST") / 2,
                              F.col("_cum") - F.col("W_LAST") / 2))
    want = attach(run.select(*groups, F.col(value).cast("double").alias("_v"), edges.alias("_mid")), totals, groups)
    want = want.withColumn("Q", F.explode(F.array(*[F.lit(float(p)) for p in points])))
    target = F.col("Q") * F.col("_all")
    low = F.col("_mid") <= target
    # Bracketing points by their midpoint alone: numbers aggregate in hash tables, where structs would be sorted.
    under, over = F.when(low, F.col("_mid")), F.when(~low, F.col("_mid"))
    near = want.groupBy(*groups, "Q").agg(
        F.max(under).alias("lo"), F.max_by("_v", under).alias("lo_v"), F.min(over).alias("hi"), F.min_by("_v", over).alias("hi_v"),
        F.max(target).alias("target"))
    slope = (F.col("target") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    value_at = (F.when(F.col("lo").isNull(), F.col("hi_v")).when(F.col("hi").isNull(), F.col("lo_v"))
                .otherwise(F.col("lo_v") + slope * (F.col("hi_v") - F.col("lo_v"))))
    return near.select(*groups, "Q", value_at.alias("QUANTILE"))


def attach(df: DataFrame, totals: DataFrame, groups: list) -> DataFrame:
    """Join per-group totals; with no groups the single total row is read as one scalar subquery."""
    if groups:
        return df.join(totals, list(groups))
    one = totals.select(F.struct(*totals.columns)).scalar()
    return df.withColumn("_one", one).select("*", *[F.col(f"_one.{c}").alias(c) for c in totals.columns]).drop("_one")


def decile(rank: Column, rows: Column) -> Column:
    """Decile d ends at rank ceil(d * rows / 10); sizes differ from ntile."""
    return (F.floor((rank - 1) * 10 / rows) + 1).cast("int")
