"""Contracts as one-pass violation counts, exact-coverage joins and population audits."""

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.scalar import total

KEY = ["PATIENT_ID", "END_DT"]


def violations(df: DataFrame, checks: dict[str, Column], *extra: Column) -> DataFrame:
    """One row: number of rows failing each named check, from a single scan."""
    return df.agg(F.count("*").alias("ROWS"), *[total(c).alias(n) for n, c in checks.items()], *extra)


def require_clean(report: DataFrame, ignore: tuple = ("ROWS",)) -> None:
    """Fail when a one-row violation report is not all zero."""
    found = {k: v for k, v in report.first().asDict().items() if k not in ignore and v}
    if found:
        raise ValueError(f"contract violations: {found}")


def exact_date(text: Column) -> Column:
    """True for a real calendar date written as YYYY-MM-DD without a time part."""
    return F.coalesce(text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def snapshot_key_report(df: DataFrame, entity: str, date: str) -> DataFrame:
    """Null, blank and padded ids, inexact dates and excess duplicate keys. Keys are pre-aggregated."""
    e, d = F.col(entity), F.col(date)
    per_key = df.groupBy(entity, date).agg(F.count("*").alias("n"))
    def add(c):
        return F.coalesce(F.sum(F.when(c, F.col("n")).otherwise(0)), F.lit(0))
    return per_key.agg(
        F.sum("n").alias("ROWS"), add(e.isNull()).alias("NULL_ID"), add(F.trim(e) == "").alias("BLANK_ID"),
        add((F.trim(e) != e) & (F.trim(e) != "")).alias("PADDED_ID"), add(~exact_date(d)).alias("BAD_DATE"),
        F.sum(F.col("n") - 1).alias("DUPLICATE_EXCESS"))


def normalise_split(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("val", "valid"), "validation").otherwise(low)


ALLOWED_SPLITS = ("train", "validation", "test")


def encode_business(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """AGE ceil(x/10); Binary x>0; Numeric 1 above the cap, else x/(cap+1). Nulls stay null.

    df holds (.., FEATURE, VALUE); parameters (FEATURE, KIND, CAP) is one row per declared feature.
    """
    v, cap = F.col("VALUE"), F.col("CAP")
    coded = (F.when(v.isNull(), None).when(F.col("KIND") == "AGE", F.ceil(v / 10).cast("double"))
             .when(F.col("KIND") == "Binary", (v > 0).cast("double"))
             .when(F.col("KIND") == "Numeric", F.when(v > cap, 1.0).otherwise(v / (cap + 1))))
    return df.join(parameters, "FEATURE").withColumn("ENCODED", coded)


def parameter_report(parameters: DataFrame) -> DataFrame:
    """Encoding-parameter contract per name: uniqueness, finite non-negative cap, declared type."""
    finite = F.col("CAP").isNotNull() & ~F.isnan("CAP") & (F.abs("CAP") < float("inf")) & (F.col("CAP") >= 0)
    return parameters.groupBy("FEATURE").agg(
        F.count("*").alias("DECLARED"), total(~F.coalesce(finite, F.lit(False))).alias("BAD_CAP"),
        total(~F.coalesce(F.col("KIND").isin("AGE", "Binary", "Numeric"), F.lit(False))).alias("BAD_KIND"),
    ).withColumn("STATUS", F.when(F.col("DECLARED") > 1, "duplicate").when(F.col("BAD_CAP") > 0, "bad_cap")
                 .when(F.col("BAD_KIND") > 0, "bad_kind").otherwise("ok"))


def json_names(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Ordered names of a JSON array column: (keep.., POSITION, FEATURE)."""
    return df.select(*keep, F.posexplode(F.from_json(F.col(column), "array<string>")).alias("POSITION", "FEATURE"))


def reconcile_lists(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two ordered name lists (NAME, POSITION): side, repeats and order agreement per name."""
    def side(df, tag):
        return df.groupBy("NAME").agg(F.min("POSITION").alias(f"{tag}_POSITION"), F.count("*").alias(f"{tag}_TIMES"))
    j = side(left, "LEFT").join(side(right, "RIGHT"), "NAME", "full")
    status = (F.when(F.col("RIGHT_TIMES").isNull(), "only_left").when(F.col("LEFT_TIMES").isNull(), "only_right")
              .when((F.col("LEFT_TIMES") > 1) | (F.col("RIGHT_TIMES") > 1), "duplicate")
              .when(F.col("LEFT_POSITION") == F.col("RIGHT_POSITION"), "same_position").otherwise("moved"))
    return j.select("NAME", "LEFT_POSITION", "RIGHT_POSITION", status.alias("STATUS"))


def match_dictionary(names: DataFrame, entries: DataFrame) -> DataFrame:
    """Match NAME to ENTRY exactly, else by the visible prefix of a clipped entry when that is unique.

    entries: (ENTRY, CLIPPED boolean). Names expand to their own prefixes, so the prefix test is an
    equi-join; an entry already used exactly, or fitting several names, is not used again.
    """
    exact = names.join(entries.select(F.col("ENTRY").alias("NAME"), F.col("ENTRY")), "NAME")
    open_names = names.join(exact, "NAME", "left_anti")
    open_entries = entries.filter("CLIPPED").join(exact.select("ENTRY"), "ENTRY", "left_anti").select("ENTRY")
    prefixes = open_names.select("NAME", F.explode(F.sequence(F.lit(1), F.length("NAME"))).alias("k")).select(
        "NAME", F.substring(F.col("NAME"), F.lit(1), F.col("k")).alias("ENTRY"))
    pairs = prefixes.join(open_entries, "ENTRY")
    single_name = pairs.groupBy("NAME").agg(F.count("*").alias("a"), F.min("ENTRY").alias("ENTRY")).filter("a = 1")
    single_entry = pairs.groupBy("ENTRY").agg(F.count("*").alias("b")).filter("b = 1")
    found = single_name.join(single_entry, "ENTRY").select("NAME", "ENTRY", F.lit("prefix").alias("MATCH"))
    matched = exact.select("NAME", "ENTRY", F.lit("exact").alias("MATCH")).unionByName(found)
    return names.join(matched, "NAME", "left").withColumn("MATCH", F.coalesce("MATCH", F.lit("none")))


def key_alignment(left: DataFrame, right: DataFrame, key: list[str], label: str) -> DataFrame:
    """Both directions at once: missing, extra, label differences, duplicates and bad labels."""
    def side(df, tag):
        return df.groupBy(*key).agg(F.count("*").alias(f"n_{tag}"), F.min(label).alias(f"y_{tag}"),
                                    F.max(label).alias(f"z_{tag}"))
    j = side(left, "l").join(side(right, "r"), key, "full")
    both = F.col("n_l").isNotNull() & F.col("n_r").isNotNull()
    return j.agg(
        total(both).alias("MATCHED"), total(F.col("n_r").isNull()).alias("MISSING"),
        total(F.col("n_l").isNull()).alias("EXTRA"),
        total(both & ~F.col("y_l").eqNullSafe(F.col("y_r"))).alias("LABEL_MISMATCH"),
        total(F.col("n_l") > 1).alias("DUPLICATE_LEFT"), total(F.col("n_r") > 1).alias("DUPLICATE_RIGHT"),
        total(F.col("n_r").isNotNull() & (F.col("y_r").isNull() | ~F.col("y_r").isin(0, 1)
                                          | ~F.col("z_r").isin(0, 1))).alias("BAD_LABEL"))


def exact_join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """One-to-one join keeping both sides, with STATUS matched / missing / extra / duplicate."""
    r = right.withColumn("_r", F.lit(1))
    times = right.groupBy(*key).agg(F.count("*").alias("_n"))
    j = left.withColumn("_l", F.lit(1)).join(r.join(times, key), key, "full")
    status = (F.when(F.col("_r").isNull(), "missing").when(F.col("_l").isNull(), "extra")
              .when(F.col("_n") > 1, "duplicate").otherwise("matched"))
    return j.withColumn("STATUS", status).drop("_l", "_r", "_n")
