"""Column expressions: identifiers, codes, hashes and strict parsing."""

from pyspark.sql import Column, functions as F

# A 60-bit and a 64-bit hash prefix are scaled to [0, 1) by these.
TWO_60 = float(2 ** 60)
TWO_64 = float(2 ** 64)


def hash_int(text: Column) -> Column:
    """First 60 bits of SHA-256 as a non-negative long."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def hash_unit(text: Column) -> Column:
    """Deterministic uniform in [0, 1), independent of row order and partitioning."""
    return hash_int(text) / F.lit(TWO_60)


def wide_hash_unit(text: Column) -> Column:
    """64-bit variant used where assignments must agree with an existing split."""
    prefix = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10)
    return prefix.cast("decimal(20,0)").cast("double") / F.lit(TWO_64)


def key_hash(*cols: str) -> Column:
    """SHA-256 of the compact JSON array of the key values (dates as ISO text)."""
    return F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in cols])), 256)


def clean_code(code: Column, family: Column) -> Column:
    """RX codes are trimmed; PX also upper-cased; DX additionally loses its dots."""
    trimmed = F.trim(code)
    return (F.when(family == "RX", trimmed)
            .when(family == "PX", F.upper(trimmed))
            .otherwise(F.replace(F.upper(trimmed), F.lit("."), F.lit(""))))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def deepest_level(*levels: Column) -> Column:
    """Most specific non-blank description; pass levels from broad to deep."""
    return F.coalesce(*[blank_to_null(x) for x in reversed(levels)])


def first_item(text: Column, delimiter: str = ",") -> Column:
    return F.trim(F.split_part(text, F.lit(delimiter), F.lit(1)))


def stable_name(text: Column, measure: str | None = None) -> Column:
    """Upper-case identifier, 160 characters at most, with a content hash so names never merge."""
    body = F.substring(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "_"), 1, 160)
    parts = [body, F.substring(F.sha2(text, 256), 1, 12)]
    return F.concat_ws("_", *parts, *([F.lit(measure)] if measure else []))


def strict_flag(text: Column) -> Column:
    """1/0 for 1, 0, TRUE and FALSE exactly; null marks a value that must be rejected."""
    return F.when(text.isin("1", "TRUE", "true"), 1).when(text.isin("0", "FALSE", "false"), 0)


def try_number(text: Column, low: float, high: float) -> tuple[Column, Column]:
    """Parsed double and its class: null, unparseable, non_finite, out_of_range or valid."""
    value = text.try_cast("double")
    infinite = F.isnan(value) | (F.abs(value) == float("inf"))
    kind = (F.when(text.isNull(), "null").when(value.isNull(), "unparseable").when(infinite, "non_finite")
            .when((value < low) | (value > high), "out_of_range").otherwise("valid"))
    return F.when(kind == "valid", value), kind


def birth_year(text: Column) -> Column:
    """Year from a plain number or from an ISO date text."""
    return F.coalesce(text.try_cast("int"), F.year(F.try_to_date(text, "yyyy-MM-dd")))


def total(condition: Column) -> Column:
    """Number of rows meeting a condition; null conditions count as not met."""
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")
