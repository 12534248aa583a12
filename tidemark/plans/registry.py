"""Query catalogue: each operator's Spark plan next to an independent SQL statement of the same result.

Result columns are declared as `NAME:kind` with kind s(tring), i(nteger), f(loat, 6 digits), d(ate) or
b(oolean); both sides are projected through that declaration so types agree.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.plans.relations import Tables, with_relations

_SPARK = {"s": lambda c: F.col(c).cast("string"), "i": lambda c: F.col(c).cast("long"),
          "f": lambda c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0),
          "d": lambda c: F.col(c).cast("date").cast("string"), "b": lambda c: F.col(c).cast("boolean").cast("long")}
_SQL = {"s": "CAST({0} AS VARCHAR)", "i": "CAST({0} AS BIGINT)", "f": "ROUND(CAST({0} AS DOUBLE), 6) + 0.0",
        "d": "CAST(CAST({0} AS DATE) AS VARCHAR)", "b": "CAST(CAST({0} AS BOOLEAN) AS BIGINT)"}


@dataclass(frozen=True)
class Spec:
    name: str
    columns: tuple
    plan: Callable[[Tables], DataFrame]
    sql: str | None
    needs: str

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        result = self.plan(Tables(spark, sf_dir))
        return result.select(*[_SPARK[kind](name).alias(name) for name, kind in self.columns])

    def oracle(self) -> str:
        cols = ", ".join(f"{_SQL[kind].format(name)} AS {name}" for name, kind in self.columns)
        return with_relations(self.needs, f"SELECT {cols} FROM ({self.sql}) AS r")


CATALOG: dict[str, Spec] = {}


def query(name: str, columns: str, needs: str = "", sql: str | None = None):
    """Register a plan under `name`; `needs` lists the derived relations its SQL refers to."""
    def keep(plan):
        if name in CATALOG:
            raise ValueError(f"duplicate query {name}")
        CATALOG[name] = Spec(name, tuple(tuple(c.split(":")) for c in columns.split()), plan, sql, needs)
        return plan
    return keep


def row_sql(*columns: str) -> str:
    """SQL of a row's SHA-256 over text columns with lengths, nulls keeping their place."""
    return "sha256(" + " || ".join(f"coalesce('v' || length({c}) || ':' || {c}, 'n;')" for c in columns) + ")"


def hash_sql(row: str) -> str:
    """SQL of the order-free hash of rows: two sums over parts of each row's SHA-256."""
    return " || '-' || ".join(f"CAST(sum(CAST('0x' || substr({row}, {at}, 15) AS BIGINT)) AS VARCHAR)" for at in (1, 16))
