"""Sparse histograms, tie edges and Gram sums equal those of the written-out cells."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import association as asc, ordering as od

NAMES = ("ALL", "NONE", "HEAD", "TAIL", "MIX", "MANY")
KEY = ["PATIENT_ID", "END_DT"]


@pytest.fixture(scope="module", params=[1, 7, 60])
def both(request, spark):
    """(sparse rows, written-out cells) of a table whose features lack zeros, hold nothing else, or start or end with other values."""
    n, rng = request.param, random.Random(request.param)
    rows = []
    for i in range(n):
        cells = {"ALL": 1 + i % 3, "HEAD": 2 if i < n // 2 else 0, "TAIL": 1 if i >= n // 3 else 0, "MIX": rng.choice([0, 0, 1, 4]),
                 "MANY": rng.choice([0, 1, 1, 2, 3]), "OTHER": 9}
        cells = {k: v for k, v in cells.items() if v}
        rows.append((f"p{i // 2:03d}", dt.date(2024, 1, 1 + i % 2), rng.randint(0, 1), 1.0 + i % 5, cells if i != 3 else None))
    packed = spark.createDataFrame(rows, "PATIENT_ID string, END_DT date, RESP int, WEIGHT double, COUNTS map<string,long>")
    dense = packed.select(*KEY, "RESP", "WEIGHT", F.explode(F.array(*[F.lit(x) for x in NAMES])).alias("FEATURE"), "COUNTS").withColumn(
        "VALUE", F.coalesce(F.try_element_at("COUNTS", "FEATURE"), F.lit(0)).cast("double")).drop("COUNTS")
    return asc.sparse_rows(packed, NAMES), dense


def same(a, b):
    a, b = (sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.collect()) for x in (a, b))
    assert a == b


def test_histograms_and_value_tables(both):
    sparse, dense = both
    columns = ["FEATURE", "RESP", "VALUE", "W", "N"]
    same(asc.sparse_histogram(sparse, "RESP", weight="WEIGHT").select(columns), asc.histogram(dense, "FEATURE", "RESP").select(columns))
    columns = ["FEATURE", "VALUE", "W", "W_FIRST", "W_LAST", "N"]
    same(asc.sparse_value_table(sparse).select(columns), od.value_table(dense, "VALUE", "WEIGHT", KEY, ("FEATURE",)).select(columns))


def test_association_measures(both):
    sparse, dense = both
    hist = asc.sparse_histogram(sparse, "RESP", weight="WEIGHT")
    same(asc.rank_correlation_of(hist), asc.rank_correlation(dense, "WEIGHT"))
    same(asc.presence_of(hist), asc.presence_association(dense))
    same(asc.discrete_information(hist), asc.discrete_mutual_information(dense))


def test_gram_sums(both, monkeypatch):
    sparse, dense = both
    x = {r.PATIENT_ID + str(r.END_DT): r.X for r in asc.vectors(dense, "VALUE", list(NAMES)).collect()}
    x = np.hstack([np.ones((len(x), 1)), np.array(list(x.values()))])
    want = {(i, j): v for (i, j), v in np.ndenumerate(x.T @ x) if i <= j}
    for matrix in (asc.sparse_gram(sparse), asc.gram(asc.vectors(dense, "VALUE", list(NAMES)), "X", len(NAMES))):
        got = {(r.I, r.J): r.S for r in matrix.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    ranked = asc.correlated_pairs(asc.vectors(asc.with_ranks(dense), "MID_RANK", list(NAMES)), "X", list(NAMES), 0.1)
    same(asc.pairs_of(asc.sparse_rank_gram(sparse), NAMES, 0.1), ranked)
    monkeypatch.setattr(asc, "RANK_TABLE", 1)
    assert asc.sparse_rank_gram(sparse) is None


def test_duplicate_search_shuffles_candidates_only(spark):
    """Cells of features whose fingerprint no other feature has leave before the comparison, and the pairs are those of all cells."""
    rows = spark.range(300).selectExpr("cast(id as string) as PATIENT_ID", "date'2020-01-31' as END_DT", "cast(id % 7 as double) as a", "cast(id % 5 as double) as c",
                                       "if(id = 3, null, cast(id % 7 as double)) as d")
    rows = rows.selectExpr("PATIENT_ID", "END_DT", "stack(5, 'A', a, 'B', a, 'C', c, 'D', d, 'E', d) as (FEATURE, VALUE)")
    found = asc.duplicate_features(rows)
    assert sorted(map(tuple, found.select("FEATURE", "DUPLICATE_OF").collect())) == [("B", "A"), ("E", "D")]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
