"""Events are dealt as packed lists in tasks of bounded size; what is counted from them equals hand-made results."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import association as asc, events as ev, features as ft, sequences as sq
from tidemark.plans import relations
from tidemark.plans.catalog import CATALOG
from tidemark.plans.relations import Tables

D = dt.date
FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture(scope="module")
def small(spark):
    snapshots = spark.createDataFrame([("a", D(2024, 3, 31)), ("a", D(2024, 2, 29)), ("b", D(2024, 3, 31))], "PATIENT_ID string, END_DT date")
    listed = spark.createDataFrame([("a", D(2024, 3, 1), [1, 2, 2]), ("a", D(2024, 2, 29), [1]), ("a", D(2023, 3, 31), [1]), ("b", D(2024, 4, 1), [2]), ("c", D(2024, 3, 1), [1])],
                                   "PATIENT_ID string, EVENT_DATE date, IDS array<int>")
    categories = ev.category_ids(spark.createDataFrame([("DX", "1", "DX_X"), ("DX", "2", "DX_X"), ("RX", "3", "RX_Y")], "FAMILY string, CODE string, CATEGORY string"))
    return ev.windowed_lists(snapshots, listed, 12, 3), categories


def test_cells_of_lists(small):
    got = sorted(tuple(r) for r in ev.monthly_cells(*small).collect())
    march, feb = D(2024, 3, 1), D(2024, 2, 29)
    assert got == [("a", feb, 0, "DX", "DX_X", 1, feb, feb), ("a", feb, 11, "DX", "DX_X", 1, D(2023, 3, 31), D(2023, 3, 31)), ("a", D(2024, 3, 31), 0, "DX", "DX_X", 1, march, march),
                   ("a", D(2024, 3, 31), 0, "RX", "RX_Y", 2, march, march), ("a", D(2024, 3, 31), 1, "DX", "DX_X", 1, feb, feb)]
    pivot = {(r.END_DT, r.TIME_STEP): (r.RX_Y, r.none) for r in ft.pivot_months(*small, ["RX_Y", "none"]).collect()}
    assert pivot == {(D(2024, 3, 31), 0): (2, 0)}


def test_tasks_grow_with_the_orders(spark, monkeypatch):
    # Before, the tasks of the counts were those of the session however large the data, and their aggregation tables spilled.
    monkeypatch.setattr(relations, "ORDERS_A_TASK", 50)
    t = Tables(spark, FOLDER)
    tasks = -(-t.orders.count() // 50)
    executed = t.counts._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(PATIENT_ID#\d+, (\d+)\), REPARTITION_BY_NUM", executed)
    assert len(dealt) == 2 and set(map(int, dealt)) == {tasks}


def test_one_scan_and_one_aggregation(spark):
    text = plan(Tables(spark, FOLDER).counts)
    # Before, lines were scanned once per source, occurrences shuffled one by one and grouped twice.
    assert text.count("l_shipdate") > 0 and len(re.findall(r"FileScan parquet \[l_", text)) == 1
    assert not re.search(r"hashpartitioning\([^)]*CATEGORY", text.split("Generate explode(IDS")[0])


@pytest.mark.parametrize("name", ["d26_train_support", "f05_vocabulary_cap", "j30_core_feature_set", "d05_recent_percentage", "d33_fixed_pivot"])
def test_no_monthly_cells_where_none_are_asked_for(spark, name):
    # Before, each of these grouped all occurrences by snapshot, step, family and category first.
    keys = re.findall(r"HashAggregate\(keys=\[([^\]]*)\]", plan(CATALOG[name].run(spark, FOLDER)))
    grouped = [{re.sub(r"#\d+L?", "", k).strip().split(" ")[-1] for k in found.split(",")} for found in keys]
    assert not [g for g in grouped if {"END_DT", "ID"} <= g or {"END_DT", "CATEGORY"} <= g]


def test_wide_block_summaries(spark):
    rows = spark.createDataFrame([("a", [1.0, None, None, 4.0], [True, False, False, True]), ("b", [None, None, None, None], [False, False, True, False])], "k string, v array<double>, h array<boolean>")
    at = lambda c, i: F.col(c)[i] if i < 4 else F.lit(None).cast("double") if c == "v" else F.lit(False)
    got = {r.k: r for r in sq.wide_block_summaries(rows, ["k"], [at("v", i) for i in range(12)], [at("h", i) for i in range(12)]).collect()}
    assert [got["a"].BLOCK_0, got["a"].BLOCK_1, got["a"].NEWEST_12] == pytest.approx([math.log(2), math.log(5), math.log(6)])
    assert got["b"].BLOCK_0 is None and got["b"].BLOCK_1 == 0.0 and got["b"].NEWEST_1 == 0.0 and got["b"].NEWEST_12 is None


def test_summaries_read_the_counts_once(spark):
    # Before, the counts were computed for the medians and once more for the sums.
    assert not re.search(r"FileScan parquet \[l_", plan(CATALOG["i08_temporal_summaries"].run(spark, FOLDER)))


def test_vectors_are_made_in_place(spark):
    rows = spark.createDataFrame([({"B": 2},), (None,)], "COUNTS map<string,long>")
    assert [r.X for r in rows.select(asc.log_vector(["A", "B"]).alias("X")).collect()] == [[0.0, pytest.approx(math.log(3))], [0.0, 0.0]]
    from tidemark.plans.associations import cv_rows
    # Before, every snapshot was written out as one row per feature and gathered again.
    assert "collect_list(struct(FEATURE" not in plan(cv_rows(Tables(spark, FOLDER)))
