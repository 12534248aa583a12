"""Expanded snapshots stay out of the driver, and windows joined by entity give the rows of those joined by month."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as ev, features as ft, text as tx
from tidemark.plans.catalog import CATALOG
from tidemark.plans.relations import Tables

D = dt.date
FOLDER = "/root/testdata/sf0.001"


def joins(df):
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line]


@pytest.mark.parametrize("name", ["c06_interval_overlap", "d29_sparsity_report", "i04_quarter_union", "i06_panel_to_sequence", "i07_representations",
                                  "i17_code_tokens", "i24_history_reuse", "l09_apply_donor_trajectories"])
def test_expanded_snapshots_are_not_broadcast(spark, name):
    found = joins(CATALOG[name].run(spark, FOLDER))
    assert found
    # Before, a join on the month, step or as-of date sent the expanded snapshots through the driver.
    assert not [line for line in found if "Broadcast" in line and any(f"{key}#" in line for key in ("MONTH", "TIME_STEP", "AS_OF_DATE"))]


def test_snapshots_meet_counts_without_broadcast(spark):
    t = Tables(spark, FOLDER)
    plan = t.counts._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "sequence(0, 11" not in plan
    assert all("Broadcast" not in line for line in joins(ft.spine(t.snapshots).join(t.orders.select(F.col("o_custkey").cast("string").alias("PATIENT_ID")), "PATIENT_ID"))[:1])


def test_long_and_short_windows_agree(spark, monkeypatch):
    snaps = spark.createDataFrame([("a", D(2024, 3, 31), 1), ("a", D(2024, 2, 15), 0), ("a", D(2024, 2, 15), 5), ("b", D(2024, 1, 1), 1), (None, D(2024, 1, 1), 1)],
                                  "PATIENT_ID string, END_DT date, k int")
    days = [D(2023, 1, 31), D(2023, 3, 1), D(2023, 4, 1), D(2023, 8, 9), D(2024, 2, 15), D(2024, 2, 16), D(2024, 3, 31), D(2024, 4, 1), None]
    rows = spark.createDataFrame([(p, d, i) for p in ("a", "b", "c", None) for i, d in enumerate(days)], "PATIENT_ID string, d date, n int")
    columns = ["PATIENT_ID", "END_DT", "k", "TIME_STEP", "d", "n"]
    found = []
    for few in (0, 99):
        monkeypatch.setattr(ev, "FEW_STEPS", few)
        for steps, start in ((12, None), (13, F.add_months("END_DT", -12))):
            found.append(sorted(map(tuple, ev.asof_join(snaps, rows, "d", steps, start).select(columns).collect())))
    assert found[:2] == found[2:] and found[0] and found[1]


def test_code_maps_by_size(spark):
    small = spark.range(5).withColumnRenamed("id", "CODE")
    assert "broadcast" in ev.sendable(small)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in ev.sendable(small, 4)._jdf.queryExecution().analyzed().toString().lower()


def test_fan_out_by_entity_equals_the_grid(spark):
    snaps = spark.createDataFrame([("a", D(2024, 3, 31)), ("a", D(2024, 3, 15)), ("a", D(2024, 2, 29)), ("b", D(2024, 1, 1))], "PATIENT_ID string, END_DT date")
    days = [D(2023, 3, 31), D(2023, 4, 30), D(2024, 2, 29), D(2024, 2, 15), D(2024, 3, 15), D(2024, 3, 31), D(2023, 12, 31), D(2024, 1, 1), D(2024, 1, 31)]
    values = spark.createDataFrame([(p, d, i) for p in "abc" for i, d in enumerate(days)], "PATIENT_ID string, AS_OF_DATE date, v int")
    columns = ["PATIENT_ID", "END_DT", "TIME_STEP", "AS_OF_DATE", "v"]
    want = tx.fan_out(ft.asof_grid(snaps, "month_end_history"), values)
    assert sorted(tx.fan_out_by_entity(values, snaps).select(columns).collect()) == sorted(want.select(columns).collect()) != []


def test_terms_are_not_shuffled(spark):
    # Before, term rows were shuffled by document, by snapshot and by snapshot and term, and kept as an uncompressed checkpoint.
    plan = CATALOG["i20_term_sequence_summary"].run(spark, FOLDER)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert not [line for line in text.splitlines() if " Exchange hashpartitioning" in line and "TERM#" in line.split("hashpartitioning(")[1].split(")")[0] and "END_DT#" in line]


def test_token_branches_are_shuffled_once(spark):
    plan = CATALOG["g01_token_branches"].run(spark, FOLDER)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # Before, tokens were shuffled by all their columns and once more for the join.
    assert not [line for line in text.splitlines() if " Exchange hashpartitioning" in line and "ENTITY_KEY#" in line.split("hashpartitioning(")[1].split(")")[0]]
