"""Bounded scans, durable batches, vector sequences and windows, quotas and fold ledgers on small cases calculated by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.calendar import month_end_cutoffs
from tidemark.operators import association as asc, evaluation as evl, events as ev, features as ft, resample as rs, selection as sel, sequences as sq
from tidemark.streaming.resume import BatchStore

D = dt.date


def test_cutoffs_cover_the_whole_span():
    got = month_end_cutoffs(D(2020, 3, 5), D(2024, 5, 29), 90, (0, 1, 2))
    assert got == [D(2021, 2, 28), D(2022, 2, 28), D(2023, 2, 28), D(2023, 12, 31), D(2024, 1, 31), D(2024, 2, 29)]
    for first, last in ((D(2020, 3, 5), D(2024, 5, 29)), (D(2019, 12, 31), D(2020, 4, 29)), (D(2020, 1, 1), D(2020, 1, 2))):
        cutoffs = month_end_cutoffs(first, last, 90, (0, 1))
        newest = max(cutoffs)
        assert newest + dt.timedelta(days=90) <= last and (newest + dt.timedelta(days=1)).day == 1
        day = first
        while day <= newest:
            assert any(c - dt.timedelta(days=366) < day <= c for c in cutoffs)
            day += dt.timedelta(days=17)


def test_scan_bounds(spark):
    snapshots = spark.createDataFrame([("a", D(2024, 3, 31)), ("b", D(2024, 2, 29))], "PATIENT_ID string, END_DT date")
    bounds = ev.scan_bounds(snapshots, 12)
    assert (bounds.low, bounds.end, bounds.entities) == (D(2023, 3, 1), D(2024, 4, 1), 2)
    empty = ev.scan_bounds(snapshots.filter("false"))
    assert empty.low == empty.end and empty.entities == 0
    rows = spark.createDataFrame([("a", 1), ("c", 2)], "PATIENT_ID string, v int")
    assert [r.v for r in ev.known_entities(rows, snapshots, bounds).collect()] == [1]
    assert ev.known_entities(rows, snapshots, bounds, limit=1).count() == 2


def test_batch_store_resumes_and_reads_each_key_once(spark, tmp_path):
    seen = []
    keys = spark.range(40).select(F.col("id").alias("k"))

    def extract(part):
        seen.extend(r.k for r in part.collect())
        return part.select("k", (F.col("k") * 2).alias("v"))

    def store(batches=3, name="twice"):
        return BatchStore(spark, str(tmp_path / "s"), "k long, v long", ["k"], batches, name)
    assert store().read().count() == 0
    done = store().run(keys, extract, "one", most=1)
    # A run that dies between writing and committing leaves rows that do not count.
    spark.createDataFrame([(999, 1)], "k long, v long").write.parquet(f"{tmp_path}/s/rows/batch={1 if done == [0] else 0}")
    assert {r.run for r in store().read().collect()} == {"one"}
    with pytest.raises(ValueError):  # an extraction that loses a key is not committed
        store().run(keys, lambda part: extract(part).filter("k % 2 = 0"), "bad", most=1)
    seen.clear()
    first = {r.k for r in store().read().collect()}
    store().run(keys, extract, "two")
    rows = store().read().collect()
    assert sorted(r.k for r in rows) == list(range(40)) and all(r.v == 2 * r.k for r in rows)
    assert sorted(seen) == sorted(set(range(40)) - first) and {r.run for r in rows} == {"one", "two"}
    seen.clear()
    assert store().run(keys, extract, "three") == [] and not seen
    for other in (lambda: store(name="thrice").run(keys, extract, "x"), lambda: store().run(keys.filter("k < 30"), extract, "x")):
        with pytest.raises(ValueError):
            other()
    spark.createDataFrame([(0, 5)], "k long, v long").write.mode("append").parquet(f"{tmp_path}/s/rows/batch=0")
    with pytest.raises(ValueError):
        store().run(keys, extract, "four")


def test_vector_sequences(spark):
    snapshots = spark.createDataFrame([("a", D(2024, 1, 31)), ("b", D(2024, 1, 31))], "PATIENT_ID string, END_DT date")
    counts = spark.createDataFrame([("a", D(2024, 1, 31), 2, "Y", 3), ("a", D(2024, 1, 31), 2, "X", 1), ("a", D(2024, 1, 31), 0, "Y", 4), ("a", D(2024, 1, 31), 1, "gone", 9)],
                                   "PATIENT_ID string, END_DT date, TIME_STEP int, CATEGORY string, VALUE long")
    got = {r.PATIENT_ID: r for r in ft.assemble_vectors(snapshots, counts, ["X", "Y"], 3).collect()}
    assert [(s.TIME_STEP, s.INDICES, s.VALUES) for s in got["a"].SEQUENCE] == [(0, [1], [4]), (1, [], []), (2, [0, 1], [1, 3])]
    assert [s.INDICES for s in got["b"].SEQUENCE] == [[], [], []] and got["a"].COMPLETE and got["b"].COMPLETE
    assert not ft.assemble_vectors(snapshots, counts, ["X", "Y"], 2).filter("PATIENT_ID = 'a'").first().COMPLETE


def test_semantic_windows_by_either_way(spark, monkeypatch):
    counts = spark.createDataFrame([("a", D(2024, 1, 31), 0, "X", 1), ("a", D(2024, 1, 31), 2, "X", 2), ("a", D(2024, 1, 31), 1, "Y", 1), ("a", D(2024, 1, 31), 7, "Y", 5), ("a", D(2024, 1, 31), 7, "none", 5)],
                                   "PATIENT_ID string, END_DT date, TIME_STEP int, CATEGORY string, VALUE long")
    book = spark.createDataFrame([("X", [1.0, 0.0]), ("Y", [0.0, 4.0])], "CATEGORY string, E array<double>")
    for limit in (4, 3):
        monkeypatch.setattr(sq, "VECTOR_NUMBERS", limit)
        got = {r.RECENT: r for r in sq.semantic_windows(counts, book).collect()}
        assert got[True].M == pytest.approx([0.75, 1.0]) and got[False].M == pytest.approx([0.0, 4.0])
        assert got[True].LOG_SUM == pytest.approx(math.log(5)) and got[False].LOG_SUM == pytest.approx(math.log(6))
    with pytest.raises(ValueError):
        sq.semantic_windows(counts, book.filter("false"))


def test_inner_split_has_its_exact_quota(spark):
    people = spark.createDataFrame([(f"p{i}", int(i < 3)) for i in range(31)], "PATIENT_ID string, RESP int")
    got = rs.inner_split(people, 20, "s").collect()
    sides = {s: [r for r in got if r.SIDE == s] for s in ("inner_train", "inner_validation")}
    assert len(sides["inner_validation"]) == 7 and len(got) == 31 and len({r.ATTEMPT for r in got}) == 1
    positive = {f"p{i}" for i in range(3)}
    assert all(0 < len({r.PATIENT_ID for r in s} & positive) < len(s) for s in sides.values())
    with pytest.raises(ValueError):
        rs.inner_split(people.filter("RESP = 0"), 20, "s", attempts=6)


def test_fold_ledger_leaves_the_held_out_fold_out(spark):
    rows = [(f"p{i}", D(2024, 1, 1), i % 2, i % 3, 1.0, {"A": 1 + i % 2, "B": 1 if i % 3 == 0 else 0}) for i in range(12)]
    packed = spark.createDataFrame(rows, "PATIENT_ID string, END_DT date, RESP int, FOLD int, WEIGHT double, COUNTS map<string,long>")
    hist = asc.sparse_histogram(asc.sparse_rows(packed, ("A", "B")), "FOLD", "RESP", weight="WEIGHT")
    got = {(r.HOLDOUT, r.FEATURE): r for r in sel.fold_ledger(hist, 3).collect()}
    assert got[0, "A"].AP_UP == 1.0 and got[0, "A"].AP_DOWN < 0.6 and got[0, "A"].RANK == 1
    assert not got[0, "B"].ELIGIBLE and got[1, "B"].ELIGIBLE  # constant once its only varying fold is held out
    assert got[0, "A"].CENTER == pytest.approx((math.log(2) + math.log(3)) / 2)
    poisoned = packed.withColumn("RESP", F.when(F.col("FOLD") == 0, 1 - F.col("RESP")).otherwise(F.col("RESP")))
    other = sel.fold_ledger(asc.sparse_histogram(asc.sparse_rows(poisoned, ("A", "B")), "FOLD", "RESP", weight="WEIGHT"), 3)
    assert {r.FEATURE: tuple(r) for r in other.filter("HOLDOUT = 0").collect()} == {f: tuple(got[0, f]) for f in "AB"}
    assert sel.candidate_sizes(48, (16, 32, 64)) == [16, 32, 48]


def test_filter_list_rules(spark):
    ranking = spark.createDataFrame([(f, i, mi) for i, (f, mi) in enumerate((("a", .9), ("b", .8), ("c", .7), ("d", .6), ("e", .5), ("f", .0), ("g", .0)), 1)], "FEATURE string, RANK int, MI double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("c", "f")], "FEATURE_A string, FEATURE_B string")
    got = {r.FEATURE: (r.STATE, r.REDUNDANT_WITH) for r in sel.filter_list(ranking, pairs, 2).collect()}
    # b leaves because of a, so c stays; d is over the limit and makes e no longer redundant, which is over it as well.
    assert got == {"a": ("kept", None), "b": ("redundant", "a"), "c": ("kept", None), "d": ("over_limit", None), "e": ("over_limit", None),
                   "f": ("redundant", "c"), "g": ("zero_information", None)}
    assert {r.FEATURE: r.STATE for r in sel.filter_list(ranking, pairs, 9).collect()}["e"] == "redundant"


def test_duplicate_latest_keys_are_refused(spark):
    rows = spark.createDataFrame([("a", D(2024, 1, 31), 1), ("a", D(2024, 2, 29), 0), ("b", D(2024, 1, 31), 1)], "PATIENT_ID string, END_DT date, RESP int")
    assert sorted(tuple(r) for r in evl.latest_snapshot(rows).collect()) == [("a", D(2024, 2, 29), 0), ("b", D(2024, 1, 31), 1)]
    older = rows.unionByName(rows.filter("END_DT < '2024-02-01' AND PATIENT_ID = 'a'"))
    assert evl.latest_snapshot(older).count() == 2 and len(evl.latest_snapshot(older).collect()) == 2
    with pytest.raises(Exception, match="duplicate latest key"):
        evl.latest_snapshot(rows.unionByName(rows.filter("PATIENT_ID = 'b'"))).collect()
