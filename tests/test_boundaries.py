"""Hand-calculated boundary fixtures."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import association as asc, cohort as co, contracts as ct, evaluation as evl, events as ev, features as ft
from tidemark.operators import lineage as ln, ordering as od, resample as rs, selection as sel, sequences as sq, text as tx
from tidemark.sources import sinks, tables
from tidemark.streaming import resume

D = dt.date


def scored(spark, labels, scores):
    rows = [(f"{i:03d}", D(2026, 1, 1), y, s) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "PATIENT_ID string, END_DT date, RESP int, SCORE double")


def test_decile_hand_case(spark):
    # 30 rows, three a decile; positives stand at ranks 1, 3, 4, 5, 6, 11, 16, 17, 30.
    labels = [int(rank in (1, 3, 4, 5, 6, 11, 16, 17, 30)) for rank in range(1, 31)]
    table = evl.decile_table(scored(spark, labels, [1 / rank for rank in range(1, 31)]), "SCORE").orderBy("DECILE").collect()
    assert [r.POSITIVES for r in table] == [2, 3, 0, 1, 0, 2, 0, 0, 0, 1]
    assert table[0].LIFT == pytest.approx((2 / 3) / (9 / 30)) and table[1].LIFT == pytest.approx(1 / (9 / 30))
    assert table[5].CUM_RECALL == pytest.approx(8 / 9) and table[-1].CUM_RECALL == 1.0


def test_odd_size_deciles_follow_ceil_cuts(spark):
    df = evl.with_decile(scored(spark, [0, 1] * 11 + [1], [i / 23 for i in range(23)]), "SCORE")
    sizes = {r.DECILE: r["count"] for r in df.groupBy("DECILE").count().collect()}
    assert [sizes[d] for d in range(1, 11)] == [3, 2, 2, 3, 2, 2, 3, 2, 2, 2]


def test_all_tied_scores_are_label_blind(spark):
    a = evl.label_blind_rank(scored(spark, [1] * 5 + [0] * 5, [0.5] * 10), "SCORE")
    b = evl.label_blind_rank(scored(spark, [0] * 5 + [1] * 5, [0.5] * 10).repartition(3), "SCORE")
    ranks = lambda x: {r.PATIENT_ID: r.RANK for r in x.collect()}
    assert ranks(a) == ranks(b) and sorted(ranks(a).values()) == list(range(1, 11))


@pytest.mark.parametrize("labels", [[0] * 10, [1] * 10])
def test_single_class_metrics(spark, labels):
    df = scored(spark, labels, [i / 10 for i in range(10)])
    m = evl.curve_metrics(evl.curve(df, "SCORE")).first()
    assert m.AUC is None
    assert m.AP == (pytest.approx(1.0) if labels[0] else None)


def test_average_precision_differs_from_trapezoid(spark):
    points = evl.curve(scored(spark, [0, 1, 1, 0], [0.9, 0.8, 0.7, 0.1]), "SCORE")
    assert evl.curve_metrics(points).first().AP == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert evl.pr_area(points, "SCORE").first().PR_AREA != pytest.approx((1 / 2 + 2 / 3) / 2)


def test_exact_f1_tie_takes_highest_threshold(spark):
    # F1 is 2/3 at 0.9 (tp 1 of 1, one missed) and again at 0.2 (tp 2 of 4).
    got = evl.best_f1(evl.curve(scored(spark, [1, 0, 0, 1], [0.9, 0.5, 0.4, 0.2]), "SCORE"), "SCORE").first()
    assert (got.THRESHOLD, got.F1) == (0.9, pytest.approx(2 / 3))


def test_running_totals_survive_one_hot_group(spark):
    rows = [("hot", i, 1) for i in range(5000)] + [(f"g{i}", 0, 1) for i in range(50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v int, w int").repartition(7)
    out = od.running_totals(df, [F.col("v")], {"c": F.col("w")}, ("g",))
    assert out.filter("g = 'hot' AND c <> v + 1").count() == 0
    assert out.filter("g <> 'hot' AND c <> 1").count() == 0


def test_weighted_quantile_with_ties_equals_row_by_row_rule(spark):
    rows = [("a", D(2026, 1, 1), 1.0, 1.0), ("b", D(2026, 1, 1), 1.0, 3.0), ("c", D(2026, 1, 1), 2.0, 1.0), ("d", D(2026, 1, 1), 5.0, 1.0)]
    df = spark.createDataFrame(rows, "PATIENT_ID string, END_DT date, v double, w double")
    got = {r.Q: r.QUANTILE for r in od.weighted_quantiles(od.value_table(df, "v", "w", ["PATIENT_ID", "END_DT"]), "v", [0.25, 0.6, 0.9]).collect()}
    mids, values = [0.5, 2.5, 4.5, 5.5], [1.0, 1.0, 2.0, 5.0]
    def interp(x):
        for (a, va), (b, vb) in zip(zip(mids, values), zip(mids[1:], values[1:])):
            if a <= x <= b:
                return va + (x - a) / (b - a) * (vb - va)
    assert got == {q: pytest.approx(interp(q * 6)) for q in got}


def cohort(spark):
    cut = D(2024, 1, 31)
    pop = spark.createDataFrame([(p, cut, 0) for p in ("day0", "day1", "day90", "day91", "none", "quiet")], "PATIENT_ID string, END_DT date, RESP int")
    day = lambda n: cut + dt.timedelta(days=n)
    basket = spark.createDataFrame([("day0", day(0), False), ("day1", day(1), False), ("day90", day(90), False), ("day91", day(91), False), ("none", day(5), True)],
                                   "PATIENT_ID string, FILL_DATE date, IS_GENERIC boolean")
    activity = spark.createDataFrame([("day91", day(90)), ("none", day(1)), ("quiet", day(91)), ("quiet", day(0))], "PATIENT_ID string, SERVICE_DATE date")
    return pop, basket, activity


def test_horizon_boundaries(spark):
    pop, basket, activity = cohort(spark)
    got = {r.PATIENT_ID: (r.RESP, r.PRIOR_INITIATION, r.RETAIN) for r in co.decide(pop, basket, activity).collect()}
    assert got == {"day0": (0, 1, 0), "day1": (1, 0, 1), "day90": (1, 0, 1), "day91": (0, 0, 1), "none": (0, 0, 1), "quiet": (0, 0, 0)}


def test_asof_dates_clamp_from_the_original_cutoff(spark):
    snap = spark.createDataFrame([("a", D(2024, 3, 31))], "PATIENT_ID string, END_DT date")
    same = [r.AS_OF_DATE for r in ft.asof_grid(snap, "same_day_months", 3).orderBy("TIME_STEP").collect()]
    ends = [r.AS_OF_DATE for r in ft.asof_grid(snap, "month_end_history", 3).orderBy("TIME_STEP").collect()]
    assert same == [D(2024, 3, 31), D(2024, 2, 29), D(2024, 1, 31)] == ends


def test_monthly_counts_mid_month_cutoff_and_window_start(spark):
    snap = spark.createDataFrame([("a", D(2024, 3, 15))], "PATIENT_ID string, END_DT date")
    days = [D(2024, 3, 15), D(2024, 3, 16), D(2024, 2, 29), D(2023, 4, 1), D(2023, 3, 31)]
    coded = spark.createDataFrame([("a", d, "RX", "X") for d in days], "PATIENT_ID string, EVENT_DATE date, FAMILY string, CATEGORY string")
    got = {r.TIME_STEP: (r.VALUE, r.LAST_EVENT_DATE) for r in ev.monthly_counts(snap, coded).collect()}
    assert got == {0: (1, D(2024, 3, 15)), 1: (1, D(2024, 2, 29)), 11: (1, D(2023, 4, 1))}


def test_interval_overlap_touching_bounds(spark):
    period = spark.createDataFrame([("a", D(2024, 2, 29), s, b, e) for s, b, e in [(0, D(2024, 2, 1), D(2024, 2, 29)), (1, D(2024, 1, 1), D(2024, 1, 31))]],
                                   "PATIENT_ID string, END_DT date, TIME_STEP int, PERIOD_START date, PERIOD_END date")
    spans = spark.createDataFrame([("a", D(2024, 2, 29), D(2024, 3, 5)), ("a", D(2023, 1, 1), D(2023, 12, 31))], "PATIENT_ID string, s date, e date")
    got = {r.TIME_STEP: r.COVERED for r in ev.interval_overlap(period, spans, "s", "e").collect()}
    assert got == {0: True, 1: False}


def test_multi_value_tokens_keep_row_weight(spark):
    mx = spark.createDataFrame([("a", D(2024, 1, 1), "X|| |y.1"), ("a", D(2024, 1, 1), "X|| |y.1"), ("a", D(2024, 1, 1), None)], "PATIENT_ID string, d date, c string")
    days = ev.explode_codes(ev.entity_days(mx, "d", "c", "DX"), "CODE")
    assert sorted((r.CODE, r.N) for r in days.collect()) == [("X", 2), ("y.1", 2)]


def test_padded_and_blank_ids(spark):
    df = spark.createDataFrame([("NA", "2024-01-31"), (" x", "2024-01-31"), ("", "2024-02-30"), (None, "2024-01-31"), ("NA", "2024-01-31")], "i string, d string")
    r = ct.snapshot_key_report(df, "i", "d").first()
    assert (r.NULL_ID, r.BLANK_ID, r.PADDED_ID, r.BAD_DATE, r.DUPLICATE_EXCESS) == (1, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        ct.require_clean(ct.snapshot_key_report(df, "i", "d"))


def test_bootstrap_equals_explicit_resampling(spark):
    rng = random.Random(3)
    rows = [(m, f"p{i % 7}", D(2024, 1, 1) + dt.timedelta(days=i), y, round(rng.random(), 1)) for m in ("a", "b") for i, y in enumerate([1, 0, 0, 1, 0, 0, 1, 0, 1, 0, 0, 0, 1, 0, 0])]
    df = spark.createDataFrame(rows, "MODEL string, PATIENT_ID string, END_DT date, RESP int, SCORE double")
    draws = rs.cluster_draws(df, 6, "s")
    mult = {(r.DRAW, r.PATIENT_ID): r.M for r in draws.collect()}
    assert all(sum(m for (d, _), m in mult.items() if d == k) == 7 for k in range(6))
    mult |= {(rs.OBSERVED, f"p{i}"): 1 for i in range(7)}
    weights = rs.cluster_weights(df, 6, "s")
    got = {(r.DRAW, r.MODEL, r.PERCENT): r.LIFT for r in rs.bootstrap_lifts(df, weights, 6, [10, 30], block=4).collect()}
    curves = {b: {(r.DRAW, r.MODEL): r for r in rs.bootstrap_curves(df, weights, 6, block=b).collect()} for b in (1, 3, 100)}
    for draw, model in itertools.product(range(-1, 6), "ab"):
        flat = sorted(((-r[4], r[3]) for r in rows if r[0] == model for _ in range(mult.get((draw, r[1]), 0))))
        pos, neg = sum(y for _, y in flat), sum(1 - y for _, y in flat)
        ap = sum(sum(y for t, y in flat if t == s) * sum(y for t, y in flat if t <= s) / sum(1 for t, _ in flat if t <= s) for s in {t for t, _ in flat})
        auc = sum((s < t) + (s == t) / 2 for s, y in flat for t, z in flat if y > z)
        for got_curve in curves.values():
            r = got_curve[draw, model]
            assert r.AP == (pytest.approx(ap / pos) if pos else None) and r.AUC == (pytest.approx(auc / pos / neg) if pos and neg else None)
    for draw, model, percent in itertools.product(range(-1, 6), "ab", (10, 30)):
        order = sorted((r for r in rows if r[0] == model), key=lambda r: (-r[4], r[1], r[2]))
        flat = [r[3] for r in order for _ in range(mult.get((draw, r[1]), 0))]
        k = max(1, -(-len(flat) * percent // 100))
        want = sum(flat[:k]) / k / (sum(flat) / len(flat)) if 0 < sum(flat) < len(flat) else None
        assert got[draw, model, percent] == (pytest.approx(want) if want is not None else None)


def test_donors_never_repeat_themselves(spark):
    df = spark.createDataFrame([(f"p{i}", D(2024, 1, 1 + i % 3)) for i in range(30)] + [("solo", D(2025, 1, 1))], "PATIENT_ID string, END_DT date")
    out = rs.donors(df, "END_DT", "x").collect()
    assert len(out) == 31 and {r.PATIENT_ID for r in out if r.PATIENT_ID == r.DONOR_ID} == {"solo"}
    assert len({(r.DONOR_ID, r.END_DT) for r in out}) == 31


def test_held_out_rows_cannot_change_the_fit(spark):
    rows = [("F", "count", float(i % 5) if i % 4 else None, "train" if i < 30 else "test") for i in range(40)]
    df = spark.createDataFrame(rows, "FEATURE string, KIND string, VALUE double, SPLIT string")
    poisoned = df.withColumn("VALUE", F.when(F.col("SPLIT") == "test", 999.0).otherwise(F.col("VALUE")))
    fit = lambda x: asc.fit_transform(x.filter("SPLIT = 'train'")).collect()
    assert fit(df) == fit(poisoned)


def test_duplicate_features_need_equal_cells(spark):
    rows = [(f"p{i}", D(2024, 1, 1), f, float(v)) for i in range(6) for f, v in (("A", i), ("B", i), ("C", 5 - i))]
    df = spark.createDataFrame(rows, "PATIENT_ID string, END_DT date, FEATURE string, VALUE double")
    assert [tuple(r) for r in asc.duplicate_features(df).collect()] == [("B", "A")]


def test_greedy_pruning_equals_the_sequential_rule(spark):
    rng = random.Random(5)
    names = [f"f{i:02d}" for i in range(12)]
    pairs = [(a, b) for a, b in itertools.combinations(names, 2) if rng.random() < 0.25]
    kept, by = [], {}
    for n in names:
        hit = next((k for k in kept if (k, n) in pairs or (n, k) in pairs), None)
        by[n] = hit
        if hit is None:
            kept.append(n)
    out = sel.greedy_prune(spark.createDataFrame([(n, i) for i, n in enumerate(names)], "FEATURE string, RANK int"),
                           spark.createDataFrame(pairs, "FEATURE_A string, FEATURE_B string"))
    assert {r.FEATURE: r.REDUNDANT_WITH for r in out.collect()} == by


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(9)] + [("x", "y")], "FEATURE_A string, FEATURE_B string")
    out = {r.NODE: r.COMPONENT for r in sel.components(edges).collect()}
    assert {out[f"n{i:02d}"] for i in range(10)} == {"n00"} and out["y"] == "x"


def test_zero_padding_and_null_stay_apart(spark):
    rows = [("a", D(2024, 1, 31), s, v, ok) for s, v, ok in [(0, 4, True), (1, 0, True), (2, 9, False)]]
    df = spark.createDataFrame(rows, "PATIENT_ID string, END_DT date, TIME_STEP int, VALUE int, VALID boolean")
    r = sq.descriptors(df, ["PATIENT_ID", "END_DT"]).first()
    assert (r.CURRENT, r.MEAN, r.SD, r.SLOPE) == (4.0, 2.0, 2.0, -2.0)  # squared step spread is 0.5, floored at 1


def test_terms_cover_bigrams_and_short_texts(spark):
    df = spark.createDataFrame([("Big Red the Ring",), ("One",), ("",)], "t string")
    got = [r[0] for r in df.select(tx.terms(F.col("t"), ["the"])).collect()]
    assert got == [["big", "red", "ring", "big red", "red ring"], ["one"], []]


def test_chunks_round_trip_and_detect_damage(spark):
    df = spark.createDataFrame([("a", "é" * 301), ("b", "")], "k string, p string")
    chunks = sinks.to_chunks(df, "k", "p", 100)
    assert {r.ARTIFACT_NAME: (r.PAYLOAD, r.VERIFIED) for r in sinks.from_chunks(chunks).collect()} == {"a": ("é" * 301, True), "b": ("", True)}
    broken = chunks.filter("NOT (ARTIFACT_NAME = 'a' AND CHUNK_INDEX = 1)")
    assert not sinks.from_chunks(broken).filter("ARTIFACT_NAME = 'a'").first().VERIFIED


def test_publish_is_create_only(spark, tmp_path):
    df = spark.range(5)
    path = str(tmp_path / "out")
    assert [sinks.publish(df, path), sinks.publish(df, path)] == ["created", "unchanged"]
    with pytest.raises(ValueError):
        sinks.publish(spark.range(6), path)
    with pytest.raises(Exception):
        sinks.export_once(df, path)


def test_resume_adds_only_missing_keys(spark, tmp_path):
    asked = []
    def extract(keys):
        asked.append(keys.count())
        return keys.withColumn("v", F.length("k"))
    path = str(tmp_path / "store")
    keys = lambda *names: spark.createDataFrame([(n,) for n in names], "k string")
    assert resume.append_missing(keys("a", "bb"), path, "k string, v int", extract, ["k"], 0) == 2
    assert resume.append_missing(keys("a", "bb", "ccc"), path, "k string, v int", extract, ["k"], 1) == 1
    assert asked == [2, 1] and spark.read.parquet(path).count() == 3


def test_budget_refuses_instead_of_truncating(spark):
    assert tables.within_budget(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError):
        tables.within_budget(spark.range(6), 5)


def test_repeated_rows_do_not_cancel_in_the_relation_hash(spark):
    one = ln.relation_hash(spark.createDataFrame([("a",)], "x string")).first()
    three = ln.relation_hash(spark.createDataFrame([("a",)] * 3, "x string")).first()
    assert one.HASH != three.HASH and three.ROWS == 3


def test_relation_hash_keeps_null_places(spark):
    schema = "x string, y string"
    one = ln.relation_hash(spark.createDataFrame([("a", None)], schema)).first()
    other = ln.relation_hash(spark.createDataFrame([(None, "a")], schema)).first()
    assert one != other


def test_publish_refuses_moved_nulls(spark, tmp_path):
    path, schema = str(tmp_path / "moved"), "x string, y string"
    assert sinks.publish(spark.createDataFrame([("a", None)], schema), path) == "created"
    with pytest.raises(ValueError):
        sinks.publish(spark.createDataFrame([(None, "a")], schema), path)
