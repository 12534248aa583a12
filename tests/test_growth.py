"""What is expanded in place neither travels through the driver nor is shuffled twice."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import resample as rs, sequences as sq, text as tx
from tidemark.plans import texts
from tidemark.plans.catalog import CATALOG
from tidemark.plans.relations import Tables

D = dt.date
FOLDER = "/root/testdata/sf0.001"


def lines(df, name):
    return [line for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if name in line]


def test_picks_of_draws_are_not_broadcast(spark):
    rows = spark.createDataFrame([(f"e{i % 7}",) for i in range(9)], "PATIENT_ID string")
    draws = rs.cluster_draws(rows, 5, "s")
    joined = lines(draws, "Join [SLOT#") + lines(rs.cluster_weights(rows, 5, "s"), "Join [SLOT#")
    # Before, Spark took the picks for as few rows as there are entities, and could send them to the driver for a broadcast.
    assert len(joined) == 2 and not [line for line in joined if "ShuffledHashJoin" not in line and "SortMergeJoin" not in line]
    plan = draws._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(SLOT#") == 3 and "Exchange hashpartitioning(DRAW#" not in plan
    got = {r.DRAW: r.n for r in draws.groupBy("DRAW").agg(F.sum("M").alias("n")).collect()}
    assert got == {d: 7 for d in range(5)}


def months(rows):
    """(k, id, {step: count}) as rows with M0 .. M11."""
    return [(k, i, *[counts.get(s, 0) for s in range(12)]) for k, i, counts in rows]


MONTHS = ", ".join(f"M{i} int" for i in range(12))


def test_all_forms_are_counted_in_one_pass(spark):
    cells = [("a", 1, {0: 2, 2: 1, 11: 4}), ("a", 2, {5: 3}), ("b", 1, {0: 1, 1: 1}), ("c", 2, {3: 7, 4: 1})]
    wide = spark.createDataFrame(months(cells), f"PATIENT_ID string, ID int, {MONTHS}")
    names = spark.createDataFrame([(1, "X"), (2, "Y"), (3, "Z")], "ID int, CATEGORY string")
    got = sorted(map(tuple, sq.representation_totals(wide, "ID", "CATEGORY", names).select("KIND", "PART", "ROWS", "TOTAL").collect()))
    tall = spark.createDataFrame([(k, D(2024, 1, 31), "XY"[i - 1], s, n) for k, i, own in cells for s, n in own.items()],
                                 "PATIENT_ID string, END_DT date, CATEGORY string, TIME_STEP int, VALUE int")
    want = []
    for kind in ("monthly", "without_step0", "flattened", "quarterly", "annual", "windows"):
        rows = sq.representation(tall, kind).groupBy("PART").agg(F.count("*").alias("n"), F.sum("VALUE").alias("t"))
        want += [(kind, r.PART, r.n, r.t) for r in rows.collect()]
    assert got == sorted(want)
    plan = CATALOG["i07_representations"].run(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate#") and sum("Relation" in line and "l_linenumber" in line for line in plan.splitlines()) == 1  # before, six scans


def test_block_summaries_without_unknown_values(spark):
    wide = spark.createDataFrame(months([("a", 1, {0: 2, 2: 1, 11: 4}), ("b", 2, {5: 3}), ("c", 3, {})]), f"k string, id int, {MONTHS}")
    known = [F.when(F.col(f"M{i}") > 0, F.col(f"M{i}").cast("double")) for i in range(12)]
    want = sq.wide_block_summaries(wide, ["k"], [F.coalesce(v, F.lit(0.0)) for v in known], [v.isNotNull() for v in known])
    assert sorted(sq.block_summaries(wide, ["k"]).collect()) == sorted(want.select(sq.block_summaries(wide, ["k"]).columns).collect())


def test_only_unknown_values_meet_their_median(spark):
    plan = CATALOG["i08_temporal_summaries"].run(spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    # Before, all rows were joined with the medians, in code too long to be compiled.
    joined = plan[plan.index("Join"):]
    assert "Union" in plan and "DX_OLD" in joined and "Join" not in plan[:plan.index("Union")]


def test_term_sums_in_arrays_equal_those_of_positions(spark, monkeypatch):
    columns = {name: [c for c, _ in CATALOG[name].columns] for name in ("i20_term_sequence_summary", "m08_term_trend")}
    run = lambda name: CATALOG[name].run(spark, FOLDER).select(columns[name])
    fast = {name: run(name) for name in columns}
    # Before, every (snapshot, step, term) was a row.
    assert all("MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString() and "TFIDF#" not in df._jdf.queryExecution().optimizedPlan().toString() for df in fast.values())
    fast = {name: sorted(map(tuple, df.collect())) for name, df in fast.items()}
    monkeypatch.setattr(tx, "WORK_NUMBERS", 1)  # a snapshot at a time
    assert sorted(map(tuple, run("m08_term_trend").collect())) == fast["m08_term_trend"]
    monkeypatch.setattr(tx, "MATRIX_NUMBERS", 0)  # from rows of positions
    for name in columns:
        assert sorted(map(tuple, run(name).collect())) == fast[name] != []


def test_events_of_documents_count_once_a_code(spark, tmp_path):
    day = dt.datetime(1998, 3, 5)
    tables = {
        "customer": ([(1,)], "c_custkey long"),
        "orders": ([(i, 1, "O", 1.0, d, "1-URGENT") for i, d in ((1, day), (1, dt.datetime(1998, 3, 7)), (2, day), (9, dt.datetime(1998, 12, 31)), (None, day))],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "part": ([(1, "red hot red", "Brand#1", "BIG", 1, 1.0), (2, "red", "Brand#2", "BIG", 1, 1.0), (3, None, None, None, None, None)],
                 "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        # The first line stands there twice, and its order has two dates of one month; the second and fourth of order 2 have no event id, the last no part.
        "lineitem": ([(1, 1, 5, 1), (1, 1, 5, 1), (2, 2, 5, 1), (2, 1, 17, 2), (2, 1, 5, 3), (2, 1, None, 4), (2, 7, 5, 5)],
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "lineitem":
            df = df.selectExpr("*", "1D l_quantity", "1D l_extendedprice", "0D l_discount", "0D l_tax", "'R' l_returnflag", "'F' l_linestatus", "timestamp_ntz'1998-03-06' l_shipdate")
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(spark, str(tmp_path))
    got = {(str(r.AS_OF_DATE), r.DESCRIPTION): r.EVENTS for r in texts.described(t).collect()}
    # Lines 1 and 3 of the first part have three codes each, the line of the second part has two.
    old = texts.doc_codes(t).filter("EVENTS > 0").join(texts.code_names(t), ["FAMILY", "CODE"]).groupBy("AS_OF_DATE", "DESCRIPTION").agg(F.sum("EVENTS").alias("n"))
    assert got == {(str(r.AS_OF_DATE), r.DESCRIPTION): r.n for r in old.collect()} and sum(got.values()) == 8
