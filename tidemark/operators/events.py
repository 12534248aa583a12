"""Coded events: normalisation, mapping, pre-aggregation and cutoff-bounded joins."""

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.calendar import calendar_step, count_window_start, month_start
from tidemark.functions.scalar import clean_code

KEY = ["PATIENT_ID", "END_DT"]


def distinct_mapping(rows: DataFrame) -> DataFrame:
    """Distinct normalised (FAMILY, CODE, CATEGORY)."""
    return rows.select("FAMILY", clean_code(F.col("CODE"), F.col("FAMILY")).alias("CODE"),
                       F.trim("CATEGORY").alias("CATEGORY")).distinct()


def explode_codes(df: DataFrame, column: str, delimiter: str = "|") -> DataFrame:
    """One row per non-blank item of a delimited list; other columns are kept."""
    parts = F.filter(F.split(F.col(column), "\\Q" + delimiter + "\\E"), lambda x: F.trim(x) != "")
    return df.withColumn(column, F.explode(parts))


def entity_days(df: DataFrame, date: str, code: str, family: str) -> DataFrame:
    """Occurrences per entity, day and raw code. Partial aggregation shrinks hot entities before any join."""
    return (df.groupBy("PATIENT_ID", F.col(date).alias("EVENT_DATE"), F.col(code).alias("CODE"))
            .agg(F.count("*").alias("N")).withColumn("FAMILY", F.lit(family)))


def daily_codes(rx: DataFrame, mx: DataFrame) -> DataFrame:
    """Both sources at entity-day-code grain; list tokens inherit the row count of their list."""
    dx = explode_codes(entity_days(mx, "SERVICE_DATE", "DIAGNOSIS_CODES", "DX"), "CODE")
    days = (entity_days(rx, "FILL_DATE", "NDC11", "RX")
            .unionByName(entity_days(mx, "SERVICE_DATE", "PROCEDURE_CODE", "PX")).unionByName(dx))
    return days.withColumn("CODE", clean_code(F.col("CODE"), F.col("FAMILY")))


def map_codes(days: DataFrame, mapping: DataFrame) -> DataFrame:
    """Inner equi-join; one code may hit several categories. Spark sizes the map and picks the strategy."""
    return days.join(mapping, ["FAMILY", "CODE"])


#: Code maps up to this many rows are broadcast to the occurrences; larger ones are left to the join.
CODE_BROADCAST = 100_000


def sendable(mapping: DataFrame, limit: int = CODE_BROADCAST) -> DataFrame:
    """A small table marked for broadcast, so that rows with few distinct codes are not shuffled by them; a larger one as it is."""
    return F.broadcast(mapping) if mapping.limit(limit + 1).count() <= limit else mapping


def mapped_occurrences(rx: DataFrame, mx: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mapped occurrences of both sources, each joined with its own families: those of procedures and diagnoses have few codes."""
    fills, visits = fill_codes(rx), visit_codes(mx)
    return map_codes(fills, mapping.filter("FAMILY = 'RX'")).unionByName(map_codes(visits, sendable(mapping.filter("FAMILY <> 'RX'"))))


def medical_codes() -> Column:
    """(FAMILY, CODE) of every code of a medical row: its procedure and each non-blank diagnosis token."""
    def coded(family, code):
        return F.struct(F.lit(family).alias("FAMILY"), clean_code(code, F.lit(family)).alias("CODE"))
    tokens = F.filter(F.split("DIAGNOSIS_CODES", "\\|"), lambda x: F.trim(x) != "")
    return F.concat(F.array(coded("PX", F.col("PROCEDURE_CODE"))), F.transform(tokens, lambda x: coded("DX", x)))


def fill_codes(rx: DataFrame) -> DataFrame:
    return rx.select("PATIENT_ID", F.col("FILL_DATE").alias("EVENT_DATE"), F.lit("RX").alias("FAMILY"),
                     clean_code(F.col("NDC11"), F.lit("RX")).alias("CODE"))


def visit_codes(mx: DataFrame) -> DataFrame:
    return mx.select("PATIENT_ID", F.col("SERVICE_DATE").alias("EVENT_DATE"), F.inline(medical_codes()))


def occurrences(rx: DataFrame, mx: DataFrame) -> DataFrame:
    """(PATIENT_ID, EVENT_DATE, FAMILY, CODE): one scan per source, several codes per row expanded in place."""
    return fill_codes(rx).unionByName(visit_codes(mx))


def window_months(snapshots: DataFrame, steps: int) -> DataFrame:
    """Each snapshot once per calendar month of its window, with the month as join key.

    Spark sizes the rows as if they were not expanded and would send them to the driver for a broadcast, hence the hint.
    """
    return (snapshots.withColumn("TIME_STEP", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
            .withColumn("MONTH", F.add_months(month_start(F.col("END_DT")), -F.col("TIME_STEP"))).hint("merge"))


def snapshots_by_entity(snapshots: DataFrame, steps: int) -> DataFrame:
    """Each entity once, with the array SNAPSHOTS of its snapshots (all other columns, and the START of the window).

    An entity has at most one snapshot per cutoff. The hint keeps the rows shuffled, whatever size Spark takes them to have.
    """
    rest = [c for c in snapshots.columns if c != "PATIENT_ID"]
    one = F.struct(*rest, count_window_start(F.col("END_DT"), steps).alias("START"))
    return snapshots.groupBy("PATIENT_ID").agg(F.collect_list(one).alias("SNAPSHOTS")).hint("shuffle_hash")


def in_window(day: Column) -> Column:
    """Those of SNAPSHOTS in whose window a day lies."""
    return F.filter("SNAPSHOTS", lambda s: (day >= s["START"]) & (day <= s["END_DT"]))


#: Windows up to this many months are joined by month.
FEW_STEPS = 3


def asof_join(snapshots: DataFrame, events: DataFrame, date: str, steps: int = 12,
              start: Column | None = None) -> DataFrame:
    """Events of the same entity with start <= date <= END_DT.

    The range condition becomes an equi-join on (entity, calendar month), so no task pairs all snapshots
    of an entity with all its events; exact bounds are applied afterwards. `start` must not precede the
    first day of month steps - 1. Windows of more than FEW_STEPS months would multiply the snapshots before
    the shuffle; there each event meets the array of its entity's snapshots instead.
    """
    if steps > FEW_STEPS:
        near = events.join(snapshots_by_entity(snapshots, steps), "PATIENT_ID").withColumn("_s", F.explode(in_window(F.col(date))))
        rest = [c for c in snapshots.columns if c != "PATIENT_ID"]
        joined = near.select("PATIENT_ID", *[F.col(f"_s.{c}") for c in rest], *[c for c in events.columns if c != "PATIENT_ID"])
        joined = joined.withColumn("TIME_STEP", step_of(date))
        return joined if start is None else joined.filter(F.col(date) >= start)
    keyed = events.withColumn("MONTH", month_start(F.col(date)))
    joined = window_months(snapshots, steps).join(keyed, ["PATIENT_ID", "MONTH"])
    joined = joined.filter(F.col(date) <= F.col("END_DT"))
    if start is not None:
        joined = joined.filter(F.col(date) >= start)
    return joined.drop("MONTH")


def monthly_counts(snapshots: DataFrame, coded: DataFrame, steps: int = 12) -> DataFrame:
    """Long monthly counts per (snapshot, step, family, category) with first and last event date.

    `coded` holds mapped occurrences. They are shuffled once, by entity, and reduced to entity-days there; then each day meets the
    entity's few snapshots as one array. Overlapping windows multiply rows only inside a task, and the last aggregation reuses the
    partitioning, so nothing larger than the occurrences is ever shuffled.
    """
    day = F.col("EVENT_DATE")
    daily = coded.repartition("PATIENT_ID").groupBy("PATIENT_ID", "EVENT_DATE", "FAMILY", "CATEGORY").agg(F.count("*").alias("N"))
    joined = daily.join(snapshots_by_entity(snapshots.select(*KEY), steps), "PATIENT_ID")
    joined = joined.withColumn("S", F.explode(in_window(day))).select("PATIENT_ID", "S.END_DT", "EVENT_DATE", "FAMILY", "CATEGORY", "N")
    return joined.groupBy("PATIENT_ID", "END_DT", step_of().alias("TIME_STEP"), "FAMILY", "CATEGORY").agg(
        F.sum("N").alias("VALUE"), F.min(day).alias("FIRST_EVENT_DATE"), F.max(day).alias("LAST_EVENT_DATE"))


def category_ids(mapping: DataFrame) -> DataFrame:
    """(ID, FAMILY, CATEGORY): the categories of a code map numbered by name. Few by contract, however many codes there are."""
    names = mapping.select("FAMILY", "CATEGORY").distinct()
    return names.select(F.row_number().over(W.orderBy("FAMILY", "CATEGORY")).alias("ID"), "FAMILY", "CATEGORY")


def windowed_lists(snapshots: DataFrame, listed: DataFrame, steps: int = 12, parts: int | None = None) -> DataFrame:
    """(KEY, TIME_STEP, EVENT_DATE, IDS): every event list once for each snapshot of its entity in whose window its date lies.

    `listed` holds (PATIENT_ID, EVENT_DATE, IDS), IDS being numbers of categories with repeats. One shuffle by entity, into `parts` tasks
    where given; lists stay packed in it, and are expanded by later steps inside the tasks.
    """
    # Both sides name the number of tasks: Spark takes that of a side which is aggregated already, and would deal the lists anew by it.
    deal = lambda df: df.repartition(parts, "PATIENT_ID") if parts else df.repartition("PATIENT_ID")
    near = deal(listed).join(snapshots_by_entity(deal(snapshots.select(*KEY)), steps), "PATIENT_ID")
    near = near.withColumn("S", F.explode(in_window(F.col("EVENT_DATE")))).select("PATIENT_ID", "S.END_DT", "EVENT_DATE", "IDS")
    return near.select(*KEY, step_of().alias("TIME_STEP"), "EVENT_DATE", "IDS")


def numbered_cells(lists: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over the occurrences in `lists` per (by.., ID), ID being the number of a category.

    Grouping columns begin with the entity, so nothing is shuffled again.
    """
    return lists.withColumn("ID", F.explode("IDS")).groupBy(*by, "ID").agg(*aggregates)


def category_cells(lists: DataFrame, categories: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """numbered_cells with the FAMILY and CATEGORY of each number, joined to the results."""
    cells = numbered_cells(lists, by, *aggregates) if aggregates else numbered_cells(lists, by, F.count("*").alias("_n")).drop("_n")
    return cells.join(F.broadcast(categories), "ID").drop("ID")


def monthly_columns(steps: int = 12) -> list[Column]:
    """Counts of the steps as columns M0, M1, .., for a row per snapshot and category instead of one per step too."""
    return [F.count_if(F.col("TIME_STEP") == i).cast("int").alias(f"M{i}") for i in range(steps)]


def monthly_cells(lists: DataFrame, categories: DataFrame) -> DataFrame:
    """The rows of `monthly_counts` from event lists, in one aggregation."""
    day = F.col("EVENT_DATE")
    rows = category_cells(lists, categories, [*KEY, "TIME_STEP"], F.count("*").alias("VALUE"), F.min(day).alias("FIRST_EVENT_DATE"), F.max(day).alias("LAST_EVENT_DATE"))
    return rows.select(*KEY, "TIME_STEP", "FAMILY", "CATEGORY", "VALUE", "FIRST_EVENT_DATE", "LAST_EVENT_DATE")


def entity_bounds(snapshots: DataFrame, steps: int = 12) -> DataFrame:
    """Earliest window start and latest cutoff per entity."""
    return snapshots.groupBy("PATIENT_ID").agg(
        F.min(count_window_start(F.col("END_DT"), steps)).alias("MIN_START"), F.max("END_DT").alias("MAX_END"))


def prune_by_bounds(events: DataFrame, bounds: DataFrame, date: str) -> DataFrame:
    """Keep events of known entities inside their overall window."""
    return events.join(bounds, "PATIENT_ID").filter(F.col(date).between(F.col("MIN_START"), F.col("MAX_END")))


def prune_by_global_bounds(events: DataFrame, snapshots: DataFrame, date: str, steps: int = 12) -> DataFrame:
    """Keep events inside the one overall window; its bounds are scalar subqueries of the fact filter."""
    low = snapshots.agg(F.min(count_window_start(F.col("END_DT"), steps))).scalar()
    high = snapshots.agg(F.max("END_DT")).scalar()
    return events.filter((F.col(date) >= low) & (F.col(date) <= high))


#: Entity sets up to this size are broadcast to the fact scan; larger ones are left to the join (and Spark's own runtime filters).
ENTITY_BROADCAST = 1_000_000


@dataclass(frozen=True)
class ScanBounds:
    """What any window of a population can touch: dates low <= day < end, and about how many entities."""

    low: date
    end: date
    entities: int


def scan_bounds(snapshots: DataFrame, steps: int = 12) -> ScanBounds:
    """First phase of a bounded scan: one small aggregation over the population, read before the fact plan is built.

    As literals the bounds reach the fact scan's row-group statistics, which bounds derived inside a join never do. An empty
    population gives an empty range.
    """
    row = snapshots.agg(F.min(count_window_start(F.col("END_DT"), steps)).alias("low"), F.max("END_DT").alias("high"),
                        F.approx_count_distinct("PATIENT_ID").alias("n")).first()
    if row.high is None:
        return ScanBounds(date(1970, 1, 1), date(1970, 1, 1), 0)
    return ScanBounds(row.low, row.high + timedelta(days=1), row.n)


def known_entities(events: DataFrame, snapshots: DataFrame, bounds: ScanBounds, limit: int = ENTITY_BROADCAST) -> DataFrame:
    """Second phase: drop rows of entities without a snapshot before they are shuffled, where the entity set is small enough to send."""
    if bounds.entities > limit:
        return events
    return events.join(F.broadcast(snapshots.select("PATIENT_ID").distinct()), "PATIENT_ID", "left_semi")


def interval_overlap(periods: DataFrame, intervals: DataFrame, start: str, end: str) -> DataFrame:
    """COVERED: any interval of the entity with start <= PERIOD_END and end >= PERIOD_START.

    Intervals are cut into the calendar months they touch and deduplicated, which turns the range join
    into an equi-join on (entity, month); the exact bounds are then checked on the touched months only.
    """
    def months(low, high):
        return F.explode(F.sequence(month_start(low), month_start(high), F.expr("interval 1 month"))).alias("MONTH")
    cut = (intervals.filter(F.col(start) <= F.col(end))
           .select("PATIENT_ID", F.col(start).alias("_s"), F.col(end).alias("_e"), months(F.col(start), F.col(end)))
           .groupBy("PATIENT_ID", "MONTH", "_s").agg(F.max("_e").alias("_e")))
    keys = [*KEY, "TIME_STEP"]
    hit = (periods.select(*keys, "PERIOD_START", "PERIOD_END", months(F.col("PERIOD_START"), F.col("PERIOD_END")))
           .join(cut, ["PATIENT_ID", "MONTH"])
           .filter((F.col("_s") <= F.col("PERIOD_END")) & (F.col("_e") >= F.col("PERIOD_START")))
           .select(*keys).distinct().withColumn("_hit", F.lit(True)))
    return periods.join(hit, keys, "left").withColumn("COVERED", F.coalesce("_hit", F.lit(False))).drop("_hit")


def with_followup(snapshots: DataFrame, days: DataFrame, date: str, horizon: int = 90) -> DataFrame:
    """Distinct snapshots with an event in (cutoff, cutoff + horizon]."""
    months = F.sequence(month_start(F.date_add("END_DT", 1)), month_start(F.date_add("END_DT", horizon)),
                        F.expr("interval 1 month"))
    event_days = days.select("PATIENT_ID", F.col(date).alias("_d")).distinct()
    near = (snapshots.select(*KEY, F.explode(months).alias("MONTH"))
            .join(event_days.withColumn("MONTH", month_start(F.col("_d"))), ["PATIENT_ID", "MONTH"]))
    return near.filter((F.col("_d") > F.col("END_DT")) & (F.col("_d") <= F.date_add("END_DT", horizon))).select(*KEY).distinct()


def distinct_members(rows: DataFrame, category: str, member: str, recent: Column) -> DataFrame:
    """Distinct members per (snapshot, category) and the same for the recent window.

    Deduplicated with a recency flag first: one pass instead of an expansion per distinct count.
    """
    once = rows.groupBy(*KEY, category, member).agg(F.max(recent.cast("int")).alias("r"), F.max("EVENT_DATE").alias("d"))
    return once.groupBy(*KEY, category).agg(
        F.count("*").alias("VALUE"), F.sum("r").alias("RECENT_VALUE"), F.max("d").alias("MAX_EVENT_DATE"))


def step_of(date: str = "EVENT_DATE") -> Column:
    return calendar_step(F.col("END_DT"), F.col(date))
