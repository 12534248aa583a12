"""Cohort binding: population bounds, horizon labels, retention and audits."""

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.scalar import total
from tidemark.operators.events import with_followup
from tidemark.operators.ordering import attach
from tidemark.operators.lineage import relation_hash

KEY = ["PATIENT_ID", "END_DT"]


def bounds(candidate: DataFrame, basket: DataFrame, activity: DataFrame, months: int, horizon: int = 90) -> DataFrame:
    """One row: OBSERVED_THROUGH, UPPER_END and the exclusive LOWER_END. All inputs are single aggregates."""
    last = attach(attach(candidate.agg(F.max("END_DT").alias("c")), basket.agg(F.max("FILL_DATE").alias("b")), []),
                  activity.agg(F.max("SERVICE_DATE").alias("m")), [])
    seen = F.least("b", "m")
    upper = F.least(F.col("c"), F.date_add(seen, -horizon))
    return last.select(seen.alias("OBSERVED_THROUGH"), upper.alias("UPPER_END"), F.add_months(upper, -months).alias("LOWER_END"))


def bounded(candidate: DataFrame, limits: DataFrame) -> DataFrame:
    """Candidates with LOWER_END < END_DT <= UPPER_END."""
    inside = (F.col("END_DT") > F.col("LOWER_END")) & (F.col("END_DT") <= F.col("UPPER_END"))
    return attach(candidate, limits, []).filter(inside).select(*candidate.columns)


def first_event(basket: DataFrame, entities: DataFrame) -> DataFrame:
    """First qualifying (non-generic) event per entity of the population."""
    return (basket.filter("IS_GENERIC = false").groupBy("PATIENT_ID").agg(F.min("FILL_DATE").alias("FIRST_EVENT"))
            .join(entities.select("PATIENT_ID").distinct(), "PATIENT_ID", "left_semi"))


def decide(population: DataFrame, basket: DataFrame, activity: DataFrame, horizon: int = 90) -> DataFrame:
    """RESP from the forward horizon, prior-event exclusion and observed-negative retention per snapshot."""
    j = population.withColumnRenamed("RESP", "ORIGINAL_RESP").join(first_event(basket, population), "PATIENT_ID", "left")
    f, e = F.col("FIRST_EVENT"), F.col("END_DT")
    j = j.withColumn("RESP", F.when((f > e) & (f <= F.date_add(e, horizon)), 1).otherwise(0)).withColumn(
        "PRIOR_INITIATION", F.when(f <= e, 1).otherwise(0))
    open_rows = j.filter("RESP = 0 AND PRIOR_INITIATION = 0")
    seen = with_followup(open_rows, activity, "SERVICE_DATE", horizon).withColumn("OBSERVED_NEGATIVE", F.lit(1))
    j = j.join(seen, KEY, "left").fillna(0, ["OBSERVED_NEGATIVE"])
    keep = (F.col("PRIOR_INITIATION") == 0) & ((F.col("RESP") == 1) | (F.col("OBSERVED_NEGATIVE") == 1))
    return j.withColumn("RETAIN", keep.cast("int"))


def audit(decisions: DataFrame) -> DataFrame:
    """Gains, losses and exclusions of a binding, from one pass over the decisions."""
    kept = F.col("RETAIN") == 1
    per = decisions.groupBy("PATIENT_ID").agg(
        F.count("*").alias("n"), total(kept).alias("k"), F.sum(F.when(kept, F.col("RESP")).otherwise(0)).alias("p"),
        total(kept & (F.col("ORIGINAL_RESP") == 0) & (F.col("RESP") == 1)).alias("g"),
        total(kept & (F.col("ORIGINAL_RESP") == 1) & (F.col("RESP") == 0)).alias("l"),
        F.sum("PRIOR_INITIATION").alias("x"),
        total((F.col("PRIOR_INITIATION") == 0) & (F.col("RESP") == 0) & (F.col("OBSERVED_NEGATIVE") == 0)).alias("u"))
    return per.agg(F.sum("n").alias("BOUNDED_SNAPSHOTS"), F.sum("k").alias("SNAPSHOTS"), F.count_if(F.col("k") > 0).alias("PATIENTS"),
                   F.sum("p").alias("POSITIVES"), F.count_if(F.col("p") > 0).alias("POSITIVE_PATIENTS"),
                   F.sum("g").alias("POSITIVES_GAINED"), F.sum("l").alias("POSITIVES_LOST"),
                   F.sum("x").alias("PRIOR_EXCLUSIONS"), F.sum("u").alias("UNOBSERVED_EXCLUSIONS"))


def population_diff(new: DataFrame, prior: DataFrame, split: DataFrame) -> DataFrame:
    """Added, removed, label-changed and unchanged keys per split, with an order-free hash of the keys and both labels of each group.

    A frozen audit names the hash of the removed keys and of the changed labels; another set of the same size does not pass.
    """
    j = new.select(*KEY, F.col("RESP").alias("a")).join(prior.select(*KEY, F.col("RESP").alias("b")), KEY, "full")
    change = (F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed")
              .when(F.col("a") != F.col("b"), "label_changed").otherwise("unchanged"))
    rows = j.withColumn("CHANGE", change).join(split, "PATIENT_ID", "left")
    text = [F.col(c).cast("string").alias(c) for c in (*KEY, "b", "a")]
    return relation_hash(rows.select("SPLIT", "CHANGE", *text), "SPLIT", "CHANGE")


def removal_reasons(prior: DataFrame, candidate: DataFrame, decisions: DataFrame) -> DataFrame:
    """First applicable reason why a prior snapshot is not retained."""
    j = (prior.join(candidate.select(*KEY, F.lit(1).alias("_c")), KEY, "left")
         .join(decisions.select(*KEY, "PRIOR_INITIATION", "RETAIN", F.lit(1).alias("_d")), KEY, "left"))
    return j.withColumn("REASON", F.when(F.col("_c").isNull(), "missing").when(F.col("_d").isNull(), "outside_window")
                        .when(F.col("PRIOR_INITIATION") == 1, "prior_event").when(F.col("RETAIN") == 0, "unobserved_negative").otherwise("retained"))
