"""Merging the records of one component: the survivor first, then the others by id, each folded into what stands.

A fold's outcome at a step depends only on what came before it, so each is a running aggregate over the component's rows in
fold order, which sorts and spills, and no Python folds a component. Rows carry component, absorbed (false for the
survivor) and record_id. NULL is unknown: it never overwrites, and an empty list is a verified none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States that need a score, and the state before it.
SCORED = ("QUALIFIED", "MATCH_CANDIDATE", "READY_FOR_REVIEW")
UNSCORED = "VERIFIED"


def _order(*keys: str):
    w = Window.partitionBy("component", *keys).orderBy("absorbed", "record_id")
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _backing() -> Column:
    """A record's best item for a field, so that the greatest is the best: confidence, tier, newest source, smallest id."""
    best = F.struct(
        F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"), (-F.coalesce("tier", F.lit(99))).alias("tier"), F.coalesce(F.col("source_date").cast("string"), F.lit("")).alias("dated"),
        (-F.col("evidence_id")).alias("id"), F.coalesce("official", F.lit(False)).alias("official"),
    )
    return F.when(F.col("evidence_id").isNotNull(), best)


def _folded(values: DataFrame) -> DataFrame:
    before = _order("field")
    v = values.withColumn("own", _backing())
    v = v.withColumn("best", F.max("own").over(before)).withColumn("held", F.max(F.col("value").isNotNull()).over(before))
    rank = lambda c: F.struct(F.col(f"{c}.confidence"), F.col(f"{c}.tier"))
    better = F.col("own").isNotNull() & (F.col("best").isNull() | (rank("own") > rank("best")))
    takes = F.col("value").isNotNull() & (~F.coalesce("held", F.lit(False)) | better)
    v = v.withColumn("takes", F.coalesce(takes, F.lit(False)))
    return v.withColumn("standing", F.last(F.when(F.col("takes"), F.col("value")), ignorenulls=True).over(before))


def merge_fields(values: DataFrame) -> DataFrame:
    """component, field, value, record_id: which value stands, and whose. Values come as (component, absorbed, record_id,
    field, value) with the record's best item for the field: evidence_id, confidence, tier, source_date, official.

    A known value beats an unknown one, a backed one that of a field not backed so far, and of two backed ones the higher
    confidence, then the lower tier; on ties the earlier stands. Items of earlier records back the field whichever
    value they gave; an item that a newer reading of its page replaces counts as long as it is among the rows."""
    at = F.struct("absorbed", "record_id")
    f = _folded(values).groupBy("component", "field").agg(F.max_by("value", F.when(F.col("takes"), at)).alias("value"), F.max(F.when(F.col("takes"), at))["record_id"].alias("record_id"))
    return f


def field_conflicts(values: DataFrame) -> DataFrame:
    """component, field, record_id, winning_value, losing_value, resolution: one row a fold in which two known values differ."""
    v = _folded(values).where("value <> standing")
    winner, loser = (F.when(F.col("takes") == side, F.col("own")).otherwise(F.col("best")) for side in (True, False))
    v = v.select("*", winner.alias("w"), loser.alias("l"))
    resolution = (
        F.when(F.col("w").isNull(), "manual").when(F.col("l").isNull(), "higher_confidence").when(F.col("w.official") & ~F.col("l.official"), "official_source")
        .when(F.col("w.confidence") != F.col("l.confidence"), "higher_confidence").when(F.col("w.dated") != F.col("l.dated"), "more_recent").otherwise("manual")
    )
    pick = lambda a, b: F.when(F.col("takes"), F.col(a)).otherwise(F.col(b))
    return v.select("component", "field", "record_id", pick("value", "standing").alias("winning_value"), pick("standing", "value").alias("losing_value"), resolution.alias("resolution"))


def merge_lists(lists: DataFrame) -> DataFrame:
    """component, field, items: the sorted union of the known lists; NULL if none is known, empty if all are verified empty."""
    items = F.array_sort(F.collect_set("item"))
    known = lists.where("items is not null").groupBy("component", "field").agg(F.count("*").alias("_known"))
    each = lists.select("component", "field", F.explode("items").alias("item")).groupBy("component", "field").agg(items.alias("items"))
    every = lists.select("component", "field").distinct()
    found = every.join(known, ["component", "field"], "left").join(each, ["component", "field"], "left")
    return found.select("component", "field", F.when(F.col("_known") > 0, F.coalesce("items", F.array().cast("array<string>"))).alias("items"))


def list_conflicts(lists: DataFrame) -> DataFrame:
    """component, field, record_id, loser: folds in which a verified empty list lost to a list with items."""
    before, size = _order("field"), F.size("items")
    v = lists.where("items is not null").withColumn("n", size).withColumn("so_far", F.max("n").over(before))
    loser = F.when((F.col("so_far") == 0) & (F.col("n") > 0), "survivor").when((F.col("so_far") > 0) & (F.col("n") == 0), "absorbed")
    return v.select("component", "field", "record_id", loser.alias("loser")).where("loser is not null")


def merge_records(records: DataFrame) -> DataFrame:
    """One row a component, from (component, absorbed, record_id, domain, website, depth, stale, operational_status, seen, state):
    what merged, the other domains, the shallowest website (ties: the earlier record's), stale only if all are (NULL if none
    says), the status that was evidenced last (ties: the earlier), and the state, which a merge sets back, as scores go with it."""
    before = _order()
    seen = F.coalesce(F.col("seen").cast("string"), F.lit(""))
    r = records.withColumn("_seen", seen)
    known, latest = F.col("operational_status").isNotNull(), F.coalesce(F.max("_seen").over(before), F.lit(""))
    first = ~F.coalesce(F.max(known).over(before), F.lit(False))
    r = r.withColumn("_takes", known & (first | (F.col("_seen") > latest)))
    at = F.struct("absorbed", "record_id")
    g = r.groupBy("component").agg(
        F.min_by("record_id", at).alias("survivor"), F.array_sort(F.collect_set("record_id")).alias("_ids"), F.min_by("domain", F.when(F.col("domain").isNotNull(), at)).alias("domain"), F.array_sort(F.collect_set("domain")).alias("_domains"),
        F.min_by("website", F.when(F.col("depth").isNotNull(), F.struct("depth", "absorbed", "record_id"))).alias("website"), F.when(F.count("stale") > 0, F.count_if("stale") == F.count("*")).alias("stale"),
        F.max_by("operational_status", F.when(F.col("_takes"), at)).alias("operational_status"), F.min_by("state", at).alias("_state"),
    )
    merged = F.size("_ids") > 1
    return g.select(
        "component", "survivor", F.array_except("_ids", F.array("survivor")).alias("merged_from"), "domain", F.array_except("_domains", F.array("domain")).alias("alias_domains"), "website", "stale", "operational_status",
        F.when(merged & F.col("_state").isin(*SCORED), UNSCORED).otherwise(F.col("_state")).alias("state"), merged.alias("unscored"),
    )
