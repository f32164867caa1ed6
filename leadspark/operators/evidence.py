"""Evidence: strength by tier and age, best item, quality, confidence, conflicts, recheck queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions.numeric import clamp, half_up_ratio

#: Points of a source tier; age limits in days with names and multipliers in percent; undated items.
TIER_POINTS = (100, 82, 64, 46, 20)
BUCKETS = ((90, "fresh", 100), (365, "current", 92), (730, "aging", 80), (None, "stale", 60))
UNDATED = 92
#: Component weights in percent, bonuses and penalties.
WEIGHTS = {"strength": 50, "coverage": 35, "corroboration": 15}
OFFICIAL, PER_DOMAIN, DOMAINS_CAP, STALE, CONFLICT, CONFLICT_FLOOR, INFERRED = 10, 7, 15, -25, -10, -20, -8


def age_days(source_date: Column, as_of: Column) -> Column:
    """Whole days, not below 0; NULL for an undated item."""
    return F.when(source_date.isNotNull(), F.greatest(F.datediff(as_of, source_date), F.lit(0)))


def _by_age(age: Column, place: int, undated) -> Column:
    out = F.when(age.isNull(), F.lit(undated))
    for limit, *values in BUCKETS[:-1]:
        out = out.when(age <= limit, F.lit(values[place]))
    return out.otherwise(F.lit(BUCKETS[-1][1 + place]))


def recency_bucket(age: Column) -> Column:
    return _by_age(age, 0, "undated")


def multiplier_percent(age: Column) -> Column:
    return _by_age(age, 1, UNDATED)


def with_strength(evidence: DataFrame, as_of: Column) -> DataFrame:
    """Adds age_days, bucket and strength = half-up of tier points times the age's multiplier."""
    points = F.coalesce(F.get(F.array(*map(F.lit, TIER_POINTS)), F.col("source_tier") - 1), F.lit(0))
    e = evidence.withColumn("age_days", age_days(F.col("source_date"), as_of))
    return e.withColumn("bucket", recency_bucket(F.col("age_days"))).withColumn("strength", half_up_ratio(points * multiplier_percent(F.col("age_days")), F.lit(100)))


def best_items(evidence: DataFrame) -> DataFrame:
    """The strongest item of each (owner, claim): strength desc, tier asc, date desc (undated last), id asc.

    An aggregate, not a window: only one row of each group crosses the shuffle from each task."""
    day = F.coalesce(F.unix_date("source_date"), F.lit(-(10**6)))
    order = F.struct((-F.col("strength")).alias("a"), F.col("source_tier").alias("b"), (-day).alias("c"), F.col("evidence_id").alias("d"))
    fields = [c for c in evidence.columns if c not in ("owner_id", "claim")]
    return evidence.groupBy("owner_id", "claim").agg(F.min_by(F.struct(*fields), order).alias("e")).select("owner_id", "claim", "e.*")


def conflict_pairs(evidence: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """Distinct unordered pairs of an item and an id that it contradicts, dangling ids and the item itself included. Items
    whose claim is among the record's `resolved` claims are settled and make no pair."""
    e = evidence.where("conflicts_with is not null")
    if records is not None:
        settled = records.select(F.col("owner_id").alias("_o"), F.explode("resolved").alias("_c"))
        e = e.join(settled, (F.col("owner_id") == F.col("_o")) & (F.col("claim") == F.col("_c")), "left_anti")
    x, y = F.col("evidence_id"), F.col("conflicts_with")
    return e.select("owner_id", F.least(x, y).alias("first_id"), F.greatest(x, y).alias("second_id")).distinct()


def quality(evidence: DataFrame, material: list[str], as_of: Column, records: DataFrame | None = None) -> DataFrame:
    """owner_id, quality (0 to 100) and what it is made of. records: owner_id, stale, resolved (claims whose conflicts are
    settled) and unknown_claims, a row for each owner; an owner without items has quality 0. Without it owners are those of items.

    Mean strength of the covered material claims' best items, share of material claims covered, and corroborating domains, weighted;
    a bonus for any official item of the first tier and for further domains; a penalty if the record is stale or every
    covered claim's best item is too old, for conflicts, and if any covered claim is only inferred. Domains, official
    items and conflicts count over all items, not only those of material claims. It is rounded once."""
    e = with_strength(evidence, as_of)
    day = F.coalesce(F.unix_date("source_date"), F.lit(-(10**6)))
    order = F.struct((-F.col("strength")).alias("a"), F.col("source_tier").alias("b"), (-day).alias("c"), F.col("evidence_id").alias("d"))
    best = F.min_by(F.struct("strength", "age_days"), order)
    claims = e.where(F.col("claim").isin(*material)).groupBy("owner_id", "claim").agg(best.alias("best"), F.min(F.coalesce("inferred", F.lit(False)).cast("int")).alias("inferred"))
    old = F.coalesce(F.col("best.age_days") > BUCKETS[-2][0], F.lit(False)).cast("int")
    covered = claims.groupBy("owner_id").agg(F.sum("best.strength").alias("s"), F.count("*").alias("claims"), F.min(old).alias("old"), F.max("inferred").alias("inferred"))
    official = F.max(F.coalesce(F.col("is_official") & (F.col("source_tier") == 1), F.lit(False)).cast("int"))
    items = e.groupBy("owner_id").agg(F.count_distinct("domain").alias("domains"), official.alias("official"))
    pairs = conflict_pairs(evidence, records).groupBy("owner_id").agg(F.count("*").alias("conflicts"))
    q = items.withColumn("items", F.lit(1)).join(covered, "owner_id", "left").join(pairs, "owner_id", "left")
    if records is not None:
        q = records.select("owner_id", F.coalesce("stale", F.lit(False)).cast("int").alias("stale"), "unknown_claims").join(q, "owner_id", "left")
    else:
        q = q.withColumn("stale", F.lit(0)).withColumn("unknown_claims", F.lit(len(material)) - F.coalesce("claims", F.lit(0)))
    q = q.fillna(0, ["s", "claims", "old", "inferred", "domains", "official", "conflicts", "items"])
    extra = F.col("official") * OFFICIAL + F.greatest(F.lit(0), F.least(F.lit(DOMAINS_CAP), PER_DOMAIN * (F.col("domains") - 1)))
    extra = extra + F.greatest("stale", "old") * STALE + F.greatest(F.lit(CONFLICT_FLOOR), F.col("conflicts") * CONFLICT) + F.col("inferred") * INFERRED
    q = q.withColumn("corroboration", clamp(50 * (F.col("domains") - 1), 0, 100))
    c, m = F.greatest("claims", F.lit(1)), len(material)
    whole = WEIGHTS["strength"] * F.col("s") * m + WEIGHTS["coverage"] * 100 * F.col("claims") * c + (WEIGHTS["corroboration"] * F.col("corroboration") + 100 * extra) * c * m
    score = F.when(F.col("items") > 0, clamp(half_up_ratio(F.greatest(whole, F.lit(0)), 100 * c * m), 0, 100)).otherwise(0)
    return q.select("owner_id", "claims", "domains", "conflicts", "stale", "unknown_claims", score.cast("int").alias("quality"))


def confidence(quality_rows: DataFrame) -> DataFrame:
    """Confidence in hundredths: quality x max(50, 100 - 5 per unknown material claim) percent, x 60 percent for a stale
    record, x 85 percent with conflicts; 5 to 100."""
    factor = F.greatest(F.lit(50), 100 - 5 * F.col("unknown_claims"))
    stale, conflict = F.when(F.col("stale") > 0, 60).otherwise(100), F.when(F.col("conflicts") > 0, 85).otherwise(100)
    return quality_rows.withColumn("confidence_pct", clamp(half_up_ratio(F.col("quality") * factor * stale * conflict, F.lit(1_000_000)), 5, 100).cast("int"))


def ranked(df: DataFrame, score: str, *ties: str, by: list[str] | None = None) -> DataFrame:
    """rank by score desc, then ties asc with unknowns last. Without `by` the ranks are global, so they are taken per
    range of a range-partitioned sort, offset by counts, not in one task."""
    order = [F.desc_nulls_last(score), *[F.asc_nulls_last(t) for t in ties]]
    if by:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    parts = df.groupBy(score).agg(F.count("*").alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(Window.orderBy(F.desc_nulls_last(score))) - F.col("_n")).drop("_n").withColumnRenamed(score, "_score")
    within = df.withColumn("_row", F.row_number().over(Window.partitionBy(score).orderBy(*order[1:])))
    return within.join(parts, F.col(score).eqNullSafe(F.col("_score"))).withColumn("rank", F.col("_before") + F.col("_row")).drop("_before", "_row", "_score")


def recheck_items(evidence: DataFrame, as_of: Column, limit: int = 365) -> DataFrame:
    """Items due for another look: older than `limit` days or flagged stale, unless a current item backs the same claim."""
    e = evidence.withColumn("age_days", age_days(F.coalesce("source_date", "observed_on"), as_of)).withColumn("bucket", recency_bucket(F.col("age_days")))
    e = e.withColumn("is_current", (F.col("age_days") <= limit) & ~F.col("stale"))
    backed = F.max("is_current").over(Window.partitionBy("owner_id", "claim"))
    reason = F.when(F.col("stale"), "flagged_stale").when(F.col("source_date").isNull(), "undated").otherwise("too_old")
    return e.withColumn("backed", backed).withColumn("reason", F.when(~F.col("is_current") & ~F.col("backed"), reason))


def claim_findings(items: DataFrame) -> DataFrame:
    """Claims of which no item is current, with counts."""
    g = items.groupBy("owner_id", "claim").agg(F.count("*").alias("items"), F.count_if("is_current").alias("current_items"), F.max("age_days").cast("int").alias("oldest_days"))
    return g.where("current_items = 0")
