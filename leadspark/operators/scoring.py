"""A rubric as data: signals priced by criterion, criteria summed into dimensions, dimensions weighted into a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions.numeric import clamp, half_up_ratio

#: Share of a criterion's points that an unknown earns, in percent.
UNKNOWN = 30


def criterion_scores(signals: DataFrame, states: DataFrame, rubric: DataFrame, prices: DataFrame) -> DataFrame:
    """signals: (owner_id, criterion, signal); states: (owner_id, criterion, is_unknown, applies); rubric: (criterion,
    dimension, max_points, aggregation); prices: (criterion, signal, points). An unpriced signal is dropped.

    earned is the best price (max) or their sum up to the most (sum_capped); an unknown with no signal earns 30 percent,
    half-up; an inapplicable criterion leaves both sums."""
    priced = signals.join(F.broadcast(prices), ["criterion", "signal"]).groupBy("owner_id", "criterion").agg(F.max("points").alias("best"), F.sum("points").alias("total"))
    c = states.join(F.broadcast(rubric), "criterion").join(priced, ["owner_id", "criterion"], "left")
    fired = F.when(F.col("aggregation") == "max", F.col("best")).otherwise(F.least("total", "max_points"))
    unknown = F.col("best").isNull() & F.col("is_unknown")
    earned = F.when(F.col("best").isNotNull(), fired).when(unknown, half_up_ratio(F.col("max_points") * UNKNOWN, F.lit(100))).otherwise(0)
    return c.where("applies").select("owner_id", "dimension", "criterion", "max_points", earned.cast("int").alias("earned"), unknown.alias("unknown"))


def dimension_scores(criteria: DataFrame, adjustments: DataFrame | None = None) -> DataFrame:
    """owner_id, dimension, score: 100 x earned / most, half-up, plus adjustments, 0 to 100."""
    d = criteria.groupBy("owner_id", "dimension").agg(F.sum("earned").alias("earned"), F.sum("max_points").alias("most"))
    if adjustments is None:
        d = d.withColumn("adjustment", F.lit(0))
    else:
        a = adjustments.groupBy("owner_id", "dimension").agg(F.sum("points").alias("adjustment"))
        d = d.join(a, ["owner_id", "dimension"], "left").fillna(0, ["adjustment"])
    return d.withColumn("score", clamp(half_up_ratio(F.col("earned"), F.col("most"), 100) + F.col("adjustment"), 0, 100).cast("int"))


def qualification(dimensions: DataFrame, weights: dict[str, int]) -> DataFrame:
    """owner_id, qualification_score over the dimensions there are: absent ones leave the weights too."""
    w = F.coalesce(*[F.when(F.col("dimension") == k, F.lit(v)) for k, v in weights.items()])
    g = dimensions.withColumn("w", w).where("w is not null").groupBy("owner_id").agg(F.sum(F.col("score") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    return g.select("owner_id", half_up_ratio(F.col("s"), F.col("w")).cast("int").alias("qualification_score"))


def missing_labels(criteria: DataFrame) -> DataFrame:
    """owner_id, missing: the unknown criteria in order, joined."""
    return criteria.where("unknown").groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_set("criterion")), ";").alias("missing"), F.count("*").alias("n_missing"))


def percentile_threshold(scores: DataFrame, percentile: int, rounding: str, minimum: int = 8, floor: int = 50, fixed: int = 70) -> DataFrame:
    """threshold, population: the nearest-rank percentile of the score, its rank rounded half up or to the ceiling; the
    fixed threshold below the least population, and never under the floor. Ranks come from counts by score."""
    n = F.sum("n").over(Window.partitionBy())
    counts = scores.groupBy("score").agg(F.count("*").alias("n"))  # at most 101 rows
    upto = F.expr("sum(n) over (order by score)")
    rank = F.call_function("div", n * percentile + (50 if rounding == "half_up" else 99), F.lit(100))
    ranked = counts.select("score", n.alias("population"), upto.alias("upto"), F.greatest(F.lit(1), rank).alias("at"))
    found = ranked.groupBy("population").agg(F.min(F.when(F.col("upto") >= F.col("at"), F.col("score"))).alias("t"))
    return found.select(F.when(F.col("population") < minimum, fixed).otherwise(F.greatest("t", F.lit(floor))).cast("int").alias("threshold"), "population")


def vertical_gate(qualified: Column, fired: Column, positive: list[str]) -> Column:
    """qualified turns false where no positive signal fired; the row stays."""
    return F.when(qualified & ~F.arrays_overlap(fired, F.array(*map(F.lit, positive))), F.lit(False)).otherwise(qualified)
