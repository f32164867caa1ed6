"""Evidence as a stream, an extension of the batch operators: the best item of each claim, and counts over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_claims(evidence: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Items and first-tier items by claim and window of observed_at; rows later than the watermark are left out, and a
    window is emitted once it is closed."""
    w = evidence.withWatermark("observed_at", late).groupBy(F.window("observed_at", window), "claim")
    return w.agg(F.count("*").alias("items"), F.count_if(F.col("source_tier") == 1).alias("tier1")).select(F.col("window.start").alias("start"), "claim", "items", "tier1")


def best_items(evidence: DataFrame) -> DataFrame:
    """The strongest item of each (owner, claim) so far, for update or complete mode; state is one row a group."""
    order = F.struct((-F.col("strength")).alias("a"), F.col("source_tier").alias("b"), F.col("evidence_id").alias("c"))
    return evidence.groupBy("owner_id", "claim").agg(F.min_by("evidence_id", order).alias("evidence_id"), F.max("strength").alias("strength"))
