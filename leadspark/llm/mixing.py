"""Mixing sources to target weights.

Words are summed per source; each source's target over its size is its repetition rate. A document is emitted
floor(rate) times, plus one Bernoulli copy with the fraction as probability. Its trial is a hash of the seed, the doc_id and the
text, so a document's copies depend on itself and its source's rate only. After the sums all is one narrow pass.

Independent trials stray: a source of many documents comes within a few parts of a hundred of its target, a source of
few, or with a few very long ones, may miss by a tenth (the README has figures). Nothing is drawn anew to hide that.

Defined results: a null text has no words; the null source is a source like others and comes last; sources without
words have target 0; rows equal in doc_id and text share their trial; very long texts are counted whole, and taken or left
whole. Columns of the documents are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm.common import materialise

#: Weights of the sources in their order, repeating; the share of all words to take; the most repetitions.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2.0
SEED = 20240607
#: Up to so many sources their table is broadcast; more are joined by Spark's choice.
BROADCAST_ROWS = 100_000
#: Fixed value: runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]++"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with `rank`, from 0 by code point, null last. Sources are dealt out by range and numbered in their
    partition; only the partitions' counts reach the driver, so that no task sees all sources."""
    spark: SparkSession = sizes.sparkSession
    order = [F.col("mix_source").isNull(), F.col("mix_source")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    dealt = materialise(dealt, "mix-sources")
    part = F.shiftright("place", 33).cast("int")
    first, rows = 0, []
    for p, n in sorted(tuple(r) for r in dealt.groupBy(part.alias("part")).agg(F.count("*")).collect()):
        rows.append((p, first))
        first += n
    firsts = F.broadcast(spark.createDataFrame(rows or [(0, 0)], "part int, first long"))  # a row for each partition
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("part", part).join(firsts, "part").select("mix_source", "mix_source_size", (F.col("first") + within).alias("rank"))


def targets(sizes: DataFrame) -> DataFrame:
    """sizes: (mix_source, mix_source_size), one row a source. Adds mix_weight and mix_target.

    All sources share the total by weight; those above their cap get the cap, and what is over is shared again among the others,
    until none is above. A round is one sum over the sources; two numbers of it reach the driver. Its level, words for
    a unit of weight, only rises, so a source once capped stays so, and the rounds end when no more are."""
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = _ranked(sizes).withColumn("mix_weight", F.element_at(weights, (F.col("rank") % len(WEIGHTS)).cast("int") + 1)).withColumn("cap", F.col("mix_source_size") * F.lit(MOST))
    total = (s.agg(F.sum("mix_source_size")).first()[0] or 0) * TOTAL
    level, capped = 0.0, -1
    while True:
        above = F.col("mix_weight") * F.lit(level) > F.col("cap")
        n, held, free = s.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("mix_weight")))).first()
        if n == capped or not free:
            break
        level, capped = (total - (held or 0.0)) / free, n
    return s.select("mix_source", "mix_source_size", "mix_weight", F.least(F.col("cap"), F.col("mix_weight") * F.lit(level)).alias("mix_target"))


def plan(documents: DataFrame, columns: list[str], seed: int = SEED) -> DataFrame:
    """For each row its columns as the struct `row`, its doc_id, mix_size, mix_source_size, mix_target and mix_copies,
    how often the mix takes it."""
    size = n_words(F.col("text"))
    rates = materialise(targets(documents.groupBy(F.col("source").alias("mix_source")).agg(F.sum(size).alias("mix_source_size"))), "mix-targets")
    if rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rates = F.broadcast(rates)
    trial = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    row = F.struct(*[F.col(f"`{c}`") for c in columns]) if columns else F.lit(0)
    docs = documents.select(row.alias("row"), "doc_id", "source", size.alias("mix_size"), trial.alias("mix_trial"))
    both = docs.join(rates, docs["source"].eqNullSafe(rates["mix_source"]))
    rate = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (F.col("mix_trial") < rate - F.floor(rate)).cast("int")
    return both.select("row", "doc_id", "mix_size", "mix_source_size", "mix_target", copies.cast("int").alias("mix_copies"))


def mix(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of documents, each as often as the plan says."""
    taken = plan(documents, documents.columns, seed).where("mix_copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies"))).alias("copy")).select("row.*")


def report(documents: DataFrame) -> DataFrame:
    return plan(documents, []).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))
