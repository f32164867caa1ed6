"""Calibration of scores against reviewers' verdicts, and differences between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.cluster import cut
from leadspark.functions.names import blind_key
from leadspark.functions.numeric import rate

#: Score bands and thresholds of the sweep.
BANDS = ((0, 49), (50, 59), (60, 69), (70, 79), (80, 89), (90, 100))
SWEEP = tuple(range(50, 91, 5))


def _block() -> list:
    accepted, rejected = F.count_if(F.col("verdict") == "accept"), F.count_if(F.col("verdict") == "reject")
    return [F.count("*").alias("scored"), F.count("verdict").alias("reviewed"), accepted.alias("accepted"), rejected.alias("rejected")]


def acceptance(rows: DataFrame, *groups: str) -> DataFrame:
    """Counts and acceptance rate (in ten-thousandths) for each value of each group column, in one pass over the rows."""
    sets = ", ".join(f"({g})" for g in groups)
    rows.createOrReplaceTempView("_acceptance_rows")
    name = " ".join(f"WHEN grouping({g}) = 0 THEN '{g}'" for g in groups)
    value = " ".join(f"WHEN grouping({g}) = 0 THEN CAST({g} AS STRING)" for g in groups)
    g = rows.sparkSession.sql(
        f"SELECT CASE {name} END AS breakdown, CASE {value} END AS value, count(*) AS scored, count(verdict) AS reviewed,"
        f" count_if(verdict = 'accept') AS accepted, count_if(verdict = 'reject') AS rejected FROM _acceptance_rows GROUP BY GROUPING SETS ({sets})"
    )
    return g.withColumn("rate_bp", rate(F.col("accepted"), F.col("accepted") + F.col("rejected")))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """For each threshold the accepted and rejected at or above it, with precision and recall in ten-thousandths."""
    cells = rows.where("verdict in ('accept', 'reject')").groupBy("score").agg(*_block()[2:])  # one row a score
    at = F.explode(F.array(*map(F.lit, SWEEP)))
    s = cells.select("*", at.alias("threshold"))
    above = lambda c: F.sum(F.when(F.col("score") >= F.col("threshold"), F.col(c)).otherwise(0))
    g = s.groupBy("threshold").agg(above("accepted").alias("accepted"), above("rejected").alias("rejected"), F.sum("accepted").alias("all_accepted"))
    return g.select("threshold", "accepted", "rejected", rate(F.col("accepted"), F.col("accepted") + F.col("rejected")).alias("precision_bp"), rate(F.col("accepted"), F.col("all_accepted")).alias("recall_bp"))


def auc(rows: DataFrame, *by: str) -> DataFrame:
    """Mann-Whitney AUC in ten-thousandths from counts by score: twice the wins plus the ties, over twice all pairs.
    The rows are first counted by score, so no pair is ever made and the windows run over at most one row a score."""
    cells = rows.where("verdict in ('accept', 'reject')").groupBy(*by, "score").agg(*_block()[2:])
    w = Window.partitionBy(*by).orderBy("score") if by else Window.orderBy("score")
    below = F.sum("rejected").over(w) - F.col("rejected")
    u2 = cells.withColumn("u2", F.col("accepted") * (2 * below + F.col("rejected")))
    g = u2.groupBy(*by).agg(F.sum("u2").alias("u2"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    return g.select(*by, "accepted", "rejected", rate(F.col("u2"), 2 * F.col("accepted") * F.col("rejected")).alias("auc_bp"))


def blind_order(rows: DataFrame) -> DataFrame:
    """The review sheet's order that tells nothing of the score: by hash, then id. The position is counted within the
    hash's first two digits and offset, so no task numbers all rows."""
    r = rows.withColumn("key", blind_key(F.col("record_id"))).withColumn("part", F.substring("key", 1, 2))
    sizes = r.groupBy("part").agg(F.count("*").alias("n"))  # 256 rows
    sizes = sizes.select(F.col("part").alias("_part"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    r = r.withColumn("row", F.row_number().over(Window.partitionBy("part").orderBy("key", "record_id"))).join(F.broadcast(sizes), F.col("part") == F.col("_part"))
    return r.withColumn("position", F.col("before") + F.col("row")).drop("part", "_part", "row", "before")


def revealing_columns(rows: DataFrame, origin: str, columns: list[str]) -> DataFrame:
    """Columns whose cell shapes (filled, empty) are disjoint between the two origins, and so must be blanked."""
    shape = lambda c: F.when(F.col(c).isNull(), "empty").otherwise("filled")
    g = rows.groupBy(origin).agg(*[F.collect_set(shape(c)).alias(c) for c in columns])
    long = g.select(origin, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("shapes")) for c in columns])).alias("x")).select(origin, "x.*")
    both = long.groupBy("column_name").agg(F.collect_list("shapes").alias("s"), F.count("*").alias("origins"))
    return both.select("column_name", ((F.col("origins") == 2) & ~F.arrays_overlap(F.get("s", F.lit(0)), F.get("s", F.lit(1)))).alias("revealing"))


def run_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Runs of (id, state returned|excluded, score, rules): one row an id with its change and score delta."""
    b, a = (df.select("id", *[F.col(c).alias(f"{c}_{s}") for c in ("state", "score", "rules")]) for df, s in ((before, "before"), (after, "after")))
    j = b.join(a, "id", "full_outer")
    sb, sa = F.col("state_before"), F.col("state_after")
    change = (
        F.when(sb.isNull(), "new").when(sa.isNull(), "gone")
        .when((sb == "returned") & (sa == "excluded"), "newly_excluded").when((sb == "excluded") & (sa == "returned"), "newly_returned")
        .when((sb == "excluded") & ~F.col("rules_before").eqNullSafe(F.col("rules_after")), "exclusion_changed").when(sb == "excluded", "excluded_both")
        .when(~F.col("score_before").eqNullSafe(F.col("score_after")), "changed").otherwise("unchanged")
    )
    sides = lambda x, y: F.array_join(F.array_sort(F.array_except(F.coalesce(F.col(x), F.array().cast("array<string>")), F.coalesce(F.col(y), F.array().cast("array<string>")))), ";")
    return j.withColumn("change", change).withColumn("delta", F.col("score_after") - F.col("score_before")).withColumn("rules_added", sides("rules_after", "rules_before")).withColumn("rules_removed", sides("rules_before", "rules_after"))


def pair_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """before_id, id, matched_by of the records of two runs with id and merged_from (array). Equal ids pair; then each later
    record, in order of ids, takes the smallest open earlier id that it absorbed; then the other way round.

    Taking turns in one order has one stable outcome, so all choose at once and who comes second to an id loses it, until
    none does; each round drops links and is checkpointed."""
    b, a = (df.where("id is not null").select("id", "merged_from") for df in (before, after))
    same = b.select("id").join(a.select("id"), "id").select(F.col("id").alias("before_id"), "id", F.lit("id").alias("matched_by"))

    def absorbed(hosts: DataFrame, parts: DataFrame) -> DataFrame:
        links = hosts.select(F.col("id").alias("host"), F.explode("merged_from").alias("part")).distinct()
        links = cut(links.join(parts.select(F.col("id").alias("part")), "part", "left_semi"))
        while True:
            wish = links.groupBy("host").agg(F.min("part").alias("part"))
            held = wish.groupBy("part").agg(F.min("host").alias("holder"))
            left = cut(links.join(held, "part", "left").where("holder is null or host <= holder").select("host", "part"))
            if left.count() == links.count():
                return wish
            links = left

    open_b, open_a = b.join(a.select("id"), "id", "left_anti"), a.join(b.select("id"), "id", "left_anti")
    first = absorbed(open_a, open_b)
    second = absorbed(open_b.join(first, open_b.id == first.part, "left_anti"), open_a.join(first, open_a.id == first.host, "left_anti"))
    merged = first.select(F.col("part").alias("before_id"), F.col("host").alias("id")).union(second.select("host", "part"))
    return same.union(merged.select("before_id", "id", F.lit("merged_from").alias("matched_by")))


def dimension_changes(pairs: DataFrame) -> DataFrame:
    """id, dimension, before, after, delta of what differs in the maps dims_before and dims_after; NULL is absent."""
    maps = [F.coalesce(c, F.create_map().cast("map<string,int>")) for c in ("dims_before", "dims_after")]
    names = F.array_union(*[F.map_keys(m) for m in maps])
    long = pairs.select("id", *[m.alias(c) for m, c in zip(maps, ("b", "a"), strict=True)], F.explode(names).alias("dimension"))
    long = long.select("id", "dimension", *[F.try_element_at(m, F.col("dimension")).alias(c) for m, c in (("b", "before"), ("a", "after"))])
    return long.where("not (before <=> after)").withColumn("delta", F.col("after") - F.col("before"))


def missing_changes(pairs: DataFrame) -> DataFrame:
    """id, added, removed of the labels missing_before and missing_after, in their own order; no row where nothing
    changed or a side has no list."""
    d = pairs.select("id", F.array_except("missing_after", "missing_before").alias("added"), F.array_except("missing_before", "missing_after").alias("removed"))
    return d.where("size(added) > 0 or size(removed) > 0")
