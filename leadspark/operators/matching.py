"""Requests against offers: candidates, hard filters without short-circuit, scores, ranks, and why nothing matched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions.numeric import clamp, half_up_ratio
from leadspark.functions.tristate import outcome

#: Ranks of category relations, and the points of criterion product fit.
RELATIONS = ("none", "adjacent", "parent", "exact")
RULES = ("HF-01", "HF-02", "HF-03", "HF-04", "HF-05", "HF-06", "HF-07", "HF-08")


def category_relation(wanted: Column, offered: Column, parents: dict[str, str], adjacent: dict[str, str]) -> Column:
    """exact, parent (either way or siblings' parent offered), adjacent (same group) or none; NULL if either is unknown."""
    # CASE, not a map: it stays in generated code and stops at the first hit.
    table = lambda d, c: F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in sorted(d.items())], F.lit(None).cast("string"))
    parent = F.coalesce(table(parents, wanted) == offered, F.lit(False)) | F.coalesce(table(parents, offered) == wanted, F.lit(False))
    near = F.coalesce(table(adjacent, wanted) == table(adjacent, offered), F.lit(False))
    return F.when(wanted.isNull() | offered.isNull(), None).when(wanted == offered, "exact").when(parent, "parent").when(near, "adjacent").otherwise("none")


def rule_conditions(tolerance_pct: int = 0) -> dict[str, tuple[Column, Column]]:
    """The eight hard filters on a candidate row: whether each applies (never null), and whether it holds, null if unknown.
    A verified empty list counts."""
    within = lambda value, ceiling: F.col(value) * 100 <= F.col(ceiling) * (100 + tolerance_pct)
    model = F.col("model")
    flag = F.when(model == "oem_odm", F.col("oem_odm")).when(model == "private_label", F.col("private_label")).when(model == "branded", F.col("brand_export"))
    certs = F.size(F.array_except("required_certs", "certs")) == 0
    return {
        "HF-01": (F.col("wanted_category").isNotNull(), F.when(F.col("relation").isNotNull(), F.col("relation").isin("exact", "parent"))),
        "HF-02": (model != "either", flag),
        "HF-03": (F.col("max_moq").isNotNull(), F.when(F.coalesce("moq_unit", F.lit("units")) == F.coalesce("rfq_unit", F.lit("units")), within("moq", "max_moq"))),
        "HF-04": ((F.size("required_certs") > 0) & F.coalesce("certs_verified", F.lit(False)), F.when(F.col("certs").isNotNull(), certs)),
        "HF-05": (F.col("destination").isNotNull() & F.col("excluded_markets").isNotNull(), ~F.array_contains("excluded_markets", F.col("destination"))),
        "HF-06": (F.lit(True), F.coalesce(~F.col("operational_status").isin("closed", "unreachable"), F.lit(True))),
        "HF-07": (F.col("max_lead").isNotNull(), within("lead_days", "max_lead")),
        "HF-08": (F.size("excluded_countries") > 0, F.when(F.col("seller_country").isNotNull(), ~F.array_contains("excluded_countries", F.col("seller_country")))),
    }


def rule_outcomes(tolerance_pct: int = 0) -> dict[str, Column]:
    """Each hard filter's na, pass, fail or skip; an unknown skips."""
    return {r: outcome(*c) for r, c in rule_conditions(tolerance_pct).items()}


def with_outcomes(candidates: DataFrame) -> DataFrame:
    """Adds fail_mask, in which bit k says that rule k fails: every rule is judged, none cuts the others short. A number
    keeps the eight rules in one piece of generated code; lists of rules are made of it only where they are shown. Each
    condition is read once, which keeps that code small enough for the JVM to compile."""
    fails = rule_failures()
    mask = sum((F.when(fails[r], 1 << k).otherwise(0) for k, r in enumerate(RULES)), F.lit(0))
    return candidates.withColumn("fail_mask", mask)


def rule_failures() -> dict[str, Column]:
    """Whether each rule fails; never null."""
    return {r: applies & ~F.coalesce(holds, F.lit(True)) for r, (applies, holds) in rule_conditions().items()}


def passing(candidates: DataFrame) -> DataFrame:
    """The candidates that no rule rejects, with fail_mask 0. One filter a rule, so that a rule on one side of the join
    is applied before it."""
    for fails in rule_failures().values():
        candidates = candidates.where(~fails)
    return candidates.withColumn("fail_mask", F.lit(0))


def rejected(df: DataFrame) -> DataFrame:
    """The rows of with_outcomes that some rule rejects. A generator drops the others: a filter would be pushed down and
    judge every candidate twice."""
    kept = F.explode(F.when(F.col("fail_mask") > 0, F.array("fail_mask"))).alias("fail_mask")
    return df.select(*[c for c in df.columns if c != "fail_mask"], kept)


def n_failed() -> Column:
    return F.bit_count("fail_mask")


def failed() -> Column:
    """The rules that fail, in order."""
    return F.array_compact(F.array(*[F.when(F.col("fail_mask").bitwiseAND(F.lit(1 << k)) > 0, F.lit(r)) for k, r in enumerate(RULES)]))


def _ladder(known: Column, *steps: tuple[Column, int], unknown: int, otherwise: int = 0) -> Column:
    out = F.when(~known, unknown)
    for when, points in steps:
        out = out.when(when, points)
    return out.otherwise(otherwise)


#: Weight of each component in percent.
WEIGHTS = {"product_fit": 30, "model_fit": 20, "operation_fit": 15, "compliance_fit": 15, "market_fit": 10, "evidence_quality": 10}


#: Points of the seller's own line of trade, and certificates of a quality system.
COMPANY_POINTS = {"oem_odm": 20, "manufacturer": 20, "brand": 8, "distributor": 4, "other": 2}
QUALITY_CERTS = ("ISO22716", "CGMP")
OTHER_QUALITY_CERTS = ("ISO9001", "ISO14001", "GMP_KOREA", "COSMOS", "ECOCERT")


def with_seller_points(sellers: DataFrame) -> DataFrame:
    """Adds what a seller earns whatever is asked: own_points (breadth of models, role) and quality_points. Priced before
    sellers meet requests, so once a seller and not once a candidate."""
    flags = [F.col(c) for c in ("oem_odm", "private_label", "brand_export")]
    kind, certs = F.col("company_type"), F.col("certs")
    breadth = F.when(F.coalesce(*flags).isNull(), 4).otherwise(sum((F.when(f, p).otherwise(0) for f, p in zip(flags, (5, 5, 2), strict=True)), F.lit(0)))
    role = _ladder(kind.isNotNull(), *[(kind == k, p) for k, p in COMPANY_POINTS.items()], unknown=6)
    held = lambda tokens: F.arrays_overlap(certs, F.array(*map(F.lit, tokens)))
    return sellers.withColumns({"own_points": breadth + role, "quality_points": _ladder(certs.isNotNull(), (held(QUALITY_CERTS), 10), (held(OTHER_QUALITY_CERTS), 6), unknown=3)})


def with_scores(df: DataFrame, tolerance_pct: int = 0) -> DataFrame:
    """Component scores (0 to 100), contributions in hundredths, and base_score, their unrounded sum rounded once.

    A component is its criteria's points over the most points of those that apply: without required certificates only
    the quality system counts. A ladder's unknown step is the half-up of 30 percent of its best, and comes before all
    others, so an unknown quantity is unknown whether or not the request limits it. Adjustments come after the ratio: a
    model that is known to be wanting costs 75, quantities in different units 10, a verified list of certificates earns 5."""
    rel, moq, top, lead, limit = (F.col(c) for c in ("relation", "moq", "max_moq", "lead_days", "max_lead"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    within = lambda value, ceiling: value * 100 <= ceiling * (100 + tolerance_pct)
    flags = [F.col(c) for c in ("oem_odm", "private_label", "brand_export")]
    flag = F.when(F.col("model") == "oem_odm", flags[0]).when(F.col("model") == "private_label", flags[1]).otherwise(flags[2])
    some, known = yes(flags[0]) | yes(flags[1]) | yes(flags[2]), F.coalesce(*flags).isNotNull()
    either = F.col("model") == "either"
    product = _ladder(rel.isNotNull(), (rel == "exact", 60), (rel == "parent", 42), (rel == "adjacent", 24), unknown=18)
    model = _ladder(known, (either & some, 56), (either, 0), (yes(flag), 60), (flag.isNull() & some, 36), unknown=18)
    model += F.col("own_points")
    same_unit = F.coalesce("moq_unit", F.lit("units")) == F.coalesce("rfq_unit", F.lit("units"))
    size = _ladder(moq.isNotNull() & same_unit, (top.isNull(), 44), (moq * 2 <= top, 55), (moq <= top, 47), (within(moq, top), 25), unknown=17)
    lead_time = _ladder(lead.isNotNull(), (limit.isNull(), 20), (lead <= limit, 25), (within(lead, limit), 12), unknown=8)
    cap = _ladder(F.col("capacity").isNotNull(), (F.col("quantity").isNull(), 16), (F.col("capacity") >= 2 * F.col("quantity"), 20), (F.col("capacity") >= F.col("quantity"), 16), unknown=6)
    need, have, certs = F.col("_need"), F.col("_have"), F.col("certs")
    verified, asked = yes(F.col("certs_verified")), F.col("_need") > 0
    comply = F.when(asked, _ladder(certs.isNotNull(), ((have == need) & verified, 55), (have == need, 38), (have * 2 >= need, 35), (have > 0, 20), unknown=17)).otherwise(0)
    comply += F.col("quality_points")
    market = _ladder(F.col("seller_region").isNotNull(), (F.col("seller_country") == F.col("destination"), 45), (F.col("seller_region") == F.col("destination_region"), 32), unknown=14, otherwise=22)
    scaled = lambda points, best, adjust=0: clamp(half_up_ratio(points, best if isinstance(best, Column) else F.lit(best), 100) + adjust, 0, 100).cast("int")
    df = df if "own_points" in df.columns else with_seller_points(df)
    df = df.withColumns({"_need": F.size("required_certs"), "_have": F.size(F.array_intersect("required_certs", "certs"))})
    df = df.withColumns({
        "product_fit": scaled(product, 60), "model_fit": scaled(model, 92, F.when(~either & ~flag, -75).otherwise(0)), "operation_fit": scaled(size + lead_time + cap, 100, F.when(~same_unit, -10).otherwise(0)),
        "compliance_fit": scaled(comply, F.when(asked, 65).otherwise(10), F.when(verified, 5).otherwise(0)), "market_fit": scaled(market, 45),
    }).drop("_need", "_have")
    df = df.withColumn("evidence_quality", F.coalesce("evidence_quality", F.lit(0)))
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0))
    return df.withColumn("base_score", half_up_ratio(total, F.lit(100)).cast("int"))


def top_matches(df: DataFrame, n: int = 10) -> DataFrame:
    """Passing candidates, ranked within their request; the window keeps n rows a request before it shuffles."""
    w = Window.partitionBy("rfq_id").orderBy(F.desc("base_score"), F.asc_nulls_last("seller_domain"), "seller_id")
    return df.where("fail_mask = 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= min(n, 50))


def no_match_diagnosis(df: DataFrame) -> DataFrame:
    """For each rule that rejects any: candidates it rejects, and those it alone rejects (what relaxing it would gain).
    Counted by pattern first, of which there are at most 256, so no row is exploded. The pattern without failures goes
    with the explosion: a filter on it would be pushed down and judge every candidate twice."""
    patterns = df.groupBy("fail_mask").agg(F.count("*").alias("n"))
    e = patterns.select(F.explode(failed()).alias("rule"), "n", (n_failed() == 1).alias("alone"))
    return e.groupBy("rule").agg(F.sum("n").alias("rejected"), F.sum(F.when(F.col("alone"), F.col("n")).otherwise(0)).alias("sole_blocker"))


def rerank_guard(rows: DataFrame, max_delta: int = 5) -> DataFrame:
    """rows: (run_id, id, base, delta). Bounded deltas, and nobody overtakes one whose base is more than max_delta
    higher: a final score is at most the least final score of those. Whoever holds one of those back has a base higher
    still and so is among them: the least final score is the least proposed one, and a window over their bases tells it.
    No delta is a delta of zero; without a base there is no final score."""
    delta = clamp(F.coalesce("delta", F.lit(0)), -max_delta, max_delta)
    rows = rows.select("run_id", "id", "base", "delta").withColumn("_proposed", clamp(F.col("base") + delta, 0, 100))
    above = Window.partitionBy("run_id").orderBy(F.desc("base")).rangeBetween(Window.unboundedPreceding, -max_delta - 1)
    final = F.when(F.col("base").isNotNull(), F.least("_proposed", F.min("_proposed").over(above))).cast("int")
    return rows.select(*[F.col(c).cast(kind) for c, kind in (("run_id", "long"), ("id", "long"), ("base", "int"), ("delta", "int"))], final.alias("final"))
