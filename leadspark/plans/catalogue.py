"""The registered queries over the tables of a folder, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.functions import names, tristate
from leadspark.operators import buyer, calibrate, matching, publish, resolve, scoring
from leadspark.operators import evidence as ev
from leadspark.plans import oracle as O
from leadspark.plans import projections as P
from leadspark.plans import records  # noqa: F401 registers its queries
from leadspark.plans.registry import QUERIES, SQL, query

def as_of():
    return F.lit(P.AS_OF).cast("date")


def strong(spark, sf):
    return ev.with_strength(P.evidence(spark, sf), as_of())


def quality(spark, sf):
    return ev.quality(P.evidence(spark, sf), P.MATERIAL, as_of(), P.owners(spark, sf))


# Evidence


@query(O.behind(O.EVIDENCE, "SELECT owner_id, CAST(quality AS INT) AS quality, claims, row_number() OVER (ORDER BY quality DESC, owner_id) AS rank FROM quality"))
def evidence_quality_rank(spark, sf):
    return ev.ranked(quality(spark, sf), "quality", "owner_id").select("owner_id", "quality", "claims", "rank")


@query(O.behind(O.EVIDENCE, "SELECT owner_id, claim, evidence_id, CAST(strength AS BIGINT) AS strength, bucket FROM best"))
def evidence_best_item(spark, sf):
    return ev.best_items(strong(spark, sf)).select("owner_id", "claim", "evidence_id", "strength", "bucket")


@query(O.behind(O.EVIDENCE, "SELECT owner_id, pct AS confidence_pct, CASE WHEN pct >= 75 THEN 'HIGH' WHEN pct >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT owner_id, CAST(greatest(5, least(100, (2 * quality * greatest(50, 100 - 5 * unknown_claims) * CASE WHEN stale THEN 60 ELSE 100 END * CASE WHEN conflicts > 0 THEN 85 ELSE 100 END + 1000000) // 2000000)) AS INT) AS pct FROM quality)"))
def evidence_confidence(spark, sf):
    c = ev.confidence(quality(spark, sf))
    return c.select("owner_id", "confidence_pct", tristate.confidence_band(F.col("confidence_pct"), 75, 50).alias("band"))


@query(O.behind(O.EVIDENCE, "SELECT owner_id, first_id, second_id FROM pairs"))
def evidence_conflict_pairs(spark, sf):
    return ev.conflict_pairs(P.evidence(spark, sf), P.owners(spark, sf))


@query(O.behind(O.EVIDENCE, "SELECT claim, bucket, count(*) AS n, CAST(max(age_days) AS INT) AS oldest FROM strong GROUP BY 1, 2"))
def evidence_recency_buckets(spark, sf):
    return strong(spark, sf).groupBy("claim", "bucket").agg(F.count("*").alias("n"), F.max("age_days").alias("oldest"))


@query(O.behind(O.EVIDENCE, "SELECT owner_id, max(observed_on) AS as_of, count(*) AS items FROM evidence GROUP BY 1"))
def evidence_as_of(spark, sf):
    return P.evidence(spark, sf).groupBy("owner_id").agg(F.max("observed_on").alias("as_of"), F.count("*").alias("items"))


@query(O.behind(O.EVIDENCE, "SELECT s_suppkey AS seller_id FROM supplier WHERE s_suppkey IN (SELECT owner_id FROM evidence WHERE claim IN ('purchase', 'signup'))"))
def material_evidence_semi(spark, sf):
    e = P.evidence(spark, sf).where("claim in ('purchase', 'signup')")
    s = P.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("seller_id"))
    return s.join(e, s.seller_id == e.owner_id, "left_semi")


@query(O.behind(O.EVIDENCE, "SELECT c_custkey AS record_id, CASE WHEN n = 0 THEN 'no_evidence' ELSE 'no_material_evidence' END AS reason FROM (SELECT c_custkey, count(owner_id) AS n, count(*) FILTER (claim = 'purchase') AS m FROM customer LEFT JOIN evidence ON owner_id = c_custkey GROUP BY 1) WHERE m = 0"))
def no_evidence_anti(spark, sf):
    e = P.evidence(spark, sf).groupBy("owner_id").agg(F.count("*").alias("n"), F.count_if(F.col("claim") == "purchase").alias("m"))
    c = P.read(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"))
    return c.join(e, c.record_id == e.owner_id, "left").where("coalesce(m, 0) = 0").select("record_id", F.when(F.col("n").isNull(), "no_evidence").otherwise("no_material_evidence").alias("reason"))


# Recheck

_RECHECK = """, aged AS (SELECT *, greatest(date_diff('day', coalesce(source_date, observed_on), DATE '2024-02-15'), 0) AS age FROM evidence),
cur AS (SELECT *, age <= 365 AND NOT stale AS is_current, max((age <= 365 AND NOT stale)::INT) OVER (PARTITION BY owner_id, claim) AS backed, CASE WHEN age <= 90 THEN 'fresh' WHEN age <= 365 THEN 'current' WHEN age <= 730 THEN 'aging' ELSE 'stale' END AS bucket FROM aged),
rc AS (SELECT *, CASE WHEN NOT is_current AND backed = 0 THEN CASE WHEN stale THEN 'flagged_stale' WHEN source_date IS NULL THEN 'undated' ELSE 'too_old' END END AS reason FROM cur)"""


def rechecked(spark, sf):
    return ev.recheck_items(P.evidence(spark, sf), as_of())


@query(O.behind(O.EVIDENCE + _RECHECK, "SELECT owner_id, claim, evidence_id, CAST(age AS INT) AS age_days, bucket, is_current, reason FROM rc"))
def recheck_items(spark, sf):
    return rechecked(spark, sf).select("owner_id", "claim", "evidence_id", "age_days", "bucket", "is_current", "reason")


@query(O.behind(O.EVIDENCE + _RECHECK, "SELECT owner_id, claim, count(*) AS items, count(*) FILTER (is_current) AS current_items, CAST(max(age) AS INT) AS oldest_days FROM rc GROUP BY 1, 2 HAVING count(*) FILTER (is_current) = 0"))
def recheck_claims(spark, sf):
    return ev.claim_findings(rechecked(spark, sf))


@query(O.behind(O.EVIDENCE + _RECHECK, "SELECT owner_id, claim, oldest_days, items, row_number() OVER (ORDER BY oldest_days DESC, owner_id, claim) AS position FROM (SELECT owner_id, claim, CAST(max(age) AS INT) AS oldest_days, count(*) AS items FROM rc WHERE reason IS NOT NULL GROUP BY 1, 2)"))
def recheck_queue(spark, sf):
    due = rechecked(spark, sf).where("reason is not null").groupBy("owner_id", "claim").agg(F.max("age_days").alias("oldest_days"), F.count("*").alias("items"))
    return ev.ranked(due, "oldest_days", "owner_id", "claim").withColumnRenamed("rank", "position")


@query(O.behind(O.EVIDENCE + _RECHECK, "SELECT spine.reason, spine.bucket, count(rc.evidence_id) AS n FROM (SELECT * FROM (VALUES ('flagged_stale'), ('undated'), ('too_old')) AS x(reason), (VALUES ('fresh'), ('current'), ('aging'), ('stale')) AS y(bucket)) AS spine LEFT JOIN rc ON rc.reason = spine.reason AND rc.bucket = spine.bucket GROUP BY 1, 2"))
def recheck_by_reason(spark, sf):
    spine = spark.createDataFrame([(r, b) for r in ("flagged_stale", "undated", "too_old") for b in ("fresh", "current", "aging", "stale")], "reason string, bucket string")
    counts = rechecked(spark, sf).where("reason is not null").groupBy("reason", "bucket").agg(F.count("*").alias("n"))
    return spine.join(counts, ["reason", "bucket"], "left").fillna(0, ["n"])


# Requests, filters, matches


@query(O.behind(O.RFQS, "SELECT rfq_id, wanted_category, quantity, model, max_moq, max_lead, destination, array_to_string(required_certs, ';') AS required_certs FROM rfqs"))
def rfq_projection(spark, sf):
    return P.rfqs(spark, sf).select("rfq_id", "wanted_category", "quantity", "model", "max_moq", "max_lead", "destination", F.array_join("required_certs", ";").alias("required_certs"))


@query(O.behind(O.RFQS, "SELECT rfq_id, (wanted_category IS NOT NULL)::INT + (max_moq IS NOT NULL)::INT + (max_lead IS NOT NULL)::INT + (destination IS NOT NULL)::INT AS filled, 4 AS \"of\", array_to_string(list_filter([CASE WHEN destination IS NULL THEN 'destination' END, CASE WHEN max_lead IS NULL THEN 'max_lead' END, CASE WHEN max_moq IS NULL THEN 'max_moq' END, CASE WHEN wanted_category IS NULL THEN 'wanted_category' END], lambda x: x IS NOT NULL), ';') AS missing FROM rfqs"))
def rfq_readiness(spark, sf):
    return publish.readiness(P.rfqs(spark, sf), ["wanted_category", "max_moq", "max_lead", "destination"])


@query(O.behind(O.RFQS, "SELECT rfq_id, printf('Q-%02d', CAST(row_number() OVER (PARTITION BY rfq_id ORDER BY rank) AS INT)) AS question_id, field FROM (SELECT rfq_id, 1 AS rank, 'wanted_category' AS field FROM rfqs WHERE wanted_category IS NULL UNION ALL SELECT rfq_id, 2, 'destination' FROM rfqs WHERE destination IS NULL UNION ALL SELECT rfq_id, 3, 'max_moq' FROM rfqs WHERE max_moq IS NULL UNION ALL SELECT rfq_id, 4, 'max_lead' FROM rfqs WHERE max_lead IS NULL)"))
def intake_questions(spark, sf):
    return publish.open_questions(P.rfqs(spark, sf), {"wanted_category": 1, "destination": 2, "max_moq": 3, "max_lead": 4})


@query(O.behind(O.SELLERS, "SELECT seller_id FROM sellers WHERE coalesce(category IN ('STANDARD', 'SMALL'), true) AND coalesce(oem_odm, true) AND coalesce(list_has_all(certs, ['ISO22716']), true) AND coalesce(operational_status <> 'closed', true)"))
def retrieval_filter(spark, sf):
    known = lambda cond: F.coalesce(cond, F.lit(True))  # noqa: E731  an unknown never excludes
    return P.sellers(spark, sf).where(known(F.col("category").isin("STANDARD", "SMALL")) & known(F.col("oem_odm")) & known(F.array_contains("certs", "ISO22716")) & known(F.col("operational_status") != "closed")).select("seller_id")


def _rule_query(k: int, name: str):
    @query(O.behind(O.CANDIDATES, f"SELECT model, coalesce(destination, '?') AS destination, hf{k} AS outcome, count(*) AS n FROM rules GROUP BY 1, 2, 3"))
    def rule(spark, sf):
        out = matching.rule_outcomes()[f"HF-0{k}"]
        return P.candidates(spark, sf).groupBy("model", F.coalesce("destination", F.lit("?")).alias("destination"), out.alias("outcome")).agg(F.count("*").alias("n"))

    for table in (QUERIES, SQL):
        table[f"hf_{name}"] = table.pop("rule")


for _k, _name in enumerate(("category", "model", "moq", "certs", "excluded_market", "status", "lead_time", "country"), 1):
    _rule_query(_k, _name)


def judged(spark, sf):
    return matching.with_outcomes(P.candidates(spark, sf))


@query(O.behind(O.CANDIDATES, "SELECT rfq_id, seller_id, array_to_string(failed, ';') AS failed FROM failing WHERE len(failed) > 0"))
def hf_all_failures(spark, sf):
    return matching.rejected(judged(spark, sf)).select("rfq_id", "seller_id", F.array_join(matching.failed(), ";").alias("failed"))


@query(O.behind(O.CANDIDATES, "SELECT rule, count(*) AS rejected, count(*) FILTER (alone) AS sole_blocker FROM (SELECT unnest(failed) AS rule, len(failed) = 1 AS alone FROM failing) GROUP BY 1"))
def hf_rule_counts(spark, sf):
    return matching.no_match_diagnosis(judged(spark, sf))


@query(O.behind(O.CANDIDATES, "SELECT rfq_id, count(*) AS considered, count(*) FILTER (len(failed) = 0) AS passing, count(*) FILTER (len(failed) = 1) AS nearly FROM failing GROUP BY 1 HAVING count(*) FILTER (len(failed) = 0) = 0"))
def no_match_requests(spark, sf):
    g = judged(spark, sf).groupBy("rfq_id").agg(F.count("*").alias("considered"), F.count_if(F.col("fail_mask") == 0).alias("passing"), F.count_if(matching.n_failed() == 1).alias("nearly"))
    return g.where("passing = 0")


@query(O.behind(O.CANDIDATES, "SELECT wanted_category, category, relation, count(*) AS n FROM cand GROUP BY 1, 2, 3"))
def category_relation(spark, sf):
    return P.candidates(spark, sf).groupBy("wanted_category", "category", "relation").agg(F.count("*").alias("n"))


@query("SELECT n_name AS country, r_name AS region, count(c_custkey) AS parties FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1, 2")
def region_membership(spark, sf):
    n, r = P.read(spark, sf, "nation"), P.read(spark, sf, "region").where(F.col("r_name").isin("ASIA", "EUROPE"))
    c = P.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("c_custkey").alias("n"))
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).join(c, n.n_nationkey == c.c_nationkey, "left")
    return j.select(F.col("n_name").alias("country"), F.col("r_name").alias("region"), F.coalesce("n", F.lit(0)).alias("parties"))


@query(O.behind(O.CANDIDATES, "SELECT rfq_id, seller_id, base_score, CAST(product_fit AS INT) AS product_fit, CAST(operation_fit AS INT) AS operation_fit, CAST(compliance_fit AS INT) AS compliance_fit FROM scored"))
def match_base_score(spark, sf):
    return matching.with_scores(P.candidates(spark, sf)).select("rfq_id", "seller_id", "base_score", "product_fit", "operation_fit", "compliance_fit")


_TOP = "SELECT rfq_id, seller_id, base_score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY rfq_id ORDER BY base_score DESC, seller_domain NULLS LAST, seller_id) AS rank FROM scored WHERE len(failed) = 0) WHERE rank <= 10"


@query(O.behind(O.CANDIDATES, _TOP))
def match_topn(spark, sf):
    return matching.top_matches(matching.with_scores(matching.passing(P.candidates(spark, sf)))).select("rfq_id", "seller_id", "base_score", F.col("rank").cast("int").alias("rank"))


@query(O.behind(O.CANDIDATES, "SELECT rfq_id, seller_id, component, contribution, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY rfq_id, seller_id ORDER BY contribution DESC, component) AS INT) AS place FROM (SELECT rfq_id, seller_id, unnest(['product_fit', 'model_fit', 'operation_fit', 'compliance_fit', 'market_fit', 'evidence_quality']) AS component, CAST(unnest([product_fit * 30, model_fit * 20, operation_fit * 15, compliance_fit * 15, market_fit * 10, eq * 10]) AS INT) AS contribution FROM scored WHERE len(failed) = 0)) WHERE place <= 2"))
def match_rationale(spark, sf):
    """The two components that contribute most to each passing match, without a shuffle: sorted within the row."""
    df = matching.with_scores(matching.passing(P.candidates(spark, sf)))
    part = lambda c: F.struct((-F.col(c) * matching.WEIGHTS[c]).alias("minus"), F.lit(c).alias("component"))
    best = F.slice(F.array_sort(F.array(*map(part, matching.WEIGHTS))), 1, 2)
    return df.select("rfq_id", "seller_id", F.posexplode(best).alias("p", "x")).select("rfq_id", "seller_id", "x.component", (-F.col("x.minus")).cast("int").alias("contribution"), (F.col("p") + 1).cast("int").alias("place"))


@query()
def rerank_guard(spark, sf):
    top = match_topn(spark, sf)
    rows = top.select(F.col("rfq_id").alias("run_id"), F.col("seller_id").alias("id"), F.col("base_score").alias("base"), (F.pmod(F.xxhash64("seller_id", "rfq_id"), F.lit(21)) - 10).cast("int").alias("delta"))
    return matching.rerank_guard(rows)


# Rubric scores of sellers

RUBRIC = [("S-CM2", "commercial_model", 12, "sum_capped"), ("S-CM4", "commercial_model", 20, "max"), ("S-EX2", "export_readiness", 30, "max"), ("S-CP4", "compliance_readiness", 10, "max")]
PRICES = [("S-CM2", "oem_odm", 5), ("S-CM2", "private_label", 5), ("S-CM2", "brand_export", 2), ("S-CM4", "oem_odm", 20), ("S-CM4", "manufacturer", 20), ("S-CM4", "brand", 8), ("S-CM4", "distributor", 4), ("S-CM4", "other", 2), ("S-EX2", "english", 30), ("S-EX2", "partial", 18), ("S-EX2", "false", 0), ("S-CP4", "ISO22716", 10), ("S-CP4", "CGMP", 10), *[("S-CP4", c, 6) for c in matching.OTHER_QUALITY_CERTS]]
SCORE_WEIGHTS = {"commercial_model": 20, "export_readiness": 10, "compliance_readiness": 15}
_CRITERIA = f"""{O.SELLERS},
crit AS (SELECT seller_id AS owner_id, 'S-CM2' AS criterion, 'commercial_model' AS dimension, 12 AS max_points, CASE WHEN oem_odm OR private_label OR brand_export THEN least(12, 5 * coalesce(oem_odm, false)::INT + 5 * coalesce(private_label, false)::INT + 2 * coalesce(brand_export, false)::INT) WHEN oem_odm IS NULL AND private_label IS NULL AND brand_export IS NULL THEN 4 ELSE 0 END AS earned, (oem_odm IS NULL AND private_label IS NULL AND brand_export IS NULL) AND NOT coalesce(oem_odm OR private_label OR brand_export, false) AS unknown FROM sellers
 UNION ALL SELECT seller_id, 'S-CM4', 'commercial_model', 20, CASE company_type WHEN 'oem_odm' THEN 20 WHEN 'manufacturer' THEN 20 WHEN 'brand' THEN 8 WHEN 'distributor' THEN 4 WHEN 'other' THEN 2 ELSE 6 END, company_type IS NULL FROM sellers
 UNION ALL SELECT seller_id, 'S-EX2', 'export_readiness', 30, CASE WHEN english IS NULL THEN 9 WHEN english = 0 THEN 0 WHEN english = 1 THEN 18 ELSE 30 END, english IS NULL FROM sellers WHERE seller_id % 6 <> 0
 UNION ALL SELECT seller_id, 'S-CP4', 'compliance_readiness', 10, CASE WHEN certs IS NULL THEN 3 WHEN list_has_any(certs, ['ISO22716', 'CGMP']) THEN 10 ELSE 0 END, certs IS NULL FROM sellers),
dims AS (SELECT owner_id, dimension, CAST(greatest(0, least(100, (200 * sum(earned) + sum(max_points)) // (2 * sum(max_points)) - CASE WHEN dimension = 'commercial_model' AND any_value(s.operational_status) = 'closed' THEN 20 ELSE 0 END)) AS INT) AS score FROM crit JOIN sellers s ON s.seller_id = owner_id GROUP BY 1, 2),
qual AS (SELECT owner_id, CAST((2 * sum(score * w) + sum(w)) // (2 * sum(w)) AS INT) AS qualification_score FROM (SELECT *, CASE dimension WHEN 'commercial_model' THEN 20 WHEN 'export_readiness' THEN 10 ELSE 15 END AS w FROM dims) GROUP BY 1)"""


def criteria(spark, sf):
    """Signals are read off each seller in place and scored through the rubric tables."""
    s = P.sellers(spark, sf)
    fire = lambda c, cond, signal: F.when(cond, F.struct(F.lit(c).alias("criterion"), signal.alias("signal")))
    flags = [fire("S-CM2", F.col(c), F.lit(c)) for c in ("oem_odm", "private_label", "brand_export")]
    english = F.when(F.col("english") == 0, "false").when(F.col("english") == 1, "partial").when(F.col("english") > 1, "english")
    found = F.array_compact(F.array(*flags, fire("S-CM4", F.col("company_type").isNotNull(), F.col("company_type")), fire("S-EX2", english.isNotNull(), english)))
    certs = F.transform(F.coalesce("certs", F.array().cast("array<string>")), lambda x: F.struct(F.lit("S-CP4").alias("criterion"), x.alias("signal")))
    signals = s.select(F.col("seller_id").alias("owner_id"), F.explode(F.concat(found, certs)).alias("x")).select("owner_id", "x.*")
    state = lambda c, unknown, applies: F.struct(F.lit(c).alias("criterion"), F.coalesce(unknown, F.lit(False)).alias("is_unknown"), applies.alias("applies"))
    yes = F.lit(True)
    states = F.array(state("S-CM2", F.coalesce("oem_odm", "private_label", "brand_export").isNull(), yes), state("S-CM4", F.col("company_type").isNull(), yes), state("S-EX2", F.col("english").isNull(), F.col("seller_id") % 6 != 0), state("S-CP4", F.col("certs").isNull(), yes))
    states = s.select(F.col("seller_id").alias("owner_id"), F.explode(states).alias("x")).select("owner_id", "x.*")
    rubric = spark.createDataFrame(RUBRIC, "criterion string, dimension string, max_points int, aggregation string")
    return scoring.criterion_scores(signals, states, rubric, spark.createDataFrame(PRICES, "criterion string, signal string, points int"))


def dimensions(spark, sf):
    closed = P.sellers(spark, sf).where("operational_status = 'closed'").select(F.col("seller_id").alias("owner_id"), F.lit("commercial_model").alias("dimension"), F.lit(-20).alias("points"))
    return scoring.dimension_scores(criteria(spark, sf), closed)


@query(O.behind(_CRITERIA, "SELECT owner_id, criterion, earned, unknown FROM crit WHERE criterion <> 'S-CM2'"))
def criterion_max(spark, sf):
    return criteria(spark, sf).where("criterion <> 'S-CM2'").select("owner_id", "criterion", "earned", "unknown")


@query(O.behind(_CRITERIA, "SELECT owner_id, criterion, earned, unknown FROM crit WHERE criterion = 'S-CM2'"))
def criterion_sum_capped(spark, sf):
    return criteria(spark, sf).where("criterion = 'S-CM2'").select("owner_id", "criterion", "earned", "unknown")


@query(O.behind(_CRITERIA, "SELECT owner_id, dimension, score FROM dims"))
def dimension_score(spark, sf):
    return dimensions(spark, sf).select("owner_id", "dimension", "score")


@query(O.behind(_CRITERIA, "SELECT owner_id, qualification_score FROM qual"))
def qualification_score(spark, sf):
    return scoring.qualification(dimensions(spark, sf), SCORE_WEIGHTS)


@query(O.behind(_CRITERIA, "SELECT owner_id, string_agg(criterion, ';' ORDER BY criterion) AS missing, count(*) AS n_missing FROM crit WHERE unknown GROUP BY 1"))
def missing_labels(spark, sf):
    return scoring.missing_labels(criteria(spark, sf))


@query(O.behind(_CRITERIA, "SELECT criterion, max_points - earned AS penalty, count(*) AS n FROM crit WHERE unknown GROUP BY 1, 2"))
def unknown_penalty(spark, sf):
    return criteria(spark, sf).where("unknown").groupBy("criterion", (F.col("max_points") - F.col("earned")).alias("penalty")).agg(F.count("*").alias("n"))


def _threshold_query(name: str, rounding: str, add: int):
    @query(O.behind(_CRITERIA, f"SELECT CAST(CASE WHEN count(*) < 8 THEN 70 ELSE greatest(50, list_sort(list(qualification_score))[greatest(1, (count(*) * 75 + {add}) // 100)]) END AS INT) AS threshold, count(*) AS population FROM qual"))
    def threshold(spark, sf):
        scores = qualification_score(spark, sf).select(F.col("qualification_score").alias("score"))
        return scoring.percentile_threshold(scores, 75, rounding)

    for table in (QUERIES, SQL):
        table[name] = table.pop("threshold")


_threshold_query("percentile_threshold_half_up", "half_up", 50)
_threshold_query("percentile_threshold_ceil", "ceil", 99)


@query(O.behind(_CRITERIA, "SELECT q.owner_id, qualification_score, qualification_score >= 40 AND coalesce(s.company_type IN ('oem_odm', 'manufacturer'), false) AS qualified FROM qual q JOIN sellers s ON s.seller_id = q.owner_id"))
def vertical_gate(spark, sf):
    s = P.sellers(spark, sf).select(F.col("seller_id").alias("owner_id"), F.coalesce(F.when(F.col("company_type").isNotNull(), F.array("company_type")), F.array().cast("array<string>")).alias("fired"))
    q = qualification_score(spark, sf).join(s, "owner_id")
    return q.select("owner_id", "qualification_score", scoring.vertical_gate(F.col("qualification_score") >= 40, F.col("fired"), ["oem_odm", "manufacturer"]).alias("qualified"))


@query(O.behind(_CRITERIA, "SELECT owner_id, qualification_score, row_number() OVER (ORDER BY qualification_score DESC, seller_domain NULLS LAST, owner_id) AS rank FROM qual JOIN sellers ON seller_id = owner_id"))
def discovery_rank(spark, sf):
    q = qualification_score(spark, sf).join(P.sellers(spark, sf).select(F.col("seller_id").alias("owner_id"), "seller_domain"), "owner_id")
    return ev.ranked(q, "qualification_score", "seller_domain", "owner_id").select("owner_id", "qualification_score", "rank")


@query(O.behind(_CRITERIA, "SELECT d.owner_id, stored, CAST(qualification_score AS INT) AS recomputed FROM (SELECT owner_id, CAST(qualification_score + CASE WHEN owner_id % 10 = 0 THEN 3 ELSE 0 END AS INT) AS stored, qualification_score FROM qual) d WHERE abs(stored - qualification_score) > 1"))
def invariant_weighted_sum(spark, sf):
    q = qualification_score(spark, sf)
    stored = (F.col("qualification_score") + F.when(F.col("owner_id") % 10 == 0, 3).otherwise(0)).cast("int")
    return q.select("owner_id", stored.alias("stored"), F.col("qualification_score").alias("recomputed")).where("abs(stored - recomputed) > 1")


# Buyer scores

REQUEST = buyer.Request(
    country="NATION_1", region=["NATION_2", "NATION_3", "NATION_4"], adjacent=["NATION_5", "NATION_6"], categories=["skincare"], channels=["department_store"], core=["skincare", "makeup", "sunscreen"], near=["haircare", "supplements"],
    parents={"sunscreen": "skincare"}, related=[("skincare", "makeup")], free_mail=["d0.example", "d1.example"], chains=["pharmacy", "department_store", "marketplace"],
)


@query(O.behind(O.BUYERS, "SELECT record_id, criterion, earned, unknown FROM bcrit"))
def buyer_criteria(spark, sf):
    return buyer.score(P.buyers(spark, sf), REQUEST).select("record_id", F.explode("criteria").alias("x")).select("record_id", "x.*")


@query(O.behind(O.BUYERS, "SELECT * FROM bqual"))
def buyer_scores(spark, sf):
    return buyer.score(P.buyers(spark, sf), REQUEST).drop("criteria")


@query(O.behind(O.EVIDENCE, "SELECT owner_id, array_to_string(list_sort(list(DISTINCT claim)), ';') AS claims, coalesce(array_to_string(list_sort(list(DISTINCT claim) FILTER (is_official)), ';'), '') AS official_claims, CAST(greatest(0, date_diff('day', max(source_date) FILTER (claim IN ('signup', 'view')), DATE '2024-02-15')) AS INT) AS sourcing_age, coalesce(bool_or(claim IN ('signup', 'view') AND source_date IS NULL AND observed_on <= DATE '2024-02-15'), false) AS standing_page FROM evidence GROUP BY 1"))
def buyer_claim_facts(spark, sf):
    j = lambda c: F.array_join(F.array_sort(c), ";").alias(c)
    return buyer.claim_facts(P.evidence(spark, sf), ["signup", "view"], as_of()).select("owner_id", j("claims"), j("official_claims"), "sourcing_age", "standing_page")


# Sites and entity resolution


@query(O.behind(O.SITES, "SELECT record_id, domain FROM sites"))
def url_canonical_domain(spark, sf):
    return P.sites(spark, sf).select("record_id", "domain")


@query(O.behind(O.SITES, "SELECT record_id, subdomain FROM sites"))
def url_subdomain(spark, sf):
    return P.sites(spark, sf).select("record_id", "subdomain")


@query(O.behind(O.SITES, "SELECT record_id, depth FROM sites"))
def url_path_depth(spark, sf):
    return P.sites(spark, sf).select("record_id", "depth")


@query(O.behind(O.SITES, "SELECT record_id, root FROM sites"))
def site_root(spark, sf):
    return P.sites(spark, sf).select("record_id", "root")


@query(O.behind(O.SITES, "SELECT domain, subdomain, min(depth) AS depth, arg_min(url, (depth, record_id)) AS url FROM sites GROUP BY 1, 2"))
def shallowest_site(spark, sf):
    return P.sites(spark, sf).groupBy("domain", "subdomain").agg(F.min("depth").alias("depth"), F.min_by("url", F.struct("depth", "record_id")).alias("url"))


@query(O.behind(O.SITES, "SELECT domain, subdomain, record_id, records, tenants FROM (SELECT domain, subdomain, min(record_id) AS record_id, count(*) AS records, count(*) OVER (PARTITION BY domain) AS tenants FROM sites WHERE subdomain <> '' GROUP BY 1, 2) WHERE tenants > 1"))
def shared_hosting_pairs(spark, sf):
    return resolve.shared_hosts(P.sites(spark, sf))


@query(O.behind(O.PARTIES, "SELECT record_id, component FROM grouped"))
def dedupe_domain_components(spark, sf):
    return resolve.domain_components(P.parties(spark, sf))


@query(O.behind(O.PARTIES, "SELECT component, arg_min(record_id, (-claims, -tier1, record_id)) AS survivor, count(*) AS members, max(claims) AS claims FROM grouped GROUP BY 1"))
def dedupe_survivor(spark, sf):
    p = P.parties(spark, sf)
    return resolve.survivors(p.join(resolve.domain_components(p), "record_id"))


@query(O.behind(O.EVIDENCE, "SELECT owner_id % 50 AS component, domain AS source_url, claim, arg_max(evidence_id, (observed_on, -evidence_id)) AS evidence_id, max(observed_on) AS observed_on, count(*) AS readings FROM evidence GROUP BY 1, 2, 3"))
def dedupe_evidence_union(spark, sf):
    return resolve.evidence_union(P.evidence(spark, sf).withColumn("component", F.col("owner_id") % 50).withColumnRenamed("domain", "source_url"))


@query(O.behind(O.PARTIES, "SELECT name_key, country, count(*) AS domains, string_agg(CAST(record_id AS VARCHAR), ';' ORDER BY record_id) AS records FROM (SELECT name_key, country, domain, min(record_id) AS record_id FROM parties WHERE domain IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING count(*) > 1"))
def dedupe_suggestions(spark, sf):
    return resolve.suggestions(P.parties(spark, sf))


@query()
def dedupe_constrained(spark, sf):
    return resolve.constrained_groups(P.parties(spark, sf))


@query(O.behind(O.PARTIES, "SELECT component, string_agg(DISTINCT domain, ';' ORDER BY domain) AS alias_domains, string_agg(DISTINCT country, ';' ORDER BY country) AS countries, count(DISTINCT country) > 1 AS contradictory FROM grouped GROUP BY 1"))
def list_union(spark, sf):
    p = P.parties(spark, sf)
    j = lambda c: F.when(F.count(c) > 0, F.array_join(F.array_sort(F.collect_set(c)), ";"))
    return p.join(resolve.domain_components(p), "record_id").groupBy("component").agg(j("domain").alias("alias_domains"), j("country").alias("countries"), (F.count_distinct("country") > 1).alias("contradictory"))


@query(O.behind(O.PARTIES, "SELECT name_key, country, count(*) AS n, min(record_id) AS first_id, max(record_id) AS last_id FROM parties GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_warnings(spark, sf):
    return publish.duplicate_groups(P.parties(spark, sf).withColumnRenamed("record_id", "id"), "name_key", "country")


@query()
def name_normalise(spark, sf):
    c = P.read(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), names.normalize_name(F.concat("c_name", F.lit(" Co., Ltd."))).alias("normalized_name"))
    return c.withColumn("name_key", names.match_key(F.col("normalized_name")))


# Calibration


@query(O.behind(O.REVIEWS, "SELECT record_id, score, verdict FROM reviews"))
def review_join(spark, sf):
    return P.reviews(spark, sf).select("record_id", "score", "verdict")


@query(O.behind(O.REVIEWS, "SELECT breakdown, value, scored, reviewed, accepted, rejected, CASE WHEN accepted + rejected > 0 THEN (20000 * accepted + accepted + rejected) // (2 * (accepted + rejected)) END AS rate_bp FROM (SELECT breakdown, value, count(*) AS scored, count(verdict) AS reviewed, count(*) FILTER (verdict = 'accept') AS accepted, count(*) FILTER (verdict = 'reject') AS rejected FROM (SELECT 'lang' AS breakdown, lang AS value, verdict FROM reviews UNION ALL SELECT 'source', source, verdict FROM reviews UNION ALL SELECT 'band', CASE WHEN score < 50 THEN '0-49' WHEN score < 60 THEN '50-59' WHEN score < 70 THEN '60-69' WHEN score < 80 THEN '70-79' WHEN score < 90 THEN '80-89' ELSE '90-100' END, verdict FROM reviews) GROUP BY 1, 2)"))
def acceptance_by_group(spark, sf):
    band = F.coalesce(*[F.when(F.col("score").between(lo, hi), f"{lo}-{hi}") for lo, hi in calibrate.BANDS])
    return calibrate.acceptance(P.reviews(spark, sf).withColumn("band", band), "lang", "source", "band")


@query(O.behind(O.REVIEWS, "SELECT threshold, accepted, rejected, CASE WHEN accepted + rejected > 0 THEN (20000 * accepted + accepted + rejected) // (2 * (accepted + rejected)) END AS precision_bp, CASE WHEN al > 0 THEN (20000 * accepted + al) // (2 * al) END AS recall_bp FROM (SELECT CAST(t AS INT) AS threshold, count(*) FILTER (verdict = 'accept' AND score >= t) AS accepted, count(*) FILTER (verdict = 'reject' AND score >= t) AS rejected, count(*) FILTER (verdict = 'accept') AS al FROM reviews, generate_series(50, 90, 5) AS g(t) GROUP BY 1)"))
def threshold_sweep(spark, sf):
    return calibrate.threshold_sweep(P.reviews(spark, sf))




@query(O.behind(O.REVIEWS, "SELECT na AS accepted, nr AS rejected, CASE WHEN na * nr > 0 THEN (20000 * u2 + 2 * na * nr) // (4 * na * nr) END AS auc_bp FROM (SELECT CAST(sum(CASE WHEN x.score > y.score THEN 2 WHEN x.score = y.score THEN 1 ELSE 0 END) AS BIGINT) AS u2 FROM reviews x, reviews y WHERE x.verdict = 'accept' AND y.verdict = 'reject'), (SELECT count(*) FILTER (verdict = 'accept') AS na, count(*) FILTER (verdict = 'reject') AS nr FROM reviews)"))
def auc_overall(spark, sf):
    return calibrate.auc(P.reviews(spark, sf))


@query(O.behind(O.REVIEWS, "SELECT lang, na AS accepted, nr AS rejected, CASE WHEN na * nr > 0 THEN (20000 * coalesce(u2, 0) + 2 * na * nr) // (4 * na * nr) END AS auc_bp FROM (SELECT lang, count(*) FILTER (verdict = 'accept') AS na, count(*) FILTER (verdict = 'reject') AS nr FROM reviews WHERE verdict IN ('accept', 'reject') GROUP BY 1) LEFT JOIN (SELECT x.lang, CAST(sum(CASE WHEN x.score > y.score THEN 2 WHEN x.score = y.score THEN 1 ELSE 0 END) AS BIGINT) AS u2 FROM reviews x JOIN reviews y ON x.lang = y.lang WHERE x.verdict = 'accept' AND y.verdict = 'reject' GROUP BY 1) USING (lang)"))
def auc_by_group(spark, sf):
    return calibrate.auc(P.reviews(spark, sf), "lang")


@query(O.behind(O.REVIEWS, "SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT verdict) AS verdicts, count(DISTINCT score) AS scores FROM reviews"))
def distinct_values(spark, sf):
    return P.reviews(spark, sf).agg(*[F.count_distinct(c).alias(f"{c}s") for c in ("lang", "source", "verdict", "score")])


@query(O.behind(O.REVIEWS, "SELECT record_id, score, lang FROM reviews WHERE verdict = 'accept' AND score < 70"))
def false_exclusions(spark, sf):
    return P.reviews(spark, sf).where("verdict = 'accept' and score < 70").select("record_id", "score", "lang")


@query(O.behind(O.REVIEWS, "SELECT record_id, sha256(CAST(record_id AS VARCHAR)) AS key, row_number() OVER (ORDER BY sha256(CAST(record_id AS VARCHAR)), record_id) AS position FROM reviews"))
def blind_order(spark, sf):
    return calibrate.blind_order(P.reviews(spark, sf).select("record_id")).select("record_id", "key", "position")


@query("SELECT column_name, revealing FROM (VALUES ('props_shape', false)) AS t(column_name, revealing) WHERE false UNION ALL SELECT 'text', coalesce(max(CASE WHEN o = 1 THEN s END) <> max(CASE WHEN o = 0 THEN s END), false) FROM (SELECT (n_chars >= 2000)::INT AS o, string_agg(DISTINCT CASE WHEN text IS NULL THEN 'empty' ELSE 'filled' END, ',') AS s FROM documents GROUP BY 1) UNION ALL SELECT 'long_text', true")
def neutralise_columns(spark, sf):
    d = P.read(spark, sf, "documents").withColumn("origin", F.col("n_chars") >= 2000).withColumn("long_text", F.when(F.col("origin"), F.lit("x")))
    return calibrate.revealing_columns(d, "origin", ["text", "long_text"])


# Run differences


def diff(spark, sf):
    return calibrate.run_diff(P.run(spark, sf, 1), P.run(spark, sf, 2))


@query(O.behind(O.RUNS, "SELECT id, change, state_before, state_after FROM diff"))
def run_diff_states(spark, sf):
    return diff(spark, sf).select("id", "change", "state_before", "state_after")


@query(O.behind(O.RUNS, "SELECT id, score_after - score_before AS delta, row_number() OVER (ORDER BY abs(score_after - score_before) DESC, id) AS position FROM diff WHERE change = 'changed'"))
def run_diff_changed(spark, sf):
    c = diff(spark, sf).where("change = 'changed'").select("id", "delta", F.abs("delta").alias("size"))
    return ev.ranked(c, "size", "id").select("id", "delta", F.col("rank").alias("position"))


@query(O.behind(O.RUNS, "SELECT change, count(*) AS n, CAST(sum(abs(score_after - score_before)) AS BIGINT) AS moved FROM diff GROUP BY 1"))
def run_diff_summary(spark, sf):
    return diff(spark, sf).groupBy("change").agg(F.count("*").alias("n"), F.sum(F.abs("delta")).cast("long").alias("moved"))


@query(O.behind(O.RUNS, "SELECT id, array_to_string(list_sort(list_filter(coalesce(ra, []), lambda x: NOT list_contains(coalesce(rb, []), x))), ';') AS rules_added, array_to_string(list_sort(list_filter(coalesce(rb, []), lambda x: NOT list_contains(coalesce(ra, []), x))), ';') AS rules_removed FROM diff"))
def run_diff_rules(spark, sf):
    return diff(spark, sf).select("id", "rules_added", "rules_removed")


@query(O.behind(O.RUNS, "SELECT id, CASE WHEN fb IS NULL OR fa IS NULL THEN 'undetermined' WHEN fa THEN 'gained' ELSE 'lost' END AS flip FROM diff WHERE both_runs AND fb IS DISTINCT FROM fa"))
def run_diff_flips(spark, sf):
    b, a = (P.run(spark, sf, k).select("id", F.col("flag").alias(f"f{k}")) for k in (1, 2))
    return b.join(a, "id").select("id", tristate.flip(F.col("f1"), F.col("f2")).alias("flip")).where("flip is not null")


# Privacy, text, export, writes


@query("SELECT doc_id, regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+') AS has_email, regexp_matches(text, '\\+[0-9][0-9 ().-]{7,}[0-9]') AS has_plus_phone FROM documents")
def pii_scan(spark, sf):
    t = F.col("text")
    return P.read(spark, sf, "documents").select("doc_id", (t.contains("@") & t.rlike(publish.EMAIL)).alias("has_email"), (t.contains("+") & t.rlike(publish.PHONE_PLUS)).alias("has_plus_phone"))


@query()
def personal_data_kinds(spark, sf):
    return P.read(spark, sf, "documents").select("doc_id", publish.personal_data(F.col("text")).alias("kinds"))


@query("SELECT event_id, CASE WHEN regexp_matches(v, '^ *[=+@-]') THEN '''' || v ELSE v END AS cell FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '=' WHEN 1 THEN ' +' WHEN 2 THEN '@' WHEN 3 THEN '-' ELSE '' END || event_type AS v FROM events)")
def formula_guard(spark, sf):
    lead = F.element_at(F.array(*map(F.lit, ("=", " +", "@", "-", ""))), (F.col("event_id") % 5 + 1).cast("int"))
    return P.read(spark, sf, "events").select("event_id", names.csv_safe(F.concat(lead, "event_type")).alias("cell"))


@query("SELECT c_custkey AS record_id, CASE WHEN own = host AND own <> 'naver.com' AND list_contains(['info', 'sales', 'export', 'einkauf', 'b2b'], local_part) THEN local_part || '@' || CASE WHEN c_custkey % 2 = 0 THEN 'www.' ELSE '' END || host END AS address FROM (SELECT c_custkey, list_value('info', 'jane.doe', 'sales', 'support', 'export', 'kim', 'einkauf', 'cs', 'b2b')[c_custkey % 9 + 1] AS local_part, list_value('co.example', 'mail.co.example', 'naver.com', 'alias.example')[c_custkey % 4 + 1] AS host, list_value('co.example', 'naver.com', 'alias.example')[c_custkey % 3 + 1] AS own FROM customer)")
def role_mailbox(spark, sf):
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("c_custkey") % len(values) + 1).cast("int"))
    local, host = pick(("info", "jane.doe", "sales", "support", "export", "kim", "einkauf", "cs", "b2b")), pick(("co.example", "mail.co.example", "naver.com", "alias.example"))
    address = F.concat(F.upper(local), F.lit("@"), F.when(F.col("c_custkey") % 2 == 0, F.lit("www.")).otherwise(F.lit("")), host)
    return P.read(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), publish.role_address(address, F.array(pick(("co.example", "naver.com", "alias.example")))).alias("address"))


@query("SELECT c_custkey AS record_id, contains(regexp_replace(q, '[^0-9]', '', 'g'), CAST(c_custkey AS VARCHAR)) AS found FROM (SELECT c_custkey, c_name || ' no. ' || (c_custkey // 3) AS q FROM customer)")
def digits_in_quote(spark, sf):
    quote = F.concat("c_name", F.lit(" no. "), F.call_function("div", F.col("c_custkey"), F.lit(3)).cast("string"))
    return P.read(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), publish.number_in_quote(F.col("c_custkey"), quote).alias("found"))


@query("SELECT conv_id, turn, sha256(text) AS digest, CAST(length(text) AS INT) AS n_chars FROM conversations")
def message_digest(spark, sf):
    return P.read(spark, sf, "conversations").select("conv_id", "turn", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.char_length("text").alias("n_chars"))


@query(O.behind(O.SELLERS, "SELECT seller_id, CASE WHEN company_type = 'distributor' THEN 'not_applicable' WHEN coalesce(operational_status = 'closed', false) THEN 'withheld' WHEN certs IS NULL THEN 'unknown' WHEN len(certs) = 0 THEN 'none' ELSE array_to_string(certs, '; ') END AS cell FROM sellers"))
def export_cells(spark, sf):
    never = lambda c: F.coalesce(c, F.lit(False))
    cell = publish.export_cell(F.col("certs"), ~never(F.col("company_type") == "distributor"), never(F.col("operational_status") == "closed"))
    return P.sellers(spark, sf).select("seller_id", cell.alias("cell"))


@query(O.behind(O.RUNS + "," + O.PARTIES, "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN state <> 'returned' THEN 'status' WHEN NOT coalesce(flag, false) THEN 'not_qualified' WHEN score < 50 THEN 'below_score' WHEN NOT coalesce(country IN ('NATION_1', 'NATION_2', 'NATION_3'), false) THEN 'country' END AS reason FROM b JOIN parties ON record_id = id) GROUP BY 1"))
def export_skip_reasons(spark, sf):
    r = P.run(spark, sf, 1).join(P.parties(spark, sf).select(F.col("record_id").alias("id"), "country"), "id")
    status = F.when(F.col("state") == "returned", "SCORED").otherwise("REJECTED")
    reason = publish.skip_reason(status, F.col("flag"), F.col("score"), F.col("country"), 50, ["NATION_1", "NATION_2", "NATION_3"])
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(O.behind(O.RUNS, "SELECT a.id, a.score, a.state AS status, CASE WHEN b.id IS NULL THEN 'created' WHEN a.score = b.score AND a.state = b.state THEN 'unchanged' WHEN a.score < b.score OR (a.state = 'excluded' AND b.state = 'returned') THEN 'refused' ELSE 'updated' END AS outcome FROM a LEFT JOIN b ON a.id = b.id"))
def upsert_outcome(spark, sf):
    b, a = (P.run(spark, sf, k).select("id", "score", F.col("state").alias("status")) for k in (1, 2))
    return publish.upsert(b, a, {"excluded": 0, "returned": 1})


_STATES = ("DISCOVERED", "VERIFIED", "QUALIFIED", "MATCH_CANDIDATE", "READY_FOR_REVIEW", "CLOSED", "CONTACTED")


@query("""WITH st AS (SELECT ['DISCOVERED', 'VERIFIED', 'QUALIFIED', 'MATCH_CANDIDATE', 'READY_FOR_REVIEW', 'CLOSED', 'CONTACTED'] AS l),
edge AS (SELECT unnest([{'f': 'DISCOVERED', 't': ['VERIFIED', 'CLOSED']}, {'f': 'VERIFIED', 't': ['QUALIFIED', 'DISCOVERED', 'CLOSED']}, {'f': 'QUALIFIED', 't': ['MATCH_CANDIDATE', 'READY_FOR_REVIEW', 'VERIFIED', 'CLOSED']}, {'f': 'MATCH_CANDIDATE', 't': ['READY_FOR_REVIEW', 'QUALIFIED', 'CLOSED']}, {'f': 'READY_FOR_REVIEW', 't': ['QUALIFIED', 'MATCH_CANDIDATE', 'CLOSED']}], recursive := true)),
m AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 < 7 THEN l[o_orderkey % 8 + 1] END AS from_state, l[(o_orderkey // 8) % 7 + 1] AS to_state FROM orders, st)
SELECT id, from_state, to_state FROM m WHERE from_state IS NOT NULL AND from_state <> to_state AND NOT EXISTS (SELECT 1 FROM edge WHERE f = from_state AND list_contains(t, to_state))""")
def state_violations(spark, sf):
    states, key = F.array(*map(F.lit, _STATES)), F.col("o_orderkey")
    start, to = F.when(key % 8 < 7, F.get(states, (key % 8).cast("int"))), F.get(states, (F.floor(key / 8) % 7).cast("int"))
    return publish.illegal_moves(P.read(spark, sf, "orders").select(key.alias("id"), start.alias("from_state"), to.alias("to_state")))


@query(O.behind(O.EVIDENCE, "SELECT owner_id, evidence_id, conflicts_with FROM evidence e WHERE conflicts_with IS NOT NULL AND NOT EXISTS (SELECT 1 FROM evidence x WHERE x.owner_id = e.owner_id AND x.evidence_id = e.conflicts_with)"))
def invariant_reference(spark, sf):
    e = P.evidence(spark, sf)
    known = e.select(F.col("owner_id").alias("_o"), F.col("evidence_id").alias("_e"))
    return e.where("conflicts_with is not null").select("owner_id", "evidence_id", "conflicts_with").join(known, (F.col("owner_id") == F.col("_o")) & (F.col("conflicts_with") == F.col("_e")), "left_anti")


@query("SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)")
def invariant_time_order(spark, sf):
    line, order = P.read(spark, sf, "lineitem"), P.read(spark, sf, "orders")
    days = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("long")
    return line.join(order, line.l_orderkey == order.o_orderkey).select("l_orderkey", "l_linenumber", days.alias("days")).where("days < 0")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_topn(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)



