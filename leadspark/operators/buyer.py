"""Buyer scoring: fifteen criteria read off a record in place, priced by the rubric, summed into dimensions.

A record and what its evidence shows (claim_facts) stand in one row, so signals, criteria, adjustments, dimensions and
the total are expressions of that row: nothing is exploded, joined to prices or shuffled.

Null means unknown. A criterion on which nothing fires earns 30 percent if its inputs are unknown and nothing if they are
known; an empty list is known. An unknown signal name earns nothing. A criterion that the query does not ask for is left
out of its dimension; a dimension without criteria is left out of the total.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions.numeric import clamp, half_up_ratio
from leadspark.operators.scoring import UNKNOWN

#: Dimension, most points, how signals add up, and each signal's points, by criterion.
RUBRIC = {
    "B-KF1": ("kbeauty_korea_fit", 55, "max", {"brands_3_plus": 55, "brands_1_2": 48, "sourcing_statement": 45, "signal_true": 40, "signal_false": 0}),
    "B-KF2": ("kbeauty_korea_fit", 30, "max", {"specialist_positioning": 30, "korean_category_page": 22, "carriage_with_beauty": 20, "marketing_mention": 12}),
    "B-KF3": ("kbeauty_korea_fit", 15, "max", {"beauty": 15, "adjacent": 8}),
    "B-CR1": ("b2b_commercial_role", 60, "max", {"distributor": 60, "importer": 60, "wholesaler": 57, "marketplace": 36, "brand": 27, "retailer": 24, "other": 15}),
    "B-CR2": ("b2b_commercial_role", 25, "max", {"published_minimum_order": 25, "wholesale_true": 25, "b2b_pricing": 20, "reseller_page": 18, "wholesale_false": 0}),
    "B-CR3": ("b2b_commercial_role", 15, "max", {"procurement_page": 15, "retail_supplier_page": 12, "distributor_network": 10}),
    "B-SI1": ("sourcing_intent", 45, "max", {"high": 45, "medium": 29, "low": 12}),
    "B-SI2": ("sourcing_intent", 45, "sum_capped", {"rfq_posted": 45, "open_call": 32, "new_brand_inquiry": 28, "active_post": 28, "brand_form": 23, "become_distributor": 19, "partnership_page": 15, "trade_terms": 15, "inquiry_form": 13, "trade_show": 10}),
    "B-SI3": ("sourcing_intent", 10, "max", {"within_90": 10, "within_365": 6, "standing_undated": 5, "older": 2}),
    "B-MR1": ("market_relevance", 55, "max", {"exact": 55, "region": 35, "adjacent": 20}),
    "B-MR2": ("market_relevance", 35, "max", {"exact": 35, "parent": 25, "adjacent": 15}),
    "B-MR3": ("market_relevance", 10, "max", {"match": 10, "partial": 6}),
    "B-RE1": ("reachability", 70, "max", {"partnership_form": 70, "wholesale_form": 68, "corporate_email": 65, "form": 55, "contact_page": 45, "messenger": 35, "linkedin": 30, "phone": 25, "other": 20}),
    "B-RE2": ("reachability", 15, "max", {"channels_3_plus": 15, "channels_2": 10, "channels_1": 5}),
    "B-RE3": ("reachability", 15, "max", {"own_domain": 15, "other_corporate": 10, "free_mail": 6}),
}
#: Points of what lowers or raises a dimension.
ADJUSTMENTS = {
    "kbeauty_korea_fit": {"non_beauty_business": -60, "signal_false": -25, "signal_unknown": -20},
    "b2b_commercial_role": {"retail_chain_procurement": 20, "retail_only": -25, "wholesale_false": -15},
    "sourcing_intent": {"closed_statement": -40, "partnership_false": -10},
    "market_relevance": {"country_mismatch": -40, "category_no_overlap": -20, "drift": -10},
    "reachability": {"stale_contact_page": -20, "verified_empty": -15},
}
#: The dimensions' weights; evidence quality is scored beside them.
WEIGHTS = {"kbeauty_korea_fit": 20, "b2b_commercial_role": 20, "sourcing_intent": 25, "market_relevance": 15, "reachability": 10, "evidence_quality": 10}
#: Channels that count as near each other.
NEAR_CHANNELS = [("retail_store", "department_store"), ("ecommerce", "marketplace"), ("pharmacy", "salon_spa")]


@dataclass(frozen=True)
class Request:
    """What buyers are scored for, and the vocabulary they are read with; empty parts ask for nothing."""

    country: str | None = None
    region: list[str] = field(default_factory=list)
    adjacent: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    channels: list[str] = field(default_factory=list)
    core: list[str] = field(default_factory=list)
    near: list[str] = field(default_factory=list)
    parents: dict[str, str] = field(default_factory=dict)
    related: list[tuple[str, str]] = field(default_factory=list)
    free_mail: list[str] = field(default_factory=list)
    chains: list[str] = field(default_factory=list)

    def asks(self, criterion: str) -> bool:
        wanted = {"B-MR1": self.country or self.region or self.adjacent, "B-MR2": self.categories, "B-MR3": self.channels}
        return bool(wanted.get(criterion, True))


def claim_facts(evidence: DataFrame, sourcing: list[str], as_of: Column) -> DataFrame:
    """owner_id; claims and official_claims, which are as few as the vocabulary; sourcing_age, days since the newest
    dated sourcing item; standing_page, whether an undated one was read by as_of. One aggregate, partial on the map side."""
    about = F.col("claim").isin(sourcing)
    read = about & F.col("source_date").isNull() & (F.col("observed_on") <= as_of)
    return evidence.groupBy("owner_id").agg(
        F.collect_set("claim").alias("claims"),
        F.collect_set(F.when(F.col("is_official"), F.col("claim"))).alias("official_claims"),
        F.greatest(F.datediff(as_of, F.max(F.when(about, F.col("source_date")))), F.lit(0)).alias("sourcing_age"),
        F.coalesce(F.bool_or(read), F.lit(False)).alias("standing_page"),
    )


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _meets(column: str, values: list[str]) -> Column:
    return _yes(F.arrays_overlap(column, _words(values)))


def _contact_key(x: Column) -> Column:
    """What makes a contact distinct: an address without mailto and case, a number's digits, else the folded text."""
    text = F.lower(F.trim(x["value"]))
    digits = F.regexp_replace(x["value"], "[^0-9]", "")
    key = F.when(x["type"] == "corporate_email", F.regexp_replace(text, "^mailto:", "")).when(x["type"] == "phone", digits)
    return F.nullif(key.otherwise(F.regexp_replace(text, "/+$", "")), F.lit(""))


def distinct_contacts(contacts: str) -> Column:
    """How many different contacts; one without a comparable value counts by itself."""
    pairs = F.transform(contacts, lambda x: F.struct(x["type"].alias("type"), _contact_key(x).alias("key")))
    keyed = F.filter(pairs, lambda p: p["key"].isNotNull())
    return F.size(F.array_distinct(keyed)) + F.size(pairs) - F.size(keyed)


def signals(q: Request) -> dict[str, tuple[dict[str, Column], Column]]:
    """For each criterion that the request asks for: when each signal fires, and whether its inputs are unknown."""
    c = F.col
    null = lambda name: c(name).isNull()
    claim = lambda name: _yes(F.array_contains("claims", name))
    korean, wholesale = c("korean_signal"), c("wholesale")
    statement = _yes(F.array_contains("official_claims", "korea_sourcing_statement"))
    positioned = {"specialist_positioning": claim("kbeauty_specialist_positioning"), "korean_category_page": claim("korean_category_page"), "marketing_mention": claim("korean_beauty_marketing_mention")}
    no_positioning = ~(positioned["specialist_positioning"] | positioned["korean_category_page"] | positioned["marketing_mention"] | claim("kbeauty_positioning"))
    core = _meets("categories", q.core)
    pages = {"b2b_pricing": claim("b2b_pricing_or_trade_account"), "reseller_page": claim("reseller_program_page")}
    parents = [p for s in q.categories if (p := q.parents.get(s))] + [s for s, p in q.parents.items() if p in q.categories]
    related = [b if a in q.categories else a for a, b in q.related if a in q.categories or b in q.categories]
    near = [b if a in q.channels else a for a, b in NEAR_CHANNELS if a in q.channels or b in q.channels]
    kinds = RUBRIC["B-RE1"][3]
    types = F.transform("contacts", lambda x: F.when(x["type"].isin(list(kinds)), x["type"]).otherwise("other"))
    mails = F.filter(F.transform("contacts", lambda x: F.when(x["type"] == "corporate_email", F.lower(F.substring_index(x["value"], "@", -1)))), lambda d: d.isNotNull() & (d != ""))
    own = F.array_append(F.coalesce("alias_domains", _words([])), F.lower("canonical_domain"))
    foreign = F.array_except(mails, own)
    n = distinct_contacts("contacts")
    age = c("sourcing_age")
    brands = F.size("brands")
    found = {
        "B-KF1": ({"brands_3_plus": brands >= 3, "brands_1_2": brands.between(1, 2), "sourcing_statement": statement, "signal_true": korean, "signal_false": ~korean}, korean.isNull() & null("brands") & ~statement),
        "B-KF2": (positioned | {"carriage_with_beauty": korean & core}, no_positioning & null("categories") & korean.isNull()),
        "B-KF3": ({"beauty": core, "adjacent": ~core & _meets("categories", q.near)}, null("categories")),
        "B-CR1": ({t: c("company_type") == t for t in RUBRIC["B-CR1"][3]}, null("company_type")),
        "B-CR2": (pages | {"published_minimum_order": c("has_moq"), "wholesale_true": wholesale, "wholesale_false": ~wholesale}, wholesale.isNull() & ~pages["b2b_pricing"] & ~pages["reseller_page"] & ~_yes(c("has_moq"))),
        "B-CR3": ({"procurement_page": claim("procurement_or_buying_page"), "retail_supplier_page": claim("retail_chain_supplier_page"), "distributor_network": claim("distributor_network_operated") | _meets("channels", ["distributor_network"])}, null("sourcing_signals") & null("channels")),
        "B-SI1": ({t: c("intent") == t for t in RUBRIC["B-SI1"][3]}, null("intent")),
        "B-SI2": ({t: F.array_contains("sourcing_signals", t) for t in RUBRIC["B-SI2"][3]}, null("sourcing_signals")),
        "B-SI3": ({"within_90": age <= 90, "within_365": age.between(91, 365), "older": age > 365, "standing_undated": age.isNull() & _yes(c("standing_page"))}, age.isNull() & ~_yes(c("standing_page"))),
        "B-MR1": ({"exact": c("country") == F.lit(q.country), "region": c("country").isin(q.region), "adjacent": c("country").isin(q.adjacent)}, null("country")),
        "B-MR2": ({"exact": _meets("categories", q.categories), "parent": _meets("categories", parents), "adjacent": _meets("categories", related)}, null("categories")),
        "B-MR3": ({"match": _meets("channels", q.channels), "partial": _meets("channels", near)}, null("channels")),
        "B-RE1": ({t: F.array_contains(types, t) for t in kinds}, null("contacts")),
        "B-RE2": ({"channels_3_plus": n >= 3, "channels_2": n == 2, "channels_1": n == 1}, null("contacts")),
        "B-RE3": ({"own_domain": F.arrays_overlap(mails, own), "free_mail": F.arrays_overlap(foreign, _words(q.free_mail)), "other_corporate": F.size(F.array_except(foreign, _words(q.free_mail))) > 0}, null("contacts")),
    }
    return {k: v for k, v in found.items() if q.asks(k)}


def adjustments(q: Request, fired: dict[str, Column]) -> dict[str, dict[str, Column]]:
    """When each adjustment applies; fired: whether any signal of a criterion fired."""
    c = F.col
    some = F.size("categories") > 0
    retail, wholesale = _yes(c("company_type") == "retailer"), c("wholesale")
    known = lambda k: ~fired.get(k, F.lit(True))
    contacts = c("contacts")
    return {
        "kbeauty_korea_fit": {"non_beauty_business": some & ~_meets("categories", q.core + q.near), "signal_false": ~c("korean_signal"), "signal_unknown": c("korean_signal").isNull()},
        "b2b_commercial_role": {"retail_only": retail & ~wholesale, "retail_chain_procurement": retail & ~_yes(~wholesale) & _meets("channels", q.chains), "wholesale_false": ~wholesale},
        "sourcing_intent": {"closed_statement": F.array_contains("claims", "sourcing_closed_statement"), "partnership_false": ~c("partnership")},
        "market_relevance": {"country_mismatch": F.lit(bool(q.country)) & c("country").isNotNull() & known("B-MR1"), "category_no_overlap": F.lit(bool(q.categories)) & some & known("B-MR2"), "drift": c("drift")},
        "reachability": {"stale_contact_page": c("stale"), "verified_empty": contacts.isNotNull() & (F.size(contacts) == 0)},
    }


def score(buyers: DataFrame, q: Request) -> DataFrame:
    """record_id; criteria, an array of (criterion, earned, unknown); a column for each dimension, null if nothing of it
    applies; qualification_score. buyers has evidence_quality; where that is null, it counts as 0."""
    read = signals(q)
    points, unknown = {}, {}
    for k, (when, missing) in read.items():
        _, most, how, prices = RUBRIC[k]
        worth = [F.when(_yes(cond), F.lit(prices[s])) for s, cond in when.items()]
        points[k] = F.greatest(*worth) if how == "max" else F.when(F.coalesce(*worth).isNotNull(), F.least(F.lit(most), sum((F.coalesce(w, F.lit(0)) for w in worth), F.lit(0))))
        unknown[k] = missing
    df = buyers.select("*", *[p.alias(f"p_{k}") for k, p in points.items()], *[u.alias(f"u_{k}") for k, u in unknown.items()])
    fired = {k: F.col(f"p_{k}").isNotNull() for k in read}
    lost = {k: ~fired[k] & F.col(f"u_{k}") for k in read}
    earned = {k: F.coalesce(F.col(f"p_{k}"), F.when(lost[k], half_up_ratio(F.lit(RUBRIC[k][1] * UNKNOWN), F.lit(100))).otherwise(0)).cast("int") for k in read}
    moved = adjustments(q, fired)
    dims = {}
    for d, prices in ADJUSTMENTS.items():
        own = [k for k in read if RUBRIC[k][0] == d]
        most = sum(RUBRIC[k][1] for k in own)
        base = half_up_ratio(sum((earned[k] for k in own), F.lit(0)), F.lit(most), 100)
        change = sum((F.when(_yes(moved[d][a]), F.lit(p)).otherwise(0) for a, p in prices.items()), F.lit(0))
        dims[d] = (clamp(base + change, 0, 100) if own else F.lit(None)).cast("int")
    dims["evidence_quality"] = F.coalesce("evidence_quality", F.lit(0)).cast("int")
    criteria = F.array(*[F.struct(F.lit(k).alias("criterion"), earned[k].alias("earned"), lost[k].alias("unknown")) for k in read])
    df = df.select("record_id", criteria.alias("criteria"), *[v.alias(d) for d, v in dims.items()])
    have = [d for d in dims if d == "evidence_quality" or any(RUBRIC[k][0] == d for k in read)]
    total = half_up_ratio(sum((F.col(d) * WEIGHTS[d] for d in have), F.lit(0)), F.lit(sum(WEIGHTS[d] for d in have)))
    return df.withColumn("qualification_score", total.cast("int"))
