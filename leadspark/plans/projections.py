"""The driver's tables as parties, offers, requests, evidence and reviews: plain selects, each mirrored in oracle.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-15"
MATERIAL = ["click", "error", "purchase", "signup", "view"]
PARENTS = {"SMALL": "STANDARD", "MEDIUM": "STANDARD", "LARGE": "STANDARD"}
ADJACENT = {"ECONOMY": "price", "PROMO": "price"}
TYPES = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = read(spark, sf, "events").where("user_id is not null").select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("evidence_id"), F.col("event_type").alias("claim"), F.col("ts").cast("date").alias("day"), k.alias("k"))
    return e.select(
        "owner_id", "evidence_id", "claim",
        (F.col("k") % 5 + 1).alias("source_tier"), F.when(F.col("k") % 11 != 0, F.date_sub("day", F.col("k") * 10)).alias("source_date"), F.col("day").alias("observed_on"),
        F.concat(F.lit("site"), (F.col("k") % 7).cast("string")).alias("domain"), (F.col("k") % 5 == 0).alias("is_official"), (F.col("k") % 13 == 0).alias("inferred"),
        (F.col("k") % 17 == 0).alias("stale"), F.when(F.col("k") % 19 == 0, F.col("evidence_id") + F.col("k")).alias("conflicts_with"),
    )


def owners(spark: SparkSession, sf: str) -> DataFrame:
    """Records behind the evidence: every user, and some customers, of whom most have no item."""
    ids = read(spark, sf, "events").where("user_id is not null").select(F.col("user_id").alias("owner_id")).union(read(spark, sf, "customer").where("c_custkey % 50 = 0").select("c_custkey")).distinct()
    k = F.col("owner_id")
    return ids.select("owner_id", (k % 7 == 0).alias("stale"), F.when(k % 5 == 0, F.array(F.lit("click"))).otherwise(F.array().cast("array<string>")).alias("resolved"), (k % 4).cast("int").alias("unknown_claims"))


def sellers(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = read(spark, sf, "supplier"), read(spark, sf, "nation"), read(spark, sf, "region")
    place = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    s = s.join(F.broadcast(place), s.s_nationkey == place.n_nationkey, "left")  # 25 rows
    key, money = F.col("s_suppkey"), F.col("s_acctbal")
    pick = lambda values, m: F.element_at(F.array(*map(F.lit, values)), (key % m + 1).cast("int"))
    certs = F.array_compact(F.array(F.when(key % 2 == 0, "ISO22716"), F.when(key % 3 == 0, "CGMP"), F.when(key % 5 == 0, "HALAL")))
    return s.select(
        key.alias("seller_id"), F.concat(F.lit("s"), (key % 40).cast("string"), F.lit(".example")).alias("seller_domain"), F.col("n_name").alias("seller_country"), F.col("r_name").alias("seller_region"),
        F.when(key % 7 != 0, pick(TYPES, 6)).alias("category"), F.when(~money.between(0, 1000), money >= 3000).alias("oem_odm"), F.when(money < 9000, money < 8000).alias("private_label"), (money >= 0).alias("brand_export"),
        F.when(key % 11 != 0, certs).alias("certs"), F.when(key % 4 != 3, key % 4 < 2).alias("certs_verified"), F.array(F.concat(F.lit("NATION_"), (key % 25).cast("string"))).alias("excluded_markets"),
        F.when(key % 29 != 0, F.when(key % 23 == 1, "closed").when(key % 23 == 2, "unreachable").otherwise("active")).alias("operational_status"), F.when(key % 9 != 0, "units").otherwise("kg").alias("moq_unit"),
        pick(["oem_odm", "manufacturer", "brand", "distributor", "other", None], 6).alias("company_type"), F.when(key % 5 != 4, (key % 5).cast("int")).alias("english"),
    )


def offers(spark: SparkSession, sf: str) -> DataFrame:
    """One row a (part, seller) with its smallest quantity, longest delivery and total quantity."""
    line, order = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    j = line.join(order, line.l_orderkey == order.o_orderkey)
    days = F.max(F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")))
    g = j.groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").cast("int").alias("moq"), days.alias("days"), F.sum("l_quantity").cast("long").alias("capacity"))
    return g.select(F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("seller_id"), "moq", F.when(F.col("days") >= 0, F.col("days")).alias("lead_days"), "capacity")


def rfqs(spark: SparkSession, sf: str) -> DataFrame:
    """One row an order with lines: its smallest part's category, quantities, ceilings and destination."""
    line, order, part = read(spark, sf, "lineitem"), read(spark, sf, "orders"), read(spark, sf, "part")
    customer, nation, region = read(spark, sf, "customer"), read(spark, sf, "nation"), read(spark, sf, "region")
    lines = line.groupBy("l_orderkey").agg(F.min("l_partkey").alias("part_id"), F.sum("l_quantity").cast("long").alias("quantity"))
    place = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left")
    j = lines.join(order, lines.l_orderkey == order.o_orderkey).join(part, lines.part_id == part.p_partkey, "left").join(customer, order.o_custkey == customer.c_custkey, "left")
    j = j.join(F.broadcast(place), customer.c_nationkey == place.n_nationkey, "left")
    key, prio = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    model = F.when(prio == "1", "oem_odm").when(prio == "2", "private_label").when(prio == "3", "branded").otherwise("either")
    needed = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.array(F.lit("ISO22716"))).when(F.col("c_mktsegment") == "MACHINERY", F.array(F.lit("CGMP"), F.lit("HALAL"))).otherwise(F.array().cast("array<string>"))
    return j.select(
        key.alias("rfq_id"), "part_id", F.when(key % 10 != 0, F.col("p_type")).alias("wanted_category"), "quantity", model.alias("model"), F.when(key % 5 != 0, F.col("quantity")).alias("max_moq"), F.lit("units").alias("rfq_unit"),
        F.when(key % 3 != 0, (60 + key % 600).cast("int")).alias("max_lead"), F.when(key % 17 != 0, F.col("n_name")).alias("destination"), F.when(key % 17 != 0, F.col("r_name")).alias("destination_region"),
        needed.alias("required_certs"), F.array(F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string"))).alias("excluded_countries"), F.col("o_orderdate").cast("date").alias("as_of"), "o_orderstatus",
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Requests with the sellers that offer the same part: an equi-join, so candidates grow with the offers."""
    from leadspark.operators.evidence import quality
    from leadspark.operators.matching import category_relation, with_seller_points

    q = quality(evidence(spark, sf), MATERIAL, F.lit(AS_OF).cast("date"), owners(spark, sf)).select(F.col("owner_id").alias("_owner"), F.col("quality").alias("evidence_quality"))
    s = with_seller_points(sellers(spark, sf)).join(q, F.col("seller_id") == F.col("_owner"), "left").drop("_owner")
    j = rfqs(spark, sf).join(offers(spark, sf), "part_id").join(s, "seller_id")
    return j.withColumn("relation", category_relation(F.col("wanted_category"), F.col("category"), PARENTS, ADJACENT))


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Documents scored by length, with the verdicts of those that are labelled."""
    d = read(spark, sf, "documents")
    labels = read(spark, sf, "labels").groupBy(F.col("doc_id").alias("_doc")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    j = d.join(labels, d.doc_id == F.col("_doc"), "left")
    verdict = F.when(F.col("toxic") == 1, "unsure").when(F.col("quality") == 1, "accept").when(F.col("quality") == 0, "reject")
    score = F.least(F.lit(100), F.call_function("div", F.col("n_chars"), F.lit(40))).cast("int")
    return j.select(F.col("doc_id").alias("record_id"), "lang", "source", score.alias("score"), verdict.alias("verdict"))


def sites(spark: SparkSession, sf: str) -> DataFrame:
    from leadspark.functions import urls

    p = read(spark, sf, "pages")
    u = F.col("url")
    return p.select(F.col("page_id").alias("record_id"), "url", urls.canonical_domain(u).alias("domain"), urls.subdomain(u).alias("subdomain"), urls.path_depth(u).alias("depth"), urls.site_root(u).alias("root"))


def parties(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as company records: few names and domains, so that records meet."""
    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    key = F.col("c_custkey")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").select(
        key.alias("record_id"), F.concat(F.lit("company "), (key % 211).cast("string")).alias("name_key"), F.when(key % 3 != 0, F.concat(F.lit("d"), (key % 401).cast("string"), F.lit(".example"))).alias("domain"),
        F.when(key % 13 != 0, F.col("n_name")).alias("country"), F.call_function("mod", key, F.lit(6)).cast("int").alias("claims"), (key % 4).cast("int").alias("tier1"),
    )


def run(spark: SparkSession, sf: str, shift: int) -> DataFrame:
    """A scored run over customers; another shift is another run, over customers of another kind, so ids are gone and new."""
    key = F.col("c_custkey")
    score = ((key * 7 + shift * (key % 5)) % 101).cast("int")
    rules = F.array_compact(F.array(F.when(score < 40, "HF-01"), F.when((score + shift) % 3 == 0, "HF-03")))
    there = F.col("c_acctbal") >= 0 if shift == 1 else F.col("c_mktsegment") != "MACHINERY"
    return read(spark, sf, "customer").where(there).select(key.alias("id"), score.alias("score"), F.when(F.size(rules) == 0, "returned").otherwise("excluded").alias("state"), rules.alias("rules"), F.when(key % 8 != shift % 8, key % 8 < 4).alias("flag"))


def buyers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as buyers: each field has unknown, negative and positive values, by the key's remainders."""
    from leadspark.operators.evidence import quality

    c, n = read(spark, sf, "customer"), read(spark, sf, "nation")
    q = quality(evidence(spark, sf), MATERIAL, F.lit(AS_OF).cast("date"), owners(spark, sf)).select(F.col("owner_id").alias("_owner"), F.col("quality").alias("evidence_quality"))
    c = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left").join(q, c.c_custkey == F.col("_owner"), "left")  # 25 nations
    k = F.col("c_custkey")
    pick = lambda values, m: F.element_at(F.array(*map(F.lit, values)), (k % m + 1).cast("int"))
    some = lambda *pairs: F.array_compact(F.array(*[F.when(cond, F.lit(v)) for v, cond in pairs]))
    host = F.concat(F.lit("d"), (k % 4).cast("string"), F.lit(".example"))
    contact = lambda kind, value, cond: F.when(cond, F.struct(F.lit(kind).alias("type"), value.alias("value")))
    mail = F.concat(F.lit("info@"), host)
    contacts = F.array_compact(F.array(
        contact("partnership_form", F.concat(F.lit("https://"), host, F.lit("/partner/")), (k % 10 > 1) & (k % 7 == 2)), contact("corporate_email", mail, (k % 10 > 1) & (k % 3 == 0)),
        contact("corporate_email", F.concat(F.lit("mailto:"), F.upper(mail)), (k % 10 > 1) & (k % 6 == 0)), contact("phone", F.lit("+1 (202) 555"), (k % 10 > 1) & (k % 4 != 0)), contact("fax", F.lit("n/a"), (k % 10 > 1) & (k % 5 == 3)),
    ))
    return c.select(
        k.alias("record_id"), "evidence_quality", F.col("n_name").alias("country"), pick(["distributor", "importer", "wholesaler", "marketplace", "brand", "retailer", "other", None], 8).alias("company_type"),
        F.when(k % 3 != 0, k % 3 == 1).alias("korean_signal"), F.when(k % 4 != 0, F.slice(F.array(*map(F.lit, "abcd")), 1, (k % 5).cast("int"))).alias("brands"),
        F.when(k % 7 != 0, F.split(pick(["", "skincare", "makeup,haircare", "supplements", "machinery", "", "sunscreen"], 7), ",")).alias("raw"), F.when(k % 5 != 0, k % 5 < 3).alias("wholesale"),
        (k % 11 == 0).alias("has_moq"), pick(["high", "medium", "low", None], 4).alias("intent"), F.when(k % 6 != 0, some(("rfq_posted", k % 2 == 0), ("open_call", k % 5 == 0), ("trade_show", k % 3 == 1))).alias("sourcing_signals"),
        F.when(k % 9 != 0, F.array(pick(["retail_store", "department_store", "ecommerce", "marketplace", "salon_spa", "distributor_network"], 6))).alias("channels"), F.when(k % 10 != 0, contacts).alias("contacts"),
        F.concat(F.lit("d"), (k % 3).cast("string"), F.lit(".example")).alias("canonical_domain"), F.array(F.lit("d3.example")).alias("alias_domains"), F.when(k % 6 > 1, k % 6 > 2).alias("partnership"), (k % 19 == 0).alias("stale"), (k % 23 == 0).alias("drift"),
        some(("kbeauty_specialist_positioning", k % 29 == 0), ("korean_category_page", k % 13 == 0), ("b2b_pricing_or_trade_account", k % 14 == 0), ("procurement_or_buying_page", k % 15 == 0), ("sourcing_closed_statement", k % 31 == 0)).alias("claims"),
        some(("korea_sourcing_statement", k % 12 == 0)).alias("official_claims"), F.when(k % 8 != 0, (k % 500).cast("int")).alias("sourcing_age"), (k % 16 == 0).alias("standing_page"),
    ).withColumn("categories", F.filter("raw", lambda x: x != "")).drop("raw")
