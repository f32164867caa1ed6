"""Entity resolution: duplicates by domain and by name, under domain and country constraints."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadspark.cluster import cut, ship


def connected(edges: DataFrame) -> DataFrame:
    """node, root: of each node of the edges (a, b) the least node it is connected with. Labels go to neighbours and then to
    their own label's label, until none changes; each round is checkpointed, and only a count comes to the driver."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root"))
    while True:
        labels = cut(labels)
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("next"))
        far = labels.select(F.col("node").alias("_far"), F.col("root").alias("far"))
        jumped = cut(moved.join(far, F.col("next") == F.col("_far"), "left").select("node", "was", F.least("next", "far").alias("root")))
        labels = jumped.select("node", "root")
        if jumped.where("root <> was").isEmpty():
            return labels


def domain_components(records: DataFrame) -> DataFrame:
    """record_id, component: the smallest record of the same canonical domain, else the record itself.

    With a column subdomain, tenants of one host stay apart: two records under different non-empty subdomains meet only
    if one's name holds the other's. A record without subdomain or name meets all of its domain. Names that hold names are
    found by joining the parts of each name with the domain's names, so no pair of records is made."""
    if "subdomain" not in records.columns:
        least = records.where("domain is not null").groupBy(F.col("domain").alias("_domain")).agg(F.min("record_id").alias("_least"))
        return records.join(least, F.col("domain") == F.col("_domain"), "left").select("record_id", F.coalesce("_least", "record_id").alias("component"))
    r = records.select("record_id", "domain", F.nullif("subdomain", F.lit("")).alias("sub"), F.nullif("name_key", F.lit("")).alias("name"))
    hosts = r.where("domain is not null").groupBy("domain").agg(F.min("record_id").alias("least"), (F.count_if(F.col("sub").isNull() | F.col("name").isNull()) == 0).alias("closed"), F.min("sub").alias("s1"), F.max("sub").alias("s2"))
    hosts = hosts.select(F.col("domain").alias("_domain"), "least", (F.col("closed") & (F.col("s1") != F.col("s2"))).alias("shared"))
    r = r.join(hosts, F.col("domain") == F.col("_domain"), "left")
    node = lambda kind, c: F.to_json(F.struct("domain", F.lit(kind).alias("kind"), F.col(c).alias("value")))
    t = cut(r.where("shared").select("record_id", "domain", "sub", "name"))
    held = t.select("domain", "name").distinct()
    length = F.char_length("name")
    part = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), length), lambda k: F.transform(F.sequence(k, length), lambda e: F.substring(F.col("name"), k, e - k + 1))))).alias("part")
    parts = held.select("domain", node("name", "name").alias("a"), part).distinct()
    inner = held.select(F.col("domain").alias("_d"), F.col("name").alias("_n"), node("name", "name").alias("b"))
    within = parts.join(inner, (F.col("domain") == F.col("_d")) & (F.col("part") == F.col("_n"))).where("a <> b").select("a", "b")
    roots = connected(t.select(node("sub", "sub").alias("a"), node("name", "name").alias("b")).union(within))
    tenants = t.withColumn("_node", node("sub", "sub")).join(roots, F.col("_node") == F.col("node"))
    least = tenants.groupBy("root").agg(F.min("record_id").alias("component"))
    tenants = tenants.join(least, "root").select("record_id", "component")
    rest = r.where("not coalesce(shared, false)").select("record_id", F.coalesce("least", "record_id").alias("component"))
    return rest.unionByName(tenants)


def survivors(records: DataFrame) -> DataFrame:
    """Of each component: the most evidenced claims, the most first-tier items, then the smallest id; and what merged."""
    order = F.struct((-F.col("claims")).alias("a"), (-F.col("tier1")).alias("b"), F.col("record_id").alias("c"))
    return records.groupBy("component").agg(F.min_by("record_id", order).alias("survivor"), F.count("*").alias("members"), F.max("claims").alias("claims"))


def evidence_union(evidence: DataFrame) -> DataFrame:
    """One item of each (component, source_url, claim): the newest reading, then the smallest id."""
    order = F.struct((-F.unix_date("observed_on")).alias("a"), F.col("evidence_id").alias("b"))
    return evidence.groupBy("component", "source_url", "claim").agg(F.min_by("evidence_id", order).alias("evidence_id"), F.max("observed_on").alias("observed_on"), F.count("*").alias("readings"))


def suggestions(records: DataFrame) -> DataFrame:
    """Names that agree in one country under several domains: for each (name, country) the domains and their smallest
    records, as a group and not as all pairs."""
    by_domain = records.where("name_key is not null and domain is not null").groupBy("name_key", "country", "domain").agg(F.min("record_id").alias("record_id"))
    g = by_domain.groupBy("name_key", "country").agg(F.array_sort(F.collect_list(F.struct("record_id", "domain"))).alias("m"))
    return g.where("size(m) > 1").select("name_key", "country", F.size("m").cast("long").alias("domains"), F.array_join(F.transform("m", lambda x: x["record_id"].cast("string")), ";").alias("records"))


def shared_hosts(records: DataFrame) -> DataFrame:
    """Domains under which records of different non-empty subdomains stand: merging them is refused. One row a
    (domain, subdomain), with the other subdomains' count."""
    s = records.where("domain is not null and subdomain <> ''").groupBy("domain", "subdomain").agg(F.min("record_id").alias("record_id"), F.count("*").alias("records"))
    n = s.withColumn("tenants", F.count("*").over(Window.partitionBy("domain")))
    return n.where("tenants > 1")


def _walk(nodes: pd.DataFrame) -> pd.DataFrame:
    """Of one block's nodes (component, name, country, domain, one, id): each component's root after walking its pairs."""
    nodes = nodes.astype(object).where(nodes.notna(), None).sort_values("id")
    parent = {c: c for c in nodes["component"]}
    domain, country = dict(zip(nodes["component"], nodes["domain"], strict=True)), dict(zip(nodes["component"], nodes["one"], strict=True))

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    rows = list(nodes[["id", "component", "name", "country", "domain"]].itertuples(index=False))
    named: dict[str, tuple[list, list]] = {}
    for r in rows:
        everyone, free = named.setdefault(r.name, ([], []))
        everyone.append(r)
        if r.domain is None:
            free.append(r)
    for r in rows:
        for x in named[r.name][r.domain is not None]:
            if x.id <= r.id or (r.country and x.country and r.country != x.country):
                continue
            a, b = find(r.component), find(x.component)
            if a == b or (domain[a] and domain[b] and domain[a] != domain[b]) or (country[a] and country[b] and country[a] != country[b]):
                continue
            a, b = min(a, b), max(a, b)
            parent[b], domain[a], country[a] = a, domain[a] or domain[b], country[a] or country[b]
    return pd.DataFrame({"component": list(parent), "root": [find(c) for c in parent]})


def constrained_groups(records: DataFrame) -> DataFrame:
    """record_id, component under constraints: a domain joins its records (see domain_components); then equal names join
    records of which one has no domain, unless two known countries differ, and never so that two domains or two
    countries come together. Pairs are walked in order of ids, whatever the order of the rows.

    Records that fare alike are one node: those without domain by (name, country), those of a component by (name,
    country). Only names with a record that has no domain are walked, and of the components of one such name and one country
    only as many as the name has nodes without domain, since each takes one at most. Names that share a component are one
    block, and one task walks one block. An empty name, country or domain counts as none."""
    blank = lambda c: F.nullif(F.col(c), F.lit("")).alias(c)
    r = records.select("record_id", blank("name_key"), blank("domain"), blank("country"), *[c for c in ("subdomain",) if c in records.columns])
    base = cut(domain_components(r).withColumnRenamed("record_id", "_id").join(r, F.col("_id") == F.col("record_id")).drop("_id"))
    heads = base.where("domain is not null").groupBy(F.col("component").alias("_c")).agg(F.min("country").alias("one"), F.max("country").alias("two"))
    owned = base.where("domain is not null and name_key is not null").groupBy("component", "name_key", "country").agg(F.min("domain").alias("domain"), F.min("record_id").alias("id"))
    owned = owned.join(heads, F.col("component") == F.col("_c")).where("one <=> two").drop("_c", "two")
    free = cut(base.where("domain is null and name_key is not null").groupBy("name_key", "country").agg(F.min("record_id").alias("id")))
    sizes = free.groupBy("name_key").agg(F.count("*").alias("takers"))
    owned = cut(owned.join(sizes, "name_key"))
    several = owned.groupBy("component").agg(F.min("name_key").alias("a"), F.max("name_key").alias("b"), F.collect_set("name_key").alias("names")).where("a <> b")
    order = Window.partitionBy("name_key", "country", "one").orderBy("id")
    alone = owned.join(several, "component", "left_anti").withColumn("_k", F.row_number().over(order)).where("_k <= takers").drop("_k")
    linked = owned.join(several, "component", "left_semi")
    blocks = connected(several.select("a", F.explode("names").alias("b"))).select(F.col("node").alias("_n"), F.col("root").alias("block"))
    nodes = alone.unionByName(linked).drop("takers").unionByName(free.select("id", F.col("id").alias("component"), "name_key", "country", F.lit(None).cast("string").alias("domain"), F.col("country").alias("one")))
    nodes = nodes.join(blocks, F.col("name_key") == F.col("_n"), "left").select(F.coalesce("block", "name_key").alias("block"), "component", F.col("name_key").alias("name"), "country", "domain", "one", "id")
    ship(records.sparkSession)
    roots = nodes.groupBy("block").applyInPandas(_walk, "component long, root long")
    # a record without domain follows the node of its name and country
    mine = free.select(F.col("name_key").alias("_name"), F.col("country").alias("_country"), F.col("id").alias("_node"))
    follows = F.col("domain").isNull() & (F.col("name_key") == F.col("_name")) & F.col("country").eqNullSafe(F.col("_country"))
    base = base.join(mine, follows, "left").select("record_id", F.coalesce("_node", "component").alias("component"))
    return base.join(roots, "component", "left").select("record_id", F.coalesce("root", "component").alias("component"))
