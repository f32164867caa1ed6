"""Queries of vocabularies, of merged records and of violations, each with the DuckDB SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadspark.functions import vocabulary as V
from leadspark.operators import calibrate, merge, publish, violations
from leadspark.plans.projections import read
from leadspark.plans.registry import query

# Vocabularies: parts and orders with raw spellings, by the key's remainder

#: Raw spellings of categories, countries, certificates and units.
TERMS = ("Sun Cream", "Sunscreen SPF50+", "선크림", "클렌징 폼", "toner pad", "serums", "K-Beauty", "packaging materials", "sun_stick_spf50_pa4", "Hair Care", "puff sponge", "LED mask", " ", "moisturiser", "립스틱", "Perfume", "collagen-drink")
#: Raw names of countries, each with its code as the rules give it (no code: none).
PLACES = (("United Kingdom", "GB"), ("UK", "GB"), ("영국", "GB"), ("Republic of Korea", "KR"), ("대한민국", "KR"), ("The Netherlands", "NL"), ("Côte d'Ivoire", "CI"), ("Viet Nam", "VN"), ("unknown", "unknown"), ("Atlantis", None), ("Georgia", None), ("EU", None), ("ae", "AE"), ("USA", "US"), ("America", None), ("조지아", "GE"), ("XX", None))
MARKS = ("iso 22716", "GMP", "c-GMP", "Halal", "leaping bunny", "My own / mark", "NMPA", "FDA registered", "기능성 화장품")
AMOUNTS = ("PCS.", "k g s", "개", "boxes", "unknown", "Litre", "e.a.", "세트")
AREAS = ("SEA", "asia", "EUROPE", "MENA", "nowhere", "cis")


def _text(word) -> str:
    return "NULL" if word is None else "'" + str(word).replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def _table(name: str, rows, columns: str) -> str:
    return f"{name} AS (SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_text, r)) + ')' for r in rows)}) AS t({columns}))"


_CATEGORY = f"""WITH {_table("tree", V.PARENTS.items(), "child, root")}, {_table("spelled", V.CATEGORY_SPELLINGS.items(), "spelling, slug")},
known AS (SELECT child AS word, child AS slug FROM tree UNION SELECT root, root FROM tree UNION ALL SELECT spelling, slug FROM spelled UNION ALL SELECT unnest({_list(V.MARKERS)}), ''),
raw AS (SELECT p_partkey AS part_id, {_list(TERMS)}[p_partkey % {len(TERMS)} + 1] AS raw, {_list(TERMS)}[(p_partkey * 3) % {len(TERMS)} + 1] AS other FROM part),
words AS (SELECT DISTINCT raw AS term, trim(regexp_replace(lower(raw), '[^0-9a-z가-힣]+', '_', 'g'), '_') AS s FROM raw),
tries AS (SELECT term, s, 1 AS k, s AS t FROM words UNION ALL SELECT term, s, 2, replace(s, '_', '') FROM words WHERE regexp_matches(s, '[가-힣]') UNION ALL SELECT term, s, 3, regexp_replace(s, '(_spf[0-9]*)?(_pa[0-9]*)?$', '') FROM words UNION ALL SELECT term, s, 4, left(s, length(s) - 1) FROM words WHERE s LIKE '%s' AND length(s) > 3),
cat AS (SELECT term, nullif(coalesce(arg_min(slug, k) FILTER (slug IS NOT NULL), any_value(s)), '') AS category FROM tries LEFT JOIN known ON word = t GROUP BY term)"""


def _raw(spark, sf):
    terms, k = F.array(*map(F.lit, TERMS)), F.col("p_partkey")
    n = len(TERMS)
    return read(spark, sf, "part").select(k.alias("part_id"), F.get(terms, (k % n).cast("int")).alias("raw"), F.get(terms, (k * 3 % n).cast("int")).alias("other"))


@query(_CATEGORY + "SELECT part_id, category, category IS NOT NULL AND category IN (SELECT child FROM tree UNION SELECT root FROM tree) AS known, coalesce((SELECT root FROM tree WHERE child = category), CASE WHEN category IN (SELECT root FROM tree) THEN category END) AS root FROM raw JOIN cat ON term = raw")
def category_normalise(spark, sf):
    return _raw(spark, sf).select("part_id", V.category(F.col("raw")).alias("category")).select("part_id", "category", V.is_known_category(F.col("category")).alias("known"), V.category_root(F.col("category")).alias("root"))


_NEXT = "(VALUES " + ", ".join(f"({_text(a)}, {_text(b)})" for g in V.NEIGHBOURS for a in g for b in g if a != b) + ") AS adj(x, y)"


@query(_CATEGORY + f""", pairs AS (SELECT part_id, a.category AS a, b.category AS b FROM raw JOIN cat a ON a.term = raw JOIN cat b ON b.term = other),
up AS (SELECT child AS c, root AS r FROM tree UNION SELECT root, root FROM tree)
SELECT part_id, CASE WHEN ra.r IS NULL OR rb.r IS NULL THEN 'none' WHEN a = b THEN 'exact' WHEN (ra.r = b AND a <> ra.r) OR (rb.r = a AND b <> rb.r) THEN 'parent' WHEN ra.r = rb.r OR EXISTS (SELECT 1 FROM {_NEXT} WHERE x = ra.r AND y = rb.r) THEN 'adjacent' ELSE 'none' END AS relation FROM pairs LEFT JOIN up ra ON ra.c = a LEFT JOIN up rb ON rb.c = b""")
def category_sets(spark, sf):
    return _raw(spark, sf).select("part_id", V.category_sets_relation(F.array("raw"), F.array("other")).alias("relation"))


@query(f"WITH {_table('places', PLACES, 'name, code')} SELECT c_custkey AS record_id, code AS country FROM customer JOIN places ON name = {_list([p for p, _ in PLACES])}[c_custkey % {len(PLACES)} + 1]")
def country_normalise(spark, sf):
    k = F.col("c_custkey")
    name = F.get(F.array(*[F.lit(p) for p, _ in PLACES]), (k % len(PLACES)).cast("int"))
    return read(spark, sf, "customer").select(k.alias("record_id"), V.country(spark, name).alias("country"))


@query(f"""WITH {_table("marks", V.CERTIFICATES.items(), "letters, token")}, {_table("units", V.UNITS.items(), "spelling, unit")},
raw AS (SELECT s_suppkey AS seller_id, upper({_list(MARKS)}[s_suppkey % {len(MARKS)} + 1]) AS mark, lower({_list(AMOUNTS)}[s_suppkey % {len(AMOUNTS)} + 1]) AS amount FROM supplier)
SELECT seller_id, coalesce(token, trim(regexp_replace(mark, '[^0-9A-Z가-힣]+', '_', 'g'), '_')) AS certificate, CASE WHEN amount = 'unknown' THEN 'units' ELSE coalesce(unit, regexp_replace(amount, '[ .]+', '', 'g')) END AS unit
FROM raw LEFT JOIN marks ON letters = regexp_replace(mark, '[^0-9A-Z가-힣]+', '', 'g') LEFT JOIN units ON spelling = regexp_replace(amount, '[ .]+', '', 'g')""")
def certificate_and_unit_normalise(spark, sf):
    k = F.col("s_suppkey")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    return read(spark, sf, "supplier").select(k.alias("seller_id"), V.certificate(pick(MARKS)).alias("certificate"), V.unit(pick(AMOUNTS)).alias("unit"))


_MEMBERS = [(r, c) for r, v in V.REGIONS.items() for c in v.split()] + [(w, c) for w, parts in V.WIDE_REGIONS.items() for r in parts for c in V.REGIONS[r].split()]


@query(f"WITH {_table('members', [(str(i), r) for i, r in enumerate(AREAS)], 'i, area')}, {_table('part_of', sorted(set(_MEMBERS)), 'region, code')} SELECT c_custkey AS record_id, EXISTS (SELECT 1 FROM part_of WHERE region = upper(area) AND code = {_list(['VN', 'KR', 'KZ', 'AE', 'US', 'EG', 'GE'])}[c_custkey % 7 + 1]) AS covered FROM customer JOIN members ON CAST(i AS INT) = c_custkey % {len(AREAS)}")
def region_covers(spark, sf):
    k = F.col("c_custkey")
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (k % len(words)).cast("int"))
    return read(spark, sf, "customer").select(k.alias("record_id"), V.region_covers(F.array(pick(AREAS)), pick(("VN", "KR", "KZ", "AE", "US", "EG", "GE"))).alias("covered"))


# Merged records: customers in components by a part of their key, the key's first holder being the survivor

_VALUES = """keys AS (SELECT c_custkey AS k FROM customer), v0 AS (
SELECT k // 8 AS component, k % 8 <> 0 AS absorbed, k AS record_id, 'country' AS field, CASE WHEN (k * 7) % 5 <> 0 THEN 'N' || ((k * 11) % 3) END AS value, CASE WHEN (k * 13) % 4 <> 0 THEN k END AS evidence_id, ((k * 17) % 4) / 4.0 AS confidence, CAST((k * 3) % 5 + 1 AS INT) AS tier, DATE '2024-01-01' + CAST((k * 5) % 3 AS INT) AS source_date, (k * 19) % 3 = 0 AS official FROM keys
UNION ALL SELECT k // 8, k % 8 <> 0, k, 'staff', CASE WHEN (k * 3) % 4 <> 0 THEN 'S' || ((k * 7) % 4) END, CASE WHEN (k * 5) % 3 <> 0 THEN k END, ((k * 23) % 3) / 4.0, CAST((k * 7) % 2 + 1 AS INT), CASE WHEN k % 2 = 0 THEN DATE '2024-01-05' END, false FROM keys),
v AS (SELECT component, field, value, row_number() OVER (PARTITION BY component, field ORDER BY absorbed, record_id) AS pos, record_id, CASE WHEN evidence_id IS NOT NULL THEN {'c': CAST(confidence AS DOUBLE), 't': -tier, 'd': coalesce(CAST(source_date AS VARCHAR), ''), 'i': -evidence_id, 'o': official} END AS b FROM v0)"""
_FOLD = f"""WITH RECURSIVE {_VALUES}, fold AS (
SELECT component, field, pos, record_id, value, CASE WHEN value IS NOT NULL THEN record_id END AS giver, b, CAST(NULL AS VARCHAR) AS won, CAST(NULL AS VARCHAR) AS lost, CAST(NULL AS VARCHAR) AS resolution FROM v WHERE pos = 1
UNION ALL SELECT component, field, pos, record_id, CASE WHEN takes THEN nv ELSE value END, CASE WHEN takes THEN record_id ELSE giver END, CASE WHEN b IS NULL THEN nb WHEN nb IS NULL THEN b WHEN nb > b THEN nb ELSE b END,
  CASE WHEN clash THEN CASE WHEN takes THEN nv ELSE value END END, CASE WHEN clash THEN CASE WHEN takes THEN value ELSE nv END END,
  CASE WHEN clash THEN CASE WHEN w IS NULL THEN 'manual' WHEN l IS NULL THEN 'higher_confidence' WHEN w.o AND NOT l.o THEN 'official_source' WHEN w.c <> l.c THEN 'higher_confidence' WHEN w.d <> l.d THEN 'more_recent' ELSE 'manual' END END
FROM (SELECT *, CASE WHEN takes THEN nb ELSE b END AS w, CASE WHEN takes THEN b ELSE nb END AS l FROM (SELECT f.component, f.field, n.pos, n.record_id, f.value, f.giver, f.b, n.value AS nv, n.b AS nb, coalesce(n.value <> f.value, false) AS clash,
  n.value IS NOT NULL AND (f.value IS NULL OR (n.b IS NOT NULL AND (f.b IS NULL OR n.b.c > f.b.c OR (n.b.c = f.b.c AND n.b.t > f.b.t)))) AS takes FROM fold f JOIN v n ON n.component = f.component AND n.field = f.field AND n.pos = f.pos + 1)))
"""


def _values(spark, sf):
    k = F.col("c_custkey")
    common = [F.floor(k / 8).cast("long").alias("component"), (k % 8 != 0).alias("absorbed"), k.alias("record_id")]
    day = lambda d: F.lit(d).cast("date")
    c = read(spark, sf, "customer")
    first = c.select(*common, F.lit("country").alias("field"), F.when(k * 7 % 5 != 0, F.concat(F.lit("N"), (k * 11 % 3).cast("string"))).alias("value"), F.when(k * 13 % 4 != 0, k).alias("evidence_id"), (k * 17 % 4 / 4).alias("confidence"), (k * 3 % 5 + 1).cast("int").alias("tier"), F.date_add(day("2024-01-01"), (k * 5 % 3).cast("int")).alias("source_date"), (k * 19 % 3 == 0).alias("official"))
    second = c.select(*common, F.lit("staff").alias("field"), F.when(k * 3 % 4 != 0, F.concat(F.lit("S"), (k * 7 % 4).cast("string"))).alias("value"), F.when(k * 5 % 3 != 0, k).alias("evidence_id"), (k * 23 % 3 / 4).alias("confidence"), (k * 7 % 2 + 1).cast("int").alias("tier"), F.when(k % 2 == 0, day("2024-01-05")).alias("source_date"), F.lit(False).alias("official"))
    return first.union(second)


@query(_FOLD + "SELECT component, field, arg_max(value, pos) AS value, arg_max(giver, pos) AS record_id FROM (SELECT component, field, pos, coalesce(value, '-') AS value, coalesce(giver, -1) AS giver FROM fold) GROUP BY 1, 2")
def merge_field_values(spark, sf):
    return merge.merge_fields(_values(spark, sf)).fillna("-", ["value"]).fillna(-1, ["record_id"]).select("component", "field", "value", "record_id")


@query(_FOLD + "SELECT component, field, record_id, won AS winning_value, lost AS losing_value, resolution FROM fold WHERE won IS NOT NULL")
def merge_field_conflicts(spark, sf):
    return merge.field_conflicts(_values(spark, sf))


_LISTS = "lists AS (SELECT c_custkey // 8 AS component, c_custkey % 8 <> 0 AS absorbed, c_custkey AS record_id, CASE WHEN c_custkey % 3 <> 0 THEN ['a', 'b', 'c', 'd', 'e'][1 + c_custkey % 4:c_custkey * 7 % 6] END AS items FROM customer)"


def _lists(spark, sf):
    k = F.col("c_custkey")
    size = F.greatest(F.lit(0), k * 7 % 6 - k % 4).cast("int")
    items = F.slice(F.array(*map(F.lit, "abcde")), (k % 4 + 1).cast("int"), size)
    return read(spark, sf, "customer").select(F.floor(k / 8).cast("long").alias("component"), (k % 8 != 0).alias("absorbed"), k.alias("record_id"), F.lit("brands").alias("field"), F.when(k % 3 != 0, items).alias("items"))


@query(f"WITH {_LISTS} SELECT component, CASE WHEN count(items) = 0 THEN NULL ELSE coalesce(array_to_string(list_sort(list_distinct(flatten(list(items) FILTER (items IS NOT NULL)))), ';'), '') END AS items FROM lists GROUP BY 1")
def merge_list_values(spark, sf):
    return merge.merge_lists(_lists(spark, sf)).select("component", F.array_join("items", ";").alias("items"))


@query(f"WITH {_LISTS}, o AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY absorbed, record_id) AS pos FROM lists WHERE items IS NOT NULL) SELECT component, record_id, CASE WHEN len(items) = 0 THEN 'absorbed' ELSE 'survivor' END AS loser FROM o WHERE pos > 1 AND (len(items) > 0) <> EXISTS (SELECT 1 FROM o p WHERE p.component = o.component AND p.pos < o.pos AND len(p.items) > 0)")
def merge_list_conflicts(spark, sf):
    return merge.list_conflicts(_lists(spark, sf)).select("component", "record_id", "loser")


_MERGED = """WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY absorbed, record_id) AS pos FROM (SELECT k // 8 AS component, k % 8 <> 0 AS absorbed, k AS record_id, CASE WHEN k % 5 <> 0 THEN 'd' || (k * 7 % 9) END AS domain, 'w' || k AS website, CASE WHEN k % 4 <> 0 THEN CAST(k * 3 % 5 AS INT) END AS depth,
CASE WHEN k % 3 <> 0 THEN (k // 8) % 2 = 0 OR k % 3 = 1 END AS stale, CASE WHEN k * 5 % 4 <> 0 THEN ['active', 'closed', 'moved'][k * 11 % 3 + 1] END AS status, CASE WHEN k % 7 <> 0 THEN '2024-01-0' || (k * 13 % 9 + 1) ELSE '' END AS seen, ['DISCOVERED', 'QUALIFIED', 'READY_FOR_REVIEW'][k // 8 % 3 + 1] AS state FROM (SELECT c_custkey AS k FROM customer))),
s AS (SELECT component, pos, status, seen FROM m WHERE pos = 1 UNION ALL SELECT n.component, n.pos, CASE WHEN n.status IS NOT NULL AND (s.status IS NULL OR (n.status <> s.status AND n.seen > s.seen)) THEN n.status ELSE s.status END, greatest(s.seen, n.seen) FROM s JOIN m n ON n.component = s.component AND n.pos = s.pos + 1)
SELECT component, arg_min(record_id, pos) AS survivor, count(*) - 1 AS absorbed, array_to_string(list_sort(list(DISTINCT domain) FILTER (domain IS DISTINCT FROM lead AND domain IS NOT NULL)), ';') AS alias_domains, arg_min(website, depth * 1000 + pos) AS website, CASE WHEN count(stale) > 0 THEN count(*) FILTER (stale) = count(*) END AS stale, any_value(last_status) AS operational_status,
CASE WHEN count(*) > 1 AND arg_min(state, pos) IN ('QUALIFIED', 'MATCH_CANDIDATE', 'READY_FOR_REVIEW') THEN 'VERIFIED' ELSE arg_min(state, pos) END AS state FROM (SELECT m.*, first_value(domain IGNORE NULLS) OVER (PARTITION BY component ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lead, (SELECT arg_max(coalesce(s.status, '-'), s.pos) FROM s WHERE s.component = m.component) AS last_status FROM m) GROUP BY component"""


@query(_MERGED)
def merge_whole_records(spark, sf):
    k = F.col("c_custkey")
    text = lambda p, n: F.concat(F.lit(p), n.cast("string"))
    pick = lambda words, at: F.get(F.array(*map(F.lit, words)), at.cast("int"))
    block = F.floor(k / 8).cast("long")
    r = read(spark, sf, "customer").select(
        block.alias("component"), (k % 8 != 0).alias("absorbed"), k.alias("record_id"), F.when(k % 5 != 0, text("d", k * 7 % 9)).alias("domain"), text("w", k).alias("website"), F.when(k % 4 != 0, (k * 3 % 5).cast("int")).alias("depth"),
        F.when(k % 3 != 0, (block % 2 == 0) | (k % 3 == 1)).alias("stale"), F.when(k * 5 % 4 != 0, pick(("active", "closed", "moved"), k * 11 % 3)).alias("operational_status"), F.when(k % 7 != 0, text("2024-01-0", k * 13 % 9 + 1)).alias("seen"), pick(("DISCOVERED", "QUALIFIED", "READY_FOR_REVIEW"), block % 3).alias("state"),
    )
    m = merge.merge_records(r)
    others = F.when(F.size("alias_domains") > 0, F.array_join("alias_domains", ";"))
    return m.select("component", "survivor", F.size("merged_from").cast("long").alias("absorbed"), others.alias("alias_domains"), "website", "stale", F.coalesce("operational_status", F.lit("-")).alias("operational_status"), "state")


# Violations

_REPORT = """WITH report AS (SELECT l_orderkey AS rfq_id, l_linenumber * 10000000 + k AS position, l_suppkey AS seller_id, k, base, delta, applied, greatest(0, least(100, base + delta)) + CASE WHEN k % 19 = 0 THEN 1 ELSE 0 END AS score, CASE WHEN k % 9 = 0 THEN 'unknown' ELSE 's' || (l_suppkey % 40) END AS domain FROM
(SELECT *, l_partkey AS k, CAST(l_quantity * 2 AS INT) AS base, CAST(l_partkey % 13 AS INT) - 6 AS delta, l_partkey % 13 <> 6 AND l_partkey % 17 <> 0 AS applied FROM lineitem)), placed AS (SELECT *, lag(score) OVER w AS s, lag(domain) OVER w AS d FROM report WINDOW w AS (PARTITION BY rfq_id ORDER BY position, seller_id))
"""


@query(_REPORT + """SELECT rfq_id, position, seller_id, rule, what FROM (
SELECT *, 'INV-08' AS rule, 'delta beyond its bound' AS what FROM placed WHERE delta NOT BETWEEN -5 AND 5 UNION ALL SELECT *, 'INV-08', 'applied without rationale' FROM placed WHERE applied AND k % 11 = 0 UNION ALL SELECT *, 'INV-08', 'applied without evidence' FROM placed WHERE applied AND k % 31 = 0
UNION ALL SELECT *, 'INV-08', 'delta but not applied' FROM placed WHERE NOT applied AND delta <> 0 UNION ALL SELECT *, 'INV-05', 'score' FROM placed WHERE score <> greatest(0, least(100, base + delta)) UNION ALL SELECT *, 'INV-05', 'contributions' FROM placed WHERE k % 23 = 0
UNION ALL SELECT *, 'INV-20', 'fewer than two evidenced reasons' FROM placed WHERE k % 4 < 2 UNION ALL SELECT *, 'INV-06', 'passed with failed rules' FROM placed WHERE k % 29 = 0 UNION ALL SELECT *, 'INV-07', 'failed and skipped' FROM placed WHERE k % 29 = 0 AND k % 5 = 0
UNION ALL SELECT *, 'INV-07', 'skipped without penalty' FROM placed WHERE (k % 5 = 0 AND k % 3 = 0) OR (k % 7 = 0 AND k % 2 <> 0) UNION ALL SELECT *, 'INV-03', 'penalty not in missing' FROM placed WHERE k % 37 = 0
UNION ALL SELECT *, 'INV-30', 'order' FROM placed WHERE s < score OR (s = score AND (d = 'unknown' AND domain <> 'unknown' OR (d <> 'unknown' AND domain <> 'unknown' AND d > domain))))""")
def match_result_violations(spark, sf):
    k = F.col("l_partkey")
    r = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", (F.col("l_quantity") * 2).cast("int").alias("base"), ((k % 13).cast("int") - 6).alias("delta"), ((k % 13 != 6) & (k % 17 != 0)).alias("applied"))
    words = lambda *pairs: F.array_compact(F.array(*[F.when(cond, F.lit(w)) for w, cond in pairs]))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.col("base") + F.col("delta"))) + F.when(k % 19 == 0, 1).otherwise(0)
    rows = r.select(
        F.col("l_orderkey").alias("rfq_id"), (F.col("l_linenumber") * 10000000 + k).alias("position"), F.col("l_suppkey").alias("seller_id"), "base", "delta", "applied", score.alias("score"), F.when(k % 9 == 0, "unknown").otherwise(F.concat(F.lit("s"), (F.col("l_suppkey") % 40).cast("string"))).alias("domain"),
        (F.col("base") + F.when(k % 23 == 0, 1).otherwise(0)).alias("contributions"), (k % 4).cast("int").alias("evidenced"), F.when(k % 11 != 0, "because").alias("rationale"), (k % 31).cast("int").alias("cites"), F.lit(True).alias("passed"),
        words(("HF-03", k % 29 == 0)).alias("failed"), words(("HF-03", k % 5 == 0), ("HF-05", k % 7 == 0)).alias("skipped"), words(("S-OP1", (k % 5 == 0) & (k % 3 != 0)), ("HF-05", (k % 7 == 0) & (k % 2 == 0))).alias("penalties"), words(("lead time", k % 37 == 0)).alias("labels"), words(("price", k % 2 == 0)).alias("missing"),
    )
    return violations.match_violations(rows)


@query("""WITH s AS (SELECT o_orderkey AS rfq_id, o_orderkey % 9 AS considered, o_orderkey % 7 AS passed, o_orderkey % 5 AS returned, o_orderkey % 4 AS excluded_count, o_orderkey % 3 AS excluded, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 6 = 1 END AS no_match, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'none fits' END AS reason FROM orders)
SELECT rfq_id, 'INV-30' AS rule, 'considered, passed, returned' AS what FROM s WHERE NOT (considered >= passed AND passed >= returned) UNION ALL SELECT rfq_id, 'INV-32', 'excluded_count below rows' FROM s WHERE excluded_count < excluded UNION ALL SELECT rfq_id, 'INV-32', 'excluded_count' FROM s WHERE excluded_count <> considered - passed
UNION ALL SELECT rfq_id, 'INV-21', 'empty but not said so' FROM s WHERE returned = 0 AND no_match IS NOT TRUE UNION ALL SELECT rfq_id, 'INV-21', 'no match with results' FROM s WHERE no_match AND returned > 0 UNION ALL SELECT rfq_id, 'INV-21', 'no reason' FROM s WHERE no_match AND trim(reason) = ''""")
def match_summary_violations(spark, sf):
    k = F.col("o_orderkey")
    s = read(spark, sf, "orders").select(k.alias("rfq_id"), *[(k % n).alias(c) for c, n in (("considered", 9), ("passed", 7), ("returned", 5), ("excluded_count", 4), ("excluded", 3))], F.when(k % 6 != 0, k % 6 == 1).alias("no_match"), F.when(k % 2 == 0, " ").otherwise("none fits").alias("reason"))
    return violations.match_summaries(s)


_WORDS = ("fine", "N/A", "NA", " tbd ", "-", "none given", "nap", "KR")


@query(f"""WITH r AS (SELECT o_orderkey AS id, {_list(_WORDS)}[o_orderkey % 8 + 1] AS note, {_list(_WORDS)}[o_orderkey // 8 % 8 + 1] AS country, ['CONTACTED', 'QUALIFIED', 'MATCHED', 'CLOSED'][o_orderkey % 4 + 1] AS status, CAST(o_orderdate AS DATE) AS observed_on FROM orders)
SELECT id AS record_id, 'INV-02' AS rule, 'note' AS what FROM r WHERE lower(trim(note)) IN ('n/a', 'na', 'tbd', '-', 'none given') UNION ALL SELECT id, 'INV-02', 'country' FROM r WHERE lower(trim(country)) IN ('n/a', 'na', 'tbd', '-', 'none given') AND country <> 'NA'
UNION ALL SELECT id, 'INV-09', 'status' FROM r WHERE status IN ('CONTACTED', 'MATCHED') UNION ALL SELECT id, 'INV-09', 'outreach_status' FROM r WHERE id % 5 = 0 UNION ALL SELECT id, 'INV-09', 'auto_send' FROM r WHERE id % 7 = 0 UNION ALL SELECT id, 'INV-09', 'manual_approval_required' FROM r WHERE id % 3 = 1
UNION ALL SELECT id, 'INV-24', 'observed_on' FROM r WHERE observed_on > DATE '1996-01-01' UNION ALL SELECT id, 'INV-24', 'source_date' FROM r WHERE id % 11 = 0 UNION ALL SELECT id, 'INV-03', 'missing' FROM r WHERE id % 13 = 0""")
def record_violations(spark, sf):
    k, seen = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    words, states = F.array(*map(F.lit, _WORDS)), F.array(*map(F.lit, ("CONTACTED", "QUALIFIED", "MATCHED", "CLOSED")))
    r = read(spark, sf, "orders").select(
        k.alias("record_id"), F.get(words, (k % 8).cast("int")).alias("note"), F.get(words, (F.floor(k / 8) % 8).cast("int")).alias("country"), F.get(states, (k % 4).cast("int")).alias("status"), F.when(k % 5 == 0, "SENT").otherwise("READY_FOR_REVIEW").alias("outreach_status"), (k % 7 == 0).alias("auto_send"),
        F.when(k % 3 != 0, k % 3 == 2).alias("manual_approval_required"), F.array(F.lit("moq")).alias("penalties"), F.when(k % 13 == 0, F.array(F.lit("price"))).otherwise(F.array(F.lit("moq"), F.lit("price"))).alias("missing"), F.lit("1996-01-01").cast("date").alias("as_of"), seen.alias("observed_on"), F.date_add(seen, F.when(k % 11 == 0, 1).otherwise(-1)).alias("source_date"),
    )
    return violations.record_violations(r, ["note"], ["country"])


@query("""WITH c AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN '=1+1' WHEN 1 THEN 'say "hi"' WHEN 2 THEN 'mail a.b@c.org' WHEN 3 THEN 'plain' END AS name, CASE c_custkey % 3 WHEN 0 THEN 'call +82 2 1234 5678' WHEN 1 THEN 'two' || chr(10) || 'lines' END AS phone FROM customer)
SELECT id AS record_id, 'formula' AS rule, 'name' AS what FROM c WHERE regexp_matches(name, '^[=+@-]') UNION ALL SELECT id, 'unreadable', 'name' FROM c WHERE contains(name, '"') UNION ALL SELECT id, 'unreadable', 'phone' FROM c WHERE contains(phone, chr(10)) UNION ALL SELECT id, 'personal', 'name' FROM c WHERE contains(name, '@')""")
def export_violations(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 5 == 0, "=1+1").when(k % 5 == 1, 'say "hi"').when(k % 5 == 2, "mail a.b@c.org").when(k % 5 == 3, "plain")
    phone = F.when(k % 3 == 0, "call +82 2 1234 5678").when(k % 3 == 1, "two\nlines")
    return violations.unsafe_cells(read(spark, sf, "customer").select(k.alias("record_id"), name.alias("name"), phone.alias("phone")), "record_id", ["name", "phone"], ("phone",))


# Runs


@query("""WITH b AS (SELECT c_custkey AS id, map {'fit': c_custkey % 5, 'reach': c_custkey % 3} AS d, ['moq', 'price'][1:c_custkey % 3] AS m FROM customer), a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN map {'fit': c_custkey % 5} ELSE map {'fit': c_custkey % 7, 'export': c_custkey % 2} END AS d FROM customer)
SELECT id, dimension, CAST(before AS INT) AS before, CAST(after AS INT) AS after, CAST(after - before AS INT) AS delta FROM (SELECT b.id, dimension, b.d[dimension] AS before, a.d[dimension] AS after FROM b JOIN a ON a.id = b.id, (VALUES ('fit'), ('reach'), ('export')) AS n(dimension)) WHERE before IS DISTINCT FROM after""")
def run_diff_dimensions(spark, sf):
    k = F.col("c_custkey").cast("int")
    m = lambda *pairs: F.create_map(*[x for n, v in pairs for x in (F.lit(n), v)])
    after = F.when(k % 4 == 0, m(("fit", k % 5))).otherwise(m(("fit", k % 7), ("export", k % 2)))
    return calibrate.dimension_changes(read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), m(("fit", k % 5), ("reach", k % 3)).alias("dims_before"), after.alias("dims_after")))


@query("""WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 <> 0 THEN ['moq', 'price', 'lead'][1:c_custkey % 4] END AS b, ['lead', 'price', 'moq'][1:c_custkey % 3] AS a FROM customer)
SELECT id, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ';') AS added, array_to_string(list_filter(b, lambda x: NOT list_contains(a, x)), ';') AS removed FROM r WHERE b IS NOT NULL AND (len(list_filter(a, lambda x: NOT list_contains(b, x))) > 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) > 0)""")
def run_diff_missing(spark, sf):
    k = F.col("c_custkey").cast("int")
    cut = lambda words, n: F.slice(F.array(*map(F.lit, words)), F.lit(1), n)
    r = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(k % 6 != 0, cut(("moq", "price", "lead"), k % 4)).alias("missing_before"), cut(("lead", "price", "moq"), k % 3).alias("missing_after"))
    return calibrate.missing_changes(r).select("id", F.array_join("added", ";").alias("added"), F.array_join("removed", ";").alias("removed"))


@query("""WITH b AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 3), a AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 1), same AS (SELECT id AS before_id, id, 'id' AS matched_by FROM b JOIN a USING (id))
SELECT * FROM same UNION ALL SELECT id - 2, id, 'merged_from' FROM a WHERE id % 4 = 3""")
def run_pairs(spark, sf):
    k = F.col("c_custkey")
    c = read(spark, sf, "customer").select(k.alias("id"), F.when(k % 4 == 3, F.array(k - 3, k - 2)).alias("merged_from"))
    return calibrate.pair_runs(c.where("id % 4 <> 3").withColumn("merged_from", F.lit(None).cast("array<bigint>")), c.where("id % 4 <> 1"))


# Quotes: sentences of each conversation's first message, looked for in all of its messages


@query("""WITH folded AS (SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM conversations), quotes AS (SELECT DISTINCT conv_id, unnest(string_split(t, '. ')) AS quote FROM folded f WHERE turn = (SELECT min(turn) FROM conversations c WHERE c.conv_id = f.conv_id))
SELECT q.conv_id, turn, count(*) AS held FROM quotes q JOIN folded f ON f.conv_id = q.conv_id AND contains(t, quote) WHERE quote <> '' AND regexp_matches(t, CASE WHEN regexp_matches(quote, '^[0-9a-z]') THEN '(^|[^0-9a-z])' ELSE '' END || regexp_escape(quote) || CASE WHEN regexp_matches(quote, '[0-9a-z]$') THEN '([^0-9a-z]|$)' ELSE '' END) GROUP BY 1, 2""")
def quote_containment(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", publish.fold_text(F.col("text")).alias("t"))
    first = c.groupBy("conv_id").agg(F.min_by("t", "turn").alias("t"))
    quotes = first.select("conv_id", F.explode(F.split("t", r"\. ")).alias("quote")).distinct()
    return publish.held_quotes(quotes, c).groupBy("conv_id", "turn").agg(F.count("*").alias("held"))


# Sheets and amounts


@query("""SELECT c_custkey AS record_id, CASE WHEN c_custkey % 5 = 0 THEN 'unknown' ELSE CASE WHEN c_custkey % 3 = 0 THEN '' ELSE printf('%s-', format('{:,}', c_custkey * 1000)) END || format('{:,}', c_custkey * 2000) || ' units' END AS quantity FROM customer""")
def quantity_texts(spark, sf):
    k = F.col("c_custkey")
    low, high = F.when(k % 5 != 0, F.when(k % 3 == 0, k * 2000).otherwise(k * 1000)), k * 2000
    return read(spark, sf, "customer").select(k.alias("record_id"), publish.quantity_text(low, high, F.lit("units")).alias("quantity"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS record_id, CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'none' WHEN 2 THEN 'a' ELSE 'a; b' END AS brands, CASE WHEN c_custkey % 7 = 0 THEN 'unknown' ELSE CAST(c_custkey % 10 AS VARCHAR) END AS dim_fit,
CASE WHEN c_custkey % 7 = 0 THEN 'unknown' WHEN c_custkey % 2 = 0 THEN 'not_applicable' ELSE '5' END AS dim_reach, 'none' AS missing, CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'v1' END AS score_version, '2024-02-15' AS as_of FROM customer""")
def export_sheet(spark, sf):
    k = F.col("c_custkey")
    fit = (k % 10).cast("int")
    scores = F.when(k % 7 != 0, F.when(k % 2 == 0, F.create_map(F.lit("fit"), fit)).otherwise(F.create_map(F.lit("fit"), fit, F.lit("reach"), F.lit(5))))
    r = read(spark, sf, "customer").select(
        k.alias("record_id"), F.when(k % 4 != 0, F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), (k % 4 - 1).cast("int"))).alias("brands"), scores.alias("dimension_scores"), F.array().cast("array<string>").alias("missing"),
        F.when(k % 2 == 0, " ").otherwise("v1").alias("score_version"), F.lit("2024-02-15").cast("date").alias("as_of"),
    )
    return publish.export_rows(r, ["record_id", "brands"], ["fit", "reach"], ("reach",))


@query(f"""WITH {_table("units", V.UNITS.items(), "spelling, unit")}, raw AS (SELECT c_custkey AS record_id, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 10 END AS amount, {_list(["pcs", "KRW", "jars of", None, " ", "kgs"])}[c_custkey % 6 + 1] AS u FROM customer),
c AS (SELECT record_id, amount, trim(coalesce(u, '')) <> '' AS named, coalesce(unit, replace(lower(u), ' ', '')) AS canon, unit IS NOT NULL OR regexp_matches(replace(lower(u), ' ', ''), '^[a-z]{{3}}$') AS known FROM raw LEFT JOIN units ON spelling = replace(lower(u), ' ', ''))
SELECT record_id, CASE WHEN named AND known THEN amount END AS value, CASE WHEN named AND known AND amount IS NOT NULL THEN canon END AS unit, CASE WHEN amount IS NOT NULL AND NOT named THEN 'unit_unstated' END AS question, amount IS NOT NULL AND named AND NOT known AS error FROM c""")
def stated_amounts(spark, sf):
    k = F.col("c_custkey")
    u = F.get(F.array(*map(F.lit, ("pcs", "KRW", "jars of", None, " ", "kgs"))), (k % 6).cast("int"))
    r = read(spark, sf, "customer").select(k.alias("record_id"), publish.stated_amount(F.when(k % 5 != 0, k * 10), u).alias("x"))
    return r.select("record_id", "x.*")
