"""DuckDB mirrors of the projections, as common table expressions that the queries' SQL is put behind."""

EVIDENCE = """
e0 AS (SELECT user_id AS owner_id, event_id AS evidence_id, event_type AS claim, CAST(ts AS DATE) AS day, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events WHERE user_id IS NOT NULL),
evidence AS (SELECT owner_id, evidence_id, claim, k % 5 + 1 AS source_tier, CASE WHEN k % 11 <> 0 THEN day - k * 10 END AS source_date, day AS observed_on, 'site' || (k % 7) AS domain,
  k % 5 = 0 AS is_official, k % 13 = 0 AS inferred, k % 17 = 0 AS stale, CASE WHEN k % 19 = 0 THEN evidence_id + k END AS conflicts_with FROM e0),
strong AS (SELECT *, CASE WHEN age_days IS NULL THEN 'undated' WHEN age_days <= 90 THEN 'fresh' WHEN age_days <= 365 THEN 'current' WHEN age_days <= 730 THEN 'aging' ELSE 'stale' END AS bucket,
  (2 * list_value(100, 82, 64, 46, 20)[source_tier] * CASE WHEN age_days IS NULL THEN 92 WHEN age_days <= 90 THEN 100 WHEN age_days <= 365 THEN 92 WHEN age_days <= 730 THEN 80 ELSE 60 END + 100) // 200 AS strength
  FROM (SELECT *, greatest(date_diff('day', source_date, DATE '2024-02-15'), 0) AS age_days FROM evidence WHERE source_date IS NOT NULL UNION ALL BY NAME SELECT *, NULL AS age_days FROM evidence WHERE source_date IS NULL)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, claim ORDER BY strength DESC, source_tier, source_date DESC NULLS LAST, evidence_id) AS rn FROM strong) WHERE rn = 1),
owners AS (SELECT owner_id, owner_id % 7 = 0 AS stale, CASE WHEN owner_id % 5 = 0 THEN ['click'] ELSE [] END AS resolved, CAST(owner_id % 4 AS INT) AS unknown_claims FROM (SELECT user_id AS owner_id FROM events WHERE user_id IS NOT NULL UNION SELECT c_custkey FROM customer WHERE c_custkey % 50 = 0)),
pairs AS (SELECT DISTINCT owner_id, least(evidence_id, conflicts_with) AS first_id, greatest(evidence_id, conflicts_with) AS second_id FROM evidence JOIN owners USING (owner_id) WHERE conflicts_with IS NOT NULL AND NOT list_contains(resolved, claim)),
material AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS claim),
covered AS (SELECT owner_id, avg(b.strength::DOUBLE) AS strength, 100.0 * count(*) / 5 AS coverage, bool_and(coalesce(b.age_days > 730, false)) AS old, count(*) AS claims,
  bool_or(NOT EXISTS (SELECT 1 FROM evidence x WHERE x.owner_id = b.owner_id AND x.claim = b.claim AND NOT x.inferred)) AS inferred FROM best b SEMI JOIN material USING (claim) GROUP BY owner_id),
allitems AS (SELECT owner_id, count(DISTINCT domain) AS domains, bool_or(is_official AND source_tier = 1) AS official FROM evidence GROUP BY owner_id),
quality AS (SELECT owner_id, coalesce(claims, 0) AS claims, coalesce(conflicts, 0) AS conflicts, stale, unknown_claims, CAST(CASE WHEN domains IS NULL THEN 0 ELSE greatest(0, least(100, floor(round(
  0.5 * coalesce(strength, 0) + 0.35 * coalesce(coverage, 0) + 0.15 * least(100, 50 * (domains - 1)) + CASE WHEN official THEN 10 ELSE 0 END + least(15, 7 * (domains - 1)) - CASE WHEN stale OR coalesce(old, false) THEN 25 ELSE 0 END
  + greatest(-20, -10 * coalesce(conflicts, 0)) - CASE WHEN inferred THEN 8 ELSE 0 END, 9) + 0.5))) END AS INT) AS quality
  FROM owners LEFT JOIN allitems USING (owner_id) LEFT JOIN covered USING (owner_id) LEFT JOIN (SELECT owner_id, count(*) AS conflicts FROM pairs GROUP BY 1) USING (owner_id))"""

SELLERS = """
sellers AS (SELECT s_suppkey AS seller_id, 's' || (s_suppkey % 40) || '.example' AS seller_domain, n_name AS seller_country, r_name AS seller_region,
  CASE WHEN s_suppkey % 7 <> 0 THEN list_value('STANDARD', 'ECONOMY', 'MEDIUM', 'PROMO', 'LARGE', 'SMALL')[s_suppkey % 6 + 1] END AS category,
  CASE WHEN NOT s_acctbal BETWEEN 0 AND 1000 THEN s_acctbal >= 3000 END AS oem_odm, CASE WHEN s_acctbal < 9000 THEN s_acctbal < 8000 END AS private_label, s_acctbal >= 0 AS brand_export,
  CASE WHEN s_suppkey % 11 <> 0 THEN list_filter([CASE WHEN s_suppkey % 2 = 0 THEN 'ISO22716' END, CASE WHEN s_suppkey % 3 = 0 THEN 'CGMP' END, CASE WHEN s_suppkey % 5 = 0 THEN 'HALAL' END], lambda x: x IS NOT NULL) END AS certs,
  CASE WHEN s_suppkey % 4 <> 3 THEN s_suppkey % 4 < 2 END AS certs_verified, ['NATION_' || (s_suppkey % 25)] AS excluded_markets,
  CASE WHEN s_suppkey % 29 <> 0 THEN CASE WHEN s_suppkey % 23 = 1 THEN 'closed' WHEN s_suppkey % 23 = 2 THEN 'unreachable' ELSE 'active' END END AS operational_status, CASE WHEN s_suppkey % 9 <> 0 THEN 'units' ELSE 'kg' END AS moq_unit,
  list_value('oem_odm', 'manufacturer', 'brand', 'distributor', 'other', NULL)[s_suppkey % 6 + 1] AS company_type, CASE WHEN s_suppkey % 5 <> 4 THEN CAST(s_suppkey % 5 AS INT) END AS english
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

RFQS = """
rfqs AS (SELECT o_orderkey AS rfq_id, part_id, CASE WHEN o_orderkey % 10 <> 0 THEN p_type END AS wanted_category, quantity,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'oem_odm' WHEN '2' THEN 'private_label' WHEN '3' THEN 'branded' ELSE 'either' END AS model, CASE WHEN o_orderkey % 5 <> 0 THEN quantity END AS max_moq, 'units' AS rfq_unit,
  CASE WHEN o_orderkey % 3 <> 0 THEN CAST(60 + o_orderkey % 600 AS INT) END AS max_lead, CASE WHEN o_orderkey % 17 <> 0 THEN n_name END AS destination, CASE WHEN o_orderkey % 17 <> 0 THEN r_name END AS destination_region,
  CASE c_mktsegment WHEN 'HOUSEHOLD' THEN ['ISO22716'] WHEN 'MACHINERY' THEN ['CGMP', 'HALAL'] ELSE CAST([] AS VARCHAR[]) END AS required_certs, ['NATION_' || (o_custkey % 25)] AS excluded_countries, CAST(o_orderdate AS DATE) AS as_of, o_orderstatus
  FROM (SELECT l_orderkey, min(l_partkey) AS part_id, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1) JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON part_id = p_partkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

OFFERS = """
offers AS (SELECT part_id, seller_id, moq, CASE WHEN days >= 0 THEN days END AS lead_days, capacity FROM (SELECT l_partkey AS part_id, l_suppkey AS seller_id, CAST(min(l_quantity) AS INT) AS moq,
  max(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS days, CAST(sum(l_quantity) AS BIGINT) AS capacity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2))"""

CANDIDATES = f"""{EVIDENCE},{SELLERS},{RFQS},{OFFERS},
cand AS (SELECT *, CASE WHEN wanted_category IS NULL OR category IS NULL THEN NULL WHEN wanted_category = category THEN 'exact'
  WHEN (wanted_category IN ('SMALL', 'MEDIUM', 'LARGE') AND category = 'STANDARD') OR (category IN ('SMALL', 'MEDIUM', 'LARGE') AND wanted_category = 'STANDARD') THEN 'parent'
  WHEN wanted_category IN ('ECONOMY', 'PROMO') AND category IN ('ECONOMY', 'PROMO') THEN 'adjacent' ELSE 'none' END AS relation
  FROM rfqs JOIN offers USING (part_id) JOIN sellers USING (seller_id) LEFT JOIN (SELECT owner_id, quality AS evidence_quality FROM quality) ON owner_id = seller_id),
flagged AS (SELECT *, CASE model WHEN 'oem_odm' THEN oem_odm WHEN 'private_label' THEN private_label WHEN 'branded' THEN brand_export END AS has_model FROM cand),
rules AS (SELECT *,
  CASE WHEN wanted_category IS NULL THEN 'na' WHEN relation IS NULL THEN 'skip' WHEN relation IN ('exact', 'parent') THEN 'pass' ELSE 'fail' END AS hf1,
  CASE WHEN model = 'either' THEN 'na' WHEN has_model IS NULL THEN 'skip' WHEN has_model THEN 'pass' ELSE 'fail' END AS hf2,
  CASE WHEN max_moq IS NULL THEN 'na' WHEN moq_unit <> rfq_unit OR moq IS NULL THEN 'skip' WHEN moq <= max_moq THEN 'pass' ELSE 'fail' END AS hf3,
  CASE WHEN len(required_certs) = 0 OR NOT coalesce(certs_verified, false) THEN 'na' WHEN certs IS NULL THEN 'skip' WHEN list_has_all(certs, required_certs) THEN 'pass' ELSE 'fail' END AS hf4,
  CASE WHEN destination IS NULL THEN 'na' WHEN list_contains(excluded_markets, destination) THEN 'fail' ELSE 'pass' END AS hf5,
  CASE WHEN coalesce(operational_status, '') IN ('closed', 'unreachable') THEN 'fail' ELSE 'pass' END AS hf6,
  CASE WHEN max_lead IS NULL THEN 'na' WHEN lead_days IS NULL THEN 'skip' WHEN lead_days <= max_lead THEN 'pass' ELSE 'fail' END AS hf7,
  CASE WHEN len(excluded_countries) = 0 THEN 'na' WHEN seller_country IS NULL THEN 'skip' WHEN list_contains(excluded_countries, seller_country) THEN 'fail' ELSE 'pass' END AS hf8 FROM flagged),
failing AS (SELECT *, list_filter([CASE WHEN hf1 = 'fail' THEN 'HF-01' END, CASE WHEN hf2 = 'fail' THEN 'HF-02' END, CASE WHEN hf3 = 'fail' THEN 'HF-03' END, CASE WHEN hf4 = 'fail' THEN 'HF-04' END,
  CASE WHEN hf5 = 'fail' THEN 'HF-05' END, CASE WHEN hf6 = 'fail' THEN 'HF-06' END, CASE WHEN hf7 = 'fail' THEN 'HF-07' END, CASE WHEN hf8 = 'fail' THEN 'HF-08' END], lambda x: x IS NOT NULL) AS failed FROM rules),
parts AS (SELECT *, CASE relation WHEN 'exact' THEN 60 WHEN 'parent' THEN 42 WHEN 'adjacent' THEN 24 WHEN 'none' THEN 0 ELSE 18 END AS pf,
  oem_odm IS NULL AND private_label IS NULL AND brand_export IS NULL AS silent, list_contains([oem_odm, private_label, brand_export], true) AS some_model, moq_unit <> rfq_unit AS other_unit, len(required_certs) AS need, len(list_intersect(required_certs, certs)) AS have FROM failing),
points AS (SELECT *, CASE WHEN silent THEN 18 + 4 ELSE CASE WHEN model = 'either' AND some_model THEN 56 WHEN model = 'either' THEN 0 WHEN has_model THEN 60 WHEN has_model IS NULL AND some_model THEN 36 ELSE 0 END + coalesce(oem_odm, false)::INT * 5 + coalesce(private_label, false)::INT * 5 + coalesce(brand_export, false)::INT * 2 END
  + CASE company_type WHEN 'oem_odm' THEN 20 WHEN 'manufacturer' THEN 20 WHEN 'brand' THEN 8 WHEN 'distributor' THEN 4 WHEN 'other' THEN 2 ELSE 6 END AS mf,
  CASE WHEN moq IS NULL OR other_unit THEN 17 WHEN max_moq IS NULL THEN 44 WHEN moq * 2 <= max_moq THEN 55 WHEN moq <= max_moq THEN 47 ELSE 0 END + CASE WHEN lead_days IS NULL THEN 8 WHEN max_lead IS NULL THEN 20 WHEN lead_days <= max_lead THEN 25 ELSE 0 END
  + CASE WHEN capacity IS NULL THEN 6 WHEN quantity IS NULL THEN 16 WHEN capacity >= 2 * quantity THEN 20 WHEN capacity >= quantity THEN 16 ELSE 0 END AS opf,
  CASE WHEN need = 0 THEN 0 WHEN certs IS NULL THEN 17 WHEN have = need THEN CASE WHEN certs_verified THEN 55 ELSE 38 END WHEN have * 2 >= need THEN 35 WHEN have > 0 THEN 20 ELSE 0 END + CASE WHEN certs IS NULL THEN 3 WHEN list_has_any(certs, ['ISO22716', 'CGMP']) THEN 10 ELSE 0 END AS cf, CASE WHEN need = 0 THEN 10 ELSE 65 END AS cmax FROM parts),
comp AS (SELECT *, (200 * pf + 60) // 120 AS product_fit, greatest(0, least(100, (200 * mf + 92) // 184 - CASE WHEN model <> 'either' AND NOT has_model THEN 75 ELSE 0 END)) AS model_fit, greatest(0, (200 * opf + 100) // 200 - CASE WHEN other_unit THEN 10 ELSE 0 END) AS operation_fit,
  least(100, (200 * cf + cmax) // (2 * cmax) + CASE WHEN certs_verified THEN 5 ELSE 0 END) AS compliance_fit,
  (200 * CASE WHEN seller_region IS NULL THEN 14 WHEN seller_country = destination THEN 45 WHEN seller_region = destination_region THEN 32 ELSE 22 END + 45) // 90 AS market_fit, coalesce(evidence_quality, 0) AS eq FROM points),
scored AS (SELECT *, CAST((2 * (product_fit * 30 + model_fit * 20 + operation_fit * 15 + compliance_fit * 15 + market_fit * 10 + eq * 10) + 100) // 200 AS INT) AS base_score FROM comp)"""

REVIEWS = """
reviews AS (SELECT doc_id AS record_id, lang, source, CAST(least(100, n_chars // 40) AS INT) AS score, CASE WHEN toxic = 1 THEN 'unsure' WHEN quality = 1 THEN 'accept' WHEN quality = 0 THEN 'reject' END AS verdict
  FROM documents LEFT JOIN (SELECT doc_id AS d, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) ON doc_id = d)"""

SITES = """
hosts AS (SELECT page_id AS record_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
sites AS (SELECT record_id, url, array_to_string(string_split(host, '.')[-2:], '.') AS domain, regexp_replace(array_to_string(string_split(host, '.')[:-3], '.'), '^www(\\.|$)', '') AS subdomain,
  CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INT) AS depth, scheme || '://' || host || '/' AS root FROM hosts)"""

PARTIES = """
parties AS (SELECT c_custkey AS record_id, 'company ' || (c_custkey % 211) AS name_key, CASE WHEN c_custkey % 3 <> 0 THEN 'd' || (c_custkey % 401) || '.example' END AS domain, CASE WHEN c_custkey % 13 <> 0 THEN n_name END AS country,
  CAST(c_custkey % 6 AS INT) AS claims, CAST(c_custkey % 4 AS INT) AS tier1 FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
comps AS (SELECT *, coalesce(min(record_id) OVER (PARTITION BY domain), record_id) AS c0 FROM parties),
grouped AS (SELECT * EXCLUDE (c0), CASE WHEN domain IS NULL THEN record_id ELSE c0 END AS component FROM comps)"""

_RUN = """SELECT id, score, CASE WHEN len(rules) = 0 THEN 'returned' ELSE 'excluded' END AS state, rules, CASE WHEN id % 8 <> {s} % 8 THEN id % 8 < 4 END AS flag FROM
  (SELECT id, score, list_filter([CASE WHEN score < 40 THEN 'HF-01' END, CASE WHEN (score + {s}) % 3 = 0 THEN 'HF-03' END], lambda x: x IS NOT NULL) AS rules FROM
  (SELECT c_custkey AS id, CAST((c_custkey * 7 + {s} * (c_custkey % 5)) % 101 AS INT) AS score FROM customer WHERE {where}))"""
RUNS = f"""
b AS ({_RUN.format(s=1, where='c_acctbal >= 0')}), a AS ({_RUN.format(s=2, where="c_mktsegment <> 'MACHINERY'")}),
diff AS (SELECT coalesce(b.id, a.id) AS id, b.state AS state_before, a.state AS state_after, b.score AS score_before, a.score AS score_after, b.rules AS rb, a.rules AS ra, b.flag AS fb, a.flag AS fa, b.id IS NOT NULL AND a.id IS NOT NULL AS both_runs,
  CASE WHEN b.id IS NULL THEN 'new' WHEN a.id IS NULL THEN 'gone' WHEN b.state = 'returned' AND a.state = 'excluded' THEN 'newly_excluded' WHEN b.state = 'excluded' AND a.state = 'returned' THEN 'newly_returned'
  WHEN b.state = 'excluded' AND b.rules <> a.rules THEN 'exclusion_changed' WHEN b.state = 'excluded' THEN 'excluded_both' WHEN b.score <> a.score THEN 'changed' ELSE 'unchanged' END AS change FROM b FULL JOIN a ON a.id = b.id)"""


def behind(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def _unpivot(table: str, criteria: dict[str, tuple[str, str, int]]) -> str:
    """criteria: by name, the points earned (NULL: nothing fired), whether the inputs are unknown, and the most points."""
    part = "SELECT record_id, '{k}' AS criterion, CAST(coalesce({p}, CASE WHEN {u} THEN ({m} * 60 + 100) // 200 ELSE 0 END) AS INT) AS earned, ({p}) IS NULL AND ({u}) AS unknown FROM {t}"
    return "\n UNION ALL ".join(part.format(k=k, p=p, u=u, m=m, t=table) for k, (p, u, m) in criteria.items())


_BUYER_CRITERIA = {
    "B-KF1": ("CASE WHEN len(brands) >= 3 THEN 55 WHEN len(brands) >= 1 THEN 48 WHEN k % 12 = 0 THEN 45 WHEN korean THEN 40 WHEN NOT korean THEN 0 END", "korean IS NULL AND brands IS NULL AND k % 12 <> 0", 55),
    "B-KF2": ("CASE WHEN k % 29 = 0 THEN 30 WHEN k % 13 = 0 THEN 22 WHEN korean AND list_has_any(categories, ['skincare', 'makeup', 'sunscreen']) THEN 20 END", "categories IS NULL AND korean IS NULL", 30),
    "B-KF3": ("CASE WHEN list_has_any(categories, ['skincare', 'makeup', 'sunscreen']) THEN 15 WHEN list_has_any(categories, ['haircare', 'supplements']) THEN 8 END", "categories IS NULL", 15),
    "B-CR1": ("CASE company_type WHEN 'distributor' THEN 60 WHEN 'importer' THEN 60 WHEN 'wholesaler' THEN 57 WHEN 'marketplace' THEN 36 WHEN 'brand' THEN 27 WHEN 'retailer' THEN 24 WHEN 'other' THEN 15 END", "company_type IS NULL", 60),
    "B-CR2": ("CASE WHEN k % 11 = 0 OR wholesale THEN 25 WHEN k % 14 = 0 THEN 20 WHEN NOT wholesale THEN 0 END", "wholesale IS NULL", 25),
    "B-CR3": ("CASE WHEN k % 15 = 0 THEN 15 WHEN coalesce(channels[1] = 'distributor_network', false) THEN 10 END", "k % 6 = 0 AND channels IS NULL", 15),
    "B-SI1": ("CASE k % 4 WHEN 0 THEN 45 WHEN 1 THEN 29 WHEN 2 THEN 12 END", "k % 4 = 3", 45),
    "B-SI2": ("CASE WHEN k % 6 <> 0 AND (k % 2 = 0 OR k % 5 = 0 OR k % 3 = 1) THEN least(45, 45 * (k % 2 = 0)::INT + 32 * (k % 5 = 0)::INT + 10 * (k % 3 = 1)::INT) END", "k % 6 = 0", 45),
    "B-SI3": ("CASE WHEN k % 8 <> 0 THEN CASE WHEN k % 500 <= 90 THEN 10 WHEN k % 500 <= 365 THEN 6 ELSE 2 END WHEN k % 16 = 0 THEN 5 END", "k % 8 = 0", 10),
    "B-MR1": ("CASE WHEN country = 'NATION_1' THEN 55 WHEN country IN ('NATION_2', 'NATION_3', 'NATION_4') THEN 35 WHEN country IN ('NATION_5', 'NATION_6') THEN 20 END", "country IS NULL", 55),
    "B-MR2": ("CASE WHEN list_contains(categories, 'skincare') THEN 35 WHEN list_contains(categories, 'sunscreen') THEN 25 WHEN list_contains(categories, 'makeup') THEN 15 END", "categories IS NULL", 35),
    "B-MR3": ("CASE channels[1] WHEN 'department_store' THEN 10 WHEN 'retail_store' THEN 6 END", "channels IS NULL", 10),
    "B-RE1": ("CASE WHEN form THEN 70 WHEN mail THEN 65 WHEN phone THEN 25 WHEN fax THEN 20 END", "k % 10 = 0", 70),
    "B-RE2": ("CASE form::INT + mail::INT + phone::INT + fax::INT WHEN 0 THEN NULL WHEN 1 THEN 5 WHEN 2 THEN 10 ELSE 15 END", "k % 10 = 0", 15),
    "B-RE3": ("CASE WHEN mail THEN CASE WHEN k % 4 = 3 OR k % 4 = k % 3 THEN 15 WHEN k % 4 = 2 THEN 10 ELSE 6 END END", "k % 10 = 0", 15),
}
BUYERS = f"""{EVIDENCE},
buyers AS (SELECT c_custkey AS record_id, c_custkey AS k, n_name AS country, quality AS evidence_quality, list_value('distributor', 'importer', 'wholesaler', 'marketplace', 'brand', 'retailer', 'other', NULL)[c_custkey % 8 + 1] AS company_type,
  CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 3 = 1 END AS korean, CASE WHEN c_custkey % 4 <> 0 THEN ['a', 'b', 'c', 'd'][:c_custkey % 5] END AS brands, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 5 < 3 END AS wholesale,
  CASE WHEN c_custkey % 7 <> 0 THEN list_filter(string_split(list_value('', 'skincare', 'makeup,haircare', 'supplements', 'machinery', '', 'sunscreen')[c_custkey % 7 + 1], ','), lambda x: x <> '') END AS categories,
  CASE WHEN c_custkey % 9 <> 0 THEN [list_value('retail_store', 'department_store', 'ecommerce', 'marketplace', 'salon_spa', 'distributor_network')[c_custkey % 6 + 1]] END AS channels,
  c_custkey % 10 > 1 AND c_custkey % 7 = 2 AS form, c_custkey % 10 > 1 AND c_custkey % 3 = 0 AS mail, c_custkey % 10 > 1 AND c_custkey % 4 <> 0 AS phone, c_custkey % 10 > 1 AND c_custkey % 5 = 3 AS fax
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN quality ON owner_id = c_custkey),
bcrit AS ({_unpivot('buyers', _BUYER_CRITERIA)}),
bsum AS (SELECT record_id, {', '.join(f"(200 * sum(earned) FILTER (criterion LIKE 'B-{p}%') + {m}) // {2 * m} AS {p}" for p, m in (('KF', 100), ('CR', 100), ('SI', 100), ('MR', 100), ('RE', 100)))} FROM bcrit GROUP BY 1),
bdim AS (SELECT record_id, greatest(0, least(100, KF - CASE WHEN categories = ['machinery'] THEN 60 ELSE 0 END - CASE WHEN korean IS NULL THEN 20 WHEN NOT korean THEN 25 ELSE 0 END))::INT AS kbeauty_korea_fit,
  greatest(0, least(100, CR - CASE WHEN NOT wholesale THEN 15 ELSE 0 END + CASE WHEN company_type = 'retailer' THEN CASE WHEN NOT wholesale THEN -25 WHEN channels[1] IN ('department_store', 'marketplace') THEN 20 ELSE 0 END ELSE 0 END))::INT AS b2b_commercial_role,
  greatest(0, least(100, SI - CASE WHEN k % 31 = 0 THEN 40 ELSE 0 END - CASE WHEN k % 6 = 2 THEN 10 ELSE 0 END))::INT AS sourcing_intent,
  greatest(0, least(100, MR - CASE WHEN country NOT IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_4', 'NATION_5', 'NATION_6') THEN 40 ELSE 0 END
    - CASE WHEN len(categories) > 0 AND NOT list_has_any(categories, ['skincare', 'sunscreen', 'makeup']) THEN 20 ELSE 0 END - CASE WHEN k % 23 = 0 THEN 10 ELSE 0 END))::INT AS market_relevance,
  greatest(0, least(100, RE - CASE WHEN k % 19 = 0 THEN 20 ELSE 0 END - CASE WHEN k % 10 <> 0 AND NOT (form OR mail OR phone OR fax) THEN 15 ELSE 0 END))::INT AS reachability, coalesce(evidence_quality, 0)::INT AS evidence_quality
  FROM bsum JOIN buyers USING (record_id)),
bqual AS (SELECT *, CAST((2 * (20 * kbeauty_korea_fit + 20 * b2b_commercial_role + 25 * sourcing_intent + 15 * market_relevance + 10 * reachability + 10 * evidence_quality) + 100) // 200 AS INT) AS qualification_score FROM bdim)"""
