import random

import pytest
from pyspark.sql import functions as F

from leadspark.functions import vocabulary
from leadspark.operators import calibrate, matching, merge, publish, violations
from leadspark.sources import tables

VALUES = "component long, absorbed boolean, record_id long, field string, value string, evidence_id long, confidence double, tier int, source_date date, official boolean"


def test_backed_values_win_and_conflicts_are_kept(spark):
    rows = [
        (1, False, 5, "country", "KR", None, None, None, None, None), (1, True, 2, "country", "JP", 20, 0.5, 2, None, False), (1, True, 3, "country", "KR", 30, 0.5, 2, None, True), (1, True, 7, "country", None, 70, 0.9, 1, None, True), (1, True, 8, "country", "CN", 80, 0.8, 1, None, True),
        (2, False, 1, "country", None, None, None, None, None, None), (2, True, 9, "country", "US", None, None, None, None, None), (3, False, 4, "country", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, VALUES).repartition(3)
    assert {r.component: (r.value, r.record_id) for r in merge.merge_fields(df).collect()} == {1: ("JP", 2), 2: ("US", 9), 3: (None, None)}
    got = sorted((r.record_id, r.winning_value, r.losing_value, r.resolution) for r in merge.field_conflicts(df).collect())
    # 8 meets the unknown record's item as well, which backs the field
    assert got == [(2, "JP", "KR", "higher_confidence"), (3, "JP", "KR", "manual"), (8, "JP", "CN", "higher_confidence")]
    assert merge.merge_fields(df.limit(0)).collect() == [] and merge.field_conflicts(df.limit(0)).collect() == []


def test_lists(spark):
    rows = [(1, False, 1, "certs", []), (1, True, 2, "certs", None), (1, True, 3, "certs", ["B", "A", "B"]), (1, True, 4, "certs", []), (2, False, 5, "certs", None), (3, False, 6, "certs", [])]
    df = spark.createDataFrame(rows, "component long, absorbed boolean, record_id long, field string, items array<string>")
    assert {r.component: r["items"] for r in merge.merge_lists(df).collect()} == {1: ["A", "B"], 2: None, 3: []}
    assert sorted((r.record_id, r.loser) for r in merge.list_conflicts(df).collect()) == [(3, "survivor"), (4, "absorbed")]


def test_whole_records(spark):
    rows = [(1, False, 9, "a.x", "https://a.x/p/q", 2, True, "active", "2024-01-02", "QUALIFIED"), (1, True, 2, "b.x", "https://b.x", 0, True, "closed", "2024-01-02", "DISCOVERED"), (1, True, 4, None, None, None, None, "moved", "2024-02-01", None), (2, False, 3, None, None, None, None, None, None, "QUALIFIED")]
    df = spark.createDataFrame(rows, "component long, absorbed boolean, record_id long, domain string, website string, depth int, stale boolean, operational_status string, seen string, state string")
    got = {r.component: r for r in merge.merge_records(df).collect()}
    assert (got[1].survivor, got[1].merged_from, got[1].alias_domains, got[1].website, got[1].stale, got[1].operational_status, got[1].state, got[1].unscored) == (9, [2, 4], ["b.x"], "https://b.x", False, "moved", "VERIFIED", True)
    assert (got[2].merged_from, got[2].domain, got[2].stale, got[2].operational_status, got[2].state, got[2].unscored) == ([], None, None, None, "QUALIFIED", False)


def _turns(before, after):
    """Pairs of {id: merged_from} as taking turns gives them."""
    pairs = [(k, k, "id") for k in set(before) & set(after)]
    b, a = set(before) - set(after), set(after) - set(before)
    for hosts, parts, lists, flip in ((a, b, after, False), (b, a, before, True)):
        for host in sorted(hosts):
            found = sorted(x for x in set(lists[host] or []) if x in parts)
            if found:
                parts.discard(found[0])
                hosts.discard(host)
                pairs.append((host, found[0], "merged_from") if flip else (found[0], host, "merged_from"))
    return sorted(pairs)


@pytest.mark.parametrize("seed", range(3))
def test_pairs_by_turns(spark, seed):
    rng = random.Random(seed)
    sides = [{k: rng.choice([None, [], rng.sample(range(30), 4)]) for k in rng.sample(range(30), 18)} for _ in range(2)]
    dfs = [spark.createDataFrame([(k, v) for k, v in s.items()], "id long, merged_from array<long>") for s in sides]
    assert sorted(map(tuple, calibrate.pair_runs(*dfs).collect())) == _turns(*sides)


def test_no_violation_of_unknown(spark):
    row = "cast(1 as long) rfq_id, 0 position, cast(2 as long) seller_id"
    nothing = ", ".join(f"cast(null as {t}) {c}" for c, t in {"base": "int", "delta": "int", "applied": "boolean", "score": "int", "domain": "string", "contributions": "double", "evidenced": "int", "rationale": "string", "cites": "int", "passed": "boolean", **{x: "array<string>" for x in ("failed", "skipped", "penalties", "labels", "missing")}}.items())
    assert violations.match_violations(spark.sql(f"select {row}, {nothing}")).collect() == []
    cells = spark.createDataFrame([(1, None, "+82 2 1234 5678"), (2, "", "ok"), (3, "＝x", "a.b@c.org")], "id long, a string, b string")
    got = sorted((r.id, r.rule, r.what) for r in violations.unsafe_cells(cells, "id", ["a", "b"], ("b",)).collect())
    assert got == [(1, "formula", "b"), (3, "formula", "a"), (3, "personal", "b")]
    assert [r.x for r in spark.createDataFrame([("NA",), ("na",), (None,)], "v string").select(violations.stand_in(F.col("v"), True).alias("x")).collect()] == [False, True, None]


def _scored(spark, **given):
    plain = {"relation": "'exact'", "model": "'oem_odm'", "oem_odm": "true", "private_label": "cast(null as boolean)", "brand_export": "cast(null as boolean)", "company_type": "'manufacturer'", "moq": "1200", "max_moq": "3000", "moq_unit": "'units'", "rfq_unit": "'units'", "lead_days": "30", "max_lead": "60", "capacity": "150000", "quantity": "5000", "required_certs": "array('CGMP')", "certs": "array('CGMP')", "certs_verified": "true", "seller_region": "'R'", "destination_region": "'R'", "seller_country": "'A'", "destination": "'A'", "evidence_quality": "80"}
    return matching.with_scores(spark.sql("select " + ", ".join(f"{v} as {k}" for k, v in (plain | given).items())), 10).first()


def test_match_components(spark):
    r = _scored(spark)
    assert (r.product_fit, r.model_fit, r.operation_fit, r.compliance_fit, r.market_fit) == (100, 92, 100, 100, 100)
    assert _scored(spark, moq="2500", max_lead="cast(null as int)").operation_fit == 47 + 20 + 20
    assert _scored(spark, moq="cast(null as int)", max_moq="cast(null as int)", lead_days="cast(null as int)", capacity="cast(null as int)").operation_fit == 17 + 8 + 6
    assert _scored(spark, moq="3300", lead_days="66", capacity="4000").operation_fit == 25 + 12
    assert _scored(spark, moq_unit="'kg'").operation_fit == 17 + 25 + 20 - 10
    # the wanted model is unknown, a related one is there: 36 + 5 + 20 of 92; known to be wanting: 60 - 75
    assert _scored(spark, model="'private_label'").model_fit == 66
    assert _scored(spark, model="'private_label'", private_label="false").model_fit == 0
    assert _scored(spark, model="'either'", oem_odm="false", private_label="false").model_fit == 22
    assert _scored(spark, oem_odm="cast(null as boolean)").model_fit == 46
    # no required certificates: only the quality system counts
    nothing = "cast(array() as array<string>)"
    assert _scored(spark, required_certs=nothing, certs="array('HALAL')", certs_verified="false").compliance_fit == 0
    assert _scored(spark, required_certs=nothing, certs="array('ECOCERT')", certs_verified="false").compliance_fit == 60
    assert _scored(spark, certs="cast(null as array<string>)", certs_verified="false").compliance_fit == 31
    assert _scored(spark, required_certs="array('CGMP', 'HALAL', 'VEGAN')", certs_verified="false").compliance_fit == 46


def test_quotes_cut_no_word(spark):
    rows = [("a toner", "on", False), ("on a toner", "on", True), ("인도네시아에 판매", "인도네시아", True), ("c++ \\E+", "\\E+", True), ("abc", "", False), ("x 10", "1", False), ("10,000 pcs.", "10,000 pcs", True), (None, "a", None)]
    df = spark.createDataFrame([(k, m, q) for k, (m, q, _) in enumerate(rows)], "k int, m string, q string")
    got = [r.x for r in df.select("k", publish.cuts_no_word(F.col("m"), F.col("q")).alias("x")).orderBy("k").collect()]
    assert got == [x for _, _, x in rows]


def test_amounts_countries_and_sheets(spark, tmp_path):
    df = spark.createDataFrame([(k, a, u) for k, (a, u) in enumerate([(5, "PCS"), (5, None), (5, "jars of"), (None, None), (5, "usd")])], "k int, a int, u string")
    assert [tuple(r.x) for r in df.select("k", publish.stated_amount(F.col("a"), F.col("u")).alias("x")).orderBy("k").collect()] == [(5, "units", None, False), (None, None, "unit_unstated", False), (None, None, None, True), (None, None, None, False), (5, "usd", None, False)]
    q = spark.createDataFrame([(0, 1000.0, 5000.0), (1, 2.5, 2.5), (2, None, 3.0), (3, 0.0, 10.0)], "k int, a double, b double")
    assert [r.x for r in q.select("k", publish.quantity_text(F.col("a"), F.col("b"), F.lit("kg")).alias("x")).orderBy("k").collect()] == ["1,000-5,000 kg", "2.5 kg", "unknown", "0-10 kg"]
    c = spark.createDataFrame([(["UK", "영국", "Mars", "kr", None],), (None,), ([],)], "v array<string>").select(vocabulary.country_list(spark, F.col("v")).alias("x")).collect()
    assert [tuple(r.x) for r in c] == [(["GB", "KR"], ["Mars", None]), (None, None), ([], [])]
    tables.write_rows(spark.createDataFrame([("=1", "b")], "a string, c string"), str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).collect() == [("'=1", "b")]
