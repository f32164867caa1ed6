import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadspark.functions import names, numeric, tristate, urls
from leadspark.operators import calibrate, evidence, matching, publish, resolve


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in df.select("k", expr(F.col("v")).alias("x")).orderBy("k").collect()]


@pytest.mark.parametrize(("text", "low", "high", "error"), [("5", 5, 5, False), ('"7"', 7, 7, False), ('{"min":1,"max":3}', 1, 3, False), ('{"max":4}', 0, 4, False), ('{"min":4}', None, None, False), ('{"min":5,"max":1}', None, None, True), ("-1", None, None, True), ('"unknown"', None, None, False), (None, None, None, False)])
def test_ranges(spark, text, low, high, error):
    r = column(spark, [text], numeric.coerce_range)[0]
    assert (r.min, r.max, r.error) == (low, high, error)


def test_half_up(spark):
    df = spark.createDataFrame([(1, 2), (3, 2), (5, 10), (0, 3), (1, 0)], "n long, d long")
    assert [r.x for r in df.select(numeric.half_up_ratio(F.col("n"), F.col("d")).alias("x")).collect()] == [1, 2, 1, 0, None]


def test_three_states(spark):
    assert column(spark, ["Yes", "0", "unknown", "", None, "TRUE"], tristate.tri_state) == [True, False, None, None, None, True]
    assert column(spark, [" a ", "Unknown", "", None], tristate.known_text) == ["a", None, None, None]
    assert column(spark, [True, False, None], lambda v: tristate.outcome(F.lit(True), v), "boolean") == ["pass", "fail", "skip"]
    assert column(spark, [True, False, None], lambda v: tristate.outcome(F.lit(None).cast("boolean"), v), "boolean") == ["na"] * 3


def test_urls(spark):
    given = ["https://User:pw@WWW.Shop.Example.co.uk:8080/a//b/?q#f", "http://example.com.", "sub.example.org/x", "http://192.168.0.1/", "localhost", "http://co.uk/", None, "http://[::1]/"]
    assert column(spark, given, urls.canonical_domain) == ["example.co.uk", "example.com", "example.org", None, None, None, None, None]
    assert column(spark, given[:3], urls.subdomain) == ["shop", "", "sub"]
    assert column(spark, given[:3], urls.path_depth) == [2, 0, 1]
    assert column(spark, ["https://m.mall.com/brand/p"], lambda u: urls.site_root(u, ("mall.com",))) == ["https://m.mall.com/brand/"]


@pytest.mark.parametrize(("name", "folded"), [("Acme Trading LLC", "acme"), ("PT Maju Jaya", "maju jaya"), ("ＡＣＭＥ　GmbH", "acme"), ("(주)한국 화장품", "한국 화장품"), ("O'Neil & Sons Inc", "o neil sons"), ("LLC", None), ("The ABC Beauty Co., Ltd.", "abc beauty"), ("ABC Beauty FZ-LLC", "abc beauty"), ("Aurora Trading", "aurora trading"), ("Aurora Group", "aurora group"), ("Beauty PT", "beauty pt"), ("Tic Beauty Studio", "tic beauty studio"), ("ABC Kozmetik San. ve Tic. Ltd. Şti.", "abc kozmetik"), ("ABC KOZMETİK SANAYİ VE TİCARET ANONİM ŞİRKETİ", "abc kozmetik"), ("주식회사한빛코스메틱", "한빛코스메틱"), ("한빛코스메틱주식회사", "한빛코스메틱"), ("LLP Cosmetics", "llp cosmetics"), ("", None), (None, None)])
def test_names(name, folded):
    assert names.fold_name(name) == folded


def test_cells_and_keys(spark):
    assert column(spark, ["=1", " +2", "a=b", "@x", None, "＝1"], names.csv_safe) == ["'=1", "' +2", "a=b", "'@x", None, "'＝1"]
    assert column(spark, ["한국 화장품", "a b"], names.match_key) == ["한국화장품", "a b"]
    assert column(spark, ["Sun Screen (SPF)", "__x"], names.slug) == ["sun_screen_spf", "x"]


@pytest.mark.parametrize(("days", "bucket", "percent"), [(90, "fresh", 100), (91, "current", 92), (365, "current", 92), (366, "aging", 80), (730, "aging", 80), (731, "stale", 60), (None, "undated", 92)])
def test_ages(spark, days, bucket, percent):
    assert column(spark, [days], evidence.recency_bucket, "int") == [bucket] and column(spark, [days], evidence.multiplier_percent, "int") == [percent]


def test_personal_data(spark):
    given = ["write a.b@c.org", "a [at] b [dot] org", "a%40b.org", "call +82 2 1234 5678", "since 2024-01-02 12345678", "tel: 02 123 4567", "0212345678", "see https://x.org/+821234567890", None, "call ０"]
    assert column(spark, given, publish.personal_data) == ["email", "obfuscated_email", "email", "phone", "", "phone", "phone", "", "", ""]


def test_rerank_guard(spark):
    rows = spark.createDataFrame([(1, 1, 90, -5), (1, 2, 88, 5), (1, 3, 84, 9), (1, 4, 70, 5)], "run_id long, id long, base int, delta int")
    got = {r.id: r.final for r in matching.rerank_guard(rows).collect()}
    assert got == {1: 85, 2: 93, 3: 85, 4: 75}


def test_rerank_guard_is_a_fold_in_order_of_base(spark):
    """Against the fold itself, over ties, chains of rows that hold each other back and runs of their own; without Python workers, of which each run took a call."""
    rng = random.Random(3)
    rows = [(k // 9, k, rng.choice((0, 3, 96, 100, *range(40, 80))), rng.randint(-12, 12)) for k in range(3000)] + [(None, 1, 50, 5), (None, 2, 44, 5), (-1, 1, 60, -5), (-1, 2, 54, None)]
    want, done = {}, {}
    for run, i, base, delta in sorted(rows, key=lambda r: (-r[2], r[1])):
        proposed = min(100, max(0, base + max(-5, min(5, delta or 0))))
        before = done.setdefault(run, [])
        want[run, i, base, delta] = min([proposed, *(f for b, f in before if b - base > 5)])
        before.append((base, want[run, i, base, delta]))
    rows, want = [*rows, (-1, 3, None, 5)], want | {(-1, 3, None, 5): None}
    df = matching.rerank_guard(spark.createDataFrame(rows, "run_id long, id long, base int, delta int").repartition(5))
    assert df.dtypes == [("run_id", "bigint"), ("id", "bigint"), ("base", "int"), ("delta", "int"), ("final", "int")]
    assert {tuple(r)[:4]: r.final for r in df.collect()} == want
    assert "Pandas" not in df._jdf.queryExecution().executedPlan().toString()


def test_constrained_groups(spark):
    rows = [(1, "a", "x.com", "KR"), (2, "a", None, "KR"), (3, "a", "y.com", "KR"), (4, "a", None, "US"), (5, "b", "x.com", "KR"), (6, None, None, None), (7, "a", None, None)]
    df = spark.createDataFrame(rows, "record_id long, name_key string, domain string, country string")
    for parts in (1, 5):
        got = dict(map(tuple, resolve.constrained_groups(df.repartition(parts)).collect()))
        assert got[1] == got[5] == got[2] == 1 and got[3] != 1 and got[4] != 1 and got[6] == 6


def _by_pairs(rows):
    """Roots of (id, name, domain, country, subdomain) by walking all pairs, as plainly as it can be said."""
    rows = sorted(rows)
    root = {r[0]: r[0] for r in rows}

    def unite(a, b):
        a, b = root[a], root[b]
        for k in root:
            if root[k] in (a, b):
                root[k] = min(a, b)

    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[2] and a[2] == b[2]:
                apart = a[4] and b[4] and a[4] != b[4] and a[1] and b[1] and a[1] not in b[1] and b[1] not in a[1]
                if not apart:
                    unite(a[0], b[0])
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if not a[1] or a[1] != b[1] or (a[2] and b[2]) or (a[3] and b[3] and a[3] != b[3]):
                continue
            both = [r for r in rows if root[r[0]] in (root[a[0]], root[b[0]])]
            if len({r[2] for r in both if r[2]}) <= 1 and len({r[3] for r in both if r[3]}) <= 1:
                unite(a[0], b[0])
    return root


RECORDS = "record_id long, name_key string, domain string, country string, subdomain string"


@pytest.mark.parametrize("seed", range(4))
def test_constrained_groups_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    names_ = ["ab", "abc", "b", "xy", None, ""]
    rows = [(k, rng.choice(names_), rng.choice([None, None, "d1.x", "d2.x", "d3.x", "d4.x", ""]), rng.choice([None, "KR", "KR", "US"]), rng.choice([None, "", "s1", "s2", "s3", "s4"]) if rng.random() < 0.4 else f"s{k % 6}") for k in rng.sample(range(1000), 40)]
    got = dict(map(tuple, resolve.constrained_groups(spark.createDataFrame(rows, RECORDS).repartition(3)).collect()))
    assert got == _by_pairs(rows)
    plain = [(*r[:4], None) for r in rows]
    assert dict(map(tuple, resolve.constrained_groups(spark.createDataFrame(rows, RECORDS).drop("subdomain")).collect())) == _by_pairs(plain)


def test_links_of_every_name_and_tenants_apart(spark):
    rows = [(1, "a", "d1.x", None, None), (2, "b", "d1.x", None, None), (3, "b", None, None, None), (4, "one", "host.x", None, "p"), (5, "two", "host.x", None, "q"), (6, "onetwo", "host.x", None, "q"), (7, "three", "host.x", None, "r"), (8, None, None, None, None)]
    got = dict(map(tuple, resolve.constrained_groups(spark.createDataFrame(rows, RECORDS)).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    assert resolve.constrained_groups(spark.createDataFrame([], RECORDS)).collect() == []


def test_auc_against_pairs(spark):
    rows = [(s, v) for s, v in zip([10, 20, 20, 30, 40, 40], ["reject", "accept", "reject", "accept", "accept", "reject"], strict=True)]
    df = spark.createDataFrame(rows, "score int, verdict string")
    u = sum((a > r) + 0.5 * (a == r) for a, x in rows if x == "accept" for r, y in rows if y == "reject")
    assert calibrate.auc(df).first().auc_bp == round(u / 9 * 10_000)


def test_domains_that_strangers_share_are_no_key(spark):
    given = ["a.com.pk", "b.com.pk", "shop.co.il", "x.co.il/", "smartstore.naver.com/brand", "shop1.cafe24.com", "cafe24.com", "https://www.www.example.com", "web.de", "a.web.de", "https://xn--hy1b45cw6b22g85n.kr/", "not a url", "-x.com"]
    assert column(spark, given, urls.canonical_domain) == ["a.com.pk", "b.com.pk", "shop.co.il", "x.co.il", None, "shop1.cafe24.com", None, "example.com", "web.de", "a.web.de", "xn--hy1b45cw6b22g85n.kr", None, None]


def test_conflicts_and_quality(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, 1, "view", 1, d, "a", True, False, False, 2), (1, 2, "view", 3, None, "b", False, False, False, 1), (1, 3, "click", 5, d, "a", False, False, False, 99)]
    df = spark.createDataFrame(rows, "owner_id long, evidence_id long, claim string, source_tier int, source_date date, domain string, is_official boolean, inferred boolean, stale boolean, conflicts_with long")
    assert sorted(evidence.conflict_pairs(df).collect()) == [(1, 1, 2), (1, 3, 99)]
    records = spark.createDataFrame([(1, False, ["click"], 0), (2, True, [], 4)], "owner_id long, stale boolean, resolved array<string>, unknown_claims int")
    assert evidence.conflict_pairs(df, records).collect() == [(1, 1, 2)]
    rows = {r.owner_id: r for r in evidence.quality(df, ["view", "click"], F.lit("2024-02-01").cast("date"), records).collect()}
    # strengths 100 and 20, mean 60; both claims; two domains: 50; +10 official, +7, -10 conflict: 30 + 35 + 7.5 + 7 = 79.5
    assert rows[1].quality == 80 and rows[2].quality == 0
    pct = {r.owner_id: r.confidence_pct for r in evidence.confidence(evidence.quality(df, ["view", "click"], F.lit("2024-02-01").cast("date"), records)).collect()}
    assert pct == {1: 68, 2: 5}  # 80 x 0.85; the least
