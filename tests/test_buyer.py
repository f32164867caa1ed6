"""Buyer scoring on records that are unknown, known to be empty, or full."""

from leadspark.operators import buyer

SCHEMA = """record_id long, evidence_quality int, country string, company_type string, korean_signal boolean, brands array<string>, categories array<string>, wholesale boolean, has_moq boolean, intent string,
sourcing_signals array<string>, channels array<string>, contacts array<struct<type: string, value: string>>, canonical_domain string, alias_domains array<string>, partnership boolean, stale boolean, drift boolean,
claims array<string>, official_claims array<string>, sourcing_age int, standing_page boolean"""
UNKNOWN = (1, *[None] * 21)
EMPTY = (2, 0, "XX", "other", False, [], [], False, False, "low", [], [], [], "a.example", [], False, False, False, [], [], None, False)
MAILS = [("corporate_email", "Info@A.example"), ("corporate_email", "mailto:info@a.example"), ("phone", "n/a"), ("phone", None)]
FULL = (3, 80, "KR", "importer", True, ["a", "b", "c"], ["skin"], True, True, "high", ["rfq_posted", "open_call", "rfq_posted"], ["x"], MAILS, "a.example", None, True, False, False, ["korean_category_page"], [], 90, False)
ASKED = buyer.Request(country="KR", categories=["skin"], core=["skin"])


def test_scores(spark):
    rows = {r["record_id"]: r for r in buyer.score(spark.createDataFrame([UNKNOWN, EMPTY, FULL], SCHEMA), ASKED).collect()}
    earned = {k: {c["criterion"]: (c["earned"], c["unknown"]) for c in r["criteria"]} for k, r in rows.items()}
    assert "B-MR3" not in earned[1]  # the request names no channels
    assert all(unknown for _, unknown in earned[1].values())
    assert earned[1]["B-KF1"] == (17, True) and earned[1]["B-CR1"] == (18, True)
    assert earned[2]["B-KF1"] == (0, False) and earned[2]["B-RE2"] == (0, False)
    assert rows[2]["market_relevance"] == 0  # the country does not match
    assert earned[3]["B-SI2"] == (45, False) and earned[3]["B-SI3"] == (10, False)
    assert earned[3]["B-RE2"] == (15, False)  # one address written twice, and two contacts without a value
    assert earned[3]["B-RE3"] == (15, False)
    assert rows[3]["market_relevance"] == 100


def test_nothing_in_nothing_out(spark):
    assert buyer.score(spark.createDataFrame([], SCHEMA), buyer.Request()).count() == 0
