"""Invariants of records, of match results and of exported cells as tables of violations: an empty table is a valid input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadspark.functions.names import csv_safe
from leadspark.operators.publish import personal_data

#: Words that stand in for "unknown", which must be said as such.
STAND_INS = ("n/a", "na", "null", "nil", "none given", "-", "--", "?", "tbd", "n.a.")
#: States past human review.
FORBIDDEN = ("APPROVED_FOR_OUTREACH", "CONTACTED", "REPLIED", "RFQ_RECEIVED", "PROPOSAL_RECEIVED", "MATCHED")
#: The criterion whose penalty answers for a rule that was skipped.
PENALTY_OF = {"HF-01": "S-PF1", "HF-02": "S-CM1", "HF-03": "S-OP1", "HF-04": "S-CP1", "HF-07": "S-OP2"}


def _found(rows: DataFrame, keys: list[str], checks: list[tuple[str, str, Column]]) -> DataFrame:
    """One row a (row, check) that is broken; a condition that is NULL is not broken."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(what).alias("what"))) for rule, what, broken in checks]))
    return rows.select(*keys, F.explode(hits).alias("_hit")).select(*keys, "_hit.rule", "_hit.what")


def stand_in(text: Column, code: bool = False) -> Column:
    """The text only stands in for unknown; in a field of codes NA is data (Namibia, North America)."""
    t = F.lower(F.trim(text))
    hit = t.isin(*STAND_INS)
    return hit & (text != "NA") if code else hit


def record_violations(records: DataFrame, texts: list[str], codes: list[str]) -> DataFrame:
    """record_id, rule, what of records with status, outreach_status, auto_send, manual_approval_required, penalties and missing
    (labels), as_of, observed_on, source_date, and the named text and code columns. Absent lists and dates break nothing."""
    c = F.col
    checks = [("INV-02", name, stand_in(c(name), name in codes)) for name in texts + codes]
    checks += [
        ("INV-09", "status", c("status").isin(*FORBIDDEN)), ("INV-09", "outreach_status", c("outreach_status") != "READY_FOR_REVIEW"), ("INV-09", "auto_send", c("auto_send")), ("INV-09", "manual_approval_required", ~c("manual_approval_required")),
        ("INV-24", "observed_on", c("observed_on") > c("as_of")), ("INV-24", "source_date", c("source_date") > c("observed_on")), ("INV-03", "missing", F.size(F.array_except("penalties", "missing")) > 0),
    ]
    return _found(records, ["record_id"], checks)


def match_violations(results: DataFrame, max_delta: int = 5) -> DataFrame:
    """rfq_id, position, seller_id, rule, what of returned candidates: bounds of the rerank, score and contributions, evidenced
    reasons, failed and skipped rules, penalties, and the order by score, then domain (unknown last); rows of one position go by seller_id. Columns: base, delta,
    applied, score, domain, contributions (their sum), evidenced, rationale, cites, passed, failed, skipped, penalties, labels, missing."""
    c = F.col
    empty = F.array().cast("array<string>")
    lists = {x: F.coalesce(x, empty) for x in ("failed", "skipped", "penalties")}
    pair = F.map_from_arrays(F.array(*map(F.lit, PENALTY_OF)), F.array(*map(F.lit, PENALTY_OF.values())))
    paired = lambda rule: F.array_contains(lists["penalties"], rule) | F.coalesce(F.array_contains(lists["penalties"], F.try_element_at(pair, rule)), F.lit(False))
    w = Window.partitionBy("rfq_id").orderBy("position", "seller_id")
    key = F.struct((-F.coalesce(c("score"), F.lit(0))).alias("a"), (F.coalesce(c("domain"), F.lit("")) == "unknown").alias("b"), F.coalesce("domain", F.lit("")).alias("c"))
    rows = results.withColumn("_key", key).withColumn("_last", F.lag("_key").over(w))
    clamp = F.greatest(F.lit(0), F.least(F.lit(100), c("base") + c("delta")))
    blank = F.coalesce(F.trim("rationale"), F.lit("")) == ""
    checks = [
        ("INV-08", "delta beyond its bound", F.abs("delta") > max_delta), ("INV-08", "applied without rationale", c("applied") & blank), ("INV-08", "applied without evidence", c("applied") & (F.coalesce("cites", F.lit(0)) == 0)),
        ("INV-08", "delta but not applied", ~F.coalesce("applied", F.lit(False)) & (c("delta") != 0)), ("INV-05", "score", c("score") != clamp), ("INV-05", "contributions", F.abs(c("contributions") - c("base")) > 0.5),
        ("INV-20", "fewer than two evidenced reasons", c("passed") & (F.coalesce("evidenced", F.lit(0)) < 2)), ("INV-06", "passed with failed rules", c("passed") & (F.size(lists["failed"]) > 0)),
        ("INV-07", "failed and skipped", F.arrays_overlap(lists["failed"], lists["skipped"])), ("INV-07", "skipped without penalty", F.exists(lists["skipped"], lambda rule: ~paired(rule))),
        ("INV-03", "penalty not in missing", F.size(F.array_except("labels", "missing")) > 0), ("INV-30", "order", c("_key") < c("_last")),
    ]
    return _found(rows, ["rfq_id", "position", "seller_id"], checks)


def match_summaries(summaries: DataFrame) -> DataFrame:
    """rfq_id, rule, what of each result's counters: considered, passed, returned, excluded_count, excluded (rows emitted), no_match, reason."""
    c = F.col
    checks = [
        ("INV-30", "considered, passed, returned", (c("considered") < c("passed")) | (c("passed") < c("returned"))), ("INV-32", "excluded_count below rows", c("excluded_count") < c("excluded")),
        ("INV-32", "excluded_count", c("excluded_count") != c("considered") - c("passed")), ("INV-21", "empty but not said so", (c("returned") == 0) & ~F.coalesce("no_match", F.lit(False))),
        ("INV-21", "no match with results", c("no_match") & (c("returned") > 0)), ("INV-21", "no reason", c("no_match") & (F.coalesce(F.trim("reason"), F.lit("")) == "")),
    ]
    return _found(summaries, ["rfq_id"], checks)


def resurrected(results: DataFrame, excluded: DataFrame) -> DataFrame:
    """rfq_id, seller_id that are both returned and excluded."""
    return results.select("rfq_id", "seller_id").join(excluded.select("rfq_id", "seller_id"), ["rfq_id", "seller_id"], "left_semi").distinct()


def unsafe_cells(rows: DataFrame, key: str, columns: list[str], phone_ok: tuple[str, ...] = ()) -> DataFrame:
    """key, rule, what of cells an import could not take: formula leads, quotes or line breaks, personal data (columns of
    phone_ok may hold a phone number). Such an export is refused, never repaired."""
    checks = []
    for name in columns:
        text, kinds = F.col(name), F.split(personal_data(F.col(name)), ";")
        told = F.array_except(kinds, F.array(F.lit(""), F.lit("phone" if name in phone_ok else "")))
        checks += [("formula", name, csv_safe(text) != text), ("unreadable", name, text.rlike('["\\r\\n]')), ("personal", name, F.size(told) > 0)]
    return _found(rows, [key], checks)
