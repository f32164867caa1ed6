"""Privacy scan, export, upsert, intake and validation: each check is a DataFrame of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.functions.vocabulary import UNITS, unit

#: Local parts of role mailboxes, and domains where anybody can have an address.
ROLE_MAILBOXES = ("b2b", "brands", "business", "buying", "contact", "distribution", "einkauf", "enquiries", "enquiry", "export", "exports", "hello", "import", "imports", "info", "inquiries", "inquiry", "kaigai", "odm", "oem", "office", "orders", "partner", "partners", "partnership", "partnerships", "procurement", "purchasing", "sales", "sellers", "sourcing", "trade", "vertrieb", "wholesale")
FREE_MAIL = ("gmail.com", "googlemail.com", "yahoo.com", "hotmail.com", "outlook.com", "live.com", "aol.com", "naver.com", "daum.net", "hanmail.net", "qq.com", "163.com", "126.com")
#: From each state, the states that a record may be moved to; from others, which the application owns, none.
TRANSITIONS = {
    "DISCOVERED": ("VERIFIED", "CLOSED"),
    "VERIFIED": ("QUALIFIED", "DISCOVERED", "CLOSED"),
    "QUALIFIED": ("MATCH_CANDIDATE", "READY_FOR_REVIEW", "VERIFIED", "CLOSED"),
    "MATCH_CANDIDATE": ("READY_FOR_REVIEW", "QUALIFIED", "CLOSED"),
    "READY_FOR_REVIEW": ("QUALIFIED", "MATCH_CANDIDATE", "CLOSED"),
    "CLOSED": (),
}
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
OBFUSCATED = r"(?i)[a-z0-9._+-]+ ?[\[(] ?at ?[\])] ?[a-z0-9-]+ ?[\[(] ?dot ?[\])] ?[a-z]+"
URL, ISO_DATE = r"https?://[^ \t\n]+", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
#: A telephone number needs a signal: a plus, a trunk zero and nine digits, or a label just before it.
PHONE_PLUS, PHONE_TRUNK = r"\+[0-9][0-9 ().-]{7,}[0-9]", r"(?:^|[^0-9A-Za-z])0[0-9](?:[ .-]?[0-9]){7,12}"
PHONE_LABEL = r"(?i)(?:tel|phone|mobile|fax|whatsapp)[^0-9a-z]{0,24}[0-9][0-9 ().-]{5,}[0-9]"


def personal_data(text: Column) -> Column:
    """The kinds of personal data in a text, in order, joined; URLs and ISO dates don't count as telephone numbers."""
    t = F.coalesce(text, F.lit(""))
    # Cheap tests first: most texts hold neither sign.
    bare = F.regexp_replace(F.regexp_replace(t, URL, " "), ISO_DATE, " ")
    email = t.contains("@") & t.rlike(EMAIL)
    hidden = t.rlike(OBFUSCATED)
    encoded = t.contains("%40") & F.replace(t, F.lit("%40"), F.lit("@")).rlike(EMAIL)
    phone = bare.rlike(PHONE_PLUS) | bare.rlike(PHONE_TRUNK) | bare.rlike(PHONE_LABEL)
    return F.array_join(F.array_compact(F.array(F.when(email | encoded, "email"), F.when(hidden, "obfuscated_email"), F.when(phone, "phone"))), ";")


def role_address(address: Column, domains: Column) -> Column:
    """The address in lower case if it is that of a function, not a person, on one of the company's own domains exactly
    (without www) and that is no free-mail domain; else NULL: what is in doubt is withheld."""
    plain = F.lower(F.trim(address))
    host = F.regexp_replace(F.substring_index(plain, "@", -1), r"^(?:www\.)+", "")
    safe = plain.rlike(f"^{EMAIL}$") & F.substring_index(plain, "@", 1).isin(*ROLE_MAILBOXES) & ~host.isin(*FREE_MAIL) & F.array_contains(domains, host)
    return F.when(F.coalesce(safe, F.lit(False)), plain)


def fold_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n]+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def number_in_quote(number: Column, quote: Column) -> Column:
    """The number's digits stand in the quote; a multiplier word forgives trailing zeros."""
    plain = F.contains(digits(quote), digits(number.cast("string")))
    root = F.regexp_replace(number.cast("string"), "0+$", "")
    return plain | (F.lower(quote).rlike(r"\b(thousand|million|k|m)\b") & F.contains(digits(quote), root))


def export_cell(value: Column, applicable: Column, withheld: Column) -> Column:
    """The literals of an empty cell: unknown, none, not_applicable, withheld."""
    joined = F.array_join(value, "; ")
    return F.when(~applicable, "not_applicable").when(withheld, "withheld").when(value.isNull(), "unknown").when(F.size(value) == 0, "none").otherwise(joined)


def skip_reason(status: Column, qualified: Column, score: Column, country: Column, least: int, countries: list[str]) -> Column:
    """The first reason in order for which a record is not exported; NULL if none."""
    return (
        F.when(~status.isin("SCORED", "QUALIFIED"), "status").when(~F.coalesce(qualified, F.lit(False)), "not_qualified")
        .when(F.coalesce(score, F.lit(-1)) < least, "below_score").when(~F.coalesce(country.isin(*countries), F.lit(False)), "country")
    )


def upsert(existing: DataFrame, incoming: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """id and outcome of writing (id, score, status): created, unchanged, updated, or refused where the score or the
    status would fall back."""
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == k, F.lit(v)) for k, v in ranks.items()])
    e = existing.select(F.col("id").alias("_id"), F.col("score").alias("_score"), F.col("status").alias("_status"))
    j = incoming.join(e, F.col("id") == F.col("_id"), "left")
    same = F.col("score").eqNullSafe(F.col("_score")) & F.col("status").eqNullSafe(F.col("_status"))
    worse = (F.col("score") < F.col("_score")) | (rank("status") < rank("_status"))
    out = F.when(F.col("_id").isNull(), "created").when(same, "unchanged").when(F.coalesce(worse, F.lit(False)), "refused").otherwise("updated")
    return j.select("id", "score", "status", out.alias("outcome"))


def illegal_moves(moves: DataFrame) -> DataFrame:
    """Moves (id, from_state, to_state) that no edge allows. A record without a state may get any, and one may stay."""
    to = F.col("to_state")
    allowed = F.coalesce(*[F.when(F.col("from_state") == f, to.isin(*ts) if ts else F.lit(False)) for f, ts in TRANSITIONS.items()], F.lit(False))
    return moves.where(F.col("from_state").isNotNull() & ~F.col("from_state").eqNullSafe(to) & ~F.coalesce(allowed, F.lit(False)))


def duplicate_groups(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that several records share: their number and smallest and largest ids, not lists of all of them."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).where("n > 1")


def open_questions(rfqs: DataFrame, fields: dict[str, int]) -> DataFrame:
    """For each request its missing fields as numbered questions Q-nn, by rank of reason (missing before unclear), then
    rank of field; fields: name and rank."""
    q = F.filter(F.array(*[F.struct(F.lit(rank).alias("rank"), F.lit(f).alias("field"), F.col(f).isNull().alias("missing")) for f, rank in fields.items()]), lambda x: x["missing"])
    e = rfqs.select("rfq_id", F.posexplode(F.array_sort(q)).alias("p", "x"))
    return e.select("rfq_id", F.format_string("Q-%02d", F.col("p") + 1).alias("question_id"), "x.field")


def readiness(rfqs: DataFrame, fields: list[str]) -> DataFrame:
    filled = sum((F.col(f).isNotNull().cast("int") for f in fields), F.lit(0))
    gaps = F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))), ";")
    return rfqs.select("rfq_id", filled.cast("int").alias("filled"), F.lit(len(fields)).alias("of"), gaps.alias("missing"))


def cuts_no_word(message: Column, quote: Column) -> Column:
    """The quote stands in the message somewhere without starting or ending inside a word of ASCII letters and digits
    ("on" in "toner" does not count). Other scripts put particles on a word, so they are not held to it. False for an empty quote."""
    literal = F.concat(F.lit(r"\Q"), F.replace(quote, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    before = F.when(quote.rlike("^[0-9A-Za-z]"), "(?<![0-9A-Za-z])").otherwise("")
    after = F.when(quote.rlike(r"[0-9A-Za-z]\z"), "(?![0-9A-Za-z])").otherwise("")
    return (quote != "") & F.contains(message, quote) & F.call_function("rlike", message, F.concat(before, literal, after))


def held_quotes(quotes: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, turn, quote of the quotes (conv_id, quote; folded) that stand whole in a message (conv_id, turn, t; folded)
    of the same conversation. An empty quote proves nothing and is in none."""
    q = quotes.where("quote <> ''")
    return q.join(messages, "conv_id").where(cuts_no_word(F.col("t"), F.col("quote"))).select("conv_id", "turn", "quote")


def stated_amount(value: Column, unit_text: Column) -> Column:
    """(value, unit, question, error) of an amount as a buyer wrote it: a number without a unit is held and asked for, as a
    guess would be; a unit that is neither known nor of a currency's three letters is an error."""
    named = ~F.coalesce(F.lower(F.trim(unit_text)).isin("", "unknown", "."), F.lit(True))
    canonical = unit(unit_text)
    known = canonical.isin(*sorted(set(UNITS.values()))) | canonical.rlike("^[a-z]{3}$")
    fine = value.isNotNull() & named & known
    return F.struct(F.when(fine, value).alias("value"), F.when(fine, canonical).alias("unit"), F.when(value.isNotNull() & ~named, "unit_unstated").alias("question"), F.coalesce(value.isNotNull() & named & ~known, F.lit(False)).alias("error"))


def quantity_text(low: Column, high: Column, unit_name: Column) -> Column:
    """1,000-5,000 units; one number where both ends are equal; unknown where either is."""
    plain = lambda x: F.regexp_replace(F.format_number(x.cast("decimal(20,6)"), 6), r"\.?0+$", "")
    text = F.when(low == high, plain(low)).otherwise(F.concat(plain(low), F.lit("-"), plain(high)))
    return F.when(text.isNull(), "unknown").otherwise(F.concat_ws(" ", text, F.nullif(unit_name, F.lit(""))))


def export_rows(records: DataFrame, columns: list[str], dimensions: list[str], droppable: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a lead sheet as text: the columns (lists joined; unknown, none), then dim_<name> of the map dimension_scores
    (unknown without scores, not_applicable for a droppable dimension that is left out), then missing, score_version, as_of."""

    def cell(name: str) -> Column:
        c, kind = F.col(name), records.schema[name].dataType.typeName()
        if kind == "array":
            return export_cell(F.transform(c, lambda x: x.cast("string")), F.lit(True), F.lit(False))
        text = c.cast("string")
        return F.when(text.isNull() | F.lower(F.trim(text)).isin("", "unknown"), "unknown").otherwise(text)

    scores = F.col("dimension_scores")
    dims = [
        F.when(scores.isNull(), "unknown").when(F.lit(d in droppable) & ~F.map_contains_key(scores, F.lit(d)), "not_applicable").otherwise(F.coalesce(F.try_element_at(scores, F.lit(d)).cast("string"), F.lit("unknown"))).alias(f"dim_{d}")
        for d in dimensions
    ]
    return records.select(*[cell(c).alias(c) for c in columns], *dims, *[cell(c).alias(c) for c in ("missing", "score_version", "as_of")])
