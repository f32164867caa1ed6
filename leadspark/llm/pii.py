"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Patterns find e-mail addresses, IP addresses, payment cards and phone numbers. Protected entities are these strings, and
the groups they belong to: the domain of an address, the first two parts of an IP, the first six digits of a card, the
first four of a phone number. Co-occurrence is counted over whole texts of the whole corpus. Of each entity e the
information content is ic(e) = -log2 P(e), with P(e) = df(e) / N, and a term t gives away
pmi(t, e) = log2 P(e | t) - log2 P(e) of it. P(e | t) = (df(t, e) + SMOOTH P(e)) / (df(t) + SMOOTH) is smoothed towards P(e), so that a
term seen once says less than one seen often. A term discloses e if pmi(t, e) is at least DISCLOSURE of ic(e). df counts documents.
Entities, and disclosing terms wherever they stand in any text, are generalised to their kind or removed.

Defined results: a null text is empty; an entity of fewer than LEAST_BITS of information (one in many documents) is no secret,
and no term discloses it, but it is found itself; letters inside an entity are no terms; ties at the threshold disclose; very
long texts are read whole; repeated rows count as documents and give one result row each; other columns of the documents are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadspark.llm.common import ascii_lower, materialise

#: The kinds in their order, with their patterns. \G and the look-behind keep a start inside a run that
#: was already tried from being tried again, possessive counts keep the engine from backtracking; neither changes what matches.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An address of parts of at most 255 each.
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)"
#: Share of an entity's information from which a term discloses it; documents without the entity's surplus that every
#: term is taken to have been seen in; information below which an entity is no secret.
DISCLOSURE, SMOOTH, LEAST_BITS = 0.95, 0.5, 3.0
#: Up to so many rows a table of terms is broadcast; a larger one is joined as Spark plans.
BROADCAST_ROWS = 500_000
#: Fixed value: letters, in any script.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]++"
SPAN = "struct<start:int,kind:int,end:int>"


def _matches(text: Column, pattern: str, keep, make, as_type: str) -> Column:
    """Array of make(match, start, end) for the matches that keep(match) holds for. Positions are code points from 0."""
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{as_type}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.coalesce(F.char_length(x["hit"]), F.lit(0))
        out = F.when(x["hit"].isNotNull() & keep(x["hit"]), F.concat(acc["out"], F.array(make(x["hit"], start, end)))).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    return F.aggregate(rows, zero, add, lambda acc: acc["out"])


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = _digits(match)
    n = F.char_length(digits)

    def value(total: Column, i: Column) -> Column:
        x = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(x)

    return n.between(14, 19) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), value) % 10 == 0)


#: For each kind: whether a text can hold one at all, and whether a match counts.
CAN = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
}
COUNTS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.transform(F.split(m, r"\."), lambda p: ~p.rlike(f"^{BYTE}$")).cast("string").contains("true") == F.lit(False),
    "card": lambda m: F.when(F.char_length(_digits(m)).between(14, 19), _luhn(m)).otherwise(F.lit(False)),
    "phone": lambda m: F.char_length(_digits(m)).between(10, 15),
}


def base_spans(text: Column) -> Column:
    """The spans of personal data: array of (start, kind as its place in KINDS, end), sorted."""
    none = F.array().cast(f"array<{SPAN}>")
    found = []
    for k, kind in enumerate(KINDS):
        make = lambda m, start, end: F.struct(start.alias("start"), F.lit(k).alias("kind"), end.alias("end"))  # noqa: B023, E731
        found.append(F.when(CAN[kind](text), _matches(text, PATTERNS[kind], COUNTS[kind], make, SPAN)).otherwise(none))
    return F.array_sort(F.concat(*found))


def _blanked(text: Column, base: Column) -> Column:
    """The text with blanks in place of the spans, so that positions stay."""

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(acc["at"], s["start"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, blank).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    blanked = F.aggregate(base, zero, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(base) > 0, blanked).otherwise(text)


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), ascii_lower))


def _group(s: Column, found: Column) -> Column:
    """The group that an entity of a kind belongs to."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    two = F.concat_ws(".", F.slice(F.split(found, r"\."), 1, 2))
    group = F.when(s["kind"] == 0, F.concat(F.lit("@"), F.lower(F.substring_index(found, "@", -1)))).when(s["kind"] == 1, two)
    return group.when(s["kind"] == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))


def _scan(documents: DataFrame) -> DataFrame:
    """One row a document, written to the shared folder: doc_id, hash, base spans, and, where there are any, the
    distinct entities (and their groups) and the distinct terms of the whole text outside them."""
    docs = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), base_spans(F.col("text")).alias("base"))
    found = lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
    entity = lambda s: F.concat_ws(":", s["kind"].cast("string"), found(s))
    group = lambda s: F.concat_ws("~", s["kind"].cast("string"), _group(s, found(s)))
    holds = F.size("base") > 0
    entities = F.when(holds, F.array_distinct(F.concat(F.transform("base", entity), F.transform("base", group))))
    words = F.when(holds, _words(_blanked(F.col("text"), F.col("base"))))
    return materialise(docs.select("doc_id", "hash", "base", entities.alias("entities"), words.alias("words")), "pii")


def _small(df: DataFrame) -> DataFrame:
    """df, written; broadcast if it is no more than BROADCAST_ROWS."""
    df = materialise(df, "pii-small")
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _most(p: Column) -> Column:
    """The least P(e | t) that discloses e, by P(e)."""
    return F.pow(p, F.lit(1 - DISCLOSURE))


def disclosures(documents: DataFrame, scan: DataFrame) -> DataFrame:
    """Pairs (entity, term) in which the term gives the entity away, with their share of its information.

    Equal texts are counted once, with their number. A term can disclose no entity of a text if it stands in more
    documents than the text's commonest entity allows; so of each text only its rarer terms are paired with its entities."""
    total = float(scan.count())
    texts = scan.where("entities is not null").groupBy("hash").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    texts = materialise(texts, "pii-texts")
    each = texts.select("hash", "n", F.explode("entities").alias("entity"))
    p = F.col("df_entity") / F.lit(total)
    known = materialise(each.groupBy("entity").agg(F.sum("n").alias("df_entity")).where(F.col("df_entity") <= total / 2**LEAST_BITS), "pii-entities")
    # (df(t, e) + SMOOTH P) / (df(t) + SMOOTH) >= _most(P), and df(t, e) <= df(e)
    limit = (F.col("df_entity") + SMOOTH * p) / _most(p) - SMOOTH
    held = materialise(each.select("hash", "entity").join(known, "entity").groupBy("hash").agg(F.max(limit).alias("limit"), F.collect_list(F.struct("entity", "df_entity")).alias("known")), "pii-known")
    df = documents.select(F.explode(_words(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    most = held.agg(F.max("limit")).first()[0] or 0.0
    rare = materialise(df.where(F.col("df") <= most + 1e-9), "pii-terms")
    words = texts.select("hash", F.explode("words").alias("term")).join(rare, "term")
    words = words.groupBy("hash").agg(F.collect_list(F.struct("term", "df")).alias("rare"))
    both = texts.select("hash", "n").join(held, "hash").join(words, "hash")
    both = both.select("n", F.explode("known").alias("e"), F.filter("rare", lambda w: w["df"] <= F.col("limit") + 1e-9).alias("rare"))
    pairs = both.select("n", F.col("e.entity").alias("entity"), F.col("e.df_entity").alias("df_entity"), F.explode("rare").alias("w"))
    pairs = pairs.groupBy("entity", F.col("w.term").alias("term")).agg(F.sum("n").alias("both"), F.first("df_entity").alias("df_entity"), F.first("w.df").alias("df"))
    given = (F.col("both") + SMOOTH * p) / (F.col("df") + SMOOTH)
    share = 1 - F.log2(given) / F.log2(p)
    return pairs.select("entity", "term", "both", "df", "df_entity", share.alias("share")).where(F.col("share") >= DISCLOSURE - 1e-12)


def _occurrences(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """hash, terms: for each text that holds any of the terms outside personal data, all their (start, end), sorted.
    Few texts do, so these are found by their terms first, and their texts come by a join on the hash."""
    docs = documents.select(F.coalesce(F.col("text"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("hash"), "text")
    told = docs.select("hash", F.explode(_words(F.col("text"))).alias("term")).join(_small(terms), "term", "left_semi")
    told = _small(told.groupBy("hash").agg(F.collect_set("term").alias("told")))
    make = lambda m, start, end: F.struct(start.alias("start"), end.alias("end"))
    is_told = lambda m: F.array_contains("told", ascii_lower(m))
    spans = _matches(F.col("blanked"), TERM, is_told, make, "struct<start:int,end:int>")
    held = docs.join(told, "hash").dropDuplicates(["hash"])
    return held.select("hash", "told", _blanked(F.col("text"), base_spans(F.col("text"))).alias("blanked")).select("hash", spans.alias("terms")).where(F.size("terms") > 0)


def find(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: doc_id, hash of the text, base (spans of personal data), terms (spans of
    disclosing terms, as (start, end), none of them inside personal data)."""
    scan = _scan(documents)
    told = materialise(disclosures(documents, scan).select("term").distinct(), "pii-told")
    terms = _occurrences(documents, told)
    none = F.array().cast("array<struct<start:int,end:int>>")
    return scan.select("doc_id", "hash", "base").join(terms, "hash", "left").select("doc_id", "hash", "base", F.coalesce("terms", none).alias("terms"))


def _shown(kind: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", kind, start.cast("string"), end.cast("string"))


def _kind(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in (*KINDS, "term")]), k + 1)


def _all_spans() -> Column:
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), t["end"].alias("end")))
    return F.array_sort(F.concat("base", terms))


def report(documents: DataFrame) -> DataFrame:
    """A digest row for each row of documents; after the base kinds, spans has those of kind `term`."""
    one = lambda s: _shown(_kind(s["kind"]), s["start"], s["end"])
    found = find(documents)
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]  # noqa: B023
    joined = F.concat_ws(",", F.transform("base", one))
    return found.select("doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.transform(_all_spans(), one)).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(documents: DataFrame, remove_terms: bool = False) -> DataFrame:
    """doc_id and text, with personal data generalised to its kind in brackets and disclosing terms generalised to
    [term] or removed. Of overlapping spans the first decides, and the text of the others goes with it."""
    found = find(documents).where((F.size("base") > 0) | (F.size("terms") > 0)).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), _all_spans().alias("spans")).dropDuplicates(["_id", "_hash"])
    docs = documents.select("doc_id", "text")
    both = docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_hash"]), "left")

    def add(acc: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), _kind(s["kind"]), F.lit("]"))
        label = F.when(s["kind"] == len(KINDS), F.lit("")).otherwise(label) if remove_terms else label
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, label)).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans", zero, add, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    return both.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(clean).alias("text"))
