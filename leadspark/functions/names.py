"""Company names, slugs and cells. Unicode folding has no native form, so names go through one Arrow UDF."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadspark.cluster import ship

#: Legal forms, as words: stripped at either end, at the end only, at the start only, and glued to a name.
LEGAL_BOTH = ("trading llc", "private limited", "co ltd", "pvt ltd", "fz llc", "l l c", "s a s", "s r l", "b v", "n v", "s a", "incorporated", "corporation", "limited", "gmbh", "corp", "dmcc", "llc", "ltd", "inc", "pty", "pte", "fze", "co", "주식회사", "유한회사", "합자회사", "합명회사")
LEGAL_TRAILING = ("sanayi ve ticaret", "san ve tic", "anonim şirketi", "limited şirketi", "ltd şti", "a ş", "şti", "tbk", "aş", "tic", "llp", "pvt")
LEGAL_LEADING = ("pt", "cv")
LEGAL_GLUED = ("주식회사", "유한회사", "합자회사", "합명회사")
LEGAL_MARKS = ("（주）", "(주)", "㈜", "（유）", "(유)", "（사）", "(사)")
HANGUL = "[가-힣]"


def _bare(words: list[str], leading: tuple[str, ...], trailing: tuple[str, ...]) -> list[str]:
    """words without the forms at their ends, the longest first, until none stands there."""
    by_length = lambda forms: sorted((f.split() for f in forms), key=len, reverse=True)
    ends = [(f, False) for f in by_length(trailing)] + [(f, True) for f in by_length(leading)]
    while True:
        for form, at_start in ends:
            n = len(form)
            if at_start and words[:n] == form:
                words = words[n:]
                break
            if not at_start and words[-n:] == form:
                words = words[:-n]
                break
        else:
            return words


def _unglued(words: list[str]) -> list[str]:
    """words without a legal form that is written into the first or the last of them."""
    while words:
        first = next((f for f in LEGAL_GLUED if words[0].startswith(f) and words[0] != f), None)
        last = next((f for f in LEGAL_GLUED if words[-1].endswith(f) and words[-1] != f), None)
        if first:
            words = [words[0].removeprefix(first), *words[1:]]
        elif last:
            words = [*words[:-1], words[-1].removesuffix(last)]
        else:
            break
    return words


def fold_name(name: str | None) -> str | None:
    """NFKC, case-folded, without punctuation, legal forms and a "the" at the ends; NULL if nothing is left."""
    if name is None:
        return None
    text = unicodedata.normalize("NFKC", name)
    for mark in LEGAL_MARKS:
        text = text.replace(mark, " ")
    words = re.sub(r"[^\w\s]|_", " ", text.casefold().replace("i̇", "i")).split()
    leading, trailing = LEGAL_BOTH + LEGAL_LEADING, LEGAL_BOTH + LEGAL_TRAILING
    words = _bare(_unglued(_bare(words, leading, trailing)), leading, trailing)
    return " ".join(_bare(words, ("the",), ("the",))) or None


def normalize_name(name: Column) -> Column:
    """fold_name in Arrow batches."""
    ship(SparkSession.getActiveSession())

    def each(names: pd.Series) -> pd.Series:
        return names.map(fold_name, na_action="ignore")

    return F.pandas_udf(each, T.StringType())(name)


def match_key(normalized: Column) -> Column:
    """Spaces count only where no Hangul is in the name."""
    return F.when(normalized.rlike(HANGUL), F.replace(normalized, F.lit(" "), F.lit(""))).otherwise(normalized)


def slug(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(token)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def csv_safe(cell: Column) -> Column:
    """An apostrophe before what a spreadsheet would run: = + - @ tab or return, also after blanks."""
    return F.when(cell.rlike(r"^[ ]*[=+\-@\t\r＝＋－＠]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def blind_key(record_id: Column) -> Column:
    return F.sha2(record_id.cast("string").cast("binary"), 256)
