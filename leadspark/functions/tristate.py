"""Unknown, verified negative and inapplicable as three states: NULL is unknown, FALSE or [] verified, a flag column says inapplicable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known_text(value: Column) -> Column:
    """NULL for absent, blank or `unknown`, whatever its case; else the trimmed text."""
    text = F.trim(value)
    return F.when((text != "") & (F.lower(text) != "unknown"), text)


def tri_state(value: Column) -> Column:
    """Nullable boolean of a text: true, yes, 1 / false, no, 0; all else unknown."""
    text = F.lower(F.trim(value))
    return F.when(text.isin("true", "yes", "1"), F.lit(True)).when(text.isin("false", "no", "0"), F.lit(False))


def outcome(applies: Column, holds: Column) -> Column:
    """na, pass, fail or skip of a rule: skipped where the predicate is unknown; an unknown never fails."""
    return F.when(~F.coalesce(applies, F.lit(False)), "na").when(holds.isNull(), "skip").when(holds, "pass").otherwise("fail")


def confidence_band(confidence: Column, high: float = 0.75, medium: float = 0.5) -> Column:
    return F.when(confidence >= high, "HIGH").when(confidence >= medium, "MEDIUM").when(confidence.isNotNull(), "LOW")


def flip(before: Column, after: Column) -> Column:
    """How a nullable flag changed: gained, lost, undetermined, or NULL where it did not."""
    same = before.eqNullSafe(after)
    return F.when(same, None).when(before.isNull() | after.isNull(), "undetermined").when(after, "gained").otherwise("lost")
