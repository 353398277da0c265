"""The assignment row: the one output shape of all matching methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = [
    "ID", "TextColumn", "is_meaningful", "theme", "subtheme", "parent_theme", "rule_score", "expected_polarity",
    "match_method", "evidence", "reason",
]

LABEL_FIELDS = ["theme", "subtheme", "parent_theme", "rule_score", "expected_polarity", "match_method", "evidence"]


def join_field(matches: Column, name: str, delimiter: str, skip_blank: bool = False) -> Column:
    values = F.transform(matches, lambda m: m[name])
    if skip_blank:
        values = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return F.array_join(values, delimiter)


def mean_field(matches: Column, name: str) -> Column:
    """Mean in array order, so the result does not depend on how rows were distributed."""
    return F.aggregate(F.transform(matches, lambda m: m[name]), F.lit(0.0), lambda a, s: a + s) / F.size(matches)


def labels(
    df: DataFrame,
    matched: dict[str, Column],
    matches: Column,
    dismissed: Column,
    no_match_reason: Column,
    dismissed_detail: Column,
    dismissed_reason: Column,
) -> DataFrame:
    """Add the label columns: dismissed answers, answers without a match, and matched answers."""
    has_match = F.coalesce(F.size(matches) > 0, F.lit(False)) & ~dismissed
    fixed = {
        "theme": (F.lit("Brief response"), F.lit("")),
        "subtheme": (dismissed_detail, F.lit("")),
        "parent_theme": (F.lit("Brief response"), F.lit("")),
        "rule_score": (F.lit(0.0), F.lit(0.0)),
        "expected_polarity": (F.lit(""), F.lit("")),
        "match_method": (F.lit("dismissed"), F.lit("none")),
        "evidence": (F.lit(""), F.lit("")),
    }
    out = {
        name: F.when(has_match, matched[name]).when(dismissed, brief).otherwise(none)
        for name, (brief, none) in fixed.items()
    }
    out["reason"] = F.when(has_match, "matched").when(dismissed, dismissed_reason).otherwise(no_match_reason)
    return df.withColumns(out)
