"""Dismissive-answer tests and the answer detail class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatim import lexicons as lx
from verbatim.functions.patterns import WS, outside, quote
from verbatim.functions.text import strip

# The exact answers and the patterns as one alternation, so the bare text is computed and scanned once.
_DISMISSIVE = (
    "^(?:"
    + "|".join([quote(t) for t in lx.NULL_EXACT] + [p.format(ws=f"[{WS}]", any="[^\\n]") for p in lx.NULL_PATTERNS])
    + ")\\z"
)


DETAILED = "Detailed response"


def is_null_text(c: Column, min_meaningful_length: int = 3, max_dismissive_length: int = 50) -> Column:
    """Whether an answer carries no information. The length gates come first: they are the cheap tests."""
    text = strip(c)
    lowered = F.lower(text)
    bare = strip(F.regexp_replace(lowered, outside(f"a-z0-9{WS}/"), ""))
    return (
        F.when(c.isNull(), True)
        .when(F.length(text) < max(min_meaningful_length, 1), True)
        .when(F.length(text) > max_dismissive_length, False)
        .when(lowered.isin(*lx.NULL_LITERALS), True)
        .otherwise(bare.rlike(_DISMISSIVE))
    )


def response_detail(c: Column, min_meaningful_length: int = 3, max_dismissive_length: int = 50) -> Column:
    """``Detailed response``, ``Yes``, ``No`` or ``No sentiment``; unclassified dismissals count as ``No``."""
    bare = F.regexp_replace(F.lower(strip(c)), outside(f"a-z0-9{WS}"), "")
    return (
        F.when(~is_null_text(c, min_meaningful_length, max_dismissive_length), DETAILED)
        .when(bare.isin(*lx.YES_RESPONSES), "Yes")
        .when(bare.isin(*lx.NO_RESPONSES), "No")
        .when(bare.isin(*lx.NO_SENTIMENT_RESPONSES), "No sentiment")
        .otherwise("No")
    )


def is_dismissive_short(c: Column) -> Column:
    """The small test used where no quality flag is supplied."""
    text = F.lower(strip(F.coalesce(c, F.lit(""))))
    return (F.length(text) <= 2) | text.isin(*lx.DISMISSIVE_SHORT)
