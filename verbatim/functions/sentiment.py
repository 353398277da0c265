"""Clause splitting, coping mentions, sentiment labels and the deterministic lexicon scorer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatim import lexicons as lx
from verbatim.functions.expr import among, bind, split_at
from verbatim.functions.patterns import WORD, any_term
from verbatim.functions.text import strip

CONTRAST = any_term(lx.CONTRAST_MARKERS)
COPING = any_term(lx.COPING_TERMS)
NEGATION = any_term(lx.NEGATION_TERMS)
_MARK = "\x1f"


def has_contrast(c: Column) -> Column:
    return F.coalesce(c.rlike(CONTRAST), F.lit(False))


def split_on_contrast(c: Column) -> Column:
    """Clauses between contrast markers, trimmed and non-blank; the whole text where none is left."""
    # As in split_at; no contrast marker is a control character, so texts that hold this one are split by the pattern itself.
    marked = F.split(F.regexp_replace(c, CONTRAST, _MARK), _MARK)
    parts = F.when(F.contains(c, F.lit(_MARK)), F.split(c, CONTRAST)).otherwise(marked)
    clauses = F.array_remove(F.transform(parts, strip), "")
    return bind(clauses, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(c)))


def detect_coping(c: Column) -> Column:
    """A coping mention in a text without any negation."""
    return F.coalesce(c.rlike(COPING) & ~c.rlike(NEGATION), F.lit(False))


def sentiment_label(compound: Column, positive: float = 0.05, negative: float = -0.05) -> Column:
    return F.when(compound >= positive, "Positive").when(compound <= negative, "Negative").otherwise("Neutral")


def sentiment_aligns(label: Column, polarity: Column) -> Column:
    return F.coalesce(
        (polarity == "Either") | (polarity.isin("Positive", "Negative") & (label == polarity)), F.lit(False)
    )


def normalise_class_label(label: Column, index: Column) -> Column:
    """A classifier's class name as Positive / Negative / Neutral; by position where the name says nothing."""
    name = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(F.contains(name, F.lit("neg")), "Negative")
        .when(F.contains(name, F.lit("pos")), "Positive")
        .when(F.contains(name, F.lit("neu")), "Neutral")
        .when(index == 0, "Negative")
        .when(index == 2, "Positive")
        .otherwise("Neutral")
    )


def words(c: Column) -> Column:
    """Lower-case words for lexicon lookups."""
    return split_at(F.lower(F.coalesce(c, F.lit(""))), f"[^{WORD}]+")


def _mood_words(c: Column, positive: list[str], negative: list[str]) -> Column:
    """The words of a text that are in a list; few are, so what follows has little to count."""
    return F.filter(words(c), lambda t: among(t, sorted({*positive, *negative})))


def lexicon_probs(
    c: Column, positive: Iterable[str] = lx.POSITIVE_WORDS, negative: Iterable[str] = lx.NEGATIVE_WORDS
) -> Column:
    """Class probabilities ``struct<neg, neu, pos>`` from word counts, with one pseudo-count for neutral."""
    pos_list, neg_list = list(positive), list(negative)

    def count(found: Column, terms: list[str]) -> Column:
        return F.size(F.filter(found, lambda t: among(t, terms))).cast("double")

    def shares(n: Column) -> Column:
        total = n["pos"] + n["neg"] + 1.0
        return F.struct((n["neg"] / total).alias("neg"), (F.lit(1.0) / total).alias("neu"), (n["pos"] / total).alias("pos"))

    counts = bind(_mood_words(c, pos_list, neg_list), lambda w: F.struct(count(w, pos_list).alias("pos"), count(w, neg_list).alias("neg")))
    return bind(counts, shares)


def lexicon_scorer(
    positive: Iterable[str] = lx.POSITIVE_WORDS, negative: Iterable[str] = lx.NEGATIVE_WORDS
):
    """The built-in scorer: positive minus negative probability, in one pass over the words."""
    pos_list, neg_list = list(positive), list(negative)

    def score(c: Column) -> Column:
        def step(acc: Column, t: Column) -> Column:
            return F.struct(
                (acc["p"] + among(t, pos_list).cast("double")).alias("p"),
                (acc["n"] + among(t, neg_list).cast("double")).alias("n"),
            )

        zero = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"))
        return F.aggregate(_mood_words(c, pos_list, neg_list), zero, step, lambda a: (a["p"] - a["n"]) / (a["p"] + a["n"] + 1.0))

    return score


def clause_weighted(scores: Column) -> Column:
    """Mean of clause scores with weights rising evenly from 0.2 to 0.8; a single clause keeps its own score."""


    def combine(s: Column) -> Column:
        steps = F.greatest(F.size(s) - 1, F.lit(1))
        weights = F.transform(s, lambda _, i: 0.2 + 0.6 * i / steps)
        total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
        weighted = F.aggregate(F.zip_with(s, weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
        return weighted / total

    return bind(scores, combine)
