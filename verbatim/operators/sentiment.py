"""Sentiment per column, combined per response."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatim.functions.expr import compute_all
from verbatim.functions.plugins import Scorer
from verbatim.functions.sentiment import clause_weighted, detect_coping, lexicon_scorer, sentiment_label, split_on_contrast
from verbatim.functions.text import is_blank
from verbatim.settings import SentimentSettings


def sentiment_weights(columns: Sequence[str], configured: Mapping[str, float] | None) -> dict[str, float]:
    """The configured weights of the active columns, else equal weights."""
    active = {c: float(configured[c]) for c in columns if configured and c in configured}
    return active or {c: 1.0 / len(columns) for c in columns}


def normalised_weights(weights: Mapping[str, float]) -> dict[str, float]:
    """User weights scaled to sum to one; none where they sum to nothing."""
    total = sum(weights.values())
    return {c: w / total for c, w in weights.items()} if total > 0 else {}


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def _coping_flag(df: DataFrame, text_columns: Sequence[str]) -> Column:
    mentions = [detect_coping(F.col(c)) for c in text_columns if c in df.columns]
    return F.when(reduce(lambda a, b: a | b, mentions, F.lit(False)), "Coping")


def combine_scores(df: DataFrame, text_columns: Sequence[str], settings: SentimentSettings) -> DataFrame:
    """``compound`` and ``sentiment_label`` from the ``compound_<column>`` scores.

    Weights count only where a column has a score, and a column without a weight weighs nothing. Without any weights,
    all columns weigh the same.
    """
    weights = sentiment_weights(text_columns, settings.column_weights)
    score = {c: F.col(f"compound_{c}") for c in text_columns}
    used = [F.when(score[c].isNotNull(), float(weights.get(c, 0.0))).otherwise(0.0) for c in text_columns]
    weighted = [F.coalesce(score[c] * float(weights.get(c, 0.0)), F.lit(0.0)) for c in text_columns]
    total = _sum(used)
    nothing = F.lit(settings.dismissed_value).cast("double")
    staged = df.withColumn("compound", F.when(total > 0, _sum(weighted) / total).otherwise(nothing))
    label = sentiment_label(F.col("compound"), settings.positive_threshold, settings.negative_threshold)
    none_label = "No sentiment" if settings.skip_dismissed else "Neutral"
    return staged.withColumn("sentiment_label", F.when(total > 0, label).otherwise(none_label))


def add_sentiment(
    df: DataFrame,
    text_columns: Sequence[str],
    settings: SentimentSettings = SentimentSettings(),
    scorer: Scorer | None = None,
) -> DataFrame:
    """Add ``compound``, ``sentiment_label``, ``coping_flag`` and ``compound_<column>``, from the raw answers.

    Answers that are dismissed or blank reach the scorer as null. Coping looks at all answers, dismissed ones included.
    """
    score = scorer or lexicon_scorer()
    scores = {}
    for c in text_columns:
        flag = F.coalesce(F.col(f"{c}_is_meaningful"), F.lit(True)) if f"{c}_is_meaningful" in df.columns else F.lit(True)
        active = (flag if settings.skip_dismissed else F.lit(True)) & ~is_blank(F.col(c))
        scores[f"compound_{c}"] = F.when(active, score(F.when(active, F.col(c))))
    staged = compute_all(df, {**scores, "coping_flag": _coping_flag(df, text_columns)})
    staged = combine_scores(staged, text_columns, settings)
    kept = [c for c in df.columns if c not in scores]
    return staged.select(*kept, "compound", "sentiment_label", "coping_flag", *scores)


def aggregate_by_id(
    df: DataFrame, text_columns: Sequence[str], weights: Mapping[str, float] | None = None
) -> DataFrame:
    """The fixed-weight combination: missing scores count as zero instead of freeing their weight."""
    shares = normalised_weights(weights or {c: 1.0 / len(text_columns) for c in text_columns})
    parts = [
        F.coalesce(F.col(f"compound_{c}"), F.lit(0.0)) * shares.get(c, 0.0)
        for c in text_columns
        if f"compound_{c}" in df.columns
    ]
    staged = df.withColumn("compound", _sum(parts))
    return staged.withColumn("sentiment_label", sentiment_label(F.col("compound"))).withColumn(
        "coping_flag", _coping_flag(df, text_columns)
    )


def clause_compound(text: Column, scorer: Scorer | None = None, list_scorer: Scorer | None = None) -> Column:
    """Clause-aware score of a text: later clauses weigh more; an empty text scores 0.

    ``scorer`` is an expression over one clause. A model, which cannot run inside a lambda, comes as ``list_scorer``
    (``plugins.model_list_scorer``) and sees the clauses of many rows at once; nothing is exploded or shuffled.
    """
    clauses = split_on_contrast(text)
    empty = text.isNull() | (text == "")
    if list_scorer is not None:
        # The model runs outside of the condition, and on no clause of an empty text.
        scores = list_scorer(F.when(~empty, clauses))
    else:
        scores = F.transform(clauses, scorer or lexicon_scorer())
    return F.when(empty, 0.0).otherwise(clause_weighted(scores))


def sentiment_by_id(df: DataFrame, text_columns: Sequence[str]) -> DataFrame:
    """The per-response sentiment output; columns that do not exist are left out."""
    wanted = ["ID", "compound", "sentiment_label", "coping_flag", *[f"compound_{c}" for c in text_columns]]
    return df.select(*[c for c in wanted if c in df.columns])


def sentiment_distribution(df: DataFrame) -> DataFrame:
    return (
        df.filter(F.col("sentiment_label").isNotNull())
        .groupBy("sentiment_label")
        .agg(F.count(F.lit(1)).alias("count"))
    )
