"""Contrast-aware clauses, their themes and sentiment, and the per-theme summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatim.functions.expr import bind, explode_rows, round_binary
from verbatim.functions.plugins import Encoder, PairScorer, Scorer
from verbatim.functions.sentiment import lexicon_scorer, sentiment_label, split_on_contrast
from verbatim.functions.text import strip, token_count
from verbatim.operators.keyword import KeywordIndex, add_keyword_labels
from verbatim.operators.rerank import METHOD, add_scored_candidates, rerank
from verbatim.operators.reshape import matching_long
from verbatim.operators.semantic import add_candidates, label_candidates, with_vectors
from verbatim.settings import KeywordSettings, SegmentSettings, SemanticSettings, SentimentSettings, SummarySettings

SEGMENTED_COLUMNS = [
    "ID", "TextColumn", "segment_index", "segment_text", "theme", "subtheme", "parent_theme", "sentiment_label",
    "compound",
]


def segment_long(long: DataFrame, settings: SegmentSettings = SegmentSettings()) -> DataFrame:
    """Clauses of long-form answers. Short clauses go; dismissed answers stay whole; indexes are dense from 0."""
    text = F.col("text")
    whole = F.array(text)
    empty = F.array().cast("array<string>")
    parts = split_on_contrast(text) if settings.detect_contrast else whole
    long_enough = F.coalesce(F.filter(parts, lambda s: token_count(s) >= settings.min_tokens), empty)
    fallback = F.when(text != "", whole).otherwise(empty) if settings.fallback_to_whole_text else empty
    clauses = bind(long_enough, lambda p: F.when(F.size(p) > 0, p).otherwise(fallback))
    dismissed = F.coalesce(~F.col("is_meaningful"), F.lit(False))
    chosen = F.when(dismissed, whole if settings.fallback_to_whole_text else empty).otherwise(clauses)
    kept = ["ID", "TextColumn", "text", "is_meaningful", "response_detail"]
    return explode_rows(long, kept, chosen, "segment_text", "segment_index").select(
        "ID", "TextColumn", "segment_index", "segment_text", F.col("text").alias("source_text"),
        token_count(F.col("segment_text")).alias("segment_tokens"), "is_meaningful", "response_detail",
    )


def build_segments(
    df: DataFrame, text_columns: Sequence[str], settings: SegmentSettings = SegmentSettings()
) -> DataFrame:
    return segment_long(matching_long(df, text_columns, carry=()), settings)


def add_segment_sentiment(
    segments: DataFrame, settings: SentimentSettings = SentimentSettings(), scorer: Scorer | None = None
) -> DataFrame:
    """Score each clause; dismissed ones get no score and the label ``No sentiment``."""
    score = scorer or lexicon_scorer()
    active = F.coalesce(F.col("is_meaningful"), F.lit(True))
    scored = segments.withColumn(
        "compound", F.when(active, score(F.when(active, F.coalesce(F.col("segment_text"), F.lit("")))))
    )
    label = sentiment_label(F.col("compound"), settings.positive_threshold, settings.negative_threshold)
    return scored.withColumn("sentiment_label", F.when(active, label).otherwise("No sentiment"))


def add_segment_keywords(
    segments: DataFrame, index: KeywordIndex, settings: KeywordSettings = KeywordSettings()
) -> DataFrame:
    labelled = add_keyword_labels(
        segments.withColumn("text", F.col("segment_text")), index, settings, segment_rules=True,
    )
    return labelled.drop("text")


def add_segment_semantic(
    segments: DataFrame,
    library: DataFrame,
    encoder: Encoder,
    settings: SemanticSettings = SemanticSettings(),
    pair_scorer: PairScorer | None = None,
) -> DataFrame:
    """Similarity themes per clause, re-ranked where a pair scorer is given."""
    texts = segments.withColumn("text", F.col("segment_text"))
    if pair_scorer is None:
        found = add_candidates(
            with_vectors(texts, encoder), library, settings.similarity_threshold, settings.top_k,
            settings.sentiment_weight,
        )
        method, score = "semantic_similarity", "score"
    else:
        found = rerank(add_scored_candidates(texts, library, pair_scorer, encoder, settings), settings.top_k)
        method, score = METHOD, "ce_score"
    labelled = label_candidates(
        found, method, score, F.lit("below_threshold"), settings.delimiter, segment_rules=True
    )
    return labelled.drop("text", "vector")


def segmented_table(segment_results: DataFrame) -> DataFrame:
    """The compact clause table; columns that do not exist are left out."""
    return segment_results.select(*[c for c in SEGMENTED_COLUMNS if c in segment_results.columns])


def insight(net: Column, dominant: Column, base: Column, settings: SummarySettings = SummarySettings()) -> Column:
    """A sentence on how respondents feel about a theme."""
    s = settings
    mood = (
        F.when(dominant < s.min_majority_pct, "mixed/neutral on")
        .when(net.between(s.net_neutral_low, s.net_neutral_high), "mixed/neutral on")
        .when((net > s.net_neutral_high) & (net < s.net_slight), "slightly happy with")
        .when((net > s.net_neutral_high) & (net < s.net_strong), "happy with")
        .when(net > s.net_neutral_high, "very happy with")
        .when(net > -s.net_slight, "slightly unhappy with")
        .when(net > -s.net_strong, "unhappy with")
        .otherwise("very unhappy with")
    )
    return F.concat_ws(" ", F.lit("Users are"), mood, base)


SUMMARY_KEYS = ("TextColumn", "theme", "subtheme")


def segment_counts(segment_results: DataFrame) -> DataFrame:
    """Positive, negative and neutral clauses per (text column, theme, subtheme); counts of parts of a table add up."""
    theme = F.coalesce(F.col("theme"), F.lit(""))
    rows = segment_results.filter(F.coalesce(F.col("is_meaningful"), F.lit(True)) & (strip(theme) != ""))
    label = F.col("sentiment_label")
    return rows.groupBy(*SUMMARY_KEYS).agg(
        F.count_if(label == "Positive").alias("pos_count"),
        F.count_if(label == "Negative").alias("neg_count"),
        F.count_if(label == "Neutral").alias("neutral_count"),
    )


def segment_summary(segment_results: DataFrame, settings: SummarySettings = SummarySettings()) -> DataFrame:
    """Sentiment counts, shares and an insight per (text column, theme, subtheme).

    Dismissed clauses and clauses without a theme do not count, and ``No sentiment`` is in no total. Counts aggregate
    before the shuffle, so a theme with a third of all clauses is as cheap as a rare one.
    """
    return summary_of_counts(segment_counts(segment_results), settings)


def summary_of_counts(counts: DataFrame, settings: SummarySettings = SummarySettings()) -> DataFrame:
    """The summary's shares and insights for the counts of ``segment_counts``, added up over batches where there are several."""
    total = F.col("pos_count") + F.col("neg_count") + F.col("neutral_count")

    def share(n: Column) -> Column:
        return F.when(total > 0, n / total).otherwise(0.0)

    pos, neg, neutral = share(F.col("pos_count")), share(F.col("neg_count")), share(F.col("neutral_count"))
    net = share(F.col("pos_count") - F.col("neg_count"))
    dominant = F.greatest(pos, neg)
    base = F.when(F.coalesce(F.col("subtheme"), F.lit("")) != "", F.col("subtheme")).otherwise(F.col("theme"))
    return counts.select(
        "TextColumn", "theme", "subtheme", total.alias("total_segments"), "pos_count", "neg_count", "neutral_count",
        round_binary(pos, 3).alias("pos_pct"), round_binary(neg, 3).alias("neg_pct"), round_binary(neutral, 3).alias("neutral_pct"),
        round_binary(net, 3).alias("net_score"), round_binary(dominant, 3).alias("dominant_pct"),
        insight(net, dominant, base, settings).alias("insight"),
    )
