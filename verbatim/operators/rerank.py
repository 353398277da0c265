"""Re-ranking of similarity candidates by a pair scorer. Candidates stay in their row: no shuffle."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatim.functions.expr import compute_once, explode_rows
from verbatim.functions.plugins import Encoder, PairScorer
from verbatim.operators import assignments as out
from verbatim.operators.semantic import add_candidates, label_candidates, with_vectors
from verbatim.settings import SemanticSettings

METHOD = "semantic_cross_encoder"


def format_template(template: str, values: dict[str, Column]) -> Column:
    """A ``{name}`` template as a concatenation of columns."""
    parts: list[Column] = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(values[name], F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def pair_text(candidate: Column, template: str) -> Column:
    values = {
        "phrase": candidate["matched_phrase"], "theme": candidate["theme"], "subtheme": candidate["subtheme"],
        "parent_theme": candidate["parent_theme"],
    }
    if template:
        return format_template(template, values)
    pair = F.concat_ws(" | ", candidate["theme"], candidate["subtheme"])
    return F.when(candidate["matched_phrase"] != "", candidate["matched_phrase"]).otherwise(pair)


def add_pair_scores(df: DataFrame, scorer: PairScorer, template: str = "{phrase}") -> DataFrame:
    """Add ``ce_score`` to each candidate."""
    pairs = F.transform(F.col("candidates"), lambda c: pair_text(c, template))
    scored = df.withColumn("_scores", scorer(F.coalesce(F.col("text"), F.lit("")), pairs))
    with_score = F.zip_with("candidates", "_scores", lambda c, s: c.withField("ce_score", s.cast("double")))
    return compute_once(scored, "candidates", with_score).drop("_scores")


def rerank(df: DataFrame, top_k: int) -> DataFrame:
    """Keep the best ``top_k`` candidates by pair score; equal scores keep their similarity order."""
    keyed = F.transform(
        F.col("candidates"), lambda c, i: F.struct((-c["ce_score"]).alias("neg"), i.alias("i"), c.alias("c"))
    )
    return df.withColumn("candidates", F.transform(F.slice(F.array_sort(keyed), 1, top_k), lambda k: k["c"]))


def add_scored_candidates(
    long: DataFrame,
    library: DataFrame,
    scorer: PairScorer,
    encoder: Encoder | None = None,
    settings: SemanticSettings = SemanticSettings(),
) -> DataFrame:
    matched = add_candidates(
        with_vectors(long, encoder), library, settings.bi_threshold, settings.bi_top_k, settings.sentiment_weight
    )
    return add_pair_scores(matched, scorer, settings.pair_template)


def candidate_table(
    long: DataFrame, library: DataFrame, encoder: Encoder | None = None, settings: SemanticSettings = SemanticSettings()
) -> DataFrame:
    """The candidates before re-ranking, best first: one row per answer and candidate; dismissed answers have none."""
    found = add_candidates(
        with_vectors(long, encoder), library, settings.bi_threshold, settings.bi_top_k, settings.sentiment_weight
    ).filter(F.coalesce(F.col("is_meaningful"), F.lit(True)))
    each = explode_rows(found, ["ID", "TextColumn", "text"], F.col("candidates"), "c", "p")
    return each.select(
        "ID", "TextColumn", "text", (F.col("p") + 1).alias("rank"), "c.theme", "c.subtheme", "c.parent_theme",
        "c.matched_phrase", F.col("c.polarity").alias("polarity"), F.col("c.score").alias("score"),
    )


def candidate_scores(scored: DataFrame) -> DataFrame:
    """One row per candidate with its similarity and pair score; dismissed answers have none."""
    return (
        scored.filter(F.coalesce(F.col("is_meaningful"), F.lit(True)))
        .select("ID", "TextColumn", "text", F.explode("candidates").alias("c"))
        .select(
            "ID", "TextColumn", "text", "c.theme", "c.subtheme", "c.parent_theme", "c.matched_phrase",
            F.col("c.score").alias("bi_score"), F.col("c.ce_score").alias("ce_score"),
        )
    )


def assign_reranked(
    long: DataFrame,
    library: DataFrame,
    scorer: PairScorer,
    encoder: Encoder | None = None,
    settings: SemanticSettings = SemanticSettings(),
) -> DataFrame:
    """The similarity + re-ranking assignment table."""
    ranked = rerank(add_scored_candidates(long, library, scorer, encoder, settings), settings.top_k)
    labelled = label_candidates(ranked, METHOD, "ce_score", F.lit("below_threshold"), settings.delimiter)
    return labelled.withColumn("is_meaningful", F.coalesce(F.col("is_meaningful"), F.lit(True))).select(*out.COLUMNS)
