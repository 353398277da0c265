"""Comparison, dashboard and count reports over assignment tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatim.functions.expr import round_binary
from verbatim.functions.text import split_multi

COMPARED = ["theme", "subtheme", "parent_theme", "match_method", "evidence", "reason"]

DISPLAY_COLUMNS = [
    "ID", "TextColumn", "text", "theme", "subtheme", "parent_theme", "match_method", "rule_score", "sentiment_label",
    "compound", "response_detail",
]


def matched_unmatched(assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched and unmatched rows: by reason where there is one, else by method."""
    if "reason" in assignments.columns:
        matched = F.coalesce(F.col("reason") == "matched", F.lit(False))
    else:
        matched = F.coalesce(F.col("match_method") != "none", F.lit(True))
    return assignments.filter(matched), assignments.filter(~matched)


def compare_assignments(
    left: DataFrame, right: DataFrame, id_col: str = "ID", suffixes: tuple[str, str] = ("_keyword", "_semantic")
) -> DataFrame:
    """Full outer comparison of two assignment tables on (id, text column), with an agreement flag."""
    keys = [id_col, "TextColumn"]

    def prepared(df: DataFrame, suffix: str) -> DataFrame:
        for c in COMPARED:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(""))
        return df.select(*keys, *[F.col(c).alias(c + suffix) for c in df.columns if c not in keys])

    a, b = suffixes
    joined = prepared(left, a).join(prepared(right, b), keys, "full_outer")
    filled = joined.withColumns(
        {c + s: F.coalesce(F.col(c + s), F.lit("")) for c in ("theme", "subtheme") for s in suffixes}
    )
    same = (F.col("theme" + a) == F.col("theme" + b)) & (F.col("subtheme" + a) == F.col("subtheme" + b))
    return filled.withColumn("match", same)


def mismatches(comparison: DataFrame) -> DataFrame:
    return comparison.filter(~F.col("match"))


def agreement_totals(comparison: DataFrame) -> DataFrame:
    matches = F.count_if(F.col("match"))
    return comparison.agg(F.count(F.lit(1)).alias("total"), matches.alias("matches")).withColumn(
        "mismatches", F.col("total") - F.col("matches")
    )


def attach_text(assignments: DataFrame, responses: DataFrame) -> DataFrame:
    """Assignments with the answer's text and sentiment; columns on both sides get the suffixes ``_x`` and ``_y``."""
    keys = ["ID", "TextColumn"]
    shared = [c for c in assignments.columns if c in responses.columns and c not in keys]
    a = assignments.withColumnsRenamed({c: f"{c}_x" for c in shared})
    r = responses.withColumnsRenamed({c: f"{c}_y" for c in shared})
    return a.join(r, keys, "left")


@dataclass(frozen=True)
class ViewFilter:
    """The dashboard's filters; an empty one lets everything through."""

    text_columns: Sequence[str] = ()
    themes: Sequence[str] = ()
    subthemes: Sequence[str] = ()
    sentiments: Sequence[str] = ()
    methods: Sequence[str] = ()
    only_meaningful: bool = False
    search: str = ""
    delimiter: str = " | "


def filter_view(view: DataFrame, f: ViewFilter) -> DataFrame:
    """Apply the dashboard's filters; a filter on a column that does not exist is skipped."""

    def any_of(column: str, wanted: Sequence[str]) -> Column:
        return F.arrays_overlap(split_multi(F.col(column), f.delimiter), F.array(*[F.lit(w) for w in wanted]))

    conditions: list[Column] = []
    if f.text_columns:
        conditions.append(F.col("TextColumn").isin(*f.text_columns))
    if f.themes:
        conditions.append(any_of("theme", f.themes))
    if f.subthemes:
        conditions.append(any_of("subtheme", f.subthemes))
    if f.sentiments and "sentiment_label" in view.columns:
        conditions.append(F.col("sentiment_label").isin(*f.sentiments))
    if f.methods and "match_method" in view.columns:
        conditions.append(F.col("match_method").isin(*f.methods))
    if f.only_meaningful and "is_meaningful" in view.columns:
        conditions.append(F.col("is_meaningful"))
    if f.search:
        conditions.append(F.coalesce(F.col("text").rlike(f"(?iu){f.search}"), F.lit(False)))
    for c in conditions:
        view = view.filter(c)
    return view


def view_metrics(view: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, distinct responses and distinct theme strings of a view."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return view.agg(
        F.count(F.lit(1)).alias("rows"), distinct("ID").alias("unique_ids"), distinct("theme").alias("themes")
    )


def theme_counts(assignments: DataFrame, delimiter: str = " | ") -> DataFrame:
    """Answers per theme after splitting multi-labels, without brief responses."""
    exploded = assignments.select(F.explode(split_multi(F.col("theme"), delimiter)).alias("theme"))
    return (
        exploded.filter(F.lower("theme") != "brief response").groupBy("theme").agg(F.count(F.lit(1)).alias("count"))
    )


def top(counts: DataFrame, n: int, by: str = "count", tie: str = "theme") -> DataFrame:
    """The ``n`` largest rows; ties in name order. Each task keeps only its own best ``n``."""
    return counts.orderBy(F.desc(by), F.asc(tie)).limit(n)


def facet_values(view: DataFrame, column: str, delimiter: str | None = None) -> DataFrame:
    """Distinct values for a filter box; multi-label columns are split."""
    if delimiter is None:
        values = view.select(F.col(column).alias("value")).filter(F.col(column).isNotNull())
    else:
        values = view.select(F.explode(split_multi(F.col(column), delimiter)).alias("value"))
    return values.distinct().orderBy("value")


def all_facet_values(view: DataFrame, facets: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """``(facet, value)`` of several filter boxes in one pass: facet name to column and delimiter, if any."""

    def values(column: str, delimiter: str | None) -> Column:
        if delimiter is None:
            return F.array_compact(F.array(F.col(column).cast("string")))
        return split_multi(F.col(column), delimiter)

    def pairs_of(name: str, column: str, delimiter: str | None) -> Column:
        return F.transform(values(column, delimiter), lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))

    pairs = [pairs_of(name, c, d) for name, (c, d) in facets.items()]
    return view.select(F.explode(F.concat(*pairs)).alias("pair")).select("pair.*").distinct()


def match_metrics(assignments: DataFrame) -> DataFrame:
    """Headline numbers. Every method but ``none`` counts as matched, dismissed answers included."""
    method = F.col("match_method")
    matched = F.count_if(method != "none")
    return assignments.agg(
        F.count(F.lit(1)).alias("assignments"),
        round_binary(matched / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 2).alias("match_rate"),
        F.count_if(method == "dismissed").alias("dismissed"),
        F.count_if(method == "none").alias("unmatched"),
        F.avg(F.when(F.col("reason") == "matched", F.col("rule_score"))).alias("mean_matched_score"),
    )


def method_counts(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("match_method").agg(F.count(F.lit(1)).alias("count"))


def review_sheet(view: DataFrame) -> DataFrame:
    """The simplified sheet for manual review: the display columns that exist."""
    return view.select(*[c for c in DISPLAY_COLUMNS if c in view.columns])


def hybrid_merge(keyword: DataFrame, semantic: DataFrame, min_score: float = 0.70) -> DataFrame:
    """Keyword matches first, similarity matches for the remaining answers; weak matches count as none.

    The answers left over keep their keyword row.
    """
    keys = ["ID", "TextColumn"]
    fields = [c for c in keyword.columns if c not in keys]
    # Field by field, so that only the fields somebody reads are computed, shuffled and joined.
    found = (F.col("reason") == "matched") & (F.col("rule_score") >= min_score)
    fallback = semantic.filter(found).select(*keys, F.lit(True).alias("_found"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    joined = keyword.select(*keys, *fields).join(fallback, keys, "left")
    keyword_wins = (F.col("reason") != "no_match") & ((F.col("reason") != "matched") | (F.col("rule_score") >= min_score))
    kept = keyword_wins | F.col("_found").isNull()
    return joined.select(*keys, *[F.when(kept, F.col(f)).otherwise(F.col(f"_s_{f}")).alias(f) for f in fields])
