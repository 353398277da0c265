"""Quality flags and data audits over wide survey tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatim.functions.expr import round_binary
from verbatim import lexicons as lx
from verbatim.functions.quality import DETAILED, response_detail
from verbatim.functions.text import preprocess, strip
from verbatim.settings import QualitySettings, TextSettings
from verbatim.sources.dictionary import TextDictionary


def preprocess_columns(
    df: DataFrame,
    text_columns: Sequence[str],
    dictionary: TextDictionary,
    settings: TextSettings = TextSettings(),
) -> DataFrame:
    """Add ``<column>_processed`` for each text column that exists."""
    return df.withColumns(
        {f"{c}_processed": preprocess(F.col(c), dictionary, settings) for c in text_columns if c in df.columns}
    )


def add_quality_flags(
    df: DataFrame, text_columns: Sequence[str], settings: QualitySettings = QualitySettings()
) -> DataFrame:
    """Add ``<column>_is_meaningful`` and ``<column>_response_detail``."""
    lo, hi = settings.min_meaningful_length, settings.max_dismissive_length
    present = [c for c in text_columns if c in df.columns]
    details = {c + settings.detail_suffix: response_detail(F.col(c).cast("string"), lo, hi) for c in present}
    # An answer is meaningful exactly if its class is "detailed", so the test runs once per answer.
    flags = {c + settings.meaningful_suffix: F.col(c + settings.detail_suffix) == DETAILED for c in present}
    ordered = [c + s for c in present for s in (settings.meaningful_suffix, settings.detail_suffix)]
    kept = [c for c in df.columns if c not in ordered]
    return df.withColumns(details).withColumns(flags).select(*kept, *ordered)


def _long(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    """One row per (row, column) holding one value; narrow, so it fuses into the partial aggregate above it."""
    entries = [F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def quality_report(
    df: DataFrame, text_columns: Sequence[str], settings: QualitySettings = QualitySettings()
) -> DataFrame:
    """Count per (column, response detail)."""
    present = [c for c in text_columns if c in df.columns]
    lo, hi = settings.min_meaningful_length, settings.max_dismissive_length
    return (
        _long(df, present, lambda c: F.col(c).cast("string"))
        .select("column", response_detail(F.col("value"), lo, hi).alias("response_detail"))
        .groupBy("column", "response_detail")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def null_text_details(
    df: DataFrame,
    text_columns: Sequence[str],
    id_col: str = "ID",
    settings: QualitySettings = QualitySettings(),
) -> DataFrame:
    """Dismissed answers in long form; expects the quality flags."""
    flagged = [c for c in text_columns if c + settings.meaningful_suffix in df.columns]
    entries = [
        F.struct(
            F.lit(c).alias("TextColumn"),
            (F.col(c).cast("string") if c in df.columns else F.lit("")).alias("text"),
            F.col(c + settings.detail_suffix).alias("response_detail"),
            F.col(c + settings.meaningful_suffix).alias("is_meaningful"),
        )
        for c in flagged
    ]
    return (
        df.select(F.col(id_col).alias("ID"), F.explode(F.array(*entries)).alias("_e"))
        .select("ID", "_e.*")
        .filter(~F.col("is_meaningful"))
    )


def _one_pass(df: DataFrame, text_columns: Sequence[str], measures) -> DataFrame:
    """Aggregate every column in one scan, then turn the single result row into one row per column."""
    aggregates = [F.count(F.lit(1)).alias("total_rows")]
    per_column = []
    for i, c in enumerate(text_columns):
        named = measures(c)
        aggregates += [e.alias(f"m{i}_{n}") for n, e in named.items() if e is not None]
        per_column.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col("total_rows"),
                *[
                    (F.lit(None).cast("long") if e is None else F.col(f"m{i}_{n}").cast("long")).alias(n)
                    for n, e in named.items()
                ],
            )
        )
    return df.agg(*aggregates).select(F.explode(F.array(*per_column)).alias("_e")).select("_e.*")


def data_audit(df: DataFrame, text_columns: Sequence[str]) -> DataFrame:
    """Rows, nulls, blanks and ``no entry`` answers per column; columns that do not exist are reported as missing."""

    def measures(c: str) -> dict[str, Column | None]:
        names = ["null_count", "empty_or_whitespace", "no_entry_count"]
        if c not in df.columns:
            return dict.fromkeys(names)
        text = strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
        return dict(
            zip(names, [F.count_if(F.col(c).isNull()), F.count_if(text == ""),
                        F.count_if(F.lower(text) == lx.NO_ENTRY)], strict=True)
        )

    return _one_pass(df, text_columns, measures).select(
        "column",
        "total_rows",
        F.col("null_count").isNull().alias("missing_column"),
        "null_count",
        "empty_or_whitespace",
        F.when(
            F.col("null_count").isNotNull(), F.greatest(F.lit(0), F.col("empty_or_whitespace") - F.col("null_count"))
        ).alias("empty_only"),
        "no_entry_count",
    )


def data_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).cast("long").alias("columns"))


def null_summary(
    df: DataFrame, text_columns: Sequence[str], settings: QualitySettings = QualitySettings()
) -> DataFrame:
    """Meaningful and dismissed answers per column; expects the quality flags."""

    def measures(c: str) -> dict[str, Column | None]:
        flag = c + settings.meaningful_suffix
        known = c in df.columns and flag in df.columns
        return {"meaningful": F.count_if(F.col(flag)) if known else None}

    dismissed = F.col("total_rows") - F.col("meaningful")
    return _one_pass(df, text_columns, measures).select(
        F.col("column").alias("TextColumn"),
        "total_rows",
        "meaningful",
        dismissed.alias("dismissed"),
        F.when(F.col("total_rows") > 0, round_binary(dismissed / F.col("total_rows") * 100, 2)).alias("dismissed_pct"),
        F.concat(F.col("column"), F.lit(settings.detail_suffix)).alias("detail_column"),
    )


def detail_counts(
    df: DataFrame, text_columns: Sequence[str], settings: QualitySettings = QualitySettings()
) -> DataFrame:
    """Count per (text column, response detail) from the flag columns; nulls count as ``Unknown``."""
    flagged = [c for c in text_columns if c + settings.detail_suffix in df.columns]
    return (
        _long(df, flagged, lambda c: F.coalesce(F.col(c + settings.detail_suffix), F.lit("Unknown")))
        .groupBy(F.col("column").alias("TextColumn"), F.col("value").alias("response_detail"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def detail_pivot(
    df: DataFrame, text_columns: Sequence[str], settings: QualitySettings = QualitySettings()
) -> DataFrame:
    """Response detail by text column. The column names are known, so no extra pass looks for pivot values."""
    flagged = [c for c in text_columns if c + settings.detail_suffix in df.columns]
    return (
        detail_counts(df, flagged, settings)
        .groupBy("response_detail")
        .pivot("TextColumn", list(flagged))
        .agg(F.sum("count"))
        .na.fill(0)
    )
