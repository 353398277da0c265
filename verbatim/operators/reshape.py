"""Wide survey tables to one row per (response, text column), without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verbatim.settings import QualitySettings


def _col_or_null(df: DataFrame, name: str, dtype: str) -> Column:
    return F.col(name).cast(dtype) if name in df.columns else F.lit(None).cast(dtype)


def _explode_columns(df: DataFrame, text_columns: Sequence[str], fields, carry: Sequence[str]) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("TextColumn"), *fields(c)) for c in text_columns]
    carried = [c for c in carry if c in df.columns]
    return df.select(*carried, F.explode(F.array(*entries)).alias("_e")).select(
        *[c for c in carried if c == "ID"], "_e.*", *[c for c in carried if c != "ID"]
    )


def response_long(
    df: DataFrame, text_columns: Sequence[str], id_col: str = "ID", quality: QualitySettings = QualitySettings()
) -> DataFrame:
    """Raw answers in long form with their quality flags and the response's sentiment."""
    present = [c for c in text_columns if c in df.columns]
    with_id = df if id_col == "ID" else df.withColumn("ID", F.col(id_col))

    def fields(c: str) -> list[Column]:
        return [
            F.col(c).cast("string").alias("text"),
            _col_or_null(df, c + quality.meaningful_suffix, "boolean").alias("is_meaningful"),
            _col_or_null(df, c + quality.detail_suffix, "string").alias("response_detail"),
        ]

    out = _explode_columns(with_id, present, fields, ["ID", "sentiment_label", "compound"])
    for name, dtype in (("sentiment_label", "string"), ("compound", "double")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(dtype))
    return out.select("ID", "TextColumn", "text", "is_meaningful", "response_detail", "sentiment_label", "compound")


def matching_long(
    df: DataFrame,
    text_columns: Sequence[str],
    carry: Sequence[str] = ("sentiment_label",),
    quality: QualitySettings = QualitySettings(),
) -> DataFrame:
    """Answers to match in long form: the processed text where there is one, else the raw text."""
    present = [c for c in text_columns if c in df.columns or f"{c}_processed" in df.columns]

    def fields(c: str) -> list[Column]:
        choices = [F.col(n).cast("string") for n in (f"{c}_processed", c) if n in df.columns]
        return [
            F.coalesce(*choices, F.lit("")).alias("text"),
            _col_or_null(df, c + quality.meaningful_suffix, "boolean").alias("is_meaningful"),
            _col_or_null(df, c + quality.detail_suffix, "string").alias("response_detail"),
        ]

    return _explode_columns(df, present, fields, ["ID", *carry])


def union_all(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """Union by column name, for instance of phrases from several passes."""
    out = first
    for df in rest:
        out = out.unionByName(df)
    return out


def row_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of a row's values in column-name order."""
    names = sorted(columns or df.columns)
    return F.sha2(F.to_json(F.struct(*[F.col(n) for n in names])), 256)


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, by: dict[str, Column] | None = None) -> DataFrame:
    """One order-independent fingerprint row per table, or per value of ``by``, usable as a result-cache key.

    Each row's values, as text with their lengths, go through MD5; two 52-bit parts of the digests are summed. Sums add up, so
    the fingerprint of a table is that of its parts (``combined_fingerprint``), and any engine with MD5 gets the same.
    """
    names = sorted(columns or df.columns)
    texts = [F.col(f"`{n}`").cast("string") for n in names]
    marked = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = F.md5(F.concat_ws("|", *marked).cast("binary"))
    parts = [F.conv(F.substring(digest, at, 13), 16, 10).cast("decimal(38,0)") for at in (1, 14)]
    groups = by or {}
    hashed = df.select(*[c.alias(n) for n, c in groups.items()], parts[0].alias("a"), parts[1].alias("b"))
    return hashed.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"), *[_modulo(F.sum(c)).alias(f"digest_{c}") for c in ("a", "b")]
    )


#: Digests are sums modulo this prime.
DIGEST_MODULUS = 2**61 - 1


def _modulo(total: Column) -> Column:
    return F.coalesce(total % F.lit(DIGEST_MODULUS), F.lit(0)).cast("bigint")


def combined_fingerprint(parts: DataFrame) -> DataFrame:
    """The fingerprint of a table from those of its parts."""
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    return parts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *[_modulo(total(c)).alias(c) for c in ("digest_a", "digest_b")])
