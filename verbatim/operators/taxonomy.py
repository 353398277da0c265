"""Taxonomy validation and building, and the flat, nested and keyword forms of a library.

The flat library is the scalable form. The nested forms hold a whole subtheme in one row, as their file formats do, so
they are built from distinct phrases.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatim import lexicons as lx
from verbatim.functions.text import is_blank, is_phrase, strip
from verbatim.operators.keyword import KeywordIndex
from verbatim.session import ensure_checkpoint_dir

KEYS = ["column", "parent", "theme", "subtheme"]


def validate_library(library: DataFrame, min_phrases: int = 2) -> DataFrame:
    """Issue rows ``(severity, check, detail, count)``; no row means nothing to report."""
    spark = library.sparkSession
    schema = "severity string, check string, detail string, count long"
    missing = [c for c in lx.LIBRARY_COLUMNS if c not in library.columns]
    if missing:
        return spark.createDataFrame([("error", "missing_columns", ", ".join(missing), len(missing))], schema)

    bad_polarity = ~F.lower(strip(F.coalesce("polarity", F.lit("nan")))).isin(*lx.ALLOWED_POLARITY)
    # One pass: distinct rows with their multiplicity, then everything from those.
    distinct = library.groupBy(*lx.LIBRARY_COLUMNS).agg(F.count(F.lit(1)).alias("n"))
    per_row = distinct.agg(
        *[F.sum(F.when(is_blank(F.col(c)), F.col("n")).otherwise(0)).alias(f"empty_{c}") for c in lx.LIBRARY_COLUMNS],
        F.sum(F.when(bad_polarity, F.col("n")).otherwise(0)).alias("polarity"),
        F.sum(F.col("n") - 1).alias("duplicates"),
    )

    def issue(severity: str, check: str, detail: str, count: Column) -> Column:
        return F.struct(
            F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.lit(detail).alias("detail"),
            F.coalesce(count, F.lit(0)).cast("long").alias("count"),
        )

    issues = [issue("error", "empty_values", c, F.col(f"empty_{c}")) for c in lx.LIBRARY_COLUMNS]
    issues.append(issue("warning", "polarity_outside_allowed", "polarity", F.col("polarity")))
    issues.append(issue("warning", "duplicate_rows", ", ".join(lx.LIBRARY_COLUMNS), F.col("duplicates")))
    row_issues = per_row.select(F.explode(F.array(*issues)).alias("_i")).select("_i.*")

    complete = distinct.dropna(subset=KEYS)
    sizes = complete.groupBy(*KEYS).agg(F.sum("n").alias("phrases")).filter(F.col("phrases") < min_phrases)
    low = sizes.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("warning").alias("severity"), F.lit("few_phrases").alias("check"),
        F.lit(f"fewer than {min_phrases}").alias("detail"), "count",
    )
    return row_issues.unionByName(low).filter(F.col("count") > 0)


def distinct_phrases(library: DataFrame) -> DataFrame:
    """Complete rows without repeats: the flat form of the enriched library."""
    return library.select(*KEYS, "phrase").dropna().distinct()


def enriched_subthemes(
    library: DataFrame, order: Column | None = None
) -> DataFrame:
    """One row per subtheme with its sorted distinct phrases and the polarity of its first row.

    ``order`` gives the row order that "first" refers to; without it, the order in which the rows were read.
    """
    ordered = library.withColumn("_order", order if order is not None else F.monotonically_increasing_id())
    complete = ordered.dropna(subset=[*KEYS, "phrase"])
    distinct = complete.groupBy(*KEYS, "phrase").agg(
        F.min(F.struct("_order", F.coalesce("polarity", F.lit("Either")).alias("polarity"))).alias("first")
    )
    return distinct.groupBy(*KEYS).agg(
        F.array_sort(F.collect_list("phrase")).alias("keywords_phrases"),
        F.min("first").getField("polarity").alias("default_polarity"),
    )


def nest_library(subthemes: DataFrame, descriptions: Mapping[str, str] = lx.COLUMN_DESCRIPTIONS) -> DataFrame:
    """One row per column: ``(column, description, parents[...])``, all levels in name order.

    A column that ``descriptions`` does not name gets a general one.
    """
    themes = subthemes.groupBy("column", "parent", "theme").agg(
        F.array_sort(
            F.collect_list(F.struct(F.col("subtheme").alias("name"), "keywords_phrases", "default_polarity"))
        ).alias("subthemes")
    )
    parents = themes.groupBy("column", "parent").agg(
        F.array_sort(F.collect_list(F.struct(F.col("theme").alias("theme_name"), "subthemes"))).alias("themes")
    )
    columns = parents.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct(F.col("parent").alias("parent_name"), "themes"))).alias("parents")
    )
    known = F.lit(None).cast("string")
    for name, text in descriptions.items():
        known = F.when(F.col("column") == name, text).otherwise(known)
    description = F.coalesce(known, F.concat(F.lit("Themes for "), F.col("column")))
    return columns.select("column", description.alias("description"), "parents")


def enriched_document(nested: DataFrame) -> dict[str, Any]:
    """The nested library as one JSON document: the form of a small library; a large one stays flat."""
    rows = nested.orderBy("column").toJSON().collect()
    libraries = [json.loads(r) for r in rows]
    return {
        "metadata": {
            "schema_version": lx.LIBRARY_SCHEMA_VERSION,
            "description": lx.LIBRARY_DESCRIPTION,
            "generated_from": lx.LIBRARY_SOURCE,
            "columns": [r["column"] for r in libraries],
        },
        "column_libraries": {r["column"]: {"description": r["description"], "parents": r["parents"]} for r in libraries},
    }


def flatten_nested(nested: DataFrame) -> DataFrame:
    """Nested rows back to one row per phrase, with the position in document order."""
    return (
        nested.select("column", F.posexplode("parents").alias("p1", "parent"))
        .select("column", "p1", "parent.parent_name", F.posexplode("parent.themes").alias("p2", "theme"))
        .select("column", "p1", "parent_name", "p2", "theme.theme_name",
                F.posexplode("theme.subthemes").alias("p3", "subtheme"))
        .select(
            "column", "p1", "p2", "p3", F.col("parent_name").alias("parent"), F.col("theme_name").alias("theme"),
            F.col("subtheme.name").alias("subtheme"), F.col("subtheme.default_polarity").alias("polarity"),
            F.posexplode("subtheme.keywords_phrases").alias("p4", "phrase"),
        )
    )


def number_phrases(flat: DataFrame, order: list[str]) -> DataFrame:
    """Add ``phrase_idx``, counting from 0 in the given order.

    Rows are dealt out by range, each range is numbered on its own, and the sizes of the ranges before it are added: one
    row per range is all that passes through one task. The ranges are checkpointed, as a second dealing could differ.
    """
    ensure_checkpoint_dir(flat.sparkSession)
    dealt = flat.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    numbered = dealt.join(sizes.select("_part", before.alias("_before")), "_part")
    return numbered.withColumn("phrase_idx", (own + F.col("_before")).cast("int")).drop("_part", "_before")


def _most_frequent(df: DataFrame, keys: list[str], value: str, default: str, name: str) -> DataFrame:
    """Most frequent non-null value per key, the smallest of equally frequent ones. Counts combine before shuffling."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = F.when(F.col(value).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(*keys).agg(F.coalesce(F.min(ranked)["v"], F.lit(default)).alias(name))


def keyword_themes(library: DataFrame) -> DataFrame:
    """One row per (theme, subtheme): parent and polarity by most frequent value, sorted phrases and columns.

    Equally frequent values: the smallest.
    """
    keys = ["theme", "subtheme"]
    parents = _most_frequent(library.filter(F.col("theme").isNotNull()), ["theme"], "parent", "", "parent_theme")
    complete = library.dropna(subset=keys)
    polarity = _most_frequent(complete, keys, "polarity", "Either", "default_polarity")

    def distinct_list(value: Column, name: str) -> DataFrame:
        values = complete.select(*keys, value.alias("v")).distinct()
        return values.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias(name))

    phrases = distinct_list(strip(F.col("phrase")), "keywords_phrases")
    columns = distinct_list(F.col("column"), "likely_columns")
    return polarity.join(phrases, keys).join(columns, keys).join(parents, "theme")


def themes_document(themes: DataFrame, max_subthemes: int = 100_000) -> dict[str, Any]:
    """Keyword themes as the document of a themes file."""
    rows = themes.orderBy("theme", "subtheme").limit(max_subthemes + 1).collect()
    if len(rows) > max_subthemes:
        raise ValueError(f"more than {max_subthemes} subthemes")
    out: dict[str, Any] = {}
    for r in rows:
        block = out.setdefault(r["theme"], {"parent_theme": r["parent_theme"], "subthemes": []})
        block["subthemes"].append(
            {
                "name": r["subtheme"], "keywords_phrases": list(r["keywords_phrases"]),
                "likely_columns": list(r["likely_columns"]), "default_polarity": r["default_polarity"],
            }
        )
    return {"themes": out}


def keyword_terms(index_table: DataFrame) -> DataFrame:
    """One row per keyword of an index table: position, kind and list order."""
    phrase = index_table.select(
        "subtheme_pos", "theme", "parent_theme", "subtheme", "polarity", "cols",
        F.lit("phrase").alias("kind"), F.posexplode("phrase_terms").alias("kw_pos", "term"),
    )
    token = index_table.select(
        "subtheme_pos", "theme", "parent_theme", "subtheme", "polarity", "cols",
        F.lit("token").alias("kind"), F.posexplode("token_terms").alias("kw_pos", "term"),
    )
    return phrase.unionByName(token)


def index_from_library(library: DataFrame) -> KeywordIndex:
    """A keyword index straight from a phrase library."""
    return KeywordIndex.from_themes(themes_document(keyword_themes(library)))


def classify_terms(phrases: DataFrame, column: str = "phrase") -> DataFrame:
    return phrases.withColumn("is_phrase", is_phrase(F.col(column)))
