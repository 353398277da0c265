"""Taxonomy files: flat phrase library, nested enriched library, keyword themes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from verbatim import lexicons as lx
from verbatim.operators.keyword import KeywordIndex
from verbatim.operators.taxonomy import enriched_document, flatten_nested, number_phrases, themes_document
from verbatim.sources.files import read_yaml, write_text, write_yaml
from verbatim.sources.survey import null_na_spellings

LIBRARY_SCHEMA = StructType([StructField(c, StringType()) for c in lx.LIBRARY_COLUMNS])

SUBTHEME_TYPE = "struct<name: string, keywords_phrases: array<string>, default_polarity: string>"
PARENTS_TYPE = (
    f"array<struct<parent_name: string, themes: array<struct<theme_name: string, subthemes: array<{SUBTHEME_TYPE}>>>>>"
)
NESTED_SCHEMA = (
    "metadata struct<schema_version: string, description: string, generated_from: string, columns: array<string>>, "
    f"column_libraries map<string, struct<description: string, parents: {PARENTS_TYPE}>>"
)


def read_phrase_library(spark: SparkSession, path: str) -> DataFrame:
    """Read the flat phrase library; unknown extra columns are not read."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    present = [c for c in lx.LIBRARY_COLUMNS if c in df.columns]
    return null_na_spellings(df.select(*present))


def explode_libraries(documents: DataFrame) -> DataFrame:
    """Nested documents (``NESTED_SCHEMA``) to one row per column library, in document order."""
    return documents.select(F.posexplode(F.map_entries("column_libraries")).alias("p0", "e")).select(
        "p0", F.col("e.key").alias("column"), F.col("e.value.description").alias("description"),
        F.col("e.value.parents").alias("parents"),
    )


def flatten_library(documents: DataFrame) -> DataFrame:
    """Nested documents to flat phrase rows with ``phrase_idx`` in document order."""
    libraries = explode_libraries(documents)
    flat = flatten_nested(libraries).join(F.broadcast(libraries.select("p0", "column")), "column")
    return number_phrases(flat, ["p0", "p1", "p2", "p3", "p4"]).select(
        "phrase_idx", "column", "parent", "theme", "subtheme", "polarity", "phrase"
    )


def read_enriched_library(spark: SparkSession, path: str) -> DataFrame:
    """Read an enriched library JSON into flat phrase rows with ``phrase_idx``."""
    return flatten_library(spark.read.schema(NESTED_SCHEMA).option("multiLine", True).json(path))


def write_enriched_library(nested: DataFrame, path: str) -> None:
    """Write the nested library as one JSON document, which is the form of a small library."""
    write_text(json.dumps(enriched_document(nested), indent=2, ensure_ascii=False), path)


LIBRARY_ROWS = (
    "column string, parent string, theme string, "
    "subthemes array<struct<name: string, keywords_phrases: array<string>, default_polarity: string>>"
)
THEME_ROWS = (
    "theme string, parent_theme string, subthemes array<struct<name: string, keywords_phrases: array<string>, "
    "likely_columns: array<string>, default_polarity: string>>"
)


def write_library_rows(subthemes: DataFrame, path: str) -> None:
    """Write the enriched library as JSON lines, a row per (column, parent, theme): written by tasks, at any size."""
    one = F.struct(F.col("subtheme").alias("name"), "keywords_phrases", "default_polarity")
    rows = subthemes.groupBy("column", "parent", "theme").agg(F.array_sort(F.collect_list(one)).alias("subthemes"))
    rows.write.mode("overwrite").json(path)


def read_library_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_library_rows``, one per subtheme."""
    rows = spark.read.schema(LIBRARY_ROWS).json(path)
    return rows.select("column", "parent", "theme", F.explode("subthemes").alias("s")).select(
        "column", "parent", "theme", F.col("s.name").alias("subtheme"), "s.keywords_phrases", "s.default_polarity"
    )


def write_theme_rows(themes: DataFrame, path: str) -> None:
    """Write the keyword themes as JSON lines, a row per theme."""
    one = F.struct(F.col("subtheme").alias("name"), "keywords_phrases", "likely_columns", "default_polarity")
    rows = themes.groupBy("theme", "parent_theme").agg(F.array_sort(F.collect_list(one)).alias("subthemes"))
    rows.write.mode("overwrite").json(path)


def read_theme_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``write_theme_rows``, one per (theme, subtheme)."""
    rows = spark.read.schema(THEME_ROWS).json(path)
    return rows.select("theme", "parent_theme", F.explode("subthemes").alias("s")).select(
        "theme", F.col("s.name").alias("subtheme"), "parent_theme", "s.keywords_phrases", "s.likely_columns", "s.default_polarity"
    )


def write_themes(themes: DataFrame, path: str) -> None:
    write_yaml(themes_document(themes), path)


def read_themes(path: str) -> KeywordIndex:
    """Read a themes file into a keyword index."""
    return KeywordIndex.from_themes(read_yaml(path))
