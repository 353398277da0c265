"""Result tables: writing to one or two places, reading back for comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatim.operators.assignments import COLUMNS
from verbatim.operators.reports import COMPARED


def write_table(
    df: DataFrame, paths: Sequence[str], file_format: str = "csv", partition_by: Sequence[str] = ()
) -> None:
    """Write a result to each path, replacing what is there. A second target does not compute the result again."""
    if len(paths) > 1:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for path in paths:
            writer = df.write.mode("overwrite").partitionBy(*partition_by)
            if file_format == "csv":
                writer = writer.options(
                    header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
                )
            writer.format(file_format).save(path)
    finally:
        if len(paths) > 1:
            df.unpersist()


def read_assignments(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """Read an assignment table for comparison; columns it does not have are added as empty strings."""
    reader = spark.read.format(file_format)
    if file_format == "csv":
        reader = reader.options(header=True, quote='"', escape='"', multiLine=True)
    df = reader.load(path)
    if "TextColumn" not in df.columns:
        raise ValueError("an assignment table must have a TextColumn column")
    types = {"is_meaningful": "boolean", "rule_score": "double"}
    df = df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})
    for c in COMPARED:
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit(""))
    return df.select(*[c for c in COLUMNS if c in df.columns])
