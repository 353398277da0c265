"""Survey tables: reading, renaming, ids, default columns."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from verbatim import lexicons as lx


def null_na_spellings(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn the usual spellings of "not available" in string columns into nulls."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return df.withColumns({c: F.when(~F.col(c).isin(*lx.CSV_NA_VALUES), F.col(c)) for c in names})


def read_survey_csv(
    spark: SparkSession, path: str, schema: StructType | str, na_values: bool = True, multi_line: bool = True
) -> DataFrame:
    """Read a survey CSV with a declared schema. Quoted answers may hold line breaks.

    ``multi_line=False`` lets Spark split large files that have none; ``read_large_survey_csv`` splits files that have some.
    """
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return null_na_spellings(df) if na_values else df


def _numbered_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add each line's place in its block and the lines before it, in the block, whose quotes are odd in number."""
    block, line, odd_before = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column("block_id").to_numpy(zero_copy_only=False)
        odd = batch.column("odd").to_numpy(zero_copy_only=False).astype(np.int64)
        before, place = np.cumsum(odd) - odd, np.arange(len(odd))
        cuts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        starts = np.repeat(cuts, np.diff(np.append(cuts, len(odd))))
        before, place = before - before[starts], place - starts
        if blocks[0] == block:
            first = starts == 0
            before[first] += odd_before
            place[first] += line
        block, line, odd_before = blocks[-1], int(place[-1]) + 1, int(before[-1] + odd[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place), pa.array(before)], [*batch.schema.names, "line", "odd_before"])


def read_large_survey_csv(spark: SparkSession, path: str, schema: StructType | str, na_values: bool = True) -> DataFrame:
    """Read a survey CSV whose quoted answers may hold line breaks, a large file by as many tasks as it has blocks.

    A line lies inside a quoted answer if the lines before it in the file hold an odd number of quotes. Each block counts its
    lines with an odd number of quotes, the counts are summed up over a file's blocks (a row per block), and every line
    then knows where it lies. Lines that are a record pass on as they are; only the lines of broken records are
    shuffled, to meet by the number of odd lines before them. Quotes inside an answer are doubled; one that is never closed
    takes the rest of its file, as in any reader. Blank lines between records are skipped.
    """
    lines = spark.read.format("text").option("lineSep", "\n").load(path)
    block = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.select(
        "value",
        F.xxhash64(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        block.alias("block_id"),
        (quotes % 2).cast("int").alias("odd"),
    )
    blocks = lines.groupBy("file", "start", "block_id").agg(F.sum("odd").alias("odd_lines"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block_id", F.coalesce(F.sum("odd_lines").over(earlier), F.lit(0)).alias("odd_in_file"))
    kinds = "value string, file bigint, start bigint, block_id bigint, odd int, line bigint, odd_before bigint"
    placed = lines.mapInArrow(_numbered_lines, kinds).join(F.broadcast(blocks), "block_id")
    placed = placed.withColumn("before", F.col("odd_in_file") + F.col("odd_before"))
    header = (F.col("start") == 0) & (F.col("line") == 0)
    whole = (F.col("before") % 2 == 0) & (F.col("odd") == 0)
    single = placed.filter(whole & ~header).select("value")
    broken = placed.filter(~whole).withColumn("record", F.floor(F.col("before") / 2))
    parts = F.sort_array(F.collect_list(F.struct("start", "line", "value")))
    joined = broken.groupBy("file", "record").agg(parts.alias("parts"), F.max(header).alias("header")).filter(~F.col("header"))
    joined = joined.select(F.array_join(F.col("parts.value"), "\n").alias("value"))
    records = single.unionByName(joined).select(F.regexp_replace("value", "\r$", "").alias("value")).filter("value <> ''")
    fields = F.from_csv("value", schema if isinstance(schema, str) else schema.simpleString()[7:-1], CSV_OPTIONS)
    df = records.select(fields.alias("r")).select("r.*")
    return null_na_spellings(df) if na_values else df


CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def read_survey(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Read a survey table from a columnar format, or from the catalog with ``file_format="table"``."""
    return spark.read.table(path) if file_format == "table" else spark.read.format(file_format).load(path)


def rename_headers(df: DataFrame, column_map: Mapping[str, str]) -> DataFrame:
    """Rename raw headers. Several raw headers may name one column: the first answer that is not null counts."""
    targets: dict[str, list[str]] = {}
    for raw, target in column_map.items():
        if raw in df.columns and target:
            targets.setdefault(target, []).append(raw)
    used = {raw for raws in targets.values() for raw in raws}
    columns = []
    for c in df.columns:
        if c in targets and c not in used:
            continue
        if c not in used:
            columns.append(F.col(f"`{c}`"))
            continue
        target = next(t for t, raws in targets.items() if c in raws)
        if targets[target][0] == c:
            columns.append(F.coalesce(*[F.col(f"`{r}`") for r in targets[target]]).alias(target))
    return df.select(*columns)


def ensure_id(df: DataFrame, id_col: str = "ID") -> DataFrame:
    """Keep the id column; without one, add a unique number. It follows the read order but has gaps."""
    return df if id_col in df.columns else df.withColumn(id_col, F.monotonically_increasing_id())


def choose_text_columns(df: DataFrame, id_col: str | None = None) -> tuple[DataFrame, list[str]]:
    """Rename the chosen id column to ``ID`` and propose the text columns: the string ones, else all others."""
    renamed = df.withColumnRenamed(id_col, "ID") if id_col and id_col != "ID" else df
    strings = [f.name for f in renamed.schema.fields if isinstance(f.dataType, StringType) and f.name != "ID"]
    return renamed, strings or [c for c in renamed.columns if c != "ID"]


def sample_survey(spark: SparkSession, rows: int = 12, columns: int = 3) -> DataFrame:
    """A generated survey for trying things out."""
    names = [f"Free_Text_{k}" for k in range(1, columns + 1)]
    number = (F.col("id") + 1).cast("string")
    return spark.range(rows).select(
        *[F.concat(F.lit("Sample response "), number, F.lit(f" for {n}")).alias(n) for n in names]
    )


#: Rows that one task of a spread input takes at most, on average.
ROWS_PER_TASK = 100_000


def spread(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Spread a small, unsplittable input before row-wise work that costs far more than the shuffle.

    The number of tasks is that of the cores or a multiple, which grows with the rows, so a task's time does not: narrow rows
    compress so well that one file split can hold millions of them. An input with that many partitions already passes through
    unchanged. Rows are counted first, which for Parquet reads the footers only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = cores * max(1, -(-df.count() // (cores * rows_per_task)))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
