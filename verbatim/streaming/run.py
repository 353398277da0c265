"""Run the row-level part of a job on a stream of responses.

Normalising, flagging, scoring and exact matching look at one response at a time and keep no state, so a stream needs no
watermark: every micro-batch appends its own rows.

Counts are taken per micro-batch and add up. ``append_batches`` writes the tables of each batch to a folder of its own number, so
a batch that is run again after a failure replaces what it wrote; ``batch_results`` and ``added_up`` read them as one. The only
state is what ``distinct_responses`` keeps: the ids seen within the watermark. Whatever collapses equal texts (fuzzy matching)
works on batches as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from verbatim.plans.job import SurveyJob


def read_responses(
    spark: SparkSession, path: str, schema: StructType, file_format: str = "parquet", files_per_batch: int = 100
) -> DataFrame:
    """Watch a folder of response files; the schema is declared, not inferred."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(file_format).load(path)
    )


def append_stream(df: DataFrame, path: str, checkpoint: str, file_format: str = "parquet") -> StreamingQuery:
    """Append a row-level result, each input row exactly once; drains what is there and stops."""
    return (
        df.writeStream.format(file_format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_tables(job: SurveyJob, responses: DataFrame) -> dict[str, DataFrame]:
    """The job's row-level outputs as streaming tables."""
    prepared = job.prepare(responses)
    return {
        "responses": prepared,
        f"assignments_{job.mode}": job.assign(prepared),
        "segments_detailed": job.analyse_segments(prepared),
    }


def distinct_responses(responses: DataFrame, event_time: str, delay: str, key: str = "ID") -> DataFrame:
    """Drop responses that come again within ``delay`` of the latest event time; later ones are late and dropped too."""
    return responses.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def append_batches(
    responses: DataFrame,
    tables: Callable[[DataFrame], dict[str, DataFrame]],
    folder: str,
    checkpoint: str,
    file_format: str = "parquet",
) -> StreamingQuery:
    """Write ``tables(batch)`` of every micro-batch below ``folder/name/batch=number``; drains what is there and stops."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, table in tables(kept).items():
                table.write.mode("overwrite").format(file_format).save(f"{folder}/{name}/batch={number}")
        finally:
            kept.unpersist()

    return (
        responses.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def batch_results(spark: SparkSession, folder: str, name: str, file_format: str = "parquet") -> DataFrame:
    """All batches of one table."""
    return spark.read.format(file_format).load(f"{folder}/{name}").drop("batch")


def added_up(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of batches as counts of the whole: every column that is no key is summed."""
    sums = [F.sum(c).alias(c) for c in counts.columns if c not in keys]
    return counts.groupBy(*keys).agg(*sums)
