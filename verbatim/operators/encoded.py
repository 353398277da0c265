"""Vectors of texts, stored by content, so that every distinct text is encoded once in the life of a store.

The key is 128 bits of hash of the text. A run looks its distinct texts up in the store, encodes those that are missing, appends
them, and joins the vectors back. Copies cost nothing, and a second run over the same texts encodes none. Appending writes new
files only, so a run that fails leaves the store as it was, or with whole files; one writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatim.functions.plugins import Encoder
from verbatim.session import ensure_checkpoint_dir

KEY = ["t1", "t2"]
_SCHEMA = "t1 bigint, t2 bigint, vector array<double>"


def stored_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(t1, t2, vector) of the store; empty where there is none yet."""
    try:
        rows = spark.read.schema(_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], _SCHEMA)
    # A text that two runs added at once is there twice, with the same vector.
    return rows.dropDuplicates(KEY)


def add_vectors(df: DataFrame, encoder: Encoder, path: str, text: str = "text", vector: str = "vector") -> DataFrame:
    """``df`` with ``vector``: read from the store at ``path``, which takes in the texts it lacks; null texts have none."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    there = F.col(text).isNotNull()
    keys = [F.when(there, F.xxhash64(text)), F.when(there, F.xxhash64(F.lit("text"), text))]
    keyed = df.withColumns({f"_{k}": c for k, c in zip(KEY, keys, strict=True)})
    texts = keyed.filter("_t1 IS NOT NULL").groupBy(F.col("_t1").alias("t1"), F.col("_t2").alias("t2")).agg(F.first(text).alias("_text"))
    missing = texts.join(stored_vectors(spark, path).select(*KEY), KEY, "left_anti").checkpoint()
    if not missing.isEmpty():
        missing.select(*KEY, encoder(F.col("_text")).cast("array<double>").alias("vector")).write.mode("append").parquet(path)
    vectors = stored_vectors(spark, path).select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), F.col("vector").alias("_vector"))
    out = keyed.join(vectors, ["_t1", "_t2"], "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c != vector], F.col("_vector").alias(vector))
