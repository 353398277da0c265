"""From raw documents to token ids in five stages; each takes all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads again for the next one.
All but the last return the columns of ``documents``.

1. toxicity: documents that the classifier rejects go. It learns from the labels of the rows that op7_toxicity learns from.
2. quality rules: documents that the current policy rejects go.
3. MinHash near-dedup: of each group of near copies the document with the smallest id stays.
4. mixing: sources are brought to their targets; a document comes as often as the mix takes it.
5. BPE: the ids of every text, with a digest of what they decode to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verbatim.llm import bpe, mixing, near_dup, rules, toxicity
from verbatim.llm.common import crc_mod, free_name, ship, stored
from verbatim.llm.queries import vocabulary_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A classifier decides in the first stage, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    settings = toxicity.Settings()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(crc_mod(F.col("doc_id"), 4) != 2)
    model = toxicity.fit(docs, labels, settings)
    score = free_name(docs.columns, "score")
    scored = docs.withColumn(score, toxicity.score(F.col("text"), model, spark, settings))
    return scored.filter(F.col(score) < settings.threshold).drop(score)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules.keep_good(docs, rules.BOOK.policy("web", 2))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    path = vocabulary_path()
    out = docs.select("doc_id", "lang", "source", bpe.encode(F.col("text"), path).alias("ids"))
    out = out.withColumn("decoded", bpe.decode(F.col("ids"), path))
    return out.select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", to_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
