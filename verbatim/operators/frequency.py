"""Word and phrase frequencies per text column."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verbatim import lexicons as lx
from verbatim.functions.expr import explode_rows
from verbatim.functions.text import frequency_preprocess, frequency_tokens
from verbatim.session import ensure_checkpoint_dir, ship_package
from verbatim.settings import FrequencySettings
from verbatim.sources.dictionary import TextDictionary


def stopwords(dictionary: TextDictionary, base: Iterable[str] = lx.BASE_STOPWORDS) -> set[str]:
    return set(base) | set(lx.FREQUENCY_EXTRA_STOPWORDS) | set(dictionary.always_drop)


def shown_tokens(
    texts: DataFrame,
    dictionary: TextDictionary,
    settings: FrequencySettings = FrequencySettings(),
    base_stopwords: Iterable[str] = lx.BASE_STOPWORDS,
) -> DataFrame:
    """A row per token that counts, as it is shown: (``TextColumn``, ``token``, ``is_phrase``)."""
    clean = frequency_preprocess(F.col("text"), dictionary)
    tokens = frequency_tokens(
        clean, dictionary, stopwords(dictionary, base_stopwords), keep_phrases_only=False,
        min_token_len=settings.min_token_len,
    )
    exploded = explode_rows(texts.filter(F.col("text").isNotNull()), ["TextColumn"], tokens, "token")
    shown = F.replace("token", F.lit("_"), F.lit(" ")) if settings.display_phrases_with_spaces else F.col("token")
    return exploded.select("TextColumn", shown.alias("token"), F.contains("token", F.lit("_")).alias("is_phrase"))


def token_frequencies(
    texts: DataFrame,
    dictionary: TextDictionary,
    settings: FrequencySettings = FrequencySettings(),
    base_stopwords: Iterable[str] = lx.BASE_STOPWORDS,
) -> DataFrame:
    """Counts per (``TextColumn``, ``token``) of rows with ``TextColumn`` and ``text``.

    With phrases only, a column in which no phrase is frequent enough falls back to its single words. Both counts come from
    one pass: tokens are counted with a phrase flag, and the few columns that have phrases are found from the counts.
    """
    exploded = shown_tokens(texts, dictionary, settings, base_stopwords)
    counts = (
        exploded.groupBy("TextColumn", "token", "is_phrase")
        .agg(F.count(F.lit(1)).alias("count"))
        .filter(F.col("count") >= settings.min_freq)
    )
    if settings.keep_phrases_only:
        # One row per text column, far below any broadcast limit at run time.
        columns = counts.groupBy("TextColumn").agg(F.max("is_phrase").alias("has_phrases"))
        counts = counts.join(columns, "TextColumn").filter(F.col("is_phrase") | ~F.col("has_phrases"))
    return counts.select("TextColumn", "token", "count")


def most_common(frequencies: DataFrame) -> DataFrame:
    """All tokens, the most common of each column first."""
    return frequencies.orderBy("TextColumn", F.desc("count"), "token")


def top_tokens(frequencies: DataFrame, n: int) -> DataFrame:
    """The ``n`` most common tokens per column with their rank; each task keeps its own ``n`` before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("TextColumn").orderBy(F.desc("count"), "token"))
    return frequencies.withColumn("rank", rank).filter(F.col("rank") <= n)


def _counters(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Misra-Gries: at most ``capacity`` counters outlive a batch; what is taken off every counter is kept as ``lost``."""
    counts: Counter[tuple] = Counter()
    lost = 0
    for batch in batches:
        counts.update(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if len(counts) > capacity:
            off = sorted(counts.values(), reverse=True)[capacity]
            lost += off
            counts = Counter({k: n - off for k, n in counts.items() if n > off})
    keys = list(counts)
    columns = [[k[0] for k in keys] + [None], [k[1] for k in keys] + [None]]
    numbers = [list(counts.values()) + [0], [0] * len(keys) + [lost]]
    arrays = [pa.array(c, pa.string()) for c in columns] + [pa.array(n, pa.int64()) for n in numbers]
    yield pa.RecordBatch.from_arrays(arrays, ["TextColumn", "token", "n", "lost"])


def frequent_tokens(
    texts: DataFrame,
    dictionary: TextDictionary,
    n: int,
    settings: FrequencySettings = FrequencySettings(),
    capacity: int = 50_000,
) -> DataFrame:
    """The ``n`` most common tokens per column, exactly, with a shuffle that does not grow with the vocabulary.

    Each task keeps ``capacity`` counters. Their sums are below the true counts by what the tasks have lost at most, so
    only tokens that could still reach the n-th best sum are counted again. If a token that no task kept could reach it (a
    capacity too small for the data), all tokens are counted.
    """
    ship_package(texts.sparkSession)
    ensure_checkpoint_dir(texts.sparkSession)
    tokens = shown_tokens(texts, dictionary, settings).select("TextColumn", "token")
    kept = tokens.mapInArrow(lambda b: _counters(b, capacity), "TextColumn string, token string, n bigint, lost bigint").checkpoint()
    lost = kept.agg(F.sum("lost")).first()[0] or 0
    sums = kept.filter(F.col("token").isNotNull()).groupBy("TextColumn", "token").agg(F.sum("n").alias("low"))
    place = F.row_number().over(Window.partitionBy("TextColumn").orderBy(F.desc("low")))
    last = sums.withColumn("place", place).filter(F.col("place") <= n).groupBy("TextColumn").agg(F.min("low").alias("reach"), F.count(F.lit(1)).alias("found"))
    short = last.filter((F.col("reach") <= lost) | (F.col("found") < n)).count()
    if lost and short:
        counted = tokens
    else:
        worth = sums.join(F.broadcast(last), "TextColumn").filter(F.col("low") + lost >= F.col("reach"))
        # About n tokens a column; no hint, so that the size at run time decides.
        counted = tokens.join(worth.select("TextColumn", "token"), ["TextColumn", "token"], "left_semi")
    counts = counted.groupBy("TextColumn", "token").agg(F.count(F.lit(1)).alias("count"))
    return top_tokens(counts.filter(F.col("count") >= settings.min_freq), n)


def column_frequencies(
    df: DataFrame,
    text_columns: Sequence[str],
    dictionary: TextDictionary,
    settings: FrequencySettings = FrequencySettings(),
    base_stopwords: Iterable[str] = lx.BASE_STOPWORDS,
) -> DataFrame:
    """Frequency table of each text column of a wide survey, from the processed text where there is one."""
    present = [c for c in text_columns if c in df.columns]

    def source(c: str) -> str:
        return f"{c}_processed" if settings.use_processed and f"{c}_processed" in df.columns else c

    entries = [F.struct(F.lit(c).alias("TextColumn"), F.col(source(c)).cast("string").alias("text")) for c in present]
    long = df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")
    return token_frequencies(long, dictionary, settings, base_stopwords)
