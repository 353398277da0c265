"""Aggregate-only text profiles, trends and correlations."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatim import lexicons as lx
from verbatim.functions.expr import compute_once, split_at
from verbatim.functions.patterns import WORD, any_term
from verbatim.functions.plugins import PairScorer
from verbatim.functions.text import split_multi, strip, token_count, tokens
from verbatim.operators.assignments import join_field
from verbatim.operators.rerank import format_template
from verbatim.session import ensure_checkpoint_dir, ship_package


def _share(condition: Column) -> Column:
    """Percentage of rows for which the condition holds."""
    return F.count_if(F.coalesce(condition, F.lit(False))) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100


def theme_trend(assignments: DataFrame, periods: DataFrame, delimiter: str = " | ") -> DataFrame:
    """Mentions per (period, theme) and the change from the theme's previous period.

    ``periods`` has ``ID`` and ``period``. Mentions are counted before the window, so it sees one row per period and theme.
    """
    mentions = assignments.select("ID", F.explode(split_multi(F.col("theme"), delimiter)).alias("theme")).filter(
        F.lower("theme") != "brief response"
    )
    counts = mentions.join(periods, "ID").groupBy("period", "theme").agg(F.count(F.lit(1)).alias("mentions"))
    previous = F.lag("mentions").over(Window.partitionBy("theme").orderBy("period"))
    return counts.withColumn("change", F.col("mentions") - previous)


def theme_scores(assignments: DataFrame, scores: DataFrame, delimiter: str = " | ") -> DataFrame:
    """Mean survey score per theme. ``scores`` has ``ID`` and ``score``."""
    mentions = assignments.select("ID", F.explode(split_multi(F.col("theme"), delimiter)).alias("theme")).filter(
        F.lower("theme") != "brief response"
    )
    return mentions.join(scores, "ID").groupBy("theme").agg(
        F.count(F.lit(1)).alias("mentions"), F.avg("score").alias("mean_score")
    )


def score_correlation(df: DataFrame, score: str = "score", compound: str = "compound") -> DataFrame:
    return df.filter(F.col(compound).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.corr(compound, score).alias("correlation")
    )


def sentiment_by_score_bin(df: DataFrame, bin_width: float, score: str = "score", compound: str = "compound") -> DataFrame:
    low = F.floor(F.col(score) / bin_width) * bin_width
    return df.filter(F.col(compound).isNotNull()).groupBy(low.cast("double").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(compound).alias("mean_compound")
    )


def length_profile(df: DataFrame, text: str = "text") -> DataFrame:
    """Length of the answers, without showing any."""
    c = F.coalesce(F.col(text), F.lit(""))
    staged = df.select(
        F.length(c).alias("chars"), token_count(c).alias("words"), (strip(c) == "").alias("empty"),
        F.size(F.filter(F.split(c, r"[.!?]+"), lambda s: strip(s) != "")).alias("sentences"),
    )
    filled = ~F.col("empty")
    return staged.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.when(filled, F.col("chars"))).alias("mean_chars"),
        F.avg(F.when(filled, F.col("words"))).alias("mean_words"),
        F.avg(F.when(filled, F.col("sentences"))).alias("mean_sentences"),
        _share(filled & (F.col("words") <= 5)).alias("very_short_pct"),
        _share(F.col("words") == 1).alias("single_word_pct"),
        _share(F.col("empty")).alias("empty_pct"),
    )


def sentiment_bands(scored: DataFrame, strong: float = 0.5, weak: float = 0.05) -> DataFrame:
    """Answers per sentiment band, with the mixed ones (both moods present) counted in each.

    ``scored`` has ``compound``, ``pos`` and ``neg``.
    """
    c = F.col("compound")
    band = (
        F.when(c <= -strong, "Strongly negative")
        .when(c <= -weak, "Negative")
        .when(c < weak, "Neutral")
        .when(c < strong, "Positive")
        .otherwise("Strongly positive")
    )
    return scored.filter(c.isNotNull()).groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if((F.col("pos") > 0) & (F.col("neg") > 0)).alias("mixed")
    )


def tone_profile(
    df: DataFrame,
    text: str = "text",
    modal: Iterable[str] = lx.MODAL_WORDS,
    hedge: Iterable[str] = lx.HEDGE_WORDS,
    intensifier: Iterable[str] = lx.INTENSIFIER_WORDS,
    negation: Iterable[str] = lx.NEGATION_WORDS,
    suggestion: Iterable[str] = lx.SUGGESTION_WORDS,
) -> DataFrame:
    """Share of answers with each tone signal."""
    c = F.col(text)
    signals = {"modal": modal, "hedge": hedge, "intensifier": intensifier, "negation": negation, "suggestion": suggestion}
    return df.agg(
        F.count(F.lit(1)).alias("rows"), *[_share(c.rlike(any_term(t))).alias(f"{n}_pct") for n, t in signals.items()]
    )


def junk_profile(
    df: DataFrame,
    text: str = "text",
    stopwords: Iterable[str] = lx.BASE_STOPWORDS,
    fillers: Iterable[str] = lx.FILLER_WORDS,
    stop_ratio: float = 0.8,
) -> DataFrame:
    """Share of single words, stop-word-heavy answers, filler answers and answers without letters."""
    stop, filler = sorted(set(stopwords)), sorted(set(fillers))
    c = F.coalesce(F.col(text), F.lit(""))
    staged = df.select(c.alias("c"), tokens(F.lower(c)).alias("t"))
    stops = F.size(F.filter("t", lambda w: w.isin(*stop)))
    filled = strip(F.col("c")) != ""
    return staged.agg(
        F.count(F.lit(1)).alias("rows"),
        _share(F.size("t") == 1).alias("single_word_pct"),
        _share((F.size("t") > 0) & (stops >= F.size("t") * stop_ratio)).alias("stopword_heavy_pct"),
        _share(F.lower(strip(F.col("c"))).isin(*filler)).alias("filler_pct"),
        _share(filled & ~F.col("c").rlike(r"\p{L}")).alias("non_linguistic_pct"),
    )


def topic_surface(counts: DataFrame, count: str = "count") -> DataFrame:
    """Topics, entropy and normalised diversity of a table of topic counts (one row per topic)."""
    n = F.col(count).cast("double")
    total, log_sum, topics = F.sum(n), F.sum(n * F.log(n)), F.count(F.lit(1))
    # entropy = ln(total) - sum(n ln n) / total, which needs one pass and no second look at the total
    staged = counts.filter(n > 0).agg(topics.alias("topics"), (F.log(total) - log_sum / total).alias("entropy"))
    diversity = F.when(F.col("topics") > 1, F.col("entropy") / F.log("topics") * 100).otherwise(0.0)
    return staged.withColumn("diversity_pct", diversity)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equally near ones."""
    gaps = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    return gaps.argmin(axis=1)


def cluster_vectors(df: DataFrame, k: int, vector: str = "vector", order: str = "id", rounds: int = 20) -> DataFrame:
    """Add ``cluster`` by k-means over an array column.

    The first ``k`` vectors by ``order`` are the first centres, so the result does not depend on how rows are dealt. A round
    sums the vectors per nearest centre, batch by batch in the tasks; ``k`` centres are all that comes to the driver. It
    ends when no centre moves. A centre without vectors stays where it is; a null vector has no cluster.
    """
    ensure_checkpoint_dir(df.sparkSession)
    # A vector may be costly to make, so the filter and the first centres read what is computed once.
    vectors = compute_once(df.select(F.col(order).alias("o"), F.col(vector).alias("v")), "v", F.col("v").cast("array<double>"))
    vectors = vectors.filter(F.col("v").isNotNull()).checkpoint()
    first = vectors.orderBy("o").limit(k).collect()
    if not first:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    ship_package(df.sparkSession)
    vectors = vectors.select("v")
    centres = np.array([r["v"] for r in first])
    for _ in range(rounds):
        now = centres

        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = now) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch.column(0))
                    own = _nearest(x, now)
                    met = np.unique(own)
                    total = pa.array([x[own == c].sum(axis=0) for c in met], pa.list_(pa.float64()))
                    size = pa.array([int((own == c).sum()) for c in met], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), size, total], ["cluster", "n", "total"])

        parts = vectors.mapInArrow(sums, "cluster int, n bigint, total array<double>")
        each = parts.select("cluster", "n", F.posexplode("total").alias("i", "x"))
        moved = each.groupBy("cluster", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
        centres = now.copy()
        for r in moved.collect():
            centres[r["cluster"], r["i"]] = r["x"]
        if np.allclose(centres, now, rtol=0, atol=1e-12):
            break
    found = centres

    @F.arrow_udf("int")
    def cluster(lists: pa.Array) -> pa.Array:
        there = lists.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(lists), np.int32)
        if there.any():
            out[there] = _nearest(_matrix(lists.filter(pa.array(there))), found)
        return pa.array(out, mask=~there)

    return df.withColumn("cluster", cluster(F.col(vector).cast("array<double>")))


def describe_clusters(
    clustered: DataFrame, text: str = "text", n_phrases: int = 3, stopwords: Iterable[str] = lx.BASE_STOPWORDS
) -> DataFrame:
    """Size, most frequent word pairs and sentiment mix of each cluster.

    Word pairs are counted before the ranking window, and the window keeps ``n_phrases`` per task before it shuffles.
    """
    stop = sorted(set(stopwords))
    sizes = clustered.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(F.col("sentiment_label") == "Positive").alias("pos_count"),
        F.count_if(F.col("sentiment_label") == "Negative").alias("neg_count"),
        F.count_if(F.col("sentiment_label") == "Neutral").alias("neutral_count"),
    )
    kept = clustered.select(
        "cluster",
        F.filter(split_at(F.lower(F.col(text)), f"[^{WORD}]+"), lambda w: (w != "") & ~w.isin(*stop)).alias("w"),
    )
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i))
    )
    counted = (
        kept.filter(F.size("w") > 1).select("cluster", F.explode(pairs).alias("phrase"))
        .groupBy("cluster", "phrase").agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "phrase"))
    best = counted.withColumn("rank", rank).filter(F.col("rank") <= n_phrases)
    labels = best.groupBy("cluster").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda p: p["phrase"]), " | ")
        .alias("top_phrases")
    )
    return sizes.join(labels, "cluster", "left")


def exact_quantiles(df: DataFrame, column: str, probabilities: list[float], buckets: int = 4096) -> list[float | None]:
    """Exact quantiles with linear interpolation, without sorting the rows or gathering them anywhere.

    Each pass counts the rows of the intervals that hold a wanted rank in even buckets and narrows every interval to
    one bucket, until that bucket holds a single value. At most ``buckets`` counts per interval reach the driver, and a
    few passes exhaust the precision of a double.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter(F.col("v").isNotNull())
    values = values.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _exact_quantiles(values, probabilities, buckets)
    finally:
        values.unpersist()


def _exact_quantiles(values: DataFrame, probabilities: list[float], buckets: int) -> list[float | None]:
    n, low, high = values.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(probabilities)
    ranks = sorted({r for p in probabilities for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))})
    found: dict[int, float] = {}
    # interval (low, high) -> (rows below it, wanted ranks inside it)
    intervals = {(low, high): (0, ranks)}
    while intervals:
        bounds = list(intervals)
        bucket = F.lit(None).cast("long")
        for i, (lo, hi) in enumerate(bounds):
            step = (hi - lo) / buckets or 1.0
            at = F.least(F.floor((F.col("v") - lo) / step), F.lit(buckets - 1)) + i * buckets
            bucket = F.when(F.col("v").between(lo, hi), at).otherwise(bucket)
        counts = (
            values.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .filter(F.col("b").isNotNull()).orderBy("b").collect()
        )
        narrowed: dict[tuple[float, float], tuple[int, list[int]]] = {}
        for i, bound in enumerate(bounds):
            below, wanted = intervals[bound]
            for row in (c for c in counts if c["b"] // buckets == i):
                inside = [r for r in wanted if below <= r < below + row["n"]]
                if inside and row["lo"] == row["hi"]:
                    found.update(dict.fromkeys(inside, row["lo"]))
                elif inside:
                    narrowed[(row["lo"], row["hi"])] = (below, inside)
                below += row["n"]
        intervals = narrowed

    def quantile(p: float) -> float:
        h = (n - 1) * p
        lo, hi = found[math.floor(h)], found[math.ceil(h)]
        return lo + (h - math.floor(h)) * (hi - lo)

    return [quantile(p) for p in probabilities]


def score_distribution(assignments: DataFrame, score: str = "rule_score") -> DataFrame:
    """Min, exact quartiles, mean and max of the matched scores."""
    matched = assignments.filter(F.col("reason") == "matched").select(score)
    q1, median, q3 = (F.lit(q).cast("double") for q in exact_quantiles(matched, score, [0.25, 0.5, 0.75]))
    s = F.col(score)
    return matched.agg(F.count(F.lit(1)).alias("n"), F.min(s).alias("min"), F.max(s).alias("max"), F.avg(s).alias("mean")).select(
        "n", "min", q1.alias("q1"), median.alias("median"), q3.alias("q3"), "max", "mean"
    )


def parent_share(assignments: DataFrame, delimiter: str = " | ") -> DataFrame:
    """Share of each parent theme in all matched labels.

    The total is a window over one row per parent theme, after the counts have been aggregated.
    """
    labels = assignments.filter(F.col("reason") == "matched").select(
        F.explode(split_multi(F.col("parent_theme"), delimiter)).alias("parent_theme")
    )
    counts = labels.groupBy("parent_theme").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.select("parent_theme", "count", (F.col("count") / total * 100).alias("share_pct"))


def classify_vectors(
    train: DataFrame, df: DataFrame, vector: str = "vector", label: str = "label", max_iter: int = 20
) -> DataFrame:
    """Add ``predicted`` from a one-vs-rest logistic regression trained on labelled vectors."""
    from pyspark.ml.classification import LogisticRegression, OneVsRest
    from pyspark.ml.functions import array_to_vector

    def features(x: DataFrame) -> DataFrame:
        return x.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))

    base = LogisticRegression(maxIter=max_iter, regParam=0.01)
    ovr = OneVsRest(classifier=base, featuresCol="_features", labelCol="_label", predictionCol="predicted")
    model = ovr.fit(features(train).select("_features", F.col(label).cast("double").alias("_label")))
    # The row's other columns may not pass a one-vs-rest transform by name, so it sees them as one struct.
    packed = features(df).select("_features", F.struct(*df.columns).alias("_row"))
    return model.transform(packed).select("_row.*", F.col("predicted").cast("int").alias("predicted"))


def hypothesis_themes(
    long: DataFrame,
    themes: list[str],
    scorer: PairScorer,
    threshold: float,
    top_k: int = 3,
    template: str = "This response is about {theme}",
    delimiter: str = " | ",
) -> DataFrame:
    """Theme each answer by how well "this answer is about X" scores, for a small list of themes.

    The hypotheses are a literal array scored inside the row, so answers are never crossed with themes as rows.
    """
    hypotheses = F.array(*[format_template(template, {"theme": F.lit(t)}) for t in themes])
    names = F.array(*[F.lit(t) for t in themes])
    scored = compute_once(long, "_s", scorer(F.coalesce(F.col("text"), F.lit("")), hypotheses))
    ranked = F.array_sort(
        F.filter(
            F.zip_with(
                F.transform("_s", lambda s, i: F.struct((-s).alias("neg"), i.alias("i"), s.alias("score"))), names,
                lambda s, n: s.withField("theme", n),
            ),
            lambda s: s["score"] >= threshold,
        )
    )
    best = compute_once(scored, "_best", F.slice(ranked, 1, top_k))
    return best.select(
        "ID", "TextColumn", join_field(F.col("_best"), "theme", delimiter).alias("theme"),
        F.coalesce(F.get("_best", F.lit(0))["score"], F.lit(0.0)).alias("score"),
    )
