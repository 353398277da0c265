"""Phrase curation: near-duplicate search and removal, related examples, library metrics.

Near-duplicates are found by an exact prefix-filtered similarity join. Equal word sets are collapsed first, words are
ordered from rare to frequent, and two sets can only be similar enough if the rare ends of both share a word. Sets meet by
word and size, and only if the places of the word leave enough words behind it; numbers meet, words are fetched later.
Where one side is small, every task holds it and looks its own sets up there (``set_index``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatim.functions.expr import compute_once
from verbatim.functions.phrases import canonical_phrase, is_generic_phrase, phrase_quality, word_set
from verbatim.functions.text import tokens
from verbatim.operators.set_index import SetIndex, meeting, near_names, rare_ends
from verbatim.session import ensure_checkpoint_dir, ship_package, written

#: Words of the new sets, in all, up to which every task holds them.
HELD_WORDS = 1 << 19
#: Words whose order every task holds; rarer ones are ordered by their hash.
COMMON = 1 << 18


def candidates_for_library(df: DataFrame, phrase: str = "phrase") -> DataFrame:
    """Canonical phrases that are not generic."""
    canonical = compute_once(df, phrase, canonical_phrase(F.col(phrase))).select(*df.columns)
    return canonical.filter((F.col(phrase) != "") & ~is_generic_phrase(F.col(phrase)))


def _ordered_sets(sets: DataFrame, group: Sequence[str]) -> DataFrame:
    """Words of each set from rare to frequent within the group; ``sets`` has ``set_id`` and ``words``."""
    words = sets.select(*group, "set_id", F.explode("words").alias("word"))
    frequency = words.groupBy(*group, "word").agg(F.count(F.lit(1)).alias("df"))
    ranked = words.join(frequency, [*group, "word"])
    return ranked.groupBy(*group, "set_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda w: w["word"]).alias("words")
    )


def _prefix_size(size: Column, threshold: float) -> Column:
    # Rounding guards against 0.65 * 20 coming out a hair above 13.
    return size - F.ceil(F.round(size * threshold, 6)).cast("int") + 1


def _prefixes(ordered: DataFrame, group: Sequence[str], threshold: float, suffix: str, spread: bool) -> DataFrame:
    """One row per prefix word: id, size, place and size class; ``spread`` also puts it into the neighbouring classes.

    Sets of a similar pair differ in size by the threshold at most, so by one class at most.
    """
    size = F.size("words")
    level = F.floor(F.log(size) / F.lit(-math.log(threshold)) + 1e-9)
    classes = F.array(*[level + d for d in ((-1, 0, 1) if spread else (0,))])
    rows = ordered.select(*group, F.col("set_id").alias(f"id_{suffix}"), size.alias(f"size_{suffix}"), classes.alias("classes"),
                          F.posexplode(F.slice("words", F.lit(1), _prefix_size(size, threshold))).alias(f"pos_{suffix}", "word"))
    return rows.withColumn("level", F.explode("classes")).drop("classes")


def _similar(left: DataFrame, right: DataFrame, group: Sequence[str], threshold: float, same: bool) -> DataFrame:
    """``(id_a, id_b, similarity)`` of the similar pairs of two tables of ordered sets; ``same``: of one, each pair once.

    Only ids, sizes and places meet in the join. A shared prefix word counts if the words behind it, in both sets, could
    still make up the overlap that the threshold asks for; of the first shared word this is a bound, and a later one only
    repeats the question. The words themselves are fetched for the pairs that are left.
    """
    keys = list(group)
    a, b = _prefixes(left, keys, threshold, "a", True), _prefixes(right, keys, threshold, "b", False)
    size_a, size_b = F.col("size_a"), F.col("size_b")
    needed = (size_a + size_b) * (threshold / (1 + threshold)) - 1e-6
    reach = F.least(size_a - F.col("pos_a"), size_b - F.col("pos_b"))
    possible = (size_a >= size_b * threshold - 1e-9) & (size_b >= size_a * threshold - 1e-9) & (reach >= needed)
    if same:
        possible = possible & (F.col("id_a") < F.col("id_b"))
    x, y = a.alias("x"), b.alias("y")
    equal = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (*keys, "word", "level")]
    pairs = x.join(y, reduce(lambda p, q: p & q, equal) & possible)
    pairs = pairs.select(*[F.col(f"x.{k}").alias(k) for k in keys], "id_a", "id_b").distinct()
    pairs = pairs.join(left.select(*keys, F.col("set_id").alias("id_a"), F.col("words").alias("words_a")), [*keys, "id_a"])
    pairs = pairs.join(right.select(*keys, F.col("set_id").alias("id_b"), F.col("words").alias("words_b")), [*keys, "id_b"])
    common = F.size(F.array_intersect("words_a", "words_b"))
    score = common / (F.size("words_a") + F.size("words_b") - common)
    return pairs.select(*keys, "id_a", "id_b", score.alias("similarity")).filter(F.col("similarity") >= threshold)


def similar_sets(sets: DataFrame, group: Sequence[str], threshold: float) -> DataFrame:
    """Pairs ``(id_a < id_b, similarity)`` of distinct word sets of a group with Jaccard at or above the threshold.

    Words are numbers behind their group, in an order that is the same in every task, so no set is shuffled to be put in
    order. Of every set only its rare end travels, a row per word; what meets there and could be similar is confirmed on
    the words themselves. Sets of a group that is null have no pairs.
    """
    named = sets.select(*group, "set_id", F.array_join("words", "\x01").alias("line")).dropna(subset=[*group, "set_id"])
    return _similar_numbered(written(named.withColumn("number", F.monotonically_increasing_id())), group, threshold, "\x01")


def _similar_numbered(named: DataFrame, group: Sequence[str], threshold: float, mark: str) -> DataFrame:
    """``similar_sets`` of a written table: a set has a ``number``, and a ``line`` of its words with ``mark`` between them."""
    spark, keys = named.sparkSession, list(group)
    ship_package(spark)
    words = named.filter("line <> ''").select(*keys, "number", F.split("line", mark).alias("words"))
    codes = words.select("number", F.transform("words", lambda w: F.xxhash64(*keys, w)).alias("codes"))
    order = spark.sparkContext.broadcast(common_codes(codes))
    rows = codes.mapInArrow(rare_ends(order, threshold), "code bigint, number bigint, size int, place int, bits bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = rows.repartition(parts, "code").sortWithinPartitions("code", "size").mapInArrow(meeting(threshold), "x bigint, y bigint")
    met = written(met.distinct())
    order.unpersist()
    ends = met.select(F.explode(F.array("x", "y")).alias("number")).distinct()
    held = written(named.join(ends, "number", "left_semi"))
    for side in "xy":
        met = met.join(held.select(F.col("number").alias(side), F.struct(*keys, "set_id", "line").alias(f"_{side}")), side)
    swapped = F.col("_x.set_id") > F.col("_y.set_id")
    same = reduce(and_, [F.col(f"_x.{k}") == F.col(f"_y.{k}") for k in keys], F.col("_x.set_id") != F.col("_y.set_id"))
    ends_of = [F.when(swapped, F.col(f"_{q}.set_id")).otherwise(F.col(f"_{p}.set_id")) for p, q in ("xy", "yx")]
    split = [F.split(f"_{side}.line", mark).alias(side) for side in "xy"]
    both = met.filter(same).select(*[F.col(f"_x.{k}").alias(k) for k in keys], ends_of[0].alias("id_a"), ends_of[1].alias("id_b"), *split)
    common = F.size(F.array_intersect("x", "y"))
    score = common / (F.size("x") + F.size("y") - common)
    return both.select(*keys, "id_a", "id_b", score.alias("similarity")).filter(F.col("similarity") >= threshold)


def common_codes(codes: DataFrame, most: int = COMMON) -> np.ndarray:
    """The numbers of the commonest words, ``most`` at most, from rare to frequent: those that reach one count."""
    counts = written(codes.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    steps = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("least")).collect()
    least, total = None, 0
    for step in sorted(steps, key=lambda r: -r["level"]):
        total += step["size"]
        if total > most:
            break
        least = step["least"]
    if least is None:
        return np.empty(0, np.int64)
    return counts.filter(F.col("n") >= least).toArrow().sort_by([("n", "ascending"), ("code", "ascending")]).column("code").to_numpy()


def _distinct_sets(df: DataFrame, group: Sequence[str], phrase: str, order: str) -> DataFrame:
    """Distinct word sets of canonical phrases per group, as lines, named by the order of their first phrase."""
    # A line of words is a smaller key than an array of them; canonical phrases have no white space but spaces.
    line = F.array_join(F.sort_array(F.array_distinct(tokens(F.col(phrase), only_spaces=True))), " ")
    lines = compute_once(df.select(*group, phrase, F.col(order).alias("_o")), "_l", line).filter(F.col("_l") != "")
    return lines.groupBy(*group, "_l").agg(F.min("_o").alias("set_id")).withColumnRenamed("_l", "line")


def dedupe_phrases(
    df: DataFrame, group: Sequence[str], order: str, phrase: str = "phrase", threshold: float = 0.65
) -> DataFrame:
    """Greedy near-duplicate removal in the given order, per group: a phrase stays if no earlier kept one is similar.

    Phrases are canonicalised and generic ones dropped first. The greedy choice is settled in rounds over the similar
    pairs only: a phrase without an undecided earlier neighbour stays, and its later neighbours go. ``order`` must be
    unique per group. Each round is checkpointed, so its lineage does not grow. Rows with a null group or order go.
    """
    ensure_checkpoint_dir(df.sparkSession)
    keys = list(group)
    # Canonicalising is the costly step and is read three times below.
    clean = written(candidates_for_library(df.dropna(subset=[*keys, order]), phrase))
    sets = written(_distinct_sets(clean, group, phrase, order).withColumn("number", F.monotonically_increasing_id()))
    pairs = _similar_numbered(sets, group, threshold, " ").select(*keys, "id_a", "id_b")
    undecided_pairs, removed = written(pairs), None
    while not undecided_pairs.isEmpty():
        blocked = undecided_pairs.select(*keys, F.col("id_b").alias("id_a")).distinct()
        kept = undecided_pairs.select(*keys, "id_a").distinct().join(blocked, [*keys, "id_a"], "left_anti")
        gone = undecided_pairs.join(kept, [*keys, "id_a"], "left_semi").select(*keys, "id_b").distinct().checkpoint()
        removed = gone if removed is None else removed.unionByName(gone)
        undecided_pairs = (
            undecided_pairs.join(gone, [*keys, "id_b"], "left_anti")
            .join(gone.withColumnRenamed("id_b", "id_a"), [*keys, "id_a"], "left_anti")
            .select(*keys, "id_a", "id_b")
            .checkpoint()
        )
    kept_sets = sets.select(*keys, F.col("set_id").alias(order))
    if removed is not None:
        kept_sets = kept_sets.join(removed.withColumnRenamed("id_b", order), [*keys, order], "left_anti")
    return clean.join(kept_sets, [*keys, order], "left_semi")


def _near_held(new_sets: DataFrame, existing_sets: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """``set_id`` of the new sets near an existing one: each existing set is looked up in its task, which holds the new ones."""
    spark = new_sets.sparkSession
    ship_package(spark)
    groups = new_sets.select(*keys).distinct().withColumn("_g", F.monotonically_increasing_id()).checkpoint()
    held = new_sets.join(F.broadcast(groups), list(keys)).select(F.col("set_id").alias("name"), F.col("_g").alias("grp"), "words")
    shared = spark.sparkContext.broadcast(SetIndex.build(held.toArrow(), threshold))
    rows = existing_sets.join(F.broadcast(groups), list(keys)).select("_g", "words")
    return rows.mapInArrow(near_names(shared), "set_id string").distinct()


def _near_shuffled(new_sets: DataFrame, existing_sets: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """``set_id`` of the new sets near an existing one: both sides meet in a shuffle by word."""
    distinct = existing_sets.filter(F.size("words") > 0).withColumn("words", F.array_sort("words")).distinct()
    names = F.concat(F.lit("e"), F.sha1(F.array_join("words", "\x01").cast("binary")))
    both = new_sets.unionByName(distinct.withColumn("set_id", names))
    ordered = _ordered_sets(both, keys).checkpoint()
    left, right = (ordered.filter(F.col("set_id").startswith(side)) for side in "ne")
    return _similar(left, right, keys, threshold, same=False).select(*keys, F.col("id_a").alias("set_id")).distinct()


def near_existing(
    new: DataFrame,
    existing: DataFrame,
    group: Sequence[str],
    phrase: str = "phrase",
    threshold: float = 0.65,
    held_words: int = HELD_WORDS,
) -> DataFrame:
    """Distinct word sets of ``new`` that are similar to some phrase of ``existing`` in the same group.

    Up to ``held_words`` words, the new sets go to every task and the existing ones are read once, without a shuffle.
    """
    keys = list(group)

    def sets(df: DataFrame) -> DataFrame:
        return df.select(*keys, word_set(F.col(phrase)).alias("words"))

    ensure_checkpoint_dir(new.sparkSession)
    new_sets = sets(new).filter(F.size("words") > 0).withColumn("words", F.array_sort("words")).distinct()
    names = F.concat(F.lit("n"), F.sha1(F.concat_ws("\x01", F.to_json(F.struct(*keys)), F.array_join("words", "\x01")).cast("binary")))
    new_sets = new_sets.withColumn("set_id", names).checkpoint()
    words = new_sets.agg(F.sum(F.size("words"))).first()[0] or 0
    near = _near_held if words <= held_words else _near_shuffled
    on = "set_id" if words <= held_words else [*keys, "set_id"]
    return new_sets.join(near(new_sets, sets(existing), keys, threshold), on, "left_semi").select(*keys, "words")


def drop_near_existing(
    new: DataFrame, existing: DataFrame, group: Sequence[str], phrase: str = "phrase", threshold: float = 0.65
) -> DataFrame:
    """Phrases of ``new`` that are not similar to any phrase of ``existing`` in the same group."""
    near = near_existing(new, existing, group, phrase, threshold).withColumnRenamed("words", "_w")
    staged = new.withColumn("_w", F.array_sort(word_set(F.col(phrase))))
    return staged.join(near, [*group, "_w"], "left_anti").select(*new.columns)


def related_examples(examples: DataFrame, subthemes: Sequence[tuple[str, str, str]], limit: int = 10) -> DataFrame:
    """Up to ``limit`` examples per (column, theme, subtheme) from categories related to the theme.

    ``examples`` has ``category_pos``, ``column``, ``example_pos``, ``related_themes`` and ``example``; a theme is related if its
    name contains, or is contained in, a related theme's. The subthemes are a small list, so they are tested inside the
    row. The cut keeps ``limit`` rows per task before anything is shuffled.
    """
    wanted = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(t).alias("theme"), F.lit(s).alias("subtheme"))
            for c, t, s in subthemes
        ]
    )

    def related(w: Column) -> Column:
        name = F.lower(w["theme"])
        hit = F.exists("related_themes", lambda r: F.contains(F.lower(r), name) | F.contains(name, F.lower(r)))
        return (w["column"] == F.col("column")) & hit

    hits = examples.select(
        F.explode(F.filter(wanted, related)).alias("w"), "category_pos", "example_pos", "example"
    ).select("w.*", "category_pos", "example_pos", "example")
    rank = F.row_number().over(
        Window.partitionBy("column", "theme", "subtheme").orderBy("category_pos", "example_pos")
    )
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit)


def existing_keywords(new: DataFrame, library: DataFrame) -> DataFrame:
    """Each subtheme of ``new`` with the keywords the library already has for it, by (column, theme, subtheme).

    Parents do not count, so several can hold the same subtheme: the last of those with keywords, by name, is taken.
    """
    keys = ["column", "theme", "subtheme"]
    held = library.filter(F.size("keywords_phrases") > 0).groupBy(*keys)
    return new.join(held.agg(F.max_by("keywords_phrases", "parent").alias("keywords_phrases")), keys, "left")


def library_metrics(generated: DataFrame, kept: DataFrame) -> DataFrame:
    """Per subtheme: phrases kept, their mean quality, and how many were generated."""
    keys = ["column", "parent", "theme", "subtheme", "polarity"]
    made = generated.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_generated"))
    quality = phrase_quality(F.col("phrase"), F.col("subtheme"))["overall"]
    stayed = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("phrase_count"), F.avg(quality).alias("avg_quality")
    )
    return made.join(stayed, keys, "left").select(
        *keys,
        F.coalesce("phrase_count", F.lit(0)).alias("phrase_count"),
        F.coalesce("avg_quality", F.lit(0.0)).alias("avg_quality"),
        "total_generated",
        F.coalesce("phrase_count", F.lit(0)).alias("total_after_dedupe"),
    )


def library_totals(metrics: DataFrame) -> DataFrame:
    return metrics.agg(
        F.count(F.lit(1)).alias("subthemes"),
        F.sum("phrase_count").alias("phrases"),
        F.avg("phrase_count").alias("phrases_per_subtheme"),
    )
