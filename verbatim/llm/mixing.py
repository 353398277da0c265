"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words: its share, by weight, of ``share`` times all words, but at most ``most`` times its
own size; what a full source cannot take is shared again among the others. Every document of a source is taken in as many
complete epochs as fit the target. The rest of the target is filled in the order of the keys ``-ln(u) / w``, where u is a
hash of the document's id and w its quality weight: the prefix sum of sizes in this order is cut at the budget, at
the document boundary that lies nearest to it.

The order is never built for a whole source in one task. Slim rows (no text) are dealt out by range of (source, key), the
ranges' sizes give each range its offset, and only the one range of a source in which its budget ends is summed row by row.
What leaves is one threshold per source, and each document decides for itself by comparing its key with it.

Defined results: null and blank texts have size 0 and are never taken; null sources form one source, last in the order;
rows of one source that agree in id and size are taken together; null ids sort first. A source of size 0 has target 0.
Other columns are left alone. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatim.llm.common import stored, words
from verbatim.llm.rules import SYMBOLS

PLACE = ("draw", "id", "size")
#: Up to so many sources, their thresholds are broadcast (at most some 10 MB); beyond that they are joined.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in the order of their names; ``share`` and ``most`` are multiples of sizes."""

    weights: Sequence[int] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: str = "mix-1"


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key and the seed only: 52 bits of md5."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits + F.lit(0.5)) / F.lit(float(2**52))


def quality(n_words: Column, n_symbols: Column) -> Column:
    """The quality weight in (0, 1]: less for text that is thick with symbols."""
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * n_symbols / F.greatest(n_words, F.lit(1)))


def placed(docs: DataFrame, mix: Mix, key: str, source: str, text: str) -> DataFrame:
    """``docs`` inside a struct ``row``, with source, id, size and the key ``draw``, computed once per row."""
    body = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = out.select(
        "row",
        F.col(f"row.{source}").alias("source"),
        F.col(f"row.{key}").alias("id"),
        F.size(words(body)).cast("long").alias("size"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("symbols"),
    )
    draw = -F.ln(uniform(F.col("id"), mix.seed)) / quality(F.col("size"), F.col("symbols"))
    return out.select("row", "source", "id", "size", draw.alias("draw"))


def targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """``source, source_size`` with ``target`` and ``epochs``; windows over one row per source.

    With the sources sorted by cap per weight, those filled up come first; the first that is not gives the level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in mix.weights]), ((F.row_number().over(by_name) - 1) % len(mix.weights)) + 1)
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * mix.most)
    out = out.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    out = out.withColumn("level", (F.sum("source_size").over(everything) * F.lit(mix.share) - before) / left)
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(everything)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * level, F.col("cap").cast("double")))
    out = out.select("source", "source_size", target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return out.withColumn("epochs", epochs)


def thresholds(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: its size, target, epochs, and the last place (draw, id, size) of the fractional part."""
    rows = rows.select("source", *PLACE)
    # The ranges must be fixed before they are summed: a range read twice from a fresh shuffle could be cut elsewhere.
    ranged = stored(
        rows.repartitionByRange("source", *PLACE).withColumn("part", F.spark_partition_id()), "mix-ranges"
    )
    place = F.struct(*PLACE)
    parts = ranged.groupBy("source", "part").agg(F.sum("size").alias("words"), F.max(place).alias("last"))
    plan = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), mix)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    plan = stored(plan.withColumn("rest", rest), "mix-plan")
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    in_order = Window.partitionBy("source").orderBy("part")
    parts = parts.withColumn("end", F.sum("words").over(in_order))
    cut = parts.alias("p").join(plan.alias("t"), same("p", "t")).select("p.*", "t.rest")
    full = cut.filter("end <= rest").groupBy("source").agg(F.max("last").alias("last"))
    crossing = cut.filter("end > rest and end - words < rest").select("source", "part", "rest", (F.col("end") - F.col("words")).alias("begin"))
    inside = ranged.alias("r").join(crossing.alias("c"), same("r", "c") & (F.col("r.part") == F.col("c.part")))
    inside = inside.select("r.source", *[f"r.{c}" for c in PLACE], "c.begin", "c.rest")
    running = F.sum("size").over(Window.partitionBy("source").orderBy(*PLACE))
    inside = inside.withColumn("before", F.col("begin") + running - F.col("size"))
    inside = inside.filter(F.col("before") + F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(place).alias("last"))
    last = full.unionByName(inside).groupBy("source").agg(F.max("last").alias("last"))
    cuts = plan.alias("t").join(last.alias("l"), same("t", "l"), "left")
    cuts = stored(cuts.select("t.source", "t.source_size", "t.target", "t.epochs", "l.last"), "mix-cuts")
    return F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts


def with_repeats(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with the numbers of their source and ``repeats``. One row per source is all that is joined."""
    joined = rows.alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")))
    chosen = F.coalesce(F.struct(*[F.col(f"r.{c}") for c in PLACE]) <= F.col("c.last"), F.lit(False))
    repeats = F.when(F.col("r.size") > 0, F.col("c.epochs") + chosen.cast("long")).otherwise(F.lit(0).cast("long"))
    return joined.select("r.*", "c.source_size", "c.target", "c.epochs", repeats.alias("repeats"))


def plan_mix(docs: DataFrame, mix: Mix | None = None, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Per document: key, size, source_size, target, epochs, repeats, taken. The text is read once."""
    mix = mix or Mix()
    slim = stored(placed(docs.select(key, source, text), mix, key, source, text).drop("row"), "mix-rows")
    out = with_repeats(slim, thresholds(slim, mix))
    return out.select(
        F.col("id").alias(key),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("repeats")).alias("taken"),
        "epochs",
        "repeats",
    )


def apply_mix(docs: DataFrame, mix: Mix | None = None, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed documents, all columns as they came, each as often as it is taken.

    The texts are not shuffled: the thresholds come to them.
    """
    mix = mix or Mix()
    cuts = thresholds(placed(docs.select(key, source, text), mix, key, source, text), mix)
    out = with_repeats(placed(docs, mix, key, source, text), cuts)
    copies = F.when(F.col("repeats") > 0, F.sequence(F.lit(1).cast("long"), F.col("repeats"))).otherwise(F.array().cast("array<bigint>"))
    return out.select("row", F.explode(copies).alias("copy")).select("row.*")
