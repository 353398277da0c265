"""Best phrases per answer where the phrase library is too large to broadcast.

Phrases are dealt to the nearest of a bounded number of centres, themselves phrases of the library; the phrases of one text
column at one centre are a cell, cut into blocks that fit a worker. Only the centres and the cells' radii are broadcast: by the
angle between answer and centre, less the radius, no phrase of a cell can be nearer than a known bound. Every distinct answer
visits its most promising cell first; the score of its last candidate there rules other cells out, and a second round visits
those that are left. Phrases and the answers that visit them meet in a shuffle by block: the block's phrases come first and
become a matrix, the answers stream past it. Nothing passes through the driver but the centres and radii, and the number of
checkpoints does not depend on the size of the library.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatim.session import ensure_checkpoint_dir, ship_package

MAX_CENTRES = 4096
MAX_CENTRE_BYTES = 32 * 1024 * 1024
MAX_CELLS = 1_000_000
MAX_BLOCK_BYTES = 64 * 1024 * 1024
_ANSWERS_PER_COPY = 100_000
_COPIES_OF_RESULTS = 16
_MAX_SCORES = 4_000_000
_OUT_BYTES = 16 * 1024 * 1024
_RANK_DECIMALS = 10
# Angles near 0 are known to about 1e-8; bounds are widened by far more than that.
_SLACK = 1e-6

_LABELS = ["theme", "subtheme", "parent_theme", "polarity", "matched_phrase"]
_FOUND = (
    "k1 bigint, k2 bigint, phrase_idx int, theme string, subtheme string, parent_theme string, score double, "
    "polarity string, matched_phrase string"
)
_VISITS = "k1 bigint, k2 bigint, column string, mood string, vector array<double>, centre int, part int"


def unit_rows(lists: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as unit rows; a zero vector stays zero."""
    flat = np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), dim)
    norms = np.linalg.norm(flat, axis=1, keepdims=True)
    return np.divide(flat, norms, out=np.zeros_like(flat), where=norms > 0)


def best_columns(scores: np.ndarray, k: int) -> np.ndarray:
    """Column numbers of the ``k`` largest scores of each row, largest first, ties to the smaller number."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    width = scores.shape[1]
    if k < width:
        last = np.partition(scores, width - k, axis=1)[:, width - k, None]
        above, equal = scores > last, scores == last
        room = k - above.sum(axis=1, keepdims=True)
        chosen = above | (equal & (np.cumsum(equal, axis=1) <= room))
        columns = np.nonzero(chosen)[1].reshape(len(scores), k)
    else:
        columns = np.broadcast_to(np.arange(width), scores.shape)
    order = np.argsort(-np.take_along_axis(scores, columns, axis=1), axis=1, kind="stable")
    return np.take_along_axis(columns, order, axis=1)


def nearest_centres(units: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each unit row and the angle to it; a zero or undefined row counts as all around the centre."""
    step = max(1, _MAX_SCORES // len(centres))
    centre, angle = np.zeros(len(units), np.int32), np.full(len(units), math.pi)
    for at in range(0, len(units), step):
        block = units[at:at + step]
        similar = block @ centres.T
        similar = np.where(np.isnan(similar), -1.0, similar)
        best = similar.argmax(axis=1)
        known = np.isfinite(block).all(axis=1) & block.any(axis=1)
        value = np.clip(similar[np.arange(len(block)), best], -1.0, 1.0)
        centre[at:at + step] = best
        angle[at:at + step] = np.where(known, np.arccos(value), math.pi)
    return centre, angle


def cell_bounds(units: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Largest similarity that each unit row can have with a phrase of each cell; a zero row has similarity 0 with all."""
    angles = np.arccos(np.clip(units @ centres.T, -1.0, 1.0))
    bounds = np.cos(np.maximum(0.0, angles - radii)) + _SLACK
    return np.where(units.any(axis=1, keepdims=True), bounds, _SLACK)


def _place(library: DataFrame, centres, dim: int) -> DataFrame:
    @F.arrow_udf("struct<centre: int, angle: double>")
    def place(lists: pa.Array) -> pa.Array:
        centre, angle = nearest_centres(unit_rows(lists, dim), centres.value)
        return pa.StructArray.from_arrays([pa.array(centre), pa.array(angle)], names=["centre", "angle"])

    return library.withColumn("_at", place(F.col("vector"))).select("*", "_at.centre", "_at.angle").drop("_at")


def _visits(queries: DataFrame, centres, cells, dim: int, weight: float, first: bool) -> DataFrame:
    """One row per answer and block to visit: the blocks of its best cell, or of the other cells its ``floor`` leaves open."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cells.value
        per_yield = max(1, _OUT_BYTES // (dim * 8))
        for batch in batches:
            units = unit_rows(batch.column("vector"), dim)
            names = np.array(batch.column("column").to_pylist(), dtype=object)
            moods = np.array(batch.column("mood").to_pylist(), dtype=object)
            floors = batch.column("floor").to_numpy(zero_copy_only=False)
            kept = batch.select(["k1", "k2", "column", "mood", "vector"])
            for name in set(names):
                if name not in table:
                    continue
                ids, radii, parts = table[name]
                rows_of = np.flatnonzero(names == name)
                step = max(1, _MAX_SCORES // len(ids))
                for at in range(0, len(rows_of), step):
                    rows = rows_of[at:at + step]
                    bounds = cell_bounds(units[rows], centres.value[ids], radii) + weight * (moods[rows] != "")[:, None]
                    best = np.where(np.isnan(bounds), -np.inf, bounds).argmax(axis=1)
                    is_best = np.arange(len(ids)) == best[:, None]
                    # Also a row that cannot reach its floor anywhere is left out here.
                    row, cell = np.nonzero((bounds >= floors[rows][:, None]) & (is_best == first))
                    times = parts[cell]
                    ends = np.cumsum(times)
                    part = np.arange(times.sum()) - np.repeat(ends - times, times)
                    row, centre = np.repeat(rows[row], times), np.repeat(ids[cell], times)
                    for i in range(0, len(row), per_yield):
                        out = kept.take(pa.array(row[i:i + per_yield]))
                        yield pa.RecordBatch.from_arrays(
                            [*out.columns, pa.array(centre[i:i + per_yield], pa.int32()), pa.array(part[i:i + per_yield], pa.int32())],
                            names=[*out.schema.names, "centre", "part"],
                        )

    return queries.mapInArrow(visit, _VISITS)


def _meet(visits: DataFrame, blocks: DataFrame, copies: int, dim: int, threshold: float, top_k: int, weight: float) -> DataFrame:
    """The best candidates of every visit: phrases of a block first, then the answers that visit it."""
    no_label = [F.lit(None).cast("string").alias(c) for c in _LABELS]
    phrases = blocks.select(
        "column", "centre", "part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"),
        F.lit(None).cast("bigint").alias("k1"), F.lit(None).cast("bigint").alias("k2"), F.lit(None).cast("string").alias("mood"),
        "vector", "phrase_idx", *_LABELS,
    )
    answers = visits.select(
        "column", "centre", "part", F.pmod(F.col("k1"), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("kind"),
        "k1", "k2", "mood", "vector", F.lit(None).cast("int").alias("phrase_idx"), *no_label,
    )
    place = ["column", "centre", "part", "copy"]
    met = phrases.unionByName(answers).repartition(*place).sortWithinPartitions(*place, "kind", "phrase_idx")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, pieces, block = None, [], None
        for batch in batches:
            where = list(zip(*[batch.column(c).to_pylist() for c in place], strict=True))
            kinds = batch.column("kind").to_numpy()
            starts = [i for i in range(len(where)) if i == 0 or where[i] != where[i - 1] or kinds[i] != kinds[i - 1]]
            for start, end in zip(starts, [*starts[1:], len(where)], strict=True):
                run = batch.slice(start, end - start)
                if where[start] != here:
                    here, pieces, block = where[start], [], None
                if kinds[start] == 0:
                    pieces.append(run)
                    continue
                if not pieces:
                    continue
                if block is None:
                    held = pa.Table.from_batches(pieces).combine_chunks()
                    polarity = np.array(held.column("polarity").to_pylist(), dtype=object)
                    vectors = np.concatenate([unit_rows(p.column("vector"), dim) for p in pieces])
                    block = held.select(["phrase_idx", *_LABELS]), polarity, vectors
                found = _matches(run, *block)
                if found.num_rows:
                    yield from found.to_batches()

    def _matches(run: pa.RecordBatch, labels: pa.Table, polarity: np.ndarray, vectors: np.ndarray) -> pa.Table:
        units = unit_rows(run.column("vector"), dim)
        moods = np.array(run.column("mood").to_pylist(), dtype=object)
        either, signed = polarity == "Either", np.isin(polarity, ["Positive", "Negative"])
        rows, picks, values = [], [], []
        step = max(1, _MAX_SCORES // len(vectors))
        for at in range(0, len(units), step):
            scores = units[at:at + step] @ vectors.T
            mood = moods[at:at + step][:, None]
            if weight > 0:
                scores = scores + weight * ((mood != "") & (either | (signed & (polarity == mood))))
            scores = np.round(scores, _RANK_DECIMALS)
            best = best_columns(scores, top_k)
            best_scores = np.take_along_axis(scores, best, axis=1)
            row, rank = np.nonzero(best_scores >= threshold)
            rows.append(row + at)
            picks.append(best[row, rank])
            values.append(best_scores[row, rank])
        asked = run.select(["k1", "k2"]).take(pa.array(np.concatenate(rows)))
        hit = labels.take(pa.array(np.concatenate(picks)))
        columns = {n: hit.column(n) for n in hit.column_names} | {
            "k1": asked.column(0), "k2": asked.column(1), "score": pa.array(np.concatenate(values)),
        }
        names = [f.split()[0] for f in _FOUND.split(", ")]
        return pa.table([columns[n] for n in names], names=names)

    return met.mapInArrow(match, _FOUND)


def _best(found: DataFrame, top_k: int) -> DataFrame:
    order = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "phrase_idx")
    return found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top_k)


def add_blocked_candidates(
    df: DataFrame,
    library: DataFrame,
    candidates: str,
    threshold: float,
    top_k: int,
    weight: float,
    vector: str,
    mood: Column,
    phrases: int,
    columns: int,
    dim: int,
    block_bytes: int,
) -> DataFrame:
    """``df`` with ``candidates`` (an array of the type given), the same as from a broadcast matrix.

    ``phrases``, ``columns`` and ``dim`` are the library's numbers of rows, text columns and vector components. Equal answers are
    matched once. Rows without a vector get null; rows without a text column, or with one the library lacks, an empty array.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    block_rows = max(1, min(block_bytes, MAX_BLOCK_BYTES) // (dim * 8))
    text_column, feeling = F.col("TextColumn"), F.coalesce(mood, F.lit(""))
    asks = F.col(vector).isNotNull() & text_column.isNotNull()
    keys = [F.when(asks, F.xxhash64(*seed, text_column, feeling, vector)) for seed in ([], [F.lit("answer")])]
    keyed = df.withColumns({"_k1": keys[0], "_k2": keys[1]})
    queries = (
        keyed.filter("_k1 IS NOT NULL")
        .groupBy(F.col("_k1").alias("k1"), F.col("_k2").alias("k2"))
        .agg(
            F.first(text_column).alias("column"), F.first(feeling).alias("mood"),
            F.first(F.col(vector).cast("array<double>")).alias("vector"),
        )
        .checkpoint()
    )
    copies = max(1, math.ceil(queries.count() / _ANSWERS_PER_COPY))

    labelled = library.select(
        "phrase_idx", "column", F.col("vector").cast("array<double>").alias("vector"), "theme", "subtheme",
        F.col("parent").alias("parent_theme"), "polarity", F.col("phrase").alias("matched_phrase"),
    ).filter("column IS NOT NULL")
    wanted = min(MAX_CENTRES, math.ceil(phrases / block_rows), MAX_CENTRE_BYTES // (dim * 8), MAX_CELLS // max(1, columns))
    sample = labelled.orderBy(F.xxhash64("phrase_idx"), "phrase_idx").limit(max(1, wanted)).select("vector").toArrow()
    centres = spark.sparkContext.broadcast(
        np.nan_to_num(np.concatenate([unit_rows(c, dim) for c in sample.column("vector").chunks]))
    )
    placed = _place(labelled, centres, dim).checkpoint()
    cells = placed.groupBy("column", "centre").agg(
        F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts")
    )
    by_column = {
        name: (rows["centre"].to_numpy(), rows["radius"].to_numpy(), rows["parts"].to_numpy())
        for name, rows in cells.toPandas().groupby("column")
    }
    bounds = spark.sparkContext.broadcast(by_column)
    blocks = placed.join(F.broadcast(cells.drop("radius")), ["column", "centre"]).withColumn(
        "part", F.pmod(F.xxhash64("phrase_idx"), F.col("parts")).cast("int")
    )

    start = queries.withColumn("floor", F.lit(float(threshold)))
    first = _best(_meet(_visits(start, centres, bounds, dim, weight, True), blocks, copies, dim, threshold, top_k, weight), top_k)
    first = first.drop("rn").checkpoint()
    floors = first.groupBy("k1", "k2").agg(F.when(F.count(F.lit(1)) >= top_k, F.min("score")).alias("_last"))
    again = queries.join(floors, ["k1", "k2"], "left").withColumn(
        "floor", F.greatest(F.lit(float(threshold)), F.coalesce("_last", F.lit(float(threshold))))
    ).drop("_last")
    rest = _meet(_visits(again, centres, bounds, dim, weight, False), blocks, copies, dim, threshold, top_k, weight)
    one = F.struct("phrase_idx", "theme", "subtheme", "parent_theme", "score", "polarity", "matched_phrase")
    results = _best(first.unionByName(rest), top_k).groupBy("k1", "k2").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", one.alias("c")))), lambda r: r["c"]).cast(candidates).alias("_found")
    )
    # An answer that a third of all rows give is met in several places.
    spread = results.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(_COPIES_OF_RESULTS - 1)))).select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "_copy", "_found"
    )
    joined = keyed.withColumn("_copy", F.pmod(F.spark_partition_id(), F.lit(_COPIES_OF_RESULTS))).join(
        spread, ["_k1", "_k2", "_copy"], "left"
    )
    value = F.when(F.col(vector).isNotNull(), F.coalesce("_found", F.array().cast(candidates)))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != "candidates"], value.alias("candidates"))
