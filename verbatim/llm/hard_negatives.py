"""Hard negatives by a vertical scan with branch-and-bound on dimensions (BOND).

Vectors are scaled to integers, so every score is exact. A block of rows is kept by column: one array per dimension, with its
least and greatest value. An anchor reads the columns in the descending order of its own magnitudes and adds up partial
scores. What the unread columns can still add lies between sums of their least and greatest contributions; rows that
cannot reach what is asked for any more leave the candidate bitmap, and the columns read next are read for the rest only.

Two scans over all rows: the first asks each anchor's best rows of its own label (the positives), the second, for every positive,
the best rows of other labels inside the window that the positive's score sets. The bound is the running result of
the task: a task takes a block of anchors and streams its part of the rows, holding one block at a time, and lets out only
``positives`` or ``negatives`` rows per anchor and window. The number of parts is fixed, so rows that leave grow with the anchors.
Anchors are a stated query set that meets all rows in blocks.

Defined results: rows without an id or label, with a null vector or a null or non-finite component take no part; shorter vectors
count as zero in missing places; rows with the anchor's id are never its positives or negatives; repeated rows count each,
but of anchors with one id the one of the least label and vector is taken; ties go to the smaller id; an anchor without a positive, and
a window without a row, give no row; an empty table gives an empty one; other columns are left alone. Scores must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatim.llm.common import pieces, stored


@dataclass(frozen=True)
class Mining:
    """Percentages bound a negative's score by its positive's; the rest sets the size of blocks."""

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95
    anchors_per_block: int = 16_384
    parts: int = 16
    rows_per_block: int = 8_192
    columns_per_step: int = 8


def integer_vectors(table: DataFrame, key: str, vector: str, label: Column, settings: Mining) -> DataFrame:
    """(id, label, v): the rows that take part."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(settings.scale))))
    rows = table.select(F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("x"), whole.alias("v"), fine.alias("fine"))
    return rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("fine")).select("id", "label", "v")


class Block:
    """Rows by column, sorted by label, with the least and greatest value of every column."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, width: int):
        order = np.argsort(labels, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        wide = np.zeros((len(ids), width), dtype=np.int64)
        wide[:, : min(width, matrix.shape[1])] = matrix[order, :width]
        self.most = max(1, int(np.abs(wide).max(initial=0)))
        self.columns = np.ascontiguousarray(wide.T)
        self.doubles = self.columns.astype(np.float64)
        self.least, self.greatest = wide.min(axis=0), wide.max(axis=0)

    def columns_for(self, anchor: np.ndarray) -> np.ndarray:
        """Doubles are faster, and exact while no sum of products can reach 2**53."""
        return self.doubles if self.most * int(np.abs(anchor).sum()) < 2**52 else self.columns


def bond(anchor: np.ndarray, block: Block, rows: slice, keep, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the rows of the block that ``keep(places, lower, upper)`` lets through to the end."""
    columns = block.columns_for(anchor)
    order = np.argsort(-np.abs(anchor), kind="stable")
    order = order[anchor[order] != 0]
    a, b = anchor[order] * block.least[order], anchor[order] * block.greatest[order]
    zero = np.zeros(1, dtype=np.int64)
    rest_low = np.concatenate([np.cumsum(np.minimum(a, b)[::-1])[::-1], zero])
    rest_high = np.concatenate([np.cumsum(np.maximum(a, b)[::-1])[::-1], zero])
    places = np.arange(rows.start, rows.stop)
    score = np.zeros(len(places), dtype=columns.dtype)
    whole = True
    for start in range(0, len(order) + 1, step):
        ok = keep(places, score + rest_low[start], score + rest_high[start])
        if not ok.all():
            places, score, whole = places[ok], score[ok], False
            if not len(places):
                break
        for j in order[start : start + step]:
            column = columns[j]
            score = score + (column[rows] if whole else column[places]) * anchor[j]
    ok = keep(places, score, score)
    return places[ok], score[ok].astype(np.int64)


class Best:
    """The best ``k`` of what was offered: higher scores first, ties by smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.ids = self.scores = np.empty(0, dtype=np.int64)

    @property
    def bound(self) -> float:
        """Below this nothing can enter any more."""
        return -np.inf if len(self.ids) < self.k else self.scores[-1]

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids) > 4 * self.k + 64:
            cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= cut], scores[scores >= cut]
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


class Positives:
    """The scan for the best rows of the anchors' own labels."""

    SCHEMA = "anchor_id long, id long, score long"

    def __init__(self, ids, labels, matrix, extra, settings: Mining):
        self.ids, self.labels, self.matrix, self.settings = ids, labels, matrix, settings
        self.best = [Best(settings.positives) for _ in ids]

    def feed(self, block: Block) -> None:
        starts = np.searchsorted(block.labels, self.labels, "left")
        stops = np.searchsorted(block.labels, self.labels, "right")
        for i, best in enumerate(self.best):
            if starts[i] == stops[i]:
                continue

            def keep(places, low, high, i=i, best=best):
                return (high >= best.bound) & (block.ids[places] != self.ids[i])

            places, scores = bond(self.matrix[i], block, slice(starts[i], stops[i]), keep, self.settings.columns_per_step)
            if len(places):
                best.offer(block.ids[places], scores)

    def result(self) -> pa.RecordBatch:
        anchors = np.repeat(self.ids, [len(b.ids) for b in self.best])
        found = [np.concatenate([getattr(b, name) for b in self.best]) for name in ("ids", "scores")]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (anchors, *found)], ["anchor_id", "id", "score"])


class Negatives:
    """The scan for the best rows of other labels inside the windows of the positives' scores."""

    SCHEMA = "anchor_id long, place int, id long, score long"

    def __init__(self, ids, labels, matrix, extra, settings: Mining):
        self.ids, self.labels, self.matrix, self.settings = ids, labels, matrix, settings
        self.windows = []
        for scores in extra:
            ends = [(-(-settings.low * p // 100), settings.high * p // 100) for p in scores]
            self.windows.append([(low, high, Best(settings.negatives)) for low, high in ends])

    def feed(self, block: Block) -> None:
        everything = slice(0, len(block.ids))
        for i, windows in enumerate(self.windows):
            open_windows = [w for w in windows if w[0] <= w[1]]
            if not open_windows:
                continue

            def keep(places, low, high, i=i, open_windows=open_windows):
                ok = np.zeros(len(places), dtype=bool)
                for least, most, best in open_windows:
                    ok |= (high >= max(least, best.bound)) & (low <= most)
                return ok & (block.labels[places] != self.labels[i]) & (block.ids[places] != self.ids[i])

            places, scores = bond(self.matrix[i], block, everything, keep, self.settings.columns_per_step)
            for least, most, best in open_windows:
                inside = (scores >= least) & (scores <= most)
                if inside.any():
                    best.offer(block.ids[places[inside]], scores[inside])

    def result(self) -> pa.RecordBatch:
        rows = [(a, place, n, s) for a, windows in zip(self.ids.tolist(), self.windows, strict=True) for place, w in enumerate(windows, 1) for n, s in zip(w[2].ids.tolist(), w[2].scores.tolist(), strict=True)]
        kinds = zip(("anchor_id", "place", "id", "score"), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)], ["anchor_id", "place", "id", "score"])


def matrix_of(lists: pa.Array) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    if len(flat) == width * len(sizes):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def stacked(pieces: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    table = pa.Table.from_batches(pieces).combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    ids, labels = (column(n).to_numpy(zero_copy_only=False) for n in ("id", "label"))
    return ids, labels, matrix_of(column("v")), column("extra").to_pylist()


def scan(batches: Iterator[pa.RecordBatch], make, settings: Mining) -> Iterator[pa.RecordBatch]:
    """Groups lie one after the other, a group's anchors before its rows; one group's anchors and one block are held."""
    group, anchors, waiting, state = None, [], [], None

    def fed(state):
        if waiting:
            if state is None and anchors:
                state = make(*stacked(anchors), settings)
            if state is not None:
                ids, labels, matrix, _ = stacked(waiting)
                state.feed(Block(ids, labels, matrix, max(state.matrix.shape[1], matrix.shape[1])))
            waiting.clear()
        return state

    for (block, part, kind), piece in pieces(batches, ["anchor_block", "part", "kind"]):
        if (block, part) != group:
            state = fed(state)
            if state is not None:
                yield state.result()
            group, state = (block, part), None
            anchors.clear()
        (waiting if kind else anchors).append(piece)
        if sum(p.num_rows for p in waiting) >= settings.rows_per_block:
            state = fed(state)
    state = fed(state)
    if state is not None:
        yield state.result()


def scanned(anchors: DataFrame, rows: DataFrame, blocks: int, make, settings: Mining) -> DataFrame:
    """Every block of anchors meets every part of the rows: an anchor travels once a part, a row once a block of anchors."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = anchors.select(dealt(blocks).alias("anchor_block"), spread(settings.parts).alias("part"), F.lit(0).alias("kind"), "id", "label", "v", "extra")
    none = F.lit(None).cast("array<long>")
    # ``rows`` is a stored table, whose splits and so the numbers are the same in every run of a task.
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(settings.parts)).cast("int")
    right = rows.select(part.alias("part"), "id", "label", "v").select(spread(blocks).alias("anchor_block"), "part", F.lit(1).alias("kind"), "id", "label", "v", none.alias("extra"))
    together = left.unionByName(right).repartition(blocks * settings.parts, "anchor_block", "part")
    together = together.sortWithinPartitions("anchor_block", "part", "kind")
    return together.mapInArrow(lambda batches: scan(batches, make, settings), make.SCHEMA)


def ranked(found: DataFrame, group: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(table: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, settings: Mining | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchors`` is a condition on ``id``."""
    settings = settings or Mining()
    rows = stored(integer_vectors(table, key, vector, F.col("label") if label is None else label, settings), "vectors")
    chosen = rows.filter(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("first"))
    chosen = stored(chosen.select("id", "first.label", "first.v"), "anchors")
    blocks = max(1, -(-chosen.count() // settings.anchors_per_block))

    none = F.lit(None).cast("array<long>")
    found = scanned(chosen.withColumn("extra", none), rows, blocks, Positives, settings)
    positives = stored(ranked(found, ["anchor_id"], settings.positives).withColumnRenamed("rank", "place"), "positives")
    scores = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("s"))
    scores = scores.select(F.col("anchor_id").alias("id"), F.col("s.score").alias("extra"))
    found = scanned(chosen.join(scores, "id"), rows, blocks, Negatives, settings)
    best = ranked(found, ["anchor_id", "place"], settings.negatives)
    best = best.select("anchor_id", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = positives.join(best, ["anchor_id", "place"])
    return out.select("anchor_id", F.col("id").alias("positive_id"), "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
