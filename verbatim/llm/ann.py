"""Approximate nearest neighbours by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then put into a leaf. A query walks the tree through a priority queue:
the best open node is popped, a leaf is visited, an inner node puts its children into the queue. A node's priority is the
inner product with its centre plus what its spread lets its best member be above that. How many leaves to visit is
calibrated: for a bounded set of queries the true neighbours are found by brute force, and the visits are widened until
the wanted share of them lies in a visited leaf.

Neighbouring leaves form a part, of which there are a fixed number whatever the rows; a leaf that holds more than a part (copies
of one vector, say) is split over several. Queries whose best leaves are near form a block of bounded size. A task streams
the leaves of one part past one block: it holds the block and the rows of one batch, each query meets only the leaves that
it visits, and its running k-th best score is the bound that rows must reach. A task lets out ``k`` rows per query at
most, so the rows that leave grow with the queries and not with the rows searched. Scores are sums over the components in their order, in double precision, so copies tie exactly.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without
an id and vectors of another length than the most frequent one; rows with the query's id are never its neighbours; repeated
rows are neighbours each; ties go to the smaller id; a table with fewer candidates returns all of them, an empty one no
row; other columns are left alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verbatim.llm.common import pieces, stored


@dataclass(frozen=True)
class Settings:
    """``sample`` rows at most fit the tree, which has ``leaves`` leaves at most; ``probes`` queries calibrate it."""

    k: int = 20
    recall: float = 0.96
    branch: int = 8
    leaf_rows: int = 160
    leaves: int = 8192
    sample: int = 65_536
    iterations: int = 8
    probes: int = 256
    parts: int = 16
    block_queries: int = 16_384
    seed: int = 11


@dataclass
class Tree:
    """Nodes in depth-first order. ``leaf[n]`` is a leaf's number, or -1; ``children[n]`` of a leaf is empty."""

    centres: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: down the tree to the nearest centre."""
        out = np.empty(len(x), np.int64)
        open_nodes = [(0, np.arange(len(x)))]
        while open_nodes:
            node, rows = open_nodes.pop()
            below = self.children[node]
            if not below:
                out[rows] = self.leaf[node]
                continue
            centres = self.centres[below]
            nearest = np.argmin((centres**2).sum(axis=1) - 2 * x[rows] @ centres.T, axis=1)
            open_nodes += [(n, rows[nearest == i]) for i, n in enumerate(below) if (nearest == i).any()]
        return out

    def visits(self, q: np.ndarray, leaves: int, sizes: np.ndarray, least: int) -> list[list[int]]:
        """For each query the first ``leaves`` leaves, best bin first, and more until they hold ``least`` rows."""
        priority = q @ self.centres.T + np.linalg.norm(q, axis=1)[:, None] * self.spread
        out = []
        for row in (-priority).tolist():
            queue, found, rows = [(row[0], 0)], [], 0
            while queue and (len(found) < leaves or rows < least):
                _, node = heapq.heappop(queue)
                if below := self.children[node]:
                    for n in below:
                        heapq.heappush(queue, (row[n], n))
                else:
                    leaf = int(self.leaf[node])
                    found.append(leaf)
                    rows += int(sizes[leaf])
            out.append(found)
        return out


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        n = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def build(x: np.ndarray, leaves: int, s: Settings) -> Tree:
    rng = np.random.default_rng(s.seed)
    centres, spread, children, leaf = [], [], [], []
    count = 0

    def grow(rows: np.ndarray, want: int) -> int:
        nonlocal count
        own = x[rows]
        node = len(centres)
        centres.append(own.mean(axis=0))
        # The best of a leaf's members lies some two standard deviations, along the query, above the centre.
        spread.append(2 * np.sqrt(((own - centres[-1]) ** 2).sum(axis=1).mean() / x.shape[1]))
        children.append([])
        leaf.append(-1)
        k = min(s.branch, want, len(rows))
        if k > 1:
            nearest = _k_means(own, k, s.iterations, rng)
            groups = [rows[nearest == i] for i in range(k) if (nearest == i).any()]
            if len(groups) > 1:
                for g in groups:
                    children[node].append(grow(g, max(1, round(want * len(g) / len(rows)))))
        if not children[node]:
            leaf[node], count = count, count + 1
        return node

    grow(np.arange(len(x)), max(1, leaves))
    return Tree(np.array(centres), np.array(spread), children, np.array(leaf))


# ---- scoring -------------------------------------------------------------------------------------------------------


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed component by component: equal vectors get equal scores."""
    total = q[:, 0] * x[:, 0]
    for j in range(1, q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, bound: np.ndarray | None = None):
    """Row numbers (query, vector) and scores of the ``k`` best of each query, the best first, ties by id.

    With a ``bound`` per query, only scores that reach it count.
    """
    rough = q @ x.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    # A matrix product may round copies of one vector differently, so the last place is judged with a margin.
    margin = 1e-9 * max(1e-300, float(np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(x, axis=1).max(initial=0)))
    last = np.full(len(q), -np.inf) if bound is None else bound
    if x.shape[0] > k:
        last = np.maximum(last, np.partition(rough, x.shape[0] - k, axis=1)[:, x.shape[0] - k])
    a, b = np.nonzero((rough >= (last - margin)[:, None]) & (rough > -np.inf))
    score = exact_scores(q[a], x[b])
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    return a[rank < k], b[rank < k], score[rank < k]


class Block:
    """Queries with the leaves they visit in one part, and their running best."""

    def __init__(self, pieces: list[pa.RecordBatch], dim: int, k: int):
        asked = pa.Table.from_batches(pieces).combine_chunks()
        self.ids, self.k = asked.column("vec_id").to_numpy(), k
        self.q = matrix(asked.column("vec").combine_chunks(), dim)
        lists = asked.column("leaves").combine_chunks()
        leaf = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(self.ids)), lists.value_lengths().to_numpy())
        order = np.argsort(leaf, kind="stable")
        self.leaf, self.owner = leaf[order], owner[order]
        self.found_ids = np.zeros((len(self.ids), k), np.int64)
        self.scores = np.full((len(self.ids), k), -np.inf)

    def feed(self, leaf: int, ids: np.ndarray, x: np.ndarray) -> None:
        """Rows of one leaf, seen by the queries that visit it."""
        visitors = self.owner[np.searchsorted(self.leaf, leaf) : np.searchsorted(self.leaf, leaf, "right")]
        for at in range(0, len(visitors), 2048):
            who = visitors[at : at + 2048]
            a, b, score = best(self.ids[who], self.q[who], ids, x, self.k, self.scores[who, -1])
            if not len(a):
                continue
            met, row = np.unique(a, return_inverse=True)
            row = np.concatenate([np.repeat(np.arange(len(met)), self.k), row])
            found = np.concatenate([self.found_ids[who[met]].ravel(), ids[b]])
            score = np.concatenate([self.scores[who[met]].ravel(), score])
            order = np.lexsort((found, -score, row))
            row, found, score = row[order], found[order], score[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < self.k
            self.found_ids[who[met][row[keep]], rank[keep]] = found[keep]
            self.scores[who[met][row[keep]], rank[keep]] = score[keep]

    def result(self) -> pa.RecordBatch:
        a, b = np.nonzero(self.scores > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(self.found_ids[a, b]), pa.array(self.scores[a, b])], ["query_id", "vec_id", "score"])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


# ---- Spark ---------------------------------------------------------------------------------------------------------


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, one of them not zero."""
    number = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    good = (F.size(vector) > 0) & F.forall(vector, lambda v: F.coalesce(number(v), F.lit(False))) & F.exists(vector, lambda v: v != 0)
    return F.coalesce(good, F.lit(False))


@dataclass
class Index:
    """``rows``: part, leaf, vec_id, vec. ``first`` and ``parts`` give each leaf's parts, ``sizes`` its rows."""

    tree: Tree
    rows: DataFrame
    dim: int
    sizes: np.ndarray
    first: np.ndarray
    parts: np.ndarray
    visits: int


def dealt(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves put one after the other into boxes of ``room``: the first box of each, and the number of boxes that it fills."""
    first, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    box, filled = 0, 0
    for leaf, size in enumerate(sizes.tolist()):
        if size > room:
            box += bool(filled)
            first[leaf], parts[leaf], filled = box, -(-size // room), 0
            box += int(parts[leaf])
        else:
            if filled + size > room:
                box, filled = box + 1, 0
            first[leaf], filled = box, filled + size
    return first, parts


def counted(rows: DataFrame, column: str, leaves: int) -> np.ndarray:
    """Rows per leaf; there are at most ``Settings.leaves`` leaves."""
    sizes = np.zeros(leaves, np.int64)
    for r in rows.groupBy(column).agg(F.count("*").alias("n")).collect():
        sizes[r[column]] = r["n"]
    return sizes


def boxes_table(rows: DataFrame, first: np.ndarray, parts: np.ndarray) -> DataFrame:
    """(leaf, first, parts), one row per leaf, to be broadcast."""
    places = pa.table({"leaf": np.arange(len(first)), "first": first, "parts": parts})
    return F.broadcast(rows.sparkSession.createDataFrame(places.to_pandas()))


def build_index(vectors: DataFrame, s: Settings, key: str, vector: str) -> Index | None:
    spark = vectors.sparkSession
    clean = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    clean = clean.filter(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    lengths = clean.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), "dim").first()
    if common is None:
        return None
    dim, n = common["dim"], common["n"]
    clean = clean.filter(F.size("vec") == dim)
    part = min(1_000_000, 1_000_000 * s.sample // n)
    drawn = F.pmod(F.xxhash64(F.lit(s.seed), "vec_id"), F.lit(1_000_000)) < part
    sample = clean.filter(drawn).toArrow().combine_chunks().sort_by("vec_id")
    x = matrix(sample.column("vec").combine_chunks(), dim) if sample.num_rows else np.zeros((1, dim))
    tree = build(x, min(s.leaves, n // s.leaf_rows), s)
    shared = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value.place(matrix(batch.column(1), dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], ["vec_id", "vec", "leaf"])

    rows = stored(clean.mapInArrow(placed, "vec_id bigint, vec array<double>, leaf bigint"), "ann-leaves")
    sizes = counted(rows, "leaf", tree.leaves)
    first, parts = dealt(sizes, -(-int(sizes.sum()) // s.parts))
    placed_rows = rows.join(boxes_table(rows, first, parts), "leaf")
    part = F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")
    index = Index(tree, placed_rows.select(part.alias("part"), "leaf", "vec_id", "vec"), dim, sizes, first, parts, 1)
    index.visits = calibrated(index, rows, s)
    return index


def top(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def calibrated(index: Index, rows: DataFrame, s: Settings) -> int:
    """Leaves to visit so that the wanted share of the true neighbours of the probes lies in them."""
    spark = rows.sparkSession
    total = int(index.sizes.sum())
    part = min(1_000_000, -(-1_000_000 * s.probes // max(total, 1)))
    probes = rows.filter(F.pmod(F.xxhash64(F.lit(s.seed + 1), "vec_id"), F.lit(1_000_000)) < part).select("vec_id", "vec").toArrow()
    if index.tree.leaves == 1 or not probes.num_rows:
        return index.tree.leaves
    probes = probes.combine_chunks().sort_by("vec_id").slice(0, 2 * s.probes)
    q_ids, q = probes.column("vec_id").to_numpy(), matrix(probes.column("vec").combine_chunks(), index.dim)
    shared = spark.sparkContext.broadcast((q_ids, q))
    dim, k = index.dim, s.k

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                own = batch.column(0).to_numpy()
                a, b, score = best(ids, queries, own, matrix(batch.column(1), dim), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a]), pa.array(own[b]), batch.column(2).take(pa.array(b)), pa.array(score)],
                    ["query_id", "vec_id", "leaf", "score"],
                )

    truth = top(rows.select("vec_id", "vec", "leaf").mapInArrow(nearest, "query_id bigint, vec_id bigint, leaf bigint, score double"), k)
    truth = truth.select("query_id", "leaf").toArrow()
    order = index.tree.visits(q, index.tree.leaves, index.sizes, 0)
    rank = {(int(i), leaf): r for i, leaves in zip(q_ids, order, strict=True) for r, leaf in enumerate(leaves)}
    needed = np.sort([rank[pair] for pair in zip(truth.column("query_id").to_pylist(), truth.column("leaf").to_pylist(), strict=True)])
    # Widen until the share is reached.
    return int(needed[min(len(needed) - 1, int(np.ceil(s.recall * len(needed))) - 1)]) + 1 if len(needed) else index.tree.leaves


def search(vectors: DataFrame, is_query: Column, s: Settings | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for every row of ``vectors`` for which ``is_query`` holds."""
    s = s or Settings()
    spark = vectors.sparkSession
    index = build_index(vectors, s, key, vector)
    if index is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim, k = index.dim, s.k
    shared = spark.sparkContext.broadcast((index.tree, index.sizes, index.first, index.parts, index.visits))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and part that it visits, with the leaves there and the query's first leaf."""
        tree, sizes, first, parts, visits = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows, places, leaves, homes = [], [], [], []
                for i, found in enumerate(tree.visits(matrix(batch.column(1), dim), visits, sizes, k + 1)):
                    by_part: dict[int, list[int]] = {}
                    for leaf in found:
                        for p in range(int(parts[leaf])):
                            by_part.setdefault(int(first[leaf]) + p, []).append(leaf)
                    rows += [i] * len(by_part)
                    places += by_part
                    leaves += by_part.values()
                    homes += [found[0]] * len(by_part)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places, pa.int64()), pa.array(homes, pa.int64()), batch.column(0).take(take), batch.column(1).take(take), pa.array(leaves, pa.list_(pa.int64()))],
                    ["part", "home", "vec_id", "vec", "leaves"],
                )

    queries = index.rows.filter(is_query).select("vec_id", "vec").dropDuplicates(["vec_id"])
    queries = stored(queries.mapInArrow(visited, "part bigint, home bigint, vec_id bigint, vec array<double>, leaves array<bigint>"), "ann-queries")
    homes = counted(queries.select("home", "vec_id").distinct(), "home", index.tree.leaves)
    places = boxes_table(queries, *dealt(homes, s.block_queries)).withColumnRenamed("leaf", "home")
    block = F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts")
    left = queries.join(places, "home").select(block.alias("block"), "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("leaf"), "vec_id", "vec", "leaves")
    # The blocks that visit a part: a row per block and part at most.
    asked = F.broadcast(left.select("block", "part").distinct())
    none = F.lit(None).cast("array<bigint>")
    right = index.rows.join(asked, "part").select("block", "part", F.lit(1).alias("kind"), "leaf", "vec_id", "vec", none.alias("leaves"))
    blocks = int(-(-homes.sum() // s.block_queries))
    together = left.unionByName(right).repartition(max(1, blocks) * s.parts, "block", "part").sortWithinPartitions("block", "part", "kind", "leaf")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, waiting, state = None, [], None
        for (block, part, kind, leaf), piece in pieces(batches, ["block", "part", "kind", "leaf"]):
            if (block, part) != group:
                if state is not None:
                    yield state.result()
                group, waiting, state = (block, part), [], None
            if not kind:
                waiting.append(piece)
                continue
            if state is None:
                state = Block(waiting, dim, k)
            state.feed(leaf, piece.column("vec_id").to_numpy(), matrix(piece.column("vec"), dim))
        if state is not None:
            yield state.result()

    found = together.mapInArrow(nearest, "query_id bigint, vec_id bigint, score double")
    return top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
