import math
import random

import numpy as np
from pyspark.sql import functions as F

from verbatim.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score string, part int, extra string, v int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "e", 2) for r in rows], SCHEMA)


def brute(rows, anchors, s):
    good = [(i, [math.floor(s.scale * float(np.float32(x))) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    first = {}
    for i, v, y in good:
        if anchors(i):
            first[i] = min(first.get(i, (y, v)), (y, v))
    out = []
    for a, (y, v) in first.items():
        scored = [(-dot(v, w), i, z) for i, w, z in good if i != a]
        for p, i, _ in sorted(x for x in scored if x[2] == y)[: s.positives]:
            p = -p
            near = sorted((n, j) for n, j, z in scored if z != y and s.low * p <= -100 * n <= s.high * p)
            out += [(a, i, r, j, p, -n) for r, (n, j) in enumerate(near[: s.negatives], 1)]
    return sorted(out)


def check(spark, rows, **settings):
    s = hn.Mining(**settings)
    got = hn.mine(table(spark, rows), F.col("id") % 5 == 0, settings=s)
    found = sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert found == brute(rows, lambda i: i % 5 == 0, s)
    return found


def made(n, dim, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    return [(i, [float(np.float32(x)) for x in centres[i % labels] * 0.6 + rng.normal(size=dim) * 0.5], i % labels) for i in range(n)]


def test_all_anchors_against_brute_force(spark):
    rows = made(400, 12, 3)
    # Copies tie exactly, also across labels.
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(40)] + [(2001 + i, rows[5][1], 9) for i in range(9)]
    assert check(spark, rows)
    assert check(spark, rows, rows_per_block=64, anchors_per_block=20, parts=3, columns_per_step=5)


def test_rows_that_take_no_part_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(60, 4, 8) + [(5, None, 1), (10, [1.0, None, 0.0, 0.0], 1), (None, [1.0] * 4, 1), (15, [nan] * 4, 2), (20, [inf, 0.0, 0.0, 0.0], 3), (25, [1.0] * 4, None)]
    rows += [(500, [], 1), (501, [1.0], 1), (502, [0.0] * 4, 2), (30, [0.5] * 4, 0), (30, [0.5] * 4, 0), (77, [0.4] * 4, 3), (77, [0.4] * 4, 3)]
    check(spark, rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-(2**20), 2**20)) * 8 for _ in range(6)], i % 2) for i in range(80)]
    check(spark, rows, scale=2)


def test_no_rows_and_no_positives(spark):
    assert check(spark, []) == []
    assert check(spark, [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)]) == []


def test_the_scan_prunes(spark):
    """Most rows leave the candidate set before their last column."""
    ids = np.arange(500)
    rng = np.random.default_rng(1)
    matrix = np.rint(rng.normal(size=(500, 32)) * 100 * np.linspace(4, 0.1, 32)).astype(np.int64)
    block = hn.Block(ids, np.zeros(500, np.int64), matrix, 32)
    seen = []
    best = hn.Best(3)
    exact = matrix @ matrix[0]
    best.offer(ids[:250], exact[:250])

    def keep(places, low, high):
        seen.append(len(places))
        assert (low <= exact[block.ids[places]]).all() and (exact[block.ids[places]] <= high).all()
        return high >= best.bound

    places, scores = hn.bond(matrix[0], block, slice(0, 500), keep, 4)
    assert (scores == exact[block.ids[places]]).all()
    assert set(ids[exact >= best.bound]) == set(block.ids[places])
    assert seen[-1] < 50 and sum(seen) < 0.6 * 500 * len(seen)
