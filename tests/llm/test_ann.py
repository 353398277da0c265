import numpy as np
from pyspark.sql import functions as F

from verbatim.llm import ann


def table(spark, ids, vectors):
    rows = [(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], "x", 0.5, 1) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string, score double, rank int")


def brute(ids, x, q, k=20):
    scores = np.zeros(len(x))
    for j in range(x.shape[1]):
        scores += x[q, j] * x[:, j]
    order = [i for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]


def clustered(rng, n, dim=16):
    return (rng.normal(size=(12, dim))[rng.integers(12, size=n)] + 0.4 * rng.normal(size=(n, dim))).astype(np.float32).astype(float)


def found(df, **settings):
    out = ann.search(df, F.col("vec_id") % 20 == 0, ann.Settings(**settings)).collect()
    by: dict = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(by.setdefault(r.query_id, [])) + 1
        by[r.query_id].append((r.vec_id, r.score))
    return by


def test_recall_of_the_tree_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x, ids = clustered(rng, 3000), np.arange(3000)
    x[500:700] = x[500]  # many copies of one vector: exact ties, a leaf of its own, several parts
    x[700] = (40 * x[700]).astype(np.float32)
    by = found(table(spark, ids, x), leaf_rows=40, parts=12, block_queries=16, probes=64)
    hits = total = 0
    for q in range(0, 3000, 20):
        want = brute(ids, x, q)
        scores = dict(brute(ids, x, q, 3000))
        assert all(scores[i] == s for i, s in by[q])
        assert by[q] == sorted(by[q], key=lambda p: (-p[1], p[0])) and len(by[q]) == 20
        hits += len({s for _, s in by[q]} & {s for _, s in want}) if len({s for _, s in want}) == 1 else len(set(by[q]) & set(want))
        total += 1 if len({s for _, s in want}) == 1 else 20
    assert hits / total >= 0.9


def test_small_table_is_exact_and_odd_rows_take_no_part(spark):
    rng = np.random.default_rng(4)
    x = clustered(rng, 60, 4)
    ids = list(range(60))
    odd = [(100, None), (120, []), (140, [0, 0, 0, 0]), (160, [1, None, 0, 0]), (180, [float("nan"), 1, 1, 1]), (200, [float("inf"), 1, 1, 1]), (220, [1.0, 2.0]), (None, [1, 1, 1, 1])]
    df = table(spark, ids + [i for i, _ in odd] + [5], [*x, *[v for _, v in odd], x[5]])
    by = found(df)
    x2, ids2 = np.vstack([x, x[5]]), np.array([*ids, 5])
    assert set(by) == {0, 20, 40}
    for q in by:
        assert by[q] == brute(ids2, x2, q)


def test_few_and_no_rows(spark):
    by = found(table(spark, [0, 1, 2], [[1, 0], [0, 1], [1, 1]]))
    assert by == {0: [(2, 1.0), (1, 0.0)]}
    assert found(table(spark, [0], [[1, 0]])) == {}
    assert found(table(spark, [], [])) == {}
