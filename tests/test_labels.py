import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatim.operators import labels as lb

SCHEMA = "id long, v array<double>, l array<string>, `a.b` string"


def fold(i):
    return int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 10


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    middles = rng.normal(size=(3, 4)) * 2
    out = []
    for i in range(240):
        own = rng.random(3) < 0.5
        v = (middles[own].sum(axis=0) + rng.normal(size=4) * 0.3).tolist()
        out.append((i, v, [f"t{j}" for j in range(3) if own[j]] + ([None] if i % 9 == 0 else []), "x"))
    # Nothing to learn from, or no label at all.
    return out + [(240, None, ["t0"], None), (241, [0.0] * 4, None, None), (242, [0.0] * 4, [], None), (None, [1.0] * 4, ["t1"], None)]


def truth(row, names):
    return np.array([n in (row[2] or []) for n in names], float)


def brute_weights(train, names, rounds):
    x = np.array([[*r[1], 1.0] for r in train if r[1] is not None])
    y = np.array([truth(r, names) for r in train if r[1] is not None])
    w = np.zeros((len(names), x.shape[1]))
    rate = 4.0 / np.mean((x * x).sum(axis=1))
    for _ in range(rounds):
        w = w - rate / len(x) * (1 / (1 + np.exp(-x @ w.T)) - y).T @ x
    return w


def test_training_and_judging_against_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    model, table = lb.train_and_judge(df, "id", "v", "l", rounds=25)
    keyed = [r for r in rows if r[0] is not None]
    weights = brute_weights([r for r in keyed if fold(r[0]) > 3], ["t0", "t1", "t2"], 25)
    assert model.labels == ["t0", "t1", "t2"]
    assert np.allclose(model.weights, weights, atol=1e-9)

    def counts(part, at, j):
        own = [r for r in keyed if r[1] is not None and fold(r[0]) in part]
        said = [1 / (1 + np.exp(-np.dot([*r[1], 1.0], weights[j]))) * 20 >= at for r in own]
        is_ = [truth(r, model.labels)[j] == 1 for r in own]
        tp = sum(s and t for s, t in zip(said, is_, strict=True))
        return tp, sum(said) - tp, sum(is_) - tp

    got = {r["label"]: r for r in table.collect()}
    for j, name in enumerate(model.labels):
        def quality(at, j=j):
            tp, fp, fn = counts(lb.CHOOSING, at, j)
            return (-round(2 * tp / (2 * tp + fp + fn), 12), abs(at - 10), at)

        at = min(range(1, 20), key=quality)
        tp, fp, fn = counts(lb.HELD_OUT, at, j)
        r = got[name]
        assert (round(r["threshold"] * 20), r["tp"], r["fp"], r["fn"]) == (at, tp, fp, fn)
        assert r["precision"] == pytest.approx(tp / (tp + fp)) and r["recall"] == pytest.approx(tp / (tp + fn))
        assert r["f1"] > 0.75 and model.thresholds[name] == at
    said = {r["id"]: r["p"] for r in lb.predict_labels(df, model, "v", "p").select("id", "p").collect()}
    assert said[240] is None
    wrong = sum(set(said[r[0]]) != {x for x in r[2] if x} for r in keyed[:240])
    assert wrong < 60


def test_nothing_to_learn(spark, rows):
    df = spark.createDataFrame(rows[:5], SCHEMA)
    for empty in (df.filter("id < 0"), df.withColumn("l", F.lit(None).cast("array<string>"))):
        model, table = lb.train_and_judge(empty, "id", "v", "l", rounds=2)
        assert model.labels == [] and table.count() == 0
    assert [r["p"] for r in lb.predict_labels(df, model, "v", "p").collect()] == [[]] * 5
    with pytest.raises(ValueError, match="at most"):
        lb.fit_labels(df, "v", "l", max_labels=1)
