import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatim.llm import toxicity
from verbatim.llm.toxicity import Settings

SMALL = Settings(buckets=1 << 16, sample=600, steps=500, warm_steps=200)


def made(n, seed):
    """Plain texts of invented words; a bad one has two words or more from two families with many endings."""
    rng = random.Random(seed)
    syllables = ["ta", "ri", "mo", "len", "dor", "su", "ka", "vi"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    out = []
    for _ in range(n):
        words = [word() for _ in range(rng.choice([6, 40, 120]))]
        bad = rng.random() < 0.3
        if bad:
            for _ in range(max(2, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(["grumph", "zaxqu"]) + word())
        out.append((" ".join(words), int(bad)))
    return out


def test_unseen_forms_are_found_in_held_out_texts():
    train, test = made(800, 1), made(300, 2)
    model = toxicity.train(train, SMALL)
    odds = toxicity.WordOdds(model.slopes(), SMALL)
    scores = toxicity.score_texts([t for t, _ in test], model.slopes(), model.offset(), SMALL, odds)
    y = np.array([y for _, y in test])
    hit = scores >= SMALL.threshold
    assert hit[y == 1].mean() > 0.95 and hit[y == 0].mean() < 0.03
    # Two such words in a very long text weigh as much as in a short one.
    long = " ".join(t for t, y in test if not y)
    one, two = toxicity.score_texts([long * 20, long * 10 + " zaxquri grumphta " + long * 10], model.slopes(), model.offset(), SMALL, odds)
    assert one < SMALL.threshold <= two


def test_subwords_are_those_of_each_word():
    words = [b"loser", b"x", "é".encode(), b"<>", b"loser", b"y" * 3000]
    flat, at = toxicity.subwords(words, SMALL)
    ends = [*at[1:], len(flat)]
    parts = [flat[a:b].tolist() for a, b in zip(at, ends, strict=True)]
    for w, p in zip(words, parts, strict=True):
        alone, _ = toxicity.subwords([w], SMALL)
        n = len(w.decode()) + 2
        assert p == alone.tolist() and len(p) == 1 + sum(max(0, n - k + 1) for k in range(3, 7))
    assert parts[0] == parts[4]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 15, 16, 100])
def test_windows_cover_all_words(n):
    starts = toxicity.window_starts(n, 8).tolist()
    sizes = np.diff([*starts, n]) if n else []
    assert sum(sizes) == n and all(8 <= s < 16 for s in sizes[:] if n >= 8)


def test_columns(docs, spark):
    rows = made(120, 3)
    df = docs([(i, t, "s") for i, (t, _) in enumerate(rows)] + [(500, None), (501, ""), (502, " \n"), (None, "ta ri")])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(1, rows[1][1]), (999, 1), (None, 0), (3, None), (4, 7)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, SMALL)
    got = df.select("doc_id", "score", toxicity.score(F.col("text"), model, spark, SMALL).alias("p")).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.p <= 1 for r in got)
    assert {r.doc_id: r.p for r in got if r.doc_id in (500, 501, 502)} == {500: 0, 501: 0, 502: 0}
    again = toxicity.fit(df, labels, SMALL)
    assert np.array_equal(again.slopes(), model.slopes())
    assert toxicity.fit(docs([]), labels.limit(0), SMALL) is None
    assert docs([(1, "a")]).select(toxicity.score(F.col("text"), None, spark).alias("p")).first().p == 0


def test_four_thousand_documents_of_a_class_are_learned_from(spark):
    docs = spark.range(12_000).selectExpr("id AS doc_id", "'word' AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS toxic")
    rows = toxicity.training_sample(docs, labels, toxicity.Settings(), "doc_id", "text", "toxic")
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    assert all(3800 < sizes[y] < 4200 for y in (0, 1))


def test_scores_against_windows_one_by_one():
    """The score of whole texts against softmax over each window, its words' n-gram vectors averaged by hand."""
    import random

    import numpy as np

    rng = random.Random(6)
    s = toxicity.Settings(buckets=257, dim=3)
    gen = np.random.default_rng(2)
    model = toxicity.Model(gen.normal(size=(s.buckets, s.dim)).astype(np.float32), gen.normal(size=(2, s.dim)).astype(np.float32), gen.normal(size=2).astype(np.float32))
    texts = [" ".join(rng.choice(["Good", "bad", "baaad", "é日", "x", "word"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 40))) for _ in range(100)]

    def brute(text):
        words = toxicity.words_of(text)
        if not words:
            return 0.0
        starts = list(range(0, max(len(words) - s.window, 0) + 1, s.window))
        best = -np.inf
        for a, b in zip(starts, [*starts[1:], len(words)], strict=True):
            window = words[a:b]
            mean = np.zeros(s.dim)
            for w in set(window):
                flat, _ = toxicity.subwords([w], s)
                mean += model.vectors[flat].astype(np.float64).mean(axis=0) / len(window)
            odds = mean @ (model.weights[1] - model.weights[0]) + model.bias[1] - model.bias[0]
            best = max(best, float(odds))
        return 1 / (1 + np.exp(-best))

    slopes = model.slopes()
    got = toxicity.score_texts(texts, slopes, model.offset(), s, toxicity.WordOdds(slopes, s))
    assert np.allclose(got, [brute(t) for t in texts], atol=1e-5)


def test_a_worker_keeps_a_bounded_number_of_words():
    s = toxicity.Settings(buckets=1 << 10)
    slopes = np.random.default_rng(3).normal(size=s.buckets).astype(np.float32)
    odds = toxicity.WordOdds(slopes, s)
    words = [f"word{i}".encode() for i in range(250_000)]
    for at in range(0, len(words), 50_000):
        odds.learn(words[at : at + 50_000])
        assert len(odds) <= 100_000
    fresh = toxicity.WordOdds(slopes, s)
    fresh.learn(words[-50_000:])
    assert {w: odds[w] for w in words[-50_000:]} == dict(fresh)
