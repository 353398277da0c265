import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatim.functions import phrases, plugins, vectors
from verbatim.operators import rerank, semantic
from verbatim.settings import SemanticSettings

LIB = "phrase_idx int, column string, parent string, theme string, subtheme string, polarity string, phrase string, vector array<double>"
ROWS = "ID long, TextColumn string, text string, is_meaningful boolean, response_detail string, sentiment_label string, vector array<double>"


@pytest.fixture()
def data(spark):
    rng = np.random.default_rng(5)
    polarities = ["Either", "Positive", "Negative", "Neutral"]
    lib = [
        (i, f"c{i % 3}", "p", f"t{i // 2}", f"s{i}", polarities[i % 4], f"phrase {i}", rng.normal(size=6).tolist())
        for i in range(20)
    ]
    moods = ["Positive", "Negative", None, "No sentiment"]
    rows = [
        (i, f"c{i % 4}", f"text {i}", [True, None, False][i % 3], "No" if i % 2 else None, moods[i % 4],
         rng.normal(size=6).tolist() if i % 7 else [0.0] * 6)
        for i in range(60)
    ]
    return spark.createDataFrame(lib, LIB), spark.createDataFrame(rows, ROWS), lib, rows


def brute(lib, row, threshold, k, weight):
    v = np.array(row[6])
    n = np.linalg.norm(v)
    v = v / n if n else v
    out = []
    for p in lib:
        if p[1] != row[1]:
            continue
        u = np.array(p[7]) / np.linalg.norm(p[7])
        s = float(u @ v)
        if row[5] and (p[5] == "Either" or (p[5] == row[5] and p[5] in ("Positive", "Negative"))):
            s += weight
        out.append((round(s, 10), p[0]))
    out.sort(key=lambda x: (-x[0], x[1]))
    return [(round(s, 8), i) for s, i in out if s >= threshold][:k]


@pytest.mark.parametrize("limit", [semantic.MAX_BROADCAST_BYTES, 7 * 6 * 8])
def test_candidates_match_brute_force(data, limit):
    library, df, lib, rows = data
    found = semantic.add_candidates(df, library, 0.1, 4, max_broadcast_bytes=limit)
    for r in found.collect():
        got = [(round(c["score"], 8), c["phrase_idx"]) for c in r["candidates"]]
        assert got == brute(lib, rows[r["ID"]], 0.1, 4, 0.15)


def test_assignment_rows(data):
    library, df, _, _ = data
    got = {r["ID"]: r for r in semantic.assign_semantic(df, library).collect()}
    assert got[3]["reason"] == "no_phrases_for_column"  # c3 has no phrases
    assert got[2]["match_method"] == "dismissed" and got[2]["subtheme"] == "No" and got[2]["reason"] == "dismissed"
    assert got[5]["reason"] == "dismissed:No"
    assert got[1]["is_meaningful"] is True  # no flag counts as meaningful
    for r in got.values():
        if r["reason"] == "matched":
            assert r["rule_score"] >= 0.35 and 1 <= len(r["theme"].split(" | ")) <= 3


def test_rerank_keeps_best_pairs(data):
    library, df, _, _ = data
    scorer = plugins.model_pair_scorer(lambda: lambda pairs: [float(p[1].split()[-1]) for p in pairs])
    scored = rerank.add_scored_candidates(df.filter("is_meaningful"), library, scorer, None, SemanticSettings(bi_threshold=-2.0))
    best = rerank.rerank(scored, 2)
    for r in best.filter(F.col("TextColumn") == "c0").collect():
        assert [c["phrase_idx"] for c in r["candidates"]] == [18, 15]
    assert rerank.candidate_scores(scored).filter("TextColumn = 'c0'").count() == 7 * best.filter("TextColumn = 'c0'").count()


def test_template():
    with pytest.raises(KeyError):
        rerank.format_template("{unknown}", {})


def test_encoder_is_unit_length_and_null_safe(spark):
    df = spark.createDataFrame([("Hello hello world",), ("!!!",), (None,)], "t string")
    got = [r["v"] for r in df.select(vectors.hashed_encoder(16)(F.col("t")).alias("v")).collect()]
    assert abs(sum(x * x for x in got[0]) - 1) < 1e-12 and got[1] == [0.0] * 16 and got[2] is None


def test_model_encoder(spark):
    enc = plugins.model_encoder(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r["v"] for r in df.select(enc(F.col("t")).alias("v")).collect()] == [[3.0, 1.0], None]


def test_each_distinct_text_is_encoded_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from verbatim.functions import vectors
    from verbatim.operators import encoded

    path, seen = str(tmp_path / "store"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counting(text):
        seen.add(1)
        return text

    encoder = lambda c: vectors.hashed_encoder(8)(counting(c))
    rows = [(1, "one two"), (2, "one two"), (3, None), (4, ""), (5, "three")]
    df = spark.createDataFrame(rows, "ID int, text string").repartition(3)
    first = sorted(map(str, encoded.add_vectors(df, encoder, path).collect()))
    assert seen.value == 3
    assert sorted(map(str, encoded.add_vectors(df, encoder, path).collect())) == first and seen.value == 3
    more = df.unionByName(spark.createDataFrame([(6, "four"), (7, "three")], "ID int, text string"))
    out = {r.ID: r.vector for r in encoded.add_vectors(more, encoder, path).collect()}
    assert seen.value == 4 and out[7] == out[5] and out[3] is None and out[1] == out[2]
    want = {r.ID: r.v for r in more.select("ID", vectors.hashed_encoder(8)(F.col("text")).alias("v")).collect()}
    assert out == want


def test_best_columns_order_and_ties():
    from verbatim.operators.blocked import best_columns

    rng = np.random.default_rng(3)
    for width, k in [(1, 3), (5, 5), (40, 3), (40, 39)]:
        scores = np.round(rng.normal(size=(50, width)), 1)
        scores[0] = 0.5
        scores[1, 0] = np.nan
        filled = np.where(np.isnan(scores), -np.inf, scores)
        assert (best_columns(scores, k) == np.argsort(-filled, axis=1, kind="stable")[:, :k]).all()


def test_cell_bounds_hold():
    from verbatim.operators.blocked import cell_bounds, nearest_centres

    rng = np.random.default_rng(4)
    unit = lambda x: np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(axis=1, keepdims=True))
    phrases, answers = unit(rng.normal(size=(300, 5))), unit(rng.normal(size=(80, 5)))
    phrases[3], answers[7] = 0.0, 0.0
    centres = phrases[:12]
    centre, angle = nearest_centres(phrases, centres)
    radii = np.array([angle[centre == c].max(initial=0.0) for c in range(12)])
    bounds = cell_bounds(answers, centres, radii)
    for c in range(12):
        assert (answers @ phrases[centre == c].T <= bounds[:, [c]]).all()


def test_blocked_library_equals_broadcast(spark, monkeypatch):
    """Clustered phrases, ties, copies of an answer, rows without vector or column: the same candidates both ways."""
    from verbatim.operators import blocked

    rng = np.random.default_rng(6)
    middles = rng.normal(size=(10, 8)) * 4
    near = lambda: (middles[rng.integers(10)] + rng.normal(size=8) * 0.3).tolist()
    lib = [(i, f"c{i % 2}", "p", f"t{i}", f"s{i}", ["Either", "Positive", "Negative"][i % 3], f"phrase {i}", near()) for i in range(400)]
    lib += [(400 + i, *lib[i][1:]) for i in range(40)]
    lib.append((440, "c0", "p", "t", "zero", "Either", "zero", [0.0] * 8))
    hot = near()
    rows = [
        (i, None if i == 5 else f"c{i % 3}", "x", True, None, ["Positive", "Negative", None][i % 3], None if i == 9 else hot if i % 2 else near())
        for i in range(150)
    ]
    library = spark.createDataFrame(lib, LIB)
    df = spark.createDataFrame(rows, ROWS).withColumns({"column": F.lit("mine"), "k1": F.lit(1), "a.b": F.col("ID")})
    counted = []
    plain = blocked._visits
    monkeypatch.setattr(blocked, "_visits", lambda *a: counted.append(plain(*a)) or counted[-1])
    brief = lambda d: {r["ID"]: r["candidates"] and [(c["phrase_idx"], round(c["score"], 8), c["subtheme"]) for c in r["candidates"]] for r in d.collect()}
    want = brief(semantic.add_candidates(df, library, 0.3, 5))
    found = semantic.add_candidates(df, library, 0.3, 5, max_broadcast_bytes=20 * 8 * 8)
    assert brief(found) == want and len(want) == 150
    assert want[9] is None and want[5] == [] and set(df.columns) < set(found.columns)
    # A column has phrases at nearly all of the 23 centres; bounds leave well below half of these cells to visit.
    asked = counted[0].select("k1", "k2").distinct().count()
    assert sum(v.count() for v in counted) < 0.5 * asked * 23
    nothing = semantic.add_candidates(df.filter("ID < 0"), library, 0.3, 5, max_broadcast_bytes=640)
    assert nothing.count() == 0


def test_overlap_scorer_scores_a_batch_at_once(spark):
    rows = [
        (0, "The  late Box", ["late box", "THE late box", "", None, "box box the"]), (1, None, ["a", "b"]), (2, "x", None),
        (3, "x y", []), (4, " ", ["x"]), (5, "İstanbul ΣΣ", ["İSTANBUL", "σσ"]), (6, "x y", ["y", "x y z"]),
    ]
    df = spark.createDataFrame(rows, "i int, t string, c array<string>").coalesce(1)
    own = phrases.word_set(F.lower("t"))
    each = F.transform("c", lambda c: phrases.jaccard(own, phrases.word_set(F.lower(c))))
    scored = df.select("i", plugins.overlap_pair_scorer()(F.col("t"), F.col("c")).alias("got"), each.alias("want"))
    for r in scored.collect():
        assert r["got"] == r["want"], r
    # The sets are made in batches, not by nested lambdas for every pair.
    plan = scored.select("got")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "array_intersect" not in plan
