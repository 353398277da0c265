"""Costly text expressions: what they give on odd texts, and that a row's text is not split and compiled over and over."""

from pyspark.sql import functions as F

from verbatim import lexicons as lx
from verbatim.functions import sentiment
from verbatim.functions.expr import among, compute_all, explode_rows, split_at
from verbatim.functions.patterns import WORD, WS
from verbatim.functions.text import strip, token_count, tokens
from verbatim.operators import keyword as kw
from verbatim.operators import profile

TEXTS = [
    None, "", " ", "a", "  two  words ", "tab\there\n", "late but good", "But first", "ends however", "a\x1fb but c", "but",
    "\x1f", "Good, good; BAD words", "très  long – très long", "not good but not bad, however great", ", late ,late delivery",
]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_splits_equal_those_by_pattern(values):
    for pattern in (f"[{WS}]+", f"[^{WORD}]+"):
        assert values(lambda c: split_at(c, pattern), TEXTS) == values(lambda c: F.split(c, pattern), TEXTS)  # noqa: B023
    assert values(tokens, TEXTS) == values(lambda c: F.filter(F.split(c, f"[{WS}]+"), lambda t: t != ""), TEXTS)
    clauses = lambda c: F.filter(F.transform(F.split(c, sentiment.CONTRAST), strip), lambda s: s != "")
    want = [[t] if t is not None and not v else v for t, v in zip(TEXTS, values(clauses, TEXTS), strict=True)]
    got = values(sentiment.split_on_contrast, TEXTS)
    assert [v for t, v in zip(TEXTS, got, strict=True) if t is not None] == [v for v in want if v is not None]


def test_few_and_many_terms_are_found_alike(values):
    for terms in ([], ["a"], [str(i) for i in range(9)] + ["a"], [str(i) for i in range(20)] + ["a"]):
        assert values(lambda c: among(c, terms), ["a", "b", None]) == values(lambda c: c.isin(*terms), ["a", "b", None])  # noqa: B023


def test_moods_split_a_text_once(spark, values):
    df = spark.createDataFrame([("good",)], "t string").select(sentiment.lexicon_probs(F.col("t")).alias("p"))
    assert optimized(df).count("split(") == 1
    got = values(sentiment.lexicon_probs, [f"{lx.POSITIVE_WORDS[0]} x {lx.POSITIVE_WORDS[0]} {lx.NEGATIVE_WORDS[0]}", None])
    assert [tuple(r) for r in got] == [(0.25, 0.25, 0.5), (0.0, 1.0, 0.0)]
    assert values(sentiment.lexicon_scorer(), [f"{lx.POSITIVE_WORDS[0]} {lx.NEGATIVE_WORDS[0]} {lx.NEGATIVE_WORDS[0]}"]) == [-0.25]


def test_no_pattern_is_compiled_per_row(spark):
    df = spark.createDataFrame([("a b",)], "t string")
    plan = optimized(df.select(token_count(F.col("t")).alias("n"), sentiment.words(F.col("t")).alias("w")))
    assert plan.count("split(") == plan.count("split(regexp_replace(") == 2


def test_small_library_needs_no_word_ngrams(spark):
    terms = [["late delivery", "late", "late"], ["long – très long", "très long"], ["pay-by-phone", "two"]]
    index = kw.KeywordIndex.from_themes({"themes": {"T": {"subthemes": [{"name": str(i), "keywords_phrases": t} for i, t in enumerate(terms)]}}})
    df = spark.createDataFrame(list(enumerate([*TEXTS, "Pay-by-phone late"])), "ID int, text string")
    by_row = kw.add_exact_hits(df, F.col("text"), index)
    assert "concat_ws" not in optimized(by_row)
    hits = lambda d: {r["ID"]: r["_hits"] and sorted(map(tuple, r["_hits"])) for r in d.collect()}
    assert hits(by_row) == hits(kw.add_exact_hits_by_table(df, F.col("text"), index))
    assert hits(by_row)[0] is None and len(hits(by_row)[15]) == len(hits(by_row)[16]) == 3


def test_costly_columns_are_projected_before_they_are_generated(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "_value0 int, t string")
    once = compute_all(df, {"t": F.upper("t"), "n": F.length("t")})
    assert once.columns == ["_value0", "t", "n"] and [tuple(r) for r in once.collect()] == [(1, "A B", 3), (2, None, None)]
    assert "inline(array(struct" in optimized(once) and "inline(array(struct(t, upper" not in optimized(once)
    rows = explode_rows(df, ["_value0"], F.split(F.upper("t"), " "), "w", "at")
    assert [tuple(r) for r in rows.collect()] == [(1, 0, "A"), (1, 1, "B")]
    assert "posexplode(split(" not in optimized(rows)


def test_clustering_makes_every_vector_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        made.add(1)
        return None if i == 3 else [float(i % 2 * 10 + i / 100)]

    clustered = profile.cluster_vectors(spark.range(20).select("id", vector("id").alias("vector")), 2)
    assert made.value == 20
    assert {r["id"]: r["cluster"] for r in clustered.collect()} == {i: None if i == 3 else i % 2 for i in range(20)}
