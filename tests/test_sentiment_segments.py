from pyspark.sql import functions as F

from suite import fixture as fx
from verbatim.operators import aspects, segments, sentiment
from verbatim.settings import KeywordSettings, SegmentSettings, SentimentSettings, SummarySettings

COLS = ["a", "b"]


def wide(spark, rows):
    return spark.createDataFrame(rows, "ID long, a string, a_is_meaningful boolean, b string, b_is_meaningful boolean")


def test_weighted_sentiment(spark):
    df = wide(spark, [
        (1, "great", True, "late", True), (2, "great", True, "no", False), (3, "no", False, " ", True),
        (4, None, True, "late", True),
    ])
    s = SentimentSettings(column_weights={"a": 0.75, "b": 0.25})
    got = {r["ID"]: r for r in sentiment.add_sentiment(df, COLS, s).collect()}
    assert got[1]["compound"] == 0.5 * 0.75 - 0.5 * 0.25 and got[1]["sentiment_label"] == "Positive"
    assert got[2]["compound"] == 0.5 and got[2]["compound_b"] is None
    assert got[3]["compound"] is None and got[3]["sentiment_label"] == "No sentiment"
    assert got[4]["compound"] == -0.5 and got[4]["compound_a"] is None
    # A column without a weight weighs nothing.
    only_a = sentiment.add_sentiment(df, COLS, SentimentSettings(column_weights={"a": 1.0})).filter("ID = 4").first()
    assert only_a["compound"] is None
    keep = SentimentSettings(column_weights={"a": 0.5, "b": 0.5}, skip_dismissed=False, dismissed_value=0.0)
    row = sentiment.add_sentiment(wide(spark, [(5, " ", False, None, False)]), COLS, keep).first()
    assert (row["compound"], row["sentiment_label"]) == (0.0, "Neutral")


def test_no_weights_mean_equal_weights(spark):
    df = wide(spark, [(4, "fine", True, "sad", True)])
    plain = sentiment.add_sentiment(df, COLS).first()
    equal = sentiment.add_sentiment(df, COLS, SentimentSettings(column_weights={"a": 0.5, "b": 0.5})).first()
    assert plain["compound"] is not None and plain == equal


def test_weights():
    assert sentiment.sentiment_weights(["a", "b"], {"a": 2, "z": 1}) == {"a": 2.0}
    assert sentiment.sentiment_weights(["a", "b"], {}) == {"a": 0.5, "b": 0.5}
    assert sentiment.normalised_weights({"a": 1, "b": 3}) == {"a": 0.25, "b": 0.75}
    assert sentiment.normalised_weights({"a": 0}) == {}


def test_coping_looks_at_dismissed_answers(spark):
    df = wide(spark, [(1, "yoga", False, "x", True), (2, "no yoga", True, "x", True)])
    got = sentiment.add_sentiment(df, COLS, SentimentSettings(column_weights={"a": 1.0})).orderBy("ID").collect()
    assert [r["coping_flag"] for r in got] == ["Coping", None]


def long(spark, rows):
    return spark.createDataFrame(
        rows, "ID long, TextColumn string, text string, is_meaningful boolean, response_detail string"
    )


def test_segments(spark):
    df = long(spark, [
        (1, "a", "the food was good but the room was cold", True, "Detailed response"),
        (2, "a", "good but cold", True, "Detailed response"), (3, "a", "as above", False, "No sentiment"),
        (4, "a", "", True, None), (5, "a", "so cold yet we all loved it", None, None),
    ])
    got = segments.segment_long(df).orderBy("ID", "segment_index").collect()
    assert [(r["ID"], r["segment_index"], r["segment_text"]) for r in got] == [
        (1, 0, "the food was good"), (1, 1, "the room was cold"), (2, 0, "good but cold"), (3, 0, "as above"),
        (5, 0, "we all loved it"),
    ]
    bare = segments.segment_long(df, SegmentSettings(fallback_to_whole_text=False))
    assert sorted(r["ID"] for r in bare.collect()) == [1, 1, 5]
    whole = segments.segment_long(df, SegmentSettings(detect_contrast=False))
    assert whole.count() == 4


def test_segment_keywords_and_summary(spark):
    df = long(spark, [
        (i, "Free_Text_1", "delivery was late again but staff were helpful and polite", True, "Detailed response")
        for i in range(3)
    ] + [(9, "Free_Text_1", "no", False, "No"), (10, "Free_Text_1", "no", False, None)])
    scored = segments.add_segment_sentiment(segments.segment_long(df))
    done = segments.add_segment_keywords(scored, fx.keyword_index(), KeywordSettings(use_fuzzy=False))
    dismissed = {r["ID"]: r for r in done.filter("not is_meaningful").collect()}
    assert dismissed[9]["reason"] == "dismissed" and dismissed[10]["subtheme"] == "No"
    assert dismissed[9]["compound"] is None and dismissed[9]["sentiment_label"] == "No sentiment"
    rows = {r["theme"]: r for r in segments.segment_summary(done, SummarySettings(min_majority_pct=0.51)).collect()}
    assert rows["Delivery"]["insight"] == "Users are very unhappy with Late delivery"
    assert rows["Service"]["pos_pct"] == 1.0 and rows["Service"]["total_segments"] == 3
    assert "Brief response" not in rows


def test_insight_bands(spark):
    df = spark.createDataFrame(
        [(0.05, 0.9), (0.3, 0.2), (0.15, 0.6), (0.3, 0.6), (0.5, 0.6), (-0.15, 0.6), (-0.2, 0.6), (-0.5, 0.6)],
        "net double, dom double",
    )
    got = [r[0] for r in df.select(segments.insight(F.col("net"), F.col("dom"), F.lit("X"))).collect()]
    assert [g.removeprefix("Users are ").removesuffix(" X") for g in got] == [
        "mixed/neutral on", "mixed/neutral on", "slightly happy with", "happy with", "very happy with",
        "slightly unhappy with", "unhappy with", "very unhappy with",
    ]


def test_aspects(spark):
    df = spark.createDataFrame(
        [("great food", "Food", "Taste"), ("late", "Time", ""), ("x", "", ""), ("bad great", "T", None)],
        "segment_text string, theme string, subtheme string",
    )
    got = [(r["aspect"], r["absa_label"]) for r in aspects.aspect_sentiment(df).collect()]
    assert got == [("Taste", "Neutral"), ("Time", "Neutral"), ("T", "Negative")] or len(got) == 3


def test_a_model_scores_clauses_of_many_rows_together(spark):
    from verbatim.functions import plugins
    from verbatim.operators import sentiment

    texts = ["good but bad", None, "", "one although two however three", "good but bad", "single"]
    model = plugins.model_list_scorer(lambda: lambda xs: [len(x) / 10 for x in xs], batch_size=2)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1)
    score = sentiment.clause_compound(F.col("t"), list_scorer=model)
    plain = sentiment.clause_compound(F.col("t"), scorer=lambda c: F.length(c) / 10)
    rows = df.select("i", score.alias("a"), plain.alias("b")).collect()
    assert all(r.a == r.b for r in rows) and rows[1].a == rows[2].a == 0.0 and len({r.a for r in rows}) == 4
    plan = df.select(score)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
