"""Sentiment, clauses and aspects (AG7, AG9-AG11, AG15, CP4, CP6-CP8, UD1, UD4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import fixture as fx
from suite import q_match as qm
from suite import sqltext as q
from suite.registry import query, scratch_folder
from verbatim.functions import plugins, vectors
from verbatim.functions.sentiment import lexicon_probs, lexicon_scorer
from verbatim.operators import aspects, segments, sentiment
from verbatim.operators import quality as quality_ops
from verbatim.settings import AspectSettings, SegmentSettings, SentimentSettings, SummarySettings
from verbatim.streaming import run

WEIGHTS = fx.SENTIMENT_WEIGHTS
SETTINGS = SentimentSettings(column_weights=WEIGHTS)



@query(
    "ud1_lexicon_probabilities",
    q.with_(q.survey(), q.all_texts(),
            "c AS (SELECT key, {} AS p, {} AS n FROM texts)".format(*q.lexicon_counts("text")))
    + "SELECT key, round(n / (p + n + 1.0::DOUBLE), 6) AS neg, round(1.0::DOUBLE / (p + n + 1.0::DOUBLE), 6) AS neu, "
    "round(p / (p + n + 1.0::DOUBLE), 6) AS pos, round((p - n) / (p + n + 1.0::DOUBLE), 6) AS compound FROM c",
)
def ud1(spark, d):
    scored = fx.all_texts(spark, d).select(
        "key", lexicon_probs(F.col("text")).alias("p"), lexicon_scorer()(F.col("text")).alias("compound")
    )
    return scored.select(
        "key", *[F.round(F.col("p")[n], 6).alias(n) for n in ("neg", "neu", "pos")],
        F.round("compound", 6).alias("compound"),
    )


@query(
    "ud1_model_scorer",
    q.with_(q.survey())
    + 'SELECT "ID", '
    + ", ".join(f'length("{c}")::DOUBLE / 100.0 AS "score_{c}"' for c in fx.TEXT_COLUMNS)
    + " FROM survey",
)
def ud1_model(spark, d):
    """A stand-in batch model (text length) behind the model adapter."""

    def load():
        return lambda texts: [len(t) / 100.0 for t in texts]

    scorer = plugins.model_scorer(load)
    return fx.survey(spark, d).select("ID", *[scorer(F.col(c)).alias(f"score_{c}") for c in fx.TEXT_COLUMNS])


# --------------------------------------------------------------------------------------------------------------
# Responses
# --------------------------------------------------------------------------------------------------------------

SCORES = ",\n".join(
    [
        "dtx AS (SELECT DISTINCT text FROM long)",
        f"rule AS (SELECT text, NOT ({q.is_null_text('text')}) AND {q.strip('text')} <> '' AS scored, "
        f"{q.lexicon_score('text')} AS s, {q.detect_coping('text')} AS coping FROM dtx)",
        'per AS (SELECT l."ID", l."TextColumn", CASE WHEN r.scored THEN r.s END AS s, r.coping FROM long l '
        "JOIN rule r ON l.text IS NOT DISTINCT FROM r.text)",
        "wide AS (SELECT \"ID\", "
        + ", ".join(
            f"max(CASE WHEN \"TextColumn\" = '{c}' THEN s END) AS s{k}" for k, c in enumerate(fx.TEXT_COLUMNS, 1)
        )
        + ', bool_or(coping) AS coping FROM per GROUP BY "ID")',
        "tot AS (SELECT *, "
        + " + ".join(f"CASE WHEN s{k} IS NOT NULL THEN {WEIGHTS[c]} ELSE 0.0 END::DOUBLE"
                     for k, c in enumerate(fx.TEXT_COLUMNS, 1))
        + " AS w, "
        + " + ".join(f"coalesce(s{k} * {WEIGHTS[c]}::DOUBLE, 0.0::DOUBLE)" for k, c in enumerate(fx.TEXT_COLUMNS, 1))
        + " AS ws FROM wide)",
        "sentiment AS (SELECT \"ID\", CASE WHEN w > 0 THEN ws / w END AS compound, "
        f"CASE WHEN w > 0 THEN {q.sentiment_label('(ws / w)')} ELSE 'No sentiment' END AS sentiment_label, "
        "CASE WHEN coping THEN 'Coping' END AS coping_flag, s1, s2, s3 FROM tot)",
    ]
)
SENTIMENT = ",\n".join([q.survey(), q.survey_long(), SCORES])


def scored(survey: DataFrame) -> DataFrame:
    flagged = quality_ops.add_quality_flags(survey, fx.TEXT_COLUMNS)
    return sentiment.add_sentiment(flagged, fx.TEXT_COLUMNS, SETTINGS)


def scored_survey(spark, d) -> DataFrame:
    return scored(fx.survey(spark, d))


_SENTIMENT_SELECT = (
    'SELECT "ID", round(compound, 6) AS compound, sentiment_label, coping_flag, '
    + ", ".join(f'round(s{k}, 6) AS "compound_{c}"' for k, c in enumerate(fx.TEXT_COLUMNS, 1))
)


@query("cp4_sentiment_columns", q.with_(SENTIMENT) + _SENTIMENT_SELECT + " FROM sentiment")
def cp4(spark, d):
    scored = sentiment.sentiment_by_id(scored_survey(spark, d), fx.TEXT_COLUMNS)
    return qm.rounded(scored, "compound", *[f"compound_{c}" for c in fx.TEXT_COLUMNS])


@query(
    "io14_output_projections",
    q.with_(SENTIMENT)
    + 'SELECT "ID", round(compound, 6) AS compound, sentiment_label, coping_flag, '
    'round(s1, 6) AS "compound_Free_Text_1" FROM sentiment',
)
def io14(spark, d):
    out = sentiment.sentiment_by_id(scored_survey(spark, d), ["Free_Text_1", "Free_Text_9"])
    return qm.rounded(out, "compound", "compound_Free_Text_1")


@query(
    "ag9_weighted_sentiment",
    "SELECT event_id, round(CASE WHEN w > 0 THEN ws / w END, 9) AS compound, CASE WHEN w > 0 THEN "
    + q.sentiment_label("(ws / w)")
    + " ELSE 'Neutral' END AS sentiment_label FROM (SELECT event_id, "
    "CASE WHEN a IS NOT NULL THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN b IS NOT NULL THEN 0.3 ELSE 0 END::DOUBLE AS w, "
    "coalesce(a * 0.5::DOUBLE, 0) + coalesce(b * 0.3::DOUBLE, 0) AS ws FROM (SELECT event_id, "
    "CASE WHEN event_id % 3 <> 0 THEN value / 50.0 - 1.0 END AS a, CASE WHEN event_id % 5 <> 0 THEN value / 40.0 - 1.0 END "
    "AS b FROM events))",
)
def ag9(spark, d):
    value, key = F.col("value"), F.col("event_id")
    scores = fx.table(spark, d, "events").select(
        "event_id",
        F.when(key % 3 != 0, value / 50.0 - 1.0).alias("compound_a"),
        F.when(key % 5 != 0, value / 40.0 - 1.0).alias("compound_b"),
        F.lit(0.9).alias("compound_c"),
    )
    settings = SentimentSettings(column_weights={"a": 0.5, "b": 0.3}, skip_dismissed=False)
    combined = sentiment.combine_scores(scores, ["a", "b", "c"], settings)
    return combined.select("event_id", F.round("compound", 9).alias("compound"), "sentiment_label")


@query(
    "ag10_fixed_weight_sentiment",
    q.with_(SENTIMENT,
            "f AS (SELECT \"ID\", coping_flag, coalesce(s1, 0) * 0.5::DOUBLE + coalesce(s2, 0) * 0.3::DOUBLE "
            "+ coalesce(s3, 0) * 0.2::DOUBLE AS compound FROM sentiment)")
    + f'SELECT "ID", round(compound, 6) AS compound, {q.sentiment_label("compound")} AS sentiment_label, coping_flag FROM f',
)
def ag10(spark, d):
    scored = scored_survey(spark, d).drop("compound", "sentiment_label", "coping_flag")
    out = sentiment.aggregate_by_id(scored, fx.TEXT_COLUMNS, WEIGHTS)
    return qm.rounded(out.select("ID", "compound", "sentiment_label", "coping_flag"), "compound")


@query(
    "ag11_clause_weighted_score",
    q.with_(
        q.survey(), q.all_texts(),
        f"cl AS (SELECT key, text, {q.clauses('text')} AS cl FROM texts)",
        "ex AS (SELECT key, len(cl) AS n, i, cl[i] AS clause FROM cl, unnest(range(1, len(cl) + 1)) AS u(i) "
        "WHERE text IS NOT NULL AND text <> '')",
        f"sc AS (SELECT key, 0.2::DOUBLE + 0.6::DOUBLE * (i - 1) / greatest(n - 1, 1) AS w, {q.lexicon_score('clause')} "
        "AS s FROM ex)",
        "agg AS (SELECT key, sum(w * s) / sum(w) AS compound FROM sc GROUP BY key)",
    )
    + "SELECT key, round(coalesce(compound, 0.0), 6) AS compound FROM texts LEFT JOIN agg USING (key)",
)
def ag11(spark, d):
    return fx.all_texts(spark, d).select("key", F.round(sentiment.clause_compound(F.col("text")), 6).alias("compound"))


_CLAUSE_LENGTHS = q.with_(
    q.survey(), q.all_texts(),
    f"cl AS (SELECT key, text, {q.clauses('text')} AS cl FROM texts)",
    "ex AS (SELECT key, len(cl) AS n, i, cl[i] AS clause FROM cl, unnest(range(1, len(cl) + 1)) AS u(i) "
    "WHERE text IS NOT NULL AND text <> '')",
    "sc AS (SELECT key, 0.2::DOUBLE + 0.6::DOUBLE * (i - 1) / greatest(n - 1, 1) AS w, length(clause) / 100.0::DOUBLE AS s FROM ex)",
    "agg AS (SELECT key, sum(w * s) / sum(w) AS compound FROM sc GROUP BY key)",
)


@query(
    "ag11_clause_weighted_model",
    _CLAUSE_LENGTHS + "SELECT key, round(coalesce(compound, 0.0), 6) AS compound FROM texts LEFT JOIN agg USING (key)",
)
def ag11_model(spark, d):
    """A stand-in batch model (clause length) over the clauses of many texts at once."""

    def load():
        return lambda texts: [len(t) / 100.0 for t in texts]

    score = sentiment.clause_compound(F.col("text"), list_scorer=plugins.model_list_scorer(load))
    return fx.all_texts(spark, d).select("key", F.round(score, 6).alias("compound"))


@query(
    "ag15_sentiment_distribution",
    q.with_(SENTIMENT) + "SELECT sentiment_label, count(*) AS count FROM sentiment GROUP BY ALL",
)
def ag15(spark, d):
    return sentiment.sentiment_distribution(scored_survey(spark, d))


# --------------------------------------------------------------------------------------------------------------
# Clauses
# --------------------------------------------------------------------------------------------------------------

SEGMENTS = ",\n".join(
    [
        q.answers(),
        f"seg_in AS (SELECT DISTINCT text, is_meaningful FROM answers)",
        f"seg_f AS (SELECT *, list_filter({q.clauses('text')}, lambda p: len({q.tokens('p')}) >= 3) AS f FROM seg_in)",
        "seg_l AS (SELECT text, is_meaningful, CASE WHEN NOT is_meaningful THEN [text] WHEN len(f) > 0 THEN f "
        "WHEN text <> '' THEN [text] ELSE [] END AS parts FROM seg_f)",
        "seg0 AS (SELECT a.\"ID\", a.\"TextColumn\", (i - 1)::INTEGER AS segment_index, l.parts[i] AS segment_text, "
        "a.text AS source_text, a.is_meaningful, a.response_detail FROM answers a JOIN seg_l l USING (text, is_meaningful), "
        "unnest(range(1, len(l.parts) + 1)) AS u(i))",
        f"seg_s AS (SELECT segment_text, len({q.tokens('segment_text')})::INTEGER AS segment_tokens, "
        f"{q.lexicon_score('segment_text')} AS s FROM (SELECT DISTINCT segment_text FROM seg0))",
        "segs AS (SELECT s0.*, t.segment_tokens, CASE WHEN s0.is_meaningful THEN t.s END AS compound, "
        f"CASE WHEN s0.is_meaningful THEN {q.sentiment_label('t.s')} ELSE 'No sentiment' END AS sentiment_label "
        "FROM seg0 s0 JOIN seg_s t USING (segment_text))",
    ]
)


def built_segments(spark, d) -> DataFrame:
    survey = fx.survey(spark, d)
    pre = quality_ops.preprocess_columns(survey, fx.TEXT_COLUMNS, fx.dictionary())
    return segments.build_segments(quality_ops.add_quality_flags(pre, fx.TEXT_COLUMNS), fx.TEXT_COLUMNS)


def scored_segments(spark, d) -> DataFrame:
    return segments.add_segment_sentiment(built_segments(spark, d))


def keyword_segments(spark, d) -> DataFrame:
    return segments.add_segment_keywords(scored_segments(spark, d), qm.INDEX, qm.EXACT)


@query(
    "cp6_segments",
    q.with_(SEGMENTS)
    + 'SELECT "ID", "TextColumn", segment_index, segment_text, source_text, segment_tokens, is_meaningful, '
    "response_detail FROM segs",
)
def cp6(spark, d):
    return built_segments(spark, d)


@query(
    "cp6_segments_documents",
    q.with_(
        f"f AS (SELECT doc_id, text, list_filter({q.clauses('text')}, lambda p: len({q.tokens('p')}) >= 5) AS f "
        "FROM documents)",
        "l AS (SELECT doc_id, CASE WHEN len(f) > 0 THEN f WHEN text <> '' THEN [text] ELSE [] END AS parts FROM f)",
    )
    + f"SELECT doc_id AS \"ID\", (i - 1)::INTEGER AS segment_index, parts[i] AS segment_text, "
    f"len({q.tokens('parts[i]')})::INTEGER AS segment_tokens FROM l, unnest(range(1, len(parts) + 1)) AS u(i)",
)
def cp6_documents(spark, d):
    docs = fx.documents_long(spark, d)
    out = segments.segment_long(docs, SegmentSettings(min_tokens=5))
    return out.select("ID", "segment_index", "segment_text", "segment_tokens")


@query(
    "dx13_clause_sentiment",
    q.with_(SEGMENTS)
    + 'SELECT "ID", "TextColumn", segment_index, segment_text, round(compound, 6) AS compound, sentiment_label FROM segs',
)
def dx13(spark, d):
    scored = scored_segments(spark, d)
    return qm.rounded(
        scored.select("ID", "TextColumn", "segment_index", "segment_text", "compound", "sentiment_label"), "compound"
    )


def keyword_segments_sql(settings) -> str:
    return ",\n".join(
        [
            SEGMENTS,
            "seg_src AS (SELECT *, segment_text AS text, is_meaningful AS active FROM segs)",
            q.matches("seg_src", qm.INDEX, settings),
            "seg_out AS ("
            + q.assignment_select(
                "s.*", "seg_src", "NOT s.is_meaningful", "coalesce(nullif(s.response_detail, ''), 'No')", "'dismissed'"
            )
            + ")",
        ]
    )


KEYWORD_SEGMENTS = keyword_segments_sql(qm.EXACT)
_SEGMENT_ROW = (
    'SELECT "ID", "TextColumn", segment_index, segment_text, is_meaningful, round(compound, 6) AS compound, '
    "sentiment_label, theme, subtheme, parent_theme, rule_score, expected_polarity, match_method, evidence, reason"
)
_SEGMENT_COLUMNS = [
    "ID", "TextColumn", "segment_index", "segment_text", "is_meaningful", "compound", "sentiment_label", "theme",
    "subtheme", "parent_theme", "rule_score", "expected_polarity", "match_method", "evidence", "reason",
]


@query("cp7_segment_keyword", q.with_(KEYWORD_SEGMENTS) + _SEGMENT_ROW + " FROM seg_out")
def cp7(spark, d):
    return qm.rounded(keyword_segments(spark, d).select(*_SEGMENT_COLUMNS), "compound", "rule_score")


_SEG_OUT = (
    "seg_src AS (SELECT *, segment_text AS text, is_meaningful AS active FROM segs),\n"
    "seg_out AS ("
    + q.assignment_select("s.*", "seg_src", "NOT s.is_meaningful", "coalesce(nullif(s.response_detail, ''), 'No')",
                          "'dismissed'", "'below_threshold'")
    + ")"
)


def _segment_candidates(mood: str) -> dict[str, str]:
    return {"before": SEGMENTS, "source": "segs", "text": "segment_text", "mood": mood}


def semantic_segments_sql(mood: str = "sentiment_label") -> str:
    return ",\n".join(
        [qm._text_candidates(0.35, 3, **_segment_candidates(mood)), qm._collapse_text("score", "semantic_similarity"), _SEG_OUT]
    )


def reranked_segments_sql(mood: str = "sentiment_label") -> str:
    collapsed = qm._collapse_text("ce_score", "semantic_cross_encoder").replace("FROM cands", "FROM ranked")
    return ",\n".join([qm._scored_pairs(qm._PAIR_SQL, **_segment_candidates(mood)), qm._RERANKED, collapsed, _SEG_OUT])


_SEMANTIC_SEGMENTS = semantic_segments_sql()


@query("cp7_segment_reranked", q.with_(reranked_segments_sql()) + _SEGMENT_ROW + " FROM seg_out")
def cp7_reranked(spark, d):
    found = segments.add_segment_semantic(
        scored_segments(spark, d), qm.encoded_library(spark), vectors.hashed_encoder(qm.DIM), qm.RERANK,
        plugins.overlap_pair_scorer(),
    )
    return qm.rounded(found.select(*_SEGMENT_COLUMNS), "compound", "rule_score")


@query("cp7_segment_semantic", q.with_(_SEMANTIC_SEGMENTS) + _SEGMENT_ROW + " FROM seg_out")
def cp7_semantic(spark, d):
    found = segments.add_segment_semantic(
        scored_segments(spark, d), qm.encoded_library(spark), vectors.hashed_encoder(qm.DIM)
    )
    return qm.rounded(found.select(*_SEGMENT_COLUMNS), "compound", "rule_score")


SUMMARY = ",\n".join(
    [
        "cnt AS (SELECT \"TextColumn\", theme, subtheme, count(*) FILTER (sentiment_label = 'Positive') AS pos_count, "
        "count(*) FILTER (sentiment_label = 'Negative') AS neg_count, "
        "count(*) FILTER (sentiment_label = 'Neutral') AS neutral_count FROM seg_out "
        "WHERE is_meaningful AND trim(theme) <> '' GROUP BY ALL)",
        "sh AS (SELECT *, pos_count + neg_count + neutral_count AS total FROM cnt)",
        "sums AS (SELECT *, CASE WHEN total > 0 THEN pos_count / total ELSE 0.0 END::DOUBLE AS p, "
        "CASE WHEN total > 0 THEN neg_count / total ELSE 0.0 END::DOUBLE AS n, "
        "CASE WHEN total > 0 THEN neutral_count / total ELSE 0.0 END::DOUBLE AS u, "
        "CASE WHEN total > 0 THEN (pos_count - neg_count) / total ELSE 0.0 END::DOUBLE AS net FROM sh)",
    ]
)
_SUMMARY_SELECT = (
    'SELECT "TextColumn", theme, subtheme, total AS total_segments, pos_count, neg_count, neutral_count, '
    f"{q.rounded('p', 3)} AS pos_pct, {q.rounded('n', 3)} AS neg_pct, {q.rounded('u', 3)} AS neutral_pct, "
    f"{q.rounded('net', 3)} AS net_score, {q.rounded('greatest(p, n)', 3)} AS dominant_pct, "
    + q.insight("net", "greatest(p, n)", "CASE WHEN subtheme <> '' THEN subtheme ELSE theme END", 0.51)
    + " AS insight FROM sums"
)


@query("ag7_segment_summary", q.with_(KEYWORD_SEGMENTS, SUMMARY) + _SUMMARY_SELECT)
def ag7(spark, d):
    return segments.segment_summary(keyword_segments(spark, d), SummarySettings(min_majority_pct=0.51))


@query(
    "io14_segmented_table",
    q.with_(KEYWORD_SEGMENTS)
    + 'SELECT "ID", "TextColumn", segment_index, segment_text, theme, subtheme, parent_theme, sentiment_label, '
    "round(compound, 6) AS compound FROM seg_out",
)
def io14_segments(spark, d):
    return qm.rounded(segments.segmented_table(keyword_segments(spark, d)), "compound")


def _aspect_sql(text: str, use_subtheme: bool) -> str:
    p, n = q.lexicon_counts(text)
    first = "subtheme" if use_subtheme else "theme"
    aspect = f"CASE WHEN trim({first}) <> '' THEN {first} ELSE theme END"
    return q.with_(
        KEYWORD_SEGMENTS,
        f"asp AS (SELECT *, {aspect} AS aspect FROM seg_out WHERE trim({aspect}) <> '')",
        f"cnts AS (SELECT *, {p} AS p, {n} AS n FROM asp)",
    ) + (
        'SELECT "ID", "TextColumn", segment_index, aspect, CASE WHEN n = greatest(p, n, 1) THEN \'Negative\' '
        "WHEN 1 = greatest(p, n, 1) THEN 'Neutral' ELSE 'Positive' END AS absa_label, "
        "round(greatest(p, n, 1) / (p + n + 1), 6)::DOUBLE AS absa_score FROM cnts"
    )


@query("cp8_aspect_sentiment", _aspect_sql("segment_text", True))
def cp8(spark, d):
    out = aspects.aspect_sentiment(keyword_segments(spark, d))
    return qm.rounded(out.select("ID", "TextColumn", "segment_index", "aspect", "absa_label", "absa_score"), "absa_score")


@query("ud4_aspect_prompt", _aspect_sql("('aspect: ' || aspect || ' text: ' || segment_text)", False))
def ud4(spark, d):
    out = aspects.aspect_sentiment(
        keyword_segments(spark, d), AspectSettings(use_subtheme=False, input_mode="prompt")
    )
    return qm.rounded(out.select("ID", "TextColumn", "segment_index", "aspect", "absa_label", "absa_score"), "absa_score")


# --------------------------------------------------------------------------------------------------------------
# Streams: the survey arrives in files, with repeated responses; counts of micro-batches add up to the batch result
# --------------------------------------------------------------------------------------------------------------


def _replayed(spark, d, tables) -> str:
    """The folder with what ``tables`` makes of each micro-batch of the survey, responses sent twice counted once."""
    folder = scratch_folder(spark)
    days = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("ID"), F.col("o_orderdate").cast("timestamp").alias("sent"))
    sent = fx.survey(spark, d).join(days, "ID")
    for part in range(4):
        again = sent.filter((F.col("ID") % 4 == (part + 1) % 4) & (F.col("ID") % 5 == 0))
        sent.filter(F.col("ID") % 4 == part).unionByName(again).write.mode("append").parquet(f"{folder}/in")
    stream = run.read_responses(spark, f"{folder}/in", sent.schema, files_per_batch=8)
    once = run.distinct_responses(stream, "sent", "4000 days")
    run.append_batches(once, tables, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return f"{folder}/out"


def _stream_counts(spark, d, count, keys) -> DataFrame:
    out = _replayed(spark, d, lambda batch: {"counts": count(batch)})
    return run.added_up(run.batch_results(spark, out, "counts"), keys)


@query(
    "ag1_quality_report_stream",
    q.with_(q.survey(), q.survey_long(), f"flagged AS (SELECT \"TextColumn\", {q.response_detail('text')} AS detail FROM long)")
    + 'SELECT "TextColumn" AS "column", detail AS response_detail, count(*) AS count FROM flagged GROUP BY ALL',
)
def ag1_stream(spark, d):
    return _stream_counts(spark, d, lambda b: quality_ops.quality_report(b, fx.TEXT_COLUMNS), ["column", "response_detail"])


@query("ag7_segment_summary_stream", q.with_(KEYWORD_SEGMENTS, SUMMARY) + _SUMMARY_SELECT)
def ag7_stream(spark, d):
    def count(batch: DataFrame) -> DataFrame:
        pre = quality_ops.preprocess_columns(batch, fx.TEXT_COLUMNS, fx.dictionary())
        parts = segments.build_segments(quality_ops.add_quality_flags(pre, fx.TEXT_COLUMNS), fx.TEXT_COLUMNS)
        return segments.segment_counts(segments.add_segment_keywords(segments.add_segment_sentiment(parts), qm.INDEX, qm.EXACT))

    counts = _stream_counts(spark, d, count, segments.SUMMARY_KEYS)
    return segments.summary_of_counts(counts, SummarySettings(min_majority_pct=0.51))


@query(
    "ag15_sentiment_distribution_stream",
    q.with_(SENTIMENT) + "SELECT sentiment_label, count(*) AS count FROM sentiment GROUP BY ALL",
)
def ag15_stream(spark, d):
    return _stream_counts(spark, d, lambda b: sentiment.sentiment_distribution(scored(b)), ["sentiment_label"])
