"""Reports, comparisons, frequencies and the whole job (AG6, AG12-AG14, AG16, PR10, PR11, JN12, JN13, RK5-RK7, CP9, CP10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import fixture as fx
from suite import q_match as qm
from suite import q_sentiment as qs
from suite import sqltext as q
from suite.q_text import FREQUENCY, frequency_token_filter
from suite.registry import TWINS, query, scratch_folder
from verbatim.functions import plugins, vectors
from verbatim.operators import frequency, keyword, quality, reports, semantic, sketches
from verbatim.operators.reshape import response_long
from verbatim.plans.job import SurveyJob
from verbatim.settings import FrequencySettings, KeywordSettings, OutputSettings, SemanticSettings, SentimentSettings
from verbatim.sources import results
from verbatim.sources.survey import spread

LOOSE = KeywordSettings(use_fuzzy=False, phrase_first=False, min_accept_score=0.7)


def assignments(spark, d, settings=qm.EXACT) -> DataFrame:
    return keyword.assign_keyword(qm.answers(spark, d), qm.INDEX, settings)


ASSIGNED = q.keyword_assignments(qm.EXACT)
LABELS = f"labels_ AS (SELECT u.t AS theme FROM assignments, unnest({q.split_multi('theme')}) AS u(t))"


@query(
    "ag6_theme_counts",
    q.with_(ASSIGNED, LABELS)
    + "SELECT theme, count(*) AS count FROM labels_ WHERE lower(theme) <> 'brief response' GROUP BY theme",
)
def ag6(spark, d):
    return reports.theme_counts(assignments(spark, d))


@query(
    "rk5_top_themes",
    q.with_(ASSIGNED, LABELS)
    + "SELECT theme, count(*) AS count FROM labels_ WHERE lower(theme) <> 'brief response' GROUP BY theme "
    "ORDER BY count DESC, theme LIMIT 4",
)
def rk5(spark, d):
    return reports.top(reports.theme_counts(assignments(spark, d)), 4)


@query(
    "ag13_match_metrics",
    q.with_(ASSIGNED)
    + "SELECT count(*) AS assignments, " + q.rounded("count(*) FILTER (match_method <> 'none') / count(*) * 100", 2) + " "
    "AS match_rate, count(*) FILTER (match_method = 'dismissed') AS dismissed, "
    "count(*) FILTER (match_method = 'none') AS unmatched, "
    "round(avg(rule_score) FILTER (reason = 'matched'), 6) AS mean_matched_score FROM assignments",
)
def ag13(spark, d):
    return qm.rounded(reports.match_metrics(assignments(spark, d)), "mean_matched_score")


@query(
    "ag13_method_counts",
    q.with_(ASSIGNED) + "SELECT match_method, count(*) AS count FROM assignments GROUP BY ALL",
)
def ag13_methods(spark, d):
    return reports.method_counts(assignments(spark, d))


@query(
    "pr11_matched_unmatched",
    q.with_(ASSIGNED)
    + 'SELECT CASE WHEN reason = \'matched\' THEN \'matched\' ELSE \'unmatched\' END AS report, "ID", "TextColumn", reason '
    "FROM assignments",
)
def pr11(spark, d):
    matched, unmatched = reports.matched_unmatched(assignments(spark, d))
    cols = ["ID", "TextColumn", "reason"]
    return matched.select(F.lit("matched").alias("report"), *cols).unionByName(
        unmatched.select(F.lit("unmatched").alias("report"), *cols)
    )


# --------------------------------------------------------------------------------------------------------------
# Comparison
# --------------------------------------------------------------------------------------------------------------

_SEMANTIC = (
    q.with_(qm._text_candidates(0.35, 3), qm._collapse_text("score", "semantic_similarity"), qm._ACTIVE)
    + qm._SEMANTIC_ROW
)
_KEYWORD = q.with_(ASSIGNED) + "SELECT * FROM assignments"
COMPARISON = ",\n".join(
    [
        f"k AS ({_KEYWORD})",
        f"s AS ({_SEMANTIC})",
        'cmp AS (SELECT coalesce(k."ID", s."ID") AS "ID", coalesce(k."TextColumn", s."TextColumn") AS "TextColumn", '
        "coalesce(k.theme, '') AS theme_keyword, coalesce(s.theme, '') AS theme_semantic, "
        "coalesce(k.subtheme, '') AS subtheme_keyword, coalesce(s.subtheme, '') AS subtheme_semantic "
        'FROM k FULL OUTER JOIN s ON k."ID" = s."ID" AND k."TextColumn" = s."TextColumn")',
        "compared AS (SELECT *, theme_keyword = theme_semantic AND subtheme_keyword = subtheme_semantic AS match FROM cmp)",
    ]
)
_COMPARED = ["ID", "TextColumn", "theme_keyword", "theme_semantic", "subtheme_keyword", "subtheme_semantic", "match"]


def semantic_assignments(spark, d) -> DataFrame:
    return semantic.assign_semantic(qm.answers(spark, d), qm.encoded_library(spark), vectors.hashed_encoder(qm.DIM))


def written(spark, df: DataFrame) -> DataFrame:
    """``df`` written to the scratch folder and read again, for a table that several parts of a plan read."""
    path = scratch_folder(spark) + "/table"
    results.write_table(df, [path], "parquet")
    return spark.read.schema(df.schema).parquet(path)


def comparison(spark, d) -> DataFrame:
    """Both methods on the same answers, which are prepared once."""
    answers = spread(written(spark, qm.answers(spark, d)))
    by_keyword = keyword.assign_keyword(answers, qm.INDEX, qm.EXACT)
    by_vector = semantic.assign_semantic(answers, qm.encoded_library(spark), vectors.hashed_encoder(qm.DIM))
    return reports.compare_assignments(by_keyword, by_vector)


@query("jn12_compare_assignments", q.with_(COMPARISON) + "SELECT * FROM compared")
def jn12(spark, d):
    return comparison(spark, d).select(*_COMPARED)


@query(
    "jn12_mismatches_unequal_tables",
    "WITH a AS (SELECT doc_id AS \"ID\", 'text' AS \"TextColumn\", lang AS theme FROM documents), "
    "b AS (SELECT doc_id AS \"ID\", CASE WHEN toxic = 1 THEN 'extra' ELSE 'text' END AS \"TextColumn\", "
    "CASE WHEN quality = 1 THEN 'en' ELSE 'fr' END AS theme FROM labels) "
    'SELECT coalesce(a."ID", b."ID") AS "ID", coalesce(a."TextColumn", b."TextColumn") AS "TextColumn", '
    "coalesce(a.theme, '') AS theme_left, coalesce(b.theme, '') AS theme_right, "
    "FALSE AS match FROM a FULL OUTER JOIN b ON a.\"ID\" = b.\"ID\" AND a.\"TextColumn\" = b.\"TextColumn\" "
    "WHERE coalesce(a.theme, '') <> coalesce(b.theme, '')",
)
def jn12_outer(spark, d):
    """Tables that cover different answers: rows on one side only are disagreements."""
    left = fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("ID"), F.lit("text").alias("TextColumn"), F.col("lang").alias("theme")
    )
    right = fx.table(spark, d, "labels").select(
        F.col("doc_id").alias("ID"),
        F.when(F.col("toxic") == 1, "extra").otherwise("text").alias("TextColumn"),
        F.when(F.col("quality") == 1, "en").otherwise("fr").alias("theme"),
    )
    compared = reports.compare_assignments(left, right, suffixes=("_left", "_right"))
    return reports.mismatches(compared).select("ID", "TextColumn", "theme_left", "theme_right", "match")


@query(
    "ag16_agreement_totals",
    q.with_(COMPARISON)
    + "SELECT count(*) AS total, count(*) FILTER (match) AS matches, count(*) FILTER (NOT match) AS mismatches FROM compared",
)
def ag16(spark, d):
    return reports.agreement_totals(comparison(spark, d))


@query(
    "dx16_embedding_agreement",
    "WITH v AS (" + q.with_(qm._vector_candidates(0.35, 3, 0.15)) + 'SELECT "ID", theme FROM cands WHERE rn = 1), '
    "t AS (SELECT vec_id AS \"ID\", 'theme ' || (label // 2) AS theme FROM embeddings) "
    "SELECT count(*) AS total, count(*) FILTER (t.theme = coalesce(v.theme, '')) AS matches, "
    "count(*) FILTER (t.theme <> coalesce(v.theme, '')) AS mismatches FROM t LEFT JOIN v USING (\"ID\")",
)
def dx16(spark, d):
    """Similarity themes against the themes of the supplied labels."""
    settings = SemanticSettings(top_k=1)
    found = semantic.assign_semantic(qm.vector_answers(spark, d), qm.centroid_library(spark, d), settings=settings)
    found = found.withColumns(
        {c: F.when(F.col("reason") == "matched", F.col(c)).otherwise("") for c in ("theme", "subtheme")}
    ).withColumn("subtheme", F.lit(""))
    known = fx.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("ID"),
        F.concat(F.lit("Free_Text_"), (F.col("vec_id") % 3 + 1).cast("string")).alias("TextColumn"),
        F.concat(F.lit("theme "), F.floor(F.col("label") / 2).cast("string")).alias("theme"),
    )
    return reports.agreement_totals(reports.compare_assignments(known, found))


@query("io12_reread_assignments", _KEYWORD)
def io12(spark, d):
    path = scratch_folder(spark) + "/assignments_keyword"
    results.write_table(qm.rounded(assignments(spark, d), "rule_score"), [path])
    read = results.read_assignments(spark, path).withColumn("ID", F.col("ID").cast("long"))
    return read.withColumn("expected_polarity", F.coalesce("expected_polarity", F.lit("")))


@query(
    "dx1_hybrid_merge",
    q.with_(
        f"k AS ({_KEYWORD})", f"s AS ({_SEMANTIC})",
        "pick AS (SELECT k.\"ID\", k.\"TextColumn\", k.reason <> 'no_match' AND (k.reason <> 'matched' OR "
        "k.rule_score >= 0.7) OR NOT (s.reason = 'matched' AND s.rule_score >= 0.7) AS keyword_wins, "
        "k.theme AS kt, s.theme AS st, k.match_method AS km, s.match_method AS sm, k.rule_score AS kr, s.rule_score AS sr "
        'FROM k JOIN s ON k."ID" = s."ID" AND k."TextColumn" = s."TextColumn")',
    )
    + 'SELECT "ID", "TextColumn", CASE WHEN keyword_wins THEN kt ELSE st END AS theme, '
    "CASE WHEN keyword_wins THEN km ELSE sm END AS match_method, CASE WHEN keyword_wins THEN kr ELSE sr END AS rule_score "
    "FROM pick",
)
def dx1(spark, d):
    answers = spread(written(spark, qm.answers(spark, d)))  # both sides read them
    found = semantic.assign_semantic(answers, qm.encoded_library(spark), vectors.hashed_encoder(qm.DIM))
    merged = reports.hybrid_merge(keyword.assign_keyword(answers, qm.INDEX, qm.EXACT), found)
    return qm.rounded(merged.select("ID", "TextColumn", "theme", "match_method", "rule_score"), "rule_score")


# --------------------------------------------------------------------------------------------------------------
# Dashboard
# --------------------------------------------------------------------------------------------------------------

VIEW = ",\n".join(
    [
        ASSIGNED,
        qs.SCORES,
        'view_ AS (SELECT a.*, l.raw AS text, l.response_detail, s.sentiment_label, round(s.compound, 6) AS compound '
        'FROM assignments a LEFT JOIN answers l ON a."ID" = l."ID" AND a."TextColumn" = l."TextColumn" '
        'LEFT JOIN sentiment s ON a."ID" = s."ID")',
    ]
)


def view(spark, d) -> DataFrame:
    long = response_long(qs.scored_survey(spark, d), fx.TEXT_COLUMNS).drop("is_meaningful")
    return qm.rounded(reports.attach_text(assignments(spark, d), long), "rule_score", "compound")


@query(
    "jn13_attach_text",
    q.with_(VIEW)
    + 'SELECT "ID", "TextColumn", is_meaningful, theme, subtheme, rule_score, match_method, text, response_detail, '
    "sentiment_label, compound FROM view_",
)
def jn13(spark, d):
    return view(spark, d).drop("parent_theme", "expected_polarity", "evidence", "reason")


FILTER = reports.ViewFilter(
    text_columns=["Free_Text_1", "Free_Text_2"], themes=["Delivery", "Price", "Product"],
    subthemes=["Late delivery", "Good value", "Too expensive"], sentiments=["Positive", "Negative"],
    methods=["exact", "exact | exact"], only_meaningful=True, search="late|cheap|HIGH",
)
_FILTERED = (
    "filtered AS (SELECT * FROM view_ WHERE \"TextColumn\" IN ('Free_Text_1', 'Free_Text_2') "
    f"AND list_has_any({q.split_multi('theme')}, ['Delivery', 'Price', 'Product']) "
    f"AND list_has_any({q.split_multi('subtheme')}, ['Late delivery', 'Good value', 'Too expensive']) "
    "AND sentiment_label IN ('Positive', 'Negative') AND match_method IN ('exact', 'exact | exact') "
    "AND is_meaningful AND regexp_matches(text, 'late|cheap|HIGH', 'i'))"
)


@query(
    "pr10_dashboard_filter",
    q.with_(VIEW, _FILTERED) + 'SELECT "ID", "TextColumn", text, theme, subtheme, sentiment_label FROM filtered',
)
def pr10(spark, d):
    filtered = reports.filter_view(view(spark, d), FILTER)
    return filtered.select("ID", "TextColumn", "text", "theme", "subtheme", "sentiment_label")


@query(
    "ag14_view_metrics",
    q.with_(VIEW, _FILTERED)
    + 'SELECT count(*) AS rows, count(DISTINCT "ID") AS unique_ids, count(DISTINCT theme) AS themes FROM filtered',
)
def ag14(spark, d):
    return reports.view_metrics(reports.filter_view(view(spark, d), FILTER))


@query(
    "rk7_facet_values",
    q.with_(VIEW)
    + f"SELECT 'theme' AS facet, u.t AS value FROM view_, unnest({q.split_multi('theme')}) AS u(t) GROUP BY ALL "
    f"UNION ALL SELECT 'subtheme', u.t FROM view_, unnest({q.split_multi('subtheme')}) AS u(t) GROUP BY ALL "
    "UNION ALL SELECT DISTINCT 'sentiment', sentiment_label FROM view_ WHERE sentiment_label IS NOT NULL "
    "UNION ALL SELECT DISTINCT 'method', match_method FROM view_",
)
def rk7(spark, d):
    labels = {"theme": ("theme", " | "), "subtheme": ("subtheme", " | ")}
    single = {"sentiment": ("sentiment_label", None), "method": ("match_method", None)}
    return reports.all_facet_values(view(spark, d), labels | single)


@query(
    "dx17_review_sheet",
    q.with_(VIEW)
    + 'SELECT "ID", "TextColumn", text, theme, subtheme, parent_theme, match_method, rule_score, sentiment_label, '
    "compound, response_detail FROM view_",
)
def dx17(spark, d):
    return reports.review_sheet(view(spark, d))


# --------------------------------------------------------------------------------------------------------------
# Frequencies
# --------------------------------------------------------------------------------------------------------------

_D = fx.dictionary()


def _frequency_ctes(source: str, phrases_only: bool) -> str:
    """CTEs up to ``freq`` for distinct texts of ``source``(TextColumn, text) weighted by how often they occur."""
    return ",\n".join(
        [
            f'src AS (SELECT "TextColumn", text, count(*) AS n FROM {source} WHERE text IS NOT NULL GROUP BY ALL)',
            f"f1 AS (SELECT \"TextColumn\", n, {q.frequency_normalise('text')} AS x FROM src)",
            f"f2 AS (SELECT \"TextColumn\", n, {q.replace_terms('x', _D.business_map)} AS x FROM f1)",
            f"f3 AS (SELECT \"TextColumn\", n, {q.map_tokens('x', _D.merge_map)} AS x FROM f2)",
            f"f4 AS (SELECT \"TextColumn\", n, {q.join_phrases('x', _D.force_phrases)} AS x FROM f3)",
            f'tok AS (SELECT "TextColumn", n, u.t AS t FROM f4, unnest({frequency_token_filter(False)}) AS u(t))',
            "freq0 AS (SELECT \"TextColumn\", replace(t, '_', ' ') AS token, contains(t, '_') AS is_phrase, "
            "sum(n)::BIGINT AS count FROM tok GROUP BY ALL HAVING sum(n) >= 2)",
            'freq AS (SELECT "TextColumn", token, count FROM freq0 '
            + (
                'WHERE is_phrase OR "TextColumn" NOT IN (SELECT "TextColumn" FROM freq0 WHERE is_phrase))'
                if phrases_only
                else ")"
            ),
        ]
    )


@query(
    "ag12_word_frequencies_documents",
    q.with_('docs AS (SELECT lang AS "TextColumn", text FROM documents)', _frequency_ctes("docs", False))
    + "SELECT * FROM freq",
)
def ag12(spark, d):
    docs = spread(fx.table(spark, d, "documents")).select(F.col("lang").alias("TextColumn"), "text")
    return frequency.token_frequencies(docs, _D, FrequencySettings(keep_phrases_only=False))


@query(
    "ag12_phrase_frequencies_documents",
    q.with_('docs AS (SELECT lang AS "TextColumn", text FROM documents)', _frequency_ctes("docs", True))
    + "SELECT * FROM freq",
)
def ag12_phrases(spark, d):
    """Phrases where a language has any, else single words."""
    docs = spread(fx.table(spark, d, "documents")).select(F.col("lang").alias("TextColumn"), "text")
    return frequency.token_frequencies(docs, _D)


_SURVEY_FREQUENCIES = q.with_(
    q.survey(), q.survey_long(), "dt AS (SELECT DISTINCT text FROM long)", q.preprocessed("pre", "dt", "text"),
    'proc AS (SELECT l."TextColumn", p.processed AS text FROM long l JOIN pre p ON l.text IS NOT DISTINCT FROM p.text)',
    _frequency_ctes("proc", True),
)


@query("cp9_column_frequencies", _SURVEY_FREQUENCIES + "SELECT * FROM freq")
def cp9(spark, d):
    pre = quality.preprocess_columns(fx.survey(spark, d), fx.TEXT_COLUMNS, _D)
    return frequency.column_frequencies(pre, fx.TEXT_COLUMNS, _D)


@query(
    "rk6_most_common_tokens",
    q.with_('docs AS (SELECT lang AS "TextColumn", text FROM documents)', _frequency_ctes("docs", False))
    + 'SELECT "TextColumn", token, count, row_number() OVER (PARTITION BY "TextColumn" ORDER BY count DESC, token) '
    "AS rank FROM freq QUALIFY rank <= 10",
)
def rk6(spark, d):
    """The ten most common tokens per language."""
    docs = spread(fx.table(spark, d, "documents")).select(F.col("lang").alias("TextColumn"), "text")
    counts = frequency.token_frequencies(docs, _D, FrequencySettings(keep_phrases_only=False))
    return frequency.top_tokens(counts, 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    "rk6_frequent_tokens",
    q.with_('docs AS (SELECT lang AS "TextColumn", text FROM documents)', _frequency_ctes("docs", False))
    + 'SELECT "TextColumn", token, count, row_number() OVER (PARTITION BY "TextColumn" ORDER BY count DESC, token) '
    "AS rank FROM freq QUALIFY rank <= 10",
)
def rk6_frequent(spark, d):
    """The same with counters of a bounded number per task."""
    docs = spread(fx.table(spark, d, "documents")).select(F.col("lang").alias("TextColumn"), "text")
    top = frequency.frequent_tokens(docs, _D, 10, FrequencySettings(keep_phrases_only=False), capacity=2_000)
    return top.withColumn("rank", F.col("rank").cast("long"))


@query(
    "ag14_view_metrics_sketch",
    q.with_(VIEW)
    + 'SELECT "TextColumn", count(*) AS rows, TRUE AS ids_close, TRUE AS median_close FROM view_ GROUP BY ALL',
)
def ag14_sketch(spark, d):
    """Sketches per facet, merged per text column; held against the exact numbers within the stated errors."""
    table = written(spark, view(spark, d).select("ID", "TextColumn", "match_method", "rule_score"))
    merged = sketches.merged_metrics(sketches.facet_sketches(table, ["TextColumn", "match_method"], "ID", "rule_score"), ["TextColumn"])
    exact = table.groupBy("TextColumn").agg(F.count_distinct("ID").alias("ids"))
    ranks = table.join(merged.select("TextColumn", F.col("quantiles")[1].alias("median")), "TextColumn").groupBy("TextColumn").agg(
        F.avg((F.col("rule_score") < F.col("median")).cast("int")).alias("below"),
        F.avg((F.col("rule_score") <= F.col("median")).cast("int")).alias("up_to"),
    )
    error = sketches.RANK_ERROR
    return merged.join(exact, "TextColumn").join(ranks, "TextColumn").select(
        "TextColumn", "rows", (F.abs(F.col("unique_ids") - F.col("ids")) <= sketches.DISTINCT_ERROR * F.col("ids")).alias("ids_close"),
        ((F.col("below") <= 0.5 + error) & (F.col("up_to") >= 0.5 - error)).alias("median_close"),
    )


@query(
    "rk6_most_common_order",
    q.with_('docs AS (SELECT lang AS "TextColumn", text FROM documents)', _frequency_ctes("docs", True))
    + "SELECT * FROM freq",
)
def rk6_order(spark, d):
    docs = spread(fx.table(spark, d, "documents")).select(F.col("lang").alias("TextColumn"), "text")
    return frequency.most_common(frequency.token_frequencies(docs, _D))


# --------------------------------------------------------------------------------------------------------------
# The whole job
# --------------------------------------------------------------------------------------------------------------

ALL_OUTPUTS = OutputSettings(
    assignments=True, taxonomy_reports=True, sentiment=True, quality_report=True, null_text_details=True, audit=True,
    segments=True, segmented_analysis=True, segment_summary=True, aspects=True,
)


def full_job(fuzzy: bool = True, outputs: OutputSettings = ALL_OUTPUTS) -> SurveyJob:
    return SurveyJob(
        fx.TEXT_COLUMNS, dictionary=_D, index=qm.INDEX, outputs=outputs,
        keyword=KeywordSettings(use_fuzzy=fuzzy),
        sentiment=SentimentSettings(column_weights=fx.SENTIMENT_WEIGHTS),
    )


def _written_rows(spark, survey: DataFrame, fuzzy: bool) -> DataFrame:
    folder = scratch_folder(spark)
    names = full_job(fuzzy).write(survey, [folder], "parquet")
    counts = [
        spark.read.parquet(f"{folder}/{n}").agg(F.lit(n).alias("output"), F.count(F.lit(1)).alias("rows")) for n in names
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def _count(sql: str, table: str) -> str:
    return f"({sql} SELECT count(*) FROM {table})"


def _job_counts(settings: KeywordSettings) -> str:
    assigned = q.keyword_assignments(settings)
    job = q.with_(qs.keyword_segments_sql(settings), qs.SUMMARY)
    report = q.with_(q.answers(), 'r AS (SELECT DISTINCT "TextColumn", response_detail FROM answers)')
    counts = {
        "data_audit": "3",
        "null_text_report": _count(report, "r"),
        "null_text_details": _count(q.with_(q.answers()), "answers WHERE NOT is_meaningful"),
        "taxonomy_matched_keyword": _count(q.with_(assigned), "assignments WHERE reason = 'matched'"),
        "taxonomy_unmatched_keyword": _count(q.with_(assigned), "assignments WHERE reason <> 'matched'"),
        "assignments_keyword": _count(q.with_(assigned), "assignments"),
        "sentiment_by_id": "(SELECT count(*) FROM orders)",
        "segments_detailed": _count(job, "seg_out"),
        "segmented_analysis": _count(job, "seg_out"),
        "segment_sentiment_summary": _count(job, "sums"),
        "absa_segment_sentiment": _count(job, "seg_out WHERE trim(theme) <> '' OR trim(subtheme) <> ''"),
    }
    return " UNION ALL ".join(f"SELECT '{n}' AS output, {c}::BIGINT AS rows" for n, c in counts.items())


@query("cp10_full_job_exact", _job_counts(KeywordSettings(use_fuzzy=False)))
def cp10_exact(spark, d):
    """The same without fuzzy matching."""
    return _written_rows(spark, fx.survey(spark, d), fuzzy=False)


@query("cp10_full_job", _job_counts(qm.FUZZY))
def cp10(spark, d):
    """Every output of the job, written and read back: rows per output."""
    return _written_rows(spark, fx.survey(spark, d), fuzzy=True)


# --------------------------------------------------------------------------------------------------------------
# The job in each mode: what it writes, read back
# --------------------------------------------------------------------------------------------------------------

_JOB_COLUMNS = ["ID", "TextColumn", "segment_index", "theme", "subtheme", "rule_score", "expected_polarity", "match_method", "evidence", "reason"]


def _written_job(spark, d, mode: str = "semantic", pair_scorer=None) -> DataFrame:
    """Assignments and clauses that the job writes; clauses carry their sentiment, answers none."""
    job = SurveyJob(
        fx.TEXT_COLUMNS, dictionary=_D, mode=mode, index=qm.INDEX, keyword=qm.FUZZY, library=qm.encoded_library(spark),
        encoder=vectors.hashed_encoder(qm.DIM), pair_scorer=pair_scorer, semantic=qm.RERANK,
        outputs=OutputSettings(assignments=True, taxonomy_reports=False, sentiment=False, quality_report=False, null_text_details=False,
                               audit=False, segments=True, segmented_analysis=False, segment_summary=False, aspects=False),
    )
    folder = scratch_folder(spark)
    job.write(fx.survey(spark, d), [folder], "parquet")
    whole = spark.read.parquet(f"{folder}/assignments_{mode}").withColumn("segment_index", F.lit(-1))
    parts = spark.read.parquet(f"{folder}/segments_detailed")
    return qm.rounded(whole.select(*_JOB_COLUMNS).unionByName(parts.select(*_JOB_COLUMNS)), "rule_score")


def _twin(name: str) -> str:
    return TWINS[name]


def _job_sql(answers_sql: str, segments_sql: str) -> str:
    names = ", ".join(f'"{c}"' for c in _JOB_COLUMNS if c != "segment_index")
    return (
        f"SELECT {names}, segment_index FROM (SELECT *, -1 AS segment_index FROM ({answers_sql})) UNION ALL "
        f"SELECT {names}, segment_index FROM ({segments_sql} SELECT * FROM seg_out)"
    )


@query("cp10_semantic_job", _job_sql(_twin("cp2_semantic_assignments"), q.with_(qs.semantic_segments_sql())))
def cp10_semantic(spark, d):
    return _written_job(spark, d)


@query("cp10_reranked_job", _job_sql(_twin("cp3_reranked_assignments"), q.with_(qs.reranked_segments_sql())))
def cp10_reranked(spark, d):
    return _written_job(spark, d, pair_scorer=plugins.overlap_pair_scorer())


@query("cp10_keyword_job", _job_sql(_twin("cp1_keyword_fuzzy"), q.with_(qs.keyword_segments_sql(qm.FUZZY))))
def cp10_keyword(spark, d):
    """The job by keywords, fuzzy ones included: contents, where cp10_full_job compares the rows of every output."""
    return _written_job(spark, d, "keyword")
