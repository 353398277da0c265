"""Quality reports, sources and sinks (AG1-AG5, IO)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from suite import fixture as fx
from suite import sqltext as q
from suite.registry import query, scratch_folder
from verbatim import lexicons as lx
from verbatim.functions.sentiment import lexicon_scorer, sentiment_label
from verbatim.operators import quality as ops
from verbatim.operators.reshape import matching_long, response_long, row_fingerprint, table_fingerprint
from verbatim.plans.reuse import reused
from verbatim.sources import results, survey as survey_io, taxonomy as taxonomy_io
from verbatim.sources.dictionary import TextDictionary, read_dictionary
from verbatim.sources.files import write_yaml

LONG = (q.survey(), q.survey_long())
FLAGGED = (
    *LONG,
    "dt AS (SELECT DISTINCT text FROM long)",
    f"rules AS (SELECT text, {q.is_null_text('text')} AS dismissed, {q.response_detail('text')} AS detail FROM dt)",
    "flagged AS (SELECT l.*, r.dismissed, r.detail FROM long l JOIN rules r ON l.text IS NOT DISTINCT FROM r.text)",
)


def flagged_survey(spark, d):
    return ops.add_quality_flags(fx.survey(spark, d), fx.TEXT_COLUMNS)


@query(
    "ag1_quality_report",
    q.with_(*FLAGGED)
    + 'SELECT "TextColumn" AS "column", detail AS response_detail, count(*) AS count FROM flagged GROUP BY ALL',
)
def ag1(spark, d):
    return ops.quality_report(fx.survey(spark, d), fx.TEXT_COLUMNS)


@query(
    "ag1_quality_report_documents",
    f"SELECT 'text' AS \"column\", {q.response_detail('text')} AS response_detail, count(*) AS count "
    "FROM documents GROUP BY ALL",
)
def ag1_documents(spark, d):
    return ops.quality_report(fx.table(spark, d, "documents"), ["text"])


AUDIT_COLUMNS = [*fx.TEXT_COLUMNS, "Free_Text_9"]


@query(
    "ag2_data_audit",
    q.with_(*LONG)
    + 'SELECT "TextColumn" AS "column", count(*) AS total_rows, FALSE AS missing_column, '
    "count(*) FILTER (text IS NULL) AS null_count, "
    f"count(*) FILTER ({q.strip('coalesce(text, chr(32))')} = '') AS empty_or_whitespace, "
    f"greatest(0, count(*) FILTER ({q.strip('coalesce(text, chr(32))')} = '') - count(*) FILTER (text IS NULL))::BIGINT "
    "AS empty_only, "
    f"count(*) FILTER (lower({q.strip('text')}) = 'no entry') AS no_entry_count FROM long GROUP BY ALL "
    "UNION ALL SELECT 'Free_Text_9', (SELECT count(*) FROM survey), TRUE, NULL, NULL, NULL, NULL",
)
def ag2(spark, d):
    return ops.data_audit(fx.survey(spark, d), AUDIT_COLUMNS)


@query("ag3_data_shape", "SELECT count(*) AS rows, 5::BIGINT AS columns FROM documents")
def ag3(spark, d):
    return ops.data_shape(fx.table(spark, d, "documents"))


@query(
    "ag4_null_summary",
    q.with_(*FLAGGED)
    + 'SELECT "TextColumn", count(*) AS total_rows, count(*) FILTER (NOT dismissed) AS meaningful, '
    "count(*) FILTER (dismissed) AS dismissed, "
    f"{q.rounded('count(*) FILTER (dismissed) / count(*) * 100', 2)} AS dismissed_pct, "
    "\"TextColumn\" || '_response_detail' AS detail_column FROM flagged GROUP BY ALL",
)
def ag4(spark, d):
    return ops.null_summary(flagged_survey(spark, d), fx.TEXT_COLUMNS)


@query(
    "ag5_detail_counts",
    q.with_(*FLAGGED)
    + 'SELECT "TextColumn", detail AS response_detail, count(*) AS count FROM flagged GROUP BY ALL',
)
def ag5(spark, d):
    return ops.detail_counts(flagged_survey(spark, d), fx.TEXT_COLUMNS)


@query(
    "ag5_detail_pivot",
    q.with_(*FLAGGED)
    + "SELECT detail AS response_detail, "
    + ", ".join(f"count(*) FILTER (\"TextColumn\" = '{c}') AS \"{c}\"" for c in fx.TEXT_COLUMNS)
    + " FROM flagged GROUP BY ALL",
)
def ag5_pivot(spark, d):
    return ops.detail_pivot(flagged_survey(spark, d), fx.TEXT_COLUMNS)


# --------------------------------------------------------------------------------------------------------------
# Sources and sinks
# --------------------------------------------------------------------------------------------------------------

_NA = q.in_list(lx.CSV_NA_VALUES)


@query(
    "io1_read_survey_csv",
    q.with_(q.survey())
    + 'SELECT "ID", '
    + ", ".join(f'CASE WHEN "{c}" NOT IN {_NA} THEN "{c}" END AS "{c}"' for c in fx.TEXT_COLUMNS)
    + " FROM survey",
)
def io1(spark, d):
    path = scratch_folder(spark) + "/survey"
    results.write_table(fx.survey(spark, d).select("ID", *fx.TEXT_COLUMNS), [path])
    schema = "ID long, " + ", ".join(f"{c} string" for c in fx.TEXT_COLUMNS)
    return survey_io.read_survey_csv(spark, path, schema, multi_line=False)


@query(
    "io1_read_documents_csv",
    f"SELECT doc_id, lang, CASE WHEN text NOT IN {_NA} THEN text END AS text FROM documents",
)
def io1_documents(spark, d):
    """Whole texts with line breaks and quotes through CSV and back."""
    path = scratch_folder(spark) + "/documents"
    results.write_table(fx.table(spark, d, "documents").select("doc_id", "lang", "text"), [path])
    return survey_io.read_survey_csv(spark, path, "doc_id long, lang string, text string")


@query(
    "io1_read_documents_csv_split",
    f"SELECT doc_id, lang, CASE WHEN text NOT IN {_NA} THEN text END AS text FROM documents",
)
def io1_documents_split(spark, d):
    """The same by blocks, records found by the parity of quotes."""
    path = scratch_folder(spark) + "/documents"
    results.write_table(fx.table(spark, d, "documents").select("doc_id", "lang", "text"), [path])
    return survey_io.read_large_survey_csv(spark, path, "doc_id long, lang string, text string")


@query(
    "io2_rename_headers",
    q.with_(q.survey())
    + 'SELECT "ID" AS respondent, coalesce("Free_Text_1", "Free_Text_3") AS "Question_1", "Free_Text_2" AS "Question_2" '
    "FROM survey",
)
def io2(spark, d):
    raw = fx.survey(spark, d).select("ID", *fx.TEXT_COLUMNS)
    return survey_io.rename_headers(
        raw,
        {"ID": "respondent", "Free_Text_1": "Question_1", "Free_Text_3": "Question_1", "Free_Text_2": "Question_2",
         "Raw Question 9": "Question_9"},
    )


@query("io4_row_id", "SELECT count(*) AS rows, count(*) AS distinct_ids FROM documents")
def io4(spark, d):
    numbered = survey_io.ensure_id(fx.table(spark, d, "documents"))
    return numbered.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("ID").alias("distinct_ids"))


def library_source(spark, d):
    """The parts as a flat phrase library: type, brand and size class as the levels, the name as the phrase."""
    from suite.q_taxonomy import part_library

    return part_library(spark, d)


LIBRARY = (
    "library AS (SELECT 'Free_Text_' || (p_partkey % 3 + 1) AS \"column\", p_type AS parent, p_brand AS theme, "
    "'Size ' || (p_size % 5) AS subtheme, ['Positive', 'Negative', 'Neutral', 'Either'][(p_partkey % 4) + 1] AS polarity, "
    "p_name AS phrase, p_partkey FROM part)"
)


@query("io5_read_phrase_library", q.with_(LIBRARY) + 'SELECT "column", parent, theme, subtheme, polarity, phrase FROM library')
def io5(spark, d):
    path = scratch_folder(spark) + "/library"
    results.write_table(library_source(spark, d).drop("p_partkey"), [path])
    return taxonomy_io.read_phrase_library(spark, path)


@query(
    "io8_dictionary_table",
    q.with_(
        "words AS (SELECT DISTINCT lower(p_type) AS w FROM part)",
        "names AS (SELECT DISTINCT p_name AS n FROM part)",
    )
    + "SELECT 'keep' AS kind, row_number() OVER (ORDER BY w) - 1 AS pos, w AS key, NULL::VARCHAR AS value FROM words "
    "UNION ALL SELECT 'business', row_number() OVER (ORDER BY n) - 1, n, replace(n, ' ', '_') FROM names",
)
def io8(spark, d):
    """A dictionary table from the parts, written as YAML, read back and turned into a table again."""
    part = fx.table(spark, d, "part")
    words = part.select(F.lower("p_type").alias("key")).distinct()
    names = part.select("p_name").distinct()
    position = lambda c: (F.row_number().over(Window.orderBy(c)) - 1).cast("int").alias("pos")
    stored = words.select(F.lit("keep").alias("kind"), position("key"), "key", F.lit(None).cast("string").alias("value"))
    stored = stored.unionByName(
        names.select(
            F.lit("business").alias("kind"), position("p_name"), F.col("p_name").alias("key"),
            F.replace("p_name", F.lit(" "), F.lit("_")).alias("value"),
        )
    )
    loaded = TextDictionary.from_df(stored)
    path = scratch_folder(spark) + "/dictionary.yaml"
    write_yaml(
        {"BUSINESS_MAP": {k.upper(): v for k, v in loaded.business_map.items()},
         "UNIGRAM_WHITELIST": sorted(loaded.unigram_whitelist)},
        path,
    )
    return read_dictionary(path).to_df(spark).withColumn("pos", F.col("pos").cast("long"))


@query(
    "io9_write_two_targets",
    q.with_(*FLAGGED)
    + 'SELECT target, "TextColumn" AS "column", detail AS response_detail, count(*)::VARCHAR AS count FROM flagged, '
    "(VALUES ('tables'), ('deliverables')) AS t(target) GROUP BY ALL",
)
def io9(spark, d):
    folder = scratch_folder(spark)
    targets = {n: f"{folder}/{n}/null_text_report" for n in ("tables", "deliverables")}
    results.write_table(ops.quality_report(fx.survey(spark, d), fx.TEXT_COLUMNS), list(targets.values()))
    read = [
        spark.read.option("header", True).csv(p).select(F.lit(n).alias("target"), "*") for n, p in targets.items()
    ]
    return read[0].unionByName(read[1])


@query(
    "io10_write_parquet",
    q.with_(*FLAGGED) + 'SELECT "ID", "TextColumn", text, NOT dismissed AS is_meaningful FROM flagged',
)
def io10(spark, d):
    path = scratch_folder(spark) + "/responses"
    long = response_long(flagged_survey(spark, d), fx.TEXT_COLUMNS).select("ID", "TextColumn", "text", "is_meaningful")
    results.write_table(long, [path], "parquet", partition_by=["TextColumn"])
    return survey_io.read_survey(spark, path).select("ID", "TextColumn", "text", "is_meaningful")


@query(
    "io13_sample_survey",
    q.with_("n AS (SELECT row_number() OVER () AS i FROM orders)")
    + "SELECT "
    + ", ".join(f"'Sample response ' || i || ' for Free_Text_{k}' AS \"Free_Text_{k}\"" for k in (1, 2, 3))
    + " FROM n",
)
def io13(spark, d):
    return survey_io.sample_survey(spark, fx.table(spark, d, "orders").count())


@query(
    "io15_text_column_choice",
    "SELECT t.name, t.n FROM (SELECT count(*) AS o, count(text) AS a, count(lang) AS b, count(source) AS c FROM documents), "
    "unnest([{'name': 'text', 'n': a}, {'name': 'lang', 'n': b}, {'name': 'source', 'n': c}]) AS u(t)",
)
def io15(spark, d):
    renamed, columns = survey_io.choose_text_columns(fx.table(spark, d, "documents"), "doc_id")
    return renamed.agg(*[F.count(c).alias(c) for c in columns]).unpivot([], columns, "name", "n")


@query(
    "rs2_text_choice",
    q.with_(q.answers()) + 'SELECT "ID", "TextColumn", text FROM answers',
)
def rs2(spark, d):
    pre = ops.preprocess_columns(fx.survey(spark, d), fx.TEXT_COLUMNS, fx.dictionary())
    return matching_long(pre, fx.TEXT_COLUMNS, carry=()).select("ID", "TextColumn", "text")


@query(
    "rs6_row_fingerprint",
    q.with_(q.survey())
    + "SELECT \"ID\", sha256(json_object('Free_Text_2', coalesce(\"Free_Text_2\", ''), 'ID', \"ID\", 'score', score)"
    "::VARCHAR) AS fingerprint FROM survey",
)
def rs6(spark, d):
    df = fx.survey(spark, d).withColumn("Free_Text_2", F.coalesce("Free_Text_2", F.lit("")))
    return df.select("ID", row_fingerprint(df, ["ID", "Free_Text_2", "score"]).alias("fingerprint"))


def _digest(at: int) -> str:
    return f"CAST(coalesce(sum(('0x' || substr(h, {at}, 13))::BIGINT::HUGEINT), 0) % {2**61 - 1} AS BIGINT)"


@query(
    "rs6_table_fingerprint",
    "WITH d AS (SELECT md5("
    + " || '|' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "lang", "n_chars", "source", "text"))
    + f") AS h FROM documents) SELECT count(*) AS n_rows, {_digest(1)} AS digest_a, {_digest(14)} AS digest_b FROM d",
)
def rs6_table(spark, d):
    return table_fingerprint(fx.table(spark, d, "documents"))


@query(
    "rs6_reused_results",
    f"SELECT doc_id, {q.sentiment_label('s')} AS label, round(s, 6) AS score FROM "
    f"(SELECT doc_id, {q.lexicon_score('text')} AS s FROM documents)",
)
def rs6_reused(spark, d):
    """Sentiment of all documents through a store that was filled before the texts of one language changed."""
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", "text")
    store = scratch_folder(spark) + "/results"

    def scores(rows):
        score = lexicon_scorer()(F.col("text"))
        return rows.select("doc_id", sentiment_label(score).alias("label"), F.round(score, 6).alias("score"))

    reused(docs.withColumn("text", F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))), scores, store, "doc_id")
    return reused(docs, scores, store, "doc_id")
