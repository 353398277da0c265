"""Matching (JN1-JN11), ranking (RK1-RK4) and the assignment tables (CP1-CP3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import fixture as fx
from suite import fuzzysql
from suite import sqltext as q
from suite.registry import query, scratch_folder
from verbatim.functions import plugins, vectors
from verbatim.functions.expr import explode_rows
from verbatim.functions.text import match_normalise, tokens
from verbatim.operators import encoded, fuzzy, keyword, rerank, semantic
from verbatim.operators import quality as quality_ops
from verbatim.operators.reshape import matching_long
from verbatim.settings import KeywordSettings, SemanticSettings

EXACT = KeywordSettings(use_fuzzy=False)
FUZZY = KeywordSettings(use_fuzzy=True)
INDEX = fx.keyword_index()
DOCS = fx.document_index()
DIM = 64


def answers(spark, d) -> DataFrame:
    """The survey's answers in long form: processed text and quality flags."""
    survey = fx.survey(spark, d)
    pre = quality_ops.preprocess_columns(survey, fx.TEXT_COLUMNS, fx.dictionary())
    return matching_long(quality_ops.add_quality_flags(pre, fx.TEXT_COLUMNS), fx.TEXT_COLUMNS, carry=())


def raw_answers(spark, d) -> DataFrame:
    survey = fx.survey(spark, d)
    return matching_long(quality_ops.add_quality_flags(survey, fx.TEXT_COLUMNS), fx.TEXT_COLUMNS, carry=())


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --------------------------------------------------------------------------------------------------------------
# Exact matching
# --------------------------------------------------------------------------------------------------------------

_DOC_HITS = q.with_(
    q.library_ctes(DOCS),
    f'm AS (SELECT doc_id AS "ID", {q.mark("lower(text)")} AS m FROM documents)',
) + (
    'SELECT "ID", pos, kind, min_by(evidence, kw) AS evidence FROM m, terms WHERE contains(m.m, terms.marked) GROUP BY ALL'
)


def _first_evidence(hits: DataFrame) -> DataFrame:
    return (
        explode_rows(hits, ["ID"], F.col("_hits"), "h")
        .groupBy("ID", "h.pos", "h.kind")
        .agg(F.min_by("h.evidence", "h.kw").alias("evidence"))
    )


@query("jn1_exact_keyword_documents", _DOC_HITS)
def jn1(spark, d):
    docs = fx.documents_long(spark, d).select("ID", "text")
    return _first_evidence(keyword.add_exact_hits(docs, F.col("text"), DOCS))


@query("jn1_exact_keyword_join", _DOC_HITS)
def jn1_join(spark, d):
    """The same hits through the broadcast table used for libraries too large for the plan."""
    docs = fx.documents_long(spark, d).select("ID", "text")
    return _first_evidence(keyword.add_exact_hits_by_table(docs, F.col("text"), DOCS))


#: A library of 9,261 keywords, all words of three of these syllables.
_SYLLABLES = "th er on an re ed nd ou ti at en es or in ha sh st he wh ea ly".split()

_LARGE_HITS = q.with_(
    f"s AS (SELECT unnest({q.list_lit(_SYLLABLES)}) AS t, unnest(range({len(_SYLLABLES)})) AS i)",
    "k AS (SELECT a.i AS pos, b.i * 21 + c.i AS kw, a.t || b.t || c.t AS word FROM s a, s b, s c)",
    f'w AS (SELECT DISTINCT doc_id AS "ID", unnest(string_split_regex(lower(text), \'[^{q.WORD}]+\')) AS word FROM documents)',
) + 'SELECT "ID", pos::INTEGER AS pos, 0::INTEGER AS kind, min_by(word, kw) AS evidence FROM w JOIN k USING (word) GROUP BY "ID", pos'


@query("jn1_exact_keyword_large", _LARGE_HITS)
def jn1_large(spark, d):
    """Exact keywords of a library that is past the size for the plan, on whole documents."""
    subthemes = [
        {"name": a, "keywords_phrases": [a + b + c for b in _SYLLABLES for c in _SYLLABLES]} for a in _SYLLABLES
    ]
    index = keyword.KeywordIndex.from_themes({"themes": {"Syllables": {"subthemes": subthemes}}})
    docs = fx.documents_long(spark, d).select("ID", "text")
    return _first_evidence(keyword.add_exact_hits_by_table(docs, F.col("text"), index))


def _survey_matches(settings: KeywordSettings, only: str = "TRUE") -> str:
    return q.with_(
        q.answers(),
        "flagged_answers AS (SELECT *, is_meaningful AS active FROM answers)",
        q.matches("flagged_answers", INDEX, settings),
    ) + (
        'SELECT a."ID", a."TextColumn", b.rn::INTEGER AS rank, b.theme, b.subtheme, b.method, b.evidence, '
        'round(b.score, 6) AS score FROM flagged_answers a JOIN best b ON a.active AND a."TextColumn" = b."TextColumn" '
        f"AND a.text = b.text WHERE {only}"
    )


def _exploded_matches(long: DataFrame, settings: KeywordSettings, index=INDEX) -> DataFrame:
    matched = keyword.add_matches(long, index, settings, active=F.col("is_meaningful"))
    return explode_rows(matched, ["ID", "TextColumn"], F.col("matches"), "m", "p").select(
        "ID", "TextColumn", (F.col("p") + 1).alias("rank"), "m.theme", "m.subtheme", "m.method", "m.evidence",
        F.round("m.score", 6).alias("score"),
    )


@query("jn2_short_text_tokens", _survey_matches(EXACT, "b.method = 'token_short_text'"))
def jn2(spark, d):
    return _exploded_matches(answers(spark, d), EXACT).filter(F.col("method") == "token_short_text")


JN7 = KeywordSettings(use_fuzzy=False, phrase_first=False, max_token_match_length=25)


@query("jn7_combined_lists", _survey_matches(JN7))
def jn7(spark, d):
    return _exploded_matches(answers(spark, d), JN7)


JN8 = KeywordSettings(use_fuzzy=False, strict_columns=True, column_bonus=0.1, min_accept_score=0.5)


@query("jn8_strict_columns", _survey_matches(JN8))
def jn8(spark, d):
    return _exploded_matches(answers(spark, d), JN8)


JN8_SOFT = KeywordSettings(use_fuzzy=False, column_penalty=0.1, min_accept_score=0.5, prefer_exact=False)


@query("jn8_soft_columns", _survey_matches(JN8_SOFT))
def jn8_soft(spark, d):
    return _exploded_matches(answers(spark, d), JN8_SOFT)


RK1 = KeywordSettings(use_fuzzy=False, min_accept_score=0.7, top_k=2)


@query("rk1_keyword_top_k", _survey_matches(RK1))
def rk1(spark, d):
    return _exploded_matches(answers(spark, d), RK1)


@query(
    "rk2_best_match",
    q.with_("m AS (" + _survey_matches(RK1) + ")")
    + 'SELECT "ID", "TextColumn", theme, subtheme, score FROM m WHERE rank = 1',
)
def rk2(spark, d):
    best = keyword.add_best_match(answers(spark, d), INDEX, RK1, active=F.col("is_meaningful"))
    return best.filter(F.col("match").isNotNull()).select(
        "ID", "TextColumn", "match.theme", "match.subtheme", F.round("match.score", 6).alias("score")
    )


# --------------------------------------------------------------------------------------------------------------
# Fuzzy matching
# --------------------------------------------------------------------------------------------------------------

_TERMS = sorted({k for k, _ in INDEX.entries()})


@query(
    "jn3_containment",
    q.with_(q.answers(), q.values_table("kws", "keyword", [(t,) for t in _TERMS]),
            f"n AS (SELECT DISTINCT text, {q.collapse(q.strip('lower(text)'))} AS t FROM answers)",
            "hit AS (SELECT n.text, keyword FROM n, kws WHERE t <> '' AND contains(t, keyword))")
    + 'SELECT a."ID", a."TextColumn", h.keyword FROM answers a JOIN hit h USING (text)',
)
def jn3(spark, d):
    staged = answers(spark, d).withColumn("n", match_normalise(F.col("text")))
    hits = fuzzy.held_rows(staged, ["ID", "TextColumn"], "n", _TERMS)
    return hits.select("ID", "TextColumn", F.get(F.array(*[F.lit(t) for t in _TERMS]), F.col("term")).alias("keyword"))


_PAIRS = [t for t in _TERMS if " " in t]


@query(
    "jn5_scattered_words",
    q.with_(q.answers(), q.values_table("kws", "keyword", [(t,) for t in _PAIRS]),
            f"n AS (SELECT DISTINCT text, {q.tokens(q.strip('lower(text)'))} AS w FROM answers)",
            "hit AS (SELECT n.text, keyword FROM n, kws WHERE len(list_filter(string_split(keyword, ' '), lambda k: "
            "len(list_filter(w, lambda x: contains(x, k) OR contains(k, x))) > 0)) = len(string_split(keyword, ' ')))")
    + 'SELECT a."ID", a."TextColumn", h.keyword FROM answers a JOIN hit h USING (text)',
)
def jn5(spark, d):
    staged = answers(spark, d).withColumn("n", match_normalise(F.col("text")))
    hits = fuzzy.scattered_rows(staged, ["ID", "TextColumn"], "n", _PAIRS)
    return hits.select("ID", "TextColumn", F.get(F.array(*[F.lit(t) for t in _PAIRS]), F.col("kw")).alias("keyword"))


_MANY_TERMS = 8_000
_MANY_SQL = q.with_(
    f"n AS (SELECT doc_id, {q.collapse(q.strip('lower(text)'))} AS t FROM documents)",
    "w AS (SELECT unnest(string_split(t, ' ')) AS word FROM n WHERE t <> '')",
    f"terms AS (SELECT word FROM w GROUP BY word ORDER BY count(*) DESC, word LIMIT {_MANY_TERMS})",
)


def many_terms(spark, d) -> list[str]:
    """The most frequent words of the documents: a stated number of terms, in the order of their text."""
    n = fx.table(spark, d, "documents").select(match_normalise(F.col("text")).alias("n")).filter("n <> ''")
    counts = explode_rows(n, [], F.split("n", " "), "word").groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    return sorted(r["word"] for r in counts.orderBy(F.desc("c"), "word").limit(_MANY_TERMS).collect())


@query(
    "jn3_containment_many_terms",
    _MANY_SQL + "SELECT doc_id, count(*) AS terms, min(word) AS first FROM n, terms WHERE contains(t, word) GROUP BY doc_id",
)
def jn3_many(spark, d):
    """Thousands of terms in whole documents, one pass over each text."""
    terms = many_terms(spark, d)
    n = fx.spread(fx.table(spark, d, "documents")).select("doc_id", match_normalise(F.col("text")).alias("n"))
    names = spark.createDataFrame(list(enumerate(terms)), "term int, word string")
    hits = fuzzy.held_rows(n, ["doc_id"], "n", terms).join(F.broadcast(names), "term")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.min("word").alias("first"))


_SLOTS = [(i, s.phrase_terms) for i, s in enumerate(INDEX.subthemes)]


@query(
    "jn4_fuzzy_windows",
    q.with_(q.answers(processed=False), "active AS (SELECT * FROM answers WHERE is_meaningful)", fuzzysql.lists("active", _SLOTS, 0.78))
    + 'SELECT a."ID", a."TextColumn", f.slot AS subtheme_pos, round(f.score, 6) AS score, f.evidence FROM active a JOIN fuzzy f USING (text)',
)
def jn4(spark, d):
    """Best fuzzy match of each keyword list, before scoring."""
    slots = [fuzzy.FuzzySlot(i, s.phrase_terms) for i, s in enumerate(INDEX.subthemes)]
    staged = raw_answers(spark, d).withColumn("t", F.when(F.col("is_meaningful"), F.col("text")))
    found = fuzzy.add_fuzzy_matches(staged, "t", slots, 0.78, "found")
    return found.select("ID", "TextColumn", F.explode("found").alias("m")).select(
        "ID", "TextColumn", F.col("m.slot").alias("subtheme_pos"), F.round("m.score", 6).alias("score"), "m.evidence"
    )


@query("jn6_fuzzy_dispatch", _survey_matches(FUZZY))
def jn6(spark, d):
    return _exploded_matches(answers(spark, d), FUZZY)


@query(
    "ud6_sequence_ratio",
    q.with_(q.survey(), 'ab AS (SELECT "ID", lower("Free_Text_1") AS a, lower("Free_Text_2") AS b FROM survey)', fuzzysql.ratio("ab"))
    + 'SELECT "ID", round(ratio, 6) AS ratio FROM ab LEFT JOIN ratio USING (a, b)',
)
def ud6(spark, d):
    pairs = fx.survey(spark, d).select("ID", F.lower("Free_Text_1").alias("a"), F.lower("Free_Text_2").alias("b"))
    return pairs.select("ID", F.round(fuzzy.sequence_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


# --------------------------------------------------------------------------------------------------------------
# Keyword assignment tables
# --------------------------------------------------------------------------------------------------------------

ASSIGNMENT = ", ".join(f'"{c}"' for c in keyword.out.COLUMNS)


@query("cp1_keyword_assignments", q.with_(q.keyword_assignments(EXACT)) + f"SELECT {ASSIGNMENT} FROM assignments")
def cp1(spark, d):
    return rounded(keyword.assign_keyword(answers(spark, d), INDEX, EXACT), "rule_score")


@query(
    "cp1_keyword_assignments_meaningful",
    q.with_(q.keyword_assignments(EXACT)) + f"SELECT {ASSIGNMENT} FROM assignments WHERE is_meaningful",
)
def cp1_meaningful(spark, d):
    settings = KeywordSettings(use_fuzzy=False, include_dismissed=False)
    return rounded(keyword.assign_keyword(answers(spark, d), INDEX, settings), "rule_score")


_DOC_FLAGS = (
    'docs AS (SELECT doc_id AS "ID", lang AS "TextColumn", text, NULL::BOOLEAN AS is_meaningful, '
    f"NOT (length({q.strip('lower(text)')}) <= 2 OR {q.strip('lower(text)')} IN "
    f"{q.in_list(q.lx.DISMISSIVE_SHORT)}) AS active FROM documents)"
)


@query(
    "cp1_keyword_documents",
    q.with_(_DOC_FLAGS, q.matches("docs", DOCS, EXACT))
    + q.assignment_select('s."ID", s."TextColumn", s.is_meaningful', "docs", "FALSE", "''", "''"),
)
def cp1_documents(spark, d):
    """All documents, whole, without quality flags."""
    docs = fx.documents_long(spark, d)
    return rounded(keyword.assign_keyword(docs, DOCS, EXACT), "rule_score")


@query(
    "jn6_fuzzy_documents",
    q.with_(_DOC_FLAGS, q.matches("docs", DOCS, FUZZY))
    + q.assignment_select('s."ID", s."TextColumn", s.is_meaningful', "docs", "FALSE", "''", "''"),
)
def jn6_documents(spark, d):
    """Fuzzy matching over whole documents."""
    docs = fx.documents_long(spark, d)
    return rounded(keyword.assign_keyword(docs, DOCS, FUZZY), "rule_score")


@query("cp1_keyword_fuzzy", q.with_(q.keyword_assignments(FUZZY)) + f"SELECT {ASSIGNMENT} FROM assignments")
def cp1_fuzzy(spark, d):
    return rounded(keyword.assign_keyword(answers(spark, d), INDEX, FUZZY), "rule_score")


@query(
    "ag8_multi_label_collapse",
    q.with_(q.keyword_assignments(RK1))
    + 'SELECT "ID", "TextColumn", theme, subtheme, parent_theme, rule_score, expected_polarity, match_method, evidence '
    "FROM assignments WHERE reason = 'matched'",
)
def ag8(spark, d):
    assigned = keyword.assign_keyword(answers(spark, d), INDEX, RK1).filter(F.col("reason") == "matched")
    return rounded(assigned, "rule_score").drop("is_meaningful", "reason")


# --------------------------------------------------------------------------------------------------------------
# Similarity on the supplied vectors: the label centroids are the phrases
# --------------------------------------------------------------------------------------------------------------


def centroid_library(spark, d) -> DataFrame:
    """One phrase per label and text column: the mean of the label's vectors."""
    vecs = fx.table(spark, d, "embeddings")
    dims = vecs.select("label", F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centroids = means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector")
    )
    label = F.col("label")
    name = F.concat(F.lit("label "), label.cast("string"))
    polarity = F.get(F.array(*[F.lit(p) for p in ("Either", "Positive", "Negative", "Neutral")]), label % 4)
    return centroids.select(
        label.cast("int").alias("phrase_idx"),
        F.when(label < 7, "Free_Text_1").otherwise("Free_Text_2").alias("column"),
        F.concat(F.lit("parent "), (label % 2).cast("string")).alias("parent"),
        F.concat(F.lit("theme "), F.floor(label / 2).cast("string")).alias("theme"),
        name.alias("subtheme"), polarity.alias("polarity"), name.alias("phrase"), "vector",
    )


def vector_answers(spark, d) -> DataFrame:
    key = F.col("vec_id")
    moods = F.array(*[F.lit(m).cast("string") for m in ("Positive", "Negative", "Neutral", "No sentiment", None)])
    return fx.table(spark, d, "embeddings").select(
        key.alias("ID"),
        F.concat(F.lit("Free_Text_"), (key % 3 + 1).cast("string")).alias("TextColumn"),
        F.lit("").alias("text"),
        F.when(key % 11 != 0, True).otherwise(False).alias("is_meaningful"),
        F.when(key % 11 != 0, "Detailed response").when(key % 2 == 0, "Yes").otherwise("").alias("response_detail"),
        F.get(moods, (key % 5).cast("int")).alias("sentiment_label"),
        F.when(key % 11 != 0, F.col("embedding")).alias("vector"),
    )


_VECTORS = ",\n".join(
    [
        "dims AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, unnest(range(1, len(embedding) + 1)) "
        "AS u(i) GROUP BY ALL)",
        "cent AS (SELECT label, list(x ORDER BY i) AS v FROM dims GROUP BY label)",
        "lib AS (SELECT label AS idx, CASE WHEN label < 7 THEN 'Free_Text_1' ELSE 'Free_Text_2' END AS col, "
        "'parent ' || (label % 2) AS parent_theme, 'theme ' || (label // 2) AS theme, 'label ' || label AS subtheme, "
        "['Either', 'Positive', 'Negative', 'Neutral'][(label % 4) + 1] AS polarity, "
        f"{q.unit('v')} AS v FROM cent)",
        "ans AS (SELECT vec_id AS \"ID\", 'Free_Text_' || (vec_id % 3 + 1) AS \"TextColumn\", vec_id % 11 <> 0 "
        "AS is_meaningful, CASE WHEN vec_id % 11 <> 0 THEN 'Detailed response' WHEN vec_id % 2 = 0 THEN 'Yes' ELSE '' END "
        "AS detail, ['Positive', 'Negative', 'Neutral', 'No sentiment', NULL][(vec_id % 5) + 1] AS mood, "
        f"{q.unit('list_transform(embedding, lambda z: z::DOUBLE)')} AS v FROM embeddings)",
    ]
)


def _vector_candidates(threshold: float, top_k: int, weight: float) -> str:
    return ",\n".join(
        [
            _VECTORS,
            "sims AS (SELECT a.\"ID\", a.\"TextColumn\", l.idx, l.theme, l.subtheme, l.parent_theme, l.polarity, "
            f"list_dot_product(a.v, l.v) + CASE WHEN coalesce(a.mood, '') <> '' AND (l.polarity = 'Either' OR "
            f"(l.polarity IN ('Positive', 'Negative') AND l.polarity = a.mood)) THEN {weight} ELSE 0.0 END::DOUBLE AS score "
            'FROM ans a JOIN lib l ON l.col = a."TextColumn" WHERE a.is_meaningful)',
            'cands AS (SELECT *, row_number() OVER (PARTITION BY "ID" ORDER BY score DESC, idx) AS rn FROM sims '
            f"WHERE score >= {threshold} QUALIFY rn <= {top_k})",
        ]
    )


def _candidate_rows(df: DataFrame) -> DataFrame:
    return df.select("ID", "TextColumn", F.posexplode("candidates").alias("p", "c")).select(
        "ID", "TextColumn", (F.col("p") + 1).alias("rank"), "c.subtheme", F.round("c.score", 6).alias("score")
    )


_CAND_SELECT = 'SELECT "ID", "TextColumn", rn::INTEGER AS rank, subtheme, round(score, 6) AS score FROM cands'


@query("jn9_similarity_join", q.with_(_vector_candidates(-2.0, 10, 0.0)) + _CAND_SELECT)
def jn9(spark, d):
    """Every answer against every phrase of its column."""
    return _candidate_rows(semantic.add_candidates(vector_answers(spark, d), centroid_library(spark, d), -2.0, 10, 0.0))


@query("jn9_similarity_expression", q.with_(_vector_candidates(-2.0, 10, 0.0))
       + 'SELECT "ID", subtheme, round(score, 6) AS score FROM sims')
def jn9_expression(spark, d):
    """The same similarities as plain expressions, inside the JVM: the library rides along as one small array."""
    library = semantic.PhraseMatrix.collect(centroid_library(spark, d))
    unit_rows = [
        {"col": str(c), "subtheme": s, "v": [float(x) for x in v]}
        for c, s, v in zip(library.columns, library.labels["subtheme"], library.vectors, strict=True)
    ]
    from verbatim.functions.literals import literal

    phrases = literal(unit_rows, "array<struct<col: string, subtheme: string, v: array<double>>>")
    answers_ = vector_answers(spark, d).filter("is_meaningful").withColumn("u", vectors.unit(F.col("vector")))
    own = F.filter(phrases, lambda p: p["col"] == F.col("TextColumn"))
    return answers_.select("ID", F.col("u"), F.explode(own).alias("p")).select(
        "ID", "p.subtheme", F.round(vectors.dot(F.col("u"), F.col("p.v")), 6).alias("score")
    )


@query("jn10_sentiment_boost", q.with_(_vector_candidates(0.1, 10, 0.15)) + _CAND_SELECT)
def jn10(spark, d):
    return _candidate_rows(semantic.add_candidates(vector_answers(spark, d), centroid_library(spark, d), 0.1, 10, 0.15))


@query("rk3_similarity_top_k", q.with_(_vector_candidates(0.2, 3, 0.15)) + _CAND_SELECT)
def rk3(spark, d):
    return _candidate_rows(semantic.add_candidates(vector_answers(spark, d), centroid_library(spark, d), 0.2, 3, 0.15))


@query("rk3_similarity_top_k_chunked", q.with_(_vector_candidates(0.2, 3, 0.15)) + _CAND_SELECT)
def rk3_chunked(spark, d):
    """The same ranking with a library taken in chunks, as for one too large to broadcast."""
    return _candidate_rows(
        semantic.add_candidates(
            vector_answers(spark, d), centroid_library(spark, d), 0.2, 3, 0.15, max_broadcast_bytes=4 * DIM * 8
        )
    )


_COLLAPSE_VECTORS = (
    "col AS (SELECT \"ID\", string_agg(theme, ' | ' ORDER BY rn) AS theme, "
    "string_agg(subtheme, ' | ' ORDER BY rn) AS subtheme, string_agg(parent_theme, ' | ' ORDER BY rn) AS parent_theme, "
    "avg(score) AS rule_score, min_by(polarity, rn) AS polarity FROM cands GROUP BY \"ID\")"
)


@query(
    "cp2_semantic_vectors",
    q.with_(_vector_candidates(0.35, 3, 0.15), _COLLAPSE_VECTORS)
    + "SELECT a.\"ID\", a.\"TextColumn\", a.is_meaningful, "
    "CASE WHEN NOT a.is_meaningful THEN 'Brief response' ELSE coalesce(c.theme, '') END AS theme, "
    "CASE WHEN NOT a.is_meaningful THEN coalesce(nullif(detail, ''), 'No') ELSE coalesce(c.subtheme, '') END AS subtheme, "
    "CASE WHEN NOT a.is_meaningful THEN 'Brief response' ELSE coalesce(c.parent_theme, '') END AS parent_theme, "
    "round(coalesce(c.rule_score, 0.0), 6)::DOUBLE AS rule_score, coalesce(c.polarity, '') AS expected_polarity, "
    "CASE WHEN NOT a.is_meaningful THEN 'dismissed' WHEN c.theme IS NULL THEN 'none' ELSE 'semantic_similarity' END "
    "AS match_method, coalesce(c.subtheme, '') AS evidence, "
    "CASE WHEN NOT a.is_meaningful THEN CASE WHEN detail <> '' THEN 'dismissed:' || detail ELSE 'dismissed' END "
    "WHEN c.theme IS NOT NULL THEN 'matched' WHEN a.\"TextColumn\" IN (SELECT col FROM lib) THEN 'below_threshold' "
    "ELSE 'no_phrases_for_column' END AS reason FROM ans a LEFT JOIN col c USING (\"ID\")",
)
def cp2_vectors(spark, d):
    assigned = semantic.assign_semantic(vector_answers(spark, d), centroid_library(spark, d))
    return rounded(assigned, "rule_score")


# --------------------------------------------------------------------------------------------------------------
# Similarity on text with the built-in encoder
# --------------------------------------------------------------------------------------------------------------


def _text_library_rows() -> list[tuple]:
    """The companion taxonomy as a phrase library, every phrase in every column it is listed for."""
    rows: list[tuple] = []
    for c in fx.TEXT_COLUMNS:
        for s in INDEX.subthemes:
            if not s.cols or c in s.cols:
                for p in (*s.phrase_terms, *s.token_terms):
                    rows.append((len(rows), c, s.parent_theme, s.theme, s.subtheme, s.polarity, p))
    return rows


def text_library(spark) -> DataFrame:
    return spark.createDataFrame(
        _text_library_rows(),
        "phrase_idx int, column string, parent string, theme string, subtheme string, polarity string, phrase string",
    )


def encoded_library(spark) -> DataFrame:
    return semantic.encode_library(text_library(spark), vectors.hashed_encoder(DIM))


def _text_candidates(
    threshold: float, top_k: int, before: str = "", source: str = "answers", text: str = "text", mood: str = "NULL"
) -> str:
    """CTEs up to ``cands``: the best phrases per distinct (TextColumn, text) of the meaningful rows of ``source``."""
    return ",\n".join(
        [
            before or q.answers(),
            q.values_table("plib", "idx, col, parent_theme, theme, subtheme, polarity, phrase", _text_library_rows()),
            f"pvec AS (SELECT phrase, {q.hashed_vector('phrase', DIM)} AS h FROM (SELECT DISTINCT phrase FROM plib))",
            f"lib AS (SELECT p.*, {q.unit('h')} AS v FROM plib p JOIN pvec USING (phrase))",
            f'pairs AS (SELECT DISTINCT "TextColumn", {text} AS text, {mood}::VARCHAR AS mood FROM {source} '
            "WHERE is_meaningful)",
            f"tvec AS (SELECT text, {q.hashed_vector('text', DIM)} AS h FROM (SELECT DISTINCT text FROM pairs))",
            f"tv AS (SELECT text, {q.unit('h')} AS v FROM tvec)",
            "sims AS (SELECT p.\"TextColumn\", p.text, l.idx, l.theme, l.subtheme, l.parent_theme, l.polarity, l.phrase, "
            "round(list_dot_product(t.v, l.v) + CASE WHEN coalesce(p.mood, '') <> '' AND (l.polarity = 'Either' OR "
            "(l.polarity IN ('Positive', 'Negative') AND l.polarity = p.mood)) THEN 0.15 ELSE 0.0 END::DOUBLE, 10) "
            "AS score FROM pairs p JOIN tv t USING (text) "
            'JOIN lib l ON l.col = p."TextColumn")',
            'cands AS (SELECT *, row_number() OVER (PARTITION BY "TextColumn", text ORDER BY score DESC, idx) AS rn FROM '
            f"sims WHERE score >= {threshold} QUALIFY rn <= {top_k})",
        ]
    )


def _collapse_text(score: str, method: str) -> str:
    return (
        "collapsed AS (SELECT \"TextColumn\", text, string_agg(theme, ' | ' ORDER BY rn) AS theme, "
        "string_agg(subtheme, ' | ' ORDER BY rn) AS subtheme, string_agg(parent_theme, ' | ' ORDER BY rn) AS parent_theme, "
        f"avg({score}) AS rule_score, min_by(polarity, rn) AS expected_polarity, '{method}' AS match_method, "
        "string_agg(phrase, ' | ' ORDER BY rn) AS evidence FROM cands GROUP BY \"TextColumn\", text)"
    )


_SEMANTIC_ROW = q.assignment_select(
    's."ID", s."TextColumn", s.is_meaningful', "active_answers", "NOT s.is_meaningful", "s.response_detail",
    "'dismissed:' || s.response_detail", "'below_threshold'",
)
_ACTIVE = "active_answers AS (SELECT *, is_meaningful AS active FROM answers)"


@query(
    "cp2_semantic_assignments",
    q.with_(_text_candidates(0.35, 3), _collapse_text("score", "semantic_similarity"), _ACTIVE) + _SEMANTIC_ROW,
)
def cp2(spark, d):
    assigned = semantic.assign_semantic(answers(spark, d), encoded_library(spark), vectors.hashed_encoder(DIM))
    return rounded(assigned, "rule_score")


_JACCARD = (
    "CASE WHEN len(wa) > 0 AND len(wb) > 0 THEN len(list_intersect(wa, wb)) / "
    "(len(wa) + len(wb) - len(list_intersect(wa, wb))) ELSE 0.0 END::DOUBLE"
)


def _scored_pairs(template: str, **source: str) -> str:
    return ",\n".join(
        [
            _text_candidates(0.20, 15, **source),
            f"worded AS (SELECT *, list_distinct({q.tokens('lower(text)')}) AS wa, "
            f"list_distinct({q.tokens(f'lower({template})')}) AS wb FROM cands)",
            f"scored AS (SELECT * EXCLUDE (wa, wb), {_JACCARD} AS ce_score FROM worded)",
        ]
    )


@query(
    "jn11_candidate_table",
    q.with_(_text_candidates(0.20, 15))
    + 'SELECT a."ID", a."TextColumn", a.text, s.rn::INTEGER AS rank, s.theme, s.subtheme, s.parent_theme, s.phrase AS matched_phrase, '
    "s.polarity, round(s.score, 6) AS score FROM answers a JOIN cands s "
    'ON a.is_meaningful AND a."TextColumn" = s."TextColumn" AND a.text = s.text',
)
def jn11_table(spark, d):
    table = rerank.candidate_table(answers(spark, d), encoded_library(spark), vectors.hashed_encoder(DIM))
    return rounded(table, "score")


RERANK = SemanticSettings(pair_template="{theme}: {phrase}")
_PAIR_SQL = "theme || ': ' || phrase"


@query(
    "jn11_candidate_scores",
    q.with_(_scored_pairs(_PAIR_SQL))
    + 'SELECT a."ID", a."TextColumn", a.text, s.theme, s.subtheme, s.parent_theme, s.phrase AS matched_phrase, '
    "round(s.score, 6) AS bi_score, round(s.ce_score, 6) AS ce_score FROM answers a JOIN scored s "
    'ON a.is_meaningful AND a."TextColumn" = s."TextColumn" AND a.text = s.text',
)
def jn11(spark, d):
    scored = rerank.add_scored_candidates(
        answers(spark, d), encoded_library(spark), plugins.overlap_pair_scorer(), vectors.hashed_encoder(DIM), RERANK
    )
    return rounded(rerank.candidate_scores(scored), "bi_score", "ce_score")


_RERANKED = (
    "ranked AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY \"TextColumn\", text ORDER BY ce_score DESC, rn) "
    "AS rn FROM scored QUALIFY row_number() OVER (PARTITION BY \"TextColumn\", text ORDER BY ce_score DESC, rn) <= 3)"
)


@query(
    "cp3_reranked_assignments",
    q.with_(_scored_pairs(_PAIR_SQL), _RERANKED,
            _collapse_text("ce_score", "semantic_cross_encoder").replace("FROM cands", "FROM ranked"), _ACTIVE)
    + _SEMANTIC_ROW,
)
def cp3(spark, d):
    assigned = rerank.assign_reranked(
        answers(spark, d), encoded_library(spark), plugins.overlap_pair_scorer(), vectors.hashed_encoder(DIM), RERANK
    )
    return rounded(assigned, "rule_score")


@query(
    "rk4_reranked_top_k",
    q.with_(_scored_pairs(_PAIR_SQL), _RERANKED)
    + 'SELECT a."ID", a."TextColumn", r.rn::INTEGER AS rank, r.phrase, round(r.ce_score, 6) AS ce_score FROM answers a '
    'JOIN ranked r ON a.is_meaningful AND a."TextColumn" = r."TextColumn" AND a.text = r.text',
)
def rk4(spark, d):
    scored = rerank.add_scored_candidates(
        answers(spark, d), encoded_library(spark), plugins.overlap_pair_scorer(), vectors.hashed_encoder(DIM), RERANK
    )
    return rerank.rerank(scored, 3).select("ID", "TextColumn", F.posexplode("candidates").alias("p", "c")).select(
        "ID", "TextColumn", (F.col("p") + 1).alias("rank"), F.col("c.matched_phrase").alias("phrase"),
        F.round("c.ce_score", 6).alias("ce_score"),
    )


@query(
    "ud2_hashed_encoder",
    q.with_(f"h AS (SELECT doc_id, {q.hashed_vector('text', DIM)} AS h FROM documents)",
            f"u AS (SELECT doc_id, {q.unit('h')} AS v FROM h)")
    + "SELECT doc_id, (i - 1)::INTEGER AS dim, round(v[i], 6) AS x FROM u, unnest(range(1, len(v) + 1)) AS t(i)",
)
def ud2(spark, d):
    encoded = fx.table(spark, d, "documents").select("doc_id", vectors.hashed_encoder(DIM)(F.col("text")).alias("v"))
    return encoded.select("doc_id", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(
    "ud2_encode_once",
    q.with_(q.survey(), q.survey_long(),
            f"h AS (SELECT text, {q.hashed_vector('text', DIM)} AS h FROM (SELECT DISTINCT coalesce(text, '') AS text FROM long))",
            f"u AS (SELECT text, {q.unit('h')} AS v FROM h)")
    + 'SELECT l."ID", l."TextColumn", round(list_max(u.v), 6) AS largest, len(list_filter(u.v, lambda x: x > 0))::INTEGER AS filled '
    "FROM long l JOIN u ON u.text = coalesce(l.text, '')",
)
def ud2_once(spark, d):
    """Vectors of all answers through a store by content, filled from a half of them first."""
    store = scratch_folder(spark) + "/vectors"
    long = raw_answers(spark, d).select("ID", "TextColumn", "text")
    encoded.add_vectors(long.filter("ID % 2 = 0"), vectors.hashed_encoder(DIM), store)
    out = encoded.add_vectors(long, vectors.hashed_encoder(DIM), store)
    filled = F.size(F.filter("vector", lambda x: x > 0))
    return out.select("ID", "TextColumn", F.round(F.array_max("vector"), 6).alias("largest"), filled.alias("filled"))


@query(
    "ud3_overlap_pair_scorer",
    q.with_(q.survey(),
            f"w AS (SELECT \"ID\", list_distinct({q.tokens('lower(coalesce(\"Free_Text_1\", chr(32)))')}) AS wa, "
            f"list_distinct({q.tokens('lower(coalesce(\"Free_Text_2\", chr(32)))')}) AS wb FROM survey)")
    + f'SELECT "ID", round({_JACCARD}, 6) AS score FROM w',
)
def ud3(spark, d):
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in fx.TEXT_COLUMNS[:2])
    score = F.get(plugins.overlap_pair_scorer()(a, F.array(b)), F.lit(0))
    return fx.survey(spark, d).select("ID", F.round(score, 6).alias("score"))
