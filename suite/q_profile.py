"""Profiles, trends and discovery (DX)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import fixture as fx
from suite import q_match as qm
from suite import q_reports as qr
from suite import q_sentiment as qs
from suite import sqltext as q
from suite.registry import query
from verbatim import lexicons as lx
from verbatim.functions import plugins, vectors
from verbatim.functions.sentiment import lexicon_probs, lexicon_scorer, sentiment_label
from verbatim.operators import labels, profile, semantic
from verbatim.sources.survey import spread

_MENTIONS = (
    f"ment AS (SELECT a.\"ID\", u.t AS theme FROM assignments a, unnest({q.split_multi('theme')}) AS u(t) "
    "WHERE lower(u.t) <> 'brief response')"
)


@query(
    "dx2_theme_trend",
    q.with_(qr.ASSIGNED, _MENTIONS,
            "cnt AS (SELECT survey_period AS period, theme, count(*) AS mentions FROM ment JOIN survey USING (\"ID\") "
            "GROUP BY ALL)")
    + "SELECT *, mentions - lag(mentions) OVER (PARTITION BY theme ORDER BY period) AS change FROM cnt",
)
def dx2(spark, d):
    periods = fx.survey(spark, d).select("ID", F.col("survey_period").alias("period"))
    return profile.theme_trend(qr.assignments(spark, d), periods)


@query(
    "dx3_theme_scores",
    q.with_(qr.ASSIGNED, _MENTIONS)
    + "SELECT theme, count(*) AS mentions, round(avg(score), 6) AS mean_score FROM ment JOIN survey USING (\"ID\") "
    "GROUP BY theme",
)
def dx3(spark, d):
    scores = fx.survey(spark, d).select("ID", "score")
    return qm.rounded(profile.theme_scores(qr.assignments(spark, d), scores), "mean_score")


@query(
    "dx3_theme_scores_documents",
    q.with_(qm._DOC_FLAGS, q.matches("docs", qm.DOCS, qm.EXACT),
            "a AS (" + q.assignment_select('s."ID"', "docs", "FALSE", "''", "''") + ")",
            f"m AS (SELECT a.\"ID\", u.t AS theme FROM a, unnest({q.split_multi('theme')}) AS u(t))")
    + "SELECT theme, count(*) AS mentions, round(avg(quality), 6) AS mean_score FROM m JOIN labels ON doc_id = \"ID\" "
    "GROUP BY theme",
)
def dx3_documents(spark, d):
    """Document themes against the supplied quality labels."""
    from verbatim.operators import keyword

    assigned = keyword.assign_keyword(fx.documents_long(spark, d), qm.DOCS, qm.EXACT)
    labels = fx.table(spark, d, "labels").select(F.col("doc_id").alias("ID"), F.col("quality").alias("score"))
    return qm.rounded(profile.theme_scores(assigned, labels), "mean_score")


@query(
    "dx4_score_correlation",
    q.with_(qs.SENTIMENT)
    + "SELECT count(*) AS n, round(corr(compound, score), 6) AS correlation FROM sentiment JOIN survey USING (\"ID\") "
    "WHERE compound IS NOT NULL",
)
def dx4(spark, d):
    return qm.rounded(profile.score_correlation(qs.scored_survey(spark, d)), "correlation")


@query(
    "dx4_sentiment_by_score_bin",
    q.with_(qs.SENTIMENT)
    + "SELECT (floor(score / 2.0) * 2.0)::DOUBLE AS bin, count(*) AS n, round(avg(compound), 6) AS mean_compound "
    "FROM sentiment JOIN survey USING (\"ID\") WHERE compound IS NOT NULL GROUP BY ALL",
)
def dx4_bins(spark, d):
    return qm.rounded(profile.sentiment_by_score_bin(qs.scored_survey(spark, d), 2.0), "mean_compound")


def _pct(condition: str) -> str:
    return f"round(count(*) FILTER (coalesce({condition}, FALSE)) / count(*) * 100, 6)"


_LENGTHS = (
    f"len_ AS (SELECT length(coalesce(text, '')) AS chars, len({q.tokens('text')}) AS words, "
    f"{q.strip('coalesce(text, chr(32))')} = '' AS empty, len(list_filter(string_split_regex(coalesce(text, ''), "
    f"'[.!?]+'), lambda s: {q.strip('s')} <> '')) AS sentences FROM texts)"
)


@query(
    "dx5_length_profile",
    q.with_(q.survey(), q.all_texts(), _LENGTHS)
    + "SELECT count(*) AS rows, round(avg(chars) FILTER (NOT empty), 6) AS mean_chars, "
    "round(avg(words) FILTER (NOT empty), 6) AS mean_words, round(avg(sentences) FILTER (NOT empty), 6) AS mean_sentences, "
    f"{_pct('NOT empty AND words <= 5')} AS very_short_pct, {_pct('words = 1')} AS single_word_pct, "
    f"{_pct('empty')} AS empty_pct FROM len_",
)
def dx5(spark, d):
    out = profile.length_profile(fx.all_texts(spark, d))
    return qm.rounded(out, *[c for c in out.columns if c != "rows"])


_P, _N = q.lexicon_counts("text")


@query(
    "dx6_sentiment_bands",
    q.with_(q.survey(), q.all_texts(),
            f"c AS (SELECT {_P} AS p, {_N} AS n FROM texts)",
            "s AS (SELECT p, n, (p - n) / (p + n + 1.0::DOUBLE) AS c FROM c)")
    + "SELECT CASE WHEN c <= -0.5 THEN 'Strongly negative' WHEN c <= -0.05 THEN 'Negative' WHEN c < 0.05 THEN 'Neutral' "
    "WHEN c < 0.5 THEN 'Positive' ELSE 'Strongly positive' END AS band, count(*) AS count, "
    "count(*) FILTER (p > 0 AND n > 0) AS mixed FROM s GROUP BY ALL",
)
def dx6(spark, d):
    scored = fx.all_texts(spark, d).select(
        lexicon_scorer()(F.col("text")).alias("compound"), lexicon_probs(F.col("text")).alias("p")
    )
    return profile.sentiment_bands(scored.select("compound", "p.pos", "p.neg"))


_TONES = {
    "modal": lx.MODAL_WORDS, "hedge": lx.HEDGE_WORDS, "intensifier": lx.INTENSIFIER_WORDS, "negation": lx.NEGATION_WORDS,
    "suggestion": lx.SUGGESTION_WORDS,
}


@query(
    "dx7_tone_profile",
    q.with_(q.survey(), q.all_texts())
    + "SELECT count(*) AS rows, "
    + ", ".join(f"{_pct(q.matches_any('text', t))} AS {n}_pct" for n, t in _TONES.items())
    + " FROM texts",
)
def dx7(spark, d):
    out = profile.tone_profile(fx.all_texts(spark, d))
    return qm.rounded(out, *[c for c in out.columns if c != "rows"])


@query(
    "dx8_junk_profile",
    q.with_(
        q.survey(), q.all_texts(),
        f"t AS (SELECT coalesce(text, '') AS c, {q.tokens('lower(text)')} AS t FROM texts)",
        f"s AS (SELECT *, len(list_filter(t, lambda w: w IN {q.in_list(sorted(lx.BASE_STOPWORDS))})) AS stops FROM t)",
    )
    + f"SELECT count(*) AS rows, {_pct('len(t) = 1')} AS single_word_pct, "
    f"{_pct('len(t) > 0 AND stops >= len(t) * 0.8')} AS stopword_heavy_pct, "
    f"{_pct('lower(' + q.strip('c') + ') IN ' + q.in_list(lx.FILLER_WORDS))} AS filler_pct, "
    + _pct(q.strip("c") + " <> '' AND NOT regexp_matches(c, '\\p{L}')")
    + " AS non_linguistic_pct FROM s",
)
def dx8(spark, d):
    out = profile.junk_profile(fx.all_texts(spark, d))
    return qm.rounded(out, *[c for c in out.columns if c != "rows"])


@query(
    "dx9_topic_entropy",
    q.with_(qr.ASSIGNED, qr.LABELS,
            "cnt AS (SELECT theme, count(*) AS n FROM labels_ WHERE lower(theme) <> 'brief response' GROUP BY theme)",
            "p AS (SELECT n / sum(n) OVER () AS p FROM cnt)")
    + "SELECT count(*) AS topics, round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / ln(count(*)) * 100, 6) "
    "AS diversity_pct FROM p",
)
def dx9(spark, d):
    from verbatim.operators import reports

    surface = profile.topic_surface(reports.theme_counts(qr.assignments(spark, d)))
    return qm.rounded(surface, "entropy", "diversity_pct")


def _clusters_sql(points: str, k: int, rounds: int = 20) -> str:
    """CTEs up to ``clustered``(id, cluster) of ``points``(id, v): the rounds as a recursion over the list of centres."""
    nearest = "list_position(gaps, list_min(gaps))"
    gaps = "list_transform(cs, lambda c: list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"
    return ",\n".join(
        [
            points,
            f"c0 AS (SELECT list(v ORDER BY id) AS cs FROM (SELECT id, v FROM points ORDER BY id LIMIT {k}))",
            "km(round, cs) AS (SELECT 0, cs FROM c0 UNION ALL SELECT any_value(round) + 1, list_transform(range(1, len(any_value(cs)) + 1), "
            "lambda i: coalesce(list_filter(list({'c': c, 'm': m}), lambda g: g.c = i)[1].m, any_value(cs)[i])) FROM ("
            "SELECT any_value(round) AS round, any_value(cs) AS cs, c, list(x ORDER BY i) AS m FROM ("
            "SELECT any_value(round) AS round, any_value(cs) AS cs, c, i, avg(x) AS x FROM ("
            f"SELECT round, cs, {nearest} AS c, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM ("
            f"SELECT round, cs, v, {gaps} AS gaps FROM km, points WHERE round < {rounds})) GROUP BY c, i) GROUP BY c) HAVING count(*) > 0)",
            f"clustered AS (SELECT id, {nearest} - 1 AS cluster FROM (SELECT id, {gaps} AS gaps FROM points, (SELECT cs FROM km ORDER BY round DESC LIMIT 1)))",
        ]
    )


_VECTOR_POINTS = "points AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL)"


@query(
    "dx9_topic_clusters",
    q.with_(_clusters_sql(_VECTOR_POINTS, 10), "cnt AS (SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster)",
            "p AS (SELECT n / sum(n) OVER () AS p FROM cnt)")
    + "SELECT count(*) AS topics, round(-sum(p * ln(p)), 6) AS entropy, round(-sum(p * ln(p)) / ln(count(*)) * 100, 6) "
    "AS diversity_pct FROM p",
)
def dx9_clusters(spark, d):
    """Clusters of the supplied vectors, their sizes and entropy."""
    clustered = profile.cluster_vectors(fx.table(spark, d, "embeddings"), 10, "embedding", "vec_id")
    surface = profile.topic_surface(clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("count")))
    return qm.rounded(surface, "entropy", "diversity_pct")


_DOC_POINTS = (
    f"points AS (SELECT id, {q.unit('h')} AS v FROM (SELECT doc_id AS id, {q.hashed_vector('text', 32)} AS h FROM documents))"
)


@query(
    "dx10_cluster_discovery",
    q.with_(
        _clusters_sql(_DOC_POINTS, 6),
        f"docs AS (SELECT c.cluster, d.text, {q.sentiment_label('s')} AS label FROM (SELECT doc_id, text, {q.lexicon_score('text')} AS s "
        "FROM documents) d JOIN clustered c ON c.id = d.doc_id)",
        f"ws AS (SELECT cluster, list_filter(string_split_regex(lower(text), '[^{q.WORD}]+'), lambda w: w <> '' AND w NOT IN "
        f"{q.in_list(sorted(set(lx.BASE_STOPWORDS)))}) AS w FROM docs)",
        "ph AS (SELECT cluster, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM ws)",
        "tops AS (SELECT cluster, phrase, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, phrase) AS rn FROM ph "
        "GROUP BY cluster, phrase QUALIFY rn <= 3)",
        "named AS (SELECT cluster, string_agg(phrase, ' | ' ORDER BY rn) AS top_phrases FROM tops GROUP BY cluster)",
        "sized AS (SELECT cluster, count(*) AS size, count(*) FILTER (label = 'Positive') AS pos_count, "
        "count(*) FILTER (label = 'Negative') AS neg_count, count(*) FILTER (label = 'Neutral') AS neutral_count FROM docs GROUP BY cluster)",
    )
    + "SELECT cluster::INTEGER AS cluster, size, pos_count, neg_count, neutral_count, top_phrases FROM sized LEFT JOIN named USING (cluster)",
)
def dx10(spark, d):
    """Clusters of all documents by their hashed vectors, with top word pairs and sentiment mix."""
    docs = spread(fx.table(spark, d, "documents")).select(
        "doc_id", "text", vectors.hashed_encoder(32)(F.col("text")).alias("vector"),
        sentiment_label(lexicon_scorer()(F.col("text"))).alias("sentiment_label"),
    )
    return profile.describe_clusters(profile.cluster_vectors(docs, 6, order="doc_id"))


@query(
    "dx11_score_distribution",
    q.with_(qm._vector_candidates(0.05, 3, 0.15),
            "m AS (SELECT avg(score) AS s FROM cands GROUP BY \"ID\")")
    + "SELECT count(*) AS n, round(min(s), 6) AS min, round(quantile_cont(s, 0.25), 6) AS q1, "
    "round(quantile_cont(s, 0.5), 6) AS median, round(quantile_cont(s, 0.75), 6) AS q3, round(max(s), 6) AS max, "
    "round(avg(s), 6) AS mean FROM m",
)
def dx11(spark, d):
    from verbatim.settings import SemanticSettings

    assigned = semantic.assign_semantic(
        qm.vector_answers(spark, d), qm.centroid_library(spark, d), settings=SemanticSettings(similarity_threshold=0.05)
    )
    out = profile.score_distribution(assigned)
    return qm.rounded(out, *[c for c in out.columns if c != "n"])


@query(
    "dx12_parent_share",
    q.with_(qr.ASSIGNED,
            f"p AS (SELECT u.t AS parent_theme FROM assignments, unnest({q.split_multi('parent_theme')}) AS u(t) "
            "WHERE reason = 'matched')",
            "c AS (SELECT parent_theme, count(*) AS count FROM p GROUP BY ALL)")
    + "SELECT parent_theme, count, round(count / sum(count) OVER () * 100, 6) AS share_pct FROM c",
)
def dx12(spark, d):
    return qm.rounded(profile.parent_share(qr.assignments(spark, d)), "share_pct")


@query("dx14_vector_classifier")
def dx14(spark, d):
    """A classifier trained on the labelled vectors, applied to all of them."""
    vecs = fx.table(spark, d, "embeddings")
    return profile.classify_vectors(vecs, vecs, "embedding").select("vec_id", "label", "predicted")


def _labels_sql(rounds: int = 40) -> str:
    """CTEs up to ``judged``: the rounds as a recursion over weights (label, component), then thresholds and counts."""
    step = "(4.0 / (SELECT avg(list_sum(list_transform(v, lambda x: x * x))) FROM train) / (SELECT count(*) FROM train))"
    return ",\n".join(
        [
            "marks AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)",
            f"hashed AS (SELECT doc_id, lang, {q.unit('h')} AS u FROM (SELECT doc_id, lang, {q.hashed_vector('text', 64)} AS h FROM documents))",
            "pts AS (SELECT d.doc_id AS id, list_append(u, 1.0::DOUBLE) AS v, list_filter([lang, CASE WHEN quality = 1 THEN 'good' END, "
            "CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS own, "
            "('0x' || substr(md5(d.doc_id::VARCHAR), 1, 8))::BIGINT % 10 AS fold FROM hashed d LEFT JOIN marks USING (doc_id))",
            "train AS (SELECT * FROM pts WHERE fold > 3)",
            "names AS (SELECT DISTINCT unnest(own) AS label FROM train)",
            "long AS MATERIALIZED (SELECT id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM train)",
            "truth AS MATERIALIZED (SELECT id, label, list_contains(own, label)::INT AS y FROM train, names)",
            f"size AS MATERIALIZED (SELECT {step} AS step)",
            "w(round, label, i, w) AS (SELECT 0, label, i, 0.0::DOUBLE FROM names, (SELECT DISTINCT i FROM long) UNION ALL "
            "SELECT w.round + 1, w.label, w.i, w.w - step * g.g FROM w, size, (SELECT e.label, l.i, sum(e.e * l.x) AS g FROM "
            "(SELECT z.id, z.label, 1 / (1 + exp(-z.z)) - t.y AS e FROM (SELECT l.id, w.label, sum(w.w * l.x) AS z FROM long l "
            "JOIN w ON w.i = l.i GROUP BY l.id, w.label) z JOIN truth t ON t.id = z.id AND t.label = z.label) e "
            f"JOIN long l ON l.id = e.id GROUP BY e.label, l.i) g WHERE w.round < {rounds} AND g.label = w.label AND g.i = w.i)",
            f"model AS (SELECT label, list(w ORDER BY i) AS w FROM w WHERE round = {rounds} GROUP BY label)",
            "scored AS (SELECT fold < 2 AS held, label, list_contains(own, label) AS y, "
            "least(floor(20 / (1 + exp(-list_dot_product(v, w)))), 19) AS place FROM pts, model WHERE fold < 4)",
            "table_ AS (SELECT held, label, step, count(*) FILTER (place >= step AND y) AS tp, count(*) FILTER (place >= step AND NOT y) "
            "AS fp, count(*) FILTER (place < step AND y) AS fn FROM scored, range(1, 20) r(step) GROUP BY ALL)",
            "rated AS (SELECT *, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM table_)",
            "chosen AS (SELECT label, step FROM rated WHERE NOT held QUALIFY row_number() OVER (PARTITION BY label ORDER BY "
            "round(coalesce(f1, 0), 12) DESC, abs(step - 10), step) = 1)",
            "judged AS (SELECT r.* FROM rated r JOIN chosen USING (label, step) WHERE held)",
        ]
    )


@query(
    "dx14_label_metrics",
    q.with_(_labels_sql())
    + "SELECT label, step / 20 AS threshold, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, "
    "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(f1, 6) AS f1 FROM judged",
)
def dx14_metrics(spark, d):
    """Language, quality and toxicity of all documents, learned at once from hashed vectors and judged on held-out documents."""
    marks = fx.table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = spread(fx.table(spark, d, "documents")).join(marks, "doc_id", "left").select(
        "doc_id", vectors.hashed_encoder(64)(F.col("text")).alias("vector"),
        F.array_compact(F.array("lang", F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))).alias("labels"),
    )
    return qm.rounded(labels.train_and_judge(docs, "doc_id", "vector", "labels")[1], "precision", "recall", "f1")


_THEMES = ["late delivery", "high prices", "good quality", "friendly staff", "slow app", "refund"]
_HYPOTHESES = [f"This response is about {t}" for t in _THEMES]


@query(
    "dx15_hypothesis_themes",
    q.with_(
        q.survey(), q.survey_long(),
        "dt AS (SELECT DISTINCT text FROM long)",
        q.values_table("hyp", "i, theme, hypothesis", [(i, t, h) for i, (t, h) in enumerate(zip(_THEMES, _HYPOTHESES, strict=True))]),
        f"w AS (SELECT text, i, theme, list_distinct({q.tokens('lower(coalesce(text, chr(32)))')}) AS wa, "
        f"list_distinct({q.tokens('lower(hypothesis)')}) AS wb FROM dt, hyp)",
        f"s AS (SELECT text, i, theme, {qm._JACCARD} AS score FROM w)",
        "r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY score DESC, i) AS rn FROM s WHERE score >= 0.05 "
        "QUALIFY rn <= 2)",
        "c AS (SELECT text, string_agg(theme, ' | ' ORDER BY rn) AS theme, max(score) AS score FROM r GROUP BY text)",
    )
    + 'SELECT l."ID", l."TextColumn", coalesce(c.theme, \'\') AS theme, round(coalesce(c.score, 0.0), 6)::DOUBLE AS score '
    "FROM long l LEFT JOIN c USING (text)",
)
def dx15(spark, d):
    from verbatim.operators.reshape import matching_long

    long = matching_long(fx.survey(spark, d), fx.TEXT_COLUMNS, carry=())
    out = profile.hypothesis_themes(long, _THEMES, plugins.overlap_pair_scorer(), 0.05, top_k=2)
    return qm.rounded(out, "score")
