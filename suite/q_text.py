"""Text functions and predicates (TX, PR)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suite import fixture as fx
from suite import sqltext as q
from suite.registry import query
from verbatim import lexicons as lx
from verbatim.functions import phrases, quality, sentiment, text
from verbatim.operators import frequency
from verbatim.operators import quality as quality_ops
from verbatim.operators.reshape import response_long

D = fx.dictionary()
TEXTS = q.with_(q.survey(), q.all_texts())
NORMALISED = q.with_(q.survey(), q.all_texts(), f"n AS (SELECT key, {q.normalise('text')} AS x FROM texts)")
SEP = "¦"


def _over_texts(spark, d, **columns: Column) -> DataFrame:
    return fx.all_texts(spark, d).select("key", *[c.alias(n) for n, c in columns.items()])


def _joined(c: Column) -> Column:
    return F.array_join(c, SEP)


T = lambda: F.col("text")


@query("tx1_basic_normalise", TEXTS + f"SELECT key, {q.normalise('text')} AS normalised FROM texts")
def tx1(spark, d):
    return _over_texts(spark, d, normalised=text.basic_normalise(T()))


@query(
    "tx2_business_map",
    NORMALISED + f"SELECT key, {q.unless_no_entry('x', q.replace_terms('x', D.business_map))} AS mapped FROM n",
)
def tx2(spark, d):
    n = _over_texts(spark, d, x=text.basic_normalise(T()))
    return n.select("key", text.apply_business_map(F.col("x"), D.business_map).alias("mapped"))


@query(
    "tx3_merge_to_canonical",
    NORMALISED + f"SELECT key, {q.unless_no_entry('x', q.map_tokens('x', D.merge_map))} AS merged FROM n",
)
def tx3(spark, d):
    n = _over_texts(spark, d, x=text.basic_normalise(T()))
    return n.select("key", text.merge_to_canonical(F.col("x"), D.merge_map).alias("merged"))


@query(
    "tx4_force_phrases",
    NORMALISED + f"SELECT key, {q.unless_no_entry('x', q.join_phrases('x', D.force_phrases))} AS forced FROM n",
)
def tx4(spark, d):
    n = _over_texts(spark, d, x=text.basic_normalise(T()))
    return n.select("key", text.force_phrases(F.col("x"), D.force_phrases).alias("forced"))


@query(
    "tx5_keep_unigrams",
    NORMALISED
    + "SELECT key, "
    + q.unless_no_entry("x", q.keep_tokens("x", D.unigram_whitelist, D.always_drop, D.must_be_phrase))
    + " AS kept FROM n",
)
def tx5(spark, d):
    n = _over_texts(spark, d, x=text.basic_normalise(T()))
    return n.select(
        "key",
        text.keep_unigrams(F.col("x"), D.unigram_whitelist, D.always_drop, D.must_be_phrase).alias("kept"),
    )


@query(
    "tx6_preprocess_text",
    q.with_(q.survey(), q.all_texts(), q.preprocessed("p", "texts", "key")) + "SELECT key, processed FROM p",
)
def tx6(spark, d):
    return _over_texts(spark, d, processed=text.preprocess(T(), D))


@query(
    "tx7_preprocess_columns",
    q.with_(
        q.survey(), q.survey_long(), "dt AS (SELECT DISTINCT text FROM long)", q.preprocessed("p", "dt", "text"),
        "a AS (SELECT l.\"ID\", l.\"TextColumn\", p.processed FROM long l JOIN p ON l.text IS NOT DISTINCT FROM p.text)",
    )
    + 'SELECT "ID", '
    + ", ".join(
        f"max(CASE WHEN \"TextColumn\" = '{c}' THEN processed END) AS \"{c}_processed\"" for c in fx.TEXT_COLUMNS
    )
    + ' FROM a GROUP BY "ID"',
)
def tx7(spark, d):
    df = quality_ops.preprocess_columns(fx.survey(spark, d), fx.TEXT_COLUMNS, D)
    return df.select("ID", *[f"{c}_processed" for c in fx.TEXT_COLUMNS])


@query("tx8_frequency_normalise", TEXTS + f"SELECT key, {q.frequency_normalise('text')} AS normalised FROM texts")
def tx8(spark, d):
    return _over_texts(spark, d, normalised=text.frequency_normalise(T()))


FREQUENCY = q.with_(
    q.survey(), q.all_texts(),
    f"f1 AS (SELECT key, {q.frequency_normalise('text')} AS x FROM texts)",
    f"f2 AS (SELECT key, {q.replace_terms('x', D.business_map)} AS x FROM f1)",
    f"f3 AS (SELECT key, {q.map_tokens('x', D.merge_map)} AS x FROM f2)",
    f"f4 AS (SELECT key, {q.join_phrases('x', D.force_phrases)} AS x FROM f3)",
)


@query("tx9_frequency_preprocess", FREQUENCY + "SELECT key, x AS processed FROM f4")
def tx9(spark, d):
    return _over_texts(spark, d, processed=text.frequency_preprocess(T(), D))


def frequency_token_filter(phrases_only: bool, min_len: int = 3) -> str:
    stop = q.in_list(sorted(frequency.stopwords(D)))
    single = (
        f"(t NOT IN {stop} AND t NOT IN {q.in_list(sorted(D.must_be_phrase))} AND NOT regexp_full_match(t, '[0-9]+') "
        f"AND (length(t) >= {min_len} OR t IN {q.in_list(sorted(D.unigram_whitelist))}))"
    )
    return f"list_filter({q.tokens('x')}, lambda t: contains(t, '_') OR ({q.lit(not phrases_only)} AND {single}))"


@query(
    "tx10_frequency_tokens",
    FREQUENCY
    + f"SELECT key, array_to_string({frequency_token_filter(False)}, '{SEP}') AS tokens, "
    + f"array_to_string({frequency_token_filter(True)}, '{SEP}') AS phrases FROM f4",
)
def tx10(spark, d):
    staged = _over_texts(spark, d, x=text.frequency_preprocess(T(), D))
    stop = frequency.stopwords(D)
    return staged.select(
        "key",
        _joined(text.frequency_tokens(F.col("x"), D, stop, keep_phrases_only=False)).alias("tokens"),
        _joined(text.frequency_tokens(F.col("x"), D, stop, keep_phrases_only=True)).alias("phrases"),
    )


@query(
    "tx11_match_normalise",
    TEXTS + f"SELECT key, {q.collapse(q.strip('lower(coalesce(text, ' + chr(39) * 2 + '))'))} AS normalised FROM texts",
)
def tx11(spark, d):
    return _over_texts(spark, d, normalised=text.match_normalise(T()))


@query("tx12_token_count", TEXTS + f"SELECT key, len({q.tokens('text')})::INTEGER AS n_tokens FROM texts")
def tx12(spark, d):
    return _over_texts(spark, d, n_tokens=text.token_count(T()))


@query(
    "tx13_split_multi",
    TEXTS
    + f"SELECT key, len({q.split_multi('text')})::INTEGER AS n, array_to_string({q.split_multi('text')}, '{SEP}') AS parts "
    "FROM texts",
)
def tx13(spark, d):
    parts = text.split_multi(T())
    return _over_texts(spark, d, n=F.size(parts), parts=_joined(parts))


@query(
    "tx14_phrase_or_token",
    "SELECT p_partkey, t.term, regexp_matches(trim(t.term), '[ _-]') AS is_phrase FROM part, "
    "unnest([p_name, p_brand, p_type, replace(p_name, ' ', '_'), replace(p_name, ' ', '-'), ' ' || p_type || ' ']) "
    "AS t(term)",
)
def tx14(spark, d):
    part = fx.table(spark, d, "part")
    terms = F.array(
        "p_name", "p_brand", "p_type", F.replace("p_name", F.lit(" "), F.lit("_")),
        F.replace("p_name", F.lit(" "), F.lit("-")), F.concat(F.lit(" "), "p_type", F.lit(" ")),
    )
    return part.select("p_partkey", F.explode(terms).alias("term")).withColumn("is_phrase", text.is_phrase(F.col("term")))


# Sentences with American wording around each part's name and each nation's code words.
_US = [
    "We organize the {a} center and the manager asked for PTO",
    "The line manager canceled my vacation for {a}",
    "Color of {a}: favorite program, behavior of the doctor and two sick days",
    "Resume, severance and layoffs were on the performance review of {a}",
    "My cell phone and gas for {a} under health insurance; a paid holiday",
    "Manager, airline manager and LINE MANAGER need {a}!",
]


def regional(spark, d) -> DataFrame:
    part = fx.table(spark, d, "part")
    sentence = F.get(F.array(*[F.lit(s) for s in _US]), (F.col("p_partkey") % len(_US)).cast("int"))
    return part.select(F.col("p_partkey").alias("key"), F.replace(sentence, F.lit("{a}"), F.col("p_name")).alias("text"))


REGIONAL = (
    f"regional AS (SELECT p_partkey AS key, replace({q.list_lit(_US)}[(p_partkey % {len(_US)}) + 1], '{{a}}', p_name) "
    "AS text FROM part)"
)


def uk_wording(x: str) -> str:
    out = q.mark(x)
    terms = {**lx.UK_SPELLINGS, **{}}
    for us, uk in terms.items():
        out = f"regexp_replace({out}, '{q.marked(us)}', '{q.marked(uk)}', 'gi')"
    for term, uk in lx.US_TO_UK_TERMS.items():
        stem = q.marked(term.removesuffix("(s)"))
        if term.endswith("(s)"):
            stem = stem[:-1] + "s?" + q.CLOSE
        out = f"regexp_replace({out}, '{stem}', '{q.marked(uk)}', 'gi')"
    line, manager = f"line{q.CLOSE} {q.OPEN}", f"manager{q.CLOSE}"
    out = f"regexp_replace({out}, '({line})({manager})', '\\1{q.CUT}\\2', 'gi')"
    out = f"regexp_replace({out}, '{q.OPEN}{manager}', '{q.marked('line manager')}', 'gi')"
    return q.unmark(f"replace({out}, '{q.CUT}', '')")


@query("tx15_regional_wording", q.with_(REGIONAL) + f"SELECT key, {uk_wording('text')} AS rewritten FROM regional")
def tx15(spark, d):
    return regional(spark, d).select("key", phrases.uk_terms(phrases.uk_spelling(T())).alias("rewritten"))


def canonical(x: str) -> str:
    spaced = q.collapse(q.strip(f"coalesce({x}, {q.lit('')})"))
    return f"trim(lower({uk_wording(spaced)}), {q.lit(lx.PHRASE_EDGE_CHARS)})"


@query(
    "tx16_canonical_phrase",
    q.with_(q.survey(), q.all_texts(), REGIONAL,
            "mixed AS (SELECT key, text FROM texts UNION ALL SELECT 'r' || key, text FROM regional)")
    + f"SELECT key, {canonical('text')} AS canonical FROM mixed",
)
def tx16(spark, d):
    mixed = fx.all_texts(spark, d).unionByName(
        regional(spark, d).withColumn("key", F.concat(F.lit("r"), F.col("key").cast("string")))
    )
    return mixed.select("key", phrases.canonical_phrase(T()).alias("canonical"))


_REPLIES = [
    '["{a}", "{b}"]', '{"data": ["{a}", "{b}"]}', '{"phrases": ["{a}"], "data": 3}', '{"items": ["{b}", 7]}',
    '{"list": ["{a}"], "other": ["{b}"]}', 'Here you are: ["{a}", "{b}"] - done', "no list here {a}", '{"note": "{b}"}',
]


def replies(spark, d) -> DataFrame:
    template = F.get(F.array(*[F.lit(r) for r in _REPLIES]), (F.col("ID") % len(_REPLIES)).cast("int"))
    a, b = (F.coalesce(F.col(c), F.lit("none")) for c in fx.TEXT_COLUMNS[:2])
    content = F.replace(F.replace(template, F.lit("{a}"), a), F.lit("{b}"), b)
    return fx.survey(spark, d).select("ID", content.alias("content"))


@query(
    "tx17_parse_phrases",
    q.with_(
        q.survey(),
        f"replies AS (SELECT \"ID\", replace(replace({q.list_lit(_REPLIES)}[(\"ID\" % {len(_REPLIES)}) + 1], '{{a}}', "
        "coalesce(\"Free_Text_1\", 'none')), '{b}', coalesce(\"Free_Text_2\", 'none')) AS content FROM survey)",
        "doc AS (SELECT *, CASE WHEN json_valid(content) THEN content::JSON END AS j, "
        "regexp_extract(content, '\\[[\\s\\S]*\\]') AS span FROM replies)",
        "picked AS (SELECT \"ID\", CASE WHEN j IS NOT NULL AND json_type(j) = 'ARRAY' THEN j "
        + " ".join(
            f"WHEN j IS NOT NULL AND json_type(j, '$.{k}') = 'ARRAY' THEN json_extract(j, '$.{k}')"
            for k in lx.PHRASE_LIST_KEYS
        )
        + " WHEN span <> '' AND json_valid(span) THEN span::JSON END AS arr FROM doc)",
        'lists AS (SELECT "ID", from_json(arr, \'["VARCHAR"]\') AS l FROM picked WHERE arr IS NOT NULL)',
    )
    + 'SELECT "ID", (i - 1)::INTEGER AS pos, l[i] AS phrase FROM lists, unnest(range(1, len(l) + 1)) AS u(i)',
)
def tx17(spark, d):
    found = phrases.parse_phrases(F.col("content"))
    return replies(spark, d).select("ID", F.posexplode(found).alias("pos", "phrase"))


# --------------------------------------------------------------------------------------------------------------
# Predicates
# --------------------------------------------------------------------------------------------------------------


@query("pr1_dismissive_answer", TEXTS + f"SELECT key, {q.is_null_text('text')} AS is_null_text FROM texts")
def pr1(spark, d):
    return _over_texts(spark, d, is_null_text=quality.is_null_text(T()))


@query("pr2_response_detail", TEXTS + f"SELECT key, {q.response_detail('text')} AS response_detail FROM texts")
def pr2(spark, d):
    return _over_texts(spark, d, response_detail=quality.response_detail(T()))


@query(
    "pr3_quality_flags",
    q.with_(q.survey())
    + 'SELECT "ID", '
    + ", ".join(
        f'NOT ({q.is_null_text(chr(34) + c + chr(34))}) AS "{c}_is_meaningful", '
        f'{q.response_detail(chr(34) + c + chr(34))} AS "{c}_response_detail"'
        for c in fx.TEXT_COLUMNS
    )
    + " FROM survey",
)
def pr3(spark, d):
    df = quality_ops.add_quality_flags(fx.survey(spark, d), fx.TEXT_COLUMNS)
    return df.select("ID", *[f"{c}{s}" for c in fx.TEXT_COLUMNS for s in ("_is_meaningful", "_response_detail")])


@query(
    "pr4_short_dismissal",
    TEXTS
    + f"SELECT key, length({q.strip('lower(coalesce(text, chr(32)))')}) <= 2 OR "
    f"{q.strip('lower(text)')} IN {q.in_list(lx.DISMISSIVE_SHORT)} AS dismissive FROM texts",
)
def pr4(spark, d):
    return _over_texts(spark, d, dismissive=quality.is_dismissive_short(T()))


@query(
    "pr5_contrast_split",
    TEXTS
    + f"SELECT key, coalesce({q.matches_any('text', lx.CONTRAST_MARKERS)}, FALSE) AS has_contrast, "
    f"coalesce(array_to_string({q.clauses('text')}, '{SEP}'), '') AS clauses FROM texts",
)
def pr5(spark, d):
    return _over_texts(
        spark, d, has_contrast=sentiment.has_contrast(T()), clauses=_joined(sentiment.split_on_contrast(T()))
    )


@query("pr6_coping_mention", TEXTS + f"SELECT key, {q.detect_coping('text')} AS coping FROM texts")
def pr6(spark, d):
    return _over_texts(spark, d, coping=sentiment.detect_coping(T()))


@query(
    "pr7_sentiment_label",
    f"SELECT event_id, {q.sentiment_label('(CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 20.0 - 1.0 END)')} AS label "
    "FROM events",
)
def pr7(spark, d):
    score = F.when(F.col("event_id") % 7 != 0, F.col("value") / 20.0 - 1.0)
    return fx.table(spark, d, "events").select("event_id", sentiment.sentiment_label(score).alias("label"))


_MOODS = ["Positive", "Negative", "Neutral", "No sentiment"]
_POLARITIES = ["Either", "Positive", "Negative", "Neutral"]


@query(
    "pr8_polarity_alignment",
    f"SELECT event_id, mood, polarity, polarity = 'Either' OR (polarity IN ('Positive', 'Negative') AND mood = polarity) "
    f"AS aligned FROM (SELECT event_id, {q.list_lit(_MOODS)}[(event_id % 4) + 1] AS mood, "
    f"{q.list_lit(_POLARITIES)}[(user_id % 4) + 1] AS polarity FROM events)",
)
def pr8(spark, d):
    def pick(values, key):
        return F.get(F.array(*[F.lit(v) for v in values]), (F.col(key) % 4).cast("int"))

    events = fx.table(spark, d, "events").select(
        "event_id", pick(_MOODS, "event_id").alias("mood"), pick(_POLARITIES, "user_id").alias("polarity")
    )
    return events.withColumn("aligned", sentiment.sentiment_aligns(F.col("mood"), F.col("polarity")))


@query(
    "pr9_insight_sentence",
    "SELECT p_partkey, " + q.insight("net", "dominant", "p_name") + " AS insight FROM (SELECT p_partkey, p_name, "
    "(p_partkey % 41 - 20) / 20.0::DOUBLE AS net, (p_size % 11) / 10.0::DOUBLE AS dominant FROM part)",
)
def pr9(spark, d):
    from verbatim.operators.segments import insight

    net, dominant = (F.col("p_partkey") % 41 - 20) / 20.0, (F.col("p_size") % 11) / 10.0
    return fx.table(spark, d, "part").select("p_partkey", insight(net, dominant, F.col("p_name")).alias("insight"))


@query(
    "pr12_dismissed_details",
    q.with_(q.survey(), q.survey_long())
    + f'SELECT "ID", "TextColumn", text, {q.response_detail("text")} AS response_detail, FALSE AS is_meaningful '
    f"FROM long WHERE {q.is_null_text('text')}",
)
def pr12(spark, d):
    flagged = quality_ops.add_quality_flags(fx.survey(spark, d), fx.TEXT_COLUMNS)
    return quality_ops.null_text_details(flagged, fx.TEXT_COLUMNS)


GENERIC = (
    f"len({q.tokens('phrase')}) < 2 OR phrase IN {q.in_list(lx.HARD_BAN)} OR "
    f"regexp_full_match(phrase, '({'|'.join(lx.GENERIC_LEADS)})[{q.WS}]+[{q.WORD}]+')"
)

_LEADS = ["need {b}", "more {b} please", "{a}", "better communication", "struggling", "improve {a} {b}", "lack  {b}"]


def candidate_phrases(spark, d) -> DataFrame:
    part = fx.table(spark, d, "part")
    template = F.get(F.array(*[F.lit(t) for t in _LEADS]), (F.col("p_partkey") % len(_LEADS)).cast("int"))
    phrase = F.replace(F.replace(template, F.lit("{a}"), F.col("p_name")), F.lit("{b}"), F.lower("p_type"))
    return part.select("p_partkey", phrase.alias("phrase"))


@query(
    "pr13_generic_phrase",
    f"SELECT p_partkey, phrase, {GENERIC} AS generic FROM (SELECT p_partkey, replace(replace({q.list_lit(_LEADS)}"
    f"[(p_partkey % {len(_LEADS)}) + 1], '{{a}}', p_name), '{{b}}', lower(p_type)) AS phrase FROM part)",
)
def pr13(spark, d):
    return candidate_phrases(spark, d).withColumn("generic", phrases.is_generic_phrase(F.col("phrase")))


_CLASSES = ["NEGATIVE", "very positive", "Neu", "LABEL_0", "LABEL_1", "LABEL_2", None]


@query(
    "pr14_class_label",
    "SELECT event_id, CASE WHEN contains(name, 'neg') THEN 'Negative' WHEN contains(name, 'pos') THEN 'Positive' "
    "WHEN contains(name, 'neu') THEN 'Neutral' WHEN idx = 0 THEN 'Negative' WHEN idx = 2 THEN 'Positive' "
    f"ELSE 'Neutral' END AS label FROM (SELECT event_id, coalesce(lower({q.list_lit(_CLASSES)}"
    f"[(event_id % {len(_CLASSES)}) + 1]), '') AS name, user_id % 3 AS idx FROM events)",
)
def pr14(spark, d):
    name = F.get(F.array(*[F.lit(c).cast("string") for c in _CLASSES]), (F.col("event_id") % len(_CLASSES)).cast("int"))
    return fx.table(spark, d, "events").select(
        "event_id", sentiment.normalise_class_label(name, F.col("user_id") % 3).alias("label")
    )


@query(
    "rs1_response_long",
    q.with_(q.survey(), q.survey_long())
    + f'SELECT "ID", "TextColumn", text, NOT ({q.is_null_text("text")}) AS is_meaningful, '
    f"{q.response_detail('text')} AS response_detail FROM long",
)
def rs1(spark, d):
    flagged = quality_ops.add_quality_flags(fx.survey(spark, d), fx.TEXT_COLUMNS)
    return response_long(flagged, fx.TEXT_COLUMNS).drop("sentiment_label", "compound")
