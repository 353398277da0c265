"""SQL fragments for the twins.

The twins are written for a regex engine without look-around and with ASCII word boundaries. They mark every word run with
two control characters instead, so a whole-word test becomes a plain substring test on the marked text. That is a
different technique from the library's on purpose.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from suite import fixture as fx
from verbatim import lexicons as lx
from verbatim.functions.patterns import STRIP_CHARS, WORD, WS
from verbatim.operators.keyword import KeywordIndex
from verbatim.settings import KeywordSettings

OPEN, CLOSE, CUT = "\x02", "\x03", "\x04"


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def in_list(values: Iterable[str]) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def rounded(value: str, digits: int) -> str:
    """Rounded by print: the exact binary value decides, a true tie goes to the even digit."""
    return f"CAST(printf('%.{digits}f', ({value})::DOUBLE) AS DOUBLE)"


def list_lit(values: Iterable[str]) -> str:
    return "CAST([" + ", ".join(lit(v) for v in values) + "] AS VARCHAR[])"


def values_table(name: str, columns: str, rows: Iterable[Iterable]) -> str:
    body = ", ".join("(" + ", ".join(v if isinstance(v, Raw) else lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


class Raw(str):
    """A fragment to insert as it is."""


def with_(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c for c in ctes if c) + "\n"


# --------------------------------------------------------------------------------------------------------------
# Inputs
# --------------------------------------------------------------------------------------------------------------

_BANK = list_lit(fx.BANK)


def survey(name: str = "survey") -> str:
    answers = ", ".join(
        f'{_BANK}[((o_orderkey * {2 * k + 1} + o_custkey * {k}) % {len(fx.BANK)}) + 1] AS "{c}"'
        for k, c in enumerate(fx.TEXT_COLUMNS, start=1)
    )
    return (
        f"{name} AS (SELECT o_orderkey AS \"ID\", {answers}, strftime(o_orderdate, '%Y-%m') AS survey_period, "
        "o_custkey % 10 + 1 AS score, o_custkey AS customer FROM orders)"
    )


def survey_long(name: str = "long", source: str = "survey") -> str:
    parts = [
        f'SELECT "ID", \'{c}\' AS "TextColumn", "{c}" AS text FROM {source}' for c in fx.TEXT_COLUMNS
    ]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


def all_texts(name: str = "texts") -> str:
    return (
        f"{name} AS (SELECT 'd' || doc_id AS key, text FROM documents "
        "UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations "
        + " ".join(f"UNION ALL SELECT 's' || \"ID\" || '-{k}', \"{c}\" FROM survey" for k, c in enumerate(fx.TEXT_COLUMNS, start=1))
        + ")"
    )


# --------------------------------------------------------------------------------------------------------------
# Text
# --------------------------------------------------------------------------------------------------------------


def strip(x: str) -> str:
    return f"trim({x}, {lit(STRIP_CHARS)})"


def collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '[{WS}]+'), lambda t: t <> '')"


def mark(x: str) -> str:
    return f"regexp_replace({x}, '([{WORD}]+)', '{OPEN}\\1{CLOSE}', 'g')"


def unmark(x: str) -> str:
    return f"replace(replace({x}, '{OPEN}', ''), '{CLOSE}', '')"


def marked(term: str) -> str:
    """A term as it looks in marked text."""
    return re.sub(r"(\w+)", f"{OPEN}\\1{CLOSE}", term)


def marked_pattern(term: str) -> str:
    """A pattern for a term in marked text; a trailing ``*`` allows further word characters."""
    if term.endswith("*"):
        return marked(term[:-1])[:-1] + f"[{WORD}]*{CLOSE}"
    return marked(term)


def matches_any(x: str, terms: Iterable[str]) -> str:
    pattern = "|".join(marked_pattern(t) for t in terms).replace("'", "''")
    return f"regexp_matches({mark(x)}, '{pattern}', 'i')"


def normalise(x: str) -> str:
    t = f"lower({strip(x)})"
    words = f"trim(regexp_replace(translate({t}, '‘’“”', '''''\"\"'), '[^{WORD}''-]+', ' ', 'g'))"
    return (
        f"CASE WHEN {x} IS NULL OR {t} IN {in_list(['', 'nan', *lx.NULL_SPELLINGS])} THEN 'no entry' "
        f"ELSE coalesce(nullif({words}, ''), 'no entry') END"
    )


def replace_terms(x: str, mapping: Mapping[str, str]) -> str:
    out = mark(x)
    for k, v in sorted(mapping.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        out = f"replace({out}, {lit(marked(k))}, {lit(marked(v))})"
    return unmark(out)


def map_tokens(x: str, mapping: Mapping[str, str]) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items())
    return f"array_to_string(list_transform({tokens(x)}, lambda t: CASE t {cases} ELSE t END), ' ')"


def join_phrases(x: str, phrases: Iterable[str]) -> str:
    out = x
    for p in phrases:
        if "_" in p:
            out = f"replace({out}, {lit(p.replace('_', ' '))}, {lit(p)})"
    return out


def keep_tokens(x: str, white: Iterable[str], drop: Iterable[str], must: Iterable[str]) -> str:
    return (
        f"array_to_string(list_filter({tokens(x)}, lambda t: contains(t, '_') OR (t NOT IN {in_list(sorted(drop))} "
        f"AND (t IN {in_list(sorted(white))} OR (t NOT IN {in_list(sorted(must))} "
        "AND regexp_full_match(t, '\\p{L}{3,}'))))), ' ')"
    )


def unless_no_entry(x: str, changed: str) -> str:
    return f"CASE WHEN {x} = 'no entry' THEN {x} ELSE {changed} END"


def preprocessed(name: str, source: str, keep: str, text: str = "text") -> str:
    """CTEs that add ``processed`` to ``source``; ``keep`` lists the columns to carry."""
    d = fx.dictionary()
    return ",\n".join(
        [
            f"{name}_1 AS (SELECT {keep}, {text} AS raw, {normalise(text)} AS x FROM {source})",
            f"{name}_2 AS (SELECT {keep}, raw, {unless_no_entry('x', replace_terms('x', d.business_map))} AS x "
            f"FROM {name}_1)",
            f"{name}_3 AS (SELECT {keep}, raw, {unless_no_entry('x', map_tokens('x', d.merge_map))} AS x FROM {name}_2)",
            f"{name}_4 AS (SELECT {keep}, raw, {unless_no_entry('x', join_phrases('x', d.force_phrases))} AS x "
            f"FROM {name}_3)",
            f"{name} AS (SELECT {keep}, raw, "
            + unless_no_entry("x", keep_tokens("x", d.unigram_whitelist, d.always_drop, d.must_be_phrase))
            + f" AS processed FROM {name}_4)",
        ]
    )


def frequency_normalise(x: str) -> str:
    t = f"lower({strip(f'coalesce({x}, {lit(str())})')})"
    return (
        f"CASE WHEN {t} = 'nan' THEN '' ELSE "
        f"trim(regexp_replace(translate({t}, '‘’', ''''''), '[^a-z0-9_'']+', ' ', 'g')) END"
    )


def split_multi(x: str, delimiter: str = " | ") -> str:
    return (
        f"list_filter(list_transform(string_split(coalesce({x}, ''), {lit(delimiter)}), lambda t: {strip('t')}), "
        "lambda t: t <> '')"
    )


# --------------------------------------------------------------------------------------------------------------
# Quality, clauses, sentiment
# --------------------------------------------------------------------------------------------------------------


def is_null_text(x: str, lo: int = 3, hi: int = 50) -> str:
    t = strip(x)
    bare = strip(f"regexp_replace(lower({t}), '[^a-z0-9{WS}/]', '', 'g')")
    pattern = "|".join(p.format(ws=f"[{WS}]", any="[^\\n]") for p in lx.NULL_PATTERNS).replace("'", "''")
    return (
        f"CASE WHEN {x} IS NULL THEN TRUE WHEN length({t}) < {lo} THEN TRUE WHEN length({t}) > {hi} THEN FALSE "
        f"WHEN lower({t}) IN {in_list(lx.NULL_LITERALS)} THEN TRUE "
        f"ELSE {bare} IN {in_list(lx.NULL_EXACT)} OR regexp_full_match({bare}, '{pattern}') END"
    )


def response_detail(x: str, lo: int = 3, hi: int = 50) -> str:
    bare = f"regexp_replace(lower({strip(x)}), '[^a-z0-9{WS}]', '', 'g')"
    return (
        f"CASE WHEN NOT ({is_null_text(x, lo, hi)}) THEN 'Detailed response' "
        f"WHEN {bare} IN {in_list(lx.YES_RESPONSES)} THEN 'Yes' WHEN {bare} IN {in_list(lx.NO_RESPONSES)} THEN 'No' "
        f"WHEN {bare} IN {in_list(lx.NO_SENTIMENT_RESPONSES)} THEN 'No sentiment' ELSE 'No' END"
    )


def clauses(x: str) -> str:
    pattern = "|".join(marked_pattern(t) for t in lx.CONTRAST_MARKERS)
    cut = unmark(f"regexp_replace({mark(x)}, '{pattern}', '{CUT}', 'gi')")
    parts = f"list_filter(list_transform(string_split({cut}, '{CUT}'), lambda t: {strip('t')}), lambda t: t <> '')"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE [{x}] END"


def detect_coping(x: str) -> str:
    return (
        f"coalesce({matches_any(x, lx.COPING_TERMS)} AND NOT {matches_any(x, lx.NEGATION_TERMS)}, FALSE)"
    )


def _lexicon_count(x: str, terms: Iterable[str]) -> str:
    return (
        f"len(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^{WORD}]+'), "
        f"lambda t: t IN {in_list(terms)}))::DOUBLE"
    )


def lexicon_counts(x: str) -> tuple[str, str]:
    return _lexicon_count(x, lx.POSITIVE_WORDS), _lexicon_count(x, lx.NEGATIVE_WORDS)


def lexicon_score(x: str) -> str:
    p, n = lexicon_counts(x)
    return f"(({p} - {n}) / ({p} + {n} + 1.0::DOUBLE))"


def sentiment_label(x: str, pos: float = 0.05, neg: float = -0.05) -> str:
    return f"CASE WHEN {x} >= {pos} THEN 'Positive' WHEN {x} <= {neg} THEN 'Negative' ELSE 'Neutral' END"


def insight(net: str, dominant: str, base: str, majority: float = 0.5) -> str:
    return (
        f"'Users are ' || CASE WHEN {dominant} < {majority} THEN 'mixed/neutral on' "
        f"WHEN {net} BETWEEN -0.1 AND 0.1 THEN 'mixed/neutral on' "
        f"WHEN {net} > 0.1 AND {net} < 0.2 THEN 'slightly happy with' "
        f"WHEN {net} > 0.1 AND {net} < 0.5 THEN 'happy with' WHEN {net} > 0.1 THEN 'very happy with' "
        f"WHEN {net} > -0.2 THEN 'slightly unhappy with' WHEN {net} > -0.5 THEN 'unhappy with' "
        f"ELSE 'very unhappy with' END || ' ' || {base}"
    )


# --------------------------------------------------------------------------------------------------------------
# Long answers with flags, keyword matching
# --------------------------------------------------------------------------------------------------------------


def answers(processed: bool = True) -> str:
    """CTEs up to ``answers``: ID, TextColumn, raw, text, is_meaningful, response_detail of the survey."""
    ctes = [survey(), survey_long()]
    # Texts repeat, so the rules run once per distinct text.
    ctes.append("distinct_texts AS (SELECT DISTINCT text FROM long)")
    ctes.append(preprocessed("pre", "distinct_texts", "text"))
    ctes.append(
        f"flagged AS (SELECT raw, processed, NOT ({is_null_text('raw')}) AS is_meaningful, "
        f"{response_detail('raw')} AS response_detail FROM pre)"
    )
    chosen = "coalesce(f.processed, l.text, '')" if processed else "coalesce(l.text, '')"
    ctes.append(
        'answers AS (SELECT l."ID", l."TextColumn", l.text AS raw, '
        f"{chosen} AS text, f.is_meaningful, f.response_detail "
        "FROM long l JOIN flagged f ON l.text IS NOT DISTINCT FROM f.raw)"
    )
    return ",\n".join(ctes)


def library_ctes(index: KeywordIndex) -> str:
    terms = [
        (hit["pos"], hit["kind"], hit["kw"], marked(key), hit["evidence"]) for key, hit in index.entries()
    ]
    meta = [
        (pos, s.theme, s.subtheme, s.parent_theme, s.polarity, Raw(list_lit(s.cols)))
        for pos, s in enumerate(index.subthemes)
    ]
    return ",\n".join(
        [
            values_table("terms", "pos, kind, kw, marked, evidence", terms),
            values_table("meta", "pos, theme, subtheme, parent_theme, polarity, cols", meta),
        ]
    )


def fuzzy_rows(index: KeywordIndex, s: KeywordSettings) -> str:
    """CTEs up to ``fuzzy_ranked``: the fuzzy match of each keyword list, with the rank at which it counts."""
    from suite import fuzzysql

    phrases = [(2 * pos + 1, t.phrase_terms if s.phrase_first else t.phrase_terms + t.token_terms) for pos, t in enumerate(index.subthemes)]
    tokens_ = [(2 * pos, t.token_terms) for pos, t in enumerate(index.subthemes) if s.allow_token_fallback and s.phrase_first]
    rank = "CASE WHEN slot % 2 = 0 THEN 1 ELSE 3 END" if s.phrase_first else "1"
    return ",\n".join(
        [
            fuzzysql.lists("texts_in", [p for p in tokens_ + phrases if p[1]], s.fuzzy_threshold),
            f"fuzzy_ranked AS (SELECT i.\"TextColumn\", i.text, (slot // 2)::INTEGER AS pos, {rank} AS rank, 0 AS ord, score AS base, "
            "CASE WHEN slot % 2 = 0 THEN 'fuzzy_token' ELSE 'fuzzy' END AS method, evidence "
            "FROM marked_in i JOIN fuzzy f ON f.text = i.text WHERE slot % 2 = 1 OR i.short)",
        ]
    )


def matches(source: str, index: KeywordIndex, s: KeywordSettings, text: str = "text") -> str:
    """CTEs up to ``best``: the accepted matches per distinct (TextColumn, text) with their rank ``rn``."""
    short = f"length({strip('text')}) <= {s.max_token_match_length}" if s.allow_token_fallback else "FALSE"
    if s.phrase_first:
        candidate = "CASE WHEN kind = 0 AND short THEN 0 WHEN kind = 1 THEN 2 END"
        ordering, is_token = "kw", "rank = 0"
    else:
        candidate = "0"
        ordering, is_token = "kw + CASE WHEN kind = 0 THEN 500000 ELSE 0 END", "FALSE"
    mismatch = 999.0 if s.strict_columns else s.column_penalty
    exact = (
        'SELECT "TextColumn", text, pos, rank, ord, '
        f"CASE WHEN {is_token} THEN 0.95 ELSE 1.0 END::DOUBLE AS base, "
        f"CASE WHEN {is_token} THEN 'token_short_text' ELSE 'exact' END AS method, evidence FROM ranked WHERE rank IS NOT NULL"
    )
    rows = f"({exact} UNION ALL SELECT * FROM fuzzy_ranked)" if s.use_fuzzy else f"({exact})"
    return ",\n".join(
        [
            library_ctes(index),
            f'texts_in AS (SELECT DISTINCT "TextColumn", {text} AS text FROM {source} WHERE active)',
            f"marked_in AS (SELECT *, {mark('lower(text)')} AS m, {short} AS short FROM texts_in)",
            'hits AS (SELECT i."TextColumn", i.text, i.short, t.pos, t.kind, t.kw, t.evidence '
            "FROM marked_in i, terms t WHERE contains(i.m, t.marked))",
            f"ranked AS (SELECT *, {candidate} AS rank, {ordering} AS ord FROM hits)",
            fuzzy_rows(index, s) if s.use_fuzzy else "no_fuzzy AS (SELECT 1)",
            f'firsts AS (SELECT * FROM {rows} QUALIFY row_number() OVER (PARTITION BY "TextColumn", text, pos ORDER BY rank, ord) = 1)',
            "scored AS (SELECT f.\"TextColumn\", f.text, f.pos, f.evidence, m.theme, m.subtheme, m.parent_theme, m.polarity, f.method, f.base "
            f"+ CASE WHEN len(m.cols) > 0 AND list_contains(m.cols, f.\"TextColumn\") THEN {s.column_bonus} ELSE 0.0 "
            "END::DOUBLE "
            f"- CASE WHEN len(m.cols) > 0 AND NOT list_contains(m.cols, f.\"TextColumn\") THEN {mismatch} ELSE 0.0 "
            "END::DOUBLE AS score0 FROM firsts f JOIN meta m USING (pos))",
            f"accepted AS (SELECT *, score0 + CASE WHEN method = 'exact' AND {lit(s.prefer_exact)} THEN 0.02 ELSE 0.0 "
            "END::DOUBLE AS score FROM scored)",
            'best AS (SELECT *, row_number() OVER (PARTITION BY "TextColumn", text ORDER BY score DESC, pos) AS rn '
            f"FROM accepted WHERE score >= {s.min_accept_score} QUALIFY rn <= {s.top_k})",
            "collapsed AS (SELECT \"TextColumn\", text, string_agg(theme, ' | ' ORDER BY rn) AS theme, "
            "string_agg(subtheme, ' | ' ORDER BY rn) AS subtheme, "
            "string_agg(parent_theme, ' | ' ORDER BY rn) AS parent_theme, avg(score) AS rule_score, "
            "string_agg(CASE WHEN polarity <> '' THEN polarity END, ' | ' ORDER BY rn) AS expected_polarity, "
            "string_agg(method, ' | ' ORDER BY rn) AS match_method, "
            "string_agg(CASE WHEN evidence <> '' THEN evidence END, ' | ' ORDER BY rn) AS evidence "
            'FROM best GROUP BY "TextColumn", text)',
        ]
    )


def assignment_select(keys: str, source: str, dismissed: str, detail: str, reason: str, no_match: str = "'no_match'") -> str:
    """The assignment row of ``source`` joined with ``collapsed``."""

    def pick(name: str, brief: str, none: str) -> str:
        return f"CASE WHEN c.text IS NOT NULL THEN c.{name} WHEN {dismissed} THEN {brief} ELSE {none} END AS {name}"

    fields = ", ".join(
        [
            pick("theme", "'Brief response'", "''"), pick("subtheme", detail, "''"),
            pick("parent_theme", "'Brief response'", "''"),
            f"round(CASE WHEN c.text IS NOT NULL THEN c.rule_score ELSE 0.0 END, 6)::DOUBLE AS rule_score",
            pick("expected_polarity", "''", "''"), pick("match_method", "'dismissed'", "'none'"),
            pick("evidence", "''", "''"),
            f"CASE WHEN c.text IS NOT NULL THEN 'matched' WHEN {dismissed} THEN {reason} ELSE {no_match} END AS reason",
        ]
    )
    return (
        f"SELECT {keys}, {fields} FROM {source} s LEFT JOIN collapsed c "
        'ON s.active AND s."TextColumn" = c."TextColumn" AND s.text = c.text'
    )


def keyword_assignments(s: KeywordSettings, index: KeywordIndex | None = None) -> str:
    """CTEs up to ``assignments``: the survey's keyword assignment table."""
    body = assignment_select(
        's."ID", s."TextColumn", s.is_meaningful', "flagged_answers",
        "(s.is_meaningful = FALSE AND s.response_detail <> '')", "s.response_detail",
        "'dismissed:' || s.response_detail",
    )
    return ",\n".join(
        [
            answers(),
            "flagged_answers AS (SELECT *, is_meaningful AS active FROM answers)",
            matches("flagged_answers", index or fx.keyword_index(), s),
            f"assignments AS ({body})",
        ]
    )


# --------------------------------------------------------------------------------------------------------------
# Vectors
# --------------------------------------------------------------------------------------------------------------


def hashed_vector(x: str, dim: int) -> str:
    buckets = (
        f"list_transform(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^{WORD}]+'), lambda t: t <> ''), "
        f"lambda t: ('0x' || substr(md5(t), 1, 4))::INTEGER % {dim})"
    )
    return f"list_transform(range({dim}), lambda i: len(list_filter({buckets}, lambda b: b = i))::DOUBLE)"


def unit(v: str) -> str:
    norm = f"sqrt(list_sum(list_transform({v}, lambda q: q * q)))"
    return f"list_transform({v}, lambda e: CASE WHEN {norm} > 0 THEN e / {norm} ELSE 0.0 END)"
