"""Taxonomy building and validation, and phrase curation (AG17-AG21, IO6, IO7, IO11, RS4, RS5, JN14-JN17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import fixture as fx
from suite import q_text as qt
from suite import sqltext as q
from suite.q_quality import LIBRARY
from suite.registry import query, scratch_folder
from verbatim import lexicons as lx
from verbatim.functions import phrases
from verbatim.functions.expr import compute_once
from verbatim.functions.patterns import WORD
from verbatim.operators import curation, taxonomy
from verbatim.operators.keyword import KeywordIndex
from verbatim.operators.reshape import union_all
from verbatim.plans.taxonomy import TaxonomyBuild
from verbatim.sources import taxonomy as taxonomy_io
from verbatim.sources.survey import spread

KEYS = '"column", parent, theme, subtheme'


def part_library(spark, d) -> DataFrame:
    """The parts as a flat phrase library; ``p_partkey`` is the row order."""
    key = F.col("p_partkey")
    polarity = F.get(
        F.array(*[F.lit(p) for p in ("Positive", "Negative", "Neutral", "Either")]), (key % 4).cast("int")
    )
    return fx.table(spark, d, "part").select(
        F.concat(F.lit("Free_Text_"), (key % 3 + 1).cast("string")).alias("column"),
        F.col("p_type").alias("parent"),
        F.col("p_brand").alias("theme"),
        F.concat(F.lit("Size "), (F.col("p_size") % 5).cast("string")).alias("subtheme"),
        polarity.alias("polarity"),
        F.col("p_name").alias("phrase"),
        "p_partkey",
    )


def flawed_library(spark, d) -> DataFrame:
    """The same library with blanks, odd polarities and repeated rows."""
    key = F.col("p_partkey")
    lib = part_library(spark, d).withColumns(
        {
            "parent": F.when(key % 17 != 0, F.col("parent")),
            "phrase": F.when(key % 13 == 0, "  ").otherwise(F.col("phrase")),
            "polarity": F.when(key % 11 == 0, "good").when(key % 19 == 0, None).otherwise(F.lower("polarity")),
        }
    ).drop("p_partkey")
    return lib.unionByName(lib.filter(F.col("theme") == "Brand#1"))


FLAWED = (
    LIBRARY,
    "fl0 AS (SELECT \"column\", CASE WHEN p_partkey % 17 <> 0 THEN parent END AS parent, theme, subtheme, "
    "CASE WHEN p_partkey % 11 = 0 THEN 'good' WHEN p_partkey % 19 = 0 THEN NULL ELSE lower(polarity) END AS polarity, "
    "CASE WHEN p_partkey % 13 = 0 THEN '  ' ELSE phrase END AS phrase FROM library)",
    "flawed AS (SELECT * FROM fl0 UNION ALL SELECT * FROM fl0 WHERE theme = 'Brand#1')",
)


def _blank(c: str) -> str:
    return f"count(*) FILTER (\"{c}\" IS NULL OR trim(\"{c}\") = '')"


@query(
    "ag17_validate_library",
    q.with_(
        *FLAWED,
        f"low AS (SELECT {KEYS} FROM flawed WHERE \"column\" IS NOT NULL AND parent IS NOT NULL AND theme IS NOT NULL AND "
        f"subtheme IS NOT NULL GROUP BY ALL HAVING count(*) < 3)",
        "issues AS ("
        + " UNION ALL ".join(
            f"SELECT 'error' AS severity, 'empty_values' AS \"check\", '{c}' AS detail, {_blank(c)} AS count FROM flawed"
            for c in lx.LIBRARY_COLUMNS
        )
        + " UNION ALL SELECT 'warning', 'polarity_outside_allowed', 'polarity', count(*) FILTER "
        f"(lower(trim(coalesce(polarity, 'nan'))) NOT IN {q.in_list(lx.ALLOWED_POLARITY)}) FROM flawed"
        + f" UNION ALL SELECT 'warning', 'duplicate_rows', '{', '.join(lx.LIBRARY_COLUMNS)}', "
        "(SELECT count(*) FROM flawed) - (SELECT count(*) FROM (SELECT DISTINCT * FROM flawed))"
        + " UNION ALL SELECT 'warning', 'few_phrases', 'fewer than 3', count(*) FROM low)",
    )
    + "SELECT * FROM issues WHERE count > 0",
)
def ag17(spark, d):
    return taxonomy.validate_library(flawed_library(spark, d), min_phrases=3)


_SUBTHEMES = (
    f"subs AS (SELECT {KEYS}, list_sort(list_distinct(list(phrase))) AS phrases, "
    f"coalesce(min_by(coalesce(polarity, 'Either'), p_partkey), 'Either') AS polarity FROM library GROUP BY {KEYS})"
)
_SUBTHEME_SELECT = (
    f"SELECT {KEYS}, array_to_string(phrases, '¦') AS phrases, polarity AS default_polarity FROM subs"
)


def enriched(spark, d) -> DataFrame:
    return taxonomy.enriched_subthemes(part_library(spark, d), F.col("p_partkey"))


@query("ag18_enriched_subthemes", q.with_(LIBRARY, _SUBTHEMES) + _SUBTHEME_SELECT)
def ag18(spark, d):
    return enriched(spark, d).select(
        "column", "parent", "theme", "subtheme", F.array_join("keywords_phrases", "¦").alias("phrases"), "default_polarity"
    )


_NESTED_FLAT = (
    f"flat AS (SELECT {KEYS}, polarity, phrases[i] AS phrase, i FROM subs, unnest(range(1, len(phrases) + 1)) AS u(i))"
)


@query(
    "rs4_flatten_library",
    q.with_(LIBRARY, _SUBTHEMES, _NESTED_FLAT) + f"SELECT {KEYS}, polarity, phrase FROM flat",
)
def rs4(spark, d):
    nested = taxonomy.nest_library(enriched(spark, d))
    return taxonomy.flatten_nested(nested).select("column", "parent", "theme", "subtheme", "polarity", "phrase")


@query(
    "io6_read_enriched_library",
    q.with_(LIBRARY, _SUBTHEMES, _NESTED_FLAT)
    + 'SELECT (row_number() OVER (ORDER BY "column", parent, theme, subtheme, i) - 1)::INTEGER AS phrase_idx, '
    f"{KEYS}, polarity, phrase FROM flat",
)
def io6(spark, d):
    """The nested library written as one JSON document and read back, flat, in document order."""
    path = scratch_folder(spark) + "/enriched.json"
    taxonomy_io.write_enriched_library(taxonomy.nest_library(enriched(spark, d)), path)
    return taxonomy_io.read_enriched_library(spark, path)


@query(
    "ag18_nested_descriptions",
    q.with_(LIBRARY)
    + "SELECT \"column\", 'Themes for ' || \"column\" AS description, count(DISTINCT parent) AS n_parents, "
    "count(DISTINCT (parent, theme)) AS n_themes FROM library GROUP BY ALL",
)
def ag18_nested(spark, d):
    nested = taxonomy.nest_library(enriched(spark, d))
    n_themes = F.aggregate("parents", F.lit(0), lambda a, p: a + F.size(p["themes"]))
    return nested.select(
        "column", "description", F.size("parents").cast("long").alias("n_parents"), n_themes.cast("long").alias("n_themes")
    )


_THEMES = (
    "par AS (SELECT theme, parent FROM library WHERE parent IS NOT NULL GROUP BY theme, parent "
    "QUALIFY row_number() OVER (PARTITION BY theme ORDER BY count(*) DESC, parent) = 1)",
    "pol AS (SELECT theme, subtheme, polarity FROM library GROUP BY theme, subtheme, polarity "
    "QUALIFY row_number() OVER (PARTITION BY theme, subtheme ORDER BY count(*) DESC, polarity) = 1)",
    "body AS (SELECT theme, subtheme, array_to_string(list_sort(list_distinct(list(trim(phrase)))), '¦') AS phrases, "
    "array_to_string(list_sort(list_distinct(list(\"column\"))), '¦') AS columns FROM library GROUP BY ALL)",
    "themes AS (SELECT theme, subtheme, par.parent AS parent_theme, pol.polarity AS default_polarity, phrases, columns "
    "FROM body JOIN par USING (theme) JOIN pol USING (theme, subtheme))",
)


@query("ag19_keyword_themes", q.with_(LIBRARY, *_THEMES) + "SELECT * FROM themes")
def ag19(spark, d):
    return taxonomy.keyword_themes(part_library(spark, d)).select(
        "theme", "subtheme", "parent_theme", "default_polarity", F.array_join("keywords_phrases", "¦").alias("phrases"),
        F.array_join("likely_columns", "¦").alias("columns"),
    )


def _built(spark, d) -> str:
    """The folder that the build job wrote, library and themes by tasks."""
    folder = scratch_folder(spark)
    TaxonomyBuild().run(part_library(spark, d), folder, F.col("p_partkey"))
    return folder


@query("io11_built_library", q.with_(LIBRARY, _SUBTHEMES) + _SUBTHEME_SELECT)
def io11_library(spark, d):
    rows = taxonomy_io.read_library_rows(spark, _built(spark, d) + "/enriched")
    return rows.select(
        "column", "parent", "theme", "subtheme", F.array_join("keywords_phrases", "¦").alias("phrases"), "default_polarity"
    )


@query("io11_built_themes", q.with_(LIBRARY, *_THEMES) + "SELECT * FROM themes")
def io11_themes(spark, d):
    return taxonomy_io.read_theme_rows(spark, _built(spark, d) + "/themes").select(
        "theme", "subtheme", "parent_theme", "default_polarity", F.array_join("keywords_phrases", "¦").alias("phrases"),
        F.array_join("likely_columns", "¦").alias("columns"),
    )


@query(
    "io7_keyword_index",
    q.with_(LIBRARY, *_THEMES,
            "numbered AS (SELECT *, row_number() OVER (ORDER BY theme, subtheme) - 1 AS pos FROM themes)")
    + "SELECT pos::INTEGER AS subtheme_pos, theme, parent_theme, subtheme, default_polarity AS polarity, columns, "
    "'phrase' AS kind, (i - 1)::INTEGER AS kw_pos, string_split(phrases, '¦')[i] AS term FROM numbered, "
    "unnest(range(1, len(string_split(phrases, '¦')) + 1)) AS u(i)",
)
def io7(spark, d):
    """Keyword themes written as a themes file, read into an index, and the index as a table of keywords."""
    path = scratch_folder(spark) + "/themes.yaml"
    taxonomy_io.write_themes(taxonomy.keyword_themes(part_library(spark, d)), path)
    table = KeywordIndex.from_df(taxonomy_io.read_themes(path).to_df(spark)).to_df(spark)
    return taxonomy.keyword_terms(table).withColumn("columns", F.array_join("cols", "¦")).drop("cols")


@query(
    "io11_write_enriched_json",
    q.with_(
        LIBRARY, _SUBTHEMES,
        "t AS (SELECT \"column\", parent, theme, list({'name': subtheme, 'keywords_phrases': phrases, "
        "'default_polarity': polarity} ORDER BY subtheme) AS subthemes FROM subs GROUP BY ALL)",
        "p AS (SELECT \"column\", parent, list({'theme_name': theme, 'subthemes': subthemes} ORDER BY theme) AS themes "
        "FROM t GROUP BY ALL)",
        "c AS (SELECT \"column\", list({'parent_name': parent, 'themes': themes} ORDER BY parent) AS parents FROM p "
        "GROUP BY ALL)",
    )
    + "SELECT to_json({'column': \"column\", 'description': 'Themes for ' || \"column\", 'parents': parents})::VARCHAR AS value "
    "FROM c",
)
def io11(spark, d):
    """The nested library as JSON lines, one row per column."""
    nested = taxonomy.nest_library(enriched(spark, d))
    path = scratch_folder(spark) + "/enriched_lines"
    nested.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return spark.read.text(path)


# --------------------------------------------------------------------------------------------------------------
# Phrase curation
# --------------------------------------------------------------------------------------------------------------


def sentences(spark, d, name: str, key: str, group: str) -> DataFrame:
    """Every sentence of a table's texts with its position: (grp, ord, phrase)."""
    parts = F.split("text", r"[.!?\n]+")
    exploded = spread(fx.table(spark, d, name)).select(
        F.col(key).alias("k"), F.col(group).alias("grp") if group else F.lit("all").alias("grp"),
        F.posexplode(parts).alias("i", "s"),
    )
    cleaned = F.trim(F.regexp_replace(F.lower("s"), f"[^{WORD}]+", " "))
    numbered = exploded.select("grp", (F.col("k") * 1_000_000 + F.col("i")).alias("ord"), "s")
    return compute_once(numbered, "phrase", cleaned).select("grp", "ord", "phrase").filter(F.col("phrase") != "")


@query(
    "jn14_related_examples",
    "WITH ex AS (SELECT p_partkey, 'Free_Text_' || (p_partkey % 3 + 1) AS \"column\", [p_type, p_brand || ' ' || p_type] "
    "AS related, p_name AS example, p_size AS pos FROM part), "
    "w(\"column\", theme, subtheme) AS (VALUES ('Free_Text_1', 'economy', 'a'), ('Free_Text_2', 'The SMALL one', 'b'), "
    "('Free_Text_3', 'brand#1', 'c'), ('Free_Text_1', 'nothing', 'd')), "
    "hit AS (SELECT w.*, ex.pos AS category_pos, ex.p_partkey AS example_pos, example FROM w JOIN ex USING (\"column\") "
    "WHERE len(list_filter(related, lambda r: contains(lower(r), lower(theme)) OR contains(lower(theme), lower(r)))) > 0) "
    'SELECT *, row_number() OVER (PARTITION BY "column", theme, subtheme ORDER BY category_pos, example_pos)::INTEGER '
    "AS rank FROM hit QUALIFY rank <= 10",
)
def jn14(spark, d):
    examples = fx.table(spark, d, "part").select(
        F.col("p_size").alias("category_pos"),
        F.concat(F.lit("Free_Text_"), (F.col("p_partkey") % 3 + 1).cast("string")).alias("column"),
        F.col("p_partkey").alias("example_pos"),
        F.array("p_type", F.concat_ws(" ", "p_brand", "p_type")).alias("related_themes"),
        F.col("p_name").alias("example"),
    )
    wanted = [
        ("Free_Text_1", "economy", "a"), ("Free_Text_2", "The SMALL one", "b"), ("Free_Text_3", "brand#1", "c"),
        ("Free_Text_1", "nothing", "d"),
    ]
    return curation.related_examples(examples, wanted)



@query(
    "jn15_jaccard",
    "WITH w AS (SELECT conv_id, turn, list_distinct(" + q.tokens("lower(text)") + ") AS s FROM conversations) "
    "SELECT a.conv_id, a.turn, round(CASE WHEN len(a.s) > 0 AND len(b.s) > 0 THEN len(list_intersect(a.s, b.s)) / "
    "(len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) ELSE 0.0 END::DOUBLE, 6) AS similarity "
    "FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1",
)
def jn15(spark, d):
    """Word overlap of each turn with the next one."""
    turns = fx.table(spark, d, "conversations").select("conv_id", "turn", phrases.word_set(F.lower("text")).alias("s"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("t"))
    return turns.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(phrases.jaccard(F.col("s"), F.col("t")), 6).alias("similarity")
    )


def _greedy_sql(source: str, columns: str) -> str:
    """CTEs up to ``kept``(grp, ord, phrase) of ``source``(grp, ord, phrase): a set of words goes if an earlier kept one is similar.

    Candidates share one of their rarest words; a list that grows along the order holds the sets that are gone.
    """
    canonical, generic = qt.canonical("phrase"), qt.GENERIC
    return q.with_(
        source,
        f"cn AS (SELECT grp, ord, {canonical} AS phrase FROM src)",
        f"cl AS (SELECT * FROM cn WHERE phrase <> '' AND NOT coalesce({generic}, FALSE))",
        f"se AS (SELECT grp, list_sort(list_distinct({q.tokens('lower(phrase)')})) AS s, min(ord) AS id FROM cl GROUP BY ALL HAVING len(s) > 0)",
        "wo AS (SELECT grp, id, len(s) AS n, unnest(s) AS word FROM se)",
        "fr AS (SELECT grp, word, count(*) AS df FROM wo GROUP BY ALL)",
        "od AS (SELECT grp, id, n, list(word ORDER BY df, word) AS ws FROM wo JOIN fr USING (grp, word) GROUP BY grp, id, n)",
        "px AS (SELECT grp, id, n, unnest(ws[1:n - ceil(round(n * 0.65, 6))::INTEGER + 1]) AS word FROM od)",
        "ca AS (SELECT DISTINCT a.grp, a.id AS a, b.id AS b FROM px a JOIN px b ON a.grp = b.grp AND a.word = b.word AND a.id < b.id "
        "AND a.n >= b.n * 0.65 - 1e-9 AND b.n >= a.n * 0.65 - 1e-9)",
        "pr AS (SELECT ca.grp, a, b FROM ca JOIN od x ON x.grp = ca.grp AND x.id = a JOIN od y ON y.grp = ca.grp AND y.id = b "
        "WHERE len(list_intersect(x.ws, y.ws)) / (x.n + y.n - len(list_intersect(x.ws, y.ws))) >= 0.65)",
        "nd AS (SELECT grp, list({'id': b, 'e': e} ORDER BY b) AS nodes FROM (SELECT grp, b, list(a) AS e FROM pr GROUP BY grp, b) GROUP BY grp)",
        "go AS (SELECT grp, unnest(list_reduce(nodes, lambda gone, x: CASE WHEN len(list_filter(x.e, lambda a: NOT list_contains(gone, a))) > 0 "
        "THEN list_append(gone, x.id) ELSE gone END, []::BIGINT[])) AS id FROM nd)",
        "kept AS (SELECT c.* FROM cl c JOIN se ON se.grp = c.grp AND se.id = c.ord LEFT JOIN go ON go.grp = c.grp AND go.id = c.ord WHERE go.id IS NULL)",
    ) + columns


_SENTENCES = (
    f"src AS (SELECT lang AS grp, doc_id * 1000000 + i - 1 AS ord, trim(regexp_replace(lower(parts[i]), '[^{q.WORD}]+', ' ', 'g')) AS phrase "
    "FROM (SELECT doc_id, lang, string_split_regex(text, '[.!?\\n]+') AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i))"
)
_PARTS = LIBRARY + ",\nsrc AS (SELECT \"column\" || '|' || parent || '|' || theme AS grp, p_partkey AS ord, phrase FROM library)"


@query("jn15_greedy_dedupe", _greedy_sql(_SENTENCES, "SELECT * FROM kept WHERE phrase <> ''"))
def jn15_greedy(spark, d):
    """Greedy near-duplicate removal over every sentence of every document, per language."""
    return curation.dedupe_phrases(sentences(spark, d, "documents", "doc_id", "lang"), ["grp"], "ord")


@query(
    "jn15_greedy_dedupe_parts",
    _greedy_sql(_PARTS, f'SELECT {KEYS}, polarity, k.phrase, p_partkey FROM kept k JOIN library l ON l.p_partkey = k.ord'),
)
def jn15_parts(spark, d):
    lib = part_library(spark, d)
    return curation.dedupe_phrases(lib, ["column", "parent", "theme"], "p_partkey")


_BENCH_SENTENCES = (
    "sent AS (SELECT k, (i - 1) AS i, trim(regexp_replace(lower(parts[i]), '[^{w}]+', ' ', 'g')) AS phrase FROM "
    "(SELECT {key} AS k, string_split_regex(text, '[.!?\\n]+') AS parts FROM {table}), "
    "unnest(range(1, len(parts) + 1)) AS u(i))"
)


def _sentence_sql(name: str, table: str, key: str) -> str:
    return _BENCH_SENTENCES.format(w=q.WORD, key=key, table=table).replace("sent AS", f"{name} AS")


@query(
    "jn16_not_near_existing",
    q.with_(
        _sentence_sql("n0", "benchmark", "item_id"), _sentence_sql("e0", "documents", "doc_id"),
        "n1 AS (SELECT k * 1000000 + i AS ord, phrase, list_distinct(string_split(phrase, ' ')) AS s FROM n0 "
        "WHERE phrase <> '')",
        "ns AS (SELECT DISTINCT list_sort(s) AS s FROM n1)",
        "es AS (SELECT DISTINCT list_sort(list_distinct(string_split(phrase, ' '))) AS s FROM e0 WHERE phrase <> '')",
        # Jaccard needs a shared word and comparable sizes, which keeps the brute force within reason.
        "near AS (SELECT DISTINCT ns.s FROM ns JOIN es ON len(es.s) >= len(ns.s) * 0.65 - 1e-9 "
        "AND len(ns.s) >= len(es.s) * 0.65 - 1e-9 AND len(list_intersect(ns.s, es.s)) / "
        "(len(ns.s) + len(es.s) - len(list_intersect(ns.s, es.s))) >= 0.65)",
    )
    + "SELECT ord, phrase FROM n1 WHERE list_sort(s) NOT IN (SELECT s FROM near)",
)
def jn16(spark, d):
    """Benchmark sentences that are not similar to any sentence of any document."""
    new = sentences(spark, d, "benchmark", "item_id", "")
    existing = sentences(spark, d, "documents", "doc_id", "").select("grp", "phrase")
    return curation.drop_near_existing(new, existing, ["grp"]).select("ord", "phrase")


@query(
    "jn17_existing_keywords",
    q.with_(LIBRARY, _SUBTHEMES)
    + "SELECT s.s_suppkey, array_to_string(b.phrases, '¦') AS keywords FROM (SELECT s_suppkey, 'Free_Text_' || "
    "(s_suppkey % 3 + 1) AS \"column\", 'Brand#' || (s_suppkey % 30 + 1) AS theme, 'Size ' || "
    "(s_nationkey % 6) AS subtheme FROM supplier) s LEFT JOIN (SELECT \"column\", theme, subtheme, "
    'max_by(phrases, parent) AS phrases FROM subs GROUP BY ALL) b USING ("column", theme, subtheme)',
)
def jn17(spark, d):
    supplier = fx.table(spark, d, "supplier")
    wanted = supplier.select(
        "s_suppkey",
        F.concat(F.lit("Free_Text_"), (F.col("s_suppkey") % 3 + 1).cast("string")).alias("column"),
        F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 30 + 1).cast("string")).alias("theme"),
        F.concat(F.lit("Size "), (F.col("s_nationkey") % 6).cast("string")).alias("subtheme"),
    )
    found = curation.existing_keywords(wanted, enriched(spark, d))
    return found.select("s_suppkey", F.array_join("keywords_phrases", "¦").alias("keywords"))


def _quality_sql(phrase: str, subtheme: str) -> dict[str, str]:
    pw, sw = f"list_distinct({q.tokens(f'lower({phrase})')})", f"list_distinct({q.tokens(f'lower({subtheme})')})"
    vocab = " OR ".join(f"contains(lower({phrase}), {q.lit(t)})" for t in lx.UK_WORKPLACE_VOCAB)
    ratio = (
        f"CASE WHEN len({pw}) > 0 THEN len(list_filter({pw}, lambda w: w IN {q.in_list(lx.GENERIC_WORDS)})) / len({pw}) "
        "ELSE 0.0 END::DOUBLE"
    )
    return {
        "length": f"CASE WHEN len({q.tokens(phrase)}) BETWEEN 5 AND 15 THEN 1.0 ELSE 0.5 END::DOUBLE",
        "specificity": f"CASE WHEN len({sw}) > 0 THEN least(len(list_intersect({sw}, {pw})) / len({sw}), 1.0) "
        "ELSE 0.5 END::DOUBLE",
        "uk_vocab": f"CASE WHEN {vocab} THEN 1.0 ELSE 0.7 END::DOUBLE",
        "not_generic": f"(1.0 - least(({ratio}) * 2, 1.0))::DOUBLE",
    }


_Q = _quality_sql("phrase", "subtheme")
_QUALITY_INPUT = (
    "inp AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'my line manager gave the ' || p_name || ' more help' "
    "WHEN 1 THEN 'need better ' || p_name WHEN 2 THEN p_name ELSE 'overtime on the rota for every ' || p_name || "
    "' since the appraisal' END AS phrase, p_name || ' ' || lower(p_type) AS subtheme FROM part)"
)


@query(
    "ag20_phrase_quality",
    q.with_(_QUALITY_INPUT, "s AS (SELECT p_partkey, " + ", ".join(f"{e} AS {n}" for n, e in _Q.items()) + " FROM inp)")
    + "SELECT p_partkey, round(length, 6) AS length, round(specificity, 6) AS specificity, round(uk_vocab, 6) AS uk_vocab, "
    "round(not_generic, 6) AS not_generic, round((length + specificity + uk_vocab + not_generic) / 4, 6) AS overall FROM s",
)
def ag20(spark, d):
    name, key = F.col("p_name"), F.col("p_partkey") % 4
    phrase = (
        F.when(key == 0, F.concat(F.lit("my line manager gave the "), name, F.lit(" more help")))
        .when(key == 1, F.concat(F.lit("need better "), name))
        .when(key == 2, name)
        .otherwise(F.concat(F.lit("overtime on the rota for every "), name, F.lit(" since the appraisal")))
    )
    subtheme = F.concat_ws(" ", name, F.lower("p_type"))
    scored = fx.table(spark, d, "part").select("p_partkey", phrases.phrase_quality(phrase, subtheme).alias("q"))
    return scored.select(
        "p_partkey",
        *[F.round(F.col("q")[n], 6).alias(n) for n in ("length", "specificity", "uk_vocab", "not_generic", "overall")],
    )


_MADE = (
    LIBRARY,
    f"kept AS (SELECT DISTINCT {KEYS}, polarity, phrase FROM library)",
    "made AS (SELECT \"column\", parent, theme, subtheme, polarity, count(*) AS total_generated FROM library GROUP BY ALL)",
    "kq AS (SELECT *, ((" + ") + (".join(_Q.values()) + ")) / 4 AS overall FROM kept)",
    f"stay AS (SELECT {KEYS}, polarity, count(*) AS phrase_count, avg(overall) AS avg_quality FROM kq GROUP BY ALL)",
)


def metrics(spark, d) -> DataFrame:
    lib = part_library(spark, d).drop("p_partkey")
    return curation.library_metrics(lib, lib.distinct())


@query(
    "ag21_library_metrics",
    q.with_(*_MADE)
    + f"SELECT {KEYS}, polarity, phrase_count, round(avg_quality, 6) AS avg_quality, total_generated, phrase_count "
    f"AS total_after_dedupe FROM made LEFT JOIN stay USING ({KEYS}, polarity)",
)
def ag21(spark, d):
    return metrics(spark, d).withColumn("avg_quality", F.round("avg_quality", 6))


@query(
    "ag21_library_totals",
    q.with_(*_MADE)
    + "SELECT count(*) AS subthemes, sum(phrase_count)::BIGINT AS phrases, round(avg(phrase_count), 6) "
    "AS phrases_per_subtheme FROM stay",
)
def ag21_totals(spark, d):
    totals = curation.library_totals(metrics(spark, d))
    return totals.withColumn("phrases_per_subtheme", F.round("phrases_per_subtheme", 6))


@query(
    "rs5_union_of_passes",
    "SELECT 'a' AS pass, p_name AS phrase FROM part UNION ALL SELECT 'b', p_brand FROM part "
    "UNION ALL SELECT 'c', text FROM benchmark",
)
def rs5(spark, d):
    part = fx.table(spark, d, "part")
    return union_all(
        part.select(F.lit("a").alias("pass"), F.col("p_name").alias("phrase")),
        part.select(F.col("p_brand").alias("phrase"), F.lit("b").alias("pass")),
        fx.table(spark, d, "benchmark").select(F.lit("c").alias("pass"), F.col("text").alias("phrase")),
    )
