import json
import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from verbatim.functions.phrases import jaccard, word_set
from verbatim.operators import curation, taxonomy
from verbatim.session import written
from verbatim.sources import taxonomy as io

COLUMNS = "column string, parent string, theme string, subtheme string, polarity string, phrase string"
ROWS = [
    ("B", "P", "T", "S", "Negative", "late bus"), ("B", "P", "T", "S", "Positive", "late bus"), ("B", "P", "T", "S", None, "bus "),
    ("A", "Q", "T", "S2", None, "x y"), ("A", "P", "T2", "S3", "good", "z"), ("A", None, "T", "S", "Either", "lost"),
    ("A", "Q", "T", "S2", "Negative", "x y"),
]


def library(spark, rows=ROWS):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], COLUMNS + ", n int")


def test_validation(spark):
    got = {(r["check"], r["detail"]): r["count"] for r in taxonomy.validate_library(library(spark).drop("n")).collect()}
    assert got[("empty_values", "parent")] == 1 and got[("empty_values", "polarity")] == 2
    assert got[("polarity_outside_allowed", "polarity")] == 3 and got[("few_phrases", "fewer than 2")] == 1
    assert ("duplicate_rows", "column, parent, theme, subtheme, polarity, phrase") not in got
    missing = taxonomy.validate_library(library(spark).drop("n", "phrase")).collect()
    assert [(r["severity"], r["detail"]) for r in missing] == [("error", "phrase")]


def test_enriched_round_trip(spark, tmp_path):
    subs = taxonomy.enriched_subthemes(library(spark), F.col("n"))
    got = {(r["column"], r["subtheme"]): (r["keywords_phrases"], r["default_polarity"]) for r in subs.collect()}
    assert got == {
        ("B", "S"): (["bus ", "late bus"], "Negative"), ("A", "S2"): (["x y"], "Either"), ("A", "S3"): (["z"], "good"),
    }
    path = str(tmp_path / "lib.json")
    io.write_enriched_library(taxonomy.nest_library(subs), path)
    document = json.loads(open(path, encoding="utf-8").read())
    assert document["metadata"]["columns"] == ["A", "B"]
    assert [p["parent_name"] for p in document["column_libraries"]["A"]["parents"]] == ["P", "Q"]
    flat = io.read_enriched_library(spark, path).orderBy("phrase_idx").collect()
    assert [(r["phrase_idx"], r["column"], r["phrase"]) for r in flat] == [
        (0, "A", "z"), (1, "A", "x y"), (2, "B", "bus "), (3, "B", "late bus"),
    ]


def test_keyword_themes(spark, tmp_path):
    themes = taxonomy.keyword_themes(library(spark))
    path = str(tmp_path / "themes.yaml")
    io.write_themes(themes, path)
    index = io.read_themes(path)
    by_name = {(s.theme, s.subtheme): s for s in index.subthemes}
    assert by_name[("T", "S")].parent_theme == "P"
    assert by_name[("T", "S")].polarity == "Either"  # a tie goes to the smallest
    assert by_name[("T", "S")].token_terms == ("bus", "lost") and by_name[("T", "S")].cols == ("A", "B")


def test_phrases_are_numbered_in_order(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("a"), (F.col("id") % 3).alias("b")).repartition(5)
    rows = taxonomy.number_phrases(df, ["b", "a"]).collect()
    assert [r["phrase_idx"] for r in sorted(rows, key=lambda r: (r["b"], r["a"]))] == list(range(500))


def random_phrases(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["the", "of"]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(2, 6))) for _ in range(n)]


def greedy(phrases, threshold):
    kept = []
    for i, p in phrases:
        s = set(p.split())
        if all(len(s & t) / len(s | t) < threshold for _, t in kept):
            kept.append((i, s))
    return [i for i, _ in kept]


def test_greedy_dedupe_matches_brute_force(spark):
    rows = []
    for g in range(3):
        crowd = ["w1 w2 w3 the"] * 40 if g == 0 else []  # a crowd of copies in one group
        for i, p in enumerate(random_phrases(120, g) + crowd):
            rows.append((f"g{g}", i, p))
    df = spark.createDataFrame(rows, "grp string, ord long, phrase string")
    got = curation.dedupe_phrases(df, ["grp"], "ord").collect()
    clean = {(r["grp"], r["ord"]): r["phrase"] for r in curation.candidates_for_library(df).collect()}
    for g in range(3):
        mine = sorted((o, p) for (gg, o), p in clean.items() if gg == f"g{g}")
        assert sorted(r["ord"] for r in got if r["grp"] == f"g{g}") == greedy(mine, 0.65)


def test_near_existing_matches_brute_force(spark):
    new = [(i, "a", p) for i, p in enumerate(random_phrases(80, 11))]
    old = [("a", p) for p in random_phrases(80, 12)]
    kept = curation.drop_near_existing(
        spark.createDataFrame(new, "id int, grp string, phrase string"),
        spark.createDataFrame(old, "grp string, phrase string"), ["grp"],
    )
    sim = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = [i for i, _, p in new if all(sim(p, q) < 0.65 for _, q in old)]
    assert sorted(r["id"] for r in kept.collect()) == want and 0 < len(want) < len(new)


def test_near_existing_looks_sets_up_without_a_shuffle_of_the_existing(spark, monkeypatch):
    new = spark.createDataFrame([("ab"[i % 2], p) for i, p in enumerate(random_phrases(150, 21))] + [(None, "w1 w2"), ("a", "")], "grp string, phrase string")
    old = spark.createDataFrame([("ab"[i % 2], p) for i, p in enumerate(random_phrases(150, 22) * 2)] + [(None, "w1 w2"), ("a", None), ("c", "w1")], "grp string, phrase string")
    for threshold in (0.3, 0.65, 0.9):
        held = curation.near_existing(new, old, ["grp"], threshold=threshold)
        met = curation.near_existing(new, old, ["grp"], threshold=threshold, held_words=0)
        rows = lambda df: sorted((r["grp"], tuple(r["words"])) for r in df.collect())
        sim = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
        sides = [{(r["grp"], tuple(sorted(set((r["phrase"] or "").split())))) for r in df.collect() if r["grp"]} for df in (new, old)]
        want = sorted({(g, n) for g, n in sides[0] if n and any(g == h and e and sim(n, e) >= threshold for h, e in sides[1])})
        assert rows(held) == rows(met) == want and want
    monkeypatch.delattr(curation, "_ordered_sets")
    assert rows(curation.near_existing(new, old, ["grp"], threshold=0.9)) == want
    assert curation.near_existing(new.limit(0), old, ["grp"]).count() == 0


def test_jaccard(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", "a"), ("a a", "a")], "x string, y string")
    got = [r[0] for r in df.select(jaccard(word_set(F.col("x")), word_set(F.col("y")))).collect()]
    assert got == [1 / 3, 0.0, 1.0]


def test_related_examples(spark):
    df = spark.createDataFrame(
        [(0, "A", i, ["Work load"], f"e{i}") for i in range(15)] + [(1, "A", 0, ["zz"], "no")],
        "category_pos int, column string, example_pos int, related_themes array<string>, example string",
    )
    got = curation.related_examples(df, [("A", "load", "s"), ("A", "the WORK LOAD topic", "t"), ("B", "load", "s")])
    assert got.count() == 20 and {r["example"] for r in got.filter("rank = 1").collect()} == {"e0"}


def test_similar_sets_match_brute_force_and_shuffle_no_set_to_order_it(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    made = {(g, tuple(sorted(rng.sample(words, rng.randint(1, 14))))) for g in "ab" for _ in range(150)}
    made |= {(g, tuple(sorted({*s, rng.choice(words)} - {rng.choice(s)}))) for g, s in list(made)}
    rows = [(g, i, list(s)) for i, (g, s) in enumerate(sorted(made)) if s] + [(None, 9000, ["w1", "w2"]), (None, 9001, ["w1", "w2"])]
    sets = spark.createDataFrame(rows, "grp string, set_id long, words array<string>").repartition(3)
    monkeypatch.delattr(curation, "_ordered_sets")
    for threshold, common in ((0.3, 4), (0.65, 1 << 18), (0.65, 0), (0.9, 16)):
        monkeypatch.setattr(curation.common_codes, "__defaults__", (common,))
        got = {(r["id_a"], r["id_b"]) for r in curation.similar_sets(sets, ["grp"], threshold).collect()}
        want = {
            (i, j) for g, i, s in rows for h, j, t in rows
            if g and g == h and i < j and len(set(s) & set(t)) / len(set(s) | set(t)) >= threshold
        }
        assert got == want and want


def test_written_tables_leave_no_shuffle_files_behind(spark):
    held = lambda: {f.name for d in Path(str(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0])).iterdir() if d.is_dir() for f in d.glob("shuffle_*.data")}
    df = spark.createDataFrame([("g", i, p) for i, p in enumerate(random_phrases(300, 3))], "grp string, ord long, phrase string")
    before = held()
    pairs = written(df.repartition(3, "phrase").groupBy("phrase").count())
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.1)
    assert held() <= before and pairs.count() > 0
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_canonical_phrases_are_computed_once(spark):
    df = spark.createDataFrame([("My Manager likes color.",), ("a vacation  plan",)], "phrase string")
    plan = curation.candidates_for_library(df)
    assert plan._jdf.queryExecution().executedPlan().toString().count("normalise(") <= 1
    assert sorted(r["phrase"] for r in plan.collect()) == ["a annual leave plan", "my line manager likes colour"]
