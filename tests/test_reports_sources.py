import pytest
from pyspark.sql import functions as F

from suite import fixture as fx
from verbatim.operators import frequency, quality, reports
from verbatim.operators.reshape import response_long, table_fingerprint
from verbatim.settings import FrequencySettings
from verbatim.sources import results
from verbatim.sources import survey as io
from verbatim.sources.dictionary import TextDictionary, read_dictionary
from verbatim.sources.files import write_yaml


def assignments(spark, rows):
    return spark.createDataFrame(rows, "ID long, TextColumn string, theme string, subtheme string")


def test_compare_with_itself_agrees(spark):
    a = assignments(spark, [(1, "x", "A", "a"), (2, "x", None, "b")])
    assert reports.mismatches(reports.compare_assignments(a, a)).count() == 0
    b = assignments(spark, [(1, "x", "A", "other"), (3, "x", "B", "b")])
    totals = reports.agreement_totals(reports.compare_assignments(a, b)).first()
    assert tuple(totals) == (3, 0, 3)


def test_theme_counts_and_top(spark):
    a = assignments(spark, [(1, "x", "A | B", ""), (2, "x", "A", ""), (3, "x", "Brief response", ""), (4, "x", None, "")])
    counts = reports.theme_counts(a)
    assert {r["theme"]: r["count"] for r in counts.collect()} == {"A": 2, "B": 1}
    assert [r["theme"] for r in reports.top(counts, 1).collect()] == ["A"]


def test_filter_view(spark):
    view = assignments(spark, [(1, "x", "A | B", "a"), (2, "y", "C", "c")]).withColumn("text", F.lit("Some Text"))
    ids = lambda **kw: sorted(r["ID"] for r in reports.filter_view(view, reports.ViewFilter(**kw)).collect())
    assert ids() == [1, 2] and ids(themes=["B", "Z"]) == [1] and ids(text_columns=["y"]) == [2]
    assert ids(search="some\\s") == [1, 2] and ids(search="zzz") == [] and ids(only_meaningful=True) == [1, 2]


def test_attach_text_suffixes(spark):
    a = assignments(spark, [(1, "x", "A", "a")]).withColumn("is_meaningful", F.lit(True))
    r = spark.createDataFrame([(1, "x", "hello", False)], "ID long, TextColumn string, text string, is_meaningful boolean")
    row = reports.attach_text(a, r).first()
    assert row["is_meaningful_x"] is True and row["is_meaningful_y"] is False and row["text"] == "hello"


def test_audit_counts(spark):
    df = spark.createDataFrame([("a",), (None,), (" ",), ("No entry ",), ("",)], "t string")
    got = {r["column"]: r for r in quality.data_audit(df, ["t", "u"]).collect()}
    assert tuple(got["t"])[1:] == (5, False, 1, 3, 2, 1)
    assert got["u"]["missing_column"] and got["u"]["null_count"] is None and got["u"]["total_rows"] == 5


def test_report_counts_every_answer(spark):
    sv = fx.survey(spark, "/root/testdata/sf0.001")
    total = quality.quality_report(sv, fx.TEXT_COLUMNS).agg(F.sum("count")).first()[0]
    assert total == sv.count() * 3


def test_frequency_fallback_is_per_column(spark):
    d = TextDictionary(force_phrases=("late_bus",))
    rows = [("x", "late bus today"), ("x", "late bus"), ("y", "cold food"), ("y", "cold soup"), ("y", None)]
    df = spark.createDataFrame(rows, "TextColumn string, text string")
    got = {(r["TextColumn"], r["token"]): r["count"] for r in frequency.token_frequencies(df, d).collect()}
    assert got == {("x", "late bus"): 2, ("y", "cold"): 2}
    everything = frequency.token_frequencies(df, d, FrequencySettings(keep_phrases_only=False, min_freq=1))
    assert everything.count() == 5


def test_csv_round_trip_and_na(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted"\nline, x'), (2, "N/A"), (3, "nil"), (4, "  pad "), (5, None)], "ID long, t string")
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    results.write_table(df, paths)
    for p in paths:
        got = {r["ID"]: r["t"] for r in io.read_survey_csv(spark, p, "ID long, t string").collect()}
        assert got == {1: 'a "quoted"\nline, x', 2: None, 3: "nil", 4: "  pad ", 5: None}


def test_rename_two_headers_to_one(spark):
    df = spark.createDataFrame([("x", None, 1), (None, "y", 2)], "short string, `long text` string, k int")
    got = io.rename_headers(df, {"short": "Q1", "long text": "Q1", "missing": "Q2"})
    assert got.columns == ["Q1", "k"] and [r["Q1"] for r in got.collect()] == ["x", "y"]


def test_text_column_choice(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "k int, t string, n double")
    assert io.choose_text_columns(df, "k")[1] == ["t"]
    assert io.choose_text_columns(df.drop("t"), "k")[1] == ["n"]


def test_dictionary_file(spark, tmp_path):
    path = str(tmp_path / "d.yaml")
    write_yaml({"BUSINESS_MAP": {"A B": "C"}, "ALWAYS_BLOCK": ["x"], "DOMAIN_WHITELIST": ["Y"]}, path)
    d = read_dictionary(path)
    assert d.business_map == {"a b": "c"} and d.always_drop == frozenset() and d.unigram_whitelist == {"y"}
    assert read_dictionary(path, block_list_drops=True).always_drop == {"x"}
    assert read_dictionary(str(tmp_path / "none.yaml")) == TextDictionary()
    assert TextDictionary.from_df(d.to_df(spark)) == d


def test_missing_text_column_in_comparison_file(spark, tmp_path):
    p = str(tmp_path / "x")
    results.write_table(spark.createDataFrame([(1,)], "ID long"), [p])
    with pytest.raises(ValueError):
        results.read_assignments(spark, p)


def test_fingerprint_ignores_row_order(spark):
    df = spark.range(100).withColumn("t", F.col("id").cast("string"))
    a, b = table_fingerprint(df).first(), table_fingerprint(df.orderBy(F.desc("id")).repartition(5)).first()
    assert a == b and a != table_fingerprint(df.filter("id < 99")).first()


def test_response_long_skips_missing_columns(spark):
    df = spark.createDataFrame([(1, "a")], "ID long, x string")
    assert [tuple(r)[:3] for r in response_long(df, ["x", "y"]).collect()] == [(1, "x", "a")]


def test_exact_quantiles(spark):
    import random

    import numpy as np

    from verbatim.operators.profile import exact_quantiles

    rng = random.Random(1)
    for data in ([0.5], [1.0, 2.0], [3.0] * 500 + [rng.gauss(0, 1) for _ in range(700)], [1e-12 * i for i in range(50)]):
        df = spark.createDataFrame([(x,) for x in data] + [(None,)], "v double")
        got = exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0], buckets=8)
        assert np.allclose(got, np.quantile(data, [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]), rtol=0, atol=1e-15)
    assert exact_quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_split_csv_reader_equals_the_whole_file_reader(spark, tmp_path):
    """Quoted line breaks on every block border: one file read by many tasks gives what one task reads."""
    import random

    from verbatim.sources.survey import read_large_survey_csv, read_survey_csv

    rng = random.Random(1)
    answer = lambda: "".join(rng.choice(['a', ' ', '\n', '""', ',', 'é', 'word ', '\n\n']) for _ in range(rng.randint(0, 60)))
    body = "".join(f'{i},"{answer()}",{"plain" if i % 3 else ""}\n' for i in range(4000))
    for name, text in (("one", 'ID,"long\nheader",c\n' + body), ("two", 'ID,b,c\n9,"x\ny",z'), ("empty", "ID,b,c\n")):
        (tmp_path / f"{name}.csv").write_text(text)
    schema = "ID int, b string, c string"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        for path in (str(tmp_path), str(tmp_path / "one.csv"), str(tmp_path / "empty.csv")):
            got = read_large_survey_csv(spark, path, schema)
            want = read_survey_csv(spark, path, schema)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        lines = spark.read.text(str(tmp_path / "one.csv"))
        assert lines.rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_fingerprints_of_parts_add_up(spark):
    from verbatim.operators.reshape import combined_fingerprint, table_fingerprint

    rows = [(i, None if i % 5 == 0 else f"t{i}|{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "b int, a string")
    whole = table_fingerprint(df).first()
    parts = table_fingerprint(df.filter("b < 30")).unionByName(table_fingerprint(df.filter("b >= 30")))
    assert combined_fingerprint(parts).first() == whole == table_fingerprint(df.orderBy("a")).first()
    changed = df.withColumn("a", F.when(F.col("b") == 7, "x").otherwise(F.col("a")))
    assert table_fingerprint(changed).first() != whole
    assert table_fingerprint(df.filter("b < 0")).first()[:] == (0, 0, 0)


def test_frequent_tokens_are_exact_with_few_counters(spark):
    import random

    rng = random.Random(4)
    words = [f"word{i}" for i in range(400)]
    texts = [(lang, " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(400)], k=60))) for lang in ("a", "b") for _ in range(120)]
    df = spark.createDataFrame(texts, "TextColumn string, text string").repartition(6)
    settings = FrequencySettings(keep_phrases_only=False, min_freq=1)
    d = TextDictionary.from_config({})
    want = sorted(map(tuple, frequency.top_tokens(frequency.token_frequencies(df, d, settings), 5).select("TextColumn", "token", "count").collect()))
    for capacity in (3, 40, 120, 10_000):
        got = frequency.frequent_tokens(df, d, 5, settings, capacity)
        assert sorted(map(tuple, got.select("TextColumn", "token", "count").collect())) == want, capacity
    assert frequency.frequent_tokens(df.filter("text is null"), d, 5, settings).count() == 0


def test_sketches_merge_within_their_errors(spark):
    from verbatim.operators import sketches

    df = spark.range(40_000).select(
        (F.col("id") % 7_000).alias("ID"), (F.col("id") % 4).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"),
        F.when(F.col("id") % 10 != 0, F.rand(3)).alias("v"),
    ).cache()
    stored = sketches.facet_sketches(df, ["a", "b"], "ID", "v")
    assert stored.count() == 12
    for condition in ("true", "a = '1'", "a = '1' and b <> '2'", "a = 'x'"):
        part = df.filter(condition)
        row = sketches.merged_metrics(stored.filter(condition)).first()
        ids = part.select("ID").distinct().count()
        assert row.rows == part.count() and abs(row.unique_ids - ids) <= sketches.DISTINCT_ERROR * ids
        for rank, value in zip(sketches.QUANTILES, row.quantiles, strict=True):
            if ids:
                below = part.filter(F.col("v") < value).count() / part.filter("v is not null").count()
                assert abs(below - rank) <= sketches.RANK_ERROR
            else:
                assert value is None


def test_taxonomy_build_stops_on_errors(spark, tmp_path):
    from verbatim.plans.taxonomy import TaxonomyBuild, TaxonomyErrors
    from verbatim.sources.taxonomy import read_library_rows, read_theme_rows

    columns = "`column` string, parent string, theme string, subtheme string, polarity string, phrase string"
    good = [("c", "p", "t", "s", "Either", "one two"), ("c", "p", "t", "s", "Positive", "three")]
    library = spark.createDataFrame(good + [("c", None, "t", "s", "Either", "x")], columns)
    with pytest.raises(TaxonomyErrors, match="parent"):
        TaxonomyBuild().run(library, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    issues = TaxonomyBuild(allow_errors=True).run(library, str(tmp_path / "y"))
    assert any(i[0] == "error" for i in issues)
    row = read_library_rows(spark, str(tmp_path / "y" / "enriched")).first()
    assert (row.subtheme, row.keywords_phrases) == ("s", ["one two", "three"])
    assert read_theme_rows(spark, str(tmp_path / "y" / "themes")).count() == 1
    assert TaxonomyBuild(validate_only=True).run(spark.createDataFrame(good, columns), str(tmp_path / "z")) == [] and not (tmp_path / "z").exists()


def test_spread_tasks_grow_with_the_rows(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    assert io.spread(rows).rdd.getNumPartitions() == cores
    many = io.spread(rows, rows_per_task=100)
    assert many.rdd.getNumPartitions() >= 10 and many.rdd.getNumPartitions() % cores == 0
    assert max(len(p) for p in many.rdd.glom().collect()) <= 150
    assert sorted(r["id"] for r in many.collect()) == list(range(1000))
    assert io.spread(rows.limit(0)).count() == 0
    split = rows.repartition(cores + 1)
    assert io.spread(split).rdd.getNumPartitions() == cores + 1


def test_several_readers_of_a_table_compute_it_once(spark):
    """What the sketches and both sides of the comparison read is written once, with nothing of its making left in the plan."""
    from suite import q_reports as qr

    made = spark.range(50).select("id", F.col("id").cast("string").alias("name"))
    kept = qr.written(spark, made)
    assert kept.schema.names == made.schema.names and sorted(kept.collect()) == sorted(made.collect())
    assert "Range" not in kept._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["rk5_top_themes", "jn2_short_text_tokens", "dx9_topic_entropy", "rk1_keyword_top_k", "ag8_multi_label_collapse", "jn8_strict_columns"],
)
def test_survey_queries_get_more_tasks_with_more_rows(spark, tmp_path, monkeypatch, name):
    """A task of these queries takes a bounded number of responses."""
    import suite

    orders = "id AS o_orderkey", "id % 7 AS o_custkey", "date'2024-01-01' AS o_orderdate"
    spark.range(400).selectExpr(*orders).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(fx, "spread", lambda df: io.spread(df, rows_per_task=30))
    plan = suite.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    cores = spark.sparkContext.defaultParallelism
    assert f"Repartition {cores * -(-400 // (cores * 30))}, true" in plan


def test_hybrid_merge_carries_only_the_fields_that_are_read(spark):
    schema = "ID long, TextColumn string, theme string, rule_score double, evidence string, reason string"
    keyword = spark.createDataFrame(
        [(1, "a", "K", 0.9, "e", "matched"), (2, "a", "K", 0.2, "e", "matched"), (3, "a", "", 0.0, "", "no_match"),
         (4, "a", "B", 1.0, "", "dismissed:No"), (5, "a", "", 0.0, "", "no_match"), (5, "a", "", 0.0, "", "no_match"),
         (6, "a", "K", None, "e", "matched"), (7, None, "", 0.0, "", "no_match")], schema)
    semantic = spark.createDataFrame([(i, "a", f"S{i}", 0.6 if i == 3 else 0.8, "s", "matched") for i in range(1, 7)] + [(7, None, "S7", 0.9, "s", "matched")], schema)
    merged = reports.hybrid_merge(keyword, semantic)
    assert merged.columns == keyword.columns
    got = sorted((r["ID"], r["theme"], r["evidence"]) for r in merged.collect())
    assert got == [(1, "K", "e"), (2, "S2", "s"), (3, "", ""), (4, "B", ""), (5, "S5", "s"), (5, "S5", "s"), (6, "S6", "s"), (7, "", "")]
    plan = merged.select("ID", "theme")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [step for step in plan if "evidence" in step and "LogicalRDD" not in step]
