import json

from pyspark.sql import functions as F

from suite import fixture as fx
from suite import q_match, q_reports, q_sentiment
from verbatim.settings import OutputSettings
from verbatim.streaming import run
from verbatim.streaming.run import append_batches, append_stream, batch_results, read_responses, stream_tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyword_matching_has_no_shuffle_and_no_python(spark):
    sv = spark.read.parquet(f"{SF}/orders.parquet").select(
        F.col("o_orderkey").alias("ID"), F.col("o_orderpriority").alias("text"), F.lit("Free_Text_1").alias("TextColumn"),
        F.lit(True).alias("is_meaningful"), F.lit("Detailed response").alias("response_detail"),
    )
    from verbatim.operators.keyword import assign_keyword

    text = plan(assign_keyword(sv, fx.keyword_index(), q_match.EXACT))
    assert "Exchange" not in text and "Python" not in text
    # Only the columns that are needed are read.
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text


def test_filters_do_not_repeat_the_matching(spark):
    filtered = q_reports.assignments(spark, SF).filter((F.col("theme") == "Price") & (F.col("reason") == "matched"))
    assert plan(filtered).count("INSET app slow") + plan(filtered).count("INSET arrived late") <= 2


def test_reports_aggregate_before_the_shuffle(spark):
    text = plan(q_sentiment.ag7(spark, SF))
    assert text.count("HashAggregate") >= 2 and "SortMergeJoin" not in text and "Python" not in text


def test_similarity_has_no_pair_rows(spark):
    text = plan(q_match.rk3(spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    fx.survey(spark, SF).repartition(4).write.parquet(source)
    batch_input = spark.read.parquet(source)
    job = q_reports.full_job(fuzzy=False, outputs=OutputSettings())
    stream = stream_tables(job, read_responses(spark, source, batch_input.schema, files_per_batch=2))
    batch = stream_tables(job, batch_input)
    for name in stream:
        out = str(tmp_path / name)
        append_stream(stream[name], out, str(tmp_path / f"{name}-checkpoint")).awaitTermination()
        a, b = spark.read.parquet(out), batch[name]
        assert a.count() == b.count() > 0
        assert a.select(*b.columns).exceptAll(b).count() == 0, name


def test_batches_of_a_stream_equal_the_batch_job(spark, tmp_path):
    """With fuzzy matching, which works on batches; a batch that runs again replaces what it wrote."""
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    fx.survey(spark, SF).filter("ID % 7 = 0").repartition(4).write.parquet(source)
    batch_input = spark.read.parquet(source)
    job = q_reports.full_job(outputs=OutputSettings(assignments=True))
    stream = read_responses(spark, source, batch_input.schema, files_per_batch=2)
    calls = []

    def tables(batch):
        calls.append(1)
        return {"assignments": job.assign(job.prepare(batch))}

    append_batches(stream, tables, folder, str(tmp_path / "c1")).awaitTermination()
    first = len(calls)
    append_batches(stream, tables, folder, str(tmp_path / "c1")).awaitTermination()
    assert first >= 2 and len(calls) == first
    # As after a crash that lost the checkpoint's last commit: the same numbers are written again.
    append_batches(stream, tables, folder, str(tmp_path / "c2")).awaitTermination()
    a, b = batch_results(spark, folder, "assignments"), job.assign(job.prepare(batch_input))
    assert a.count() == b.count() > 0 and a.select(*b.columns).exceptAll(b).count() == 0


def test_fuzzy_matching_refuses_a_stream(spark, tmp_path):
    import pytest

    source = str(tmp_path / "in")
    fx.survey(spark, SF).limit(5).write.parquet(source)
    stream = read_responses(spark, source, spark.read.parquet(source).schema)
    with pytest.raises(ValueError, match="batch by batch"):
        stream_tables(q_reports.full_job(outputs=OutputSettings()), stream)


def test_repeated_responses_count_once(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, "2024-01-01", "a"), (2, "2024-01-02", "a"), (1, "2024-01-03", "a"), (3, "2024-01-04", "b")]
    for r in rows:
        spark.createDataFrame([r], "ID int, day string, v string").withColumn("sent", F.to_timestamp("day")).write.mode("append").parquet(source)
    stream = read_responses(spark, source, spark.read.parquet(source).schema, files_per_batch=50)
    once = run.distinct_responses(stream, "sent", "30 days")
    count = lambda b: {"n": b.groupBy("v").agg(F.count(F.lit(1)).alias("n"))}
    append_batches(once, count, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    total = run.added_up(batch_results(spark, str(tmp_path / "out"), "n"), ["v"])
    assert sorted(tuple(r) for r in total.collect()) == [("a", 2), ("b", 1)]


def test_job_outputs(spark, tmp_path):
    folders = [str(tmp_path / "tables"), str(tmp_path / "deliverables")]
    names = q_reports.full_job(fuzzy=False).write(fx.survey(spark, SF), folders)
    assert {"assignments_keyword", "sentiment_by_id", "segment_sentiment_summary", "data_audit"} <= set(names)
    read = lambda f, n: spark.read.option("header", True).option("multiLine", True).csv(f"{f}/{n}").count()
    assert [read(folders[0], n) for n in names] == [read(folders[1], n) for n in names]
    matched, unmatched = (read(folders[0], f"taxonomy_{m}_keyword") for m in ("matched", "unmatched"))
    assert matched + unmatched == read(folders[0], "assignments_keyword") == fx.survey(spark, SF).count() * 3


def test_queries_and_twins_line_up():
    import suite

    queries, twins = suite.queries(), suite.twins()
    assert set(twins) <= set(queries) and len(queries) > 120
    json.dumps(sorted(queries))
