from pyspark.sql import functions as F

from verbatim.operators.reshape import combined_fingerprint, table_fingerprint
from verbatim.plans import reuse


def test_only_changed_buckets_are_computed(spark, tmp_path):
    store, seen = str(tmp_path / "store"), []

    def plan(rows):
        seen.append(rows.select("id").collect())
        return rows.filter("id IS NULL OR id <> 3").select("id", F.upper("t").alias("u"), "`a.b`")

    def check(df, **settings):
        seen.clear()
        got = reuse.reused(df, plan, store, "id", buckets=16, **settings)
        want = df.filter("id IS NULL OR id <> 3").select("id", F.upper("t").alias("u"), "`a.b`")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.columns == want.columns
        return sum(map(len, seen))

    schema = "id long, t string, `a.b` int"
    rows = [(i, f"text {i}", None) for i in range(200)] + [(None, None, 1), (None, "x", 1), (7, "text 7", None)]
    df = spark.createDataFrame(rows, schema)
    assert check(df) == 203
    assert check(df.repartition(3)) == 0 and seen == []
    # One text changed: its bucket alone; back again: nothing.
    one = check(df.withColumn("t", F.when(F.col("id") == 5, "other").otherwise(F.col("t"))))
    assert 0 < one < 60
    assert check(df) == 0
    assert 0 < check(df.filter("id IS NULL OR id <> 9")) < 60
    # A row less among equal ones, a different plan, another type are other contents.
    assert 0 < check(spark.createDataFrame(rows[:-1], schema)) < 60
    assert check(df, settings="v2") == 203
    assert check(spark.createDataFrame(rows, "id long, t string, `a.b` long"), settings="v2") == 203


def test_unfinished_runs_empty_tables_and_empty_results(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    df = spark.createDataFrame([(i, "x") for i in range(30)], "id long, t string")
    # Rows written, manifest not: the next run does not read them.
    df.limit(3).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{store}/rows/broken")
    plan = lambda rows: rows.withColumn("n", F.length("t"))
    assert reuse.reused(df, plan, store, "id").count() == 30 == reuse.reused(df, plan, store, "id").count()
    assert reuse.reused(df.filter("id < 0"), plan, store, "id").columns == ["id", "t", "n"]
    none = lambda rows: plan(rows).filter("n > 1")
    for _ in range(2):
        assert reuse.reused(df, none, store, "id", settings="none").count() == 0


def test_fingerprints_by_bucket_add_up(spark):
    df = spark.range(100).selectExpr("id", "id % 7 x", "cast(id as string) t")
    parts = table_fingerprint(df, by={"bucket": F.col("x")})
    assert parts.count() == 7 and combined_fingerprint(parts).collect() == table_fingerprint(df).collect()
