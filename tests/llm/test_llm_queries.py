"""The registered queries against their SQL, and the pipeline against its stages by hand."""

import sys
from collections import Counter
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from check_queries import compare, connect  # noqa: E402

from verbatim.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    status, note = compare(spark, connect(SF), SF, name, ORACLES[name])
    assert status == "ok", note


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_bpe_query_against_the_library(spark):
    import hashlib

    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    from verbatim.llm.queries import vocabulary_path

    theirs = Tokenizer.from_file(vocabulary_path())
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in QUERIES["op3_bpe"](spark, SF).collect()}
    for row in texts:
        ids = theirs.encode(row["text"] or "", add_special_tokens=False).ids
        r = got[row["doc_id"]]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(",".join(map(str, ids))))
        assert r.decoded_sha256 == digest(theirs.decode(ids, skip_special_tokens=False))


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as cp
    from pyspark.sql import functions as F

    from verbatim.llm import mixing, near_dup, rules

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in cp.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], SF).cache())
        assert kept[-1].columns == columns
    ids = [Counter(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    assert ids[1].keys() <= ids[0].keys()
    good = rules.apply_policy(rules.ledger(kept[1]), rules.BOOK.policy("web", 2)).filter("kept")
    assert ids[2] == Counter(r.doc_id for r in good.select("doc_id").collect())
    single = near_dup.classes(kept[2]).filter("id = component")
    assert ids[3] == Counter(r.id for r in single.select("id").collect())
    plan = mixing.plan_mix(kept[3]).filter("repeats > 0")
    assert ids[4] == Counter({r.doc_id: r.repeats for r in plan.select("doc_id", "repeats").collect()})
    last = cp.STAGES[-1][1](spark, kept[4], SF)
    texts = kept[4].select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("t")).distinct()
    assert last.join(texts, "doc_id").filter("t = decoded_sha256").count() == sum(ids[4].values())
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality rules", "MinHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]


def _tables(spark, path, rows, marks):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, id string, `kept.x` string"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty texts, copies, names the stages use themselves: clean texts stay, one of each group of copies."""
    import random

    import corpus_pipeline as cp

    rng = random.Random(4)
    words = "river stone market garden letter window winter bridge morning paper music travel history animal forest".split()
    prose = lambda: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(90))
    texts = [prose() for _ in range(40)]
    row = lambda i, t, **k: (i, t, k.get("lang", "en"), k.get("source", "a"), None, 0.5, "x", None)
    rows = [row(i, t) for i, t in enumerate(texts)]
    rows += [row(100 + i, texts[i], source=None) for i in range(5)]  # exact copies from elsewhere
    rows += [row(200, None), row(201, ""), row(202, "too short"), row(203, prose(), lang=None, source=None)]
    marks = [(i, 1, 0) for i in range(30)] + [(200, None, 0), (201, 1, None)]
    sf = _tables(spark, tmp_path, rows, marks)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in cp.STAGES[:3]:
        columns = docs.columns
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
    assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == [*range(40), 203]
    out = cp.run(spark, sf).collect()
    assert {r.doc_id for r in out} <= {*range(40), 203} and all(len(r.ids) == r.n_tokens > 0 for r in out)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    assert cp.run(spark, _tables(spark, tmp_path, [], [])).count() == 0
