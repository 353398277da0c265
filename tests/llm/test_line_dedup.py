import random
from collections import Counter

from pyspark.sql import functions as F

from verbatim.llm import line_dedup as ld

BLANK = " \t\n\x0b\f\r"


def key(line):
    return line.strip(BLANK).encode().lower().decode()


def brute(texts, min_docs, min_chars=1):
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def got(df):
    return sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.text or "") for r in df.collect())


def check(docs, rows, **settings):
    s = ld.LineDedup(**settings)
    want = sorted((i or 0, *b) for (i, _), b in zip(rows, brute([t for _, t in rows], s.min_docs, s.min_chars), strict=True))
    assert got(ld.dedup_lines(docs(rows), settings=s)) == want


def test_whole_texts_against_brute_force(docs):
    rng = random.Random(5)
    lines = ["Menu", " menu\t", "MENU ", "É", "é", "", " ", "a|b", "one", "two", "three", "İ x"]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "menu"), (None, "menu"), (102, "menu"), (102, "menu"), (103, "\n".join(["long"] * 3000 + ["menu"] * 3000))]
    check(docs, rows, min_docs=5)
    check(docs, rows, min_docs=5, batches=1)
    check(docs, rows, min_docs=20, min_chars=4, batches=5, fanout=3)


def test_a_key_in_a_document_twice_counts_once(docs):
    check(docs, [(1, "x\nx"), (2, "x"), (3, "y")], min_docs=3)
    check(docs, [(1, "x\nx"), (2, "x"), (3, " X ")], min_docs=3)


def test_hot_line_is_met_in_several_places(docs, spark):
    check(docs, [(i, f"hot\nonly {i}") for i in range(300)], min_docs=10, batches=2)
    runs = ld.build_runs(docs([(i, "hot") for i in range(50)]), settings=ld.LineDedup(min_docs=2))
    assert runs.all_hot().count() == 1
    runs.close()


def test_runs_are_levelled_and_batches_leave_known_lines_out(docs):
    runs = ld.LineRuns(docs([]).sparkSession, ld.LineDedup(min_docs=2, fanout=2))
    for i in range(4):
        runs.add(docs([(i, f"same\nown {i}"), (10 + i, "same")]))
    assert [len(level) for level in runs.levels] == [0, 0, 1] and len(runs.frequent) == 3
    assert sum(f.count() for f in runs.frequent) == 1 and runs.all_frequent().count() == 1
    assert runs.levels[2][0].count() == 4
    later = ld.drop_frequent(docs([(99, "same\nnew")]), runs)
    assert [(r.text, r.n_lines, r.n_dropped) for r in later.collect()] == [("new", 2, 1)]
    runs.close()


def test_empty_table_and_clashing_names(docs, spark):
    empty = ld.dedup_lines(docs([]))
    assert empty.count() == 0
    odd = spark.createDataFrame([("a\nb", 1, "h", 3, [1])], "text string, n_lines int, gone string, `a.b` int, lines array<int>")
    out = ld.dedup_lines(odd, settings=ld.LineDedup(min_docs=1))
    assert out.columns == [*odd.columns, "_n_lines", "n_dropped"]
    assert out.select("text", "n_lines", "gone", F.col("`a.b`"), "lines", "_n_lines", "n_dropped").collect()[0][:] == ("", 1, "h", 3, [1], 2, 2)
