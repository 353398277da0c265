import random
import re
from collections import Counter, defaultdict

from verbatim.llm import source_audit as sa

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, v int, `value` string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, "x", 1, 2, "y") for i, (t, la, s) in enumerate(rows)], SCHEMA)


def brute(rows, min_docs, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    texts = [([fold(x) for x in TERM.findall(t)], la, s) for t, la, s in rows]
    out = []
    for la in {r[1] for r in texts}:
        mine = [(t, s) for t, x, s in texts if x == la]
        df = Counter(w for t, _ in mine for w in set(t))
        kept = sorted(w for w, n in df.items() if n >= min_docs)
        v = len(kept)
        counts = defaultdict(Counter)
        for t, s in mine:
            for name in (("group", s), ("lang",)):
                counts[name].update(w for w in t if df[w] >= min_docs)
            counts["group", s] = counts["group", s]
        shares = {g: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * v) for w in kept} for g, c in counts.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        sources = sorted({s for _, s in mine})
        for s in sources:
            p = shares["group", s]
            pairs = sorted((-sum(f(p[w], shares["group", o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            out += [(la, s, "pair", o, -x, r) for r, (x, _, o) in enumerate(pairs, 1)]
            q = shares["lang",]
            above = sorted((-f(p[w], q[w]), w.encode(), w) for w in kept if counts["group", s][w] > 0 and p[w] > q[w])
            out += [(la, s, "term", w, -x, r) for r, (x, _, w) in enumerate(above[:top], 1)]
    return sorted(out)


def check(spark, rows, **settings):
    s = sa.Audit(**settings)
    got = sa.audit(table(spark, rows), settings=s)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, s.min_docs, s.top_terms)


def made(n, seed):
    rng = random.Random(seed)
    words = ["Alpha", "alpha", "beta", "çédille", "ÉCOLE", "école", "x1y", "don't", "日本", "a", "zz_top", "rare"]
    out = []
    for _ in range(n):
        s = rng.choice(["s1", "s2", "s3", None, ""])
        pool = words[: 6 + (ord((s or "x")[-1]) % 2) * 6] if s else words
        out.append((" ".join(rng.choices(pool, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), s))
    return out


def test_against_brute_force_with_copies(spark):
    rows = made(150, 1)
    rows += [rows[3]] * 40 + [(rows[5][0], "en", s) for s in ("s1", "s2", "s9") for _ in range(7)]
    check(spark, rows)
    check(spark, rows, min_docs=3, top_terms=2)


def test_languages_without_kept_terms_and_single_sources(spark):
    check(spark, [("one two", "en", "a"), ("three", "en", "b"), (None, None, None), ("", "fr", "b"), ("4 5 6", "fr", "c")])
    check(spark, [(None, None, None)] * 3, min_docs=1)
    check(spark, [], min_docs=1)


def test_a_very_long_text_and_large_counts(spark):
    check(spark, [("word " * 60_000 + "other", "en", "a"), ("other word", "en", "b"), ("other", "en", "b")], min_docs=1)


def test_shares_do_not_overflow(spark):
    from pyspark.sql import functions as F

    big = 4_000_000_000_000
    row = spark.range(1).select(sa.share(F.lit(big), F.lit(3 * big), F.lit(7).cast("long")).alias("p"), sa.share(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")).alias("one"))
    assert row.first()[:] == (1 + 1_000_000_000 * (big + 2) // (3 * big + 14), 1_000_000_001)
