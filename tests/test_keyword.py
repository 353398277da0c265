import random
import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from suite import fixture as fx
from verbatim.operators import fuzzy
from verbatim.operators import keyword as kw
from verbatim.settings import KeywordSettings

INDEX = fx.keyword_index()
SCHEMA = "ID long, TextColumn string, text string, is_meaningful boolean, response_detail string"


def long_rows(spark, texts, column="Free_Text_1"):
    return spark.createDataFrame([(i, column, t, True, "Detailed response") for i, t in enumerate(texts)], SCHEMA)


def random_texts(n, seed=7):
    rng = random.Random(seed)
    words = [w for s in INDEX.subthemes for t in (*s.phrase_terms, *s.token_terms) for w in re.findall(r"\w+", t)]
    seps = [" ", " ", " ", "  ", ", ", "-", "'", " – ", "_", "\n", "! "]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(1, 12)):
            w = rng.choice(words)
            if rng.random() < 0.2:
                w = w[:-1] + rng.choice("aeé")
            text += (w.upper() if rng.random() < 0.1 else w) + rng.choice(seps)
        out.append(text)
    return out


def test_three_exact_paths_agree(spark):
    texts = random_texts(300) + ["", "pay-by-phone", "xpay-by-phone", "long – très long", "LATE delivery", "late\ndelivery"]
    df = long_rows(spark, texts)
    hits = lambda d: {r["ID"]: sorted(tuple(h) for h in r["_hits"]) for r in d.select("ID", "_hits").collect()}
    by_row = hits(kw.add_exact_hits(df, F.col("text"), INDEX))
    by_pattern = hits(kw.add_exact_hits_by_pattern(df, F.col("text"), INDEX))
    assert by_row == by_pattern
    assert sum(map(len, by_row.values())) > 100
    cfg = KeywordSettings(use_fuzzy=False, min_accept_score=0.1, top_k=50)
    rows = lambda m: sorted(map(str, kw.add_matches(df, INDEX, cfg, exact=m).select("ID", "matches").collect()))
    assert rows("row") == rows("table") == rows("pattern")
    shards = lambda n: hits(kw.add_exact_hits_by_table(df, F.col("text"), INDEX, shard_bytes=n))
    assert by_row == shards(200) == shards(1 << 20)


def large_index(size=8200):
    words = [f"w{i} x{i % 97}" if i % 3 else f"v{i}" for i in range(size)]
    themes = {"Delivery": {"subthemes": [{"name": "Late", "keywords_phrases": ["late delivery", *words[::2]]}]},
              "Price": {"subthemes": [{"name": "Good value", "keywords_phrases": ["great prices", *words[1::2]]}]}}
    return kw.KeywordIndex.from_themes({"themes": themes})


def test_a_large_library_keeps_rows_apart(spark):
    """Rows with equal and with null ids get their own matches, in the plan and in a broadcast table alike."""
    index = large_index()
    assert index.n_keywords() > kw.MAX_LITERAL_KEYWORDS
    texts = [(1, "late delivery"), (1, "great prices"), (None, "late delivery"), (2, None), (3, "w4 x4 and v3, w4  x4")]
    df = spark.createDataFrame([(i, "Free_Text_1", t, True, None) for i, t in texts], SCHEMA)
    cfg = KeywordSettings(use_fuzzy=False, top_k=5)
    found = {m: sorted(str((r["ID"], r["text"], [x["subtheme"] for x in r["matches"] or []])) for r in kw.add_matches(df, index, cfg, exact=m).collect()) for m in ("auto", "table", "row")}
    assert found["auto"] == found["table"] == found["row"]
    assert "(1, 'great prices', ['Good value'])" in found["auto"] and "(None, 'late delivery', ['Late'])" in found["auto"]


def test_a_large_library_runs_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "Free_Text_1", "late delivery" if i % 2 else "v3", True, None) for i in range(6)], SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = kw.add_best_match(stream, large_index(), KeywordSettings(use_fuzzy=False)).select("ID", "match.subtheme")
    query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    query.trigger(availableNow=True).start().awaitTermination(120)
    assert {r["subtheme"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"Late", "Good value"}


# A plain restatement of the matching rules, for comparison on small inputs.


def norm(t):
    return re.sub(r"\s+", " ", t.lower().strip())


def brute_fuzzy(text, keyword, threshold):
    t, k = norm(text), norm(keyword)
    if not t or not k:
        return None
    if k in t:
        return 1.0, keyword
    words, parts = t.split(), k.split()
    if len(parts) > 1:
        windows = [" ".join(words[i:i + len(parts)]) for i in range(len(words) - len(parts) + 1)]
        ratios = [SequenceMatcher(None, k, w).ratio() for w in windows]
        for r, w in zip(ratios, windows, strict=True):
            if r >= threshold:
                return r, w
        if all(any(p in w or w in p for w in words) for p in parts):
            return 0.80, "scattered:" + " ".join(parts)
        if ratios and max(ratios) >= threshold - 0.05 and max(ratios) > 0:
            return max(ratios), windows[ratios.index(max(ratios))]
    return None


def brute_best(text, keywords, threshold):
    best = (0.0, "")
    for k in keywords:
        found = brute_fuzzy(text, k, threshold)
        if found and found[0] > best[0]:
            best = found
    return best if best[0] > 0 else None


def brute_matches(text, column, cfg):
    short = cfg.allow_token_fallback and len(text.strip()) <= cfg.max_token_match_length
    out = []

    def exact(terms):
        return next((t for t in terms if re.search(rf"\b{re.escape(t)}\b", text, re.IGNORECASE)), None)

    for pos, s in enumerate(INDEX.subthemes):
        found = None
        if short and s.token_terms:
            hit = exact(s.token_terms)
            if hit:
                found = (0.95, "token_short_text", hit)
            elif cfg.use_fuzzy and (b := brute_best(text, s.token_terms, cfg.fuzzy_threshold)):
                found = (b[0], "fuzzy_token", b[1])
        if cfg.phrase_first:
            if found is None:
                hit = exact(s.phrase_terms)
                if hit:
                    found = (1.0, "exact", hit)
                elif cfg.use_fuzzy and (b := brute_best(text, s.phrase_terms, cfg.fuzzy_threshold)):
                    found = (b[0], "fuzzy", b[1])
        else:
            both = s.phrase_terms + s.token_terms
            hit = exact(both)
            if hit:
                found = (1.0, "exact", hit)
            elif cfg.use_fuzzy and (b := brute_best(text, both, cfg.fuzzy_threshold)):
                found = (b[0], "fuzzy", b[1])
        if found is None:
            continue
        score = found[0]
        if s.cols:
            score += cfg.column_bonus if column in s.cols else -(999.0 if cfg.strict_columns else cfg.column_penalty)
        if cfg.prefer_exact and found[1] == "exact":
            score += 0.02
        if score >= cfg.min_accept_score:
            out.append((round(score, 9), pos, found[1], found[2]))
    out.sort(key=lambda m: -m[0])
    return out[:cfg.top_k]


def check_against_brute_force(spark, cfg, texts, column):
    df = kw.add_matches(long_rows(spark, texts, column), INDEX, cfg)
    names = [(s.theme, s.subtheme) for s in INDEX.subthemes]
    for r in df.collect():
        got = [(round(m["score"], 9), names.index((m["theme"], m["subtheme"])), m["method"], m["evidence"])
               for m in r["matches"]]
        assert got == brute_matches(r["text"], column, cfg), r["text"]


TEXTS = [t for t in fx.BANK if t and t.strip()] + random_texts(120, seed=3)


def test_fuzzy_matches_brute_force(spark):
    check_against_brute_force(spark, KeywordSettings(), TEXTS, "Free_Text_1")


def test_shipped_thresholds_match_brute_force(spark):
    cfg = KeywordSettings(fuzzy_threshold=0.7, min_accept_score=0.7, top_k=5, column_penalty=0.1,
                          allow_token_fallback=False)
    check_against_brute_force(spark, cfg, TEXTS, "Free_Text_2")


def test_combined_lists_match_brute_force(spark):
    cfg = KeywordSettings(phrase_first=False, strict_columns=True, min_accept_score=0.5, top_k=4)
    check_against_brute_force(spark, cfg, TEXTS, "Free_Text_3")


def test_dismissed_and_unmatched_rows(spark):
    rows = [
        (1, "Free_Text_1", "no", False, "No"), (2, "Free_Text_1", "no", False, ""), (3, "Free_Text_1", "ok", None, None),
        (4, "Free_Text_1", "late delivery", None, None), (5, "Free_Text_1", "unrelated words here", True, "Detailed response"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["ID"]: r for r in kw.assign_keyword(df, INDEX, KeywordSettings(use_fuzzy=False)).collect()}
    assert (got[1]["theme"], got[1]["subtheme"], got[1]["reason"]) == ("Brief response", "No", "dismissed:No")
    assert (got[2]["match_method"], got[2]["reason"]) == ("none", "no_match")
    assert got[3]["reason"] == "no_match" and got[3]["is_meaningful"] is None
    assert got[4]["theme"] == "Delivery" and got[4]["is_meaningful"] is None
    assert got[5]["reason"] == "no_match"
    kept = kw.assign_keyword(df, INDEX, KeywordSettings(use_fuzzy=False, include_dismissed=False))
    assert sorted(r["ID"] for r in kept.collect()) == [3, 4, 5]


def test_row_order_changes_nothing(spark):
    df = long_rows(spark, TEXTS)
    a = kw.assign_keyword(df, INDEX).collect()
    b = kw.assign_keyword(df.orderBy(F.desc("ID")).repartition(3), INDEX).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_single_label_and_order(spark):
    df = long_rows(spark, ["great prices and quick refunds with late delivery"])
    multi = kw.assign_keyword(df, INDEX, KeywordSettings(use_fuzzy=False)).first()
    single = kw.assign_keyword(df, INDEX, KeywordSettings(use_fuzzy=False, multi_label=False)).first()
    assert multi["theme"] == "Delivery | Price | Service" and single["theme"] == "Delivery"


def test_index_table_round_trip(spark):
    assert kw.KeywordIndex.from_df(INDEX.to_df(spark)) == INDEX


def test_automaton_finds_every_term():
    from verbatim.operators.fuzzy import Automaton, term_parts

    rng = random.Random(3)
    for _ in range(300):
        terms = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 12))]
        text = "".join(rng.choice("abc é") for _ in range(rng.randint(0, 40)))
        assert Automaton(terms).found(text) == [i for i, t in enumerate(terms) if t and t in text]
    assert [list(r) for r in term_parts(["aa", "b", "ccccc", "d"], 3)] == [[0, 1], [2], [3]]


def test_bounds_never_exclude_a_ratio():
    """The letter masks and the common subsequence bound the matching characters from above."""
    import numpy as np
    import pyarrow as pa

    from verbatim.operators import fuzzy

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aabcdeé日 ") for _ in range(rng.randint(1, 30))).strip() or "x"
    pairs = [(word(), word()) for _ in range(600)] + [("aaaaaaa bbbbbb", "aaaaaab bbbbba")]
    matched = np.array([round(SequenceMatcher(None, a, b).ratio() * (len(a) + len(b)) / 2) for a, b in pairs])
    masks = []
    for side in (0, 1):
        counts = fuzzy.letter_counts(pa.array([p[side] for p in pairs]))
        assert counts.sum(axis=1).tolist() == [len(p[side]) for p in pairs]
        masks.append(fuzzy.letter_masks(counts))
    shared = sum(np.bitwise_count(masks[0][i] & masks[1][i]).astype(int) for i in (0, 1)) + np.minimum(masks[0][2], masks[1][2])
    longest = fuzzy._common([a for a, _ in pairs], [b for _, b in pairs])
    assert (matched <= longest).all() and (longest <= shared).all()
    for floor in (0.3, 0.6, 0.73):
        want = [r if (r := SequenceMatcher(None, a, b).ratio()) >= floor else None for a, b in pairs]
        assert fuzzy.ratios([a for a, _ in pairs], [b for _, b in pairs], floor) == want


def test_large_libraries_match_alike(spark, monkeypatch):
    """Several automata and keywords dealt into lots give the same matches."""
    from verbatim.operators import fuzzy

    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS[:60])], "ID int, t string")
    slots = [fuzzy.FuzzySlot(i, s.phrase_terms + s.token_terms) for i, s in enumerate(INDEX.subthemes)]
    run = lambda: sorted(map(str, fuzzy.add_fuzzy_matches(texts, "t", slots, 0.78, "m").collect()))
    want = run()
    monkeypatch.setattr(fuzzy, "BROADCAST_KEYWORDS", 7)
    monkeypatch.setattr(fuzzy, "held_rows", lambda *a, f=fuzzy.held_rows, **k: f(*a, **k))
    monkeypatch.setattr(fuzzy.term_parts, "__defaults__", (60,))
    assert run() == want and any("Row(slot" in r for r in want)


def test_windows_of_long_texts_are_made_in_runs(spark, monkeypatch):
    words = pa.array([["a", "b", "c"], None, [], ["d"] * 7, ["e", "f"], ["g", "h"], ["i"]])
    parts = list(fuzzy.word_runs(words, 4))
    assert [len(p) for p in parts] == [3, 1, 2, 1]
    assert pa.concat_arrays(parts).to_pylist() == words.to_pylist()
    whole = fuzzy.windows_of(words, [1, 2]).to_pylist()
    assert [w for p in parts for w in fuzzy.windows_of(p, [1, 2]).to_pylist()] == whole
    monkeypatch.setattr(fuzzy, "WINDOW_WORDS", 4)
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words.to_pylist())], "i int, w array<string>").coalesce(1)
    got = df.select("i", fuzzy.word_windows(F.col("w"), [1, 2]).alias("v")).orderBy("i").collect()
    assert [[w.asDict() for w in r["v"]] for r in got] == whole


def test_rows_without_text_are_dealt_to_all_tasks(spark):
    rows = spark.range(400).select("id", F.when(F.col("id") < 4, "late delivry again").alias("t"))
    slots = [fuzzy.FuzzySlot(0, ("late delivery",))]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = fuzzy.add_fuzzy_matches(rows, "t", slots, 0.78)
        parts = [[r for r in p if r["t"] is None] for p in out.rdd.glom().collect()]
        found = {r["id"]: r["_fuzzy"] for r in out.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(map(len, parts)) == 396 and max(map(len, parts)) < 200
    assert len(found) == 400 and all((found[i] is None) == (i >= 4) for i in found)
