import random
import re

from verbatim.llm import rules

FIXED = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "a b"), (6, "a a a a"), (7, "a b c a b c a b c"), (8, "# $%& |<> *"),
    (9, "x y\nx y\n\nx y\n \n"), (9, "x y\nx y\n\nx y\n \n"), (None, "null id"), (10, "é ü b 　 c"), (11, "w " * 30_000),
    (12, "ONE TWO THREE " + " ".join(f"W{i}" for i in range(60))), (13, " ".join(f"v{i}" for i in range(60))),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = {}, set()
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(p + j for p in places for j in range(3))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_are_those_of_brute_force(docs):
    rng = random.Random(4)
    made = [(100 + i, " ".join(rng.choice("abcd\n") for _ in range(rng.randint(0, 40)))) for i in range(200)]
    got = rules.ledger(docs(FIXED + made)).collect()
    want = sorted((str(k), *brute(t)) for k, t in FIXED + made)
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == want


def test_policies_read_the_same_ledger(docs):
    text = " ".join(f"w{i}" for i in range(60))
    table = rules.ledger(docs([(1, text), (2, text.upper()), (3, "short"), (4, (text + "\n") * 2), (5, "# " * 10 + text)]))
    kept = lambda v: {r.doc_id for r in rules.apply_policy(table, rules.BOOK.policy("web", v)).filter("kept").collect()}
    assert kept(1) == {1} and kept(2) == {1}
    rows = {r.rule: r for r in rules.ablation(table, rules.BOOK.policy("web", 2)).collect()}
    assert (rows["too_short"].fail, rows["too_short"].fail_alone, rows["too_short"].kept_without) == (1, 1, 2)
    assert rows["shouting"].fail_alone == 1 and rows["symbols"].kept_without == 2
    assert rows["repeats_itself"].seen_with & rules.BOOK.bit("repeated_lines")


def test_stage_keeps_rows_as_they_came(docs, spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = docs([(1, text), (1, text), (2, None), (None, text)])
    out = rules.keep_good(df, rules.BOOK.policy("web", 2))
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "1", "None"]
    assert rules.keep_good(docs([]), rules.BOOK.policy("web", 2)).count() == 0
    assert rules.ablation(rules.ledger(docs([])), rules.BOOK.policy("web", 2)).count() == 0


def test_main_path_is_native(docs):
    plan = rules.ledger(docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_a_filter_on_the_verdict_costs_no_more_than_the_ledger(docs):
    import time

    text = " ".join(f"w{i}" for i in range(40))
    table = rules.apply_policy(rules.ledger(docs([(i, f"{text} {text} {i}") for i in range(50)])), rules.BOOK.policy("web", 2))

    def seconds(df):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(table)
    assert seconds(table.filter("kept")) < 2 * seconds(table) + 1
    assert seconds(table.filter("n_repeat_words > 5 and failed = 0")) < 2 * seconds(table) + 1
