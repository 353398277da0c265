import random
import re
from itertools import combinations

import numpy as np
import pytest

from verbatim.llm import near_dup
from verbatim.llm.near_dup import NearDup


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(rows, n):
    """Components by union-find over all pairs."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingles(t, n))
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def made(rng):
    """Chains, dense groups, copies and lone texts; edits put many pairs near the threshold."""
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 14)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 14))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((i, rng.choice([" ", "\n", "\t "]).join(text)))
            i += 1
            if rng.random() < 0.3:
                base = text
    return rows


EDGES = [
    (1000, None), (1001, ""), (1002, " \n"), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "É x"), (1007, "é x"),
    (1008, "a b c d e f"), (1009, "A b C d e F"), (1010, "rep " * 50), (1011, "rep " * 60), (1012, "long " + " ".join(map(str, range(20_000)))),
]


@pytest.mark.parametrize("n", [4, 5])
def test_components_are_those_of_brute_force(docs, n):
    rows = made(random.Random(n)) + EDGES
    got = {r.id: (r.n_shingles, r.component) for r in near_dup.classes(docs(rows), NearDup(words=n)).collect()}
    assert got == brute(rows, n)


def test_stage_and_odd_rows(docs):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (None, "a b c d e f g"), (None, "alone"), (3, None), (4, None)]
    out = near_dup.keep_one(docs(rows))
    assert out.columns == docs(rows).columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "4", "None", "None"]
    rows = near_dup.classes(docs(rows)).collect()
    assert sorted((str(r.id), str(r.component)) for r in rows) == [("1", "1"), ("2", "1"), ("2", "1"), ("3", "3"), ("4", "4"), ("None", "1"), ("None", "None")]
    assert near_dup.classes(docs([])).count() == 0


def test_signatures_estimate_the_similarity():
    config, rng = NearDup(), np.random.default_rng(2)
    values = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    got = []
    for _ in range(30):
        rng.shuffle(values)
        a, b = np.sort(values[:900]), np.sort(values[100:])
        got.append((near_dup.min_max(a, config) == near_dup.min_max(b, config)).mean())
    assert abs(np.mean(got) - 0.8) < 0.02
    assert len(near_dup.min_max(values, config)) == 2 * config.permutations


def test_blocks_answer_what_stars_leave_open(docs, monkeypatch):
    """A family round one text, each copy edited so that most pairs are just below the threshold."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.choice([2, 3, 4])):
            text[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "ASKING", 5)
    got = {r.id: (r.n_shingles, r.component) for r in near_dup.classes(docs(rows), NearDup(words=4)).collect()}
    want = brute(rows, 4)
    assert got == want and 1 < len({c for _, c in want.values()}) < 60
