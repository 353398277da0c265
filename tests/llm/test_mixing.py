import hashlib
import math
from collections import defaultdict

from verbatim.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Water-filling by hand: share out, cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, full, rest = {s: 0.0 for s in names}, set(), share * sum(sizes.values())
    while rest > 1e-9 and len(full) < len(names):
        open_ = [s for s in names if s not in full]
        part, total = rest, sum(weight[s] for s in open_)
        rest = 0.0
        for s in open_:
            out[s] += part * weight[s] / total
            if out[s] >= most * sizes[s]:
                rest += out[s] - most * sizes[s]
                out[s] = float(most * sizes[s])
                full.add(s)
    return out


def test_targets_epochs_and_order(docs):
    rows = [(i, "w " * (1 + i * 7 % 13), f"s{i % 4}") for i in range(300)] + [(i, "w " * 9, "big") for i in range(300, 900)]
    rows += [(901, None, "s1"), (902, "", None), (903, "a # b", None), (None, "no id", "s2"), (904, "w " * 400, "long")]
    got = mixing.plan_mix(docs(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for (_, text, source) in rows:
        sizes[source] += len((text or "").split())
    want = targets(dict(sizes))
    by_id = {r.doc_id: r for r in got}
    for i, text, source in rows:
        r = by_id[i]
        assert r.size == len((text or "").split()) and r.source_size == sizes[source]
        assert math.isclose(r.target, want[source], rel_tol=1e-9)
        assert r.taken <= 2 * r.size and r.taken == r.size * r.repeats
        taken[source] += r.taken
    largest = defaultdict(int)
    for _, text, source in rows:
        largest[source] = max(largest[source], len((text or "").split()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    # Within a source the drawn documents are those with the smallest keys.
    def draw(i, n):
        bits = int(hashlib.md5(f"{i}:mix-1".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52)

    mixed = 0
    for s in ("s0", "s1", "s2", "s3", "big"):
        order = sorted((draw(i, 0), by_id[i].repeats) for i, t, source in rows if source == s and i is not None and t)
        repeats = [r for _, r in order]
        assert repeats == sorted(repeats, reverse=True)
        mixed += len(set(repeats)) == 2
    assert mixed


def test_stage_repeats_rows(docs):
    df = docs([(i, "w " * (i % 5 + 1), "ab"[i % 2]) for i in range(100)])
    plan = {r.doc_id: r.repeats for r in mixing.plan_mix(df).collect()}
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert got == {k: v for k, v in plan.items() if v}
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, out.collect()))


def test_empty_and_blank_tables(docs):
    assert mixing.plan_mix(docs([])).count() == 0
    assert mixing.apply_mix(docs([])).count() == 0
    rows = mixing.plan_mix(docs([(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2
