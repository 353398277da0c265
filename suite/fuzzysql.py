"""SQL for fuzzy keywords: the Ratcliff-Obershelp ratio as a recursive query, and the best match of every keyword list.

The ratio is twice the characters in matching blocks over the characters of both strings. The longest common block (the first in
the one string, then the first in the other) is taken, and the parts to its left and right are treated alike; the recursion
walks these parts.
"""

from __future__ import annotations

from collections.abc import Iterable

from suite import sqltext as q

_LETTERS = "abcdefghijklmnopqrstuvwxyz "


def ratio(pairs: str, name: str = "ratio") -> str:
    """CTEs up to ``name``(a, b, ratio) for the distinct pairs (a, b) of ``pairs``. Needs WITH RECURSIVE."""
    p = name
    return ",\n".join(
        [
            f"{p}_p AS (SELECT row_number() OVER () AS id, a, b FROM (SELECT DISTINCT a, b FROM {pairs} WHERE a IS NOT NULL AND b IS NOT NULL))",
            f"{p}_a AS (SELECT id, unnest(string_split(a, '')) AS c, unnest(range(1, length(a) + 1)) AS i FROM {p}_p WHERE a <> '')",
            f"{p}_b AS (SELECT id, unnest(string_split(b, '')) AS c, unnest(range(1, length(b) + 1)) AS j FROM {p}_p WHERE b <> '')",
            f"{p}_m AS (SELECT x.id, x.i, y.j, x.i - row_number() OVER (PARTITION BY x.id, x.i - y.j ORDER BY x.i) AS run "
            f"FROM {p}_a x JOIN {p}_b y ON x.id = y.id AND x.c = y.c)",
            # How far equal characters go on from (i, j).
            f"{p}_r AS (SELECT id, i, j, count(*) OVER (PARTITION BY id, i - j, run ORDER BY i DESC) AS n FROM {p}_m)",
            f"{p}_f(id, a1, a2, b1, b2, size) AS (SELECT id, 1::BIGINT, length(a)::BIGINT + 1, 1::BIGINT, length(b)::BIGINT + 1, 0::BIGINT FROM {p}_p "
            "UNION ALL SELECT id, s.a1, s.a2, s.b1, s.b2, s.size FROM (SELECT id, unnest(["
            "{'a1': a1, 'a2': m.i, 'b1': b1, 'b2': m.j, 'size': m.n}, "
            "{'a1': m.i + m.n, 'a2': a2, 'b1': m.j + m.n, 'b2': b2, 'size': 0::BIGINT}]) AS s FROM ("
            "SELECT id, a1, a2, b1, b2, {'n': -g.n, 'i': g.i, 'j': g.j} AS m FROM ("
            "SELECT f.id, f.a1, f.a2, f.b1, f.b2, min({'n': -least(r.n, f.a2 - r.i, f.b2 - r.j), 'i': r.i, 'j': r.j}) AS g "
            f"FROM {p}_f f JOIN {p}_r r ON r.id = f.id AND r.i >= f.a1 AND r.i < f.a2 AND r.j >= f.b1 AND r.j < f.b2 GROUP BY ALL))))",
            f"{name} AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0 ELSE 2.0 * s.size / (length(a) + length(b)) END::DOUBLE AS ratio "
            f"FROM {p}_p JOIN (SELECT id, sum(size)::DOUBLE AS size FROM {p}_f GROUP BY id) s USING (id))",
        ]
    )


def lists(texts: str, slots: Iterable[tuple[int, Iterable[str]]], threshold: float) -> str:
    """CTEs up to ``fuzzy``(text, slot, score, evidence): the best match of each keyword list in the distinct texts of ``texts``."""
    rows = [(slot, place, kw, " ".join(kw.lower().split())) for slot, kws in slots for place, kw in enumerate(kws)]
    floor = repr(threshold - 0.05)
    letters = ", ".join(f"length(t) - length(replace(t, '{c}', '')) AS c{i}" for i, c in enumerate(_LETTERS))
    common = " + ".join(f"least(x.c{i}, y.c{i})" for i in range(len(_LETTERS)))
    rest = " + ".join(f"c{i}" for i in range(len(_LETTERS)))
    related = "len(list_filter(t.w, lambda x: contains(x, k) OR contains(k, x))) > 0"
    return ",\n".join(
        [
            q.values_table("fz_kws", "slot, place, raw, norm", rows),
            "fz_k AS (SELECT *, string_split(norm, ' ') AS words, len(string_split(norm, ' ')) AS width FROM fz_kws)",
            f"fz_t AS (SELECT text, n, string_split(n, ' ') AS w FROM (SELECT DISTINCT text, {q.collapse(q.strip('lower(text)'))} AS n FROM {texts} "
            "WHERE text IS NOT NULL) WHERE n <> '')",
            "fz_win AS (SELECT text, width, i AS pos, array_to_string(w[i:i + width - 1], ' ') AS win FROM (SELECT text, w, width, "
            "unnest(range(1, len(w) - width + 2)) AS i FROM fz_t, (SELECT DISTINCT width FROM fz_k WHERE width > 1)))",
            f"fz_c AS (SELECT t, width, {letters} FROM (SELECT win AS t, width FROM fz_win UNION SELECT norm, width FROM fz_k WHERE width > 1))",
            f"fz_l AS (SELECT *, length(t) - ({rest}) AS c FROM fz_c)",
            # No ratio is above what the shared letters allow.
            "fz_pairs AS (SELECT x.t AS a, y.t AS b FROM fz_l x JOIN fz_l y ON x.width = y.width "
            f"AND 2 * ({common} + least(x.c, y.c)) >= {floor} * (length(x.t) + length(y.t)) - 1e-9 "
            "WHERE x.t IN (SELECT norm FROM fz_k) AND y.t IN (SELECT win FROM fz_win))",
            ratio("fz_pairs", "fz_ratio"),
            f"fz_close AS (SELECT w.text, r.a AS norm, w.width, w.pos, w.win, r.ratio FROM fz_win w JOIN fz_ratio r ON r.b = w.win WHERE r.ratio >= {floor})",
            "fz_best AS (SELECT text, norm, min({'p': pos, 'r': ratio, 'w': win}) "
            f"FILTER (ratio >= {threshold!r}) AS hit, min({{'r': -ratio, 'p': pos, 'w': win}}) AS best FROM fz_close GROUP BY text, norm)",
            "fz_scored AS (SELECT t.text, k.slot, k.place, CASE WHEN contains(t.n, k.norm) THEN {'s': 1.0::DOUBLE, 'e': k.raw} "
            "WHEN b.hit IS NOT NULL THEN {'s': b.hit.r, 'e': b.hit.w} "
            f"WHEN k.width > 1 AND len(list_filter(k.words, lambda k: {related})) = k.width THEN {{'s': 0.8::DOUBLE, 'e': 'scattered:' || k.norm}} "
            "WHEN b.best IS NOT NULL THEN {'s': -b.best.r, 'e': b.best.w} END AS m "
            "FROM fz_t t CROSS JOIN fz_k k LEFT JOIN fz_best b ON b.text = t.text AND b.norm = k.norm)",
            "fuzzy AS (SELECT text, slot, m.s AS score, m.e AS evidence FROM fz_scored WHERE m IS NOT NULL "
            "QUALIFY row_number() OVER (PARTITION BY text, slot ORDER BY m.s DESC, place) = 1)",
        ]
    )
