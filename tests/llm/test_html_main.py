import numpy as np
import pytest
from pyspark.sql import functions as F

from verbatim.llm import html_main
from verbatim.llm.html_main import Settings

PROSE = ["The river rose slowly over the fields.", "Nobody had seen such water, not in years.", "By noon the road was gone; the bridge held.", "People waited, and counted the hours."] * 10


@pytest.fixture(scope="module")
def forest():
    return html_main.train([f"<p>{' '.join(PROSE)}</p>"], Settings(pages=700, rounds=40))


def text_of(forest, html):
    return html_main.extract([html_main.parse(html)], forest)[0]


def test_article_without_what_is_round_it(forest):
    p = " ".join(PROSE[:4])
    html = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{x:1}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href=/a>Menu one</a></li><li><a href=/b>Menu two</a></li></ul></nav><!-- ad --><div class="ad">Buy it now.</div>
    <article><h1>A  title</h1><p><b>{p}<br>Next&nbsp;line &amp; more &#x41;.</b><p>Second
    paragraph, <a href=x>with a link</a>, goes on. {p}</p></article>
    <div id="comments"><h3>Comments</h3><div class="comment"><b>Al</b><p>I do not agree.</p></div></div>
    <aside><h3>Related</h3><ul><li><a href=1>Other one</a></li></ul></aside>
    <form><label>Mail</label><input name=m><button>Send</button></form><footer>&copy; all rights</footer></body></html>"""
    want = f"A title\n\n{p} Next line & more A.\n\nSecond paragraph, with a link, goes on. {p}"
    assert text_of(forest, html) == want


def test_made_pages(forest):
    maker = html_main.Maker(PROSE, np.random.default_rng(77))
    kept = wrong = missed = 0
    for _ in range(150):
        page = html_main.parse(maker.page())
        y = html_main.labelled(page) > 0
        x, parent, _ = html_main.features([page])
        keep = html_main.decode(forest.log_odds(forest.binned(x)), parent)
        size = np.array([len(t.strip()) for t in page.texts])
        kept, wrong, missed = kept + size[keep & y].sum(), wrong + size[keep & ~y].sum(), missed + size[~keep & y].sum()
    assert kept / (kept + wrong) > 0.95 and kept / (kept + missed) > 0.95


def test_decoding_is_the_best_labelling_without_contradiction():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 11))
        parent = np.array([-1] + [int(rng.integers(i)) for i in range(1, n)])
        odds = rng.normal(size=n)
        best = max(
            sum(o for o, k in zip(odds, bits, strict=True) if k)
            for m in range(1 << n)
            if all(not bits[i] or parent[i] < 0 or bits[parent[i]] for bits in [[m >> j & 1 for j in range(n)]] for i in range(n))
            for bits in [[m >> j & 1 for j in range(n)]]
        )
        keep = html_main.decode(odds, parent)
        assert all(parent[i] < 0 or not keep[i] or keep[parent[i]] for i in range(n))
        assert abs(odds[keep].sum() - best) < 1e-9


@pytest.mark.parametrize("html", [None, "", "   ", "<", "<<<>>>", "plain", "<p", "</p></div>", "<!--", "<script>x", "<div " * 3000, "<b>" * 3000 + "x", "&#0; &bogus; &amp", "<a href='>'>q</a>", "\0<p>\ud83d"[:3]])
def test_broken_pages_do_not_crash(forest, html):
    assert isinstance(text_of(forest, html or ""), str)


def test_parser_repairs():
    page = html_main.parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p>e<div>f</div><table><tr><td>g<td>h<tr><td>i</table>")
    keep = [True] * len(page.tags)
    assert html_main.main_text(page, keep) == "a\n\nb\n\nc\n\nd\n\ne\n\nf\n\ng\n\nh\n\ni"
    page = html_main.parse("x <b>y</b>z<br>q <TITLE>no</TITLE><textarea><p>no</textarea> w<![CDATA[v]]>")
    assert html_main.main_text(page, [True] * len(page.tags)) == "xyz q wv".replace("xyz", "x yz")


def test_columns(spark, forest):
    long = "<article>" + "".join(f"<p>{' '.join(PROSE[:3])} {i}</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", None, "t", 1), (2, "u", "", "t", 1), (3, "u", long, "t", 1), (3, "u", long, "t", 1), (None, None, "<article><p>x", "t", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = df.select("page_id", "text", html_main.extracted(F.col("html"), forest, spark).alias("main")).collect()
    by = {r.page_id: r.main for r in got}
    assert by[1] == by[2] == "" and by[3].count("\n\n") == 2999 and len(got) == 5
    fitted = html_main.fit(df.limit(0), Settings(pages=60, rounds=5))
    assert df.limit(0).select(html_main.extracted(F.col("html"), fitted, spark)).count() == 0


def test_formulas_and_drawings_are_text(forest):
    p = " ".join(PROSE[:4])
    formula = "<math><mi>E</mi><mo>=</mo><mi>m</mi><annotation encoding='application/x-tex'>E=m</annotation></math>"
    drawing = "<svg><title>No</title><style>x</style><path d='M0'/><text>Fig one</text></svg>"
    html = f"<html><body><article><h1>A title</h1><p>{p} So {formula} holds. {p}</p><p>{p} {drawing} {p}</p></article></body></html>"
    assert f"{p} So E=m holds. {p}" in text_of(forest, html)
    texts = html_main.parse(html).texts
    assert "Fig one" in texts and not {"No", "x"}.intersection(texts)
    # A block ends a formula that is not closed.
    page = html_main.parse("<div>a <math><mi>b</mi><p>c</p><p>d</p></div>")
    assert [t for t in page.texts if t] == ["a b", "c", "d"] and page.tags.count("p") == 2


def test_text_runs_against_a_walk_of_the_tree():
    """Random trees and random kept runs: marks at both edges of every block, then split, against the single pass."""
    rng = np.random.default_rng(9)
    tags = ["div", "p", "b", "i", "a", "section", "li", "span"]

    def made(depth):
        out = []
        for _ in range(int(rng.integers(1, 5))):
            pick = rng.integers(8)
            if pick < 4 or depth > 4:
                out.append(f"{' ' * int(rng.integers(2))}w{rng.integers(99)}{' ' * int(rng.integers(2))}")
            elif pick == 4:
                out.append("<br>")
            else:
                tag = tags[int(rng.integers(len(tags)))]
                out.append(f"<{tag}>{made(depth + 1)}</{tag}>")
        return "".join(out)

    for _ in range(200):
        page = html_main.parse(f"<html><body>{made(0)}</body></html>")
        keep = (rng.random(len(page.tags)) < 0.7).tolist()
        below = {i: [j for j, up in enumerate(page.parents) if up == i] for i in range(-1, len(page.tags))}

        def walk(i):
            tag = page.tags[i]
            if tag == "br":
                return " "
            if tag == " " or tag == html_main.TEXT:
                return page.texts[i] if tag == " " or keep[i] else ""
            inside = "".join(map(walk, below[i]))
            return f"\0{inside}\0" if tag in html_main.BLOCKS else inside

        runs = [" ".join(r.split()) for r in "".join(map(walk, below[-1])).split("\0")]
        assert html_main.main_text(page, keep) == "\n\n".join(r for r in runs if r)
