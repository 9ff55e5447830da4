import random

import numpy as np
import pytest

from treeloom.llm import boosting, dom
from treeloom.llm import html_extraction as ext


def page(rng, i, body=None):
    words = "stone river light garden winter paper silver mountain letter window".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    main = [text(rng.randrange(1, 40)) for _ in range(rng.randrange(1, 8))]
    title = text(5)
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rng.sample(words, 5))
    html = (
        f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body><nav><ul>{nav}</ul></nav><!-- ad -->'
        f'<div class="ad">{text(6)}</div><article><h1>{title}</h1>' + "".join(f"<p>{m}</p>" for m in main) + f"</article><footer>&copy; {text(4)}</footer></body></html>"
    )
    return html, "\n".join([title, *main])


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(0)
    made = [page(rng, i) for i in range(240)]
    rows = [(i, f"http://x/{i}", h, "old") for i, (h, _) in enumerate(made)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    return df, dict(enumerate(t for _, t in made)), ext.fit(df)


def test_given_layout(spark, fitted):
    df, want, trees = fitted
    got = {r.page_id: r.text for r in ext.extract(df, trees).collect()}
    assert sum(got[i] == t for i, t in want.items()) >= 0.99 * len(want)


def test_other_layouts(fitted):
    trees = fitted[2]
    para = "A paragraph of the story that is long enough to be one, with commas, and a second clause. It goes on."
    html = (
        f'<html><body><header><h2>Site</h2><p>The tag line</p></header><div class="menu"><ul><li><a href="x">one</a></li></ul></div><div id="content"><h1>Title</h1><p>{para}</p><p>{para} &amp; more&nbsp;text</p>'
        '<div class="comments"><p>Great story, thanks a lot for it all.</p></div></div><aside class="sidebar"><p>Related stories here.</p></aside><div class="cookie-notice">We use cookies.</div>'
        '<form><label>Name</label><input></form><div class="footer">Copyright</div></body></html>'
    )
    lines = ext.extracted(trees, [html])[0].split("\n")
    assert lines[-2:] == [para, f"{para} & more text"] and lines[:-2] in ([], ["Title"])


def test_a_table_of_long_pages_alone(spark):
    rng = random.Random(5)
    made = []
    for i in range(20):
        paragraphs = ["A paragraph " + " ".join(rng.choice(["stone", "river", "garden", "winter"]) for _ in range(40)) + "." for _ in range(220)]
        script = "<script>" + "var x = 1; " * (6_000 if i % 2 else 0) + "</script>"
        made.append((f"<html><head>{script}</head><body><nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>Title {i}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</article><footer>imprint</footer></body></html>", "\n".join([f"Title {i}", *paragraphs])))
    assert min(len(h) for h, _ in made) > ext.SAMPLE_CHARS
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(made)], "page_id long, html string")
    got = {r.page_id: r.text for r in ext.extract(df, ext.fit(df)).collect()}
    assert [i for i, (_, t) in enumerate(made) if got[i] != t] == []


def test_edges(spark, fitted):
    trees = fitted[2]
    given = [None, "", "   ", "<", "<div", "<!-- open", "<script>x", "</p></div>", "plain", "<p>" * 3000 + "deep", "<div>" * 2000 + "x", '<a href="unclosed>text', "<p>\x00</p>", "&#x110000;&bad;"]
    out = ext.extracted(trees, given)
    assert out[:4][:3] == ["", "", ""] and all(isinstance(x, str) for x in out)
    df = spark.createDataFrame([(None, None, None), (1, None, "<p>x")], "page_id long, url string, html string")
    assert ext.extract(df, trees).count() == 2 and ext.extract(df.limit(0), trees).count() == 0
    nothing = ext.fit(df.limit(0))
    found = ext.extracted(nothing, ["<html><body><nav><a href='/'>home</a></nav><article><h1>Some title</h1><p>A paragraph of the story, with words.</p></article></body></html>"])[0].split("\n")
    assert found[-1] == "A paragraph of the story, with words." and found[:-1] in ([], ["Some title"])
    assert ext.extracted(nothing, ["", "<script>x</script>"]) == ["", ""]


def test_kept_nodes_have_kept_parents(fitted):
    nodes = ext.Nodes([dom.parse(r.html) for r in fitted[0].limit(20).collect()])
    keep = nodes.decoded(np.random.default_rng(0).normal(0, 3, len(nodes.parent)))
    assert (keep[nodes.parent] | ~keep | nodes.root).all() and not keep[nodes.hidden].any()


def test_decoding_is_the_best_choice():
    p = dom.Page()
    for parent in (-1, 0, 1, 1, 0, 4):
        p.add(parent, "div")
    nodes = ext.Nodes([p])
    for seed in range(20):
        odds = np.random.default_rng(seed).normal(0, 2, 6)
        worth = nodes.smoothed(odds)
        best = max((sum(worth[i] for i in range(6) if m >> i & 1), m) for m in range(64) if all(not m >> i & 1 or p.parent[i] < 0 or m >> p.parent[i] & 1 for i in range(6)))
        assert nodes.decoded(odds).tolist() == [bool(best[1] >> i & 1) for i in range(6)]


def test_parser():
    p = dom.parse("<p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table>g<br>h")
    texts = [(p.text[i], p.tag[p.parent[i]], p.block[i]) for i in range(len(p.tag)) if p.tag[i] is dom.TEXT]
    assert [(t, tag) for t, tag, _ in texts] == [("a", "p"), ("b", "p"), ("c", "li"), ("d", "li"), ("e", "td"), ("f", "td"), ("g", "#page"), ("h", "#page")]
    assert len({b for _, _, b in texts[:7]}) == 7 and texts[6][2] == texts[7][2]
    assert dom.tokens("postBody main-2 X_y") == ["post", "body", "main", "x", "y"]


def test_boosting():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.grow(x[:1500], y[:1500], trees=30)
    assert ((trees.log_odds(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_breaks_part_words_and_references_end_with_their_run():
    page = dom.parse("<article><p>line one<br>line two<br/>three<wbr>four</p><p>AT&<b>amp;</b>T &amp;<i>lt;</i> a&nbsp;b</p><ul><br><li>x</li></ul></article>")
    assert ext.text_of(page, np.ones(len(page.tag), bool)) == "line one line two threefour\nAT&amp;T &lt; a b\nx"


def test_repeated_rows_and_single_words(spark):
    body = "<nav><ul><li><a href='/'>home</a></li></ul></nav><article><h1>Some title here</h1>" + "".join(f"<p>{w}</p>" for w in ["A paragraph of several words, with a comma.", "Word", "Another paragraph; it has more words than that.", "Onelle"] * 4) + "</article><footer>imprint</footer>"
    pages = spark.createDataFrame([(k, f"<html><body>{body}</body></html>") for k in (1, 1, 2)], "page_id long, html string")
    got = [r.text for r in ext.extract(pages, ext.fit(pages)).collect()]
    assert len(got) == 3 and len(set(got)) == 1
    assert got[0].split("\n").count("Onelle") == 4 and "imprint" not in got[0] and "home" not in got[0]
