import pytest

from lodestar.llm import html_extract as h
from lodestar.llm import html_layouts

PAGES = "page_id long, url string, html string"

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    "<!-- x --><div class=\"ad\">Buy this now, cheap offers.</div><article><h1>The &amp; title</h1><p><b>First  line of it.<br><p>Second paragraph, which is\n longer &lt;here&gt;, and says a few more words.</p>"
    "<ul><li>point one of the list<li>point two of the list</ul></article><div class='comments'><h3>Comments</h3><p>I do not agree, this is wrong.</p></div><footer>&copy; someone &middot; all rights reserved</footer></body></html>"
)


def test_page():
    assert h.main_texts([PAGE], h.model()) == ["The & title\nFirst line of it.\nSecond paragraph, which is longer <here>, and says a few more words.\npoint one of the list\npoint two of the list"]


def test_held_out_layouts():
    right = wrong = missed = 0
    for page in html_layouts.pages(150, 12345):
        (got,) = h.main_texts([page], h.model())
        want = {t for n in h.parse(page) for _, t in n.texts if html_layouts.is_main(t)}
        got = set(got.split("\n")) - {""}
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.98 and right / (right + missed) > 0.98


def test_nothing_below_a_rejected_node_is_kept():
    nodes = h.parse(PAGE)
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(50):
        kept = h.decode(nodes, rng.normal(size=len(nodes)))
        assert all(kept[n.parent] for i, n in enumerate(nodes) if i and kept[i])


@pytest.mark.parametrize("page", ["<", "<p", "</p></div>", "<p>a<p>b", "<table><tr><td>a<td>b<tr><td>c", "<script>", "<!-- open", "a & b &nosuch; &#65;", "<div " * 50, "<b><i></b></i>x", "<p x='>'>y"])
def test_broken_markup(page):
    assert isinstance(h.main_texts([page], h.model())[0], str)


ARTICLE = "<html><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><article><h1>The title</h1><p>First paragraph of the text, which says a few words.</p>%s<p>Last paragraph of the text, which says a few more words.</p></article></body></html>"


@pytest.mark.parametrize("tag", ["svg", "math"])
def test_self_closed_elements_do_not_swallow_text(tag):
    part = f"<{tag} width='1'/><p>Between the two, there are words, and more of them.</p><{tag}><g/></{tag}>"
    (got,) = h.main_texts([ARTICLE % part], h.model())
    assert got.split("\n") == ["The title", "First paragraph of the text, which says a few words.", "Between the two, there are words, and more of them.", "Last paragraph of the text, which says a few more words."]


def test_slash_closes_what_lies_in_svg():
    page = ARTICLE % "<svg><style/><a/><title/></svg><p>Between, there are words, and more of them.</p><style>p{}</style>"
    (node,) = [n for n in h.parse(page) if any("Between" in t for _, t in n.texts)]
    assert not node.linked and not any("{" in t for n in h.parse(page) for _, t in n.texts)


def test_text_in_other_elements_is_kept():
    part = "<p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> is drawn in <svg><style>t{}</style><text>figure one</text></svg>, as said before.</p>"
    part += "<object data=a><p>Words of the object, which are part of the text.</p></object><noscript><p>Words without scripts, which are part of the text.</p></noscript>"
    (got,) = h.main_texts([ARTICLE % part], h.model())
    assert "The sum x+y is drawn in figure one, as said before.\nWords of the object, which are part of the text.\nWords without scripts, which are part of the text.\nLast" in got


def test_noscript_is_a_node():
    nodes = h.parse("<p>One <noscript>two<img></noscript> three</p><noscript><p>four")
    assert [(n.tag, [t for _, t in n.texts]) for n in nodes[1:]] == [("p", ["One", "three"]), ("noscript", ["two"]), ("noscript", []), ("p", ["four"])]


def test_frame(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "just text, nothing else but words."), (1, "u", PAGE), (5, "u", "<article>" + "<p>word and word, word.</p>" * 20_000 + "</article>")]
    got = h.extract(spark.createDataFrame(rows, PAGES)).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 6 and by[2].text == by[3].text == "" and by[None].text == "just text, nothing else but words."
    assert all(r.n_chars == len(r.text) for r in got) and by[5].text.count("\n") == 19_999
    assert h.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_stray_quotes_do_not_swallow_text():
    first, second = "Hello there world, this is a whole sentence.", "The second paragraph doesn't say more, or does it."
    for attributes in ("title=it's", "title='it\"s'", 'data-x="a>b" don\'t', "a = 'b' c", "'", 'x="unclosed', "x=", "=y'"):
        (got,) = h.main_texts([f"<article><p {attributes}>{first}</p><p>{second}</p></article>"], h.model())
        assert got == f"{first}\n{second}", attributes


@pytest.mark.parametrize("part", ["<div>", "<span>", "<p><b>", "<svg><select>", "<table><tr><td>", "<li><p>a", "<a b=\"'", "<button>", "<!--", "<x y='"])
def test_pages_of_open_elements_take_linear_time(part):
    import time

    began = time.process_time()
    h.parse(part * 100_000 + "text")
    assert time.process_time() - began < 10


def test_decoding_against_all_choices():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(2, 9))
        nodes = [h.Node("div", -1 if i == 0 else int(rng.integers(0, i)), 0, (), [(i, "t")] if rng.random() < 0.6 else []) for i in range(n)]
        odds = rng.normal(size=n)
        filled = [bool(x.texts) for x in nodes]
        for i in range(n - 1, 0, -1):
            filled[nodes[i].parent] |= filled[i]
        weight = np.where(filled, odds, 0.0)
        worth = lambda kept: sum(w if k else -w for w, k in zip(weight, kept, strict=True))  # noqa: E731, B023
        allowed = [k for k in itertools.product((False, True), repeat=n) if all(k[nodes[i].parent] for i in range(1, n) if k[i])]
        kept = h.decode(nodes, odds)
        assert tuple(kept.tolist()) in allowed and worth(kept) == pytest.approx(max(map(worth, allowed)))
