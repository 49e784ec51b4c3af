"""Main-text extraction: held-out pages, broken markup, real rows, and the boosted trees."""

import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwerk.llm import webpages
from maskwerk.llm.boosting import Boosted


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 1] > 0) ^ (x[:, 4] > 0.5)).astype(float)
    model = Boosted(trees=25, depth=3).fit(x[:2000], y[:2000])
    assert ((model.odds(x[2000:]) > 0) == y[2000:]).mean() > 0.95
    assert np.isfinite(Boosted(trees=2).fit(np.zeros((5, 2)), np.ones(5)).odds(np.zeros((3, 2)))).all()


def test_held_out_pages():
    model, exact, found, right, wanted = webpages.fitted(), 0, 0, 0, 0
    for seed in range(50_000, 50_200):
        source, main = webpages.written_page(seed)
        got = set(filter(None, webpages.main_texts([source], model)[0].split("\n")))
        exact += got == main
        found, right, wanted = found + len(got), right + len(got & main), wanted + len(main)
    assert exact >= 190 and right / found > 0.98 and right / wanted > 0.98


def article_of(source):
    """The article of the test tables' pages, whose markup is known."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    blocks = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|li|ul)[^>]*>", "\x00", inner)).split("\x00")
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r["page_id"]: r for r in webpages.extract(pages).collect()}
    for r in pages.collect():
        assert out[r["page_id"]]["text"] == article_of(r["html"]) and out[r["page_id"]]["n_chars"] == len(article_of(r["html"]))


ODD = [
    None, "", "just text", "<", "<p", "<!-- open", "<script>never closed", "<p>a<p>b</div></p></article>", "<div " * 50, "<a href='x\">broken</a> text", "<p>&amp;lt; &#x41; &nbsp; &bogus; ퟿</p>",
    "<div>" * 3000 + "deep" + "</div>" * 3000, "<table><tr><td>x<td>y<tr><td>z</table>", "<P CLASS=Content>UPPER</P>", "<article><p>word " + "long " * 200_000 + "</p></article>",
]


def test_odd_pages(spark):
    rows = [(i, "u", h) for i, h in enumerate(ODD)] + [(None, None, "<article><p>A sentence, and another one. It is long enough to be a text.</p></article>")] * 2
    given = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    out = webpages.extract(given).collect()
    assert len(out) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in out)
    by = {r["page_id"]: r["text"] for r in out}
    assert by[0] == by[1] == by[6] == "" and by[len(ODD) - 1].count("long") == 200_000
    assert by[None] == "A sentence, and another one. It is long enough to be a text."
    assert webpages.extract(given.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("inner", "want"),
    [("<p>a&amp;b  c\n d</p><p>e</p>", "a&b c d\ne"), ("<h2>t</h2><ul><li>x<li>y</ul>", "t\nx\ny"), ("<p>in<b>li</b>ne <a href=x>link</a></p>", "inline link"), ("<p>a<script>b</script>c</p><!-- no --><style>p{}</style>", "a\nc")],
)
def test_blocks(inner, want):
    page = webpages.Page(f"<html><head><title>no</title></head><body>{inner}</body></html>")
    assert "\n".join(t for t in page.text if t) == want


@pytest.mark.parametrize(
    "source",
    [
        "<body><p>a</p><embed src=x><p>b</p>", "<body><p>a</p><embed src=x/><p>b</p>", "<body><p>a</p><svg><path d=x><p>b</p>", "<body><p>a</p><map name=m><area><p>b</p><svg><text>no</text></svg>", "<body><p>a</p><button><p>b</p>",
        "<body><p>a</p><button><p>b</p><button>no</button>", "<body><p>a</p><object><object>no</object>no</object><p>b</p>", "<body><p>a</p><svg><script>'</svg>'</script><text>no</text></svg><p>b</p>",
        "<head><meta charset=utf-8><title>no</title><style>no</style><p>a</p><p>b</p>", "<html><head><title>no</title><noscript>no</noscript><link rel=x><article><p>a</p><p>b</p></article>", "<head><title>no</title><p>a</p></head><body><p>b</p>",
        "<p>a</p><p>b</p><script>never <p>closed</p>", "<p>a</p><p>b</p><textarea>never <p>closed</p>", "<p>a</p><p>b</p><title>never <p>closed</p>",
    ],
)
def test_skipping_ends(source):
    """What stands behind a void or unclosed element, or in a head that is not closed, is read; raw text runs to the end."""
    assert [t for t in webpages.Page(source).text if t] == ["a", "b"]


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<p>a<br>b<br/> c</p><p>d</p>", "a b c\nd"), ("<p>a<script>no</script>b <style>no</style>c<svg><text>no</text></svg></p>", "ab c"), ("<p>Hi</p><script src=a.js/>var leak=1;</script><p>x</p>", "Hi\nx"),
        ("<p>a<svg width=1 /> b</p><svg width=1/><p>no</p></svg><p>c</p>", "a b\nc"), ("<p>a</p><script>no</script><p>b</p>", "a\nb"), ("<p title='1 > 0'>a</p><p title=\"x='>'\">b</p>", "a\nb"),
    ],
)
def test_blocks_go_on_behind_what_is_skipped(inner, want):
    page = webpages.Page(f"<html><body>{inner}</body></html>")
    assert "\n".join(page.decode([1.0] * len(page.text))) == want


@pytest.mark.parametrize("unit", ['<a x="y ', '<a x="> y="', "<a x='> y=\"", "<p ", "<!-- ", "<a =", "</p "])
def test_reading_is_linear(unit):
    started = time.monotonic()
    webpages.Page(unit * (1_000_000 // len(unit)))
    assert time.monotonic() - started < 15


def strange_page(seed):
    """A page of a third kind: a newspaper's layout in tables and sections, words as class names in another language, text by letters."""
    import random

    rng = random.Random(f"strange {seed}")
    word = lambda: "".join(rng.choices("etaoinshrdluäöüéñ", k=rng.randint(2, 9)))
    said = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + "."
    prose = lambda: " ".join(said(6, 18) for _ in range(rng.randint(1, 5)))
    kinds = rng.sample(["spalte", "kasten", "zeile", "kopf", "fuss", "rand", "inhalt", "bereich", "block", "teil", "rahmen", "gruppe"], 12)
    box = lambda k, x, tag="div": f'<{tag} class="{kinds[k]} {kinds[k]}-{rng.randint(1, 9)}">{x}</{tag}>'
    main = set()

    def own(text, tag="p"):
        main.add(text)
        return f"<{tag}>{text}</{tag}>"

    links = lambda n: "".join(f'<li><a href="/{word()}">{said(1, 4)}</a></li>' for _ in range(n))
    body = own(said(3, 9), "h1") + "".join(rng.choice([lambda: own(prose()), lambda: own(prose()), lambda: own(prose()), lambda: own(said(2, 6), "h3")])() for _ in range(rng.randint(3, 12)))
    top = box(3, f"<a href=/>{word()}</a><ul>{links(rng.randint(4, 9))}</ul>", rng.choice(["div", "header"]))
    rand = box(5, f"<h4>{said(1, 3)}</h4><ul>{links(rng.randint(4, 9))}</ul>", rng.choice(["div", "aside"]))
    bottom = box(4, f"<p>&copy; {word()} <a href=/a>{word()}</a> <a href=/b>{word()}</a></p>", rng.choice(["div", "footer"]))
    middle = box(6, body, rng.choice(["div", "section", "article"]))
    middle = f"<table><tr><td>{rand}</td><td>{middle}</td></tr></table>" if rng.random() < 0.3 else box(0, middle + rand)
    return f"<html><body>{top}{middle}{bottom}</body></html>", main


def test_foreign_layouts():
    """Precision and recall of blocks on pages of a generator that the trees have not been fitted on."""
    model, found, right, wanted = webpages.fitted(), 0, 0, 0
    for seed in range(200):
        source, main = strange_page(seed)
        got = set(filter(None, webpages.main_texts([source], model)[0].split("\n")))
        found, right, wanted = found + len(got), right + len(got & main), wanted + len(main)
    print("precision", right / found, "recall", right / wanted)
    assert right / found > 0.9 and right / wanted > 0.9


PROSE = "The town lies on a river, and its market is older than its walls. Ships came up from the sea, with salt and wool."


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("The river ran<script>var x = 1;</script> on", "The river ran on"), ("See <noscript><img src=x></noscript>the map", "See the map"), ("We saw it<svg><text>no</text></svg> today", "We saw it today"),
        ("We came <a href=/x>and a link to it</a><script>1</script> (more)", "We came and a link to it (more)"), ("<style>b{}</style>A<script>1</script>B<svg></svg> C <script>2</script><a href=/y>D</a>", "AB C D"),
    ],
)
@pytest.mark.parametrize("around", ["{}", "<header><a href=/>Home</a></header><nav><ul><li><a href=/a>News</a></li><li><a href=/b>Sport</a></li></ul></nav>{}<footer>&copy; 2020 Example</footer>"])
def test_a_block_with_something_skipped_in_it_is_one(inner, want, around):
    """A block is kept or dropped as a whole, whatever stands in it."""
    page = around.format(f"<article><h1>A short history</h1><p>{PROSE}</p><p>{inner}</p><p>{PROSE[::-1]}</p></article>")
    plain = around.format(f"<article><h1>A short history</h1><p>{PROSE}</p><p>{want}</p><p>{PROSE[::-1]}</p></article>")
    got, without = webpages.main_texts([page, plain], webpages.fitted())
    assert got.split("\n") == ["A short history", PROSE, want, PROSE[::-1]] and without == got


def test_scripts_change_no_verdict():
    """Pages in whose blocks scripts and icons are put have the same text as without them."""
    import random

    model, rng = webpages.fitted(), random.Random(3)
    for seed in range(150):
        source, _ = strange_page(seed)
        cut = [rng.choice(["<script>var a = '<p>';</script>", "<svg><path d=x></svg>", "<noscript><b>x</b></noscript>"]) + " " if c == " " and rng.random() < 0.02 else c for c in source]
        inside, mixed = False, []
        for c, new in zip(source, cut, strict=True):  # between tags alone
            inside = c == "<" or inside and c != ">"
            mixed.append(c if inside else new)
        assert webpages.main_texts(["".join(mixed)], model) == webpages.main_texts([source], model), seed


def test_many_unclosed_elements():
    started = time.monotonic()
    page = webpages.Page("<body>" + "<svg><button>x" * 100_000)
    assert sum(t.count("x") for t in page.text) == 100_000 and time.monotonic() - started < 20


def test_decoding_is_consistent():
    page = webpages.Page("<body><div><p>one</p><div><p>two</p></div></div><p>three</p></body>")
    names = {page.text[i]: i for i in range(len(page.text)) if page.text[i]}
    odds = [0.0] * len(page.text)
    outer = page.parent[page.parent[names["one"]]]
    odds[outer] = -9.0
    for i, t in enumerate(page.text):
        if t:
            odds[i] = 1.0
    assert page.decode(odds) == ["three"] or "one" in page.decode(odds)
    odds[outer] = -1.0
    assert page.decode(odds) == ["one", "two", "three"]
