from __future__ import annotations

import html
import re

import numpy as np
import pytest

from eventide.llm import html_crf as H
from eventide.llm.queries import op1_html_text

SF = "/root/testdata/sf0.001"


def article(page):
    """The main text of the test tables' pages, read off their fixed layout."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n\n".join(x for x in (" ".join(html.unescape(p).split()) for p in parts) if x)


def test_query_against_the_pages_layout(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op1_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article(pages[r["page_id"]]["html"]) and r["url"] == pages[r["page_id"]]["url"]
        assert r["n_chars"] == len(r["text"])


@pytest.fixture(scope="module")
def model(spark):
    return H.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_held_out_layouts(spark, model):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").limit(60).collect()]
    wrong = total = 0
    for page, labels in H.labelled_pages(pages, seed=99):
        got = np.array(model.decode(page), int)
        wrong, total = wrong + (got != labels).sum(), total + len(labels)
    assert wrong / total < 0.02


PAGES = {
    "<body><header><a href=/>Site</a></header><nav><a>Home</a> <a>News</a></nav><div class='cookie-notice'>We use cookies here.</div>"
    "<main><h1>Title here</h1><p>First para &amp; more &copy; text.</p><div class=ad>Buy now!</div><p>Second &lt;b&gt;\n\t para.</p>"
    "<ul><li>item one<li>item two</ul><form><label>Email</label><input><button>Go</button></form>"
    "<section class=comments><h2>Comments</h2><div class=comment><p>Great article, I really liked it a lot.</p></div></section></main>"
    "<aside><h3>Related</h3><p>Another story of interest, read it.</p></aside><footer><p>All rights reserved.</p></footer>":
        ["Title here", "First para & more © text.", "Second <b> para.", "item one", "item two"],
    "<div id=page><div id=sidebar><p>About me text goes here and is long enough to look like prose.</p></div><div class=post><h2>Hello</h2>"
    "<p>Body text one. With <a href=x>a link</a> in it.</p><blockquote>Quote</blockquote></div><div id=comments><ol><li><p>First!</p></li></ol>"
    "</div><div id=footer>Copyright 2020</div></div>": ["Hello", "Body text one. With a link in it.", "Quote"],
    "just plain text, no tags.": ["just plain text, no tags."],
    "<p>a<p>b": ["a", "b"],
    "<script>var t='</p><p>x</p>';</script><style>p{}</style><p>kept text.</p><!-- <p>not this</p> -->": ["kept text."],
}


@pytest.mark.parametrize("page", list(PAGES))
def test_layouts_never_seen(model, page):
    assert model.extract(page).split("\n\n") == PAGES[page]


@pytest.mark.parametrize("page", [None, "", " \n", "<", "<div", "<p class=\"x", "<!-- open", "<script>never closed", "&#0;&bogus;", "</p></div>", "<>" * 50])
def test_broken_pages_do_not_fail(model, page):
    assert isinstance(model.extract(page), str)


def test_long_and_deep_pages(model):
    text = "word " * 200_000
    assert model.extract(f"<article><p>{text}</p></article>") == text.strip()
    assert model.extract("<div>" * 5000 + "<p>deep text here.</p>") == "deep text here."


@pytest.mark.parametrize("page,texts", [
    ("<p title=it's>One two three.</p><p>Three don't go.</p><p>Last one.</p>", ["One two three.", "Three don't go.", "Last one."]),
    ("<p>a <a href=x\">link</a> here.</p><p>\"quoted\" text</p>", ["a link here.", '"quoted" text']),
    ("<p>one</p><p class=\"x>two</p><p>three</p>", ["one", "two", "three"]),
    ("<p 'x' \"y>one</p><p>it's two</p>", ["one", "it's two"]),
    ("<p a = 'x > y' b=\">\">one</p><p / =x>two</p><p a=>three</p><br/>", ["one", "two", "three"]),
    ("<p a=b'c\"d>one</p>\"'<p a='1'b=\"2\">two</p>", ["one", "\"'", "two"]),
])
def test_quotes_in_tags(page, texts):
    assert [b.text for b in H.blocks(page)] == texts


def test_attribute_names_give_features():
    names = lambda tag, attrs: H._own_features(tag, attrs) - H._own_features(tag, "")
    want = names("div", " class=\"navBar\"")
    assert len(want) == 2 and want == names("div", " CLASS='nav Bar'") == names("div", "/title=\"x class=y\" id=nav-bar") == names("div", " class = nav_bar")


def test_deep_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for name in ("x", "{}"):  # one name, and a name of its own for each element
        letters = ["".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(20_000)]
        page = "".join(f"<div class={name.format(x)}>" for x in letters) + "<p>deep text</p>"
        assert [b.text for b in H.blocks(page)] == ["deep text"]
    H.blocks("<p a=\"" * 20_000 + "<p>x")
    assert time.perf_counter() - began < 2


def test_gradient_matches_differences():
    """The likelihood's gradient against central differences, on random chains."""
    rng = np.random.default_rng(7)
    pages = [([H.Block("x", tuple(sorted(rng.choice(40, 4, replace=False).tolist())), frozenset()) for _ in range(n)],
              rng.integers(0, 2, n)) for n in (1, 2, 5, 9)]

    def loss(m):
        """Minus the log probability of the labels, by summing over all label sequences."""
        total = 0.0
        for page, y in pages:
            e, n = m.emissions(page), len(page)
            value = lambda k: sum(e[i] * k[i] for i in range(n)) + sum(m.turns[k[i], k[i + 1]] for i in range(n - 1))
            every = [value([c >> i & 1 for i in range(n)]) for c in range(2**n)]
            total += np.logaddexp.reduce(every) - value(y.tolist())
        return total

    m = H.Model(rng.normal(size=H.FEATURES), rng.normal(size=(2, 2)))
    want_w, want_t = np.zeros(40), np.zeros((2, 2))
    for page, y in pages:
        p, pair = H.marginals(m.emissions(page), m.turns)
        for i, b in enumerate(page):
            for f in b.features:
                want_w[f] += p[i] - y[i]
        for i in range(len(page) - 1):
            want_t += pair[i]
            want_t[y[i], y[i + 1]] -= 1
    for f in range(40):
        step = np.zeros(H.FEATURES)
        step[f] = 1e-5
        assert (loss(H.Model(m.weights + step, m.turns)) - loss(H.Model(m.weights - step, m.turns))) / 2e-5 == pytest.approx(want_w[f], abs=1e-5)
    for a in range(2):
        for b in range(2):
            step = np.zeros((2, 2))
            step[a, b] = 1e-5
            assert (loss(H.Model(m.weights, m.turns + step)) - loss(H.Model(m.weights, m.turns - step))) / 2e-5 == pytest.approx(want_t[a, b], abs=1e-5)


def test_blocks_decode_and_join_white_space():
    found = H.blocks("<p>a&nbsp;b<br>c\n\n d <b>e</b>f &amp;amp; &am &#x41;</p>")
    assert [b.text for b in found] == ["a b c d ef &amp; &am A"]


def test_viterbi_matches_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n = int(rng.integers(1, 7))
        m = H.Model(rng.normal(size=H.FEATURES), rng.normal(size=(2, 2)))
        page = [H.Block("x", (int(rng.integers(H.FEATURES)),), frozenset()) for _ in range(n)]
        e = m.emissions(page)
        best = max(range(2**n), key=lambda k: sum(e[i] * (k >> i & 1) for i in range(n)) + sum(
            m.turns[k >> i & 1, k >> (i + 1) & 1] for i in range(n - 1)))
        assert [int(x) for x in m.decode(page)] == [best >> i & 1 for i in range(n)]


def test_empty_table_and_odd_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, "<p>x y z.</p>"), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    assert H.fit(pages.limit(0)).extract("<p>a</p>") in ("", "a")
    text = H.extractor(H.fit(pages))
    assert [r[0] for r in pages.select(text("html")).collect()].count("") >= 3


WHOLE = ["First part of the story, with enough words.", "Second part of the story, it ends here."]
HOLES = {tag: f"<{tag} class=x>" for tag in ("svg", "select", "object", "canvas", "audio", "video", "button", "template", "noscript")}


@pytest.mark.parametrize("hole", [*HOLES.values(), "<svg viewBox='0 0 1 1'/>", "<svg><path d='M0 0'/><title>icon", "<!-->"])
@pytest.mark.parametrize("tail", ["", "<p>Third.</p><div><button>Go</button><svg/><video src=v>none</video></div>"])
def test_unclosed_elements_cut_nothing(model, hole, tail):
    found = [b.text for b in H.blocks(f"<body><article><p>{WHOLE[0]}</p>{hole}<p>{WHOLE[1]}</p></article>{tail}")]
    assert [t for t in found if t in WHOLE] == WHOLE and ("Third." in found) == bool(tail)
    assert "Go" not in found and "none" not in found
    text = model.extract(f"<body><article><p>{WHOLE[0]}</p>{hole}<p>{WHOLE[1]}</p></article>")
    assert all(w in text for w in WHOLE)


@pytest.mark.parametrize("tag", list(HOLES))
def test_second_element_does_not_end_an_unclosed_one(tag):
    page = f"<body><div><{tag}></div><article><p>{WHOLE[0]}</p></article><{tag}>hidden</{tag}><p>{WHOLE[1]}</p>"
    assert [b.text for b in H.blocks(page)] == WHOLE
    page = f"<body><{tag}><article><p>{WHOLE[0]}</p></article><{tag}>hidden</{tag}><p>{WHOLE[1]}</p>"
    assert [b.text for b in H.blocks(page)] == WHOLE


@pytest.mark.parametrize("tag", list(HOLES))
def test_closed_elements_are_left_out(tag):
    page = f"<p>Press <{tag} id=a><g>x</g> y</{tag}>to start.</p><ul><li>a<{tag}>z</{tag}><li>b</ul>"
    assert [b.text for b in H.blocks(page)] == ["Press to start.", "a", "b"]


def test_blocks_inside_closed_elements_do_not_part_the_text():
    assert [b.text for b in H.blocks("<p>Press <button><div>Go</div></button>to start.</p>")] == ["Press to start."]
    assert [b.text for b in H.blocks("<ul><li>a<template><li>x<li>y</template> b</ul>")] == ["a b"]
    assert [b.text for b in H.blocks("<p>a<svg><foreignObject><div><p>x</p></div></foreignObject></svg>b</p>")] == ["ab"]


@pytest.mark.parametrize("head", ["<head><title>t</title><meta charset=x>", "<head><title>t</title></head>", "<head><noscript><style>p{}</style></noscript>", "<head>"])
@pytest.mark.parametrize("body", ["", "<body>"])
def test_head_without_its_end_tag(model, head, body):
    inner = "".join(f"<p>{w}</p>" for w in WHOLE)
    page = f"<!doctype html><html>{head}{body}<article>{inner}</article>"
    found = H.blocks(page)
    assert [b.text for b in found] == WHOLE and model.extract(page) == "\n\n".join(WHOLE)
    assert bool(body) or not any("head" in b.tags for b in found)
    assert [b.text for b in H.blocks(f"{head}Plain text.")] == ["Plain text."]


@pytest.mark.parametrize("tag", ["script", "style", "textarea", "title"])
def test_raw_text_runs_to_the_end(tag):
    assert [b.text for b in H.blocks(f"<p>a</p><{tag}>never closed <p>b</p>")] == ["a"]


STORY = [f"Line {i} of the story tells what happened on day {i} at sea." for i in range(5)]


def div_page(k):
    body = "".join(f"<p>{x} ({k})</p>" for x in STORY)
    return (f"<html><head><title>t</title></head><body><div class=menu><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></div>"
            f"<div class=post><h1>Title {k}</h1>{body}</div><div class=ads><p>Buy the best boats of the coast now, only today.</p></div>"
            f"<div id=comments><div class=comment><p>I liked this story a lot, thank you for it.</p></div></div>"
            f"<div class=footer>Copyright 2020, all rights reserved.</div></body></html>")


def test_table_without_articles(spark):
    pages = spark.createDataFrame([(k, "u", div_page(k)) for k in range(30)], "page_id long, url string, html string")
    model = H.fit(pages)
    for k in (0, 29):
        assert model.extract(div_page(k)).split("\n\n") == [f"Title {k}", *(f"{x} ({k})" for x in STORY)]


@pytest.mark.parametrize("name", ["advert", "cookie-banner", "reader-comments", "sponsored"])
def test_named_parts_of_an_article_are_not_taught_as_content(name):
    pages = [f"<div class=menu><a>Home</a></div><article><h1>Title {k}</h1>" + "".join(f"<p>{x} ({k})</p>" for x in STORY)
             + f"<div class={name}><p>Not of the story {k}, in spite of its place.</p></div></article><footer>Site {k}</footer>" for k in range(20)]
    taught = H.labelled_pages(pages)
    assert not any(y and b.text.startswith("Not of the story") for page, labels in taught for b, y in zip(page, labels))
    trained = H.train(taught)
    for k, page in enumerate(pages):
        assert trained.extract(page).split("\n\n") == [f"Title {k}", *(f"{x} ({k})" for x in STORY)]


def test_every_sample_teaches_both_labels():
    for pages in ([], [""], ["<div>Home</div>"], [div_page(1)]):
        labels = np.concatenate([y for _, y in H.labelled_pages(pages)])
        assert 0 < labels.mean() < 1
