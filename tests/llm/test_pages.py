"""Main text of pages: known layouts, held-out pages, and message passing against enumeration."""

import itertools

import numpy as np
import pytest

from sievegrid.llm import html as H


@pytest.fixture(scope="module")
def model():
    return H.default_model()


def test_messages_equal_enumeration():
    rng = np.random.default_rng(0)
    parents = np.array([-1, 0, 0, 1, 1, 2, 5])
    edges = rng.integers(0, H.EDGES, 7)
    forest = H.Forest([(rng.random((7, 3), np.float32), parents, edges)])
    unary, pair = rng.normal(size=(7, 2)), rng.normal(size=(H.EDGES, 2, 2))
    total, single, double = 0.0, np.zeros((7, 2)), np.zeros((7, 2, 2))
    for y in itertools.product((0, 1), repeat=7):
        p = np.exp(sum(unary[k, y[k]] for k in range(7)) + sum(pair[edges[k], y[parents[k]], y[k]] for k in range(1, 7)))
        total += p
        for k in range(7):
            single[k, y[k]] += p
            double[k, y[parents[k]], y[k]] += p * (k > 0)
    chance, joint, log_z = forest.marginals(unary, pair)
    assert np.allclose(chance, single / total)
    assert np.allclose(joint[1:], double[1:] / total)
    assert np.allclose(log_z, np.log(total))


def test_held_out_pages(model):
    maker = H.PageMaker(4242)
    made = [H.labelled(maker.page()) for _ in range(150)]
    forest = H.Forest([H.describe(p, p.texts()) for p, _ in made])
    truth = np.concatenate([y for _, y in made])
    assert ((model.content(forest) >= 0.5) == truth).mean() > 0.97


BODY = "<h1>A title of words</h1><p>First &amp; long enough sentence, with &eacute; and &#8212; signs.<p>Second\n one <b>in</b>side <a href=x>a link</a>, and more words.<ul><li>one item of it<li>two items of it</ul>"
TEXT = "A title of words First & long enough sentence, with é and — signs. Second one inside a link, and more words. one item of it two items of it"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article>{BODY}</article><footer>&copy; host</footer></body></html>",
        f"<body><header><a href=/>Site name</a></header><div class=sidebar><h3>Related</h3><ul><li><a href=1>x y</a></ul></div><main>{BODY}</main><div class='ad'>Buy this now, it is good.</div>",
        f"<div id=cookie-notice>We use cookies. Accept them please.</div><div class=content>{BODY}</div><div id=comments><div class=comment><p>I think this is bad, said a reader.</p></div></div>",
        f"<body>{BODY}</body>",
        f"<div role=navigation><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div><div id=main-content>{BODY}</div><div role=contentinfo><p>Some words about the site.</p></div>",
        f"<article>{BODY}<aside><h3>Related</h3><ul><li><a href=1>one more</a></ul></aside><section class=comments><h2>Comments</h2><div class=comment><p>This is what a reader had to say.</p></div></section></article>",
        f"<ol class=breadcrumb><li><a>Home</a></li><li>Here</li></ol><article>{BODY}<div class='share-buttons'><a>Tweet</a> <a>Post</a></div></article><div class='newsletter-popup'><p>Join us, it is free.</p></div>",
        f"<article>{BODY}<script>var t='</p><p>no</p>';</script><style>p{{}}</style><!-- <p>no</p> --><form><label>Name</label><input><button>Send</button></form></article>",
    ],
)
def test_layouts(model, page):
    assert H.main_texts([page], model) == [TEXT]


def test_awkward_pages(spark, model):
    rows = [
        (1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>" + "word of it, again. " * 40_000, None), (4, "u", "<<>< a < b > <p", "x"),
        (5, "u", "<p class=\"a>never closed", "x"), (1, "u", None, "x"), (6, "u", "<div>" * 3000 + "deep", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = H.extract(pages, model=model)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = found.collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", "", ""]
    assert all(r.n_chars == len(r.text) for r in got)
    assert max(r.n_chars for r in got) == 19 * 40_000 - 1
    assert H.extract(pages.limit(0), model=model).count() == 0


# All marks by one pattern, which costs the rest of the page for every "<" that has no end.
PLAIN_MARKS = r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"""


def marks(source):
    found, at, out = H.Marks(source), 0, []
    while True:
        start, end, tag = found.after(at)
        if end is None:
            return out
        out.append((start, end, tag.groups() if tag else (None,) * 6))
        at = end


def test_marks_equal_one_pattern():
    import random
    import re

    pattern, r = re.compile(PLAIN_MARKS, re.S), random.Random(1)
    parts = ["<p ", "<b>", '"', "'", ">", "<!--", "-->", "<!x ", "x", "</p", "</div>", " ", "=", '<a href="', "<", "--", "<?y"]
    for _ in range(20_000):
        source = "".join(r.choices(parts, k=r.randint(0, 14)))
        assert marks(source) == [(m.start(), m.end(), m.groups()) for m in pattern.finditer(source)], source


def test_open_quotes_cost_the_length_of_the_page():
    import time

    for unit in ("<p '<b ", '<a "', "<!x ", "<!-- <p '", "<a \"'>", "<p '\"<b> "):
        start = time.process_time()
        marks("<div>ok</div>" + unit * (1_000_000 // len(unit)))
        assert time.process_time() - start < 3, unit
