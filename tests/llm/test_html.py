"""Template deduction: its classes against brute force, what the template decides, and pages that are hostile or long."""

import time

import numpy as np
import pytest

h = pytest.importorskip("tesselark.llm.html")


def one(text):
    return h.extract([text])[0]


def brute_classes(pages):
    """Valid classes by definition: tokens of one vector whose order on each page is a repeated sequence."""
    tokens = sorted({t for p in pages for t in p.tokens})
    vector = {t: tuple(p.tokens.count(t) for p in pages) for t in tokens}
    out = set()
    for v in set(vector.values()):
        own = {t for t in tokens if vector[t] == v}
        if sum(n > 0 for n in v) < h.LEAST_PAGES or len(own) < 2:
            continue
        rows = [[t for t in p.tokens if t in own] for p in pages]
        order = next(r for r in rows if r)[: len(own)]
        if all(r == order * n for r, n in zip(rows, v, strict=True)):
            out.add(tuple(order))
    return out


def test_classes_equal_brute_force():
    r = np.random.default_rng(8)
    for _ in range(40):
        kinds = ["<div id=a>", "</div>", "<ul>", "<li>x", "<li>y", "<b>", "<hr>", "same", "<div class=k>", "<p>"]
        pages = [h.Page("".join(r.choice(kinds, r.integers(1, 9)))) for _ in range(r.integers(3, 6))]
        assert {tuple(tokens) for _, tokens in h.equivalence_classes(pages)} == brute_classes(pages)


def test_lists_are_classes_of_several_rounds():
    pages = [h.Page("<ul>" + "".join(f"<li><a>{k}{j}</a></li>" for j in range(k + 2)) + "</ul>") for k in range(4)]
    found = {tuple(n for _, n in v): [t.partition(">")[2] for t in tokens] for v, tokens in h.equivalence_classes(pages)}
    assert found[2, 3, 4, 5] == ["li", "a", "/a", "/li"] and found[1, 1, 1, 1] == ["ul", "/ul"]
    assert len(h.nest(h.equivalence_classes(pages), pages)) == 2
    slots = h.Template(pages).slots(pages[1])
    assert len(set(slots)) == 1 and len(slots) == 3


def page(k):
    return f"<body><div>Menu of the site</div><article><h1>Title {k}</h1><div>By the desk</div><p>Body {k}</p></article></body>"


def test_without_templates_the_result_differs(monkeypatch):
    texts = [page(k) for k in range(4)]
    assert h.extract(texts) == [f"Title {k}\n\nBody {k}" for k in range(4)]
    monkeypatch.setattr(h, "equivalence_classes", lambda pages: [])
    assert h.extract(texts) == [f"Title {k}\n\nBy the desk\n\nBody {k}" for k in range(4)]


def test_shared_paragraphs_are_not_template():
    """Near copies on one host share paragraphs; they are no template, nor are exact copies."""
    long = lambda k: f"<article><h1>T</h1><p>One</p><p>Two</p><p>Three {k}</p></article>"
    other = [f"<article><h1>O{k}</h1><p>a{k}</p><p>b{k}</p></article>" for k in range(30)]
    assert h.extract([long(k) for k in range(9)] + other)[:9] == [f"T\n\nOne\n\nTwo\n\nThree {k}" for k in range(9)]
    assert h.extract([page(1)] * 20) == ["Title 1\n\nBy the desk\n\nBody 1"] * 20


def test_article_text_that_looks_like_something_else_stays():
    assert one("<article><div class='entry-header'><h1>T</h1></div><p>x</p></article>") == "T\n\nx"
    assert one("<article><figure><img><figcaption>cap</figcaption></figure><p>a</p></article>") == "cap\n\na"
    assert one("<article><p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p></article>") == "a x=1 b"
    assert one("<article><p class='market-share'>m</p><p class='text-alert'>t</p></article>") == "m\n\nt"
    assert one("<main><p>before</p><article><p>body</p></article><p>after</p></main>") == "before\n\nbody\n\nafter"
    assert one("<p>İ a < b &amp;lt; 1<2 <script>x</SCRIPT >y") == "İ a < b &lt; 1<2 y"


def test_what_is_no_article_goes():
    gone = [
        "<nav>m</nav>", "<div class='comments-area'>c</div>", "<div class='post-footer'>f</div>", "<div id=cookie-banner>k</div>", "<aside>s</aside>",
        "<div class='ad'>a</div>", "<form><label>q</label></form>", "<style>p{}</style>", "<!-- <p>x</p> -->", "<div class='left-sidebar'>s</div>", "<noscript>n</noscript>",
        "<footer>f</footer>", "<div role=navigation>n</div>", "<script>var t='</p>';</script>",
    ]
    for g in gone:
        assert one(f"<body><article><p>a</p>{g}<p>b</p></article>{g}</body>") == "a\n\nb", g
    assert one("<article><p>a <span class=ad>x</span> b</p><p>c<i class=ad>x</i>d</p></article>") == "a b\n\ncd"


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<b><p>", "</x>", "<div><p>x</z>", "<a b=\"<\" c='>'", "<li><p>x", "<script>", "<!--", "<", "&lt;", "<a '\">", "word "])
def test_a_megabyte_takes_seconds(unit):
    began = time.time()
    h.extract([unit * (1_000_000 // len(unit))])
    assert time.time() - began < 30


def test_blocks_and_awkward_rows(spark):
    rows = [(k, "http://a.org/x", page(k)) for k in range(6)] + [(7, None, None), (8, "", ""), (9, "x", page(9)), (0, "http://a.org/x", page(0)), (None, None, "plain")]
    pages = spark.createDataFrame([(*r, "h", 1) for r in rows], "page_id long, url string, html string, host string, block int")
    got = sorted(((r["page_id"], r["text"]) for r in h.main_texts(pages).collect()), key=repr)
    want = [(k, f"Title {k}\n\nBody {k}") for k in range(6)] + [(0, "Title 0\n\nBody 0"), (7, ""), (8, ""), (9, "Title 9\n\nBy the desk\n\nBody 9"), (None, "plain")]
    assert got == sorted(want, key=repr)
    assert h.main_texts(pages.limit(0)).count() == 0
    assert h.main_texts(pages, block_bytes=100).count() == len(rows)
