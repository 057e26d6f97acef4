"""The training-data operators against brute force, on small fixtures with the awkward cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, pos int, rep long, part long"
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names the operators use inside."""
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3) for i, t in zip(ids, texts)], SCHEMA)


def prose(seed, n):
    r = np.random.default_rng(seed)
    syllables = ["an", "er", "th", "ou", "é", "ing", "st", "re", "Ö", "la"]
    return " ".join("".join(r.choice(syllables, r.integers(1, 4))) for _ in range(n))


EDGES = [None, "", " ", "\n\n", "a", "É", "word " * 3000, "x" * 5000, "same text here", "same text here", "tab\tand\x0bvt\r\n", "日本語 の テキスト 😀"]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# op1 ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return str(P.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(spark, tokenizer):
    from tokenizers import Tokenizer

    from tesselark.llm import bpe

    t = Tokenizer.from_file(tokenizer)
    r = np.random.default_rng(4)
    bits = [" ", "  ", "\n", "\t", "'s", "'re", "'", "''", "don't", "x", "1", "²", "!!", "<|endoftext|>", "\r\n", "'T", "é", "\x85", "　", "a" * 60]
    texts = [*EDGES, *("".join(r.choice(bits, r.integers(0, 12))) for _ in range(400)), prose(1, 400)]
    got = {x[0]: x[1:] for x in bpe.digests(frame(spark, texts), tokenizer).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t.decode(ids, skip_special_tokens=False))), repr(text)[:80]
    both = bpe.encode(frame(spark, texts[:20]), tokenizer)
    back = {x["doc_id"]: x["decoded"] for x in bpe.decode(both, tokenizer).collect()}
    assert back == {i: x or "" for i, x in enumerate(texts[:20])}
    assert bpe.digests(frame(spark, []), tokenizer).count() == 0


def test_lexicon_is_exact(tokenizer, tmp_path, monkeypatch):
    import tempfile

    from tesselark.llm import bpe

    monkeypatch.setattr(tempfile, "tempdir", str(tmp_path))
    v = bpe.Vocabulary(tokenizer)
    words = [w.encode() for w in (" the", " then", "thing", "nothing", " a", "a")]
    lex = bpe.Lexicon(bpe.compile_lexicon(words, bpe.Merger(v.byte_ids, v.merges)))
    probe = [*words, b" th", b"things", b"x"]
    data = np.frombuffer(b"".join(probe), np.uint8)
    end = np.cumsum([len(p) for p in probe])
    found = lex.find(data, end - [len(p) for p in probe], end)
    assert list(found >= 0) == [True] * 6 + [False] * 3
    assert sorted(found[:6]) == list(range(6))


# op2 ----------------------------------------------------------------------------------------


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    docs: dict = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                docs.setdefault(key(x), set()).add(i)
    gone = {k: max(v) for k, v in docs.items() if len(v) >= 5}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def test_line_dedup(spark):
    from tesselark.llm import lines

    common, accent = "This line is repeated by very many documents.", "ÉCOLE " * 8
    texts = [*EDGES, *(f"{prose(k, 12)}\n  {common.upper() if k % 2 else common}\t\n{common}\n{accent.lower() if k == 3 else accent}\nend {k}" for k in range(9)), common, common[:39], *[("y\n" * 200) + common for _ in range(2)]]
    got = lines.dedupe(frame(spark, texts))
    assert got.columns[:9] == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert {r["doc_id"]: (r["__n_lines"], r["__n_dropped"], sha(r["__kept"])) for r in got.collect()} == brute_lines(list(enumerate(texts)))
    assert lines.dedupe(frame(spark, [])).count() == 0


def test_line_dedup_plan_has_no_python(spark):
    from tesselark.llm import lines

    plan = lines.dedupe(frame(spark, EDGES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# op4 ----------------------------------------------------------------------------------------


def brute_hits(text, patterns):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hit, items = set(), set()
    for p, own in patterns.items():
        for k in range(len(words) - len(p) + 1):
            if tuple(words[k : k + len(p)]) == p:
                hit.update(range(k, k + len(p)))
                items |= own
    return len(words), len(hit), sorted(items)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontaminate(spark, block):
    from tesselark.llm import decontaminate as d

    bench = [(1, prose(100, 20)), (2, prose(101, 9)), (10, "Three Little words"), (11, prose(101, 9)), (12, None), (13, "..."), (14, "solo")]
    texts = [*EDGES, prose(100, 20).upper(), "a " + prose(101, 9) + " b", prose(5, 30) + " three, little-words " + prose(101, 8), prose(100, 7), "solo solo", *(prose(k, 50) for k in range(20))]
    patterns: dict = {}
    for i, t in bench:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            patterns.setdefault(tuple(w[k : k + n]), set()).add(i)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: r for r in d.report(d.search(frame(spark, texts), b, block_bytes=block)).collect()}
    for i, t in enumerate(texts):
        n, hits, items = brute_hits(t, patterns)
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hits, len(items)), (i, t)
        assert r["items_sha256"] == sha(",".join(sorted(map(str, items)))) and r["contaminated"] == (len(items) >= 2)
    kept = {r["doc_id"] for r in d.keep_clean(frame(spark, texts), b, block_bytes=block).collect()}
    assert kept == {i for i in range(len(texts)) if not got[i]["contaminated"]}
    assert d.search(frame(spark, texts), b.limit(0)).where("size(items) > 0").count() == 0


# op5, op7, op3 ------------------------------------------------------------------------------


def test_toxicity_learns_and_scores_everything(spark):
    from tesselark.llm import toxicity as t

    texts = [prose(k, 60) + (" vile scum" if k % 4 == 0 else "") for k in range(400)] + EDGES
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(9999, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = t.score(docs, t.train(docs, labels)).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"] and r["doc_id"] < 400)
    kept = {r["doc_id"] for r in t.keep_clean(docs, t.train(docs, labels)).collect()}
    assert kept == {r["doc_id"] for r in got if r["predicted"] == 0}
    assert t.score(docs.limit(0), t.train(docs, labels)).count() == 0
    assert {r["score"] for r in t.score(frame(spark, EDGES), t.train(docs, labels.limit(0))).collect()} == {0.5}


def test_language(spark):
    from tesselark.llm import language as n

    r = np.random.default_rng(2)
    sets = {"aa": ["ka", "to", "mi"], "bb": ["str", "ung", "ög"], "cc": ["ñe", "ció", "lla"]}
    rows = [(k, "".join(r.choice(sets[lang]) + (" " if r.random() < 0.5 else "") for _ in range(200)), lang) for k, lang in enumerate(sorted(sets) * 60)]
    rows += [(1000, None, "aa"), (1001, "123 ...", "bb"), (1002, "", None), (1003, "ka to", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in n.predict(docs, n.train(docs)).collect()}
    held = [(x["lang_pred"], rows[i][2]) for i, x in got.items() if x["held_out"] and i < 1000]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and len(held) > 10
    assert {got[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and got[1003]["lang_pred"] in sets
    assert {x["lang_pred"] for x in n.predict(docs, n.train(docs.limit(0))).collect()} == {"und"}


def test_weak_labels(spark):
    from tesselark.llm import weaklabels as w

    good = [" ".join(f"The {x} of it was an {x}n." for x in prose(k, 12).split()) for k in range(150)]
    bad = ["%%% ### $$$ *** " * 30, "BUY NOW!! " * 40, "again " * 80]
    texts = good + [b + prose(k, 3) for k in range(20) for b in bad] + EDGES
    docs = frame(spark, texts)
    got = {r["doc_id"]: r for r in w.score(docs, w.train(docs)).collect()}
    assert len(got) == len(texts)
    assert sum(got[k]["kept"] for k in range(150)) >= 148
    assert sum(got[k]["kept"] for k in range(150, 210)) <= 2


# op6 ----------------------------------------------------------------------------------------


def brute_repeats(rows, n):
    seen: dict = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        for p in range(len(b) - n + 1):
            seen[b[p : p + n]] = seen.get(b[p : p + n], 0) + 1
    out = {}
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def test_repeats(spark):
    from tesselark.llm import repeats as r

    shared = prose(7, 90)
    texts = [*EDGES, shared, prose(1, 40) + shared + prose(2, 40), prose(3, 9) + shared[50:400], shared[:199], shared[:200], shared[1:260] + "!", "ab" * 400, "é" * 300, prose(9, 100), *(prose(40 + k, 6) + shared[k * 7 : k * 7 + 230] + prose(80 + k, 6) for k in range(12))]
    texts += [texts[-1]] * 3
    got = r.remove(frame(spark, texts)).select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)"), F.size("spans"), F.sha2("kept", 256))
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == brute_repeats(list(enumerate(texts)), 200)
    assert r.remove(frame(spark, [])).count() == 0


def test_repeats_of_rows_with_one_id_or_none(spark):
    """Rows are told apart by id and text; extra columns named as the operator's own don't matter."""
    from tesselark.llm import repeats as r

    a, b, c = prose(1, 90), prose(2, 150), prose(3, 70)
    rows = [(1, a), (1, b + a), (1, b), (None, c), (None, c + b), (2, a), (2, a), (3, "x" * 250 + c), (4, prose(5, 90))]
    docs = spark.createDataFrame([(i, t, 1, 2, "s", 3) for i, t in rows], "doc_id long, text string, row long, twin long, spans string, core long")
    got = r.remove(docs).select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)"), F.size("spans"), F.sha2("kept", 256)).collect()
    want = brute_repeats(list(enumerate(t for _, t in rows)), 200)
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *want[k]) for k, (i, _) in enumerate(rows)), key=repr)
    text = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    assert sorted((tuple(x) for x in r.remove(text).select("n_bytes", F.size("spans")).collect())) == sorted((want[k][0], want[k][2]) for k in want)


def test_repeats_in_very_long_texts(spark, monkeypatch):
    """Parts and chunks much smaller than the text."""
    from tesselark.llm import repeats as r

    monkeypatch.setattr(r, "_PIECE", 700)
    monkeypatch.setattr(r, "_CHUNK", 900)
    shared = prose(7, 300)
    texts = [prose(8, 500) + shared + prose(9, 200), shared[100:1500] + prose(10, 300) + shared[:900], prose(11, 800)]
    got = r.remove(frame(spark, texts)).select("doc_id", "n_bytes", F.expr("aggregate(spans, 0L, (a, x) -> a + x.end - x.start)"), F.size("spans"), F.sha2("kept", 256))
    assert {x[0]: tuple(x[1:]) for x in got.collect()} == brute_repeats(list(enumerate(texts)), 200)


# op8 ----------------------------------------------------------------------------------------


def test_quality_rules(spark):
    from tesselark.llm import quality as q

    texts = [*EDGES, "a b c a b c a b c", "one two three four\none two three four\n\n \n", "# * $ % & | < > x", *(prose(k, 80) for k in range(5)), "the of and " * 30]
    got = {r["doc_id"]: r for r in q.measure(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at: dict = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = len({p + j for v in at.values() if len(v) > 1 for p in v for j in range(3)})
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat), repr(t)[:60]
        assert r["base_failed"] == (len(w) < 50 or 100 * repeat > 50 * len(w)) and not (r["kept"] and r["base_failed"])
    plan = q.measure(frame(spark, texts))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_quality_rules_beyond_packed_positions(spark, monkeypatch):
    """With two bits for positions, most texts have more windows than fit."""
    from tesselark.llm import quality as q

    texts = [*EDGES, "a b c a b c a b c", "a b c d e f g h i a b c", "a b c d e f", " ".join(map(str, range(40))) + " 1 2 3 7 8 9", *(prose(k, 80) for k in range(3)), "the of and " * 30]
    want = q.measure(frame(spark, texts)).orderBy("doc_id").collect()
    monkeypatch.setattr(q, "POSITION_BITS", 2)
    assert q.measure(frame(spark, texts)).orderBy("doc_id").collect() == want
    assert [r["n_repeat_words"] for r in want][len(EDGES) : len(EDGES) + 4] == [9, 6, 0, 12]


# op9 ----------------------------------------------------------------------------------------


def test_html(spark):
    from tesselark.llm import html as h

    page = lambda k: f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>ok?</div><article><h1>Title {k}</h1><p>Body &amp; <b>bold</b> {k}<br>more<p>two &#233;<script>x='</p>'</script><form>q<input></form></article><aside>side</aside><div id=comments>nice!</div><footer>&copy;</footer>"
    rows = [(k, "http://a.org/x", page(k)) for k in range(5)] + [(10, None, None), (11, "http://b.org", ""), (12, "bad url", "plain text"), (13, "http://b.org/1", "<p>a<p>b<div class=content>in</div>")]
    rows += [(20 + k, "http://c.org/", f"<html><body><div>Same top</div><div><h2>T{k}</h2><p>Body {k}</p></div><div>Same end</div></body></html>") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in h.main_texts(pages).collect()}
    assert len(got) == len(rows)
    assert got[3] == "Title 3\n\nBody & bold 3 more\n\ntwo é"
    assert (got[10], got[11], got[12], got[13]) == ("", "", "plain text", "in")
    assert got[22] == "T2\n\nBody 2"
    one = lambda x: h.extract([x])[0]
    assert one("<body><header>Site</header><div class='main-content no-sidebar'><p>in</p><div class='sidebar'>out</div></div></body>") == "in"
    assert one("<main><article><header><h1>T</h1></header><p>x</p><footer>by</footer></article><section id='comments'><article class='comment'>c</article></section><article class='related-posts'>r</article></main>") == "T\n\nx"
    assert one("<p>a<b>b</b>c &lt;d&gt;</p><!-- no --><p>e\n f") == "abc <d>\n\ne f"
    many = h.main_texts(pages, block_pages=2)
    assert many.count() == len(rows)


def test_html_template_decides_in_main_regions():
    from tesselark.llm import html as h

    page = lambda k: f"<body><article><h1>Title {k}</h1><div>By the desk</div><p>Body <b>bold</b> {k}</p><p>More {k}</p><div class=x>Join <i>our</i> list</div></article>"
    own = lambda k: f"Title {k}\n\nBody bold {k}\n\nMore {k}"
    assert h.extract([page(k) for k in range(4)]) == [own(k) for k in range(4)]
    # no evidence: two pages, or copies of one
    few = h.extract([page(k) for k in range(2)])
    assert few[1] == "Title 1\n\nBy the desk\n\nBody bold 1\n\nMore 1\n\nJoin our list"
    assert h.extract([page(1)] * 9) == [few[1]] * 9
    # a paragraph without a tag of its own kind repeats in enough pages
    note = lambda k: f"<main><h1>T{k}</h1><p>One {k}</p><p>Two {k}</p><p>All rights reserved</p></main>"
    assert h.extract([note(k) for k in range(9)]) == [f"T{k}\n\nOne {k}\n\nTwo {k}" for k in range(9)]


def test_html_classes_that_cross_are_dropped():
    from tesselark.llm import html as h

    pages = [h.Page(x) for x in ["<i id=a><u id=c><i id=b><u id=d>"] * 3 + ["<i id=a><i id=b>"]]
    kept = h.templates(pages)
    assert all({t.partition(">")[2] for t in k} == {"i id=a", "i id=b"} for k in kept)
    whole = [h.Page(x) for x in ["<i id=a><u id=c><u id=d><i id=b>"] * 3 + ["<i id=a><i id=b>"]]
    assert len(h.templates(whole)[0]) == 4


def test_html_does_not_depend_on_the_order_of_pages():
    """Classes a and b cross, b and c do: which of them stay must not follow from the page met first."""
    from tesselark.llm import html as h

    page = lambda k, names: f"<article><p>Text {k}</p>" + "".join(f"<div id={n}>{'Join us' if n == 'c1' else ''}</div>" for n in names) + f"<p>More {k}</p></article>"
    kinds = [("b1", "c1", "b2", "c2")] * 3 + [("a1", "b1", "a2", "b2")] * 3 + [("c1", "c2")] * 2 + [("a1", "a2")] * 5
    texts = [page(k, names) for k, names in enumerate(kinds)]
    assert h.extract(texts[::-1])[::-1] == h.extract(texts)


# op10 ---------------------------------------------------------------------------------------


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a], changed = label[b], True
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard(spark, width, percent):
    from tesselark.llm import jaccard as j

    r = np.random.default_rng(width)
    texts = list(EDGES)
    for k in range(12):
        base = prose(200 + k, int(r.integers(5, 160))).split()
        for _ in range(int(r.integers(1, 6))):
            words = list(base)
            for _ in range(int(r.integers(0, 4))):
                words[int(r.integers(len(words)))] = "edited"
            texts.append(" ".join(words[: len(words) - int(r.integers(0, 3))]))
    texts += ["one two three", "One  two\tthree", "one two three four", "one two three four five six seven eight", "one two three four five six seven"]
    got = {x[0]: tuple(x[1:]) for x in j.classes_of(frame(spark, texts), width=width, percent=percent).collect()}
    assert got == brute_components(list(enumerate(texts)), width, percent)


def test_jaccard_groups_in_blocks(spark, monkeypatch):
    from tesselark.llm import jaccard as j

    monkeypatch.setattr(j, "GROUP_TOKENS", 200)
    base = prose(5, 90).split()
    texts = [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(40)] + [" ".join(base)] * 5 + [prose(6, 90)]
    got = {x[0]: tuple(x[1:]) for x in j.classes_of(frame(spark, texts)).collect()}
    assert got == brute_components(list(enumerate(texts)), 4, 85)
    assert j.classes_of(frame(spark, [])).count() == 0


def test_components(spark):
    from tesselark.llm.components import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (90, 95, 100)} == {90}
    assert components(edges.limit(0)).count() == 0
