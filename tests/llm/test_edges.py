"""Every operator over rows that are repeated, null, empty, very long or oddly named, and over empty tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tesselark.llm.queries")

#: Names that the operators use inside for something else.
NAMES = "n_dropped n_lines lines row doc twin text2 bitmap k t uid spans items id pos h g salt first core rep part need parts f i j x at low high word __doc at2 kept".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(["an", "er", "th", "ou", "é", "ing"], r.integers(1, 4))) for _ in range(n))


LINE = "This line is held by more than five of the documents."


def rows():
    texts = [None, "", " ", "\n", "a", *(f"{prose(k, 30)}\n{LINE}" for k in range(7)), prose(40, 60), LINE]
    out = list(enumerate(texts))
    return out + [(3, "\n"), (5, f"{prose(0, 30)}\n{LINE}"), (6, prose(90, 12)), (None, None), (None, f"x\n{LINE}"), (None, f"x\n{LINE}"), (None, prose(40, 60))]


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(rows(), "doc_id long, text string")
    return plain.withColumns({n: F.lit("z") for n in NAMES}).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(14)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(40, 60)), (2, "a"), (2, "a"), (None, prose(1, 30)), (3, None)], "item_id long, text string")


def tokenizer():
    return str(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))


def run_bpe(docs, **_):
    from tesselark.llm import bpe

    return bpe.digests(docs, tokenizer())


def run_lines(docs, **_):
    from tesselark.llm import lines

    return lines.dedupe(docs).select("doc_id", "__n_lines", "__n_dropped", "__kept")


def run_weak(docs, **_):
    from tesselark.llm import weaklabels

    return weaklabels.score(docs, weaklabels.train(docs))


def run_search(docs, bench, **_):
    from tesselark.llm import decontaminate

    return decontaminate.report(decontaminate.search(docs, bench))


def run_search_in_blocks(docs, bench, **_):
    from tesselark.llm import decontaminate

    return decontaminate.report(decontaminate.search(docs, bench, block_bytes=60))


def run_toxicity(docs, labels, **_):
    from tesselark.llm import toxicity

    return toxicity.score(docs, toxicity.train(docs, labels))


def run_repeats(docs, **_):
    from tesselark.llm import repeats

    return repeats.remove(docs).select("doc_id", "n_bytes", F.size("spans"), "kept")


def run_language(docs, **_):
    from tesselark.llm import language

    return language.predict(docs, language.train(docs))


def run_quality(docs, **_):
    from tesselark.llm import quality

    return quality.measure(docs)


EVERY = [run_bpe, run_lines, run_weak, run_search, run_search_in_blocks, run_toxicity, run_repeats, run_language, run_quality]


@pytest.mark.parametrize("run", EVERY)
def test_rows_stay_whole(run, docs, labels, bench):
    """One result for each row, the same for rows that repeat, and none from an empty table."""
    got = run(docs=docs, labels=labels, bench=bench)
    assert got.columns[0] == "doc_id" and len(set(got.columns)) == len(got.columns)
    found = got.collect()
    assert sorted(repr(r[0]) for r in found) == sorted(repr(i) for i, _ in rows())
    for i, text in {r for r in rows() if rows().count(r) > 1}:
        n = rows().count((i, text))
        assert max(sum(tuple(a) == tuple(b) for b in found if b[0] == i) for a in found if a[0] == i) >= n
    assert run(docs=docs.limit(0), labels=labels.limit(0), bench=bench.limit(0)).count() == 0
    assert run(docs=docs.limit(0), labels=labels, bench=bench).columns == got.columns


def test_lines_of_rows_with_one_id(docs):
    found = run_lines(docs).collect()
    by = lambda i: sorted((r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in found if r["doc_id"] == i)
    assert by(6) == sorted([(1, 0, prose(90, 12)), (2, 1, prose(1, 30))])
    assert by(5) == [(2, 1, prose(0, 30))] * 2
    assert by(13) == [(1, 0, LINE)] and by(None)[-1] == (2, 0, f"x\n{LINE}")


def test_blocks_of_the_benchmark_change_nothing(docs, bench):
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(run_search(docs, bench)) == key(run_search_in_blocks(docs, bench))
    from tesselark.llm import decontaminate

    whole = decontaminate.keep_clean(docs, bench, least_items=1)
    split = decontaminate.keep_clean(docs, bench, least_items=1, block_bytes=60)
    assert whole.columns == split.columns == docs.columns and key(whole) == key(split)
    # benchmark passages go whether their row has an id or none
    assert {r["text"] for r in whole.collect()}.isdisjoint({prose(40, 60), "a"}) and whole.where("doc_id is null").count() == 3


def test_jaccard_over_awkward_rows(docs):
    from tesselark.llm import jaccard

    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes_of(docs).collect()}
    assert sorted(found) == sorted({i for i, _ in rows() if i is not None})
    assert found[0] == (0, 0) and found[1] == (0, 1) and found[4] == (1, 4)
    greatest = max(prose(90, 12), f"{prose(1, 30)}\n{LINE}")  # of the two texts of document 6
    words = greatest.lower().split()
    assert found[6] == (len({tuple(words[k : k + 4]) for k in range(len(words) - 3)}), 6)
    assert jaccard.classes_of(docs.limit(0)).count() == 0


def test_an_encoder_is_of_its_tokenizer(spark, tmp_path):
    """With an empty lexicon the automata are the same; the merges aren't."""
    import json

    from tesselark.llm import bpe

    with open(tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][:50]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec))
    one = spark.createDataFrame([(1, "the thing")], "doc_id long, text string").coalesce(1)
    long, short = (bpe.digests(one, p).head()["n_tokens"] for p in (str(other), tokenizer()))
    assert long > short == bpe.digests(one, tokenizer()).head()["n_tokens"]


@pytest.mark.parametrize("run", EVERY)
def test_a_long_text(run, spark, labels, bench):
    """Five megabytes of words and one word of a megabyte."""
    words = prose(3, 4000) + "\n"
    texts = [(1, words * 160), (2, "é" * 500_000), (3, prose(40, 60))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("aa"))
    found = {r["doc_id"]: r for r in run(docs=docs, labels=labels, bench=bench).collect()}
    assert sorted(found) == [1, 2, 3]
    if run is run_lines:
        assert hashlib.sha256(found[1]["__kept"].encode()).digest() == hashlib.sha256(texts[0][1].encode()).digest()
    if run is run_quality:
        assert found[1]["n_words"] == 640_000 == found[1]["n_repeat_words"]
    if run is run_repeats:
        assert len(found[1]["kept"]) < 400 and found[2]["kept"] == b""
