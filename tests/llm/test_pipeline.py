"""The pipeline against its stages' definitions, worked out on the small tables."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_keep_the_columns_and_shrink(spark):
    from test_operators import brute_components, brute_hits, brute_lines, sha  # noqa: PLC0415

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes, name
        now = {r["doc_id"]: r["text"] for r in after.collect()}
        if k == 0:
            toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
            clean = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 0").collect()}
            assert clean & set(before) <= set(now) and len(toxic & set(now)) < len(toxic & set(before))  # few labels here
        elif k == 1:
            want = brute_lines(list(before.items()))
            assert {i: sha(t) for i, t in now.items()} == {i: w[2] for i, w in want.items()}
        elif k == 2:
            want = brute_components(list(before.items()), 5, 80)
            assert set(now) == {i for i, w in want.items() if w[1] == i}
        else:
            import re

            low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
            patterns: dict = {}
            for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
                w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r["text"] or "").translate(low))
                n = min(8, len(w))
                for p in range(len(w) - n + 1 if w else 0):
                    patterns.setdefault(tuple(w[p : p + n]), set()).add(r["item_id"])
            assert set(now) == {i for i, t in before.items() if not brute_hits(t, patterns)[2]}
            assert len(now) < len(before)  # the tables hold benchmark passages
        docs, before = spark.createDataFrame(after.collect(), after.schema), now
    from tokenizers import Tokenizer  # noqa: PLC0415

    from tesselark.llm.queries import tokenizer_path  # noqa: PLC0415

    t = Tokenizer.from_file(tokenizer_path())
    got = {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()}
    ids = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in before.items()}
    assert got == {i: (len(x), hashlib.sha256(t.decode(x, skip_special_tokens=False).encode()).hexdigest()) for i, x in ids.items()}


def test_one_benchmark_item_is_enough(spark, tmp_path):
    passage = "seven little words and then one more of them"
    spark.createDataFrame([(1, passage), (2, "quite another passage of the benchmark that nobody quotes")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, "clean text"), (2, f"x {passage} y"), (3, None), (None, f"{passage}"), (None, "also clean")], "doc_id long, text string").withColumn("n", F.lit(1))
    kept = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted([(1, "clean text"), (3, None), (None, "also clean")], key=repr)


def test_run_equals_its_stages(spark):
    from tesselark.llm.common import stored  # noqa: PLC0415

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, DATA))
    want = sorted(map(repr, corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()))
    assert sorted(map(repr, corpus_pipeline.run(spark, DATA).collect())) == want


def test_python_stages_take_small_batches(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    usual = spark.conf.get(key)
    spark.createDataFrame([(1, "words of no document that is given here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, 0, k % 2) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(k, f"text {k} and some more") for k in range(50)], "doc_id long, text string").withColumn("n_chars", F.length("text"))
    long = spark.range(0, 4_000, 1, 1).select("id", F.repeat(F.lit("x"), 4_000).alias("text"))  # 16 MB in one partition

    def sizes(batches):
        import pyarrow as pa  # noqa: PLC0415

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "b": [batch.nbytes]})

    try:
        for name, stage in corpus_pipeline.STAGES:
            if name == "line dedup":  # no Python there
                continue
            spark.conf.set(key, usual)
            stage(spark, docs, str(tmp_path))
            got = long.mapInArrow(sizes, "n long, b long").collect()
            assert sum(r["n"] for r in got) == 4_000, name
            assert max(r["b"] for r in got) <= (4 << 20) + (1 << 16), name
    finally:
        spark.conf.set(key, usual)
