"""A corpus pipeline of five operators: toxicity, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's
result as Parquet in the shared folder and gives it, read again, to the next stage; the tables
that a stage made for itself are deleted then.

Edge cases, alike in every stage: a null or empty text is kept and is no one's copy; rows
without an id lose no line and are no one's copy, and are judged by their text alone
elsewhere; repeated rows stay or go together; very long texts are read whole; ties go to the
smallest id (near copies) or the largest (lines); empty tables pass through; other columns
are handed on as they are, whatever their names, and n_chars follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselark.llm import bpe, decontaminate, jaccard, lines, toxicity
from tesselark.llm.common import bounded_batches, few, release, stored, tables
from tesselark.llm.queries import table, tokenizer_path

#: Bytes of an Arrow batch, about; the stages share executors, whose JVMs were seen to grow from stage to stage.
BATCH = 4 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on those given that have labels, doesn't reject."""
    bounded_batches(spark, BATCH)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents repeat; n_chars follows the text."""
    got = lines.dedupe(docs)
    changed = F.col("__n_dropped") > 0
    length = F.char_length("__kept").cast(docs.schema["n_chars"].dataType)
    text = F.when(changed, F.col("__kept")).otherwise(F.col("text"))
    n_chars = F.when(changed, length).otherwise(F.col("n_chars"))
    return got.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by shingles of five words at 0.8."""
    bounded_batches(spark, BATCH)
    found = jaccard.classes_of(docs, width=5, percent=80)
    gone = few(found.where(F.col("component_id") != F.col("doc_id")).select("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    bounded_batches(spark, BATCH)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), least_items=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document that is left, as counts and digests."""
    bounded_batches(spark, BATCH)
    return bpe.digests(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: The first and last stages have no SQL form; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    first = tables()
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        # all that is stored but the stage's result, which is the last
        release(spark, first, tables() - 1)
        first = tables() - 1
    return STAGES[-1][1](spark, docs, sf_dir)
