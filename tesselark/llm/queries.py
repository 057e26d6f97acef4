"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    got = lines.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op3_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import weaklabels as w

    docs = table(spark, sf_dir, "documents")
    return w.score(docs, w.train(docs))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate as d

    return d.report(d.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity as t

    docs = table(spark, sf_dir, "documents")
    return t.score(docs, t.train(docs, table(spark, sf_dir, "labels")))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repeats as r

    got = r.remove(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language as n

    docs = table(spark, sf_dir, "documents")
    return n.predict(docs, n.train(docs))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality as q

    return q.measure(table(spark, sf_dir, "documents"))


def op9_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html as h

    return h.main_texts(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard as j

    return j.classes_of(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_line_dedup, op3_weak_quality, op4_decontaminate, op5_toxicity, op6_repeats, op7_language, op8_quality_rules, op9_html_template, op10_ngram_jaccard)}

_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _quality_sql() -> str:
    """The measures of op8 and its verdict, from the same threshold table."""
    from .quality import RULES, STOP_WORDS, SYMBOLS

    stops = ", ".join(f"'{x}'" for x in STOP_WORDS)
    fails = " OR ".join(f"{name} {op} {limit}" for name, op, limit in RULES)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT doc_id, t, regexp_extract_all(t, '{_WORDS}') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x, {_TRIM}) <> '') AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) AS k FROM w WHERE len(w) > 2),
r AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
q AS (SELECT doc_id, count(DISTINCT i) AS n FROM r GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(q.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS BIGINT) AS n_stop,
  length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '\\p{{L}}', '', 'g')) AS n_letters FROM w LEFT JOIN q ON q.doc_id = w.doc_id),
x AS (SELECT *, CASE WHEN n_words > 0 THEN CAST(word_chars AS DOUBLE) / n_words ELSE 0.0 END AS mean_word, CASE WHEN n_words > 0 THEN CAST(n_symbols AS DOUBLE) / n_words ELSE 0.0 END AS symbols_per_word,
  CASE WHEN n_words > 0 THEN CAST(n_stop AS DOUBLE) / n_words ELSE 0.0 END AS stop_share, CASE WHEN n_letters > 0 THEN CAST(n_upper AS DOUBLE) / n_letters ELSE 0.0 END AS upper_share,
  CASE WHEN n_lines > 0 THEN CAST(n_dup_lines AS DOUBLE) / n_lines ELSE 0.0 END AS dup_line_share, CASE WHEN n_words > 0 THEN CAST(n_repeat_words AS DOUBLE) / n_words ELSE 0.0 END AS repeat_share,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({fails}) AS kept, mean_word, symbols_per_word, stop_share, upper_share, dup_line_share FROM x"""


ORACLES = {
    "op4_decontaminate": f"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
p AS MATERIALIZED (SELECT DISTINCT item_id, least(8, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(8, len(w)) + 2), lambda i: array_to_string(w[i:i + least(8, len(w)) - 1], ' '))) AS k FROM b WHERE len(w) > 0),
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
s AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS k FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
h AS MATERIALIZED (SELECT doc_id, item_id, i, s.n AS n FROM s JOIN p ON p.n = s.n AND p.k = s.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS items FROM h GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(len(items), 0) >= 2 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op8_quality_rules": _quality_sql(),
    "op10_ngram_jaccard": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) ELSE [array_to_string(w, ' ')] END) AS k FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
c(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT c.doc_id, l.b FROM c JOIN l ON l.a = c.r)
SELECT c.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY 1""",
    "op2_line_dedup": f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, {_TRIM}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
}
