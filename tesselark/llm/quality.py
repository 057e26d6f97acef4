"""Quality rules: a threshold table compiled into one projection, without user functions.

Every measure is a Spark expression over the text, so the whole operator is one stage
without a shuffle.  Repeats of three-word windows are found per text by sorting hashes of
the windows packed with their positions; in a text of more than 16 million windows, whose
positions don't fit beside the hash, pairs of hash and position are sorted.

Edge cases: a null or empty text has no words and fails the base rules; rows repeat as
given, with or without an id; a very long text is measured whole; a measure at its limit (a
tie) passes; an empty table gives an empty result; columns beside id and text play no part,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a window's position beside its hash; texts with more windows sort pairs.
POSITION_BITS = 24
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "auf das dem den der des die ein eine für ist mit nicht sich und von zu "
    "au aux avec dans de des du elle en est et la le les ou par pas pour que qui sur un une "
    "con de del el en es la las lo los no para por que se su una y"
).split()

#: measure, comparison that fails, limit
RULES = (
    ("n_words", "<", 50),
    ("mean_word", ">", 15.0),
    ("symbols_per_word", ">", 0.3),
    ("stop_share", "<", 0.02),
    ("upper_share", ">", 0.7),
    ("dup_line_share", ">", 0.5),
    ("repeat_share", ">", 0.5),
)


def measures(text: Column) -> dict[str, Column]:
    """Named expressions over a text column that holds no nulls; later ones use earlier ones by name."""
    c = F.col
    high, low = f"{-1 << POSITION_BITS}L", f"{(1 << POSITION_BITS) - 1}L"
    packed = F.expr(f"transform(h, (x, i) -> (x & {high}) | i)")
    # equal leading bits name a candidate; the whole hashes at both positions decide
    same = lambda j: f"((x & {high}) = (p[{j}] & {high}) and h[cast(x & {low} as int)] = h[cast(p[{j}] & {low} as int)])"
    near = F.expr(f"filter(p, (x, i) -> (i > 0 and {same('i - 1')}) or (i + 1 < size(p) and {same('i + 1')}))")
    # no packing for more windows than positions
    pairs = F.expr("array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', cast(i as bigint))))")
    met = F.expr("filter(pp, (x, i) -> (i > 0 and x.h = pp[i - 1].h) or (i + 1 < size(pp) and x.h = pp[i + 1].h))")
    repeats, long = F.size(F.array_distinct("h")) < F.size("h"), F.size("h") > F.lit(1 << POSITION_BITS)
    return {
        "w": F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != ""),
        "n_words": F.size("w").cast("long"),
        "word_chars": F.char_length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "lines": F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != ""),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "h": F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, w[i + 1], w[i + 2]))"),
        "p": F.when(~long & repeats, F.sort_array(packed)).otherwise(F.expr("cast(array() as array<bigint>)")),
        "pp": F.when(long & repeats, pairs).otherwise(F.expr("cast(array() as array<struct<h:bigint,i:bigint>>)")),
        "again": F.when(long, F.array_sort(F.transform(met, lambda x: x["i"]))).otherwise(F.array_sort(F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << POSITION_BITS) - 1))))),
        "n_repeat_words": F.expr("aggregate(again, named_struct('n', 0L, 'end', 0L), (a, x) -> named_struct('n', a.n + x + 3 - greatest(a.end, x), 'end', x + 3), a -> a.n)"),
        "n_stop": F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS))).cast("long"),
        "n_upper": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long"),
        "n_letters": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{L}", ""))).cast("long"),
        "mean_word": F.coalesce(F.try_divide(c("word_chars"), c("n_words")), F.lit(0.0)),
        "symbols_per_word": F.coalesce(F.try_divide(c("n_symbols"), c("n_words")), F.lit(0.0)),
        "stop_share": F.coalesce(F.try_divide(c("n_stop"), c("n_words")), F.lit(0.0)),
        "upper_share": F.coalesce(F.try_divide(c("n_upper"), c("n_letters")), F.lit(0.0)),
        "dup_line_share": F.coalesce(F.try_divide(c("n_dup_lines"), c("n_lines")), F.lit(0.0)),
        "repeat_share": F.coalesce(F.try_divide(c("n_repeat_words"), c("n_words")), F.lit(0.0)),
    }


def verdict(rules=RULES) -> Column:
    """True where no rule of the table fails."""
    ops = {"<": lambda a, b: a < b, ">": lambda a, b: a > b}
    out = F.lit(True)
    for name, op, limit in rules:
        out = out & ~ops[op](F.col(name), F.lit(limit))
    return out


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Every measure of every text, base_failed and kept."""
    out = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    for name, value in measures(F.col("__t")).items():
        out = out.withColumn(name, value)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ratios = ["mean_word", "symbols_per_word", "stop_share", "upper_share", "dup_line_share"]
    return out.select(F.col("__id").alias(id_col), *counts, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"), *ratios)
