"""Line deduplication in DataFrame operations only.

Lines are represented by a 128-bit hash of their key, made once and stored.  Hashes are
range-partitioned together with a salt of the document, so that a key which a third of all
documents hold is spread over many ranges, and sorted by document and position within each;
the number of salts follows from the number of lines.  Streaming over that order, the first
row of a document within a key marks it, which gives each (key, salt) its number of documents
and its largest document; those few rows are summed by key.  What goes back to the documents
is no text but a compressed keep bitmap: 64-bit words whose bits are 1 for the lines that
stay, absent where all lines of that stretch do.

Edge cases: a null or empty text is one empty line, which is never dropped; rows with a
null id are kept as they are, and count as no document; rows of one id count as one
document, and each loses the lines of its own text; a very long text is one array of
lines and one bitmap; of documents that hold a line the one with the largest id keeps it,
in all its rows and as often as it has it (ties between its own lines drop none); an empty
table gives an empty result; columns beside id and text play no part, whatever their names,
but for the four that dedupe adds, which docs mustn't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines for each range that one key may be spread over.
SALT_LINES = 50_000


def split_lines(text) -> F.Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(doc, twin, pos, h, g) of each line whose key is long enough to count; doc and twin, a hash of the text, name the row."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc is not null")
    rows = rows.select("doc", F.xxhash64("text").alias("twin"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keys = rows.where(F.char_length("line") >= least_chars).withColumn("key", F.btrim("line", F.lit(WHITE)))
    folded = F.when(F.octet_length("key") == F.char_length("key"), F.lower("key")).otherwise(F.translate("key", UPPER, LOWER))
    keys = keys.where(F.char_length("key") >= least_chars).withColumn("key", folded)
    return keys.select("doc", "twin", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("g"))


def drops(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(doc, twin, n_dropped, bitmap array<struct<word,bits>>) of the rows that lose lines; bits are 1 for lines that stay."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = stored(line_keys(docs, id_col, text_col, least_chars))
    salts = max(1, -(-lines.count() // SALT_LINES))
    ranged = lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts))).repartitionByRange(parts, "h", "g", "salt")
    stream = Window.partitionBy("h", "g", "salt").orderBy(F.desc("doc"), "pos")
    marked = ranged.select("h", "g", "salt", "doc", F.coalesce(F.lag("doc").over(stream) != F.col("doc"), F.lit(True)).alias("first"))
    part = stored(marked.groupBy("h", "g", "salt").agg(F.sum(F.col("first").cast("long")).alias("n"), F.max("doc").alias("last")))
    whole = part.groupBy("h", "g").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= least_docs).select("h", "g", "last")
    frequent = part.select("h", "g", "salt").join(whole, ["h", "g"])
    salted = lines.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(salts)))
    gone = salted.join(frequent, ["h", "g", "salt"]).where(F.col("doc") != F.col("last"))
    words = gone.groupBy("doc", "twin", F.expr("pos div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    bitmap = F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("bits").alias("bits")))).alias("bitmap")
    return words.groupBy("doc", "twin").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), bitmap)


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """docs with __n_lines, __n_dropped, __kept, the text that stays, and __keep_bitmap, null where all lines stay."""
    gone = drops(docs, id_col, text_col, least_chars, least_docs)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc"), F.xxhash64(text).alias("twin"), text.alias("text"))
    out = rows.join(gone, ["doc", "twin"], "left").withColumn("lines", split_lines(F.col("text"))).withColumn("n_lines", F.size("lines").cast("long"))
    # the compressed words, laid out densely for one constant-time look-up a line
    dense = F.expr("transform(sequence(0L, (n_lines - 1) div 64), k -> coalesce(try_element_at(map_from_entries(bitmap), k), -1L))")
    out = out.withColumn("dense", F.when(F.col("bitmap").isNotNull(), dense))
    stay = F.expr("filter(lines, (x, i) -> (shiftright(dense[i div 64], i % 64) & 1L) = 1L)")
    kept = F.when(F.col("bitmap").isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(stay, "\n"))
    return out.select(
        *(F.col("row").getField(c).alias(c) for c in docs.columns), F.col("n_lines").alias("__n_lines"),
        F.coalesce("n_dropped", F.lit(0).cast("long")).alias("__n_dropped"), kept.alias("__kept"), F.col("bitmap").alias("__keep_bitmap"),
    )
