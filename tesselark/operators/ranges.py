"""Line ranges: merging, mapping to the most specific symbols, source windows, literal evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_ranges(ranges: DataFrame, key: str = "file_path", start: str = "start_line", end: str = "end_line", source: str | None = None) -> DataFrame:
    """Overlapping or adjacent ranges of each key as one; a null range means the whole file and swallows the rest."""
    whole = ranges.groupBy(key).agg(F.max(F.col(start).isNull() | F.col(end).isNull()).alias("__whole"))
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(start) > reach + 1, F.lit(True)).cast("int")
    islands = ranges.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(order))
    sources = [F.array_sort(F.collect_set(source)).alias("sources")] if source else []
    merged = islands.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), *sources).drop("__island")
    open_ = whole.where("__whole").select(key)
    null = ranges.join(open_, key, "left_semi").groupBy(key).agg(F.lit(None).cast(ranges.schema[start].dataType).alias(start), F.lit(None).cast(ranges.schema[end].dataType).alias(end), *sources)
    return merged.join(open_, key, "left_anti").unionByName(null)


def map_ranges(ranges: DataFrame, symbols: DataFrame, key: str = "file_path") -> DataFrame:
    """(range, symbol) pairs that overlap, without symbols that contain a smaller one which overlaps too."""
    r = ranges.select(key, F.col("start_line").alias("from"), F.col("end_line").alias("to"))
    s = symbols.select(key, "symbol", F.col("start_line").alias("a"), F.col("end_line").alias("z"))
    hit = r.join(s, key).where((F.col("a") <= F.coalesce("to", "a")) & (F.col("z") >= F.coalesce("from", "z")))
    x, y = hit.alias("x"), hit.alias("y")
    inner = (F.col(f"x.{key}") == F.col(f"y.{key}")) & F.col("x.from").eqNullSafe(F.col("y.from")) & F.col("x.to").eqNullSafe(F.col("y.to")) & (F.col("y.a") >= F.col("x.a")) & (F.col("y.z") <= F.col("x.z")) & ((F.col("y.z") - F.col("y.a")) < (F.col("x.z") - F.col("x.a")))
    return x.join(y, inner, "left_anti").select(key, F.col("from").alias("start_line"), F.col("to").alias("end_line"), "symbol")


def source_window(files: DataFrame, path: str, start: int | None = None, end: int | None = None, default: int = 120, most: int = 400, path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """Numbered lines of one file, with where the previous and next windows begin."""
    first = max(1, start or 1)
    last = min(end or first + default - 1, first + most - 1)
    rows = files.where(F.col(path_col) == path).select(F.col(path_col), F.split(text_col, "\n", -1).alias("__l"))
    rows = rows.withColumn("total_lines", F.size("__l")).select(path_col, "total_lines", F.posexplode(F.slice("__l", first, max(last - first + 1, 0))).alias("__i", "text"))
    previous = F.lit(max(1, first - default) if first > 1 else None).cast("int")
    return rows.select(path_col, (F.col("__i") + first).alias("line"), "text", "total_lines", previous.alias("previous_start"), F.when(F.col("total_lines") > last, F.lit(last + 1)).alias("next_start"))


def literal_evidence(files: DataFrame, needle: str, limit: int = 20, context: int = 0, path_col: str = "file_path", text_col: str = "content") -> DataFrame:
    """Lines that hold a literal: exact matches if a file has any, else those that ignore case; 1-based columns."""
    lines = files.select(path_col, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "text"))
    hit = lines.select(path_col, (F.col("pos") + 1).alias("line"), "text", F.instr("text", needle).alias("exact"), F.instr(F.lower("text"), needle.lower()).alias("folded")).where("folded > 0 or exact > 0")
    by_file = Window.partitionBy(path_col)
    ranked = hit.withColumn("__any", F.max(F.col("exact") > 0).over(by_file)).where("not __any or exact > 0")
    ranked = ranked.withColumn("match", F.when(F.col("exact") > 0, "exact").otherwise("case_insensitive")).withColumn("column", F.greatest("exact", F.when(F.col("exact") > 0, 0).otherwise(F.col("folded"))))
    rank = F.row_number().over(by_file.orderBy("line"))
    out = ranked.withColumn("__n", rank).where(F.col("__n") <= limit).select(path_col, "line", "column", "match", "text")
    if not context:
        return out
    around = out.select(path_col, "line", F.explode(F.sequence(F.col("line") - context, F.col("line") + context)).alias("near"))
    text = lines.select(path_col, (F.col("pos") + 1).alias("near"), F.col("text").alias("t"))
    got = around.join(text, [path_col, "near"]).groupBy(path_col, "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("near", "t"))), lambda x: x["t"]).alias("context"))
    return out.join(got, [path_col, "line"])
