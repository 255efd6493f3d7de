"""Texts of any size as numbered lines, by Spark's own text source: a file is read by as many tasks as it has splits, and none is ever one string.

What a line needs to know of the lines before its split comes from a table with a row per split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .files import PROJECT, WIDE, read_text_files, source_lines, windows_1252
from .scratch import checkpoint

SPLIT = ["path", "split"]


def _in_split() -> WindowSpec:
    return Window.partitionBy(*SPLIT).orderBy("line_no")


def _above() -> WindowSpec:
    return _in_split().rowsBetween(Window.unboundedPreceding, -1)


def _file() -> WindowSpec:
    return Window.partitionBy("path")


def _earlier() -> WindowSpec:
    """Of a row per split: the earlier splits of its file."""
    return _file().orderBy("split").rowsBetween(Window.unboundedPreceding, -1)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pver_id, path, split, line_no, text) of all files below path, split by spark.sql.files.maxPartitionBytes.

    A file is taken as UTF-8 if all its lines are, else as Windows-1252; a UTF-8 mark is dropped. Lines end with \\n, \\r\\n or \\r, and are
    numbered from 1 over the whole file. Files with a UTF-16 mark cannot be cut at bytes; each is read whole, as one split. Empty files have no lines.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    named = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # the metadata have the path as a URI
    raw = raw.select(named.alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    head = F.hex(F.substring(F.col("value").cast("binary"), 1, 3))
    splits = checkpoint(raw.groupBy(*SPLIT).agg(F.count("*").alias("n"), F.bool_and(F.is_valid_utf8("value")).alias("valid"), F.min_by(head, "at").alias("mark")))
    splits = splits.select(*SPLIT, F.coalesce(F.sum("n").over(_earlier()), F.lit(0)).alias("above"), F.bool_and("valid").over(_file()).alias("valid"), F.min_by("mark", "split").over(_file()).alias("mark"))
    wide = F.substring("mark", 1, 4).isin(*WIDE)
    numbered = raw.withColumn("i", F.row_number().over(Window.partitionBy(*SPLIT).orderBy("at"))).join(splits.where(~wide), SPLIT).withColumn("line_no", F.col("above") + F.col("i"))
    content = F.col("value").cast("binary")
    text = F.when((F.col("mark") == "EFBBBF") & (F.col("line_no") == 1), F.make_valid_utf8(F.substring(content, 4, 2**31 - 1).cast("string"))).when((F.col("mark") == "EFBBBF") | F.col("valid"), F.make_valid_utf8("value"))
    lines = numbered.select(F.regexp_extract("path", PROJECT, 1).alias("pver_id"), *SPLIT, "line_no", text.otherwise(windows_1252(content)).alias("text"))
    whole = [r["path"] for r in splits.where(wide).select("path").distinct().collect()]  # names of UTF-16 files
    if not whole:
        return lines
    return lines.unionByName(source_lines(read_text_files(spark, whole)).select("pver_id", "path", F.lit(0).cast("long").alias("split"), F.col("line_no").cast("long"), "text"))


def _carried(lines: DataFrame, **last: tuple[Column, Column]) -> DataFrame:
    """Per split and for each name its (value, where): the value of the last line of all earlier splits of the file for which it holds."""
    found = lines.groupBy(*SPLIT).agg(*[F.max_by(value, F.when(where, F.col("line_no"))).alias(name) for name, (value, where) in last.items()])
    return found.select(*SPLIT, *[F.last(name, ignorenulls=True).over(_earlier()).alias(f"{name}_before") for name in last])


def log_blocks(lines: DataFrame) -> DataFrame:
    """S04 over lines: (pver_id, path, block_no, block), numbered over each file, lines joined by \\n.

    A block runs from a line that begins with `[` to the next line that ends with `]`, and takes the `>` lines right after it; a last block
    that nothing ends is none. A line that ends with `]` leaves all blocks and one that only begins with `[` is inside one, whatever stood
    before, so that the last such line of the earlier splits tells each split its state. Lines without text belong to no block of their own.
    """
    starts, ends = F.col("text").rlike(r"^[ \t]*\["), F.col("text").rlike(r"\][ \t]*$")
    marked = lines.where("text is not null").withColumn("inside", F.when(ends, 0).when(starts, 1))
    known = marked.join(_carried(marked, inside=(F.col("inside"), F.col("inside").isNotNull())), SPLIT)
    within = F.coalesce(F.last("inside", ignorenulls=True).over(_above()), F.col("inside_before"), F.lit(0)) == 1
    known = known.withColumn("within", within).withColumn("opens", ~F.col("within") & starts).withColumn("closes", ends & (F.col("within") | starts))
    known = known.withColumn("quote", ~F.col("within") & ~F.col("opens") & F.col("text").startswith(">"))
    counts = known.groupBy(*SPLIT).agg(F.count_if("opens").alias("n"), F.max(F.when(F.col("closes"), F.col("line_no"))).alias("closed"))
    counts = counts.select(*SPLIT, F.coalesce(F.sum("n").over(_earlier()), F.lit(0)).alias("blocks_before"), F.max("closed").over(_file()).alias("last_closed"))
    before = _carried(known, begun=(F.col("line_no"), F.col("opens")), ended=(F.col("closes"), ~F.col("quote")))
    known = known.join(counts.join(before, SPLIT), SPLIT)
    begun = F.coalesce(F.last(F.when(F.col("opens"), F.col("line_no")), ignorenulls=True).over(_in_split()), F.col("begun_before"))
    after_end = F.coalesce(F.last(F.when(~F.col("quote"), F.col("closes")), ignorenulls=True).over(_above()), F.col("ended_before"), F.lit(False))
    number = F.col("blocks_before") + F.count_if("opens").over(_in_split())
    rows = known.select("pver_id", "path", "line_no", "text", "last_closed", begun.alias("begun"), number.alias("block_no"), (F.col("within") | F.col("opens") | (F.col("quote") & after_end)).alias("part"))
    rows = rows.where(F.col("part") & (F.col("begun") < F.col("last_closed") + 1))
    block = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")  # a block is one message
    return rows.groupBy("pver_id", "path", "block_no").agg(block.alias("block"))
