
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import safe_name

VARIABLE_INFO = "group_id int, location string, variable string, no_of_paths int, no_of_traces int, paths array<struct<path_id:int,function_sequence:array<string>,call_stack:array<string>>>, "
_OCCURRENCE = "struct<location:string,access:string,function:string,callee:string,line_text:string>"
VARIABLE_INFO = VARIABLE_INFO + (
    "variable_info struct<symbol_name:string,index_expression:string,member_path:array<string>>, symbol_infos array<struct<symbol_name:string,role:string,kind:string,datatype:string,array_dims:array<string>,"
    "resolved_sizes:array<int>,size_known:boolean,scope:string,declared_in_function:string,declaration_line:int,declaration_text:string,declaration_kind:string,access_counts:map<string,bigint>,"
    f"used_in_functions:array<string>,passed_to:array<struct<function:string,location:string,mode:string>>,occurrence_count:int,occurrences_truncated:boolean,occurrences:array<{_OCCURRENCE}>,"
    "index_expression:string,dimension_index:int,parent_symbol:string,member_of:string,pointed_type:string>>, enclosing_function string"
)


#: The project of a file: its parent folder.
PROJECT = r"([^/]+)/[^/]+$"
#: Byte order marks of UTF-16.
WIDE = ("FFFE", "FEFF")
#: Windows-1252 is ISO-8859-1 but for these 32 bytes, five of which have no character.
_HIGH = bytes(range(0x80, 0xA0))


def windows_1252(content: Column) -> Column:
    """Bytes as a Windows-1252 text, with replacement."""
    return F.translate(F.decode(content, "ISO-8859-1"), _HIGH.decode("latin-1"), _HIGH.decode("cp1252", "replace"))


def read_text_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(pver_id, path, text); the encoding from the byte order mark, else UTF-8, else Windows-1252. pver_id is the parent folder. A text is one value here; lines.read_lines splits large files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    mark = F.hex(F.substring("content", 1, 3))
    text = (
        F.when(mark.startswith("FFFE"), F.decode(F.expr("substring(content, 3)"), "UTF-16LE"))
        .when(mark.startswith("FEFF"), F.decode(F.expr("substring(content, 3)"), "UTF-16BE"))
        .when(mark == "EFBBBF", F.make_valid_utf8(F.expr("substring(content, 4)").cast("string")))
        .when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
        .otherwise(windows_1252(F.col("content")))
    )
    return files.select(F.regexp_extract("path", PROJECT, 1).alias("pver_id"), "path", text.alias("text"))


def source_lines(texts: DataFrame) -> DataFrame:
    """Lines numbered from 1; a last empty piece is no line."""
    pieces = F.split("text", "\r\n?|\n")
    lines = F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return texts.select("pver_id", "path", F.posexplode(lines).alias("i", "text")).select("pver_id", "path", (F.col("i") + 1).alias("line_no"), "text")


def read_alarms(texts: DataFrame) -> DataFrame:
    """S03 over whole texts."""
    return alarm_rows(source_lines(texts))


def alarm_rows(lines: DataFrame) -> DataFrame:
    """Alarm rows of the lines of CSV files: an optional `sep=` line, a header, `;` between fields; each row as a map of trimmed names to trimmed values."""
    lines = lines.where("trim(text) <> '' and not lower(text) like 'sep=%'")
    head = lines.groupBy("path").agg(F.min_by("text", "line_no").alias("head"), F.min("line_no").alias("first"))
    # A field is quoted, and may then hold the separator and doubled quotes, or runs up to the separator.
    cut = lambda c: F.regexp_extract_all(F.concat(F.lit(";"), F.regexp_replace(c, "^\ufeff", "")), F.lit(r';\s*("(?:[^"]|"")*"[^;]*|[^;]*)'), 1)
    bare = lambda x: F.when(x.rlike('^".*"\\s*$'), F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    fields = lambda c: F.transform(cut(c), lambda x: F.trim(bare(x)))
    rows = lines.join(head, "path").where(F.col("line_no") > F.col("first"))
    return rows.select("pver_id", "path", F.col("line_no").alias("alarm_seq"), F.map_from_entries(F.arrays_zip(fields(F.col("head")), F.slice(F.concat(fields(F.col("text")), F.array_repeat(F.lit(""), F.size(fields(F.col("head"))))), F.lit(1), F.size(fields(F.col("head")))))).alias("row"))


def read_trace_blocks(texts: DataFrame) -> DataFrame:
    """Blocks of a message log: from a line that begins with `[` to the next line that ends with `]`, and the `>` lines after it."""
    blocks = F.regexp_extract_all("text", F.lit(r"(?ms)^[ \t]*\[.*?\][ \t]*$(?:\r?\n>[^\n]*)*"), 0)
    return texts.select("pver_id", F.posexplode(blocks).alias("i", "block")).select("pver_id", (F.col("i") + 1).alias("block_no"), "block")


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """The call stack, the alarm line and the source lines of a block."""
    lines = F.filter(F.transform(F.split(F.regexp_replace("block", r"^[ \t]*\[|\][ \t]*(?=\r?\n>|$)", ""), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    stack = F.filter("ls", lambda x: x.startswith("call#"))
    alarm = F.element_at(F.filter("ls", lambda x: x.contains("ALARM")), 1)
    source = F.transform(F.filter("ls", lambda x: x.startswith(">")), lambda x: F.regexp_replace(x, "^>", ""))
    found = F.regexp_extract(alarm, r"at (\S+:\d+\.\d+-(?:\d+\.)?\d+)", 1)
    return blocks.withColumn("ls", lines).select("pver_id", "block_no", stack.alias("call_stack"), alarm.alias("alarm"), source.alias("source_lines"), F.when(found != "", found).otherwise(F.concat(F.lit("UNKNOWN_LOCATION::"), F.coalesce(alarm, F.lit("")))).alias("location"))


def read_variable_info(spark: SparkSession, path: str) -> DataFrame:
    """Groups with their paths, the alarmed access and all that is known of its symbols; from a list over many lines, or a group a line as written here."""
    first = spark.read.text(path).where("trim(value) <> ''").first()
    return spark.read.schema(VARIABLE_INFO).option("multiLine", first is not None and first[0].lstrip().startswith("[")).json(path)


def write_variable_info(groups: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").json(path)


def read_cfg(texts: DataFrame) -> DataFrame:
    """Edges (pver_id, caller, pos, callee) of JSON maps from callers to lists; a caller without callees keeps a row with null."""
    entries = texts.select("pver_id", F.explode(F.from_json("text", "map<string,array<string>>")).alias("caller", "callees"))
    return entries.select("pver_id", "caller", F.posexplode_outer("callees").alias("pos", "callee"))


def cfg_json(edges: DataFrame) -> DataFrame:
    """One JSON map per project; a caller's list is bounded by the functions it calls."""
    lists = edges.groupBy("pver_id", "caller").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("callee").isNotNull(), F.struct("pos", "callee")))), lambda x: x["callee"]).alias("callees"))
    return lists.groupBy("pver_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("caller", "callees"))))).alias("text"))


def write_events(events: DataFrame, path: str) -> None:
    """Appends JSON lines; times keep their microseconds."""
    events.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)


def write_artifact(df: DataFrame, path: str, stage: str) -> None:
    """Rows under pver_id / safe order / stamp."""
    df.withColumn("safe_order", safe_name(F.col("order_key"))).write.mode("append").partitionBy("pver_id", "safe_order", "stamp").parquet(f"{path}/{stage}")


def read_artifact(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """The rows of a stage, of all projects, orders and stamps; names of folders stay texts, whatever they look like."""
    folder = f"{path}/{stage}"
    named = {"pver_id", "safe_order", "stamp"}
    given = spark.read.option("basePath", folder).parquet(folder).schema
    schema = StructType([StructField(f.name, StringType()) if f.name in named else f for f in given])
    return spark.read.schema(schema).option("basePath", folder).parquet(folder)
