"""What the operators share: reading tables, cutting lineage, connected components and small stream helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as a Java and DuckDB regular expression: a run without blank, tab or line-ending controls.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's folder below the one that spark.checkpoint.dir names; a temporary one where none is set, as in tests, and only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not in use."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def reread(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet files into the shared folder and opened again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near(df: DataFrame, rows: int) -> DataFrame:
    """df, a cheap one to count (a checkpoint), to be broadcast if it has no more rows than that, else as it is."""
    return F.broadcast(df) if df.count() <= rows else df


def fold(doc_id, modulus: int):
    """crc32 of the id's decimal text, modulo; null ids fall into fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0))


def slices(lengths: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive [i, j) whose lengths sum to at most limit, or that hold a single longer item."""
    i, total = 0, 0
    for j, n in enumerate(lengths):
        if j > i and total + n > limit:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(lengths):
        yield i, len(lengths)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def text_slices(batch: pa.RecordBatch, place: int, limit: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Consecutive rows [i, j) of a batch and their texts of at most limit bytes together, or a single longer one; only these are held."""
    column = batch.column(place)
    for i, j in slices(pc.binary_length(column).fill_null(0).to_pylist(), limit):
        yield i, j, utf8(column.slice(i, j - i))


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Splits a stream that is sorted by keys into one table per key value; only the open group is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, value in enumerate(zip(*columns)):
            if value != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, value
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): component is the smallest node that can be reached.

    Alternates the large-star and the small-star step. Each step is one pre-aggregated minimum and one join, so a hub
    with very many neighbours is split by partial aggregation and by the skew join; lineage is cut every round.
    """
    now = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:  # a logarithmic number of rounds
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = checkpoint(small.select("e.u", "e.v").where("u <> v").distinct())
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == seen:
            break
        seen = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select("v", "v").distinct().toDF("node", "component"))
