"""Operator 11, importance resampling towards a target distribution, with Arrow kernels.

A batch of texts becomes one list of words by ascii_lower and split_pattern_regex; list_flatten and dictionary_encode give
each place the index of its word. Shifted indices side by side are the n-grams; only distinct ones get a CRC, and from it a
bucket. take brings buckets, or the buckets' gains, back to the places, and sums over each document's stretch of them follow.

Two passes over the texts: tasks count buckets of documents and of target texts (a row per bucket and task, added up by
Spark); the gains, one number per bucket, go to every task of the second pass. What is ranked is ids and numbers only.
Rows are counted by score, a few ten thousand values whatever the number of rows, running sums of the counts say at which
rank each score begins, and rows are numbered within a score; equal rows are counted together first, so copies of one id are
never numbered one by one.

Null and empty texts have no features and weight 0. Rows without an id have a weight, but no score, and are never drawn. Rows that repeat
an id share its chance; they are ranked by id, then by n_features. Without target texts all t are 0. Empty tables give empty
results. Texts are read whole, in batches of bounded size or alone; extra columns take no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, near, slices, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEAST_N, MOST_N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 1, 10_000, 20, 10, 2024
#: Bytes of texts in a batch; a single longer one goes alone.
TEXT_BYTES = 1 << 23
#: Distinct scores up to this number are broadcast with their first ranks.
SCORE_ROWS = 1 << 20


def words_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts as a dictionary array, and the number of words of each text."""
    lists = pc.split_pattern_regex(pc.fill_null(pc.ascii_lower(texts), ""), pattern=SEPARATORS)
    flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    some = pc.not_equal(pc.binary_length(flat), 0)  # before the first and behind the last separator stands an empty one
    told = pc.dictionary_encode(pc.filter(flat, some))
    return told, np.bincount(owner[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def buckets_of(words: pa.DictionaryArray, n_words: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each run of n words in a text, number of runs of each text)."""
    index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    runs = np.maximum(n_words - n + 1, 0)
    starts = np.cumsum(n_words) - n_words
    at = np.repeat(starts - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())  # of each run, its first word
    raw = [w.encode() for w in words.dictionary.to_pylist()]
    crcs = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
    keys, crc = index[at], crcs
    for k in range(1, n):  # a run of k + 1 words is a run of k words, by its number, and a word
        keys, number = np.unique(keys * len(raw) + index[at + k], return_inverse=True)
        head, tail = keys // max(1, len(raw)), keys % max(1, len(raw))
        crc = np.fromiter((zlib.crc32(b" " + raw[t], int(crc[h])) for h, t in zip(head.tolist(), tail.tolist())), np.uint32, len(keys))
        keys = number
    return pc.take(pa.array(crc % np.uint32(buckets)), pa.array(keys)).to_numpy(zero_copy_only=False), runs


def _batches(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        column = batch.column(place)
        for i, j in slices(pc.binary_length(column).fill_null(0).to_pylist(), TEXT_BYTES):
            yield batch.slice(i, j - i), column.slice(i, j - i)


def bucket_counts(texts: DataFrame, text: str, least_n: int, most_n: int, buckets: int) -> DataFrame:
    """(bucket, n) over all runs of least_n to most_n words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, column in _batches(batches, 0):
            words, n_words = words_of(column)
            for n in range(least_n, most_n + 1):
                total += np.bincount(buckets_of(words, n_words, n, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return texts.select(F.col(f"`{text}`")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(given: DataFrame, wanted: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket from the counts of documents and of target texts."""
    s, t = (np.zeros(buckets) for _ in range(2))
    for counts, into in ((given, s), (wanted, t)):
        for bucket, n in counts.collect():  # a row for each bucket at most
            into[bucket] = n
    odds = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in odds], np.int64)


def weights(docs: DataFrame, text: str, gain: np.ndarray, least_n: int, most_n: int) -> DataFrame:
    """(id, n_features, n_words, weight) from docs (id, text): the floored mean of the gains of a text's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, column in _batches(batches, 1):
            words, n_words = words_of(column)
            n, total = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
            for k in range(least_n, most_n + 1):
                bucket, runs = buckets_of(words, n_words, k, len(gain))
                sums = np.concatenate([[0], np.cumsum(pc.take(pa.array(gain), pa.array(bucket)).to_numpy(zero_copy_only=False))])
                ends = np.cumsum(runs)
                n, total = n + runs, total + sums[ends] - sums[ends - runs]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(n_words.astype(np.int64)), pa.array(total // np.maximum(n, 1))], ["id", "n_features", "n_words", "weight"])

    return docs.mapInArrow(run, "id long, n_features long, n_words long, weight long")


def chance(doc_id: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln(u))) with u from a hash of the id: a Gumbel number, so that the best sums are a draw without replacement."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, least_words: int, percent: int) -> DataFrame:
    """scored (id, n_features, n_words, weight, score) with rank, for the best floor(percent / 100) of the rows with least_words words, else null."""
    fits = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    alike = checkpoint(scored.groupBy(*scored.columns).agg(F.count("*").alias("copies")))
    pool = alike.where(fits)
    by_score = checkpoint(pool.groupBy("score").agg(F.sum("copies").alias("n")))
    total = alike.where(F.col("n_words") >= least_words).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    quota = percent * total // 100
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = by_score.select("score", before.alias("before")).where(F.col("before") < quota)  # rows are distinct scores, some ten thousand
    marked = alike.join(near(checkpoint(reached), SCORE_ROWS), "score", "left").withColumn("before", F.when(fits, F.col("before")))
    within = Window.partitionBy("score").orderBy("id", "n_features", "n_words", "weight").rowsBetween(Window.unboundedPreceding, 0)
    drawn = marked.where(F.col("before").isNotNull()).withColumn("last", F.col("before") + F.sum("copies").over(within))
    drawn = drawn.select(*scored.columns, F.explode(F.sequence(F.col("last") - F.col("copies") + 1, F.col("last"))).alias("place"))
    drawn = drawn.select(*scored.columns, F.when(F.col("place") <= quota, F.col("place")).alias("rank"))
    left = marked.where(F.col("before").isNull()).select(*scored.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("place"))
    return drawn.unionByName(left.select(*scored.columns, F.lit(None).cast("long").alias("rank")))


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", least_n: int = LEAST_N, most_n: int = MOST_N,
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row; rank is null for what is not drawn."""
    gain = gains(bucket_counts(docs, text, least_n, most_n, buckets), bucket_counts(target, target_text, least_n, most_n, buckets), buckets)
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    scored = weights(slim, "text", gain, least_n, most_n).withColumn("score", F.col("weight") + chance(F.col("id"), seed))
    return ranked(scored, least_words, percent).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


SQL = f"""
with tab as (
  select list(list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as crcs from range(256) r(i)),
w as (
  select 'd' as side, doc_id as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from documents
  union all
  select 'b', null, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) from benchmark),
known as (select distinct word, hex(encode(word)) as h from w),
b as materialized (
  select word, xor(list_reduce([4294967295] || list_transform(range(0, len(h) // 2), lambda k: cast('0x' || substr(h, cast(2 * k + 1 as bigint), 2) as bigint)),
    lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from known, tab),
f as materialized (select side, id, bucket from w join b using (word)),
n as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from f group by bucket),
total as (select count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from f),
g as (select bucket, cast(floor(1000 * ln(((n.t + 1)::double * (total.s + {BUCKETS})::double) / ((n.s + 1)::double * (total.t + {BUCKETS})::double))) as bigint) as gain from n, total),
m as (select id as doc_id, count(*) as n_features, cast(sum(gain) as bigint) as gain from f join g using (bucket) where side = 'd' group by id),
d as (
  select doc_id, coalesce(n_features, 0) as n_features, coalesce((gain - ((gain % n_features) + n_features) % n_features) // n_features, 0) as weight,
    cast('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) as bigint)::double as h from documents left join m using (doc_id)),
e as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) as bigint) as score, count(*) filter (n_features >= {LEAST_WORDS}) over () as fit from d),
r as (select doc_id, row_number() over (order by score desc, doc_id) as place from e where n_features >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when place <= {PERCENT} * fit // 100 then place end as rank from e left join r using (doc_id)
"""
