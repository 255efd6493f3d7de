"""Operator 7, mixing sources to target weights by subset-sum budget fitting.

Every source's target is its share of the total size by weight, at most max_repeats times its own size; what is cut off is
shared again by weight among the others. A source first gives each document floor(target / size) whole times. For the rest
of its budget, documents are counted by exact size, the same share of each size is taken, and a bounded-knapsack dynamic
program over the counts that are left fits the remaining budget as closely as sums of sizes allow (fit). Which documents of a
size are taken is decided by a seeded hash of their ids, so reruns agree.

Null texts have size 0 and are never taken. A null source is a source of its own, in last place. Without rows, or if all
sizes are 0, targets are 0. Rows that repeat an id with the same size are taken or left together. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, near, table

WEIGHTS, MAX_REPEATS, SEED = (5.0, 2.0, 1.0), 3, 7
#: The knapsack's window in words, and the sums it keeps where the window is wider; bounds of memory (5 and some 60 bytes each).
MAX_WINDOW, MAX_SUMS = 1 << 25, 1 << 22
#: Documents of one source and size are cut by hash into as many buckets as leave so few rows of the whole table in each.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 64
#: Plans (one row per source and size) of more rows than this are not broadcast.
PLAN_ROWS = 1 << 18
#: Without a broadcast, rows of one source and size are dealt over as many tasks by hash.
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    target = least(weight * level, max_repeats * source_size) with the level at which targets sum to the total: sources that
    reach their cap first come first in the order of cap / weight, so running sums give the level without iterating.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level)
    #: the first source whose cap is not reached fixes the level of all that follow
    free = F.min_by("level", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("cap") / F.col("weight"))).over(Window.partitionBy())
    return levels.select("source", "source_size", "weight", F.least("cap", F.coalesce(free * F.col("weight"), F.col("cap"))).alias("target"))


def _items(sizes: np.ndarray, counts: np.ndarray, width: int):
    """(size's place, how many, their summed size) from the least size on, counts in powers of two."""
    for i in np.argsort(sizes, kind="stable"):
        size = int(sizes[i])
        n, step = min(int(counts[i]), width // size), 1
        while n:
            k = min(step, n)
            yield int(i), k, k * size
            n, step = n - k, step * 2


def _nearest(sizes: np.ndarray, counts: np.ndarray, budget: float, enough: float) -> tuple[float, np.ndarray]:
    """How many of each size (at most counts) sum as near to budget as any choice does, by a bounded knapsack; and how far off that is.

    Every sum notes the item that first reached it. A sum at most enough off ends the search; sums past budget and the largest
    size are never nearest. The sums are marks in a window of budget and the largest size; a wider window than MAX_WINDOW, that of
    very long documents, has few of its sums reached, and these are kept as a sorted list, up to MAX_SUMS of them.
    """
    width = int(budget) + int(sizes.max()) + 1
    items: list[tuple[int, int]] = []
    if width <= MAX_WINDOW:
        reach, made_by = np.zeros(width + 1, bool), np.full(width + 1, -1, np.int32)
        reach[0] = True
        near = [x for x in range(max(0, int(np.ceil(budget - enough - 1e-9))), min(width, int(budget + enough + 1e-9)) + 1)]
        top = 0
        for i, k, weight in _items(sizes, counts, width):
            to = min(top, width - weight)
            new = np.flatnonzero(reach[: to + 1] & ~reach[weight : weight + to + 1]) + weight
            reach[new], made_by[new] = True, len(items)
            items.append((i, k))
            top = min(width, top + weight)
            if reach[near].any():
                break
        sums = np.flatnonzero(reach)
        made = made_by[sums]
    else:
        sums, made = np.zeros(1, np.int64), np.full(1, -1, np.int32)
        for i, k, weight in _items(sizes, counts, width):
            new = np.setdiff1d(sums[: np.searchsorted(sums, width - weight, "right")] + weight, sums, assume_unique=True)
            both = np.concatenate([sums, new])
            order = np.argsort(both, kind="stable")
            sums, made = both[order], np.concatenate([made, np.full(len(new), len(items), np.int32)])[order]
            items.append((i, k))
            if len(sums) > MAX_SUMS or np.abs(sums - budget).min() <= enough + 1e-9:
                break
    at = int(sums[np.argmin(np.abs(sums - budget))])
    off, take = abs(at - budget), np.zeros(len(sizes), np.int64)
    while at:
        i, k = items[made[np.searchsorted(sums, at)]]
        take[i] += k
        at -= k * int(sizes[i])
    return off, take


def _filled(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """Largest sizes first, as many as fit, and one more of the size that brings the sum nearer, if there is one."""
    take, rest = np.zeros(len(sizes), np.int64), budget
    for i in np.argsort(-sizes, kind="stable"):
        take[i] = min(int(counts[i]), int(rest // int(sizes[i])))
        rest -= int(take[i]) * int(sizes[i])
    left = np.flatnonzero(take < counts)
    if len(left):
        i = left[np.argmin(np.abs(rest - sizes[left]))]
        take[i] += abs(rest - int(sizes[i])) < rest
    return take


def fit(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each size to take, at most counts, so that the summed size comes as near to budget as any choice does.

    No sum is nearer than the nearest multiple of the sizes' greatest common divisor, by which everything is divided. Filling up
    from the largest size on is the first choice, which the others must beat. Then the even share of every size, and a knapsack over the counts
    that are left fits the rest; if that misses the multiple, less is given by share and more is left to the knapsack, in the
    end everything. Only where that last knapsack would pass both MAX_WINDOW and MAX_SUMS can a nearer sum be missed.
    """
    take = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero((sizes > 0) & (counts > 0))
    if not len(some) or budget <= 0:
        return take
    s, c = sizes[some].astype(np.int64), counts[some].astype(np.int64)
    if budget >= int((s * c).sum()):
        take[some] = c
        return take
    unit = int(np.gcd.reduce(s))
    s, budget = s // unit, budget / unit
    total = int((s * c).sum())
    enough = min(budget % 1, 1 - budget % 1)
    share = np.floor(c * (budget / total)).astype(np.int64)
    largest = share.copy()  # beyond the share, large documents until a few of their sizes are left: a small window
    rest = budget - float((s * share).sum())
    for i in np.argsort(-s, kind="stable"):
        n = min(int(c[i] - largest[i]), max(0, int(rest - 2 * int(s.max())) // int(s[i])))
        largest[i] += n
        rest -= n * int(s[i])
    take[some] = _filled(s, c, budget)
    best = abs(budget - float((s * take[some]).sum()))
    for first in (largest, share, share // 2, share // 8, share * 0):
        if best <= enough + 1e-6:
            break
        rest = max(0.0, budget - float((s * first).sum()))
        off, more = _nearest(s, c - first, rest, enough)
        if off < best:
            best, take[some] = off, first + more
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    size, n = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    whole = int(rows["target"][0] // rows["source_size"][0]) if rows["source_size"][0] else 0
    quota = fit(size, n, rows["target"][0] - whole * rows["source_size"][0])
    return rows[["key", "size", "source_size", "target"]].assign(whole=whole, quota=quota)


def mix(docs: DataFrame, source: str, size: Column, doc_id: str, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> DataFrame:
    """(row, size, source_size, target, times): row holds all columns of docs, times is how often the mix takes the document.

    The largest group is never gathered: documents of one source and size are counted within hash buckets, running sums of
    these counts tell in which bucket the quota ends, and only that bucket's rows are numbered to find the cut. The plan, a row
    per source and size, is broadcast if it is small by its counted rows; then no document moves.
    """
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.to_json(F.struct(F.col(f"`{source}`").alias("s"))).alias("key"),  # null is a key like any other
        size.alias("size"),
        F.xxhash64(F.col(f"`{doc_id}`"), F.lit(seed)).alias("hash"),
        F.col(f"`{doc_id}`").alias("id"),
        F.col(f"`{source}`").alias("source"),
    )
    slim = checkpoint(own.drop("row"))
    buckets = max(LEAST_BUCKETS, slim.count() // BUCKET_ROWS)
    bucket = F.pmod("hash", F.lit(buckets))
    counts = checkpoint(slim.groupBy("key", "size", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.first("source").alias("source")))
    per_source = counts.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.first("source").alias("source"))
    aims = targets(per_source.select("source", "source_size"), weights, max_repeats)
    aims = aims.select(F.to_json(F.struct(F.col("source").alias("s"))).alias("key"), "source_size", "target")
    by_size = counts.groupBy("key", "size").agg(F.sum("n").alias("n"))
    quotas = checkpoint(by_size.join(aims, "key").groupBy("key").applyInPandas(_fit_source, "key string, size long, source_size long, target double, whole long, quota long"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = counts.withColumn("start", start).join(near(quotas.select("key", "size", "quota"), PLAN_ROWS), ["key", "size"]).where((F.col("start") < F.col("quota")) & (F.col("quota") <= F.col("start") + F.col("n")))
    number = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("hash", "id"))
    ends = checkpoint(ends.select("key", "size", "bucket", (F.col("quota") - F.col("start")).alias("here")))
    cuts = (
        slim.withColumn("bucket", bucket).join(near(ends, PLAN_ROWS), ["key", "size", "bucket"])
        .withColumn("number", number).where("number = here").select("key", "size", F.struct("bucket", "hash", "id").alias("cut"))
    )
    plan = checkpoint(quotas.join(cuts, ["key", "size"], "left"))
    more = (F.struct(bucket.alias("bucket"), "hash", "id") <= F.col("cut")) & (F.col("size") > 0)
    if plan.count() <= PLAN_ROWS:
        met = own.join(F.broadcast(plan), ["key", "size"])
    else:
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = own.withColumn("salt", F.pmod(F.xxhash64("hash"), F.lit(SALTS)).cast("int")).join(salted, ["key", "size", "salt"])
    return met.select("row", "size", "source_size", "target", (F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).alias("times"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = checkpoint(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    done = mix(sized, "source", F.col("size"), "doc_id")
    return done.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents as the mix takes them: a document taken twice stands in two rows, one that is not taken goes."""
    done = mix(docs, "source", word_count(F.col("text")), "doc_id").where("times > 0")
    return done.select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
