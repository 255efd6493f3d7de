"""Operator 10, exact top-k search by inner product: Voronoi kNN join.

Pivots, a bounded sample of the data whose number grows with it, cut the space into cells: every query and every candidate
belongs to the pivot at the least angle. First each query meets the candidates of its own cell; the k-th best score there is
its floor, as no result of it scores less. Angles obey the triangle inequality, so a query q at angle a from its pivot and a
candidate x at angle b from it have q.x <= |q| |x| cos(b - a). A cell's queries of like reach are a group, summed up by their least and
largest angle and their least floor / |q|. A cell of candidates, summed up by its largest angle and norm, is left out for a
group as a whole where even that can't reach the floor; its other candidates are tested one by one, and copies are made only for the
groups that may need them. Queries that most of a sample would pass, those that lie alone, can't be bounded: they share one group, as
they need one copy of a candidate and not one each. Queries and candidates of a group meet in blocks of bounded size; each
block keeps its own k best, and these are merged.

Ties go to the smaller id. Vectors that are null, hold null or non-finite components, or whose length is not the most common
one, take no part, nor do rows without an id. Fewer than k candidates give fewer rows. Repeated ids are rows of their own, but
for the query's own id. Components are turned into floor(1024 * x) as 64-bit integers; scores beyond 64 bits are not defined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, key_groups, table

K = 10
#: Rows that tell how many candidates a query would need; of these the first are pivots, the root of the rows but at least LEAST_PIVOTS.
SAMPLE, LEAST_PIVOTS = 2048, 16
QUERY_BLOCK, DATA_BLOCK = 1024, 20_000
#: Queries that more than this share of the sample would be needed for are one group.
WIDE = 0.25
#: A cell's queries are told apart by their reach, in so many steps a radian.
BANDS = 4
#: More than rounding can take away from angles and bounds.
SLACK = 1e-6
#: Below this a sum of products is exact in double precision.
EXACT = 2.0**53


def matrix(batch: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = batch.combine_chunks() if isinstance(batch, pa.ChunkedArray) else batch
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), flat.dtype)


def valid_vectors(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """(id, v array<bigint>) of the vectors that take part."""
    scaled = F.transform(F.col(vec), lambda x: F.floor(F.lit(1024.0) * x.cast("double")))
    fine = F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    good = vectors.where(F.col(vec_id).isNotNull() & fine & (F.size(vec) > 0)).select(F.col(vec_id).alias("id"), scaled.alias("v"))
    usual = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return good.join(F.broadcast(usual), F.size("v") == F.col("d")).drop("d")


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All inner products as 64-bit integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64) if bound < EXACT else q.astype(np.int64) @ x.astype(np.int64).T


def _angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles from the unit vectors pivots) of rows; a zero row lies at angle 0 from everything."""
    norm = np.sqrt((x**2).sum(1))
    cosine = x @ pivots.T / np.where(norm == 0, 1, norm)[:, None]
    return norm, np.where((norm == 0)[:, None], 0, np.arccos(np.clip(cosine, -1, 1)))


def _cells(pivots: np.ndarray):
    """(id, v, asks, cell, angle, norm): each row's cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(i, QUERY_BLOCK)
                norm, angle = _angles(matrix(part.column(1)).astype(np.float64), pivots)
                cell = angle.argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell]), pa.array(norm)], ["id", "v", "asks", "cell", "angle", "norm"])

    return run


def may_reach(norm: np.ndarray, angle: np.ndarray, low, high, least) -> np.ndarray:
    """Whether a candidate at these angles from a pivot may score least * |q| with a query q at an angle from low to high."""
    apart = np.maximum(0, np.maximum(angle - high, low - angle) - SLACK)
    return norm * np.cos(np.minimum(apart, np.pi)) + SLACK * (1 + norm) >= least


def _reach(pivots: np.ndarray, sample: np.ndarray):
    """(id, v, cell, angle, least, band) of queries (id, v, cell, angle, norm, floor); least is floor / |q|, band null for what most of the sample passes."""
    norms, angles = _angles(sample.astype(np.float64), pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle, norm = (batch.column(c).to_numpy() for c in ("cell", "angle", "norm"))
            floor = batch.column("floor").cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
            least = np.where(norm > 0, floor / np.where(norm > 0, norm, 1), -np.inf)
            share = np.array([may_reach(norms, angles[:, c], a, a, m).mean() for c, a, m in zip(cell, angle, least)])
            reach = angle + np.arccos(np.clip(least / max(norms.max(), 1e-300), -1, 1))
            band = pa.array((reach * BANDS).astype(np.int32), pa.int32(), mask=share > WIDE)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), batch.column("cell"), batch.column("angle"), pa.array(least), band], ["id", "v", "cell", "angle", "least", "band"])

    return run


def _place(pivots: np.ndarray, groups: np.ndarray, cells: np.ndarray, wide: bool):
    """(id, v, groups) of candidates (id, v, cell): the groups that may need them.

    groups has a row (pivot, least angle, largest angle, least) a group, cells a row (largest angle, largest norm) a cell. The group
    of queries without a bound is the last one.
    """
    of, low, high, least = groups[:, 0].astype(int), groups[:, 1], groups[:, 2], groups[:, 3]
    between = np.arccos(np.clip(pivots[of] @ pivots.T, -1, 1))  # of a group's pivot and a cell's
    nearest = np.maximum(0, between - cells[:, 0])
    open_ = may_reach(cells[:, 1], nearest, np.zeros(len(of))[:, None], high[:, None], least[:, None])  # groups x cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, DATA_BLOCK):
                part = batch.slice(i, DATA_BLOCK)
                hit = open_[:, part.column("cell").to_numpy()].T.copy()
                rows = np.flatnonzero(hit.any(1))
                if len(rows):
                    norm, angle = _angles(matrix(part.column("v")).astype(np.float64)[rows], pivots[of])
                    hit[rows] &= may_reach(norm[:, None], angle, low, high, least)
                if wide:
                    hit = np.concatenate([hit, np.ones((len(hit), 1), bool)], 1)
                row, g = np.nonzero(hit)
                ends = np.concatenate([[0], np.cumsum(hit.sum(1))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.ListArray.from_arrays(ends, pa.array(g, pa.int32()))], ["id", "v", "groups"])

    return run


def top_k(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best in x without itself, ties to the smaller id."""
    order = np.argsort(x_id, kind="stable")
    x, x_id = x[order], x_id[order]
    score = scores(q, x)
    ids, cands, best_scores = [], [], []
    for i in range(len(q)):
        keep = np.flatnonzero(x_id != q_id[i])
        s = score[i, keep]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            near = np.flatnonzero(s >= edge)
            keep, s = keep[near], s[near]
        best = np.lexsort((x_id[keep], -s))[:k]
        ids.append(np.full(len(best), q_id[i]))
        cands.append(x_id[keep][best])
        best_scores.append(s[best])
    return np.concatenate(ids), np.concatenate(cands), np.concatenate(best_scores)


def _solve(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["group", "qb", "db"]):
            side = group.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
            v, ids = matrix(group.column("v")), group.column("id").to_numpy()
            if side.any() and (~side).any():
                q, x, s = top_k(v[side], ids[side], v[~side], ids[~side], k)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(x), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def _met(asked: DataFrame, given: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): the k best of each query among the candidates of its group, from asked and given (id, v, group).

    Blocks: a group's queries and its candidates are cut by hash so that a task holds a bounded number of each.
    """
    n_data = given.groupBy("group").agg(F.ceil(F.count("*") / DATA_BLOCK).alias("nd"))
    n_queries = asked.groupBy("group").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("nq"))
    plan = F.broadcast(checkpoint(n_queries.join(n_data, "group").select("group", F.col("nq").cast("int"), F.col("nd").cast("int"))))  # a row per group, that is some per pivot
    asked, given = asked.join(plan, "group"), given.join(plan, "group")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = asked.select("id", "v", F.lit(True).alias("is_query"), "group", F.pmod(F.xxhash64("id"), "nq").cast("int").alias("qb"), every("nd").alias("db"))
    given = given.select("id", "v", F.lit(False).alias("is_query"), "group", every("nq").alias("qb"), F.pmod(F.xxhash64("id"), "nd").cast("int").alias("db"))
    met = asked.unionByName(given).repartition("group", "qb", "db").sortWithinPartitions("group", "qb", "db")
    found = met.mapInArrow(_solve(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def placed(rows: DataFrame, k: int, pivots: int | None) -> tuple[DataFrame, DataFrame] | None:
    """Queries (id, v, group) and candidates (id, v, groups) of rows (id, v, asks); None without any query."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    if sample.empty or rows.where("asks").isEmpty():
        return None
    known = np.stack(sample["v"].to_numpy())
    n_pivots = min(len(known), pivots or max(LEAST_PIVOTS, int(rows.count() ** 0.5)))
    centers = known[:n_pivots].astype(np.float64)
    centers = centers / np.maximum(np.sqrt((centers**2).sum(1)), 1e-300)[:, None]
    celled = checkpoint(rows.select("id", "v", "asks").mapInArrow(_cells(centers), "id long, v array<bigint>, asks boolean, cell int, angle double, norm double"))
    own = _met(celled.where("asks").select("id", "v", F.col("cell").alias("group")), celled.select("id", "v", F.col("cell").alias("group")), k)
    floors = own.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    asked = celled.where("asks").join(floors, "id", "left").select("id", "v", "cell", "angle", "norm", "floor")
    told = checkpoint(asked.mapInArrow(_reach(centers, known), "id long, v array<bigint>, cell int, angle double, least double, band int"))
    # A row per cell and band at most, and a row per cell.
    groups = told.where("band is not null").groupBy("cell", "band").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("least").alias("least")).orderBy("cell", "band").toPandas()
    cells = celled.groupBy("cell").agg(F.max("angle").alias("angle"), F.max("norm").alias("norm")).toPandas()
    summary = np.zeros((n_pivots, 2))
    summary[cells["cell"]] = cells[["angle", "norm"]]
    wide = not told.where("band is null").isEmpty()
    numbers = rows.sparkSession.createDataFrame([(int(c), int(b), g) for g, (c, b) in enumerate(zip(groups["cell"], groups["band"]))], "cell int, band int, number int")
    query_groups = told.join(F.broadcast(numbers), ["cell", "band"], "left").select("id", "v", F.coalesce("number", F.lit(len(groups))).alias("group"))
    place = _place(centers, groups[["cell", "low", "high", "least"]].to_numpy(np.float64), summary, wide)
    return query_groups, checkpoint(celled.select("id", "v", "cell").mapInArrow(place, "id long, v array<bigint>, groups array<int>"))


def knn(vectors: DataFrame, is_query, vec_id: str = "vec_id", vec: str = "embedding", k: int = K, pivots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest integer inner product with each query row, without itself."""
    rows = checkpoint(valid_vectors(vectors, vec_id, vec).withColumn("asks", F.coalesce(is_query(F.col("id")), F.lit(False))))
    sides = placed(rows, k, pivots)
    if sides is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, given = sides
    return _met(asked, given.select("id", "v", F.explode("groups").alias("group")), k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % 100 == 0)


SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (
  select q.vec_id as query_id, x.vec_id, cast(list_inner_product(q.v, x.v) as bigint) as score
  from e q join e x on q.vec_id <> x.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""
