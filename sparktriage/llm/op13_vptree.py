"""Operator 13, centroid clustering with a vantage-point tree over the centroids.

Each round builds a vantage-point tree over the centroids and sends it to the tasks, k centroids and nothing that grows with the
rows. A node holds a centroid, its vantage point; the others are halved by their distance from it, and each half notes its
least and largest distance. Every vector searches best first: it takes the open node of the least lower bound, tests that
node's centroids by exact integer distances, and opens the halves with the bound that the triangle inequality gives, until
no open node's bound reaches the best distance found. Bounds count inclusively and are widened by more than square roots can be off,
so a centroid at the same distance is always met, and the smaller number wins. The vectors of a block search at the same time.

Tasks give sums and counts per centroid (a row for each component), which Spark adds up; the new centroid is the exact floor
of sum / count. Vectors are read anew each round and never move; the table must give the same rows each time.

Vectors that are null, hold null or non-finite components or have not exactly dims of them take no part, nor do rows without
an id. Repeated ids are rows of their own; of equal hashes the smaller vector comes first. Fewer rows than k give as many centroids. No row
gives an empty result. Components beyond 2**26 are worked on as Python integers; distances beyond 64 bits are not defined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, table

DIMS, K, ROUNDS, SEED = 64, 8, 10, 3
#: Centroids in a leaf, at most.
LEAF = 2
#: Vectors that search at the same time, at most, and cells of the table of their open nodes.
BLOCK, TABLE = 4096, 1 << 23
#: Components below this have squared distances that are exact in double precision, for dims up to 512.
SMALL = 1 << 20
#: Components below this have squared distances of at most 64 bits, for dims up to 512.
FIT = 1 << 26


@dataclass
class Node:
    points: list[int]  # centroids that are tested when the node is visited: its vantage point, or a leaf's
    children: list[tuple[float, float, int]] = field(default_factory=list)  # least and largest distance from the vantage point, node


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v from c."""
    top = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top < SMALL:
        d = v.astype(np.float64) - c.astype(np.float64)
        return np.einsum("ij,ij->i", d, d).astype(np.int64)
    d = v.astype(object) - c.astype(object) if top >= FIT else v.astype(np.int64) - c.astype(np.int64)
    return (d * d).sum(1)


def build(centroids: np.ndarray, leaf: int = LEAF) -> list[Node]:
    """The tree's nodes, the root first. The vantage point is the centroid farthest from the first one of its part."""
    nodes: list[Node] = []

    def grow(part: np.ndarray) -> int:
        at = len(nodes)
        if len(part) <= leaf:
            nodes.append(Node(part.tolist()))
            return at
        far = np.array(squared(centroids[part], centroids[part[0]]), float)
        vantage = int(part[far.argmax()])
        rest = part[part != vantage]
        distance = np.sqrt(np.array(squared(centroids[rest], centroids[vantage]), float))
        order = np.argsort(distance, kind="stable")
        nodes.append(Node([vantage]))
        for half in (order[: len(order) // 2], order[len(order) // 2 :]):
            if len(half):
                nodes[at].children.append((float(distance[half].min()), float(distance[half].max()), grow(rest[half])))
        return at

    if len(centroids):
        grow(np.arange(len(centroids)))
    return nodes


def nearest(v: np.ndarray, centroids: np.ndarray, nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each row's nearest centroid, the smaller number of equals, and how many distances were worked out."""
    n, tests = len(v), 0
    best = np.full(n, -1)
    least = np.full(n, -1, np.int64 if max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0))) < FIT else object)
    radius = np.full(n, np.inf)  # the best distance, a little more than rounding can take away
    open_ = np.full((n, len(nodes)), np.inf)  # the lower bound of each node that waits, infinite for the others
    open_[:, 0] = 0
    live = np.arange(n)
    while len(live):
        choice = open_[live].argmin(1)
        bound = open_[live, choice]
        go = bound <= np.where(np.isfinite(radius[live]), radius[live], np.finfo(float).max)  # inclusive; infinite bounds wait no more
        live, choice = live[go], choice[go]
        for at in np.unique(choice):
            rows = live[choice == at]
            open_[rows, at] = np.inf
            node = nodes[at]
            for point in node.points:
                d = squared(v[rows], centroids[point])
                tests += len(rows)
                better = (best[rows] < 0) | (d < least[rows]) | ((d == least[rows]) & (point < best[rows]))
                least[rows[better]], best[rows[better]] = d[better], point
            radius[rows] = np.sqrt(least[rows].astype(float)) * (1 + 1e-9) + 1e-6
            if node.children:
                from_vantage = np.sqrt(d.astype(float))
                slack = 1e-9 * from_vantage + 1e-6
                for low, high, child in node.children:
                    open_[rows, child] = np.maximum(0, np.maximum(low * (1 - 1e-9) - from_vantage, from_vantage - high * (1 + 1e-9)) - slack)
    return best, least, tests


def kept(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, integer vectors) of the rows of (id, vector) that take part."""
    ids, column = batch.column(0), batch.column(1)
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims
    some = column.filter(pa.array(size)).flatten()
    x = some.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null becomes nan
    fine = np.isfinite(x).all(1) & np.asarray(ids.filter(pa.array(size)).is_valid())
    scaled = np.floor(1024.0 * x[fine])
    if np.abs(scaled).max(initial=0) < 2.0**62:
        whole = scaled.astype(np.int64)
    else:
        whole = np.array([[int(a) if np.isfinite(a) else int(b) * 1024 for a, b in zip(row, raw)] for row, raw in zip(scaled, x[fine])], object)
    return ids.filter(pa.array(size)).to_numpy(zero_copy_only=False)[fine].astype(np.int64), whole


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, nodes: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, min(BLOCK, TABLE // nodes))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            ids, v = kept(batch.slice(i, step), dims)
            if len(ids):
                yield ids, v


def _sums(centroids: np.ndarray, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(cluster, dim, total, n): a task's sums, a row for each centroid and component."""
    nodes = build(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(centroids), dims), object), np.zeros(len(centroids), np.int64)
        for _, v in _blocks(batches, dims, len(nodes)):
            best, _, _ = nearest(v, centroids, nodes)
            for c in np.unique(best):
                total[c] += v[best == c].sum(0).astype(object)
            n += np.bincount(best, minlength=len(centroids))
        some = np.flatnonzero(n)
        if len(some):
            rows = [np.repeat(some, dims), np.tile(np.arange(dims), len(some)), np.repeat(n[some], dims)]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array([str(x) for x in total[some].ravel()]), pa.array(rows[2], pa.int64())], ["cluster", "dim", "total", "n"])

    return run


def _assign(centroids: np.ndarray, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    nodes = build(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, v in _blocks(batches, dims, len(nodes)):
            best, least, _ = nearest(v, centroids, nodes)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(best, pa.int32()), pa.array(least.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    return run


def starts(vectors: DataFrame, k: int, dims: int, seed: int) -> np.ndarray:
    """The vectors of (_id, _vec) that take part and whose ids hash least, as k centroids."""
    fine = F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    first = vectors.where(fine).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256), "_vec").limit(k).toArrow()
    return np.concatenate([np.empty((0, dims), np.int64), *[kept(b, dims)[1] for b in first.to_batches()]])


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", k: int = K, rounds: int = ROUNDS, dims: int = DIMS, seed: int = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    slim = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("_id"), F.col(f"`{vec}`").alias("_vec")).where(F.col("_id").isNotNull() & (F.size("_vec") == dims))
    centroids = starts(slim, k, dims, seed)
    for _ in range(rounds if len(centroids) else 0):
        parts = slim.mapInArrow(_sums(centroids, dims), "cluster int, dim int, total string, n long")
        sums = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"), F.sum("n").alias("n"))
        rows = sums.collect()  # k times dims of them, whatever the number of vectors
        new = centroids.astype(object)
        for c, d, total, n in rows:
            new[c, d] = int(total) // n
        centroids = new if np.abs(new).max() >= FIT else new.astype(np.int64)
    if not len(centroids):
        slim = slim.limit(0)
        centroids = np.zeros((1, dims), np.int64)
    assigned = checkpoint(slim.mapInArrow(_assign(centroids, dims), "vec_id long, cluster int, distance long"))
    names = [(c, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest()) for c, row in enumerate(centroids)]
    hashes = vectors.sparkSession.createDataFrame(names, "cluster int, centroid_sha256 string")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = F.sum("cluster_inertia").over(Window.partitionBy())
    told = F.broadcast(inertia.join(hashes, "cluster").withColumn("inertia", total))  # a row for each centroid
    return assigned.join(told, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Rounds as common table expressions; a vector is a list of doubles, all of whose sums and products are whole and below 2**53."""
    near = "select e.vec_id, e.v, arg_min(c.cluster, (list_inner_product(e.v, e.v) - 2 * list_inner_product(e.v, c.v) + list_inner_product(c.v, c.v)) * 8 + c.cluster) as cluster from e, c{0} c group by all"
    steps = []
    for i in range(ROUNDS):
        steps.append(
            f"""n{i} as materialized ({near.format(i)}),
s{i} as (select cluster, d, cast(sum(v[d]) as bigint) as s, count(*) as n from n{i}, (select unnest(range(1, {DIMS + 1})) as d) group by all),
c{i + 1} as materialized (select c.cluster, coalesce(m.v, c.v) as v from c{i} c
  left join (select cluster, list(cast((s - ((s % n) + n) % n) // n as double) order by d) as v from s{i} group by cluster) m using (cluster))"""
        )
    return f"""
with e as materialized (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
c0 as materialized (select cast(row_number() over (order by sha256('{SEED}:' || vec_id)) - 1 as integer) as cluster, v from (from e order by sha256('{SEED}:' || vec_id) limit {K})),
{", ".join(steps)},
last as ({near.format(ROUNDS)}),
found as (
  select l.vec_id, l.cluster, cast(list_inner_product(l.v, l.v) - 2 * list_inner_product(l.v, c.v) + list_inner_product(c.v, c.v) as bigint) as distance,
    sha256(array_to_string(list_transform(c.v, lambda x: cast(x as bigint)), ',')) as centroid_sha256
  from last l join c{ROUNDS} c using (cluster))
select vec_id, cluster, distance, cast(sum(distance) over (partition by cluster) as bigint) as cluster_inertia, cast(sum(distance) over () as bigint) as inertia, centroid_sha256 from found
"""


SQL = _sql()
