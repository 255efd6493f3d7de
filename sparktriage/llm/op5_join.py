"""Operator 5, n-gram Jaccard join by prefix trees.

Each document becomes the set of its distinct shingles, as 64-bit hashes in one global order (by value). Sets with
denominator * intersection >= numerator * union are linked; a Likeness has the shingles' width and these two: three words and
90 of 100 in the query, five words and 80 of 100 in the pipeline's stage. Equal sets are one node from the start.

Finding groups. If two sets are linked, their symmetric difference is at most (|x| + |y|) / 19. Cutting the hash space into
m parts with m above that bound plus a reserve, at least one part that is not almost empty is the same in both. Sets that
share no part can't be linked, so the graph of shared parts falls into groups that hold all links. Keys are counted after
partial aggregation, groups come from connected components; no pairs are made. Below 90 of 100 parts get so small that unrelated
sets share them; there the keys are the rarest shingles of a set, as many as must hold one that both linked sets have (prefix filter).

Joining. Each group's sets travel once. They are put into a compressed trie in the global order; a set walks the trie from
the root, counting the overlap of each node once for all sets below it, and leaves a subtree when what can still match is
too short (remaining-length bound) or when all its sets are linked with it already. Groups above BLOCK_BYTES are cut into
blocks that are joined one by one, then their representatives; what is then still apart meets under the keys that sets of
different components share, in blocks again where one key has too many, so that no task holds more than two blocks and no
link between different components is lost.

Null and empty texts have the empty set and are linked with nothing. Rows are told apart by a hash of id and text, so null and
repeated ids take part like others; components name ids, null where none of the rows has one. Hashes of 64 bits stand for shingles and for sets: among 10**9 sets some two meet with odds of 3 %.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import mix, split_words, windows
from .common import WORD, checkpoint, components, key_groups, near, slices, table, text_slices, utf8

BLOCK_BYTES = 4 << 20
#: Components (a number and an id each) that are broadcast at most.
BROADCAST_CLASSES = 1 << 20
#: Sizes fall into bands, each from CUT times its upper bound; a set meets partners of its own band and of the next.
CUT = 0.9**3
TINY = 3
#: Every so-manieth row is looked through for frequent shingles; those met so often there, at most so many, are dealt over so many windows.
SAMPLED, OFTEN, HOT_SHINGLES, SALTS = 64, 16, 1 << 16, 256
#: Sets that a task remembers to leave copies out.
KNOWN_SETS = 1 << 19
_BOUNDS = [0, *np.unique(np.ceil(2 / CUT ** np.arange(0, 60)).astype(np.int64)).tolist()]


@dataclass(frozen=True)
class Likeness:
    """What links two sets: shingles of width words, denominator * intersection >= numerator * union."""

    width: int = 3
    numerator: int = 90
    denominator: int = 100

    @property
    def by_parts(self) -> bool:
        """Whether parts hold enough members to be keys."""
        return 100 * self.numerator >= 90 * self.denominator

    def parts(self, upper: int) -> tuple[int, int]:
        """Number of parts for sets of at most upper members, and how many tiny parts a set may leave out.

        Each difference touches one part at most, and each side leaves out some; one more part must remain.
        """
        differences = 2 * upper * (self.denominator - self.numerator) // (self.denominator + self.numerator)
        out = differences // 32 + (differences > 0)
        return differences + 2 * out + 1, out


QUERY, STAGE = Likeness(), Likeness(5, 80, 100)


#: Texts whose words are looked at together; a single longer one goes alone.
SLICE_BYTES = 1 << 18


def sets_of(texts: list[bytes], width: int = QUERY.width) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    for i, j in slices([len(t) for t in texts], SLICE_BYTES):
        w = split_words(texts[i:j], lower=True)
        h = w.hashes()
        shingles = windows(h, width)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if b - a >= width:
                yield np.unique(shingles[a : b - width + 1])
            elif b > a:
                yield np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), b - a)], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def set_id(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), len(s)) - (1 << 63)


def part_keys(s: np.ndarray, like: Likeness = QUERY) -> np.ndarray:
    """The keys under which a set looks for partners."""
    n, keys = len(s), []
    band = int(np.searchsorted(_BOUNDS, n))
    partner = min(n * like.denominator // like.numerator, _BOUNDS[-1])
    for b in range(band, int(np.searchsorted(_BOUNDS, partner)) + 1):
        m, out = like.parts(_BOUNDS[b])
        part = (mix(s) >> np.uint64(32)).astype(np.int64) * m >> 32
        counts = np.bincount(part, minlength=m)
        sums = np.zeros(m, np.uint64)
        np.add.at(sums, part, mix(s + np.uint64(77)))
        tiny = np.flatnonzero(counts <= TINY)
        tiny = tiny[np.argsort(counts[tiny], kind="stable")][:out]
        key = mix(sums + mix(np.arange(m, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(b)))
        keys.append(np.delete(key, tiny))
    return np.concatenate(keys)


def _members(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_slices(batch, 1, SLICE_BYTES):
                n, ids = [], []
                for s in sets_of(texts, like.width):
                    n.append(len(s))
                    ids.append(set_id(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), batch.column(2).slice(i, j - i)], ["id", "n_shingles", "node", "row"])

    return run


def _keys(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in text_slices(batch, 0, SLICE_BYTES):
                keys, nodes = [], []
                for s in sets_of(texts, like.width):
                    if len(s):
                        keys.append(part_keys(s, like))
                        nodes.append(np.full(len(keys[-1]), set_id(s), np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], ["key", "node"])

    return run


def _shingles(width: int):
    """(key, node) of the sets of a task, each set once, so that copies make no shingle frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            for _, _, texts in text_slices(batch, 0, SLICE_BYTES):
                named = {set_id(s): s for s in sets_of(texts, width) if len(s)}
                sets = {node: s for node, s in named.items() if node not in met}
                met.update(sets)
                if len(met) > KNOWN_SETS:
                    met.clear()
                if sets:
                    nodes = np.repeat(np.array(list(sets), np.int64), [len(s) for s in sets.values()])
                    sets = list(sets.values())
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64)), pa.array(nodes)], ["key", "node"])

    return run


# --- the trie ---


class _Node:
    __slots__ = ("run", "children", "least", "most", "deepest", "root", "ends")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ends = run, {}, []
        self.least, self.most, self.deepest, self.root = 1 << 60, 0, 0, -2

    def note(self, size: int, below: int, member: int, root) -> None:
        """A set of size members, below of them after this node's end, lies in this subtree."""
        self.least, self.most, self.deepest = min(self.least, size), max(self.most, size), max(self.deepest, below)
        if self.root == -2:
            self.root = member
        elif self.root != -1 and root(self.root) != root(member):
            self.root = -1  # sets of more than one component


class PrefixTree:
    """Ordered sets in a compressed trie, joined as they come; links of sets that are apart are added to links."""

    def __init__(self, parent: list[int], like: Likeness = QUERY):
        self.like = like
        self.top = _Node(np.empty(0, np.uint64))
        self.parent = parent
        self.sizes: list[int] = []
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def probe(self, s: np.ndarray, member: int) -> None:
        n, numerator, denominator = len(s), self.like.numerator, self.like.denominator
        stack = [(child, 0, 0) for child in self.top.children.values()]
        while stack:
            node, seen, overlap = stack.pop()  # seen: members of s that come before node's first
            if node.root >= 0 and self.root(node.root) == self.root(member):
                continue
            if node.least * numerator > n * denominator or node.most * denominator < n * numerator:
                continue
            run = node.run
            need = -(-numerator * (n + node.least) // (numerator + denominator))
            if overlap + min(n - seen, len(run) + node.deepest) < need:
                continue
            at = np.searchsorted(s, run)
            overlap += int((s[np.minimum(at, n - 1)] == run).sum())
            seen = int(np.searchsorted(s, run[-1], "right"))
            for other in node.ends:
                if denominator * overlap >= numerator * (n + self.sizes[other] - overlap) and self.root(other) != self.root(member):
                    self.links.append((member, other))
                    self.parent[self.root(member)] = self.root(other)
            if node.children and overlap + min(n - seen, node.deepest) >= need:
                stack.extend((child, seen, overlap) for child in node.children.values())

    def insert(self, s: np.ndarray, member: int) -> None:
        while len(self.sizes) <= member:
            self.sizes.append(0)
        self.sizes[member] = n = len(s)
        node, at = self.top, 0
        while at < n:
            child = node.children.get(int(s[at]))
            if child is None:
                leaf = _Node(s[at:])
                leaf.note(n, 0, member, self.root)
                leaf.ends.append(member)
                node.children[int(s[at])] = leaf
                return
            run = child.run
            k = min(len(run), n - at)
            differ = np.flatnonzero(run[:k] != s[at : at + k])
            same = int(differ[0]) if len(differ) else k
            if same < len(run):  # split the node where the sets part
                upper = _Node(run[:same])
                upper.least, upper.most, upper.root = child.least, child.most, child.root
                upper.deepest = child.deepest + len(run) - same
                child.run = run[same:]
                upper.children[int(child.run[0])] = child
                node.children[int(s[at])] = upper
                child = upper
            at += same
            child.note(n, n - at, member, self.root)
            node = child
        node.ends.append(member)


def tree_join(sets: list[np.ndarray], apart: list[int] | None = None, like: Likeness = QUERY) -> list[tuple[int, int]]:
    """Links (i, j) of a spanning forest of the linked sets. apart: sets with equal numbers count as linked already."""
    first: dict[int, int] = {}
    parent = [first.setdefault(a, i) for i, a in enumerate(apart)] if apart else list(range(len(sets)))
    tree = PrefixTree(parent, like)
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        tree.probe(sets[i], i)
        tree.insert(sets[i], i)
    return tree.links


def _join_groups(like: Likeness):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["grp", "i", "j"]):
            texts = [t for chunk in group.column("text").chunks for t in utf8(chunk)]
            own = {}  # should two rows have one key, the text is another than the node's
            for s, node, apart in zip(sets_of(texts, like.width), group.column("node").to_pylist(), group.column("apart").to_pylist()):
                if len(s) and set_id(s) == node:
                    own[node] = s, apart
            nodes = list(own)
            links = tree_join([s for s, _ in own.values()], [a for _, a in own.values()], like)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in links], pa.int64()), pa.array([nodes[b] for _, b in links], pa.int64())], ["a", "b"])

    return run


def _joined(placed: DataFrame, like: Likeness) -> DataFrame:
    """Links among the rows (grp, i, j, node, apart, text) of each (grp, i, j); groups are streamed, one is held at a time."""
    keys = ["grp", "i", "j"]
    return placed.select(*keys, "node", "apart", "text").repartition(*keys).sortWithinPartitions(*keys, "node").mapInArrow(_join_groups(like), "a long, b long")


def row_key(doc_id: str, text: str):
    """A hash of id and text, with null ids told apart from given ones; equal only for repeated rows."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text))


def memberships(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", like: Likeness = QUERY) -> DataFrame:
    """(id, n_shingles, node, row) of every row; node, the hash of the set, is null for the empty set."""
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), row_key(doc_id, text).alias("row"))
    return slim.mapInArrow(_members(like), "id long, n_shingles long, node long, row long")


def _rarest(docs: DataFrame, members: DataFrame, doc_id: str, text: str, like: Likeness) -> DataFrame:
    """(key, node): of the n shingles of each set the n - k + 1 rarest, k being the fewest it has in common with a linked set.

    Two linked sets have one of these in common, whatever the order of shingles is, as long as all sets have the same. Shingles of one
    set only are dropped after they are counted, which leaves most sets without keys. A shingle that very many sets have would put
    all of them into one window. Such ones are found in every SAMPLED-th row: what several different sets have there is shared, its count
    there is its place in the order, and its rows are dealt over SALTS windows. Which shingles these are changes no link.
    """
    shingles = lambda df: df.select(text).mapInArrow(_shingles(like.width), "key long, node long")
    some = shingles(docs.where(F.pmod(row_key(doc_id, text), F.lit(SAMPLED)) == 0)).groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("top"))
    hot = checkpoint(some.where("least < top").where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "key").limit(HOT_SHINGLES).select("key", (F.col("n") * SAMPLED).alias("often")))
    rows = shingles(docs).join(F.broadcast(hot), "key", "left")  # at most HOT_SHINGLES rows
    rows = rows.withColumn("salt", F.when(F.col("often").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")))
    holders = Window.partitionBy("key", "salt")
    counted = rows.withColumns({"n_rows": F.coalesce("often", F.count("*").over(holders)), "least": F.min("node").over(holders), "top": F.max("node").over(holders)})
    shared = counted.where("least < top or often is not null").select("key", "salt", "node", "n_rows").distinct()
    sizes = members.where("node is not null").select("node", F.col("n_shingles").alias("n")).distinct()
    own = Window.partitionBy("node")
    ranked = shared.join(sizes, "node").withColumns({"rank": F.row_number().over(own.orderBy("n_rows", "key")), "n_shared": F.count("*").over(own)})
    prefix = F.expr(f"n - (n * {like.numerator} + {like.denominator - 1}) div {like.denominator} + 1")
    return checkpoint(ranked.where(F.col("rank") <= prefix - (F.col("n") - F.col("n_shared"))).select("key", "node"))


def candidate_groups(docs: DataFrame, keys: DataFrame | None, text: str = "text", like: Likeness = QUERY) -> DataFrame:
    """(node, grp) of the nodes that share a key with another node; keys: (key, node) if they were counted."""
    if keys is None:
        keys = docs.select(text).mapInArrow(_keys(like), "key long, node long")
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    edges = keys.join(hubs, "key").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    return components(edges).toDF("node", "grp")


def linked_nodes(docs: DataFrame, members: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, like: Likeness = QUERY) -> DataFrame:
    """(node, component): the components of two nodes at least."""
    keys = None if like.by_parts else _rarest(docs, members, doc_id, text, like)
    groups = candidate_groups(docs, keys, text, like)
    holders = members.where("node is not null").groupBy("node").agg(F.min("row").alias("row"))
    chosen = groups.join(holders, "node")
    own = docs.select(row_key(doc_id, text).alias("row"), F.col(text).alias("text"))
    once = own.join(chosen, "row").groupBy("node", "grp").agg(F.first("text").alias("text"))  # repeated rows have one key
    sized = checkpoint(once.withColumn("bytes", F.octet_length("text").cast("long")))
    weight = sized.groupBy("grp").agg(F.ceil(F.sum("bytes") / block_bytes).alias("blocks"))
    large = checkpoint(weight.where("blocks > 1"))
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = sized.join(large, "grp", "left").select("grp", block.alias("i"), block.alias("j"), "node", F.col("node").alias("apart"), "text")
    links = checkpoint(_joined(placed, like))
    if large.isEmpty():
        return components(links)
    return components(links.unionByName(_across(sized.join(large, "grp"), links, keys, block_bytes, like)))


def _across(rows: DataFrame, links: DataFrame, keys: DataFrame | None, block_bytes: int, like: Likeness) -> DataFrame:
    """The links that are missing between the blocks of large groups, whose rows are (node, grp, text, bytes, blocks); keys: (key, node) if they were counted."""

    def labelled(known: DataFrame) -> DataFrame:
        return rows.join(components(known), "node", "left").withColumn("apart", F.coalesce("component", "node")).drop("component")

    # Representatives first: where a group is one component in every block, this links the blocks.
    least = labelled(links).where("node = apart")
    blocks = least.groupBy("grp").agg(F.ceil(F.sum("bytes") / block_bytes).alias("k"))
    block = F.pmod(F.xxhash64("node", F.lit(5)), "k").cast("int")
    more = checkpoint(_joined(least.join(blocks, "grp").select("grp", block.alias("i"), block.alias("j"), "node", "apart", "text"), like))
    # Then what is still apart, and only where sets of different components share a key.
    full = checkpoint(labelled(links.unionByName(more)))
    parts = full.groupBy("grp").agg(F.min("apart").alias("low"), F.max("apart").alias("high")).where("low < high")
    open_ = checkpoint(full.join(parts, "grp").select("node", "apart", "text", "bytes"))
    if open_.isEmpty():
        return more
    held = (open_.select("text").mapInArrow(_keys(like), "key long, node long") if keys is None else keys).join(open_.select("node", "apart", "bytes"), "node")
    mark = F.xxhash64("node", F.lit(7))
    mixed = held.groupBy("key").agg(F.min("apart").alias("low"), F.max("apart").alias("high"), F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 24)).alias("y"))
    chosen = mixed.where("low < high").groupBy("n", "x", "y").agg(F.min("key").alias("key"))  # of keys with the same holders one is enough
    meets = checkpoint(held.join(chosen.select("key"), "key").select(F.col("key").alias("grp"), "node"))
    return more.unionByName(checkpoint(_joined(_paired(meets.join(open_, "node"), block_bytes), like)))


def _paired(rows: DataFrame, block_bytes: int) -> DataFrame:
    """(grp, i, j, node, apart, text) of rows (grp, node, apart, text, bytes): any two of a group but those of its largest component meet in one (i, j).

    Small groups are one block. Of the others the largest component's blocks meet those of the rest, and these meet one another.
    """
    sizes = rows.groupBy("grp", "apart").agg(F.sum("bytes").alias("b"))
    ruler = sizes.groupBy("grp").agg(F.max_by("apart", F.struct("b", "apart")).alias("ruler"), F.max("b").alias("b1"), F.sum("b").alias("b"))
    count = lambda x: F.greatest(F.lit(1), F.ceil(x / block_bytes).cast("int"))
    ruler = checkpoint(ruler.select("grp", "ruler", (F.col("b") <= block_bytes).alias("one"), count(F.col("b1")).alias("k1"), count(F.col("b") - F.col("b1")).alias("k0")))
    placed = rows.join(ruler, "grp").withColumn("side", F.col("apart") == F.col("ruler"))
    placed = placed.withColumn("at", F.pmod(F.xxhash64("node", F.lit(9)), F.when(F.col("side"), F.col("k1")).otherwise(F.col("k0"))).cast("int"))
    small = F.sequence(F.lit(0), F.col("k0") - 1)
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    pairs = (
        F.when(F.col("one"), F.array(pair(F.lit(0), F.lit(0))))
        .when(F.col("side"), F.transform(small, lambda o: pair(o, F.col("k0") + F.col("at"))))
        .otherwise(F.concat(F.transform(small, lambda o: pair(F.least(o, "at"), F.greatest(o, "at"))), F.transform(F.sequence(F.lit(0), F.col("k1") - 1), lambda o: pair(F.col("at"), F.col("k0") + o))))
    )
    return placed.withColumn("p", F.explode(F.array_distinct(pairs))).select("grp", "p.i", "p.j", "node", "apart", "text")


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, like: Likeness = QUERY) -> DataFrame:
    """(id, n_shingles, node, row, class, component_id) for every row; component_id is the smallest id of the class, the rows that links reach.

    Smallest ids are found per node, then per component, and come back to the rows by their node, so that neither a node of very
    many copies nor a component of very many nodes is one task's work.
    """
    members = checkpoint(memberships(docs, doc_id, text, like))
    nodes = checkpoint(members.where("node is not null").groupBy("node").agg(F.min("id").alias("least")))
    linked = checkpoint(linked_nodes(docs, members, doc_id, text, block_bytes, like).join(nodes, "node"))
    best = checkpoint(linked.groupBy("component").agg(F.min("least").alias("best")))
    told = checkpoint(nodes.join(linked.join(near(best, BROADCAST_CLASSES), "component").select("node", F.col("component").alias("class"), "best"), "node", "left"))
    named = members.join(told.select("node", F.coalesce("class", "node").alias("class"), F.coalesce("best", "least").alias("least")), "node", "left")
    return named.select("id", "n_shingles", "node", "row", "class", F.coalesce("least", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = join_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("node").alias("set_hash"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked ones (five words, 80 of 100): that of the smallest id, a null id only where no other is there.

    Of repeated rows, and of different texts under one id, one stays as well. Documents without words are in no class and all stay.
    """
    done = join_components(docs, like=STAGE).where("node is not null")
    classes = done.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("first"))
    keep = checkpoint(classes.select(F.col("first.row").alias("key")))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key("doc_id", "text").alias("key"), F.coalesce(~F.col("text").rlike(WORD), F.lit(True)).alias("wordless")
    )
    repeated = done.groupBy("row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("row").alias("key"))
    repeated = checkpoint(repeated.join(keep, "key", "left_semi"))
    one = rows.where(~F.col("wordless")).join(keep.join(repeated, "key", "left_anti"), "key", "left_semi")
    many = rows.where(~F.col("wordless")).join(repeated, "key", "left_semi").dropDuplicates(["key"])
    return rows.where("wordless").select("row").unionByName(one.select("row")).unionByName(many.select("row")).select("row.*")
