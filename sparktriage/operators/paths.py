"""Call paths of alarms: traces, unique paths, classes, clusters, trees, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

TRACE = ["pver_id", "block_no"]
GROUP = ["pver_id", "location"]


def parse_frames(frames: DataFrame) -> DataFrame:
    """Frames (pver_id, block_no, pos, entry) with fn_raw, fn and call_site_line."""
    raw = S.frame_fn(F.col("entry"))
    return frames.withColumns({"fn_raw": raw, "fn": S.bare_fn(raw), "call_site_line": S.frame_line(F.col("entry"))})


def traces(frames: DataFrame, heads: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """One row per head: its location, raw call stack, (fn, line) steps and function names in order; empty arrays without frames.

    P05: a trace none of whose entries is a call has the names given for it (named: pver_id, block_no, fns) as its functions, without lines.
    """
    stacks = parse_frames(frames).groupBy(*TRACE).agg(F.array_sort(F.collect_list(F.struct("pos", "entry", "fn", "fn_raw", "call_site_line"))).alias("f"))
    both = heads.join(stacks, TRACE, "left").withColumn("f", F.coalesce("f", F.expr("array()").cast(stacks.schema["f"].dataType)))
    calls = F.filter("f", lambda x: x["fn"] != "")
    steps = F.transform(calls, lambda x: F.concat(x["fn"], F.lit(":"), F.coalesce(x["call_site_line"].cast("string"), F.lit("?"))))
    fns = F.transform(calls, lambda x: x["fn"])
    if named is not None:
        both = both.join(named.select(*TRACE, F.col("fns").alias("given")), TRACE, "left")
        none = (F.size(calls) == 0) & F.col("given").isNotNull()
        steps = F.when(none, F.transform("given", lambda x: F.concat(S.bare_fn(x), F.lit(":?")))).otherwise(steps)
        fns = F.when(none, F.transform("given", S.bare_fn)).otherwise(fns)
    return both.select(*TRACE, "location", "alarm", F.transform("f", lambda x: x["entry"]).alias("call_stack"), steps.alias("steps"), fns.alias("fns"))


def alarm_location_paths(frames: DataFrame, heads: DataFrame) -> DataFrame:
    """Per alarm location: traces, unique call stacks and path classes."""
    return _counted(traces(frames, heads), n_traces="n", n_paths="stacks", n_classes="classes")


def _counted(own: DataFrame, **names: str) -> DataFrame:
    """Traces, different call stacks and different step lists of a location, by way of hashes: stacks are not copied once per distinct count.

    Two 64-bit hashes of a list differ from another's but for one pair in 2**128.
    """
    key = lambda c: F.struct(F.xxhash64(c), F.xxhash64(c, F.lit(1)))
    slim = own.select(*GROUP, key("call_stack").alias("stack"), key("steps").alias("steps"))
    per = slim.groupBy(*GROUP, "stack", "steps").agg(F.count("*").alias("n"))
    return per.groupBy(*GROUP).agg(*[{"n": F.sum("n"), "stacks": F.countDistinct("stack"), "classes": F.countDistinct("steps")}[what].alias(name) for name, what in names.items()])


def trace_counts(frames: DataFrame, heads: DataFrame) -> DataFrame:
    """A01."""
    return _counted(traces(frames, heads), no_of_traces="n", no_of_paths="stacks")


def path_records(frames: DataFrame, heads: DataFrame, enclosing: DataFrame | None = None) -> DataFrame:
    """Unique call stacks of a location, numbered from 1 by first block; a path without functions has the enclosing one (pver_id, location, fn)."""
    unique = traces(frames, heads).groupBy(*GROUP, "call_stack").agg(F.min("block_no").alias("first_block"), F.count("*").alias("n"), F.first("fns").alias("fns"), F.first("steps").alias("steps"))
    if enclosing is not None:
        unique = unique.join(enclosing.select(*GROUP, F.col("fn").alias("around")), GROUP, "left")
        unique = unique.withColumn("fns", F.when((F.size("fns") == 0) & F.col("around").isNotNull(), F.array("around")).otherwise(F.col("fns"))).drop("around")
    return unique.withColumn("path_id", F.row_number().over(Window.partitionBy(*GROUP).orderBy("first_block")))


def group_ids(heads: DataFrame) -> DataFrame:
    """Locations of a project numbered from 1 by first appearance."""
    seen = heads.groupBy(*GROUP).agg(F.min("block_no").alias("first_block"))
    return seen.withColumn("group_id", F.row_number().over(Window.partitionBy("pver_id").orderBy("first_block")))


def path_classes(paths: DataFrame) -> DataFrame:
    """Paths of equal (fn, line) steps; C1, C2, … by size descending, ties by first path. Two 64-bit hashes stand for the steps as a key."""
    key = F.struct(F.xxhash64("steps"), F.xxhash64("steps", F.lit(1))).alias("key")
    classes = paths.groupBy(*GROUP, key).agg(F.first("steps").alias("steps"), F.count("*").alias("size"), F.min("path_id").alias("representative_path_id"), F.array_sort(F.collect_list("path_id")).alias("member_path_ids"), F.first("fns").alias("fns")).drop("key")
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("size"), "representative_path_id"))
    return classes.withColumn("rank", rank).withColumn("class_id", F.concat(F.lit("C"), F.col("rank")))


def cluster_classes(classes: DataFrame, cap: int = 15, local: DataFrame | None = None) -> DataFrame:
    """Above cap classes, those with equal last three steps form clusters; cap clusters stay, and coverage is partial.

    It stays full for alarms (local: pver_id, location) whose index is made in their own function, as callers can't change it.
    """
    n = F.max("rank").over(Window.partitionBy(*GROUP))
    marked = classes.withColumn("n_classes", n)
    few = marked.where(F.col("n_classes") <= cap).select(*GROUP, "class_id", "size", "member_path_ids", "representative_path_id", F.lit("full").alias("coverage"))
    suffix = F.when(F.size("steps") > 3, F.slice("steps", -3, 3)).otherwise(F.col("steps"))
    clusters = (
        marked.where(F.col("n_classes") > cap).groupBy(*GROUP, suffix.alias("suffix"))
        .agg(F.sum("size").alias("size"), F.min("rank").alias("best"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("member_path_ids")))).alias("member_path_ids"), F.min_by("representative_path_id", "rank").alias("representative_path_id"))
    )
    rank = F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("size"), "best"))
    many = clusters.withColumn("k", rank).where(F.col("k") <= cap).select(*GROUP, F.concat(F.lit("K"), F.col("k")).alias("class_id"), "size", "member_path_ids", "representative_path_id", F.lit("partial").alias("coverage"))
    if local is not None:
        many = many.join(local.select(*GROUP).distinct().withColumn("own", F.lit(True)), GROUP, "left").withColumn("coverage", F.when(F.col("own"), "full").otherwise("partial")).drop("own")
    return few.unionByName(many)


def class_edges(classes: DataFrame) -> DataFrame:
    """A10: steps that follow each other in a class; an edge belongs to its first class."""
    n = F.size("steps")
    pairs = F.transform(F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.expr("array()").cast("array<int>")), lambda i: F.struct(F.element_at("steps", i).alias("src"), F.element_at("steps", i + 1).alias("dst")))
    edges = classes.select(*GROUP, "rank", F.explode(pairs).alias("e"))
    return edges.groupBy(*GROUP, "e.src", "e.dst").agg(F.concat(F.lit("C"), F.min("rank")).alias("class_id"))


def call_tree(paths: DataFrame) -> DataFrame:
    """Every prefix of the paths' function names with the number of paths through it."""
    n = F.size("fns")
    prefixes = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("array()").cast("array<int>")), lambda i: F.array_join(F.slice("fns", F.lit(1), i), ">"))
    return paths.select(*GROUP, F.explode(prefixes).alias("prefix")).groupBy(*GROUP, "prefix").agg(F.count("*").alias("n_paths"))


def unique_sequences(frames: DataFrame, heads: DataFrame) -> DataFrame:
    """Function names of a trace without direct repeats; equal sequences of a location once, numbered by first block."""
    parsed = parse_frames(frames)
    kept = parsed.withColumn("was", F.lag("fn").over(Window.partitionBy(*TRACE).orderBy("pos"))).where(F.col("was").isNull() | (F.col("was") != F.col("fn")))
    lists = kept.groupBy(*TRACE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fn"))), lambda x: x["fn"]), ">").alias("seq"))
    return heads.join(lists, TRACE).groupBy(*GROUP, "seq").agg(F.min("block_no").alias("first_block"), F.count("*").alias("n"))


def path_edges(frames: DataFrame) -> DataFrame:
    """Neighbours in a trace without self loops and repeats."""
    parsed = parse_frames(frames)
    after = F.lead("fn").over(Window.partitionBy(*TRACE).orderBy("pos"))
    return parsed.withColumn("dst", after).where("dst is not null and dst <> fn").select(*TRACE, F.col("fn").alias("src"), "dst").distinct()


def edge_kinds(edges: DataFrame, cfg_edges: DataFrame) -> DataFrame:
    """An edge is direct if the call graph has it, else path."""
    known = cfg_edges.select("pver_id", F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct().withColumn("known", F.lit(True))
    return edges.join(known, ["pver_id", "src", "dst"], "left").withColumn("kind", F.when(F.col("known"), "direct").otherwise("path")).drop("known")


def attach_traces(groups: DataFrame, heads: DataFrame) -> DataFrame:
    """Blocks of the exact location; for groups without any, blocks with the same numbers in another file; else none."""
    exact = groups.join(heads.select(*GROUP, "block_no"), GROUP).select(*GROUP, "block_no", F.lit("exact").alias("how"))
    rest = groups.join(heads, GROUP, "left_anti").withColumn("key", S.location_parts(F.col("location"))["numeric_key"])
    keyed = heads.select("pver_id", "block_no", S.location_parts(F.col("location"))["numeric_key"].alias("key"))
    loose = rest.join(keyed, ["pver_id", "key"], "left").select(*GROUP, "block_no", F.when(F.col("block_no").isNull(), "none").otherwise("numbers").alias("how"))
    return exact.unionByName(loose)


def paths_with_variable(paths: DataFrame, functions: DataFrame) -> DataFrame:
    """Paths through one of the functions (pver_id, fn), global left out."""
    names = paths.select(*GROUP, "path_id", F.explode("fns").alias("fn"))
    return names.join(functions.where("fn <> 'global'"), ["pver_id", "fn"], "left_semi").select(*GROUP, "path_id").distinct()


def path_roles(paths: DataFrame, centers: DataFrame | None = None) -> DataFrame:
    """What each function is in an alarm's paths: origin, alarm (also the alarm's own function, centers: pver_id, location, fn), both or a hop."""
    steps = paths.select(*GROUP, "path_id", F.size("fns").alias("n"), F.posexplode("fns").alias("i", "fn"))
    roles = steps.groupBy(*GROUP, "fn").agg(F.bool_or(F.col("i") == 0).alias("first"), F.bool_or(F.col("i") == F.col("n") - 1).alias("last"), F.countDistinct("path_id").alias("n_paths"))
    if centers is not None:
        roles = roles.join(centers.select(*GROUP, "fn").distinct().withColumn("center", F.lit(True)), [*GROUP, "fn"], "left")
    center = F.lit(False) if centers is None else F.coalesce("center", F.lit(False))
    role = F.when(F.col("first") & F.col("last"), "origin_and_alarm").when(F.col("last") | center, "alarm").when(F.col("first"), "origin").otherwise("hop")
    return roles.select(*GROUP, "fn", role.alias("role"), "n_paths")


def primary_paths(paths: DataFrame, centers: DataFrame) -> DataFrame:
    """The path of each alarm that is shown first: one that ends in its own function (centers: pver_id, location, fn) if there is one, the longest, the first; direct repeats count once."""
    flat = F.expr("filter(fns, (x, i) -> i = 0 or x <> fns[i - 1])")
    own = paths.withColumn("seq", flat).where(F.size("seq") > 0).join(centers.select(*GROUP, F.col("fn").alias("center")), GROUP, "left")
    ends = F.coalesce(F.element_at("seq", -1) == F.col("center"), F.lit(False))
    best = own.groupBy(*GROUP).agg(F.max(F.struct(ends.alias("ends"), F.size("seq").alias("n"), (-F.col("path_id")).alias("at"), "seq")).alias("b"))
    return best.select(*GROUP, (-F.col("b.at")).alias("path_id"), F.col("b.ends").alias("at_center"), F.array_join("b.seq", ">").alias("seq"))
