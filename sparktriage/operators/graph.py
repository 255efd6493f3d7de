"""Call graphs: closure, degrees, hubs, neighbourhoods, chains, distances and orders."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import checkpoint


def close_graph(edges: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Nodes are callers (defined), callees, and the functions (pver_id, fn, defined) that are known besides: definitions without calls, and prototypes."""
    ends = edges.select("pver_id", F.col("caller").alias("fn"), F.lit(True).alias("d")).unionByName(edges.where("callee is not null").select("pver_id", F.col("callee").alias("fn"), F.lit(False).alias("d")))
    if functions is not None:
        ends = ends.unionByName(functions.select("pver_id", "fn", F.col("defined").alias("d")))
    return ends.groupBy("pver_id", "fn").agg(F.bool_or("d").alias("defined"))


def degrees(edges: DataFrame) -> DataFrame:
    """Out, in and total degree over distinct edges, by one aggregation over both ends; hubs are pre-aggregated."""
    unique = edges.select("pver_id", "caller", "callee").distinct()
    ends = unique.select("pver_id", F.explode(F.array(F.struct(F.col("caller").alias("fn"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("callee").alias("fn"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("pver_id", "e.fn").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"), F.sum(F.col("e.o") + F.col("e.i")).alias("degree"))


def edge_weights(calls: DataFrame) -> DataFrame:
    """A07."""
    return calls.groupBy("pver_id", "caller", "callee").agg(F.sum("w").alias("weight"))


def merge_callees(edges: DataFrame) -> DataFrame:
    """One callee list per caller, in first-seen order (seq)."""
    first = edges.groupBy("pver_id", "caller", "callee").agg(F.min("seq").alias("seq"))
    return first.groupBy("pver_id", "caller").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "callee"))), lambda x: x["callee"]).alias("callees"))


def hubs(degree: DataFrame, limit: int = 40) -> DataFrame:
    """The limit (1 to 80) functions of largest degree of each project, ties by name."""
    rank = F.row_number().over(Window.partitionBy("pver_id").orderBy(F.desc("degree"), "fn"))
    return degree.withColumn("rank", rank).where(F.col("rank") <= max(1, min(80, limit)))


def search_functions(degree: DataFrame, q: str, limit: int = 30) -> DataFrame:
    """L02."""
    rank = F.row_number().over(Window.partitionBy("pver_id").orderBy("fn"))
    return degree.where(F.lower("fn").contains(q.lower())).withColumn("rank", rank).where(F.col("rank") <= limit)


def neighborhood(edges: DataFrame, fns: DataFrame, limit: int = 10) -> DataFrame:
    """Callers and callees of the wanted functions (pver_id, fn): the first limit by name, and how many there are."""
    unique = edges.select("pver_id", "caller", "callee").distinct()
    up = unique.select("pver_id", F.col("callee").alias("fn"), F.col("caller").alias("other"), F.lit("caller").alias("side"))
    down = unique.select("pver_id", F.col("caller").alias("fn"), F.col("callee").alias("other"), F.lit("callee").alias("side"))
    near = up.unionByName(down).join(fns, ["pver_id", "fn"], "left_semi")
    keys = Window.partitionBy("pver_id", "fn", "side")
    return near.withColumn("rank", F.row_number().over(keys.orderBy("other"))).withColumn("total", F.count("*").over(keys)).where(F.col("rank") <= limit)


def caller_chain(starts: DataFrame, edges: DataFrame, max_len: int = 12) -> DataFrame:
    """From each start (pver_id, fn) the least caller that the chain has not yet, again and again; at most max_len names, outermost first.

    One equi-join per round on the open chains only; max_len bounds the rounds.
    """
    callers = edges.select(F.col("pver_id").alias("p"), F.col("callee").alias("at"), "caller").distinct()
    chains = starts.select("pver_id", "fn", F.array("fn").alias("chain"))
    for _ in range(max_len - 1):
        found = chains.join(callers, (F.col("pver_id") == F.col("p")) & (F.element_at("chain", -1) == F.col("at")), "left")
        fresh = F.min(F.when(~F.array_contains("chain", F.col("caller")), F.col("caller"))).alias("next")
        chains = found.groupBy("pver_id", "fn", "chain").agg(fresh).select("pver_id", "fn", F.when(F.col("next").isNull(), F.col("chain")).otherwise(F.array_append("chain", F.col("next"))).alias("chain"))
    return chains.select("pver_id", "fn", F.array_join(F.reverse("chain"), ">").alias("chain"))


def leaf_distance(edges: DataFrame, leaves: DataFrame) -> DataFrame:
    """The least number of calls from a function to the leaf (pver_id, leaf); breadth first over callers until no function is new."""
    callers = checkpoint(edges.select("pver_id", F.col("callee").alias("fn"), "caller").distinct())
    frontier = seen = checkpoint(leaves.select("pver_id", "leaf", F.col("leaf").alias("fn"), F.lit(0).alias("distance")).distinct())
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(callers, ["pver_id", "fn"]).select("pver_id", "leaf", F.col("caller").alias("fn")).distinct()
        frontier = checkpoint(step.join(seen, ["pver_id", "leaf", "fn"], "left_anti").withColumn("distance", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def kahn_order(names: list[str], edges: list[tuple[str, str]], path: list[str], leaf: str | None) -> list[str]:
    """`global` first, then callers before callees, the leaf last.

    Of functions that are ready the one first on the path comes first, then those farthest from the leaf, then the others, by
    name. What waits in or behind a cycle follows in the same order. Distances count calls to the leaf among these names.
    """
    body = [n for n in dict.fromkeys(names) if n and n != "global"]
    after: dict[str, set[str]] = {n: set() for n in body}
    before: dict[str, set[str]] = {n: set() for n in body}
    for a, b in edges:
        if a in after and b in after and a != b:
            after[a].add(b)
            before[b].add(a)
    far = {leaf: 0} if leaf else {}
    reached = [leaf] if leaf else []
    for n in reached:  # grows while it is read
        fresh = [m for m in before.get(n, ()) if m not in far]
        far |= dict.fromkeys(fresh, far[n] + 1)
        reached += fresh
    at = {n: i for i, n in enumerate(path) if n in after}
    rank = {n: (0, at[n], n) if n in at else (1, -far[n], n) if n in far else (2, 0, n) for n in body}
    left = {n: len(before[n]) for n in body}
    heap = [rank[n] for n in body if not left[n]]
    heapq.heapify(heap)
    out: list[str] = []
    while heap:
        n = heapq.heappop(heap)[2]
        out.append(n)
        for m in after[n]:
            left[m] -= 1
            if not left[m]:
                heapq.heappush(heap, rank[m])
    out += sorted((n for n in body if left[n]), key=rank.__getitem__)
    return [*(["global"] if "global" in names else []), *(n for n in out if n != leaf), *(n for n in out if n == leaf)]


def group_calls(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(pver_id, grp, caller, callee): the edges inside each group of members (pver_id, grp, fn).

    Edges lose what no group could hold, at both ends, before they meet the groups, so that a caller of very many functions brings only those that some group has.
    """
    named = members.select("pver_id", "fn").distinct()
    near = edges.select("pver_id", "caller", "callee").distinct().join(named.withColumnRenamed("fn", "caller"), ["pver_id", "caller"], "left_semi").join(named.withColumnRenamed("fn", "callee"), ["pver_id", "callee"], "left_semi")
    own = members.select("pver_id", "grp", "fn").distinct()
    return own.withColumnRenamed("fn", "caller").join(near, ["pver_id", "caller"]).join(own.withColumnRenamed("fn", "callee"), ["pver_id", "grp", "callee"], "left_semi").select("pver_id", "grp", "caller", "callee")


def group_distance(members: DataFrame, edges: DataFrame) -> DataFrame:
    """For each group of members (pver_id, grp, fn, is_leaf), an alarm's few functions, the least number of calls from a function to the leaf among them.

    Breadth first from all leaves at once, over the edges inside the groups; the result is bounded by the members.
    """
    calls = checkpoint(group_calls(members, edges))
    frontier = seen = checkpoint(members.where("is_leaf").select("pver_id", "grp", "fn", F.lit(0).alias("distance")).distinct())
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.select("pver_id", "grp", F.col("fn").alias("callee")).join(calls, ["pver_id", "grp", "callee"]).select("pver_id", "grp", F.col("caller").alias("fn")).distinct()
        frontier = checkpoint(step.join(seen, ["pver_id", "grp", "fn"], "left_anti").withColumn("distance", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def execution_order(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Members (pver_id, grp, fn, position on the path or null, is_leaf) of each group in execution order; groups are an alarm's few functions."""
    calls = group_calls(members, edges).groupBy("pver_id", "grp").agg(F.collect_list(F.struct("caller", "callee")).alias("calls"))
    listed = members.groupBy("pver_id", "grp").agg(F.array_sort(F.collect_list(F.struct(F.col("position").isNull().alias("off"), "position", "fn", "is_leaf"))).alias("fns")).join(calls, ["pver_id", "grp"], "left")

    @F.pandas_udf("array<string>")
    def order(fns: pd.Series, calls: pd.Series) -> pd.Series:
        out = []
        for own, pairs in zip(fns, calls):
            leaf = next((x["fn"] for x in own if x["is_leaf"]), None)
            out.append(kahn_order(sorted(x["fn"] for x in own), [(c["caller"], c["callee"]) for c in pairs] if pairs is not None else [], [x["fn"] for x in own if not x["off"]], leaf))
        return pd.Series(out, dtype=object)

    placed = listed.select("pver_id", "grp", F.posexplode(order("fns", "calls")).alias("at", "fn"))
    return placed.select("pver_id", "grp", "fn", (F.col("at") + 1).alias("place"))


def execution_role(ordered: DataFrame) -> DataFrame:
    """Declaration for global, leaf for the last, intermediate between."""
    last = F.max("place").over(Window.partitionBy("pver_id", "grp"))
    return ordered.withColumn("role", F.when(F.col("fn") == "global", "declaration").when(F.col("place") == last, "leaf").otherwise("intermediate"))
