"""Alarm records: joins of alarm rows, groups and requests, and the latest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def alarm_records(alarms: DataFrame, groups: DataFrame) -> DataFrame:
    """Every alarm with the last group (highest group_id) of its trimmed location."""
    last = groups.groupBy("pver_id", F.trim("location").alias("location")).agg(F.max("group_id").alias("group_id"))
    return alarms.withColumn("location", F.trim("location")).join(last, ["pver_id", "location"], "left")


def resolve_orders(requests: DataFrame, groups: DataFrame, alarms: DataFrame) -> DataFrame:
    """A request (pver_id, key) means a group id first, else an order whose location names the group; null if neither."""
    key = S.order_key(F.col("key"))
    asked = requests.withColumn("k", key)
    by_id = groups.select("pver_id", F.col("group_id").cast("string").alias("k"), F.col("group_id").alias("by_id"))
    orders = alarms.groupBy("pver_id", S.order_key(F.col("order_id")).alias("k")).agg(F.max_by("location", "alarm_seq").alias("location"))
    last = groups.groupBy("pver_id", "location").agg(F.max("group_id").alias("by_order"))
    both = asked.join(by_id, ["pver_id", "k"], "left").join(orders, ["pver_id", "k"], "left").join(last, ["pver_id", "location"], "left")
    how = F.when(F.col("by_id").isNotNull(), "group").when(F.col("by_order").isNotNull(), "order").otherwise("none")
    return both.select("pver_id", "key", F.coalesce("by_id", "by_order").alias("group_id"), how.alias("how"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Of each (pver_id, order_key) the run with the greatest stamp."""
    return runs.groupBy("pver_id", "order_key").agg(F.max("stamp").alias("stamp"), F.count("*").alias("runs"))


def enrichment_report(heads: DataFrame, groups: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per project its blocks, matching blocks, groups, functions and edges, and of its symbols (pver_id, group_id, is_array, size_known) how many there are, in how many groups, and how many arrays of unknown size."""
    blocks = heads.groupBy("pver_id").agg(F.count("*").alias("blocks"), F.count_if(S.is_aoob(F.col("alarm"))).alias("matched"))
    counted = groups.groupBy("pver_id").agg(F.count("*").alias("groups"))
    graph = edges.groupBy("pver_id").agg(F.count("*").alias("edges"), F.countDistinct("caller").alias("functions"))
    told = symbols.groupBy("pver_id").agg(F.count("*").alias("symbols"), F.countDistinct("group_id").alias("groups_with_info"), F.count_if(F.col("is_array") & ~F.col("size_known")).alias("unknown_sizes"))
    return blocks.join(counted, "pver_id", "left").join(graph, "pver_id", "left").join(told, "pver_id", "left").fillna(0, ["symbols", "groups_with_info", "unknown_sizes"])


def project_inventory(files: DataFrame, alarms: DataFrame) -> DataFrame:
    """Files (pver_id, name) and the alarm count give ready (has a graph), needs_build (alarms and source) or incomplete; the first name in order counts."""
    lower = F.lower("name")
    kinds = {"alarm_file": lower.rlike(r"alarm.*\.csv$|^orders?\.csv$"), "log_file": lower.rlike(r"\.(log|txt)$"), "source_file": lower.rlike(r"\.(c|i)$"), "graph_file": lower.rlike(r"(cfg|call_?graph).*\.json$")}
    found = files.groupBy("pver_id").agg(*[F.min(F.when(cond, F.col("name"))).alias(k) for k, cond in kinds.items()])
    counts = alarms.groupBy("pver_id").agg(F.count("*").alias("n_alarms"))
    state = F.when(F.col("graph_file").isNotNull(), "ready").when(F.col("alarm_file").isNotNull() & F.col("source_file").isNotNull(), "needs_build").otherwise("incomplete")
    return found.join(counts, "pver_id", "left").withColumns({"n_alarms": F.coalesce("n_alarms", F.lit(0)), "state": state})
