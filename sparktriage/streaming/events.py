"""Run events as a stream: typed source, focus and status folds, the visit gate, bounded tails; each with its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import clip

SCHEMA = "event_id long, ts timestamp, pver_id string, order_key string, kind string, agent string, activity string, props string, title string, functions string, edges string, call_path string, var_paths string, var_focus string, cursor string"
JOB = ["pver_id", "order_key"]
# The agents that keep a cursor of their own, and the one whose cursor is the focus on a value.
AGENTS = ["CALL_PATH_EXPLORE", "TP_PROVE", "FP_PROVE", "FINAL_CLASSIFICATION"]
VALUE_AGENT = "VAR_VALUE_EXPLORE"
#: Setting and value of the state store that visit_gate_stream needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def stream_events(spark: SparkSession, path: str, preview: int = 200) -> DataFrame:
    """A folder of JSON lines as a stream of typed rows, long properties clipped."""
    return spark.readStream.schema(SCHEMA).json(path).withColumn("props", clip(F.col("props"), preview))


def _latest(value: Column, where: Column) -> Column:
    return F.max_by(value, F.when(where, F.struct("ts", "event_id")))


def focus_state(events: DataFrame) -> DataFrame:
    """Per job the latest of each field that is not null, and the latest cursor of each agent; the value agent's goes to var_focus. The same aggregation runs on streams and on tables."""
    latest = [_latest(F.col(c), F.col(c).isNotNull()).alias(c) for c in ("agent", "activity", "functions", "edges", "call_path", "var_paths")]
    value = F.coalesce(F.when(F.col("agent") == VALUE_AGENT, F.col("cursor")), F.col("var_focus"))
    cursors = [_latest(F.col("cursor"), F.col("cursor").isNotNull() & (F.col("agent") == a)).alias(f"cursor_{a.lower()}") for a in AGENTS]
    return events.groupBy(*JOB).agg(*latest, _latest(value, value.isNotNull()).alias("var_focus"), *cursors, F.count("*").alias("n"))


def job_status(events: DataFrame) -> DataFrame:
    """Events, the last title, and the state: that of the last event that ends a job (done or agent_error), else running."""
    ended = F.col("kind").isin("done", "agent_error")
    state = F.coalesce(_latest(F.when(F.col("kind") == "done", "done").otherwise("error"), ended), F.lit("running"))
    return events.groupBy(*JOB).agg(F.count("*").alias("n"), _latest(F.col("title"), F.col("title").isNotNull()).alias("message"), state.alias("state"))


def tail_events(events: DataFrame, n: int = 2000) -> DataFrame:
    """The last n events of each job."""
    rank = F.row_number().over(Window.partitionBy(*JOB).orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("rank", rank).where(F.col("rank") <= n)


BUCKETS = 64


def read_tail(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """What event_tail_sink keeps: of each bucket the newest version (older than before)."""
    rows = spark.read.option("basePath", path).parquet(path)
    rows = rows if before is None else rows.where(F.col("v") < before)
    newest = rows.groupBy("bucket").agg(F.max("v").alias("v"))  # a row per bucket
    return rows.join(F.broadcast(newest), ["bucket", "v"])


def event_tail_sink(events: DataFrame, path: str, checkpoint: str, n: int = 2000):
    """Keeps a table of the last n events of each job. Jobs are dealt into buckets; a batch merges and rewrites only the buckets
    that it has events of, as a new version of these, and the versions before go. A batch that is run again writes the same."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("bucket", F.pmod(F.xxhash64(*JOB), F.lit(BUCKETS)).cast("int"))
        touched = new.select("bucket").distinct()
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        old = None
        if number and store.exists(folder):
            old = read_tail(spark, path, number).join(touched, "bucket", "left_semi")
            passed = [(r["v"], r["bucket"]) for r in old.select("v", "bucket").distinct().collect()]  # BUCKETS rows at most
            new = old.drop("v").unionByName(new)
        tail_events(new.dropDuplicates(["event_id"]), n).drop("rank").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={number}")
        for v, b in passed if old is not None else ():
            store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}/bucket={b}"), True)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visit_gate(opens: DataFrame, needed: DataFrame) -> DataFrame:
    """T04, batch twin: per job and submit the functions still to be opened; it is accepted only when none is left and it has facts.

    opens: (pver_id, order_key, ts, event_id, fn, is_submit, n_facts); needed: (pver_id, order_key, fns array).
    """
    run = Window.partitionBy(*JOB).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = opens.withColumn("seen", F.collect_set(F.when(~F.col("is_submit"), F.col("fn"))).over(run))
    left = seen.join(needed, JOB).withColumn("remaining", F.array_sort(F.array_except("fns", "seen")))
    return left.where("is_submit").select(*JOB, "event_id", ((F.size("remaining") == 0) & (F.col("n_facts") > 0)).alias("accepted"), F.array_join("remaining", ",").alias("remaining"))


class VisitGate(StatefulProcessor):
    """T04's state: a map of the functions that a job has opened, each with the event that did; with a time to live, functions opened longer ago are forgotten."""

    def __init__(self, keep_ms: int | None) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.opened = handle.getMapState("opened", "fn string", "event_id long", self.keep_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        opened = {fn for (fn,) in self.opened.keys()}
        out = []
        for row in pd.concat(rows).sort_values(["ts", "event_id"]).itertuples():
            if row.is_submit:
                left = sorted(set(row.fns) - opened)
                out.append((*key, row.event_id, not left and row.n_facts > 0, ",".join(left)))
            elif row.fn in row.fns:
                opened.add(row.fn)
                self.opened.updateValue((row.fn,), (row.event_id,))
        yield pd.DataFrame(out, columns=[*JOB, "event_id", "accepted", "remaining"])


def visit_gate_stream(opens: DataFrame, needed: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """T04 on a stream of opens: the functions a job has opened are its state, at most as many as its sequence names; each submit gives one row.

    Events of one batch are taken by time. A function that was opened more than keep_ms ago (null: never) counts as not opened and leaves the
    state; opening it again renews it. Streams with such state need the RocksDB state store (STATE_STORE) when they start.
    State that ages asks for batches for ever: with keep_ms, a stream that shall end by itself (availableNow) needs spark.sql.streaming.noDataMicroBatches.enabled off.
    """
    result = "pver_id string, order_key string, event_id long, accepted boolean, remaining string"
    return opens.join(needed, JOB).groupBy(*JOB).transformWithStateInPandas(VisitGate(keep_ms), result, "Append", "None" if keep_ms is None else "ProcessingTime")


def opened_functions(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of a gate's stream by its checkpoint: (pver_id, order_key, fn)."""
    state = spark.read.format("statestore").option("stateVarName", "opened").load(checkpoint)
    return state.select(*[F.col(f"key.{k}") for k in JOB], "user_map_key.fn")
