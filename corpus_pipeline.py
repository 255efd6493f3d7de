"""The corpus pipeline: documents through quality rules, line dedup, near-duplicate removal, source mixing and tokenization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparktriage.llm import op2_lines, op3_bpe, op5_join, op6_rules, op7_mix
from sparktriage.llm.common import reread, table

#: (name, function); each function takes (spark, docs, sf_dir), and its result is written and read again as the next one's docs.
STAGES = [
    ("quality rules", op6_rules.stage),
    ("line dedup", op2_lines.stage),
    ("n-gram Jaccard join", op5_join.stage),
    ("source mixing", op7_mix.stage),
    ("byte-level BPE", op3_bpe.stage),
]

#: Learned rules and the fitted mix have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder as Parquet files before the next one reads them."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = reread(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
