"""Operator 6, quality rules as learned decision lists.

Statistics of each text are compared with thresholds. Sequential covering learns an ordered list of rules from labelled
rows: a rule grows as a conjunction of thresholds that picks low-quality rows, is pruned on rows held back from growing, and
is kept if it is precise there; rows that it covers leave, and the next rule is learned. The list becomes one ordered Spark
conditional expression.

Null text has no words and no lines. Without labelled rows of both kinds the list is empty and nothing but the base rule
rejects. Repeated label rows count as often as they stand; labels for unknown documents and null labels are not used.
score() gives the id and what it finds; stage() keeps all columns of docs, also those named like a statistic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .arrays import mix, split_words, windows3
from .common import table, text_slices

#: At most so many labelled rows are fitted on, those with the least hash of their id.
MAX_LABELLED = 20_000
#: A rule must be so precise on the rows held back for pruning, by a one-sided lower bound, and cover so many rows.
MIN_PRECISION, MIN_COVER, MAX_RULES, MAX_TERMS = 0.8, 10, 12, 3

#: Texts that are looked at together; a single longer one goes alone.
SLICE_BYTES = 1 << 18

STATS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long", "n_chars_all": "long", "n_alpha": "long", "n_upper": "long", "n_digit": "long", "n_stop": "long", "n_distinct": "long"}
#: What the rules compare, as SQL over the statistics.
FEATURES = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_ratio": "n_symbols / greatest(n_words, 1)",
    "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
    "alpha_ratio": "n_alpha / greatest(word_chars, 1)",
    "upper_ratio": "n_upper / greatest(word_chars, 1)",
    "digit_ratio": "n_digit / greatest(word_chars, 1)",
    "short_ratio": "n_stop / greatest(n_words, 1)",
    "distinct_ratio": "n_distinct / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}
_KIND = np.zeros((5, 256), bool)  # symbol, letter byte, upper, digit, start of a code point
_KIND[0, list(b"#*$%&|<>")] = True
_KIND[1, [*range(65, 91), *range(97, 123), *range(0xC3, 0xF5)]] = True
_KIND[2, range(65, 91)] = True
_KIND[3, range(48, 58)] = True
_KIND[4] = True
_KIND[4, range(0x80, 0xC0)] = False


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines), len(lines) - len(set(lines))


def text_stats(texts: list[bytes]) -> np.ndarray:
    """One row per text, columns as in STATS."""
    w = split_words(texts)
    n, h = len(texts), w.hashes()
    out = np.zeros((n, len(STATS)), np.int64)
    if not n:
        return out
    gap = np.concatenate([w.text_start, [len(w.raw) + 1]])
    per_text = []
    for kind in _KIND:  # one at a time: a running sum is four times as long as the texts
        sums = np.zeros(len(w.raw) + 1, np.int32)
        np.cumsum(kind[w.raw], out=sums[1:])
        per_text.append(sums[np.minimum(gap[1:] - 1, len(w.raw))] - sums[gap[:-1]])
    chars = (sums[w.ends] - sums[w.starts]).astype(np.int64)
    out[:, 0] = np.diff(w.first)
    out[:, 1] = np.bincount(w.doc, chars, n)
    out[:, 2] = per_text[0]
    out[:, 6] = per_text[4]
    out[:, 7:10] = np.array(per_text[1:4]).T
    out[:, 10] = np.bincount(w.doc, chars <= 3, n)
    out[:, 11] = np.bincount(w.doc[np.unique(mix(h ^ mix(w.doc.astype(np.uint64) + np.uint64(1))), return_index=True)[1]], minlength=n)
    out[:, 5], out[:, 3] = np.array([_dup_lines(t) for t in texts]).T
    if len(h) >= 3:
        inside = np.flatnonzero(w.doc[:-2] == w.doc[2:])  # windows that run into the next text are none
        g = mix(windows3(h)[inside] ^ mix(w.doc[inside].astype(np.uint64) + np.uint64(1)))  # those of different texts never meet
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = np.zeros(len(h) - 2, bool)
        hit[inside[twice]] = True
        word = np.zeros(len(h), bool)
        for k in range(3):
            word[k : k + len(hit)] |= hit
        out[:, 4] = np.bincount(w.doc, word, n)
    return out


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, texts in text_slices(batch, 1, SLICE_BYTES):
            values = text_stats(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *[pa.array(c) for c in values.T]], ["_key", *STATS])


def stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the statistics of STATS) for every row."""
    slim = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text"))
    fields = ", ".join(f"{k} {v}" for k, v in STATS.items())
    return slim.mapInArrow(_stats_batches, f"_key {slim.schema['_key'].dataType.simpleString()}, {fields}").withColumnRenamed("_key", doc_id)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold); rows that fulfil it are rejected."""

    terms: tuple[tuple[str, str, float], ...]

    def sql(self) -> str:
        return " and ".join(f"({FEATURES[f]}) {op} {x!r}D" for f, op, x in self.terms)

    def covers(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(values.values()))), bool)
        for f, op, x in self.terms:
            out &= values[f] <= x if op == "<=" else values[f] > x
        return out


def _lower_bound(bad: int, n: int, z: float = 1.0) -> float:
    """Wilson's lower bound of bad / n."""
    if not n:
        return 0.0
    p = bad / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _best_term(values: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> tuple[float, tuple[str, str, float]] | None:
    """The threshold with most information gain (FOIL) over the rows inside."""
    p0, n0, best = bad[inside].sum(), inside.sum(), None
    for name, v in values.items():
        order = np.argsort(v[inside], kind="stable")
        x, b = v[inside][order], bad[inside][order]
        edge = np.flatnonzero(x[1:] > x[:-1])
        if not len(edge):
            continue
        below, n_below = np.cumsum(b)[edge], edge + 1
        for op, p, n in (("<=", below, n_below), (">", p0 - below, n0 - n_below)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / n) - np.log2(p0 / n0)), -1.0)
            k = int(np.argmax(gain))
            if best is None or gain[k] > best[0]:
                best = float(gain[k]), (name, op, float((x[edge[k]] + x[edge[k] + 1]) / 2))
    return best


def learn(values: dict[str, np.ndarray], bad: np.ndarray, held: np.ndarray) -> list[Rule]:
    """Sequential covering: grow on the rows that are not held, prune and accept on the held ones."""
    rules: list[Rule] = []
    alive = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES:
        grow, prune = alive & ~held, alive & held
        terms: list[tuple[str, str, float]] = []
        inside = grow.copy()
        while len(terms) < MAX_TERMS and 0 < bad[inside].sum() < inside.sum():
            if (found := _best_term(values, bad, inside)) is None or found[0] <= 0:
                break
            terms.append(found[1])
            inside = grow & Rule(tuple(terms)).covers(values)
        worth = []
        for k in range(1, len(terms) + 1):  # final terms go as long as the rule does better on held rows without them
            c = prune & Rule(tuple(terms[:k])).covers(values)
            worth.append((_lower_bound(bad[c].sum(), c.sum()), -k))
        if not worth:
            break
        bound, k = max(worth)
        rule = Rule(tuple(terms[:-k]))
        hit = rule.covers(values) & alive
        if bound < MIN_PRECISION or hit.sum() < MIN_COVER:
            break
        rules.append(rule)
        alive &= ~hit
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from labels (doc_id, quality 1 or 0) of docs; at most max_labelled rows reach the driver, as numbers."""
    known = labels.where("quality in (0, 1)").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    rows = stats(docs.join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")).join(F.broadcast(known), "doc_id")
    got = rows.selectExpr("doc_id", "quality", *[f"cast({e} as double) as {f}" for f, e in FEATURES.items()]).orderBy("doc_id", "quality").toPandas()
    if got.empty or got["quality"].nunique() < 2:
        return []
    held = (mix(got["doc_id"].fillna(-1).to_numpy(np.int64).astype(np.uint64)) % np.uint64(3)) == 0
    return learn({f: got[f].to_numpy() for f in FEATURES}, (got["quality"] == 0).to_numpy(), held)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, null if none does: an ordered conditional expression."""
    return F.expr("case " + " ".join(f"when {r.sql()} then {i}" for i, r in enumerate(rules, 1)) + " end") if rules else F.lit(None).cast("int")


BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def score(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, the statistics, base_failed, rule, kept) of every row."""
    done = stats(docs).withColumns({"base_failed": F.expr(BASE_FAILED), "rule": verdict(rules)})
    return done.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents that neither the base rule nor a learned rule rejects; all their columns, whatever their names, are as they were."""
    rules = fit(docs, table(spark, sf_dir, "labels"))
    place = docs.columns.index("text")
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no name of the statistics begins with c and a number
    fields = StructType([*rows.schema.fields, *[StructField(k, LongType()) for k in STATS]])

    def with_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_slices(batch, place, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, *[pa.array(c) for c in text_stats(texts).T]], [*batch.schema.names, *STATS])

    kept = rows.mapInArrow(with_stats, fields).where(~F.expr(BASE_FAILED) & verdict(rules).isNull())
    return kept.select(*rows.columns).toDF(*docs.columns)
