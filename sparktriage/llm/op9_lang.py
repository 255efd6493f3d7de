"""Operator 9, language identification by a bidirectional gated recurrent network over bytes.

A text is cut into windows of WINDOW bytes, the last one filled up with blanks. One recurrence reads a window forwards, one
backwards; from both states every position gets probabilities of the languages, and those of all positions of the text are
averaged. Weights are trained in numpy by backpropagation through time on windows of labelled texts: at most SAMPLE texts,
those of least hash of each language in turn, and PER_TEXT windows of each, at hashed places.

Null texts and texts without a letter get `und` with score 0, as does every text if there is nothing to learn from. Only the
text decides; equal texts get equal answers. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fold, near, table, text_slices

WINDOW, HIDDEN = 48, 8
SAMPLE, PER_TEXT = 6000, 4
#: Rows of a language that may be drawn at least, and languages that are broadcast at most.
LEAST_PER_LANGUAGE, BROADCAST_LANGUAGES = 200, 100_000
STEPS, BATCH, RATE = 260, 256, 0.02
_LETTER = regex.compile(r"\p{L}")


def windows(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, one per row, and how many each text has."""
    counts = np.array([-(-len(t) // width) for t in texts], np.int64)
    joined = b"".join([t.ljust(int(c) * width) for t, c in zip(texts, counts)])
    return np.frombuffer(joined, np.uint8).reshape(-1, width), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Gru:
    """One direction: what a byte adds to the gates and the proposal, and what the state before adds."""

    byte: np.ndarray  # 256 x 3 HIDDEN
    state: np.ndarray  # HIDDEN x 3 HIDDEN

    def run(self, x: np.ndarray, keep: bool = False):
        """The states after each column of x (time first), and what training needs."""
        n = self.state.shape[0]
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((x.shape[0], x.shape[1], n), np.float32)
        notes = []
        for t in range(x.shape[0]):
            a, u = self.byte[x[t]], h @ self.state
            gates = _sigmoid(a[:, : 2 * n] + u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(a[:, 2 * n :] + r * u[:, 2 * n :])
            if keep:
                notes.append((h, z, r, c, u[:, 2 * n :]))
            h = out[t] = c + z * (h - c)
        return out, notes

    def gradients(self, x: np.ndarray, d_out: np.ndarray, notes) -> tuple[np.ndarray, np.ndarray]:
        """Backpropagation through time."""
        n = self.state.shape[0]
        d_byte, d_state = np.zeros_like(self.byte), np.zeros_like(self.state)
        d_all = np.empty((*x.shape, 3 * n), np.float32)
        dh = np.zeros((x.shape[1], n), np.float32)
        for t in range(x.shape[0] - 1, -1, -1):
            before, z, r, c, u = notes[t]
            dh = dh + d_out[t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (before - c) * z * (1 - z)
            dr = dc * u * r * (1 - r)
            d_all[t] = np.concatenate([dz, dr, dc], 1)
            through = np.concatenate([dz, dr, dc * r], 1)
            d_state += before.T @ through
            dh = dh * z + through @ self.state.T
        flat, rows = x.ravel(), d_all.reshape(-1, 3 * n)
        order = np.argsort(flat, kind="stable")
        values, first = np.unique(flat[order], return_index=True)
        d_byte[values] = np.add.reduceat(rows[order], first)
        return d_byte, d_state


@dataclass
class LanguageModel:
    languages: list[str]
    forward: Gru
    backward: Gru
    out: np.ndarray  # 2 HIDDEN + 1 x languages

    def _logits(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.forward.state.shape[0]
        return f @ self.out[:n] + b @ self.out[n : 2 * n] + self.out[-1]

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (window, position, language)."""
        seq = np.ascontiguousarray(x.T)
        f, _ = self.forward.run(seq)
        b, _ = self.backward.run(seq[::-1])
        p = np.exp(self._logits(f, b[::-1]))
        p /= p.sum(2, keepdims=True)
        return p.transpose(1, 0, 2)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities (text, language); a text without bytes has zeros."""
        x, counts = windows(texts)
        sums = np.zeros((len(x), len(self.languages)))
        filled = np.full(len(x), WINDOW)
        last = np.cumsum(counts) - 1
        some = counts > 0
        lengths = np.array([len(t) for t in texts], np.int64)
        filled[last[some]] = lengths[some] - (counts[some] - 1) * WINDOW
        inside = np.arange(WINDOW) < filled[:, None]
        for i in range(0, len(x), 4096):
            sums[i : i + 4096] = (self.positions(x[i : i + 4096]) * inside[i : i + 4096, :, None]).sum(1)
        pooled = np.zeros((len(texts), len(self.languages)))
        np.add.at(pooled, np.repeat(np.arange(len(texts)), counts), sums)
        return pooled / np.maximum(lengths, 1)[:, None]


def train(texts: list[bytes], labels: list[str], seed: int = 5, steps: int = STEPS) -> LanguageModel | None:
    """A model of windows with labels (texts are cut or filled up to WINDOW bytes), None without any."""
    if not texts:
        return None
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    x = np.frombuffer(b"".join(t[:WINDOW].ljust(WINDOW) for t in texts), np.uint8).reshape(-1, WINDOW)
    rng = np.random.RandomState(seed)
    weight = lambda *shape, by: (rng.randn(*shape) * by).astype(np.float32)
    model = LanguageModel(names, *[Gru(weight(256, 3 * HIDDEN, by=0.3), weight(HIDDEN, 3 * HIDDEN, by=0.3)) for _ in range(2)], weight(2 * HIDDEN + 1, len(names), by=0.1))
    params = [model.forward.byte, model.forward.state, model.backward.byte, model.backward.state, model.out]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = rng.randint(0, len(x), BATCH)
        seq, target = np.ascontiguousarray(x[pick].T), y[pick]
        f, f_notes = model.forward.run(seq, True)
        b, b_notes = model.backward.run(seq[::-1], True)
        b = b[::-1]
        p = np.exp(model._logits(f, b))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(BATCH), target] -= 1
        p = (p / p[..., 0].size).astype(np.float32)
        n = HIDDEN
        flat = p.reshape(-1, p.shape[2])
        d_out = np.concatenate([f.reshape(-1, n).T @ flat, b.reshape(-1, n).T @ flat, flat.sum(0, keepdims=True)])
        back = p[::-1] @ model.out[n : 2 * n].T
        grads = [*model.forward.gradients(seq, p @ model.out[:n].T, f_notes), *model.backward.gradients(seq[::-1], back, b_notes), d_out]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for w, g, m, v in zip(params, grads, first, second):  # Adam with clipped gradients
            g = g * min(1.0, 1.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= RATE * min(1.0, 2 * (1 - step / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def sample(labelled: DataFrame, size: int = SAMPLE, per_text: int = PER_TEXT) -> tuple[list[bytes], list[str]]:
    """Windows and labels of at most size rows (doc_id, text, lang), as many of each language as there are; what reaches the driver is bounded in bytes, too.

    Of each language the rows of least hash are taken in turn, so a rare one is learned as well. Rows whose hash can't be among
    these never meet: a language's share of hashes follows from its count.
    """
    usable = labelled.where("lang is not null and length(text) > 0")
    counts = checkpoint(usable.groupBy("lang").agg(F.count("*").alias("n")))
    wanted = max(LEAST_PER_LANGUAGE, 8 * size // max(1, counts.count()))
    share = F.least(F.lit(1.0), F.lit(float(wanted)) / F.col("n"))
    most = counts.select("lang", "n", F.when(share < 1, ((share * 2 - 1) * 2.0**63).cast("long")).otherwise(F.lit(2**63 - 1)).alias("most"))
    places = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1) for i in range(per_text)]
    pieces = F.array(*[F.substring("text", (p + 1).cast("int"), F.lit(WINDOW)) for p in places])
    rank = F.xxhash64("doc_id")
    few = usable.join(near(checkpoint(most), BROADCAST_LANGUAGES), "lang").where(rank <= F.col("most"))
    few = few.select("doc_id", "lang", pieces.alias("pieces"), rank.alias("rank"), ((rank / 2.0**64 + 0.5) * F.col("n")).alias("turn"))  # its place among its language's hashes, as even hashes have it
    chosen = few.orderBy("turn", "rank", "doc_id", "lang").limit(size)
    cut = chosen.select("doc_id", "lang", F.posexplode("pieces").alias("i", "piece"))
    rows = cut.orderBy("doc_id", "i").select("piece", "lang").toPandas()
    return [t.encode() for t in rows["piece"]], rows["lang"].tolist()


def predict(docs: DataFrame, model: LanguageModel | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_slices(batch, 1, 1 << 20):
                some = [t if model and _LETTER.search(t.decode()) else b"" for t in texts]
                p = model.texts(some) if model else np.zeros((j - i, 1))
                best = p.argmax(1)
                names = [model.languages[k] if t else "und" for k, t in zip(best, some)]
                score = np.where([bool(t) for t in some], np.clip(p[np.arange(j - i), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(score)], ["_key", "lang_pred", "score"])

    slim = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text"))
    return slim.mapInArrow(run, f"_key {slim.schema['_key'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("_key", doc_id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 4) == 2
    model = train(*sample(docs.where(~held)))
    return predict(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
