"""Scores of the class model and of the network by plain loops; fits, joins and the pipeline beyond their usual sizes."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparktriage.llm import op1_brown, op5_join, op7_mix, op9_lang
from sparktriage.llm.arrays import split_words
from sparktriage.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("exchanged", [4, 1000])
def test_brown_scores_by_loops(spark, exchanged):
    """The model's log10 probability of each text, from the classes that the operator gives the words."""
    rng = random.Random(exchanged)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.randint(3, 30)]) for _ in range(rng.randint(0, 12))), i % 4 != 0) for i in range(60)] + [(90, None, True), (91, "never seen w1 Never", False), (92, "W1 w2", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    got = {r["doc_id"]: r["score"] for r in op1_brown.brown_scores(docs, F.col("t"), exchanged=exchanged).collect()}

    schema = "block long, h long, n_all long, n long, often boolean, ord int, docs array<long>, held array<boolean>, lengths array<long>, codes binary"
    words = docs.select("doc_id", "text", F.col("t").alias("trains")).mapInArrow(op1_brown._code(1 << 20), schema).where("h is not null").select("block", "h", "n_all", "n", "often")
    top, owner, _, others = op1_brown.word_classes(docs.where("t").select("text"), words, exchanged)
    kind = dict(zip(top.tolist(), owner.tolist())) | {int(np.int64(r["h"]).view(np.uint64)): r["class"] for r in others.collect()}
    name = lambda w: int(op1_brown.END) if w is None else int(split_words([w.encode()]).hashes()[0])
    tokens = {i: [*re.findall(r"\S+", (text or "").lower()), None] for i, text, _ in rows}
    count = Counter(w for i, _, t in rows if t for w in tokens[i])
    assert {name(w) for w in count} == set(kind)
    classes, unseen_, start = range(op1_brown.CLASSES), "unseen", "start"
    of = lambda w: kind[name(w)] if w in count else unseen_
    mass, once = Counter(), Counter()
    for w, n in count.items():
        mass[of(w)] += n
        once[of(w)] += n == 1
    unseen = {k: min(0.5, once[k] / max(1, mass[k])) for k in classes}
    pairs = Counter(p for i, _, t in rows if t for p in itertools.pairwise([start, *map(of, tokens[i])]))
    often = {k: 1 + sum(pairs[a, k] for a in [*classes, start]) for k in classes}

    def smooth(a, k):
        if a == unseen_:
            total = sum(once[b] + 1e-9 for b in classes)
            return sum((once[b] + 1e-9) / total * smooth(b, k) for b in classes)
        return (pairs[a, k] + op1_brown.PRIOR * often[k] / sum(often.values())) / (sum(pairs[a, b] for b in classes) + op1_brown.PRIOR)

    known = {}
    for i, _, _ in rows:
        score = 0.0
        for a, (k, w) in zip([start, *map(of, tokens[i])], [(of(w), w) for w in tokens[i]]):
            if (a, k) not in known:
                known[a, k] = sum(smooth(a, b) * unseen[b] for b in classes) if k == unseen_ else smooth(a, k)
            score += math.log10(max(known[a, k], 1e-300)) + (math.log10(count[w] / mass[k] * (1 - unseen[k])) if w in count else 0)
        assert abs(got[i] - score) < 1e-6 * max(1, abs(score)), i


def test_language_by_plain_network(spark):
    """Language and score from the gates written out, a byte and a window at a time."""
    texts = ["the cat sat on the mat and was there " * 3, "der Hund und die Katze sind nicht da", "kurz", "x " * 60, "é漢", "123 456", None]
    model = op9_lang.train([t.encode() for t in texts[:2]] * 20, ["en", "de"] * 20, steps=30)
    got = [tuple(r) for r in op9_lang.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()]

    def states(gru, data):
        n, h, out = gru.state.shape[0], np.zeros(gru.state.shape[0]), []
        for b in data:
            a, u = gru.byte[b].astype(float), h @ gru.state.astype(float)
            z, r = 1 / (1 + np.exp(-(a[:n] + u[:n]))), 1 / (1 + np.exp(-(a[n : 2 * n] + u[n : 2 * n])))
            h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * u[2 * n :])
            out.append(h)
        return out

    for i, text in enumerate(texts):
        if not text or not re.search(r"[^\W\d_]", text):
            assert got[i] == (i, "und", 0.0)
            continue
        raw, total = text.encode(), np.zeros(2)
        for at in range(0, len(raw), op9_lang.WINDOW):
            piece = raw[at : at + op9_lang.WINDOW]
            data = piece.ljust(op9_lang.WINDOW)
            for place, (f, b) in enumerate(zip(states(model.forward, data), states(model.backward, data[::-1])[::-1])):
                if place < len(piece):
                    e = np.exp(np.concatenate([f, b, [1.0]]) @ model.out.astype(float))
                    total += e / e.sum()
        total /= len(raw)
        assert got[i][1] == model.languages[total.argmax()] and abs(got[i][2] - total.max()) < 1e-4


@pytest.mark.parametrize("window", [1 << 25, 10, 0])
def test_fit_of_any_size(monkeypatch, window):
    """The nearest sum also where the window of sums would be too wide; never nothing while a document comes nearer."""
    monkeypatch.setattr(op7_mix, "MAX_WINDOW", window)
    assert op7_mix.fit(np.array([30_000_000]), np.array([5]), 75e6)[0] in (2, 3)
    rng = random.Random(window)
    for _ in range(150):
        sizes = list(dict.fromkeys(rng.choice([rng.randint(1, 40), rng.randint(10**6, 10**8)]) if window else rng.randint(1, 60) for _ in range(rng.randint(1, 4))))
        counts = [rng.randint(0, 4) for _ in sizes]
        budget = rng.random() * sum(s * c for s, c in zip(sizes, counts)) * 1.1
        take = op7_mix.fit(np.array(sizes), np.array(counts), budget).tolist()
        assert all(0 <= t <= c for t, c in zip(take, counts))
        best = min(abs(budget - sum(s * k for s, k in zip(sizes, ks))) for ks in itertools.product(*[range(c + 1) for c in counts]))
        assert abs(budget - sum(s * t for s, t in zip(sizes, take))) <= best + 1e-5


def test_fit_stops_at_many_sums(monkeypatch):
    monkeypatch.setattr(op7_mix, "MAX_WINDOW", 0)
    monkeypatch.setattr(op7_mix, "MAX_SUMS", 50)
    sizes, counts = np.array([7, 101, 1009, 10007]), np.array([9, 9, 9, 9])
    take = op7_mix.fit(sizes, counts, 54_321.0)
    assert (take <= counts).all() and abs(54_321 - int(take @ sizes)) < 1009


def test_mix_without_broadcast(spark, monkeypatch):
    want = sorted(map(tuple, op7_mix.query(spark, SF).collect()), key=str)
    monkeypatch.setattr(op7_mix, "PLAN_ROWS", 0)
    monkeypatch.setattr(op7_mix, "SALTS", 3)
    assert sorted(map(tuple, op7_mix.query(spark, SF).collect()), key=str) == want


def test_join_with_frequent_shingles(spark, monkeypatch):
    """A line that all texts have, and many copies: dealt over windows, the links are those of comparing all pairs."""
    rng = random.Random(4)
    line = "a line of words that every text of the table has in common with all others"
    rows = []
    for i in range(60):
        words = [f"v{rng.randint(0, 5000)}" for _ in range(40)]
        rows.append((i, " ".join([*words, line])))
        if i % 3 == 0:
            words[rng.randint(0, 39)] = "changed"
            rows.append((100 + i, " ".join([*words, line])))
    rows += [(200 + i, rows[0][1]) for i in range(30)]
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    least = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = least[a], least[b]
            least = {i: min(x, y) if v in (x, y) else v for i, v in least.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for sampled, often, hot in ((64, 16, 1 << 16), (1, 2, 1 << 16), (1, 2, 4), (2, 3, 1000)):
        for name, value in (("SAMPLED", sampled), ("OFTEN", often), ("HOT_SHINGLES", hot), ("SALTS", 3)):
            monkeypatch.setattr(op5_join, name, value)
        got = op5_join.join_components(docs, like=op5_join.STAGE)
        assert {r["id"]: r["component_id"] for r in got.collect()} == least


def test_pipeline_of_no_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name
