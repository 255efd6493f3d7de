"""Operators 11 to 13 against brute force and the library, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sparktriage.llm import op11_resample, op12_pieces, op13_vptree
from sparktriage.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, n_words string, score double, rank long"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD = [(1, None, "a", "x", 1.0, 1), (2, "", None, None, None, None), (3, " \n\t ..", "a", "x", 1.0, 1), (4, LONG, "a", "x", 1.0, 1), (5, LONG, "a", "x", 1.0, 1), (5, LONG, "a", "x", 1.0, 1), (5, "other " * 25, "a", "x", 1.0, 1), (6, "One two-THREE É", "b", "y", 1.0, 1), (None, "a b " * 30, "b", "y", 1.0, 1), (7, "no blank" * 5000, "b", "y", 1.0, 1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def resampled(rows, targets, low, high, buckets, least_words, percent, seed):
    """(doc_id, n_features, weight, score, rank) by plain loops."""

    def runs(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(words), [" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    told = [(i, *runs(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in told for f in fs), Counter(bucket(f) for x in targets for f in runs(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)}
    out = []
    for i, n, fs in told:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        u = (int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append([i, len(fs), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log(u))), None, n])
    pool = sorted((r for r in out if r[5] >= least_words and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for place, r in enumerate(pool[: percent * sum(r[5] >= least_words for r in out) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in out), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("low, high, buckets, least, percent", [(1, 1, 10_000, 20, 10), (1, 3, 97, 1, 60), (2, 2, 1000, 3, 100)])
def test_resample(spark, odd, low, high, buckets, least, percent):
    targets = ["word1 word2 two", None, "", "THREE é a b"]
    want = resampled([(r[0], r[1]) for r in ODD], targets, low, high, buckets, least, percent, 5)
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    assert rows(op11_resample.resample(odd, target, least_n=low, most_n=high, buckets=buckets, least_words=least, percent=percent, seed=5)) == want


def test_resample_tables(spark, odd):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    given = [tuple(r) for r in docs.collect()]
    want = resampled(given, [r[0] for r in table(spark, SF, "benchmark").select("text").collect()], 1, 1, 10_000, 20, 10, 2024)
    assert rows(op11_resample.query(spark, SF)) == want
    none = spark.createDataFrame([], "text string")
    assert rows(op11_resample.resample(docs, none, most_n=2)) == resampled(given, [], 1, 2, 10_000, 20, 10, 2024)
    assert op11_resample.resample(odd.limit(0), none).collect() == []


def test_resample_hot_copies(spark):
    """Copies of one id are counted, not numbered; ranks stay without gaps."""
    many = spark.range(3000).select((F.col("id") % 3 * F.col("id")).alias("doc_id"), F.lit("a b c " * 9).alias("text"))
    want = resampled([tuple(r) for r in many.collect()], ["a"], 1, 1, 10_000, 20, 50, 2024)
    got = rows(op11_resample.resample(many, spark.createDataFrame([("a",)], "text string"), percent=50))
    assert got == want and sorted(r[4] for r in got if r[4]) == list(range(1, 1501))


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path(op12_pieces.MODEL)
    return op12_pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_pieces_equal_library(pieces):
    own, library = pieces
    rng = random.Random(1)
    names = [library.id_to_piece(i) for i in range(259, library.get_piece_size())]
    some = [
        lambda: "".join(rng.choice(" ab\n▁  ec") for _ in range(rng.randint(0, 40))),
        lambda: "".join(rng.choice(names) for _ in range(rng.randint(1, 8))),
        lambda: "".join(rng.choice(names).replace("▁", " ") for _ in range(rng.randint(1, 8))),
        lambda: "".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0x2FFF), rng.randint(0x4E00, 0x9FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(1, 12))),
    ]
    texts = ["", " ", "  a", "a  ", "▁", "<s></s><0x0A><unk>", "\0", " " * 5000, "ab" * 20_000, "漢字" * 3000, LONG] + [f() for f in some for _ in range(2500)]
    for text in texts:
        ids = own.encode(text)
        want = library.encode(text, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids).decode() == library.decode(want), text
    for _ in range(4000):  # ids that no text has
        ids = [rng.choice([rng.randint(0, 2), rng.randint(3, 258), rng.randint(0, 31_999)]) for _ in range(rng.randint(0, 8))]
        assert own.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids), ids


def test_pieces_whole_texts(pieces):
    """Without the cut at space marks the table of prefixes gives the same ids; the rule of pairs holds for them."""
    own, library = pieces
    whole = op12_pieces.PieceModel(public_tokenizers.path(op12_pieces.MODEL))
    whole.apart = False
    for text in duckdb.sql(f"select text from '{SF}/documents.parquet' where text is not null limit 25").fetchall():
        ids = np.frombuffer(whole.encode(text[0][:3000]), "<u4").tolist()
        assert ids == library.encode(text[0][:3000], add_eos=True)
        assert all(own.goes_with(a, b) for a, b in zip(ids, ids[1:-1]) if a not in own.byte_of and b not in own.byte_of)


def test_pieces_forget(pieces, monkeypatch):
    own, library = pieces
    monkeypatch.setattr(op12_pieces, "KNOWN_STRETCHES", 10)
    monkeypatch.setattr(op12_pieces, "KNOWN_PAIRS", 10)
    for text in ("one two three four five six seven eight nine ten eleven", LONG[:5000], "one two"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_eos=True)


def test_pieces_documents(spark, odd, pieces):
    _, library = pieces
    full = op12_pieces.encode_documents(odd)
    assert full.columns == [*odd.columns, "_ids", "_decoded"]
    got = full.collect()
    assert len(got) == len(ODD)
    for r in got:
        assert r["_ids"] == library.encode(r["text"] or "", add_eos=True) and r["_decoded"] == library.decode(r["_ids"])
    with pytest.raises(ValueError):
        op12_pieces.encode_documents(odd.withColumn("_ids", F.lit(1)))
    assert op12_pieces.encode_documents(odd.limit(0)).collect() == []
    texts = table(spark, SF, "documents").select("doc_id", "text").collect()
    want = []
    for i, text in texts:
        ids = library.encode(text or "", add_eos=True)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert rows(op12_pieces.query(spark, SF)) == sorted(want, key=str)


def clustered(given, k, rounds, dims, seed):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by plain loops over Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in given if i is not None and v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(centers)):
            mine = [v for (_, v), o in zip(kept, of) if o == j]
            if mine:
                centers[j] = [sum(x) // len(mine) for x in zip(*mine)]
    told = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in told:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in told), key=str)


@pytest.mark.parametrize("k, n, spread", [(1, 5, 3), (8, 400, 2), (40, 300, 3), (9, 200, 100_000), (5, 60, 1 << 17)])
def test_clusters(spark, k, n, spread):
    rng = random.Random(k)
    given = [(rng.randint(0, n), [rng.randint(-spread, spread) / 8 for _ in range(4)]) for _ in range(n)]  # repeated ids and vectors, ties
    given += [(None, [1.0] * 4), (1, None), (2, [1.0] * 3), (3, [1.0, None, 1.0, 1.0]), (4, [math.nan] + [0.0] * 3), (5, [math.inf] + [0.0] * 3), (6, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in given], "vec_id long, embedding array<double>, cluster string, n int")
    assert rows(op13_vptree.cluster(df, k=k, rounds=4, dims=4, seed=3)) == clustered(given, k, 4, 4, 3)


def test_clusters_empty(spark):
    df = spark.createDataFrame([(1, None), (None, [1.0] * 64)], "vec_id long, embedding array<float>")
    got = op13_vptree.cluster(df)
    assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert op13_vptree.cluster(df.limit(0)).collect() == []


def test_clusters_by_sql(spark):
    want = duckdb.connect()
    want.sql(f"create view embeddings as from '{SF}/embeddings.parquet'")
    assert rows(op13_vptree.query(spark, SF)) == sorted(want.sql(op13_vptree.SQL).fetchall(), key=str)


@pytest.mark.parametrize("k, top, leaf", [(1, 5, 2), (7, 2, 1), (64, 3, 2), (300, 1000, 2), (50, 1 << 22, 4), (20, 1 << 29, 2)])
def test_vantage_points(k, top, leaf):
    """Exact nearest centroid and the smaller number of equals, with fewer distances than all where centroids lie apart."""
    rng = np.random.RandomState(k)
    centers, v = rng.randint(-top, top + 1, (k, 3)), rng.randint(-top, top + 1, (500, 3))
    centers[k // 2 :: 3] = centers[0]  # equal centroids
    got, least, tests = op13_vptree.nearest(v, centers, op13_vptree.build(centers, leaf))
    d = ((v[:, None].astype(object) - centers[None].astype(object)) ** 2).sum(2)
    assert got.tolist() == [min(range(k), key=lambda j: (row[j], j)) for row in d] and least.tolist() == d.min(1).tolist()
    assert tests <= d.size and (k < 300 or tests < d.size / 3)
