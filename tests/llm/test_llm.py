"""The training-data operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparktriage.llm import op1_brown, op2_lines, op3_bpe, op4_rans, op5_join, op6_rules, op7_mix, op8_secrets, op9_lang, op10_knn
from sparktriage.llm.common import components, fold, table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, size long"
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ODD = [(1, None, "en", "a", 0, "n", 1), (2, "", "en", None, 0, None, 2), (3, " \n\t ", None, "a", 4, "n", 3), (4, LONG, "en", "a", len(LONG), "n", 4), (5, LONG, "en", "b", len(LONG), "n", 5), (5, LONG, "en", "b", len(LONG), "n", 5), (6, "one two", "en", "b", 7, None, 6), (7, "漢字 \U0001f600 é", "fr", "", 5, "n", 7), (None, "x y z", "de", "b", None, "n", 8)]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").orderBy("doc_id").toPandas()


def test_brown(spark, odd, docs):
    def check(df, rows):
        got = sorted(op1_brown.brown_scores(df, fold("doc_id", 7) != 2).collect(), key=lambda r: (r["doc_id"] or -1, r["n_tokens"]))
        toks = [[*words(lower(t)), None] for _, t in rows]
        held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
        c = Counter(w for t, h in zip(toks, held) if not h for w in t)
        n, v = sum(c.values()), len(c)
        want = sorted(((i or -1, len(t), sum(w in c for w in t), h, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for (i, _), t, h in zip(rows, toks, held)), key=lambda r: r[:2])
        for g, w in zip(got, want, strict=True):
            assert (g["doc_id"] or -1, g["n_tokens"], g["n_known"], g["held_out"], g["train_tokens"]) == (*w[:4], n)
            assert abs(g["base_score"] - w[4]) < 1e-6 * max(1, abs(w[4])) and g["score"] < 0
        return got

    check(odd, [(r[0], r[1]) for r in ODD])
    got = check(spark.createDataFrame(docs[["doc_id", "text"]]), list(zip(docs["doc_id"].tolist(), docs["text"])))
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better than the unigram base on held-out texts
    assert op1_brown.brown_scores(odd.limit(0), fold("doc_id", 7) != 2).count() == 0
    assert op1_brown.brown_scores(odd, F.lit(False)).where("n_known > 0 or train_tokens > 0").count() == 0
    df = spark.createDataFrame(docs[["doc_id", "text"]])
    small = {r["doc_id"]: r["score"] for r in op1_brown.brown_scores(df, fold("doc_id", 7) != 2, block_bytes=20_000).collect()}  # of many blocks
    assert all(abs(r["score"] - small[r["doc_id"]]) < 1e-6 * abs(r["score"]) for r in got) and len(small) == len(got)


def test_brown_gives_every_word_the_class_of_most_gain(spark, docs):
    texts = docs["text"].dropna().head(60).tolist()
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    toks = [[*words(lower(t)), None] for t in texts]
    count = Counter(w for t in toks for w in t)
    name = {int(h): w for t in texts for h, w in zip(op1_brown._tokens([t.encode()])[0], [*words(lower(t)), None])}
    counts = spark.createDataFrame([(int(np.uint64(h).astype(np.int64)), count[w], True) for h, w in name.items()], "h long, n long, often boolean")
    top, owner, top_count, others = op1_brown.word_classes(df, counts, 40)
    others = [(name[int(np.int64(r["h"]).astype(np.uint64))], r["class"], r["total"]) for r in others.collect()]
    classes = {w: c for w, c, _ in others}
    assert all(count[w] == n for w, _, n in others)
    own = {name[int(h)]: int(c) for h, c in zip(top, owner)}
    assert set(classes) | set(own) == set(count) and not set(classes) & set(own) and [count[name[int(h)]] for h in top] == top_count.tolist()
    kind = lambda w: own.get(w, op1_brown.OTHER)
    grid = np.zeros((op1_brown.WIDTH, op1_brown.WIDTH))
    left, right = {w: np.zeros(op1_brown.WIDTH) for w in classes}, {w: np.zeros(op1_brown.WIDTH) for w in classes}
    for t in toks:
        for a, b in zip([op1_brown.START, *map(kind, t)], t):
            grid[a, kind(b)] += 1
            if b in left:
                left[b][a] += 1
        for a, b in zip(t, map(kind, t[1:])):
            if a in right:
                right[a][b] += 1

    def likelihood(g):
        return op1_brown._xlogx(g).sum() - op1_brown._xlogx(g.sum(0)).sum() - op1_brown._xlogx(g.sum(1)).sum()

    for w in random.Random(1).sample(sorted(classes, key=str), 60):
        worth = []
        for c in range(op1_brown.CLASSES):
            g = grid.copy()
            g[:, c] += left[w]
            g[c] += right[w]
            worth.append(likelihood(g))
        assert worth[classes[w]] >= max(worth) - 1e-6


def test_exchange_finds_classes():
    rng = np.random.RandomState(1)
    grid = np.zeros((22, 22), np.int64)
    a, b = np.arange(0, 20, 2), np.arange(1, 20, 2)
    grid[np.ix_(a, b)] = rng.poisson(30, (10, 10))
    grid[np.ix_(b, a)] = rng.poisson(30, (10, 10))
    owner, by_class = op1_brown.exchange(grid, classes=2)
    assert by_class.sum() == grid.sum()
    assert len(set(owner[a])) == len(set(owner[b])) == 1 and owner[0] != owner[1]


def test_line_dedup(spark, odd):
    pages = [(i, f"top {i % 2}\nown {i}\n\n top 0 ", "h" if i % 4 else None) for i in range(12)]
    df = spark.createDataFrame([*pages, (99, None, "h")], "doc_id long, text string, source string")
    done, salted = (op2_lines.dedup_lines(df, F.split("text", "\n"), F.col("source"), 0.6, 3, limit).select("row.doc_id", F.array_join("kept", "\n").alias("t")).collect() for limit in (10, 0))
    assert sorted(done) == sorted(salted) and len(done) == 13
    n = Counter((s, x) for _, t, s in pages for x in {x.strip() for x in t.split("\n")} if x)
    total = Counter(s for _, _, s in pages) + Counter(["h"])
    for r in done:
        row = next((p for p in pages if p[0] == r["doc_id"]), None)
        assert r["t"] == (None if row is None else "\n".join(x for x in row[1].split("\n") if not (n[row[2], x.strip()] >= 3 and n[row[2], x.strip()] > 0.6 * total[row[2]])))
    staged = op2_lines.stage(spark, odd, SF)
    assert staged.columns == odd.columns and staged.count() == len(ODD)


def test_line_dedup_small_source(spark):
    rows = [(i, f"license\nown {i}", "small") for i in range(5)] + [(5, "twice\none", "tiny"), (6, "twice\ntwo", "tiny")]
    got = op2_lines.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [*(f"own {i}" for i in range(5)), "twice\none", "twice\ntwo"]


def test_bpe(spark, odd):
    path = public_tokenizers.path(op3_bpe.RANKS)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = op3_bpe.Encoder(path)
    random.seed(4)
    texts = ["".join(random.choice(["a", "b", "tion", "é", " ", "  ", "\n", "1", "'s", "漢", ".", "\x1c", " "]) for _ in range(random.randint(0, 80))) for _ in range(400)]
    texts += ["a" * 5000, "".join(random.choice("abcdetion") for _ in range(40_000)), " ", " \n "]
    for t in texts:
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(t), repr(t)
        assert own.decode(ids) == t.encode()
    for r in op3_bpe.digests(odd).collect():
        text = next((x[1] for x in ODD if x[0] == r["doc_id"]), None) or ""
        ids = want.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert op3_bpe.stage(spark, odd, SF).count() == len(ODD)


def test_rans_codec():
    rng = np.random.RandomState(3)
    ids = (rng.zipf(1.3, 100_000) % 40_000).astype(np.uint32)
    t = op4_rans.Table.fit(np.bincount(ids, minlength=49_408))
    assert int(t.freq.sum()) == 1 << op4_rans.SCALE and (t.freq[np.unique(ids)] > 0).all()
    for n in (0, 1, 511, 512, 513, 32_768, 32_769, 100_000):
        assert (op4_rans.decode_block(*op4_rans.encode_block(ids[:n], t), n, t) == ids[:n]).all()
    stream, marks, sums = op4_rans.encode_block(ids, t)
    assert (op4_rans.decode_part(stream, marks, sums, len(ids), 2, t) == ids[65_536:98_304]).all()  # without the parts before
    with pytest.raises(ValueError):
        op4_rans.decode_part(bytes(8) + stream[8:], marks, sums, len(ids), 0, t)
    only = op4_rans.Table.fit(np.array([0, 5, 0]))
    assert (op4_rans.decode_block(*op4_rans.encode_block(np.ones(9, np.uint32), only), 9, only) == 1).all()


def test_rans_files(spark, odd):
    library = Tokenizer.from_file(public_tokenizers.path(op4_rans.VOCABULARY))
    random.seed(5)
    texts = ["".join(random.choice(["a", "B", "́", "Σ", " ", "\n", " ", "é", "1", "'s", "<|endoftext|>", "漢", "x", ".", ",", "!", "'", "|", "_", "'ve"]) for _ in range(30)) for _ in range(300)]
    own = op4_rans.WordTokenizer(public_tokenizers.path(op4_rans.VOCABULARY))
    texts += ["Ärger größer à í ÿ ÷ × ß. é, É, ŁŒ ǰ J̌ H̱ é. ñ! Ñ?", "x", ".", "", " a. ", "İ. K. Σας ΣΑΣ.", *("".join(random.choice("aßàíéÉz .,!\n̈") for _ in range(40)) for _ in range(300))]
    assert own.known
    for t, ids in zip(texts, own.encode([t.encode() for t in texts])):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
    segments = op4_rans.write_ids(odd)
    got = op4_rans.read_ids(segments).orderBy("start").collect()
    rows = sorted(((r[0], r[1] or "") for r in ODD), key=lambda r: -1 if r[0] is None else r[0])
    start = 0
    for g, (doc, text) in zip(got, rows, strict=True):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (g["doc_id"], g["start"], g["n_tokens"]) == (doc, start, len(ids)) and bytes(g["ids"]) == np.array(ids, "<u4").tobytes()
        start += len(ids)
    segments = op4_rans.write_ids(odd.limit(0))
    assert op4_rans.read_ids(segments).count() == 0


def test_rans_files_of_another_session(spark, odd, tmp_path):
    out = f"{tmp_path}/ids"
    assert op4_rans.write_ids(odd, out=out) == out
    records = spark.newSession().read.parquet(out)
    assert records.columns == [x.split()[0] for x in op4_rans.SEGMENTS.split(", ")] and records.agg(F.sum(F.length("docs") / 8)).first()[0] == len(ODD)
    got = [tuple(r) for r in op4_rans.read_ids(out, spark.newSession()).collect()]
    assert Counter(r[0] for r in got) == Counter(r[0] for r in ODD) and got == [tuple(r) for r in op4_rans.read_ids(out).collect()]


def test_pipeline_writes_parquet(spark):
    from sparktriage.llm.common import reread

    assert reread(spark.range(3), "numbers").inputFiles() and reread(spark.range(0), "numbers").count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = words(lower(t))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [root(i) for i in range(len(sets))]


def near_copies():
    random.seed(6)
    base, rows = [f"w{i}" for i in range(200)], []
    for k in range(160):
        w = list(base)
        for _ in range(random.randint(0, 4) if k < 110 else random.randint(5, 10)):
            w[random.randrange(200)] = f"x{random.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    return [*rows, (160, None), (161, ""), (162, "a b"), (163, "A b"), (164, "a"), (165, "q w e r t y u i o p a s"), (166, "q w e r t y u i o p a s d")]


@pytest.mark.parametrize("block", [12 << 20, 25_000])
def test_ngram_join(spark, block):
    rows = near_copies()
    n, c = brute_components([t for _, t in rows])
    got = op5_join.join_components(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block).orderBy("id").collect()
    assert [r["n_shingles"] for r in got] == n and [r["component_id"] for r in got] == [rows[i][0] for i in c]


def linked_components(texts, width, numerator):
    """Smallest index of each text's component; links by all pairs."""
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set() for w in (words(lower(t)) for t in texts)]
    own = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= numerator * len(a | sets[j]) and own[i] != own[j]:
                x, y = sorted((own[i], own[j]))
                own = [x if o == y else o for o in own]
    return own


@pytest.mark.parametrize("block", [12 << 20, 25_000])
def test_ngram_join_five_words(spark, block):
    rows = near_copies()
    for n in (49, 53, 58, 12, 10, 9):  # one changed word in the middle: 5-word similarity of 0.8 or more from 49 words on
        one = [f"s{n}x{i}" for i in range(n)]
        for w in (one, [*one[: n // 2], "changed", *one[n // 2 + 1 :]], one[1:]):
            rows.append((len(rows), " ".join(w)))
    want = linked_components([t for _, t in rows], 5, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = op5_join.join_components(df, block_bytes=block, like=op5_join.STAGE).orderBy("id").collect()
    assert [r["component_id"] for r in got] == want and want != linked_components([t for _, t in rows], 3, 90)
    kept = op5_join.stage(spark, df, SF).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in kept] == [i for i, c in enumerate(want) if i == c]


def test_ngram_join_odd(spark, odd, docs):
    got = op5_join.join_components(odd).collect()
    assert len(got) == len(ODD) and {r["component_id"] for r in got if r["id"] in (4, 5)} == {4}
    assert op5_join.join_components(odd.limit(0)).count() == 0
    assert sorted(r["doc_id"] for r in op5_join.stage(spark, odd, SF).where("doc_id is not null").collect()) == [1, 2, 3, 4, 6, 7]
    n, c = brute_components(docs["text"].tolist())
    found = op5_join.query(spark, SF).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in found] == [(a, docs["doc_id"][b]) for a, b in zip(n, c)]


def test_ngram_join_keys_rows(spark):
    w = [f"w{i}" for i in range(100)]
    a, b, c = (" ".join([*w[:k], *(f"z{i}" for i in range(100 - k))]) for k in (100, 94, 88))  # a is linked with b, b with c, a not with c
    x, y, z, single = (" ".join(f"{p}{i}" for i in range(20)) for p in "xyzs")
    rows = [(1, a), (None, b), (2, c), (None, None), (None, ""), (None, " "), (3, x), (3, x), (4, x), (None, x), (5, y), (5, z), (6, z), (None, single), (None, single), (7, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["id"], r["component_id"]) for r in op5_join.join_components(df, like=op5_join.STAGE).where("id is not null").collect()}
    assert {(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5)} <= found
    kept = op5_join.stage(spark, df, SF)
    assert kept.columns == df.columns
    want = [(1, a), (None, None), (None, ""), (None, " "), (3, x), (5, y), (5, z), (None, single), (7, None), (7, None)]
    assert Counter(map(tuple, kept.collect())) == Counter(want)


def test_linked_sets_share_a_part():
    rng = np.random.RandomState(8)
    for _ in range(1500):
        n = int(rng.choice([1, 5, 9, 10, 19, 20, 50, 100, 300]))
        s = np.unique(rng.randint(0, 1 << 62, n).astype(np.uint64))
        t = np.unique(np.concatenate([s[rng.rand(len(s)) > rng.rand() * 0.12], rng.randint(0, 1 << 62, rng.randint(0, n // 10 + 1)).astype(np.uint64)]))
        both = len(np.intersect1d(s, t))
        if len(t) and 100 * both >= 90 * (len(s) + len(t) - both):
            assert len(np.intersect1d(op5_join.part_keys(s), op5_join.part_keys(t)))


def test_components(spark):
    random.seed(9)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(0, i) for i in range(400, 500)]
    parent = {x: x for e in edges for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def brute_stats(text):
    w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)]


def test_quality_rules(spark, odd, docs):
    random.seed(10)
    texts = [r[1] for r in ODD] + docs["text"].tolist() + ["".join(random.choice(["a ", "b ", "c\n", "# ", "é|"]) for _ in range(random.randint(0, 60))) for _ in range(100)]
    got = op6_rules.text_stats([(t or "").encode() for t in texts])
    assert got[:, :5].tolist() == [brute_stats(t) for t in texts]
    rng = np.random.RandomState(1)
    values = {"a": rng.rand(3000), "b": rng.rand(3000), "c": rng.rand(3000)}
    bad = (values["a"] > 0.7) & (values["b"] <= 0.4)
    rules = op6_rules.learn(values, bad, rng.rand(3000) < 0.3)
    hit = np.any([r.covers(values) for r in rules], axis=0)
    assert bad[hit].mean() > 0.95 and hit[bad].mean() > 0.9
    assert op6_rules.learn(values, rng.rand(3000) < 0.05, rng.rand(3000) < 0.3) == []  # nothing to find
    assert op6_rules.stage(spark, odd, SF).columns == odd.columns
    assert op6_rules.score(odd, []).where("kept").count() == 0 and op6_rules.score(odd.limit(0), []).count() == 0


def brute_targets(sizes):
    w = dict(zip(sizes, (5.0, 2.0, 1.0) * len(sizes)))
    total, capped = sum(sizes.values()), {}
    while True:
        free = {s: w[s] for s in sizes if s not in capped}
        rest = total - sum(capped.values())
        share = {s: rest * v / sum(free.values()) for s, v in free.items()}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark, odd):
    sizes = [("a", 500), ("b", 10), ("c", 300), ("d", 4), ("e", 90), ("f", 700)]
    df = spark.createDataFrame(sizes, "source string, source_size long")
    want = brute_targets(dict(sizes))
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in op7_mix.targets(df).collect())
    done = op7_mix.query(spark, SF).toPandas()
    again = op7_mix.query(spark, SF).toPandas()
    assert done.sort_values("doc_id").values.tolist() == again.sort_values("doc_id").values.tolist()
    assert (done["taken"] <= 3 * done["size"]).all() and (done["taken"] % done["size"].clip(lower=1) == 0).all()
    texts = table(spark, SF, "documents").select("doc_id", "source", "text").toPandas()
    assert dict(zip(done["doc_id"], done["size"])) == {i: len(words(t)) for i, t in zip(texts["doc_id"], texts["text"])}
    named = done.merge(texts[["doc_id", "source"]], on="doc_id")
    per = named.groupby("source")["size"].sum()
    want = brute_targets({s: int(per[s]) for s in sorted(per.index)})
    for source, rows in named.groupby("source"):  # what is taken is as near to the target as any choice of documents comes
        own = int(per[source])
        assert (rows["source_size"] == own).all() and np.allclose(rows["target"], want[source])
        whole = int(want[source] // own)
        reach = 1
        for n in rows["size"]:
            reach |= reach << int(n)
        nearest = min(abs(whole * own + x - want[source]) for x in range(own + 1) if reach >> x & 1)
        assert abs(abs(int(rows["taken"].sum()) - want[source]) - nearest) < 1e-3
        assert (rows["taken"] >= whole * rows["size"]).all()
    assert op7_mix.mix(odd.limit(0), "source", op7_mix.word_count(F.col("text")), "doc_id").count() == 0


def test_mix_fit_is_nearest():
    random.seed(11)
    for _ in range(2000):
        s = np.array(sorted(random.sample(range(1, 60), random.randint(1, 8))))
        c = np.array([random.randint(1, 6) for _ in s])
        budget = random.uniform(0, float((s * c).sum()))
        take = op7_mix.fit(s, c, budget)
        reach = {0}
        for size, n in zip(s.tolist(), c.tolist()):
            reach = {x + k * size for x in reach for k in range(n + 1)}
        assert (take >= 0).all() and (take <= c).all()
        assert abs(abs((s * take).sum() - budget) - min(abs(x - budget) for x in reach)) < 1e-6
    sizes, counts = np.arange(1, 3000), np.full(2999, 7)
    assert abs((sizes * op7_mix.fit(sizes, counts, 12_345_678.4)).sum() - 12_345_678.4) < 0.5
    assert op7_mix.fit(np.array([0, 5]), np.array([3, 0]), 4.0).tolist() == [0, 0]


CLASHING = ["key", "size", "source_size", "target", "times", "row", "hash", "id", "n_words", "_n_words", "_lines", "keys", "site", "_row", "_ids", "_decoded", "c0", "node", "class", "grp"]


@pytest.mark.parametrize("stage", [op6_rules.stage, op2_lines.stage, op5_join.stage, op7_mix.stage])
def test_stages_keep_columns_of_any_name(spark, odd, stage):
    """Rows of a stage are whole rows of docs, whatever the columns are called; null, empty and repeated rows among them."""
    own = ["doc_id", "text", "source", "n_chars"]
    named = odd.select(*own, *[F.concat_ws("|", F.lit(c), "doc_id").alias(c) for c in CLASHING])
    got, plain = stage(spark, named, SF), stage(spark, odd.select(*own), SF)
    assert got.columns == named.columns and stage(spark, named.limit(0), SF).count() == 0
    rows = got.collect()
    assert Counter(tuple(r[c] for c in own) for r in rows) == Counter(tuple(r) for r in plain.collect())
    assert all(r[c] == (c if r["doc_id"] is None else f"{c}|{r['doc_id']}") for r in rows for c in CLASHING)


def brute_secrets(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    for kind, pattern, least in (("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0), ("slack", r"xox[abprs]-[A-Za-z0-9\-]{10,}", 0), ("jwt", r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", 30), ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    kinds = [r.kind for r in op8_secrets.RULES]
    return sorted(out, key=lambda x: (x[1], kinds.index(x[0])))


def test_secrets(spark, odd, docs):
    random.seed(12)
    parts = ["token", "PassWord", "secret", "api_key", "APIKEY", "passwd", ":", "=", " ", '"', "'", "abcdefgh", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "x", "é", "\n", "ghp_" + "a" * 36, "eyJabcdefgh.abcdefgh.abcdefgh", "-----BEGIN RSA PRIVATE KEY-----", "-", "xoxb-1234567890", "\x00"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 60))) for _ in range(2000)] + docs["text"].tolist() + [LONG + "0123456789abcdef" * 500]
    assert op8_secrets.scan([t.encode() for t in texts]) == [brute_secrets(t) for t in texts]
    assert op8_secrets.scan([]) == [] and op8_secrets.scan([b""]) == [[]]
    assert op8_secrets.find_secrets(odd).count() == len(ODD)
    for r in op8_secrets.query(spark, SF).collect():
        spans = [s for s in brute_secrets(docs["text"][docs["doc_id"] == r["doc_id"]].iloc[0] or "") if s[0] in ("assign", "access", "hex")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert r["n_assign"] == sum(s[0] == "assign" for s in spans)


def test_language_gradients():
    rng = np.random.RandomState(0)
    g = op9_lang.Gru((rng.randn(256, 9) * 0.5).astype(np.float64), rng.randn(3, 9) * 0.5)
    x = rng.randint(97, 100, (5, 4))
    weight = rng.randn(5, 4, 3)
    loss = lambda: float((op9_lang.Gru(g.byte, g.state).run(x)[0] * weight).sum())
    _, notes = g.run(x, True)
    d_byte, d_state = g.gradients(x, weight, notes)
    for array, grad, at in ((g.state, d_state, (1, 4)), (g.state, d_state, (2, 8)), (g.byte, d_byte, (98, 2)), (g.byte, d_byte, (97, 7))):
        old, step = array[at], 1e-3
        array[at] = old + step
        up = loss()
        array[at] = old - step
        down = loss()
        array[at] = old
        assert abs((up - down) / (2 * step) - grad[at]) < 1e-2 * max(1, abs(grad[at]))


def test_language(spark, odd):
    docs = table(spark, SF, "documents")
    got = op9_lang.query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.95 and got["score"].between(0, 1).all()
    texts = [b"the cat sat on the mat again", "über die Straße gehen".encode()] * 40
    model = op9_lang.train(texts, ["en", "de"] * 40, steps=40)
    r = {x["doc_id"]: x for x in op9_lang.predict(odd, model).collect()}
    assert [r[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and r[4]["lang_pred"] in ("en", "de") and r[7]["lang_pred"] in ("en", "de")
    p = model.positions(op9_lang.windows(texts[:2])[0])
    assert p.shape == (2, op9_lang.WINDOW, 2) and np.allclose(p.sum(2), 1, atol=1e-4)
    assert {x["lang_pred"] for x in op9_lang.predict(odd, op9_lang.train([], [])).collect()} == {"und"}


def test_knn(spark):
    rng = np.random.RandomState(13)
    v = (rng.randn(700, 6) * np.repeat([[0.2], [2.0]], 350, 0) + np.repeat(rng.randn(7, 6) * 3, 100, 0)).astype(np.float32)
    v[10:14] = v[9]  # ties
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    rows[20], rows[21], rows[22] = (20, None, 0), (21, [float("nan")] * 6, 0), (22, [None] * 6, 0)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for pivots in (4, 32):
        got = op10_knn.knn(df, lambda i: i % 100 == 0, pivots=pivots).collect()
        ok = [i for i in range(700) if i not in (20, 21, 22)]
        z = {i: [math.floor(1024 * float(x)) for x in v[i]] for i in ok}
        want = {(q, r, c, s) for q in range(0, 700, 100) for r, (s, c) in enumerate(sorted(((sum(a * b for a, b in zip(z[q], z[c])), c) for c in ok if c != q), key=lambda t: (-t[0], t[1]))[:10], 1)}
        assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want
    assert op10_knn.knn(df.limit(0), lambda i: i % 100 == 0).count() == 0 and op10_knn.knn(df, lambda i: i < 0).count() == 0
    nameless = df.unionByName(spark.createDataFrame([(None, [9.0] * 6, 1)] * 2, df.schema))
    assert op10_knn.knn(nameless, lambda i: i % 100 == 0).count() == len(want)
    assert op10_knn.knn(df.where("vec_id in (0, 1, 2)"), lambda i: i % 100 == 0).count() == 2


def test_knn_copies(spark):
    """In separate clusters a candidate goes to few of the groups, and results stay those of brute force."""
    rng = np.random.RandomState(3)
    v = np.repeat(rng.randn(30, 8) * 10, 100, 0) + rng.randn(3000, 8) * 0.1
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    rows = op10_knn.valid_vectors(df, "vec_id", "embedding").withColumn("asks", F.col("id") % 50 == 0)
    asked, given = op10_knn.placed(rows, 10, None)
    groups, copies = asked.select("group").distinct().count(), given.select(F.explode("groups")).count()
    assert groups > 5 and copies < 3000 * groups / 4
    z = np.floor(1024 * v).astype(np.int64)
    want = {(q, c, s) for q in range(0, 3000, 50) for s, c in sorted(((int(z[q] @ z[c]), -c) for c in range(3000) if c != q), reverse=True)[:10]}
    assert {(r["query_id"], -r["vec_id"], r["score"]) for r in op10_knn.knn(df, lambda i: i % 50 == 0).collect()} == want


def feature_values(texts):
    """The features of the rules, from brute-force statistics where there are any."""
    rows = []
    for t in texts:
        w, lines = words(t), [x for x in (t or "").split("\n") if words(x)]
        n_words, word_chars, n_symbols, n_dup, n_repeat = brute_stats(t)
        chars = "".join(w)
        letters = sum(b in range(65, 91) or b in range(97, 123) or 0xC3 <= b <= 0xF4 for b in chars.encode())
        n, c, k = max(n_words, 1), max(word_chars, 1), max(len(lines), 1)
        rows.append((n_words, word_chars / n, n_symbols / n, n_dup / k, n_repeat / n, letters / c, sum("A" <= x <= "Z" for x in chars) / c, sum("0" <= x <= "9" for x in chars) / c, sum(len(x) <= 3 for x in w) / n, len(set(w)) / n, n_words / k))
    return dict(zip(op6_rules.FEATURES, np.array(rows, float).reshape(-1, len(op6_rules.FEATURES)).T))


def test_quality_query(spark, docs):
    """The query's rows by brute force: statistics, the base rule, and the learned list evaluated rule by rule."""
    small = "/root/testdata/sf0.01"
    frame = table(spark, small, "documents").select("doc_id", "text")
    rules = op6_rules.fit(frame, table(spark, small, "labels"))
    assert rules  # the list has something to say at this scale
    rows = frame.toPandas()
    values = feature_values(rows["text"])
    first = np.zeros(len(rows), int)
    for i, r in reversed(list(enumerate(rules, 1))):
        first[r.covers(values)] = i
    want = {}
    for doc, text, rule in zip(rows["doc_id"], rows["text"], first):
        stats = brute_stats(text)
        base = stats[0] < 50 or 100 * stats[4] > 50 * stats[0]
        want[doc] = (*stats, base, not base and rule == 0, int(rule) or None)
    got = {r["doc_id"]: tuple(r)[1:] for r in op6_rules.query(spark, small).collect()}
    assert got == want
    labels = table(spark, small, "labels").toPandas().dropna()
    bad = labels["doc_id"].map(lambda d: want[d][-1] is not None)
    assert (labels["quality"][bad] == 0).mean() > 0.8
    assert op6_rules.fit(frame.limit(0), table(spark, small, "labels")) == op6_rules.fit(frame, table(spark, small, "labels").limit(0)) == []
    assert op6_rules.fit(frame, spark.createDataFrame([(None, 0, 0), (1, None, 0), (1, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")) == []


def test_language_sample_has_rare_languages(spark):
    rows = [(i, f"word{i} " * 20, "rare" if i % 1000 == 7 else "often") for i in range(4000)]
    _, labels = op9_lang.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=40)
    assert Counter(labels) == {"often": 36 * op9_lang.PER_TEXT, "rare": 4 * op9_lang.PER_TEXT}


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert op3_bpe.digests(none).count() == op3_bpe.stage(spark, none, SF).count() == op8_secrets.find_secrets(none).count() == 0
    assert op9_lang.predict(none, op9_lang.train(*op9_lang.sample(none))).count() == 0 and op9_lang.sample(none) == ([], [])
    assert op2_lines.dedup_lines(none, F.split("text", "\n"), F.col("source")).count() == 0
    with pytest.raises(ValueError):
        op3_bpe.encode_documents(odd.withColumn("_ids", F.lit(1)))


def test_pipeline_by_brute_force(spark):
    """Each stage of the pipeline on what the one before kept, against a plain version."""
    import corpus_pipeline

    start = table(spark, SF, "documents")
    docs = start.unionByName(spark.createDataFrame([(None, None, "en", None, 0), (900_001, "", None, "x", 0), (900_002, None, "en", "x", None)], start.schema))
    named = dict(corpus_pipeline.STAGES)
    assert list(named) == [n for n, _ in corpus_pipeline.STAGES] and len(named) == 5
    rows = docs.toPandas()
    rules = op6_rules.fit(docs, table(spark, SF, "labels"))
    values = feature_values(rows["text"])
    bad = np.any([r.covers(values) for r in rules], axis=0) if rules else np.zeros(len(rows), bool)
    base = np.array([s[0] < 50 or 100 * s[4] > 50 * s[0] for s in map(brute_stats, rows["text"])])
    one = named["quality rules"](spark, docs, SF)
    kept = one.toPandas()
    assert sorted(kept["doc_id"]) == sorted(rows["doc_id"][~base & ~bad])

    two = named["line dedup"](spark, one, SF)
    pages, seen = Counter(kept["source"]), Counter((s, x) for s, t in zip(kept["source"], kept["text"]) for x in {x.strip(" ") for x in t.split("\n")} if x)
    hot = {k for k, n in seen.items() if n >= 3 and n > 0.1 * pages[k[0]]}
    want = {d: "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in hot) for d, s, t in zip(kept["doc_id"], kept["source"], kept["text"])}
    lines = two.toPandas()
    assert dict(zip(lines["doc_id"], lines["text"])) == want and (lines["n_chars"] == lines["text"].str.len()).all()

    three = named["n-gram Jaccard join"](spark, two, SF)
    lines = lines.sort_values("doc_id", ignore_index=True)
    root = linked_components(lines["text"].tolist(), 5, 80)
    joined = three.toPandas()
    assert sorted(joined["doc_id"]) == [d for i, d in enumerate(lines["doc_id"]) if root[i] == i]

    four = named["source mixing"](spark, three, SF)
    mixed, size = Counter(four.toPandas()["doc_id"]), {d: len(words(t)) for d, t in zip(joined["doc_id"], joined["text"])}
    per = {s: int(sum(size[d] for d in g["doc_id"])) for s, g in joined.groupby("source")}
    targets = brute_targets({s: per[s] for s in sorted(per)})
    for s, g in joined.groupby("source"):
        whole, reach = int(targets[s] // per[s]), 1
        for d in g["doc_id"]:
            reach |= reach << size[d]
            assert whole <= mixed[d] <= whole + 1
        nearest = min(abs(whole * per[s] + x - targets[s]) for x in range(per[s] + 1) if reach >> x & 1)
        assert abs(abs(sum(mixed[d] * size[d] for d in g["doc_id"]) - targets[s]) - nearest) < 1e-3

    with open(public_tokenizers.path(op3_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = dict(zip(joined["doc_id"], joined["text"]))
    last = named["byte-level BPE"](spark, four, SF).collect()
    assert Counter(r["doc_id"] for r in last) == mixed
    for r in last:
        ids = library.encode_ordinary(text[r["doc_id"]])
        assert bytes(r["token_ids"]) == np.array(ids, "<u4").tobytes() and r["n_tokens"] == len(ids)


def test_pipeline(spark):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert corpus_pipeline.run(spark, SF).where("n_tokens > 0").count() > 50
