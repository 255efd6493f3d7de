"""What operators hand over at once."""

import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from sparktriage.llm import op1_brown, op4_rans


def test_brown_batches_are_bounded(monkeypatch):
    """No batch is as long as the vocabulary of a block; together they are the counts and texts of plain loops."""
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 3))
    texts = [" ".join(f"v{i % 40_000}" for i in range(k, 90_000)) for k in (0, 5_000, 20_000)] + [None, "v1 V1"]
    trains = [True, False, True, True, False]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, None, 5]), pa.array(texts), pa.array(trains)], ["doc_id", "text", "trains"])
    tokens = [op1_brown._tokens([(t or "").encode()])[0].view(np.int64).tolist() for t in texts]
    for block_bytes in (1 << 30, 700_000):
        got = list(op1_brown._code(block_bytes)(iter([batch])))
        assert max(b.num_rows for b in got) <= 1 << 14
        rows = pa.Table.from_batches(got).to_pylist()
        words = [r for r in rows if r["h"] is not None]
        for column, chosen in (("n_all", tokens), ("n", [t for t, own in zip(tokens, trains) if own])):
            count = Counter()
            for r in words:
                count[r["h"]] += r[column]
            assert +count == Counter(h for t in chosen for h in t)
        seen = {}
        for r in (r for r in rows if r["h"] is None):
            own = [w["h"] for w in words if w["block"] == r["block"]]  # in the order of their numbers
            code = np.frombuffer(zlib.decompress(r["codes"]), "<u4")
            for doc, held, m, end in zip(r["docs"], r["held"], r["lengths"], np.cumsum(r["lengths"])):
                seen[doc] = ([own[c] for c in code[end - m : end]], held)
        assert seen == {d: (t, not own) for d, t, own in zip([1, 2, 3, None, 5], tokens, trains)}

    top = np.unique(op1_brown._tokens([b"v1"])[0])
    near = list(op1_brown._neighbours(top, np.zeros(len(top), np.int64))(iter([batch.select(["text"])])))
    assert max(b.num_rows for b in near) <= 1 << 14
    count = Counter()
    for r in pa.Table.from_batches(near).to_pylist():
        count[r["h"]] += len(r["seen"])
    assert count == Counter({h: 2 * n for h, n in Counter(h for t in tokens for h in t).items() if np.int64(h).view(np.uint64) not in top})


def test_words_become_objects_once_a_call(monkeypatch):
    """Only different words are looked up one by one; ids are the library's, with empty texts, blanks and texts that share words."""
    path = public_tokenizers.path(op4_rans.VOCABULARY)
    looked_up = []

    class Counted(dict):
        def __getitem__(self, word):
            looked_up.append(word)
            return dict.__getitem__(self, word)

    own, library = op4_rans.WordTokenizer(path), Tokenizer.from_file(path)
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda words: Counted(learn(words)))
    texts = ["", "The end of the end. ", " \t\r\n", "the End of\x0bthe\x0cend", "", "b\u00dfa, \u00dfa! \u00e9. e\u0301. \u03a3\u0391\u03a3", "the " * 5_000, "x"]
    for some in (texts, texts[:1], [], texts[::-1]):
        assert [x.tolist() for x in own.encode([t.encode() for t in some])] == [library.encode(t, add_special_tokens=False).ids for t in some]
    assert len(looked_up) < 60
    own.known, looked_up[:] = False, []
    assert [x.tolist() for x in own.encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(looked_up) < 30
