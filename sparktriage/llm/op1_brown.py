"""Operator 1, LM scoring with Brown class-based n-grams.

A word is its 64-bit hash; the end of a text is a word too. Word counts come from all training texts. Exchange clustering
assigns every word of the training texts to one of CLASSES classes. The most frequent words are exchanged one by one, until no
word moves or PASSES have gone by. Then every other word is put where the same gain is largest: its left and right neighbours
are counted by class, and it enters the class that most raises the likelihood of the class bigrams. P(word | previous) =
P(class | previous class) * count(word) / count(class), where class transitions, counted over all training texts, are smoothed
with class frequencies. In each class the mass of its words that were seen once, at most half, is that of words never seen (Good
and Turing); such a word's own class, as a previous one, is one more, counted on the words that were seen once.

Null text is an empty text: its one token is its end. Without training texts every word is unknown. Repeated rows count as
texts of their own; null ids train. Extra columns are not looked at.

How it is spread: the texts are read twice where they lie, and never shuffled. The first pass turns blocks of them into rows of
(block, word, count) and coded texts, in which a token is a number within its block; the second counts neighbours' classes per
word. Totals are added up per word and go back to the blocks that have it, so that no task ever needs the whole vocabulary.
The driver sees the counts of EXCHANGED words, their bigram counts and the class transitions: all bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import split_words
from .common import checkpoint, fold, reread, table, text_slices

#: Words that are exchanged one by one, classes, passes over these words at most, and the weight of class frequencies in smoothing.
EXCHANGED, CLASSES, PASSES, PRIOR = 1000, 32, 20, 5.0
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 19
#: Rows that go to Spark at once: buffers of a whole block stay with an executor long after, as its allocator keeps room of that size.
BATCH_ROWS = 1 << 14
END = np.uint64(0x656E64)
#: Numbers beside the classes: in transitions a word that was never seen and the start of a text; in neighbours any word that was not exchanged, and the start.
UNSEEN = OTHER = CLASSES
START = CLASSES + 1
WIDTH = CLASSES + 2


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts in order, each text's closed by END, and the number of tokens of each text."""
    w = split_words(texts, lower=True)
    return np.insert(w.hashes(), w.first[1:], END), np.diff(w.first) + 1


def _code(block_bytes: int):
    """Blocks of texts (doc_id, text, trains): a row (block, h, n_all, n, often) per distinct token, and rows (block, docs ...) of coded texts.

    n counts training texts only; often marks the 4 * EXCHANGED most frequent tokens of the block.

    Tokens are numbered within the block by falling n_all, then h; a text is the numbers of its tokens, as unsigned 32-bit
    integers, compressed. Blocks are numbered by task, so a task that is run again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size = TaskContext.get().partitionId() << 32, [], 0

        def tables() -> Iterator[pa.RecordBatch]:
            parts, counts, trained, codes, lengths, docs, trains = zip(*held)
            held.clear()
            values, place = np.unique(np.concatenate(parts), return_inverse=True)
            n_all, n = (np.bincount(place, np.concatenate(x), len(values)).astype(np.int64) for x in (counts, trained))
            order = np.lexsort((values.view(np.int64), -n_all))
            rank = np.empty(len(values), np.uint32)
            rank[order] = np.arange(len(values))
            values, n_all, n, place = values[order].view(np.int64), n_all[order], n[order], rank[place]
            del order, rank
            for i in range(0, len(values), BATCH_ROWS):
                h = values[i : i + BATCH_ROWS]
                yield _rows({"block": np.full(len(h), block), "h": h, "n_all": n_all[i : i + BATCH_ROWS], "n": n[i : i + BATCH_ROWS], "often": np.arange(i, i + len(h)) < 4 * EXCHANGED})
            at = 0
            for first, (part, code, m, d, t) in enumerate(zip(parts, codes, lengths, docs, trains)):  # a slice's texts are a row
                raw = zlib.compress(place[at : at + len(part)][code].astype("<u4").tobytes(), 1)
                yield _rows({"block": [block], "ord": [first], "docs": [d], "held": [(~t).tolist()], "lengths": [m.tolist()], "codes": [raw]})
                at += len(part)

        for batch in batches:
            for i, j, texts in text_slices(batch, 1, SLICE_BYTES):
                h, n = _tokens(texts)
                docs, trains = batch.column(0).slice(i, j - i).to_pylist(), batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)  # copies: a view would hold the batch's texts
                part, code = np.unique(h, return_inverse=True)  # slices first: a block's tokens are never sorted at once
                held.append((part, np.bincount(code, minlength=len(part)), np.bincount(code, np.repeat(trains, n), len(part)), code.astype(np.uint32), n, docs, trains))
                size += sum(map(len, texts))
                if size >= block_bytes:
                    yield from tables()
                    block, size = block + 1, 0
        if held:
            yield from tables()

    return run


_CODED = {"block": pa.int64(), "h": pa.int64(), "n_all": pa.int64(), "n": pa.int64(), "often": pa.bool_(), "ord": pa.int32(), "docs": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "lengths": pa.list_(pa.int64()), "codes": pa.binary()}


def _rows(columns: dict) -> pa.RecordBatch:
    n = len(columns["block"])
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in _CODED.items()], list(_CODED))


def _frequent_bigrams(top: np.ndarray):
    """Counts of (left, right) among the frequent words; all other words are one further word, the start of a text another."""
    width = len(top) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * width, np.int64)
        for batch in batches:
            for _, _, texts in text_slices(batch, 0, SLICE_BYTES):
                h, n = _tokens(texts)
                at = np.minimum(np.searchsorted(top, h), len(top) - 1)
                word = np.where(top[at] == h, at, len(top))
                before = np.concatenate([[len(top) + 1], word[:-1]])
                before[np.concatenate([[0], np.cumsum(n)[:-1]])] = len(top) + 1
                pair, count = np.unique(before * width + word, return_counts=True)
                total[pair] += count
        pair = np.flatnonzero(total)
        for i in range(0, len(pair), BATCH_ROWS):
            some = pair[i : i + BATCH_ROWS]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["pair", "n"])

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _gain(grid: np.ndarray, left: np.ndarray, right: np.ndarray, self_loop: np.ndarray, classes: int) -> np.ndarray:
    """(word, class): how much the likelihood of the class bigrams grows if a word with these neighbours by class enters the class.

    grid: bigrams by class without the words. left, right: (word, class) counts of the words before and after it that are not itself.
    """
    n, at = len(left), np.arange(classes)
    log_grid, out = _xlogx(grid), np.zeros((n, classes))
    for c in range(classes):
        row = _xlogx(grid[c] + right).sum(1) - log_grid[c].sum()
        column = _xlogx(grid[:, c] + left).sum(1) - log_grid[:, c].sum()
        out[:, c] = row + column
    once, own_left, own_right = grid[at, at], left[:, :classes], right[:, :classes]
    out += _xlogx(once) - _xlogx(once + own_right) - _xlogx(once + own_left)  # the pair of the class with itself is in both sums
    out += _xlogx(once + own_right + own_left + self_loop[:, None])
    row_sum, column_sum = grid.sum(1)[:classes] + own_left, grid.sum(0)[:classes] + own_right  # its neighbours' sums don't depend on its class
    after, before = (right.sum(1) + self_loop)[:, None], (left.sum(1) + self_loop)[:, None]
    return out - (_xlogx(row_sum + after) - _xlogx(row_sum) + _xlogx(column_sum + before) - _xlogx(column_sum))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """A class for each word of a square matrix of bigram counts whose last two words keep classes of their own, and the bigrams by class.

    Words start in turn, by frequency. A word leaves its class and enters the one that gives the highest likelihood of the
    class bigrams, in order of frequency; passes end when no word moves.
    """
    n = len(bigrams) - 2
    order = np.argsort(-bigrams[:n].sum(1), kind="stable")
    owner = np.empty(n + 2, np.int64)
    owner[order] = np.arange(n) % classes
    owner[n:] = classes, classes + 1
    size = classes + 2
    grid = np.zeros((size, size))
    np.add.at(grid, (owner[:, None], owner[None, :]), bigrams)
    for _ in range(passes):
        moved = 0
        for w in order:
            own, self_loop = owner[w], float(bigrams[w, w])
            right = np.bincount(owner, bigrams[w], size)
            left = np.bincount(owner, bigrams[:, w], size)
            right[own] -= self_loop
            left[own] -= self_loop
            grid[own] -= right
            grid[:, own] -= left
            grid[own, own] -= self_loop
            rows, cols = grid[:classes], grid[:, :classes].T
            gain = (_xlogx(rows + right) - _xlogx(rows)).sum(1) + (_xlogx(cols + left) - _xlogx(cols)).sum(1)
            at = np.arange(classes)
            once = grid[at, at]
            gain -= _xlogx(once + right[at]) + _xlogx(once + left[at]) - _xlogx(once)
            gain += _xlogx(once + right[at] + left[at] + self_loop)
            row_sum, col_sum = (grid.sum(1) + left)[:classes], (grid.sum(0) + right)[:classes]
            out, into = right.sum() + self_loop, left.sum() + self_loop
            gain -= _xlogx(row_sum + out) - _xlogx(row_sum) + _xlogx(col_sum + into) - _xlogx(col_sum)
            new = int(np.argmax(gain))
            moved += new != own
            owner[w] = new
            grid[new] += right
            grid[:, new] += left
            grid[new, new] += self_loop
        if not moved:
            break
    return owner[:n], grid


def _neighbours(top: np.ndarray, owner: np.ndarray):
    """(h, seen): for each word that was not exchanged, the classes of the words before (even) and after it (odd) in some training texts, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            parts, codes, kinds = zip(*held)
            held.clear()
            h, place = np.unique(np.concatenate(parts), return_inverse=True)
            place = place.astype(np.uint32 if len(h) < 1 << 24 else np.uint64) << 8
            keys, at = [], 0
            for part, code, k in zip(parts, codes, kinds):
                keys.append(place[at : at + len(part)][code] | k)
                at += len(part)
            keys = np.concatenate(keys)
            keys.sort()  # by word; a word's neighbours have no order
            raw = keys.astype(np.uint8).tobytes()
            keys >>= 8
            edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            ends = np.append(edge, len(keys)).astype(np.int32)
            seen = pa.BinaryArray.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
            rows = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), seen], ["h", "seen"])
            for i in range(0, len(edge), BATCH_ROWS):
                yield rows.slice(i, BATCH_ROWS)

        for batch in batches:
            for _, _, texts in text_slices(batch, 0, SLICE_BYTES):
                h, n = _tokens(texts)
                at = np.minimum(np.searchsorted(top, h), len(top) - 1)
                own = top[at] == h
                kind = np.where(own, owner[at], OTHER).astype(np.uint8)
                before = np.concatenate([[START], kind[:-1]]).astype(np.uint8)
                before[np.cumsum(n)[:-1]] = START
                after = np.append(kind[1:], np.uint8(OTHER))
                rare = np.flatnonzero(~own)
                inner = h[rare] != END  # nothing comes after an end
                part, code = np.unique(h[rare], return_inverse=True)
                code = code.astype(np.uint32)
                held.append((part, np.concatenate([code, code[inner]]), np.concatenate([2 * before[rare], 2 * after[rare[inner]] + 1]).astype(np.uint8)))
                size += sum(map(len, texts))
                if size >= BLOCK_BYTES:
                    yield from counted()
                    size = 0
        if held:
            yield from counted()

    return run


def _choose(grid: np.ndarray):
    """(h, class, total) of streams of (h, seen) that are sorted by h: the class of most gain, and how often the word occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_h, last = None, np.zeros(2 * WIDTH, np.int64)

        def best(h: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            left, right = counts[:, 0::2].astype(float), counts[:, 1::2].astype(float)
            own = np.concatenate([_gain(grid, left[i : i + 4096], right[i : i + 4096], np.zeros(len(left[i : i + 4096])), CLASSES).argmax(1) for i in range(0, len(h), 4096)])
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(own, pa.int32()), pa.array(left.sum(1).astype(np.int64))], ["h", "class", "total"])

        for batch in batches:
            for i in range(0, batch.num_rows, 8192):
                part = batch.slice(i, 8192)
                h, seen = part.column(0).to_numpy(), part.column(1)
                sizes = pc.binary_length(seen).to_numpy(zero_copy_only=False)
                word, row = np.unique(h, return_inverse=True)
                kinds = np.frombuffer(seen.buffers()[2], np.uint8, int(sizes.sum()), np.frombuffer(seen.buffers()[1], np.int32)[seen.offset])
                counts = np.bincount(np.repeat(row, sizes) * 2 * WIDTH + kinds, minlength=len(word) * 2 * WIDTH).reshape(len(word), 2 * WIDTH)
                if last_h is not None:  # the word that the rows before ended with may go on
                    if word[0] == last_h:
                        counts[0] += last
                    else:
                        word, counts = np.insert(word, 0, last_h), np.insert(counts, 0, last, 0)
                last_h, last = word[-1], counts[-1]
                if len(word) > 1:
                    yield best(word[:-1], counts[:-1])
        if last_h is not None:
            yield best(np.array([last_h]), last[None])

    return run


def _label(top: np.ndarray, owner: np.ndarray, top_count: np.ndarray, class_mass: np.ndarray, unseen: np.ndarray, n_total: int, vocabulary: int):
    """Of a block's coded texts and its words with their totals and classes: token numbers, base score, the emission part of the score and the classes as bytes."""
    fields = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "emission": pa.float64(), "classes": pa.binary()}
    emptiest = np.maximum(class_mass, 1)

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({k: pa.array([], t) for k, t in fields.items()})
        h, n_all = words.column("h").to_numpy(), words.column("n_all").to_numpy()
        order = np.lexsort((h, -n_all))
        h = h[order].view(np.uint64)
        count, kind = (words.column(c).fill_null(v).to_numpy()[order].astype(np.int64) for c, v in (("total", 0), ("class", UNSEEN)))
        if len(top):
            at = np.minimum(np.searchsorted(top, h), len(top) - 1)
            own = top[at] == h
            count, kind = np.where(own, top_count[at], count), np.where(own, owner[at], kind)
        seen = count > 0
        base = np.log10((count + 1) / (n_total + vocabulary + 1))
        emission = np.where(seen, np.log10(np.maximum(count, 1) / emptiest[np.minimum(kind, CLASSES - 1)] * (1 - unseen[np.minimum(kind, CLASSES - 1)])), 0.0)
        kind = np.where(seen, kind, UNSEEN).astype(np.uint8)
        parts: dict[str, list] = {k: [] for k in fields}
        for row in texts.sort_by("ord").to_pylist():
            code = np.frombuffer(zlib.decompress(row["codes"]), "<u4")
            n = np.array(row["lengths"], np.int64)
            doc, ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
            raw = kind[code].tobytes()
            parts["doc_id"] += row["docs"]
            parts["held_out"] += row["held"]
            parts["n_tokens"] += n.tolist()
            parts["n_known"] += np.bincount(doc, seen[code], len(n)).astype(np.int64).tolist()
            parts["base_score"] += np.bincount(doc, base[code], len(n)).tolist()
            parts["emission"] += np.bincount(doc, emission[code], len(n)).tolist()
            parts["classes"] += [raw[e - m : e] for e, m in zip(ends.tolist(), n.tolist())]
        return pa.table({k: pa.array(v, fields[k]) for k, v in parts.items()})

    return run


def _moves(classes: bytes) -> np.ndarray:
    """Numbers of the class pairs of a text, the first from the start."""
    k = np.frombuffer(classes, np.uint8).astype(np.int64)
    return np.concatenate([[START], k[:-1]]) * WIDTH + k


def _count_moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(WIDTH**2, np.int64)
    for batch in batches:
        for c in batch.column(0).to_pylist():
            pair, n = np.unique(_moves(c), return_counts=True)
            total[pair] += n
    pair = np.flatnonzero(total)
    if len(pair):
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(total[pair])], ["pair", "n"])


def _transitions(counts: np.ndarray, unseen: np.ndarray, once: np.ndarray) -> np.ndarray:
    """log10 of the smoothed transition probabilities, by pair number; a step to UNSEEN has the mass that the classes leave to words never seen.

    After a word that was never seen, the next class is as after the words seen once, class by class as often as these (once).
    """
    grid = counts.reshape(WIDTH, WIDTH)[:, :CLASSES].astype(float)
    often = grid.sum(0) + 1
    smooth = (grid + PRIOR * often / often.sum()) / (grid.sum(1, keepdims=True) + PRIOR)
    smooth[UNSEEN] = (once + 1e-9) / (once + 1e-9).sum() @ smooth[:CLASSES]
    steps = np.full((WIDTH, WIDTH), 1e-300)
    steps[:, :CLASSES] = smooth
    steps[:, UNSEEN] = smooth @ unseen
    return np.log10(np.maximum(steps, 1e-300)).ravel()


def _pair_array(rows: DataFrame, size: int) -> np.ndarray:
    got = rows.groupBy("pair").agg(F.sum("n").alias("n")).toPandas()  # at most size rows
    out = np.zeros(size, np.int64)
    out[got["pair"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out


def word_classes(train: DataFrame, words: DataFrame, exchanged: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, DataFrame]:
    """(hashes, classes, counts) of the exchanged words, sorted by hash, and (h, class, total) of all others.

    train: texts, words: (h, n, often). Exchanged are those that are most frequent where they are often; their counts are exact.
    """
    spark = words.sparkSession
    often = words.where("often and n > 0").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(exchanged)
    best = words.join(F.broadcast(often.select("h")), "h").groupBy("h").agg(F.sum("n").alias("total")).toPandas()  # exchanged rows at most
    top = best["h"].to_numpy(np.int64).view(np.uint64)
    sort = np.argsort(top)
    top, top_count = top[sort], best["total"].to_numpy(np.int64)[sort]
    if not len(top):
        return top, np.empty(0, np.int64), top_count, spark.createDataFrame([], "h long, class int, total long")
    width = len(top) + 2
    owner, grid = exchange(_pair_array(train.mapInArrow(_frequent_bigrams(top), "pair long, n long"), width * width).reshape(width, width))
    seen = train.mapInArrow(_neighbours(top, owner), "h long, seen binary").repartition("h").sortWithinPartitions("h")
    return top, owner, top_count, seen.mapInArrow(_choose(grid), "h long, class int, total long")


def brown_scores(docs: DataFrame, trains, doc_id: str = "doc_id", text: str = "text", exchanged: int = EXCHANGED, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row; trains: a condition."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(trains, F.lit(True)).alias("trains"))
    schema = "block long, h long, n_all long, n long, often boolean, ord int, docs array<long>, held array<boolean>, lengths array<long>, codes binary"
    coded = reread(own.mapInArrow(_code(block_bytes), schema), "brown-blocks")
    words, texts = coded.where("h is not null").select("block", "h", "n_all", "n", "often"), coded.where("h is null").select("block", "ord", "docs", "held", "lengths", "codes")
    top, owner, top_count, others = word_classes(own.where("trains").select("text"), words, exchanged)
    known = reread(others, "brown-classes")
    n_total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    vocabulary = len(top) + known.count()
    class_mass, once = np.zeros(CLASSES), np.zeros(CLASSES)
    np.add.at(class_mass, owner, top_count)
    np.add.at(once, owner, top_count == 1)
    for row in known.groupBy("class").agg(F.sum("total").alias("n"), F.count_if(F.col("total") == 1).alias("once")).collect():  # a row per class
        class_mass[row["class"]] += row["n"]
        once[row["class"]] += row["once"]
    unseen = np.minimum(0.5, once / np.maximum(class_mass, 1))
    told = words.select(F.col("block").alias("at"), "h", "n_all").join(known, "h", "left")
    labelled = checkpoint(texts.groupBy("block").cogroup(told.groupBy("at")).applyInArrow(_label(top, owner, top_count, class_mass, unseen, n_total, vocabulary), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"))
    moves = _pair_array(labelled.where("not held_out").select("classes").mapInArrow(_count_moves, "pair long, n long"), WIDTH**2)
    step = _transitions(moves, unseen, once)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = [float(step[_moves(c)].sum()) for c in batch.column("classes").to_pylist()]
            kept = [batch.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(batch.column("emission").to_numpy() + np.array(path))], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = labelled.mapInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumns({"train_tokens": F.lit(int(n_total)).cast("long"), "perplexity": F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return brown_scores(docs, fold("doc_id", 7) != 2)
