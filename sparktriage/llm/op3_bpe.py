"""Operator 3, byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of a piece form a linked list; the lists of many short pieces lie side by side and share one queue. Adjacent pairs
that join to a known token wait in buckets, one per rank, that hold the positions of their left ends. A bitmap in two levels of 256-bit words marks the buckets that hold something, so the next
rank is two find-first-set steps away, and its bucket is merged from left to right. Entries whose pair has changed since are
stale and skipped; if a merge brings up a lower rank, the rest of the bucket waits again. A piece of n bytes thus costs
O(n log n) whatever its length.

Null text counts as empty: no token. Empty tables give empty results; extra columns stay in encode_documents().
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_slices

RANKS = "byte_bpe_multi_50k.tiktoken"
#: The encoder forgets its known pieces when it holds so many; results do not depend on it.
KNOWN_PIECES = 300_000
#: The same where a worker does nothing else (about 250 MB).
KNOWN_ALONE = 700_000
#: Pieces longer than this are not kept.
LONG_PIECE = 64
#: Bytes of new pieces that share a queue, and of texts that are encoded together; a single longer one goes alone.
QUEUE_BYTES, TEXT_BYTES = 1 << 18, 1 << 21
_BITS = [1 << i for i in range(256)]
_BLANK_AND_SPACE = re.compile(r" \s")


class Encoder:
    """Encodes and decodes by a rank file in tiktoken's format."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.cut = pattern == public_tokenizers.PATTERN
        self.low = [0] * ((max(self.ranks.values()) >> 8) + 1)  # the lower level of the bitmap, all zero between calls
        self.of_byte = np.array([self.ranks.get(bytes([a]), -1) for a in range(256)], np.int64)
        self.of_pair = np.array([self.ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], np.int64)
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}  # ids of a blank and the word

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        return np.frombuffer(self.merge_all([piece])[0], "<u4").tolist()

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, packed. Pieces share a queue, up to QUEUE_BYTES of them at a time; a longer piece has one for itself."""
        whole = [self.ranks.get(p) for p in pieces]
        out = [b"" if rank is None else struct.pack("<I", rank) for rank in whole]
        open_ = [i for i, (rank, p) in enumerate(zip(whole, pieces)) if rank is None and p]
        for i, j in slices([len(pieces[k]) for k in open_], QUEUE_BYTES):
            for k, ids in zip(open_[i:j], self._merge_queue([pieces[k] for k in open_[i:j]])):
                out[k] = ids
        return out

    def _merge_queue(self, pieces: list[bytes]) -> list[bytes]:
        known, low, bits = self.ranks.get, self.low, _BITS
        joined = b"".join(pieces)
        raw, n = np.frombuffer(joined, np.uint8), len(joined)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        starts = np.concatenate([[0], ends[:-1]])
        links = np.arange(1, n + 1)
        links[ends - 1] = n  # no link crosses from one piece to the next
        after = links.tolist()
        links = np.arange(-1, n - 1)
        links[starts] = -1
        before = links.tolist()
        parts = [joined[i : i + 1] for i in range(n)]
        ids = self.of_byte[raw].tolist()  # of what starts at a position; -1 once it has been joined to its left
        pairs = np.full(n, -1, np.int64)  # the rank of the pair at a position now, -1 for none
        pairs[:-1] = self.of_pair[raw[:-1].astype(np.int64) << 8 | raw[1:]]
        pairs[ends - 1] = -1
        waiting = pairs.tolist()
        by_rank = np.argsort(pairs, kind="stable")[np.count_nonzero(pairs < 0) :]
        ranks, firsts = np.unique(pairs[by_rank], return_index=True)
        buckets: dict[int, list[int]] = {rank: held.tolist() for rank, held in zip(ranks.tolist(), np.split(by_rank, firsts[1:]))}
        top = 0
        for rank in buckets:
            low[rank >> 8] |= bits[rank & 255]
            top |= bits[rank >> 8]
        while top:
            first = top & -top  # find-first-set, then the same one level below
            word = first.bit_length() - 1
            held = low[word]
            bit = held & -held
            now = (word << 8) + bit.bit_length() - 1
            low[word] = held ^ bit
            if held == bit:
                top ^= first
            bucket = buckets.pop(now)
            if len(bucket) > 1:
                bucket.sort()
            for at, i in enumerate(bucket):
                if waiting[i] != now:
                    continue  # stale
                j = after[i]
                joined = parts[i] + parts[j]
                parts[i] = joined
                ids[i], ids[j] = now, -1
                waiting[j] = -1
                k = after[i] = after[j]
                h = before[i]
                least = now
                if k < n:
                    before[k] = i
                    rank = waiting[i] = known(joined + parts[k], -1)
                    if rank >= 0:
                        if rank in buckets:
                            buckets[rank].append(i)
                        else:
                            buckets[rank] = [i]
                            low[rank >> 8] |= bits[rank & 255]
                            top |= bits[rank >> 8]
                        if rank < least:
                            least = rank
                else:
                    waiting[i] = -1
                if h >= 0:
                    rank = waiting[h] = known(parts[h] + joined, -1)
                    if rank >= 0:
                        if rank in buckets:
                            buckets[rank].append(h)
                        else:
                            buckets[rank] = [h]
                            low[rank >> 8] |= bits[rank & 255]
                            top |= bits[rank >> 8]
                        if rank < least:
                            least = rank
                if least < now and at + 1 < len(bucket):  # a better rank has come up: what is left of this bucket waits
                    buckets[now] = bucket[at + 1 :] + buckets.get(now, [])
                    low[word] |= bit
                    top |= first
                    break
        done = np.array(ids, np.int64)
        live = done >= 0
        packed = done[live].astype("<u4").tobytes()
        cuts = (4 * np.concatenate([[0], np.cumsum(live)[ends - 1]])).tolist()
        return [packed[a:b] for a, b in zip(cuts, cuts[1:])]

    def _learn_pieces(self, pieces: Iterable[str]) -> None:
        new = list({p for p in pieces if p not in self.pieces})
        self.pieces.update(zip(new, self.merge_all([p.encode() for p in new])))

    def encode_all(self, texts: list[str], most: int = KNOWN_PIECES) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; what is new in them is merged together.

        A match of the pattern always begins at a blank that stands before something else than white space, so texts are cut
        at their blanks and stretches that were seen before are looked up; other texts go through the pattern as a whole.
        """
        heads: list[list[str]] = []
        words: list[list[str]] = []
        for text in texts:
            if not self.cut or text.endswith(" ") or _BLANK_AND_SPACE.search(text):
                head, rest = text, []
            else:
                head, *rest = text.split(" ")
            heads.append(self.find(head))
            words.append(rest)
        new = list({w for rest in words for w in rest if w not in self.words})
        cuts = [self.find(" " + w) for w in new]
        self._learn_pieces(chain(chain.from_iterable(heads), chain.from_iterable(cuts)))
        piece = self.pieces.__getitem__
        self.words.update((w, b"".join(map(piece, cut))) for w, cut in zip(new, cuts))
        word = self.words.__getitem__
        out = [b"".join(map(piece, head)) + b"".join(map(word, rest)) for head, rest in zip(heads, words)]
        for known in (self.pieces, self.words):
            if len(known) > most:
                known.clear()
        for known, met in ((self.pieces, chain(chain.from_iterable(heads), chain.from_iterable(cuts))), (self.words, new)):
            for key in met:
                if len(key) > LONG_PIECE:
                    known.pop(key, None)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of one text."""
        return self.encode_all([text])[0]

    def forget(self) -> None:
        """Gives up the known pieces: a worker that turns to other work needs the room."""
        self.pieces.clear()
        self.words.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """One encoder per worker process and file; workers that are used again keep it."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """All rows and columns of docs with _ids (binary, little-endian unsigned 32-bit) and _decoded (binary); docs must not have these two."""
    if taken := {"_ids", "_decoded"}.intersection(docs.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")
    path = path or public_tokenizers.path(RANKS)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        try:
            for batch in batches:
                for start, end, texts in text_slices(batch, place, TEXT_BYTES):  # the output of a few rows at a time bounds what a worker holds
                    part = batch.slice(start, end - start)
                    ids = own.encode_all([t.decode() for t in texts])
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())], [*part.schema.names, "_ids", "_decoded"])
        finally:
            own.forget()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, _ids binary, _decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); the digests are made beside the ids, which then need not leave the worker."""
    path = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            n, a, b = [], [], []
            for _, _, texts in text_slices(batch, 1, TEXT_BYTES):
                for ids in own.encode_all([t.decode() for t in texts], KNOWN_ALONE):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, the token ids (binary) and their number; decoding must give the text back, or the job fails."""
    done = encode_documents(docs.select("doc_id", "source", "text"))
    same = F.assert_true(F.col("_decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.lit("decoding differs from the text"))
    checked = done.where(same.isNull())
    return checked.select("doc_id", "source", (F.length("_ids") / 4).cast("long").alias("n_tokens"), F.sha2("_ids", 256).alias("ids_sha256"), F.col("_ids").alias("token_ids"))
