"""Operator 4, token ids in files, coded by a static range asymmetric numeral system (rANS).

Documents are tokenized, each closed by an end id, and written in ascending order of their ids. SEGMENT_IDS ids or more, of
whole documents, make a segment: its frequency table, made from all its ids, is shared by its blocks of BLOCK_IDS ids. So
texts are tokenized once, and a task holds the ids of one segment. A block is coded by itself: LANES interleaved states share
one stream of 32-bit words, kept in the order in which a decoder reads them. Every CHECKPOINT rows of ids the decoder's
place in the stream and its states are noted, so that the parts of a block can be decoded at once; each part has a crc32.

The files are Parquet files of segment records, written by Spark, so lost tasks leave no half files: part (the file's number in
order), first (ids in the file before this segment), docs, of which the first n_null are null, lengths (unsigned 32-bit each),
n_ids, freq (the table: unsigned 32-bit each, zlib), blocks (n, stream, checkpoints, checksums). A document's start thus
needs one number per file besides its own segment.

Null text is empty: only the end id. An empty table gives no segment. Documents with equal ids stand next to each other;
null ids come first.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table, text_slices

VOCABULARY, END_ID = "word_bpe_49k.json", 2
SCALE = 20  # frequencies sum to 2**SCALE
LOW = np.uint64(1 << 31)
LANES, CHECKPOINT = 512, 64
BLOCK_IDS = 1 << 17
SEGMENT_IDS = 1 << 21
SLICE_BYTES = 4 << 20
KNOWN_WORDS = 500_000


# --- tokens ---


#: The settings under which words of letters are single pieces, letters are lower-cased and a piece's last id ends in _END_MARK.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_END_MARK = "</w>"
#: Lower-case Latin letters that neither composition nor lower-casing changes; those beyond ASCII (ß to ö, ø to ÿ) have the lead byte C3.
_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_LETTER, _TAIL, _SIGN, _BLANK = (
    np.isin(np.arange(256), list(x))
    for x in (b"abcdefghijklmnopqrstuvwxyz", [*range(0x9F, 0xB7), *range(0xB8, 0xC0)], bytes(x for x in range(33, 127) if not chr(x).isalnum()), b" \t\n\x0b\f\r")
)


class WordTokenizer:
    """Ids of texts by a tokenizers file whose pieces never cross white space; each different word is encoded once.

    The library's pieces of a text are those of its words when it drops white space and treats words one by one; then words
    are looked up, and only new ones go through the library. Results are those of encoding the whole text.

    If the file's settings are those above (known), letters are lower-cased first, a sign between a Latin letter and white space is
    a word of its own, and new words of Latin letters skip the normalizer: their pieces are told apart by the ids that end a piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode("|", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None  # ids of a word that is only this sign, between the words of a call
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        steps = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.known = (
            steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _SPLIT}
            and told["model"].get("end_of_word_suffix") == _END_MARK and not any(x["content"].isalpha() for x in told["added_tokens"])
        )
        if self.known:
            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer = normalizers.Sequence([])
            self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(_END_MARK)]] = True

    def _pieces(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of _LATIN letters, each of which is one piece."""
        out = []
        for i in range(0, len(words), 1000):
            text = b" ".join(words[i : i + 1000]).decode("latin-1")  # as the library writes bytes: each as the character of its number, but for three
            text = text.replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143")
            ids = np.array(self.letters.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u2")
            cut, raw = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *cut[:-1]], cut, strict=True)]
        return out

    def _library(self, words: list[bytes]) -> list[bytes]:
        if self.mark is None:
            return [np.array(e.ids, "<u2").tobytes() for e in self.tokenizer.encode_batch([w.decode() for w in words], add_special_tokens=False)]
        out = []
        for i in range(0, len(words), 256):
            some = words[i : i + 256]
            ids = np.array(self.tokenizer.encode_batch_fast([b" | ".join(some).decode()], add_special_tokens=False)[0].ids, "<u2")  # the fast call keeps no offsets
            cut = np.flatnonzero(ids == self.mark)
            starts, ends, raw = [0, *(2 * cut + 2).tolist()], [*(2 * cut).tolist(), 2 * len(ids)], ids.tobytes()
            out += [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        return out

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A table that knows the ids of all words. Words seen lately are kept: when a generation is full, the one before it goes."""
        if len(self.young) >= KNOWN_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = words.difference(young)
        if old:
            young.update((w, old[w]) for w in new.intersection(old))
            new = new.difference(old)
        simple, plain, odd = [], [], []
        for w in new:
            if self.known and _LATIN.fullmatch(w):
                simple.append(w)
            else:
                (odd if b"|" in w or len(w) > 1000 else plain).append(w)
        young.update(zip(simple, self._pieces(simple)))
        young.update(zip(plain, self._library(plain)))
        for w in odd:
            young[w] = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, "<u2").tobytes()
        return young

    def joined(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all texts, with a line end between them and made alike where that changes no id, and where each text starts; at the end one more."""
        starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
        if not self.known:
            return np.frombuffer(b"\n".join(texts), np.uint8), starts
        # Lower-casing comes after composition in the library: before letters with combining marks (lead bytes CC, CD) it is left to it.
        raw = np.frombuffer(b"\n".join([t if b"\xcc" in t or b"\xcd" in t else t.lower() for t in texts]), np.uint8)
        at = np.flatnonzero(_SIGN[raw[1:-1]]) + 1
        at = at[(_LETTER[raw[at - 1]] | _TAIL[raw[at - 1]] & (raw[at - 2] == 0xC3)) & _BLANK[raw[at + 1]]]
        return np.insert(raw, at, 32), starts + np.searchsorted(at, starts)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Words are numbered by Arrow, so that only different ones become Python objects."""
        raw, text_start = self.joined(texts)
        gap = np.ones(len(raw) + 2, bool)
        gap[1:-1] = _BLANK[raw]
        turn = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = turn[::2], turn[1::2]
        places, letters = np.cumsum(np.append(0, ends - starts)), raw[~gap[1:-1]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(letters)]).dictionary_encode()
        different = words.dictionary.to_pylist()
        pieces = list(map(self.learn(set(different)).__getitem__, different))
        ids = np.frombuffer(b"".join(pieces), "<u2").astype(np.uint32)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 2
        code = words.indices.to_numpy()
        n = sizes[code]
        stop = np.cumsum(np.append(0, n))
        out = ids[np.repeat((np.cumsum(sizes) - sizes)[code] - stop[:-1], n) + np.arange(stop[-1])]
        cut = stop[np.searchsorted(starts, text_start)].tolist()
        return [out[i:j] for i, j in zip(cut, cut[1:])]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


# --- coding ---


@dataclass
class Table:
    """freq and start of each id, id of each slot."""

    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray) -> Table:
        """Counts scaled to 2**SCALE; ids that occur keep one slot at least."""
        size, total = 1 << SCALE, int(counts.sum())
        seen = counts > 0
        freq = np.zeros(len(counts), np.int64)
        if total:
            freq[seen] = np.maximum(1, (counts[seen].astype(float) * size / total).astype(np.int64))
            while (over := int(freq.sum()) - size) > 0:  # single slots for rare ids are taken from the frequent ones
                order = np.argsort(-freq)[: max(1, int((freq > 1).sum()))]
                take = np.minimum(freq[order] - 1, np.maximum(1, freq[order] * over // max(1, int(freq[order].sum()))))
                take = np.where(np.cumsum(take) - take < over, np.minimum(take, over - (np.cumsum(take) - take)), 0)
                freq[order] -= take
            freq[int(np.argmax(freq))] += size - int(freq.sum())
        return cls.of(freq)

    @classmethod
    def of(cls, freq: np.ndarray) -> Table:
        return cls(freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64), np.repeat(np.arange(len(freq)), freq).astype(np.uint32))


def encode_block(ids: np.ndarray, t: Table) -> tuple[bytes, bytes, bytes]:
    """(stream, checkpoints, checksums) of a block's ids."""
    n = len(ids)
    rows = -(-n // LANES)
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    places: list[tuple[int, np.ndarray]] = []
    written = 0
    limit_shift = np.uint64(31 + 32 - SCALE)
    for r in range(rows - 1, -1, -1):  # the decoder reads from the first row on, so the encoder ends there
        s = ids[r * LANES : (r + 1) * LANES]
        x, f = state[: len(s)], t.freq[s]
        full = np.flatnonzero(x >= f << limit_shift)
        if len(full):
            words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            written += len(full)
            x[full] >>= np.uint64(32)
        state[: len(s)] = ((x // f) << np.uint64(SCALE)) + x % f + t.start[s]
        if r % CHECKPOINT == 0:
            places.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    places.reverse()
    marks = b"".join(np.uint64(written - at).tobytes() + x.astype("<u8").tobytes() for at, x in places)
    sums = b"".join(np.uint32(zlib.crc32(ids[i : i + CHECKPOINT * LANES].astype("<u4").tobytes())).tobytes() for i in range(0, n, CHECKPOINT * LANES))
    return stream.tobytes(), marks, sums


def decode_part(stream: bytes, marks: bytes, sums: bytes, n: int, part: int, t: Table) -> np.ndarray:
    """The ids from checkpoint number part up to the next one; needs nothing before it."""
    width = 8 + 8 * LANES
    mark = marks[part * width : (part + 1) * width]
    at = int(np.frombuffer(mark, "<u8", 1)[0])
    state = np.frombuffer(mark, "<u8", LANES, 8).astype(np.uint64)
    words = np.frombuffer(stream, "<u4")
    first = part * CHECKPOINT * LANES
    out = np.empty(min(n - first, CHECKPOINT * LANES), np.uint32)
    mask = np.uint64((1 << SCALE) - 1)
    for i in range(0, len(out), LANES):
        x = state[: len(out) - i]
        slot = x & mask
        s = t.symbol[slot]
        x = t.freq[s] * (x >> np.uint64(SCALE)) + slot - t.start[s]
        empty = np.flatnonzero(x < LOW)
        if len(empty):
            x[empty] = (x[empty] << np.uint64(32)) | words[at : at + len(empty)]
            at += len(empty)
        state[: len(x)] = x
        out[i : i + LANES] = s
    if zlib.crc32(out.astype("<u4").tobytes()) != int(np.frombuffer(sums, "<u4")[part]):
        raise ValueError(f"checksum of part {part} is wrong")
    return out


def decode_block(stream: bytes, marks: bytes, sums: bytes, n: int, t: Table) -> np.ndarray:
    parts = -(-n // (CHECKPOINT * LANES))
    return np.concatenate([decode_part(stream, marks, sums, n, p, t) for p in range(parts)]) if parts else np.empty(0, np.uint32)


# --- jobs ---


SEGMENTS = "part int, first long, n_null int, docs binary, lengths binary, n_ids long, freq binary, blocks array<struct<n:int,stream:binary,checkpoints:binary,checksums:binary>>"
_BLOCKS = pa.list_(pa.struct([("n", pa.int32()), ("stream", pa.binary()), ("checkpoints", pa.binary()), ("checksums", pa.binary())]))


def _write_segments(path: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part = tokenizer(path), TaskContext.get().partitionId()
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), _BLOCKS]
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        total = first = 0

        def segment() -> pa.RecordBatch:
            flat = np.concatenate(held)
            t = Table.fit(np.bincount(flat, minlength=vocabulary))
            blocks = []
            for i in range(0, total, BLOCK_IDS):
                ids = flat[i : i + BLOCK_IDS]
                blocks.append(dict(zip(("n", "stream", "checkpoints", "checksums"), (len(ids), *encode_block(ids, t)))))
            nulls = docs.count(None)  # they come first
            order = np.array([d or 0 for d in docs], "<i8").tobytes()
            values = [part, first, nulls, order, np.array([len(x) for x in held], "<u4").tobytes(), total, zlib.compress(t.freq.astype("<u4").tobytes(), 1), blocks]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for i, j, texts in text_slices(batch, 1, SLICE_BYTES):
                for doc, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), own.encode(texts)):
                    docs.append(doc)
                    held.append(np.append(ids, np.uint32(END_ID)))
                    total += len(held[-1])
                    if total >= SEGMENT_IDS:
                        yield segment()
                        docs, held, total, first = [], [], 0, first + total
        if docs:
            yield segment()

    return run


#: A segment is a row of megabytes; Parquet would look at the size of what it holds only every hundred rows.
_FILES = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def write_ids(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", out: str | None = None) -> str:
    """Writes the ids of docs as Parquet files of segments to out, else to a new path in the shared folder; returns that path. path: the vocabulary."""
    out = out or new_path(docs.sparkSession, "rans-ids")
    path = path or public_tokenizers.path(VOCABULARY)
    vocabulary = tokenizer(path).tokenizer.get_vocab_size()
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    ordered = slim.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(_write_segments(path, vocabulary), SEGMENTS).write.options(**_FILES).parquet(out)
    return out


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            t = Table.of(np.frombuffer(zlib.decompress(row["freq"]), "<u4").astype(np.int64))
            ids = np.concatenate([decode_block(b["stream"], b["checkpoints"], b["checksums"], b["n"], t) for b in row["blocks"]])
            n = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
            ends = np.cumsum(n)
            docs = np.frombuffer(row["docs"], "<i8")
            raw = ids.astype("<u4").tobytes()
            pieces = [raw[4 * (e - m) : 4 * e] for e, m in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(docs, mask=np.arange(len(docs)) < row["n_null"]), pa.array(row["start"] + ends - n), pa.array(n), pa.array(pieces, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read_ids(path: str, spark: SparkSession | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary little-endian unsigned 32-bit) of the documents in the files of segments at path."""
    segments = (spark or SparkSession.active()).read.schema(SEGMENTS).parquet(path)
    per_part = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = per_part.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))  # one row per file, that is per writing task
    joined = segments.join(F.broadcast(starts), "part").select((F.col("part_start") + F.col("first")).alias("start"), "n_null", "docs", "lengths", "freq", "blocks")
    return joined.mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_ids(table(spark, sf_dir, "documents"))
    return read_ids(path, spark).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
