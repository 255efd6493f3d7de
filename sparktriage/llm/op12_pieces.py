"""Operator 12, SentencePiece encoding and decoding: a merge-type model read through a table of each prefix's last token.

A merge-type model joins, again and again, the adjacent pair whose joined piece scores best, the leftmost of equals. What it
makes of a text obeys a rule of pairs: tokens are its result if and only if every two neighbours are the result for their own
joined text, since merges on both sides of a boundary come in the same order whether the rest of the text is there or not. So
each prefix has one last token that goes with the last token of the prefix before it. An automaton over all pieces gives the
pieces that end at each character, a test of pairs (remembered) finds the one that fits, and a table keeps it. The ids are then
read from the end of the table backwards. A text of n characters costs n lookups times the longest piece, whatever it holds.

No piece holds a space mark behind another character, so a text falls apart at its blanks, and stretches met before are looked
up; a model with such pieces gets whole texts. Characters without a piece become byte ids.

Null text counts as empty: the end id alone. Empty tables give empty results; rows that repeat are encoded each; extra columns
stay in encode_documents(), which refuses columns named _ids and _decoded. Very long texts go alone through a worker.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: The encoder forgets stretches and pairs when it holds so many; results do not depend on it.
KNOWN_STRETCHES, KNOWN_PAIRS = 500_000, 1_000_000
#: Stretches longer than this are not kept.
LONG_STRETCH = 64
#: Bytes of texts that are encoded together; a single longer one goes alone.
TEXT_BYTES = 1 << 21
_BAD = "�"


class PieceModel:
    """Encodes and decodes by a model of merge type with byte fallback, identity normalisation and a leading space mark."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        if any(map(model.is_unused, range(size))) or not any(map(model.is_byte, range(size))):
            raise ValueError("a model with byte pieces and without unused ones is needed")
        self.size, self.end = size, model.eos_id()
        self.ids = {name: i for i, name in enumerate(names) if not special[i]}
        #: the better a piece scores, the smaller; pieces of one score are equals
        self.cost = {name: -model.get_score(i) for name, i in self.ids.items() if len(name) > 1}
        self.names, self.lengths = names, [len(name) for name in names]
        byte_id = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_ids = [byte_id[b] for b in range(256)]
        self.byte_of = {i: b for b, i in byte_id.items()}
        unknown = model.decode([model.unk_id()]).encode()
        self.surface = [b"" if model.is_control(i) else unknown if model.is_unknown(i) else bytes([self.byte_of[i]]) if i in self.byte_of else name.replace(MARK, " ").encode() for i, name in enumerate(names)]
        self.marked = [not special[i] and name.startswith(MARK) for i, name in enumerate(names)]
        self.silent = np.array([model.is_control(i) for i in range(size)])
        self.digits = [str(i) for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        for name in self.cost:
            self.automaton.add_word(name, self.ids[name])
        self.automaton.make_automaton()
        inside = re.escape("".join(sorted(set("".join(self.cost)))))
        self.by_reach = re.compile(f"[^{inside}]|[{inside}]+").findall  # characters of no joined piece stand alone
        self.by_mark = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", name) for name in self.cost)
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def joined(self, text: str, cut: int = 0) -> list[str] | None:
        """What the merges make of a short text; None if one of them goes across the cut."""
        parts = list(text)
        cost, none = self.cost.get, float("inf")
        costs = [cost(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            if cut and sum(map(len, parts[: i + 1])) == cut:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = cost(parts[i] + parts[i + 1], none)
        return parts

    def _name(self, token: int) -> str:
        return self.names[token] if token < self.size else chr(token - self.size)

    def is_whole(self, token: int) -> bool:
        """Whether the merges make this one token of its own text."""
        if token not in self.whole:
            self.whole[token] = len(self.joined(self._name(token))) == 1
        return self.whole[token]

    def goes_with(self, left: int, right: int) -> bool:
        """Whether the merges make these two tokens of their joined text."""
        key = left << 24 | right
        if key not in self.pairs:
            a = self._name(left)
            parts = self.joined(a + self._name(right), len(a))
            self.pairs[key] = parts is not None and len(parts) == 2
        return self.pairs[key]

    def tokens(self, stretch: str) -> list[int]:
        """The ids of a stretch; size + code point stands for a character without a piece."""
        size, ids = self.size, self.ids.get
        last = [0, *[ids(c, size + ord(c)) for c in stretch]]  # of each prefix; one character, unless a longer piece fits
        lengths, pairs = self.lengths, self.pairs
        for end, token in self.automaton.iter(stretch):
            start = end + 1 - lengths[token]
            if start:
                before = last[start]
                fits = pairs.get(before << 24 | token)
                if fits is None:
                    fits = self.goes_with(before, token)
            else:
                fits = self.is_whole(token)
            if fits:
                last[end + 1] = token
        out, at = [], len(stretch)
        while at:
            token = last[at]
            out.append(token)
            at -= lengths[token] if token < size else 1
        out.reverse()
        return out

    def _packed(self, stretch: str) -> bytes:
        ids = self.tokens(stretch)
        if max(ids) >= self.size:
            ids = [i for token in ids for i in ([token] if token < self.size else [self.byte_ids[b] for b in chr(token - self.size).encode()])]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, stretch: str) -> bytes:
        """A stretch's ids, put together from the parts that no merge can join."""
        parts = self.by_reach(stretch)
        if len(parts) == 1:
            return self._packed(stretch)
        known, out = self.known, []
        for part in parts:
            ids = known.get(part)
            if ids is None:
                ids = self._packed(part)
                if len(part) <= LONG_STRETCH:
                    known[part] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text with the end id, as little-endian unsigned 32-bit integers."""
        out = []
        if text:
            for stretch in self.by_mark(MARK + text.replace(" ", MARK)) if self.apart else [MARK + text.replace(" ", MARK)]:
                ids = self.known.get(stretch)
                if ids is None:
                    ids = self._learn(stretch)
                    if len(stretch) <= LONG_STRETCH:
                        self.known[stretch] = ids
                out.append(ids)
            if len(self.known) > KNOWN_STRETCHES:
                self.known.clear()
            if len(self.pairs) > KNOWN_PAIRS:
                self.pairs.clear()
        out.append(np.array([self.end], "<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; bytes that make no character become U+FFFD each, the first space mark goes."""
        numbers = np.frombuffer(ids, "<u4")
        given = numbers.tolist()
        text = b"".join(map(self.surface.__getitem__, given))
        first = next((i for i in given if self.surface[i]), None)
        try:
            text.decode()
            mend = bool(self.silent[numbers[:-1]].any())  # bytes on both sides of such an id make no character together
        except UnicodeDecodeError:
            mend = True
        if mend:
            text = self._mended(given)
        return text[1:] if first is not None and self.marked[first] else text

    def _mended(self, given: list[int]) -> bytes:
        out, run = [], bytearray()
        for i in [*given, None]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode().encode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append(_BAD.encode())
                    n = 1
                at += n
            run.clear()
            if i is not None:
                out.append(self.surface[i])
        return b"".join(out)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process and file; workers that are used again keep it."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """All rows and columns of docs with _ids (array of int, the end id last) and _decoded (string); docs must not have these two."""
    if taken := {"_ids", "_decoded"}.intersection(docs.columns):
        raise ValueError(f"columns {sorted(taken)} are there already")
    path = path or public_tokenizers.path(MODEL)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch in batches:
            for start, end, texts in text_slices(batch, place, TEXT_BYTES):
                part = batch.slice(start, end - start)
                ids = [own.encode(t.decode()) for t in texts]
                decoded = [own.decode(i).decode() for i in ids]
                arrays = pa.array([np.frombuffer(i, "<u4").astype(np.int32) for i in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, arrays, pa.array(decoded, pa.string())], [*part.schema.names, "_ids", "_decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, _ids array<int>, _decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); the digests are made beside the ids, which then need not leave the worker."""
    path = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        digit = own.digits.__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for _, _, texts in text_slices(batch, 1, TEXT_BYTES):
                for text in texts:
                    ids = own.encode(text.decode())
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(" ".join(map(digit, np.frombuffer(ids, "<u4").tolist())).encode()).hexdigest())
                    b.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
