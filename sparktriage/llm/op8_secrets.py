"""Operator 8, secret scan by one combined deterministic automaton.

All rules are compiled together: each rule's regular expression, reversed, becomes a nondeterministic automaton; subset
construction over all of them and minimisation give one table of transitions. One pass over the bytes of a batch, from the
last to the first, then tells for every position which rules have a match that begins there. From these positions the rule's
own small automaton finds the longest end; matches of a kind are taken from left to right and do not overlap.

The pass runs many stretches of the batch side by side. Each stretch starts in the automaton's first state; where the
stretch before it ended in another state, its beginning is run again until both agree, so no match is lost at a cut.

Null text has no secrets; empty tables give empty results; spans are in code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices


@dataclass(frozen=True)
class SecretRule:
    """kind; pattern (bytes; literals, classes, groups, | ? * + {m} {m,}).

    Matches of which less than least bytes follow the prefix pattern (the whole match, if there is none) are found, so that no
    other match overlaps them, and dropped. Lengths that are not in the pattern keep the combined automaton small.
    """

    kind: str
    pattern: str
    prefix: str = ""
    least: int = 0


def _any_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "(" + "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")]) + ")"
_ASSIGN = _KEYS + "[\"']?\x20*[:=]\x20*[\"']?"
RULES = (
    SecretRule("assign", _ASSIGN + "[A-Za-z0-9+/_.=\\-]+", _ASSIGN, 8),
    SecretRule("access", "AKIA[A-Z0-9]+", "", 16),
    SecretRule("hex", "[0-9a-f]{8,}", "", 32),
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_", 36),
    SecretRule("slack", "xox[abprs]-[A-Za-z0-9\\-]+", "xox[abprs]-", 10),
    SecretRule("jwt", "eyJ[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+\\.[A-Za-z0-9_\\-]+", "", 30),
    SecretRule("private_key", "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)


# --- regular expressions to automata ---


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.step: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.step.append([])
        return len(self.step) - 1

    def add(self, node, start: int) -> int:
        """Builds node from start; the state in which it has matched."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.step[start].append((node[1], end))
            return end
        if kind == "all":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in node[1]:
                first = self.state()
                self.empty[start].append(first)
                self.empty[self.add(part, first)].append(end)
            return end
        _, part, low, high = node
        for _ in range(low):
            start = self.add(part, start)
        if high is None:
            loop = self.state()
            self.empty[start].append(loop)
            self.empty[self.add(part, loop)].append(loop)
            return loop
        end = self.state()
        self.empty[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start)
            self.empty[start].append(end)
        return end


def _parse(pattern: str):
    at = 0

    def alternatives():
        nonlocal at
        parts = [sequence()]
        while at < len(pattern) and pattern[at] == "|":
            at += 1
            parts.append(sequence())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def sequence():
        parts = []
        while at < len(pattern) and pattern[at] not in "|)":
            parts.append(repeated(atom()))
        return ("all", parts)

    def atom():
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            inner = alternatives()
            at += 1
            return inner
        if c == "[":
            members: set[int] = set()
            while pattern[at] != "]":
                first = literal()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    members.update(range(first, literal() + 1))
                else:
                    members.add(first)
            at += 1
            return ("set", frozenset(members))
        at -= 1
        return ("set", frozenset([literal()]))

    def literal() -> int:
        nonlocal at
        at += 2 if pattern[at] == "\\" else 1
        return ord(pattern[at - 1])

    def repeated(node):
        nonlocal at
        if at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                at = end + 1
                return ("rep", node, int(low), int(high) if high else None if comma else int(low))
            return ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    return alternatives()


def _reversed(node):
    if node[0] == "all":
        return ("all", [_reversed(x) for x in reversed(node[1])])
    if node[0] == "or":
        return ("or", [_reversed(x) for x in node[1]])
    return ("rep", _reversed(node[1]), *node[2:]) if node[0] == "rep" else node


@dataclass
class Automaton:
    """next[state * classes + byte_class[byte]] is the state that follows; accepts[state] has bit i for rule i. State 0 is the first."""

    byte_class: np.ndarray
    classes: int
    next: np.ndarray
    accepts: np.ndarray
    rows: list[list[int]] = field(default_factory=list)


def compile_rules(patterns: list[str], backwards: bool, anchored: bool) -> Automaton:
    """One minimal automaton for all patterns: over reversed patterns if backwards; matches may begin anywhere unless anchored."""
    nfa, start = _Nfa(), 0
    nfa.state()
    ends: dict[int, int] = {}
    for i, pattern in enumerate(patterns):
        node = _parse(pattern)
        first = nfa.state()
        nfa.empty[start].append(first)
        end = nfa.add(_reversed(node) if backwards else node, first)
        ends[end] = ends.get(end, 0) | 1 << i

    sets = sorted({s for steps in nfa.step for s, _ in steps}, key=sorted)
    kinds: dict[tuple[bool, ...], int] = {}
    byte_class = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    sample = {k: next(b for b in range(256) if byte_class[b] == k) for k in range(len(kinds))}

    def closure(states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for x in nfa.empty[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(x for x in out if nfa.step[x] or x in ends)

    origin = closure([start])
    names, rows, todo = {origin: 0}, [], [origin]
    for now in todo:  # grows while it is read
        row = []
        for k in range(len(kinds)):
            got = {t for x in now for s, t in nfa.step[x] if sample[k] in s}
            after = closure(got | (set() if anchored else {start}))
            if after not in names:
                names[after] = len(names)
                todo.append(after)
            row.append(names[after])
        rows.append(row)
    accepts = [0] * len(todo)
    for states, i in names.items():
        for x in states:
            accepts[i] |= ends.get(x, 0)

    block = {a: i for i, a in enumerate(dict.fromkeys(accepts))}  # minimisation: split blocks until they are stable
    part = [block[a] for a in accepts]
    while True:
        seen: dict[tuple, int] = {}
        finer = [seen.setdefault((part[i], *(part[j] for j in row)), len(seen)) for i, row in enumerate(rows)]
        if len(seen) == len(set(part)):
            break
        part = finer
    some = {b: i for i, b in reversed(list(enumerate(part)))}
    order = dict.fromkeys([part[0], *some])
    place = {b: i for i, b in enumerate(order)}
    table_ = [[place[part[j]] for j in rows[some[b]]] for b in order]
    return Automaton(byte_class, len(kinds), np.array(table_, np.int32).ravel(), np.array([accepts[some[b]] for b in order], np.int64), table_)


@cache
def automata(rules: tuple[SecretRule, ...]) -> tuple[Automaton, list[Automaton], list[Automaton | None]]:
    return (
        compile_rules([r.pattern for r in rules], True, False),
        [compile_rules([r.pattern], False, True) for r in rules],
        [compile_rules([r.prefix], False, True) if r.prefix else None for r in rules],
    )


# --- scanning ---

LANES = 2048


def run_states(machine: Automaton, raw: np.ndarray) -> np.ndarray:
    """The state after each byte of raw, read from first to last."""
    n = len(raw)
    codes = machine.byte_class[raw]
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    padded = np.zeros(steps * lanes, np.uint8)
    padded[:n] = codes
    grid = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    out = np.empty((steps, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for i in range(steps):
        state = machine.next[state * machine.classes + grid[i]]
        out[i] = state
    flat = out.T.ravel()
    rows = machine.rows
    for lane in range(1, lanes):  # a stretch before it may have ended amid a match
        at, now = lane * steps, int(flat[lane * steps - 1])
        end = min(n, at + steps)
        was = 0
        while at < end and now != was:
            was, now = int(flat[at]), rows[now][padded[at]]
            if was == now:
                break
            flat[at] = now
            at += 1
    return flat[:n]


def _longest(machine: Automaton, raw: bytes, start: int, end: int) -> int:
    """The longest match's end from start, -1 without one."""
    state, best, rows, kinds, accepts = 0, -1, machine.rows, machine.byte_class, machine.accepts
    for i in range(start, end):
        state = rows[state][kinds[raw[i]]]
        if accepts[state]:
            best = i + 1
        elif not any(x != state for x in rows[state]):
            break  # nothing leads out of the dead state
    return best


def scan(texts: list[bytes], rules: tuple[SecretRule, ...] = RULES) -> list[list[tuple[str, int, int]]]:
    """Of each text, its (kind, start, end) in code points, by start, then in the order of rules."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    back, forward, prefixes = automata(rules)
    joined = b"\x00".join(texts)
    if not joined:
        return out
    raw = np.frombuffer(joined, np.uint8)
    begins = back.accepts[run_states(back, raw[::-1])][::-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return out
    starts = np.cumsum([0, *[len(t) + 1 for t in texts]])
    points = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int32)  # code points up to each byte, all texts counted on
    owner = np.searchsorted(starts, at, "right") - 1
    free = [0] * len(rules)
    last = -1
    for p, d in zip(at.tolist(), owner.tolist()):
        if d != last:
            free, last = [0] * len(rules), d
        flags = int(begins[p])
        for i, rule in enumerate(rules):
            if not flags >> i & 1 or p < free[i]:
                continue
            stop = int(starts[d + 1]) - 1
            end = _longest(forward[i], joined, p, stop)
            free[i] = end
            if end - (_longest(prefixes[i], joined, p, stop) if rule.prefix else p) < rule.least:
                continue
            before = int(points[p]) - int(points[starts[d]])  # the rules' matches begin with ASCII characters, of one byte each
            out[d].append((rule.kind, before, before + end - p))
    return out


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind,start,end>>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for i, j, texts in text_slices(batch, 1, 4 << 20):
                found = [[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in scan(texts, rules)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found, kind)], ["_key", "spans"])

    slim = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("_text"))
    return slim.mapInArrow(run, f"_key {slim.schema['_key'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("_key", doc_id)


def _of(kinds: list[str]) -> Column:
    return F.filter("spans", lambda s: s["kind"].isin(kinds))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in RULES[:3]]
    counts = [F.size(_of([k])).cast("long").alias(f"n_{k}") for k in base]
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, F.sha2(_joined(_of(base)).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
