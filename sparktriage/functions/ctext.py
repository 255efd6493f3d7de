"""Scanners of one C text: brackets and their partners, declarators, functions, declarations, parameters, initializers.

Each goes once over its text, so that a file of hundreds of thousands of lines costs what its length says. Brackets left open end with the text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

from .scalars import KEYWORDS

_HIDDEN = re.compile(r"/\*.*?(?:\*/|\Z)|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|^[ \t]*#(?:\\.|[^\\\n])*", re.S | re.M)
_SHOWN = re.compile(r"[^\n]")
_PIECE = re.compile(r"[A-Za-z_]\w*|\d\w*|\S")
_WORD, _MACRO = re.compile(r"[A-Za-z_]"), re.compile(r"[A-Z][A-Z0-9_]*")
#: How a declaration begins: a word, then another one, a star or a bracket.
_BEGUN = re.compile(r"\s*([A-Za-z_]\w*)(?!\w)\s*[A-Za-z_*(]")
_QUALIFIERS = {"static", "extern", "const", "volatile", "register", "inline"}
_TAGS = {"struct", "union", "enum"}
#: Words that begin no declaration of a variable; the others of KEYWORDS are types or qualifiers.
_STATEMENTS = {"break", "case", "continue", "default", "do", "else", "for", "goto", "if", "return", "sizeof", "switch", "typedef", "while"}
_CLOSING = {"(": ")", "[": "]", "{": "}"}
#: Initializers longer than this many lines are not counted.
INITIALIZER_LINES = 20_000


def blank(text: str) -> str:
    """Comments, strings and directives as blanks, so that offsets and lines stay."""
    return _HIDDEN.sub(lambda m: _SHOWN.sub(" ", m.group()), text)


def line_of(text: str) -> Callable[[int], int]:
    """The line of an offset."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return lambda at: bisect_right(ends, at - 1) + 1


def partners(flat: str) -> dict[int, int]:
    """The offset of every opening bracket's partner. A closing one ends what was opened since its own kind, if that is one of the last eight; without a partner it is the text's end."""
    found: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    for m in re.finditer(r"[()\[\]{}]", flat):
        sign = m.group()
        if sign in _CLOSING:
            open_.append((_CLOSING[sign], m.start()))
        elif open_ and open_[-1][0] == sign:
            found[open_.pop()[1]] = m.start()
        elif any(kind == sign for kind, _ in open_[-8:]):
            while open_[-1][0] != sign:
                found[open_.pop()[1]] = m.start()
            found[open_.pop()[1]] = m.start()
    return found | {at: len(flat) for _, at in open_}


def declarators(flat: str, start: int, end: int, pair: dict[int, int]) -> Iterator[tuple[str, str, bool, int, str, int]]:
    """(name, type, macro, pointer depth, dims, offset of the name) of what flat[start:end] declares, an automaton over its pieces.

    words collects the type and, if no sign comes between, the first name; then declarators follow, with stars, a name in
    brackets of its own (a pointer to a function or an array), dims, and an initializer that is jumped over by partners.
    """
    begun = _BEGUN.match(flat, start, end)
    if not begun or begun.group(1) in _STATEMENTS:
        return
    pieces = [(m.group(), m.start()) for m in _PIECE.finditer(flat, start, end)]
    i, words, macro = 0, [], False

    def beyond(at: int) -> int:
        """The number of the piece behind the partner of the bracket at an offset."""
        to, k = pair.get(at, end), i
        while k < len(pieces) and pieces[k][1] <= to:
            k += 1
        return k

    while i < len(pieces) and _WORD.match(pieces[i][0]):
        if len(words) == 0 and i + 2 < len(pieces) and pieces[i + 1][0] == "(" and _MACRO.fullmatch(pieces[i][0]):
            to = beyond(pieces[i + 1][1])
            if to < len(pieces) and re.match(r"[A-Za-z_*]", pieces[to][0]):  # a macro around the type
                words, macro, i = [pieces[i + 2]], True, to
                continue
        words.append(pieces[i])
        i += 1
    if i == len(pieces) or pieces[i][0] not in ("*", "("):  # the last word is the first name
        i -= 1
        if words:
            words.pop()
    kinds = [w for w, _ in words if w not in _QUALIFIERS and w not in _TAGS]
    if not kinds or any(w in _STATEMENTS for w, _ in words):
        return
    kind = " ".join(kinds)
    while i < len(pieces):
        depth, dims, name = 0, "", None
        while i < len(pieces) and pieces[i][0] in ("*", "const", "volatile"):
            depth += pieces[i][0] == "*"
            i += 1
        if i < len(pieces) and pieces[i][0] == "(":  # (*name)(...) or (*name[n])(...)
            to = beyond(pieces[i][1])
            inner = [p for p in pieces[i + 1 : to - 1]]
            stars = sum(1 for p in inner if p[0] == "*")
            names = [p for p in inner if _WORD.match(p[0]) and p[0] not in KEYWORDS]
            if not stars or inner[0][0] != "*" or not names or to >= len(pieces) or pieces[to][0] not in "([":
                return
            name, depth = names[0], depth + stars
            dims = "".join("".join(p[0] for p in inner).partition(name[0])[2].split())
            i = beyond(pieces[to][1])
        elif i < len(pieces) and _WORD.match(pieces[i][0]) and pieces[i][0] not in KEYWORDS:
            name = pieces[i]
            i += 1
        if name is None:
            return
        while i < len(pieces) and pieces[i][0] == "[":
            to = pair.get(pieces[i][1], end)
            dims += "".join(flat[pieces[i][1] : to + 1].split())
            i = beyond(pieces[i][1])
        after = pieces[i][0] if i < len(pieces) else ";"
        if after not in ("=", ",", ";", ":") or (after == "=" and i + 1 < len(pieces) and pieces[i + 1][0] == "="):
            return
        yield name[0], kind, macro, depth, dims, name[1]
        while i < len(pieces) and pieces[i][0] != ",":
            i = beyond(pieces[i][1]) if pieces[i][0] in _CLOSING else i + 1
        i += 1


def declarations(text: str) -> Iterator[tuple]:
    """(name, type, macro, pointer depth, dims, line, owner) of all declarations; the owner is the struct around, by its closing name if it has one."""
    flat = blank(text)
    pair, line = partners(flat), line_of(text)
    owners: list[str | None] = []
    start = resume = 0
    filled = False
    for m in re.finditer(r"[;{}(=]", flat):
        at, sign = m.start(), m.group()
        if at < resume:
            continue
        if sign == "(":
            resume = pair[at] + 1
        elif sign == "=":
            filled = True
        elif sign == "{" and filled:
            resume = pair[at] + 1
        else:
            if sign == ";":
                for name, kind, macro, depth, dims, place in declarators(flat, start, at, pair):
                    yield name, kind, macro, depth, dims, line(place), owners[-1] if owners else None
            elif sign == "{":
                head = re.search(r"\b(?:struct|union)\b\s*(\w+)?\s*$", flat[start:at])
                close = re.compile(r"\}[ \t]*([A-Za-z_]\w*)").match(flat, pair[at]) if head else None
                owners.append((close.group(1) if close else head.group(1)) if head else None)
            elif owners:
                owners.pop()
            start, filled = at + 1, False


def parameters(params: str | None) -> list[tuple[str, str, str, int]]:
    """(name, type, dims, pointer depth) of a parameter list, one that is a pointer to a function by its own name."""
    flat = params or ""
    pair = partners(flat)
    out, start, at = [], 0, 0
    while at <= len(flat):
        sign = flat[at] if at < len(flat) else ","
        if sign == ",":
            out += [(name, kind, dims, depth) for name, kind, _, depth, dims, _ in declarators(flat, start, at, pair)]
            start = at + 1
        at = pair[at] + 1 if sign in _CLOSING else at + 1
    return out


def _signature(head: str) -> tuple[str, int, str] | None:
    """(name, offset, parameters) by the last balanced bracket group at the top whose name can be a function's."""
    if "=" in head:
        return None
    found, depth, start = None, 0, 0
    for m in re.finditer(r"[()]", head):
        if m.group() == "(":
            start = m.start() if depth == 0 else start
            depth += 1
        else:
            depth -= 1
            name = re.search(r"([A-Za-z_]\w*)\s*$", head[:start]) if depth == 0 else None
            if name and name.group(1) not in KEYWORDS and not name.group(1).startswith("__"):
                found = name.group(1), name.start(1), head[start + 1 : m.start()]
    return found


def functions(text: str) -> Iterator[tuple]:
    """(name, defined, first and last line of the body, line and text of the name, parameters, blanked body) of definitions and prototypes."""
    flat, lines = blank(text), text.split("\n")
    line = line_of(text)
    depth, last, opened = 0, 0, 0
    for m in re.finditer(r"[{};]", flat):
        at, sign = m.start(), m.group()
        if sign == "{":
            opened = at if depth == 0 else opened
            depth += 1
        elif sign == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                found = _signature(flat[last:opened])
                if found:
                    where = line(last + found[1])
                    yield found[0], True, line(opened), line(at), where, lines[where - 1], found[2], flat[opened : at + 1]
                last = at + 1
        elif depth == 0:
            found = _signature(flat[last:at])
            if found and re.search(r"\w\s*[\s*]$", flat[last : last + found[1]]):
                where = line(last + found[1])
                yield found[0], False, None, None, where, lines[where - 1], found[2], None
            last = at + 1


def initializers(text: str) -> Iterator[tuple]:
    """(name, line, pieces at the top) of each `name[...] = { ... }` that closes within INITIALIZER_LINES."""
    flat, line = blank(text), line_of(text)
    pair = partners(flat)
    piece = re.compile(r"[{(,]|[^\s{(,]+")
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*((?:\[[^\]]*\]\s*)+)=\s*\{", flat):
        at, end, items, filled = m.end(), pair[m.end() - 1], 0, False
        if end == len(flat) or line(end) - line(m.start()) > INITIALIZER_LINES:
            continue
        while (t := piece.search(flat, at, end)) is not None:
            sign = t.group()
            items, filled = (items + filled, False) if sign == "," else (items, True)
            at = pair[t.start()] + 1 if sign in _CLOSING else t.end()
        yield m.group(1), line(m.start()), items + filled
