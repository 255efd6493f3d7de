
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# C keywords and primitive types that are never symbols.
KEYWORDS = ["auto", "break", "case", "char", "const", "continue", "default", "do", "double", "else", "enum", "extern", "float", "for", "goto", "if", "int", "long", "register", "return", "short", "signed", "sizeof", "static", "struct", "switch", "typedef", "union", "unsigned", "void", "volatile", "while"]
# What marks a line as a guard when alarms are prepared, and when bodies are mined.
GUARD = r"(?i)\b(if|while|for|switch)\b|<=|>=|<|>|&&|\|\||\bmin\b|\bmax\b|&\s*0x|%\s*\d+|clamp"
MINED_GUARD = r"(?i)\b(if|while|for|switch)\b|<=|>=|<|>|&&|\|\||&\s*0x|%\s*\d+|clamp|MIN|MAX"
# An identifier of an index; what may stand before a name that is set, and behind it; statements that set nothing; steps.
INDEX_NAME = r"(?<![\w.])([A-Za-z_]\w*)"
SET_BEFORE = r"(?<![\w.>])"
SET_AFTER = r"\s*(?:\[[^\]]*\])?\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)"
NOT_SET = r"\b(if|while|return)\b"
STEP = r"(?:\+\+|--)"
# The rewriting steps of a statement, in order.
NORMAL_STEPS = [
    (r"\(\s*\(void\)\s*\([^)]*\)\s*\)\s*;?", ""),
    (r"\(\s*\(?\s*([\w.]+)\s*\)?\s*!=\s*\(\s*0\s*!=\s*0\s*\)\s*\)", "$1"),
    (r"\(\s*1\s*!=\s*0\s*\)", "1"),
    (r"\(\s*0\s*!=\s*0\s*\)", "0"),
    (r"\(\s*(?:uint\d*|int|unsigned|signed|bool)\s*\)\s*", ""),
    (r"(?i)\b(0x[0-9a-f]+)u\b", "$1"),
    (r"\b(\d+)u\b", "$1"),
    *[(r"(?<![A-Za-z_0-9])\(\s*([\w.]+)\s*\)", "$1")] * 6,
    (r"\s+", " "),
    (r"^ | $", ""),
    (r"\b(if|while|for|switch|elif)\(", "$1 ("),
    (r"\b(if|while|switch|elif)\s+([^(].+)$", "$1 ($2)"),
]


def is_aoob(text: Column) -> Column:
    """The text names an array out of bounds, in any case."""
    return F.lower(F.coalesce(text, F.lit(""))).contains("array_out_of_bounds")


def alarm_text(message: Column, category: Column, location: Column) -> Column:
    """A message that ends in its location stays; else the location is added; without a message one is made for array accesses, or none."""
    message, location = F.trim(F.coalesce(message, F.lit(""))), F.trim(F.coalesce(location, F.lit("")))
    array = F.lower(F.coalesce(category, F.lit(""))).rlike("out-of-bound|array_out_of_bounds")
    return (
        F.when(~array & ~is_aoob(message), F.lit(None))
        .when((message != "") & message.endswith(F.concat(F.lit("at "), location)), message)
        .when(message != "", F.concat(message, F.lit(" at "), location))
        .otherwise(F.concat(F.lit("ALARM (A) array_out_of_bounds at "), location))
    )


def location_parts(location: Column) -> Column:
    """Struct (line1, col1, line2, col2, numeric_key); one-line form l.c-c2, many-line form l.c-l2.c2; null parts if neither."""
    many, one = r":(\d+)\.(\d+)-(\d+)\.(\d+)$", r":(\d+)\.(\d+)-(\d+)$"
    part = lambda pattern, i: F.regexp_extract(location, pattern, i)
    both = lambda i, j: F.when(location.rlike(many), part(many, i)).when(location.rlike(one), part(one, j)).cast("int")
    key = F.regexp_extract(location, r":(\d+\.\d+-(?:\d+\.)?\d+)$", 1)
    return F.struct(both(1, 1).alias("line1"), both(2, 2).alias("col1"), both(3, 1).alias("line2"), both(4, 3).alias("col2"), F.when(key != "", key).alias("numeric_key"))


def bare_fn(name: Column) -> Column:
    """The name before the first bar, trimmed."""
    return F.trim(F.substring_index(name, "|", 1))


def order_key(order: Column) -> Column:
    """Trimmed, without thousands commas."""
    return F.regexp_replace(F.trim(order), ",", "")


def frame_fn(entry: Column) -> Column:
    return F.regexp_extract(entry, r"^\s*call#(.*?) at ", 1)


def frame_line(entry: Column) -> Column:
    return F.regexp_extract(entry, r" at [^:]*:(\d+)", 1).try_cast("int")


def clean_index(text: Column) -> Column:
    """Surplus opening brackets go from the front and surplus closing ones from the end; then one pair that encloses all."""
    opened = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
    closed = F.length(text) - F.length(F.replace(text, F.lit(")"), F.lit("")))
    lead, tail = F.length(F.regexp_extract(text, r"^\(*", 0)), F.length(F.regexp_extract(text, r"\)*$", 0))
    front, end = F.greatest(F.lit(0), F.least(opened - closed, lead)), F.greatest(F.lit(0), F.least(closed - opened, tail))
    balanced = F.substring(text, front + 1, F.length(text) - front - end)
    return F.trim(F.regexp_replace(balanced, r"^\(([^()]*)\)$", "$1"))


def index_tokens(text: Column) -> Column:
    """Identifiers in order of first sight; not parts of numbers, not members after a dot, no keywords."""
    found = F.regexp_extract_all(text, F.lit(INDEX_NAME), 1)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(KEYWORDS)))


def ident_pieces(*names: Column) -> Column:
    """P10: the lower-case pieces of identifiers, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.concat_ws("_", *names)), "[^a-z0-9]+"), lambda x: x != "")))


def is_guard(text: Column, pattern: str = GUARD) -> Column:
    """P15."""
    return text.rlike(pattern)


def is_lhs_write(text: Column, token: Column) -> Column:
    """Token itself (no member of another) is assigned, by = or a compound operator, or stepped by ++ or --.

    Comments don't count, nor does an assignment whose left side holds if, while or return; such a line is no step either.
    """
    code = F.substring_index(text, "//", 1)
    name = F.concat(F.lit(r"\b\Q"), token, F.lit(r"\E\b"))
    free = F.lit(SET_BEFORE)
    assigned = F.regexp_like(code, F.concat(free, F.lit(r"\*?\s*"), name, F.lit(SET_AFTER)))
    head = F.substring_index(code, "=", 1)
    step = F.regexp_like(code, F.concat(free, name, F.lit(rf"\s*{STEP}|{STEP}\s*"), name))
    return F.when(assigned, head.contains(token) & ~head.rlike(NOT_SET)).otherwise(step)


def collapse_ws(text: Column) -> Column:
    """P17."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clip(text: Column, n: int) -> Column:
    """At most n characters, then how many more there are."""
    more = (F.length(text) - n).cast("string")
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("… ["), more, F.lit(" more chars]"))).otherwise(text)


def display_variable(given: Column, symbol: Column, index: Column) -> Column:
    """P18."""
    whole = F.when((symbol != "") & (index != ""), F.concat(symbol, F.lit("["), index, F.lit("]")))
    return F.coalesce(F.when(F.trim(given) != "", F.trim(given)), whole, symbol)


def normalize_stmt(text: Column) -> Column:
    """P20: void casts go, constant truths fold, scalar casts and u suffixes go, brackets around single names open, conditions are in brackets."""
    text = F.trim(text)
    for pattern, into in NORMAL_STEPS:
        text = F.regexp_replace(text, pattern, into)
    return text


def strip_line(text: Column) -> Column:
    """A line without its blanks and the comment at its end."""
    return F.regexp_replace(F.regexp_replace(text, r"//[\s\S]*$", ""), r"^\s+|\s+$", "")


def is_noise(text: Column) -> Column:
    """Blank, preprocessor, only braces and semicolons, or a line that begins with a comment which ends there."""
    line = strip_line(text)
    return (line == "") | line.rlike(r"^#|^[{};]+$") | (line.startswith("/*") & line.contains("*/"))


def open_call(before: Column) -> Column:
    """What stands before a place, without the bracket pairs that are closed there, four levels deep."""
    bare = before
    for _ in range(4):
        bare = F.regexp_replace(bare, r"\([^()]*\)", "")
    return F.when(before.contains(")"), bare).otherwise(before)


#: Bracket groups that hold up to three levels of further ones, and what makes of the name before them a written one. The assignment signs.
_GROUP = r"\[[^\[\]]*\]"
for _ in range(3):
    _GROUP = r"\[(?:[^\[\]]|" + _GROUP + r")*\]"
WRITTEN = r"^(?:\s*" + _GROUP + r")*\s*(?:=[^=]|[-+*/%&|^]=|<<=|>>=|\+\+|--)"


def access_kind(text: Column, before: Column, after: Column, declared: Column) -> Column:
    """What an occurrence does, by what stands before and after it: declaration, address, write, parameter, read; the first that fits."""
    depth = F.length(F.regexp_replace(before, r"[^(]", "")) - F.length(F.regexp_replace(before, r"[^)]", ""))
    bare = open_call(before)
    return (
        F.when(declared, "declaration")
        .when(before.rlike(r"(^|[^&])&\s*$"), "address")
        .when(after.rlike(WRITTEN) | before.rlike(r"(\+\+|--)\s*$"), "write")
        .when((depth > 0) & bare.rlike(r"\w\s*\([^()]*$") & ~bare.rlike(r"\b(if|while|for|switch|return)\s*\(+[^()]*$"), "parameter")
        .otherwise("read")
    )


def symbol_kind(is_array: Column, is_member: Column, is_pointer: Column, is_parameter: Column, is_struct: Column) -> Column:
    """The first that fits."""
    return F.when(is_array, "array").when(is_member, "struct_member").when(is_pointer, "pointer").when(is_parameter, "parameter").when(is_struct, "struct").otherwise("symbol")


def symbol_scope(function: Column, is_parameter: Column, is_member: Column) -> Column:
    """P14."""
    return F.when(is_parameter, "parameter").when(is_member, "struct_member").when(function.isNull() | (function == "global"), "global").otherwise("local")


def safe_name(order: Column) -> Column:
    """An order as a folder name."""
    return F.regexp_replace(order, r"[^\p{L}\p{N}._-]", "_")
