"""Extraction jobs over many C files, texts as (pver_id, file_id, text). One file is the unit; scanners are small helpers, the rest is joins.

Null texts give no rows; brackets left open end with the file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ctext
from ..functions import scalars as S
from ..functions.ctext import blank as blank
from ..sources.scratch import checkpoint, many
from .facts import merge_windows, verify_quotes
from .symbols import FILE, LINE, _with_span, extract_constants, occurrences, resolve_declaration

CALL = r"((?<!\w)[A-Za-z_]\w*|\(\s*\*\s*[A-Za-z_]\w*\s*\))\s*(?=\()"
# Kinds a fact may have, and those that state a bound.
ALLOWED = ["declaration", "alarm_site", "access", "write", "read", "guard", "clamp", "mask", "loop_bound", "arg_binding", "call_edge", "path_step", "value_site", "array_size_hint", "local_guard", "fact"]
BOUNDS = ["guard", "clamp", "mask", "loop_bound", "local_guard", "array_size_hint"]
#: Rows of a scanner that are handed on together.
SCANNED_ROWS = 10_000


def _per_file(texts: DataFrame, scan: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(*(c.to_pylist() for c in batch.columns))
            found = ((p, f, *r) for p, f, text in texts if text for r in scan(text))  # a file at a time: no more than its rows are held
            while rows := list(islice(found, SCANNED_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    picked = texts.select(*FILE, "text")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema[:2]) + ", " + fields
    schema = to_arrow_schema(_parse_datatype_string(ddl))
    return many(picked.mapInArrow(run, ddl))


def extract_functions(texts: DataFrame) -> DataFrame:
    """Definitions (defined) and prototypes with the lines of the body's brackets and of the name, parameters and the blanked body."""
    return _per_file(texts, ctext.functions, "fn string, defined boolean, start_line int, end_line int, sig_line int, sig_text string, params string, body string")


def extract_calls(functions: DataFrame) -> DataFrame:
    """Callees of each defined function once, by first call; (*fp)(...) counts, keywords don't. Duplicate definitions are merged."""
    calls = functions.where("defined").select(*FILE, F.col("fn").alias("caller"), "start_line", F.posexplode(F.regexp_extract_all("body", F.lit(CALL), 1)).alias("at", "raw"))
    named = calls.withColumn("callee", F.regexp_replace("raw", r"[^\w]", "")).where(~F.col("callee").isin(S.KEYWORDS) & ~F.col("callee").startswith("__"))
    first = named.groupBy(*FILE, "caller", "callee").agg(F.min(F.struct("start_line", "at")).alias("first"))
    pos = F.row_number().over(Window.partitionBy(*FILE, "caller").orderBy("first"))
    return first.select(*FILE, "caller", "callee", pos.alias("pos"))


def extract_declarations(texts: DataFrame) -> DataFrame:
    """Declarations: each name of a statement with its type (also macro-wrapped or on a line before), pointer depth, dims as text, line, owning struct or null."""
    return _per_file(texts, ctext.declarations, "symbol string, datatype string, macro boolean, pointer_depth int, dims string, line_no int, owner string")


def extract_parameters(functions: DataFrame) -> DataFrame:
    """Parameters of definitions: name, type, dims, pointer depth; one that is a pointer to a function by its own name. void gives none."""

    @F.pandas_udf("array<struct<symbol string, datatype string, dims string, pointer_depth int>>")
    def parsed(params: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("symbol", "datatype", "dims", "pointer_depth"), p)) for p in ctext.parameters(x)] for x in params], dtype=object)

    return functions.where("defined").select(*FILE, "fn", F.posexplode(parsed("params")).alias("place", "p")).select(*FILE, "fn", "place", "p.*")


def extract_typedefs(texts: DataFrame) -> DataFrame:
    """Array typedefs of a file with their dims; the first of a name."""
    found = texts.select(*FILE, F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*typedef\s+[^;\[]*?\b(\w+\s*(?:\[[^\]]*\])+)\s*;"), 1)).alias("at", "t"))
    return many(found).groupBy(*FILE, F.regexp_extract("t", r"^\w+", 0).alias("name")).agg(F.min_by(F.regexp_extract("t", r"\[.*$", 0), "at").alias("dims"))


def extract_defines(texts: DataFrame) -> DataFrame:
    """The integer constants of each file."""
    lines = texts.select(*FILE, F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return extract_constants(many(lines), tuple(FILE))


def initializer_sizes(texts: DataFrame) -> DataFrame:
    """Pieces at the top of `= { ... }` behind an array's declaration; none if it does not close within INITIALIZER_LINES."""
    return _per_file(texts, ctext.initializers, "symbol string, line_no int, n_items int")


_HEAD = re.compile(r"((?:[A-Za-z_]\w*[\s\0]*(?:->|\.)\s*)*)([A-Za-z_]\w*)\s*\)*([\s\0]*)$")
_ACCESS = re.compile(r"([A-Za-z_]\w*)\s*\)?\s*\[")


def array_from_bracket(text: str, at: int) -> tuple[str | None, str | None, int]:
    """(array, member path, dimension) of the access whose bracket is text[at]; the name is None if there is no such access.

    What is in closed brackets before it is blanked, so that earlier dimensions, however deep, stand between name and bracket.
    """
    if not 0 <= at < len(text) or text[at] != "[":
        return None, None, 0
    flat, n = text[:at], 1
    while n:
        flat, n = re.subn(r"\[[^\[\]]*\]", lambda m: "\0" * len(m.group()), flat)
    head = _HEAD.search(flat)
    if not head or head.group(2) in S.KEYWORDS:
        return None, None, 0
    depth = groups = 0
    for sign in text[head.start(3) : at]:
        depth += (sign == "[") - (sign == "]")
        groups += sign == "]" and depth == 0
    return head.group(2), re.sub(r"[\s\0]", "", head.group(1) + head.group(2)), groups


def locate_access(before: list[str], lines: list[str], col: int, end_col: int | None) -> tuple[str | None, str | None, str | None, int]:
    """(array, member path, index, dimension) of an access that begins at column col of lines[0] and ends at end_col of the last line.

    The bracket is at the column, else the last one before it. Without a name there, the first name[ of the lines counts. Without
    an end column the index runs to the bracket's partner.
    """
    prefix = "".join(f"{x}\n" for x in before)
    first = prefix + lines[0]
    text = prefix + "\n".join([*lines[:-1], lines[-1][:end_col] if end_col and len(lines) > 1 else lines[-1]])
    place = len(prefix) + col - 1
    own = len(prefix) if len(lines) == 1 else 0  # on one line, no bracket of a line before counts
    at = place if 0 <= place < len(first) and first[place] == "[" else text.rfind("[", own, max(own, min(len(text), place + 1)))
    name, path, dimension = array_from_bracket(text, at)
    start = max(place, len(prefix))
    if end_col:
        index = text[start : len(prefix) + end_col] if len(lines) == 1 else text[start:]
        index = index.removeprefix("[")
    else:
        depth = 0
        end = len(text)
        for end in range(max(at, 0), len(text)):
            depth += (text[end] == "[") - (text[end] == "]")
            if depth == 0:
                break
        index = text[at + 1 : end] if at >= 0 else None
    if name is None and (found := _ACCESS.search(text)):
        name, path = found.group(1), found.group(1)
    return name, path, index and index.strip(), dimension


SPOT = [*LINE, "col", "end_line", "end_col", "underlined"]


def resolve_access(alarms: DataFrame, lines: DataFrame) -> DataFrame:
    """Array, member path, index and dimension of the access of each alarm (pver_id, file_id, line_no, col, and if known end_line, end_col, underlined)."""
    return accesses(alarms, lines).select(*LINE, "col", "array", "member_path", "index", "dimension")


def accesses(alarms: DataFrame, lines: DataFrame) -> DataFrame:
    """X07 with the alarm's whole place (SPOT).

    Two lines before it are looked at, too. Without any access the underlined variable (P19) is taken if it is a name. An alarm's
    few lines are put together by an equi-join on exploded line numbers.
    """
    for name, kind in (("end_line", "int"), ("end_col", "int"), ("underlined", "string")):
        if name not in alarms.columns:
            alarms = alarms.withColumn(name, F.lit(None).cast(kind))
    key = SPOT
    spans = alarms.select(*key).distinct().withColumn("at", F.explode(F.sequence(F.col("line_no") - 2, F.coalesce("end_line", "line_no"))))
    own = spans.join(lines.select(*FILE, F.col("line_no").alias("at"), "text"), [*FILE, "at"])
    near = own.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("near"))
    told = near.withColumns({"before": F.expr("transform(filter(near, x -> x.at < line_no), x -> x.text)"), "own": F.expr("transform(filter(near, x -> x.at >= line_no), x -> x.text)")}).where(F.size("own") > 0)

    @F.pandas_udf("array string, member_path string, index string, dimension int")
    def access(before: pd.Series, own: pd.Series, col: pd.Series, end_col: pd.Series) -> pd.DataFrame:
        found = [locate_access(list(b), list(o), int(c), None if pd.isna(e) else int(e)) if not pd.isna(c) else (None, None, None, 0) for b, o, c, e in zip(before, own, col, end_col)]
        return pd.DataFrame(found, columns=["array", "member_path", "index", "dimension"])

    done = told.select(*SPOT, access("before", "own", "col", "end_col").alias("a")).select(*SPOT, "a.*")
    name = F.when(F.col("underlined").rlike(r"^[A-Za-z_]\w*$"), F.col("underlined"))
    lost = F.col("array").isNull() & name.isNotNull()
    return done.select(*SPOT, F.coalesce("array", name).alias("array"), F.coalesce("member_path", name).alias("member_path"), F.when(~lost, S.clean_index(F.col("index"))).alias("index"), F.when(~lost & F.col("array").isNotNull(), F.col("dimension")).alias("dimension"))


def relevant_symbols(access: DataFrame) -> DataFrame:
    """The flagged array, the parents of its member path and the identifiers of its index, once each; keywords drop out."""
    return _named(access).drop("place").distinct()


def _named(access: DataFrame) -> DataFrame:
    """X08 with each symbol's first place in that order."""
    parents = F.filter(F.split("member_path", r"->|\."), lambda x: x != F.col("array"))
    one = lambda role, names: F.transform(names, lambda n: F.struct(F.lit(role).alias("role"), n.alias("symbol")))
    every = F.concat(one("array", F.array("array")), one("parent", parents), one("index", S.index_tokens(F.coalesce("index", F.lit("")))))
    named = access.where("array is not null").select(*LINE, "col", F.posexplode(every).alias("place", "s")).select(*LINE, "col", "s.*", "place").where(~F.col("symbol").isin(S.KEYWORDS))
    return named.groupBy(*LINE, "col", "role", "symbol").agg(F.min("place").alias("place"))


def resolve_dims(decls: DataFrame, constants: DataFrame) -> DataFrame:
    """Sizes of the bracket groups in dims (pver_id, file_id, dims): numbers, constants of the file, and + - * / with brackets.

    Distinct dims are evaluated once. An unknown name, an empty group, a division by zero or another sign gives null there; all_known says if none did.
    """
    own = decls.select(*FILE, "dims").where("dims <> ''").distinct()
    names = own.select(*FILE, "dims", F.explode(F.regexp_extract_all("dims", F.lit(r"(?<!\w)([A-Za-z_]\w*)"), 1)).alias("name")).distinct()
    valued = names.join(constants, [*FILE, "name"]).groupBy(*FILE, "dims").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("known"))

    @F.pandas_udf("array<long>")
    def sizes(dims: pd.Series, known: pd.Series) -> pd.Series:
        return pd.Series([[dim_eval(g, dict(k) if k is not None else {}) for g in re.findall(r"\[([^\]]*)\]", d)] for d, k in zip(dims, known)])

    done = own.join(valued, [*FILE, "dims"], "left").select(*FILE, "dims", sizes("dims", "known").alias("sizes"))
    return done.withColumn("all_known", F.forall("sizes", lambda x: x.isNotNull()))


def dim_eval(text: str, known: dict[str, int]) -> int | None:
    """The integer value of one dimension, or None."""
    tokens = re.findall(r"[A-Za-z_]\w*|\d+(?=[uUlL]*\b)|[-+*/()]|\S", re.sub(r"\b(\d+)[uUlL]+\b", r"\1", text))
    values: list[int] = []
    signs: list[str] = []
    weight = {"+": 1, "-": 1, "*": 2, "/": 2}

    def apply() -> None:
        b, a, sign = values.pop(), values.pop(), signs.pop()
        values.append(a + b if sign == "+" else a - b if sign == "-" else a * b if sign == "*" else int(a / b))

    try:
        for t in tokens:
            if t.isdigit():
                values.append(int(t))
            elif t in known:
                values.append(known[t])
            elif t == "(":
                signs.append(t)
            elif t == ")":
                while signs[-1] != "(":
                    apply()
                signs.pop()
            elif t in weight:
                while signs and signs[-1] != "(" and weight[signs[-1]] >= weight[t]:
                    apply()
                signs.append(t)
            else:
                return None
        while signs:
            apply()
        return values[0] if len(values) == 1 else None
    except (IndexError, ZeroDivisionError, KeyError):
        return None


def resolve_parameter(uses: DataFrame, params: DataFrame) -> DataFrame:
    """The parameter a use (pver_id, file_id, fn, symbol) means: of its own function if there is one, else the first of the file."""
    cand = uses.join(params.select(*FILE, "symbol", F.col("fn").alias("owner"), "place", "datatype"), [*FILE, "symbol"])
    return cand.groupBy(*FILE, "fn", "symbol").agg(F.min(F.struct((F.col("owner") != F.col("fn")).alias("other"), "owner", "place", "datatype")).alias("p")).select(*FILE, "fn", "symbol", "p.owner", "p.datatype")


def typedef_dims(decls: DataFrame, typedefs: DataFrame) -> DataFrame:
    """Dims that come from a declaration's type: its last word that names an array typedef of the file."""
    words = decls.select(*LINE, "symbol", F.posexplode(F.split("datatype", r"\s+")).alias("at", "name"))
    return words.join(typedefs, [*FILE, "name"]).groupBy(*LINE, "symbol").agg(F.max_by("dims", "at").alias("dims"))


def attach_snippets(records: DataFrame, functions: DataFrame, lines: DataFrame, reach: int = 256) -> DataFrame:
    """For each record (pver_id, file_id, fn) the lines of that function, from its name to its last bracket.

    Each function that is asked for is put together once. Its lines are met by an interval join: stretches of reach lines are the
    keys, so a line meets only functions of its stretch, and no file's text travels.
    """
    asked = records.withColumn("bare", S.bare_fn(F.col("fn")))
    spans = functions.where("defined").select(*FILE, F.col("fn").alias("bare"), F.col("sig_line").alias("from_line"), F.col("end_line").alias("to_line"))
    wanted = spans.join(asked.select(*FILE, "bare"), [*FILE, "bare"], "left_semi").distinct()
    part = lambda c: F.floor(F.col(c) / reach)
    cut = wanted.withColumn("part", F.explode(F.sequence(part("from_line"), part("to_line"))))
    own = lines.select(*FILE, "line_no", "text", part("line_no").alias("part"))
    met = cut.join(own, [*FILE, "part"]).where("line_no between from_line and to_line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    snippets = met.groupBy(*FILE, "bare", "from_line", "to_line").agg(text.alias("snippet"))
    return asked.join(snippets, [*FILE, "bare"]).select(*FILE, "fn", "from_line", "to_line", "snippet")


def underlined_variable(blocks: DataFrame) -> DataFrame:
    """What of `raw` stands over the first run of ~ in `underline`; null without one."""
    at, run = F.instr("underline", "~"), F.length(F.regexp_extract("underline", r"~+", 0))
    return blocks.withColumn("variable", F.when(at > 0, F.trim(F.substring(F.col("raw"), at, run))))


# The form of an assignment (by any operator, perhaps through a pointer or to an element), and of a taken address.
ASSIGNED = r"(?<![\w.>])(?:\*\s*)?([A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\s*(?:[-+*/%&|^]|<<|>>)?=(?!=)(?=([^;]*))"
GIVEN = r"&\s*([A-Za-z_]\w*)"


def _called(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CALL), 1), lambda x: F.regexp_replace(x, r"\W", ""))


def extract_assignments(functions: DataFrame) -> DataFrame:
    """Assignments in bodies, by place: what is set (lhs), the names on the right side that are not called, and the functions called there.

    Every assignment counts: behind a condition, inside another one, by any operator; its right side goes up to the next `;`, over lines.
    A statement that takes addresses is a row without lhs: the names given away, and all its calls.
    """
    body = functions.where("defined").select(*FILE, "fn", "body")
    sides = F.arrays_zip(F.regexp_extract_all("body", F.lit(ASSIGNED), 1).alias("lhs"), F.regexp_extract_all("body", F.lit(ASSIGNED), 2).alias("rhs"))
    none = F.array().cast("array<string>")
    rhs = F.col("s.rhs")
    members = F.regexp_extract_all(rhs, F.lit(r"->\s*([A-Za-z_]\w*)"), 1)
    names = F.array_except(F.array_except(S.index_tokens(rhs), _called(rhs)), members)
    set_ = body.select(*FILE, "fn", F.posexplode(sides).alias("at", "s")).select(*FILE, "fn", "at", F.col("s.lhs").alias("lhs"), names.alias("names"), _called(rhs).alias("calls"), none.alias("given"), none.alias("all_calls"))
    taken = body.select(*FILE, "fn", F.posexplode(F.split("body", r"[;{}]")).alias("at", "s")).where(F.col("s").rlike(GIVEN))
    return many(set_.unionByName(taken.select(*FILE, "fn", "at", F.lit(None).cast("string").alias("lhs"), none.alias("names"), none.alias("calls"), F.regexp_extract_all("s", F.lit(GIVEN), 1).alias("given"), _called(F.col("s")).alias("all_calls"))))


def definition_uses(assignments: DataFrame, params: DataFrame) -> DataFrame:
    """The edges (pver_id, file_id, fn, name, source, place) from a name to each name it is set from, once, by its first place; a parameter has none."""
    at = F.col("at") if "at" in assignments.columns else F.lit(0)
    pairs = assignments.where("lhs is not null").select(*FILE, "fn", F.col("lhs").alias("name"), at.alias("at"), F.posexplode("names").alias("i", "source")).where("name <> source")
    first = pairs.groupBy(*FILE, "fn", "name", "source").agg(F.min(F.struct("at", "i")).alias("place"))
    return first.join(params.select(*FILE, "fn", F.col("symbol").alias("name")).distinct(), [*FILE, "fn", "name"], "left_anti")


def _followed(starts: DataFrame, assignments: DataFrame, params: DataFrame, limit: int) -> DataFrame:
    """(pver_id, file_id, fn, token, name, n): the names an index comes from, itself first, in order of discovery, at most limit of them.

    Breadth first over the definition-use edges, all indices at once: a round joins only the names of the last one, and drops those
    found before. Each round finds a name more for every index that goes on, so limit rounds are enough (a search ends once it has passed 40 names).
    """
    key = [*FILE, "fn", "token"]
    edges = many(checkpoint(definition_uses(assignments, params)))
    seen = frontier = checkpoint(starts.select(*key).distinct().select(*key, F.col("token").alias("name"), F.lit(0).alias("depth"), F.lit(0).alias("rank")))
    for depth in range(1, limit):
        step = frontier.join(edges, [*FILE, "fn", "name"]).groupBy(*key, F.col("source").alias("name")).agg(F.min(F.struct("rank", "place")).alias("found"))
        fresh = step.join(many(seen.select(*key, "name")), [*key, "name"], "left_anti")
        frontier = checkpoint(fresh.select(*key, "name", F.lit(depth).alias("depth"), F.row_number().over(Window.partitionBy(*key).orderBy("found")).alias("rank")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    place = F.row_number().over(Window.partitionBy(*key).orderBy("depth", "rank")) - 1
    return many(seen.select(*key, "name", place.alias("n")).where(F.col("n") < limit))


def index_origin(starts: DataFrame, assignments: DataFrame, params: DataFrame, decls: DataFrame, functions: DataFrame, limit: int = 41) -> DataFrame:
    """Where an index (pver_id, file_id, fn, token) comes from: followed back over assignments, parameter beats global beats local.

    A parameter ends its branch; a name that is not declared inside the function is global and is still followed.
    """
    key = [*FILE, "fn", "token"]
    names = _followed(starts, assignments, params, limit)
    p = params.select(*FILE, "fn", F.col("symbol").alias("name"), F.lit(True).alias("is_param")).distinct()
    d = _declared_inside(decls, functions).select(*FILE, "fn", F.col("symbol").alias("name"), F.lit(True).alias("declared")).distinct()
    known = names.join(p, [*FILE, "fn", "name"], "left").join(d, [*FILE, "fn", "name"], "left")
    agg = known.groupBy(*key).agg(F.bool_or(F.coalesce("is_param", F.lit(False))).alias("p"), F.bool_or(F.coalesce("is_param", "declared").isNull()).alias("g"), F.count("*").alias("n_names"))
    return agg.select(*key, F.when(F.col("p"), "parameter").when(F.col("g"), "global").otherwise("local").alias("origin"), "n_names")


def _declared_inside(decls: DataFrame, functions: DataFrame) -> DataFrame:
    """Declarations (pver_id, file_id, line_no, symbol) inside bodies, with the function (fn), by one sort of a file's lines."""
    spans = functions.where("defined").select(*FILE, "fn", "start_line", "end_line")
    return many(_with_span(decls.select(*LINE, "symbol"), spans)).where("near is not null").select(*LINE, "symbol", F.col("near.fn").alias("fn"))


def value_origins(starts: DataFrame, assignments: DataFrame, functions: DataFrame, params: DataFrame, path_fns: DataFrame | None = None, cap: int = 6, limit: int = 41) -> DataFrame:
    """The project's functions that an index (pver_id, file_id, fn, token) comes from: called on the right side of assignments to it or
    to a name it comes from, or given the address of one; in order of discovery, the first cap.

    path_fns: (pver_id, file_id, fn, caller, pos), the functions on the paths to fn; what sets the token itself there follows, unless it is on a path, too.
    """
    key = [*FILE, "fn", "token"]
    names = _followed(starts, assignments, params, limit)
    names = names.join(params.select(*FILE, "fn", F.col("symbol").alias("name")).distinct(), [*FILE, "fn", "name"], "left_anti")
    every = _set_by(many(names).join(assignments, [*FILE, "fn"]), key, 0)
    if path_fns is not None:
        asked = starts.select(*key).distinct().join(path_fns, [*FILE, "fn"]).select(*key, "caller", F.col("pos").alias("n"), F.col("token").alias("name"))
        callers = _set_by(asked.join(assignments.withColumnRenamed("fn", "caller"), [*FILE, "caller"]), key, 1)
        every = every.unionByName(callers.join(path_fns.select(*FILE, "fn", F.col("caller").alias("callee")), [*FILE, "fn", "callee"], "left_anti"))
    defined = functions.where("defined").select("pver_id", F.col("fn").alias("callee")).distinct()
    first = every.join(defined, ["pver_id", "callee"], "left_semi").groupBy(*key, "callee").agg(F.min("r").alias("r"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("r", "callee")))
    return ranked.where(F.col("place") <= cap).select(*key, "callee", "place")


def _set_by(rows: DataFrame, key: list[str], stage: int) -> DataFrame:
    """(key, callee, r) of the calls in statements that set name, or take its address; r is their order."""
    calls = lambda c, kind: F.transform(c, lambda x, i: F.struct(F.struct(F.lit(stage).alias("stage"), F.col("n").cast("int").alias("n"), F.lit(kind).alias("kind"), F.col("at").cast("int").alias("at"), i.cast("int").alias("i")).alias("r"), x.alias("callee")))
    none = F.filter(calls("calls", 0), lambda x: F.lit(False))
    made = F.when(F.col("lhs") == F.col("name"), calls("calls", 0)).otherwise(none)
    filled = F.when(F.array_contains("given", F.col("name")), calls("all_calls", 1)).otherwise(none)
    return rows.select(*key, F.explode(F.concat(made, filled)).alias("c")).select(*key, "c.callee", "c.r")


def _names(text, name):
    """Whether a text holds a name as a whole word."""
    return F.regexp_like(text, F.concat(F.lit(r"\b"), name, F.lit(r"\b")))


def fix_index_symbols(symbols: DataFrame, tokens: DataFrame, params: DataFrame, decls: DataFrame, functions: DataFrame) -> DataFrame:
    """Symbols (pver_id, file_id, fn, symbol, line_no) of an alarm's function, with index tokens (pver_id, file_id, fn, token) re-pointed.

    A token's declaration is the function's parameter of that name, else its first local one; where there is none the symbol stays as
    it is. Tokens that the symbols lack are added with the declaration found. `change` says which: kept, re-pointed or added.
    """
    spans = functions.where("defined").select(*FILE, "fn", "sig_line", "start_line", "end_line")
    local = _declared_inside(decls, functions).select(*FILE, "fn", F.col("symbol").alias("token"), F.struct(F.lit(1).alias("rank"), F.col("line_no").alias("line")).alias("at"))
    own = params.select(*FILE, "fn", F.col("symbol").alias("token")).join(spans, [*FILE, "fn"]).select(*FILE, "fn", "token", F.struct(F.lit(0).alias("rank"), F.col("sig_line").alias("line")).alias("at"))
    found = many(local.unionByName(own)).join(tokens.distinct(), [*FILE, "fn", "token"], "left_semi").groupBy(*FILE, "fn", "token").agg(F.min("at").alias("at"))
    both = symbols.join(many(found).withColumnRenamed("token", "symbol"), [*FILE, "fn", "symbol"], "full")
    change = F.when(F.col("line_no").isNull() & F.col("at").isNotNull(), "added").when(F.col("at.line") != F.col("line_no"), "re-pointed").otherwise("kept")
    scope = F.when(F.col("at.rank") == 0, "parameter").when(F.col("at.rank") == 1, "local")
    return both.select(*FILE, "fn", "symbol", F.coalesce("at.line", "line_no").alias("line_no"), scope.alias("scope"), change.alias("change"))


def normalize_facts(raw: DataFrame, alarms: DataFrame, lines: DataFrame, allowed: list[str] = ALLOWED, bounds: list[str] = BOUNDS) -> DataFrame:
    """Outside facts (pver_id, file_id, line_no, kind, quote, symbol) on one alarm (array, alarm_line, tokens, relevant) a file.

    The line becomes the nearest that holds the quote, or the fact goes. Facts whose line names nothing relevant go, too. An alarm_site
    elsewhere is an access or a fact; a write must set its symbol or an index token, else it is a read or a fact; a call edge needs a
    bracket; a bound needs a guard, an empty dimension or sizeof. Plain facts and reads stay only if they name a token or the array.
    """
    asked = raw.where("trim(quote) <> '' and line_no is not null").withColumn("quote", F.trim("quote"))
    at = verify_quotes(asked.select(*LINE, "quote").distinct(), lines).where("found_line is not null").select(*LINE, "quote", "found_line")
    own = asked.join(many(at), [*LINE, "quote"]).join(alarms, FILE).join(lines.select(*FILE, F.col("line_no").alias("found_line"), "text"), [*FILE, "found_line"])
    text, given = F.col("text"), F.lower(F.trim(F.coalesce("kind", F.lit("fact"))))
    kind = F.when(given.isin(allowed), given).otherwise("fact")
    token_here, array_here = F.exists("tokens", lambda t: _names(text, t)), F.coalesce(_names(text, F.col("array")), F.lit(False))
    written = F.when(S.is_lhs_write(text, F.col("symbol")), F.col("symbol")).otherwise(F.get(F.filter("tokens", lambda t: S.is_lhs_write(text, t)), F.lit(0)))
    base = own.where(F.exists("relevant", lambda t: _names(text, t))).withColumn("symbol", F.when(_names(text, F.col("symbol")), F.col("symbol")))
    one = base.withColumns({"given": kind, "written": written})
    bracket = F.coalesce(F.regexp_like(text, F.concat(F.lit(r"\b"), F.col("array"), F.lit(r"\s*\["))), F.lit(False))
    new = (
        F.when((F.col("given") == "alarm_site") & ~F.coalesce(F.col("found_line") == F.col("alarm_line"), F.lit(False)), F.when(bracket, "access").otherwise("fact"))
        .when((F.col("given") == "write") & F.col("written").isNull(), F.when(token_here, "read").otherwise("fact"))
        .when((F.col("given") == "call_edge") & ~text.contains("("), "fact")
        .when(F.col("given").isin(bounds) & ~S.is_guard(text, S.MINED_GUARD) & ~text.rlike(r"\[\s*\]|\bsizeof\b"), "fact")
        .otherwise(F.col("given"))
    )
    done = one.withColumn("kind", new).withColumn("symbol", F.when(F.col("kind") == "write", F.col("written")).otherwise(F.col("symbol")))
    kept = done.where(~F.col("kind").isin("fact", "read") | token_here | array_here)
    quote = F.when(F.length("quote") < 8, F.substring(F.trim(text), 1, 300)).otherwise(F.substring("quote", 1, 300))
    return kept.select(*FILE, F.col("found_line").alias("line_no"), "kind", quote.alias("quote"), "symbol")


def seed_facts(decls: DataFrame, sizes: DataFrame, alarms: DataFrame, guards: DataFrame, lines: DataFrame) -> DataFrame:
    """X11: the facts known before any search: declarations, size hints, alarm sites and local guards, each with its line as the quote."""
    pick = lambda df, kind, symbol: df.select(*LINE, F.lit(kind).alias("kind"), symbol.alias("symbol"))
    seeds = pick(decls, "declaration", F.col("symbol")).unionByName(pick(sizes, "array_size_hint", F.col("symbol"))).unionByName(pick(alarms, "alarm_site", F.col("array"))).unionByName(pick(guards, "local_guard", F.col("token")))
    return seeds.distinct().join(lines.select(*LINE, "text"), LINE).select(*LINE, "kind", "symbol", S.collapse_ws(F.col("text")).alias("quote"))


def symbol_key_lines(occ: DataFrame, decls: DataFrame, alarms: DataFrame) -> DataFrame:
    """The lines (pver_id, file_id, symbol, line) a symbol's package is made around: its occurrences, among them writes and guards, its declaration, and the line of an alarm whose array or index it is."""
    at = alarms.select(*FILE, "line_no", F.explode(F.array("array", "index")).alias("symbol"))
    every = [df.select(*FILE, "symbol", F.col("line_no").cast("int").alias("line")) for df in (occ, decls, at)]
    return every[0].unionByName(every[1]).unionByName(every[2]).where("symbol is not null and line is not null").distinct()


def symbol_packages(centers: DataFrame, lines: DataFrame, radius: int = 3, clip: int = 24_000) -> DataFrame:
    """For each symbol the numbered lines around its key lines (pver_id, file_id, symbol, line): windows merged, a blank line between them, cut at clip characters."""
    key = [*FILE, "symbol"]
    wanted = merge_windows(centers, key, radius).select(*key, "start_line", F.explode(F.sequence("start_line", "end_line")).alias("line_no"))
    own = wanted.join(lines.select(*LINE, "text"), LINE)
    joined = lambda rows, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rows, "text"))), lambda x: x["text"]), sep)
    numbered = own.select(*key, "start_line", "line_no", F.concat(F.col("line_no").cast("string"), F.lit(": "), "text").alias("text"))
    windows = numbered.groupBy(*key, "start_line").agg(F.count("*").alias("n"), joined("line_no", "\n").alias("text"))
    return windows.groupBy(*key).agg(F.sum("n").alias("n_lines"), F.substring(joined("start_line", "\n\n"), 1, clip).alias("package"))
