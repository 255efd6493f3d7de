"""Occurrences of symbols, functions around lines, declarations and constants. Lines are (pver_id, file_id, line_no, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

FILE = ["pver_id", "file_id"]
LINE = [*FILE, "line_no"]


def line_tokens(lines: DataFrame) -> DataFrame:
    """Each identifier at each place: its column (from 1), what stands before and what after; the lines' other columns stay.

    A line is cut into pieces once, running offsets keep the identifiers' columns, and only these are exploded; what stands before
    and after is cut from the line for what is left.
    """
    pieces = F.regexp_extract_all("text", F.lit(r"([A-Za-z_]\w*|\d\w*|[^\sA-Za-z_\d]+|\s+)"), 1)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<symbol:string,at:int>>").alias("found"))
    named = lambda p: p.rlike(r"^[A-Za-z_]") & ~p.isin(S.KEYWORDS)
    step = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.when(named(p), F.array_append(acc["found"], F.struct(p.alias("symbol"), acc["at"].alias("at")))).otherwise(acc["found"]).alias("found"))
    found = lines.select("*", F.explode(F.aggregate(pieces, start, step, lambda acc: acc["found"])).alias("t"))
    size, at = F.length("t.symbol"), F.col("t.at")
    told = found.withColumns({"symbol": F.col("t.symbol"), "before": F.substring(F.col("text"), F.lit(1), at - 1), "col_start": at, "col_end": at + size, "after": F.expr("substring(text, t.at + length(t.symbol))")})
    return told.drop("t")


def wanted_tokens(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tokens of wanted symbols. Spark broadcasts wanted if it is small by its measured size."""
    return tokens.join(wanted, "symbol", "left_semi")


def occurrences(lines: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Every occurrence with its access and, if functions are given, the function it is in (fn); a type name right before makes it a declaration."""
    tokens = line_tokens(lines.select(*LINE, "text") if functions is None else lines_in_functions(lines.select(*LINE, "text"), functions))
    declared = F.col("before").rlike(r"^\s*(?:(?:static|const|extern)\s+)*[A-Za-z_]\w*\s+\**$") & ~F.col("before").rlike(r"^\s*return\b") & ~F.col("after").rlike(r"^\s*\(")
    called = F.col("after").rlike(r"^\s*\(")
    callee = F.regexp_extract(S.open_call(F.col("before")), r"([A-Za-z_]\w*)\s*\([^()]*$", 1)
    access = S.access_kind(F.col("text"), F.col("before"), F.col("after"), declared)
    typed = F.col("after").rlike(r"^\s+\**[A-Za-z_]") & (F.trim("before") == "")
    own = [] if functions is None else ["fn"]
    return tokens.where(~called & ~typed).select(*LINE, "symbol", "col_start", "col_end", access.alias("access"), F.when(access.isin("parameter", "address"), callee).alias("callee"), F.col("text").alias("line_text"), *own)


def access_counts(occ: DataFrame) -> DataFrame:
    """One column per access."""
    kinds = ["declaration", "address", "write", "parameter", "read"]
    return occ.groupBy("pver_id", "symbol").agg(*[F.count_if(F.col("access") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("occurrence_count"))


def used_in(occ: DataFrame) -> DataFrame:
    """The functions of a symbol's occurrences (with fn), numbered in first-seen order."""
    first = occ.groupBy("pver_id", "symbol", "file_id", "fn").agg(F.min(F.struct("line_no", "col_start")).alias("first"))
    place = F.row_number().over(Window.partitionBy("pver_id", "symbol").orderBy("file_id", "first"))
    return first.select("pver_id", "symbol", place.alias("place"), "file_id", "fn")


def passed_to(occ: DataFrame) -> DataFrame:
    """Distinct (callee, place, mode) of occurrences given to a function by value or by address."""
    given = occ.where("access in ('parameter', 'address') and callee <> ''")
    mode = F.when(F.col("access") == "address", "address").otherwise("value")
    return given.select("pver_id", "symbol", "callee", "file_id", "line_no", mode.alias("mode")).distinct()


def function_rows(occ: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Uses of a symbol per function and the kinds of access there; functions that are only listed (pver_id, symbol, file_id, fn) count once."""
    keys = ["pver_id", "symbol", "file_id", "fn"]
    rows = occ.groupBy(*keys).agg(F.count("*").alias("uses"), F.array_join(F.array_sort(F.collect_set("access")), ",").alias("accesses"))
    if listed is None:
        return rows
    more = listed.select(*keys).distinct().join(rows, keys, "left_anti").select(*keys, F.lit(1).cast("long").alias("uses"), F.lit("").alias("accesses"))
    return rows.unionByName(more)


def access_filter(rows: DataFrame, mode: str) -> DataFrame:
    """Of function rows all, with_read or without_read."""
    reads = F.array_contains(F.split("accesses", ","), "read")
    return rows if mode == "all" else rows.where(reads if mode == "with_read" else ~reads)


def sample_occurrences(occ: DataFrame, n: int = 80) -> DataFrame:
    """All of a symbol's occurrences up to n; above, the first and the last n / 2. Counts stay complete."""
    keys = Window.partitionBy("pver_id", "symbol")
    order = keys.orderBy("file_id", "line_no", "col_start")
    ranked = occ.withColumns({"rn": F.row_number().over(order), "total": F.count("*").over(keys)})
    half = n // 2
    return ranked.where((F.col("total") <= n) | (F.col("rn") <= half) | (F.col("rn") > F.col("total") - half))


#: Lines of a file that are worked on together where running sums over files are needed.
STRETCH = 4096


def function_ranges(lines: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Runs of lines between a brace opened at depth 0 and the line that closes it; runs left open end with the file.

    A scan in two levels, so that a file is no single task: each stretch of lines is summed up by its net depth and its least one, these few
    rows are scanned by file, and then all stretches run at the same time from where the one before ends. A closing brace without
    an opening one would leave the depth below zero: depth counts from the lowest point so far.
    """
    opens = F.length(F.regexp_replace("text", r"[^{]", "")) - F.length(F.regexp_replace("text", r"[^}]", ""))
    part = [*FILE, "part"]
    own = lines.select(*LINE, "text", opens.alias("opens"), F.floor(F.col("line_no") / stretch).alias("part"))
    within = Window.partitionBy(*part).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = own.withColumn("net", F.sum("opens").over(within))
    before = Window.partitionBy(*FILE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = summed.groupBy(*part).agg(F.sum("opens").alias("net"), F.min("net").alias("low"))
    based = parts.withColumn("base", F.coalesce(F.sum("net").over(before), F.lit(0)))
    based = based.select(*part, "base", F.coalesce(F.min(F.col("base") + F.col("low")).over(before), F.lit(0)).alias("floor"))
    depth = summed.join(based, part).withColumn("d", F.col("base") + F.col("net"))
    depth = depth.withColumn("depth", F.col("d") - F.least(F.lit(0), F.col("floor"), F.min("d").over(within)))
    edges = depth.groupBy(*part).agg(F.max_by("depth", "line_no").alias("last"))
    entry = edges.select(*part, F.coalesce(F.lag("last").over(Window.partitionBy(*FILE).orderBy("part")), F.lit(0)).alias("entry"))
    marked = depth.join(entry, part).withColumn("before", F.coalesce(F.lag("depth").over(Window.partitionBy(*part).orderBy("line_no")), "entry"))
    marked = marked.withColumn("starts", ((F.col("before") == 0) & (F.col("depth") > 0)).cast("int")).withColumn("here", F.sum("starts").over(within))
    begun = marked.groupBy(*part).agg(F.sum("starts").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    bodies = marked.where((F.col("depth") > 0) | (F.col("before") > 0)).join(begun, part).withColumn("body", F.col("earlier") + F.col("here"))
    return bodies.groupBy(*FILE, "body").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min_by("text", "line_no").alias("sig_text"))


def _with_span(points: DataFrame, functions: DataFrame) -> DataFrame:
    """points with near, the span (start_line, end_line, fn) around each, null when none, by one sort per file instead of a range join.

    Starts and points are ordered together; a point takes the last start before it if that body has not ended.
    """
    rest = [c for c in points.columns if c not in LINE]
    name = F.col("fn") if "fn" in functions.columns else F.concat(F.lit("body_"), F.col("body"))
    starts = functions.select(*FILE, F.col("start_line").cast("long").alias("line_no"), F.lit(0).alias("side"), F.struct("start_line", "end_line", name.alias("fn")).alias("span"))
    asked = points.select(*FILE, F.col("line_no").cast("long").alias("line_no"), F.lit(1).alias("side"), F.lit(None).cast(starts.schema["span"].dataType).alias("span"), *rest)
    before = F.last("span", ignorenulls=True).over(Window.partitionBy(*FILE).orderBy("line_no", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = starts.unionByName(asked, allowMissingColumns=True).withColumn("near", before).where("side = 1")
    return placed.select(*FILE, F.col("line_no").cast(points.schema["line_no"].dataType).alias("line_no"), *rest, F.when(F.col("near.end_line") >= F.col("line_no"), F.col("near")).alias("near"))


def lines_in_functions(points: DataFrame, functions: DataFrame) -> DataFrame:
    """Points (pver_id, file_id, line_no, more) with fn, the function (fn, else the number of the body) around them; `global` when none."""
    return _with_span(points, functions).withColumn("fn", F.coalesce("near.fn", F.lit("global"))).drop("near")


def enclosing_function(points: DataFrame, functions: DataFrame) -> DataFrame:
    """The body around each point (pver_id, file_id, line_no)."""
    return lines_in_functions(points.select(*LINE), functions)


def nearest_span(refs: DataFrame, functions: DataFrame) -> DataFrame:
    """Of the spans (fn, start_line, end_line, body) that have a reference's name (fn), the one whose middle is nearest to its line; the first on a tie.

    Middles and references of a file and name are ordered together, so each reference looks at one middle before and one after it.
    """
    keys = [*FILE, "fn"]
    middle = F.floor((F.col("start_line") + F.col("end_line")) / 2)
    spans = functions.select(*keys, middle.cast("long").alias("line_no"), F.lit(0).alias("side"), F.struct(middle.cast("long").alias("middle"), "body").alias("span"))
    asked = refs.select(*keys, F.col("line_no").cast("long").alias("line_no"), F.lit(1).alias("side"), F.lit(None).cast(spans.schema["span"].dataType).alias("span"))
    order = Window.partitionBy(*keys).orderBy("line_no", "side")
    both = spans.unionByName(asked).withColumns({
        "low": F.last("span", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "high": F.first("span", ignorenulls=True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    }).where("side = 1")
    nearer = F.col("high").isNotNull() & (F.col("low").isNull() | (F.col("high.middle") - F.col("line_no") < F.col("line_no") - F.col("low.middle")))
    return both.select(*LINE, "fn", F.when(nearer, F.col("high.body")).otherwise(F.col("low.body")).alias("body")).where("body is not null")


def extract_constants(lines: DataFrame, keys: tuple[str, ...] = ("pver_id",)) -> DataFrame:
    """The first integer per keys (project, or file) that a #define gives a name, or that a name is set to on a line that is no directive, as in enums."""
    define = r"^\s*#\s*define\s+([A-Za-z_]\w*)\s+\(?\s*([+-]?\d+)"
    set_to = r"\b([A-Za-z_]\w*)\s*=\s*([+-]?\d+)"
    every = lambda i: F.regexp_extract_all("text", F.lit(set_to), i)
    own = F.when(F.col("text").rlike(define), F.array(F.struct(F.regexp_extract("text", define, 1).alias("name"), F.regexp_extract("text", define, 2).alias("value"))))
    pairs = own.when(~F.col("text").rlike(r"^\s*#"), F.arrays_zip(every(1).alias("name"), every(2).alias("value")))
    found = lines.select(*LINE, F.posexplode(pairs).alias("at", "c")).withColumn("value", F.col("c.value").try_cast("long")).where("value is not null")
    return found.groupBy(*keys, F.col("c.name").alias("name")).agg(F.min_by("value", F.struct("file_id", "line_no", "at")).alias("value"))


def constant_values(names: DataFrame, constants: DataFrame) -> DataFrame:
    """The value of a name, or of the name without its ___hex suffix."""
    bare = names.withColumn("bare", F.regexp_replace("name", r"___[0-9a-fA-F]{4,}$", ""))
    own = constants.select("pver_id", "name", F.col("value").alias("v1"))
    short = constants.select("pver_id", F.col("name").alias("bare"), F.col("value").alias("v2"))
    return bare.join(own, ["pver_id", "name"], "left").join(short, ["pver_id", "bare"], "left").select("pver_id", "name", F.coalesce("v1", "v2").alias("value"))


def resolve_declaration(uses: DataFrame, decls: DataFrame) -> DataFrame:
    """Of a name's declarations in the file of a use (start_line, end_line of its function, null outside; tokens, its context): those in
    its function if there are any; of these the ones not after it if any; then, if several are left and there are tokens, the best score; the last line.

    A score has 1 for dims, 1 for a struct's member, 5 for each token that is a piece of type or text, 4 for each that is in the owner's name.
    A sweep: declarations and uses of a name and context are ordered together by line, and the best so far is kept for the file and for
    each function, so that uses and declarations never meet in pairs. Declarations meet only the different contexts of their name.
    """
    return declarations_in_context(uses, decls).select(*FILE, "symbol", "line_no", "score", "d_line", "datatype", "dims", "owner", "d_text")


def declarations_in_context(uses: DataFrame, decls: DataFrame) -> DataFrame:
    """J05 with the context (tokens, empty for null) of each answer: uses of one name and line may have several."""
    d = decls.select(*FILE, "symbol", F.col("line_no").alias("d_line"), "datatype", "d_text", "dims", "owner")
    asked = uses.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    spans = asked.where("start_line is not null").select(*FILE, "start_line", "end_line").distinct().withColumn("body", F.col("start_line"))
    placed = _with_span(d.withColumn("line_no", F.col("d_line")), spans).select(*FILE, "symbol", "d_line", "datatype", "d_text", "dims", "owner", F.col("near.start_line").alias("start_line"))
    each = placed.join(asked.select(*FILE, "symbol", "tokens").distinct(), [*FILE, "symbol"])
    pieces, low = S.ident_pieces(F.col("datatype"), F.col("d_text")), F.transform("tokens", lambda t: F.lower(t))
    hits = F.size(F.filter(low, lambda t: (t != "") & F.array_contains(pieces, t)))
    owned = F.size(F.filter(low, lambda t: (t != "") & F.lower(F.coalesce("owner", F.lit(""))).contains(t)))
    score = (F.col("dims") != "").cast("int") + F.col("owner").isNotNull().cast("int") + 5 * hits + 4 * owned
    told = F.struct(F.when(F.size("tokens") > 0, score).otherwise(0).alias("score"), F.col("d_line"), F.col("datatype"), F.col("dims"), F.col("owner"), F.col("d_text"))
    given = each.select(*FILE, "symbol", "tokens", "start_line", F.col("d_line").cast("long").alias("at"), F.lit(0).alias("side"), told.alias("d"))
    wanted = asked.select(*FILE, "symbol", "tokens", "start_line", F.col("line_no").cast("long").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(given.schema["d"].dataType).alias("d")).distinct()
    of = [*FILE, "symbol", "tokens"]
    best = lambda keys, rows: F.max("d").over(rows(Window.partitionBy(*keys).orderBy("at", "side")))
    so_far, all_ = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow), lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inside = F.col("start_line").isNotNull()
    found = given.unionByName(wanted).withColumn("d", F.coalesce(
        "d", F.when(inside, best([*of, "start_line"], so_far)), F.when(inside, best([*of, "start_line"], all_)), best(of, so_far), best(of, all_),
    )).where("side = 1 and d is not null")
    return found.select(*FILE, "symbol", F.col("at").cast(uses.schema["line_no"].dataType).alias("line_no"), "tokens", "d.score", "d.d_line", "d.datatype", "d.dims", "d.owner", "d.d_text")


# Names in an index that no guard is looked for, and what bounds an index by a literal.
UNGUARDED = ["Mo_Inst_GetCoreIdx", "sizeof"]
LITERAL_BOUND = r"<\s*=?\s*\d+|&\s*0x[0-9A-Fa-f]+|%\s*\d+"


def local_guard(alarms: DataFrame, functions: DataFrame, lines: DataFrame) -> DataFrame:
    """The first guard from the start of an alarm's function to its line that names one of the first six identifiers of its index
    (any guard if there are none) and holds the array size, or a literal bound, mask or modulo.

    alarms: (pver_id, file_id, line_no, index, array_size). Guards meet the distinct (index, size) of their own function only.
    """
    at = [*FILE, "start_line"]
    inside = lambda df: _with_span(df, functions).where("near is not null").withColumn("start_line", F.col("near.start_line")).drop("near")
    asked = inside(alarms.select(*LINE, "index", "array_size"))
    names = F.slice(F.filter(F.regexp_extract_all("index", F.lit(r"([A-Za-z_]\w*)"), 1), lambda t: ~t.isin(UNGUARDED)), 1, 6)
    wanted = asked.groupBy(*at, "index", "array_size").agg(F.max("line_no").alias("last")).withColumn("names", F.coalesce(names, F.array().cast("array<string>")))
    guards = inside(lines.select(*LINE, "text").where(S.is_guard(F.col("text")))).withColumnsRenamed({"line_no": "guard_line", "text": "guard_text"})
    both = guards.join(wanted, at).where("guard_line <= last")
    named = (F.size("names") == 0) | F.exists("names", lambda t: F.col("guard_text").contains(t))
    bounded = F.coalesce(S.collapse_ws(F.col("guard_text")).contains(F.col("array_size").cast("string")), F.lit(False)) | F.col("guard_text").rlike(LITERAL_BOUND)
    first = both.where(named & bounded).groupBy(*at, "index", "array_size").agg(F.min(F.struct("guard_line", "guard_text")).alias("g"))
    same = [F.col("a.pver_id") == F.col("f.pver_id"), F.col("a.file_id") == F.col("f.file_id"), F.col("a.start_line") == F.col("f.start_line"), F.col("a.index").eqNullSafe(F.col("f.index")), F.col("a.array_size").eqNullSafe(F.col("f.array_size"))]
    hit = asked.alias("a").join(first.alias("f"), same).where("f.g.guard_line <= a.line_no")
    return hit.select(*[f"a.{c}" for c in LINE], "a.index", "a.array_size", "f.g.guard_line", F.trim("f.g.guard_text").alias("guard_text"))


def line_context(lines: DataFrame) -> DataFrame:
    """A line with the two before it and the one after. Neighbours come by equal line numbers, so a file is no single task; numbers without a gap are needed."""
    near = lines.select(*FILE, F.posexplode(F.array(*[F.col("line_no") + d for d in (0, 1, 2, -1)])).alias("place", "line_no"), "text")
    of = lambda i: F.max(F.when(F.col("place") == i, F.col("text")))
    return near.groupBy(*LINE).agg(F.bool_or(F.col("place") == 0).alias("own"), F.concat_ws("\n", of(2), of(1), of(0)).alias("lookback"), of(3).alias("next_text")).where("own").drop("own")


def cite_lines(lines: DataFrame, focus: list[str] | None = None, cap: int = 36, keys: list[str] = FILE) -> DataFrame:
    """Per keys (a function's or file's lines) those that name a focus token, or without focus those of high signal; over cap the ones with a bracket, if, < or sizeof first; place is the line order of what is left."""
    text = S.strip_line(F.col("text"))
    kept = lines.withColumn("text", text).where(~S.is_noise(F.col("text")))
    if focus:
        kept = kept.where(F.col("text").rlike(r"\b(" + "|".join(focus) + r")\b"))
    else:
        kept = kept.where(~F.col("text").rlike(r"^(break|continue);?$") & F.col("text").rlike(r"\[|if|while|for|switch|return|case|="))
    bounds = (~F.col("text").rlike(r"\[|if|<|>|sizeof")).cast("int")
    w = Window.partitionBy(*keys)
    ranked = kept.withColumn("rank", F.row_number().over(w.orderBy(bounds, *[c for c in LINE if c not in keys]))).where(F.col("rank") <= cap)
    return ranked.withColumn("place", F.row_number().over(w.orderBy(*[c for c in LINE if c not in keys]))).drop("rank")


# Fixed value: a statement that copies one numbered element.
COPIED = r"^([\w.]+?)(\d+)\s*=\s*([\w.]+)\s*\[\s*(\d+)\s*\]\s*;?\s*$"


def collapse_indexed_runs(lines: DataFrame) -> DataFrame:
    """Consecutive statements P0 = S[0], P1 = S[1], ... of one prefix and base whose two numbers are equal and count up become one, P[0..k]=S[0..k]; all others stay.

    Runs are islands: within consecutive lines of one shape the number less the line's place is the same.
    """
    m = lambda i: F.regexp_extract("text", COPIED, i)
    shaped = lines.select(*LINE, F.col("text"), m(1).alias("prefix"), m(3).alias("base"), m(2).try_cast("int").alias("n"), m(4).try_cast("int").alias("k"))
    shape = F.when(F.col("n") == F.col("k"), F.struct("prefix", "base"))
    w = Window.partitionBy(*FILE).orderBy("line_no")
    shaped = shaped.withColumn("shape", shape)
    goes_on = F.lag("shape").over(w).eqNullSafe(F.col("shape")) & F.col("shape").isNotNull() & (F.lag("n").over(w) + 1 == F.col("n"))
    runs = shaped.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(w))
    one = runs.groupBy(*FILE, "run").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n_lines"), F.min("n").alias("a"), F.max("n").alias("b"), F.min_by("text", "line_no").alias("text"), F.first("prefix").alias("prefix"), F.first("base").alias("base"))
    both = F.format_string("%s[%d..%d]=%s[%d..%d]", "prefix", "a", "b", "base", "a", "b")
    return one.select(*LINE, "n_lines", F.when(F.col("n_lines") > 1, both).otherwise(F.col("text")).alias("text"))


def compression_stats(lines: DataFrame) -> DataFrame:
    """Characters of all lines, of the normalised lines that are no noise, and their ratio to three places."""
    short = F.when(S.is_noise(F.col("text")), 0).otherwise(F.length(S.normalize_stmt(F.col("text"))))
    return lines.groupBy("pver_id").agg(F.sum(F.length("text")).alias("original"), F.sum(short).alias("compressed")).withColumn("ratio", F.round(F.col("compressed") / F.col("original"), 3))
