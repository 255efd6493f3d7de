"""The enrichment job: alarm groups with their paths, the alarmed access, and all that is known of its symbols.

A symbol is resolved once for each place and context it is asked for, and what is known of the object it means, its occurrences above all,
once for all alarms that mean it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.scratch import checkpoint, many
from .corpus import SPOT, _named, accesses, extract_declarations, extract_defines, extract_functions, extract_parameters, extract_typedefs, resolve_dims, resolve_parameter
from .paths import GROUP, group_ids, path_records, trace_counts
from .symbols import FILE, LINE, STRETCH, _with_span, declarations_in_context, lines_in_functions, occurrences

KINDS = ["declaration", "address", "write", "parameter", "read"]
OBJECT = [*FILE, "symbol", "object"]


def text_lines(texts: DataFrame) -> DataFrame:
    return many(texts.select(*FILE, F.posexplode(F.split("text", "\n")).alias("at", "text")).select(*FILE, (F.col("at") + 1).alias("line_no"), "text"))


def resolve_symbols(access: DataFrame, texts: DataFrame, functions: DataFrame, lines: DataFrame) -> DataFrame:
    """The symbols of each access (X07) in order (place), with their declarations and the object they mean.

    A symbol's declaration is J05's, with the access path as context, else a parameter's. Its dims are its own or its type's, its sizes
    come from the file's constants. Symbols of one declaration and, for members, of the same parents are one object.
    """
    spans = functions.where("defined").select(*FILE, "fn", F.col("sig_line").alias("start_line"), "end_line")
    decls = checkpoint(extract_declarations(texts).join(lines.withColumnRenamed("text", "d_text"), LINE))
    key = [*LINE, "col", "role", "symbol"]
    context = F.coalesce(F.filter(F.split("member_path", r"->|\."), lambda x: x != ""), F.array().cast("array<string>")).alias("tokens")
    asked = _with_span(_named(access).join(access.select(*LINE, "col", "array", "member_path", "index", "dimension", context).distinct(), [*LINE, "col"]), spans)
    asked = asked.select(*key, "place", "array", "index", "dimension", "tokens", F.col("near.start_line").alias("start_line"), F.col("near.end_line").alias("end_line"), F.col("near.fn").alias("fn"))
    found = declarations_in_context(asked.select(*LINE, "symbol", "start_line", "end_line", "tokens").distinct(), decls).drop("score")
    pointers = decls.select(*FILE, "symbol", F.col("line_no").alias("d_line"), "pointer_depth").distinct()
    found = found.join(pointers, [*FILE, "symbol", "d_line"], "left")
    params = extract_parameters(functions)
    named = resolve_parameter(asked.where("fn is not null").select(*FILE, "fn", "symbol").distinct(), params)
    named = named.join(params.select(*FILE, F.col("fn").alias("owner"), "symbol", F.col("dims").alias("p_dims"), F.col("pointer_depth").alias("p_depth")), [*FILE, "owner", "symbol"])
    signed = functions.where("defined").select(*FILE, F.col("fn").alias("owner"), F.col("sig_line").alias("p_line"), F.col("sig_text").alias("p_text"))
    named = named.join(signed, [*FILE, "owner"]).select(*FILE, "fn", "symbol", F.col("datatype").alias("p_type"), "p_dims", "p_depth", "p_line", "p_text", F.col("owner").alias("p_owner"))
    both = asked.join(found, [*LINE, "symbol", "tokens"], "left").join(named, [*FILE, "fn", "symbol"], "left")
    own, given = F.col("d_line").isNotNull(), F.col("p_line").isNotNull()
    pick = lambda d, p: F.when(own, F.col(d)).otherwise(F.col(p))
    typed = both.select(
        *key, "place", "array", "index", "dimension", "tokens", pick("datatype", "p_type").alias("datatype"), pick("dims", "p_dims").alias("own_dims"), F.coalesce(pick("pointer_depth", "p_depth"), F.lit(0)).alias("depth"),
        F.when(own, F.col("owner")).alias("member_of"), F.when(~own, F.col("p_owner")).alias("p_owner"), pick("d_line", "p_line").cast("int").alias("declaration_line"), F.trim(pick("d_text", "p_text")).alias("declaration_text"),
        F.when(own & F.col("owner").isNotNull(), "struct_member").when(own, "variable").when(given, "parameter").otherwise("unknown").alias("declaration_kind"),
    )
    typedefs = extract_typedefs(texts).select(*FILE, F.col("name").alias("datatype"), F.col("dims").alias("type_dims"))
    sized = typed.join(typedefs, [*FILE, "datatype"], "left").withColumn("dims", F.coalesce(F.nullif("own_dims", F.lit("")), "type_dims", F.lit("")))
    sized = sized.join(resolve_dims(sized.select(*FILE, "dims"), extract_defines(texts)), [*FILE, "dims"], "left")
    placed = _with_span(sized.where("declaration_line is not null").select(*FILE, F.col("declaration_line").cast("long").alias("line_no")).distinct(), spans)
    placed = many(placed).select(*FILE, F.col("line_no").cast("int").alias("declaration_line"), F.col("near.fn").alias("around"))
    known = sized.join(placed, [*FILE, "declaration_line"], "left").withColumn("declared_in", F.coalesce("p_owner", "around")).drop("around", "p_owner", "own_dims", "type_dims")
    parents = F.filter("tokens", lambda t: t != F.col("symbol"))
    member = F.col("declaration_kind") == "struct_member"
    means = F.to_json(F.struct("declaration_line", "declared_in", member.alias("member"), F.when(member, parents).alias("parents")))
    return known.withColumns({"parents": parents, "object": means})


def object_occurrences(objects: DataFrame, lines: DataFrame, functions: DataFrame) -> DataFrame:
    """The occurrences of each object (OBJECT, declaration_line, declared_in, declaration_kind, parents).

    An object declared in a function meets the occurrences there only; a member those on lines that name a parent, if there are any,
    else all; any other one the file's. The declaration's line counts as declaration.
    """
    spans = functions.where("defined").select(*FILE, "fn", F.col("sig_line").alias("start_line"), "end_line")
    occ = many(occurrences(lines, spans)).join(objects.select(*FILE, "symbol").distinct(), [*FILE, "symbol"], "left_semi")
    member, local = F.col("declaration_kind") == "struct_member", F.col("declared_in").isNotNull()
    cols = [*OBJECT, "line_no", "col_start", "col_end", "access", "fn", "callee", "line_text"]
    seen = F.when(F.col("line_no") == F.col("declaration_line"), "declaration").otherwise(F.col("access"))
    inside = objects.where(~member & local).join(occ.withColumnRenamed("fn", "declared_in"), [*FILE, "symbol", "declared_in"]).withColumn("fn", F.col("declared_in"))
    wide = objects.where(~member & ~local).join(occ, [*FILE, "symbol"])
    parts = objects.where(member).join(occ, [*FILE, "symbol"]).withColumn("access", seen)
    parts = parts.withColumn("near", (F.size("parents") == 0) | (F.col("access") == "declaration") | F.exists("parents", lambda t: F.col("line_text").contains(t)))
    parts = parts.withColumn("any", F.max("near").over(Window.partitionBy(*OBJECT))).where(F.col("near") | ~F.col("any"))
    return inside.withColumn("access", seen).select(*cols).unionByName(wide.withColumn("access", seen).select(*cols)).unionByName(parts.select(*cols))


def two_ended(rows: DataFrame, keys: list[str], order: list[str], n: int = 80) -> DataFrame:
    """Of each key's rows the first and the last n / 2 in order, all if there are no more than n, with how many there are (total).

    Two levels: each stretch of lines keeps its own ends, so that a key of very many rows is no single task's work; of what is left,
    some 2 n rows a stretch, the ends of the key are taken.
    """
    half, part = n // 2, F.floor(F.col(order[0]) / STRETCH)

    def ends(df: DataFrame, by: list) -> DataFrame:
        up, down = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
        return df.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)}).where((F.col("_up") <= half) | (F.col("_down") <= half)).drop("_up", "_down")

    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    return ends(ends(rows.withColumn("_part", part), [*keys, "_part"]).drop("_part"), keys).join(totals, keys)


def object_details(occ: DataFrame, n: int = 80) -> DataFrame:
    """Per object: counts by access (access_counts, occurrence_count), functions in order of first use, calls it is given to, and a two-ended sample.

    used_in_functions and passed_to are as long as the functions and calls that use the object; the other lists are bounded.
    """
    counts = occ.groupBy(*OBJECT, "access").agg(F.count("*").alias("n")).groupBy(*OBJECT).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("access", "n")))).alias("access_counts"), F.sum("n").alias("occurrence_count"))
    listed = lambda df, order, what: df.groupBy(*OBJECT).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*what).alias("x")))), lambda r: r["x"]).alias("xs"))
    fns = occ.groupBy(*OBJECT, "fn").agg(F.min(F.struct("line_no", "col_start")).alias("first"))
    used = listed(fns, "first", ["fn"]).select(*OBJECT, F.transform("xs", lambda x: x["fn"]).alias("used_in_functions"))
    spot = F.struct("line_no", "col_start").alias("first")
    mode = F.when(F.col("access") == "address", "address").otherwise("value").alias("mode")
    given = occ.where(F.col("access").isin("parameter", "address") & (F.col("callee") != "")).select(*OBJECT, spot, F.col("callee").alias("function"), "line_no", "col_start", "col_end", mode, F.col("fn").alias("in_function")).distinct()
    passed = listed(given, "first", ["function", "line_no", "col_start", "col_end", "mode", "in_function"]).withColumnRenamed("xs", "passed_to")
    some = two_ended(occ, OBJECT, ["line_no", "col_start"], n).withColumn("first", spot)
    sample = listed(some, "first", ["line_no", "col_start", "col_end", "access", "fn", "callee", "line_text"]).withColumnRenamed("xs", "occurrences")
    return counts.join(used, OBJECT).join(sample, OBJECT).join(passed, OBJECT, "left").withColumn("occurrences_truncated", F.col("occurrence_count") > n)


def symbol_details(access: DataFrame, texts: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """X09 in full: a row for each symbol of each access (X07: pver_id, file_id, line_no, col, array, member_path, index, dimension); functions (X01) if they are there already."""
    functions = many(checkpoint(extract_functions(texts))) if functions is None else functions
    lines = text_lines(texts)
    known = checkpoint(resolve_symbols(access, texts, functions, lines))
    objects = known.select(*OBJECT, "declaration_line", "declared_in", "declaration_kind", "parents").withColumn("parents", F.when(F.col("declaration_kind") == "struct_member", F.col("parents")))
    occ = checkpoint(object_occurrences(objects.dropDuplicates(OBJECT), lines, functions))
    full = known.join(object_details(occ), OBJECT, "left")
    array, pointer, parameter = (F.col("dims") != "") | (F.col("role") == "array"), F.col("depth") > 0, F.col("declaration_kind") == "parameter"
    member, flagged = F.col("declaration_kind") == "struct_member", F.col("role") == "array"
    kind = S.symbol_kind(array, member, pointer, parameter, F.coalesce(F.col("datatype").rlike(r"\b(struct|union)\b"), F.lit(False)))
    all_known = F.coalesce("all_known", F.lit(False))
    alarmed = F.when(flagged & (F.col("dimension") < F.size("sizes")), F.get("sizes", F.col("dimension")).isNotNull()).otherwise(all_known)
    return full.select(
        *LINE, "col", "place", "role", "symbol", "index", kind.alias("kind"), S.symbol_scope(F.col("declared_in"), parameter, member).alias("scope"), "datatype", "dims", "sizes", F.when(array, alarmed | all_known).alias("size_known"),
        "member_of", "declared_in", "declaration_line", "declaration_text", "declaration_kind", F.when(flagged, F.col("dimension")).alias("dimension_index"),
        F.when(F.col("symbol") == F.col("array"), F.try_element_at("parents", F.lit(-1))).alias("parent_symbol"), F.when(pointer, F.col("datatype")).alias("pointed_type"),
        "access_counts", "used_in_functions", "passed_to", F.coalesce("occurrence_count", F.lit(0)).alias("occurrence_count"), F.coalesce("occurrences_truncated", F.lit(False)).alias("occurrences_truncated"), "occurrences",
    )


def symbol_infos(access: DataFrame, texts: DataFrame) -> DataFrame:
    """X09 as counts: of symbol_details the figures of each list."""
    full = symbol_details(access, texts)
    of = lambda k: F.coalesce(F.try_element_at("access_counts", F.lit(k)), F.lit(0)).alias(f"n_{k}")
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    return full.select(*LINE, "col", "role", "symbol", "index", "kind", "scope", "datatype", "dims", "sizes", "size_known", "member_of", "declared_in", "declaration_line", "declaration_kind", *[of(k) for k in KINDS], "occurrence_count", size("passed_to").alias("n_passed"), size("used_in_functions").alias("n_functions"))


def enrich(frames: DataFrame, heads: DataFrame, texts: DataFrame, underlined: DataFrame | None = None) -> DataFrame:
    """A nested row (VARIABLE_INFO and pver_id) for each location of array alarms in heads (pver_id, block_no, location, alarm).

    frames: (pver_id, block_no, pos, entry); texts: (pver_id, file_id, name, text), name being what locations call the file;
    underlined: (pver_id, location, variable), what a message marks. Locations without a file or a line keep their paths and have no symbols.
    """
    alarms = checkpoint(heads.where(S.is_aoob(F.col("alarm"))))
    place = S.location_parts(F.col("location"))
    spots = alarms.select(*GROUP).distinct().select(*GROUP, F.regexp_extract("location", r"^(.*):\d[\d.-]*$", 1).alias("name"), place.alias("p"))
    spots = spots.join(texts.select("pver_id", "name", "file_id"), ["pver_id", "name"]).select(*GROUP, "file_id", F.col("p.line1").alias("line_no"), F.col("p.col1").alias("col"), F.col("p.line2").alias("end_line"), F.col("p.col2").alias("end_col")).where("line_no is not null")
    marked = underlined if underlined is not None else heads.select(*GROUP, F.lit(None).cast("string").alias("variable")).limit(0)
    spots = checkpoint(spots.join(marked.groupBy(*GROUP).agg(F.first("variable", ignorenulls=True).alias("underlined")), GROUP, "left"))
    functions = many(checkpoint(extract_functions(texts)))
    spans = functions.where("defined").select(*FILE, "fn", F.col("sig_line").alias("start_line"), "end_line")
    around = checkpoint(lines_in_functions(spots.select(*LINE, "location"), spans).withColumn("fn", F.nullif("fn", F.lit("global"))).select(*GROUP, "fn"))
    access = checkpoint(accesses(spots, text_lines(texts)))
    infos = symbol_details(access, texts, functions).join(texts.select(*FILE, "name"), FILE)
    at = lambda x: F.concat("name", F.lit(":"), x["line_no"].cast("string"), F.lit("."), x["col_start"].cast("string"), F.lit("-"), (x["col_end"] - 1).cast("string")).alias("location")
    sizes = F.transform("sizes", lambda x: x.cast("int")).alias("resolved_sizes")
    info = F.struct(
        "place", F.col("symbol").alias("symbol_name"), "role", "kind", "datatype", F.nullif(F.regexp_extract_all("dims", F.lit(r"\[[^\]]*\]"), 0), F.array().cast("array<string>")).alias("array_dims"), sizes, "size_known", "scope",
        F.col("declared_in").alias("declared_in_function"), "declaration_line", "declaration_text", "declaration_kind", "access_counts", "used_in_functions",
        F.transform("passed_to", lambda x: F.struct(x["function"].alias("function"), at(x), x["mode"].alias("mode"))).alias("passed_to"), F.col("occurrence_count").cast("int").alias("occurrence_count"), "occurrences_truncated",
        F.transform("occurrences", lambda x: F.struct(at(x), x["access"].alias("access"), x["fn"].alias("function"), x["callee"].alias("callee"), F.trim(x["line_text"]).alias("line_text"))).alias("occurrences"),
        F.col("index").alias("index_expression"), "dimension_index", "parent_symbol", "member_of", "pointed_type",
    )
    listed = infos.groupBy(*LINE, "col").agg(F.array_sort(F.collect_list(info), lambda a, b: a["place"] - b["place"]).alias("found"))
    listed = listed.withColumn("symbol_infos", F.transform("found", lambda x: x.dropFields("place"))).drop("found")
    same = lambda c: F.col(f"s.{c}").eqNullSafe(F.col(f"a.{c}"))
    told = spots.alias("s").join(access.alias("a"), [F.col(f"s.{c}") == F.col(f"a.{c}") for c in FILE] + [same(c) for c in SPOT if c not in FILE]).select(*[f"s.{c}" for c in [*GROUP, *LINE[1:], "col", "underlined"]], "a.array", "a.member_path", "a.index")
    told = told.join(listed, [*LINE, "col"], "left")
    variable = S.display_variable(F.col("underlined"), F.col("array"), F.col("index"))
    path = F.filter(F.split("member_path", r"->|\."), lambda x: x != "")
    primary = F.when(F.col("array").isNotNull(), F.struct(F.col("array").alias("symbol_name"), F.col("index").alias("index_expression"), path.alias("member_path"))).alias("variable_info")
    told = told.select(*GROUP, variable.alias("variable"), primary, "symbol_infos")
    paths = path_records(frames, alarms, around.where("fn is not null")).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("path_id", F.col("fns").alias("function_sequence"), "call_stack"))).alias("paths"))
    counts = trace_counts(frames, alarms).select(*GROUP, F.col("no_of_paths").cast("int"), F.col("no_of_traces").cast("int"))
    groups = group_ids(alarms).select(*GROUP, "group_id").join(counts, GROUP).join(paths, GROUP).join(around.withColumnRenamed("fn", "enclosing_function"), GROUP, "left").join(told, GROUP, "left")
    return groups.select("pver_id", "group_id", "location", "variable", "no_of_paths", "no_of_traces", "paths", "variable_info", F.coalesce("symbol_infos", F.array().cast(listed.schema["symbol_infos"].dataType)).alias("symbol_infos"), "enclosing_function")
