"""Facts: checking quotes, packing, merging, attaching to path classes, ordering and trimming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .symbols import STRETCH

ALARM = ["pver_id", "group_id"]
# The rank of a fact's kind in a pack, least first, and its weight in a brief, greatest first.
PACK_RANK = {"alarm_site": 0, "array_size_hint": 1, "local_guard": 2, "declaration": 3, "write": 4, "guard": 5, "clamp": 5, "mask": 5, "loop_bound": 5, "arg_binding": 6, "call_edge": 7, "path_step": 8, "access": 9}
BRIEF_WEIGHT = {"alarm_site": 100, "array_size_hint": 95, "local_guard": 95, "guard": 90, "clamp": 90, "mask": 90, "loop_bound": 90, "declaration": 80, "write": 70, "arg_binding": 65, "value_site": 60, "path_step": 50, "call_edge": 40, "access": 35}
# The kinds that a pack of each role keeps.
CALL_KINDS = ["call_edge", "arg_binding", "alarm_site", "path_step", "declaration", "array_size_hint", "local_guard"]
VALUE_KINDS = ["declaration", "write", "guard", "clamp", "mask", "loop_bound", "array_size_hint", "alarm_site", "arg_binding", "local_guard", "access"]
EVERYWHERE = ["global", ""]
# A line of a parameter list; behind an array's name an open dimension and a subscript; statements and signs that guard an index.
LISTED_TYPE = r"^(const\s+)?(uint\d+|int|unsigned|signed|size_t|bool)\b"
OPEN_DIMENSION, SUBSCRIPT = r"\s*\[\s*\]", r"\s*\[\s*[^\]\s]"
GUARDING, COMPARED = r"\b(if|while|for|switch)\b", r"\b\s*(<|>|<=|>=|==|!=)"


def _of_kind(values: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("kind")], F.lit(20))


def _quote80() -> Column:
    return F.substring(S.collapse_ws(F.col("quote")), 1, 80)


def verify_quotes(quotes: DataFrame, lines: DataFrame, radius: int = 2) -> DataFrame:
    """Whether a quote (pver_id, file_id, line_no, quote) stands on a line at most radius away, or on such a line and its two
    neighbours put together; and the nearest single line that holds it. Blank quotes never do.

    Quotes and lines of a stretch are ordered together, and a quote looks at the lines around it; lines near a stretch's ends are in both.
    So neither is copied for each place it is compared at, and what is dealt by file already is not dealt again.
    """
    file = ["pver_id", "file_id"]
    asked = quotes.select(*file, "line_no", "quote").distinct()
    w = Window.partitionBy(*file).orderBy("line_no")
    wide = S.collapse_ws(F.concat_ws("\n", F.lag("text").over(w), "text", F.lead("text").over(w)))
    own = lines.select(*file, F.col("line_no").cast("long").alias("at"), S.collapse_ws(F.col("text")).alias("flat"), wide.alias("wide"))
    line = F.when(F.col("pver_id").isNotNull() & F.col("file_id").isNotNull(), F.struct("at", "flat", "wide"))  # a line of no file holds nothing
    part = lambda c: F.floor(c / STRETCH)
    own = own.select(*file, F.explode(F.sequence(part(F.col("at") - radius), part(F.col("at") + radius))).alias("part"), "at", line.alias("own"))
    at = F.col("line_no").cast("long")
    both = own.unionByName(asked.select(*file, part(at).alias("part"), at.alias("at"), F.struct("line_no", "quote").alias("asked")), allowMissingColumns=True)
    near = F.collect_list("own").over(Window.partitionBy(*file, "part").orderBy("at").rangeBetween(-radius, radius))
    seen = both.select(*file, "at", "asked", near.alias("near")).where("asked is not null").select(*file, "asked.*", "at", "near", S.collapse_ws(F.col("asked.quote")).alias("needle"))
    holds = lambda text: text.contains(F.col("needle")) & (F.col("needle") != "")
    off = lambda x: x["at"] - F.col("at")
    found = F.array_min(F.transform(F.filter("near", lambda x: holds(x["flat"])), lambda x: F.struct((2 * F.abs(off(x)) - (off(x) < 0).cast("int")).alias("rank"), x["at"].alias("at"))))
    verified = F.coalesce(F.exists("near", lambda x: F.coalesce(holds(x["flat"]) | holds(x["wide"]), F.lit(False))), F.lit(False))
    return seen.select(*file, "line_no", "quote", verified.alias("verified"), found["at"].cast(asked.schema["line_no"].dataType).alias("found_line"))


def merge_packs(facts: DataFrame, guards: DataFrame | None = None) -> DataFrame:
    """Verified facts once per (line, kind, symbol, first 80 of the quote); the call path pack wins, then the order in a pack.

    guards: verified local guards (…, fn, line, quote, symbol); one per alarm comes last, as a fact of the value pack, unless it is there already.
    """
    rows = facts.where("verified").withColumn("pack", (F.col("agent") != "call_path").cast("int"))
    if guards is not None:
        own = guards.select(*ALARM, "fn", "line", "quote", "symbol", F.lit("local_guard").alias("kind"), F.lit("var_value").alias("agent"), F.lit(True).alias("verified"), F.lit(2).alias("pack"))
        rows = rows.unionByName(own, allowMissingColumns=True)
    key = Window.partitionBy(*ALARM, "line", "kind", F.coalesce("symbol", F.lit("")), _quote80()).orderBy("pack", "seq", "fn")
    return rows.withColumn("rn", F.row_number().over(key)).where("rn = 1").drop("rn", "pack")


def order_facts(facts: DataFrame) -> DataFrame:
    """Weight of the kind, then line, as a rank."""
    return facts.withColumn("rank", F.row_number().over(Window.partitionBy(*ALARM).orderBy(_of_kind(BRIEF_WEIGHT).desc(), "line", "fn", "quote", "seq", "agent", "verified")))


def facts_by_class(facts: DataFrame, class_fns: DataFrame, shared: DataFrame) -> DataFrame:
    """A fact belongs to the classes (…, class_id, fn) that pass its function; facts of the alarm's shared functions (…, fn: its own
    function and the callees its index comes from), of `global` and of no function belong to all classes of the alarm."""
    own = facts.join(class_fns, [*ALARM, "fn"])
    classes = class_fns.select(*ALARM, "class_id").distinct()
    everywhere = facts.where(F.col("fn").isin(EVERYWHERE)).unionByName(facts.where(~F.col("fn").isin(EVERYWHERE)).join(shared, [*ALARM, "fn"], "left_semi"))
    cols = [*ALARM, "class_id", "kind", "fn", "line", "symbol", "quote"]
    return own.select(*cols).unionByName(everywhere.join(classes, ALARM).select(*cols)).distinct()


def unattached_facts(facts: DataFrame, class_fns: DataFrame, shared: DataFrame) -> DataFrame:
    """Facts whose function no class passes and that is not shared."""
    return facts.where(~F.col("fn").isin(EVERYWHERE)).join(class_fns, [*ALARM, "fn"], "left_anti").join(shared, [*ALARM, "fn"], "left_anti")


def supported_findings(findings: DataFrame, facts: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings (…, file_id, fn, line, quote) with how they are supported: by a fact on the same line, of the same function (or no
    function), whose quote holds or is held by it; else by the source (J12); else not (null). Without line or quote nothing supports them."""
    keys = [*ALARM, "file_id", "fn", "line", "quote"]
    asked = findings.select(*keys).distinct()
    known = facts.select(*ALARM, "line", F.col("fn").alias("k_fn"), S.collapse_ws(F.col("quote")).alias("k_quote")).distinct()
    q = S.collapse_ws(F.col("quote"))
    hit = ((F.coalesce("fn", F.lit("")) == "") | (F.col("fn") == F.col("k_fn"))) & (F.col("k_quote").contains(q) | q.contains(F.col("k_quote"))) & (F.col("quote") != "")
    by_fact = asked.join(known, [*ALARM, "line"], "left").groupBy(*keys).agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("by_fact"))
    seen = verify_quotes(asked.select("pver_id", "file_id", F.col("line").alias("line_no"), "quote"), lines).where("verified").select("pver_id", "file_id", F.col("line_no").alias("line"), "quote", "verified")
    both = by_fact.join(seen, ["pver_id", "file_id", "line", "quote"], "left")
    return both.select(*keys, F.when(F.col("by_fact"), "fact").when(F.col("verified"), "source").alias("how"))


def merge_windows(centers: DataFrame, keys: list[str], radius: int = 3) -> DataFrame:
    """Windows of radius lines around centers (keys, line); those that overlap or touch become one."""
    spans = centers.select(*keys, F.greatest(F.lit(1), F.col("line") - radius).alias("s"), (F.col("line") + radius).alias("e")).distinct()
    w = Window.partitionBy(*keys).orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.coalesce((F.col("s") > reach + 1).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w))
    return islands.groupBy(*keys, "island").agg(F.min("s").alias("start_line"), F.max("e").alias("end_line"))


def compact_pack(facts: DataFrame, role: str = "var_value", cap: int = 48) -> DataFrame:
    """Facts of the kinds that the role keeps, by verified, rank of the kind, line and order; once per (fn, line, kind, symbol); past
    half of cap a symbol's second declaration goes; at most cap; quotes are cut at 160."""
    order = [F.col("verified").cast("int").desc(), _of_kind(PACK_RANK), "line", "seq", "fn", "quote", "agent"]
    allowed = facts.where(F.col("kind").isin(CALL_KINDS if role == "call_path" else VALUE_KINDS))
    once = Window.partitionBy(*ALARM, "fn", "line", "kind", F.substring(F.coalesce("symbol", F.lit("")), 1, 40)).orderBy(*order)
    ranked = allowed.withColumn("d", F.row_number().over(once)).where("d = 1").drop("d")
    ranked = ranked.withColumn("rn", F.row_number().over(Window.partitionBy(*ALARM).orderBy(*order)))
    again = F.row_number().over(Window.partitionBy(*ALARM, "kind", "symbol").orderBy("rn"))
    kept = ranked.withColumn("again", again).where(~((F.col("kind") == "declaration") & (F.coalesce("symbol", F.lit("")) != "") & (F.col("again") > 1) & (F.col("rn") - 1 > cap // 2)))
    kept = kept.withColumn("rn", F.row_number().over(Window.partitionBy(*ALARM).orderBy("rn"))).where(F.col("rn") <= cap).drop("again")
    return kept.withColumn("quote", F.substring("quote", 1, 160))


def trim_brief(facts: DataFrame, max_chars: int = 40000) -> DataFrame:
    """Facts in order (rank); while the text is longer than max_chars, the first three quarters of them stay, never under eight.

    The sizes that are tried, n, 3/4 n, ..., depend on the number of facts only; the longest that fits is found from running sums, so an alarm's facts are never gathered.
    """
    size = F.length(F.concat_ws("|", "kind", "fn", F.col("line").cast("string"), "quote"))
    w = Window.partitionBy(*ALARM)
    summed = facts.withColumns({"reach": F.sum(size).over(w.orderBy("rank")), "n": F.count("*").over(w)})
    steps = F.expr("aggregate(sequence(1, 64), array(n), (l, i) -> if(element_at(l, -1) <= 8, l, array_append(l, greatest(8, cast(floor(element_at(l, -1) * 0.75) as bigint)))))")
    tried = summed.withColumn("steps", steps).where(F.expr("array_contains(steps, cast(rank as bigint))"))
    fits = (F.col("reach") <= max_chars) | (F.col("rank") <= 8)
    return tried.groupBy(*ALARM).agg(F.max("n").alias("n_facts"), F.max(F.when(fits, F.col("rank"))).alias("n_kept"))


def compact_facts(attached: DataFrame, facts: DataFrame, n_classes: DataFrame) -> DataFrame:
    """One row per (line, kind, symbol, first 80 of the quote) of all facts, with its classes in order, or all; empty if none."""
    keys = [*ALARM, "line", "kind", F.coalesce("symbol", F.lit("")).alias("symbol"), _quote80().alias("quote80")]
    every = attached.select(*keys, "class_id").unionByName(facts.select(*keys, F.lit(None).cast("string").alias("class_id")))
    rows = every.groupBy(*ALARM, "line", "kind", "symbol", "quote80").agg(F.array_sort(F.collect_set("class_id")).alias("ids"))
    classes = F.when(F.size("ids") == F.col("n"), "all").otherwise(F.array_join("ids", ","))
    return rows.join(n_classes, ALARM, "left").select(*ALARM, "line", "kind", "symbol", "quote80", classes.alias("classes"))


def unclear_symbols(symbols: DataFrame, facts: DataFrame) -> DataFrame:
    """Symbols of an alarm (…, symbol, is_array, is_index, declared, sized, local) that stay unclear after its facts, with the reason.

    An array needs its size; an index a bound or a write, unless it is made in the alarm function (local); anything else a declaration, write or bound.
    """
    any_of = lambda *kinds: F.bool_or(F.col("kind").isin(*kinds))
    told = facts.groupBy(*ALARM, "symbol").agg(any_of("declaration").alias("f_decl"), any_of("write", "arg_binding").alias("f_write"), any_of("guard", "clamp", "mask", "loop_bound", "local_guard").alias("f_bound"), any_of("array_size_hint").alias("f_size"))
    seen = symbols.where("symbol <> ''").join(told, [*ALARM, "symbol"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("f_decl", "f_write", "f_bound", "f_size")})
    reason = (
        F.when(F.col("is_array") & ~(F.col("f_size") | F.col("sized")), "array_size_unknown")
        .when(F.col("is_index") & ~F.col("f_bound") & ~F.col("f_write") & ~F.col("local"), "index_value_unclear")
        .when(~(F.col("f_decl") | F.col("declared")) & ~F.col("f_write") & ~F.col("f_bound"), "no_decl_or_write")
    )
    return seen.withColumn("reason", reason).where("reason is not null").select(*ALARM, "symbol", "reason").distinct()


def mine_facts(alarms: DataFrame, lines: DataFrame) -> DataFrame:
    """What body lines tell about an alarm (…, array, index, alarm_line): array declarations, subscripts (alarm_site on the alarm's
    line, else access), guards of the index and writes of its tokens; once per (line, kind, first 80 of the quote).

    lines: (…, line_no, text) of the alarm's bodies. One line may give several facts: an array of candidates is exploded.
    """
    text, array, index = F.trim("text"), F.coalesce("array", F.lit("")), F.coalesce("index", F.lit(""))
    quoted = lambda c: F.concat(F.lit(r"\b\Q"), c, F.lit(r"\E"))
    both = lines.join(alarms, ALARM).where((text != "") & ~text.startswith("/*"))
    listed = text.endswith(",")
    weak = (text.rlike(LISTED_TYPE) & listed) | (listed & ~text.rlike(r"[(=\[]") & (index != "") & text.contains(index))
    both = both.where(~weak).withColumns({"t": text, "a": array, "x": index, "toks": S.index_tokens(index)})
    t, a, x = F.col("t"), F.col("a"), F.col("x")
    declared = (a != "") & F.regexp_like(t, F.concat(quoted(a), F.lit(OPEN_DIMENSION))) & t.contains("=")
    used = (a != "") & F.regexp_like(t, F.concat(quoted(a), F.lit(SUBSCRIPT)))
    head = F.split_part(t, x, F.lit(1))
    guard = (x != "") & S.is_guard(t, S.MINED_GUARD) & t.contains(x) & ~F.substring(head, -3, 3).contains("[")
    guard = guard & (t.rlike(GUARDING) | F.regexp_like(t, F.concat(quoted(x), F.lit(COMPARED))))
    written = F.try_element_at(F.filter("toks", lambda k: S.is_lhs_write(F.col("t"), k)), F.lit(1))
    one = lambda ok, kind, symbol: F.when(ok, F.struct(kind.alias("kind"), symbol.alias("symbol")))
    site = F.when(F.col("line_no") == F.col("alarm_line"), "alarm_site").otherwise("access")
    found = F.array(one(declared, F.lit("declaration"), a), one(used, site, F.when((x != "") & t.contains(x), x).otherwise(a)), one(guard, F.lit("guard"), x), one(written.isNotNull(), F.lit("write"), written))
    rows = both.select(*ALARM, "line_no", F.substring("t", 1, 300).alias("quote"), F.posexplode(F.filter(found, lambda f: f.isNotNull())).alias("at", "f")).select("*", "f.*")
    once = Window.partitionBy(*ALARM, "line_no", "kind", F.substring("quote", 1, 80)).orderBy("at", "quote", "symbol")
    return rows.withColumn("rn", F.row_number().over(once)).where("rn = 1").select(*ALARM, "line_no", "kind", "symbol", "quote")


def visit_sequence(class_fns: DataFrame, alarm_fns: DataFrame) -> DataFrame:
    """X15, call path: the functions of an alarm's classes (…, class_id, pos, fn) in class and path order, then the alarm's own; each once."""
    rank = lambda step, c, pos: F.struct(F.lit(step).alias("s"), c.alias("c"), pos.cast("long").alias("p")).alias("r")
    ranked = class_fns.select(*ALARM, "fn", rank(0, F.col("class_id"), F.col("pos")))
    own = alarm_fns.select(*ALARM, "fn", rank(1, F.lit(""), F.lit(0)))
    return _placed(ranked.unionByName(own).where("fn <> ''"))


def _placed(ranked: DataFrame) -> DataFrame:
    first = ranked.groupBy(*ALARM, "fn").agg(F.min("r").alias("r"))
    return first.select(*ALARM, "fn", F.row_number().over(Window.partitionBy(*ALARM).orderBy("r", "fn")).alias("place"))


def value_sequence(alarms: DataFrame, origins: DataFrame, symbol_fns: DataFrame, call_path: DataFrame, cap: int = 24) -> DataFrame:
    """X15, values: an alarm's function (…, fn, index_origin), the callees its index comes from (…, fn, place), its symbols' functions
    (…, fn, place: of use, write and declaration, in the symbols' order), and, unless the index is local, the call path; each once, no `global`, at most cap."""
    rank = lambda step, place: F.struct(F.lit(step).alias("s"), place.cast("long").alias("p")).alias("r")
    wide = call_path.join(alarms.where("index_origin <> 'local'").select(*ALARM).distinct(), ALARM, "left_semi")
    parts = [alarms.select(*ALARM, "fn", rank(0, F.lit(0))), *[df.select(*ALARM, "fn", rank(i, F.col("place"))) for i, df in enumerate((origins, symbol_fns, wide), 1)]]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("fn <> '' and fn <> 'global'")
    return _placed(every).where(F.col("place") <= cap)


def symbol_chains(symbol_fns: DataFrame, alarm_fns: DataFrame) -> DataFrame:
    """X15, per symbol: consecutive pairs of the functions (…, symbol, fn, place) it goes through, without `global`; a symbol without any has its alarm's function, as a chain of one (target null)."""
    inner = symbol_fns.where("fn <> '' and fn <> 'global'")
    lone = symbol_fns.select(*ALARM, "symbol").distinct().join(inner, [*ALARM, "symbol"], "left_anti").join(alarm_fns, ALARM).select(*ALARM, "symbol", "fn", F.lit(1).alias("place"))
    every = inner.select(*ALARM, "symbol", "fn", "place").unionByName(lone)
    w = Window.partitionBy(*ALARM, "symbol").orderBy("place")
    chained = every.select(*ALARM, "symbol", F.row_number().over(w).alias("step"), F.col("fn").alias("source"), F.lead("fn").over(w).alias("target"))
    return chained.where("target is not null or step = 1")
