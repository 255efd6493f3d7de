"""All registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import corpus as co
from .operators import enrich as en
from .operators import facts as fa
from .operators import graph as gr
from .operators import paths as pa
from .operators import records as re_
from .operators import symbols as sy
from .operators import verdict as ve
from .plans.views import view, with_views
from .sources import files as fi
from .sources import lines as li
from .sources.scratch import checkpoint, many, new_path
from .streaming import events as ev

FLAGSHIP = "alarm_location_paths"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, views: str, build: Callable[..., DataFrame], sql: str | None) -> None:
    names = views.split()
    QUERIES[name] = lambda spark, sf_dir: build(*[view(spark, sf_dir, v) for v in names])
    if sql:
        SQL[name] = with_views(names, sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _flat(df: DataFrame, *arrays: str) -> DataFrame:
    return df.withColumns({a: F.array_join(F.col(a).cast("array<string>"), ",") for a in arrays})


# --- paths ---

_TR = """, p as (select pver_id, block_no, pos, entry, regexp_extract(entry, '^\\s*call#(.*?) at ', 1) as fn_raw,
  trim(split_part(regexp_extract(entry, '^\\s*call#(.*?) at ', 1), '|', 1)) as fn, cast(regexp_extract(entry, ' at [^:]*:(\\d+)', 1) as integer) as call_site_line from frames),
st as (select pver_id, block_no, string_agg(entry, ' > ' order by pos) as stack, string_agg(fn || ':' || call_site_line, ',' order by pos) as steps,
  string_agg(fn, '>' order by pos) as fns, list(fn order by pos) as fl, list(fn || ':' || call_site_line order by pos) as sl from p group by 1, 2),
tr as (select h.*, coalesce(stack, '') as stack, coalesce(steps, '') as steps, coalesce(fns, '') as fns, coalesce(fl, []) as fl, coalesce(sl, []) as sl from heads h left join st using (pver_id, block_no)),
un as (select pver_id, location, stack, min(block_no) as first_block, count(*) as n, first(steps) as steps, first(fns) as fns, first(fl) as fl, first(sl) as sl from tr group by 1, 2, 3),
pt as (select *, row_number() over (partition by pver_id, location order by first_block) as path_id from un),
cl0 as (select pver_id, location, steps, count(*) as size, min(path_id) as rep, string_agg(path_id, ',' order by path_id) as members, list(path_id) as ml, first(sl) as sl from pt group by 1, 2, 3),
cl as (select *, row_number() over (partition by pver_id, location order by size desc, rep) as rank from cl0)
"""
_classes = lambda f, h: pa.path_classes(pa.path_records(f, h))

register("alarm_location_paths", "frames heads", pa.alarm_location_paths, _TR + "select pver_id, location, count(*) as n_traces, count(distinct stack) as n_paths, count(distinct steps) as n_classes from tr group by 1, 2")
register("p05_parse_frames", "frames", lambda f: pa.parse_frames(f), _TR.split("st as")[0].rstrip().rstrip(",") + " select * from p")
register("p04_parse_location", "heads", lambda h: h.select("pver_id", "block_no", S.location_parts(F.col("location")).alias("l")).select("pver_id", "block_no", "l.*"), r"""
select pver_id, block_no, cast(regexp_extract(location, ':(\d+)\.(\d+)-', 1) as integer) as line1, cast(regexp_extract(location, ':(\d+)\.(\d+)-', 2) as integer) as col1,
  cast(case when regexp_matches(location, '-\d+\.\d+$') then regexp_extract(location, '-(\d+)\.', 1) else regexp_extract(location, ':(\d+)', 1) end as integer) as line2,
  cast(regexp_extract(location, '(\d+)$', 1) as integer) as col2, regexp_extract(location, ':(.*)$', 1) as numeric_key from heads""")
register("a01_trace_counts", "frames heads", pa.trace_counts, _TR + "select pver_id, location, count(*) as no_of_traces, count(distinct stack) as no_of_paths from tr group by 1, 2")
_around = lambda h: h.select(*pa.GROUP).distinct().withColumn("fn", F.concat(F.lit("near_"), F.col("pver_id")))
register("a02_path_records", "frames heads", lambda f, h: pa.path_records(f, h, _around(h)).select(*pa.GROUP, "path_id", "first_block", "n", F.array_join("call_stack", " > ").alias("stack"), F.array_join("fns", ">").alias("fns")), _TR + "select pver_id, location, cast(path_id as integer) as path_id, first_block, n, stack, case when fns = '' then 'near_' || pver_id else fns end as fns from pt")
_centers = lambda h: h.select(*pa.GROUP).distinct().withColumn("fn", F.lit("fn_5"))
register("w01_group_ids", "heads", pa.group_ids, ", g as (select pver_id, location, min(block_no) as first_block from heads group by 1, 2) select *, cast(row_number() over (partition by pver_id order by first_block) as integer) as group_id from g")
register("a08_path_classes", "frames heads", lambda f, h: _flat(_classes(f, h).select(*pa.GROUP, "class_id", "size", "representative_path_id", "member_path_ids", F.array_join("steps", ",").alias("steps")), "member_path_ids"), _TR + "select pver_id, location, 'C' || rank as class_id, size, cast(rep as integer) as representative_path_id, members as member_path_ids, steps from cl")
register("a09_cluster_classes", "frames heads", lambda f, h: _flat(pa.cluster_classes(_classes(f, h), 3, h.where("pver_id < '4'")), "member_path_ids"), _TR + """, m as (select *, max(rank) over (partition by pver_id, location) as nc, case when len(sl) > 3 then sl[-3:] else sl end as suffix from cl),
k0 as (select pver_id, location, suffix, cast(sum(size) as bigint) as size, min(rank) as best, array_to_string(list_sort(list_distinct(flatten(list(ml)))), ',') as members, arg_min(rep, rank) as rep from m where nc > 3 group by 1, 2, 3),
k as (select *, row_number() over (partition by pver_id, location order by size desc, best) as kr from k0)
select pver_id, location, 'C' || rank as class_id, size, members as member_path_ids, cast(rep as integer) as representative_path_id, 'full' as coverage from m where nc <= 3
union all select pver_id, location, 'K' || kr, size, members, cast(rep as integer), case when pver_id < '4' then 'full' else 'partial' end from k where kr <= 3""")
register("a10_class_edges", "frames heads", lambda f, h: pa.class_edges(_classes(f, h)), _TR + ", e as (select pver_id, location, rank, unnest(list_zip(sl[:-2], sl[2:])) as e from cl where len(sl) > 1) select pver_id, location, e[1] as src, e[2] as dst, 'C' || min(rank) as class_id from e group by 1, 2, 3, 4")
register("a11_call_tree", "frames heads", lambda f, h: pa.call_tree(pa.path_records(f, h)), _TR + ", e as (select pver_id, location, fl, unnest(range(1, len(fl) + 1)) as i from pt) select pver_id, location, array_to_string(fl[1:i], '>') as prefix, count(*) as n_paths from e group by 1, 2, 3")
register("w02_unique_sequences", "frames heads", pa.unique_sequences, _TR + """, d as (select *, lag(fn) over (partition by pver_id, block_no order by pos) as was from p),
q as (select pver_id, block_no, string_agg(fn, '>' order by pos) as seq from d where was is null or was <> fn group by 1, 2)
select pver_id, location, seq, min(block_no) as first_block, count(*) as n from heads join q using (pver_id, block_no) group by 1, 2, 3""")
register("w03_path_edges", "frames", pa.path_edges, _TR.split("st as")[0].rstrip().rstrip(",") + ", d as (select *, lead(fn) over (partition by pver_id, block_no order by pos) as dst from p) select distinct pver_id, block_no, fn as src, dst from d where dst is not null and dst <> fn")
register("j16_edge_kinds", "frames cfg_edges", lambda f, c: pa.edge_kinds(pa.path_edges(f).select("pver_id", "src", "dst").distinct(), c), _TR.split("st as")[0].rstrip().rstrip(",") + """, d as (select *, lead(fn) over (partition by pver_id, block_no order by pos) as dst from p),
e as (select distinct pver_id, fn as src, dst from d where dst is not null and dst <> fn), c as (select distinct pver_id, caller, callee from cfg_edges)
select e.pver_id, src, dst, case when c.caller is null then 'path' else 'direct' end as kind from e left join c on e.pver_id = c.pver_id and src = caller and dst = callee""")
register("j03_attach_traces", "alarms heads", lambda a, h: pa.attach_traces(a.select("pver_id", "location").distinct(), h), r""", g as (select distinct pver_id, location from alarms),
x as (select g.pver_id, g.location, h.block_no, 'exact' as how from g join heads h on g.pver_id = h.pver_id and g.location = h.location),
r as (select *, regexp_extract(location, ':(.*)$', 1) as k from g where not exists (select 1 from heads h where h.pver_id = g.pver_id and h.location = g.location))
select * from x union all select r.pver_id, r.location, h.block_no, case when h.block_no is null then 'none' else 'numbers' end from r left join heads h on r.pver_id = h.pver_id and k = regexp_extract(h.location, ':(.*)$', 1)""")
register("j17_paths_with_variable", "frames heads", lambda f, h: pa.paths_with_variable(pa.path_records(f, h), h.select("pver_id", F.lit("fn_3").alias("fn")).distinct()), _TR + "select pver_id, location, cast(path_id as integer) as path_id from pt where list_contains(fl, 'fn_3')")

register("a14_path_roles", "frames heads", lambda f, h: pa.path_roles(pa.path_records(f, h), _centers(h)), _TR + """, e as (select pver_id, location, path_id, fl, unnest(range(1, len(fl) + 1)) as i from pt),
r as (select pver_id, location, fl[i] as fn, bool_or(i = 1) as a, bool_or(i = len(fl)) as z, count(distinct path_id) as n_paths from e group by 1, 2, 3)
select pver_id, location, fn, case when a and z then 'origin_and_alarm' when z or fn = 'fn_5' then 'alarm' when a then 'origin' else 'hop' end as role, n_paths from r""")
register("a14_primary_paths", "frames heads", lambda f, h: pa.primary_paths(pa.path_records(f, h), _centers(h)), _TR + """, q as (select pver_id, location, path_id, list_filter(fl, lambda x, i: i = 1 or x <> fl[i - 1]) as sq from pt where len(fl) > 0), b as (select *, row_number() over (partition by pver_id, location order by sq[-1] = 'fn_5' desc, len(sq) desc, path_id) as k from q)
select pver_id, location, cast(path_id as integer) as path_id, sq[-1] = 'fn_5' as at_center, array_to_string(sq, '>') as seq from b where k = 1""")

# --- graph ---

_E = ", e as (select distinct pver_id, caller, callee from cfg_edges), x as (select pver_id, caller as fn, 1 as o, 0 as i from e union all select pver_id, callee, 0, 1 from e), dg as (select pver_id, fn, cast(sum(o) as bigint) as out_degree, cast(sum(i) as bigint) as in_degree, cast(sum(o + i) as bigint) as degree from x group by 1, 2)\n"
register("u01_close_graph", "cfg_edges c_files", lambda e, c: gr.close_graph(e, co.extract_functions(c).select("pver_id", "fn", "defined")), _E + r""", k as (select pver_id, fn, out_degree > 0 as d from dg union all select pver_id, regexp_extract(text, '(fn_\d+)\(uint8 par', 1), true from c_files union all select pver_id, regexp_extract(text, '(fn_p\d+)', 1), false from c_files) select pver_id, fn, bool_or(d) as defined from k group by 1, 2""")
register("a06_degrees", "cfg_edges", gr.degrees, _E + "select * from dg")
register("a07_edge_weights", "cfg_edges", gr.edge_weights, "select pver_id, caller, callee, cast(sum(w) as bigint) as weight from cfg_edges group by 1, 2, 3")
register("a22_merge_callees", "cfg_edges", lambda e: _flat(gr.merge_callees(e.withColumn("seq", -F.col("w"))), "callees"), ", s as (select pver_id, caller, callee, min(-w) as seq from cfg_edges group by 1, 2, 3) select pver_id, caller, string_agg(callee, ',' order by seq, callee) as callees from s group by 1, 2")
register("l01_hubs", "cfg_edges", lambda e: gr.hubs(gr.degrees(e)), _E + ", r as (select *, cast(row_number() over (partition by pver_id order by degree desc, fn) as integer) as rank from dg) select * from r where rank <= 40")
register("l02_search_functions", "cfg_edges", lambda e: gr.search_functions(gr.degrees(e), "FN_1"), _E + ", r as (select *, cast(row_number() over (partition by pver_id order by fn) as integer) as rank from dg where contains(lower(fn), 'fn_1')) select * from r where rank <= 30")
_near = "n as (select pver_id, callee as fn, caller as other, 'caller' as side from e union all select pver_id, caller, callee, 'callee' from e)"
register("j15_neighborhood", "cfg_edges", lambda e: gr.neighborhood(e, gr.close_graph(e).select("pver_id", "fn")), _E + f""", {_near}, r as (select *, cast(row_number() over (partition by pver_id, fn, side order by other) as integer) as rank, count(*) over (partition by pver_id, fn, side) as total from n) select * from r where rank <= 10""")
_leaves = lambda f: f.groupBy("pver_id", "block_no").agg(F.max_by(S.bare_fn(S.frame_fn(F.col("entry"))), "pos").alias("leaf")).select("pver_id", "leaf").distinct()
register("g02_leaf_distance", "cfg_edges frames", lambda e, f: gr.leaf_distance(e, _leaves(f)), _E.replace(", e as", "--recursive, e as", 1) + r""", lf as (select distinct pver_id, leaf from (select pver_id, block_no, arg_max(regexp_extract(entry, '^call#([^ |]*)', 1), pos) as leaf from frames group by 1, 2)), many as (select count(distinct caller) as n from e),
b(pver_id, leaf, fn, distance) as (select pver_id, leaf, leaf, 0 from lf union select b.pver_id, leaf, caller, distance + 1 from b join e on e.pver_id = b.pver_id and callee = fn where caller <> leaf and distance < (select n from many)) select pver_id, leaf, fn, min(distance) as distance from b group by 1, 2, 3""")
_members = lambda f: f.groupBy("pver_id", F.col("block_no").alias("grp"), S.bare_fn(S.frame_fn(F.col("entry"))).alias("fn")).agg(F.min("pos").alias("position"), F.max("pos").alias("last")).withColumn("is_leaf", F.col("last") == F.max("last").over(Window.partitionBy("pver_id", "grp"))).drop("last")
register("g03_execution_order", "cfg_edges frames", lambda e, f: gr.execution_order(_members(f), e), r"""--recursive, m as (select pver_id, block_no as grp, regexp_extract(entry, '^call#([^ |]*)', 1) as fn, min(pos) as first, max(pos) as last from frames group by 1, 2, 3), nm as (select pver_id, grp, list(fn order by first, fn) as names, arg_max(fn, last) as leaf from m group by 1, 2),
inn as (select distinct a.pver_id, a.grp, a.fn as caller, b.fn as callee from m a join cfg_edges e on e.pver_id = a.pver_id and e.caller = a.fn join m b on b.pver_id = a.pver_id and b.grp = a.grp and b.fn = e.callee where a.fn <> b.fn), es as (select pver_id, grp, list(caller || '>' || callee) as es from inn group by 1, 2),
k(pver_id, grp, leaf, es, names, done) as (select pver_id, grp, leaf, coalesce(es, []::varchar[]), names, []::varchar[] from nm left join es using (pver_id, grp)
 union all select pver_id, grp, leaf, es, list_filter(names, lambda x: x <> nx), list_append(done, nx) from (select *, list_filter(names, lambda x: len(list_filter(es, lambda e: ends_with(e, '>' || x) and not list_contains(done, split_part(e, '>', 1)))) = 0)[1] as nx from k where len(names) > 0) where nx is not null),
z as (select pver_id, grp, arg_max(list_concat(list_filter(list_concat(done, names), lambda x: x <> leaf), [leaf]), len(done)) as o from k group by 1, 2) select pver_id, grp, unnest(o) as fn, cast(unnest(range(1, len(o) + 1)) as integer) as place from z""")
register("g04_execution_role", "frames", lambda f: gr.execution_role(_members(f).withColumn("place", F.row_number().over(Window.partitionBy("pver_id", "grp").orderBy("position")))).select("pver_id", "grp", "fn", "role"), r""", m as (select pver_id, block_no as grp, regexp_extract(entry, '^call#([^ |]*)', 1) as fn, min(pos) as p from frames group by 1, 2, 3)
select pver_id, grp, fn, case when fn = 'global' then 'declaration' when p = max(p) over (partition by pver_id, grp) then 'leaf' else 'intermediate' end as role from m""")
register("g01_caller_chain", "cfg_edges", lambda e: gr.caller_chain(e.select("pver_id", F.col("callee").alias("fn")).distinct(), e), _E.replace(", e as", "--recursive, e as", 1) + """, c(pver_id, fn, cur, chain, n) as (select distinct pver_id, callee, callee, [callee], 1 from e
 union all select pver_id, fn, nx, list_append(chain, nx), n + 1 from (select c.pver_id, c.fn, c.chain, c.n, (select min(e.caller) from e where e.pver_id = c.pver_id and e.callee = c.cur and not list_contains(c.chain, e.caller)) as nx from c where c.n < 12) t where nx is not null),
m as (select pver_id, fn, arg_max(chain, n) as chain from c group by 1, 2) select pver_id, fn, array_to_string(list_reverse(chain), '>') as chain from m""")
# --- alarm records ---

_G = ", g as (select pver_id, location, min(block_no) as fb from heads group by 1, 2), gi as (select pver_id, location, cast(row_number() over (partition by pver_id order by fb) as integer) as group_id from g)\n"
register("p01_alarm_text", "alarms", lambda a: a.select("pver_id", "alarm_seq", S.alarm_text(F.col("message"), F.col("category"), F.col("location")).alias("text")), """
select pver_id, alarm_seq, case when category not like 'Out-of-bound%' and not contains(lower(message), 'array_out_of_bounds') then null when message <> '' then message || ' at ' || location else 'ALARM (A) array_out_of_bounds at ' || location end as text from alarms""")
register("p02_is_aoob", "heads", lambda h: h.select("pver_id", "block_no", S.is_aoob(F.col("alarm")).alias("aoob")), "select pver_id, block_no, contains(lower(alarm), 'array_out_of_bounds') as aoob from heads")
register("p06_bare_fn", "frames", lambda f: f.select("pver_id", S.bare_fn(S.frame_fn(F.col("entry"))).alias("fn")).groupBy("pver_id", "fn").count().withColumnRenamed("count", "n"), r"select pver_id, regexp_extract(entry, '^call#([^ |]*)', 1) as fn, count(*) as n from frames group by 1, 2")
register("p07_order_key", "alarms", lambda a: a.select("alarm_seq", S.order_key(F.col("order_id")).alias("order_key")), "select alarm_seq, replace(trim(order_id), ',', '') as order_key from alarms")
register("p18_display_variable", "alarms", lambda a: a.select("alarm_seq", S.display_variable(F.when(F.col("alarm_seq") % 3 == 0, F.col("message")), F.lit("items"), F.when(F.col("alarm_seq") % 2 == 0, "i").otherwise("")).alias("variable")), "select alarm_seq, case when alarm_seq % 3 = 0 and trim(message) <> '' then trim(message) when alarm_seq % 2 = 0 then 'items[i]' else 'items' end as variable from alarms")
register("j01_alarm_records", "alarms heads", lambda a, h: re_.alarm_records(a, pa.group_ids(h)), _G + "select a.*, gi.group_id from alarms a left join gi on a.pver_id = gi.pver_id and a.location = gi.location")
register("j02_resolve_orders", "alarms heads", lambda a, h: re_.resolve_orders(a.select("pver_id", F.col("order_id").alias("key")).distinct(), pa.group_ids(h), a), _G + """, o as (select pver_id, replace(order_id, ',', '') as k, arg_max(location, alarm_seq) as location from alarms group by 1, 2), q as (select distinct pver_id, order_id as key, replace(order_id, ',', '') as k from alarms)
select q.pver_id, q.key, coalesce(g1.group_id, g2.group_id) as group_id, case when g1.group_id is not null then 'group' when g2.group_id is not null then 'order' else 'none' end as how
from q left join gi g1 on g1.pver_id = q.pver_id and cast(g1.group_id as string) = q.k left join o on o.pver_id = q.pver_id and o.k = q.k left join gi g2 on g2.pver_id = o.pver_id and g2.location = o.location""")
register("w13_latest_runs", "run_events", lambda e: re_.latest_runs(e.select("pver_id", "order_key", F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("stamp"))), "select pver_id, order_key, max(strftime(ts, '%Y%m%dT%H%M%SZ')) as stamp, count(*) as runs from run_events group by 1, 2")
_sized = lambda o: o.groupBy("pver_id", "group_id", "symbol").agg(F.bool_or(F.col("kind") == "array_size_hint").alias("size_known")).withColumn("is_array", F.col("symbol").isin("idx_0", "idx_1"))
register("a15_enrichment_report", "heads cfg_edges order_facts", lambda h, e, o: re_.enrichment_report(h, pa.group_ids(h), e, _sized(o)), """, b as (select pver_id, count(*) as blocks, count(*) filter (contains(lower(alarm), 'array_out_of_bounds')) as matched, count(distinct location) as groups from heads group by 1), c as (select pver_id, count(*) as edges, count(distinct caller) as functions from cfg_edges group by 1),
z as (select pver_id, group_id, symbol, bool_or(kind = 'array_size_hint') as k from order_facts group by 1, 2, 3), y as (select pver_id, count(*) as symbols, count(distinct group_id) as groups_with_info, count(*) filter (symbol in ('idx_0', 'idx_1') and not k) as unknown_sizes from z group by 1)
select b.*, c.edges, c.functions, symbols, groups_with_info, unknown_sizes from b left join c using (pver_id) left join y using (pver_id)""")
_files = lambda h: h.select("pver_id", F.explode(F.array(F.when(F.col("pver_id") != "3", F.lit("Alarms.CSV")), F.lit("run.log"), F.when(F.col("pver_id") != "2", F.lit("input.c")), F.when(F.col("pver_id") > "4", F.lit("cfg.json")))).alias("name")).where("name is not null").distinct()
register("s09_project_inventory", "alarms heads", lambda a, h: re_.project_inventory(_files(h), a), """
select p.pver_id, case when p.pver_id <> '3' then 'Alarms.CSV' end as alarm_file, 'run.log' as log_file, case when p.pver_id <> '2' then 'input.c' end as source_file, case when p.pver_id > '4' then 'cfg.json' end as graph_file, coalesce(n, 0) as n_alarms,
 case when p.pver_id > '4' then 'ready' when p.pver_id in ('2', '3') then 'incomplete' else 'needs_build' end as state from (select distinct pver_id from heads) p left join (select pver_id, count(*) as n from alarms group by 1) c using (pver_id)""")

# --- lines and symbols ---

_GUARD = r"(?i)\b(if|while|for|switch)\b|[<>]|&&|\|\||\b(min|max)\b|&\s*0x|%\s*\d|clamp"  # of alarms being prepared
_MINED = r"(?i)\b(if|while|for|switch)\b|[<>]|&&|\|\||&\s*0x|%\s*\d|clamp|min|max"  # of mined bodies
_WRITE = lambda t, token: f"regexp_matches(split_part({t}, '//', 1), '(^|[^\\w.>])\\*?\\s*{token}\\s*(\\[[^\\]]*\\])?\\s*([-+*/%&|^]|<<|>>)?=([^=]|$)') and not regexp_matches(split_part({t}, '=', 1), '\\b(if|while|return)\\b') and contains(split_part({t}, '=', 1), '{token}')"
_OCC = r""", k as (select *, list_filter(regexp_extract_all(text, '([A-Za-z_]\w*|\d\w*|[^\sA-Za-z_\d]+|\s+)'), lambda x: true) as ps from code_lines),
t as (select pver_id, file_id, line_no, text, ps, unnest(range(1, len(ps) + 1)) as i from k),
s as (select pver_id, file_id, line_no, text, ps[i] as symbol, cast(1 + length(array_to_string(ps[1:i-1], '')) as integer) as col_start, array_to_string(ps[1:i-1], '') as before, array_to_string(ps[i+1:], '') as after from t
 where regexp_matches(ps[i], '^[A-Za-z_]') and ps[i] not in ('auto','break','case','char','const','continue','default','do','double','else','enum','extern','float','for','goto','if','int','long','register','return','short','signed','sizeof','static','struct','switch','typedef','union','unsigned','void','volatile','while')),
o0 as (select *, regexp_matches(before, '^\s*(?:(?:static|const|extern)\s+)*[A-Za-z_]\w*\s+\**$') and not regexp_matches(before, '^\s*return\b') as decl,
 length(regexp_replace(before, '[^(]', '', 'g')) - length(regexp_replace(before, '[^)]', '', 'g')) as depth,
 regexp_replace(regexp_replace(before, '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g') as bare from s
 where not regexp_matches(after, '^\s*\(') and not (regexp_matches(after, '^\s+\**[A-Za-z_]') and trim(before) = '')),
o1 as (select *, case when decl then 'declaration' when regexp_matches(before, '(^|[^&])&\s*$') then 'address' when regexp_matches(after, '^(\s*\[[^\]]*\])?\s*(=[^=]|[-+*/%&|^]=|<<=|>>=|\+\+|--)') then 'write'
 when depth > 0 and regexp_matches(bare, '\w\s*\([^()]*$') and not regexp_matches(bare, '\b(if|while|for|switch|return)\s*\(+[^()]*$') then 'parameter' else 'read' end as access from o0),
occ as (select pver_id, file_id, line_no, symbol, col_start, cast(col_start + length(symbol) as integer) as col_end, access, case when access in ('parameter', 'address') then regexp_extract(bare, '([A-Za-z_]\w*)\s*\([^()]*$', 1) end as callee, text as line_text from o1)
"""
register("x06_occurrences", "code_lines", sy.occurrences, _OCC + "select * from occ")
register("j10_wanted_tokens", "code_lines", lambda c: sy.wanted_tokens(sy.line_tokens(c), c.select(F.lit("idx_3").alias("symbol")).distinct()).select(*sy.LINE, "symbol", "col_start"), _OCC + "select pver_id, file_id, line_no, symbol, col_start from s where symbol = 'idx_3'")
register("a03_access_counts", "code_lines", lambda c: sy.access_counts(sy.occurrences(c)), _OCC + "select pver_id, symbol, count(*) filter (access = 'declaration') as n_declaration, count(*) filter (access = 'address') as n_address, count(*) filter (access = 'write') as n_write, count(*) filter (access = 'parameter') as n_parameter, count(*) filter (access = 'read') as n_read, count(*) as occurrence_count from occ group by 1, 2")
register("a05_passed_to", "code_lines", lambda c: sy.passed_to(sy.occurrences(c)), _OCC + "select distinct pver_id, symbol, callee, file_id, line_no, case when access = 'address' then 'address' else 'value' end as mode from occ where access in ('parameter', 'address') and callee <> ''")
register("w07_sample_occurrences", "code_lines", lambda c: sy.sample_occurrences(sy.occurrences(c)).select("pver_id", "symbol", "file_id", "line_no", "col_start", "rn", "total"), _OCC + ", r as (select *, cast(row_number() over (partition by pver_id, symbol order by file_id, line_no, col_start) as integer) as rn, count(*) over (partition by pver_id, symbol) as total from occ) select pver_id, symbol, file_id, line_no, col_start, rn, total from r where total <= 80 or rn <= 40 or rn > total - 40")
_FR = r""", d as (select *, sum(length(regexp_replace(text, '[^{]', '', 'g')) - length(regexp_replace(text, '[^}]', '', 'g'))) over (partition by pver_id, file_id order by line_no) as d from code_lines),
d2 as (select *, d - least(0, min(d) over (partition by pver_id, file_id order by line_no)) as depth from d), d3 as (select *, coalesce(lag(depth) over (partition by pver_id, file_id order by line_no), 0) as bf from d2),
d4 as (select *, sum(case when bf = 0 and depth > 0 then 1 else 0 end) over (partition by pver_id, file_id order by line_no) as body from d3),
fr as (select pver_id, file_id, cast(body as bigint) as body, min(line_no) as start_line, max(line_no) as end_line, arg_min(text, line_no) as sig_text from d4 where depth > 0 or bf > 0 group by 1, 2, 3)
"""
_INT = lambda df: df.withColumns({c: F.col(c).cast("long") for c in ("start_line", "end_line", "body") if c in df.columns})
register("w04_function_ranges", "code_lines", lambda c: _INT(sy.function_ranges(c)), _FR + "select * from fr")
register("j04_enclosing_function", "code_lines", lambda c: sy.enclosing_function(c, sy.function_ranges(c)), _FR + "select c.pver_id, c.file_id, c.line_no, coalesce('body_' || fr.body, 'global') as fn from code_lines c left join fr on c.pver_id = fr.pver_id and c.file_id = fr.file_id and c.line_no between start_line and end_line")
_BODY = " left join fr on {0}.pver_id = fr.pver_id and {0}.file_id = fr.file_id and {0}.line_no between fr.start_line and fr.end_line"
_OF = _OCC + _FR + ", ow as (select occ.*, coalesce('body_' || body, 'global') as fn from occ" + _BODY.format("occ") + ")\n"
_occ = lambda c: sy.occurrences(c, sy.function_ranges(c))
register("a04_used_in", "code_lines", lambda c: sy.used_in(_occ(c)), _OF + ", uf as (select pver_id, symbol, file_id, fn, min((line_no, col_start)) as f from ow group by 1, 2, 3, 4) select pver_id, symbol, row_number() over (partition by pver_id, symbol order by file_id, f) as place, file_id, fn from uf")
_wide = lambda c: sy.line_tokens(sy.lines_in_functions(c, sy.function_ranges(c))).select("pver_id", "symbol", "file_id", "fn")
_A12 = _OF + ", tk as (select distinct s.pver_id, symbol, s.file_id, coalesce('body_' || body, 'global') as fn from s" + _BODY.format("s") + "), rw as (select pver_id, symbol, file_id, fn, count(*) as uses, string_agg(distinct access, ',' order by access) as accesses from ow group by 1, 2, 3, 4)\n"
register("a12_function_rows", "code_lines", lambda c: sy.function_rows(_occ(c), _wide(c)), _A12 + "select * from rw union all select tk.*, 1, '' from tk where not exists (select 1 from rw where rw.pver_id = tk.pver_id and rw.symbol = tk.symbol and rw.file_id = tk.file_id and rw.fn = tk.fn)")
register("a13_access_filter", "code_lines", lambda c: sy.access_filter(sy.function_rows(_occ(c)), "without_read"), _A12 + "select * from rw where not regexp_matches(accesses, '(^|,)read(,|$)')")
_NM = r"'(idx_\d+)'"
register("j06_nearest_span", "code_lines", lambda c: _INT(sy.nearest_span(c.select(*sy.LINE, F.regexp_extract("text", r"(idx_\d+)", 1).alias("fn")).where("fn <> ''"), sy.function_ranges(c).withColumn("fn", F.regexp_extract("sig_text", r"(idx_\d+)", 1)))), _FR + f""", sp as (select *, regexp_extract(sig_text, {_NM}, 1) as fn from fr), rf as (select pver_id, file_id, line_no, regexp_extract(text, {_NM}, 1) as fn from code_lines where regexp_matches(text, {_NM}))
select rf.pver_id, rf.file_id, rf.line_no, rf.fn, arg_min(body, (abs(floor((start_line + end_line) / 2.0) - rf.line_no), start_line)) as body from rf join sp on rf.pver_id = sp.pver_id and rf.file_id = sp.file_id and rf.fn = sp.fn group by 1, 2, 3, 4""")


def _uses(c: DataFrame) -> DataFrame:
    reads = sy.occurrences(c).where("access = 'read'").select(*sy.LINE, "symbol", "line_text").distinct()
    return sy._with_span(reads, sy.function_ranges(c)).select(*sy.LINE, "symbol", F.col("near.start_line").alias("start_line"), F.col("near.end_line").alias("end_line"), F.regexp_extract_all("line_text", F.lit(r"(\d+u)"), 1).alias("tokens")).distinct()


_decls = lambda c: sy.occurrences(c).where("access = 'declaration'").select(*sy.LINE, "symbol", F.regexp_extract("line_text", r"^\s*(\w+)", 1).alias("datatype"), F.col("line_text").alias("d_text"), F.lit("").alias("dims"), F.lit(None).cast("string").alias("owner"))
register("j05_resolve_declaration", "code_lines", lambda c: sy.resolve_declaration(_uses(c), _decls(c)), _OCC + _FR + r""", u as (select distinct o.pver_id, o.file_id, o.symbol, o.line_no, start_line, end_line, regexp_extract_all(line_text, '(\d+u)', 1) as tk from occ o""" + _BODY.format("o") + r""" where access = 'read'),
dl0 as (select pver_id, file_id, symbol, line_no as dl, regexp_extract(line_text, '^\s*(\w+)', 1) as datatype, line_text as d_text from occ where access = 'declaration'),
j1 as (select u.*, dl, datatype, d_text, coalesce(dl between start_line and end_line, false) as i from u join dl0 using (pver_id, file_id, symbol)),
j2 as (select *, max(i) over w as mi, dl <= line_no as h from j1 window w as (partition by pver_id, file_id, symbol, line_no)), j3 as (select *, max(h) over (partition by pver_id, file_id, symbol, line_no) as mh from j2 where i = mi),
j4 as (select *, case when len(tk) > 0 then 5 * len(list_filter(tk, lambda x: list_contains(regexp_split_to_array(lower(d_text), '[^a-z0-9]+'), x))) else 0 end as score from j3 where h = mh)
select pver_id, file_id, symbol, line_no, max(score) as score, arg_max(dl, (score, dl)) as d_line, arg_max(datatype, (score, dl)) as datatype, '' as dims, cast(null as string) as owner, arg_max(d_text, (score, dl)) as d_text from j4 group by 1, 2, 3, 4""")
_indexed = lambda c: c.select(*sy.LINE, F.regexp_extract("text", r"\[(idx_\d+)\]", 1).alias("index")).where("index <> ''").withColumn("array_size", F.lit(17))
register("j11_local_guard", "code_lines", lambda c: sy.local_guard(_indexed(c), sy.function_ranges(c), c), _FR + r""", a as (select pver_id, file_id, line_no, regexp_extract(text, '\[(idx_\d+)\]', 1) as ix from code_lines where regexp_matches(text, '\[(idx_\d+)\]')), af as (select a.*, start_line from a join fr on a.pver_id = fr.pver_id and a.file_id = fr.file_id and a.line_no between start_line and end_line)
select af.pver_id, af.file_id, af.line_no, ix as "index", 17 as array_size, min(g.line_no) as guard_line, arg_min(trim(g.text), g.line_no) as guard_text from af join code_lines g on g.pver_id = af.pver_id and g.file_id = af.file_id and g.line_no between start_line and af.line_no
where regexp_matches(g.text, '""" + _GUARD + r"""') and contains(g.text, ix) and (contains(g.text, '17') or regexp_matches(g.text, '<\s*=?\s*\d+|&\s*0x[0-9A-Fa-f]+|%\s*\d+')) group by 1, 2, 3, 4""")
register("w12_cite_lines", "code_lines", lambda c: sy.cite_lines(c, keys=["pver_id"]), r""", h as (select pver_id, file_id, line_no, trim(text) as text from code_lines where trim(text) <> '}' and regexp_matches(text, '\[|if|while|for|switch|return|case|=')), r as (select *, row_number() over (partition by pver_id order by case when regexp_matches(text, '\[|if|<|>|sizeof') then 0 else 1 end, file_id, line_no) as rk from h)
select pver_id, file_id, line_no, text, cast(row_number() over (partition by pver_id order by file_id, line_no) as integer) as place from r where rk <= 36""")
register("w10_collapse_runs", "copy_lines", sy.collapse_indexed_runs, r""", s as (select pver_id, file_id, line_no, text, regexp_extract(text, '^(cfg\d_)', 1) as p, cast(regexp_extract(text, '_(\d+) =', 1) as bigint) as n, cast(regexp_extract(text, 'tab.(\d+)', 1) as bigint) as k from copy_lines where text <> 'break;' union all select pver_id, file_id, line_no, text, '', -1, -2 from copy_lines where text = 'break;'),
m as (select *, case when n = k and lag(n) over w = lag(k) over w and lag(p) over w = p and lag(n) over w + 1 = n then 0 else 1 end as nw from s window w as (partition by pver_id, file_id order by line_no)), r as (select *, sum(nw) over (partition by pver_id, file_id order by line_no) as run from m)
select pver_id, file_id, min(line_no) as line_no, count(*) as n_lines, case when count(*) > 1 then first(p) || '[' || min(n) || '..' || max(n) || ']=tab[' || min(n) || '..' || max(n) || ']' else first(text) end as text from r group by pver_id, file_id, run""")
_CONST = r", kc as (select pver_id, name, arg_min(cast(v as bigint), (file_id, line_no)) as value from (select *, regexp_extract(text, '(\w+)\s*=\s*(\d+)', 1) as name, regexp_extract(text, '(\w+)\s*=\s*(\d+)', 2) as v from code_lines) where name <> '' group by 1, 2)"
register("x04_constants", "code_lines", sy.extract_constants, _CONST + "select * from kc")
register("j09_constant_values", "code_lines", lambda c: sy.constant_values(c.select("pver_id", F.explode(F.array(F.lit("idx_1"), F.lit("idx_2___ab12"), F.lit("none"), F.lit("idx_3___ab"))).alias("name")).distinct(), sy.extract_constants(c)), _CONST + ", nm as (select distinct pver_id, unnest(['idx_1', 'idx_2___ab12', 'none', 'idx_3___ab']) as name from code_lines) select nm.pver_id, nm.name, kc.value from nm left join kc on kc.pver_id = nm.pver_id and kc.name = replace(nm.name, '___ab12', '')")
register("w11_line_context", "code_lines", sy.line_context, "select pver_id, file_id, line_no, concat_ws(chr(10), lag(text, 2) over w, lag(text, 1) over w, text) as lookback, lead(text) over w as next_text from code_lines window w as (partition by pver_id, file_id order by line_no)")
_code = lambda f: lambda c: c.select(*sy.LINE, f(F.col("text")).alias("v"))
register("p09_index_tokens", "code_lines", lambda c: _flat(_code(S.index_tokens)(c), "v"), r", e as (select pver_id, file_id, line_no, list_filter(regexp_extract_all(text, '(?:^|[^\w.])([A-Za-z_]\w*)', 1), lambda x: x not in ('if', 'return')) as l from code_lines) select pver_id, file_id, line_no, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') as v from e")
register("p10_ident_pieces", "code_lines", lambda c: _flat(_code(S.ident_pieces)(c), "v"), "select pver_id, file_id, line_no, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> ''))), ',') as v from code_lines")
register("p17_collapse_clip", "code_lines", _code(lambda t: S.clip(S.collapse_ws(t), 12)), r"select pver_id, file_id, line_no, case when length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 12 then left(trim(regexp_replace(text, '\s+', ' ', 'g')), 12) || '… [' || (length(trim(regexp_replace(text, '\s+', ' ', 'g'))) - 12) || ' more chars]' else trim(regexp_replace(text, '\s+', ' ', 'g')) end as v from code_lines")
register("p08_clean_index", "code_lines", _code(lambda t: S.clean_index(F.regexp_extract(t, r"\(.*", 0))), r""", e as (select pver_id, file_id, line_no, regexp_extract(text, '\(.*', 0) as t from code_lines), q as (select *, length(t) - length(replace(t, '(', '')) as o, length(t) - length(replace(t, ')', '')) as c, length(regexp_extract(t, '^\(*', 0)) as ld, length(regexp_extract(t, '\)*$', 0)) as tl from e),
r as (select *, greatest(0, least(o - c, ld)) as fr, greatest(0, least(c - o, tl)) as en from q) select pver_id, file_id, line_no, trim(regexp_replace(substring(t, fr + 1, length(t) - fr - en), '^\(([^()]*)\)$', '\1')) as v from r""")
register("p15_is_guard", "code_lines", _code(S.is_guard), "select pver_id, file_id, line_no, regexp_matches(text, '" + _GUARD + "') as v from code_lines")
register("p16_is_lhs_write", "code_lines", _code(lambda t: S.is_lhs_write(t, F.lit("idx_3"))), f"select pver_id, file_id, line_no, {_WRITE('text', 'idx_3')} as v from code_lines")
_NORMAL = r"regexp_replace(regexp_replace(regexp_replace(trim(text), '\b(\d+)u\b', '\1', 'g'), '(^|[^A-Za-z_0-9])\(\s*([\w.]+)\s*\)', '\1\2', 'g'), '\b(if|while|switch)\s+([^(].+)$', '\1 (\2)')"
register("p20_normalize_stmt", "code_lines", _code(S.normalize_stmt), f"select pver_id, file_id, line_no, {_NORMAL} as v from code_lines")
register("p21_is_noise", "code_lines", _code(S.is_noise), "select pver_id, file_id, line_no, trim(text) = '}' as v from code_lines")
register("a21_compression_stats", "code_lines", sy.compression_stats, f", n as (select pver_id, length(text) as a, case when trim(text) = '}}' then 0 else length({_NORMAL}) end as b from code_lines) select pver_id, cast(sum(a) as bigint) as original, cast(sum(b) as bigint) as compressed, round(sum(b) / sum(a), 3) as ratio from n group by 1")

# --- facts ---

_CASE = lambda values: "case kind " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " else 20 end"
_IN = lambda kinds: "(" + ", ".join(f"'{k}'" for k in kinds) + ")"
_cls = lambda f: f.where("kind in ('guard', 'write')").select("pver_id", "group_id", F.concat(F.lit("C"), F.col("line") % 3 + 1).alias("class_id"), "fn").distinct()
_shared = lambda f: f.where("kind = 'access' and line <= 20").select("pver_id", "group_id", "fn").distinct()
_C = lambda v: f", cf as (select distinct pver_id, group_id, 'C' || (line % 3 + 1) as class_id, fn from {v} where kind in ('guard', 'write')), sh as (select distinct pver_id, group_id, fn from {v} where kind = 'access' and line <= 20)\n"
_AT = lambda v: _C(v) + f", att as (select distinct f.pver_id, f.group_id, class_id, kind, f.fn, line, symbol, quote from {v} f join cf on f.pver_id = cf.pver_id and f.group_id = cf.group_id and f.fn = cf.fn union select distinct f.pver_id, f.group_id, class_id, kind, f.fn, line, symbol, quote from {v} f join sh on f.pver_id = sh.pver_id and f.group_id = sh.group_id and f.fn = sh.fn join (select distinct pver_id, group_id, class_id from cf) c on f.pver_id = c.pver_id and f.group_id = c.group_id)\n"
def _quotes(c: DataFrame) -> DataFrame:
    w = Window.partitionBy(*sy.FILE).orderBy("line_no")
    near = c.select(*sy.LINE, F.lag("text").over(w).alias("above"), F.concat_ws("  ", "text", F.lead("text").over(w)).alias("below"))
    return near.select(*sy.LINE, F.explode(F.array("above", "below")).alias("quote")).where("quote is not null")


_WIDE = ", wl as (select *, concat_ws(' ', lag(text) over w, text, lead(text) over w) as wide from code_lines window w as (partition by pver_id, file_id order by line_no))\n"
_by_file = lambda c: c.repartition(*sy.FILE)  # noqa: E731  (dealt once for all that is made of the lines)
register("j12_verify_quotes", "code_lines", lambda c: (lambda d: fa.verify_quotes(_quotes(d), d))(_by_file(c)), _WIDE + """, q as (select distinct * from (select pver_id, file_id, line_no, lag(text) over w as quote from code_lines window w as (partition by pver_id, file_id order by line_no) union all select pver_id, file_id, line_no, concat_ws('  ', text, lead(text) over w) from code_lines window w as (partition by pver_id, file_id order by line_no)) where quote is not null),
h as (select q.*, wl.line_no as fl, contains(text, replace(quote, '  ', ' ')) as ok, contains(wide, replace(quote, '  ', ' ')) as wd, case wl.line_no - q.line_no when 0 then 0 when -1 then 1 when 1 then 2 when -2 then 3 else 4 end as rk from q join wl on wl.pver_id = q.pver_id and wl.file_id = q.file_id and wl.line_no between q.line_no - 2 and q.line_no + 2)
select pver_id, file_id, line_no, quote, bool_or(ok or wd) as verified, arg_min(fl, rk) filter (ok) as found_line from h group by 1, 2, 3, 4""")
_guards = lambda f: f.where("kind = 'guard'").groupBy("pver_id", "group_id").agg(F.min(F.struct("line", "fn", "quote", "symbol")).alias("g")).select("pver_id", "group_id", "g.*")
register("u02_merge_packs", "facts", lambda f: fa.merge_packs(f, _guards(f)).select("pver_id", "group_id", "agent", "kind", "fn", "line", "quote", "seq"), """, gd as (select pver_id, group_id, min((line, fn, quote, symbol)) as g from facts where kind = 'guard' group by 1, 2), af as (select pver_id, group_id, agent, kind, fn, line, quote, symbol, seq, case when agent = 'call_path' then 0 else 1 end as pack from facts where verified
 union all select pver_id, group_id, 'var_value', 'local_guard', g[2], g[1], g[3], g[4], null, 2 from gd), r as (select *, row_number() over (partition by pver_id, group_id, line, kind, coalesce(symbol, ''), left(quote, 80) order by pack, seq, fn) as rn from af) select pver_id, group_id, agent, kind, fn, line, quote, seq from r where rn = 1""")
register("l03_order_facts", "facts", lambda f: fa.order_facts(f).select("pver_id", "group_id", "rank", "kind", "line", "fn"), f", r as (select *, cast(row_number() over (partition by pver_id, group_id order by {_CASE(fa.BRIEF_WEIGHT)} desc, line, fn, quote, seq, agent, verified) as integer) as rank from facts) select pver_id, group_id, rank, kind, line, fn from r")
register("j13_facts_by_class", "facts", lambda f: fa.facts_by_class(f, _cls(f), _shared(f)), _AT("facts") + "select * from att")
register("j13_unattached", "order_facts", lambda f: fa.unattached_facts(f.where("verified"), _cls(f), _shared(f)).select("pver_id", "group_id", "kind", "fn", "line").distinct(), _C("order_facts") + "select distinct pver_id, group_id, kind, fn, line from order_facts f where verified and not exists (select 1 from cf where cf.pver_id = f.pver_id and cf.group_id = f.group_id and cf.fn = f.fn) and not exists (select 1 from sh where sh.pver_id = f.pver_id and sh.group_id = f.group_id and sh.fn = f.fn)")
_found = lambda f, c: c.select("pver_id", F.col("file_id").alias("group_id"), "file_id", F.lit("").alias("fn"), (F.col("line_no") + 1).alias("line"), F.col("text").alias("quote")).unionByName(f.where("not verified").select("pver_id", "group_id", F.col("group_id").alias("file_id"), "fn", "line", F.substring("quote", 1, 6).alias("quote")))
register("j14_supported_findings", "order_facts code_lines", lambda f, c: (lambda d: fa.supported_findings(_found(f, d), f.where("verified"), d))(_by_file(c)), _WIDE + """, a as (select distinct * from (select pver_id, file_id as group_id, file_id, '' as fn, line_no + 1 as line, text as quote from code_lines union all select pver_id, group_id, group_id, fn, line, left(quote, 6) from order_facts where not verified)),
bf as (select distinct a.* from a join order_facts k on k.verified and k.pver_id = a.pver_id and k.group_id = a.group_id and k.line = a.line where (a.fn = '' or k.fn = a.fn) and (contains(k.quote, trim(a.quote)) or contains(trim(a.quote), k.quote))),
bs as (select distinct a.* from a join wl on wl.pver_id = a.pver_id and wl.file_id = a.file_id where wl.line_no between a.line - 2 and a.line + 2 and (contains(wl.text, trim(quote)) or contains(wide, trim(quote))))
select a.*, case when bf.quote is not null then 'fact' when bs.quote is not null then 'source' end as how from a left join bf using (pver_id, group_id, file_id, fn, line, quote) left join bs using (pver_id, group_id, file_id, fn, line, quote)""")
_packs = lambda f: fa.compact_pack(f.where("agent = 'call_path'"), "call_path").unionByName(fa.compact_pack(f.where("agent = 'var_value'")))
register("w08_compact_pack", "facts", lambda f: _packs(f).select("pver_id", "group_id", "agent", "rn", "kind", "fn", "line", "symbol"), f""", al as (select * from facts where (agent = 'call_path' and kind in {_IN(fa.CALL_KINDS)}) or (agent = 'var_value' and kind in {_IN(fa.VALUE_KINDS)})), a as (select *, row_number() over (partition by pver_id, group_id, agent, fn, line, kind, left(symbol, 40) order by verified desc, {_CASE(fa.PACK_RANK)}, line, seq, fn, quote) as d from al),
b as (select *, row_number() over (partition by pver_id, group_id, agent order by verified desc, {_CASE(fa.PACK_RANK)}, line, seq, fn, quote) as rn from a where d = 1),
c as (select *, row_number() over (partition by pver_id, group_id, agent, kind, symbol order by rn) as again from b), e as (select * exclude (rn), cast(row_number() over (partition by pver_id, group_id, agent order by rn) as integer) as rn from c where not (kind = 'declaration' and again > 1 and rn - 1 > 24)) select pver_id, group_id, agent, rn, kind, fn, line, symbol from e where rn <= 48""")
register("w09_trim_brief", "facts", lambda f: fa.trim_brief(fa.order_facts(f), 400), f"""--recursive, r as (select *, row_number() over (partition by pver_id, group_id order by {_CASE(fa.BRIEF_WEIGHT)} desc, line, fn, quote, seq, agent, verified) as rank from facts), s as (select pver_id, group_id, rank, sum(length(concat_ws('|', kind, fn, line, quote))) over (partition by pver_id, group_id order by rank) as reach from r),
n as (select pver_id, group_id, count(*) as n from facts group by 1, 2), t(pver_id, group_id, n, k) as (select pver_id, group_id, n, n from n union select pver_id, group_id, n, greatest(8, cast(floor(k * 0.75) as bigint)) from t where k > 8)
select t.pver_id, t.group_id, n as n_facts, max(k) filter (reach <= 400 or k <= 8) as n_kept from t join s on s.pver_id = t.pver_id and s.group_id = t.group_id and s.rank = k group by 1, 2, 3""")
register("a16_compact_facts", "facts", lambda f: fa.compact_facts(fa.facts_by_class(f, _cls(f), _shared(f)), f, _cls(f).groupBy("pver_id", "group_id").agg(F.countDistinct("class_id").alias("n"))), _AT("facts") + """, n as (select pver_id, group_id, count(distinct class_id) as n from cf group by 1, 2), g as (select pver_id, group_id, line, kind, symbol, left(quote, 80) as quote80, count(distinct class_id) as c, coalesce(string_agg(distinct class_id, ',' order by class_id), '') as ids from (select pver_id, group_id, line, kind, symbol, quote, class_id from att union all select pver_id, group_id, line, kind, symbol, quote, null from facts) group by 1, 2, 3, 4, 5, 6)
select g.pver_id, g.group_id, line, kind, symbol, quote80, case when c = n then 'all' else ids end as classes from g left join n using (pver_id, group_id)""")
_symbols = lambda f: f.select("pver_id", "group_id", "symbol").distinct().select("*", F.col("symbol").isin("idx_0", "idx_1").alias("is_array"), F.col("symbol").isin("idx_2", "idx_3").alias("is_index"), (F.col("group_id") % 4 == 0).alias("declared"), (F.col("group_id") % 5 == 0).alias("sized"), (F.col("group_id") % 3 == 0).alias("local"))
register("a17_unclear_symbols", "order_facts", lambda f: fa.unclear_symbols(_symbols(f), f), """, s as (select pver_id, group_id, symbol, bool_or(kind = 'declaration') as d, bool_or(kind in ('write', 'arg_binding')) as w, bool_or(kind in ('guard', 'clamp', 'mask', 'loop_bound', 'local_guard')) as b, bool_or(kind = 'array_size_hint') as z from order_facts group by 1, 2, 3),
r as (select *, case when symbol in ('idx_0', 'idx_1') and not z and group_id % 5 <> 0 then 'array_size_unknown' when symbol in ('idx_2', 'idx_3') and not b and not w and group_id % 3 <> 0 then 'index_value_unclear' when not d and group_id % 4 <> 0 and not w and not b then 'no_decl_or_write' end as reason from s)
select pver_id, group_id, symbol, reason from r where reason is not null""")
_alarms = lambda c: c.select("pver_id", F.col("file_id").alias("group_id")).distinct().select("*", F.lit("arr_3").alias("array"), F.lit("idx_3").alias("index"), F.lit(3).alias("alarm_line"))
register("x12_mine_facts", "code_lines", lambda c: fa.mine_facts(_alarms(c), c.select("pver_id", F.col("file_id").alias("group_id"), "line_no", "text")), r"""select pver_id, file_id as group_id, line_no, case when line_no = 3 then 'alarm_site' else 'access' end as kind, case when contains(text, 'idx_3') then 'idx_3' else 'arr_3' end as symbol, text as quote from code_lines where regexp_matches(text, '\barr_3\s*\[\s*[^\]\s]')
 union all select pver_id, file_id, line_no, 'guard', 'idx_3', text from code_lines where contains(text, 'idx_3') and regexp_matches(text, '""" + _MINED + r"""') and not contains(right(split_part(text, 'idx_3', 1), 3), '[') and regexp_matches(text, '\b(if|while|for|switch)\b|\bidx_3\b\s*(<|>|==|!=)')
 union all select pver_id, file_id, line_no, 'write', 'idx_3', text from code_lines where """ + _WRITE("text", "idx_3"))
_steps = lambda f: f.select("pver_id", F.col("block_no").alias("group_id"), F.concat(F.lit("C"), F.col("pos") % 2 + 1).alias("class_id"), "pos", S.bare_fn(S.frame_fn(F.col("entry"))).alias("fn"))
_own = lambda f: f.select("pver_id", F.col("block_no").alias("group_id")).distinct().withColumn("fn", F.lit("fn_7"))
_X15 = r""", st as (select pver_id, block_no as group_id, 'C' || (pos % 2 + 1) as class_id, pos, regexp_extract(entry, '^call#([^ |]*)', 1) as fn from frames), ow as (select distinct pver_id, block_no as group_id, 'fn_7' as fn from frames),
u as (select pver_id, group_id, fn, 0 as s, class_id as c, pos as p from st union all select pver_id, group_id, fn, 1, '', 0 from ow), m as (select pver_id, group_id, fn, min((s, c, p)) as r from u group by 1, 2, 3), cp as (select pver_id, group_id, fn, cast(row_number() over (partition by pver_id, group_id order by r, fn) as integer) as place from m)
"""
register("x15_visit_sequence", "frames", lambda f: fa.visit_sequence(_steps(f), _own(f)), _X15 + "select * from cp")
_used = lambda f: f.groupBy("pver_id", "group_id", "symbol", F.when(F.col("line") % 4 == 0, "global").otherwise(F.col("fn")).alias("fn")).agg(F.min("line").alias("place"))
_origin = lambda f: _own(f).withColumn("index_origin", F.when(F.col("group_id") % 2 == 0, "local").otherwise("parameter"))
_SY = ", us as (select pver_id, group_id, symbol, case when line % 4 = 0 then 'global' else fn end as fn, min(line) as place from order_facts group by 1, 2, 3, 4)\n"
register("x15_value_sequence", "frames order_facts", lambda f, o: fa.value_sequence(_origin(f), o.where("kind = 'call_edge'").groupBy("pver_id", "group_id", "fn").agg(F.min("seq").alias("place")), _used(o), fa.visit_sequence(_steps(f), _own(f)), 6), _X15 + _SY + """, v as (select pver_id, group_id, fn, 0 as s, 0 as p from ow union all select pver_id, group_id, fn, 1, min(seq) from order_facts where kind = 'call_edge' group by 1, 2, 3 union all select pver_id, group_id, fn, 2, place from us union all select pver_id, group_id, fn, 3, place from cp where group_id % 2 = 1),
w as (select pver_id, group_id, fn, min((s, p)) as r from v where fn <> 'global' group by 1, 2, 3), z as (select pver_id, group_id, fn, cast(row_number() over (partition by pver_id, group_id order by r, fn) as integer) as place from w) select * from z where place <= 6""")
register("x15_symbol_chains", "frames order_facts", lambda f, o: fa.symbol_chains(_used(o).withColumn("place", F.row_number().over(Window.partitionBy("pver_id", "group_id", "symbol").orderBy("place", "fn"))), _own(f)), _X15 + _SY + """, nm as (select *, row_number() over (partition by pver_id, group_id, symbol order by place, fn) as pl from us), inn as (select pver_id, group_id, symbol, fn, pl from nm where fn <> 'global'), al as (select * from inn union all select distinct us.pver_id, us.group_id, us.symbol, ow.fn, 1 from us join ow using (pver_id, group_id) where not exists (select 1 from inn where inn.pver_id = us.pver_id and inn.group_id = us.group_id and inn.symbol = us.symbol)),
k as (select pver_id, group_id, symbol, cast(row_number() over w as integer) as step, fn as source, lead(fn) over w as target from al window w as (partition by pver_id, group_id, symbol order by pl)) select * from k where target is not null or step = 1""")
register("w05_merge_windows", "facts", lambda f: fa.merge_windows(f.where("kind = 'guard'"), ["pver_id", "group_id"]).withColumn("island", F.col("island").cast("long")), """, s as (select distinct pver_id, group_id, greatest(1, line - 3) as s, line + 3 as e from facts where kind = 'guard'), m as (select *, case when s > max(e) over (partition by pver_id, group_id order by s, e rows between unbounded preceding and 1 preceding) + 1 then 1 when row_number() over (partition by pver_id, group_id order by s, e) = 1 then 1 else 0 end as nw from s),
i as (select *, sum(nw) over (partition by pver_id, group_id order by s, e) as island from m) select pver_id, group_id, cast(island as bigint) as island, min(s) as start_line, max(e) as end_line from i group by 1, 2, 3""")
# --- verdicts ---

_LST = lambda c: f"list_filter(string_split({c}, ','), lambda x: x <> '')"
_WHY = """concat_ws(';', case when tp_claim = 'tp' and tp_witness = 'found' then 'tp witness found' end, case when fp_claim <> 'fp' then 'no fp claim' end, case when coverage <> 'full' then 'coverage not full' end,
 case when unaddressed <> '' then 'classes unaddressed' end, case when fp_error <> '' then 'prover error' end, case when index_range = 'unknown' then 'index range unknown' end,
 case when array_size <> 'known' then 'array size unknown' end, case when fp_witness = 'found' then 'fp witness found' end, case when n_findings = 0 then 'no findings' end,
 case when n_missing > 0 then 'evidence missing' end, case when merged_coverage = 'partial' then 'merged coverage partial' end, case when coverage_cap = 'partial' then 'coverage capped' end,
 case when classes <> '' and addressed <> classes and (addressed = '' or starts_with(classes, addressed || ',')) then 'classes not addressed' end, case when not has_bound and index_range <> 'constant' then 'no bound' end)"""
_R = f", r0 as (select *, {_WHY} as why from prove_reports), r as (select *, why = '' as ok, case when tp_error <> '' and fp_error <> '' then 'uncertain' when tp_claim = 'tp' and tp_witness = 'found' then 'TP' when fp_claim = 'fp' and why = '' then 'FP' else 'none' end as gate from r0)\n"
register("p23_fp_reasons", "prove_reports", lambda r: r.select("pver_id", "group_id", F.array_join(ve.fp_reasons(), ";").alias("reasons"), (F.size(ve.fp_reasons()) == 0).alias("ironclad")), _R + "select pver_id, group_id, why as reasons, ok as ironclad from r")
register("p24_hard_gate", "prove_reports", ve.hard_gate, _R + "select pver_id, group_id, gate, why as reasons from r")
_V = _R + """, v as (select v.*, coalesce(ok, false) as ok, coalesce(tp_claim = 'tp', false) as tc, coalesce(tp_witness = 'found', false) as wi, coalesce(gate, 'none') as gate from votes v left join r using (pver_id, group_id)),
k as (select *, case when tc and wi then 'TP' when label = 'FP' and not ok then case when tc then 'TP' else 'uncertain' end else label end as clamped from v)
"""
register("p25_clamp_vote", "votes prove_reports", lambda v, r: ve.clamp_vote(v, r).select("pver_id", "group_id", "run", "label", "clamped"), _V + "select pver_id, group_id, run, label, clamped from k")
register("p26_coerce_report", "prove_reports", lambda r: ve.coerce_report(r.withColumns({"fp_claim": F.when(F.col("group_id") % 4 == 1, "tp").otherwise(F.upper("fp_claim")), "tp_claim": F.upper("tp_claim"), "array_size": F.when(F.col("group_id") % 3 == 0, "big").otherwise(F.initcap("array_size")), "coverage": F.when(F.col("group_id") % 5 == 0, "odd").otherwise(F.col("coverage"))})).select("pver_id", "group_id", "fp_claim", "tp_claim", "index_range", "array_size", "coverage", "fp_witness", "tp_witness", "empty_report"), """
select pver_id, group_id, case when group_id % 4 = 1 then 'no_credible_case' else fp_claim end as fp_claim, tp_claim, index_range, case when group_id % 3 = 0 then 'unknown' else array_size end as array_size, case when group_id % 5 = 0 then 'partial' else coverage end as coverage, fp_witness, tp_witness,
 rationale = ' ' and n_findings = 0 and n_missing = 0 and addressed = '' as empty_report from prove_reports""")
register("a18_final_verdict", "votes prove_reports", ve.final_verdict, _V + """, n as (select pver_id, group_id, clamped, count(*) as c, min(run) as fi from k group by 1, 2, 3), f as (select pver_id, group_id, arg_max(clamped, (c, -fi)) as lead, max(c) as top from n group by 1, 2), tt as (select pver_id, group_id, count(*) as ties from n join f using (pver_id, group_id) where c = top group by 1, 2),
g as (select pver_id, group_id, count(*) as n, count(*) filter (clamped = 'TP') as tp, count(*) filter (clamped = 'FP') as fp, count(*) filter (clamped = 'uncertain') as uncertain, first(ok) as ok, first(tc) as tc, first(wi) as wi, first(gate) as gate, bool_or(reexplore and clamped = 'uncertain') as asked from k group by 1, 2),
w as (select g.*, case when fp > 0 and ok and 2 * fp >= n then 'FP' when fp > 0 and not ok then case lead when 'FP' then 'uncertain' else lead end when ties > 1 then case when tp > 0 and (wi or tc) then 'TP' else 'uncertain' end else lead end as won from g join f using (pver_id, group_id) join tt using (pver_id, group_id)),
z as (select *, case when gate <> 'none' then gate when tc and wi then 'TP' when won = 'FP' and not ok then case when tc then 'TP' else 'uncertain' end else won end as label from w)
select pver_id, group_id, n, tp, fp, uncertain, label, asked and label = 'uncertain' and gate = 'none' as reexplore from z""")
_U3 = lambda src: f""", u0 as (select *, list_filter({_LST('addressed')}, lambda x: list_contains({_LST('classes')}, x)) as gv, {_LST('classes')} as cl from {src}), u1 as (select *, index_origin = 'local' and len(gv) > 0 and n_findings > 0 as closes from u0),
u as (select * replace (case when (not closes and len(list_filter(cl, lambda x: not list_contains(gv, x))) > 0) or merged_coverage = 'partial' then 'partial' else coverage end as coverage, array_to_string(case when closes then cl else gv end, ',') as addressed,
 array_to_string(case when closes then [] else list_filter(cl, lambda x: not list_contains(gv, x)) end, ',') as unaddressed) from u1)
"""  # noqa: E731
register("u03_class_coverage", "prove_reports", lambda r: ve.class_coverage(r).select("pver_id", "group_id", "coverage", "addressed", "unaddressed"), _U3("prove_reports") + "select pver_id, group_id, coverage, addressed, unaddressed from u")
register("u04_validate_reports", "prove_reports findings", ve.validate_reports, """, c as (select pver_id, group_id, count(*) filter (agent = 'FP_PROVE' and supported) as fp_kept, count(*) filter (agent = 'FP_PROVE' and not supported) as fp_lost, count(*) filter (agent = 'TP_PROVE' and supported) as tp_kept, count(*) filter (agent = 'TP_PROVE' and not supported) as tp_lost from findings group by 1, 2),
b0 as (select p.* exclude (n_findings), coalesce(fp_kept, 0) as n_findings, coalesce(fp_kept, 0) as fp_kept, coalesce(fp_lost, 0) as fp_lost, coalesce(tp_kept, 0) as tp_kept, coalesce(tp_lost, 0) as tp_lost, tp_claim = 'tp' and tp_witness = 'found' and coalesce(tp_kept, 0) = 0 as cleared from prove_reports p left join c using (pver_id, group_id)),
b1 as (select * replace (case when cleared then 'none' else tp_witness end as tp_witness) from b0), b2 as (select *, tp_claim = 'tp' and tp_witness <> 'found' as down from b1), b3 as (select * replace (case when down then 'no_credible_case' else tp_claim end as tp_claim) from b2)""" + _U3("b3") + f""", x as (select *, fp_claim = 'fp' and {_WHY} <> '' as soft from u)
select pver_id, group_id, tp_claim, case when soft then 'no_credible_case' else fp_claim end as fp_claim, tp_witness, coverage, addressed, unaddressed, fp_kept, fp_lost, tp_kept, tp_lost,
 concat_ws(';', case when tp_error <> '' then 'tp prover failed' end, case when fp_error <> '' then 'fp prover failed' end, case when tp_lost > 0 then 'tp findings' end, case when fp_lost > 0 then 'fp findings' end, case when cleared then 'tp witness' end, case when down then 'tp claim' end, case when soft then 'fp claim' end) as dropped from x""")
register("a19_score", "expert_labels", ve.score, """, e as (select case when lower(human_label) in ('true', 'tp') then 'TP' when lower(human_label) in ('false', 'fp') then 'FP' end as h, prediction as p, case when contains(comment, 'TOOL') then 'tool' else 'person' end as reviewer from expert_labels)
select reviewer, count(*) as n, count(*) filter (h = 'TP' and p = 'TP') as tp_tp, count(*) filter (h = 'FP' and p = 'FP') as fp_fp, count(*) filter (h = 'TP' and p = 'FP') as wrong_fp, count(*) filter (h = 'FP' and p = 'TP') as wrong_tp, count(*) filter (p = 'uncertain') as uncertain,
 round(count(*) filter (h = 'TP' and p = 'TP') / greatest(count(*) filter (h = 'TP'), 1), 6) as recall_tp, round(count(*) filter (h = 'FP' and p = 'FP') / greatest(count(*) filter (h = 'FP'), 1), 6) as recall_fp from e where h is not null group by 1""")

register("a20_run_report", "runs", ve.run_report, "select pver_id, count(*) as orders, count(*) filter (status = 'done') as completed, count(*) filter (status = 'error') as errors, count(*) filter (label = 'TP') as tp, count(*) filter (label = 'FP') as fp, count(*) filter (label = 'uncertain') as uncertain, cast(sum(calls) as bigint) as calls, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out, epoch_us(max(ended)) - epoch_us(min(started)) as wall_micros from runs group by 1")

# --- streams (batch twins) ---

_LAST = lambda v, cond, name: f"arg_max({v}, (ts, event_id)) filter ({cond}) as {name}"
_VF = "coalesce(case when agent = 'VAR_VALUE_EXPLORE' then cursor end, var_focus)"
register("t02_focus_state", "run_events", ev.focus_state, "select pver_id, order_key, " + ", ".join(_LAST(c, f"{c} is not null", c) for c in ("agent", "activity", "functions", "edges", "call_path", "var_paths")) + ", " + _LAST(_VF, f"{_VF} is not null", "var_focus") + ", " + ", ".join(_LAST("cursor", f"cursor is not null and agent = '{a}'", f"cursor_{a.lower()}") for a in ev.AGENTS) + ", count(*) as n from run_events group by 1, 2")
register("t03_job_status", "run_events", ev.job_status, "select pver_id, order_key, count(*) as n, arg_max(title, (ts, event_id)) filter (title is not null) as message, coalesce(arg_max(case when kind = 'done' then 'done' else 'error' end, (ts, event_id)) filter (kind in ('done', 'agent_error')), 'running') as state from run_events group by 1, 2")
_opens = lambda e: e.select("pver_id", "order_key", "ts", "event_id", F.col("activity").alias("fn"), (F.col("kind") == "agent_output").alias("is_submit"), (F.col("event_id") % 3).alias("n_facts"))
_needed = lambda e: e.select("pver_id", "order_key").distinct().withColumn("fns", F.array(F.lit("act_1"), F.lit("act_2")))
_GATE_SQL = """, o as (select *, kind = 'agent_output' as sub from run_events), w as (select *, count(*) filter (not sub and activity = 'act_1') over q as a, count(*) filter (not sub and activity = 'act_2') over q as b from o window q as (partition by pver_id, order_key order by ts, event_id rows unbounded preceding))
select pver_id, order_key, event_id, a > 0 and b > 0 and event_id % 3 > 0 as accepted, concat_ws(',', case when a = 0 then 'act_1' end, case when b = 0 then 'act_2' end) as remaining from w where sub"""
register("t04_visit_gate", "run_events", lambda e: ev.visit_gate(_opens(e), _needed(e)), _GATE_SQL)


def _gated(e: DataFrame) -> DataFrame:
    """T04 as a stream: the older half of the events first, then, by a stream that starts again from the state, the rest."""
    spark, path = e.sparkSession, new_path(e.sparkSession, "gate")
    opens, needed = _opens(e), _needed(e)
    ends = e.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    middle = F.lit(ends["low"] + (ends["high"] - ends["low"]) / 2) if ends["low"] else F.lit(None).cast("timestamp_ntz")
    name, provider = ev.STATE_STORE
    before = spark.conf.get(name)
    spark.conf.set(name, provider)
    try:
        for older in (True, False):
            opens.where((F.col("ts") <= middle) == F.lit(older)).write.mode("append").parquet(f"{path}/in")
            gate = ev.visit_gate_stream(spark.readStream.schema(opens.schema).parquet(f"{path}/in"), needed)
            gate.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema("pver_id string, order_key string, event_id long, accepted boolean, remaining string").parquet(f"{path}/out")


register("t04_gate_stream", "run_events", _gated, _GATE_SQL)
register("l04_tail_events", "run_events", lambda e: ev.tail_events(e, 5).select("event_id", "pver_id", "order_key", "rank"), ", r as (select *, cast(row_number() over (partition by pver_id, order_key order by ts desc, event_id desc) as integer) as rank from run_events) select event_id, pver_id, order_key, rank from r where rank <= 5")

# --- C files ---

_CF = r""", c as (select pver_id, file_id, text, string_split(text, chr(10)) as ls, regexp_extract(text, '(fn_\d+)\(uint8 par', 1) as fn, regexp_extract(text, '(par_\d+), const', 1) as par,
 regexp_extract(text, 'uint16 (tab_\d+)', 1) as tab, regexp_extract(text, 'uint8 (f_\d+)', 1) as mem, regexp_extract(text, '= (fn_\d+)\(&loc', 1) as callee, regexp_extract(text, 'define (SZ_\d+)', 1) as sz,
 cast(regexp_extract(text, 'SZ_\d+ (\d+)u', 1) as bigint) as n, regexp_extract(text, '(fn_p\d+)', 1) as proto, regexp_extract(text, 'uint8 loc = (\w+);', 1) as src from c_files)
"""
_lines = en.text_lines
_points = lambda c: _lines(c).where("line_no in (14, 16)").select(*sy.LINE, F.instr("text", "[").alias("col"))


def _spread(texts: DataFrame) -> DataFrame:
    """Texts dealt over the tasks: the given tables are single files, and a scan of texts is the work here."""
    return many(checkpoint(texts.repartition(*sy.FILE)))


def _parsed(texts: DataFrame, *columns: str) -> DataFrame:
    """The functions of all files (if columns are named, these), scanned once."""
    functions = co.extract_functions(texts)
    return many(checkpoint(functions.select(*sy.FILE, *columns) if columns else functions))


def _origins(texts: DataFrame, token: str) -> DataFrame:
    texts = _spread(texts)
    functions = _parsed(texts)
    starts = functions.where("defined").select(*sy.FILE, "fn", F.lit(token).alias("token"))
    return co.index_origin(starts, co.extract_assignments(functions), co.extract_parameters(functions), co.extract_declarations(texts), functions)


def _sources(texts: DataFrame, token: str) -> DataFrame:
    texts = _spread(texts)
    functions = _parsed(texts)
    starts = functions.where("defined").select(*sy.FILE, "fn", F.lit(token).alias("token"))
    return co.value_origins(starts, co.extract_assignments(functions), functions, co.extract_parameters(functions))


_starts = lambda c: co.extract_functions(c).where("defined").select(*sy.FILE, "fn", F.lit("loc").alias("token"))
register("x01_functions", "c_files", lambda c: co.extract_functions(c).where("defined").select(*sy.FILE, "fn", "start_line", "end_line", "sig_line", "sig_text"), _CF + "select pver_id, file_id, fn, 10 as start_line, 17 as end_line, 9 as sig_line, ls[9] as sig_text from c")
register("x02_calls", "c_files", lambda c: co.extract_calls(co.extract_functions(c)), _CF + "select pver_id, file_id, fn as caller, callee, 1 as pos from c union all select pver_id, file_id, fn, replace(fn, 'fn_', 'cb_'), 2 from c")
register("x02_prototypes", "c_files", lambda c: co.extract_functions(c).where("not defined").select(*sy.FILE, "fn", "sig_line"), _CF + "select pver_id, file_id, proto as fn, 8 as sig_line from c")
register("x03_declarations", "c_files", co.extract_declarations, _CF + """select pver_id, file_id, unnest([tab, mem, 'loc', 'rows']) as symbol, unnest(['uint16', 'uint8', 'uint8', 'row_t']) as datatype, false as macro, 0 as pointer_depth,
 unnest(['[' || sz || '*2+1][2]', '[3]', '', '']) as dims, unnest([4, 6, 11, 12]) as line_no, unnest([null, 'S', null, null]) as owner from c""")
register("x04_defines", "c_files", co.extract_defines, _CF + "select pver_id, file_id, sz as name, n as value from c union all select pver_id, file_id, 'loc', 3 from c where src = '3u'")
register("x05_parameters", "c_files", lambda c: co.extract_parameters(co.extract_functions(c)), _CF + "select pver_id, file_id, fn, unnest([0, 1]) as place, unnest([par, 'ptr']) as symbol, unnest(['uint8', 'uint16']) as datatype, '' as dims, unnest([0, 1]) as pointer_depth from c")
_spots = lambda c: _points(c).select("*", F.lit(None).cast("int").alias("end_line"), F.lit(None).cast("int").alias("end_col")).unionByName(_lines(c).where("line_no = 14").select(*sy.LINE, F.expr("instr(text, '[1]')").alias("col"), F.lit(16).alias("end_line"), F.lit(9).alias("end_col")))
register("x07_resolve_access", "c_files", lambda c: co.resolve_access(_spots(c), _lines(c)), _CF + """select pver_id, file_id, 14 as line_no, instr(ls[14], '[') as col, tab as "array", tab as member_path, 'loc' as "index", 0 as dimension from c union all select pver_id, file_id, 16, instr(ls[16], '['), mem, 's.' || mem, 'ptr[0] + 1u', 0 from c
 union all select pver_id, file_id, 14, instr(ls[14], '[1]'), tab, tab, substring(ls[14], instr(ls[14], '[1]') + 1) || chr(10) || ls[15] || chr(10) || '  return', 1 from c""")
register("x08_relevant_symbols", "c_files", lambda c: co.relevant_symbols(co.resolve_access(_points(c), _lines(c))), _CF + """select pver_id, file_id, 14 as line_no, instr(ls[14], '[') as col, unnest(['array', 'index']) as role, unnest([tab, 'loc']) as symbol from c
 union all select pver_id, file_id, 16, instr(ls[16], '['), unnest(['array', 'parent', 'index']), unnest([mem, 's', 'ptr']) from c""")
register("x09_symbol_infos", "c_files", lambda c: _flat(en.symbol_infos(co.resolve_access(_points(c), _lines(c)), _spread(c)).drop("index"), "sizes"), _CF + """, i as (select *, instr(ls[14], '[') as c1, instr(ls[16], '[') as c2 from c)
select pver_id, file_id, unnest([14, 14, 16, 16, 16]) as line_no, unnest([c1, c1, c2, c2, c2]) as col, unnest(['array', 'index', 'array', 'parent', 'index']) as role, unnest([tab, 'loc', mem, 's', 'ptr']) as symbol,
 unnest(['array', 'symbol', 'array', 'symbol', 'pointer']) as kind, unnest(['global', 'local', 'struct_member', 'global', 'parameter']) as scope, unnest(['uint16', 'uint8', 'uint8', null, 'uint16']) as datatype,
 unnest(['[' || sz || '*2+1][2]', '', '[3]', '', '']) as dims, unnest([(n * 2 + 1) || ',2', null, '3', null, null]) as sizes, unnest([true, null, true, null, null]) as size_known, unnest([null, null, 'S', null, null]) as member_of, unnest([null, fn, null, null, fn]) as declared_in,
 unnest([4, 11, 6, null, 9]) as declaration_line, unnest(['variable', 'variable', 'struct_member', 'unknown', 'parameter']) as declaration_kind, unnest([1, 1, 1, 0, 1]) as n_declaration, unnest([0, 1, 0, 0, 0]) as n_address, unnest([1, 0, 0, 0, 0]) as n_write,
 unnest([0, 0, 0, 0, 0]) as n_parameter, unnest([0, 2, 1, 1, 1]) as n_read, unnest([2, 4, 2, 1, 2]) as occurrence_count, unnest([0, 1, 0, 0, 0]) as n_passed, unnest([2, 1, 2, 1, 1]) as n_functions from i""")
register("x10_initializer_sizes", "c_files", co.initializer_sizes, _CF + "select pver_id, file_id, tab as symbol, 4 as line_no, 3 as n_items from c")
register("p12_resolve_dims", "c_files", lambda c: _flat(co.resolve_dims(co.extract_declarations(c), co.extract_defines(c)), "sizes"), _CF + "select pver_id, file_id, unnest(['[' || sz || '*2+1][2]', '[3]']) as dims, unnest([(n * 2 + 1) || ',2', '3']) as sizes, true as all_known from c")
register("j07_resolve_parameter", "c_files", lambda c: co.resolve_parameter(co.extract_functions(c).where("defined").select(*sy.FILE, "fn", F.explode(F.array(F.lit("ptr"), F.lit("none"))).alias("symbol")), co.extract_parameters(co.extract_functions(c))), _CF + "select pver_id, file_id, fn, 'ptr' as symbol, fn as owner, 'uint16' as datatype from c")
register("j08_typedef_dims", "c_files", lambda c: co.typedef_dims(co.extract_declarations(c), co.extract_typedefs(c)), _CF + "select pver_id, file_id, 12 as line_no, 'rows' as symbol, '[4]' as dims from c")
register("j18_attach_snippets", "c_files", lambda c: co.attach_snippets(_starts(c).select(*sy.FILE, F.concat("fn", F.lit("|separate")).alias("fn")), co.extract_functions(c), _lines(c)), _CF + "select pver_id, file_id, fn || '|separate' as fn, 9 as from_line, 17 as to_line, array_to_string(ls[9:17], chr(10)) as snippet from c")
register("p19_underlined_variable", "c_files", lambda c: co.underlined_variable(_lines(c).where("line_no = 14").select(*sy.FILE, F.col("text").alias("raw"), F.concat(F.lit("    "), F.repeat(F.lit("~"), 5)).alias("underline"))), _CF + "select pver_id, file_id, ls[14] as raw, '    ~~~~~' as underline, ls[14][5:9] as variable from c")
register("g05_index_origin", "c_files", lambda c: _origins(c, "loc"), _CF + "select pver_id, file_id, fn, 'loc' as token, case when src = par then 'parameter' when src = 'g_all' then 'global' else 'local' end as origin, case when src = '3u' then 1 else 2 end as n_names from c")
register("j19_value_origins", "c_files", lambda c: _sources(c, "loc"), _CF + "select pver_id, file_id, fn, 'loc' as token, callee, 1 as place from c where exists (select 1 from c d where d.pver_id = c.pver_id and d.fn = c.callee)")
_one = lambda c: many(c.select(*sy.FILE, F.regexp_extract("text", r"uint16 (tab_\d+)", 1).alias("array"), F.lit(14).alias("line_no")))


def _fixed(texts: DataFrame) -> DataFrame:
    functions = _parsed(texts, "fn", "defined", "sig_line", "start_line", "end_line", "params")
    named = lambda column, *names: functions.where("defined").select(*sy.FILE, "fn", F.explode(F.array(*map(F.lit, names))).alias(column))
    return co.fix_index_symbols(named("symbol", "loc", "far").withColumn("line_no", F.lit(4)), named("token", "loc", "ptr", "none"), co.extract_parameters(functions), co.extract_declarations(texts), functions)


register("x14_fix_index_symbols", "c_files", _fixed, _CF + "select pver_id, file_id, fn, unnest(['loc', 'far', 'ptr']) as symbol, unnest([11, 4, 9]) as line_no, unnest(['local', null, 'parameter']) as scope, unnest(['re-pointed', 'kept', 'added']) as change from c")
_RAW = [(13, "alarm_site", "tab_", None), (13, "write", "uint8 loc = ", "loc"), (15, "write", "if (loc < 4u) {", "loc"), (16, "guard", "return (*cb", "s"), (14, "guard", "if (loc < 4u)", "zz"), (2, "write", "far away", "loc"), (12, "fact", "row_t rows;", None)]
register("x13_normalize_facts", "c_files", lambda c: co.normalize_facts(_one(c).select(*sy.FILE, F.explode(F.array(*[F.struct(F.lit(a).alias("line_no"), F.lit(k).alias("kind"), F.lit(q).alias("quote"), F.lit(s).cast("string").alias("symbol")) for a, k, q, s in _RAW])).alias("r")).select(*sy.FILE, "r.*"), _one(c).select(*sy.FILE, "array", F.col("line_no").alias("alarm_line"), F.array(F.lit("loc")).alias("tokens"), F.array(F.lit("loc"), F.col("array")).alias("relevant")), _lines(c)), _CF + """select pver_id, file_id, unnest([14, 11, 13, 13]) as line_no,
 unnest(['alarm_site', 'write', 'read', 'guard']) as kind, unnest([trim(ls[14]), 'uint8 loc =', 'if (loc < 4u) {', 'if (loc < 4u)']) as quote, unnest([null, 'loc', 'loc', null]) as symbol from c""")
register("x11_seed_facts", "c_files", lambda c: co.seed_facts(co.extract_declarations(c), co.initializer_sizes(c), _one(c), _one(c).select(*sy.FILE, F.lit(13).alias("line_no"), F.lit("loc").alias("token")), _lines(c)), _CF + """, k as (select *, unnest([4, 6, 11, 12, 4, 14, 13]) as line_no,
 unnest(['declaration', 'declaration', 'declaration', 'declaration', 'array_size_hint', 'alarm_site', 'local_guard']) as kind, unnest([tab, mem, 'loc', 'rows', tab, tab, 'loc']) as symbol from c) select pver_id, file_id, line_no, kind, symbol, trim(ls[line_no]) as quote from k""")
register("w06_symbol_packages", "c_files", lambda c: co.symbol_packages(_one(c).select(*sy.FILE, F.col("array").alias("symbol"), F.explode(F.array(F.lit(4), F.lit(14), F.lit(12))).alias("line")), _lines(c)), _CF + "select pver_id, file_id, tab as symbol, 16 as n_lines, array_to_string(list_transform(range(1, 18), lambda i: case when i = 8 then '' else i || ': ' || ls[i] end), chr(10)) as package from c")
register("w06_key_lines", "c_files", lambda c: co.symbol_key_lines(sy.occurrences(_lines(c)), co.extract_declarations(c), _one(c).withColumn("index", F.lit("loc"))).where("symbol = 'loc' or symbol like 'tab%'"), _CF + "select pver_id, file_id, tab as symbol, unnest([4, 14]) as line from c union all select pver_id, file_id, 'loc', unnest([11, 13, 14]) from c")

# --- C files of several shapes; positions come from where a file's blocks begin ---

_at = lambda rows, *names: "(values " + ", ".join(str(r) for r in rows) + f") as v({', '.join(names)})"
_SB = lambda rows, *names: f", v as (select * from {_at(rows, *names)}), s as (select b.*, v.* exclude (kind) from shape_blocks b join v using (kind))\n"
_BODY = [(0, 1, 2, 8), (1, 1, 3, 11), (2, 1, 2, 7), (3, 1, 2, 9), (4, 5, 6, 10), (5, 1, 2, 8)]
_tokens = lambda f, *names: co.extract_functions(f).where("defined").select(*sy.FILE, "fn", F.explode(F.array(*map(F.lit, names))).alias("token"))
_NAMED = "case {0} when 'P' then p when 'F' then 'f_' || p when 'T' then t when 'U' then u when 'B' then b when 'C' then c when 'S' then fn || '_tag' else {0} end"
register("x01_function_shapes", "shape_files shape_blocks", lambda f, b: co.extract_functions(f).select(*sy.FILE, "fn", "defined", "start_line", "end_line", "sig_line"), _SB(_BODY, "kind", "sig", "o", "e") + "select pver_id, file_id, fn, true as defined, head + o as start_line, head + e as end_line, head + sig as sig_line from s")
register("x02_call_shapes", "shape_files shape_blocks", lambda f, b: co.extract_calls(co.extract_functions(f)), _SB([(1, 1, "cb"), (2, 1, "B"), (3, 1, "B"), (3, 2, "C")], "kind", "pos", "x") + f"""select distinct pver_id, file_id, fn as caller, {_NAMED.format('x')} as callee, pos from s""")
_DECLS = [(0, "idx", "uint8", 0, "", 3, ""), (0, "m", "uint8", 0, "", 4, ""), (1, "k", "uint16", 0, "", 4, ""), (1, "idx", "uint16", 0, "", 5, ""), (2, "idx", "uint8", 0, "", 3, ""), (2, "at", "uint8", 1, "", 3, ""), (2, "rows", "uint8", 0, "[4][2]", 3, ""), (2, "j", "uint8", 0, "", 4, ""),
          (3, "idx", "uint8", 0, "", 3, ""), (3, "sz", "uint8", 0, "", 4, ""), (4, "F", "uint8", 0, "[3]", 2, "S"), (4, "hook", "void", 1, "", 3, "S"), (4, "idx", "uint8", 0, "", 7, ""), (5, "a", "uint8", 0, "", 3, ""), (5, "idx", "uint8", 0, "", 3, "")]
register("x03_declaration_shapes", "shape_files shape_blocks", lambda f, b: co.extract_declarations(f), _SB(_DECLS, "kind", "x", "datatype", "d", "dims", "l", "o") + f"select pver_id, file_id, {_NAMED.format('x')} as symbol, datatype, false as macro, d as pointer_depth, dims, head + l as line_no, nullif({_NAMED.format('o')}, '') as owner from s union all select pver_id, file_id, unnest([t, u]), 'uint8', false, 0, unnest(['[SZ+1u]', '[4]']), head, null from shape_blocks where seq = 1")
_PARAMS = [(0, 0, "P", "uint8", 0), (0, 1, "n", "uint8", 0), (1, 0, "P", "uint16", 0), (1, 1, "cb", "uint16", 1), (3, 0, "src", "uint8", 1), (3, 1, "len", "uint8", 0), (4, 0, "s", "S", 1), (4, 1, "P", "uint8", 0), (5, 0, "q", "uint8", 0)]
register("x05_parameter_shapes", "shape_files shape_blocks", lambda f, b: co.extract_parameters(co.extract_functions(f)), _SB(_PARAMS, "kind", "place", "x", "y", "d") + f"select pver_id, file_id, fn, place, {_NAMED.format('x')} as symbol, {_NAMED.format('y')} as datatype, '' as dims, d as pointer_depth from s")
_WRITES = [(0, "idx", 5, 1), (0, "T", 6, 1), (1, "k", 6, 1), (1, "idx", 8, 1), (1, "T", 9, 1), (2, "idx", 5, 1), (2, "j", 5, 1), (2, "rows", 6, 1), (3, "idx", 6, 1), (3, "sz", 7, 2), (3, "T", 7, 1), (5, "idx", 3, 1), (5, "T", 4, 1), (5, "idx", 5, 1), (5, "a", 6, 1), (5, "idx", 6, 1)]
register("x06_write_shapes", "shape_files shape_blocks", lambda f, b: sy.occurrences(_lines(f)).where("access = 'write'").groupBy(*sy.LINE, "symbol").agg(F.count("*").alias("n")), _SB(_WRITES, "kind", "x", "l", "n") + f"select pver_id, file_id, head + l as line_no, {_NAMED.format('x')} as symbol, n from s")
register("g05_origin_shapes", "shape_files shape_blocks", lambda f, b: _origins(f, "idx"), _SB([(0, "parameter", 2), (1, "parameter", 3), (2, "global", 3), (3, "local", 2), (4, "parameter", 2), (5, "local", 2)], "kind", "origin", "n_names") + "select pver_id, file_id, fn, 'idx' as token, origin, n_names from s")
register("j19_origin_shapes", "shape_files shape_blocks", lambda f, b: _sources(f, "idx"), _SB([(2, 1, "B"), (3, 1, "C"), (3, 2, "B")], "kind", "r", "x") + f""", k as (select *, {_NAMED.format('x')} as callee from s), d as (select distinct pver_id, fn as callee from shape_blocks)
select pver_id, file_id, fn, 'idx' as token, callee, cast(row_number() over (partition by pver_id, file_id, fn order by r) as integer) as place from k join d using (pver_id, callee)""")
register("j18_snippet_shapes", "shape_files shape_blocks", lambda f, b: co.attach_snippets(_tokens(f, "idx").select(*sy.FILE, F.concat("fn", F.lit("|separate")).alias("fn")), co.extract_functions(f), _lines(f)), _SB(_BODY, "kind", "sig", "o", "e") + ", t as (select pver_id, file_id, string_split(text, chr(10)) as ls from shape_files) select pver_id, file_id, fn || '|separate' as fn, head + sig as from_line, head + e as to_line, array_to_string(ls[head + sig:head + e], chr(10)) as snippet from s join t using (pver_id, file_id)")

# Occurrences by shape: symbol, place, line, access; then the symbols of a shape's alarm with what is known of them.
_OCCURS = [(0, "idx", "declaration write read read"), (1, "idx", "declaration write read parameter"), (2, "idx", "declaration write read"), (2, "rows", "declaration write"), (3, "idx", "declaration address read write read read"), (4, "idx", "declaration read"),
           (4, "s", "declaration read"), (4, "F", "declaration read"), (5, "a", "declaration read read read read write read"), (0, "T", "write"), (1, "T", "write"), (2, "T", "read"), (3, "T", "write read"), (5, "T", "write"), (1, "U", "read"), (5, "U", "read")]
_LISTED = [(k, x, i, a) for k, x, accesses in _OCCURS for i, a in enumerate(accesses.split())]
_TABLE, _LOCAL = ("array", "global", "uint8"), ("symbol", "local", "uint8", "", "", None)
_SYMBOLS = [
    (0, 0, "array", "T", *_TABLE, "[SZ+1u]", "9", True, 0, "variable", ""), (0, 1, "index", "idx", *_LOCAL, 3, "variable", ""), (1, 0, "array", "U", *_TABLE, "[4]", "4", True, 0, "variable", ""), (1, 1, "index", "idx", "symbol", "local", "uint16", "", "", None, 5, "variable", "cb:value"),
    (2, 0, "array", "rows", "array", "local", "uint8", "[4][2]", "4,2", True, 3, "variable", ""), (2, 1, "index", "idx", *_LOCAL, 3, "variable", ""), (3, 0, "array", "T", *_TABLE, "[SZ+1u]", "9", True, 0, "variable", ""), (3, 1, "index", "idx", *_LOCAL, 3, "variable", "C:address"),
    (4, 0, "array", "F", "array", "struct_member", "uint8", "[3]", "3", True, 2, "struct_member", ""), (4, 1, "parent", "s", "pointer", "parameter", "S", "", "", None, 5, "parameter", ""), (4, 2, "index", "idx", *_LOCAL, 7, "variable", ""),
    (5, 0, "array", "T", *_TABLE, "[SZ+1u]", "9", True, 0, "variable", ""), (5, 1, "index", "U", *_TABLE, "[4]", "4", True, 0, "variable", ""), (5, 2, "index", "a", *_LOCAL, 3, "variable", ""),
]
_cells = lambda rows: [tuple("null" if x is None else x for x in r) for r in rows]
_values = lambda rows: "(values " + ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) and x != "null" else str(x) for x in r) + ")" for r in _cells(rows)) + ")"


def _rows_of(groups: DataFrame) -> DataFrame:
    """A row for each symbol of each group, nested lists as texts."""
    one = groups.select("*", F.posexplode("symbol_infos").alias("place", "x")).select("*", "x.*")
    join = lambda c, sep=",": F.array_join(c, sep)
    return one.select(
        "pver_id", "group_id", "location", "variable", "enclosing_function", "no_of_paths", "no_of_traces", F.array_join(F.transform("paths", lambda p: F.array_join(p["function_sequence"], ">")), ";").alias("paths"), join("variable_info.member_path", "->").alias("member_path"),
        "place", "role", "symbol_name", "kind", "scope", "datatype", join(F.coalesce("array_dims", F.array().cast("array<string>")), "").alias("dims"), join(F.coalesce(F.col("resolved_sizes").cast("array<string>"), F.array().cast("array<string>"))).alias("sizes"), "size_known",
        "declared_in_function", "declaration_line", "declaration_text", "declaration_kind", join(F.transform(F.map_entries("access_counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))).alias("access_counts"), join("used_in_functions").alias("used_in"),
        F.coalesce(join(F.transform("passed_to", lambda p: F.concat_ws(":", p["function"], p["mode"]))), F.lit("")).alias("passed_to"), "occurrence_count", "occurrences_truncated", join(F.transform("occurrences", lambda o: o["access"])).alias("accesses"),
    )


register("s05_enrichment", "shape_frames shape_heads shape_files shape_blocks", lambda fr, h, f, b: _rows_of(en.enrich(fr, h, _spread(f).withColumn("name", F.concat(F.lit("f"), F.col("file_id").cast("string"), F.lit(".c"))))), f""", oc as (select * from {_values(_LISTED)} as v(kind, x, i, access)), sy as (select * from {_values(_SYMBOLS)} as v(kind, place, role, x, k, scope, ty, dims, sizes, sk, dl, dk, passed)),
tx as (select pver_id, file_id, string_split(text, chr(10)) as ls from shape_files), top as (select pver_id, file_id, head as base from shape_blocks where seq = 1),
met as (select b.pver_id, b.file_id, b.seq, b.fn, oc.x, oc.i, oc.access from shape_blocks b join oc using (kind) union all select pver_id, file_id, 0, 'global', unnest(['T', 'U']), 0, 'declaration' from top),
met2 as (select *, case when x in ('T', 'U', 'F') then 0 else seq end as obj, case when x = 'F' and i = 0 then 'global' else fn end as f from met),
cnt as (select pver_id, file_id, x, obj, access, count(*) as n from met2 group by all), cs as (select pver_id, file_id, x, obj, string_agg(access || ':' || n, ',' order by access) as access_counts, cast(sum(n) as integer) as occurrence_count from cnt group by all),
uf as (select pver_id, file_id, x, obj, f, min((seq, i)) as pl from met2 group by all), us as (select pver_id, file_id, x, obj, string_agg(f, ',' order by pl) as used_in from uf group by all),
sq as (select pver_id, file_id, x, obj, string_agg(access, ',' order by seq, i) as accesses from met2 group by all),
gr as (select pver_id, location, count(*) as n, cast(row_number() over (partition by pver_id order by min(block_no)) as integer) as group_id, min(block_no) as first from shape_heads group by 1, 2),
al as (select gr.*, b.* exclude (pver_id) from gr join shape_blocks b on b.pver_id = gr.pver_id and (b.file_id * 3 + b.seq) * 2 = gr.first),
z as (select al.*, sy.* exclude (kind), ls, base, case when x in ('T', 'U', 'F') then 0 else seq end as obj, {_NAMED.format('x')} as symbol_name, case when dl = 0 then base else head + dl end as declaration_line from al join sy using (kind) join tx using (pver_id, file_id) join top using (pver_id, file_id))
select z.pver_id, group_id, location, case kind when 1 then u || '[idx]' when 2 then 'rows[idx]' when 4 then 'f_' || p || '[idx & 3u]' when 5 then t || '[' || u || '[a]]' else t || '[idx]' end as variable, fn as enclosing_function, 1 as no_of_paths, cast(n as integer) as no_of_traces,
 'main>' || fn as paths, case kind when 1 then u when 2 then 'rows' when 4 then 's->f_' || p else t end as member_path, cast(place as integer) as place, role, symbol_name, k as kind, scope, {_NAMED.format('ty')} as datatype, dims, sizes, sk as size_known,
 case when scope in ('local', 'parameter') then fn end as declared_in_function, declaration_line, trim(ls[declaration_line]) as declaration_text, dk as declaration_kind, access_counts, used_in, replace(passed, 'C:', c || ':') as passed_to, occurrence_count, false as occurrences_truncated, accesses
from z join cs using (pver_id, file_id, x, obj) join us using (pver_id, file_id, x, obj) join sq using (pver_id, file_id, x, obj)""")

# --- sources over texts made of the tables ---

register("s02_source_lines", "shape_files", lambda f: fi.source_lines(f.withColumn("path", F.concat(F.lit("f"), F.col("file_id").cast("string")))), "select pver_id, 'f' || file_id as path, cast(i as integer) as line_no, string_split(text, chr(10))[i] as text from (select *, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from shape_files)")
register("s03_read_alarms", "csv_texts", lambda c: fi.read_alarms(c.select("pver_id", "path", "text")).select("pver_id", "path", "alarm_seq", *[F.col("row")[k].alias(k.lower()) for k in ("Order", "Message", "Type")]), """select pver_id, path, case when first = '' then 2 else 3 end as alarm_seq, n as "order", 'a; "b" ' || nation as message, 'x' as type from csv_texts
 union all select pver_id, path, case when first = '' then 4 else 5 end, n || '/7', 'plain', '' from csv_texts""")
register("s04_trace_blocks", "log_texts", lambda t: fi.read_trace_blocks(t.select("pver_id", "text")), r"""select pver_id, 1 as block_no, regexp_extract(text, '(?s)\n(\[.*~~~~)', 1) as block from log_texts union all select pver_id, 2, '[ ALARM (A) overflow ]' from log_texts""")
register("p03_parse_blocks", "log_texts", lambda t: _flat(fi.parse_blocks(fi.read_trace_blocks(t.select("pver_id", "text"))), "call_stack", "source_lines"), """select pver_id, 1 as block_no, 'call#main at m.c:1.2-3,call#fn_' || f || ' at m.c:9.1-2' as call_stack, 'ALARM (A) array_out_of_bounds at ap.c:' || n || '.5-9' as alarm, '  x = t[i];,      ~~~~' as source_lines, 'ap.c:' || n || '.5-9' as location from log_texts
 union all select pver_id, 2, '', 'ALARM (A) overflow', '', 'UNKNOWN_LOCATION::ALARM (A) overflow' from log_texts""")


def _as_files(df: DataFrame, name: str) -> DataFrame:
    """(project, k, text) written as one file a project, its texts one after another, and read back in splits."""
    path = new_path(df.sparkSession, name)
    df.repartition("project").sortWithinPartitions("project", "k").select("project", "text").write.partitionBy("project").text(path)
    return li.read_lines(df.sparkSession, path).withColumn("pver_id", F.replace("pver_id", F.lit("project="), F.lit("")))


register("s04_log_blocks", "log_texts", lambda t: _flat(fi.parse_blocks(li.log_blocks(_as_files(t.select((F.substring("pver_id", 2, 20).cast("long") % 8).alias("project"), F.substring("pver_id", 2, 20).cast("long").alias("k"), "text"), "logs"))), "call_stack", "source_lines"), """, t as (select cast(pver_id[2:] as bigint) as k, n, f from log_texts), r as (select k % 8 as p, row_number() over (partition by k % 8 order by k) as i, n, f from t)
select cast(p as varchar) as pver_id, 2 * i - 1 as block_no, 'call#main at m.c:1.2-3,call#fn_' || f || ' at m.c:9.1-2' as call_stack, 'ALARM (A) array_out_of_bounds at ap.c:' || n || '.5-9' as alarm, '  x = t[i];,      ~~~~' as source_lines, 'ap.c:' || n || '.5-9' as location from r
 union all select cast(p as varchar), 2 * i, '', 'ALARM (A) overflow', '', 'UNKNOWN_LOCATION::ALARM (A) overflow' from r""")
register("s03_alarm_lines", "csv_texts", lambda c: fi.alarm_rows(_as_files(c.select(F.col("pver_id").alias("project"), F.col("n").cast("long").alias("k"), "text"), "alarms")).select("pver_id", "alarm_seq", *[F.col("row")[k].alias(k.lower()) for k in ("Order", "Message", "Type")]), """, t as (select pver_id, cast(n as bigint) as k, nation, case when first = '' then 0 else 1 end as s from csv_texts), a as (select *, coalesce(sum(5 + s) over (partition by pver_id order by k rows between unbounded preceding and 1 preceding), 0) + s as up, row_number() over (partition by pver_id order by k) as i from t)
select pver_id, cast(up + 2 as bigint) as alarm_seq, cast(k as varchar) as "order", 'a; "b" ' || nation as message, 'x' as type from a union all select pver_id, cast(up + 4 as bigint), k || '/7', 'plain', '' from a union all select pver_id, cast(up + 1 as bigint), 'Order', 'Message', 'Type' from a where i > 1""")
register("s06_read_cfg", "cfg_texts", lambda t: fi.read_cfg(fi.cfg_json(fi.read_cfg(t.select("pver_id", "text")))), "select pver_id, 'fn_' || n as caller, unnest([0, 1]) as pos, unnest(['fn_b', callee]) as callee from cfg_texts union all select pver_id, 'leaf', null, null from cfg_texts")


def _stored(df: DataFrame) -> DataFrame:
    """Rows written as artifacts of a stage and read back."""
    path = new_path(df.sparkSession, "artifacts")
    fi.write_artifact(df, path, "merge")
    return fi.read_artifact(df.sparkSession, path, "merge")


register("s08_artifacts", "alarms", lambda a: _stored(a.select("pver_id", F.concat(F.col("alarm_seq") % 20, F.lit(",5/x")).alias("order_key"), "location", F.concat(F.lit("t"), F.col("alarm_seq") % 3).alias("stamp"))).select("pver_id", "safe_order", "stamp", "order_key", "location"), "select pver_id, (alarm_seq % 20) || '_5_x' as safe_order, 't' || (alarm_seq % 3) as stamp, (alarm_seq % 20) || ',5/x' as order_key, location from alarms")


def _streamed(df: DataFrame, preview: int) -> DataFrame:
    """Events appended as JSON lines in two batches, read as a stream, kept as a table."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "events")
    for part in (0, 1):
        fi.write_events(df.where(F.col("event_id") % 2 == part), f"{path}/in")
    kept = ev.stream_events(spark, f"{path}/in", preview).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    kept.awaitTermination()
    return spark.read.parquet(f"{path}/out")


register("t01_event_stream", "run_events", lambda e: _streamed(e, 12).select("event_id", "ts", "pver_id", "order_key", "kind", "agent", "activity", "props", "cursor"), "select event_id, ts, pver_id, order_key, kind, agent, activity, case when length(props) > 12 then left(props, 12) || '… [' || (length(props) - 12) || ' more chars]' else props end as props, cursor from run_events")


def _tail(df: DataFrame, n: int) -> DataFrame:
    """Events appended in two batches, their tails kept by a stream's sink."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "tail")
    for part in (0, 1):
        fi.write_events(df.where(F.col("event_id") % 2 == part).coalesce(1), f"{path}/in")
    events = spark.readStream.schema(ev.SCHEMA).option("maxFilesPerTrigger", 1).json(f"{path}/in")
    ev.event_tail_sink(events, f"{path}/out", f"{path}/log", n).awaitTermination()
    return ev.read_tail(spark, f"{path}/out")


register("t05_event_tail", "run_events", lambda e: _tail(e, 3).select("event_id", "pver_id", "order_key"), ", r as (select *, row_number() over (partition by pver_id, order_key order by ts desc, event_id desc) as rank from run_events) select event_id, pver_id, order_key from r where rank <= 3")
_flags = lambda f: f.select("pver_id", "group_id", "seq", (F.col("line") % 5 == 0).alias("a"), (F.col("line") % 4 == 0).alias("m"), (F.col("line") % 3 == 0).alias("p"), (F.col("line") % 2 == 0).alias("q"), (F.col("seq") % 2 == 0).alias("s"), F.when(F.col("line") > 30, F.lit("global")).when(F.col("line") > 10, F.col("fn")).alias("f"))
register("p14_symbol_kinds", "order_facts", lambda f: _flags(f).select("pver_id", "group_id", "seq", S.symbol_kind(F.col("a"), F.col("m"), F.col("p"), F.col("q"), F.col("s")).alias("kind"), S.symbol_scope(F.col("f"), F.col("q"), F.col("m")).alias("scope")), """select pver_id, group_id, seq, case when line % 5 = 0 then 'array' when line % 4 = 0 then 'struct_member' when line % 3 = 0 then 'pointer' when line % 2 = 0 then 'parameter' when seq % 2 = 0 then 'struct' else 'symbol' end as kind,
 case when line % 2 = 0 then 'parameter' when line % 4 = 0 then 'struct_member' when line > 30 or line <= 10 then 'global' else 'local' end as scope from order_facts""")
register("g02_group_distance", "cfg_edges frames", lambda e, f: gr.group_distance(_members(f), e), r"""--recursive, m as (select pver_id, block_no as grp, regexp_extract(entry, '^call#([^ |]*)', 1) as fn, min(pos) as first, max(pos) as last from frames group by 1, 2, 3), lf as (select pver_id, grp, fn from (select *, max(last) over (partition by pver_id, grp) as top from m) where last = top),
inn as (select distinct a.pver_id, a.grp, a.fn as caller, b.fn as callee from m a join cfg_edges e on e.pver_id = a.pver_id and e.caller = a.fn join m b on b.pver_id = a.pver_id and b.grp = a.grp and b.fn = e.callee),
d(pver_id, grp, fn, n) as (select pver_id, grp, fn, 0 from lf union select d.pver_id, d.grp, inn.caller, n + 1 from d join inn on inn.pver_id = d.pver_id and inn.grp = d.grp and inn.callee = d.fn where n < 8) select pver_id, grp, fn, min(n) as distance from d group by 1, 2, 3""")
