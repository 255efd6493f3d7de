"""Views that turn the driver's tables into alarm data; each is one SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

#: Files of several shapes: blocks of C, in an order of their own in each file. {fn} {b} {c} are functions, {p} a parameter, {t} {u} tables; one line a row.
SHAPES = [
    ["uint8 {fn}(uint8 {p}, uint8 n)", "{{", "  uint8 idx = 0u;", "  uint8 m = 2u;", "  if (m == 1u) idx = {p};", "  {t}[idx] = n;", "  return idx;", "}}"],
    ["static uint16 {fn}(uint16 {p},", "                   uint16 (*cb)(uint8, uint16))", "{{", "  uint16 k;", "  uint16 idx = 0u;", "  k = 1u +", "      {p};", "  idx <<= k;", "  {t}[{u}[idx] + 1u] = cb(1u, idx);", "  return (*cb)(2u, k);", "}}"],
    ["void {fn}(void)", "{{", "  uint8 idx, *at, rows[4][2];", "  uint8 j;", "  idx = j = g_all.x;", "  rows[idx][{t}[j]] = {b}(&j, at);", "}}"],
    ["uint8 {fn}(const uint8 *src, uint8 len)", "{{", "  uint8 idx = 0u;", "  uint8 sz = {b}(3u);", "  {c}(src, &idx);", "  while (idx >= sz) idx -= sz;", "  for (sz = 0u; sz < 4u; sz++) {t}[idx] += 1u;", "  return {t}[idx];", "}}"],
    ["struct {fn}_tag {{", "  uint8 f_{p}[3];", "  void (*hook)(uint8 v);", "}};", "uint8 {fn}(struct {fn}_tag *s, uint8 {p})", "{{", "  uint8 idx = {p};", "  return s->f_{p}", "      [idx & 3u];", "}}"],
    ["uint8 {fn}(uint8 q)", "{{", "  uint8 a = 1u, idx = 2u;", "  {t}[{u}[a]] = idx;", "  if (a <= idx) {{ idx = (a != 0u) ? idx : a; }}", "  ++a; idx >>= 1u;", "  return a;", "}}"],
]


def _block(seq: int) -> dict[str, str]:
    """SQL of the columns of a file's block: what shape it has and the names in it."""
    number = lambda e: f"cast(cast({e} as bigint) as string)"
    return {
        "kind": f"cast((o_orderkey * {seq} + o_custkey) % {len(SHAPES)} as int)", "fn": f"concat('fn_', {number(f'(o_orderkey + {7 * seq}) % 40')})", "b": f"concat('fn_', {number('o_custkey % 50')})",
        "c": f"concat('fn_', {number('(o_custkey + 3) % 50')})", "p": f"concat('par_', {number('o_custkey % 5')})", "t": f"concat('tab_', {number('o_custkey % 9')})", "u": f"concat('tbu_', {number('o_orderkey % 9')})",
    }


def _block_text(seq: int) -> str:
    """SQL of a block's text: its shape with the names put in."""
    block = _block(seq)
    whole = "case {kind} " + " ".join(f"when {k} then concat({_joined(shape)})" for k, shape in enumerate(SHAPES)) + " end"
    return re.sub(r"\{(\w+)\}", lambda m: block[m[1]], whole)


def _joined(shape: list[str]) -> str:
    pieces = re.split(r"\{(fn|b|c|p|t|u)\}", "\n".join(shape).replace("{{", "{").replace("}}", "}"))
    texts = lambda x: ", chr(10), ".join(f"'{part}'" for part in x.split("\n"))
    return ", ".join(f"{{{x}}}" if i % 2 else texts(x) for i, x in enumerate(pieces) if x)


def _n_lines(kind: str) -> str:
    return f"case {kind} " + " ".join(f"when {k} then {len(shape)}" for k, shape in enumerate(SHAPES)) + " end"


#: Comments before the first block of a file; a constant and the tables follow.
_HEAD = "cast(o_orderkey % 3 as int)"


def _first_line(seq: int) -> str:
    """SQL of the line before a block."""
    return f"{_HEAD} + 2 + " + " + ".join(["0", *(_n_lines(_block(i)["kind"]) for i in range(1, seq))])


#: By shape: the line of an alarm in its block, the columns of its bracket and of its index' end.
SPOTS = [(6, "3 + length({t})", "6 + length({t})"), (9, "4 + length({t}) + length({u})", "7 + length({t}) + length({u})"), (6, "7", "10"), (8, "10 + length({t})", "13 + length({t})"), (9, "7", "15"), (4, "3 + length({t})", "6 + length({t}) + length({u})")]


def _alarm(seq: int) -> str:
    """SQL of the location of a block's alarm."""
    block = _block(seq)
    pick = lambda i: "cast(case {kind} ".format(**block) + " ".join(f"when {k} then {str(spot[i]).format(**block)}" for k, spot in enumerate(SPOTS)) + " end as string)"
    line = f"cast({_first_line(seq)} + case {block['kind']} " + " ".join(f"when {k} then {spot[0]}" for k, spot in enumerate(SPOTS)) + " end as string)"
    return f"concat('f', cast(o_orderkey as string), '.c:', {line}, '.', {pick(1)}, '-', {pick(2)})"


_TWICE = [(seq, again, " where o_custkey % 2 = 0" if again else "") for seq in (1, 2, 3) for again in (0, 1)]

VIEWS = {
    "shape_files": f"""
select cast(o_orderkey % 8 as string) as pver_id, o_orderkey as file_id, concat(repeat(concat('/* part; {{ */', chr(10)), {_HEAD}), '#define SZ 8u', chr(10), 'static uint8 ', {_block(1)["t"]}, '[SZ + 1u], ', {_block(1)["u"]}, '[4];', chr(10), {_block_text(1)}, chr(10), {_block_text(2)}, chr(10), {_block_text(3)}) as text from orders""",
    "shape_blocks": " union all ".join(f"""
select cast(o_orderkey % 8 as string) as pver_id, o_orderkey as file_id, {seq} as seq, {", ".join(f"{e} as {n}" for n, e in _block(seq).items())},
 {_first_line(seq)} as head from orders""" for seq in (1, 2, 3)),
    "csv_texts": """
select cast(c_custkey % 8 as string) as pver_id, concat('p', cast(c_custkey as string), '/alarms.csv') as path, cast(c_custkey as string) as n, case when c_custkey % 2 = 0 then 'sep=;' else '' end as first,
 concat(case when c_custkey % 2 = 0 then concat('sep=;', chr(10)) else '' end, 'Order; Message ;Type', chr(13), chr(10), cast(c_custkey as string), ';"a; ""b"" ', cast(c_nationkey as string), '";x', chr(10), chr(10), cast(c_custkey as string), '/7; plain ', chr(10)) as text, cast(c_nationkey as string) as nation from customer""",
    "log_texts": """
select concat('p', cast(o_orderkey as string)) as pver_id, cast(o_custkey as string) as n, cast(o_orderkey % 12 as string) as f,
 concat('start of run', chr(10), '[ call#main at m.c:1.2-3', chr(10), '  call#fn_', cast(o_orderkey % 12 as string), ' at m.c:9.1-2', chr(10), '  ALARM (A) array_out_of_bounds at ap.c:', cast(o_custkey as string), '.5-9 ]', chr(10), '>  x = t[i];', chr(10), '>      ~~~~', chr(10), 'noise ]', chr(10), '[ ALARM (A) overflow ]') as text from orders""",
    "cfg_texts": """
select concat('p', cast(c_custkey as string)) as pver_id, cast(c_nationkey as string) as n, concat('{"fn_', cast(c_nationkey as string), '": ["fn_b", "fn_', cast(c_custkey % 7 as string), '"], "leaf": []}') as text, concat('fn_', cast(c_custkey % 7 as string)) as callee from customer""",
    "shape_heads": " union all ".join(f"""
select cast(o_orderkey % 8 as string) as pver_id, (o_orderkey * 3 + {seq}) * 2 + {again} as block_no, {_alarm(seq)} as location, 'ALARM (A) array_out_of_bounds' as alarm from orders{only}""" for seq, again, only in _TWICE),
    "shape_frames": " union all ".join(f"""
select cast(o_orderkey % 8 as string) as pver_id, (o_orderkey * 3 + {seq}) * 2 + {again} as block_no, {pos} as pos, {entry} as entry from orders{only}""" for seq, again, only in _TWICE
        for pos, entry in ((1, "'call#main at m.c:1.1-9'"), (2, f"concat('call#', {_block(seq)['fn']}, '|separate at m.c:7.1-9')"))),
    "frames": f"""
select cast(l_orderkey % 8 as string) as pver_id, l_orderkey as block_no,
 row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as pos,
 concat('call#fn_', cast(l_suppkey % 12 as string), case when l_returnflag = 'R' then '|separate' else '' end,
  ' at ap.c:', cast(l_partkey % 5 + 1 as string), '.1-9') as entry from lineitem""",
    "heads": """
select cast(o_orderkey % 8 as string) as pver_id, o_orderkey as block_no,
 concat('ap', cast(o_custkey % 3 as string), '.c:', cast(o_custkey % 97 + 1 as string),
  case when o_custkey % 5 = 0 then concat('.5-', cast(o_custkey % 97 + 3 as string), '.9') else '.5-9' end) as location,
 case when o_orderpriority = '5-LOW' then 'ALARM (A) overflow' else 'ALARM (A) Array_Out_Of_Bounds: idx' end as alarm from orders""",
    "alarms": """
select cast(c_custkey % 8 as string) as pver_id, c_custkey as alarm_seq,
 case when c_custkey >= 1000 then concat(cast(cast(floor(c_custkey / 1000) as bigint) as string), ',', lpad(cast(c_custkey % 1000 as string), 3, '0')) else cast(c_custkey as string) end as order_id,
 concat('ap', cast(c_custkey % 3 as string), '.c:', cast(c_custkey % 120 + 1 as string), '.5-9') as location,
 case when c_custkey % 4 = 0 then '' else 'ALARM (A) array_out_of_bounds: idx' end as message,
 case when c_custkey % 3 = 0 then 'Out-of-bound array access' else 'Overflow' end as category from customer""",
    "cfg_edges": """
select cast(l_orderkey % 4 as string) as pver_id, concat('fn_', cast(l_suppkey as string)) as caller,
 concat('fn_', cast(l_partkey % 300 as string)) as callee, count(*) as w from lineitem group by 1, 2, 3""",
    "code_lines": f"""
select cast(l_orderkey % 8 as string) as pver_id, l_orderkey as file_id,
 row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as line_no,
 case cast(l_suppkey % 6 as int)
  when 0 then concat('arr_', cast(l_partkey % 9 as string), '[idx_', cast(l_suppkey % 5 as string), '] = fn_', cast(l_partkey % 40 as string), '(idx_', cast(l_linenumber as string), ');')
  when 1 then concat('if ((idx_', cast(l_suppkey % 5 as string), ') < ', cast(cast(l_quantity as int) as string), 'u) {{')
  when 2 then '}}'
  when 3 then concat('uint8 idx_', cast(l_suppkey % 5 as string), ' = ', cast(cast(l_quantity as int) as string), 'u;')
  when 4 then concat('fn_', cast(l_partkey % 40 as string), '(&idx_', cast(l_suppkey % 5 as string), ', arr_', cast(l_partkey % 9 as string), '[2]);')
  else concat('return arr_', cast(l_partkey % 9 as string), '[idx_', cast(l_suppkey % 5 as string), '];') end as text from lineitem""",
    "c_files": """
select cast(o_orderkey % 8 as string) as pver_id, o_orderkey as file_id, concat_ws(chr(10),
 concat('#define SZ_', cast(o_custkey % 5 as string), ' ', cast(o_custkey % 20 + 2 as string), 'u'),
 'typedef uint8 row_t[4];', '/* fn_dead(x); { */',
 concat('static uint16 tab_', cast(o_custkey % 9 as string), '[SZ_', cast(o_custkey % 5 as string), ' * 2 + 1][2] = { {1u, 2u}, {3u, 4u}, {5u, 6u} };'),
 'struct S {', concat('  uint8 f_', cast(o_orderkey % 12 as string), '[3];'), '};', concat('void fn_p', cast(o_custkey % 7 as string), '(uint8 x);'),
 concat('uint8 fn_', cast(o_orderkey % 12 as string), '(uint8 par_', cast(o_custkey % 5 as string), ', const uint16 *ptr)'), '{',
 concat('  uint8 loc = ', case cast(o_orderkey % 3 as int) when 0 then concat('par_', cast(o_custkey % 5 as string)) when 1 then 'g_all' else '3u' end, ';'),
 '  row_t rows;', '  if (loc < 4u) {',
 concat('    tab_', cast(o_custkey % 9 as string), '[loc][1] = fn_', cast(o_custkey % 30 as string), '(&loc, "fn_str(");'), '  }',
 concat('  return (*cb_', cast(o_orderkey % 12 as string), ')(s.f_', cast(o_orderkey % 12 as string), '[(ptr[0] + 1u)]);'), '}') as text from orders""",
    "facts": """
select cast(l_orderkey % 8 as string) as pver_id, l_orderkey % 50 as group_id,
 case when l_linestatus = 'F' then 'call_path' else 'var_value' end as agent,
 case cast(l_suppkey % 8 as int) when 0 then 'alarm_site' when 1 then 'array_size_hint' when 2 then 'declaration' when 3 then 'write'
  when 4 then 'guard' when 5 then 'call_edge' when 6 then 'access' else 'local_guard' end as kind,
 concat('fn_', cast(l_suppkey % 12 as string)) as fn, l_partkey % 40 + 1 as line,
 concat('idx_', cast(l_suppkey % 5 as string), ' = x;') as quote, concat('idx_', cast(l_suppkey % 5 as string)) as symbol,
 l_returnflag <> 'N' as verified, l_linenumber as seq from lineitem""",
    "order_facts": """
select cast(l_orderkey % 8 as string) as pver_id, l_orderkey as group_id,
 case when l_linestatus = 'F' then 'call_path' else 'var_value' end as agent,
 case cast(l_suppkey % 8 as int) when 0 then 'alarm_site' when 1 then 'array_size_hint' when 2 then 'declaration' when 3 then 'write'
  when 4 then 'guard' when 5 then 'call_edge' when 6 then 'access' else 'local_guard' end as kind,
 concat('fn_', cast(l_suppkey % 12 as string)) as fn, l_partkey % 40 + 1 as line,
 concat('idx_', cast(l_suppkey % 5 as string), ' = x;') as quote, concat('idx_', cast(l_suppkey % 5 as string)) as symbol,
 l_returnflag <> 'N' as verified, l_linenumber as seq from lineitem""",
    "copy_lines": f"""
select cast(l_orderkey % 8 as string) as pver_id, l_orderkey as file_id, n as line_no,
 case when l_quantity > 45 then 'break;' else concat('cfg', cast(l_suppkey % 2 as string), '_', cast(n as string), ' = tab[', cast(case when l_quantity < 3 then n + 1 else n end as string), '];') end as text
 from (select l_orderkey, l_suppkey, l_quantity, row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as n from lineitem) as r""",
    "prove_reports": """
select cast(o_orderkey % 8 as string) as pver_id, o_orderkey as group_id,
 case cast(o_custkey % 3 as int) when 0 then 'fp' else 'no_credible_case' end as fp_claim,
 case cast(o_custkey % 4 as int) when 0 then 'unknown' when 1 then 'constant' else 'guard_bounded' end as index_range,
 case cast(o_custkey % 5 as int) when 0 then 'unknown' else 'known' end as array_size,
 case when o_orderstatus = 'F' then 'full' else 'partial' end as coverage,
 case cast(o_orderkey % 7 as int) when 0 then 'tp' else 'no_credible_case' end as tp_claim,
 case cast(o_orderkey % 14 as int) when 0 then 'found' when 3 then 'found' else 'none' end as tp_witness,
 case when o_custkey % 11 < 2 then 'timeout' else '' end as tp_error, case when o_custkey % 22 = 0 then 'timeout' else '' end as fp_error,
 case when o_orderkey % 9 = 0 then 'found' else 'none' end as fp_witness, cast(o_custkey % 4 as bigint) as n_findings, cast(case when o_custkey % 6 = 1 then 1 else 0 end as bigint) as n_missing,
 left('C1,C2,C3', cast(o_orderkey % 3 * 3 + 2 as int)) as classes, case when o_custkey % 5 = 4 then '' else left('C1,C2,C3', cast(o_custkey % 3 * 3 + 2 as int)) end as addressed,
 case when o_orderkey % 8 = 5 then 'C9' else '' end as unaddressed, case when o_custkey % 7 = 0 then 'partial' else 'full' end as merged_coverage,
 case when o_orderkey % 10 = 0 then 'partial' else 'full' end as coverage_cap, o_custkey % 8 <> 0 as has_bound,
 case cast(o_orderkey % 5 as int) when 0 then 'local' when 1 then 'global' else 'parameter' end as index_origin,
 case when o_custkey % 3 = 1 then ' ' else 'text' end as rationale from orders""",
    "findings": """
select cast(l_orderkey % 8 as string) as pver_id, l_orderkey as group_id, case when l_suppkey % 2 = 0 then 'FP_PROVE' else 'TP_PROVE' end as agent, l_returnflag <> 'N' as supported from lineitem""",
    "votes": """
select cast(e.user_id % 8 as string) as pver_id, e.user_id as group_id, e.event_id as run,
 case e.event_type when 'click' then 'TP' when 'view' then 'FP' when 'signup' then 'FP' else 'uncertain' end as label,
 e.event_id % 3 = 0 as reexplore from events e""",
    "expert_labels": """
select d.doc_id, cast(d.doc_id % 8 as string) as pver_id,
 case when l.quality is null then '' when l.quality = 1 then 'true' else 'FP' end as human_label,
 case when d.source in ('src0','src1','src2') then 'ALG TOOL' else '' end as comment,
 case cast(d.n_chars % 3 as int) when 0 then 'TP' when 1 then 'FP' else 'uncertain' end as prediction
 from documents d left join labels l on d.doc_id = l.doc_id""",
    "run_events": """
select event_id, ts, cast(user_id % 8 as string) as pver_id, cast(user_id as string) as order_key,
 case when event_id % 40 = 39 then 'done' when event_type = 'click' then 'agent_thinking' when event_type = 'view' then 'tool_result' when event_type = 'signup' then 'agent_input' when event_type = 'error' then 'agent_error' else 'agent_output' end as kind,
 case when cast(floor(value) as bigint) % 3 = 0 then null when cast(floor(value) as bigint) % 3 = 1 then 'CALL_PATH_EXPLORE' else 'VAR_VALUE_EXPLORE' end as agent,
 case when event_id % 4 = 0 then null else concat('act_', cast(event_id % 10 as string)) end as activity, props,
 case when event_id % 3 = 0 then concat('title ', cast(event_id % 17 as string)) end as title, case when event_id % 5 = 0 then concat('fn_', cast(event_id % 12 as string)) end as functions,
 case when event_id % 7 = 0 then concat('fn_', cast(event_id % 12 as string), '>fn_1') end as edges, case when event_id % 11 = 0 then concat('C', cast(event_id % 3 as string)) end as call_path,
 case when event_id % 13 = 0 then concat('idx_', cast(event_id % 5 as string)) end as var_paths, case when event_id % 9 = 0 then concat('v', cast(event_id as string)) end as var_focus,
 case when event_id % 2 = 0 then concat('c', cast(event_id as string)) end as cursor from events""",
    "runs": """
select cast(user_id % 8 as string) as pver_id, cast(user_id as string) as order_key, min(ts) as started, max(ts) as ended, cast(sum(case when event_type = 'click' then 1 else 0 end) as bigint) as calls,
 cast(sum(length(props)) as bigint) as tokens_in, count(*) as tokens_out, case when max(case when event_type = 'error' then 1 else 0 end) = 1 then 'error' when count(*) > 3 then 'done' else 'running' end as status,
 case when max(case when event_type = 'error' then 1 else 0 end) = 1 then '' when count(*) % 3 = 0 then 'TP' when count(*) % 3 = 1 then 'FP' else 'uncertain' end as label from events group by user_id""",
}
_TABLE = re.compile(r"\b(from|join)\s+(lineitem|orders|customer|events|documents|labels)\b")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in sf_dir."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for _, t in _TABLE.findall(VIEWS[name])}
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    return spark.sql(_TABLE.sub(r"\1 {\2}", text), **tables)


def with_views(names: list[str], query: str) -> str:
    """DuckDB text of query with the named views before it."""
    recursive = "recursive " if query.lstrip().startswith("--recursive") else ""
    heads = [f"{n} as ({VIEWS[n]})" for n in names]
    return f"with {recursive}" + ",\n".join(heads) + "\n" + query.replace("--recursive", "")
