"""Small literal inputs with the rows they must give."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparktriage.functions import ctext
from sparktriage.functions import scalars as S
from sparktriage.operators import corpus, enrich, facts, graph, paths, symbols, verdict
from sparktriage.sources import files
from sparktriage.streaming import events


def test_csv_orders_and_records(spark):
    text = "sep=;\nOrder;Type;Category;Location;Classification;Comment;Message\n1,002;x;Out-of-bound array access;a.c:1.2-3;;; msg \n"
    row = files.read_alarms(spark.createDataFrame([("p", "f", text)], "pver_id string, path string, text string")).first()["row"]
    assert row["Order"] == "1,002" and row["Message"] == "msg"
    assert spark.range(1).select(S.order_key(F.lit(" 1,002 "))).first()[0] == "1002"


def test_trace_blocks(spark):
    text = "noise\n[ call#main at a.c:1.1-2\ncall#read|separate at a.c:5.1-2\nALARM (A) Array_Out_Of_Bounds: x at a.c:7.3-9 ]\n> items[i]\n>   ~~~~~\nmore\n[ ALARM other ]\n"
    blocks = files.read_trace_blocks(spark.createDataFrame([("p", text)], "pver_id string, text string"))
    first, second = files.parse_blocks(blocks).orderBy("block_no").collect()
    assert len(first["call_stack"]) == 2 and first["location"] == "a.c:7.3-9" and len(first["source_lines"]) == 2
    assert second["location"].startswith("UNKNOWN_LOCATION::")


def test_unique_paths_and_edges(spark):
    stacks = {1: ["main|separate", "mid", "leaf"], 2: ["boot|separate", "mid", "leaf"], 3: ["main|separate", "mid", "leaf"]}
    frames = spark.createDataFrame([("p", b, i, f"call#{f} at a.c:{i}.1-2") for b, fs in stacks.items() for i, f in enumerate(fs, 1)], "pver_id string, block_no long, pos int, entry string")
    heads = spark.createDataFrame([("p", b, "a.c:9.1-2", "x") for b in stacks], "pver_id string, block_no long, location string, alarm string")
    assert paths.unique_sequences(frames, heads).count() == 2
    edges = {(r["src"], r["dst"]) for r in paths.path_edges(frames).collect()}
    assert edges == {("main", "mid"), ("boot", "mid"), ("mid", "leaf")}
    counts = paths.trace_counts(frames, heads).first()
    assert (counts["no_of_traces"], counts["no_of_paths"]) == (3, 2)


def test_leaf_distance_of_long_chains(spark):
    edges = spark.createDataFrame([("p", f"f{i + 1}", f"f{i}") for i in range(9)] + [("p", "f0", "f9"), ("p", "f6", "f0")], "pver_id string, caller string, callee string")
    leaves = spark.createDataFrame([("p", "f0")], "pver_id string, leaf string")
    want = {"f0": 0, "f6": 1, "f7": 2, "f8": 3, "f9": 4, **{f"f{i}": i for i in range(1, 6)}}
    assert {r["fn"]: r["distance"] for r in graph.leaf_distance(edges, leaves).collect()} == want


def test_index_origin_of_long_chains(spark):
    key = "pver_id string, file_id long, fn string"
    starts = spark.createDataFrame([("p", 1, "f", "n0"), ("p", 1, "g", "n0"), ("p", 1, "h", "filewide")], f"{key}, token string")
    sets = spark.createDataFrame([("p", 1, fn, f"n{i}", [f"n{i + 1}"]) for fn, n in (("f", 40), ("g", 60)) for i in range(n)], f"{key}, lhs string, names array<string>")
    params = spark.createDataFrame([("p", 1, "f", "n40"), ("p", 1, "g", "n60")], f"{key}, symbol string")
    functions = spark.createDataFrame([("p", 1, fn, True, at, at + 70) for fn, at in (("f", 100), ("g", 200), ("h", 300))], f"{key}, defined boolean, start_line int, end_line int")
    decls = spark.createDataFrame([("p", 1, f"n{i}", at + i) for i in range(61) for at in (100, 200)] + [("p", 1, "filewide", 5)], "pver_id string, file_id long, symbol string, line_no int")
    got = {r["fn"]: (r["origin"], r["n_names"]) for r in corpus.index_origin(starts, sets, params, decls, functions).collect()}
    assert got == {"f": ("parameter", 41), "g": ("local", 41), "h": ("global", 1)}  # declared in the file, but not in the function


def test_kahn_order():
    out = graph.kahn_order(["leaf", "global", "other", "main", "mid"], [("main", "mid"), ("mid", "leaf"), ("other", "mid")], [], "leaf")
    assert out == ["global", "main", "other", "mid", "leaf"]
    assert graph.kahn_order(["a", "b", "c"], [], ["c", "b"], None) == ["c", "b", "a"]
    assert graph.kahn_order(["x", "far", "near", "l"], [("far", "near"), ("near", "l")], [], "l") == ["far", "near", "x", "l"]  # by distance to the leaf, then the rest
    assert graph.kahn_order(["m", "z", "n", "w"], [("m", "z"), ("z", "m"), ("n", "w"), ("w", "n")], [], None) == ["m", "n", "w", "z"]
    random.seed(2)
    for _ in range(50):
        ns = [f"f{i}" for i in range(8)]
        es = [(a, b) for a in ns for b in ns if a < b and random.random() < 0.3]
        got = graph.kahn_order(ns, es, [], None)
        assert sorted(got) == ns and all(got.index(a) < got.index(b) for a, b in es)


def test_execution_order(spark):
    """Groups by brute force: of the functions that no waiting one calls, the one of least rank is next."""
    random.seed(3)
    rows, edges = [], sorted({(f"f{random.randrange(9)}", f"f{random.randrange(9)}") for _ in range(14)})
    for g in range(12):
        some = random.sample(range(9), random.randint(1, 6))
        rows += [("p", g, f"f{k}", i if random.random() < 0.5 else None, i == len(some) - 1) for i, k in enumerate(some)]
    members = spark.createDataFrame(rows, "pver_id string, grp long, fn string, position int, is_leaf boolean")
    got = graph.execution_order(members, spark.createDataFrame([("p", a, b) for a, b in edges], "pver_id string, caller string, callee string"))
    found = {}
    for r in got.orderBy("grp", "place").collect():
        found.setdefault(r["grp"], []).append(r["fn"])
    for g in range(12):
        own = {r[2]: r[3] for r in rows if r[1] == g}
        leaf = next(r[2] for r in rows if r[1] == g and r[4])
        calls = {(a, b) for a, b in edges if a in own and b in own and a != b}
        far = {leaf: 0}
        for d in range(9):
            far |= {a: d + 1 for a, b in calls if far.get(b) == d and a not in far}
        path = sorted((n for n in own if own[n] is not None), key=own.get)
        rank = lambda n: (0, path.index(n), n) if n in path else (1, -far[n], n) if n in far else (2, 0, n)
        want, waiting = [], set(own)
        while ready := [n for n in waiting if not any(b == n and a in waiting for a, b in calls)]:
            want.append(min(ready, key=rank))
            waiting.remove(want[-1])
        want += sorted(waiting, key=rank)
        assert found[g] == [n for n in want if n != leaf] + [leaf]


def test_facts(spark):
    fact = "pver_id string, group_id long, agent string, kind string, fn string, line long, quote string, symbol string, verified boolean, seq long"
    seeds = [("p", 1, agent, "declaration", "global", 5, "uint8  a[4];", "a", True, 1) for agent in ("call_path", "var_value")]
    rows = spark.createDataFrame([*seeds, ("p", 1, "call_path", "guard", "Leaf", 9, "if (i < 4)", "i", True, 2), ("p", 1, "call_path", "write", "Far", 30, "i = 1;", "i", True, 3), ("p", 1, "call_path", "write", "Leaf", 8, "i = 0;", "i", False, 4)], fact)
    guards = spark.createDataFrame([("p", 1, "Leaf", 9, "if (i < 4)", "i"), ("p", 2, "Leaf", 9, "x", "i")], "pver_id string, group_id long, fn string, line long, quote string, symbol string")
    merged = facts.merge_packs(rows, guards)
    assert {(r["group_id"], r["agent"], r["kind"], r["line"]) for r in merged.collect()} == {(1, "call_path", "declaration", 5), (1, "call_path", "guard", 9), (1, "call_path", "write", 30), (1, "var_value", "local_guard", 9), (2, "var_value", "local_guard", 9)}
    one = merged.where("group_id = 1")
    classes = spark.createDataFrame([("p", 1, "C1", "Caller"), ("p", 1, "C1", "Leaf"), ("p", 1, "C2", "Other")], "pver_id string, group_id long, class_id string, fn string")
    shared = spark.createDataFrame([("p", 1, "GetCls")], "pver_id string, group_id long, fn string")
    attached = facts.facts_by_class(one, classes, shared)
    n = spark.createDataFrame([("p", 1, 2)], "pver_id string, group_id long, n long")
    assert {(r["kind"], r["classes"]) for r in facts.compact_facts(attached, one, n).collect()} == {("declaration", "all"), ("guard", "C1"), ("local_guard", "C1"), ("write", "")}
    assert [r["fn"] for r in facts.unattached_facts(one, classes, shared).collect()] == ["Far"]
    assert [r["kind"] for r in facts.order_facts(one).orderBy("rank").collect()] == ["local_guard", "guard", "declaration", "write"]
    noisy = spark.createDataFrame([("p", 1, "call_path", k, "f", i, f"q{i}", f"s{i % 2}", True, i) for i, k in enumerate(["access"] * 30 + ["declaration"] * 10 + ["call_edge"] * 5)], fact)
    pack = facts.compact_pack(noisy, "call_path", 8).orderBy("rn").collect()
    assert [r["kind"] for r in pack] == ["declaration"] * 5 + ["call_edge"] * 3  # a second declaration of a symbol goes once more than half is kept


def test_quotes_over_lines(spark):
    lines = spark.createDataFrame([("p", 1, i, t) for i, t in enumerate(["a = 1;", "b  = f(x,", "      y);", "c;", "d;", "e;"], 1)], "pver_id string, file_id long, line_no int, text string")
    asked = {(2, "b = f(x, y);"): (True, None), (4, "f(x,"): (True, 2), (6, "c;"): (True, 4), (6, "a = 1;"): (False, None), (3, "  "): (False, None), (5, "c; d; e;"): (True, None), (1, "c;"): (True, None)}
    quotes = spark.createDataFrame([("p", 1, n, q) for n, q in asked], "pver_id string, file_id long, line_no int, quote string")
    assert {(r["line_no"], r["quote"]): (r["verified"], r["found_line"]) for r in facts.verify_quotes(quotes, lines).collect()} == asked
    findings = spark.createDataFrame([("p", 1, 1, "", 2, "b = f(x,"), ("p", 1, 1, "g", 2, "only here"), ("p", 1, 1, "h", 2, "only here"), ("p", 1, 1, "h", 4, "c;")], "pver_id string, group_id long, file_id long, fn string, line int, quote string")
    known = spark.createDataFrame([("p", 1, "g", 2, "only  here;")], "pver_id string, group_id long, fn string, line int, quote string")
    assert {(r["fn"], r["line"]): r["how"] for r in facts.supported_findings(findings, known, lines).collect()} == {("", 2): "source", ("g", 2): "fact", ("h", 2): None, ("h", 4): "source"}


def test_mined_facts(spark):
    alarms = spark.createDataFrame([("p", 1, "tbl", "cls", 7)], "pver_id string, group_id long, array string, index string, alarm_line int")
    text = {1: "uint8 tbl[] = {1, 2};", 2: "const uint8 cls,", 3: "/* tbl[cls] */", 5: "cls = get(); if (cls < 3) { tbl[cls] = 0; }", 7: "x = tbl[cls];", 8: "cls++;", 9: "while (other) {}", 10: "y = cls == 2;"}
    lines = spark.createDataFrame([("p", 1, n, t) for n, t in text.items()], "pver_id string, group_id long, line_no int, text string")
    got = {(r["line_no"], r["kind"], r["symbol"]) for r in facts.mine_facts(alarms, lines).collect()}
    assert got == {(1, "declaration", "tbl"), (5, "access", "cls"), (5, "guard", "cls"), (5, "write", "cls"), (7, "alarm_site", "cls"), (8, "write", "cls")}


def test_guards_runs_and_declarations(spark):
    text = ["int f(int i) {", "  if (i < n) {", "  if (i < SIZE_17) {", "  if (k < 9) {", "  x = i & 0x0F;", "  t[i] = 0;", "}", "int g() {", "  t[i] = 1;", "}"]
    lines = spark.createDataFrame([("p", 1, i, t) for i, t in enumerate(text, 1)], "pver_id string, file_id long, line_no int, text string")
    functions = spark.createDataFrame([("p", 1, 1, 7, 1), ("p", 1, 8, 10, 2)], "pver_id string, file_id long, start_line int, end_line int, body long")
    alarms = spark.createDataFrame([("p", 1, 6, "i", 17), ("p", 1, 6, "i", None), ("p", 1, 6, "", None), ("p", 1, 9, "i", 17), ("p", 1, 2, "i", 17)], "pver_id string, file_id long, line_no int, index string, array_size int")
    got = {(r["line_no"], r["index"], r["array_size"]): r["guard_line"] for r in symbols.local_guard(alarms, functions, lines).collect()}
    assert got == {(6, "i", 17): 3, (6, "i", None): 4, (6, "", None): 4}  # names are looked for anywhere in the text, as in if
    runs = ["P0=S[0]", "P1 = S[1];", "P2=S[2]", "P3=T[3]", "Q5=S[5]", "P4=S[5]", "P5=S[5]", "P6=S[6]"]
    lines = spark.createDataFrame([("p", 1, i, t) for i, t in enumerate(runs, 1)], "pver_id string, file_id long, line_no int, text string")
    assert [r["text"] for r in symbols.collapse_indexed_runs(lines).orderBy("line_no").collect()] == ["P[0..2]=S[0..2]", "P3=T[3]", "Q5=S[5]", "P4=S[5]", "P[5..6]=S[5..6]"]
    decls = [(1, "uint8", "uint8 CH;", "", None), (4, "A_Tom_tst", "A_Tom_tst CH[2];", "[2]", "Tom_s"), (6, "A_Atom_tst", "A_Atom_tst CH[2];", "[2]", "Atom_s"), (20, "int", "int CH;", "", None)]
    decls = spark.createDataFrame([("p", 1, "CH", *d) for d in decls], "pver_id string, file_id long, symbol string, line_no int, datatype string, d_text string, dims string, owner string")
    uses = [(9, None, None, ["TOM"]), (9, None, None, []), (30, 15, 40, ["TOM"]), (0, None, None, [])]
    for (line, start, end, tokens), want in zip(uses, [4, 6, 20, 20], strict=True):
        use = spark.createDataFrame([("p", 1, "CH", line, start, end, tokens)], "pver_id string, file_id long, symbol string, line_no int, start_line int, end_line int, tokens array<string>")
        assert symbols.resolve_declaration(use, decls).first()["d_line"] == want


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(S.clean_index(F.lit("(numClass"))) == "numClass"
    assert one(S.clean_index(F.lit("(i + 1)"))) == "i + 1"
    assert one(S.index_tokens(F.lit("a.b + 0x1F + idx + sizeof idx"))) == ["a", "idx"]
    for text, want in {"if((x) < 5u) ((void)(f));": "if (x < 5)", "if ((1 != 0)) x = 0x1Fu;": "if (1 x = 0x1F;)", "x = ((ok) != (0 != 0));": "x = ok;", "while(a)": "while (a)", "f(a.b)(c)": "f(a.b)c", "y = (uint16)((z));": "y = z;"}.items():
        assert one(S.normalize_stmt(F.lit(text))) == want, text
    assert [one(S.is_guard(F.lit(t))) for t in ("a || b", "ok = a == b;", "x % 8", "Max(a)", "f(x)")] == [True, False, True, True, False]
    writes = {"idx = 1": True, "s.idx = 1": False, "p->idx = 1": False, "// idx = 1": False, "*idx += 2;": True, "idx[3] <<= 1": True, "idx == 2": False, "if (idx = 1)": False, "return idx = 2;": False, "x = idx;": False, "++idx;": True, "idx--;": True}
    for text, want in writes.items():
        assert one(S.is_lhs_write(F.lit(text), F.lit("idx"))) == want, text
    assert [one(S.is_noise(F.lit(t))) for t in ("  // x", "};", "/* a */", "# if", "x; // y", "/* open")] == [True, True, True, True, False, False]
    assert one(S.clip(F.lit("abcdef"), 4)) == "abcd… [2 more chars]"
    assert one(S.safe_name(F.lit("1,0/é"))) == "1_0_é"
    no, yes = F.lit(False), F.lit(True)
    assert [one(S.symbol_kind(*f)) for f in ((yes, yes, yes, yes, yes), (no, yes, yes, yes, yes), (no, no, yes, yes, yes), (no, no, no, yes, yes), (no, no, no, no, yes), (no,) * 5)] == ["array", "struct_member", "pointer", "parameter", "struct", "symbol"]
    assert one(S.symbol_scope(F.lit("global"), F.lit(False), F.lit(False))) == "global"


def test_function_ranges(spark):
    text = ["int f()", "{", "x;", "if (a) {", "}", "}", "int y;", "g() {", "}"]
    lines = spark.createDataFrame([("p", 1, i, t) for i, t in enumerate(text, 1)], "pver_id string, file_id long, line_no int, text string")
    assert [(r["start_line"], r["end_line"]) for r in symbols.function_ranges(lines).orderBy("body").collect()] == [(2, 6), (8, 9)]


REPORT = {"pver_id": "p", "group_id": 1, "fp_claim": "fp", "index_range": "constant", "array_size": "known", "coverage": "full", "tp_claim": "no_credible_case", "tp_witness": "none", "tp_error": "", "fp_error": "", "fp_witness": "none", "n_findings": 1, "n_missing": 0, "classes": "C1,C2", "addressed": "C1,C2", "unaddressed": "", "merged_coverage": "full", "coverage_cap": "full", "has_bound": True, "index_origin": "parameter", "rationale": "because"}
REPORT_SCHEMA = ", ".join(f"{k} {'long' if k[:2] == 'n_' or k == 'group_id' else 'boolean' if k == 'has_bound' else 'string'}" for k in REPORT)


def reports_of(spark, *changes):
    return spark.createDataFrame([tuple({**REPORT, "group_id": i, **c}.values()) for i, c in enumerate(changes, 1)], REPORT_SCHEMA)


def test_fp_checklist(spark):
    one_wrong = [{"fp_claim": "no_credible_case"}, {"coverage": "partial"}, {"unaddressed": "C2"}, {"fp_error": "timeout"}, {"index_range": "unknown"}, {"array_size": "unknown"}, {"fp_witness": "found"}, {"n_findings": 0}, {"n_missing": 1}, {"merged_coverage": "partial"}, {"coverage_cap": "partial"}, {"addressed": "C1"}, {"has_bound": False, "index_range": "guard_bounded"}, {"tp_claim": "tp", "tp_witness": "found"}]
    fine = [{}, {"has_bound": False}, {"tp_witness": "found"}, {"addressed": "C2,C1,C1"}, {"addressed": "C9"}, {"classes": ""}]  # a witness without a claim, and classes that are no strict subset, fail nothing
    n = [len(r[0]) for r in reports_of(spark, *one_wrong, *fine).orderBy("group_id").select(verdict.fp_reasons()).collect()]
    assert n == [1] * len(one_wrong) + [0] * len(fine)


def test_policy(spark):
    reports = reports_of(spark, {}, {"array_size": "unknown", "tp_claim": "tp", "tp_witness": "found"}, {"fp_claim": "no_credible_case"}, {"tp_error": "x", "fp_error": "y"}, {"array_size": "unknown", "tp_claim": "tp"}, {"array_size": "unknown"}, {"fp_claim": "no_credible_case", "tp_witness": "found"})
    gates = {r["group_id"]: r["gate"] for r in verdict.hard_gate(reports).collect()}
    assert gates == {1: "FP", 2: "TP", 3: "none", 4: "uncertain", 5: "none", 6: "none", 7: "none"}
    cast = {1: ["uncertain"], 2: ["FP", "FP"], 3: ["uncertain", "TP"], 4: ["FP", "TP"], 5: ["FP", "uncertain"], 6: ["FP", "uncertain", "TP"], 7: ["uncertain", "TP"], 8: ["FP", "uncertain"]}
    votes = spark.createDataFrame([("p", g, r, v, True) for g, vs in cast.items() for r, v in enumerate(vs)], "pver_id string, group_id long, run int, label string, reexplore boolean")
    got = {r["group_id"]: (r["label"], r["reexplore"]) for r in verdict.final_verdict(votes, reports).collect()}
    assert got == {1: ("FP", False), 2: ("TP", False), 3: ("uncertain", True), 4: ("uncertain", False), 5: ("TP", False), 6: ("uncertain", True), 7: ("TP", False), 8: ("uncertain", True)}


def test_coverage_and_validation(spark):
    reports = reports_of(spark, {"index_origin": "local", "classes": "C1,C2,C3", "addressed": "C1"}, {"index_origin": "parameter", "classes": "C1,C2,C3", "addressed": "C1,C7"}, {"index_origin": "local", "addressed": "C1", "n_findings": 0}, {"merged_coverage": "partial"})
    got = [(r["addressed"], r["unaddressed"], r["coverage"]) for r in verdict.class_coverage(reports).orderBy("group_id").collect()]
    assert got == [("C1,C2,C3", "", "full"), ("C1", "C2,C3", "partial"), ("C1", "C2", "partial"), ("C1,C2", "", "partial")]
    reports = reports_of(spark, {}, {"array_size": "unknown"}, {"tp_claim": "tp", "tp_witness": "found"}, {"tp_claim": "tp", "tp_witness": "found"}, {})
    findings = spark.createDataFrame([("p", g, a, ok) for g, a, ok in [(1, "FP_PROVE", True), (2, "FP_PROVE", True), (3, "TP_PROVE", False), (3, "FP_PROVE", True), (4, "TP_PROVE", True), (5, "FP_PROVE", False)]], "pver_id string, group_id long, agent string, supported boolean")
    got = {r["group_id"]: (r["fp_claim"], r["tp_claim"], r["tp_witness"], r["dropped"]) for r in verdict.validate_reports(reports, findings).collect()}
    none = "no_credible_case"
    assert got == {1: ("fp", none, "none", ""), 2: (none, none, "none", "fp claim"), 3: ("fp", none, "none", "tp findings;tp witness;tp claim"), 4: (none, "tp", "found", "fp claim"), 5: (none, none, "none", "fp findings;fp claim")}
    assert verdict.coerce_report(reports_of(spark, {"fp_claim": "TP", "index_range": "Modulo", "coverage": "FULL", "rationale": " ", "n_findings": 0, "addressed": ""})).select("fp_claim", "index_range", "coverage", "empty_report").first() == (none, "unknown", "full", True)


def test_trim_brief(spark):
    rows = [("p", 1, i, "access", "f", i, "x" * 50) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "pver_id string, group_id long, rank int, kind string, fn string, line int, quote string")
    assert facts.trim_brief(df, 10**6).first()["n_kept"] == 40
    assert facts.trim_brief(df, 10).first()["n_kept"] == 8
    assert facts.trim_brief(df, 1400).first()["n_kept"] == 22  # 40, 30, 22


def test_cfg_round_trip_and_text(spark, tmp_path):
    text = json.dumps({"main": ["a", "b"], "leaf": None})
    edges = files.read_cfg(spark.createDataFrame([("p", text)], "pver_id string, text string"))
    assert {(r["caller"], r["callee"]) for r in edges.collect()} == {("main", "a"), ("main", "b"), ("leaf", None)}
    assert json.loads(files.cfg_json(edges).first()["text"])["main"] == ["a", "b"]
    (tmp_path / "p1").mkdir()
    (tmp_path / "p1" / "a.c").write_bytes("é\r\nx\n".encode("cp1252"))
    (tmp_path / "p1" / "b.c").write_bytes("é\n".encode("utf-16"))
    got = files.source_lines(files.read_text_files(spark, str(tmp_path))).orderBy("path", "line_no").collect()
    assert [(r["pver_id"], r["line_no"], r["text"]) for r in got] == [("p1", 1, "é"), ("p1", 2, "x"), ("p1", 1, "é")]


def test_stream_equals_batch(spark, tmp_path):
    schema = "event_id long, ts string, pver_id string, order_key string, kind string, agent string, activity string, props string"
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "p", str(i % 3), "agent_error" if i == 7 else "x", ["A", None, "B"][i % 3 if i < 6 else 1], f"act{i}" if i % 2 else None, "{}") for i in range(20)]
    source = tmp_path / "in"
    for part in range(2):
        files.write_events(spark.createDataFrame(rows[part * 10 : part * 10 + 10], schema).coalesce(1), str(source))
    stream = events.stream_events(spark, str(source))
    batch = spark.read.schema(events.SCHEMA).json(str(source))
    for fold in (events.focus_state, events.job_status):
        query = fold(stream).writeStream.outputMode("complete").format("memory").queryName(fold.__name__).trigger(availableNow=True).start()
        query.awaitTermination()
        assert sorted(map(str, spark.table(fold.__name__).collect())) == sorted(map(str, fold(batch).collect()))
    events.event_tail_sink(stream, str(tmp_path / "tail"), str(tmp_path / "check"), 3).awaitTermination()
    assert events.read_tail(spark, str(tmp_path / "tail")).count() == 9
    more = [(i, f"2024-01-01 00:01:{i:02d}", "p", "1", "done", None, None, "{}") for i in range(30, 35)]
    files.write_events(spark.createDataFrame(more, schema).coalesce(1), str(source))
    events.event_tail_sink(stream, str(tmp_path / "tail"), str(tmp_path / "check"), 3).awaitTermination()
    kept = {(r["order_key"], r["event_id"]) for r in events.read_tail(spark, str(tmp_path / "tail")).collect()}
    assert len(kept) == 9 and {i for k, i in kept if k == "1"} == {32, 33, 34} and {i for k, i in kept if k == "0"} == {12, 15, 18}
    versions = sorted(x.parent.name for x in (tmp_path / "tail").glob("v=*/bucket=*"))
    assert len(versions) == len({r[0] for r in events.read_tail(spark, str(tmp_path / "tail")).select("bucket").collect()})  # older versions are gone


@pytest.fixture
def state_store(spark):
    spark.conf.set(*events.STATE_STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset(events.STATE_STORE[0])
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_visit_gate_stream(spark, tmp_path, state_store):
    fields = "ts timestamp, event_id long, pver_id string, order_key string, fn string, is_submit boolean, n_facts int"
    rows = [(0, None, True, 1), (1, "a", False, 0), (2, None, True, 1), (3, "b", False, 0), (4, "x", False, 0), (5, None, True, 0), (6, None, True, 2), (7, "c", False, 0)]
    table = spark.createDataFrame([(i, "p", k, *r) for k in ("1", "2") for i, *r in rows], "event_id long, pver_id string, order_key string, fn string, is_submit boolean, n_facts int").withColumn("ts", F.timestamp_seconds("event_id"))
    needed = spark.createDataFrame([("p", "1", ["a", "b"]), ("p", "2", ["a", "c"])], "pver_id string, order_key string, fns array<string>")
    for low, high in ((0, 3), (3, 9)):
        table.where(f"event_id >= {low} and event_id < {high}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = events.visit_gate_stream(stream, needed).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(map(tuple, spark.table("gate").collect()))
    assert got == sorted(map(tuple, events.visit_gate(table, needed).collect()))
    assert [r[3] for r in got] == [False, False, False, True, False, False, False, False]
    kept = events.opened_functions(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, kept.collect())) == [("p", "1", "a"), ("p", "1", "b"), ("p", "2", "a"), ("p", "2", "c")]


def test_visit_gate_forgets(spark, tmp_path, state_store):
    fields = "ts timestamp, event_id long, pver_id string, order_key string, fn string, is_submit boolean, n_facts int"
    table = spark.createDataFrame([(0, "p", "1", "a", False, 0), (1, "p", "1", None, True, 1), (2, "p", "1", None, True, 1)], "event_id long, pver_id string, order_key string, fn string, is_submit boolean, n_facts int").withColumn("ts", F.timestamp_seconds("event_id"))
    needed = spark.createDataFrame([("p", "1", ["a"])], "pver_id string, order_key string, fns array<string>")
    for keep, want in ((None, [(1, True), (2, True)]), (1, [(1, True), (2, False)])):
        folder = tmp_path / str(keep)
        for low, high in ((0, 2), (2, 3)):
            table.where(f"event_id >= {low} and event_id < {high}").coalesce(1).write.mode("append").json(str(folder / "in"))
            gate = events.visit_gate_stream(spark.readStream.schema(fields).json(str(folder / "in")), needed, keep)
            gate.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start().awaitTermination()
        assert sorted((r["event_id"], r["accepted"]) for r in spark.read.parquet(str(folder / "out")).collect()) == want


def test_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "1,002", "20240101T000000Z", "x"), ("p1", "7/8", "20240102T000000Z", "y"), ("p2", "9", "20240102T000000Z", "z")], "pver_id string, order_key string, stamp string, text string")
    files.write_artifact(rows, str(tmp_path), "merge")
    back = files.read_artifact(spark, str(tmp_path), "merge")
    assert sorted(map(tuple, back.select("pver_id", "safe_order", "stamp", "text").collect())) == [("p1", "1_002", "20240101T000000Z", "x"), ("p1", "7_8", "20240102T000000Z", "y"), ("p2", "9", "20240102T000000Z", "z")]
    group = '{"group_id": 3, "location": "a.c:1.2-3", "paths": [{"path_id": 1, "function_sequence": ["f"]}], "variable_info": {"symbol_name": "t", "member_path": ["s", "t"]}, "symbol_infos": [{"symbol_name": "t", "access_counts": {"read": 2}, "occurrences": [{"location": "a.c:1.2", "access": "read"}]}]}'
    (tmp_path / "info.json").write_text(f"[{group}]")
    groups = files.read_variable_info(spark, str(tmp_path / "info.json"))
    files.write_variable_info(groups, str(tmp_path / "info"))
    for df in (groups, files.read_variable_info(spark, str(tmp_path / "info"))):
        r = df.first()
        assert (r["group_id"], r["paths"][0]["function_sequence"], r["variable_info"]["member_path"], r["symbol_infos"][0]["access_counts"], r["symbol_infos"][0]["occurrences"][0]["access"]) == (3, ["f"], ["s", "t"], {"read": 2}, "read")
    text = 'sep=;\nOrder;Message;Type\n1;"a; ""b"" ";x\n2;;\n'
    got = files.read_alarms(spark.createDataFrame([("p", "f", text)], "pver_id string, path string, text string")).orderBy("alarm_seq").collect()
    assert [r["row"] for r in got] == [{"Order": "1", "Message": 'a; "b"', "Type": "x"}, {"Order": "2", "Message": "", "Type": ""}]


def test_given_names_and_primary_path(spark):
    frames = spark.createDataFrame([("p", 1, 1, "no call here"), ("p", 2, 1, "call#a at x.c:1.1-2"), ("p", 2, 2, "call#a at x.c:1.1-2"), ("p", 2, 3, "call#b at x.c:2.1-2"), ("p", 3, 1, "call#c at x.c:2.1-2"), ("p", 3, 2, "call#d at x.c:2.1-2"), ("p", 3, 3, "call#e at x.c:2.1-2")], "pver_id string, block_no long, pos int, entry string")
    heads = spark.createDataFrame([("p", i, "l", "x") for i in (1, 2, 3)], "pver_id string, block_no long, location string, alarm string")
    named = spark.createDataFrame([("p", 1, ["m|separate", "n"]), ("p", 2, ["zz"])], "pver_id string, block_no long, fns array<string>")
    assert {r["block_no"]: r["fns"] for r in paths.traces(frames, heads, named).collect()} == {1: ["m", "n"], 2: ["a", "a", "b"], 3: ["c", "d", "e"]}
    records = paths.path_records(frames, heads, spark.createDataFrame([("p", "l", "own")], "pver_id string, location string, fn string"))
    assert {r["path_id"]: r["fns"] for r in records.collect()}[1] == ["own"]
    for center, want in (("b", "a>b"), ("zz", "c>d>e"), ("own", "own")):
        assert paths.primary_paths(records, spark.createDataFrame([("p", "l", center)], "pver_id string, location string, fn string")).first()["seq"] == want


def test_c_corpus(spark):
    text = """/* dead(x); { */
#define N 3u
__attribute__((noinline)) int helper(void) { return 0; }
extern void proto(int a);
static uint8
 late[N];
VAR(uint8, FAST) wrapped;
void Inner(int x, const struct T *p) { if (x) { helper(); (*callback)("}"); helper(); } }
int open_end(void) {
"""
    texts = spark.createDataFrame([("p", 1, text), ("p", 2, None), ("p", 3, "")], "pver_id string, file_id long, text string")
    fns = corpus.extract_functions(texts)
    assert {(r["fn"], r["defined"]) for r in fns.collect()} == {("helper", True), ("proto", False), ("Inner", True)}
    assert [(r["caller"], r["callee"]) for r in corpus.extract_calls(fns).orderBy("caller", "pos").collect()] == [("Inner", "helper"), ("Inner", "callback")]
    found = {(r["symbol"], r["datatype"], r["dims"], r["macro"]) for r in corpus.extract_declarations(texts).collect()}
    assert {("late", "uint8", "[N]", False), ("wrapped", "uint8", "", True)} <= found
    assert {(r["symbol"], r["datatype"], r["pointer_depth"]) for r in corpus.extract_parameters(fns).collect()} == {("x", "int", 0), ("p", "T", 1)}
    assert corpus.extract_functions(texts.limit(0)).count() == 0


def test_c_helpers():
    assert [corpus.dim_eval(t, {"N": 3}) for t in ("(N + 1u) * 2", "7 / 2 - 1", "M", "", "1 / 0", "2 2", "(1")] == [8, 2, None, None, None, None, None]
    text = "x = (p->f)[i + a[1]];"
    assert corpus.array_from_bracket(text, text.index("[")) == ("f", "p->f", 0) and corpus.array_from_bracket("return [", 7) == (None, None, 0)
    assert corpus.array_from_bracket("a.b[2][k[1]][j] = 0;", 12) == ("b", "a.b", 2) and corpus.array_from_bracket("no bracket", 1) == (None, None, 0)
    assert corpus.locate_access([], [text], 11, 20) == ("f", "p->f", "i + a[1]]", 0) and corpus.locate_access([], [text], 11, None) == ("f", "p->f", "i + a[1]", 0)
    assert corpus.locate_access(["x = 1;", "y = tbl"], ["  [i];"], 3, 4) == ("tbl", "tbl", "i", 0)  # the name on a line before
    assert corpus.locate_access([], ["y = tbl[a", "  + b", "  ] + 1;"], 8, 2) == ("tbl", "tbl", "a\n  + b", 0)  # over three lines
    assert corpus.locate_access(["q[1] = 0;"], ["f(x);"], 1, 2)[:2] == ("q", "q")  # the first access of the lines
    assert corpus.locate_access([], ["f(x);"], 1, 2)[0] is None
    assert corpus.blank('a "x{" /* { */ b') == "a      " + " " * 8 + "b"


def test_symbol_infos(spark):
    text = """#define N 4u
typedef uint8 row_t[3];
static uint16 tbl[N + 1];
uint8 cls;
struct Dev {
  row_t CH;
};
int Leaf(uint8 numClass, int *out) {
  uint8 pos = numClass;
  fill(&pos, tbl);
  tbl[pos] = 1;
  dev.CH[numClass] = pos;
  return 0;
}
int Other(int numClass) {
  uint8 pos = 1;
  other.CH[pos] = cls;
  return pos + numClass;
}"""
    texts = spark.createDataFrame([("p", 1, text), ("p", 2, None)], "pver_id string, file_id long, text string")
    lines = files.source_lines(texts.withColumn("path", F.lit("x")).where("text is not null")).select("pver_id", F.lit(1).cast("long").alias("file_id"), "line_no", "text")
    points = spark.createDataFrame([("p", 1, 11, 6), ("p", 1, 12, 9)], "pver_id string, file_id long, line_no int, col int")
    got = {(r["line_no"], r["role"], r["symbol"]): r for r in enrich.symbol_infos(corpus.resolve_access(points, lines), texts).collect()}
    assert set(got) == {(11, "array", "tbl"), (11, "index", "pos"), (12, "array", "CH"), (12, "parent", "dev"), (12, "index", "numClass")}
    told = lambda k: tuple(got[k][c] for c in ("kind", "scope", "datatype", "dims", "sizes", "size_known", "declared_in", "declaration_line", "declaration_kind"))
    assert told((11, "array", "tbl")) == ("array", "global", "uint16", "[N+1]", [5], True, None, 3, "variable")
    assert told((11, "index", "pos")) == ("symbol", "local", "uint8", "", None, None, "Leaf", 9, "variable")
    assert told((12, "array", "CH")) == ("array", "struct_member", "row_t", "[3]", [3], True, None, 6, "struct_member")
    assert told((12, "index", "numClass")) == ("parameter", "parameter", "uint8", "", None, None, "Leaf", 8, "parameter")
    assert told((12, "parent", "dev"))[-1] == "unknown"
    count = lambda k: tuple(got[k][f"n_{c}"] for c in ("declaration", "address", "write", "parameter", "read"))
    assert count((11, "index", "pos")) == (1, 1, 0, 0, 2) and got[11, "index", "pos"]["occurrence_count"] == 4 and got[11, "index", "pos"]["n_passed"] == 1
    assert count((11, "array", "tbl")) == (1, 0, 1, 1, 0) and got[11, "array", "tbl"]["n_passed"] == 1
    assert count((12, "array", "CH")) == (1, 0, 1, 0, 0)  # other.CH is another object's
    assert got[12, "index", "numClass"]["occurrence_count"] == 3 and got[12, "index", "numClass"]["n_functions"] == 1


def test_access_and_origins(spark):
    text = ["int Get(int a) {", "  return a;", "}", "void Fill(int *p) {", "}", "int Size(void) {", "  return 1;", "}", "void Caller(void) {", "  int cls = Size();", "  Alarm(cls);", "}", "void Alarm(int cls) {", "  int i = Get(cls) + missing(1);", "  int pos = i;", "  Fill(&pos);", "  tbl", "    [pos] = 0;", "}"]
    texts = spark.createDataFrame([("p", 1, "\n".join(text))], "pver_id string, file_id long, text string")
    lines = spark.createDataFrame([("p", 1, i, t) for i, t in enumerate(text, 1)], "pver_id string, file_id long, line_no int, text string")
    alarms = spark.createDataFrame([("p", 1, 18, 5, 18, 8, None), ("p", 1, 5, 1, 5, 1, "other"), ("p", 1, 2, 1, 2, 1, "a.b")], "pver_id string, file_id long, line_no int, col int, end_line int, end_col int, underlined string")
    got = {r["line_no"]: (r["array"], r["index"], r["dimension"]) for r in corpus.resolve_access(alarms, lines).collect()}
    assert got == {18: ("tbl", "pos", 0), 5: ("other", None, None), 2: (None, None, None)} or got[18] == ("tbl", "pos", 0) and got[5] == ("other", None, None)
    functions = corpus.extract_functions(texts)
    starts = spark.createDataFrame([("p", 1, "Alarm", "pos"), ("p", 1, "Alarm", "cls")], "pver_id string, file_id long, fn string, token string")
    path = spark.createDataFrame([("p", 1, "Alarm", "Caller", 1)], "pver_id string, file_id long, fn string, caller string, pos int")
    found = corpus.value_origins(starts, corpus.extract_assignments(functions), functions, corpus.extract_parameters(functions), path)
    assert {(r["token"], r["place"]): r["callee"] for r in found.collect()} == {("pos", 1): "Fill", ("pos", 2): "Get", ("cls", 1): "Size"}


def test_constants(spark):
    text = ["#define N (4u)", "#define N 5", "enum { A = 2, B, C = -7 };", "#if X = 3", "x == 9; y = 0;", "#define M (N + 1)"]
    lines = spark.createDataFrame([("p", 1, i, t) for i, t in enumerate(text, 1)], "pver_id string, file_id long, line_no int, text string")
    assert {r["name"]: r["value"] for r in symbols.extract_constants(lines).collect()} == {"N": 4, "A": 2, "C": -7, "y": 0}


def test_statements_that_declare_nothing_are_not_cut_into_pieces(monkeypatch):
    cut, pieces = [], ctext._PIECE

    class Counted:
        def finditer(self, *a):
            cut.append(a[1:])
            return pieces.finditer(*a)

    monkeypatch.setattr(ctext, "_PIECE", Counted())
    assert list(ctext.declarations("void f(void) { a[1] = 2; return b; x.y = 3; i = j = 4; {5; é; } uint8 k; }")) == [("k", "uint8", False, 0, "", 1, None)]
    assert len(cut) == 1
