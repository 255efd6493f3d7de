"""The enrichment job on literal files, its round trip, and the helpers that keep large files and symbols from being one task."""

import random

import pytest
from pyspark.sql import functions as F

from sparktriage.functions import ctext
from sparktriage.operators import corpus, enrich, symbols
from sparktriage.sources import files

TEXT = """#define N 3u
uint8 tab[N], other[2][N];
void Fill(uint8 *p, void (*cb)(uint8, int));
struct Dev {
  uint8 CH[4];
} dev_t;
uint8 Leaf(uint8 cls, struct Dev *d)
{
  uint8 pos = cls;
  Fill(&pos, tab);
  if (pos < N) tab[pos] = d->CH[other[1][pos]];
  return tab[pos];
}
"""


@pytest.fixture(scope="module")
def groups(spark):
    texts = spark.createDataFrame([("p", 1, "a.c", TEXT), ("p", 2, "b.c", None), ("q", 1, "a.c", "")], "pver_id string, file_id long, name string, text string")
    heads = [("p", 1, "a.c:11.19-22", "ALARM (A) array_out_of_bounds"), ("p", 2, "a.c:11.19-22", "Array_Out_Of_Bounds"), ("p", 3, "a.c:11.32-47", "array_out_of_bounds"), ("p", 4, "a.c:11.32-47", "overflow"), ("p", 5, "none.c:1.1-2", "array_out_of_bounds"), ("p", 6, None, "array_out_of_bounds"), ("p", 7, "b.c:3.1-2", "array_out_of_bounds"), ("q", 8, "no place", "array_out_of_bounds"), ("q", 9, "a.c:9.1-2", None)]
    frames = [("p", 1, 1, "call#main at m.c:1.1-2"), ("p", 1, 2, "call#Leaf|x at m.c:2.1-2"), ("p", 2, 1, "call#main at m.c:1.1-2"), ("p", 5, 1, "call#far at m.c:1.1-2")]
    marked = spark.createDataFrame([("p", "none.c:1.1-2", "x.y"), ("p", "a.c:11.32-47", "shown")], "pver_id string, location string, variable string")
    return enrich.enrich(spark.createDataFrame(frames, "pver_id string, block_no long, pos int, entry string"), spark.createDataFrame(heads, "pver_id string, block_no long, location string, alarm string"), texts, marked)


def test_groups(groups):
    got = {(r["pver_id"], r["location"]): r for r in groups.collect()}
    assert set(got) == {("p", "a.c:11.19-22"), ("p", "a.c:11.32-47"), ("p", "none.c:1.1-2"), ("p", None), ("p", "b.c:3.1-2"), ("q", "no place")} - {("p", None)} or ("p", None) in got
    one = got["p", "a.c:11.19-22"]
    assert (one["group_id"], one["no_of_traces"], one["no_of_paths"], one["variable"], one["enclosing_function"]) == (1, 2, 2, "tab[pos]", "Leaf")
    assert [p["function_sequence"] for p in one["paths"]] == [["main", "Leaf"], ["main"]]
    infos = {x["symbol_name"]: x for x in one["symbol_infos"]}
    assert [x["symbol_name"] for x in one["symbol_infos"]] == ["tab", "pos"]
    tab, pos = infos["tab"], infos["pos"]
    assert (tab["kind"], tab["scope"], tab["resolved_sizes"], tab["size_known"], tab["declaration_line"], tab["dimension_index"]) == ("array", "global", [3], True, 2, 0)
    assert tab["access_counts"] == {"declaration": 1, "parameter": 1, "write": 1, "read": 1} and tab["used_in_functions"] == ["global", "Leaf"]
    assert [(p["function"], p["mode"], p["location"]) for p in tab["passed_to"]] == [("Fill", "value", "a.c:10.14-16")]
    assert (pos["scope"], pos["declared_in_function"], pos["declaration_text"], pos["occurrence_count"], pos["occurrences_truncated"]) == ("local", "Leaf", "uint8 pos = cls;", 6, False)
    assert [(o["location"], o["access"]) for o in pos["occurrences"]][:2] == [("a.c:9.9-11", "declaration"), ("a.c:10.9-11", "address")]
    two = got["p", "a.c:11.32-47"]
    assert two["variable"] == "shown" and two["variable_info"]["member_path"] == ["d", "CH"] and two["paths"][0]["function_sequence"] == ["Leaf"]  # a path without functions has the enclosing one
    assert [(x["symbol_name"], x["role"]) for x in two["symbol_infos"]] == [("CH", "array"), ("d", "parent"), ("other", "index"), ("pos", "index")]
    ch, d, other, _ = two["symbol_infos"]
    assert (ch["kind"], ch["member_of"], ch["parent_symbol"], ch["resolved_sizes"]) == ("array", "dev_t", "d", [4]) and other["resolved_sizes"] == [2, 3]
    assert (d["kind"], d["pointed_type"], d["scope"]) == ("pointer", "Dev", "parameter")
    for lost in (("p", "none.c:1.1-2"), ("p", "b.c:3.1-2"), ("q", "no place")):
        assert got[lost]["symbol_infos"] == [] and got[lost]["variable_info"] is None


def test_round_trip(spark, groups, tmp_path):
    files.write_variable_info(groups.where("pver_id = 'p'").drop("pver_id"), str(tmp_path / "info"))
    back = {r["location"]: r for r in files.read_variable_info(spark, str(tmp_path / "info")).collect()}
    for r in groups.where("pver_id = 'p'").collect():
        assert {k: v for k, v in r.asDict(True).items() if k != "pver_id"} == back[r["location"]].asDict(True)


def test_no_rows(spark, groups):
    none = spark.createDataFrame([], "pver_id string, block_no long, location string, alarm string")
    texts = spark.createDataFrame([("p", 1, "a.c", TEXT)], "pver_id string, file_id long, name string, text string")
    frames = spark.createDataFrame([], "pver_id string, block_no long, pos int, entry string")
    assert enrich.enrich(frames, none, texts).collect() == []


def test_two_ended(spark, monkeypatch):
    monkeypatch.setattr(enrich, "STRETCH", 8)
    rng = random.Random(3)
    rows = [(k, line, col) for k, n in ((1, 300), (2, 6), (3, 7), (4, 5), (5, 1)) for line, col in rng.sample([(a, b) for a in range(100) for b in range(5)], n)]
    got = enrich.two_ended(spark.createDataFrame(rows, "k int, line int, col int"), ["k"], ["line", "col"], 6).collect()
    for k in range(1, 6):
        mine = sorted(r[1:] for r in rows if r[0] == k)
        want = mine if len(mine) <= 6 else mine[:3] + mine[-3:]
        assert sorted((r["line"], r["col"]) for r in got if r["k"] == k) == want and all(r["total"] == len(mine) for r in got if r["k"] == k)


def test_ranges_by_stretches(spark):
    """Stretches of any length give the bodies of one pass, also below depth 0 and with runs left open."""
    rng = random.Random(1)
    texts = {f: [rng.choice(["x;", "{", "}", "} {", "{ {", "}}", "a {} b"]) for _ in range(rng.randint(0, 60))] for f in range(30)}
    lines = spark.createDataFrame([("p", f, i, t) for f, ts in texts.items() for i, t in enumerate(ts, 1)], "pver_id string, file_id long, line_no int, text string")
    want = set()
    for f, ts in texts.items():
        depth, body, start = 0, 0, None
        for i, t in enumerate(ts, 1):
            before, depth = depth, max(0, depth + t.count("{") - t.count("}"))
            if before == 0 and depth > 0:
                body, start = body + 1, i
            if before > 0 or depth > 0:
                end = i
            if start and (depth == 0 or i == len(ts)) and (before > 0 or depth > 0):
                want.add((f, body, start, end))
                start = None if depth == 0 else start
    for stretch in (1, 3, 7, 4096):
        got = {(r["file_id"], r["body"], r["start_line"], r["end_line"]) for r in symbols.function_ranges(lines, stretch).collect()}
        assert got == want


def test_declarations_by_brute_force(spark):
    """The sweep gives what comparing each use with each declaration gives."""
    rng = random.Random(2)
    bodies = [(10, 30), (40, 60), (70, 90)]
    decls = sorted({(rng.choice("ab"), rng.randint(1, 100)) for _ in range(25)})
    decls = [(s, line, rng.choice(["A_Tom", "uint8"]), "x", rng.choice(["", "[2]"]), rng.choice([None, "Tom_s"])) for s, line in decls]
    uses = []
    for _ in range(120):
        line = rng.randint(1, 100)
        uses.append((rng.choice("abc"), line, *next(((a, b) for a, b in bodies if a <= line <= b), (None, None)), rng.choice([[], ["tom"], ["uint8", "x"]])))
    uses = [(s, line, *(next(((a, b) for a, b in bodies if a <= line <= b), (None, None))), t) for s, line, _, _, t in uses]
    once = {(u[0], u[1]): u for u in uses}

    def want(symbol, line, start, end, tokens):
        pool = [d for d in decls if d[0] == symbol]
        pool = [d for d in pool if start is not None and start <= d[1] <= end] or pool
        pool = [d for d in pool if d[1] <= line] or pool
        pieces = lambda d: {x for x in f"{d[2]}_{d[3]}".lower().split("_")}
        score = lambda d: (d[4] != "") + (d[5] is not None) + sum(5 * (t in pieces(d)) + 4 * (t in (d[5] or "").lower()) for t in tokens)
        return max(pool, key=lambda d: (score(d) if tokens else 0, d[1]))[1] if pool else None

    given = spark.createDataFrame([("p", 1, *u) for u in once.values()], "pver_id string, file_id long, symbol string, line_no int, start_line int, end_line int, tokens array<string>")
    table = spark.createDataFrame([("p", 1, s, line, t, d, dims, o) for s, line, t, d, dims, o in decls], "pver_id string, file_id long, symbol string, line_no int, datatype string, d_text string, dims string, owner string")
    got = {(r["symbol"], r["line_no"]): r["d_line"] for r in symbols.resolve_declaration(given, table).collect()}
    assert got == {k: w for k, u in once.items() if (w := want(*u)) is not None}


def test_origins_of_assignments(spark):
    """Conditions, several lines, operators with =, chains: the right side counts, whatever stands before the assignment."""
    text = ["void f(int par, int q)", "{", "  int i, k, z, c, d, n;", "  if (m == 1u) i = par;", "  k = 1u +", "    par;", "  z <<= par;", "  c = d = par;", "  n = (q <= 3) ? 1 : 2;", "  w[q] = par; if (n >= 2) { e != par; }", "}"]
    texts = spark.createDataFrame([("p", 1, "\n".join(text))], "pver_id string, file_id long, text string")
    functions = corpus.extract_functions(texts)
    starts = spark.createDataFrame([("p", 1, "f", t) for t in ("i", "k", "z", "c", "d", "n", "e", "w")], "pver_id string, file_id long, fn string, token string")
    got = corpus.index_origin(starts, corpus.extract_assignments(functions), corpus.extract_parameters(functions), corpus.extract_declarations(texts), functions)
    assert {r["token"]: r["origin"] for r in got.collect()} == {"i": "parameter", "k": "parameter", "z": "parameter", "c": "parameter", "d": "parameter", "n": "parameter", "e": "global", "w": "parameter"}


def test_written_by_brackets(spark):
    lines = ["tab[idx[i]] = 5u;", "x = tab[idx[i]];", "a[b[c[d]]] += 1;", "a[i][j[0]]++;", "a[i] == 3;", "t[i] <<= 2;"]
    df = spark.createDataFrame([("p", 1, i, t) for i, t in enumerate(lines, 1)], "pver_id string, file_id long, line_no int, text string")
    got = {(r["line_no"], r["symbol"]) for r in symbols.occurrences(df).where("access = 'write'").collect()}
    assert got == {(1, "tab"), (2, "x"), (3, "a"), (4, "a"), (6, "t")}


def test_declarators():
    text = "int *a, b[3], (*fp)(int, char), *const q = 0;\nstatic uint16 t[N * 2][2] = { {1u}, f(2) }, u;\nVAR(uint8, X) w; unsigned int ui;\nT1\n late[4];\nx = y; f(a); return z; a == b; p->q = 3; { goto end; }"
    got = {(n, k, d, dims) for n, k, _, d, dims, _, _ in ctext.declarations(text)}
    assert got == {("a", "int", 1, ""), ("b", "int", 0, "[3]"), ("fp", "int", 1, ""), ("q", "int", 1, ""), ("t", "uint16", 0, "[N*2][2]"), ("u", "uint16", 0, ""), ("w", "uint8", 0, ""), ("ui", "unsigned int", 0, ""), ("late", "T1", 0, "[4]")}
    assert ctext.parameters("uint8 x, void (*cb)(uint8, int), const T *p, int a[2], unsigned long w, void, ...") == [("x", "uint8", "", 0), ("cb", "void", "", 1), ("p", "T", "", 1), ("a", "int", "[2]", 0), ("w", "unsigned long", "", 0)]
    assert ctext.parameters("void") == [] and ctext.parameters(None) == [] and list(ctext.declarations("int (")) == []


def test_scanners_are_linear():
    """Ten times the lines cost about ten times the time; a quadratic scan would cost a hundred times."""
    import time

    def took(n):
        text = "".join(f"uint8 fn_{i}(uint8 p)\n{{\n  uint8 loc = p;\n  uint8 t[2] = {{ 1, 2 }};\n  return loc;\n}}\n" for i in range(n))
        start = time.process_time()
        assert sum(1 for _ in ctext.functions(text)) == n and sum(1 for _ in ctext.declarations(text)) == 2 * n and sum(1 for _ in ctext.initializers(text)) == n
        return time.process_time() - start

    small = took(1000)
    assert took(10_000) < 35 * max(small, 0.02)


def test_snippets(spark):
    text = "int f(int a)\n{\n  return a;\n}\n\nint g(void)\n{\n}\n"
    texts = spark.createDataFrame([("p", 1, text)], "pver_id string, file_id long, text string")
    records = spark.createDataFrame([("p", 1, "f|x"), ("p", 1, "g"), ("p", 1, "none")], "pver_id string, file_id long, fn string")
    for reach in (1, 2, 256):
        got = {r["fn"]: (r["from_line"], r["to_line"], r["snippet"]) for r in corpus.attach_snippets(records, corpus.extract_functions(texts), enrich.text_lines(texts), reach).collect()}
        assert got == {"f|x": (1, 4, "int f(int a)\n{\n  return a;\n}"), "g": (6, 8, "int g(void)\n{\n}")}
