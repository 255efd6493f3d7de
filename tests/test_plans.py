"""What Spark plans for rows whose number it cannot estimate, and how much the plans move."""

import random
import re
from collections import defaultdict

import pytest

from sparktriage import catalog
from sparktriage.operators import corpus as co
from sparktriage.operators import enrich as en
from sparktriage.operators import facts as fa
from sparktriage.plans.views import view

SF = "/root/testdata/sf0.001"
FROM_TEXTS = [
    "g05_origin_shapes", "j19_origin_shapes", "w06_symbol_packages", "x07_resolve_access", "x08_relevant_symbols", "x11_seed_facts", "x13_normalize_facts",
]


@pytest.mark.parametrize("name", FROM_TEXTS)
def test_rows_of_texts_are_not_broadcast(spark, name):
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_symbols_are_resolved_without_a_broadcast(spark):
    texts = view(spark, SF, "c_files")
    lines = en.text_lines(texts)
    access = co.resolve_access(lines.where("line_no = 14").selectExpr("pver_id", "file_id", "line_no", "instr(text, '[') as col"), lines)
    plan = en.resolve_symbols(access, texts, co.extract_functions(texts), lines)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_quotes_are_not_dealt_again(spark):
    lines = spark.sql("select cast(id % 2 as string) pver_id, id % 5 file_id, id line_no, cast(id as string) text from range(50)").repartition("pver_id", "file_id")
    plan = fa.verify_quotes(lines.withColumnRenamed("text", "quote"), lines)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_quotes_beside_plain_loops(spark):
    draw = random.Random(5)
    lines = [(p, f, n * (3 if f == 2 else 1) + (4090 if f == 1 else 0), draw.choice(["a  b", "b", " c", "", None, "a b c"])) for p in ("0", None) for f in (1, 2) for n in draw.sample(range(1, 40), 25)]
    quotes = [(p, f, draw.choice([None, *range(-2, 50), *range(4085, 4140)]), draw.choice(["a b", "b  c", "c", " ", "", None, "b a b"])) for p in ("0", "1", None) for f in (1, 2, None) for _ in range(150)]
    flat = lambda x: re.sub(r"\s+", " ", x).strip()
    files = defaultdict(list)
    for p, f, n, text in sorted(lines, key=lambda x: (str(x[0]), x[1], x[2])):
        files[p, f].append((n, text))
    want = set()
    for p, f, n, quote in quotes:
        own, needle = files.get((p, f), []) if p is not None and f is not None else [], flat(quote or "")
        near = [i for i, x in enumerate(own) if n is not None and abs(x[0] - n) <= 2]
        whole = {i: flat("\n".join(x[1] for x in own[max(0, i - 1) : i + 2] if x[1] is not None)) for i in near}
        one = [own[i][0] for i in near if needle and own[i][1] is not None and needle in flat(own[i][1])]
        want.add((p, f, n, quote, bool(one) or any(needle and needle in x for x in whole.values()), min(one, key=lambda a: (abs(a - n), a > n), default=None)))
    frame = lambda rows, last: spark.createDataFrame(rows, f"pver_id string, file_id long, line_no int, {last} string")
    got = fa.verify_quotes(frame(quotes, "quote"), frame(lines, "text")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_functions_are_scanned_once(spark):
    plan = catalog.queries()["x14_fix_index_symbols"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # that of the declarations
