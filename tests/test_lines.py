"""Texts read in splits give what whole texts give."""

import random

import pytest
from pyspark.sql import functions as F

from sparktriage.sources import files, lines

ROWS = ["[ call#main at a.c:1.2-3", "[", "]", " [x]", "x ]", "  ALARM (A) oob at a.c:7.3-9 ]", ">  y = t[i];", "> [z", ">]", "noise", "", "[ a ] b", "\t[ open"]


@pytest.fixture(params=[7, 40, 1000])
def small_splits(spark, request):
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in kept:
        spark.conf.set(c, str(request.param))
    yield request.param
    for c, v in kept.items():
        spark.conf.set(c, v)


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_blocks_of_splits(spark, tmp_path, small_splits):
    rng = random.Random(small_splits)
    for p in range(12):
        (tmp_path / f"p +{p}%").mkdir()
        text = "".join(rng.choice(ROWS) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(p * 9))
        (tmp_path / f"p +{p}%" / "run.log").write_text(text, newline="")
    plain = files.read_trace_blocks(files.read_text_files(spark, str(tmp_path))).withColumn("block", F.replace("block", F.lit("\r"), F.lit("")))
    split = lines.read_lines(spark, str(tmp_path))
    assert small_splits > 40 or split.select("path", "split").distinct().count() > 40
    got = _rows(lines.log_blocks(split).select("pver_id", "block_no", "block"))
    assert got == _rows(plain.select("pver_id", "block_no", "block")) and len(got) > 60


def test_lines_of_splits(spark, tmp_path, small_splits):
    texts = {
        "utf8.c": "int é;\n\nlong line of text 1;\r\nx\ry", "mark.c": "﻿ü\nb\n", "only.c": "﻿", "empty.c": "", "latin.c": None, "late.c": None,
        "wide.c": None, "ends.c": "\n\n\n", "long.c": "z" * 3000 + "\nend",
    }
    raw = {"latin.c": b"caf\xe9 \x80 \x81\r\nb\n", "late.c": b"a\n" * 60 + "é\n".encode("cp1252"), "wide.c": "é\nਊ\n".encode("utf-16")}
    (tmp_path / "q").mkdir()
    for name, text in texts.items():
        (tmp_path / "q" / name).write_bytes(raw[name] if text is None else text.encode())
    name = F.regexp_extract("path", "[^/]+$", 0).alias("name")
    got = lines.read_lines(spark, str(tmp_path)).select("pver_id", name, "line_no", "text")
    want = files.source_lines(files.read_text_files(spark, str(tmp_path))).select("pver_id", name, "line_no", "text")
    assert [r for r in _rows(got) if r[1] != "only.c"] == _rows(want)
    assert {r[3] for r in _rows(got) if r[1] == "only.c"} <= {""} and {r[3] for r in _rows(got) if r[1] == "latin.c"} == {"café € �", "b"}


def test_alarms_of_splits(spark, tmp_path, small_splits):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "alarms.csv").write_text("﻿sep=;\nOrder; Message\n" + "".join(f'{i};"m;{i}"\n' for i in range(50)))
    rows = files.alarm_rows(lines.read_lines(spark, str(tmp_path))).collect()
    assert sorted((r["alarm_seq"], r["row"]["Order"], r["row"]["Message"]) for r in rows) == [(i + 3, str(i), f"m;{i}") for i in range(50)]


def test_no_files_have_no_blocks(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "run.log").write_text("")
    assert lines.log_blocks(lines.read_lines(spark, str(tmp_path))).count() == 0
