"""Statements read in splits give what the same texts give whole."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators.sinks import materialise
from tallyspark.sources import splits, statements

CELLS = ["RICE", '"a, b"', '"say ""hi"""', '"two\nlines"', '"three\n\nli,nes\n"', 'x "y" z', "",
         '""', '"""q"""', '"tail" more', '"crlf\nhere, ""too""\n1"']


def text(seed, rows, unclosed=False):
    r = random.Random(seed)
    lines = ["Account Statement", "Name:,\"A\"", "Date,Details,Debit,Credit,Balance"][seed % 3:]
    for k in range(rows):
        debit = seed + k
        lines.append(f"{k % 28 + 1:02d}/{k % 12 + 1:02d}/2024,{r.choice(CELLS)},{debit}.50,,"
                     f"{r.choice(['1.00', '', chr(34) + '2,000.00' + chr(34)])}")
        if r.random() < 0.1:
            lines.append(r.choice(["", "  ", "no date here", ","]))
    if unclosed:
        lines.insert(rows // 2, '05/05/2024,"never closed,7.00,,1.00')
    return "\n".join(lines) + "\n"


def test_lines_are_numbered_without_moving_them(spark, small_splits, tmp_path):
    texts = {"a": text(1, 60), "b": "x\n\n\ny\n", "c": "caf\u00e9\n"}
    for name, value in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(value.encode("latin-1" if name == "c" else "utf-8"))
    lines = splits.read_lines(spark, str(tmp_path))
    assert lines.groupBy("path", "block").count().count() > len(texts)
    got = splits.numbered(lines).select(
        F.regexp_extract("path", r"(\w)\.csv$", 1).alias("f"), "nth", "value", "latin").collect()
    for name, value in texts.items():
        own = sorted((r for r in got if r.f == name), key=lambda r: r.nth)
        assert [r.nth for r in own] == list(range(1, len(own) + 1))
        assert {r.latin for r in own} == {name == "c"}
        if name != "c":
            assert [r.value for r in own] == value.replace("\r\n", "\n").split("\n")[:-1]
    # With stored counts the lines meet them where they are.
    plan = splits.numbered(lines, materialise)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Sort [" not in plan and "hashpartitioning" not in plan


@pytest.fixture()
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    for n, value in zip(names, ["150", "1"]):
        spark.conf.set(n, value)
    yield
    for n, value in zip(names, before):
        spark.conf.set(n, value)


def test_equal_to_whole_texts(spark, tmp_path, small_splits):
    texts = {f"s{k}": text(k, 60, unclosed=k >= 4) for k in range(6)}
    texts |= {"latin": text(1, 5).replace("RICE", "CAFÉ") + "01/02/2024,CAFÉ,5.00,,1.00\n",
              "bom": "﻿" + text(2, 3), "empty": "", "columns": "a,b\n1,2\n",
              "uba": "Transaction Date,Transaction Details,Amount,Transaction Type,Ledger Balance\n"
                     "2024-01-02,A,5.00,DEBIT,1.00\n2024-01-03 10:00:00,B,6.00,CREDIT,2.00\n",
              "mixed": "Posting Date,Particulars,Dr,Cr,Closing Balance\n2 Jan 2024,A,5.00,,\n"}
    (tmp_path / "u 1").mkdir()
    for name, content in texts.items():
        (tmp_path / "u 1" / f"{name}.csv").write_bytes(
            content.encode("latin-1" if name == "latin" else "utf-8"))
    read = splits.read_lines(spark, str(tmp_path))
    assert read.groupBy("path").agg(F.countDistinct("block").alias("n")).agg(
        F.max("n")).first()[0] > 10
    got = splits.read_statements(spark, str(tmp_path))
    want = statements.read_statements(spark.createDataFrame(
        [("u 1", k, "csv", v.removeprefix("﻿")) for k, v in texts.items()],
        "user_id string, upload_id string, file_type string, text string"))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[1], r[2]))
    found, expected = order(got.collect()), order(want.collect())
    assert len(expected) > 300 and any("\n" in r[4] for r in expected)
    assert found == expected


def test_states_compose(spark):
    """A quoted cell over many splits, and lines that swap, keep or fix the state."""
    lines = ['a,"b', "plain", 'x","y', "", 'end",z', "free", '"shut",1', 'q,"', '"']
    rows = [("f", k, 100 * k, v) for k, v in enumerate(lines)]
    got = splits.with_state(spark.createDataFrame(
        rows, "path string, block long, line long, value string")).orderBy("line").collect()
    assert [(r.inside, r.open) for r in got] == [
        (False, True), (True, True), (True, True), (True, True), (True, False), (False, False),
        (False, False), (False, True), (True, False)]
    whole = splits.records(spark.createDataFrame(
        rows, "path string, block long, line long, value string")).orderBy("line").collect()
    assert [r.record for r in whole] == ["\n".join(lines[:5]), "free", '"shut",1', 'q,"\n"']
