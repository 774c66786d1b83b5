"""Line numbers across splits, records that hold line ends, rejects with file and line, errors only when a query runs."""

import csv
import io
import random

import pytest

from gleaner.sources import records


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


SHEET = "review_id string, text string, human_label string"


def test_lines_of_many_splits(spark, small_splits, tmp_path):
    rng = random.Random(1)
    want = []
    for name in ("a.jsonl", "b.jsonl"):
        lines = [rng.choice(["", "x" * rng.randint(1, 90), " "]) for _ in range(300)]
        (tmp_path / name).write_text("﻿" + "\r\n".join(lines))
        want += [(name, i, v) for i, v in enumerate(lines, 1) if v.strip()]
    df = records.records(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() > 20
    assert sorted((r["file"].rsplit("/", 1)[-1], r["line"], r["record"]) for r in df.collect()) == sorted(want)


def test_cells_that_hold_line_ends_across_splits(spark, small_splits, tmp_path):
    rng = random.Random(2)
    rows = [[str(i), "".join(rng.choice('ab,"\n ') for _ in range(rng.randint(1, 150))) + ".", rng.choice(["x", "y"])] for i in range(200)]
    rows[70][1] = "long\n" * 300 + "."
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n", quoting=csv.QUOTE_ALL).writerows([["review_id", "text", "human_label"], *rows])
    (tmp_path / "sheet.csv").write_bytes(("﻿" + out.getvalue()).encode())
    got = records.read_label_sheet(spark, str(tmp_path / "sheet.csv"), SHEET, ["text", "human_label"], ["review_id"])
    line, want = 2, []
    for r in rows:
        want.append((line, *r, None))
        line += 1 + r[1].count("\n")
    assert sorted((r["line"], r["review_id"], r["text"], r["human_label"], r["reason"]) for r in got.collect()) == want
    assert records.checked(got).count() == 200 and records.rejected(got).count() == 0


def test_rejects_of_a_sheet(spark, tmp_path):
    p = tmp_path / "gold.csv"
    p.write_text('review_id,text,human_label\n1,"a\nb",x\n2,t,\n\n1,again,y\n3,only two\n4,"q ""q""",z\n')
    got = records.read_label_sheet(spark, str(p), SHEET, ["human_label"], ["review_id"])
    assert sorted((r["line"], r["reason"]) for r in records.rejected(got).collect()) == [(4, "blank cell: human_label"), (6, "repeated key"), (7, "broken row")]
    assert sorted((r["review_id"], r["text"]) for r in records.accepted(got).collect()) == [("1", "a\nb"), ("4", 'q "q"')]
    lazy = records.checked(got)  # nothing has run yet
    with pytest.raises(Exception, match=r"gold\.csv, line [467]: "):
        lazy.collect()
    p.write_text("review_id,label\n1,x\n")
    assert "another header" in {r["reason"] for r in records.rejected(records.read_label_sheet(spark, str(p), SHEET, [], ["review_id"])).collect()}
    with pytest.raises(ValueError, match="line"):
        records.read_label_sheet(spark, str(p), "line string", [], ["line"])


def test_rejects_of_a_population(spark, tmp_path):
    p = tmp_path / "all.jsonl"
    p.write_text('﻿{"source_review_id":"a","rating":5,"reviewer":"hidden"}\n\n{"source_review_id":"b"}\n{"rating":1}\nnonsense\n{"source_review_id":"c","rating":6}\n{"source_review_id":"d","rating":1,"created_at":"2026-01-02T00:00:00Z"}')
    got = records.read_population(spark, str(p))
    assert sorted((r["line"], r["reason"]) for r in records.rejected(got).collect()) == [(3, "no stars from 1 to 5"), (4, "no id"), (5, "no review"), (6, "no stars from 1 to 5")]
    assert sorted(r["source_review_id"] for r in records.accepted(got).collect()) == ["a", "d"] and "reviewer" not in got.columns
    with pytest.raises(Exception, match=r"all\.jsonl, line [3456]: no "):
        records.checked(got).collect()


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.jsonl").write_text("")
    assert records.read_population(spark, str(tmp_path)).collect() == []
    assert records.read_label_sheet(spark, str(tmp_path), SHEET, [], ["review_id"]).collect() == []
