import os

import pytest
from pyspark.sql import functions as F

from tessel.sources import upkeep as u


def test_data_version(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.csv").write_text("1,2\n")
        (tmp_path / d / "y.csv").write_text("3\n")
    one = u.data_version(spark, str(tmp_path / "a"))
    assert one == u.data_version(spark, str(tmp_path / "b"))
    (tmp_path / "b" / "y.csv").write_text("4\n")
    assert one != u.data_version(spark, str(tmp_path / "b"))


def test_history(spark, tmp_path):
    f = tmp_path / "h.csv"
    f.write_text('﻿Question,sql,reviewer\n"a, b?","select 1\nfrom t",\nq,select 2,ann\n"a, b?","select 1\nfrom t",bob\n,select 3,x\n')
    assert sorted((x.question, x.sql, x.reviewer, x.reviewed) for x in u.import_history(spark, str(f)).collect()) == [("a, b?", "select 1\nfrom t", "bob", True), ("q", "select 2", "ann", True)]
    f.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        u.import_history(spark, str(f))


def test_profile(spark):
    d = spark.createDataFrame([("1", "x", " ", "NaN"), (" 2.5e3 ", "2", None, "1")], "a string, b string, c string, d string")
    assert [(x.name, x.type, x.nulls) for x in u.profile_csv(d).orderBy("place").collect()] == [("a", "NUMBER", 0), ("b", "TEXT", 0), ("c", "TEXT", 2), ("d", "TEXT", 0)]
    assert [(x.type, x.nulls) for x in u.profile_csv(d.where("false")).collect()] == [("TEXT", 0)] * 4
    with pytest.raises(ValueError):
        u.profile_csv(spark.createDataFrame([("1", "2")], "a string, ` A ` string"))


def test_retiring_reports(spark, tmp_path):
    for n in ("old", "new", "bad name"):
        (tmp_path / f"{n}.html").write_text("x")
    (tmp_path / "old.manifest.json").write_text("{}")
    for n in ("old.html", "bad name.html"):
        os.utime(tmp_path / n, (1, 1))
    ages = u.report_ages(spark, str(tmp_path))
    assert {x.report: x.verdict for x in ages.collect()} == {"old": "expire", "new": "keep", "bad name": "inspect"}
    assert (tmp_path / "old.html").exists()  # nothing moves until asked
    assert sorted(u.retire_reports(spark, str(tmp_path), ages)) == ["old.html", "old.manifest.json"]
    assert sorted(x.name for x in (tmp_path / "_retired" / "1970-01-01").glob("old*")) == ["old.html", "old.manifest.json"]
    assert (tmp_path / "new.html").exists() and (tmp_path / "bad name.html").exists()
    with pytest.raises(ValueError):
        u.report_ages(spark, str(tmp_path), days=0)


def test_period_order(spark):
    d = spark.createDataFrame([(1, "2024-01"), (2, "2024-02"), (3, "2024-02"), (4, "spring")], "i int, p string")
    assert sorted(x.i for x in u.period_order(d, "p", "i").collect()) == [3, 4]
    assert sorted(x.i for x in u.period_order(d.withColumn("s", F.lit(1)), "p", "i", ["s"]).collect()) == [3, 4]
