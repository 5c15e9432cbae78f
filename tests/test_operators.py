import pytest
from pyspark.sql import functions as F

from tessel.operators import analysis as a
from tessel.operators import governance as g
from tessel.operators import quality as q
from tessel.operators import retrieval as r


@pytest.mark.parametrize(("now", "was", "state", "delta", "relative"), [(80.0, 100.0, "ok", -20.0, -0.2), (0.0, 0.0, "both_zero", 0.0, None), (7.0, 0.0, "zero_baseline", 7.0, None), (-80.0, -100.0, "ok", 20.0, 0.2), (80.0, None, "missing_value", None, None), (float("inf"), 1.0, "undefined_input", None, None)])
def test_compare(spark, now, was, state, delta, relative):
    x = spark.createDataFrame([(now, was)], "c double, b double").select(*a.compare(F.col("c"), F.col("b"))).first()
    assert (x.state, x.delta) == (state, delta)
    assert x.relative == (pytest.approx(relative) if relative is not None else None)


def test_drill_down_tail(spark):
    d = spark.range(1000).select(F.format_string("c%04d", "id").alias("n"), (1000 - F.col("id")).alias("v"))
    out = {x.name: x for x in a.drill_down(d, "n", "v", 5).collect()}
    assert out["others"].value == 495510 and out["others"].categories == 995 and len(out) == 6
    d = spark.createDataFrame([("big", 100.0, 9), ("tiny_a", 1.0, 1), ("tiny_b", 2.0, 1)], "n string, v double, k int")
    assert {x.name: x.value for x in a.drill_down(d, "n", "v", 5, "k", 5).collect()} == {"big": 100.0, "others": 3.0}


def test_contribution(spark):
    d = spark.createDataFrame([("A", 30.0, 60.0), ("B", 50.0, 40.0)], "n string, c double, b double")
    out = {x.name: x for x in a.contribution(d, "n", "c", "b").collect()}
    assert (out["A"].share, out["B"].share, out["B"].offsetting) == (1.5, -0.5, True)
    with pytest.raises(ValueError, match="additive"):
        a.contribution(d, "n", "c", "b", additive=False)


def test_combine_ratio(spark):
    d = spark.createDataFrame([("web", 9, 10), ("app", 100, 1000)], "n string, a int, b int")
    x = a.combine_ratio(d, "a", "b").first()
    assert x.ratio == pytest.approx(109 / 1010) and x.unweighted == pytest.approx(0.5)


def days(spark, values, first="2025-01-01"):
    d = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(values)], "i int, v double")
    return d.select(F.date_format(F.date_add(F.lit(first).cast("date"), F.col("i")), "yyyy-MM-dd").alias("l"), "v")


def test_anomalies(spark):
    out = a.anomalies(days(spark, [10, 11, 9, 10, 11, 9, 10, 11, 9, 30]), "l", "v").where("is_anomaly").collect()
    assert [(x.label, x.expected) for x in out] == [("2025-01-10", 10.0)] and out[0].score == pytest.approx(20 / 1.4826)
    assert {x.state for x in a.anomalies(days(spark, [10] * 8), "l", "v").collect()} == {"constant_series"}
    assert {x.state for x in a.anomalies(days(spark, [1, 2]), "l", "v").collect()} == {"insufficient_data"}
    assert a.anomalies(days(spark, [1, 2, None, 3, 4, 5, 6, 7, 8]), "l", "v").count() == 8
    assert a.anomalies(days(spark, [1, 2, None, 3, 4, 5, 6, 7, 8]), "l", "v", missing="gap").count() == 9
    season = days(spark, [100 if i % 7 == 0 else 10 for i in range(14)], "2025-01-06")
    assert a.anomalies(season, "l", "v", season="weekday").where("is_anomaly").count() == 0


def test_results_do_not_depend_on_partitions(spark):
    d = days(spark, [10, 11, 9, 10, 11, 9, 10, 11, 9, 30])
    assert a.same_result(a.anomalies(d, "l", "v"), a.anomalies(d.repartition(7), "l", "v")).count() == 0


def test_quality_checks(spark):
    e = spark.createDataFrame([(1, 1, 10.0, "2025-01-01"), (1, 1, None, "2025-01-02"), (2, 2, 20.0, "2025-01-02"), (2, 999, 30.0, "2025-01-05"), (3, 3, 40.0, "2025-01-05")], "event_id long, user_id long, amount double, d string")
    u = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    x = q.grain_unique(e, ["event_id"]).first()
    assert (x.duplicate_groups, x.status) == (2, "error") and q.grain_unique(e, ["event_id"], "duplicates").first().status == "warning"
    assert q.grain_unique(u, ["user_id"]).first().status == "ok"
    assert [(x.rate, x.status) for x in q.null_rates(e, ["amount"]).collect()] == [(0.2, "warning")]
    empty = spark.createDataFrame([], "v double")
    assert q.null_rates(empty, ["v"]).first().status == "unknown" and q.grain_unique(empty, ["v"]).first().status == "unknown"
    x = q.coverage(e, "d", "2025-01-01", "2025-01-05").first()
    assert (x.present, x.expected, x.status) == (3, 5, "warning") and q.coverage(e, "d", "2025-02-01", "2025-02-05").first().status == "error"
    assert q.referential(e, "user_id", u, "user_id").first().orphans == 1
    assert q.roll_up(["ok", "unknown", "warning"]) == "warning" and q.roll_up([]) == "unknown"
    assert q.drift({"t": {"a": "1", "b": "1"}}, {"t": {"b": "2", "c": "1"}}) == {"t": {"added": ["c"], "removed": ["a"], "changed": ["b"]}}


@pytest.fixture(scope="module")
def views(spark):
    spark.createDataFrame([(1, "a", "s")], "id int, name string, secret string").createOrReplaceTempView("items")
    spark.createDataFrame([(1, 2)], "id int, v int").createOrReplaceTempView("facts")


@pytest.mark.parametrize(("sql", "rule"), [
    ("delete from items", "forbidden_node"), ("drop table items", "forbidden_node"), ("insert into items values (1, 'a', 'b')", "forbidden_node"), ("set a=1", "forbidden_node"), ("select 1; select 2", "parse_error"),
    ("select * from parquet.`/etc`", "table_scope"), ("select * from other", "table_scope"), ("select java_method('a', 'b')", "dangerous_function"), ("select * from items cross join facts", "cross_join"),
    ("select secret from items limit 1", "column_scope"), ("select * from items limit 1", "column_scope"), ("select id from items where secret = 'x' limit 1", "column_scope"), ("select id from items limit 1000", "limit"), ("select id from items", "unbounded_result"),
    ("with recursive r(n) as (select 1 union all select n + 1 from r where n < 3) select n from r limit 1", "recursive_cte"),
])
def test_policy_refuses(spark, views, sql, rule):
    p = g.Policy({"items": frozenset({"id", "name"}), "facts": None}, max_limit=100, require_limit=True)
    found = g.judge(spark, sql, p)
    assert any(f.startswith(rule) for f in found), found


def test_policy_runs(spark, views):
    p = g.Policy({"items": frozenset({"id", "name"}), "facts": None}, max_limit=100, require_limit=True)
    assert g.judge(spark, "select i.id, f.v from items i join facts f on i.id = f.id limit 5", p) == []
    assert g.judge(spark, "select count(*) as n from items", p) == []
    assert g.judge(spark, "with x as (select id from items) select id from x limit 3", p) == []
    assert g.run(spark, "select id from items limit 5", p)["rows"] == [[1]]
    assert g.preview(spark, "select id from items", p)["row_count"] == 1
    assert g.signature(spark, "select id as a from items") == g.signature(spark, "SELECT id AS a FROM items")
    assert [c[0] for c in g.visible(spark.table("items"), "items", p)] == ["id", "name"]
    with pytest.raises(g.PolicyError, match="column_scope"):
        g.run(spark, "select secret from items limit 1", p)


def test_retrieval(spark):
    h = spark.createDataFrame([("total sales by region",), ("average age of users",)], "text string")
    assert r.history_search(h, "text", "sales by region", 1).first().text == "total sales by region"
    assert r.history_search(h, "text", "sales by region", 1, sequence=True).first().similarity > 0.8
    a_ = spark.createDataFrame([(1, "alpha beta gamma")], "l long, text string")
    b_ = spark.createDataFrame([(7, "beta gamma delta"), (8, "zzz")], "r long, text string")
    assert [tuple(x) for x in r.token_overlap(a_, "l", b_, "r", "text", 0.5).collect()] == [(1, 7, pytest.approx(2 / 3))]
    assert a.chart(["period", "v"], {"period": "text", "v": "float"}, [{"period": "a", "v": 1}])["chart"] == "line"
    b = a.paired_bootstrap(spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 1.0)], "t string, x double, y double"), "t", "x", "y").first()
    assert (b.mean, b.low, b.high) == (1.0, 1.0, 1.0)


def test_policy_sees_into_subqueries(spark):
    spark.range(3).createOrReplaceTempView("seen")
    spark.range(3).selectExpr("id", "id as secret").createOrReplaceTempView("kept")
    p = g.Policy({"seen": None})
    for sql in ("select id from seen where id in (select id from kept)", "select id from seen where exists (select 1 from kept)", "select (select max(id) from kept) as m from seen"):
        assert g.judge(spark, sql, p) == ["table_scope kept"]
    p = g.Policy({"seen": None, "kept": frozenset({"id"})})
    assert g.judge(spark, "select id from seen where id in (select id from kept)", p) == []
    assert g.judge(spark, "select id from seen where id in (select secret from kept)", p) == ["column_scope kept.secret"]
