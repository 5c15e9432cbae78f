"""Guards, retrieval, catalogue, model builder, artefacts and ordered helpers, on small tables."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessel.functions import calendar, ordered
from tessel.operators import analysis as a
from tessel.operators import catalogue as c
from tessel.operators import retrieval as r
from tessel.operators.governance import Policy, PolicyError
from tessel.plans import builder, questions, schema
from tessel.plans.model import Entity, Metric, Model, Relationship
from tessel.plans.planner import Request
from tessel.queries import MODEL
from tessel.sources import artefacts, readers

TODAY = date(2024, 8, 15)


def test_ranges_in_two_languages():
    one = lambda text: calendar.resolve_ranges(text, TODAY)
    assert one("sales in May 2023") == [(date(2023, 5, 1), date(2023, 5, 31))]
    assert one("from 2024-01-05 to 2024-02-03") == [(date(2024, 1, 5), date(2024, 2, 3))]
    assert one("between March 2023 and April 2023") == [(date(2023, 3, 1), date(2023, 4, 30))]
    assert one("January 2023 and February 2023 and 2021") == [(date(2021, 1, 1), date(2021, 12, 31)), (date(2023, 1, 1), date(2023, 2, 28))]
    assert one("last 7 days") == [(date(2024, 8, 9), TODAY)] == one("最近7天")
    assert one("last quarter") == [(date(2024, 4, 1), date(2024, 6, 30))] == one("上季度")
    assert one("this month") == [(date(2024, 8, 1), TODAY)] == one("本月")
    assert one("2023年5月到2023年6月") == [(date(2023, 5, 1), date(2023, 6, 30))]
    assert one("Q2 2023") == [(date(2023, 4, 1), date(2023, 6, 30))] and one("昨天") == [(date(2024, 8, 14),) * 2]
    assert one("nothing here") == []
    with pytest.raises(ValueError, match="reversed"):
        one("2024-03-01 to 2024-01-01")


def test_baselines():
    assert calendar.detect_baseline("sales by region, year-over-year") == "previous_year" and calendar.detect_baseline("环比") == "previous_period"
    assert calendar.detect_baseline("plain") is None
    with pytest.raises(ValueError, match="no baseline of yearly"):
        calendar.baseline_day(date(2024, 5, 1), "previous_month", "yearly")
    with pytest.raises(ValueError, match="29 February"):
        calendar.baseline_day(date(2024, 2, 29), "previous_year", "daily")
    assert calendar.baseline_day(date(2024, 3, 31), "previous_month") == date(2024, 2, 29)
    request = questions.to_request(MODEL, "monthly order value in 1997 year over year", TODAY)
    assert (request.baseline, request.grain, request.ranges) == ("previous_year", "monthly", ((date(1997, 1, 1), date(1997, 12, 31)),))
    out, why = questions.follow_up(MODEL, Request(("order_value",)), "compared with last year", TODAY)
    assert (out.baseline, out.grain, why) == ("previous_year", "monthly", ["grain", "baseline"])


def test_labels_round_trip():
    for d in (date(2024, 2, 29), date(2023, 12, 31), date(2024, 1, 1)):
        for grain in ("daily", "weekly", "monthly", "quarterly", "yearly"):
            assert calendar.parse_label(calendar.label(d, grain), grain) == calendar.bounds(d, grain)[0]


def test_guards(spark):
    cut = spark.createDataFrame([("2024-01", 1.0, True)], "period string, v double, truncated boolean")
    with pytest.raises(a.AnalysisError, match="truncated_input"):
        a.compare_periods(cut, "period", "v", 1)
    assert a.untruncated(cut, allow=True).columns == ["period", "v"]
    d = spark.createDataFrame([("a", 3.0), ("b", 3.0), ("c", None), ("d", 5.0)], "k string, v double")
    assert [(x.k, x.truncated) for x in a.truncated_top(d, "v", ["k"], 2).orderBy("k").collect()] == [("a", True), ("d", True)]
    assert {x.truncated for x in a.truncated_top(d, "v", ["k"], 4).collect()} == {False}
    with pytest.raises(a.AnalysisError, match="one dimension"):
        a.series(d.withColumn("x", F.lit("y")))
    s = a.series(d, "v")
    with pytest.raises(a.AnalysisError, match="ends at d"):
        a.comparison_pair(s, "c", "a")
    with pytest.raises(a.AnalysisError, match="no period z"):
        a.comparison_pair(s, "d", "z")
    with pytest.raises(a.AnalysisError, match="unit"):
        a.alike([{"unit": "eur"}, {"unit": "usd"}])
    assert a.alike([{"unit": "eur"}, {"grain": "daily"}, {}]) == {"unit": "eur", "version": None, "grain": "daily"}


def test_answers_and_rows():
    evidence = {"e1": 5.0}
    assert a.check_answer({"e1": 5.0}, evidence, [("It rose.", ["e1"])]) == []
    found = a.check_answer({"e2": 1.0}, evidence, [("It fell because of rain.", []), ("x", ["e9"])])
    assert found == ["unknown evidence e2", "uncited: It fell because of rain.", "causal wording 'because'", "unknown evidence e9"]
    assert a.same_rows([(1, None), (2.0, "x")], [(2.0 + 1e-12, "x"), (1, None)]) and not a.same_rows([(1,), (2,)], [(2,), (1,)], ordered=True)
    assert not a.same_rows([(True,)], [(1,)]) and not a.same_rows([(None,)], [(0,)]) and not a.same_rows([(1,)], [(1,), (1,)])


def test_ordered_helpers(spark):
    rows = [(i, i * 1.0 if i % 7 == 3 else None) for i in range(200)]
    d = spark.createDataFrame(rows, "i int, v double").repartition(5)
    want, last = {}, None
    for i, v in rows:
        last = v if v is not None else last
        want[i] = last
    assert {x.i: x.c for x in ordered.carried(d, "i", "v", "c").collect()} == want
    assert {x.i: x.p for x in ordered.previous(d.withColumn("w", F.col("i") * 2), "i", "w", "p").collect()} == {i: 2 * (i - 1) if i else None for i in range(200)}
    points = spark.createDataFrame([(k, x) for k in ("a", "b") for x in range(0, 100, 3)], "k string, x int")
    spans = spark.createDataFrame([("a", 5, 40), ("a", 10, 11), ("b", 99, 500), ("b", 7, 7)], "k string, s int, e int")
    for width in (1.0, 10.0, 1000.0):
        got = sorted((x.k, x.x, x.s) for x in ordered.range_join(points, F.col("x"), spans, F.col("s"), F.col("e"), width, ["k"]).collect())
        assert got == sorted((k, x, s) for k in ("a", "b") for x in range(0, 100, 3) for q, s, e in (("a", 5, 40), ("a", 10, 11), ("b", 99, 500)) if q == k and s <= x < e)


def test_overlaps_against_all_pairs(spark):
    import random

    z = random.Random(1)
    texts = [" ".join(z.choice(["the", "of"] + [f"w{n}" for n in range(12)]) for _ in range(z.randrange(0, 9))) for _ in range(60)]
    own = [set(t.split()) for t in texts]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for least in (0.3, 0.5, 1.0):
        got = {(x.i, x.other_i) for x in r.jaccard_pairs(d, "i", "text", least).collect()}
        assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if own[i] | own[j] and len(own[i] & own[j]) / len(own[i] | own[j]) >= least}
        got = {(x.i, x.j) for x in r.token_overlap(d.where("i < 30"), "i", d.where("i >= 30").withColumnRenamed("i", "j"), "j", "text", least, 2).collect()}
        assert got == {(i, j) for i in range(30) for j in range(30, 60) if len(own[i] & own[j]) >= 2 and len(own[i] & own[j]) / min(len(own[i]), len(own[j])) >= least}


def test_retrieval(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0], "x" if i % 2 else None) for i in range(40)], "k int, v array<double>, tag string")
    whole = {(x.query_id, x.k) for x in r.vector_top(v, v.where("k < 12"), "v", "k", 2).collect()}
    assert whole == {(x.query_id, x.k) for x in r.vector_top(v, v.where("k < 12"), "v", "k", 2, block=5).collect()} and len(whole) == 24
    assert {x.k % 2 for x in r.vector_top(v, v.where("k < 3"), "v", "k", 2, {"tag": "x"}).collect()} == {1}
    assert r.vector_top(v, v.where("k < 3"), "v", "k", 2, {"absent": 1}).count() == 0
    with pytest.raises(ValueError):
        r.delete_where(v, {})
    assert r.delete_where(v, {"tag": "x"}).count() == 20
    h = spark.createDataFrame([("sum of sales", "a", 1), ("sum of sales", "b", 2), ("sales by city", "a", 3)], "q string, scope string, n int")
    assert [x.q for x in r.history_search(h, "q", "sum of sales", 5, where=F.col("scope") == "a", priority=F.col("n"), window=1).collect()] == ["sales by city"]
    rows = [("revenue", "glossary", None, None, 9, None, None), ("revenue", "metric", "shop", None, 1, None, None), ("revenue", "metric", "shop", None, 2, date(2025, 1, 1), None), ("churn", "glossary", None, "boss", 1, None, None)]
    k = spark.createDataFrame(rows, "term string, kind string, domain string, role string, version int, valid_from date, valid_to date")
    assert [(x.term, x.kind, x.version) for x in r.resolve_knowledge(k, "2024-06-01", "shop", ["clerk"]).collect()] == [("revenue", "metric", 1)]
    assert r.resolve_knowledge(k, "2024-06-01", "shop", ["boss"]).count() == 2


def test_catalogue(spark):
    for t in ("orders", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").createOrReplaceTempView(t)
    try:
        policy = Policy({"orders": frozenset({"o_orderkey", "o_custkey"}), "nation": None})
        assert c.list_tables(spark, policy) == ["orders"] and {"orders", "customer"} <= set(c.list_tables(spark, Policy()))
        own = c.describe(spark.table("orders"), "orders", policy, MODEL)
        assert [(x["name"], x["key"], x["refers_to"]) for x in own] == [("o_orderkey", 1, None), ("o_custkey", None, None)]
        assert c.describe(spark.table("orders"), "orders", Policy(), MODEL)[1]["refers_to"] == "customer.c_custkey"
        assert "c_acctbal" not in [x["name"] for x in c.describe(spark.table("customer"), "customer", Policy(), MODEL)]
    finally:
        for t in ("orders", "customer"):
            spark.catalog.dropTempView(t)
    with pytest.raises(c.UnsafeValue):
        c.json_safe(spark.sql("select array(1) as x"))
    with pytest.raises(Exception, match="finite"):
        c.json_safe(spark.sql("select double('NaN') as x")).collect()
    row = c.json_safe(spark.sql("select 1.50BD as d, x'0Aff' as b, timestamp_ntz'2024-01-02 03:04:05.5' as t, date'2024-01-02' as e, true as f, null as n")).first()
    assert (row.d, row.b, row.t, row.e, row.f, row.n) == ("1.50", "0aff", "2024-01-02T03:04:05.500000", "2024-01-02", True, None)
    lite = c.CAPABILITIES["sqlite"]
    assert lite.refusals("select 'ilike' from t where a ilike 'x' and date_trunc('month', d) = 1 -- qualify") == ["ilike on sqlite", "date_trunc() on sqlite"]
    assert c.CAPABILITIES["spark"].refusals("select date_trunc('month', d) from t") == []
    with pytest.raises(PolicyError):
        c.CAPABILITIES["spark"].require("select 1 qualify row_number() over (order by 1) = 1")


def test_bounded_runs_need_capability_and_objects(spark):
    from tessel.operators.governance import run

    spark.range(5).createOrReplaceTempView("five")
    try:
        out = run(spark, "select id from five", Policy(), bound=3)
        assert (out["row_count"], out["truncated"], out["fetched_row_count"]) == (3, True, 4)
        with pytest.raises(PolicyError, match="unknown_object nowhere"):
            run(spark, "with x as (select 1 as a) select * from x join nowhere on true", Policy(allow_cross_join=True))
        with pytest.raises(PolicyError, match="unsupported ilike"):
            run(spark, "select id from five where cast(id as string) ilike '1'", Policy(), capability=c.CAPABILITIES["sqlite"])
    finally:
        spark.catalog.dropTempView("five")


def test_builder(spark):
    tables = {
        "users": spark.createDataFrame([(i, f"n{i}", f"m{i}@x.org") for i in range(5)], "user_id int, name string, email string"),
        "visits": spark.createDataFrame([(i // 2, i % 2, i // 4, i * 1.5, i % 3 == 0 and 1 or 0, date(2024, 1, 1 + i)) for i in range(10)], "visit_id int, part_number int, user_id int, amount double, is_new int, day date"),
        "odd": spark.createDataFrame([(99, "x")], "user_id int, note string"),
    }
    m = builder.propose(tables)
    assert m.entities["users"].primary_key == ("user_id",) and set(m.entities["visits"].primary_key) == {"visit_id", "part_number"}
    assert m.entities["users"].hidden == {"email"} and "email" not in m.entities["users"].dimensions  # personal data is hidden
    assert [(x.left, x.left_column, x.right) for x in m.relationships] == [("visits", "user_id", "users")]
    assert {n: (x.kind, x.expression) for n, x in m.metrics.items()} == {"visits_count": ("count", "*"), "visits_amount": ("sum", "amount"), "visits_is_new_rate": ("ratio", "sum(is_new)")}
    assert builder.paths(m) == [("visits", "users", 1)]
    mine = Model({"users": Entity("users", "users", ("user_id",), {"who": "name"})}, [], {"visits_amount": Metric("visits_amount", "visits", "sum", "amount * 2", time="day")})
    both = builder.merge(mine, m)
    assert both.metrics["visits_amount"].expression == "amount * 2" and both.entities["users"].dimensions["who"] == "name"
    assert both.entities["users"].hidden == {"email"} and len(both.relationships) == 1


def test_schema_retrieval():
    columns = {"orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"], "customer": ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "region": ["r_regionkey", "r_name"], "part": ["p_partkey", "p_brand"]}
    got = schema.retrieve(MODEL, "order value by region name", columns)
    assert {"order", "region"} <= set(got.entities) and {"customer", "nation"} <= set(got.entities)
    assert "orders.o_custkey = customer.c_custkey" in got.joins and "nation.n_regionkey = region.r_regionkey" in got.joins
    assert "c_acctbal" not in got.columns["customer"] and "part" not in got.columns
    assert schema.retrieve(MODEL, "the weather", columns).entities == []


def test_artefacts(spark, tmp_path):
    rows = [{"a.b": "x<script>", "a b": 1.0}, {"a.b": "y", "a b": 2.0}]
    assert artefacts.field_names(["a.b", "a b"]) == {"a.b": "a_b", "a b": "a_b_2"}
    chart = artefacts.chart_file(a.chart(["a.b", "a b"], {"a.b": "text", "a b": "float"}, rows), rows)
    assert chart["mark"] == "bar" and chart["data"]["values"][0] == {"a_b": "x<script>", "a_b_2": 1.0}
    page = artefacts.report_file("t & u", ["a.b", "a b"], rows, ["one"])
    assert "<script>" not in page and "t &amp; u" in page
    manifest = artefacts.write_artefacts(spark, str(tmp_path), "run1", {"html": page, "chart.json": json.dumps(chart)})
    assert (tmp_path / "run1.html").read_text() == page and json.loads((tmp_path / "run1.manifest.json").read_text()) == manifest
    with pytest.raises(ValueError):
        artefacts.write_artefacts(spark, str(tmp_path), "../x", {})


def test_routing(tmp_path):
    assert [readers.route(x) for x in ("postgresql://h/db", "jdbc:sqlite:x", "a/b.duckdb", "a.CSV", "x.db")] == ["postgresql", "sqlite", "duckdb", "csv", "sqlite"]
    (tmp_path / "_backend").write_text("duckdb\n")
    assert readers.route(str(tmp_path)) == "duckdb"
    with pytest.raises(readers.SourceError):
        readers.route("nothing")
    with pytest.raises(readers.SourceError, match="superuser"):
        readers.jdbc_options("postgresql://h/db", {"dbtable": "t"}, superuser=lambda: True)
    with pytest.raises(readers.SourceError, match="in parts"):
        readers.jdbc_options("postgresql://h/db", {"dbtable": "t", "partitionColumn": "id"})
    with pytest.raises(readers.SourceError, match="only reads"):
        readers.jdbc_options("x.sqlite", {"query": "delete from t"})
    assert readers.jdbc_options("postgresql://h/db", {"dbtable": "t"}) == {"url": "jdbc:postgresql://h/db", "fetchsize": "10000", "dbtable": "t", **readers.READ_ONLY["postgresql"]}


def test_relationships_with_roles():
    m = Model({"a": Entity("a", "t"  , ("i",)), "b": Entity("b", "t", ("i",))}, [Relationship("a", "p", "b", "i")], {})
    assert [x.right for x in m.path("a", "b")] == ["b"]


def test_replans_budgets_and_journal(spark, tmp_path):
    from tessel.plans.executor import Budget, Journal, PlanError, Step, execute

    ran = []

    def act(*up, name="x", rows=0):
        ran.append(name)
        if name.startswith("bad"):
            raise RuntimeError(name)
        return {"row_count": rows, "name": name}

    swap = lambda s, error: Step(s.id, s.action, s.needs, (("name", f"{dict(s.args)['name'][3:]}"),))
    run = execute([Step("a", "act", (), (("name", "badbadgood"),)), Step("b", "act", ("a",), (("name", "end"),))], {"act": act}, replan=swap)
    assert ran == ["badbadgood", "badgood", "good", "end"] and run.states == {"a": "done", "b": "done"}
    run = execute([Step("a", "act", (), (("name", "badbadbadgood"),)), Step("b", "act", ("a",))], {"act": act}, replan=swap)
    assert run.states == {"a": "failed", "b": "skipped"}
    with pytest.raises(PlanError, match="rows"):
        execute([Step("a", "act", (), (("rows", 11),))], {"act": act}, Budget(rows=10))
    with pytest.raises(PlanError, match="bytes"):
        execute([Step("a", "big")], {"big": lambda: {"bytes": 3}}, Budget(bytes=2))
    ran.clear()
    journal = Journal(spark, str(tmp_path / "j"))
    plan = [Step("a", "act", (), (("name", "one"),)), Step("b", "act", ("a",), (("name", "two"),), side_effect=True)]
    assert set(execute(plan, {"act": act}, journal=journal).states.values()) == {"done"}
    again = execute(plan, {"act": act}, journal=Journal(spark, str(tmp_path / "j")))
    assert set(again.states.values()) == {"reused"} and again.results["b"]["name"] == "two" and ran == ["one", "two"]
    keys = {s.id: k for s, k in zip(plan, _prints(plan))}
    for done in (tmp_path / "j").glob("*.done"):
        done.unlink()  # begun by a run that was killed
    assert execute(plan, {"act": act}, journal=journal).states == {"a": "held", "b": "skipped"}
    late = Journal(spark, str(tmp_path / "j"), lease=-1)
    assert execute(plan, {"act": act}, journal=late).states == {"a": "done", "b": "uncertain"} and ran == ["one", "two", "one"]
    assert late.get(keys["a"])[0] and not late.get(keys["b"])[0]


def _prints(plan):
    first = plan[0].fingerprint({}, [])
    return first, plan[1].fingerprint({}, [first])
