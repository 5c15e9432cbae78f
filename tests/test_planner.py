from datetime import date

import pytest
from pyspark.sql import functions as F

from tessel.plans.model import Entity, Metric, Model, Relationship, SemanticError
from tessel.plans.planner import Request, compile_request
from tessel.plans.predicates import PredicateError, _Probe, extract, parse


@pytest.fixture(scope="module")
def shop(spark):
    tables = {
        "dim_item": spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "a", 0)], "item_id long, category string, item_valid int"),
        "fact_sales": spark.createDataFrame([(1, 1, 10.0, 1, 20250101), (2, 2, 20.0, 1, 20250102), (3, 1, 30.0, 1, 20250601), (4, 3, 40.0, 0, 20250103), (5, 3, 5.0, 0, 20250103)], "sale_id long, item_id long, amount double, is_valid int, sale_date_key int"),
        "fact_returns": spark.createDataFrame([(1, 1, 2.5), (2, 4, 1.5)], "return_id long, sale_id long, amount double"),
    }
    model = Model(
        {
            "item": Entity("item", "dim_item", ("item_id",), {"category": "category", "secret": "item_valid"}, frozenset({"item_valid"})),
            "sale": Entity("sale", "fact_sales", ("sale_id",), {"item": "item_id"}),
            "return": Entity("return", "fact_returns", ("return_id",), {"id": "return_id"}),
        },
        [Relationship("sale", "item_id", "item", "item_id"), Relationship("return", "sale_id", "sale", "sale_id")],
        {
            "net_sales": Metric("net_sales", "sale", "sum", "amount", filters=("is_valid = 1",), time="sale_date_key"),
            "order_count": Metric("order_count", "sale", "count_distinct", "sale_id", filters=("is_valid = 1",)),
            "valid_ratio": Metric("valid_ratio", "sale", "ratio", "sum(is_valid)", "count(*)"),
            "returned": Metric("returned", "return", "sum", "amount"),
        },
    )
    return model, tables.__getitem__


def rows(shop, *metrics, **more):
    return sorted(tuple(r) for r in compile_request(*shop, Request(metrics, **more)).collect())


def test_gold_values(shop):
    assert rows(shop, "net_sales") == [(60.0,)]
    assert rows(shop, "order_count") == [(3,)]
    assert rows(shop, "valid_ratio") == [(0.6, 3.0, 5.0)]
    assert rows(shop, "net_sales", dimensions=("item.category",)) == [("a", 40.0), ("b", 20.0)]
    assert rows(shop, "net_sales", ranges=((date(2025, 1, 1), date(2025, 1, 31)),)) == [(30.0,)]


def test_drill_across_keeps_missing_sides(shop):
    assert rows(shop, "net_sales", "returned") == [(60.0, 4.0)]
    out = compile_request(*shop, Request(("net_sales", "order_count"), dimensions=("item.category",)))
    assert {r["item.category"]: (r.net_sales, r.order_count) for r in out.collect()} == {"a": (40.0, 2), "b": (20.0, 1)}


def test_null_keys_meet(spark):
    from tessel.plans.planner import drill_across

    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, b int")
    assert {tuple(r) for r in drill_across([a, b], ["k"]).collect()} == {(None, 1, 3), ("x", 2, None), ("y", None, 4)}


@pytest.mark.parametrize(("request_", "rule"), [(Request(("net_sales",), ("return.id",)), "fanout"), (Request(("net_sales",), ("item.secret",)), "hidden_column"), (Request(("nothing",)), "metric_expression"), (Request(("order_count",), grain="monthly"), "time_filter")])
def test_refusals(shop, request_, rule):
    with pytest.raises(SemanticError, match=rule):
        compile_request(*shop, request_)


@pytest.mark.parametrize("where", ["secret > 0", "item.secret > 0", "sale.hidden > 0", "item_valid > 0", "is_valid2 > 0"])
def test_hidden_and_foreign_columns_are_no_filters(shop, where):
    from dataclasses import replace

    model, tables = shop
    sale, item = model.entities["sale"], model.entities["item"]
    own = replace(sale, dimensions={**sale.dimensions, "hidden": "is_valid", "secret": "is_valid"}, hidden=frozenset({"is_valid"}))
    closed = Model({**model.entities, "sale": own, "item": item}, model.relationships, model.metrics)
    with pytest.raises(SemanticError, match="hidden_column|unknown_table_or_column"):  # a column of a joined table isn't the fact's own either
        compile_request(closed, tables, Request(("net_sales",), ("item.category",), where=where))


def test_filters_over_several_facts_name_shared_dimensions(shop):
    with pytest.raises(SemanticError, match="all facts share"):
        compile_request(*shop, Request(("net_sales", "returned"), where="amount > 1"))
    assert rows(shop, "net_sales", "returned", where="item.category = 'a'") == [(40.0, 4.0)]  # both returned sales are of category a
    assert rows(shop, "net_sales", "returned", where="item.category = 'b'") == [(20.0, None)]


def test_roles_and_self_joins(spark):
    tables = {"person": spark.createDataFrame([(1, "ann", None), (2, "bob", 1), (3, "cy", 1), (4, "di", 2)], "id long, name string, boss_id long"), "task": spark.createDataFrame([(1, 2, 4, 5.0), (2, 3, 2, 7.0)], "task_id long, from_id long, to_id long, hours double")}
    model = Model(
        {"task": Entity("task", "task", ("task_id",)), "giver": Entity("giver", "person", ("id",), {"name": "name"}), "taker": Entity("taker", "person", ("id",), {"name": "name"}), "boss": Entity("boss", "person", ("id",), {"name": "name"})},
        [Relationship("task", "from_id", "giver", "id"), Relationship("task", "to_id", "taker", "id"), Relationship("taker", "boss_id", "boss", "id")],
        {"hours": Metric("hours", "task", "sum", "hours")},
    )
    out = compile_request(model, tables.__getitem__, Request(("hours",), ("giver.name", "taker.name", "boss.name"), where="taker.name != 'zed'"))
    assert sorted(tuple(r) for r in out.collect()) == [("bob", "di", "bob", 5.0), ("cy", "bob", "ann", 7.0)]


def test_additivity(shop):
    model, _ = shop
    assert model.additive(model.metrics["order_count"]) and not model.additive(model.metrics["valid_ratio"])


@pytest.mark.parametrize("text", ["lower(a) = 'x'", "a like 'x%'", "1 = a", "a = b", "a in ()", "a = 1 -- c", "a = (select 1)", "a ="])
def test_predicates_refused(text):
    with pytest.raises((PredicateError, IndexError)):
        parse(text, lambda n: _Probe())


def test_predicates(spark):
    d = spark.createDataFrame([(1, "o'x"), (2, None), (3, "y")], "a int, b string")
    for text, want in (("a in (1, 3) and not b = 'y'", [1]), ("b is null or (a >= 3)", [2, 3]), ("a between 1 and 2 and b is not null", [1]), ("b = 'o''x'", [1]), ("a not in (1)", [2, 3])):
        assert [r.a for r in d.where(parse(text)[0]).orderBy("a").collect()] == want, text
    assert extract("revenue where a > 2?") == "a > 2"
    assert extract("revenue by month") is None


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select(F.col("id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"), F.lit("x").alias("unused")).write.parquet(str(tmp_path / "f"))
    model = Model({"f": Entity("f", "f", ("id",), {})}, [], {"n": Metric("n", "f", "count", "*", time="t")})
    plan = compile_request(model, lambda _: spark.read.parquet(str(tmp_path / "f")), Request(("n",), ranges=((date(1970, 1, 1), date(1970, 1, 1)),)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t," in plan and "unused" not in plan
