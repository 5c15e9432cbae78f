from dataclasses import replace
from datetime import date

import pytest

from tessel.plans import questions as q
from tessel.plans.model import Entity, Metric, Model, SemanticError
from tessel.queries import MODEL

TODAY = date(2001, 8, 1)


def model():
    m = Metric("sales", "order", "sum", "x", synonyms=("revenue",)), Metric("net_sales", "order", "sum", "y"), Metric("orders", "order", "count", synonyms=("id",)), Metric("rate", "order", "ratio", "sum(a)", "count(*)", synonyms=("orders share",))
    e = Entity("order", "t", ("k",), {"city": "c", "secret": "s"}, frozenset({"s"}), synonyms=("订单",), dimension_synonyms={"city": ("town", "城市")})
    return Model({"order": e}, [], {x.name: x for x in m})


def test_longest_term_wins():
    assert [m.name for m in q.metrics_in(model(), "net sales last month")] == ["net_sales"]
    assert [m.name for m in q.metrics_in(model(), "net sales and sales")] == ["net_sales", "sales"]
    assert [m.name for m in q.metrics_in(model(), "how many orders share")] == ["orders"]
    assert [m.name for m in q.metrics_in(model(), "list the ids, id and revenue")] == ["sales"]
    assert q.metrics_in(model(), "salesperson") == []


def test_mentions_and_groups():
    assert q.mentions(model(), "订单 by town, secret") == ["order", "order.city"]
    assert q.groups_in(model(), "sales per the home town", []) == ["order.city"]
    assert q.groups_in(model(), "销售额按城市", []) == ["order.city"]
    assert q.groups_in(model(), "sales in town", []) == []


def test_request_and_errors(spark):
    r = q.to_request(MODEL, "Top 3 order value by customer segment in 1997 where status = 'F'", TODAY)
    assert (r.metrics, r.dimensions, r.where, r.limit) == (("order_value",), ("customer.segment",), "status = 'F'", 3)
    assert r.ranges == ((date(1997, 1, 1), date(1997, 12, 31)),)
    with pytest.raises(SemanticError):
        q.to_request(MODEL, "the weather by region", TODAY)


def test_follow_up(spark):
    r = q.to_request(MODEL, "order count by order status", TODAY)
    out, why = q.follow_up(MODEL, r, "by order priority instead", TODAY)
    assert out.dimensions == ("order.priority",) and why == ["dimensions"]
    out, why = q.follow_up(MODEL, r, "top 5", TODAY)
    assert (out.limit, out.descending, out.metrics) == (5, True, r.metrics)
    out, why = q.follow_up(MODEL, replace(r, where="a = 1"), "only b = 2", TODAY)
    assert out.where == "(a = 1) AND (b = 2)" and why == ["where"]
    assert q.follow_up(MODEL, r, "add order value", TODAY)[0].metrics == ("order_count", "order_value")
    assert q.follow_up(MODEL, r, "remove order status", TODAY)[0].dimensions == ()
    assert q.follow_up(MODEL, r, "over time", TODAY)[0].grain == "monthly"
    assert q.follow_up(MODEL, r, "thanks", TODAY) == (r, [])
    with pytest.raises(SemanticError):
        q.follow_up(MODEL, r, "add happiness", TODAY)


def test_subjects_template_contract():
    assert q.subjects(MODEL, "order value of the customer")[0][0] == "order"
    assert [q.template(x) for x in ("why did it drop", "sales over time", "sales by city", "sales", "any outliers")] == ["contribution", "trend", "segment", "default", "anomaly"]
    assert q.contract("count orders and return a_id, total and n") == ["a_id", "total", "n"] and q.contract("count orders") is None
    assert q.meets(["a", "b"], ["a", "b"]) and not q.meets(["b", "a"], ["a", "b"])
    wide = {"t": [f"c{i}" for i in range(200)] + ["key", "city"]}
    shown = q.context_columns(wide, {"t": {"key"}}, "sales by city")["t"]
    assert len(shown) == 100 and {"key", "city"} <= set(shown)
