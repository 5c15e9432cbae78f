"""Metric requests to DataFrames (SURVEY G-01 to G-03, G-05 to G-10, G-15, G-16, J-01, J-05 to J-08, J-12, J-13, P-01, P-02, P-05, P-09, P-10, O-01, O-02, D-12, T-09).

Each fact is filtered, joined to its dimensions by n:1 paths and aggregated, alone; several facts meet after
aggregation on null-safe keys, so facts never join facts. Filters stay on raw columns, so they reach the scan. A table that plays
several roles is an entity for each, and its columns get the role's name where they would clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import calendar
from tessel.plans.model import Metric, Model, SemanticError
from tessel.plans.predicates import _Probe, parse

Tables = Callable[[str], DataFrame]


@dataclass(frozen=True)
class Request:
    metrics: tuple[str, ...]
    dimensions: tuple[str, ...] = ()
    grain: str | None = None
    ranges: tuple[tuple[date, date], ...] = ()
    where: str | None = None
    limit: int | None = None
    descending: bool = False
    baseline: str | None = None


def aggregate(m: Metric) -> list[Column]:
    """The metric's column; a ratio also has its two parts, for audit."""
    if m.kind == "ratio":
        n, d = F.expr(m.expression).cast("double"), F.expr(m.denominator).cast("double")
        return [F.try_divide(n * m.scale, d).alias(m.name), n.alias(f"{m.name}__numerator"), d.alias(f"{m.name}__denominator")]
    e = F.expr("1" if m.expression == "*" else m.expression)
    return [{"sum": F.sum, "count": F.count, "count_distinct": F.countDistinct, "avg": F.avg, "min": F.min, "max": F.max}[m.kind](e).alias(m.name)]


def within(m: Metric, ranges: tuple[tuple[date, date], ...]) -> Column:
    """P-09: the metric's calendar days in any of the ranges; half-open bounds on the raw column, so that they are pushed down."""
    if m.time.endswith("_key"):
        return reduce(lambda a, b: a | b, (F.col(m.time).between(int(f"{s:%Y%m%d}"), int(f"{e:%Y%m%d}")) for s, e in ranges))
    hours, minutes = int(m.offset[:3]), int(m.offset[0] + m.offset[4:])
    shift = timedelta(hours=hours, minutes=minutes)

    def at(d: date) -> Column:
        from datetime import datetime

        return F.lit((datetime(d.year, d.month, d.day) - shift).isoformat(sep=" ")).cast("timestamp_ntz")

    return reduce(lambda a, b: a | b, ((F.col(m.time) >= at(s)) & (F.col(m.time) < at(e + timedelta(1))) for s, e in ranges))


class Joined:
    """A metric's fact with the dimensions joined so far, and the names that each entity's columns have in it."""

    def __init__(self, model: Model, tables: Tables, m: Metric) -> None:
        self.model, self.tables, self.metric, self.base = model, tables, m, model.entities[m.entity]
        self.df = tables(self.base.table)
        self.names = {m.entity: {c: c for c in self.df.columns}}

    def _add(self, entity: str, on: Callable[[dict[str, str]], Column]) -> None:
        other = self.tables(self.model.entities[entity].table)
        taken = set(self.df.columns)
        names = {c: f"{entity}__{c}" if c in taken else c for c in other.columns}
        self.df = self.df.join(other.select(*(F.col(c).alias(n) for c, n in names.items())), on(names))
        self.names[entity] = names

    def reach(self, entity: str) -> None:
        if entity in self.names:
            return
        if entity == self.model.calendar:  # J-05: on the metric's own time
            if not self.metric.time:
                raise SemanticError(f"time_filter: {self.metric.name} has no time field")
            key = self.model.entities[entity].primary_key[0]
            self._add(entity, lambda names: calendar.day(F.col(self.metric.time), self.metric.offset) == F.col(names[key]))
            return
        for step in self.model.path(self.metric.entity, entity):
            if step.right not in self.names:
                self._add(step.right, lambda names, step=step: F.col(self.names[step.left][step.left_column]) == F.col(names[step.right_column]))

    def dimension(self, ref: str) -> Column:
        entity, column = self.model.dimension(ref)
        if self.metric.dimensions is not None and ref not in self.metric.dimensions:
            raise SemanticError(f"grain: {self.metric.name} has no dimension {ref}")
        self.reach(entity.name)
        return F.col(self.names[entity.name][column])

    def companion(self, ref: str) -> Column | None:
        """O-01: what a label is ordered by."""
        entity, _ = self.model.dimension(ref)
        column = entity.order_by.get(ref.partition(".")[2])
        return F.col(self.names[entity.name][column]) if column else None

    def bind(self, name: str) -> Column:
        """A filter's name: entity.dimension, or a dimension or column of the fact itself; the column behind it mustn't be hidden."""
        if "." in name:
            return self.dimension(name)
        column = self.base.dimensions.get(name, name)
        if column in self.base.hidden:
            raise SemanticError(f"hidden_column: {name}")
        if column not in self.names[self.metric.entity]:
            raise SemanticError(f"unknown_table_or_column: {name}")
        return F.col(column)


def fact(model: Model, tables: Tables, m: Metric, request: Request) -> DataFrame:
    """One metric at the request's grain; a label with a companion brings its least one along."""
    if (request.grain or request.ranges) and not m.time:
        raise SemanticError(f"time_filter: {m.name} has no time field")
    if request.grain and m.additivity == "semi_additive" and "time" in m.non_additive:
        raise SemanticError(f"grain: {m.name} doesn't add up over time")
    if request.ranges and m.require_complete and request.grain and m.coverage and not all(calendar.complete(d, request.grain, m.coverage) for r in request.ranges for d in r):
        raise SemanticError(f"time_filter: {m.name} isn't complete in that range")
    j = Joined(model, tables, m)
    filters = [F.expr(f) for f in m.filters]
    if request.ranges:
        filters.append(within(m, request.ranges))
    if filters:  # before any join
        j.df = j.df.where(reduce(lambda a, b: a & b, filters))
    if request.where:
        condition = parse(request.where, j.bind)[0]  # joins what it names
        j.df = j.df.where(condition)
    keys = [j.dimension(ref).alias(ref) for ref in request.dimensions]
    if request.grain:
        keys.append(calendar.bucket(calendar.day(F.col(m.time), m.offset), request.grain, m.fiscal_start).alias("period"))
    order = [F.min(c).alias(f"{ORDER}{i}") for i, ref in enumerate(request.dimensions) if (c := j.companion(ref)) is not None]
    return j.df.groupBy(*keys).agg(*aggregate(m), *order)


ORDER = "__order_"


def drill_across(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """J-07: measures of several facts side by side. What a fact lacks stays null; null keys meet (J-06)."""
    if not keys:  # J-08: one row each
        return reduce(lambda a, b: a.join(b, "__one"), (p.withColumn("__one", F.lit(1)) for p in parts)).drop("__one")
    quoted = [F.col(f"`{k}`") for k in keys]
    out = reduce(lambda a, b: a.unionByName(b), (p.select(*quoted) for p in parts)).distinct()
    for n, p in enumerate(parts):
        measures = [c for c in p.columns if c not in keys]
        renamed = p.select(*(F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)), *(F.col(f"`{c}`").alias(f"{c}_{n}" if c.startswith(ORDER) else c) for c in measures))
        on = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)))
        out = out.join(renamed, on, "left").drop(*(f"__{i}" for i in range(len(keys))))
    for c in [c for c in parts[0].columns if c.startswith(ORDER)]:
        own = [x for x in out.columns if x.startswith(f"{c}_")]
        out = out.withColumn(c, F.array_min(F.array(*own))).drop(*own)
    return out


def compile_request(model: Model, tables: Tables, request: Request) -> DataFrame:
    """The request's result: keys, then measures."""
    unknown = [n for n in request.metrics if n not in model.metrics]
    if unknown or not request.metrics:
        raise SemanticError(f"metric_expression: unknown metric {unknown}")
    if request.where and len({model.metrics[n].entity for n in request.metrics}) > 1 and (loose := [n for n in parse(request.where, lambda n: _Probe())[1] if "." not in n]):
        raise SemanticError(f"grain: {loose[0]} isn't a dimension that all facts share")
    keys = [*request.dimensions, *(["period"] if request.grain else [])]
    parts = [fact(model, tables, model.metrics[n], request) for n in request.metrics]
    out = parts[0] if len(parts) == 1 else drill_across(parts, keys)
    companions = [c for c in out.columns if c.startswith(ORDER)]
    if request.limit or companions:
        order = [F.desc_nulls_last(f"`{request.metrics[0]}`")] if request.descending else []
        out = out.orderBy(*order, *companions, *(F.col(f"`{k}`") for k in keys))
    return (out.limit(request.limit) if request.limit else out).drop(*companions)


def compile_comparison(model: Model, tables: Tables, request: Request) -> DataFrame:
    """T-09, D-12: one metric's periods beside those of the request's baseline: keys, period, baseline_period, current, baseline, delta, relative, percent, state.

    The ranges that are read grow by the whole baseline periods. A current period meets the period with exactly its baseline's label, or nothing.
    """
    if not request.baseline or not request.grain or len(request.ranges) != 1 or len(request.metrics) != 1:
        raise SemanticError("time_filter: a comparison needs one metric, a grain, one range and a baseline")
    from tessel.operators.analysis import compare

    m, (start, end) = model.metrics[request.metrics[0]], request.ranges[0]
    pairs, d = [], calendar.bounds(start, request.grain, m.fiscal_start)[0]
    while d <= end:
        before = calendar.baseline_day(d, request.baseline, request.grain, m.fiscal_start)
        pairs.append((calendar.label(d, request.grain, m.fiscal_start), calendar.label(before, request.grain, m.fiscal_start)))
        d = calendar.bounds(d, request.grain, m.fiscal_start)[1] + timedelta(1)
    both = fact(model, tables, m, replace(request, ranges=tuple(calendar.comparison_ranges(start, end, request.baseline, request.grain))))
    keys = list(request.dimensions)
    values = both.select(*(F.col(f"`{k}`") for k in keys), "period", F.col(f"`{m.name}`").cast("double").alias("value"))
    labels = F.create_map(*(F.lit(x) for p in pairs for x in p))  # as many as the range has periods
    current = values.withColumn("baseline_period", labels[F.col("period")]).where("baseline_period is not null").withColumnRenamed("value", "current")
    earlier = values.select(*(F.col(f"`{k}`").alias(f"__{i}") for i, k in enumerate(keys)), F.col("period").alias("__period"), F.col("value").alias("baseline"))
    on = reduce(lambda a, b: a & b, (F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}")) for i, k in enumerate(keys)), F.col("baseline_period") == F.col("__period"))
    out = current.join(earlier, on, "left")
    return out.select(*(F.col(f"`{k}`") for k in keys), "period", "baseline_period", "current", "baseline", *compare(F.col("current"), F.col("baseline")))
