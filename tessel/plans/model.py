"""Semantic model: entities, relationships, metrics with time and additivity contracts."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from datetime import date

REVERSED = {"one_to_many": "many_to_one", "many_to_one": "one_to_many", "one_to_one": "one_to_one", "many_to_many": "many_to_many"}


class SemanticError(ValueError):
    """A request the model can't answer safely; the message names the rule."""


@dataclass(frozen=True)
class Entity:
    name: str
    table: str
    primary_key: tuple[str, ...]
    dimensions: dict[str, str] = field(default_factory=dict)
    hidden: frozenset[str] = frozenset()
    order_by: dict[str, str] = field(default_factory=dict)  # O-01: label column to its ordering companion
    synonyms: tuple[str, ...] = ()
    dimension_synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class Relationship:
    left: str
    left_column: str
    right: str
    right_column: str
    cardinality: str = "many_to_one"

    def reverse(self) -> Relationship:
        return Relationship(self.right, self.right_column, self.left, self.left_column, REVERSED[self.cardinality])


@dataclass(frozen=True)
class Metric:
    name: str
    entity: str
    kind: str  # sum, count, count_distinct, avg, min, max, ratio
    expression: str = "*"
    denominator: str | None = None
    scale: float = 1.0
    filters: tuple[str, ...] = ()
    time: str | None = None
    offset: str = "+00:00"
    fiscal_start: int = 1
    coverage: tuple[date, date] | None = None
    require_complete: bool = False
    additivity: str = "additive"  # additive, non_additive, semi_additive
    non_additive: frozenset[str] = frozenset()
    dimensions: frozenset[str] | None = None  # allowed; None: all reachable
    synonyms: tuple[str, ...] = ()


@dataclass
class Model:
    entities: dict[str, Entity]
    relationships: list[Relationship]
    metrics: dict[str, Metric]
    calendar: str | None = None  # J-05: the entity of days, whose key is a date

    def dimension(self, ref: str) -> tuple[Entity, str]:
        """entity.dimension to its entity and column; hidden columns are refused (P-10)."""
        entity, _, name = ref.partition(".")
        if entity not in self.entities or name not in self.entities[entity].dimensions:
            raise SemanticError(f"unknown_table_or_column: {ref}")
        column = self.entities[entity].dimensions[name]
        if column in self.entities[entity].hidden:
            raise SemanticError(f"hidden_column: {ref}")
        return self.entities[entity], column

    def path(self, start: str, end: str, longest: int = 4) -> list[Relationship]:
        """The shortest path whose steps never fan out; a fan-out-only path is refused."""
        steps = [x for r in self.relationships for x in (r, r.reverse())]

        def search(safe: bool) -> list[Relationship] | None:
            queue, seen = deque([(start, [])]), {start}
            while queue:
                at, path = queue.popleft()
                if at == end:
                    return path
                if len(path) < longest:
                    for s in steps:
                        if s.left == at and s.right not in seen and (not safe or s.cardinality in ("many_to_one", "one_to_one")):
                            seen.add(s.right)
                            queue.append((s.right, [*path, s]))
            return None

        found = search(True)
        if found is None:
            raise SemanticError(f"fanout: {start} to {end}" if search(False) else f"no_path: {start} to {end}")
        return found

    def additive(self, metric: Metric) -> bool:
        """G-14: distinct counts and ratios don't add up, unless the distinct column is the entity's whole key."""
        if metric.kind == "count_distinct":
            return self.entities[metric.entity].primary_key == (metric.expression,)
        return metric.kind in ("sum", "count") and metric.additivity == "additive"
