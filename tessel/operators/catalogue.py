"""What a caller may see of a catalogue, what a backend can do, and results as JSON-safe columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.operators.governance import Policy, PolicyError, visible
from tessel.plans.model import Model


def list_tables(spark: SparkSession, policy: Policy) -> list[str]:
    """S-12: the user's tables and views that the policy shows, in order of name."""
    names = {t.name for t in spark.catalog.listTables() if not t.name.startswith("_")}
    return sorted(names & set(policy.tables) if policy.tables else names)


def describe(df: DataFrame, table: str, policy: Policy, model: Model | None = None) -> list[dict]:
    """S-13: the visible columns with their place in the key and what they refer to; a reference shows only if its target does."""
    own = next((e for e in model.entities.values() if e.table == table), None) if model else None
    out = []
    for name, kind, nullable in visible(df, table, policy):
        if own and name in own.hidden:
            continue
        refers = None
        for r in model.relationships if own else ():
            target = model.entities[r.right]
            seen = not policy.tables or (target.table in policy.tables and (policy.tables[target.table] is None or r.right_column in policy.tables[target.table]))
            if (r.left, r.left_column) == (own.name, name) and seen and r.right_column not in target.hidden:
                refers = f"{target.table}.{r.right_column}"
        out.append({"name": name, "type": kind, "nullable": nullable, "key": own.primary_key.index(name) + 1 if own and name in own.primary_key else None, "refers_to": refers})
    return out


class UnsafeValue(ValueError):
    """A value that has no JSON form."""


def json_safe(df: DataFrame) -> DataFrame:
    """S-21: whole numbers, finite floats, truth values and text as they are; decimals and times as text, bytes as lower-case hex. NaN and infinities fail the query when they are read, containers at once."""

    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            raise UnsafeValue(f"{f.name} holds containers")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            odd = F.isnan(c) | (F.abs(c) == float("inf"))
            return F.when(odd, F.raise_error(F.lit(f"{f.name} holds a number that isn't finite")).cast("double")).otherwise(c.cast("double"))
        if isinstance(f.dataType, T.DecimalType):
            return c.cast("string")
        if isinstance(f.dataType, T.DateType):
            return F.date_format(c, "yyyy-MM-dd")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
        if isinstance(f.dataType, T.BinaryType):
            return F.lower(F.hex(c))
        return c

    return df.select(*(one(f).alias(f.name) for f in df.schema.fields))


@dataclass(frozen=True)
class Capability:
    """V-10: what a backend's SQL has; what it lacks is refused before it is asked."""

    backend: str
    ilike: bool = True
    qualify: bool = False
    lateral: bool = True
    date_functions: frozenset[str] = frozenset()

    def refusals(self, sql: str) -> list[str]:
        """Features and date functions in a statement, outside quotes, that the backend doesn't have."""
        bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).lower()
        out = [f"{name} on {self.backend}" for name, has in (("ilike", self.ilike), ("qualify", self.qualify), ("lateral", self.lateral)) if not has and re.search(rf"\b{name}\b", bare)]
        called = set(re.findall(r"\b(\w+)\s*\(", bare)) & EVERY_DATE_FUNCTION
        return out + [f"{f}() on {self.backend}" for f in sorted(called - self.date_functions)]

    def require(self, sql: str) -> None:
        if found := self.refusals(sql):
            raise PolicyError("unsupported " + "; ".join(found))


#: Date functions by backend.
DATE_FUNCTIONS = {
    "spark": frozenset("date_trunc date_format date_add date_sub add_months datediff to_date year month quarter dayofmonth weekday".split()),
    "sqlite": frozenset("strftime date datetime julianday".split()),
    "duckdb": frozenset("date_trunc strftime date_diff date_add year month quarter".split()),
    "postgresql": frozenset("date_trunc to_char date_part age make_date".split()),
}
EVERY_DATE_FUNCTION = frozenset().union(*DATE_FUNCTIONS.values())
CAPABILITIES = {
    "spark": Capability("spark", date_functions=DATE_FUNCTIONS["spark"]),
    "sqlite": Capability("sqlite", ilike=False, lateral=False, date_functions=DATE_FUNCTIONS["sqlite"]),
    "duckdb": Capability("duckdb", qualify=True, date_functions=DATE_FUNCTIONS["duckdb"]),
    "postgresql": Capability("postgresql", date_functions=DATE_FUNCTIONS["postgresql"]),
}
