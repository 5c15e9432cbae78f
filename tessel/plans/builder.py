"""A semantic model proposed from tables: keys, references, paths and metrics, merged into a curated one.

Profiles are one aggregation a table; a proposed reference is proven by an anti join on the parent's distinct key.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.plans.model import Entity, Metric, Model, Relationship, SemanticError

NUMERIC = ("int", "bigint", "smallint", "double", "float", "decimal")
#: Words in names: of keys, of amounts that add up, of personal data.
KEY_NAME = re.compile(r"(^|_)\w*(key|id)$", re.I)
AMOUNT_NAME = re.compile(r"price|amount|value|total|quantity|cost|balance|bal$", re.I)
PERSONAL = ("email", "phone", "address", "birth", "ssn", "password")


def bare(column: str, columns: list[str]) -> str:
    """A column's name without the one- or two-letter prefix, if all columns of its table share it."""
    prefixes = {m[0] if (m := re.match(r"[a-z]{1,2}_", c.lower())) else "" for c in columns}
    return column.lower().removeprefix(prefixes.pop() if len(prefixes) == 1 else "")


def profile(df: DataFrame) -> dict[str, dict]:
    """By column: rows, nulls, and the distinct values of columns that may be keys or parts of them. One pass; distinct counts are exact and only of candidates."""
    keys = [c for c, t in df.dtypes if t.split("(")[0] in ("int", "bigint", "smallint", "string") and (KEY_NAME.search(c) or re.search(r"number$", c, re.I))]
    out = df.agg(F.count("*").alias("__rows"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns)).first()
    found = {c: {"rows": out["__rows"], "nulls": out[c], "rate": out[c] / out["__rows"] if out["__rows"] else None, "distinct": None} for c in df.columns}
    for c in keys:  # one column at a time: several distinct counts in one aggregate repeat every row for each
        found[c]["distinct"] = df.agg(F.countDistinct(c)).first()[0]
    return found


def key_of(df: DataFrame, found: dict[str, dict], widest: int = 2) -> tuple[str, ...]:
    """The first column that is never null and never twice, names in id or key first; else the first pair of such names that is."""
    order = sorted((c for c, p in found.items() if p["distinct"] is not None and p["nulls"] == 0 and p["rows"]), key=lambda c: (not KEY_NAME.search(c), df.columns.index(c)))
    for c in order:
        if found[c]["distinct"] == found[c]["rows"]:
            return (c,)
    for i, a in enumerate(order if widest > 1 else []):
        for b in order[i + 1 :]:
            if found[a]["distinct"] * found[b]["distinct"] >= found[a]["rows"] and df.groupBy(a, b).count().where("count > 1").isEmpty():
                return (a, b)
    return ()


def references(tables: dict[str, DataFrame], keys: dict[str, tuple[str, ...]]) -> list[tuple[str, str, str, str]]:
    """(table, column, parent, key) where a column is named like another table's single key and has no value that the key lacks."""
    out = []
    for parent, key in sorted(keys.items()):
        if len(key) != 1:
            continue
        for child, df in sorted(tables.items()):
            for c in df.columns:
                own = bare(c, df.columns)
                named = own == bare(key[0], tables[parent].columns) or own in (f"{parent.rstrip('s')}_id", f"{parent}_id")
                if child == parent or not named or dict(df.dtypes)[c] not in _same_types(dict(tables[parent].dtypes)[key[0]]):
                    continue
                orphans = df.where(F.col(c).isNotNull()).select(F.col(c).alias("k")).distinct().join(tables[parent].select(F.col(key[0]).alias("k")), "k", "left_anti")
                if orphans.isEmpty():
                    out.append((child, c, parent, key[0]))
    return out


def _same_types(kind: str) -> tuple[str, ...]:
    return ("int", "bigint", "smallint") if kind in ("int", "bigint", "smallint") else (kind,)


def propose(tables: dict[str, DataFrame]) -> Model:
    """N-13, N-15: an entity a table, references as n:1 relationships, and metrics of tables with a time: a count (of the key where it is one column), sums of amounts, and rates of flags."""
    found = {t: profile(df) for t, df in tables.items()}
    keys = {t: key_of(df, found[t]) for t, df in tables.items()}
    links = references(tables, keys)
    entities, metrics = {}, {}
    for t, df in tables.items():
        kinds = dict(df.dtypes)
        hidden = frozenset(c for c in df.columns if any(w in c.lower() for w in PERSONAL))
        joined = {c for child, c, _, _ in links if child == t}
        text = {bare(c, df.columns): c for c, k in kinds.items() if k == "string" and c not in hidden}
        entities[t] = Entity(t, t, keys[t], text, hidden)
        time = next((c for c, k in kinds.items() if k.startswith(("date", "timestamp"))), None)
        if time is None:
            continue
        one = len(keys[t]) == 1
        metrics[f"{t}_count"] = Metric(f"{t}_count", t, "count_distinct" if one else "count", keys[t][0] if one else "*", time=time)
        for c, k in kinds.items():
            if k.split("(")[0] in NUMERIC and c not in joined and c not in keys[t] and c not in hidden:
                name = f"{t}_{bare(c, df.columns)}"
                if AMOUNT_NAME.search(c):
                    metrics[name] = Metric(name, t, "sum", c, time=time)
                elif re.match(r"(is|has)_", bare(c, df.columns)):
                    metrics[f"{name}_rate"] = Metric(f"{name}_rate", t, "ratio", f"sum({c})", "count(*)", time=time)
    return Model(entities, [Relationship(a, c, b, k) for a, c, b, k in links], metrics)


def paths(model: Model, longest: int = 3) -> list[tuple[str, str, int]]:
    """(from, to, steps) of every n:1 path of up to so many steps."""
    out = []
    for a in model.entities:
        for b in model.entities:
            if a != b:
                try:
                    out.append((a, b, len(model.path(a, b, longest))))
                except SemanticError:
                    continue
    return out


def merge(curated: Model, proposed: Model) -> Model:
    """What a person wrote stays, field by field; proposals fill what is missing."""
    entities = dict(proposed.entities)
    for name, e in curated.entities.items():
        p = proposed.entities.get(name)
        entities[name] = e if p is None else replace(e, primary_key=e.primary_key or p.primary_key, dimensions=p.dimensions | e.dimensions, hidden=e.hidden | p.hidden)
    have = {(r.left, r.left_column, r.right) for r in curated.relationships}
    links = [*curated.relationships, *(r for r in proposed.relationships if (r.left, r.left_column, r.right) not in have)]
    return Model(entities, links, proposed.metrics | curated.metrics, curated.calendar or proposed.calendar)


def as_rows(model: Model, df: DataFrame) -> DataFrame:
    """The model's relationships as rows (child, child_column, parent, parent_key), in df's session."""
    return df.sparkSession.createDataFrame([(r.left, r.left_column, r.right, r.right_column) for r in model.relationships], "child string, child_column string, parent string, parent_key string")


__all__ = ["as_rows", "key_of", "merge", "paths", "profile", "propose", "references"]
