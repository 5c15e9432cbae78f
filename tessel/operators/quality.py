"""Data-quality and contract checks. Each gives one row: check, target, failed, total, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.calendar import invalid_day

RANK = ("ok", "unknown", "warning", "error")


def _row(df: DataFrame, check: str, target: str, failed: Column, total: Column, status: Column) -> DataFrame:
    return df.agg(failed.cast("long").alias("failed"), total.cast("long").alias("total")).select(F.lit(check).alias("check"), F.lit(target).alias("target"), "failed", "total", status.alias("status"))


def grain_unique(df: DataFrame, keys: list[str], check: str = "grain_unique") -> DataFrame:
    """Q-01, Q-02, J-19: groups of rows with equal non-null keys, and rows with a null key."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    groups = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("null_key", null)
    out = groups.agg(F.count_if(~F.col("null_key") & (F.col("n") > 1)).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("null_key"), F.col("n"))), F.lit(0)).alias("null_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    bad = "error" if check == "grain_unique" else "warning"
    status = F.when(F.col("total") == 0, "unknown").when(F.col("duplicate_groups") + (F.col("null_rows") if check == "grain_unique" else 0) > 0, bad).otherwise("ok")
    return out.select(F.lit(check).alias("check"), F.lit(",".join(keys)).alias("target"), "duplicate_groups", "null_rows", "total", status.alias("status"))


def null_rates(df: DataFrame, columns: list[str], most: float = 0.0) -> DataFrame:
    """Q-03, in one pass over all rows: nulls only."""
    parts = F.array(*(F.struct(F.lit(c).alias("target"), F.count_if(F.col(c).isNull()).alias("failed"), F.count("*").alias("total")) for c in columns))
    rate = F.round(F.try_divide(F.col("failed").cast("double"), F.col("total").cast("double")), 6)
    status = F.when(F.col("total") == 0, "unknown").when(F.col("failed") == F.col("total"), "error").when(rate > most, "warning").otherwise("ok")
    return df.agg(parts.alias("p")).select(F.explode("p").alias("x")).select("x.*").select("target", "failed", "total", rate.alias("rate"), status.alias("status"))


def freshness(df: DataFrame, column: str, expected: str, tolerance_days: int = 1) -> DataFrame:
    """Q-04: days between the newest value and the expected day."""
    newest = df.agg(F.max(F.to_date(column)).alias("newest"))
    lag = F.datediff(F.lit(expected).cast("date"), F.col("newest"))
    return newest.select(F.col("newest").cast("string").alias("newest"), lag.alias("lag_days"), F.when(lag.isNull(), "unknown").when(lag <= 0, "ok").when(lag <= tolerance_days, "warning").otherwise("error").alias("status"))


def coverage(df: DataFrame, column: str, start: str, end: str, least: float = 0.0) -> DataFrame:
    """Q-05: days of the window that have a row."""
    d = F.to_date(column)
    expected = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    out = df.where(d.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).agg(F.countDistinct(d).alias("present")).withColumn("expected", expected.cast("long"))
    ratio = F.col("present") / F.col("expected")
    return out.select("present", "expected", F.round(ratio, 6).alias("ratio"), F.when((F.col("present") == 0) | (ratio < least), "error").when(F.col("present") < F.col("expected"), "warning").otherwise("ok").alias("status"))


def referential(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Q-06, Q-13, J-09, J-10: rows whose non-null reference has no parent."""
    child = df.where(F.col(column).isNotNull()).select(F.col(column).alias("k"))
    orphans = child.join(parent.select(F.col(key).alias("k")).distinct(), "k", "left_anti")
    return orphans.agg(F.count("*").alias("orphans"), F.countDistinct("k").alias("orphan_keys")).withColumn("status", F.when(F.col("orphans") > 0, "error").otherwise("ok"))


def local_column(columns: list[str], parent: str, key: str, declared: dict[str, str] | None = None) -> str | None:
    """Q-06: the column that refers to a parent's key: as declared, else the key's own name, else <parent>_<key>, <parent>_id or a name that ends in the key's."""
    if declared and parent in declared:
        return declared[parent]
    one = parent.rstrip("s")
    for name in (key, f"{one}_{key}", f"{parent}_{key}", f"{one}_id", f"{parent}_id"):
        if name in columns:
            return name
    ends = [c for c in columns if c.split("_", 1)[-1] == key.split("_", 1)[-1]]
    return ends[0] if len(ends) == 1 else None


def path_references(model, tables, start: str, end: str) -> DataFrame:  # noqa: ANN001
    """Q-13: the referential check of every step of a join path, with `step` child.column>parent.key."""
    checks = []
    for s in model.path(start, end):
        child, parent = model.entities[s.left].table, model.entities[s.right].table
        checks.append(referential(tables(child), s.left_column, tables(parent), s.right_column).select(F.lit(f"{child}.{s.left_column}>{parent}.{s.right_column}").alias("step"), "orphans", "orphan_keys", "status"))
    return reduce(DataFrame.unionByName, checks)


def proven_join(model, tables, start: str, end: str) -> DataFrame:  # noqa: ANN001
    """J-19: before a compiled join runs, the grain of its source and the uniqueness of every target column: one row each, and a join is safe if none has duplicates."""
    source = model.entities[start]
    checks = [grain_unique(tables(source.table), list(source.primary_key)).withColumn("target", F.lit(source.table))]
    checks += [grain_unique(tables(model.entities[s.right].table), [s.right_column]).withColumn("target", F.lit(f"{model.entities[s.right].table}.{s.right_column}")) for s in model.path(start, end)]
    return reduce(DataFrame.unionByName, checks).select("target", "duplicate_groups", "null_rows", "total", "status")


def snapshot(model) -> dict[str, dict[str, str]]:  # noqa: ANN001
    """Q-16: a hash of each entity, metric, relationship and path, by section, for `drift`."""
    import hashlib

    from tessel.plans.builder import paths

    h = lambda x: hashlib.sha256(repr(x).encode()).hexdigest()
    frozen = lambda e: [(f, sorted(v) if isinstance(v, (set, frozenset)) else sorted(v.items()) if isinstance(v, dict) else v) for f, v in sorted(vars(e).items())]
    return {
        "entities": {n: h(frozen(e)) for n, e in model.entities.items()},
        "metrics": {n: h(frozen(m)) for n, m in model.metrics.items()},
        "relationships": {f"{r.left}.{r.left_column}>{r.right}.{r.right_column}": h(r.cardinality) for r in model.relationships},
        "paths": {f"{a}>{b}": h(n) for a, b, n in paths(model)},
    }


def schema_drift(df: DataFrame, expected: list[str], additive: bool = True) -> dict:
    """Q-08."""
    missing, extra = sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))
    return {"missing": missing, "unexpected": extra, "status": "error" if missing or (extra and not additive) else "ok"}


def contract_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Q-09, Q-11: null rows, and duplicate groups with nulls grouped."""
    null = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
    g = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("null_key", null)
    return g.agg(F.coalesce(F.sum(F.when(F.col("null_key"), F.col("n"))), F.lit(0)).alias("null_rows"), F.count_if(F.col("n") > 1).alias("duplicate_groups"))


def contract_null_rate(df: DataFrame, column: str) -> DataFrame:
    """Q-10: null or blank; an empty table has rate 0."""
    blank = F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")
    return df.agg(F.count_if(blank).alias("failed"), F.coalesce(F.round(F.try_divide(F.count_if(blank).cast("double"), F.count("*").cast("double")), 6), F.lit(0.0)).alias("rate"))


def contract_range(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """Q-12: nulls pass."""
    c = F.col(column)
    bad = (c < low if low is not None else F.lit(False)) | (c > high if high is not None else F.lit(False))
    return df.agg(F.min(c).alias("least"), F.max(c).alias("greatest"), F.count_if(F.coalesce(bad, F.lit(False))).alias("failed"))


def contract_times(df: DataFrame, column: str) -> DataFrame:
    """Q-14: values that aren't real dates; nulls count."""
    return df.agg(F.count_if(invalid_day(F.col(column).cast("string"))).alias("failed"), F.count("*").alias("total"))


def roll_up(statuses: list[str]) -> str:
    """Q-07: the worst; nothing known is never ok."""
    return max(statuses, key=RANK.index) if statuses else "unknown"


def blocking(report: list[dict]) -> list[dict]:
    """Q-15."""
    return [r for r in report if r.get("status") == "error" and r.get("severity", "error") == "error"]


def drift(before: dict[str, dict[str, str]], after: dict[str, dict[str, str]]) -> dict[str, dict[str, list[str]]]:
    """Q-16: added, removed and changed names by section; values are content hashes."""
    out = {}
    for s in sorted(before.keys() | after.keys()):
        a, b = before.get(s, {}), after.get(s, {})
        out[s] = {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": sorted(k for k in a.keys() & b.keys() if a[k] != b[k])}
    return out
