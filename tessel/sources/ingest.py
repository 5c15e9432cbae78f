"""Incremental ingestion: normalise, quarantine, first-wins keys, watermark."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.scalars import INTEGER, REAL, as_integer, as_real, clean_text, identifier, identifiers, mixed_less, sorted_json

ORDINAL, REASON = "__ordinal", "__reason"


@dataclass(frozen=True)
class Rules:
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    watermark: str | None = None
    max_invalid: float = 1.0


def normalise(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """N-01, N-02: safe names, trimmed text, empty as null; nested values as JSON text with sorted keys. aliases: from a source's name, as it is or made safe, to the column's."""
    aliases = aliases or {}
    nested = {f.name: f.dataType for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    called = [aliases.get(c, aliases.get(identifier(c), c)) for c in df.columns]
    return df.select(*(sorted_json(F.col(f"`{c}`"), nested[c]).alias(n) if c in nested else clean_text(F.col(f"`{c}`")).alias(n) for c, n in zip(df.columns, identifiers(called))))


def infer_types(df: DataFrame) -> DataFrame:
    """N-03: INTEGER < REAL < TEXT for each text column, in one pass; all-null columns are TEXT."""
    own = [c for c in df.columns if c != ORDINAL]
    parts = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.bool_and(F.col(c).rlike(INTEGER)).alias("i"), F.bool_and(F.col(c).rlike(INTEGER) | F.col(c).rlike(REAL)).alias("r")) for c in own]
    kind = F.when(F.col("n") == 0, "TEXT").when(F.col("i"), "INTEGER").when(F.col("r"), "REAL").otherwise("TEXT")
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*").select("column", "n", kind.alias("type"))


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    return df.select(*({"INTEGER": as_integer, "REAL": as_real}.get(types.get(c, "TEXT"), F.col)(F.col(c) if types.get(c) in ("INTEGER", "REAL") else c).alias(c) for c in df.columns))


def with_ordinal(df: DataFrame) -> DataFrame:
    """The order of reading: rises with partition and row."""
    return df.withColumn(ORDINAL, F.monotonically_increasing_id())


def after_watermark(df: DataFrame, column: str, stored: str | None) -> DataFrame:
    """N-06: strictly later than what is stored; nulls are skipped silently."""
    d = df.where(F.col(column).isNotNull())
    return d if stored is None else d.where(mixed_less(F.lit(stored), F.col(column)))


def judge_rows(df: DataFrame, rules: Rules, published: DataFrame | None = None) -> DataFrame:
    """N-04, N-05: every row with its reason; null means accepted. df has the ordinal column.

    Missing required values come first; of the others, the first of each key that isn't published yet wins.
    """
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in rules.required))) if rules.required else F.array().cast("array<string>")
    d = df.withColumn(REASON, F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))))
    if not rules.unique:
        return d
    null_key = F.array_contains(F.array(*(F.col(c).isNull() for c in rules.unique)), True)
    d = d.withColumn(REASON, F.coalesce(F.col(REASON), F.when(null_key, F.lit("null key"))))
    if published is not None:
        known = published.select(*rules.unique).distinct().withColumn("__known", F.lit(True))
        d = d.join(known, list(rules.unique), "left").withColumn(REASON, F.coalesce(F.col(REASON), F.when(F.col("__known"), F.lit("duplicate")))).drop("__known")
    # the least ordinal of each key among rows still good; pre-aggregated, so a hot key is no task's burden
    first = d.where(F.col(REASON).isNull()).groupBy(*rules.unique).agg(F.min(ORDINAL).alias("__first"))
    d = d.join(first, list(rules.unique), "left")
    return d.withColumn(REASON, F.coalesce(F.col(REASON), F.when(F.col(ORDINAL) != F.col("__first"), F.lit("duplicate")))).drop("__first")


def advance(accepted: DataFrame, column: str, stored: str | None) -> str | None:
    """N-07: the greatest accepted value, never backwards: decimals if all are, else text."""
    number = F.col(column).cast("string").try_cast("decimal(38,10)")
    r = accepted.agg(F.max_by(F.col(column).cast("string"), number).alias("n"), F.max(F.col(column).cast("string")).alias("t"), F.bool_and(number.isNotNull()).alias("all")).first()
    new = r["n"] if r["all"] else r["t"]
    if new is None or stored is None:
        return new if stored is None else stored
    less = accepted.sparkSession.range(1).select(mixed_less(F.lit(stored), F.lit(new)).alias("l")).first()["l"]
    return new if less else stored


def profile(df: DataFrame) -> DataFrame:
    """N-14: rows, nulls and distinct values of each column, exact: one pass for counts, and the distinct values of all columns as (column, value) pairs that are reduced before they are shuffled."""
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls")) for c in df.columns]
    counts = df.agg(F.array(*parts).alias("a")).select(F.inline("a"))
    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns))).alias("p")).select("p.*")
    distinct = pairs.where("v is not null").distinct().groupBy("column").agg(F.count("*").alias("distinct"))
    return counts.join(distinct, "column", "left").select("column", "rows", "nulls", F.coalesce("distinct", F.lit(0)).alias("distinct"))


def scaffold(df: DataFrame) -> dict:
    """N-14: grain and kind proposed from the profile: the first fully distinct column, *_id first."""
    p = {r["column"]: r for r in profile(df).collect()}
    full = [c for c, r in p.items() if r["rows"] and r["nulls"] == 0 and r["distinct"] == r["rows"]]
    grain = next(iter([c for c in full if c.endswith("_id")] + full), None)
    personal = [c for c in df.columns if any(w in c.lower() for w in ("email", "phone", "address", "birth", "ssn", "password"))]
    times = [c for c, t in df.dtypes if t.startswith(("date", "timestamp")) or c.lower().endswith(("_at", "date", "_ts"))]
    return {"grain": grain, "hidden": personal, "time": times[0] if times else None, "kind": "fact" if times else "dimension", "metrics": [f"count_distinct({grain})" if grain else "count(*)"]}
