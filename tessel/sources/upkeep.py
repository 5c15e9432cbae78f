"""Upkeep of uploads, histories and reports."""

from __future__ import annotations

import hashlib
import re
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions.ordered import previous


def data_version(spark: SparkSession, path: str) -> str:
    """N-16: one SHA-256 of the sorted (name, SHA-256 of the content) of all files below a path.

    Files are hashed where they are read; only names and digests meet.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # paths are compared from the given folder on, so that a moved upload keeps its version
    root = re.sub(r"^file:/+", "/", path.rstrip("/"))
    name = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{re.escape(root)}/?", "")
    named = files.select(name.alias("name"), F.sha2("content", 256).alias("digest"))
    digest = hashlib.sha256()
    for r in named.orderBy("name").toLocalIterator():  # one partition of names at a time
        digest.update(f"{r.name}\0{r.digest}\n".encode())
    return digest.hexdigest()


def import_history(spark: SparkSession, path: str) -> DataFrame:
    """S-26: (question, sql, reviewer) of a CSV file; rows without both are left out, of equal questions and statements the first stays, and a reviewer makes it reviewed."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    by = {c.strip().lower().lstrip("﻿"): c for c in raw.columns}
    if not {"question", "sql"} <= set(by):
        raise ValueError("a history needs the columns question and sql")
    text = lambda c: F.nullif(F.trim(F.col(f"`{by[c]}`")), F.lit("")) if c in by else F.lit(None).cast("string")
    rows = raw.select(text("question").alias("question"), text("sql").alias("sql"), text("reviewer").alias("reviewer"), F.monotonically_increasing_id().alias("place")).where("question is not null and sql is not null")
    first = rows.groupBy("question", "sql").agg(F.min("place").alias("place"), F.min_by("reviewer", F.when(F.col("reviewer").isNotNull(), F.col("place"))).alias("reviewer"))
    return first.select("question", "sql", "reviewer", F.col("reviewer").isNotNull().alias("reviewed"), "place")


def header_problems(names: list[str]) -> list[str]:
    """What keeps a header from naming every column: blanks, and names that differ only in case or blanks around them."""
    bare = [n.strip().lower() for n in names]
    return [f"column {i + 1} has no name" if not n else f"column {i + 1} repeats {n!r}" for i, n in enumerate(bare) if not n or n in bare[:i]]


def profile_csv(df: DataFrame) -> DataFrame:
    """S-28: (place, name, type, nulls) of text columns, in one aggregation of all rows: NUMBER if some value is filled and all such are finite numbers."""
    if problems := header_problems(df.columns):
        raise ValueError("; ".join(problems))

    def judged(place: int, name: str) -> Column:
        value = F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))
        number = value.try_cast("double")
        other = value.isNotNull() & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")))
        kind = F.when((F.count(value) > 0) & (F.count_if(other) == 0), "NUMBER").otherwise("TEXT")
        return F.struct(F.lit(place).alias("place"), F.lit(name.strip()).alias("name"), kind.alias("type"), F.count_if(value.isNull()).alias("nulls"))

    return df.agg(F.array(*(judged(i, n) for i, n in enumerate(df.columns))).alias("a")).select(F.inline("a"))


def report_ages(spark: SparkSession, root: str, days: int = 30, now: datetime | None = None) -> DataFrame:
    """N-17: (report, modified, verdict) of the HTML reports of a folder: `keep`, `expire` or, where a name isn't plain, `inspect`. Only names and times are read."""
    if days < 1:
        raise ValueError("a report is kept for a day at least")
    limit = (now or datetime.now(timezone.utc)).timestamp() - days * 86400
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(root).select("path", "modificationTime")
    report = F.url_decode(F.regexp_extract("path", r"([^/]+)\.html$", 1))
    old = F.unix_timestamp("modificationTime") <= F.lit(limit)
    verdict = F.when(~old, "keep").when(report.rlike(r"^\w[\w-]*$"), "expire").otherwise("inspect")
    return files.select(report.alias("report"), F.col("modificationTime").alias("modified"), verdict.alias("verdict"))


def retire_reports(spark: SparkSession, root: str, ages: DataFrame) -> list[str]:
    """N-17: moves what report_ages says has expired, with whatever else begins with the report's name and a dot, to `_retired/<day of the report>`; nothing is deleted. The names moved."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    moved = []
    for r in ages.where("verdict = 'expire'").orderBy("report").toLocalIterator():
        target = path(f"{root.rstrip('/')}/_retired/{r.modified:%Y-%m-%d}")
        fs.mkdirs(target)
        for s in fs.globStatus(path(f"{root.rstrip('/')}/{r.report}.*")):
            name = s.getPath().getName()
            if not fs.rename(s.getPath(), path(target, name)):
                raise OSError(f"{name} was not moved")
            moved.append(name)
    return moved


def period_order(df: DataFrame, label: str, position: str, series: list[str] | None = None) -> DataFrame:
    """D-16: rows whose ISO period label isn't after the one before it in the same series; none means a proper time axis."""
    known = F.col(label).rlike(r"^\d{4}(-(\d{2}(-\d{2})?|Q[1-4]|W\d{2}))?$")
    if series:
        return df.withColumn("previous", F.lag(label).over(Window.partitionBy(*series).orderBy(position))).where(~known | (F.col("previous") >= F.col(label)))
    return previous(df, position, label, "previous").where(~known | (F.col("previous") >= F.col(label)))


__all__ = ["data_version", "header_problems", "import_history", "period_order", "profile_csv", "report_ages", "retire_reports"]
