"""Source dispatch and scans."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession


class SourceError(ValueError):
    """A source that can't be read as declared."""


@dataclass(frozen=True)
class Source:
    """S-07: path for files, url for an API, where paging is allowed."""

    type: str
    path: str | None = None
    url: str | None = None
    records_path: str | None = None
    page_param: str | None = None
    page_size: int = 100
    max_pages: int = 1
    options: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        if self.type == "api":
            if not self.url or self.path:
                raise SourceError("an api source needs a url and no path")
        elif self.type in ("csv", "parquet", "json", "orc", "jdbc"):
            if self.page_param:
                raise SourceError("paging is for api sources only")
            if self.type != "jdbc" and not self.path:
                raise SourceError(f"a {self.type} source needs a path")
        else:
            raise SourceError(f"unknown source type {self.type}")


def expand(text: str) -> str:
    """S-06: ${NAME} from the environment; a missing one is an error."""

    def value(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise SourceError(f"environment variable {m[1]} is not set")
        return os.environ[m[1]]

    return re.sub(r"\$\{(\w+)\}", value, text)


def records(document: object, path: str | None) -> list[dict]:
    """S-05: the array of objects at a dotted path."""
    for part in path.split(".") if path else ():
        if not isinstance(document, dict) or part not in document:
            raise SourceError(f"no {part} in the document")
        document = document[part]
    if not isinstance(document, list) or not all(isinstance(x, dict) for x in document):
        raise SourceError("an array of objects is expected")
    return document


def _get(url: str) -> bytes:
    with urlopen(url, timeout=30) as r:  # noqa: S310
        return r.read()


def read_api(spark: SparkSession, source: Source, get: Callable[[str], bytes] = _get) -> DataFrame:
    """S-04: pages 1 .. max_pages until one is short; rows keep their JSON until columns are typed by Spark. One page is on the driver at a time; pages lie in the store."""
    folder = new_folder(spark, "api")
    for page in range(1, source.max_pages + 1):
        url = expand(source.url)
        if source.page_param:
            url += ("&" if "?" in url else "?") + f"{source.page_param}={page}"
        got = records(json.loads(get(url)), source.records_path)
        if got:
            spark.createDataFrame([(json.dumps(r, sort_keys=True),) for r in got], "value string").coalesce(1).write.mode("append").text(folder)
        elif page == 1:
            return spark.createDataFrame([], "value string")
        if not source.page_param or len(got) < source.page_size:
            break
    return spark.read.json(folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a temporary one only where Spark is local."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise SourceError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="tessel-")
    return f"{shared.rstrip('/')}/tessel-{name}-{uuid.uuid4().hex}"


#: Schemes and suffixes of addresses, and the backend behind them.
BACKENDS = {"sqlite": "sqlite", "duckdb": "duckdb", "postgres": "postgresql", "postgresql": "postgresql"}
SUFFIXES = {".sqlite": "sqlite", ".sqlite3": "sqlite", ".db": "sqlite", ".duckdb": "duckdb", ".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def route(address: str) -> str:
    """S-11: the backend of an address: by the scheme of its URL, else by its suffix, else by a marker file `_backend` in the folder that it names."""
    if m := re.match(r"(?:jdbc:)?([a-z0-9]+):", address, re.I):
        if m[1].lower() in BACKENDS:
            return BACKENDS[m[1].lower()]
    for suffix, backend in SUFFIXES.items():
        if address.lower().endswith(suffix):
            return backend
    marker = os.path.join(address, "_backend")
    if os.path.isfile(marker):
        with open(marker, encoding="utf-8") as f:
            name = f.read().strip()
        if name in {*BACKENDS.values(), *SUFFIXES.values()}:
            return name
    raise SourceError(f"no backend for {address}")


#: What keeps a connection from writing, by backend; two threads and 512 MB for an embedded engine.
READ_ONLY = {
    "sqlite": {"open_mode": "1", "query_only": "true"},
    "duckdb": {"duckdb.read_only": "true", "enable_external_access": "false", "threads": "2", "memory_limit": "512MB"},
    "postgresql": {"readOnly": "true", "options": "-c default_transaction_read_only=on", "defaultRowFetchSize": "10000"},
}


def jdbc_options(address: str, options: dict[str, str], superuser: Callable[[], bool] | None = None) -> dict[str, str]:
    """S-08 to S-10: options of a read-only scan. A PostgreSQL superuser is refused, as read-only settings don't bind it; a scan in parts needs its column and both bounds."""
    backend = route(address)
    if backend not in READ_ONLY:
        raise SourceError(f"{backend} is no database")
    if backend == "postgresql" and superuser is not None and superuser():
        raise SourceError("a superuser isn't bound by read-only settings")
    if any(k in options for k in ("query", "dbtable")) and re.search(r"\b(insert|update|delete|drop|alter|create|copy|attach)\b", options.get("query", ""), re.I):
        raise SourceError("a scan only reads")
    parts = [k for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions") if k in options]
    if parts and len(parts) < 4:
        raise SourceError("a scan in parts needs partitionColumn, lowerBound, upperBound and numPartitions")
    url = address if address.startswith("jdbc:") else f"jdbc:{backend}:{address.split('://', 1)[-1] if backend != 'postgresql' else '//' + address.split('://', 1)[-1]}"
    return {"url": url, "fetchsize": "10000"} | READ_ONLY[backend] | options


def read(spark: SparkSession, source: Source) -> DataFrame:
    """S-01 to S-03, S-08 to S-11. CSV values stay text; a byte-order mark is dropped from the first name. Values of several lines are for files that say so (option multiLine), as such a file is one task."""
    if source.type == "api":
        return read_api(spark, source)
    own = dict(source.options)
    if source.type == "jdbc":
        return spark.read.format("jdbc").options(**jdbc_options(own.pop("url", source.path or ""), own)).load()
    path = expand(source.path)
    if source.type == "csv":
        df = spark.read.csv(path, header=True, inferSchema=False, multiLine=own.get("multiLine", "false").lower() == "true", escape='"')
        return df.toDF(*(c.removeprefix("﻿") for c in df.columns))
    return spark.read.format(source.type).options(**own).load(path)


def split_statements(text: str) -> list[tuple[str, str]]:
    """S-27: (comment, statement) pairs of a .sql file; semicolons inside quotes or comments don't end a statement."""
    out, comment, statement = [], [], []
    for m in re.finditer(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"[^\"]*\"|;|[^;'\"/-]+|[-/]", text, re.S):
        t = m[0]
        if t.startswith(("--", "/*")):
            if not "".join(statement).strip():
                comment.append(t.strip("-/* \n"))
            continue
        if t == ";":
            if s := "".join(statement).strip():
                out.append((" ".join(comment), s))
            comment, statement = [], []
        else:
            statement.append(t)
    if s := "".join(statement).strip():
        out.append((" ".join(comment), s))
    return out
