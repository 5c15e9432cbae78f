"""Charts, reports and their manifest as files: bounded rows from the driver, through Hadoop's file system."""

from __future__ import annotations

import hashlib
import html
import json
import re

from pyspark.sql import SparkSession

#: Rows of a chart or a report; more are no picture.
MOST_ROWS = 1000


def field_names(columns: list[str]) -> dict[str, str]:
    """F-13: names that a chart's field syntax can't misread: letters, digits and underscores, later doubles numbered."""
    out: dict[str, str] = {}
    for c in columns:
        base = re.sub(r"\W", "_", c) or "field"
        name, n = base, 2
        while name in out.values():
            name, n = f"{base}_{n}", n + 1
        out[c] = name
    return out


def chart_file(chosen: dict, rows: list[dict]) -> dict:
    """A Vega-Lite document of a choice of analysis.chart and its rows; tables and single values have no mark."""
    marks = {"line": "line", "bar": "bar", "pie": "arc"}
    if chosen["chart"] not in marks:
        raise ValueError(f"a {chosen['chart']} is no chart")
    names = field_names([chosen["x"], chosen["y"]])
    x, y = names[chosen["x"]], names[chosen["y"]]
    axes = {"theta": {"field": y, "type": "quantitative"}, "color": {"field": x, "type": "nominal"}} if chosen["chart"] == "pie" else {"x": {"field": x, "type": "ordinal", "title": chosen["x"]}, "y": {"field": y, "type": "quantitative", "title": chosen["y"]}}
    return {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "description": chosen["reason"], "mark": marks[chosen["chart"]], "data": {"values": [{x: r[chosen["x"]], y: r[chosen["y"]]} for r in rows[:MOST_ROWS]]}, "encoding": axes}


def report_file(title: str, columns: list[str], rows: list[dict], findings: list[str]) -> str:
    """An HTML page without scripts; everything that comes from data is escaped."""
    cell = lambda v: f"<td>{html.escape('' if v is None else str(v))}</td>"
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join(f"<tr>{''.join(cell(r.get(c)) for c in columns)}</tr>" for r in rows[:MOST_ROWS])
    notes = "".join(f"<li>{html.escape(f)}</li>" for f in findings)
    cut = f"<p>{len(rows) - MOST_ROWS} more rows aren't shown.</p>" if len(rows) > MOST_ROWS else ""
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul>{notes}</ul><table><tr>{head}</tr>{body}</table>{cut}"


def write_artefacts(spark: SparkSession, folder: str, run: str, files: dict[str, str]) -> dict:
    """Writes <run>.<name> for each file and then <run>.manifest.json with sizes and SHA-256; a run without a manifest isn't complete. The manifest."""
    if not re.fullmatch(r"\w[\w-]*", run):
        raise ValueError(f"{run!r} is no plain name")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(name: str, data: bytes) -> None:
        out = fs.create(path(f"{folder.rstrip('/')}/{name}"), True)
        out.write(bytearray(data))
        out.close()

    entries = []
    for name, text in sorted(files.items()):
        data = text.encode()
        put(f"{run}.{name}", data)
        entries.append({"name": f"{run}.{name}", "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()})
    manifest = {"run": run, "files": entries}
    put(f"{run}.manifest.json", json.dumps(manifest, sort_keys=True).encode())
    return manifest
