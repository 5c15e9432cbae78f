"""All-or-nothing publication: versioned folders, and manifests that are never changed.

A batch writes new folders, then a new version of the manifest is renamed into place: one rename to a name that wasn't there, so
before it readers see the old version and after it the new one, and two builders can't publish the same version. A crash leaves at most folders without
an entry and an unread file; `residue` lists them, and the next build is refused until `reconcile` took them away. Files go
through Spark and Hadoop's file system, so any store with an atomic rename will do.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import socket
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.sources.ingest import ORDINAL, REASON, Rules, advance, after_watermark, judge_rows, normalise, with_ordinal

VERSION = re.compile(r"manifest-(\d{10})\.json")
LINEAGE = "asset string, run long, folder string, staged long, published long, quarantined long, watermark_before string, watermark_after string"


class PublishError(RuntimeError):
    """The batch was not published; nothing changed."""


class Store:
    """lease: seconds after which a lock counts as left behind by a builder that was killed; longer than any build."""

    def __init__(self, spark: SparkSession, root: str, lease: float = 6 * 3600, keep: int = 20) -> None:
        self.spark, self.root, self.lease, self.kept = spark, root.rstrip("/"), lease, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):  # noqa: ANN202
        return self._path(f"{self.root}/{name}")

    def _names(self) -> list[tuple[str, bool]]:
        """(name, is a folder) of what is in the root."""
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted((s.getPath().getName(), s.isDirectory()) for s in self._fs.listStatus(self._path(self.root)))

    def _write(self, name: str, text: str) -> None:
        out = self._fs.create(self._at(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def holder(self) -> dict | None:
        """Who holds the lock, and since when; an unreadable one has the time of its file."""
        if not self._fs.exists(self._at("_lock")):
            return None
        since = self._fs.getFileStatus(self._at("_lock")).getModificationTime() / 1000
        try:
            return {"since": since} | json.loads(self._text("_lock") or "{}")
        except ValueError:
            return {"since": since}

    @contextmanager
    def lock(self):  # noqa: ANN201
        """N-11: one builder at a time; a second one fails at once. A lock older than the lease is taken over: who renames it away goes on."""
        self._fs.mkdirs(self._path(self.root))
        mine = {"owner": f"{socket.gethostname()}:{os.getpid()}:{uuid.uuid4().hex}", "since": time.time()}
        held = self.holder()
        if held and time.time() - held["since"] > self.lease:
            gone = f"_lock-{uuid.uuid4().hex}"
            if self._fs.rename(self._at("_lock"), self._at(gone)):
                self._fs.delete(self._at(gone), False)
        if not self._fs.createNewFile(self._at("_lock")):
            raise PublishError(f"another build holds the lock: {self.holder()}")
        self._write("_lock", json.dumps(mine))
        try:
            yield
        finally:
            if (self.holder() or {}).get("owner") == mine["owner"]:
                self._fs.delete(self._at("_lock"), False)

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n, _ in self._names() if (m := VERSION.fullmatch(n)))

    def manifest(self) -> dict:
        """The newest manifest whose checksum holds."""
        for v in reversed(self.versions()):
            try:
                found = json.loads(self._text(f"manifest-{v:010d}.json"))
                if found.pop("checksum") == _checksum(found):
                    return found
            except (ValueError, KeyError):
                continue
        return {"assets": {}}

    def commit(self, manifest: dict) -> int:
        """Publishes the next version; a builder that lost its lock meets the other's version and fails."""
        version = max(self.versions(), default=0) + 1
        if manifest.get("version", 0) + 1 != version:
            raise PublishError(f"version {version - 1} was published meanwhile")
        manifest = manifest | {"version": version}
        name = f"manifest-{version:010d}.json"
        self._write("_manifest.new", json.dumps(manifest | {"checksum": _checksum(manifest)}, sort_keys=True))
        if self._fs.exists(self._at(name)) or not self._fs.rename(self._at("_manifest.new"), self._at(name)):
            raise PublishError(f"version {version} was published meanwhile")
        for old in self.versions()[: -self.kept]:
            self._fs.delete(self._at(f"manifest-{old:010d}.json"), False)
        return version

    def read(self, asset: str, part: str = "folders") -> DataFrame | None:
        a = self.manifest()["assets"].get(asset)
        return self.spark.read.parquet(*(f"{self.root}/{f}" for f in a[part])) if a and a.get(part) else None

    def lineage(self) -> DataFrame:
        """N-12: a row for every run that was published: its folder, counts and watermarks."""
        rows = [(asset, *run) for asset, a in self.manifest()["assets"].items() for run in a["lineage"]]
        return self.spark.createDataFrame(rows, LINEAGE)

    def residue(self) -> list[str]:
        """N-10: folders that no manifest entry names, and a manifest that wasn't published."""
        known = {f for a in self.manifest()["assets"].values() for f in (*a["folders"], *a["quarantine"])}
        return [n for n, folder in self._names() if (folder and n not in known) or n == "_manifest.new"]

    def missing(self) -> list[str]:
        """N-10: folders that the manifest names and that aren't there; nothing can mend that but a replacement of the asset."""
        there = {n for n, folder in self._names() if folder}
        return sorted(f for a in self.manifest()["assets"].values() for f in (*a["folders"], *a["quarantine"]) if f not in there)

    def reconcile(self) -> list[str]:
        """Takes away what crashed builds left. Needs the lock, so no running build loses its folders."""
        with self.lock():
            left = self.residue()
            for n in left:
                self._fs.delete(self._at(n), True)
            return left

    def ingest(self, asset: str, batch: DataFrame, rules: Rules, mode: str = "append") -> dict:
        """One batch: watermark, normalise, judge, ratio gate, publish, advance. The counts of the run. A failure takes its own folders away."""
        with self.lock():
            if left := self.residue():
                raise PublishError(f"a crashed build left {left}; reconcile first")
            if lost := self.missing():
                raise PublishError(f"published folders are missing: {lost}")
            manifest = self.manifest()
            entry = manifest["assets"].get(asset, {"folders": [], "quarantine": [], "watermark": None, "columns": None, "runs": 0, "lineage": []})
            d = normalise(batch)
            if mode == "append" and entry["columns"] and d.columns != entry["columns"]:
                raise PublishError(f"columns differ: {d.columns} and {entry['columns']}")
            d = with_ordinal(d)
            if rules.watermark:
                d = after_watermark(d, rules.watermark, entry["watermark"])
            name = f"{asset}-{entry['runs']:06d}-{uuid.uuid4().hex[:8]}"
            own = [f"{name}-staged", name, f"{name}-quarantine"]
            try:
                counts, entry = self._build(d, rules, entry, name, mode)
                self.commit(manifest | {"assets": manifest["assets"] | {asset: entry}})
                own = own[:1]
            finally:
                for n in own:
                    self._fs.delete(self._at(n), True)
            return counts | {"watermark": entry["watermark"]}

    def _build(self, d: DataFrame, rules: Rules, entry: dict, name: str, mode: str) -> tuple[dict, dict]:
        published = self.spark.read.parquet(*(f"{self.root}/{f}" for f in entry["folders"])) if mode == "append" and entry["folders"] else None
        judge_rows(d, rules, published).write.parquet(f"{self.root}/{name}-staged")
        staged = self.spark.read.parquet(f"{self.root}/{name}-staged")
        good = staged.where(F.col(REASON).isNull())
        counts = staged.agg(F.count("*").alias("staged"), F.count_if(F.col(REASON).isNull()).alias("published"), F.count_if(F.col(REASON).isNotNull()).alias("quarantined")).first().asDict()
        if counts["staged"] and counts["quarantined"] / counts["staged"] > rules.max_invalid:
            raise PublishError(f"{counts['quarantined']} of {counts['staged']} rows are invalid")
        columns = [c for c in d.columns if c != ORDINAL]
        if counts["published"]:
            good.select(*columns).write.parquet(f"{self.root}/{name}")
        if counts["quarantined"]:
            staged.where(F.col(REASON).isNotNull()).write.parquet(f"{self.root}/{name}-quarantine")
        mark = advance(good, rules.watermark, entry["watermark"]) if rules.watermark and counts["published"] else entry["watermark"]
        return counts, {
            "folders": (entry["folders"] if mode == "append" else []) + [name] * bool(counts["published"]),
            "quarantine": entry["quarantine"] + [f"{name}-quarantine"] * bool(counts["quarantined"]),
            "watermark": mark, "columns": columns, "runs": entry["runs"] + 1,
            "lineage": [*entry["lineage"], [entry["runs"], name if counts["published"] else None, counts["staged"], counts["published"], counts["quarantined"], entry["watermark"], mark]],
        }


def _checksum(manifest: dict) -> str:
    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
