import json
import os

import pytest

from tessel.plans.executor import Budget, PlanError, Step, execute
from tessel.sources import readers
from tessel.sources.ingest import Rules
from tessel.sources.publish import PublishError, Store

HEAD = "Event ID,Anime Title,Watched At,Watch Seconds\n"
RULES = Rules(("event_id", "anime_title", "watched_at"), ("event_id",), "watched_at")


def csv(spark, path, body):
    path.write_text("﻿" + HEAD + body)
    return readers.read(spark, readers.Source("csv", path=str(path)))


def test_incremental_batches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = csv(spark, tmp_path / "a.csv", "1, Azure Voyager ,2024-01-01,10.5\n1,Duplicate,2024-01-02,11\n2,,2024-01-03,12\n3,Crimson Horizon,2024-01-04,13\n")
    assert store.ingest("watch", one, RULES) == {"staged": 4, "published": 2, "quarantined": 2, "watermark": "2024-01-04"}
    two = csv(spark, tmp_path / "b.csv", "1,Azure Voyager,2024-01-01,10.5\n3,Crimson Horizon,2024-01-04,13\n4,New,2024-01-05,14\n")
    assert store.ingest("watch", two, RULES) == {"staged": 1, "published": 1, "quarantined": 0, "watermark": "2024-01-05"}
    assert sorted(r.anime_title for r in store.read("watch").collect()) == ["Azure Voyager", "Crimson Horizon", "New"]
    assert {r["__reason"] for r in store.read("watch", "quarantine").collect()} == {"duplicate", "missing anime_title"}
    assert store.residue() == []


def test_failed_batch_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    one = csv(spark, tmp_path / "a.csv", "1,A,2024-01-01,1\n2,,2024-01-03,12\n")
    with pytest.raises(PublishError, match="invalid"):
        store.ingest("watch", one, Rules(("anime_title",), max_invalid=0.1))
    assert store.manifest() == {"assets": {}} and store.residue() == []
    with store.lock(), pytest.raises(PublishError, match="lock"):
        store.ingest("watch", one, RULES)


class Killed(BaseException):
    pass


class DyingFileSystem:
    """Works up to its n-th change, and then not at all: what a killed process leaves."""

    CHANGES = ("rename", "delete", "create", "createNewFile", "mkdirs")

    def __init__(self, fs, left):
        self.fs, self.left = fs, left

    def __getattr__(self, name):
        def call(*args):
            if self.left <= 0:
                raise Killed
            if name in self.CHANGES:
                self.left -= 1
                if self.left <= 0:
                    raise Killed
            return getattr(self.fs, name)(*args)

        return call


def test_killed_builds_leave_old_or_new(spark, tmp_path):
    root = str(tmp_path / "store")
    one = csv(spark, tmp_path / "a.csv", "1,A,2024-01-01,1\n2,,2024-01-03,12\n")
    two = csv(spark, tmp_path / "b.csv", "3,C,2024-01-05,1\n4,,2024-01-06,12\n")
    Store(spark, root).ingest("watch", one, RULES)
    old = Store(spark, root).manifest()
    outcomes, n = [], 0
    while True:
        n += 1
        killed = Store(spark, root, lease=-1)
        killed._fs = DyingFileSystem(killed._fs, n)
        try:
            killed.ingest("watch", two, RULES)
            break
        except Killed:
            pass
        store = Store(spark, root, lease=-1)  # the killed builder's lock counts as left behind
        seen = store.manifest()
        rows = sorted(r.event_id for r in store.read("watch").collect())
        assert rows == (["1"] if seen == old else ["1", "3"])
        outcomes.append(seen == old)
        if store.residue():
            with pytest.raises(PublishError, match="crashed"):
                store.ingest("watch", two, RULES)
            store.reconcile()
        assert store.residue() == [] == store.missing()
        if seen != old:  # back to the old one for the next round
            for v in store.versions()[1:]:
                store._fs.delete(store._at(f"manifest-{v:010d}.json"), False)
            store.reconcile()
    assert outcomes[0] and not outcomes[-1] and outcomes == sorted(outcomes, reverse=True)
    store = Store(spark, root, lease=-1)
    assert sorted(r.event_id for r in store.read("watch").collect()) == ["1", "3"]
    assert [(r.run, r.staged, r.published, r.quarantined, r.watermark_after) for r in store.lineage().orderBy("run").collect()] == [(0, 2, 1, 1, "2024-01-01"), (1, 2, 1, 1, "2024-01-05")]


def test_lock_of_a_killed_builder(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store._fs.mkdirs(store._at(""))
    store._write("_lock", "{}")
    with pytest.raises(PublishError, match="holds the lock"), store.lock():
        pass
    with Store(spark, store.root, lease=-1).lock():
        assert store.holder()["owner"]
    assert store.holder() is None


def test_damaged_manifest_falls_back(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.ingest("watch", csv(spark, tmp_path / "a.csv", "1,A,2024-01-01,1\n"), RULES)
    good = store.manifest()
    store._write("manifest-0000000002.json", '{"assets": {')
    assert store.manifest() == good
    with pytest.raises(PublishError, match="meanwhile"):
        store.commit(good)


def test_stream_replay_changes_nothing(spark, tmp_path):
    from tessel.streaming.windows import publish_stream

    spark.createDataFrame([("1", "a", "2024-01-01"), ("2", "b", "2024-01-02")], "event_id string, anime_title string, watched_at string").write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    for n in range(2):
        stream = spark.readStream.schema("event_id string, anime_title string, watched_at string").parquet(str(tmp_path / "in"))
        query = publish_stream(stream, store, "watch", Rules(("event_id",), ("event_id",))).option("checkpointLocation", str(tmp_path / f"check{n}")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert store.read("watch").count() == 2


def test_paged_api(spark):
    calls = []

    def get(url):
        calls.append(url)
        return json.dumps({"data": {"items": [{"a": 1}, {"a": 2}] if "page=1" in url else [{"a": 3}]}}).encode()

    df = readers.read_api(spark, readers.Source("api", url="http://x/y", records_path="data.items", page_param="page", page_size=2, max_pages=5), get)
    assert sorted(r.a for r in df.collect()) == [1, 2, 3] and len(calls) == 2


def test_source_rules():
    with pytest.raises(readers.SourceError):
        readers.Source("csv")
    with pytest.raises(readers.SourceError):
        readers.records({"a": 1}, "b")
    os.environ["TESSEL_X"] = "v"
    assert readers.expand("a/${TESSEL_X}") == "a/v"
    with pytest.raises(readers.SourceError):
        readers.expand("${TESSEL_MISSING}")
    assert readers.split_statements("-- one\nselect ';' as a;\n/* two */ select 2") == [("one", "select ';' as a"), ("two", "select 2")]


def test_executor():
    journal = {}
    steps = [Step("a", "one"), Step("b", "add", ("a",), (("n", 2),)), Step("c", "bad", ("a",)), Step("d", "add", ("c",), (("n", 1),))]
    actions = {"one": lambda: 1, "add": lambda x, n: x + n, "bad": lambda x: 1 / 0}
    run = execute(steps, actions, journal=journal)
    assert run.results["b"] == 3 and run.states == {"a": "done", "b": "done", "c": "failed", "d": "skipped"}
    assert execute(steps[:2], actions, journal=journal).states == {"a": "reused", "b": "reused"}
    assert execute(steps[:2], actions, journal=dict(journal), versions={"data": "2"}).states == {"a": "done", "b": "done"}
    with pytest.raises(PlanError, match="cycle"):
        execute([Step("a", "one", ("b",)), Step("b", "one", ("a",))], actions)
    with pytest.raises(PlanError, match="budget"):
        execute(steps[:2], actions, Budget(calls=1))
