"""Exact repeated word windows by Rabin-Karp hashes; repeated windows merge into maximal removal intervals.

Windows of candidate texts (see repeats) are hashed to 96 bits and dealt to buckets by hash as packed arrays. A window
repeated inside a batch, or in a text with copies, is known as repeated at once and sent once for the others to see,
so a hot window costs one entry a batch. A bucket answers with the positions of windows seen elsewhere. Windows go
to buckets by their seed, which equal windows share, so that a bucket answers for whole runs of a text and answers grow
with runs whatever the number of buckets; windows of very frequent seeds go by their own hash.

Defined cases: a null text has no words; texts shorter than a window keep all words; equal rows (ties) count as other
places, so both lose their windows; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Rolling, Rows, as_bytes, mix, slices
from tessel.llm.repeats import NO_RUNS, Runs, candidates, intervals, keyed, least_grams, runs_of

GRAM = 8
#: Runs of a bucket: some 300,000 windows, 8 MB.
RUNS = 20_000
MESSAGE = "bucket int, high binary, low binary, doc binary, at binary, keys binary"
REPLY = "k1 long, k2 long, at binary"
RESULT = "k1 long, k2 long, n_removed long, kept_sha256 string, spans array<long>"
BASE = "doc_id long, k1 long, k2 long, n_words long, all_sha256 string"


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def word_runs(hashes: np.ndarray, window: int, rolling: Rolling) -> Runs:
    gram = min(GRAM, window)
    return runs_of(*least_grams(rolling.windows(hashes, gram), window - gram + 1)) if len(hashes) >= window else NO_RUNS


def seeder(window: int) -> Callable[[bytes], Runs]:
    rolling = Rolling()
    return lambda text: word_runs(word_hashes(text.split()), window, rolling)


def _pack(order: np.ndarray, high: np.ndarray, low: np.ndarray, doc: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[bytes, ...]:
    used, local = np.unique(doc[order], return_inverse=True)
    return high[order].tobytes(), low[order].tobytes(), local.astype(np.uint32).tobytes(), at[order].astype(np.uint32).tobytes(), keys[used].tobytes()


def send(window: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = Rolling(), Rolling(0xC2B2AE3D27D4EB4F)
        rows = Rows(MESSAGE)
        for part in slices(batches, 2000):
            if part.num_rows:
                keys = np.stack([part.column(0).to_numpy(), part.column(1).to_numpy()], 1)
                copies, runs, wide = part.column(3).to_numpy(), part.column(4).to_pylist(), part.column(5).to_pylist()
                high, low, doc, pos, route = [], [], [], [], []
                for i, text in enumerate(as_bytes(part.column(2))):
                    h = word_hashes(text.split())
                    seeds, first, last = word_runs(h, window, one)
                    picked = np.zeros(len(h) - window + 2, np.int64)
                    which = np.array(runs[i])
                    np.add.at(picked, first[which], 1)
                    np.add.at(picked, last[which], -1)
                    p = np.nonzero(np.cumsum(picked)[:-1])[0]
                    high.append(one.windows(h, window)[p])
                    low.append((two.windows(mix(h), window)[p] >> np.uint64(32)).astype(np.uint32))
                    doc.append(np.full(len(p), i, np.int64))
                    pos.append(p)
                    run_of, own_hash = np.searchsorted(first, p, "right") - 1, np.zeros(len(first), bool)
                    own_hash[np.array(wide[i], np.int64)] = True
                    route.append(np.where(own_hash[run_of], high[-1], mix(seeds[run_of])))
                high, low, doc, pos, route = map(np.concatenate, (high, low, doc, pos, route))
                order = np.lexsort((low, high))
                high, low, doc, pos, route = high[order], low[order], doc[order], pos[order], route[order]
                new = np.ones(len(high), bool)
                new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
                group = np.cumsum(new) - 1
                known = (np.bincount(group) > 1) | (np.bincount(group, copies[doc] > 1) > 0)
                settled = known[group]
                for n, own in enumerate(np.array_split(np.nonzero(settled)[0], max(1, int(settled.sum()) // 500_000))):
                    if len(own):  # a negative bucket is an answer already
                        rows.add(-1 - int(keys[0, 0] + n) % buckets, *_pack(own, high, low, doc, pos, keys))
                sent = np.nonzero(new)[0]
                at_sent = np.where(settled[sent], 0xFFFFFFFF, pos[sent])  # no answer is wanted for what is settled
                bucket = (route[sent] >> np.uint64(20)) % np.uint64(buckets)
                by = np.argsort(bucket, kind="stable")
                for own in np.split(by, np.nonzero(np.diff(bucket[by]))[0] + 1):
                    if len(own) and rows.add(int(bucket[own[0]]), *_pack(own, high[sent], low[sent], doc[sent], at_sent, keys), weight=24 * len(own)):
                        yield from rows.take()
        yield from rows.take()

    return run


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; one bucket is held at a time."""
    rows, held, now = Rows(REPLY), [], None

    def replies(keys: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.argsort(doc, kind="stable")
        for own in np.split(order, np.nonzero(np.diff(doc[order]))[0] + 1):
            if len(own):
                k1, k2 = keys[doc[own[0]]].tolist()
                if rows.add(k1, k2, at[own].tobytes(), weight=4 * len(own)):
                    yield from rows.take()

    def close() -> Iterator[pa.RecordBatch]:
        high, low = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
        shift = np.cumsum([0, *(len(x[4]) for x in held[:-1])])
        doc, at, keys = np.concatenate([x[2] + s for x, s in zip(held, shift)]), np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
        order = np.lexsort((low, high))
        same = (high[order[1:]] == high[order[:-1]]) & (low[order[1:]] == low[order[:-1]])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        own = order[twice]
        own = own[at[own] != 0xFFFFFFFF]
        yield from replies(keys, doc[own], at[own])

    for b in batches:
        for bucket, high, low, doc, at, keys in zip(*(c.to_pylist() for c in b.columns)):
            item = (np.frombuffer(high, np.uint64), np.frombuffer(low, np.uint32), np.frombuffer(doc, np.uint32).astype(np.int64), np.frombuffer(at, np.uint32), np.frombuffer(keys, np.int64).reshape(-1, 2))
            if bucket < 0:
                yield from replies(item[4], item[2], item[3])
                continue
            if bucket != now and held:
                yield from close()
                held = []
            now = bucket
            held.append(item)
    if held:
        yield from close()
    yield from rows.take()


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for every row: spans are removed word intervals, flat [from, to, from, to ...]."""
    spark = docs.sparkSession
    d = keyed(docs)
    work = candidates(d.select("k1", "k2", "text"), lambda: seeder(window))
    # a bucket is held whole: it gets about RUNS runs of windows, however many there are
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(work.agg(F.sum(F.size("runs"))).first()[0] or 0) // RUNS))
    sent = work.select("k1", "k2", "text", "copies", "runs", "wide").mapInArrow(send(window, buckets), MESSAGE)
    replies = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, REPLY)
    places = replies.groupBy("k1", "k2").agg(F.collect_list("at").alias("at"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(RESULT)
        for b in slices(batches):
            for k1, k2, text, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist()):
                words = text.split()
                begin, end = intervals(np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in at])).astype(np.int64), window)
                keep, kept = 0, []
                for a, e in zip(begin.tolist(), end.tolist()):
                    kept += words[keep:a]
                    keep = e
                kept += words[keep:]
                if rows.add(k1, k2, len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), np.stack([begin, end], 1).ravel()):
                    yield from rows.take()
        yield from rows.take()

    changed = work.select("k1", "k2", "text").join(places, ["k1", "k2"]).select("k1", "k2", "text", "at").mapInArrow(render, RESULT)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(BASE)
        for b in slices(batches):
            for doc, k1, k2, text in zip(*(c.to_pylist() for c in b.columns[:3]), as_bytes(b.column(3))):
                words = text.split()
                if rows.add(doc, k1, k2, len(words), hashlib.sha256(b" ".join(words)).hexdigest()):
                    yield from rows.take()
        yield from rows.take()

    base = d.mapInArrow(whole, BASE)
    return base.join(changed, ["k1", "k2"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))
