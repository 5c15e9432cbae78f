"""Exact repeated byte strings by suffix arrays built in two stages.

A text is cut into runs of windows with the same seed (the least gram of each half of the window, see repeats), each with a hash
of its bytes, and runs are grouped by seed, so all places of a repeated string lie in one group. Where all runs of a seed are equal, by
seed and hash (128 bits), all their windows repeat and no bytes move. The other groups get the bytes of each different run once, as
a snippet with a count, and a block of groups gets a suffix array: suffixes smaller than their successor (type B) are sorted directly,
the others (type A) are induced by scanning the buckets of first bytes upwards, then adjacent common prefixes of at
least the window's length show the repeats. Groups of over HOT snippets are split by finer seeds first.

Defined cases: a null text is empty; a text shorter than the window keeps all bytes; equal rows (ties) count as other
places, so both are removed; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Rolling, Rows, as_bytes, mix, slices, stage
from tessel.llm.repeats import NO_RUNS, Runs, keyed, least_grams, runs_of

RUNS = "k1 long, k2 long, seeds array<long>, ids array<long>, low array<int>, high array<int>"
SNIPPET = "seed long, id long, body binary, span int, copies long"
FOUND = "seed long, id long, first array<int>, last array<int>"
RESULT = "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, spans array<long>"
#: Seeds of more snippets are split by finer seeds: least grams of eight parts of a window, then whole windows.
HOT = 2000
FINER = (8, 0)


def seeder(window: int, parts: int = 2) -> Callable[[bytes], Runs]:
    """Runs of windows by the least grams of so many parts of a window; with no parts, by the whole window."""
    size = window // parts if parts else window
    gram = max(1, min(32, size // 2)) if parts else window
    rolling, table = Rolling(), mix(np.arange(1, 257, dtype=np.uint64))
    offsets = [i * (window - size) // (parts - 1) for i in range(parts)] if parts else [0]

    def seeds(text: bytes) -> Runs:
        if len(text) < window:
            return NO_RUNS
        m, changes = least_grams(rolling.windows(table[np.frombuffer(text, np.uint8)], gram), size - gram + 1)
        n = len(text) - window + 1
        seed, new = m[:n], changes[:n].copy()
        with np.errstate(over="ignore"):
            for at in offsets[1:]:
                seed = seed * np.uint64(0x9E3779B97F4A7C15) + m[at : at + n]
                new |= changes[at : at + n]
        new[0] = True
        return runs_of(mix(seed), new)

    return seeds


def cut_runs(texts: DataFrame, window: int, parts: int) -> DataFrame:
    """Staged RUNS of texts(k1, k2, text, copies): a row for a text, two for one with copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seeds, rows, seen = seeder(window, parts), Rows(RUNS), {}
        for b in slices(batches):
            for k1, k2, text, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist()):
                if (n := seen.get((k1, k2), 0)) >= 2 or len(text) < window:  # two rows of a text already show that all of it is repeated
                    continue
                seen[k1, k2] = n + copies
                seed, first, last = seeds(text)
                ids = np.fromiter((xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(first.tolist(), (last + (window - 1)).tolist())), np.uint64, len(seed))
                for _ in range(min(2 - n, copies)):
                    if rows.add(k1, k2, seed.view(np.int64), ids.view(np.int64), first.astype(np.int32), last.astype(np.int32), weight=24 * len(seed)):
                        yield from rows.take()
        yield from rows.take()

    return stage(texts.select("k1", "k2", "text", "copies").mapInArrow(run, RUNS), "runs")


def repeated_runs(runs: DataFrame) -> DataFrame:
    """Staged (seed, k1, k2, id, low, high, single) of runs whose seed is found again; single: all runs of the seed are equal."""
    groups = runs.select(F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("ids").alias("id")))).groupBy("seed").agg(F.count("*").alias("n"), (F.min("id") == F.max("id")).alias("single"))
    # staged, so that the join has a shuffle on either side and skewed seeds can be split
    groups = stage(groups.where("n > 1").drop("n"), "groups")
    every = runs.select("k1", "k2", F.inline(F.arrays_zip(F.col("seeds").alias("seed"), F.col("ids").alias("id"), "low", "high")))
    return stage(every.join(groups, "seed"), "repeated")


def sort_directly(text: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """positions in the order of their suffixes' first `depth` bytes: by eight bytes, then ties by all, in slabs of bounded memory."""
    wide = np.lib.stride_tricks.sliding_window_view(text, 8)
    key = np.ascontiguousarray(wide[positions]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(key, kind="stable")
    positions, key = positions[order], key[order]
    first = np.concatenate(([True], key[1:] != key[:-1], [True]))
    tied = ~(first[:-1] & first[1:])
    at = np.nonzero(tied)[0]
    if not len(at):
        return positions
    begins = at[first[:-1][at]]  # of each tie
    whole = np.lib.stride_tricks.sliding_window_view(text, depth)
    cuts = np.searchsorted(at, begins)
    i = 0
    while i < len(cuts):
        j = i + 1
        while j < len(cuts) and cuts[j] - cuts[i] < 50_000:
            j += 1
        own = at[cuts[i] : cuts[j] if j < len(cuts) else len(at)]
        rows = np.ascontiguousarray(whole[positions[own]]).view(f"S{depth}").ravel()
        positions[own] = positions[own][np.argsort(rows, kind="stable")]
        i = j
    return positions


def suffix_array(text: np.ndarray, wanted: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Wanted positions in suffix order, right to `depth` bytes.

    text: symbols with 0 as padding after every string (at ends) and real bytes as themselves; `wanted` marks positions
    to be sorted, closed under "the next position, up to the next type B or the string's end".
    """
    symbols = text.astype(np.int16) + 1
    is_end = np.zeros(len(text) + 1, bool)
    is_end[ends] = True
    symbols[ends] = 0
    step = np.sign(np.diff(symbols, append=np.int16(0))).astype(np.int8)
    following = np.where(step != 0, np.arange(len(step), dtype=np.int32), np.int32(len(step) - 1))
    step = step[np.minimum.accumulate(following[::-1])[::-1]]  # equal neighbours take the type of what comes next
    is_b, is_a = step > 0, step < 0
    b = sort_directly(text, np.nonzero(wanted & is_b)[0], depth)
    b_begin = np.searchsorted(symbols[b], np.arange(258))
    pending: list[list[np.ndarray]] = [[] for _ in range(258)]
    out = []

    def induce(from_: np.ndarray, symbol: int) -> np.ndarray:
        """Files the type-A predecessors under their symbol, in order; returns those of the same symbol."""
        before = from_ - 1
        before = before[(before >= 0) & wanted[before] & is_a[before] & ~is_end[before]]
        s = symbols[before]
        for c in np.unique(s[s != symbol]):
            pending[c].append(before[s == c])
        return before[s == symbol]

    induce(ends, 0)
    for c in range(1, 257):
        layers = []
        layer = np.concatenate(pending[c]) if pending[c] else np.empty(0, np.int64)
        while len(layer):  # longer runs of one byte come later
            layers.append(layer)
            layer = induce(layer, c)
        own = b[b_begin[c] : b_begin[c + 1]]
        if len(own):
            induce(own, c)
        out += [*layers, own]
    return np.concatenate(out) if out else np.empty(0, np.int64)


def repeated(bodies: list[bytes], spans: list[int], copies: list[int], window: int) -> list[np.ndarray]:
    """For each snippet, the window starts below its span that occur elsewhere in these snippets or in its copies."""
    sizes = np.array([len(b) for b in bodies])
    pad = bytes(window + 8)
    text = np.frombuffer(pad.join(bodies) + pad, np.uint8)
    begin = np.concatenate(([0], np.cumsum(sizes + len(pad))[:-1]))
    ends, spans_ = begin + sizes, np.array(spans)
    owner = np.repeat(np.arange(len(bodies), dtype=np.int32), sizes + len(pad))
    offset = np.arange(len(text), dtype=np.int32) - begin.astype(np.int32)[owner]
    start = offset < spans_[owner]
    # on from the last start, up to the next type B
    inside = offset < sizes[owner]
    up = np.zeros(len(text), bool)
    up[:-1] = (text[1:] > text[:-1]) & inside[1:]
    ups = np.append(np.nonzero(up)[0], len(text))
    stop = np.minimum(ups[np.searchsorted(ups, begin + spans_ - 1)], ends - 1)
    wanted = inside & (offset <= (stop - begin).astype(np.int32)[owner])
    order = suffix_array(text, wanted, ends, window)
    order = order[start[order]]
    rows = np.lib.stride_tricks.sliding_window_view(text, window)
    same = np.zeros(len(order) + 1, bool)
    for at in range(0, len(order) - 1, 20_000):
        here, there = order[at : at + 20_000], order[at + 1 : at + 20_001]
        here = here[: len(there)]
        differ = rows[here] != rows[there]
        common = np.where(differ.any(1), differ.argmax(1), window)  # adjacent common prefix, as far as the window
        same[at + 1 : at + 1 + len(there)] = common >= window
    counts = np.array(copies)
    hit = same[:-1] | same[1:] | (counts[owner[order]] > 1)
    group = np.cumsum(~same[:-1]) - 1
    any_hit = np.bincount(group, hit, minlength=int(group[-1]) + 1 if len(group) else 0) > 0
    found = np.sort(order[any_hit[group]]) if len(order) else order
    return [x - b for x, b in zip(np.split(found, np.searchsorted(found, begin[1:])), begin)]


def settle(window: int, block: int = 60_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Snippets come sorted by seed. Groups gather to a block of so many window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, now, size = Rows(FOUND), [], None, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                seeds, ids, bodies, spans, copies = zip(*held)
                for x, y, hits in zip(seeds, ids, repeated(list(bodies), list(spans), list(copies), window)):
                    if len(hits) and rows.add(x, y, *stretches(hits)):
                        yield from rows.take()
            held, size = [], 0

        for batch in slices(batches):
            for snippet in zip(*(c.to_pylist() for c in batch.columns)):
                if snippet[0] != now and size >= block:
                    yield from flush()
                now, size = snippet[0], size + snippet[3]
                held.append(snippet)
        yield from flush()
        yield from rows.take()

    return run


def stretches(hits: np.ndarray) -> tuple[list[int], list[int]]:
    """[from, to) of the stretches of consecutive numbers in sorted ones."""
    gap = np.nonzero(np.diff(hits) != 1)[0]
    return [int(hits[0]), *hits[gap + 1].tolist()], [*(hits[gap] + 1).tolist(), int(hits[-1]) + 1]


def lists(column: pa.Array) -> list[np.ndarray]:
    """The numbers of each list of a column, as arrays."""
    values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [values[s:e] for s, e in zip(at, at[1:])]


def merged(places: DataFrame) -> DataFrame:
    """FOUND of (k1, k2, low, high), with overlapping and touching intervals merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(FOUND)
        for b in slices(batches):
            for seed, x, low, high in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), lists(b.column(2)), lists(b.column(3))):
                if rows.add(seed, x, *union(low, high)):
                    yield from rows.take()
        yield from rows.take()

    lists_ = places.groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("p"))
    return lists_.select("k1", "k2", "p.low", "p.high").mapInArrow(run, FOUND)


def repeats(runs: DataFrame, texts: DataFrame, window: int, finer: tuple[int, ...] = FINER) -> DataFrame:
    """(k1, k2, low, high): the windows low to high - 1 of these texts(k1, k2, text) are found elsewhere; runs is of repeated_runs."""
    several = runs.where("not single")
    # one place of each snippet gives its bytes
    once = several.groupBy("seed", "id").agg(F.min(F.struct("k1", "k2", "low", "high")).alias("place"), F.count("*").alias("copies"))
    once = once.groupBy("place.k1", "place.k2").agg(F.collect_list(F.struct("seed", "id", "place.low", "place.high", "copies")).alias("p"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(SNIPPET)
        for b in slices(batches):
            for text, *own in zip(as_bytes(b.column(0)), *(c.to_pylist() for c in b.columns[1:])):
                for seed, x, low, high, n in zip(*own):
                    body = text[low : high + window - 1]
                    if rows.add(seed, x, body, high - low, n, weight=len(body)):
                        yield from rows.take()
        yield from rows.take()

    snippets = texts.select("k1", "k2", "text").join(once, ["k1", "k2"]).select("text", "p.seed", "p.id", "p.low", "p.high", "p.copies").mapInArrow(bodies, SNIPPET)
    snippets = stage(snippets, "snippets")
    counts = snippets.groupBy("seed").count().where(F.col("count") > HOT)
    more = None
    if finer and not counts.isEmpty():
        hot = snippets.join(counts, "seed", "left_semi").select(F.col("seed").alias("k1"), F.col("id").alias("k2"), F.col("body").alias("text"), "copies")
        more = merged(repeats(repeated_runs(cut_runs(hot, window, finer[0])), hot, window, finer[1:]))
        snippets = snippets.join(counts, "seed", "left_anti")
    found = snippets.select(*(x.split()[0] for x in SNIPPET.split(", "))).repartition("seed").sortWithinPartitions("seed").mapInArrow(settle(window), FOUND)
    found = stage(found if more is None else found.unionByName(more), "found")
    again = several.join(found, ["seed", "id"]).select("k1", "k2", "low", F.inline(F.arrays_zip("first", "last"))).select("k1", "k2", (F.col("low") + F.col("first")).alias("low"), (F.col("low") + F.col("last")).alias("high"))
    return runs.where("single").select("k1", "k2", "low", "high").unionByName(again)


def remove_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for every row; spans are removed byte intervals, flat."""
    d = keyed(docs)
    runs = repeated_runs(cut_runs(d.select("k1", "k2", "text", F.lit(1).alias("copies")), window, 2))
    # copies of a text meet as partial results of map tasks, never as rows in one task
    texts = d.groupBy("k1", "k2").agg(F.first("text").alias("text")).join(runs.select("k1", "k2").distinct(), ["k1", "k2"])
    texts = stage(texts, "texts")
    places = repeats(runs, texts, window).groupBy("k1", "k2").agg(F.sort_array(F.collect_set(F.struct("low", "high"))).alias("p"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(RESULT)
        for b in slices(batches):
            for k1, k2, text, low, high in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), lists(b.column(3)), lists(b.column(4))):
                begin, end = union(low.astype(np.int64), high.astype(np.int64) + (window - 1))
                keep, kept = 0, []
                for a, e in zip(begin.tolist(), end.tolist()):
                    kept.append(text[keep:a])
                    keep = e
                left = b"".join([*kept, text[keep:]])
                if rows.add(k1, k2, len(text) - len(left), len(begin), hashlib.sha256(left).hexdigest(), np.stack([begin, end], 1).ravel()):
                    yield from rows.take()
        yield from rows.take()

    changed = texts.join(places, ["k1", "k2"]).select("k1", "k2", "text", "p.low", "p.high").mapInArrow(render, RESULT)
    zero = F.lit(0).cast("long")
    base = d.select("doc_id", "k1", "k2", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("all_sha256"))
    return base.join(changed, ["k1", "k2"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))


def union(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [from, to) of intervals sorted by their beginnings; touching ones merge."""
    reach = np.maximum.accumulate(high)
    gap = np.nonzero(low[1:] > reach[:-1])[0]
    return np.concatenate((low[:1], low[gap + 1])), np.concatenate((reach[gap], reach[-1:]))
