"""Candidate texts of the exact-repeat operators: seeds, repeated seeds, and the texts that hold them.

A window's seed is made of minimal hashes of short grams inside it, so equal windows have equal seeds, and a window
whose seed occurs once in the corpus occurs once itself. Neighbouring windows mostly share a seed: a text has a run of
windows for each, far fewer than windows. Counting seeds in Spark and keeping the texts with repeated ones loses no
repeat and spares shuffling one row for every window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Rows, as_bytes, slices, sliding_min, stage, text_key

#: A seed found more often is too frequent to meet in one place.
WIDE = 10_000
SEEDS = "k1 long, k2 long, seeds array<long>"


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]
NO_RUNS: Runs = (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))


def least_grams(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(least of each w consecutive grams, whether its leftmost place differs from the one before): a place is left when it was the first."""
    m = sliding_min(grams, w)
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | (grams[: len(m) - 1] == m[:-1])
    return m, new


def runs_of(seed_by_window: np.ndarray, new: np.ndarray) -> Runs:
    """(seed, first window, one past the last) of each run of windows whose seed comes from the same places, so that a run holds no two equal windows."""
    first = np.nonzero(new)[0]
    return seed_by_window[first], first, np.append(first[1:], len(seed_by_window))


def candidates(docs: DataFrame, seeds_of: Callable[[], Callable[[bytes], Runs]]) -> DataFrame:
    """Staged (k1, k2, text, copies, runs, wide): each distinct text with a repeated seed, how many rows have it, the numbers of its repeated runs, and those of them whose seed is found over WIDE times.

    docs has (k1, k2, text). seeds_of() gives a function from a text's bytes to its runs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, rows, seen = seeds_of(), Rows(SEEDS), {}
        for b in slices(batches):
            for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                if (n := seen.get((k1, k2), 0)) == 2:  # two rows of a text already show that its seeds are repeated
                    continue
                seen[k1, k2] = n + 1
                s = seeds(text)[0]
                if len(s) and rows.add(k1, k2, s.view(np.int64), weight=8 * len(s)):
                    yield from rows.take()
        yield from rows.take()

    found = stage(docs.mapInArrow(run, SEEDS), "seeds")
    # staged, so that the join below has a shuffle on either side and skewed seeds can be split
    again = stage(found.select(F.explode("seeds").alias("seed")).groupBy("seed").count().where("count > 1").select("seed", (F.col("count") > WIDE).alias("wide")), "again")
    hits = found.select("k1", "k2", F.posexplode("seeds").alias("run", "seed")).join(again, "seed")
    hits = hits.groupBy("k1", "k2").agg(F.collect_set("run").alias("runs"), F.collect_set(F.when(F.col("wide"), F.col("run"))).alias("wide"))
    # copies of a text meet as partial results of map tasks, never as rows in one task
    texts = docs.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return stage(texts.join(hits, ["k1", "k2"]), "candidates")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", *text_key(F.col("text")), "text")


def intervals(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal [from, to) that sorted window starts of one length cover; touching ones merge."""
    if not len(starts):
        return starts, starts
    gap = np.nonzero(np.diff(starts) > length)[0]
    return np.concatenate((starts[:1], starts[gap + 1])), np.concatenate((starts[gap], starts[-1:])) + length
