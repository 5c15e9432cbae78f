"""SimHash near-duplicate classes: pigeonhole blocks over fingerprints, verified Hamming distance.

Defined cases: a null or empty text has fingerprint zero; equal fingerprints always link; repeated rows each get a
row; a null doc_id gets a row but never names a component; an empty table gives an empty result; columns other
than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Rows, arrow_schema, as_bytes, components, small, stage

#: Widths of the six blocks of a fingerprint. Two differing bits spare at least four blocks, so every close pair
#: shares one of the 15 choices of four; what is free then is at most 22 bits, which bounds a bucket to 2**22 fingerprints.
WIDTHS = (11, 11, 11, 11, 10, 10)


def masks(distance: int = 2) -> list[int]:
    edges = np.cumsum((0, *WIDTHS))
    blocks = [((1 << int(b)) - 1) ^ ((1 << int(a)) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, len(blocks) - distance)]


def fingerprint(text: bytes, words: int) -> int:
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    parts = zip(*(w[i:] for i in range(words))) if len(w) >= words else [w]
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), 42) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", more: list[Column] | None = None) -> DataFrame:
    """(doc_id, fp long) for every row, and a column `more` (long) where one is given."""
    ddl = "doc_id long, fp long" + (", more long" if more else "")
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            fps = np.array([fingerprint(t, words) for t in as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(fps), *b.columns[2:]], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(c.alias("more") for c in more or [])).mapInArrow(run, ddl)


def bucket_links(fps: np.ndarray, mask: int, distance: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Star links (fp, least fp of its group) among distinct fingerprints that agree under mask.

    Small buckets compare directly; large ones probe the few hundred patterns of the free bits, so the work is linear
    in the bucket.
    """
    fps = np.sort(fps.astype(np.uint64))
    n = len(fps)
    left, right = [], []
    if n <= 256:
        d = np.bitwise_count(fps[:, None] ^ fps[None, :])
        a, b = np.nonzero(np.triu(d <= distance, 1))
        left.append(a)
        right.append(b)
    else:
        free = [1 << i for i in range(64) if not mask >> i & 1]
        for k in range(1, distance + 1):
            for bits in combinations(free, k):
                other = fps ^ np.uint64(sum(bits))
                at = np.minimum(np.searchsorted(fps, other), n - 1)
                a = np.nonzero((fps[at] == other) & (other > fps))[0]
                left.append(a)
                right.append(at[a])
    a, b = np.concatenate(left), np.concatenate(right)
    root = np.arange(n)
    while len(a):  # least label spreads along links, with shortcuts
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            break
    linked = root != np.arange(n)
    return fps[linked], fps[root[linked]]


def link_fingerprints(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """edges(u, v) that span the classes of distinct(fp) at the given distance."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    every = masks(distance)
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("block")) for i, m in enumerate(every))))
    buckets = distinct.select("fp", keys.alias("key")).groupBy("key.choice", "key.block").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows("u long, v long")
        for b in batches:
            for choice, fps in zip(b.column(0).to_pylist(), b.column(1)):
                u, v = bucket_links(fps.values.to_numpy(zero_copy_only=False).view(np.uint64), every[choice], distance)
                for x, y in zip(u.view(np.int64).tolist(), v.view(np.int64).tolist()):
                    if rows.add(x, y):
                        yield from rows.take()
        yield from rows.take()

    return buckets.select("choice", "fps").mapInArrow(run, "u long, v long")


def _classes(fps: DataFrame, distance: int) -> DataFrame:
    """Staged fps(doc_id, fp, ...) with component (the least fingerprint of the class) and component_id (its least doc_id)."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    parts = components(link_fingerprints(distinct.select("fp"), distance))
    known = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    known = stage(known, "classes")
    ids = known.groupBy("component").agg(F.min("least").alias("component_id"))
    return fps.join(known.join(ids, "component").select("fp", "component", "component_id"), "fp")


def near_classes(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs; fingerprints within distance bits link."""
    found = _classes(stage(fingerprints(docs, words), "fps"), distance)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3, distance: int = 2) -> DataFrame:
    """One row of each class of near copies, with docs's columns: that of the least doc_id, a null one only where no other is.

    Rows of one doc_id and different texts are different documents; equal rows are copies. A class is reduced to its
    least (id, text hash) before texts are joined, so that no task gathers a class.
    """
    fps = stage(fingerprints(docs, words, more=[F.xxhash64("text")]), "fps")
    return keep_least(docs, _classes(fps, distance).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "more")).alias("least")))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Columns that name a document: its id, null or not, and its text's hash."""
    return [F.coalesce(doc_id, F.lit(0)).alias("__near_id"), doc_id.isNull().alias("__near_none"), text.alias("__near_text")]


def keep_least(docs: DataFrame, least: DataFrame) -> DataFrame:
    """One row of docs for each row of least(least: struct of null or not, doc_id and the text's hash)."""
    keep = least.select(*row_key(F.col("least.doc_id"), F.col("least.more")))
    keyed = docs.select("*", *row_key(F.col("doc_id").cast("long"), F.xxhash64("text")))
    return keyed.join(keep, keep.columns, "left_semi").dropDuplicates(keep.columns).select(*docs.columns)
