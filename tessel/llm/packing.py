"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. In each round a queue is credited a quantum (its share of one
window, in fixed point) and serves the whole tokens of its credit; the fraction is its deficit, carried on. A
window is cut from the rounds' stream at every `window` tokens, so it is full and holds the target proportions to
within a token or two. Service after r rounds is floor((carried + r * quantum) / unit): a closed form, so any
partition knows the deficits it starts with without asking another, and partitions are laid out independently.
When a queue runs dry its share passes to the others and a new phase starts.

Defined cases: null and empty texts are the end token alone; a null source is the source ""; repeated rows are packed
each; an empty table gives an empty result; only doc_id, source and text are read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Rows, slices, stage

UNIT = 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
#: Offsets of (part, source) are broadcast up to so many rows (some 10 MB), beyond that joined by shuffle.
BROADCAST_ROWS = 100_000


@dataclass
class Phase:
    """Rounds over a fixed set of queues; arrays are by source, zero quantum where a queue is not served."""

    rounds: int
    stream: int  # tokens before it
    served: np.ndarray  # of each queue before it
    left: np.ndarray  # of each queue at its start
    carried: np.ndarray  # deficits, in units
    quanta: np.ndarray

    def cum(self, r: np.ndarray) -> np.ndarray:
        """Tokens that each queue has served of this phase after r rounds, one row a queue."""
        return np.minimum(self.left[:, None], (self.carried[:, None] + r * self.quanta[:, None]) // UNIT)

    def done(self) -> np.ndarray:
        return self.served + self.cum(np.array([self.rounds]))[:, 0]


def schedule(totals: list[int], weights: list[float] | None = None, window: int = 1024) -> list[Phase]:
    """Phases that serve `totals` tokens at the given weights (default: the totals, so that all queues end together)."""
    left = np.array(totals, np.int64)
    want = np.array(weights if weights is not None else totals, np.float64)
    if (want[left > 0] <= 0).any():
        raise ValueError("every source with tokens needs a positive weight")
    served, carried, stream, out = np.zeros_like(left), np.zeros_like(left), 0, []
    while left.any():
        live = left > 0
        quanta = np.where(live, np.maximum(1, np.rint(window * UNIT * np.where(live, want, 0) / want[live].sum())), 0).astype(np.int64)
        carried = np.where(live, carried, 0)
        rounds = int(min(-((int(c) - int(n) * UNIT) // int(q)) for n, c, q in zip(left[live], carried[live], quanta[live])))
        p = Phase(rounds, stream, served, left, carried, quanta)
        done = p.cum(np.array([rounds]))[:, 0]
        out.append(p)
        stream, served, carried, left = stream + int(done.sum()), served + done, np.where(left > done, (carried + rounds * quanta) % UNIT, 0), left - done
    return out


def pieces_of(phases: list[Phase], source: int, start: int, n: int, ends: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in the stream, offset in the document, length) of the runs that a document at [start, start + n) of its queue is cut into.

    ends: what the source has served after each phase, if known already.
    """
    ends = ends or [int(p.done()[source]) for p in phases]
    at, off, size = [], [], []
    for i in range(bisect_right(ends, start), len(phases)):
        p, base = phases[i], ends[i - 1] if i else 0
        if base >= start + n:
            break
        lo, hi = max(start, base), min(start + n, ends[i])
        c, q = int(p.carried[source]), int(p.quanta[source])
        first, last = (-((c - (j + 1) * UNIT) // q) for j in (lo - base, hi - 1 - base))
        cum = p.cum(np.arange(first - 1, last + 1, dtype=np.int64))
        begin, end = cum[source, :-1], cum[source, 1:]
        # earlier rounds of all queues, and this round's queues before this one
        stream = p.stream + cum[:source, 1:].sum(0) + cum[source:, :-1].sum(0)
        b, e = np.maximum(begin, lo - base), np.minimum(end, hi - base)
        keep = e > b
        at.append((stream + b - begin)[keep])
        off.append((b + base - start)[keep])
        size.append((e - b)[keep])
    return np.concatenate(at), np.concatenate(off), np.concatenate(size)


def cut(at: np.ndarray, off: np.ndarray, size: np.ndarray, total: int, window: int) -> tuple[np.ndarray, ...]:
    """(sequence, offset there, offset in the document, length): runs cut at windows; the tail becomes sequences of powers of two, which need no padding."""
    while (over := at % window + size > window).any():
        room = (window - at % window)[over]
        at, off, size = (np.concatenate(x) for x in ((np.where(over, at, at), at[over] + room), (off, off[over] + room), (np.where(over, window - at % window, size), size[over] - room)))
    full, rest = divmod(total, window)
    sequence, inside = at // window, at % window
    if (tail := at >= full * window).any():
        begins, b = [], 0
        for bit in range(window.bit_length(), -1, -1):
            if rest >> bit & 1:
                begins.append(b)
                b += 1 << bit
        ends = [*begins[1:], rest]
        out = [(int(s), int(i), int(o), int(n)) for s, i, o, n in zip(sequence[~tail], inside[~tail], off[~tail], size[~tail])]
        for i, o, n in zip(inside[tail], off[tail], size[tail]):
            for k, (b, e) in enumerate(zip(begins, ends)):
                lo, hi = max(i, b), min(i + n, e)
                if lo < hi:
                    out.append((full + k, int(lo - b), int(o + lo - i), int(hi - lo)))
        sequence, inside, off, size = (np.array(x, np.int64) for x in zip(*out))
    return sequence, inside, off, size


class Encoder:
    """Ids of a byte-level BPE tokenizer file; equal, text for text, to what the `tokenizers` library gives for it without a template's tokens.

    The ranks and the pattern are read from the tokenizer file and run by tiktoken, several times as fast. The file's
    added tokens are found inside texts first, as the library does; with `plain` their strings are ordinary text.
    """

    def __init__(self, path: str, pattern: str, plain: bool = False) -> None:
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, added = file["model"]["vocab"], file.get("added_tokens") or []
        if odd := [t["content"] for t in added if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]:
            raise ValueError(f"added tokens with conditions: {odd}")
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.special = {} if plain else {t["content"]: t["id"] for t in added}
        names = {t["content"] for t in added}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in names and all(c in letters for c in token)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.wide = max([*vocabulary.values(), *self.special.values()]) >= 1 << 16

    def run(self, text: str) -> list[int]:
        if any(t in text for t in self.special):
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)


def tokenised(docs: DataFrame, path: str, pattern: str, end_id: int = 0) -> DataFrame:
    """Staged (doc_id, source, part, start, n, ids): start counts the tokens of its source before it in its part."""
    ddl = "doc_id long, source string, part long, start long, n long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, begun, rows = Encoder(path, pattern), TaskContext.get().partitionId(), {}, Rows(ddl)
        for b in batches:
            for doc, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = np.array([*encoder.run(text.as_py() or ""), end_id], "<u4" if encoder.wide else "<u2").tobytes()
                n, source = len(ids) // (4 if encoder.wide else 2), source or ""
                at = begun.get(source, 0)
                begun[source] = at + n
                if rows.add(doc, source, part, at, n, ids, weight=len(ids)):
                    yield from rows.take()
        yield from rows.take()

    return stage(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text")).mapInArrow(run, ddl), "tokens")


def pack(docs: DataFrame, tokenizer: str, pattern: str, window: int = 1024, end_id: int = 0, weights: dict[str, float] | None = None) -> DataFrame:
    """One row per piece of a document; see the module. `weights` are target proportions by source (default: the corpus's)."""
    tokens = tokenised(docs, tokenizer, pattern, end_id)
    spark = docs.sparkSession
    from pyspark.sql import Window as W

    parts = stage(tokens.groupBy("source", "part").agg(F.sum("n").alias("n")), "parts")
    totals = {r[0]: r[1] for r in parts.groupBy("source").agg(F.sum("n")).orderBy("source").collect()}  # as many as the mixture has sources
    names = list(totals)
    phases = schedule(list(totals.values()), [weights[s] for s in names] if weights else None, window)
    total, wide = sum(totals.values()), None
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("source", "part", before.alias("before"))
    if parts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    plan = spark.sparkContext.broadcast((names, phases, total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, phases, total = plan.value
        index = {s: i for i, s in enumerate(names)}
        ends = np.stack([p.done() for p in phases], 1).tolist() if phases else []
        for b in slices(batches):
            found, crcs = [], []
            for source, start, n, ids in zip(*(c.to_pylist() for c in b.columns[1:])):
                own = index[source]
                found.append(cut(*pieces_of(phases, own, start, n, ends[own]), total, window))
                view = memoryview(np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")).cast("B")
                at = 4 * found[-1][2]
                crcs += [zlib.crc32(view[i:j]) for i, j in zip(at.tolist(), (at + 4 * found[-1][3]).tolist())]
            if found:
                sequence, offset, at, size = (np.concatenate(x) for x in zip(*found))
                row = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
                yield pa.record_batch([b.column(0).take(row), pa.array(at), pa.array(size), pa.array(crcs, pa.int64()), b.column(3).take(row), pa.array(sequence), pa.array(offset), b.column(1).take(row)], names=[x.split()[0] for x in PIECES.split(", ")])

    placed = tokens.join(offsets, ["source", "part"]).select("doc_id", "source", (F.col("start") + F.col("before")).alias("start"), "n", "ids")
    return placed.mapInArrow(run, PIECES)
