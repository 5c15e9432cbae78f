"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood by the scaled forward recursion.

States emit word classes (a hash of the word; the end token is a class of its own), and a class emits its words by
smoothed counts: P(word | class) = (c + 1) / (N_class + V_class + 1). Both are proper distributions, so a text's score is
its exact probability: forward recursion over classes times the words given their classes. The state tables have a
fixed size and are broadcast; word counts grow with the corpus and stay distributed. Frequent words, of which there
are at most HEAVY by arithmetic (each has over 1/HEAVY of all tokens), are looked up in a broadcast table; the
counts of all other words are joined by word.

Every Baum-Welch pass goes over all training texts: expected counts add up by class inside partitions and then across
them, and the model is re-estimated. How the input is dealt changes a sum's rounding only.

Defined cases: a null or empty text is the end token alone; a null doc_id is in training; repeated rows are scored and counted
each; an empty table gives an empty result; without training rows counts are zero; only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Rows, as_bytes, small, stage

HEAVY = 200_000
END = ""  # no word is empty
SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, heavy_known long, heavy_log double, class_log double, hmm_log double, words array<binary>, times array<int>"


@dataclass
class Model:
    """start: of the state before the first token; move[i, j]; emit[class, state]."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def class_ids(words: list[bytes], classes: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % classes


def first_model(share: np.ndarray, states: int, seed: int = 7) -> Model:
    """Sticky transitions, and emissions scattered around the classes' shares."""
    r = np.random.default_rng(seed)
    emit = (share[:, None] + 1e-9) * np.exp(r.normal(0, 0.5, (len(share), states)))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def sequences(ids: list[np.ndarray], most: int = 400_000) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(row numbers, class ids) in lots of similar lengths, longest first within a lot."""
    order = np.argsort([-len(x) for x in ids], kind="stable")
    lot, size = [], 0
    for i in order:
        if lot and size + len(ids[i]) > most:
            yield np.array(lot), [ids[j] for j in lot]
            lot, size = [], 0
        lot.append(i)
        size += len(ids[i])
    if lot:
        yield np.array(lot), [ids[j] for j in lot]


def by_time(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols ordered by time then sequence, number of sequences alive at each time); sequences are longest first."""
    sizes = np.array([len(s) for s in seqs])
    alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes[0] + 1))
    begin = np.concatenate(([0], np.cumsum(alive)))
    out = np.empty(begin[-1], np.int64)
    for i, s in enumerate(seqs):
        out[begin[: len(s)] + i] = s
    return out, alive


def forward(m: Model, symbols: np.ndarray, alive: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """log likelihood of each sequence; scaled alphas and scales by time, if kept."""
    emit = m.emit[symbols]
    scale = np.empty(len(symbols))
    alphas = np.empty_like(emit) if keep else None
    a, at = np.repeat(m.start[None], alive[0], 0), 0
    ones = np.ones(len(m.start))
    for n in alive.tolist():
        a = (a[:n] @ m.move) * emit[at : at + n]
        c = a @ ones
        a /= c[:, None]
        scale[at : at + n] = c
        if keep:
            alphas[at : at + n] = a
        at += n
    begin = np.concatenate(([0], np.cumsum(alive)))[:-1]
    log = np.log(scale)
    owner = np.arange(len(symbols)) - np.repeat(begin, alive)
    return np.bincount(owner, log, minlength=alive[0]), alphas, scale


def expected(m: Model, symbols: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected (starts, moves, emissions by class) and the log likelihood."""
    log, alphas, scale = forward(m, symbols, alive, True)
    emit, gamma = m.emit[symbols] / scale[:, None], np.empty_like(alphas)
    begin = np.concatenate(([0], np.cumsum(alive)))
    k = len(m.start)
    moves, beta = np.zeros((k, k)), np.ones((0, k))
    back = np.ascontiguousarray(m.move.T)
    for t in range(len(alive) - 1, -1, -1):
        lo, n = begin[t], alive[t]
        if len(beta) < n:
            beta = np.concatenate((beta, np.ones((n - len(beta), k))))
        gamma[lo : lo + n] = alphas[lo : lo + n] * beta
        weighted = emit[lo : lo + n] * beta
        before = alphas[begin[t - 1] : begin[t - 1] + n] if t else np.repeat(m.start[None], n, 0)
        moves += before.T @ weighted
        beta = weighted @ back
    starts = (m.start * beta).sum(0)
    by_class = np.stack([np.bincount(symbols, gamma[:, i], minlength=len(m.emit)) for i in range(k)], 1)
    return starts, moves * m.move, by_class, float(log.sum())


def maximise(starts: np.ndarray, moves: np.ndarray, by_class: np.ndarray, share: np.ndarray, prior: float = 200.0) -> Model:
    """Smoothed re-estimates: emissions lean on the classes' shares, transitions on one count."""
    emit = by_class + prior * share[:, None]
    moves = moves + 1
    return Model((starts + 1) / (starts + 1).sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0))


def coded(training: DataFrame, classes: int) -> DataFrame:
    """Staged (codes) of training(text): class ids, the end token's class last, so that passes needn't cut texts into words again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows("codes binary")
        for b in small(batches):
            for t in as_bytes(b.column(0)):
                ids = np.append(class_ids(t.lower().split(), classes), classes).astype("<u2").tobytes()
                if rows.add(ids, weight=len(ids)):
                    yield from rows.take()
        yield from rows.take()

    return stage(training.mapInArrow(run, "codes binary"), "classes")


def baum_welch(training: DataFrame, model: Model, classes: int) -> np.ndarray:
    """Expected counts over training(codes): rows are the classes, then moves, starts and the log likelihood. Spark sums; what returns has a fixed size."""
    k, spark = len(model.start), training.sparkSession
    ddl = "row int, " + ", ".join(f"s{i} double" for i in range(k))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes + 1 + k + 2, k))
        for b in small(batches):
            for _, seqs in sequences([np.frombuffer(x, "<u2").astype(np.int64) for x in b.column(0).to_pylist()]):
                s, m, e, log = expected(sent.value, *by_time(seqs))
                total += np.concatenate((e, m, s[None], np.full((1, k), log / k)))
        own = np.nonzero(total.any(1))[0]
        if len(own):
            yield pa.record_batch([pa.array(own.astype(np.int32)), *(pa.array(total[own, i]) for i in range(k))], names=["row", *(f"s{i}" for i in range(k))])

    total = np.zeros((classes + 1 + k + 2, k))
    for r in training.select("codes").mapInArrow(run, ddl).groupBy("row").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(k))).collect():
        total[r[0]] = r[1:]
    return total


def train(codes: DataFrame, share: np.ndarray, states: int, passes: int) -> Model:
    """So many passes over all of coded(...)."""
    classes, model = len(share) - 1, first_model(share, states)
    for _ in range(passes):
        total = baum_welch(codes, model, classes)
        model = maximise(total[-2], total[classes + 1 : -2], total[: classes + 1], share)
    return model


def count_words(training: DataFrame) -> DataFrame:
    """Staged (word, c) over training(text); the end token is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def take() -> Iterator[pa.RecordBatch]:
            every = list(counts)
            for at in range(0, len(every), 50_000):
                own = every[at : at + 50_000]
                yield pa.record_batch([pa.array(own, pa.binary()), pa.array([counts[w] for w in own], pa.int64())], names=["word", "c"])

        for b in small(batches):
            for t in as_bytes(b.column(0)):
                counts.update(t.lower().split())
            if b.num_rows:
                counts[b""] += b.num_rows
            if len(counts) > 400_000:
                yield from take()
                counts = Counter()
        yield from take()

    return stage(training.mapInArrow(run, "word binary, c long").groupBy(F.col("word").cast("string").alias("word")).agg(F.sum("c").alias("c")), "counts")


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def score(docs: DataFrame, states: int = 8, classes: int = 4096, passes: int = 4) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; logs are to the base 10."""
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    training = d.where(~F.col("held_out")).select("text")
    counts = count_words(training)
    cls = F.when(F.col("word") == END, classes).otherwise(F.crc32(F.col("word").cast("binary")) % classes).cast("int")
    tokens, words = np.zeros(classes + 1), np.zeros(classes + 1)
    for c, n, v in counts.groupBy(cls.alias("cls")).agg(F.sum("c"), F.count("*")).collect():  # as many rows as classes
        tokens[c], words[c] = n, v
    n_all, v_all = int(tokens.sum()), int(words.sum())
    model = train(coded(training, classes), (tokens + 1) / (tokens + 1).sum(), states, passes)
    inside = np.log10(tokens + words + 1)
    inside[classes] = 0.0  # the end class has one word
    common = counts.where((F.col("c") * HEAVY > n_all) & (F.col("word") != END))  # at most HEAVY words
    heavy = {r[0].encode(): float(np.log10(r[1] + 1)) for r in common.collect()}
    tables = spark.sparkContext.broadcast((model, inside, heavy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, inside, heavy = tables.value
        uid = TaskContext.get().partitionId() << 33
        for b in small(batches):
            cut = [t.lower().split() for t in as_bytes(b.column(1))]
            ids = [np.append(class_ids(w, classes), classes) for w in cut]
            log = np.zeros(len(ids))
            for own, seqs in sequences(ids):
                log[own] = forward(model, *by_time(seqs))[0] / np.log(10)
            known, known_log, rare, times = [], [], [], []
            for w in cut:
                c = Counter(w)
                own = [(n, heavy[x]) for x, n in c.items() if x in heavy]
                known.append(sum(n for n, _ in own))
                known_log.append(sum(n * x for n, x in own))
                rare.append([x for x in c if x not in heavy])
                times.append([c[x] for x in rare[-1]])
            columns = [np.arange(uid, uid + len(cut)), b.column(0), b.column(2), pa.array([len(x) for x in ids], pa.int64()), pa.array(known, pa.int64()), pa.array(known_log, pa.float64()), pa.array([float(inside[x].sum()) for x in ids], pa.float64()), log, pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=[x.split()[0] for x in SCORED.split(", ")])
            uid += len(cut)

    scored = stage(d.select("doc_id", "text", "held_out").mapInArrow(run, SCORED), "scored")
    pairs = scored.select("uid", F.explode(F.arrays_zip("words", "times")).alias("r")).select("uid", F.col("r.words").cast("string").alias("word"), F.col("r.times").alias("n"))
    rare = pairs.join(counts, "word").groupBy("uid").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_log"))
    ends = float(tokens[classes])  # every text has one end token
    word_log = F.col("heavy_log") + F.coalesce("rare_log", F.lit(0.0))
    end_log = float(np.log10(ends + 1))
    return scored.drop("words", "times").join(rare, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("heavy_known") + F.coalesce("rare_known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (word_log + end_log - F.col("n_tokens") * float(np.log10(n_all + v_all + 1))).alias("base_score"),
        (F.col("hmm_log") + word_log - F.col("class_log")).alias("score"),
    )
