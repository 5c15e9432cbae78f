"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation and case; numbers, names and units become typed slots. Every window of template tokens
of the benchmark is hashed, and the corpus's windows are joined to them by hash. Hits on one diagonal (same shift
between item and document) are judged together; enough of them are a leak if their slots are consistent: one value of the
item always stands for one value in the document, and the reverse. Of a diagonal whose
slots conflict, the largest consistent part is taken. Equal slots make an `exact` leak, others a `reparameterised` one.

A window with fewer than LITERAL literal words is hashed by its words and values as they are, so that tables of other
numbers or lists of other names don't match. A capitalised word that opens a sentence or a line may be a name or not, so windows
over such words are hashed up to three times: as words; as names where the same word is a name elsewhere in the text; all as names.

One pass over the texts hashes their windows and lets through those that a filter of fixed size (a Bloom filter of the
benchmark's windows) doesn't rule out; these are joined to the benchmark's windows by hash, and pairs of a text and an item with enough hits
on a diagonal are verified on their words. Windows that very many items share are left out of the join as far as an item can
miss them and still be found. Texts are told apart by 128-bit keys, so copies of a text are judged once.

Defined cases: null or empty texts match nothing; an item with no word is left out; equal items are one, named by its least
item_id; documents are judged by their text, so every row of a leaking text is reported, with a null or a repeated doc_id or not;
empty tables give an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import Rolling, Rows, as_bytes, mix, small, stage, text_key

HITS = "k1 long, k2 long, item_id long, kind string, start_word long, end_word long, matched_windows long, item_windows long"
WINDOWS = "hash long, item_id long, at int, need int, size int"
PASSED = "k1 long, k2 long, hash long, at int"
#: Size of the filter: 4 MB.
FILTER_BITS = 1 << 25
#: Bytes of texts that are cut into windows together.
TOGETHER = 500_000
#: A window in more items is popular.
POPULAR = 50
#: Units that may follow a number.
UNITS = frozenset(b"% kg g mg lb lbs oz km m cm mm mi ft miles meters metres litres liters l ml hours hour hrs minutes minute min seconds second sec days day weeks week months month years year dollars dollar euros euro cents usd eur kmh mph".split())
WORD, NUMBER, NAME, UNIT = range(4)
LITERAL = 3
_NUMBER = re.compile(rb"[+-]?[$\xe2\x82\xac]*\d[\d.,:/]*%?$")
_OUTER = b"\"'`.,;:!?()[]{}<>*_~|#&"


def kind_of(core: bytes) -> int:
    """The kind of a word without its outer punctuation, -1 if nothing is left."""
    if core.isupper() and core.isalpha() and len(core) > 1:
        return WORD  # shouting is not a name
    if _NUMBER.match(core):
        return NUMBER
    if core[:1].isupper():
        return NAME
    return -1 if not core else UNIT if core.lower() in UNITS else WORD


class Lexicon:
    """Numbers words, and knows of each number (kind, ends a sentence, hash in any case); filled as words come, emptied when large."""

    def __init__(self) -> None:
        self.known, self.kind, self.ends, self.hash = {}, np.empty(4096, np.int8), np.empty(4096, bool), np.empty(4096, np.uint64)

    def arrays(self) -> tuple[np.ndarray, ...]:
        return self.kind, self.ends, self.hash

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers, which hold until the next call."""
        if len(self.known) > 400_000:
            self.known.clear()
        if new := list(set(words).difference(self.known)):
            self.add(new)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def add(self, new: list[bytes]) -> None:
        import xxhash

        n = len(self.known)
        own = slice(n, n + len(new))
        if own.stop > len(self.kind):
            more = max(own.stop, 2 * len(self.kind)) - len(self.kind)
            self.kind, self.ends, self.hash = (np.concatenate((x, np.empty(more, x.dtype))) for x in self.arrays())
        cores = [w.strip(_OUTER) for w in new]
        self.kind[own] = [kind_of(c) if not c.isalpha() or not c.islower() else UNIT if c in UNITS else WORD for c in cores]
        self.ends[own] = [w[-1:] in b".!?:" or w == b"\x00" for w in new]
        self.hash[own] = np.frombuffer(b"".join(xxhash.xxh3_64_digest(c.lower()) for c in cores), ">u8")
        self.known.update(zip(new, range(n, own.stop)))


SLOTS = np.array([0, 0x51ED270B, 0x6F4A955E, 0x9BA38F13], np.uint64)


@dataclass
class Tokens:
    """The tokens of one text, or of several one after another."""

    template: np.ndarray  # hash of the literal word or of its slot's type
    literal: np.ndarray  # hash of the word in any case
    slot: np.ndarray  # whether the token is a slot
    words: np.ndarray  # number of the word in all texts
    text: np.ndarray  # number of the token's text
    first_name: bool  # whether the first token could be a name but for its place
    others: list[np.ndarray]  # further templates, with words that open sentences as names


def tokenise(text: bytes, lexicon: Lexicon) -> Tokens:
    return tokenise_all([text], lexicon)


def tokenise_all(texts: list[bytes], lexicon: Lexicon) -> Tokens:
    """The tokens of all texts; nothing in one text bears on another, so they are those of each text alone."""
    # a line break ends a sentence; its mark is dropped below
    parts = [t.replace(b"\n", b" \x00 ").split() for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    at = lexicon.numbers(list(chain.from_iterable(parts)))
    kind, ends, literal = (x[at] for x in lexicon.arrays())
    text = np.repeat(np.arange(len(texts)), sizes)
    fresh = np.ones(len(at), bool)
    fresh[1:] = ends[:-1] | (text[1:] != text[:-1])
    mark = at == lexicon.known.get(b"\x00", -1)
    word_no = np.cumsum(~mark) - 1
    keep = (kind >= 0) & ~mark
    kind, literal, fresh, word_no, text = kind[keep], literal[keep], fresh[keep], word_no[keep], text[keep]
    first_name = bool(len(kind) and kind[0] == NAME)
    opens, inside = (kind == NAME) & fresh, (kind == NAME) & ~fresh
    kind[opens] = WORD
    after_number = np.zeros(len(kind), bool)
    after_number[1:] = (kind[:-1] == NUMBER) & (text[1:] == text[:-1])
    kind[(kind == UNIT) & ~after_number] = WORD
    slot = kind != WORD
    template, others = np.where(slot, SLOTS[kind], literal), []
    if opens.any():
        own, names = np.nonzero(opens)[0], np.nonzero(inside)[0]
        own = own[np.isin(literal[own] ^ mix(text[own]), literal[names] ^ mix(text[names]))]
        if 0 < len(own) < opens.sum():
            others.append(template.copy())
            others[0][own] = SLOTS[NAME]
        others.append(np.where(opens, SLOTS[NAME], template))
    return Tokens(template, literal, slot, word_no, text, first_name, others)


def windows_of(t: Tokens, w: int, window: int, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the windows of w tokens of one text, in all their readings; only windows of the full length have further readings."""
    h = rolling.windows(t.template, w)
    if not len(h):
        return np.empty(0, np.int64), h
    literal = rolling.windows(t.literal, w)
    few = counted(~t.slot, w) < LITERAL
    h = np.where(few, mix(literal ^ SLOTS[1]), h)
    whole = t.text[: len(h)] == t.text[w - 1 :]
    at = [np.nonzero(whole)[0]]
    out, known = [h[whole]], [h]
    for template in t.others if w == window else []:
        other, fresh = rolling.windows(template, w), whole
        for x in known:
            fresh = fresh & (other != x)
        own = np.nonzero(fresh)[0]
        enough = counted(template == t.literal, w)[own] >= LITERAL
        at.append(own[enough])
        out.append(other[own[enough]])
        known.append(other)
    return np.concatenate(at), mix(np.concatenate(out) + np.uint64(w))


def counted(marks: np.ndarray, w: int) -> np.ndarray:
    """How many of every w consecutive marks are set."""
    sums = np.concatenate(([0], np.cumsum(marks)))
    return sums[w:] - sums[:-w]


@dataclass
class Item:
    """An item's tokens and windows. One shorter than a window is one window."""

    tokens: Tokens
    size: int
    windows: int
    at: np.ndarray
    hashes: np.ndarray

    def need(self, least: int) -> int:
        """How many windows make a leak; what starts an item may differ."""
        return min(least, max(1, self.windows - 1))


def item_of(text: bytes, window: int, lexicon: Lexicon, rolling: Rolling) -> Item | None:
    t = tokenise(text, lexicon)
    if not len(t.template):
        return None
    w = min(window, len(t.template))
    at, h = windows_of(t, w, window, rolling)
    if t.first_name and (~t.slot[1:w]).sum() >= LITERAL:  # what starts an item may be a name inside a text
        first = t.template[:w].copy()
        first[0] = SLOTS[NAME]
        at, h = np.append(at, 0), np.append(h, mix(rolling.windows(first, w) + np.uint64(w)))
    return Item(t, w, len(t.template) - w + 1, at, h)


def consistent(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether values a and b stand for each other one to one."""
    return len(set(zip(a.tolist(), b.tolist()))) == len(set(a.tolist())) == len(set(b.tolist()))


def judge(doc: Tokens, item: Tokens, shift: int, places: np.ndarray, w: int, need: int) -> tuple | None:
    """(windows matched, kind, first word, one past the last) of one diagonal's matched windows, if a consistent part of them is large enough."""
    if len(places) < need:
        return None
    s, e = int(places[0]), int(places[-1]) + w
    differ = doc.literal[s:e] != item.literal[s - shift : e - shift]
    covered = np.cumsum(np.bincount(places - s, minlength=e - s + 1) - np.bincount(places - s + w, minlength=e - s + 1))[:-1] > 0
    own, his = slice(s, e), slice(s - shift, e - shift)
    slot = covered & (doc.slot[own] | item.slot[his] | differ)
    a, c = item.literal[his][slot], doc.literal[own][slot]
    if not consistent(a, c):
        places = consistent_part(places, np.nonzero(slot)[0] + s, a.tolist(), c.tolist(), w)
        if len(places) < need:
            return None
    changed = np.concatenate(([0], np.cumsum(differ)))
    exact = not (changed[places - s + w] - changed[places - s]).any()
    return len(places), "exact" if exact else "reparameterised", int(doc.words[places[0]]), int(doc.words[places[-1] + w - 1]) + 1


def consistent_part(places: np.ndarray, at: np.ndarray, a: list[int], b: list[int], w: int) -> np.ndarray:
    """The most of places whose slots (at, values a and b) are one to one: without what differs, without what breaks the commonest pairs, or one stretch."""

    def without(odd: list[bool]) -> np.ndarray:
        bad = at[np.array(odd, bool)]
        return places[np.searchsorted(bad, places) == np.searchsorted(bad, places + w)]

    there, back = {}, {}
    for (x, y), _ in Counter(zip(a, b)).most_common():
        if x not in there and y not in back:
            there[x], back[y] = y, x
    found = [without([x != y for x, y in zip(a, b)]), without([there.get(x) != y for x, y in zip(a, b)])]
    first = last = low = 0  # slots first to last - 1 are held, and the stretch begins at places[low]
    held, forth, to = Counter(), {}, {}
    best = (0, 0)
    for high, p in enumerate(places.tolist()):
        while last < len(at) and at[last] < p + w:
            x, y = a[last], b[last]
            while forth.get(x, y) != y or to.get(y, x) != x:  # let go of what it conflicts with
                u, v = a[first], b[first]
                held[u, v] -= 1
                if not held[u, v]:
                    del forth[u], to[v]
                first += 1
            held[x, y] += 1
            forth[x], to[y] = y, x
            last += 1
        while low <= high and first and places[low] <= at[first - 1]:
            low += 1
        if high + 1 - low > best[1] - best[0]:
            best = (low, high + 1)
    return max([*found, places[slice(*best)]], key=len)


def leak(doc: Tokens, found: tuple[np.ndarray, np.ndarray], item: Item, least: int) -> tuple | None:
    """(kind, first word, one past the last, windows matched, windows of the item) of the item's best diagonal; found are the document's windows of the item's size."""
    at, h = found
    order = np.argsort(item.hashes, kind="stable")
    known, places = item.hashes[order], item.at[order]
    lo, hi = np.searchsorted(known, h), np.searchsorted(known, h, "right")
    n = hi - lo
    hit = np.nonzero(n)[0]
    if not len(hit):
        return None
    # every pair of equal windows, by diagonal
    p = np.repeat(at[hit], n[hit])
    q = places[np.repeat(lo[hit], n[hit]) + np.arange(n.sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])]
    diagonals = np.unique(np.stack([p - q, p], 1), axis=0)
    best, need = None, item.need(least)
    for part in np.split(diagonals, np.nonzero(np.diff(diagonals[:, 0]))[0] + 1):
        if len(part) >= need and (best is None or len(part) > best[0]):
            own = judge(doc, item.tokens, int(part[0, 0]), part[:, 1], item.size, need)
            if own and (best is None or own[0] > best[0]):
                best = own
    return best and (best[1], best[2], best[3], best[0], item.windows)


def probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in the filter."""
    return (h & np.uint64(FILTER_BITS - 1)).astype(np.int64), (h >> np.uint64(39)).astype(np.int64) % FILTER_BITS


def bench_windows(items: DataFrame, window: int, least: int) -> DataFrame:
    """Staged windows of items(item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, lexicon, rows = Rolling(), Lexicon(), Rows(WINDOWS)
        for b in small(batches):
            for key, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1))):
                if (item := item_of(text, window, lexicon, rolling)) is not None:
                    for h, at in zip(item.hashes.view(np.int64).tolist(), item.at.tolist()):
                        if rows.add(h, key, at, item.need(least), item.size):
                            yield from rows.take()
        yield from rows.take()

    return stage(items.mapInArrow(run, WINDOWS), "windows")


def window_filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """The filter as an array of words, and the sizes of windows. Words are put together by Spark; their number is fixed, as is that of sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.concatenate(probes(b.column(0).to_numpy().view(np.uint64)))
            yield pa.record_batch([pa.array((bits >> 6).astype(np.int32)), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    words = np.zeros(FILTER_BITS >> 6, np.uint64)
    found = windows.select("hash").mapInArrow(run, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return words, sorted(r[0] for r in windows.select("size").distinct().collect())


def pairs(texts: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    """Staged (k1, k2, item_id) with enough equal windows on one diagonal; texts has (k1, k2, text)."""
    sent = texts.sparkSession.sparkContext.broadcast(window_filter(windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, lexicon, rows, seen = Rolling(), Lexicon(), Rows(PASSED), set()
        (bits, sizes), texts, keys, size = sent.value, [], [], 0

        def look() -> Iterator[pa.RecordBatch]:
            nonlocal size
            t = tokenise_all(texts, lexicon)
            first = np.searchsorted(t.text, np.arange(len(texts)))
            for w in sizes:
                at, h = windows_of(t, w, window, rolling)
                for x in range(2):  # the second bit is looked up where the first is set
                    bit = probes(h)[x]
                    hit = np.nonzero(bits[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1))[0]
                    at, h = at[hit], h[hit]
                own = t.text[at]
                for n, p, v in zip(own.tolist(), (at - first[own]).tolist(), h.view(np.int64).tolist()):
                    if rows.add(*keys[n], v, p):
                        yield from rows.take()
            texts.clear()
            keys.clear()
            size = 0

        for b in small(batches):
            for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                if (k1, k2) in seen:  # copies in one task are read once
                    continue
                if len(seen) < 500_000:
                    seen.add((k1, k2))
                texts.append(text)
                keys.append((k1, k2))
                size += len(text)
                if size >= TOGETHER:
                    yield from look()
            yield from look()
        yield from rows.take()

    passed = stage(texts.mapInArrow(run, PASSED), "passed")
    # an item may miss need - 1 windows: its most popular ones are left out
    items_of = windows.groupBy("hash").agg(F.count_distinct("item_id").alias("items"))
    spread = windows.join(items_of, "hash")
    places = spread.groupBy("item_id", "at", "need").agg(F.max("items").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("items"), "at"))
    dropped = (F.col("items") > POPULAR) & (rank < F.col("need"))
    places = places.withColumn("out", dropped)
    left = F.col("need") - F.sum(F.col("out").cast("int")).over(Window.partitionBy("item_id"))
    places = places.withColumn("left", left).where("not out").select("item_id", F.col("at").alias("item_at"), "left")
    known = stage(windows.select("hash", "item_id", F.col("at").alias("item_at")).join(places, ["item_id", "item_at"]).distinct(), "known")
    hits = passed.join(known, "hash").select("k1", "k2", "item_id", "left", (F.col("at") - F.col("item_at")).alias("shift"), "at")
    # repeated rows of a text say the same
    enough = hits.groupBy("k1", "k2", "item_id", "left", "shift").agg(F.size(F.collect_set("at")).alias("n")).where("n >= left")
    return stage(enough.select("k1", "k2", "item_id").distinct(), "pairs")


def leaking_texts(texts: DataFrame, benchmark: DataFrame, window: int, least: int) -> DataFrame:
    """Staged rows of HITS: one per text of texts(k1, k2, text) and leaked item."""
    items = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("text != ''")
    items = stage(items.groupBy(*text_key(F.col("text"))).agg(F.min("item_id").alias("name"), F.first("text").alias("text")).select(F.monotonically_increasing_id().alias("item_id"), "name", "text"), "items")
    found = pairs(texts, bench_windows(items.select("item_id", "text"), window, least), window)
    asked = found.join(items.withColumnRenamed("text", "item"), "item_id").groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "name", "item")).alias("i"))
    held = texts.join(found.select("k1", "k2").distinct(), ["k1", "k2"]).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    both = held.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "i.item_id", "i.name", "i.item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, lexicon, rows, known = Rolling(), Lexicon(), Rows(HITS), {}
        for b in small(batches, most_rows=200):
            for k1, k2, text, keys, names, items in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), *(c.to_pylist() for c in b.columns[3:])):
                doc, found = tokenise(text, lexicon), {}
                for key, name, item in zip(keys, names, items):
                    if key not in known:
                        if len(known) > 20_000:
                            known.clear()
                        known[key] = item_of(item.encode(), window, lexicon, rolling)
                    own = known[key]
                    if own.size not in found:
                        found[own.size] = windows_of(doc, own.size, window, rolling)
                    hit = leak(doc, found[own.size], own, least)
                    if hit and rows.add(k1, k2, name, *hit):
                        yield from rows.take()
        yield from rows.take()

    return stage(both.mapInArrow(run, HITS), "leaks")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 6) -> DataFrame:
    """One row per row of docs and leaked item. A leak needs `least` windows on one diagonal, or all but one of an item's if it has no more."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", *text_key(F.col("text")), "text")
    found = leaking_texts(d.select("k1", "k2", "text"), benchmark, window, least)
    return d.select("doc_id", "k1", "k2").join(found, ["k1", "k2"]).drop("k1", "k2")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 6) -> DataFrame:
    """The rows whose texts have no leak, in the columns of docs."""
    key = [c.alias(n) for c, n in zip(text_key(F.coalesce("text", F.lit(""))), ("__leak_1", "__leak_2"))]
    texts = docs.select(*text_key(F.coalesce("text", F.lit(""))), F.coalesce("text", F.lit("")).alias("text"))
    bad = leaking_texts(texts, benchmark, window, least).select(F.col("k1").alias("__leak_1"), F.col("k2").alias("__leak_2")).distinct()
    return docs.select("*", *key).join(bad, ["__leak_1", "__leak_2"], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
