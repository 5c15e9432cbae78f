"""Near copies by SimHash of word shingles: blocks of fingerprints find candidates, exact Jaccard similarity of the shingle sets decides.

A text's set holds the hashes of its five-word shingles (a shorter text is one shingle). Its fingerprint has 512 bits. A
fixed permutation deals the bits to 32 blocks of 16, and texts that agree on a block are compared by the Hamming distance of
the fingerprint's first 128 bits; there are DEALS permutations. Texts that differ in at most 31 of 512 bits share a block of each
(the pigeonhole principle); texts at similarity 0.8 differ in 15 % of their bits (a cosine of 0.89) and share one of all blocks with the
probability that the README states. Links of at most NEAR bits give candidate groups, and each group's sets are compared
exactly by a search that compares a member only with those not reached yet. Classes are the connected components at the given similarity.

A group of over BLOCK shingles is dealt to blocks, so no task holds more than two blocks. Classes are found in each block; then
their representatives are compared, block by block; and the members of two classes whose representatives aren't similar are compared
only if the distances allow a link at all: Jaccard distance is a metric, so with radii a and b there is none beyond a + b + 1 - similarity.
Members are sent once for each other block that one is asked about, not for each other class.

Defined cases: texts with equal sets are copies; null and empty texts are copies of each other; an empty table gives an
empty result; null and repeated ids are as in simhash.keep_one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import Rolling, Rows, as_bytes, components, mix, slices, stage
from tessel.llm.decontaminate import FILTER_BITS, probes
from tessel.llm.simhash import keep_least, row_key

#: Bits of a fingerprint and of a block; permutations of the bits.
BITS, WIDTH, DEALS = 512, 16, 4
#: Blocks whose classes are found before the other blocks are looked at.
FEW = 4
#: Greatest distance of a candidate pair in 128 bits: at similarity 0.8 the mean is 19.4, 36 is four deviations above.
NEAR = 36
#: Shingles of a block of sets: 2 MB.
BLOCK = 250_000
SKETCH = "doc_id long, more long, node long, print binary"
_RANDOM = np.random.default_rng(11)
_SALTS = _RANDOM.integers(0, 1 << 64, BITS // 64, np.uint64)
_TABLES = np.concatenate([_RANDOM.permutation(BITS).reshape(-1, WIDTH) for _ in range(DEALS)])
#: What a block's bucket knows of a text.
ENTRY = np.dtype([("key", "<u2"), ("node", "<i8"), ("a", "<u8"), ("b", "<u8")])


class Shingles(dict):
    """Word bytes to their hash, emptied when large; sorted distinct shingle hashes of a text."""

    def __init__(self, words: int) -> None:
        self.words, self.rolling = words, Rolling()

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, text: bytes) -> np.ndarray:
        if len(self) > 400_000:
            self.clear()
        w = np.fromiter(map(self.__getitem__, text.lower().split()), np.uint64)
        return np.unique(self.rolling.windows(w, min(self.words, len(w)))) if len(w) else w


def node(own: np.ndarray) -> int:
    """One signed long for a set of shingles, 0 for the empty one."""
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64)) if len(own) else 0


def simhash(own: np.ndarray) -> bytes:
    """The fingerprint of a set of shingles: a bit is 1 where over half of their hashes have it; nothing for the empty set."""
    if not len(own):
        return b""
    ones, each = np.zeros(BITS, np.int64), np.arange(8, dtype=np.uint64)[:, None]
    for at in range(0, len(own), 4080):
        h = mix(own[at : at + 4080, None] ^ _SALTS)
        lanes = h[:, None, :] >> each & np.uint64(0x0101010101010101)  # a byte for every eighth bit, so 255 rows fit
        ones += np.add.reduceat(lanes, np.arange(0, len(h), 255)).view(np.uint8).reshape(-1, BITS).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(own)).tobytes()


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, more, node, print) of every row; more is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shingles = Rows(SKETCH), Shingles(words)
        for b in slices(batches):
            for doc, more, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                own = shingles.of(text)
                if rows.add(doc, more, node(own), simhash(own)):
                    yield from rows.take()
        yield from rows.take()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(run, SKETCH)


def similar(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The number of each non-empty set's class, by a search over pairs of at least this similarity."""
    sizes = np.array([len(s) for s in sets])
    edges = np.concatenate(([0], np.cumsum(sizes)))
    _, at = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(at.max() + 1, bool)
    label, rest, left, n, queue = np.full(len(sets), -1), np.arange(len(sets)), at, 0, []
    while len(rest):
        if queue:
            i = queue.pop()
            mine = at[edges[i] : edges[i + 1]]
            marked[mine] = True
            begin = np.concatenate(([0], np.cumsum(sizes[rest])[:-1]))
            both = np.add.reduceat(marked[left], begin, dtype=np.int64)
            marked[mine] = False
            hit = both >= similarity * (sizes[i] + sizes[rest] - both) - 1e-9
        else:
            hit, n = np.arange(len(rest)) == 0, n + 1
        if hit.any():
            label[rest[hit]] = n
            queue += rest[hit].tolist()
            left, rest = left[np.repeat(~hit, sizes[rest])], rest[~hit]
    return label


class Sets:
    """Sorted sets, none empty, to compare others with."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes, self.every = np.array([len(s) for s in sets]), np.concatenate(sets)
        self.begin = np.cumsum(self.sizes) - self.sizes

    def overlaps(self, one: np.ndarray) -> np.ndarray:
        """The Jaccard similarity of a sorted set with each."""
        hit = one[np.minimum(np.searchsorted(one, self.every), len(one) - 1)] == self.every
        both = np.add.reduceat(hit, self.begin, dtype=np.int64)
        return both / (len(one) + self.sizes - both)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that links a, b reach from each of n: least labels spread along links, with shortcuts."""
    root = np.arange(n)
    while len(a):
        before, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            break
    return root


def sets_of(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def block_classes(similarity: float):  # noqa: ANN201
    """Groups (component, block) to (component, block, node, class, radius, middle): class is the least node, radius the greatest distance of its members from that, middle its shingles, on its own row and in large groups only."""

    def run(group: pa.Table) -> pa.Table:
        nodes, sets = group.column("node").to_numpy(), sets_of(group.column("shingles"))
        label = similar(sets, similarity)
        least = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, nodes)
        radius = np.zeros(len(least))
        for c in np.nonzero(np.bincount(label) > 1)[0]:
            own = np.nonzero(label == c)[0]
            middle = sets[own[np.argmin(nodes[own])]]
            radius[c] = 1 - Sets([sets[i] for i in own]).overlaps(middle).min()
        large = group.column("large")[0].as_py()
        middles = [sets[i].tobytes() if large and nodes[i] == least[label[i]] else None for i in range(len(nodes))]
        return pa.table({"component": group.column("component"), "block": group.column("block"), "node": nodes, "class": least[label], "radius": radius[label], "middle": pa.array(middles, pa.binary())})

    return run


def block_pairs(similarity: float):  # noqa: ANN201
    """Groups (component, i, j) of representatives to links (u, v), and to rows (u, null, own, low, high): members of class u, of block own, may be linked to a class of the other of the blocks low and high."""

    def run(group: pa.Table) -> pa.Table:
        nodes, radius, own, block, sets = *(group.column(c).to_numpy() for c in ("node", "radius", "own", "block")), sets_of(group.column("shingles"))
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = np.nonzero(own == i)[0], np.nonzero(own == j)[0]
        a, b, maybe = [], [], []
        every = Sets([sets[y] for y in right]) if len(left) and len(right) else None
        for x in left if every else []:
            s = every.overlaps(sets[x])
            apart = block[right] != block[x]  # classes of one block are known to be apart
            near = apart & (s >= similarity - 1e-9)
            a.append(np.full(near.sum(), x))
            b.append(right[near])
            maybe.append(apart & ~near & (1 - s <= radius[x] + radius[right] + 1 - similarity + 1e-9) & (radius[x] + radius[right] > 0))
        root = roots(len(nodes), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(nodes))
        linked = np.nonzero(root != np.arange(len(nodes)))[0]
        asked = set()
        for x, hit in zip(left, maybe):
            for y in right[hit & (root[right] != root[x])].tolist():
                low, high = sorted((int(block[x]), int(block[y])))
                asked |= {(int(nodes[x]), int(block[x]), low, high), (int(nodes[y]), int(block[y]), low, high)}
        u, _, low, high = ([k[n] for k in sorted(asked)] for n in range(4))
        none = [None] * len(linked)
        return pa.table({"component": pa.array([group.column("component")[0].as_py()] * (len(linked) + len(u)), pa.int64()), "u": pa.array(nodes[linked].tolist() + u, pa.int64()), "v": pa.array(nodes[root[linked]].tolist() + [None] * len(u), pa.int64()), "low": pa.array(none + low, pa.int64()), "high": pa.array(none + high, pa.int64())})

    return run


def member_links(similarity: float):  # noqa: ANN201
    """Groups (component, low, high) of members of two blocks' classes to links (u, v) of these classes."""

    def run(group: pa.Table) -> pa.Table:
        own, label = group.column("class").to_numpy(), similar(sets_of(group.column("shingles")), similarity)
        least = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, own)
        links = np.unique(np.stack([own, least[label]]), axis=1)
        links = links[:, links[0] != links[1]]
        return pa.table({"u": links[0], "v": links[1]})

    return run


def exact_classes(members: DataFrame, similarity: float) -> DataFrame:
    """Staged (node, class) of staged members(component, node, shingles): the classes in each candidate group."""
    # few rows, so members aren't shuffled to meet them
    sizes = stage(members.groupBy("component").agg(F.sum(F.octet_length("shingles") / 8).alias("words")).where(F.col("words") > BLOCK), "sizes")
    block = F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("words") / BLOCK)), F.lit(0)).cast("long")
    dealt = members.join(sizes, "component", "left").select("component", block.alias("block"), "node", "shingles", F.col("words").isNotNull().alias("large"))
    found = stage(dealt.groupBy("component", "block").applyInArrow(block_classes(similarity), "component long, block long, node long, class long, radius double, middle binary"), "blocks")
    middles = found.where("middle is not null").select("component", "block", "node", "radius", F.col("middle").alias("shingles"))
    if middles.isEmpty():
        return found.select("node", "class")
    own = middles.groupBy("component").agg(F.ceil(F.sum(F.octet_length("shingles") / 8) / BLOCK).cast("int").alias("n"))
    spread = middles.join(own, "component").withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    tasks = spread.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "block", "node", "radius", "shingles")
    pairs = stage(tasks.groupBy("component", "i", "j").applyInArrow(block_pairs(similarity), "component long, u long, v long, low long, high long"), "pairs")
    links = pairs.where("v is not null").select("u", "v")
    asked = stage(pairs.where("v is null").select("component", F.col("u").alias("class"), "low", "high").distinct(), "asked")
    if not asked.isEmpty():
        sides = asked.join(found.select("component", "class", "node"), ["component", "class"])
        more = sides.join(members.select("node", "shingles"), "node").groupBy("component", "low", "high").applyInArrow(member_links(similarity), "u long, v long")
        links = links.unionByName(more)
    whole = components(links).withColumnRenamed("node", "class").withColumnRenamed("component", "joined")
    return stage(found.select("node", "class").join(whole, "class", "left").select("node", F.coalesce("joined", "class").alias("class")), "classes")


def bucket_links(entries: np.ndarray, most: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Star links (node, least node) that span the classes of entries which share a key, within NEAR bits.

    Entries are compared with the next ones of their bucket; buckets of over `most` by a search among those not reached yet.
    """
    e = entries[np.argsort(entries["key"], kind="stable")]
    key, a, b = (np.ascontiguousarray(e[c]) for c in ("key", "a", "b"))
    node, at = np.unique(e["node"], return_inverse=True)
    begin = np.concatenate(([0], np.nonzero(np.diff(key))[0] + 1, [len(key)]))
    size = np.diff(begin)
    u, v, n = [], [], 0

    def add(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal u, v, n
        u.append(at[i])
        v.append(at[j])
        n += len(i)
        if n > 1_000_000:
            root = roots(len(node), np.concatenate(u), np.concatenate(v))
            u, v, n = [np.arange(len(node))], [root], 0

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(a[i] ^ a[j]).astype(np.int16) + np.bitwise_count(b[i] ^ b[j]) <= NEAR

    live, step = np.nonzero(np.repeat(size <= most, size))[0], 1
    while len(live := live[live + step < len(key)]) and len(live := live[key[live + step] == key[live]]):
        hit = live[near(live, live + step)]
        add(hit, hit + step)
        step += 1
    for k in np.nonzero(size > most)[0]:
        rest, queue = np.arange(begin[k], begin[k + 1]), []
        while len(rest):
            i = queue.pop() if queue else rest[0]
            hit = near(i, rest)
            add(np.full(hit.sum(), i), rest[hit])
            queue += rest[hit & (rest != i)].tolist()
            rest = rest[~hit]
    root = roots(len(node), np.concatenate(u), np.concatenate(v)) if u else np.arange(len(node))
    linked = root != np.arange(len(node))
    return node[linked], node[root[linked]]


def block_links(known: DataFrame, tables: list[int], split: int) -> DataFrame:
    """Links (u, v) of known(node, print) that span what shares a block of the given ones and is near; nodes may be labels of several prints."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4000):
            nodes = b.column(0).to_numpy()
            prints = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            if not len(prints):
                continue
            words, bits = prints.view("<u8"), np.unpackbits(prints, axis=1)
            piece, out = [], []
            for t in tables:
                e = np.empty(len(nodes), ENTRY)
                e["key"] = np.ascontiguousarray(np.packbits(bits[:, _TABLES[t]], axis=1)).view("<u2")[:, 0]
                e["node"], e["a"], e["b"] = nodes, words[:, 0], words[:, 1]
                part = e["key"].astype(np.int64) >> (WIDTH - split)
                order = np.argsort(part, kind="stable")
                e, part = e[order], part[order]
                edges = np.concatenate(([0], np.nonzero(np.diff(part))[0] + 1, [len(part)]))
                piece += ((t << WIDTH) + part[edges[:-1]]).tolist()
                out += [e[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]
            yield pa.record_batch([pa.array(piece, pa.int64()), pa.array(out, pa.binary())], names=["piece", "entries"])

    def link(group: pa.Table) -> pa.Table:
        u, v = bucket_links(np.frombuffer(b"".join(group.column("entries").to_pylist()), ENTRY))
        return pa.table({"u": u, "v": v})

    return stage(known.mapInArrow(deal, "piece long, entries binary").groupBy("piece").applyInArrow(link, "u long, v long"), "links")


def candidates(distinct: DataFrame) -> DataFrame:
    """(node, component): groups of nodes whose fingerprints share a block and are near, directly or through others.

    A text of a large group has a link in nearly every block, most of them to different texts. So the classes of FEW blocks are found first;
    the other blocks then link these classes, and only classes that are not one yet. The groups are those of all links.
    """
    # pieces of about 8 MB: a block's buckets, by their key's first bits where there are many texts
    split = max(0, int(np.ceil(np.log2(max(1, distinct.count() * ENTRY.itemsize / 8e6)))))
    split = min(split, WIDTH)
    known = distinct.where(F.octet_length("print") > 0).select("node", "print")
    first = components(block_links(known, list(range(FEW)), split))
    named = stage(known.join(first, "node", "left").withColumn("class", F.coalesce("component", "node")), "named")
    rest = components(block_links(named.select(F.col("class").alias("node"), "print"), list(range(FEW, len(_TABLES))), split))
    rest = stage(rest.toDF("class", "joined"), "joined")
    found = named.select("node", "component", "class").join(rest, "class", "left")
    return stage(found.select("node", F.coalesce("joined", "component").alias("component")).where("component is not null"), "candidates")


def within(hashes: DataFrame):  # noqa: ANN201
    """A function of a long column: whether hashes(hash) may hold it, by a filter of fixed size (see decontaminate.FILTER_BITS), so that most other rows needn't be shuffled to learn that they meet nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.concatenate(probes(mix(b.column(0).to_numpy().view(np.uint64))))
            yield pa.record_batch([pa.array((bits >> 6).astype(np.int32)), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], names=["word", "bit"])

    words = np.zeros(FILTER_BITS >> 6, np.uint64)
    found = hashes.select("hash").mapInArrow(run, "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    sent = hashes.sparkSession.sparkContext.broadcast(words)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        x, y = probes(mix(h.to_numpy(zero_copy_only=False).view(np.uint64)))
        hit = (sent.value[x >> 6] >> (x & 63).astype(np.uint64)) & (sent.value[y >> 6] >> (y & 63).astype(np.uint64)) & np.uint64(1)
        return pa.array(hit.astype(bool))

    return maybe


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of near copies, with docs's columns, chosen as in simhash.keep_one. Texts are shuffled only where a filter can't tell that they are alone."""
    rows = stage(sketches(docs, words), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "more")).alias("first")
    distinct = stage(rows.groupBy("node").agg(first, F.any_value("print").alias("print"), F.count("*").alias("n")), "distinct")
    groups = stage(candidates(distinct).join(distinct.drop("print"), "node"), "groups")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text"))
    own = row_key(F.col("first.doc_id"), F.col("first.more"))
    asked = within(groups.select(F.xxhash64("first.doc_id", "first.more").alias("hash")))
    texts = docs.where(asked(key)).select("text", *row_key(F.col("doc_id").cast("long"), F.xxhash64("text"))).join(groups.select("node", "component", *own), ["__near_id", "__near_none", "__near_text"])
    texts = texts.dropDuplicates(["node"]).select("component", "node", "text")
    ddl = "component long, node long, shingles binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shingles = Rows(ddl), Shingles(words)
        for b in slices(batches):
            for c, n, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                data = shingles.of(text).tobytes()
                if out.add(c, n, data, weight=len(data)):
                    yield from out.take()
        yield from out.take()

    classes = exact_classes(stage(texts.mapInArrow(cut, ddl), "members"), similarity)
    named = stage(distinct.drop("print").join(classes, "node", "left").select("node", "first", "n", F.coalesce("class", "node").alias("component")), "named")
    least = stage(named.groupBy("component").agg(F.min("first").alias("least"), F.sum("n").alias("n")), "least")
    several = named.select("node", "component").join(least.where("n > 1").select("component"), "component")
    met = within(rows.join(several, "node").select(F.xxhash64("doc_id", "more").alias("hash")))
    return docs.where(~met(key)).unionByName(keep_least(docs.where(met(key)), least))
