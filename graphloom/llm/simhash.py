"""SimHash near-duplicates by multi-index hashing.

If a pair of fingerprints differs in ``radius`` bits at most, then in one of ``segments`` segments it differs in
``a = radius // segments`` bits at most; indeed in one of the first ``radius - segments * a + 1``, or in another by
``a - 1`` at most. Each distinct fingerprint enters a table under the values of a small Hamming ball around its segments, and
probes the table with those of another, the balls' radii adding up to ``a``; whatever meets under one value has its complete
distance verified. Rows of one value never leave as all pairs: a task keeps the links of a spanning forest, and where links
are only candidates, those of each row to the centre of the rows it meets.

With a second seed a fingerprint has 64 bits more, and segments of their own. ``similar_groups`` takes links as candidates and
compares the texts at their ends; pairs that are alike without such a link are found exactly, by the shingles they share.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.components import FEW, matched, stars
from graphloom.llm.workers import let_go
from graphloom.session import counted, cut, cut_few, map_arrow, stored

BITS = 64
#: Hashes whose bits are counted at once, and links that are held before they are reduced to stars.
BLOCK = 1 << 16
HELD = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows that meet under one key are compared all at once up to this number.
SMALL = 16
#: Of more rows, so many are centres.
CENTRES = 3
#: A key with more rows than this, as estimated from one node in so many, is split into pairs of parts; so many keys at most,
#: those with the most rows.
PART, ONE_IN, SPLIT_KEYS = 1 << 16, 64, 10_000
#: Shingles are counted over one text in so many; so many of the most frequent ones are taken last.
COUNTED, FREQUENT = 16, 1 << 15
#: So many texts that meet under one shingle are compared at once.
WIDE = 1 << 11


def fingerprint(text: bytes | None, words: int = 3, distinct: bool = False, seed: int = 42) -> int:
    """The 64-bit SimHash of a UTF-8 text's shingles, A-Z lower-cased; 0 for null and for texts without a word.

    ``bytes.lower`` and ``bytes.split`` touch exactly A-Z and [\\x20\\x09-\\x0D]. ``distinct`` counts each shingle once.
    """
    ws = text.lower().split() if text else []
    if not ws:
        return 0
    if len(ws) < words:
        shingles = [b" ".join(ws)]
    elif words == 1:
        shingles = ws
    else:
        shingles = map(b" ".join, zip(*(ws[i:] for i in range(words)), strict=False))
    if distinct:
        shingles = set(shingles)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int = 3, distinct: bool = False, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(id, fp[, fp2]) of every row, as signed longs. A map over the input, without a shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    names = ["fp", "fp2"][: len(seeds)]
    schema = f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            fps = np.array([[fingerprint(t.as_py(), words, distinct, s) for s in seeds] for t in b.column(1)], dtype=np.uint64).reshape(-1, len(seeds))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in fps.T)], names=["id", *names])

    return map_arrow(source, run, schema)


def _masks(width: int, radius: int) -> list[int]:
    """Non-empty sets of up to ``radius`` bits of a segment."""
    return [sum(1 << b for b in bits) for r in range(1, radius + 1) for bits in combinations(range(width), r)]


def _entries(nodes: DataFrame, radius: int, segments: int) -> DataFrame:
    """(key, exact, fp[, fp2]): what a fingerprint enters the table under, and its probes.

    Two values that differ in one bit meet if the one with a 0 there probes, so in balls of one bit the other is left out.
    With balls of one bit on both sides, every row is both.
    """
    each = segments // len(nodes.columns)
    if each * len(nodes.columns) != segments:
        raise ValueError("segments divide evenly among the halves of a fingerprint")
    ball, wide = radius // segments, radius % segments + 1
    keys = []
    for s in range(segments):
        low, high = BITS * (s % each) // each, BITS * (s % each + 1) // each
        value = F.shiftrightunsigned(nodes.columns[s // each], low).bitwiseAND(F.lit((1 << (high - low)) - 1))
        key = lambda v, exact, s=s: F.struct((v * F.lit(segments) + F.lit(s)).alias("key"), F.lit(exact).alias("exact"))
        within = ball if s < wide else ball - 1
        entered = within // 2  # the table's ball; the rest is the probes'
        if within < 0:
            continue
        keys += [key(value.bitwiseXOR(F.lit(m)), True) for m in [0, *_masks(high - low, entered)]]
        if within == entered * 2:
            continue  # the same values
        for m in _masks(high - low, within - entered):
            probe: Column = key(value.bitwiseXOR(F.lit(m)), False)
            keys.append(F.when(value.bitwiseAND(F.lit(m)) == 0, probe) if within == 1 else probe)
    return nodes.select(*nodes.columns, F.explode(F.array(*keys)).alias("k")).where("k is not null").select("k.key", "k.exact", *nodes.columns)


def _split(entries: DataFrame, sample: DataFrame) -> DataFrame:
    """Entries with a column ``part``: 0, or for keys with very many rows the pairs of parts that a row is in."""
    seen = sample.groupBy("key").count().where(F.col("count") > PART // ONE_IN).orderBy(F.desc("count"), "key").limit(SPLIT_KEYS).collect()
    return _parted(entries, [(r["key"], -(-r["count"] * ONE_IN // PART)) for r in seen])


def _parted(entries: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """Entries with a column ``part``, by the number of parts of the keys that have several."""
    if not keys:
        return entries.withColumn("part", F.lit(0).cast("long"))
    parts = entries.sparkSession.createDataFrame(keys, "_key long, _parts long")
    own = F.pmod(F.xxhash64(F.lit("part"), *[F.col(c) for c in entries.columns[2:]]), F.col("_parts"))
    pair = lambda q: F.least(own, q) * F.col("_parts") + F.greatest(own, q)
    at = F.when(F.col("_parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1), pair))
    return entries.join(F.broadcast(parts), F.col("key") == F.col("_key"), "left").select(*entries.columns, F.explode(at).alias("part"))


def _numbered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and which of them each row is."""
    order = np.lexsort(rows.T[::-1])
    sorted_ = rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]).any(axis=1)
    which = np.empty(len(rows), np.int64)
    which[order] = np.cumsum(new) - 1
    return sorted_[new], which


def _joined(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after joining those of x and y: the least of each component."""
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(hop := new[new], new):
            new = hop
        if np.array_equal(new, label):
            return label
        label = new


def _priority(fp: np.ndarray) -> np.ndarray:
    """A number for each fingerprint, the same in every task; equal ones are told apart by the fingerprints themselves."""
    x = fp[:, 0].view(np.uint64) * MIX
    for i in range(1, fp.shape[1]):
        x = (x ^ (x >> np.uint64(29)) ^ fp[:, i].view(np.uint64)) * MIX
    return x ^ (x >> np.uint64(32))


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which links are those of the minimum spanning forest by their ends' priorities, the better end's first.

    That order is the same everywhere, so a link of the whole table's forest is in the forest of any part that has it. A node
    is a row. Boruvka's rounds.
    """
    nodes, at = _numbered(np.concatenate([a, b]))
    place = np.empty(len(nodes), np.int64)
    place[np.lexsort((*nodes.T[::-1], _priority(nodes)))] = np.arange(len(nodes))
    x, y = at[: len(a)], at[len(a) :]
    order = np.lexsort((np.maximum(place[x], place[y]), np.minimum(place[x], place[y])))
    rank = np.empty(len(a), np.int64)
    rank[order] = np.arange(len(a))
    label, kept = np.arange(len(nodes)), np.zeros(len(a), bool)
    alive = np.arange(len(a))
    while len(alive := alive[label[x[alive]] != label[y[alive]]]):
        best = np.full(len(nodes), len(a))
        np.minimum.at(best, label[x[alive]], rank[alive])
        np.minimum.at(best, label[y[alive]], rank[alive])
        chosen = order[np.unique(best[best < len(a)])]
        kept[chosen] = True
        label = _joined(label, x[chosen], y[chosen])
    return kept


class _Links:
    """Verified pairs, reduced to a forest whenever many have gathered; and, if asked for, more candidates, each once.

    With ``segments``, a pair is taken under one of its common keys only.
    """

    def __init__(self, width: int, more: bool, segments: int) -> None:
        self.width, self.more, self.segments = width, more, segments
        self.held: dict[bool, list[np.ndarray]] = {False: [], True: []}
        self.n, self.most = {False: 0, True: 0}, {False: HELD, True: HELD}

    def add(self, key: int, a: np.ndarray, b: np.ndarray, more: bool = False) -> None:
        if more and not self.more:
            return
        if self.segments and len(a):
            own = _own_key(a, b, self.segments) == key
            a, b = a[own], b[own]
        if len(a):
            self.held[more].append(np.concatenate([a, b], axis=1))
            self.n[more] += len(a)
            if self.n[more] > self.most[more]:
                self.reduced(more)
                self.most[more] = max(HELD, 2 * self.n[more])

    def reduced(self, more: bool) -> np.ndarray:
        every = np.concatenate([np.empty((0, 2 * self.width), np.int64), *self.held[more]])
        every = _numbered(every)[0] if more else every[_forest(every[:, : self.width], every[:, self.width :])]
        self.held[more], self.n[more] = [every], len(every)
        return every


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, which the last axis holds."""
    return sum(np.bitwise_count((a[..., i] ^ b[..., i]).view(np.uint64)).astype(np.int64) for i in range(a.shape[-1]))


def _own_key(a: np.ndarray, b: np.ndarray, segments: int) -> np.ndarray:
    """The key under which a pair counts, of those that both enter by balls of one bit: in the first segment with two
    differing bits at most, the value itself if they agree there, else the least that both enter. -1 if there is none."""
    each = segments // a.shape[1]
    out = np.full(len(a), -1)
    for s in reversed(range(segments)):
        low, high = BITS * (s % each) // each, BITS * (s % each + 1) // each
        u, v = ((x[:, s // each].view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << (high - low)) - 1) for x in (a, b))
        apart = u ^ v
        bits = np.bitwise_count(apart)
        one = apart & -apart
        value = np.where(bits == 0, u, np.where(bits == 1, np.minimum(u, v), np.minimum(u ^ one, v ^ one)))
        out = np.where(bits <= 2, value * segments + s, out)
    return out


def _meet(key: np.ndarray, exact: np.ndarray, fp: np.ndarray, radius: int, links: _Links) -> None:
    """Verify what meets under each key: table rows against all rows. Rows are sorted by key; fp has a row a fingerprint."""
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
    size = np.diff(np.r_[start, len(key)])
    tables = np.add.reduceat(exact.astype(np.int64), start)
    two = start[(size == 2) & (tables > 0)]
    two = two[_distance(fp[two], fp[two + 1]) <= radius]
    links.add(key[two, 0], fp[two], fp[two + 1])
    links.add(key[two, 0], fp[two], fp[two + 1], True)
    many = (size > 2) & (tables > 0)
    for i, n in zip(start[many].tolist(), size[many].tolist(), strict=True):
        own, table = fp[i : i + n], np.flatnonzero(exact[i : i + n])
        if n <= SMALL:
            d = _distance(own[table, None], own[None, :])
            x, y = np.nonzero((d <= radius) & (d > 0))
            x = table[x]
            if links.segments:
                x, y = x[x < y], y[x < y]
            links.add(key[i, 0], own[x], own[y])
            links.add(key[i, 0], own[x], own[y], True)
        else:
            _within(key[i, 0], own, table, radius, links)


def _within(key: int, own: np.ndarray, table: np.ndarray, radius: int, links: _Links) -> None:
    """The forest of many rows under one key, and the links to its centres. Table rows come in order of priority, and what is
    already together needs no comparison, so a tight group takes one round.

    Centres are nearest to the bitwise majority: among near copies of one text, that text.
    """
    if links.more:
        bits = np.unpackbits(np.ascontiguousarray(own).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        middle = np.packbits(2 * bits > len(own)).view(np.int64)
        for centre in own[table[np.argsort(_distance(own[table], middle), kind="stable")[:CENTRES]]]:
            d = _distance(own, centre)
            near = own[(d <= radius) & (d > 0)]
            links.add(key, near, np.broadcast_to(centre, near.shape), True)
    place = np.empty(len(own), np.int64)
    place[np.lexsort((*own.T[::-1], _priority(own)))] = np.arange(len(own))
    label = np.arange(len(own))
    for t in table[np.argsort(place[table])]:
        apart = np.flatnonzero(label != label[t])
        if not len(apart):
            break
        apart = apart[_distance(own[t], own[apart]) <= radius]
        if len(apart):
            apart = apart[np.argsort(place[apart])]
            first = apart[np.unique(label[apart], return_index=True)[1]]
            links.add(key, own[first], np.broadcast_to(own[t], own[first].shape))
            label[np.isin(label, label[first])] = label[t]


def links(nodes: DataFrame, radius: int = 3, segments: int = 2, reach: int | None = None) -> DataFrame:
    """(a, b): links whose closure is that of all pairs of distinct fingerprints within ``radius`` bits.

    ``nodes``: fp, which is a node itself, or fp and fp2, whose structs are nodes. Each task gives the spanning forest of what it
    finds. With a ``reach`` beyond the radius, pairs up to there are links if they happen to meet; then all pairs of few rows
    under a key are given, too, and the links of many to their centres. Rows of a key stream through a task in key order, so a
    task holds one key's rows at a time; those are distinct fingerprints, never copies of documents, and keys of very many
    rows are split.
    """
    names = nodes.columns
    most = max(radius, reach or 0)
    twice = radius // segments == 2 and radius % segments == segments - 1  # every segment has balls of one bit on both sides

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rest = _Links(len(names), most > radius, segments if twice else 0), None
        for b in batches:
            col = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            rows = [np.stack([col[0], col[-1]], axis=1), col[1], np.stack(col[2:-1], axis=1)]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.argmax((rows[0] == rows[0][-1]).all(axis=1)))
            rest = [x[last:] for x in rows]
            if last:
                _meet(*(x[:last] for x in rows), most, found)
        if rest is not None and len(rest[0]):
            _meet(*rest, most, found)
        every = np.concatenate([found.reduced(False), found.reduced(True)])
        for i in range(0, len(every), BLOCK):
            cols = [pa.array(np.ascontiguousarray(every[i : i + BLOCK, k])) for k in range(2 * len(names))]
            yield pa.RecordBatch.from_arrays(cols, names=[f"{end}_{c}" for end in "ab" for c in names])

    schema = ", ".join(f"{end}_{c} long" for end in "ab" for c in names)
    some = nodes.where(F.pmod(F.xxhash64(F.lit("some"), *names), F.lit(ONE_IN)) == 0)
    entries = _split(_entries(nodes, radius, segments), _entries(some, radius, segments))
    out = map_arrow(entries.repartition("key", "part").sortWithinPartitions("key", "part"), run, schema)
    node = lambda end: F.col(f"{end}_fp") if len(names) == 1 else F.struct(*[F.col(f"{end}_{c}").alias(c) for c in names])
    return out.select(node("a").alias("a"), node("b").alias("b"))


def _settled(edges: DataFrame) -> DataFrame:
    """What ``stars`` gives, of links (a, b) of longs in one task: only for a bounded number of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.empty((2, 0), np.int64), *(np.stack([c.to_numpy() for c in b.columns]) for b in batches)]
        nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
        x, y = at.reshape(2, -1)
        root = _joined(np.arange(len(nodes)), x, y)
        other = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[root[other]])], names=["node", "root"])

    return map_arrow(edges.coalesce(1), run, "node long, root long")


def _named(rows: DataFrame, key: str, nodes: DataFrame, star: DataFrame, keep: Callable[[DataFrame, int], DataFrame] = lambda df, most: cut(df)) -> DataFrame:
    """(id, key, component) of rows: each node's component's smallest id. ``nodes``: key, id, k (rows of the node). ``keep`` cuts
    tables of a bounded number of rows."""
    n_nodes = nodes.count()
    rooted = keep(nodes.join(star, F.col(key) == F.col("node"), "left").select(key, "id", "k", F.coalesce("root", key).alias("root")), n_nodes)
    least = keep(rooted.groupBy("root").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("_k")), n_nodes)
    named = keep(matched(rooted, least, "root", "_k", n_nodes, n_nodes).select(key, "component", "k"), n_nodes)
    return matched(rows, named, key, "k", rows.count(), n_nodes)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, segments: int = 2, distinct: bool = False, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """One row per input row: (id, fp, component), component being the smallest id reachable over links.

    Fingerprints link at ``radius`` or fewer differing bits. Null and word-less texts have fingerprint zero, linked like any other. A null id takes part but never
    names a component, unless all its ids are null. Repeated rows come back repeated; other columns are ignored; an empty
    table gives an empty result.
    """
    fps = fingerprints(docs, id_col, text_col, words, distinct, seeds)
    names = fps.columns[1:]
    node = F.col("fp") if len(names) == 1 else F.struct(*names)
    fps = cut(fps.select("id", node.alias("own")))
    nodes = cut(fps.groupBy("own").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k")))
    star = stars(links(nodes.select("own" if len(names) == 1 else "own.*").toDF(*names), radius, segments))
    out = _named(fps, "own", nodes, star)
    return out.select("id", F.col("own").alias("fp") if len(names) == 1 else "own.*", "component")


def shingles(text: bytes | None, words: int) -> set[bytes]:
    """Distinct shingles of a text, A-Z lower-cased; of fewer words, the whole sequence; of none, one empty one."""
    ws = (text or b"").lower().split()
    if len(ws) < words:
        return {b" ".join(ws)}
    return {b" ".join(ws[i : i + words]) for i in range(len(ws) - words + 1)}


def verified(edges: DataFrame, docs: DataFrame, text_col: str, words: int, least: float, most: int | None = None) -> DataFrame:
    """The stored edges (a, b), by texts' 64-bit hashes, whose texts' sets of shingles have a Jaccard similarity of ``least`` or more.

    Only texts at an edge's end are kept; there are ``most`` at most, if given. A centre, which is ``b`` in its edges, has its text repeated for each ``each`` of
    them, so that not all of their texts gather in one task.
    """
    each = 1024
    total = edges.count()
    most = 2 * total if most is None else most
    degree = cut_few(edges.groupBy("b").agg(F.count(F.lit(1)).alias("k")).withColumn("salts", F.ceil(F.col("k") / each).cast("long")), most)
    need = cut_few(edges.select(F.col("a").alias("h"), F.lit(0).cast("long").alias("salts")).union(degree.select("b", "salts")).groupBy("h").agg(F.max("salts").alias("salts")), most)
    texts = docs.select(F.xxhash64(text_col).alias("h_"), F.col(text_col).cast("binary").alias("t"))
    texts = stored(texts.join(need, F.col("h_") == F.col("h")).groupBy("h", "salts").agg(F.first("t").alias("t")), "texts")
    two = texts.where("salts > 0").select(F.col("h").alias("b"), F.col("t").alias("two"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    dealt = matched(edges, degree, "b", "k", total).select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"))
    salted = dealt.join(texts.select(F.col("h").alias("a"), F.col("t").alias("one")), "a")
    met = salted.join(two, ["b", "salt"]).select("a", "b", "one", "two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for one, two in zip(b.column(2), b.column(3), strict=True):
                x, y = shingles(one.as_py(), words), shingles(two.as_py(), words)
                both = len(x & y)
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_arrow(met, run, "a long, b long")


def _hashes(text: bytes | None, words: int) -> np.ndarray:
    """Distinct hashes of a text's shingles in order: equal shingles have equal ones."""
    ws = (text or b"").lower().split()
    w = np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))
    many = min(words, len(ws))
    h = np.zeros(len(ws) - many + 1, np.uint64)
    for i in range(many):
        h = (h ^ (h >> np.uint64(29))) * MIX + w[i : i + len(h)]
    h = (h ^ (h >> np.uint64(32))) * MIX
    return np.unique(h ^ (h >> np.uint64(29)))


def _prefix(h: np.ndarray, least: float, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of a text's hashes, in an order that is the same for all texts: two texts alike by ``least`` share one of them.

    They share at least ``least`` of each one's hashes, so the first that they share has no more than the rest before it. The
    order is that of the hashes, but ``frequent`` ones come last, by ``rank``.
    """
    size = len(h) - max(1, int(np.ceil(least * len(h) - 1e-6))) + 1
    if not len(frequent):
        return h[:size]
    at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
    often = frequent[at] == h
    rare = h[~often]
    if len(rare) >= size:
        return rare[:size]
    return np.concatenate([rare, h[often][np.argsort(rank[at[often]])]])[:size]


def _possible(key: np.ndarray, place: np.ndarray, size: np.ndarray, label: np.ndarray, least: float) -> np.ndarray:
    """Which rows share their key with one of another label that may be alike, as far as the places of the hash they share
    tell. Rows are sorted by key. A row is compared until one such is found."""
    change = np.r_[True, key[1:] != key[:-1]]
    which, start = np.cumsum(change) - 1, np.flatnonzero(change)
    first, end = start[which], np.r_[start[1:], len(key)][which]
    out = np.zeros(len(key), bool)
    left, apart = np.arange(len(key)), 1
    while len(left := left[~out[left] & ((left + apart < end[left]) | (left - apart >= first[left]))]):
        for x, y in ((left, left + apart), (left, left - apart)):
            inside = (y < end[x]) & (y >= first[x])
            x, y = x[inside], y[inside]
            both = np.minimum(size[x] - place[x], size[y] - place[y])
            met = (label[x] != label[y]) & (both * (1 + least) >= least * (size[x] + size[y]) - 1e-6)
            out[x[met]] = out[y[met]] = True
        apart += 1
    return out


def _gathered(key: np.ndarray, node: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of each key, sorted by key, whose nodes are to be compared: of more than ``WIDE``, each two blocks of half as many."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for i, n in zip(start.tolist(), np.diff(np.r_[start, len(key)]).tolist(), strict=True):
        rows = i + np.argsort(node[i : i + n])
        if n <= WIDE:
            yield rows
        else:
            for one, two in combinations([rows[k : k + WIDE // 2] for k in range(0, n, WIDE // 2)], 2):
                yield np.concatenate([one, two])


def _marks(h: np.ndarray) -> bytes:
    """A text's number of hashes modulo two at each of some places, two to four times as many as there are hashes: those of two
    texts differ in no more places than their sets do. Both halves' exclusive or are those of half as many places."""
    width = min(1 << 16, max(512, 1 << int(2 * len(h) - 1).bit_length()))
    odd = np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _unlike(marks: list[bytes], size: np.ndarray, label: np.ndarray, least: float) -> np.ndarray:
    """Which texts of a group are not alike by ``least`` to any of another label, as their ``_marks`` show. Places of texts that
    can be alike by 0.5 or more differ by a factor of two at most."""
    places, out = np.array([len(m) for m in marks]), np.ones(len(marks), bool)
    for w in np.unique(places):
        rows = np.flatnonzero((places == w) | (places == 2 * w))
        own = np.stack([np.bitwise_xor.reduce(np.frombuffer(marks[i], np.int64).reshape(-1, w // 8), axis=0) for i in rows])
        for i in np.flatnonzero(out[rows]):
            near = _distance(own, own[i]) * (1 + least) <= (1 - least) * (size[rows] + size[rows[i]]) + 1e-6
            near &= label[rows] != label[rows[i]]
            if near.any():
                out[rows[near]] = out[rows[i]] = False
    return out


def _alike(texts: list[bytes | None], label: np.ndarray, words: int, least: float) -> Iterator[tuple[int, int]]:
    """Links of texts alike by ``least`` that join all labels of which two such texts are.

    The bits of two texts' hash counts, taken modulo two, differ in no more places than their sets do, which rules most pairs
    out. Texts nearest to the bitwise majority come first, and what is already together is not compared, so near copies of
    one text take few comparisons.
    """
    sets = [_hashes(t, words) for t in texts]
    size = np.array([len(h) for h in sets])
    width = min(1 << 13, max(64, 1 << int(2 * size.max() - 1).bit_length()))
    odd = np.stack([np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1 for h in sets]).astype(bool)
    marks = np.packbits(odd, axis=1).view(np.int64)
    middle = np.packbits(2 * odd.sum(axis=0) > len(sets)).view(np.int64)
    label, todo = label.copy(), np.ones(len(sets), bool)
    for t in np.argsort(_distance(marks, middle), kind="stable").tolist():
        todo[t] = False
        apart = np.flatnonzero(label != label[t])
        if not len(apart):
            return
        apart = apart[todo[apart]]
        differ = _distance(marks[apart], marks[t])
        may = differ * (1 + least) <= (1 - least) * (size[apart] + size[t]) + 1e-6
        for u in apart[may][np.argsort(differ[may], kind="stable")].tolist():
            if label[u] == label[t]:
                continue
            both = len(np.intersect1d(sets[t], sets[u], assume_unique=True))
            if both * (1 + least) < least * (size[t] + size[u]) - 1e-6:
                continue
            x, y = shingles(texts[t], words), shingles(texts[u], words)
            both = len(x & y)
            if both >= least * (len(x) + len(y) - both):
                yield t, u
                label[label == label[u]] = label[t]


def _sample(docs: DataFrame, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles' hashes in order, and in how many texts each is, estimated from a sample."""
    some = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t")).where(F.pmod(F.xxhash64(F.lit("some"), "h"), F.lit(COUNTED)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(t.as_py(), words).view(np.int64))], names=["key"])

    counts, _ = counted(map_arrow(some.groupBy("h").agg(F.first("t").alias("t")).select("t"), run, "key long").groupBy("key").count().where("count > 1"))
    least, n = 1 << 62, 0
    for r in sorted(counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        n += r["n"]
        if n > FREQUENT:
            break
        least = r["count"]
    top = counts.where(F.col("count") >= least).collect()
    keys, n = np.array([r["key"] for r in top], np.int64).view(np.uint64), np.array([r["count"] for r in top], np.int64)
    order = np.argsort(keys)
    return keys[order], n[order] * COUNTED


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Table]]:
    """Rows sorted by their first column, as lists of the tables that agree in it."""
    rest = None
    for b in batches:
        now = pa.Table.from_batches([b])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        if not len(now):
            continue
        group = now.column(0).to_numpy()
        start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist()
        rest = now.slice(start[-1])
        if len(start) > 1:
            yield [now.slice(i, j - i) for i, j in zip(start, start[1:], strict=False)]
    if rest is not None:
        yield [rest]


def alike_besides(docs: DataFrame, edges: DataFrame, text_col: str, words: int, least: float) -> DataFrame:
    """(a, b): links, by texts' 64-bit hashes, that with the stored edges (a, b) connect all pairs of texts whose Jaccard similarity is
    ``least`` or more.

    Each distinct text is entered under the hashes of its ``_prefix``, so that two that are alike meet under one. Texts of a
    key that may be alike, by their sizes and the places of that hash in them, are a group; the same group under several keys
    is one. A task that has a group's ``_marks`` drops whatever they show to be unlike the rest; another has the texts, and
    gives the links of a forest. So rows are texts in a group, never pairs.
    Texts with the same least neighbour are connected, so they are not compared. Keys of very many texts are split.
    """
    frequent, number = _sample(docs, text_col, words)
    rank = np.empty(len(number), np.int64)
    rank[np.lexsort((frequent, number))] = np.arange(len(number))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            size, found = [], []
            for t in b.column(1):
                h = _hashes(t.as_py(), words)
                size.append(len(h))
                found.append(_prefix(h, least, frequent, rank).view(np.int64))
            offsets = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), lists], names=["h", "size", "keys"])

    source = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).cast("binary").alias("t"))
    each = map_arrow(source, prefixes, "h long, size long, keys array<long>").groupBy("h").agg(F.first(F.struct("size", "keys")).alias("p"))
    both = edges.union(edges.select("b", "a")).groupBy(F.col("a").alias("h")).agg(F.least(F.col("a"), F.min("b")).alias("root"))
    rows = each.join(both, "h", "left").select("h", "root", "p.size", F.posexplode("p.keys").alias("place", "key"))
    entries = rows.select("key", F.shiftleft("size", 32).bitwiseOR(F.col("place").cast("long")).alias("at"), "h", "root")
    large = number > PART
    entries = _parted(entries, list(zip(frequent[large].view(np.int64).tolist(), (-(-number[large] // PART)).tolist(), strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def met(key: np.ndarray, part: np.ndarray, at: np.ndarray, node: np.ndarray, label: np.ndarray) -> Iterator[pa.RecordBatch]:
            which = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])]) - 1
            several = np.bincount(which)[which] > 1
            which, at, node, label = (x[several] for x in (which, at, node, label))
            may = _possible(which, at & ((1 << 32) - 1), at >> 32, label, least)
            which, node, label = (x[may] for x in (which, node, label))
            if not len(which):
                return
            groups = list(_gathered(which, node))
            for i in range(0, len(groups), BLOCK // WIDE):
                some = groups[i : i + BLOCK // WIDE]
                names = np.array([xxhash.xxh64_intdigest(node[g].tobytes()) for g in some], np.uint64).view(np.int64)
                rows = np.concatenate(some)
                cols = [np.repeat(names, [len(g) for g in some]), node[rows], label[rows]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["met", "h", "root"])

        for b in batches:
            key, at, node, part = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
            label = np.where(b.column(3).is_null().to_numpy(zero_copy_only=False), node, b.column(3).fill_null(0).to_numpy(zero_copy_only=False))
            now = [key, part, at, node, label]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            last = int(np.argmax((now[0] == now[0][-1]) & (now[1] == now[1][-1])))
            rest = [x[last:] for x in now]
            if last:
                yield from met(*(x[:last] for x in now))
        if rest is not None and len(rest[0]):
            yield from met(*rest)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [_hashes(t.as_py(), words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(map(_marks, sets), pa.binary())], names=["h", "size", "marks"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            out = [np.empty((0, 3), np.int64)]
            for g in rows:
                node, label, size = (g.column(i).to_numpy() for i in (1, 2, 3))
                keep = ~_unlike(g.column(4).to_pylist(), size, label, least)
                if keep.any():
                    name = np.uint64(xxhash.xxh64_intdigest(node[keep].tobytes())).astype(np.int64)
                    out.append(np.stack([np.full(int(keep.sum()), name), node[keep], label[keep]], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(out).T], names=["met", "h", "root"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            pairs = []
            for g in rows:
                node, label = (g.column(i).to_numpy() for i in (1, 2))
                pairs += [(node[t], node[u]) for t, u in _alike(g.column(3).to_pylist(), label, words, least)]
            cols = np.array(pairs, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=["a", "b"])

    members, n = counted(map_arrow(entries.repartition("key", "part").sortWithinPartitions("key", "part"), run, "met long, h long, root long").distinct())
    texts = source.join(members.select(F.col("h").alias("h_")).distinct(), F.col("h") == F.col("h_")).groupBy("h").agg(F.first("t").alias("t"))
    texts = stored(texts, "met")
    grouped = lambda rows, values: rows.join(values, "h").select("met", "h", "root", *values.columns[1:]).repartition("met").sortWithinPartitions("met", "h")
    members = cut_few(map_arrow(grouped(members, map_arrow(texts, marked, "h long, size long, marks binary")), near, "met long, h long, root long").distinct(), n)
    return map_arrow(grouped(members, texts), compared, "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, radius: int = 11, segments: int = 4, reach: int = 20, seeds: tuple[int, ...] = (42, 43)) -> DataFrame:
    """One row per input row: (id, component), component being the smallest id reachable over texts alike by ``least``.

    Two texts link if the Jaccard similarity of their sets of ``words``-word shingles is ``least`` or more; no such pair is left
    out. First candidates are the links of 128-bit fingerprints of distinct words, complete up to ``radius`` bits and taken up to
    ``reach``; of links among many that meet, those of a spanning forest and those to its centres. They bring most of what is
    alike together, and ``alike_besides`` gives the links that connect all other such pairs. Equal texts are one node; null texts, and
    texts without a word, are alike. A null id takes part but never names a component, unless all its ids are null. Repeated rows come back
    repeated; other columns are ignored; an empty table gives an empty result.
    """
    source = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h")).alias("row"), F.col(text_col).alias("t"))
    prints = cut(fingerprints(source, "row", "t", 1, True, seeds).select(F.col("id.id").alias("id"), F.col("id.h").alias("h"), F.struct("fp", "fp2").alias("own")))
    nodes = cut_few(prints.groupBy("h").agg(F.min("id").alias("id"), F.first("own").alias("own"), F.count(F.lit(1)).alias("k")), prints.count())
    n = nodes.count()
    classes = cut_few(nodes.groupBy("own").agg(F.min("h").alias("first"), F.count(F.lit(1)).alias("size")), n)
    found, n_found = counted(links(classes.select("own.*"), radius, segments, reach).distinct())
    centres = cut_few(found.groupBy("b").agg(F.count(F.lit(1)).alias("size")).join(classes.select(F.col("own").alias("b"), F.col("first").alias("to")), "b"), n)
    between = matched(found, centres, "b", "size", n_found).join(classes.select(F.col("own").alias("a"), "first"), "a").select(F.col("first").alias("a"), F.col("to").alias("b"))
    inside = matched(nodes.select("h", "own"), classes, "own", "size", n).where("h <> first").select(F.col("h").alias("a"), F.col("first").alias("b"))
    candidates = cut_few(between.union(inside), n_found + n)
    alike = cut_few(verified(candidates, docs, text_col, words, least, n), n_found + n)
    edges, n_edges = counted(alike.union(alike_besides(docs, alike, text_col, words, least)))
    star = _settled(edges) if n_edges <= FEW else stars(edges)
    return _named(prints.select("id", "h"), "h", nodes.select("h", "id", "k"), star, cut_few).select("id", "component")
