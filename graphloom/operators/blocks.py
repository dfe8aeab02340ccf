"""Blocks of packed vectors that meet in tasks: all pairs are looked at, in bounded memory, and only what is asked for leaves.

Rows are packed into chunks of bytes, as floats where that loses nothing. A task holds one block of a bounded size and reads the
chunks that it meets one by one. Similarities are products in single precision first, which rule out whatever is below the
limit by more than their largest error; what is left is computed in double precision. As in SQL, a similarity that is no
number counts as larger than any.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import map_arrow

#: Rows of a chunk.
CHUNK_ROWS = 1024
#: Rows of a block that a task holds, and its bytes in doubles, at most.
BLOCK_ROWS, BLOCK_BYTES = 1 << 15, 1 << 24
#: Best hits of all queries that a task holds.
HITS = 1 << 20
#: Similarities held at once: rows of the block times those of a chunk.
STEP_ROWS, STEP_COLUMNS = 2048, 256
#: Pairs whose vectors are laid side by side at once.
PAIRS = 1 << 15
#: Tasks are not made smaller than so many similarities, nor more than so many for each that runs at once.
TASK_CELLS, TASKS_A_CORE = 1 << 26, 8

CHUNK = "g string, part long, dim int, ids binary, v binary"


def dense(v: pa.Array) -> np.ndarray:
    """A list array as a matrix; shorter rows are filled up with zeros, and null components are zeros, too."""
    sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten()
    x = (pc.fill_null(flat, 0) if flat.null_count else flat).to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    dim = int(sizes.max(initial=0))
    if (sizes == dim).all():
        return x.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    at = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = x
    return out


def _bytes(m: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        f = m.astype(np.float32)
    return (f if (f == m).all() else m).tobytes()


def _unpacked(dim: int, ids: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(v, np.float32 if len(v) < 8 * dim * len(i) else np.float64).reshape(len(i), dim).astype(np.float64)


def _pack(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        g, part, ids, m = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(), dense(b.column(3))
        code = pc.fill_null(g.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (code[1:] != code[:-1])]) if len(ids) else np.empty(0, np.int64)
        cuts = [(x, min(x + rows, end)) for a, end in zip(starts, [*starts[1:], len(ids)], strict=True) for x in range(a, end, rows)]
        first = pa.array([a for a, _ in cuts], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [g.take(first), b.column(1).take(first), pa.array([m.shape[1]] * len(cuts), pa.int32()), pa.array([ids[a:e].tobytes() for a, e in cuts], pa.binary()), pa.array([_bytes(m[a:e]) for a, e in cuts], pa.binary())],
            names=["g", "part", "dim", "ids", "v"],
        )


def large_groups(df: DataFrame, rows: int) -> dict[str | None, tuple[int, int]]:
    """Rows and most dimensions of each group of more than ``rows``, of which there are few."""
    found = df.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).where(F.col("n") > rows)
    return {r["g"]: (r["n"], max(1, r["dim"])) for r in found.collect()}


def _chunks(df: DataFrame, large: dict, layout: list[tuple], names: str, chunk: int) -> DataFrame:
    """``df`` (g, id, v) as chunks of one block each, with what ``layout`` (g first, then its blocks, then ``names``) knows of the group."""
    rows = [(*row, max(row[1], -(-large.get(row[0], (0, 0))[0] // chunk))) for row in layout]
    listed = F.array(*[F.struct(*map(F.lit, row)) for row in rows]).cast(f"array<struct<g_: string, blocks: long{names}, deals: long>>")
    known = F.broadcast(df.sparkSession.range(1).select(F.inline(listed)))
    own = F.col("g").eqNullSafe(F.col("g_"))
    deal = F.pmod(F.xxhash64("id"), F.coalesce("deals", F.lit(1)))
    dealt = df.join(known, own, "left").withColumn("deal", deal).withColumn("part", F.pmod("deal", F.coalesce("blocks", F.lit(1))))
    dealt = dealt.repartition("g", "deal").sortWithinPartitions("g", "part").select("g", "part", "id", "v")
    return map_arrow(dealt, lambda batches: _pack(batches, chunk), CHUNK).join(known, own, "left").drop("g_", "deals")


def _wanted(df: DataFrame, cells: float) -> int:
    return max(1, min(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / TASK_CELLS)))


def _most_rows(most: int, dim: int, k: int = 1) -> int:
    return max(1, min(most, BLOCK_BYTES // (8 * dim), HITS // k))


def _met(chunks: DataFrame, tasks: int, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """Chunks (g, x, y, side, ..., task) come together by g, x and y, those of side 0 first."""
    n = max(tasks, chunks.sparkSession.sparkContext.defaultParallelism)
    task = F.pmod(F.coalesce(F.col("task"), F.xxhash64("g")), F.lit(n)).cast("int")
    own = chunks.select("g", "x", "y", "side", "dim", "ids", "v", task.alias("task"))
    return map_arrow(own.repartitionById(n, F.col("task")).sortWithinPartitions("g", "x", "y", "side").drop("task"), fn, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list | None, tuple | None]]:
    """(key, held chunks or None, chunk or None): held ones once, before the first that they meet; at last a pair of nulls for each key that had both."""
    key, held, open_ = None, [], False
    for b in batches:
        for r in range(b.num_rows):
            g, x, y, side, dim, ids, v = (c[r].as_py() for c in b.columns)
            if (g, x, y) != key:
                if open_:
                    yield key, None, None
                key, held, open_ = (g, x, y), [], False
            if side == 0:
                held.append(_unpacked(dim, ids, v))
            elif held or open_:
                if not open_:
                    yield key, held, None
                    held, open_ = [], True
                yield key, None, _unpacked(dim, ids, v)
    if open_:
        yield key, None, None


def _stacked(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    dim = max(m.shape[1] for _, m in parts)
    wide = [np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m for _, m in parts]
    return np.concatenate([i for i, _ in parts]), np.concatenate(wide)


def _where(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a mask with few trues: whole words of falses are passed over."""
    flat = np.ascontiguousarray(mask).reshape(-1)
    whole = len(flat) & ~7
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    at = (words[:, None] * 8 + np.arange(8)).reshape(-1)
    at = np.r_[at[flat[at]], whole + np.flatnonzero(flat[whole:])]
    return np.divmod(at, mask.shape[1])


class Side:
    """Rows of a block or a chunk, in both precisions."""

    def __init__(self, ids: np.ndarray, v: np.ndarray) -> None:
        self.ids, self.v = ids, v
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            self.most = float(self.norm.max(initial=0.0))
            self.f = v.astype(np.float32)

    def against(self, other: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own and other rows to multiply, over the shorter length, and by how much a product of each own row can be wrong."""
        d = min(self.v.shape[1], other.v.shape[1])
        with np.errstate(all="ignore"):
            if self.most < 1e15 and other.most < 1e15:  # false of what is no number
                return self.f[:, :d], other.f[:, :d], (d + 8) * (1.2e-7 * self.norm * other.most + 1e-37 * (1 + self.most + other.most))
            return self.v[:, :d], other.v[:, :d], (d + 8) * 2.3e-16 * self.norm * other.most

    def exact(self, i: np.ndarray, other: Side, j: np.ndarray) -> np.ndarray:
        d, out = min(self.v.shape[1], other.v.shape[1]), np.empty(len(i))
        with np.errstate(all="ignore"):
            for a in range(0, len(i), PAIRS):
                out[a : a + PAIRS] = np.einsum("ij,ij->i", self.v[i[a : a + PAIRS], :d], other.v[j[a : a + PAIRS], :d])
        return out


def _steps(a: int, b: int) -> Iterator[tuple[slice, slice]]:
    for c in range(0, b, STEP_COLUMNS):
        for r in range(0, a, STEP_ROWS):
            yield slice(r, min(a, r + STEP_ROWS)), slice(c, min(b, c + STEP_COLUMNS))


class Best:
    """The k best of each query among the rows that it has seen, equal ones by id.

    With ``tables``, so many last components of each vector are buckets: rows take part that share one with the query at the
    same place and lie nearer than ``radius``.
    """

    def __init__(self, ids: np.ndarray, v: np.ndarray, k: int, tables: int = 0, radius: float = math.inf) -> None:
        self.k, self.tables, self.radius = k, tables, radius
        self.buckets = v[:, v.shape[1] - tables :]
        self.q = Side(ids, np.ascontiguousarray(v[:, : v.shape[1] - tables]))
        self.limit, self.last = np.full(len(ids), -np.inf), np.full(len(ids), np.iinfo(np.int64).max)
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]  # query, id, similarity
        self.waiting = 0

    def see(self, ids: np.ndarray, v: np.ndarray) -> None:
        buckets, side = v[:, v.shape[1] - self.tables :], Side(ids, np.ascontiguousarray(v[:, : v.shape[1] - self.tables]))
        a, b, wrong = self.q.against(side)
        for r, c in _steps(len(a), len(b)):
            with np.errstate(all="ignore"):
                s = a[r] @ b[c].T
                limit = self.limit[r] - wrong[r]
                if self.tables:
                    shared = np.zeros(s.shape, bool)
                    for t in range(self.tables):
                        shared |= self.buckets[r, t, None] == buckets[None, c, t]
                    s[~shared] = -np.inf
                    maybe = shared & ~(s < limit[:, None])
                    i, j = _where(maybe)
                else:
                    new = np.flatnonzero(np.isneginf(self.limit[r]))
                    if len(new) and s.shape[1] > self.k:  # the k-th best of the first ones bounds the rest
                        some = np.partition(np.where(np.isnan(s[new]), np.inf, s[new]), s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                        limit[new] = some - 2 * wrong[r][new]
                    rows = np.flatnonzero(~(s.max(axis=1) < limit))
                    i, j = _where(~(s[rows] < limit[rows, None]))
                    i = rows[i]
            if len(i):
                self._take(i + r.start, side, j + c.start)

    def _take(self, i: np.ndarray, side: Side, j: np.ndarray) -> None:
        sim = self.q.exact(i, side, j)
        key = np.where(np.isnan(sim), np.inf, sim)
        good = (key > self.limit[i]) | ((key == self.limit[i]) & (side.ids[j] < self.last[i]))
        if self.radius < math.inf:
            for a in range(0, len(i), PAIRS):
                apart = self.q.v[i[a : a + PAIRS]] - side.v[j[a : a + PAIRS]]
                good[a : a + PAIRS] &= np.sqrt(np.einsum("ij,ij->i", apart, apart)) < self.radius
        self.kept.append((i[good], side.ids[j[good]], sim[good]))
        self.waiting += int(good.sum())
        if self.waiting > max(1 << 16, self.k * len(self.limit)):
            self._settle()

    def _settle(self) -> None:
        i, ids, sim = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        key = np.where(np.isnan(sim), np.inf, sim)
        order = np.lexsort((ids, -key, i))
        i = i[order]
        first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
        rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
        keep = rank < self.k
        order, i, rank = order[keep], i[keep], rank[keep]
        self.kept, self.waiting = [(i, ids[order], sim[order])], 0
        full = rank == self.k - 1
        self.limit[i[full]], self.last[i[full]] = key[order][full], ids[order][full]

    def found(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        i, ids, sim = self.kept[0]
        for a in range(0, len(i), 1 << 16):
            e = a + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(self.q.ids[i[a:e]]), pa.array(ids[a:e]), pa.array(sim[a:e])], names=["query_id", "id", "sim"])


FOUND = "query_id long, id long, sim double"


def best_of_blocks(v: DataFrame, q: DataFrame, k: int, tables: int = 0, radius: float = math.inf, most: int = BLOCK_ROWS, chunk: int = CHUNK_ROWS) -> DataFrame:
    """(query_id, id, sim): each query's k best rows of its group, by task. ``v``, ``q``: g, id, v. A task holds ``most`` queries."""
    small = min(2 * chunk, most)
    rows, asked = large_groups(v, small), large_groups(q, small)
    layout, tasks = [], 0
    for g in sorted({*rows, *asked}, key=str):
        (n, dim), (m, wide) = rows.get(g, (small, 1)), asked.get(g, (small, 1))
        across = -(-m // _most_rows(most, max(dim, wide), k))
        down = max(1, min(-(-n // chunk), -(-_wanted(v, n * m) // across)))
        layout.append((g, across, down, tasks))
        tasks += across * down
    task = F.col("at") + F.col("x") * F.coalesce("down", F.lit(1)) + F.col("y")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(c, F.lit(1)) - 1))
    held = _chunks(q, asked, layout, ", down: long, at: long", chunk).withColumn("x", F.col("part")).withColumn("y", every("down")).withColumn("side", F.lit(0))
    swapped = [(g, down, across, at) for g, across, down, at in layout]
    read = _chunks(v, rows, swapped, ", across: long, at: long", chunk).withColumn("y", F.col("part")).withColumn("x", every("across")).withColumn("side", F.lit(1)).withColumn("down", F.col("blocks"))
    cols = ["g", "x", "y", "side", "dim", "ids", "v", "down", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for _, block, chunk in _blocks(batches):
            if block is not None:
                best = Best(*_stacked(block), k, tables, radius)
            elif chunk is not None:
                best.see(*chunk)
            else:
                yield from best.found()

    return _met(held.select(cols).unionByName(read.select(cols)).withColumn("task", task), tasks, run, FOUND)


def best_of_few(v: DataFrame, ids: np.ndarray, own: np.ndarray, k: int, tables: int = 0, radius: float = math.inf) -> DataFrame:
    """The same for few queries, which every task holds; ``v`` (id, v) is not moved."""
    sent = v.sparkSession.sparkContext.broadcast((ids, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*sent.value, k, tables, radius)
        for b in batches:
            best.see(b.column(0).to_numpy(), dense(b.column(1)))
        yield from best.found()

    return map_arrow(v, run, FOUND)


def pairs_of_blocks(v: DataFrame, threshold: float) -> DataFrame:
    """(id, earlier, sim) of all pairs in a group that are similar by ``threshold``, the smaller id second. ``v``: g, id, v."""
    rows, layout, tasks = large_groups(v, 2 * CHUNK_ROWS), [], 0
    for g in sorted(rows, key=str):
        n, dim = rows[g]
        wanted = _wanted(v, n * n / 2)
        parts = min(-(-n // CHUNK_ROWS), max(-(-n // _most_rows(BLOCK_ROWS, dim)), math.ceil(math.sqrt(2 * wanted)) if wanted > 1 else 1))
        layout.append((g, parts, tasks))
        tasks += parts * (parts + 1) // 2
    chunks, p = _chunks(v, rows, layout, ", at: long", CHUNK_ROWS), F.col("part")
    place = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    held = F.transform(F.sequence(p, F.coalesce("blocks", F.lit(1)) - 1), lambda y: place(p, y, 0))
    read = F.transform(F.sequence(F.lit(0).cast("long"), p), lambda x: place(x, p, 1))
    chunks = chunks.withColumn("z", F.explode(F.concat(held, read))).select("*", "z.*")
    task = F.col("at") + F.shiftright(F.col("y") * (F.col("y") + 1), 1) + F.col("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for (_, x, y), block, chunk in _blocks(batches):
            if block is not None:
                own = Side(*_stacked(block))
            elif chunk is not None:
                yield from _similar(own, Side(*chunk), threshold, x == y)

    return _met(chunks.withColumn("task", task), tasks, run, "id long, earlier long, sim double")


def near(own: Side, other: Side, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(own row, other row, similarity) of all that are similar by ``threshold``, a bounded number at once."""
    a, b, wrong = own.against(other)
    for r, c in _steps(len(a), len(b)):
        with np.errstate(all="ignore"):
            i, j = _where(~(a[r] @ b[c].T < (threshold - wrong[r])[:, None]))
        i, j = i + r.start, j + c.start
        sim = own.exact(i, other, j)
        keep = ~(sim < threshold)
        if keep.any():
            yield i[keep], j[keep], sim[keep]


def _similar(own: Side, other: Side, threshold: float, within: bool) -> Iterator[pa.RecordBatch]:
    for i, j, sim in near(own, other, threshold):
        ids, others = own.ids[i], other.ids[j]
        apart = ids > others if within else ids != others
        if apart.any():
            ids, others = ids[apart], others[apart]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(ids, others)), pa.array(np.minimum(ids, others)), pa.array(sim[apart])], names=["id", "earlier", "sim"])
