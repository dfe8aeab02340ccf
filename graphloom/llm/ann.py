"""Approximate nearest neighbours by inner product: inverted lists scanned in blocks of rotated dimensions.

Vectors get one more dimension that makes all norms equal, so that the largest inner product is the smallest distance, and
are rotated at random, so that a distance over the first dimensions estimates the whole one. A query probes the lists
with the nearest centres. Its nearest list gives a threshold; in the others, candidates are compared block by block, and a
hypothesis test after each block abandons those whose partial distance is too large for the threshold. Scores of the
survivors are computed on the original vectors, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut, map_arrow, ship

#: Ends of the blocks of dimensions; the last block has all the rest.
BLOCKS = (16, 32, 48, 96, 192, 384, 768)
#: The test abandons at a partial distance of (1 + EPSILON / sqrt(dimensions)) times the scaled threshold.
EPSILON = 2.1
#: Pairs of which partial distances are held at once.
PAIRS = 1 << 20
#: Rows of a list that one task scans, and queries that it scans them for.
CHUNK, QUERIES = 8192, 8192
#: The first list of a query is scanned alone, then those up to the second number, then the rest.
WAVES = (1, 4)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows with an id and a vector that isn't empty, zero, or holding null or non-finite components."""
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return v.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")


@dataclass
class Index:
    """What every task needs to know; its size is bounded by the number of lists and of dimensions."""

    dim: int
    norm2: float  # of the longest vector
    rotation: np.ndarray
    centres: np.ndarray  # rotated
    rows: np.ndarray | None = None  # of each list
    probes: int = 1

    def turned(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        """Vectors with the added dimension (0 for queries), rotated."""
        extra = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.norm2 - (v * v).sum(axis=1), 0))
        return np.column_stack([v, extra]) @ self.rotation

    def nearest(self, turned: np.ndarray, n: int = 1) -> np.ndarray:
        """The n nearest lists of each rotated vector, nearest first."""
        d = (self.centres**2).sum(axis=1) - 2 * turned @ self.centres.T
        return np.argsort(d, axis=1, kind="stable")[:, :n] if n > 1 else d.argmin(axis=1)[:, None]


def _stack(v: pd.Series | pa.Array, dim: int) -> np.ndarray:
    if isinstance(v, pa.Array):
        return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.empty((0, dim))


def _centres(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), n, replace=False)]
    for _ in range(rounds):
        own = ((c * c).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        count = np.bincount(own, minlength=n)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], x[rng.choice(len(x), n)])
    return c


def train(v: DataFrame, list_rows: int = 1024, most_lists: int = 16_384, sample: int = 20_000) -> Index | None:
    """Centres from a hash sample of about ``sample`` rows, or eight a list if that is more. None for an empty table.

    There is a list for each ``list_rows`` rows, up to ``most_lists``, a bound on what is broadcast. Rows whose vectors don't have the most frequent number of dimensions take no part.
    """
    sizes = v.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return None
    dim, n, norm2 = sizes["d"], sizes["n"], sizes["m"]
    rotation = np.linalg.qr(np.random.default_rng(11).standard_normal((dim + 1, dim + 1)))[0]
    index = Index(dim, norm2, rotation, np.empty((0, dim + 1)))
    lists = max(1, min(most_lists, round(n / list_rows)))
    sample = max(sample, 8 * lists)
    cells = 1 << 40
    some = v.where(F.size("v") == dim).where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(cells)) < min(cells, -(-sample * cells // n))).select("v").limit(2 * sample)
    x = index.turned(_stack(some.toArrow().column("v").combine_chunks(), dim))
    if not len(x):
        x = index.turned(np.array([v.where(F.size("v") == dim).first()["v"]]))
    index.centres = _centres(x, min(lists, len(x)))
    return index


def _top(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the k first of their q, by falling score and rising id."""
    order = np.lexsort((ids, -score, q))
    q = q[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]


def scan(index: Index, qid: np.ndarray, qv: np.ndarray, least: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best of the given vectors with a score of ``least`` or more."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    x = index.turned(v)
    ends = [b for b in BLOCKS if b < index.dim + 1] + [index.dim + 1]
    step = max(1, PAIRS // max(1, len(ids)))
    for a in range(0, len(qid), step):
        q, low = index.turned(qv[a : a + step], query=True), least[a : a + step]
        whole = (q * q).sum(axis=1) + index.norm2
        slack = 1e-9 * (whole + 1)
        limit = whole - 2 * low + slack  # squared distance at the threshold; infinite without one
        b = ends[0]
        part = (q[:, :b] ** 2).sum(axis=1)[:, None] + (x[:, :b] ** 2).sum(axis=1) - 2 * q[:, :b] @ x[:, :b].T
        test = lambda d: 1.0 if d == index.dim + 1 else d / (index.dim + 1) * (1 + EPSILON / np.sqrt(d)) ** 2
        i, j = np.nonzero((part <= (limit * test(b))[:, None]) & (ids[None, :] != qid[a : a + step, None]))
        part = part[i, j]
        for start, end in zip(ends, ends[1:], strict=False):
            gap = q[i, start:end] - x[j, start:end]
            part = part + np.einsum("ij,ij->i", gap, gap)
            on = part <= limit[i] * test(end)
            i, j, part = i[on], j[on], part[on]
        if len(i):  # without a threshold all are left: keep what can be among the k best, then score exactly
            order = np.lexsort((part, i))
            first = np.flatnonzero(np.r_[True, i[order][1:] != i[order][:-1]])
            last = np.minimum(first + k - 1, np.r_[first[1:], len(order)] - 1)
            bound = np.full(len(q), np.inf)
            bound[i[order][first]] = part[order][last]
            on = part <= bound[i] + 2 * slack[i]
            i, j = i[on], j[on]
            score = np.einsum("ij,ij->i", qv[a + i], v[j])
            keep = _top(i, ids[j], score, k)
            out.append((qid[a + i[keep]], ids[j[keep]], score[keep]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def _by_list(values: np.ndarray) -> Column:
    return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("list") + 1)


FOUND = "query_id long, vec_id long, score double"


def _probe(rows: DataFrame, asked: DataFrame, table, chunks: np.ndarray, parts: np.ndarray, k: int) -> DataFrame:  # noqa: ANN001
    """Scan for each (query_id, q, least, list) its list, in chunks of rows and parts of queries."""
    ship(rows.sparkSession)
    data = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), _by_list(chunks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), _by_list(parts) - 1)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), _by_list(parts)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), _by_list(chunks) - 1)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        index = table.value
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        got = scan(index, right["query_id"].to_numpy(), _stack(right["q"], index.dim), right["least"].to_numpy(), left["id"].to_numpy(), _stack(left["v"], index.dim), k)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    keys = ("list", "chunk", "part")
    return data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(meet, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, recall: float = 0.95, tuned_on: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, all other rows being candidates.

    ``is_query`` is a condition on ``id``. Queries probe as many lists as reach ``recall`` on ``tuned_on`` of them, compared
    with an exact search, and at least so many that k rows are found. Rows without id, or whose vector is null, zero, of an
    unusual number of dimensions, or holds null or non-finite components take no part. Rows of one id are one
    vector, the least of theirs, whatever their order; no query finds itself. Fewer than k other rows: all of them. Equal scores go by id. An empty table gives an empty result.
    Lists are scanned in three waves, each with the threshold that the ones before it reached. A hot list is scanned in chunks of rows and parts of queries, so no task grows with it.
    """
    spark = vectors.sparkSession
    v = usable(vectors, id_col, vec_col)
    index = train(v)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = index.dim
    first = spark.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                own = first.value.nearest(first.value.turned(_stack(part.column(1), dim)))[:, 0]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.astype(np.int32))], names=["id", "v", "list"])

    one = v.where(F.size("v") == dim).select(F.col("id").cast("long").alias("id"), "v").groupBy("id").agg(F.min("v").alias("v"))
    rows = cut(map_arrow(one, assign, "id long, v array<double>, list int"))
    index.rows = np.zeros(len(index.centres), np.int64)
    for r in rows.groupBy("list").count().collect():
        index.rows[r["list"]] = r["count"]
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    sample = queries.orderBy(F.xxhash64("query_id")).limit(tuned_on).collect()
    index.probes = _probes(index, rows, sample, k, recall)
    table = spark.sparkContext.broadcast(index)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = table.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                order = m.nearest(m.turned(_stack(part.column(1), dim), query=True), len(m.centres)).reshape(part.num_rows, -1)
                have = np.cumsum(m.rows[order], axis=1)
                take = (np.arange(order.shape[1]) < m.probes) | (np.c_[np.zeros(len(have), np.int64), have[:, :-1]] < 4 * k)
                take &= m.rows[order] > 0
                i, j = np.nonzero(take)
                first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else np.empty(0, np.int64)
                wave = np.searchsorted(WAVES, np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])), "right")
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(order[i, j].astype(np.int32)), pa.array(wave.astype(np.int32))], names=["query_id", "q", "list", "wave"])

    asked = cut(map_arrow(queries, lists, "query_id long, q array<double>, list int, wave int"))
    number = np.zeros((len(WAVES) + 1, len(index.rows)), np.int64)
    for r in asked.groupBy("list", "wave").count().collect():
        number[r["wave"], r["list"]] = r["count"]
    chunks, parts = np.maximum(1, -(-index.rows // CHUNK)), np.maximum(1, -(-number // QUERIES))
    none = F.lit(float("-inf"))
    best = None
    for wave in range(len(WAVES) + 1):
        due = asked.where(F.col("wave") == wave).drop("wave")
        if best is None:
            due = due.withColumn("least", none)
        else:
            least = best.where(F.col("rank") == k).select(F.col("query_id").alias("q_"), F.col("score").alias("least"))
            due = due.join(least, F.col("query_id") == F.col("q_"), "left").select("query_id", "q", "list", F.coalesce("least", none).alias("least"))
        found = _probe(rows, due, table, chunks, parts[wave], k)
        best = _best(found if best is None else best.select("query_id", "vec_id", "score").union(found), k)
        if wave < len(WAVES):
            best = cut(best)
    return best.select("query_id", "rank", "vec_id", "score")


def _probes(index: Index, rows: DataFrame, sample: list, k: int, recall: float) -> int:
    """How many lists reach the recall on sampled queries, by an exact search of all rows for them."""
    if not sample or len(index.centres) == 1:
        return 1
    qid = np.array([r["query_id"] for r in sample])
    qv = np.array([r["q"] for r in sample])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, v, own = b.column(0).to_numpy(), _stack(b.column(1), qv.shape[1]), b.column(2).to_numpy()
            s = qv @ v.T
            s[qid[:, None] == ids[None, :]] = -np.inf
            j = np.argsort(-s, axis=1, kind="stable")[:, :k]
            i = np.repeat(np.arange(len(qid)), j.shape[1])
            j = j.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids[j]), pa.array(own[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "list", "score"])

    found = map_arrow(rows, exact, "query_id long, vec_id long, list int, score double").where("score > double('-infinity')")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    true = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "list").collect()
    order = index.nearest(index.turned(qv, query=True), len(index.centres))
    place = {(q, int(c)): p for q, row in zip(qid.tolist(), order, strict=True) for p, c in enumerate(row)}
    need = np.sort([place[r["query_id"], r["list"]] for r in true]) + 1
    return int(need[max(0, int(np.ceil(recall * len(need))) - 1)]) if len(need) else 1
