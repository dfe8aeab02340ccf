"""Best-fit packing with certified bounds.

Documents become pieces of at most ``size`` tokens. Pieces are dealt to groups of a bounded number, each group is packed by
best-fit decreasing, and dual-feasible functions bound from below the sequences that the group needs. A group that meets
its bound keeps its sequences but for those with much room, which no group can fill alone; the others give up all that are
not full. Those pieces are dealt anew, to other groups, and packed again, as long as that saves sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pretokens import packed, worker_encoder
from graphloom.session import cut, map_arrow, ship

PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
#: Rows of an output batch.
ROWS = 20_000


def pieces(docs: DataFrame, path: str, end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's ids, with ``end_id`` after them.

    Only a document of more than ``size`` ids is cut: the first piece takes what is left over, all others are full. A null
    text counts as empty and is a piece of the end id alone. No shuffle; a row's ids exist only while it is cut.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    end = packed([end_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_encoder(path, "bytes")
        for b in batches:
            ids, cols = [], ([], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = memoryview(b"".join(coder.values(t.as_py())) + end)
                n = len(raw) // 4
                at, to = 0, n % size or size
                while at < n:
                    ids.append(i)
                    for col, v in zip(cols, (0 if not at else cols[0][-1] + 1, at, to - at, zlib.crc32(raw[4 * at : 4 * to])), strict=True):
                        col.append(v)
                    at, to = to, to + size
                if len(ids) >= ROWS:
                    yield from out(b, ids, cols)
                    ids, cols = [], ([], [], [], [])
            yield from out(b, ids, cols)

    def out(b: pa.RecordBatch, ids: list, cols: tuple) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *map(pa.array, cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(source, run, PIECE.format(id=kind))


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Sequences of ``size`` that lengths in 1..size need at least, by two families of dual-feasible functions.

    One counts lengths over size - e as whole and drops those under e; the other rounds multiples of size / (k + 1) down
    to multiples of 1 / k. The plain sum is the first with e = 0.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    amount, number = np.cumsum(count * x), np.cumsum(count)
    e = np.arange(size // 2 + 1)
    middle = amount[size - e] - np.where(e > 0, amount[np.maximum(e - 1, 0)], 0)
    best = int(np.max(-(-(middle + size * (number[size] - number[size - e])) // size)))
    for k in range(1, 17):
        whole = (k + 1) * x % size == 0
        u = np.where(whole, k * x, (k + 1) * x // size * size)  # in units of 1 / (k * size)
        best = max(best, -(-int((count * u).sum()) // (k * size)))
    return best


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order of decreasing lengths, and each bin's fill.

    Bins stand under their room, and one integer has a bit for each room in use, so the fullest bin that fits is found
    without a scan.
    """
    rooms: list[list[int]] = [[] for _ in range(size + 1)]
    used, fill = 0, []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        fits = used >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            b, room = len(fill), size
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += n
        if room := room - n:
            rooms[room].append(b)
            used |= 1 << room
    return where, offset, np.array(fill, np.int64)


def pack(pieces: DataFrame, size: int = 2048, group_rows: int = 8192, room: int = 32, worth: int = 1000, keep: Callable[[DataFrame, int], DataFrame] = lambda df, most: cut(df)) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32): adds sequence_id, offset and certified.

    ``certified``: the piece's last group used as few sequences as its bound, or its sequence is full. Groups have about
    ``group_rows`` pieces, equal ones too, whatever the input's size: pieces are dealt by a hash of all columns and of their
    place in a stored table, so that a task run again gets the same. A group at its bound gives up sequences with more room
    than one part in ``room``. Rounds go on while they save one sequence in ``worth`` of those given up, and at least one. An
    empty table gives an empty result; null ids and repeated rows are pieces like any other. ``keep`` cuts tables of a bounded
    number of rows.
    """
    rows = pieces.columns
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long, certified boolean, open boolean"

    def dealt(df: DataFrame, round_: int, n: int) -> DataFrame:
        groups = max(1, -(-n // group_rows))

        def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", *[c for c in rows if c != "length"]], ascending=[False] + [True] * (len(rows) - 1), ignore_index=True)
            lengths = pdf["length"].to_numpy()
            where, offset, fill = best_fit_decreasing(lengths, size)
            sure = len(fill) == lower_bound(lengths, size)
            more = fill < (size - size // room if sure else size)
            return pdf[rows].assign(sequence_id=(np.int64(round_) << 53) | (np.int64(key[0]) << 22) | where, offset=offset, certified=sure | (fill[where] == size), open=more[where])

        at = F.xxhash64(*[F.col(c) for c in rows], F.lit(round_), F.monotonically_increasing_id())
        return df.select(*rows).withColumn("_group", F.pmod(at, F.lit(groups))).groupBy("_group").applyInPandas(place, schema)

    ship(pieces.sparkSession)
    pool = cut(pieces)
    done, n, round_ = [], pool.count(), 0
    placed = keep(dealt(pool, 0, n), n)
    while True:
        done.append(placed.where("not open"))
        pool = keep(placed.where("open"), n)
        n, before = pool.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if not n:
            return _all(done).drop("open")
        round_ += 1
        again = keep(dealt(pool, round_, n), n)
        saved = before - again.agg(F.count_distinct("sequence_id")).first()[0]
        if saved < max(1, before // worth):
            return _all([*done, again if saved > 0 else pool]).drop("open")
        placed = again


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole
