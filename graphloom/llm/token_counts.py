"""Token counts by a two-tier lookup: a broadcast table of frequent pre-tokens' lengths, and a cache in each worker.

Nothing is shuffled: each text is split and summed where it is read. The table only saves work; whatever it lacks is
encoded by the library's model on first sight, so the counts do not depend on it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.pretokens import LONGEST, Encoder, worker_encoder
from graphloom.session import map_arrow


def frequent_lengths(docs: DataFrame, text_col: str, path: str, sample_rows: int = 512, longest: int = 20_000, entries: int = 32_768) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens in some ``sample_rows`` texts of at most ``longest`` characters.

    Taken from as few partitions as have so many rows. The sample and the table are bounded whatever the input.
    """
    seen, coder = Counter(), Encoder(path, len)
    for r in docs.select(F.col(text_col).alias("t")).where(F.length("t") <= longest).take(sample_rows):
        seen.update(x for x in coder.pretokens(r["t"]) if len(x) <= LONGEST)
    return {x: coder[x] for x, _ in seen.most_common(entries)}


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, sample_rows: int = 512, entries: int = 32_768) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row.

    Null texts count as empty: no bytes, no tokens. Special strings inside a text count as the library's default has it.
    Null ids, repeated rows and texts of any length pass through; other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    table = sc.broadcast(frequent_lengths(docs, text_col, path, sample_rows, entries=entries))
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_encoder(path, "length", table.value)
        for b in batches:
            n = np.fromiter((sum(coder.values(t.as_py())) for t in b.column(1)), dtype=np.int64, count=b.num_rows)
            size = pc.binary_length(b.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), size, pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(source, run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
