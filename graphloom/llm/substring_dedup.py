"""Substring dedup by content-defined chunks.

A gear rolling hash over the first ``GEAR_BYTES`` bytes of each word chooses chunk boundaries: a word begins a chunk where its
hash is the least among some ``reach`` neighbouring words. That depends on the words alone, so the chunks of a repeated
passage are the same wherever it stands and whatever was inserted before it. A chunk's digest covers ``span`` words from its
boundary, with ``span + reach - 1 = min_words``: any stretch of ``min_words`` words holds at least one whole chunk.

Repeated digests are linked to their first occurrence, and the bytes of both documents compared as far as they are equal.
Where a third document shares a chunk but less text around it than some other one, its first occurrence does not settle the
matter; there all windows of ``min_words`` words are compared by 128-bit digests. Together these find every such window that
an earlier document has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.components import HOT
from graphloom.session import map_arrow, stored

#: One random 64-bit number a byte value, from a fixed seed.
GEAR = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)
GEAR_BYTES = 16
#: Bytes hashed at once.
BLOCK = 1 << 20
ROWS = 50_000
#: A place is one long: this many low bits are the byte offset, those above it tell texts of one id apart.
OFFSET_BITS, TEXT_BITS = 43, 20
#: A window's number of bytes takes so many bits beside its first word's number.
SIZE_BITS = 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def words_of(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end (exclusive)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[b], [True]]).view(np.int8)))
    return edge[::2], edge[1::2]


def gear(b: np.ndarray) -> np.ndarray:
    """h[i]: the rolling hash of the GEAR_BYTES bytes that end at i; the first ones have fewer."""
    out = np.empty(len(b), np.uint64)
    for at in range(0, len(b), BLOCK):
        lead = min(at, GEAR_BYTES - 1)
        h = GEAR[b[at - lead : at + BLOCK]]
        for step in (1, 2, 4, 8):
            prior = h.copy()
            prior[step:] = h[:-step] << np.uint64(step)
            prior[:step] = 0
            h = h + prior
        out[at : at + BLOCK] = h[lead:]
    return out


def boundaries(b: np.ndarray, starts: np.ndarray, span: int, reach: int) -> np.ndarray:
    """Which words begin chunks: each that has the least hash of ``reach`` neighbours with ``span`` words from them on."""
    n = len(starts) - span + 1
    if n < reach:
        return np.empty(0, np.int64)
    h = gear(b)[np.minimum(starts[:n] + GEAR_BYTES - 1, len(b) - 1)]
    least, have = np.arange(n), 1
    while have < reach:
        step = min(have, reach - have)
        first, second = least[: len(least) - step], least[step:]
        least, have = np.where(h[second] < h[first], second, first), have + step
    return np.unique(least)


def chunk_rows(docs: DataFrame, id_col: str, text_col: str, span: int, reach: int) -> DataFrame:
    """(id, place, digest, n) of each chunk: a few longs a row, since these rows are what is shuffled. Places sort by offset;
    n is 1 for the first chunk of a digest in a text, and 0 for others."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            n = 0
            for k, t in enumerate(batch.column(1)):
                text = t.as_py()
                b = np.frombuffer(text, np.uint8)
                start, end = words_of(b)
                at = boundaries(b, start, span, reach)
                if not len(at):
                    continue
                digest = np.fromiter((xxhash.xxh3_64_intdigest(text[s:e]) for s, e in zip(start[at].tolist(), end[at + span - 1].tolist(), strict=True)), np.uint64, len(at))
                own = (zlib.crc32(text) & (1 << TEXT_BITS) - 1) << OFFSET_BITS
                new = np.zeros(len(at), np.int64)
                new[np.unique(digest, return_index=True)[1]] = 1
                rows.append((np.full(len(at), k), start[at] | own, digest.view(np.int64), new))
                n += len(at)
                if n >= ROWS:
                    yield made(batch, rows)
                    rows, n = [], 0
            if rows:
                yield made(batch, rows)

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        k, *cols = (np.concatenate(c) for c in zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k)), *map(pa.array, cols)], names=["id", "place", "digest", "n"])

    return map_arrow(source, run, f"id {kind}, place long, digest long, n long")


def _text_of(place: str) -> Column:
    return F.shiftright(place, OFFSET_BITS).cast("int")


def _offset(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit((1 << OFFSET_BITS) - 1))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, v, t): texts with what tells those of one id apart."""
    d = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("binary").alias("t")).where("t is not null")
    return d.select("d", F.crc32("t").bitwiseAND(F.lit((1 << TEXT_BITS) - 1)).cast("int").alias("v"), "t")


def linked(docs: DataFrame, id_col: str, text_col: str, span: int, reach: int) -> DataFrame:
    """(id, place, digest, n, first_id, first_place) of every chunk whose digest occurs again; stored.

    ``n`` is the number of texts that have it. Digests are counted with map-side combine, once a text; only the repeated
    ones' rows are gathered and told their first occurrence.
    Each join is of two stored or mapped tables, so adaptive execution can split a digest of very many documents.
    """
    chunks = chunk_rows(docs, id_col, text_col, span, reach)
    again = stored(chunks.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1"), "again")
    hits = stored(chunks.drop("n").join(again, "digest"), "hits")
    first = stored(hits.groupBy("digest").agg(F.min(F.struct("id", "place")).alias("f")), "first")
    return stored(hits.join(first, "digest").select("id", "place", "digest", "n", F.col("f.id").alias("first_id"), F.col("f.place").alias("first_place")), "linked")


def _common(a: bytes, b: bytes) -> int:
    """How many first bytes are equal."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax())


def equal_words(own: bytes, other: bytes, core: int, size: int, own_begins: bool, other_begins: bool, start: np.ndarray, end: np.ndarray) -> tuple[int, int]:
    """The first and, exclusive, last of own's words that are whole in the equal bytes around ``size`` bytes at ``core``.

    Both are cut at the same distance from the core. A word is whole if it begins and ends in both: at the cut's start where
    the flags say so, at the end of a text, or beside a space. (0, 0) if the core differs.
    """
    if own[core : core + size] != other[core : core + size] or len(other) < core + size:
        return 0, 0
    low = core - _common(own[:core][::-1], other[:core][::-1])
    high = core + size + _common(own[core + size :], other[core + size :])
    a, b = int(np.searchsorted(start, low)), int(np.searchsorted(end, high, "right"))
    if a < b and start[a] == low and not (own_begins and other_begins if low == 0 else _SPACE[other[low - 1]]):
        a += 1
    if a < b and end[b - 1] == high and high < len(other) and not _SPACE[other[high]]:
        b -= 1
    return (a, b) if a < b else (0, 0)


def open_windows(start: np.ndarray, end: np.ndarray, size: int, at: int, low: int, high: int, equal: tuple[int, int], min_words: int, reach: int) -> int:
    """Which of the windows that begin 0 to ``reach - 1`` words before the chunk at byte ``at`` are not in the equal words.

    A bit each. Windows of the text are those between the bytes ``low`` and ``high``, which may lie outside what is cut out.
    """
    mask, c = 0, int(np.searchsorted(start, at))
    for before in range(reach):
        w = c - before
        z = w + min_words
        inside = (start[w] >= low if w >= 0 else low < 0) and (end[z - 1] <= high if z <= len(end) else high > size)
        if inside and not (equal[0] <= w and z <= equal[1]):
            mask |= 1 << before
    return mask


RUN = "id {k}, v int, at long, own binary, begins boolean, core int, size int, first_id {k}, fv int, first_at long, digests array<long>, ats array<int>, lows array<int>, highs array<int>, numbers array<long>"
PASSAGE = "id {k}, start long, end long, words long, first_id {k}, first_start long"
_ROW = {"v": pa.int32(), "at": pa.int64(), "own": pa.binary(), "begins": pa.bool_(), "core": pa.int32(), "size": pa.int32(), "fv": pa.int32(), "first_at": pa.int64()}
_ROW |= {"digests": pa.list_(pa.int64()), "ats": pa.list_(pa.int32()), "masks": pa.list_(pa.int32()), "numbers": pa.list_(pa.int64()), "lows": pa.list_(pa.int32()), "highs": pa.list_(pa.int32())}
_ROW |= {"start": pa.int64(), "end": pa.int64(), "words": pa.int64(), "first_start": pa.int64(), "place": pa.int64(), "word": pa.int64(), "d1": pa.int64(), "d2": pa.int64()}


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, _ROW.get(n, id_type)) for n, c in zip(names, cols, strict=True)], names=names)


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _per_text(hits: DataFrame, link: Column, texts: DataFrame) -> DataFrame:
    """(id, v, t, links): each text with what was found in it, one row a text."""
    own = hits.groupBy(F.col("id").alias("i_"), _text_of("place").alias("v_")).agg(F.collect_list(link).alias("links"))
    return own.join(texts, F.col("i_").eqNullSafe(F.col("d")) & (F.col("v_") == F.col("v"))).select(F.col("d").alias("id"), "v", "t", "links")


def _runs(found: DataFrame, texts: DataFrame, kind: str, span: int, reach: int) -> DataFrame:
    """Runs of overlapping chunks with one first document and shift, and the bytes around them.

    ``digests`` are those of more than two occurrences, with the bytes that the windows about them reach.
    """
    links = found.where(~F.col("id").eqNullSafe(F.col("first_id")))
    link = F.struct(_offset("place").alias("s"), "first_id", _text_of("first_place").alias("fv"), _offset("first_place").alias("fs"), F.when(F.col("n") > 2, F.col("digest")).alias("g"), "n")
    schema = RUN.format(k=kind)
    names = _names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for i, v, text, found_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b = np.frombuffer(text, np.uint8)
                start, end = words_of(b)
                at = np.minimum(np.searchsorted(start, [x["s"] for x in found_]), len(start) - 1)
                together: dict[tuple, list] = {}
                for x, w in zip(found_, at.tolist(), strict=True):
                    if start[w] == x["s"] and w + span <= len(start):  # else another text with this id and checksum
                        together.setdefault((x["first_id"], x["fv"], x["s"] - x["fs"]), []).append((w, x["g"], x["n"]))
                for (first_id, fv, shift), all_ in together.items():
                    all_.sort(key=lambda x: x[0])
                    a = 0
                    while a < len(all_):
                        z = a + 1
                        while z < len(all_) and all_[z][0] <= all_[z - 1][0] + span:
                            z += 1
                        w, last = all_[a][0], all_[z - 1][0] + span - 1
                        core, core_end = int(start[w]), int(end[last])
                        low = max(int(start[max(w - reach, 0)]) - 1, 0, shift)
                        high = min(int(end[min(last + reach, len(end) - 1)]) + 1, len(text))
                        g = [(g, int(start[x]) - low, int(start[max(x - reach + 1, 0)]) - low, int(end[min(x + span + reach - 2, len(end) - 1)]) - low, n) for x, g, n in all_[a:z] if g is not None]
                        out.append((i, v, low, text[low:high], low == 0 or bool(_SPACE[b[low - 1]]), core - low, core_end - core, first_id, fv, low - shift, *([x[c] for x in g] for c in range(5))))
                        held += high - low
                        a = z
                        if held > BLOCK:
                            yield _batch(out, names, batch.column(0).type)
                            out, held = [], 0
            yield _batch(out, names, batch.column(0).type)

    return map_arrow(_per_text(links, link, texts), run, schema)


def _compared(runs: DataFrame, texts: DataFrame, kind: str, min_words: int, span: int) -> DataFrame:
    """Passages of enough words, and which windows about which chunks of more than two texts were not equal."""
    cols = [c for c in runs.columns if c != "v"]
    before = F.substring("t", F.col("first_at").cast("int"), F.lit(1))
    other = F.substring("t", (F.col("first_at") + 1).cast("int"), F.length("own"))
    # the texts are joined as in the step before, under the same names, so that one exchange serves both
    met = runs.drop("v").join(texts, F.col("first_id").eqNullSafe(F.col("d")) & (F.col("fv") == F.col("v"))).select(*cols, other.alias("other"), F.when(F.col("first_at") > 0, before).alias("before"))
    schema = PASSAGE.format(k=kind) + ", digests array<long>, masks array<int>, numbers array<long>"
    names = _names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.to_pydict()
            out = []
            for k in range(batch.num_rows):
                own, begins = col["own"][k], not col["before"][k] or col["before"][k].isspace()
                start, end = words_of(np.frombuffer(own, np.uint8))
                equal = equal_words(own, col["other"][k], col["core"][k], col["size"][k], col["begins"][k], begins, start, end)
                words = equal[1] - equal[0]
                masks = [open_windows(start, end, len(own), *x, equal, min_words, min_words - span + 1) for x in zip(col["ats"][k], col["lows"][k], col["highs"][k], strict=True)]
                open_ = [x for x in zip(col["digests"][k], masks, col["numbers"][k], strict=True) if x[1]]
                if words >= min_words or open_:
                    s, e = (int(start[equal[0]]), int(end[equal[1] - 1])) if words else (0, 0)
                    out.append((col["id"][k], col["at"][k] + s, col["at"][k] + e, words, col["first_id"][k], col["first_at"][k] + s, *([x[c] for x in open_] for c in range(3))))
            yield _batch(out, names, batch.column(0).type)

    return map_arrow(met, run, schema)


def _by_windows(found: DataFrame, open_: DataFrame, texts: DataFrame, kind: str, min_words: int, reach: int) -> DataFrame:
    """Passages by the digests of windows of ``min_words`` words: of those asked for, at all occurrences of their chunks."""
    hot = F.col("n") * HOT > found.count()  # fewer than HOT digests, so what is asked of them is broadcast
    asked = lambda of: open_.where(of).drop("n")
    hits = found.where(hot).join(F.broadcast(asked(hot)), "digest").union(found.where(~hot).join(asked(~hot), "digest"))
    schema = f"id {kind}, place long, word long, d1 long, d2 long"
    names = _names(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, v, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start, end = words_of(np.frombuffer(text, np.uint8))
                at = np.searchsorted(start, np.array([x["s"] for x in places], np.int64))
                asked = np.array([x["mask"] for x in places])[:, None] >> np.arange(reach) & 1 > 0
                first = np.unique((at[:, None] - np.arange(reach))[asked])
                for w in first[(first >= 0) & (first + min_words <= len(start))].tolist():
                    s, e = int(start[w]), int(end[w + min_words - 1])
                    d = xxhash.xxh3_128_digest(text[s:e])
                    out.append((i, s | v << OFFSET_BITS, w << SIZE_BITS | e - s, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
                if len(out) >= ROWS:
                    yield _batch(out, names, batch.column(0).type)
                    out = []
            yield _batch(out, names, batch.column(0).type)

    windows = stored(map_arrow(_per_text(hits, F.struct(_offset("place").alias("s"), "mask"), texts), run, schema), "windows")
    first = windows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place")).alias("f")).where("n > 1")
    first = stored(first.select("d1", "d2", "f"), "first")
    same = windows.join(first, ["d1", "d2"]).where(~F.col("id").eqNullSafe(F.col("f.id")))
    end = _offset("place") + F.col("word").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))
    same = same.select("id", "place", end.alias("end"), F.shiftright("word", SIZE_BITS).alias("word"), F.col("f.id").alias("first_id"), _text_of("f.place").alias("fv"), _offset("f.place").alias("first_start"), (F.col("place") - _offset("f.place")).alias("shift"))
    own = Window.partitionBy("id", "first_id", "fv", "shift").orderBy("place")
    same = same.withColumn("run", F.sum(F.when(F.col("word") - F.lag("word").over(own) <= min_words, 0).otherwise(1)).over(own))
    runs = same.groupBy("id", "first_id", "fv", "shift", "run").agg(F.min("place").alias("place"), F.max("end").alias("end"), (F.max("word") - F.min("word") + min_words).alias("words"), F.min("first_start").alias("first_start"))
    return runs.select("id", _offset("place").alias("start"), "end", "words", "first_id", "first_start")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, span: int = 35) -> DataFrame:
    """(id, start, end, words, first_id, first_start): passages that another document has first, by byte offsets.

    Every window of ``min_words`` whole words with equal bytes between and in them that a document of smaller id has lies in a
    passage; passages are equal throughout and may overlap, where parts of them have different first documents. The first
    occurrence by (id, checksum of the text, start) is the one to keep; nulls sort first. Rows without id are one document,
    as are rows that repeat an id; repeats inside one document are not reported. Null and empty texts and texts of fewer
    words have no passage; an empty table gives an empty result; other columns are ignored.

    Rows that meet in one task by a key are chunks of one text, or are joined by joins that adaptive execution can split.
    Of texts, only the passages and what is around them are cut out where they meet.
    """
    reach = min_words - span + 1
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    texts = _texts(docs, id_col, text_col)
    found = linked(docs, id_col, text_col, span, reach)
    compared = stored(_compared(_runs(found, texts, kind, span, reach), texts, kind, min_words, span), "compared")
    names = _names(PASSAGE.format(k=kind))
    certain = compared.where(F.col("words") >= min_words).select(*names)
    open_ = compared.select(F.explode(F.arrays_zip("digests", "masks", "numbers")).alias("x")).groupBy(F.col("x.digests").alias("digest"))
    open_ = stored(open_.agg(F.bit_or("x.masks").alias("mask"), F.max("x.numbers").alias("n")), "open")
    rest = _by_windows(found, open_, texts, kind, min_words, reach)
    return certain.union(rest.select(*names)).dropDuplicates(["id", "start", "end", "first_id", "first_start"])


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the given passages; first occurrences stay. Texts are cut at byte offsets between characters."""
    own = passages.groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("_sd_spans")).withColumnRenamed("id", "_sd_id")
    d = docs.join(own, F.col(id_col).eqNullSafe(F.col("_sd_id")), "left")
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join(f"`{c}` {t}" for c, t in kind.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = docs_columns.index(text_col)
        for b in batches:
            texts = [without(t, s) for t, s in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays(cols, names=docs_columns)

    docs_columns = docs.columns
    return map_arrow(d.select(*docs.columns, "_sd_spans"), run, schema)


def without(text: str | None, spans: list[dict] | None) -> str | None:
    """A text less the bytes of some spans; a span that begins or ends inside a character leaves that character."""
    if text is None or not spans:
        return text
    raw, out, at = text.encode(), [], 0
    inside = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        start, end = s["start"], s["end"]
        while inside(start):
            start += 1
        while end > 0 and inside(end):
            end -= 1
        if start > at:
            out.append(raw[at:start])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode()
