"""Language identification by interpolated Kneser-Ney character models.

Each language has a model over letters and single spaces, of orders 1 to ``ORDER``. All models share sorted arrays of 64-bit
n-gram hashes, each with a row of log-probabilities, one a language, and of context hashes with back-off weights; a lookup
is a binary search. The language with the lowest cross-entropy per character wins. A document is rejected if that entropy
is above what the language's own documents of its length reach, as measured on documents that the counts did not see.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.workers import let_go
from graphloom.session import cut, map_arrow

ORDER = 4
PRIME = np.uint64(0x9E3779B97F4A7C15)
SPACE, BREAK = 32, 1
#: Characters that are worked on at once.
BLOCK = 1 << 18
#: The chance of a character that no model has seen.
UNSEEN = 1 / 4096
#: Standard deviations above its mean that a language's documents may always have.
LEAST_ALLOWED = 4.0


def _letter(c: int) -> int:
    ch = chr(c)
    if unicodedata.category(ch)[0] not in "LM":
        return SPACE
    low = ch.lower()
    return ord(low) if len(low) == 1 else c


_TABLE: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Lower-case letters and marks; anything else, however long, is one space. ORDER - 1 breaks stand in front."""
    if not _TABLE:
        _TABLE.append(np.array([_letter(c) if not 0xD800 <= c < 0xE000 else SPACE for c in range(0x10000)], dtype=np.uint32))
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    out = _TABLE[0][np.minimum(raw, 0xFFFF)]
    if len(raw) and raw.max() > 0xFFFF:
        at = np.flatnonzero(raw > 0xFFFF)
        seen, which = np.unique(raw[at], return_inverse=True)
        out[at] = np.array([_letter(int(c)) for c in seen], dtype=np.uint32)[which]
    keep = out != SPACE
    keep[1:] |= out[:-1] != SPACE
    if len(keep):
        keep[0] = out[0] != SPACE
    return np.concatenate([np.full(ORDER - 1, BREAK, np.uint32), out[keep]])


def hashes(c: np.ndarray) -> list[np.ndarray]:
    """h[k][i]: the hash of the k characters that end at i, for k in 0..ORDER; those that would begin before 0 wrap."""
    x = c.astype(np.uint64) + np.uint64(1)
    h = [np.zeros(len(c), np.uint64)]
    for k in range(1, ORDER + 1):
        h.append(x if k == 1 else np.roll(h[-1], 1) * PRIME + x)
    return h


@dataclass
class Model:
    languages: list[str]
    grams: list[np.ndarray]  # by order less one: sorted hashes
    logs: list[np.ndarray]  # and a row of log-probabilities for each
    contexts: list[np.ndarray]  # by length less one: sorted hashes
    backs: list[np.ndarray]  # and a row of log back-off weights for each
    root: np.ndarray | float = 0.0  # log back-off weights of the empty context
    typical: np.ndarray | None = None  # by language: mean cross-entropy, variance a character, variance a document, deviations allowed
    temper: float = 4.0  # by which likelihoods are flattened into scores

    def score(self, h: list[np.ndarray], at: np.ndarray) -> np.ndarray:
        """Log-probabilities at positions, a column a language."""
        out = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            hit, row = _find(self.grams[k - 1], h[k][at[left]])
            out[left[hit]] += self.logs[k - 1][row[hit]]
            left = left[~hit]
            if not len(left):
                break
            if k > 1:
                hit, row = _find(self.contexts[k - 2], h[k - 1][at[left] - 1])
                out[left[hit]] += self.backs[k - 2][row[hit]]
            else:
                out[left] += self.root + np.log(UNSEEN)
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character, a column a language, and characters; 0 characters for a text without a letter."""
        size, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        held: list[tuple[int, np.ndarray]] = []
        n = 0

        def flush() -> None:
            nonlocal held, n
            if held:
                c = np.concatenate([x for _, x in held])
                at = np.flatnonzero(c != BREAK)
                doc = np.repeat([i for i, _ in held], [np.count_nonzero(x != BREAK) for _, x in held])
                p = self.score(hashes(c), at)
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.empty(0, np.int64)
                if len(first):
                    np.add.at(total, doc[first], np.add.reduceat(p, first, axis=0, dtype=np.float64))
            held, n = [], 0

        for i, t in enumerate(texts):
            c = codes(t or "")
            if not (c > SPACE).any():
                continue
            size[i] = len(c) - (ORDER - 1)
            if len(c) <= BLOCK:
                if n + len(c) > BLOCK:
                    flush()
                held.append((i, c))
                n += len(c)
            else:  # block by block, each behind the characters before it
                flush()
                for b in range(ORDER - 1, len(c), BLOCK):
                    part = c[b - ORDER + 1 : b + BLOCK]
                    total[i] += self.score(hashes(part), np.arange(ORDER - 1, len(part))).sum(axis=0, dtype=np.float64)
        flush()
        return -total / np.maximum(size, 1)[:, None], size


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row = np.searchsorted(keys, asked)
    row[row == len(keys)] = 0
    return (keys[row] == asked) if len(keys) else np.zeros(len(asked), bool), row


COUNT = "lang int, k int, gram long, context long, suffix long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of (lang, text) rows with their contexts, suffixes and counts."""
    let_go()
    for b in batches:
        langs = np.array(b.column(0).to_pylist(), np.int32)
        cs = [codes(t or "") for t in b.column(1).to_pylist()]
        for lang in np.unique(langs):
            c = np.concatenate([x for x, own in zip(cs, langs, strict=True) if own == lang])
            h, at = hashes(c), np.flatnonzero(c != BREAK)
            for k in range(1, ORDER + 1):
                gram, first, n = np.unique(h[k][at], return_index=True, return_counts=True)
                at_ = at[first]
                cols = [gram, h[k - 1][at_ - 1], h[k - 1][at_]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(gram), lang, np.int32)), pa.array(np.full(len(gram), k, np.int32)), *(pa.array(x.view(np.int64)) for x in cols), pa.array(n.astype(np.int64))],
                    names=["lang", "k", "gram", "context", "suffix", "n"],
                )


def estimate(languages: list[str], rows: pa.Table) -> Model:
    """Interpolated Kneser-Ney: the highest order has counts, each lower one the number of distinct characters before."""
    col = {c: rows.column(c).to_numpy() for c in rows.column_names}
    for c in ("gram", "context", "suffix"):
        col[c] = col[c].view(np.uint64)
    model = Model(languages, [], [], [], [])
    width = len(languages)
    for k in range(1, ORDER + 1):
        own = {x: v[col["k"] == k] for x, v in col.items()}
        grams, first = np.unique(own["gram"], return_index=True)
        context, suffix = own["context"][first], own["suffix"][first]
        contexts = np.unique(own["context"])
        up = {x: v[col["k"] == k + 1] for x, v in col.items()}
        logs = np.empty((len(grams), width), np.float32)
        backs = np.zeros((len(contexts), width), np.float32)
        for j in range(width):
            mine = own["lang"] == j
            if k == ORDER:
                g, n = own["gram"][mine], own["n"][mine].astype(float)
            else:
                g, n = np.unique(up["suffix"][up["lang"] == j], return_counts=True)
                n = n.astype(float)
            here = np.searchsorted(grams, g)
            once, twice = max(1, (n == 1).sum()), max(1, (n == 2).sum())
            d = once / (once + 2 * twice)
            where = np.searchsorted(contexts, context[here])
            total = np.bincount(where, n, len(contexts))
            kinds = np.bincount(where, minlength=len(contexts))
            back = np.divide(d * kinds, total, out=np.ones(len(contexts)), where=total > 0)
            own_p = np.zeros(len(grams))
            own_p[here] = np.maximum(n - d, 0) / total[where]
            if k == 1:
                lower, weight = np.full(len(grams), UNSEEN), np.full(len(grams), back[0] if len(back) else 1.0)
            else:
                lower = np.exp(model.logs[k - 2][np.searchsorted(model.grams[k - 2], suffix), j].astype(float))
                weight = back[np.searchsorted(contexts, context)]
            logs[:, j] = np.log(own_p + weight * lower)
            backs[:, j] = np.log(back)
        model.grams.append(grams)
        model.logs.append(logs)
        if k > 1:
            model.contexts.append(contexts)
            model.backs.append(backs)
        elif len(backs):
            model.root = backs[0]
    return model


def _fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = 600, longest: int = 20_000, most_rows: int = 120_000, spare: float = 1.5) -> Model:
    """Learn from about ``rows`` documents of each language, and from about ``most_rows`` in all if there are many languages.

    The sample is drawn by a hash of the id from documents with text, language and id whose fold isn't 0 and whose text has
    at most ``longest`` characters; texts are used whole. A third of it only calibrates: the temper is the one under which
    that third's languages are likeliest, and a language's documents may deviate ``spare`` times as far as any of its third.
    The sample's bound, which no language is left out for, limits the n-grams and entropies that reach the driver, whatever
    the table's size.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t")).where(F.col("lang").isNotNull() & F.col("id").isNotNull())
    known = known.where(_fold("id") != 0)
    seen = known.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in seen)
    if not languages:
        return Model([], [], [], [], [])
    number = {lang: i for i, lang in enumerate(languages)}
    cells = 1 << 40
    each = max(1, min(rows, most_rows // len(languages)))
    wanted = {r["lang"]: min(cells, -(-each * cells // r["count"])) for r in seen}
    as_map = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    cell = F.pmod(F.xxhash64(F.lit("sample"), F.col("id").cast("string")), F.lit(cells))
    some = known.where(cell < as_map(wanted)[F.col("lang")]).where(F.col("t").isNotNull() & (F.length("t") <= longest))
    some = some.select(as_map(number)[F.col("lang")].cast("int").alias("lang"), "t", (F.pmod(F.xxhash64(F.lit("part"), F.col("id").cast("string")), F.lit(3)) == 0).alias("aside"))
    some = cut(some)  # bounded, and read twice
    counts = map_arrow(some.where("not aside").select("lang", "t"), _count, COUNT)
    counts = counts.groupBy("lang", "k", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n"))
    model = estimate(languages, counts.toArrow())
    table = docs.sparkSession.sparkContext.broadcast(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, n = table.value.entropies(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(h), pa.list_(pa.float64())), pa.array(n)], names=["lang", "every", "n"])

    got = map_arrow(some.where("aside").select("lang", "t"), calibrate, "lang int, every array<double>, n long").toArrow().to_pandas()
    got = got[got["n"] > 0].reset_index(drop=True)
    every = np.stack(got["every"].to_numpy()) if len(got) else np.empty((0, len(languages)))
    got["h"] = every[np.arange(len(got)), got["lang"]]
    model.temper = _temper(every, got["lang"].to_numpy(), got["n"].to_numpy())
    typical = np.empty((len(languages), 4))
    for j in range(len(languages)):
        own = got[got["lang"] == j]
        own = own if len(own) >= 10 else got  # of a rare language, what all have
        if not len(own):
            typical[j] = (0, np.inf, np.inf, 1)
            continue
        mean = float(np.average(own["h"], weights=own["n"]))
        off = (own["h"] - mean) ** 2
        long = own["n"] >= own["n"].median()
        by_char, by_doc = max(1.0, float((off * own["n"]).mean())), max(1e-3, float(off[long].mean()))
        farthest = float(((own["h"] - mean) / np.sqrt(by_char / own["n"] + by_doc)).max())
        typical[j] = mean, by_char, by_doc, max(LEAST_ALLOWED, spare * farthest)
    model.typical = typical
    return model


def _temper(h: np.ndarray, lang: np.ndarray, n: np.ndarray) -> float:
    """The temper, of some powers of two, under which the given languages are likeliest."""

    def loss(temper: float) -> float:
        x = -h * (n / temper)[:, None]
        x -= x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), lang]).sum())

    tempers = [2.0**i for i in range(9)]
    return min(tempers, key=loss) if len(h) else 4.0


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: (id, lang_pred, score, entropy, rejected). A map over the rows, without a shuffle.

    ``score`` is the winner's share of the languages' likelihoods, tempered since neighbouring characters depend on each
    other. Null texts and texts without a letter, and all texts if nothing was learned, are ``und`` with score 0, no entropy,
    and rejected. Null ids, repeated rows and texts of any length pass through; other columns are ignored.
    """
    table = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        m = table.value
        for b in batches:
            lang, score, entropy, rejected = judged(m, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(entropy, pa.float64(), from_pandas=True), pa.array(rejected)], names=["id", "lang_pred", "score", "entropy", "rejected"])

    return map_arrow(source, run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, entropy double, rejected boolean")


def judged(m: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, entropy and rejection of each text."""
    if not m.languages:
        none = np.zeros(len(texts))
        return ["und"] * len(texts), none, np.full(len(texts), np.nan), np.ones(len(texts), bool)
    h, n = m.entropies(texts)
    best = h.argmin(axis=1)
    low = h[np.arange(len(n)), best]
    score = 1 / np.exp(-np.minimum((h - low[:, None]) * (n / m.temper)[:, None], 700)).sum(axis=1)
    some = n > 0
    limit = np.full(len(n), np.inf)
    if m.typical is not None:
        mean, by_char, by_doc, z = m.typical[best].T
        limit = mean + z * np.sqrt(by_char / np.maximum(n, 1) + by_doc)
    return [m.languages[j] if ok else "und" for j, ok in zip(best, some, strict=True)], np.where(some, score, 0.0), np.where(some, low, np.nan), ~some | (low > limit)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input rows, with all their columns, whose language isn't rejected."""
    table = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in batches:
            rejected = judged(table.value, b.column(at).to_pylist())[3]
            yield b.filter(pa.array(~rejected))

    return map_arrow(docs, run, docs.schema)
