"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

A candidate is a long run of token characters, less what fixed patterns cover. Its encoding is the smallest alphabet that has
all its characters. Three tests ask whether it can be random in that alphabet: chi-squared uniformity, runs about the
alphabet's middle, and lag-one serial correlation; a candidate whose combined p-value is small is ordinary text and out.
For the rest, the chi-squared statistic gives a p-value under the opposite hypothesis, that its letters are as uneven as in
words; its power grows with the length. Small alphabets have no power there and are held against a chain of letters and
digits by likelihood ratio instead. Benjamini-Hochberg, within each class of encoding and length over the whole table,
turns those into discoveries. The three p-values are combined by Fisher's rule as if they were independent, which only decides
who stays a candidate; ``AGREE`` is the evenness of English letters, and stands for words in any alphabet. Only counts by class and p-value bin, of a fixed number, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut, map_arrow

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(rb"AKIA[A-Z0-9]{12,}")
HEX = re.compile(rb"[0-9a-f]{32,}")
VALUE = 8
#: Encodings, smallest alphabet first.
ALPHABETS = (
    ("hex", "0123456789abcdef"),
    ("hex upper", "0123456789ABCDEF"),
    ("base32", string.ascii_uppercase + "234567"),
    ("base36", string.digits + string.ascii_lowercase),
    ("base36 upper", string.digits + string.ascii_uppercase),
    ("base62", string.digits + string.ascii_letters),
    ("base64", string.ascii_letters + string.digits + "+/"),
    ("base64url", string.ascii_letters + string.digits + "-_"),
)
_INDEX = []
for _, letters in ALPHABETS:
    at = np.full(256, -1, np.int16)
    at[np.frombuffer(letters.encode(), np.uint8)] = np.arange(len(letters))
    _INDEX.append(at)
#: Characters of runs that can hold an access key, a hexadecimal value or a candidate.
_TOKEN = np.zeros(256, bool)
_TOKEN[np.frombuffer((string.ascii_letters + string.digits + "+/-_").encode(), np.uint8)] = True
SHORTEST, CANDIDATE = 16, 20
#: Letters of words agree this often at two random places: the sum of their squared frequencies.
AGREE = 0.066
#: Alphabets of up to so many letters are too small for that sum to tell: their tokens are held against a chain of letters
#: and digits, as in names with numbers. Letters come by their frequency in texts, in ten-thousandths, or one time in
#: ten any; a digit follows a letter, and a letter a digit, as often as given.
SMALL, TO_DIGIT, TO_LETTER = 36, 0.1, 0.3
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (1202, 910, 812, 768, 731, 695, 628, 592, 602, 432, 398, 271, 288, 261, 209, 230, 203, 211, 182, 149, 111, 69, 10, 17, 11, 7), strict=True))
_LETTER = np.zeros(256)
for _c, _f in LETTERS.items():
    _LETTER[[ord(_c), ord(_c.upper())]] = math.log(0.9 * _f / sum(LETTERS.values()) + 0.1 / 26)
_LETTER[48:58] = math.log(0.1)
#: Bins of p-values: so many to a factor of ten, and the last one's number.
TENTHS, LAST = 4, 160
RANDOM_ALPHA, RATE = 0.001, 0.01


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def _chi_tail(x: float, df: int) -> float:
    """P(chi-squared with df degrees >= x), by Wilson and Hilferty's cube root."""
    c = 2 / (9 * df)
    return _normal_tail(((x / df) ** (1 / 3) - (1 - c)) / math.sqrt(c)) if x > 0 else 1.0


def battery(x: np.ndarray, size: int) -> tuple[float, float]:
    """(p if random, p if words) of indices into an alphabet of ``size`` letters."""
    n = len(x)
    counts = np.bincount(x, minlength=size)
    chi = float((counts.astype(float) ** 2).sum() * size / n - n)
    high = x >= size / 2
    n1 = int(high.sum())
    n0 = n - n1
    if n0 and n1:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * n0 * n1 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    y = x - x.mean()
    spread = float((y * y).sum())
    p_serial = 2 * _normal_tail(abs(float((y[1:] * y[:-1]).sum()) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    ps = [max(p, 1e-300) for p in (_chi_tail(chi, size - 1), p_runs, p_serial)]
    half = -sum(map(math.log, ps))  # half of Fisher's statistic, of 6 degrees of freedom
    random = math.exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0
    uneven = max(size * AGREE - 1, 0.5)
    words = _normal_tail((size - 1 + (n - 1) * uneven - chi) / math.sqrt(2 * (size - 1) + 4 * n * uneven))
    return random, words


def chained(u: np.ndarray, size: int) -> float:
    """p of a token of letters and digits under the chain, for random ones of an alphabet of ``size``.

    The inverse of the likelihood ratio, which exceeds r with a probability of 1 / r at most under the chain, once for
    each alphabet that could have been the token's.
    """
    digit = u < 58
    to = np.where(digit[:-1], np.where(digit[1:], 1 - TO_LETTER, TO_LETTER), np.where(digit[1:], TO_DIGIT, 1 - TO_DIGIT))
    log = math.log(0.5) + float(np.log(to).sum() + _LETTER[u].sum()) + len(u) * math.log(size) + math.log(len(ALPHABETS))
    return math.exp(min(log, 0.0))


def candidate(token: bytes) -> tuple[int, int] | None:
    """(class, bin) of a token that could be random; class 0 upwards by encoding and power of two of its length."""
    u = np.frombuffer(token, np.uint8)
    kind = next((k for k, at in enumerate(_INDEX) if (at[u] >= 0).all()), None)
    if kind is None or token.isdigit():
        return None
    size = len(ALPHABETS[kind][1])
    random, words = battery(_INDEX[kind][u].astype(np.int64), size)
    if size <= SMALL:
        words = chained(u, size)
    bin_ = min(LAST, int(-math.log10(max(words, 1e-300)) * TENTHS))
    return kind * 32 + min(31, len(u).bit_length()), bin_ if random >= RANDOM_ALPHA else -1


def scan(text: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int]]]:
    """The base spans (start, kind, end) in code points, sorted, and the candidates (start, end, class, bin)."""
    base: list[tuple[int, int, int]] = []
    if b":" in text or b"=" in text:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text.decode("utf-8", "replace")) if m.end(2) - m.start(2) >= VALUE]
    found: list[tuple[int, int, int, int]] = []
    token = _TOKEN[np.frombuffer(text, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], token, [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= SHORTEST
    plain, runs = text.isascii(), []
    shift, done = 0, 0  # code points less bytes up to ``done``
    for b, e in zip(begin[long].tolist(), end[long].tolist(), strict=True):
        if not plain:
            shift += len(text[done:b].decode("utf-8", "replace")) - (b - done)
            done = b
        run = text[b:e]
        for kind, pattern in ((1, ACCESS), (2, HEX)):
            base += [(b + m.start() + shift, kind, b + m.end() + shift) for m in pattern.finditer(run)]
        if e - b >= CANDIDATE:
            runs.append((b + shift, e + shift, run))
    base.sort()
    covered: list[list[int]] = []  # disjoint, in order
    for s, _, t in base:
        if covered and s <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], t)
        else:
            covered.append([s, t])
    k = 0
    for b, e, run in runs:
        while k < len(covered) and covered[k][1] <= b:
            k += 1
        at, j, rests = b, k, []
        while j < len(covered) and covered[j][0] < e:
            rests.append((at, covered[j][0]))
            at, j = covered[j][1], j + 1
        for s, t in [*rests, (at, e)]:
            if t - s >= CANDIDATE and (got := candidate(run[s - b : t - b])):
                found.append((s, t, *got))
    return base, found


def thresholds(counts: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """The lowest bin of each class that counts as a discovery, by Benjamini and Hochberg's step-up rule."""
    best = {}
    for c in {c for c, _ in counts}:
        bins = {b: n for (k, b), n in counts.items() if k == c}
        m, above = sum(bins.values()), 0
        for b in sorted((b for b in bins if b >= 0), reverse=True):
            above += bins[b]
            if m * 10 ** (-b / TENTHS) <= rate * above:  # the bin's largest p-value
                best[c] = b
    return best


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """One row per input row: (id, n_assign, n_access, n_hex, base_sha256, spans, n_random).

    A null text is scanned as an empty one. Null ids, repeated rows and texts of any length pass through; other columns are
    ignored; an empty table gives an empty result. The texts are read once; what is kept for the second pass is spans.
    """
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    kind = source.schema["id"].dataType.simpleString()
    span, cand = "array<struct<s: int, k: int, e: int>>", "array<struct<s: int, e: int, c: int, b: int>>"
    span_type = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
    cand_type = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("c", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans, cands = ([], [], []), [], [], []
            for t in batch.column(1):
                base, found = scan(t.as_py())
                for k, col in enumerate(counts):
                    col.append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest())
                spans.append([dict(zip("ske", x, strict=True)) for x in base])
                cands.append([dict(zip("secb", x, strict=True)) for x in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, span_type), pa.array(cands, cand_type)],
                names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"],
            )

    rows = cut(map_arrow(source, run, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base {span}, found {cand}"))
    seen = rows.select(F.explode("found").alias("x")).groupBy("x.c", "x.b").count().collect()
    limit = thresholds({(r["c"], r["b"]): r["count"] for r in seen}, rate)
    least = F.create_map(*[F.lit(x) for pair in (limit or {-1: 0}).items() for x in pair])
    random = F.transform(F.filter("found", lambda x: F.coalesce(x["b"] >= least[x["c"]], F.lit(False))), lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("k"), x["e"].alias("e")))
    every = F.array_sort(F.concat("base", "random"))
    names = F.array(*map(F.lit, KINDS))
    joined = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.withColumn("random", random).select("id", "n_assign", "n_access", "n_hex", "base_sha256", joined.alias("spans"), F.size("random").cast("long").alias("n_random"))
