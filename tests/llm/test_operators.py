"""Each operator on odd rows, on an empty table, and against a plain version of itself."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import ann, components, langid, line_dedup, mixing, packing, pretokens, quality, registry, secrets, simhash, substring_dedup, token_counts

from .conftest import LONG, ROWS

TEXTS = [t for _, t, _, _ in ROWS]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 1 secrets -----------------------------------------------------------------------------------------------------------


def plain_spans(t):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secret_base_spans_equal_plain_ones():
    rng = random.Random(4)
    parts = ["password", "PassWD", "api_key", "apikey", "ſecret", "secret", "token", " = ", ":", '="', "' : ", "abc-1", "x" * 8, "0123456789abcdef" * 2, "f", "AKIA", "AKIA" + "B3" * 7, "ü", "東", " ", "\n", "tokentoken:aaaaaaaaa"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert secrets.scan(t.encode())[0] == plain_spans(t), t


def test_battery_tells_random_from_words():
    rng = random.Random(5)
    letters = dict(secrets.ALPHABETS)
    words = [secrets.candidate("".join(rng.choice("etaoinshrdlu") for _ in range(48)).encode()) for _ in range(200)]
    rand = [secrets.candidate("".join(rng.choice(letters["base64"]) for _ in range(48)).encode()) for _ in range(200)]
    assert sum(b is not None and b[1] >= 20 for b in words) == 0
    assert sum(b[1] >= 20 for b in rand) > 180
    assert secrets.candidate(b"1" * 40) is None


def test_step_up_rule():
    counts = {(1, 40): 3, (1, 4): 100, (1, -1): 50, (2, 1): 9}
    assert secrets.thresholds(counts, 0.01) == {1: 40}
    assert secrets.thresholds({}, 0.01) == {}


def test_step_up_rule_equals_a_plain_one():
    rng = random.Random(20)
    for _ in range(200):
        counts = {(c, rng.choice([-1, *range(0, 40)])): rng.randrange(1, 30) for c in range(3) for _ in range(rng.randrange(8))}
        want = {}
        for c in {c for c, _ in counts}:
            ps = sorted(10 ** (-b / secrets.TENTHS) if b >= 0 else 1.0 for (k, b), n in counts.items() if k == c for _ in range(n))
            passing = [p for i, p in enumerate(ps, 1) if p < 1 and p <= 0.01 * i / len(ps)]
            if passing:
                want[c] = round(-np.log10(max(passing)) * secrets.TENTHS)
        assert secrets.thresholds(counts, 0.01) == want


def test_names_alone_give_no_discovery(spark):
    """A table without secrets: what is found is at most the odd one."""
    rng = random.Random(21)
    parts = ["counter", "window", "report", "account", "version", "section", "house", "letter", "number", "water", "running", "station", "2024", "10", "v2"]
    rows = [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(4, 9))) for _ in range(20))) for i in range(400)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_random")).first()[0]
    assert got <= 8


def test_rests_beside_base_spans_are_tested():
    rng = random.Random(22)
    key = "".join(rng.choice(dict(secrets.ALPHABETS)["base62"]) for _ in range(35))
    base, found = secrets.scan(f"é {'0123456789abcdef' * 2}{'Z' + key} x".encode())
    assert base == [(2, 2, 34)] and [f[:2] for f in found] == [(34, 70)]
    many = " ".join(f"token={'ab01' * 8}{i:08d}Zq {key}" for i in range(20_000)).encode()  # one long line
    base, found = secrets.scan(many)
    assert len(base) >= 20_000 and len(found) == 20_000


def test_secret_scan(spark, odd, none):
    rng = random.Random(6)
    random_ = ["".join(rng.choice(dict(secrets.ALPHABETS)["base64"]) for _ in range(64)) for _ in range(20)]
    rows = [(i, f"key é {r} token=abcdefgh12 {'ab01' * 8} AKIA{'Z' * 12}") for i, r in enumerate(random_)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        t = rows[r["id"]][1]
        base = plain_spans(t)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert set(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base) <= set(r["spans"].split(","))
    assert sum(f"random:6:{6 + 64}" in r["spans"] for r in got) >= 18
    assert secrets.find_secrets(odd).count() == len(ROWS) and secrets.find_secrets(none).count() == 0


def test_keys_of_every_encoding_among_ordinary_tokens(spark):
    rng = random.Random(16)
    letters = dict(secrets.ALPHABETS)
    lengths = {"hex": 31, "hex upper": 40, "base32": 52, "base36": 48, "base36 upper": 48, "base62": 43, "base64": 64, "base64url": 43}
    vocabulary = ["counter", "window", "report", "account", "version", "section", "house", "letter", "number", "water", "running", "station"]
    names = ["".join(rng.choice(vocabulary) + rng.choice(["", "", "", "2", "10", "2024"]) for _ in range(5)) for _ in range(300)]
    names += [n.upper() for n in names] + ["".join(w.title() for w in rng.sample(vocabulary, 6)) for _ in range(300)]
    keys = [(k, "".join(rng.choice(letters[k]) for _ in range(n))) for k, n in lengths.items() for _ in range(5)]
    rows = [(i, f"see {k} here") for i, (_, k) in enumerate(keys)] + [(1000 + i, f"see {n} here") for i, n in enumerate(names)]
    got = {r["id"]: r["n_random"] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = Counter(k for i, (k, _) in enumerate(keys) if got[i])
    assert all(found[k] >= 4 for k in lengths), found
    assert sum(got[1000 + i] for i in range(len(names))) <= 3


# ---- 2 lines -------------------------------------------------------------------------------------------------------------


def test_line_dedup(spark, odd, none):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == [*[c for c in odd.columns], "n_lines", "n_removed_lines"]
    rows = sorted((r["h"], r["text"], r["n_removed_lines"]) for r in got.collect())
    by = {h: (t, n) for h, t, n in rows}
    assert len(rows) == len(ROWS) and by[0] == (TEXTS[0], 0) and by[9][0] == LONG and by[4][0] is None
    assert by[1] == by[2] and by[1][1] > 0 and len(by[1][0]) < len(TEXTS[1])  # twins lose what document 1 has, not each other
    assert line_dedup.dedup_lines(none).count() == 0


def test_lines_survive_shifts(spark):
    block = "\n".join(f"shared line {i} ends." for i in range(30))
    rows = [(1, block), (2, "an inserted line.\n" + block + "\nand another."), (3, "nothing\nshared.")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed_lines"] == 0 and got[3]["text"] == rows[2][1]
    assert 15 <= got[2]["n_removed_lines"] <= 30 and got[2]["text"].startswith("an inserted line.") and got[2]["text"].endswith("and another.")


def test_filter_behind_line_dedup_stays_behind(spark, odd):
    plan = line_dedup.dedup_lines(odd).where("n_removed_lines = 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")


# ---- 3 quality -----------------------------------------------------------------------------------------------------------


def plain_quality(t):
    w = WORDS.findall(t)
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_quality(spark, odd, none):
    rng = random.Random(7)
    texts = [*TEXTS, *["".join(rng.choice(["a", "b ", "c ", "\n", "# ", "d.", "\x0b", "\xa0", "e e e "]) for _ in range(rng.randrange(200))) for _ in range(100)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r for r in quality.assess(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain_quality(t or "")
        assert not (r["base_failed"] and r["kept"])
    good = "This is a plain sentence with words in it. " * 1 + " ".join(f"Word{i} stands{i} alone." for i in range(30))
    menu = "\n".join(f"Home{i} | About{i} | Contact{i} | Login{i} | More{i}" for i in range(30))
    kept = {r["id"]: r["kept"] for r in quality.assess(spark.createDataFrame([(1, good), (2, menu)], "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False}
    assert quality.assess(odd).count() == len(ROWS) and quality.assess(none).count() == 0
    assert quality.assess(df).where("kept").count() == sum(r["kept"] for r in got.values())


def test_each_line_rule(spark):
    good = [
        "The new design in room 3 was drawn by hand, and the analog input stays.",
        "Roads need repair; spread moreover the sand evenly. A cookie is baked.",
        "我们昨天去了那个新的市场。",
        "क्या आप कल बाजार गए थे।",
        "هل ذهبت إلى السوق؟",
        "The privacy policy of a firm, as the court found in its long and careful opinion of last year, binds it towards each of its customers, whether or not they read it.",
    ]
    bad = ["a line without any end", "Home / Shop / News / About us / Contact.", "What!! No!! Really?? ok.", "# $ % & | some.", "Click here.", "Please read more.", "Alle Rechte vorbehalten.", "Leer más."]
    df = spark.createDataFrame([(x,) for x in good + bad], "line string")
    got = {r["line"]: r["f"] for r in df.select("line", quality.fails(F.col("line")).alias("f")).collect()}
    assert [x for x in good if got[x]] == [] and [x for x in bad if not got[x]] == []


# ---- 4 languages ---------------------------------------------------------------------------------------------------------


def test_language_id(spark, sample, odd, none):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    model = langid.fit(docs)
    got = langid.identify(docs, model).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id").where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert sum(r["rejected"] for r in got) <= 0.05 * len(got) and all(0 <= r["score"] <= 1 for r in got)
    strange = {(r["lang_pred"], r["rejected"]) for r in langid.identify(odd.where("text is null or trim(text) in ('') or doc_id = 7"), model).collect()}
    assert strange == {("und", True)}
    assert langid.identify(odd, model).count() == len(ROWS) and langid.identify(none, model).count() == 0
    untaught = langid.fit(none)
    assert {r["lang_pred"] for r in langid.identify(odd, untaught).collect()} == {"und"}


def test_kneser_ney_sums_to_one_and_blocks_agree(monkeypatch):
    import pyarrow as pa

    texts = ["abracadabra abra", "banana bandana", "cabana"]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 1], pa.int32()), pa.array(texts)], names=["lang", "t"])
    model = langid.estimate(["x", "y"], pa.Table.from_batches(list(langid._count(iter([batch])))))
    seen = sorted(set("".join(texts)))
    c = langid.codes("banan")
    total = np.zeros(2)
    for ch in seen:
        whole = np.append(c, ord(ch)).astype(np.uint32)
        total += np.exp(model.score(langid.hashes(whole), np.array([len(whole) - 1]))[0].astype(float))
    assert (total <= 1.0001).all() and (total > 0.6).all()
    once = model.entropies(texts)[0]
    monkeypatch.setattr(langid, "BLOCK", 5)
    assert np.allclose(once, model.entropies(texts)[0], atol=1e-5)
    assert np.allclose(once[1], model.entropies([texts[1]])[0][0], atol=1e-5)  # a text's score is its own


def test_kneser_ney_equals_a_plain_model():
    import pyarrow as pa

    texts = [["abracadabra abra", "banana band"], ["xyz zyx xyzzy", "zebra"]]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0, 1, 1], pa.int32()), pa.array(sum(texts, []))], names=["lang", "t"])
    model = langid.estimate(["p", "q"], pa.Table.from_batches(list(langid._count(iter([batch])))))
    broken = "\x01" * (langid.ORDER - 1)

    def plain(own):
        grams = {k: Counter() for k in range(1, langid.ORDER + 1)}
        for t in own:
            t = broken + t
            for k in grams:
                grams[k].update(t[i - k + 1 : i + 1] for i in range(langid.ORDER - 1, len(t)))
        kept = {langid.ORDER: grams[langid.ORDER]}
        for k in range(1, langid.ORDER):  # how many different characters stand before
            kept[k] = Counter(g[1:] for g in grams[k + 1])

        def p(context, c):
            k = len(context) + 1
            n = kept[k]
            once, twice = max(1, sum(v == 1 for v in n.values())), max(1, sum(v == 2 for v in n.values()))
            d = once / (once + 2 * twice)
            beside = [v for g, v in n.items() if g[:-1] == context]
            lower = p(context[1:], c) if context else langid.UNSEEN
            if not beside:
                return lower
            return max(n[context + c] - d, 0) * (context + c in n) / sum(beside) + d * len(beside) / sum(beside) * lower

        return p

    for j, own in enumerate(texts):
        p = plain(own)
        for word in ("abra", "zyxa", "banxq", "q"):
            t = broken + word
            want = -sum(np.log(p(t[i - langid.ORDER + 1 : i], t[i])) for i in range(langid.ORDER - 1, len(t))) / len(word)
            assert abs(model.entropies([word])[0][0, j] - want) < 1e-4, (word, j)


def test_temper_is_the_likeliest():
    h = np.array([[1.0, 1.1], [1.0, 1.05], [1.2, 1.0], [1.02, 1.0]])
    lang, n = np.array([0, 1, 1, 1]), np.array([50, 40, 60, 10])
    best = langid._temper(h, lang, n)
    assert best in [2.0**i for i in range(9)] and best > 1


# ---- 5 tokens ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pretokens_equal_library(name):
    path = public_tokenizers.path(name)
    coder, library, rng = pretokens.Encoder(path, list), Tokenizer.from_file(path), random.Random(8)
    letters = "ab'sSt .,!\n\t09ÄÖßéñİ́Ωσς中😀\x00\x1c\x85\xa0ſŉ"
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice([*letters, "<|endoftext|>", "<|startoftext|>"]) for _ in range(rng.randrange(20))) for _ in range(3000)]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}1" for c in range(pretokens.LIMIT)]
    for t in texts:
        assert [i for v in coder.values(t) for i in v] == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_counts(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(odd, path).collect())
    want = [(len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in TEXTS]
    assert got == sorted((b, n, n > 2048) for b, n in want)
    assert token_counts.count_tokens(none, path).count() == 0


def test_cache_forgets_without_losing(monkeypatch):
    monkeypatch.setattr(pretokens, "CACHED", 5)
    coder = pretokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), len, {"fox": 1})
    assert sum(coder.values("the fox " * 3 + " ".join(f"w{i}" for i in range(40)))) == sum(pretokens.Encoder(public_tokenizers.path("word_bpe_49k.json"), len).values("the fox " * 3 + " ".join(f"w{i}" for i in range(40))))
    assert len(coder) <= 7


# ---- 6 mixing ------------------------------------------------------------------------------------------------------------


def test_mixing(spark, odd, none):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 60), f"s{rng.randrange(7) if i % 3 else 0}") for i in range(900)] + [(9999, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).join(docs.select(F.col("doc_id").alias("id"), "source"), "id").collect()
    assert len(got) == len(rows)
    total, taken, target = Counter(), Counter(), {}
    for r in got:
        total[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert abs(sum(target.values()) - 1.5 * sum(total.values())) < 1e-6
    for s, t in target.items():
        assert t <= 2 * total[s] + 1e-9 and 0 <= t - taken[s] <= 60
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(x for x in target if x is not None))}
    free = [s for s in weight if target[s] < 2 * total[s] - 1e-9]
    assert len({round(target[s] / weight[s], 6) for s in free}) <= 1  # what is below its bound shares by weight
    again = {r["id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r["id"]: r["taken"] for r in got}
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)
    assert mixing.mix(odd).count() == len(ROWS) and mixing.mix(none).count() == 0 and mixing.mixed(odd).columns == odd.columns


def test_mixing_without_broadcast(spark, sample, monkeypatch):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    one = sorted(map(tuple, mixing.mix(docs).select("id", "taken").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs).select("id", "taken").collect())) == one


# ---- 7 substrings --------------------------------------------------------------------------------------------------------


def test_boundaries_are_local(monkeypatch):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(400))

    def chosen(lead):
        t = f"{' '.join(word() for _ in range(lead))} {passage} {word()}".encode()
        b = np.frombuffer(t, np.uint8)
        start = substring_dedup.words_of(b)[0]
        return {int(w) - lead for w in substring_dedup.boundaries(b, start, 35, 16)}

    a, b = chosen(7), chosen(160)
    assert {w for w in a if 0 <= w < 365} - set(range(15)) <= b and {w for w in b if 15 <= w < 365} <= a
    gaps = np.diff(sorted(w for w in a if w >= 0))
    assert gaps.max() <= 16  # any 50 words hold a whole chunk
    raw = np.frombuffer(passage.encode(), np.uint8)
    once = substring_dedup.gear(raw)
    monkeypatch.setattr(substring_dedup, "BLOCK", 700)
    assert (substring_dedup.gear(raw) == once).all()
    same = np.frombuffer(b"a " * 100, np.uint8)
    assert len(substring_dedup.boundaries(same, substring_dedup.words_of(same)[0], 35, 16)) <= 100


def check_windows(found, rows, n=50):
    """Passages are equal throughout, and cover every window of n words that a document of smaller id has."""
    by = {i: (t or "").encode() for i, t in rows}
    spans = defaultdict(list)
    for r in found:
        size = r["end"] - r["start"]
        own = by[r["id"]][r["start"] : r["end"]]
        assert r["first_id"] < r["id"] and own == by[r["first_id"]][r["first_start"] : r["first_start"] + size] and len(own.split()) == r["words"] >= n
        spans[r["id"]].append((r["start"], r["end"]))
    seen, repeated = {}, set()
    for i in sorted(by):
        start, end = substring_dedup.words_of(np.frombuffer(by[i], np.uint8))
        windows = [(int(s), int(e), by[i][s:e]) for s, e in zip(start, end[n - 1 :], strict=False)]
        for s, e, w in windows:
            if w in seen:
                repeated.add(i)
                assert any(a <= s and e <= z for a, z in spans[i]), (i, s, e)
        for _, _, w in windows:
            seen.setdefault(w, i)
    assert spans.keys() == repeated
    return spans


def test_passages_equal_all_windows(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert check_windows(substring_dedup.repeated_passages(docs).collect(), rows)


def test_passages_among_parts_in_many_documents(spark):
    rng = random.Random(15)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9)))
    text = lambda n: [word() for _ in range(n)]
    shared, rows = text(120), []
    for i in range(6):  # each a sixth of the passage
        rows.append((i, " ".join([*text(20), *shared[20 * i : 20 * i + 20], *text(20)])))
    rows += [(k, " ".join([*text(30), *shared, *text(30)])) for k in (10, 11)]
    other = text(120)
    for i in range(8):  # overlapping parts that nearly suffice, so that no first occurrence of a chunk does
        rows.append((20 + i, " ".join([*text(20), *other[10 * i : 10 * i + 46], *text(20)])))
    rows += [(k, " ".join([*text(30), *other, *text(30)])) for k in (40, 41, 42)]
    short = text(51)
    rows += [(50, " ".join([*text(9), *short[:45], *text(9)])), (51, " ".join([*text(9), *short[6:], *text(9)])), (52, " ".join(short)), (53, " ".join([*text(9), *short]))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = check_windows(found, rows)
    assert spans.keys() == {11, 41, 42, 53} and max(r["words"] for r in found if r["id"] == 11) == 120


def test_hostile_texts_have_all_their_passages(spark):
    rng = random.Random(17)
    rows = [(i, " ".join(rng.choice(["a", "b", "c\n", "dé"][: 1 + i % 4]) for _ in range(rng.randrange(40, 160)))) for i in range(40)]
    check_windows(substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect(), rows)


def test_passages(spark, odd, none):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(20)]
    rows = [(i, f"{text(30)} {shared[i % 20]} {text(30)}") for i in range(60)] + [(i, text(120)) for i in range(100, 160)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    caught = {r["id"] for r in found}
    assert caught == set(range(20, 60))
    by = dict(rows)
    for r in found:
        n = r["end"] - r["start"]
        assert by[r["id"]][r["start"] : r["end"]] == by[r["first_id"]][r["first_start"] : r["first_start"] + n] and r["words"] >= 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(df, substring_dedup.repeated_passages(df)).collect()}
    assert all(left[i] == by[i] for i in by if i not in caught) and all(len(left[i]) < len(by[i]) - 300 for i in caught)
    assert {r["id"] for r in substring_dedup.repeated_passages(odd).collect()} <= {1, 2, 8, 9, None}
    assert substring_dedup.repeated_passages(none).count() == 0
    assert substring_dedup.without("aéb", [{"start": 2, "end": 4}]) == "aé"


def test_passages_with_parts_of_third_documents(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9)))
    text = lambda n: [word() for _ in range(n)]
    rows, want = [], {}
    for i in range(20):
        shared = text(51)
        rows.append((i, " ".join([*text(20), *shared[8:20], *text(20), *shared[26:38], *text(20)])))
        for k in (100 + i, 200 + i):
            before = " ".join(text(30)) + " "
            rows.append((k, before + " ".join([*shared, *text(30)])))
            want[k] = (len(before), len(before) + len(" ".join(shared)))
    found = {r["id"]: r for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found.keys() == set(range(200, 220))
    for k, r in found.items():
        assert r["first_id"] == k - 100 and (r["start"], r["end"]) == want[k] and r["words"] == 51


def test_only_whole_words_in_equal_bytes_count():
    def words(own, other, core, size, other_begins=True):
        start, end = substring_dedup.words_of(np.frombuffer(own, np.uint8))
        return substring_dedup.equal_words(own, other, core, size, True, other_begins, start, end)

    assert words(b"one two three four", b"xne two three four", 4, 3) == (1, 4)
    assert words(b"one two three four", b"one two threx four", 4, 3, False) == (1, 2)
    assert words(b"a b c d", b"a b c d", 2, 3) == (0, 4)
    assert words(b"a b c d", b"a b c dd", 2, 3) == (0, 3)
    assert words(b"a b", b"a x", 2, 1) == (0, 0)


# ---- 8 packing -----------------------------------------------------------------------------------------------------------


def test_bounds_and_best_fit():
    rng = np.random.default_rng(12)
    for _ in range(300):
        lengths = np.sort(rng.integers(1, 21, rng.integers(0, 30)))[::-1]
        where, offset, fill = packing.best_fit_decreasing(lengths, 20)
        assert (fill <= 20).all() and (np.bincount(where, lengths, len(fill)) == fill).all()
        assert -(-int(lengths.sum()) // 20) <= packing.lower_bound(lengths, 20) <= len(fill)
    assert packing.lower_bound(np.array([11] * 7), 20) == 7 and packing.lower_bound(np.array([7] * 6), 20) == 3


def check_packing(rows, docs, path, size):
    library = Tokenizer.from_file(path)
    want = Counter()
    for i, t in docs:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at, to, k = 0, len(ids) % size or size, 0
        while at < len(ids):
            want[i, k, at, to - at, zlib.crc32(ids[at:to].tobytes())] += 1
            at, to, k = to, to + size, k + 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_packing(spark, odd, none, sample):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_packing(packing.pack(packing.pieces(odd, path)).collect(), [(i, t) for i, t, _, _ in ROWS], path, 2048)
    docs = spark.read.parquet(f"{sample}/documents.parquet").select("doc_id", "text")
    for rows in (50, 8192):  # many small groups with exchange, or one
        got = packing.pack(packing.pieces(docs, path, size=512), 512, group_rows=rows).collect()
        n = check_packing(got, [tuple(r) for r in docs.collect()], path, 512)
        assert n <= packing.lower_bound(np.array([r["length"] for r in got]), 512) * 1.02 + 1
    assert packing.pack(packing.pieces(none, path)).count() == 0


def test_equal_pieces_are_dealt_to_many_groups(spark):
    same = spark.range(50_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("length"), F.lit(7).cast("long").alias("ids_crc32"))
    got = packing.pack(same).cache()
    assert got.count() == 50_000
    first = got.groupBy((F.shiftright("sequence_id", 22)).alias("g")).count().agg(F.max("count")).first()[0]
    assert first <= 10_000
    assert got.select("sequence_id").distinct().count() == -(-50_000 // 2048)


def test_bins_of_many_groups_meet_the_bound_of_the_whole(spark):
    rng = np.random.default_rng(19)
    lengths = [int(x) for x in np.minimum(2048, rng.lognormal(5.5, 1.0, 20_000)) + 1]
    rows = [(i, 0, 0, min(n, 2048), 1) for i, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, group_rows=500).collect()
    bins = Counter()
    for r in got:
        bins[r["sequence_id"]] += r["length"]
    assert len(got) == len(rows) and max(bins.values()) <= 2048
    assert len(bins) <= packing.lower_bound(np.array([r[3] for r in rows]), 2048) * 1.001 + 1


# ---- 9 neighbours --------------------------------------------------------------------------------------------------------


def exact_neighbours(ids, m, k):
    out = {}
    for q in sorted({i for i in ids if i % 20 == 0}):
        at = ids.index(q)
        s = np.array([float(np.dot(m[at], x)) for x in m])
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q]
        out[q] = [(ids[j], s[j]) for j in order[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(13)
    m = rng.standard_normal((3000, 24)) * rng.uniform(0.2, 3, (3000, 1))
    m[100:400] = 5 * m[100] / np.linalg.norm(m[100]) * 3  # one long vector many times
    ids = list(range(3000))
    rows = [(i, x.tolist()) for i, x in zip(ids, m, strict=True)]
    bad = [(None, [1.0] * 24), (5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] * 24), (5004, []), (5005, [1.0]), (5020, [float("inf")] * 24)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("list", F.lit(1)).withColumn("id", F.lit(2))
    got = defaultdict(list)
    for r in ann.search(df, F.col("id") % 20 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = exact_neighbours(ids, m, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, rows_ in got.items():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21))
        assert all(abs(float(np.dot(m[q], m[i])) - s) < 1e-9 for _, i, s in rows_)
        assert [(-round(s, 9), i) for _, i, s in rows_] == sorted((-round(s, 9), i) for _, i, s in rows_)
        hits += len({i for _, i, _ in rows_} & {i for i, _ in want[q]})
    assert hits / (20 * len(want)) >= 0.9
    assert [i for _, i, _ in got[100]] == list(range(101, 121))  # ties by id


def test_repeated_ids_are_one_vector_in_any_order(spark):
    rng = np.random.default_rng(23)
    rows = [(int(i), rng.standard_normal(8).round(3).tolist()) for i in list(range(200)) * 2]
    search = lambda r, n: sorted(map(tuple, ann.search(spark.createDataFrame(r, "vec_id long, embedding array<double>").repartition(n), F.col("id") % 20 == 0).collect()))
    one = search(rows, 3)
    assert one == search(rows[::-1], 5)
    least = {}
    for i, v in rows:
        least[i] = min(v, least.get(i, v))
    want = exact_neighbours(list(least), np.array(list(least.values())), 20)
    assert {(q, i) for q, _, i, _ in one} == {(q, i) for q, found in want.items() for i, _ in found}


def test_recall_over_many_lists(spark):
    rng = np.random.default_rng(24)
    hubs = rng.standard_normal((300, 16))
    m = hubs[rng.integers(0, 300, 52_000)] + 0.3 * rng.standard_normal((52_000, 16))
    got = defaultdict(set)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(m)), "embedding": list(m)}), "vec_id long, embedding array<double>").repartition(8)
    for r in ann.search(df, F.col("id") % 2000 == 0).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q, found in got.items():
        s = m @ m[q]
        s[q] = -np.inf
        hits += len(found & set(np.argpartition(-s, 20)[:20].tolist()))
    assert len(got) == 26 and hits >= 0.9 * 20 * 26


def test_few_neighbours(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(5)] + [(0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"]) for r in ann.search(df, F.col("id") % 20 == 0).orderBy("rank").collect()] == [(0, 4), (0, 3), (0, 2), (0, 1)]
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0


# ---- 10 near-duplicates --------------------------------------------------------------------------------------------------


def plain_fingerprint(t, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = WORDS.findall(low)
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if sum((x ^ y).bit_count() for x, y in zip(fps[a], fps[b], strict=True)) <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_fingerprints():
    texts = [*TEXTS[:9], "One", "One TWO", "One two\x0bthree", "ÀÉ É à é", "a\xa0b c d e"]
    assert [simhash.fingerprint(None if t is None else t.encode()) for t in texts] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize(("radius", "segments", "halves", "part"), [(3, 2, 1, 1 << 16), (5, 3, 1, 1 << 16), (2, 3, 1, 1 << 16), (10, 6, 2, 1 << 16), (11, 4, 2, 1 << 16), (9, 4, 2, 64)])
def test_links_equal_all_pairs(spark, radius, segments, halves, part, monkeypatch):
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(radius)
    fps = {tuple(rng.getrandbits(64) for _ in range(halves)) for _ in range(150)}
    for f in list(fps) * 2:  # neighbours at every distance about the radius, and clusters
        g = list(f)
        for b in rng.sample(range(64 * halves), rng.randrange(1, radius + 3)):
            g[b // 64] ^= 1 << b % 64
        fps.add(tuple(g))
    base = [rng.getrandbits(64) for _ in range(halves)]
    for _ in range(300 if part < 1000 else 40):  # many under the same keys
        g = list(base)
        for b in rng.sample(range(24), rng.randrange(8)):
            g[0] ^= 1 << b
        fps.add(tuple(g))
    fps = sorted(fps)
    signed = [tuple(x - (1 << 64) if x >> 63 else x for x in f) for f in fps]
    df = spark.createDataFrame(signed, ", ".join(f"{c} long" for c in ("fp", "fp2")[:halves]))
    key = lambda r: (r,) if halves == 1 else tuple(r)
    star = {key(r["node"]): key(r["root"]) for r in components.stars(simhash.links(df, radius, segments)).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for i, c in enumerate(components_of(fps, radius)):
        want[c].add(signed[i])
        groups[star.get(signed[i], signed[i])].add(signed[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values())) and len(want) > 20


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_stars_take_few_jobs_a_round(spark, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(10)
    hub = [(0, i) for i in range(1, 400)]
    chains = [(i, i + 1) for k in range(60) for i in range(1000 + 50 * k, 1000 + 50 * k + rng.randrange(1, 49))]
    several = [tuple(rng.sample(range(5000, 5300), 2)) for _ in range(200)]
    pairs = [p[::-1] if rng.random() < 0.5 else p for p in hub + chains + several]
    names = rng.sample(range(10_000), 5300)  # so that the smallest is anywhere
    pairs = [(names[a], names[b]) for a, b in pairs]
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    edges = spark.createDataFrame([*pairs, *pairs[:50], (7, 7), (None, 3)], "a long, b long")
    rounds, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: rounds.append(1) or cut(df))
    sc = spark.sparkContext
    sc.setJobGroup(f"stars {few}", "")
    try:
        got = components.stars(edges)
        jobs = len(sc.statusTracker().getJobIdsForGroup(f"stars {few}"))
    finally:
        sc._jsc.clearJobGroup()
    n = (len(rounds) - 2) // 3  # the edges, the nodes of the last state, and three tables a round
    assert sorted((r["node"], r["root"]) for r in got.collect()) == sorted((x, root(x)) for x in parent if root(x) != x)
    assert n >= 3 and (few == 0 or jobs <= 12 * n + 6)  # it was 18 a round


def test_near_duplicates(odd, none, spark):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    by = defaultdict(set)
    for r in got:
        by[r["id"]].add((r["fp"], r["component"]))
    assert by[1] == by[2] and {c for _, c in by[1]} == {1}
    assert by[5] == by[6] == by[7] == {(0, 5)} and (0, 5) in by[None]
    assert simhash.near_duplicates(none).count() == 0


def test_near_duplicates_are_named_alike_by_either_join(spark, odd, monkeypatch):
    exchanges, rows = {}, {}
    for few in (components.FEW, 0):
        monkeypatch.setattr(components, "FEW", few)
        got = simhash.near_duplicates(odd)
        exchanges[few] = got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        rows[few] = sorted(map(str, got.collect()))
    assert len(set(map(tuple, rows.values()))) == 1 and exchanges[1 << 16] == 0 < exchanges[0]


def test_similar_groups_equal_all_pairs(spark, odd, none):
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 9)))
    texts = [[word() for _ in range(rng.randrange(150, 400))] for _ in range(40)]
    for t in list(texts):
        for _ in range(rng.randrange(1, 5)):
            new = list(t)
            for _ in range(rng.randrange(1, max(2, len(t) // 30))):
                new[rng.randrange(len(t))] = word()
            texts.append(new)
    hub = [word() for _ in range(200)]
    for _ in range(60):  # near copies of one text, not all near each other
        new = list(hub)
        for _ in range(4):
            new[rng.randrange(200)] = word()
        texts.append(new)
    texts += [hub, texts[0], texts[0][::-1], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [simhash.shingles(t.encode(), 5) for _, t in rows]
    parent = list(range(len(rows)))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r["id"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    together = lambda of: [of[a] == of[b] for a, b in pairs]
    assert all(together(parent)) and sum(together(got)) >= 0.97 * len(pairs), (sum(together(got)), len(pairs))
    assert all(parent[i] == parent[c] for i, c in got.items())  # nothing joined that isn't alike
    out = simhash.similar_groups(odd).collect()
    assert len(out) == len(ROWS) and {r["component"] for r in out if r["id"] in (1, 2)} == {1}
    assert {r["component"] for r in out if r["id"] in (5, 6, 7)} == {5}
    assert simhash.similar_groups(none).count() == 0


@pytest.mark.parametrize(("counted", "part"), [(simhash.COUNTED, simhash.PART), (1, 8)])
def test_similar_groups_leave_no_pair_out(spark, counted, part, monkeypatch):
    monkeypatch.setattr(simhash, "COUNTED", counted)
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(100):  # many orders of the same words, so that all meet, each with one text alike
        one = rng.sample(words, len(words))
        two = list(one)
        if k < 40:
            i = rng.randrange(len(words) - 1)
            two[i], two[i + 1] = two[i + 1], two[i]
        else:
            for i in range(0, 120, 30):
                one[i] = two[i] = f"x{rng.randrange(10**6)}"
            del two[-3:]
        texts += [one, two]
    texts += [["y", *w] for w in (["a", "b", "c"], ["a", "b", "c"], ["a", "c", "b"])]
    texts += [[f"z{i}" for i in range(24)][: 24 - cut] for cut in (0, 4, 8)]  # exactly at 0.8, and 0.75 of that
    texts += [["common"] * 6 + [f"c{i}" for i in range(8)] + [f"v{k}" for _ in range(k)] for k in range(30)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [simhash.shingles(t.encode(), 5) for _, t in rows]
    want = list(range(len(rows)))
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    got = {r["id"]: r["component"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(want)) and len(pairs) > 100


def test_many_near_copies_take_links_in_proportion(spark):
    rng = random.Random(11)
    hub = [f"w{i}" for i in range(150)]

    def found(n):
        texts = []
        for _ in range(n):
            new = list(hub)
            for _ in range(rng.randrange(1, 4)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(new))
        docs = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("h"))
        at = {r["h"]: i for i, r in enumerate(docs.collect())}
        none = spark.createDataFrame([], "a long, b long")
        links = [(at[r["a"]], at[r["b"]]) for r in simhash.alike_besides(docs, none, "text", 5, 0.8).collect()]
        sets = [simhash.shingles(t.encode(), 5) for t in texts]
        near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        assert all(near(a, b) for a, b in links)
        pairs = [(a, b) for a in range(n) for b in range(a) if near(a, b)]
        joined = lambda of: simhash._joined(np.arange(n), *np.array(of).T).tolist()
        assert joined(links) == joined(pairs) and len(pairs) > n * n // 10
        return len(set(links)), len(links)

    (few, few_rows), (many, many_rows) = found(100), found(400)
    assert many <= 6 * few and many_rows <= 6 * few_rows, (few, few_rows, many, many_rows)  # 16 times as many pairs


def test_large_groups_are_compared_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "WIDE", 8)
    key, node = np.repeat([3, 5, 9], [2, 30, 8]), np.random.default_rng(2).permutation(40)
    groups = list(simhash._gathered(key, node))
    met = {(min(a, b), max(a, b)) for g in groups for a in g.tolist() for b in g.tolist() if a != b}
    assert met == {(a, b) for a in range(40) for b in range(a + 1, 40) if key[a] == key[b]}
    assert max(map(len, groups)) <= 8


def test_marks_leave_every_text_that_has_one_alike():
    rng = random.Random(6)
    texts = []
    for n in (3, 40, 250, 260, 900, 3000):  # marks of several widths
        base = [f"w{n}_{i}" for i in range(n)]
        for change in (0, 1, 2, 5, 12, 40):
            new = base[: n - rng.randrange(1 + n // 20)]
            for _ in range(change):
                new[rng.randrange(len(new))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(new).encode())
    sets = [simhash.shingles(t, 5) for t in texts]
    label = np.arange(len(texts)) // 2 * 2  # pairs of one label
    hashes = [simhash._hashes(t, 5) for t in texts]
    got = simhash._unlike(list(map(simhash._marks, hashes)), np.array(list(map(len, hashes))), label, 0.8)
    near = lambda a, b: label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = np.array([any(near(a, b) for b in range(len(texts))) for a in range(len(texts))])
    assert not (got & want).any() and want.sum() > 5 and got.sum() > 5


def test_possible_rows_equal_all_comparisons():
    rng = np.random.default_rng(3)
    key, label = np.sort(rng.integers(0, 60, 500)), rng.integers(0, 5, 500)
    size = rng.integers(5, 60, 500)
    place = rng.integers(0, size)
    both = np.minimum.outer(size - place, size - place)
    want = (key[:, None] == key) & (label[:, None] != label) & (both * 1.8 >= 0.8 * np.add.outer(size, size) - 1e-6)
    assert np.array_equal(simhash._possible(key, place, size, label, 0.8), want.any(axis=1)) and 0 < want.any(axis=1).sum() < 500


def test_hot_keys_get_their_values(spark):
    rows = spark.createDataFrame([(1, i) for i in range(5000)] + [(i, 0) for i in range(2, 3000)], "key long, x long")
    values = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("value", F.col("key") * 2)
    got = components.matched(rows, values, "key", "n", rows.count())
    assert got.columns == ["key", "x", "value"] and got.count() == rows.count() and got.where("value <> key * 2").count() == 0


def test_long_chains_have_one_root(spark):
    rows = [(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)]
    got = {r["node"]: r["root"] for r in components.stars(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1001: 1000}


# ---- queries -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_equal_sql(spark, sample, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sample}/documents.parquet'")
    want = con.sql(registry.ORACLES[name])
    cols = sorted(want.columns)
    got = registry.QUERIES[name](spark, sample)
    assert sorted(got.columns) == cols
    tidy = lambda rows: sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)
    assert tidy(map(tuple, got.select(*cols).collect())) == tidy(want.project(", ".join(cols)).fetchall())
