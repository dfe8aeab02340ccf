"""Line-first quality rules, in DataFrame functions only.

Each line is held against rules for punctuation, navigation and boilerplate; failing lines are dropped, and a document
that loses too many of its words with them is rejected. Everything is a map over the rows: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.settled import settled

SPACE, WORD = "[\\x20\\x09-\\x0D]+", "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: A line fails if it has no end of a sentence or clause anywhere, or has one of the others. Scripts whose sentences end in
#: marks of their own need no space behind them.
ENDS = "[.!?:;…]['\"”’»)\\]]*([\\x20\\x09-\\x0D]|\\z)|[。！？；：｡।॥؟؛۔။።၊]"
SHOUTS = "([!?]{2,}[^!?]*){3}"
NAVIGATES = "([\\x20\\x09-\\x0D][|>»•·/][\\x20\\x09-\\x0D][^|>»•·/]*){3}"
#: Phrases of page furniture, in whole words, that make a line of up to so many words boilerplate: in longer lines they are
#: what a text is about.
BOILERPLATE_WORDS = 25
PHRASES = (
    "lorem ipsum", "cookie (policy|settings)", "(use|accept|uses) cookies", "privacy policy", "terms (of|and) (use|service|conditions)", "all rights reserved",
    "click here", "read more", "sign (in|up)", "log ?in", "subscribe (now|to)", "enable javascript", "share on",
    "alle rechte vorbehalten", "datenschutzerklärung", "impressum", "mehr lesen", "hier klicken", "jetzt anmelden",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "lire la suite", "cliquez ici", "se connecter",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "leer más", "haga clic aquí", "iniciar sesión",
)
BOILERPLATE = f"(^|[^a-z])({'|'.join(PHRASES)})([^a-z]|$)"
#: A line also fails with more than one symbol in so many characters.
SYMBOL_SPAN = 30


def fails(line: Column) -> Column:
    """Whether a line breaks one of the rules."""
    symbols = F.length(line) - F.length(F.translate(line, SYMBOLS, ""))
    furniture = F.lower(line).rlike(BOILERPLATE) & (F.regexp_count(line, F.lit(WORD)) <= BOILERPLATE_WORDS)
    return ~line.rlike(ENDS) | (symbols * SYMBOL_SPAN > F.length(line)) | line.rlike(SHOUTS) | line.rlike(NAVIGATES) | furniture


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, repeat_percent: int = 50, lost_percent: int = 30) -> DataFrame:
    """One row per input row: the id, the base figures, and the verdict.

    (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lost_words, kept, clean_text). A null
    text has no words and so fails. 3-word windows are compared by 64-bit hashes within a text. Null ids, repeated rows
    and texts of any length pass through; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    t = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    t = t.select("id", "t", F.array_remove(F.split("t", SPACE, -1), "").alias("w"), F.split("t", "\n", -1).alias("lines"))
    hashes = F.expr("slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, greatest(size(w) - 2, 0))")
    t = t.select("*", hashes.alias("g"), F.filter("lines", lambda x: x.rlike(WORD)).alias("worded"))
    t = t.select("*", F.filter("worded", lambda x: ~fails(x)).alias("clean"), F.expr("CASE WHEN size(array_distinct(g)) < size(g) THEN sort_array(transform(g, (x, i) -> struct(x AS g, i AS i))) ELSE array() END").alias("s"))
    # where equal windows stand side by side, in order of place; each adds the words that the one before it has not covered
    twice = F.expr("sort_array(transform(filter(s, (x, i) -> x.g = get(s, i - 1).g OR x.g = get(s, i + 1).g), x -> x.i))")
    t = t.select("*", twice.alias("at"))
    covered = F.expr("aggregate(at, struct(0L AS n, -3 AS last), (a, p) -> struct(a.n + least(3, p - a.last) AS n, p AS last), a -> a.n)")
    words = F.size("w").cast("long")
    t = t.select(
        "id",
        words.alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.array_join("clean", "\n").alias("clean_text"),
    )
    t = settled(t, *t.columns[1:])
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    t = t.select("*", base_failed.alias("base_failed"), (F.col("n_words") - F.regexp_count("clean_text", F.lit(WORD))).cast("long").alias("n_lost_words"))
    return t.select("*", (~F.col("base_failed") & (100 * F.col("n_lost_words") <= lost_percent * F.col("n_words"))).alias("kept"))


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


QUALITY_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS worded FROM d),
c AS (SELECT *, list_filter(worded, lambda x: regexp_matches(x, '{_sql(ENDS)}')
               AND (length(x) - length(translate(x, '{SYMBOLS}', ''))) * {SYMBOL_SPAN} <= length(x)
               AND NOT regexp_matches(x, '{SHOUTS}') AND NOT regexp_matches(x, '{NAVIGATES}')
               AND NOT (regexp_matches(lower(x), '{_sql(BOILERPLATE)}') AND len(regexp_extract_all(x, '{WORD}')) <= {BOILERPLATE_WORDS})) AS clean FROM w),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM c),
p AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM p, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
f AS (SELECT c.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             (len(w) - len(regexp_extract_all(array_to_string(clean, chr(10)), '{WORD}')))::BIGINT AS n_lost_words
      FROM c LEFT JOIN r ON c.doc_id = r.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 30 * n_words AS kept
FROM f
"""
