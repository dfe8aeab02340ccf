"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A line ends a chunk where a rolling hash over its own and the previous line's hash is a multiple of ``divisor``, so an
inserted line shifts no boundary beyond it. Chunks of several lines that occur again anywhere are removed, but for their
first occurrence. Digests find candidates; each candidate is then compared byte by byte with the first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.settled import settled
from graphloom.session import cut

#: The rolling hash: the previous line's 28-bit hash times this, plus the line's own.
FACTOR, DIGITS = 31, 7


def _chunks(df: DataFrame, text: Column, keep: list[str], name: str, divisor: int, min_lines: int) -> DataFrame:
    """The columns ``keep`` and the text's chunks: (pos, n: lines, t: text, m: enough lines with a word). Null for null."""
    d = df.select(*keep, F.split(text, "\n", -1).alias("_l"))
    d = d.select("*", F.expr(f"transform(_l, x -> cast(conv(substring(md5(cast(x AS binary)), 1, {DIGITS}), 16, 10) AS bigint))").alias("_h"))
    ends = f"filter(sequence(0, size(_l) - 1), i -> i = size(_l) - 1 OR (coalesce(get(_h, i - 1), 0) * {FACTOR} + get(_h, i)) % {divisor} = 0)"
    d = d.select(*keep, "_l", F.expr(f"CASE WHEN _l IS NOT NULL THEN {ends} END").alias("_e"))
    parts = "transform(_e, (b, j) -> struct(j AS pos, slice(_l, coalesce(get(_e, j - 1), -1) + 2, b - coalesce(get(_e, j - 1), -1)) AS l))"
    several = f"size(filter(x.l, y -> y rlike '[^\\\\x20\\\\x09-\\\\x0D]')) >= {min_lines}"
    d = d.select(*keep, F.expr(parts).alias("_p"))
    return d.select(*keep, F.expr(f"transform(_p, x -> struct(x.pos AS pos, size(x.l) AS n, array_join(x.l, '\\n') AS t, {several} AS m))").alias(name))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 3, min_lines: int = 2) -> DataFrame:
    """(id, v, gone): the positions of the chunks to remove from each document that has some; v is a hash of its text.

    Digests are counted with map-side combine and travel without text. Only the texts of documents with a candidate are
    brought together with their candidates, once; of those, only the candidate chunks go on to be compared. A digest in very
    many documents meets its first occurrence in a join, which adaptive execution splits.
    """
    d = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t")).where("t is not null")
    d = _chunks(d, F.col("t"), ["id", "v"], "c", divisor, min_lines)
    slim = d.select("id", "v", F.explode(F.expr("transform(filter(c, x -> x.m), x -> struct(x.pos AS pos, xxhash64(x.t) AS d, length(x.t) AS n))")).alias("x")).select("id", "v", "x.*")
    first = slim.groupBy("d", "n").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "v", "pos")).alias("first")).where("k > 1").drop("k")
    first = cut(first)  # a join of two exchanges is one that adaptive execution can split; of an aggregate it isn't
    hits = slim.join(first, ["d", "n"]).select("id", "v", F.struct("pos", "d", "n", F.col("first").eqNullSafe(F.struct("id", "v", "pos")).alias("own")).alias("hit"))
    asked = hits.groupBy("id", "v").agg(F.collect_set("hit").alias("hits")).select(F.col("id").alias("id_"), F.col("v").alias("v_"), "hits")
    found = d.join(asked, F.col("id").eqNullSafe(F.col("id_")) & (F.col("v") == F.col("v_"))).select("id", "v", "c", F.explode("hits").alias("x"))
    found = found.select("id", "v", "x.*", F.expr("c[x.pos].t").alias("t"))
    kept = found.where("own").groupBy("d", "n").agg(F.first("t").alias("original"))
    gone = found.where("not own").join(kept, ["d", "n"]).where(F.col("t").cast("binary") == F.col("original").cast("binary"))
    return gone.groupBy("id", "v").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = 3, min_lines: int = 2) -> DataFrame:
    """All input rows and columns, the text without its repeated chunks, plus n_lines and n_removed_lines.

    The first occurrence by (id, position) stays; nulls sort first. Rows equal in id and text are one document, so a
    repeated row removes nothing from its twin. Null texts stay null and have no lines; an empty table stays empty. The
    two added columns replace any of the same name.
    """
    docs = docs.drop("n_lines", "n_removed_lines")
    gone = repeats(docs, id_col, text_col, divisor, min_lines).select(F.col("id").alias("_ld_id"), F.col("v").alias("_ld_v"), F.col("gone").alias("_ld_gone"))
    own = docs.withColumn("_ld_own", F.xxhash64(text_col))
    d = own.join(gone, F.col(id_col).eqNullSafe(F.col("_ld_id")) & (F.col("_ld_own") == F.col("_ld_v")), "left")
    keep = [*docs.columns, "_ld_gone"]
    d = _chunks(d, F.when(F.col("_ld_gone").isNotNull(), F.col(text_col)), keep, "_ld_c", divisor, min_lines)
    d = d.withColumn("_ld_left", F.expr("filter(_ld_c, x -> NOT array_contains(_ld_gone, x.pos))"))
    lost = F.expr("aggregate(_ld_c, 0L, (a, x) -> a + x.n) - aggregate(_ld_left, 0L, (a, x) -> a + x.n)")
    lines = F.length(text_col) - F.length(F.translate(text_col, "\n", "")) + 1
    clean = F.when(F.col("_ld_gone").isNull(), F.col(text_col)).otherwise(F.array_join("_ld_left.t", "\n"))
    d = d.select(
        *[clean.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("n_removed_lines"),
    )
    return settled(d, text_col, "n_lines", "n_removed_lines")


LINES_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, ('0x' || substr(md5(line), 1, {DIGITS}))::BIGINT AS h FROM l),
b AS (SELECT *, (coalesce(lag(h) OVER w, 0) * {FACTOR} + h) % 3 = 0 AS ends FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM b),
c AS (SELECT doc_id, pos, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t,
             count(*) FILTER (WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) >= 2 AS m FROM p GROUP BY doc_id, pos),
r AS (SELECT *, m AND row_number() OVER (PARTITION BY t ORDER BY doc_id, pos) > 1 AS gone FROM c)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0)::BIGINT AS n_removed_lines,
       CASE WHEN any_value(d.text) IS NOT NULL THEN md5(coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) END AS clean_md5
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""
