"""Mix sources to target weights by hash-threshold histograms.

A source's target is some whole copies of all its documents and a rest. The rest takes the documents whose hash lies under
a threshold, found level by level: sizes are summed by source and hash bucket, the bucket in which the budget runs out is
the only one that the next, finer level looks at. No document is sorted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut, cut_few

WORD = "[^\\x20\\x09-\\x0D]+"
#: Bits that each level adds to the hash's known prefix, and levels: the hash has their product.
BITS, LEVELS = 10, 4
#: Up to this many sources, per-source rows are broadcast; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def _hash(id_col: str, text_col: str) -> Column:
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(text_col, F.lit("")))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS * LEVELS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, h): words of the text (null: 0) and 40 bits of the id's MD5 (the text's if the id is null)."""
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _hash(id_col, text_col).alias("h"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of every source.

    Sources in order of code points, null last, take the weights in turn. They share ``share`` of all sizes by weight, and
    no target exceeds ``most`` times its source's size: with level L the target is min(most * size, L * weight), and L
    follows from the sources in the order in which they reach their bound. The windows run over one row a source.
    """
    total = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight: Column = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    every, full = Window.partitionBy(), Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    return (
        total.withColumn("weight", weight)
        .withColumn("cap", most * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("budget", share * F.sum("source_size").over(every))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), none)) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none)))
        .withColumn("final", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "source", "level"))).over(every)["level"])
        .withColumn("target", F.coalesce(F.least("cap", F.col("final") * F.col("weight")), F.col("cap")))
        .select("source", "source_size", "target")
    )


def thresholds(rows: DataFrame, plan: DataFrame, small: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """(source, source_size, target, copies, below) of every source: a document counts ``copies`` times, and once more if
    its hash is under ``below``. ``keep`` cuts the table of sources."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = plan.withColumn("copies", copies.cast("long")).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    state = keep(state.withColumn("prefix", F.lit(0).cast("long")).withColumn("done", F.lit(None).cast("long")))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        open_ = state.where("done is null").select(F.col("source").alias("s"), "prefix")
        inside = rows.withColumn("up", F.shiftright("h", shift + BITS))
        if level:
            inside = inside.join(small(open_), (F.col("source").eqNullSafe(F.col("s"))) & (F.col("up") == F.col("prefix")), "left_semi")
        summed = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket")
        running = summed.withColumn("upto", F.sum("n").over(upto)).select(F.col("source").alias("s"), "bucket", "n", "upto")
        over = (
            running.join(small(state.where("done is null").select("source", "left")), F.col("source").eqNullSafe(F.col("s")))
            .where(F.col("upto") > F.col("left"))
            .groupBy("s")
            .agg(F.min(F.struct("bucket", (F.col("left") - (F.col("upto") - F.col("n"))).alias("left"))).alias("cut"))
        )
        state = keep(
            state.join(over, F.col("source").eqNullSafe(F.col("s")), "left").select(
                "source",
                "source_size",
                "target",
                "copies",
                F.coalesce("cut.left", "left").alias("left"),
                F.coalesce("cut.bucket", "prefix").alias("prefix"),
                # nothing runs over: all that the prefix has is taken
                F.when(F.col("done").isNull() & F.col("cut").isNull(), F.shiftleft(F.col("prefix") + 1, shift + BITS)).otherwise(F.col("done")).alias("done"),
            )
        )
    return state.select("source", "source_size", "target", "copies", F.coalesce("done", "prefix").alias("below"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per input row: (id, size, source_size, target, copies, taken).

    ``copies`` is how often the mix has the document, ``taken`` its words over all copies. Each source comes within the
    size of the documents that share one 40-bit hash of its target. Equal ids get equal decisions, so repeated rows stay
    together and reruns agree. Null sources are one source, null texts have size 0; an empty table gives an empty result.
    """
    rows = cut(sized(docs, id_col, text_col, source_col))
    plan = cut(targets(rows, weights, share, most))
    few = plan.count() <= BROADCAST_SOURCES
    small = F.broadcast if few else (lambda df: df)
    chosen = thresholds(rows, plan, small).withColumnRenamed("source", "s")
    copies = F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return rows.join(small(chosen), F.col("source").eqNullSafe(F.col("s"))).select("id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The input's rows and columns, each row as often as the mix has it."""
    rows = cut(sized(docs, id_col, text_col, source_col))
    plan = cut(targets(rows, weights, share, most))
    sources = plan.count()
    small = F.broadcast if sources <= BROADCAST_SOURCES else (lambda df: df)
    chosen = thresholds(rows, plan, small, lambda df: cut_few(df, sources)).select(F.col("source").alias("_mx_source"), F.col("copies").alias("_mx_copies"), F.col("below").alias("_mx_below"))
    d = docs.withColumn("_mx_h", _hash(id_col, text_col)).join(small(chosen), F.col(source_col).eqNullSafe(F.col("_mx_source")))
    times = F.col("_mx_copies") + F.when(F.col("_mx_h") < F.col("_mx_below"), 1).otherwise(0)
    return d.withColumn("_mx_one", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 10))::BIGINT AS h
  FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM t),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS full_at FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM c WINDOW b AS (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, full_at) AS final FROM l WHERE level <= full_at),
g AS (SELECT source, source_size, coalesce(least(cap, final * weight), cap) AS target FROM l, f),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM g),
h AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, k.source_size, k.target,
       (k.copies * d.size + CASE WHEN h.upto <= k.target - k.copies * k.source_size THEN d.size ELSE 0 END)::BIGINT AS taken
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.h = h.h
"""
