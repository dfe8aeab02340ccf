"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import cut

#: A key is hot if it has more than one in so many of all rows; so there are fewer hot keys than this.
HOT = 1000
#: The values of so many keys at most are broadcast, where their number is known.
FEW = 1 << 16


def matched(rows: DataFrame, values: DataFrame, key: str, number: str, total: int, keys: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``values``, which has one row a key and in ``number`` how many rows have it.

    Rows of hot keys get theirs by a broadcast of the hot keys' values, fewer than ``HOT`` rows, and stay where they are; all
    others are shuffled, in one plain join where no key is hot. Both sides should be stored ones, since they are read twice.
    Where ``values`` is known to have ``keys`` rows at most, and these are ``FEW`` at most, it is broadcast and no row is shuffled.
    """
    names = [c for c in values.columns if c not in (key, number)]
    if keys is not None and keys <= FEW:
        return rows.join(F.broadcast(values.drop(number)), key).select(*rows.columns, *names)
    hot = F.col(number) * HOT > total
    few = values.where(hot).select(F.col(key).alias("_hot"), F.struct(*names).alias("_value"))
    if few.isEmpty():
        return rows.join(values.drop(number), key).select(*rows.columns, *names)
    marked = rows.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left")
    kept = [*rows.columns, *names]
    known = marked.where("_hot is not null").select(*rows.columns, *[F.col(f"_value.{c}").alias(c) for c in names])
    return known.union(marked.where("_hot is null").select(*rows.columns).join(values.where(~hot).drop(number), key).select(*kept))


def _pointed(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v, each once."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(nodes: DataFrame) -> tuple[int, int, int, int]:
    """How many edges there are; how many nodes have a larger neighbour, and how many a smaller one; and how many keep the edges
    from being stars: those with several smaller neighbours, or with smaller and larger ones. ``nodes``: larger, smaller (counts)."""
    larger, smaller = F.col("larger"), F.col("smaller")
    kept = F.count_if((smaller > 1) | (smaller > 0) & (larger > 0))
    return tuple(nodes.agg(F.coalesce(F.sum("smaller"), F.lit(0)), F.count_if(larger > 0), F.count_if(smaller > 0), kept).first())


def _each(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """Edges (u, v) of several pairs of columns of each row, in one pass over the rows."""
    pairs = [F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends]
    return rows.select(F.explode(F.array(*pairs)).alias("e")).select("e.u", "e.v")


def stars(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Reduce links to (node, root) pairs, root being the smallest node of the component.

    ``edges``: two columns of one orderable type, in any direction; null ends and self-links are ignored. Roots and
    nodes without links get no row. Every step is an aggregation with map-side combine and a join in which a hot centre's
    neighbours are not brought together. A round shuffles three times where nodes are ``FEW``, and the state it starts from is
    read off its first aggregation. Raises when ``max_rounds`` do not suffice.
    """
    a, b = edges.columns
    now = cut(_pointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()))
    for _ in range(max_rounds):
        found = _each(now, ("u", "v"), ("v", "u")).groupBy("u")
        nodes = cut(found.agg(F.least("u", F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("larger"), F.count_if(F.col("v") < F.col("u")).alias("smaller")))
        total, centres, ends, unsettled = _state(nodes)
        if not unsettled:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        least = nodes.where("larger > 0").select(F.col("u").alias("v"), "m", "larger")
        large = cut(matched(now, least, "v", "larger", total, centres).select("u", F.col("m").alias("v")))  # repeated edges do no harm
        least = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")))
        now = cut(_pointed(_each(matched(large, least, "u", "k", total, ends), ("v", "m"), ("u", "m"))))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
