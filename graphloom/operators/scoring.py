"""Relevance scores of a traversed subgraph, and what is kept of it as context."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import cosine


@dataclass(frozen=True)
class Weights:
    """Shares of similarity, proximity and node weight in a score."""

    alpha: float
    beta: float
    gamma: float


#: The named presets. Only the relationship mode follows edges both ways.
PRESETS = {
    "balanced": Weights(0.5, 0.3, 0.2),
    "semantic": Weights(0.7, 0.2, 0.1),
    "relationship": Weights(0.3, 0.6, 0.1),
    "entity": Weights(0.4, 0.2, 0.4),
}


@dataclass(frozen=True)
class QueryOptions:
    k: int = 20
    depth: int = 2
    max_nodes: int = 500
    top_n: int = 50
    min_score: float = 0.3
    bidirectional: bool = False
    weights: Weights = PRESETS["balanced"]

    @staticmethod
    def of_mode(mode: str | None, **given: object) -> QueryOptions:
        """The options of a mode, unknown ones being balanced, with what the caller gives on top."""
        base = QueryOptions(weights=PRESETS.get(mode or "balanced", PRESETS["balanced"]), bidirectional=mode == "relationship")
        return replace(base, **given)


def score(subgraph: DataFrame, nodes: DataFrame, seeds: DataFrame, weights: Weights, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, node, hop, path_weight, seq, vsim, proximity, node_weight, score, is_seed).

    vsim is a node hit's own similarity, else its cosine with the query's vector, else 0. Proximity is max(vsim, 0) for
    seeds and path_weight / (hop + 1) beyond. Nodes that the graph doesn't know are dropped.
    """
    known = nodes.select(F.col("id").alias("node"), F.col("weight").alias("node_weight"), *([F.col("embedding")] if queries is not None else []))
    s = subgraph.join(known, "node")
    hits = seeds.where("seed_sim is not null").select("query_id", "node", "seed_sim")
    s = s.join(hits, ["query_id", "node"], "left")
    own: Column = F.lit(0.0)
    if queries is not None:
        s = s.join(queries.select("query_id", "vector"), "query_id")
        own = cosine("embedding", "vector")
    s = s.withColumn("vsim", F.coalesce("seed_sim", own)).withColumn("is_seed", F.col("seed_sim").isNotNull())
    near = F.when(F.col("hop") == 0, F.greatest("vsim", F.lit(0.0))).otherwise(F.col("path_weight") / (F.col("hop") + 1))
    s = s.withColumn("proximity", near)
    total = weights.alpha * F.col("vsim") + weights.beta * F.col("proximity") + weights.gamma * F.col("node_weight")
    return s.withColumn("score", total).select("query_id", "node", "hop", "path_weight", "seq", "vsim", "proximity", "node_weight", "score", "is_seed")


def context(scored: DataFrame, top_n: int = 50, min_score: float = 0.3) -> DataFrame:
    """The top_n best of each query with at least min_score, if that is over 0; equal scores keep the traversal's order."""
    kept = scored.where(F.col("score") >= min_score) if min_score > 0 else scored
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top_n)


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with from_name and to_name; those with an unknown end are dropped."""
    names = nodes.select("id", "name")
    one, two = names.select(F.col("id").alias("src"), F.col("name").alias("from_name")), names.select(F.col("id").alias("dst"), F.col("name").alias("to_name"))
    return edges.join(one, "src").join(two, "dst")
