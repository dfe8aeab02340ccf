"""The property graph as two DataFrames, and the operators that only need its topology.

nodes: id, external_id, name, node_type, weight, props, full_context, embed_context, image_url, embedding
edges: edge_id, src, dst, edge_type, weight, full_context, embed_context, embedding, ord

``ord`` is the order in which a node's edges were added; it decides every tie that the order of traversal decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.session import cut

NODE_SCHEMA = "id long, external_id string, name string, node_type string, weight double, props string, full_context string, embed_context string, image_url string, embedding array<float>"
EDGE_SCHEMA = "edge_id long, src long, dst long, edge_type string, weight double, full_context string, embed_context string, embedding array<float>, ord long"

#: A traversal deeper than this cuts its lineage after every level.
SHALLOW = 2


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema in its order, nulls for those that are missing."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return df.select(*[(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every node with an edge. Parallel edges count each; a self-loop counts both ways."""
    out = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    both = out.union(edges.select(F.col("dst").alias("id"), F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def node_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, weight): a node's degree over the largest; 0 throughout if there are no edges."""
    degree = degrees(edges).select("id", (F.col("out_degree") + F.col("in_degree")).alias("d"))
    known = nodes.select("id").join(degree, "id", "left").select("id", F.coalesce("d", F.lit(0)).alias("d"))
    most = known.agg(F.max("d").alias("most"))
    return known.join(F.broadcast(most)).select("id", F.when(F.col("most") > 0, F.col("d") / F.col("most")).otherwise(0.0).alias("weight"))


def build(nodes: DataFrame, edges: DataFrame) -> Graph:
    """A graph whose node weights follow from its edges."""
    weights = node_weights(nodes, edges)
    nodes = conform(nodes.drop("weight").join(weights, "id"), NODE_SCHEMA)
    return Graph(nodes, conform(edges, EDGE_SCHEMA))


def neighbours(edges: DataFrame, node_id: int, reverse: bool = False) -> DataFrame:
    """(node, weight, edge_type, full_context, ord) of a node's edges, in order of insertion; none for an unknown node."""
    own, other = ("dst", "src") if reverse else ("src", "dst")
    found = edges.where(F.col(own) == node_id)
    return found.select(F.col(other).alias("node"), "weight", "edge_type", "full_context", "ord").orderBy("ord")


def all_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("src", "ord")


def counts(graph: Graph) -> DataFrame:
    """One row: n_nodes, n_edges."""
    return graph.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(F.broadcast(graph.edges.agg(F.count(F.lit(1)).alias("n_edges"))))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int = 2, max_nodes: int = 500, bidirectional: bool = False) -> DataFrame:
    """Breadth-first expansion of many seed sets at once.

    ``seeds``: query_id, node, ord (the order within the query). Returns (query_id, node, hop, path_weight, seq). A node is
    reached by the first edge in order of its parent's ``seq``, then forward before reverse, then the edge's ``ord``;
    ``path_weight`` is that edge's weight alone, 1 for seeds and for edges taken in reverse. Seeds all stay; a query ends
    with max(max_nodes, seeds + 1) nodes at most. Repeated seeds count once.

    Each level is one join of the frontier with the edges, an aggregation by node, and an anti-join with what was visited.
    """
    forward = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("w"), F.lit(0).alias("dir"), "ord")
    if bidirectional:
        forward = forward.union(edges.select("dst", "src", F.lit(1.0), F.lit(1), "ord"))
    once = seeds.groupBy("query_id", "node").agg(F.min("ord").alias("ord"))
    seq = F.row_number().over(Window.partitionBy("query_id").orderBy("ord", "node")) - 1
    visited = once.select("query_id", "node", F.lit(0).alias("hop"), F.lit(1.0).alias("path_weight"), seq.cast("long").alias("seq"))
    caps = once.groupBy("query_id").agg(F.greatest(F.lit(max_nodes), F.count(F.lit(1)) + 1).alias("cap"))
    frontier = visited
    for hop in range(1, depth + 1):
        have = visited.groupBy("query_id").agg(F.count(F.lit(1)).alias("have")).join(caps, "query_id")
        reached = frontier.select("query_id", F.col("node").alias("a"), F.col("seq").alias("parent")).join(forward, "a")
        first = reached.groupBy("query_id", F.col("b").alias("node")).agg(F.min(F.struct("parent", "dir", "ord", "w")).alias("first"))
        fresh = first.join(visited.select("query_id", "node"), ["query_id", "node"], "left_anti")
        order = F.row_number().over(Window.partitionBy("query_id").orderBy("first", "node"))
        # no query takes more than max_nodes at a level, a limit that the sort by groups knows beforehand
        fresh = fresh.withColumn("rn", order).where(F.col("rn") <= max(max_nodes, 1)).join(have, "query_id").withColumn("seq", F.col("have") + F.col("rn") - 1).where("seq < cap")
        frontier = fresh.select("query_id", "node", F.lit(hop).alias("hop"), F.col("first.w").alias("path_weight"), "seq")
        if depth > SHALLOW:
            frontier = cut(frontier)
        visited = visited.union(frontier)
    return visited


def edges_between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(src, dst, weight, edge_type) of the edges inside a set of ids: the heaviest of parallel ones, the first of equals.

    With a ``query_id`` in ``ids``, one such subgraph a query.
    """
    by = ["query_id"] if "query_id" in ids.columns else []
    one = ids.select(*by, F.col("node").alias("src")).distinct()
    two = ids.select(*by, F.col("node").alias("dst")).distinct()
    inside = edges.join(one, "src").join(two, [*by, "dst"])
    best = inside.groupBy(*by, "src", "dst").agg(F.max_by(F.struct("weight", "edge_type"), F.struct("weight", -F.col("ord"))).alias("e"))
    return best.select(*by, "src", "dst", "e.weight", "e.edge_type")
