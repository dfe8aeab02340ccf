"""Node and edge lookups over a base graph and, if there is one, a delta on top of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import BadRequest, NotFound
from graphloom.functions.text import contains_ignoring_case, same_ignoring_case
from graphloom.operators.graph import Graph

#: Most rows that a search returns.
MOST_NODES, MOST_EDGES = 500, 1000


def _layers(base: DataFrame, delta: DataFrame | None) -> DataFrame:
    rows = base.withColumn("layer", F.lit(0))
    return rows if delta is None else rows.unionByName(delta.withColumn("layer", F.lit(1)), allowMissingColumns=True)


def get_node(base: Graph, node_id: int, delta: Graph | None = None) -> DataFrame:
    """The node of an id, the base's before the delta's; no row if neither has it."""
    return _layers(base.nodes, delta and delta.nodes).where(F.col("id") == node_id).orderBy("layer").limit(1).drop("layer")


def get_by_external_id(base: Graph, external_id: str) -> DataFrame:
    """The node of an external id; the empty one names no node."""
    return base.nodes.where((F.col("external_id") == external_id) & (F.col("external_id") != ""))


def _named(text: str | None, node_type: str | None) -> Column:
    wanted = F.lit(True)
    if text:
        wanted = wanted & contains_ignoring_case(F.col("name"), text)
    if node_type:
        wanted = wanted & same_ignoring_case(F.col("node_type"), node_type)
    return wanted


def _of_type(edges: DataFrame, edge_type: str | None) -> DataFrame:
    return edges.where(same_ignoring_case(F.col("edge_type"), edge_type)) if edge_type else edges


def search_nodes(base: Graph, delta: Graph | None = None, text: str | None = None, node_type: str | None = None, edge_type: str | None = None, limit: int = 50) -> DataFrame:
    """Nodes whose name contains a text and whose type matches, ignoring case; base first, each by id.

    With ``edge_type``, only nodes from which an edge of that type goes out in their own layer.
    """

    def layer(g: Graph) -> DataFrame:
        rows = g.nodes.where(_named(text, node_type))
        return rows.join(_of_type(g.edges, edge_type).select(F.col("src").alias("id")), "id", "left_semi") if edge_type else rows

    return _layers(layer(base), delta and layer(delta)).orderBy("layer", "id").limit(min(limit, MOST_NODES))


def related_nodes(base: Graph, root: int, delta: Graph | None = None, direction: str = "out", edge_type: str | None = None, text: str | None = None, node_type: str | None = None, limit: int = 50) -> DataFrame:
    """Neighbours of a node in order of insertion, each once: outgoing (also for unknown directions), ``in``, or ``both``.

    For both, incoming ones follow those that are outgoing too. Edges of the delta add only nodes of the delta.
    """
    if base.nodes.where(F.col("id") == root).isEmpty():
        raise NotFound(f"node {root} is not in the base graph")

    def layer(g: Graph) -> DataFrame:
        e = _of_type(g.edges, edge_type)
        out = e.where(F.col("src") == root).select(F.col("dst").alias("id"), F.lit(0).alias("way"), "ord")
        into = e.where(F.col("dst") == root).select(F.col("src").alias("id"), F.lit(1).alias("way"), "ord")
        found = {"in": into, "both": out.union(into)}.get(direction, out)
        first = found.groupBy("id").agg(F.min(F.struct("way", "ord")).alias("at"))
        return g.nodes.where(_named(text, node_type)).join(first, "id")

    return _layers(layer(base), delta and layer(delta)).orderBy("layer", "at", "id").limit(min(limit, MOST_NODES))


def edge_type_matches(edges: DataFrame, src: int, dst: int, edge_type: str | None) -> bool:
    """Whether an edge of the type goes from src to dst; true without a type."""
    return edge_type is None or not _of_type(edges, edge_type).where((F.col("src") == src) & (F.col("dst") == dst)).isEmpty()


def search_edges(base: Graph, delta: Graph | None = None, src: int | None = None, dst: int | None = None, edge_type: str | None = None, limit: int = 100) -> DataFrame:
    """Edges that meet all given filters, with the names of their ends; base first, each by (src, ord).

    At least one filter is needed. If only one end is given, the base or the delta must have it.
    """
    if src is None and dst is None and not edge_type:
        raise BadRequest("give at least one of src, dst and edge_type")
    if (src is None) != (dst is None):
        one = src if src is not None else dst
        if get_node(base, one, delta).isEmpty():
            raise NotFound(f"no node {one}")
    found = _of_type(_layers(base.edges, delta and delta.edges), edge_type)
    for c, value in (("src", src), ("dst", dst)):
        if value is not None:
            found = found.where(F.col(c) == value)
    names = _layers(base.nodes, delta and delta.nodes).select("id", "name", "layer").groupBy("id").agg(F.min_by("name", "layer").alias("name"))
    found = found.orderBy("layer", "src", "ord").limit(min(limit, MOST_EDGES))
    found = found.join(names.select(F.col("id").alias("src"), F.col("name").alias("from_name")), "src", "left")
    return found.join(names.select(F.col("id").alias("dst"), F.col("name").alias("to_name")), "dst", "left").orderBy("layer", "src", "ord")


def stats(base: Graph, delta: Graph | None = None, merge_threshold: int = 500) -> DataFrame:
    """One row: nodes and edges of both layers, and whether the delta is due to be merged."""
    number = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)) if df is not None else base.nodes.limit(0).agg(F.count(F.lit(1)).alias(name))
    row = number(base.nodes, "base_nodes").join(number(base.edges, "base_edges"))
    row = row.join(number(delta and delta.nodes, "delta_nodes")).join(number(delta and delta.edges, "delta_edges"))
    return row.withColumn("pending_merge", F.col("delta_nodes") + F.col("delta_edges") >= merge_threshold)
