"""Node and edge lookups over a base graph and its delta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import lookup
from graphloom.plans.graphs import SPLIT_SQL, VECTOR_SQL, split_graph, vector_graph
from graphloom.plans.registered import query, r6

SHOW = "id, name, node_type, external_id"
BOTH = f"WITH {VECTOR_SQL}, {SPLIT_SQL}"


def _nodes(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "node_type", "external_id")


def _edges(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", "edge_type", r6("weight").alias("weight"), "from_name", "to_name")


@query(f"WITH {VECTOR_SQL} SELECT {SHOW}, props, full_context, embed_context, image_url, round(weight, 6) AS weight FROM nodes WHERE id = 30")
def get_node(spark: SparkSession, d: str) -> DataFrame:
    n = lookup.get_node(vector_graph(spark, d), 30)
    return n.select("id", "name", "node_type", "external_id", "props", "full_context", "embed_context", "image_url", r6("weight").alias("weight"))


@query(f"WITH {VECTOR_SQL} SELECT {SHOW} FROM nodes WHERE name = 'vec_17'")
def by_external_id(spark: SparkSession, d: str) -> DataFrame:
    g = vector_graph(spark, d)
    wanted = g.nodes.where("name = 'vec_17'").first()["external_id"]
    return _nodes(lookup.get_by_external_id(g, wanted))


@query(f"WITH {VECTOR_SQL} SELECT {SHOW} FROM nodes WHERE contains(lower(name), 'vec_1') ORDER BY id LIMIT 50")
def search_name(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(lookup.search_nodes(vector_graph(spark, d), text="VEC_1"))


@query(f"WITH {VECTOR_SQL} SELECT {SHOW} FROM nodes WHERE lower(node_type) = 'label_3' ORDER BY id LIMIT 500")
def search_type(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(lookup.search_nodes(vector_graph(spark, d), node_type="Label_3", limit=10_000))


@query(f"{BOTH} SELECT {SHOW} FROM (SELECT 0 AS layer, * FROM base_nodes WHERE id IN (SELECT src FROM base_edges WHERE edge_type = 'close_to') UNION ALL BY NAME SELECT 1 AS layer, * FROM delta_nodes WHERE id IN (SELECT src FROM delta_edges WHERE edge_type = 'close_to')) ORDER BY layer, id LIMIT 500")
def search_edge_type(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return _nodes(lookup.search_nodes(base, delta, edge_type="CLOSE_TO", limit=500))


def _related(ways: str) -> str:
    one = lambda e, n, layer: f"SELECT {layer} AS layer, min((way, ord)) AS place, n.id, name, node_type, external_id FROM ({ways.format(e=e)}) x JOIN {n} n ON n.id = x.id GROUP BY ALL"
    return f"{BOTH} SELECT {SHOW} FROM ({one('base_edges', 'base_nodes', 0)} UNION ALL {one('delta_edges', 'delta_nodes', 1)}) ORDER BY layer, place, id LIMIT 50"


OUT, IN = "SELECT dst AS id, 0 AS way, ord FROM {e} WHERE src = 11", "SELECT src AS id, 1 AS way, ord FROM {e} WHERE dst = 11"


@query(_related(OUT))
def related_out(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return _nodes(lookup.related_nodes(base, 11, delta))


@query(_related(IN))
def related_in(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return _nodes(lookup.related_nodes(base, 11, delta, "in"))


@query(_related(f"{OUT} UNION ALL {IN}"))
def related_both(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return _nodes(lookup.related_nodes(base, 11, delta, "both"))


def _found(where: str, limit: int = 100) -> str:
    return f"""{BOTH}, every AS (SELECT 0 AS layer, * FROM base_edges UNION ALL SELECT 1, * FROM delta_edges),
    e AS (SELECT * FROM every WHERE {where} ORDER BY layer, src, ord LIMIT {limit})
    SELECT src, dst, edge_type, round(e.weight, 6) AS weight, a.name AS from_name, b.name AS to_name FROM e LEFT JOIN nodes a ON a.id = src LEFT JOIN nodes b ON b.id = dst"""


@query(_found("src = 25"))
def edges_from(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return _edges(lookup.search_edges(base, delta, src=25))


@query(_found("dst = 25"))
def edges_to(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return _edges(lookup.search_edges(base, delta, dst=25))


@query(_found("src = 0 AND dst = 365"))
def edges_from_to(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return _edges(lookup.search_edges(base, delta, src=0, dst=365))


@query(_found("lower(edge_type) = 'close_to'", 1000))
def edges_by_type(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return _edges(lookup.search_edges(base, delta, edge_type="Close_To", limit=5000))


@query(f"{BOTH} SELECT {SHOW} FROM nodes WHERE id = 450")
def lookup_with_delta(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return _nodes(lookup.get_node(base, 450, delta))


@query(f"{BOTH} SELECT (SELECT count(*) FROM base_nodes) AS base_nodes, (SELECT count(*) FROM base_edges) AS base_edges, (SELECT count(*) FROM delta_nodes) AS delta_nodes, (SELECT count(*) FROM delta_edges) AS delta_edges, (SELECT count(*) FROM delta_nodes) + (SELECT count(*) FROM delta_edges) >= 500 AS pending_merge")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return lookup.stats(base, delta)


@query(f"""WITH {VECTOR_SQL}, t AS (SELECT unnest(['close_to', 'similar_to', 'unknown']) AS edge_type)
    SELECT t.edge_type, count(e.src) > 0 AS matches FROM t LEFT JOIN edges e ON e.src = 0 AND e.dst = 365 AND e.edge_type = t.edge_type GROUP BY t.edge_type""")
def edge_type_matches(spark: SparkSession, d: str) -> DataFrame:
    e = vector_graph(spark, d).edges
    kinds = ("close_to", "similar_to", "unknown")
    return spark.createDataFrame([(k, lookup.edge_type_matches(e, 0, 365, k)) for k in kinds], "edge_type string, matches boolean")
