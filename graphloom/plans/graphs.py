"""Graphs over the shared test tables, as DataFrames and as the SQL that defines the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.vectors import as_double, normalise
from graphloom.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, build, conform
from graphloom.operators.search import topk
from graphloom.session import cut

#: Nearest neighbours of each vector that become edges, and the similarity from which an edge is close.
NEIGHBOURS, CLOSE = 5, 0.35
#: Vectors below this id are the base of a split graph; the rest are its delta.
SPLIT = 400
#: Type tags of star-schema ids, above the key's 24 bits.
TAGS = {"Region": 0, "Nation": 1, "Customer": 2, "Supplier": 3, "Part": 4, "Order": 5}
BITS = 24

_BUILT: dict[tuple[str, str, str], Graph] = {}


def _once(spark: SparkSession, name: str, sf_dir: str, make: Callable[[], Graph]) -> Graph:
    """A graph is stored once for each application, table folder and name. ``make`` stores the edges, on which weights rest."""
    key = (spark.sparkContext.applicationId, name, sf_dir)
    if key not in _BUILT:
        built = make()
        _BUILT[key] = Graph(cut(built.nodes), built.edges)
    return _BUILT[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vector_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The embeddings as nodes, linked to their five most similar ones."""
    return _once(spark, "vectors", sf_dir, lambda: _vector_graph(spark, sf_dir))


def _vector_graph(spark: SparkSession, sf_dir: str) -> Graph:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    kind, name = F.concat(F.lit("label_"), F.col("label")), F.concat(F.lit("vec_"), F.col("id"))
    nodes = e.select(
        "id",
        F.concat_ws(":", kind, name).alias("external_id"),
        name.alias("name"),
        kind.alias("node_type"),
        F.concat(F.lit('{"label": '), F.col("label"), F.lit("}")).alias("props"),
        F.concat(F.lit("vector "), F.col("id"), F.lit(" of label "), F.col("label")).alias("full_context"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("embedded "), name)).alias("embed_context"),
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("https://images.test/"), F.col("id"))).alias("image_url"),
        "embedding",
    )
    near = topk(e, e.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector")), NEIGHBOURS + 1).where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    near = near.withColumn("r", rank).where(F.col("r") <= NEIGHBOURS)
    edge_id = (F.col("query_id") * NEIGHBOURS + F.col("r") - 1).cast("long")
    edges = near.select(
        edge_id.alias("edge_id"),
        F.col("query_id").alias("src"),
        F.col("id").alias("dst"),
        F.when(F.col("sim") >= CLOSE, "close_to").otherwise("similar_to").alias("edge_type"),
        F.col("sim").alias("weight"),
        F.lit("").alias("full_context"),
        edge_id.alias("ord"),
    )
    vec = lambda end, v: e.select(F.col("id").alias(end), F.col("embedding").alias(v))
    edges = edges.join(vec("src", "v1"), "src").join(vec("dst", "v2"), "dst")
    edges = edges.withColumn("embedding", normalise(F.zip_with(as_double("v1"), as_double("v2"), lambda a, b: a + b)).cast("array<float>"))
    return build(nodes, cut(conform(edges, EDGE_SCHEMA)))


def split_graph(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    """(base, delta) of the vector graph: an edge belongs to the base if both ends do."""
    g = vector_graph(spark, sf_dir)
    inside = (F.col("src") < SPLIT) & (F.col("dst") < SPLIT)
    return build(g.nodes.where(F.col("id") < SPLIT), g.edges.where(inside)), Graph(g.nodes.where(F.col("id") >= SPLIT), g.edges.where(~inside))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The star schema as typed nodes and edges; parallel edges where an order has a part more than once."""
    return _once(spark, "star", sf_dir, lambda: _star_graph(spark, sf_dir))


def _star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    tag = lambda kind, c: (F.lit(TAGS[kind] << BITS) + F.col(c)).cast("long")
    node = lambda df, kind, key, name: df.select(tag(kind, key).alias("id"), F.col(name).cast("string").alias("name"), F.lit(kind).alias("node_type"))
    nodes = node(t("region"), "Region", "r_regionkey", "r_name").unionByName(node(t("nation"), "Nation", "n_nationkey", "n_name")).unionByName(node(t("customer"), "Customer", "c_custkey", "c_name"))
    nodes = nodes.unionByName(node(t("supplier"), "Supplier", "s_suppkey", "s_name")).unionByName(node(t("part"), "Part", "p_partkey", "p_name")).unionByName(node(t("orders"), "Order", "o_orderkey", "o_orderkey"))
    nodes = nodes.withColumn("external_id", F.concat_ws(":", "node_type", "name"))
    edge = lambda df, kind, a, ca, b, cb, w: df.select(tag(a, ca).alias("src"), tag(b, cb).alias("dst"), F.lit(kind).alias("edge_type"), w.cast("double").alias("weight"))
    one = F.lit(1.0)
    edges = edge(t("nation"), "in_region", "Nation", "n_nationkey", "Region", "n_regionkey", one)
    for more in (
        edge(t("customer"), "located_in", "Customer", "c_custkey", "Nation", "c_nationkey", one),
        edge(t("supplier"), "located_in", "Supplier", "s_suppkey", "Nation", "s_nationkey", one),
        edge(t("orders"), "placed_by", "Order", "o_orderkey", "Customer", "o_custkey", one),
        edge(t("lineitem"), "contains", "Order", "l_orderkey", "Part", "l_partkey", F.col("l_quantity") / 50),
        edge(t("lineitem"), "supplied_by", "Order", "l_orderkey", "Supplier", "l_suppkey", 1 - F.col("l_discount")),
    ):
        edges = edges.union(more)
    order = F.row_number().over(Window.partitionBy("src").orderBy("edge_type", "dst", "weight")).cast("long")
    edges = cut(conform(edges.withColumn("ord", order), EDGE_SCHEMA))
    return build(conform(nodes, NODE_SCHEMA), edges)


#: SQL of the vector graph, to stand behind WITH.
VECTOR_SQL = f"""
emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings),
pairs AS (SELECT a.id AS src, b.id AS dst, list_dot_product(a.v, b.v) AS weight FROM emb a JOIN emb b ON a.id <> b.id),
knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM pairs QUALIFY r <= {NEIGHBOURS}),
edges AS (SELECT src * {NEIGHBOURS} + r - 1 AS edge_id, src, dst, CASE WHEN weight >= {CLOSE} THEN 'close_to' ELSE 'similar_to' END AS edge_type,
                 weight, src * {NEIGHBOURS} + r - 1 AS ord FROM knn),
deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id),
nodes AS (SELECT e.id, 'label_' || label || ':vec_' || e.id AS external_id, 'vec_' || e.id AS name, 'label_' || label AS node_type,
                 coalesce(d, 0) / (max(coalesce(d, 0)) OVER ())::DOUBLE AS weight, '{{"label": ' || label || '}}' AS props,
                 'vector ' || e.id || ' of label ' || label AS full_context, CASE WHEN e.id % 3 = 0 THEN 'embedded vec_' || e.id END AS embed_context,
                 CASE WHEN e.id % 10 = 0 THEN 'https://images.test/' || e.id END AS image_url, v
          FROM emb e LEFT JOIN deg USING (id))"""

#: SQL of the split graph, after VECTOR_SQL.
SPLIT_SQL = f"""
base_edges AS (SELECT * FROM edges WHERE src < {SPLIT} AND dst < {SPLIT}),
delta_edges AS (SELECT * FROM edges WHERE NOT (src < {SPLIT} AND dst < {SPLIT})),
base_deg AS (SELECT id, count(*) AS d FROM (SELECT src AS id FROM base_edges UNION ALL SELECT dst FROM base_edges) GROUP BY id),
base_nodes AS (SELECT * REPLACE (coalesce(d, 0) / (max(coalesce(d, 0)) OVER ())::DOUBLE AS weight) FROM nodes LEFT JOIN base_deg USING (id) WHERE id < {SPLIT}),
delta_nodes AS (SELECT * FROM nodes WHERE id >= {SPLIT})"""

_T = {k: v << BITS for k, v in TAGS.items()}
#: SQL of the star graph.
STAR_SQL = f"""
star_nodes AS (
  SELECT {_T["Region"]} + r_regionkey::BIGINT AS id, r_name AS name, 'Region' AS node_type FROM region
  UNION ALL SELECT {_T["Nation"]} + n_nationkey, n_name, 'Nation' FROM nation
  UNION ALL SELECT {_T["Customer"]} + c_custkey, c_name, 'Customer' FROM customer
  UNION ALL SELECT {_T["Supplier"]} + s_suppkey, s_name, 'Supplier' FROM supplier
  UNION ALL SELECT {_T["Part"]} + p_partkey, p_name, 'Part' FROM part
  UNION ALL SELECT {_T["Order"]} + o_orderkey, o_orderkey::VARCHAR, 'Order' FROM orders),
star_raw AS (
  SELECT {_T["Nation"]} + n_nationkey::BIGINT AS src, {_T["Region"]} + n_regionkey::BIGINT AS dst, 'in_region' AS edge_type, 1.0::DOUBLE AS weight FROM nation
  UNION ALL SELECT {_T["Customer"]} + c_custkey, {_T["Nation"]} + c_nationkey, 'located_in', 1.0 FROM customer
  UNION ALL SELECT {_T["Supplier"]} + s_suppkey, {_T["Nation"]} + s_nationkey, 'located_in', 1.0 FROM supplier
  UNION ALL SELECT {_T["Order"]} + o_orderkey, {_T["Customer"]} + o_custkey, 'placed_by', 1.0 FROM orders
  UNION ALL SELECT {_T["Order"]} + l_orderkey, {_T["Part"]} + l_partkey, 'contains', l_quantity / 50 FROM lineitem
  UNION ALL SELECT {_T["Order"]} + l_orderkey, {_T["Supplier"]} + l_suppkey, 'supplied_by', 1 - l_discount FROM lineitem),
star_edges AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY edge_type, dst, weight) AS ord FROM star_raw)"""


def bfs_sql(edges: str, seeds: str, depth: int, max_nodes: int, bidirectional: bool = False, prefix: str = "") -> str:
    """Common table expressions up to ``{prefix}bfs``: the traversal unrolled by level."""
    p = prefix
    back = f" UNION ALL SELECT dst, src, 1.0, 1, ord FROM {edges}" if bidirectional else ""
    out = [
        f"{p}adj AS (SELECT src AS a, dst AS b, weight AS w, 0 AS dir, ord FROM {edges}{back})",
        f"{p}vis0 AS (SELECT query_id, node, 0 AS hop, 1.0::DOUBLE AS path_weight, row_number() OVER (PARTITION BY query_id ORDER BY ord, node) - 1 AS seq FROM (SELECT query_id, node, min(ord) AS ord FROM {seeds} GROUP BY query_id, node))",
        f"{p}caps AS (SELECT query_id, greatest({max_nodes}, count(*) + 1) AS cap FROM {p}vis0 GROUP BY query_id)",
    ]
    for n in range(1, depth + 1):
        f = f"{p}vis{n - 1}"
        out += [
            f"{p}c{n} AS (SELECT v.query_id, x.b AS node, v.seq AS parent, x.dir, x.ord, x.w FROM {f} v JOIN {p}adj x ON v.node = x.a WHERE v.hop = {n - 1} QUALIFY row_number() OVER (PARTITION BY v.query_id, x.b ORDER BY v.seq, x.dir, x.ord, x.w) = 1)",
            f"{p}n{n} AS (SELECT c.*, row_number() OVER (PARTITION BY c.query_id ORDER BY parent, dir, ord, w, node) AS rn FROM {p}c{n} c WHERE NOT EXISTS (SELECT 1 FROM {f} v WHERE v.query_id = c.query_id AND v.node = c.node))",
            f"{p}k{n} AS (SELECT n.query_id, n.node, {n} AS hop, n.w AS path_weight, h.have + n.rn - 1 AS seq FROM {p}n{n} n JOIN (SELECT query_id, count(*) AS have FROM {f} GROUP BY query_id) h USING (query_id) JOIN {p}caps USING (query_id) WHERE h.have + n.rn - 1 < cap)",
            f"{p}vis{n} AS (SELECT * FROM {f} UNION ALL SELECT * FROM {p}k{n})",
        ]
    return ",\n".join([*out, f"{p}bfs AS (SELECT * FROM {p}vis{depth})"])


def score_sql(weights: tuple[float, float, float], sub: str = "bfs", seeds: str = "seeds", queries: str | None = "queries") -> str:
    """``scored``: the scores of a traversal."""
    a, b, c = weights
    sim = "coalesce(s.seed_sim, list_dot_product(n.v, q.v))" if queries else "coalesce(s.seed_sim, 0.0)"
    join = f"JOIN {queries} q ON q.query_id = b.query_id" if queries else ""
    return f"""scored0 AS (SELECT b.query_id, b.node, b.hop, b.path_weight, b.seq, {sim} AS vsim, n.weight AS node_weight, s.seed_sim IS NOT NULL AS is_seed
  FROM {sub} b JOIN nodes n ON n.id = b.node {join} LEFT JOIN (SELECT * FROM {seeds} WHERE seed_sim IS NOT NULL) s ON s.query_id = b.query_id AND s.node = b.node),
scored1 AS (SELECT *, CASE WHEN hop = 0 THEN greatest(vsim, 0.0) ELSE path_weight / (hop + 1) END AS proximity FROM scored0),
scored AS (SELECT *, {a} * vsim + {b} * proximity + {c} * node_weight AS score FROM scored1)"""
