"""Vector search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import as_double, is_degenerate, norm, normalise
from graphloom.operators import search
from graphloom.plans.graphs import VECTOR_SQL, table, vector_graph
from graphloom.plans.registered import query, r6

EMB = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")


def _queries(v: DataFrame, every: int) -> DataFrame:
    return v.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))


def one_query(v: DataFrame, vec_id: int = 0) -> DataFrame:
    return v.where(F.col("id") == vec_id).select(F.lit(0).cast("long").alias("query_id"), F.col("embedding").alias("vector"))


@query(
    f"""WITH {EMB} SELECT id, round(sqrt(list_dot_product(v, v)), 6) AS norm, sqrt(list_dot_product(v, v)) <= 1e-9 AS degenerate,
    round(3 * v[1] / sqrt(list_sum(list_transform(v, lambda x: 9 * x * x))), 6) AS first_component FROM emb"""
)
def normalise_check(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    tripled = F.transform(as_double("embedding"), lambda x: 3 * x)
    return v.select("id", r6(norm("embedding")).alias("norm"), is_degenerate("embedding").alias("degenerate"), r6(normalise(tripled)[0]).alias("first_component"))


@query(
    f"""WITH {EMB} SELECT a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 6) AS sim, round(1 - list_dot_product(a.v, b.v), 6) AS dist
    FROM emb a JOIN emb b ON a.label = b.label AND a.id < b.id WHERE list_dot_product(a.v, b.v) >= 0.3"""
)
def cosine_pairs_topk(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    pairs = search.similar_pairs(v.where("label is not null"), 0.3, "label")
    return pairs.select(F.col("earlier").alias("a"), F.col("id").alias("b"), r6("sim").alias("sim"), r6(1 - F.col("sim")).alias("dist"))


@query(
    f"""WITH {EMB} SELECT b.id, round(list_dot_product(a.v, b.v), 6) AS sim, row_number() OVER (ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS rank
    FROM emb a, emb b WHERE a.id = 0 QUALIFY rank <= 20"""
)
def topk_single(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return search.topk(v, one_query(v), 20).select("id", r6("sim").alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {EMB} SELECT a.id AS query_id, b.id, round(list_dot_product(a.v, b.v), 6) AS sim,
    row_number() OVER (PARTITION BY a.id ORDER BY list_dot_product(a.v, b.v) DESC, b.id) AS rank FROM emb a, emb b WHERE a.id % 5 = 0 QUALIFY rank <= 10"""
)
def topk_batched(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return search.topk(v, _queries(v, 5), 10).select("query_id", "id", r6("sim").alias("sim"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {VECTOR_SQL} SELECT edge_id, src, dst, edge_type, round(weight, 6) AS weight FROM edges")
def knn_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return vector_graph(spark, d).edges.select("edge_id", "src", "dst", "edge_type", r6("weight").alias("weight"))


#: Edge embeddings: the unit vector between both ends'.
EDGE_SIMS = """
ev AS (SELECT e.src, e.dst, e.edge_id, list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] + b.v[i]) AS s FROM edges e JOIN emb a ON a.id = e.src JOIN emb b ON b.id = e.dst),
es AS (SELECT q.id AS query_id, src, dst, edge_id, list_dot_product(s, q.v) / sqrt(list_dot_product(s, s)) AS sim FROM ev, emb q WHERE q.id IN (0, 50, 100)),
et AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 6) DESC, edge_id) AS rank FROM es QUALIFY rank <= 10)"""


@query(f"WITH {VECTOR_SQL}, {EDGE_SIMS} SELECT query_id, src, dst, round(1 - sim, 5) AS dist FROM et WHERE rank <= 9 AND sim > (SELECT max(sim) FROM et x WHERE x.query_id = et.query_id AND x.rank = 10)")
def edge_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    g = vector_graph(spark, d)
    q = g.nodes.where("id in (0, 50, 100)").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.edge_topk(g.edges, q, 10)
    last = found.where("rank = 10").select("query_id", F.col("dist").alias("last"))
    return found.join(last, "query_id").where("rank <= 9 and dist < last").select("query_id", "src", "dst", F.round("dist", 5).alias("dist"))


@query(
    f"""WITH {VECTOR_SQL}, {EDGE_SIMS},
    nh AS (SELECT q.id AS query_id, b.id AS node, list_dot_product(q.v, b.v) AS sim, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, b.v) DESC, b.id) AS rank
           FROM emb q, emb b WHERE q.id IN (0, 50, 100) QUALIFY rank <= 10),
    every AS (SELECT query_id, node, sim FROM nh UNION ALL SELECT query_id, src, NULL FROM et UNION ALL SELECT query_id, dst, NULL FROM et)
    SELECT query_id, node, round(max(sim), 6) AS seed_sim FROM every GROUP BY query_id, node"""
)
def dual_seed_merge(spark: SparkSession, d: str) -> DataFrame:
    g = vector_graph(spark, d)
    q = g.nodes.where("id in (0, 50, 100)").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    merged = search.merge_seeds(search.topk(g.nodes, q, 10), search.edge_topk(g.edges, q, 10))
    return merged.select("query_id", "node", r6("seed_sim").alias("seed_sim"))


@query()
def lsh_recall(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    q = _queries(v, 50)
    return search.recall(search.lsh_topk(v, q, 10), search.topk(v, q, 10), 10)
