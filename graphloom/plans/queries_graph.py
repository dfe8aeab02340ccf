"""Traversal and scoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import graph as g
from graphloom.operators import scoring, search
from graphloom.operators.engine import PROFILES, Engine, respond
from graphloom.operators.scoring import PRESETS, QueryOptions
from graphloom.plans.graphs import STAR_SQL, VECTOR_SQL, bfs_sql, score_sql, star_graph, table, vector_graph
from graphloom.plans.queries_vector import one_query
from graphloom.plans.registered import query, r6

SEEDS3 = "seeds AS (SELECT 0 AS query_id, unnest([3, 120, 77]) AS node, unnest([0, 1, 2]) AS ord)"
TRAVERSED = "SELECT query_id, node, hop, round(path_weight, 6) AS path_weight, seq FROM bfs"


def _seeds(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "query_id long, node long, ord long")


def _three(spark: SparkSession) -> DataFrame:
    return _seeds(spark, [(0, 3, 0), (0, 120, 1), (0, 77, 2)])


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "node", "hop", r6("path_weight").alias("path_weight"), "seq")


@query(f"""WITH {STAR_SQL}, d AS (SELECT id, count(*) FILTER (WHERE o) AS out_degree, count(*) FILTER (WHERE NOT o) AS in_degree FROM
    (SELECT src AS id, true AS o FROM star_edges UNION ALL SELECT dst, false FROM star_edges) GROUP BY id)
    SELECT n.id, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) AS in_degree,
           round((coalesce(out_degree, 0) + coalesce(in_degree, 0)) / max(coalesce(out_degree, 0) + coalesce(in_degree, 0)) OVER (), 6) AS weight
    FROM star_nodes n LEFT JOIN d USING (id)""")
def degree_weights(spark: SparkSession, d: str) -> DataFrame:
    s = star_graph(spark, d)
    degree = g.degrees(s.edges)
    rows = s.nodes.select("id", "weight").join(degree, "id", "left")
    return rows.select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"), r6("weight").alias("weight"))


@query(f"WITH {VECTOR_SQL} SELECT dst AS node, round(weight, 6) AS weight, edge_type, ord FROM edges WHERE src = 7")
def neighbors_out(spark: SparkSession, d: str) -> DataFrame:
    return g.neighbours(vector_graph(spark, d).edges, 7).select("node", r6("weight").alias("weight"), "edge_type", "ord")


@query(f"WITH {VECTOR_SQL} SELECT src AS node, round(weight, 6) AS weight, edge_type, ord FROM edges WHERE dst = 7")
def neighbors_in(spark: SparkSession, d: str) -> DataFrame:
    return g.neighbours(vector_graph(spark, d).edges, 7, reverse=True).select("node", r6("weight").alias("weight"), "edge_type", "ord")


@query(f"WITH {STAR_SQL} SELECT edge_type, count(*) AS n, count(DISTINCT src) AS sources, round(sum(weight), 4) AS weight FROM star_edges GROUP BY edge_type")
def neighbor_types(spark: SparkSession, d: str) -> DataFrame:
    e = star_graph(spark, d).edges
    return e.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"), F.round(F.sum("weight"), 4).alias("weight"))


def _bfs(depth: int, cap: int, both: bool = False) -> str:
    return f"WITH {VECTOR_SQL}, {SEEDS3}, {bfs_sql('edges', 'seeds', depth, cap, both)} {TRAVERSED}"


@query(_bfs(1, 500))
def bfs_d1(spark: SparkSession, d: str) -> DataFrame:
    return _shown(g.bfs(vector_graph(spark, d).edges, _three(spark), 1))


@query(_bfs(2, 500))
def bfs_d2(spark: SparkSession, d: str) -> DataFrame:
    return _shown(g.bfs(vector_graph(spark, d).edges, _three(spark), 2))


@query(_bfs(3, 500))
def bfs_d3(spark: SparkSession, d: str) -> DataFrame:
    return _shown(g.bfs(vector_graph(spark, d).edges, _three(spark), 3))


@query(_bfs(2, 500, True))
def bfs_d2_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return _shown(g.bfs(vector_graph(spark, d).edges, _three(spark), 2, bidirectional=True))


@query(_bfs(2, 25, True))
def bfs_capped(spark: SparkSession, d: str) -> DataFrame:
    return _shown(g.bfs(vector_graph(spark, d).edges, _three(spark), 2, 25, True))


@query(f"WITH {VECTOR_SQL}, seeds AS (SELECT 0 AS query_id, id AS node, id AS ord FROM emb WHERE id % 40 = 0), {bfs_sql('edges', 'seeds', 2, 10)} {TRAVERSED}")
def bfs_multi_seed(spark: SparkSession, d: str) -> DataFrame:
    v = vector_graph(spark, d)
    seeds = v.nodes.where("id % 40 = 0").select(F.lit(0).cast("long").alias("query_id"), F.col("id").alias("node"), F.col("id").alias("ord"))
    return _shown(g.bfs(v.edges, seeds, 2, 10))


@query(f"WITH {VECTOR_SQL}, seeds AS (SELECT id // 60 AS query_id, id AS node, id AS ord FROM emb WHERE id % 20 = 0), {bfs_sql('edges', 'seeds', 2, 60)} {TRAVERSED}")
def bfs_batched(spark: SparkSession, d: str) -> DataFrame:
    v = vector_graph(spark, d)
    seeds = v.nodes.where("id % 20 = 0").select(F.floor(F.col("id") / 60).alias("query_id"), F.col("id").alias("node"), F.col("id").alias("ord"))
    return _shown(g.bfs(v.edges, seeds, 2, 60))


@query(f"WITH {STAR_SQL}, seeds AS (SELECT o_custkey % 8 AS query_id, {5 << 24} + o_orderkey AS node, o_orderkey AS ord FROM orders WHERE o_orderkey < 40), {bfs_sql('star_edges', 'seeds', 2, 500)} {TRAVERSED}")
def bfs_star_schema(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "orders").where("o_orderkey < 40").select((F.col("o_custkey") % 8).alias("query_id"), (F.col("o_orderkey") + (5 << 24)).alias("node"), F.col("o_orderkey").alias("ord"))
    return _shown(g.bfs(star_graph(spark, d).edges, seeds, 2))


@query(f"""WITH {STAR_SQL}, ids AS (SELECT id FROM star_nodes WHERE node_type IN ('Part', 'Supplier') OR (node_type = 'Order' AND id % 3 = 0))
    SELECT src, dst, round(weight, 6) AS weight, edge_type FROM star_edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)
    QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY weight DESC, ord) = 1""")
def induced_edges_best(spark: SparkSession, d: str) -> DataFrame:
    s = star_graph(spark, d)
    ids = s.nodes.where("node_type in ('Part', 'Supplier') or (node_type = 'Order' and id % 3 = 0)").select(F.col("id").alias("node"))
    return g.edges_between(s.edges, ids).select("src", "dst", r6("weight").alias("weight"), "edge_type")


@query(f"WITH {STAR_SQL} SELECT (SELECT count(*) FROM star_nodes) AS n_nodes, (SELECT count(*) FROM star_edges) AS n_edges")
def graph_counts(spark: SparkSession, d: str) -> DataFrame:
    return g.counts(star_graph(spark, d))


@query(f"WITH {VECTOR_SQL} SELECT src, ord, dst FROM edges")
def all_edges_ordered(spark: SparkSession, d: str) -> DataFrame:
    return g.all_edges(vector_graph(spark, d).edges).select("src", "ord", "dst")


# ---- scores: one query, the vector of node 0, node hits only -----------------------------------------------------------

HITS = """queries AS (SELECT 0 AS query_id, v FROM emb WHERE id = 0),
seeds AS (SELECT 0 AS query_id, b.id AS node, list_dot_product(q.v, b.v) AS seed_sim, row_number() OVER (ORDER BY list_dot_product(q.v, b.v) DESC, b.id) - 1 AS ord
          FROM queries q, emb b QUALIFY ord < 20)"""
SCORED = "SELECT node, hop, round(vsim, 6) AS vsim, round(proximity, 6) AS proximity, round(node_weight, 6) AS node_weight, round(score, 6) AS score, is_seed FROM scored"


def _score_sql(mode: str) -> str:
    w = PRESETS[mode]
    return f"WITH {VECTOR_SQL}, {HITS}, {bfs_sql('edges', 'seeds', 2, 500, mode == 'relationship')}, {score_sql((w.alpha, w.beta, w.gamma))}"


def _scored(spark: SparkSession, d: str, mode: str) -> DataFrame:
    v, options = vector_graph(spark, d), QueryOptions.of_mode(mode)
    q = one_query(v.nodes)
    seeds = search.merge_seeds(search.topk(v.nodes, q, 20))
    sub = g.bfs(v.edges, seeds, options.depth, options.max_nodes, options.bidirectional)
    return scoring.score(sub, v.nodes, seeds, options.weights, q)


def _score_query(mode: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _scored(spark, d, mode).select("node", "hop", r6("vsim").alias("vsim"), r6("proximity").alias("proximity"), r6("node_weight").alias("node_weight"), r6("score").alias("score"), "is_seed")

    run.__name__ = f"score_{mode}"
    return query(f"{_score_sql(mode)} {SCORED}")(run)


score_balanced, score_semantic, score_relationship, score_entity = map(_score_query, ("balanced", "semantic", "relationship", "entity"))

TOP = "top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seq) AS rank FROM scored WHERE score >= 0.3 QUALIFY rank <= 50)"
INDUCED = """between AS (SELECT e.* FROM edges e WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)
  QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY e.weight DESC, ord) = 1)"""


@query(f"{_score_sql('balanced')}, {TOP} SELECT node, rank, round(score, 6) AS score FROM top")
def context_topn(spark: SparkSession, d: str) -> DataFrame:
    top = scoring.context(_scored(spark, d, "balanced"), 50, 0.3)
    return top.select("node", F.col("rank").cast("long").alias("rank"), r6("score").alias("score"))


@query(f"""WITH {VECTOR_SQL}, seeds AS (SELECT 0 AS query_id, 42 AS node, 0 AS ord, 1.0 AS seed_sim), {bfs_sql('edges', 'seeds', 2, 500)},
    {score_sql((0.5, 0.3, 0.2), queries=None)} SELECT node, hop, round(score, 6) AS score, is_seed FROM scored QUALIFY row_number() OVER (ORDER BY score DESC, seq) <= 50""")
def node_query(spark: SparkSession, d: str) -> DataFrame:
    found = Engine(vector_graph(spark, d)).query_node(42)
    return found.nodes.select("node", "hop", r6("score").alias("score"), "is_seed")


#: The engine's own seeds: node hits, then the ends of edge hits.
FULL = f"""{VECTOR_SQL}, queries AS (SELECT 0 AS query_id, v FROM emb WHERE id = 0),
ev AS (SELECT e.src, e.dst, e.edge_id, list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] + b.v[i]) AS s FROM edges e JOIN emb a ON a.id = e.src JOIN emb b ON b.id = e.dst),
eh AS (SELECT src, dst, row_number() OVER (ORDER BY (list_dot_product(list_transform(s, lambda x: (x / sqrt(list_dot_product(s, s)))::FLOAT)::DOUBLE[], q.v)) DESC, edge_id) AS rank FROM ev, queries q QUALIFY rank <= 20),
nh AS (SELECT b.id AS node, list_dot_product(q.v, b.v) AS sim, row_number() OVER (ORDER BY list_dot_product(q.v, b.v) DESC, b.id) AS rank FROM queries q, emb b QUALIFY rank <= 20),
every AS (SELECT node, 0 AS part, rank, 0 AS n, sim FROM nh UNION ALL SELECT src, 1, rank, 0, NULL FROM eh UNION ALL SELECT dst, 1, rank, 1, NULL FROM eh),
seeds AS (SELECT 0 AS query_id, node, row_number() OVER (ORDER BY min((part, rank, n))) - 1 AS ord, max(sim) AS seed_sim FROM every GROUP BY node),
{bfs_sql('edges', 'seeds', 2, 500)}, {score_sql((0.5, 0.3, 0.2))}, {TOP}, {INDUCED}"""


def _full(spark: SparkSession, d: str):  # noqa: ANN202
    v = vector_graph(spark, d)
    return Engine(v).query_vectors(one_query(v.nodes))


@query(f"WITH {FULL} SELECT node, rank, hop, round(score, 6) AS score, is_seed FROM top")
def vector_query_full(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d).nodes.select("node", F.col("rank").cast("long").alias("rank"), "hop", r6("score").alias("score"), "is_seed")


@query(f"WITH {FULL} SELECT a.name AS from_name, b.name AS to_name, round(e.weight, 6) AS weight, edge_type FROM between e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst")
def subgraph_edges_named(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d).edges.select("from_name", "to_name", r6("weight").alias("weight"), "edge_type")


@query(f"WITH {FULL} SELECT (SELECT count(*) FROM seeds) AS seed_nodes, (SELECT count(*) FROM bfs) AS subgraph_nodes, (SELECT count(*) FROM top) AS context_nodes")
def query_stats(spark: SparkSession, d: str) -> DataFrame:
    return _full(spark, d).stats.select("seed_nodes", "subgraph_nodes", "context_nodes")


def _profile_sql(name: str, nodes: str, edges: str) -> str:
    return f"SELECT '{name}' AS profile, '{','.join(sorted(PROFILES[name]))}' AS fields, {nodes} AS n_nodes, {edges} AS n_edges"


@query(f"WITH {FULL} " + " UNION ALL ".join((_profile_sql("minimal", "0", "0"), _profile_sql("standard", "(SELECT count(*) FROM top)", "0"), _profile_sql("full", "(SELECT count(*) FROM top)", "(SELECT count(*) FROM between)"))))
def response_profiles(spark: SparkSession, d: str) -> DataFrame:
    """What each profile's answer to one query holds: its fields, and how many nodes and edges."""
    found = _full(spark, d)
    got = {p: respond(found, p) for p in PROFILES}
    rows = [(p, ",".join(sorted(r)), len(r.get("nodes", [])), len(r.get("edges", []))) for p, r in got.items()]
    return spark.createDataFrame(rows, "profile string, fields string, n_nodes long, n_edges long")
