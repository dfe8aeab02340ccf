"""Payloads, resolution and id allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.vectors import normalise
from graphloom.operators import ingest
from graphloom.operators.ingest import Resolution
from graphloom.plans.graphs import SPLIT_SQL, VECTOR_SQL, split_graph, table, vector_graph
from graphloom.plans.registered import query, r6
from graphloom.sources import payload

#: A payload a region: its nations as entities with some blanks, and relations from each to the next nation and to a ghost.
NATIONS = """n AS (SELECT n_regionkey AS payload_id, n_nationkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos,
                  lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS next FROM nation)"""


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    blank = F.when(F.col("n_nationkey") % 4 == 0, "  ").otherwise(" Nation ")
    entity = F.struct(
        F.concat(F.lit("n"), "n_nationkey").alias("id"),
        F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("name"),
        blank.alias("type"),
        F.when(F.col("n_nationkey") % 3 == 0, F.struct(F.col("n_nationkey").alias("key"))).alias("props"),
        F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("about "), "n_name")).alias("full_context"),
        F.when(F.col("n_nationkey") % 5 == 0, F.concat(F.lit("embed "), "n_name")).otherwise(" ").alias("embed_context"),
        F.when(F.col("n_nationkey") % 6 == 0, F.concat(F.lit("img/"), "n_nationkey")).otherwise("").alias("image_url"),
    )
    nxt = F.lead("n_nationkey").over(ingest.Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    rel = F.array(
        F.struct(F.concat(F.lit("n"), "n_nationkey").alias("from"), F.concat(F.lit("n"), "next").alias("to"), F.lit("borders").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, 0.5).alias("weight")),
        F.struct(F.concat(F.lit("n"), "n_nationkey").alias("from"), F.lit("GHOST").alias("to"), F.lit("haunts").alias("type"), F.lit(1.0).alias("weight")),
    )
    rows = n.withColumn("next", nxt).select(F.col("n_regionkey").alias("payload_id"), "n_nationkey", entity.alias("e"), rel.alias("r"))
    each = rows.groupBy("payload_id").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "e", "r"))).alias("x"))
    doc = F.struct(F.transform("x", lambda x: x["e"]).alias("entities"), F.flatten(F.transform("x", lambda x: x["r"])).alias("relations"))
    return each.select("payload_id", F.to_json(doc).alias("payload"))


NODE_SQL = f"""{NATIONS}, p AS (SELECT payload_id, pos, 'n' || k AS payload_key, n_name AS name, CASE WHEN k % 4 = 0 THEN 'Entity' ELSE 'Nation' END AS node_type, 'n' || k AS external_id,
    CASE WHEN k % 3 = 0 THEN '{{"key":' || k || '}}' END AS props, CASE WHEN k % 2 = 0 THEN 'about ' || n_name ELSE '' END AS full_context,
    CASE WHEN k % 5 = 0 THEN 'embed ' || n_name END AS embed_context, CASE WHEN k % 6 = 0 THEN 'img/' || k END AS image_url, k, next FROM n)"""


@query(f"WITH {NODE_SQL} SELECT payload_id, pos::INT AS pos, payload_key, name, node_type, external_id, props, full_context, embed_context, image_url FROM p")
def payload_nodes(spark: SparkSession, d: str) -> DataFrame:
    return payload.parse(_payloads(spark, d))[0]


@query(f"WITH {NODE_SQL} SELECT a.payload_id, a.pos AS from_pos, b.pos AS to_pos, 'borders' AS edge_type, CASE WHEN a.k % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight, '' AS full_context FROM p a JOIN p b ON b.k = a.next AND a.payload_id = b.payload_id")
def payload_edges(spark: SparkSession, d: str) -> DataFrame:
    return payload.parse(_payloads(spark, d))[1].select("payload_id", "from_pos", "to_pos", "edge_type", "weight", "full_context")


@query("SELECT n_regionkey AS payload_id, count(*) * 2 AS relations, count(*) - 1 AS kept FROM nation GROUP BY 1")
def dangling_dropped(spark: SparkSession, d: str) -> DataFrame:
    p = _payloads(spark, d)
    kept = payload.parse(p)[1].groupBy("payload_id").agg(F.count(F.lit(1)).alias("kept"))
    given = p.select("payload_id", F.size(F.from_json("payload", payload.SCHEMA)["relations"]).cast("long").alias("relations"))
    return given.join(kept, "payload_id")


@query(f"WITH {NODE_SQL} SELECT payload_id, pos::INT AS pos, coalesce(embed_context, nullif(full_context, ''), name) AS embed_text, image_url IS NOT NULL AS by_image FROM p")
def embed_text_choice(spark: SparkSession, d: str) -> DataFrame:
    n = payload.parse(_payloads(spark, d))[0]
    text, image = payload.split_images(n)
    pick = lambda df, by: df.select("payload_id", "pos", payload.node_embed_text(df).alias("embed_text"), F.lit(by).alias("by_image"))
    return pick(text, False).union(pick(image, True))


@query(f"WITH {VECTOR_SQL} SELECT edge_id, coalesce(nullif(trim(edge_type), ''), 'x') AS embed_text FROM edges")
def edge_embed_text(spark: SparkSession, d: str) -> DataFrame:
    e = vector_graph(spark, d).edges
    return e.select("edge_id", payload.edge_embed_text(e).alias("embed_text"))


@query("SELECT c_custkey, c_custkey + (3 << 24) AS id FROM customer")
def id_allocation(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey")
    return ingest.allocate_ids(rows, 3, 1000, ["c_custkey"]).select("c_custkey", "id")


#: New entities: perturbed copies of all vectors at two distances, with the vector's type or another one.
PERTURBED = """pert AS (SELECT a.id AS pos, a.label, CASE WHEN a.id % 4 = 0 THEN 'label_x' ELSE 'label_' || a.label END AS type,
   list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] + (CASE WHEN a.id % 2 = 0 THEN 0.1 ELSE 0.6 END) * b.v[i]) AS w FROM emb a JOIN emb b ON b.id = (a.id + 1) % (SELECT max(id) + 1 FROM emb)),
unit AS (SELECT pos, type, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS w FROM pert)"""


def _perturbed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    last = e.agg(F.max("id").alias("last"))  # one row
    other = e.join(F.broadcast(last)).select(F.pmod(F.col("id") - 1, F.col("last") + 1).alias("id"), F.col("v").alias("o"))
    a = e.join(other, "id")
    eps = F.when(F.col("id") % 2 == 0, 0.1).otherwise(0.6)
    kind = F.when(F.col("id") % 4 == 0, "label_x").otherwise(F.concat(F.lit("label_"), "label"))
    return a.select(F.col("id").alias("pos"), kind.alias("type"), normalise(F.zip_with("v", "o", lambda x, y: x + eps * y)).alias("embedding"))


def _resolve_sql(nodes: str, threshold: float, typed: bool, five: bool = True) -> str:
    top = "QUALIFY row_number() OVER (PARTITION BY pos ORDER BY list_dot_product(w, v) DESC, id) <= 5" if five else ""
    match = "AND node_type = type" if typed else ""
    return f"""SELECT pos, arg_min(id, (-sim, id)) AS id, max(sim) AS sim FROM
      (SELECT pos, type, id, node_type, list_dot_product(w, v) AS sim FROM unit, {nodes} {top}) WHERE sim >= {threshold} {match} GROUP BY pos"""


def _resolved(df: DataFrame) -> DataFrame:
    return df.select("pos", "resolved_id", r6("sim").alias("sim"), "layer")


@query(f"WITH {VECTOR_SQL}, {PERTURBED}, r AS ({_resolve_sql('nodes', 0.92, False)}) SELECT pos, r.id AS resolved_id, round(sim, 6) AS sim, CASE WHEN r.id IS NOT NULL THEN 'base' END AS layer FROM unit LEFT JOIN r USING (pos)")
def resolve_base(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(ingest.resolve(_perturbed(spark, d), vector_graph(spark, d).nodes))


@query(f"WITH {VECTOR_SQL}, {PERTURBED}, r AS ({_resolve_sql('nodes', 0.8, True)}) SELECT pos, r.id AS resolved_id, round(sim, 6) AS sim, CASE WHEN r.id IS NOT NULL THEN 'base' END AS layer FROM unit LEFT JOIN r USING (pos)")
def resolve_type_match(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(ingest.resolve(_perturbed(spark, d), vector_graph(spark, d).nodes, cfg=Resolution(threshold=0.8, match_type=True)))


@query(f"""WITH {VECTOR_SQL}, {SPLIT_SQL}, {PERTURBED}, b AS ({_resolve_sql('base_nodes', 0.8, False)}), e AS ({_resolve_sql('delta_nodes', 0.8, False, False)})
    SELECT pos, coalesce(b.id, e.id) AS resolved_id, round(CASE WHEN b.id IS NOT NULL THEN b.sim ELSE e.sim END, 6) AS sim, CASE WHEN b.id IS NOT NULL THEN 'base' WHEN e.id IS NOT NULL THEN 'delta' END AS layer
    FROM unit LEFT JOIN b USING (pos) LEFT JOIN e USING (pos)""")
def resolve_delta(spark: SparkSession, d: str) -> DataFrame:
    base, delta = split_graph(spark, d)
    return _resolved(ingest.resolve(_perturbed(spark, d), base.nodes, delta.nodes, Resolution(threshold=0.8)))


#: Leaders of a batch, folded over positions: those without an earlier similar leader.
LEADERS = """sim AS (SELECT a.id AS pos, b.id AS earlier FROM emb a JOIN emb b ON b.id < a.id WHERE list_dot_product(a.v, b.v) >= 0.3),
nb AS (SELECT pos, list_sort(list(earlier)) AS nb FROM sim GROUP BY pos),
f AS (SELECT list_reduce(list_prepend([]::BIGINT[], list([pos] || nb ORDER BY pos)), lambda acc, x: CASE WHEN len(list_filter(x[2:], lambda y: NOT list_contains(acc, y))) > 0 THEN acc || [x[1]] ELSE acc END) AS followers FROM nb),
led AS (SELECT pos, list_min(list_filter(nb, lambda y: NOT list_contains(followers, y))) AS leader FROM nb, f)"""


@query(f"WITH emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), {LEADERS} SELECT id AS pos, coalesce(leader, id) AS leader_pos FROM emb LEFT JOIN led ON pos = id")
def resolve_in_batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), F.lit("x").alias("type"), "embedding")
    return ingest.resolve_in_batch(e, Resolution(threshold=0.3))


@query(f"""WITH {VECTOR_SQL}, {PERTURBED}, r AS ({_resolve_sql('nodes', 0.92, False)}) SELECT (SELECT count(*) FROM unit) AS entities, (SELECT count(*) FROM unit) - (SELECT count(*) FROM r) AS new_nodes,
    (SELECT count(*) FROM r) AS resolved, (SELECT count(*) - 1 FROM unit) AS relations""")
def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    n = _perturbed(spark, d).withColumnRenamed("type", "node_type")
    w = ingest.Window.orderBy("pos")
    edges = n.select(F.col("pos").alias("from_pos"), F.lead("pos").over(w).alias("to_pos")).where("to_pos is not null").withColumn("edge_type", F.lit("next"))
    nodes = vector_graph(spark, d).nodes
    return ingest.ingest(n, edges, nodes, None, 1, nodes.count())[2]
