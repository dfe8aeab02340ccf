"""Log records, merging, export and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import fnv1a
from graphloom.operators import delta as log
from graphloom.plans.graphs import SPLIT_SQL, VECTOR_SQL, split_graph, table, vector_graph
from graphloom.plans.registered import query, r6
from graphloom.sources import exchange

FNV_SQL = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(range(1, length({x}) + 1), lambda i: ascii(substr({x}, i::BIGINT, 1))::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295::UBIGINT)"
BOTH = f"WITH {VECTOR_SQL}, {SPLIT_SQL}"


@query(f"SELECT c_custkey, lower(format('{{:08x}}', {FNV_SQL.format(x='c_name')}::BIGINT)) || '|' || c_name AS line FROM customer")
def wal_lines_checksum(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", log.log_line(F.col("c_name")).alias("line"))


@query("SELECT n_nationkey, n_name AS name, n_nationkey AS id FROM nation WHERE n_nationkey % 5 <> 4 AND n_nationkey % 5 <> 3")
def wal_replay(spark: SparkSession, d: str) -> DataFrame:
    """Of five lines, one is damaged, one is cut short, and one is an old line without a checksum."""
    n = table(spark, d, "nation")
    record = F.to_json(F.struct(F.lit("add_node").alias("op"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))
    line, m = log.log_line(record), F.col("n_nationkey") % 5
    damaged = F.when(m == 4, F.concat(F.lit("00000000"), F.substring(line, 9, 1 << 20))).when(m == 3, F.substring(line, 1, 30)).when(m == 2, record).otherwise(line)
    nodes = log.replay(n.select(damaged.alias("value")))[0]
    return nodes.select(F.col("id").cast("int").alias("n_nationkey"), "name", F.col("id").cast("int").alias("id"))


@query("SELECT count(*) FILTER (WHERE n_nationkey % 5 < 3) AS entries FROM nation")
def wal_replay_count(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    record = F.to_json(F.struct(F.lit("add_node").alias("op"), F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")))
    line, m = log.log_line(record), F.col("n_nationkey") % 5
    damaged = F.when(m == 4, F.concat(F.lit("00000000"), F.substring(line, 9, 1 << 20))).when(m == 3, F.substring(line, 1, 30)).otherwise(line)
    return log.replay(n.select(damaged.alias("value")))[2]


@query(f"SELECT n_name, {FNV_SQL.format(x='n_name')}::BIGINT AS fnv FROM nation")
def fnv_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_name", fnv1a(F.col("n_name")).alias("fnv"))


# The delta's ids follow the base's without a gap here, so merging keeps them; ids are shifted first to make it visible.
SHIFT = 1 << 24
MERGED = f"""{BOTH}"""


def _merged(spark: SparkSession, d: str):  # noqa: ANN202
    base, delta = split_graph(spark, d)
    moved = lambda c: F.when(F.col(c) >= 400, F.col(c) + SHIFT).otherwise(F.col(c)).alias(c)
    nodes = delta.nodes.withColumn("id", F.col("id") + SHIFT)
    edges = delta.edges.withColumns({c: moved(c) for c in ("src", "dst")})
    return log.merge(base, log.Graph(nodes, edges))


@query(f"{MERGED} SELECT id, name, node_type, external_id FROM nodes")
def merge_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).nodes.select("id", "name", "node_type", "external_id")


@query(f"""{MERGED}, b AS (SELECT count(*) AS n, max(edge_id) AS last FROM base_edges)
    SELECT edge_id, src, dst, edge_type, round(weight, 6) AS weight FROM base_edges UNION ALL
    SELECT last + row_number() OVER (ORDER BY ord), src, dst, edge_type, round(weight, 6) FROM delta_edges, b""")
def merge_edges_remapped(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).edges.select("edge_id", "src", "dst", "edge_type", r6("weight").alias("weight"))


@query(f"{MERGED} SELECT id, round(weight, 6) AS weight FROM nodes")
def merge_weights(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d).nodes.select("id", r6("weight").alias("weight"))


@query(f"{BOTH} SELECT (SELECT count(*) FROM delta_nodes) + (SELECT count(*) FROM delta_edges) AS delta_size, (SELECT count(*) FROM delta_nodes) + (SELECT count(*) FROM delta_edges) >= 500 AS needs_merge")
def needs_merge(spark: SparkSession, d: str) -> DataFrame:
    return log.needs_merge(split_graph(spark, d)[1])


@query(f"{BOTH} SELECT src, dst, round(weight, 6) AS weight FROM delta_edges WHERE src = 420")
def delta_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return log.neighbours(split_graph(spark, d)[1], 420).select("src", "dst", r6("weight").alias("weight"))


@query(f"{BOTH} SELECT name, node_type, props, full_context, embed_context, image_url FROM nodes")
def export_nodes(spark: SparkSession, d: str) -> DataFrame:
    return exchange.export_nodes(*split_graph(spark, d))


@query(f"{BOTH} SELECT 'vec_' || src AS \"from\", 'vec_' || dst AS \"to\", edge_type, round(weight, 6) AS weight FROM edges")
def export_edges(spark: SparkSession, d: str) -> DataFrame:
    return exchange.export_edges(*split_graph(spark, d)).select("from", "to", "edge_type", r6("weight").alias("weight"))


@query(f"""WITH {VECTOR_SQL} SELECT 0 AS section, '{{"type":"meta","version":"1","exported_at":"2024-01-01T00:00:00Z","nodes":' || (SELECT count(*) FROM nodes) || ',"edges":' || (SELECT count(*) FROM edges) || '}}' AS value, NULL::DOUBLE AS weight
    UNION ALL SELECT 1, '{{"type":"node","name":"' || name || '","node_type":"' || node_type || '","props":"{{\\"label\\": ' || label || '}}","full_context":"' || full_context || '"'
      || coalesce(',"embed_context":"' || embed_context || '"', '') || coalesce(',"image_url":"' || image_url || '"', '') || '}}', NULL FROM nodes JOIN emb USING (id)
    UNION ALL SELECT 2, '{{"type":"edge","from":"vec_' || src || '","to":"vec_' || dst || '","edge_type":"' || edge_type || '","weight":?}}', round(weight, 6) FROM edges""")
def ndjson_lines(spark: SparkSession, d: str) -> DataFrame:
    """All lines; an edge's weight, whose last digits depend on the order of sums, stands beside its line."""
    lines = exchange.ndjson(vector_graph(spark, d), exported_at="2024-01-01T00:00:00Z")
    weight = F.get_json_object("value", "$.weight").cast("double")
    return lines.select("section", F.regexp_replace("value", '"weight":[-0-9.E]+', '"weight":?').alias("value"), r6(weight).alias("weight"))


@query(f"""{BOTH} SELECT (SELECT count(*) FROM delta_nodes) AS imported_nodes, (SELECT count(*) FROM edges) AS imported_edges, 1 AS skipped_edges""")
def import_result(spark: SparkSession, d: str) -> DataFrame:
    base, _ = split_graph(spark, d)
    whole = vector_graph(spark, d)
    ghost = exchange.export_edges(whole).limit(1).withColumn("to", F.lit("GHOST"))
    counts = exchange.import_graph(base, exchange.export_nodes(whole), exchange.export_edges(whole).union(ghost), 1000)[2]
    return counts.select("imported_nodes", "imported_edges", "skipped_edges")


@query(f"WITH {VECTOR_SQL} SELECT 'vec_' || src AS \"from\", 'vec_' || dst AS \"to\", edge_type, round(weight, 6) AS weight FROM edges")
def roundtrip(spark: SparkSession, d: str) -> DataFrame:
    lines = exchange.ndjson(vector_graph(spark, d))
    return exchange.parse_ndjson(lines)[1].select("from", "to", "edge_type", r6("weight").alias("weight"))


@query(f"WITH {VECTOR_SQL} SELECT name, node_type, props FROM nodes")
def roundtrip_nodes(spark: SparkSession, d: str) -> DataFrame:
    return exchange.parse_ndjson(exchange.ndjson(vector_graph(spark, d)))[0].select("name", "node_type", "props")


@query(f"WITH {VECTOR_SQL} SELECT '1' AS version, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def export_json_stats(spark: SparkSession, d: str) -> DataFrame:
    doc = exchange.export_json(vector_graph(spark, d)).select(F.from_json("value", "version string, stats struct<nodes: long, edges: long>").alias("x"))
    return doc.select("x.version", "x.stats.nodes", "x.stats.edges")
