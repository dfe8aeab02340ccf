"""Export and import by name: JSON documents, NDJSON lines, snapshots, and a binary vector file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, conform
from graphloom.session import map_arrow

VERSION = "1"


def _union(a: DataFrame, b: DataFrame | None) -> DataFrame:
    return a if b is None else a.unionByName(b, allowMissingColumns=True)


def export_nodes(base: Graph, delta: Graph | None = None) -> DataFrame:
    """Nodes of both layers as they are exchanged."""
    n = _union(base.nodes, delta and delta.nodes)
    return n.select("name", "node_type", "props", "full_context", "embed_context", "image_url")


def export_edges(base: Graph, delta: Graph | None = None) -> DataFrame:
    """Edges of both layers, with names in place of ids; an unknown end is an empty name."""
    names = _union(base.nodes, delta and delta.nodes).select("id", "name")
    e = _union(base.edges, delta and delta.edges)
    e = e.join(names.select(F.col("id").alias("src"), F.col("name").alias("f")), "src", "left").join(names.select(F.col("id").alias("dst"), F.col("name").alias("t")), "dst", "left")
    return e.select(F.coalesce("f", F.lit("")).alias("from"), F.coalesce("t", F.lit("")).alias("to"), "edge_type", "weight", "full_context", "embed_context")


def now_utc() -> Column:
    """The time in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _line(kind: str, *cols: Column) -> Column:
    """One JSON object; nulls and empty contexts are left out."""
    return F.to_json(F.struct(F.lit(kind).alias("type"), *cols))


def ndjson(base: Graph, delta: Graph | None = None, exported_at: str | None = None) -> DataFrame:
    """(section, value): one meta line, a line a node, a line an edge."""
    n, e = export_nodes(base, delta), export_edges(base, delta)
    context = F.nullif(F.col("full_context"), F.lit("")).alias("full_context")
    at = F.lit(exported_at) if exported_at else now_utc()
    meta = n.agg(F.count(F.lit(1)).alias("nodes")).join(e.agg(F.count(F.lit(1)).alias("edges")))
    meta = meta.select(F.lit(0).alias("section"), _line("meta", F.lit(VERSION).alias("version"), at.alias("exported_at"), "nodes", "edges").alias("value"))
    nodes = n.select(F.lit(1).alias("section"), _line("node", "name", "node_type", "props", context, "embed_context", "image_url").alias("value"))
    edges = e.select(F.lit(2).alias("section"), _line("edge", "from", "to", "edge_type", "weight", context, "embed_context").alias("value"))
    return meta.union(nodes).union(edges)


def write_ndjson(lines: DataFrame, path: str) -> None:
    """The lines as text files in order of section; the meta line comes first. Lines of a section go to many files."""
    dealt = lines.withColumn("h", F.xxhash64("value"))
    dealt.repartitionByRange("section", "h").sortWithinPartitions("section", "h").select("value").write.text(path)


def export_json(base: Graph, delta: Graph | None = None, exported_at: str | None = None) -> DataFrame:
    """One row: the whole graph as one JSON document. For graphs that fit into one value; others go out as NDJSON."""
    n, e = export_nodes(base, delta), export_edges(base, delta)
    nodes = n.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(*n.columns))).alias("nodes"))
    edges = e.agg(F.count(F.lit(1)).alias("m"), F.sort_array(F.collect_list(F.struct(*e.columns))).alias("edges"))
    at = F.lit(exported_at) if exported_at else now_utc()
    doc = F.struct(F.lit(VERSION).alias("version"), at.alias("exported_at"), F.struct(F.col("n").alias("nodes"), F.col("m").alias("edges")).alias("stats"), "nodes", "edges")
    return nodes.join(edges).select(F.to_json(doc).alias("value"))


LINE = "type string, version string, exported_at string, nodes long, edges long, name string, node_type string, props string, full_context string, embed_context string, image_url string, `from` string, `to` string, edge_type string, weight double"
DOCUMENT = (
    "nodes array<struct<name: string, node_type: string, props: string, full_context: string, embed_context: string, image_url: string>>, "
    "edges array<struct<`from`: string, `to`: string, edge_type: string, weight: double, full_context: string, embed_context: string>>"
)


def parse_ndjson(lines: DataFrame, column: str = "value", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of exchanged lines. Blank lines are skipped; a bad line is an error, or with strict=False skipped."""
    rows = lines.where(F.trim(column) != "").select(F.from_json(column, LINE, {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("x")).select("x.*")
    nodes = rows.where("type = 'node'").select("name", "node_type", "props", F.coalesce("full_context", F.lit("")).alias("full_context"), "embed_context", "image_url")
    edges = rows.where("type = 'edge'").select("from", "to", "edge_type", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.coalesce("full_context", F.lit("")).alias("full_context"), "embed_context")
    return nodes, edges


def read_upload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a file that is one JSON document, or else NDJSON."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", DOCUMENT).alias("d")).where("d.nodes is not null and d.edges is not null")
    if whole.isEmpty():
        return parse_ndjson(spark.read.text(path))
    return whole.select(F.inline("d.nodes")), whole.select(F.inline("d.edges"))


def import_graph(base: Graph, nodes: DataFrame, edges: DataFrame, first_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new nodes, new edges, counts) of exchanged rows.

    A name that the base has is skipped; of names that repeat, one row is kept, the first by type. New nodes get ids from
    ``first_id`` in order of name, and ``type:name`` as external id. Edges are resolved by name, over the base and the new
    nodes, and skipped if an end is unknown. counts: imported_nodes, imported_edges, skipped_edges.
    """
    known = base.nodes.groupBy("name").agg(F.max("id").alias("id"))
    fresh = nodes.join(known, "name", "left_anti").groupBy("name").agg(F.min_by(F.struct("node_type", "props", "full_context", "embed_context", "image_url"), F.col("node_type")).alias("n")).select("name", "n.*")
    new = numbered(fresh, ["name"], first_id).withColumn("external_id", F.concat_ws(":", "node_type", "name")).withColumn("weight", F.lit(0.0))
    ids = known.unionByName(new.select("name", "id"))
    ends = edges.join(ids.select(F.col("name").alias("from"), F.col("id").alias("src")), "from", "left").join(ids.select(F.col("name").alias("to"), F.col("id").alias("dst")), "to", "left")
    good = ends.where("src is not null and dst is not null")
    counts = new.agg(F.count(F.lit(1)).alias("imported_nodes")).join(
        ends.agg(F.coalesce(F.sum(F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), 1).otherwise(0)), F.lit(0)).alias("imported_edges"), F.coalesce(F.sum(F.when(F.col("src").isNull() | F.col("dst").isNull(), 1).otherwise(0)), F.lit(0)).alias("skipped_edges"))
    )
    return conform(new, NODE_SCHEMA), good, counts


def numbered(df: DataFrame, order: list[str], first: int, name: str = "id") -> DataFrame:
    """Consecutive numbers from ``first`` in the given order, without bringing the rows to one task.

    Rows are range-partitioned and stored; the partitions' sizes, one number each, give their offsets.
    """
    from graphloom.session import cut

    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], first
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(total)
        total += sizes.get(p, 0)
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets or [first]]), (part + 1).cast("int"))
    return rows.withColumn(name, start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def save_snapshot(graph: Graph, path: str) -> None:
    """Nodes and edges as Parquet, the edges clustered by source in order of insertion."""
    graph.nodes.write.parquet(f"{path}/nodes")
    graph.edges.repartitionByRange("src").sortWithinPartitions("src", "ord").write.parquet(f"{path}/edges")


def load_snapshot(spark: SparkSession, path: str) -> Graph:
    """A saved graph; columns that an older one lacks are null, empty contexts or weight 1."""
    nodes = conform(spark.read.parquet(f"{path}/nodes"), NODE_SCHEMA).withColumns({"full_context": F.coalesce("full_context", F.lit("")), "weight": F.coalesce("weight", F.lit(1.0))})
    edges = conform(spark.read.parquet(f"{path}/edges"), EDGE_SCHEMA).withColumns({"full_context": F.coalesce("full_context", F.lit("")), "edge_type": F.coalesce("edge_type", F.lit("")), "weight": F.coalesce("weight", F.lit(1.0))})
    return Graph(nodes, edges)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, embedding) of binary files: two little-endian 32-bit counts, dimension and rows, then the rows of floats.

    A file that is shorter than it says is an error. Each file is one task's work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                dim, n = (int(x) for x in np.frombuffer(raw, "<u4", 2))
                if len(raw) < 8 + 4 * dim * n:
                    raise ValueError(f"a vector file of {len(raw)} bytes cannot hold {n} rows of {dim}")
                rows = np.frombuffer(raw, "<f4", dim * n, 8).reshape(n, dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(list(rows), pa.list_(pa.float32()))], names=["id", "embedding"])

    return map_arrow(spark.read.format("binaryFile").load(path).select("content"), run, "id long, embedding array<float>")


def vector_bytes(rows: np.ndarray) -> bytes:
    """A matrix in the form that ``read_vectors`` reads."""
    return np.array([rows.shape[1], rows.shape[0]], "<u4").tobytes() + np.ascontiguousarray(rows, "<f4").tobytes()


def checked_dimension(df: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """The rows, failing when a vector has another dimension."""
    return df.where(F.assert_true(F.col(column).isNull() | (F.size(column) == dim), F.lit(f"vectors have {dim} dimensions")).isNull())
