"""The delta: checksummed log lines, replay, merging into the base, and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import fnv1a
from graphloom.functions.vectors import normalise
from graphloom.operators.graph import EDGE_SCHEMA, NODE_SCHEMA, Graph, build, conform
from graphloom.sources.exchange import load_snapshot, numbered, save_snapshot

NODE_FIELDS = "op string, id long, external_id string, name string, node_type string, props string, full_context string, embed_context string, image_url string, embedding array<float>"
EDGE_FIELDS = "edge_id long, src long, dst long, edge_type string, weight double"
RECORD = f"{NODE_FIELDS}, {EDGE_FIELDS}"
MERGE_THRESHOLD = 500


def log_line(record: Column) -> Column:
    """``checksum|json``: eight hexadecimal digits of the JSON's FNV-1a hash."""
    return F.concat(F.lower(F.lpad(F.hex(fnv1a(record)), 8, "0")), F.lit("|"), record)


def node_records(nodes: DataFrame) -> DataFrame:
    cols = [c for c in ("id", "external_id", "name", "node_type", "props", "full_context", "embed_context", "image_url", "embedding") if c in nodes.columns]
    return nodes.select(log_line(F.to_json(F.struct(F.lit("add_node").alias("op"), *cols))).alias("value"))


def edge_records(edges: DataFrame) -> DataFrame:
    cols = [c for c in ("edge_id", "src", "dst", "edge_type", "weight", "full_context", "embed_context", "embedding") if c in edges.columns]
    return edges.select(log_line(F.to_json(F.struct(F.lit("add_edge").alias("op"), *cols))).alias("value"))


def replay(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts) of log lines. Blank lines, wrong checksums, malformed JSON and unknown operations are skipped;
    a line without a checksum of eight hexadecimal digits is taken as it is. counts: entries."""
    line = F.col(column)
    digits, rest = F.regexp_extract(line, r"^([0-9a-fA-F]{8})\|(.*)$", 1), F.regexp_extract(line, r"^([0-9a-fA-F]{8})\|(.*)$", 2)
    checked = lines.where(F.trim(line) != "").select(F.when(digits == "", line).otherwise(rest).alias("json"), digits.alias("digits"))
    checked = checked.where((F.col("digits") == "") | (F.lower("digits") == F.lower(F.lpad(F.hex(fnv1a(F.col("json"))), 8, "0"))))
    rows = checked.select(F.from_json("json", RECORD).alias("r")).select("r.*").where("op in ('add_node', 'add_edge')")
    nodes = conform(rows.where("op = 'add_node' and id is not null"), NODE_SCHEMA)
    edges = conform(rows.where("op = 'add_edge' and src is not null and dst is not null"), EDGE_SCHEMA)
    return nodes, edges, rows.agg(F.count(F.lit(1)).alias("entries"))


def append(records: DataFrame, path: str) -> None:
    """Add log lines to a log folder; each call is one atomic commit of files."""
    records.write.mode("append").text(path)


def normalised(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", normalise("embedding").cast("array<float>"))


def needs_merge(delta: Graph, threshold: int = MERGE_THRESHOLD) -> DataFrame:
    """One row: delta_size and whether it reaches the threshold."""
    size = delta.nodes.select(F.lit(1)).union(delta.edges.select(F.lit(1))).agg(F.count(F.lit(1)).alias("delta_size"))
    return size.withColumn("needs_merge", F.col("delta_size") >= threshold)


def neighbours(delta: Graph, node_id: int) -> DataFrame:
    """A node's outgoing edges in the delta."""
    return delta.edges.where(F.col("src") == node_id).orderBy("ord")


def merge(base: Graph, delta: Graph) -> Graph:
    """The base with the delta's nodes and edges; all node weights follow from the new degrees.

    Delta nodes get ids from the base's count on, in order of their own ids; delta edges are mapped to them and come after
    the base's edges, with edge ids after the largest.
    """
    count = base.nodes.count()
    moved = numbered(delta.nodes.withColumnRenamed("id", "old"), ["old"], count)
    ids = moved.select("old", F.col("id").alias("new"))
    last = base.edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1)).alias("e"), F.coalesce(F.max("ord"), F.lit(-1)).alias("o")).first()
    edges = numbered(delta.edges.drop("edge_id").withColumnRenamed("ord", "was"), ["was"], 0, "n")
    for c in ("src", "dst"):
        edges = edges.join(ids.select(F.col("old").alias(c), F.col("new").alias(f"{c}_new")), c, "left").withColumn(c, F.coalesce(f"{c}_new", c)).drop(f"{c}_new")
    edges = edges.withColumns({"edge_id": F.col("n") + last["e"] + 1, "ord": F.col("n") + last["o"] + 1})
    nodes = conform(base.nodes, NODE_SCHEMA).union(conform(moved, NODE_SCHEMA))
    return build(nodes, conform(base.edges, EDGE_SCHEMA).union(conform(edges, EDGE_SCHEMA)))


class SnapshotStore:
    """Numbered snapshots under one folder. A version counts once its marker exists, which is written last; readers of an
    older version keep it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".done"))

    def save(self, graph: Graph) -> int:
        version = max(self.versions(), default=0) + 1
        save_snapshot(graph, f"{self.path}/v{version}")
        fs, p = self._fs(f"{self.path}/v{version}.done")
        fs.create(p).close()
        return version

    def load(self, version: int | None = None) -> Graph:
        return load_snapshot(self.spark, f"{self.path}/v{version or self.versions()[-1]}")
