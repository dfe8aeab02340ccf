"""Batch jobs: what a service does on request, as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators import delta as log
from graphloom.operators import ingest, models
from graphloom.operators.graph import EDGE_SCHEMA, Graph, build, conform
from graphloom.operators.ingest import Resolution
from graphloom.operators.models import Embedder
from graphloom.session import cut, map_arrow
from graphloom.sources import exchange, payload

NOTHING = "no entities found in the text"


def _embedded(nodes: DataFrame, edges: DataFrame, embedder: Embedder, image_embedder: Embedder | None) -> tuple[DataFrame, DataFrame]:
    """Nodes by text or image, edges by text; each row is embedded once."""
    text, image = payload.split_images(nodes)
    by_text = models.embed(text.withColumn("_t", payload.node_embed_text(text)), "_t", embedder).drop("_t")
    if image_embedder is not None:
        by_text = by_text.unionByName(models.embed(image, "image_url", image_embedder))
    else:
        by_text = by_text.unionByName(models.embed(image.withColumn("_t", payload.node_embed_text(image)), "_t", embedder).drop("_t"))
    return cut(by_text), cut(models.embed(edges.withColumn("_t", payload.edge_embed_text(edges)), "_t", embedder).drop("_t"))


def graph_from_payload(spark: SparkSession, source: str, embedder: Embedder, image_embedder: Embedder | None = None) -> Graph:
    """A graph of a payload, a JSON text or file: ids by position, all nodes and edges embedded."""
    nodes, edges = _embedded(*payload.read_payload(spark, source), embedder, image_embedder)
    rows = nodes.withColumn("id", F.col("pos").cast("long"))
    linked = edges.select(F.col("pos").cast("long").alias("edge_id"), F.col("from_pos").cast("long").alias("src"), F.col("to_pos").cast("long").alias("dst"), "edge_type", "weight", "full_context", "embed_context", "embedding", F.col("pos").cast("long").alias("ord"))
    return build(rows, linked)


def ingest_file(spark: SparkSession, source: str, folder: str, embedder: Embedder) -> int:
    """One-shot: read a payload, embed it, save it as the next snapshot. Returns the version."""
    return log.SnapshotStore(spark, folder).save(graph_from_payload(spark, source, embedder))


def ingest_json(spark: SparkSession, source: str, base: Graph, delta: Graph | None, embedder: Embedder, image_embedder: Embedder | None = None, instance: int = 0, cfg: Resolution = Resolution(), store: Callable[[DataFrame], DataFrame] | None = None) -> tuple[Graph, DataFrame]:
    """(what a payload adds to the delta, counts). ``store`` may replace image URLs before anything is embedded."""
    nodes, edges = payload.read_payload(spark, source)
    payload.check_size(nodes)
    if store is not None:
        nodes = store(nodes)
    nodes, edges = _embedded(nodes, edges, embedder, image_embedder)
    return _added(nodes, edges, base, delta, instance, cfg)


def ingest_text(spark: SparkSession, text: str, base: Graph, delta: Graph | None, embedder: Embedder, extractor: Callable = models.capitalised, instance: int = 0, cfg: Resolution = Resolution()) -> tuple[Graph, DataFrame] | str:
    """Like ``ingest_json``, of what the extractor finds in a text; a message if that is nothing."""
    found = cut(models.extract(spark.createDataFrame([(0, text)], "id long, t string"), "id", "t", extractor))
    if found.where(F.size("entities") > 0).isEmpty():
        return NOTHING
    doc = found.select(F.to_json(F.struct("entities", "relations")).alias("payload"))
    nodes, edges = _embedded(*payload.parse(doc), embedder, None)
    return _added(nodes, edges, base, delta, instance, cfg)


def _added(nodes: DataFrame, edges: DataFrame, base: Graph, delta: Graph | None, instance: int, cfg: Resolution) -> tuple[Graph, DataFrame]:
    taken = base.nodes.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] + 1
    number, first_edge = base.edges.agg(F.count(F.lit(1)), F.coalesce(F.max("edge_id"), F.lit(-1)) + 1).first()
    if delta is not None:
        taken = max(taken, delta.nodes.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0] + 1)
        first_edge = max(first_edge, delta.edges.agg(F.coalesce(F.max("edge_id"), F.lit(-1))).first()[0] + 1)
    fresh, linked, counts = ingest.ingest(nodes, edges, base.nodes, delta and delta.nodes, instance, taken, cfg)
    linked = exchange.numbered(linked, ["pos"], first_edge, "edge_id").withColumn("ord", F.col("edge_id"))
    return Graph(log.normalised(conform(fresh, log.NODE_SCHEMA)), log.normalised(conform(linked, EDGE_SCHEMA))), counts


def merge_if_due(store: log.SnapshotStore, delta: Graph, threshold: int = log.MERGE_THRESHOLD) -> int | None:
    """Merge the delta into the latest snapshot once it is large enough; returns the new version. Readers of the old one
    keep it; a failure leaves both as they were and is raised."""
    if not log.needs_merge(delta, threshold).first()["needs_merge"]:
        return None
    return store.save(log.merge(store.load(), delta))


def store_images(nodes: DataFrame, folder: str, base_url: str) -> DataFrame:
    """Nodes whose data-URI images are replaced by URLs of content-addressed names; other URLs stay.

    The images' bytes are written as Parquet (name, bytes) under ``folder``, each name once.
    """
    is_data = F.col("image_url").startswith("data:")
    images = nodes.where(is_data).select(models.image_key(F.col("image_url")).alias("name"), F.unbase64(F.substring_index("image_url", ",", -1)).alias("bytes"))
    images.dropDuplicates(["name"]).write.mode("append").parquet(folder)
    return nodes.withColumn("image_url", F.when(is_data, F.concat(F.lit(base_url.rstrip("/") + "/"), models.image_key(F.col("image_url")))).otherwise(F.col("image_url")))


def call_model(df: DataFrame, column: str, model: Callable[[list[str]], list[str]], into: str, texts: int = 32) -> DataFrame:
    """The rows with a text model's replies to a column, in calls of so many texts."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(at).to_pylist()
            got = [r for i in range(0, len(asked), texts) for r in model(asked[i : i + texts])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], names=[*b.schema.names, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{into}` string"
    return map_arrow(df, run, schema)
