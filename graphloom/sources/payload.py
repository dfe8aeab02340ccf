"""Graphs from JSON payloads of entities and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import ValidationFailed
from graphloom.functions.text import blank_to_null, trimmed

SCHEMA = (
    "entities array<struct<id: string, name: string, type: string, props: string, full_context: string, embed_context: string, image_url: string>>, "
    "relations array<struct<`from`: string, `to`: string, type: string, weight: double, props: string, full_context: string, embed_context: string>>"
)
#: Most entities of one request.
MOST_ENTITIES = 10_000


def parse(payloads: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of JSON texts, each a payload of its own under ``payload_id`` if there is such a column.

    nodes: payload_id, pos, payload_key, name, node_type, external_id, props, full_context, embed_context, image_url
    edges: payload_id, pos, from_pos, to_pos, edge_type, weight, full_context, embed_context

    Of entities that repeat an id, relations mean the last. A relation with an unknown end is dropped. Names and types are
    trimmed, a blank type is Entity, blank optional texts are null, a missing weight is 1. A payload without one of the two
    arrays is an error.
    """
    key: Column = F.col("payload_id") if "payload_id" in payloads.columns else F.lit(0)
    p = payloads.select(key.alias("payload_id"), F.from_json(column, SCHEMA).alias("p"))
    missing = F.col("p.entities").isNull() | F.col("p.relations").isNull()
    array = lambda c: F.when(missing, F.raise_error(F.lit("a payload needs entities and relations"))).otherwise(F.col(c))
    e = p.select("payload_id", F.posexplode(array("p.entities")).alias("pos", "e"))
    name, kind = F.coalesce(trimmed(F.col("e.name")), F.lit("")), F.coalesce(blank_to_null(F.col("e.type")), F.lit("Entity"))
    nodes = e.select(
        "payload_id",
        "pos",
        F.col("e.id").alias("payload_key"),
        name.alias("name"),
        kind.alias("node_type"),
        F.coalesce(blank_to_null(F.col("e.id")), F.concat_ws(":", kind, name)).alias("external_id"),
        F.col("e.props").alias("props"),
        F.coalesce("e.full_context", F.lit("")).alias("full_context"),
        blank_to_null(F.col("e.embed_context")).alias("embed_context"),
        F.nullif(F.col("e.image_url"), F.lit("")).alias("image_url"),
    )
    last = nodes.where("payload_key is not null").groupBy("payload_id", "payload_key").agg(F.max("pos").alias("p"))
    end = lambda c, to: last.select("payload_id", F.col("payload_key").alias(c), F.col("p").alias(to))
    r = p.select("payload_id", F.posexplode(array("p.relations")).alias("pos", "r")).select(
        "payload_id",
        "pos",
        F.col("r.from").alias("from_key"),
        F.col("r.to").alias("to_key"),
        F.coalesce("r.type", F.lit("")).alias("edge_type"),
        F.coalesce("r.weight", F.lit(1.0)).alias("weight"),
        F.coalesce("r.full_context", F.lit("")).alias("full_context"),
        blank_to_null(F.col("r.embed_context")).alias("embed_context"),
    )
    edges = r.join(end("from_key", "from_pos"), ["payload_id", "from_key"]).join(end("to_key", "to_pos"), ["payload_id", "to_key"])
    return nodes, edges.select("payload_id", "pos", "from_pos", "to_pos", "edge_type", "weight", "full_context", "embed_context")


def read_payload(spark: SparkSession, source: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON text, or of a file of one."""
    if source.lstrip().startswith("{"):
        return parse(spark.createDataFrame([(source,)], "payload string"))
    return parse(spark.read.text(source, wholetext=True).withColumnRenamed("value", "payload"))


def check_size(nodes: DataFrame) -> None:
    """A request has 1 to MOST_ENTITIES entities."""
    n = nodes.limit(MOST_ENTITIES + 1).count()
    if not 1 <= n <= MOST_ENTITIES:
        raise ValidationFailed(f"a request has 1 to {MOST_ENTITIES} entities")


def node_embed_text(nodes: DataFrame) -> Column:
    """What is embedded of a node: embed_context, else full_context, else the name."""
    return F.coalesce(blank_to_null(nodes["embed_context"]), blank_to_null(nodes["full_context"]), nodes["name"])


def edge_embed_text(edges: DataFrame) -> Column:
    """What is embedded of an edge: embed_context, else full_context, else the type."""
    return F.coalesce(blank_to_null(edges["embed_context"]), blank_to_null(edges["full_context"]), edges["edge_type"])


def split_images(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text nodes, image nodes): the latter have an image_url and go to the image embedder."""
    return nodes.where("image_url is null"), nodes.where("image_url is not null")
