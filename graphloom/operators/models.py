"""The places where models plug in, deterministic stand-ins for them, and the prompts, which are plain strings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import strip_fence, trimmed
from graphloom.session import map_arrow, ship

#: Texts of one call to an embedder.
CALL_TEXTS = 256


@dataclass(frozen=True)
class Hints:
    """What a caller may add to a model's instructions; a system prompt replaces the built-in one."""

    system_prompt: str | None = None
    rules: list[str] = field(default_factory=list)
    extend_context: list[str] = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.system_prompt or self.rules or self.extend_context)


@dataclass(frozen=True)
class HashedWords:
    """A stand-in embedder: words hashed into dimensions, at unit length."""

    dim: int = 64

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 16 & 1 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 1e-9)


Embedder = Callable[[list[str]], np.ndarray]


def embed(df: DataFrame, text: str, embedder: Embedder, into: str = "embedding") -> DataFrame:
    """The rows with the embedding of a text column; texts reach the embedder in calls of a bounded number."""
    ship(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = s.fillna("").tolist()
            rows = [r for i in range(0, len(texts), CALL_TEXTS) for r in embedder(texts[i : i + CALL_TEXTS]).astype(np.float32)]
            yield pd.Series(rows, index=s.index)

    return df.withColumn(into, run(F.col(text)))


def capitalised(text: str) -> tuple[list[dict], list[dict]]:
    """A stand-in extractor: capitalised words are entities, neighbours in a sentence are related."""
    entities, relations = {}, []
    for sentence in re.split(r"[.!?]", text or ""):
        names = re.findall(r"\b[A-Z][a-z]+\b", sentence)
        for n in names:
            entities.setdefault(n, {"id": f"e{len(entities) + 1}", "name": n, "type": "Entity"})
        relations += [{"from": entities[a]["id"], "to": entities[b]["id"], "type": "near", "weight": 1.0} for a, b in zip(names, names[1:], strict=False)]
    return list(entities.values()), relations


EXTRACTED = "id long, entities array<struct<id: string, name: string, type: string>>, relations array<struct<`from`: string, `to`: string, type: string, weight: double>>"


def extract(df: DataFrame, id_col: str, text_col: str, extractor: Callable[[str], tuple[list[dict], list[dict]]] = capitalised) -> DataFrame:
    """(id, entities, relations) of each text, less relations whose ends the extractor did not name."""
    entity = pa.list_(pa.struct([(c, pa.string()) for c in ("id", "name", "type")]))
    relation = pa.list_(pa.struct([("from", pa.string()), ("to", pa.string()), ("type", pa.string()), ("weight", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extractor(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e for e, _ in got], entity), pa.array([r for _, r in got], relation)], names=["id", "entities", "relations"])

    found = map_arrow(df.select(F.col(id_col).cast("long").alias("id"), text_col), run, EXTRACTED)
    return found.withColumn("relations", known_relations(F.col("entities"), F.col("relations")))


REPLY = "entities array<struct<id: string, name: string, type: string, full_context: string, props: string>>, relations array<struct<`from`: string, `to`: string, type: string, weight: double, full_context: string>>"


def parse_extract(raw: Column) -> Column:
    """struct(entities, relations) of an extracting model's reply: fences stripped, absent lists empty, relations to unknown
    ids dropped; null for a reply that isn't a JSON object."""
    text = trimmed(strip_fence(raw))
    got = F.from_json(text, REPLY + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    entities = F.coalesce(got["entities"], F.array().cast("array<struct<id: string, name: string, type: string, full_context: string, props: string>>"))
    relations = F.coalesce(got["relations"], F.array().cast("array<struct<`from`: string, `to`: string, type: string, weight: double, full_context: string>>"))
    good = got["_bad"].isNull() & text.startswith("{")
    return F.when(good, F.struct(entities.alias("entities"), known_relations(entities, relations).alias("relations")))


def known_relations(entities: Column, relations: Column) -> Column:
    """The relations both of whose ends are ids of entities."""
    ids = F.transform(entities, lambda e: e["id"])
    return F.filter(relations, lambda r: F.array_contains(ids, r["from"]) & F.array_contains(ids, r["to"]))


# The texts that prompts are made of.
NO_CONTEXT = "No relevant context found in the knowledge graph."
ANSWER_SYSTEM = "You are a knowledge graph question-answering system."
ANSWER_LEAD = "Below is the relevant subgraph retrieved for this query."
ANSWER_INSTRUCTIONS = (
    "- Answer based strictly on the entities and relationships above.\n"
    '- Cite entity names directly (e.g. "Alice works at Acme Corp").\n'
    "- If the context is insufficient, clearly state what is missing.\n"
    "- Be concise — one to three sentences is ideal."
)
LAST_ITERATION = "\n⚠️  This is the LAST iteration — you MUST set done=true and give your best answer."
MOST_FOLLOW_UPS = 5

#: What a model is told to reply with; the keys are those that replies are read by.
REASON_SYSTEM = (
    "You answer questions over a part of a knowledge graph, and say whether that part suffices.\n"
    "Reply with one JSON object and nothing else:\n"
    '{"answer": "<the answer, or what is missing>", "follow_ups": ["<entity name>"], "done": <true or false>}\n'
    "Set done to true with no follow_ups if you can answer now. Otherwise set it to false and name the entities to look at\n"
    f"next, {MOST_FOLLOW_UPS} at most, exactly as they are called, and only if they would change the answer. In the last iteration done is true."
)
EXTRACT_SYSTEM = (
    "You extract entities and the relations between them from a text.\n"
    "Reply with one JSON object and nothing else:\n"
    '{"entities": [{"id": "<own id>", "name": "", "type": "", "full_context": "<one sentence>", "props": {}}],\n'
    ' "relations": [{"from": "<entity id>", "to": "<entity id>", "type": "", "weight": <0 to 1>, "full_context": "<one sentence>"}]}\n'
    "Both ends of a relation are ids of entities in the reply. Without any, reply with empty arrays."
)


def system_prompt(builtin: str, hints: Hints = Hints()) -> str:
    """The caller's system prompt, if there is one; else the built-in one with the caller's rules."""
    if hints.system_prompt:
        return hints.system_prompt
    return builtin + ("\n\nAdditional rules:\n" + "\n".join(f"- {r}" for r in hints.rules) if hints.rules else "")


def shown_props(props: Column) -> Column:
    """`` | key: value, ...`` of a JSON object, in its order, less values that are null, false, zero or empty; an empty string
    for an empty object or none. Values show as JSON has them, but true as True and strings without quotes."""
    held = F.from_json(props, "map<string,string>")
    value = lambda e: F.coalesce(e["value"], F.lit(""))
    some = F.filter(F.map_entries(held), lambda e: ~value(e).rlike(r"^(|false|\[\]|\{\}|-?0+(\.0*)?([eE][-+]?[0-9]+)?)$"))
    each = F.transform(some, lambda e: F.concat(e["key"], F.lit(": "), F.when(value(e) == "true", "True").otherwise(value(e))))
    return F.when(F.size(held) > 0, F.concat(F.lit(" | "), F.array_join(each, ", "))).otherwise("")


def _sections(hints: Hints) -> Column:
    entity = F.transform("nodes", lambda n: F.concat(F.lit("- ["), n["node_type"], F.lit("] "), n["name"], F.lit(" (relevance: "), F.format_string("%.2f", n["score"]), F.lit(")"), shown_props(n["props"]), F.when(n["full_context"] != "", F.concat(F.lit(" — "), n["full_context"])).otherwise("")))
    relation = F.transform("edges", lambda e: F.concat(F.lit("- "), e["from_name"], F.when(e["edge_type"] != "", F.concat(F.lit(" ["), e["edge_type"], F.lit("]"))).otherwise(""), F.lit("→ "), e["to_name"], F.lit(" (strength: "), F.format_string("%.2f", e["weight"]), F.lit(")")))
    relations = F.when(F.size("edges") > 0, F.concat(F.lit("\nRelationships:\n"), F.array_join(relation, "\n"))).otherwise("")
    extra = "\nAdditional context:\n" + "\n".join(f"- {c}" for c in hints.extend_context) if hints.extend_context else ""
    return F.concat(F.lit("Entities (sorted by relevance):\n"), F.array_join(entity, "\n"), relations, F.lit(extra))


def prompt_rows(context: DataFrame, edges: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, query, nodes, edges): each query's ranked context and its named edges as arrays, bounded by top_n."""
    props = F.col("props") if "props" in nodes.columns else F.lit(None).cast("string")
    known = nodes.select(F.col("id").alias("node"), "name", "node_type", F.coalesce("full_context", F.lit("")).alias("full_context"), props.alias("props"))
    n = context.join(known, "node").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "name", "node_type", "score", "full_context", "props"))).alias("nodes"))
    e = edges.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "from_name", "to_name", "edge_type", "weight"))).alias("edges"))
    rows = queries.select("query_id", "query").join(n, "query_id", "left").join(e, "query_id", "left")
    kinds = {f.name: f.dataType for f in rows.schema}
    empty = lambda c: F.coalesce(c, F.array().cast(kinds[c])).alias(c)
    return rows.select("query_id", "query", empty("nodes"), empty("edges"))


def answer_prompt(hints: Hints = Hints()) -> Column:
    """The prompt for an answer, over the columns of ``prompt_rows``; null if there is no context."""
    rules = ANSWER_INSTRUCTIONS + "".join(f"\n- {r}" for r in hints.rules)
    text = F.concat(F.lit((hints.system_prompt or ANSWER_SYSTEM) + "\n\n" + ANSWER_LEAD + "\n\n"), _sections(hints), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\n\nInstructions:\n" + rules))
    return F.when(F.size("nodes") > 0, text)


def reason_prompt(iteration: int, max_iterations: int, hints: Hints = Hints()) -> Column:
    """The prompt for one round of reasoning; null if there is no context."""
    head = f"Reasoning iteration {iteration + 1} of {max_iterations}.{LAST_ITERATION if iteration >= max_iterations - 1 else ''}\n\n"
    return F.when(F.size("nodes") > 0, F.concat(F.lit(head), _sections(hints), F.lit("\n\nQuestion: "), F.col("query")))


def parse_reason(raw: Column) -> Column:
    """struct(answer, follow_ups, done) of a model's reply: fences stripped, five follow-ups at most; a reply that isn't
    JSON is the final answer."""
    text = trimmed(strip_fence(raw))
    got = F.from_json(text, "answer string, follow_ups array<string>, done boolean, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = got["_bad"].isNotNull() | ~text.startswith("{")
    follow = F.slice(F.filter(F.coalesce(got["follow_ups"], F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != ""), 1, MOST_FOLLOW_UPS)
    return F.struct(
        F.when(bad, text).otherwise(F.coalesce(got["answer"], F.lit(""))).alias("answer"),
        F.when(bad, F.array().cast("array<string>")).otherwise(follow).alias("follow_ups"),
        F.when(bad, True).otherwise(F.coalesce(got["done"], F.lit(True))).alias("done"),
    )


@dataclass(frozen=True)
class Reply:
    answer: str
    follow_ups: list[str]
    done: bool


def image_key(data_uri: Column) -> Column:
    """Content-addressed name of an image in a data URI: SHA-256 of its bytes, and an extension by type."""
    kind = F.lower(F.trim(F.regexp_extract(data_uri, "^data:([^;,]*)", 1)))
    ext = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    raw = F.unbase64(F.substring_index(data_uri, ",", -1))
    name = F.concat(F.sha2(raw, 256), F.coalesce(F.try_element_at(ext, kind), F.lit(".bin")))
    return F.when(F.octet_length(raw) > MOST_IMAGE_BYTES, F.raise_error(F.lit("an image has 50 MB at most"))).otherwise(name)


#: File extensions by image type.
EXTENSIONS = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp", "image/bmp": ".bmp", "image/tiff": ".tiff", "image/svg+xml": ".svg"}
#: Larger images are rejected.
MOST_IMAGE_BYTES = 50 * 1024 * 1024
