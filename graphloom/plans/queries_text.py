"""Prompts, replies, and the stand-in models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import model_parts, strip_fence
from graphloom.functions.vectors import norm
from graphloom.operators import models
from graphloom.operators.engine import Engine
from graphloom.operators.models import ANSWER_INSTRUCTIONS, ANSWER_LEAD, ANSWER_SYSTEM, LAST_ITERATION, HashedWords, Hints, Reply
from graphloom.plans.graphs import table, vector_graph
from graphloom.plans.queries_graph import FULL
from graphloom.plans.queries_vector import one_query
from graphloom.plans.registered import query, r6

QUESTION = "Which vectors are close?"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SECTIONS = """
pe AS (SELECT string_agg('- [' || node_type || '] ' || name || ' (relevance: ' || printf('%.2f', score) || ') | ' || CASE WHEN node_type = 'label_0' THEN '' ELSE 'label: ' || substr(node_type, 7) END || ' — ' || full_context, chr(10) ORDER BY rank) AS entities FROM top JOIN nodes ON id = node),
pr AS (SELECT string_agg('- vec_' || src || ' [' || edge_type || ']→ vec_' || dst || ' (strength: ' || printf('%.2f', weight) || ')', chr(10) ORDER BY src, dst) AS relations FROM between)"""
BODY = "'Entities (sorted by relevance):' || chr(10) || entities || coalesce(chr(10) || 'Relationships:' || chr(10) || relations, '')"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    v = vector_graph(spark, d)
    found = Engine(v).query_vectors(one_query(v.nodes))
    asked = spark.createDataFrame([(0, QUESTION)], "query_id long, query string")
    return models.prompt_rows(found.nodes, found.edges, v.nodes, asked)


@query(f"WITH {FULL}, {SECTIONS} SELECT {_text(ANSWER_SYSTEM + chr(10) * 2 + ANSWER_LEAD + chr(10) * 2)} || {BODY} || {_text(chr(10) * 2 + 'Question: ' + QUESTION + chr(10) * 2 + 'Instructions:' + chr(10) + ANSWER_INSTRUCTIONS + chr(10) + '- Be kind.')} AS prompt FROM pe, pr")
def prompt_generate(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select(models.answer_prompt(Hints(rules=["Be kind."])).alias("prompt"))


@query(f"WITH {FULL}, {SECTIONS} SELECT {_text('Reasoning iteration 3 of 3.' + LAST_ITERATION + chr(10) * 2)} || {BODY} || {_text(chr(10) + 'Additional context:' + chr(10) + '- more' + chr(10) * 2 + 'Question: ' + QUESTION)} AS prompt FROM pe, pr")
def prompt_reason(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select(models.reason_prompt(2, 3, Hints(extend_context=["more"])).alias("prompt"))


FENCE = "```"
PROPS = """CASE n_nationkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '{}' WHEN 2 THEN '{"name": "' || n_name || '", "rank": ' || n_nationkey || ', "none": null, "zero": 0, "no": false}'
    WHEN 3 THEN '{"zero": 0.0, "blank": ""}' ELSE '{"yes": true, "share": 0.5, "list": [1, 2], "empty": []}' END"""


@query("""SELECT n_nationkey, CASE n_nationkey % 5 WHEN 2 THEN ' | name: ' || n_name || ', rank: ' || n_nationkey WHEN 3 THEN ' | ' WHEN 4 THEN ' | yes: True, share: 0.5, list: [1,2]' ELSE '' END AS shown FROM nation""")
def prompt_props(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.expr(PROPS).alias("props"))
    return n.select("n_nationkey", models.shown_props(F.col("props")).alias("shown"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN NULL ELSE 'a:' || n_name END AS names, CASE n_nationkey % 3 WHEN 0 THEN 'a>b' WHEN 1 THEN '' END AS kept FROM nation""")
def extract_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies in a fence with a good and a dangling relation, without relations, and ones that are no JSON."""
    k = F.col("n_nationkey")
    full = F.concat(F.lit(FENCE + 'json\n{"entities": [{"id": "a", "name": "a:'), "n_name", F.lit('", "type": "N"}, {"id": "b", "type": "N"}], "relations": [{"from": "a", "to": "b"}, {"from": "a", "to": "z"}]}\n' + FENCE))
    bare = F.concat(F.lit('{"entities": [{"id": "a", "name": "a:'), "n_name", F.lit('"}]}'))
    n = table(spark, d, "nation").select("n_nationkey", models.parse_extract(F.when(k % 3 == 0, full).when(k % 3 == 1, bare).otherwise("sorry")).alias("x"))
    return n.select("n_nationkey", F.array_join("x.entities.name", ",").alias("names"), F.array_join(F.transform("x.relations", lambda r: F.concat_ws(">", r["from"], r["to"])), ",").alias("kept"))



def _replies(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    doc = F.concat(F.lit('{"answer": "'), "n_name", F.lit('", "follow_ups": ["a", "b", "c", "d", "", "e", "f"], "done": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("}"))
    raw = F.when(k % 4 == 0, F.concat(F.lit(f"{FENCE}json\n"), doc, F.lit(f"\n{FENCE}"))).when(k % 4 == 1, doc).when(k % 4 == 2, F.concat(F.lit("just "), "n_name")).otherwise(F.concat(F.lit(f"{FENCE}\n"), doc, F.lit(f"\n{FENCE}")))
    return n.select("n_nationkey", raw.alias("raw"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 2 THEN 'just ' || n_name ELSE n_name END AS answer, CASE WHEN n_nationkey % 4 = 2 THEN '' ELSE 'a,b,c,d,e' END AS follow_ups,
    CASE WHEN n_nationkey % 4 = 2 THEN true ELSE n_nationkey % 2 = 0 END AS done FROM nation""")
def fence_strip_parse(spark: SparkSession, d: str) -> DataFrame:
    r = _replies(spark, d).select("n_nationkey", models.parse_reason(F.col("raw")).alias("x"))
    return r.select("n_nationkey", "x.answer", F.array_join("x.follow_ups", ",").alias("follow_ups"), "x.done")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'google' ELSE 'openai' END AS provider, 'm/' || n_name AS model FROM nation")
def model_strings(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.when(F.col("n_nationkey") % 2 == 0, "gemini/m/").otherwise("openai/m/"), "n_name").alias("m"))
    provider, name = model_parts(F.col("m"))
    return n.select("n_nationkey", provider.alias("provider"), name.alias("model"))


@query("SELECT n_nationkey, n_name AS inner_text FROM nation")
def fence_strip(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit(f"{FENCE}json"), "n_name", F.lit(FENCE)).alias("x"))
    return n.select("n_nationkey", strip_fence(F.col("x")).alias("inner_text"))


@query("SELECT n_regionkey AS id, count(*) AS n_entities, count(*) * 2 - 1 AS n_relations FROM nation GROUP BY 1")
def relations_filter(spark: SparkSession, d: str) -> DataFrame:
    """A chain of relations, a loop on the last entity, and for each entity one to an unknown end."""
    n = table(spark, d, "nation")
    ent = n.groupBy(F.col("n_regionkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("id")))).alias("entities"))
    ids = F.transform("entities", lambda e: e["id"])
    chain = F.transform("entities", lambda e, i: F.struct(e["id"].alias("from"), F.coalesce(F.get(ids, i + 1), F.lit("nowhere")).alias("to")))
    loops = F.transform("entities", lambda e: F.struct(e["id"].alias("from"), e["id"].alias("to")))
    rows = ent.withColumn("relations", F.concat(chain, loops))
    kept = rows.select("id", "entities", models.known_relations(F.col("entities"), F.col("relations")).alias("relations"))
    return kept.select("id", F.size("entities").cast("long").alias("n_entities"), F.size("relations").cast("long").alias("n_relations"))


@query("SELECT n_nationkey, sha256(n_name) || '.png' AS key FROM nation")
def image_keys(spark: SparkSession, d: str) -> DataFrame:
    uri = F.concat(F.lit("data:image/png;base64,"), F.base64(F.col("n_name").cast("binary")))
    return table(spark, d, "nation").select("n_nationkey", models.image_key(uri).alias("key"))


@query()
def embed_stub(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    e = models.embed(docs, "text", HashedWords())
    return e.select("doc_id", F.size("embedding").alias("dim"), F.round(norm("embedding"), 4).alias("norm"))


@query()
def extract_stub(spark: SparkSession, d: str) -> DataFrame:
    found = models.extract(table(spark, d, "documents"), "doc_id", "text")
    return found.select("id", F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations"))


def _text_engine(spark: SparkSession, d: str) -> Engine:
    g = vector_graph(spark, d)
    nodes = models.embed(g.nodes.drop("embedding"), "full_context", HashedWords())
    return Engine(type(g)(nodes, g.edges.withColumn("embedding", F.lit(None).cast("array<float>"))), HashedWords(), generator=lambda p: f"{len(p)} characters")


@query()
def text_query_stub(spark: SparkSession, d: str) -> DataFrame:
    return _text_engine(spark, d).query_text("vector 12 of label 6").nodes.select("node", "rank", r6("score").alias("score"))


@query()
def multihop_stub(spark: SparkSession, d: str) -> DataFrame:
    e = _text_engine(spark, d)
    e.reasoner = lambda prompt, i, n: Reply("done", [], True) if i >= 2 else Reply("", [f"vec_{20 + i}"], False)
    return e.query_multihop("vector 12 of label 6").nodes.select("node", "rank", r6("score").alias("score"))
