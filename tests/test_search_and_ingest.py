"""Vectors, search, resolution, payloads, logs, exchange, models and the engine."""

import json
import math

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from graphloom.errors import BadRequest, GraphloomError, NotFound, ValidationFailed
from graphloom.functions import vectors
from graphloom.functions.text import fnv1a, model_parts
from graphloom.operators import delta as log
from graphloom.operators import graph as g
from graphloom.operators import ingest, lookup, models, search
from graphloom.operators.engine import Engine, respond, ResultCache
from graphloom.operators.ingest import Resolution
from graphloom.operators.models import HashedWords, Hints, Reply
from graphloom.operators.scoring import QueryOptions
from graphloom.sources import exchange, payload

FIVE = json.dumps(
    {
        "entities": [
            {"id": "e1", "name": " Alice ", "type": "Person", "props": {"role": "CEO"}},
            {"id": "e2", "name": "Bob", "type": "Person", "embed_context": " ", "image_url": ""},
            {"id": "e3", "name": "Acme Corp", "type": " "},
        ],
        "relations": [
            {"from": "e1", "to": "e3", "type": "leads", "weight": 0.5},
            {"from": "e2", "to": "e3", "type": "works_at"},
            {"from": "e2", "to": "GHOST", "type": "knows", "weight": 1.0},
        ],
    }
)


def basis(i, dim=8):
    return [1.0 if j == i else 0.0 for j in range(dim)]


def test_vector_expressions(spark):
    rows = [([3.0, 4.0], [3.0, 4.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0], [-1.0, 5.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    got = [tuple(r) for r in df.select(vectors.dot("a", "b"), vectors.norm("a"), vectors.normalise("a"), vectors.is_degenerate("a")).collect()]
    assert [x[0] for x in got] == [25.0, 0.0, -1.0, 0.0, 0.0]
    assert got[0][1:3] == (5.0, [0.6, 0.8]) and got[3][2] == [0.0, 0.0] and got[3][3]


def sine(n, dim):
    m = np.sin(np.arange(n * dim).reshape(n, dim) * 0.1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_search_is_exact_for_few_and_many_queries(spark, monkeypatch):
    m = sine(120, 16)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)] + [(500, None)], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(0, 120, 7)], "query_id long, vector array<double>")
    want = {(i, r): None for i in range(0, 120, 7) for r in range(1, 6)}
    sims = m @ m.T
    order = {i: sorted(range(120), key=lambda j: (-round(sims[i][j], 12), j))[:5] for i in range(0, 120, 7)}
    few = {(r["query_id"], r["rank"]): r["sim"] for r in search.topk(v, q, 5).collect()}
    monkeypatch.setattr(search, "FEW_QUERIES", 3)
    monkeypatch.setattr(search, "BLOCK_ROWS", 50)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 6)
    many = {(r["query_id"], r["rank"]): r["sim"] for r in search.topk(v, q, 5).collect()}
    assert few.keys() == many.keys() == want.keys()
    for (i, r), s in few.items():
        assert abs(s - sims[i][order[i][r - 1]]) < 1e-9 and abs(many[i, r] - s) < 1e-12
    assert search.topk(v.limit(0), q, 5).count() == 0 and search.topk(v, q, 0).count() == 0


def test_ann_recall(spark):
    m = sine(200, 32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    q = spark.createDataFrame([(i, m[i].tolist()) for i in (0, 17, 42, 88)], "query_id long, vector array<double>")
    assert search.recall(search.lsh_topk(v, q, 10), search.topk(v, q, 10), 10).first()["recall"] >= 0.8


def test_payload(spark):
    nodes, edges = payload.read_payload(spark, FIVE)
    n = {r["pos"]: r for r in nodes.collect()}
    assert (n[0]["name"], n[0]["props"], n[2]["node_type"], n[1]["embed_context"], n[1]["image_url"]) == ("Alice", '{"role":"CEO"}', "Entity", None, None)
    assert sorted((r["from_pos"], r["to_pos"], r["weight"]) for r in edges.collect()) == [(0, 2, 0.5), (1, 2, 1.0)]
    with pytest.raises(PySparkException, match="entities and relations"):
        payload.read_payload(spark, '{"entities": []}')[0].collect()
    twice = json.dumps({"entities": [{"id": "a", "name": "x"}, {"id": "a", "name": "y"}], "relations": [{"from": "a", "to": "a", "type": "self"}]})
    assert [(r["from_pos"], r["to_pos"]) for r in payload.read_payload(spark, twice)[1].collect()] == [(1, 1)]


KNOWN = [(0, "Alice", "Person"), (1, "Bob", "Person"), (2, "Acme", "Company"), (3, "Widget", "Product")]


def test_resolution(spark):
    base = spark.createDataFrame([(i, t, basis(i)) for i, _, t in KNOWN], "id long, node_type string, embedding array<double>")
    layer = spark.createDataFrame([(9, "Person", basis(5))], "id long, node_type string, embedding array<double>")
    new = spark.createDataFrame([(0, "Company", basis(0)), (1, "Person", basis(6)), (2, "Person", basis(5)), (3, "person", basis(1))], "pos long, type string, embedding array<double>")
    got = lambda cfg, d=None: [(r["resolved_id"], r["layer"]) for r in sorted(ingest.resolve(new, base, d, cfg).collect(), key=lambda r: r["pos"])]
    assert got(Resolution("none")) == [(None, None)] * 4
    assert got(Resolution()) == [(0, "base"), (None, None), (None, None), (1, "base")]
    assert got(Resolution(match_type=True), layer) == [(None, None), (None, None), (9, "delta"), (1, "base")]


def test_batch_leaders_are_first_matches(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((60, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    lead, leaders = [], []
    for i in range(60):
        hit = next((j for j in leaders if m[i] @ m[j] >= 0.7), None)
        if hit is None:
            leaders.append(i)
        lead.append(i if hit is None else hit)
    new = spark.createDataFrame([(i, "x", x.tolist()) for i, x in enumerate(m)], "pos long, type string, embedding array<double>")
    got = {r["pos"]: r["leader_pos"] for r in ingest.resolve_in_batch(new, Resolution(threshold=0.7)).collect()}
    assert [got[i] for i in range(60)] == lead and len(leaders) < 60


def test_ids(spark):
    rows = spark.range(10).withColumnRenamed("id", "pos")
    assert [r["id"] for r in ingest.allocate_ids(rows, 2, 5, ["pos"]).orderBy("pos").collect()] == list(range(2 << 24, (2 << 24) + 10))
    with pytest.raises(GraphloomError):
        ingest.allocate_ids(rows, 0, (1 << 24) - 5, ["pos"])


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def test_log(spark):
    texts = ["", "a", "Grüße 東京", "x" * 300]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fnv1a(F.col("t"))).collect()] == [fnv(t) for t in texts]
    good = json.dumps({"op": "add_node", "id": 7, "name": "n"})
    edge = json.dumps({"op": "add_edge", "src": 7, "dst": 8, "edge_type": "t", "weight": 0.5})
    lines = [f"{fnv(good):08x}|{good}", "", f"{fnv(good) ^ 1:08x}|{good}", good, f"{fnv(edge):08x}|{edge}", f"{fnv('{'):08x}|" + "{", json.dumps({"op": "other"})]
    nodes, edges, counts = log.replay(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["id"] for r in nodes.collect()] == [7, 7] and [(r["src"], r["dst"]) for r in edges.collect()] == [(7, 8)]
    assert counts.first()["entries"] == 3


def small(spark, n=4, first=0):
    nodes = spark.createDataFrame([(i, f"n{i}", "T", f"T:n{i}", basis(i % 8)) for i in range(first, first + n)], "id long, name string, node_type string, external_id string, embedding array<float>")
    edges = spark.createDataFrame([(i, i, i + 1, "next", 1.0, i) for i in range(first, first + n - 1)], "edge_id long, src long, dst long, edge_type string, weight double, ord long")
    return g.build(nodes, edges)


def test_merge_equals_build(spark, tmp_path):
    base, delta = small(spark), small(spark, 3, 1 << 24)
    merged = log.merge(base, delta)
    assert [r["id"] for r in merged.nodes.orderBy("id").collect()] == list(range(7))
    assert sorted((r["edge_id"], r["src"], r["dst"]) for r in merged.edges.collect()) == [(0, 0, 1), (1, 1, 2), (2, 2, 3), (3, 4, 5), (4, 5, 6)]
    store = log.SnapshotStore(spark, str(tmp_path / "graph"))
    assert store.versions() == [] and store.save(base) == 1 and store.save(merged) == 2
    assert store.load().nodes.count() == 7 and store.load(1).edges.count() == 3
    assert log.needs_merge(delta, 5).first().asDict() == {"delta_size": 5, "needs_merge": True}


def test_exchange_round_trip(spark, tmp_path):
    graph = small(spark)
    path = str(tmp_path / "lines")
    exchange.write_ndjson(exchange.ndjson(graph), path)
    nodes, edges = exchange.read_upload(spark, path)
    assert nodes.count() == 4 and sorted((r["from"], r["to"]) for r in edges.collect()) == [("n0", "n1"), ("n1", "n2"), ("n2", "n3")]
    doc = str(tmp_path / "doc")
    exchange.export_json(graph).write.text(doc)
    assert exchange.read_upload(spark, doc)[1].count() == 3
    new, linked, counts = exchange.import_graph(small(spark, 2), nodes, edges, 100)
    assert counts.first().asDict() == {"imported_nodes": 2, "imported_edges": 3, "skipped_edges": 0}
    assert [r["id"] for r in new.orderBy("id").collect()] == [100, 101] and linked.count() == 3
    with pytest.raises((PySparkException, Py4JJavaError)):
        exchange.parse_ndjson(spark.createDataFrame([("{bad",)], "value string"))[0].collect()
    raw = str(tmp_path / "v.bin")
    m = sine(5, 3).astype("f4")
    with open(raw, "wb") as f:
        f.write(exchange.vector_bytes(m))
    assert np.allclose([r["embedding"] for r in exchange.read_vectors(spark, raw).orderBy("id").collect()], m)


def test_lookups(spark):
    base, delta = small(spark), small(spark, 2, 50)
    assert lookup.get_node(base, 51, delta).first()["name"] == "n51" and lookup.get_node(base, 99, delta).isEmpty()
    assert [r["id"] for r in lookup.search_nodes(base, delta, text="N", limit=5).collect()] == [0, 1, 2, 3, 50]
    assert [r["id"] for r in lookup.related_nodes(base, 1, direction="both").collect()] == [2, 0]
    with pytest.raises(NotFound):
        lookup.related_nodes(base, 50)
    with pytest.raises(BadRequest):
        lookup.search_edges(base)
    with pytest.raises(NotFound):
        lookup.search_edges(base, src=99)
    assert lookup.search_edges(base, src=99, dst=0).isEmpty()
    assert [(r["from_name"], r["to_name"]) for r in lookup.search_edges(base, delta, edge_type="NEXT", limit=4).collect()] == [("n0", "n1"), ("n1", "n2"), ("n2", "n3"), ("n50", "n51")]


def test_replies(spark):
    raws = ['```json\n{"answer": "a", "follow_ups": ["1","2","3","4","5","6"], "done": false}\n```', "no json", '{"answer": "b"}', "{broken"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raws], "r string").select(models.parse_reason(F.col("r"))).collect()]
    assert (got[0]["answer"], got[0]["follow_ups"], got[0]["done"]) == ("a", list("12345"), False)
    assert (got[1]["answer"], got[1]["done"]) == ("no json", True)
    assert (got[2]["answer"], list(got[2]["follow_ups"]), got[2]["done"]) == ("b", [], True)
    assert (got[3]["answer"], got[3]["done"]) == ("{broken", True)
    p, m = model_parts(F.lit("gemini/a/b"))
    assert spark.range(1).select(p, m).first()[:2] == ("google", "a/b")


def test_engine(spark):
    graph = small(spark, 6)
    e = Engine(graph, lambda texts: np.array([basis(0)] * len(texts)), generator=lambda p: p)
    found = e.query_text("q", QueryOptions(min_score=0.0, k=2, depth=1))
    scores = [r["score"] for r in found.nodes.orderBy("rank").collect()]
    assert scores == sorted(scores, reverse=True) and "Question: q" in found.answer and "- [T] n0 (relevance: " in found.answer
    assert e.query_text("q ", QueryOptions(min_score=0.0, k=2, depth=1)).cache_hit
    assert not e.query_text("q", QueryOptions(min_score=0.0, k=2, depth=1), Hints(rules=["r"])).cache_hit
    deeper = e.query_node(0, QueryOptions(depth=3)).nodes.count()
    assert deeper == 4 and e.query_node(0, QueryOptions(depth=1)).nodes.count() == 2
    with pytest.raises(NotFound):
        e.query_node(77)
    with pytest.raises(ValidationFailed):
        e.query_vector([])
    with pytest.raises(ValidationFailed):
        ResultCache.key("q", QueryOptions(min_score=math.nan))


def test_profiles_timings_and_swap(spark):
    graph, options = small(spark, 6), QueryOptions(min_score=0.0, k=2, depth=1)
    e = Engine(graph, lambda texts: np.array([basis(0)] * len(texts)), generator=lambda p: "said", cache=ResultCache(1, 60.0))
    found = e.query_text("q", options)
    assert set(found.timings) == {"search_ms", "bfs_ms", "score_ms", "llm_ms", "embed_ms", "total_ms"}
    assert found.timings["total_ms"] >= found.timings["search_ms"] + found.timings["bfs_ms"]
    assert set(respond(found, "minimal")) == {"answer", "total_ms", "cache_hit"}
    standard, full = respond(found), respond(found, "full")
    assert "edges" not in standard and standard["answer"] == "said" and standard["context_nodes"] == len(standard["nodes"]) > 0
    assert len(full["edges"]) == found.edges.count() and {"search_ms", "bfs_ms", "score_ms"} <= set(full)
    with pytest.raises(ValidationFailed):
        respond(found, "huge")
    again = e.query_text("q", options)
    assert again.cache_hit and respond(again, "minimal")["cache_hit"]
    e.swap(small(spark, 3))
    assert not e.query_text("q", options).cache_hit and e.graph.nodes.count() == 3


def test_multihop_ends(spark):
    graph = small(spark, 6)
    nodes = models.embed(graph.nodes.drop("embedding"), "name", HashedWords())
    asked = []

    def reason(prompt, i, most):
        asked.append(i)
        return Reply("end", [], True) if i == 2 else Reply("", [f"n{i + 3}"], False)

    e = Engine(g.Graph(nodes, graph.edges), HashedWords(), reasoner=reason)
    found = e.query_multihop("n0", QueryOptions(k=1, depth=0, min_score=0.0), 3)
    assert found.answer == "end" and asked == [0, 1, 2]
    assert {r["node"] for r in found.nodes.collect()} == {0, 3, 4}
    e.reasoner = lambda p, i, n: Reply("", ["nobody at all"], False)
    e.generator = lambda p: "generated"
    assert e.query_multihop("n0", QueryOptions(k=1, depth=0, min_score=0.0)).answer == "generated"


def test_extract_drops_dangling(spark):
    rows = spark.createDataFrame([(1, "Alice met Bob. Carol slept."), (2, None)], "id long, t string")
    got = {r["id"]: r for r in models.extract(rows, "id", "t").collect()}
    assert [e["name"] for e in got[1]["entities"]] == ["Alice", "Bob", "Carol"] and len(got[1]["relations"]) == 1 and got[2]["entities"] == []
    dangling = models.extract(rows, "id", "t", lambda t: ([{"id": "a", "name": "a", "type": "x"}], [{"from": "a", "to": "b", "type": "x", "weight": 1.0}]))
    assert all(r["relations"] == [] for r in dangling.collect())
