"""Batch jobs and settings."""

import base64
import hashlib
import json

from graphloom import config
from graphloom.operators import delta as log
from graphloom.operators.graph import Graph
from graphloom.operators.ingest import Resolution
from graphloom.operators.models import HashedWords
from graphloom.plans import jobs

DOC = json.dumps(
    {
        "entities": [{"id": "a", "name": "Ada", "type": "Person"}, {"id": "b", "name": "Babbage", "type": "Person"}, {"id": "c", "name": "Ada", "type": "Person"}],
        "relations": [{"from": "a", "to": "b", "type": "knows"}, {"from": "c", "to": "b", "type": "cites"}],
    }
)


def test_ingest_and_merge(spark, tmp_path):
    folder = str(tmp_path / "graph")
    assert jobs.ingest_file(spark, DOC, folder, HashedWords()) == 1
    store = log.SnapshotStore(spark, folder)
    base = store.load()
    assert base.nodes.count() == 3 and base.edges.where("embedding is not null").count() == 2
    more = json.dumps({"entities": [{"id": "x", "name": "Babbage", "type": "Person"}, {"id": "y", "name": "Lovelace", "type": "Person"}, {"id": "z", "name": "Lovelace", "type": "Person"}], "relations": [{"from": "x", "to": "z", "type": "knows"}]})
    delta, counts = jobs.ingest_json(spark, more, base, None, HashedWords(), cfg=Resolution(threshold=0.99))
    assert counts.first().asDict() == {"entities": 3, "new_nodes": 1, "resolved": 2, "relations": 1}
    assert [(r["src"], r["dst"]) for r in delta.edges.collect()] == [(1, 3)]
    assert jobs.merge_if_due(store, delta, 100) is None and jobs.merge_if_due(store, delta, 2) == 2
    assert sorted(r["name"] for r in store.load().nodes.collect()) == ["Ada", "Ada", "Babbage", "Lovelace"]
    assert jobs.ingest_text(spark, "nothing here", base, None, HashedWords()) == jobs.NOTHING
    added, counts = jobs.ingest_text(spark, "Turing met Church.", base, Graph(delta.nodes, delta.edges), HashedWords())
    assert counts.first()["new_nodes"] == 2 and sorted(r["id"] for r in added.nodes.collect()) == [4, 5]


def test_images(spark, tmp_path):
    raw = b"picture"
    uri = "data:image/png;base64," + base64.b64encode(raw).decode()
    rows = spark.createDataFrame([(1, uri), (2, uri), (3, "http://x/y.png"), (4, None)], "id long, image_url string")
    got = {r["id"]: r["image_url"] for r in jobs.store_images(rows, str(tmp_path / "images"), "http://images/").collect()}
    name = hashlib.sha256(raw).hexdigest() + ".png"
    assert got == {1: f"http://images/{name}", 2: f"http://images/{name}", 3: "http://x/y.png", 4: None}
    assert [(r["name"], bytes(r["bytes"])) for r in spark.read.parquet(str(tmp_path / "images")).collect()] == [(name, raw)]


def test_model_calls(spark):
    out = jobs.call_model(spark.createDataFrame([("a",), ("b",)], "q string"), "q", lambda texts: [t.upper() for t in texts], "answer")
    assert sorted(tuple(r) for r in out.collect()) == [("a", "A"), ("b", "B")]


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text("[query]\nk = 7\ndepth = 3\n[service]\nauto_store_images = true\n")
    got = config.load(str(f), {"GRAPHLOOM_QUERY_DEPTH": "4", "GRAPHLOOM_QUERY_TOP_N": "many", "GRAPHLOOM_SERVICE_INSTANCE": "999"})
    assert (got.query.k, got.query.depth, got.query.top_n, got.service.auto_store_images, got.service.instance) == (7, 4, 50, True, 0)
    assert got.query.options("relationship", k=1).bidirectional and got.ingest.resolution() == Resolution()
    f.write_text("not [toml")
    assert config.load(str(f), {}).query.k == 20
