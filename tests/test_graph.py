"""Topology, traversal and scores on small graphs with values worked out by hand, and against a plain referee."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph as g
from graphloom.operators import scoring
from graphloom.operators.scoring import PRESETS, QueryOptions

FIVE = [(0, 1, 1.0), (0, 2, 0.5), (1, 3, 0.8), (2, 3, 1.0), (2, 4, 1.0), (3, 4, 1.0)]


def edges_of(spark, rows):
    return spark.createDataFrame([(i, a, b, "rel", float(w), i) for i, (a, b, w) in enumerate(rows)], "edge_id long, src long, dst long, edge_type string, weight double, ord long")


def nodes_of(spark, n):
    return spark.createDataFrame([(i, f"node_{i}", "Entity") for i in range(n)], "id long, name string, node_type string")


def seeds_of(spark, *ids):
    return spark.createDataFrame([(0, x, i) for i, x in enumerate(ids)], "query_id long, node long, ord long")


def traversed(spark, rows, seeds, depth, cap=500, both=False):
    out = g.bfs(g.conform(edges_of(spark, rows), g.EDGE_SCHEMA), seeds_of(spark, *seeds), depth, cap, both)
    return [(r["node"], r["hop"], r["path_weight"]) for r in sorted(out.collect(), key=lambda r: r["seq"])]


def referee(rows, seeds, depth, cap, both):
    seen, out = set(), []
    for s in seeds:
        if s not in seen:
            seen.add(s)
            out.append((s, 0, 1.0))
    at = 0
    while at < len(out):
        node, hop, _ = out[at]
        at += 1
        if hop >= depth:
            continue
        step = [(b, w) for a, b, w in rows if a == node] + ([(a, 1.0) for a, b, w in rows if b == node] if both else [])
        for other, w in step:
            if other not in seen:
                seen.add(other)
                out.append((other, hop + 1, w))
                if len(out) >= cap:
                    return out
    return out


def test_neighbours(spark):
    e = g.conform(edges_of(spark, FIVE), g.EDGE_SCHEMA)
    out = lambda n, **k: [r["node"] for r in g.neighbours(e, n, **k).collect()]
    assert (out(0), out(2), out(4), out(99)) == ([1, 2], [3, 4], [], [])
    assert out(4, reverse=True) == [2, 3]


def test_depths(spark):
    assert traversed(spark, FIVE, [0], 0) == [(0, 0, 1.0)]
    assert traversed(spark, FIVE, [0], 1) == [(0, 0, 1.0), (1, 1, 1.0), (2, 1, 0.5)]
    assert {n for n, _, _ in traversed(spark, FIVE, [0], 2)} == {0, 1, 2, 3, 4}
    assert len(traversed(spark, FIVE, [0], 2, 2)) == 2
    assert traversed(spark, FIVE, [4], 1) == [(4, 0, 1.0)]
    assert {n for n, _, _ in traversed(spark, FIVE, [4], 1, both=True)} == {4, 2, 3}


@pytest.mark.parametrize("seed", range(4))
def test_traversal_equals_referee(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(9), rng.randrange(9), round(rng.random(), 3)) for _ in range(24)]  # loops and parallels too
    seeds, depth, cap, both = [rng.randrange(9) for _ in range(3)], rng.randrange(4), rng.choice([1, 4, 6, 100]), seed % 2 == 1
    assert traversed(spark, rows, seeds, depth, cap, both) == referee(rows, seeds, depth, cap, both)


def test_weights(spark):
    built = g.build(nodes_of(spark, 6), edges_of(spark, FIVE))
    w = {r["id"]: r["weight"] for r in built.nodes.collect()}
    assert w == {0: 2 / 3, 1: 2 / 3, 2: 1.0, 3: 1.0, 4: 2 / 3, 5: 0.0}
    lone = g.build(nodes_of(spark, 2), edges_of(spark, [(0, 0, 1.0)]).where("false"))
    assert [r["weight"] for r in lone.nodes.collect()] == [0.0, 0.0]


def test_edges_between_keeps_heaviest(spark):
    e = g.conform(edges_of(spark, [(0, 1, 0.2), (0, 1, 0.9), (0, 1, 0.9), (1, 5, 1.0)]), g.EDGE_SCHEMA).withColumn("edge_type", F.concat(F.lit("t"), "ord"))
    ids = spark.createDataFrame([(0,), (1,)], "node long")
    assert [tuple(r) for r in g.edges_between(e, ids).collect()] == [(0, 1, 0.9, "t1")]


def test_scores(spark):
    for w in PRESETS.values():
        assert abs(w.alpha + w.beta + w.gamma - 1) < 1e-9
    assert QueryOptions.of_mode("relationship").bidirectional and not QueryOptions.of_mode("unheard of").bidirectional
    built = g.build(nodes_of(spark, 5), edges_of(spark, FIVE))
    seeds = spark.createDataFrame([(0, 0, 0, 1.0), (0, 77, 1, 0.5)], "query_id long, node long, ord long, seed_sim double")
    sub = g.bfs(built.edges, seeds, 1)
    rows = {r["node"]: r for r in scoring.score(sub, built.nodes, seeds, PRESETS["balanced"]).collect()}
    assert 77 not in rows  # unknown to the graph
    assert abs(rows[0]["score"] - (0.5 + 0.3 + 0.2 * 2 / 3)) < 1e-12 and rows[0]["is_seed"]
    assert abs(rows[2]["score"] - (0.3 * 0.5 / 2 + 0.2)) < 1e-12 and not rows[2]["is_seed"]
    top = scoring.context(scoring.score(sub, built.nodes, seeds, PRESETS["balanced"]), 1, 0.0).collect()
    assert [r["node"] for r in top] == [0]
