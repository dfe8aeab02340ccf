"""Vectors that meet in blocks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.sql import functions as F

from graphloom.functions.vectors import normalise
from graphloom.operators import blocks, ingest, search
from graphloom.plans import graphs, queries_vector


def table(spark, m, **more):
    rows = [(i, None if x is None else [float(y) for y in x], *(c[i] for c in more.values())) for i, x in enumerate(m)]
    return spark.createDataFrame(rows, ", ".join(["id long, embedding array<double>", *(f"{c} string" for c in more)]))


def asked(v):
    return v.withColumnRenamed("id", "query_id").withColumnRenamed("embedding", "vector")


def unit(n, dim, seed=1):
    m = np.random.default_rng(seed).standard_normal((n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def many(monkeypatch):
    """Small blocks, and so many tasks as there are queries for."""
    for module, name, value in ((search, "FEW_QUERIES", 3), (search, "BLOCK_QUERIES", 16), (search, "BLOCK_ROWS", 20), (blocks, "CHUNK_ROWS", 20), (blocks, "BLOCK_ROWS", 32), (blocks, "TASK_CELLS", 1 << 8), (blocks, "STEP_ROWS", 7), (blocks, "STEP_COLUMNS", 9)):
        monkeypatch.setattr(module, name, value)


@pytest.mark.parametrize("blocked", [False, True])
def test_lsh_candidates_are_compared_where_they_meet(spark, monkeypatch, blocked):
    def no_join(*_, **__):
        raise AssertionError("a row for each table and pair")

    monkeypatch.setattr(BucketedRandomProjectionLSHModel, "approxSimilarityJoin", no_join)
    if blocked:
        many(monkeypatch)
    m = unit(120, 8)
    m[5] = m[50] = m[17]
    v = table(spark, [*m, None])
    q = asked(v.where("id % 3 = 0"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.lsh_topk(v, q, 4, tables=2, bucket=0.4, max_distance=0.8).collect()}
    f = table(spark, m).select("id", search.array_to_vector("embedding").alias("f"))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=0.4, numHashTables=2, seed=5).fit(f)
    h = np.array([[x[0] for x in r["h"]] for r in model.transform(f).orderBy("id").collect()])
    want = {}
    for i in range(0, 120, 3):
        near = [j for j in range(120) if (h[i] == h[j]).any() and np.linalg.norm(m[i] - m[j]) < 0.8]
        for k, j in enumerate(sorted(near, key=lambda j: (-round(float(m[i] @ m[j]), 12), j))[:4], 1):
            want[i, k] = j
    assert got == want and len(want) < 160


def test_a_norm_is_computed_once_for_a_vector(spark):
    df = spark.range(3).select(F.array(F.col("id").cast("double"), F.lit(4.0)).alias("v")).select(normalise("v").alias("u"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [r["u"] for r in df.orderBy("u").collect()][0] == [0.0, 1.0]


def test_many_queries_are_exact_beside_many_equal_vectors(spark, monkeypatch):
    many(monkeypatch)
    m = unit(150, 6)
    m[40:100] = m[3]
    rows = [*m, None, [], [float("nan")] * 6]
    v = table(spark, rows)
    got = {}
    for r in search.topk(v, asked(v.where("id < 150")), 5).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    sims = np.einsum("id,jd->ij", m, m)
    for i in range(150):  # no number is larger than any, as in SQL, and the empty vector has similarity 0
        like = [*((-round(float(sims[i, j]), 12), j) for j in range(150)), (0.0, 151), (-9.0, 152)]
        assert got[i] == [j for _, j in sorted(like)[:5]]


def test_a_task_keeps_few_of_many_equal_hits():
    best = blocks.Best(np.arange(50), np.ones((50, 4)), 3)
    for a in range(0, 400_000, 20_000):
        best.see(np.arange(a, a + 20_000)[::-1], np.ones((20_000, 4)))
        assert sum(len(x[0]) for x in best.kept) < 1_000_000
    found = pa.Table.from_batches(best.found()).to_pydict()
    assert found["id"] == [0, 1, 2] * 50 and set(found["sim"]) == {4.0}


def test_a_graph_looks_for_neighbours_once(spark, tmp_path):
    v = table(spark, unit(30, 4)).withColumnRenamed("id", "vec_id").withColumn("label", F.lit(1))
    v.write.parquet(f"{tmp_path}/embeddings.parquet")
    g = graphs._vector_graph(spark, str(tmp_path))
    for df in (g.nodes, g.edges):
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert g.edges.count() == 150


@pytest.mark.parametrize(("few", "typed"), [(0, False), (3, True), (1 << 20, False)])
def test_a_batch_is_resolved_without_a_row_for_each_pair(spark, monkeypatch, few, typed):
    stored, whole = [], ingest._by_pairs
    monkeypatch.setattr(ingest, "PEEL", 20)
    monkeypatch.setattr(ingest, "FEW_SIMILAR", few)
    monkeypatch.setattr(ingest, "_by_pairs", lambda rest, t: stored.append(rest.count()) or whole(rest, t))
    m = unit(200, 4, 5)
    m[60:120] = m[30]
    kinds = ["a" if i % 3 else "B" if i % 2 else None for i in range(200)]
    lead, leaders = [], []
    for i in range(200):
        like = lambda j: m[i] @ m[j] >= 0.7 and (not typed or kinds[i] == kinds[j] is not None)
        lead.append(next((j for j in leaders if like(j)), i))
        leaders += [i] if lead[i] == i else []
    new = table(spark, m, type=kinds).withColumnRenamed("id", "pos")
    got = {r["pos"]: r["leader_pos"] for r in ingest.resolve_in_batch(new, ingest.Resolution(threshold=0.7, match_type=typed)).collect()}
    assert [got[i] for i in range(200)] == lead
    assert stored == ([200] if few > 200 else []) or few == 3 and stored[0] < 200


def test_pairs_of_a_label_meet_in_blocks_and_not_in_a_join(spark, tmp_path):
    m = unit(40, 4, 2)
    rows = [(i, x.tolist(), None if i == 7 else i % 2) for i, x in enumerate(m)] + [(99, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries_vector.cosine_pairs_topk(spark, str(tmp_path))
    assert "Generate explode" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "embedding" not in plan.split("MapInArrow")[0]
    f = m.astype(np.float32).astype(float)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if i % 2 == j % 2 and 7 not in (i, j) and f[i] @ f[j] >= 0.3}
    assert {(r["a"], r["b"]) for r in got.collect()} == want
