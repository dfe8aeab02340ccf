"""Each stage of the pipeline on its own input, and the whole."""

import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest
from graphloom import session
from graphloom.llm import components, simhash

from .conftest import ROWS


def test_stages(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sample)
        assert out.columns == docs.columns, name
        before, after = {r["doc_id"]: r["text"] for r in kept.collect()}, out.collect()
        assert {r["doc_id"] for r in after} <= set(before)
        if name == "language ID":
            assert len(after) >= 0.95 * len(before) and all(before[r["doc_id"]] == r["text"] for r in after)
        if name == "SimHash near-dedup":
            sets = {i: simhash.shingles(t.encode(), 5) for i, t in before.items()}
            near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            left = {r["doc_id"] for r in after}
            pairs = [(a, b) for a in before for b in before if a < b and near(a, b)]
            gone = set(before) - left
            assert gone and all(any(i in p for p in pairs) for i in gone)  # whatever goes has a partner
            assert sum(not {a, b} <= left for a, b in pairs) >= 0.8 * len(pairs)  # and few pairs stay whole
        if name == "mixing":
            assert max(Counter(r["doc_id"] for r in after).values()) <= 2
        kept = spark.createDataFrame(after, docs.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, kept, sample)
    assert pieces.where("piece = 0").count() == kept.count()


def test_stages_take_odd_rows(spark, odd, sample):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, sample).count() > 0
        assert stage(spark, docs.limit(0), sample).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), sample).count() == 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, sample).count() <= len(ROWS)


def test_run(spark, sample):
    assert corpus_pipeline.run(spark, sample).count() > 0


@pytest.fixture
def uncoalesced(spark):
    """As many partitions as the tables are dealt to, however few their rows."""
    for key, value in (parts := {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}).items():
        parts[key] = spark.conf.get(key)
        spark.conf.set(key, value)
    yield 64
    for key, value in parts.items():
        spark.conf.set(key, value)


def test_small_tables_leave_few_files(spark, sample, uncoalesced, monkeypatch):
    """A local checkpoint folder costs a process for each file. Whatever the number of files, the rows are the same."""
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    files = lambda: {p for p in Path(session.checkpoint_dir(spark).removeprefix("file:")).glob("*/rdd-*/part-*")}
    for stage, most in ((corpus_pipeline.near_dedup, 2 * uncoalesced), (corpus_pipeline.mix_sources, uncoalesced), (corpus_pipeline.pack_sequences, uncoalesced)):
        before = files()
        few = Counter(r["doc_id"] for r in stage(spark, docs, sample).collect())
        assert few and len(files() - before) <= most, stage
        with monkeypatch.context() as m:
            m.setattr(session, "FEW_ROWS", -1)
            m.setattr(simhash, "FEW", -1)
            assert Counter(r["doc_id"] for r in stage(spark, docs, sample).collect()) == few


def test_links_settled_in_one_task_give_the_stars(spark):
    rnd = random.Random(5)
    for n in (0, 1, 300):
        rows = [(rnd.choice((-1, 1)) * rnd.randrange(1 << 62), 0) for _ in range(n)]
        rows = [(a, rnd.choice(rows[max(0, i - 3) : i + 1])[0]) for i, (a, _) in enumerate(rows)] + [(7, 9), (9, 7), (8, 8), (9, 11)][: 4 * n]
        edges = spark.createDataFrame(rows, "a long, b long").repartition(5)
        assert {*simhash._settled(edges).collect()} == {*components.stars(edges).collect()}
    kept, n = session.counted(edges)
    assert n == len(rows) and sorted(kept.collect()) == sorted(edges.collect()) and kept.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
