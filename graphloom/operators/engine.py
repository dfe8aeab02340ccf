"""Retrieval end to end: search, traversal, scoring, context, and the models' answers."""

from __future__ import annotations

import functools
import hashlib
import json
import math
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import ModelUnavailable, NotFound, ValidationFailed
from graphloom.functions.vectors import normalise
from graphloom.operators import graph as g
from graphloom.operators import models, scoring, search
from graphloom.operators.models import Embedder, Hints, Reply
from graphloom.operators.scoring import QueryOptions
from graphloom.session import cut

#: Columns of an answer by profile.
PROFILES = {
    "minimal": ["answer", "total_ms", "cache_hit"],
    "standard": ["answer", "nodes", "total_ms", "cache_hit", "seed_nodes", "subgraph_nodes", "context_nodes", "embed_ms", "llm_ms"],
    "full": ["answer", "nodes", "edges", "total_ms", "cache_hit", "seed_nodes", "subgraph_nodes", "context_nodes", "embed_ms", "search_ms", "bfs_ms", "score_ms", "llm_ms"],
}
MODES = ("balanced", "semantic", "relationship", "entity")


@dataclass
class Result:
    """nodes: the ranked context; edges: its named edges; stats: one row a query with its counts; timings: milliseconds of
    each step and in total."""

    answer: str | None
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame
    cache_hit: bool = False
    timings: dict[str, int] = field(default_factory=dict)


def _ms(began: float) -> int:
    return round((time.perf_counter() - began) * 1000)


def _timed(method: Callable[..., Result]) -> Callable[..., Result]:
    """The method, with its whole time in its result."""

    @functools.wraps(method)
    def run(*args: object, **more: object) -> Result:
        began = time.perf_counter()
        found = method(*args, **more)
        found.timings["total_ms"] = _ms(began)
        return found

    return run


def respond(found: Result, profile: str = "standard") -> dict[str, object]:
    """The fields of a profile, of a result for one query. Context and its edges, at most top_n nodes and what links them,
    are read only by profiles that have them; steps that did not run took no time."""
    if profile not in PROFILES:
        raise ValidationFailed(f"a response profile is one of {', '.join(PROFILES)}")
    names = PROFILES[profile]
    rows = {"nodes": lambda: found.nodes.orderBy("rank"), "edges": lambda: found.edges}
    counted = (found.stats.first() if "seed_nodes" in names else None) or {}
    known = {"answer": found.answer or "", "cache_hit": found.cache_hit, **(counted and counted.asDict()), **found.timings}
    return {n: [r.asDict() for r in rows[n]().collect()] if n in rows else known.get(n, 0) for n in names}


def validate(query: str | None = None, vector: list[float] | None = None, mode: str | None = None, max_hops: int | None = None) -> None:
    """The limits of a request."""
    if mode is not None and mode not in MODES:
        raise ValidationFailed(f"mode is one of {', '.join(MODES)}")
    if max_hops is not None and not 1 <= max_hops <= 5:
        raise ValidationFailed("max_hops is 1 to 5")
    if query is not None and not 1 <= len(query) <= 4096:
        raise ValidationFailed("a query has 1 to 4096 characters")
    if vector is not None and (not vector or not all(math.isfinite(x) for x in vector)):
        raise ValidationFailed("a vector has finite components, at least one")


class ResultCache:
    """The latest results by query, options and hints; entries end after ``ttl`` seconds. Used on the driver only."""

    def __init__(self, size: int = 10_000, ttl: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.size, self.ttl, self.clock = size, ttl, clock
        self.rows: OrderedDict[str, tuple[float, Result]] = OrderedDict()
        self.hits = self.misses = 0

    @staticmethod
    def key(query: str, options: QueryOptions) -> str:
        values = asdict(options)
        if any(isinstance(v, float) and math.isnan(v) for v in [*values.values(), *values["weights"].values()]):
            raise ValidationFailed("options are numbers")
        return hashlib.sha256(f"{query.strip()}||{json.dumps(values, sort_keys=True)}".encode()).hexdigest()

    def get(self, key: str) -> Result | None:
        at, found = self.rows.get(key, (0.0, None))
        if found is None or self.clock() - at > self.ttl:
            self.rows.pop(key, None)
            self.misses += 1
            return None
        self.rows.move_to_end(key)
        self.hits += 1
        return found

    def put(self, key: str, result: Result) -> None:
        self.rows[key] = (self.clock(), result)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)

    def clear(self) -> None:
        self.rows.clear()


class Engine:
    """Queries over a graph. Every retrieval is one plan over all its queries; only models and multi-hop rounds act on the
    driver, on one context of at most top_n nodes."""

    def __init__(self, graph: g.Graph, embedder: Embedder | None = None, image_embedder: Embedder | None = None, generator: Callable[[str], str] | None = None, reasoner: Callable[[str, int, int], Reply] | None = None, delta: g.Graph | None = None, cache: ResultCache | None = None) -> None:
        self.graph = graph if delta is None else g.Graph(graph.nodes.unionByName(delta.nodes), graph.edges.unionByName(delta.edges))
        self.embedder, self.image_embedder, self.generator, self.reasoner = embedder, image_embedder, generator, reasoner
        self.cache = cache or ResultCache()

    def swap(self, graph: g.Graph) -> None:
        """Query another graph from now on, such as one with its delta merged; results of the old one are forgotten."""
        self.graph = graph
        self.cache.clear()

    @property
    def spark(self) -> SparkSession:
        return self.graph.nodes.sparkSession

    def seeds(self, queries: DataFrame, options: QueryOptions) -> DataFrame:
        """Nearest nodes, then the ends of the nearest edges that have an embedding."""
        queries = queries.select("query_id", normalise("vector").alias("vector"))
        return search.merge_seeds(search.topk(self.graph.nodes, queries, options.k), search.edge_topk(self.graph.edges, queries, options.k))

    def retrieve(self, seeds: DataFrame, queries: DataFrame | None, options: QueryOptions, min_score: float | None = None) -> Result:
        """Expand, score and cut; with the edges inside each context and the counts of each step."""
        began = time.perf_counter()
        seeds = cut(seeds)
        timings, began = {"search_ms": _ms(began)}, time.perf_counter()
        sub = g.bfs(self.graph.edges, seeds, options.depth, options.max_nodes, options.bidirectional)
        sub = cut(sub)
        timings["bfs_ms"], began = _ms(began), time.perf_counter()
        unit = queries.select("query_id", normalise("vector").alias("vector")) if queries is not None else None
        scored = scoring.score(sub, self.graph.nodes, seeds, options.weights, unit)
        top = cut(scoring.context(scored, options.top_n, options.min_score if min_score is None else min_score))
        timings["score_ms"] = _ms(began)
        edges = scoring.named_edges(g.edges_between(self.graph.edges, top.select("query_id", "node")), self.graph.nodes)
        number = lambda df, name: df.groupBy("query_id").agg(F.count(F.lit(1)).alias(name))
        stats = number(seeds, "seed_nodes").join(number(sub, "subgraph_nodes"), "query_id", "left").join(number(top, "context_nodes"), "query_id", "left")
        return Result(None, top, edges, stats.na.fill(0), timings=timings)

    @_timed
    def query_vectors(self, queries: DataFrame, options: QueryOptions = QueryOptions()) -> Result:
        """Many queries (query_id, vector) in one plan."""
        return self.retrieve(self.seeds(queries, options), queries, options)

    def _answered(self, found: Result, query: str, hints: Hints) -> Result:
        if self.generator is None:
            return found
        began = time.perf_counter()
        found.answer = models.NO_CONTEXT
        if prompt := self._prompt(found, query, models.answer_prompt(hints)):
            found.answer = self.generator(prompt)
        found.timings["llm_ms"] = _ms(began)
        return found

    def _prompt(self, found: Result, query: str, prompt: F.Column) -> str | None:
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return models.prompt_rows(found.nodes, found.edges, self.graph.nodes, asked).select(prompt.alias("p")).first()["p"]

    def _one(self, vector: list[float]) -> DataFrame:
        return self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id long, vector array<double>")

    @_timed
    def query_vector(self, vector: list[float], query: str = "", options: QueryOptions = QueryOptions(), hints: Hints = Hints()) -> Result:
        """One vector; never cached."""
        validate(vector=vector)
        return self._answered(self.query_vectors(self._one(vector), options), query, hints)

    @_timed
    def query_text(self, query: str, options: QueryOptions = QueryOptions(), hints: Hints = Hints()) -> Result:
        """Cached by query and options, unless hints are given."""
        validate(query=query)
        if self.embedder is None:
            raise ModelUnavailable("no embedder")
        key = None if hints else ResultCache.key(query, options)
        if key and (found := self.cache.get(key)):
            return Result(found.answer, found.nodes, found.edges, found.stats, True)
        began = time.perf_counter()
        vector, took = self.embedder([query])[0].tolist(), _ms(began)
        found = self.query_vector(vector, query, options, hints)
        found.timings["embed_ms"] = took
        if key:
            self.cache.put(key, found)
        return found

    @_timed
    def query_image(self, image: str, query: str = "", options: QueryOptions = QueryOptions(), hints: Hints = Hints()) -> Result:
        if self.image_embedder is None:
            raise ModelUnavailable("no image embedder")
        return self.query_vector(self.image_embedder([image])[0].tolist(), query, options, hints)

    @_timed
    def query_node(self, node_id: int, options: QueryOptions = QueryOptions()) -> Result:
        """From a node: it is the one seed, with similarity 1; other nodes have similarity 0 and no score is too low."""
        if self.graph.nodes.where(F.col("id") == node_id).isEmpty():
            raise NotFound(f"no node {node_id}")
        seeds = self.spark.createDataFrame([(0, node_id, 0, 1.0)], "query_id long, node long, ord int, seed_sim double")
        return self.retrieve(seeds, None, options, min_score=0.0)

    def query(self, text: str | None = None, vector: list[float] | None = None, **more: object) -> Result:
        """Either kind; a vector wins."""
        if vector is not None:
            return self.query_vector(vector, text or "", **more)  # type: ignore[arg-type]
        if text is None:
            raise ValidationFailed("give a text or a vector")
        return self.query_text(text, **more)  # type: ignore[arg-type]

    def follow_ups(self, names: list[str]) -> DataFrame:
        """(node) of the names a reasoner asks for: of each name's five nearest nodes, the first whose name contains it or
        is contained in it, ignoring case."""
        rows = [(i, n, v.tolist()) for i, (n, v) in enumerate(zip(names, self.embedder(names), strict=True))]
        asked = self.spark.createDataFrame(rows, "query_id long, wanted string, vector array<double>")
        hits = search.topk(self.graph.nodes, asked, 5).join(self.graph.nodes.select("id", "name"), "id").join(asked.select("query_id", "wanted"), "query_id")
        a, b = F.lower("name"), F.lower("wanted")
        return hits.where(F.contains(a, b) | F.contains(b, a)).groupBy("query_id").agg(F.min_by("id", "rank").alias("node")).select("node").distinct()

    @_timed
    def query_multihop(self, query: str, options: QueryOptions = QueryOptions(), max_hops: int = 3, hints: Hints = Hints()) -> Result:
        """Retrieve, ask the reasoner, add what it asks for, at most ``max_hops`` times.

        Context that was there stays; added context is ranked with it by score and cut to top_n. If nothing that is asked
        for is known, the generator answers.
        """
        validate(query=query, max_hops=max_hops)
        if self.embedder is None or self.reasoner is None:
            raise ModelUnavailable("multi-hop queries need an embedder and a reasoner")
        vector = self._one(self.embedder([query])[0].tolist())
        found, hops = self.query_vectors(vector, options), 0
        while True:
            prompt = self._prompt(found, query, models.reason_prompt(hops, max_hops, hints))
            reply = self.reasoner(prompt, hops, max_hops) if prompt else Reply(models.NO_CONTEXT, [], True)
            if reply.done or not reply.follow_ups or hops >= max_hops:
                found.answer = reply.answer
                return found
            hops += 1
            more = cut(self.follow_ups(reply.follow_ups[: models.MOST_FOLLOW_UPS]))
            if more.isEmpty():
                return self._answered(found, query, hints)
            order = F.row_number().over(g.Window.partitionBy("query_id").orderBy("node")) - 1
            seeds = more.select(F.lit(0).cast("long").alias("query_id"), "node", F.lit(1.0).alias("seed_sim")).withColumn("ord", order)
            extra = self.retrieve(seeds, vector, options)
            nodes = merge_context(found.nodes, extra.nodes, options.top_n)
            edges = merge_edges(found.edges, extra.edges)
            steps = {k: found.timings.get(k, 0) + extra.timings.get(k, 0) for k in extra.timings}
            found = Result(None, cut(nodes), cut(edges), found.stats, timings=steps)


def merge_context(base: DataFrame, extra: DataFrame, top_n: int) -> DataFrame:
    """Context plus that of other nodes, ranked by score and cut; of equal scores, the earlier stay first."""
    fresh = extra.join(base.select("query_id", "node"), ["query_id", "node"], "left_anti")
    both = base.withColumn("part", F.lit(0)).unionByName(fresh.withColumn("part", F.lit(1)))
    rank = F.row_number().over(g.Window.partitionBy("query_id").orderBy(F.desc("score"), "part", "rank"))
    return both.withColumn("new", rank).where(F.col("new") <= top_n).drop("rank", "part").withColumnRenamed("new", "rank")


def merge_edges(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Edges plus those between other ends."""
    return base.unionByName(extra.join(base.select("query_id", "src", "dst"), ["query_id", "src", "dst"], "left_anti"))
