"""The search agent: plan, retrieve for every sub-query, keep first arrivals, rank, and report confidence."""

from __future__ import annotations

import functools
import json
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import AgentOptions, SearchOptions, check_strategy, check_top_k
from ..functions import text as X
from ..functions import vector as V
from ..operators import retrieve as R
from ..operators.knn import knn_many
from .planner import create_plan, simple_plan


@dataclass
class AgentResult:
    query: str
    plan: dict
    results: DataFrame
    summary: DataFrame
    iterations: int
    seconds: float
    #: all rows of all sub-queries, repeats included
    found: DataFrame


class Agent:
    """Searches over one topic's chunks(chunk_id, content, embedding, ...)."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, embed_query, *, key: str = "chunk_id", content: str = "content", index=None):
        """`index` gives the chunks' keyword index, or None; without it statistics are computed from the chunks."""
        self.spark, self.key, self.content, self.embed_query, self._index = spark, key, content, embed_query, index
        self.use_chunks(chunks)

    def use_chunks(self, chunks: DataFrame) -> None:
        """Go on with other chunks; keyword statistics are looked up again when they are needed."""
        self.chunks = chunks
        self.__dict__.pop("bm25", None)

    @functools.cached_property
    def bm25(self):
        return (self._index and self._index()) or R.BM25(self.chunks, key=self.key, content=self.content)

    def _search(self, texts: list[str], ks: list[int], strategy: str) -> DataFrame:
        """(sub_idx, chunk_id, content, score, vector_score, keyword_score, explanation, rank, strategy) of some searches, in one scan of the chunks."""
        none = F.lit(None)
        each = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("sub_idx") + 1)
        key, content = self.key, self.content
        if strategy in ("vector", "hybrid", "ensemble"):
            wide = {"vector": 1, "hybrid": 3, "ensemble": 3}[strategy]
            pool = max(max(k * wide, 20 if strategy == "hybrid" else 0) for k in ks)
            near = knn_many(self.chunks, [self.embed_query(t) for t in texts], pool, key=key, keep=(content,))
            near = near.where(F.col("rank") <= each([max(k * wide, 20 if strategy == "hybrid" else 0) for k in ks]))
        if strategy in ("bm25", "ensemble"):
            queries = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "query_id int, text string")
            words = self.bm25.search(queries, max(ks) * (3 if strategy == "ensemble" else 1))
            words = words.withColumnRenamed("query_id", "sub_idx").where(F.col("rank") <= each([k * (3 if strategy == "ensemble" else 1) for k in ks]))
        if strategy == "hybrid":
            hits = near.withColumn("vector_score", V.similarity(F.col("distance"))).withColumn("keyword_score", F.lit(None).cast("double")).withColumn("explanation", F.lit(None).cast("string"))
            lists = [X.keyword_list(t, SearchOptions().custom_stop_words) for t in texts]
            pick = lambda f: functools.reduce(lambda c, i: c.when(F.col("sub_idx") == i, f(lists[i])), range(1, len(lists)), F.when(F.col("sub_idx") == 0, f(lists[0])))
            o = SearchOptions()
            hits = hits.withColumn("keyword_score", pick(lambda w: X.keyword_score(F.col(content), w, o.keyword_boosting)))
            hits = hits.withColumn("score", F.col("vector_score") * o.vector_weight + F.col("keyword_score") * o.keyword_weight).where(F.col("score") >= o.min_similarity)
            order = [F.col("score").desc(), F.col("distance"), F.col(key)]
            hits = R.ranked(hits.drop("rank"), order, group="sub_idx").where(F.col("rank") <= each(ks))
            hits = hits.withColumn("explanation", pick(lambda w: R.explanation(w, F.col(content))))
        elif strategy == "vector":
            hits = near.withColumn("score", V.similarity(F.col("distance"))).withColumns({"vector_score": F.col("score"), "keyword_score": none.cast("double"), "explanation": none.cast("string")})
        else:
            if strategy == "bm25":
                hits = words.withColumns({"vector_score": none.cast("double"), "keyword_score": F.col("score"), "explanation": none.cast("string")})
            else:
                fused = R.reciprocal_rank_fusion(near.withColumnRenamed("sub_idx", "query_id"), words.withColumnRenamed("sub_idx", "query_id"), max(ks), key=key)
                hits = fused.withColumnRenamed("query_id", "sub_idx").where(F.col("rank") <= each(ks)).withColumns({"vector_score": none.cast("double"), "keyword_score": none.cast("double"), "explanation": none.cast("string")})
            # keyword hits come from the index; their texts are looked up for the rows that are shown
            hits = hits.join(self.chunks.select(key, content), key)
        return hits.select("sub_idx", key, content, "score", "vector_score", "keyword_score", "explanation", "rank", F.lit(strategy).alias("strategy"))

    def simple_query(self, query: str, top_k: int = 5, strategy: str = "hybrid") -> DataFrame:
        """One search, without planning or removal of repeats."""
        return self._search([query], [top_k], check_strategy(strategy)).orderBy("rank")

    def retrieve(self, plan: dict, strategy: str, top_k: int) -> DataFrame:
        """Results of all sub-queries from one scan, in order of arrival (sub_idx, rank)."""
        subs = plan["sub_queries"]
        hits = self._search([s["query"] for s in subs], [s.get("top_k") or top_k for s in subs], strategy)
        return hits.withColumn("sub_query", F.element_at(F.array(*[F.lit(s["query"]) for s in subs]), F.col("sub_idx") + 1))

    def query(self, query: str, o: AgentOptions | None = None) -> AgentResult:
        """Plan and search. One pass: refinement needs a planner that asks for more, and stops after it."""
        o, began = o or AgentOptions(), time.time()
        strategy = check_strategy(o.retrieval_strategy)
        plan = create_plan(query, use_llm=o.use_llm, planner=o.planner, max_sub_queries=o.max_iterations, top_k=o.top_k, context=o.workspace_context)
        # top_k rows per sub-query at most: they come to the driver once, and summary, counts and ranking read them from there
        found = self.retrieve(plan, strategy, o.top_k)
        found = self.spark.createDataFrame(found.collect(), found.schema)
        summary = R.confidence(found, o.confidence_threshold)
        unique = R.deduplicate(found.withColumn("query_id", F.lit(0)), F.coalesce(F.col(self.key).cast("string"), F.left(self.content, F.lit(100))), ["sub_idx", "rank"])
        results = unique.orderBy(F.col("score").desc(), "sub_idx", "rank").limit(o.top_k).drop("query_id")
        summary = summary.withColumn("sub_queries_executed", F.lit(len(plan["sub_queries"]))).withColumn("strategy", F.lit(strategy))
        return AgentResult(query, plan, results, summary, 1, time.time() - began, found)


def sub_query_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("sub_idx").agg(F.count("*").alias("results"))


def tool_rows(results: DataFrame, *, content: str = "content") -> DataFrame:
    """Results as the search tool shows them."""
    has = lambda c, other: F.col(c) if c in results.columns else F.lit(other)
    position = F.concat(F.lit("chars "), F.coalesce(has("start_position", None).cast("int"), F.lit(0)).cast("string"), F.lit("-"), F.coalesce(has("end_position", None).cast("int"), F.lit(0)).cast("string"))
    path = F.array_join(F.col("heading_path"), " → ") if "heading_path" in results.columns else F.lit(None).cast("string")
    return results.select(F.col(content).alias("text"), F.coalesce(has("file_name", None).cast("string"), F.lit("Unknown")).alias("document_name"), X.round2(F.coalesce(F.col("score"), F.lit(0.0))).alias("similarity"), F.col("strategy").alias("retrieval_strategy"), F.coalesce(has("chunk_index", None).cast("int"), F.lit(0)).alias("chunk_index"), position.alias("position"), path.alias("heading_path"))


def best_topic(catalog, requested: str, embed_query) -> tuple[dict, str]:
    """(topic, how it matched): exact name in whatever case, the only one there is, else the most similar name."""
    topics = catalog.all()
    if not topics:
        raise ValueError("there are no topics")
    for t in topics:
        if t["name"].lower() == requested.lower():
            return t, "exact"
    if len(topics) == 1:
        return topics[0], "fallback"
    import numpy as np

    q = np.asarray(embed_query(requested))

    def near(t):
        v = np.asarray(embed_query(t["name"]))
        return float(q @ v / max(1e-12, np.linalg.norm(q) * np.linalg.norm(v)))

    return max(topics, key=near), "similar"


class Agents:
    """One agent for each topic, with its keyword statistics, kept until the catalog drops or changes the topic."""

    def __init__(self, spark: SparkSession, catalog, embed_query):
        self.spark, self.catalog, self.embed_query = spark, catalog, embed_query
        self.kept: dict[str, Agent] = {}
        catalog.cleanup.append(self.forget)

    def forget(self, topic_id: str | None = None) -> None:
        """Drop a topic's agent, or all of them."""
        if topic_id is None:
            self.kept.clear()
        self.kept.pop(topic_id, None)

    def get(self, topic_id: str) -> Agent | None:
        """The topic's agent, over its chunks as they are now; None if it has none."""
        chunks = self.catalog.chunks(topic_id)
        if chunks is None:
            return None
        agent = self.kept.get(topic_id)
        if agent is None:
            # a shared topic is read-only: its index is used if it has one
            index = functools.partial(self.catalog.keyword_index, topic_id)
            agent = self.kept[topic_id] = Agent(self.spark, chunks, self.embed_query, index=index)
        elif agent.chunks is not chunks:
            # the store gives another table after each write
            agent.use_chunks(chunks)
        return agent


def rag_query(spark: SparkSession, catalog, embed_query, *, topic: str, query: str, top_k: int = 5, retrieval_strategy: str = "hybrid", use_agentic_mode: bool = False, options: AgentOptions | None = None, agents: Agents | None = None) -> str:
    """The search tool: resolve the topic, search it, and give the answer as JSON text. `agents` keeps agents from call to call."""
    check_top_k(top_k), check_strategy(retrieval_strategy)
    found, how = best_topic(catalog, topic, embed_query)
    if not (catalog.stats(found["id"]) or {}).get("document_count"):
        raise ValueError(f"topic {found['name']!r} has no documents")
    agent = (agents or Agents(spark, catalog, embed_query)).get(found["id"])
    if agent is None:
        raise ValueError(f"topic {found['name']!r} has no chunks")
    chunks = agent.chunks
    out: dict = {"query": query, "topicName": found["name"], "topicMatched": how}
    if how != "exact":
        out |= {"requestedTopic": topic, "availableTopics": [t["name"] for t in catalog.all()]}
    if use_agentic_mode:
        o = options or AgentOptions(retrieval_strategy=retrieval_strategy, top_k=top_k)
        r = agent.query(query, o)
        rows, counts = r.results, {c.sub_idx: c.results for c in sub_query_counts(r.found).collect()}
        s = r.summary.first()
        steps = [{"stepNumber": i + 1, "query": q["query"], "reasoning": q["reasoning"], "resultsCount": counts.get(i, 0)} for i, q in enumerate(r.plan["sub_queries"])]
        out["agenticMetadata"] = {"mode": "agentic", "queryComplexity": r.plan["complexity"], "steps": steps, "totalIterations": r.iterations, "confidence": s.avg_confidence, "confidenceMet": s.confidence_met}
    else:
        rows = agent.simple_query(query, top_k, retrieval_strategy)
        s = R.confidence(rows).first()
        out["agenticMetadata"] = {"mode": "simple", "queryComplexity": simple_plan(query)["complexity"], "confidence": s.avg_confidence}
    extra = [c for c in ("file_name", "chunk_index", "heading_path") if c in chunks.columns]
    shown = tool_rows(rows.join(chunks.select("chunk_id", *extra), "chunk_id") if extra else rows)
    out["results"] = [json.loads(x[0]) for x in shown.select(F.to_json(F.struct("*"))).collect()]
    return json.dumps(out, indent=2, ensure_ascii=False)
