"""The searches: vector, hybrid, keyword, BM25, and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import SearchOptions
from ..functions import text as X
from ..functions import vector as V
from .knn import knn

RRF_CONSTANT = 60
K1, B = 1.2, 0.75
TERM = "[a-z0-9_]+"


# --- vector and hybrid ------------------------------------------------------------------------


def vector_search(chunks: DataFrame, query: list[float], k: int = 5, *, metric: str = "cosine", key: str = "chunk_id") -> DataFrame:
    """Nearest k in the order of distance, with score = similarity; not sorted again by score."""
    return knn(chunks, query, k or 5, metric=metric, key=key).withColumn("score", V.similarity(F.col("distance")))


def rescored(candidates: DataFrame, words: list[str], o: SearchOptions, content: str = "content") -> DataFrame:
    """vector_score, keyword_score and their weighted sum."""
    out = candidates.withColumn("vector_score", V.similarity(F.col("distance"))).withColumn("keyword_score", X.keyword_score(F.col(content), words, o.keyword_boosting))
    return out.withColumn("score", F.col("vector_score") * o.vector_weight + F.col("keyword_score") * o.keyword_weight)


def explanation(words: list[str], content: Column) -> Column:
    """Why a row was found: the shares of both scores and the keywords in the text."""
    low = F.lower(content)
    hits = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w)) if words else F.array().cast("array<string>")
    semantic = F.when(F.col("vector_score") > 0, F.concat(F.lit("Semantic: "), X.percent(F.col("vector_score"))))
    keyword = F.when((F.col("keyword_score") > 0) & (F.size(hits) > 0), F.concat(F.lit("Keywords: "), X.percent(F.col("keyword_score")), F.lit(" ("), F.array_join(hits, ", "), F.lit(")")))
    return F.concat_ws(" | ", semantic, keyword, F.concat(F.lit("Overall: "), X.percent(F.col("score"))))


def hybrid_search(chunks: DataFrame, query_text: str, query: list[float], o: SearchOptions | None = None, *, key: str = "chunk_id", content: str = "content") -> DataFrame:
    """Candidates by vector, scored with keywords, sorted, filtered by least similarity, then cut to k."""
    o = o or SearchOptions()
    words = X.keyword_list(query_text, o.custom_stop_words)
    found = rescored(knn(chunks, query, max(o.limit * 3, 20), metric=o.metric, key=key), words, o, content)
    found = found.where(F.col("score") >= o.min_similarity).orderBy(F.col("score").desc(), "distance", key).limit(o.limit)
    return found.withColumn("explanation", explanation(words, F.col(content)))


def keyword_search(chunks: DataFrame, query_text: str, query: list[float], k: int = 5, *, metric: str = "cosine", key: str = "chunk_id", content: str = "content") -> DataFrame:
    """Candidates by vector, ranked by keyword score alone."""
    k = k or 5
    words = X.keyword_list(query_text)
    found = rescored(knn(chunks, query, max(k * 5, 50), metric=metric, key=key), words, SearchOptions(), content)
    return found.withColumn("score", F.col("keyword_score")).orderBy(F.col("score").desc(), "distance", key).limit(k)


# --- BM25 ---------------------------------------------------------------------------------------


def terms(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0))


def bm25_weight(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    """What one term adds to a chunk's score."""
    tf, dl, df, n = (c.cast("double") for c in (tf, dl, df, n))
    idf = F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.try_divide(dl, avgdl)))


class BM25:
    """Okapi BM25 over a chunk table that has no index. Statistics are plain aggregates; nothing is gathered."""

    def __init__(self, chunks: DataFrame, *, key: str = "chunk_id", content: str = "content"):
        self.key = key
        self.docs = chunks.select(key, terms(F.col(content)).alias("terms"))
        # lengths need a count of the terms only
        self.sizes = chunks.select(key, F.coalesce(F.regexp_count(F.lower(F.col(content)), F.lit(TERM)), F.lit(0)).alias("dl"))
        self.postings = self.docs.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))

    def statistics(self) -> DataFrame:
        """(n_docs, avgdl), one row."""
        return self.sizes.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))

    def document_frequency(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def document_count(self) -> int:
        return self.sizes.count()

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, key, score) of every chunk with a term of a query; queries(query_id, text).

        Postings are cut to the queries' terms before anything is shuffled by chunk.
        """
        wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        own = self.postings.join(wanted.select("term").distinct(), "term", "left_semi")
        # summed from tf, so that both readers of the postings need the same columns and share one exchange
        df = own.groupBy("term").agg(F.sum(F.least("tf", F.lit(1).cast("long"))).alias("df"))
        # one row of totals; the join is on a constant key
        totals = self.statistics().withColumn("one", F.lit(1))
        weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avgdl"))
        scored = own.join(df, "term").withColumn("one", F.lit(1)).join(F.broadcast(totals), "one").select(self.key, "term", weight.alias("w"))
        return wanted.join(scored, "term").groupBy("query_id", self.key).agg(F.sum("w").alias("score"))

    def search(self, queries: DataFrame, k: int = 5, compat_cap: int | None = None) -> DataFrame:
        """Best k per query with rank; `compat_cap` = 5 shows five rows at most."""
        k = min(k or 5, compat_cap or k or 5)
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), self.key)
        return self.scores(queries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- fusion -------------------------------------------------------------------------------------


def reciprocal_rank_fusion(vector: DataFrame, keyword: DataFrame, k: int = 5, *, weights: tuple[float, float] = (0.5, 0.5), key: str = "chunk_id") -> DataFrame:
    """Fuse two ranked lists (query_id, key, rank): the sum of w / (60 + rank); the vector list's order breaks ties."""
    v = vector.select("query_id", key, F.col("rank").alias("v_rank"))
    b = keyword.select("query_id", key, F.col("rank").alias("b_rank"))
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (RRF_CONSTANT + F.col(r)), F.lit(0.0))
    fused = v.join(b, ["query_id", key], "full_outer").withColumn("score", part(weights[0], "v_rank") + part(weights[1], "b_rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("v_rank").asc_nulls_last(), F.col("b_rank").asc_nulls_last())
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(hits: DataFrame, order: list[Column], query_id: Column | None = None, group: str = "query_id") -> DataFrame:
    """Add rank (from 1) within each query."""
    hits = hits if query_id is None else hits.withColumn(group, query_id)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


# --- results ------------------------------------------------------------------------------------


def deduplicate(results: DataFrame, dedupe_key: Column, arrival: list[Column | str], query_id: str = "query_id") -> DataFrame:
    """First arrival of each key, not the best one."""
    order = Window.partitionBy(query_id, "_key").orderBy(*arrival)
    return results.withColumn("_key", dedupe_key).withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_key", "_nth")


def confidence(results: DataFrame, threshold: float = 0.7, group: str | None = None) -> DataFrame:
    """Mean score over all results (0 without any) and whether it meets the threshold."""
    own = results.groupBy(group) if group else results.groupBy()
    return own.agg(F.count("*").alias("total_results"), F.coalesce(F.avg(F.coalesce("score", F.lit(0.0))), F.lit(0.0)).alias("avg_confidence")).withColumn("confidence_met", F.col("avg_confidence") >= threshold)


def average_score(results: DataFrame, group: str | None = None) -> DataFrame:
    """Mean of the scores, per group if one is named; 0 without any."""
    own = results.groupBy(group) if group else results.groupBy()
    return own.agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))
