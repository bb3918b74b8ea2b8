"""Nearest chunks by vector distance, for one query or a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V

#: Queries and vectors that a task compares at once.
BATCH_QUERIES, PART = 256, 16_384


def literal_distance(embedding: Column, query: list[float], metric: str) -> Column:
    """Distance to a known vector as plain arithmetic, inside generated code."""
    ip = V.dot_literal(embedding, query)
    if metric == "neg_ip":
        return -ip
    own = V.norm(embedding)
    if metric == "cosine":
        length = float(np.sqrt((np.asarray(query, np.float64) ** 2).sum()))
        return F.lit(1.0) - F.coalesce(F.try_divide(ip, own * F.lit(length)), F.lit(0.0))
    return V.distance(embedding, F.array(*[F.lit(float(x)) for x in query]), metric)


def knn(chunks: DataFrame, query: list[float], k: int, *, metric: str = "cosine", key: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """The k rows nearest to a vector, with `distance`, nearest first; a top-k per partition and one merge."""
    return chunks.withColumn("distance", literal_distance(F.col(embedding), query, metric)).orderBy("distance", key).limit(k)


def distances(x: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each query (row) to each vector (column). A pair's value doesn't depend on its place in the batch."""
    ip = np.empty((len(queries), len(x)))
    for i, q in enumerate(queries):
        ip[i] = (x * q).sum(axis=1)
    if metric == "neg_ip":
        return -ip
    if metric == "l2sq":
        return np.stack([((x - q) ** 2).sum(axis=1) for q in queries]) if len(queries) else ip
    scale = np.sqrt((queries**2).sum(axis=1))[:, None] * np.sqrt((x**2).sum(axis=1))[None]
    return 1.0 - np.divide(ip, scale, out=np.zeros_like(ip), where=scale > 0)


def vectors_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, vectors) of the lists in a column that aren't null, as one matrix of doubles."""
    at = np.flatnonzero(np.asarray(pc.is_valid(col)))
    lists = col.take(pa.array(at)) if len(at) < len(col) else col
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return at, flat.reshape(len(at), -1) if len(at) else np.empty((0, 0))


class Heap:
    """The k rows nearest to a query among those that a task has met: distances, keys for ties, and the rows."""

    def __init__(self, k: int):
        self.k, self.rows, self.d = k, None, np.empty(0)

    def offer(self, batch: pa.RecordBatch, at: np.ndarray, d: np.ndarray, key: str) -> None:
        if len(d) > self.k:
            near = d <= np.partition(d, self.k - 1)[self.k - 1]
            at, d = at[near], d[near]
        if self.rows is not None and len(self.d) == self.k:
            near = d <= self.d[-1]
            at, d = at[near], d[near]
        if not len(d):
            return
        rows = pa.Table.from_batches([batch.take(pa.array(at))])
        rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        all_d = np.concatenate([self.d, d])
        order = pc.sort_indices(pa.table({"d": all_d, "key": rows.column(key)}), [("d", "ascending"), ("key", "ascending")])[: self.k]
        self.rows, self.d = rows.take(order).combine_chunks(), all_d[np.asarray(order)]


def knn_many(chunks: DataFrame, queries: list[list[float]], k: int, *, metric: str = "cosine", key: str = "chunk_id", embedding: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """(sub_idx, key, distance, rank, keep...) of the k rows nearest to each of a few known vectors, in one scan of chunks.

    A task holds one Arrow batch, and one heap of k rows for each vector; only these rows leave it, with
    the columns to keep. Made for the sub-queries of a plan; many queries go to knn_batch().
    """
    matrix, columns = np.array(queries, np.float64), list(dict.fromkeys([key, *keep]))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in matrix]
        for batch in batches:
            at, x = vectors_of(batch.column(0))
            if not len(at):
                continue
            own = batch.select(columns)
            for heap, d in zip(heaps, distances(x, matrix, metric), strict=True):
                heap.offer(own, at, d, key)
        for i, heap in enumerate(heaps):
            if heap.rows is not None:
                for part in heap.rows.to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array([i] * part.num_rows, pa.int32()), pa.array(heap.d), *part.columns], names=["sub_idx", "distance", *columns])

    ddl = ", ".join(["sub_idx int", "distance double", *(f"`{c}` {chunks.schema[c].dataType.simpleString()}" for c in columns)])
    found = chunks.where(F.col(embedding).isNotNull()).select(F.col(embedding).alias("_v"), *columns).mapInArrow(best, ddl)
    order = Window.partitionBy("sub_idx").orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cell(k: int, metric: str, key: str, schema: pa.Schema):
    """The k best of a part of the vectors for each query of a block."""

    def run(_, left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        ids, keys = left.column("query_id").combine_chunks(), right.column(key).combine_chunks()
        _, q = vectors_of(left.column("v").combine_chunks())
        _, x = vectors_of(right.column("v").combine_chunks())
        # as a product of matrices first; what may be among the best is measured again, alike in every place
        own, norms = (x**2).sum(axis=1), (q**2).sum(axis=1)
        rough = q @ x.T
        if metric == "cosine":
            scale = np.sqrt(norms)[:, None] * np.sqrt(own)[None]
            rough = -np.divide(rough, scale, out=np.zeros_like(rough), where=scale > 0)
        else:
            rough = -rough if metric == "neg_ip" else norms[:, None] + own[None] - 2 * rough
        of, at, d = [], [], []
        for i, row in enumerate(rough):
            near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1] + 1e-9 * (1 + np.abs(row).max())) if len(row) > k else np.arange(len(row))
            of.append(np.full(len(near), i))
            at.append(near)
            d.append(distances(x[near], q[i : i + 1], metric)[0])
        of, at, d = np.concatenate(of), np.concatenate(at), np.concatenate(d)
        return pa.table([ids.take(pa.array(of)), keys.take(pa.array(at)), pa.array(d)], schema=schema)

    return run


def knn_batch(chunks: DataFrame, queries: DataFrame, k: int, *, metric: str = "cosine", key: str = "chunk_id", embedding: str = "embedding", query_id: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """(query_id, key, distance, rank) of the k rows nearest to each query.

    The queries are the stated query set, a table: it is dealt in blocks of BATCH_QUERIES and the vectors in
    parts of PART, and each block meets each part in one task. What leaves a task is about k rows per query. No query passes
    the driver.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key_type, id_type = chunks.schema[key].dataType, queries.schema[query_id].dataType
    left = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("v"))
    right = chunks.where(F.col(embedding).isNotNull()).select(F.col(key).alias("_key"), F.col(embedding).alias("v"))
    # two numbers
    blocks, parts = max(1, -(-left.count() // BATCH_QUERIES)), max(1, -(-right.count() // PART))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.withColumn("block", deal("query_id", blocks)).withColumn("part", each(parts))
    right = right.withColumn("part", deal("_key", parts)).withColumn("block", each(blocks)).withColumnRenamed("_key", key)
    schema = pa.schema([("query_id", to_arrow_type(id_type)), (key, to_arrow_type(key_type)), ("distance", pa.float64())])
    ddl = f"query_id {id_type.simpleString()}, `{key}` {key_type.simpleString()}, distance double"
    out = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_cell(k, metric, key, schema), ddl)
    order = Window.partitionBy("query_id").orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
