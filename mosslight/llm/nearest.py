"""Approximate nearest neighbours by collision-counting hashing.

Method. Each hash function is a single random projection; its projected values are kept as a
sorted array. A query opens a window around its own projection in every array and widens all
windows together (virtual rehashing: a wider window is the union of the buckets of a coarser
hash). A vector collides in the functions in whose windows it lies. The first window is narrow: the
`k` vectors with most collisions are verified by their exact inner product. The wide windows that
follow hold most of an array, so the functions in which a vector does not collide are counted:
what lies outside, ring by ring. The functions are an orthonormal basis, so each miss adds the squared
width to a lower bound of the vector's squared distance. Best bounds are verified first. Seen from
random directions, a difference of a given length has normally distributed parts, so the bound that
a vector at the k-th best distance found would have is known, with its spread: vectors beyond
`SURE` spreads of it are out, all others are verified. A true neighbour is lost with a probability
of about 0.001.

Largest inner product becomes nearest point by scaling vectors with the largest norm and adding
one coordinate that completes them to norm 1. That tells little where norms differ much, so a
block is parted by norm: a range ends where norms fall below `NORMS` of its longest, and is scaled
by that. Ranges are read longest first, until no vector of the next can reach the k-th best.

Scale. The arrays are built once for each block of `BLOCK` vectors; every vector is indexed. A task holds a block and
reads the queries after it, `QUERIES` at a time; only a table of few blocks is built several times, so that all
cores have some of its queries. Per query and block only the best k leave a task. The stated query set meets
all rows in blocks: queries are copied to each block, vectors are not. With `exact=True` nothing is left to chance: a vector is out only if its
lower bound is above the k-th best distance.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component take no
part. An inner product needs equal lengths: a query's candidates are the vectors of its own length.
With fewer than k others all are returned. Repeated ids count as rows of their own (a query's own
id is never its neighbour). Ties go to the smaller id. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K_
from .scratch import written

K, EVERY = 20, 20
BLOCK, QUERIES = 16384, 1024
#: Queries for which a block's arrays are worth building once more, on another core.
LEAST = 256
NORMS, STEP, SURE = 0.8, 64, 3.0
#: Half the widths of the windows, in spreads of a projection: the root of the functions' number, inverted.
NARROW, WIDE = 0.12, (1.2, 1.6, 2.0, 2.5, 3.2)
SEED = 11


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>, norm) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    ok = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull() & (F.size(embedding) > 0)
    out = vectors.where(ok).select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0 and norm < double('infinity')")


def functions(dim: int, seed: int = SEED) -> np.ndarray:
    """An orthonormal set of projections, one in each row."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(seed)).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).T


class Best:
    """The k best of what one query has met; least is the k-th score."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores, self.least = k, np.empty(0, np.int64), np.empty(0), -np.inf

    def put(self, vectors: np.ndarray, ids: np.ndarray, at: np.ndarray, query: np.ndarray) -> None:
        if not len(at):
            return
        ids, scores = np.concatenate([self.ids, ids[at]]), np.concatenate([self.scores, (vectors[at] * query).sum(axis=1)])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]
        if len(order) == self.k:
            self.least = float(self.scores[-1])


class Arrays:
    """Sorted projection arrays over the vectors of one range of norms."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.ids, self.vectors, self.longest = ids, vectors, longest
        unit = vectors / longest
        rest = np.sqrt(np.maximum(0.0, 1.0 - (unit * unit).sum(axis=1)))
        self.directions = functions(vectors.shape[1] + 1)
        values = np.column_stack([unit, rest]) @ self.directions.T
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(values, order, axis=0).T)
        self.order = list(np.ascontiguousarray(order.T))
        self.widths = np.array([NARROW, *WIDE]) / len(self.directions) ** 0.5

    def windows(self, queries: np.ndarray) -> np.ndarray:
        """Where the windows of each query end, from the widest left to the widest right; query x edge x function."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        at, w = unit @ self.directions[:, :-1].T, np.concatenate([-self.widths[::-1], self.widths])
        return np.stack([np.searchsorted(s, x[:, None] + w) for s, x in zip(self.sorted, at.T, strict=True)], axis=2).astype(np.int32)

    def _count(self, starts: list[int], ends: list[int]) -> np.ndarray:
        """In how many functions each vector lies between two places of the array."""
        parts = [o[a:b] for o, a, b in zip(self.order, starts, ends, strict=True) if b > a]
        return np.bincount(np.concatenate(parts), minlength=len(self.ids)) if parts else np.zeros(len(self.ids), np.int64)

    def search(self, query: np.ndarray, own: int, best: Best, windows: np.ndarray, exact: bool = False) -> int:
        """Put into best all vectors that belong there; the number verified."""
        length = float(np.sqrt(query @ query))
        if self.longest * length * (1 + 1e-9) < best.least:
            return 0
        n, last, edges = len(self.ids), len(self.widths), windows.tolist()
        todo = self.ids != own
        # the narrow window: most collisions first
        open_ = np.flatnonzero(todo)
        collisions = self._count(edges[last - 1], edges[last])[open_]
        some = open_ if len(open_) <= best.k else open_[np.argpartition(-collisions, best.k)[: best.k]]
        best.put(self.vectors, self.ids, some, query)
        todo[some] = False
        # the wide ones: what lies outside a window but inside the next, on both sides
        bound = np.zeros(n)
        for r in range(1, last):
            outer = [(edges[last - 2 - r], edges[last - 1 - r]), (edges[last + r], edges[last + r + 1])] if r + 1 < last else [([0] * len(self.order), edges[0]), (edges[-1], [n] * len(self.order))]
            for starts, ends in outer:
                bound += self._count(starts, ends) * self.widths[r] ** 2
        # best bounds first: they bring the k-th best close to what it will be
        verified, open_ = len(some), np.flatnonzero(todo)
        some = open_ if len(open_) <= STEP else open_[np.argpartition(bound[open_], STEP)[:STEP]]
        best.put(self.vectors, self.ids, some, query)
        todo[some] = False
        square = 2 - 2 * best.least / (length * self.longest)
        rest = np.flatnonzero(todo & (bound <= (square + 1e-9 if exact else self.threshold(square))))
        best.put(self.vectors, self.ids, rest, query)
        return verified + len(some) + len(rest)

    def threshold(self, square: float) -> float:
        """Bound of a vector at such a squared distance, SURE spreads above the mean; never above the distance itself."""
        if not 0 < square < 4:
            return np.inf if square >= 4 else 1e-9
        m = len(self.directions)
        part, mean, second, mixed, below = square / m, 0.0, 0.0, 0.0, 0.0
        for w in self.widths[1:].tolist():
            # how often a normally distributed part misses this window, and the mean of its square there
            t = w / part**0.5
            miss = math.erfc(t / 2**0.5)
            beyond = part * (miss + t * math.exp(-t * t / 2) * (2 / math.pi) ** 0.5)
            mean += miss * (w**2 - below**2)
            second += miss * (w**4 - below**4)
            mixed += beyond * (w**2 - below**2)
            below = w
        # the squares of all parts sum to the distance: only what they don't tell of the bound is open
        spread = second - mean**2 - (mixed - mean * part) ** 2 / (2 * part**2)
        return min(square, m * mean + SURE * (m * max(spread, 0.0)) ** 0.5) + 1e-9


def ranges(ids: np.ndarray, vectors: np.ndarray) -> list[Arrays]:
    """The arrays of a block, by falling norm."""
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    by = np.lexsort((ids, -norm))
    norm, out, a = norm[by], [], 0
    while a < len(by):
        b = int(np.searchsorted(-norm, -NORMS * norm[a], "right"))
        out.append(Arrays(ids[by[a:b]], vectors[by[a:b]], float(norm[a])))
        a = b
    return out


def _search(k: int, exact: bool):
    """Rows come sorted by cell, the vectors of its block before its queries. The arrays of a block are built once in a task, and queries are read batch by batch."""
    names = ["query_id", "vec_id", "score"]

    def run(batches):
        key, ids, held, block = None, [], [], None
        matrix = lambda col, n: col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        for batch in K_.portions(batches, QUERIES):
            out: list[list[np.ndarray]] = [[np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]]
            cells, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            # runs of one cell and kind
            edges = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(cells)]
            for a, b in zip(edges, edges[1:], strict=False):
                if cells[a] != key:
                    key, ids, held, block = cells[a], [], [], None
                own, x = batch.column("vec_id").slice(a, b - a).to_numpy(), matrix(batch.column("v").slice(a, b - a), b - a)
                if kind[a] == 0:
                    ids.append(own)
                    held.append(x)
                    continue
                if block is None:
                    block = ranges(np.concatenate(ids), np.concatenate(held)) if ids else []
                    ids, held = [], []
                windows = [arrays.windows(x) for arrays in block]
                for i, (one, me) in enumerate(zip(x, own.tolist(), strict=True)):
                    best = Best(k)
                    for arrays, at in zip(block, windows, strict=True):
                        arrays.search(one, me, best, at[i], exact)
                    for col, y in zip(out, (np.full(len(best.ids), me), best.ids, best.scores), strict=True):
                        col.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, *, exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of vectors(vec_id, v, norm) for each of queries(vec_id, v).

    `exact` verifies every vector whose lower bound doesn't rule it out, not only those that are likely to be near.
    """
    spark = vectors.sparkSession
    # one row for each length of vectors
    lengths = vectors.groupBy(F.size("v").alias("dim")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    # queries are parted only as far as a table of few blocks needs it to use all cores
    cores = max(1, spark.sparkContext.defaultParallelism)
    lengths = lengths.withColumn("parts", F.ceil(F.lit(cores) / F.col("blocks")).cast("int"))
    lengths = lengths.join(queries.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("asked")), "dim")
    lengths = lengths.withColumn("parts", F.least("parts", F.ceil(F.col("asked") / F.lit(LEAST)).cast("int")))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.withColumn("dim", F.size("v")).join(lengths, "dim").select("dim", deal("parts").alias("part"), each("blocks").alias("block"), F.lit(1).alias("kind"), "vec_id", "v")
    right = vectors.withColumn("dim", F.size("v")).join(lengths, "dim").select("dim", each("parts").alias("part"), deal("blocks").alias("block"), F.lit(0).alias("kind"), "vec_id", "v")
    cells = right.unionByName(left).withColumn("cell", F.xxhash64("dim", "block", "part"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)
    hits = cells.repartition(partitions, "cell").sortWithinPartitions("cell", "kind").select("cell", "kind", "vec_id", "v").mapInArrow(_search(k, exact), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = written(valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
