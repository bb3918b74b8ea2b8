"""Near-duplicate embeddings by a PCA-ordered tiled comparison.

Method. Vectors are scaled to length 1 and turned onto the principal axes of a sample, so that their
leading coordinates hold most of their length. A tile of rows is compared with another by its leading
coordinates first; the product of what is left of both rows, their suffix norms, bounds what the
other coordinates can add. A pair is dropped as soon as its cosine can't reach the threshold; the
next coordinates are added for the others, and so on. What comes within 1e-9 of the threshold is
decided by the vectors as they came. Any rotation gives the same links: the sample (`SAMPLE`
vectors, those with the least hash) only decides how early pairs are dropped.

Vectors are dealt to tiles by cuts at the sample's medians along the principal axes. Each tile has a
box, exact for its vectors. Two vectors link only within a distance of sqrt(2 - 2 * threshold), so a
vector visits the tiles whose box lies as near as that, each pair of tiles in one direction; within
a tile only rows are compared that are as near along its widest axis.

Scale. Equal vectors are one class, found by a digest in a combining aggregate, so a vector of any
frequency is compared once. Tiles beyond `BLOCK` rows are cut in blocks and their visitors in
portions of `BLOCK` rows: a task holds one of each. Out of a task come a count per class and the
edges of a forest, in proportion to its rows and not to its pairs. How many tiles a vector visits
follows the data: where a few axes tell vectors apart it is a few; where none does, all vectors are
near each other in every box, and the work is that of all pairs of tiles.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing: n_links is 0 and they are their own component. Vectors of other lengths never link. Repeated rows
and copies under other ids link with each other. Rows that share a vec_id are one vertex
of the components, and count as links of each other where their vectors are similar. A row without
a vec_id takes no part: n_links 0, no component, kept. A cosine equal to the threshold links. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components, forest
from .scratch import drop, written

THRESHOLD = 0.95
SAMPLE, LEAD, LEAST_LEAD = 2_048, 16, 8
#: Rows of a block of a tile, and of a portion of its visitors: fewer where vectors are long.
BLOCK, BLOCK_BYTES = 16_384, 32 << 20
TILE, DENSE, SLACK = 256, 0.1, 1e-9


# --- vectors -----------------------------------------------------------------------------------------


def _pack(batches):
    """A digest and the bytes of each vector that takes part; 32-bit components where they are exact."""
    for batch in K.portions(batches):
        digests, dims, packed = [], [], []
        for x in batch.column(1).to_numpy(zero_copy_only=False):
            x = None if x is None else np.asarray(x, np.float64) + 0.0  # -0.0 is 0.0
            if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
                digest = dim = data = None
            else:
                with np.errstate(over="ignore"):
                    short = x.astype(np.float32)
                data = (short if (short == x).all() else x).tobytes()
                digest, dim = hashlib.blake2b(x.tobytes(), digest_size=16).digest(), len(x)
            for col, y in zip((digests, dims, packed), (digest, dim, data), strict=True):
                col.append(y)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "digest", "dim", "v"])


def unpacked(packed: list[bytes], dim: int) -> np.ndarray:
    """Vectors as they came, scaled so that their largest component is 1 or -1."""
    out = np.empty((len(packed), dim))
    for i, data in enumerate(packed):
        out[i] = np.frombuffer(data, np.float32 if len(data) == 4 * dim else np.float64)
    return out / np.abs(out).max(axis=1, keepdims=True)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Axes:
    """The principal axes of vectors of one length, and the cuts that deal them to tiles."""

    def __init__(self, sample: np.ndarray, rows: int, block: int):
        # largest first; the axes of x^T x, not of its deviations: the bounds are about lengths
        values, vectors = np.linalg.eigh(sample.T @ sample)
        self.turn = np.ascontiguousarray(vectors[:, np.argsort(-values, kind="stable")])
        self.lead = min(LEAD, sample.shape[1])
        self.cuts: list[tuple[int, float, int, int]] = []
        self.tiles = 0
        depth = max(0, int(np.ceil(np.log2(max(1, rows) / block))))
        self.root = self._cut(sample @ self.turn[:, : self.lead], depth)

    def _cut(self, own: np.ndarray, depth: int) -> int:
        """A node: the number of a cut, or -1 - tile."""
        spread = np.ptp(own, axis=0) if len(own) else np.zeros(1)
        if depth == 0 or len(own) < 2 or not spread.max() > 0:
            self.tiles += 1
            return -self.tiles
        axis = int(np.argmax(own.var(axis=0)))
        at = float(np.median(own[:, axis]))
        low = own[:, axis] < at
        if not low.any():
            low = own[:, axis] <= at
            at = float(np.nextafter(at, np.inf))
        node = len(self.cuts)
        self.cuts.append((axis, at, 0, 0))
        self.cuts[node] = (axis, at, self._cut(own[low], depth - 1), self._cut(own[~low], depth - 1))
        return node

    def turned(self, x: np.ndarray) -> np.ndarray:
        return unit(x) @ self.turn

    def tile(self, turned: np.ndarray) -> np.ndarray:
        out = np.full(len(turned), self.root)
        while (live := np.flatnonzero(out >= 0)).size:
            for node in np.unique(out[live]).tolist():
                axis, at, low, high = self.cuts[node]
                own = live[out[live] == node]
                out[own] = np.where(turned[own, axis] < at, low, high)
        return -1 - out

    def key(self, turned: np.ndarray) -> np.ndarray:
        """What boxes are about: the leading coordinates and the length of the rest."""
        rest = turned[:, self.lead :]
        return np.column_stack([turned[:, : self.lead], np.sqrt((rest * rest).sum(axis=1))])


def axes_of(models: dict[int, Axes], dim: int) -> Axes:
    """The axes for a length; one too rare for the sample keeps its own, in one tile."""
    if dim not in models:
        models[dim] = Axes(np.eye(dim), 1, BLOCK)
    return models[dim]


# --- comparing ---------------------------------------------------------------------------------------


class Rows:
    """Vectors of a task: as they came, turned, and what is left of each beyond some coordinates."""

    def __init__(self, raw: np.ndarray, axes: Axes):
        self.raw, self.turned = raw, axes.turned(raw)
        dim, self.steps = raw.shape[1], []
        k = min(LEAST_LEAD, dim)
        while k < dim:
            self.steps.append(k)
            k *= 2
        self.steps.append(dim)
        squares = (self.turned**2)[:, ::-1].cumsum(axis=1)[:, ::-1]
        self.rest = [np.sqrt(squares[:, k]) if k < dim else np.zeros(len(raw)) for k in self.steps]


def similar(x: Rows, own: np.ndarray, y: Rows, others: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in own and others of the pairs whose cosine reaches the threshold."""
    least = threshold - SLACK
    a, b = x.turned[own], y.turned[others]
    done = x.steps[0]
    part = a[:, :done] @ b[:, :done].T
    step = 0
    # while many pairs are open, whole tiles are multiplied
    while True:
        open_ = part + np.outer(x.rest[step][own], y.rest[step][others]) >= least
        if step + 1 == len(x.steps) or np.count_nonzero(open_) <= DENSE * open_.size:
            break
        step += 1
        part += a[:, done : x.steps[step]] @ b[:, done : x.steps[step]].T
        done = x.steps[step]
    i, j = np.nonzero(open_)
    cosine = part[i, j]
    for step in range(step + 1, len(x.steps)):
        if not len(i):
            break
        end = x.steps[step]
        cosine = cosine + np.einsum("ij,ij->i", a[i, done:end], b[j, done:end])
        done = end
        near = cosine + x.rest[step][own[i]] * y.rest[step][others[j]] >= least
        i, j, cosine = i[near], j[near], cosine[near]
    close = np.flatnonzero(cosine < threshold + SLACK)
    if len(close):
        u, v = x.raw[own[i[close]]], y.raw[others[j[close]]]
        exact = (u * v).sum(axis=1) / (np.sqrt((u * u).sum(axis=1)) * np.sqrt((v * v).sum(axis=1)))
        keep = np.ones(len(i), bool)
        keep[close] = exact >= threshold
        i, j = i[keep], j[keep]
    return i, j


class Cell:
    """A block of a tile and some of its visitors: links per row, and the edges of a forest."""

    def __init__(self, sizes: list[np.ndarray], threshold: float):
        self.sizes, self.threshold = sizes, threshold
        self.links = [np.zeros(len(s), np.int64) for s in sizes]
        self.first = [0, len(sizes[0])]
        self.root = np.arange(sum(len(s) for s in sizes))

    def compare(self, x: Rows, y: Rows, kx: int, ky: int) -> None:
        """All pairs of x and y; those of y with itself where both are one."""
        reach = np.sqrt(2 - 2 * self.threshold) + 1e-6
        axis = int(np.argmax(y.turned.var(axis=0)))
        by, order = np.argsort(y.turned[:, axis], kind="stable"), np.argsort(x.turned[:, axis], kind="stable")
        edge = y.turned[by, axis]
        for a in range(0, len(order), TILE):
            own = order[a : a + TILE]
            low, high = x.turned[own[[0, -1]], axis]
            start, end = np.searchsorted(edge, [low - reach, high + reach])
            start = a if x is y else int(start)
            for b in range(start, int(end), 16 * TILE):
                others = by[b : min(b + 16 * TILE, int(end))]
                i, j = similar(x, own, y, others, self.threshold)
                if x is y:
                    later = b + j > a + i
                    i, j = i[later], j[later]
                self.put(own[i], others[j], kx, ky)

    def put(self, i: np.ndarray, j: np.ndarray, kx: int, ky: int) -> None:
        if not len(i):
            return
        for k, at, other, of in ((kx, i, j, ky), (ky, j, i, kx)):
            self.links[k] += np.bincount(at, weights=self.sizes[of][other], minlength=len(self.sizes[k])).astype(np.int64)
        u, v = self.root[self.first[kx] + i], self.root[self.first[ky] + j]
        apart = u != v
        if apart.any():
            low = np.arange(len(self.root))
            nodes, roots = forest(u[apart], v[apart])
            low[nodes] = roots
            self.root = low[self.root]


def _compare(models: dict[int, Axes], threshold: float):
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])

    def run(key, left, right):
        if not left.num_rows:
            return schema.empty_table()
        dim, portion = key[0].as_py(), key[3].as_py()
        axes = axes_of(models, dim)
        tables = [left, right] if right.num_rows else [left]
        cell = Cell([t.column("size").to_numpy() for t in tables], threshold)
        rows = [Rows(unpacked(t.column("v").to_pylist(), dim), axes) for t in tables]
        if portion == 0:
            cell.compare(rows[0], rows[0], 0, 0)
        if len(rows) > 1:
            cell.compare(rows[1], rows[0], 1, 0)
        digests = [d for t in tables for d in t.column("digest").to_pylist()]
        reps = np.concatenate([t.column("rep").to_numpy() for t in tables])
        links = np.concatenate(cell.links)
        own, far = np.flatnonzero(links), np.flatnonzero(cell.root != np.arange(len(cell.root)))
        none = lambda n, t: pa.nulls(n, t)
        counts = pa.table([pa.array([digests[k] for k in own.tolist()], pa.binary()), pa.array(links[own]), none(len(own), pa.int64()), none(len(own), pa.int64())], schema=schema)
        edges = pa.table([none(len(far), pa.binary()), none(len(far), pa.int64()), pa.array(reps[far]), pa.array(reps[cell.root[far]])], schema=schema)
        return pa.concat_tables([counts, edges])

    return run


# --- tiles -------------------------------------------------------------------------------------------


def _place(models: dict[int, Axes]):
    def run(batches):
        for batch in K.portions(batches):
            dims = batch.column("dim").to_numpy()
            packed, tiles = batch.column("v").to_pylist(), np.zeros(len(dims), np.int32)
            for dim in np.unique(dims).tolist():
                at, axes = np.flatnonzero(dims == dim), axes_of(models, dim)
                tiles[at] = axes.tile(axes.turned(unpacked([packed[k] for k in at.tolist()], dim)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tiles)], names=[*batch.schema.names, "tile"])

    return run


def _boxes(models: dict[int, Axes]):
    """(dim, tile, k, low, high) of the rows of a task."""

    def run(batches):
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in K.portions(batches):
            dims, tiles = batch.column("dim").to_numpy(), batch.column("tile").to_numpy()
            packed = batch.column("v").to_pylist()
            for dim in np.unique(dims[np.isin(dims, list(models))]).tolist():
                at, axes = np.flatnonzero(dims == dim), models[dim]
                keys = axes.key(axes.turned(unpacked([packed[k] for k in at.tolist()], dim)))
                for tile in np.unique(tiles[at]).tolist():
                    own = keys[tiles[at] == tile]
                    low, high = own.min(axis=0), own.max(axis=0)
                    if (dim, tile) in held:
                        low, high = np.minimum(low, held[dim, tile][0]), np.maximum(high, held[dim, tile][1])
                    held[dim, tile] = (low, high)
        rows = [(d, t, k, float(a), float(b)) for (d, t), (low, high) in held.items() for k, (a, b) in enumerate(zip(low, high, strict=True))]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["dim", "tile", "k", "low", "high"])

    return run


def _visits(models: dict[int, Axes], boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], threshold: float, counted: bool):
    """The rows of a task under the tiles that they visit; or only how many visit each."""
    reach = 2 - 2 * threshold + 1e-6
    names = ["dim", "tile", "n"] if counted else ["dim", "tile", "digest", "rep", "size", "v"]

    def run(batches):
        for batch in K.portions(batches):
            dims, tiles = batch.column("dim").to_numpy(), batch.column("tile").to_numpy()
            packed, who, to = batch.column("v").to_pylist(), [], []
            for dim in np.unique(dims[np.isin(dims, list(boxes))]).tolist():
                ids, low, high = boxes[dim]
                at, axes = np.flatnonzero(dims == dim), models[dim]
                keys = axes.key(axes.turned(unpacked([packed[k] for k in at.tolist()], dim)))
                for a in range(0, len(at), TILE):
                    own = keys[a : a + TILE, None]
                    gap = np.maximum(0.0, np.maximum(low - own, own - high))
                    i, j = np.nonzero(((gap * gap).sum(axis=2) <= reach) & (ids > tiles[at[a : a + TILE], None]))
                    who.append(at[a + i])
                    to.append(ids[j])
            who, to = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (who, to))
            if counted:
                keys, n = np.unique(np.column_stack([dims[who], to]), axis=0, return_counts=True) if len(who) else (np.empty((0, 2), np.int64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0], pa.int32()), pa.array(keys[:, 1], pa.int32()), pa.array(n, pa.int64())], names=names)
                continue
            for a in range(0, len(who), 4_096):
                rows = batch.take(pa.array(who[a : a + 4_096]))
                yield pa.RecordBatch.from_arrays([rows.column("dim"), pa.array(to[a : a + 4_096], pa.int32()), *(rows.column(c) for c in names[2:])], names=names)

    return run


def embedding_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = written(own.mapInArrow(_pack, "vec_id long, digest binary, dim int, v binary"), "vectors")
    full = rows.where("digest is not null and vec_id is not null")
    first = full.groupBy("digest").agg(F.min(F.struct("vec_id", "dim", "v")).alias("r"), F.count("*").alias("size"))
    classes = written(first.select("digest", F.col("r.vec_id").alias("rep"), "r.dim", "r.v", "size"), "classes")
    # axes of a bounded sample
    models: dict[int, Axes] = {}
    sample = classes.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("dim", "v").collect()
    lengths = sorted({r.dim for r in sample})
    rows_of = {r.dim: r["count"] for r in classes.where(F.col("dim").isin(lengths)).groupBy("dim").count().collect()}
    for dim in lengths:
        models[dim] = Axes(unit(unpacked([bytes(r.v) for r in sample if r.dim == dim], dim)), rows_of[dim], BLOCK)
    placed = written(classes.mapInArrow(_place(models), "digest binary, rep long, dim int, v binary, size long, tile int"), "placed")
    drop(classes)
    # boxes: as many tiles as the sample has vectors, at most
    found = placed.mapInArrow(_boxes(models), "dim int, tile int, k int, low double, high double").groupBy("dim", "tile", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    held: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    for r in found.collect():
        held.setdefault(r.dim, {}).setdefault(r.tile, {})[r.k] = (r.low, r.high)
    boxes = {}
    for dim, tiles in held.items():
        ids = sorted(tiles)
        edges = np.array([[tiles[t][k] for k in range(len(tiles[t]))] for t in ids])
        boxes[dim] = (np.array(ids), edges[:, :, 0], edges[:, :, 1])
    visits = lambda counted, ddl: placed.mapInArrow(_visits(models, boxes, threshold, counted), ddl)
    # the cells: blocks of a tile and portions of its visitors
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (F.col("dim") * 8))))
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    guests = visits(True, "dim int, tile int, n long").groupBy("dim", "tile").agg(F.sum("n").alias("guests"))
    tiles = placed.groupBy("dim", "tile").agg(F.count("*").alias("hosts")).join(guests, ["dim", "tile"], "left")
    tiles = tiles.select("dim", "tile", parts(F.col("hosts")).alias("blocks"), parts(F.coalesce("guests", F.lit(0))).alias("portions"))
    tiles = written(tiles, "tiles")
    spread = lambda n, salt: F.pmod(F.xxhash64("digest", F.lit(salt)), F.col(n)).cast("int")
    up_to = lambda a, n: F.explode(F.filter(F.sequence(F.lit(0), F.col(n) - 1), lambda x: x >= a))
    keep = ["digest", "rep", "size", "v"]
    home = placed.join(tiles, ["dim", "tile"]).withColumn("block", spread("blocks", 1))
    hosts = home.select("dim", "tile", "block", up_to(F.lit(0), "portions").alias("portion"), *keep)
    come = visits(False, "dim int, tile int, digest binary, rep long, size long, v binary").join(tiles, ["dim", "tile"])
    come = come.select("dim", "tile", spread("portions", 2).alias("portion"), up_to(F.lit(0), "blocks").alias("block"), *keep)
    # within a tile, earlier blocks visit later ones
    inner = home.select("dim", "tile", spread("portions", 2).alias("portion"), up_to(F.col("block") + 1, "blocks").alias("block"), *keep)
    cell = ["dim", "tile", "block", "portion"]
    cells = hosts.groupBy(*cell).cogroup(come.unionByName(inner).groupBy(*cell))
    pairs = written(cells.applyInArrow(_compare(models, threshold), "digest binary, n long, u long, v long"), "pairs")
    # rows that share a vec_id are one vertex
    same = full.groupBy("vec_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("vec_id")
    twins = full.join(same, "vec_id").join(placed.select("digest", "rep"), "digest").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    stars = connected_components(pairs.where("digest is null").select("u", "v").unionByName(twins))
    per = pairs.where("digest is not null").groupBy("digest").agg(F.sum("n").alias("n"))
    result = placed.select("digest", "rep", "size").join(per, "digest", "left").join(stars.withColumnRenamed("node", "rep"), "rep", "left")
    result = written(result.select("digest", "rep", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("links"), "component"), "classes")
    for table in (pairs, stars, tiles, placed):
        drop(table)
    out = rows.select("vec_id", "digest").join(result, "digest", "left")
    label = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    links = F.when(F.col("vec_id").isNotNull(), F.coalesce("links", F.lit(0))).otherwise(0).cast("long")
    return out.select("vec_id", links.alias("n_links"), label.alias("component_id"), F.coalesce(F.col("vec_id") == label, F.lit(True)).alias("kept"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return embedding_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP12_SQL = f"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS s, len(v) AS d FROM e WHERE list_dot_product(v, v) > 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.s * b.s) >= {THRESHOLD}),
r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT r.vec_id, l.v FROM r JOIN l ON r.c = l.u),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.u = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM m
"""
