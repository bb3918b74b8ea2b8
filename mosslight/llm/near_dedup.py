"""Near-duplicate documents by a chosen-path set similarity join.

Method. Each distinct shingle set gets a signature of minwise values. A tree starts with all sets
in one node and branches them by the values of two selected coordinates at once. From there on a
node of more than `LEAF` sets branches again: it selects `PATHS` coordinates that its path has not used
and goes on with the sets that agree in one of them, so a set follows two paths and a pair of similarity s
2s paths, more than one where s is above one half. Nodes of up to `LEAF` sets are compared
exhaustively. Before a node branches, its most central sets (those with most of the node's common
values) are compared with all others, and a node whose sets are all linked ends there: groups of near
copies, which no coordinate would part, cost their size. A pair at 0.85 meets below a root with probability 0.72,
one at 0.8 with 0.64, and both survive branching to any depth with 0.94 or more; twelve independent trees
miss a pair at 0.8 with 2e-5 at most. Sets of similarity 0.5 share 1.3 times fewer
sets at each level than they are cut into, so such a family costs less than its square.
Nodes are walked twice. The first walk compares signatures only and
splits every node into groups of sets that may be linked (pairs five standard deviations below the
threshold are left out). The second walk compares the full shingle sets within these groups; only
that makes a link.

Scale. Documents with equal sets are folded into one class first, by a digest. Only classes with a
similar signature go to the second walk, and only their sets are gathered; a group that several
trees find alike is compared once. The first trees' links are turned into components; later trees
drop every group that lies in one component, so that a group of copies costs links in proportion
to its size and not to its square. Nodes too large for a task branch in the cluster, level by level, as
long as that parts them; what can't be parted is cut in blocks, and each pair of blocks is compared, so
that no pair is lost. The ids of the gathered sets are broadcast up to `BROADCAST_ROWS` of them, and
joined by a shuffle beyond.

Edge cases: null and empty texts and texts without words have no shingles and link with nothing,
not even with each other. Rows with equal doc_id count as one vertex, whose links join; repeated
rows are in the result as often as in the input. A null doc_id takes no part and keeps a null
component and kept = true. A pair at exactly the threshold is linked. A very long text is one set
of all its shingles. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .components import connected_components
from .scratch import drop, written

#: Percent. Two texts are near duplicates from THRESHOLD on; the contract of the op7 query says OP7_THRESHOLD.
SHINGLE, THRESHOLD, OP7_THRESHOLD = 5, 80, 85
COORDS, TREES, FIRST_TREES = 64, 12, 2
LEAF, TILE, CENTRE, PATHS = 1024, 64, 16, 2
#: Levels that nodes beyond a task's bound branch in the cluster, at most.
DEPTH = 12
#: A child with this share of its node's members isn't parted further.
HARDLY = 0.9
NODE_ROWS, NODE_BYTES = 20_000, 48 << 20
BROADCAST_ROWS = 1_000_000
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles."""
    for i, j, data, offs in K.text_slices(texts):
        data = K.LOWER[data]
        starts, ends, rows = K.word_spans(data, offs, K.SPACED)
        words = K.span_hashes(data, starts, ends)
        grams = K.kgrams(words, k)
        base = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=j - i))]).tolist()
        for r in range(j - i):
            a, b = base[r], base[r + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield np.array([K.sequence_hash(words[a:b])], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """COORDS minwise values, 32 bits each."""
    out = np.full(COORDS, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(s), 4096):
        out = np.minimum(out, (((s[i : i + 4096, None] ^ _XOR) * _MUL) >> np.uint64(32)).min(axis=0))
    return out.astype(np.uint32)


def _features(batches):
    for batch in K.portions(batches):
        ids, n, digests, sigs, roots = batch.column(0), [], [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            sig = signature(s)
            # 16 bits of each value are enough to compare; a root's key is made from two whole ones
            sigs.append(sig.astype("<u2").tobytes() if len(s) else None)
            two = sig[: 2 * TREES].astype(np.uint64)
            keys = K.mix64((two[::2] << np.uint64(32) | two[1::2]) + np.arange(1, TREES + 1, dtype=np.uint64) * K._MULT[0])
            roots.append(keys.view(np.int64).tolist() if len(s) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(roots, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "digest", "sig", "roots"])


def _sets(batches):
    for batch in K.portions(batches):
        rows = [(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s.tobytes()) for s in shingle_sets(batch.column(1)) if len(s)]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.binary()), pa.array([s for _, s in rows], pa.binary())], names=["digest", "items"])


def linked(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether 100 * |a and b| >= threshold * |a or b|, for sorted sets without repeats."""
    if 100 * min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (len(a) + len(b) - common)


def path_coordinates(node: int, used: list[int]) -> list[int]:
    """The coordinates that a node branches by: selected at random for each node, other ones than its path has used."""
    order = np.random.Generator(np.random.PCG64(node & (1 << 63) - 1)).permutation(COORDS).tolist()
    return [c for c in order if c not in used][:PATHS]


def child_key(node: int, coordinate: int, value: int) -> int:
    """The name of the node that follows by one coordinate's value."""
    return int(K.mix64(np.array([node & (1 << 64) - 1], np.uint64) * K._MULT[1] + np.uint64(coordinate << 16 | value)).view(np.int64)[0])


class _Node:
    """The members of one node in a task: branch, compare, and give the links that join components."""

    def __init__(self, reps: list, sigs: list[bytes], sets: list[bytes] | None, comps: list, threshold: int = THRESHOLD, key: int = 0, used: list[int] | None = None):
        self.key, self.used = key, used or []
        self.reps, self.threshold = reps, threshold
        self.sig = np.frombuffer(b"".join(sigs), "<u2").reshape(-1, COORDS)
        self.sets = None if sets is None else [np.frombuffer(s, np.uint64) for s in sets]
        self.n = None if sets is None else np.array([len(s) for s in self.sets])
        first: dict[int, int] = {}
        self.root = np.array([first.setdefault(c, i) for i, c in enumerate(comps)])
        self.links: list[tuple[int, int]] = []

    def least(self) -> float:
        """Equal coordinates below which a pair is left out: five standard deviations below the threshold."""
        p = self.threshold / 100
        return COORDS * (p - 5 * (p * (1 - p) / COORDS) ** 0.5)

    def compare(self, i: int, others: np.ndarray) -> None:
        """Link i with those of others that are in another component and similar (on full sets, where they are given)."""
        least = self.least()
        others = others[self.root[others] != self.root[i]]
        if not len(others):
            return
        near = (self.sig[others] == self.sig[i]).sum(axis=1) >= least
        if self.sets is not None:
            n, m = self.n[i], self.n[others]
            near &= 100 * np.minimum(n, m) >= self.threshold * np.maximum(n, m)
        for j in others[near].tolist():
            if self.root[j] != self.root[i] and (self.sets is None or linked(self.sets[i], self.sets[j], self.threshold)):
                self.links.append((self.reps[i], self.reps[j]))
                self.root[self.root == self.root[j]] = self.root[i]

    def run(self) -> list[tuple[int, int]]:
        n = len(self.reps)
        if n <= (LEAF if self.sets is None else TILE):
            at = np.arange(n)
            for k in range(n - 1):
                self.compare(k, at[k + 1 :])
        else:
            # the members nearest to the most common values first: the centre of a star joins it at once
            if self.sets is None:
                self._branch(np.arange(n), self.key, self.used)
            else:
                self._indexed(self._central(np.arange(n)))
        return self.links

    def _central(self, own: np.ndarray) -> np.ndarray:
        """Members of a node, those with its most common values first."""
        sig = self.sig[own]
        common = np.zeros(len(own), np.int64)
        for col in sig.T:
            common += col == np.bincount(col).argmax()
        return own[np.argsort(-common, kind="stable")]

    def _branch(self, own: np.ndarray, key: int, used: list[int]) -> None:
        """Chosen paths: the node's centre with all its members, then the members that agree in a selected coordinate, until nodes are small."""
        todo = [(own, key, used)]
        while todo:
            own, key, used = todo.pop()
            next_ = [] if len(own) <= LEAF else path_coordinates(key, used)
            if not next_:
                self._tiles(own, len(own))
                continue
            self._tiles(self._central(own), CENTRE)
            if (self.root[own] == self.root[own[0]]).all():
                continue
            for c in next_:
                by = own[np.argsort(self.sig[own, c], kind="stable")]
                edges = np.flatnonzero(np.diff(self.sig[by, c])) + 1
                for child in np.split(by, edges):
                    if len(child) > 1 and (self.root[child] != self.root[child[0]]).any():
                        todo.append((child, child_key(key, c, int(self.sig[child[0], c])), [*used, *next_]))

    def _join(self, i: int, others: np.ndarray) -> None:
        """Link i with others, one of each component."""
        _, first = np.unique(self.root[others], return_index=True)
        self.links += [(self.reps[i], self.reps[j]) for j in others[first].tolist()]
        self.root[np.isin(self.root, self.root[others])] = self.root[i]

    def _tiles(self, order: np.ndarray, first: int) -> None:
        """Pairs by signatures of the first members with all later ones, TILE of them at a time."""
        least = self.least()
        for a in range(0, min(first, len(order)), TILE):
            own, rest = order[a : min(a + TILE, first)], order[a:]
            if (self.root[own] == self.root[own[0]]).all():
                rest = rest[self.root[rest] != self.root[own[0]]]
            if not len(rest):
                continue
            x, y = np.ascontiguousarray(self.sig[own].T), np.ascontiguousarray(self.sig[rest].T)
            same = np.zeros((len(own), len(rest)), np.uint8)
            for c in range(COORDS):
                same += x[c, :, None] == y[c]
            for i, near in zip(own.tolist(), same >= least, strict=True):
                others = rest[near]
                others = others[self.root[others] != self.root[i]]
                if len(others):
                    self._join(i, others)

    def _indexed(self, order: np.ndarray) -> None:
        """All pairs by full sets: what a member shares with every other one, counted over the members of each shingle."""
        edges = np.concatenate([[0], np.cumsum(self.n)])
        item = np.unique(np.concatenate(self.sets), return_inverse=True)[1].astype(np.int32)
        by = np.argsort(item, kind="stable")
        owner = np.repeat(np.arange(len(self.n), dtype=np.int32), self.n)[by]
        del by
        size = np.bincount(item)
        first = np.cumsum(size) - size
        for i in order.tolist():
            if (self.root == self.root[i]).all():
                break
            own = item[edges[i] : edges[i + 1]]
            own = own[size[own] > 1]
            count = size[own]
            at = np.repeat(first[own] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            common = np.bincount(owner[at], minlength=len(self.n))
            others = np.flatnonzero((100 * common >= self.threshold * (self.n[i] + self.n - common)) & (self.root != self.root[i]))
            if len(others):
                self._join(i, others)


def _walk(columns: tuple[str, ...], solve, schema: pa.Schema):
    """solve(node, *columns) of each node with two members at least. Rows come sorted by node, and a node lies in one partition."""

    def run(batches):
        key, held = None, [[] for _ in columns]

        def close():
            return solve(key, *held) if len(held[0]) > 1 else []

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for batch in batches:
            rows = []
            for node, *row in zip(*(batch.column(c).to_pylist() for c in ("node", *columns)), strict=True):
                if node != key:
                    rows += close()
                    key, held = node, [[] for _ in columns]
                for k, x in enumerate(row):
                    held[k].append(x)
            yield out(rows)
        yield out(close())
        held = [[] for _ in columns]
        K.give_back()

    return run


def _similar(node: int, trees: list[int], digests: list[bytes], sigs: list[bytes], threshold: int = THRESHOLD) -> list[tuple[int, int, bytes]]:
    """(tree, group, digest) of the classes that may be linked; equal groups of different trees get equal names."""
    # the root's coordinates agree already
    found = _Node(digests, sigs, None, digests, threshold, node, sorted({c for t in set(trees) for c in (2 * t, 2 * t + 1)}))
    found.run()
    groups: dict[int, list[int]] = {}
    for i, r in enumerate(found.root.tolist()):
        groups.setdefault(r, []).append(i)
    out = []
    for own in groups.values():
        if len(own) > 1:
            name = int.from_bytes(hashlib.blake2b(b"".join(sorted(digests[i] for i in own)), digest_size=8).digest(), "little", signed=True)
            out += [(trees[i], name, digests[i]) for i in own]
    return out


def _verify(node: int, reps: list[int], sigs: list[bytes], sets: list[bytes], comps: list[int], threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    return _Node(reps, sigs, sets, comps, threshold).run()


def _bounded(members: DataFrame) -> DataFrame:
    """members(node, digest, rows, bytes, ...), with the totals of their nodes, as nodes that one task can hold: large ones are cut in blocks, and each pair of blocks is a node."""
    parts = F.greatest(F.ceil(F.col("rows") * 2 / NODE_ROWS), F.ceil(F.col("bytes") * 2 / NODE_BYTES)).cast("int")
    parts = F.when((F.col("rows") > NODE_ROWS) | (F.col("bytes") > NODE_BYTES), parts).otherwise(1)
    block = members.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
    # a pair of blocks compares each of the two within itself as well
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: (x != F.col("own")) | (F.col("parts") == 1))
    block = block.withColumn("other", F.explode(others))
    pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return block.withColumn("node", F.when(F.col("parts") == 1, F.col("node")).otherwise(pair)).drop("parts", "own", "other", "rows", "bytes")


def _children(batches):
    """Members of a node under the nodes that follow it."""
    names = ["tree", "node", "digest", "sig", "used", "rows"]
    for batch in K.portions(batches):
        out: list[list] = [[] for _ in names]
        for tree, node, digest, sig, used, rows in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            values, chosen = np.frombuffer(sig, "<u2"), path_coordinates(node, used)
            for c in chosen:
                for col, x in zip(out, (tree, child_key(node, c, int(values[c])), digest, sig, [*used, *chosen], rows), strict=True):
                    col.append(x)
        types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)


def _parted(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """members(tree, node, digest, rows) with the nodes beyond NODE_ROWS branched, level by level.

    A child with nearly all members of its node isn't branched on: what its members share no coordinate parts.
    """
    columns = ["tree", "node", "digest", "rows"]
    done, large = members.where(F.col("rows") <= NODE_ROWS).select(*columns), members.where(F.col("rows") > NODE_ROWS)
    if large.isEmpty():
        return done
    root = F.transform(F.array(F.lit(0), F.lit(1)), lambda x: F.col("tree") * 2 + x)
    large = large.select(*columns, root.alias("used")).join(sigs, "digest")
    for _ in range(DEPTH):
        child = written(large.mapInArrow(_children, "tree int, node long, digest binary, sig binary, used array<int>, rows long"), "children")
        size = child.groupBy("node").agg(F.count("*").alias("own"), F.max("rows").alias("parent")).where("own > 1")
        child = child.drop("rows").join(size, "node").withColumnRenamed("own", "rows")
        on = (F.col("rows") > NODE_ROWS) & (F.col("rows") < F.col("parent") * HARDLY)
        done = done.unionByName(child.where(~on).select(*columns))
        large = child.where(on).drop("parent")
        if large.isEmpty():
            return done
    return done.unionByName(large.select(*columns))


def _by_node(rows: DataFrame, solve, columns: tuple[str, ...], schema: pa.Schema, ddl: str) -> DataFrame:
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("node", *columns).repartition(partitions, "node").sortWithinPartitions("node").mapInArrow(_walk(columns, solve, schema), ddl)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs; the mapping is over all pairs of rows with threshold percent in common."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = written(docs.mapInArrow(_features, "doc_id long, n_shingles long, digest binary, sig binary, roots array<long>"), "features")
    full = rows.where("digest is not null and doc_id is not null")
    first = full.groupBy("digest").agg(F.min(F.struct("doc_id", "sig", "roots", "n_shingles")).alias("r"))
    classes = written(first.select("digest", F.col("r.doc_id").alias("rep"), "r.sig", "r.roots", F.col("r.n_shingles").alias("n")), "classes")
    sigs = classes.select("digest", "sig")
    # first walk: signatures
    rooted = classes.select("digest", F.posexplode("roots").alias("tree", "node"))
    shared = rooted.groupBy("node").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = written(rooted.join(shared, "node"), "shared")
    members = written(_bounded(_parted(shared, sigs).withColumn("bytes", F.col("rows") * 2 * COORDS)), "members")
    drop(shared)
    near = _by_node(members.join(sigs, "digest"), partial(_similar, threshold=threshold), ("tree", "digest", "sig"), pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("digest", pa.binary())]), "tree int, node long, digest binary")
    near = written(near.groupBy("node", "digest").agg(F.min("tree").alias("tree")), "near")
    drop(members)
    groups = near.join(classes.select("digest", "rep", "n"), "digest")
    total = groups.groupBy("node").agg(F.count("*").alias("rows"), (F.sum("n") * 8).alias("bytes"), F.min("tree").alias("tree"))
    groups = written(groups.select("node", "digest", "rep").join(total, "node"), "groups")
    drop(near)
    # the sets of what is left
    active = written(groups.select("rep").distinct(), "active")
    wanted = F.broadcast(active) if active.count() <= BROADCAST_ROWS else active
    sets = docs.join(wanted, docs.doc_id == wanted.rep, "left_semi").mapInArrow(_sets, "digest binary, items binary")
    sets = written(sets.dropDuplicates(["digest"]).join(sigs, "digest"), "sets")
    drop(active)
    # second walk: full sets
    same_id = full.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    links = full.join(same_id, "doc_id").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    comp = None
    for some in (F.col("tree") < FIRST_TREES, F.col("tree") >= FIRST_TREES):
        part, open_ = groups.where(some).drop("tree"), None
        if comp is None:
            part = part.withColumn("comp", F.col("rep"))
        else:
            part = part.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
            apart = part.groupBy("node").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("node")
            part = open_ = written(part.join(apart, "node", "left_semi"), "open")
        pairs = _by_node(_bounded(part).join(sets, "digest"), partial(_verify, threshold=threshold), ("rep", "sig", "items", "comp"), pa.schema([("u", pa.int64()), ("v", pa.int64())]), "u long, v long")
        # components known so far stand for the links that made them
        before = links if comp is None else comp.select(F.col("node").alias("u"), F.col("component").alias("v"))
        found = written(before.unionByName(pairs), "links")
        stars = connected_components(found)
        known, comp = comp, written(stars, "components")
        for table in (found, known, open_, stars):
            drop(table)
    drop(sets)
    drop(groups)
    final = rows.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left")
    final = final.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    label = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return final.select("doc_id", "n_shingles", label.alias("component_id"), F.coalesce(F.col("doc_id") == label, F.lit(True)).alias("kept"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), threshold=OP7_THRESHOLD)


OP7_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {SHINGLE} + 2), lambda i: array_to_string(ws[i : i + {SHINGLE - 1}], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
x AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= {OP7_THRESHOLD} * (a.n + b.n - c)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.c = e.u),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN m USING (doc_id)
"""
