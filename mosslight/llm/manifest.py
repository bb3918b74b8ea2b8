"""Merkle dataset manifest: one root for a dataset, and for every row the proof that it belongs to it.

Method. Each row is a leaf, the sha256 of its fields with their lengths. Leaves are numbered within
their group (a language); the size of a group tells how many children each node of its tree has. A
task combines by key: a partial parent accumulates its children's digests by index, and when the
last one arrives it becomes an event itself, a child of its own parent. What a task can't complete,
its frontier, is dealt again by wider and wider spans of leaves until only the subroots are left.
Every completed parent leaves a reverse link to its children. The links are followed from the root
down, three levels at a time: a node's proof is its siblings' digests, then those of its parent.

Hashes are lowercase hexadecimal text, parents hash the concatenated text of their children. Eight
consecutive nodes have one parent; the last run of a level may be shorter, even one node. Groups
are ordered by name, null first, and their subroots make up a tree in the same way.

Scale. Texts are read once and leave their task as digests. Rows are ordered by a range partitioning and
numbered from the counts of its partitions; sorted pieces complete nearly all parents in the first
pass, so that a frontier holds some rows per piece and level. Links take 73 bytes per leaf. Proofs are
made in blocks of 512 leaves, from the block's links and one row of what lies above it.

Edge cases: nulls in any field hash as '-', which no value does; null doc_ids come first in their group.
Rows with one doc_id are ordered by their leaves' digests, so that the roots don't depend on how rows are stored; rows equal
in all fields are leaves of their own. Empty and very long texts are hashed whole. A group of one
row has that leaf as its subroot; a single group's subroot is the root. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import drop, written

ARITY, BITS = 8, 3
#: Levels that a round of the frontier completes, and levels of a block of proofs.
SPAN, BLOCK = 4, 3
#: Partial parents that a task holds; beyond that their children go to the frontier.
PARTIALS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODES = "tree long, level int, at long, n long, digest string, children string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above the leaves of a tree with n of them."""
    out = 0
    while n > 1:
        n, out = (n + ARITY - 1) // ARITY, out + 1
    return out


def width(n: int, level: int) -> int:
    """Nodes of a level; level 0 are the leaves."""
    return -(-n >> BITS * level) if n else 0


def leaf(fields: list[Column]) -> Column:
    part = lambda c: F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in fields]), 256)


# --- the order of the leaves -----------------------------------------------------------------------


def _counted(batches):
    """Rows with the number of their partition and their place in it."""
    part, place = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(place, place + n), pa.int64())], names=[*batch.schema.names, "part", "place"])
        place += n


def numbered(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with `place`, their number in the order of `by` (nulls first, from 0).

    Sorted in ranges; only one count per range is summed in one task. Rows equal in `by` are told apart by
    where they are stored (`rows` must be a written table), so a value of any frequency is dealt over ranges.
    """
    tie = F.monotonically_increasing_id()
    ranged = rows.withColumn("_tie", tie).repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie").drop("_tie")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    out = written(ranged.mapInArrow(_counted, f"{ddl}, part int, place long"), "numbered")
    ends = out.groupBy("part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # written: its size is known when the join is planned
    placed = out.join(written(ends.select("part", before.alias("start")), "starts"), "part").withColumn("place", F.col("place") + F.col("start")).drop("part", "start")
    placed._scratch_path = out._scratch_path
    return placed


# --- bottom up -------------------------------------------------------------------------------------


class Combiner:
    """Partial parents of a task by (tree, level, index): children by index until the size-derived arity is met."""

    def __init__(self):
        self.open: dict[tuple[int, int, int], tuple[int, int, dict[int, str]]] = {}
        self.out: list[tuple] = []

    def add(self, tree: int, level: int, at: int, n: int, digest: str) -> None:
        """A node arrives; it may complete its parent, which then arrives itself."""
        while True:
            below = width(n, level)
            if below <= 1:
                self.out.append((tree, level, at, n, digest, None))
                return
            key = (tree, level + 1, at >> BITS)
            known = self.open.get(key)
            if known is None:
                known = self.open[key] = (n, min(ARITY, below - (at >> BITS << BITS)), {})
            known[2][at & ARITY - 1] = digest
            if len(known[2]) < known[1]:
                if len(self.open) > PARTIALS:
                    self.release()
                return
            del self.open[key]
            children = "".join([known[2][k] for k in range(known[1])])
            level, at, digest = level + 1, at >> BITS, sha(children)
            self.out.append((tree, level, at, n, digest, children))

    def release(self) -> None:
        """What is incomplete becomes the frontier."""
        for (tree, level, parent), (n, _, children) in self.open.items():
            self.out += [(tree, level - 1, (parent << BITS) + k, n, d, None) for k, d in children.items()]
        self.open.clear()

    def take(self) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*self.out, strict=True)) or [[]] * 6
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["tree", "level", "at", "n", "digest", "children"])


def _combine(batches):
    own = Combiner()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("tree", "level", "at", "n", "digest")), strict=True):
            own.add(*row)
        yield own.take()
    own.release()
    yield own.take()


def build(leaves: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(subroots, links) of leaves(tree, at, n, digest); `most` is the largest n.

    subroots(tree, n, digest) has a row per tree; links(tree, level, at, n, children) one per parent.
    """
    columns = ["tree", "level", "at", "n", "digest"]
    passes = [written(leaves.select("tree", F.lit(0).alias("level"), "at", "n", "digest").mapInArrow(_combine, NODES), "nodes")]
    spans = range(SPAN, levels(most) + SPAN, SPAN)
    for span in spans:
        front = passes[-1].where("children is null").select(*columns)
        # all nodes below one span of leaves meet; the last span holds whole trees
        span_of = F.expr(f"shiftright(shiftleft(at, level * {BITS}), {min(BITS * span, 62)})")
        passes.append(written(front.repartition("tree", span_of).mapInArrow(_combine, NODES), "nodes"))
    links = None
    for p in passes:
        own = p.where("children is not null").select("tree", "level", "at", "n", "children")
        links = own if links is None else links.unionByName(own)
    return passes[-1].where("children is null").select("tree", "n", "digest"), links


# --- top down --------------------------------------------------------------------------------------


def siblings(children: str, k: int) -> str:
    """The digests of a run without the k-th."""
    return children[: 64 * k] + children[64 * (k + 1) :]


def fold(digest: str, at: int, n: int, path: str, start: int = 0) -> tuple[str, int]:
    """The subroot that a leaf and its siblings give, and where in the path they end."""
    while n > 1:
        k, size = at & ARITY - 1, min(ARITY, n - (at >> BITS << BITS))
        end = start + 64 * (size - 1)
        digest = sha(path[start : start + 64 * k] + digest + path[start + 64 * k : end])
        at, n, start = at >> BITS, (n + ARITY - 1) >> BITS, end
    return digest, start


def _path(at: int, level: int, top: int, links: dict[tuple[int, int], str]) -> str:
    """Siblings of a node at `level` and of its ancestors below `top`."""
    out = []
    while level < top:
        out.append(siblings(links[level + 1, at >> BITS], at & ARITY - 1))
        level, at = level + 1, at >> BITS
    return "".join(out)


def _block(table: pa.Table, level: int) -> tuple[dict[tuple[int, int], str], str, int, int]:
    """Links of a block, the path above it, its tree's size, and the level at which that path begins."""
    links, above, n = {}, "", 0
    for kind, lvl, at, size, text in zip(*(table.column(c).to_pylist() for c in ("kind", "level", "at", "n", "text")), strict=True):
        n = size
        if kind == 0:
            links[lvl, at] = text
        else:
            above = text
    return links, above, n, min(levels(n), level + BLOCK)


def _down(level: int) -> Callable:
    def run(key, table):
        links, above, n, top = _block(table, level)
        first = key[1].as_py() << BITS * (top - level)
        own = range(first, min(width(n, level), first + (1 << BITS * (top - level))))
        k = len(own)
        return pa.table({"tree": pa.array([key[0].as_py()] * k, pa.int64()), "at": pa.array(own, pa.int64()), "n": pa.array([n] * k, pa.int64()), "text": pa.array([_path(i, level, top, links) + above for i in own], pa.string())})

    return run


def _above(links: DataFrame, above: DataFrame, level: int) -> DataFrame:
    """Links of the levels that follow `level`, and the paths above them, by tree and block."""
    top = level + BLOCK
    own = links.where((F.col("level") > level) & (F.col("level") <= top)).select("tree", F.expr(f"shiftright(at, ({top} - level) * {BITS})").alias("block"), F.lit(0).alias("kind"), "level", "at", "n", F.col("children").alias("text"))
    return own.unionByName(above.select("tree", F.col("at").alias("block"), F.lit(1).alias("kind"), F.lit(top).alias("level"), "at", "n", "text"))


def paths(links: DataFrame, trees: DataFrame, most: int) -> DataFrame:
    """What lies above each block of leaves: (tree, at, n, text), from trees(tree, n, text), the paths above their subroots."""
    blocks = max(1, -(-levels(most) // BLOCK))
    # the round at which a tree's subroot comes in
    deep = lambda n: sum((F.when(n > F.lit(ARITY ** (BLOCK * k)), 1).otherwise(0) for k in range(1, blocks)), F.lit(1))
    out = None
    for j in range(blocks, 0, -1):
        own = trees.where(deep(F.col("n")) == j).select("tree", F.lit(0).cast("long").alias("at"), "n", "text")
        if out is not None:
            # at the level of this round's subroots
            own = own.unionByName(out)
        if j == 1:
            return own
        level = BLOCK * (j - 1)
        out = written(_above(links, own, level).groupBy("tree", "block").applyInArrow(_down(level), "tree long, at long, n long, text string"), "paths")
    raise AssertionError("a tree has one block at least")


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(key, left, right):
    """Proofs of a block's leaves, and the roots that the altered rows give."""
    links, above, n, top = _block(right, 0)
    subroot, root, g, m = (right.column(c)[0].as_py() for c in ("subroot", "root", "g", "m"))
    out: list[list] = [[] for _ in range(7)]
    for doc_id, at, own, altered in zip(*(left.column(c).to_pylist() for c in ("doc_id", "at", "digest", "altered")), strict=True):
        path = _path(at, 0, top, links) + above
        folded, end = fold(altered, at, n, path)
        folded, _ = fold(folded, g, m, path, end)
        for col, x in zip(out, (doc_id, own, subroot, root, sha(path), folded, folded == root), strict=True):
            col.append(x)
    types = (pa.int64(), *[pa.string()] * 5, pa.bool_())
    return pa.table([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])


def manifest(docs: DataFrame, *, doc_id: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = FIELDS, altered: Callable[[Column], Column] | None = None, text: str = "text", where: Column | None = None) -> DataFrame:
    """Proofs of all rows: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    `altered` is what the rows given by `where` hold now in place of their `text`: their leaf is
    hashed again, and folded with the original siblings. Without it every row is verified as it is.
    """
    now = F.lit(None).cast("string")
    if altered is not None:
        now = leaf([altered(F.col(c)) if c == text else F.col(c) for c in fields])
        now = now if where is None else F.when(where, now)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(group).cast("string").alias("name"), leaf([F.col(c) for c in fields]).alias("digest"), now.alias("altered"))
    rows = written(rows.withColumn("altered", F.coalesce("altered", "digest")), "leaves")
    order = numbered(rows, ["name", "doc_id", "digest"])
    trees = written(order.groupBy("name").agg(F.min("place").alias("tree"), F.count("*").alias("n")), "trees")
    most = trees.agg(F.max("n").alias("n"), F.count("*").alias("m")).first()
    if not most.m:
        return docs.sparkSession.createDataFrame([], RESULT)
    leaves = order.join(trees, order["name"].eqNullSafe(trees["name"])).select("doc_id", "tree", (F.col("place") - F.col("tree")).alias("at"), "n", "digest", "altered")
    leaves = written(leaves, "leaves")
    drop(order)
    drop(rows)
    subroots, links = build(leaves, most.n)
    # the tree of the subroots, in the order of the names: a tree's number is the place of its first leaf
    above = numbered(written(subroots, "subroots"), ["tree"]).select(F.col("tree").alias("name"), F.lit(-1).cast("long").alias("tree"), F.col("place").alias("at"), F.lit(most.m).cast("long").alias("n"), "digest", F.col("n").alias("leaves"))
    above = written(above, "tops")
    roots, top_links = build(above, most.m)
    root = roots.first().digest
    base = paths(top_links, roots.select("tree", "n", F.lit("").alias("text")), most.m)
    upper = above.select("tree", F.col("name").alias("own"), "at", "n", F.col("leaves"), "digest", F.expr(f"shiftright(at, {BITS * BLOCK})").alias("block"))
    tops = upper.groupBy("tree", "block").cogroup(_above(top_links, base, 0).groupBy("tree", "block")).applyInArrow(_tops, "tree long, n long, subroot string, g long, m long, text string")
    tops = written(tops.withColumn("root", F.lit(root)), "tops")
    lower = paths(links, tops.select("tree", "n", "text"), most.n)
    right = _above(links, lower, 0).join(tops.select("tree", "subroot", "root", "g", "m"), "tree")
    left = leaves.withColumn("block", F.expr(f"shiftright(at, {BITS * BLOCK})"))
    return left.groupBy("tree", "block").cogroup(right.groupBy("tree", "block")).applyInArrow(_prove, RESULT)


def _tops(key, left, right):
    """The paths of some subroots to the root."""
    links, above, n, top = _block(right, 0)
    at = left.column("at").to_pylist()
    return pa.table({"tree": left.column("own"), "n": left.column("leaves"), "subroot": left.column("digest"), "g": left.column("at"), "m": left.column("n"), "text": pa.array([_path(i, 0, top, links) + above for i in at], pa.string())})


#: The letters that tampering changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; in those where 3 divides the crc32 of the doc_id, the text's capitals are tampered with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return manifest(docs, altered=lambda c: F.translate(c, UPPER, LOWER), where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0)


OP11_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, lang, source, n_chars, text,
 xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 3 = 0 AS hit FROM documents),
f AS (SELECT *, list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), lambda a, b: a || b) AS head FROM d),
h AS (SELECT doc_id, lang, hit, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
 sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || translate(text, '{UPPER}', '{LOWER}') END) AS changed FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM h),
t AS (SELECT g, 0 AS level, pos, n, leaf AS digest FROM l UNION ALL SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, level, n, pos // 8),
s AS (SELECT g, digest AS subroot, max(level) OVER (PARTITION BY g) AS top FROM t WHERE n = 1),
u AS (SELECT 0 AS level, g AS pos, (SELECT count(*) FROM s) AS n, subroot AS digest FROM s UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, n, pos // 8),
r AS (SELECT digest AS root FROM u WHERE n = 1),
q AS (SELECT g, level, pos, digest, n FROM t WHERE n > 1 UNION ALL SELECT -1, level, pos, digest, n FROM u WHERE n > 1),
p AS (SELECT a.g, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt FROM q a JOIN q b ON a.g = b.g AND a.level = b.level AND a.pos // 8 = b.pos // 8 GROUP BY a.g, a.level, a.pos),
w AS (SELECT doc_id, leaf, l.g, l.pos, s.subroot, s.top, row_number() OVER () AS k, CASE WHEN hit THEN changed ELSE leaf END AS start FROM l JOIN s USING (g)),
x AS (SELECT k, g, pos, 0 AS level, top, start AS digest, '' AS path, g AS own FROM w UNION ALL
 SELECT k, CASE WHEN x.own >= 0 AND x.level = top THEN -1 ELSE x.g END, CASE WHEN x.own >= 0 AND x.level = top THEN x.own ELSE x.pos // 8 END, CASE WHEN x.own >= 0 AND x.level = top THEN 0 ELSE x.level + 1 END, top,
 CASE WHEN x.own >= 0 AND x.level = top THEN digest ELSE sha256(lft || digest || rgt) END, CASE WHEN x.own >= 0 AND x.level = top THEN path ELSE path || lft || rgt END, CASE WHEN x.own >= 0 AND x.level = top THEN -1 ELSE x.own END
 FROM x LEFT JOIN p ON p.g = x.g AND p.level = x.level AND p.pos = x.pos WHERE (x.own >= 0 AND x.level = top) OR p.g IS NOT NULL),
y AS (SELECT k, arg_max(digest, level) AS folded_root, arg_max(path, level) AS path FROM x WHERE own < 0 GROUP BY k)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, folded_root, folded_root = root AS verified FROM w JOIN y USING (k), r
"""
