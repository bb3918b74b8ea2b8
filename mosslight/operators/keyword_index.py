"""A keyword index on disk: postings in buckets by term, kept from query to query.

One table holds three kinds of rows, each in buckets of its own:

- postings (term, key, tf, dl, seq), in the bucket of their term and sorted by it;
- terms (term, df, seq): by how much a write changed in how many chunks a term occurs;
- removed keys (key, seq): postings of that key written before are void.

A query reads the buckets of its own terms, with the terms pushed down to the scan. Number and total length
of all chunks are kept with the snapshot. Chunks are cut into words once, when they are added; a removal
writes its keys and takes back what it counted, and no posting is written again before compact().
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.snapshots import BucketTable, bucket_of
from .retrieve import bm25_weight, terms

BUCKETS = 64
#: Distinct terms of a set of queries up to which they are literals of the scan; beyond, they are joined.
LITERALS = 256
#: Terms of all queries of a set up to which these go to every task.
BROADCAST = 200_000
_POSTING, _TERM, _GONE = 0, 1, 2


class KeywordIndex:
    """Okapi BM25 over chunks(key, content) whose postings lie below `path`."""

    def __init__(self, spark: SparkSession, path: str, *, key: str = "chunk_id", content: str = "content", buckets: int = BUCKETS):
        self.spark, self.key, self.content = spark, key, content
        kind = F.when(F.col("term").isNull(), F.lit(_GONE)).when(F.col("df").isNotNull(), F.lit(_TERM)).otherwise(F.lit(_POSTING))
        shard = F.when(F.col("term").isNull(), bucket_of(key, buckets)).otherwise(bucket_of("term", buckets))
        self.table, self.buckets = BucketTable(spark, path, kind * buckets + shard, ("term",)), buckets

    # writing ---------------------------------------------------------------------------------

    def _counted(self, chunks: DataFrame) -> DataFrame:
        """(key, dl, term, tf). A chunk's terms are sorted and their runs counted where it lies: no posting is shuffled to be counted."""
        own = chunks.where(F.col(self.content).isNotNull()).select(self.key, F.sort_array(terms(F.col(self.content))).alias("_t")).where(F.size("_t") > 0)
        first = lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1))
        own = own.select(self.key, "_t", F.filter(F.sequence(F.lit(0), F.size("_t") - 1), first).alias("_at"))
        run = lambda i, n: F.struct(F.get("_t", i).alias("term"), (F.coalesce(F.get("_at", n + 1), F.size("_t")) - i).cast("long").alias("tf"))
        return own.select(self.key, F.size("_t").cast("long").alias("dl"), F.inline(F.transform("_at", run)))

    def _totals(self, chunks: DataFrame) -> tuple[int, int]:
        r = chunks.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.regexp_count(F.lower(self.content), F.lit(r"[a-z0-9_]+")), F.lit(0))).alias("total")).first()
        return r.n, r.total or 0

    def update(self, added: DataFrame | None, removed: DataFrame | None = None, batch: tuple[str, int] | None = None) -> dict:
        """Add chunks and take others out, in one commit. `removed` holds the chunks as they were added."""
        old = self.table.snapshot()
        if self.table._seen(old, batch):
            return old
        seq = old["version"] + 1
        n, total = old["stats"].get("n_docs", 0), old["stats"].get("total_length", 0)
        rows, more, none = None, [], lambda c, t: F.lit(None).cast(t).alias(c)
        key_type = (added if added is not None else removed).schema[self.key].dataType
        for chunks, sign in ((removed, -1), (added, 1)):
            if chunks is None:
                continue
            if sign > 0:
                # cut into words once: frequencies and lengths are counted from the postings that were written
                own = self._counted(chunks).select("term", self.key, "tf", "dl", none("df", "long"), F.lit(seq).cast("long").alias("seq"))
                more.append(self.table._write(own))
                paths = self.table.paths(None, {"folders": {b: [more[-1][0]] for b in more[-1][1]}})
                counted = self.spark.read.schema(own.schema).parquet(*paths) if paths else self.spark.createDataFrame([], own.schema)
                n, total = n + chunks.count(), total + (counted.agg(F.sum("tf")).first()[0] or 0)
                own = None
            else:
                counted = self._counted(chunks)
                gone = self._totals(chunks)
                n, total = n - gone[0], total - gone[1]
                own = chunks.select(none("term", "string"), self.key, none("tf", "long"), none("dl", "long"), none("df", "long"), F.lit(seq).cast("long").alias("seq"))
            df = counted.groupBy("term").agg((F.count("*") * sign).alias("df")).select("term", none(self.key, key_type), none("tf", "long"), none("dl", "long"), "df", F.lit(seq).cast("long").alias("seq"))
            df = df if own is None else own.unionByName(df)
            rows = df if rows is None else rows.unionByName(df)
        return self.table.write(rows, batch=batch, stats={"n_docs": n, "total_length": total}, more=more)

    def add(self, chunks: DataFrame, batch: tuple[str, int] | None = None) -> dict:
        return self.update(chunks, batch=batch)

    def remove(self, chunks: DataFrame) -> dict:
        return self.update(None, chunks)

    def compact(self) -> dict:
        """One folder per bucket, without postings of removed keys."""
        snapshot = self.table.snapshot()
        live, df = self._postings(None, snapshot), self._frequencies(None, snapshot)
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        key_type = live.schema[self.key].dataType
        rows = live.select("term", self.key, "tf", "dl", none("df", "long"), "seq")
        rows = rows.unionByName(df.select("term", none(self.key, key_type), none("tf", "long"), none("dl", "long"), "df", F.lit(snapshot["version"]).cast("long").alias("seq")))
        return self.table.write(rows, fresh=True, stats=snapshot["stats"])

    # reading ---------------------------------------------------------------------------------

    def _shards(self, kind: int, words: list[str] | None) -> list[int]:
        own = range(self.buckets) if words is None else {zlib.crc32(w.encode()) % self.buckets for w in words}
        return sorted(kind * self.buckets + b for b in own)

    def _postings(self, words: list[str] | None, snapshot: dict) -> DataFrame:
        """Valid postings of some terms, or of all."""
        rows = self.table.read(self._shards(_POSTING, words), snapshot)
        if words is not None and len(words) <= LITERALS:
            rows = rows.where(F.col("term").isin(words))
        gone = self._shards(_GONE, None)
        if any(str(b) in snapshot["folders"] for b in gone):
            void = self.table.read(gone, snapshot).groupBy(F.col(self.key).alias("_k")).agg(F.max("seq").alias("_until"))
            # a row that was removed and added again has a later posting
            rows = rows.join(void, (rows[self.key] == void["_k"]) & (rows["seq"] < void["_until"]), "left_anti")
        return rows.select("term", self.key, "tf", "dl", "seq")

    def _frequencies(self, words: list[str] | None, snapshot: dict) -> DataFrame:
        rows = self.table.read(self._shards(_TERM, words), snapshot)
        if words is not None and len(words) <= LITERALS:
            rows = rows.where(F.col("term").isin(words))
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def files_read(self, words: list[str]) -> tuple[int, int]:
        """Folders that a query with these terms opens, of how many."""
        snapshot = self.table.snapshot()
        return len(self.table.paths(self._shards(_POSTING, words), snapshot)), len(self.table.paths(self._shards(_POSTING, None), snapshot))

    def mean_length(self) -> float | None:
        n, total = self._stats(self.table.snapshot())
        return total / n if n else None

    def statistics(self) -> DataFrame:
        """(n_docs, avgdl), one row."""
        n, total = self._stats(self.table.snapshot())
        return self.spark.createDataFrame([(n, total / n if n else None)], "n_docs long, avgdl double")

    @staticmethod
    def _stats(snapshot: dict) -> tuple[int, int]:
        return snapshot["stats"].get("n_docs", 0), snapshot["stats"].get("total_length", 0)

    def document_count(self) -> int:
        return self._stats(self.table.snapshot())[0]

    def document_frequency(self) -> DataFrame:
        """(term, df) of all terms."""
        return self._frequencies(None, self.table.snapshot())

    def scores(self, queries: DataFrame) -> DataFrame:
        """(query_id, key, score) of every chunk with a term of a query; queries(query_id, text)."""
        snapshot = self.table.snapshot()
        n, total = self._stats(snapshot)
        wanted = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        known = [r[0] for r in wanted.select("term").distinct().limit(LITERALS + 1).collect()]
        if not n or not known:
            kind = self.table.read([], snapshot)
            if kind is None:
                raise ValueError("the keyword index is empty")
            return kind.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), self.key, F.lit(0.0).alias("score")).where("false")
        if len(known) <= LITERALS:
            own, df = self._postings(known, snapshot), self._frequencies(known, snapshot)
        else:
            # buckets are few; terms go by a join
            shards = [r[0] for r in wanted.select(bucket_of("term", self.buckets).alias("b")).distinct().collect()]
            words = wanted.select("term").distinct()
            own = self._in(_POSTING, shards, snapshot).join(words, "term", "left_semi")
            df = self._in(_TERM, shards, snapshot).join(words, "term", "left_semi")
        weight = bm25_weight(F.col("tf"), F.col("dl"), F.col("df"), F.lit(float(n)), F.lit(total / n))
        # frequencies: one row for each term of the queries
        few = wanted.limit(BROADCAST + 1).count() <= BROADCAST
        if not few:
            scored = own.join(df, "term").select(self.key, "term", weight.alias("w"))
            return wanted.join(scored, "term").groupBy("query_id", self.key).agg(F.sum("w").alias("score"))
        # a chunk's weights meet once, by its key; the rows of queries and chunks are made, summed and ranked there
        scored = own.join(F.broadcast(df), "term").select(self.key, "term", weight.alias("w")).repartition(self.key)
        wanted = F.broadcast(wanted)
        return wanted.join(scored, "term").groupBy("query_id", self.key).agg(F.sum("w").alias("score"))

    def _in(self, kind: int, shards: list[int], snapshot: dict) -> DataFrame:
        part = {**snapshot, "folders": {b: f for b, f in snapshot["folders"].items() if int(b) // self.buckets == _GONE or int(b) % self.buckets in shards}}
        return self._postings(None, part) if kind == _POSTING else self._frequencies(None, part)

    def search(self, queries: DataFrame, k: int = 5, compat_cap: int | None = None) -> DataFrame:
        """Best k per query with rank; `compat_cap` = 5 shows five rows at most."""
        k = min(k or 5, compat_cap or k or 5)
        # copies of a text tie up to the order of a sum; nine places settle it
        order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), self.key)
        return self.scores(queries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
