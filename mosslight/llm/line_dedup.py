"""Line deduplication: of equal units in the whole corpus the earliest ranked one stays.

Method. Texts are cut into units (lines by default; any separator). Units are normalised (case
folded, white space collapsed) and named by a digest; digests are grouped globally. The occurrence
with the least (doc_id, text digest, place in the text) stays, the others are removed. The offsets
of removed units in the original text are retained. The longest unit that occurs more than once,
the occurrence that stays included, is told: from `PASSAGE` words on it counts as a shared passage.
Units are compared whole, so that misses passages which begin or end within a unit. On request the
operator also tells which rows share a run of more than 50 words with another row, wherever in its
units it lies (passages.py).

Scale. A unit is a row of a few bytes whatever its length. Grouping combines before the shuffle
and keeps one minimum per digest; only units that occur again are joined back, in a join that
Spark may split when one unit is very common. Texts move once, at the end.

Edge cases: a null text has no units and stays null; blank units never count as repeated and stay;
rows equal in doc_id and text are ranked one after another, so all but one of them lose every
unit that isn't blank; a null doc_id ranks last; rows with one doc_id and other texts are ranked by
a digest; a very long text is cut into units whole; an empty table gives an empty result. Input
columns other than the named ones are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .passages import WORDS, sharing
from .scratch import written

SEPARATOR = "\n"
#: Words from which on a repeated unit counts as a shared passage.
PASSAGE = 20


def normalised(unit: str) -> str:
    return " ".join(unit.lower().split())


def _units(separator: str):
    def run(batches):
        for batch in K.portions(batches):
            out: list[list] = [[], [], [], []]
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for i, unit in enumerate((text or "").split(separator)):
                    if plain := normalised(unit):
                        for col, x in zip(out, (row, doc_id, i, hashlib.blake2b(plain.encode(), digest_size=16).digest()), strict=True):
                            col.append(x)
            types = (pa.binary(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["row", "doc_id", "place", "digest"])

    return run


def _apply(separator: str):
    def run(batches):
        for batch in K.portions(batches):
            ids, counts, lost, spans, kept, longest = batch.column(0), [], [], [], [], []
            for text, marks, nth, copies in zip(*(c.to_pylist() for c in batch.columns[1:5]), strict=True):
                units = [] if text is None else text.split(separator)
                again = {m["place"]: m["gone"] for m in marks or ()}
                at, own, stay, most = 0, [], [], 0
                for i, unit in enumerate(units):
                    plain = normalised(unit) if copies > 1 or i in again else ""
                    if plain:
                        most = max(most, plain.count(" ") + 1)
                    if plain and (nth > 1 or again.get(i, False)):
                        own.append([at, at + len(unit)])
                    else:
                        stay.append(unit)
                    at += len(unit) + len(separator)
                for col, x in zip((counts, lost, spans, kept, longest), (len(units), len(own), own, None if text is None else separator.join(stay), most), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string()), pa.array(longest, pa.int64()), *batch.columns[5:]],
                names=["doc_id", "n_units", "n_removed", "spans", "kept", "longest_repeated", *batch.schema.names[5:]],
            )

    return run


def dedup_units(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", separator: str = SEPARATOR, passages: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_units, n_removed, spans ([first character, character after] of removed units), kept, and longest_repeated (words of the longest unit that occurs more than once, here or elsewhere).

    With `passages` also shares_run: whether a run of more than 50 words stands in another row too, even if it begins or ends within a unit.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # a null is no text that a row could hold
    key = F.concat(F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")), F.lit("|"), F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("n")))
    own = own.withColumn("row", F.unhex(F.md5(key)))
    units = written(own.select("row", "doc_id", "text").mapInArrow(_units(separator), "row binary, doc_id long, place int, digest binary"), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("a"), F.coalesce("doc_id", F.lit(0)).alias("b"), F.col("row").alias("c"), F.col("place").alias("d"))
    # written first: a join with a plain table can be split where one unit is very common
    first = written(units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first")
    again = units.join(first, "digest").select("row", F.struct("place", (rank != F.col("first")).alias("gone")).alias("mark"))
    again = again.groupBy("row").agg(F.collect_set("mark").alias("marks"))
    same = Window.partitionBy("row")
    out = own.withColumn("nth", F.row_number().over(same.orderBy(F.lit(1)))).withColumn("copies", F.count("*").over(same)).join(again, "row", "left")
    columns, schema = ["doc_id", "text", "marks", "nth", "copies"], "doc_id long, n_units long, n_removed long, spans array<array<long>>, kept string, longest_repeated long"
    if passages:
        keyed = own.withColumn("key", F.xxhash64("row"))
        told = sharing(keyed.select("key", "text"))
        # by row, as the texts are dealt already: they don't move again
        told = keyed.select("key", "row").join(told, "key").select("row").distinct().withColumn("told", F.lit(True))
        # rows equal in doc_id and text share all that they hold
        words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
        out = out.join(told, "row", "left").withColumn("shares_run", F.coalesce("told", (F.col("copies") > 1) & (words >= WORDS), F.lit(False)))
        columns, schema = [*columns, "shares_run"], f"{schema}, shares_run boolean"
    return out.select(*columns).mapInArrow(_apply(separator), schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated lines of all documents."""
    out = dedup_units(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",")
    return out.select("doc_id", "n_units", "n_removed", spans.alias("removed_spans"), F.sha2("kept", 256).alias("kept_sha256"), "longest_repeated", (F.col("longest_repeated") >= PASSAGE).alias("shares_passage"))


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, md5(text)) AS r, doc_id, string_split(text, chr(10)) AS u FROM documents),
x AS (SELECT r, i, u[i] AS t, trim(regexp_replace(lower(u[i]), '[\s]+', ' ', 'g')) AS n, coalesce(list_sum(list_transform(u[1 : i - 1], lambda z: length(z) + 1)), 0) AS a FROM (SELECT r, u, unnest(range(1, len(u) + 1)) AS i FROM d)),
f AS (SELECT *, n <> '' AND row_number() OVER (PARTITION BY n ORDER BY r, i) > 1 AS gone, CASE WHEN n <> '' AND count(*) OVER (PARTITION BY n) > 1 THEN len(string_split(n, ' ')) ELSE 0 END AS long FROM x)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_units, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
 coalesce(string_agg(CAST(a AS BIGINT) || ':' || CAST(a + length(t) AS BIGINT), ',' ORDER BY i) FILTER (gone), '') AS removed_spans,
 sha256(coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256,
 CAST(max(long) AS BIGINT) AS longest_repeated, max(long) >= {PASSAGE} AS shares_passage
FROM f JOIN d USING (r) GROUP BY r, doc_id
"""


def line_dedup_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a run of more than 50 words with another one, beside their longest repeated line."""
    out = dedup_units(spark.read.parquet(f"{sf_dir}/documents.parquet"), passages=True)
    return out.select("doc_id", "n_units", "longest_repeated", "shares_run")


LINE_DEDUP_PASSAGES_SQL = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, md5(text)) AS r, doc_id, text FROM documents),
u AS (SELECT r, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[\s]+', ' ', 'g')) AS n FROM d),
l AS (SELECT r, count(*) AS n_units, max(CASE WHEN n <> '' AND c > 1 THEN len(string_split(n, ' ')) ELSE 0 END) AS longest FROM (SELECT *, count(*) OVER (PARTITION BY n) AS c FROM u) GROUP BY r),
w AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda z: z <> '') AS w FROM d),
p AS (SELECT DISTINCT r, md5(array_to_string(w[i : i + {WORDS - 1}], ' ')) AS p FROM (SELECT r, w, unnest(range(1, len(w) - {WORDS - 2})) AS i FROM w)),
s AS (SELECT DISTINCT r FROM p JOIN (SELECT p FROM p GROUP BY p HAVING count(*) > 1) USING (p))
SELECT doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(longest, 0) AS BIGINT) AS longest_repeated, s.r IS NOT NULL AS shares_run
FROM d LEFT JOIN l USING (r) LEFT JOIN s ON s.r = d.r
"""
