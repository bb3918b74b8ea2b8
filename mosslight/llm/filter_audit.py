"""Filter interaction audit: what each order of a set of filters removes, and at whose cost.

Method. Texts are scanned as Arrow buffers: NumPy byte classes and prefix sums over a slice of rows
count words, capitals, code points and symbols. Distinct words come from word hashes sorted within
their document: equal neighbours are compared byte by byte, and a document in which two different
words share a hash is counted by its words themselves. Each document becomes a mask of the filters
that it fails. Masks are counted per part; every order of the filters is then read off these counts.

Filters. A: under 200 words. B: distinct words below half of the words. C: capitals A-Z above 3 % of
the code points. D: holds one of # $ % & * |. E: the text equals that of a row with a smaller doc_id.

Scale. A text leaves its task as a digest and a mask, a row of some 40 bytes. Rows alike in all of
it are counted in the task before they are shuffled, so copies of one text cost their doc_ids only.
Copies are told from first occurrences by the least doc_id of a digest, a minimum combined in the
tasks; no group is gathered. What is left is at most 32 masks per part, whatever the table's size.

Edge cases: a null text counts as empty, and equals empty texts; a null lang is the part ''. A null
doc_id is neither smaller than another nor has a smaller one: such rows never fail E, and no row
fails it because of them; no label belongs to them. Rows with one doc_id are documents of their own, and aren't
copies of each other. Of several labels for one doc_id the largest value counts; labels of other
documents are ignored, as are null ones. Long texts are scanned whole. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels as K
from .scratch import written

FILTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = np.isin(np.arange(256), list(b"#$%&*|"))
CAPITALS = (np.arange(256) >= 65) & (np.arange(256) <= 90)
#: The first byte of each UTF-8 character.
CHARACTERS = (np.arange(256) & 0xC0) != 0x80


def class_counts(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Bytes of a class in each row, as differences of prefix sums."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(table[data], out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray, limit: int = K.SLICE_BYTES) -> np.ndarray:
    """Whether the bytes of each span at a equal those at b; the spans have the same lengths, none is empty."""
    out = np.empty(len(a), bool)
    ends, i = np.cumsum(length), 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
        n = length[i:j]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        equal = data[np.repeat(a[i:j], n) + step] == data[np.repeat(b[i:j], n) + step]
        out[i:j] = np.logical_and.reduceat(equal, first)
        i = j
    return out


def distinct_words(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each row."""
    n = len(offs) - 1
    if not len(starts):
        return np.zeros(n, np.int64)
    hashes = K.span_hashes(data, starts, ends) if hashes is None else hashes
    order = np.lexsort((hashes, rows))
    row, h, a, size = rows[order], hashes[order], starts[order], (ends - starts)[order]
    twin = np.flatnonzero((row[1:] == row[:-1]) & (h[1:] == h[:-1]))
    fits = size[twin] == size[twin + 1]
    same = np.zeros(len(twin), bool)
    same[fits] = same_bytes(data, a[twin[fits]], a[twin[fits] + 1], size[twin[fits]])
    out = np.bincount(rows, minlength=n) - np.bincount(row[twin], minlength=n)
    # two words with one hash: such a document is counted by its words
    for r in np.unique(row[twin[~same]]).tolist():
        at = np.flatnonzero(rows == r)
        out[r] = len({data[s:e].tobytes() for s, e in zip(starts[at], ends[at], strict=True)})
    return out


def _scan(batches):
    for batch in K.portions(batches):
        columns: list[list[np.ndarray]] = [[] for _ in range(5)]
        digests: list[bytes] = []
        for i, j, data, offs in K.text_slices(batch.column(2)):
            starts, ends, rows = K.word_spans(data, offs, K.SPACED)
            counts = (np.bincount(rows, minlength=j - i), distinct_words(data, offs, starts, ends, rows), *(class_counts(data, offs, t) for t in (CAPITALS, CHARACTERS, SYMBOLS)))
            for col, x in zip(columns, counts, strict=True):
                col.append(x)
            raw, at = data.tobytes(), offs.tolist()
            digests += [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(at, at[1:], strict=False)]
        counts = [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), *counts], names=["doc_id", "part", "digest", "n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols"])


def features(docs: DataFrame, *, doc_id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """doc_id, part, digest of the text, n_words, n_distinct, n_capitals, n_chars and n_symbols of every row."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_scan, "doc_id long, part string, digest binary, n_words long, n_distinct long, n_capitals long, n_chars long, n_symbols long")


def failures(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail exactly the filters of a mask (bit 0 is A), and how many of them are labelled so."""
    bit = lambda k, c: F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    mask = (
        bit(0, F.col("n_words") < LEAST_WORDS)
        + bit(1, F.col("n_distinct") * 100 < F.col("n_words") * DISTINCT_PERCENT)
        + bit(2, F.col("n_capitals") * 100 > F.col("n_chars") * CAPITAL_PERCENT)
        + bit(3, F.col("n_symbols") > 0)
    )
    rows = features(docs, **columns).select("doc_id", "part", "digest", mask.alias("mask"))
    alike = written(rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n")), "alike")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("q"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("t"))
    no = F.lit(False)
    # rows without a doc_id have no label; beside the join they don't meet in one task
    marked = alike.where("doc_id is not null").join(known, "doc_id", "left").withColumns({"q": F.coalesce("q", no), "t": F.coalesce("t", no)})
    marked = marked.unionByName(alike.where("doc_id is null").withColumns({"q": no, "t": no}))
    # per text: all rows, those without a doc_id, and those that have the least one (a doc_id has one row here)
    groups = marked.groupBy("digest", "part", "mask", "q", "t").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    split = groups.withColumn("clean", F.col("without") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    fate = F.explode(F.array(F.struct(F.col("mask").alias("m"), F.col("clean").alias("c")), F.struct((F.col("mask") + 16).alias("m"), (F.col("n") - F.col("clean")).alias("c"))))
    split = split.select("part", "q", "t", fate.alias("f")).where("f.c > 0")
    count = lambda c: F.sum(F.when(c, F.col("f.c")).otherwise(0)).cast("long")
    return split.groupBy("part", F.col("f.m").alias("mask")).agg(F.sum("f.c").cast("long").alias("n"), count(F.col("q")).alias("good"), count(F.col("t")).alias("toxic"))


def orders() -> list[str]:
    return ["".join(p) for p in itertools.permutations(FILTERS)]


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the filters, and step, with the counts of that step (see the module's text)."""
    counts = written(failures(docs, labels, **columns), "masks")
    parts = counts.select("part").distinct()
    step = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1)), lambda k: F.substring(F.col("filter_order"), k + 1, F.lit(1))))
    frame = parts.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders()]))).select("part", "filter_order", step.alias("at", "name"))
    bits = F.create_map(*itertools.chain.from_iterable((F.lit(f), F.lit(1 << k)) for k, f in enumerate(FILTERS)))
    before = Window.partitionBy("part", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    frame = frame.withColumn("own", bits[F.col("name")]).withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0)))
    rows = frame.join(counts, "part")
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before").cast("int")) != 0
    total = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0)).cast("long")
    here = fails & ~gone
    out = rows.groupBy("part", "filter_order", (F.col("at") + 1).alias("step"), "name").agg(
        total(~fails & ~gone).alias("kept"),
        total(here).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "name"))).drop("name")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS q, max(toxic) = 1 AS x FROM labels GROUP BY doc_id),
m AS (SELECT part, len(ws) < {LEAST_WORDS} AS a, 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {CAPITAL_PERCENT} * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
 coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(q, false) AS q, coalesce(x, false) AS x FROM w LEFT JOIN l USING (doc_id)),
f AS (SELECT *, a::INT AS fa, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails FROM m),
k AS (SELECT part, fails, count(*) AS n, count(*) FILTER (q) AS good, count(*) FILTER (x) AS toxic FROM f GROUP BY part, fails),
s(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order FROM s v, s w, s x, s y, s z WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
g AS (SELECT part, filter_order, step, filter_order[step] AS own, left(filter_order, step - 1) AS earlier FROM (SELECT DISTINCT part FROM k), o, range(1, 6) r(step)),
h AS (SELECT g.*, fails, n, good, toxic, contains(fails, own) AS hit, length(translate(fails, earlier, '')) < length(fails) AS gone FROM g JOIN k USING (part)),
z AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (hit AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (hit AND gone), 0) AS redundant,
 coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails, coalesce(sum(good) FILTER (hit AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (hit AND NOT gone), 0) AS toxic_lost FROM h GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM z
"""
