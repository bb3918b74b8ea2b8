"""Benchmark decontamination by winnowing.

Method. Both sides are cut into words. From every window of W - K + 1 successive K-grams the
smallest hash is kept as a fingerprint (all positions that hold it, so that both sides choose
alike). A shared span of W words holds one whole window, so both sides keep the same fingerprint
inside it: no shared span of W words is missed. Document fingerprints that may be among those of
the benchmark are extended to all W-word windows around them; these are joined with the
benchmark's windows by hash and compared word by word.

Items shorter than W words are one window of their own length; for these every n-gram of that
length is a fingerprint (the winnowing window is then one K-gram wide).

Scale. Both sides stay distributed: the benchmark's windows are a table. What goes to every task is
a filter of fixed size at most (`FILTER_BITS`), built in pieces by the tasks, that tells which
hashes can't be the benchmark's; a larger benchmark lets more through to the join, which decides.
Documents are cut once, and only windows that pass the filter move. Equal texts have equal hits, so
these are kept by a text's digest; texts move only where they have hits. The keys of these are
broadcast up to `BROADCAST_ROWS` of them and joined by a shuffle beyond.

Edge cases: null or empty texts have no words, no hits and an empty item list. Items with null
id or without words take no part; an empty benchmark hits nothing. Repeated items and repeated rows
are each treated alike. Items with equal windows are all named. A very long text is cut whole, and
its windows are rows of their own. An empty table gives an empty result. Input columns whose names
clash with result columns are replaced by them; a caller that needs them renames them first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .scratch import drop, written

WINDOW, KGRAM = 10, 5
#: Bits of the filter: FILTER_LOAD for each hash, FILTER_BITS at most (a power of two).
FILTER_LOAD, FILTER_BITS, CHUNK_BITS = 64, 1 << 28, 1 << 16
BROADCAST_ROWS = 250_000
RESULT = {"n_words": T.LongType(), "n_hit": T.LongType(), "hit_spans": T.ArrayType(T.ArrayType(T.LongType())), "items": T.ArrayType(T.StringType())}
_ARROW = {"n_words": pa.int64(), "n_hit": pa.int64(), "hit_spans": pa.list_(pa.list_(pa.int64())), "items": pa.list_(pa.string())}


def _words(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, data, offs in K.text_slices(texts):
        data = K.LOWER[data]
        starts, ends, rows = K.word_spans(data, offs, K.ALNUM)
        yield i, j, data, starts, ends, rows, K.span_hashes(data, starts, ends)


def winnow(words: np.ndarray, rows: np.ndarray, window: int = WINDOW, k: int = KGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept k-grams: the least of each window of window - k + 1 k-grams."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grams, span = K.kgrams(words, k), window - k + 1
    least = grams[:n].copy()
    for t in range(1, span):
        np.minimum(least, grams[t : t + n], out=least)
    whole = rows[:n] == rows[window - 1 :]
    kept = np.zeros(len(grams), bool)
    for t in range(span):
        kept[t : t + n] |= (grams[t : t + n] == least) & whole
    at = np.flatnonzero(kept)
    return at, grams[at]


# --- the benchmark ---------------------------------------------------------------------------------


def _windows(batches):
    """(item, size, hash, what): every window of every item."""
    for batch in K.portions(batches):
        out: list[list] = [[], [], [], []]
        names = batch.column(0).to_pylist()
        for i, j, data, starts, ends, rows, words in _words(batch.column(1)):
            base = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=j - i))]).tolist()
            raw = data.tobytes()
            for r in range(j - i):
                own, size = words[base[r] : base[r + 1]], min(WINDOW, base[r + 1] - base[r])
                if size:
                    each = [raw[s:e] for s, e in zip(starts[base[r] : base[r + 1]].tolist(), ends[base[r] : base[r + 1]].tolist(), strict=True)]
                    for at, h in enumerate(K.kgrams(own, size).view(np.int64).tolist()):
                        for col, x in zip(out, (names[i + r], size, h, b" ".join(each[at : at + size])), strict=True):
                            col.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["item", "size", "hash", "what"])


def _prints(batches):
    """The fingerprints of items that have a window of WINDOW words."""
    for batch in K.portions(batches):
        found = []
        for _, _, _, _, _, rows, words in _words(batch.column(0)):
            found.append(winnow(words, rows)[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).view(np.int64) if found else [], pa.int64())], names=["hash"])


class Filter:
    """Which hashes can't be among those put in: two bits for each."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.data = bits, np.zeros(bits // 8, np.uint8) if data is None else data

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.bits - 1)
        return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        a, b = self.places(hashes)
        return ((self.data[a >> 3] >> (a & 7).astype(np.uint8)) & (self.data[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


def _bits(bits: int):
    """(chunk, place) of the bits that hashes set, each once in a task."""

    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate(Filter(bits, np.empty(0, np.uint8)).places(batch.column(0).to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(at // CHUNK_BITS, pa.int64()), pa.array(at % CHUNK_BITS, pa.int32())], names=["chunk", "place"])

    return run


def _chunks(batches):
    """Each chunk as bytes. Rows come sorted by chunk, and a chunk lies in one partition."""
    key, bits = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["chunk", "data"])

    for batch in batches:
        chunk, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        for a, b in zip(cut, cut[1:], strict=False):
            if a == b:
                continue
            if chunk[a] != key:
                if key is not None:
                    yield out()
                key, bits = int(chunk[a]), np.zeros(CHUNK_BITS, bool)
            bits[place[a:b]] = True
    if key is not None:
        yield out()


def build_filter(hashes: DataFrame) -> Filter:
    """The filter of hashes(hash). The driver puts chunks of bytes together, FILTER_BITS / 8 of them at most."""
    bits = CHUNK_BITS
    n = hashes.agg(F.approx_count_distinct("hash")).first()[0]
    while bits < min(FILTER_BITS, n * FILTER_LOAD):
        bits *= 2
    out = Filter(bits)
    chunks = hashes.mapInArrow(_bits(bits), "chunk long, place int").distinct().repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_chunks, "chunk long, data binary")
    for r in chunks.toLocalIterator():
        at = r.chunk * CHUNK_BITS // 8
        out.data[at : at + CHUNK_BITS // 8] = np.frombuffer(r.data, np.uint8)
    return out


# --- the documents ---------------------------------------------------------------------------------


def _candidates(shared: Broadcast, sizes: list[int]):
    """(key, at, size, hash, what): windows of documents that may be among those of the benchmark."""
    names = ["key", "at", "size", "hash", "what"]
    types = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary())

    def run(batches):
        known: Filter = shared.value
        for batch in K.portions(batches):
            texts, out = batch.column(0), [[] for _ in names]
            for i, j, data, starts, ends, rows, words in _words(texts):
                base = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=j - i))])
                keys: dict[int, bytes] = {}
                raw = data.tobytes()
                for size in sizes:
                    n = len(words) - size + 1
                    if n <= 0:
                        continue
                    if size == WINDOW:
                        at, grams = winnow(words, rows)
                        at = at[known.may_hold(grams)]
                        at = np.unique((at[:, None] - np.arange(WINDOW - KGRAM + 1)).ravel())
                        at = at[(at >= 0) & (at < n)]
                        around = words[at[:, None] + np.arange(size)]
                        grams = np.full(len(at), size, np.uint64)
                        for k in range(size):
                            grams += around[:, k] * K._MULT[k]
                        grams = K.mix64(grams)
                    else:
                        at, grams = np.arange(n), K.kgrams(words, size)
                    ok = known.may_hold(grams) & (rows[at] == rows[at + size - 1])
                    for p, h in zip(at[ok].tolist(), grams[ok].view(np.int64).tolist(), strict=True):
                        r = int(rows[p])
                        if r not in keys:
                            keys[r] = hashlib.md5(texts[i + r].as_buffer()).digest()
                        what = b" ".join(raw[s:e] for s, e in zip(starts[p : p + size].tolist(), ends[p : p + size].tolist(), strict=True))
                        for col, x in zip(out, (keys[r], p - int(base[r]), size, h, what), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return run


def _finish(text: str, keep: list[str]):
    """Words, hits and items of each row."""

    def run(batches):
        for batch in K.portions(batches):
            n = batch.num_rows
            n_words, n_hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, j, data, offs in K.text_slices(batch.column(text)):
                n_words[i:j] = K.word_counts(K.LOWER[data], offs, K.ALNUM)
            spans: list[list] = [[] for _ in range(n)]
            items: list[list] = [[] for _ in range(n)]
            for r in np.flatnonzero(pc.is_valid(batch.column("_windows")).to_numpy(zero_copy_only=False)).tolist():
                edge = np.zeros(int(n_words[r]) + 1, np.int64)
                for w in batch.column("_windows")[r].as_py():
                    edge[w["at"]] += 1
                    edge[w["at"] + w["size"]] -= 1
                hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
                spans[r] = np.flatnonzero(np.diff(hit)).reshape(-1, 2).tolist()
                n_hit[r] = int(hit.sum())
                items[r] = sorted(batch.column("_items")[r].as_py(), key=lambda x: x.encode())
            cols = {c: batch.column(c) for c in keep}
            cols |= {"n_words": pa.array(n_words), "n_hit": pa.array(n_hit), "hit_spans": pa.array(spans, _ARROW["hit_spans"]), "items": pa.array(items, _ARROW["items"])}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: n_words, n_hit, hit_spans ([first word, word after]) and items (sorted ids).

    `keep` names the input columns that the result carries (all of them by default).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    # within, input columns have names that no other column has
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    docs, text = docs.toDF(*names.values()), names[text]
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("t")).where("item is not null and t is not null")
    windows = written(items.mapInArrow(_windows, "item string, size int, hash long, what binary").distinct(), "windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # 1 to WINDOW
    known = build_filter(windows.select("hash").unionByName(items.select("t").mapInArrow(_prints, "hash long")))
    shared = spark.sparkContext.broadcast(known)
    found = written(docs.select(text).mapInArrow(_candidates(shared, sizes), "key binary, at long, size int, hash long, what binary").distinct(), "candidates")
    shared.destroy()
    hits = found.join(windows, ["hash", "size", "what"])
    hits = written(hits.groupBy("key").agg(F.collect_set(F.struct("at", "size")).alias("_windows"), F.collect_set("item").alias("_items")), "hits")
    for table in (windows, found):
        drop(table)
    own = [names[c] for c in keep]
    rows = docs.select(*dict.fromkeys([*own, text]))
    key, columns = F.unhex(F.md5(F.col(text).cast("string"))), [*rows.columns, "_windows", "_items"]
    rows = rows.withColumn("_key", key)
    hits = hits.withColumnRenamed("key", "_key")
    if hits.count() <= BROADCAST_ROWS:
        keys = F.broadcast(hits.select("_key"))
        clean = rows.join(keys, "_key", "left_anti").withColumns({c: F.lit(None).cast(hits.schema[c].dataType) for c in ("_windows", "_items")})
        rows = rows.join(keys, "_key", "left_semi").join(hits, "_key").select(*columns).unionByName(clean.select(*columns))
    else:
        rows = rows.join(hits, "_key", "left").select(*columns)
    schema = T.StructType([*(rows.schema[c] for c in own), *(T.StructField(c, t) for c, t in RESULT.items())])
    return rows.mapInArrow(_finish(text, own), schema).toDF(*keep, *RESULT)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = decontaminate(spark, docs.select("doc_id", "text"), bench, keep=["doc_id"])
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') AS g FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, p, array_to_string(ws[p : p + n - 1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, sizes WHERE len(ws) >= n)),
h AS (SELECT r, dw.n, p, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hw AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, n, p FROM h)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
