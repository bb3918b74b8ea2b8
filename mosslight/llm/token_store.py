"""Token ids of a corpus as a Huffman-coded binary store.

Method. Texts are encoded with a public tokenizer. The ids' counts over the whole corpus give a
canonical Huffman code whose lengths are limited to `MAX_BITS` (package-merge). Documents are
written in ascending doc_id order in segments that decode independently. In a segment the bit
offset of every `LANE`-th id is a checkpoint; decoding looks each code up in a table and advances
all lanes of a segment together.

Store: three Parquet folders, so that Spark commits whole files only and any file system serves.
- codebook (symbol, length): the canonical code.
- segments (shard, segment, first, n_tokens, n_docs, data): `first` counts the shard's ids before
  the segment. `data` is little-endian: the magic `MTK1`; uint32 documents, lanes; uint64 ids;
  per document int64 doc_id, uint32 ids, uint8 null flag; uint16 bits of every lane; the payload,
  most significant bit first, and 8 zero bytes.
- shards (shard, start): the ids of all shards before each one.

Scale. Texts are encoded once. Only encoded ids are sorted, by ranges of doc_id. Only the code
(at most one row per id of the vocabulary) and one number per shard meet in one place.

Edge cases: a null or empty text is a document with the end id alone. Rows with equal doc_id stay
rows of their own, next to each other, in an order that their ids set. A null doc_id sorts first. An empty
table gives an empty store. A very long text is one document of one segment. Other columns are ignored.
Another tokenizer's file may be given: unless it splits words as this one does, whole texts are encoded.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernels import portions, row_slices
from .scratch import new_path, written

MAX_BITS, LANE, SEGMENT = 18, 64, 1 << 17
END_ID = 2
CACHE_BYTES, TEXT_SLICE, CALL = 36 << 20, 4 << 20, 32
MAGIC = b"MTK1"
DTYPE = np.dtype("<u4")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def strings(col: pa.Array) -> list[str]:
    """A column as a list, several times faster than by to_pylist()."""
    return col.to_numpy(zero_copy_only=False).tolist()


class UnitEncoder:
    """Encodes parts of texts, each distinct one once, and keeps the ids of frequent ones.

    The pre-tokenizer of this vocabulary never joins characters across white space (its pattern
    has none, and neither composition nor lower-casing looks across it), so a text's ids are those
    of the parts between spaces and line ends, in order. ASCII letters are looked up in lower case.
    - A part of plain letters is one pre-token, whose last id is one that ends a word: many such
      parts go to the library as one text with spaces, and its ids are cut after those that end words.
    - Letters and then marks (no apostrophe) are two pre-tokens.
    - All other parts go together with a special token between them, which splits a text before
      anything else looks at it; parts that hold its beginning themselves go alone.
    """

    MARK = "<|endoftext|>"
    #: Letters below U+0130: their lower case and composition are one character each.
    LETTERS = r"^[a-zA-Z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]+$"
    MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"

    def __init__(self, path: str, limit: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.mark = self.tok.token_to_id(self.MARK)
        self.closes = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.limit, self.held, self.now, self.before = limit, 0, {"": b""}, {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, units: list[str]) -> None:
        """Encode distinct units that aren't known yet. What is kept is bounded by its bytes, and by those of one slice's parts."""
        if self.held > self.limit:
            self.before, self.now, self.held = self.now, {"": b""}, 0
        now, before = self.now, self.before
        now.update((u, before[u]) for u in units if u in before)
        fresh = pa.array([u for u in units if u not in now], pa.string())
        # parts are told apart by Arrow; those of letters, with or without marks, are nearly all
        core = pc.utf8_rtrim(fresh, self.MARKS)
        letters, whole = pc.match_substring_regex(core, self.LETTERS), pc.equal(core, fresh)
        joined = pc.and_not(letters, whole)
        ends, cores = strings(fresh.filter(joined)), strings(core.filter(joined))
        tails = [u[len(c) :] for u, c in zip(ends, cores, strict=True)]
        plain = strings(fresh.filter(pc.and_(letters, whole)))
        more = set(cores).difference(plain)
        now.update((u, before[u]) for u in more if u in before)
        self._learn(plain + [u for u in more if u not in now], " ")
        for tail in set(tails):
            if tail not in now:
                now[tail] = self._ids([tail])[0].tobytes()
        other = strings(fresh.filter(pc.invert(letters)))
        alone = [u for u in other if "<|" in u]
        now.update(zip(alone, (x.tobytes() for x in self._ids(alone)), strict=True))
        self._learn([u for u in other if "<|" not in u], self.MARK)
        now.update(zip(ends, map(add, map(now.__getitem__, cores), map(now.__getitem__, tails)), strict=True))
        # a part and its ids (no more than one of two bytes for each byte), two objects and their place in the table
        self.held += 3 * sum(map(len, units)) + 180 * len(units)

    def _learn(self, units: list[str], between: str) -> None:
        width, step = self.dtype.itemsize, 512 * CALL
        # the library's results are large: they live for one call
        for k in range(0, len(units), step):
            groups = [units[i : i + 512] for i in range(k, min(len(units), k + step), 512)]
            for own, ids in zip(groups, self._ids([between.join(g) for g in groups]), strict=True):
                raw = ids.tobytes()
                if between == " ":
                    ends = np.flatnonzero(self.closes[ids]) + 1
                    starts = np.concatenate([[0], ends[:-1]])
                else:
                    ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
                    starts = np.concatenate([[0], ends[:-1] + 1])
                if len(ends) != len(own):
                    raise AssertionError("parts and ids don't match")
                self.now.update(zip(own, (raw[x:y] for x, y in zip((starts * width).tolist(), (ends * width).tolist(), strict=True)), strict=True))

    def known(self, units: list[str]) -> list[bytes]:
        """Ids of distinct parts."""
        found = list(map(self.now.get, units))
        gaps = [i for i, x in enumerate(found) if x is None]
        if gaps:
            self.learn([units[i] for i in gaps])
            for i in gaps:
                found[i] = self.now[units[i]]
        return found

    def parts(self, texts: pa.Array) -> tuple[pa.ListArray, np.ndarray, list[bytes]]:
        """The parts of texts (no nulls) between spaces and line ends, which distinct one each of them is, and the ids of the distinct ones, each looked up once."""
        # lower case ASCII letters don't change the ids, unless they are a special token's
        special, texts = pc.match_substring(texts, "<|"), pc.replace_substring(texts, "\n", " ")
        plain = pc.ascii_lower(texts)
        parts = pc.split_pattern(pc.if_else(special, texts, plain) if pc.any(special).as_py() else plain, " ")
        named = parts.flatten().dictionary_encode()
        return parts, named.indices.to_numpy(), self.known(strings(named.dictionary))

    def encode(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """Ids of whole texts, the end id after each. Distinct parts are found by Arrow, looked up once, and gathered."""
        parts, at, found = self.parts(pc.fill_null(texts, ""))
        # a slice's ids are far fewer than 2 ** 31
        size = np.fromiter(map(len, found), np.int32, len(found)) // self.dtype.itemsize
        begin = np.cumsum(size, dtype=np.int32) - size
        n = size[at]
        ends = np.cumsum(n, dtype=np.int32)
        ids = np.frombuffer(b"".join(found), self.dtype)[np.repeat(begin[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int32)]
        # every text has a part, if an empty one
        cuts = [0, *ends[parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py() - 1].tolist()]
        end = np.array([end_id], self.dtype).tobytes()
        return [ids[i:j].tobytes() + end for i, j in zip(cuts, cuts[1:], strict=False)]


class WholeEncoder:
    """Encodes whole texts, for tokenizers of which nothing is known."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")

    def encode(self, texts: pa.Array, end_id: int) -> list[bytes]:
        out, rows = [], [t or "" for t in texts.to_pylist()]
        for i, j in row_slices(np.array([len(t) for t in rows], np.int64), 1 << 20):
            out += [np.array([*e.ids, end_id], self.dtype).tobytes() for e in self.tok.encode_batch_fast(rows[i:j], add_special_tokens=False)]
        return out


def splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer file has the normaliser, pre-tokenizer and word ends that UnitEncoder counts on."""
    with open(path, encoding="utf-8") as f:
        c = json.load(f)
    norm = [(n["type"], n.get("content")) for n in (c.get("normalizer") or {}).get("normalizers", ())]
    pre = (c.get("pre_tokenizer") or {}).get("pretokenizers", ())
    pattern = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    split = len(pre) == 2 and pre[0].get("pattern") == {"Regex": pattern} and (pre[0].get("behavior"), pre[0].get("invert")) == ("Removed", True) and pre[1]["type"] == "ByteLevel" and not pre[1].get("add_prefix_space")
    added = {t["content"] for t in c.get("added_tokens", ()) if not t["normalized"]}
    words = c["model"].get("type") == "BPE" and c["model"].get("end_of_word_suffix") == "</w>"
    return norm == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and split and words and UnitEncoder.MARK in added and all(x.startswith("<|") for x in added)


_loaded: dict[str, UnitEncoder | WholeEncoder] = {}


def encoder(path: str) -> UnitEncoder | WholeEncoder:
    """One encoder per Python worker."""
    if path not in _loaded:
        _loaded[path] = UnitEncoder(path) if splits_at_spaces(path) else WholeEncoder(path)
    return _loaded[path]


_squeeze, _expand = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(ids: bytes) -> bytes:
    return _squeeze.compress(ids)


def unpack(data: bytes, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(_expand.decompress(data), dtype)


def _tokenize(path: str, end_id: int):
    """(doc_id, width, ids): ids of `width` bytes each, packed for the way to where they are sorted."""

    def run(batches):
        coder = encoder(path)
        for batch in portions(batches):
            ids, texts = batch.column(0), batch.column(1)
            for i, j in row_slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), TEXT_SLICE):
                some = [pack(x) for x in coder.encode(texts.slice(i, j - i), end_id)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([coder.dtype.itemsize] * len(some), pa.int32()), pa.array(some, pa.binary())], names=["doc_id", "width", "ids"])
        # an idle worker keeps the newer half of what it knows
        if isinstance(coder, UnitEncoder):
            coder.before = {}

    return run


def _count(batches):
    total = np.zeros(1 << 16, np.int64)
    for batch in portions(batches):
        rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for i in range(0, len(rows), 500):
            own = np.bincount(np.concatenate([unpack(x, np.dtype(f"<u{w}")) for w, x in rows[i : i + 500]]))
            if len(own) > len(total):
                total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
            total[: len(own)] += own
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["symbol", "n"])


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    merged, leaf = weights, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        leaf.append(by < n)
        merged = both[by]
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for flags in reversed(leaf):
        own = int(flags[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


@dataclass
class Code:
    """A canonical code: codes ascend by (length, symbol)."""

    symbols: np.ndarray
    lengths: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.symbols, self.lengths))
        self.symbols, self.lengths = self.symbols[order], self.lengths[order]
        self.bits = int(self.lengths.max()) if len(order) else 1
        steps = np.int64(1) << (self.bits - self.lengths)
        left = np.cumsum(steps) - steps
        self.codes = (left >> (self.bits - self.lengths)).astype(np.uint64)
        self.table = np.zeros(1 << self.bits, np.int64)
        self.table[: int(steps.sum())] = np.repeat((self.symbols << 5) | self.lengths, steps)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Bits of each lane and the payload."""
        if not hasattr(self, "_at"):
            self._at = np.full(int(self.symbols.max()) + 1, -1)
            self._at[self.symbols] = np.arange(len(self.symbols))
        at = self._at[ids]
        size, code = self.lengths[at], self.codes[at]
        end = np.cumsum(size)
        start = end - size
        word, shift = start >> 5, (64 - size - (start & 31)).astype(np.uint64)
        value = code << shift
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out = np.zeros(int(end[-1] >> 5) + 3, np.uint64)
        out[word[cut]] = np.bitwise_or.reduceat(value >> np.uint64(32), cut)
        out[word[cut] + 1] |= np.bitwise_or.reduceat(value & np.uint64(0xFFFFFFFF), cut)
        payload = out.astype(">u4").tobytes()[: int(end[-1] + 7) // 8] + bytes(8)
        marks = np.concatenate([start[::LANE], [end[-1]]])
        return np.diff(marks).astype("<u2"), payload

    def decode(self, lanes: np.ndarray, payload: np.ndarray, n: int) -> np.ndarray:
        """All lanes step by step; ids in order."""
        b = payload.astype(np.uint32)
        wide = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
        at = np.concatenate([[0], np.cumsum(lanes.astype(np.int64))])[:-1]
        out = np.zeros((len(lanes), LANE), DTYPE)
        mask, last = np.uint32((1 << self.bits) - 1), len(wide) - 1
        for k in range(LANE):
            x = wide[np.minimum(at >> 3, last)]
            e = self.table[(x >> (32 - self.bits - (at & 7)).astype(np.uint32)) & mask]
            out[:, k] = e >> 5
            at = at + (e & 31)
        return out.ravel()[:n]


def pack_segment(code: Code, doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    ids = np.concatenate(docs)
    lanes, payload = code.encode(ids)
    head = MAGIC + struct.pack("<IIQ", len(docs), len(lanes), len(ids))
    own = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([len(d) for d in docs], "<u4").tobytes() + np.array([x is None for x in doc_ids], "u1").tobytes()
    return head + own + lanes.tobytes() + payload


def unpack_segment(code: Code, data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, number of ids of each, all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n_lanes, n = struct.unpack_from("<IIQ", data, 4)
    at = 20
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    sizes = np.frombuffer(data, "<u4", n_docs, at := at + 8 * n_docs)
    nulls = np.frombuffer(data, "u1", n_docs, at := at + 4 * n_docs)
    lanes = np.frombuffer(data, "<u2", n_lanes, at := at + n_docs)
    payload = np.frombuffer(data, "u1", offset=at + 2 * n_lanes)
    return [None if z else x for x, z in zip(doc_ids.tolist(), nulls.tolist(), strict=True)], sizes.astype(np.int64), code.decode(lanes, payload, n)


def _write(shared: Broadcast):
    def run(batches):
        code, shard = Code(*shared.value), TaskContext.get().partitionId()
        ids, docs, size, first, number = [], [], 0, 0, 0

        def segment():
            data = pack_segment(code, ids, docs)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (number, pa.int32()), (first, pa.int64()), (size, pa.int64()), (len(ids), pa.int32()), (data, pa.binary()))], names=["shard", "segment", "first", "n_tokens", "n_docs", "data"])

        for batch in portions(batches, 200):
            for i, w, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids.append(i)
                docs.append(unpack(x, np.dtype(f"<u{w}")))
                size += len(docs[-1])
                if size >= SEGMENT:
                    yield segment()
                    first, number = first + size, number + 1
                    ids, docs, size = [], [], 0
        if ids:
            yield segment()

    return run


def _read(shared: Broadcast):
    def run(batches):
        code = Code(*shared.value)
        for batch in portions(batches):
            for shard, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                doc_ids, sizes, ids = unpack_segment(code, data.as_py())
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(first + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    return run


def _codebook(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and lengths; one row per id of the vocabulary at most."""
    rows = table.collect()
    return np.array([r.symbol for r in rows], np.int64), np.array([r.length for r in rows], np.int64)


def write_store(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode docs and write the store below path."""
    spark = docs.sparkSession
    encoded = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_tokenize(tokenizer or tokenizer_path(), end_id), "doc_id long, width int, ids binary"), "ids")
    counts = encoded.select("width", "ids").mapInArrow(_count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).orderBy("symbol").collect()
    symbols = np.array([r.symbol for r in counts], np.int64)
    lengths = code_lengths(np.array([r.n for r in counts], np.int64))
    spark.createDataFrame(list(zip(symbols.tolist(), lengths.tolist(), strict=True)), "symbol long, length long").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((symbols, lengths))
    ordered = encoded.repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(_write(shared), "shard int, segment int, first long, n_tokens long, n_docs int, data binary").write.option("compression", "none").parquet(f"{path}/segments")
    sums = spark.read.parquet(f"{path}/segments").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).write.parquet(f"{path}/shards")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: doc_id, start, n_tokens, ids_crc32, from the decoded ids."""
    shared = spark.sparkContext.broadcast(_codebook(spark.read.parquet(f"{path}/codebook")))
    docs = spark.read.parquet(f"{path}/segments").select("shard", "first", "data").mapInArrow(_read(shared), "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return docs.join(spark.read.parquet(f"{path}/shards"), "shard").select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded, written and read back."""
    path = new_path(spark, "tokens")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_store(spark, path)
