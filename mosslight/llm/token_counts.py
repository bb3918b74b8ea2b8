"""Token counts that follow edits.

Method. For each document the counts of its pre-tokens (parts between spaces, which the tokenizer
never joins) are the leaves of a segment tree, `LEAF` pre-tokens to a leaf, with the sum of every
subtree. An edit replaces a range of characters. Only the leaves that an edit touches, with one
character of context on both sides, are encoded again, and cut into leaves anew; the sums above them
are updated. The root is the document's count.

Trees are kept: `with_trees` adds a document's leaves (their characters and tokens) to its row, as a
column that is stored with the table; `apply_edits` takes stored rows, and gives the edited text with
its tree, ready to be stored and edited again. Untouched leaves are never encoded a second time.

Scale. One pass without a shuffle; a document's tree lives in one task while it is worked on, and is
a few bytes for each leaf. Each pre-token is encoded once per worker and its count kept in a bounded
cache; the leaves of a slice of texts are counted at once, each distinct part looked up once.

Edge cases: a null text counts 0 tokens, has a null tree and takes no edits (they are refused); an
empty text counts 0 and may be edited. Edits are in characters of the text before any edit of their
list; they are applied in order of position, equal ones in the list's order; those that overlap an
earlier one, lie outside the text or hold a null are refused (and counted). An insertion is an edit
of an empty range. Repeated rows, and rows with equal doc_id, are rows of their own. A very long text
is one tree. An empty table gives an empty result. Input columns are carried; one that has the name
of a result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .scratch import written
from .token_store import TEXT_SLICE, UnitEncoder, encoder, tokenizer_path

LEAF = 16
#: What the query redacts: e-mail addresses, and runs of digits with separators.
MAIL, NUMBER = r"(?<![\w.+-])[\w.+-]+@[\w-]+\.[\w.-]+", r"\d[\d ().-]{7,}\d"
REDACTED = "<redacted>"
TREE = "struct<chars:array<int>,tokens:array<int>>"
EDITS = "array<struct<start:int,end:int,text:string>>"
COUNTS = ("n_tokens", "n_tokens_edited", "n_units", "n_recounted", "n_refused")
_TREE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of pre-tokens, with a bounded cache per worker."""
    coder = encoder(path)
    if not isinstance(coder, UnitEncoder):
        raise ValueError(f"{path} may join characters across spaces")

    def count(units: list[str]) -> list[int]:
        return [len(x) // coder.dtype.itemsize for x in coder.known([u if "<|" in u else u.lower() if u.isascii() else u for u in units])]

    return count


class TokenTree:
    """Segment tree over the pre-tokens of one text. chars and tokens are those of its leaves; a leaf's last separator, or the text's end, counts as a character of it."""

    def __init__(self, text: str, chars: np.ndarray, tokens: np.ndarray, count: Callable[[list[str]], list[int]], leaf: int = LEAF):
        self.text, self.count, self.leaf = text, count, leaf
        self.chars, self.tokens = np.asarray(chars, np.int64), np.asarray(tokens, np.int64)
        self.recounted, self.refused = 0, 0
        self._sum_up()

    @classmethod
    def build(cls, text: str, count: Callable[[list[str]], list[int]], leaf: int = LEAF) -> TokenTree:
        units = text.split(" ")
        return cls(text, *cls.leaves(units, count(units), leaf), count, leaf)

    @staticmethod
    def leaves(units: list[str], counts: list[int], leaf: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(units), leaf)
        return np.add.reduceat(np.array([len(u) + 1 for u in units], np.int64), at), np.add.reduceat(np.array(counts, np.int64), at)

    def _sum_up(self) -> None:
        n = len(self.tokens)
        self.width = 1 << max(0, (n - 1).bit_length())
        self.sums = np.zeros(2 * self.width, np.int64)
        self.sums[self.width : self.width + n] = self.tokens
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def _set(self, leaf: int, value: int) -> None:
        at = self.width + leaf
        more = value - int(self.sums[at])
        while at and more:
            self.sums[at] += more
            at >>= 1

    def apply(self, edits: Iterable[tuple[int, int, str]]) -> str:
        """Apply edits (start, end, replacement) to text and tree; give the new text."""
        usable, last = [], 0
        for a, b, new in sorted((e for e in edits if None not in e), key=lambda e: (e[0], e[1])):
            if a < last or b < a or b > len(self.text):
                self.refused += 1
                continue
            usable.append((a, b, new))
            last = b
        begins = np.concatenate([[0], np.cumsum(self.chars)])
        # touched leaves; edits whose leaves meet are counted together
        groups: list[list] = []
        for a, b, new in usable:
            lo = int(np.searchsorted(begins, max(0, a - 1), "right")) - 1
            hi = min(int(np.searchsorted(begins, b + 1, "right")) - 1, len(begins) - 2)
            lo = min(lo, hi)
            if groups and lo <= groups[-1][1]:
                groups[-1][1] = max(hi, groups[-1][1])
                groups[-1][2].append((a, b, new))
            else:
                groups.append([lo, hi, [(a, b, new)]])
        parts, at, fresh_leaves, moved = [], 0, [], False
        for lo, hi, own in groups:
            begin, end = int(begins[lo]), int(begins[hi + 1]) - 1
            region, p = [], begin
            for a, b, new in own:
                region += [self.text[p:a], new]
                p = b
            fresh = "".join(region) + self.text[p:end]
            units = fresh.split(" ")
            self.recounted += len(units)
            fresh_leaves.append((lo, hi, *self.leaves(units, self.count(units), self.leaf)))
            moved |= len(fresh_leaves[-1][2]) != hi + 1 - lo
            parts += [self.text[at:begin], fresh]
            at = end
        self.text = "".join(parts) + self.text[at:]
        if moved:
            for k, col in enumerate(("chars", "tokens")):
                old, pieces, at = getattr(self, col), [], 0
                for lo, hi, *new in fresh_leaves:
                    pieces += [old[at:lo], new[k]]
                    at = hi + 1
                setattr(self, col, np.concatenate([*pieces, old[at:]]))
            self._sum_up()
        else:
            for lo, hi, chars, tokens in fresh_leaves:
                self.chars[lo : hi + 1], self.tokens[lo : hi + 1] = chars, tokens
                for leaf, value in zip(range(lo, hi + 1), tokens.tolist(), strict=True):
                    self._set(leaf, value)
        return self.text


def leaves_of(texts: pa.Array, coder: UnitEncoder, leaf: int = LEAF) -> pa.StructArray:
    """The leaves of the trees that TokenTree.build makes of texts, for all of them at once; null for null."""
    known = texts.fill_null("")
    # parts end at line ends too; those up to a space, or the text's end, are one pre-token
    parts, at, found = coder.parts(known)
    ends = parts.offsets.to_numpy()[1:] - parts.offsets[0].as_py()
    data, _ = K.flat(known)
    closes = np.ones(len(at), bool)
    inner = np.ones(len(at), bool)
    inner[ends - 1] = False
    closes[inner] = data[(data == 0x20) | (data == 0x0A)] == 0x20
    unit = np.cumsum(closes) - closes
    begins = np.concatenate([[0], ends[:-1]])
    unit -= np.repeat(unit[begins], ends - begins)
    # a leaf begins with each text, and after every `leaf` pre-tokens
    first = np.zeros(len(at), bool)
    first[1:] = closes[:-1] & (unit[1:] % leaf == 0)
    first[begins] = True
    first = np.flatnonzero(first)
    size = np.fromiter(map(len, found), np.int32, len(found)) // coder.dtype.itemsize
    chars = pc.utf8_length(parts.flatten()).to_numpy() + 1
    offsets = pa.array(np.append(np.searchsorted(first, begins), len(first)).astype(np.int32))
    sums = (np.add.reduceat(x, first).astype(np.int32) if len(first) else np.empty(0, np.int32) for x in (chars, size[at]))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x)) for x in sums], fields=list(_TREE), mask=texts.is_null())


def _trees(path: str, text: str, tree: str, keep: list[str]):
    def run(batches):
        counter(path)  # or refuses
        coder = encoder(path)
        for batch in K.portions(batches):
            for i, j in K.row_slices(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(), TEXT_SLICE):
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), leaves_of(own.column(text), coder)], names=[*keep, tree])

    return run


def with_trees(docs: DataFrame, *, text: str = "text", tree: str = "tree", tokenizer: str | None = None) -> DataFrame:
    """docs with the leaves of each text's tree, to be stored with it."""
    keep = [c for c in docs.columns if c != tree]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(tree, T._parse_datatype_string(TREE))])
    return docs.select(*keep).mapInArrow(_trees(tokenizer or tokenizer_path(), text, tree, keep), schema)


def _edited(path: str, text: str, edits: str, tree: str, keep: list[str]):
    def run(batches):
        count = counter(path)
        for batch in K.portions(batches):
            rows: list[list] = [[] for _ in COUNTS]
            texts, trees = [], []
            for t, changes, stored in zip(*(batch.column(c).to_pylist() for c in (text, edits, tree)), strict=True):
                if t is None:
                    row = (0, 0, 0, 0, len(changes or ()))
                    texts.append(None)
                    trees.append(None)
                else:
                    own = TokenTree(t, stored["chars"], stored["tokens"], count) if stored is not None else TokenTree.build(t, count)
                    before = own.total
                    if changes:
                        own.apply([(e["start"], e["end"], e["text"]) for e in changes if e is not None])
                    row = (before, own.total, t.count(" ") + 1, own.recounted, own.refused + sum(e is None or None in e.values() for e in changes or ()))
                    texts.append(own.text)
                    trees.append({"chars": own.chars.tolist(), "tokens": own.tokens.tolist()} if tree in keep else None)
                for col, x in zip(rows, row, strict=True):
                    col.append(x)
            cols = {c: pa.array(texts, pa.string()) if c == text else pa.array(trees, _TREE) if c == tree else batch.column(c) for c in keep}
            cols |= {c: pa.array(x, pa.int64()) for c, x in zip(COUNTS, rows, strict=True)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def apply_edits(docs: DataFrame, *, text: str = "text", edits: str = "edits", tree: str = "tree", keep: list[str] | None = None, tokenizer: str | None = None) -> DataFrame:
    """Rows with a text, its tree and `edits` (array<struct<start, end, text>>): text and tree after the edits, counts before and after, and how much was counted again.

    `keep` names the columns that the result carries (all but the edits by default).
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (*COUNTS, edits)]
    rows = docs.select(*dict.fromkeys([*keep, text, tree])).withColumn(edits, F.lit(None).cast(EDITS)) if edits not in docs.columns else docs.select(*dict.fromkeys([*keep, text, tree]), F.col(edits).cast(EDITS).alias(edits))
    schema = T.StructType([*(rows.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return rows.mapInArrow(_edited(tokenizer or tokenizer_path(), text, edits, tree, keep), schema)


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", edits: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """Per row of docs, whose `edits` are array<struct<start, end, text>>: doc_id, counts before and after, and how much was counted again."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(edits).cast(EDITS).alias("edits"))
    return apply_edits(with_trees(rows, tokenizer=tokenizer), keep=["doc_id"], tokenizer=tokenizer)


_MAIL, _NUMBER = re.compile(MAIL), re.compile(NUMBER)


def redactions(text: str) -> list[dict]:
    """Edits that replace mail addresses and numbers; a text without an @ isn't searched for the first."""
    found = [*(_MAIL.finditer(text) if "@" in text else ()), *_NUMBER.finditer(text)]
    return [{"start": m.start(), "end": m.end(), "text": REDACTED} for m in found]


def with_redactions(docs: DataFrame, text: str = "text", edits: str = "edits") -> DataFrame:
    """docs with the redactions as column `edits`; a column of that name is replaced."""

    @F.pandas_udf(EDITS)
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redactions(t) for t in texts])

    return docs.withColumn(edits, find(text))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents from their stored trees, and after redaction."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    stored = written(with_trees(docs), "trees", "zstd")
    return apply_edits(with_redactions(stored), keep=["doc_id"])
