"""Language identification by error-correcting output codes.

Method. Every language gets a binary codeword. For each bit a binary classifier over hashed byte
n-grams (1 to 4 bytes, letters only, word edges included) says how likely the bit is set. A text
is decoded to the language whose codeword has the least total logistic loss under the bits'
margins (loss-weighted decoding). The text is flagged as ambiguous where the best two codewords
lie close together.

Training. Labelled rows only: those with a language, a text and crc32(doc_id as text) mod 5 other
than 0. The classifiers are fitted on a bounded sample of them, at most `TRAIN_DOCS` whole texts
of any length in all, the same number for each language; the rows with the smallest hash are taken,
so reruns agree. The bit weights are smoothed log odds of the n-grams, scaled by a logistic fit.
Language, source and doc_id are no inputs of a prediction. Texts stay with the executors: n-grams
are counted in the tasks, in whole numbers, so that the order of tasks leaves no trace; what comes
to the driver is a count per language and bucket, and one number per text and bit.

Prediction is one pass over the table without a shuffle; the model has a fixed number of buckets.

Edge cases: a null text, or one without any letter, is `und` with score 0. Without training rows
everything is `und`. With one learned language every text with a letter gets it, with score 1.
Repeated rows get equal results. Languages that fit equally well: the first in code point order.
A very long text is read whole, piece by piece. A null doc_id counts as an empty text for the fold.
An empty table gives an empty result. Input columns are carried, but for those with the names of
result columns, which are replaced; a caller that needs them renames them first.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import kernels as K
from .scratch import drop, written

#: Labelled texts that the classifiers are fitted on, at most; tasks that they are dealt to.
TRAIN_DOCS, TASKS = 4_000, 32
BUCKET_BITS, ORDERS = 16, (1, 2, 3, 4)
SLICE = 1 << 18
AMBIGUOUS = 0.6
UNDETERMINED = "und"
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:256] = True
_SHIFT = np.uint64(64 - BUCKET_BITS)


def codewords(n: int) -> np.ndarray:
    """n codewords of -1 and 1, far apart: all columns that split n languages for few of them, else the best of some random codes."""
    if n <= 5:
        cols = [[1 if (c >> (n - 1 - i)) & 1 else -1 for i in range(n)] for c in range(1 << (n - 1), (1 << n) - 1)] if n > 1 else [[1]]
        return np.array(cols, np.float32).T.copy()
    bits, best, score = max(15, int(np.ceil(10 * np.log2(n)))), None, -1
    draw = np.random.Generator(np.random.PCG64(n))
    for _ in range(200):
        code = draw.choice(np.array([-1, 1], np.float32), (n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        gap = (bits - code @ code.T) / 2
        np.fill_diagonal(gap, bits)
        if gap.min() > score:
            best, score = code, gap.min()
    return best


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of a slice of rows, and the row of each."""
    n_rows = len(offs) - 1
    # each row stands between spaces, so that n-grams don't cross rows
    at = np.arange(len(data)) + np.repeat(np.arange(n_rows) + 1, np.diff(offs))
    text = np.full(len(data) + n_rows + 1, 32, np.uint8)
    text[at] = data
    text[~_LETTER[text]] = 32
    space = text == 32
    keep = np.ones(len(text), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    row = np.cumsum(np.bincount(offs[:-1] + np.arange(n_rows), minlength=len(text))) - 1
    text, row, space = text[keep].astype(np.uint64), row[keep], space[keep]
    buckets, rows = [], []
    rolled = np.zeros(len(text), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(text) - n + 1
        if m <= 0:
            break
        rolled = (rolled[:m] << np.uint64(8)) | text[n - 1 :]
        if n not in ORDERS:
            continue
        whole = ~space[:m] | ~space[n - 1 :] if n <= 2 else np.ones(m, bool)
        for t in range(1, n - 1):
            whole &= ~space[t : t + m]
        h = ((rolled[whole] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> _SHIFT
        buckets.append(h.astype(np.int64))
        # an n-gram that begins with a space belongs to the row of its first letter
        at = np.flatnonzero(whole)
        rows.append(row[at + space[at]] if n > 1 else row[at])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(rows)


def _slices(col: pa.Array):
    if not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    return K.text_slices(pc.utf8_lower(pc.fill_null(col, "")), SLICE)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray  # bucket x bit
    scale: np.ndarray
    bias: np.ndarray

    @functools.cached_property
    def columns(self) -> np.ndarray:
        """The weights bit by bit, each contiguous."""
        return np.ascontiguousarray(self.weights.T)

    def margins(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        return total / np.maximum(count, 1)[:, None] * self.scale + self.bias

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Mean logistic loss of each codeword; rows x languages."""
        return np.logaddexp(0, -margins[:, None, :] * self.codes[None]).mean(axis=2)

    def totals(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n = len(col)
        total, count = np.zeros((n, self.codes.shape[1])), np.zeros(n, np.int64)
        for i, j, data, offs in _slices(col):
            # a very long row is summed piece by piece
            for piece, off in _pieces(data, offs):
                bucket, row = grams(piece, off)
                for b in range(total.shape[1]):
                    total[i:j, b] += np.bincount(row, self.columns[b][bucket], minlength=j - i)
                count[i:j] += np.bincount(row, minlength=j - i)
        return total, count


def _pieces(data: np.ndarray, offs: np.ndarray):
    """The slice itself, or a single long row in pieces that end at a non-letter, if one is near."""
    if len(offs) != 2 or len(data) <= 2 * SLICE:
        yield data, offs
        return
    a = 0
    while a < len(data):
        b = min(len(data), a + SLICE)
        if b < len(data):
            gap = np.flatnonzero(~_LETTER[data[max(a, b - 4096) : b]])
            b = max(a, b - 4096) + int(gap[-1]) + 1 if len(gap) else b
        yield data[a:b], np.array([0, b - a])
        a = b


def gram_counts(labels: list[int], texts: pa.Array, n: int) -> np.ndarray:
    """Shares of the buckets in the texts of each language, in units of 2 ** -40; language x bucket."""
    counts, label = np.zeros((n, 1 << BUCKET_BITS), np.int64), np.array(labels, np.int64)
    for i, j, data, offs in _slices(texts):
        bucket, row = grams(data, offs)
        # each document counts alike, so that a few long ones don't decide
        share = (1 << 40) // np.maximum(np.bincount(row, minlength=j - i), 1)
        for lang in np.unique(label[i:j]).tolist():
            own = label[i:j][row] == lang
            np.add.at(counts[lang], bucket[own], share[row[own]])
    return counts


def weigh(languages: list[str], counts: np.ndarray) -> Model:
    """A model whose bits are the log odds of the counted shares, not scaled yet."""
    codes = codewords(len(languages))
    counts = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1) + 1e-6
    bits = codes.shape[1]
    weights = np.zeros((counts.shape[1], bits))
    for b in range(bits):
        yes, no = counts[codes[:, b] > 0], counts[codes[:, b] < 0]
        weights[:, b] = np.log(yes.mean(axis=0) / no.mean(axis=0)) if len(yes) and len(no) else 0
    return Model(languages, codes, weights, np.ones(bits), np.zeros(bits))


def scale(model: Model, labels: np.ndarray, x: np.ndarray) -> Model:
    """Fit scale and bias of each bit to texts whose mean weights are x."""
    for b in range(x.shape[1] if len(model.languages) > 1 else 0):
        model.scale[b], model.bias[b] = _logistic(x[:, b], model.codes[labels, b])
    return model


def fit(rows: list[tuple[str, str]]) -> Model | None:
    """Train on (language, text) pairs in one place; train() does the same in the tasks."""
    languages = sorted({x for x, _ in rows}, key=lambda x: x.encode())
    if not languages:
        return None
    labels, texts = [languages.index(x) for x, _ in rows], pa.array([t for _, t in rows], pa.string())
    model = weigh(languages, gram_counts(labels, texts, len(languages)))
    total, count = model.totals(texts)
    return scale(model, np.array(labels), total / np.maximum(count, 1)[:, None])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and bias of a one-variable logistic regression, by damped Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-y * (a * x + b)))
        g, w = y * (1 - p), p * (1 - p)
        ridge = 1e-3
        grad = np.array([(g * x).mean() - ridge * a, g.mean() - ridge * b])
        hess = np.array([[(w * x * x).mean() + ridge, (w * x).mean()], [(w * x).mean(), w.mean() + ridge]])
        step = np.linalg.solve(hess, grad)
        a, b = a + float(np.clip(step[0], -20, 20)), b + float(np.clip(step[1], -20, 20))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def _fold(doc_id: str):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def _count(languages: list[str]):
    def run(batches):
        total, place = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64), {x: i for i, x in enumerate(languages)}
        for batch in K.portions(batches):
            total += gram_counts([place[x] for x in batch.column(0).to_pylist()], batch.column(1), len(languages))
        for i in np.flatnonzero(total.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([total[i].tobytes()], pa.binary())], names=["l", "counts"])

    return run


def _sum(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[i] = sums.get(i, 0) + np.frombuffer(raw, np.int64)
    for i, x in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([x.tobytes()], pa.binary())], names=["l", "counts"])


def _means(shared: Broadcast):
    def run(batches):
        model: Model = shared.value
        place = {x: i for i, x in enumerate(model.languages)}
        for batch in K.portions(batches):
            total, count = model.totals(batch.column(1))
            x = (total / np.maximum(count, 1)[:, None]).astype("<f8")
            yield pa.RecordBatch.from_arrays([pa.array([place[k] for k in batch.column(0).to_pylist()], pa.int64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["l", "x"])

    return run


def sample(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = TRAIN_DOCS) -> DataFrame:
    """(l, t): the bounded sample that the module's text describes, with its languages."""
    usable = docs.where((_fold(doc_id) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("string").alias("i"), F.col(lang).alias("l"), F.col(text).alias("t"))
    counts = {r[0]: r[1] for r in usable.groupBy("l").count().collect()}
    each = max(1, limit // max(1, len(counts)))
    space = 1_000_000_007
    rank = F.pmod(F.xxhash64("i", "t"), F.lit(space))
    # the hash threshold lets a few more through than asked for, so that few texts move to where they are ranked
    bound = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, (each + 4 * each**0.5 + 10) / n) * space))]) if counts else F.create_map(F.lit(""), F.lit(0))
    near = usable.withColumn("h", rank).where(F.col("h") <= bound[F.col("l")])
    nth = F.row_number().over(Window.partitionBy("l").orderBy("h", "i", "t"))
    return near.withColumn("nth", nth).where(F.col("nth") <= each).select("l", "t")


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", limit: int = TRAIN_DOCS) -> Model | None:
    """Fit on the bounded sample that the module's text describes."""
    spark = docs.sparkSession
    # dealt out again: the ranked rows of a language lie in one partition
    rows = written(sample(docs, doc_id=doc_id, text=text, lang=lang, limit=limit).repartition(TASKS), "sample")
    languages = sorted((r[0] for r in rows.select("l").distinct().collect()), key=lambda x: x.encode())
    if not languages:
        return None
    counts = np.zeros((len(languages), 1 << BUCKET_BITS), np.int64)
    summed = rows.mapInArrow(_count(languages), "l long, counts binary").repartition("l").mapInArrow(_sum, "l long, counts binary")
    for r in summed.toLocalIterator():
        counts[r.l] = np.frombuffer(r.counts, np.int64)
    model = weigh(languages, counts)
    shared = spark.sparkContext.broadcast(model)
    means = rows.mapInArrow(_means(shared), "l long, x binary").toPandas()
    shared.destroy()
    drop(rows)
    # the sums of a fit depend on the order of its rows
    means = means.sort_values(["l", "x"])
    return scale(model, means["l"].to_numpy(), np.frombuffer(b"".join(means["x"]), "<f8").reshape(len(means), -1))


RESULT = {"lang_pred": (pa.string(), T.StringType()), "score": (pa.float64(), T.DoubleType()), "ambiguous": (pa.bool_(), T.BooleanType())}


def _predict(shared: Broadcast, text: str, keep: list[str]):
    def run(batches):
        model: Model | None = shared.value
        for batch in K.portions(batches):
            col, n = batch.column(text), batch.num_rows
            pred: list[str] = [UNDETERMINED] * n
            score, doubt = np.zeros(n), np.zeros(n, bool)
            if model is not None and n:
                total, count = model.totals(col)
                losses = model.losses(model.margins(total, count))
                order = np.argsort(losses, axis=1, kind="stable")
                best = order[:, 0]
                soft = np.exp(-model.codes.shape[1] * (losses - losses.min(axis=1, keepdims=True)))
                p = soft[np.arange(n), best] / soft.sum(axis=1)
                letters = _has_letter(col)
                score = np.where(letters, p, 0.0)
                doubt = letters & (p < AMBIGUOUS)
                pred = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            cols = {c: batch.column(c) for c in keep} | {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(score), "ambiguous": pa.array(doubt)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return run


def _has_letter(col: pa.Array) -> np.ndarray:
    """Whether each text has a character of category L."""
    out = np.zeros(len(col), bool)
    plain = np.zeros(256, bool)
    plain[65:91] = plain[97:123] = True
    for i, j, data, offs in K.text_slices(col):
        sums = np.concatenate([[0], np.cumsum(plain[data])])
        out[i:j] = sums[offs[1:]] > sums[offs[:-1]]
    for i in np.flatnonzero(~out).tolist():
        out[i] = any(c.isalpha() for c in (col[i].as_py() or ""))
    return out


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of docs (all by default) with lang_pred, score and ambiguous."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, t) for c, (_, t) in RESULT.items())])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(_predict(shared, text, keep), schema)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), train(docs), keep=["doc_id"])
    return out.select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
