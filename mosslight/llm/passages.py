"""Which texts share a run of words with another text.

Words are `[^\\x20\\x09-\\x0D]+` as they stand. Where a run begins and ends in a line or a text does
not matter, and every run of `words` words is found: the answer is that of comparing all windows.

Method. In each window of `words` words the smallest hash of its `GRAM`-word strings (the leftmost
of equal ones) is the window's anchor. Equal windows have equal anchors at equal places, so only
windows with one anchor are compared. The successive windows that share one anchor position form a
segment, named by a digest.

1. Anchors are counted; those that stand in one text only hold nothing shared.
2. A segment that stands in two texts is shared as a whole.
3. Where an anchor has several segments, one text of each is read again and gives the hashes of the
   segment's windows; those that two texts gave are shared.

Scale. A segment is three numbers, about one for 20 words. Texts move for step 3 only. Windows are
compared by 64-bit hashes. Edge cases: null or shorter texts share nothing; a run that a text only
repeats itself is not shared; rows with one key count as one text; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .scratch import drop, written

#: A passage has more than 50 words.
WORDS, GRAM = 51, 12
BROADCAST_ROWS = 250_000
_PLACE_BITS = 20


@dataclass
class Segments:
    """Segments of a slice of texts, in order; `windows` are the hashes of all windows, `segment` tells whose they are."""

    rows: np.ndarray
    anchors: np.ndarray
    digests: np.ndarray
    windows: np.ndarray
    segment: np.ndarray


def segments(data: np.ndarray, offs: np.ndarray, words: int = WORDS) -> Segments:
    starts, ends, rows = K.word_spans(data, offs, K.SPACED)
    size, gram = len(starts), min(GRAM, words)
    n = size - words + 1
    at = np.flatnonzero(rows[:n] == rows[words - 1 :]) if n > 0 else np.empty(0, np.int64)
    if not len(at):
        return Segments(np.empty(0, np.int64), *(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.int64))
    up, down = K._power(max(size + 1, K.SLICE_BYTES + 1))
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(K.span_hashes(data, starts, ends) * up[:size], out=total[1:])
    grams = K.mix64((total[gram:] - total[:-gram]) * down[: size - gram + 1])
    # the place in the low bits makes the leftmost of equal ones the smallest, and tells where it is
    low = np.uint64((1 << max(_PLACE_BITS, size.bit_length())) - 1)
    place = (K.window_minima((grams & ~low) | np.arange(len(grams), dtype=np.uint64), words - gram + 1)[at] & low).astype(np.int64)
    new = np.concatenate([[True], (np.diff(at) != 1) | (np.diff(place) != 0)])
    first, last = at[new], at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] + words
    shape = ((last - first) << 20 | (place[new] - first)).astype(np.uint64)
    digests = K.mix64((total[last] - total[first]) * down[first] + K.mix64(shape))
    windows = K.mix64((total[at + words] - total[at]) * down[at])
    found = Segments(rows[first], grams[place[new]].view(np.int64), digests.view(np.int64), windows.view(np.int64), np.cumsum(new) - 1)
    if size > K.SLICE_BYTES:
        K._powers[:] = [p[: K.SLICE_BYTES + 1] for p in K._powers]
    return found


def _segments(words: int):
    """(key, anchor, digest) of every segment."""

    def run(batches):
        for batch in K.portions(batches):
            keys = batch.column(0).to_numpy()
            for i, _, data, offs in K.text_slices(batch.column(1)):
                s = segments(data, offs, words)
                yield pa.RecordBatch.from_arrays([pa.array(keys[i + s.rows]), pa.array(s.anchors), pa.array(s.digests)], names=["key", "anchor", "digest"])

    return run


def _windows(words: int):
    """(window, key) of the windows of the wanted segments of each text, each once."""

    def run(batches):
        for batch in K.portions(batches):
            keys, wanted = batch.column(0).to_numpy(), batch.column(2)
            for i, j, data, offs in K.text_slices(batch.column(1)):
                s = segments(data, offs, words)
                cut = np.searchsorted(s.rows, np.arange(j - i + 1))
                for r in range(j - i):
                    a, b = int(cut[r]), int(cut[r + 1])
                    x, y = np.searchsorted(s.segment, (a, b))
                    own = np.unique(s.windows[x:y][np.isin(s.digests[a:b], wanted[i + r].values.to_numpy())[s.segment[x:y] - a]])
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), keys[i + r]))], names=["window", "key"])

    return run


def sharing(texts: DataFrame, *, key: str = "key", text: str = "text", words: int = WORDS) -> DataFrame:
    """The keys (long, one for each text) of the texts in which a run of `words` words stands that a text of another key has too."""
    texts = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    least = (F.min("key").alias("a"), F.max("key").alias("b"))
    every = written(texts.mapInArrow(_segments(words), "key long, anchor long, digest long"), "runs")
    # tables of one row for each anchor are written first: a join with them can then be split where an anchor is very common
    met = written(every.groupBy("anchor").agg(*least, (F.min("digest") != F.max("digest")).alias("differ")).where("a <> b").select("anchor", "differ"), "met")
    again = written(every.join(met, "anchor"), "runs")
    drop(every)
    kinds = written(again.groupBy("anchor", "digest").agg(*least, F.max("differ").alias("differ")), "kinds")
    whole = written(kinds.where("a <> b").select("anchor", "digest"), "whole")
    alike = again.join(whole, ["anchor", "digest"]).select("key")
    wanted = written(kinds.where("differ").groupBy(F.col("a").alias("key")).agg(F.collect_set("digest").alias("wanted")), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        texts = texts.join(F.broadcast(wanted.select("key")), "key", "left_semi")
    parted = texts.join(wanted, "key").dropDuplicates(["key"]).select("key", "text", "wanted")
    windows = written(parted.mapInArrow(_windows(words), "window long, key long"), "windows")
    common = written(windows.groupBy("window").agg(*least).where("a <> b").select("window"), "common")
    out = written(alike.unionByName(windows.join(common, "window").select("key")).distinct(), "sharing")
    for table in (met, again, kinds, whole, wanted, windows, common):
        drop(table)
    return out
