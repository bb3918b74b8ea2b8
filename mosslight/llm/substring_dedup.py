"""Removal of every byte covered by a string of `LENGTH` bytes that also starts elsewhere.

Method. Threshold-bounded interval expansion on a Burrows-Wheeler transform: suffixes are sorted,
and a breadth-first search extends intervals of the transform backward by `STRIDE` symbols at a time.
Level by level it fixes which neighbouring suffixes have a common prefix shorter than `LENGTH`; it
stops at that level. Suffixes between which nothing was fixed share `LENGTH` bytes.

One transform over a whole corpus does not fit a machine, so the corpus is cut where equal strings
must be cut alike: in every window of `LENGTH` bytes the smallest hash of its `GRAM`-byte strings
(the leftmost of equal ones) is the window's anchor. Equal windows have equal anchors at equal
places, so windows may be compared anchor by anchor. The starts that share one anchor position
form a segment, `LENGTH` - 1 bytes longer than their number.

1. Per anchor, the distinct segments (by a 128-bit digest) and how often each occurs are counted.
   An anchor that occurs once holds nothing repeated; one whose segments are all equal holds
   nothing else. Neither needs a transform. That also folds groups of copies before any text moves.
2. For anchors with several distinct segments, one example of each segment is fetched.
3. Tasks take anchors together up to `BATCH` bytes, build the transform of their segments and run
   the search. A segment that occurs twice is repeated as a whole.
4. The repeated starts are joined back to all occurrences of the segments.

An anchor with more than `GROUP` distinct segments is refined in step 2: its segments are cut by
the starts' distance to the anchor, and each piece gets the hash of the text that all its windows
share as its anchor. Pieces with other text around a common passage so come apart, and pieces
within it are alike; a task keeps equal pieces once.

Passages shorter than `LENGTH` lose nothing, but are told: `shares_passage` is true where a run of
more than 50 words also stands in another row (passages.py). Bytes may be removed without that, where
a text repeats itself or words are long.

Texts move only where they must: for step 2 those that hold an example, for step 4 those that lose
bytes. Their keys are broadcast up to `BROADCAST_ROWS` of them, beyond that texts are joined by a
shuffle.

Anchors, spans and kept bytes are worked out for slices of many rows at once.

Other columns are ignored. Edge cases: null counts as empty; texts shorter than `LENGTH` lose nothing; equal rows repeat each
other; rows with equal or null doc_id are rows of their own; an empty table gives an empty result.
Strings are bytes: a removed span may begin or end inside a character, so kept text is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .passages import WORDS, sharing
from .scratch import drop, written

LENGTH, GRAM = 400, 32
BATCH, GROUP, PIECES, BANDS = 1 << 18, 3_000, 4, 8
SLICE, STRIDE = 128 << 10, 8
BROADCAST_ROWS = 250_000
_SPAN = LENGTH - GRAM + 1


# --- anchors and segments ------------------------------------------------------------------


def gram_hashes(data: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hash of data[i : i + k] for every i."""
    up, down = K._power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(K._BYTE[data] * up[: len(data)], out=total[1:])
    return K.mix64((total[k:] - total[:-k]) * down[: len(data) - k + 1])


def window_anchors(hashes: np.ndarray, span: int = _SPAN) -> np.ndarray:
    """For each window of `span` successive hashes, the position of its leftmost smallest one."""
    n = len(hashes)
    if n < span:
        return np.empty(0, np.int64)
    m, size = n - span + 1, -(-n // span) * span
    padded = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = hashes
    grid, place, new = padded.reshape(-1, span), np.arange(size, dtype=np.int32), np.ones((size // span, span), bool)
    # from a block's begin on: a position holds the minimum from where it is smaller than all before it
    ahead = np.minimum.accumulate(grid, axis=1)
    np.less(grid[:, 1:], ahead[:, :-1], out=new[:, 1:])
    ahead_at = np.maximum.accumulate(np.where(new.ravel(), place, np.int32(0)))
    # from a block's end on: of equal ones the left one
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1]
    new[:, -1] = True
    np.less_equal(grid[:, :-1], behind[:, 1:], out=new[:, :-1])
    behind_at = np.minimum.accumulate(np.where(new.ravel(), place, np.int32(size))[::-1])[::-1]
    return np.where(behind.ravel()[:m] <= ahead.ravel()[span - 1 : n], behind_at[:m], ahead_at[span - 1 : n]).astype(np.int64)


def segments(data: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, first start, number of starts, distance from the first start to the anchor)."""
    step = 1 << 20
    for base in range(0, max(0, len(data) - LENGTH + 1), step):
        # windows that start in [base, base + step); a run that goes on is cut there, see runs()
        yield from runs(data, base, min(len(data) - LENGTH + 1, base + step))


def runs(data: np.ndarray, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
    """Segments of the windows that start in [a, b), whole ones even where they begin before a or end after b."""
    lo, hi = max(0, a - LENGTH), min(len(data), b + 2 * LENGTH)
    hashes = gram_hashes(data[lo:hi])
    anchors = window_anchors(hashes)
    cut = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    ends = np.append(cut[1:], len(anchors))
    for s, e in zip(cut.tolist(), ends.tolist(), strict=True):
        # a segment belongs to the stretch in which its first start lies
        if a <= s + lo < b and (s or not lo):
            p = int(anchors[s])
            yield int(hashes[p]), s + lo, e - s, p - s


def row_segments(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """The segments of all rows of a slice: their rows, first starts in the row, numbers of starts, anchor hashes, distances to the anchor."""
    count = np.maximum(np.diff(offs) - LENGTH + 1, 0)
    ends = np.cumsum(count)
    if not len(ends) or not ends[-1]:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64), np.empty(0, np.int64))
    hashes = gram_hashes(data)
    at = np.arange(ends[-1]) + np.repeat(offs[:-1] - (ends - count), count)
    place = window_anchors(hashes)[at]
    # the windows of two rows have no anchor in common
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    begin, place = at[first], place[first]
    rows = np.searchsorted(offs, begin, "right") - 1
    return rows, begin - offs[rows], np.diff(first, append=len(at)), hashes[place], place - begin


def digest(data: np.ndarray | memoryview) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _occurrences(batches):
    """Each row's segments: (row, start, starts, anchor, digest, before)."""
    for batch in K.portions(batches):
        found, digests = [], []
        for i, j, data, offs in K.text_slices(batch.column(1), SLICE):
            if j - i == 1:  # it may be a long one
                own = list(segments(data))
                anchors, start, starts, before = (np.array([x[k] for x in own], np.int64 if k else np.uint64) for k in range(4))
                rows = np.zeros(len(own), np.int64)
            else:
                rows, start, starts, anchors, before = row_segments(data, offs)
            begin, raw = offs[rows] + start, memoryview(data)
            digests += [digest(raw[a:b]) for a, b in zip(begin.tolist(), (begin + starts + LENGTH - 1).tolist(), strict=True)]
            found.append((rows + i, start, starts.astype(np.int32), anchors.view(np.int64), before.astype(np.int32)))
        if found:
            rows, start, starts, anchors, before = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(start), pa.array(starts), pa.array(anchors), pa.array(digests, pa.binary()), pa.array(before)], names=["row", "start", "starts", "anchor", "digest", "before"])


# --- the transform and the search --------------------------------------------------------------


def suffixes(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least. Symbols fit 9 bits.

    Prefix doubling over what is still tied; the order of suffixes that share more than that is open.
    """
    n, width = len(text), 7
    padded = np.concatenate([text, np.zeros(width, text.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(width):
        key = (key << np.uint64(9)) | padded[i : i + n]
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    place = np.arange(n, dtype=np.int32)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    # the rank of a class is the place of its first suffix
    rank = np.empty(n + 1, np.int32)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    tied = ~(new & np.append(new[1:], True))
    at = np.flatnonzero(tied).astype(np.int32)
    while width < depth and len(at):
        who = order[at]
        own, follow = rank[who], rank[np.minimum(who + width, n)]
        key = (own.astype(np.int64) << 32) | (follow + 1).astype(np.int64)
        by = np.argsort(key)
        who, key = who[by], key[by]
        order[at] = who
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        at = at[~(new & np.append(new[1:], True))]
        width *= 2
    return order


def long_prefixes(text: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Whether neighbours order[i - 1] and order[i] share `length` symbols, for i in 1 .. n - 1 (False at 0).

    Breadth-first backward extension, by `stride` symbols at a time, which divides the length. At
    level L the intervals of strings of L symbols that were new are extended by the symbols before
    them. The suffixes at the end of an interval so found and after it share fewer symbols than its
    string has. If that was not known, the interval is extended in turn.
    """
    n = len(text)
    stride = next(k for k in range(min(STRIDE, length), 0, -1) if length % k == 0)
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    # of a suffix: the place of the one that begins `stride` symbols before; its class: which have the same first `stride` symbols
    step = rank[(order - stride) % n]
    padded = np.concatenate([text, np.zeros(stride, text.dtype)])
    new = np.ones(n, bool)
    new[1:] = False
    for i in range(stride):
        symbol = padded[order + i]
        new[1:] |= symbol[1:] != symbol[:-1]
    kind = np.cumsum(new, dtype=np.int32)
    fixed = np.zeros(n + 1, bool)
    fixed[0] = fixed[n] = True
    lo, hi = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(length // stride):
        if not len(lo):
            break
        size = hi - lo
        ends = np.cumsum(size)
        total = int(ends[-1])
        member = np.repeat(np.arange(len(lo), dtype=np.int64), size)
        at = np.arange(total, dtype=np.int32) + np.repeat(lo - (ends - size), size).astype(np.int32)
        image = np.sort(step[at].astype(np.int64) << 32 | member)
        to, member = image >> 32, image & 0xFFFFFFFF
        symbol = kind[to]
        first = np.flatnonzero(np.concatenate([[True], (member[1:] != member[:-1]) | (symbol[1:] != symbol[:-1])]))
        a, b = to[first], to[np.append(first[1:], total) - 1] + 1
        keep = ~fixed[b]
        fixed[b] = True
        lo, hi = a[keep].astype(np.int32), b[keep].astype(np.int32)
    return ~fixed[:n]


def repeated_starts(pieces: list[np.ndarray], twice: list[bool], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its starts have a string that also starts at another place of any segment."""
    sizes = np.array([len(p) for p in pieces])
    text = np.empty(int(sizes.sum()) + len(pieces) + 1, np.uint16)
    # symbol 0 ends the text, 1 ends a segment, bytes follow
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    for p, b in zip(pieces, begins.tolist(), strict=False):
        text[b : b + len(p)] = p
        text[b : b + len(p)] += 2
        text[b + len(p)] = 1
    text[-1] = 0
    order = suffixes(text, length)
    share = long_prefixes(text, order, length)
    both = share.copy()
    both[:-1] |= share[1:]
    found = np.zeros(len(text), bool)
    found[order[both]] = True
    return [np.ones(len(p) - length + 1, bool) if t else found[b : b + len(p) - length + 1] for p, t, b in zip(pieces, twice, begins.tolist(), strict=False)]


def live_starts(contents: list[tuple[int, np.ndarray, int]]) -> list[tuple[int, int] | None]:
    """For each (group, content, distance from its first start to the anchor), the range that holds all starts which another content of the group may share.

    The starts within a band of distances to the anchor all have one string in common; where no other
    content has that string, none of them is shared. Nothing is left out but such bands at either end.
    """
    width = -(-_SPAN // BANDS)
    seen: dict[tuple[int, int, int], int] = {}
    bands = []
    for group, content, before in contents:
        raw, own = content.tobytes(), []
        last = len(raw) - LENGTH
        for i in range((before - last) // width, before // width + 1):
            near, far = i * width, (i + 1) * width - 1
            name = group, i, hash(raw[before - near : before - far + LENGTH])
            seen[name] = seen.get(name, 0) + 1
            own.append((max(0, before - far), min(last, before - near) + 1, name))
        bands.append(own)
    out: list[tuple[int, int] | None] = []
    for own in bands:
        live = [(a, b) for a, b, name in own if seen[name] > 1]
        out.append((min(live)[0], max(live)[1]) if live else None)
    return out


def _solve(batches):
    """Repeated starts of each segment, as [from, to) pairs. Rows come sorted by (group, content's digest); a group lies in one partition.

    Equal contents of a group are held once, with the segments they are part of.
    """
    held: list[tuple[np.ndarray, bool, list[tuple[int, bytes, int]], int, int]] = []
    size, last = 0, None

    def close():
        # a content that occurs twice is repeated as a whole
        near = live_starts([(h[3], h[0], h[4]) for h in held])
        some = [i for i, x in enumerate(near) if x]
        marks = dict(zip(some, repeated_starts([held[i][0][near[i][0] : near[i][1] + LENGTH - 1] for i in some], [False] * len(some)), strict=True)) if some else {}
        rows = []
        for i, (content, many, parts, _, _) in enumerate(held):
            if many or len(parts) > 1:
                edge, begin = np.array([0, len(content) - LENGTH + 1]), 0
            elif i in marks:
                edge, begin = np.flatnonzero(np.diff(np.concatenate([[0], marks[i].astype(np.int8), [0]]))), near[i][0]
            else:
                continue
            if len(edge):
                rows += [(anchor, key, (edge + begin + shift).tolist()) for anchor, key, shift in parts]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))], names=["anchor", "digest", "edges"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("group", "name", "anchor", "digest", "shift", "many", "before")]
        for group, name, anchor, key, shift, many, before, content in zip(*cols, batch.column("content"), strict=True):
            if last == (group, name):
                held[-1][2].append((anchor, key, shift))
                if many and not held[-1][1]:
                    held[-1] = (held[-1][0], True, *held[-1][2:])
                continue
            if size > BATCH and (last is None or group != last[0]):
                yield close()
                held, size = [], 0
            held.append((np.frombuffer(content.as_buffer(), np.uint8), many, [(anchor, key, shift)], group, before))
            size, last = size + len(held[-1][0]), (group, name)
    if held:
        yield close()


# --- the operator ------------------------------------------------------------------------------


def pieces(content: np.ndarray, starts: int, before: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(group, first start, content) of the parts of a segment whose anchor lies `before` bytes after its first start."""
    width = -(-_SPAN // PIECES)
    for i in range(PIECES):
        # distances of a start to the anchor from near to far; all windows of these hold `common`
        near, far = i * width, (i + 1) * width - 1
        a, b = max(0, before - far), min(starts - 1, before - near)
        if a <= b:
            common = content[before - near : before - far + LENGTH]
            yield int.from_bytes(hashlib.blake2b(common, digest_size=8, salt=bytes([i])).digest(), "little", signed=True), a, content[a : b + LENGTH]


_PARTS = pa.schema([("group", pa.int64()), ("name", pa.binary()), ("anchor", pa.int64()), ("digest", pa.binary()), ("shift", pa.int32()), ("many", pa.bool_()), ("before", pa.int32()), ("content", pa.binary())])


def _fetch(batches):
    """Content of the wanted segments of each row, those of large anchors in pieces."""
    for batch in K.portions(batches):
        data, offs = K.flat(batch.column(0))
        out: list[tuple] = []
        for r, wanted in enumerate(batch.column(1).to_pylist()):
            own = data[offs[r] : offs[r + 1]]
            for w in wanted:
                content = own[w["start"] : w["start"] + w["starts"] + LENGTH - 1]
                if w["large"]:
                    out += [(group, digest(part), w["anchor"], w["digest"], a, w["many"], w["before"] - a, part.tobytes()) for group, a, part in pieces(content, w["starts"], w["before"])]
                else:
                    out.append((w["anchor"], w["digest"], w["anchor"], w["digest"], 0, w["many"], w["before"], content.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(_PARTS)], schema=_PARTS)


def _cut(batches):
    """What stays of each row that loses bytes."""
    for batch in K.portions(batches):
        for i, j, data, offs in K.text_slices(batch.column(1)):
            own = batch.slice(i, j - i)
            marks = own.column(2)
            mark, number = marks.flatten(), marks.value_lengths().fill_null(0).to_numpy()
            edges, begin = mark.field("edges"), np.repeat(offs[:-1], number) + mark.field("start").to_numpy()
            at = edges.flatten().to_numpy() + np.repeat(begin, edges.value_lengths().to_numpy())
            gone = np.zeros(len(data), bool)
            if len(at):
                size = len(data) + 1
                gone = np.cumsum(np.bincount(at[::2], minlength=size) - np.bincount(at[1::2] - 1 + LENGTH, minlength=size))[:-1] > 0
            # runs end with their row
            turn = np.zeros(len(data) + 1, bool)
            turn[:-1] = turn[1:] = gone
            turn[1:-1] = gone[1:] != gone[:-1]
            edge = offs[1:-1][(offs[1:-1] > 0) & (offs[1:-1] < len(data))]
            both = np.unique(edge[gone[edge] & gone[edge - 1]])
            turn = np.sort(np.concatenate([np.flatnonzero(turn), both, both])).astype(np.int64)
            rows = np.searchsorted(offs, turn[::2], "right") - 1
            lost = np.bincount(rows, weights=turn[1::2] - turn[::2], minlength=j - i).astype(np.int64)
            pairs = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * 2), pa.array(turn - np.repeat(offs[rows], 2)))
            spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=j - i))]).astype(np.int32)), pairs)
            cuts = (offs - np.concatenate([[0], np.cumsum(lost)])).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
            # a copy shares a passage if it is long enough to hold one
            shares = pa.array((K.word_counts(data, offs, K.SPACED) >= WORDS) & own.column(3).fill_null(False).to_numpy(zero_copy_only=False), pa.bool_())
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(np.diff(offs)), pa.array(lost), spans, kept, shares], names=["doc_id", "n_bytes", "n_removed", "spans", "kept", "shares_passage"])


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, spans ([first byte, byte after]), kept (binary) and shares_passage."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal texts have equal spans, so a text's digest stands for its rows
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    marked = docs.withColumn("row", F.unhex(F.md5("text")))
    found = written(marked.select("row", "text").mapInArrow(_occurrences, "row binary, start long, starts int, anchor long, digest binary, before int"), "anchors")
    # tables of one row for each anchor are written first: a join with them can then be split where an anchor is very common
    shared = written(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "common")
    again = written(found.join(shared, "anchor"), "shared")
    drop(found)
    each = written(again.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.min(F.struct("row", "start")).alias("at"), F.first("starts").alias("starts"), F.first("before").alias("before")), "segments")
    kinds = written(each.groupBy("anchor").agg(F.count("*").alias("kinds")), "kinds")
    known = each.join(kinds, "anchor")
    same = known.where("kinds = 1").select("anchor", "digest", F.array(F.lit(0), F.col("starts")).alias("edges"))
    wanted = known.where("kinds > 1").select(F.col("at.row").alias("row"), F.struct("anchor", "digest", (F.col("n") > 1).alias("many"), F.col("at.start").alias("start"), "starts", "before", (F.col("kinds") > GROUP).alias("large")).alias("w"))
    wanted = written(wanted.groupBy("row").agg(F.collect_list("w").alias("wanted")), "wanted")
    texts = _having(marked.select("row", "text"), wanted.select("row")).join(wanted, "row").dropDuplicates(["row"])
    parts = texts.select("text", "wanted").mapInArrow(_fetch, "group long, name binary, anchor long, digest binary, shift int, many boolean, before int, content binary")
    solved = parts.repartition(partitions, "group").sortWithinPartitions("group", "name").mapInArrow(_solve, "anchor long, digest binary, edges array<int>")
    marks = written(solved.unionByName(same), "repeats")
    drop(each)
    drop(wanted)
    hits = again.select("row", "start", "anchor", "digest").join(marks, ["anchor", "digest"])
    hits = hits.select("row", F.struct("start", "edges").alias("mark"), F.lit(False).alias("shares")).unionByName(_sharing(marked))
    hits = written(hits.groupBy("row").agg(F.collect_set("mark").alias("marks"), F.max("shares").alias("shares")), "marks")
    drop(again)
    drop(marks)
    columns = ["doc_id", "text", "marks", "shares"]
    if hits.count() <= BROADCAST_ROWS:
        keys = F.broadcast(hits.select("row"))
        touched = marked.join(keys, "row", "left_semi").join(hits, "row").select(*columns)
        out = touched.unionByName(marked.join(keys, "row", "left_anti").withColumns({"marks": F.lit(None).cast(hits.schema["marks"].dataType), "shares": F.lit(False)}).select(*columns))
    else:
        out = marked.join(hits, "row", "left").select(*columns)
    return out.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary, shares_passage boolean")


def _sharing(marked: DataFrame) -> DataFrame:
    """Rows of texts that stand in two rows, or have a passage of another text: without a mark."""
    key = F.xxhash64("row").alias("key")
    told = sharing(marked.select(key, "text"), words=WORDS).withColumn("other", F.lit(True))
    names = marked.groupBy("row").agg(F.count("*").alias("n")).select("row", "n", key)
    return names.join(told, "key", "left").where("n > 1 or other").select("row", F.lit(None).cast("struct<start:bigint,edges:array<int>>").alias("mark"), F.lit(True).alias("shares"))


def _having(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts with a key among keys, as far as a broadcast can tell; beyond its bound all of them."""
    return texts.join(F.broadcast(keys), "row", "left_semi") if keys.count() <= BROADCAST_ROWS else texts


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses and keeps."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")
