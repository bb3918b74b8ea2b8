"""Kernels of op3 on many rows at once, against one row at a time; how often they go over their input."""

import hashlib
import random

import numpy as np
import pyarrow as pa

from mosslight.llm import substring_dedup as S


def texts():
    draw = random.Random(11)
    base = "".join(draw.choices("abcdefgh ", k=2500))
    return ["", None, base, "x" * 900, base[:399], base[:400], "é" * 300, base[100:1400] + "QQ" + base[1500:], base * 2, "", "ab" * 700, "".join(draw.choices("ab", k=150_000)), base[:401], None]


def test_segments_of_many_rows(monkeypatch):
    """Before, the strings of each row were hashed by a call of their own."""
    rows = texts()
    want = []
    for i, t in enumerate(rows):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        want += [(bytes([i]), start, n, anchor - (anchor >> 63 << 64), hashlib.blake2b(raw[start : start + n + 399], digest_size=16).digest(), before) for anchor, start, n, before in S.segments(raw)]
    calls, hashes = [], S.gram_hashes
    monkeypatch.setattr(S, "gram_hashes", lambda data, *a: calls.append(len(data)) or hashes(data, *a))
    batch = pa.RecordBatch.from_arrays([pa.array([bytes([i]) for i in range(len(rows))]), pa.array(rows, pa.string())], names=["row", "text"])
    got = [tuple(r.values()) for b in S._occurrences([batch.slice(0, 1), batch.slice(1)]) for r in b.to_pylist()]
    assert sorted(got) == sorted(want) and len(want) > 300
    assert len(calls) <= 4


def test_search_goes_back_by_several_symbols(monkeypatch):
    """Before, every one of the 400 levels was a round of its own."""
    draw = np.random.default_rng(4)
    own = [draw.integers(97, 123, 700).astype(np.uint8) for _ in range(3)]
    own[1][40:560], own[2][200:599] = own[0][100:620], own[0][60:459]
    rounds, repeat = [], np.repeat
    monkeypatch.setattr(np, "repeat", lambda *a: rounds.append(1) or repeat(*a))
    got = S.repeated_starts(own, [False] * 3)
    assert [np.flatnonzero(x).tolist() for x in got] == [list(range(100, 221)), list(range(40, 161)), []]
    assert len(rounds) <= 200


def test_cut_of_many_rows():
    """Runs end with their row, also where the next row's begins at once; overlaps count once."""
    draw = random.Random(2)
    rows = [None if t is None else t[:3000] for t in texts()]
    marks = []
    for t in rows:
        n = len((t or "").encode()) - 399
        own = [] if n < 1 else [{"start": (a := draw.randrange(n)), "edges": sorted(draw.sample(range(n - a + 1), 2)) if n - a > 1 else [0, 1]} for _ in range(draw.randrange(4))]
        marks.append(own or None)
    marks[2] = marks[3] = [{"start": 0, "edges": [0, 100, 101, 501]}]
    rows[2], rows[3] = rows[2][:900], rows[3][:900]
    for a, b in ((0, len(rows)), (1, 5), (2, 3), (9, 10)):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("edges", pa.list_(pa.int32()))]))
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.string()), pa.array(marks, kind), pa.array([None] * len(rows), pa.bool_())], names=["doc_id", "text", "marks", "shares"])
        got = [r for x in S._cut([batch.slice(a, b - a)]) for r in x.to_pylist()]
        assert [r["doc_id"] for r in got] == list(range(a, b))
        for r in got:
            raw = (rows[r["doc_id"]] or "").encode()
            gone = {k for m in marks[r["doc_id"]] or () for x, y in zip(m["edges"][::2], m["edges"][1::2]) for k in range(m["start"] + x, m["start"] + y + 399)}
            begins = [k for k in sorted(gone) if k - 1 not in gone]
            assert r["spans"] == [[k, next(e for e in range(k, len(raw) + 1) if e not in gone)] for k in begins]
            assert (r["n_bytes"], r["n_removed"], r["kept"]) == (len(raw), len(gone), bytes(x for k, x in enumerate(raw) if k not in gone))
