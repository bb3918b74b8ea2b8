"""Manifest, embedding near-dedup and filter audit against brute force, on small tables with every odd case."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosslight.llm import embedding_dedup as E
from mosslight.llm import filter_audit as A
from mosslight.llm import manifest as M
from mosslight.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, name string, tree long, part int, place long, mask int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 1, 2, 3, 4) for r in rows], DOCS)


@pytest.mark.parametrize("name", ["op11_manifest", "op12_embedding_dedup", "op13_filter_audit"])
def test_sql(spark, same, name):
    got, want = same(spark, QUERIES[name], ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]


# --- 11 -----------------------------------------------------------------------------------------


def tree(digests):
    """All levels of a tree."""
    out = [digests]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def brute_manifest(rows, tampered):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, low=False: sha("".join(map(field, (r[0], r[3], r[2], r[4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if low and r[1] is not None else r[1]))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), leaf(r, tampered(r[0])), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top, out = tree([trees[g][-1][0] for g in names]), []
    root = top[-1][0]
    for k, g in enumerate(names):
        for i, (_, _, own, now, doc_id) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = ""
            for levels, at in ((trees[g], i), (top, k)):
                for level in levels[:-1]:
                    first = at // 8 * 8
                    run = level[first : first + 8]
                    path += "".join(run[: at - first] + run[at - first + 1 :])
                    now = sha("".join([*run[: at - first], now, *run[at - first + 1 :]]))
                    at //= 8
            out.append((doc_id, own, trees[g][-1][0], root, sha(path), now, now == root))
    return out


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 1, None: 1}, {"en": 8, "de": 9}, {"": 65, None: 7, "fr": 1, "é": 64}, {"en": 700, "de": 513, **{f"l{k}": 2 for k in range(70)}}])
def test_manifest(spark, sizes, monkeypatch):
    draw = random.Random(len(sizes))
    rows, n = [], 0
    for lang, size in sizes.items():
        for _ in range(size):
            text = draw.choice([None, "", "Words é Äß", "lower", "X" * draw.randrange(2000)])
            rows.append((draw.choice([n, n, n, n, None, 3]), text, lang, draw.choice([None, "s", "|"]), draw.choice([None, len(text or "")])))
            n += 1
    rows += rows[:3]
    draw.shuffle(rows)
    tampered = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0
    monkeypatch.setattr(M, "PARTIALS", 5)
    got = M.manifest(docs_of(spark, rows).repartition(5), altered=lambda c: F.translate(c, M.UPPER, M.LOWER), where=F.crc32(F.col("doc_id").cast("string")) % 3 == 0).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute_manifest(rows, tampered), key=key)


def test_manifest_of_nothing_and_without_changes(spark):
    assert M.manifest(docs_of(spark, [])).count() == 0
    rows = [(i, "T", "en", "s", 1) for i in range(20)]
    assert {r.verified for r in M.manifest(docs_of(spark, rows)).collect()} == {True}
    assert not any(r.verified for r in M.manifest(docs_of(spark, rows), altered=F.lower).collect())


def test_partial_parents_in_any_order():
    n, leaves = 1000, [sha(str(i)) for i in range(1000)]
    want = tree(leaves)[-1][0]
    order = list(range(n))
    random.Random(1).shuffle(order)
    own = M.Combiner()
    for i in order:
        own.add(0, 0, i, n, leaves[i])
    assert [r[4] for r in own.out if r[5] is None] == [want]
    assert M.fold(leaves[0], 0, 1, "") == (leaves[0], 0)


# --- 12 -----------------------------------------------------------------------------------------


def brute_links(rows, threshold):
    valid = []
    for _, v in rows:
        x = None if v is None or None in v else np.array(v, np.float64)
        valid.append(None if x is None or not len(x) or not np.isfinite(x).all() or not x.any() else x / np.abs(x).max())
    n, links, root = len(rows), [0] * len(rows), list(range(len(rows)))
    ids = [r[0] for r in rows]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(n), 2):
        if ids[i] is None or ids[j] is None:
            continue
        a, b = valid[i], valid[j]
        close = a is not None and b is not None and len(a) == len(b) and (a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())) >= threshold
        links[i] += close
        links[j] += close
        if close or (ids[i] == ids[j] and a is not None and b is not None):
            root[find(i)] = find(j)
    out = []
    for i in range(n):
        least = None if ids[i] is None else min(ids[j] for j in range(n) if ids[j] is not None and find(j) == find(i))
        out.append((ids[i], links[i], least, ids[i] is None or ids[i] == least))
    return out


def vectors(draw):
    centres = draw.normal(size=(12, 24))
    rows = [c + draw.normal(size=24) * s for c in centres for s in (0.05, 0.1, 0.15, 0.2, 0.3) for _ in range(6)]
    rows += [rows[0]] * 40 + [2.5 * rows[1], -rows[2]] + [draw.normal(size=24) for _ in range(60)]
    # a chain, each link just above the threshold
    angle = np.arccos(0.951)
    rows += [np.concatenate([[np.cos(k * angle), np.sin(k * angle)], np.zeros(22)]) for k in range(15)]
    rows += [np.eye(24)[0] * 1e-200, np.eye(24)[0] * 1e200, draw.normal(size=7), np.ones(7), np.ones(7) * 3]
    return [x.tolist() for x in rows]


@pytest.mark.parametrize("block, sample, lead", [(16_384, 2_048, 16), (40, 2_048, 4), (16, 5, 2), (30, 64, 64)])
def test_embedding_duplicates(spark, monkeypatch, block, sample, lead):
    for name, value in (("BLOCK", block), ("SAMPLE", sample), ("LEAD", lead), ("TILE", 16)):
        monkeypatch.setattr(E, name, value)
    draw = np.random.Generator(np.random.PCG64(5))
    own = vectors(draw)
    rows = [(3 * i + 1, v) for i, v in enumerate(own)]
    rows += [(-5, None), (-6, []), (-7, [0.0] * 24), (-8, [float("nan")] * 24), (-9, [1.0, None]), (-10, [float("inf")] * 24), (None, own[0]), (1, own[-6]), (4, own[0]), (-5, own[3]), (1, own[0])]
    table = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], "vec_id long, embedding array<double>, digest string, tile int, v string")
    got = E.embedding_duplicates(table).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(brute_links(rows, 0.95), key=key)
    assert E.embedding_duplicates(table.limit(0)).count() == 0


def test_a_cosine_at_the_threshold_links(spark):
    # 0.6 * 0.6 + 0.8 * 0.8 and 3-4-5 triangles: exactly 0.96 and 24 / 25
    rows = [(1, [3.0, 4.0]), (2, [4.0, 3.0]), (3, [-4.0, 3.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for threshold, links in ((0.96, 1), (0.9600001, 0)):
        assert {r.vec_id: r.n_links for r in E.embedding_duplicates(table, threshold=threshold).collect()} == {1: links, 2: links, 3: 0}


def test_pairs_are_dropped_early():
    draw = np.random.Generator(np.random.PCG64(2))
    x = E.unit(draw.normal(size=(400, 32)) * np.geomspace(1, 0.01, 32))
    rows = E.Rows(x, E.Axes(x, 400, 100))
    at = np.arange(400)
    i, j = E.similar(rows, at, rows, at, 0.95)
    want = np.nonzero(x @ x.T >= 0.95)
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(*(w.tolist() for w in want)))
    assert set(E.Axes(x, 400, 100).tile(rows.turned).tolist()) == {0, 1, 2, 3}


# --- 13 -----------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    first, known = {}, {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, q, t in labels:
        if d is not None:
            a, b = known.get(d, (False, False))
            known[d] = (a or q == 1, b or t == 1)
    docs = []
    for d, t, lang, *_ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "".join(
            f
            for f, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), d is not None and first[t] < d))
            if bad
        )
        docs.append((lang or "", fails, *known.get(d, (False, False))))
    out = []
    for part in {d[0] for d in docs}:
        own, shapley = [d[1:] for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        found = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                kept = [d for d in left if f not in d[0]]
                redundant = sum(f in d[0] for d in own) - len(gone)
                found.append([part, "".join(order), k + 1, len(kept), len(gone), redundant, sum(d[0] == f for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)])
                shapley[f] += len(gone)
                left = kept
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return out


def test_filter_audit(spark):
    draw = random.Random(4)
    word = lambda: draw.choice(["a", "bb", "Ccc", "é", "日本", "X", "word" + str(draw.randrange(400))])
    texts = [" ".join(word() for _ in range(draw.choice([0, 1, 150, 199, 200, 201, 300]))) + draw.choice(["", "", " #", "|x", " "]) for _ in range(60)]
    texts += [None, "", " \n\t", "A" * 3 + "b" * 97, "A" * 4 + "b" * 96, " ".join(f"w{i}" for i in range(100)) + " " + " ".join(["w1"] * 100), " ".join(f"v{i}" for i in range(30_000))]
    rows = [(draw.choice([i, i, i, None, 7]), t, draw.choice(["en", "de", None, ""]), "s", 1) for i, t in enumerate(texts + texts[:30] + ["same"] * 40)]
    rows += rows[:5]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 120, 2)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1), (9999, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = A.audit(docs_of(spark, rows).repartition(4), table).collect()
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r[c] for c in names) for r in got) == sorted(brute_audit(rows, labels))
    assert A.audit(docs_of(spark, []), table).count() == 0


def test_words_that_share_a_hash():
    import pyarrow as pa

    from mosslight.llm import kernels as K

    texts = ["aa bb aa cc", "", "aa bb bb", "one"]
    data, offs = K.flat(pa.array(texts))
    starts, ends, rows = K.word_spans(data, offs, K.SPACED)
    assert A.distinct_words(data, offs, starts, ends, rows).tolist() == [3, 0, 2, 1]
    assert A.distinct_words(data, offs, starts, ends, rows, np.zeros(len(starts), np.uint64)).tolist() == [3, 0, 2, 1]
