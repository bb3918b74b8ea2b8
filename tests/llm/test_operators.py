"""Training-data operators against brute force on small tables with every odd case."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosslight.llm import components, decontaminate, language_id, license_scan, line_dedup, mixing, near_dedup, nearest, scratch, substring_dedup, token_counts, token_store
from mosslight.llm import kernels as K
from mosslight.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, mark long, digest string, nth int, items string"


def table(spark, texts, ids=None, langs=None, sources=None):
    """Documents with extra columns whose names operators use themselves."""
    rows = []
    for i, t in enumerate(texts):
        rows.append((ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", len(t or ""), "x", 1, "y", 2, "z"))
    return spark.createDataFrame(rows, DOCS)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(draw, n, vocab=40):
    return [f"w{draw.randrange(vocab)}é" if draw.random() < 0.2 else f"w{draw.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd():
    """Texts with nulls, empties, repeats, near copies, shared passages, and a long one."""
    draw = random.Random(11)
    base = [" ".join(words(draw, draw.randrange(1, 120), 400)) for _ in range(25)]
    passage = " ".join(words(draw, 70, 400))
    out = [*base, None, "", "   \n ", "!!!", base[3], base[3], base[4].upper()]
    for b in base[:12]:
        w = b.split()
        if len(w) > 60:
            w[5] = "changed"
            out.append(" ".join(w))
    out += [" ".join(words(draw, 30)) + "\n" + passage + "\n" + " ".join(words(draw, 20)) for _ in range(5)]
    out.append(" ".join(words(draw, 30_000, 5_000)))
    return out


# --- kernels ------------------------------------------------------------------------------------


def test_word_spans(odd):
    import pyarrow as pa

    for table_, pattern in ((K.SPACED, r"[^\x20\x09-\x0D]+"), (K.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        texts, got = pa.array(odd, pa.string()), {}
        for i, _, data, offs in K.text_slices(texts, 500):
            data = K.LOWER[data]
            for s, e, r in zip(*K.word_spans(data, offs, table_)):
                got.setdefault(i + int(r), []).append(data[s:e].tobytes().decode())
        assert got == {i: w for i, t in enumerate(odd) if (w := re.findall(pattern, lower(t)))}


def test_hashes_do_not_depend_on_slices(odd):
    import pyarrow as pa

    data, offs = K.flat(pa.array(odd, pa.string()))
    s, e, _ = K.word_spans(data, offs, K.SPACED)
    assert (K.span_hashes(data, s, e) == K.span_hashes(data, s, e, limit=64)).all()


# --- 1 ------------------------------------------------------------------------------------------


def brute_hits(texts, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = cut(t)
        n = min(10, len(w))
        if i is not None:
            for k in range(len(w) - n + 1 if n else 0):
                windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for t in texts:
        w, hit, who = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    who |= windows[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(who)))
    return out


@pytest.mark.parametrize("bits, rows", [(1 << 28, 1_000_000), (1 << 16, 0)])
def test_decontaminate(spark, odd, monkeypatch, bits, rows):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    long = odd[-1].split()
    items = [(1, odd[0]), (2, " ".join(odd[1].split()[3:14])), (3, "w1 w2"), (3, "w1 w2"), (4, None), (5, ""), (None, odd[2]), (10, " ".join(long[20_000:20_011])), (11, odd[3]), (12, odd[3].upper() + "!!"), (13, " ".join(long[5_000:15_000]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(spark, table(spark, odd), bench, keep=["doc_id", "items", "source"]).orderBy("doc_id").collect()
    want = brute_hits(odd, items)
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == want
    assert all(sum(b - a for a, b in r.hit_spans) == r.n_hit for r in got) and got[0].source == "s0"
    empty = decontaminate.decontaminate(spark, table(spark, odd), bench.limit(0), keep=["doc_id"])
    assert empty.where("n_hit > 0").count() == 0 and decontaminate.decontaminate(spark, table(spark, odd).limit(0), bench).count() == 0


# --- 2, 8 and the SQL ones ------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, same, name):
    got, want = same(spark, QUERIES[name], ORACLES[name])
    assert got == want


def test_license(spark):
    mit = dict((t[:12], t) for _, t in license_scan.LICENSES)["MIT License "]
    texts = ["Copyright (c) 2020 A. Person\n" + mit.upper().replace(",", " ;"), "text\n// Licenced under the Apache Licence, version 2.0\nmore", None, "", "licensed under the apache license version 2 0 and more", "Copyright 2021 B"]
    got = {r.doc_id: r for r in license_scan.scan(table(spark, texts)).collect()}
    assert got[0].license == "MIT" and got[1].license is None
    # a line is a text of its own; more words around a notice make another text
    assert [got[i].notices for i in range(1, 6)] == ["Apache-2.0", "", "", "", ""]
    spelled = license_scan.scan(table(spark, ["Licensed under the Apache Licence, Version 2.0!!"])).first()
    assert spelled.license == spelled.notices == "Apache-2.0"
    assert license_scan.scan(table(spark, texts).limit(0)).count() == 0
    many = [("X", f"text number {i}") for i in range(license_scan.KNOWN_ROWS)] + [("Y", "Sole text")]
    assert license_scan.scan(table(spark, ["sole TEXT."]), many).first().license == "Y"


def test_wrapped_licenses(spark):
    """Every known text is found however its lines are broken, a line that states a copyright before it or not."""
    import textwrap

    known = {r.digest for r in license_scan.known(spark).collect()}
    isc = dict(license_scan.LICENSES)["ISC"].replace("above copyright notice", "above\ncopyright notice")
    texts = [isc, *("\n".join(textwrap.wrap(t, w, break_long_words=False, break_on_hyphens=False)) for _, t in license_scan.LICENSES for w in (12, 40, 64, 72, 78, 80))]
    heads = ["", "Copyright 2020 A. Owner\n", "Copyright (c) Holders Ltd\n", "(c) 1999 B\n", "* Copyright by C\n"]
    docs = table(spark, [h + t for h in heads for t in texts])
    got = docs.select(F.unhex(F.sha2(license_scan.canonical(F.col("text")), 256)).alias("d"), "text").collect()
    assert [r.text for r in got if r.d not in known] == []
    assert license_scan.scan(table(spark, [isc])).first().license == "ISC"


def test_lines(spark):
    texts = ["a b\nc\n\nc", "A  B\nd", None, "", "c", "A  B\nd", "x\n" * 3 + "y"]
    ids = [1, 2, 3, 4, None, 2, 6]
    got = [(r.doc_id, r.n_units, r.n_removed, r.kept) for r in line_dedup.dedup_units(table(spark, texts, ids)).collect()]
    want = [(1, 4, 1, "a b\nc\n"), (2, 2, 1, "d"), (2, 2, 2, ""), (3, 0, 0, None), (4, 1, 0, ""), (None, 1, 1, ""), (6, 4, 2, "x\ny")]
    assert collections.Counter(got) == collections.Counter(want)
    for r in line_dedup.dedup_units(table(spark, texts, ids)).where("doc_id = 6").collect():
        assert r.spans == [[2, 3], [4, 5]]


def test_lines_odd_tables(spark):
    rows = [(5, "abc def"), (None, "5|abc def"), (6, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_units(docs).collect()
    assert all(r.n_removed == 0 and r.longest_repeated == 0 for r in got) and len(got) == 4
    assert line_dedup.dedup_units(docs.limit(0)).count() == 0
    long = "\n".join(f"line {i} " + "w " * 30 for i in range(20_000))
    got = line_dedup.dedup_units(spark.createDataFrame([(1, long), (2, "line 7 " + "w " * 30), (3, "other")], docs.schema)).orderBy("doc_id").collect()
    assert [(r.n_units, r.n_removed, r.longest_repeated) for r in got] == [(20_000, 0, 32), (1, 1, 32), (1, 0, 0)]


def test_paragraph_licenses(spark):
    """A notice of several lines inside a longer text, and known texts beyond the broadcast bound."""
    mit = next(t for n, t in license_scan.LICENSES if n == "MIT" and len(t) > 300)
    import textwrap

    text = "Some words before.\n\n" + textwrap.fill(mit, 60) + "\n \nand after"
    for bound in (10_000, 0):
        license_scan.KNOWN_ROWS, before = bound, license_scan.KNOWN_ROWS
        r = license_scan.scan(table(spark, [text, None])).orderBy("doc_id").first()
        license_scan.KNOWN_ROWS = before
        assert (r.license, r.notices, r.n_notices) == (None, "MIT", 1)
    assert license_scan.scan(table(spark, [text]).limit(0)).count() == 0


def test_decontaminate_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three", b"k", "w", "i", 5)], "doc_id long, text string, _key binary, _windows string, `a.b` string, key int")
    bench = spark.createDataFrame([(7, "two three")], "item_id long, text string")
    for rows in (1_000_000, 0):
        decontaminate.BROADCAST_ROWS, before = rows, decontaminate.BROADCAST_ROWS
        try:
            r = decontaminate.decontaminate(spark, docs.withColumn("_items", F.lit("mine")), bench).first()
        finally:
            decontaminate.BROADCAST_ROWS = before
        assert (r.doc_id, bytes(r["_key"]), r["_windows"], r["a.b"], r["key"], r["_items"], r.n_hit, r["items"]) == (1, b"k", "w", "i", 5, "mine", 2, ["7"])


# --- 3 ------------------------------------------------------------------------------------------


def brute_spans(texts, n=400):
    count, raw = collections.Counter(), [(t or "").encode() for t in texts]
    for b in raw:
        count.update(b[i : i + n] for i in range(len(b) - n + 1))
    for b in raw:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                gone[i] += 1
                gone[i + n] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        yield len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize("group", [3_000, 0])
def test_substrings(spark, odd, group, monkeypatch):
    """With anchors as they are, and with all of them refined."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", group)
    draw = random.Random(3)
    base = "".join(draw.choices("abcdef ", k=3000))
    texts = [*odd[:-1], "x" * 1500, "abcdefg" * 200, base, base[500:1500] + "Q" + base[1600:2100], "é" * 300 + base[10:420], base[:399], base[:400], base[:400], "zz" + base[100:480] + "zz", base[:1000] + base[:1000]]
    ids = [None if i == 1 else i // 2 for i in range(len(texts))]
    got = [(r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in substring_dedup.remove_repeats(table(spark, texts, ids)).collect()]
    assert collections.Counter(got) == collections.Counter(brute_spans(texts))
    assert substring_dedup.remove_repeats(table(spark, texts).limit(0)).count() == 0


def test_transform_search():
    draw = np.random.default_rng(0)
    for _ in range(30):
        text = draw.integers(2, 5, 300).astype(np.uint16)
        text[-1], n = 0, int(draw.integers(1, 9))
        order = substring_dedup.suffixes(text, 40)
        keys = [tuple(text[i : i + 40]) for i in order]
        assert keys == sorted(keys)
        want = [False] + [len(a) >= n and len(b) >= n and a[:n] == b[:n] for a, b in zip(keys, keys[1:])]
        assert substring_dedup.long_prefixes(text, order, n).tolist() == want
    for n, span in [(50, 7), (400, 369), (1000, 13), (369, 369), (368, 369)]:
        h = draw.integers(0, 20, n).astype(np.uint64)
        assert substring_dedup.window_anchors(h, span).tolist() == [i + int(np.argmin(h[i : i + span])) for i in range(n - span + 1)]


# --- 4, 6 ----------------------------------------------------------------------------------------

HARD = ["", "a<|endoftext|>b <|startoftext|>", " ́x é É y", "ΑΣ σας. İstanbul", "...a.. b., it's we'll 'Re x'S.", "<|EndOfText|> A.", "\t\r\n  x  \n\n y", "日本語テキスト，。a1b2.3,", "a,b.c d.,", "ǅ ﬁ Å. ñ, ß.", "abc''' d$$ e_f <| x|>"]


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(token_store.tokenizer_path())


def test_units(tokenizer, odd):
    import pyarrow as pa

    texts = HARD + [t or "" for t in odd]
    want = [np.array([*e.ids, 2], "<u2").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    small = token_store.UnitEncoder(token_store.tokenizer_path(), limit=50)
    both = [small.encode(pa.array(texts, pa.string()), 2) for _ in range(2)]
    assert both == [want, want]
    assert small.encode(pa.array([None, *texts], pa.string()).slice(1), 2) == want


def test_edits(tokenizer, odd):
    """Several rounds of edits on one tree; each leaves the count of the whole text, encoded anew."""
    draw, count = random.Random(1), token_counts.counter(token_store.tokenizer_path())
    for text in HARD + [t for t in odd if t is not None]:
        tree, plain = token_counts.TokenTree.build(text, count, leaf=4), text
        for _ in range(3):
            edits, last = [], 0
            for _ in range(draw.randrange(6)):
                a = min(len(plain), last + draw.randrange(20))
                last = min(len(plain), a + draw.randrange(30))
                edits.append((a, last, draw.choice(["", " ", "foo bar", "x", "é.", "a b c d e f g h i j"])))
                if a == last:
                    break
            want = plain
            for a, b, new in reversed(edits):
                want = want[:a] + new + want[b:]
            plain = tree.apply(edits)
            assert plain == want == tree.text
            assert tree.total == len(tokenizer.encode(plain, add_special_tokens=False).ids)
            assert tree.sums[1] == tree.sums[tree.width :].sum() == tree.tokens.sum()
            assert tree.chars.sum() == len(plain) + 1 and (tree.chars > 0).all()
    tree = token_counts.TokenTree.build("a b c", count)
    assert tree.apply([(0, 1, "x"), (0, 1, "y"), (9, 9, "z"), (None, 1, "n")]) == "x b c" and tree.refused == 2
    tree = token_counts.TokenTree.build("aa bb cc dd ee ff", count)
    assert [tree.apply([(0, 2, "xxxxx")]), tree.apply([(0, 5, "y")])] == ["xxxxx bb cc dd ee ff", "y bb cc dd ee ff"]
    long = " ".join(words(draw, 5_000))
    tree = token_counts.TokenTree.build(long, count)
    tree.apply([(10_000, 10_004, "new")])
    assert tree.recounted <= 3 * token_counts.LEAF


def test_stored_trees(spark, tokenizer, odd):
    """Trees are stored with their rows, edited, stored and edited again."""
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    texts = [t if t is None else t[:2000] for t in [*odd, odd[0]]]
    docs = table(spark, texts).withColumn("tree", F.lit("replaced"))
    now, plain = token_counts.with_trees(docs), texts
    for k in range(3):
        edits = F.expr(f"array(named_struct('start', {3 * k}, 'end', {3 * k + 2}, 'text', 'new word'), named_struct('start', 40, 'end', 41, 'text', null), null, named_struct('start', 50, 'end', 50, 'text', '-'))")
        path = scratch.written(now.withColumn("edits", edits), "trees")
        now = token_counts.apply_edits(path)
        rows = sorted(now.collect(), key=lambda r: r.doc_id)
        after = []
        for t in plain:
            if t is not None:
                t = t[:50] + "-" + t[50:] if len(t) >= 50 else t
                t = t[: 3 * k] + "new word" + t[3 * k + 2 :] if len(t) >= 3 * k + 2 else t
            after.append(t)
        assert [r.text for r in rows] == after
        assert [r.n_tokens_edited for r in rows] == [0 if t is None else n(t) for t in after]
        assert [r.n_tokens for r in rows] == [0 if t is None else n(t) for t in plain]
        assert all(r.mark == 1 and r.n_refused >= 2 for r in rows)
        plain = after
    assert token_counts.apply_edits(token_counts.with_trees(table(spark, texts).limit(0))).count() == 0


def test_token_counts(spark, tokenizer):
    texts = ["mail a.b@c.org now 030 1234 5678", None, "", "plain"]
    rows = {r.doc_id: r for r in token_counts.token_counts(token_counts.with_redactions(table(spark, texts))).collect()}
    n = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    assert (rows[0].n_tokens, rows[0].n_tokens_edited) == (n(texts[0]), n("mail <redacted> now <redacted>"))
    assert (rows[1].n_tokens, rows[2].n_tokens, rows[3].n_tokens_edited) == (0, 0, n("plain"))


def test_other_tokenizers(tokenizer, tmp_path):
    """A tokenizer that doesn't split words as ours encodes whole texts."""
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    assert token_store.splits_at_spaces(token_store.tokenizer_path())
    config = json.loads(open(token_store.tokenizer_path()).read())
    config["normalizer"]["normalizers"].pop()
    path = str(tmp_path / "other.json")
    open(path, "w").write(json.dumps(config))
    coder = token_store.encoder(path)
    assert isinstance(coder, token_store.WholeEncoder)
    want = [np.array([*e.ids, 2], coder.dtype).tobytes() for e in Tokenizer.from_file(path).encode_batch(HARD, add_special_tokens=False)]
    assert coder.encode(pa.array([*HARD, None]), 2) == [*want, np.array([2], coder.dtype).tobytes()]
    with pytest.raises(ValueError):
        token_counts.counter(path)


def test_store(spark, tokenizer, odd, tmp_path):
    texts = HARD + odd
    ids = [None if i == 3 else i // 2 * 7 - 20 for i in range(len(texts))]
    path = str(tmp_path / "store")
    token_store.write_store(table(spark, texts, ids), path)
    got = token_store.read_store(spark, path).orderBy("start").collect()
    coded = collections.Counter()
    for i, t in zip(ids, texts, strict=True):
        own = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        coded[(i, len(own) // 4, zlib.crc32(own))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == coded
    assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    token_store.write_store(table(spark, texts).limit(0), path + "0")
    assert token_store.read_store(spark, path + "0").count() == 0


def test_code():
    draw = np.random.default_rng(2)
    for n, limit in [(1, 18), (2, 1), (5, 3), (300, 9), (300, 18), (5000, 13)]:
        counts = (draw.pareto(0.5, n) * 10 + 1).astype(np.int64)
        lengths = token_store.code_lengths(counts, limit)
        assert lengths.max() <= limit and (2.0 ** -lengths).sum() <= 1 + 1e-12
        if n == 300 and limit == 18:
            p = counts / counts.sum()
            assert (p * lengths).sum() <= -(p * np.log2(p)).sum() + 1
        code = token_store.Code(np.arange(n) * 3, lengths)
        ids = draw.choice(n, 1000) * 3
        lanes, payload = code.encode(ids)
        assert (code.decode(lanes, np.frombuffer(payload, np.uint8), 1000) == ids).all()


# --- 5 ------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda x: x.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: weight[s] * left / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mix(spark):
    draw = random.Random(4)
    texts = [" ".join(words(draw, draw.choice([1, 5, 200, 900]))) for _ in range(120)] + [None, "", " "]
    sources = [draw.choice(["a", "a", "a", "b", "é", "B", None, "tiny"]) if i < 119 else "tiny" for i in range(len(texts))]
    sources = ["big" if s == "tiny" and i % 20 else s for i, s in enumerate(sources)]
    ids = [i // 2 for i in range(len(texts))]
    rows = mixing.mix_report(table(spark, texts, ids, sources=sources)).collect()
    again = mixing.mix_report(table(spark, texts, ids, sources=sources).repartition(5)).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, again))
    sizes = collections.Counter()
    for t, s in zip(texts, sources, strict=True):
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((i, len((t or "").split())) for i, t in zip(ids, texts, strict=True))
    assert {round(r.target, 3) for r in rows} == {round(x, 3) for x in want.values()}
    taken = collections.Counter()
    for r in rows:
        taken[(r.source_size, round(r.target, 3))] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for s, t in want.items():
        assert abs(taken[(sizes[s], round(t, 3))] - t) <= mixing.BLOCK
    assert mixing.mix_report(table(spark, texts).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_report(table(spark, [None, ""])).collect()] == [0, 0]


def test_mix_of_tiny_sources(spark):
    """Sources of one block, and targets of a few words, get these words; longer ones miss less than their own last block's rest."""
    sizes = {"a": 10, "b": 3, "c": 20, "d": 1, "e": 640, "f": 7, "g": 100, None: 2}
    texts, sources = [], []
    for s, n in sizes.items():
        for part in (n // 2, n - n // 2):
            texts.append(" ".join(["w"] * part))
            sources.append(s)
    docs = table(spark, texts, sources=sources)
    rows = mixing.mix_report(docs).collect()
    taken, want = collections.Counter(), brute_targets(sizes)
    for r, s in zip(sorted(rows, key=lambda r: r.doc_id), sources, strict=True):
        taken[s] += r.taken
        assert r.taken <= 3 * r.size
    for s, n in sizes.items():
        off = abs(taken[s] - want[s])
        assert off <= 0.5 if n <= mixing.BLOCK or n % mixing.BLOCK == 0 else off < mixing.BLOCK
    assert sum(taken.values()) == sum(len(r.text.split()) for r in mixing.mix_documents(docs).collect())


def test_another_seed_deals_other_shards(spark):
    draw = random.Random(8)
    docs = table(spark, [" ".join(words(draw, 900)) for _ in range(300)], sources=[draw.choice("aab") for _ in range(300)])
    one, two, again = ({r.doc_id: r for r in mixing.mix_report(docs, seed=k).collect()} for k in (0, 1, 0))
    assert one == again and max(r.first_shard for r in one.values() if r.taken) > 0
    assert [one[i].target for i in one] == [two[i].target for i in one] and [one[i].taken for i in one] == [two[i].taken for i in one]
    assert [(r.n_shards, r.first_shard) for r in one.values()] != [(two[i].n_shards, two[i].first_shard) for i in one]
    _, pieces = mixing.mix(docs)
    per = pieces.groupBy("shard").agg(F.countDistinct("slot", "row").alias("n")).collect()
    assert len(per) > 1


def test_mix_documents(spark):
    draw = random.Random(6)
    texts = [" ".join(words(draw, 150)) + "\n" for _ in range(30)] + [None, ""]
    docs = table(spark, texts, sources=["a" if i % 5 else "b" for i in range(32)])
    report = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect()}
    got = collections.Counter()
    for r in mixing.mix_documents(docs).collect():
        assert r.text and r.n_chars == len(r.text) and r.digest == "y"
        got[r.doc_id] += len(r.text.split())
    assert got == {k: v for k, v in report.items() if v}


def test_permutation(spark):
    for n in (1, 2, 7, 100, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))


# --- 7 ------------------------------------------------------------------------------------------


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = {i: i for i in ids if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if None not in (ids[a], ids[b]) and both and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    return [(i, len(s), None if i is None else find(i)) for i, s in zip(ids, sets, strict=True)]


def near_texts():
    draw = random.Random(9)
    out = []
    for _ in range(12):
        w = words(draw, draw.choice([3, 5, 6, 80, 300]), 3000)
        out.append(" ".join(w))
        for _ in range(draw.randrange(6)):
            v = list(w)
            for _ in range(draw.randrange(1, 4)):
                v[draw.randrange(len(v))] = "edit"
            out.append(" ".join(v))
    return [*out, None, "", "  ", None, out[5], out[5].upper(), "one", "ONE"]


def test_near(spark):
    texts = near_texts()
    ids = list(range(100, 100 + len(texts)))
    ids[4], ids[7] = None, ids[20]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, texts, ids)).collect()]
    assert collections.Counter(got) == collections.Counter(brute_components(texts, ids))
    assert near_dedup.near_duplicates(table(spark, texts).limit(0)).count() == 0


def test_near_large_nodes(spark, monkeypatch):
    """Nodes beyond every bound: branched by Spark, cut in blocks, and ids joined by a shuffle."""
    texts = near_texts()
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 3)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == set(brute_components(texts, list(range(len(texts)))))


def test_near_chain_beyond_every_bound(spark, monkeypatch):
    """A chain in which only neighbours are linked: every link is needed, and every node is larger than its bounds."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 60)
    monkeypatch.setattr(near_dedup, "LEAF", 32)
    base = [f"c{i}" for i in range(3000)]
    texts = [" ".join(base[6 * k : 6 * k + 100]) for k in range(480)]
    got = {r.component_id for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == {0}
    rare = [" ".join(f"r{k}x{i}" for i in range(50)) for k in range(300)]
    pairs = [t for t in rare for _ in (0, 1)]
    for k in range(0, 600, 2):
        pairs[k] = pairs[k].replace("x3 ", "changed ")
    found = collections.Counter(r.component_id for r in near_dedup.near_duplicates(table(spark, pairs)).collect())
    assert sum(n == 2 for n in found.values()) >= 0.99 * 300


def star_texts(n):
    """A template, not the first, and n copies that are 0.858 to it and 0.73 to each other."""
    draw, out = random.Random(21), []
    base = [f"t{i}" for i in range(200)]
    for k in range(n):
        w = list(base)
        for p in draw.sample(range(5, 195, 5), 3):
            w[p] = f"copy{k}at{p}"
        out.append(" ".join(w))
    return [*out[: n // 2], " ".join(base), *out[n // 2 :]]


def test_near_star_by_spark(spark, monkeypatch):
    """A star far beyond a task's bound loses no link on the way to a task."""
    monkeypatch.setattr(near_dedup, "NODE_ROWS", 10)
    got = [r.component_id for r in near_dedup.near_duplicates(table(spark, star_texts(120))).collect()]
    assert got == [0] * 121


def test_near_star_in_a_task():
    """Nor does one beyond a leaf within a task, in either walk."""
    import pyarrow as pa

    sets = list(near_dedup.shingle_sets(pa.array(star_texts(1500))))
    sigs = [near_dedup.signature(s).astype("<u2").tobytes() for s in sets]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near_dedup._verify(7, root[:], sigs, [s.tobytes() for s in sets], root[:]):
        assert near_dedup.linked(sets[a], sets[b])
        root[find(a)] = find(b)
    assert len({find(x) for x in root}) == 1
    digests = [b"%d" % i for i in range(len(sets))]
    near = near_dedup._similar(7, [0] * len(sets), digests, sigs)
    assert sorted(d for _, _, d in near) == sorted(digests) and len({g for _, g, _ in near}) == 1


def signatures(n, template, seed):
    """Signatures in which each value is the template's with this probability, and random otherwise."""
    draw = np.random.default_rng(seed)
    own = draw.integers(0, 1 << 16, (n, near_dedup.COORDS), dtype=np.uint16)
    return np.where(draw.random(own.shape) < template, draw.integers(0, 1 << 16, near_dedup.COORDS, dtype=np.uint16), own)


def groups_of(sigs, threshold=85):
    digests = [b"%09d" % i for i in range(len(sigs))]
    found = near_dedup._similar(7, [0] * len(sigs), digests, [s.astype("<u2").tobytes() for s in sigs], threshold)
    return {int(d): g for _, g, d in found}


def test_near_paths_find_pairs_in_a_large_node():
    """A chain, a star and pairs within a family of unrelated texts from one template, in one large node."""
    family, draw = signatures(6000, 0.66, 1), np.random.default_rng(2)
    for k in range(0, 600, 2):  # pairs with 58 of 64 values in common
        family[k + 1] = family[k]
        at = draw.choice(near_dedup.COORDS, 6, replace=False)
        family[k + 1, at] = draw.integers(0, 1 << 16, 6)
    for k in range(1000, 1200):  # a chain: 58 of 64 with the one before
        family[k] = family[k - 1]
        family[k, (np.arange(6) + 6 * k) % near_dedup.COORDS] = draw.integers(0, 1 << 16, 6)
    for k in range(2001, 2400):  # a star around 2000
        family[k] = family[2000]
        family[k, draw.choice(near_dedup.COORDS, 6, replace=False)] = draw.integers(0, 1 << 16, 6)
    got = groups_of(family)
    assert sum(k in got and got[k] == got.get(k + 1) for k in range(0, 600, 2)) >= 0.85 * 300  # one tree of twelve
    assert sum(k in got and got[k] == got.get(k - 1) for k in range(1000, 1200)) >= 0.85 * 200
    assert sum(k in got and got[k] == got.get(2000) for k in range(2001, 2400)) >= 0.85 * 399


def test_near_paths_cost_less_than_the_square(monkeypatch):
    """Families of similarity 0.5 and growing size: pairs compared."""
    compared = []
    plain = near_dedup._Node._tiles

    def counted(self, order, first):
        compared.append(min(first, len(order)) * len(order))
        plain(self, order, first)

    monkeypatch.setattr(near_dedup._Node, "_tiles", counted)
    monkeypatch.setattr(near_dedup, "LEAF", 128)
    cost = []
    for n in (2000, 8000):
        compared.clear()
        groups_of(signatures(n, 0.667, n))
        cost.append(sum(compared))
    assert cost[1] < 0.8 * 16 * cost[0] and cost[1] < 8000**2 / 2


def test_components(spark):
    draw = random.Random(8)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 1)]
    root = list(range(2000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if None not in e and e[0] != e[1] for x in e}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 9 ------------------------------------------------------------------------------------------


def test_nearest(spark, monkeypatch):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(1500, 16)) * draw.uniform(0.2, 2, (1500, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2001, [0.0] * 16), (2020, [None] * 16), (2040, [float("nan")] * 16), (2060, [1.0] * 15), (2080, [float("inf")] + [1.0] * 15), (2100, []), (None, [1.0] * 16), (20, rows[20][1]), (2101, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = nearest.valid(df)
    usable = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.array([i for i, _ in usable]), np.array([v for _, v in usable])
    monkeypatch.setattr(nearest, "LEAST", 8)
    for block, least, exact in ((8192, 0.9, False), (500, 0.9, False), (500, 1.0, True), (8192, 1.0, True)):
        monkeypatch.setattr(nearest, "BLOCK", block)
        got = collections.defaultdict(list)
        for r in nearest.nearest(good, good.where("vec_id % 20 = 0").dropDuplicates(["vec_id"]), exact=exact).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        found = total = 0
        queries = sorted({i for i in ids.tolist() if i % 20 == 0})
        for q in queries:
            s = x @ x[list(ids).index(q)]
            keep = ids != q
            order = np.lexsort((ids[keep], -s[keep]))[:20]
            want = ids[keep][order].tolist()
            found, total = found + len(set(want) & {i for i, _ in got[q]}), total + len(set(want))  # one id is there twice
            assert len(got[q]) == 20 and [t for _, t in got[q]] == sorted((t for _, t in got[q]), reverse=True)
            assert all(abs(t - float(x[list(ids).index(i)] @ x[list(ids).index(q)])) < 1e-9 for i, t in got[q])
        assert found >= least * total
    few = nearest.valid(df.where("vec_id < 4"))
    assert nearest.nearest(few, few).count() == 12
    assert nearest.nearest(nearest.valid(df.limit(0)), nearest.valid(df.limit(0))).count() == 0


def test_nearest_among_lengths(spark):
    """A query is held against the vectors of its own length."""
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(100)] + [(-1, [1.0, 2.0])] + [(1000 + i, draw.normal(size=3).tolist()) for i in range(30)]
    good = nearest.valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("x")))
    got = collections.defaultdict(list)
    for r in nearest.nearest(good, good.where("vec_id % 20 = 0 or vec_id = -1")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert sorted(got) == [0, 20, 40, 60, 80, 1000, 1020]
    vectors = dict(rows)
    for q, found in got.items():
        best = sorted((i for i in vectors if i != q and len(vectors[i]) == len(vectors[q])), key=lambda i: -np.dot(vectors[i], vectors[q]))[:20]
        assert found == best


def test_verified_part():
    """Many dimensions, and norms of a wide spread: few vectors are verified, and little is missed."""
    draw = np.random.default_rng(3)
    for dim, spread in ((64, 0.3), (384, 0.0), (384, 0.3)):
        x = draw.normal(size=(8000, dim))
        x *= draw.lognormal(0, spread, (8000, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
        block = nearest.ranges(np.arange(8000), x)
        windows, verified, found = [a.windows(x[:20]) for a in block], 0, 0
        for i in range(20):
            best = nearest.Best(20)
            verified += sum(a.search(x[i], i, best, w[i]) for a, w in zip(block, windows))
            s = x @ x[i]
            s[i] = -np.inf
            assert len(best.ids) == 20
            found += len(set(np.argsort(-s)[:20].tolist()) & set(best.ids.tolist()))
        assert verified < 0.25 * 20 * 8000 and found >= 0.95 * 400


@pytest.mark.parametrize("norms", ["equal", "uniform", "lognormal", "outlier"])
def test_nearest_in_a_full_block(norms):
    """A whole block of unclustered vectors, where norms tell more than directions."""
    import pyarrow as pa

    draw = np.random.default_rng(3)
    x = draw.normal(size=(nearest.BLOCK, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    size = {"equal": np.ones(len(x)), "uniform": draw.uniform(0.5, 1, len(x)), "lognormal": draw.lognormal(0, 0.3, len(x)), "outlier": np.where(np.arange(len(x)) == 5, 100.0, 1.0)}[norms]
    x *= size[:, None]
    part = lambda n, kind: pa.record_batch({"cell": np.zeros(n, np.int64), "kind": np.full(n, kind), "vec_id": np.arange(n), "v": pa.array(list(x[:n]))})
    got = collections.defaultdict(set)
    for batch in nearest._search(20, False)(iter([part(len(x), 0), part(60, 1)])):
        for r in batch.to_pylist():
            got[r["query_id"]].add(r["vec_id"])
    for q in range(60):
        s = x @ x[q]
        s[q] = -np.inf
        assert len(got[q] & set(np.argsort(-s)[:20].tolist())) >= 18


# --- 10 -----------------------------------------------------------------------------------------


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language_id.op10_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    model = language_id.train(docs)
    odd = [None, "", "123 !!", "é", "x" * 3_000_000, "the and of " * 100]
    got = {r.doc_id: r for r in language_id.identify(table(spark, odd), model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and [got[i].score for i in range(3)] == [0.0] * 3
    assert got[5].lang_pred == "en" and got[4].lang_pred != "und"
    assert {r.lang_pred for r in language_id.identify(table(spark, odd), None).collect()} == {"und"}
    assert language_id.train(table(spark, odd, langs=[None] * 6)) is None
    single = language_id.train(table(spark, ["some words"] * 40))
    assert language_id.identify(table(spark, ["other words"]), single).first().lang_pred == "en"


def test_language_odd_tables(spark, monkeypatch):
    """Empty tables, repeated rows, null doc_ids, long training texts, clashing names, and the same model as in one place."""
    docs = spark.createDataFrame([], DOCS)
    assert language_id.train(docs) is None and language_id.identify(docs, None).count() == 0
    texts = ["uma ume umi umo"] * 30 + ["xor xar xir xur " * 4000] * 30 + ["uma xor"]
    langs = ["a"] * 30 + ["b"] * 30 + [None]
    ids = [None if i % 7 == 0 else i // 2 for i in range(61)]
    docs = table(spark, texts, ids, langs).withColumn("score", F.lit(9.0)).withColumn("lang_pred", F.lit("x"))
    model = language_id.train(docs)
    assert model.languages == ["a", "b"]
    rows = [(r.l, r.t) for r in language_id.sample(docs).collect()]
    assert len(rows) < 60 and np.allclose(language_id.fit(rows).weights, model.weights)
    assert len(language_id.sample(docs, limit=8).collect()) == 8
    got = language_id.identify(docs, model).collect()
    assert [r.lang_pred for r in got[:60]] == langs[:60] and all(r.mark == 1 and 0 <= r.score <= 1 for r in got)
    assert model.scale.tolist() == language_id.train(docs.repartition(5)).scale.tolist()


def test_codewords():
    for n in range(1, 40):
        codes = language_id.codewords(n)
        assert len({tuple(c) for c in codes.tolist()}) == n
        if n > 2:
            gaps = [(codes[i] != codes[j]).sum() for i, j in itertools.combinations(range(n), 2)]
            assert min(gaps) >= min(4, codes.shape[1] // 4, 2 if n == 3 else 4)


def test_long_rows_are_summed_in_pieces(monkeypatch):
    model = language_id.fit([("a", "uma ume umi " * 50), ("b", "xor xar xir " * 50)])
    import pyarrow as pa

    text = pa.array(["uma xar umi " * 400])
    whole = model.totals(text)
    monkeypatch.setattr(language_id, "SLICE", 600)
    parts = model.totals(text)
    assert np.allclose(whole[0], parts[0]) and (whole[1] == parts[1]).all()
