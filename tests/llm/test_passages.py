"""Runs of more than 50 words that stand in other texts, against all runs compared in plain Python."""

import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from mosslight.llm import line_dedup, passages, substring_dedup
from mosslight.llm.queries import QUERIES


def words(draw, n, letters="abcdefghijklmnop"):
    return ["".join(draw.choices(letters, k=draw.randint(1, 4))) for _ in range(n)]


def corpus():
    draw = random.Random(5)
    p = words(draw, 60)
    own = lambda n: words(draw, n)
    runs = [own(n) for n in (50, 51, 51, 52)]
    texts = [" ".join(own(30) + p + own(40)), " ".join(own(3) + p[:51] + own(90)), "\n".join(own(80) + p[9:]) + "\n"]
    texts += [" ".join(own(20) + p[:50] + own(20)), " ".join(p[10:60])]  # 50 words only
    for r in runs:
        texts += [" ".join(own(7) + r + own(5)), "\n ".join(own(90) + r)]
    again = own(120)
    texts += [" ".join(again + own(5) + again)]  # repeats itself, and nobody else
    texts += [" ".join(own(60))] * 2 + [" ".join(own(20))] * 2  # copies, long enough and not
    texts += ["of " * 300, "of " * 51, "of " * 50, "", None]
    # one passage under edits at many places, so that an anchor has many segments
    texts += [" ".join(p[:k] + own(1) + p[k + 1 :] + own(6)) for k in range(60)]
    return texts


def brute(texts):
    where = collections.defaultdict(set)
    runs = [[tuple(w[i : i + 51]) for i in range(len(w) - 50)] for w in ((t or "").split() for t in texts)]
    for i, own in enumerate(runs):
        for x in own:
            where[x].add(i)
    return [any(len(where[x]) > 1 for x in own) for own in runs]


def test_passages_of_over_50_words_are_told(spark):
    """Before, the flag knew strings of 256 bytes only, and was set where a text repeats itself."""
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    assert [got[i].shares_passage for i in range(len(texts))] == brute(texts)
    # bytes go where a text repeats itself; that shares nothing
    assert any(r.n_removed > 0 and not r.shares_passage for r in got.values())
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    once = {k for k, n in collections.Counter(texts).items() if n == 1}
    told = {r.text for r in keyed.join(passages.sharing(keyed), "key").collect()} & once
    assert told == {t for t, x in zip(texts, brute(texts)) if x and t in once}


def test_starts_left_out_before_the_transform_are_not_shared():
    """All starts that equal one of another content at the same distance to the anchor lie in the range."""
    draw = np.random.default_rng(2)
    n = substring_dedup.LENGTH
    base = draw.integers(97, 120, 768).astype(np.uint8)
    contents = []
    for _ in range(40):
        own = base.copy()
        own[draw.integers(0, 768, draw.integers(0, 4))] = 33
        a, b = int(draw.integers(0, 200)), int(draw.integers(650, 769))
        contents.append((int(draw.integers(0, 2)), own[a:b], 368 - a))
    # the same text of another group is no partner
    contents.append((9, base, 368))
    live = substring_dedup.live_starts(contents)
    assert live[-1] is None
    at = collections.Counter((g, before - s, c[s : s + n].tobytes()) for g, c, before in contents for s in range(len(c) - n + 1))
    for (g, c, before), found in zip(contents, live):
        for s in range(len(c) - n + 1):
            if at[g, before - s, c[s : s + n].tobytes()] > 1:
                assert found[0] <= s < found[1]


def test_line_dedup_tells_passages_within_lines(spark):
    """Before, only whole lines that repeat were told."""
    texts = corpus()
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    docs = docs.unionByName(docs.where("doc_id = 1"))  # rows equal in doc_id and text
    own = [(r.doc_id, r.text) for r in docs.collect()]
    plain, told = line_dedup.dedup_units(docs), line_dedup.dedup_units(docs, passages=True)
    kept = lambda rows: collections.Counter((r.doc_id, r.n_units, r.n_removed, str(r.spans), r.kept, r.longest_repeated) for r in rows)
    rows = told.collect()
    assert kept(rows) == kept(plain.collect()) and "shares_run" not in plain.columns
    assert collections.Counter((r.doc_id, r.shares_run) for r in rows) == collections.Counter((i, x) for (i, _), x in zip(own, brute([t for _, t in own])))
    assert any(r.shares_run and not r.longest_repeated for r in rows)


def test_registered_query_tells_passages_planted_within_lines(spark, tmp_path):
    """Before, no registered query of line deduplication told them."""
    draw = random.Random(11)
    plain = [[" ".join(words(draw, 25)) for _ in range(8)] for _ in range(60)]
    for i in range(0, 40, 2):  # in one line of either, with words of its own before and after; 60 words are over the bound, 50 are not
        p = " ".join(words(draw, 60 if i < 20 else 50))
        for own in plain[i : i + 2]:
            at = draw.randrange(8)
            own[at] = f"{own[at]} {p} {' '.join(words(draw, 5))}"
    texts = ["\n".join(x) for x in plain]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["line_dedup_passages"](spark, str(tmp_path)).collect()}
    assert [rows[i].shares_run for i in range(60)] == [i < 20 for i in range(60)] == brute(texts)
    assert not any(r.longest_repeated for r in rows.values())


def test_line_dedup_moves_texts_once_when_it_tells_passages(spark):
    """Before, texts were dealt by key and by row again where the rows told were too many to broadcast."""
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id long, text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for told in (False, True):
            plan = line_dedup.dedup_units(docs, passages=told)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            moved = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: (.*)$", plan, re.M)
            assert sum("text#" in x for x in moved) == 1 < len(moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
