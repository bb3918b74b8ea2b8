"""The stages of the pipeline, each against what it should decide on its own input."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from mosslight.llm import mixing, near_dedup, token_store
from mosslight.llm.scratch import written

from .test_operators import brute_hits


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The input and output of every stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        f(spark, docs, sf).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_shape(stages):
    assert [n for n, _, _ in stages] == ["language_id", "near_dedup", "decontaminate", "mix_sources", "token_store"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_language(stages):
    _, before, after = stages[0]
    assert after.count() >= 0.99 * before.count()
    assert all(re.search(r"[^\W\d_]", r.text) for r in after.collect())


def test_near(stages):
    _, before, after = stages[1]
    kept = {r.doc_id for r in near_dedup.near_duplicates(before).where("kept").collect()}
    assert {r.doc_id for r in after.collect()} == kept and after.count() == len(kept)


def test_near_keeps_every_text_of_one_id(spark):
    """Rows of one doc_id with unlinked texts are documents of their own; of linked rows one stays."""
    rows = [(1, "a b c d e f", "en", "s", 1), (1, "other text that is long enough", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (2, "A b c d e f", "en", "s", 1), (None, "x", "en", "s", 1), (None, "x", "en", "s", 1), (5, None, None, None, None), (6, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = P.stage_near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, (r.text or "").lower()) for r in got if r.doc_id) == [(1, "a b c d e f"), (1, "other text that is long enough"), (5, ""), (6, "")]
    assert [r.doc_id for r in got].count(None) == 2
    unique = [r for r in rows if r[0] != 1]
    assert P.stage_near_dedup(spark, spark.createDataFrame(unique, docs.schema), "").count() == 5


CLASH = "score double, lang_pred string, ambiguous int, n_words int, n_hit int, items string, hit_spans int, name string, own_mark int, use int, _plan int, c0 int, tree map<string,int>, kept string"


def test_other_columns_stay(spark, sf):
    """Columns that have the names of operators' own, and one of a map, come through every stage."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(200)
    extra = {c.split()[0]: F.create_map(F.lit("k"), F.col("doc_id").cast("int")) if "map" in c else F.lit(-7).cast(c.split()[1]) for c in CLASH.split(", ")}
    docs = written(docs.withColumns(extra), "docs")
    for _, stage in P.STAGES[:-1]:
        after = written(stage(spark, docs, sf), "docs")
        assert after.columns == docs.columns and after.count() > 100
        assert after.where("score <> -7 or lang_pred <> '-7' or use <> -7 or own_mark <> -7 or n_hit <> -7 or items <> '-7' or c0 <> -7 or name <> '-7' or tree['k'] <> doc_id").isEmpty()
        docs = after


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_near_links_from_80_percent(spark):
    base = [f"t{i}" for i in range(104)]
    texts = [base, [*base[:20], "x", *base[21:60], "y", *base[61:]], [f"u{i}" for i in range(104)]]
    sets = [{tuple(w[k : k + 5]) for k in range(100)} for w in texts]
    assert 80 <= 100 * len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 85
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.stage_near_dedup(spark, docs, "").collect()) == [0, 2]
    assert near_dedup.near_duplicates(docs, threshold=near_dedup.OP7_THRESHOLD).where("kept").count() == 3


def test_decontaminate(spark, sf, stages):
    _, before, after = stages[2]
    rows = before.select("doc_id", "text").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {r.doc_id for r, (_, hit, _) in zip(rows, brute_hits([r.text for r in rows], items), strict=True) if not hit}
    assert {r.doc_id for r in after.collect()} == clean and len(clean) < len(rows)


def test_mix(stages):
    _, before, after = stages[3]
    want = {r.doc_id: r.taken for r in mixing.mix_report(before).collect() if r.taken}
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).alias("n")).collect()}
    assert got == want


def test_tokens(stages):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(token_store.tokenizer_path())
    _, before, after = stages[4]
    coded = sorted((r.doc_id, zlib.crc32(np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4").tobytes())) for r in before.collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in after.collect()) == coded


def test_run(spark, sf, stages):
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, stages[-1][2].collect()))
