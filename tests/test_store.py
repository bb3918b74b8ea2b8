"""Snapshots, the keyword index, changes of documents, listing and the one-scan search."""

import io
import random
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosslight.config import AgentOptions, ChunkOptions
from mosslight.operators import knn as N
from mosslight.operators.chunking import global_index
from mosslight.operators.embed import HashingEmbedder
from mosslight.operators.keyword_index import KeywordIndex
from mosslight.operators.retrieve import BM25
from mosslight.plans.agent import Agent
from mosslight.plans.ingest import ingest
from mosslight.sources.catalog import Catalog
from mosslight.sources import readers as L
from mosslight.sources.readers import load_documents
from mosslight.sources.snapshots import BucketTable, Conflict, bucket_of
from mosslight.streaming import ingest as S


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows(spark, ids, text="x"):
    return spark.createDataFrame([(i, f"{text}{i}") for i in ids], "doc_id long, content string")


def test_snapshots(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), bucket_of("doc_id", 4))
    assert t.read() is None and t.version() == 0
    t.write(rows(spark, range(20)))
    old, folders = t.read(), t.snapshot()["folders"]
    gone = rows(spark, [3]).select("doc_id")
    now = t.write(rows(spark, [3], "new"), gone=gone, on="doc_id")
    # one bucket is written again, the others keep their files
    assert sum(now["folders"][b] != folders[b] for b in folders) == 1
    assert {r.content for r in old.collect()} == {f"x{i}" for i in range(20)}
    assert {r.content for r in t.read().collect()} == {f"x{i}" for i in range(20) if i != 3} | {"new3"}
    t.write(rows(spark, [100]).withColumn("more", F.lit(1)))
    assert {r.more for r in t.read().collect()} == {None, 1}
    with pytest.raises(ValueError, match="more"):
        t.write(rows(spark, [101]).withColumn("more", F.lit("text")))
    assert t.read([0, 1, 2, 3]).count() == 21
    t.compact()
    assert {len(f) for f in t.snapshot()["folders"].values()} == {1} and t.read().count() == 21
    assert t.vacuum() > 0 and len(t.versions()) == 1 and t.read().count() == 21
    # two writers from one snapshot
    stale = t.snapshot()
    t.write(rows(spark, [200]))
    with pytest.raises(Conflict):
        t._commit(stale)
    assert t.read().count() == 22
    t.write(rows(spark, []), fresh=True)
    assert t.read().count() == 0


def test_a_batch_counts_once(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), bucket_of("doc_id", 4))
    for batch in (0, 1, 1, 0, 2):
        t.write(rows(spark, [batch]), batch=("s", batch))
    t.write(rows(spark, [9]), batch=("other", 0))
    assert sorted(r.doc_id for r in t.read().collect()) == [0, 1, 2, 9]


def corpus(spark, n=300):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(200)]
    return spark.createDataFrame([(i, " ".join(draw.choices(words, k=draw.randrange(0, 40)))) for i in range(n)] + [(n, None), (n + 1, "")], "chunk_id long, content string")


def same_scores(a, b):
    got, want = ({(r.query_id, r.chunk_id): r.score for r in x.collect()} for x in (a, b))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_keyword_index(spark, tmp_path):
    chunks = corpus(spark)
    queries = spark.createDataFrame([(0, "w1 w2 W3 w1"), (1, "w150 none"), (2, "nothing here"), (3, "")], "query_id long, text string")
    index = KeywordIndex(spark, str(tmp_path / "i"), buckets=8)
    with pytest.raises(ValueError, match="empty"):
        index.scores(queries)
    index.add(chunks.where("chunk_id < 200"))
    same_scores(index.scores(queries), BM25(chunks.where("chunk_id < 200")).scores(queries))
    index.add(chunks.where("chunk_id >= 200"))
    index.remove(chunks.where("chunk_id % 3 = 0"))
    left = chunks.where("chunk_id % 3 <> 0")
    same_scores(index.scores(queries), BM25(left).scores(queries))
    index.update(chunks.where("chunk_id % 6 = 0"))
    left = left.unionByName(chunks.where("chunk_id % 6 = 0"))
    plain = BM25(left)
    for _ in range(2):
        same_scores(index.scores(queries), plain.scores(queries))
        assert {tuple(r) for r in index.document_frequency().collect()} == {tuple(r) for r in plain.document_frequency().collect()}
        assert index.document_count() == left.count()
        index.compact()
    # only the buckets of the query's terms are opened, and the term reaches the scan
    opened, all_ = index.files_read(["w1"])
    assert opened == 1 and all_ == 8
    assert "In(term, [w1,w2])" in plan_of(index.scores(queries.where("query_id = 0").withColumn("text", F.lit("w1 w2"))))
    # more terms than are literals
    many = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(200)) + " " + " ".join(f"z{i}" for i in range(200)))], "query_id long, text string")
    same_scores(index.scores(many), plain.scores(many))
    assert index.scores(queries.where("query_id = 3")).count() == 0
    assert [r.rank for r in index.search(queries.where("query_id = 0"), 20, compat_cap=5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def write(path, **files):
    for name, text in files.items():
        (path / f"{name}.txt").write_text(text)


def test_changed_new_and_removed_files(spark, tmp_path):
    own = tmp_path / "in"
    own.mkdir()
    write(own, a="alpha one", b="beta two", c="gamma three")
    e = HashingEmbedder(8)
    catalog = Catalog(spark, str(tmp_path / "catalog"), e.name)
    t = catalog.create("T")["id"]
    assert ingest(spark, catalog, t, [str(own)], e).changes == {"new": 3}
    index = catalog.keyword_index(t)
    assert index.document_count() == 3
    reader = catalog.store.open(t)
    write(own, b="beta changed", d="delta four")
    (own / "c.txt").unlink()
    r = ingest(spark, catalog, t, [str(own)], e, sync=True)
    assert r.changes == {"new": 1, "changed": 1, "unchanged": 1, "removed": 1} and r.documents == 3
    text = lambda df: sorted(x.content for x in df.collect())
    assert text(reader) == ["alpha one", "beta two", "gamma three"]
    assert text(catalog.store.open(t)) == ["alpha one", "beta changed", "delta four"]
    assert sorted(x.name for x in catalog.documents(t).collect()) == ["a.txt", "b.txt", "d.txt"] and catalog.stats(t)["document_count"] == 3
    # the index followed
    index = catalog.store.index(t)
    assert index is not None and index.document_count() == 3
    found = index.search(spark.createDataFrame([(0, "beta two"), (1, "gamma"), (2, "changed")], "query_id long, text string"), 5)
    assert sorted((x.query_id, x.rank) for x in found.collect()) == [(0, 1), (2, 1)]
    # without sync nothing goes; a file that becomes empty does
    (own / "a.txt").unlink()
    write(own, d="  ")
    r = ingest(spark, catalog, t, [str(own)], e)
    assert r.changes == {"changed": 1, "unchanged": 1} and text(catalog.store.open(t)) == ["alpha one", "beta changed"]
    assert sorted(x.name for x in catalog.documents(t).collect()) == ["a.txt", "b.txt"]


def test_log_is_compacted(spark, tmp_path, monkeypatch):
    from mosslight.sources import catalog as T

    monkeypatch.setattr(T, "FOLDERS", 2)
    catalog = Catalog(spark, str(tmp_path / "catalog"), "m")
    t, other = catalog.create("T")["id"], catalog.create("U")["id"]
    for k in range(5):
        catalog.record_documents(t, [{"name": f"n{k}", "file_path": f"/p{k % 2}", "file_type": "markdown", "chunk_count": k}])
    catalog.record_documents(other, [{"name": "o", "file_path": "/p0", "file_type": "pdf", "chunk_count": 1}])
    assert sorted((r.file_path, r.name) for r in catalog.documents(t).collect()) == [("/p0", "n4"), ("/p1", "n3")]
    assert catalog.get(t)["document_count"] == 2 and catalog.store.metadata(t)["chunk_count"] == 7
    assert max(map(len, catalog.log.snapshot()["folders"].values())) <= 3
    catalog.delete(t)
    assert [r.topic_id for r in catalog.tables()[1].collect()] == [other]


def test_a_stream_that_dies_between_store_and_checkpoint(spark, tmp_path, monkeypatch):
    own = tmp_path / "in"
    own.mkdir()
    write(own, a="alpha one", b="beta two")
    (own / "c.html").write_text("<p>gamma &amp; more</p>")
    e = HashingEmbedder(8)
    catalog = Catalog(spark, str(tmp_path / "catalog"), e.name)
    t, real = catalog.create("T")["id"], catalog.record_documents

    def dies(*_):
        raise RuntimeError("killed")

    monkeypatch.setattr(catalog, "record_documents", dies)
    with pytest.raises(Exception, match="killed"):
        S.ingest_stream(spark, catalog, t, str(own), e, str(tmp_path / "cp")).awaitTermination()
    assert catalog.store.open(t).count() == 3 and catalog.documents(t).count() == 0
    monkeypatch.setattr(catalog, "record_documents", real)
    S.ingest_stream(spark, catalog, t, str(own), e, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.content for r in catalog.store.open(t).collect()) == ["alpha one", "beta two", "gamma & more"]
    assert catalog.documents(t).count() == 3 and catalog.get(t)["document_count"] == 3


def test_a_stream_without_repeated_content(spark, tmp_path):
    own = tmp_path / "in"
    own.mkdir()
    write(own, a="same", b="same", c="other")
    e = HashingEmbedder(8)
    catalog = Catalog(spark, str(tmp_path / "catalog"), e.name)
    t = catalog.create("T")["id"]
    for _ in range(2):
        S.ingest_stream(spark, catalog, t, str(own), e, str(tmp_path / "cp"), within="1 day").awaitTermination()
        write(own, d="same", e="new")
    assert sorted(r.content for r in catalog.store.open(t).collect()) == ["new", "other", "same"]


def test_files_with_odd_names(spark, tmp_path):
    for name in ("a|b.txt", "c[1].TXT", "d{e}.md", "f g.txt"):
        (tmp_path / name).write_text(name)
    (tmp_path / "x|y").mkdir()
    (tmp_path / "x|y" / "z.markdown").write_text("deep")
    docs, failures = load_documents(spark, [str(tmp_path), str(tmp_path / "a|b.txt")])
    assert sorted(r.content for r in docs.collect()) == sorted(["a|b.txt", "a|b.txt", "c[1].TXT", "d{e}.md", "f g.txt", "deep"]) and not failures
    (tmp_path / "none").mkdir()
    assert load_documents(spark, [str(tmp_path / "c[1].TXT"), str(tmp_path / "none")])[1] == [(str(tmp_path / "none"), "no supported file")]


def test_global_index_of_any_ids(spark):
    ids = ["b", "a", "é", "", "zz", "10", "9", None] + [f"k{i}" for i in range(300)]
    for own, kind in ((ids, "string"), ([None, -5, 2**62, *range(400)], "long")):
        table = spark.createDataFrame([(i, k) for i in own for k in range(2)], f"doc_id {kind}, chunk_index int")
        got = [(r.doc_id, r.chunk_index) for r in global_index(table).orderBy("global_index").collect()]
        order = lambda x: (x[0] is not None, (x[0].encode() if isinstance(x[0], str) else x[0]) if x[0] is not None else 0, x[1])
        assert got == sorted(got, key=order) and len(got) == 2 * len(own)


def test_many_vectors_in_one_scan(spark, tmp_path):
    draw = np.random.default_rng(1)
    own = draw.normal(size=(500, 8))
    own[100:120] = own[7]
    spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in enumerate(own)] + [(1000, "none", None)], "chunk_id long, content string, embedding array<double>").repartition(4).write.parquet(str(tmp_path / "c"))
    chunks = spark.read.parquet(str(tmp_path / "c"))
    queries = [own[k].tolist() for k in (7, 50, 400)]
    for metric in ("cosine", "l2sq", "neg_ip"):
        got = {(r.sub_idx, r["rank"]): (r.chunk_id, r.content) for r in N.knn_many(chunks, queries, 12, metric=metric, keep=("content",)).collect()}
        table = spark.createDataFrame(list(enumerate(queries)), "query_id long, vector array<double>")
        batch = {(r.query_id, r["rank"]): r.chunk_id for r in N.knn_batch(chunks, table, 12, metric=metric).collect()}
        for i, q in enumerate(queries):
            want = [r.chunk_id for r in N.knn(chunks.where("embedding is not null"), q, 12, metric=metric).collect()]
            assert [got[i, k + 1] for k in range(12)] == [(c, f"t{c}") for c in want]
            assert [batch[i, k + 1] for k in range(12)] == want
    vectors = dict(zip(("a x", "b y", "c z"), queries))
    agent = Agent(spark, chunks, lambda t: vectors[t])
    plan = {"sub_queries": [{"query": t} for t in vectors]}
    for strategy in ("hybrid", "vector"):
        found = agent.retrieve(plan, strategy, 5)
        assert plan_of(found).count("Scan parquet") == plan_of(agent.retrieve({"sub_queries": plan["sub_queries"][:1]}, strategy, 5)).count("Scan parquet")
        assert sorted((r.sub_idx, r["rank"]) for r in found.collect()) == [(i, k) for i in range(3) for k in range(1, 6)]
        one = {i: [(r.chunk_id, r.score) for r in agent.simple_query(t, 5, strategy).collect()] for i, t in enumerate(vectors)}
        for i in one:
            assert [(r.chunk_id, r.score) for r in found.where(f"sub_idx = {i}").orderBy("rank").collect()] == one[i]
    assert N.knn_many(chunks.limit(0), queries, 3).count() == 0 and N.knn_batch(chunks.limit(0), table, 3).count() == 0
    assert AgentOptions().top_k == 5 and ChunkOptions().chunk_size == 512


def test_names_in_any_case_and_order(spark):
    from mosslight.sources import catalog as T

    names = lambda *x: spark.createDataFrame([(y,) for y in x], "name string")
    topics = names("ÉCOLE", "straße", "Ночь", "plain")
    asked = spark.createDataFrame([("école",), ("STRASSE",), ("НОЧЬ",), ("Plain",)], "requested string")
    assert {r.requested: r.name for r in T.exact_topic(topics, asked).collect()} == {"école": "ÉCOLE", "STRASSE": None, "НОЧЬ": "Ночь", "Plain": "plain"}
    assert sorted(r.name for r in T.name_conflicts(topics, names("école", "PLAIN", "x")).collect()) == ["plain", "ÉCOLE"]
    local = T.available_models(names("m"), names("Zeta", "alpha", "éclair", "Eclair", "echo", "m")).where("source = 'local'")
    assert [r.name for r in local.orderBy("place").collect()] == ["alpha", "echo", "Eclair", "éclair", "Zeta"]


def test_a_load_lists_with_spark_and_scans_in_few_tasks(spark, tmp_path, monkeypatch):
    """Small files share tasks, and no walk asks for each file by itself."""
    own = tmp_path / "many"
    for i in range(80):
        (own / f"part={i % 40}").mkdir(parents=True, exist_ok=True)
        (own / f"part={i % 40}" / f"doc_id={i}.txt").write_text(f"text {i}\n")
    monkeypatch.setattr(L, "TASKS", 1)
    docs, failures = load_documents(spark, [str(own)])
    assert not failures and docs.count() == 80
    # two scans, by the size of the files, of one task per core each
    assert docs.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert not hasattr(L, "_has")


def test_the_folder_of_documents_has_few_folders(spark, tmp_path):
    import pathlib

    from mosslight import lifecycle as Y

    sf = tmp_path / "tables"
    rows = [(i, f"text {i}", None, None, 0) for i in range(300)] + [(5, "again", None, None, 0), (None, "none", None, None, 0), (-7, "below", None, None, 0), (301, None, None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    path = pathlib.Path(Y._folder(spark, str(sf)))
    files = list(path.rglob("*.txt"))
    assert len(files) == 303 and len(list(path.iterdir())) <= Y.FOLDERS
    assert sorted(f.read_bytes() for f in files) == sorted(f"{r[1]}\n".encode() for r in rows if r[1] is not None)
    got = sorted(((r.doc_id, r.file_size) for r in Y.listed_files(spark, str(sf)).collect()), key=str)
    assert got == sorted(((r[0], len(r[1]) + 1) for r in rows if r[1] is not None), key=str)


def test_a_topic_goes_out_and_in_as_a_folder(spark, tmp_path, monkeypatch):
    """No row passes the driver, values stay as they are, and two imports are two topics."""
    from pyspark.sql import DataFrame

    catalog = Catalog(spark, str(tmp_path / "catalog"), "m")
    topic = catalog.create("Topic", "about")
    rows = [("a", "one\ntwo", [1.0, float("nan")]), ("b", None, None), ("c", "é", [float("-inf"), 0.1])]
    catalog.store.create(topic["id"], spark.createDataFrame(rows, "chunk_id string, content string, embedding array<float>"), "m")
    catalog.record_documents(topic["id"], [{"name": n, "file_path": f"/{n}", "file_type": "markdown", "chunk_count": 1} for n in "xyz"])
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_: pytest.fail("rows pass the driver"))
    path = catalog.export_folder(topic["id"], str(tmp_path / "out"))
    names = []
    for _ in range(2):
        other = catalog.import_folder(path)
        names.append(other["name"])
        own = catalog.chunks(other["id"])
        assert sorted(str(r) for r in own.drop("topic_id").collect()) == sorted(str(r) for r in catalog.chunks(topic["id"]).drop("topic_id").collect())
        assert sorted(r.file_path for r in catalog.documents(other["id"]).collect()) == ["/x", "/y", "/z"]
    assert names == ["Topic (imported)", "Topic (imported) (imported)"]
    with pytest.raises(ValueError, match="topic.json"):
        catalog.import_folder(str(tmp_path / "none"))


def test_chunks_leave_a_worker_in_small_batches():
    import pyarrow as pa

    from mosslight.operators import chunking as C

    texts = [f"{i} " + "word " * 400 for i in range(2_000)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "content"])
    out = list(C._pieces(512, 50, C.RECURSIVE, "content")([batch]))
    assert max(b.column(0).unique().__len__() for b in out) <= C.ROWS
    assert max(b.nbytes for b in out) <= 2 * C.BYTES
    got = [(r["doc_id"], r["chunk_index"], r["content"]) for b in out for r in b.to_pylist()]
    assert got == [(i, k, t[a:b]) for i, t in enumerate(texts) for k, (a, b) in enumerate(C.split_text(t or "", 512, 50, C.RECURSIVE))]


def test_terms_are_counted_where_the_chunk_lies(spark, tmp_path):
    """Counting shuffles nothing; a set of queries shuffles weights once, by chunk."""
    docs = spark.createDataFrame([(1, "b a b"), (2, "A, b. c"), (3, None), (4, "..."), (5, "c" * 3)], "chunk_id long, content string")
    index = KeywordIndex(spark, str(tmp_path / "index"))
    counted = index._counted(docs)
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.chunk_id, r.dl, r.term, r.tf) for r in counted.collect()) == [(1, 3, "a", 1), (1, 3, "b", 2), (2, 3, "a", 1), (2, 3, "b", 1), (2, 3, "c", 1), (5, 1, "ccc", 1)]
    index.add(docs)
    queries = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "ccc b"), (4, "none")], "query_id long, text string")
    plan = index.scores(queries)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    want = {(r.query_id, r.chunk_id): round(r.score, 9) for r in BM25(docs).scores(queries).collect()}
    assert {(r.query_id, r.chunk_id): round(r.score, 9) for r in index.scores(queries).collect()} == want


def test_tasks_list_folders_as_spark_does(spark, tmp_path):
    """No index of files in the driver: what tasks find and read is what Spark's own reader does."""
    import os

    own = tmp_path / "in"
    for i, name in enumerate(["a.txt", "B.TXT", "x.md", "é ü.txt", "c[1].txt", "a|b.htm", "n.bin", "empty.txt", "_hidden.txt", ".dot.txt", "_k=1.txt", "t.txt._COPYING_", "_metadata.txt", "deep/a/b/c/d/e.txt", "deep/_no/f.txt", "deep/_k=v/f.txt", "deep/.no/f.txt", "y..txt"]):
        (own / name).parent.mkdir(parents=True, exist_ok=True)
        (own / name).write_bytes(b"" if "empty" in name else b"text \xff %d" % i)
    (own / "nothing").mkdir()
    os.symlink(own / "gone", own / "broken.txt")
    os.symlink(own / "deep" / "a", own / "linked")
    for root in (str(own), f"file://{own}", f"file:{own}/"):
        whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        got = L._files(spark, [root], True)
        columns = ["path", "modificationTime", "length", "content"]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect())) and got.where("load_error is not null").isEmpty()
        flat = {r.path for r in L._files(spark, [root]).select("path").collect()}
        assert flat == {r.path for r in whole.collect() if r.path.count("/") == str(own).count("/") + 1}
        docs, failures = load_documents(spark, [root])
        assert not failures and docs.count() == 11
        for df in (docs, L.list_files(spark, root), load_documents(spark, [root], file_type="github")[0]):
            assert "binaryFile" not in plan_of(df)


def test_a_checkout_named_by_a_uri(spark, tmp_path):
    own = tmp_path / "in"
    (own / "src").mkdir(parents=True)
    write(own, a="a", b="b")
    write(own / "src", c="c")
    for root in (str(own), f"file://{own}", f"file:{own}/"):
        docs, _ = load_documents(spark, [root], file_type="github", ignore="b*")
        assert sorted(r.relative_path for r in docs.collect()) == ["a.txt", "src/c.txt"]


def test_a_file_that_goes_or_is_too_large_is_a_row_with_an_error(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(L, "MAX_BYTES", 5)
    monkeypatch.setattr(L, "ROWS", 2)
    write(tmp_path, a="12345", b="123456", d="x", e="y")
    rows = [(f"file:{tmp_path}/{n}.txt", 0, size) for n, size in (("a", 5), ("b", 6), ("c", 1), ("d", 9), ("e", 1))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.timestamp("us", "UTC"), pa.int64()), strict=True)], names=["path", "modificationTime", "length"])
    out = [r for b in L._open([batch]) for r in b.to_pylist()]
    assert [(r["content"], r["length"]) for r in out] == [(b"12345", 5), (None, 6), (None, 1), (None, 9), (b"y", 1)]
    assert [r["load_error"] is None for r in out] == [True, False, False, False, True]
    assert "FileNotFoundError" in out[2]["load_error"] and "too large" in out[1]["load_error"]


def test_a_load_without_news_writes_nothing_and_reads_only_what_is_new(spark, tmp_path):
    own = tmp_path / "in"
    own.mkdir()
    write(own, a="alpha one", b="beta two", c="gamma three")
    e = HashingEmbedder(8)
    catalog = Catalog(spark, str(tmp_path / "catalog"), e.name)
    t = catalog.create("T")["id"]
    first = ingest(spark, catalog, t, [str(own)], e)
    index = catalog.keyword_index(t)
    was = catalog.store.table(t).version(), catalog.log.version(), index.table.version()
    again = ingest(spark, catalog, t, [str(own)], e)
    assert again.success and again.changes == {"unchanged": 3} and (again.documents, again.chunks, again.characters) == (first.documents, first.chunks, first.characters)
    assert (catalog.store.table(t).version(), catalog.log.version(), index.table.version()) == was
    with pytest.raises(ValueError, match="vectors"):
        ingest(spark, catalog, t, [str(own)], HashingEmbedder(9))
    ids = catalog.documents(t).where("name = 'b.txt'").select("doc_id")
    only, _ = load_documents(spark, [str(own), str(own / "a.txt")], only=ids)
    assert [r.content for r in only.collect()] == ["beta two"]
    # an index is brought up to date from the ids, and the chunks are made once
    write(own, b="beta changed", d="delta")
    assert ingest(spark, catalog, t, [str(own)], e).changes == {"new": 1, "changed": 1, "unchanged": 2}
    assert catalog.store.index(t).document_count() == 4
    assert sorted(r.content for r in catalog.store.open(t).collect()) == ["alpha one", "beta changed", "delta", "gamma three"]


def test_words_are_hashed_once():
    import hashlib
    import re

    from mosslight.operators import embed as E

    texts = ["a b A", "", "é ü_1 word " * 50, "x", "  ", "b"]
    for dim, seed in ((8, 0), (64, 3), (1, 0)):
        E._word_hash.cache_clear()
        want = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(f"{seed}:{w}".encode(), digest_size=8).digest(), "little")
                want[i, h % dim] += 1 if h >> 63 else -1
        assert np.array_equal(E.hashed_features(texts, dim, seed), want) and E._word_hash.cache_info().misses == 6
    assert E.hashed_features([], 8).shape == (0, 8) and not E.hashed_features(["", " "], 8).any()


def test_a_stream_lists_in_tasks_and_looks_again(spark, tmp_path):
    """No file source that keeps paths in the driver; known files aren't stored again, a look without news writes nothing."""
    own = tmp_path / "in"
    (own / "deep" / "more").mkdir(parents=True)
    write(own, a="alpha", blank=" ")
    write(own / "deep" / "more", b="beta")
    (own / "x.pdf").write_bytes(b"%PDF")
    e = HashingEmbedder(8)
    catalog = Catalog(spark, str(tmp_path / "catalog"), e.name)
    t = catalog.create("T")["id"]
    assert S.look_stream(spark, f"file://{own}").isStreaming
    run = lambda k: S.ingest_stream(spark, catalog, t, f"file://{own}", e, str(tmp_path / f"cp{k}"))
    versions = lambda: (catalog.store.table(t).version(), catalog.log.version())
    query = run(1)
    query.awaitTermination()
    assert "FileStreamSource" not in query.lastProgress.json and len(query.recentProgress) == 1
    assert sorted(r.content for r in catalog.store.open(t).collect()) == ["alpha", "beta"]
    was = versions()
    for k in (1, 2):
        run(k).awaitTermination()
    assert versions() == was
    write(own, c="gamma")
    # a moved file keeps its times
    import os

    write(tmp_path, d="delta")
    os.utime(tmp_path / "d.txt", (1, 1))
    os.rename(tmp_path / "d.txt", own / "deep" / "d.txt")
    run(1).awaitTermination()
    assert sorted(r.content for r in catalog.store.open(t).collect()) == ["alpha", "beta", "delta", "gamma"]
    assert catalog.documents(t).count() == 4 and versions() == (was[0] + 1, was[1] + 1)
