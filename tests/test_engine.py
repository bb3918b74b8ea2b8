"""Ingest, stores, topics, the agent and the search tool end to end on small files."""

import json

import pytest
from pyspark.sql import functions as F

from mosslight.config import AgentOptions, ChunkOptions
from mosslight.operators import chunking as C
from mosslight.operators import knn as N
from mosslight.operators.embed import FunctionEmbedder, HashingEmbedder, PrecomputedEmbedder
from mosslight.plans.agent import Agent, best_topic, rag_query
from mosslight.plans.ingest import ingest
from mosslight.operators.retrieve import average_score
from mosslight.sources.catalog import Catalog, TopicError, resolve_model_path
from mosslight.sources.readers import load_documents, read_pdf
from mosslight.sources.store import ModelMismatch
from mosslight.streaming.ingest import ingest_stream


@pytest.fixture()
def folder(tmp_path):
    own = tmp_path / "in"
    (own / "sub").mkdir(parents=True)
    (own / "a.md").write_text("# Python\n\nPython is a language. Python has modules and packages.")
    (own / "sub" / "b.html").write_text("<html><title> Rust &amp; co </title><body><p>Rust is a compiled language.</p></body></html>")
    (own / "c.txt").write_text("Spark runs queries on clusters.\n" * 40)
    (own / "d.bin").write_bytes(b"\x00\x01")
    return str(own)


def test_load(spark, folder):
    docs, failures = load_documents(spark, [folder, "/no/such/file.txt"], metadata={"team": "x"})
    got = {r.file_name: r for r in docs.collect()}
    assert set(got) == {"a.md", "b.html", "c.txt"} and failures[0][0] == "/no/such/file.txt"
    assert got["a.md"].is_markdown and got["a.md"].team == "x" and got["b.html"].title == "Rust &amp; co"
    assert got["b.html"].content == "Rust & co Rust is a compiled language." and got["c.txt"].file_type == "text"
    with pytest.raises(ValueError, match="Failed to load"):
        load_documents(spark, ["/no/such"])
    with pytest.raises(RuntimeError, match="parser"):
        read_pdf(spark, [folder])
    flat, _ = load_documents(spark, [folder], recursive=False)
    assert flat.count() == 2
    repo, _ = load_documents(spark, [folder], file_type="github", ignore="*.bin")
    assert repo.count() == 3


def test_chunks(spark, folder):
    docs, _ = load_documents(spark, [folder])
    chunks = C.chunk_documents(docs, ChunkOptions(chunk_size=100, chunk_overlap=20))
    rows = chunks.collect()
    assert all(0 < r.chunk_size <= 100 for r in rows) and any(r.section_title == "Python" and r.heading_level == 1 for r in rows)
    assert C.choose_strategy(docs.select("doc_id", "content"), ChunkOptions()) == "recursive"
    index = sorted(r.global_index for r in C.global_index(chunks).collect())
    assert index == list(range(len(rows)))
    assert C.chunk_stats(chunks.limit(0)).first().asDict() == dict(total_chunks=0, avg_size=0, min_size=0, max_size=0, total_chars=0)


def test_knn_batch_agrees(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    for metric in ("cosine", "l2sq", "neg_ip"):
        q = [float(x) for x in e.where("vec_id = 7").first().embedding]
        single = [r.vec_id for r in N.knn(e, q, 5, metric=metric, key="vec_id").collect()]
        batch = N.knn_batch(e, e.where("vec_id = 7").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5, metric=metric, key="vec_id")
        assert [r.vec_id for r in batch.orderBy("rank").collect()] == single


def test_embedders(spark):
    df = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, content string")
    rows = {r.doc_id: r.embedding for r in HashingEmbedder(16).embed_documents(df).collect()}
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-6 and sum(map(abs, rows[2])) == 0
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError
        return [[3.0, 4.0] for _ in texts]

    assert FunctionEmbedder(flaky).embed_query("x") == pytest.approx([0.6, 0.8]) and len(calls) == 3
    table = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert PrecomputedEmbedder(table).embed_documents(df).count() == 1


def test_topics_and_tool(spark, folder, tmp_path):
    e = HashingEmbedder(64)
    catalog = Catalog(spark, str(tmp_path / "catalog"), e.name)
    topic = catalog.create("Languages")
    for bad in ("LANGUAGES", " "):
        with pytest.raises(TopicError):
            catalog.create(bad)
    seen = []
    done = ingest(spark, catalog, topic["id"], [folder], e, on_progress=lambda *x: seen.append(x[0]))
    assert done.success and done.documents == 3 and done.chunks >= 3 and seen[0] == "loading" and seen[-1] == "complete"
    assert catalog.stats(topic["id"])["document_count"] == 3
    assert not ingest(spark, catalog, topic["id"], ["/none"], e).success
    with pytest.raises(ModelMismatch):
        catalog.store.append(topic["id"], catalog.store.open(topic["id"]).drop("topic_id"), "other")
    for agentic in (False, True):
        for strategy in ("hybrid", "vector", "bm25", "ensemble"):
            out = json.loads(rag_query(spark, catalog, e.embed_query, topic="languages", query="Python modules vs Rust language", top_k=2, retrieval_strategy=strategy, use_agentic_mode=agentic))
            assert out["topicMatched"] == "exact" and 1 <= len(out["results"]) <= 2
            assert "Python" in str(out["results"]) or "Rust" in str(out["results"])
    other = catalog.import_(catalog.export(topic["id"]))
    assert other["name"] == "Languages (imported)" and catalog.chunks(other["id"]).count() == catalog.chunks(topic["id"]).count()
    assert best_topic(catalog, "languages (IMPORTED)", e.embed_query)[1] == "exact" and best_topic(catalog, "Rust", e.embed_query)[1] == "similar"
    with pytest.raises(TopicError, match="topic.json"):
        import io
        import zipfile

        buf = io.BytesIO()
        zipfile.ZipFile(buf, "w").close()
        catalog.import_(buf.getvalue())
    catalog.update(topic["id"], name="Tongues", description="d")
    again = Catalog(spark, str(tmp_path / "catalog"), e.name)
    assert {t["name"] for t in again.all()} == {"Tongues", "Languages (imported)"}
    shared = Catalog(spark, str(tmp_path / "own"), e.name, common_root=str(tmp_path / "catalog"))
    assert shared.is_common(topic["id"]) and shared.chunks(topic["id"]).count() > 0
    with pytest.raises(TopicError, match="read-only"):
        shared.delete(topic["id"])
    catalog.delete(topic["id"])
    assert catalog.get(topic["id"]) is None and catalog.store.open(topic["id"]) is None


def test_archive_paths(spark, tmp_path):
    import io
    import zipfile

    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("../x", "y")
        z.writestr("topic.json", "{}")
    with pytest.raises(TopicError, match="outside"):
        Catalog(spark, str(tmp_path / "c"), "m").import_(buf.getvalue())


def test_agent(spark):
    e = HashingEmbedder(32)
    rows = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(["python basics", "python and java", "java threads", "cooking rice", "python testing"])], "chunk_id string, content string")
    agent = Agent(spark, e.embed_documents(rows), e.embed_query)
    result = agent.query("python testing vs java threads", AgentOptions(top_k=3))
    got = result.results.collect()
    assert result.plan["complexity"] == "complex" and len({r.chunk_id for r in got}) == len(got) == 3
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert agent.simple_query("python", 2, "bm25").count() == 2
    with pytest.raises(ValueError):
        agent.simple_query("x", 5, "nope")


def test_stream(spark, folder, tmp_path):
    e = HashingEmbedder(16)
    catalog = Catalog(spark, str(tmp_path / "catalog"), e.name)
    topic = catalog.create("Stream")
    for _ in range(2):
        ingest_stream(spark, catalog, topic["id"], folder + "/c.txt", e, str(tmp_path / "cp")).awaitTermination()
    assert catalog.chunks(topic["id"]).select("doc_id").distinct().count() == 1


def test_one_bad_pdf_does_not_end_a_load(spark, tmp_path):
    from mosslight.operators.embed import HashingEmbedder
    from mosslight.plans.ingest import ingest
    from mosslight.sources.catalog import Catalog

    for name, data in (("a.pdf", b"one two"), ("b.pdf", b"bad"), ("c.pdf", b"three")):
        (tmp_path / name).write_bytes(data)

    def parser(data):
        if data == b"bad":
            raise ValueError("not a PDF")
        return [data.decode()]

    e = HashingEmbedder(8)
    catalog = Catalog(spark, str(tmp_path / "catalog"), e.name)
    topic = catalog.create("Files")
    r = ingest(spark, catalog, topic["id"], [str(tmp_path / x) for x in ("a.pdf", "b.pdf", "c.pdf")], e, parser=parser)
    assert r.success and r.documents == 2 and len(r.failures) == 1 and "not a PDF" in r.failures[0][1]
    assert sorted(x.content for x in catalog.chunks(topic["id"]).collect()) == ["one two", "three"]


def test_agents_are_kept_until_their_topic_changes(spark, tmp_path):
    from mosslight.plans.agent import Agents
    from mosslight.sources.catalog import Catalog

    catalog = Catalog(spark, str(tmp_path / "catalog"), "m")
    t = catalog.create("T")["id"]
    agents = Agents(spark, catalog, lambda _: [1.0, 0.0])
    assert agents.get(t) is None
    rows = spark.createDataFrame([("a", "x y", [1.0, 0.0])], "chunk_id string, content string, embedding array<double>")
    catalog.store.create(t, rows, "m")
    first = agents.get(t)
    statistics = first.bm25
    assert agents.get(t) is first and first.bm25 is statistics
    catalog.store.append(t, rows.withColumn("chunk_id", rows.content), "m")
    assert agents.get(t) is first and first.bm25 is not statistics and first.chunks.count() == 2
    catalog.delete(t)
    assert agents.get(t) is None and t not in agents.kept


def test_global_index_of_hashed_ids(spark):
    from pyspark.sql import functions as F

    from mosslight.operators.chunking import global_index

    rows = spark.range(3000).select(F.xxhash64("id").alias("doc_id")).withColumn("chunk_index", F.explode(F.array(F.lit(0), F.lit(1))))
    got = [(r.doc_id, r.chunk_index) for r in global_index(rows).orderBy("global_index").collect()]
    assert got == sorted(got) and len(got) == 6000
    assert global_index(rows.limit(0)).count() == 0


def test_model_path(spark, tmp_path, monkeypatch):
    (tmp_path / "m").mkdir()
    monkeypatch.setenv("HOME", str(tmp_path))
    own = str(tmp_path / "m")
    assert resolve_model_path(spark, "~/m") == resolve_model_path(spark, own) == resolve_model_path(spark, "./m", str(tmp_path)) == own
    assert resolve_model_path(spark, "~") == str(tmp_path) and resolve_model_path(spark, f"file://{own}") == f"file://{own}"
    assert resolve_model_path(spark, " ") is None and resolve_model_path(spark, None) is None
    monkeypatch.chdir(tmp_path)
    assert resolve_model_path(spark, "m") == own
    for gone in ("~x", "none", "/no/such"):
        with pytest.raises(ValueError, match="does not exist"):
            resolve_model_path(spark, gone)


def test_average_score(spark):
    rows = spark.createDataFrame([(1, 0.5), (1, 1.0), (2, None)], "g int, score double")
    assert average_score(rows).first().avg_score == 0.75 and average_score(rows.limit(0)).first().avg_score == 0.0
    assert {r.g: r.avg_score for r in average_score(rows, "g").collect()} == {1: 0.75, 2: 0.0}
