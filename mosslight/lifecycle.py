"""Registered queries over topics, stores, files and the search tool: each runs the whole life of one on the fixture tables."""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ChunkOptions, SearchOptions, check_strategy, check_top_k
from .functions import text as X
from .operators import chunking as C
from .operators import retrieve as R
from .operators.embed import HashingEmbedder
from .plans import agent as A
from .plans import planner as P
from .plans.ingest import ingest, ingest_documents
from .queries import _A, _B, _FIXED, _KIND, _TURNS, CH, KEYWORDS, ORACLES, TEXT, _html_sql, _scratch, _stored, _turns, _windows, chunks, hybrid_sql, query, rnd, table, vector
from .sources import catalog as T
from .sources import readers as L
from .sources.store import ChunkStore, ModelMismatch

_SOURCES = "s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)"


def _refused(f, *args, error=T.TopicError, **named) -> bool:
    try:
        f(*args, **named)
    except error:
        return True
    return False


def _documents(spark: SparkSession, sf: str, topics: list[dict]) -> DataFrame:
    """Every document under the topic of its source."""
    names = spark.createDataFrame([(t["id"], t["name"]) for t in topics], "topic_id string, topic string")
    docs = table(spark, sf, "documents").join(names, F.col("source") == F.col("topic"))
    path = F.concat(F.lit("/docs/"), "doc_id", F.lit(".md"))
    return docs.select("topic_id", "doc_id", F.concat(F.lit("d"), "doc_id").alias("name"), path.alias("file_path"), F.lit("markdown").alias("file_type"), F.lit(2).alias("chunk_count"))


def _catalog(spark: SparkSession, sf: str) -> tuple[T.Catalog, list[dict]]:
    """A topic for each source, with its documents, written in one go."""
    catalog = T.Catalog(spark, _scratch(spark), "precomputed")
    names = [r.source for r in table(spark, sf, "documents").where("source is not null").select("source").distinct().orderBy("source").collect()]
    topics = [catalog.create(n, f"about {n}") for n in names]
    catalog.record(_documents(spark, sf, topics))
    return catalog, topics


@query(f"WITH {_SOURCES} SELECT CASE WHEN i = 0 THEN 'Renamed' ELSE source END AS name, CASE WHEN i = 0 THEN 'other' ELSE 'about ' || source END AS description, n AS document_count, 'local' AS source, true AS taken_refused, true AS blank_refused, true AS gone_refused FROM s WHERE i <> 1")
def topic_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Create, rename, delete; names are unique in whatever case; the index outlives the catalog object."""
    catalog, topics = _catalog(spark, sf)
    catalog.update(topics[0]["id"], "Renamed", "other")
    refused = [_refused(catalog.create, topics[-1]["name"].upper()), _refused(catalog.create, "  ")]
    catalog.delete(topics[1]["id"])
    refused.append(_refused(catalog.update, topics[1]["id"], "x"))
    again = T.Catalog(spark, catalog.root, "precomputed").tables()[0]
    return again.select("name", "description", "document_count", "source", *(F.lit(x).alias(c) for x, c in zip(refused, ("taken_refused", "blank_refused", "gone_refused"), strict=True)))


@query("SELECT source AS topic, 'd' || doc_id AS name, '/docs/' || doc_id || '.md' AS file_path, 'markdown' AS file_type, CAST(2 AS BIGINT) AS chunk_count FROM documents WHERE source IS NOT NULL")
def topic_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of all topics; a path that is recorded again is replaced, one that goes and comes back is there once."""
    catalog, topics = _catalog(spark, sf)
    first = catalog.documents(topics[0]["id"])
    catalog.record_documents(topics[0]["id"], first.withColumn("chunk_count", F.lit(7)))
    catalog.record_documents(topics[0]["id"], first.where("false"), gone=first.where("doc_id % 2 = 0"))
    catalog.record_documents(topics[0]["id"], _documents(spark, sf, topics[:1]).drop("topic_id"))
    t, d = catalog.tables()
    return d.join(t.select(F.col("id").alias("topic_id"), F.col("name").alias("topic")), "topic_id").select("topic", "name", "file_path", "file_type", "chunk_count")


@query(f"WITH {_SOURCES} SELECT source AS name, n AS document_count, n * 2 AS chunk_count, 'precomputed' AS embedding_model FROM s")
def topic_statistics(spark: SparkSession, sf: str) -> DataFrame:
    catalog, topics = _catalog(spark, sf)
    rows = [(t["name"], s["document_count"], s["chunk_count"], s["embedding_model"]) for t in topics if (s := catalog.stats(t["id"]))]
    return spark.createDataFrame(rows, "name string, document_count long, chunk_count long, embedding_model string")


@query(f"WITH {_SOURCES} SELECT source AS name, 'common' AS source, n AS documents, true AS read_only, true AS clash_refused FROM s UNION ALL SELECT 'Own', 'local', 0, false, true")
def shared_topics(spark: SparkSession, sf: str) -> DataFrame:
    """A shared read-only set beside local topics; a clash of names refuses it whole."""
    common, topics = _catalog(spark, sf)
    local = T.Catalog(spark, _scratch(spark), "precomputed", common_root=common.root)
    local.create("Own")
    other = T.Catalog(spark, _scratch(spark), "precomputed")
    other.create(topics[0]["name"].upper())
    clash = _refused(other.load_common, common.root)
    count = {r.topic_id: r["count"] for r in local.tables()[1].groupBy("topic_id").count().collect()}
    rows = [(t["name"], t["source"], count.get(t["id"], 0), _refused(local.update, t["id"], description="x") and local.is_common(t["id"]), clash) for t in local.all()]
    return spark.createDataFrame(rows, "name string, source string, documents long, read_only boolean, clash_refused boolean")


@query("SELECT DISTINCT upper(source) AS requested, source AS name, 'exact' AS matched FROM documents WHERE source IS NOT NULL")
def topic_resolution(spark: SparkSession, sf: str) -> DataFrame:
    """Every source's topic, asked for in other case."""
    catalog, topics = _catalog(spark, sf)
    rows = [(x["name"].upper(), t["name"], how) for x in topics for t, how in [A.best_topic(catalog, x["name"].upper(), HashingEmbedder(16).embed_query)]]
    return spark.createDataFrame(rows, "requested string, name string, matched string")


@query(f"WITH {CH} SELECT chunk_id, content, lang, source, CAST(len(v) AS INTEGER) AS dims, round(list_sum(v), 6) AS total FROM ch")
def store_append(spark: SparkSession, sf: str) -> DataFrame:
    """A store made in two appends, opened anew."""
    store, rows = ChunkStore(spark, _scratch(spark)), chunks(spark, sf)
    store.append("t", rows.where("chunk_id % 2 = 0"), "precomputed")
    store.append("t", rows.where("chunk_id % 2 = 1"), "precomputed")
    return _stored(ChunkStore(spark, store.root).open("t"))


@query("SELECT 't1' AS topic_id, (SELECT count(*) FROM documents) AS document_count, (SELECT count(*) FROM embeddings) AS chunk_count, 'm1' AS embedding_model, true AS mismatch_refused, true AS gone")
def store_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata of topics; another model's vectors are refused; deleting twice is no error."""
    store, rows = ChunkStore(spark, _scratch(spark)), chunks(spark, sf).select("chunk_id", "content")
    for t, model in (("t1", "m1"), ("t2", "m2")):
        store.create(t, rows, model)
    store.save_metadata("t1", document_count=table(spark, sf, "documents").count(), chunk_count=table(spark, sf, "embeddings").count())
    refused = _refused(store.append, "t1", rows, "m2", error=ModelMismatch)
    for _ in range(2):
        store.delete("t2")
    return store.metadata_table().select("topic_id", "document_count", "chunk_count", "embedding_model", F.lit(refused).alias("mismatch_refused"), F.lit(store.open("t2") is None and store.list() == ["t1"]).alias("gone"))


# --- files ------------------------------------------------------------------------------------------


#: Folders that hold a file for each document: few to list, and of few files each.
FOLDERS = 64


def _put(base: str):
    """Each row a file named by its id, below the folder of its number; where ids are repeated rows come sorted, and a repeated id gets a number more."""

    def run(batches):
        last, nth, made = None, 0, set()
        for batch in batches:
            for folder, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = f"{base}/part={folder}"
                if folder not in made:
                    os.makedirs(own, exist_ok=True)
                    made.add(folder)
                nth = nth + 1 if (folder, doc_id) == last else 0
                last = (folder, doc_id)
                with open(f"{own}/doc_id={doc_id}{f'-{nth}' if nth else ''}.txt", "wb") as f:
                    f.write(text + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return run


def _folder(spark: SparkSession, sf: str) -> str:
    """Every document as a text file of its own, named by its id.

    In a shared folder that is mounted the tasks write the files: Hadoop's local file system starts a process for each
    file to set its rights. Into other stores Spark writes them, a folder for each.
    """
    path = f"{_scratch(spark)}/files"
    docs = table(spark, sf, "documents").where("text is not null").select(F.pmod(F.xxhash64("doc_id"), F.lit(FOLDERS)).alias("part"), "doc_id", "text")
    local = re.fullmatch("(?:file:(?://)?)?(/.*)", path)
    if local:
        # texts move only where an id is repeated, whose files are numbered
        if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
            docs = docs.repartition("part").sortWithinPartitions("part", "doc_id", "text")
        docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(_put(local[1]), "n long").agg(F.sum("n")).collect()
    else:
        docs.repartition("part").write.partitionBy("part", "doc_id").text(path)
    return path


def _file_id() -> Column:
    return F.regexp_extract("file_path", "doc_id=(-?[0-9]+)", 1).try_cast("long").alias("doc_id")


@query("SELECT doc_id, md5(text || chr(10)) AS content, CAST(strlen(text) + 1 AS BIGINT) AS file_size, kind AS file_type, kind = 'markdown' AS is_markdown, 'x' AS label, 1 AS failures FROM documents, (VALUES ('text'), ('markdown')) k(kind) WHERE text IS NOT NULL")
def load_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A folder's files, found recursively, as text and as Markdown; a path that isn't there fails by itself."""
    path, out = _folder(spark, sf), None
    for kind in (None, "markdown"):
        docs, failures = L.load_documents(spark, [path, f"{path}-missing"], file_type=kind, metadata={"label": "x"})
        marked = F.col("is_markdown") if kind else F.lit(False)
        own = docs.select(_file_id(), F.md5("content").alias("content"), "file_size", "file_type", marked.alias("is_markdown"), "label", F.lit(len(failures)).alias("failures"))
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS file_size FROM documents WHERE text IS NOT NULL")
def listed_files(spark: SparkSession, sf: str) -> DataFrame:
    return L.list_files(spark, _folder(spark, sf)).select(_file_id(), "file_size")


@query("SELECT doc_id, md5(text || chr(10)) AS content, 'b' AS branch FROM documents WHERE text IS NOT NULL AND NOT starts_with(CAST(doc_id AS VARCHAR), '1')")
def load_repository(spark: SparkSession, sf: str) -> DataFrame:
    """A checkout without its ignored paths."""
    docs, _ = L.load_documents(spark, [_folder(spark, sf)], file_type="github", ignore="doc_id=1*, **/_SUCCESS", branch="b")
    return docs.where("relative_path like 'part=%' and relative_path not like '%.crc'").select(_file_id(), F.md5("content").alias("content"), "branch")


@query("SELECT url AS file_path, CAST(strlen(html) AS BIGINT) AS file_size FROM pages WHERE NOT (contains(url, 'login') OR contains(url, 'signin') OR contains(url, 'auth') OR contains(html, 'type=\"password\"') OR contains(html, 'type=' || chr(39) || 'password' || chr(39)))")
def web_documents(spark: SparkSession, sf: str) -> DataFrame:
    return L.web_pages(table(spark, sf, "pages")).select("file_path", "file_size")


@query("SELECT count(*) AS documents, count(*) AS topic_documents, count(*) AS again, true AS success, 5 AS reports, 1 AS failures FROM documents WHERE regexp_matches(text, '\\S')")
def ingest_folder(spark: SparkSession, sf: str) -> DataFrame:
    """Load, split, embed and store a folder with a missing path beside it; a second run adds nothing."""
    catalog, e, seen = T.Catalog(spark, _scratch(spark), "hash"), HashingEmbedder(8), []
    topic, path = catalog.create("Folder"), _folder(spark, sf)
    r = ingest(spark, catalog, topic["id"], [path, f"{path}-missing"], e, options=ChunkOptions(strategy="recursive"), on_progress=lambda *x: seen.append(x))
    first = catalog.store.open(topic["id"]).count()
    ingest(spark, catalog, topic["id"], [path], e, options=ChunkOptions(strategy="recursive"))
    rows = catalog.store.open(topic["id"])
    same = rows.count() == first
    return spark.createDataFrame([(r.documents, catalog.stats(topic["id"])["document_count"], rows.select("doc_id").distinct().count() if same else -1, r.success, len(seen) + 1, len(r.failures))], "documents long, topic_documents long, again long, success boolean, reports int, failures int")


_PARTS = [("nav li > a", "(?s)<a [^>]*>(.*?)</a>"), ("div.ad, footer", "(?s)<div class=\"ad\">(.*?)</div>|<footer>(.*?)</footer>"), ("article > h1", "(?s)<h1>(.*?)</h1>"), ("html[lang=en] title", "(?s)<html lang=\"en\">.*?<title>(.*?)</title>")]


@query(" UNION ALL ".join(f"SELECT url AS file_path, '{css}' AS selector, {_html_sql(f'array_to_string(regexp_extract_all(html, {chr(39)}{pattern}{chr(39)}, 0), {chr(39)} {chr(39)})' if 'lang' not in pattern else f'regexp_extract(html, {chr(39)}{pattern}{chr(39)}, 1)')} AS content FROM pages WHERE NOT (contains(url, 'login') OR contains(url, 'signin') OR contains(url, 'auth') OR contains(html, 'type=\"password\"'))" for css, pattern in _PARTS))
def web_selectors(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that some selectors name in every page."""
    out = None
    for css, _ in _PARTS:
        own = L.web_pages(table(spark, sf, "pages"), selector=css).select("file_path", F.lit(css).alias("selector"), "content")
        out = own if out is None else out.unionByName(own)
    return out


_BODY = r"md5(regexp_replace({}, '\s', '', 'g'))"


@query("WITH a AS (SELECT doc_id, text FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' changed' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 1) " + f"SELECT doc_id, {_BODY.format('text')} AS body, 'after' AS seen, 1 AS documents FROM b WHERE regexp_matches(text, '\\S') UNION ALL SELECT doc_id, {_BODY.format('text')}, 'before', 1 FROM a WHERE regexp_matches(text, '\\S')")
def ingest_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A second load with new, changed, unchanged and missing documents: the topic is what was loaded last, and a reader from before still sees what was."""
    catalog, e = T.Catalog(spark, _scratch(spark), "hash"), HashingEmbedder(4)
    topic, docs = catalog.create("Changes"), table(spark, sf, "documents").where("text is not null")
    docs = docs.select("doc_id", F.concat(F.lit("/docs/"), "doc_id").alias("file_path"), F.concat(F.lit("d"), "doc_id").alias("file_name"), F.col("text").alias("content"))
    options = ChunkOptions(strategy="recursive", chunk_size=10_000_000)
    ingest_documents(spark, catalog, topic["id"], docs.where("doc_id % 5 <> 0"), e, options=options)
    before = catalog.store.open(topic["id"])
    later = docs.where("doc_id % 5 <> 1").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit(" changed"))).otherwise(F.col("content")))
    ingest_documents(spark, catalog, topic["id"], later, e, options=options, folders=["/docs"])
    after = catalog.store.open(topic["id"])
    # the log names each document once
    listed = catalog.documents(topic["id"]).groupBy("doc_id").agg(F.count("*").cast("int").alias("documents"))
    body = F.md5(F.regexp_replace("content", r"\s", "")).alias("body")
    now = after.select("doc_id", body, F.lit("after").alias("seen")).join(listed, "doc_id", "left")
    return now.unionByName(before.select("doc_id", body, F.lit("before").alias("seen"), F.lit(1).alias("documents")))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '\\S')")
def stream_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A folder followed by a stream; what it stored names every document once."""
    from .streaming.ingest import ingest_stream

    catalog, e = T.Catalog(spark, _scratch(spark), "hash"), HashingEmbedder(8)
    topic, path = catalog.create("Stream"), _folder(spark, sf)
    for k in (1, 2):  # the second stream starts anew and finds everything known
        ingest_stream(spark, catalog, topic["id"], path, e, f"{path}-checkpoint{k}").awaitTermination()
    first = catalog.store.open(topic["id"]).where("chunk_index = 0")
    return first.select(_file_id())


@query(ORACLES["chunk_fixed_window"])
def chunk_dump(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_scratch(spark)}/dump"
    C.dump_json(_windows(spark, sf), path)
    return spark.read.schema("doc_id long, chunk_index int, content string, chunk_size int").json(path)


# --- the search tool --------------------------------------------------------------------------------


@query(f"WITH {hybrid_sql(KEYWORDS, 5, 0.7, 0.3, 0.0, 20)} SELECT chunk_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, d, chunk_id) AS INTEGER) AS rank, 'hybrid' AS strategy FROM hy")
def agent_simple_query(spark: SparkSession, sf: str) -> DataFrame:
    agent = A.Agent(spark, chunks(spark, sf), lambda _: vector(spark, sf))
    return agent.simple_query(TEXT).select("chunk_id", rnd("score").alias("score"), "rank", "strategy")


def _tool(spark: SparkSession, sf: str, **options) -> dict:
    """What the search tool answers over a topic with all chunks."""
    catalog = T.Catalog(spark, _scratch(spark), "precomputed")
    topic = catalog.create("Documents")
    catalog.store.create(topic["id"], chunks(spark, sf), "precomputed")
    catalog.record_documents(topic["id"], [{"name": "documents", "file_path": "documents", "file_type": "markdown", "chunk_count": 1}])
    agents = A.Agents(spark, catalog, lambda _: vector(spark, sf))
    ask = lambda: json.loads(A.rag_query(spark, catalog, lambda _: vector(spark, sf), topic="DOCUMENTS", query=TEXT, agents=agents, **options))
    first, kept = ask(), agents.get(topic["id"])
    again = ask()
    return first | {"reused": agents.get(topic["id"]) is kept and again["results"] == first["results"]}


_TOOL = "SELECT content AS text, floor(score * 100 + 0.5) / 100 AS similarity, {mode} AS mode, 'exact' AS matched, {more} AS n, true AS reused FROM hy"


def _tool_rows(spark: SparkSession, out: dict, n: int) -> DataFrame:
    rows = [(r["text"], float(r["similarity"]), out["agenticMetadata"]["mode"], out["topicMatched"], n, out["reused"]) for r in out["results"]]
    return spark.createDataFrame(rows, "text string, similarity double, mode string, matched string, n int, reused boolean")


@query(f"WITH {hybrid_sql(KEYWORDS, 5, 0.7, 0.3, 0.0, 20)} " + _TOOL.format(mode="'simple'", more="0"))
def search_tool(spark: SparkSession, sf: str) -> DataFrame:
    """The tool's JSON answer; the topic's agent is kept from call to call."""
    return _tool_rows(spark, _tool(spark, sf), 0)


@query(f"WITH {hybrid_sql(KEYWORDS, 3, 0.7, 0.3, 0.0, 20)} " + _TOOL.format(mode="'agentic'", more="1"))
def search_tool_agentic(spark: SparkSession, sf: str) -> DataFrame:
    out = _tool(spark, sf, top_k=3, use_agentic_mode=True)
    return _tool_rows(spark, out, len(out["agenticMetadata"]["steps"]))


@query("SELECT DISTINCT CAST(turn * 5 - 4 AS BIGINT) AS k, turn * 5 - 4 BETWEEN 1 AND 20 AS accepted, true AS strategy_refused FROM conversations")
def tool_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of results, made from the numbers of turns."""
    refused = _refused(check_strategy, "other", error=ValueError)
    numbers = [r.k for r in table(spark, sf, "conversations").select((F.col("turn") * 5 - 4).alias("k")).distinct().collect()]
    return spark.createDataFrame([(k, not _refused(check_top_k, k, error=ValueError), refused) for k in numbers], "k long, accepted boolean, strategy_refused boolean")


def _answers() -> Column:
    """What a planner might say to a turn: plans in a fenced block, bare, with commas too many; what is no plan; nothing."""
    one, pair = F.struct(F.col("text").alias("query"), F.lit("low").alias("priority")), F.struct(F.lit("two").alias("query"), F.lit("high").alias("priority"))
    fenced = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.lit("moderate").alias("complexity"), F.lit("parallel").alias("strategy"), F.array(one, pair).alias("sub_queries"))), F.lit("\n```\nDone."))
    camel = F.concat(F.lit("Plan "), F.to_json(F.struct(F.lit("complex").alias("complexity"), F.lit("sequential").alias("strategy"), F.array(F.struct(F.col("text").alias("query"), F.lit(3).alias("topK"))).alias("subQueries"))))
    other = [F.lit('{"complexity": "simple", "strategy": "parallel", "sub_queries": [{"query": "fixed",},],}'), F.lit('{"complexity": "odd", "strategy": "parallel", "sub_queries": [{"query": "one"}]}'), F.lit('{"complexity": "simple", "strategy": "parallel", "sub_queries": [{"query": 7}]}'), F.lit("no plan at all"), F.lit(None).cast("string")]
    return F.element_at(F.array(fenced, camel, *other), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)) + 1).cast("int"))


@query(
    f"WITH {_TURNS}, k AS (SELECT *, ((conv_id + turn) % 7 + 7) % 7 AS n, {_KIND} AS kind FROM t), s AS (SELECT *, CASE kind WHEN 'complex/parallel' THEN {_A} WHEN 'moderate/parallel' THEN {_B} ELSE [text] END AS subs FROM k), f AS (SELECT *, CASE WHEN len(subs) = 0 THEN [text] ELSE subs END AS own FROM s) "
    "SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN n < 3 THEN 'llm' ELSE 'rules' END AS planned_by, CASE n WHEN 0 THEN 'moderate' WHEN 1 THEN 'complex' WHEN 2 THEN 'simple' ELSE split_part(kind, '/', 1) END AS complexity, "
    "CASE n WHEN 0 THEN 'low: ' || text || ' (5)|high: two (5)' WHEN 1 THEN 'high: ' || text || ' (3)' WHEN 2 THEN 'high: fixed (5)' ELSE array_to_string(list_transform(own, lambda q: CASE WHEN kind = 'moderate/parallel' THEN 'medium: ' ELSE 'high: ' END || q || ' (5)'), '|') END AS sub_queries FROM f"
)
def planner_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A planner's answers to all turns, in all their forms; one that doesn't fit falls back to the rules."""
    plan = _turns(spark, sf).select("conv_id", "turn", P.planned(F.col("text"), _answers()).alias("p"))
    shown = F.transform("p.sub_queries", lambda s: F.concat(s["priority"], F.lit(": "), s["query"], F.lit(" ("), s["top_k"].cast("string"), F.lit(")")))
    return plan.select("conv_id", "turn", "p.planned_by", "p.complexity", F.array_join(shown, "|").alias("sub_queries"))


@query("SELECT count(*) AS rows, 0 AS cached, true AS other_model_refused FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id")
def model_switch(spark: SparkSession, sf: str) -> DataFrame:
    """After a change of model, opened tables are dropped and another model's chunks are refused unless it is at hand."""
    catalog, dropped = T.Catalog(spark, _scratch(spark), "precomputed"), []
    topic = catalog.create("Documents")
    catalog.cleanup.append(dropped.append)
    catalog.store.create(topic["id"], chunks(spark, sf), "precomputed")
    catalog.chunks(topic["id"])
    catalog.use_model("other")
    cached = len(catalog.store._open)
    refused = _refused(catalog.chunks, topic["id"]) and dropped == [topic["id"]]
    rows = catalog.chunks(topic["id"], available_models=["precomputed"])
    return rows.agg(F.count("*").alias("rows"), F.lit(cached).alias("cached"), F.lit(refused).alias("other_model_refused"))


@query(f"WITH {hybrid_sql(KEYWORDS, 5, 0.7, 0.3, 0.0, 20)} SELECT chunk_id, round(ks, 6) AS keyword_score FROM hy")
def search_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """k = 0 stands for the default."""
    return R.hybrid_search(chunks(spark, sf), TEXT, vector(spark, sf), SearchOptions(k=0)).select("chunk_id", rnd("keyword_score").alias("keyword_score"))


@query("SELECT turn, role, length(text) > 1000 AS cut, CASE WHEN length(text) > 1000 THEN left(text, 1000) || chr(10) || '... (truncated)' ELSE text END AS excerpt FROM conversations")
def context_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("turn", "role", (F.length("text") > 1000).alias("cut"), X.select_excerpt(F.col("text")).alias("excerpt"))


@query(f"WITH {hybrid_sql(KEYWORDS, 5, 0.7, 0.3, 0.0, 20)} SELECT round(avg(score), 6) AS avg_score FROM hy")
def hybrid_average_score(spark: SparkSession, sf: str) -> DataFrame:
    return R.average_score(R.hybrid_search(chunks(spark, sf), TEXT, vector(spark, sf), SearchOptions())).select(rnd("avg_score").alias("avg_score"))


@query("SELECT source AS configured, source AS below, true AS missing_refused, true AS blank FROM documents WHERE source IS NOT NULL GROUP BY source")
def model_paths(spark: SparkSession, sf: str) -> DataFrame:
    """A model folder for each source, found by its relative path."""
    base = f"{_scratch(spark)}/models"
    names = table(spark, sf, "documents").where("source is not null").select("source").distinct()
    names.withColumn("model", F.col("source")).write.partitionBy("model").json(base)
    rows = []
    for r in names.collect():
        path = T.resolve_model_path(spark, f"model={r.source}", base)
        missing = _refused(T.resolve_model_path, spark, f"{r.source}-missing", base, error=ValueError)
        rows.append((r.source, path.rsplit("model=", 1)[1], missing, T.resolve_model_path(spark, " ") is None))
    return spark.createDataFrame(rows, "configured string, below string, missing_refused boolean, blank boolean")
