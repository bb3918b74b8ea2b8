"""Ingest: load, split, embed and store, with progress reports and counts.

What a topic holds is compared with what is loaded by content: new documents are added, changed ones take
the place of what they were, unchanged ones stay as they are, and with `sync` documents go whose files are gone.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkOptions
from ..functions import text as X
from ..operators.chunking import chunk_documents
from ..sources.catalog import Catalog
from ..sources.readers import load_documents, path_exists, plain_path

#: Failures of single files that a report names.
MAX_FAILURES = 1_000
STAGES = ("loading", "chunking", "embedding", "storing", "complete")


@dataclass
class IngestResult:
    success: bool
    documents: int = 0
    chunks: int = 0
    characters: int = 0
    mean_chunk: float = 0.0
    seconds: dict[str, float] = field(default_factory=dict)
    failures: list[tuple[str, str]] = field(default_factory=list)
    #: documents by what became of them: new, changed, unchanged, removed
    changes: dict[str, int] = field(default_factory=dict)


def content_hash(content: Column) -> Column:
    return F.md5(F.coalesce(content, F.lit("")))


def document_type(file_path: Column) -> Column:
    ext = F.regexp_replace(X.extension(file_path), "^\\.", "")
    return F.when(ext == "pdf", "pdf").when(ext.isin("html", "htm"), "html").otherwise("markdown")


def changes(known: DataFrame, loaded: DataFrame, below: list[str] | None = None) -> DataFrame:
    """(doc_id, change) of known(doc_id, file_path, content_hash) and loaded(doc_id, file_path, content_hash).

    `below` names the folders that were loaded whole: a known file below one of them that wasn't loaded is removed.
    """
    a = known.select("doc_id", F.col("content_hash").alias("_was"), plain_path(F.col("file_path")).alias("_path"), F.lit(True).alias("_known"))
    both = loaded.select("doc_id", "content_hash", F.lit(True).alias("_loaded")).join(a, "doc_id", "full_outer")
    under = F.lit(False)
    for folder in below or []:
        under = under | F.startswith(F.col("_path"), F.lit(folder.rstrip("/") + "/"))
    change = F.when(F.col("_known").isNull(), "new").when(F.col("_loaded").isNull(), F.when(under, "removed"))
    return both.select("doc_id", change.when(F.col("content_hash").eqNullSafe(F.col("_was")), "unchanged").otherwise("changed").alias("change")).where("change is not null")


def ingest(spark: SparkSession, catalog: Catalog, topic_id: str, paths: list[str], embedder, *, options: ChunkOptions | None = None, on_progress: Callable[[str, int, str], None] | None = None, compat_count: bool = False, sync: bool = False, **load) -> IngestResult:
    """One load for all paths. `sync` removes documents whose files below a given folder are gone; `compat_count` counts a call as one document, whatever it holds.

    Readers of the topic see all changes at once. Only documents that are new or changed are split and embedded.
    """
    report = on_progress or (lambda *_: None)
    result, began = IngestResult(False), time.time()
    report("loading", 0, "reading documents")
    try:
        docs, result.failures = load_documents(spark, paths, **load)
    except ValueError as e:
        result.failures = [("", str(e))]
        return result
    folders = [plain_of(spark, p) for p in paths if path_exists(spark, p)[1]] if sync else None
    result.seconds["loading"] = time.time() - began
    again = lambda ids: load_documents(spark, paths, only=ids, **load)[0]
    done = ingest_documents(spark, catalog, topic_id, docs, embedder, options=options, on_progress=report, folders=folders, result=result, again=again)
    if compat_count:
        done.documents = 1
    return done


def ingest_documents(spark: SparkSession, catalog: Catalog, topic_id: str, docs: DataFrame, embedder, *, options: ChunkOptions | None = None, on_progress: Callable[[str, int, str], None] | None = None, folders: list[str] | None = None, result: IngestResult | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> IngestResult:
    """Documents (doc_id, file_path, file_name, content, ...) that are loaded already; `folders` are those that they are all of.

    `again` loads those of ids(doc_id) once more, without the others; documents without it are joined with the ids.
    """
    report, result, began = on_progress or (lambda *_: None), result or IngestResult(False), time.time()
    scratch = f"{catalog.root}/staging/{uuid.uuid4().hex}"
    docs = docs.withColumn("content_hash", content_hash(F.col("content")))
    failed = F.col("load_error").isNotNull() if "load_error" in docs.columns else F.lit(False)
    error = F.col("load_error") if "load_error" in docs.columns else F.lit(None).cast("string")
    docs.select("doc_id", "file_path", "content_hash", error.alias("load_error"), failed.alias("failed")).write.parquet(f"{scratch}/loaded")
    loaded = spark.read.parquet(f"{scratch}/loaded")
    result.failures += [tuple(r) for r in loaded.where("failed").select("file_path", "load_error").limit(MAX_FAILURES).collect()]
    # a file that can't be read just now keeps what is stored of it
    known = catalog.documents(topic_id).where("doc_id is not null")
    held = known.join(loaded.where("failed").select("doc_id"), "doc_id", "left_anti")
    # pages of one file share its doc_id
    one = loaded.where("not failed").groupBy("doc_id").agg(F.first("file_path").alias("file_path"), F.md5(F.array_join(F.sort_array(F.collect_list("content_hash")), "")).alias("content_hash"))
    changes(held, one, folders).write.parquet(f"{scratch}/changes")
    change = spark.read.parquet(f"{scratch}/changes")
    result.seconds["loading"] = result.seconds.get("loading", 0.0) + time.time() - began
    report("chunking", 25, "splitting")
    result.changes = {r.change: r["count"] for r in change.groupBy("change").count().collect()}
    if result.changes.keys() <= {"unchanged"} and catalog.store.open(topic_id) is not None:
        catalog.store.check_model(topic_id, embedder.name)
        report("embedding", 50, "nothing is new")
        result.seconds["storing"] = 0.0
    else:
        ids = change.where("change in ('new', 'changed')").select("doc_id")
        fresh = docs.join(ids, "doc_id", "left_semi").where(~failed) if again is None else again(ids)
        if "load_error" in fresh.columns:
            # one that could be read before and can't now ends the load: nothing is stored
            fresh = fresh.withColumn("content", F.when(F.col("load_error").isNotNull(), F.raise_error(F.concat_ws(": ", "file_path", "load_error"))).otherwise(F.col("content")))
        chunks = embedder.embed_documents(chunk_documents(fresh.drop("load_error", "content_hash"), options))
        report("embedding", 50, "embedding and writing")
        began = time.time()
        gone = change.where("change in ('changed', 'removed')").select("doc_id")
        # splitting and embedding run once, as the chunks are stored; what is counted is counted there
        written = catalog.store.replace(topic_id, chunks, embedder.name, gone=gone, touched=ids)
        per = written.join(ids, "doc_id", "left_semi").groupBy("doc_id", "file_path", "file_name").agg(F.count("*").alias("chunk_count"), F.sum("chunk_size").cast("long").alias("characters"))
        rows = per.join(one.select("doc_id", "content_hash"), "doc_id").select("doc_id", F.col("file_name").alias("name"), "file_path", document_type(F.col("file_path")).alias("file_type"), "chunk_count", "characters", "content_hash")
        # what was there and has no chunk now
        empty = known.join(gone, "doc_id", "left_semi").join(per.select("doc_id"), "doc_id", "left_anti").select("file_path")
        catalog.record_documents(topic_id, rows, empty)
        result.seconds["storing"] = time.time() - began
    total = catalog.documents(topic_id).join(one.select("doc_id"), "doc_id", "left_semi").agg(F.count("*").alias("n"), F.sum("chunk_count").alias("chunks"), F.sum("characters").alias("characters")).first()
    catalog.files.remove(scratch)
    result.documents, result.chunks, result.characters = total.n, total.chunks or 0, total.characters or 0
    result.mean_chunk = result.characters / result.chunks if result.chunks else 0.0
    result.success = True
    report("complete", 100, f"{result.documents} documents, {result.chunks} chunks")
    return result


def ingest_document(spark: SparkSession, catalog: Catalog, topic_id: str, path: str, embedder, **options) -> IngestResult:
    """One document: ingest() for a single path."""
    return ingest(spark, catalog, topic_id, [path], embedder, **options)


def plain_of(spark: SparkSession, path: str) -> str:
    """A path as plain_path() shows those of its files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return full[len("file:") :] if full.startswith("file:") else full


def counted(docs: DataFrame, content: str = "content") -> DataFrame:
    """(documents, characters) of a load."""
    return docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length(content)), F.lit(0)).alias("characters"))
