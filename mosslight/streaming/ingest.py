"""Continuous ingest: new files of a folder become chunks of a topic, batch by batch, each exactly once.

The number of a stream's batch is part of the commit that stores it. A batch that ran before a failure,
stored but not noted in the checkpoint, comes again with the same number and adds nothing. Files that
the topic holds already are left out, so a stream that starts anew adds nothing either.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ChunkOptions
from ..functions import html as H
from ..functions import text as X
from ..functions import urls as U
from ..operators.chunking import chunk_documents
from ..plans.ingest import content_hash, document_type
from ..sources.catalog import Catalog
from ..sources.readers import files_below, in_tasks, is_mounted, opened, qualified

#: The source whose rows stand for looks at the folder: one for each batch.
LOOKS = "rate-micro-batch"


def look_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length) of all files of a folder, which is mounted wherever tasks run, at each look.

    A batch is a look: its tasks list the folder. What was seen before is not kept by the stream but told by the topic, so the
    driver holds no path.
    """
    full = qualified(spark, folder)
    if not is_mounted(full):
        raise ValueError(f"tasks can't list {full}")
    looks = spark.readStream.format(LOOKS).option("rowsPerBatch", 1).option("numPartitions", 1).load()
    return files_below(looks.select(F.lit(full).alias("path"))).where(X.extension(F.col("path")) != ".pdf")


def documents_of(files: DataFrame) -> DataFrame:
    """Documents of opened files: text, Markdown and HTML by their extensions, any other file as text. One that can't be read ends the batch."""
    ext = X.extension(F.col("path"))
    readable = F.when(F.col("load_error").isNotNull(), F.raise_error(F.concat_ws(": ", "path", "load_error")).cast("binary")).otherwise(F.col("content"))
    rows = files.where(ext != ".pdf").select(F.col("path").alias("file_path"), F.col("modificationTime").alias("modified"), F.col("length").alias("file_size"), F.decode(readable, "UTF-8").alias("raw"))
    kind = U.file_type(F.col("file_path"))
    rows = rows.withColumn("file_type", kind).withColumn("content", F.when(kind == "html", H.html_to_text(F.col("raw"))).otherwise(F.col("raw"))).drop("raw")
    return rows.withColumn("is_markdown", F.col("file_type") == "markdown").withColumn("file_name", X.base_name(F.col("file_path"))).withColumn("doc_id", F.xxhash64("file_path")).withColumn("content_hash", content_hash(F.col("content")))


def file_stream(spark: SparkSession, folder: str, *, within: str | None = None, **source) -> DataFrame:
    """Files of a folder as a stream of documents. On a mounted folder every look has all files, elsewhere Spark's own source tells new ones.

    `within` drops files whose content came before, under whatever name, as far as the watermark over
    their times of change reaches back: the state holds a hash for each.
    """
    if is_mounted(qualified(spark, folder)) and not source:
        raw = opened(look_stream(spark, folder))
    else:
        raw = spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("recursiveFileLookup", "true").options(**source).load(folder)
        raw = in_tasks(spark, raw).withColumn("load_error", F.lit(None).cast("string"))
    rows = documents_of(raw)
    return rows if within is None else rows.withWatermark("modified", within).dropDuplicatesWithinWatermark(["content_hash"])


def stream_name(checkpoint: str) -> str:
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()


def store_batch(catalog: Catalog, topic_id: str, embedder, options: ChunkOptions, stream: str, df: DataFrame, batch_id: int) -> None:
    """What foreachBatch runs, for documents or for files that are listed and not read yet; again for a batch that came to its end only in part."""
    known = catalog.documents(topic_id).select("doc_id")
    table = catalog.store._own(topic_id)
    if "doc_id" in df.columns:
        fresh = df.join(known, "doc_id", "left_anti")
    else:
        # files that the log names are not read; a look that finds no other has nothing to store
        files = df.join(known, F.xxhash64("path") == F.col("doc_id"), "left_anti")
        if table.version() and files.isEmpty():
            return
        fresh = documents_of(opened(files))
    fresh = fresh.drop("modified")
    if table.snapshot()["batches"].get(stream, -1) < batch_id:
        chunks = embedder.embed_documents(chunk_documents(fresh, options, strategy=options.strategy or "recursive"))
        stored = catalog.store.append(topic_id, chunks, embedder.name, batch=(stream, batch_id))
        if stored is None:
            return
    else:
        stored = catalog.store.open(topic_id)
    # the log follows what is stored, also where an earlier run stored a batch and no more
    stored = stored.join(known, "doc_id", "left_anti")
    per = stored.groupBy("doc_id", "file_path", "file_name", "content_hash").agg(F.count("*").alias("chunk_count"), F.sum("chunk_size").cast("long").alias("characters"))
    catalog.record_documents(topic_id, per.select("doc_id", F.col("file_name").alias("name"), "file_path", document_type(F.col("file_path")).alias("file_type"), "chunk_count", "characters", F.md5("content_hash").alias("content_hash")))


def ingest_stream(spark: SparkSession, catalog: Catalog, topic_id: str, folder: str, embedder, checkpoint: str, *, options: ChunkOptions | None = None, available_now: bool = True, within: str | None = None, **source) -> StreamingQuery:
    """Follow a folder of files. `available_now` stops after what is there; other options go to Spark's file source, which keeps the paths that it has seen in the driver."""
    options = options or ChunkOptions(strategy="recursive")
    name = stream_name(checkpoint)

    def batch(df: DataFrame, batch_id: int) -> None:
        store_batch(catalog, topic_id, embedder, options, name, df, batch_id)

    listed = within is None and not source and is_mounted(qualified(spark, folder))
    rows = look_stream(spark, folder) if listed else file_stream(spark, folder, within=within, **source)
    out = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out.trigger(processingTime="10 seconds")).start()
