"""The chunk store: a bucketed table per topic, with its metadata and keyword index beside it."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches
from .files import Files
from .snapshots import BucketTable, bucket_of

#: Metadata columns that the stored form of a chunk keeps.
STORED_METADATA = ["source", "file_name", "file_path", "file_type", "file_size", "loaded_at", "chunk_index", "total_chunks", "loc_lines_from", "loc_lines_to", "is_markdown", "preserve_structure"]


class ModelMismatch(ValueError):
    """A store's vectors were made by another model."""


def compat_stored_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks with the kept metadata columns only."""
    kept = ["chunk_id", "content", "embedding", *STORED_METADATA]
    return chunks.select(*[c for c in kept if c in chunks.columns])


#: Buckets of a topic's chunks; a changed document costs its bucket.
BUCKETS = 32


class ChunkStore:
    """Create, open, append, replace, delete; metadata is a JSON file per topic.

    A topic's chunks lie in buckets by doc_id (chunk_id where there is none) and are read by snapshot: who has
    opened a topic goes on with what it was, whatever is written meanwhile.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.files.make(self.root)
        self._open: dict[str, tuple[int, DataFrame]] = {}

    def _path(self, topic_id: str) -> str:
        if "/" in topic_id or topic_id.startswith("."):
            raise ValueError(f"not a topic id: {topic_id!r}")
        return f"{self.root}/topic_id={topic_id}"

    def _metadata_path(self, topic_id: str) -> str:
        return f"{self.root}/{topic_id}-metadata.json"

    def table(self, topic_id: str, key: str = "doc_id") -> BucketTable:
        return BucketTable(self.spark, self._path(topic_id), bucket_of(key, BUCKETS))

    def _own(self, topic_id: str) -> BucketTable:
        return self.table(topic_id, self.table(topic_id).snapshot()["stats"].get("key", "doc_id"))

    def list(self) -> list[str]:
        return [n.removeprefix("topic_id=") for n in self.files.folders(self.root) if n.startswith("topic_id=")]

    def create(self, topic_id: str, chunks: DataFrame, model: str) -> None:
        """Write a topic's chunks, in place of any there."""
        key = "doc_id" if "doc_id" in chunks.columns else "chunk_id"
        self.table(topic_id, key).write(chunks, fresh=True, stats={"key": key})
        self.save_metadata(topic_id, embedding_model=model)

    def append(self, topic_id: str, chunks: DataFrame, model: str, batch: tuple[str, int] | None = None) -> DataFrame | None:
        """Add chunks made with the store's own model; create the store if there is none. A stream's `batch` that is stored already adds nothing. Returns what replace() does."""
        return self.replace(topic_id, chunks, model, batch=batch)

    def replace(self, topic_id: str, chunks: DataFrame, model: str, gone: DataFrame | None = None, batch: tuple[str, int] | None = None, touched: DataFrame | None = None) -> DataFrame | None:
        """Drop the chunks of the documents gone(doc_id) and add others, in one step for readers. Only the buckets of those documents are written again.

        touched(doc_id) names the documents of the chunks, where they are known; chunks are made once. Returns the rows that
        were written, with those that were written again; None for a batch that was stored before.
        """
        table = self._own(topic_id)
        before = table.snapshot()
        if not before["version"]:
            table = self.table(topic_id, key := "doc_id" if "doc_id" in chunks.columns else "chunk_id")
            with small_batches(chunks.sparkSession):
                after = table.write(chunks, batch=batch, stats={"key": key})
            self.save_metadata(topic_id, embedding_model=model)
            return table.read(None, after)
        self.check_model(topic_id, model)
        key = before["stats"]["key"]
        with small_batches(chunks.sparkSession):
            after = table.write(chunks, gone=gone, on=key, batch=batch)
        index = self._index(topic_id)
        if after["version"] == before["version"]:
            return None
        if index.table.version():
            # the chunks that this write has added, and those that it has dropped, as they were
            self._follow(index, table, before, after, gone, key, touched if touched is not None else chunks.select(key).distinct())
        return table.read(None, table.added(before, after))

    def _follow(self, index, table: BucketTable, before: dict, after: dict, gone: DataFrame | None, key: str, touched: DataFrame) -> None:
        if index.table.snapshot()["stats"].get("of") != before["version"]:
            return
        added, removed = table.read(None, table.added(before, after)).join(touched, key, "left_semi").select("chunk_id", "content"), None
        if gone is not None:
            buckets = [r[0] for r in gone.select(table.bucket.alias("b")).distinct().collect()]
            removed = table.read(buckets, before).join(gone.select(key).distinct(), key, "left_semi").select("chunk_id", "content")
        index.update(added, removed)
        self._mark(index, after["version"])

    def _index(self, topic_id: str):
        from ..operators.keyword_index import KeywordIndex

        return KeywordIndex(self.spark, f"{self.root}/{topic_id}-index")

    @staticmethod
    def _mark(index, version: int) -> None:
        old = index.table.snapshot()
        index.table._commit(old, stats=old["stats"] | {"of": version})

    def index(self, topic_id: str, build: bool = False):
        """The topic's keyword index, kept from query to query; None if there is none that fits its chunks and none is to be built."""
        index, table = self._index(topic_id), self._own(topic_id)
        snapshot = table.snapshot()
        known = index.table.snapshot()
        if known["version"] and known["stats"].get("of") == snapshot["version"]:
            return index
        if not build or not snapshot["version"]:
            return None
        if known["version"]:
            self.files.remove(index.table.root)
        index.add(table.read(None, snapshot).select("chunk_id", "content"))
        self._mark(index, snapshot["version"])
        return index

    def check_model(self, topic_id: str, model: str) -> None:
        known = (self.metadata(topic_id) or {}).get("embedding_model")
        if known and known != model:
            raise ModelMismatch(f"topic {topic_id} holds vectors of {known!r}, not of {model!r}")

    def open(self, topic_id: str) -> DataFrame | None:
        """A topic's chunks as they are now, None if there are none."""
        table = self._own(topic_id)
        version = table.version()
        if not version:
            self._open.pop(topic_id, None)
            return None
        if self._open.get(topic_id, (0,))[0] != version:
            self._open[topic_id] = (version, table.read().withColumn("topic_id", F.lit(topic_id)))
        return self._open[topic_id][1]

    def delete(self, topic_id: str) -> None:
        """Remove a topic; a missing one is no error."""
        self._open.pop(topic_id, None)
        for path in (self._path(topic_id), self._metadata_path(topic_id), f"{self.root}/{topic_id}-index"):
            self.files.remove(path)

    def metadata(self, topic_id: str) -> dict | None:
        """A topic's metadata, None if missing or broken."""
        try:
            return json.loads(self.files.read(self._metadata_path(topic_id)) or "null")
        except ValueError:
            return None

    def save_metadata(self, topic_id: str, **values) -> dict:
        now = datetime.now(UTC).isoformat()
        known = self.metadata(topic_id) or {"topic_id": topic_id, "document_count": 0, "chunk_count": 0, "embedding_model": None, "created_at": now}
        known |= {k: v for k, v in values.items() if v is not None} | {"updated_at": now}
        self.files.write(self._metadata_path(topic_id), json.dumps(known))
        return known

    def metadata_table(self) -> DataFrame:
        """All metadata as a DataFrame."""
        rows = [m for t in self.list() if (m := self.metadata(t))]
        schema = "topic_id string, document_count long, chunk_count long, embedding_model string, created_at string, updated_at string"
        return self.spark.createDataFrame([tuple(m.get(c) for c in ("topic_id", "document_count", "chunk_count", "embedding_model", "created_at", "updated_at")) for m in rows], schema)

    def dispose(self) -> None:
        """Forget opened tables; nothing is cached with them."""
        self._open.clear()
