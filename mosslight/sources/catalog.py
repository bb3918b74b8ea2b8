"""Topics: named collections of documents, local ones and a shared read-only set; export and import."""

from __future__ import annotations

import io
import json
import os
import posixpath
import re
import uuid
import zipfile
import zlib
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .files import Files
from .snapshots import BucketTable, bucket_of
from .store import ChunkStore

VERSION = "1.0"
#: Columns of a topic's document. The log has `seq`, the number of the write, and `dropped` besides.
DOCUMENT = "id string, topic_id string, name string, file_path string, file_type string, added_at string, chunk_count long, doc_id long, content_hash string, characters long"
#: Folders of a bucket of the log beyond which it is written again.
FOLDERS = 16


def _now() -> str:
    return datetime.now(UTC).isoformat()


class TopicError(ValueError):
    """A topic operation that can't be done."""


class Catalog:
    """A topics index, the log of the topics' documents, and their chunk store.

    The index is one small file. Documents are a table: each change is a row of a log that only grows, the last
    write to a path counts, and the log is compacted when it has many pieces. No document passes the driver.
    """

    def __init__(self, spark: SparkSession, root: str, model: str, common_root: str | None = None):
        self.spark, self.root, self.model = spark, root.rstrip("/"), model
        self.files = Files(spark)
        self.files.make(self.root)
        self.store = ChunkStore(spark, f"{self.root}/store")
        self.cleanup: list = []
        self.log = self._log(self.root)
        self.common_root, self.common = common_root, {}
        self.refresh()
        if common_root:
            self.load_common(common_root)

    # index ---------------------------------------------------------------------------------

    def refresh(self) -> None:
        """Read the index again; an unreadable one counts as empty."""
        try:
            self.index = json.loads(self.files.read(f"{self.root}/topics.json") or "")
        except ValueError:
            self.index = {"topics": {}, "model_name": self.model, "last_updated": _now()}
            self._save()

    def _save(self) -> None:
        self.index["last_updated"] = _now()
        self.files.write(f"{self.root}/topics.json", json.dumps(self.index))

    def _log(self, root: str) -> BucketTable:
        return BucketTable(self.spark, f"{root.rstrip('/')}/documents", bucket_of("topic_id", 16), ("topic_id", "file_path"))

    def _check_name(self, name: str, own: str | None = None) -> None:
        if not name.strip():
            raise TopicError("a topic needs a name")
        if any(t["name"].lower() == name.lower() for k, t in {**self.common, **self.index["topics"]}.items() if k != own):
            raise TopicError(f"a topic named {name!r} exists")

    def create(self, name: str, description: str | None = None) -> dict:
        self._check_name(name)
        topic = {"id": f"topic-{uuid.uuid4().hex}", "name": name, "description": description, "created_at": _now(), "updated_at": _now(), "document_count": 0, "source": "local"}
        self.index["topics"][topic["id"]] = topic
        self._save()
        return topic

    def update(self, topic_id: str, name: str | None = None, description: str | None = None) -> dict:
        topic = self._local(topic_id)
        if name is not None:
            self._check_name(name, topic_id)
            topic["name"] = name
        if description is not None:
            topic["description"] = description
        topic["updated_at"] = _now()
        self._save()
        return topic

    def delete(self, topic_id: str) -> None:
        self._local(topic_id)
        self.store.delete(topic_id)
        # ids are never used again: rows of a topic that is gone are no one's, and compaction drops them
        del self.index["topics"][topic_id]
        self._save()
        for f in self.cleanup:
            f(topic_id)

    def _local(self, topic_id: str) -> dict:
        if topic_id in self.common:
            raise TopicError("shared topics are read-only")
        if topic_id not in self.index["topics"]:
            raise TopicError(f"no topic {topic_id!r}")
        return self.index["topics"][topic_id]

    def get(self, topic_id: str) -> dict | None:
        return self.index["topics"].get(topic_id) or self.common.get(topic_id)

    def all(self) -> list[dict]:
        return [*({**t, "source": "local"} for t in self.index["topics"].values()), *({**t, "source": "common"} for t in self.common.values())]

    def is_common(self, topic_id: str) -> bool:
        return topic_id in self.common

    def _current(self, log: BucketTable, topics: list[str], snapshot: dict | None = None) -> DataFrame:
        """The last write to each path of some topics."""
        empty = self.spark.createDataFrame([], DOCUMENT)
        snapshot = snapshot or log.snapshot()
        if not topics or not snapshot["version"]:
            return empty
        buckets = {zlib.crc32(t.encode()) % 16 for t in topics}
        last = Window.partitionBy("topic_id", "file_path").orderBy(F.col("seq").desc(), "id")
        rows = log.read(list(buckets), snapshot).where(F.col("topic_id").isin(topics)).withColumn("_nth", F.row_number().over(last))
        return rows.where("_nth = 1 and not dropped").select(*empty.columns)

    def documents(self, topic_id: str) -> DataFrame:
        """A topic's documents."""
        if self.is_common(topic_id):
            return self._current(self._log(self.common_root), [topic_id])
        return self._current(self.log, [topic_id] if topic_id in self.index["topics"] else [])

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """Topics and their documents as DataFrames."""
        fields = ("id", "name", "description", "created_at", "updated_at", "document_count", "source")
        topics = self.spark.createDataFrame([tuple(t.get(f) for f in fields) for t in self.all()], "id string, name string, description string, created_at string, updated_at string, document_count long, source string")
        documents = self._current(self.log, list(self.index["topics"]))
        if self.common:
            documents = documents.unionByName(self._current(self._log(self.common_root), list(self.common)))
        return topics, documents

    def record(self, rows: DataFrame, gone: DataFrame | None = None) -> None:
        """Write documents (topic_id, name, file_path, file_type, chunk_count; doc_id, content_hash if known) to the log, and drop gone(topic_id, file_path).

        A path that is there is replaced. Of the counts that follow, one row per topic reaches the driver.
        """
        seq, now = self.log.version() + 1, _now()
        columns = [f.split(" ") for f in DOCUMENT.split(", ")]
        name = F.concat(F.lit("doc-"), F.md5(F.concat_ws("|", "topic_id", "file_path", F.lit(f"{seq}"))))

        def event(own: DataFrame, dropped: bool) -> DataFrame:
            given = {"id": name, "added_at": F.lit(now)}
            out = own.select(*(given.get(c, F.col(c) if c in own.columns else F.lit(None)).cast(t).alias(c) for c, t in columns))
            return out.withColumn("seq", F.lit(seq).cast("long")).withColumn("dropped", F.lit(dropped))

        events = event(rows, False) if gone is None else event(rows, False).unionByName(event(gone, True))
        before = self.log.snapshot()
        snapshot = self.log.write(events)
        # from what was written: the documents are not made a second time
        touched = [r[0] for r in self.log.read(None, self.log.added(before, snapshot)).select("topic_id").distinct().collect()]
        if max(map(len, snapshot["folders"].values()), default=0) > FOLDERS:
            live = self._current(self.log, list(self.index["topics"]), snapshot)
            snapshot = self.log.write(live.withColumn("seq", F.lit(seq).cast("long")).withColumn("dropped", F.lit(False)), fresh=True)
        counts = {r.topic_id: r for r in self._current(self.log, touched, snapshot).groupBy("topic_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks")).collect()}
        for t in touched:
            topic, own = self._local(t), counts.get(t)
            topic["document_count"], topic["updated_at"] = (own.n if own else 0), now
            self.store.save_metadata(t, document_count=topic["document_count"], chunk_count=own.chunks if own else 0)
        self._save()

    def record_documents(self, topic_id: str, documents: DataFrame | list[dict], gone: DataFrame | None = None) -> None:
        """record() for one topic; a short list of rows will do as well."""
        self._local(topic_id)
        if isinstance(documents, list):
            fields = ("name", "file_path", "file_type", "chunk_count", "doc_id", "content_hash", "characters")
            documents = self.spark.createDataFrame([tuple(d.get(f) for f in fields) for d in documents], "name string, file_path string, file_type string, chunk_count long, doc_id long, content_hash string, characters long")
        own = lambda rows: None if rows is None else rows.withColumn("topic_id", F.lit(topic_id))
        self.record(own(documents), own(gone))

    def stats(self, topic_id: str) -> dict | None:
        topic = self.get(topic_id)
        if not topic:
            return None
        meta = self.store.metadata(topic_id) or {}
        return {"document_count": topic["document_count"], "chunk_count": meta.get("chunk_count", 0), "embedding_model": meta.get("embedding_model") or self.index["model_name"], "last_updated": topic["updated_at"]}

    def chunks(self, topic_id: str, available_models: list[str] | None = None) -> DataFrame | None:
        """A topic's chunks, if its model is the current one or available."""
        known = (self.store.metadata(topic_id) or {}).get("embedding_model")
        if known and known != self.model and known not in (available_models or []):
            raise TopicError(f"topic {topic_id} needs the model {known!r}")
        return self.store.open(topic_id) if not self.is_common(topic_id) else ChunkStore(self.spark, f"{self.common_root}/store").open(topic_id)

    def keyword_index(self, topic_id: str):
        """The keyword index of a topic, made if there is none that fits; of a shared topic only one that is there."""
        if self.is_common(topic_id):
            return ChunkStore(self.spark, f"{self.common_root}/store").index(topic_id)
        return self.store.index(topic_id, build=True)

    def use_model(self, model: str) -> None:
        """Go on with another model: caches are dropped, the index names it."""
        self.model = self.index["model_name"] = model
        self.store.dispose()
        for t in self.index["topics"]:
            for f in self.cleanup:
                f(t)
        self._save()

    # shared topics --------------------------------------------------------------------------

    def load_common(self, root: str) -> None:
        """Read a shared set; any name that a local topic has, in whatever case, refuses it whole."""
        text = self.files.read(f"{root.rstrip('/')}/topics.json")
        topics = json.loads(text)["topics"] if text else {}
        names = {t["name"].lower() for t in self.index["topics"].values()}
        clash = [t["name"] for t in topics.values() if t["name"].lower() in names]
        if clash:
            raise TopicError("shared topics clash with local ones: " + ", ".join(clash[:3]) + ("..." if len(clash) > 3 else ""))
        self.common, self.common_root = topics, root

    # archives -------------------------------------------------------------------------------

    def export_folder(self, topic_id: str, path: str) -> str:
        """A topic as a folder: documents and chunks in Parquet, written by the tasks, then topic.json. No row passes the driver."""
        topic, path = self._local(topic_id), path.rstrip("/")
        model = (self.store.metadata(topic_id) or {}).get("embedding_model") or self.index["model_name"]
        chunks = self.store.open(topic_id)
        self.documents(topic_id).write.parquet(f"{path}/documents")
        if chunks is not None:
            chunks.drop("topic_id").write.parquet(f"{path}/chunks")
        self.files.write(f"{path}/topic.json", json.dumps({"version": VERSION, "topic": topic, "chunks": chunks is not None, "embedding_model": model, "exported_at": _now()}))
        return path

    def import_folder(self, path: str) -> dict:
        """A topic from a folder that export_folder wrote, under a new id; a name that is taken gets the suffix (imported)."""
        text = self.files.read(f"{path.rstrip('/')}/topic.json")
        if text is None:
            raise TopicError("not a topic's folder: topic.json is missing")
        info = json.loads(text)
        topic = self._create_imported(info)
        if info["chunks"]:
            self.store.create(topic["id"], self.spark.read.parquet(f"{path.rstrip('/')}/chunks"), info["embedding_model"])
        self.record_documents(topic["id"], self.spark.read.schema(DOCUMENT).parquet(f"{path.rstrip('/')}/documents"))
        return topic

    def _create_imported(self, info: dict) -> dict:
        name = info["topic"]["name"]
        while any(t["name"].lower() == name.lower() for t in self.all()):
            name += " (imported)"
        return self.create(name, info["topic"].get("description"))

    def export(self, topic_id: str) -> bytes:
        """A topic as a ZIP archive: topic.json and its chunks as JSON lines, part by part. One file of the driver's; export_folder() is for large topics."""
        topic = self._local(topic_id)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
            model = (self.store.metadata(topic_id) or {}).get("embedding_model") or self.index["model_name"]
            z.writestr("topic.json", json.dumps({"version": VERSION, "topic": topic, "documents": [r.asDict() for r in self.documents(topic_id).toLocalIterator()], "embedding_model": model, "exported_at": _now()}))
            chunks = self.store.open(topic_id)
            if chunks is not None:
                z.writestr("schema.json", chunks.drop("topic_id").schema.json())
                with z.open("chunks.jsonl", "w") as f:
                    for row in chunks.drop("topic_id").select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
                        f.write(row.j.encode() + b"\n")
        return out.getvalue()

    def import_(self, data: bytes) -> dict:
        """A topic from an archive, under a new id; a name that is taken gets the suffix (imported)."""
        from pyspark.sql.types import StructType

        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n in z.namelist():
                if posixpath.isabs(n) or ".." in posixpath.normpath(n).split("/"):
                    raise TopicError(f"archive entry outside its folder: {n!r}")
            if "topic.json" not in z.namelist():
                raise TopicError("not a topic archive: topic.json is missing")
            info = json.loads(z.read("topic.json"))
            topic = self._create_imported(info)
            if "chunks.jsonl" in z.namelist():
                schema = StructType.fromJson(json.loads(z.read("schema.json")))
                self.files.write(f"{self.root}/import-{topic['id']}.jsonl", z.read("chunks.jsonl").decode())
                chunks = self.spark.read.schema(schema).json(f"{self.root}/import-{topic['id']}.jsonl")
                self.store.create(topic["id"], chunks, info["embedding_model"])
                self.files.remove(f"{self.root}/import-{topic['id']}.jsonl")
        self.record_documents(topic["id"], info["documents"])
        return topic


# matching of names, as tables ---------------------------------------------------------------


def folded(name: Column) -> Column:
    """A name that equals others in whatever case, of any script."""
    return F.collate(name, "UTF8_LCASE")


def in_order(name: Column) -> Column:
    """A name to sort by: accents and case after letters, as in the root locale of Unicode."""
    return F.collate(name, "UNICODE")


def exact_topic(topics: DataFrame, requested: DataFrame) -> DataFrame:
    """Requests with the topic of the same name, in whatever case."""
    return requested.join(topics, folded(requested["requested"]) == folded(topics["name"]), "left")


def name_conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Topics of a whose name b has."""
    return a.join(b.select(folded(F.col("name")).alias("_n")), folded(a["name"]) == F.col("_n"), "left_semi")


def most_similar_topic(topics: DataFrame, vector: list[float]) -> DataFrame:
    """(name, similarity) of the topic whose name's vector is nearest; there is no threshold."""
    from ..operators.knn import literal_distance

    sim = F.lit(1.0) - literal_distance(F.col("embedding"), vector, "cosine")
    return topics.agg(F.max_by("name", sim).alias("name"), F.max(sim).alias("similarity"))


def union_topics(local: DataFrame, common: DataFrame) -> DataFrame:
    return local.withColumn("source", F.lit("local")).unionByName(common.withColumn("source", F.lit("common")), allowMissingColumns=True)


def topic_stats(topics: DataFrame, documents: DataFrame, metadata: DataFrame) -> DataFrame:
    """Topics with counts of their documents and chunks; zeros where nothing is known."""
    per = documents.groupBy("topic_id").agg(F.count("*").alias("documents"))
    out = topics.join(per, topics["id"] == per["topic_id"], "left").drop("topic_id").join(metadata.withColumnRenamed("topic_id", "_t"), F.col("id") == F.col("_t"), "left").drop("_t")
    return out.withColumn("documents", F.coalesce("documents", F.lit(0))).withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def available_models(curated: DataFrame, local: DataFrame) -> DataFrame:
    """Curated models with whether they are downloaded, then local ones that aren't curated; `place` numbers each of both kinds by name."""
    have = local.select(F.col("name").alias("_n")).distinct().withColumn("downloaded", F.lit(True))
    a = curated.select("name").distinct().join(have, F.col("name") == F.col("_n"), "left").select("name", F.lit("curated").alias("source"), F.coalesce("downloaded", F.lit(False)).alias("downloaded"))
    b = local.select("name").distinct().join(curated, "name", "left_anti").select("name", F.lit("local").alias("source"), F.lit(True).alias("downloaded"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(in_order(F.col("name")), "name"))
    return a.unionByName(b).withColumn("place", place)


def discover_models(spark: SparkSession, root: str) -> list[str]:
    """Names of model folders below root: <model> or <owner>/<model>, known by a config or a model file."""
    files = Files(spark)
    marks = ("config.json", "model.onnx", "onnx/model.onnx")
    has = lambda path: any(files.exists(f"{path}/{m}") for m in marks)
    found = []
    for owner in files.folders(root):
        if has(f"{root}/{owner}"):
            found.append(owner)
        else:
            found += [f"{owner}/{model}" for model in files.folders(f"{root}/{owner}") if has(f"{root}/{owner}/{model}")]
    return sorted(found)


def resolve_model_path(spark: SparkSession, configured: str | None, base: str | None = None) -> str | None:
    """The folder that a setting names: ~ is the home folder, other relative paths lie below base (the working folder).

    None for a blank setting; a path that isn't there is an error. Paths with a scheme stay as they are.
    """
    given = (configured or "").strip()
    if not given:
        return None
    path = given
    if "://" not in given:
        path = os.path.join(base or os.getcwd(), os.path.expanduser(given) if re.match("~(/|$)", given) else given)
        path = path if "://" in path else os.path.normpath(path)
    if not Files(spark).exists(path):
        raise ValueError(f"model path {given!r} does not exist (resolved to {path!r})")
    return path
