"""From raw documents to a token store, in five stages.

1. language_id: documents without a letter, and those whose two best languages lie too close
   together to tell, are rejected.
2. near_dedup: of each group of linked near duplicates (five-word shingles, similarity 0.8 or more)
   a document with the smallest doc_id stays.
3. decontaminate: documents that share a 10-word passage with a benchmark item go.
4. mix_sources: what stays is mixed to the sources' target weights; a document used twice is two rows,
   and every file holds its rows in the order of the mix.
5. token_store: the mix is encoded, written as a binary store and read back.

Every stage works on all that its predecessor kept. All but the last return the columns of documents,
as they came: other columns may have any name and type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosslight.llm import decontaminate, language_id, mixing, near_dedup, token_store
from mosslight.llm.scratch import drop, new_path, written


def _small_batches(spark: SparkSession) -> None:
    """The pipeline's own setting for its session: a stage's rows hold whole texts, which executor and Python worker both hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def _aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under column names that no operator uses, and these by the true ones: an operator's columns then replace none."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(c).alias(name) for name, c in names.items()))


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that can be told."""
    _small_batches(spark)
    plain, names = _aside(docs)
    model = language_id.train(plain, doc_id=names["doc_id"], text=names["text"], lang=names["lang"])
    found = language_id.identify(plain, model, text=names["text"])
    return _back(found.where((F.col("lang_pred") != language_id.UNDETERMINED) & ~F.col("ambiguous")), names)


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, one with the smallest doc_id.

    Rows that share a doc_id are documents of their own where their texts differ; of rows equal in
    both, one stays. Rows with a null doc_id stay.
    """
    _small_batches(spark)
    plain, names = _aside(docs)
    doc_id, text = names["doc_id"], names["text"]
    twice = written(plain.where(f"{doc_id} is not null").groupBy(doc_id).count().where("count > 1").select(doc_id), "twice")
    if twice.isEmpty():
        gone = near_dedup.near_duplicates(plain, doc_id=doc_id, text=text).where("not kept").select(F.col("doc_id").alias(doc_id))
        return _back(plain.join(gone.distinct(), doc_id, "left_anti"), names)
    # a name for each text of such a doc_id; other rows are named by their doc_id
    single = plain.join(twice, doc_id, "left_anti").withColumn("name", F.col(doc_id).cast("long"))
    several = plain.join(twice, doc_id, "left_semi").withColumn("name", F.xxhash64(F.col(doc_id), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    several = several.dropDuplicates(["name"])
    named = single.unionByName(several)
    groups = written(near_dedup.near_duplicates(named, doc_id="name", text=text).select("doc_id", "component_id").where("doc_id is not null"), "groups")
    order = groups.join(several.select(F.col("name").alias("doc_id"), F.col(doc_id).cast("long").alias("true_id")), "doc_id", "left")
    best = order.groupBy("component_id").agg(F.min(F.struct(F.coalesce("true_id", "doc_id").alias("a"), "doc_id"))["doc_id"].alias("name"))
    gone = groups.select(F.col("doc_id").alias("name")).join(best.select("name"), "name", "left_anti")
    return _back(named.join(gone, "name", "left_anti"), names)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents with a benchmark passage."""
    _small_batches(spark)
    plain, names = _aside(docs)
    hits = decontaminate.decontaminate(spark, plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), text=names["text"])
    return _back(hits.where("n_hit = 0"), names)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, as documents."""
    _small_batches(spark)
    return mixing.mix_documents(docs)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the store's files."""
    _small_batches(spark)
    path = new_path(spark, "tokens")
    token_store.write_store(docs, path)
    return token_store.read_store(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stage_language),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("mix_sources", stage_mix),
    ("token_store", stage_tokens),
]

#: The classifier of the first stage is fitted in floating point; SQL can't give the same rows. The tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
