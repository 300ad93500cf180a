"""Stored chunks with vectors: one Parquet table, partitioned by corpus, model and chunk configuration."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagecraft.schema import ChunkConfig

from .embedding import Embedder, embed, hashed_words
from .storage import hadoop_path, store_of

PARTITIONS = ("corpus_id", "embed_model", "chunk_slug", "doc_type")


def build(chunks: DataFrame, model: str = "hashed-words", embedder: Embedder = hashed_words) -> DataFrame:
    """Chunks with their vectors."""
    return chunks.withColumns({"vector": embed(F.col("embed_text"), embedder), "embed_model": F.lit(model)}).drop("embed_text")


def write(index: DataFrame, path: str) -> None:
    """Replaces, as a whole, the collections that index has rows of, and no others.

    Rows are written beside the collections first. If a collection has two rows of one chunk_id, that is an error, and
    what was there before stays. Then the old collection is put aside and the new one takes its place, so documents that
    are no longer there are gone, as are values of doc_type that no document has any more. If that fails the old one comes
    back; if the driver is lost between the two, readers find it where it lies and the next writer brings it back. Readers
    who need the old rows after that take a store of versions.
    """
    spark = index.sparkSession
    store, root = store_of(spark, path)
    recover(spark, path)
    name = uuid.uuid4().hex
    staged, aside = f"{path}/_staged-{name}", f"{path}/_old-{name}"
    try:
        index.write.partitionBy(*PARTITIONS).parquet(staged)
        found = _collections(store, store_of(spark, staged)[1])
        again = duplicate_ids(_open(spark, staged)).limit(5).collect() if found else []
        if again:
            raise ValueError(f"chunks share an id: {', '.join(r['chunk_id'] for r in again)}")
        for new in found:
            parts = "/".join(str(new.toString()).split("/")[-3:])
            _replace(store, new, hadoop_path(spark, f"{root.toString()}/{parts}"), hadoop_path(spark, f"{aside}/{parts}"))
    finally:
        store.delete(store_of(spark, staged)[1], True)
    store.delete(store_of(spark, aside)[1], True)


def _replace(store, new, place, aside) -> None:
    """Puts a folder in place of another, which comes back if that fails."""
    held = store.exists(place)
    if held:
        store.mkdirs(aside.getParent())
        if not store.rename(place, aside):
            raise OSError(f"{place.toString()} can't be put aside")
    try:
        store.mkdirs(place.getParent())
        if not store.rename(new, place):
            raise OSError(f"{place.toString()} can't be put in place")
    except BaseException:
        if held and not store.exists(place):
            store.rename(aside, place)
        raise


def recover(spark: SparkSession, path: str) -> None:
    """Brings back collections that a writer had put aside when it was lost; those that were replaced go. Not while a writer is at work."""
    store, root = store_of(spark, path)
    for folder, aside, place in _put_aside(spark, store, root):
        if not store.exists(place):
            store.mkdirs(place.getParent())
            store.rename(aside, place)
    for s in store.listStatus(root) if store.exists(root) else []:
        if s.getPath().getName().startswith("_old-"):
            store.delete(s.getPath(), True)


def _collections(store, root) -> list:
    """The folders of the collections below a root: one level for each partition but doc_type."""
    found = [root]
    for name in PARTITIONS[:-1]:
        found = [s.getPath() for p in found for s in store.listStatus(p) if s.getPath().getName().startswith(f"{name}=")]
    return found


def _put_aside(spark: SparkSession, store, root) -> list[tuple]:
    """(folder put aside, collection in it, its place) for each collection that a lost writer has put aside."""
    folders = [s.getPath() for s in (store.listStatus(root) if store.exists(root) else []) if s.getPath().getName().startswith("_old-")]
    return [(f, c, hadoop_path(spark, "/".join([root.toString(), *str(c.toString()).split("/")[-3:]]))) for f in folders for c in _collections(store, f)]


def _open(spark: SparkSession, path: str) -> DataFrame:
    """The table, with its partition values as the strings that they are; a collection that a lost writer has put aside is read where it lies."""
    store, root = store_of(spark, path)
    lost = [(str(f.toString()), str(c.toString())) for f, c, place in _put_aside(spark, store, root) if not store.exists(place)]
    places = [(path, path)] if _collections(store, root) or not lost else []
    rows = None
    for base, folder in [*places, *lost]:
        found = spark.read.option("basePath", base).parquet(folder).schema
        kind = T.StructType([T.StructField(f.name, T.StringType()) if f.name in PARTITIONS else f for f in found])
        one = spark.read.option("basePath", base).schema(kind).parquet(folder)
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows


def read(spark: SparkSession, path: str, corpus_id: str, cfg: ChunkConfig, model: str = "hashed-words") -> DataFrame:
    """One collection; the filters are on partitions, so no file of another is opened."""
    return _open(spark, path).where((F.col("corpus_id") == corpus_id) & (F.col("embed_model") == model) & (F.col("chunk_slug") == cfg.slug))


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Collections and how many chunks and documents each has."""
    return counts(_open(spark, path))


def counts(index: DataFrame) -> DataFrame:
    return index.groupBy(*[c for c in PARTITIONS if c != "doc_type"]).agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("document_id").alias("n_documents"))


def duplicate_ids(index: DataFrame) -> DataFrame:
    """chunk_ids that are there more than once in a collection."""
    return index.groupBy(*[c for c in PARTITIONS if c != "doc_type"], "chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def drop_corpus(spark: SparkSession, path: str, corpus_id: str) -> bool:
    """Removes the collections of exactly this corpus; whether there were any."""
    from urllib.parse import quote

    store, root = store_of(spark, path)
    return store.delete(hadoop_path(spark, f"{root.toString()}/corpus_id={quote(corpus_id, safe=' -_.~')}"), True)
