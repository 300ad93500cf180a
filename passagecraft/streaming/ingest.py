"""Document files become chunks as they arrive: appended to a table, or as versions of a collection without doubles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passagecraft.operators import chunking, index, versions
from passagecraft.operators.embedding import Embedder, hashed_words
from passagecraft.schema import ChunkConfig
from passagecraft.sources import files

_FILES = "path string, modificationTime timestamp, length long, content binary"


def _found(spark: SparkSession, root: str, max_files: int) -> DataFrame:
    found = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(root)
    return found.where(files.document_format(F.col("path")).isin("markdown", "html"))


def _documents(found: DataFrame, corpus_id: str) -> DataFrame:
    parsed = found.select("path", files._parse(files.document_format(F.col("path")), F.col("content")).alias("p"))
    known = files.defaults(F.col("path"), F.col("p.meta"))
    return parsed.select(*(c.alias(k) for k, c in known.items()), F.col("p.text").alias("text"), F.lit(corpus_id).alias("corpus_id"))


def stream_chunks(spark: SparkSession, root: str, cfg: ChunkConfig = ChunkConfig(), corpus_id: str = "default", max_files: int = 1000) -> DataFrame:
    """A stream of the chunks of Markdown, text and HTML files below a folder."""
    return chunking.chunk(_documents(_found(spark, root, max_files), corpus_id), cfg)


def ingest(spark: SparkSession, root: str, out: str, checkpoint: str, cfg: ChunkConfig = ChunkConfig(), corpus_id: str = "default", embedder: Embedder = hashed_words) -> StreamingQuery:
    """Appends what is new to a table and ends; the checkpoint knows what has been read.

    A file that changes is read again, and its chunks stand there twice; upsert() replaces them. A store of collections
    that index.write() replaces as a whole is no place for this, and is refused.
    """
    store, p = index.store_of(spark, out)
    if store.exists(p) and index._collections(store, p) and not store.exists(index.hadoop_path(spark, f"{out}/_spark_metadata")):
        raise ValueError(f"{out} holds collections that are replaced as a whole")
    built = index.build(stream_chunks(spark, root, cfg, corpus_id), embedder=embedder)
    return built.writeStream.format("parquet").partitionBy(*index.PARTITIONS).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)


def upserted(store: str, made: Callable[[DataFrame], DataFrame], expire_after: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: files of a batch (key, modificationTime, content, ...) become a version of a store.

    The store's list of documents is the state, by key and digest of the content: a file that comes again as it was makes no
    version, so a batch that is run again after a failure changes nothing; one that changed replaces its rows, and of
    several deliveries in a batch the newest counts. With ``expire_after``, an interval such as ``30 days``, documents that
    have not come for so long are left out of the next version.
    """

    def run(batch: DataFrame, number: int) -> None:
        expire = F.current_timestamp() - F.expr(f"interval {expire_after}") if expire_after else None
        versions.commit(batch, store, made, F.sha2("content", 256), key="key", whole=False, expire_before=expire, newest=F.col("modificationTime"))

    return run


def upsert(
    spark: SparkSession, root: str, store: str, checkpoint: str, cfg: ChunkConfig = ChunkConfig(), corpus_id: str = "default", embedder: Embedder = hashed_words, expire_after: str | None = None, max_files: int = 1000
) -> StreamingQuery:
    """Takes what has come below a folder into a store of versions and ends; versions.read() gives the chunks with vectors.

    A document's key is its file name, so a new version of it may come in another folder. A file that is changed in place
    is not delivered again under the same checkpoint: that is how Spark's source of files works.
    """

    def made(found: DataFrame) -> DataFrame:
        return index.build(chunking.chunk(_documents(found, corpus_id), cfg), embedder=embedder).withColumn("key", F.col("filename"))

    keyed = _found(spark, root, max_files).withColumn("key", F.element_at(F.split("path", "/"), -1))
    return keyed.writeStream.foreachBatch(upserted(store, made, expire_after)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
