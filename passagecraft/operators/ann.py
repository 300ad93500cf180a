"""Approximate nearest neighbours by inverted lists, beside the exact search.

Centroids are fitted on a bounded sample; every row of the index goes to the list of its nearest centroid, and lists are
partitions of a table. A question looks into the lists of its nearest centroids only: which ones is known before the table
is read, so the files of the others are never opened. A list that holds many rows, such as copies, is many files, and its
rows are scored where they lie by as many tasks. Recall grows with the lists that a question probes; with all of them the
result is the exact one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .retrieval import QUESTION_BLOCK, best_of, top_of
from .storage import kept

#: Vectors that centroids are fitted on at most, whatever the size of the index; rounds of fitting.
MAX_SAMPLE, ROUNDS = 20_000, 8
#: Lists at most, so that centroids stay small; rows of a file of a list, about.
MAX_LISTS, FILE_ROWS = 4096, 200_000
#: How many lists a question probes is chosen on the sample: so many that TRIALS of its rows find this share of their NEIGHBOURS nearest.
RECALL, TRIALS, NEIGHBOURS = 0.95, 256, 20


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _matrix(vectors: pa.Array) -> np.ndarray:
    return np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), -1)


def fit(index: DataFrame, lists: int, sample: int = MAX_SAMPLE, recall: float = RECALL) -> tuple[np.ndarray, int]:
    """(unit centroids, ``lists`` at most, probes) for index(chunk_id, vector), by spherical k-means on the ``sample`` rows with the least hashes of their ids.

    The sample is the same in every run; equal vectors are one of it, so copies make no lists of their own. ``probes`` is
    the number of lists that gives the recall within the sample; vectors that have no groups need most of the lists.
    """
    some = index.select(F.xxhash64("chunk_id").alias("h"), F.col("vector").cast("array<double>").alias("vector"))
    v = some.orderBy("h", "vector").limit(sample).toArrow().column("vector").combine_chunks()
    if not len(v):
        return np.zeros((0, 0)), 1
    x = np.unique(_unit(_matrix(v)), axis=0)
    rnd = np.random.default_rng(len(x))
    centers = x[rnd.permutation(len(x))[:lists]]
    for _ in range(ROUNDS):
        near = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        centers = _unit(np.where((np.bincount(near, minlength=len(centers)) > 0)[:, None], sums, centers))
    asked = x[rnd.permutation(len(x))[:TRIALS]]
    best = np.argsort(-(asked @ x.T), axis=1)[:, :NEIGHBOURS]
    place = np.argsort(np.argsort(-(asked @ centers.T), axis=1), axis=1)
    at = np.sort(np.take_along_axis(place, (x @ centers.T).argmax(1)[best], 1).ravel())
    return centers, int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def nearest_lists(centers: np.ndarray, probes: int):
    """A column function: the numbers of a vector's nearest centroids, nearest first, ties to the smaller number."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(vectors: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in vectors:
            near = np.argsort(-np.round(_unit(_matrix(part)) @ centers.T, 9), axis=1, kind="stable")[:, :probes] if len(part) else np.zeros((0, 0), int)
            yield pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))

    return run


class Inverted:
    """An index by lists: a table at ``path`` with a folder for each, and the centroids."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.rows = spark.read.schema(spark.read.parquet(f"{path}/rows").schema).parquet(f"{path}/rows")
        found = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()  # MAX_LISTS rows at most
        self.centers = _matrix(found.column("center").combine_chunks()) if len(found) else np.zeros((0, 0))
        self.probes = found.column("probes")[0].as_py() if len(found) else 1

    def search(self, questions: DataFrame, k: int, probes: int | None = None, block: int = QUESTION_BLOCK) -> DataFrame:
        """question_id, chunk_id, cosine, cosine_rank: of questions(question_id, vector) the k nearest rows of the lists they probe.

        Without ``probes`` they are as many as the fitting chose. Ties go to the smaller chunk_id. Questions without a vector, or of another length, get no rows. Questions go in
        blocks, each of which reads the lists it probes; what a block finds is written and the block is forgotten.
        """
        kinds = f"question_id {questions.schema['question_id'].dataType.simpleString()}, chunk_id {self.rows.schema['chunk_id'].dataType.simpleString()}, raw double"
        width = self.centers.shape[1] if len(self.centers) else -1
        asks = questions.where(F.size("vector") == width).select("question_id", F.col("vector").cast("array<double>").alias("vector"))
        blocks = -(-asks.count() // block)
        found = None
        for b in range(blocks):
            own = asks.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b) if blocks > 1 else asks
            part = self._block(own, k, probes or self.probes, kinds)
            if part is not None:
                part = kept(top_of(part, k), "ann-hits") if blocks > 1 else top_of(part, k)
                found = part if found is None else found.unionByName(part)
        if found is None:
            return self.spark.createDataFrame([], kinds.replace("raw", "cosine") + ", cosine_rank int")
        return found

    def _block(self, asks: DataFrame, k: int, probes: int, kinds: str) -> DataFrame | None:
        own = asks.toArrow()  # a block of questions
        if not len(own):
            return None
        v = _unit(_matrix(own.column("vector").combine_chunks()))
        near = np.argsort(-np.round(v @ self.centers.T, 9), axis=1, kind="stable")[:, :probes]
        wanted = np.unique(near)
        of_list = {int(c): np.flatnonzero((near == c).any(1)) for c in wanted}
        rows = self.rows.where(F.col("list").isin([int(c) for c in wanted])).select("chunk_id", "vector", "list")
        return rows.mapInArrow(_scorer(np.array(own.column("question_id").to_pylist()), v, of_list, k, to_arrow_type(self.rows.schema["chunk_id"].dataType)), kinds)


def _scorer(asks: np.ndarray, questions: np.ndarray, of_list: dict[int, np.ndarray], k: int, kind: pa.DataType):
    """Rows of a list against the questions that probe it; k rows a question and task leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lists = np.asarray(batch.column(2))
            for c in np.unique(lists):
                part = batch.filter(pa.array(lists == c))
                ids, v = np.array(part.column(0).to_pylist()), _unit(_matrix(part.column(1)))
                for q in of_list[int(c)]:
                    scores = v @ questions[q]
                    old = best.get(q)
                    new = (ids, scores) if old is None else (np.concatenate([old[0], ids]), np.concatenate([old[1], scores]))
                    best[q] = tuple(x[:, 0] for x in best_of(new[0][:, None], new[1][:, None], k))
        for q, (ids, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(asks[np.full(len(ids), q)]), pa.array(ids.tolist(), kind), pa.array(scores)], ["question_id", "chunk_id", "raw"])

    return run


def build(index: DataFrame, path: str, lists: int | None = None, sample: int = MAX_SAMPLE, file_rows: int = FILE_ROWS, recall: float = RECALL) -> Inverted:
    """Writes index(chunk_id, vector, ...) by lists to ``path``, which must be new; every row with a vector of the usual length is there once.

    Without ``lists`` there are about as many as the square root of the rows, MAX_LISTS at most. Rows of a list are dealt
    over tasks by a hash, as many as its number of rows asks for, and no file has more than ``file_rows``.
    """
    spark = index.sparkSession
    usual = index.where(F.size("vector") > 0).groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "n").first()
    width, n = (usual["n"], usual["k"]) if usual else (0, 0)
    rows = index.where(F.size("vector") == width) if width else index.limit(0)
    centers, probes = fit(rows, min(MAX_LISTS, lists or max(1, round(n**0.5))), sample, recall)
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centers)], "list int, center array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")
    if not len(centers):
        index.withColumn("list", F.lit(0)).limit(0).write.parquet(f"{path}/rows")  # no folders, but a schema
        return Inverted(spark, path)
    placed = kept(rows.withColumn("list", nearest_lists(centers, 1)(F.col("vector").cast("array<double>"))[0]), "ann-placed")
    files = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / file_rows).cast("int").alias("files"))  # one row a list
    salted = placed.join(F.broadcast(files), "list").withColumn("salt", F.pmod(F.xxhash64("chunk_id"), F.col("files")))
    salted.repartition("list", "salt").drop("files", "salt").write.option("maxRecordsPerFile", file_rows).partitionBy("list").parquet(f"{path}/rows")
    return Inverted(spark, path)
