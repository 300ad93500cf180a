"""Questions against an index: filter, exact nearest neighbours, rerank, recency, limit and the gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from passagecraft.functions.text import half_even
from passagecraft.schema import RECENCY_BAND, RetrievalParams

from .embedding import BATCH, Embedder, Scorer, rerank_score, vectors
from .storage import kept

#: Questions that are sent to all executors at once, about.
QUESTION_BLOCK = 2048
#: Scores that are held at once.
_SCORES = 1 << 18

NO_MATCH = "Nothing in the index matched the filters."
REFUSED_COSINE = "Best vector similarity %.2f is below the threshold of %.2f: nothing in the documents is close to this question."
REFUSED_RERANK = "The best passage scores %.2f, below the threshold of %.2f: it is near the question but does not answer it."


def matches(params: RetrievalParams) -> Column:
    """The metadata filter; dates compare as ISO strings, and documents without one never pass a date filter."""
    out = F.lit(True)
    if params.doc_type and params.doc_type != "all":
        out = out & (F.col("doc_type") == params.doc_type)
    if params.effective_on_or_after:
        out = out & (F.col("effective_date") >= params.effective_on_or_after)
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each column the k highest scores (four digits count) and their ids; ties go to the smaller id."""
    order = np.lexsort((ids, -np.round(scores, 4)), axis=0)[:k]
    return np.take_along_axis(ids, order, 0), np.take_along_axis(scores, order, 0)


class _Best:
    """The k nearest of one group to each question so far: pairs by question, score (four digits count), then id."""

    def __init__(self, questions: int, k: int):
        self.k, self.worst = k, np.full(questions, -np.inf)
        self.at, self.ids, self.scores = np.zeros(0, np.int64), None, np.zeros(0)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Rows of ids with their scores for each question; pairs that reach no question's worst are of no use."""
        rounded = np.round(scores, 4)
        rounded[np.isnan(rounded)] = -np.inf
        least = self.worst
        if len(ids) > self.k and np.isneginf(least).any():  # nor are those behind k of these rows
            least = np.maximum(least, np.partition(rounded, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, at = np.nonzero(rounded >= least)
        self.more.append((at, ids[row], scores[row, at]))
        self.waiting += len(row)
        if self.waiting > max(len(self.at), _SCORES >> 3):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.more:
            held = [] if self.ids is None else [(self.at, self.ids, self.scores)]
            at, ids, scores = (np.concatenate(x) for x in zip(*held, *self.more, strict=True))
            order = np.lexsort((ids, -np.round(scores, 4), at))
            at = at[order]
            first = np.searchsorted(at, np.arange(len(self.worst)))
            nth = np.arange(len(at)) - first[at]
            order, at = order[nth < self.k], at[nth < self.k]
            self.at, self.ids, self.scores = at, ids[order], scores[order]
            last = np.flatnonzero(nth[nth < self.k] == self.k - 1)
            self.worst[at[last]] = np.nan_to_num(np.round(self.scores[last], 4), nan=-np.inf)
            self.more, self.waiting = [], 0
        return self.at, self.ids, self.scores


def _nearest_in_place(asks: np.ndarray, questions: np.ndarray, k: int, kind: pa.DataType, embedder: Embedder | None = None):
    """The k nearest rows of each group that a task has seen, for each question; with an embedder rows come as texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Best] = {}
        some = max(1, min(BATCH if embedder else _SCORES, _SCORES // max(1, len(asks))))
        for whole in batches:
            for at in range(0, len(whole), some):
                chunk = whole.slice(at, some)
                if embedder:
                    v = np.concatenate(list(vectors(chunk.column(1), embedder))).astype(np.float64)
                    if v.shape[1] != questions.shape[1]:
                        continue
                else:
                    v = np.asarray(chunk.column(1).flatten(), np.float64).reshape(len(chunk), -1)
                names = np.array(chunk.column(0).to_pylist())
                groups = np.array(chunk.column(2).to_pylist())
                scores = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) @ questions.T
                for group in np.unique(groups).tolist():
                    own = groups == group
                    held.setdefault(group, _Best(len(asks), k)).add(names[own], scores[own])
        for group, best in held.items():
            at, ids, scores = best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(asks[at]), pa.array(ids.tolist(), kind), pa.array(scores), pa.array([group] * len(at), pa.string())], ["question_id", "chunk_id", "raw", "group"])

    return run


def candidates(questions: DataFrame, index: DataFrame, k: int, block: int = QUESTION_BLOCK, by: str | None = None, embedder: Embedder | None = None) -> DataFrame:
    """question_id, chunk_id, cosine, cosine_rank: exactly the k nearest of index(chunk_id, vector) to each of questions(question_id, vector).

    Questions go in blocks by a hash of their id, so what is sent out has a bound whatever the number of questions; every
    block meets the index where it lies, and only k rows a question and task are shuffled. With several blocks, what one
    finds is written to the shared folder and the block is forgotten, so neither the driver nor the plan grows with the
    questions by more than a table's name for each block. Ties go to the smaller chunk_id. Rows without a vector take no
    part, nor do those of another length than most questions' vectors have.

    With ``by``, a string column of index with few values such as a configuration, the k nearest are found for each value,
    all in the same look at the index, and the result has that column, too.

    With ``embedder``, index has a column text in place of vector: texts become vectors where they are met, some at a time,
    and no vector leaves a worker. A null text is an empty one. With several blocks they are made for each.
    """
    spark = questions.sparkSession
    asks = questions.where(F.col("vector").isNotNull()).select("question_id", F.col("vector").cast("array<double>").alias("vector"))
    group = F.col(by) if by else F.lit("")
    group = F.coalesce(group, F.lit("")).alias("group")
    if embedder:
        rows = index.select("chunk_id", "text", group)
    else:
        rows = index.where(F.col("vector").isNotNull()).select("chunk_id", F.col("vector").cast("array<double>").alias("vector"), group)
    lengths = asks.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "n").first()
    width, n = lengths if lengths else (0, 0)
    asks = asks.where(F.size("vector") == width)
    rows = rows if embedder else rows.where(F.size("vector") == width)
    blocks = max(1, -(-n // block))
    kinds = f"question_id {questions.schema['question_id'].dataType.simpleString()}, chunk_id {index.schema['chunk_id'].dataType.simpleString()}, raw double, group string"
    named = lambda df: df.withColumnRenamed("group", by) if by else df.drop("group")
    found = None
    for b in range(blocks):
        own = (asks.where(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == b) if blocks > 1 else asks).toArrow()
        if not len(own):
            continue
        v = np.asarray(own.column("vector").combine_chunks().flatten(), np.float64).reshape(len(own), -1)
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        part = rows.mapInArrow(_nearest_in_place(np.array(own.column("question_id").to_pylist()), v, k, to_arrow_type(index.schema["chunk_id"].dataType), embedder), kinds)
        # the k best of a block: few rows are kept
        part = top_of(part, k, "group") if blocks == 1 else kept(top_of(part, k, "group"), "hits")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return named(spark.createDataFrame([], kinds.replace("raw double, group string", "group string, cosine double") + ", cosine_rank int"))
    return named(found)


def top_of(found: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best of found(question_id, chunk_id, raw) by rounded cosine, then chunk_id; for each value of ``by``."""
    scored = found.withColumn("cosine", half_even(F.col("raw"), 4))
    nth = F.row_number().over(W.partitionBy("question_id", *by).orderBy(F.desc("cosine"), "chunk_id"))
    return scored.withColumn("cosine_rank", nth).where(F.col("cosine_rank") <= k).drop("raw")


def recency_bucket(score: Column) -> Column:
    """Scores within about RECENCY_BAND share a bucket; half-way scores go to the even one."""
    return half_even(score / F.lit(RECENCY_BAND))


def order_of(params: RetrievalParams) -> list[Column]:
    """How hits are sorted: by bucket and date, by score, or by cosine alone; always down to cosine_rank, so it is total."""
    if params.rerank and params.prefer_recent:
        return [F.desc(recency_bucket(F.col("rerank_score"))), F.desc(F.coalesce("effective_date", F.lit(""))), F.asc("cosine_rank")]
    return [F.desc("rerank_score"), F.asc("cosine_rank")] if params.rerank else [F.asc("cosine_rank")]


def ranked(hits: DataFrame, params: RetrievalParams) -> DataFrame:
    """hits(question_id, cosine, cosine_rank, rerank_score, effective_date) with rank, best_cosine and n_candidates, the top k of each."""
    q = W.partitionBy("question_id")
    out = hits.withColumns({"best_cosine": F.max("cosine").over(q), "n_candidates": F.count(F.lit(1)).over(q).cast("int")})
    return out.withColumn("rank", F.row_number().over(q.orderBy(*order_of(params)))).where(F.col("rank") <= params.top_k).withColumn("score", F.coalesce("rerank_score", "cosine"))


def reason(n: Column, best_cosine: Column, best_rerank: Column, params: RetrievalParams) -> Column:
    """Why a question is refused, in the order the gates stand; empty if it is grounded. Bounds themselves pass."""
    out = F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(NO_MATCH)).when(best_cosine < params.cosine_gate, F.format_string(REFUSED_COSINE, best_cosine, F.lit(float(params.cosine_gate))))
    if params.rerank:
        out = out.when(best_rerank < params.rerank_gate, F.format_string(REFUSED_RERANK, best_rerank, F.lit(float(params.rerank_gate))))
    return out.otherwise(F.lit(""))


def decide(questions: DataFrame, hits: DataFrame, params: RetrievalParams, collection: str = "") -> DataFrame:
    """A row for every question, whether it has hits or not: grounded, reason and diagnostics."""
    per = hits.groupBy("question_id").agg(F.max("n_candidates").alias("n"), F.max("best_cosine").alias("c"), F.min_by("rerank_score", "rank").alias("r"))
    why = reason(F.col("n"), F.col("c"), F.col("r"), params)
    diagnostics = F.struct(F.coalesce("n", F.lit(0)).alias("candidates"), F.col("c").alias("best_cosine"), F.col("r").alias("best_rerank"), F.lit(params.rerank).alias("reranked"), F.lit(collection).alias("collection"))
    joined = questions.join(per, "question_id", "left").withColumn("reason", why).withColumn("diagnostics", diagnostics)
    return joined.withColumn("grounded", F.col("reason") == "").drop("n", "c", "r")


def retrieve(questions: DataFrame, index: DataFrame, params: RetrievalParams = RetrievalParams(), scorer: Scorer | None = None, collection: str = "", where: Column | str | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits, decisions) of questions(question_id, question, vector) on an index of chunks with vectors.

    ``where`` is any further condition on the index's columns; it holds before candidates are chosen, as the filters of ``params`` do.
    """
    some = index.where(matches(params))
    some = some.where(where) if where is not None else some
    near = candidates(questions, some, params.candidate_k)
    # text and metadata meet the few candidates only
    full = near.join(some.drop("vector"), "chunk_id").join(questions.select("question_id", "question"), "question_id")
    score = rerank_score(F.col("question"), F.col("text"), scorer) if params.rerank else F.lit(None).cast("double")
    hits = ranked(full.withColumn("rerank_score", score), params)
    return hits, decide(questions.drop("vector"), hits, params, collection)
