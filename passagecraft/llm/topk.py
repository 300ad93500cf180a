"""Exact top-k search: score histograms find each query's kth score, then a filter leaves what can be in the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cells, delete_at_end, scratch

#: Queries that are scored together; a bound for what is collected and broadcast at once, about twice this many vectors.
QUERY_BLOCK = 1 << 14
BINS = 64
#: Scores that are held at once: the more queries, the fewer vectors meet them at a time.
_SCORES = 1 << 21
_LONG = 1 << 63


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of floor(256 x), short vectors filled up with zeros; as floats, which hold them exactly."""
    out = np.zeros((len(vectors), width))
    flat, at = np.floor(256 * np.asarray(vectors.flatten(), np.float64)), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    n = np.diff(at)
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(flat)) - np.repeat(at[:-1], n)] = flat
    return out


class _Block:
    """One block of queries and how their scores against a batch of vectors are made."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, exact: bool):
        order = np.argsort(ids)
        self.ids, self.queries, self.exact = ids[order], queries[order], exact

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Vector ids, scores (vectors x queries), and where a score counts."""
        big = np.vectorize(int, otypes=[object])
        right = self.queries.T if self.exact else big(self.queries.T)
        some = max(1, _SCORES // max(1, len(self.ids)))
        for whole in batches:
            for at in range(0, len(whole), some):
                part = whole.slice(at, some)
                ids, left = part.column(0).to_numpy(), _matrix(part.column(1), self.queries.shape[1])
                scores = left @ right if self.exact else np.clip(big(left) @ right, -_LONG, _LONG - 1)
                counts = np.ones(scores.shape, bool)
                q = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
                own = np.nonzero(self.ids[q] == ids)[0]
                counts[own, q[own]] = False
                yield ids, scores, counts


def _histogram(block: _Block, base: np.ndarray, width: np.ndarray, span: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(block.ids) * BINS, np.int64)
        for _, scores, counts in block.slices(batches):
            above = scores - base
            rows, q = np.nonzero(counts & (above >= 0) & (above < span))
            total += np.bincount(q * BINS + (above[rows, q] // width[q]).astype(np.int64), minlength=len(total))
        full = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(full // BINS, pa.int64()), pa.array(full % BINS, pa.int64()), pa.array(total[full])], ["q", "bin", "n"])

    return run


def _winners(block: _Block, kth: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scores, counts in block.slices(batches):
            rows, q = np.nonzero(counts & (scores >= kth))
            found = scores[rows, q]
            order = np.lexsort((ids[rows], np.array([-int(s) for s in found], object if not block.exact else np.int64), q))
            rows, q, found = rows[order], q[order], found[order]
            first = np.concatenate([[0], np.nonzero(np.diff(q))[0] + 1]) if len(q) else np.zeros(0, int)
            nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            rows, q, found = rows[nth < k], q[nth < k], found[nth < k]
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q]), pa.array(ids[rows]), pa.array([int(s) for s in found], pa.int64())], ["query_id", "vec_id", "score"])

    return run


def _kth_scores(rows: DataFrame, block: _Block, limit: int, k: int) -> np.ndarray:
    """Each query's kth highest score; the lowest possible one, if it has fewer."""
    n, kind = len(block.ids), np.float64 if block.exact else object
    base, span = np.full(n, -limit, kind), np.full(n, 2 * limit + 1, kind)
    need = np.full(n, k, np.int64)
    while span.max() > 1:
        width = np.maximum(-(-span // BINS), 1)
        sums = rows.mapInArrow(_histogram(block, base, width, span), "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        table = np.zeros((n, BINS), np.int64)
        found = sums.toArrow()  # at most QUERY_BLOCK x BINS numbers, about
        table[found["q"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
        from_top = table[:, ::-1].cumsum(1)
        there = from_top[:, -1] >= need
        nth = np.where(there, BINS - 1 - (from_top >= need[:, None]).argmax(1), 0)
        need = need - np.where(there, np.take_along_axis(from_top, (BINS - 1 - nth)[:, None], 1)[:, 0] - np.take_along_axis(table, nth[:, None], 1)[:, 0], 0)
        top = base + span
        base = np.where(there, base + nth * width, base)
        span = np.where(there, np.minimum(width, top - base), 1)
    return base


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For every query of vectors(vec_id, embedding): query_id, rank, vec_id, score of its k best by integer inner product.

    Vectors are taken as floor(256 x) per component. Null vectors, and those with a null or non-finite component, take
    no part, nor do rows without vec_id; shorter vectors count as filled up with zeros. A query is not its own
    candidate, and neither is any other row with its vec_id; if a query's vec_id repeats, the smallest of its vectors
    asks. Ties go to the smaller vec_id; fewer than k candidates are all returned. No queries: no rows. Other columns
    are ignored. Scores beyond 64 bits are held at the ends of that range.

    Queries go in blocks by a hash of their id. One block, of about ``query_block`` rows whatever the input, is what the
    driver holds and sends out; every block meets all rows in place, without a shuffle. Some rounds of histograms over
    all scores, BINS bins a query and round, narrow each query's kth score down to one value; sums alone are shuffled.
    A last round scores again and lets out what reaches that value, of ties no more than k from a slice of a batch. With
    more than one block, each writes what it found to one table in the shared folder.
    """
    spark = vectors.sparkSession
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
    asks = rows.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    largest = F.array_max(F.transform("embedding", lambda x: F.abs(F.floor(x * 256).cast("double"))))
    size, width = rows.agg(F.max(F.abs(largest)), F.max(F.size("embedding"))).first()
    n = asks.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    limit = int(size or 0) ** 2 * max(width, 1) + 1
    blocks = cells(n, query_block)
    kind = "query_id long, vec_id long, score long"
    found, path = None, scratch(spark, "top-k") if blocks > 1 else ""
    for b in range(blocks):
        own = asks.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        if not len(own):
            continue
        block = _Block(own.column(0).to_numpy(), _matrix(own.column(1).combine_chunks(), max(width, 1)), limit < 1 << 53)
        kth = _kth_scores(rows, block, min(limit, _LONG), k)
        found = rows.mapInArrow(_winners(block, kth, k), kind)
        if path:
            found.write.mode("append").parquet(path)
    if path:
        delete_at_end(spark, path)
        found = spark.read.schema(kind).parquet(path)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
