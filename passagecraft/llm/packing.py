"""Packing documents into sequences by non-negative least squares.

A document's tokens fill whole windows first; what is left of it is shorter than a window. Combinations of two or three
such lengths (and powers of two alone) that fill a sequence without padding are enumerated, least squares over the
histogram of lengths says how often to repeat each, and rounding makes that whole numbers that the histogram allows.
What no combination takes is packed greedily, one after the other, cut where a sequence is full.

Places are computed, not searched for: a remainder's rank among those of its length, by exact sums over buckets of that
length, says which repetition of which combination it is in, or how many tokens of the rest stand before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cells, materialize
from .tokenizer import definition_of, encode_all

WINDOW = 1024
END = 0
#: Buckets of a length at least, and rows of all lengths for each further one.
BUCKETS, BUCKET_ROWS = 64, 50_000


def combinations_of(window: int) -> np.ndarray:
    """Rows of up to three lengths, ascending after zeros, that make a sequence without padding."""
    alone = [(0, 0, 1 << i) for i in range(window.bit_length()) if 1 << i < window]
    two = [(0, a, window - a) for a in range(1, window // 2 + 1)]
    three = [(a, b, window - a - b) for a in range(1, window // 3 + 1) for b in range(a, (window - a) // 2 + 1)]
    return np.array([*alone, *two, *three], np.int64)


def non_negative(combos: np.ndarray, h: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The repeats x >= 0 that come nearest to the histogram h in least squares, by accelerated projected gradients."""
    flat = combos.ravel()
    there = flat > 0
    row = np.repeat(np.arange(len(combos)), combos.shape[1])[there]
    flat = flat[there]
    apply = lambda x: np.bincount(flat, x[row], len(h))
    back = lambda r: np.bincount(row, r[flat], len(combos))
    v = np.ones(len(combos))
    for _ in range(20):
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(combos))
    for t in range(rounds):
        new = np.maximum(0, y - step * back(apply(y) - h))
        y = new + t / (t + 3) * (new - x)
        x = new
    return x


def whole_numbers(combos: np.ndarray, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeats near x that take no more than h has, and then as many more as fit; and what is left of h."""
    left, n = h.copy(), np.zeros(len(combos), np.int64)
    for least in (True, False):
        for k in np.argsort(-x, kind="stable"):
            want = int(x[k] + 0.5) if least else 1 << 62
            if want == 0:
                break  # in order of x: no more to round up
            lengths = combos[k][combos[k] > 0]
            if not (left[lengths] > 0).all():
                continue
            kinds, times = np.unique(lengths, return_counts=True)
            take = min(want, int((left[kinds] // times).min()))
            left[kinds] -= take * times
            n[k] += take
    return n, left


@dataclass(frozen=True)
class Plan:
    """Where every remainder goes. By length: ``covered`` ranks stand in combinations, the others' first place is ``rest_at``.

    The slots of length l are slot_from[l] to slot_from[l + 1]: the first rank, the first sequence and the offset of each.
    """

    window: int
    full_at: np.ndarray
    n_full: int
    covered: np.ndarray
    slot_from: np.ndarray
    first_rank: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray
    n_combined: int
    rest_at: np.ndarray
    n_rest: int


def plan(h: np.ndarray, full: np.ndarray, window: int = WINDOW) -> Plan:
    """h: how many remainders have each length (0 to window - 1); full: whole windows of the documents of each."""
    combos = combinations_of(window)
    used = h.copy()
    used[0] = 0
    n, left = whole_numbers(combos, non_negative(combos, used.astype(float)), used)
    keep = np.nonzero(n)[0]
    first = np.cumsum(n[keep]) - n[keep]
    slots = []
    for k, base in zip(keep, first, strict=True):
        at = 0
        for length in combos[k][combos[k] > 0]:
            slots.append((length, base, at, n[k]))
            at += length
    slots = np.array(sorted(slots), np.int64).reshape(-1, 4)
    slot_from = np.searchsorted(slots[:, 0], np.arange(window + 1))
    ranks = np.cumsum(slots[:, 3]) - slots[:, 3]
    ranks = ranks - ranks[slot_from[slots[:, 0]]] if len(slots) else ranks
    tokens = left * np.arange(window)
    return Plan(window, np.cumsum(full) - full, int(full.sum()), used - left, slot_from, ranks, slots[:, 1], slots[:, 2], int(n.sum()), np.cumsum(tokens) - tokens, int(tokens.sum()))


def rest_cuts(p: Plan) -> tuple[int, np.ndarray]:
    """Of the rest's last sequence: where it begins, and the first places of its parts, whose lengths are powers of two."""
    begin = p.n_rest // p.window * p.window
    parts, left, at = [], p.n_rest - begin, begin
    for bit in reversed(range(p.window.bit_length())):
        if left >> bit & 1:
            parts.append(at)
            at += 1 << bit
    return begin, np.array(parts, np.int64)


def place(p: Plan, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start in the remainder, length, sequence, offset) of each piece of a remainder."""
    if rank < p.covered[length]:
        a, b = p.slot_from[length], p.slot_from[length + 1]
        s = a + np.searchsorted(p.first_rank[a:b], rank, "right") - 1
        return [(0, length, int(p.n_full + p.first_sequence[s] + rank - p.first_rank[s]), int(p.offset[s]))]
    at = int(p.rest_at[length] + (rank - p.covered[length]) * length)
    begin, parts = rest_cuts(p)
    out, done = [], 0
    while done < length:
        if at < begin:
            nth, first, end = at // p.window, at // p.window * p.window, (at // p.window + 1) * p.window
        else:
            k = int(np.searchsorted(parts, at, "right")) - 1
            nth, first, end = begin // p.window + k, int(parts[k]), int(parts[k + 1]) if k + 1 < len(parts) else p.n_rest
        n = min(length - done, end - at)
        out.append((done, n, p.n_full + p.n_combined + nth, at - first))
        done, at = done + n, at + n
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenize(definition, key: str, window: int):
    """Per document its whole windows, as checksums, and the ids of its remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows = []
                for nth, ids in enumerate(encode_all(part.column(1), key, definition.value)):
                    ids = np.append(ids, ids.dtype.type(END))
                    n = len(ids) // window
                    rest = ids[n * window :]
                    rows.append((len(ids), [_crc(ids[i * window : (i + 1) * window]) for i in range(n)], len(rest), _crc(rest), rest.astype("<u4").tobytes() if ids.dtype != np.uint16 else rest.tobytes(), ids.dtype.itemsize, nth))
                c = list(zip(*rows, strict=True)) or [()] * 7
                kinds = (pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(c, kinds, strict=True))], ["doc_id", "doc_tokens", "crcs", "rest", "rest_crc", "rest_ids", "id_bytes", "salt"])

    return run


def _pieces(shared, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Plan(**shared.value)
        kinds = [pa.int64()] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                doc, total, rest = r["doc_id"], r["doc_tokens"], r["rest"]
                for i, crc in enumerate(r["crcs"]):
                    out.append((doc, i * window, window, crc, total, int(p.full_at[rest]) + r["full"] + i, 0))
                if rest:
                    places, base = place(p, rest, r["rank"]), total - rest
                    ids = np.frombuffer(r["rest_ids"], np.uint16 if r["id_bytes"] == 2 else np.uint32) if len(places) > 1 else None
                    for start, n, sequence, offset in places:
                        crc = r["rest_crc"] if ids is None else _crc(ids[start : start + n])
                        out.append((doc, base + start, n, crc, total, sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Per piece of a document of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids are those of the tokenizer in the file ``path``, without added special tokens, and an id END after each document.
    Null text is empty and has that id alone. Repeated rows are packed each; null doc_ids stay null. An empty table gives
    no rows; other columns are ignored. Every sequence is full or its length is a power of two, so nothing is padded; the
    latter are powers of two alone and at most one for each bit of the window at the very end.

    Texts are encoded once, into a table of checksums of whole windows and of the ids of remainders, which are shorter
    than a window whatever the document. The driver gets one sum for each length. Equal lengths are dealt over buckets, repeated rows too.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(definition_of(path))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, doc_tokens long, crcs array<long>, rest int, rest_crc long, rest_ids binary, id_bytes int, salt int"
    made = materialize(some.mapInArrow(_tokenize(definition, path, window), kind), "packed-ids", narrow=False)
    buckets = cells(made.count(), BUCKET_ROWS, BUCKETS)
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "rest_crc", "doc_tokens", "salt"), F.lit(buckets)))
    sums = materialize(made.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("crcs")).alias("n_full")), "packed-sums")
    before = W.partitionBy("rest").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    firsts = sums.select("rest", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"), F.coalesce(F.sum("n_full").over(before), F.lit(0)).alias("full0"))
    h, full = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for r in sums.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("n_full").alias("n_full")).collect():
        h[r["rest"]], full[r["rest"]] = r["n"], r["n_full"]
    shared = spark.sparkContext.broadcast(vars(plan(h, full, window)))  # a few numbers for each combination there is
    within = W.partitionBy("rest", "bucket").orderBy("doc_id", "rest_crc", "doc_tokens", F.hash("crcs"), "salt")
    ranked = made.join(firsts, ["rest", "bucket"]).select(
        "doc_id", "doc_tokens", "crcs", "rest", "rest_crc", "rest_ids", "id_bytes",
        (F.col("rank0") + F.row_number().over(within) - 1).alias("rank"),
        (F.col("full0") + F.sum(F.size("crcs")).over(within.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.size("crcs")).alias("full"),
    )
    return ranked.mapInArrow(_pieces(shared, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
