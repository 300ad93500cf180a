"""Token counts of documents: pieces are counted once for each distinct pre-token and joined to frequencies.

Blocks of documents become lists by pre-token: which documents of the block hold it, and how often. The lists are dealt
out by a hash of the pre-token, packed, one row for each block and partition. So all of a pre-token's lists meet in one
task, which counts its pieces once, joins them to the frequencies and sums up by document; sums then meet by block. A
pre-token crosses the shuffle once for a block, not once for a document; no token id is ever made but while a distinct
pre-token is counted, and a frequent pre-token is one more entry in the row of a block, never a row for each document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokenizer import LOWER_WORDS, PLAIN_TEXT, WHOLE_TEXTS, definition_of, ids_of, kind_of, loaded, parts_of

LIMIT = 2048
#: A block: documents and characters at most, and characters that are split in one go.
BLOCK_DOCS, BLOCK_CHARS, _PART_CHARS = 4096, 16 << 20, 4 << 20

#: Input partitions whose blocks share the tasks of a pre-token: more documents get more tasks, however frequent it is.
TOGETHER = 128

# Text of these characters alone is split here as the library splits it: they have no other composed form, each has one
# lower case letter, and what is letter, digit, white space or neither is plain. Other text is split by the library.
_LETTERS = "a-zß-öø-ÿĀ-įı-ňŊ-ž"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")

def pre_tokens(text: str, tok, specials: re.Pattern | None, kind: str = LOWER_WORDS) -> list[str]:
    """What the tokenizer counts one by one, in order; a special string stands for itself, and a text that can't be cut for itself."""
    if kind == WHOLE_TEXTS:
        return [text] if text else []
    if kind == LOWER_WORDS and PLAIN_TEXT.fullmatch(text) and not (specials and "<" in text and specials.search(text)):
        return _PIECE.findall(text.lower())
    out = []
    for i, part in enumerate(specials.split(text) if specials else [text]):
        if i % 2:
            out.append(part)
        elif part:
            normal = tok.normalizer.normalize_str(part) if tok.normalizer else part
            out += [normal[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(normal)]
    return out


def _specials(tok) -> re.Pattern | None:
    if not hasattr(tok, "get_added_tokens_decoder"):
        return None
    names = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile(f"({'|'.join(map(re.escape, names))})") if names else None


def _pack(names: pa.Array, lengths: np.ndarray, docs: np.ndarray, times: np.ndarray) -> bytes:
    """Names, how many entries each has, and the entries, compressed."""
    offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1]
    text = bytes(names.buffers()[2])[offsets[0] : offsets[-1]] if len(names) else b""
    wide = 8 if len(times) and times.max() >= 1 << 32 else 4 if len(times) and times.max() >= 1 << 8 else 1
    head = np.array([len(names), len(docs), wide], np.int64)
    raw = b"".join([head.tobytes(), np.diff(offsets).astype(np.int32).tobytes(), lengths.astype(np.int32).tobytes(), docs.astype(np.uint16).tobytes(), times.astype(f"<u{wide}").tobytes(), text])
    return np.int64(len(raw)).tobytes() + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpack(data: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd").decompress(memoryview(data)[8:], int(np.frombuffer(data, np.int64, 1)[0]), asbytes=True)
    n, k, wide = (int(x) for x in np.frombuffer(raw, np.int64, 3))
    at = 24
    sizes = np.frombuffer(raw, np.int32, n, at)
    lengths = np.frombuffer(raw, np.int32, n, at := at + 4 * n)
    docs = np.frombuffer(raw, np.uint16, k, at := at + 4 * n)
    times = np.frombuffer(raw, f"<u{wide}", k, at := at + 2 * k)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    names = pa.StringArray.from_buffers(n, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[at + wide * k :]))
    return names.to_pylist(), lengths, docs, times


def _blocks(definition, key: str, buckets: int):
    """Per block a row for each bucket with its packed lists, and one with what is known of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd
        from pyspark import TaskContext

        tok = loaded(key, definition.value)
        specials, kind = _specials(tok), kind_of(definition.value)
        task, nth = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        sizes: list[int] = []
        parts: list[pa.DictionaryArray] = []
        counts: list[int] = []
        pieces: list[str] = []

        def split_up() -> None:
            if pieces:
                parts.append(pa.array(pieces, pa.string()).dictionary_encode())
                pieces.clear()

        def close() -> pa.RecordBatch:
            nonlocal nth
            split_up()
            block, nth = task << 32 | nth, nth + 1
            data, where = [], []
            if parts:
                whole = pa.chunked_array(parts).unify_dictionaries()
                names = whole.chunk(0).dictionary
                at = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in whole.chunks]).astype(np.int64)
                bucket = pd.util.hash_array(np.array(names.to_pylist(), object), categorize=False) % buckets
                order = np.argsort(bucket, kind="stable")
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                names, bucket = names.take(pa.array(order)), bucket[order]
                both, times = np.unique(place[at] * BLOCK_DOCS + np.repeat(np.arange(len(ids)), counts), return_counts=True)
                first = np.searchsorted(bucket, np.arange(buckets + 1))
                entry = np.searchsorted(both // BLOCK_DOCS, first)
                lengths = np.bincount(both // BLOCK_DOCS, minlength=len(names))
                for b in np.nonzero(np.diff(first))[0]:
                    n, e = slice(first[b], first[b + 1]), slice(entry[b], entry[b + 1])
                    data.append(_pack(names.slice(n.start, n.stop - n.start), lengths[n], both[e] % BLOCK_DOCS, times[e]))
                    where.append(int(b + task // TOGETHER) % buckets)
            m = len(data)
            lists = pa.list_(pa.int64())
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([*where, block % buckets], pa.int32()), pa.array([block] * (m + 1), pa.int64()), pa.array([*data, None], pa.binary()),
                    pa.array([None] * m + [ids], lists), pa.array([None] * m + [sizes], lists),
                ],
                ["bucket", "block", "data", "doc_ids", "sizes"],
            )
            for held in (ids, sizes, parts, counts):
                held.clear()
            return out

        chars = whole_chars = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                t = text.as_py() or ""
                ids.append(doc_id.as_py())
                sizes.append(len(t.encode()))
                counts.append(0)
                for part in parts_of(t, kind, _PART_CHARS):
                    own = pre_tokens(part, tok, specials, kind)
                    counts[-1] += len(own)
                    pieces += own
                    chars, whole_chars = chars + len(part), whole_chars + len(part)
                    if chars >= _PART_CHARS:
                        split_up()
                        chars = 0
                if whole_chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield close()
                    chars = whole_chars = 0
        if ids:
            yield close()

    return run


_KIND = "block long, data binary, doc_ids array<long>, sizes array<long>"


def _count(definition, key: str):
    """Counts the pieces of each pre-token when it is first seen, joins them to its lists, and sums up by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(key, definition.value)
        known: dict[str, int] = {}  # the distinct pre-tokens of this partition
        for batch in batches:
            out = []
            for row in batch.column("data"):
                if not row.is_valid:
                    out.append(None)
                    continue
                names, lengths, docs, times = _unpack(row.as_buffer())
                new = [w for w in names if w not in known]
                for at in range(0, len(new), 4096):
                    part = new[at : at + 4096]
                    known.update(zip(part, map(len, ids_of(tok, part)), strict=True))
                n = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
                sums = np.zeros(int(docs.max()) + 1, np.int64)
                np.add.at(sums, docs, np.repeat(n, lengths) * times.astype(np.int64))
                kind = np.uint32 if sums.max() < 1 << 32 else np.uint64
                raw = sums.astype(kind).tobytes()
                out.append(bytes([kind(0).itemsize]) + np.int64(len(raw)).tobytes() + pa.Codec("zstd").compress(raw, asbytes=True))
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(out, pa.binary()), batch.column("doc_ids"), batch.column("sizes")], ["block", "data", "doc_ids", "sizes"])

    return run


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block follow each other: adds up its sums, and gives them to its documents."""
    block, total, docs = None, np.zeros(BLOCK_DOCS, np.int64), None

    def close() -> pa.RecordBatch:
        ids, sizes = docs
        return pa.RecordBatch.from_arrays([ids, sizes, pa.array(total[: len(ids)])], ["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for b, data, ids, sizes in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("doc_ids"), batch.column("sizes"), strict=True):
            if b != block:
                if block is not None:
                    yield close()
                block, total, docs = b, np.zeros(BLOCK_DOCS, np.int64), None
            if data.is_valid:
                raw = data.as_buffer().to_pybytes()
                got = np.frombuffer(pa.Codec("zstd").decompress(raw[9:], int(np.frombuffer(raw, np.int64, 1, 1)[0]), asbytes=True), f"<u{raw[0]}")
                total[: len(got)] += got.astype(np.int64)
            else:
                docs = ids.values, sizes.values
    if block is not None:
        yield close()


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_bytes, n_tokens, over_limit, by the tokenizer in the file ``path``.

    The file is one of the library tokenizers (.json) or of sentencepiece (.model). Pre-tokens are those of the file if its
    normalizer, pre-tokenizer and added tokens are of a known kind; for any other file a text is one pre-token.
    Null text counts as empty, with no bytes and no tokens. Each row counts by itself, repeated or null doc_ids too; an
    empty table gives no rows, and other columns are ignored. The file's content is sent to the executors. A task of the
    second stage holds its partition's distinct pre-tokens, so their number per task goes down with
    spark.sql.shuffle.partitions. Lists of a pre-token meet in one task for each TOGETHER input partitions; there it is
    counted once, so that no pre-token's lists outgrow a task, be it in every document.
    """
    spark = docs.sparkSession
    definition = spark.sparkContext.broadcast(definition_of(path))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = some.mapInArrow(_blocks(definition, path, buckets), f"bucket int, {_KIND}").repartitionById(buckets, F.col("bucket"))
    sums = lists.drop("bucket").mapInArrow(_count(definition, path), _KIND)
    whole = sums.repartition(buckets, "block").sortWithinPartitions("block").mapInArrow(_sum_up, "doc_id long, n_bytes long, n_tokens long")
    return whole.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
