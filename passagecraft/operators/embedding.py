"""Vectors and scores. The built-in models are deterministic stand-ins without learned weights; others plug in as functions."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagecraft.functions.text import half_even, tokens

DIMENSIONS = 384
#: Texts that a model gets at once.
BATCH = 64
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "

#: Words that a worker remembers the hashes of, and different signs between words up to which they are blanked one by one.
REMEMBERED_WORDS, SIGNS = 200_000, 64

#: From texts to a matrix with a row for each.
Embedder = Callable[[Sequence[str]], np.ndarray]
#: From (question, passage) pairs to logits.
Scorer = Callable[[Sequence[tuple[str, str]]], Sequence[float]]


def kept(name: str, make: Callable[[], object]):
    """What this Python process keeps under a name, between tasks, too; functions that travel by value have globals of their own."""
    store = sys.modules.setdefault("_passagecraft_models", types.ModuleType("_passagecraft_models")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


class _Hashes(dict):
    """Hashes of words, made when they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = made = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
        return made


def words(texts: Sequence[str]) -> list[list[str]]:
    """The lower-case runs of letters and digits of each text: as by ``[^\\W_]+``, but signs are blanked for all texts at once."""
    import re

    whole = "\0".join(texts).lower()
    between = [c for c in set(whole) if c != "\0" and not c.isalnum() and not c.isspace()]
    if len(between) > SIGNS or whole.count("\0") >= max(1, len(texts)):
        return [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    for c in between:
        whole = whole.replace(c, " ")
    return [t.split() for t in whole.split("\0")] if texts else []


def hashed_words(texts: Sequence[str], dims: int = DIMENSIONS) -> np.ndarray:
    """Word counts by hash: a word's place is the first 32 bits of its MD5, modulo the dimensions."""
    from itertools import chain

    hashes = kept("hashed words", _Hashes)
    if len(hashes) > REMEMBERED_WORDS:
        hashes.clear()
    found = words(texts)
    sizes = [len(w) for w in found]
    places = np.fromiter(map(hashes.__getitem__, chain.from_iterable(found)), np.int64, sum(sizes)) % dims
    return np.bincount(np.repeat(np.arange(len(texts)) * dims, sizes) + places, minlength=len(texts) * dims).reshape(len(texts), dims).astype(float)


class Hosted:
    """An embedder by calls to a service: texts go in batches, and rows come back in the order of their index.

    ``post`` gets a model's name and texts, and gives (index, vector) pairs in any order. Questions have no instruction
    in front, as the models of services take both alike.
    """

    def __init__(self, post: Callable[[str, Sequence[str]], Iterable[tuple[int, Sequence[float]]]], model: str, dims: int, batch: int = 128):
        self.post, self.model, self.dims, self.batch = post, model, dims, batch

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for at in range(0, len(texts), self.batch):
            part = list(texts[at : at + self.batch])
            rows = sorted(self.post(self.model, part), key=lambda r: r[0])
            if [r[0] for r in rows] != list(range(len(part))):
                raise ValueError(f"{self.model}: {len(rows)} vectors for {len(part)} texts")
            out[at : at + len(part)] = [r[1] for r in rows]
        return out


class Loaded:
    """An embedder that a worker makes once for each name and keeps, such as a model read from a file."""

    def __init__(self, name: str, make: Callable[[str], Embedder]):
        self.name, self.make = name, make

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        return kept(f"embedder {self.name}", lambda: self.make(self.name))(texts)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def vectors(texts: pa.Array, embedder: Embedder = hashed_words, batch: int = BATCH) -> Iterator[np.ndarray]:
    """Unit vectors of texts in single precision, ``batch`` rows at a time; a null text is an empty one."""
    for at in range(0, len(texts), batch):
        yield unit(np.asarray(embedder([t or "" for t in texts.slice(at, batch).to_pylist()]), float)).astype(np.float32)


def embed(text: Column, embedder: Embedder = hashed_words, batch: int = BATCH) -> Column:
    """Unit vectors of texts; a null text is an empty one."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            made = list(vectors(part, embedder, batch))
            if not made:
                yield pa.array([], pa.list_(pa.float32()))
                continue
            flat = np.concatenate(made)
            ends = pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32())
            yield pa.ListArray.from_arrays(ends, pa.array(flat.ravel()))

    return run(text)


def embed_query(question: Column, embedder: Embedder = hashed_words, model: str = "hashed-words", batch: int = BATCH) -> Column:
    """As embed(); models of the bge family get their instruction in front of a question."""
    return embed(F.concat(F.lit(QUERY_PREFIX), question) if "bge" in model.lower() else question, embedder, batch)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(F.arrays_zip(v.alias("x"), F.array_repeat(norm, F.size(v)).alias("n")), lambda p: p["x"].cast("double") / F.greatest(p["n"], F.lit(1e-12)))


def cosine(a: Column, b: Column, digits: int = 4) -> Column:
    """Of unit vectors: their inner product, rounded."""
    return half_even(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x), digits)


def sigmoid(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def overlap_logit(question: Column, passage: Column) -> Column:
    """The built-in scorer: 8 times the share of the question's words that the passage has, less 4."""
    q = F.array_distinct(tokens(question))
    share = F.size(F.array_intersect(q, tokens(passage))) / F.greatest(F.size(q), F.lit(1))
    return 8 * share - 4


def rerank_score(question: Column, passage: Column, scorer: Scorer | None = None) -> Column:
    """How well a passage answers a question, 0 to 1, four digits; by the built-in scorer or another."""
    if scorer is None:
        return half_even(sigmoid(overlap_logit(question, passage)), 4)

    @F.arrow_udf(T.DoubleType())
    def run(pairs: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for q, p in pairs:
            yield pa.array([float(x) for x in scorer(list(zip(q.to_pylist(), p.to_pylist(), strict=True)))], pa.float64())

    return half_even(sigmoid(run(question, passage)), 4)
