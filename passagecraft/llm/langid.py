"""Hierarchical language identification: the family first, then one-versus-one linear support vector machines within it.

A text is the square roots of the shares of its hashed letter n-grams (1 to 3, words padded by a separator), all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


UNKNOWN = "und"
DIMENSIONS = 4096
#: The labelled texts that a model is fitted on, about; shared evenly among the languages.
MAX_LABELLED = 2000
_CHUNK = 1 << 20

# Families of closely related languages, by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "indic": "hi bn mr gu pa ur ne si",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he am mt",
    "sinitic": "zh yue",
    "uralic": "fi et hu",
    "baltic": "lt lv",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    """The family of a language code; codes that are in none share one."""
    return _FAMILY_OF.get(lang.replace("_", "-").split("-")[0].lower(), "other")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, mod 4, is 2; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class _Letters:
    """Code points to themselves where they are letters, else to zero."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, text: str) -> np.ndarray:
        if cls.table is None:
            codes = np.arange(0x110000)
            cls.table = np.where([chr(c).isalpha() for c in codes], codes, 0).astype(np.uint32)
        return cls.table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]


def ngram_shares(text: str | None, dims: int = DIMENSIONS) -> np.ndarray | None:
    """The text as a vector of length 1; None if there is no letter."""
    total = np.zeros(dims, np.int64)
    text = text or ""
    for at in range(0, len(text), _CHUNK):  # a long text by pieces that overlap by what an n-gram needs
        c = _Letters.of(text[max(0, at - 2) : at + _CHUNK])
        if at == 0:
            c = np.concatenate([np.zeros(1, np.uint32), c])
        if at + _CHUNK >= len(text):
            c = np.concatenate([c, np.zeros(1, np.uint32)])
        lead = 2 if at else 0
        c = c.astype(np.uint32)
        one = c[lead:]
        total += np.bincount((one[one > 0] * np.uint32(2654435761) >> np.uint32(20)) % dims, minlength=dims)
        h = c[:-1] * np.uint32(2246822519) ^ c[1:] * np.uint32(3266489917)
        two = h[max(0, lead - 1) :][(c[:-1] > 0)[max(0, lead - 1) :] | (c[1:] > 0)[max(0, lead - 1) :]]
        total += np.bincount(((two ^ two >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(20)) % dims, minlength=dims)
        h3 = h[:-1] * np.uint32(374761393) ^ c[2:] * np.uint32(668265263)
        three = h3[c[1:-1] > 0]
        total += np.bincount(((three ^ three >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(20)) % dims, minlength=dims)
    n = total.sum()
    return np.sqrt(total / n).astype(np.float32) if n else None


@F.arrow_udf(T.BinaryType())
def _vector(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        made = (ngram_shares(t.as_py()) for t in batch)
        yield pa.array([None if v is None else v.tobytes() for v in made], pa.binary())


# a filter on a result must not make Spark compute it once for the filter and once more
_vector = _vector.asNondeterministic()


@dataclass(frozen=True)
class Model:
    """Languages, their families, and one weight vector (the last weight is the bias) for each family and each pair of a family's languages."""

    langs: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of x: the index of the language, and how sure that is, 0 to 1."""
        margin = x @ self.weights[:-1] + self.weights[-1]
        sure = 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        f, n = len(self.families), len(x)
        fam = margin[:, :f].argmax(1)
        share = sure[np.arange(n), fam] / sure[:, :f].sum(1)
        votes, worth = np.zeros((n, len(self.langs))), np.zeros((n, len(self.langs)))
        for k, (i, j) in enumerate(self.pairs):
            p = sure[:, f + k]
            votes[:, i] += p > 0.5
            votes[:, j] += p <= 0.5
            worth[:, i] += p
            worth[:, j] += 1 - p
        of = np.array([self.families.index(family(c)) for c in self.langs])
        votes[of[None, :] != fam[:, None]] = -1
        best = (votes + worth / (1 + len(self.langs))).argmax(1)
        rivals = np.array([(of == o).sum() - 1 for o in of])[best]
        within = np.where(rivals > 0, worth[np.arange(n), best] / np.maximum(rivals, 1), 1.0)
        return best, np.clip(share * within, 0, 1)


def train(x: np.ndarray, y: list[str], rounds: int = 400, ridge: float = 1e-4) -> Model | None:
    """Squared-hinge machines by accelerated gradients, all at once in the space of the examples."""
    langs = sorted(set(y))
    if not langs:
        return None
    families = sorted({family(c) for c in langs})
    pairs = [(i, j) for i, j in combinations(range(len(langs)), 2) if family(langs[i]) == family(langs[j])]
    lang = np.array([langs.index(c) for c in y])
    fam = np.array([families.index(family(c)) for c in y])
    sign = np.zeros((len(y), len(families) + len(pairs)), np.float32)
    for k in range(len(families)):
        sign[:, k] = np.where(fam == k, 1, -1)
    for k, (i, j) in enumerate(pairs):
        sign[:, len(families) + k] = np.where(lang == i, 1, np.where(lang == j, -1, 0))
    weight = np.zeros_like(sign)
    for side in (1, -1):  # both sides of a question count the same
        weight += np.where(sign == side, 0.5 / np.maximum(1, (sign == side).sum(0)), 0)
    gram = x @ x.T + 1
    step = 1 / (2 * 2.0 + ridge)  # the largest eigenvalue of a mean of (x, 1)(x, 1)' is at most 2
    a = np.zeros_like(sign)
    ahead = a
    for t in range(rounds):
        f = gram @ ahead
        new = ahead - step * (ridge * ahead - 2 * weight * sign * np.maximum(0, 1 - sign * f) * (sign != 0))
        ahead = new + t / (t + 3) * (new - a)
        a = new
    return Model(langs, families, pairs, np.vstack([x.T @ a, a.sum(0)]).astype(np.float32))


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model from text and lang of the documents that are not held out; None if there is nothing to learn from.

    Documents are taken by a hash of doc_id and text until about ``max_labelled`` are there, of each language about as
    many; the driver gets one vector for each of them, twice ``max_labelled`` at the very most. Where rows repeat so much
    that none is taken by its hash, those with the smallest are. Documents without id, language or letter teach nothing.
    """
    known = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_labelled).collect()}
    if not counts:
        return None
    share = max_labelled / len(counts)
    part = F.create_map(*[F.lit(v) for c, n in counts.items() for v in (c, min(1.0, share / n))])
    hashed = known.select("doc_id", "lang", "text", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit("langid")).alias("hash"))
    drawn = F.pmod("hash", F.lit(1 << 20)) / F.lit(float(1 << 20))
    taken = hashed.where(drawn < F.coalesce(part[F.col("lang")], F.lit(0.0))).select("doc_id", "lang", "hash", _vector("text").alias("x"))
    rows = taken.where(F.col("x").isNotNull()).orderBy("hash", "doc_id", "lang").limit(2 * max_labelled).toArrow()
    if not len(rows):
        few = hashed.orderBy("hash", "doc_id", "lang").limit(max_labelled).select("doc_id", "lang", "hash", _vector("text").alias("x"))
        rows = few.where(F.col("x").isNotNull()).toArrow()
        if not len(rows):
            return None
    order = pc.sort_indices(rows.select(["hash", "doc_id", "lang"]), [("hash", "ascending"), ("doc_id", "ascending"), ("lang", "ascending")]).to_numpy()
    x = np.empty((len(rows), DIMENSIONS), np.float32)
    for i, k in enumerate(order):
        x[i] = np.frombuffer(rows["x"][int(k)].as_buffer(), np.float32)
    langs = rows["lang"].take(pa.array(order)).to_pylist()
    del rows
    pa.default_memory_pool().release_unused()
    return train(x, langs)


def predictor(model: Model | None):
    """A function of a text column: struct(lang, score)."""

    @F.arrow_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            langs, scores = [UNKNOWN] * len(batch), np.zeros(len(batch))
            if model is not None:
                for at in range(0, len(batch), 256):
                    made = [ngram_shares(t.as_py()) for t in batch.slice(at, 256)]
                    there = [i for i, v in enumerate(made) if v is not None]
                    if there:
                        best, sure = model.scores(np.stack([made[i] for i in there]))
                        for i, b, s in zip(there, best, sure, strict=True):
                            langs[at + i], scores[at + i] = model.langs[b], s
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    return predict.asNondeterministic()  # computed once, filter or not


def identify(docs: DataFrame, model: Model | None, into: str = "predicted") -> DataFrame:
    """docs with a column ``into`` = struct(lang, score), predicted from the whole text alone; one of that name is replaced.

    Null text and text without a letter: ``und`` and 0, as is everything where nothing could be learned. Equal texts
    have equal results, repeated rows too; an empty table stays empty. No other column is read.
    """
    return docs.withColumn(into, predictor(model)("text"))
