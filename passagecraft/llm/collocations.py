"""Phrases whose words stand together: position bitmaps per word, extended depth-first by shift and AND.

A task cuts its texts into shards of one language. In a shard each place is a word's, and between two pieces of text stands
a place of nobody, so no phrase crosses it. A word's bitmap is compressed: of every 64 places, only those with the word are
kept, as (number of the 64, mask). A phrase's bitmap marks the places of its last word; shifted by one place and ANDed with
the bitmap of another word it becomes that of the longer phrase, and its popcount is how often the shard has it. Phrases
with the same first words grow down to the last level before the next branch begins, many of them in one pass over arrays.
Popcounts are summed over the shards.

A phrase can be frequent only if its words and its pairs are. Words are counted first, then pairs of frequent words, then
longer phrases of frequent pairs. What is frequent goes to the tasks as a filter of bits by hash, of 16 MB at most: it may
let too much through, never too little, and the sums over all shards decide exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables

MIN_COUNT = 30
MAX_WORDS = 4
#: Scores are millionths of a half; a phrase goes if a longer one has this share of its occurrences (percent).
SCALE, SHARE = 2_000_000, 80
TOP = 2000
#: Parts of a language that are ranked apart before its best are.
PARTS = 256
UNKNOWN = "und"
#: Places of a shard, of the first words that grow together, about; bytes that are split into words at once.
SHARD, BRANCH, SLICE = 1 << 21, 1 << 18, 1 << 20
#: Words that a worker remembers at most.
REMEMBERED = 1_000_000
#: Bits of one bitmap of a filter, as Spark's bitmap functions have them; bits for each key; bitmaps at most.
_BITMAP, _BITS_A_KEY, _BITMAPS = 1 << 15, 16, 1 << 12
#: Ends of pieces become a byte that UTF-8 has not.
_GAP = b"\xff"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + _GAP * 10)


class Filter:
    """A set of hashes: what is in it passes, and little else as long as it has bits enough."""

    def __init__(self, bits: bytes):
        self.bits, self.one = np.frombuffer(bits, np.uint8), bits
        self.last = 8 * len(bits) - 1

    def has(self, h: int) -> bool:
        h &= self.last
        return self.one[h >> 3] >> (h & 7) & 1 > 0

    def passes(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(self.last)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0

    @staticmethod
    def bits_of(hashes: DataFrame, n: int) -> bytes:
        """The bits of hashes(h), about n of them."""
        bitmaps = max(1, min(_BITMAPS, 1 << (n * _BITS_A_KEY // _BITMAP).bit_length()))
        at = hashes.select(F.pmod("h", F.lit(bitmaps * _BITMAP)).alias("at"))
        rows = at.groupBy(F.floor(F.col("at") / _BITMAP).alias("k")).agg(F.bitmap_construct_agg(F.col("at") % _BITMAP).alias("bits")).toArrow()
        out = bytearray(bitmaps * _BITMAP // 8)
        for k, bits in zip(rows["k"].to_pylist(), rows["bits"].to_pylist(), strict=True):
            out[k * _BITMAP // 8 : (k + 1) * _BITMAP // 8] = bits
        return bytes(out)


def word_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)


def pair_hash(lang: Column, first: Column, second: Column) -> Column:
    h = word_hash(lang, second)
    return word_hash(lang, first).bitwiseXOR(F.shiftleft(h, 29).bitwiseOR(F.shiftrightunsigned(h, 35)))


class Words(dict):
    """Numbers of the words of a language, from 1; 0 for a gap, and for a word that the filter stops."""

    def __init__(self, lang: str, passing: Filter | None):
        from xxhash import xxh64_intdigest

        super().__init__({_GAP: 0})
        self.passing, self.names, self.hashes = passing, [b""], [0]
        seed = xxh64_intdigest(lang.encode(), 42)
        self.digest = lambda w: xxh64_intdigest(w, seed)

    def __missing__(self, word: bytes) -> int:
        h, n = 0, len(self.names)
        if self.passing is not None:
            h = self.digest(word)
            if not self.passing.has(h):
                n = 0
        if n:
            self.names.append(word)
            self.hashes.append(h)
        self[word] = n
        return n


def numbered(data: bytes, words: Words) -> np.ndarray:
    """The word at each place of texts, which are joined by gaps."""
    found = data.translate(_PLAIN).replace(_GAP, b" " + _GAP + b" ").split()
    return np.fromiter(map(words.__getitem__, found), np.int32, len(found))


class Bitmaps:
    """The compressed bitmap of each word of a shard: masks of 64 places each, by word and place."""

    def __init__(self, seq: np.ndarray):
        self.seq = np.concatenate([seq, np.zeros(65, np.int32)])
        places = np.argsort(seq, kind="stable")
        places = places[np.searchsorted(seq[places], 1) :]
        word, at = seq[places], places >> 6
        new = np.ones(len(places), bool)
        new[1:] = (word[1:] != word[:-1]) | (at[1:] != at[:-1])
        first = np.flatnonzero(new)
        bit = np.uint64(1) << (places & 63).astype(np.uint64)
        self.word, self.at = word[first], at[first]
        self.mask = np.bitwise_or.reduceat(bit, first) if len(first) else np.zeros(0, np.uint64)
        #: Which mask has a place.
        self.held = np.zeros(len(self.seq), np.int32)
        self.held[places] = np.cumsum(new) - 1

    def branches(self) -> Iterator[slice]:
        """Masks of words that grow together."""
        if not len(self.word):
            return
        ends = np.append(np.flatnonzero(np.diff(self.word)) + 1, len(self.word))
        start = 0
        while start < len(self.word):
            k = max(np.searchsorted(ends, start + BRANCH, "right") - 1, np.searchsorted(ends, start, "right"))
            yield slice(start, int(ends[k]))
            start = int(ends[k])


def grown(shard: Bitmaps, phrase: np.ndarray, at: np.ndarray, mask: np.ndarray, going: np.ndarray, n_words: int):
    """One word more: (phrase, at, mask) of the longer phrases, and of each its parent, its last word and its popcount.

    A place takes part only if ``going`` says that its word may follow the one before it.
    """
    over = np.flatnonzero(mask >> np.uint64(63))
    phrase, at = np.append(phrase, phrase[over]), np.append(at, at[over] + 1)
    mask = np.append(mask << np.uint64(1), np.ones(len(over), np.uint64))
    # the words that stand there are the only ones whose AND isn't empty
    bit = np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))
    row = bit >> 6
    place = at[row] * 64 + (bit & 63)
    may = going[place]
    row, place = row[may], place[may]
    longer, which = np.unique(phrase[row].astype(np.int64) * n_words + shard.seq[place], return_inverse=True)
    code = which * np.int64(len(mask)) + row
    order = np.argsort(code, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(code[order]) != 0
    one = order[new]
    mask = mask[row[one]] & shard.mask[shard.held[place[one]]]
    phrase = which[one]
    counts = np.bitwise_count(mask).astype(np.int64)
    counts = np.add.reduceat(counts, np.flatnonzero(np.append(True, np.diff(phrase) != 0))) if len(phrase) else counts
    return (phrase, at[row[one]], mask), longer // n_words, longer % n_words, counts


def phrases_of(seq: np.ndarray, words: Words, pairs: Filter | None, least: int, most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(phrases, their popcounts) of the phrases of least to most words in a shard, a level of a branch at a time."""
    shard = Bitmaps(seq)
    going = np.zeros(len(shard.seq), bool)
    going[1 : len(seq)] = (seq[1:] > 0) & (seq[:-1] > 0)
    if pairs is not None:
        h = np.array(words.hashes, np.uint64)
        second = h << np.uint64(29) | h >> np.uint64(35)
        at = np.flatnonzero(going)
        going[at] = pairs.passes(h[seq[at - 1]] ^ second[seq[at]])
    named = pa.array(words.names, pa.binary()).cast(pa.string())
    for part in shard.branches():
        first, phrase = np.unique(shard.word[part], return_inverse=True)
        names = named.take(pa.array(first))
        now = phrase, shard.at[part], shard.mask[part]
        for level in range(2, most + 1):
            now, parent, last, counts = grown(shard, *now, going, len(words.names))
            if not len(counts):
                break
            names = pc.binary_join_element_wise(names.take(pa.array(parent)), named.take(pa.array(last)), " ")
            if level >= least:
                yield names, counts


def _shards(batches: Iterator[pa.RecordBatch], passing: Filter | None) -> Iterator[tuple[str, np.ndarray, Words]]:
    """(language, words by place, their numbers) of shards of (lang, text); memory is bound whatever the number of languages."""
    known: dict[str, Words] = {}
    held: dict[str, list[np.ndarray]] = {}
    n = 0

    def out():
        for lang, parts in held.items():
            yield lang, np.concatenate(parts), known[lang]
        held.clear()
        if sum(map(len, known.values())) > REMEMBERED:
            known.clear()

    def take(lang: str, texts: list[bytes]) -> int:
        seq = numbered(_GAP.join([*texts, b""]), known[lang])
        held.setdefault(lang, []).append(seq)
        return len(seq)

    for batch in batches:
        waiting: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            if lang not in known:
                known[lang] = Words(lang, passing)
            waiting.setdefault(lang, []).append(data := text.as_buffer().to_pybytes())
            size[lang] = size.get(lang, 0) + len(data)
            if size[lang] >= SLICE:
                n += take(lang, waiting.pop(lang))
                size[lang] = 0
                if n >= SHARD:
                    yield from out()
                    n = 0
        for lang, texts in waiting.items():
            if lang not in known:  # forgotten since
                known[lang] = Words(lang, passing)
            n += take(lang, texts)
    yield from out()


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), phrases, pa.array(counts, pa.int64())], ["lang", "phrase", "f"])


def _counted(words: object, pairs: object, least: int, most: int):
    """Counts per shard, of single words (with all of them under an empty name) or of phrases; words and pairs are broadcast bits of filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, going = (x and Filter(x.value) for x in (words, pairs))
        for lang, seq, numbers in _shards(batches, passing):
            if most == 1:
                counts = np.bincount(seq, minlength=len(numbers.names))
                counts[0] = 0
                there = np.flatnonzero(counts)
                words_there = pa.array([numbers.names[w] for w in there], pa.binary()).cast(pa.string())
                yield _rows(lang, words_there, counts[there])
                yield _rows(lang, pa.array([""]), counts.sum(keepdims=True))
            else:
                for phrases, counts in phrases_of(seq, numbers, going, least, most):
                    yield _rows(lang, phrases, counts)

    return run


def frequent(docs: DataFrame, tables: Tables, least: int = MIN_COUNT, most: int = MAX_WORDS) -> DataFrame:
    """lang, phrase, f: words and phrases of docs(lang, text) of up to ``most`` words that stand ``least`` times in a language.

    The empty phrase has the number of all words. The result reads tables that belong to ``tables``.
    """
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")

    def summed(what: str, words, pairs, low: int, high: int) -> DataFrame:
        each = texts.mapInArrow(_counted(words, pairs, low, high), "lang string, phrase string, f long")
        return tables.keep(each.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == "")), what)

    one = summed("words", None, None, 1, 1)
    if most == 1:
        return one
    words = context.broadcast(Filter.bits_of(one.select(word_hash(F.col("lang"), F.col("phrase")).alias("h")), one.count()))
    two = summed("pairs", words, None, 2, 2)
    if most == 2:
        return one.unionByName(two)
    both = F.split("phrase", " ")
    pairs = context.broadcast(Filter.bits_of(two.select(pair_hash(F.col("lang"), both[0], both[1]).alias("h")), two.count()))
    return one.unionByName(two).unionByName(summed("phrases", words, pairs, 3, most))


def collocations(docs: DataFrame, least: int = MIN_COUNT, most: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language of docs(lang, text), by exact arithmetic.

    a is how often a phrase stands in the texts, l and r how often its parts do, cut where it scores least (then after the
    fewest words), n how many words the language has. A phrase goes if a longer one has SHARE percent of its occurrences;
    one word more is enough to look at, as a phrase that is longer still is no more frequent. Null lang is ``und``, null
    text an empty one; repeated rows count each; ties go by a, then by the phrase's bytes. An empty table gives no rows;
    other columns are ignored.
    """
    tables = Tables()
    found = frequent(docs, tables, least, most)
    size = F.size(F.split("phrase", " "))
    counts = found.where("phrase != ''")
    some = counts.where(size > 1).select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    wide = lambda c: c.cast("decimal(19,0)")
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.withColumns({"above": wide(F.col("a")) * SCALE, "below": wide(F.col("l")) + wide(F.col("r"))})
    # a whole division of decimals: no double comes near it
    least_cut = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(least_cut.alias("cut"))
    inner = F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w"))))
    over = some.where(F.size("w") > 2).select("lang", F.col("a").alias("longer"), inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(over, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide(F.col("longer")) * 100 < wide(F.col("a")) * SHARE))
    # the best of each part of a language first, so that no task sorts all of one
    order = F.desc("cut.score"), F.desc("a"), F.col("phrase")
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some_best = dealt.withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = some_best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    named = best.join(found.where("phrase = ''").select("lang", F.col("f").alias("n")), "lang")
    return named.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
