import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from passagecraft.llm import collocations
from passagecraft.llm.common import Tables

SCHEMA = "doc_id long, lang string, text string"


def plain_counts(rows, most=4):
    """f of every phrase of a language, by loops; the empty one has the number of words."""
    f = Counter()
    for _, lang, text in rows:
        lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = [w for w in re.split("[ \t]", piece) if w]
            for i in range(len(words)):
                f[lang or "und", ""] += 1
                for k in range(1, most + 1):
                    if i + k <= len(words):
                        f[lang or "und", " ".join(words[i : i + k])] += 1
    return f


def plain(rows, least, top):
    f = plain_counts(rows)
    some = {key: n for key, n in f.items() if " " in key[1] and n >= least}
    out = {}
    for (lang, phrase), a in some.items():
        w = phrase.split(" ")
        if any(lang == other and len(p) > len(phrase) and f" {phrase} " in f" {p} " and 100 * n >= 80 * a for (other, p), n in some.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, " ".join(w[:k])] + f[lang, " ".join(w[k:])]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, phrase.encode(), f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])], f[lang, ""]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n, -s) for lang, found in out.items() for i, (s, a, p, l, r, n) in enumerate(sorted(found)[:top]))


def said(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def rows_of(seed, n=80):
    rnd = random.Random(seed)
    words = ["a", "b", "C", "de", "é", "Éa", "\x00", "x y", "ÿ", "f"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!"]
    return [(i, rnd.choice(["en", "fr", None]), "".join(rnd.choice(words) + rnd.choice(marks) for _ in range(rnd.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("shard, branch", [(1 << 21, 1 << 18), (500, 64), (130, 1)])
def test_against_plain_counts(spark, monkeypatch, shard, branch):
    monkeypatch.setattr(collocations, "SHARD", shard)
    monkeypatch.setattr(collocations, "BRANCH", branch)
    monkeypatch.setattr(collocations, "SLICE", 200)
    rows = rows_of(1) + [(500, "en", "one two three four five " * 40), (501, "en", None), (502, None, ""), (503, "de", " \t.;")] + [(504, "fr", "same words here")] * 9
    got = collocations.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=8, top=25)
    assert said(got) == plain(rows, 8, 25)
    found = collocations.frequent(spark.createDataFrame(rows, SCHEMA), Tables(), 8)
    assert {(r.lang, r.phrase): r.f for r in found.collect() if r.phrase} == {k: n for k, n in plain_counts(rows).items() if n >= 8 and k[1]}


def test_filters_that_let_all_through_still_give_exact_results(spark, monkeypatch):
    monkeypatch.setattr(collocations.Filter, "passes", lambda self, h: np.ones(len(h), bool))
    monkeypatch.setattr(collocations.Filter, "has", lambda self, h: True)
    rows = rows_of(2)
    assert said(collocations.collocations(spark.createDataFrame(rows, SCHEMA), least=5)) == plain(rows, 5, 2000)


def test_bitmaps_over_many_places():
    rnd = np.random.default_rng(3)
    seq = rnd.integers(0, 5, 3000).astype(np.int32)
    words = collocations.Words("en", None)
    for w in (b"p", b"q", b"r", b"s"):
        words[w]
    want = Counter()
    for i in range(len(seq)):
        for k in range(1, 5):
            part = seq[i : i + k]
            if len(part) == k and part.all():
                want[b" ".join(words.names[w] for w in part)] += 1
    found = {p: n for names, counts in collocations.phrases_of(seq, words, None, 2, 4) for p, n in zip(names.to_pylist(), counts.tolist(), strict=True)}
    assert found == {p.decode(): n for p, n in want.items() if b" " in p}
    masks = collocations.Bitmaps(seq)
    assert np.bitwise_count(masks.mask).sum() == (seq > 0).sum() and len(masks.mask) <= 4 * (3000 // 64 + 1)
    assert list(collocations.phrases_of(np.zeros(0, np.int32), words, None, 2, 4)) == []


def test_hashes_agree(spark):
    texts = ["", "a", "é", "x" * 100, "1234567", "12345678", "\x00"]
    df = spark.createDataFrame([("en", t) for t in texts], "lang string, w string")
    want = [xxh64_intdigest(t.encode(), xxh64_intdigest(b"en", 42)) for t in texts]
    assert [r.h % (1 << 64) for r in df.select(collocations.word_hash(F.col("lang"), F.col("w")).alias("h")).collect()] == want
    two = [r.h % (1 << 64) for r in df.select(collocations.pair_hash(F.col("lang"), F.lit("a"), F.col("w")).alias("h")).collect()]
    assert two == [want[1] ^ (h << 29 | h >> 35) % (1 << 64) for h in want]


def test_odd_tables(spark):
    rows = [(1, None, None), (None, "en", "A b. A b\nA b"), (1, "en", "z " * 100_000), (1, "en", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("own") for n in ("phrase", "f", "a", "l", "r", "n", "k", "w", "score", "rank", "left", "right")})
    assert said(collocations.collocations(df, least=3)) == plain(rows, 3, 2000)
    assert collocations.collocations(df.limit(0)).count() == 0
