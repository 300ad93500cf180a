import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import Row
from tokenizers import Tokenizer

from passagecraft.llm import packing, tokencount, tokenizer

ODD = [
    None, "", " ", "\n", "a", "it's we'll THEY'RE don't ''s '", "a  b", "a\n\nb", " lead and trail ", "x\ty\r\nz", "a \n b", "café CAFÉ é İstanbul ǅ ß ﬁ ½ ²",
    "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "< |endoftext| >", "日本語 テキスト 123４５", "emoji 👩‍👩‍👧 ok", "\x00\x1c\x1f a\x85b\xa0c d　", "1234 12.5 --- ...!!! ¿qué? «x»",
    "a\x1cb \x1d c", " x ", "w" * 5000, "the " * 9000, "퟿�", "ŉ Ŀ ŀ ſ Ÿ ĳ",
]


def odd_texts():
    rnd = random.Random(4)
    parts = ["the", "Ba", " ", "  ", "\n", "\n ", ".", "'s", "é", "É", "12", "\t", "ö-", "<|endoftext|>", "_", "'", "ñ", "日", "\xa0"]
    return ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300)]


def docs_of(spark, texts):
    return spark.createDataFrame([Row(doc_id=i if i % 7 else None, text=t, piece="clash", n=3) for i, t in enumerate(texts)], "doc_id long, text string, piece string, n int")


def variants(tmp_path):
    """Files of public tokenizers, and of some with other settings, which allow no cuts."""
    out = {n: (public_tokenizers.path(n), k) for n, k in (("byte_bpe_50k.json", tokenizer.BYTE_WORDS), ("word_bpe_49k.json", tokenizer.LOWER_WORDS), ("piece_bpe_32k.model", tokenizer.WHOLE_TEXTS))}
    for name, change in {
        "prefix": lambda d: d["pre_tokenizer"].update(add_prefix_space=True),
        "lower": lambda d: d.update(normalizer={"type": "Lowercase"}),
        "strips": lambda d: d["added_tokens"][0].update(lstrip=True),
        "split": lambda d: d.update(pre_tokenizer={"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}]}),
    }.items():
        d = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
        change(d)
        out[name] = (str(tmp_path / f"{name}.json"), tokenizer.WHOLE_TEXTS)
        with open(out[name][0], "w", encoding="utf-8") as f:
            json.dump(d, f)
    return out


NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "prefix", "lower", "strips", "split")


def library(path):
    """The ids of one text, by the library alone."""
    if path.endswith(".model"):
        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    tok = Tokenizer.from_file(path)
    return lambda t: tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_counts_of_any_file(spark, tmp_path, name):
    path, kind = variants(tmp_path)[name]
    assert tokenizer.kind_of(tokenizer.definition_of(path)) == kind
    ids, texts = library(path), [t for t in odd_texts() if t is None or len(t) < 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(df, path).collect()}
    for i, t in enumerate(texts):
        assert got[i] == len(ids(t or "")), t


def test_long_texts_are_cut_where_nothing_is_lost():
    rnd = random.Random(7)
    for kind in (tokenizer.LOWER_WORDS, tokenizer.BYTE_WORDS):
        path = public_tokenizers.path("word_bpe_49k.json" if kind == tokenizer.LOWER_WORDS else "byte_bpe_50k.json")
        ids = library(path)
        for _ in range(60):
            t = "".join(rnd.choice(odd_texts()[:20] + [" ", "\n", "e\u0301", "x y z "]) or "" for _ in range(8))
            parts = list(tokenizer.parts_of(t, kind, 5))
            assert "".join(parts) == t and sum(len(ids(p)) for p in parts) == len(ids(t)), t
    assert list(tokenizer.parts_of("", tokenizer.LOWER_WORDS)) == [] and list(tokenizer.parts_of("a b c", tokenizer.WHOLE_TEXTS, 1)) == ["a b c"]


@pytest.mark.parametrize("name", NAMES)
def test_encode_all(name, tmp_path):
    path = variants(tmp_path)[name][0]
    ids_by_library, texts = library(path), [t or "" for t in odd_texts()]
    definition = tokenizer.definition_of(path)
    got = list(tokenizer.encode_all(pa.array(texts), path, definition))
    assert list(tokenizer.encode_all(pa.array([], pa.string()), path, definition)) == []
    assert [len(x) for x in tokenizer.encode_all(pa.array([None, "a b"]), path, definition)] == [0, len(ids_by_library("a b"))]
    for t, ids in zip(texts, got, strict=True):
        assert ids.tolist() == ids_by_library(t), t


def test_count_tokens_against_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, texts = Tokenizer.from_file(path), odd_texts()
    got = tokencount.count_tokens(docs_of(spark, texts), path).collect()
    want = [(i if i % 7 else None, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert tokencount.count_tokens(docs_of(spark, texts).limit(0), path).count() == 0


def check_pieces(pieces, texts, tok, window=1024):
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], np.uint32) for i, t in enumerate(texts)}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert p.doc_tokens == len(ids[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].astype("<u4").tobytes())
    assert set(by_doc) == set(ids)
    for d, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0
            at += p.length
        assert at == len(ids[d])
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == window or at < window and at & (at - 1) == 0
    return len(by_seq)


@pytest.mark.parametrize("copies", [1, 40])
def test_pack(spark, copies):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rnd = random.Random(copies)
    texts = odd_texts() + [" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.randint(1, 3000))) for _ in range(60)] + ["same words again"] * copies
    df = spark.createDataFrame([Row(doc_id=i, text=t, rest="clash") for i, t in enumerate(texts)])
    check_pieces(packing.pack(df, path).collect(), texts, Tokenizer.from_file(path))
    assert packing.pack(df.limit(0), path).count() == 0


def test_pack_repeated_rows_and_null_ids(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, text = Tokenizer.from_file(path), "the same words again and again " * 300
    rows = [(7, text)] * 700 + [(None, text)] * 5 + [(None, None), (7, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(df, path).collect()
    n = len(tok.encode(text, add_special_tokens=False).ids) + 1
    total = 705 * n + 1 + len(tok.encode("other words", add_special_tokens=False).ids) + 1
    assert sum(p.length for p in pieces) == total and sum(p.length for p in pieces if p.doc_id is None) == 5 * n + 1
    ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
    per = {}
    for p in pieces:
        if p.doc_tokens == n:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            per[p.start] = per.get(p.start, 0) + p.length
    by_seq = {}
    for p in pieces:
        by_seq.setdefault(p.sequence_id, []).append(p)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 1024 or at & (at - 1) == 0


def test_plan_fills_what_it_can():
    rnd = np.random.default_rng(0)
    h = rnd.integers(0, 50, 1024)
    h[0] = 5
    p = packing.plan(h, np.zeros(1024, np.int64))
    assert p.n_rest < 0.25 * (h * np.arange(1024)).sum()
    x = packing.non_negative(packing.combinations_of(16), np.array([0, *[10.0] * 15]))
    assert (x >= 0).all()
    made = sum(n * np.bincount(c[c > 0], minlength=16) for n, c in zip(x, packing.combinations_of(16), strict=True))
    assert np.abs(made[1:] - 10).max() < 0.5
