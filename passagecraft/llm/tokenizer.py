"""Public tokenizers in Python workers: one per worker and file, kept between tasks."""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa

#: Characters that are encoded in one go.
_CHARS = 1 << 20

# What kinds of tokenizers are known by; the word pattern of byte-level tokenizers, and their bytes that stand for themselves.
_LOWER_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_LOWER_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Text whose letters, digits and white space all libraries see alike.
PLAIN_TEXT = re.compile(r"[\t\n\r -~¡§©«®°±·»¿-ÖØ-öø-įı-ňŊ-ž–—‘’“”•…€]*+")


def worker_store() -> dict:
    """What outlives a task in this Python process; functions that travel by value have globals of their own."""
    return sys.modules.setdefault("_passagecraft_worker", types.ModuleType("_passagecraft_worker")).__dict__.setdefault("store", {})


def definition_of(path: str) -> str | bytes:
    """What a tokenizer's file holds: text for the library tokenizers, bytes for sentencepiece (.model)."""
    if path.endswith(".model"):
        with open(path, "rb") as f:
            return f.read()
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Kinds of tokenizers: words in lower case, white space dropped; bytes by words with the space before; any other one.
LOWER_WORDS, BYTE_WORDS, WHOLE_TEXTS = "lower words", "byte words", "whole texts"


def kind_of(definition: str | bytes) -> str:
    """Whether a tokenizer's texts can be cut, and how: only where all of its settings are known to allow it."""
    if isinstance(definition, bytes):
        return WHOLE_TEXTS
    d = json.loads(definition)
    model, pre, normal = d["model"], d.get("pre_tokenizer") or {}, d.get("normalizer")
    plain = model.get("type") == "BPE" and not model.get("dropout")
    for t in d.get("added_tokens", []):
        plain = plain and t["special"] and not any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")) and not re.search(r"\s", t["content"])
    if not plain:
        return WHOLE_TEXTS
    bytes_only = lambda p, words: p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and p.get("use_regex", True) is words
    if normal is None and bytes_only(pre, True):
        return BYTE_WORDS
    steps = pre.get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": _LOWER_PATTERN}, "behavior": "Removed", "invert": True}
    if normal == _LOWER_NORMALIZER and len(steps) == 2 and steps[0] == split and bytes_only(steps[1], False):
        return LOWER_WORDS
    return WHOLE_TEXTS


def loaded(key: str, definition: str | bytes):
    """The tokenizer of a definition."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    store = worker_store()
    if key not in store:
        if isinstance(definition, bytes):
            import sentencepiece

            store[key] = sentencepiece.SentencePieceProcessor(model_proto=definition)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(definition)
            tok.no_truncation()
            tok.no_padding()
            store[key] = tok
    return store[key]


def ids_of(tok, texts: list[str]) -> list[list[int]]:
    """The ids of each text, by either library, without added special tokens."""
    if hasattr(tok, "encode_batch_fast"):
        return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return tok.encode(texts, num_threads=1)


#: Where a text can be cut, by kind: no word of the tokenizer reaches over such a place. A lone space is the head of what
#: follows it, and a lone line end stands alone; each needs visible characters on its two sides.
_CUT = {LOWER_WORDS: re.compile(r"(?<=\s)(?=\S)"), BYTE_WORDS: re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")}


def parts_of(text: str, kind: str, size: int = _CHARS) -> Iterator[str]:
    """The text in parts of about ``size``, if its kind of tokenizer allows cuts."""
    at = 0
    while kind != WHOLE_TEXTS and len(text) - at > size and (m := _CUT[kind].search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    if at < len(text):
        yield text[at:] if at else text


def _merges_by_rank(definition: str | bytes):
    """A faster encoder of the same ids for plain text, if the tokenizer is byte-level with ids in the order of its merges."""
    import tiktoken

    if kind_of(definition) != BYTE_WORDS:
        return None
    d = json.loads(definition)
    model = d["model"]
    if any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    shown = {chr(b): b for b in _PRINTABLE} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
    special = {t["content"] for t in d.get("added_tokens", [])}
    ranks = {bytes(shown[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
    return tiktoken.Encoding("by-rank", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def _plain(text: str) -> bool:
    return "<" not in text and PLAIN_TEXT.fullmatch(text) is not None


def _encoder(key: str, definition: str | bytes) -> tuple[Callable[[list[str]], list[np.ndarray]], int]:
    """A function from texts to their ids, as small as they can be; and how many characters it gets at once."""
    store = worker_store()
    if f"encoder {key}" in store:
        return store[f"encoder {key}"]
    tok, fast, kind = loaded(key, definition), _merges_by_rank(definition), kind_of(definition)
    size = tok.get_vocab_size() if hasattr(tok, "get_vocab_size") else tok.vocab_size()
    small = np.uint16 if size <= 1 << 16 else np.uint32

    def of_text(text: str) -> np.ndarray:
        """By parts; what is plain in one by the faster encoder, what is not by the library, each as far as it reaches."""
        found = []
        for part in parts_of(text, kind):
            if _plain(part):
                found.append(np.array(fast(part), small))
                continue
            for plain, run in groupby(_CUT[kind].split(part), _plain):
                run = "".join(run)
                found.append(np.array(fast(run) if plain else ids_of(tok, [run])[0], small))
        return np.concatenate(found) if len(found) != 1 else found[0]

    def encode(texts: list[str]) -> list[np.ndarray]:
        if fast is None:
            return [np.array(ids, small) for ids in ids_of(tok, texts)]
        return [of_text(t) if t else np.zeros(0, small) for t in texts]

    store[f"encoder {key}"] = encode, _CHARS if fast is None else 0
    return store[f"encoder {key}"]


def encode_all(texts: pa.Array, key: str, definition: str | bytes) -> Iterator[np.ndarray]:
    """The ids of each text (null: empty) as the library gives them without added special tokens.

    A few texts at a time are in memory as ids; a long one is cut where its tokenizer allows it.
    """
    encode, chars = _encoder(key, definition)
    held, size = [], 0
    for text in texts:
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield from encode(held)
            held, size = [], 0
    if held:
        yield from encode(held)
