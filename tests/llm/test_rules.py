import random
import re

import numpy as np
from pyspark.sql import functions as F

from passagecraft.llm import rules


def plain(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                covered |= set(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_against_brute_force(spark):
    rnd = random.Random(9)
    parts = ["a", "bb", " ", "  ", "\n", "\t", "é", "#", "a b c d e f g h ", "a b c d e f g h i\n", "\xa0", "|", "z\r"]
    texts = [None, "", " ", "x", "a " * 7, "a " * 8, "a " * 9, "a " * 30_000] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame([(i if i % 3 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    for r in rules.with_statistics(df).select("text", "stats.*").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(r.text), r.text
    assert rules.with_statistics(df.limit(0)).count() == 0


def corpus(spark, n=600):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(rnd.randint(25, 90))]
        if bad:
            words = [w + rnd.choice(["***", "%%%", "$$$"]) for w in words] if i % 2 else [words[0]] * 12 + words
            if i % 2 == 0:
                words = [x for w in words for x in (w, words[0], words[1])]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels + [(0, None), (None, 0), (99999, 1)], "doc_id long, quality int")


def test_learns_and_keeps(spark):
    docs, labels = corpus(spark)
    found = rules.learn_from(docs, labels, max_labelled=400)
    assert found.rules
    got = rules.assess(docs, found).select("doc_id", "kept", "rule", "base_failed").collect()
    right = sum(r.kept == (r.doc_id % 5 != 0) for r in got)
    assert right >= 0.97 * len(got)
    plan = rules.assess(docs, found)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    # the verdict by a plain reading of the rules' own text, over statistics counted without the operator
    for r in rules.assess(docs, found).select("doc_id", "text", "kept", "rule").collect():
        n_words, chars, symbols, dup_lines, repeats = plain(r.text)
        lines = [x for x in r.text.split("\n") if x.strip()]
        value = {
            "n_words": n_words, "word_length": chars / n_words, "symbol_share": symbols / chars, "dup_line_share": dup_lines / len(lines), "repeat_share": repeats / n_words,
            "distinct_share": len(set(r.text.split())) / n_words, "mark_share": sum(map(r.text.count, "!?")) / chars, "digit_share": sum(c.isdigit() for c in r.text) / chars,
        }
        says = None
        for rule in found.rules:
            if says is None and all(value[c.feature] > c.bound if c.above else value[c.feature] <= c.bound for c in rule):
                says = " and ".join(map(str, rule))
        assert r.rule == says
        assert r.kept == (says is None and n_words >= 20 and 100 * repeats <= 30 * n_words)
    # rules say in SQL what they say in Python
    stats = rules.with_statistics(docs)
    made = rules.features(F.col("stats"))
    x = np.array([list(r) for r in stats.select(*(made[f] for f in rules.FEATURES), F.col("doc_id")).collect()])
    hit = {int(r[-1]) for r, h in zip(x, np.any([rules._cover(rule, x[:, :-1]) for rule in found.rules], axis=0), strict=True) if h}
    assert {r.doc_id for r in got if r.rule is not None} == hit


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "w " * 40), (2, None), (3, "one two three"), (4, " ".join(f"w{i}" for i in range(40)))], "doc_id long, text string")
    none = rules.learn_from(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert list(none.rules) == []
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.assess(docs, none).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, False), 4: (False, True)}
