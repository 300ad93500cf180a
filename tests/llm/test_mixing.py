import random
import re

import pytest
from pyspark.sql import Row

from passagecraft.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is over a cap goes to the others, until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(w[s] for s in names if s not in full)
        target = {s: float(most * sizes[s]) if s in full else rest * w[s] / open_weight for s in names}
        over = {s for s in names if target[s] > most * sizes[s] * (1 + 1e-12) and s not in full}
        if not over:
            return target
        full |= over


def test_mix_against_brute_force(spark):
    rnd = random.Random(0)
    rows = [Row(doc_id=i, text=" ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(0, 60))), source=rnd.choice(["b", "a", "Z", "é", None, "hot", "hot", "hot"]), mix_size="clash") for i in range(4000)]
    rows += [Row(doc_id=9000, text=None, source="a", mix_size=""), Row(doc_id=None, text="one two", source="b", mix_size=""), Row(doc_id=9001, text=" \t\x0b one\xa0two ", source="tiny", mix_size="")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    want = plain_targets(sizes)
    got = mixing.allotment(df).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(got) == len(rows)
    for r in got:
        d = by_id[r.doc_id]
        assert r["size"] == size(d.text) and r.source_size == sizes[d.source] and r.target == pytest.approx(want[d.source])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[d.source] = taken.get(d.source, 0) + r.taken
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.15, abs=3)
    assert sorted(map(tuple, mixing.allotment(df).collect()), key=str) == sorted(map(tuple, got), key=str)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and sum(size(r.text) for r in mixed.collect()) == sum(taken.values())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.allotment(df).count() == 0 and mixing.mix(df).count() == 0
    one = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.allotment(one).collect()] == [0, 0]
