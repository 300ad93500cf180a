import random

import pytest
from pyspark.sql import functions as F

from passagecraft.operators import asof, containment


def plain_asof(left, right, strict):
    out = []
    for i, k, t in left:
        some = [(rt, v) for rk, rt, v in right if None not in (k, t, rk, rt) and rk == k and (rt < t or rt == t and not strict)]
        out.append((i, k, t, max(some, key=lambda r: (r[0], r[1] is not None, r[1] or 0), default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_with_a_hot_key(spark, strict):
    rnd = random.Random(6)
    pick = lambda: rnd.choice(["hot"] * 6 + ["a", "b", "c", None, ""])
    at = lambda: rnd.choice([None, *range(300)])
    left = [(i, pick(), at()) for i in range(900)] + [(5000, "hot", 7)] * 3 + [(6000, "alone", 5)]
    right = [(pick(), at(), rnd.randrange(50)) for i in range(500)] + [("hot", 7, None), ("hot", 7, 3), ("hot", 7, 3)]
    l, r = spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "k string, t long, v int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof.asof_join(l.repartition(3), r.repartition(2), "t", "t", ["k"], strict).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(((x.i, x.k, x.t, x.found and (x.found.t, x.found.v)) for x in got), key=str) == plain_asof(left, right, strict)


def test_asof_without_keys_and_of_nothing(spark):
    l, r = spark.createDataFrame([(1, 5.0), (2, 1.0), (3, None)], "i int, t double"), spark.createDataFrame([(2.0, "x"), (4.0, "y")], "u double, l string")
    rows = lambda df: sorted((x.i, x.found and x.found.l) for x in df.collect())
    assert rows(asof.asof_join(l, r, "t", "u")) == [(1, "y"), (2, None), (3, None)]
    assert rows(asof.asof_join(l, r.limit(0), "t", "u")) == [(1, None), (2, None), (3, None)] and asof.asof_join(l.limit(0), r, "t", "u").count() == 0


@pytest.mark.parametrize("chars", [1 << 21, 60])
def test_contained_against_a_plain_search(spark, chars):
    rnd = random.Random(chars)
    text = lambda n: "".join(rnd.choice("abAB É\n") for _ in range(rnd.randrange(n)))
    texts = [(i, text(60)) for i in range(200)] + [(500, None), (501, ""), (None, "abab"), (7, "abab"), (502, "ab" * 200_000)]
    needles = [(i, text(5)) for i in range(80)] + [(90, None), (91, ""), (92, "AB"), (92, "AB"), (None, "ba"), (93, "ab" * 300)]
    n, t = spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(texts, "doc_id long, text string").withColumn("needle", F.lit("own"))
    got = containment.contained(n, t, chars).collect()
    want = [(i, d) for i, x in needles for d, y in texts if x is not None and y is not None and x.lower() in y.lower()]
    assert sorted(((r.needle_id, r.doc_id) for r in got), key=str) == sorted(want, key=str)
    assert containment.contained(n.limit(0), t).count() == 0 and containment.contained(n, t.limit(0)).count() == 0
