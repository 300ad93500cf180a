import math
import random

from pyspark.sql import functions as F

from passagecraft.llm import topk


def plain(rows, k, every):
    v = {}
    good = [(i, x) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    for i, x in good:
        v.setdefault(i, []).append([math.floor(256 * c) for c in x])
    out = {}
    for q in v:
        if q % every == 0:
            own = min(v[q])
            scored = sorted(((-sum(a * b for a, b in zip(own, c)), i) for i, cs in v.items() if i != q for c in cs))[:k]
            for n, (s, i) in enumerate(scored):
                out[q, n + 1] = (i, -s)
    return out


def run(spark, rows, k=5, every=10, **how):
    df = spark.createDataFrame([(i, x, "clash") for i, x in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % every == 0, k, **how).collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, 0.3) for _ in range(6)]) for i in range(400)]
    rows += [(1000 + i, [0.5, 0.1, 0.0, -0.2, 0.3, 0.9]) for i in range(150)]  # ties
    rows += [(2000, None), (2010, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (2020, [float("nan")] * 6), (2030, [float("inf")] + [0.0] * 5), (None, [0.1] * 6), (5, rows[5][1]), (20, [9.0] * 6), (3001, [1.0, 2.0]), (3003, [])]
    assert run(spark, rows) == plain(rows, 5, 10)
    assert run(spark, rows, query_block=7) == plain(rows, 5, 10)


def test_few_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1): (1, 256 * 512)}
    assert run(spark, [(0, [1.0])]) == {} and run(spark, [(1, [1.0])]) == {} and run(spark, []) == {}


def test_scores_beyond_the_integers_that_floats_hold(spark):
    rows = [(i, [1e6 * (i - 3) + i, 3.0 + i / 7]) for i in range(12)]
    want = plain(rows, 3, 4)
    assert 1 << 53 < max(abs(s) for _, s in want.values()) < 1 << 63
    assert run(spark, rows, k=3, every=4) == want


def test_scores_beyond_64_bits_are_held_at_the_ends(spark):
    rows = [(i, [1e9 * (i - 3), 3.0]) for i in range(8)]
    held = {}
    for q in (0, 4):
        a = [math.floor(256 * c) for c in rows[q][1]]
        scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * math.floor(256 * c) for x, c in zip(a, v)))), i) for i, v in rows if i != q)[:3]
        held |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(scores)}
    assert run(spark, rows, k=3, every=4) == held
