import random

from pyspark.sql import Row
from xxhash import xxh64_intdigest

from passagecraft.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    seen, out = set(), {}
    for a in fps:
        if a in seen:
            continue
        seen.add(a)
        group, todo = [a], [a]
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in seen and (x ^ y).bit_count() <= 3:
                    seen.add(y)
                    group.append(y)
                    todo.append(y)
        out |= dict.fromkeys(group, min(group))
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_against_all_pairs(spark):
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(120)}
    for f in list(fps)[:40]:  # chains and clusters
        for _ in range(rnd.randint(1, 4)):
            for _ in range(rnd.randint(1, 4)):
                f ^= 1 << rnd.randrange(64)
            fps.add(f)
    fps |= {0, (1 << 64) - 1, 1, 7, 15}
    df = spark.createDataFrame([(i, signed(f)) for i, f in enumerate(sorted(fps))], "doc_id long, fp long")
    want = plain_components(sorted(fps))
    ids = {f: i for i, f in enumerate(sorted(fps))}
    least = {}
    for f, r in want.items():
        least[r] = min(least.get(r, 1 << 60), ids[f])
    got = {r["fp"]: r["component_id"] for r in simhash.classes(df).collect()}
    assert got == {signed(f): least[want[f]] for f in fps}


def test_large_cell_is_split_without_loss(spark):
    rnd = random.Random(6)
    base, fps = rnd.getrandbits(64), set()
    while len(fps) < 90:
        f = base
        for _ in range(rnd.randint(0, 5)):
            f ^= 1 << rnd.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    links = simhash.near_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), block=8)
    from passagecraft.llm.components import components

    got = {r.node: r.root for r in components(links).collect()}
    want = plain_components(fps)
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(signed(f))
    for g in groups.values():
        assert {got.get(f, f) for f in g} == {min(g)}


def test_texts_nulls_ties_and_long(spark):
    texts = [None, "", " \n\t", "One", "one", "two words", "A b C d e", "a B c d e", "é ß x y z", "w " * 70_000 + "end", "É ß x y z", " a b c d"]
    df = spark.createDataFrame([Row(doc_id=i, text=t, fp="clash", component_id=-1) for i, t in enumerate(texts)] + [Row(doc_id=None, text="one", fp="", component_id=0)])
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    for i, t in enumerate(texts):
        assert got[i].fp == signed(plain_fingerprint(t)), t
    assert got[1].component_id == got[2].component_id == 0
    assert got[None].component_id == got[4].component_id == 3
    kept = [r.doc_id for r in simhash.keep_one(df).collect()]
    assert len(kept) == len(set(kept)) and {0, 3, 6} <= set(kept) and not {1, 2, 4, 7, None} & set(kept)
    assert simhash.keep_one(df).columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_null_ids_keep_a_row(spark):
    df = spark.createDataFrame([(None, "same words here"), (None, "same words here"), (5, "other text at all")], "doc_id long, text string")
    assert sorted(simhash.keep_one(df).collect(), key=str) == [Row(doc_id=5, text="other text at all"), Row(doc_id=None, text="same words here")]
