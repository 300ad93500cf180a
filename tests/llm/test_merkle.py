from hashlib import sha256

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from passagecraft.llm import common, merkle

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*inputs):
    return sha256("".join(inputs).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    """The levels of a tree over nodes, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, place):
    """(before, after) for each level below the root."""
    out = []
    for level in levels[:-1]:
        at = place // 3 * 3
        out.append(("".join(level[at:place]), "".join(level[place + 1 : at + 3])))
        place //= 3
    return out


def plain(rows, alter):
    """(doc_id, leaf, altered leaf, subroot, root, steps) of each row, by lists."""
    leaf = lambda r: h(*(field(r[c]) for c in COLUMNS))
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    trees = {}
    for g, some in groups.items():
        some.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in some])
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order]) if order else []
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            other = leaf({**r, "text": alter(r["text"])})
            out.append((r["doc_id"], leaf(r), other if other != leaf(r) else None, trees[g][-1][0], top[-1][0], way(trees[g], i) + way(top, k)))
    return out


def fold(node, steps):
    for before, after in steps:
        node = h(before, node, after)
    return node


def seen(df):
    return sorted(((r.doc_id, r.leaf, r.altered_leaf, r.subroot, r.root, [(s.before, s.after) for s in r.steps]) for r in df.collect()), key=str)


def make(spark, rows):
    return spark.createDataFrame([Row(**r) for r in rows], "doc_id long, source string, lang string, n_chars long, text string")


def row(doc_id, source, text="a\nb"):
    return dict(doc_id=doc_id, source=source, lang=["en", None][(doc_id or 0) % 2], n_chars=None if text is None else len(text), text=text)


SIZES = {"a": 1, "b": 2, "c": 3, "d": 4, None: 9, "": 10, "é": 27, "z": 28, "-": 40, "1:x": 5}


@pytest.mark.parametrize("tier", [1, 5])
def test_against_plain_trees(spark, monkeypatch, tier):
    monkeypatch.setattr(merkle, "TIER", tier)
    monkeypatch.setattr(merkle, "_BLOCK", 3**tier)
    rows = [row(i * 100 + k, s, f"{s} text\n{i}" if i % 4 else None) for k, (s, n) in enumerate(SIZES.items()) for i in range(min(n, 9 if tier == 1 else 99))]
    got = merkle.manifest(make(spark, rows).repartition(3), COLUMNS, "source", "doc_id", F.replace("text", F.lit("\n"), F.lit("")))
    assert seen(got) == sorted(plain(rows, lambda t: t and t.replace("\n", "")), key=str)
    for r in merkle.proven(got, "doc_id").collect():
        assert r.verified == (r.folded_root == r.root)
    proven = {r.doc_id: r for r in merkle.proven(got, "doc_id").collect()}
    for doc_id, leaf, other, _, _, steps in plain(rows, lambda t: t and t.replace("\n", "")):
        assert proven[doc_id].folded_root == fold(other or leaf, steps) and proven[doc_id].proof_sha256 == h(*(b + a for b, a in steps))
        assert proven[doc_id].verified == (other is None)


def test_a_source_of_more_than_a_block(spark):
    rows = [row(i, "hot", f"t{i}") for i in range(600)] + [row(1000 + i, f"s{i:03}") for i in range(250)]
    got = merkle.manifest(make(spark, rows).repartition(5), COLUMNS, "source", "doc_id")
    assert seen(got) == sorted(plain(rows, lambda t: t), key=str)


def test_odd_rows(spark):
    rows = [row(None, None, None), row(None, None, None), row(None, "a", ""), row(7, "a"), row(7, "a"), row(7, "a", "other"), row(7, "b"), row(3, "a", "x" * 3_000_000), row(0, None, "\n")]
    docs = make(spark, rows).withColumns({n: F.lit("own") for n in ("key", "named", "node", "altered", "node_group", "place", "size", "steps", "level", "rank_line", "rank_part")})
    got = merkle.manifest(docs, COLUMNS, "source", "doc_id", F.replace("text", F.lit("\n"), F.lit("")))
    want = plain(rows, lambda t: t and t.replace("\n", ""))
    assert seen(got) == sorted(want, key=str)
    for some in (rows[:1], rows[3:4]):
        one = merkle.proven(merkle.manifest(make(spark, some), COLUMNS, "source", "doc_id"), "doc_id").first()
        assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h("") and one.verified
    assert merkle.manifest(docs.limit(0), COLUMNS, "source", "doc_id").count() == 0


def test_places_of_a_hot_group_are_dealt_out(spark):
    df = spark.createDataFrame([("a", 1)] * 500 + [("b", i) for i in range(30)] + [(None, None)] * 3, "g string, x int").repartition(4)
    tables = common.Tables()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = common.ranked(df, ["g"], [F.col("x")], tables, "place", "size").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g, n in (("a", 500), ("b", 30), (None, 3)):
        assert sorted(r.place for r in got if r.g == g) == list(range(n)) and {r["size"] for r in got if r.g == g} == {n}
    assert all(r.place == r.x for r in got if r.g == "b")
    ranges = spark.read.parquet(tables.paths[0][1])
    held = ranges.where("g = 'a'").groupBy(F.shiftrightunsigned("rank_line", 33)).count().collect()
    assert len(held) > 1  # equal rows, too, are in several ranges
