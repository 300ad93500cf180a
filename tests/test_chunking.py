import random

import pytest
from pyspark.sql import functions as F

from passagecraft.operators import chunking, splitting
from passagecraft.schema import SWEEP, ChunkConfig


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("abcdefghij", 4, 1, [(0, "abcd"), (3, "defg"), (6, "ghij")]),
        ("abcd", 4, 1, [(0, "abcd")]),
        ("", 4, 1, []),
        ("ab      ", 2, 0, [(0, "ab")]),
        ("abc", 2, 2, [(0, "ab"), (1, "bc")]),
    ],
)
def test_windows(spark, text, size, overlap, want):
    assert list(splitting.windows(text, size, overlap)) == want
    got = spark.createDataFrame([(text,)], "t string").select(chunking.windows(F.col("t"), size, overlap).alias("w")).first()["w"]
    assert [tuple(x) for x in got] == want


def test_sections():
    assert splitting.sections("pre\n# A\nx\n### C\ny\n## B\nz") == [(0, "", "pre\n"), (4, "A", "# A\nx"), (10, "A > C", "### C\ny"), (18, "A > B", "## B\nz")]
    assert splitting.sections("no heading") == [(0, "", "no heading")]
    assert splitting.sections("#\n\nnext")[0][1] == "next"


def test_packing_with_carry():
    body = (0, "", "aaaa\nbbbb")
    assert splitting.packed(body, 8, 3) == [(0, "", "aaaa"), (1, "", "aaa\nbbbb"), (6, "", "bbb")]
    assert splitting.packed(body, 8, 0) == [(0, "", "aaaa"), (4, "", "bbbb")]
    assert splitting.packed((0, "", "aaaa"), 8, 3) == [(0, "", "aaaa")]


def plain_packed(body, size, overlap):
    """Step by step, on a list of lines."""
    out, lines, at = [], [], 0
    count = 0

    def end():
        nonlocal lines, count, at
        t = "\n".join(lines).strip()
        lines, count = [], 0
        if t:
            out.append((at, t))
            if overlap:
                lines, count = [t[-overlap:]], len(t[-overlap:])
            at += max(0, len(t) - overlap) if overlap else len(t)

    for a in splitting.atoms(body):
        if len(a) > size:
            end()
            out.extend((at, w) for _, w in splitting.windows(a, size, overlap))
            at += len(a)
            continue
        if count > 0 and count + len(a) + 1 > size:
            end()
        lines.append(a)
        count += len(a) + 1
    end()
    return out


def test_properties_of_packing(spark):
    rnd = random.Random(1)
    parts = ["word", " ", "\n", "\n\n", "|", "# H\n", "## G\n", ". ", "x" * 90, "é"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 120))) for _ in range(150)]
    for t in texts:
        for size, overlap in ((50, 0), (50, 20), (120, 30)):
            if len(t) > size:
                assert [(a, x) for a, _, x in splitting.packed((0, "", t), size, overlap)] == [p for p in plain_packed(t, size, overlap) if p[1].strip()]
            for strategy in ("heading", "recursive"):
                assert all(len(p[2]) <= size + overlap + 1 for p in splitting.split(t, strategy, size, overlap))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chunking.atoms(F.col("t")).alias("a")).collect():
        assert list(r.a) == list(splitting.atoms(r.t)), r.t


def test_chunk_columns_and_pages(spark):
    rows = [("D1", "Title", "# A\n" + "one two\n" * 30 + "# B\nthree", [(0, 1), (100, 2)]), ("D2", "", "short", []), ("D3", None, "", None)]
    docs = spark.createDataFrame(rows, "document_id string, title string, text string, page_breaks array<struct<start:int,page:int>>")
    for cfg in SWEEP:
        got = chunking.chunk(docs, cfg).orderBy("document_id", "chunk_index").collect()
        assert [r.chunk_index for r in got if r.document_id == "D1"] == list(range(sum(r.document_id == "D1" for r in got)))
        assert all(r.char_end - r.char_start == r.n_chars == len(r.text) for r in got)
    fixed = chunking.chunk(docs, ChunkConfig("fixed", 120, 0)).where("document_id = 'D1'").orderBy("chunk_index").collect()
    assert [r.page for r in fixed] == [1, 2, 2] and fixed[0].section == "A" and fixed[0].embed_text.startswith("[Title > A]\n") and fixed[0].label == "Title > A > p.1"
    short = chunking.chunk(docs).where("document_id = 'D2'").first()
    assert short.chunk_id == "D2::0" and short.embed_text == "[D2]\nshort" and short.page is None


def test_as_of(spark):
    breaks = "array(named_struct('start',10,'page',1), named_struct('start',100,'page',2))"
    got = spark.sql(f"select explode(array(0,10,50,100,120)) at, {breaks} b").select(chunking.as_of(F.col("b"), F.col("at"), "page").alias("p")).collect()
    assert [r.p for r in got] == [None, 1, 1, 2, 2]


def test_stats(spark):
    s = chunking.stats(spark.createDataFrame([(1,), (2,), (3,), (4,)], "n_chars int")).first()
    assert (s["count"], s["min"], s["median"], s["max"], s["mean"], s["total_chars"]) == (4, 1, 3, 4, 2, 10)


def test_config_is_checked():
    with pytest.raises(ValueError):
        ChunkConfig("fixed", 10, 10)
    with pytest.raises(ValueError):
        ChunkConfig("other")
    assert ChunkConfig().slug == "recursive_800_150"
