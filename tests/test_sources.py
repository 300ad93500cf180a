from pyspark.sql import functions as F

from passagecraft.functions import text as tx
from passagecraft.sources import files, markup, pages

PAGE = """<html><head><meta name="effective_date" content="2026-01-02"><meta name="Author" content="A. B"><title>A  page</title></head><body><nav><li>menu</li></nav>
<blockquote>outside</blockquote><main><h1>Top</h1><p>One <b>two</b>\n three</p><div>lost</div><ul><li>item</li></ul>
<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td><p>2</p></td></tr></table><h2>Next</h2><p></p></main><footer>foot</footer></body></html>"""


def test_html():
    text, meta = markup.parse(PAGE)
    assert text == "# Top\n\nOne two three\n- item\n\na | b\n1 | 2\n\n\n## Next".replace("\n\n\n", "\n\n")
    assert meta == {"effective_date": "2026-01-02", "Author": "A. B", "title": "A  page"}
    assert markup.parse("") == ("", {})
    assert markup.parse("<p>one<p>two")[0] == "one two\ntwo"
    assert markup.parse("<p> a\n  b <i>c  d</i><!-- x -->e &lt; 5 &amp; f</p>")[0] == "a\n  b c  d e < 5 & f"
    assert markup.parse("<li></li><h2> </h2>")[0] == "- \n\n##"
    assert markup.parse("<title></title><title>Second</title>")[1] == {}


def test_open_references():
    page = "<title>a &amp; &amp</title><p>&ltb &lt;c&gt; &nope; &#38; &#38</p>"
    assert markup.parse(page) == ("<b <c> &nope; & &", {"title": "a & &"})
    assert markup.parse(page, open_references=False) == ("&ltb <c> &nope; & &#38", {"title": "a & &amp"})


def test_titles_cut_within_a_reference(spark, tmp_path):
    import duckdb

    from passagecraft.plans.queries import QUERIES, SQL

    rows = [(1, "<title>This &amp; that &quot;&amp;&quot; &amp</title>"), (2, "<title> plain </title>"), (3, "<p>none</p>"), (4, "<title>&amp;quot; &am</title>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    want = duckdb.sql(SQL["html_title"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["html_title"](spark, str(tmp_path)).collect())) == sorted(want)
    assert dict(want)[1] == 'This & that "&" &amp'


def test_promote(spark):
    cases = {"Page 3 of 12": "", "4 / 20": "", "PART - A": "\n## PART - A\n", "PREAMBLE": "\n## PREAMBLE\n", "Part C of this document": "Part C of this document", "4.2 Termination": "\n### 4.2. Termination\n\n4.2 Termination"}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", pages.promote_line(F.col("s")).alias("p")).collect()
    assert {r.s: r.p for r in got} == cases


def test_join_pages(spark):
    df = spark.createDataFrame([("d", 2, "second\nline"), ("d", 1, "  PART A \nfirst"), ("d", 3, " \n "), ("d", 4, "last"), ("e", 1, None)], "document_id string, page_no int, raw_text string")
    r = pages.join_pages(df).collect()
    assert len(r) == 1 and r[0].text == "## PART A\n\nfirst\n\nsecond\nline\n\nlast"
    assert [(b.start, b.page) for b in r[0].page_breaks] == [(0, 1), (18, 2), (31, 4)]


def test_corpus(spark, tmp_path):
    root = tmp_path / "corpora" / "mine" / "policy"
    root.mkdir(parents=True)
    (root / "my-file_one.md").write_text("just text\n")
    (root / "two.md").write_text("---\ntitle: Own\neffective_date: 2026-04-01\nversion: 3\nempty:\n---\n# H\nbody\n")
    (root / "three.HTML").write_text(PAGE)
    (root / "blank.txt").write_text("  \n")
    (root / "skip.csv").write_text("a,b")
    (root / ".hidden.md").write_text("no")
    (root.parent / "metadata.yaml").write_text("my-file_one.md: {title: T, effective_date: null, owner: me}\n")
    got = {r.filename: r for r in files.read_corpus(spark, str(root.parent), "mine").collect()}
    assert set(got) == {"my-file_one.md", "two.md", "three.HTML"}
    one, two = got["my-file_one.md"], got["two.md"]
    assert (one.document_id, one.title, one.doc_type, one.effective_date, one.relpath) == ("MY-FILE_ONE", "T", "policy", "", "policy/my-file_one.md") and one.extra == {"owner": "me"}
    assert (two.title, two.effective_date, two.text) == ("Own", "2026-04-01", "# H\nbody") and two.extra == {"version": "3"}
    assert got["three.HTML"].effective_date == "2026-01-02"
    assert [tuple(r) for r in files.list_corpora(spark, str(tmp_path / "corpora")).collect()] == [("mine", 4)]
    assert files.save_uploads(str(root), [("../../x/evil.md", b"hi"), ("a.exe", b"")], replace=True) == ["evil.md"]
    assert sorted(p.name for p in root.iterdir()) == ["evil.md"]


def test_questions(spark):
    q = files.read_questions(spark, "- {id: a, question: what, kind: answerable, expect_text: [x, y]}\n- {id: b, question: q, kind: unanswerable, near_miss: true}\n").collect()
    assert q[0].expect_text == ["x", "y"] and q[1].near_miss is True and q[1].expect_text is None


def test_titles(spark):
    cases = ["form10k annual", "o'brien's NOTE", "2nd éclair", "x", "", "a1b2 c", "ÉTUDE 日本go", "3"]
    got = spark.createDataFrame([(c,) for c in cases], "s string").select("s", tx.title_case(F.col("s")).alias("t")).collect()
    assert {r.s: r.t for r in got} == {c: c.title() for c in cases}


def test_names_and_numbers(spark):
    r = spark.sql("select 'My Docs!' a, '---' b, '\\u00a0\\n x \\u00a0' c").select(tx.safe_name(F.col("a")).alias("a"), tx.safe_name(F.col("b")).alias("b"), tx.strip(F.col("c")).alias("c"), tx.model_tag(F.lit("BAAI/bge-small-en-v1.5")).alias("m"), tx.half_even(F.lit(2.5)).alias("h")).first()
    assert tuple(r) == ("my_docs", "corpus", "x", "bgesmallenv15", 2.0)


def test_files_with_pages(spark, tmp_path):
    import json

    def read(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("no pages here")
        return json.loads(content[4:]), {"title": "Of Pages", "author": "nobody"}

    root = tmp_path / "corpus" / "terms"
    root.mkdir(parents=True)
    raw = ["Page 1 of 4\nSECTION 1 SCOPE\nfirst page", " \n", "last words\nof it", "é end"]
    (root / "a.PDF").write_bytes(b"%PDF" + json.dumps(raw).encode())
    (root / "b.pdf").write_bytes(b"other")
    (root / "c.md").write_text("plain")
    docs = {r.document_id: r for r in files.read_corpus(spark, str(tmp_path / "corpus"), read_pages=read).collect()}
    assert set(docs) == {"A", "C"} and docs["A"].title == "Of Pages" and docs["A"].extra["author"] == "nobody"
    text, breaks = docs["A"].text, [(b.start, b.page) for b in docs["A"].page_breaks]
    assert [p for _, p in breaks] == [1, 3, 4]  # in order; a page without text is none, but keeps its number
    cut = [text[s:e] for (s, _), e in zip(breaks, [b[0] - 2 for b in breaks[1:]] + [len(text)], strict=True)]
    assert cut[1:] == ["last words\nof it", "é end"] and cut[0].endswith("first page") and "## " in cut[0] and "Page 1 of 4" not in cut[0]
    assert [r.error for r in files.failures(spark, str(tmp_path / "corpus"), read).collect()] == ["ValueError: no pages here"]
