import base64
import gzip
import hashlib

from pyspark.sql import Row

from passagecraft.llm import warc
from passagecraft.llm.common import Tables, scratch


def pages():
    rows = [Row(page_id=i, url=f"http://x/{i}", html=f"<p>page {i % 17} é</p>" * (1 + i % 5), digest="clash", shard=1) for i in range(200)]
    rows += [Row(page_id=1000, url=None, html=None, digest="", shard=0), Row(page_id=1001, url="u", html="", digest="", shard=0), Row(page_id=-5, url="u", html="z" * 400_000, digest="", shard=0)]
    rows += [Row(page_id=None, url="u", html="<p>nobody</p>", digest="", shard=0), Row(page_id=1 << 62, url="far\r\naway ", html="far", digest="", shard=0), Row(page_id=7, url="again", html="<p>page 7 é</p>" * 3, digest="", shard=0)]
    return rows


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, shard int")
    archive = warc.write_archive(df, scratch(spark, "warc"), roll_bytes=1500, shard_bytes=6000)
    assert len(archive.files) > 3 and sum(f["records"] for f in archive.files) == len(rows)
    got = warc.read_archive(spark, archive).collect()
    assert sorted((str(r.page_id), str(r.url)) for r in got) == sorted((str(r.page_id), str(r.url)) for r in rows)
    for f in archive.files:
        with gzip.open(f"{archive.path.removeprefix('file://')}/{f['name']}") as stream:
            data = stream.read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and data.count(b"WARC-Type: warcinfo") == 1
    payloads = {}
    for r in rows:
        payloads.setdefault((r.html or "").encode(), []).append(r.page_id)
    digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    of = {digest(k): max((i for i in v if i is not None), default=None) for k, v in payloads.items()}
    text = {digest(k): k for k in payloads}
    responses = {}
    for r in got:
        assert r.payload_bytes == len(text[r.payload_digest])
        if r.record_type == "response":
            assert r.page_id == of[r.payload_digest] and r.payload == text[r.payload_digest] and r.refers_to is None
            responses[r.payload_digest] = r.page_id
        else:
            assert r.record_type == "revisit" and r.refers_to == of[r.payload_digest] and r.payload is None
    assert responses == of


def test_same_files_again(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string, digest string, shard int")
    a = warc.write_archive(df, scratch(spark, "warc"), roll_bytes=1500, shard_bytes=6000)
    b = warc.write_archive(df.repartition(7), scratch(spark, "warc"), roll_bytes=1500, shard_bytes=6000)
    assert a.files == b.files
    local = a.path.removeprefix("file://")
    with open(f"{local}/{a.files[0]['name']}", "rb") as f:
        data = f.read()
    assert hashlib.sha256(data).hexdigest() == a.files[0]["sha256"] and gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write_archive(df, scratch(spark, "warc"))
    assert archive.files == [] and warc.read_archive(spark, archive).count() == 0


def test_a_shard_is_a_task(spark):
    df = spark.createDataFrame([(i, f"u{i}", f"{i} " * 2000) for i in range(60)], "page_id long, url string, html string")
    archive = warc.write_archive(df, scratch(spark, "warc"), shard_bytes=100_000)
    assert {f["name"][:11] for f in archive.files} == {f"part-{i:06d}" for i in range(len(archive.files))} and len(archive.files) >= 4
    assert max(f["records"] for f in archive.files) <= 2 * min(f["records"] for f in archive.files)


def jobs_of(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = f()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_bounds_take_the_same_jobs_for_any_number_of_shards(spark):
    sizes = spark.range(20_000).selectExpr("id * 977 - 5000000 as page_id", "id % 700 as n_bytes").union(spark.range(50).selectExpr("null", "10"))
    keys = sorted((i * 977 - 5_000_000, i % 700 + 512) for i in range(20_000))
    took = []
    for shard in (400_000, 3_000):
        want, upto, last = [], 0, 0
        for k, n in keys:
            if upto // shard != last:
                want.append(k)
                last = upto // shard
            upto += n
        got, n = jobs_of(spark, f"bounds {shard}", lambda s=shard: warc.shard_bounds(sizes.repartition(5), Tables(), s))
        assert got == want
        took.append(n)
    assert len(want) > 4000 and took[0] == took[1] <= 12


def test_many_pages_without_an_id(spark):
    rows = [(None, f"u{i}", f"{i % 40} " * 500) for i in range(200)] + [(7, "named", "3 " * 500), (8, "other", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(df, scratch(spark, "warc"), shard_bytes=20_000)
    assert len({f["name"][:11] for f in archive.files}) > 4
    got = warc.read_archive(spark, archive).collect()
    assert len(got) == 202 and sum(r.record_type == "response" for r in got) == 197  # five refer to 7; what has no id is never referred to
    assert all(r.refers_to == 7 for r in got if r.page_id is None and r.payload_bytes == 1000 and r.payload_digest == next(x.payload_digest for x in got if x.page_id == 7))
