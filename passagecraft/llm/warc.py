"""Deterministic sharded WARC archives: a writer that range-sorts records and commits by manifest, and a reader.

Shards are ranges of the record key with about equal payload, cut from exact sums rather than samples, so that another
run on the same rows makes the same files. A task writes its records in order, each a gzip member of its own, under
temporary names, and begins another file when one has reached its compressed size. The driver then gives the files of
the attempts that counted their final names and writes the manifest; whatever else was left is removed.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Tables, delete

#: Compressed bytes after which a file is closed, payload bytes of a shard.
ROLL_BYTES = 64 << 20
SHARD_BYTES = 256 << 20
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A header for URLs that can't stand in one as they are: null, empty, or with white space that would not come back.
_EXACT = "X-Exact-URI"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(data: bytes) -> str:
    """Base32 of the SHA-1, in upper case."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One record, response or (with refers_to, a record's id) revisit, as a gzip member; equal input, equal bytes."""
    block = _HTTP % len(payload) + (b"" if refers_to else payload)
    said = " ".join((url or "urn:none").split())
    exact = [] if said == url else [f"{_EXACT}: {'-' if url is None else base64.b64encode(url.encode()).decode()}"]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {said}",
        *exact,
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        *([f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_PROFILE}"] if refers_to else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return _member(head, block)


def _member(head: list[str], block: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # no time and no name in a gzip header made so
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def file_name(shard: int, part: int) -> str:
    return f"part-{shard:06d}-{part:05d}.warc.gz"


def info(shard: int, part: int, date: str = DATE) -> bytes:
    """The record that every file begins with."""
    block = b"software: passagecraft\r\nformat: WARC File Format 1.1\r\n"
    name = file_name(shard, part)
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:file:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return _member(head, block)


def _open(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _write_rows(tmp: str, roll: int, date: str):
    """Over rows (shard, page_id, url, html, digest, of), sorted; a row with ``of`` says what its page's copies refer to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as arrow_fs

        store, root = arrow_fs.FileSystem.from_uri(tmp)
        store.create_dir(root, recursive=True)
        out, shard, part, done = None, None, 0, []
        name, size, n, sha = "", 0, 0, hashlib.sha256()
        key, seen, refers = None, set(), {}

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((shard, part, name, size, n, sha.hexdigest()))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard:
                    close()
                    shard, part = row["shard"], 0
                    key, seen, refers = None, set(), {}
                if row["page_id"] != key:
                    key, seen, refers = row["page_id"], set(), {}
                if row["of"] is not None:
                    refers[row["digest"]] = row["of"]
                    continue
                payload = (row["html"] or "").encode()
                own = digest(payload)
                to = refers.get(own, key if own in seen else None)
                seen.add(own)
                data = record(key, row["url"], payload, own, None if to is None else _urn(to), date)
                if out is not None and size + len(data) > roll:
                    close()
                    part += 1
                if out is None:
                    name, size, n, sha = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0, hashlib.sha256()
                    out = store.open_output_stream(name, compression=None)
                    first = info(shard, part, date)
                    out.write(first)
                    size += len(first)
                    sha.update(first)
                out.write(data)
                size, n = size + len(data), n + 1
                sha.update(data)
        close()
        columns = list(zip(*done, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["shard", "part", "name", "bytes", "records", "sha256"])

    return run


def shard_bounds(sizes: DataFrame, tables: Tables, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """First keys of the shards, but for the first shard, of sizes(page_id, n_bytes): exact, by prefix sums over sorted keys.

    A shard begins with the first key whose prefix sum is in another multiple of ``shard_bytes`` than the one before. Keys
    are sorted by ranges; a range's own sums and those of the ranges before it give each key's, so the jobs are the same
    few whatever the number of shards, and the driver gets one key for each. The sorted keys are one of ``tables``.
    """
    per = sizes.where(F.col("page_id").isNotNull()).groupBy("page_id").agg(F.sum(F.col("n_bytes") + 512).alias("n"))
    dealt = per.repartitionByRange("page_id").sortWithinPartitions("page_id").withColumn("range", F.shiftrightunsigned(F.monotonically_increasing_id(), 33))
    rows = tables.keep(dealt, "warc-keys", narrow=False)
    sums = rows.groupBy("range").agg(F.sum("n").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    upto = F.sum("n").over(W.partitionBy("range").orderBy("page_id").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    placed = rows.withColumn("upto", upto).join(sums.select("range", before.alias("before")), "range")
    firsts = placed.groupBy(F.floor((F.col("upto") + F.col("before")) / F.lit(shard_bytes)).alias("shard")).agg(F.min("page_id").alias("page_id")).collect()
    return sorted(r["page_id"] for r in firsts)[1:]


@dataclass(frozen=True)
class Archive:
    """A committed archive: its folder and what the manifest says of each file."""

    path: str
    files: list[dict]


def write_archive(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, date: str = DATE) -> Archive:
    """Write pages(page_id, url, html) as WARC files in the folder ``path`` (a URI that all executors share).

    Of pages with equal payload, that with the largest page_id is a response and all others revisit it; null html is an
    empty payload, also shared. Null page_ids sort first and are never referred to unless no page of the payload has an
    id; rows that repeat a page_id with its payload revisit that page. Null page_ids of more than a shard's bytes have
    shards of their own, by payload. URLs come back as they are, null ones too. No pages:
    no files and an empty manifest. Other columns are ignored. Pages have no date of their own: ``date`` stands for it.

    Payload bytes are shuffled once, to their shard; the references to copies travel along as small rows, which sort
    before the page that they are for.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    tables = Tables()
    facts = tables.keep(pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).cast("long").alias("n_bytes")), "warc-facts")
    copies = facts.groupBy("sha").agg(F.max("page_id").alias("of"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    referring = facts.select("page_id", "sha").distinct().join(copies, "sha").where(~F.col("page_id").eqNullSafe(F.col("of")) & F.col("of").isNotNull())
    hexed = F.unhex("sha")
    none = F.lit(None).cast("string")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.lit(None).cast("binary").alias("sha"), F.lit(None).cast("long").alias("of"))
    rows = rows.unionByName(referring.select("page_id", none.alias("url"), none.alias("html"), hexed.alias("sha"), "of"))
    bounds = shard_bounds(facts, tables, shard_bytes)
    nameless = facts.where("page_id is null").agg(F.coalesce(F.sum(F.col("n_bytes") + 512), F.lit(0))).first()[0]
    extra = -(-nameless // shard_bytes) if nameless > shard_bytes else 0
    known = spark.sparkContext.broadcast(bounds)  # one number for each SHARD_BYTES of payload

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            ids = b.column("page_id")
            at = extra + np.searchsorted(np.array(known.value, np.int64), ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
            if extra:
                for i in np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False)):
                    sha = b.column("sha")[int(i)].as_py() or hashlib.sha1((b.column("html")[int(i)].as_py() or "").encode()).digest()
                    at[i] = int.from_bytes(sha[:8]) % extra
            digests = pa.array([None if s is None else base64.b32encode(s).decode() for s in b.column("sha").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), ids, b.column("url"), b.column("html"), digests, b.column("of")], ["shard", "page_id", "url", "html", "digest", "of"])

    shards = rows.mapInArrow(numbered, "shard long, page_id long, url string, html string, digest string, of long")
    shards = shards.repartitionById(extra + len(bounds) + 1, F.col("shard").cast("int"))  # a shard is a task, by its number
    tmp = f"{path}/_temporary/{uuid.uuid4().hex}"
    ordered = shards.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.col("of").asc_nulls_last(), "digest", F.md5("html"), "url")
    files = ordered.mapInArrow(_write_rows(tmp, roll_bytes, date), "shard long, part long, name string, bytes long, records long, sha256 string").collect()
    tables.release()
    return _commit(spark, path, [f.asDict() for f in files])


def _commit(spark: SparkSession, path: str, files: list[dict]) -> Archive:
    """Final names for the files, then the manifest, which makes them count; one row a file."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(root)
    for f in sorted(files, key=lambda f: (f["shard"], f["part"])):
        final = file_name(f["shard"], f["part"])
        if not store.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/_temporary/{f['name'].split('/_temporary/')[1]}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{final}")):
            raise OSError(f"{final} can't be put in place")
        f["name"] = final
    files.sort(key=lambda f: f["name"])
    text = json.dumps({"files": files}, indent=1)
    out = store.create(jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json.tmp"), True)
    out.write(bytearray(text.encode()))
    out.close()
    store.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json.tmp"), jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest.json"))
    delete(spark, f"{path}/_temporary")
    return Archive(path, files)


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped file, one at a time; checks the block's digest and length."""
    data, z, out = b"", zlib.decompressobj(31), []
    while True:
        if not data:
            data = stream.read(1 << 20)
            if not data:
                if out:
                    raise ValueError("a file ends within a record")
                return
        out.append(z.decompress(data))
        data = z.unused_data
        if not z.eof:
            continue
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        version, *fields = head.decode().split("\r\n")
        headers = dict(f.split(": ", 1) for f in fields)
        block = rest[: int(headers["Content-Length"])]
        if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != f"sha1:{digest(block)}":
            raise ValueError(f"a record is broken: {headers.get('WARC-Record-ID')}")
        yield headers, block
        z, out = zlib.decompressobj(31), []


def _id_of(urn: str | None) -> int | None:
    value = (urn or "<urn:page:none>").removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def _url_of(headers: dict[str, str]) -> str | None:
    exact = headers.get(_EXACT)
    return headers["WARC-Target-URI"] if exact is None else None if exact == "-" else base64.b64decode(exact).decode()


def _read_files(path: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows):
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

        for names in batches:
            for name in names.column(0).to_pylist():
                store, file = _open(f"{path}/{name}")
                rows, held = [], 0
                with store.open_input_stream(file, compression=None) as stream:
                    for headers, block in records_of(stream):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind = headers["WARC-Type"]
                        size = int(next(h for h in http.split(b"\r\n") if h.startswith(b"Content-Length: "))[16:])
                        said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (digest(payload) != said or len(payload) != size):
                            raise ValueError(f"a payload is broken: {headers['WARC-Record-ID']}")
                        rows.append((_id_of(headers["WARC-Record-ID"]), _url_of(headers), size, said, kind, _id_of(headers.get("WARC-Refers-To")), payload if with_payload and kind == "response" else None))
                        held += len(payload) if with_payload else 100
                        if len(rows) >= 1000 or held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                yield batch(rows)

    return run


def read_archive(spark: SparkSession, archive: Archive, with_payload: bool = True) -> DataFrame:
    """A row for each record of the files that the manifest names, read from them and checked; a file is a task's share."""
    names = spark.createDataFrame([(f["name"],) for f in archive.files], "name string")
    spread = names.repartition(max(1, min(len(archive.files), 10_000)), "name")
    return spread.mapInArrow(_read_files(archive.path, with_payload), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
