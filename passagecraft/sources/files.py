"""Document files to rows: scan, dispatch by format, metadata and sidecar."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagecraft.functions.text import is_blank, title_case
from passagecraft.schema import KNOWN_KEYS

# Formats by suffix, and the file of a corpus that holds metadata for others.
FORMATS = {".md": "markdown", ".markdown": "markdown", ".txt": "markdown", ".html": "html", ".htm": "html", ".pdf": "pdf"}
SIDECAR = "metadata.yaml"
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
_META = T.MapType(T.StringType(), T.StringType())
_PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("meta", _META), T.StructField("page_breaks", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("page", T.IntegerType())]))), T.StructField("error", T.StringType())])


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def document_format(path: Column) -> Column:
    """markdown, html or pdf; null for what is none of them."""
    out = F.lit(None).cast("string")
    for end, name in FORMATS.items():
        out = F.when(suffix(path) == end, name).otherwise(out)
    return out


def plain_values(meta: dict) -> dict[str, str]:
    """Metadata as strings; values of None are left out."""
    return {str(k): str(v) for k, v in (meta or {}).items() if v is not None}


def defaults(path: Column, meta: Column, root: str = "") -> dict[str, Column]:
    """The known metadata of a file: its own where the key is there, else from its name and folder."""
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    folder = F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))
    relative = F.when(F.lit(bool(root)) & path.startswith(root), F.substring(path, len(root) + 1, 1 << 30)).otherwise(path)
    own = {
        "document_id": F.upper(stem),
        "title": title_case(F.translate(stem, "-_", "  ")),
        "doc_type": folder,
        "effective_date": F.lit(""),
        "source_url": path,
    }
    return {k: F.coalesce(meta[k], v) for k, v in own.items()} | {"filename": name, "relpath": relative}


def overridden(docs: DataFrame, sidecar: DataFrame) -> DataFrame:
    """docs with the values of sidecar(filename, meta map) in place of their own, where those are not null.

    A left join by file name; the sidecar has one row a file, and Spark broadcasts it if it is small.
    """
    side = sidecar.select(F.col("filename").alias("_file"), F.map_filter("meta", lambda k, v: v.isNotNull()).alias("_side"))
    joined = docs.join(side, docs["filename"] == side["_file"], "left")
    keys = [k for k in KNOWN_KEYS if k not in ("filename", "relpath") and k in docs.columns]
    out = joined.withColumns({k: F.coalesce(F.col("_side")[k], F.col(k)) for k in keys})
    if "extra" in docs.columns:
        more = F.map_filter(F.coalesce("_side", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: ~k.isin(*KNOWN_KEYS))
        out = out.withColumn("extra", F.map_concat(F.map_filter("extra", lambda k, v: ~F.map_contains_key(more, k)), more))
    return out.drop("_file", "_side")


#: From a file's bytes to the raw text of its pages, in order, and its metadata.
PageReader = Callable[[bytes], tuple[list[str], dict]]


def _parse_pdf(content: bytes) -> tuple[list[str], dict]:
    import io

    from pypdf import PdfReader  # optional; without it PDF files raise here and nowhere else

    reader = PdfReader(io.BytesIO(content))
    meta = {k.lstrip("/").lower(): str(v) for k, v in (reader.metadata or {}).items() if v and str(v).strip()}
    return [(p.extract_text() or "") for p in reader.pages], meta


def _parse_text(kind: str, raw: bytes) -> tuple[str, dict]:
    import re

    import yaml

    from passagecraft.sources.markup import parse as parse_html

    text = raw.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
    if kind == "html":
        return parse_html(text)
    m = re.match(FRONT_MATTER, text)
    meta = (yaml.safe_load(m[1]) or {}) if m else {}
    return (text[m.end() :] if m else text).strip(), meta if isinstance(meta, dict) else {}


def parser(read_pages: PageReader = _parse_pdf):
    """A column function of (format, content): text, metadata and error of a file; ``read_pages`` reads what has pages."""

    @F.arrow_udf(_PARSED)
    def parse(files: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.struct([("text", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("page_breaks", pa.list_(pa.struct([("start", pa.int32()), ("page", pa.int32())]))), ("error", pa.string())])
        for kinds, contents in files:
            out = []
            for k, c in zip(kinds.to_pylist(), contents, strict=True):
                text, meta, error = "", {}, None
                try:
                    if k == "pdf":
                        pages, meta = read_pages(c.as_py() or b"")
                        text = json.dumps(pages)
                    else:
                        text, meta = _parse_text(k, c.as_py() or b"")
                except Exception as e:  # a file that can't be read is a row with an error, and the others go on
                    error = f"{type(e).__name__}: {e}"
                out.append({"text": text, "meta": list(plain_values(meta).items()), "page_breaks": [], "error": error})
            yield pa.array(out, kind)

    # parsed once, whatever is filtered by the outcome
    return parse.asNondeterministic()


_parse = parser()


def failures(spark: SparkSession, root: str, read_pages: PageReader = _parse_pdf) -> DataFrame:
    """path and error of the files below a folder that read_corpus() leaves out as they can't be read."""
    return scan(spark, root).select("path", parser(read_pages)("format", "content").alias("p")).where("p.error is not null").select("path", F.col("p.error").alias("error"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Files of supported formats below a folder: path, format, content; hidden files and the sidecar are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith(".") & (name != SIDECAR)).select("path", document_format(F.col("path")).alias("format"), "content").where("format is not null")


def read_corpus(spark: SparkSession, root: str, corpus_id: str = "default", read_pages: PageReader = _parse_pdf) -> DataFrame:
    """The documents below a folder, as rows of schema.DOCUMENT with corpus_id; those without text are left out, as are files that can't be read: see failures().

    ``read_pages`` reads PDF files; without one that is what ``pypdf`` does, where it is installed.
    """
    from .pages import join_pages

    base = f"file:{os.path.abspath(root)}/" if "://" not in root else f"{root.rstrip('/')}/"
    parsed = scan(spark, root).withColumn("p", parser(read_pages)("format", "content")).where("p.error is null")
    known = defaults(F.col("path"), F.col("p.meta"), base)
    extra = F.map_filter("p.meta", lambda k, v: ~k.isin(*KNOWN_KEYS)).alias("extra")
    docs = parsed.select(*(c.alias(k) for k, c in known.items()), extra, F.col("p.text").alias("text"), F.col("p.page_breaks").alias("page_breaks"), "format")
    flat = docs.where("format != 'pdf'").drop("format")
    paged = docs.where("format = 'pdf'").drop("format", "page_breaks")
    pages = paged.select(F.col("relpath").alias("_r"), F.posexplode(F.from_json("text", "array<string>")).alias("page_no", "raw_text")).withColumn("page_no", F.col("page_no") + 1)
    joined = paged.drop("text").join(join_pages(pages, "_r"), F.col("relpath") == F.col("_r")).drop("_r")
    return overridden(flat.unionByName(joined), read_sidecar(spark, root)).where(~is_blank(F.col("text"))).withColumn("corpus_id", F.lit(corpus_id))


def read_sidecar(spark: SparkSession, root: str) -> DataFrame:
    """filename and metadata of each entry of the corpus' sidecar file; no rows if there is none."""
    import yaml

    rows = []
    found = spark.read.format("binaryFile").option("pathGlobFilter", SIDECAR).load(root).select("content").take(1)
    if found:
        rows = [(k, plain_values(v)) for k, v in (yaml.safe_load(found[0][0].decode()) or {}).items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, "filename string, meta map<string,string>")


def list_corpora(spark: SparkSession, root: str) -> DataFrame:
    """corpus_id and n_files of the folders of ``root`` that hold supported files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    base = f"file:{os.path.abspath(root)}/" if "://" not in root else f"{root.rstrip('/')}/"
    name = F.element_at(F.split("path", "/"), -1)
    some = files.where(document_format(F.col("path")).isNotNull() & ~name.startswith(".") & F.substring("path", len(base) + 1, 1 << 30).contains("/"))
    return some.groupBy(F.element_at(F.split(F.substring("path", len(base) + 1, 1 << 30), "/"), 1).alias("corpus_id")).agg(F.count(F.lit(1)).alias("n_files"))


def save_uploads(folder: str, files: Iterable[tuple[str, bytes]], replace: bool = False) -> list[str]:
    """Writes uploads of supported formats under their base names, and returns those; replace empties the folder first, but for the sidecar."""
    os.makedirs(folder, exist_ok=True)
    if replace:
        for name in os.listdir(folder):
            if name != SIDECAR and os.path.isfile(f"{folder}/{name}"):
                os.remove(f"{folder}/{name}")
    saved = []
    for path, content in files:
        name = os.path.basename(path.replace("\\", "/"))
        if os.path.splitext(name)[1].lower() in FORMATS and not name.startswith("."):
            with open(f"{folder}/{name}", "wb") as f:
                f.write(content)
            saved.append(name)
    return saved


def read_questions(spark: SparkSession, text: str) -> DataFrame:
    """Gold questions from YAML: id, question, kind and what answers are known by."""
    import yaml

    fields = "id string, question string, kind string, expect_doc string, expect_text array<string>, current_doc string, current_text array<string>, stale_doc string, stale_text array<string>, near_miss boolean"
    names = [f.split()[0] for f in fields.split(", ")]
    listed = lambda k, v: [str(x) for x in (v if isinstance(v, list) else [v])] if v is not None and k.endswith("_text") else v if v is None or isinstance(v, bool) else str(v)
    return spark.createDataFrame([tuple(listed(k, q.get(k)) for k in names) for q in yaml.safe_load(text) or []], fields)
