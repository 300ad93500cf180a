"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagecraft.functions.text import citation_label, half_even, is_blank, or_default, upper_median
from passagecraft.schema import ChunkConfig

from . import splitting

_PIECES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("section", T.StringType()), T.StructField("text", T.StringType())]))
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("section", pa.string()), ("text", pa.string())]))


def _per_text(make):
    """An Arrow function from texts to lists of pieces; each text once, in linear time."""

    @F.arrow_udf(_PIECES)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([[{"start": a, "section": s, "text": t} for a, s, t in make(x.as_py() or "")] for x in batch], _ARROW)

    return run


def sections(text: Column) -> Column:
    """array<struct(start, section, text)> by heading."""
    return _per_text(splitting.sections)(text)


def structured(text: Column, cfg: ChunkConfig) -> Column:
    """The pieces of a strategy, with their sections; only they go on, not the text."""
    strategy, size, overlap = cfg.strategy, cfg.chunk_size, cfg.overlap
    return _per_text(lambda t: splitting.split(t, strategy, size, overlap))(text)


def atoms(text: Column) -> Column:
    """The units of packing, with built-in functions."""
    blocks = F.transform(F.split(text, r"(?U)\n\s*\n"), lambda b: F.regexp_replace(b, r"\A\n+|\n+\z", ""))
    table = lambda b: (F.regexp_count(b, F.lit(r"\|")) >= 2) & b.contains("\n")
    sentences = lambda line: F.filter(F.split(line, r"(?U)(?<=[.!?;:])\s+"), lambda s: ~is_blank(s))
    lines = lambda b: F.flatten(F.transform(F.split(b, "\n"), lambda x: F.when(F.length(x) <= splitting.LONG_LINE, F.array(x)).otherwise(sentences(x))))
    return F.flatten(F.transform(F.filter(blocks, lambda b: ~is_blank(b)), lambda b: F.when(table(b), F.array(b)).otherwise(F.concat(lines(b), F.array(F.lit(""))))))


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<struct(start, text)> of fixed windows, with built-in functions."""
    step = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / F.lit(step))).cast("int") * step
    starts = F.filter(F.sequence(F.lit(0), last, F.lit(step)), lambda k: k < F.length(text))
    cut = F.transform(starts, lambda k: F.struct(k.alias("start"), F.substring(text, k + 1, F.lit(size)).alias("text")))
    return F.filter(cut, lambda p: ~is_blank(p["text"]))


def as_of(entries: Column, at: Column, value: str, key: str = "start") -> Column:
    """The value of the last entry at or before a place; null if there is none. Entries are in order."""
    return F.try_element_at(F.filter(entries, lambda e: e[key] <= at), F.lit(-1))[value]


def pieces_of(docs: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """docs(…, text) with chunk_index, char_start, section and chunk text in place of text."""
    piece = "piece"
    while piece in docs.columns:
        piece += "_"
    cut = docs.select(*docs.columns, F.posexplode(structured(F.col("text"), cfg)).alias("chunk_index", piece))
    return cut.withColumns({"section": F.col(piece)["section"], "char_start": F.col(piece)["start"], "text": F.col(piece)["text"]}).drop(piece)


def chunk(docs: DataFrame, cfg: ChunkConfig = ChunkConfig()) -> DataFrame:
    """A row for each chunk of docs, with its place, its page if the document has pages, and the text to embed."""
    cut = pieces_of(docs, cfg)
    title = or_default(F.col("title"), F.col("document_id")) if "title" in docs.columns else F.col("document_id")
    header = F.when(F.col("section") != "", F.concat_ws(" > ", title, "section")).otherwise(title)
    page = as_of(F.col("page_breaks"), F.col("char_start"), "page") if "page_breaks" in docs.columns else F.lit(None).cast("int")
    return cut.withColumns(
        {
            "chunk_id": F.concat_ws("::", F.col("document_id"), F.col("chunk_index").cast("string")),
            "n_chars": F.length("text"),
            "char_end": F.col("char_start") + F.length("text"),
            "page": page,
            "embed_text": F.concat(F.lit("["), header, F.lit("]\n"), F.col("text")),
            "chunk_strategy": F.lit(cfg.strategy),
            "chunk_size": F.lit(cfg.chunk_size),
            "chunk_overlap": F.lit(cfg.overlap),
            "chunk_slug": F.lit(cfg.slug),
        }
    ).withColumn("label", citation_label(title, F.col("document_id"), F.col("section"), F.col("page")))


def stats(chunks: DataFrame, *by: str) -> DataFrame:
    """Count, extremes, upper median, rounded mean and sum of chunk lengths.

    The median comes from a table of counts by length, so that no task holds all chunks.
    """
    from pyspark.sql import Window as W

    lengths = chunks.groupBy(*by, "n_chars").agg(F.count(F.lit(1)).alias("k"))
    upto = W.partitionBy(*by).orderBy("n_chars")
    ranked = lengths.withColumn("upto", F.sum("k").over(upto)).withColumn("all", F.sum("k").over(W.partitionBy(*by)))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n_chars")))
    total = F.sum(F.col("k") * F.col("n_chars"))
    return ranked.groupBy(*by).agg(
        F.sum("k").alias("count"), F.min("n_chars").alias("min"), middle.alias("median"), F.max("n_chars").alias("max"), half_even(total / F.sum("k")).cast("long").alias("mean"), total.alias("total_chars")
    )


__all__ = ["as_of", "atoms", "chunk", "pieces_of", "sections", "stats", "structured", "upper_median", "windows"]
