"""Near duplicates by SimHash, found through an embedding of fingerprints as bit counts of segments.

A 64-bit fingerprint becomes the vector of the bit counts of its 32 two-bit segments. One differing bit moves one count
by one, so two fingerprints within ``k`` bits are within Manhattan distance ``k`` there: a lower bound that needs no
look at the bits. The range join under that bound goes by a grid: the 32 dimensions form GROUPS groups, and of two
vectors within distance 3 at least GROUPS - 3 groups are equal. A cell of the grid is a choice of GROUPS - 3 groups and
the counts in them; partners share a cell. Within a cell, pairs pass the Manhattan bound and then the exact comparison.
Counts 0, 1, 2 are kept as 00, 01, 11, so that the Manhattan distance of two vectors is a bit count, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, materialize, parted, unused
from .components import components

MAX_BITS = 3
GROUPS = 7
#: Fingerprints of one cell that are compared in one go; a larger cell is split and its parts meet two by two.
BLOCK = 1024
_EVEN = 0x5555555555555555
_CHUNK = 1 << 16


def simhash(text: bytes, shingle: int = 3) -> int:
    """The fingerprint of one UTF-8 text, as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + shingle - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64)
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        found = np.fromiter((simhash(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch), np.uint64, len(batch))
        yield pa.array(found.view(np.int64))


def counts_code(fp: Column) -> Column:
    """The bit counts of the two-bit segments, each in unary."""
    even, above = F.lit(_EVEN), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(above).bitwiseAND(even).bitwiseOR(F.shiftleft(fp.bitwiseAND(above).bitwiseAND(even), 1))


def grid_masks(groups: int = GROUPS, bits: int = MAX_BITS) -> list[int]:
    """For each choice of groups - bits groups, the positions of their counts, as a signed 64-bit mask."""
    of = [sum(3 << (2 * s) for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    masks = (sum(of[g] for g in some) for some in combinations(range(groups), groups - bits))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])))
def linked(cells: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Within each list of fingerprints, a link from every one to the smallest that it reaches."""
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    for batch in cells:
        out = []
        for cell in batch:
            fp = np.unique(np.asarray(cell.values)).astype(np.int64)
            x = fp.view(np.uint64)
            even, above = np.uint64(_EVEN), x >> np.uint64(1)
            code = ((x | above) & even) | ((x & above & even) << np.uint64(1))
            near = np.bitwise_count(code[:, None] ^ code) <= MAX_BITS
            i, j = np.nonzero(near)
            ok = np.bitwise_count(x[i] ^ x[j]) <= MAX_BITS
            near[i[~ok], j[~ok]] = False
            left, links = np.ones(len(fp), bool), []
            for first in range(len(fp)):
                if left[first]:
                    left[first] = False
                    edge = np.array([first])
                    while len(edge):
                        edge = np.nonzero(near[edge].any(0) & left)[0]
                        left[edge] = False
                        links += [{"a": int(fp[first]), "b": int(fp[e])} for e in edge]
            out.append(links)
        yield pa.array(out, kind)


def near_links(fps: DataFrame, bits: int = MAX_BITS, groups: int = GROUPS, block: int = BLOCK, tables: Tables | None = None) -> DataFrame:
    """Links (a, b) that join what fps(fp), each once, has within ``bits`` differing bits, directly or by way of others.

    No pair is lost and no cell is cut short: a cell of two is compared as it is counted; in a larger one, up to
    ``block`` fingerprints are compared at once, and of a cell with more every two of its parts meet in a task of
    their own. Of each such meeting only links to the smallest members leave, never all pairs. The links read a table
    of cells that belongs to ``tables``.
    """
    if bits != MAX_BITS:
        raise ValueError(f"the grid is laid out for {MAX_BITS} bits")
    code = counts_code(F.col("fp"))
    choices = F.array(*[F.struct(F.lit(k).cast("byte").alias("choice"), code.bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(grid_masks(groups, bits))])
    # fingerprints are few bytes and become many cells: without this, few tasks would make them all; by another hash
    # than that of fp itself, as Spark drops a repartition by what rows are dealt by already
    spread = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp", F.lit("spread")))
    placed = spread.select("fp", F.inline(choices))
    sizes = (tables or Tables()).keep(placed.groupBy("choice", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"), "cells")
    two = sizes.where("n = 2").select("a", "b")
    bound = F.bit_count(counts_code(F.col("a")).bitwiseXOR(counts_code(F.col("b")))) <= bits
    two = two.where(bound).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    more = (
        placed.join(sizes.where("n > 2").select("choice", "cell", parts.alias("parts")), ["choice", "cell"])
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .groupBy("choice", "cell", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"))
        .agg(F.collect_list("fp").alias("fps"))
        .select(F.inline(linked("fps")))
    )
    return two.unionByName(more)


def rooted(marked: DataFrame) -> DataFrame:
    """Per fingerprint of marked(doc_id, fp): fp, least (its smallest doc_id), root (the smallest fingerprint in reach)."""
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    tables = Tables()
    roots = components(near_links(nodes.select("fp"), tables=tables))
    tables.release()
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def classes(marked: DataFrame) -> DataFrame:
    """Per fingerprint of marked(doc_id, fp): fp, component_id (the smallest doc_id in reach)."""
    of = rooted(marked)
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return of.join(named, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, fp (signed long), component_id, the smallest doc_id within reach of links.

    Null or empty text, or one of white space, has fingerprint zero, and links like any other. Equal rows have equal
    results. Null doc_ids take part but never name a component, unless it has no other (then null). An empty table gives
    no rows; other columns are ignored. Equal fingerprints are one node; documents meet their class by fingerprint,
    with one row of each on the other side, so a hot fingerprint's documents can be split over tasks.
    """
    marked = materialize(docs.select("doc_id", fingerprint("text").alias("fp")), "fingerprints")
    return marked.join(classes(marked), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest doc_id.

    Null doc_ids come last. Of several rows with that doc_id and fingerprint, the one with the smallest text stays, then
    the one that is smallest as JSON. Null and empty texts are near duplicates of each other. An empty table stays empty;
    columns of any name pass through.

    All is decided on doc_ids and fingerprints alone. Rows that may go meet their verdict by doc_id, all others stay
    where they lie; rows whose doc_id is there more than once have their fingerprint taken again to tell them apart.
    """
    tables = Tables()
    marked = tables.keep(docs.select("doc_id", fingerprint("text").alias("fp")), "fingerprints")
    best = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("doc_id"), "fp"))
    won = rooted(marked).groupBy("root").agg(best.alias("w")).select(F.col("w.doc_id").alias("won"), F.col("w.fp").alias("won_fp"))
    won = Tables().keep(won, "winners")
    per = marked.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))
    judged = per.join(won, (per["fp"] == won["won_fp"]) & per["doc_id"].eqNullSafe(won["won"]), "left").select("doc_id", "n", F.col("won_fp").isNotNull().alias("stays"))
    ids = judged.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("stays").alias("stays"))
    special = Tables().keep(ids.where(~(F.col("stays") & (F.col("n") == 1))).select(F.col("doc_id").alias("key"), (F.col("n") > 1).alias("again")), "judged-ids")
    tables.release()
    # rows whose doc_id is surely not among those stay where they lie; the others meet them
    n, repeated = special.agg(F.count(F.lit(1)), F.coalesce(F.max("again"), F.lit(False))).first()
    kept, rest = parted(docs, docs["doc_id"], special, n)
    # of those few stay, so they go on in few tasks
    kept = kept.unionByName(rest.join(special, rest["doc_id"].eqNullSafe(special["key"]), "left_anti").hint("rebalance"))
    if not repeated:
        return kept
    again = special.where("again").select("key")
    fp = unused(docs, "fp")
    some = docs.join(again, docs["doc_id"].eqNullSafe(again["key"]), "left_semi").withColumn(fp, fingerprint("text"))
    some = some.join(won, some["doc_id"].eqNullSafe(won["won"]) & (some[fp] == won["won_fp"]), "left_semi")
    row = F.struct(*(some[c] for c in docs.columns))
    one = some.groupBy(some["doc_id"], some[fp]).agg(F.min_by(row, F.struct(F.coalesce(some["text"], F.lit("")), F.to_json(row))).alias("row"))
    return kept.unionByName(one.select("row.*"))
