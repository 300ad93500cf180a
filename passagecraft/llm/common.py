"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_OWN_DIR: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset and all run in this process, a folder of its own."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(f"file://{tempfile.mkdtemp(prefix='passagecraft-')}")
        atexit.register(shutil.rmtree, _OWN_DIR[0].removeprefix("file://"), ignore_errors=True)
    return _OWN_DIR[0]


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path on any file system Hadoop knows."""
    store, p = _store(spark, path)
    store.delete(p, True)


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Remove a path that is there when the driver ends."""
    store, p = _store(spark, path)
    store.deleteOnExit(p)


class Tables:
    """The tables that one call writes to the shared folder: they cut lineage and survive lost executors.

    ``release`` removes them as soon as no result that is still to be computed reads them; what is never released goes
    when the driver ends.
    """

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame, what: str, narrow: bool = True) -> DataFrame:
        """df, written and read back. One without texts is shuffled into files of a good size: many tasks often make little."""
        spark, path = df.sparkSession, scratch(df.sparkSession, what)
        df = df.hint("rebalance") if narrow else df
        # the table counts as soon as this returns, so it needs no marker
        df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        delete_at_end(spark, path)
        self.paths.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        while self.paths:
            delete(*self.paths.pop())


def materialize(df: DataFrame, what: str, narrow: bool = True) -> DataFrame:
    """df, written as a table to the shared folder and read back; the table is there until the driver ends."""
    return Tables().keep(df, what, narrow)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """A setting for an application on texts: rows go to Python workers ``rows`` at a time, as a batch has to fit several times beside the heap.

    Operators leave the session as it is; the named queries and the pipeline call this first.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df has not, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of one bitmap of parted(), as Spark's bitmap functions have them; how many bits for each key; bitmaps at most (16 MB).
_BITMAP, _BITS_A_KEY, _BITMAPS = 1 << 15, 16, 1 << 12


def parted(docs: DataFrame, key: Column, keys: DataFrame, n_keys: int) -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose key is surely none of keys(key), the other rows): what a join with keys can leave where it lies.

    Keys fill bitmaps by their hash, 4 KB each and no more than _BITMAPS of them, which go to all rows. With far more
    keys than bits the second part has nearly all rows, and a join of it still tells exactly. docs is read for each part.
    """
    bitmaps = max(1, min(_BITMAPS, 1 << (n_keys * _BITS_A_KEY // _BITMAP).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bitmaps * _BITMAP))
    which, bits = unused(docs, "bitmap_number"), unused(docs, "bitmap_bits")
    at = keys.select(place(F.col("key")).alias("at"))
    filled = at.groupBy(F.floor(F.col("at") / _BITMAP).cast("long").alias(which)).agg(F.bitmap_construct_agg(F.col("at") % _BITMAP).alias(bits))
    nth = (place(key) % _BITMAP).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(nth / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    there = F.coalesce(F.getbit(byte, nth % 8) == 1, F.lit(False))
    joined = docs.join(F.broadcast(filled), F.floor(place(key) / _BITMAP).cast("long") == F.col(which), "left")
    return joined.where(~there).select(*docs.columns), joined.where(there).select(*docs.columns)


def ranked(df: DataFrame, groups: list[str], order: list[Column], tables: Tables, place: str, size: str) -> DataFrame:
    """df with its row's place in its group (from 0) in the order given, and the group's number of rows.

    Rows are dealt out by ranges of (groups, order) and sorted there, so a group of any size is spread over tasks, equal
    rows too; a row's place is its line in its range, and what the ranges before hold of its group. Nulls are a group
    like any other. The sorted rows are a table that belongs to ``tables``, so that all looks see the same ranges.
    """
    line, part, first, held = (unused(df, c) for c in ("rank_line", "rank_part", "rank_first", "rank_held"))
    # equal rows differ by where they stand, else no range could part them
    keys = [*map(F.col, groups), *order, F.monotonically_increasing_id()]
    named = df.withColumns({f"{line}{i}": k for i, k in enumerate(keys)})
    sort = [F.col(f"{line}{i}") for i in range(len(keys))]
    dealt = named.repartitionByRange(*sort).sortWithinPartitions(*sort).select(*df.columns, F.monotonically_increasing_id().alias(line))
    rows = tables.keep(dealt.withColumn(part, F.shiftrightunsigned(line, 33)), "ranked", narrow=False)
    per = rows.groupBy(*groups, part).agg(F.min(line).alias(first), F.count(F.lit(1)).alias(held))
    # one row a group and range
    own = W.partitionBy(*groups)
    before = F.coalesce(F.sum(held).over(own.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*(F.col(g).alias(f"{part}{i}") for i, g in enumerate(groups)), F.col(part).alias(f"{part}_"), (before - F.col(first)).alias(first), F.sum(held).over(own).alias(size))
    same = rows[part] == per[f"{part}_"]
    for i, g in enumerate(groups):
        same = same & rows[g].eqNullSafe(per[f"{part}{i}"])
    return rows.join(per, same).select(*df.columns, (F.col(line) + F.col(first)).alias(place), F.col(size))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def cells(n_rows: int, per: int, least: int = 1) -> int:
    """How many buckets hold n_rows at about per rows each."""
    return max(least, -(-n_rows // per))
