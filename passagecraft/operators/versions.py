"""Collections by versions: what changed is written anew, the rest stays, and a manifest makes a version count.

A store is a folder with ``parts`` (rows, each part written once and never touched again), ``sources`` (of each version, a
row for every document: its digest and the part that holds its rows) and ``versions`` (a manifest for each number). A
version is there when its manifest has its name, which is one rename; whatever fails before leaves the versions that were
there, and files that no manifest names. Readers keep the version they have opened, as nothing it names is changed;
vacuum() removes what no manifest that is kept names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import delete, kept, read_text, store_of, write_new

#: Versions that vacuum() keeps; shares of dead documents over which a part is written anew by compact().
KEEP, DEAD = 2, 0.5


class Conflict(RuntimeError):
    """Another writer has made this version meanwhile."""


@dataclass(frozen=True)
class Version:
    number: int
    parts: tuple[str, ...]
    sources: str | None
    #: Documents that this version wrote, and those it left out.
    written: int
    removed: int


NONE = Version(0, (), None, 0, 0)


def numbers(spark: SparkSession, root: str) -> list[int]:
    store, p = store_of(spark, f"{root}/versions")
    names = [s.getPath().getName() for s in store.listStatus(p)] if store.exists(p) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))


def version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """A version's manifest, the last one's without a number; NONE of a store that has none."""
    known = numbers(spark, root)
    number = number if number is not None else (known[-1] if known else 0)
    if not number:
        return NONE
    text = read_text(spark, f"{root}/versions/{number:08}.json")
    if text is None:
        raise LookupError(f"{root} has no version {number}")
    m = json.loads(text)
    return Version(number, tuple(m["parts"]), m["sources"], m["written"], m["removed"])


_SOURCES = "key string, digest string, part string, seen timestamp"


def sources(spark: SparkSession, root: str, v: Version | None = None) -> DataFrame:
    """key, digest, part, seen: the documents of a version."""
    v = v or version(spark, root)
    return spark.read.schema(_SOURCES).parquet(f"{root}/{v.sources}") if v.sources else spark.createDataFrame([], _SOURCES)


def read(spark: SparkSession, root: str, number: int | None = None) -> DataFrame | None:
    """The rows of a version, with ``key`` and ``part``; null if it has none. Rows of documents that a later part replaces are left out."""
    v = version(spark, root, number)
    if not v.parts:
        return None
    live = sources(spark, root, v)
    rows = None
    for part in v.parts:
        one = spark.read.parquet(f"{root}/{part}").withColumn("part", F.lit(part))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return rows.join(live.select("key", "part"), ["key", "part"], "left_semi")


def digest_of(*columns: str | Column) -> Column:
    """What a document's rows depend on; a null is no empty text."""
    return F.sha2(F.to_json(F.struct(*(c if isinstance(c, Column) else F.col(c) for c in columns)), {"ignoreNullFields": "false"}), 256)


def commit(
    docs: DataFrame, root: str, made: Callable[[DataFrame], DataFrame], digest: Column | Sequence[str], key: str = "document_id", whole: bool = True, expire_before: Column | None = None, newest: Column | None = None
) -> Version:
    """Makes a version of docs, with rows by ``made`` of what is new or has another digest; the version that is there if nothing changed.

    ``digest`` says what rows depend on, or the columns that do. ``made`` gets rows of docs and gives rows that have ``key`` still, as a column of that name. With ``whole`` docs are all
    documents, and those that are not among them are gone; without, they are added or replaced, and the others stay, but
    for those not seen since ``expire_before``. Of several rows of a key the one with the greatest ``newest`` counts, then
    with the greatest digest. Rows with a null key are an error. Only changed documents reach ``made``; of the others a row
    each is written to the list of documents.
    """
    spark = docs.sparkSession
    digest = digest if isinstance(digest, Column) else digest_of(*digest)
    old = version(spark, root)
    now = F.current_timestamp()
    # the state of a document is its key and digest: texts don't take part in finding out what changed
    state = docs.select(F.col(key).cast("string").alias("key"), digest.alias("digest"), (newest if newest is not None else F.lit(0)).alias("newest"))
    state = kept(state.groupBy("key").agg(F.max_by("digest", F.struct("newest", "digest")).alias("digest")), "version-state")
    if not state.where("key is null").isEmpty():
        raise ValueError(f"a document has no {key}")
    before = sources(spark, root, old)
    changed = kept(state.join(before.select("key", "digest"), ["key", "digest"], "left_anti"), "version-changed")
    gone = before.join(state, "key", "left_anti")
    gone = gone if whole else (gone.where(F.col("seen") < expire_before) if expire_before is not None else gone.limit(0))
    n, removed = changed.count(), gone.count()
    if not n and not removed:
        return old
    name = uuid.uuid4().hex
    parts = list(old.parts)
    if n:
        mine = docs.withColumn("version_digest", digest).join(changed.select(F.col("key").alias("version_key"), F.col("digest").alias("version_digest")), "version_digest")
        mine = mine.where(F.col(key).cast("string") == F.col("version_key")).dropDuplicates(["version_key"]).drop("version_key", "version_digest")
        made(mine).withColumn("key", F.col(key).cast("string")).write.parquet(f"{root}/parts/{name}")
        parts.append(f"parts/{name}")
    still = before.join(changed.select("key"), "key", "left_anti").join(gone.select("key"), "key", "left_anti")
    still = still.join(state.select("key", F.lit(True).alias("there")), "key", "left").withColumn("seen", F.when(F.col("there"), now).otherwise(F.col("seen"))).drop("there")
    fresh = changed.select("key", "digest", F.lit(f"parts/{name}").alias("part"), now.alias("seen"))
    still.unionByName(fresh).select("key", "digest", "part", "seen").write.parquet(f"{root}/sources/{name}")
    after = spark.read.schema(_SOURCES).parquet(f"{root}/sources/{name}")
    used = {r.part for r in after.select("part").distinct().collect()}  # a row a part
    return _put(spark, root, old, [p for p in parts if p in used], f"sources/{name}", n, removed)


def _put(spark: SparkSession, root: str, old: Version, parts: list[str], listed: str, written: int, removed: int) -> Version:
    m = dict(parts=parts, sources=listed, written=written, removed=removed)
    if not write_new(spark, f"{root}/versions/{old.number + 1:08}.json", json.dumps(m)):
        raise Conflict(f"version {old.number + 1} of {root} is there already")
    return version(spark, root, old.number + 1)


def compact(spark: SparkSession, root: str, dead: float = DEAD) -> Version:
    """A version of the same rows, in which parts with a share of dead documents over ``dead`` are put together in a new one."""
    old = version(spark, root)
    if not old.parts:
        return old
    live = sources(spark, root, old)
    held = None
    for part in old.parts:
        one = spark.read.parquet(f"{root}/{part}").select("key").distinct().withColumn("part", F.lit(part))
        held = one if held is None else held.unionByName(one)
    shares = held.join(live.select("key", "part", F.lit(1).alias("lives")), ["key", "part"], "left").groupBy("part").agg((1 - F.count("lives") / F.count(F.lit(1))).alias("dead"))
    poor = [r.part for r in shares.where(F.col("dead") > dead).collect()]
    if not poor:
        return old
    name = uuid.uuid4().hex
    read(spark, root, old.number).where(F.col("part").isin(poor)).drop("part").write.parquet(f"{root}/parts/{name}")
    live.withColumn("part", F.when(F.col("part").isin(poor), F.lit(f"parts/{name}")).otherwise(F.col("part"))).write.parquet(f"{root}/sources/{name}")
    return _put(spark, root, old, [*(p for p in old.parts if p not in poor), f"parts/{name}"], f"sources/{name}", 0, 0)


def vacuum(spark: SparkSession, root: str, keep: int = KEEP) -> list[str]:
    """Forgets all but the last ``keep`` versions and removes what no version names; what went. Not while a writer is at work."""
    known = numbers(spark, root)
    for n in known[: max(0, len(known) - keep)]:
        delete(spark, f"{root}/versions/{n:08}.json")
    named = set()
    for n in numbers(spark, root):
        v = version(spark, root, n)
        named |= {*v.parts, v.sources}
    gone = []
    for kind in ("parts", "sources"):
        store, p = store_of(spark, f"{root}/{kind}")
        for s in store.listStatus(p) if store.exists(p) else []:
            if f"{kind}/{s.getPath().getName()}" not in named:
                store.delete(s.getPath(), True)
                gone.append(f"{kind}/{s.getPath().getName()}")
    return sorted(gone)
