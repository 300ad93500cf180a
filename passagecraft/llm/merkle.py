"""A Merkle manifest of a dataset: a tree for each source, a tree over their roots, and a proof for each row.

Every FAN consecutive nodes become one. Nodes are a table by coordinates (group, level, place), which is written TIER
levels at a time: a block of FAN ** TIER nodes is folded in one row, so even a tree over all rows of a corpus takes few
jobs. What a leaf's proof needs follows from its index and the size of its group alone: it explodes into the coordinates
of its siblings, which meet the table of nodes. That, too, goes by tiers: a node of a tier asks for the siblings within its
block, and takes the rest of its way from the block's own node. So no node, not even a root's child that all rows of a hot
source need, is asked for more than FAN ** TIER times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, ranked

FAN = 3
#: Levels that are folded at once; powers of FAN up to the largest that a long holds.
TIER = 5
_BLOCK = FAN**TIER
_POWERS = [FAN**k for k in range(40)]


def field(value: Column) -> Column:
    """A value as it is hashed: its UTF-8 bytes, their number before them; - for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*inputs: Column) -> Column:
    """The SHA-256 of inputs one after the other, in lowercase hexadecimal digits."""
    return F.sha2(F.concat(*inputs), 256)


def _levels(size: Column) -> Column:
    """How many levels stand above leaves of that number."""
    return F.size(F.filter(F.array(*[F.lit(p) for p in _POWERS]), lambda p: p < size))


def _at(size: Column, level: int) -> Column:
    """How many nodes of a group of leaves of that number a level has."""
    return F.ceil(size / F.lit(_POWERS[level])).cast("long") if level < 33 else F.lit(1)


def _over(n: Column, by: int) -> Column:
    return F.floor(n / F.lit(by)).cast("long")


def _runs(below: Column) -> Column:
    """The level above an array of nodes."""
    return F.transform(F.sequence(F.lit(1), F.size(below), F.lit(FAN)), lambda i: F.sha2(F.array_join(F.slice(below, i, F.lit(FAN)), ""), 256))


def _placed(level: Column, number: int, first: Column) -> Column:
    """An array of nodes with their coordinates; the first one's place is given."""
    return F.transform(level, lambda d, i: F.struct(F.lit(number).alias("level"), (first + i).alias("place"), d.alias("node")))


def nodes_of(leaves: DataFrame, tables: Tables) -> DataFrame:
    """node_group, level, place, node: all nodes of the trees over leaves(node_group, place, size, node), node in hex digits.

    A tier is a job: blocks of FAN ** TIER nodes become arrays, and each array the levels above it as far as its tree goes.
    """
    most = leaves.agg(F.max("size")).first()[0] or 0
    now, found, base = leaves.select("node_group", "place", "node", "size"), leaves.select("node_group", F.lit(0).alias("level"), "place", "node"), 0
    while most > 1:
        rows = now.groupBy("node_group", "size", _over(F.col("place"), _BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("n0"))
        rows = rows.withColumn("n0", F.transform("n0", lambda x: x["node"]))
        for k in range(1, TIER + 1):
            # in a size of at most _POWERS[k - 1] the root stands below
            rows = rows.withColumn(f"n{k}", F.when(F.col("size") > _POWERS[k - 1], _runs(F.col(f"n{k - 1}"))).otherwise(F.array().cast("array<string>")))
        each = [_placed(F.col(f"n{k}"), base + k, F.col("block") * _POWERS[TIER - k]) for k in range(1, TIER + 1)]
        made = tables.keep(rows.select("node_group", "size", F.inline(F.concat(*each))), "nodes")
        found = found.unionByName(made.drop("size"))
        base, most = base + TIER, -(-most // _BLOCK)
        now = made.where((F.col("level") == base) & (F.col("size") > _BLOCK)).withColumn("size", _at(F.col("size"), TIER)).drop("level")
    return found


def _siblings(s: Column) -> Column:
    """The coordinates of the other nodes of a run, where struct(level, at, held) says which node of how many asks."""
    run = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda j: F.struct(s["level"].alias("level"), (_over(s["at"], FAN) * FAN + j).alias("place")))
    return F.filter(run, lambda c: (c["place"] != s["at"]) & (c["place"] < s["held"]))


def _step(s: Column) -> Column:
    """What stands before and after a node in its run, from the siblings that were found."""
    mine = F.filter(F.coalesce("siblings", F.array().cast("array<struct<level:int,place:bigint,node:string>>")), lambda x: x["level"] == s["level"])
    joined = lambda some: F.array_join(F.transform(some, lambda x: x["node"]), "")
    return F.struct(joined(F.filter(mine, lambda x: x["place"] < s["at"])).alias("before"), joined(F.filter(mine, lambda x: x["place"] > s["at"])).alias("after"))


def climb(leaves: DataFrame, nodes: DataFrame, above: DataFrame) -> DataFrame:
    """leaves with steps and the other columns of above(node_group, steps, ...), which has a row for each group.

    steps is an array of struct(before, after) from the leaf to the root, and on as above has them: what stands before and
    after the node among the inputs of the node over it, concatenated in order.
    """
    most = leaves.agg(F.max("size")).first()[0] or 0
    tiers = -(-max(1, sum(p < most for p in _POWERS)) // TIER)
    extra = [c for c in above.columns if c not in ("node_group", "steps")]
    known = above.withColumn("place", F.lit(0).cast("long"))
    for tier in reversed(range(tiers)):
        base = tier * TIER
        # every node of a level is over just one leaf of these; where the root stands below, its place goes on as 0
        items = leaves.where(F.col("place") % _POWERS[base] == 0).select("node_group", _over(F.col("place"), _POWERS[base]).alias("item"), _at(F.col("size"), base).alias("held"))
        way = F.array(*[F.struct(F.lit(base + k).alias("level"), _over(F.col("item"), _POWERS[k]).alias("at"), _at(F.col("held"), k).alias("held")) for k in range(TIER)])
        way = F.filter(way, lambda s: s["held"] > 1)
        items = items.withColumn("way", way)
        asked = items.select("node_group", "item", F.inline(F.flatten(F.transform("way", _siblings))))
        given = asked.join(nodes.where(F.col("level").between(base, base + TIER - 1)), ["node_group", "level", "place"])
        proofs = given.groupBy("node_group", "item").agg(F.sort_array(F.collect_list(F.struct("level", "place", "node"))).alias("siblings"))
        steps = F.transform("way", _step)
        own = items.join(proofs, ["node_group", "item"], "left").select("node_group", "item", steps.alias("own"))
        over = known.withColumnsRenamed({"place": "block", "steps": "rest"})
        known = own.withColumn("block", _over(F.col("item"), _BLOCK)).join(over, ["node_group", "block"])
        known = known.select("node_group", F.col("item").alias("place"), F.concat("own", "rest").alias("steps"), *extra)
    return leaves.join(known, ["node_group", "place"])


def root_of(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """node_group, node: the root of each tree; a lone leaf is its own."""
    height = leaves.where("place = 0").select("node_group", _levels(F.col("size")).alias("level"))
    return nodes.where("place = 0").join(height, ["node_group", "level"]).select("node_group", "node")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give."""
    return F.aggregate(steps, leaf, lambda node, s: digest(s["before"], node, s["after"]))


def manifest(docs: DataFrame, hashed: list[str], group: str, order: str, altered: Column | None = None, text: str = "text") -> DataFrame:
    """Per row of docs: order (its column), leaf, altered_leaf, subroot, root, steps.

    A leaf is the digest of the columns ``hashed``, as field() gives them. Per value of ``group``, null too, leaves ascend by
    ``order`` (nulls first, then by their digests: equal rows have equal leaves, and places of their own), and make a tree;
    the subroots, by ``group`` (null first), make the tree of the root. ``altered`` is what stands for ``text`` in
    altered_leaf, null where it isn't another. An empty table gives no rows; other columns are ignored.
    """
    tables = Tables()
    leaf = digest(*(field(F.col(c)) for c in hashed))
    other = digest(*(field(altered if c == text else F.col(c)) for c in hashed)) if altered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(order).alias("key"), F.col(group).alias("named"), leaf.alias("node"), other.alias("altered"))
    rows = rows.withColumn("altered", F.when(F.col("altered") != F.col("node"), F.col("altered")))
    rows = tables.keep(rows, "leaves").withColumn("node_group", field(F.col("named")))
    leaves = tables.keep(ranked(rows, ["named", "node_group"], [F.col("key"), F.col("node")], tables, "place", "size").drop("named"), "leaves-placed")
    nodes = nodes_of(leaves, tables)
    named = rows.select("node_group", "named").distinct()
    sub = tables.keep(root_of(nodes, leaves).join(named, "node_group"), "subroots")
    top = ranked(sub.select(F.lit("").alias("all"), F.col("node_group").alias("of"), "named", "node"), ["all"], [F.col("named")], tables, "place", "size")
    top = tables.keep(top.withColumnRenamed("all", "node_group").drop("named"), "subroots-placed")
    over = nodes_of(top, tables)
    root = root_of(over, top).select("node_group", F.array().cast("array<struct<before:string,after:string>>").alias("steps"), F.col("node").alias("root"))
    above = climb(top, over, root).select(F.col("of").alias("node_group"), F.col("node").alias("subroot"), "steps", "root")
    found = climb(leaves, nodes, tables.keep(above, "subroot-steps"))
    return found.select(F.col("key").alias(order), F.col("node").alias("leaf"), F.col("altered").alias("altered_leaf"), "subroot", "root", "steps")


def proven(rows: DataFrame, order: str) -> DataFrame:
    """Of manifest(): order, leaf, subroot, root, proof_sha256, folded_root, verified; an altered leaf is the one that is checked."""
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), "")
    found = rows.withColumn("folded_root", fold(F.coalesce("altered_leaf", "leaf"), F.col("steps")))
    return found.select(order, "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
