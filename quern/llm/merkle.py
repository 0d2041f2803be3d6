"""Merkle manifest: leaves by group, levels collapsed by higher-order functions over arrays of fixed size, proofs.

A group's leaves are numbered in order (ranges and their totals, no group in one task) and gathered in blocks of
``arity ** LEVELS`` at most.  ``sequence``, ``transform``, ``slice`` and ``aggregate`` collapse a block's levels inside
a row; the roots of the blocks are the leaves of the next round, so a group of n leaves takes log(n) / log(512) rounds.
On the way back every block hands its members their siblings, and ``aggregate`` folds a leaf with them.  All of it is
DataFrame functions; the text itself goes no further than the hash of its leaf.

Results that are defined: any field may be null and counts as ``-``; null keys and null ids come first; rows that repeat an
id are leaves of their own, in the order of their digests; a text of any length is hashed whole; extra columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.windows import sums_before
from quern.runtime import cut

ARITY = 8
#: Levels that are collapsed in one row; a block holds ARITY ** LEVELS digests at most.
LEVELS = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """A field of a leaf: its bytes in UTF-8 behind their number, or a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _parents(nodes: Column, arity: int) -> Column:
    """Digests of all runs of ``arity`` nodes, the last of which may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / arity).cast("int"))
    return F.transform(runs, lambda r: F.sha2(_joined(F.slice(nodes, r * arity + 1, F.lit(arity))), 256))


def _depth(n: Column, arity: int) -> Column:
    """Levels above n nodes until one remains: the least k with arity ** k >= n."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.struct(F.lit(0).alias("k"), F.lit(1).cast("decimal(38,0)").alias("room")), lambda s, _: F.when(s["room"] >= n, s).otherwise(F.struct((s["k"] + 1).alias("k"), (s["room"] * arity).cast("decimal(38,0)").alias("room"))))["k"]


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """(key, block, depth, members, level0 ...): nodes (key, rank, depth, node) gathered in blocks, and their levels."""
    size = arity**levels
    gathered = nodes.groupBy("key", F.floor(F.col("rank") / size).cast("long").alias("block")).agg(F.sort_array(F.collect_list(F.struct("rank", "node"))).alias("found"), F.max("depth").alias("depth"))
    made = gathered.select("key", "block", "depth", F.col("found.node").alias("level0"))
    for k in range(1, levels + 1):
        below = F.col(f"level{k - 1}")
        made = made.withColumn(f"level{k}", F.when(F.col("depth") >= k, _parents(below, arity)).otherwise(below))
    return made


def _siblings(place: Column, arity: int, levels: int) -> Column:
    """The (left, right) siblings of a member of a block, level by level; levels that the group lacks are left out."""

    def one(k: int) -> Column:
        at = F.floor(place / arity**k).cast("int")
        first = (F.floor(at / arity) * arity).cast("int")
        nodes = F.col(f"level{k}")
        left = _joined(F.slice(nodes, first + 1, at - first))
        right = _joined(F.slice(nodes, at + 2, F.greatest(first + arity - at - 1, F.lit(0))))
        return F.struct(left.alias("left"), right.alias("right"))

    return F.slice(F.array(*(one(k) for k in range(levels))), F.lit(1), F.least(F.col("depth"), F.lit(levels)))


def trees(nodes: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """(key, rank, root, path) of every node of (key, rank, node): ranks of a key go 0, 1, 2 ...

    ``path`` is the array of a node's (left, right) siblings, each the digests of a side joined, from the node up.
    """
    sizes = nodes.groupBy("key").agg((F.max("rank") + 1).alias("n")).select(F.col("key").alias("of"), _depth(F.col("n"), arity).alias("depth"))
    now = cut(nodes.join(sizes, F.col("key") == F.col("of")).select("key", "rank", "depth", "node"))
    rounds: list[DataFrame] = []
    while True:
        made = cut(_blocks(now, arity, levels))
        rounds.append(made)
        if made.where("block > 0").isEmpty():
            break
        now = made.select("key", F.col("block").alias("rank"), (F.col("depth") - levels).alias("depth"), F.element_at(f"level{levels}", 1).alias("node"))
        now = now.withColumn("depth", F.greatest("depth", F.lit(0)))
    none = F.array().cast("array<struct<left:string,right:string>>")
    upper = rounds[-1].select("key", "block", F.element_at(f"level{levels}", 1).alias("root"), none.alias("above"))
    for n in reversed(range(len(rounds))):
        # Both sides hold a row a block, so they can be dealt by block, whatever the size of a key.
        blocks = rounds[n].join(upper, ["key", "block"])
        members = blocks.select("*", F.posexplode("level0").alias("place", "node"))
        placed = members.select("key", (F.col("block") * arity**levels + F.col("place")).alias("rank"), "root", F.concat(_siblings(F.col("place"), arity, levels), "above").alias("path"))
        if n == 0:
            return placed
        upper = cut(placed.select("key", F.col("rank").alias("block"), "root", F.col("path").alias("above")))
    raise AssertionError("the first round returns")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: hashed(s["left"], node, s["right"]))


def leaf_of(row: dict[str, Column]) -> Column:
    return hashed(*(encoded(row[c]) for c in FIELDS))


def lower_ascii(text: Column) -> Column:
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def ordered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """A ``rank`` from 0 within each key, by ``order``, nulls first; no task holds a key."""
    return sums_before(df.withColumn("one", F.lit(1).cast("long")), [key], list(order), rank="one").drop("one")


def manifest(df: DataFrame, arity: int = ARITY, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``df``: doc_id, leaf, changed, subroot, root, path, of groups by lang and the tree over them.

    ``changed`` is the leaf after a change of the text to lower case, for one in three ids, else the leaf itself.
    """
    row = {c: F.col(f"`{c}`") for c in FIELDS}
    tampered = F.coalesce(F.crc32(row["doc_id"].cast("string")) % 3 == 0, F.lit(False))
    changed = F.when(tampered, leaf_of(row | {"text": lower_ascii(row["text"].cast("string"))})).otherwise(leaf_of(row))
    # A null group comes before all others, and these by the bytes of their names.
    group = F.coalesce(F.concat(F.lit("1"), row["lang"].cast("string")), F.lit("0"))
    leaves = cut(df.select(row["doc_id"].alias("doc_id"), group.alias("key"), leaf_of(row).alias("leaf"), changed.alias("changed"), F.monotonically_increasing_id().alias("row")))
    leaves = cut(ordered(leaves, "key", "doc_id", "leaf", "row"))
    placed = cut(trees(leaves.select("key", "rank", F.col("leaf").alias("node")), arity, levels))
    subroots = cut(placed.where("rank = 0").select(F.lit("").alias("all"), "key", F.col("root").alias("node")))
    tops = ordered(subroots, "all", "key").select(F.col("all").alias("top"), "key", "rank", "node")
    over = trees(tops.select(F.col("top").alias("key"), "rank", "node"), arity, levels).select("rank", F.col("root").alias("whole"), F.col("path").alias("above"))
    # One row a group; where groups are few this is broadcast by its size.
    named = cut(tops.join(over, "rank").select(F.col("key").alias("group"), "whole", "above"))
    below = placed.join(named, F.col("key") == F.col("group")).select("key", "rank", F.col("root").alias("subroot"), F.col("whole").alias("root"), F.concat("path", "above").alias("path"))
    return leaves.join(below, ["key", "rank"]).select("doc_id", "leaf", "changed", "subroot", "root", "path")


def verified(found: DataFrame) -> DataFrame:
    """Proofs and what they give: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    proof = F.sha2(_joined(F.transform("path", lambda s: F.concat(s["left"], s["right"]))), 256)
    shown = found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), fold(F.col("changed"), F.col("path")).alias("folded_root"))
    return shown.withColumn("verified", F.col("folded_root") == F.col("root"))
