"""The prefix trie of conversations, its subtrees summed by the Euler-tour technique.

1. A node is a distinct sequence of first turns. Its key is the sum of one hash per turn, taken over
   place, role and text (two of 56 bits each), so keys of all prefixes are running totals and no
   conversation is ever gathered in a task. Smallest member and depth name a node.
2. Every node is entered and left once: two arcs. Entering leads to the first child (children in the
   order of their smallest members) or, in a leaf, to leaving; leaving leads to the next sibling's
   entering or to the parent's leaving.
3. Arcs of nodes with the same smallest member are neighbours on the tour wherever no branch lies
   between, so such runs are joined first (windows of BLOCK depths); the list of runs is ranked by
   ``list_ranking``. That gives each arc's place on the tour and the leaves and savings up to it.
4. A subtree is what lies between a node's two arcs: its sums are differences of the sums there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import attach, running, stored
from rankloom.llm.list_ranking import sums_before

BLOCK = 4096  # depths of one path that are joined in one window
IDS = 4096  # ids that make one row on their way to the digest
EMPTY = hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, said, bytes): turns numbered from 1 inside their conversation.

    ``said`` is the text's SHA-256, so texts are read once and never shuffled. Turns that share a
    number (or have none: these are first) are ordered by role, then by ``said``. Rows without a
    conv_id belong to no conversation.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("said"), F.octet_length(text).cast("long").alias("bytes"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")]
    return running(rows, ["conv_id"], order, pos=F.lit(1)).drop("turn")


def shared_starts(turns: DataFrame, family: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of another: (members, turns).

    Conversation c takes the first h turns of c - c % family, h = crc32(c) % heads, then its own
    after its first h. members: conv_id, length; turns: conv_id, depth, role, said, bytes.
    """
    turns = stored(turns, "ordered-turns")
    own = stored(
        turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads)))
        .withColumn("base", F.col("conv_id") - F.col("conv_id") % family), "conversations",
    )
    known = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    members = stored(
        own.join(known, "base", "left").withColumn("taken", taken)
        .withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "members",
    )
    later = attach(turns, members, "conv_id", "n", turns.count()).filter("pos > h")
    later = later.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "role", "said", "bytes")
    # no more than heads - 1 turns of a base and twice ``family`` conversations on it
    first = turns.filter((F.col("pos") < heads) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    first = first.join(members.select("conv_id", "base", "h"), "base").filter("pos <= h")
    first = first.select("conv_id", F.col("pos").cast("long").alias("depth"), "role", "said", "bytes")
    return members.select("conv_id", "length"), first.unionByName(later)


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form of ``shared_starts``."""
    turns = stored(turns, "ordered-turns")
    members = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    return members, turns.withColumn("depth", F.col("pos").cast("long")).drop("pos")


def _hash(k: int) -> Column:
    """56 bits, number ``k`` of a turn's SHA-256 over its place, role and text."""
    all_of = F.concat(
        F.concat_ws(":", F.col("depth").cast("string"), F.octet_length("role").cast("string"), "role").cast("binary"), F.col("said")
    )
    return F.conv(F.substring(F.sha2(all_of, 256), 1 + 14 * k, 14), 16, 10).cast("decimal(18,0)")


def _nodes(members: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): nodes with their keys, and which conversation ends in which node."""
    hashed = turns.select("conv_id", "depth", "bytes", _hash(0).alias("h1"), _hash(1).alias("h2"))
    summed = running(hashed, ["conv_id"], [F.col("depth")], k1=F.col("h1"), k2=F.col("h2"))
    none = F.lit(0).cast(summed.schema["k1"].dataType)
    rows = summed.select(
        "conv_id", "depth", "bytes", "k1", "k2", (F.col("k1") - F.col("h1")).cast(summed.schema["k1"].dataType).alias("p1"),
        (F.col("k2") - F.col("h2")).cast(summed.schema["k2"].dataType).alias("p2"),
    )
    roots = members.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("bytes"),
        none.alias("k1"), none.alias("k2"), none.alias("p1"), none.alias("p2"),
    )
    rows = stored(rows.unionByName(roots), "prefixes")
    total = members.count()
    ends = attach(rows.select("conv_id", "depth", "k1", "k2"), members.withColumn("w", F.col("length") + 1), "conv_id", "w", total)
    ends = stored(ends.filter("depth = length").select(F.col("conv_id").alias("member"), "depth", "k1", "k2"), "ends")
    key = ["depth", "k1", "k2"]
    nodes = rows.groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
        F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
    )
    nodes = nodes.join(ends.groupBy(*key).agg(F.count(F.lit(1)).alias("n_ends")), key, "left")
    return stored(nodes, "nodes"), ends


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes with parent, number of children, first child and next sibling."""
    key = ["depth", "k1", "k2"]
    below = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), "conv_id")
    families = below.groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("first_child"))
    own = stored(nodes.join(families, key, "left").fillna(0, ["n_children"]), "families")
    parents = own.filter("n_children > 0").select(
        F.col("depth").alias("p_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("w"),
    )
    # a parent may have any share of the nodes as children
    children = own.filter("depth > 0").withColumn("p_depth", F.col("depth") - 1)
    children = attach(children, parents, ["p_depth", "p1", "p2"], "w", own.count()).drop("p_depth", "w")
    placed = stored(running(children, ["parent_conv_id", "depth"], [F.col("conv_id")], place=F.lit(1)), "children")
    after = placed.select("parent_conv_id", "depth", (F.col("place") - 1).alias("place"), F.col("conv_id").alias("sibling"))
    placed = placed.join(after, ["parent_conv_id", "depth", "place"], "left").drop("place")
    root = own.filter("depth = 0").withColumns({"parent_conv_id": F.lit(None).cast("long"), "sibling": F.lit(None).cast("long")})
    return stored(placed.unionByName(root).drop("p1", "p2"), "linked-nodes")


def _arc(conv: str, depth: Column, leaving: bool) -> Column:
    return F.struct(F.col(conv).alias("c"), depth.alias("d"), F.lit(leaving).alias("out"))


def _tour(nodes: DataFrame) -> DataFrame:
    """Arcs with their successors: c, d, out, next, leaves, saved."""
    depth = F.col("depth")
    leaf = F.col("n_children") == 0
    entering = nodes.select(
        F.col("conv_id").alias("c"), depth.alias("d"), F.lit(False).alias("out"),
        F.when(leaf, _arc("conv_id", depth, True)).otherwise(_arc("first_child", depth + 1, False)).alias("next"),
        leaf.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"),
    )
    leaving = nodes.select(
        F.col("conv_id").alias("c"), depth.alias("d"), F.lit(True).alias("out"),
        F.when(F.col("sibling").isNotNull(), _arc("sibling", depth, False))
        .when(depth > 0, _arc("parent_conv_id", depth - 1, True)).alias("next"),
        F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"),
    )
    return entering.unionByName(leaving)


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens, enters_at) from sums at the places of the arcs."""
    arcs = _tour(nodes).withColumn("at", F.struct("c", "d", "out"))
    arcs = arcs.withColumns({"block": F.floor(F.col("d") / BLOCK), "step": F.when(F.col("out"), -F.col("d")).otherwise(F.col("d"))})
    path = Window.partitionBy("c", "block").orderBy("out", "step")
    arcs = arcs.withColumn("new", F.when(F.lag("next").over(path).eqNullSafe(F.col("at")), 0).otherwise(1))
    arcs = arcs.withColumns({"run": F.sum("new").over(path), "last": F.coalesce(F.lead("new").over(path), F.lit(1)) == 1})
    run = Window.partitionBy("c", "block", "run").orderBy("out", "step")
    upto = run.rowsBetween(Window.unboundedPreceding, 0)
    arcs = arcs.withColumns(
        {
            "head": F.first("at").over(run), "sum_arcs": F.count(F.lit(1)).over(upto),
            "sum_leaves": F.sum("leaves").over(upto), "sum_saved": F.sum("saved").over(upto),
        }
    )
    arcs = stored(arcs.select("c", "d", "out", "next", "leaves", "saved", "last", "head", "sum_arcs", "sum_leaves", "sum_saved"), "arcs")
    names = ["arcs", "n_leaves", "n_saved"]
    runs = arcs.filter("last").select(
        F.col("head").alias("at"), "next", F.col("sum_arcs").alias("arcs"), F.col("sum_leaves").alias("n_leaves"), F.col("sum_saved").alias("n_saved")
    )
    before = sums_before(runs, names).withColumnRenamed("at", "head")
    sign = F.when(F.col("out"), 1).otherwise(-1)
    own = lambda c: F.when(F.col("out"), 0).otherwise(F.col(c))  # noqa: E731  entering counts for the node itself
    placed = arcs.join(before, "head")
    return placed.groupBy(F.col("c").alias("conv_id"), F.col("d").alias("depth")).agg(
        F.sum(sign * (F.col("n_leaves") + F.col("sum_leaves") - own("leaves"))).alias("n_leaves"),
        F.sum(sign * (F.col("n_saved") + F.col("sum_saved") - own("saved"))).alias("saved_tokens"),
        F.min(F.col("arcs") + F.col("sum_arcs")).alias("enters_at"),
    )


def _ends_digest(ends: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of nodes in which a conversation ends.

    SHA-256 takes its input in one go, so a node's ids go through one task; but as rows of IDS ids,
    one after the other, however many they are.
    """
    named = nodes.filter("n_ends > 0").select("depth", "k1", "k2", "conv_id", "n_ends")
    rows = attach(ends, named, ["depth", "k1", "k2"], "n_ends", ends.count()).select("conv_id", "depth", "member")
    key = ["conv_id", "depth"]

    def joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = f.groupby(key, sort=False).cumcount() // IDS
            parts = f.groupby([*key, at], sort=False)["member"]
            first, ids = parts.min(), parts.agg(lambda m: ",".join(map(str, m)))
            yield pd.DataFrame(
                {"conv_id": first.index.get_level_values(0), "depth": first.index.get_level_values(1), "first": first.to_numpy(), "ids": ids.to_numpy(object)}
            )

    def digested(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for f in frames:
            done = []
            for c, d, ids in zip(f["conv_id"], f["depth"], f["ids"]):
                if (c, d) == now:
                    state.update(b",")
                else:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (c, d), hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=[*key, "ends_sha256"])
        if now:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=[*key, "ends_sha256"])

    sorted_rows = rows.repartitionByRange(*key, "member").sortWithinPartitions(*key, "member")
    parts = sorted_rows.mapInPandas(joined, "conv_id long, depth long, first long, ids string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInPandas(digested, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(members: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns``: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256 and enters_at, its place on the tour.

    ``members``: conv_id, length (0 for a conversation without turns); ``turns``: conv_id, depth (1 to
    length), role, said, bytes: as ``shared_starts`` or ``whole`` return them. Repeated rows are
    turns like others; other columns are not read. No members give no rows, not even a root.
    """
    members = stored(members, "trie-members")
    nodes, ends = _nodes(members, turns)
    linked = _linked(nodes)
    out = linked.join(_subtrees(linked), ["conv_id", "depth"]).join(_ends_digest(ends, nodes), ["conv_id", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "enters_at",
    )
