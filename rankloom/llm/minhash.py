"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every text becomes its set of hashed word shingles and the k smallest of them, its sketch.
   Texts with equal sets form a class; one row per class goes on.
2. Retained values are inverted. Two sets as similar as asked share at least ``need`` of their
   retained values, so they meet in the list of one of the (kept - need + 1) rarest of either; only
   these are listed, and values that one class alone has are never listed.
3. In every list the members are first compared with its most typical one, whose retained values are
   in most sets: of a group of near copies that is the text they were made from, or close to it. This is
   linear however long the list is. Links found join components; then members outside a list's
   main component are listed once more by their full sets and there compared with the members of
   other components. So every pair of a list is compared, already connected or known to differ.
4. Candidates are filtered by the overlap of their sketches within the sketch of the union, and
   the exact Jaccard of the full sets decides.

``need`` is exact where the smaller set is retained whole; else the share of the union's sketch that
both have is hypergeometric with mean k x similarity, and ``need`` lies SIGMAS standard deviations
below it (a chance of 1e-9 per pair).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import attach, stored, text_of
from rankloom.llm.components import components
from rankloom.llm.shingles import sets_of

WORDS = 5
PERCENT = 80
KEPT = 128
SIGMAS = 6
ALL = 1 << 40  # retained values, where a set is listed whole
BEFORE = 64  # earlier values a listed one carries along
HUB = 500  # pairs of one document that may share one copy of its full set


def sampled_need(kept: int, percent: int) -> int:
    j = percent / 100
    return max(1, math.floor(kept * j - SIGMAS * math.sqrt(kept * j * (1 - j))))


def need(size: Column, kept: int, percent: int) -> Column:
    """Retained values that a set of ``size`` shares with any set as similar as asked."""
    whole = F.ceil(size * percent / F.lit(100))
    return F.when(size * 100 <= F.lit(kept * percent), whole).otherwise(
        F.least(whole, F.lit(sampled_need(kept, percent)))
    ).cast("int")


def _sets(docs: DataFrame, words: int, full: bool, kept: int = KEPT) -> DataFrame:
    """``docs`` (doc_id, t) as (doc_id, n, digest, sketch) or, if ``full``, (doc_id, shingles)."""
    id_field = T.StructField("doc_id", docs.schema["doc_id"].dataType)
    longs = T.ArrayType(T.LongType(), False)
    fields = [T.StructField("shingles", longs)] if full else [
        T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("sketch", longs)
    ]

    def lists(values: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, values)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*values, np.empty(0, np.int64)]), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                own = batch.slice(at, 256)
                sets = list(sets_of(own.column(1), words))
                if full:
                    cols = [lists(sets)]
                else:
                    cols = [
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        lists([s[:kept] for s in sets]),
                    ]
                yield pa.RecordBatch.from_arrays([own.column(0), *cols], names=["doc_id", *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([id_field, *fields]))


def _listed(classes: DataFrame, kept: int, percent: int) -> DataFrame:
    """(value, df, rep, n, typical, place, nth): every class under its rarest retained values, as many as
    have to be listed; ``typical`` sums up the frequencies of all its values, ``place`` counts those that are rarer, ``nth`` the listed ones up to it."""
    values = classes.select("rep", "n", F.size("sketch").alias("have"), F.explode("sketch").alias("value"))
    shared = stored(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "shared-values")
    total = shared.agg(F.sum("df")).first()[0] or 0
    found = attach(values, shared, "value", "df", total)
    # values of one class alone are the rarest, and there is nothing to meet in their lists. A set's values are
    # sorted, not collected: lists of them as objects, and a copy of the list for every value, filled the heap
    own = Window.partitionBy("rep", "n", "have").orderBy("df", "value")
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alone = F.col("have") - F.count(F.lit(1)).over(whole)
    return (
        found.withColumns({"typical": F.sum("df").over(whole), "alone": alone, "nth": F.row_number().over(own)})
        .filter(F.col("nth") <= F.col("have") - need(F.col("n"), kept, percent) + 1 - F.col("alone"))
        .select("value", "df", "rep", "n", "typical", (F.col("alone") + F.col("nth") - 1).alias("place"), "nth")
    )


def _with_before(listed: DataFrame) -> DataFrame:
    """``listed`` with ``before``: up to BEFORE listed values of the same set that come next before a value.

    Two sets meet once in every listed value they share; a meeting with a shared value among both ``before`` is no
    news. The meetings left are at most 1 + (listed values of both) / BEFORE, and an array's size is bounded.
    """
    last = Window.partitionBy("rep", "n").orderBy("nth").rowsBetween(-BEFORE, -1)
    return listed.withColumn("before", F.collect_list("value").over(last))


def _near_size(percent: int) -> Column:
    return (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)


def _by_sketch(pairs: DataFrame, classes: DataFrame, kept: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches agree within the sketch of their union as similar sets' do."""
    total = pairs.count()
    for side in ("b", "a"):  # a hub is in any share of the pairs
        own = classes.select(F.col("rep").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
        asked = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_asked"))
        pairs = attach(pairs, stored(own.join(asked, side), "asked-sketches"), side, "_asked", total).drop("_asked")
    union = F.array_union("s_a", "s_b")
    least = F.when(F.greatest("n_a", "n_b") <= kept, union).otherwise(F.slice(F.sort_array(union), 1, kept))
    # plain set operations: a lambda would work the union's sketch out again for every value
    shared = F.array_intersect("s_a", "s_b")
    asked = F.least(need(F.col("n_a"), kept, percent), need(F.col("n_b"), kept, percent))
    return pairs.filter(F.size(shared) >= asked).filter(F.size(F.array_intersect(shared, least)) >= asked).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough. ``docs``: doc_id, t; ids unique.

    Full sets are made only for documents in a pair. One that is in many pairs (a hub is always
    ``a``) is copied once per HUB pairs, so no key of the join grows with it.
    """
    wanted = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct(), "wanted")
    sets = stored(_sets(docs.join(wanted, "doc_id", "left_semi"), words, True), "full-sets")
    hubs = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB).cast("int").alias("copies"))
    copied = hubs.join(sets, F.col("a") == F.col("doc_id")).select(
        "a", F.col("shingles").alias("s_a"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    )
    dealt = pairs.join(hubs, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int") + 1)
    both = dealt.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("s_b")), "b").join(copied, ["a", "copy"])
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.withColumn("shared", shared).filter(
        F.col("shared") * 100 >= (F.size("s_a") + F.size("s_b") - F.col("shared")) * percent
    ).select("a", "b")


def _links(classes: DataFrame, docs: DataFrame, words: int, percent: int, kept: int) -> DataFrame:
    """Links (a, b) between classes whose components are those of all links."""
    listed = stored(_listed(classes, kept, percent).select("value", "rep", "n", "typical"), "listed-values")
    center = F.min(F.struct((-F.col("typical")).alias("t"), "rep", "n")).alias("center")
    lists = stored(listed.groupBy("value").agg(F.count(F.lit(1)).alias("members"), center).filter("members > 1"), "lists")
    total = lists.agg(F.sum("members")).first()[0] or 0
    stars = attach(listed.select("value", "rep", "n"), lists, "value", "members", total)
    first = (
        stars.select(F.col("center.rep").alias("a"), F.col("center.n").alias("n_a"), F.col("rep").alias("b"), F.col("n").alias("n_b"))
        .filter(F.col("a") != F.col("b")).filter(_near_size(percent)).select("a", "b").distinct()
    )
    first = stored(_by_sketch(stored(first, "first-pairs"), classes, kept, percent), "star-pairs")
    first = stored(_verified(first, docs, words, percent), "star-links")

    # what is left: members of one list in different components
    member = components(first)
    placed = stored(
        listed.join(member, F.col("rep") == F.col("node"), "left")
        .select("value", "rep", F.coalesce("component", "rep").alias("component")), "placed-members",
    )
    split = placed.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high"))
    split = stored(split.filter("low < high").select("value", "members"), "split-lists")
    unsure = attach(placed, split, "value", "members", split.agg(F.sum("members")).first()[0] or 0).select(F.col("rep").alias("doc_id"))
    rest = _across(stored(unsure.distinct(), "unsure"), member, docs, words, percent)
    if rest.isEmpty():
        return first
    return first.union(_verified(rest, docs, words, percent))


def _across(ids: DataFrame, member: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``ids`` in different components that may be similar, by their full sets.

    The same inverted lists as of the sketches, but of whole sets, whose share of common values
    is no estimate: only as many of the rarest are listed as similar sets may differ in, and what a near
    copy has alone is the rarest. Members of a list that are outside its main component are paired
    with the others, in the first list they share and in later ones only where that lies BEFORE values back.
    """
    sets = stored(_sets(docs.join(ids, "doc_id", "left_semi"), words, True), "unsure-sets")
    whole = sets.select(F.col("doc_id").alias("rep"), F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("sketch"))
    listed = stored(_with_before(_listed(whole, ALL, percent)).select("value", "rep", "n", "place", "before"), "full-listed")
    placed = listed.join(member, F.col("rep") == F.col("node"), "left").select(
        "value", "rep", "n", "place", "before", F.coalesce("component", "rep").alias("component")
    )
    placed = stored(placed, "full-placed")
    sizes = placed.groupBy("value", "component").agg(F.count(F.lit(1)).alias("c"))
    main = sizes.groupBy("value").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("c").alias("members"), F.max(F.struct("c", "component")).alias("m")
    ).filter("parts > 1").select("value", "members", F.col("m.component").alias("main"))
    main = stored(main, "full-split-lists")
    lists = stored(attach(placed, main, "value", "members", main.agg(F.sum("members")).first()[0] or 0), "full-open-lists")
    x, y = (lists.select("value", "main", *[F.col(c).alias(f"{c}_{k}") for c in ("rep", "n", "component", "place", "before")]) for k in "xy")
    met = (
        (F.col("component_x") != F.col("component_y"))
        & ((F.col("component_y") == F.col("main")) | (F.col("rep_x") < F.col("rep_y")))
        & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent)
        # all they share lies from here on, and similar sets share at least this much
        & (F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent)
        & ~F.arrays_overlap("before_x", "before_y")
    )
    pairs = y.join(x.filter("component_x != main").drop("main"), "value").filter(met)
    return stored(pairs.select(F.least("rep_x", "rep_y").alias("a"), F.greatest("rep_x", "rep_y").alias("b")).distinct(), "rest-pairs")


def near_duplicates(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, kept: int = KEPT
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 x shared shingles >= percent x shingles of either;
    component_id is the smallest id reachable over links. Texts of fewer than ``words`` words are one
    shingle; null and empty texts have none and are linked with nothing. Ids are whole numbers and
    should be unique: rows that repeat an id are one document, linked when any of its texts is. Rows
    without an id are linked with nothing and keep a null component. No rows give no rows.
    """
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("t"))
    sketched = stored(_sets(rows, words, False, kept), "sketches")
    has = sketched.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(
        has.groupBy("digest").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
        ),
        "classes",
    )
    links = _links(classes, rows.filter("doc_id IS NOT NULL"), words, percent, kept)
    member = components(links)
    named = stored(
        classes.select("digest", "rep", "copies").join(member, F.col("rep") == F.col("node"), "left")
        .select("digest", "copies", F.coalesce("component", "rep").alias("component_id")), "named-classes",
    )
    found = attach(has.select("doc_id", "n", "digest"), named, "digest", "copies", has.count()).select("doc_id", "n", "component_id")
    alone = sketched.filter("n = 0 OR doc_id IS NULL").select(
        "doc_id", "n", F.col("doc_id").alias("component_id")
    )
    return found.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, whole, that are the smallest of their component: see ``near_duplicates``."""
    dropped = near_duplicates(docs, id=id, text=text, **options).filter("NOT kept").select(F.col("doc_id").alias("_dropped_id"))
    dropped = stored(dropped.distinct(), "dropped-near-copies")
    return docs.join(dropped, docs[id] == dropped["_dropped_id"], "left_anti")
