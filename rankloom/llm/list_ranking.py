"""Sums along a linked list whose elements lie anywhere: contract, solve the rest, expand.

In each round every element draws a random number. One that beats both neighbours' goes out: its
predecessor takes over its sums and its successor, and what the predecessor held until then is noted
as the offset of the element that left. A third of the list goes each round, so all rounds together
are linear in it. A remnant of at most LEFT elements, however long the list was, is walked in one
task; then the rounds are undone from the last to the first, each by one join on the predecessor.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored

LEFT = 4096
MAX_ROUNDS = 200  # (2/3) ** 200 of any list is less than one element


def _draw(column: str, seed: int) -> Column:
    return F.when(F.col(column).isNull(), F.lit(-(2**63))).otherwise(F.xxhash64(F.lit(seed), F.col(column)))


def sums_before(links: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Per element what the list holds before it: (at, the columns ``sums``).

    ``links``: at (any hashable type), next (null for the last) and whole numbers ``sums``, one row
    per element of one list. Two lists or a ring are an error. No rows give no rows.
    """
    sums = list(sums)
    now, undo = stored(links.select("at", "next", *sums), "list"), []
    left = now.count()
    for seed in range(MAX_ROUNDS):
        if left <= LEFT:
            break
        drawn = now.withColumns({"_own": _draw("at", seed), "_next": _draw("next", seed)})
        out = drawn.filter("_own > _next").select(
            F.col("at").alias("o_at"), F.col("next").alias("o_next"), *[F.col(c).alias(f"o_{c}") for c in sums]
        )
        takers = drawn.filter("_own < _next").drop("_own", "_next")
        taken = stored(takers.join(out, takers["next"] == out["o_at"], "left"), "list-taken")
        gone = taken.filter("o_at IS NOT NULL")
        stay = out.join(gone.select("o_at"), "o_at", "left_anti").toDF("at", "next", *sums)
        same = drawn.filter("_own = _next").drop("_own", "_next")
        merged = taken.select(
            "at", F.when(F.col("o_at").isNull(), F.col("next")).otherwise(F.col("o_next")).alias("next"),
            *[(F.col(c) + F.coalesce(f"o_{c}", F.lit(0))).alias(c) for c in sums],
        )
        undo.append(gone.select(F.col("o_at").alias("at"), F.col("at").alias("after"), *sums))
        now = stored(merged.unionByName(stay).unionByName(same), "list")
        left = now.count()
    else:
        raise RuntimeError("the list does not get shorter")
    placed = stored(_walked(now, sums), "list-placed")
    for one in reversed(undo):
        before = placed.select(F.col("at").alias("after"), *[F.col(c).alias(f"b_{c}") for c in sums])
        back = one.join(before, "after").select("at", *[(F.col(c) + F.col(f"b_{c}")).alias(c) for c in sums])
        placed = stored(placed.unionByName(back), "list-placed")
    return placed


def _walked(links: DataFrame, sums: list[str]) -> DataFrame:
    """The sums before each of at most LEFT elements, in one task."""
    key, kinds = links.schema["at"], [links.schema[c] for c in sums]
    numbered = links.select(F.to_json(F.struct("at")).alias("j"), F.to_json(F.struct(F.col("next").alias("at"))).alias("k"), *sums)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([f for f in frames if len(f)] or [pd.DataFrame(columns=["j", "k", *sums])], ignore_index=True)
        place = {j: i for i, j in enumerate(rows["j"])}
        heads = set(place) - set(rows["k"])
        if len(rows) and len(heads) != 1:
            raise ValueError("not one list")
        values, after = rows[sums].to_numpy(object), list(rows["k"])
        at, total, out = place[heads.pop()] if len(rows) else None, [0] * len(sums), []
        while at is not None:
            out.append((rows["j"][at], *total))
            total = [int(a) + int(b) for a, b in zip(total, values[at])]
            at = place.get(after[at])
        if len(out) != len(rows):
            raise ValueError("not one list")
        yield pd.DataFrame(out, columns=["j", *sums])

    done = numbered.coalesce(1).mapInPandas(walk, "j string, " + ", ".join(f"`{k.name}` {k.dataType.simpleString()}" for k in kinds))
    kind = f"struct<at:{key.dataType.simpleString()}>"
    return done.select(F.from_json("j", kind)["at"].alias("at"), *sums)
