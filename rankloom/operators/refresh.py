"""Statistics that are brought up to date delivery by delivery, without the earlier rows.

A store is a Parquet folder with one part per delivery (a day, a late file, a back-fill) and in it one row
per key: counts, totals, means, squared deviations and extremes, all of which merge. A new delivery reads its
own rows only. Delivering an id again replaces what that id held, so a repeated or corrected day is not
counted twice, while late rows come under an id of their own and are added.

Work of a delivery grows with its rows (aggregated where they are, then one shuffle of a row per key);
reading the statistics grows with keys x deliveries. A key has at most one row per delivery, so no key is
hot in a store, whatever share of the rows it holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.columns import smoothed_rate
from rankloom.operators.encode import Target
from rankloom.operators.stats import MARKET_COLUMNS
from rankloom.roles import Roles

DELIVERY = "delivery_id"
ROWS = "rows"


def _number(df: DataFrame, column: str) -> Column:
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.IntegralType):
        return c
    return c.cast("int" if isinstance(kind, T.BooleanType) else "double")


def deliver(df: DataFrame, store: str, keys: Sequence[str], measures: Sequence[str], delivery: str | Column) -> None:
    """Put the rows of ``df`` into ``store``, replacing the deliveries that they belong to.

    ``delivery``: an id for all rows, or a column with the id of each. The parts of those ids are swapped
    when the whole job has succeeded; a job that died is run again as it was. NULL keys are a key, NULL
    ids a delivery; measures skip NULLs. No rows change nothing. Keys and measures of a store, and
    their types, never change.
    """
    names = {n.lower() for n in (*keys, *measures)}
    if len(names) < len(keys) + len(measures) or names & {DELIVERY, ROWS}:
        raise ValueError(f"keys and measures must differ and not be called {DELIVERY} or {ROWS}")
    id = F.lit(delivery) if isinstance(delivery, str) else delivery
    # named apart first, so that any further column of df, of whatever name, is out of the way
    rows = df.select(
        id.cast("string").alias(DELIVERY), *[F.col(f"`{k}`").alias(k) for k in keys], *[_number(df, m).alias(m) for m in measures]
    )
    sums = rows.groupBy(DELIVERY, *[F.col(f"`{k}`") for k in keys]).agg(
        F.count(F.lit(1)).alias(ROWS), *[_part(F.col(f"`{m}`")).alias(m) for m in measures]
    )
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DELIVERY).parquet(store)


def _part(c: Column) -> Column:
    """n, total, mean, squared deviations from the mean, least and largest value."""
    return F.struct(
        F.count(c).alias("n"), F.sum(c).alias("total"), F.avg(c).alias("mean"),
        (F.var_pop(c) * F.count(c)).alias("m2"), F.min(c).alias("lo"), F.max(c).alias("hi"),
    )


def _joined(a: Column, b: Column) -> Column:
    """Count, mean and squared deviations of two sets of values together."""
    n = a["n"] + b["n"]
    apart = b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"),
        (a["mean"] + apart * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2"),
    )
    return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(both)


def _member(name: str, part: Column) -> Column:
    return part[name]


def merged(spark: SparkSession, store: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per key over all deliveries: ``rows`` and, per measure, ``{m}_n _total _mean _std _min _max``.

    As if all rows had been aggregated at once: a total or mean without a value is NULL, a sample deviation
    with fewer than two. The parts of a key are folded in the order of their delivery, so results do not
    depend on how tasks ran.
    """
    parts = spark.read.parquet(store)
    key = [F.col(f"`{k}`") for k in keys]
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    held = parts.groupBy(*key).agg(
        F.sum(ROWS).alias(ROWS),
        F.sort_array(
            F.collect_list(  # a row per delivery
                F.struct(
                    F.col(DELIVERY).cast("string").alias("_id"),
                    *[F.struct(*[F.col(f"`{m}`.{f}").alias(f) for f in ("n", "mean", "m2")]).alias(f"_{i}") for i, m in enumerate(measures)],
                )
            )
        ).alias("_parts"),
        *[
            fn(f"`{m}`.{f}").alias(f"{m}{end}")
            for m in measures
            for end, f, fn in (("_n", "n", F.sum), ("_total", "total", F.sum), ("_min", "lo", F.min), ("_max", "hi", F.max))
        ],
    )
    folds = {f"_fold{i}": F.aggregate(F.transform("_parts", partial(_member, f"_{i}")), zero, _joined) for i in range(len(measures))}
    columns = []
    for i, m in enumerate(measures):
        n, m2 = F.col(f"`{m}_n`"), F.col(f"_fold{i}.m2")
        columns += [
            n, F.col(f"`{m}_total`"), F.when(n > 0, F.col(f"_fold{i}.mean")).alias(f"{m}_mean"),
            F.when(n > 1, F.sqrt(m2 / (n - 1))).alias(f"{m}_std"), F.col(f"`{m}_min`"), F.col(f"`{m}_max`"),
        ]
    return held.withColumns(folds).select(*key, ROWS, *columns)


# --- the statistics that need recomputing when rows arrive ---------------------


def item_rates(spark: SparkSession, store: str, keys: Sequence[str], targets: Sequence[Target]) -> tuple[DataFrame, dict[str, float]]:
    """(smoothed rates per key, global rates) from a store whose measures are the targets' labels."""
    # totals alone: no need to fold
    parts = spark.read.parquet(store)
    row = parts.agg(*[F.try_divide(F.sum(f"`{t.label}`.total"), F.sum(f"`{t.label}`.n")).alias(t.label) for t in targets]).first()
    prior = {t.label: row[t.label] if row[t.label] is not None else 0.0 for t in targets}
    sums = parts.groupBy(*keys).agg(
        F.sum(ROWS).alias("_n"), *[F.coalesce(F.sum(f"`{t.label}`.total"), F.lit(0)).alias(f"_{t.label}") for t in targets]
    )
    rates = [smoothed_rate(F.col(f"_{t.label}"), F.col("_n"), F.lit(prior[t.label]), t.m).alias(t.out) for t in targets]
    return sums.select(*keys, *rates), prior


def deliver_positions(df: DataFrame, store: str, delivery: str | Column, by_market: bool = False, roles: Roles = Roles()) -> None:
    """Positions of rows not shown in random order, per item or per (market, item)."""
    keys = (roles.market, roles.item) if by_market else (roles.item,)
    deliver(df.filter(F.col(roles.random_flag) == 0), store, keys, (roles.position,), delivery)


def position_profile(spark: SparkSession, store: str, roles: Roles = Roles()) -> DataFrame:
    """``stats.position_profile`` of all rows delivered so far."""
    p = roles.position
    return merged(spark, store, (roles.item,), (p,)).select(
        roles.item, F.col(f"{p}_mean").alias("prop_avg_position"), F.col(f"{p}_min").alias("prop_best_position"),
        F.col(f"{p}_std").alias("prop_position_std"), F.col(ROWS).alias("prop_nonrandom_appearances"),
    )


def estimated_position(spark: SparkSession, store: str, roles: Roles = Roles()) -> DataFrame:
    """``stats.estimated_position`` of all rows delivered so far, from a store by market."""
    found = merged(spark, store, (roles.market, roles.item), (roles.position,))
    return found.select(roles.market, roles.item, F.try_divide(F.lit(1.0), F.col(f"{roles.position}_mean")).alias("estimated_position"))


def market_columns(roles: Roles = Roles()) -> Mapping[str, str]:
    """Short name -> column of a market's statistics."""
    return {short: getattr(roles, role) for short, role in MARKET_COLUMNS.items()}


def deliver_markets(df: DataFrame, store: str, delivery: str | Column, roles: Roles = Roles()) -> None:
    deliver(df, store, (roles.market,), tuple(market_columns(roles).values()), delivery)


def market_stats(spark: SparkSession, store: str, roles: Roles = Roles()) -> DataFrame:
    """``stats.market_stats`` of all rows delivered so far."""
    short = market_columns(roles)
    found = merged(spark, store, (roles.market,), tuple(short.values()))
    pairs = [[F.col(f"{c}_mean").alias(f"dest_{s}_mean"), F.col(f"{c}_std").alias(f"dest_{s}_std")] for s, c in short.items()]
    return found.select(roles.market, *reduce(list.__add__, pairs, []), F.col(ROWS).alias("dest_search_count"))
