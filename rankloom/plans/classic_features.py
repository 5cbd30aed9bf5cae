"""The older, smaller feature build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators import clean, features, splits, stats
from rankloom.operators.skew import attach, dealt, stored
from rankloom.roles import Roles


def classic_features(
    df: DataFrame, roles: Roles = Roles(), labelled: bool = True, sparse_threshold: float = 0.9
) -> DataFrame:
    """Label, date parts, sparse columns dropped, group normalisations and differences.

    The price is replaced by its log10 before anything is computed from it. Columns named
    like the labels are dropped; keys, position and the random flag stay until scoring
    (``clean.drop_bias_columns``).
    """
    r = roles
    if labelled:
        df = df.withColumn("target", features.first_match_target(r))
    df = df.withColumns(features.date_parts(r.time)).drop(r.time)
    df = clean.drop_sparse_columns(df, sparse_threshold, keep=(*clean.KEEP_WHEN_SPARSE, "target"))
    df, by_query = dealt(df, [r.query])

    df = stats.normalise(df, r.query, r.price, take_log10=True, hot=by_query)
    df = stats.normalise(df, r.query, r.star, hot=by_query)
    for c in (r.loc2, r.loc1, r.review):
        df = stats.normalise(df, r.query, c, hot=by_query)
    for c in (r.star, r.loc2, r.loc1, r.review, r.promo):
        df = stats.group_transform(df, r.query, c, ["mean"], hot=by_query)
    # items and markets have few numbers each: these go to the rows, which are wide by now and stay where they are
    df = stored(df)
    df = stats.normalise(df, r.item, r.price, joined=True)
    df = stats.group_transform(df, r.item, r.price, ["mean"], joined=True)
    df = stats.group_transform(df, r.market, r.price, ["mean"], joined=True)
    return df.drop(*[c for c in clean.LABEL_COLUMNS if c != "target"])


def block_holdout(
    df: DataFrame, roles: Roles = Roles(), blocks: int = 10, block: int = 0, exclude_random: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(train, validation): one contiguous block of queries held out, and the estimated
    position learnt on the training part joined to both."""
    numbered = splits.add_block(df, roles.query, blocks)
    train = numbered.filter(F.col("block") != block).drop("block")
    val = numbered.filter(F.col("block") == block).drop("block")
    positions = stats.estimated_position(train, roles, exclude_random)
    keys = [roles.market, roles.item]
    return attach(train, positions, keys), attach(val, positions, keys)
