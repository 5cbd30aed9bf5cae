"""The full feature build: one table with train, validation and test rows.

All rows go through one plan. Which rows a statistic is learnt from depends on the
row's ``split`` and is written down as data:

===========================  ==============  ==============  ==================
statistic                    train row       val row         test row
===========================  ==============  ==============  ==================
clip bounds                  labelled rows   labelled rows   labelled rows
query statistics and ranks   own query       own query       own query
largest booking window       labelled rows   labelled rows   test rows
item profile, frequencies    all rows        all rows        all rows
positions, markets           train rows      train rows      labelled rows
position fill (median)       own split       own split       own split
item and market-item rates   other folds     train rows      labelled rows
                             of train
rate priors                  train rows      train rows      train rows
===========================  ==============  ==============  ==================

Statistics of train rows and of all labelled rows come from one pass: both are
computed side by side per key and the join picks by split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import clean, encode, features, splits, stats
from rankloom.operators.skew import attach, dealt, discard, hot_rows, is_small, materialise, stored
from rankloom.roles import Roles
from rankloom.sources import tables

# Clip rules of the raw columns.
CLIP_RULES = {
    "price": (("q", 0.001), ("q", 0.999)),
    "window": (0, ("q", 0.999)),
    "stay": (1, ("q", 0.999)),
}


@dataclass(frozen=True)
class FeatureOptions:
    holdout_folds: int = 5
    encode_folds: int = 5
    target_rates: bool = True
    holdout_expr: Column | None = field(default=None, compare=False)
    encode_expr: Column | None = field(default=None, compare=False)
    quantile_method: str = "nearest"
    approximate_median: bool = False
    clip_outliers: bool = True


def clip_specs(roles: Roles) -> dict[str, tuple]:
    return {getattr(roles, role): ends for role, ends in CLIP_RULES.items()}


def base_features(
    df: DataFrame, roles: Roles = Roles(), keys: Sequence[str] | None = None, hot="detect"
) -> DataFrame:
    """Row features plus everything relative to the own query.

    One shuffle, on the query key. Only the price features are needed on its far side;
    all other features are computed after it, so they are never shuffled.
    """
    keys = list(keys or [roles.query])
    rows, hot = dealt(df, keys, hot)
    seen = features.add_query_windows(rows.withColumns(features.price_features(roles)), roles, keys, hot)
    return _finish(seen, df, roles, [k for k in keys if k != roles.query])


def _finish(df: DataFrame, rows: DataFrame, roles: Roles, by: Sequence[str], more_ranks=None) -> DataFrame:
    """The projections that follow the windows."""
    df = features.finish_query_features(df, roles, more_ranks)
    largest = features.largest_window(rows, roles, by)
    return features.count_window(features.add_row_features(df, roles), roles, by, largest)


def feature_table(
    labelled: DataFrame,
    test: DataFrame | None = None,
    roles: Roles = Roles(),
    options: FeatureOptions = FeatureOptions(),
) -> DataFrame:
    """All features for labelled and test rows; column ``split`` is train, val or test.

    Statistics are learnt from the raw rows. The rows are shuffled once on the query key,
    while they are narrow; statistics are joined after it (without a shuffle where they
    are small), and the features themselves are computed last.
    """
    o = options
    if o.clip_outliers:
        bounds = clean.fit_clip_bounds(labelled, clip_specs(roles), o.quantile_method)
        labelled = clean.apply_clip(labelled, bounds)
        test = clean.apply_clip(test, bounds) if test is not None else None

    rows = splits.add_holdout(labelled, roles.query, o.holdout_folds, fold_expr=o.holdout_expr, out="split")
    rows = rows.withColumn("_test", F.lit(0))
    if test is not None:
        shared = clean.align_types(test.select(*clean.common_columns(labelled, test)), labelled)
        tagged = shared.withColumns({"split": F.lit("test"), "_test": F.lit(1)})
        rows = rows.unionByName(tagged, allowMissingColumns=True)
    rows = splits.add_fold(rows, roles.query, o.encode_folds, fold_expr=o.encode_expr, out="_fold")
    rows = rows.withColumn("_variant", encode.variant("split", "_fold")).drop("_fold")
    rows = rows.withColumn("checkin_month", features.calendar_features(roles)["checkin_month"])

    train_row = F.col("split") == "train"
    test_row = F.col("split") == "test"
    salt = [roles.query, *roles.ties]
    raw = features.add_row_features(rows, roles)

    # --- target rates of items; position and rates of (market, item)
    # joined first, while the rows are narrow: these tables have nearly as many rows
    prior = encode.priors(rows.filter(train_row), encode.ITEM_TARGETS) if o.target_rates else {}
    pair = [roles.market, roles.item]
    cells = stored(_cells(rows, roles, prior if o.target_rates else None))
    shuffled = not is_small(cells)

    def settled(df: DataFrame) -> DataFrame:
        """Rows that a join has shuffled are stored before the next one does, so the disk holds one shuffle of them."""
        out = stored(df) if shuffled else df
        discard(held.pop() if held else None)
        held.extend([out] if shuffled else [])
        return out

    held: list[DataFrame] = []
    df = settled(attach(rows, cells, [*pair, "_variant"], "_size", salt, settle=False))
    medians = _position_medians(cells, rows)

    # --- items: profile and frequency over all rows, position over train / labelled rows
    places = [
        *stats.position_aggs(roles, ~test_row),
        *stats.position_aggs(roles, train_row, "__train"),
    ]
    items = stats.item_profile(raw, roles, approximate_median=o.approximate_median, more=places)
    items = items.withColumn(f"{roles.item}_freq", F.col("_rows"))
    items = materialise(items)
    by_split = ["prop_avg_position", "prop_best_position", "prop_position_std", "prop_nonrandom_appearances"]
    # the windows need one item column: it goes ahead alone, next to the rates; the others follow the windows
    early = [c for c in items.columns if c.removesuffix("__train") == by_split[0]]
    late = [c for c in items.columns if c not in early and c not in (roles.item, "_rows")]
    head = items.select(roles.item, *early, "_rows")
    if o.target_rates:
        rates = encode.variant_rates(rows, [roles.item], encode.ITEM_TARGETS, prior)
        rates = rates.join(head.drop("_rows"), roles.item, "left")  # every item has a row there
        df = attach(df, rates, [roles.item, "_variant"], "_size", salt)
    else:
        df = attach(df, head, [roles.item], "_rows", salt, settle=False)
    df = settled(_pick(df, by_split[:1]))

    # --- windows of the query
    keys = [roles.query, "_test"]
    ranks = {"prop_avg_position_pct_rank": "prop_avg_position"}
    df, hot = dealt(df, keys, source=rows)
    df = df.withColumns(features.price_features(roles))
    df = settled(features.add_query_windows(df, roles, keys, hot, ranks))

    # what a row has in itself does not travel to the items
    df = df.drop(*features.price_features(roles))
    df = attach(df, items.select(roles.item, *late, "_rows"), [roles.item], "_rows", salt, settle=False)
    df = _pick(df, by_split[1:]).withColumns(features.price_features(roles))
    others = [k for k in roles.frequency_keys if k not in (roles.item, roles.market) and k in rows.columns]
    df = stats.add_frequencies(df, rows, others, salt)

    # --- markets
    markets = rows.groupBy(roles.market).agg(
        *stats.market_aggs(roles, ~test_row),
        *stats.market_aggs(roles, train_row, "__train"),
        F.count(F.lit(1)).alias(f"{roles.market}_freq"),
    )
    df = attach(df, markets.withColumn("_size", F.col(f"{roles.market}_freq")), [roles.market], "_size", salt)
    months = rows.groupBy(roles.market, "checkin_month").agg(
        *stats.month_aggs(roles, ~test_row),
        *stats.month_aggs(roles, train_row, "__train"),
        F.count(F.lit(1)).alias("_size"),
    )
    df = attach(df, months, [roles.market, "checkin_month"], "_size", salt)
    df = _pick(df, [*stats.market_helper_columns(), "dest_search_count"])
    df = df.withColumns(stats.market_zscores(roles)).drop(*stats.market_helper_columns())

    df = df.join(F.broadcast(medians), "split", "left")  # one row per split
    unseen = F.coalesce(F.col("estimated_position"), F.col("_median"), F.lit(stats.UNSEEN_POSITION))
    filled = {"estimated_position": unseen}
    if o.target_rates:
        every = (*encode.ITEM_TARGETS, *encode.MARKET_ITEM_TARGETS)
        filled |= {t.out: F.coalesce(F.col(t.out), F.lit(prior[t.label])) for t in every}
    df = df.withColumns(filled).drop("_median", "_variant", "checkin_month")

    df = _finish(df, rows, roles, ["_test"], ranks)
    return df.withColumns(features.price_against_item(roles)).drop("_test")


def _cells(rows: DataFrame, roles: Roles, prior: dict[str, float] | None) -> DataFrame:
    """Per (market, item, variant): estimated position and, with a prior, smoothed rates.

    Position sums are taken once per variant; train rows (variant >= 0) or all labelled
    rows (>= -1) are added up over the at most folds + 2 rows of a pair.
    """
    pair = [roles.market, roles.item]
    shown = F.col(roles.random_flag) == 0
    targets = encode.MARKET_ITEM_TARGETS if prior is not None else ()
    sums = rows.groupBy(*pair, "_variant").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.when(shown, F.col(roles.position))).alias("_pos"),
        F.count(F.when(shown, F.col(roles.position))).alias("_shown"),
        *[F.coalesce(F.sum(F.col(t.label).cast("bigint")), F.lit(0)).alias(f"_sum_{t.label}") for t in targets],
    )
    over = Window.partitionBy(*pair)

    def visible(c: str) -> Column:
        part = {v: F.sum(F.when(F.col("_variant") >= v, F.col(c))).over(over) for v in (0, -1)}
        return F.when(F.col("_variant") == -2, part[-1]).otherwise(part[0])

    rates = [c for t in targets for c in [encode.seen_rate(t, over, prior)]]
    return sums.select(
        *pair,
        "_variant",
        F.col("_n").alias("_size"),
        F.try_divide(visible("_shown").cast("double"), visible("_pos")).alias("estimated_position"),
        *rates,
    )


def _pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the labelled-row value for test rows and the ``__train`` value for the others."""
    test_row = F.col("split") == "test"
    picked = {c: F.when(test_row, F.col(c)).otherwise(F.col(f"{c}__train")) for c in columns}
    return df.withColumns(picked).drop(*[f"{c}__train" for c in columns])


def _position_medians(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Median estimated position per split over its rows, from the (market, item) table."""
    split = F.when(F.col("_variant") >= 0, "train").when(F.col("_variant") == -1, "val").otherwise("test")
    large = rows.count() > hot_rows(rows.sparkSession)
    return stats.split_median(
        cells.withColumn("split", split), "estimated_position", "split", large=large, weight="_size"
    )


def write_feature_tables(table: DataFrame, path: str, roles: Roles = Roles()) -> None:
    """Parquet partitioned by split, so each split is a folder of its own, in one job."""
    tables.write_parquet(table, path, partition_by=["split"], sort_within=["split", roles.query])


def read_feature_table(spark, path: str, split: str) -> DataFrame:
    """One split (a partition filter: the other folders are not read)."""
    return spark.read.parquet(path).filter(F.col("split") == split)
