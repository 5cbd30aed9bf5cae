"""Per-group statistics: item profiles, positions, markets, frequencies, generic forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.columns import zscore
from rankloom.operators.quantile import hot_medians, weighted_quantiles
from rankloom.operators.skew import Groups, attach, dealt, grouped, hot_rows, materialise, sent_if_small, split_hot, stored
from rankloom.roles import Roles

# Columns an item profile summarises.
PROFILE_COLUMNS = (
    "price_usd",
    "price_per_night",
    "log_price_usd",
    "prop_location_score1",
    "prop_location_score2",
    "prop_review_score",
    "srch_query_affinity_score",
    "orig_destination_distance",
    "ump",
    "per_fee",
    "total_fee",
    "score2ma",
)

UNSEEN_POSITION = 0.05  # fixed value: estimated position when a split has none at all


def _only(keep: Column | None, c: Column) -> Column:
    return c if keep is None else F.when(keep, c)


def _rows(keep: Column | None) -> Column:
    """Rows that count; NULL instead of 0, as for a key that has no row at all."""
    return F.nullif(F.count(_only(keep, F.lit(1))), F.lit(0))


def item_profile(
    df: DataFrame,
    roles: Roles = Roles(),
    columns: Sequence[str] = PROFILE_COLUMNS,
    approximate_median: bool = False,
    hot: DataFrame | None | str = "detect",
    more: Sequence[Column] = (),
) -> DataFrame:
    """Mean, sample deviation and median of each column per item, plus the row count.

    Columns ``prop_{c}_mean|std|median`` and ``_rows``. ``approximate_median`` trades
    exactness for one mergeable sketch per item. ``more`` aggregates share the pass. Rows with known hot
    keys (``hot``) are read several times and should be ``stored``.
    """
    p = roles.item
    columns = [c for c in columns if c in df.columns]
    aggs = [F.count(F.lit(1)).alias("_rows"), *more]
    for c in columns:
        aggs += [F.avg(c).alias(f"prop_{c}_mean"), F.stddev_samp(c).alias(f"prop_{c}_std")]
    names = {c: f"prop_{c}_median" for c in columns}
    if approximate_median:
        return df.groupBy(p).agg(*aggs, *[F.percentile_approx(c, 0.5).alias(o) for c, o in names.items()])
    # the rows of an item meet before they are summed up: partial sums of all columns are wider than rows
    if isinstance(hot, str):
        df, hot = dealt(df, [p])
        df = df if hot is None else stored(df)
    elif hot is None:
        df, _ = dealt(df, [p], None)
    medians = [F.median(c).alias(o) for c, o in names.items()]
    if hot is None:
        return df.groupBy(p).agg(*aggs, *medians)
    cold_rows, hot_part = split_hot(df, [p], hot)
    cold_rows, _ = dealt(cold_rows, [p], None)
    moments = hot_part.groupBy(p).agg(*aggs)
    medians_of_hot = hot_medians(hot_part, [p], names, hot).withColumnRenamed(p, "_median_" + p)
    joined = moments.join(medians_of_hot, moments[p].eqNullSafe(medians_of_hot["_median_" + p]), "left")
    return cold_rows.groupBy(p).agg(*aggs, *medians).unionByName(joined.drop("_median_" + p))


def position_aggs(roles: Roles = Roles(), keep: Column | None = None, suffix: str = "") -> list[Column]:
    """Position statistics over rows that were not shown in random order (and pass ``keep``)."""
    shown = F.col(roles.random_flag) == 0
    keep = shown if keep is None else shown & keep
    pos = F.when(keep, F.col(roles.position))
    return [
        F.avg(pos).alias("prop_avg_position" + suffix),
        F.min(pos).alias("prop_best_position" + suffix),
        F.stddev_samp(pos).alias("prop_position_std" + suffix),
        _rows(keep).alias("prop_nonrandom_appearances" + suffix),
    ]


def position_profile(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Logged position per item over rows that were not shown in random order."""
    return df.filter(F.col(roles.random_flag) == 0).groupBy(roles.item).agg(*position_aggs(roles))


def estimated_position(df: DataFrame, roles: Roles = Roles(), exclude_random: bool = True) -> DataFrame:
    """1 / mean logged position per (market, item)."""
    if exclude_random:
        df = df.filter(F.col(roles.random_flag) == 0)
    return df.groupBy(roles.market, roles.item).agg(
        F.try_divide(F.lit(1.0), F.avg(roles.position)).alias("estimated_position")
    )


def split_median(
    df: DataFrame, column: str, split: str | None = None, large: bool | None = None, weight: str | None = None
) -> DataFrame:
    """Exact median of a column per split, over value counts. ``weight`` counts a row w times."""
    if large is None:
        large = df.count() > hot_rows(df.sparkSession)
    key = split or "_all"
    values = (
        (df if split else df.withColumn("_all", F.lit(0)))
        .filter(F.col(column).isNotNull())
        .groupBy(key, column)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c"))
    )
    got = weighted_quantiles(values, [key], column, "_c", [0.5], "linear", few_large_groups=large)
    got = got.select(key, F.element_at("quantiles", 1).alias("_median"))
    return got if split else got.drop("_all")


def fill_with_median(
    df: DataFrame, column: str = "estimated_position", split: str | None = None, default: float = UNSEEN_POSITION
) -> DataFrame:
    """Replace NULLs by the median of the row's own split, or ``default`` when there is none."""
    medians = F.broadcast(split_median(df, column, split))  # one row per split
    joined = df.join(medians, split, "left") if split else df.join(medians, how="left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.col("_median"), F.lit(default))).drop("_median")


# --- markets -----------------------------------------------------------------

# Short name in the output -> role that holds the column.
MARKET_COLUMNS = {"price": "price", "star": "star", "loc1": "loc1", "loc2": "loc2", "review": "review"}


def market_aggs(roles: Roles = Roles(), keep: Column | None = None, suffix: str = "") -> list[Column]:
    """Mean and deviation of price, star, locations and review, and the rows that count."""
    aggs = []
    for short, role in MARKET_COLUMNS.items():
        c = _only(keep, F.col(getattr(roles, role)))
        aggs += [
            F.avg(c).alias(f"dest_{short}_mean{suffix}"),
            F.stddev_samp(c).alias(f"dest_{short}_std{suffix}"),
        ]
    return [*aggs, _rows(keep).alias(f"dest_search_count{suffix}")]


def month_aggs(roles: Roles = Roles(), keep: Column | None = None, suffix: str = "") -> list[Column]:
    price = _only(keep, F.col(roles.price))
    return [
        F.avg(price).alias(f"dest_month_price_mean{suffix}"),
        F.stddev_samp(price).alias(f"dest_month_price_std{suffix}"),
    ]


def market_stats(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Statistics per market."""
    return df.groupBy(roles.market).agg(*market_aggs(roles))


def market_month_stats(df: DataFrame, roles: Roles = Roles(), month: str = "checkin_month") -> DataFrame:
    """Mean and deviation of price per market and check-in month."""
    return df.groupBy(roles.market, month).agg(*month_aggs(roles))


def market_zscores(roles: Roles = Roles()) -> dict[str, Column]:
    """z-scores against the market columns already joined to the row."""

    def z(role: str, short: str, fill: bool = False) -> Column:
        mean, std = F.col(f"dest_{short}_mean"), F.col(f"dest_{short}_std")
        x = F.col(getattr(roles, role))
        return zscore(F.coalesce(x, mean) if fill else x, mean, std)

    return {
        "price_zscore_dest": z("price", "price"),
        "star_zscore_dest": z("star", "star"),
        "loc1_zscore_dest": z("loc1", "loc1"),
        "loc2_zscore_dest": z("loc2", "loc2", fill=True),
        "review_zscore_dest": z("review", "review", fill=True),
        "price_zscore_dest_month": zscore(
            F.col(roles.price), F.col("dest_month_price_mean"), F.col("dest_month_price_std")
        ),
    }


def market_helper_columns() -> list[str]:
    names = [f"dest_{s}_{f}" for s in MARKET_COLUMNS for f in ("mean", "std")]
    return [*names, "dest_month_price_mean", "dest_month_price_std"]


def apply_market_stats(
    df: DataFrame,
    markets: DataFrame,
    months: DataFrame,
    roles: Roles = Roles(),
    month: str = "checkin_month",
    salt_by: Sequence[str] | None = None,
) -> DataFrame:
    """Join market and market x month statistics, add z-scores, keep only ``dest_search_count``."""
    joined = attach(df, markets, [roles.market], salt_by=salt_by)
    joined = attach(joined, months, [roles.market, month], salt_by=salt_by)
    return joined.withColumns(market_zscores(roles)).drop(*market_helper_columns())


# --- frequencies and totals ----------------------------------------------------


def frequency_table(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(f"{key}_freq"))


def add_frequencies(
    df: DataFrame, source: DataFrame, keys: Sequence[str], salt_by: Sequence[str] | None = None
) -> DataFrame:
    """Row count in ``source`` of each row's value, one column ``{key}_freq`` per key.

    ``source`` is read once for each key and so is stored first: whole if it is ``df``, else its keys alone.
    """
    if source is df:
        df = source = stored(df)
    else:
        source = stored(source.select(*dict.fromkeys(keys)))
    for key in keys:
        table = frequency_table(source, key).withColumn("_size", F.col(f"{key}_freq"))
        df = attach(df, table, [key], "_size", salt_by)
    return df


def group_sizes(df: DataFrame, key: str, out: str = "rows") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(out)).orderBy(key)


def global_rates(df: DataFrame, **columns: str) -> DataFrame:
    """One row with the mean of each column ({output name: column})."""
    return df.agg(*[F.avg(c).alias(o) for o, c in columns.items()])


def distinct_count(df: DataFrame, *columns: str, approximate: bool = False) -> DataFrame:
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns])
    return df.agg(*[F.count_distinct(F.col(c)).alias(f"n_{c}") for c in columns])


# --- generic group features -------------------------------------------------------


def normalise(
    df: DataFrame,
    keys: str | Sequence[str],
    column: str,
    take_log10: bool = False,
    hot: DataFrame | None | str = "detect",
    joined: bool = False,
) -> DataFrame:
    """(x - group mean) / group deviation as ``{column}_norm_by_{keys}``.

    No epsilon: a group without spread gives NULL. With ``take_log10`` the column
    itself is first replaced by log10(x + 1e-4). Rows without a key are dropped. ``joined``: the
    groups' statistics are joined to the rows, which are not dealt by key and should be ``stored``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if take_log10:
        df = df.withColumn(column, F.log10(F.col(column) + F.lit(1e-4)))
    df = df.dropna(subset=keys)
    name = f"{column}_norm_by_{'_'.join(keys)}"

    def build(part: DataFrame, groups: Groups) -> DataFrame:
        part = groups.attach(part, _mean=F.avg(column), _std=F.stddev_samp(column))
        return part.withColumn(name, F.try_divide(F.col(column) - F.col("_mean"), F.col("_std"))).drop(
            "_mean", "_std"
        )

    return build(df, Groups(keys, spread=True)) if joined else grouped(df, keys, build, hot)


_AGGREGATES = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}


def group_transform(
    df: DataFrame,
    keys: str | Sequence[str],
    column: str,
    methods: Sequence[str] = ("mean", "median", "min", "max"),
    transforms: dict[str, Sequence[str]] | None = None,
    hot: DataFrame | None | str = "detect",
    joined: bool = False,
) -> DataFrame:
    """Attach group aggregates of a column and row-versus-group transforms.

    Aggregates are named ``{column}_{method}_by_{keys}``; transforms ``subtract`` and
    ``divide`` are named ``{column}_{transform}_{method}_by_{keys}``, so the same column
    compared within two keys gives two columns. Rows without a key are dropped. ``joined`` as in
    ``normalise``, not for medians.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    transforms = {"mean": ["subtract"]} if transforms is None else transforms
    by = "_".join(keys)
    df = df.dropna(subset=keys)
    if isinstance(hot, str) and not joined:
        df, hot = dealt(df, keys)
        df = df if hot is None else stored(df)
    names = {m: f"{column}_{m}_by_{by}" for m in methods}
    simple = {names[m]: _AGGREGATES[m](column) for m in methods if m != "median"}

    def build(part: DataFrame, groups: Groups) -> DataFrame:
        if "median" in methods and not groups.spread:
            return groups.attach(part, **simple, **{names["median"]: F.median(column)})
        if "median" in methods:
            # one median per hot key; sent where that is little
            medians = sent_if_small(materialise(hot_medians(part, keys, {column: names["median"]}, hot)))
            part = part.join(medians, keys, "left")
        return groups.attach(part, **simple) if simple else part

    df = build(df, Groups(keys, spread=True)) if joined else grouped(df, keys, build, hot)
    out = {}
    for m, applied in transforms.items():
        for t in applied:
            x, g = F.col(column), F.col(names[m])
            if t == "subtract":
                out[f"{column}_subtract_{m}_by_{by}"] = x - g
            elif t == "divide":
                out[f"{column}_divide_{m}_by_{by}"] = F.try_divide(x, g)
            else:
                raise ValueError(f"unknown transform {t!r}")
    return df.withColumns(out)


