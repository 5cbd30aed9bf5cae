"""Row-level and in-query features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.columns import (
    clip,
    count_equal,
    dbl,
    first_match,
    flag,
    graded_relevance,
    iso_weekday,
    missing,
    plus_days,
    row_mean,
    zscore,
)
from rankloom.operators.skew import Groups, grouped
from rankloom.roles import Roles

SCORE_EPS = 1e-4  # fixed value: added to both location scores before dividing
PARTY_EPS = 1e-6  # fixed value: added to the number of guests before dividing


def price_features(roles: Roles = Roles()) -> dict[str, Column]:
    """log price and price per night. Chain order matters: see ``add_row_features``."""
    nights = clip(dbl(roles.stay), 1.0, None)
    per_night = dbl(roles.price) / nights
    return {
        "log_price_usd": F.log1p(dbl(roles.price)),
        "price_per_night": per_night,
        "log_price_per_night": F.log1p(per_night),
    }


def composite_features(roles: Roles = Roles()) -> dict[str, Column]:
    r = roles
    guests = dbl(r.adults) + dbl(r.children)
    return {
        "ump": F.exp(dbl(r.log_hist_price)) - dbl(r.price),
        "price_diff": dbl(r.hist_price) - dbl(r.price),
        "starrating_diff": dbl(r.hist_star) - dbl(r.star),
        "per_fee": dbl(r.price) * dbl(r.rooms) / (guests + F.lit(PARTY_EPS)),
        "total_fee": dbl(r.price) * dbl(r.rooms),
        "score1d2": F.try_divide(
            F.coalesce(dbl(r.loc2), F.lit(0.0)) + F.lit(SCORE_EPS),
            F.coalesce(dbl(r.loc1), F.lit(0.0)) + F.lit(SCORE_EPS),
        ),
        "score2ma": F.coalesce(dbl(r.loc2), F.lit(0.0)) * F.coalesce(dbl(r.affinity), F.lit(0.0)),
    }


def alignment_features(roles: Roles = Roles()) -> dict[str, Column]:
    r = roles
    return {
        "star_rating_alignment": F.abs(dbl(r.star) - dbl(r.hist_star)),
        "price_alignment": F.abs(dbl(r.price) - dbl(r.hist_price)),
    }


def competitor_features(roles: Roles = Roles()) -> dict[str, Column]:
    r = roles
    return {
        "num_comp_cheaper": count_equal(r.comp_rate, -1),
        "num_comp_more_expensive": count_equal(r.comp_rate, 1),
        "competitor_availability_pressure": count_equal(r.comp_inv, 1),
        "avg_comp_price_diff": row_mean(r.comp_diff),
    }


def party_features(roles: Roles = Roles()) -> dict[str, Column]:
    r = roles
    guests = F.col(r.adults).cast("int") + F.col(r.children).cast("int")
    return {
        "family_trip_flag": flag(F.col(r.children) > 0),
        "group_travel_size": guests,
        "guests_per_room": F.try_divide(guests.cast("double"), dbl(r.rooms)),
    }


def calendar_features(roles: Roles = Roles()) -> dict[str, Column]:
    t = F.col(roles.time)
    checkin = plus_days(t, roles.window)
    return {
        "search_month": F.month(t),
        "search_day_of_week": iso_weekday(t),
        "search_hour": F.hour(t),
        "checkin_datetime": checkin,
        "checkin_month": F.month(checkin),
        "checkin_day_of_week": iso_weekday(checkin),
    }


def missing_flags(roles: Roles = Roles()) -> dict[str, Column]:
    r = roles
    return {
        "visitor_history_star_missing": missing(r.hist_star),
        "visitor_history_price_missing": missing(r.hist_price),
        "missing_star_rating_flag": flag(F.col(r.star) == 0),
        "review_score_zero_flag": flag(F.col(r.review) == 0),
        "review_score_missing_flag": missing(r.review),
        "missing_historical_price_flag": flag(F.col(r.log_hist_price) == 0),
        "affinity_score_missing_flag": missing(r.affinity),
        "distance_missing_flag": missing(r.distance),
        "location_score2_missing_flag": missing(r.loc2),
    }


def label_features(df: DataFrame, roles: Roles = Roles()) -> dict[str, Column]:
    """``relevance`` where both labels exist, nothing otherwise."""
    if roles.click in df.columns and roles.book in df.columns:
        return {"relevance": graded_relevance(roles.click, roles.book)}
    return {}


def first_match_target(
    roles: Roles = Roles(), order: Sequence[tuple[str, int]] = (("click", 1), ("book", 2)), default: int = 0
) -> Column:
    """Older three-grade label: first rule that holds wins.

    In the default order a booking that is also a click gets 1; pass
    ``(("book", 2), ("click", 1))`` to let bookings win.
    """
    return first_match([(F.col(getattr(roles, part)) == 1, value) for part, value in order], default)


def date_parts(time: str = "date_time", parts: Sequence[str] = ("month", "hour", "dayofweek")) -> dict[str, Column]:
    """Older calendar features; ``dayofweek`` has Monday = 0."""
    known = {"month": F.month, "hour": F.hour, "dayofweek": F.weekday}
    return {p: known[p](F.col(time)) for p in parts}


def interactions(pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """Products of two columns, ``{a}_x_{b}``: price x quality terms for linear models."""
    return {f"{a}_x_{b}": dbl(a) * dbl(b) for a, b in pairs}


def largest_window(df: DataFrame, roles: Roles = Roles(), by: Sequence[str] = ()) -> Column | DataFrame:
    """Largest booking window of the table, or one row per value of ``by``."""
    if by:
        return df.groupBy(*by).agg(F.max(roles.window).alias("_max_window"))
    return df.agg(F.max(roles.window)).scalar()


def count_window(
    df: DataFrame,
    roles: Roles = Roles(),
    by: Sequence[str] = (),
    largest: Column | DataFrame | None = None,
    out: str = "count_window",
) -> DataFrame:
    """rooms * (largest booking window of the table) + booking window.

    ``by`` takes the maximum within each value of those columns (a handful, such as
    the train / test tag) instead of the whole table.
    """
    if largest is None:
        largest = largest_window(df, roles, by)
    if by:
        df, top = df.join(F.broadcast(largest), list(by), "left"), F.col("_max_window")
    else:
        top = largest
    value = dbl(roles.rooms) * top.cast("double") + dbl(roles.window)
    return df.withColumn(out, value).drop("_max_window")


def row_features(df: DataFrame, roles: Roles = Roles()) -> dict[str, Column]:
    """All features that need nothing but their own row."""
    return (
        price_features(roles)
        | composite_features(roles)
        | alignment_features(roles)
        | competitor_features(roles)
        | party_features(roles)
        | calendar_features(roles)
        | missing_flags(roles)
        | label_features(df, roles)
    )


def add_row_features(df: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Add all row features that are not there yet."""
    return df.withColumns({n: c for n, c in row_features(df, roles).items() if n not in df.columns})


# --- within the query ----------------------------------------------------------


def query_aggregates(roles: Roles = Roles()) -> dict[str, Column]:
    r = roles
    return {
        "query_price_mean": F.avg(r.price),
        "query_price_std": F.stddev_samp(r.price),
        "query_price_min": F.min(r.price),
        "query_price_max": F.max(r.price),
        "query_log_price_mean": F.avg("log_price_usd"),
        "query_log_price_std": F.stddev_samp("log_price_usd"),
        "query_ppn_mean": F.avg("price_per_night"),
        "query_ppn_std": F.stddev_samp("price_per_night"),
        "query_ppn_min": F.min("price_per_night"),
        "query_star_mean": F.avg(r.star),
        "query_review_mean": F.avg(r.review),
        "query_review_min": F.min(r.review),
        "query_review_max": F.max(r.review),
        "query_location_mean1": F.avg(r.loc1),
        "query_location_max1": F.max(r.loc1),
        "query_location_mean2": F.avg(r.loc2),
        "query_hotel_count": F.count(F.lit(1)),
    }


def query_relative_features(roles: Roles = Roles()) -> dict[str, Column]:
    """Row against its query; needs the columns of ``query_aggregates``."""
    r = roles
    price, logp, ppn = dbl(r.price), F.col("log_price_usd"), F.col("price_per_night")
    return {
        "price_diff_from_query_mean": price - F.col("query_price_mean"),
        "price_zscore": zscore(price, F.col("query_price_mean"), F.col("query_price_std")),
        "log_price_diff_from_mean": logp - F.col("query_log_price_mean"),
        "log_price_zscore": zscore(logp, F.col("query_log_price_mean"), F.col("query_log_price_std")),
        "ppn_diff_from_query_mean": ppn - F.col("query_ppn_mean"),
        "ppn_zscore": zscore(ppn, F.col("query_ppn_mean"), F.col("query_ppn_std")),
        "cheapest_ppn_flag": flag(ppn == F.col("query_ppn_min")),
        "cheapest_hotel_flag": flag(F.col(r.price) == F.col("query_price_min")),
        "star_diff_from_mean": dbl(r.star) - F.col("query_star_mean"),
        "review_diff_from_mean": dbl(r.review) - F.col("query_review_mean"),
        "location_diff_from_mean1": dbl(r.loc1) - F.col("query_location_mean1"),
        "location_diff_from_mean2": dbl(r.loc2) - F.col("query_location_mean2"),
    }


def rank_columns(roles: Roles = Roles()) -> dict[str, str]:
    """{percentile-rank name: ranked column}."""
    r = roles
    return {
        "ppn_pct_rank": "price_per_night",
        "price_pct_rank": r.price,
        "star_pct_rank": r.star,
        "review_pct_rank": r.review,
        "location_pct_rank1": r.loc1,
        "location_pct_rank2": r.loc2,
    }


def ascending(column: str, ties: Sequence[str]) -> list[Column]:
    return [F.col(column).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]


def descending(column: str, ties: Sequence[str]) -> list[Column]:
    return [F.col(column).desc_nulls_last(), *[F.col(t).asc_nulls_last() for t in ties]]


def add_ordinal_ranks(
    df: DataFrame,
    columns: dict[str, str],
    keys: Sequence[str],
    ties: Sequence[str],
    hot: DataFrame | None | str = "detect",
) -> DataFrame:
    """Ascending 1-based rank in the group, {output: column}; a NULL value has a NULL rank.

    ``ties`` must tell the rows of a group apart (there is no row order to fall back on).
    """

    def build(part: DataFrame, groups: Groups) -> DataFrame:
        part = groups.ordinal(part, **{o: ascending(c, ties) for o, c in columns.items()})
        return part.withColumns({o: F.when(F.col(c).isNotNull(), F.col(o)) for o, c in columns.items()})

    return grouped(df, keys, build, hot)


def add_percentile_ranks(
    df: DataFrame,
    columns: dict[str, str],
    keys: Sequence[str],
    ties: Sequence[str],
    hot: DataFrame | None | str = "detect",
    size: str | None = None,
) -> DataFrame:
    """Ordinal rank divided by the number of rows of the group (NULL values included).

    ``size`` names an existing column with that number.
    """

    def build(part: DataFrame, groups: Groups) -> DataFrame:
        n = size
        if n is None:
            part, n = groups.attach(part, _n=F.count(F.lit(1))), "_n"
        part = groups.ordinal(part, **{o: ascending(c, ties) for o, c in columns.items()})
        part = part.withColumns(
            {o: F.when(F.col(c).isNotNull(), F.col(o) / F.col(n)) for o, c in columns.items()}
        )
        return part.drop("_n") if size is None else part

    return grouped(df, keys, build, hot)


def add_group_minimum_flag(
    df: DataFrame, column: str, keys: Sequence[str], out: str, hot: DataFrame | None | str = "detect"
) -> DataFrame:
    """1 where the value is the smallest of its group (all tied minima), NULL where it is missing."""

    def build(part: DataFrame, groups: Groups) -> DataFrame:
        part = groups.attach(part, _min=F.min(column))
        return part.withColumn(out, flag(F.col(column) == F.col("_min"))).drop("_min")

    return grouped(df, keys, build, hot)


def add_query_windows(
    df: DataFrame,
    roles: Roles = Roles(),
    keys: Sequence[str] | None = None,
    hot: DataFrame | None | str = "detect",
    more_ranks: dict[str, str] | None = None,
) -> DataFrame:
    """Query statistics and ordinal ranks: all windows of the query key, one shuffle.

    The ranks are still positions here; ``finish_query_features`` divides them.
    ``more_ranks`` ({output: column}) ranks further columns.
    """
    ranks = rank_columns(roles) | (more_ranks or {})

    def build(part: DataFrame, groups: Groups) -> DataFrame:
        part = groups.attach(part, **query_aggregates(roles))
        return groups.ordinal(part, **{o: ascending(c, roles.ties) for o, c in ranks.items()})

    return grouped(df, list(keys or [roles.query]), build, hot)


def finish_query_features(
    df: DataFrame, roles: Roles = Roles(), more_ranks: dict[str, str] | None = None
) -> DataFrame:
    """Deviations, z-scores, percentile ranks and flags from the columns of ``add_query_windows``."""
    ranks = rank_columns(roles) | (more_ranks or {})
    shares = {o: F.when(F.col(c).isNotNull(), F.col(o) / F.col("query_hotel_count")) for o, c in ranks.items()}
    promo = dbl(roles.promo) * (dbl(roles.price) - F.col("query_price_mean"))
    return df.withColumns(query_relative_features(roles) | shares | {"promotion_price_interaction": promo})


def price_against_item(roles: Roles = Roles()) -> dict[str, Column]:
    """Price against the item's own profile (``stats.item_profile`` joined to the row)."""
    mean, std = F.col(f"prop_{roles.price}_mean"), F.col(f"prop_{roles.price}_std")
    return {
        "price_vs_prop_mean": dbl(roles.price) - mean,
        "price_vs_prop_zscore": zscore(dbl(roles.price), mean, std),
    }
