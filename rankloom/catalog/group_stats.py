"""Per-group statistics, joins, unions, sorts, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.impressions import (
    KEYS,
    ROLES,
    TIES,
    impressions,
    ordinal,
    r,
    row_features_sql,
    rs,
    with_impressions,
)
from rankloom.catalog.registry import register
from rankloom.operators import features, splits, stats
from rankloom.operators.skew import attach, dealt, stored

KEY_SQL = ", ".join(KEYS)
RF = row_features_sql("imp")

# --- item profile -----------------------------------------------------------------

PROFILE_SQL = ", ".join(
    r(f"{fn}({c})", f"prop_{c}_{s}")
    for c in stats.PROFILE_COLUMNS
    for s, fn in (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"))
)


@register("g2_item_profile", with_impressions(f"select prop_id, {PROFILE_SQL} from rf group by 1", rf=RF))
def g2(spark, sf):
    """Mean, deviation and median of 12 columns per item."""
    return stats.item_profile(features.add_row_features(impressions(spark, sf), ROLES), ROLES).drop("_rows")


# A third of all rows belong to one item: exact medians must not depend on one task.
# What the profile's columns are made of.
_PROFILED = (
    "price_usd", "srch_length_of_stay", "srch_room_count", "srch_adults_count", "srch_children_count", "prop_starrating",
    "prop_review_score", "prop_location_score1", "prop_location_score2", "prop_log_historical_price", "visitor_hist_adr_usd",
    "visitor_hist_starrating", "srch_query_affinity_score", "orig_destination_distance",
)
_HOT_ITEM = "case when srch_id % 3 = 0 then 0 else prop_id end"


@register(
    "g2_item_profile_with_hot_item",
    with_impressions(
        f"select pid as prop_id, {PROFILE_SQL} from hot group by 1", rf=RF, hot=f"select *, {_HOT_ITEM} as pid from rf"
    ),
)
def g2_hot(spark, sf):
    from rankloom.operators.skew import hot_keys

    df = impressions(spark, sf).withColumn("prop_id", F.expr(_HOT_ITEM))
    df = stored(df.select("prop_id", *_PROFILED)).withColumns(features.price_features(ROLES) | features.composite_features(ROLES))
    return stats.item_profile(df, ROLES, hot=hot_keys(df, ["prop_id"], limit=1000)).drop("_rows")


@register(
    "g3_position_profile",
    with_impressions(
        f"""select prop_id, {r('avg(position)', 'prop_avg_position')}, min(position) as prop_best_position,
        {r('stddev_samp(position)', 'prop_position_std')}, count(*) as prop_nonrandom_appearances
        from imp where random_bool = 0 group by 1"""
    ),
)
def g3(spark, sf):
    return stats.position_profile(impressions(spark, sf), ROLES)


def _estimated(where: str) -> str:
    return f"select srch_destination_id, prop_id, 1.0e0 / avg(position) as estimated_position from imp {where} group by 1, 2"


@register(
    "g4_estimated_position",
    with_impressions(f"select srch_destination_id, prop_id, {rs('estimated_position')} from e", e=_estimated("where random_bool = 0")),
)
def g4(spark, sf):
    return stats.estimated_position(impressions(spark, sf), ROLES)


@register(
    "g5_estimated_position_all_rows",
    with_impressions(f"select srch_destination_id, prop_id, {rs('estimated_position')} from e", e=_estimated("")),
)
def g5(spark, sf):
    return stats.estimated_position(impressions(spark, sf), ROLES, exclude_random=False)


@register(
    "g6_fill_with_split_median",
    with_impressions(
        f"select {KEY_SQL}, split, {r('coalesce(estimated_position, m, 0.05e0)', 'estimated_position')} from j left join med using (split)",
        e=_estimated("where random_bool = 0 and split = 'train'"),
        j="select imp.*, e.estimated_position from imp left join e using (srch_destination_id, prop_id)",
        med="select split, median(estimated_position) as m from j group by 1",
    ),
)
def g6(spark, sf):
    """Positions learnt on the train split; unseen pairs get the median of their own split."""
    df = impressions(spark, sf).select(*KEYS, "srch_destination_id", "split", "random_bool")
    learnt = stats.estimated_position(df.filter("split = 'train'"), ROLES)
    joined = attach(df, learnt, ["srch_destination_id", "prop_id"])
    return stats.fill_with_median(joined, "estimated_position", "split").select(*KEYS, "split", "estimated_position")


MARKETS_SQL = (
    "select srch_destination_id, "
    + ", ".join(
        f"avg({c}) as dest_{s}_mean, stddev_samp({c}) as dest_{s}_std"
        for s, c in (
            ("price", "price_usd"),
            ("star", "prop_starrating"),
            ("loc1", "prop_location_score1"),
            ("loc2", "prop_location_score2"),
            ("review", "prop_review_score"),
        )
    )
    + ", count(*) as dest_search_count from rf group by 1"
)
MONTHS_SQL = (
    "select srch_destination_id, checkin_month, avg(price_usd) as dest_month_price_mean, "
    "stddev_samp(price_usd) as dest_month_price_std from rf group by 1, 2"
)
MARKET_Z = {
    "price_zscore_dest": "(price_usd - dest_price_mean) / (dest_price_std + 1e-6)",
    "star_zscore_dest": "(prop_starrating - dest_star_mean) / (dest_star_std + 1e-6)",
    "loc1_zscore_dest": "(prop_location_score1 - dest_loc1_mean) / (dest_loc1_std + 1e-6)",
    "loc2_zscore_dest": "(coalesce(prop_location_score2, dest_loc2_mean) - dest_loc2_mean) / (dest_loc2_std + 1e-6)",
    "review_zscore_dest": "(coalesce(prop_review_score, dest_review_mean) - dest_review_mean) / (dest_review_std + 1e-6)",
    "price_zscore_dest_month": "(price_usd - dest_month_price_mean) / (dest_month_price_std + 1e-6)",
}


@register(
    "g7_market_stats",
    with_impressions(
        f"select srch_destination_id, {rs(*[c for c in stats.market_helper_columns() if 'month' not in c])}, dest_search_count from m",
        rf=RF,
        m=MARKETS_SQL,
    ),
)
def g7(spark, sf):
    return stats.market_stats(impressions(spark, sf), ROLES)


@register(
    "g8_market_month_stats",
    with_impressions(
        f"select srch_destination_id, checkin_month, {rs('dest_month_price_mean', 'dest_month_price_std')} from m", rf=RF, m=MONTHS_SQL
    ),
)
def g8(spark, sf):
    df = impressions(spark, sf)
    month = features.calendar_features(ROLES)["checkin_month"]
    return stats.market_month_stats(df.withColumn("checkin_month", month), ROLES)


@register(
    "g9_r5_r7_market_zscores",
    with_impressions(
        f"select {KEY_SQL}, dest_search_count, {', '.join(r(e, n) for n, e in MARKET_Z.items())} from rf "
        "left join m using (srch_destination_id) left join mm using (srch_destination_id, checkin_month)",
        rf=RF,
        m=MARKETS_SQL,
        mm=MONTHS_SQL,
    ),
)
def g9(spark, sf):
    df = impressions(spark, sf)
    df = df.withColumn("checkin_month", features.calendar_features(ROLES)["checkin_month"])
    columns = [*KEYS, "srch_destination_id", "checkin_month", ROLES.price, ROLES.star, ROLES.review, ROLES.loc1, ROLES.loc2]
    out = stats.apply_market_stats(
        df.select(*columns), stats.market_stats(df, ROLES), stats.market_month_stats(df, ROLES), ROLES
    )
    return out.select(*KEYS, "dest_search_count", *MARKET_Z)


_FREQ = ROLES.frequency_keys


@register(
    "g10_frequencies",
    with_impressions(
        f"select {KEY_SQL}, {', '.join(f'count(*) over (partition by {c}) as {c}_freq' for c in _FREQ)} from imp"
    ),
)
def g10(spark, sf):
    df = impressions(spark, sf).select(*dict.fromkeys([*KEYS, *_FREQ]))
    return stats.add_frequencies(df, df, _FREQ).select(*KEYS, *[f"{c}_freq" for c in _FREQ])


@register(
    "g11_normalise",
    with_impressions(
        f"""select {KEY_SQL}, {r('x', 'price_usd')},
        {r('(x - avg(x) over q) / nullif(stddev_samp(x) over q, 0)', 'price_usd_norm_by_srch_id')},
        {r('(prop_location_score2 - avg(prop_location_score2) over q) / nullif(stddev_samp(prop_location_score2) over q, 0)', 'prop_location_score2_norm_by_srch_id')},
        {r('(x - avg(x) over p) / nullif(stddev_samp(x) over p, 0)', 'price_usd_norm_by_prop_id')}
        from (select *, log10(price_usd + 1e-4) as x from imp)
        window q as (partition by srch_id), p as (partition by prop_id)"""
    ),
)
def g11(spark, sf):
    """Log price within query and item, location score within query."""
    df = impressions(spark, sf).select(*KEYS, "price_usd", "prop_location_score2")
    df = stats.normalise(df, "srch_id", "price_usd", take_log10=True)
    df = stats.normalise(df, "srch_id", "prop_location_score2")
    return stats.normalise(df, "prop_id", "price_usd").drop("prop_location_score2")


@register(
    "g12_group_transform",
    with_impressions(
        f"""select {KEY_SQL},
        {r('avg(price_usd) over m', 'price_usd_mean_by_srch_destination_id')}, {r('median(price_usd) over m', 'price_usd_median_by_srch_destination_id')},
        {r('min(price_usd) over m', 'price_usd_min_by_srch_destination_id')}, {r('max(price_usd) over m', 'price_usd_max_by_srch_destination_id')},
        {r('price_usd - avg(price_usd) over m', 'price_usd_subtract_mean_by_srch_destination_id')},
        {r('price_usd / nullif(median(price_usd) over m, 0)', 'price_usd_divide_median_by_srch_destination_id')},
        {r('avg(prop_review_score) over q', 'prop_review_score_mean_by_srch_id_promotion_flag')},
        {r('prop_review_score - avg(prop_review_score) over q', 'prop_review_score_subtract_mean_by_srch_id_promotion_flag')}
        from imp window m as (partition by srch_destination_id), q as (partition by srch_id, promotion_flag)"""
    ),
)
def g12(spark, sf):
    """Aggregates and transforms by one key and by a pair of keys."""
    df = impressions(spark, sf).select(*KEYS, "srch_destination_id", "promotion_flag", "price_usd", "prop_review_score")
    df = stats.group_transform(
        df, "srch_destination_id", "price_usd", transforms={"mean": ["subtract"], "median": ["divide"]}
    )
    df = stats.group_transform(df, ["srch_id", "promotion_flag"], "prop_review_score", ["mean"])
    return df.drop("srch_destination_id", "promotion_flag", "price_usd", "prop_review_score")


@register(
    "g12_group_transform_with_hot_market",
    with_impressions(
        f"""select {KEY_SQL}, mkt, {r('avg(price_usd) over m', 'price_usd_mean_by_mkt')}, {r('median(price_usd) over m', 'price_usd_median_by_mkt')},
        {r('price_usd - median(price_usd) over m', 'price_usd_subtract_median_by_mkt')}
        from (select *, case when srch_id % 3 = 0 then 0 else srch_destination_id end as mkt from imp)
        window m as (partition by mkt)"""
    ),
)
def g12_hot(spark, sf):
    from rankloom.operators.skew import hot_keys

    df = impressions(spark, sf).select(
        *KEYS, "price_usd", F.expr("case when srch_id % 3 = 0 then 0 else srch_destination_id end").alias("mkt")
    )
    df = stored(df)
    hot = hot_keys(df, ["mkt"], limit=5000)
    return stats.group_transform(
        df, "mkt", "price_usd", ["mean", "median"], {"median": ["subtract"]}, hot=hot
    ).drop("price_usd")


@register("g13_group_sizes", with_impressions("select srch_id, count(*) as rows from imp group by 1"))
def g13(spark, sf):
    return stats.group_sizes(impressions(spark, sf), "srch_id")


@register(
    "g14_global_rates",
    with_impressions(f"select {r('avg(booking_bool)', 'booking_rate')}, {r('avg(click_bool)', 'ctr')} from imp"),
)
def g14(spark, sf):
    return stats.global_rates(impressions(spark, sf), booking_rate="booking_bool", ctr="click_bool")


@register(
    "g15_distinct_counts",
    with_impressions("select count(distinct srch_id) as n_srch_id, count(distinct prop_id) as n_prop_id from imp"),
)
def g15(spark, sf):
    return stats.distinct_count(impressions(spark, sf), "srch_id", "prop_id")


@register(
    "r4_price_against_item",
    with_impressions(
        f"""select {KEY_SQL}, {r('price_usd - avg(price_usd) over p', 'price_vs_prop_mean')},
        {r('(price_usd - avg(price_usd) over p) / (stddev_samp(price_usd) over p + 1e-6)', 'price_vs_prop_zscore')}
        from imp window p as (partition by prop_id)"""
    ),
)
def r4(spark, sf):
    df = impressions(spark, sf).select(*KEYS, "price_usd")
    profile = stats.item_profile(df, ROLES, ["price_usd"])
    joined = attach(df, profile, ["prop_id"], "_rows", KEYS)
    return joined.select(*KEYS, *[c.alias(n) for n, c in features.price_against_item(ROLES).items()])


@register(
    "w3_position_percentile_rank",
    with_impressions(
        f"select {KEY_SQL}, {r(f'({ordinal('prop_avg_position')}) / count(*) over (partition by srch_id)', 'prop_avg_position_pct_rank')} from j",
        g="select prop_id, avg(position) as prop_avg_position from imp where random_bool = 0 group by 1",
        j="select imp.*, g.prop_avg_position from imp left join g using (prop_id)",
    ),
)
def w3(spark, sf):
    df = stored(impressions(spark, sf).select(*dict.fromkeys([*KEYS, *TIES, "random_bool"])))
    positions = stats.position_profile(df, ROLES).select("prop_id", "prop_avg_position")
    joined, hot = dealt(attach(df, positions, ["prop_id"]), ["srch_id"], source=df)
    out = features.add_percentile_ranks(
        joined, {"prop_avg_position_pct_rank": "prop_avg_position"}, ["srch_id"], TIES, hot
    )
    return out.select(*KEYS, "prop_avg_position_pct_rank")


# --- joins, filters, unions, sorts ------------------------------------------------------


@register(
    "j1_left_join_one_key",
    with_impressions(
        f"select {KEY_SQL}, {r('m', 'price_mean')}, n from imp left join (select prop_id, avg(price_usd) as m, count(*) as n "
        "from imp where split = 'test' group by 1) using (prop_id)"
    ),
)
def j1(spark, sf):
    df = impressions(spark, sf)
    learnt = df.filter("split = 'test'").groupBy("prop_id").agg(
        F.avg("price_usd").alias("price_mean"), F.count(F.lit(1)).alias("n")
    )
    return attach(df.select(*KEYS), learnt, ["prop_id"])


@register(
    "j1_left_join_hot_key",
    with_impressions(
        f"""select {KEY_SQL}, mkt, {r('m', 'price_mean')} from (select *, case when srch_id % 3 = 0 then 0 else srch_destination_id end as mkt from imp)
        left join (select case when srch_id % 3 = 0 then 0 else srch_destination_id end as mkt, avg(price_usd) as m from imp group by 1) using (mkt)"""
    ),
)
def j1_hot(spark, sf):
    """A third of the rows share a key: they are salted over many tasks."""
    key = F.expr("case when srch_id % 3 = 0 then 0 else srch_destination_id end").alias("mkt")
    df = impressions(spark, sf).select(*KEYS, "price_usd", key)
    learnt = df.groupBy("mkt").agg(F.avg("price_usd").alias("price_mean"))
    return attach(df.drop("price_usd"), learnt, ["mkt"], limit=1000)


@register(
    "j2_left_join_two_keys",
    with_impressions(
        f"select {KEY_SQL}, {r('m', 'price_mean')} from imp left join (select srch_destination_id, prop_id, avg(price_usd) as m "
        "from imp where random_bool = 0 group by 1, 2) using (srch_destination_id, prop_id)"
    ),
)
def j2(spark, sf):
    df = impressions(spark, sf)
    keys = ["srch_destination_id", "prop_id"]
    learnt = df.filter("random_bool = 0").groupBy(*keys).agg(F.avg("price_usd").alias("price_mean"))
    return attach(df.select(*KEYS, "srch_destination_id"), learnt, keys).drop("srch_destination_id")


@register(
    "j3_inner_join",
    with_impressions(
        f"select {KEY_SQL}, {r('m', 'price_mean')} from imp join (select prop_id, avg(price_usd) as m "
        "from imp where booking_bool = 1 group by 1) using (prop_id)"
    ),
)
def j3(spark, sf):
    df = impressions(spark, sf)
    learnt = df.filter("booking_bool = 1").groupBy("prop_id").agg(F.avg("price_usd").alias("price_mean"))
    return attach(df.select(*KEYS), learnt, ["prop_id"], how="inner")


_BOOKED = "select distinct srch_id from imp where booking_bool = 1"


@register("j4_semi_join_queries", with_impressions(f"select {KEY_SQL} from imp where srch_id in ({_BOOKED})"))
def j4(spark, sf):
    """Rows of searches that led to a booking."""
    df = impressions(spark, sf)
    return splits.keep_queries(df.select(*KEYS), df.filter("booking_bool = 1"), "srch_id")


@register("j5_anti_join_queries", with_impressions(f"select {KEY_SQL} from imp where srch_id not in ({_BOOKED})"))
def j5(spark, sf):
    df = impressions(spark, sf)
    return splits.drop_queries(df.select(*KEYS), df.filter("booking_bool = 1"), "srch_id")


@register(
    "l1_filters",
    with_impressions(f"select {KEY_SQL}, {r('price_usd')} from imp where random_bool = 0 and srch_children_count > 0 and booking_bool = 1"),
)
def l1(spark, sf):
    df = impressions(spark, sf).filter("random_bool = 0 and srch_children_count > 0 and booking_bool = 1")
    return df.select(*KEYS, "price_usd")


@register(
    "u2_blocks_around_holdout",
    with_impressions(
        f"select {KEY_SQL}, block from k where block <> 1",
        q="select distinct srch_id from imp",
        b="select quantile_disc(srch_id, 0.25) as b1, quantile_disc(srch_id, 0.5) as b2, quantile_disc(srch_id, 0.75) as b3 from q",
        k="select imp.*, (srch_id > b1)::int + (srch_id > b2)::int + (srch_id > b3)::int as block from imp, b",
    ),
)
def u2(spark, sf):
    """All rows around a held-out block of queries."""
    numbered = splits.add_block(impressions(spark, sf), "srch_id", 4)
    return numbered.filter(F.col("block") != 1).select(*KEYS, "block")


@register("o1_sort_by_query", with_impressions(f"select {KEY_SQL} from imp order by srch_id, position, prop_id"))
def o1(spark, sf):
    return impressions(spark, sf).select(*KEYS).orderBy("srch_id", "position", "prop_id")


# --- splits ------------------------------------------------------------------------------


@register(
    "k1_group_holdout",
    with_impressions(f"select {KEY_SQL}, case when srch_id % 5 = 0 then 'val' else 'train' end as part from imp"),
)
def k1(spark, sf):
    df = impressions(spark, sf).select(*KEYS)
    return splits.add_holdout(df, "srch_id", 5, fold_expr=F.col("srch_id") % 5)


@register("k1_hash_holdout_is_group_safe", with_impressions("select count(distinct srch_id) as queries, cast(0 as bigint) as cut_queries from imp"))
def k1_hash(spark, sf):
    """The default hash split never puts one query into both parts."""
    df = splits.add_holdout(impressions(spark, sf), "srch_id", 5)
    per = df.groupBy("srch_id").agg(F.count_distinct("part").alias("parts"))
    return per.agg(
        F.count(F.lit(1)).alias("queries"), F.count_if(F.col("parts") > 1).alias("cut_queries")
    )


@register("k2_query_folds", with_impressions(f"select {KEY_SQL}, cast(srch_id % 5 as int) as fold from imp"))
def k2(spark, sf):
    return splits.add_fold(impressions(spark, sf).select(*KEYS), "srch_id", 5, fold_expr=F.col("srch_id") % 5)


@register(
    "k3_query_blocks",
    with_impressions(
        f"select {KEY_SQL}, (srch_id > b1)::int + (srch_id > b2)::int + (srch_id > b3)::int + (srch_id > b4)::int as block from imp, b",
        q="select distinct srch_id from imp",
        b="select quantile_disc(srch_id, 0.2) as b1, quantile_disc(srch_id, 0.4) as b2, quantile_disc(srch_id, 0.6) as b3, "
        "quantile_disc(srch_id, 0.8) as b4 from q",
    ),
)
def k3(spark, sf):
    df = impressions(spark, sf).select(*KEYS)
    bounds = splits.block_bounds(df, "srch_id", 5)
    return splits.add_block(df, "srch_id", 5, bounds)


@register("k4_split_report", with_impressions("select split, count(*) as rows, count(distinct srch_id) as queries from imp group by 1"))
def k4(spark, sf):
    return splits.split_report(impressions(spark, sf), "split", "srch_id")
