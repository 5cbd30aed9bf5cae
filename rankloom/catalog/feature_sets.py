"""Row features, in-query features and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.impressions import (
    DOUBLE_ROW_FEATURES,
    KEYS,
    QUERY_FLAGS,
    QUERY_RANKS,
    QUERY_RELATIVE,
    QUERY_STATS,
    ROLES,
    ROW_FEATURES,
    TIES,
    impressions,
    ordinal,
    query_relative_sql,
    query_stats_sql,
    r,
    row_features_sql,
    rs,
    table,
    with_impressions,
)
from rankloom.catalog.registry import register
from rankloom.operators import features
from rankloom.plans.feature_tables import base_features

KEY_SQL = ", ".join(KEYS)


def _row_sql(names) -> str:
    cols = ", ".join(r(ROW_FEATURES[n], n) if n in DOUBLE_ROW_FEATURES else f"{ROW_FEATURES[n]} as {n}" for n in names)
    return with_impressions(f"select {KEY_SQL}, {cols} from imp")


def _row_query(name: str, make, columns: tuple[str, ...], doc: str) -> None:
    def run(spark, sf):
        made = make(ROLES)
        return impressions(spark, sf).select(*KEYS, *[made[c].alias(c) for c in columns])

    run.__doc__ = doc
    register(name, _row_sql(columns))(run)


_row_query(
    "f1_f3_price_features",
    features.price_features,
    ("log_price_usd", "price_per_night", "log_price_per_night"),
    "log price, price per night and its log",
)
_row_query(
    "f4_f10_composite_features",
    features.composite_features,
    ("ump", "price_diff", "starrating_diff", "per_fee", "total_fee", "score1d2", "score2ma"),
    "price, fee, star and score composites",
)
_row_query(
    "f12_f13_alignment_features",
    features.alignment_features,
    ("star_rating_alignment", "price_alignment"),
    "distance to the visitor's history",
)
_row_query(
    "f14_f17_competitor_features",
    features.competitor_features,
    ("num_comp_cheaper", "num_comp_more_expensive", "competitor_availability_pressure", "avg_comp_price_diff"),
    "counts and mean over competitors",
)
_row_query(
    "f18_f20_party_features",
    features.party_features,
    ("family_trip_flag", "group_travel_size", "guests_per_room"),
    "family flag, party size, guests per room",
)
_row_query(
    "f21_f23_calendar_features",
    features.calendar_features,
    (
        "search_month",
        "search_day_of_week",
        "search_hour",
        "checkin_datetime",
        "checkin_month",
        "checkin_day_of_week",
    ),
    "parts of search and check-in time",
)
_row_query(
    "f25_f27_missing_flags",
    features.missing_flags,
    (
        "visitor_history_star_missing",
        "visitor_history_price_missing",
        "missing_star_rating_flag",
        "review_score_zero_flag",
        "review_score_missing_flag",
        "missing_historical_price_flag",
        "affinity_score_missing_flag",
        "distance_missing_flag",
        "location_score2_missing_flag",
    ),
    "missing and zero flags",
)


@register(
    "f11_count_window",
    with_impressions(
        f"select {KEY_SQL}, {r('srch_room_count * (select max(srch_booking_window) from imp) + srch_booking_window', 'count_window')} from imp"
    ),
)
def f11(spark, sf):
    return features.count_window(impressions(spark, sf), ROLES).select(*KEYS, "count_window")


@register(
    "f20_guests_per_room_zero_rooms",
    f"""select l_orderkey, l_linenumber, l_shipdate,
        {r('(l_quantity + l_linenumber) / nullif(l_partkey % 3, 0)', 'guests_per_room')} from lineitem""",
)
def f20_zero(spark, sf):
    """No rooms gives NULL, not an error."""
    df = table(spark, sf, "lineitem").withColumns({"rooms": F.col("l_partkey") % 3, "adults": F.col("l_quantity")})
    roles = ROLES.with_(adults="adults", children="l_linenumber", rooms="rooms")
    guests = features.party_features(roles)["guests_per_room"]
    return df.select("l_orderkey", "l_linenumber", "l_shipdate", guests.alias("guests_per_room"))


@register(
    "f21_event_hours",
    """select event_id, cast(month(ts) as int) as search_month, cast(isodow(ts) as int) as search_day_of_week,
       cast(hour(ts) as int) as search_hour from events""",
)
def f21(spark, sf):
    """Calendar parts on a table whose times have hours."""
    parts = features.calendar_features(ROLES.with_(time="ts"))
    names = ("search_month", "search_day_of_week", "search_hour")
    return table(spark, sf, "events").select("event_id", *[parts[n].alias(n) for n in names])


@register(
    "f24_promotion_price",
    with_impressions(
        f"select {KEY_SQL}, {r('promotion_flag * (price_usd - avg(price_usd) over (partition by srch_id))', 'promotion_price_interaction')} from imp"
    ),
)
def f24(spark, sf):
    return base_features(impressions(spark, sf), ROLES).select(*KEYS, "promotion_price_interaction")


@register("f28_relevance", with_impressions(f"select {KEY_SQL}, {ROW_FEATURES['relevance']} as relevance from imp"))
def f28(spark, sf):
    df = impressions(spark, sf)
    return df.withColumns(features.label_features(df, ROLES)).select(*KEYS, "relevance")


@register(
    "f29_first_match_target",
    with_impressions(
        f"""select {KEY_SQL}, case when click_bool = 1 then 1 when booking_bool = 1 then 2 else 0 end as target,
        case when booking_bool = 1 then 2 when click_bool = 1 then 1 else 0 end as target_booking_first from imp"""
    ),
)
def f29(spark, sf):
    return impressions(spark, sf).select(
        *KEYS,
        features.first_match_target(ROLES).alias("target"),
        features.first_match_target(ROLES, (("book", 2), ("click", 1))).alias("target_booking_first"),
    )


@register(
    "f30_date_parts",
    """select event_id, cast(month(ts) as int) as month, cast(hour(ts) as int) as hour,
       cast(isodow(ts) - 1 as int) as dayofweek from events""",
)
def f30(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", *[c.alias(n) for n, c in features.date_parts("ts").items()]
    )


_PAIRS = (("price_usd", "prop_starrating"), ("price_usd", "prop_review_score"), ("price_usd", "prop_location_score2"))


@register(
    "f31_price_quality_interactions",
    with_impressions(f"select {KEY_SQL}, {', '.join(r(f'{a} * {b}', f'{a}_x_{b}') for a, b in _PAIRS)} from imp"),
)
def f31(spark, sf):
    return impressions(spark, sf).select(*KEYS, *[c.alias(n) for n, c in features.interactions(_PAIRS).items()])


# --- query-relative ------------------------------------------------------------------

_PARTS = dict(
    rf=row_features_sql("imp"),
    qs=query_stats_sql("rf"),
    qr=query_relative_sql("qs"),
)
_STAT_SQL = ", ".join(n if n == "query_hotel_count" else r(n) for n in QUERY_STATS)


@register("g1_query_stats", with_impressions(f"select {KEY_SQL}, {_STAT_SQL} from qs", rf=_PARTS["rf"], qs=_PARTS["qs"]))
def g1(spark, sf):
    return base_features(impressions(spark, sf), ROLES).select(*KEYS, *QUERY_STATS)


@register("r1_r3_query_relative", with_impressions(f"select {KEY_SQL}, {rs(*QUERY_RELATIVE)} from qr", **_PARTS))
def r1(spark, sf):
    return base_features(impressions(spark, sf), ROLES).select(*KEYS, *QUERY_RELATIVE)


@register(
    "w1_ordinal_ranks",
    with_impressions(
        f"select {KEY_SQL}, {ordinal('prop_review_score')} as review_rank, {ordinal('prop_location_score2')} as location_rank from imp"
    ),
)
def w1(spark, sf):
    ranked = features.add_ordinal_ranks(
        impressions(spark, sf),
        {"review_rank": "prop_review_score", "location_rank": "prop_location_score2"},
        ["srch_id"],
        TIES,
    )
    return ranked.select(*KEYS, "review_rank", "location_rank")


# One query takes a third of all rows: its ranks and statistics must still be exact.
_HOT = "case when srch_id % 3 = 0 then 0 else srch_id end"
_HOT_TIES = "srch_id, position, prop_id, srch_destination_id, price_usd, tiebreak_ts"
_HOT_SQL = dict(
    hot=f"select *, {_HOT} as qid from imp",
    ranked=f"""select {KEY_SQL}, qid, {ordinal('price_usd', 'qid', _HOT_TIES)} as price_rank,
        {ordinal('prop_starrating', 'qid', _HOT_TIES)} as star_rank,
        avg(price_usd) over (partition by qid) as price_mean,
        stddev_samp(price_usd) over (partition by qid) as price_std,
        count(*) over (partition by qid) as n from hot""",
)


@register(
    "w1_ranks_with_hot_query",
    with_impressions(
        f"select {KEY_SQL}, qid, price_rank, star_rank, {rs('price_mean', 'price_std')}, n from ranked", **_HOT_SQL
    ),
)
def w1_hot(spark, sf):
    from rankloom.operators.skew import grouped, hot_keys

    df = impressions(spark, sf).withColumn("qid", F.expr(_HOT))
    ties = ["srch_id", *TIES]

    def build(part, groups):
        part = groups.attach(
            part, price_mean=F.avg("price_usd"), price_std=F.stddev_samp("price_usd"), n=F.count(F.lit(1))
        )
        return groups.ordinal(
            part,
            price_rank=features.ascending("price_usd", ties),
            star_rank=features.ascending("prop_starrating", ties),
        )

    out = grouped(df, ["qid"], build, hot_keys(df, ["qid"], limit=1000))
    return out.select(*KEYS, "qid", "price_rank", "star_rank", "price_mean", "price_std", "n")


@register(
    "w2_percentile_ranks",
    with_impressions(f"select {KEY_SQL}, {rs(*QUERY_RANKS)} from qr", **_PARTS),
)
def w2(spark, sf):
    df = impressions(spark, sf).withColumns(features.price_features(ROLES))
    out = features.add_percentile_ranks(df, features.rank_columns(ROLES), ["srch_id"], TIES)
    return out.select(*KEYS, *QUERY_RANKS)


@register("w4_w5_cheapest_flags", with_impressions(f"select {KEY_SQL}, {', '.join(QUERY_FLAGS)} from qr", **_PARTS))
def w4(spark, sf):
    return base_features(impressions(spark, sf), ROLES).select(*KEYS, *QUERY_FLAGS)


@register(
    "w4_group_minimum_flag",
    with_impressions(
        f"""select {KEY_SQL}, cast(prop_review_score = min(prop_review_score) over (partition by srch_id) as int) as lowest_review_flag from imp"""
    ),
)
def w4_min(spark, sf):
    out = features.add_group_minimum_flag(impressions(spark, sf), "prop_review_score", ["srch_id"], "lowest_review_flag")
    return out.select(*KEYS, "lowest_review_flag")


BASE_DOUBLES = [*DOUBLE_ROW_FEATURES, "count_window", *[s for s in QUERY_STATS if s != "query_hotel_count"], *QUERY_RELATIVE, *QUERY_RANKS]
BASE_OTHERS = [n for n in ROW_FEATURES if n not in DOUBLE_ROW_FEATURES] + ["query_hotel_count", *QUERY_FLAGS]


@register(
    "x2_base_features",
    with_impressions(
        f"select {KEY_SQL}, {rs(*[b for b in BASE_DOUBLES if b != 'count_window'])}, "
        f"{r('srch_room_count * (select max(srch_booking_window) from imp) + srch_booking_window', 'count_window')}, "
        f"{', '.join(BASE_OTHERS)} from qr",
        **_PARTS,
    ),
)
def x2(spark, sf):
    """All base features of every impression."""
    return base_features(impressions(spark, sf), ROLES).select(*KEYS, *BASE_DOUBLES, *BASE_OTHERS)
