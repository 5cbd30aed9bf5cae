"""Statistics from a store of deliveries, each against the SQL of the one-time build.

The impressions arrive as three days. One day comes first with half its searches missing and is delivered
again, late rows come under their own id, and the last delivery is repeated as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.catalog.encodings import KEY_SQL, apply_sql
from rankloom.catalog.group_stats import MARKETS_SQL, RF
from rankloom.catalog.impressions import KEYS, ROLES, impressions, r, rs, with_impressions
from rankloom.catalog.registry import register
from rankloom.operators import encode, refresh, stats
from rankloom.operators.skew import attach, materialise, shared_dir

DAY = "case when srch_id % 50 = 7 then 'late' else concat('day-', srch_id % 3) end"


def delivered(df: DataFrame, put: Callable[[DataFrame, str, str], None]) -> str:
    """The store after all deliveries of ``df``."""
    store = f"{shared_dir(df.sparkSession)}/deliveries-{uuid.uuid4().hex}"
    days = materialise(df.withColumn("_day", F.expr(DAY)))

    def day(name: str) -> DataFrame:
        return days.filter(F.col("_day") == name).drop("_day")

    put(day("day-0"), store, "day-0")
    put(day("day-1").filter("srch_id % 2 = 0"), store, "day-1")
    put(day("day-1"), store, "day-1")
    put(day("late"), store, "late")
    for _ in range(2):
        put(day("day-2"), store, "day-2")
    return store


@register(
    "t3_refreshed_item_rates",
    with_impressions(
        f"select {KEY_SQL}, {rs('prop_booking_rate_oof', 'prop_ctr_oof')} from rated", **apply_sql(("prop_id",), encode.ITEM_TARGETS)
    ),
)
def t3(spark, sf):
    df, targets = impressions(spark, sf), encode.ITEM_TARGETS
    labels = [t.label for t in targets]
    train = df.filter("split = 'train'").select("srch_id", "prop_id", *labels)
    store = delivered(train, lambda rows, to, id: refresh.deliver(rows, to, ("prop_id",), labels, id))
    rates, prior = refresh.item_rates(spark, store, ("prop_id",), targets)
    out = attach(df.filter("split = 'test'").select(*dict.fromkeys([*KEYS, "prop_id"])), rates, ["prop_id"], salt_by=KEYS)
    return out.select(*KEYS, *[F.coalesce(F.col(t.out), F.lit(prior[t.label])).alias(t.out) for t in targets])


@register(
    "g3_refreshed_position_profile",
    with_impressions(
        f"""select prop_id, {r('avg(position)', 'prop_avg_position')}, min(position) as prop_best_position,
        {r('stddev_samp(position)', 'prop_position_std')}, count(*) as prop_nonrandom_appearances
        from imp where random_bool = 0 group by 1"""
    ),
)
def g3(spark, sf):
    df = impressions(spark, sf).select("srch_id", "prop_id", "position", "random_bool")
    store = delivered(df, lambda rows, to, id: refresh.deliver_positions(rows, to, id, roles=ROLES))
    return refresh.position_profile(spark, store, ROLES)


@register(
    "g4_refreshed_estimated_position",
    with_impressions(
        f"select srch_destination_id, prop_id, {rs('estimated_position')} from e",
        e="""select srch_destination_id, prop_id, 1.0e0 / avg(position) as estimated_position
        from imp where random_bool = 0 group by 1, 2""",
    ),
)
def g4(spark, sf):
    df = impressions(spark, sf).select("srch_id", "srch_destination_id", "prop_id", "position", "random_bool")
    store = delivered(df, lambda rows, to, id: refresh.deliver_positions(rows, to, id, by_market=True, roles=ROLES))
    return refresh.estimated_position(spark, store, ROLES)


@register(
    "g7_refreshed_market_stats",
    with_impressions(
        f"select srch_destination_id, {rs(*[c for c in stats.market_helper_columns() if 'month' not in c])}, dest_search_count from m",
        rf=RF,
        m=MARKETS_SQL,
    ),
)
def g7(spark, sf):
    columns = dict.fromkeys(["srch_id", ROLES.market, *refresh.market_columns(ROLES).values()])
    df = impressions(spark, sf).select(*columns)
    return refresh.market_stats(spark, delivered(df, lambda rows, to, id: refresh.deliver_markets(rows, to, id, ROLES)), ROLES)
