"""Search impressions derived from the order tables: order = search, line = shown item,
supplier = market. ``impressions`` is the Spark view, ``IMPRESSIONS_SQL`` the same in SQL.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.catalog.registry import NUDGE, places
from rankloom.operators import skew
from rankloom.roles import Roles

TIES = ("position", "prop_id", "srch_destination_id", "price_usd", "tiebreak_ts")

ROLES = Roles(
    comp_rate=("comp1_rate", "comp2_rate"),
    comp_inv=("comp1_inv", "comp2_inv"),
    comp_diff=("comp1_rate_percent_diff", "comp2_rate_percent_diff"),
    ties=TIES,
)

IMPRESSIONS_SQL = """
select
  l.l_orderkey as srch_id, l.l_partkey as prop_id, l.l_suppkey as srch_destination_id,
  c.c_nationkey as visitor_location_country_id, s.s_nationkey as prop_country_id,
  o.o_orderdate as date_time, l.l_linenumber as position,
  case when o.o_orderkey % 3 = 0 then 1 else 0 end as random_bool,
  l.l_extendedprice as price_usd, p.p_size % 6 as prop_starrating,
  case when l.l_partkey % 7 = 0 then null else (l.l_partkey % 11) / 2.0e0 end as prop_review_score,
  l.l_quantity / 10.0e0 as prop_location_score1,
  case when l.l_suppkey % 4 = 0 then null else l.l_discount end as prop_location_score2,
  case when l.l_partkey % 13 = 0 then 0.0e0 else ln(p.p_retailprice) end as prop_log_historical_price,
  case when l.l_tax > 0.05e0 then 1 else 0 end as promotion_flag,
  1 + o.o_custkey % 7 as srch_length_of_stay, o.o_custkey % 60 as srch_booking_window,
  1 + o.o_custkey % 4 as srch_adults_count,
  case when o.o_custkey % 4 = 0 then 1 + o.o_custkey % 3 else 0 end as srch_children_count,
  1 + o.o_custkey % 3 as srch_room_count,
  case when o.o_custkey % 10 = 0 then (o.o_custkey % 5) + 0.5e0 else null end as visitor_hist_starrating,
  case when o.o_custkey % 10 = 0 then abs(c.c_acctbal) else null end as visitor_hist_adr_usd,
  case when l.l_suppkey % 9 = 0 then -1.0e0 * l.l_quantity else null end as srch_query_affinity_score,
  case when o.o_custkey % 3 = 0 then null else o.o_custkey * 1.5e0 end as orig_destination_distance,
  case l.l_partkey % 4 when 0 then -1 when 1 then 0 when 2 then 1 else null end as comp1_rate,
  case l.l_suppkey % 4 when 0 then -1 when 1 then 0 when 2 then 1 else null end as comp2_rate,
  case when l.l_partkey % 5 = 0 then null else l.l_partkey % 2 end as comp1_inv,
  case when l.l_suppkey % 5 = 0 then null else l.l_suppkey % 2 end as comp2_inv,
  case when l.l_partkey % 3 = 0 then null else l.l_quantity end as comp1_rate_percent_diff,
  case when l.l_suppkey % 3 = 0 then null else l.l_quantity * 2.0e0 end as comp2_rate_percent_diff,
  case when l.l_returnflag = 'R' then 1 else 0 end as click_bool,
  case when l.l_returnflag = 'R' and l.l_linestatus = 'F' then 1 else 0 end as booking_bool,
  case when o.o_orderkey % 10 < 8 then 'train' else 'test' end as split,
  l.l_shipdate as tiebreak_ts
from lineitem l
join orders o on o.o_orderkey = l.l_orderkey
join customer c on c.c_custkey = o.o_custkey
join part p on p.p_partkey = l.l_partkey
join supplier s on s.s_suppkey = l.l_suppkey
"""


SENT_VALUES = 10 * skew.TASK_ROWS  # most values of a table of more than TASK_ROWS rows that is sent, some 20 MB


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _met(rows: DataFrame, n: int, key: str, other: DataFrame, other_key: str, others: int | None = None) -> DataFrame:
    """Inner join of ``n`` rows. Beyond TASK_ROWS rows a core they are dealt by key, about TASK_ROWS a task, or a table
    of fewer rows or few values is sent to them: Spark makes tasks of equal bytes, and of these narrow rows a few bytes are
    left each. Dealing all rows once more takes more disk than a copy of such a table in every executor takes memory."""
    if n > skew.TASK_ROWS * rows.sparkSession.sparkContext.defaultParallelism:
        size = other.count() if others is None else others
        sent = others is None and size * len(other.columns) <= SENT_VALUES  # not what has been dealt itself
        if size > skew.TASK_ROWS and not sent:
            rows = rows.repartition(ceil(n / skew.TASK_ROWS), key)
        else:
            other = F.broadcast(other)
    return rows.join(other, F.col(other_key) == F.col(key))


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    col, lit, when = F.col, F.lit, F.when
    cust, part, supp, qty = col("o_custkey"), col("l_partkey"), col("l_suppkey"), col("l_quantity")

    def rate(key):
        k = key % 4
        return when(k == 0, -1).when(k == 1, 0).when(k == 2, 1)

    # searches and their visitors meet before the lines, which come last and stay together by search
    orders, joined = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines, by = joined.count(), orders.count()  # from the files' footers
    searches = _met(orders, by, "o_custkey", table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), "c_custkey")
    joined = _met(joined, lines, "l_partkey", table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")
    joined = _met(joined, lines, "l_suppkey", table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_suppkey")
    joined = _met(joined, lines, "l_orderkey", searches, "o_orderkey", by)
    return joined.select(
        col("l_orderkey").alias("srch_id"),
        part.alias("prop_id"),
        supp.alias("srch_destination_id"),
        col("c_nationkey").alias("visitor_location_country_id"),
        col("s_nationkey").alias("prop_country_id"),
        col("o_orderdate").alias("date_time"),
        col("l_linenumber").alias("position"),
        when(col("o_orderkey") % 3 == 0, 1).otherwise(0).alias("random_bool"),
        col("l_extendedprice").alias("price_usd"),
        (col("p_size") % 6).alias("prop_starrating"),
        when(part % 7 != 0, (part % 11) / lit(2.0)).alias("prop_review_score"),
        (qty / lit(10.0)).alias("prop_location_score1"),
        when(supp % 4 != 0, col("l_discount")).alias("prop_location_score2"),
        when(part % 13 == 0, 0.0).otherwise(F.ln("p_retailprice")).alias("prop_log_historical_price"),
        when(col("l_tax") > 0.05, 1).otherwise(0).alias("promotion_flag"),
        (lit(1) + cust % 7).alias("srch_length_of_stay"),
        (cust % 60).alias("srch_booking_window"),
        (lit(1) + cust % 4).alias("srch_adults_count"),
        when(cust % 4 == 0, lit(1) + cust % 3).otherwise(0).alias("srch_children_count"),
        (lit(1) + cust % 3).alias("srch_room_count"),
        when(cust % 10 == 0, cust % 5 + lit(0.5)).alias("visitor_hist_starrating"),
        when(cust % 10 == 0, F.abs("c_acctbal")).alias("visitor_hist_adr_usd"),
        when(supp % 9 == 0, lit(-1.0) * qty).alias("srch_query_affinity_score"),
        when(cust % 3 != 0, cust * lit(1.5)).alias("orig_destination_distance"),
        rate(part).alias("comp1_rate"),
        rate(supp).alias("comp2_rate"),
        when(part % 5 != 0, part % 2).alias("comp1_inv"),
        when(supp % 5 != 0, supp % 2).alias("comp2_inv"),
        when(part % 3 != 0, qty).alias("comp1_rate_percent_diff"),
        when(supp % 3 != 0, qty * lit(2.0)).alias("comp2_rate_percent_diff"),
        when(col("l_returnflag") == "R", 1).otherwise(0).alias("click_bool"),
        when((col("l_returnflag") == "R") & (col("l_linestatus") == "F"), 1).otherwise(0).alias("booking_bool"),
        when(col("o_orderkey") % 10 < 8, "train").otherwise("test").alias("split"),
        col("l_shipdate").alias("tiebreak_ts"),
    )


# --- SQL helpers ---------------------------------------------------------------

TIE_SQL = ", ".join(TIES)


def with_impressions(body: str, **ctes: str) -> str:
    """The body after ``with imp as (...)`` and any further named parts, in order."""
    parts = [f"imp as ({IMPRESSIONS_SQL})", *[f"{n} as ({q})" for n, q in ctes.items()]]
    return "with " + ",\n".join(parts) + "\n" + body


def r(expr: str, name: str | None = None) -> str:
    """A rounded double with a name, as ``registry.tidy`` does on the other side."""
    name = name or expr
    unit = f"1e{places(name)}"
    return f"(round((cast({expr} as double) + {NUDGE!r}::double) * {unit}) / {unit} + 0.0e0) as {name}"


def rs(*names: str) -> str:
    return ", ".join(r(n) for n in names)


def ordinal(column: str, by: str = "srch_id", ties: str = TIE_SQL) -> str:
    """Ordinal rank of a column in a group, NULL where the value is."""
    return (
        f"case when {column} is not null then row_number() over "
        f"(partition by {by} order by {column} asc nulls last, {ties}) end"
    )


# Row features as SQL over a relation with the impression columns.
ROW_FEATURES = {
    "log_price_usd": "ln(1 + price_usd)",
    "price_per_night": "price_usd / greatest(srch_length_of_stay, 1)",
    "log_price_per_night": "ln(1 + price_usd / greatest(srch_length_of_stay, 1))",
    "ump": "exp(prop_log_historical_price) - price_usd",
    "price_diff": "visitor_hist_adr_usd - price_usd",
    "starrating_diff": "visitor_hist_starrating - prop_starrating",
    "per_fee": "price_usd * srch_room_count / (srch_adults_count + srch_children_count + 1e-6)",
    "total_fee": "price_usd * srch_room_count",
    "score1d2": "(coalesce(prop_location_score2, 0) + 1e-4) / (coalesce(prop_location_score1, 0) + 1e-4)",
    "score2ma": "coalesce(prop_location_score2, 0) * coalesce(srch_query_affinity_score, 0)",
    "star_rating_alignment": "abs(prop_starrating - visitor_hist_starrating)",
    "price_alignment": "abs(price_usd - visitor_hist_adr_usd)",
    "num_comp_cheaper": "cast(coalesce(comp1_rate = -1, false) as int) + cast(coalesce(comp2_rate = -1, false) as int)",
    "num_comp_more_expensive": "cast(coalesce(comp1_rate = 1, false) as int) + cast(coalesce(comp2_rate = 1, false) as int)",
    "competitor_availability_pressure": "cast(coalesce(comp1_inv = 1, false) as int) + cast(coalesce(comp2_inv = 1, false) as int)",
    "avg_comp_price_diff": "(coalesce(comp1_rate_percent_diff, 0) + coalesce(comp2_rate_percent_diff, 0)) / "
    "nullif((comp1_rate_percent_diff is not null)::int + (comp2_rate_percent_diff is not null)::int, 0)",
    "family_trip_flag": "cast(srch_children_count > 0 as int)",
    "group_travel_size": "cast(srch_adults_count + srch_children_count as int)",
    "guests_per_room": "(srch_adults_count + srch_children_count) / nullif(srch_room_count, 0)",
    "search_month": "cast(month(date_time) as int)",
    "search_day_of_week": "cast(isodow(date_time) as int)",
    "search_hour": "cast(hour(date_time) as int)",
    "checkin_datetime": "date_time + to_days(cast(srch_booking_window as int))",
    "checkin_month": "cast(month(date_time + to_days(cast(srch_booking_window as int))) as int)",
    "checkin_day_of_week": "cast(isodow(date_time + to_days(cast(srch_booking_window as int))) as int)",
    "visitor_history_star_missing": "cast(visitor_hist_starrating is null as int)",
    "visitor_history_price_missing": "cast(visitor_hist_adr_usd is null as int)",
    "missing_star_rating_flag": "cast(prop_starrating = 0 as int)",
    "review_score_zero_flag": "cast(prop_review_score = 0 as int)",
    "review_score_missing_flag": "cast(prop_review_score is null as int)",
    "missing_historical_price_flag": "cast(prop_log_historical_price = 0 as int)",
    "affinity_score_missing_flag": "cast(srch_query_affinity_score is null as int)",
    "distance_missing_flag": "cast(orig_destination_distance is null as int)",
    "location_score2_missing_flag": "cast(prop_location_score2 is null as int)",
    "relevance": "5 * booking_bool + click_bool * (1 - booking_bool)",
}
DOUBLE_ROW_FEATURES = {
    "log_price_usd", "price_per_night", "log_price_per_night", "ump", "price_diff", "starrating_diff", "per_fee",
    "total_fee", "score1d2", "score2ma", "star_rating_alignment", "price_alignment", "avg_comp_price_diff",
    "guests_per_room",
}

QUERY_STATS = {
    "query_price_mean": "avg(price_usd)",
    "query_price_std": "stddev_samp(price_usd)",
    "query_price_min": "min(price_usd)",
    "query_price_max": "max(price_usd)",
    "query_log_price_mean": "avg(log_price_usd)",
    "query_log_price_std": "stddev_samp(log_price_usd)",
    "query_ppn_mean": "avg(price_per_night)",
    "query_ppn_std": "stddev_samp(price_per_night)",
    "query_ppn_min": "min(price_per_night)",
    "query_star_mean": "avg(prop_starrating)",
    "query_review_mean": "avg(prop_review_score)",
    "query_review_min": "min(prop_review_score)",
    "query_review_max": "max(prop_review_score)",
    "query_location_mean1": "avg(prop_location_score1)",
    "query_location_max1": "max(prop_location_score1)",
    "query_location_mean2": "avg(prop_location_score2)",
    "query_hotel_count": "count(*)",
}
QUERY_RELATIVE = {
    "price_diff_from_query_mean": "price_usd - query_price_mean",
    "price_zscore": "(price_usd - query_price_mean) / (query_price_std + 1e-6)",
    "log_price_diff_from_mean": "log_price_usd - query_log_price_mean",
    "log_price_zscore": "(log_price_usd - query_log_price_mean) / (query_log_price_std + 1e-6)",
    "ppn_diff_from_query_mean": "price_per_night - query_ppn_mean",
    "ppn_zscore": "(price_per_night - query_ppn_mean) / (query_ppn_std + 1e-6)",
    "star_diff_from_mean": "prop_starrating - query_star_mean",
    "review_diff_from_mean": "prop_review_score - query_review_mean",
    "location_diff_from_mean1": "prop_location_score1 - query_location_mean1",
    "location_diff_from_mean2": "prop_location_score2 - query_location_mean2",
    "promotion_price_interaction": "promotion_flag * (price_usd - query_price_mean)",
}
QUERY_FLAGS = {
    "cheapest_ppn_flag": "cast(price_per_night = query_ppn_min as int)",
    "cheapest_hotel_flag": "cast(price_usd = query_price_min as int)",
}
QUERY_RANKS = {
    "ppn_pct_rank": "price_per_night",
    "price_pct_rank": "price_usd",
    "star_pct_rank": "prop_starrating",
    "review_pct_rank": "prop_review_score",
    "location_pct_rank1": "prop_location_score1",
    "location_pct_rank2": "prop_location_score2",
}


def row_features_sql(source: str, labels: bool = True) -> str:
    feats = {n: e for n, e in ROW_FEATURES.items() if labels or n != "relevance"}
    return f"select *, {', '.join(f'{e} as {n}' for n, e in feats.items())} from {source}"


def query_stats_sql(source: str, by: str = "srch_id") -> str:
    cols = ", ".join(f"{e} over (partition by {by}) as {n}" for n, e in QUERY_STATS.items())
    return f"select *, {cols} from {source}"


def query_relative_sql(source: str, by: str = "srch_id") -> str:
    cols = [f"{e} as {n}" for n, e in (QUERY_RELATIVE | QUERY_FLAGS).items()]
    cols += [f"({ordinal(c, by)}) / query_hotel_count as {n}" for n, c in QUERY_RANKS.items()]
    return f"select *, {', '.join(cols)} from {source}"


KEYS = ("srch_id", "prop_id", "position", "tiebreak_ts")
