"""Sources, sinks, cleaning, schema operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.catalog.impressions import KEYS, ROLES, TIE_SQL, TIES, impressions, r, rs, table, with_impressions
from rankloom.catalog.registry import register
from rankloom.operators import clean, features, metrics
from rankloom.operators.rankers import rank_items
from rankloom.operators.skew import dealt, shared_dir
from rankloom.plans import prepare
from rankloom.sources import tables

KEY_SQL = ", ".join(KEYS)


def scratch(spark, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "s1_csv_round_trip",
    with_impressions(
        f"select {KEY_SQL}, date_time, {rs('price_usd', 'prop_review_score')}, comp1_rate, click_bool, split from imp"
    ),
)
def s1(spark, sf):
    """Write impressions as CSV with NULL tokens, read them back typed."""
    df = impressions(spark, sf).select(
        *KEYS, "date_time", "price_usd", "prop_review_score", "comp1_rate", "click_bool", "split"
    )
    path = scratch(spark, "csv")
    tables.write_csv(df, path, null_token="NULL")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
    return tables.read_csv(spark, path, schema=schema, null_token="NULL")


@register("s2_parquet_scan", f"select l_orderkey, l_partkey, {r('l_extendedprice')} from lineitem where l_quantity >= 25")
def s2(spark, sf):
    """Column-pruned scan with a filter that reaches the files."""
    df = tables.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_extendedprice", "l_quantity"])
    return df.filter(F.col("l_quantity") >= 25).drop("l_quantity")


@register("s3_parquet_sink", with_impressions(f"select {KEY_SQL}, {r('price_usd')}, split from imp"))
def s3(spark, sf):
    """Write one folder per split, read both back."""
    df = impressions(spark, sf).select(*KEYS, "price_usd", "split")
    path = scratch(spark, "features")
    tables.write_parquet(df, path, ["split"], ["split", "srch_id"])
    return tables.read_parquet(spark, path).select(*df.columns)


SCORE = "prop_review_score - price_usd / 10000"
SCORE_SQL = "prop_review_score - price_usd / 10000.0e0"


@register(
    "s4_ranking_file",
    with_impressions(
        f"select srch_id, prop_id, row_number() over (partition by srch_id order by {SCORE_SQL} desc nulls last, {TIE_SQL}) as rank from imp"
    ),
)
def s4(spark, sf):
    """Ranking written as CSV in rank order and read back."""
    df = impressions(spark, sf).withColumn("score", F.expr(SCORE_SQL))
    path = scratch(spark, "ranking")
    tables.write_ranking(rank_items(df, "srch_id", "prop_id", "score", TIES), path, "srch_id", "prop_id")
    return tables.read_ranking(spark, path, "srch_id", "prop_id")


@register(
    "c1_null_tokens",
    """select l_orderkey, l_linenumber, l_shipdate,
         case when l_partkey % 7 = 0 then null else cast(l_partkey as varchar) end as item_text,
         case when l_suppkey % 5 = 0 then null else l_returnflag end as flag_text
       from lineitem""",
)
def c1(spark, sf):
    """The text NULL becomes a NULL in all string columns."""
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        F.when(F.col("l_partkey") % 7 == 0, "NULL").otherwise(F.col("l_partkey").cast("string")).alias("item_text"),
        F.when(F.col("l_suppkey") % 5 == 0, "NULL").otherwise(F.col("l_returnflag")).alias("flag_text"),
    )
    return clean.null_tokens(raw)


@register(
    "c2_lenient_cast",
    f"""select l_orderkey, l_linenumber, l_shipdate,
         {r("case when l_partkey % 7 = 0 then null else cast(l_quantity as float) end", "quantity")},
         cast(case when l_partkey % 11 = 0 then null else l_partkey % 2 end as tinyint) as flag
       from lineitem""",
)
def c2(spark, sf):
    """Unreadable numbers become NULL instead of an error."""
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_shipdate",
        F.when(F.col("l_partkey") % 7 == 0, "12x").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
        F.when(F.col("l_partkey") % 11 == 0, "").otherwise((F.col("l_partkey") % 2).cast("string")).alias("flag"),
    )
    return clean.lenient_cast(raw, ["quantity"], ["flag"])


_INTS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "deep", "small", "empty")


def _int_text(spark, sf):
    return table(spark, sf, "lineitem").select(
        *[F.col(c).cast("string").alias(c) for c in _INTS[:4]],
        (F.col("l_orderkey") * 3000000000).cast("string").alias("deep"),
        (F.col("l_partkey") % 200 - 100).cast("string").alias("small"),
        F.lit(None).cast("string").alias("empty"),
    )


@register(
    "c3_narrow_integers",
    """select cast(l_orderkey as bigint) as l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as l_linenumber,
         l_orderkey * 3000000000 as deep, cast(l_partkey % 200 - 100 as bigint) as small, cast(null as bigint) as empty
       from lineitem""",
)
def c3(spark, sf):
    """Values survive the narrowing (compared as bigint; the types are in c4)."""
    narrow = clean.narrow_integers(_int_text(spark, sf), _INTS)
    return narrow.select(*[F.col(c).cast("bigint").alias(c) for c in _INTS])


def _report_sql(columns: dict[str, str]) -> str:
    parts = [
        f"select '{c}' as \"column\", cast(min({e}) as bigint) as lo, cast(max({e}) as bigint) as hi from lineitem"
        for c, e in columns.items()
    ]
    return " union all ".join(parts)


@register(
    "c4_type_report",
    f"""with seen as ({_report_sql({
        "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber",
        "deep": "l_orderkey * 3000000000", "small": "l_partkey % 200 - 100", "empty": "cast(null as bigint)"})})
       select "column", 'string' as initial_dtype,
         case when lo is null then 'int' when lo >= -128 and hi <= 127 then 'tinyint'
              when lo >= -32768 and hi <= 32767 then 'smallint'
              when lo >= -2147483648 and hi <= 2147483647 then 'int' else 'bigint' end as final_dtype,
         lo as "min", hi as "max" from seen""",
)
def c4(spark, sf):
    raw = _int_text(spark, sf)
    return clean.type_report(raw, [], [], clean.integer_plan(raw, _INTS))


@register(
    "c4_type_counts",
    f"""with seen as ({_report_sql({
        "l_orderkey": "l_orderkey", "l_partkey": "l_partkey", "l_suppkey": "l_suppkey", "l_linenumber": "l_linenumber",
        "deep": "l_orderkey * 3000000000", "small": "l_partkey % 200 - 100", "empty": "cast(null as bigint)"})}),
       typed as (select case when lo is null then 'int' when lo >= -128 and hi <= 127 then 'tinyint'
              when lo >= -32768 and hi <= 32767 then 'smallint'
              when lo >= -2147483648 and hi <= 2147483647 then 'int' else 'bigint' end as final_dtype from seen)
       select final_dtype, count(*) as columns from typed group by 1""",
)
def c4_counts(spark, sf):
    raw = _int_text(spark, sf)
    return clean.type_counts(clean.type_report(raw, [], [], clean.integer_plan(raw, _INTS)))


@register(
    "c5_parse_time",
    """select event_id, case when event_id % 10 = 0 then null else date_trunc('second', ts) end as date_time from events""",
)
def c5(spark, sf):
    """Times formatted as text and parsed back; unreadable text becomes NULL."""
    text = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 10 == 0, "31/12/2019")
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .alias("date_time"),
    )
    return clean.parse_time(text)


def nearest(column: str, p: float) -> str:
    """SQL of the order statistic nearest to p (n - 1)."""
    return f"(list({column} order by {column}) filter (where {column} is not null))[1 + cast(round({p!r}::double * (count({column}) - 1)) as int)]"


CLIP_BOUNDS_SQL = (
    f"select {nearest('price_usd', 0.001)} as p_lo, {nearest('price_usd', 0.999)} as p_hi, "
    f"{nearest('srch_booking_window', 0.999)} as w_hi, {nearest('srch_length_of_stay', 0.999)} as s_hi "
    "from imp where split = 'train'"
)
CLIP_COLUMNS = {
    "price_usd": "least(greatest(price_usd, p_lo), p_hi)",
    "srch_booking_window": "least(greatest(srch_booking_window, 0), w_hi)",
    "srch_length_of_stay": "least(greatest(srch_length_of_stay, 1), s_hi)",
}


@register(
    "c6_clip_outliers",
    with_impressions(
        f"""select {KEY_SQL}, {r(CLIP_COLUMNS['price_usd'], 'price_usd')},
            {CLIP_COLUMNS['srch_booking_window']} as srch_booking_window,
            {CLIP_COLUMNS['srch_length_of_stay']} as srch_length_of_stay from imp, b""",
        b=CLIP_BOUNDS_SQL,
    ),
)
def c6(spark, sf):
    """Bounds learnt on the train split, applied to all rows."""
    from rankloom.plans.feature_tables import clip_specs

    df = impressions(spark, sf)
    bounds = clean.fit_clip_bounds(df.filter(F.col("split") == "train"), clip_specs(ROLES))
    return clean.apply_clip(df, bounds).select(*KEYS, "price_usd", "srch_booking_window", "srch_length_of_stay")


@register(
    "c6_clip_linear_quantile",
    with_impressions(
        f"select {KEY_SQL}, {r('case when orig_destination_distance is not null then least(greatest(orig_destination_distance, lo), hi) end', 'orig_destination_distance')} from imp, b",
        b="select quantile_cont(orig_destination_distance, 0.01) as lo, quantile_cont(orig_destination_distance, 0.99) as hi from imp",
    ),
)
def c6_linear(spark, sf):
    """Interpolated bounds on a column with missing values, which stay missing."""
    df = impressions(spark, sf)
    bounds = clean.fit_clip_bounds(df, {"orig_destination_distance": (("q", 0.01), ("q", 0.99))}, "linear")
    return clean.apply_clip(df, bounds).select(*KEYS, "orig_destination_distance")


_RAW = [
    "srch_id", "prop_id", "srch_destination_id", "position", "tiebreak_ts", "price_usd", "prop_review_score",
    "prop_location_score2", "visitor_hist_starrating", "visitor_hist_adr_usd", "srch_query_affinity_score",
    "orig_destination_distance", "comp1_rate", "comp1_rate_percent_diff", "comp2_rate_percent_diff",
]


@register(
    "c7_drop_sparse_columns",
    with_impressions(
        f"""select srch_id, prop_id, srch_destination_id, position, tiebreak_ts,
        {rs('price_usd', 'prop_review_score', 'prop_location_score2', 'visitor_hist_starrating', 'visitor_hist_adr_usd', 'srch_query_affinity_score')},
        comp1_rate from imp"""
    ),
)
def c7(spark, sf):
    """Columns with more than 30 % missing go, except the three that are always kept."""
    return clean.drop_sparse_columns(impressions(spark, sf).select(*_RAW), 0.3)


@register(
    "c8_align_types",
    with_impressions(
        f"""select srch_id, prop_id, {r('cast(price_usd as float)', 'price_usd')}, cast(position as bigint) as position from imp where split = 'train'
        union all
        select srch_id, prop_id, {r('cast(price_usd as float)', 'price_usd')}, cast(position as bigint) as position from imp where split = 'test'"""
    ),
)
def c8(spark, sf):
    """The second table takes the types of the first before the union."""
    df = impressions(spark, sf).select("srch_id", "prop_id", "price_usd", "position", "split")
    first = df.filter("split = 'train'").select(
        "srch_id", "prop_id", F.col("price_usd").cast("float"), F.col("position").cast("bigint")
    )
    second = df.filter("split = 'test'").drop("split")
    return first.unionByName(clean.align_types(second, first))


@register(
    "c9_feature_columns",
    with_impressions(
        f"""select srch_destination_id, random_bool, {r('price_usd')}, prop_starrating,
        cast(family as int) as family_trip_flag, tiebreak_ts
        from (select *, srch_children_count > 0 as family from imp)"""
    ),
)
def c9(spark, sf):
    df = impressions(spark, sf).withColumns(
        {
            "family_trip_flag": features.party_features(ROLES)["family_trip_flag"],
            "relevance": features.label_features(impressions(spark, sf), ROLES)["relevance"],
            "prop_booking_count": F.lit(1),
            "any_click_count": F.lit(1),
        }
    )
    wide = df.select(
        "srch_id", "prop_id", "position", "date_time", "click_bool", "booking_bool", "relevance", "srch_destination_id",
        "random_bool", "price_usd", "prop_starrating", "family_trip_flag", "tiebreak_ts", "prop_booking_count",
        "any_click_count",
    )
    return wide.select(*clean.feature_columns(wide))


@register("c10_drop_bias_columns", with_impressions(f"select srch_destination_id, tiebreak_ts, {r('price_usd')} from imp"))
def c10(spark, sf):
    df = impressions(spark, sf).select(
        "srch_id", "prop_id", "position", "random_bool", "srch_destination_id", "tiebreak_ts", "price_usd"
    )
    return clean.drop_bias_columns(df)


@register(
    "c11_category_codes",
    with_impressions(
        f"""select {KEY_SQL}, coalesce(cast(prop_starrating as int), -1) as prop_starrating,
        coalesce(cast(visitor_location_country_id as int), -1) as visitor_location_country_id,
        coalesce(cast(comp1_inv as int), -1) as comp1_inv from imp"""
    ),
)
def c11(spark, sf):
    df = impressions(spark, sf).select(*KEYS, "prop_starrating", "visitor_location_country_id", "comp1_inv")
    return clean.encode_categories(df, [*clean.CATEGORY_COLUMNS, "comp1_inv"])


@register(
    "c12_u1_union_common",
    with_impressions(f"select srch_id, prop_id, {r('price_usd')}, split from imp"),
)
def c12(spark, sf):
    """Train has a label column that test lacks; the union keeps what both have."""
    df = impressions(spark, sf).select("srch_id", "prop_id", "price_usd", "split", "click_bool")
    return clean.union_common(df.filter("split = 'train'"), df.filter("split = 'test'").drop("click_bool"))


# --- the raw-to-typed job ----------------------------------------------------------

_X1_TYPES = prepare.RawTypes(
    floats=("price_usd", "prop_review_score", "prop_location_score2"),
    integers=("srch_id", "prop_id", "srch_destination_id", "position", "prop_starrating", "comp1_rate"),
    flags=("promotion_flag", "click_bool", "booking_bool"),
)
_X1_COLUMNS = [*_X1_TYPES.integers, *_X1_TYPES.floats, *_X1_TYPES.flags, "date_time"]


@register(
    "x1_csv_to_typed_parquet",
    with_impressions(
        f"""select {', '.join(f'cast({c} as bigint) as {c}' for c in (*_X1_TYPES.integers, *_X1_TYPES.flags))},
        {', '.join(r(f'cast({c} as float)', c) for c in _X1_TYPES.floats)}, date_time from imp"""
    ),
)
def x1(spark, sf):
    """Impressions as raw CSV text with NULL tokens, typed and written as Parquet."""
    text = impressions(spark, sf).select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")).alias(c) for c in _X1_COLUMNS[:-1]],
        F.date_format("date_time", "yyyy-MM-dd HH:mm:ss").alias("date_time"),
    )
    source, target = scratch(spark, "raw"), scratch(spark, "typed")
    tables.write_csv(text, source)
    prepare.csv_to_parquet(spark, source, target, _X1_TYPES, _X1_COLUMNS)
    typed = tables.read_parquet(spark, target)
    whole = [*_X1_TYPES.integers, *_X1_TYPES.flags]
    return typed.withColumns({c: F.col(c).cast("bigint") for c in whole})


# --- trials as JSON ------------------------------------------------------------------

# Score formulas that play the part of trials: quality is measured on the whole tables.
TRIAL_SCORES = (
    "-1.0e0 * price_usd",
    "price_usd",
    "prop_starrating * 1.0e0",
    "prop_location_score1",
    "prop_starrating - price_usd / 20000.0e0",
    "prop_location_score1 - price_usd / 50000.0e0",
    "position * -1.0e0",
    "position * 1.0e0",
    "prop_log_historical_price",
    "promotion_flag + prop_location_score1",
    "promotion_flag * 2.0e0 - prop_starrating",
    "srch_room_count * prop_location_score1 - position",
)


def trial_table(spark, sf):
    """One row per score formula: NDCG@5 on train and test rows and their gap. All formulas
    are measured in one pass over the rows."""
    df = impressions(spark, sf).withColumn("relevance", features.graded_relevance("click_bool", "booking_bool"))
    entries = [
        F.struct(F.lit(i).alias("trial"), F.expr(s).cast("double").alias("score")) for i, s in enumerate(TRIAL_SCORES)
    ]
    needed = sorted({f for s in TRIAL_SCORES for f in re.findall(r"[a-z]\w+", s)} & set(df.columns))
    df, _ = dealt(df.select("srch_id", "split", "relevance", *needed), ["split", "srch_id"])
    tall = df.select("srch_id", "split", "relevance", F.explode(F.array(*entries)).alias("_t")).select(
        "srch_id", "split", "relevance", "_t.trial", "_t.score"
    )
    means = metrics.mean_ndcg(tall, "srch_id", "relevance", "score", by=["trial", "split"], deal=False)
    wide = means.groupBy("trial").agg(
        F.max(F.when(F.col("split") == "test", F.col("ndcg"))).alias("val_ndcg"),
        F.max(F.when(F.col("split") == "train", F.col("ndcg"))).alias("train_ndcg"),
    )
    return wide.select(
        "trial",
        "val_ndcg",
        "train_ndcg",
        (F.col("train_ndcg") - F.col("val_ndcg")).alias("gap"),
        (F.lit(100) + F.col("trial")).cast("int").alias("best_iteration"),
        F.when(F.col("trial") % 2 == 0, "gbdt").otherwise("dart").alias("boosting_type"),
        F.create_map(F.lit("formula"), F.concat(F.lit("score_"), F.col("trial").cast("string"))).alias("params"),
    )
