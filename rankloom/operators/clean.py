"""Cleaning, typing and schema operators."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.columns import clip
from rankloom.operators.quantile import quantiles

# Ranges of the integer types, narrowest first.
INTEGER_RANGES = (
    ("tinyint", -128, 127),
    ("smallint", -32768, 32767),
    ("int", -2147483648, 2147483647),
    ("bigint", -9223372036854775808, 9223372036854775807),
)

# Never features / dropped before scoring / codes to treat as categories.
NEVER_FEATURES = (
    "click_bool",
    "booking_bool",
    "gross_bookings_usd",
    "relevance",
    "srch_id",
    "prop_id",
    "position",
    "date_time",
    "checkin_datetime",
    "prop_booking_count",
    "prop_click_count",
)
NEVER_FEATURE_SUFFIXES = ("_booking_count", "_click_count")
BIAS_COLUMNS = ("srch_id", "prop_id", "position", "random_bool")
LABEL_COLUMNS = ("date_time", "target", "click_bool", "booking_bool", "gross_bookings_usd")
KEEP_WHEN_SPARSE = ("visitor_hist_adr_usd", "visitor_hist_starrating", "srch_query_affinity_score")
CATEGORY_COLUMNS = (
    "site_id",
    "visitor_location_country_id",
    "prop_country_id",
    "srch_destination_id",
    "prop_starrating",
    "prop_brand_bool",
    "srch_adults_count",
    "srch_children_count",
    "srch_room_count",
    "srch_saturday_night_bool",
    "search_month",
    "search_day_of_week",
    "search_hour",
    "checkin_month",
    "checkin_day_of_week",
    "promotion_flag",
    "random_bool",
    "family_trip_flag",
    "cheapest_hotel_flag",
    "visitor_history_star_missing",
    "visitor_history_price_missing",
    "missing_star_rating_flag",
    "review_score_zero_flag",
    "review_score_missing_flag",
    "missing_historical_price_flag",
    "affinity_score_missing_flag",
    "distance_missing_flag",
    "location_score2_missing_flag",
)


def _present(df: DataFrame, names: Iterable[str], what: str) -> list[str]:
    names = list(names)
    absent = [n for n in names if n not in df.columns]
    if absent:
        warnings.warn(f"{what} columns not in the table, skipped: {absent}", stacklevel=3)
    return [n for n in names if n in df.columns]


def null_tokens(df: DataFrame, token: str = "NULL") -> DataFrame:
    """Turn the text ``NULL`` into a real NULL in every string column."""
    return df.withColumns({n: F.nullif(F.col(n), F.lit(token)) for n, t in df.dtypes if t == "string"})


def lenient_cast(df: DataFrame, floats: Sequence[str] = (), flags: Sequence[str] = ()) -> DataFrame:
    """Cast to float / tinyint; an unreadable value becomes NULL, an absent column is skipped."""
    casts = {n: F.col(n).try_cast("float") for n in _present(df, floats, "float")}
    casts |= {n: F.col(n).try_cast("tinyint") for n in _present(df, flags, "flag")}
    return df.withColumns(casts)


def integer_plan(df: DataFrame, columns: Sequence[str]) -> list[dict]:
    """Narrowest integer type per column, from one min/max pass over all of them.

    The result is one record per column (a fixed, small size), with the initial
    type, the final type and the range seen. An all-NULL column becomes ``int``.
    """
    columns = _present(df, columns, "integer")
    if not columns:
        return []
    types = dict(df.dtypes)
    whole = {c: F.col(c).try_cast("bigint") for c in columns}
    aggs = [f(whole[c]).alias(f"{c}__{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    seen = df.agg(*aggs).first()
    plan = []
    for c in columns:
        low, high = seen[f"{c}__min"], seen[f"{c}__max"]
        if low is None:
            final = "int"
        else:
            final = next(t for t, a, b in INTEGER_RANGES if a <= low and high <= b)
        plan.append({"column": c, "initial_dtype": types[c], "final_dtype": final, "min": low, "max": high})
    return plan


def narrow_integers(df: DataFrame, columns: Sequence[str], plan: list[dict] | None = None) -> DataFrame:
    """Cast each integer column to the narrowest type that holds its values."""
    plan = plan or integer_plan(df, columns)
    return df.withColumns({p["column"]: F.col(p["column"]).try_cast("bigint").try_cast(p["final_dtype"]) for p in plan})


def type_report(df: DataFrame, floats: Sequence[str], flags: Sequence[str], plan: list[dict]) -> DataFrame:
    """column, initial and final type, and the range for integer columns."""
    types = dict(df.dtypes)
    rows = [(c, types[c], "float", None, None) for c in floats if c in types]
    rows += [(c, types[c], "tinyint", None, None) for c in flags if c in types]
    rows += [(p["column"], p["initial_dtype"], p["final_dtype"], p["min"], p["max"]) for p in plan]
    schema = "`column` string, initial_dtype string, final_dtype string, `min` bigint, `max` bigint"
    return df.sparkSession.createDataFrame(rows, schema).orderBy("column")


def type_counts(report: DataFrame, which: str = "final_dtype") -> DataFrame:
    return (
        report.groupBy(which)
        .agg(F.count(F.lit(1)).alias("columns"))
        .orderBy(F.col("columns").desc(), which)
    )


def parse_time(df: DataFrame, column: str = "date_time", pattern: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Text to timestamp without zone; unreadable text becomes NULL."""
    return df.withColumn(column, F.try_to_timestamp(F.col(column), F.lit(pattern)).cast("timestamp_ntz"))


def fit_clip_bounds(
    df: DataFrame,
    specs: dict[str, tuple],
    method: str = "nearest",
) -> dict[str, tuple[float | None, float | None]]:
    """Bounds per column. A spec is (low, high); ("q", p) means the p-quantile.

    >>> fit_clip_bounds(df, {"price": (("q", .001), ("q", .999)), "stay": (1, ("q", .999))})
    """
    wanted: dict[str, list[float]] = {}
    for c, ends in specs.items():
        wanted[c] = [e[1] for e in ends if isinstance(e, tuple)]
    probs = sorted({p for ps in wanted.values() for p in ps})
    rows = quantiles(df, [c for c, ps in wanted.items() if ps], probs, method=method).collect()
    found = {r["variable"]: dict(zip(probs, r["quantiles"])) for r in rows}

    def end(c, e):
        return found.get(c, {}).get(e[1]) if isinstance(e, tuple) else e

    return {c: (end(c, low), end(c, high)) for c, (low, high) in specs.items()}


def apply_clip(df: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Clamp each column to its bounds, keeping its type; NULL stays NULL."""
    types = dict(df.dtypes)
    return df.withColumns(
        {c: clip(F.col(c), low, high).cast(types[c]) for c, (low, high) in bounds.items() if c in types}
    )


def drop_sparse_columns(
    df: DataFrame, threshold: float = 0.9, keep: Sequence[str] = KEEP_WHEN_SPARSE
) -> DataFrame:
    """Drop columns whose share of NULLs is above ``threshold``, except those in ``keep``."""
    share = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("int")).alias(c) for c in df.columns]).first()
    gone = [c for c in df.columns if c not in keep and share[c] is not None and share[c] > threshold]
    return df.drop(*gone)


def align_types(df: DataFrame, like: DataFrame) -> DataFrame:
    """Cast the columns that ``like`` also has to the types they have there."""
    target = {f.name: f.dataType for f in like.schema.fields}
    return df.select(
        *[
            F.col(f.name).cast(target[f.name]) if f.name in target and target[f.name] != f.dataType else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    have = set(right.columns)
    return [c for c in left.columns if c in have]


def union_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union over the columns both tables have, with the types of the first."""
    names = common_columns(left, right)
    return left.select(*names).unionByName(align_types(right.select(*names), left))


def feature_columns(
    df: DataFrame,
    drop: Sequence[str] = NEVER_FEATURES,
    drop_suffixes: Sequence[str] = NEVER_FEATURE_SUFFIXES,
) -> list[str]:
    return [c for c in df.columns if c not in drop and not c.endswith(tuple(drop_suffixes))]


def drop_bias_columns(df: DataFrame, names: Sequence[str] = BIAS_COLUMNS) -> DataFrame:
    return df.drop(*names)


def encode_categories(df: DataFrame, columns: Sequence[str] = CATEGORY_COLUMNS) -> DataFrame:
    """Category codes as int with -1 for missing; absent columns are left out."""
    have = set(df.columns)
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(-1)).cast("int") for c in columns if c in have}
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
