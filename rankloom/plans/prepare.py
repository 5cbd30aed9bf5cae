"""Raw CSV to typed Parquet."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rankloom.operators import clean
from rankloom.sources import tables


@dataclass(frozen=True)
class RawTypes:
    """Which columns are floats, whole numbers and 0/1 flags, and the time column."""

    floats: tuple[str, ...]
    integers: tuple[str, ...]
    flags: tuple[str, ...]
    time: str = "date_time"


_COMP = range(1, 9)

# Columns of the raw impression files.
_FLOATS = (
    "visitor_hist_starrating",
    "visitor_hist_adr_usd",
    "prop_review_score",
    "prop_location_score1",
    "prop_location_score2",
    "prop_log_historical_price",
    "price_usd",
    "srch_query_affinity_score",
    "orig_destination_distance",
    *[f"comp{i}_rate_percent_diff" for i in _COMP],
)
_INTEGERS = (
    "srch_id",
    "site_id",
    "visitor_location_country_id",
    "prop_country_id",
    "prop_id",
    "prop_starrating",
    "srch_destination_id",
    "srch_length_of_stay",
    "srch_booking_window",
    "srch_adults_count",
    "srch_children_count",
    "srch_room_count",
    *[f"comp{i}_rate" for i in _COMP],
    *[f"comp{i}_inv" for i in _COMP],
)
_FLAGS = ("prop_brand_bool", "promotion_flag", "srch_saturday_night_bool", "random_bool")

TRAIN_TYPES = RawTypes(
    floats=(*_FLOATS, "gross_bookings_usd"),
    integers=(*_INTEGERS, "position"),
    flags=(*_FLAGS, "click_bool", "booking_bool"),
)
TEST_TYPES = RawTypes(floats=_FLOATS, integers=_INTEGERS, flags=_FLAGS)


def type_table(raw: DataFrame, types: RawTypes, token: str = "NULL") -> tuple[DataFrame, DataFrame]:
    """(typed table, type report) of a table of text columns."""
    cleaned = clean.null_tokens(raw, token)
    plan = clean.integer_plan(cleaned, types.integers)
    report = clean.type_report(cleaned, types.floats, types.flags, plan)
    typed = clean.lenient_cast(cleaned, types.floats, types.flags)
    typed = clean.narrow_integers(typed, types.integers, plan)
    if types.time in typed.columns and dict(typed.dtypes)[types.time] == "string":
        typed = clean.parse_time(typed, types.time)
    return typed, report


def csv_to_parquet(
    spark: SparkSession, source: str, target: str, types: RawTypes = TRAIN_TYPES, columns: list[str] | None = None
) -> DataFrame:
    """Read raw CSV as text, clean and type it, write Parquet; returns the type report.

    Pass the header names as ``columns`` to skip reading the header by inference.
    """
    if columns is None:
        columns = spark.read.option("header", True).csv(source).columns  # header only
    raw = tables.read_csv(spark, source, columns=columns)
    typed, report = type_table(raw, types)
    tables.write_parquet(typed, target)
    return report
