"""Row-level building blocks. All of them treat NULL as "missing, stays missing"."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6  # fixed value: added to a standard deviation before dividing


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: str | Column) -> Column:
    return col(c).cast("double")


def lit_or_col(v) -> Column | None:
    if v is None or isinstance(v, Column):
        return v
    return F.lit(v)


def clip(c: str | Column, low=None, high=None) -> Column:
    """Clamp to [low, high]; a NULL value stays NULL, a None bound is open.

    ``greatest``/``least`` skip NULLs, so without the guard a missing value would
    turn into a bound.
    """
    x = col(c)
    out = x
    if high is not None:
        out = F.least(lit_or_col(high), out)
    if low is not None:
        out = F.greatest(lit_or_col(low), out)
    return F.when(x.isNotNull(), out)


def zscore(x: Column, mean: Column, std: Column, eps: float = EPS) -> Column:
    """(x - mean) / (std + eps); NULL where the group has one row (std is NULL)."""
    return (x - mean) / (std + F.lit(eps))


def flag(condition: Column) -> Column:
    """0/1 integer; NULL when the condition is NULL."""
    return condition.cast("int")


def missing(c: str | Column) -> Column:
    return col(c).isNull().cast("int")


def count_equal(columns: Sequence[str], value) -> Column:
    """How many of the columns hold ``value`` in this row; NULL counts as no."""
    return reduce(add, [F.coalesce(flag(F.col(c) == F.lit(value)), F.lit(0)) for c in columns])


def row_mean(columns: Sequence[str]) -> Column:
    """Mean over the columns of one row, NULLs skipped; NULL when all are NULL."""
    total = reduce(add, [F.coalesce(dbl(c), F.lit(0.0)) for c in columns])
    present = reduce(add, [F.col(c).isNotNull().cast("int") for c in columns])
    return F.try_divide(total, present)


def smoothed_rate(count: Column, impressions: Column, prior: Column, m: float) -> Column:
    """(count + m * prior) / (impressions + m)."""
    return (count + F.lit(float(m)) * prior) / (impressions + F.lit(float(m)))


def graded_relevance(click: str | Column, book: str | Column, book_gain: int = 5) -> Column:
    """book_gain for a booking, 1 for a click without booking, else 0."""
    b, c = col(book).cast("int"), col(click).cast("int")
    return b * F.lit(book_gain) + c * (F.lit(1) - b)


def first_match(rules: Iterable[tuple[Column, object]], default) -> Column:
    """Value of the first rule that holds, as in a chain of if / elif."""
    rules = list(rules)
    out = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, value in rules[1:]:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def iso_weekday(ts: str | Column) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return F.weekday(col(ts)) + F.lit(1)


def plus_days(ts: str | Column, days: str | Column) -> Column:
    return col(ts) + F.make_dt_interval(days=col(days).cast("int"))


def same_keys(left, right, keys: Sequence[str], prefix: str) -> Column:
    """NULL-safe equality of ``left.k`` and ``right.<prefix>k`` for all keys."""
    return reduce(and_, [left[k].eqNullSafe(right[prefix + k]) for k in keys])


def rounded(df, digits: int = 6):
    """Round every double/float column; used to compare engines, not in the operators."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`").cast("double"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
