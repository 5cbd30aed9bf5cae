"""Name -> (Spark query, SQL text or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

_MODULES = ("tables", "profiles", "feature_sets", "group_stats", "encodings", "refreshed", "ranking", "models")


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; its doubles are rounded to 6 places like the SQL's."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = (run, sql)
        return fn

    return wrap


# Rounding for comparison. Engines add numbers up in different orders, so amounts are
# compared to 4 places and the rest to 6; the nudge keeps values that end exactly in half a
# unit (cents divided by 8, say) from falling on either side.
AMOUNTS = ("price", "ppn", "fee", "ump", "count_window", "mean", "std", "min", "max", "median", "low", "high", "adr")
NUDGE = 1.3e-8


def places(name: str) -> int:
    return 4 if any(a in name for a in AMOUNTS) else 6


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles (and turn -0.0 into 0.0) so engines can be compared."""
    out = []
    for n, t in df.dtypes:
        c = F.col(f"`{n}`")
        if t in ("double", "float"):
            unit = F.lit(10.0 ** places(n))
            c = (F.rint((c.cast("double") + F.lit(NUDGE)) * unit) / unit + F.lit(0.0)).alias(n)
        out.append(c)
    return df.select(*out)


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"rankloom.catalog.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: fn for n, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: sql for n, (_, sql) in QUERIES.items() if sql}
