"""Shared pieces of the text operators: stored tables, skew-safe lookups, free column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key counts as hot when it holds at least one in so many of all rows; so at most so many
#: keys are hot, whatever the data are, and a table with one row per hot key may be broadcast.
HOT_SHARE = 1000

BATCH_ROWS = 1024
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a local one only in a single JVM."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="rankloom-llm-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage with columns and sizes that the planner knows; the files outlive any
    executor. The shared folder is the caller's to empty once the results are used.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession) -> None:
    """Let tasks exchange at most BATCH_ROWS rows at once with their Python workers, for the session.

    The operators work through 256 texts at a time; Spark's 10,000 rows a batch are tens of MB of text that are held
    outside the heap, on both sides, once for each task of an executor. A smaller setting is kept.
    """
    rows = int(spark.conf.get(_BATCH))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def free_name(taken: Sequence[str], wish: str) -> str:
    """``wish``, with underscores put before it until no column of that name (in any case) is there."""
    names = {c.lower() for c in taken}
    while wish.lower() in names:
        wish = "_" + wish
    return wish


def text_of(column: str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per ``key``), safe for hot keys.

    ``weight``: the column of ``groups`` with the number of rows of a key, ``total``: all rows.
    Keys with at least total / HOT_SHARE rows (no more than HOT_SHARE keys can be) are joined by
    broadcast where their rows are; the others meet in a sort-merge join, whose largest key then
    has under a thousandth of all rows. ``rows`` is read twice, so it should be a stored table.
    """
    hot = groups.filter(F.col(weight) * HOT_SHARE >= F.lit(total))
    rest = groups.filter(F.col(weight) * HOT_SHARE < F.lit(total))
    return (
        rows.join(F.broadcast(hot), key)
        .unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key))
    )


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], **sums: Column) -> DataFrame:
    """``df`` with running totals (own row included) of ``sums`` in every group, in ``order``.

    A group may hold any share of the rows: rows are cut into ranges by (keys, order) and written
    with the number of their range, totals run inside a range, and a group that goes on in a later
    range gets what the earlier ones hold. At most two groups a range do, so that table has no more
    than twice as many rows as there are ranges and is broadcast. Keys must not be null. Rows that ``order``
    does not tell apart share a range and come in any order.
    """
    keys = list(keys)
    part = free_name(df.columns, "_range")
    cut = stored(
        df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn(part, F.spark_partition_id()), "ranges"
    )
    local = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.withColumns({n: F.sum(c).over(local) for n, c in sums.items()})
    held = stored(cut.groupBy(*keys, part).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "range-sums")
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("_ranges", F.count(F.lit(1)).over(whole)).filter("_ranges > 1").select(
        *[F.col(k).alias(f"_of_{k}") for k in keys], F.col(part).alias("_of_range"),
        *[F.sum(n).over(earlier).alias(f"_before_{n}") for n in sums],
    )
    on = (out[part] == F.col("_of_range")) & _all(out[k] == F.col(f"_of_{k}") for k in keys)
    found = out.join(F.broadcast(before), on, "left")
    return found.withColumns({n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in sums}).select(
        *df.columns, *sums
    )


def _all(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
