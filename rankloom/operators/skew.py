"""Keeping work spread when one key holds a large share of the rows.

A "hot" key is one with more than ``hot_rows`` rows. At most N / hot_rows keys
can be hot. A table with one row per hot key stays on the executors and is broadcast
when it has been counted and is small; everything that has one row per *ordinary* key is
left to Spark's own size check.

* ``hot_keys``   - which keys are hot (one column-pruned, map-side combined count)
* ``grouped``    - run window-style work per key: ordinary keys by one hash
                   exchange, hot keys without ever putting a group in one task
* ``attach``     - join of per-key statistics to rows: broadcast, plain or salted
* ``prefix_sum`` - exact running total inside groups of any size
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions.columns import same_keys

DEFAULT_HOT_ROWS = 1_000_000
BROADCAST_VALUES = 4_000_000  # rows x columns, about 32 MB
TASK_ROWS = 100_000  # rows a task sorts or counts at once


def hot_rows(spark: SparkSession) -> int:
    """Rows above which one key counts as hot (``spark.rankloom.hotRows``)."""
    return int(spark.conf.get("spark.rankloom.hotRows", str(DEFAULT_HOT_ROWS)))


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names, else a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="rankloom-")


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives the loss of executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def dealt_by(df: DataFrame) -> tuple[list[str], int] | None:
    """(columns, tasks) if the rows of ``df`` are dealt by the hash of these columns: by ``dealt``, or ``stored`` so."""
    plan = node = df._jdf.queryExecution().sparkPlan()
    while node.children().size() == 1 and not node.nodeName().startswith("Exchange"):
        node = node.children().head()
    if node.children().size() > 1:
        return None
    by = plan.outputPartitioning()
    if by.getClass().getSimpleName() != "HashPartitioning":
        return None
    listed = lambda x: [x.apply(i) for i in range(x.size())]
    names = {a.exprId().id(): a.name() for a in listed(plan.output())}
    keys = [names.get(e.exprId().id()) if e.getClass().getSimpleName() == "AttributeReference" else None for e in listed(by.expressions())]
    alone = all(k and df.columns.count(k) == 1 for k in keys)
    return (keys, by.numPartitions()) if alone else None


def release(spark: SparkSession) -> None:
    """Drop the shuffle files that nothing refers to any more: Spark's cleaner does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """``materialise`` for tables as long as the rows: Parquet in the shared folder, so that columns are
    compressed on disk and later passes read only those they need. Columns are referred to by name.

    Rows that ``dealt`` has dealt by key stay together: they are written in buckets, one a task, and
    later work by that key shuffles nothing. The shuffle files behind the table are dropped.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(spark))
    name = uuid.uuid4().hex
    path, by = f"{context.getCheckpointDir()}/stored-{name}", dealt_by(df)
    writer = df.write.option("compression", "zstd")
    if by is None:
        writer.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        keys, tasks = by
        writer.format("parquet").option("path", path).bucketBy(tasks, *keys).sortBy(*keys).saveAsTable(f"stored_{name}")
        out = spark.table(f"stored_{name}")
        spark.sql(f"drop table stored_{name}")  # the name only: the files are the reader's
    out.stored_at = path
    release(spark)
    return out


def discard(table: DataFrame | None) -> None:
    """Delete the files of a ``stored`` table that nothing reads any more."""
    if table is not None:
        jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(
    df: DataFrame, keys: Sequence[str], limit: int | None = None, counted: str | None = None
) -> DataFrame | None:
    """One row per hot key with its row count ``_n``, or None when no key is hot.

    ``counted`` names a column of counts when ``df`` already has one row per key. Every key
    over the limit is returned; the table is checkpointed, not collected.
    """
    limit = limit or hot_rows(df.sparkSession)
    if counted:
        counts = df.select(*keys, F.col(counted).cast("bigint").alias("_n"))
    else:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = materialise(counts.filter(F.col("_n") > limit))  # the rows are counted once
    return None if found.isEmpty() else found


def dealt(
    df: DataFrame, keys: Sequence[str], hot: DataFrame | None | str = "detect", source: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(rows, hot keys). Without a hot key the rows are dealt by key over so many tasks that one holds
    about TASK_ROWS of them, whatever the size of the table; with one they are left as they are.

    Windows and aggregations by these keys then need no other exchange, and their sorts fit in memory.
    ``source`` has the same rows in an earlier, cheaper state and is counted in place of ``df``.
    """
    counted = df if source is None else source
    if isinstance(hot, str):
        sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n").alias("most"), F.sum("_n").alias("n"))
        found = sizes.first()
        rows = found["n"] or 0
        hot = hot_keys(counted, keys) if (found["most"] or 0) > hot_rows(df.sparkSession) else None
    elif hot is None:
        rows = counted.count()
    if hot is not None:
        return df, hot
    tasks, by = max(ceil(rows / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), dealt_by(df)
    if by and set(by[0]) <= set(keys) and by[1] >= tasks:
        return df, None  # they are already
    return df.repartition(tasks, *keys), None


def _renamed(hot: DataFrame, keys: Sequence[str], prefix: str = "_hot_") -> DataFrame:
    return hot.select(*[F.col(k).alias(prefix + k) for k in keys])


def split_hot(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys)."""
    small = sent_if_small(_renamed(hot, keys))
    on = same_keys(df, small, keys, "_hot_")
    return df.join(small, on, "left_anti"), df.join(small, on, "left_semi")


class Groups:
    """Per-key work on rows whose keys are all ordinary, or all hot."""

    def __init__(self, keys: Sequence[str], spread: bool = False):
        self.keys = list(keys)
        self.spread = spread

    def attach(self, df: DataFrame, **aggs: Column) -> DataFrame:
        """Add group aggregates to every row."""
        if not self.spread:
            w = Window.partitionBy(*self.keys)
            return df.withColumns({n: a.over(w) for n, a in aggs.items()})
        stats = df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()])
        stats = sent_if_small(materialise(stats.withColumnsRenamed({k: "_stat_" + k for k in self.keys})))
        joined = df.join(stats, same_keys(df, stats, self.keys, "_stat_"), "left")
        return joined.drop(*["_stat_" + k for k in self.keys])

    def ordinal(self, df: DataFrame, **orders: Sequence[Column]) -> DataFrame:
        """Add 1-based positions; each order has to tell the rows of a group apart."""
        if not self.spread:
            return df.withColumns(
                {
                    n: F.row_number().over(Window.partitionBy(*self.keys).orderBy(*o)).cast("bigint")
                    for n, o in orders.items()
                }
            )
        for name, order in orders.items():
            df = _place_by_range(df, self.keys, order, name)
        return df


def grouped(
    df: DataFrame,
    keys: Sequence[str],
    build: Callable[[DataFrame, Groups], DataFrame],
    hot: DataFrame | None | str = "detect",
) -> DataFrame:
    """Apply ``build(rows, groups)`` so that no group has to fit in one task.

    With no hot key this is one plan over one hash exchange on the keys. With hot
    keys, their rows go through the spread variant and are united with the rest.
    Pass ``hot`` when the hot keys of the table are already known; the rows are then read several
    times if there are any, and should be ``stored``.
    """
    if isinstance(hot, str):
        df, hot = dealt(df, keys)
        df = df if hot is None else stored(df)
    if hot is None:
        return build(df, Groups(keys))
    cold_rows, hot_part = split_hot(df, keys, hot)
    cold_rows, _ = dealt(cold_rows, keys, None)
    return build(cold_rows, Groups(keys)).unionByName(build(hot_part, Groups(keys, spread=True)))


def is_small(settled: DataFrame) -> bool:
    """Whether a materialised table has few enough values to be sent to every executor."""
    most = BROADCAST_VALUES // max(1, len(settled.columns))
    return settled.limit(most + 1).count() <= most


def sent_if_small(settled: DataFrame) -> DataFrame:
    """With a broadcast hint if it is small; else the join is Spark's choice, which splits skewed sides."""
    return F.broadcast(settled) if is_small(settled) else settled


def attach(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    size: str | None = None,
    salt_by: Sequence[str] | None = None,
    how: str = "left",
    limit: int | None = None,
    settle: bool = True,
) -> DataFrame:
    """Join per-key statistics (one row per key) to rows.

    The statistics are materialised first - they are far smaller than the rows - so that
    the join can be chosen by what they turned out to be:

    * at most BROADCAST_VALUES values: broadcast, the rows are not shuffled at all;
    * no key with more than ``limit`` rows: ordinary join on the keys;
    * otherwise each hot key gets 1 + n / limit copies of its statistics and its rows pick
      one by the hash of ``salt_by`` (all columns by default), so they are spread over
      that many tasks.

    ``size`` is the statistics column with (at least) the number of ``rows`` behind a
    key; it is dropped. Without it the rows are counted per key. ``settle=False`` is for
    statistics that are materialised already.
    """
    keys = list(keys)
    if settle:
        stats = materialise(stats)
    if is_small(stats):
        return rows.join(F.broadcast(stats.drop(size) if size else stats), keys, how)
    limit = limit or hot_rows(rows.sparkSession)
    if size:
        sizes = stats.select(*keys, F.col(size).alias("_n"))
        hot = hot_keys(sizes, keys, limit, counted="_n")
        stats = stats.drop(size)
    else:
        hot = hot_keys(rows, keys, limit)
    if hot is None:
        return rows.join(stats, keys, how)
    return _salted_join(rows, stats, keys, hot, limit, salt_by, how)


def _salted_join(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    hot: DataFrame,
    limit: int,
    salt_by: Sequence[str] | None,
    how: str,
) -> DataFrame:
    pieces = (F.col("_n") / F.lit(limit)).cast("int") + F.lit(1)
    hot = sent_if_small(hot.select(*[F.col(k).alias("_hot_" + k) for k in keys], pieces.alias("_pieces")))
    helpers = ["_pieces", *["_hot_" + k for k in keys]]
    columns = [F.col(f"`{c}`") for c in (salt_by or rows.columns)]
    salt = F.when(F.col("_pieces").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(*columns), F.col("_pieces").cast("bigint")).cast("int")
    )
    # a hot NULL key is salted like any other; it simply matches nothing
    left = rows.join(hot, same_keys(rows, hot, keys, "_hot_"), "left").withColumn("_salt", salt).drop(*helpers)
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - F.lit(1))
    right = (
        stats.join(hot, same_keys(stats, hot, keys, "_hot_"), "left")
        .withColumn("_salt", F.explode(copies))
        .drop(*helpers)
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def _place_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1-based place in the group by a range sort over (keys, order).

    The rows are shuffled once and stored with the number of their range and their place in it, about
    TASK_ROWS in a range; what follows reads them where they are. The table of first places has at most
    (#ranges + #groups) rows.
    """
    keys = list(keys)
    by = [*[F.col(k) for k in keys], *order]
    ranges = max(ceil(df.count() / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism)
    in_order = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its task
    cut = stored(in_order.withColumns({"_part": F.spark_partition_id(), "_at": at}))
    held = cut.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(
        *[F.col(k).alias("_off_" + k) for k in keys],
        F.col("_part").alias("_off__part"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + F.lit(1)).alias("_offset"),
    )
    offsets = materialise(offsets)
    joined = cut.join(F.broadcast(offsets), same_keys(cut, offsets, [*keys, "_part"], "_off_"), "inner")
    placed = joined.withColumn(out, F.col("_at") + F.col("_offset"))
    return placed.drop("_part", "_at", "_offset", *["_off_" + k for k in keys], "_off__part")


def _prefix_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: Column, before: str, total: str | None
) -> DataFrame:
    """Exclusive running total by a range sort over (keys, order).

    The ranges are materialised once with their partition number, so the sums per
    range and the rows always see the same cut. A group spans neighbouring ranges
    only: the table of sums has at most (#ranges + #groups) rows.
    """
    keys = list(keys)
    df = stored(
        df.withColumn("_weight", weight)
        .repartitionByRange(*[F.col(k) for k in keys], *order)
        .withColumn("_part", F.spark_partition_id())
    )
    sums = df.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_sum"))
    w = Window.partitionBy(*keys)
    offsets = sums.select(
        *[F.col(k).alias("_off_" + k) for k in keys],
        F.col("_part").alias("_off__part"),
        F.coalesce(
            F.sum("_sum").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ).alias("_offset"),
        F.sum("_sum").over(w).alias("_total"),
    )
    joined = df.join(F.broadcast(offsets), same_keys(df, offsets, [*keys, "_part"], "_off_"), "inner")
    local = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = {before: F.coalesce(F.sum("_weight").over(local), F.lit(0)) + F.col("_offset")}
    if total:
        out[total] = F.col("_total")
    return joined.withColumns(out).drop(
        "_weight", "_part", "_offset", "_total", *["_off_" + k for k in keys], "_off__part"
    )


def prefix_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    weight: Column,
    before: str = "before",
    total: str = "total",
    few_large_groups: bool | None = None,
    hot: DataFrame | None | str = "detect",
) -> DataFrame:
    """Add the sum of ``weight`` over earlier rows of the group, and over the group.

    ``few_large_groups`` True means every group may be large and there are few of
    them (one per column, say); False means no group is; None decides per key, by
    ``hot``. The order has to tell the rows of a group apart.
    """

    def by_window(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(*keys)
        upto = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return part.withColumns(
            {before: F.coalesce(F.sum(weight).over(upto), F.lit(0)), total: F.sum(weight).over(w)}
        )

    if few_large_groups is None:
        if isinstance(hot, str):
            hot = hot_keys(df, keys)
        if hot is None:
            return by_window(df)
        cold_rows, hot_part = split_hot(df, keys, hot)
        return by_window(cold_rows).unionByName(
            _prefix_by_range(hot_part, keys, order, weight, before, total)
        )
    if few_large_groups:
        return _prefix_by_range(df, keys, order, weight, before, total)
    return by_window(df)


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], **sums: Column) -> DataFrame:
    """``df`` with totals of ``sums`` up to and with each row of its group, in one range sort.

    Groups may be of any size and number: only those that go on from one range into the next get an
    offset, and these are at most two a range, so the offsets are broadcast. Keys are not null.
    """
    keys = list(keys)
    cut = stored(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    local = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    held = materialise(cut.groupBy(*keys, "_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()]))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        held.withColumn("_ranges", F.count(F.lit(1)).over(group)).filter("_ranges > 1")
        .select(*[F.col(k).alias(f"_off_{k}") for k in keys], F.col("_part").alias("_off__part"), *[F.sum(n).over(earlier).alias(f"_before_{n}") for n in sums])
    )
    out = cut.withColumns({n: F.sum(c).over(local) for n, c in sums.items()})
    out = out.join(F.broadcast(offsets), same_keys(out, offsets, [*keys, "_part"], "_off_"), "left")
    out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_before_{n}"), F.lit(0)) for n in sums}).select(*df.columns, *sums)
    out.stored_at = cut.stored_at  # the files it reads, for ``discard``
    return out
