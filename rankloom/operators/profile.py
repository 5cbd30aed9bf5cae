"""Profiling tables and the tables behind exploratory plots."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.clean import numeric_columns
from rankloom.operators.features import add_ordinal_ranks
from rankloom.operators.quantile import as_doubles, quantiles, stored_quantiles
from rankloom.operators.skew import BROADCAST_VALUES, attach, dealt, dealt_by, discard, is_small, running_totals, stored

PLANE_ROWS = 2_000  # rows whose ranks are multiplied at once: their planes stay in a core's cache
SUMMED = 8  # columns whose sums are one aggregation

# Probabilities of the numeric summary and of the quantile report.
SUMMARY_PROBS = {"q001": 0.001, "q01": 0.01, "q25": 0.25, "q75": 0.75, "q99": 0.99, "q999": 0.999}
REPORT_PROBS = {
    "q001": 0.001,
    "q01": 0.01,
    "q05": 0.05,
    "q25": 0.25,
    "median": 0.5,
    "q75": 0.75,
    "q95": 0.95,
    "q99": 0.99,
    "q999": 0.999,
}


def _tall(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One wide row with ``{column}__{field}`` to one row per column."""
    per_column = [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"`{c}__{f}`").alias(f) for f in fields]) for c in columns
    ]
    return row.select(F.explode(F.array(*per_column)).alias("_x")).select("_x.*")


def overview(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def missing_report(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """variable, missing_count, missing_fraction, most missing first; one pass."""
    aggs = []
    for c in df.columns:
        aggs += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"{c}__missing_count")]
    row = df.agg(F.count(F.lit(1)).alias("_n"), *aggs)
    per_column = [
        F.struct(F.lit(c).alias("variable"), F.col(f"`{c}__missing_count`").alias("missing_count"))
        for c in df.columns
    ]
    out = row.select("_n", F.explode(F.array(*per_column)).alias("_x")).select(
        "_x.*", F.try_divide(F.col("_x.missing_count"), F.col("_n")).alias("missing_fraction")
    )
    if only_missing:
        out = out.filter(F.col("missing_count") > 0)
    return out.orderBy(F.col("missing_fraction").desc(), "variable")


def numeric_summary(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "nearest", large: bool | None = None
) -> DataFrame:
    """Missing count/fraction, mean, std, min, quantiles, median and max per numeric column."""
    columns = list(columns or numeric_columns(df))
    # the median of an even number of values lies between two of them, hence its own rule
    probs = [*SUMMARY_PROBS.values(), (0.5, "linear")]
    if large is None:
        rows = as_doubles(df, columns)
        x = {c: F.col(f"c{k}") for k, c in enumerate(columns)}
        spread = stored_quantiles(rows, columns, probs, method)
    else:
        rows, x = df, {c: F.col(c).cast("double") for c in columns}
        spread = quantiles(df, columns, probs, method, large)
    fields = ["missing_count", "missing_fraction", "mean", "std", "min", "max"]

    def sums(own: Sequence[str]) -> DataFrame:
        aggs = []
        for c in own:
            missing = F.count(F.lit(1)) - F.count(x[c])
            aggs += [
                missing.alias(f"{c}__missing_count"),
                F.round(F.try_divide(missing, F.count(F.lit(1))), 6).alias(f"{c}__missing_fraction"),
                F.avg(x[c]).alias(f"{c}__mean"),
                F.stddev_samp(x[c]).alias(f"{c}__std"),
                F.min(x[c]).alias(f"{c}__min"),
                F.max(x[c]).alias(f"{c}__max"),
            ]
        return _tall(rows.agg(*aggs), own, fields)

    # few columns at once, as methods of hundreds of sums are too long to be compiled; stored rows are read by column
    step = SUMMED if large is None else len(columns)
    tall = reduce(DataFrame.unionByName, [sums(columns[at : at + step]) for at in range(0, len(columns), step)])
    both = tall.join(F.broadcast(spread), "variable", "left")  # one row per column
    at = {n: F.element_at("quantiles", i + 1).alias(n) for i, n in enumerate(SUMMARY_PROBS)}
    return both.select(
        "variable",
        "missing_count",
        "missing_fraction",
        "mean",
        "std",
        "min",
        at["q001"],
        at["q01"],
        at["q25"],
        F.element_at("quantiles", -1).alias("median"),
        at["q75"],
        at["q99"],
        at["q999"],
        "max",
    ).orderBy(F.col("missing_fraction").desc(), "variable")


def boolean_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count and share (of all rows) of 0 and of 1 per flag column."""
    columns = [c for c in columns if c in df.columns]
    aggs = []
    for c in columns:
        for v in (0, 1):
            hits = F.count_if(F.col(c) == v)
            aggs += [
                hits.alias(f"{c}__count_{v}"),
                F.round(F.try_divide(hits, F.count(F.lit(1))), 6).alias(f"{c}__fraction_{v}"),
            ]
    return _tall(df.agg(*aggs), columns, ["count_0", "fraction_0", "count_1", "fraction_1"])


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: count, mean, std, min, exact quartiles (linear) and max."""
    columns = list(columns or numeric_columns(df))
    x = {c: F.col(c).cast("double") for c in columns}
    aggs = [
        a.alias(f"{c}__{n}")
        for c in columns
        for n, a in (("count", F.count(x[c])), ("mean", F.avg(x[c])), ("std", F.stddev_samp(x[c])), ("min", F.min(x[c])), ("max", F.max(x[c])))
    ]
    spread = quantiles(df, columns, [0.25, 0.5, 0.75], "linear")
    both = _tall(df.agg(*aggs), columns, ["count", "mean", "std", "min", "max"]).join(F.broadcast(spread), "variable", "left")  # one row per column
    quartiles = [F.element_at("quantiles", i + 1).alias(n) for i, n in enumerate(("q25", "q50", "q75"))]
    return both.select("variable", "count", "mean", "std", "min", *quartiles, "max").orderBy("variable")


def quantile_report(
    df: DataFrame, columns: Sequence[str], method: str = "nearest", large: bool | None = None
) -> DataFrame:
    """One row per column: min, nine quantiles, max."""
    got = quantiles(df, columns, [0.0, *REPORT_PROBS.values(), 1.0], method, large)
    names = ["min", *REPORT_PROBS, "max"]
    return got.select("variable", *[F.element_at("quantiles", i + 1).alias(n) for i, n in enumerate(names)])


# --- histograms ------------------------------------------------------------------


def histogram(
    df: DataFrame, value: str | Column, bins: int, by: Sequence[str] = (), share: bool = False
) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed: bin, low, high, rows.

    With ``by`` the groups share the edges. ``share`` adds each bin's part of its group.
    """
    x = F.col(value) if isinstance(value, str) else value
    data = df.select(*by, x.cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    ends = data.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()
    lo, width = ends["lo"], (ends["hi"] - ends["lo"]) / F.lit(bins)
    at = F.when(width > 0, F.least(F.floor((F.col("_x") - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = data.groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    out = counted.select(
        *by,
        "bin",
        (lo + F.col("bin") * width).alias("low"),
        (lo + (F.col("bin") + F.lit(1)) * width).alias("high"),
        "rows",
    )
    if share:
        # at most ``bins`` rows per group here
        totals = counted.groupBy(*by).agg(F.sum("rows").alias("_all"))
        if by:
            out = out.join(F.broadcast(totals), list(by)).withColumn("share", F.col("rows") / F.col("_all"))
            out = out.drop("_all")
        else:
            out = out.withColumn("share", F.col("rows") / totals.scalar())
    return out


def log_histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = (), share: bool = False) -> DataFrame:
    """Histogram of log(1 + x); values at or below -1 have none and are left out."""
    return histogram(df, F.log1p(F.col(value).cast("double")), bins, by, share)


def shift_histogram(left: DataFrame, right: DataFrame, column: str, bins: int, log: bool = False) -> DataFrame:
    """Histogram of one column in two tables over shared edges, with shares."""
    both = left.select(column, F.lit("train").alias("split")).unionByName(
        right.select(column, F.lit("test").alias("split"))
    )
    return (log_histogram if log else histogram)(both, column, bins, ["split"], share=True)


# --- per query -----------------------------------------------------------------------


def query_sizes(df: DataFrame, query: str) -> DataFrame:
    """How many queries have each number of rows."""
    per = df.groupBy(query).agg(F.count(F.lit(1)).alias("query_size"))
    return per.groupBy("query_size").agg(F.count(F.lit(1)).alias("queries")).orderBy("query_size")


def query_price_stats(df: DataFrame, query: str, price: str) -> DataFrame:
    return df.groupBy(query).agg(
        F.avg(price).alias("query_price_mean"), F.stddev_samp(price).alias("query_price_std")
    )


def target_rates(df: DataFrame, click: str, book: str) -> DataFrame:
    """Click rate, booking rate and mean of booked / (clicked + 1e-6)."""
    ratio = F.col(book).cast("double") / (F.col(click).cast("double") + F.lit(1e-6))
    return df.agg(
        F.avg(click).alias("ctr"), F.avg(book).alias("booking_rate"), F.avg(ratio).alias("booking_given_click")
    )


def query_target_rates(df: DataFrame, query: str, click: str, book: str) -> DataFrame:
    return df.groupBy(query).agg(
        F.avg(click).alias("query_ctr"),
        F.avg(book).alias("query_booking_rate"),
        F.count(F.lit(1)).alias("query_size"),
    )


def booking_rate_by_query_size(df: DataFrame, query: str, click: str, book: str) -> DataFrame:
    per = query_target_rates(df, query, click, book)
    return per.groupBy("query_size").agg(F.avg("query_booking_rate").alias("avg_booking_rate")).orderBy("query_size")


def booking_rate_by_rank(
    df: DataFrame, query: str, column: str, book: str, ties: Sequence[str], out: str = "price_rank", hot="detect"
) -> DataFrame:
    """Booking rate by ascending in-query rank of a column."""
    narrow = df.select(*dict.fromkeys([query, column, book, *ties]))
    ranked = add_ordinal_ranks(narrow, {out: column}, [query], ties, hot)
    return ranked.groupBy(out).agg(F.avg(book).alias("booking_rate"), F.count(F.lit(1)).alias("rows")).orderBy(out)


# --- correlation -------------------------------------------------------------------------


def _null_classes(df: DataFrame, names: Sequence[str]) -> list[list[int]]:
    """Columns by the rows in which they are null: the first class is of those that never are."""
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
    some = [k for k, c in enumerate(names) if nulls[c]]
    alike = [(i, j) for i in some for j in some if i < j and nulls[names[i]] == nulls[names[j]]]
    odd = [F.count_if(F.col(names[i]).isNull() != F.col(names[j]).isNull()).alias(f"{i}_{j}") for i, j in alike]
    differ = df.agg(*odd).first() if odd else {}
    classes = [[k for k in range(len(names)) if k not in some]]
    for k in some:
        home = next((c for c in classes[1:] if (c[0], k) in alike and differ[f"{c[0]}_{k}"] == 0), None)
        if home:
            home.append(k)
        else:
            classes.append([k])
    return classes


def _value_counts(df: DataFrame, width: int, leads: list[int]) -> DataFrame:
    """(c, value, n0, n1, ...): rows of a value, in all and where column ``leads[b - 1]`` is present."""
    slots = len(leads) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present = np.stack([np.ones(batch.num_rows, bool), *(batch.column(k).is_valid().to_numpy(zero_copy_only=False) for k in leads)])
            # rows by the leads they have: a few values are counted once for each such pattern, not once for each lead
            _, first, of_row = np.unique(np.packbits(present, axis=0).T.copy().view(f"V{(slots + 7) // 8}").reshape(-1), return_index=True, return_inverse=True)
            patterns = present[:, first].astype(float)
            parts = []
            for c in range(width):
                own = batch.column(c)
                here = own.is_valid().to_numpy(zero_copy_only=False)
                coded = pc.dictionary_encode(pc.add(own.drop_null(), 0.0))  # -0.0 is 0.0
                values, back = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                if len(values) * len(first) <= 20 * batch.num_rows:
                    both = np.bincount(back * len(first) + of_row[here], minlength=len(values) * len(first))
                    counts = (both.reshape(-1, len(first)).astype(float) @ patterns.T).astype(np.int64).T
                else:
                    counts = [np.bincount(back[p[here]], minlength=len(values)).astype(np.int64) for p in present]
                parts.append((np.full(len(values), c, np.int32), values, *counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], ["c", "value", *(f"n{b}" for b in range(slots))])

    schema = "c int, value double, " + ", ".join(f"n{b} long" for b in range(slots))
    return df.mapInArrow(run, schema).groupBy("c", "value").agg(*[F.sum(f"n{b}").alias(f"n{b}") for b in range(slots)])


def spearman(df: DataFrame, columns: Sequence[str], sent: int = BROADCAST_VALUES) -> DataFrame:
    """Rank correlation of every pair of columns: f1, f2, corr with f1 < f2 in list order.

    Each pair uses the rows where both are present, ties get their average rank, and a pair without
    spread has NULL. A column is sorted once: running totals of its value counts give its ranks
    among all rows and among the rows where any other class of nulls is present (columns that are null
    in the same rows are one class). Ranks of columns with few values, ``sent`` numbers together, are
    looked up in every task, those of the others are joined; then each task adds up the products of all
    its ranks, and these sums merge. Work is rows x columns x classes.

    A join that has to shuffle takes a row's number and one value there, and its ranks back, as 4-byte
    whole numbers where they fit; no column travels with another one's ranks.
    """
    columns, spark = list(columns), df.sparkSession
    names = [f"c{k}" for k in range(len(columns))]
    df = stored(df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names)], F.monotonically_increasing_id().alias("_row")))
    held = [df]
    classes = _null_classes(df, names)
    slots, leads = len(classes), [c[0] for c in classes[1:]]
    class_of = {k: b for b, c in enumerate(classes) for k in c}
    counts = stored(_value_counts(df.select(*names), len(names), leads))
    held.append(counts)
    sums = {r["c"]: r for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("d"), *[F.sum(f"n{b}").alias(f"n{b}") for b in range(slots)]).collect()}
    totalled = running_totals(counts, ["c"], [F.col("value").asc()], **{f"u{b}": F.col(f"n{b}") for b in range(slots)})
    totals = [F.create_map(*[F.lit(x) for k in sums for x in (k, sums[k][f"n{b}"])]) if sums else F.create_map() for b in range(slots)]
    whole = "int" if all(r["n0"] < 2**31 for r in sums.values()) else "bigint"
    # twice the rank, counted from the middle: a whole number of at most n0
    rank = lambda b: (2 * F.col(f"u{b}") - F.col(f"n{b}") - F.element_at(totals[b], F.col("c"))).cast(whole)
    ranked = stored(totalled.select("c", "value", "n0", F.array(*[rank(b) for b in range(slots)]).alias("ranks")))
    held.append(ranked)
    discard(totalled)
    few, size = [], 0
    for k in sorted(sums, key=lambda k: sums[k]["d"]):
        size += sums[k]["d"] * (slots + 1)
        if size <= sent:
            few.append(k)
    tables = {}
    for k, own in ranked.filter(F.col("c").isin(few)).select("c", "value", "ranks").toPandas().groupby("c") if few else ():
        own = own.sort_values("value")
        tables[int(k)] = (own["value"].to_numpy(), np.stack(own["ranks"].to_numpy()) / 2.0)
    joined = [k for k in sums if k not in tables]
    rows, by_row = df, None
    for k in sorted(joined, key=lambda k: -sums[k]["d"]):  # joins that shuffle come first
        own = ranked.filter(F.col("c") == k).select(F.col("value").alias(names[k]), F.col("n0").alias("_n"), F.col("ranks").alias(f"r{k}"))
        if is_small(own):
            df = attach(df, own, [names[k]], "_n", settle=False)
            continue
        found = attach(rows.select("_row", names[k]).filter(F.col(names[k]).isNotNull()), own, [names[k]], "_n", settle=False)
        # what is joined by row number is dealt and stored one after the other: the disk holds one shuffle at a time
        if by_row is None:
            df = by_row = stored(dealt(df, ["_row"], None)[0])
            held.append(by_row)
        found = found.select("_row", f"r{k}")
        held.append(stored(found.repartition(dealt_by(by_row)[1], "_row")))
        df = df.join(held[-1], "_row", "left")
    df = df.select(*names, *[f"r{k}" for k in joined])
    known = spark.sparkContext.broadcast(tables)  # no more than ``sent`` numbers
    by_class = [k for c in classes for k in c]
    starts = [0, *np.cumsum([len(c) for c in classes]).tolist()]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums_of: dict[tuple[int, int], np.ndarray] = {}
        for batch in (whole.slice(at, PLANE_ROWS) for whole in batches for at in range(0, whole.num_rows, PLANE_ROWS)):
            n = batch.num_rows
            # ranks among the rows where class b is present: one plane per b, the columns by class; 0 where one is missing
            planes, present = np.zeros((slots, len(names), n)), np.ones((slots, n), bool)
            for b in range(1, slots):
                present[b] = batch.column(leads[b - 1]).is_valid().to_numpy(zero_copy_only=False)
            for at, k in enumerate(by_class):
                own = batch.column(k)
                here = own.is_valid().to_numpy(zero_copy_only=False)
                x = None
                if k in known.value:
                    values, r = known.value[k]
                    x = r[np.searchsorted(values, own.drop_null().to_numpy(zero_copy_only=False) + 0.0)]
                elif k in joined and here.any():
                    x = batch.column(len(names) + joined.index(k)).filter(pa.array(here)).flatten().to_numpy(zero_copy_only=False).reshape(-1, slots) / 2.0
                if x is not None:
                    planes[:, at, here] = x.T
            planes *= present[:, None, :]
            for a in range(slots):
                left = slice(starts[a], starts[a + 1])
                for b in range(a, slots):
                    right = slice(starts[b], starts[b + 1])
                    x, y = planes[b, left], planes[a, right]
                    if a == b:
                        m = x @ x.T
                    elif len(x) + len(y):  # products of the two classes, and squares of each
                        m = np.diag(np.concatenate([np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)]))
                        m[: len(x), len(x) :] = x @ y.T
                    else:
                        continue
                    sums_of[a, b] = sums_of.get((a, b), 0) + m
        rows = [(a, b, i, j, m[i, j]) for (a, b), m in sums_of.items() for i in range(len(m)) for j in range(i, len(m))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["a", "b", "i", "j", "v"])

    moments = df.mapInArrow(products, "a long, b long, i long, j long, v double").groupBy("a", "b", "i", "j").agg(F.sum("v").alias("v"))
    found = {(r["a"], r["b"], r["i"], r["j"]): r["v"] for r in moments.collect()}  # columns x columns x classes numbers
    for table in held:
        discard(table)
    out = []
    for i in range(len(columns)):
        for j in range(i + 1, len(columns)):
            a, b = sorted((class_of[i], class_of[j]))
            order = classes[a] + (classes[b] if b != a else [])
            x, y = sorted((order.index(i), order.index(j)))
            xx, yy, xy = (found.get((a, b, *at), 0.0) for at in ((x, x), (y, y), (x, y)))
            out.append((columns[i], columns[j], xy / math.sqrt(xx * yy) if xx > 0 and yy > 0 else None))
    return spark.createDataFrame(out, "f1 string, f2 string, corr double")


def usable_pairs(corr: DataFrame) -> DataFrame:
    """Pairs without spread count as 0; columns without spread in every pair are left out."""
    both = corr.select(F.col("f1").alias("f"), "corr").unionByName(corr.select(F.col("f2").alias("f"), "corr"))
    alive = both.groupBy("f").agg(F.max(F.abs(F.coalesce("corr", F.lit(0.0)))).alias("_m")).filter("_m > 0").select("f")
    kept = corr.join(alive.withColumnRenamed("f", "f1"), "f1", "left_semi").join(
        alive.withColumnRenamed("f", "f2"), "f2", "left_semi"
    )
    return kept.withColumn("corr", F.coalesce("corr", F.lit(0.0)))


def strongest_pairs(corr: DataFrame, n: int = 30) -> DataFrame:
    """The n pairs with the largest absolute correlation."""
    return usable_pairs(corr).orderBy(F.abs("corr").desc(), "f1", "f2").limit(n)
