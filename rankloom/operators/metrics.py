"""NDCG@k with explicit rules for ties and for queries without a relevant item.

Only the first k rows (or tie groups) of a query matter. The row_number filter
becomes a per-task top-k before the shuffle, so a query of any size sends at most k
rows per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions.columns import same_keys
from rankloom.operators.features import descending
from rankloom.operators.skew import dealt

_EXACT = ("double", "float", "int", "smallint", "tinyint")  # score types that a double holds exactly
EMPTY = ("zero", "one", "skip")


def discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1))


def _discount_sums(k: int) -> Column:
    """Constant array d with d[m] = sum of the first m discounts, m = 0..k."""
    sums = accumulate((1.0 / log2(i + 1) for i in range(1, k + 1)), initial=0.0)
    return F.array(*[F.lit(x) for x in sums])


def _gain_of_steps(steps: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str) -> DataFrame:
    """DCG@k per key of a table of steps: ``_n`` rows of gain ``_gain`` each, best step first."""
    first = Window.partitionBy(*keys).orderBy(*order)
    top = steps.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= k)
    upto = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    sums = _discount_sums(k)
    end = F.sum("_n").over(upto)
    placed = top.withColumn("_end", end)

    def d(m: Column) -> Column:
        return F.element_at(sums, (F.least(m, F.lit(k)) + F.lit(1)).cast("int"))

    share = F.col("_gain") * (d(F.col("_end")) - d(F.col("_end") - F.col("_n")))
    return placed.groupBy(*keys).agg(F.sum(share).alias(out))


def ideal_dcg(df: DataFrame, keys: Sequence[str], relevance: str, k: int = 5, out: str = "idcg") -> DataFrame:
    """IDCG@k per query: rows are first counted per grade, so little is shuffled."""
    steps = df.groupBy(*keys, F.coalesce(F.col(relevance).cast("double"), F.lit(0.0)).alias("_gain")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return _gain_of_steps(steps, keys, [F.col("_gain").desc()], k, out)


def dcg(
    df: DataFrame,
    keys: Sequence[str],
    relevance: str,
    score: str,
    k: int = 5,
    ties: str = "average",
    tie_keys: Sequence[str] = (),
    out: str = "dcg",
) -> DataFrame:
    """DCG@k per query under the order of ``score`` descending, missing scores last.

    ``ties="average"`` gives equal scores their mean relevance; ``ties="break"`` orders
    them by ``tie_keys``, which then have to tell the rows of a query apart.
    """
    gain = F.coalesce(F.col(relevance).cast("double"), F.lit(0.0))
    if ties == "average":
        steps = df.groupBy(*keys, F.col(score).alias("_s")).agg(
            F.count(F.lit(1)).alias("_n"), F.avg(gain).alias("_gain")
        )
        order = [F.col("_s").desc_nulls_last()]
    elif ties == "break":
        order = descending(score, tie_keys)
        steps = df.select("*", F.lit(1).cast("bigint").alias("_n"), gain.alias("_gain"))
    else:
        raise ValueError(f"unknown tie rule {ties!r}")
    return _gain_of_steps(steps, keys, order, k, out)


def ndcg_per_query(
    df: DataFrame,
    keys: Sequence[str] | str,
    relevance: str,
    score: str,
    k: int = 5,
    ties: str = "average",
    tie_keys: Sequence[str] = (),
    deal: bool = True,
) -> DataFrame:
    """dcg, idcg and ndcg per query; ndcg is NULL when the query has no relevant item.

    With ties by average one pass and one exchange give both sums. ``deal=False``: the rows of a key are
    together already (``skew.dealt``).
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if ties == "average" and dict(df.dtypes)[score] in _EXACT:
        if deal:
            df, _ = dealt(df, keys)
        return _dcgs_of_steps(score_and_grade_steps(df, keys, relevance, score), keys, k)
    gained = dcg(df, keys, relevance, score, k, ties, tie_keys)
    ideal = ideal_dcg(df, keys, relevance, k).withColumnsRenamed({c: "_ideal_" + c for c in keys})
    # NULL-safe: rows without a query are one query, as in the sums
    got = gained.join(ideal, same_keys(gained, ideal, keys, "_ideal_")).drop(*["_ideal_" + c for c in keys])
    return got.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")))


def score_and_grade_steps(df: DataFrame, keys: Sequence[str], relevance: str, score: str) -> DataFrame:
    """Per key and ``_kind`` the rows of equal score (0) and of equal gain (1): ``_value``, ``_n``, ``_gain``.

    Both sorts come from one pass over ``df`` and one aggregation; with ties by average they are all that NDCG needs.
    """
    gain = F.coalesce(F.col(relevance).cast("double"), F.lit(0.0))
    kind = lambda n, value: F.struct(F.lit(n).alias("_kind"), value.alias("_value"))
    rows = df.select(*keys, gain.alias("_g"), F.explode(F.array(kind(0, F.col(score).cast("double")), kind(1, gain))).alias("_x"))
    return rows.groupBy(*keys, F.col("_x._kind").alias("_kind"), F.col("_x._value").alias("_value")).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_g").alias("_gain")
    )


def _dcgs_of_steps(steps: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """dcg, idcg and ndcg per key from ``score_and_grade_steps``."""
    gained = _gain_of_steps(steps, [*keys, "_kind"], [F.col("_value").desc_nulls_last()], k, "_sum")
    only = lambda n: F.max(F.when(F.col("_kind") == n, F.col("_sum")))
    both = gained.groupBy(*keys).agg(only(0).alias("dcg"), only(1).alias("idcg"))
    return both.withColumn("ndcg", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")))


def ndcg_of_steps(steps: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """ndcg per key from ``score_and_grade_steps``; NULL without a relevant item."""
    return _dcgs_of_steps(steps, keys, k).drop("dcg", "idcg")


def empty_value(empty: str) -> Column:
    """Value of a query without a relevant item, NULL when such queries are skipped."""
    if empty not in EMPTY:
        raise ValueError(f"empty must be one of {EMPTY}")
    return {"zero": F.lit(0.0), "one": F.lit(1.0), "skip": F.lit(None).cast("double")}[empty]


def mean_ndcg(
    df: DataFrame,
    keys: Sequence[str] | str,
    relevance: str,
    score: str,
    k: int = 5,
    ties: str = "average",
    tie_keys: Sequence[str] = (),
    empty: str = "skip",
    by: Sequence[str] = (),
    deal: bool = True,
) -> DataFrame:
    """Mean NDCG@k over queries (per value of ``by``, e.g. the split) and how many counted."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    per_query = ndcg_per_query(df, [*by, *keys], relevance, score, k, ties, tie_keys, deal)
    value = F.coalesce(F.col("ndcg"), empty_value(empty))
    return per_query.groupBy(*by).agg(F.avg(value).alias("ndcg"), F.count(value).alias("queries"))


def train_val_gap(
    df: DataFrame,
    keys: Sequence[str] | str,
    relevance: str,
    score: str,
    split: str,
    train: str = "train",
    val: str = "val",
    **rules,
) -> DataFrame:
    """One row: train_ndcg, val_ndcg and their difference ``gap``."""
    by_split = mean_ndcg(df, keys, relevance, score, by=[split], **rules)
    one = by_split.agg(
        F.max(F.when(F.col(split) == train, F.col("ndcg"))).alias("train_ndcg"),
        F.max(F.when(F.col(split) == val, F.col("ndcg"))).alias("val_ndcg"),
    )
    return one.withColumn("gap", F.col("train_ndcg") - F.col("val_ndcg"))


def top_k(
    df: DataFrame, keys: Sequence[str] | str, score: str, tie_keys: Sequence[str], k: int, out: str = "rank"
) -> DataFrame:
    """The k best rows of each query with their rank; cut to k per task before the shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*keys).orderBy(*descending(score, tie_keys))
    return df.withColumn(out, F.row_number().over(w).cast("bigint")).filter(F.col(out) <= k)
