import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import refresh

KINDS = "k string, x double, y int, delivery string"


def plain(rows):
    """Count, total, mean, deviation, least and largest of x and y per key, from all rows."""
    out = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        out[k] = [len(own)]
        for c in (1, 2):
            v = [r[c] for r in own if r[c] is not None]
            mean = math.fsum(v) / len(v) if v else None
            std = math.sqrt(math.fsum((a - mean) ** 2 for a in v) / (len(v) - 1)) if len(v) > 1 else None
            out[k] += [len(v), sum(v) if v else None, mean, std, min(v, default=None), max(v, default=None)]
    return out


def found(spark, store):
    return {r[0]: list(r[1:]) for r in refresh.merged(spark, store, ["k"], ["x", "y"]).collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9), k


def rows_of(seed, day, n=120):
    rng = random.Random(seed)
    # far from zero, so sums of squares would lose the deviation; one key holds a third of the rows
    return [
        (rng.choice(["hot", "hot", "a", "b", None, f"own {day}"]), rng.choice([None, 1e6 + rng.random()]), rng.choice([None, 1, 2, 7]), day)
        for _ in range(n)
    ]


def test_deliveries_add_up_and_repeats_change_nothing(spark, tmp_path):
    store, days = str(tmp_path / "store"), {d: rows_of(i, d) for i, d in enumerate(["2024-01-01", "2024-01-02", "007", "late"])}

    def put(rows, id):
        refresh.deliver(spark.createDataFrame(rows, KINDS), store, ["k"], ["x", "y"], id)

    so_far = []
    for d, rows in days.items():
        put(rows[:50], d)  # at first a part of the day
        put(rows, d)
        so_far += rows
        same(found(spark, store), plain(so_far))
    before = found(spark, store)
    put(days["2024-01-02"], "2024-01-02")
    put([], "late")
    assert found(spark, store) == before


def test_many_deliveries_in_one_job(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = rows_of(9, "one") + rows_of(10, None) + rows_of(11, "two")
    df = spark.createDataFrame(rows, KINDS).withColumn("rows", F.lit(1)).withColumn("k_n", F.lit(2))
    refresh.deliver(df, store, ["k"], ["x", "y"], F.col("delivery"))
    same(found(spark, store), plain(rows))
    again = rows_of(12, "two")
    refresh.deliver(spark.createDataFrame(again, KINDS), store, ["k"], ["x", "y"], F.col("delivery"))
    same(found(spark, store), plain([r for r in rows if r[3] != "two"] + again))


def test_names_that_clash(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 1, "d")], KINDS)
    for keys, measures in ((["k"], ["k"]), (["delivery_id"], ["x"]), (["k"], ["Rows"])):
        with pytest.raises(ValueError):
            refresh.deliver(df, str(tmp_path / "s"), keys, measures, "d")
