"""What travels through joins and how many rows a task gets, as tables grow."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rankloom.operators import features, metrics, pairs, profile, quantile, rankers, skew, stats
from rankloom.plans import feature_tables
from rankloom.roles import Roles


def rows(n=120, per=4):
    return [(i // per, i, float(i * 7 % 11), float(i * 5 % 13), float(i % 3)) for i in range(n)]


@pytest.fixture
def ranked(spark):
    return spark.createDataFrame(rows(), "q int, i int, a double, s double, rel double")


def test_ranks_of_large_columns_travel_alone(spark, monkeypatch):
    """A join that shuffles takes one value and a row number, not the columns of the table."""
    made = [(float(i * 7 % 31), None if i % 4 == 0 else float(i * i % 23), float(i % 29), None if i % 5 else -0.0) for i in range(90)]
    made += [(float("nan"), 1.0, None, 2.0)] * 2
    df = spark.createDataFrame(made, "a double, b double, c double, d double")
    sent, attach = [], profile.attach
    monkeypatch.setattr(profile, "attach", lambda left, *x, **y: sent.append(left.columns) or attach(left, *x, **y))
    whole = {(r["f1"], r["f2"]): r["corr"] for r in profile.spearman(df, df.columns).collect()}
    monkeypatch.setattr(skew, "BROADCAST_VALUES", 1)
    got = {(r["f1"], r["f2"]): r["corr"] for r in profile.spearman(df, df.columns, sent=0).collect()}
    assert sent and all(len(c) == 2 for c in sent)
    data = pd.DataFrame(made, columns=list("abcd"))[:90]
    assert got.keys() == whole.keys()
    for k in got:
        assert (got[k] is None and whole[k] is None) or got[k] == pytest.approx(whole[k], abs=1e-12)
    plain = profile.spearman(df.filter(~F.isnan("a")), ["a", "b", "c"], sent=0)
    for r in plain.collect():
        both = data[[r["f1"], r["f2"]]].dropna().rank()
        assert r["corr"] == pytest.approx(np.corrcoef(both.T)[0, 1], abs=1e-9)


def test_pairs_are_built_from_stored_rows(spark, ranked):
    """Both sides of the join read the ranked rows; they do not rank them once each."""
    out = pairs.preference_pairs(ranked, "q", "rel", "s", ["i"], ["i"])
    assert out.inputFiles()
    expected = {(q, a, b) for q, a, _, _, g in rows() for p, b, _, _, h in rows() if p == q and g > h}
    assert {(r["q"], r["i_win"], r["i_lose"]) for r in out.collect()} == expected and out.count() == len(expected)


def test_pairwise_fit_joins_its_pairs_once(spark, ranked, monkeypatch):
    seen = []

    class Fit(rankers.LogisticRegression):
        def _fit(self, dataset):
            seen.append("Join" in dataset._jdf.queryExecution().optimizedPlan().toString())
            return super()._fit(dataset)

    monkeypatch.setattr(rankers, "LogisticRegression", Fit)
    rankers.pairwise_logistic(ranked, ["a"], "q", "rel", "s", ["i"], max_iter=2)
    assert seen == [False]


def test_copies_of_a_hot_query_are_bounded(spark):
    """n / limit pieces would copy 60 rows 60 times over."""
    df = spark.createDataFrame([(1, i, float(i % 3), -float(i)) for i in range(60)], "q int, i int, rel double, s double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = pairs.preference_pairs(df, "q", "rel", "s", ["i"], ["i"], limit=1)
        got = [(r["i_win"], r["i_lose"]) for r in out.collect()]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(got) == sorted((a, b) for a in range(60) for b in range(60) if a % 3 > b % 3)
    assert f", {pairs.PIECES})" in plan and "least(" in plan


@pytest.mark.parametrize("build", [
    lambda df: features.add_percentile_ranks(df, {"r": "a"}, ["q"], ["i"]),
    lambda df: metrics.ndcg_per_query(df, "q", "rel", "s"),
])
def test_tasks_grow_with_the_rows(spark, ranked, monkeypatch, build):
    """More rows are more tasks, not larger ones, and results do not depend on it."""
    before = sorted(build(ranked).collect(), key=str)
    monkeypatch.setattr(skew, "TASK_ROWS", 10, raising=False)
    out = build(ranked)
    assert out.rdd.getNumPartitions() == 12
    assert sorted(out.collect(), key=str) == before


def test_hot_queries_are_not_dealt_whole(spark, ranked):
    spark.conf.set("spark.rankloom.hotRows", "3")
    try:
        assert skew.dealt(ranked, ["q"])[1].count() == 30
    finally:
        spark.conf.unset("spark.rankloom.hotRows")
    assert skew.dealt(ranked, ["q"])[1] is None


def test_factorisation_machine_reads_held_columns(spark, ranked, monkeypatch):
    held = []
    monkeypatch.setattr(rankers.FMClassifier, "_fit", lambda self, d, f=rankers.FMClassifier._fit: held.append(d.storageLevel.useMemory) or f(self, d))
    df = ranked.withColumns({"click_bool": (F.col("i") % 2), "booking_bool": F.lit(0)})
    model, fill = rankers.factorisation_machine(df, ["a", "s"], factors=2, max_iter=2)
    assert held == [True] and rankers.score(model, df, fill).count() == 120


def test_cells_are_joined_to_narrow_rows(spark, sf_dir, monkeypatch):
    """(market, item) statistics are as many as the rows: they are joined before these are widened."""
    from rankloom.catalog.impressions import ROLES, impressions

    seen, attach = [], feature_tables.attach
    monkeypatch.setattr(feature_tables, "attach", lambda df, stats, keys, *x, **y: seen.append((len(keys), df.columns)) or attach(df, stats, keys, *x, **y))
    df = impressions(spark, sf_dir)
    feature_tables.feature_table(df.filter("split = 'train'").drop("split"), df.filter("split = 'test'").drop("split"), ROLES)
    assert [("query_price_mean" in columns) for n, columns in seen if n == 3] == [False]


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_lambda_terms_are_columns(spark, ranked):
    """No array function that is interpreted entry by entry; hot and ordinary queries get the same numbers."""
    plain = pairs.lambda_gradients(ranked, "q", "rel", "s", ["i"], truncation=3)
    assert "lambdafunction" not in plan_of(plain)
    hot = skew.hot_keys(ranked, ["q"], limit=3)
    spread = pairs.lambda_gradients(skew.stored(ranked), "q", "rel", "s", ["i"], truncation=3, hot=hot)
    a, b = ({r["i"]: (r["lambda"], r["hessian"]) for r in df.collect()} for df in (plain, spread))
    assert a.keys() == b.keys() and len(a) == 120 and any(x[0] for x in a.values())
    assert all(a[i] == pytest.approx(b[i], abs=1e-12) for i in a)


def test_lambdas_of_rows_without_a_query_are_zero(spark, ranked):
    df = ranked.withColumn("q", F.when(F.col("q") > 3, F.col("q")))
    out = pairs.lambda_gradients(df, "q", "rel", "s", ["i"]).filter("q is null")
    assert out.count() == 16 and out.filter("lambda <> 0 or hessian <> 0").isEmpty()


def test_hot_places_are_stored_once(spark, ranked, monkeypatch):
    """One range shuffle; no window shuffles the hot rows again, and later passes read them from files."""
    monkeypatch.setattr(skew, "TASK_ROWS", 10)
    out = skew.Groups(["q"], spread=True).ordinal(ranked.withColumn("q", F.col("i") % 2), at=[F.col("s").desc(), F.col("i")])
    assert out.inputFiles() and "Window" not in plan_of(out)
    got = {r["i"]: r["at"] for r in out.collect()}
    for q in (0, 1):
        order = sorted((r for r in rows() if r[1] % 2 == q), key=lambda r: (-r[3], r[1]))
        assert [got[r[1]] for r in order] == list(range(1, 61))


def test_hot_medians_are_counted(spark, monkeypatch):
    """A few hot keys need neither a shuffle nor a sort of their rows; many take the range sort."""
    made = [(None if i % 3 == 0 else i % 3, float(i * 7 % 101) if i % 5 else None, float(i % 4), None) for i in range(300)]
    df = spark.createDataFrame(made, "k int, x double, y double, z double")
    names, hot = {"x": "mx", "y": "my", "z": "mz"}, skew.hot_keys(df, ["k"], 50)
    wanted = {r["k"]: r for r in quantile.group_medians(df, ["k"], names, None).collect()}
    with monkeypatch.context() as m:
        m.setattr(quantile, "FEW_KEYS", 0)
        assert {r["k"]: r for r in quantile.group_medians(df, ["k"], names, hot).collect()} == wanted
    monkeypatch.setattr(quantile, "weighted_quantiles", None)
    assert {r["k"]: r for r in quantile.group_medians(df, ["k"], names, hot).collect()} == wanted and len(wanted) == 3


def test_profiles_sum_up_where_the_rows_of_an_item_are(spark, ranked):
    roles = Roles(item="q")
    out = stats.item_profile(ranked, roles, ["a", "s"])
    assert plan_of(out).split("== Physical Plan ==")[1].count("Exchange hashpartitioning(q") == 1 and "REPARTITION_BY_NUM" in plan_of(out)
    hot = stats.item_profile(skew.stored(ranked), roles, ["a", "s"], hot=skew.hot_keys(ranked.filter("q < 5"), ["q"], 3))
    key = lambda df: {r["q"]: r for r in df.select("q", "_rows", *[F.round(c, 9).alias(c) for c in out.columns[2:]]).collect()}
    assert key(out) == key(hot) and len(key(out)) == 30


def test_frequencies_read_stored_rows(spark, ranked):
    """The source is read once for each key: it is not worked out as often."""
    df = ranked.withColumn("b", F.when(F.col("i") % 3 > 0, F.col("i") % 3))
    for source in (df, ranked.withColumn("b", F.when(F.col("i") % 3 > 0, F.col("i") % 3))):
        out = stats.add_frequencies(df, source, ["q", "b"])
        assert out.inputFiles() if source is df else True
        assert {(r["q_freq"], r["b_freq"]) for r in out.collect()} == {(4, 40), (4, None)}


def test_positions_are_ranked_from_stored_rows(spark, sf_dir):
    from rankloom.catalog import group_stats

    files = group_stats.w3(spark, sf_dir).inputFiles()
    assert files and all("stored-" in f for f in files)


def test_known_ordinary_queries_are_dealt_for_fitting(spark, ranked, monkeypatch):
    from rankloom.operators import boosting

    seen = []
    monkeypatch.setattr(boosting, "materialise", lambda df, f=boosting.materialise: seen.append(plan_of(df)) or f(df))
    boosting.fit_ranking_trees(ranked, ["a", "s"], "q", "rel", ["i"], boosting.BoostParams(rounds=1, max_depth=1, min_rows_in_leaf=1))
    assert "REPARTITION_BY_NUM" in seen[0] and "Join" not in seen[0]


def test_few_values_are_counted_once(spark, monkeypatch):
    from rankloom.operators import profile, quantile

    passes, counted = [], quantile._counted
    monkeypatch.setattr(quantile, "_counted", lambda df, *a: passes.append(1) or counted(df, *a))
    rows = [(k % 7 - 3.0, float("nan") if k % 5 == 0 else -0.0, None) for k in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    found = {r["variable"]: r for r in profile.numeric_summary(df).collect()}
    assert len(passes) == 1
    assert (found["a"]["q25"], found["a"]["median"], found["a"]["q99"]) == (-2.0, 0.0, 3.0)
    assert found["b"]["median"] == 0.0 and math.isnan(found["b"]["q99"]) and found["b"]["missing_count"] == 0
    assert found["c"]["missing_fraction"] == 1.0 and found["c"]["median"] is None


def test_lines_are_dealt_before_their_joins(spark, sf_dir, monkeypatch):
    from rankloom.catalog.impressions import impressions
    from rankloom.operators import skew

    want = sorted(impressions(spark, sf_dir).select("srch_id", "prop_id", "position", "price_usd").collect())
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    df = impressions(spark, sf_dir)
    assert sorted(df.select("srch_id", "prop_id", "position", "price_usd").collect()) == want
    per_task = df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert per_task < 6 * 50
