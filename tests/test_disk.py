"""What stays on disk: rows are shuffled once, stored in columns, and dropped when nothing reads them."""

import os

import pytest
from pyspark.sql import functions as F

from rankloom.catalog import models
from rankloom.operators import boosting, profile, rankers, skew, stats
from rankloom.plans import classic_features, feature_tables, search
from rankloom.roles import Roles


@pytest.fixture
def ranked(spark):
    made = [(i // 4, i, float(i * 7 % 11), float(i * 5 % 13), float(i % 3)) for i in range(120)]
    return spark.createDataFrame(made, "q int, i int, a double, s double, rel double")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def folders(spark):
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {f for f in os.listdir(top) if f.startswith("stored-")}


def test_dealt_rows_stay_together_when_stored(spark, ranked):
    rows = skew.stored(skew.dealt(ranked, ["q"])[0])
    assert skew.dealt(rows.filter("rel > 0"), ["q"])[0].groupBy("q").count().count() == 30
    assert exchanges(skew.dealt(rows.filter("rel > 0"), ["q"])[0].groupBy("q").count()) == 0
    assert sorted(rows.collect()) == sorted(ranked.collect()) and skew.dealt_by(ranked) is None
    skew.discard(rows)
    assert not any(f in rows.stored_at for f in folders(spark))


def test_rounds_shuffle_nothing_and_leave_nothing(spark, ranked, monkeypatch):
    """one shuffle at the start, no vectors in storage, no table left behind."""
    seen, before = [], folders(spark)
    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    monkeypatch.setattr(boosting, "stored", lambda df, f=boosting.stored: seen.append((exchanges(df), df.columns)) or f(df))
    params = boosting.BoostParams(rounds=3, max_depth=2, min_rows_in_leaf=1)
    model = boosting.fit_ranking_trees(ranked, ["a", "s"], "q", "rel", ["i"], params, val=ranked)
    assert len(model.history) == 3 and len(seen) == 5
    few = [len(t) for t in boosting.fit_ranking_trees(ranked.limit(50), ["a", "s"], "q", "rel", ["i"], params).trees]
    assert len(few) == 3 and len(seen) == 5
    assert [n for n, _ in seen] == [1, 1, 0, 0, 0] and not any("features" in c for _, c in seen)
    assert folders(spark) == before


def test_factorisation_machine_keeps_nothing_on_disk(spark, ranked, monkeypatch):
    """F7"""
    held = []
    monkeypatch.setattr(rankers.FMClassifier, "_fit", lambda self, d, f=rankers.FMClassifier._fit: held.append(d.storageLevel) or f(self, d))
    rankers.factorisation_machine(ranked.withColumns({"click_bool": F.col("i") % 2, "booking_bool": F.lit(0)}), ["a", "s"], factors=2, max_iter=2)
    assert held[0].useMemory and not held[0].useDisk


def test_classic_rows_are_dealt_by_query_only(spark, sf_dir):
    """F8: the numbers of items and markets are joined to rows that stay where they are."""
    from rankloom.catalog.impressions import ROLES, impressions

    out = classic_features.classic_features(impressions(spark, sf_dir), ROLES)
    assert exchanges(out) == out._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") and out.inputFiles()


def test_joined_statistics_equal_those_of_windows(spark, ranked):
    rows = ranked.withColumn("q", F.when(F.col("q") > 3, F.col("q") % 5))
    for f in (lambda **x: stats.normalise(rows, "q", "a", **x), lambda **x: stats.group_transform(rows, "q", "a", ["mean", "max"], **x)):
        key = lambda df: sorted(df.select(*[F.round(c, 9).alias(c) for c in df.columns]).collect(), key=str)
        assert key(f(joined=True)) == key(f()) and f().count() == 104


def test_item_profiles_do_not_travel_with_the_windows(spark, sf_dir, monkeypatch):
    """of a large item table only the average position is joined before the windows; each join's rows are stored."""
    from rankloom.catalog.impressions import ROLES, impressions

    wide, kept = [], []
    monkeypatch.setattr(feature_tables, "is_small", lambda df: False)
    windows, store = feature_tables.features.add_query_windows, feature_tables.stored
    monkeypatch.setattr(feature_tables.features, "add_query_windows", lambda df, *x, **y: wide.extend(df.columns) or windows(df, *x, **y))
    monkeypatch.setattr(feature_tables, "stored", lambda df: kept.append(len(df.columns)) or store(df))
    df = impressions(spark, sf_dir)
    out = feature_tables.feature_table(df.filter("split = 'train'").drop("split"), df.filter("split = 'test'").drop("split"), ROLES)
    assert "prop_avg_position" in wide and "prop_price_usd_median" not in wide and len(kept) == 4
    assert out.filter("prop_price_usd_median is null or log_price_usd is null").isEmpty()


def test_rank_correlations_leave_nothing(spark, ranked, monkeypatch):
    """tables are dropped at the end; joins by row number are stored one by one."""
    before = folders(spark)
    monkeypatch.setattr(profile, "PLANE_ROWS", 7)
    whole = {tuple(r)[:2]: r["corr"] for r in profile.spearman(ranked, ["i", "a", "s", "rel"]).collect()}
    monkeypatch.setattr(skew, "BROADCAST_VALUES", 1)
    got = {tuple(r)[:2]: r["corr"] for r in profile.spearman(ranked, ["i", "a", "s", "rel"], sent=0).collect()}
    assert got == pytest.approx(whole) and len(got) == 6 and folders(spark) == before


def test_small_dimensions_are_sent(spark, sf_dir, monkeypatch):
    """F5 to F12: a table of few values is no reason to deal all rows once more."""
    from rankloom.catalog import impressions as source

    monkeypatch.setattr(skew, "TASK_ROWS", 5)
    plan = source.impressions(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(l_orderkey" in plan and "hashpartitioning(l_suppkey" not in plan
    monkeypatch.setattr(source, "SENT_VALUES", 0)
    assert "hashpartitioning(l_suppkey" in source.impressions(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_searches_and_audits_are_whole(spark, monkeypatch):
    """all trials, rounds and refits, and trees as large as the settings say."""
    seen = {}
    monkeypatch.setattr(models, "_parts", lambda *x: (None, None))
    monkeypatch.setattr(models, "scratch", lambda *x: "nowhere")

    def stop(name, error=StopIteration):
        def call(*x, **y):
            seen[name] = (x, y)
            raise error

        return call

    monkeypatch.setattr(models, "fit_ranking_trees", stop("fit"))
    monkeypatch.setattr(models, "audit", stop("audit"))
    monkeypatch.setattr(models.search, "run_trials", stop("trials"))
    for f in (models.e9, models.x6, models.e12):
        with pytest.raises(StopIteration):
            f(spark, "")
    for x in (seen["fit"][0][5], seen["audit"][0][8]):
        assert (x.rounds, x.max_depth, x.min_rows_in_leaf) == (1219, 6, 1428)
    x, y = seen["trials"]
    assert len(x[6]) == 150 and (y["rounds"], y["patience"], y["dart_rounds"]) == (3000, 150, 600) and "overrides" not in y


def test_settings_decide_how_long_a_trial_is(spark, ranked, monkeypatch):
    seen = []

    def fit(train, columns, query, relevance, ties, params, val=None, **x):
        seen.append((params.rounds, params.patience, params.min_gain, params.min_gain_total, val is None))
        return boosting.RankingTrees([], [], {"a": 0.0}, params)

    monkeypatch.setattr(search, "fit_ranking_trees", fit)
    two = [search.START_POINTS[0], search.START_POINTS[4]]
    search.run_trials(ranked, ranked, ["a"], "q", "rel", ["i"], two, 3000, patience=150, dart_rounds=600, summed_gain=True)
    assert seen == [(3000, 150, 0.0, 0.427, False), (600, 150, 0.0, 0.12, True)]


def test_least_gain_is_a_sum(spark, ranked):
    """Per unit of weight 0.5 is more than any split of these rows gains, as a sum it is little."""
    fit = lambda **x: boosting.fit_ranking_trees(ranked, ["a", "s", "i"], "q", "rel", ["i"], boosting.BoostParams(rounds=1, max_depth=2, min_rows_in_leaf=1, **x))
    sizes = [len(fit(min_gain=50.0).trees[0]), len(fit(min_gain_total=0.001).trees[0])]
    assert sizes[0] == 1 and sizes[1] > 1
