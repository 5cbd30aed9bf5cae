"""Properties on the shared tables and on planted data."""

import random

import pytest
from pyspark.sql import functions as F

from rankloom.catalog.impressions import ROLES, TIES, impressions
from rankloom.catalog.ranking import scored
from rankloom.operators import encode, features, metrics, pairs, rankers
from rankloom.operators.boosting import BoostParams, RankingTrees, fit_ranking_trees
from rankloom.operators.skew import materialise
from rankloom.plans.feature_tables import base_features
from rankloom.plans.search import START_POINTS, draw_settings, leaderboard, refit_top, run_trials
from rankloom.sources import tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def imp(spark, sf_dir):
    return materialise(impressions(spark, sf_dir))


def test_zscores_of_a_query_sum_to_zero(imp):
    base = base_features(imp, ROLES)
    worst = base.groupBy("srch_id").agg(F.abs(F.sum("price_zscore")).alias("s")).agg(F.max("s")).first()[0]
    assert worst < 1e-6


def test_ranks_are_permutations(imp):
    ranked = features.add_ordinal_ranks(imp, {"r": "prop_review_score"}, ["srch_id"], TIES)
    bad = ranked.groupBy("srch_id").agg(
        F.count("r").alias("n"), F.count_distinct("r").alias("d"), F.max("r").alias("m")
    ).filter("n <> d or (n > 0 and m <> n)")
    assert bad.isEmpty()


def test_own_labels_do_not_leak(imp):
    df = imp.withColumn("fold", (F.col("srch_id") % 5).cast("int"))
    g = encode.priors(df, encode.ITEM_TARGETS)
    some = df.agg(F.min("srch_id")).first()[0]
    flipped = df.withColumns(
        {c: F.when(F.col("srch_id") == some, 1 - F.col(c)).otherwise(F.col(c)) for c in ("click_bool", "booking_bool")}
    )

    def rates(d):
        out = encode.encode_out_of_fold(d, ["prop_id"], encode.ITEM_TARGETS, "fold", g).filter(F.col("srch_id") == some)
        return sorted(tuple(r) for r in out.select("prop_id", "prop_ctr_oof", "prop_booking_rate_oof").collect())

    assert rates(df) == rates(flipped)


def test_ndcg_bounds_and_ideal_order(spark, sf_dir):
    df = scored(spark, sf_dir)
    bounds = metrics.ndcg_per_query(df, "srch_id", "relevance", "score").agg(F.min("ndcg"), F.max("ndcg")).first()
    assert bounds[0] >= 0 and bounds[1] <= 1 + 1e-9
    assert metrics.mean_ndcg(df, "srch_id", "relevance", "relevance").first()["ndcg"] == pytest.approx(1)


def test_lambdas_sum_to_zero(spark, sf_dir):
    out = pairs.lambda_gradients(scored(spark, sf_dir), "srch_id", "relevance", "score", [*TIES], truncation=3)
    worst = out.groupBy("srch_id").agg(F.abs(F.sum("lambda")).alias("s")).agg(F.max("s")).first()[0]
    assert worst < 1e-9 and out.filter("hessian < 0").isEmpty()


def test_base_features_shuffle_rows_once_and_stay_in_the_jvm(imp):
    text = plan(base_features(imp, ROLES, hot=None))
    assert "PythonUDF" not in text and "ArrowEvalPython" not in text
    assert text.count("hashpartitioning(srch_id") == 1
    assert "Exchange SinglePartition" not in text.split("Subquery")[0]


def test_metric_cuts_to_k_before_the_shuffle(imp):
    df = imp.withColumn("relevance", F.col("click_bool"))
    text = plan(metrics.ndcg_per_query(df, "srch_id", "relevance", "price_usd", ties="break", tie_keys=TIES))
    assert text.count("WindowGroupLimit") >= 2


def test_scan_is_pruned_and_filtered(spark, sf_dir):
    from rankloom import catalog

    text = plan(catalog.queries()["s2_parquet_scan"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity" in text
    assert "l_shipdate" not in text


# --- models on planted data ------------------------------------------------------------------


@pytest.fixture(scope="module")
def planted(spark):
    """Relevance follows quality; price is noise."""
    df = spark.range(1200).select(
        (F.col("id") / 6).cast("int").alias("srch_id"),
        F.col("id").alias("prop_id"),
        F.pmod(F.xxhash64(F.col("id"), F.lit(1)), F.lit(1000)).cast("double").alias("quality"),
        F.pmod(F.xxhash64(F.col("id"), F.lit(2)), F.lit(1000)).cast("double").alias("price"),
    )
    rel = F.when(F.col("quality") > 850, 5).when(F.col("quality") > 600, 1).otherwise(0)
    df = df.withColumns({"relevance": rel, "minus_price": -F.col("price")})
    df = df.withColumns(
        {"click_bool": F.when(rel > 0, 1).otherwise(0), "booking_bool": F.when(rel == 5, 1).otherwise(0)}
    )
    return materialise(df)


PARAMS = BoostParams(rounds=3, max_depth=3, min_rows_in_leaf=5, max_bins=32, learning_rate=0.3)


def quality(df, score):
    return metrics.mean_ndcg(df, "srch_id", "relevance", score).first()["ndcg"]


def test_ranking_trees_beat_price_order_and_survive_saving(spark, planted, tmp_path):
    train, val = planted.filter("srch_id % 5 <> 0"), planted.filter("srch_id % 5 = 0")
    model = fit_ranking_trees(train, ["quality", "price"], "srch_id", "relevance", ["prop_id"], PARAMS, val=val)
    scored_rows = model.transform(val)
    assert quality(scored_rows, "score") > quality(val, "minus_price") + 0.1
    assert model.importance(spark).first()["feature"] == "quality"
    model.save(str(tmp_path / "m"))
    again = RankingTrees.load(spark, str(tmp_path / "m")).transform(val)
    assert again.select(F.sum("score")).first()[0] == pytest.approx(scored_rows.select(F.sum("score")).first()[0])


def test_leaf_penalty_shrinks_scores(planted):
    free = fit_ranking_trees(planted, ["quality"], "srch_id", "relevance", ["prop_id"], BoostParams(rounds=1, max_depth=2))
    bound = fit_ranking_trees(
        planted, ["quality"], "srch_id", "relevance", ["prop_id"], BoostParams(rounds=1, max_depth=2, l2=50.0)
    )
    spread = [m.transform(planted).agg(F.max(F.abs("score"))).first()[0] for m in (free, bound)]
    assert 0 < spread[1] < spread[0]


def test_linear_models_find_the_signal(planted):
    roles = ROLES
    model, fill = rankers.logistic_baseline(planted, ["quality", "price"], roles, c=1.0, max_iter=20)
    assert quality(rankers.score(model, planted, fill), "score") > 0.9
    pairwise, fill = rankers.pairwise_logistic(
        planted, ["quality", "price"], "srch_id", "relevance", "minus_price", ["prop_id"], max_iter=20
    )
    assert quality(rankers.score(pairwise, planted, fill), "score") > 0.9


def test_search_leaderboard_and_refit(spark, planted, tmp_path):
    train, val = planted.filter("srch_id % 5 <> 0"), planted.filter("srch_id % 5 = 0")
    small = {"min_data_in_leaf": 5, "max_depth": 2}
    trials = run_trials(train, val, ["quality"], "srch_id", "relevance", ["prop_id"], START_POINTS[:2], 1, small)
    board = leaderboard(trials, 1)
    assert board.count() == 1 and trials.count() == 2
    done = refit_top(
        board, train, val, val, ["quality"], "srch_id", "prop_id", "relevance", ["prop_id"], str(tmp_path), small
    ).first()
    ranking = tables.read_ranking(spark, done["ranking_path"], "srch_id", "prop_id")
    assert ranking.count() == val.count() and ranking.filter("rank = 1").count() == val.select("srch_id").distinct().count()


def test_draws_are_reproducible_and_inside_the_space():
    a, b = draw_settings(5, seed=3), draw_settings(5, seed=3)
    assert a == b and all(20 <= s["num_leaves"] <= 80 and 0.005 <= s["learning_rate"] <= 0.12 for s in a)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    from rankloom.sources import tables

    (tmp_path / "file one.csv").write_text("b,a\n1,x\n2,y\n")
    (tmp_path / "two%20+.csv").write_text("a,c,b\nz,q,3\n")
    for options in ({"columns": ["a", "b"]}, {"schema": "a string, b string"}):
        rows = tables.read_csv(spark, str(tmp_path), **options).collect()
        assert sorted(map(tuple, rows)) == [("x", "1"), ("y", "2"), ("z", "3")]



def test_group_quality_in_one_scan_equals_the_parts(spark):
    from rankloom.operators import fairness, metrics

    rng = random.Random(4)
    rows = [
        (rng.choice([1, 2, 3, 4, None]), rng.choice([0, 1, 5, None]), rng.choice([0.1, 0.5, 0.9, None]), rng.choice([True, False, None]))
        for _ in range(200)
    ] + [(9, 0, 0.3, True)]
    df = spark.createDataFrame(rows, "q int, rel int, s double, fam boolean")
    got = fairness.evaluate_groups(df, "q", "rel", "s", F.col("fam")).first()
    tagged = df.withColumn("inside", F.coalesce(F.col("fam"), F.lit(False)))
    by = {r["inside"]: r["ndcg"] for r in metrics.mean_ndcg(tagged, "q", "rel", "s", by=["inside"]).collect()}
    assert got["ndcg_overall"] == pytest.approx(metrics.mean_ndcg(df, "q", "rel", "s").first()["ndcg"])
    assert got["ndcg_group"] == pytest.approx(by[True]) and got["ndcg_rest"] == pytest.approx(by[False])
    assert got["rows_group"] == sum(bool(r[3]) for r in rows) and got["queries_group"] == len({r[0] for r in rows if r[3]})
