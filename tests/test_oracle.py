"""A cross-section of the registered queries against their SQL at the smallest scale.

``python check.py`` runs all of them.
"""

import duckdb
import pytest

import check
from rankloom import catalog

NAMES = (
    "c6_clip_outliers",
    "p4_numeric_summary_range_sorted",
    "p11_price_by_booking",
    "p16_booking_rate_by_price_rank",
    "p18_spearman",
    "f4_f10_composite_features",
    "f21_f23_calendar_features",
    "w1_ranks_with_hot_query",
    "x2_base_features",
    "g2_item_profile_with_hot_item",
    "g9_r5_r7_market_zscores",
    "g12_group_transform_with_hot_market",
    "j1_left_join_hot_key",
    "k3_query_blocks",
    "t2_out_of_fold_item_rates",
    "t5_apply_market_item_rates",
    "t3_refreshed_item_rates",
    "g7_refreshed_market_stats",
    "x3_feature_table",
    "x4_classic_features",
    "m1_ndcg_per_query",
    "m4_tie_averaged_ndcg",
    "e3_preference_pairs_truncated",
    "e4_lambda_gradients_hot_query",
    "q1_quality_per_group",
    "q6_fairness_comparison",
)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def test_every_query_has_a_plain_name():
    names = catalog.queries()
    assert set(catalog.oracle_sql()) <= set(names)
    assert not [n for n in names if "pipeline" in n]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf_dir, con, name):
    result = check.compare(catalog.queries()[name](spark, sf_dir), con, catalog.oracle_sql()[name])
    assert result == "ok"
