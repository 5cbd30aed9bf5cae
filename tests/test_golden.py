"""Hand-made tables: nulls, ties, one-row queries, bad text, unseen items."""

import math

import pytest
from pyspark.sql import functions as F

from rankloom.functions.columns import clip, row_mean
from rankloom.operators import clean, encode, fairness, features, metrics, profile, quantile, splits, stats
from rankloom.operators.skew import attach, grouped, hot_keys
from rankloom.plans.prepare import RawTypes, type_table
from rankloom.roles import Roles


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_bad_text_becomes_null(spark):
    raw = spark.createDataFrame([("NULL", "1"), ("12x", "NULL"), ("", "0"), ("300", "1")], "a string, b string")
    typed, report = type_table(raw, RawTypes(floats=(), integers=("a",), flags=("b",)))
    assert dict(typed.dtypes) == {"a": "smallint", "b": "tinyint"}
    assert sorted(rows(typed), key=str) == sorted([(None, 1), (None, None), (None, 0), (300, 1)], key=str)
    assert {r["column"]: r["final_dtype"] for r in report.collect()} == {"a": "smallint", "b": "tinyint"}


@pytest.mark.parametrize(
    "low, high, want",
    [(-128, 127, "tinyint"), (-129, 5, "smallint"), (0, 32768, "int"), (0, 2**31, "bigint"), (None, None, "int")],
)
def test_integer_narrowing(spark, low, high, want):
    df = spark.createDataFrame([(low,), (high,)], "x bigint")
    assert clean.integer_plan(df, ["x"])[0]["final_dtype"] == want


def test_absent_columns_are_skipped_with_a_warning(spark):
    df = spark.createDataFrame([("1.5",)], "a string")
    with pytest.warns(UserWarning):
        assert clean.lenient_cast(df, ["a", "gone"]).columns == ["a"]


def test_parse_time(spark):
    df = spark.createDataFrame([("2013-04-04 08:32:15",), ("4/4/2013",), (None,)], "date_time string")
    got = [r[0] for r in clean.parse_time(df).collect()]
    assert str(got[0]) == "2013-04-04 08:32:15" and got[1:] == [None, None]


def test_clip_keeps_nulls_and_open_ends(spark):
    df = spark.createDataFrame([(1, -5.0), (2, None), (3, 50.0)], "i int, x double")
    got = rows(df.select("i", clip("x", 0.0, 10.0), clip("x", 0.0, None)), "i")
    assert got == [(1, 0.0, 0.0), (2, None, None), (3, 10.0, 50.0)]


def test_clip_bounds_are_reused(spark):
    train = spark.createDataFrame([(float(i),) for i in range(1, 1002)], "price double")
    bounds = clean.fit_clip_bounds(train, {"price": (("q", 0.001), ("q", 0.999))})
    assert bounds == {"price": (2.0, 1000.0)}
    test = spark.createDataFrame([(0.0,), (5000.0,)], "price double")
    assert sorted(r[0] for r in clean.apply_clip(test, bounds).collect()) == [2.0, 1000.0]


def test_schema_alignment_and_union(spark):
    a = spark.createDataFrame([(1, 1.0, 1)], "k int, x double, label int").withColumn("x", F.col("x").cast("float"))
    b = spark.createDataFrame([(2, 2.0)], "k bigint, x double")
    assert dict(clean.align_types(b, a).dtypes) == {"k": "int", "x": "float"}
    both = clean.union_common(a, b)
    assert both.columns == ["k", "x"] and both.count() == 2


def test_sparse_columns(spark):
    df = spark.createDataFrame([(1, None, None)] * 19 + [(1, 2, None)], "a int, b int, visitor_hist_adr_usd int")
    assert clean.drop_sparse_columns(df, 0.9).columns == ["a", "visitor_hist_adr_usd"]


def test_categories(spark):
    df = spark.createDataFrame([(None,), (3.0,)], "prop_starrating double")
    assert sorted(r[0] for r in clean.encode_categories(df).collect()) == [-1, 3]


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, None), (3, 2.0, 4.0)], "i int, a double, b double")
    assert rows(df.select("i", row_mean(["a", "b"])), "i") == [(1, 2.0), (2, None), (3, 3.0)]


def test_zero_rooms_and_zero_nights(spark):
    r = Roles()
    df = spark.createDataFrame([(0, 2, 1, 0, 100.0)], f"{r.rooms} int, {r.adults} int, {r.children} int, {r.stay} int, {r.price} double")
    got = df.select(
        features.party_features()["guests_per_room"], features.price_features()["price_per_night"]
    ).first()
    assert got[0] is None and got[1] == 100.0


def test_flags_keep_null_where_the_value_is_missing(spark):
    r = Roles()
    columns = [r.hist_star, r.hist_price, r.star, r.review, r.log_hist_price, r.affinity, r.distance, r.loc2]
    df = spark.createDataFrame([tuple([None] * 8)], ", ".join(f"{c} double" for c in columns))
    got = df.select(*[c.alias(n) for n, c in features.missing_flags().items()]).first().asDict()
    assert got["missing_star_rating_flag"] is None and got["review_score_zero_flag"] is None
    assert got["review_score_missing_flag"] == 1 and got["visitor_history_price_missing"] == 1


def test_relevance_and_targets(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 1), (0, 1)], "click_bool int, booking_bool int")
    got = df.select(
        "click_bool",
        "booking_bool",
        features.graded_relevance("click_bool", "booking_bool"),
        features.first_match_target(),
    ).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 0), (1, 0, 1, 1), (1, 1, 5, 1), (0, 1, 5, 2)]


def test_ordinal_ranks_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (1, 3, None), (1, 4, 1.0), (2, 1, None)], "q int, p int, x double")
    ranks = features.add_ordinal_ranks(df, {"r": "x"}, ["q"], ["p"])
    assert rows(ranks.select("q", "p", "r"), "q", "p") == [(1, 1, 2), (1, 2, 3), (1, 3, None), (1, 4, 1), (2, 1, None)]
    share = features.add_percentile_ranks(df, {"r": "x"}, ["q"], ["p"])
    assert rows(share.select("q", "p", "r"), "q", "p") == [(1, 1, 0.5), (1, 2, 0.75), (1, 3, None), (1, 4, 0.25), (2, 1, None)]
    low = features.add_group_minimum_flag(df.filter("p < 3"), "x", ["q"], "low")
    assert [r["low"] for r in low.filter("q = 1").collect()] == [1, 1]  # all tied minima


def test_one_row_group_has_no_zscore(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (2, 5.0), (3, 4.0), (3, 4.0)], "q int, x double")
    got = rows(stats.normalise(df, "q", "x").select("q", F.round("x_norm_by_q", 6)), "q", "x")
    assert got[0] == (1, None)
    assert [g[1] for g in got[1:3]] == [-0.707107, 0.707107]
    assert got[3] == (3, None)  # no spread


def test_group_transform_names_its_key(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (None, 1, 9.0)], "a int, b int, x double")
    out = stats.group_transform(df, "a", "x", ["mean", "median"], {"mean": ["subtract"], "median": ["divide"]})
    assert out.count() == 2  # a row without a key is dropped
    assert {"x_mean_by_a", "x_subtract_mean_by_a", "x_divide_median_by_a"} <= set(out.columns)


def test_unseen_keys_get_the_prior(spark):
    seen = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0)], "prop_id int, click_bool int, booking_bool int")
    new = spark.createDataFrame([(1,), (3,), (None,)], "prop_id int")
    got = {r["prop_id"]: r for r in encode.apply_rates(new, seen, ["prop_id"], encode.ITEM_TARGETS).collect()}
    assert got[1]["prop_ctr_oof"] == pytest.approx((2 + 50 * 2 / 3) / 52)
    assert got[3]["prop_ctr_oof"] == pytest.approx(2 / 3) and got[None]["prop_ctr_oof"] == pytest.approx(2 / 3)


def test_item_only_in_its_own_fold_gets_the_prior(spark):
    df = spark.createDataFrame(
        [(1, 7, 1, 1, 0), (1, 8, 0, 0, 0), (2, 8, 1, 0, 1), (3, 8, 0, 0, 2), (4, 9, 1, 1, 1)],
        "srch_id int, prop_id int, click_bool int, booking_bool int, fold int",
    )
    got = encode.encode_out_of_fold(df, ["prop_id"], encode.ITEM_TARGETS, "fold").filter("prop_id = 7").first()
    assert got["prop_ctr_oof"] == pytest.approx(3 / 5) and got["prop_booking_rate_oof"] == pytest.approx(2 / 5)


def ndcg_rows(spark):
    return spark.createDataFrame(
        [
            (1, 1, 5, 0.1), (1, 2, 0, 0.9), (1, 3, 1, 0.5),  # an ordinary query
            (2, 1, 0, 0.3), (2, 2, 0, 0.2), (2, 3, 0, 0.1),  # nothing relevant
            (3, 1, 1, 0.7),  # one item
            (4, 1, 5, 0.5), (4, 2, 0, 0.5),  # a tie
        ],
        "q int, p int, rel int, s double",
    )


def test_ndcg_by_hand(spark):
    got = {r["q"]: r for r in metrics.ndcg_per_query(ndcg_rows(spark), "q", "rel", "s").collect()}
    want = (1 / math.log2(3) + 5 / math.log2(4)) / (5 + 1 / math.log2(3))
    assert got[1]["ndcg"] == pytest.approx(want)
    assert got[2]["ndcg"] is None and got[2]["idcg"] == 0
    assert got[3]["ndcg"] == pytest.approx(1)
    assert got[4]["dcg"] == pytest.approx(2.5 * (1 + 1 / math.log2(3)))
    broken = {r["q"]: r for r in metrics.ndcg_per_query(ndcg_rows(spark), "q", "rel", "s", ties="break", tie_keys=["p"]).collect()}
    assert broken[4]["ndcg"] == pytest.approx(1)


@pytest.mark.parametrize("empty, queries", [("zero", 4), ("one", 4), ("skip", 3)])
def test_empty_query_policies(spark, empty, queries):
    got = metrics.mean_ndcg(ndcg_rows(spark), "q", "rel", "s", empty=empty).first()
    skip = metrics.mean_ndcg(ndcg_rows(spark), "q", "rel", "s", empty="skip").first()
    assert got["queries"] == queries
    extra = {"zero": 0, "one": 1, "skip": 0}[empty]
    assert got["ndcg"] * queries == pytest.approx(skip["ndcg"] * 3 + extra)


def test_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "children int")
    inside = F.col("children") > 0
    plain = fairness.add_group_weights(df, inside, swap=False)
    assert plain.agg(F.sum("weight")).first()[0] == pytest.approx(4)
    swapped = {r["children"]: r["weight"] for r in fairness.add_group_weights(df, inside).collect()}
    assert swapped == {0: pytest.approx(2.0), 1: pytest.approx(4 / 6)}
    mean = fairness.add_group_weights(df, inside, normalise=True).agg(F.avg("weight")).first()[0]
    assert mean == pytest.approx(1)


def test_comparison_uses_absolute_gaps(spark):
    names = "ndcg_overall double, ndcg_group double, ndcg_rest double, gap double"
    before = spark.createDataFrame([(0.42, 0.43, 0.42, -0.01)], names)
    after = spark.createDataFrame([(0.42, 0.40, 0.43, 0.03)], names)
    got = {r["metric"]: r["improved"] for r in fairness.compare(before, after).collect()}
    assert got["gap"] == 0 and got["ndcg_rest"] == 1 and got["ndcg_group"] == 0


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 9, 10)] + [(None,)], "x double")
    got = {r["bin"]: r["rows"] for r in profile.histogram(df, "x", 10).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 9: 2}


def test_quantile_rules(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    for large in (False, True):
        for method, want in (("nearest", 3.0), ("linear", 2.5), ("disc", 2.0)):
            got = quantile.quantiles(df, ["x"], [0.5], method, large).first()["quantiles"]
            assert got == [want], (method, large)


def test_missing_report_order(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b int")
    assert rows(profile.missing_report(df)) == [("b", 2, 1.0), ("a", 0, 0.0)]
    assert rows(profile.missing_report(df, only_missing=True)) == [("b", 2, 1.0)]


def test_blocks_do_not_cut_queries(spark):
    df = spark.createDataFrame([(q, p) for q in range(20) for p in range(q % 3 + 1)], "q int, p int")
    numbered = splits.add_block(df, "q", 4)
    per = numbered.groupBy("q").agg(F.count_distinct("block").alias("n"))
    assert per.filter("n > 1").isEmpty()
    sizes = [r[0] for r in numbered.groupBy("block").agg(F.count_distinct("q")).select("count(DISTINCT q)").collect()]
    assert sorted(sizes) == [5, 5, 5, 5]


def test_blocks_of_keys_beyond_double_precision(spark):
    df = spark.range(8).select((F.lit(2**53).cast("bigint") + F.col("id")).alias("q"))
    sizes = splits.add_block(df, "q", 4).groupBy("block").count().orderBy("block").collect()
    assert [r["count"] for r in sizes] == [2, 2, 2, 2]
    assert splits.block_bounds(df.limit(0), "q", 4) == [] == splits.block_bounds(df, "q", 1)


def test_ndcg_keeps_rows_without_a_query(spark):
    df = spark.createDataFrame([(None, 1.0, 0.5), (None, 0.0, 0.1), (1, 0.0, 0.9), (1, 5.0, 0.1)], "q int, rel double, s double")
    got = {r["q"]: r["ndcg"] for r in metrics.ndcg_per_query(df, "q", "rel", "s").collect()}
    assert set(got) == {None, 1} and got[None] == 1.0 and got[1] == pytest.approx(1 / math.log2(3))


def all_pairs(rows):
    """Pairs (query, winner, loser) of different grades, by trying all."""
    return sorted(
        ((q, a, b) for q, a, g in rows for p, b, h in rows if p == q and g > h), key=str
    )


def test_pairs_are_not_cut(spark):
    """Also where both rows are far down, in hot queries, and for rows without a query."""
    from rankloom.operators import pairs

    made = [(q, i, float(i % 7 == 6) + 4.0 * (i == n - 1)) for q, n in ((1, 15), (2, 40), (3, 60), (None, 9)) for i in range(n)]
    df = spark.createDataFrame([(q, i, g, -float(i)) for q, i, g in made], "q int, i int, rel double, s double")
    hot = hot_keys(df, ["q"], 8)
    assert {r["q"] for r in hot.collect()} == {1, 2, 3, None}
    spark.conf.set("spark.rankloom.hotRows", "8")
    try:
        for h in (None, hot):
            out = pairs.preference_pairs(df, "q", "rel", "s", ["i"], ["i"], weighted=True, hot=h)
            assert sorted(((r["q"], r["i_win"], r["i_lose"]) for r in out.collect()), key=str) == all_pairs(made)
    finally:
        spark.conf.unset("spark.rankloom.hotRows")
    few = pairs.preference_pairs(df, "q", "rel", "s", ["i"], ["i"], truncation=10)
    assert sorted(((r["q"], r["i_win"], r["i_lose"]) for r in few.collect()), key=str) == [
        p for p in all_pairs(made) if min(p[1:]) < 10
    ]


# --- hot keys -------------------------------------------------------------------------------


def skewed(spark, n=400):
    """Key 0 holds half of the rows; key NULL a few."""
    df = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 2 == 0, 0).when(F.col("id") % 37 == 0, None).otherwise(F.col("id") % 20).alias("k"),
        (F.col("id") * 7919 % 53).cast("double").alias("x"),
    )
    return df.withColumn("x", F.when(F.col("id") % 11 != 0, F.col("x")))


def test_hot_keys_are_found(spark):
    assert [r["k"] for r in hot_keys(skewed(spark), ["k"], 50).collect()] == [0]
    assert hot_keys(skewed(spark), ["k"], 1000) is None


def test_every_hot_key_is_split(spark):
    """However many there are, and when their table is too large to be sent."""
    df = spark.range(1000).withColumn("k", F.col("id") % 4)
    assert {(r["k"], r["_n"]) for r in hot_keys(df, ["k"], 100).collect()} == {(k, 250) for k in range(4)}


def test_hot_and_ordinary_paths_agree(spark):
    df = skewed(spark)

    def build(part, groups):
        part = groups.attach(part, m=F.avg("x"), n=F.count(F.lit(1)))
        return groups.ordinal(part, r=features.ascending("x", ["id"]))

    plain = grouped(df, ["k"], build, None)
    spread = grouped(df, ["k"], build, hot_keys(df, ["k"], 50))
    assert rows(plain.select("id", "k", F.round("m", 9), "n", "r"), "id") == rows(
        spread.select("id", "k", F.round("m", 9), "n", "r"), "id"
    )


def test_attach_variants_agree(spark, monkeypatch):
    from rankloom.operators import skew

    df = skewed(spark)
    per_key = df.groupBy("k").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    broadcast = rows(attach(df, per_key.drop("n"), ["k"]).select("id", F.round("m", 9)), "id")
    monkeypatch.setattr(skew, "BROADCAST_VALUES", 0)
    plain = rows(attach(df, per_key.drop("n"), ["k"]).select("id", F.round("m", 9)), "id")
    salted = rows(attach(df, per_key.drop("n"), ["k"], limit=30).select("id", F.round("m", 9)), "id")
    sized = rows(attach(df, per_key, ["k"], "n", ["id"], limit=30).select("id", F.round("m", 9)), "id")
    assert broadcast == plain == salted == sized and len(plain) == 400


def test_hot_medians_agree(spark):
    df = skewed(spark)
    plain = quantile.group_medians(df, ["k"], {"x": "med"}, None)
    spread = quantile.group_medians(df, ["k"], {"x": "med"}, hot_keys(df, ["k"], 50))
    assert rows(plain, "k") == rows(spread, "k")
