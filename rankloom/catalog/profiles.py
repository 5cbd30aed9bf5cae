"""Profiling tables and the tables behind plots."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.impressions import ROLES, TIES, impressions, ordinal, r, with_impressions
from rankloom.catalog.registry import register
from rankloom.catalog.tables import nearest
from rankloom.operators import profile

ALL_COLUMNS = (
    "srch_id", "prop_id", "srch_destination_id", "visitor_location_country_id", "prop_country_id", "date_time",
    "position", "random_bool", "price_usd", "prop_starrating", "prop_review_score", "prop_location_score1",
    "prop_location_score2", "prop_log_historical_price", "promotion_flag", "srch_length_of_stay",
    "srch_booking_window", "srch_adults_count", "srch_children_count", "srch_room_count", "visitor_hist_starrating",
    "visitor_hist_adr_usd", "srch_query_affinity_score", "orig_destination_distance", "comp1_rate", "comp2_rate",
    "comp1_inv", "comp2_inv", "comp1_rate_percent_diff", "comp2_rate_percent_diff", "click_bool", "booking_bool",
    "split", "tiebreak_ts",
)
NUMERIC = tuple(c for c in ALL_COLUMNS if c not in ("date_time", "split", "tiebreak_ts"))


@register("p1_overview", with_impressions(f"select count(*) as rows, cast({len(ALL_COLUMNS)} as int) as columns from imp"))
def p1(spark, sf):
    return profile.overview(impressions(spark, sf))


def _missing_sql(where: str = "") -> str:
    parts = [
        f"select '{c}' as variable, count(*) - count({c}) as missing_count, (count(*) - count({c})) / count(*) as f from imp"
        for c in ALL_COLUMNS
    ]
    return with_impressions(
        f"select variable, missing_count, {r('f', 'missing_fraction')} from m {where}", m=" union all ".join(parts)
    )


@register("p2_missing_values", _missing_sql())
def p2(spark, sf):
    return profile.missing_report(impressions(spark, sf))


@register("p3_missing_values_present", _missing_sql("where missing_count > 0"))
def p3(spark, sf):
    return profile.missing_report(impressions(spark, sf), only_missing=True)


def _summary_sql() -> str:
    parts = []
    for c in NUMERIC:
        quant = ", ".join(r(nearest(c, p), n) for n, p in profile.SUMMARY_PROBS.items())
        parts.append(
            f"select '{c}' as variable, count(*) - count({c}) as missing_count, "
            f"{r(f'(count(*) - count({c})) / count(*)', 'missing_fraction')}, {r(f'avg({c})', 'mean')}, "
            f"{r(f'stddev_samp({c})', 'std')}, {r(f'min({c})', 'min')}, {quant}, {r(f'median({c})', 'median')}, "
            f"{r(f'max({c})', 'max')} from imp"
        )
    return with_impressions(" union all ".join(parts))


@register("p4_numeric_summary", _summary_sql())
def p4(spark, sf):
    return profile.numeric_summary(impressions(spark, sf).select(*NUMERIC))


@register("p4_numeric_summary_range_sorted", _summary_sql())
def p4_large(spark, sf):
    """The same by the plan for tables too large for one window per column."""
    return profile.numeric_summary(impressions(spark, sf).select(*NUMERIC), large=True)


_FLAGS = ("promotion_flag", "random_bool", "click_bool", "booking_bool", "comp1_inv")


@register(
    "p5_boolean_summary",
    with_impressions(
        " union all ".join(
            f"select '{c}' as variable, count(*) filter (where {c} = 0) as count_0, "
            f"{r(f'count(*) filter (where {c} = 0) / count(*)', 'fraction_0')}, "
            f"count(*) filter (where {c} = 1) as count_1, "
            f"{r(f'count(*) filter (where {c} = 1) / count(*)', 'fraction_1')} from imp"
            for c in _FLAGS
        )
    ),
)
def p5(spark, sf):
    return profile.boolean_summary(impressions(spark, sf), _FLAGS)


def _describe_sql() -> str:
    parts = []
    for c in NUMERIC:
        quant = ", ".join(r(f"quantile_cont({c}, {p})", n) for n, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75)))
        parts.append(
            f"select '{c}' as variable, count({c}) as count, {r(f'avg({c})', 'mean')}, {r(f'stddev_samp({c})', 'std')}, "
            f"{r(f'min({c})', 'min')}, {quant}, {r(f'max({c})', 'max')} from imp"
        )
    return with_impressions(" union all ".join(parts))


@register("p6_describe", _describe_sql())
def p6(spark, sf):
    return profile.describe(impressions(spark, sf), NUMERIC)


_REPORT = ("price_usd", "srch_booking_window", "srch_length_of_stay")


def _report_sql(split: str) -> str:
    parts = []
    for c in _REPORT:
        quant = ", ".join(r(nearest(c, p), n) for n, p in profile.REPORT_PROBS.items())
        parts.append(
            f"select '{c}' as variable, {r(f'min({c})', 'min')}, {quant}, {r(f'max({c})', 'max')}, "
            f"'{split}' as split from imp where split = '{split}'"
        )
    return " union all ".join(parts)


@register("p7_quantiles", with_impressions(f"{_report_sql('train')} union all {_report_sql('test')}"))
def p7(spark, sf):
    df = impressions(spark, sf)
    parts = [
        profile.quantile_report(df.filter(F.col("split") == s), _REPORT).withColumn("split", F.lit(s))
        for s in ("train", "test")
    ]
    return parts[0].unionByName(parts[1])


@register(
    "p7_quantiles_linear",
    with_impressions(
        " union all ".join(
            f"select '{c}' as variable, {r(f'min({c})', 'min')}, "
            + ", ".join(r(f"quantile_cont({c}, {p})", n) for n, p in profile.REPORT_PROBS.items())
            + f", {r(f'max({c})', 'max')} from imp"
            for c in ("price_usd", "orig_destination_distance")
        )
    ),
)
def p7_linear(spark, sf):
    return profile.quantile_report(
        impressions(spark, sf), ["price_usd", "orig_destination_distance"], method="linear", large=True
    )


@register(
    "p8_query_sizes",
    with_impressions(
        "select query_size, count(*) as queries from (select srch_id, count(*) as query_size from imp group by 1) group by 1"
    ),
)
def p8(spark, sf):
    return profile.query_sizes(impressions(spark, sf), "srch_id")


def hist_sql(value: str, bins: int, by: str = "", share: bool = False, source: str = "imp") -> dict[str, str]:
    b = f"{by}, " if by else ""
    over = f"(partition by {by})" if by else "()"
    extra = f", {r(f'count(*) / sum(count(*)) over {over}', 'share')}" if share else ""
    return {
        "d": f"select {b}{value} as x from {source} where {value} is not null",
        "e": f"select min(x) as lo, (max(x) - min(x)) / {bins} as w from d",
        "h": f"select {b}cast(least(floor((x - lo) / w), {bins - 1}) as int) as bin, lo, w from d, e",
        "body": f"select {b}bin, {r('min(lo) + bin * min(w)', 'low')}, {r('min(lo) + (bin + 1) * min(w)', 'high')}, "
        f"count(*) as rows{extra} from h group by {b}bin",
    }


def _hist(value: str, bins: int, by: str = "", share: bool = False) -> str:
    parts = hist_sql(value, bins, by, share)
    body = parts.pop("body")
    return with_impressions(body, **parts)


@register("p9_price_histogram", _hist("price_usd", 100))
def p9(spark, sf):
    return profile.histogram(impressions(spark, sf), "price_usd", 100)


@register("p9_star_histogram", _hist("cast(prop_starrating as double)", 10))
def p9_star(spark, sf):
    return profile.histogram(impressions(spark, sf), "prop_starrating", 10)


@register("p10_log_price_histogram", _hist("ln(1 + price_usd)", 100))
def p10(spark, sf):
    return profile.log_histogram(impressions(spark, sf), "price_usd", 100)


@register("p10_log_stay_histogram", _hist("ln(1 + srch_length_of_stay)", 100))
def p10_stay(spark, sf):
    return profile.log_histogram(impressions(spark, sf), "srch_length_of_stay", 100)


@register("p11_price_by_booking", _hist("price_usd", 80, "booking_bool"))
def p11(spark, sf):
    return profile.histogram(impressions(spark, sf), "price_usd", 80, ["booking_bool"])


@register("p11_log_price_by_booking", _hist("ln(1 + price_usd)", 80, "booking_bool"))
def p11_log(spark, sf):
    return profile.log_histogram(impressions(spark, sf), "price_usd", 80, ["booking_bool"])


@register("p11_review_by_booking", _hist("prop_review_score", 80, "booking_bool"))
def p11_review(spark, sf):
    return profile.histogram(impressions(spark, sf), "prop_review_score", 80, ["booking_bool"])


@register("p11_location2_by_booking", _hist("ln(1 + prop_location_score2)", 80, "booking_bool"))
def p11_loc2(spark, sf):
    return profile.log_histogram(impressions(spark, sf), "prop_location_score2", 80, ["booking_bool"])


@register(
    "p12_query_price_stats",
    with_impressions(
        f"select srch_id, {r('avg(price_usd)', 'query_price_mean')}, {r('stddev_samp(price_usd)', 'query_price_std')} from imp group by 1"
    ),
)
def p12(spark, sf):
    return profile.query_price_stats(impressions(spark, sf), "srch_id", "price_usd")


_P12 = hist_sql("s", 80, source="q")


@register(
    "p12_query_price_std_histogram",
    with_impressions(
        _P12["body"],
        q="select srch_id, coalesce(stddev_samp(price_usd), 0) as s from imp group by 1",
        **{k: v for k, v in _P12.items() if k != "body"},
    ),
)
def p12_hist(spark, sf):
    """Distribution of the per-query deviation; one-row queries count as 0."""
    per = profile.query_price_stats(impressions(spark, sf), "srch_id", "price_usd")
    return profile.histogram(per, F.coalesce("query_price_std", F.lit(0.0)), 80)


@register(
    "p13_target_rates",
    with_impressions(
        f"select {r('avg(click_bool)', 'ctr')}, {r('avg(booking_bool)', 'booking_rate')}, "
        f"{r('avg(booking_bool / (click_bool + 1e-6))', 'booking_given_click')} from imp"
    ),
)
def p13(spark, sf):
    return profile.target_rates(impressions(spark, sf), "click_bool", "booking_bool")


@register(
    "p14_query_target_rates",
    with_impressions(
        f"select srch_id, {r('avg(click_bool)', 'query_ctr')}, {r('avg(booking_bool)', 'query_booking_rate')}, "
        "count(*) as query_size from imp group by 1"
    ),
)
def p14(spark, sf):
    return profile.query_target_rates(impressions(spark, sf), "srch_id", "click_bool", "booking_bool")


@register(
    "p15_booking_rate_by_query_size",
    with_impressions(
        f"select n as query_size, {r('avg(b)', 'avg_booking_rate')} from "
        "(select srch_id, count(*) as n, avg(booking_bool) as b from imp group by 1) group by 1"
    ),
)
def p15(spark, sf):
    return profile.booking_rate_by_query_size(impressions(spark, sf), "srch_id", "click_bool", "booking_bool")


@register(
    "p16_booking_rate_by_price_rank",
    with_impressions(
        f"select price_rank, {r('avg(booking_bool)', 'booking_rate')}, count(*) as rows from "
        f"(select booking_bool, {ordinal('price_usd')} as price_rank from imp) group by 1"
    ),
)
def p16(spark, sf):
    """Which in-query price rank gets booked most."""
    return profile.booking_rate_by_rank(impressions(spark, sf), "srch_id", "price_usd", "booking_bool", TIES)


@register("p17_log_price_shift", _hist("ln(1 + price_usd)", 100, "split", share=True))
def p17(spark, sf):
    df = impressions(spark, sf)
    return profile.shift_histogram(
        df.filter("split = 'train'"), df.filter("split = 'test'"), "price_usd", 100, log=True
    )


@register("p17_item_shift", _hist("prop_id", 100, "split", share=True))
def p17_item(spark, sf):
    df = impressions(spark, sf)
    return profile.shift_histogram(df.filter("split = 'train'"), df.filter("split = 'test'"), "prop_id", 100)


_NULLABLE = (
    "prop_review_score", "prop_location_score2", "visitor_hist_starrating", "visitor_hist_adr_usd", "srch_query_affinity_score",
    "orig_destination_distance", "comp1_rate", "comp2_rate", "comp1_inv", "comp2_inv", "comp1_rate_percent_diff", "comp2_rate_percent_diff",
)


def _spearman_ctes() -> dict[str, str]:
    """One part for each set of rows with the ranks in it, then ``p`` with all pairs."""
    full = [c for c in NUMERIC if c not in _NULLABLE]
    wanted = [([], full, [(a, b) for i, a in enumerate(full) for b in full[i + 1 :]])]
    wanted += [([a], [*full, a], [(a, c) for c in full]) for a in _NULLABLE]
    wanted += [([a, b], [a, b], [(a, b)]) for i, a in enumerate(_NULLABLE) for b in _NULLABLE[i + 1 :]]
    parts, picks = {}, []
    for k, (present, columns, pairs) in enumerate(wanted):
        ranks = ", ".join(
            f"rank() over (order by {c}) + (count(*) over (order by {c} range between current row and current row) - 1) / 2.0e0 as {c}" for c in columns
        )
        where = " and ".join(f"{c} is not null" for c in present) or "true"
        parts[f"s{k}"] = f"select {ranks} from imp where {where}"
        named = [sorted(pair, key=NUMERIC.index) for pair in pairs]
        found = ", ".join(f"struct_pack(f1 := '{a}', f2 := '{b}', c := corr({a}, {b}))" for a, b in named)
        picks.append(f"select unnest([{found}], recursive := true) from s{k}")
    # NaN where a column has no spread
    parts["q"] = " union all ".join(picks)
    parts["p"] = "select f1, f2, case when isnan(c) then null else c end as c from q"
    return parts


@register("p18_spearman", with_impressions(f"select f1, f2, {r('c', 'corr')} from p", **_spearman_ctes()))
def p18(spark, sf):
    """Pairwise-complete rank correlations."""
    return profile.spearman(impressions(spark, sf), NUMERIC)


@register("p18_spearman_range_sorted", with_impressions(f"select f1, f2, {r('c', 'corr')} from p", **_spearman_ctes()))
def p18_large(spark, sf):
    """The same with the ranks of all columns but those of few values joined instead of sent."""
    return profile.spearman(impressions(spark, sf), NUMERIC, sent=2000)


@register(
    "p19_strongest_pairs",
    with_impressions(
        f"select f1, f2, {r('c', 'corr')} from p order by abs(coalesce(c, 0)) desc, f1, f2 limit 30", **_spearman_ctes()
    ),
)
def p19(spark, sf):
    return profile.strongest_pairs(profile.spearman(impressions(spark, sf), NUMERIC), 30)


@register(
    "p20_group_shares",
    with_impressions(
        f"""select cast(srch_children_count > 0 as int) as in_group, count(*) as rows,
        {r('count(*) / sum(count(*)) over ()', 'share')}, {r('avg(booking_bool)', 'label_rate')} from imp group by 1"""
    ),
)
def p20(spark, sf):
    from rankloom.operators.fairness import group_shares

    return group_shares(impressions(spark, sf), F.col(ROLES.children) > 0, "booking_bool")


