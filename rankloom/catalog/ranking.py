"""Rank metrics, rankings, preference pairs, lambda gradients, fairness."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.impressions import KEYS, ROLES, TIE_SQL, TIES, impressions, r, rs, with_impressions
from rankloom.catalog.registry import register
from rankloom.catalog.tables import SCORE_SQL, TRIAL_SCORES, scratch, trial_table
from rankloom.operators import fairness, features, metrics, pairs
from rankloom.operators.rankers import rank_items
from rankloom.plans.search import leaderboard
from rankloom.sources import tables

KEY_SQL = ", ".join(KEYS)
REL_SQL = "5 * booking_bool + click_bool * (1 - booking_bool)"
STAR = "prop_starrating"  # a score with many ties


def scored(spark, sf, expr: str = SCORE_SQL):
    return impressions(spark, sf).withColumns(
        {"relevance": features.graded_relevance("click_bool", "booking_bool"), "score": F.expr(expr).cast("double")}
    )


def ndcg_sql(source: str = "s", by: str = "srch_id", k: int = 5, average: bool = True) -> dict[str, str]:
    """dcg, idcg and ndcg per query over (relevance, score) rows of ``source``."""
    gain = f"avg(relevance) over (partition by {by}, score)" if average else "relevance"
    return {
        "placed": f"select {by}, {gain} as gain, relevance, "
        f"row_number() over (partition by {by} order by score desc nulls last, {TIE_SQL}) as spot, "
        f"row_number() over (partition by {by} order by relevance desc, {TIE_SQL}) as best from {source}",
        "nd": f"select {by}, sum(case when spot <= {k} then gain / log2(spot + 1) else 0 end) as dcg, "
        f"sum(case when best <= {k} then relevance / log2(best + 1) else 0 end) as idcg from placed group by {by}",
    }


def _scored_sql(expr: str = SCORE_SQL) -> str:
    return f"select *, {REL_SQL} as relevance, cast({expr} as double) as score from imp"


@register(
    "m1_ndcg_per_query",
    with_impressions(
        f"select srch_id, {rs('dcg', 'idcg')}, {r('dcg / nullif(idcg, 0)', 'ndcg')} from nd",
        s=_scored_sql(),
        **ndcg_sql(average=False),
    ),
)
def m1(spark, sf):
    """Ties broken by the tie keys."""
    return metrics.ndcg_per_query(scored(spark, sf), "srch_id", "relevance", "score", 5, "break", TIES)


@register(
    "m2_mean_ndcg_all_queries",
    with_impressions(
        f"select {r('avg(coalesce(dcg / nullif(idcg, 0), 0))', 'ndcg')}, count(*) as queries from nd",
        s=_scored_sql(),
        **ndcg_sql(),
    ),
)
def m2(spark, sf):
    """A query without a relevant item counts as 0."""
    return metrics.mean_ndcg(scored(spark, sf), "srch_id", "relevance", "score", empty="zero")


@register(
    "m3_mean_ndcg_relevant_queries",
    with_impressions(
        f"select {r('avg(dcg / idcg)', 'ndcg')}, count(*) as queries from nd where idcg > 0", s=_scored_sql(), **ndcg_sql()
    ),
)
def m3(spark, sf):
    return metrics.mean_ndcg(scored(spark, sf), "srch_id", "relevance", "score", empty="skip")


@register(
    "m4_tie_averaged_ndcg",
    with_impressions(
        f"select srch_id, {rs('dcg', 'idcg')}, {r('dcg / nullif(idcg, 0)', 'ndcg')} from nd", s=_scored_sql(STAR), **ndcg_sql()
    ),
)
def m4(spark, sf):
    """Equal scores share their mean relevance."""
    return metrics.ndcg_per_query(scored(spark, sf, STAR), "srch_id", "relevance", "score")


@register(
    "m4_ndcg_with_hot_query",
    with_impressions(
        f"select qid, {rs('dcg', 'idcg')}, {r('dcg / nullif(idcg, 0)', 'ndcg')} from nd",
        s=f"select *, case when srch_id % 3 = 0 then 0 else srch_id end as qid, {REL_SQL} as relevance, "
        f"cast({SCORE_SQL} as double) as score from imp",
        **ndcg_sql(by="qid", k=50),
    ),
)
def m4_hot(spark, sf):
    """A third of all rows in one query, cut-off 50."""
    df = scored(spark, sf).withColumn("qid", F.expr("case when srch_id % 3 = 0 then 0 else srch_id end"))
    return metrics.ndcg_per_query(df, "qid", "relevance", "score", k=50)


_GAP = ndcg_sql(by="split, srch_id")


@register(
    "m5_train_test_gap",
    with_impressions(
        f"""select {r("avg(n) filter (where split = 'train')", 'train_ndcg')}, {r("avg(n) filter (where split = 'test')", 'val_ndcg')},
        {r("avg(n) filter (where split = 'train') - avg(n) filter (where split = 'test')", 'gap')}
        from (select split, dcg / nullif(idcg, 0) as n from nd)""",
        s=_scored_sql(),
        **_GAP,
    ),
)
def m5(spark, sf):
    return metrics.train_val_gap(scored(spark, sf), "srch_id", "relevance", "score", "split", val="test")


# --- rankings ---------------------------------------------------------------------------


@register(
    "e8_o2_ranked_output",
    with_impressions(
        f"select srch_id, prop_id, row_number() over (partition by srch_id order by score desc nulls last, {TIE_SQL}) as rank from s",
        s=_scored_sql(),
    ),
)
def e8(spark, sf):
    return rank_items(scored(spark, sf), "srch_id", "prop_id", "score", TIES)


@register(
    "o3_top_items_by_bookings",
    with_impressions("select prop_id, sum(booking_bool)::bigint as bookings, count(*) as shown from imp group by 1 order by 2 desc, 3, 1 limit 20"),
)
def o3(spark, sf):
    """A top-20 report."""
    per = impressions(spark, sf).groupBy("prop_id").agg(
        F.sum("booking_bool").alias("bookings"), F.count(F.lit(1)).alias("shown")
    )
    return per.orderBy(F.col("bookings").desc(), "shown", "prop_id").limit(20)


@register(
    "o4_top_k_per_query",
    with_impressions(
        f"select {KEY_SQL}, rank from (select *, row_number() over (partition by srch_id order by score desc nulls last, {TIE_SQL}) as rank from s) where rank <= 3",
        s=_scored_sql(),
    ),
)
def o4(spark, sf):
    return metrics.top_k(scored(spark, sf), "srch_id", "score", TIES, 3).select(*KEYS, "rank")


# --- pairs and lambdas ------------------------------------------------------------------------


def _pair_parts(truncation: int | None, expr: str = SCORE_SQL, qid: str = "srch_id") -> dict[str, str]:
    """Every pair of a query with different grades and, if given, one row within the truncation level."""
    return {
        "s": f"select *, {qid} as qid, {REL_SQL} as relevance, cast({expr} as double) as score from imp",
        "ranked": f"select *, row_number() over (partition by qid order by score desc nulls last, {TIE_SQL}, srch_id) as rk, "
        "row_number() over (partition by qid order by relevance desc) as best from s",
        "ideal": f"select qid, sum(relevance / log2(best + 1)) as idcg from ranked where best <= {truncation or 10} group by qid",
        "pr": f"""select w.qid, w.prop_id as prop_id_win, l.prop_id as prop_id_lose, w.relevance as rel_win, l.relevance as rel_lose,
            w.rk as rank_win, l.rk as rank_lose,
            (w.relevance - l.relevance) * abs(1 / log2(w.rk + 1) - 1 / log2(l.rk + 1)) / idcg as delta,
            1 / (1 + exp(w.score - l.score)) as rho
            from ranked w join ranked l on w.qid = l.qid and w.relevance > l.relevance
            join ideal on ideal.qid = w.qid{f' where least(w.rk, l.rk) <= {truncation}' if truncation else ''}""",
    }


@register(
    "e3_preference_pairs",
    with_impressions(
        f"""select qid as srch_id, prop_id_win, prop_id_lose, {r('rel_win')}, {r('rel_lose')}, rank_win, rank_lose, {r('delta')} from pr""",
        **_pair_parts(None),
    ),
)
def e3(spark, sf):
    """All pairs of different grades, weighted."""
    return pairs.preference_pairs(
        scored(spark, sf), "srch_id", "relevance", "score", [*TIES, "srch_id"], ["prop_id"], weighted=True
    )


@register(
    "e3_preference_pairs_hot_query",
    with_impressions(
        f"""select qid, prop_id_win, prop_id_lose, {r('rel_win')}, {r('rel_lose')}, rank_win, rank_lose, {r('delta')} from pr""",
        **_pair_parts(None, qid="case when srch_id % 50 = 0 then 0 else srch_id end"),
    ),
)
def e3_hot(spark, sf):
    """All pairs, one query holding a fiftieth of all rows and cut into pieces of 100 rows."""
    df = scored(spark, sf).withColumn("qid", F.expr("case when srch_id % 50 = 0 then 0 else srch_id end"))
    return pairs.preference_pairs(df, "qid", "relevance", "score", [*TIES, "srch_id"], ["prop_id"], weighted=True, limit=100)


@register(
    "e3_preference_pairs_truncated",
    with_impressions(
        f"""select qid as srch_id, prop_id_win, prop_id_lose, {r('rel_win')}, {r('rel_lose')}, rank_win, rank_lose from pr""",
        **_pair_parts(2),
    ),
)
def e3_short(spark, sf):
    return pairs.preference_pairs(
        scored(spark, sf), "srch_id", "relevance", "score", [*TIES, "srch_id"], ["prop_id"], truncation=2
    )


_LAMBDA_SQL = """
    sum(case when side = 1 then delta * rho else -delta * rho end) as lam, sum(delta * rho * (1 - rho)) as hes
    from (select qid, rank_win as rk, 1 as side, delta, rho from pr
          union all select qid, rank_lose, 0, delta, rho from pr) group by qid, rk
"""


def _lambda_query(truncation: int, expr: str, qid: str = "srch_id") -> str:
    return with_impressions(
        f"select {KEY_SQL}, {r('coalesce(lam, 0)', 'lambda')}, {r('coalesce(hes, 0)', 'hessian')} from ranked left join lg using (qid, rk)",
        **_pair_parts(truncation, expr, qid),
        lg=f"select qid, rk, {_LAMBDA_SQL}",
    )


_SMALL_SCORE = "coalesce(prop_review_score, 0) / 5.0e0 - price_usd / 50000.0e0"


@register("e4_lambda_gradients", _lambda_query(10, _SMALL_SCORE))
def e4(spark, sf):
    out = pairs.lambda_gradients(
        scored(spark, sf, _SMALL_SCORE), "srch_id", "relevance", "score", [*TIES, "srch_id"]
    )
    return out.select(*KEYS, "lambda", "hessian")


@register("e4_lambda_gradients_truncated", _lambda_query(2, _SMALL_SCORE))
def e4_short(spark, sf):
    """Truncation level 2: rows further down meet only the first two."""
    out = pairs.lambda_gradients(
        scored(spark, sf, _SMALL_SCORE), "srch_id", "relevance", "score", [*TIES, "srch_id"], truncation=2
    )
    return out.select(*KEYS, "lambda", "hessian")


_HOT = "case when srch_id % 3 = 0 then 0 else srch_id end"


@register("e4_lambda_gradients_hot_query", _lambda_query(5, _SMALL_SCORE, _HOT))
def e4_hot(spark, sf):
    """One query holds a third of all rows; no pair table, no task with the whole query."""
    from rankloom.operators.skew import hot_keys, stored

    df = scored(spark, sf, _SMALL_SCORE).withColumn("qid", F.expr(_HOT))
    df = stored(df.select(*dict.fromkeys([*KEYS, *TIES, "qid", "relevance", "score"])))
    hot = hot_keys(df, ["qid"], limit=1000)
    out = pairs.lambda_gradients(df, "qid", "relevance", "score", [*TIES, "srch_id"], truncation=5, hot=hot)
    return out.select(*KEYS, "lambda", "hessian")


# --- trials ------------------------------------------------------------------------------


def _trials_sql() -> dict[str, str]:
    tall = " union all ".join(
        f"select *, {REL_SQL} as relevance, {i} as trial, cast({e} as double) as score from imp" for i, e in enumerate(TRIAL_SCORES)
    )
    return {
        "s": tall,
        **ndcg_sql(by="trial, split, srch_id"),
        "trials": """select cast(trial as int) as trial, avg(n) filter (where split = 'test') as val_ndcg,
            avg(n) filter (where split = 'train') as train_ndcg, cast(100 + trial as int) as best_iteration,
            case when trial % 2 = 0 then 'gbdt' else 'dart' end as boosting_type
            from (select trial, split, dcg / nullif(idcg, 0) as n from nd) group by trial""",
    }


_TRIAL_COLUMNS = (
    f"trial, {r('val_ndcg')}, {r('train_ndcg')}, {r('train_ndcg - val_ndcg', 'gap')}, best_iteration, boosting_type"
)


@register(
    "e11_trial_leaderboard",
    with_impressions(f"select {_TRIAL_COLUMNS} from trials order by val_ndcg desc, trial limit 10", **_trials_sql()),
)
def e11(spark, sf):
    """Ten best of twelve score formulas, each measured on all rows."""
    return leaderboard(trial_table(spark, sf), 10).drop("params")


@register("s5_trials_as_json", with_impressions(f"select {_TRIAL_COLUMNS} from trials", **_trials_sql()))
def s5(spark, sf):
    path = scratch(spark, "trials")
    tables.write_trials(trial_table(spark, sf), path)
    return tables.read_trials(spark, path).drop("params")


# --- fairness -------------------------------------------------------------------------------


def _fair_parts(expr: str, name: str) -> dict[str, str]:
    whole = {f"{k}{name}": v for k, v in ndcg_sql(f"s{name}").items()}
    part = {f"{k}{name}g": v for k, v in ndcg_sql(f"s{name}", by="fam, srch_id").items()}
    parts = {
        f"s{name}": f"select *, {REL_SQL} as relevance, cast({expr} as double) as score, cast(srch_children_count > 0 as int) as fam from imp"
    }
    parts |= {
        f"placed{name}": whole[f"placed{name}"],
        f"nd{name}": whole[f"nd{name}"].replace("from placed ", f"from placed{name} "),
        f"placed{name}g": part[f"placed{name}g"],
        f"nd{name}g": part[f"nd{name}g"].replace("from placed ", f"from placed{name}g "),
        f"f{name}": f"""select (select avg(dcg / nullif(idcg, 0)) from nd{name}) as ndcg_overall,
            (select avg(dcg / nullif(idcg, 0)) from nd{name}g where fam = 1) as ndcg_group,
            (select avg(dcg / nullif(idcg, 0)) from nd{name}g where fam = 0) as ndcg_rest""",
    }
    return parts


@register(
    "q1_quality_per_group",
    with_impressions(
        f"""select {rs('ndcg_overall', 'ndcg_group', 'ndcg_rest')}, {r('ndcg_rest - ndcg_group', 'gap')},
        (select count(*) from sa where fam = 1) as rows_group, (select count(*) from sa where fam = 0) as rows_rest,
        (select count(distinct srch_id) from sa where fam = 1) as queries_group,
        (select count(distinct srch_id) from sa where fam = 0) as queries_rest from fa""",
        **_fair_parts(SCORE_SQL, "a"),
    ),
)
def q1(spark, sf):
    return fairness.evaluate_groups(scored(spark, sf), "srch_id", "relevance", "score", F.col(ROLES.children) > 0)


def _weights(swap: bool, normalise: bool) -> str:
    mine, other = "case when srch_children_count > 0 then f else n - f end", "case when srch_children_count > 0 then n - f else f end"
    w = f"n / (2.0e0 * ({other if swap else mine}))"
    if normalise:
        w = f"({w}) / avg({w}) over ()"
    return with_impressions(
        f"select {KEY_SQL}, {r(w, 'weight')} from imp, c",
        c="select count(*) as n, count(*) filter (where srch_children_count > 0) as f from imp",
    )


def _weigh(spark, sf, **kw):
    df = impressions(spark, sf).select(*KEYS, "srch_children_count")
    return fairness.add_group_weights(df, F.col("srch_children_count") > 0, **kw).select(*KEYS, "weight")


@register("q2_swapped_weights", _weights(True, False))
def q2(spark, sf):
    """The larger weight goes to the larger group."""
    return _weigh(spark, sf, swap=True)


@register("q3_inverse_frequency_weights", _weights(False, False))
def q3(spark, sf):
    return _weigh(spark, sf, swap=False)


@register("q4_normalised_weights", _weights(True, True))
def q4(spark, sf):
    """Mean weight 1."""
    return _weigh(spark, sf, swap=True, normalise=True)


_AFTER = "prop_location_score1 - price_usd / 20000.0e0"


@register(
    "q6_fairness_comparison",
    with_impressions(
        " union all ".join(
            f"select '{m}' as metric, {r(f'a.{m}', 'baseline')}, {r(f'b.{m}', 'reweighted')}, {r(f'b.{m} - a.{m}', 'change')}, "
            + (
                "cast(abs(b.gap) < abs(a.gap) as int)" if m == "gap" else f"cast(b.{m} - a.{m} > 0 as int)"
            )
            + " as improved from (select *, ndcg_rest - ndcg_group as gap from fa) a, (select *, ndcg_rest - ndcg_group as gap from fb) b"
            for m in fairness.FAIRNESS_METRICS
        ),
        **_fair_parts(SCORE_SQL, "a"),
        **_fair_parts(_AFTER, "b"),
    ),
)
def q6(spark, sf):
    """Two scores of the same rows side by side."""
    group = F.col(ROLES.children) > 0
    before = fairness.evaluate_groups(scored(spark, sf), "srch_id", "relevance", "score", group)
    after = fairness.evaluate_groups(scored(spark, sf, _AFTER), "srch_id", "relevance", "score", group)
    return fairness.compare(before, after)
