"""The evaluation chain on published metric values."""

import pytest
from pyspark.sql import functions as F

from fleetveil.plans import chart_data, evaluation

EPSILONS = ["0.01", "0.05", "0.1", "0.5", "1.0", "inf"]

# Published metric per query over the epsilon grid, sampled data.
GAUSSIAN = {
    1: ("RE", [1.0, 0.758, 0.4219, 0.0899, 0.0347, 0.0]),
    2: ("RE", [1.0, 0.503, 0.3352, 0.0853, 0.0353, 0.0]),
    3: ("SPEARMAN", [0.2006, 0.7774, 0.8754, 0.9888, 0.9971, 1.0]),
    4: ("RE", [1.0, 1.0, 1.0, 1.0, 1.0, 0.0]),
    5: ("RE", [18.1645, 1.0, 1.0, 0.8455, 0.5699, 0.0]),
    6: ("SPEARMAN", [0.1999, 0.1072, -0.1395, 0.373, -0.0171, 0.0069]),
    7: ("TVD", [0.6739, 0.5934, 0.6316, 0.5938, 0.5279, 0.0]),
    8: ("TVD", [0.5845, 0.5812, 0.5691, 0.5622, 0.5515, 0.0]),
    9: ("RE", [1.0, 1.0, 1.0, 0.2818, 0.1424, 0.0]),
    10: ("TVD", [0.2186, 0.4555, 0.267, 0.067, 0.0465, 0.0]),
    11: ("TVD", [0.5633, 0.4634, 0.3843, 0.1518, 0.0729, 0.0]),
    12: ("SPEARMAN", [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]),
}
LAPLACE = {
    1: ("RE", [0.8482, 0.148, 0.1065, 0.0184, 0.0053, 0.0]),
    2: ("RE", [1.0, 0.3287, 0.1129, 0.0279, 0.0105, 0.0]),
    3: ("SPEARMAN", [0.4717, 0.9324, 0.98, 0.9988, 0.9997, 1.0]),
    4: ("RE", [1.0, 1.0, 1.0, 1.0, 0.5223, 0.0]),
    5: ("RE", [6.7634, 1.0, 1.0, 0.2657, 0.0729, 0.0]),
    6: ("SPEARMAN", [0.1999, 0.1072, -0.1395, 0.373, -0.0171, 0.0069]),
    7: ("TVD", [0.6758, 0.6306, 0.6551, 0.5112, 0.3956, 0.0]),
    8: ("TVD", [0.6069, 0.6122, 0.6198, 0.5361, 0.524, 0.0]),
    9: ("RE", [1.0, 0.5439, 0.2964, 0.0606, 0.0222, 0.0]),
    10: ("TVD", [0.1975, 0.7649, 0.1402, 0.003, 0.0177, 0.0]),
    11: ("TVD", [0.5106, 0.3749, 0.2182, 0.0469, 0.0257, 0.0]),
    12: ("SPEARMAN", [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]),
}
HISTOGRAMS = (10, 11)


@pytest.fixture(scope="module")
def summary(spark):
    rows = []
    for mechanism, values in (("gaussian", GAUSSIAN), ("laplace", LAPLACE)):
        for query, (metric, series) in values.items():
            for epsilon, v in zip(EPSILONS, series):
                single = query in HISTOGRAMS
                rows.append((
                    query, mechanism, epsilon, metric,
                    v if metric == "RE" else None,
                    v if metric == "TVD" and not single else None,
                    v if single else None,
                    v if metric == "SPEARMAN" else None,
                ))
    return spark.createDataFrame(
        rows,
        "query_num int, mechanism string, epsilon string, metric_type string, median_re double, "
        "mean_tvd double, tvd double, spearman_rho double",
    ).cache()


def test_published_evaluation_summary(summary):
    got = {
        (r.query_num, r.mechanism): r
        for r in evaluation.evaluation_summary(summary, published=True).collect()
    }
    assert len(got) == 20 and (10, "gaussian") not in got
    q5 = got[5, "gaussian"]
    assert (q5.worst_value, q5.worst_epsilon, q5.best_epsilon) == (18.1645, "0.01", "inf")
    assert (q5.mean_across_eps, q5.std_across_eps) == (3.5967, 7.1467)
    assert (q5.n_pass_hard, q5.frac_pass_hard, q5.n_pass_adaptive) == (1, 0.1667, 1)
    q6 = got[6, "laplace"]
    assert (q6.worst_value, q6.worst_epsilon, q6.best_value, q6.best_epsilon) == (
        -0.1395, "0.1", 0.373, "0.5")
    assert (q6.adaptive_threshold, q6.n_pass_adaptive, q6.frac_pass_adaptive) == (0.0062, 4, 0.6667)
    q3 = got[3, "laplace"]
    assert (q3.mean_across_eps, q3.std_across_eps, q3.n_pass_hard) == (0.8971, 0.21, 5)
    assert (got[8, "laplace"].worst_value, got[8, "laplace"].worst_epsilon) == (0.6198, "0.1")
    # All-equal values: the first epsilon is worst and best.
    q12 = got[12, "gaussian"]
    assert (q12.worst_epsilon, q12.best_epsilon, q12.n_pass_adaptive) == ("0.01", "0.01", 6)


def test_default_summary_keeps_histograms_and_leaves_infinity_out(summary):
    got = {
        (r.query_num, r.mechanism): r
        for r in evaluation.evaluation_summary(summary).collect()
    }
    assert len(got) == 24
    q10 = got[10, "laplace"]
    assert (q10.primary_col, q10.n_epsilons, q10.n_pass_hard) == ("tvd", 5, 3)


def test_published_comparison(summary):
    rows = evaluation.mechanism_comparison(summary).collect()
    assert len(rows) == 72
    pivots = [r for r in rows if r.query_num not in HISTOGRAMS]
    count = {w: sum(r.winner == w for r in pivots) for w in ("tie", "laplace", "gaussian")}
    assert count == {"tie": 28, "laplace": 26, "gaussian": 6}
    first = next(r for r in rows if (r.query_num, r.epsilon) == (1, "0.05"))
    assert (first.difference, first.winner) == (0.61, "laplace")
    assert evaluation.unmatched_pairs(summary).count() == 0


def test_comparison_drops_one_sided_rows_and_reports_them(summary):
    cut = summary.where(~((F.col("mechanism") == "laplace") & (F.col("query_num") == 4)))
    assert evaluation.mechanism_comparison(cut).where("query_num = 4").count() == 0
    lone = evaluation.unmatched_pairs(cut).collect()
    assert len(lone) == 6 and {r.mechanism for r in lone} == {"gaussian"}


def test_published_selection(summary):
    got = {
        r.mechanism: r
        for r in evaluation.selection_report(summary, "advance", "mini", published=True).collect()
    }
    g, lap = got["gaussian"], got["laplace"]
    assert (g.best_epsilon, g.mean_utility_preserved, g.min_utility_preserved) == (
        0.5, -12.3198, -49.0)
    assert (g.n_queries_scored, g.runner_up_epsilon, g.runner_up_utility) == (9, 0.1, -28.9147)
    assert (lap.best_epsilon, lap.mean_utility_preserved, lap.runner_up_utility) == (
        0.5, -6.5487, -22.4192)
    assert {g.status, lap.status} == {"best_available"} and not g.near_miss


def test_utility_detail_has_one_entry_per_query(summary):
    row = evaluation.utility_table(summary, published=True).where(
        "mechanism = 'gaussian' AND eps = 0.5").first()
    assert [d.query_num for d in row.per_query_detail] == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    q1 = row.per_query_detail[0]
    assert q1.utility_preserved == pytest.approx(1 - 0.0899 / 0.02, abs=1e-4)


def _utility(spark, series):
    rows = [("laplace", e, u, u, 3) for e, u in series]
    return spark.createDataFrame(
        rows,
        "mechanism string, eps double, mean_utility_preserved double, "
        "min_utility_preserved double, n_queries_scored long",
    )


def test_smallest_epsilon_over_the_threshold_wins(spark):
    table = _utility(spark, [(0.01, 0.2), (0.05, 0.78), (0.1, 0.81), (0.5, 0.99)])
    row = evaluation.select_epsilon(table).first()
    assert (row.best_epsilon, row.status, row.runner_up_epsilon) == (
        0.1, "utility_threshold_met", 0.05)
    assert row.near_miss
    wide = _utility(spark, [(0.05, 0.76), (0.1, 0.95)])
    assert not evaluation.select_epsilon(wide).first().near_miss
    assert evaluation.select_epsilon(wide, near_miss="threshold").first().near_miss


def test_selection_edges(spark, summary):
    tie = _utility(spark, [(0.5, 0.3), (0.1, 0.3)])
    row = evaluation.select_epsilon(tie).first()
    assert row.best_epsilon == 0.1 and row.runner_up_epsilon is None and not row.near_miss
    none = summary.where("epsilon = 'inf'")
    report = evaluation.selection_report(none, "advance", "mini").collect()
    assert {r.status for r in report} == {"no_candidates"} and len(report) == 2


def test_best_epsilon_per_query(summary):
    cmp = evaluation.mechanism_comparison(summary)
    got = {(r.query_num, r.mechanism): r for r in evaluation.best_epsilon_per_query(cmp).collect()}
    q3 = got[3, "laplace"]
    assert (q3.best_epsilon, q3.passed_hard, q3.status) == (0.05, True, "utility_threshold_met")
    q4 = got[4, "gaussian"]
    assert (q4.best_epsilon, q4.passed_hard, q4.status) == (0.01, False, "best_available")
    assert (12, "gaussian") not in got  # a zero noise-free correlation cannot be scored


def test_epsilon_spellings(spark):
    df = spark.createDataFrame([("inf",), (" Infinity ",), ("np.inf",), ("0.5",), ("x",)], "e string")
    rows = df.select(
        evaluation.is_no_noise(F.col("e")).alias("i"), evaluation.epsilon_number(F.col("e")).alias("n")
    ).collect()
    assert [r.i for r in rows] == [True, True, True, False, False]
    assert rows[3].n == 0.5 and rows[4].n is None


def test_chart_tables(summary, spark):
    curves = {
        (r.metric_type, r.mechanism, r.position): r.mean_value
        for r in chart_data.utility_curves(summary).collect()
    }
    assert curves["SPEARMAN", "laplace", 1000.0] == pytest.approx((1.0 + 0.0069 + 0.0) / 3)
    heat = chart_data.query_heat_map(summary).where("query_num = 9 AND mechanism = 'laplace'").first()
    assert (heat.eps_0_05, heat.eps_inf) == (0.5439, 0.0)
    bars = chart_data.mechanism_bars(summary).where("metric_type = 'RE' AND position = 1.0").first()
    assert bars.laplace == pytest.approx((0.0053 + 0.0105 + 0.5223 + 0.0729 + 0.0222) / 5)
    rate = chart_data.pass_rates(summary).where("mechanism = 'laplace' AND position = 1.0").first()
    assert rate.pass_rate == pytest.approx(7 / 12)
    pareto = chart_data.pareto_points(summary).where(
        "query_num = 3 AND mechanism = 'gaussian' AND eps = 0.5").first()
    assert pareto.privacy_gain == 2.0 and pareto.utility_loss == pytest.approx(0.0112)
    ticks = chart_data.axis_ticks(summary).collect()
    assert [t.label for t in ticks] == ["0.01", "0.05", "0.1", "0.5", "1.0", "∞"]
    assert not any(r.single_epsilon for r in chart_data.is_single_epsilon(summary).collect())
    one = summary.where("epsilon IN ('0.5', 'inf')")
    assert all(r.single_epsilon for r in chart_data.is_single_epsilon(one).collect())


def test_generalisation_points(summary):
    report = evaluation.selection_report(summary, "advance", "mini")
    mini = summary.where("query_num <> 9")
    got = {
        (r.query_num, r.mechanism): r
        for r in chart_data.generalisation_points(mini, summary, report).collect()
    }
    assert len(got) == 24
    assert got[9, "laplace"].mini_value is None and not got[9, "laplace"].mini_pass
    chosen = got[1, "laplace"]
    assert chosen.mini_value == chosen.full_value and chosen.full_pass
