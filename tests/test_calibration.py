import math

import pytest
from pyspark.sql import functions as F

from fleetveil.functions import calibration as cal
from fleetveil.functions.draws import (
    fresh_seed,
    gaussian_draw,
    hashed_uniform,
    laplace_draw,
    snap_to_grid,
)
from fleetveil.operators.noise import Policy, column_share, epsilon_on_grid, plan_rows
from fleetveil.plans.registry import (
    DELTA,
    EPSILON_GRID,
    INF,
    Limits,
    published_sensitivity_limits,
    release_registry,
)

REGISTRY = release_registry()


def test_laplace_scale():
    assert cal.laplace_scale(2.0, 0.5) == 4.0
    assert cal.laplace_scale(2.0, INF) == 0.0
    assert cal.laplace_scale(2.0, 0.0) == INF
    assert cal.laplace_scale(2.0, 0.1) > cal.laplace_scale(2.0, 0.5)


@pytest.mark.parametrize("epsilon", [0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0])
@pytest.mark.parametrize("sensitivity", [0.1, 1.0, 365.0])
def test_analytic_sigma_meets_delta_and_beats_classic(sensitivity, epsilon):
    sigma = cal.analytic_gaussian_sigma(sensitivity, epsilon, DELTA)
    assert cal.gaussian_delta(sigma, sensitivity, epsilon) <= DELTA * (1 + 1e-6)
    classic = cal.classic_gaussian_sigma(sensitivity, epsilon, DELTA)
    if epsilon <= 1.0:
        assert sigma <= classic
    capped = cal.analytic_gaussian_sigma(sensitivity, epsilon, DELTA, cap_at_classic=True)
    assert capped == min(sigma, classic)
    # Not needlessly large: a slightly smaller sigma breaks the guarantee.
    assert cal.gaussian_delta(sigma * 0.999, sensitivity, epsilon) > DELTA


def test_analytic_sigma_limits_and_order():
    assert cal.analytic_gaussian_sigma(1.0, INF, DELTA) == 0.0
    assert cal.analytic_gaussian_sigma(1.0, 0.0, DELTA) == INF
    sigmas = [cal.analytic_gaussian_sigma(1.0, e, DELTA) for e in (0.01, 0.1, 1.0, 10.0)]
    assert sigmas == sorted(sigmas, reverse=True)


def test_sigma_frame_solves_each_parameter_row(spark):
    rows = [(1.0, 0.5, 1e-6), (1.0, 0.5, 1e-6), (2.0, 1.0, 1e-5)]
    df = spark.createDataFrame(rows, "s double, e double, d double")
    got = cal.with_gaussian_sigma(df, "s", "e", "d").collect()
    assert len(got) == 3
    for r in got:
        assert r.sigma == pytest.approx(cal.analytic_gaussian_sigma(r.s, r.e, r.d))


@pytest.mark.parametrize("rho, n, expected", [
    (0.5, 10, 0.14111328), (-0.3, 20, 0.19866464), (0.0, 8, 1.0), (0.9, 6, 0.01453389),
])
def test_correlation_p_value(rho, n, expected):
    # Values of Student's t distribution, from tables of the t statistic.
    assert cal.correlation_p_value(rho, n) == pytest.approx(expected, abs=2e-4)


def test_correlation_p_value_edges():
    assert math.isnan(cal.correlation_p_value(0.5, 2))
    assert cal.correlation_p_value(1.0, 5) == 0.0


@pytest.mark.parametrize("query", REGISTRY.values(), ids=lambda q: f"q{q.number}")
def test_norms(query):
    assert query.l1_sensitivity >= query.l2_sensitivity >= 0.0


def test_sensitivities_follow_the_caps():
    assert REGISTRY[1].column("avg_number_of_dc_powerons").sensitivity == pytest.approx(0.1)
    assert REGISTRY[1].column("avg_duration").sensitivity == pytest.approx(0.6)
    assert REGISTRY[3].column("average_duration_on_ac_in_seconds").sensitivity == 72.0
    assert REGISTRY[5].column("entries_per_system").sensitivity == 5.0
    assert REGISTRY[8].column("days").sensitivity == 365.0
    assert REGISTRY[9].column("avg_pkg_power_consumed").sensitivity == 0.5
    assert REGISTRY[11].column("avg_percentage_used").sensitivity == 2.0
    published = release_registry(published_sensitivity_limits(Limits()))
    assert published[3].column("average_duration_on_dc_in_seconds").sensitivity == 12.0
    assert published[7].column("avg_total_time").sensitivity == pytest.approx(7.2)
    assert published[12].column("total_power_consumption").sensitivity == 10.0


def test_registry_shape():
    assert sorted(REGISTRY) == list(range(1, 13))
    assert len(REGISTRY[8].distribution) == 28 and len(REGISTRY[7].distribution) == 4
    assert [q.metric for q in REGISTRY.values()].count("RE") == 5
    assert REGISTRY[6].columns == ()


@pytest.mark.parametrize("number", [n for n in REGISTRY if REGISTRY[n].columns])
def test_split_budget_sums_to_one(number):
    query = REGISTRY[number]
    spent = sum(column_share(query, c.name, Policy()) for c in query.columns)
    assert spent == pytest.approx(1.0)


def test_published_budget_shares():
    policy = Policy.published()
    assert column_share(REGISTRY[1], "avg_duration", policy) == 1.0
    assert column_share(REGISTRY[8], "education", policy) == pytest.approx(1 / 28)
    assert column_share(REGISTRY[7], "avg_pcnt_on_time", policy) == pytest.approx(1 / 28)
    plain = Policy.published("baseline")
    assert column_share(REGISTRY[8], "education", plain) == 1.0


def test_plan_covers_the_grid():
    rows = plan_rows(REGISTRY, Policy())
    columns = sum(len(q.columns) for q in REGISTRY.values())
    assert len(rows) == columns * 2 * len(EPSILON_GRID)
    assert all(row[7] == 0.0 for row in rows if row[3] == "inf")


def test_single_epsilon_must_be_on_the_grid():
    assert epsilon_on_grid(0.5) == (3, 0.5)
    with pytest.raises(ValueError):
        epsilon_on_grid(0.3)


def _largest_gap(values, cdf):
    values = sorted(values)
    n = len(values)
    return max(
        max((i + 1) / n - cdf(v), cdf(v) - i / n) for i, v in enumerate(values)
    )


def test_draws_follow_their_distributions(spark):
    n = 100_000
    scale = F.lit(2.0)
    rows = spark.range(n).select(
        hashed_uniform("s", F.col("id")).alias("u"),
        laplace_draw("s", scale, F.col("id")).alias("l"),
        gaussian_draw("s", scale, F.col("id")).alias("g"),
    ).toPandas()
    bound = 1.95 / math.sqrt(n)  # Kolmogorov-Smirnov at about 0.001
    assert rows.u.between(0, 1, inclusive="neither").all()
    assert _largest_gap(rows.u, lambda x: x) < bound
    assert _largest_gap(
        rows.l, lambda x: 0.5 * math.exp(x / 2) if x < 0 else 1 - 0.5 * math.exp(-x / 2)
    ) < bound
    assert _largest_gap(rows.g, lambda x: cal.normal_cdf(x / 2)) < bound
    assert rows.l.mean() == pytest.approx(0, abs=0.04)
    assert rows.l.var() == pytest.approx(8, rel=0.03)
    assert rows.g.var() == pytest.approx(4, rel=0.03)


def test_seeds_and_grid(spark):
    assert fresh_seed() != fresh_seed() and len(fresh_seed()) == 32
    got = spark.range(1).select(
        hashed_uniform("a", F.lit("1")).alias("u"), snap_to_grid(F.lit(1.3), -2).alias("g")
    ).first()
    # First 48 bits of the MD5 of "a|1".
    assert got.u == (14783901167038 + 0.5) / 2**48
    assert got.g == 1.25
