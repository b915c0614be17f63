import pytest
from pyspark.sql import functions as F

from fleetveil.operators.noise import Policy, epsilon_frame, flip_selection, noisy_selection
from fleetveil.plans import metrics
from fleetveil.plans.registry import INF, Limits, release_registry
from fleetveil.plans.release import (
    Release,
    allocate_budget,
    exact_cells,
    filter_by_noisy_count,
    ledger_totals,
    noisy_cells,
    privacy_ledger,
    published_table,
    result_cells,
    run_release,
)
from fleetveil.plans.release_queries import export_release_queries
from oracles.texts import DEMO_LIMITS, DEMO_REGISTRY

SEED = "test"


@pytest.fixture(scope="module")
def cells(tables):
    return exact_cells(tables, DEMO_REGISTRY, DEMO_LIMITS, [1, 7, 10]).cache()


@pytest.fixture(scope="module")
def release(tables):
    return run_release(
        tables, DEMO_LIMITS, Policy(), SEED, epsilons=[0.5, INF], mechanisms=["laplace"]
    )


def test_infinite_epsilon_copies(cells):
    noisy = noisy_cells(cells, DEMO_REGISTRY, Policy(), SEED).where("epsilon = 'inf'")
    assert noisy.where("noisy_value IS DISTINCT FROM true_value").count() == 0
    assert noisy.count() == 2 * cells.count()


def test_noise_ignores_partitioning(cells):
    def values(frame):
        rows = noisy_cells(frame, DEMO_REGISTRY, Policy(), SEED).collect()
        return sorted(
            (r.query_num, r.mechanism, r.epsilon, r.group_key, r.column, round(r.noisy_value, 9))
            for r in rows
        )

    assert values(cells.repartition(1)) == values(cells.repartition(13))


def test_every_query_column_and_epsilon_draws_its_own_noise(cells):
    noisy = noisy_cells(cells.where("query_num = 1"), DEMO_REGISTRY, Policy(), SEED)
    noise = noisy.where("epsilon <> 'inf' AND noisy_value > 0").select(
        F.round(F.col("noisy_value") - F.col("true_value"), 9).alias("n"))
    assert noise.count() == noise.distinct().count()
    other = noisy_cells(cells.where("query_num = 1"), DEMO_REGISTRY, Policy(), "another")
    same = noisy.join(
        other.withColumnRenamed("noisy_value", "o"),
        ["query_num", "mechanism", "epsilon", "group_key", "column"],
    ).where("epsilon <> 'inf' AND noisy_value = o AND o > 0")
    assert same.count() == 0


def test_post_process_invariants(cells):
    noisy = noisy_cells(cells, DEMO_REGISTRY, Policy(), SEED).where("epsilon <> 'inf'").cache()
    assert noisy.where("noisy_value < 0").count() == 0
    rows = noisy.where("query_num = 7 AND column LIKE 'avg_pcnt%'").groupBy(
        "mechanism", "epsilon", "group_key").agg(F.sum("noisy_value").alias("s"))
    assert rows.where("abs(s - 100) > 1e-6").count() == 0
    # Smoothing leaves no zero in a distribution.
    assert noisy.where("column LIKE 'avg_pcnt%' AND noisy_value <= 0").count() == 0
    shares = noisy.where("column = 'percent_systems'").groupBy("mechanism", "epsilon").agg(
        F.sum("noisy_value").alias("s"))
    assert shares.where("abs(s - 100) > 1e-6 AND s > 0").count() == 0


def test_baseline_variant_skips_smoothing(cells):
    plain = noisy_cells(
        cells, DEMO_REGISTRY, Policy.published("baseline"), SEED, epsilons=[0.01])
    assert plain.where("column LIKE 'avg_pcnt%' AND noisy_value = 0").count() > 0
    # The published post-process scales a mean column to 100 as well.
    column = plain.where("column = 'avg_pcnt_on_time'").groupBy("mechanism").count()
    assert column.count() == 2


def test_noisy_selection_is_exact_without_noise_and_random_with(spark):
    rows = [(6, f"c{i}", item, n) for i in range(300) for item, n in (("x", 3.0), ("y", 2.0))]
    counts = spark.createDataFrame(
        rows, "query_num int, group_key string, item string, true_value double")
    grid = epsilon_frame(spark, [0.05, INF], ["laplace"])
    got = noisy_selection(counts, grid, SEED)
    assert got.where("epsilon = 'inf' AND noisy_item <> 'x'").count() == 0
    flipped = got.where("epsilon = '0.05' AND noisy_item = 'y'").count()
    assert 100 < flipped < 200


def test_flip_selection_rate(spark):
    rows = [(6, f"c{i}", "x") for i in range(4000)]
    winners = spark.createDataFrame(rows, "query_num int, group_key string, true_item string")
    got = flip_selection(winners, epsilon_frame(spark, [1.0], ["laplace"]), SEED)
    rate = got.where("noisy_item = 'unknown'").count() / 4000
    assert rate == pytest.approx(0.5 * 2.718281828 ** -0.5, abs=0.03)


def test_ledger_spends_the_stated_epsilon(spark, release):
    ledger = privacy_ledger(spark, release.cells, release.winners, release.registry, Policy())
    rows = ledger.collect()
    assert {r.query_num for r in rows} == set(range(1, 13))
    assert all(r.epsilon_spent == pytest.approx(0.5) for r in rows)
    total = ledger_totals(ledger, budget=5.0).first()
    assert total.epsilon_total == pytest.approx(6.0) and not total.within_budget


def test_published_budget_overspends(spark, release):
    ledger = privacy_ledger(
        spark, release.cells, None, release.registry, Policy.published())
    spent = {r.query_num: r.epsilon_spent for r in ledger.collect()}
    assert spent[1] == pytest.approx(1.5)  # three columns at the full epsilon


def test_budget_shares():
    shares = allocate_budget(10.0)
    assert shares[8] == 2.0 and sum(shares.values()) == pytest.approx(10.0)


def test_published_tables_keep_null_and_empty_keys_and_types(spark):
    registry = release_registry(DEMO_LIMITS)
    odd = spark.createDataFrame(
        [(None, "x", 10, 1.0), ("", "x", 20, 2.0), ("a\x1fb\\s", None, 30, 3.0)],
        "marketcodename string, cpugen string, number_of_systems long, "
        "avg_duration_mins_on_battery double")
    cells = noisy_cells(
        result_cells(odd, registry[2]), registry, Policy(), "s", epsilons=[float("inf")])
    wide = published_table(Release(cells, None, registry), 2).where("mechanism = 'laplace'")
    got = {(r.marketcodename, r.cpugen): r.number_of_systems for r in wide.collect()}
    assert got == {(None, "x"): 10.0, ("", "x"): 20.0, ("a\x1fb\\s", None): 30.0}
    ram = spark.createDataFrame([(8.0, 9, 50.0), (None, 7, 40.0)],
                                "ram_gb double, number_of_systems long, avg_percentage_used double")
    cells = noisy_cells(
        result_cells(ram, registry[11]), registry, Policy(), "s", epsilons=[float("inf")])
    wide = published_table(Release(cells, None, registry), 11)
    assert dict(wide.dtypes)["ram_gb"] == "double" and wide.where("ram_gb IS NULL").count() == 2


def test_published_tables(release):
    wide = published_table(release, 3).where("epsilon = '0.5'")
    assert wide.columns[2:] == [
        "connection_type", "resolution", "number_of_systems",
        "average_duration_on_ac_in_seconds", "average_duration_on_dc_in_seconds"]
    assert wide.where("resolution LIKE '%x%'").count() == wide.count() > 0
    ranked = published_table(release, 12).where("epsilon = '0.5'").orderBy("rnk").collect()
    values = [r.total_power_consumption for r in ranked]
    assert values == sorted(values, reverse=True) and ranked[0].rnk == 1
    assert published_table(release, 6).columns == ["mechanism", "epsilon", "country", "browser"]


def test_noisy_threshold_filters_whole_groups(release):
    kept = filter_by_noisy_count(release.cells.where("query_num = 1"), 60)
    low = kept.where("column = 'number_of_systems' AND noisy_value < 60").count()
    per_group = kept.groupBy("epsilon", "group_key").count()
    assert low == 0 and per_group.where("count <> 3").count() == 0


def test_metric_summary_without_noise_is_perfect(release):
    rows = metrics.metric_summary(release).where("epsilon = 'inf'").collect()
    assert len(rows) == 12
    by = {r.query_num: r for r in rows}
    assert all(by[q].median_re == 0.0 for q in (1, 2, 4, 5, 9))
    assert all(by[q].mean_tvd == 0.0 == by[q].max_tvd for q in (7, 8))
    assert all(by[q].tvd == 0.0 for q in (10, 11))
    assert by[3].spearman_rho == 1.0 and by[3].p_value == 0.0
    assert all(r["pass"] == 1 for r in rows if r.query_num not in (6, 12))


def _frame(spark, pairs):
    rows = [(1, "laplace", "advance", "0.5", f"g{i:03d}", "", "c", float(t), float(n))
            for i, (t, n) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "query_num int, mechanism string, variant string, epsilon string, group_key string, "
        "item string, column string, true_value double, noisy_value double")


def test_relative_error_skips_zero_truth(spark):
    got = metrics.median_relative_error(_frame(spark, [(0.0, 9.0), (2.0, 3.0), (4.0, 4.4)])).first()
    assert got.median_re == 0.3
    assert metrics.median_relative_error(_frame(spark, [(0.0, 1.0)])).count() == 0


def test_total_variation_edges(spark):
    assert metrics.total_variation(_frame(spark, [(1, 3), (3, 1)])).first().tvd == 0.5
    assert metrics.total_variation(_frame(spark, [(1.0, 0.0), (3.0, 0.0)])).first().tvd == 0.5


def test_spearman_edges(spark):
    reverse = metrics.spearman_numeric(_frame(spark, [(1, 3), (2, 2), (3, 1)])).first()
    assert (reverse.spearman_rho, reverse.p_value) == (-1.0, 0.0)
    flat = metrics.spearman_numeric(_frame(spark, [(1, 0), (2, 0), (3, 0)])).first()
    assert (flat.spearman_rho, flat.p_value) == (0.0, 1.0)
    assert metrics.spearman_numeric(_frame(spark, [(1, 5)])).first().spearman_rho is None
    tied = metrics.spearman_numeric(_frame(spark, [(1, 1), (2, 2), (2, 4), (4, 3)])).first()
    # Ranks 4, 2.5, 2.5, 1 against 4, 3, 1, 2.
    assert tied.spearman_rho == pytest.approx(3 / 22.5**0.5, abs=1e-4)


def test_categorical_spearman(spark):
    rows = [(6, "laplace", "advance", "0.5", k, t, n) for k, t, n in (
        ("a", "x", "x"), ("b", "y", "unknown"), ("c", "x", "y"), ("d", "z", "z"))]
    winners = spark.createDataFrame(
        rows, "query_num int, mechanism string, variant string, epsilon string, group_key string, "
        "true_item string, noisy_item string")
    # Positions 0..3 against labels x=2, unknown=4, y=1, z=3: ranks 2, 4, 1, 3.
    assert metrics.spearman_categorical(winners).first().spearman_rho == 0.0


def test_export_reports_each_query(tables, tmp_path):
    report = export_release_queries(tables, tmp_path, DEMO_LIMITS).collect()
    assert len(report) == 12 and {r.status for r in report} == {"ok"}
    names = {r.table for r in report}
    assert "battery_power_on_geographic_summary" in names
    assert (tmp_path / "query=ram_utilization_histogram").is_dir()


def test_release_is_complete(release):
    assert isinstance(release, Release)
    assert {r.query_num for r in release.cells.select("query_num").distinct().collect()} == (
        set(range(1, 13)) - {6})
    assert release_registry(Limits()).keys() == release.registry.keys()
