"""How far one device moves the released results, against the scale of the noise."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetveil.operators.units import bound_groups_per_unit, mean_of_enough
from fleetveil.plans.analytics import run_query
from fleetveil.plans.registry import MANY_GROUPS, Limits, published_sensitivity_limits, release_registry
from fleetveil.plans.release import exact_cells
from fleetveil.plans.release_queries import run_release_query
from fleetveil.plans.reporting import reporting_tables
from oracles.texts import DEMO_LIMITS

# Shares of a total: one device may move them by more, which the README states.
SHARES = {(4, "percentage_of_systems"), *[(10, f"percent_{p}") for p in ("systems", "instances", "duration")]}
NUMBERS = [n for n in range(1, 13) if n != 6]
LIMITS = replace(DEMO_LIMITS, max_groups_per_unit=2)


@pytest.fixture(scope="module")
def without(sources):
    """The device with most display groups, and the layer without any row of it."""
    busiest = (
        sources["display_devices"].groupBy("guid").agg(F.countDistinct("connection_type", "vendor_name").alias("n"))
        .orderBy(F.desc("n"), "guid").first().guid
    )
    left = {
        n: (lambda n=n: sources[n].where(F.col("guid") != busiest) if "guid" in sources[n].columns else sources[n])
        for n in sources
    }
    return reporting_tables({n: f() for n, f in left.items()})


@pytest.mark.parametrize("number", NUMBERS)
def test_one_device_moves_a_result_by_the_scale_at_most(tables, without, number):
    query = release_registry(LIMITS)[number]
    both = []
    for layer in (tables, without):
        rows = run_release_query(number, layer, LIMITS).collect()
        both.append({tuple(r[k] for k in query.keys): r for r in rows})
    common = both[0].keys() & both[1].keys()
    assert common
    for column in query.columns:
        if column.dist or (number, column.name) in SHARES:
            continue
        moved = [
            abs(both[0][k][column.name] - both[1][k][column.name]) for k in common
            if both[0][k][column.name] is not None and both[1][k][column.name] is not None
        ]
        # The total of query 4 is one value, repeated in every row.
        total = max(moved, default=0.0) if column.name == "total_number_of_systems" else sum(moved)
        # Means are rounded, to two digits at most.
        assert total <= column.sensitivity * query.groups + 0.011 * len(moved), (column.name, total)


def test_the_bound_is_met_and_fixed(spark):
    rows = spark.createDataFrame([(u, g) for u in range(40) for g in range(u % 7 + 1)], "guid int, g int")
    kept = bound_groups_per_unit(rows, "guid", ["g"], 3)
    per_unit = {r.guid: r["count"] for r in kept.groupBy("guid").count().collect()}
    assert per_unit == {u: min(3, u % 7 + 1) for u in range(40)}
    again = bound_groups_per_unit(rows.repartition(5), "guid", ["g"], 3)
    assert sorted(kept.collect()) == sorted(again.collect())
    # Without one device the others keep their groups.
    fewer = bound_groups_per_unit(rows.where("guid <> 6"), "guid", ["g"], 3)
    assert sorted(kept.where("guid <> 6").collect()) == sorted(fewer.collect())


def test_the_hashes_of_groups_are_not_shuffled(spark):
    rows = spark.createDataFrame([(u, g) for u in range(40) for g in range(u % 7 + 1)], "guid int, g int")
    kept = bound_groups_per_unit(rows, "guid", ["g"], 3)
    plan = kept._jdf.queryExecution().executedPlan().toString().splitlines()
    shuffles = [i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line]
    hashes = [i for i, line in enumerate(plan) if "md5(" in line]
    # A plan is printed from its end.
    assert len(shuffles) == 1 and hashes and max(hashes) < shuffles[0]


def test_power_of_users_is_read_once(tables):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    cells = plan(exact_cells(tables, release_registry(LIMITS), LIMITS, [12]))
    assert cells.count("lineitem.parquet") == 1 and "ExistingRDD" not in cells
    for ranked in (run_release_query(12, tables, LIMITS), run_query(12, tables)):
        assert "lineitem.parquet" not in plan(ranked)


def test_a_mean_needs_enough_devices_with_a_value(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 1.0), ("b", None)], "g string, x double")
    got = dict(rows.groupBy("g").agg(mean_of_enough("x", 2)).collect())
    assert got == {"a": 2.0, "b": None}
    assert dict(rows.groupBy("g").agg(mean_of_enough("x", 0)).collect()) == {"a": 2.0, "b": 1.0}


def test_scales_follow_the_bound():
    one, four = release_registry(Limits(max_groups_per_unit=1)), release_registry(Limits())
    for n in one:
        times = 4 if n in MANY_GROUPS else 1
        assert four[n].l1_sensitivity == pytest.approx(times * one[n].l1_sensitivity)
        assert four[n].l2_sensitivity == pytest.approx(times**0.5 * one[n].l2_sensitivity)
    published = release_registry(published_sensitivity_limits(Limits()))
    assert {q.groups for q in published.values()} == {1}
    # The sum of four capped parts, and the value the published scales use.
    assert four[7].column("avg_total_time").sensitivity == pytest.approx(57.6)
    assert published[7].column("avg_total_time").sensitivity == pytest.approx(7.2)
