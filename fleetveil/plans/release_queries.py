"""The twelve release queries: per-unit values capped before any group aggregate.

All follow one shape: fold the fact table per unit, join the dimension, cap, then
aggregate over units. The results are exact; noise is added in ``release``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetveil.functions.exprs import clip_upper, percent_of, ratio, round_to, row_total
from fleetveil.operators.ranking import full_rank, top_ranked
from fleetveil.operators.units import (
    Measure,
    bound_groups_per_unit,
    count_of,
    distinct_units,
    group_summary,
    mean_of,
    mean_of_enough,
    sum_of,
    unit_values,
    weighted_mean_of,
    with_total,
)
from fleetveil.plans.analytics import (
    SLEEP_STATES,
    blockers_with_os,
    browser_devices_by_country,
    category_totals_per_device,
    sized_displays,
    weighted_category_shares,
)
from fleetveil.plans.categories import CATEGORY_COLUMNS
from fleetveil.plans.registry import MANY_GROUPS, Limits, release_registry, slug
from fleetveil.session import stage
from fleetveil.sources.sinks import export_results

Tables = Mapping[str, DataFrame]


def _bound(number: int, limits: Limits) -> int | None:
    """Groups of a query that one device counts in."""
    if limits.max_groups_per_unit is None:
        return None
    return limits.max_groups_per_unit if number in MANY_GROUPS else 1


def _units(
    number: int,
    fact: DataFrame,
    group: list[str],
    measures: list[Measure],
    limits: Limits,
    dimension: DataFrame | None = None,
) -> DataFrame:
    return unit_values(
        fact, "guid", group, measures, dimension, limits.null_is_cap, _bound(number, limits)
    )


def _mean(name: str, least: int, digits: int | None = None) -> Column:
    mean = mean_of_enough(name, least)
    return (mean if digits is None else round_to(mean, digits)).alias(name)


def battery_by_country(t: Tables, limits: Limits) -> DataFrame:
    measures = [
        mean_of("avg_number_of_dc_powerons", "num_power_ons", limits.power_ons),
        mean_of("avg_duration", "duration_mins", limits.battery_minutes),
    ]
    country = t["sysinfo"].select("guid", F.col("countryname_normalized").alias("country"))
    units = _units(1, t["system_batt_dc_events"], ["country"], measures, limits, country)
    return group_summary(
        units, ["country"], [_mean(m.name, limits.least(1)) for m in measures], limits.min_units[1]
    )


def battery_by_cpu(t: Tables, limits: Limits) -> DataFrame:
    name = "avg_duration_mins_on_battery"
    measures = [mean_of(name, "duration_mins", limits.battery_minutes)]
    cpu = t["system_cpu_metadata"].where(F.col("cpugen") != "Unknown")
    group = ["marketcodename", "cpugen"]
    units = _units(2, t["system_batt_dc_events"], group, measures, limits, cpu)
    return group_summary(units, group, [_mean(name, limits.least(2))], limits.min_units[2])


def display_durations(t: Tables, limits: Limits) -> DataFrame:
    measures = [
        mean_of(f"average_duration_on_{s}_in_seconds", f"duration_{s}", limits.display_seconds)
        for s in ("ac", "dc")
    ]
    group = ["connection_type", "resolution"]
    units = _units(3, sized_displays(t), group, measures, limits)
    means = [_mean(m.name, limits.least(3), 2) for m in measures]
    return group_summary(units, group, means, limits.min_units[3])


def display_vendor_share(t: Tables, limits: Limits) -> DataFrame:
    """The total is the sum of the vendor counts, so the shares add up to 100."""
    known = t["system_display_devices"].where(F.col("vendor_name").isNotNull())
    counts = distinct_units(known, ["vendor_name"], "guid", _bound(4, limits))
    totalled = with_total(counts, total_number_of_systems=F.sum("number_of_systems"))
    share = round_to(percent_of("number_of_systems", "total_number_of_systems"), 2)
    return totalled.withColumn("percentage_of_systems", share)


def blockers_by_os(t: Tables, limits: Limits) -> DataFrame:
    group = ["os_name", "os_codename"]
    measures = [sum_of("entries", "n_rows", limits.blocker_entries)]
    units = _units(5, blockers_with_os(t), group, measures, limits)
    out = group_summary(
        units, group, [F.sum("entries").alias("num_entries")], limits.min_units[5]
    )
    return out.select(
        *group, "num_entries", "number_of_systems",
        ratio("num_entries", "number_of_systems").alias("entries_per_system"),
    )


def browser_counts(t: Tables, limits: Limits | None = None) -> DataFrame:
    """(country, browser, number_of_systems), the input of the noisy selection."""
    return browser_devices_by_country(t, True, _bound(6, limits or Limits()))


def top_browser_by_country(t: Tables, limits: Limits) -> DataFrame:
    winners = top_ranked(browser_counts(t, limits), F.col("number_of_systems"), 1, ["country"])
    return winners.select("country", "browser")


def sleep_by_cpu(t: Tables, limits: Limits) -> DataFrame:
    group = ["marketcodename", "cpugen"]
    states, least = list(SLEEP_STATES.values()), limits.least(7)
    measures = [mean_of(s, s, limits.state_minutes) for s in states]
    units = _units(
        7, t["system_on_off_suspend_time_day"], group, measures, limits, t["system_cpu_metadata"]
    ).withColumn("total", row_total(states))
    outputs = [
        *[round_to(mean_of_enough(s, least), 2).alias(f"avg_{k}_time") for k, s in SLEEP_STATES.items()],
        round_to(mean_of_enough("total", least), 2).alias("avg_total_time"),
        *[
            round_to(percent_of(F.sum(s), F.sum("total")), 2).alias(f"avg_pcnt_{s}")
            for s in states
        ],
    ]
    return group_summary(units, group, outputs, limits.min_units[7])


def persona_web_categories(t: Tables, limits: Limits) -> DataFrame:
    persona = t["sysinfo"].select("guid", "persona")
    joined = category_totals_per_device(t).join(persona, "guid")
    sums = [*CATEGORY_COLUMNS, "total_duration"]
    per_unit = joined.groupBy("guid", "persona").agg(
        F.sum("days").alias("days"), *[F.sum(c).alias(c) for c in sums]
    )
    capped = per_unit.select(
        "guid",
        "persona",
        clip_upper("days", limits.days, limits.null_is_cap).alias("days"),
        *[clip_upper(c, limits.web_duration_ms, limits.null_is_cap).alias(c) for c in sums],
    ).where(F.col("total_duration") > 0)
    if (bound := _bound(8, limits)) is not None:
        capped = bound_groups_per_unit(capped, "guid", ["persona"], bound, placed=True)
    return group_summary(
        capped, ["persona"], [F.sum("days").alias("days"), *weighted_category_shares()],
        limits.min_units[8],
    )


def package_power_by_country(t: Tables, limits: Limits) -> DataFrame:
    name = "avg_pkg_power_consumed"
    measures = [weighted_mean_of(name, "mean", "nrs", limits.package_watts)]
    group = ["countryname_normalized"]
    units = _units(9, t["system_hw_pkg_power"], group, measures, limits, t["sysinfo"])
    return group_summary(units, group, [_mean(name, limits.least(9))], limits.min_units[9])


def browser_shares(t: Tables, limits: Limits) -> DataFrame:
    known = t["system_web_cat_usage"].where(F.col("browser").isNotNull())
    measures = [
        count_of("instances", limits.browser_rows),
        sum_of("duration", "duration_ms", limits.web_duration_ms),
    ]
    parts = ["systems", "instances", "duration"]
    per_browser = group_summary(
        _units(10, known, ["browser"], measures, limits), ["browser"],
        [F.sum(p).alias(p) for p in parts[1:]],
    ).withColumnRenamed("number_of_systems", "systems")
    totalled = with_total(per_browser, **{f"all_{p}": F.sum(p) for p in parts})
    return totalled.select(
        "browser", *[round_to(percent_of(p, f"all_{p}"), 2).alias(f"percent_{p}") for p in parts]
    )


def ram_histogram(t: Tables, limits: Limits) -> DataFrame:
    rows = t["system_memory_utilization"].where(F.col("avg_percentage_used") > 0)
    gb = F.col("sysinfo_ram") / F.pow(F.lit(2.0), F.lit(10.0))
    name = "avg_percentage_used"
    units = _units(
        11, rows.withColumn("ram_gb", gb), ["ram_gb"], [mean_of(name, name, limits.percent)], limits
    )
    return group_summary(units, ["ram_gb"], [_mean(name, limits.least(11), 0)], limits.min_units[11])


def power_by_user(t: Tables, limits: Limits) -> DataFrame:
    """The unit here is the user, not the device."""
    measures = [sum_of("total_power_consumption", "total_power_consumption", limits.user_power)]
    return unit_values(
        t["system_mods_power_consumption"], "user_id", [], measures,
        null_is_cap=limits.null_is_cap,
    )


def users_by_power(t: Tables, limits: Limits) -> DataFrame:
    # Ranks and rows both read the sums: one pass over the power table.
    return full_rank(stage(power_by_user(t, limits)), "total_power_consumption", "rnk")


RELEASE_QUERIES: dict[int, Callable[[Tables, Limits], DataFrame]] = {
    1: battery_by_country,
    2: battery_by_cpu,
    3: display_durations,
    4: display_vendor_share,
    5: blockers_by_os,
    6: top_browser_by_country,
    7: sleep_by_cpu,
    8: persona_web_categories,
    9: package_power_by_country,
    10: browser_shares,
    11: ram_histogram,
    12: users_by_power,
}


def run_release_query(number: int, tables: Tables, limits: Limits | None = None) -> DataFrame:
    return RELEASE_QUERIES[number](tables, limits or Limits())


def run_cell_query(number: int, tables: Tables, limits: Limits) -> DataFrame:
    """A release query as far as its cells go: that of query 12 without the rank."""
    return {**RELEASE_QUERIES, 12: power_by_user}[number](tables, limits)


def export_release_queries(
    tables: Tables, folder: str | PurePosixPath, limits: Limits | None = None
) -> DataFrame:
    """Run all release queries, write one CSV folder each, report what succeeded."""
    limits = limits or Limits()
    spark = tables["sysinfo"].sparkSession
    results = {
        slug(q.title): (lambda n=q.number: run_release_query(n, tables, limits))
        for q in release_registry(limits).values()
    }
    return export_results(spark, results, str(folder))
