"""Validation of the stored layers: coverage, sanity, readiness, value bounds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetveil.plans.registry import Limits

Tables = Mapping[str, DataFrame]

SECONDS_PER_DAY = 86_400

# The tables the later queries depend on.
REQUIRED_TABLES = (
    "system_batt_dc_events",
    "system_cpu_metadata",
    "system_mods_top_blocker_hist",
    "system_os_codename_history",
    "system_on_off_suspend_time_day",
    "system_frgnd_apps_types",
)


def coverage(name: str, rows: DataFrame, unit: str = "guid") -> DataFrame:
    """(table, rows, devices) of one table from one scan, folded per device first."""
    per_unit = rows.groupBy(unit).agg(F.count(F.lit(1)).alias("n"))
    return per_unit.agg(
        F.lit(name).alias("table_name"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(unit).alias("unique_guids"),
    )


def table_coverage(tables: Tables, names: Iterable[str] | None = None) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [coverage(n, tables[n]) for n in (names or list(tables))]
    )


def sample_rows(tables: Tables, names: Iterable[str], n: int) -> dict[str, DataFrame]:
    """``n`` rows of each table for a look at the values: the first in the order of its
    columns, so that the same table always shows the same rows."""
    return {name: tables[name].orderBy(*tables[name].columns).limit(n) for name in names}


def negative_ram(tables: Tables) -> DataFrame:
    return (
        tables["system_memory_utilization"].where(F.col("utilized_ram") < 0)
        .agg(
            F.lit("Negative RAM Utilization Check").alias("check_name"),
            F.count(F.lit(1)).alias("neg_utilized_count"),
        )
    )


def overlong_device_days(tables: Tables, limit: int = SECONDS_PER_DAY) -> DataFrame:
    """Device days whose displays were on for longer than a day in total."""
    per_day = tables["system_display_devices"].groupBy("guid", "dt").agg(
        F.sum(F.col("duration_ac") + F.col("duration_dc")).alias("total_duration")
    )
    return per_day.where(F.col("total_duration") > limit)


def overlong_count(tables: Tables, limit: int = SECONDS_PER_DAY) -> DataFrame:
    return overlong_device_days(tables, limit).agg(
        F.lit("Display Duration > 24hrs Check").alias("check_name"),
        F.count(F.lit(1)).alias("excessive_duration_count"),
    )


def top_overlong(tables: Tables, limit: int = SECONDS_PER_DAY, n: int = 50) -> DataFrame:
    """The longest device days; device and day break ties, so the cut is repeatable."""
    return overlong_device_days(tables, limit).orderBy(
        F.col("total_duration").desc(), "guid", "dt"
    ).limit(n)


def status_distribution(tables: Tables) -> DataFrame:
    return tables["system_display_devices"].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def category_pairs(sources: Tables) -> DataFrame:
    """Every pair of parent and sub-category that occurs; a caller may limit them."""
    pairs = sources["web_usage"].select("parent_category", "sub_category").distinct()
    label = F.concat("parent_category", F.lit("-"), "sub_category").alias("category")
    return pairs.select(label).distinct().orderBy(F.col("category").asc_nulls_last())


def battery_nulls(tables: Tables) -> DataFrame:
    return tables["system_batt_dc_events"].agg(
        F.lit("Battery Events NULLIF Check").alias("check_name"),
        F.count(F.lit(1)).alias("total_events"),
        *[
            F.count(f"{s}_power_on_battery_percent").alias(f"non_null_{s}_on")
            for s in ("max", "min", "avg")
        ],
    )


def distinct_counts(rows: DataFrame, label: str, columns: Mapping[str, str]) -> DataFrame:
    """Number of distinct values of several columns of one table."""
    return rows.agg(
        F.lit(label).alias("check_name"),
        *[F.count_distinct(c).alias(name) for name, c in columns.items()],
    )


def cpu_coverage(tables: Tables) -> DataFrame:
    return distinct_counts(
        tables["system_cpu_metadata"], "CPU Metadata Check",
        {"unique_systems": "guid", "unique_market_codes": "marketcodename",
         "unique_cpu_gens": "cpugen"},
    )


def app_coverage(tables: Tables) -> DataFrame:
    return distinct_counts(
        tables["system_frgnd_apps_types"], "Foreground Apps Check",
        {"unique_systems": "guid", "unique_app_types": "app_type", "unique_exe_names": "exe_name"},
    )


def readiness(
    spark: SparkSession, schema: str, required: Sequence[str] = REQUIRED_TABLES
) -> DataFrame:
    """Whether all required tables are in the catalog, and which are not."""
    missing = [t for t in required if not spark.catalog.tableExists(f"{schema}.{t}")]
    status = "MISSING TABLES" if missing else "ALL TABLES EXIST"
    return spark.createDataFrame(
        [("Benchmark Query Readiness", status, ",".join(missing))],
        "check_name string, status string, missing string",
    )


def device_count(devices: DataFrame) -> DataFrame:
    return devices.select("guid").distinct().agg(
        F.lit("Overall Coverage").alias("metric"), F.count("guid").alias("unique_systems")
    )


def date_range(tables: Tables) -> DataFrame:
    return tables["system_display_devices"].agg(
        F.lit("Date Range").alias("metric"),
        F.min("dt").alias("earliest_date"),
        F.max("dt").alias("latest_date"),
        F.date_diff(F.max("dt"), F.min("dt")).alias("days_span"),
    )


def bound_rules(limits: Limits) -> list[tuple[int, str, float, float]]:
    """(query, column, low, high, per unit) that a clipped result must respect."""
    state = limits.state_minutes
    highs: dict[int, dict[str, float]] = {
        1: {"avg_number_of_dc_powerons": limits.power_ons, "avg_duration": limits.battery_minutes},
        2: {"avg_duration_mins_on_battery": limits.battery_minutes},
        3: {
            f"average_duration_on_{s}_in_seconds": limits.display_seconds for s in ("ac", "dc")
        },
        4: {"percentage_of_systems": limits.percent},
        5: {"entries_per_system": limits.blocker_entries},
        7: {
            **{f"avg_{s}_time": state for s in ("on", "off", "modern_sleep", "sleep")},
            "avg_total_time": limits.total_time_parts * state,
            **{f"avg_pcnt_{s}_time": limits.percent for s in ("on", "off", "mods", "sleep")},
        },
        9: {"avg_pkg_power_consumed": limits.package_watts},
        10: {f"percent_{s}": limits.percent for s in ("systems", "instances", "duration")},
        11: {"avg_percentage_used": limits.percent},
        12: {"total_power_consumption": limits.user_power},
    }
    rules = [(q, c, 0.0, float(high), False) for q, cols in highs.items() for c, high in cols.items()]
    # Sums over devices: the cap of one times the devices of the group.
    return [
        *rules, (5, "num_entries", 0.0, float(limits.blocker_entries), True),
        (8, "days", 0.0, float(limits.days), True),
    ]


def bound_violations(cells: DataFrame, rules: Sequence[tuple]) -> DataFrame:
    """Per (query, column): checked cells and those outside their bounds; a NULL is
    outside. A rule is (query, column, low, high) and, if wanted, whether ``high`` is meant
    for each device of the group."""
    rules = [(*r, False)[:5] for r in rules]
    table = cells.sparkSession.createDataFrame(
        rules, "query_num int, column string, low double, high double, per_unit boolean"
    )
    # The rules are one row per checked column.
    checked = cells.join(F.broadcast(table), ["query_num", "column"])
    value, high = F.col("true_value"), F.col("high")
    summed = sorted({r[0] for r in rules if r[4]})
    if summed:
        units = cells.where(
            (F.col("column") == "number_of_systems") & F.col("query_num").isin(summed)
        ).select("query_num", "group_key", F.col("true_value").alias("units"))
        checked = checked.join(units, ["query_num", "group_key"], "left")
        high = F.when(F.col("per_unit"), high * F.col("units")).otherwise(high)
    bad = value.isNull() | F.isnan(value) | (value < F.col("low")) | (value > high)
    return checked.groupBy("query_num", "column").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum(bad.cast("int")).alias("n_violations")
    )
