"""The reporting layer: 22 tables derived from the telemetry sources.

Each builder maps the source tables to one DataFrame. ``reporting_tables`` offers
them lazily, so a query over an unsaved layer still reaches the source scan with
its filters and columns; ``sinks.write_tables`` stores them.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetveil.functions.exprs import (
    half_even_int,
    percent_of,
    ratio,
    round_to,
    sentinel_null,
    weighted_mean,
)
from fleetveil.plans.categories import CATEGORIES, CATEGORY_COLUMNS
from fleetveil.sources.sinks import write_table, write_tables
from fleetveil.sources.tables import LazyTables

Tables = Mapping[str, DataFrame]

# Metric names in the long power table.
METRIC_C0 = "HW::CORE:C0:PERCENT:"
METRIC_FREQUENCY = "HW::CORE:AVG_FREQ:MHZ:"
METRIC_TEMPERATURE = "HW::CORE:TEMPERATURE:CENTIGRADE:"
METRIC_PLATFORM_POWER = "HW:::PSYS_RAP:WATTS:"
POWER_METRICS = (METRIC_C0, METRIC_FREQUENCY, METRIC_TEMPERATURE, METRIC_PLATFORM_POWER)

STATISTICS = {"min": "min_val", "avg": "avg_val", "med": "percentile_50th", "max": "max_val"}

POWER_COLUMNS = [
    f"{part}_power_consumption"
    for part in ("cpu", "display", "disk", "mbb", "network", "soc", "loss", "other", "total")
]

WEB_MEASURES = ("duration_ms", "page_load_count", "page_visit_count", "domain_count")


def with_load_time(df: DataFrame) -> DataFrame:
    return df.select(F.current_timestamp().alias("load_ts"), "*")


def display_devices(src: Tables) -> DataFrame:
    return src["display_devices"].select(
        F.col("load_ts").cast("timestamp"),
        "guid",
        F.col("dt").cast("date"),
        F.col("ts").cast("timestamp"),
        "display_id", "adapter_id", "port", "sink_index", "connection_type", "vendor_name",
        "status", "resolution_width", "resolution_heigth", "refresh_rate",
        "duration_ac", "duration_dc",
    )


def userwait(src: Tables) -> DataFrame:
    # The two-letter code is a function of a grouping column: derive it afterwards.
    totals = src["userwait"].groupBy(
        "guid", "dt", "event_name", "ac_dc_event_name",
        F.col("proc_name_current").alias("proc_name"),
    ).agg(
        F.count(F.lit(1)).alias("number_of_instances"),
        F.sum("duration_ms").alias("total_duration_ms"),
    )
    code = F.upper(F.substring("ac_dc_event_name", 1, 2))
    return totals.select(
        "guid", "dt", "event_name", "ac_dc_event_name", code.alias("acdc"), "proc_name",
        "number_of_instances", "total_duration_ms",
    )


def hw_pkg_power(src: Tables) -> DataFrame:
    return src["hw_pack_power"].select(
        "load_ts", "guid", "dt", "instance", "nrs", "mean", F.col("rap_22").alias("max")
    )


def power_days(src: Tables) -> DataFrame:
    """The fold of the long power table that feeds four tables and query 24.

    One row per device, day, event and metric, over all its rows (``nrs``, ``duration_ms``, weighted
    means) and over its cores (``core_...``: largest number of samples and duration of a core,
    plain mean of the cores' means).
    """
    core = F.col("attribute_metric_level1")
    per_core = src["power_hist"].where(F.col("metric_name").isin(*POWER_METRICS)).groupBy(
        "guid", "dt", "event_name", "metric_name", core
    ).agg(
        F.sum("nrs").alias("nrs"),
        F.sum("duration_ms").alias("duration_ms"),
        F.max("duration_ms").alias("longest_ms"),
        *[F.sum(F.col("nrs") * F.col(source)).alias(stat) for stat, source in STATISTICS.items()],
    )
    return per_core.groupBy("guid", "dt", "event_name", "metric_name").agg(
        F.sum("nrs").alias("nrs"),
        F.sum("duration_ms").alias("duration_ms"),
        F.max("longest_ms").alias("longest_ms"),
        *[ratio(F.sum(s), F.sum("nrs")).alias(s) for s in STATISTICS],
        F.max("nrs").alias("core_nrs"),
        F.max("duration_ms").alias("core_duration_ms"),
        F.max(core.try_cast("smallint")).alias("number_of_cores"),
        *[F.avg(ratio(s, "nrs")).alias(f"core_{s}") for s in STATISTICS],
    )


def _power_table(src: Tables, metric: str, suffix: str, **columns: str) -> DataFrame:
    """A table of one metric: its columns, then the statistics, from all rows or the cores."""
    prefix = "core_" if columns["nrs"].startswith("core_") else ""
    return src["power_days"].where(F.col("metric_name") == metric).select(
        "guid", "dt", "event_name",
        *[F.col(source).alias(name) for name, source in columns.items()],
        *[F.col(f"{prefix}{s}").alias(f"{s}_{suffix}") for s in STATISTICS],
    )


def pkg_c0(src: Tables) -> DataFrame:
    return _power_table(
        src, METRIC_C0, "pkg_c0", nrs="nrs", number_of_cores="number_of_cores",
        duration_ms="longest_ms",
    )


def _core_table(src: Tables, metric: str, suffix: str) -> DataFrame:
    return _power_table(
        src, metric, suffix, nrs="core_nrs", number_of_cores="number_of_cores",
        duration_ms="core_duration_ms",
    )


def pkg_avg_freq_mhz(src: Tables) -> DataFrame:
    return _core_table(src, METRIC_FREQUENCY, "avg_freq_mhz")


def pkg_temp_centigrade(src: Tables) -> DataFrame:
    return _core_table(src, METRIC_TEMPERATURE, "temp_centigrade")


def psys_rap_watts(src: Tables) -> DataFrame:
    return _power_table(
        src, METRIC_PLATFORM_POWER, "psys_rap_watts", nrs="nrs", duration_ms="duration_ms"
    )


def network_consumption(src: Tables) -> DataFrame:
    return src["network"].groupBy(
        "guid", "dt", F.col("input_description").alias("input_desc")
    ).agg(
        F.sum("nr_samples").alias("nrs"),
        F.min("min_bytes_sec").alias("min_bytes_sec"),
        weighted_mean("avg_bytes_sec", "nr_samples").alias("avg_bytes_sec"),
        F.max("max_bytes_sec").alias("max_bytes_sec"),
    )


def web_days(src: Tables) -> DataFrame:
    """The fold of the web table that feeds the usage table and the four pivots."""
    return src["web_usage"].groupBy(
        "guid", "dt", "browser", "parent_category", "sub_category"
    ).agg(
        *[
            F.sum(c).alias(c)
            for c in ("duration_ms", "page_load_count", "site_count", "domain_count",
                      "page_visit_count")
        ]
    )


def category() -> Column:
    """The output column that a (parent, sub) pair feeds, of which there is one at most."""
    parent, sub = F.col("parent_category"), F.col("sub_category")
    out = F.lit(None).cast("string")
    for (p, s), name in reversed(list(zip(CATEGORIES, CATEGORY_COLUMNS))):
        out = F.when((parent == p) if s is None else (parent == p) & (sub == s), name).otherwise(out)
    return out


def web_category_pivots(src: Tables, measures=WEB_MEASURES) -> DataFrame:
    """All category sums of all measures per device and day; columns are named
    ``<measure>__<category>``.

    The sums are taken per category first, so the pivot meets few rows of a device and day.
    """
    sums = src["web_days"].groupBy("guid", "dt", category().alias("category")).agg(
        *[F.sum(m).alias(m) for m in measures]
    )
    wide = sums.groupBy("guid", "dt").pivot("category", CATEGORY_COLUMNS).agg(
        *[F.first(m).alias(m) for m in measures]
    )
    # A pivot of one measure names its columns by the category alone.
    source = (lambda name, m: name) if len(measures) == 1 else (lambda name, m: f"{name}_{m}")
    return wide.select(
        "guid", "dt",
        *[
            F.coalesce(F.col(source(name, m)), F.lit(0)).alias(f"{m}__{name}")
            for m in measures
            for name in CATEGORY_COLUMNS
        ],
    )


def web_category_pivot(src: Tables, measure: str) -> DataFrame:
    """One measure of :func:`web_category_pivots`."""
    wide = web_category_pivots(src, (measure,))
    return wide.select(
        "guid", "dt", *[F.col(f"{measure}__{name}").alias(name) for name in CATEGORY_COLUMNS]
    )


def web_cat_usage(src: Tables) -> DataFrame:
    return src["web_days"]


def memory_utilization(src: Tables) -> DataFrame:
    # Fold the samples to device days before the device join; the join then adds
    # the RAM size to one row per device and day. A device listed several times
    # with one RAM size counts its samples as often as a row-level join would.
    free = src["memory"].groupBy("guid", "dt").agg(
        F.sum("sample_count").alias("nrs"),
        weighted_mean("average", "sample_count").alias("avg_free_ram"),
    )
    ram = (
        src["sysinfo"].where(F.col("ram") != 0).groupBy("guid", "ram")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    joined = free.join(ram, "guid")
    sized = joined.withColumn(
        "sysinfo_ram", half_even_int(F.col("ram") * F.pow(F.lit(2.0), F.lit(10.0)))
    )
    used = F.col("sysinfo_ram") - F.col("avg_free_ram")
    return sized.select(
        "guid", "dt", (F.col("nrs") * F.col("copies")).alias("nrs"), "avg_free_ram",
        "sysinfo_ram",
        used.alias("utilized_ram"),
        round_to(percent_of(used, "sysinfo_ram")).alias("avg_percentage_used"),
    )


def mods_power_consumption(src: Tables) -> DataFrame:
    # A pattern costs several times as much; only names of several lines need it.
    base_name = F.when(
        F.contains("app_id", F.lit("\n")), F.regexp_replace("app_id", r"^.*\\", "")
    ).otherwise(F.substring_index("app_id", "\\", -1))
    return src["mods_power"].groupBy(
        "guid", F.col("ts_local").cast("date").alias("dt"), base_name.alias("app_id"), "user_id"
    ).agg(*[half_even_int(F.sum(c)).alias(c) for c in POWER_COLUMNS])


def batt_dc_events(src: Tables) -> DataFrame:
    stats = []
    for side in ("on", "off"):
        percent = sentinel_null(f"power_{side}_battery_percent")
        for name, agg in (("max", F.max), ("min", F.min), ("avg", F.avg)):
            stats.append(agg(percent).alias(f"{name}_power_{side}_battery_percent"))
    return src["batt_dc_events"].groupBy(
        "load_ts", "guid", F.col("power_on_dc_ts").cast("date").alias("dt")
    ).agg(
        F.sum("duration_mins").alias("duration_mins"),
        *stats,
        F.count("power_on_dc_ts").alias("num_power_ons"),
    )


def _copy(name: str):
    return lambda src: src[name]


def _stamped(build):
    return lambda src: with_load_time(build(src))


BUILDERS = {
    "system_display_devices": display_devices,
    "system_userwait": userwait,
    "system_hw_pkg_power": hw_pkg_power,
    "system_pkg_C0": _stamped(pkg_c0),
    "system_pkg_avg_freq_mhz": _stamped(pkg_avg_freq_mhz),
    "system_pkg_temp_centigrade": _stamped(pkg_temp_centigrade),
    "system_psys_rap_watts": _stamped(psys_rap_watts),
    "system_web_cat_pivot": _copy("web_cat_pivot"),
    "system_network_consumption": _stamped(network_consumption),
    "system_web_cat_pivot_duration": partial(web_category_pivot, measure="duration_ms"),
    "system_web_cat_pivot_page_load_count": partial(web_category_pivot, measure="page_load_count"),
    "system_web_cat_pivot_page_visit_count": partial(
        web_category_pivot, measure="page_visit_count"
    ),
    "system_web_cat_pivot_domain_count": partial(web_category_pivot, measure="domain_count"),
    "system_web_cat_usage": _stamped(web_cat_usage),
    "system_memory_utilization": _stamped(memory_utilization),
    "system_mods_power_consumption": _stamped(mods_power_consumption),
    "system_batt_dc_events": batt_dc_events,
    "system_cpu_metadata": _copy("cpu_metadata"),
    "system_mods_top_blocker_hist": _copy("blockers"),
    "system_os_codename_history": _copy("os_history"),
    "system_on_off_suspend_time_day": _copy("on_off"),
    "system_frgnd_apps_types": _copy("apps"),
}


#: Frames that feed several tables: one pass over a large source each.
FOLDS = {"power_days": power_days, "web_days": web_days}


def with_folds(src: Tables, stored: Tables | None = None) -> LazyTables:
    """The sources and the folds over them, which ``stored`` replaces by their stored form."""
    known = stored or {}
    folds = {
        n: (lambda n=n: known[n]) if n in known else partial(build, src)
        for n, build in FOLDS.items()
    }
    return LazyTables({**{n: (lambda n=n: src[n]) for n in src}, **folds})


def reporting_tables(src: Tables, stored: Tables | None = None) -> LazyTables:
    """The reporting tables over ``src``, plus the folds and the device dimension under their
    own names. A table whose source is absent is left out. ``stored`` are folds that
    ``store_folds`` wrote: with them no table reads their sources again."""
    names = [
        n for n in BUILDERS if n != "system_web_cat_pivot" or "web_cat_pivot" in src
    ]
    both = with_folds(src, stored)
    tables = {n: partial(BUILDERS[n], both) for n in names}
    folds = {n: (lambda n=n: both[n]) for n in FOLDS}
    return LazyTables({**tables, **folds, "sysinfo": lambda: src["sysinfo"]})


def store_folds(src: Tables, folder: str) -> dict[str, DataFrame]:
    """Each fold written once under ``folder`` and read back.

    Rows are sorted by metric or device, so that a table reads the row groups of its own.
    """
    folds = with_folds(src)
    first = {"power_days": ["metric_name", "guid"], "web_days": ["guid", "dt"]}
    out = {}
    for name in FOLDS:
        frame = folds[name]
        write_table(frame, f"{folder}/{name}", sort_by=first[name])
        out[name] = frame.sparkSession.read.schema(frame.schema).parquet(f"{folder}/{name}")
    return out


def store_reporting(src: Tables, folder: str) -> DataFrame:
    """Store the whole layer under ``folder``, each large source read once; returns the report."""
    stored = store_folds(src, folder)
    tables = reporting_tables(src, stored)
    rest = {n: (lambda n=n: tables[n]) for n in tables if n not in FOLDS}
    return write_tables(LazyTables(rest), folder)
