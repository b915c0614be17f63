"""The analytical query library (24 queries over the reporting layer).

Every query is ``tables -> DataFrame``. Counts of distinct devices come from a
fold to one row per (group, device) rather than COUNT(DISTINCT), and facts are
folded per device before they meet the device dimension, so no join key is hot.
Thresholds of the published queries are the defaults. Result order is left to the
caller (``ordered``): a sort is a presentation step.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetveil.functions.exprs import (
    percent_of,
    ratio,
    round_to,
    row_total,
    sum_when,
    weighted_mean,
)
from fleetveil.operators.joins import fan_out_means, valid_time_join
from fleetveil.operators.ranking import full_rank, top_ranked, with_position
from fleetveil.operators.units import (
    distinct_units,
    fold_state,
    mean_of,
    unit_state,
    weighted_mean_of,
)
from fleetveil.plans.categories import CATEGORY_COLUMNS
from fleetveil.plans.reporting import (
    METRIC_C0,
    METRIC_FREQUENCY,
    METRIC_PLATFORM_POWER,
    METRIC_TEMPERATURE,
)
from fleetveil.session import stage

Tables = Mapping[str, DataFrame]

# Names that the rankings leave out, and network counter names.
NON_APPLICATIONS = ["restricted process", "desktop"]
NON_PROCESSES = ["DUMMY_PROCESS", "DESKTOP", "explorer.exe", "RESTRICTED PROCESS", "UNKNOWN"]
NON_WAIT_EVENTS = ["TOTAL_NON_WAIT_EVENTS", "TOTAL_DISCARDED_WAIT_EVENTS"]
BYTES_RECEIVED = "OS:NETWORK INTERFACE::BYTES RECEIVED/SEC::"
BYTES_SENT = "OS:NETWORK INTERFACE::BYTES SENT/SEC::"
SECONDS_PER_SAMPLE = 5

SLEEP_STATES = {"on": "on_time", "off": "off_time", "modern_sleep": "mods_time", "sleep": "sleep_time"}


def _row_means(
    fact: DataFrame,
    dimension: DataFrame | None,
    group: list[str],
    measures,
    more_than: int | None = None,
) -> DataFrame:
    """Distinct devices and row-level means per group, folded device by device."""
    dim_group = [] if dimension is None else group
    state = unit_state(fact, [*([] if dim_group else group), "guid"], measures)
    if dimension is not None:
        state = fold_state(
            state.join(dimension.select("guid", *group), "guid"), [*group, "guid"], measures
        )
    out = state.groupBy(*group).agg(
        F.count("guid").alias("number_of_systems"),
        *[ratio(F.sum(f"{m.name}__num"), F.sum(f"{m.name}__den")).alias(m.name) for m in measures],
    )
    return out if more_than is None else out.where(F.col("number_of_systems") > more_than)


def battery_by_country(t: Tables, more_than: int = 100) -> DataFrame:
    measures = [
        mean_of("avg_number_of_dc_powerons", "num_power_ons"),
        mean_of("avg_duration", "duration_mins"),
    ]
    country = t["sysinfo"].withColumn("country", F.col("countryname_normalized"))
    return _row_means(t["system_batt_dc_events"], country, ["country"], measures, more_than)


def battery_by_cpu(t: Tables, more_than: int = 100) -> DataFrame:
    cpu = t["system_cpu_metadata"].where(F.col("cpugen") != "Unknown")
    measures = [mean_of("avg_duration_mins_on_battery", "duration_mins")]
    return _row_means(
        t["system_batt_dc_events"], cpu, ["marketcodename", "cpugen"], measures, more_than
    )


def sized_displays(t: Tables) -> DataFrame:
    """Displays with a known connection and size, and their resolution label."""
    rows = t["system_display_devices"].where(
        F.col("connection_type").isNotNull()
        & (F.col("resolution_heigth") != 0)
        & (F.col("resolution_width") != 0)
    )
    label = F.concat(
        F.col("resolution_heigth").cast("string"), F.lit("x"),
        F.col("resolution_width").cast("string"),
    )
    return rows.withColumn("resolution", label)


def display_durations(t: Tables, more_than: int = 50) -> DataFrame:
    measures = [mean_of("ac", "duration_ac"), mean_of("dc", "duration_dc")]
    out = _row_means(
        sized_displays(t), None, ["connection_type", "resolution"], measures, more_than
    )
    return out.select(
        "connection_type", "resolution", "number_of_systems",
        round_to("ac", 2).alias("average_duration_on_ac_in_seconds"),
        round_to("dc", 2).alias("average_duration_on_dc_in_seconds"),
    )


def display_vendor_share(t: Tables) -> DataFrame:
    displays = t["system_display_devices"]
    per_vendor = distinct_units(displays, ["vendor_name"], "guid")
    total = displays.select("guid").distinct().agg(
        F.count("guid").alias("total_number_of_systems")
    )
    return per_vendor.crossJoin(F.broadcast(total)).withColumn(
        "percentage_of_systems",
        round_to(percent_of("number_of_systems", "total_number_of_systems"), 2),
    )


def blockers_with_os(
    t: Tables, keys: Sequence[str] = (), where: Column | None = None, **sums: str
) -> DataFrame:
    """Blocker entries with the system version valid at their time, folded beforehand.

    One row per device, time and ``keys``, with the number of entries in ``n_rows`` and a
    column for each of ``sums`` (name = summed column). A device with very many entries, also
    identical ones, is a few rows per time before the join.
    """
    facts = t["system_mods_top_blocker_hist"]
    facts = facts if where is None else facts.where(where)
    folded = facts.groupBy("guid", "dt_utc", *keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    return valid_time_join(
        folded, t["system_os_codename_history"],
        unit="guid", at="dt_utc", valid_from="min_ts", valid_to="max_ts",
    )


def blockers_by_os(t: Tables, more_than: int = 10) -> DataFrame:
    group = ["os_name", "os_codename"]
    per_unit = blockers_with_os(t).groupBy(*group, "guid").agg(F.sum("n_rows").alias("rows"))
    out = per_unit.groupBy(*group).agg(
        F.sum("rows").alias("num_entries"), F.count(F.lit(1)).alias("number_of_systems")
    )
    return out.where(F.col("number_of_systems") > more_than).withColumn(
        "entries_per_system", ratio("num_entries", "number_of_systems")
    )


def browser_devices_by_country(
    t: Tables, known_only: bool = False, max_groups_per_unit: int | None = None
) -> DataFrame:
    """(country, browser, number_of_systems): distinct devices."""
    use = t["system_web_cat_usage"].select("guid", "browser").distinct()
    if known_only:
        use = use.where(F.col("browser").isNotNull())
    country = t["sysinfo"].select("guid", F.col("countryname_normalized").alias("country"))
    return distinct_units(
        use.join(country, "guid"), ["country", "browser"], "guid", max_groups_per_unit
    )


def top_browser_by_country(t: Tables) -> DataFrame:
    counts = browser_devices_by_country(t)
    winners = top_ranked(counts, F.col("number_of_systems"), 1, ["country"])
    return winners.select("country", "browser")


def sleep_by_cpu(t: Tables, more_than: int = 100) -> DataFrame:
    total = row_total(list(SLEEP_STATES.values()))
    measures = [
        *[mean_of(source, source) for source in SLEEP_STATES.values()], mean_of("total", total)
    ]
    group = ["marketcodename", "cpugen"]
    state = unit_state(t["system_on_off_suspend_time_day"], ["guid"], measures)
    cpu = t["system_cpu_metadata"].select("guid", *group)
    state = fold_state(state.join(cpu, "guid"), [*group, "guid"], measures)

    def mean(name: str) -> Column:
        return round_to(ratio(F.sum(f"{name}__num"), F.sum(f"{name}__den")), 2)

    def share(name: str) -> Column:
        return round_to(percent_of(F.sum(f"{name}__num"), F.sum("total__num")), 2)

    out = state.groupBy(*group).agg(
        F.count(F.lit(1)).alias("number_of_systems"),
        *[mean(source).alias(f"avg_{k}_time") for k, source in SLEEP_STATES.items()],
        mean("total").alias("avg_total_time"),
        *[share(source).alias(f"avg_pcnt_{source}") for source in SLEEP_STATES.values()],
    )
    return out.where(F.col("number_of_systems") > more_than)


def category_totals_per_device(t: Tables) -> DataFrame:
    """(guid, days, one sum per category, total_duration)."""
    wide = t["system_web_cat_pivot_duration"]
    return wide.groupBy("guid").agg(
        F.count(F.lit(1)).alias("days"),
        *[F.sum(c).alias(c) for c in CATEGORY_COLUMNS],
        F.sum(row_total(CATEGORY_COLUMNS)).alias("total_duration"),
    )


def weighted_category_shares() -> list[Column]:
    """Day-weighted mean share of each category, in percent, to three digits."""
    return [
        F.expr(
            "round(round("
            f"100 * sum(days * {c} / nullif(total_duration, 0)) / nullif(sum(days), 0), 9), 3)"
        ).alias(c)
        for c in CATEGORY_COLUMNS
    ]


def persona_web_categories(t: Tables) -> DataFrame:
    persona = t["sysinfo"].select("guid", "persona")
    joined = category_totals_per_device(t).join(persona, "guid")
    sums = ["days", *CATEGORY_COLUMNS, "total_duration"]
    folded = joined.groupBy("guid", "persona").agg(*[F.sum(c).alias(c) for c in sums])
    return folded.groupBy("persona").agg(
        F.count("guid").alias("number_of_systems"),
        F.sum("days").alias("days"),
        *weighted_category_shares(),
    )


def package_power_by_country(t: Tables) -> DataFrame:
    measures = [weighted_mean_of("avg_pkg_power_consumed", "mean", "nrs")]
    return _row_means(
        t["system_hw_pkg_power"], t["sysinfo"], ["countryname_normalized"], measures
    )


def browser_shares(t: Tables) -> DataFrame:
    use = t["system_web_cat_usage"]
    per_unit = use.groupBy("browser", "guid").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("duration_ms").alias("duration")
    )
    per_browser = per_unit.groupBy("browser").agg(
        F.count("guid").alias("num_systems"),
        F.sum("rows").alias("num_instances"),
        F.sum("duration").alias("sum_duration"),
    )
    devices = per_unit.select("guid").distinct().agg(F.count("guid").alias("total_systems"))
    sums = per_browser.agg(
        F.sum("num_instances").alias("tot_instances"), F.sum("sum_duration").alias("tot_duration")
    )
    shares = per_browser.crossJoin(F.broadcast(devices)).crossJoin(F.broadcast(sums))
    return shares.select(
        "browser",
        round_to(percent_of("num_systems", "total_systems"), 2).alias("percent_systems"),
        round_to(percent_of("num_instances", "tot_instances"), 2).alias("percent_instances"),
        round_to(percent_of("sum_duration", "tot_duration"), 2).alias("percent_duration"),
    )


def ram_histogram(t: Tables) -> DataFrame:
    rows = t["system_memory_utilization"].where(F.col("avg_percentage_used") > 0)
    measures = [weighted_mean_of("avg_percentage_used", "avg_percentage_used", "nrs")]
    out = _row_means(rows, None, ["sysinfo_ram"], measures)
    return out.select(
        (F.col("sysinfo_ram") / F.pow(F.lit(2.0), F.lit(10.0))).alias("ram_gb"),
        "number_of_systems",
        round_to("avg_percentage_used").alias("avg_percentage_used"),
    )


def users_by_power(t: Tables) -> DataFrame:
    totals = t["system_mods_power_consumption"].groupBy("user_id").agg(
        F.sum("total_power_consumption").alias("total_power_consumption")
    )
    # Ranks and rows both read the sums: one pass over the power table.
    return full_rank(stage(totals), "total_power_consumption", "rnk")


def _network_per_device(t: Tables) -> DataFrame:
    volume = F.col("avg_bytes_sec") * F.col("nrs") * F.lit(SECONDS_PER_SAMPLE)
    return t["system_network_consumption"].groupBy("guid").agg(
        F.sum("nrs").alias("nrs"),
        sum_when(F.col("input_desc") == BYTES_RECEIVED, volume).alias("received_bytes"),
        sum_when(F.col("input_desc") == BYTES_SENT, volume).alias("sent_bytes"),
    )


def server_like_devices(t: Tables, min_samples: int = 720, cores: str = "ofcores") -> DataFrame:
    """Devices that send more than they receive. ``cores`` names the core-count
    column of the dimension (``#ofcores`` in the raw table)."""
    busy = _network_per_device(t).where(
        (F.col("nrs") > min_samples) & (F.col("sent_bytes") > F.col("received_bytes"))
    )
    device = t["sysinfo"].select(
        "guid", "chassistype", F.col("modelvendor_normalized").alias("vendor"),
        F.col("model_normalized").alias("model"), "ram", "os",
        F.col(f"`{cores}`").alias("number_of_cores"),
    )
    return busy.join(device, "guid").select(
        "guid", "nrs", "received_bytes", "sent_bytes", "chassistype", "vendor", "model", "ram",
        "os", "number_of_cores",
    )


def _applications(t: Tables) -> DataFrame:
    return t["system_frgnd_apps_types"].where(
        ~F.col("exe_name").isin(NON_APPLICATIONS) & F.col("app_type").isNotNull()
    )


def apps_by_focal_time(t: Tables, k: int = 10) -> DataFrame:
    means = _applications(t).groupBy("app_type", "exe_name").agg(
        F.avg("totalsecfocal_day").alias("average_focal_sec_per_day")
    )
    top = top_ranked(means, F.col("average_focal_sec_per_day"), k, ["app_type"])
    return top.withColumn("average_focal_sec_per_day", round_to("average_focal_sec_per_day"))


def apps_by_devices(t: Tables, k: int = 10) -> DataFrame:
    counts = distinct_units(_applications(t), ["app_type", "exe_name"], "guid")
    return top_ranked(counts, F.col("number_of_systems"), k, ["app_type"])


def apps_by_detections(t: Tables, k: int = 10) -> DataFrame:
    sums = _applications(t).groupBy("app_type", "exe_name").agg(
        F.sum("lines_per_day").alias("total_number_of_detections")
    )
    return top_ranked(sums, F.col("total_number_of_detections"), k, ["app_type"])


def processes_by_user_power(t: Tables, k: int = 10) -> DataFrame:
    sums = t["system_mods_power_consumption"].groupBy("user_id", "app_id").agg(
        F.sum("total_power_consumption").alias("total_power_consumption")
    )
    return top_ranked(sums, F.col("total_power_consumption"), k, ["user_id"], "rnk")


def top_power_processes(t: Tables, k: int = 20) -> DataFrame:
    """Shows the mean, ranks by the sum."""
    per_app = t["system_mods_power_consumption"].groupBy("app_id").agg(
        F.avg("total_power_consumption").alias("total_power_consumption"),
        F.sum("total_power_consumption").alias("sum_power"),
    )
    return top_ranked(per_app, F.col("sum_power"), k, name="rnk").drop("sum_power")


def blocker_durations(t: Tables) -> DataFrame:
    group = ["os_name", "os_codename", "blocker_name", "blocker_type", "activity_level"]
    rows = blockers_with_os(t, group[2:], F.col("active_time_ms") > 0, ms="active_time_ms")
    per_unit = rows.groupBy(*group, "guid").agg(
        F.sum("ms").alias("ms"), F.sum("n_rows").alias("rows")
    )
    return per_unit.groupBy(*group).agg(
        F.count("guid").alias("number_of_clients"),
        ratio(F.sum("ms") / F.lit(1000.0), F.sum("rows")).alias("average_active_time_in_seconds"),
        F.sum("rows").alias("number_of_occurences"),
    )


def _is_wait() -> Column:
    return ~F.col("proc_name").isin(NON_PROCESSES) & ~F.col("event_name").isin(NON_WAIT_EVENTS)


def _seconds() -> Column:
    return F.col("total_duration_ms") / F.lit(1000.0)


def _seconds_per_instance() -> Column:
    return ratio(F.sum(_seconds()), F.sum("number_of_instances"))


def top_wait_processes(t: Tables, k: int = 10) -> DataFrame:
    per_process = t["system_userwait"].where(_is_wait()).groupBy("proc_name").agg(
        _seconds_per_instance().alias("total_duration_sec_per_instance")
    )
    return top_ranked(per_process, F.col("total_duration_sec_per_instance"), k)


def top_wait_processes_by_type(t: Tables, k: int = 10) -> DataFrame:
    per_process = t["system_userwait"].where(_is_wait()).groupBy(
        "event_name", "acdc", "proc_name"
    ).agg(_seconds_per_instance().alias("total_duration_sec_per_instance"))
    top = top_ranked(
        per_process, F.col("total_duration_sec_per_instance"), k, ["event_name", "acdc"]
    )
    return top.withColumn(
        "total_duration_sec_per_instance", round_to("total_duration_sec_per_instance", 2)
    )


def wait_processes_by_power_source(
    t: Tables, k: int = 20, min_instances: int = 50, min_devices: int = 20
) -> DataFrame:
    """The top ``k`` wait processes with their seconds per instance on AC, DC and
    unknown power. Both sides come from one fold of the wait table per process,
    power source and device; the ranking looks at wait events only, the shown
    durations at all events of the process."""
    waits = F.col("is_wait")
    folded = (
        t["system_userwait"]
        .withColumn("is_wait", F.coalesce(_is_wait(), F.lit(False)))
        .groupBy("proc_name", "acdc", "guid")
        .agg(
            F.sum("number_of_instances").alias("instances"),
            F.sum(_seconds()).alias("duration_s"),
            F.sum(F.when(waits, F.col("number_of_instances"))).alias("wait_instances"),
            F.sum(F.when(waits, _seconds())).alias("wait_s"),
        )
    )
    eligible = (
        folded.where(F.col("wait_instances").isNotNull())
        .groupBy("proc_name", "guid")
        .agg(F.sum("wait_instances").alias("n"), F.sum("wait_s").alias("s"))
        .groupBy("proc_name")
        .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("guid").alias("devices"))
        .where((F.col("n") > min_instances) & (F.col("devices") > min_devices))
        .withColumn("seconds", ratio("s", "n"))
    )
    top = top_ranked(eligible, F.col("seconds"), k).select("proc_name")
    by_source = folded.groupBy("proc_name", "acdc").agg(
        F.sum("instances").alias("n"), F.sum("duration_s").alias("s")
    )
    seconds = round_to(ratio("s", "n"), 2)
    return by_source.join(top, "proc_name").groupBy("proc_name").agg(
        sum_when(F.col("acdc") == "AC", seconds).alias("ac_duration"),
        sum_when(F.col("acdc") == "DC", seconds).alias("dc_duration"),
        sum_when(F.col("acdc") == "UN", seconds).alias("unknown_duration"),
    )


def network_by_processor_class(t: Tables) -> DataFrame:
    kind = F.when(F.col("cpuname") == "Xeon", "Server Class").otherwise("Non-Server Class")
    device = t["sysinfo"].select("guid", "os", kind.alias("processor_class"))
    per_device = _network_per_device(t).join(device, "guid")
    folded = per_device.groupBy("guid", "os", "processor_class").agg(
        *[F.sum(c).alias(c) for c in ("nrs", "received_bytes", "sent_bytes")]
    )
    return folded.groupBy("processor_class", "os").agg(
        F.count("guid").alias("number_of_systems"),
        weighted_mean("received_bytes", "nrs").alias("avg_bytes_received"),
        weighted_mean("sent_bytes", "nrs").alias("avg_bytes_sent"),
    )


# Query 24: output column, metric, value and weight column of the power fold.
_PLATFORM_MEANS = (
    ("avg_psys_rap_watts", METRIC_PLATFORM_POWER, "avg", "nrs"),
    ("avg_pkg_c0", METRIC_C0, "avg", "nrs"),
    ("avg_freq_mhz", METRIC_FREQUENCY, "core_avg", "core_nrs"),
    ("avg_temp_centigrade", METRIC_TEMPERATURE, "core_avg", "core_nrs"),
)


def platform_by_chassis(t: Tables) -> DataFrame:
    """All four means from one pass over the power fold, a row per device."""
    sums = []
    for name, metric, value, weight in _PLATFORM_MEANS:
        of = lambda c, m=metric: F.when(F.col("metric_name") == m, c)
        sums += [
            F.sum(of(F.col(weight) * F.col(value))).alias(f"{name}__s"),
            F.sum(of(F.col(weight))).cast("double").alias(f"{name}__w"),
            F.count(of(F.lit(1))).cast("double").alias(f"{name}__c"),
        ]
    per_device = t["power_days"].groupBy("guid").agg(*sums)
    names = [name for name, *_ in _PLATFORM_MEANS]
    return fan_out_means(t["sysinfo"], per_device, names, "guid", ["chassistype"])


QUERIES: dict[int, Callable[..., DataFrame]] = {
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
    13: server_like_devices,
    14: apps_by_focal_time,
    15: apps_by_devices,
    16: apps_by_detections,
    17: processes_by_user_power,
    18: top_power_processes,
    19: blocker_durations,
    20: top_wait_processes,
    21: top_wait_processes_by_type,
    22: wait_processes_by_power_source,
    23: network_by_processor_class,
    24: platform_by_chassis,
}

# The presentation order of each query: column, descending.
ORDERS: dict[int, list[tuple[str, bool]]] = {
    1: [("avg_number_of_dc_powerons", True)],
    3: [("connection_type", False), ("number_of_systems", True)],
    4: [("percentage_of_systems", True)],
    8: [("number_of_systems", True)],
    9: [("avg_pkg_power_consumed", True)],
    11: [("ram_gb", False)],
    14: [("app_type", False), ("rank", False)],
    15: [("app_type", False), ("rank", False)],
    16: [("app_type", False), ("rank", False)],
    20: [("rank", False)],
    21: [("acdc", False), ("event_name", False), ("rank", False)],
    22: [("proc_name", False)],
    23: [("processor_class", False), ("os", False)],
}


def ordered(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Sort for presentation, NULLs last either way."""
    return df.orderBy(
        *[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in keys]
    )


def positioned(number: int, result: DataFrame) -> DataFrame:
    """The result with the place of each row in the query's presentation order, from 1; rows
    that the order leaves equal follow their other columns."""
    keys = ORDERS[number]
    rest = [(c, False) for c in result.columns if c not in {k for k, _ in keys}]
    order = [
        F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last()
        for c, down in [*keys, *rest]
    ]
    return with_position(result, order)


def run_query(number: int, tables: Tables, sort: bool = True, **options) -> DataFrame:
    out = QUERIES[number](tables, **options)
    return ordered(out, ORDERS[number]) if sort and number in ORDERS else out
