"""Registered queries: the output columns and the oracle text of each."""

from __future__ import annotations

from fleetveil.operators.noise import Policy
from fleetveil.plans.categories import CATEGORY_COLUMNS
from fleetveil.plans.reporting import WEB_MEASURES
from fleetveil.plans.registry import EPSILON_GRID, epsilon_label
from oracles.build import pick, with_ctes
from oracles.noise_plan import classic, plan_ctes
from oracles.texts import (
    CTES,
    DEMO_LIMITS,
    DEMO_REGISTRY,
    POWER_PARTS,
    cells_text,
    key_part,
    p_value,
    pivot_columns,
)

CASES: dict[str, tuple[str, str]] = {}


def _case(name: str, spec: str, sql: str) -> None:
    CASES[name] = (spec, sql)


def _d(*names: str) -> str:
    return " ".join(f"{n}:d" for n in names)


_STATS4 = ("min", "avg", "med", "max")


def _stats(suffix: str) -> str:
    return _d(*[f"{s}_{suffix}" for s in _STATS4])


# ---------------------------------------------------------------- reporting tables
_KEY = "guid:i dt:s event_name:s nrs:d"
_case("r01_display_devices",
      "guid:i dt:s display_id:i adapter_id:i port:i sink_index:i connection_type:s vendor_name:s "
      "status:s resolution_width:i resolution_heigth:i refresh_rate:i duration_ac:d duration_dc:d",
      "SELECT * FROM rep_display")
_case("r02_userwait",
      "guid:i dt:s event_name:s ac_dc_event_name:s acdc:s proc_name:s number_of_instances:i "
      "total_duration_ms:d", "SELECT * FROM rep_userwait")
_case("r03_hw_pkg_power", "guid:i dt:s instance:s nrs:i mean:d max:d", "SELECT * FROM rep_hwpkg")
_case("r04_pkg_c0", f"{_KEY} number_of_cores:i duration_ms:d {_stats('pkg_c0')}",
      "SELECT * FROM rep_c0")
_case("r05_pkg_freq", f"{_KEY} number_of_cores:i duration_ms:d {_stats('avg_freq_mhz')}",
      "SELECT * FROM rep_freq")
_case("r06_pkg_temp", f"{_KEY} number_of_cores:i duration_ms:d {_stats('temp_centigrade')}",
      "SELECT * FROM rep_temp")
_case("r07_psys_watts", f"{_KEY} duration_ms:d {_stats('psys_rap_watts')}",
      "SELECT * FROM rep_psys")
_case("r09_network",
      "guid:i dt:s input_desc:s nrs:i min_bytes_sec:d avg_bytes_sec:d max_bytes_sec:d",
      "SELECT * FROM rep_net")
_case("r10_13_web_pivots",
      "guid:i dt:s " + _d(*[f"{m}__{c}" for m in WEB_MEASURES for c in CATEGORY_COLUMNS]),
      "SELECT guid, dt, " + ", ".join(pivot_columns(m, f"{m}__") for m in WEB_MEASURES)
      + " FROM src_web_usage GROUP BY guid, dt")
_case("r14_web_usage",
      "guid:i dt:s browser:s parent_category:s sub_category:s duration_ms:d page_load_count:i "
      "site_count:i domain_count:i page_visit_count:i", "SELECT * FROM rep_web")
_case("r15_memory",
      "guid:i dt:s nrs:i avg_free_ram:d sysinfo_ram:i utilized_ram:d avg_percentage_used:d",
      "SELECT * FROM rep_mem")
_case("r16_mods_power",
      "guid:i dt:s app_id:s user_id:s "
      + " ".join(f"{p}_power_consumption:i" for p in POWER_PARTS), "SELECT * FROM rep_power")
_case("r17_batt_events",
      "load_ts:s guid:i dt:s duration_mins:d "
      + " ".join(f"{f}_power_{s}_battery_percent:d"
                 for s in ("on", "off") for f in ("max", "min", "avg"))
      + " num_power_ons:i", "SELECT * FROM rep_batt")
_case("r18_cpu_metadata", "guid:i marketcodename:s cpugen:s", "SELECT * FROM src_cpu_metadata")
_case("r19_blockers", "guid:i blocker_name:s blocker_type:s activity_level:s active_time_ms:i",
      "SELECT * FROM src_blockers")
_case("r20_os_history", "guid:i os_name:s os_codename:s", "SELECT * FROM src_os_history")
_case("r21_on_off", "guid:i dt:s on_time:d off_time:d mods_time:d sleep_time:d",
      "SELECT * FROM src_on_off")
_case("r22_apps", "guid:i app_type:s exe_name:s totalsecfocal_day:d lines_per_day:i",
      "SELECT * FROM src_apps")

# ---------------------------------------------------------------------- validation
COVERAGE = {
    "system_display_devices": "rep_display", "system_userwait": "rep_userwait",
    "system_hw_pkg_power": "rep_hwpkg", "system_pkg_C0": "rep_c0",
    "system_pkg_avg_freq_mhz": "rep_freq", "system_pkg_temp_centigrade": "rep_temp",
    "system_psys_rap_watts": "rep_psys", "system_network_consumption": "rep_net",
    "system_web_cat_pivot_duration": "rep_webdur",
    "system_web_cat_pivot_page_load_count": "rep_webdur",
    "system_web_cat_pivot_page_visit_count": "rep_webdur",
    "system_web_cat_pivot_domain_count": "rep_webdur", "system_web_cat_usage": "rep_web",
    "system_memory_utilization": "rep_mem", "system_mods_power_consumption": "rep_power",
    "system_batt_dc_events": "rep_batt", "system_cpu_metadata": "src_cpu_metadata",
    "system_mods_top_blocker_hist": "src_blockers", "system_os_codename_history": "src_os_history",
    "system_on_off_suspend_time_day": "src_on_off", "system_frgnd_apps_types": "src_apps",
}
_case("v01_coverage", "table_name:s row_count:i unique_guids:i",
      " UNION ALL ".join(
          f"SELECT '{t}' AS table_name, count(*) AS row_count, count(DISTINCT guid) AS unique_guids "
          f"FROM {c}" for t, c in COVERAGE.items()))
_case("v02_source_coverage", "table_name:s row_count:i unique_guids:i",
      "SELECT 'sysinfo' AS table_name, count(*) AS row_count, count(DISTINCT guid) AS unique_guids "
      "FROM src_sysinfo")
_case("v04_negative_ram", "check_name:s neg_utilized_count:i",
      "SELECT 'Negative RAM Utilization Check' AS check_name, count(*) AS neg_utilized_count "
      "FROM rep_mem WHERE utilized_ram < 0")
_OVERLONG = ("SELECT guid, dt, sum(duration_ac + duration_dc) AS total_duration FROM rep_display "
             "GROUP BY guid, dt HAVING total_duration > 20000")
_case("v05_overlong_days", "check_name:s excessive_duration_count:i",
      f"SELECT 'Display Duration > 24hrs Check' AS check_name, count(*) AS excessive_duration_count "
      f"FROM ({_OVERLONG}) d")
_case("v06_top_overlong", "guid:i dt:s total_duration:d",
      f"SELECT * FROM ({_OVERLONG}) d ORDER BY total_duration DESC, guid, dt LIMIT 50")
_case("v07_status", "status:s n:i", "SELECT status, count(*) AS n FROM rep_display GROUP BY status")
_case("v08_categories", "category:s",
      "SELECT DISTINCT concat(parent_category, '-', sub_category) AS category FROM src_web_usage "
      "ORDER BY 1")
_case("v09_battery_nulls",
      "check_name:s total_events:i non_null_max_on:i non_null_min_on:i non_null_avg_on:i",
      "SELECT 'Battery Events NULLIF Check' AS check_name, count(*) AS total_events, "
      + ", ".join(f"count({s}_power_on_battery_percent) AS non_null_{s}_on"
                  for s in ("max", "min", "avg")) + " FROM rep_batt")
_case("v10_cpu_coverage",
      "check_name:s unique_systems:i unique_market_codes:i unique_cpu_gens:i",
      "SELECT 'CPU Metadata Check' AS check_name, count(DISTINCT guid) AS unique_systems, "
      "count(DISTINCT marketcodename) AS unique_market_codes, "
      "count(DISTINCT cpugen) AS unique_cpu_gens FROM src_cpu_metadata")
_case("v11_app_coverage", "check_name:s unique_systems:i unique_app_types:i unique_exe_names:i",
      "SELECT 'Foreground Apps Check' AS check_name, count(DISTINCT guid) AS unique_systems, "
      "count(DISTINCT app_type) AS unique_app_types, count(DISTINCT exe_name) AS unique_exe_names "
      "FROM src_apps")
_case("v13_devices", "metric:s unique_systems:i",
      "SELECT 'Overall Coverage' AS metric, count(DISTINCT guid) AS unique_systems FROM src_sysinfo")
_case("v14_date_range", "metric:s earliest_date:s latest_date:s days_span:i",
      "SELECT 'Date Range' AS metric, min(dt) AS earliest_date, max(dt) AS latest_date, "
      "date_diff('day', min(dt), max(dt)) AS days_span FROM rep_display")
# What a clipped result may reach; "device" is times the devices of the group.
_BOUNDS = """
 1 avg_number_of_dc_powerons 10 value
 1 avg_duration 60 value
 2 avg_duration_mins_on_battery 60 value
 3 average_duration_on_ac_in_seconds 3600 value
 3 average_duration_on_dc_in_seconds 3600 value
 4 percentage_of_systems 100 value
 5 entries_per_system 50 value
 5 num_entries 50 device
 7 avg_on_time 1440 value
 7 avg_off_time 1440 value
 7 avg_modern_sleep_time 1440 value
 7 avg_sleep_time 1440 value
 7 avg_total_time 5760 value
 7 avg_pcnt_on_time 100 value
 7 avg_pcnt_off_time 100 value
 7 avg_pcnt_mods_time 100 value
 7 avg_pcnt_sleep_time 100 value
 8 days 365 device
 9 avg_pkg_power_consumed 50 value
10 percent_systems 100 value
10 percent_instances 100 value
10 percent_duration 100 value
11 avg_percentage_used 100 value
12 total_power_consumption 100 value
"""
_RULES = ", ".join(
    f"({q}, '{c}', 0.0, {high}.0, {kind == 'device'})"
    for q, c, high, kind in map(str.split, _BOUNDS.strip().splitlines())
)
_case("v15_bounds", "query_num:i column:s n_cells:i n_violations:i",
      f"""SELECT c.query_num, c.col AS "column", count(*) AS n_cells, count(*) FILTER (WHERE
              c.true_value IS NULL OR c.true_value NOT BETWEEN low AND high * CASE WHEN per_device
              THEN u.true_value ELSE 1 END) AS n_violations
          FROM cells c JOIN (SELECT * FROM (VALUES {_RULES}) AS v(query_num, col, low, high, per_device)) r
            ON r.query_num = c.query_num AND r.col = c.col
          LEFT JOIN cells u ON u.query_num = c.query_num AND u.group_key = c.group_key
            AND u.col = 'number_of_systems' AND per_device GROUP BY 1, 2""")

# -------------------------------------------------------------- analytical queries
# Thresholds that split the small test groups.
Q_OPTIONS: dict[int, dict] = {
    1: {"more_than": 50}, 2: {"more_than": 50}, 3: {"more_than": 50}, 5: {"more_than": 10},
    7: {"more_than": 5},
}
_STATE_COLS = ("on_time", "off_time", "mods_time", "sleep_time")
_STATE_SUM = " + ".join(_STATE_COLS)
_WAIT = ("proc_name NOT IN ('DUMMY_PROCESS', 'DESKTOP', 'explorer.exe', 'RESTRICTED PROCESS', 'UNKNOWN') "
         "AND event_name NOT IN ('TOTAL_NON_WAIT_EVENTS', 'TOTAL_DISCARDED_WAIT_EVENTS')")
_SEC = "sum(total_duration_ms / 1e3) / sum(number_of_instances)"
_VALID = ("src_blockers b JOIN src_os_history h ON h.guid = b.guid "
          "AND dt_utc >= min_ts AND dt_utc <= max_ts")
_NET = """SELECT guid, sum(nrs) AS nrs,
    coalesce(sum(avg_bytes_sec * nrs * 5) FILTER (WHERE input_desc LIKE '%RECEIVED%'), 0) AS received_bytes,
    coalesce(sum(avg_bytes_sec * nrs * 5) FILTER (WHERE input_desc LIKE '%SENT%'), 0) AS sent_bytes
    FROM rep_net GROUP BY guid"""
_APPS = "FROM src_apps WHERE app_type IS NOT NULL AND exe_name NOT IN ('restricted process', 'desktop')"


def _top(inner: str, by: str, k: int, partition: str = "", name: str = "rank") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return (f"SELECT * FROM (SELECT *, rank() OVER ({part}ORDER BY {by} DESC) AS {name} "
            f"FROM ({inner}) g) r WHERE {name} <= {k}")


_case("q01_battery_by_country",
      "country:s number_of_systems:i avg_number_of_dc_powerons:d avg_duration:d",
      """SELECT countryname_normalized AS country, count(DISTINCT b.guid) AS number_of_systems,
         avg(num_power_ons) AS avg_number_of_dc_powerons, avg(duration_mins) AS avg_duration
         FROM rep_batt b JOIN src_sysinfo s ON s.guid = b.guid GROUP BY 1
         HAVING count(DISTINCT b.guid) > 50""")
_case("q02_battery_by_cpu",
      "marketcodename:s cpugen:s number_of_systems:i avg_duration_mins_on_battery:d",
      """SELECT marketcodename, cpugen, count(DISTINCT b.guid) AS number_of_systems,
         avg(duration_mins) AS avg_duration_mins_on_battery
         FROM rep_batt b JOIN src_cpu_metadata c ON c.guid = b.guid WHERE cpugen <> 'Unknown'
         GROUP BY 1, 2 HAVING count(DISTINCT b.guid) > 50""")
_case("q03_display_durations",
      "connection_type:s resolution:s number_of_systems:i average_duration_on_ac_in_seconds:d "
      "average_duration_on_dc_in_seconds:d",
      """SELECT connection_type, concat(resolution_heigth, 'x', resolution_width) AS resolution,
         count(DISTINCT guid) AS number_of_systems,
         round_dec(avg(duration_ac), 2) AS average_duration_on_ac_in_seconds,
         round_dec(avg(duration_dc), 2) AS average_duration_on_dc_in_seconds
         FROM rep_display WHERE connection_type IS NOT NULL AND resolution_heigth <> 0
         AND resolution_width <> 0 GROUP BY 1, 2 HAVING count(DISTINCT guid) > 50""")
_case("q04_vendor_share",
      "vendor_name:s number_of_systems:i total_number_of_systems:i percentage_of_systems:d",
      """SELECT vendor_name, count(DISTINCT guid) AS number_of_systems, total_number_of_systems,
         round_dec(count(DISTINCT guid) * 1e2 / total_number_of_systems, 2) AS percentage_of_systems
         FROM rep_display, (SELECT count(DISTINCT guid) AS total_number_of_systems FROM rep_display) t
         GROUP BY vendor_name, total_number_of_systems""")
_case("q05_blockers_by_os",
      "os_name:s os_codename:s num_entries:i number_of_systems:i entries_per_system:d",
      f"""SELECT os_name, os_codename, count(*) AS num_entries,
          count(DISTINCT b.guid) AS number_of_systems,
          CAST(count(*) AS DOUBLE) / count(DISTINCT b.guid) AS entries_per_system
          FROM {_VALID} GROUP BY 1, 2 HAVING count(DISTINCT b.guid) > 10""")
_case("q06_top_browser", "country:s browser:s",
      "SELECT country, browser FROM ("
      + _top("""SELECT countryname_normalized AS country, browser, count(DISTINCT w.guid) AS n
                FROM rep_web w JOIN src_sysinfo s ON s.guid = w.guid GROUP BY 1, 2""",
             "n", 1, "country") + ") x")
_case("q07_sleep_by_cpu",
      "marketcodename:s cpugen:s number_of_systems:i avg_on_time:d avg_off_time:d "
      "avg_modern_sleep_time:d avg_sleep_time:d avg_total_time:d avg_pcnt_on_time:d "
      "avg_pcnt_off_time:d avg_pcnt_mods_time:d avg_pcnt_sleep_time:d",
      f"""SELECT marketcodename, cpugen, count(DISTINCT o.guid) AS number_of_systems,
          round_dec(avg(on_time), 2) AS avg_on_time, round_dec(avg(off_time), 2) AS avg_off_time,
          round_dec(avg(mods_time), 2) AS avg_modern_sleep_time, round_dec(avg(sleep_time), 2) AS avg_sleep_time,
          round_dec(avg({_STATE_SUM}), 2) AS avg_total_time,
          {', '.join(f"round_dec(sum({s}) * 1e2 / sum({_STATE_SUM}), 2) AS avg_pcnt_{s}" for s in _STATE_COLS)}
          FROM src_on_off o JOIN src_cpu_metadata c ON c.guid = o.guid GROUP BY 1, 2
          HAVING count(DISTINCT o.guid) > 5""")
_case("q08_persona_web", "persona:s number_of_systems:i days:i " + _d(*CATEGORY_COLUMNS),
      f"""SELECT persona, count(DISTINCT guid) AS number_of_systems, sum(days) AS days,
          {', '.join(f"round_dec(1e2 * sum(days * {c} / nullif(total, 0)) / sum(days), 3) AS {c}"
                     for c in CATEGORY_COLUMNS)}
          FROM (SELECT w.guid, persona, count(*) AS days,
                {', '.join(f"sum({c}) AS {c}" for c in CATEGORY_COLUMNS)},
                sum({' + '.join(CATEGORY_COLUMNS)}) AS total
                FROM rep_webdur w JOIN src_sysinfo s ON s.guid = w.guid GROUP BY 1, 2) d
          GROUP BY persona""")
_case("q09_package_power",
      "countryname_normalized:s number_of_systems:i avg_pkg_power_consumed:d",
      """SELECT countryname_normalized, count(DISTINCT p.guid) AS number_of_systems,
         sum(nrs * mean) / sum(nrs) AS avg_pkg_power_consumed
         FROM rep_hwpkg p JOIN src_sysinfo s ON s.guid = p.guid GROUP BY 1""")
_case("q10_browser_shares", "browser:s percent_systems:d percent_instances:d percent_duration:d",
      """SELECT browser, round_dec(count(DISTINCT guid) * 1e2 / s, 2) AS percent_systems,
         round_dec(count(*) * 1e2 / n, 2) AS percent_instances,
         round_dec(sum(duration_ms) * 1e2 / d, 2) AS percent_duration
         FROM rep_web, (SELECT count(DISTINCT guid) AS s, count(*) AS n, sum(duration_ms) AS d
                        FROM rep_web) t GROUP BY browser, s, n, d""")
_case("q11_ram_histogram", "ram_gb:d number_of_systems:i avg_percentage_used:d",
      """SELECT sysinfo_ram / 1024 AS ram_gb, count(DISTINCT guid) AS number_of_systems,
         round_dec(sum(nrs * avg_percentage_used) / sum(nrs)) AS avg_percentage_used
         FROM rep_mem WHERE avg_percentage_used > 0 GROUP BY sysinfo_ram""")
_case("q12_users_by_power", "user_id:s total_power_consumption:i rnk:i",
      """SELECT user_id, sum(total_power_consumption) AS total_power_consumption,
         rank() OVER (ORDER BY sum(total_power_consumption) DESC) AS rnk
         FROM rep_power GROUP BY user_id""")
_case("q13_server_like",
      "guid:i nrs:i received_bytes:d sent_bytes:d chassistype:s vendor:s model:s ram:i os:s "
      "number_of_cores:i",
      f"""SELECT n.*, chassistype, modelvendor_normalized AS vendor, model_normalized AS model, ram, os,
          ofcores AS number_of_cores FROM ({_NET} HAVING sum(nrs) > 720) n
          JOIN src_sysinfo s ON s.guid = n.guid WHERE sent_bytes > received_bytes""")
_case("q14_apps_focal", "app_type:s exe_name:s average_focal_sec_per_day:d rank:i",
      "SELECT app_type, exe_name, round_dec(v) AS average_focal_sec_per_day, rank FROM ("
      + _top(f"SELECT app_type, exe_name, avg(totalsecfocal_day) AS v {_APPS} GROUP BY 1, 2",
             "v", 10, "app_type") + ") x")
_case("q15_apps_devices", "app_type:s exe_name:s number_of_systems:i rank:i",
      _top(f"SELECT app_type, exe_name, count(DISTINCT guid) AS number_of_systems {_APPS} GROUP BY 1, 2",
           "number_of_systems", 10, "app_type"))
_case("q16_apps_detections", "app_type:s exe_name:s total_number_of_detections:i rank:i",
      _top(f"SELECT app_type, exe_name, sum(lines_per_day) AS total_number_of_detections {_APPS} "
           "GROUP BY 1, 2", "total_number_of_detections", 10, "app_type"))
_case("q17_user_processes", "user_id:s app_id:s total_power_consumption:i rnk:i",
      _top("SELECT user_id, app_id, sum(total_power_consumption) AS total_power_consumption "
           "FROM rep_power GROUP BY 1, 2", "total_power_consumption", 10, "user_id", "rnk"))
_case("q18_power_processes", "app_id:s total_power_consumption:d rnk:i",
      "SELECT app_id, v AS total_power_consumption, rnk FROM ("
      + _top("SELECT app_id, avg(total_power_consumption) AS v, sum(total_power_consumption) AS s "
             "FROM rep_power GROUP BY 1", "s", 20, name="rnk") + ") x")
_case("q19_blocker_durations",
      "os_name:s os_codename:s blocker_name:s blocker_type:s activity_level:s number_of_clients:i "
      "average_active_time_in_seconds:d number_of_occurences:i",
      f"""SELECT os_name, os_codename, blocker_name, blocker_type, activity_level,
          count(DISTINCT b.guid) AS number_of_clients,
          avg(active_time_ms / 1e3) AS average_active_time_in_seconds, count(*) AS number_of_occurences
          FROM {_VALID} WHERE active_time_ms > 0 GROUP BY 1, 2, 3, 4, 5""")
_case("q20_wait_processes", "proc_name:s total_duration_sec_per_instance:d rank:i",
      _top(f"SELECT proc_name, {_SEC} AS total_duration_sec_per_instance FROM rep_userwait "
           f"WHERE {_WAIT} GROUP BY 1", "total_duration_sec_per_instance", 10))
_case("q21_wait_by_type",
      "event_name:s acdc:s proc_name:s total_duration_sec_per_instance:d rank:i",
      "SELECT * REPLACE (round_dec(total_duration_sec_per_instance, 2) AS total_duration_sec_per_instance) "
      "FROM (" + _top(
          f"SELECT event_name, acdc, proc_name, {_SEC} AS total_duration_sec_per_instance "
          f"FROM rep_userwait WHERE {_WAIT} GROUP BY 1, 2, 3",
          "total_duration_sec_per_instance", 10, "event_name, acdc") + ") x")
_case("q22_wait_by_power", "proc_name:s ac_duration:d dc_duration:d unknown_duration:d",
      "SELECT proc_name, "
      + ", ".join(f"coalesce(sum(v) FILTER (WHERE acdc = '{a}'), 0) AS {n}_duration"
                  for a, n in (("AC", "ac"), ("DC", "dc"), ("UN", "unknown")))
      + f""" FROM (SELECT proc_name, acdc, round_dec({_SEC}, 2) AS v FROM rep_userwait
             WHERE proc_name IN (SELECT proc_name FROM ("""
      + _top(f"SELECT proc_name, {_SEC} AS v FROM rep_userwait WHERE {_WAIT} GROUP BY 1 "
             "HAVING sum(number_of_instances) > 50 AND count(DISTINCT guid) > 20", "v", 20)
      + ") t) GROUP BY 1, 2) y GROUP BY proc_name")
_case("q23_network_by_class",
      "processor_class:s os:s number_of_systems:i avg_bytes_received:d avg_bytes_sent:d",
      f"""SELECT CASE WHEN cpuname = 'Xeon' THEN 'Server Class' ELSE 'Non-Server Class' END
          AS processor_class, os, count(DISTINCT n.guid) AS number_of_systems,
          sum(nrs * received_bytes) / sum(nrs) AS avg_bytes_received,
          sum(nrs * sent_bytes) / sum(nrs) AS avg_bytes_sent
          FROM ({_NET}) n JOIN src_sysinfo s ON s.guid = n.guid GROUP BY 1, 2""")
_case("q24_platform_by_chassis",
      "chassistype:s number_of_systems:i avg_psys_rap_watts:d avg_pkg_c0:d avg_freq_mhz:d "
      "avg_temp_centigrade:d",
      """SELECT chassistype, count(DISTINCT s.guid) AS number_of_systems,
         sum(w.nrs * avg_psys_rap_watts) / sum(w.nrs) AS avg_psys_rap_watts,
         sum(c.nrs * avg_pkg_c0) / sum(c.nrs) AS avg_pkg_c0,
         sum(f.nrs * avg_avg_freq_mhz) / sum(f.nrs) AS avg_freq_mhz,
         sum(t.nrs * avg_temp_centigrade) / sum(t.nrs) AS avg_temp_centigrade
         FROM src_sysinfo s JOIN rep_psys w ON w.guid = s.guid JOIN rep_c0 c ON c.guid = s.guid
         JOIN rep_freq f ON f.guid = s.guid JOIN rep_temp t ON t.guid = s.guid GROUP BY chassistype""")

# ------------------------------------------------------------------ release queries
for _q in DEMO_REGISTRY.values():
    _ints = {"number_of_systems", "total_number_of_systems", "days", "num_entries"}
    _cols = " ".join(f"{c.name}:{'i' if c.name in _ints else 'd'}" for c in _q.columns)
    _keys = " ".join(f"{k}:{'d' if k == 'ram_gb' else 's'}" for k in _q.keys)
    _extra = {6: "browser:s", 12: "rnk:i"}.get(_q.number, "")
    _case(f"e{_q.number:02d}_release", f"{_keys} {_cols} {_extra}",
          f"SELECT * FROM e{_q.number:02d}")

# ------------------------------------------------------------------ private release
_CELL = "query_num:i mechanism:s epsilon:s group_key:s column:s true_value:d noisy_value:d"
_REL = 'SELECT *, col AS "column" FROM released'
_case("d03_norms", "query_num:i n_columns:i n_cells:i l1_sensitivity:d l2_sensitivity:d",
      """SELECT query_num, count(*) AS n_columns, sum(n) AS n_cells,
         sum(sensitivity * groups) AS l1_sensitivity,
         sqrt(sum(sensitivity * sensitivity * groups)) AS l2_sensitivity
         FROM (SELECT query_num, col, count(*) AS n FROM cells GROUP BY 1, 2)
         JOIN plan_columns USING (query_num, col)
         GROUP BY query_num""")
_case("d04_scales",
      "query_num:i column:s mechanism:s epsilon:s column_epsilon:d scale:d n_cells:i",
      'SELECT *, col AS "column" FROM plan JOIN (SELECT query_num, col, count(*) AS n_cells '
      "FROM cells GROUP BY 1, 2) USING (query_num, col) WHERE epsilon <> 'inf'")
_SOLVED = f"""
    SELECT query_num, col AS "column", epsilon, column_epsilon, g.delta, n_cells,
           sensitivity * sqrt(groups) * exact_sigma AS sigma,
           sensitivity * sqrt(groups) * {classic('column_epsilon', 'g.delta')} AS classic
    FROM plan_grid g JOIN sigma_table s ON s.eps = column_epsilon AND s.delta = g.delta
    JOIN (SELECT query_num, col, count(true_value) AS n_cells FROM cells GROUP BY 1, 2) USING (query_num, col)"""
# Two searches agree to about nine digits; the rows compare four.
_case("d05_sigma", "query_num:i column:s epsilon:s n_cells:i digits:s",
      f"SELECT *, format('{{:.4e}}', sigma) AS digits FROM ({_SOLVED}) x")
_case("d06_classic", "query_num:i column:s epsilon:s classic:d saved:d",
      f"SELECT *, 1 - sigma / classic AS saved FROM ({_SOLVED}) x")
_case("d08_laplace_e01", _CELL, f"{_REL} WHERE query_num = 1 AND mechanism = 'laplace'")
_case("d09_gaussian_e01", _CELL, f"{_REL} WHERE query_num = 1 AND mechanism = 'gaussian'")
_case("d11_proportion_e10", _CELL, f"{_REL} WHERE query_num = 10")
_case("d12_noisymax_e06", "mechanism:s epsilon:s group_key:s true_item:s noisy_item:s",
      "SELECT * FROM winners")
_case("d13_16_post_e07", _CELL, f"{_REL} WHERE query_num IN (7, 8)")
_case("d17_grid", _CELL, _REL)
_case("d21_ledger",
      "mechanism:s epsilon:s query_num:i n_columns:i n_cells:i epsilon_spent:d delta_spent:d",
      """SELECT mechanism, epsilon, query_num, count(*) AS n_columns, sum(n) AS n_cells,
         sum(column_epsilon) AS epsilon_spent, sum(column_delta) AS delta_spent
         FROM (SELECT query_num, col, mechanism, epsilon, count(*) AS n FROM released
               WHERE epsilon <> 'inf' GROUP BY ALL)
         JOIN plan USING (query_num, col, mechanism, epsilon) GROUP BY 1, 2, 3
         UNION ALL SELECT mechanism, epsilon, 6, 1, count(*), CAST(epsilon AS DOUBLE), 0.0
         FROM winners WHERE epsilon <> 'inf' GROUP BY 1, 2""")

# ------------------------------------------------------------------ utility metrics
_ATS = "query_num:i mechanism:s epsilon:s"
_case("m01_relative_error", f"{_ATS} median_re:d", "SELECT * FROM m_re")
_case("m02_tvd", f"{_ATS} column:s tvd:d", 'SELECT *, col AS "column" FROM m_tvd')
_case("m03_pivot_tvd", f"{_ATS} mean_tvd:d max_tvd:d", "SELECT * FROM m_pivot")
_case("m04_spearman", f"{_ATS} spearman_rho:d", "SELECT * FROM m_rho")
_case("m05_spearman_labels", f"{_ATS} spearman_rho:d", "SELECT * FROM m_cat")
_case("m07_summary",
      f"{_ATS} metric_type:s n_rows:i median_re:d spearman_rho:d mean_tvd:d max_tvd:d tvd:d pass:i",
      "SELECT s.*, CASE WHEN ok THEN 1 ELSE 0 END AS pass FROM scored s "
      "LEFT JOIN (SELECT query_num, mechanism, epsilon, ok FROM judged) j "
      "USING (query_num, mechanism, epsilon)")

# ----------------------------------------------------------- evaluation and choice
_case("y01_evaluation",
      "query_num:i mechanism:s metric_type:s primary_col:s worst_value:d worst_epsilon:s best_value:d "
      "best_epsilon:s baseline_value:d mean_across_eps:d std_across_eps:d n_pass_hard:i "
      "n_pass_adaptive:i n_epsilons:i", "SELECT * FROM y_eval")
_case("y04_comparison",
      "query_num:i epsilon:s metric_type:s primary_col:s gaussian_value:d laplace_value:d "
      "difference:d winner:s", "SELECT * FROM y_cmp")
_case("y07_utility",
      "mechanism:s eps:d mean_utility_preserved:d min_utility_preserved:d n_queries_scored:i",
      "SELECT * FROM y_table")
_case("y08_selection",
      "mechanism:s best_epsilon:d mean_utility_preserved:d min_utility_preserved:d "
      "n_queries_scored:i runner_up_epsilon:d runner_up_utility:d near_miss:i status:s",
      "SELECT * FROM y_select")
_case("y11_best_per_query",
      "query_num:i mechanism:s metric_type:s best_epsilon:d passed_hard:i status:s",
      "SELECT * FROM y_best")

# ------------------------------------------------------------------------ chart data
_case("b01_curves", "metric_type:s mechanism:s position:d mean_value:d",
      "SELECT metric_type, mechanism, position, avg(value) AS mean_value FROM judged GROUP BY ALL")
_LABELS = [epsilon_label(e) for e in EPSILON_GRID]
_case("b02_heat_map",
      "mechanism:s metric_type:s query_num:i "
      + " ".join(f"eps_{x.replace('.', '_')}:d" for x in _LABELS),
      "SELECT mechanism, metric_type, query_num, "
      + ", ".join(f"avg(value) FILTER (WHERE epsilon = '{x}') AS eps_{x.replace('.', '_')}"
                  for x in _LABELS) + " FROM judged GROUP BY ALL")
_case("b03_bars", "metric_type:s position:d gaussian:d laplace:d",
      "SELECT metric_type, position, "
      + ", ".join(f"avg(value) FILTER (WHERE mechanism = '{m}') AS {m}"
                  for m in ("gaussian", "laplace"))
      + " FROM judged WHERE epsilon IN ('0.1', '0.5', '1.0') GROUP BY ALL")
_case("b04_pass_rate", "mechanism:s position:d pass_rate:d",
      "SELECT mechanism, position, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS pass_rate FROM judged "
      "GROUP BY ALL")
_case("b05_best_points", "query_num:i mechanism:s best_epsilon:d passed_hard:i status:s",
      "SELECT * FROM y_best")
_case("b06_generalisation",
      "query_num:i mechanism:s metric_type:s epsilon:d mini_value:d full_value:d mini_pass:i "
      "full_pass:i",
      """SELECT query_num, j.mechanism, metric_type, eps AS epsilon, value AS mini_value,
         value AS full_value, CASE WHEN ok THEN 1 ELSE 0 END AS mini_pass,
         CASE WHEN ok THEN 1 ELSE 0 END AS full_pass
         FROM judged j JOIN y_pick p ON p.mechanism = j.mechanism AND p.best_epsilon = j.eps""")
_case("b07_pareto",
      "query_num:i mechanism:s metric_type:s eps:d privacy_gain:d utility_loss:d",
      """SELECT query_num, mechanism, metric_type, eps, 1 / eps AS privacy_gain,
         CASE WHEN abs(b) < 1e-12 THEN abs(value - b) WHEN lower THEN (value - b) / abs(b)
              ELSE (b - value) / abs(b) END AS utility_loss
         FROM based WHERE NOT no_noise""")

_case("b08_axis", "position:d label:s",
      "SELECT DISTINCT position, CASE WHEN no_noise THEN '∞' ELSE epsilon END AS label FROM scored")
_case("b09_single_epsilon", "mechanism:s single_epsilon:i",
      "SELECT mechanism, CASE WHEN count(DISTINCT eps) FILTER (WHERE NOT no_noise) <= 1 THEN 1 ELSE 0 "
      "END AS single_epsilon FROM scored GROUP BY mechanism")

# A published-behaviour release beside the sound one, through the same mechanism SQL.
PUBLISHED_POLICY = Policy(
    budget="per_column", distribution_parts=28, normalise="percent_columns"
)


# Queries whose result SQL cannot state: a random sample, a Student tail probability.
_case("s04_sized_sample", "l_orderkey:i l_partkey:i l_quantity:d",
      "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE (CAST('0x' || "
      "substr(md5(concat_ws('|', '7', l_orderkey, l_linenumber)), 1, 12) AS BIGINT) + 0.5) "
      "/ 281474976710656.0 < 0.25")

_case("m06_p_values", f"{_ATS} spearman_rho:d p_value:d",
      f"SELECT *, {p_value()} AS p_value FROM (SELECT * FROM m_rho UNION ALL SELECT * FROM m_cat) r "
      "WHERE spearman_rho IS NOT NULL")

_case("s15_release_roundtrip", "query_num:i mechanism:s epsilon:s group_key:s column:s noisy_value:d",
      _REL)
CASES["y05_job"] = CASES["y04_comparison"]

_case("s02_csv_typed", "l_returnflag:s n:i quantity:d kind:s",
      "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity, 'double' AS kind FROM lineitem "
      "GROUP BY 1")
_MALFORMED = "l_orderkey % 97 = 0 AND l_linenumber = 1"
_case("s03_csv_rejects", "l_returnflag:s n:i quantity:d",
      f"SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem "
      f"WHERE NOT ({_MALFORMED}) GROUP BY 1 UNION ALL "
      f"SELECT 'rejected', count(*), NULL FROM lineitem WHERE {_MALFORMED}")
_case("s11_load_report", "table:s status:s rows:i",
      f"""SELECT 'orders' AS "table", 'ok' AS status, count(*) AS rows FROM orders UNION ALL
          SELECT 'lines', 'ok', count(*) FROM lineitem WHERE NOT ({_MALFORMED}) UNION ALL
          SELECT 'absent', 'missing', NULL""")
for _n, _order in ((4, "percentage_of_systems DESC NULLS LAST"), (15, "app_type, rank"),
                   (23, "processor_class, os")):
    _name = next(k for k in CASES if k.startswith(f"q{_n:02d}"))
    _spec, _sql = CASES[_name]
    _by = [x.split()[0].rstrip(",") for x in _order.split(", ")]
    _rest = [c.split(":")[0] for c in _spec.split() if c.split(":")[0] not in _by]
    CASES[f"l01_q{_n:02d}_order"] = (
        f"{_spec} position:i",
        f"SELECT *, row_number() OVER (ORDER BY {', '.join([_order, *_rest])}) AS position "
        f"FROM ({_sql}) result")

_case("r08_web_cat_pivot", "guid:i dt:s " + _d(*CATEGORY_COLUMNS), "SELECT * FROM rep_webdur")
_case("v03_sample_rows", "guid:i marketcodename:s cpugen:s",
      "SELECT * FROM src_cpu_metadata ORDER BY guid, marketcodename, cpugen LIMIT 20")
_NOISY = "max(noisy_value) FILTER (WHERE col = '{0}') AS {0}"
for _n, _keys in ((2, ("marketcodename", "cpugen")), (12, ("user_id",))):
    _cols = [c.name for c in DEMO_REGISTRY[_n].columns]
    _key = ", ".join(map(key_part, _keys))
    _wide = (
        f"SELECT mechanism, epsilon, {', '.join(_keys)}, {', '.join(_NOISY.format(c) for c in _cols)} "
        f"FROM released r JOIN (SELECT DISTINCT {', '.join(_keys)}, concat_ws(chr(31), {_key}) AS gk "
        f"FROM s{_n:02d}) k ON r.group_key = gk WHERE query_num = {_n} GROUP BY mechanism, epsilon, {', '.join(_keys)}"
    )
    if _n == 12:
        _wide = (f"SELECT *, rank() OVER (PARTITION BY mechanism, epsilon ORDER BY {_cols[0]} DESC "
                 f"NULLS LAST) AS rnk FROM ({_wide}) w")
    _case(f"p{_n:02d}_published",
          f"mechanism:s epsilon:s {' '.join(f'{k}:s' for k in _keys)} {_d(*_cols)}" + " rnk:i" * (_n == 12),
          _wide)
_case("n13_export_report", "table:s status:s rows:i", " UNION ALL ".join(
    f"""SELECT '{"_".join(q.title.lower().replace("/", " ").split())}' AS "table", 'ok' AS status, """
    f"count(*) AS rows FROM e{q.number:02d}" for q in DEMO_REGISTRY.values()))

# Queries without an SQL form: none.
ROWS_ONLY: dict[str, str] = {}


def oracle(name: str) -> str:
    spec, sql = CASES[name]
    ctes = CTES
    if name.startswith("d20_"):
        ctes = {**CTES, "cells": cells_text("e"), **plan_ctes(DEMO_LIMITS.min_units, 1, published=True)}
    return with_ctes(ctes, pick(spec, sql))


_case("d20_published_grid", _CELL, _REL)
