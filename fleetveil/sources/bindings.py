"""Telemetry-shaped source tables over a retail star schema.

The engine reads device telemetry. Where only the retail test tables exist, these
views stand in for the sources: customers and event users play devices, orders
play battery events, line items play display sessions, metrics and app usage.
NULLs, -1 sentinels, zero sizes, excluded names and path-shaped names occur on
purpose. One SQL text per view serves Spark and any ANSI engine; ``{ntz}`` is the
engine's name for a timestamp without zone.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from fleetveil.sources.tables import LazyTables

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEW_SQL: dict[str, str] = {
    "sysinfo": """
        SELECT c_custkey AS guid, n_name AS countryname_normalized, c_mktsegment AS persona,
               concat('chassis', c_nationkey % 3) AS chassistype,
               concat('vendor', c_custkey % 4) AS modelvendor_normalized,
               concat('model', c_custkey % 9) AS model_normalized,
               CASE WHEN c_custkey % 17 = 0 THEN 0 ELSE 4 * (1 + c_custkey % 4) END AS ram,
               concat('os', c_custkey % 3) AS os,
               CASE WHEN c_custkey % 7 = 0 THEN 'Xeon' ELSE 'Core' END AS cpuname,
               2 + c_custkey % 6 AS ofcores
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "cpu_metadata": """
        SELECT c_custkey AS guid, concat('M', c_nationkey % 6) AS marketcodename,
               CASE WHEN c_custkey % 11 = 0 THEN 'Unknown' ELSE concat('G', c_custkey % 4) END AS cpugen
        FROM {customer}""",
    "batt_dc_events": """
        SELECT o_orderpriority AS load_ts, o_custkey AS guid, o_orderdate AS power_on_dc_ts,
               o_totalprice / 3000.0 AS duration_mins,
               CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_orderkey % 101 END AS power_on_battery_percent,
               CASE WHEN o_orderkey % 13 = 0 THEN -1 ELSE o_orderkey % 97 END AS power_off_battery_percent
        FROM {orders}""",
    "display_devices": """
        SELECT o_orderdate AS load_ts, o_custkey AS guid, CAST(l_shipdate AS DATE) AS dt, l_shipdate AS ts,
               l_linenumber AS display_id, l_suppkey AS adapter_id, l_linenumber % 3 AS port,
               l_linenumber % 2 AS sink_index,
               CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS connection_type,
               p_brand AS vendor_name, l_linestatus AS status,
               (p_size % 4) * 640 AS resolution_width, (p_size % 4) * 360 AS resolution_heigth,
               30 + p_size AS refresh_rate,
               l_quantity * 100 AS duration_ac, l_extendedprice / 10 AS duration_dc
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "userwait": """
        SELECT user_id AS guid, CAST(ts AS DATE) AS dt, event_type AS event_name,
               CASE WHEN event_id % 3 = 0 THEN 'ac_on' WHEN event_id % 3 = 1 THEN 'dc_on' ELSE 'unknown' END
                   AS ac_dc_event_name,
               CASE WHEN event_id % 41 = 0 THEN 'DESKTOP' ELSE concat('proc', event_id % 40) END
                   AS proc_name_current,
               value * 1000 AS duration_ms
        FROM {events}""",
    "power_hist": """
        SELECT o_custkey AS guid, CAST(o_orderdate AS DATE) AS dt, l_linestatus AS event_name,
               CASE WHEN l_partkey % 4 = 0 THEN 'HW::CORE:C0:PERCENT:'
                    WHEN l_partkey % 4 = 1 THEN 'HW::CORE:AVG_FREQ:MHZ:'
                    WHEN l_partkey % 4 = 2 THEN 'HW::CORE:TEMPERATURE:CENTIGRADE:'
                    ELSE 'HW:::PSYS_RAP:WATTS:' END AS metric_name,
               CAST(l_linenumber AS VARCHAR(10)) AS attribute_metric_level1,
               l_quantity AS nrs, l_quantity * 60 AS duration_ms,
               l_discount * 100 AS min_val, l_discount * 200 AS avg_val,
               l_discount * 150 AS percentile_50th, l_discount * 300 AS max_val
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "web_usage": """
        SELECT user_id AS guid, CAST(ts AS DATE) AS dt,
               CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('browser', event_id % 3) END AS browser,
               CASE event_type WHEN 'view' THEN 'entertainment' WHEN 'click' THEN 'education'
                    WHEN 'purchase' THEN 'shopping' WHEN 'signup' THEN 'productivity'
                    ELSE 'other' END AS parent_category,
               CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'video streaming'
                    WHEN event_type = 'signup' THEN 'crm' ELSE 'other' END AS sub_category,
               value * 1000 AS duration_ms, event_id % 7 AS page_load_count, event_id % 3 AS site_count,
               event_id % 2 AS domain_count, event_id % 5 AS page_visit_count
        FROM {events}""",
    "network": """
        SELECT user_id AS guid, CAST(ts AS DATE) AS dt,
               CASE WHEN event_id % 2 = 0 THEN 'OS:NETWORK INTERFACE::BYTES RECEIVED/SEC::'
                    ELSE 'OS:NETWORK INTERFACE::BYTES SENT/SEC::' END AS input_description,
               1 + event_id % 30 AS nr_samples, value / 2 AS min_bytes_sec, value AS avg_bytes_sec,
               value * 2 AS max_bytes_sec
        FROM {events}""",
    "memory": """
        SELECT user_id AS guid, CAST(ts AS DATE) AS dt, 1 + event_id % 20 AS sample_count,
               value * 10 AS average
        FROM {events}""",
    "mods_power": r"""
        SELECT o_custkey AS guid, o_orderdate AS ts_local,
               concat('C:', chr(92), p_type, chr(92), p_brand) AS app_id,
               concat('user', l_suppkey % 5) AS user_id,
               l_quantity AS cpu_power_consumption, l_linenumber AS display_power_consumption,
               p_size AS disk_power_consumption, l_quantity * 2 AS mbb_power_consumption,
               l_quantity * 3 AS network_power_consumption, l_discount * 10 AS soc_power_consumption,
               l_tax * 10 AS loss_power_consumption, l_linenumber * 2 AS other_power_consumption,
               l_extendedprice / 1000 AS total_power_consumption
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "blockers": """
        SELECT user_id AS guid, ts AS dt_utc, concat('blocker', event_id % 12) AS blocker_name,
               event_type AS blocker_type, concat('level', event_id % 3) AS activity_level,
               (event_id % 9) * 250 AS active_time_ms
        FROM {events}""",
    "os_history": """
        SELECT user_id AS guid, concat('OS', k) AS os_name, concat('code', user_id % 4) AS os_codename,
               CASE WHEN k = 1 THEN CAST('2024-01-01 00:00:00' AS {ntz})
                    ELSE CAST('2024-01-16 00:00:00' AS {ntz}) END AS min_ts,
               CASE WHEN k = 1 THEN CAST('2024-01-15 23:59:59' AS {ntz})
                    ELSE CAST('2024-01-31 00:00:00' AS {ntz}) END AS max_ts
        FROM (SELECT DISTINCT user_id FROM {events}) u
        CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) r""",
    "on_off": """
        SELECT user_id AS guid, CAST(ts AS DATE) AS dt,
               sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS on_time,
               sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS off_time,
               sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS mods_time,
               sum(CASE WHEN event_type = 'signup' THEN value ELSE 0 END) AS sleep_time
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "apps": """
        SELECT o_custkey AS guid, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_type END AS app_type,
               CASE WHEN l_partkey % 23 = 0 THEN 'desktop' ELSE p_brand END AS exe_name,
               l_quantity * 60 AS totalsecfocal_day, l_linenumber AS lines_per_day
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "hw_pack_power": """
        SELECT ts AS load_ts, user_id AS guid, CAST(ts AS DATE) AS dt, event_type AS instance,
               1 + event_id % 10 AS nrs, value / 4 AS mean, value AS rap_22
        FROM {events}""",
}


def telemetry_sources(spark: SparkSession, folder: str) -> LazyTables:
    """The source tables over the Parquet files in ``folder``, each built on first use."""
    base = LazyTables(
        {name: partial(spark.read.parquet, f"{folder}/{name}.parquet") for name in BASE_TABLES}
    )

    def view(text: str) -> DataFrame:
        used = {name: base[name] for name in BASE_TABLES if f"{{{name}}}" in text}
        # The engine name is filled in first; Spark binds the frames itself.
        return spark.sql(text.replace("{ntz}", "TIMESTAMP_NTZ"), **used)

    return LazyTables({name: partial(view, text) for name, text in VIEW_SQL.items()})
