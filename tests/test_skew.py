"""Whole queries on tables where one key holds a third or more of all rows, part of
its values are missing and many rows are identical."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from compare import TABLES, compare, duck

HOT_QUERIES = [
    "r02_userwait", "r05_pkg_freq", "r09_network", "r10_13_web_pivots", "r15_memory",
    "r17_batt_events", "q01_battery_by_country", "q03_display_durations", "q04_vendor_share",
    "q05_blockers_by_os", "q06_top_browser", "q07_sleep_by_cpu", "q08_persona_web",
    "q09_package_power", "q10_browser_shares", "q11_ram_histogram", "q12_users_by_power",
    "q13_server_like", "q15_apps_devices", "q19_blocker_durations", "q20_wait_processes",
    "q22_wait_by_power", "q23_network_by_class", "e01_release", "e03_release", "e05_release",
    "e06_release", "e10_release", "e12_release", "d17_grid", "m07_summary",
]


@pytest.fixture(scope="module")
def skewed(tmp_path_factory, folder):
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    changed = {
        # Two fifths of the events come from one user, some of them identical in time.
        "events": """SELECT event_id, CASE WHEN event_id % 5 < 2 THEN TIMESTAMP '2024-01-09 10:00:00'
                            ELSE ts END AS ts,
                     CASE WHEN event_id % 5 < 2 THEN 7 ELSE user_id END AS user_id, event_type,
                     CASE WHEN event_id % 45 = 0 THEN NULL ELSE value END AS value, props FROM t""",
        # Half of the orders belong to one customer.
        "orders": """SELECT * REPLACE (CASE WHEN o_orderkey % 2 = 0 THEN 11 ELSE o_custkey END
                     AS o_custkey) FROM t""",
        # A third of the lines name one part, one supplier user and one amount.
        "lineitem": """SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 5 ELSE l_partkey END AS l_partkey,
                       CASE WHEN l_orderkey % 3 = 0 THEN 2 ELSE l_suppkey END AS l_suppkey) FROM t""",
    }
    for name in TABLES:
        source = f"(SELECT * FROM '{folder}/{name}.parquet') t"
        text = changed.get(name, "SELECT * FROM t").replace("FROM t", f"FROM {source}")
        con.execute(f"COPY ({text}) TO '{out}/{name}.parquet' (FORMAT parquet)")
    return str(out)


@pytest.fixture(scope="module")
def con(skewed):
    return duck(skewed)


@pytest.mark.parametrize("name", HOT_QUERIES)
def test_hot_key(spark, con, skewed, name):
    run, sql = entry_point.queries()[name], entry_point.oracle_sql()[name]
    assert compare(spark, con, run, sql, skewed, tolerance=1e-9) is None
