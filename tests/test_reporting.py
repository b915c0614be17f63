"""The reporting layer from shared folds: one pass over each large source."""

import re

from pyspark.sql import functions as F

from fleetveil.functions.exprs import half_even_int
from fleetveil.plans import reporting
from fleetveil.plans.analytics import run_query
from fleetveil.plans.categories import CATEGORIES, CATEGORY_COLUMNS

POWER = ("system_pkg_C0", "system_pkg_avg_freq_mhz", "system_pkg_temp_centigrade", "system_psys_rap_watts")
WEB = ("system_web_cat_usage", *[n for n in reporting.BUILDERS if "web_cat_pivot_" in n])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return len(re.findall(r"FileScan|Scan parquet", plan(df)))


def rows(df):
    kept = [c for c in df.columns if c != "load_ts"]
    return sorted(
        tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.select(kept).collect()
    )


def test_one_scan_of_a_source_feeds_all_its_tables(sources, tables, tmp_path):
    stored = reporting.store_folds(sources, str(tmp_path))
    for fold, source in (("power_days", "power_hist"), ("web_days", "web_usage")):
        assert scans(reporting.with_folds(sources)[fold]) == scans(sources[source])
    layer = reporting.reporting_tables(sources, stored)
    for name in (*POWER, *WEB):
        files = layer[name].inputFiles()
        assert files and all(str(tmp_path) in f for f in files), name
        assert rows(layer[name]) == rows(tables[name]), name
    # A table of one metric needs no shuffle and pushes the metric to the scan.
    for name in POWER:
        assert "Exchange" not in plan(layer[name]) and "EqualTo(metric_name" in plan(layer[name])
    assert scans(run_query(24, layer)) == 1 + scans(sources["sysinfo"])
    assert rows(run_query(24, layer)) == rows(run_query(24, tables))


def test_sums_are_in_generated_code_and_the_pivot_behind_them(sources):
    wide = reporting.web_category_pivots(reporting.with_folds(sources))
    text = wide._jdf.queryExecution().executedPlan().toString()
    sums = [line for line in text.splitlines() if "Aggregate" in line and "sum(" in line]
    assert sums and all("CASE WHEN" not in line.split("functions=")[1] for line in sums)
    assert all(re.match(r"[\s:+\-|]*\*\(\d+\)", line) or "AdaptiveSparkPlan" in text for line in sums)
    assert len(wide.columns) == 2 + 4 * len(CATEGORY_COLUMNS)


def test_the_whole_layer_is_stored(sources, tmp_path):
    report = {r.table: r for r in reporting.store_reporting(sources, str(tmp_path)).collect()}
    assert {r.status for r in report.values()} == {"ok"}
    assert set(report) == {*reporting.reporting_tables(sources)} - {*reporting.FOLDS}
    spark = sources["sysinfo"].sparkSession
    stored = spark.read.parquet(f"{tmp_path}/system_pkg_C0")
    assert stored.count() == report["system_pkg_C0"].rows > 0


def test_categories_of_web_rows(spark):
    pairs = [*CATEGORIES, ("education", "any"), ("games", "unknown"), (None, None), ("social", None)]
    usage = spark.createDataFrame(
        [(1, "d", "b", p, s, 10 ** (i % 5), 1, 1, 1, None) for i, (p, s) in enumerate(pairs)]
        + [(2, "d", "b", "nothing", "else", 5, 5, 5, 5, 5)],
        "guid int, dt string, browser string, parent_category string, sub_category string, "
        "duration_ms long, page_load_count long, site_count long, domain_count long, page_visit_count long",
    )
    wide = reporting.web_category_pivots(reporting.with_folds({"web_usage": usage}))
    by = {r.guid: r.asDict() for r in wide.collect()}
    for i, ((p, s), name) in enumerate(zip(CATEGORIES, CATEGORY_COLUMNS)):
        want = sum(10 ** (k % 5) for k, (a, b) in enumerate(pairs) if a == p and (s is None or b == s))
        assert by[1][f"duration_ms__{name}"] == want and by[1][f"page_visit_count__{name}"] == 0, name
    assert all(v == 0 for k, v in by[2].items() if k not in ("guid", "dt"))
    one = reporting.web_category_pivot(reporting.with_folds({"web_usage": usage}), "page_load_count")
    assert one.where("guid = 1").select(F.col("education")).first()[0] == 2


def test_power_rows_without_samples_or_core_number(spark):
    metric = reporting.METRIC_FREQUENCY
    rows_in = [
        (1, "d", "e", metric, "0", 2, 10.0, 1.0, 2.0, 3.0, 4.0), (1, "d", "e", metric, "1", 0, 5.0, 1.0, 9.0, 9.0, 9.0),
        (1, "d", "e", metric, "x", 1, 1.0, None, None, None, None), (1, "d", "e", "other", "7", 1, 1.0, 1.0, 1.0, 1.0, 1.0),
    ]
    hist = spark.createDataFrame(
        rows_in, "guid int, dt string, event_name string, metric_name string, attribute_metric_level1 string, "
        "nrs int, duration_ms double, min_val double, avg_val double, percentile_50th double, max_val double",
    )
    src = reporting.with_folds({"power_hist": hist})
    r = reporting.pkg_avg_freq_mhz(src).first()
    assert (r.nrs, r.number_of_cores, r.duration_ms, r.avg_avg_freq_mhz) == (2, 1, 10.0, 2.0)
    assert src["power_days"].count() == 1 and reporting.pkg_c0(src).count() == 0


def test_a_tie_rounds_alike_in_any_order_of_the_sum(spark):
    shares = [0.02 * 10, 0.04 * 10, 0.09 * 10]
    sums = [shares[i] + shares[j] + shares[k] for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))]
    assert len(set(sums)) > 1
    cases = [*[(s, 2) for s in sums], (0.5, 0), (2.5, 2), (-1.5, -2), (1.4999, 1), (None, None)]
    out = spark.createDataFrame(cases, "v double, expected int").select(half_even_int("v").alias("i"), "expected")
    assert [r.i for r in out.collect()] == [e for _, e in cases]
