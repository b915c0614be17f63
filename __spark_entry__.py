
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetveil.plans import analytics, chart_data, checks, evaluation, metrics
from fleetveil.plans.registry import Limits, sensitivity_frame
from fleetveil.plans.release import (
    Release,
    exact_cells,
    noisy_cells,
    noisy_winners,
    privacy_ledger,
    published_table,
    rerun_epsilon,
)
from fleetveil.plans.release_queries import (
    browser_counts,
    export_release_queries,
    run_release_query,
)
from fleetveil.plans.reporting import (
    reporting_tables,
    web_category_pivot,
    web_category_pivots,
    with_folds,
)
from fleetveil.functions.calibration import with_gaussian_sigma
from fleetveil.operators.noise import Policy, noise_plan
from fleetveil.session import stage, work_folder
from fleetveil.sources.bindings import telemetry_sources
from fleetveil.sources.readers import (
    SourceTable,
    load_tables,
    read_csv,
    read_csv_with_rejects,
    read_sampled,
)
from fleetveil.sources.sinks import (
    noisy_only,
    read_release,
    write_csv,
    write_release,
    write_summary,
)
from oracles.build import shape
from oracles.cases import CASES, COVERAGE, PUBLISHED_POLICY, Q_OPTIONS, ROWS_ONLY, oracle
from oracles.texts import (
    DEMO_LIMITS,
    DEMO_POLICY,
    DEMO_REGISTRY,
    DEMO_SEED,
    EXACT_LIMITS,
    PUBLISHED_REGISTRY,
)

SMOKE_DIR = "/root/testdata/sf0.001"
OVERLONG_SECONDS = 20_000
SAMPLE_ROWS = 20


def _tables(spark: SparkSession, folder: str):
    return reporting_tables(telemetry_sources(spark, folder))


# Exact results, noisy release and metric summary of a folder, staged on first use:
# the stored hand-over between the query, release and evaluation jobs.
_STAGED: dict[tuple, DataFrame | Release] = {}


def _staged(spark: SparkSession, folder: str, what: str, build):
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _STAGED:
        _STAGED[key] = build()
    return _STAGED[key]


def exact(spark: SparkSession, folder: str, limits: Limits = DEMO_LIMITS) -> DataFrame:
    return _staged(
        spark, folder, f"cells {limits.max_groups_per_unit}",
        lambda: stage(exact_cells(_tables(spark, folder), DEMO_REGISTRY, limits)),
    )


def counts(spark: SparkSession, folder: str) -> DataFrame:
    return _staged(
        spark, folder, "counts", lambda: stage(browser_counts(_tables(spark, folder)))
    )


def release(spark: SparkSession, folder: str, policy: Policy = DEMO_POLICY) -> Release:
    def build() -> Release:
        return Release(
            stage(noisy_cells(exact(spark, folder), DEMO_REGISTRY, policy, DEMO_SEED)),
            stage(noisy_winners(counts(spark, folder), DEMO_REGISTRY, policy, DEMO_SEED)),
            DEMO_REGISTRY,
        )

    return _staged(spark, folder, f"release {policy}", build)


def published_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The published behaviour: unbounded results, tighter sensitivities, whole budgets."""
    return _staged(
        spark, folder, "published cells",
        lambda: stage(noisy_cells(
            exact(spark, folder, EXACT_LIMITS), PUBLISHED_REGISTRY, PUBLISHED_POLICY, DEMO_SEED
        )),
    )


def summary(spark: SparkSession, folder: str) -> DataFrame:
    return _staged(
        spark, folder, "summary",
        lambda: stage(metrics.metric_summary(release(spark, folder))),
    )


def _reporting(table: str):
    return lambda spark, folder: _tables(spark, folder)[table]


def _analysis(number: int):
    options = Q_OPTIONS.get(number, {})
    return lambda spark, folder: analytics.run_query(
        number, _tables(spark, folder), sort=False, **options
    )


def _exact_release(number: int):
    return lambda spark, folder: run_release_query(number, _tables(spark, folder), EXACT_LIMITS)


def _check(build: Callable[..., DataFrame], **options):
    return lambda spark, folder: build(_tables(spark, folder), **options)


def _noised(*numbers: int, mechanism: str | None = None):
    """The grid over some queries, straight from the exact queries."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        cells = stage(exact_cells(_tables(spark, folder), DEMO_REGISTRY, DEMO_LIMITS, numbers))
        grid = {"mechanisms": [mechanism]} if mechanism else {}
        return noisy_cells(cells, DEMO_REGISTRY, DEMO_POLICY, DEMO_SEED, **grid)

    return run


def _norms(spark: SparkSession, folder: str) -> DataFrame:
    released = exact(spark, folder).groupBy("query_num", "column").agg(
        F.count(F.lit(1)).alias("n")
    )
    spec = sensitivity_frame(spark, DEMO_REGISTRY)
    s, groups = F.col("sensitivity"), F.col("groups")
    by_column = released.join(F.broadcast(spec), ["query_num", "column"])
    # The budget share of a column is in the plan; here only its sensitivity counts.
    return by_column.groupBy("query_num").agg(
        F.count(F.lit(1)).alias("n_columns"), F.sum("n").alias("n_cells"),
        F.sum(s * groups).alias("l1_sensitivity"),
        F.sqrt(F.sum(s * s * groups)).alias("l2_sensitivity"),
    )


def _scales(spark: SparkSession, folder: str) -> DataFrame:
    released = exact(spark, folder).groupBy("query_num", "column").agg(
        F.count(F.lit(1)).alias("n_cells")
    )
    plan = noise_plan(spark, DEMO_REGISTRY, DEMO_POLICY).where(F.col("epsilon") != "inf")
    return released.join(F.broadcast(plan), ["query_num", "column"])


def _sigmas(spark: SparkSession, folder: str) -> DataFrame:
    """The analytic scale of every released Gaussian column, solved in one job, beside the classic."""
    plan = noise_plan(spark, DEMO_REGISTRY, DEMO_POLICY, mechanisms=["gaussian"]).where(
        F.col("epsilon") != "inf"
    )
    released = exact(spark, folder).groupBy("query_num", "column").agg(
        F.sum((F.col("true_value").isNotNull()).cast("int")).alias("n_cells")
    )
    spec = sensitivity_frame(spark, DEMO_REGISTRY).select("query_num", "column", "sensitivity", "groups")
    shift = F.col("sensitivity") * F.sqrt("groups")
    asked = released.join(F.broadcast(plan), ["query_num", "column"]).join(
        F.broadcast(spec), ["query_num", "column"]
    ).withColumn("shift", shift)
    solved = with_gaussian_sigma(asked, "shift", "column_epsilon", "column_delta")
    classic = F.col("shift") * F.sqrt(2 * F.log(1.25 / F.col("column_delta"))) / F.col("column_epsilon")
    return solved.withColumn("classic", classic).withColumn("saved", 1 - F.col("sigma") / classic).withColumn(
        "digits", F.format_string("%.4e", "sigma")
    )


def _stored_release(spark: SparkSession, folder: str) -> DataFrame:
    """The whole grid stored, one epsilon of it noised and stored again, all read back."""
    place = work_folder(spark, "release")
    write_release(noisy_only(release(spark, folder).cells), place)
    rerun_epsilon(exact(spark, folder), DEMO_REGISTRY, DEMO_POLICY, DEMO_SEED, 0.5, place)
    return read_release(spark, place)


def _evaluation_job(spark: SparkSession, folder: str) -> DataFrame:
    """Both mechanisms' summaries stored, evaluated and compared; the stored comparison."""
    rows, place = summary(spark, folder), work_folder(spark, "evaluation")
    folders = {m: f"{place}/{m}" for m in ("gaussian", "laplace")}
    for mechanism, target in folders.items():
        write_summary(rows.where(F.col("mechanism") == mechanism), target)
    evaluation.evaluation_job(spark, folders, place)
    return spark.read.parquet(f"{place}/comparison")


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    made = release(spark, folder)
    return privacy_ledger(spark, made.cells, made.winners, DEMO_REGISTRY, DEMO_POLICY)


def _metric(metric: str, score: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: score(metrics._metric_cells(release(spark, folder), metric))


def _pivot_tvd(cells: DataFrame) -> DataFrame:
    return metrics.pivot_variation(
        metrics.total_variation(cells.where(F.col("query_num").isin(7, 8)))
    )


def _of_summary(build: Callable[[DataFrame], DataFrame]):
    return lambda spark, folder: build(summary(spark, folder))


def _flags_as_int(df: DataFrame, *flags: str) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("int") for f in flags})


def _best(rows: DataFrame) -> DataFrame:
    return evaluation.best_epsilon_per_query(evaluation.mechanism_comparison(rows))


def _generalisation(rows: DataFrame) -> DataFrame:
    report = evaluation.selection_report(rows, "advance", "mini")
    return _flags_as_int(
        chart_data.generalisation_points(rows, rows, report), "mini_pass", "full_pass"
    )


def _sized_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the line items, chosen by their keys."""
    source = SourceTable("lineitem", f"{folder}/lineitem.parquet")
    return read_sampled(spark, source, 0.25, "7", ["l_orderkey", "l_linenumber"])[0]


CSV_SCHEMA = "l_orderkey long, l_linenumber long, l_quantity double, l_returnflag string"


def _csv_folder(spark: SparkSession, folder: str, malformed: bool) -> str:
    """Line items as gzip CSV files; if asked, with a number that is none in some first lines."""
    text = F.col("l_quantity").cast("string")
    if malformed:
        bad = (F.col("l_orderkey") % 97 == 0) & (F.col("l_linenumber") == 1)
        text = F.when(bad, "n/a").otherwise(text)
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", text.alias("l_quantity"), "l_returnflag"
    )
    place = work_folder(spark, "csv")
    write_csv(rows, place)
    return place


def _typed_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Types inferred from the text, rows of the files spread by size before the aggregation."""
    rows = read_csv(spark, _csv_folder(spark, folder, False)).hint("rebalance")
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"),
        F.max(F.lit(dict(rows.dtypes)["l_quantity"])).alias("kind"),
    )


def _csv_with_rejects(spark: SparkSession, folder: str) -> DataFrame:
    place = _csv_folder(spark, folder, True)
    good, bad = read_csv_with_rejects(spark, place, StructType.fromDDL(CSV_SCHEMA))
    return good.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    ).unionByName(bad.select(
        F.lit("rejected").alias("l_returnflag"), F.lit(1).alias("one")
    ).groupBy("l_returnflag").agg(F.count("one").alias("n"), F.lit(None).cast("double").alias("quantity")))


def _load_report(spark: SparkSession, folder: str) -> DataFrame:
    """A Parquet table, a CSV folder with malformed lines and a missing one, loaded and reported."""
    sources = [
        SourceTable("orders", f"{folder}/orders.parquet"),
        SourceTable("lines", _csv_folder(spark, folder, True), "csv", True, CSV_SCHEMA),
        SourceTable("absent", f"{folder}/absent.parquet"),
    ]
    return load_tables(spark, sources, work_folder(spark, "loaded"))


def _raw_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """The copied pivot table over a source that has one: here, durations by category."""
    sources = telemetry_sources(spark, folder)
    raw = web_category_pivot(with_folds(sources), "duration_ms")
    return reporting_tables({**{n: sources[n] for n in sources}, "web_cat_pivot": raw})[
        "system_web_cat_pivot"
    ]


def _export_report(spark: SparkSession, folder: str) -> DataFrame:
    return export_release_queries(_tables(spark, folder), work_folder(spark, "export"), EXACT_LIMITS)


def _in_order(number: int):
    options = Q_OPTIONS.get(number, {})
    return lambda spark, folder: analytics.positioned(
        number, analytics.run_query(number, _tables(spark, folder), sort=False, **options)
    )


_RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "r01_display_devices": _reporting("system_display_devices"),
    "r02_userwait": _reporting("system_userwait"),
    "r03_hw_pkg_power": _reporting("system_hw_pkg_power"),
    "r04_pkg_c0": _reporting("system_pkg_C0"),
    "r05_pkg_freq": _reporting("system_pkg_avg_freq_mhz"),
    "r06_pkg_temp": _reporting("system_pkg_temp_centigrade"),
    "r07_psys_watts": _reporting("system_psys_rap_watts"),
    "r08_web_cat_pivot": _raw_pivot,
    "r09_network": _reporting("system_network_consumption"),
    "r10_13_web_pivots": lambda s, d: web_category_pivots(with_folds(telemetry_sources(s, d))),
    "r14_web_usage": _reporting("system_web_cat_usage"),
    "r15_memory": _reporting("system_memory_utilization"),
    "r16_mods_power": _reporting("system_mods_power_consumption"),
    "r17_batt_events": _reporting("system_batt_dc_events"),
    "r18_cpu_metadata": _reporting("system_cpu_metadata"),
    "r19_blockers": _reporting("system_mods_top_blocker_hist"),
    "r20_os_history": _reporting("system_os_codename_history"),
    "r21_on_off": _reporting("system_on_off_suspend_time_day"),
    "r22_apps": _reporting("system_frgnd_apps_types"),
    "v01_coverage": _check(checks.table_coverage, names=list(COVERAGE)),
    "v02_source_coverage": _check(checks.table_coverage, names=["sysinfo"]),
    "v03_sample_rows": lambda s, d: checks.sample_rows(
        _tables(s, d), ["system_cpu_metadata"], SAMPLE_ROWS
    )["system_cpu_metadata"],
    "v04_negative_ram": _check(checks.negative_ram),
    "v05_overlong_days": _check(checks.overlong_count, limit=OVERLONG_SECONDS),
    "v06_top_overlong": _check(checks.top_overlong, limit=OVERLONG_SECONDS),
    "v07_status": _check(checks.status_distribution),
    "v08_categories": lambda s, d: checks.category_pairs(telemetry_sources(s, d)),
    "v09_battery_nulls": _check(checks.battery_nulls),
    "v10_cpu_coverage": _check(checks.cpu_coverage),
    "v11_app_coverage": _check(checks.app_coverage),
    "v13_devices": lambda s, d: checks.device_count(telemetry_sources(s, d)["sysinfo"]),
    "v14_date_range": _check(checks.date_range),
    "v15_bounds": lambda s, d: checks.bound_violations(
        exact(s, d), checks.bound_rules(DEMO_LIMITS)
    ),
    "d03_norms": _norms,
    "d04_scales": _scales,
    "d08_laplace_e01": _noised(1, mechanism="laplace"),
    "d09_gaussian_e01": _noised(1, mechanism="gaussian"),
    "d11_proportion_e10": _noised(10),
    "d12_noisymax_e06": lambda s, d: noisy_winners(
        browser_counts(_tables(s, d)), DEMO_REGISTRY, DEMO_POLICY, DEMO_SEED
    ),
    "d13_16_post_e07": _noised(7, 8),
    "d17_grid": lambda s, d: release(s, d).cells,
    "d05_sigma": _sigmas,
    "d06_classic": _sigmas,
    "d20_published_grid": published_cells,
    "d21_ledger": _ledger,
    "s15_release_roundtrip": _stored_release,
    "p02_published": lambda s, d: published_table(release(s, d), 2),
    "p12_published": lambda s, d: published_table(release(s, d), 12),
    "n13_export_report": _export_report,
    "y05_job": _evaluation_job,
    "m01_relative_error": _metric("RE", metrics.median_relative_error),
    "m02_tvd": _metric("TVD", metrics.total_variation),
    "m03_pivot_tvd": _metric("TVD", _pivot_tvd),
    "m04_spearman": _metric("SPEARMAN", metrics.spearman_numeric),
    "m05_spearman_labels": lambda s, d: metrics.spearman_categorical(release(s, d).winners),
    "m07_summary": summary,
    "y01_evaluation": _of_summary(evaluation.evaluation_summary),
    "y04_comparison": _of_summary(evaluation.mechanism_comparison),
    "y07_utility": _of_summary(evaluation.utility_table),
    "y08_selection": _of_summary(
        lambda rows: _flags_as_int(
            evaluation.selection_report(rows, "advance", "mini"), "near_miss"
        )
    ),
    "y11_best_per_query": _of_summary(lambda rows: _flags_as_int(_best(rows), "passed_hard")),
    "b01_curves": _of_summary(chart_data.utility_curves),
    "b02_heat_map": _of_summary(chart_data.query_heat_map),
    "b03_bars": _of_summary(chart_data.mechanism_bars),
    "b04_pass_rate": _of_summary(chart_data.pass_rates),
    "b05_best_points": _of_summary(
        lambda rows: _flags_as_int(chart_data.best_epsilon_points(_best(rows)), "passed_hard")
    ),
    "b06_generalisation": _of_summary(_generalisation),
    "b07_pareto": _of_summary(chart_data.pareto_points),
    "b08_axis": _of_summary(chart_data.axis_ticks),
    "b09_single_epsilon": _of_summary(
        lambda rows: _flags_as_int(chart_data.is_single_epsilon(rows), "single_epsilon")
    ),
    "s02_csv_typed": _typed_csv,
    "s03_csv_rejects": _csv_with_rejects,
    "s11_load_report": _load_report,
    "l01_q04_order": _in_order(4),
    "l01_q15_order": _in_order(15),
    "l01_q23_order": _in_order(23),
    "s04_sized_sample": _sized_sample,
    "m06_p_values": _of_summary(lambda rows: rows.where("spearman_rho IS NOT NULL")),
}
for _name in CASES:
    if _name.startswith("q"):
        _RUNS[_name] = _analysis(int(_name[1:3]))
    elif _name.startswith("e"):
        _RUNS[_name] = _exact_release(int(_name[1:3]))


SPECS = {**{name: spec for name, (spec, _) in CASES.items()}, **ROWS_ONLY}


def entry(spark: SparkSession) -> DataFrame:
    """Battery use by country with every device's contribution capped."""
    limits = Limits(min_units={**DEMO_LIMITS.min_units, 1: 5})
    return run_release_query(1, _tables(spark, SMOKE_DIR), limits)


# The training-data operators and their pipeline are optional: both may be absent.
_LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_LLM_ORACLES: dict[str, str] = {}
try:
    from fleetveil.llm import entries as _llm

    _LLM_QUERIES, _LLM_ORACLES = dict(_llm.QUERIES), dict(_llm.ORACLES)
    import corpus_pipeline as _pipeline

    _LLM_QUERIES["pipeline"] = _pipeline.run
    if _pipeline.ORACLE_SQL:
        _LLM_ORACLES["pipeline"] = _pipeline.ORACLE_SQL
except ImportError as _missing:
    if _missing.name not in ("fleetveil.llm", "corpus_pipeline"):
        raise


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def registered(name: str):
        return lambda spark, folder: shape(_RUNS[name](spark, folder), SPECS[name])

    return {**{name: registered(name) for name in SPECS}, **_LLM_QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**{name: oracle(name) for name in CASES}, **_LLM_ORACLES}
