"""Evaluation of metric summaries and the choice of epsilon.

Input: one row per (query_num, mechanism, epsilon) with ``metric_type`` and the
metric columns; ``epsilon`` may be text or a number, infinity spelled any way.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetveil.functions.exprs import round_to
from fleetveil.plans.metrics import passes
from fleetveil.plans.registry import LOWER_IS_BETTER, PASS_THRESHOLD
from fleetveil.sources.readers import folder_exists
from fleetveil.sources.sinks import run_report, write_table

# Fixed values of the selection rule.
ADAPTIVE_TOLERANCE = 0.9
UTILITY_THRESHOLD = 0.80
NEAR_MISS_MARGIN = 0.05
ZERO_BASELINE_SCALE = 0.02
ZERO_BASELINE = 1e-9
MAX_EPSILON = 1.0
TIE = 1e-7


def epsilon_number(epsilon: Column) -> Column:
    text = F.lower(F.trim(epsilon.cast("string")))
    infinite = text.isin("inf", "infinity", "np.inf", "+inf", "+infinity")
    return F.when(infinite, F.lit(float("inf"))).otherwise(text.try_cast("double"))


def is_no_noise(epsilon: Column) -> Column:
    return F.coalesce(epsilon_number(epsilon) == F.lit(float("inf")), F.lit(False))


def lower_is_better(metric: Column) -> Column:
    return metric.isin([m for m, lower in LOWER_IS_BETTER.items() if lower])


def primary_metrics(summary: DataFrame, published: bool = False) -> DataFrame:
    """(query_num, mechanism, metric_type, epsilon, eps, no_noise, primary_col, value).

    A TVD row is judged by ``mean_tvd``, or by ``tvd`` where there is no pivot.
    ``published`` leaves out the second kind, as the reference summary does.
    """
    pivot = F.col("mean_tvd").try_cast("double")
    single = F.lit(None).cast("double") if published else F.col("tvd").try_cast("double")
    metric = F.col("metric_type")
    value = (
        F.when(metric == "RE", F.col("median_re").try_cast("double"))
        .when(metric == "TVD", F.coalesce(pivot, single))
        .when(metric == "SPEARMAN", F.col("spearman_rho").try_cast("double"))
    )
    name = (
        F.when(metric == "RE", "median_re")
        .when((metric == "TVD") & pivot.isNull() & single.isNotNull(), "tvd")
        .when(metric == "TVD", "mean_tvd")
        .when(metric == "SPEARMAN", "spearman_rho")
    )
    value = F.nanvl(value, F.lit(None).cast("double"))
    return summary.select(
        "query_num", "mechanism", "metric_type", F.col("epsilon").cast("string").alias("epsilon"),
        epsilon_number(F.col("epsilon")).alias("eps"),
        is_no_noise(F.col("epsilon")).alias("no_noise"),
        name.alias("primary_col"), value.alias("value"),
    ).where(F.col("value").isNotNull())


def evaluation_summary(
    summary: DataFrame, published: bool = False, include_inf: bool | None = None
) -> DataFrame:
    """Per (query, mechanism): best and worst value with their epsilon, mean and
    deviation over the grid, how many epsilons pass the fixed and the adaptive
    threshold. Pass counts leave out the noise-free row unless ``include_inf``."""
    include_inf = published if include_inf is None else include_inf
    rows = primary_metrics(summary, published)
    lower = lower_is_better(F.col("metric_type"))
    group = ["query_num", "mechanism", "metric_type"]
    base = rows.where("no_noise").groupBy(*group).agg(F.max("value").alias("baseline_value"))
    counted = F.lit(True) if include_inf else ~F.col("no_noise")
    badness = F.when(lower, F.col("value")).otherwise(-F.col("value"))
    adaptive = F.when(lower, F.col("baseline_value") / F.lit(ADAPTIVE_TOLERANCE)).otherwise(
        F.col("baseline_value") * F.lit(ADAPTIVE_TOLERANCE)
    )
    meets = F.when(lower, F.col("value") <= adaptive).otherwise(F.col("value") >= adaptive)
    hard = passes(F.col("metric_type"), F.col("value"))
    # At most one row per query and mechanism on the base side.
    out = rows.join(F.broadcast(base), group, "left").groupBy(*group).agg(
        F.min("primary_col").alias("primary_col"),
        F.max(F.struct(badness.alias("b"), (-F.col("eps")).alias("o"), "value", "epsilon"))
        .alias("worst"),
        F.min(F.struct(badness.alias("b"), F.col("eps").alias("o"), "value", "epsilon"))
        .alias("best"),
        F.max("baseline_value").alias("baseline_value"),
        F.max(adaptive).alias("adaptive_threshold"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.sum((hard & counted).cast("int")).alias("n_pass_hard"),
        F.sum((meets & counted).cast("int")).alias("n_pass_adaptive"),
        F.sum(counted.cast("int")).alias("n_epsilons"),
    )
    threshold = F.create_map(*[F.lit(x) for kv in PASS_THRESHOLD.items() for x in kv])
    share = F.nullif(F.col("n_epsilons"), F.lit(0)).cast("double")
    return out.select(
        "query_num", "mechanism", "metric_type", "primary_col",
        round_to("worst.value", 4).alias("worst_value"),
        F.col("worst.epsilon").alias("worst_epsilon"),
        round_to("best.value", 4).alias("best_value"),
        F.col("best.epsilon").alias("best_epsilon"),
        round_to("baseline_value", 4).alias("baseline_value"),
        round_to("adaptive_threshold", 4).alias("adaptive_threshold"),
        round_to("mean", 4).alias("mean_across_eps"),
        round_to("std", 4).alias("std_across_eps"),
        "n_pass_hard", round_to(F.col("n_pass_hard") / share, 4).alias("frac_pass_hard"),
        threshold[F.col("metric_type")].alias("pass_threshold"),
        "n_pass_adaptive",
        round_to(F.col("n_pass_adaptive") / share, 4).alias("frac_pass_adaptive"),
        "n_epsilons",
    )


SUMMARY_SCHEMA = (
    "query_num int, mechanism string, variant string, epsilon string, query_file string, "
    "delta double, database string, n_rows long, metric_type string, median_re double, "
    "spearman_rho double, p_value double, mean_tvd double, max_tvd double, tvd double, pass int"
)


def evaluation_job(
    spark: SparkSession, summaries: Mapping[str, str], folder: str, published: bool = False
) -> DataFrame:
    """Evaluate stored metric summaries, one folder per mechanism, and store two tables.

    Writes ``evaluation_summary`` and, where both mechanisms are there, ``comparison`` under
    ``folder``. The report has a row per input and output: a missing summary is reported and
    the rest goes on; without any summary nothing is written.
    """
    found: dict[str, DataFrame] = {}

    def load(mechanism: str):
        if not folder_exists(spark, summaries[mechanism]):
            raise FileNotFoundError(f"no summary of {mechanism}: {summaries[mechanism]}")
        rows = spark.read.schema(SUMMARY_SCHEMA).parquet(summaries[mechanism])
        found[mechanism] = rows.where(F.col("mechanism") == mechanism)
        return found[mechanism].count(), None, None

    read = run_report(spark, {m: (lambda m=m: load(m)) for m in summaries})
    rows = [found[m] for m in sorted(found)]
    if not rows:
        return read
    together = reduce(DataFrame.unionByName, rows)
    outputs = {"evaluation_summary": lambda: evaluation_summary(together, published)}
    if {"gaussian", "laplace"} <= found.keys():
        outputs["comparison"] = lambda: mechanism_comparison(together)

    def store(name: str):
        return write_table(outputs[name](), f"{folder}/{name}"), None, None

    return read.unionByName(run_report(spark, {n: (lambda n=n: store(n)) for n in outputs}))


def mechanism_comparison(summary: DataFrame) -> DataFrame:
    """Gaussian against Laplace per (query, epsilon), on the first metric column
    both sides have. Pairs missing on a side are in :func:`unmatched_pairs`."""
    columns = ["median_re", "mean_tvd", "tvd", "spearman_rho"]

    def side(mechanism: str, prefix: str) -> DataFrame:
        values = [
            F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")).alias(f"{prefix}_{c}")
            for c in columns
        ]
        return summary.where(F.col("mechanism") == mechanism).select(
            "query_num", epsilon_number(F.col("epsilon")).alias("eps"),
            F.col("epsilon").cast("string").alias(f"{prefix}_epsilon"),
            F.col("metric_type").alias(f"{prefix}_type"), *values,
        )

    pairs = side("gaussian", "g").join(side("laplace", "l"), ["query_num", "eps"]).select(
        "*", F.col("g_epsilon").alias("epsilon"), F.col("g_type").alias("metric_type")
    )
    # The pivot metric where both sides have it, else the single-column one.
    pivot = F.col("g_mean_tvd").isNotNull() & F.col("l_mean_tvd").isNotNull()
    name = (
        F.when(F.col("metric_type") == "RE", "median_re")
        .when((F.col("metric_type") == "TVD") & pivot, "mean_tvd")
        .when(F.col("metric_type") == "TVD", "tvd")
        .when(F.col("metric_type") == "SPEARMAN", "spearman_rho")
    )
    named = pairs.withColumn("primary_col", name)

    def chosen(prefix: str) -> Column:
        return F.coalesce(
            *[F.when(F.col("primary_col") == c, F.col(f"{prefix}_{c}")) for c in columns]
        )

    both = named.select(
        "query_num", "epsilon", "metric_type", "primary_col",
        chosen("g").alias("gaussian_value"), chosen("l").alias("laplace_value"),
    ).where(F.col("gaussian_value").isNotNull() & F.col("laplace_value").isNotNull())
    gap = F.col("gaussian_value") - F.col("laplace_value")
    gaussian_better = F.when(lower_is_better(F.col("metric_type")), gap < 0).otherwise(gap > 0)
    winner = (
        F.when(F.abs(gap) < TIE, "tie").when(gaussian_better, "gaussian").otherwise("laplace")
    )
    return both.select(
        "query_num", "epsilon", "metric_type", "primary_col",
        round_to("gaussian_value", 4).alias("gaussian_value"),
        round_to("laplace_value", 4).alias("laplace_value"),
        round_to(gap, 4).alias("difference"), winner.alias("winner"),
    )


def unmatched_pairs(summary: DataFrame) -> DataFrame:
    """(query_num, epsilon) that only one mechanism reports, and which one."""
    rows = primary_metrics(summary)
    return (
        rows.groupBy("query_num", "eps")
        .agg(F.count_distinct("mechanism").alias("n"), F.min("mechanism").alias("mechanism"))
        .where(F.col("n") == 1).select("query_num", "eps", "mechanism")
    )


def utility_preserved(metric: Column, current: Column, baseline: Column) -> Column:
    """1 for no loss against the noise-free value, falling with the relative loss.

    An error metric with a noise-free value of about 0 is scored on an absolute
    scale; a correlation of about 0 cannot be scored.
    """
    zero = F.abs(baseline) < F.lit(ZERO_BASELINE)
    size = F.nullif(F.abs(baseline), F.lit(0.0))
    lower = lower_is_better(metric)
    return (
        F.when(lower & zero, F.lit(1.0) - current / F.lit(ZERO_BASELINE_SCALE))
        .when(lower, F.lit(1.0) - (current - baseline) / size)
        .when(~zero, F.lit(1.0) - (baseline - current) / size)
    )


def utility_scores(rows: DataFrame) -> DataFrame:
    """Primary-metric rows of the candidate epsilons with baseline and score."""
    by_query = Window.partitionBy("query_num", "mechanism")
    with_base = rows.withColumn(
        "baseline", F.max(F.when(F.col("no_noise"), F.col("value"))).over(by_query)
    )
    score = utility_preserved(F.col("metric_type"), F.col("value"), F.col("baseline"))
    return (
        with_base.where(~F.col("no_noise") & (F.col("eps") <= MAX_EPSILON))
        .withColumn("score", score).where(F.col("score").isNotNull())
    )


def utility_table(summary: DataFrame, published: bool = False) -> DataFrame:
    """Per (mechanism, epsilon): mean and minimum score over the queries, with the
    per-query scores as an array (one element per released query)."""
    scores = utility_scores(primary_metrics(summary, published))
    detail = F.struct(
        "query_num", "metric_type", F.col("primary_col").alias("col"),
        round_to("baseline", 4).alias("baseline"), round_to("value", 4).alias("current"),
        round_to("score", 4).alias("utility_preserved"),
    )
    return scores.groupBy("mechanism", "eps").agg(
        round_to(F.avg("score"), 4).alias("mean_utility_preserved"),
        round_to(F.min("score"), 4).alias("min_utility_preserved"),
        F.count(F.lit(1)).alias("n_queries_scored"),
        F.sort_array(F.collect_list(detail)).alias("per_query_detail"),
    )


def _choice(score: str) -> tuple[Column, Column]:
    """Aggregates: the smallest epsilon that meets the threshold, and the epsilon of
    the best score (the smallest on a tie)."""
    met = F.min(F.when(F.col(score) >= UTILITY_THRESHOLD, F.col("eps")))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col("eps")).alias("o")))
    return met, -best.getField("o")


def select_epsilon(utility: DataFrame, near_miss: str = "gap") -> DataFrame:
    """One row per mechanism: the chosen epsilon, its utility, the next smaller one.

    ``near_miss`` compares the runner-up with the chosen utility ("gap") or with
    the threshold ("threshold").
    """
    met, best = _choice("mean_utility_preserved")
    chosen = utility.groupBy("mechanism").agg(
        F.coalesce(met, best).alias("best_epsilon"),
        F.when(met.isNotNull(), "utility_threshold_met").otherwise("best_available")
        .alias("status"),
    )
    # One row per mechanism.
    rows = utility.join(F.broadcast(chosen), "mechanism")
    at = F.col("eps") == F.col("best_epsilon")
    below = F.when(
        F.col("eps") < F.col("best_epsilon"), F.struct("eps", "mean_utility_preserved")
    )
    out = rows.groupBy("mechanism", "best_epsilon", "status").agg(
        F.max(F.when(at, F.col("mean_utility_preserved"))).alias("mean_utility_preserved"),
        F.max(F.when(at, F.col("min_utility_preserved"))).alias("min_utility_preserved"),
        F.max(F.when(at, F.col("n_queries_scored"))).alias("n_queries_scored"),
        F.max(below).alias("below"),
    )
    runner_up = F.col("below.mean_utility_preserved")
    target = F.col("mean_utility_preserved") if near_miss == "gap" else F.lit(UTILITY_THRESHOLD)
    return out.select(
        "mechanism", "best_epsilon", "mean_utility_preserved", "min_utility_preserved",
        "n_queries_scored", F.col("below.eps").alias("runner_up_epsilon"),
        runner_up.alias("runner_up_utility"),
        F.coalesce(target - runner_up <= NEAR_MISS_MARGIN, F.lit(False)).alias("near_miss"),
        "status",
    )


def selection_report(
    summary: DataFrame, variant: str, database: str, published: bool = False,
    near_miss: str = "gap",
) -> DataFrame:
    """The selection, with a ``no_candidates`` row for a mechanism without scores."""
    chosen = select_epsilon(utility_table(summary, published), near_miss)
    mechanisms = summary.select("mechanism").distinct()
    return mechanisms.join(chosen, "mechanism", "left").select(
        "mechanism", "best_epsilon", "mean_utility_preserved", "min_utility_preserved",
        F.coalesce("n_queries_scored", F.lit(0)).alias("n_queries_scored"),
        "runner_up_epsilon", "runner_up_utility",
        F.coalesce("near_miss", F.lit(False)).alias("near_miss"),
        F.coalesce("status", F.lit("no_candidates")).alias("status"),
        F.lit(variant).alias("variant"), F.lit(database).alias("database"),
    )


def comparison_as_rows(comparison: DataFrame) -> DataFrame:
    """A mechanism comparison as primary-metric rows."""
    long = comparison.unpivot(
        ["query_num", "epsilon", "metric_type", "primary_col"],
        ["gaussian_value", "laplace_value"], "mechanism", "value",
    )
    return long.select(
        "query_num", F.regexp_replace("mechanism", "_value$", "").alias("mechanism"),
        "metric_type", "epsilon", epsilon_number(F.col("epsilon")).alias("eps"),
        is_no_noise(F.col("epsilon")).alias("no_noise"), "primary_col", "value",
    )


def best_epsilon_per_query(comparison: DataFrame) -> DataFrame:
    """The selection rule applied to each (query, mechanism) of a comparison, with
    whether the chosen epsilon also passes the fixed threshold."""
    scores = utility_scores(comparison_as_rows(comparison))
    met, best = _choice("score")
    keys = ["query_num", "mechanism", "metric_type"]
    chosen = scores.groupBy(*keys).agg(
        F.coalesce(met, best).alias("best_epsilon"),
        F.when(met.isNotNull(), "utility_threshold_met").otherwise("best_available")
        .alias("status"),
    )
    at_best = scores.join(chosen, keys).where(F.col("eps") == F.col("best_epsilon"))
    return at_best.select(
        *keys, "best_epsilon",
        passes(F.col("metric_type"), F.col("value")).alias("passed_hard"), "status",
    )
