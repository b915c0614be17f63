"""The tables behind the figures; drawing is left to the reader's tool."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetveil.plans.evaluation import (
    epsilon_number,
    is_no_noise,
    lower_is_better,
    primary_metrics,
)
from fleetveil.plans.metrics import passes
from fleetveil.plans.registry import EPSILON_GRID, epsilon_label

# Stand-in for infinity on a log axis, epsilons of the bar chart.
INFINITY_ON_AXIS = 1000.0
BAR_EPSILONS = (0.1, 0.5, 1.0)
ZERO_LOSS_BASE = 1e-12


def axis_value(epsilon: Column) -> Column:
    return F.when(is_no_noise(epsilon), F.lit(INFINITY_ON_AXIS)).otherwise(epsilon_number(epsilon))


def axis_ticks(summary: DataFrame) -> DataFrame:
    """(position, label) of the epsilons present, in order."""
    ticks = summary.select(F.trim(F.col("epsilon").cast("string")).alias("epsilon")).distinct()
    label = F.when(is_no_noise(F.col("epsilon")), "∞").otherwise(F.col("epsilon"))
    return ticks.select(axis_value(F.col("epsilon")).alias("position"), label.alias("label")) \
        .distinct().orderBy("position")


def _rows(summary: DataFrame) -> DataFrame:
    return primary_metrics(summary).withColumn("position", axis_value(F.col("epsilon")))


def utility_curves(summary: DataFrame) -> DataFrame:
    """Mean metric over queries per (metric type, mechanism, epsilon)."""
    return _rows(summary).groupBy("metric_type", "mechanism", "position").agg(
        F.avg("value").alias("mean_value")
    )


def query_heat_map(summary: DataFrame, epsilons: Sequence[float] = EPSILON_GRID) -> DataFrame:
    """Query by epsilon matrix of the metric, per mechanism."""
    labels = [epsilon_label(e) for e in epsilons]
    label = F.when(F.col("no_noise"), "inf").otherwise(F.col("eps").cast("string"))
    return (
        _rows(summary).withColumn("label", label)
        .groupBy("mechanism", "metric_type", "query_num").pivot("label", labels)
        .agg(F.avg("value"))
        .select(
            "mechanism", "metric_type", "query_num",
            *[F.col(f"`{x}`").alias(f"eps_{x.replace('.', '_')}") for x in labels],
        )
    )


def mechanism_bars(summary: DataFrame, epsilons: Sequence[float] = BAR_EPSILONS) -> DataFrame:
    """Mean metric side by side for the two mechanisms at a few epsilons."""
    return (
        _rows(summary).where(F.col("position").isin(list(epsilons)))
        .groupBy("metric_type", "position").pivot("mechanism", ["gaussian", "laplace"])
        .agg(F.avg("value"))
    )


def pass_rates(summary: DataFrame) -> DataFrame:
    hit = passes(F.col("metric_type"), F.col("value")).cast("int")
    return _rows(summary).groupBy("mechanism", "position").agg(F.avg(hit).alias("pass_rate"))


def best_epsilon_points(best: DataFrame) -> DataFrame:
    """Points of the best-epsilon chart from ``best_epsilon_per_query``."""
    return best.where(F.col("best_epsilon").isNotNull()).select(
        "query_num", "mechanism", "best_epsilon",
        F.coalesce("passed_hard", F.lit(False)).alias("passed_hard"), "status",
    )


def generalisation_points(mini: DataFrame, full: DataFrame, report: DataFrame) -> DataFrame:
    """Sample against full data at the epsilon selected on the sample.

    ``report`` has one row per mechanism. A query without a sample value keeps its
    full value and does not pass on the sample side.
    """
    chosen = F.broadcast(report.select("mechanism", "best_epsilon"))

    def at_choice(summary: DataFrame) -> DataFrame:
        joined = _rows(summary).join(chosen, "mechanism")
        return joined.where(F.abs(F.col("eps") - F.col("best_epsilon")) < 1e-9)

    small = at_choice(mini).select("query_num", "mechanism", F.col("value").alias("mini_value"))
    whole = at_choice(full).select(
        "query_num", "mechanism", "metric_type", "best_epsilon",
        F.col("value").alias("full_value"),
    )

    def ok(value: str) -> Column:
        return F.coalesce(passes(F.col("metric_type"), F.col(value)), F.lit(False))

    return whole.join(small, ["query_num", "mechanism"], "left").select(
        "query_num", "mechanism", "metric_type", F.col("best_epsilon").alias("epsilon"),
        "mini_value", "full_value", ok("mini_value").alias("mini_pass"),
        ok("full_value").alias("full_pass"),
    )


def pareto_points(summary: DataFrame) -> DataFrame:
    """(privacy gain 1/epsilon, utility loss) per query, mechanism and epsilon; the
    loss is relative to the noise-free value, absolute where that is about 0."""
    rows = _rows(summary)
    base = rows.where("no_noise").groupBy("query_num", "mechanism").agg(
        F.max("value").alias("baseline")
    )
    size = F.nullif(F.abs(F.col("baseline")), F.lit(0.0))
    change = F.col("value") - F.col("baseline")
    loss = (
        F.when(F.abs(F.col("baseline")) < ZERO_LOSS_BASE, F.abs(change))
        .when(lower_is_better(F.col("metric_type")), change / size)
        .otherwise(-change / size)
    )
    # One base row per query and mechanism.
    return (
        rows.where(~F.col("no_noise")).join(F.broadcast(base), ["query_num", "mechanism"])
        .select(
            "query_num", "mechanism", "metric_type", "eps",
            (F.lit(1.0) / F.nullif(F.col("eps"), F.lit(0.0))).alias("privacy_gain"),
            loss.alias("utility_loss"),
        )
    )


def is_single_epsilon(summary: DataFrame) -> DataFrame:
    """Per mechanism: whether the summary holds at most one finite epsilon."""
    finite = F.when(~is_no_noise(F.col("epsilon")), epsilon_number(F.col("epsilon")))
    return summary.groupBy("mechanism").agg(
        (F.count_distinct(finite) <= 1).alias("single_epsilon")
    )
