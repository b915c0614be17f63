"""Utility of a release: relative error, total variation, rank correlation.

Cells pair by key, so a missing noisy cell cannot shift the pairing. Each metric
is a grouped aggregate over (query_num, mechanism, epsilon); nothing gathers a
result in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetveil.functions.calibration import correlation_p_value_udf
from fleetveil.functions.exprs import round_to
from fleetveil.operators.ranking import (
    attach_rank,
    exact_median,
    full_rank,
    rank_table,
    value_positions,
)
from fleetveil.plans.registry import DELTA, PASS_THRESHOLD, slug
from fleetveil.plans.release import Release
from fleetveil.session import stage

AT = ["query_num", "mechanism", "variant", "epsilon"]


def _metric_cells(release: Release, metric: str) -> DataFrame:
    """The cells of the metric columns of all queries scored by ``metric``."""
    wanted = [
        (F.col("query_num") == q.number) & F.col("column").isin(list(q.metric_columns))
        for q in release.registry.values()
        if q.metric == metric and q.columns
    ]
    return release.cells.where(reduce(Column.__or__, wanted)).where(
        F.col("true_value").isNotNull() & F.col("noisy_value").isNotNull()
    )


def median_relative_error(cells: DataFrame) -> DataFrame:
    """Median of |true - noisy| / |true| over the cells with a non-zero true value."""
    error = F.abs(F.col("true_value") - F.col("noisy_value")) / F.nullif(
        F.abs(F.col("true_value")), F.lit(0.0)
    )
    # Rounded so that ties compare equal in every evaluation of the frame.
    errors = cells.withColumn("re", F.round(error, 12)).where(F.col("re").isNotNull())
    return exact_median(errors, "re", AT, "median_re").withColumn(
        "median_re", round_to("median_re", 4)
    )


def total_variation(cells: DataFrame) -> DataFrame:
    """Half the L1 distance of the normalised true and noisy columns, per column."""
    at = [*AT, "column"]
    # One row per released column, mechanism and epsilon: bounded by the registry.
    sums = cells.groupBy(*at).agg(
        F.sum("true_value").alias("__t"), F.sum("noisy_value").alias("__n")
    )

    def normalised(value: str, total: str) -> Column:
        return F.col(value) / F.when(F.col(total) > 0, F.col(total)).otherwise(F.lit(1.0))

    gap = F.abs(normalised("true_value", "__t") - normalised("noisy_value", "__n"))
    return (
        cells.join(F.broadcast(sums), at).groupBy(*at)
        .agg(round_to(F.sum(gap) / F.lit(2.0), 4).alias("tvd"))
    )


def pivot_variation(per_column: DataFrame) -> DataFrame:
    return per_column.groupBy(*AT).agg(
        round_to(F.avg("tvd"), 4).alias("mean_tvd"), round_to(F.max("tvd"), 4).alias("max_tvd")
    )


def rank_correlation(ranks: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of two rank columns; 0 where a side has no variation,
    NULL below two rows."""
    spread = F.sqrt(F.var_pop(x) * F.var_pop(y))
    rho = F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))
    out = ranks.groupBy(*AT).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(rho, F.lit(0.0)).alias("rho"),
        (F.coalesce(spread, F.lit(0.0)) == 0).alias("flat"),
    )
    known = F.col("n") >= 2
    # Rounding noise must not push a perfect correlation past 1.
    rho = F.least(F.greatest(F.col("rho"), F.lit(-1.0)), F.lit(1.0))
    p = F.when(F.col("flat"), F.lit(1.0)).otherwise(
        correlation_p_value_udf(rho, F.col("n").cast("double"))
    )
    return out.select(
        *AT, F.when(known, round_to(rho, 4)).alias("spearman_rho"),
        F.when(known, round_to(F.nanvl(p, F.lit(None).cast("double")), 4)).alias("p_value"),
    )


def spearman_numeric(cells: DataFrame) -> DataFrame:
    """Average ranks, descending, of true and noisy values."""
    ranked = cells
    for side in ("true", "noisy"):
        value, name = f"{side}_value", f"{side}_rank"
        ranks = rank_table(cells, value, name, AT, average=True)
        ranked = attach_rank(ranked, ranks, value, name, AT)
    return rank_correlation(ranked, "true_rank", "noisy_rank")


def spearman_categorical(winners: DataFrame) -> DataFrame:
    """Winners in key order: a label stands for its last position among the true
    winners, a label that never truly wins for the number of rows."""
    places = value_positions(winners, "group_key", AT, descending=False)
    located = winners.join(
        places.select(*AT, "group_key", F.col("before").alias("position"), "total"),
        [*AT, "group_key"],
    )
    labels = located.groupBy(*AT, F.col("true_item").alias("noisy_item")).agg(
        F.max("position").alias("label_position")
    )
    scored = located.join(labels, [*AT, "noisy_item"], "left").withColumn(
        "label_position", F.coalesce("label_position", "total").cast("long")
    )
    # Several branches read the label positions: fix them once.
    scored = stage(scored)
    ranked = full_rank(
        scored, "label_position", "label_rank", AT, descending=False, average=True
    )
    return rank_correlation(ranked, "position", "label_rank")


def metric_summary(release: Release, database: str = "full", delta: float = DELTA) -> DataFrame:
    """One row per (query, mechanism, variant, epsilon) with the metric of its query.

    The seed is left out on purpose: whoever knows it can remove the noise.
    """
    registry = release.registry
    scored = [q for q in registry.values() if q.columns]
    first_column = reduce(
        Column.__or__,
        [(F.col("query_num") == q.number) & (F.col("column") == q.metric_columns[0])
         for q in scored],
    )
    sizes = release.cells.where(first_column).groupBy(*AT).agg(F.count(F.lit(1)).alias("n_rows"))
    sizes = sizes.unionByName(
        release.winners.groupBy(*AT).agg(F.count(F.lit(1)).alias("n_rows"))
    )
    per_column = total_variation(_metric_cells(release, "TVD"))
    pivots = [q.number for q in scored if q.metric == "TVD" and q.distribution]
    is_pivot = F.col("query_num").isin(pivots)
    rho = spearman_numeric(_metric_cells(release, "SPEARMAN")).unionByName(
        spearman_categorical(release.winners)
    )
    parts = [
        median_relative_error(_metric_cells(release, "RE")),
        pivot_variation(per_column.where(is_pivot)),
        per_column.where(~is_pivot).drop("column"),
        rho,
    ]
    # Every side has one row per query, mechanism and epsilon.
    wide = sizes
    for part in parts:
        wide = wide.join(F.broadcast(part), AT, "left")

    def by_query(values: dict[int, str]) -> Column:
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("query_num")]

    wide = wide.withColumn("metric_type", by_query({n: q.metric for n, q in registry.items()}))
    return wide.select(
        *AT, by_query({n: slug(q.title) for n, q in registry.items()}).alias("query_file"),
        F.when(F.col("mechanism") == "gaussian", F.lit(delta)).alias("delta"),
        F.lit(database).alias("database"), "n_rows", "metric_type", "median_re",
        "spearman_rho", "p_value", "mean_tvd", "max_tvd", "tvd",
        metric_pass().alias("pass"),
    )


def primary_value() -> Column:
    """The value a row is judged by, per metric type."""
    return (
        F.when(F.col("metric_type") == "RE", F.col("median_re"))
        .when(F.col("metric_type") == "TVD", F.coalesce("mean_tvd", "tvd"))
        .when(F.col("metric_type") == "SPEARMAN", F.col("spearman_rho"))
    )


def passes(metric: Column, value: Column) -> Column:
    return (
        F.when(metric == "SPEARMAN", value >= PASS_THRESHOLD["SPEARMAN"])
        .when(metric == "RE", value <= PASS_THRESHOLD["RE"])
        .when(metric == "TVD", value <= PASS_THRESHOLD["TVD"])
    )


def metric_pass() -> Column:
    return F.coalesce(passes(F.col("metric_type"), primary_value()), F.lit(False)).cast("int")
