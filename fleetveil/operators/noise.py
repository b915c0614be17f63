"""The noise plan and the mechanisms over result cells.

Results are handled in long form, one row per cell:
``query_num, group_key, item, column, true_value``. All queries, mechanisms and
epsilons are noised in one job by joining the plan, whose size is the number of
released columns times mechanisms times epsilons and does not grow with data.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetveil.functions.calibration import laplace_scale, released_sigma
from fleetveil.functions.draws import gaussian_draw, laplace_draw
from fleetveil.plans.registry import (
    DELTA,
    EPSILON_GRID,
    INF,
    MECHANISMS,
    ReleasedQuery,
    epsilon_label,
)

PLAN_SCHEMA = (
    "query_num int, column string, mechanism string, epsilon string, epsilon_value double, "
    "column_epsilon double, column_delta double, scale double, rescale boolean, "
    "normalise boolean, is_dist boolean"
)

# Fixed value: divisor that the published variant applies to every distribution column.
PUBLISHED_DISTRIBUTION_PARTS = 28


@dataclass(frozen=True)
class Policy:
    """How a query's budget is spent and how its noisy cells are repaired.

    The defaults keep the stated guarantee: a query's epsilon is split over its
    parts (its distribution columns form one part, split further) and only true
    shares are scaled to 100. ``published()`` reproduces the reference behaviour,
    in which every column spends the whole epsilon; it does not compose to the
    stated epsilon and serves comparison only.
    """

    variant: str = "advance"  # "baseline": no selection noise, rescaling, split or smoothing
    budget: str = "split"  # or "per_column"
    distribution_parts: int | None = None
    selection: str = "counts"  # or "flip"
    normalise: str = "shares"  # or "percent_columns"
    smoothing: float = 0.01

    @staticmethod
    def published(variant: str = "advance") -> Policy:
        return Policy(
            variant=variant, budget="per_column",
            distribution_parts=PUBLISHED_DISTRIBUTION_PARTS, selection="flip",
            normalise="percent_columns",
        )

    @property
    def advanced(self) -> bool:
        return self.variant == "advance"


def column_share(query: ReleasedQuery, column: str, policy: Policy) -> float:
    """Fraction of the query's budget that one column spends."""
    dist = query.distribution
    parts = 1
    if policy.budget == "split":
        parts = len(query.columns) - len(dist) + (1 if dist else 0)
    share = 1.0 / parts
    if column in dist and (policy.advanced or policy.budget == "split"):
        share /= policy.distribution_parts or len(dist)
    return share


def plan_rows(
    registry: Mapping[int, ReleasedQuery],
    policy: Policy,
    epsilons: Iterable[float] = EPSILON_GRID,
    mechanisms: Iterable[str] = MECHANISMS,
    delta: float = DELTA,
) -> list[tuple]:
    scales: dict[tuple, float] = {}
    rows = []
    for query in registry.values():
        for column in query.columns:
            share = column_share(query, column.name, policy)
            for mechanism in mechanisms:
                gaussian = mechanism == "gaussian"
                for epsilon in epsilons:
                    eps = epsilon * share if epsilon != INF else INF
                    col_delta = delta * (share if policy.budget == "split" else 1.0)
                    key = (mechanism, column.sensitivity, query.groups, eps, col_delta)
                    if key not in scales:
                        # One unit moves so many groups: a sum of shifts for Laplace, a root
                        # of squares for the Gaussian.
                        scales[key] = (
                            released_sigma(eps, col_delta) * column.sensitivity * math.sqrt(query.groups)
                            if gaussian
                            else laplace_scale(column.sensitivity * query.groups, eps)
                        )
                    rows.append((
                        query.number, column.name, mechanism, epsilon_label(epsilon), epsilon,
                        eps, col_delta if gaussian else 0.0, scales[key],
                        bool(policy.advanced and column.share and query.metric == "TVD"),
                        column.share if policy.normalise == "shares"
                        else column.name == query.percent_column,
                        column.dist,
                    ))
    return rows


def noise_plan(spark: SparkSession, registry: Mapping[int, ReleasedQuery], policy: Policy,
               **grid) -> DataFrame:
    return spark.createDataFrame(plan_rows(registry, policy, **grid), PLAN_SCHEMA)


def epsilon_on_grid(epsilon: float, grid: Iterable[float] = EPSILON_GRID) -> tuple[int, float]:
    """The grid position and value of a single-epsilon run; the epsilon must be on the grid."""
    grid = list(grid)
    if epsilon not in grid:
        raise ValueError(f"epsilon {epsilon} is not on the grid {grid}")
    return grid.index(epsilon), epsilon


def epsilon_frame(spark: SparkSession, epsilons: Iterable[float], mechanisms: Iterable[str]):
    rows = [(m, epsilon_label(e), e) for m in mechanisms for e in epsilons]
    return spark.createDataFrame(rows, "mechanism string, epsilon string, epsilon_value double")


def cell_draw(mechanism: Column, scale: Column, seed: str, *identity: Column) -> Column:
    return (
        F.when(scale == 0, F.lit(0.0))
        .when(mechanism == "laplace", laplace_draw(seed, scale, *identity))
        .otherwise(gaussian_draw(seed, scale, *identity))
    )


def add_noise(cells: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """Noise every cell for every mechanism and epsilon of the plan.

    Columns flagged ``rescale`` are first scaled to sum to 100 over the groups.
    An infinite epsilon passes the true value through untouched.
    """
    finite = F.col("epsilon_value") != F.lit(INF)
    # One sum per released column: bounded by the registry.
    sums = cells.groupBy("query_num", "column").agg(F.sum("true_value").alias("__sum"))
    rescaled = F.when(
        F.col("rescale") & finite & (F.col("__sum") > 0),
        F.col("true_value") * F.lit(100.0) / F.nullif(F.col("__sum"), F.lit(0.0)),
    ).otherwise(F.col("true_value"))
    draw = cell_draw(
        F.col("mechanism"), F.col("scale"), seed,
        *[F.col(c) for c in ("query_num", "column", "epsilon", "mechanism", "group_key", "item")],
    )
    return (
        cells.join(F.broadcast(plan), ["query_num", "column"])
        .join(F.broadcast(sums), ["query_num", "column"])
        .withColumn("noisy_value", rescaled + draw)
        .drop("__sum")
    )


CELL = ["query_num", "mechanism", "epsilon", "column"]


def clamp_and_normalise(noisy: DataFrame) -> DataFrame:
    """Clamp noised cells at 0 and scale the flagged columns to sum to 100.

    The sums are a grouped aggregate joined back, one row per released column,
    mechanism and epsilon; a window would put a whole result into one task.
    """
    finite = F.col("epsilon_value") != F.lit(INF)
    clamped = noisy.withColumn(
        "noisy_value",
        F.when(finite, F.greatest(F.col("noisy_value"), F.lit(0.0)))
        .otherwise(F.col("noisy_value")),
    )
    sums = (
        clamped.where(F.col("normalise") & finite).groupBy(*CELL)
        .agg(F.sum("noisy_value").alias("__sum"))
    )
    scaled = F.when(
        F.col("__sum") > 0,
        F.col("noisy_value") * F.lit(100.0) / F.nullif(F.col("__sum"), F.lit(0.0)),
    ).otherwise(F.col("noisy_value"))
    return (
        clamped.join(F.broadcast(sums), CELL, "left")
        .withColumn("noisy_value", scaled).drop("__sum")
    )


def normalise_rows(noisy: DataFrame, smoothing: float | None) -> DataFrame:
    """Scale each row's distribution columns to 100, optionally after adding
    ``smoothing`` to each. A window holds one row's few columns."""
    row = Window.partitionBy("query_num", "mechanism", "epsilon", "group_key")
    finite = F.col("epsilon_value") != F.lit(INF)

    def scale_to_100(df: DataFrame) -> DataFrame:
        total = F.sum("noisy_value").over(row)
        scaled = F.col("noisy_value") * F.lit(100.0) / F.nullif(F.col("__total"), F.lit(0.0))
        return (
            df.withColumn("__total", total)
            .withColumn(
                "noisy_value",
                F.when(finite & (F.col("__total") > 0), scaled).otherwise(F.col("noisy_value")),
            )
            .drop("__total")
        )

    out = scale_to_100(noisy)
    if smoothing is None:
        return out
    return scale_to_100(
        out.withColumn(
            "noisy_value",
            F.when(finite, F.col("noisy_value") + F.lit(smoothing))
            .otherwise(F.col("noisy_value")),
        )
    )


def noisy_selection(counts: DataFrame, grid: DataFrame, seed: str, groups: int = 1) -> DataFrame:
    """Report noisy max: the item with the largest noisy count per group.

    ``counts`` holds (query_num, group_key, item, true_value); ``grid`` the
    mechanism and epsilon pairs. Laplace noise of scale groups/epsilon goes on each
    count under either mechanism name: a unit counts in at most ``groups`` of them. The winner is a grouped maximum, partly
    computed before the shuffle, so a group of any size is no hot task.
    """
    scale = F.when(F.col("epsilon_value") == F.lit(INF), F.lit(0.0)).otherwise(
        F.lit(float(groups)) / F.col("epsilon_value")
    )
    identity = [F.col(c) for c in ("query_num", "epsilon", "mechanism", "group_key", "item")]
    noisy = counts.crossJoin(F.broadcast(grid)).withColumn(
        "noisy_value",
        F.col("true_value")
        + F.when(scale == 0, F.lit(0.0)).otherwise(laplace_draw(seed, scale, *identity)),
    )
    return noisy.groupBy("query_num", "mechanism", "epsilon", "group_key").agg(
        F.max(F.struct("true_value", "item")).getField("item").alias("true_item"),
        F.max(F.struct("noisy_value", "item")).getField("item").alias("noisy_item"),
    )


def flip_selection(winners: DataFrame, grid: DataFrame, seed: str) -> DataFrame:
    """The published shortcut: relabel a true winner ``unknown`` when 1 plus Laplace
    noise falls below one half. Not a private selection; for comparison only."""
    scale = F.when(F.col("epsilon_value") == F.lit(INF), F.lit(0.0)).otherwise(
        F.lit(1.0) / F.col("epsilon_value")
    )
    identity = [F.col(c) for c in ("query_num", "epsilon", "mechanism", "group_key", "true_item")]
    draw = F.when(scale == 0, F.lit(0.0)).otherwise(laplace_draw(seed, scale, *identity))
    noisy = F.when(F.lit(1.0) + draw < 0.5, F.lit("unknown")).otherwise(F.col("true_item"))
    return winners.crossJoin(F.broadcast(grid)).select(
        "query_num", "mechanism", "epsilon", "group_key", "true_item", noisy.alias("noisy_item")
    )
