"""The private release: exact results to noisy cells, over the whole grid at once."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetveil.functions.draws import fresh_seed, snap_to_grid
from fleetveil.functions.exprs import joined_key, key_parts
from fleetveil.operators.noise import (
    Policy,
    add_noise,
    clamp_and_normalise,
    epsilon_frame,
    epsilon_on_grid,
    flip_selection,
    noise_plan,
    noisy_selection,
    normalise_rows,
)
from fleetveil.operators.ranking import full_rank
from fleetveil.plans.registry import (
    DELTA,
    EPSILON_GRID,
    INF,
    KEY_TYPES,
    MECHANISMS,
    Limits,
    ReleasedQuery,
    published_sensitivity_limits,
    release_registry,
)
from fleetveil.plans.release_queries import browser_counts, run_cell_query
from fleetveil.session import stage
from fleetveil.sources.sinks import noisy_only, write_release

SELECTION_QUERY = 6


@dataclass(frozen=True)
class Release:
    """Noisy cells and noisy winners over (mechanism, epsilon), with the true
    values beside them for the utility metrics; publish only the noisy columns."""

    cells: DataFrame
    winners: DataFrame
    registry: Mapping[int, ReleasedQuery]


def result_cells(result: DataFrame, query: ReleasedQuery) -> DataFrame:
    """Unpivot one exact result to (query_num, group_key, item, column, true_value)."""
    wide = result.select(
        joined_key(list(query.keys)).alias("group_key"),
        *[F.col(c.name).cast("double").alias(c.name) for c in query.columns],
    )
    long = wide.unpivot("group_key", [c.name for c in query.columns], "column", "true_value")
    return long.select(
        F.lit(query.number).alias("query_num"), "group_key", F.lit("").alias("item"), "column",
        "true_value",
    )


def selection_counts(counts: DataFrame, query: ReleasedQuery) -> DataFrame:
    return counts.select(
        F.lit(query.number).alias("query_num"),
        joined_key(list(query.keys)).alias("group_key"),
        F.col(query.metric_columns[0]).alias("item"),
        F.col("number_of_systems").cast("double").alias("true_value"),
    )


def exact_cells(
    tables: Mapping[str, DataFrame],
    registry: Mapping[int, ReleasedQuery],
    limits: Limits,
    numbers: Iterable[int] | None = None,
) -> DataFrame:
    """The cells of all (or some) release queries; the true rank of query 12 is not
    among them, it is recomputed from noisy values."""
    wanted = [n for n in (numbers or registry) if registry[n].columns]
    parts = [result_cells(run_cell_query(n, tables, limits), registry[n]) for n in wanted]
    return reduce(DataFrame.unionByName, parts)


def noisy_cells(
    cells: DataFrame,
    registry: Mapping[int, ReleasedQuery],
    policy: Policy,
    seed: str,
    epsilons: Iterable[float] = EPSILON_GRID,
    mechanisms: Iterable[str] = MECHANISMS,
    delta: float = DELTA,
    snap_exponent: int | None = None,
) -> DataFrame:
    plan = noise_plan(
        cells.sparkSession, registry, policy, epsilons=list(epsilons),
        mechanisms=list(mechanisms), delta=delta,
    )
    noisy = add_noise(cells, plan, seed)
    if snap_exponent is not None:
        noisy = noisy.withColumn("noisy_value", snap_to_grid(F.col("noisy_value"), snap_exponent))
    repaired = clamp_and_normalise(noisy)
    # Only the queries with distribution columns pay for the row-wise shuffle.
    dist = [q.number for q in registry.values() if q.distribution]
    in_dist = F.col("query_num").isin(dist) & F.col("is_dist")
    rows = normalise_rows(
        repaired.where(in_dist), policy.smoothing if policy.advanced else None
    )
    return repaired.where(~in_dist).unionByName(rows).select(
        "query_num", "mechanism", F.lit(policy.variant).alias("variant"), "epsilon", "group_key",
        "item", "column", "true_value", "noisy_value",
    )


def noisy_winners(
    counts: DataFrame,
    registry: Mapping[int, ReleasedQuery],
    policy: Policy,
    seed: str,
    epsilons: Iterable[float] = EPSILON_GRID,
    mechanisms: Iterable[str] = MECHANISMS,
) -> DataFrame:
    query = registry[SELECTION_QUERY]
    cells = selection_counts(counts, query)
    grid = epsilon_frame(counts.sparkSession, list(epsilons), list(mechanisms))
    if policy.advanced and policy.selection == "counts":
        out = noisy_selection(cells, grid, seed, query.groups)
    else:
        best = cells.groupBy("query_num", "group_key").agg(
            F.max(F.struct("true_value", "item")).getField("item").alias("true_item")
        )
        if policy.advanced:
            out = flip_selection(best, grid, seed)
        else:
            out = best.crossJoin(F.broadcast(grid)).select(
                "query_num", "mechanism", "epsilon", "group_key", "true_item",
                F.col("true_item").alias("noisy_item"),
            )
    return out.withColumn("variant", F.lit(policy.variant))


def run_release(
    tables: Mapping[str, DataFrame],
    limits: Limits | None = None,
    policy: Policy | None = None,
    seed: str | None = None,
    epsilons: Iterable[float] = EPSILON_GRID,
    mechanisms: Iterable[str] = MECHANISMS,
    delta: float = DELTA,
    published_sensitivities: bool = False,
) -> Release:
    """Exact results, staged once, then noise for the whole grid, staged again.

    Without ``seed`` a fresh secret is drawn. Staging makes the metrics read one
    fixed release rather than re-evaluate the queries, and lets them survive the
    loss of an executor without replaying the source scans.
    """
    limits = limits or Limits()
    if published_sensitivities:
        limits = limits.unbounded()
    policy = policy or Policy()
    seed = seed or fresh_seed()
    registry = release_registry(
        published_sensitivity_limits(limits) if published_sensitivities else limits
    )
    cells = stage(exact_cells(tables, registry, limits))
    counts = stage(browser_counts(tables, limits))
    grid = {"epsilons": list(epsilons), "mechanisms": list(mechanisms)}
    noisy = noisy_cells(cells, registry, policy, seed, delta=delta, **grid)
    winners = noisy_winners(counts, registry, policy, seed, **grid)
    return Release(stage(noisy), stage(winners), registry)


def rerun_epsilon(
    cells: DataFrame,
    registry: Mapping[int, ReleasedQuery],
    policy: Policy,
    seed: str,
    epsilon: float,
    folder: str,
    grid: Iterable[float] = EPSILON_GRID,
    mechanisms: Iterable[str] = MECHANISMS,
    delta: float = DELTA,
) -> int:
    """Noise one epsilon of the grid anew and store it among the others; returns its place.

    An epsilon that is not on the grid is refused. A draw depends on the seed and the cell only,
    so with the seed of the stored release the same bits come out; other partitions of the
    folder stay as they are.
    """
    place, value = epsilon_on_grid(epsilon, grid)
    noisy = noisy_cells(
        cells, registry, policy, seed, epsilons=[value], mechanisms=mechanisms, delta=delta
    )
    write_release(noisy_only(noisy), folder, others_stay=True)
    return place


def published_table(release: Release, number: int) -> DataFrame:
    """One query's noisy result in wide form, keys split back with their types, for every
    mechanism and epsilon. Query 12 gets its rank from the noisy values."""
    query = release.registry[number]
    at = ["mechanism", "epsilon", "group_key"]
    if not query.columns:
        wide = release.winners.where(F.col("query_num") == number).select(
            *at, F.col("noisy_item").alias(query.metric_columns[0])
        )
    else:
        names = [c.name for c in query.columns]
        wide = (
            release.cells.where(F.col("query_num") == number)
            .groupBy(*at).pivot("column", names).agg(F.max("noisy_value"))
        )
    if number == 12:
        wide = full_rank(wide, "total_power_consumption", "rnk", ["mechanism", "epsilon"])
    types = [KEY_TYPES.get(k, "string") for k in query.keys]
    keys = [c.alias(k) for c, k in zip(key_parts("group_key", types), query.keys)]
    return wide.select("mechanism", "epsilon", *keys, *wide.columns[3:])


def filter_by_noisy_count(cells: DataFrame, threshold: float) -> DataFrame:
    """Keep the groups whose noisy device count reaches ``threshold``.

    The size filter of the exact queries looks at true counts, so which groups
    appear is not private; released with a minimum of 1 and this filter, it is a
    post-process of noisy values.
    """
    at = ["query_num", "mechanism", "variant", "epsilon", "group_key"]
    kept = cells.where(
        (F.col("column") == "number_of_systems") & (F.col("noisy_value") >= threshold)
    ).select(*at)
    return cells.join(kept, at, "left_semi")


def privacy_ledger(
    spark: SparkSession,
    cells: DataFrame,
    winners: DataFrame | None,
    registry: Mapping[int, ReleasedQuery],
    policy: Policy,
    delta: float = DELTA,
) -> DataFrame:
    """Epsilon and delta spent per (mechanism, epsilon, query) by sequential
    composition over the columns that were released, with the size of the release."""
    plan = noise_plan(spark, registry, policy, delta=delta).where(
        F.col("epsilon_value") != F.lit(INF)
    )
    released = cells.groupBy("query_num", "column", "mechanism", "epsilon").agg(
        F.count(F.lit(1)).alias("n_cells")
    )
    spent = released.join(F.broadcast(plan), ["query_num", "column", "mechanism", "epsilon"])
    ledger = spent.groupBy("mechanism", "epsilon", "query_num").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.sum("n_cells").alias("n_cells"),
        F.sum("column_epsilon").alias("epsilon_spent"),
        F.sum("column_delta").alias("delta_spent"),
    )
    if winners is None:
        return ledger
    selected = (
        winners.where(F.col("epsilon") != "inf").groupBy("mechanism", "epsilon", "query_num")
        .agg(
            F.lit(1).cast("long").alias("n_columns"),
            F.count(F.lit(1)).alias("n_cells"),
            F.max(F.col("epsilon").cast("double")).alias("epsilon_spent"),
            F.lit(0.0).alias("delta_spent"),
        )
    )
    return ledger.unionByName(selected)


def ledger_totals(ledger: DataFrame, budget: float | None = None) -> DataFrame:
    """Sum over queries per (mechanism, epsilon), and whether it fits ``budget``."""
    totals = ledger.groupBy("mechanism", "epsilon").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.sum("epsilon_spent").alias("epsilon_total"),
        F.sum("delta_spent").alias("delta_total"),
    )
    if budget is None:
        return totals
    return totals.withColumn("within_budget", F.col("epsilon_total") <= F.lit(budget))


def allocate_budget(
    total: float, shares: Mapping[int, float] | None = None, numbers: Iterable[int] = range(1, 13)
) -> dict[int, float]:
    """Epsilon per query: the given shares (query 8 a fifth), the rest split evenly."""
    fixed = dict(shares or {8: 0.2})
    rest = [n for n in numbers if n not in fixed]
    left = 1.0 - sum(fixed.values())
    return {n: total * s for n, s in sorted({**fixed, **{n: left / len(rest) for n in rest}}.items())}
