"""Per-unit pre-aggregation, clipping and group summaries.

A unit (usually a device) may own a large share of all rows. Every job here first
folds the fact table to one row per unit and key, which Spark does partly on the
map side, and only then joins the device dimension. The join therefore never
sees a hot key, and the group aggregation after it is again partial plus final.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetveil.functions.exprs import clip_upper, col, ratio


@dataclass(frozen=True)
class Measure:
    """A per-unit quantity, kept as numerator and denominator so that it can be
    folded in stages: mean, weighted mean, sum or row count."""

    name: str
    numerator: Column
    denominator: Column | None = None
    cap: float | None = None

    def value(self, null_is_cap: bool = False) -> Column:
        top = F.col(f"{self.name}__num")
        raw = top.cast("double") if self.denominator is None else ratio(top, f"{self.name}__den")
        return raw if self.cap is None else clip_upper(raw, self.cap, null_is_cap)


def mean_of(name: str, value: Column | str, cap: float | None = None) -> Measure:
    return Measure(name, F.sum(col(value).cast("double")), F.count(col(value)), cap)


def weighted_mean_of(
    name: str, value: Column | str, weight: Column | str, cap: float | None = None
) -> Measure:
    return Measure(name, F.sum(col(weight) * col(value)), F.sum(col(weight)), cap)


def sum_of(name: str, value: Column | str, cap: float | None = None) -> Measure:
    return Measure(name, F.sum(col(value)), None, cap)


def count_of(name: str, cap: float | None = None) -> Measure:
    return Measure(name, F.count(F.lit(1)), None, cap)


def _state_columns(measures: Sequence[Measure]) -> list[str]:
    names = []
    for m in measures:
        names.append(f"{m.name}__num")
        if m.denominator is not None:
            names.append(f"{m.name}__den")
    return names


def unit_state(fact: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """One row per ``keys`` with the foldable state of each measure."""
    aggs = []
    for m in measures:
        aggs.append(m.numerator.alias(f"{m.name}__num"))
        if m.denominator is not None:
            aggs.append(m.denominator.alias(f"{m.name}__den"))
    return fact.groupBy(*keys).agg(*aggs)


def fold_state(state: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    return state.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _state_columns(measures)])


def unit_values(
    fact: DataFrame,
    unit: str,
    group: Sequence[str],
    measures: Sequence[Measure],
    dimension: DataFrame | None = None,
    null_is_cap: bool = False,
    max_groups_per_unit: int | None = None,
) -> DataFrame:
    """One clipped row per (group, unit).

    ``group`` columns come from the fact table, or from ``dimension`` joined on
    the unit. The state is folded once more after the join, so a unit that occurs
    in several dimension rows counts as it would in a row-level join; that fold
    needs no shuffle because the rows are already placed by unit.
    """
    dim_group = [g for g in group if dimension is not None and g in dimension.columns]
    fact_group = [g for g in group if g not in dim_group]
    state = unit_state(fact, [*fact_group, unit], measures)
    if dimension is not None:
        state = state.join(dimension.select(unit, *dim_group), unit)
        state = fold_state(state, [*group, unit], measures)
    if max_groups_per_unit is not None:
        # The join has placed the rows by unit.
        state = bound_groups_per_unit(
            state, unit, group, max_groups_per_unit, placed=dimension is not None
        )
    return state.select(
        *group, unit, *[m.value(null_is_cap).alias(m.name) for m in measures]
    )


def bound_groups_per_unit(
    df: DataFrame, unit: str, group: Sequence[str], limit: int, placed: bool = False
) -> DataFrame:
    """Contribution bound: keep at most ``limit`` groups of each unit, chosen by hash.

    Rows go to their unit's task before they are hashed, since the hashes, 32 letters each, are
    most of what would be shuffled. ``placed`` rows are there already.
    """
    df = df if placed else df.repartition(unit)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (unit, *group)]
    order = Window.partitionBy(unit).orderBy(F.md5(F.concat_ws("|", *parts)), *group)
    numbered = df.withColumn("__pick", F.row_number().over(order))
    return numbered.where(F.col("__pick") <= limit).drop("__pick")


def group_summary(
    units: DataFrame,
    group: Sequence[str],
    outputs: Sequence[Column],
    min_units: int | None = None,
) -> DataFrame:
    """Aggregate (group, unit) rows over units.

    The minimum size uses the true number of units: a quality threshold, not a
    private one (see ``filter_by_noisy_count``). ``mean_of_enough`` asks for the units
    with a value.
    """
    out = units.groupBy(*group).agg(F.count(F.lit(1)).alias("number_of_systems"), *outputs)
    return out if min_units is None else out.where(F.col("number_of_systems") >= min_units)


def distinct_units(
    fact: DataFrame, group: Sequence[str], unit: str, max_groups_per_unit: int | None = None
) -> DataFrame:
    """Number of distinct units per group, in two levels instead of COUNT(DISTINCT)."""
    pairs = fact.select(*group, unit).distinct()
    if max_groups_per_unit is not None:
        pairs = bound_groups_per_unit(pairs, unit, group, max_groups_per_unit)
    return pairs.groupBy(*group).agg(F.count(unit).alias("number_of_systems"))


def mean_of_enough(value: Column | str, least: int) -> Column:
    """Aggregate: the mean, NULL if fewer than ``least`` units have a value."""
    return F.avg(value) if least <= 1 else F.when(F.count(value) >= least, F.avg(value))


def with_total(df: DataFrame, **totals: Column) -> DataFrame:
    """Attach one-row totals; the broadcast side is a single row."""
    total = df.agg(*[expr.alias(name) for name, expr in totals.items()])
    return df.crossJoin(F.broadcast(total))
