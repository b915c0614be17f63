"""Joins that keep their shape when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_time_join(
    fact: DataFrame,
    history: DataFrame,
    unit: str,
    at: str,
    valid_from: str,
    valid_to: str,
    salts: int = 8,
) -> DataFrame:
    """Inner join of facts to the history rows valid at the time of the fact.

    The equality on the unit makes it a hash-partitioned join with the range as
    a residual. The fact rows of one unit are spread over ``salts`` keys by their time
    and the history, a few rows per unit, is repeated once per salt, so a unit with a
    third of all facts becomes ``salts`` tasks. No pair is lost or doubled: each
    fact row carries exactly one salt. Only unit and time are read for it; fold facts
    that share both beforehand.
    """
    facts = fact.withColumn("__salt", F.pmod(F.xxhash64(unit, at), F.lit(salts)).cast("int"))
    spans = history.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    joined = facts.join(spans, [unit, "__salt"])
    return joined.where(F.col(at).between(F.col(valid_from), F.col(valid_to))).drop("__salt")


def fan_out_weighted_means(
    dimension: DataFrame,
    facts: Sequence[tuple[str, DataFrame, str, str]],
    unit: str,
    group: Sequence[str],
) -> DataFrame:
    """Weighted means over a star join whose fact tables all have many rows per unit.

    ``facts`` lists (output name, frame, value column, weight column). The plain
    join multiplies the rows of all tables for a unit. The same sums follow from
    one row per unit and table: a table's weighted sum is repeated once for each
    combination of rows of the other tables.
    """
    names = [name for name, *_ in facts]
    units = None
    for name, frame, value, weight in facts:
        per_unit = frame.groupBy(unit).agg(
            F.sum(F.col(weight) * F.col(value)).alias(f"{name}__s"),
            F.sum(F.col(weight)).cast("double").alias(f"{name}__w"),
            F.count(F.lit(1)).cast("double").alias(f"{name}__c"),
        )
        units = per_unit if units is None else units.join(per_unit, unit)
    return fan_out_means(dimension, units, names, unit, group)


def fan_out_means(
    dimension: DataFrame, units: DataFrame, names: Sequence[str], unit: str, group: Sequence[str]
) -> DataFrame:
    """The same from one row per unit with ``<name>__s``, ``__w`` and ``__c``: the weighted sum,
    the weights and the number of rows of each table. A unit without rows in one has no part."""
    complete = units
    for name in names:
        complete = complete.where(F.col(f"{name}__c") > 0)
    joined = dimension.select(unit, *group).join(complete, unit)

    def repeated(name: str, part: str):
        value = F.col(f"{name}__{part}")
        for other in names:
            if other != name:
                value = value * F.col(f"{other}__c")
        return value

    per_unit_sums = joined.select(
        unit,
        *group,
        *[repeated(n, "s").alias(f"{n}__num") for n in names],
        *[repeated(n, "w").alias(f"{n}__den") for n in names],
    )
    # A second fold by unit counts each unit once even if the dimension repeats it.
    folded = per_unit_sums.groupBy(*group, unit).agg(
        *[F.sum(f"{n}__{p}").alias(f"{n}__{p}") for n in names for p in ("num", "den")]
    )
    return folded.groupBy(*group).agg(
        F.count(F.lit(1)).alias("number_of_systems"),
        *[
            (F.sum(f"{n}__num") / F.nullif(F.sum(f"{n}__den"), F.lit(0.0))).alias(n)
            for n in names
        ],
    )
