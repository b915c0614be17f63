"""Ranks: top-k with ties, and full ranks without a single-task window.

``RANK() OVER (ORDER BY x)`` sends every row to one task, and a hot value does
the same within a partition. The full-rank operators here work on the distinct
values with their counts instead:

1. count the rows per distinct value (partial aggregation absorbs ties);
2. range-partition the values: Spark samples them, so that the bounds follow the data and
   close values are spread like any others; the result is staged, so the bounds are fixed;
3. turn the partitions' totals into running offsets (one row per partition and group in it);
4. accumulate inside each partition, many windows of equal size in parallel.

Values must evaluate to the same bits each time the frame is read: integers,
rounded numbers, text, or a frame that went through ``session.stage``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetveil.session import stage


def top_ranked(
    df: DataFrame, by: Column, k: int, partition: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Rows whose rank by ``by`` (descending) is at most ``k``; ties are kept.

    Spark plans the rank filter as a group limit ahead of the shuffle, so each
    task sends on only its own leading rows, also without a partition key.
    """
    order = Window.partitionBy(*partition).orderBy(by.desc_nulls_last())
    return df.withColumn(name, F.rank().over(order)).where(F.col(name) <= k)


def value_positions(
    df: DataFrame,
    value: str,
    group: Sequence[str] = (),
    descending: bool = True,
    ranges: int | None = None,
) -> DataFrame:
    """(group, value, n, before, total): how many rows hold the value, how many come
    strictly ahead of it, and how many there are. NULL is a value behind all others.

    ``ranges`` is the number of partitions, that of shuffles by default.
    """
    group = list(group)
    order = F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(
        counts.repartitionByRange(parts, *group, order).withColumn("__range", F.spark_partition_id())
    )
    by_group = Window.partitionBy(*group)
    ahead = by_group.orderBy("__range")
    offsets = (
        ranged.groupBy(*group, "__range")
        .agg(F.sum("n").alias("__n"))
        .withColumn("__ahead", F.sum("__n").over(ahead) - F.col("__n"))
        .withColumn("total", F.sum("__n").over(by_group))
        .drop("__n")
    )
    inside = Window.partitionBy(*group, "__range").orderBy(order)
    located = ranged.withColumn("__inside", F.sum("n").over(inside) - F.col("n"))
    left, right = located.alias("l"), offsets.alias("r")
    return left.join(right, _same("__range", group)).select(
        *[F.col(f"l.{g}").alias(g) for g in group],
        F.col(f"l.{value}").alias(value),
        F.col("n"),
        (F.col("__ahead") + F.col("__inside")).alias("before"),
        F.col("total"),
    )


def _same(key: str, group: Sequence[str]) -> Column:
    same = F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}"))
    for g in group:
        same = same & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    return same


def with_position(
    df: DataFrame, order: Sequence[Column], name: str = "position", ranges: int | None = None
) -> DataFrame:
    """Add the place of every row in a total order, from 1, without one task for all rows.

    Rows are range-partitioned by ``order``, which must tell any two apart, and staged; a row's
    place is its place in the partition behind the rows of all partitions before.
    """
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    ahead = Window.orderBy("__range")
    # One row per partition.
    offsets = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select(
        "__range", (F.sum("__n").over(ahead) - F.col("__n")).alias("__ahead")
    )
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    placed = ranged.withColumn("__inside", inside).join(F.broadcast(offsets), "__range")
    return placed.withColumn(name, F.col("__ahead") + F.col("__inside")).drop(
        "__range", "__inside", "__ahead"
    )


def rank_table(
    df: DataFrame,
    value: str,
    name: str,
    group: Sequence[str] = (),
    descending: bool = True,
    average: bool = False,
) -> DataFrame:
    """(group, value, rank) of the distinct values: the standard rank (1, 1, 3) or
    the average of tied places."""
    rank = F.col("before") + F.lit(1)
    if average:
        rank = rank + (F.col("n") - F.lit(1)) / F.lit(2.0)
    return value_positions(df, value, group, descending).select(
        *group, value, rank.alias(name)
    )


def attach_rank(
    df: DataFrame, ranks: DataFrame, value: str, name: str, group: Sequence[str] = ()
) -> DataFrame:
    """Join a :func:`rank_table` back to the rows. Each value is there once, so the rows of one
    that is very common may be split at will, which the adaptive skew join does."""
    left, right = df.alias("l"), ranks.alias("r")
    return left.join(right, _same(value, group), "left").select(
        *[F.col(f"l.{c}").alias(c) for c in df.columns], F.col(f"r.{name}").alias(name)
    )


def full_rank(
    df: DataFrame,
    value: str,
    name: str,
    group: Sequence[str] = (),
    descending: bool = True,
    average: bool = False,
) -> DataFrame:
    """Add the rank of every row; NULL values tie behind all others."""
    ranks = rank_table(df, value, name, group, descending, average)
    return attach_rank(df, ranks, value, name, group)


def exact_median(
    df: DataFrame, value: str, group: Sequence[str], name: str = "median"
) -> DataFrame:
    """Exact median per group without holding a group's values in one buffer."""
    group = list(group)
    places = value_positions(df.where(F.col(value).isNotNull()), value, group, descending=False)
    low = F.floor((F.col("total") + F.lit(1)) / F.lit(2.0))
    high = F.floor((F.col("total") + F.lit(2)) / F.lit(2.0))
    first, last = F.col("before") + F.lit(1), F.col("before") + F.col("n")
    hits = places.select(
        *group,
        value,
        (
            low.between(first, last).cast("int") + high.between(first, last).cast("int")
        ).alias("__hits"),
    ).where(F.col("__hits") > 0)
    return hits.groupBy(*group).agg(
        (F.sum(F.col(value) * F.col("__hits")) / F.lit(2.0)).alias(name)
    )
