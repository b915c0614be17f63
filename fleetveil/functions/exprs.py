"""Column expressions shared by the reporting, query and release jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double division that yields NULL for a zero denominator."""
    return col(numerator).cast("double") / F.nullif(col(denominator).cast("double"), F.lit(0.0))


def percent_of(part: Column | str, whole: Column | str) -> Column:
    return ratio(col(part).cast("double") * F.lit(100.0), whole)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    """Aggregate: sum of weight * value over sum of weight."""
    return ratio(F.sum(col(weight) * col(value)), F.sum(col(weight)))


def sentinel_null(value: Column | str, sentinel: float = -1) -> Column:
    return F.nullif(col(value), F.lit(sentinel))


def half_even_int(value: Column | str) -> Column:
    """Double to integer, rounding halves to even as the source engine's cast does.

    The last bits of a sum, which depend on the order of its terms, are dropped first: a decimal
    tie is a tie in any order.
    """
    return F.bround(F.round(col(value).cast("double"), 9), 0).cast("int")


def sum_when(condition: Column, value: Column | str) -> Column:
    """Aggregate: sum of ``value`` over the rows that satisfy ``condition``, else 0."""
    return F.sum(F.when(condition, col(value)).otherwise(F.lit(0)))


def row_total(columns: list[str]) -> Column:
    return F.expr(" + ".join(f"`{c}`" for c in columns))


def clip_upper(value: Column | str, cap: float, null_is_cap: bool = False) -> Column:
    """Cap a per-unit value.

    ``least`` skips NULL, which would turn a unit without data into one at the
    cap; by default such a unit stays NULL. ``null_is_cap`` restores the former.
    """
    value = col(value).cast("double")
    clipped = F.least(value, F.lit(float(cap)))
    return clipped if null_is_cap else F.when(value.isNotNull(), clipped)


def round_to(value: Column | str, digits: int = 0) -> Column:
    """Round half away from zero in decimal terms.

    The last bits of a double sum depend on the order of its terms and would decide
    a tie differently from run to run; they are dropped first.
    """
    return F.round(F.round(col(value).cast("double"), 9), digits)


# Separates the parts of a joined key; inside a part it is written as \\s, a backslash as \\b.
KEY_SEPARATOR = "\x1f"
# Stands for a NULL part; an empty text stays an empty text.
KEY_NULL = "\\0"


def joined_key(columns: list[str]) -> Column:
    """One text key from the grouping columns of a result, different for different groups."""

    def part(c: str) -> Column:
        text = F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\b"))
        text = F.replace(text, F.lit(KEY_SEPARATOR), F.lit("\\s"))
        return F.coalesce(text, F.lit(KEY_NULL))

    return F.concat_ws(KEY_SEPARATOR, *[part(c) for c in columns])


def key_parts(key: Column | str, types: list[str]) -> list[Column]:
    """The grouping columns back from a joined key, with their types."""
    parts = F.split(col(key), KEY_SEPARATOR)

    def value(i: int, kind: str) -> Column:
        text = F.nullif(parts.getItem(i), F.lit(KEY_NULL))
        text = F.replace(text, F.lit("\\s"), F.lit(KEY_SEPARATOR))
        return F.replace(text, F.lit("\\b"), F.lit("\\")).cast(kind)

    return [value(i, kind) for i, kind in enumerate(types)]
