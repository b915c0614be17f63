"""Assembles oracle texts from named common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6
# Moves exact decimal ties off the rounding edge, where the last bit of a sum, which
# depends on the order of its terms, would otherwise decide the digit.
OFF_EDGE = 3e-8


def pick(spec: str, sql: str) -> str:
    """Typed projection: ``name:i`` integer, ``:d`` rounded double, ``:s`` text."""
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        if kind == "i":
            out.append(f'CAST("{name}" AS BIGINT) AS "{name}"')
        elif kind == "d":
            out.append(f'ROUND(CAST("{name}" AS DOUBLE) + {OFF_EDGE!r}, {DIGITS}) + 0.0 AS "{name}"')
        else:
            out.append(f'CAST("{name}" AS VARCHAR) AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({sql}) AS picked"


def shape(df: DataFrame, spec: str) -> DataFrame:
    """The Spark side of :func:`pick`."""
    out = []
    for item in spec.split():
        name, kind = item.split(":")
        c = F.col(f"`{name}`")
        if kind == "i":
            out.append(c.cast("bigint").alias(name))
        elif kind == "d":
            out.append((F.round(c.cast("double") + F.lit(OFF_EDGE), DIGITS) + F.lit(0.0)).alias(name))
        else:
            out.append(c.cast("string").alias(name))
    return df.select(*out)


def expand_rounds(sql: str) -> str:
    """Write out ``round_dec(x[, digits])``: round half up in decimal arithmetic, after
    dropping the last bits of the double, which depend on the order of summation."""
    while (at := sql.rfind("round_dec(")) >= 0:
        start = at + len("round_dec(")
        depth, comma, end = 1, None, start
        while depth:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        value = sql[start:comma if comma else end - 1]
        digits = sql[comma + 1:end - 1].strip() if comma else "0"
        exact = f"CAST({value} AS DECIMAL(38, 9))"
        sql = f"{sql[:at]}CAST(round({exact}, {digits}) AS DOUBLE){sql[end:]}"
    return sql


def with_ctes(ctes: dict[str, str], sql: str) -> str:
    """Prefix ``sql`` with the CTEs it needs, directly or through others."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in ctes:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(ctes[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return expand_rounds(sql)
    body = ",\n".join(f"{n} AS MATERIALIZED ({ctes[n]})" for n in needed)
    return expand_rounds(f"WITH {body}\n{sql}")
