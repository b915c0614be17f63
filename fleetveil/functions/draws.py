"""Reproducible noise as column expressions.

A draw depends only on the seed and the identity of the cell, never on row order
or partitioning, so a recomputed task repeats it exactly. Anyone who holds the
seed can remove the noise: pass a fixed seed only in tests and repeatable
reports, otherwise use :func:`fresh_seed` and keep it out of logs.

Floating-point Laplace noise can leak through its low-order bits (Mironov,
2012); ``snap_to_grid`` rounds a noisy value to a power-of-two grid.
"""

from __future__ import annotations

import math
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F


def fresh_seed() -> str:
    return secrets.token_hex(16)


def hashed_uniform(seed: str, *parts: Column) -> Column:
    """A uniform in (0, 1) from the first 48 bits of an MD5 over seed and parts."""
    # A NULL part is written out, or (NULL, 'a') and ('a', NULL) would draw alike.
    text = F.concat_ws(
        "|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]
    )
    bits = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**48))


def laplace_from_uniform(u: Column, scale: Column) -> Column:
    centred = u - F.lit(0.5)
    return -scale * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))


def gaussian_from_uniforms(u1: Column, u2: Column, sigma: Column) -> Column:
    return sigma * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def laplace_draw(seed: str, scale: Column, *parts: Column) -> Column:
    return laplace_from_uniform(hashed_uniform(seed, *parts, F.lit("1")), scale)


def gaussian_draw(seed: str, sigma: Column, *parts: Column) -> Column:
    return gaussian_from_uniforms(
        hashed_uniform(seed, *parts, F.lit("1")), hashed_uniform(seed, *parts, F.lit("2")), sigma
    )


def snap_to_grid(value: Column, exponent: int) -> Column:
    step = F.lit(float(2.0**exponent))
    return F.round(value / step) * step
