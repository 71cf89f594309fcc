"""Small shared expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def clip(e: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), e))


def grade(score: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """First name whose threshold the score reaches."""
    e = None
    for limit, name in steps:
        e = F.when(score >= limit, name) if e is None else e.when(score >= limit, name)
    return e.otherwise(last)


def norm3(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def present(*conds: tuple[Column, str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in conds]))
