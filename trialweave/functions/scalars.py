"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_53 = float(2**53)


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def expit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def one_of(x: Column, *values: str) -> Column:
    """1 when the lower-cased text of ``x`` is one of ``values``, else 0."""
    return F.coalesce(F.lower(x.cast("string")).isin(*values), F.lit(False)).cast("int")


def as_number(x: Column) -> Column:
    return x.try_cast("double")


def as_date(x: Column) -> Column:
    return x.try_cast("date")


def as_level(x: Column) -> Column:
    """Category text; a missing value is a level of its own."""
    return F.coalesce(x.cast("string"), F.lit("nan"))


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the key values and the seed only."""
    h = F.xxhash64(F.lit(seed).cast("long"), *keys)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(TWO_POW_53)


def hash_long(seed: int, *keys: Column) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), *keys)
