"""Backscatter and complex-signal column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathline.schema import DB_FLOOR


def db_clipped(value: Column, floor: float = DB_FLOOR) -> Column:
    """Linear power to dB with a floor; NaN stays NaN because it sorts above every number."""
    return 10 * F.log10(F.greatest(value, F.lit(floor)))


def db_masked(value: Column, nodata: float = 0.0) -> Column:
    """Linear power to dB; nodata, NaN and non-positive values become NULL."""
    clean = F.when(F.isnan(value), None).otherwise(F.nullif(value, F.lit(nodata)))
    return 10 * F.log10(clean)


def amplitude_db(value: Column) -> Column:
    return 20 * F.log10(value + F.lit(DB_FLOOR))


def change_db(pre: Column, post: Column) -> Column:
    return db_clipped(post) - db_clipped(pre)


def below(diff: Column, threshold) -> Column:
    """1 where the difference is strictly below the threshold; NULL and NaN give 0."""
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return F.when(diff < limit, 1).otherwise(0)


def real_part(amplitude: Column, phase: Column) -> Column:
    return amplitude * F.cos(phase)


def imag_part(amplitude: Column, phase: Column) -> Column:
    return amplitude * F.sin(phase)


def conj_product(re1: Column, im1: Column, re2: Column, im2: Column) -> tuple[Column, Column]:
    """s1 * conj(s2) as (re, im)."""
    return re1 * re2 + im1 * im2, im1 * re2 - re1 * im2
