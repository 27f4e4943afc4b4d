"""Small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cut points of ``snap`` sit at this fraction of a step, where no decimal or
# binary fraction lies, so that equal results never fall on two sides of a cut.
SNAP_SHIFT = 0.3141592


def snap(value: Column, digits: int) -> Column:
    """Quantise to ``digits`` decimals; insensitive to the last bits of float sums."""
    step = float(10**digits)
    return F.floor(value * F.lit(step) + F.lit(SNAP_SHIFT)) / F.lit(step)


def snap_sql(value: str, digits: int) -> str:
    """The same quantisation as SQL text."""
    step = f"1e{digits}"
    return f"floor(({value}) * {step} + {SNAP_SHIFT}) / {step}"


def intdiv(value, divisor) -> Column:
    """Floor division for coordinates, which are whole numbers that may be negative."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / F.lit(divisor)).cast("bigint")


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)
