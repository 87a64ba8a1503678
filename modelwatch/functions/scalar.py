"""Scalar column expressions. All are built-in Spark expressions (codegen, no Python UDF).

Spark 4 runs in ANSI mode, so divisions use ``try_divide`` and casts ``try_cast``;
``greatest`` / ``least`` skip NULLs, so clips are guarded to keep NULL as NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reference.
LOG_LOSS_EPS = 1e-15      # probability clip for log loss
RANGE_LIMIT = 1e6         # sanity range for lab values, both ends open
ROUND_DIGITS = 6          # reported metrics are rounded to 6 places


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_double(c) -> Column:
    """Cast to double and map NaN to NULL, so NULL is the only missing marker."""
    x = col(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def is_finite(c) -> Column:
    """True for non-null, non-NaN, non-infinite values."""
    x = col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def numeric_coerce(c) -> Column:
    """``to_numeric(errors="coerce")``: anything unparsable becomes NULL."""
    return F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double")


def in_open_range(c, lo: float = -RANGE_LIMIT, hi: float = RANGE_LIMIT) -> Column:
    x = col(c)
    return (x > F.lit(lo)) & (x < F.lit(hi))


def guarded_clip(c, lo, hi) -> Column:
    """Clip to [lo, hi]; NULL stays NULL (greatest/least would turn it into a bound)."""
    x = col(c)
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo_c), hi_c))


def round6(c) -> Column:
    return F.round(col(c), ROUND_DIGITS)


def derive_label(lactate_col: str | None = "lactate", threshold: float = 2.0) -> Column:
    """Demo label rule: ``coalesce(lactate, 0) >= 2.0`` as 0/1 (0 when the column is absent)."""
    if lactate_col is None:
        return F.lit(0)
    return F.when(F.coalesce(F.col(lactate_col).cast("double"), F.lit(0.0)) >= threshold, 1).otherwise(0)


def np_lerp(a, b, t) -> Column:
    """NumPy's linear interpolation between a and b (the form used by ``np.percentile``)."""
    a, b, t = col(a), col(b), col(t)
    diff = b - a
    return F.when(t >= 0.5, b - diff * (F.lit(1.0) - t)).otherwise(a + diff * t)
