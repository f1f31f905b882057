"""Guarded arithmetic on columns.

Spark raises on a zero divisor in ANSI mode, also inside ``corr``.  Everything
here returns NULL instead when a value is undefined.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(as_col(a), as_col(b))


def tidy(x: Column | str, places: int = 6) -> Column:
    """Round away summation noise; adding zero turns -0.0 into 0.0.

    ``rint`` works on the binary value with halves to even.  ``F.round`` would
    go through the printed digits of every value, which is many times slower.
    """
    unit = F.lit(10.0**places)
    return F.rint(as_col(x) * unit) / unit + F.lit(0.0)


PLACES = 2
NOISE_BELOW = 2.0**43  # last places; up to there noise stays below a hundredth of one


def as_whole(x: Column | str, places: int = PLACES) -> Column:
    """An amount of at most ``places`` decimal places as a whole number of its last place.

    Sums of whole numbers are the same in any order.  A value with more places
    than declared is an error, not rounded away; NaN counts as NULL.  Noise in
    the last digits is allowed for as long as it is small beside the last place;
    a larger amount must be the very double that stands for a number of so many
    places.
    """
    scaled = known(x) * F.lit(10.0**places)
    whole = F.rint(scaled)
    noise = F.abs(scaled - whole) <= F.lit(1e-9) + F.abs(scaled) * F.lit(1e-15)
    fits = F.when(F.abs(scaled) < F.lit(NOISE_BELOW), noise).otherwise(whole / F.lit(10.0**places) == as_col(x))
    wrong = F.raise_error(F.concat(F.lit(f"more than {places} decimal places: "), as_col(x).cast("string")))
    return F.when(scaled.isNull() | fits, whole).otherwise(wrong.cast("double")).cast("long")


def from_whole(total: Column | str, places: int = PLACES) -> Column:
    return as_col(total) / F.lit(10.0**places)


def exact_sum(x: Column | str, places: int = PLACES) -> Column:
    """Sum of amounts of at most ``places`` decimal places: exact, and the same for every partitioning."""
    return from_whole(F.sum(as_whole(x, places)), places)


def known(x: Column | str) -> Column:
    """The value, NULL if it is NaN."""
    x = as_col(x)
    return F.when(~F.isnan(x), x)


def paired(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Both columns, NULL wherever either one is NULL or NaN."""
    a, b = known(a), known(b)
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def _over(agg: Column, window: WindowSpec | None) -> Column:
    return agg if window is None else agg.over(window)


def varies(x: Column, window: WindowSpec | None = None) -> Column:
    return _over(F.max(x), window) > _over(F.min(x), window)


def correlation(a: Column | str, b: Column | str, window: WindowSpec | None = None) -> Column:
    """Pearson correlation of the complete pairs; NULL where a side is constant."""
    x, y = paired(a, b)
    value = ratio(
        _over(F.covar_pop(x, y), window),
        _over(F.stddev_pop(x), window) * _over(F.stddev_pop(y), window),
    )
    return F.when(varies(x, window) & varies(y, window), value)


def slope(y: Column | str, x: Column | str, window: WindowSpec | None = None) -> Column:
    """Least-squares slope of ``y`` on ``x``; NULL where ``x`` is constant."""
    a, b = paired(x, y)
    value = ratio(_over(F.covar_pop(a, b), window), _over(F.var_pop(a), window))
    return F.when(varies(a, window), value)


def two_sided_p(t: Column | str) -> Column:
    """Two-sided p value under the normal law, to about 1e-7.

    Error-function approximation 7.1.26 of Abramowitz and Stegun.
    """
    # Fixed values of the published approximation.
    p = 0.3275911
    a1, a2, a3, a4, a5 = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429
    z = F.abs(as_col(t)) / F.sqrt(F.lit(2.0))
    u = F.lit(1.0) / (F.lit(1.0) + F.lit(p) * z)
    poly = u * (a1 + u * (a2 + u * (a3 + u * (a4 + u * F.lit(a5)))))
    return poly * F.exp(-z * z)
