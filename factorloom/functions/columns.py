"""Column expressions with the NULL and domain guards that ANSI mode asks for."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The seven feature channels, in table order.
CHANNELS = (
    "r_close",
    "r_gap",
    "r_intraday",
    "range",
    "dlog_volume",
    "vol20",
    "dollar_volume_z20",
)

# Ratio of the interquartile range to the standard deviation of a normal variable.
IQR_TO_SIGMA = 1.349

_INF = float("inf")


def is_finite(value: Column) -> Column:
    """TRUE/FALSE for numbers, NULL for NULL."""
    return ~F.isnan(value) & (F.abs(value) != _INF)


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def log_ratio(numerator: Column, denominator: Column) -> Column:
    """ln(numerator / denominator), NULL outside the positive domain."""
    inside = (numerator > 0) & (denominator > 0)
    return F.when(inside, F.ln(F.try_divide(numerator, denominator)))


def rank_correlation(left: Column, right: Column) -> Column:
    """Aggregate Pearson correlation of ranks.

    Sums of half-integer ranks are exact, so uncorrelated ranks give exactly zero and the
    sign of a date's rank IC never depends on summation order.
    """

    def cross(a: Column, b: Column) -> Column:
        return F.sum(a * b) - F.sum(a) * F.sum(b) / F.count(F.lit(1))

    varies = (F.max(left) > F.min(left)) & (F.max(right) > F.min(right))
    scale = F.sqrt(cross(left, left) * cross(right, right))
    return F.when(varies, F.try_divide(cross(left, right), scale))


def log_if_positive(value: Column) -> Column:
    return F.when(value > 0, F.ln(value))


def correlation(left: Column, right: Column) -> Column:
    """Aggregate Pearson correlation; NULL when a side is constant or fewer than two rows.

    The built-in ``corr`` raises on a constant side, so the quotient is guarded here.
    """
    varies = (F.max(left) > F.min(left)) & (F.max(right) > F.min(right))
    scale = F.stddev_pop(left) * F.stddev_pop(right)
    return F.when(varies, F.try_divide(F.covar_pop(left, right), scale))


def sample_key(security: str = "security_id", date: str = "trade_date") -> Column:
    return F.concat_ws("|", F.col(security), F.date_format(date, "yyyy-MM-dd"))


def seeded_draw(seed: str, *values: Column | str) -> Column:
    """A pseudo-random text that orders rows: md5 of the seed and the values, joined by bars.

    The same in every engine that has md5, on any layout.
    """
    columns = [F.col(v) if isinstance(v, str) else v for v in values]
    return F.md5(F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in columns]).cast("binary"))


def by_security(order: str = "trade_date") -> Window:
    """One security's history. Its length is bounded by the session calendar."""
    return Window.partitionBy("security_id").orderBy(order)


def trailing(length: int, order: str = "trade_date") -> Window:
    return by_security(order).rowsBetween(-(length - 1), 0)


def full_window(aggregate, value: Column, length: int) -> Column:
    """A rolling aggregate that is NULL unless all ``length`` rows are observed."""
    frame = trailing(length)
    return F.when(F.count(value).over(frame) == length, aggregate(value).over(frame))


def require_columns(frame: DataFrame, required: Iterable[str], table: str) -> DataFrame:
    missing = sorted(set(required) - set(frame.columns))
    if missing:
        raise ContractError(f"{table} is missing required columns: {missing}")
    return frame


class ContractError(ValueError):
    """An input table breaks its contract."""
