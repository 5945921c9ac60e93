"""Inference on daily factor series: HAC and non-overlapping means, pooled over folds.

A daily series holds one row per session, so windows over it are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import is_finite


def _finite(value: str) -> Column:
    return F.coalesce(is_finite(F.col(value)), F.lit(False))


def _check(lags: int, stride: int, offset: int) -> None:
    if lags < 0:
        raise ValueError("lags cannot be negative")
    if stride < 1 or not 0 <= offset < stride:
        raise ValueError("require stride >= 1 and 0 <= offset < stride")


def _mean_columns(selected: Column, prefix: str) -> list[Column]:
    n, mean = F.count(selected), F.avg(selected)
    error = F.when(n > 1, F.stddev_samp(selected) / F.sqrt(n.cast("double")))
    return [
        n.alias(f"{prefix}n"),
        mean.alias(f"{prefix}mean"),
        error.alias(f"{prefix}standard_error"),
        F.when(error > 0, mean / error).alias(f"{prefix}t_stat"),
    ]


def _all_groups(values: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Groups without any finite value keep a row."""
    return values.select(*by).distinct().join(stats, list(by), "left") if by else stats


def panel_mean_inference(
    values: DataFrame,
    *,
    lags: int,
    stride: int = 1,
    offset: int = 0,
    by: Sequence[str] = (),
    fold: str = "fold_id",
    order: str = "asof_date",
    value: str = "value",
) -> DataFrame:
    """Pooled mean with HAC error; neither lag products nor strides cross a fold boundary."""
    _check(lags, stride, offset)
    finite = values.filter(_finite(value))
    series = Window.partitionBy(*by, fold).orderBy(order)
    centred = finite.withColumns(
        {
            "_x": F.col(value) - F.avg(value).over(Window.partitionBy(*by)),
            "_at": F.row_number().over(series) - 1,
            "_fold_n": F.count(F.lit(1)).over(Window.partitionBy(*by, fold)),
        }
    )
    products = centred.withColumns(
        {f"_p{k}": F.col("_x") * F.lag("_x", k).over(series) for k in range(1, lags + 1)}
    )
    on_stride = (F.col("_at") >= offset) & ((F.col("_at") - offset) % stride == 0)
    sums = products.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(value).alias("mean"),
        F.max("_fold_n").alias("_longest"),
        F.sum(F.col("_x") * F.col("_x")).alias("_p0"),
        *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_p{k}") for k in range(1, lags + 1)],
        *_mean_columns(F.when(on_stride, F.col(value)), "non_overlapping_"),
    )
    rows = _all_groups(values, sums, by).withColumn("n", F.coalesce("_n", F.lit(0)))
    n = F.col("n")
    used = F.least(F.lit(lags), F.col("_longest") - 1)
    variance = F.col("_p0")
    for k in range(1, lags + 1):
        weight = F.when(used >= k, 1 - k / (used + 1)).otherwise(0.0)
        variance = variance + 2 * weight * F.col(f"_p{k}")
    # All sums are divided by n, and the variance of the mean once more.
    error = F.when(n > 1, F.sqrt(F.greatest(variance / n, F.lit(0.0)) / n))
    kept = ["non_overlapping_mean", "non_overlapping_standard_error", "non_overlapping_t_stat"]
    return rows.withColumn("standard_error", error).select(
        *by,
        "n",
        "mean",
        "standard_error",
        F.when(F.col("standard_error") > 0, F.col("mean") / F.col("standard_error")).alias("t_stat"),
        F.when(n == 0, lags).when(n == 1, 0).otherwise(used).cast("long").alias("lags"),
        F.coalesce("non_overlapping_n", F.lit(0)).alias("non_overlapping_n"),
        *kept,
    )


def newey_west_mean(
    values: DataFrame,
    *,
    lags: int,
    by: Sequence[str] = (),
    order: str = "asof_date",
    value: str = "value",
) -> DataFrame:
    """Mean of one series per group with its Newey-West standard error."""
    single = values.withColumn("_series", F.lit(0))
    pooled = panel_mean_inference(
        single, lags=lags, by=by, fold="_series", order=order, value=value
    )
    return pooled.select(*by, "n", "mean", "standard_error", "t_stat", "lags")


def non_overlapping_mean(
    values: DataFrame,
    *,
    stride: int,
    offset: int = 0,
    by: Sequence[str] = (),
    order: str = "asof_date",
    value: str = "value",
) -> DataFrame:
    """Mean over every ``stride``-th row; non-finite values are dropped after the selection."""
    _check(0, stride, offset)
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    placed = values.withColumn("_at", at)
    on_stride = (F.col("_at") >= offset) & ((F.col("_at") - offset) % stride == 0)
    return placed.groupBy(*by).agg(
        *_mean_columns(F.when(on_stride & _finite(value), F.col(value)), "")
    )


def series_inference(
    values: DataFrame,
    *,
    lags: int,
    stride: int,
    offset: int = 0,
    by: Sequence[str] = (),
    order: str = "asof_date",
    value: str = "value",
) -> DataFrame:
    """HAC and non-overlapping inference side by side, one row per group."""
    keep = {"by": [*by, "_one"], "order": order, "value": value}
    tagged = values.withColumn("_one", F.lit(1))
    hac = newey_west_mean(tagged, lags=lags, **keep)
    plain = non_overlapping_mean(tagged, stride=stride, offset=offset, **keep)
    names = ("n", "mean", "standard_error", "t_stat")
    renamed = plain.withColumnsRenamed({c: f"non_overlapping_{c}" for c in names})
    return hac.join(renamed, [*by, "_one"]).drop("_one")
