"""Multiscale rolling features per sample and their standardisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import CHANNELS, is_finite
from factorloom.functions.rolling import STATISTICS, rolling_name, with_rolling

# Default statistics windows, in sessions.
WINDOWS = (5, 20, 60, 120, 252)
MIN_SCALE = 1e-12


def multiscale_columns(
    channels: Sequence[str], windows: Sequence[int], context_length: int
) -> list[str]:
    usable = [w for w in windows if w <= context_length]
    if not usable:
        raise ValueError("at least one window must fit within the context length")
    return [
        name
        for c in channels
        for name in [
            f"{c}__last",
            *[rolling_name(c, stat, w) for w in usable for stat in STATISTICS],
        ]
    ]


def multiscale_features(
    features: DataFrame,
    index: DataFrame,
    *,
    channels: Sequence[str] = CHANNELS,
    windows: Sequence[int] = WINDOWS,
    context_length: int,
) -> DataFrame:
    """Last value and rolling mean, deviation, minimum and maximum per channel and window.

    The narrow index is joined first: the wide result of the windows is never exchanged,
    and all windows share one layout and one sort by security and date. The rows keep the
    session's number of shuffle partitions: merged by their narrow size, they would widen in a
    few tasks.
    """
    columns = multiscale_columns(channels, windows, context_length)
    usable = [w for w in windows if w <= context_length]
    carried = [
        c
        for c in ("sample_id", "symbol", "split", "target")
        if c in index.columns
    ]
    marks = index.select("security_id", F.col("asof_date").alias("trade_date"), *carried)
    parts = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        features.select("security_id", "trade_date", *channels)
        .repartition(parts, "security_id")
        .join(marks.repartition(parts, "security_id"), ["security_id", "trade_date"], "left")
    )
    rolled = with_rolling(rows, channels, usable).filter("sample_id IS NOT NULL")
    return rolled.withColumnsRenamed({c: f"{c}__last" for c in channels}).select(
        "security_id", F.col("trade_date").alias("asof_date"), *carried, *columns
    )


def multiscale_inference_features(
    features: DataFrame,
    inference_index: DataFrame,
    *,
    channels: Sequence[str] = CHANNELS,
    windows: Sequence[int] = WINDOWS,
    context_length: int,
) -> DataFrame:
    """The same statistics on the target-free index."""
    plain = inference_index.select("sample_id", "security_id", "symbol", "asof_date")
    return multiscale_features(
        features, plain, channels=channels, windows=windows, context_length=context_length
    )


def fit_tabular_preprocessor(tabular: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: mean and population deviation over finite values."""

    # Long form keeps the generated code small however many columns there are.
    long = tabular.unpivot([], list(columns), "feature", "value")
    finite = F.when(is_finite(F.col("value")), F.col("value"))
    fits = long.groupBy("feature").agg(
        F.avg(finite).alias("_mean"), F.stddev_pop(finite).alias("_deviation")
    )
    return fits.select(
        "feature",
        F.coalesce("_mean", F.lit(0.0)).alias("mean"),
        F.when(F.col("_deviation") > MIN_SCALE, F.col("_deviation")).otherwise(1.0).alias("scale"),
    )


def transform_tabular(tabular: DataFrame, parameters: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standardise, fill missing values with zero, append the presence of each column.

    The parameters (one row per column) enter the plan as constants. Adds ``vector``, an
    array twice as wide as the columns.
    """
    fitted = {row["feature"]: row for row in parameters.collect()}

    def present(name: str) -> Column:
        return F.coalesce(is_finite(F.col(name)), F.lit(False))

    def standard(name: str) -> Column:
        p = fitted[name]
        return F.when(present(name), (F.col(name) - p["mean"]) / p["scale"]).otherwise(0.0)

    vector = [standard(c).cast("float") for c in columns]
    vector += [present(c).cast("float") for c in columns]
    return tabular.withColumn("vector", F.array(*vector))
