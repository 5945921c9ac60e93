"""Sample, inference and metadata indexes: window bounds, never window contents."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import by_security, log_if_positive, sample_key
from factorloom.operators.quality import checked_join, require_unique
from factorloom.sources.tables import INFERENCE_INDEX, SAMPLE_INDEX


def window_bounds(features: DataFrame, context_length: int) -> DataFrame:
    """Per grid row: first and last date of the window of ``context_length`` rows ending there."""
    if context_length < 1:
        raise ValueError("context_length must be positive")
    return features.select(
        "security_id",
        "trade_date",
        F.lag("trade_date", context_length - 1).over(by_security()).alias("feature_start"),
        F.col("trade_date").alias("feature_end"),
    )


def sample_index(
    features: DataFrame, labels_with_split: DataFrame, universe: DataFrame, context_length: int
) -> DataFrame:
    """Eligible rows with a full window, a target and a split; one label and one state each."""
    keys = ["security_id", "trade_date"]
    require_unique(labels_with_split, ["security_id", "asof_date"], "labels")
    require_unique(universe, keys, "universe")
    labels = labels_with_split.filter(
        "target IS NOT NULL AND split IS NOT NULL"
    ).withColumnRenamed("asof_date", "trade_date")
    listed = universe.filter("eligible").select(*keys, "symbol")
    # All three sides are laid out by security once; bounds need every grid row.
    return (
        window_bounds(features, context_length)
        .filter("feature_start IS NOT NULL")
        .join(labels.repartition("security_id"), keys)
        .join(listed.repartition("security_id"), keys)
        .withColumns({"sample_id": sample_key(), "asof_date": F.col("trade_date")})
        .select(*SAMPLE_INDEX.fieldNames())
    )


def inference_index(features: DataFrame, universe: DataFrame, context_length: int) -> DataFrame:
    """Every eligible row with a full window; free of label columns."""
    keys = ["security_id", "trade_date"]
    listed = universe.filter("eligible").select(
        *keys, "symbol", "eligible", "industry_code", "float_market_cap"
    )
    return (
        window_bounds(features, context_length)
        .filter("feature_start IS NOT NULL")
        .join(listed.repartition("security_id"), keys)
        .withColumns(
            {
                "sample_id": sample_key(),
                "asof_date": F.col("trade_date"),
                "log_float_market_cap": log_if_positive(F.col("float_market_cap")),
            }
        )
        .select(*INFERENCE_INDEX.fieldNames())
    )


def sample_metadata(index: DataFrame, universe: DataFrame) -> DataFrame:
    """Point-in-time exposures of each sample; a repeated state of a session stops the job."""
    exposures = universe.select(
        "security_id",
        F.col("trade_date").alias("asof_date"),
        "eligible",
        "industry_code",
        "float_market_cap",
    )
    rows = index.select("sample_id", "security_id", "symbol", "asof_date", "split")
    keys = ["security_id", "asof_date"]
    return (
        checked_join(rows, exposures, keys, "m:1", "left", ("index", "universe"))
        .select("security_id", "asof_date", "sample_id", "symbol", "split", "eligible", "industry_code",
                "float_market_cap")
        .withColumn("log_float_market_cap", log_if_positive(F.col("float_market_cap")))
    )


def select_asof(
    index: DataFrame,
    asof: str | dt.date | None = "latest",
    start: dt.date | None = None,
    end: dt.date | None = None,
    *,
    check: bool = True,
) -> DataFrame:
    """Rows of the latest date, of one date, or of a closed range."""
    if asof is not None and (start is not None or end is not None):
        raise ValueError("asof cannot be combined with start or end")
    if asof == "latest":
        latest = index.agg(F.max("asof_date")).scalar()
        selected = index.filter(F.col("asof_date") == latest)
    elif asof is not None:
        day = dt.date.fromisoformat(asof) if isinstance(asof, str) else asof
        selected = index.filter(F.col("asof_date") == F.lit(day))
    else:
        selected = index
        if start is not None:
            selected = selected.filter(F.col("asof_date") >= F.lit(start))
        if end is not None:
            selected = selected.filter(F.col("asof_date") <= F.lit(end))
    if check and selected.isEmpty():
        raise ValueError("the date selection contains no eligible rows")
    return selected
