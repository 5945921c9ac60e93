"""Cross-sectional neutralisation of scores for industry and size.

The least-squares residual on intercept, industry dummies and log-cap has a closed form:
demean score and cap within (date, industry), regress one on the other per date. Only
sums are needed, so the work is map-side-combined aggregates and one join back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import is_finite
from factorloom.functions.session import materialize

# Quality labels of a date.
MISSING = "unavailable_missing_point_in_time_exposures"
INSUFFICIENT = "unavailable_insufficient_cross_section"
AVAILABLE = "industry_and_log_market_cap"

MIN_ROWS = 3
MIN_RANK_SHARE = 1e-12

CAP = "log_float_market_cap"
INDUSTRY = "industry_code"


def _complete():
    return F.col(INDUSTRY).isNotNull() & F.coalesce(is_finite(F.col(CAP)), F.lit(False))


def _industry_terms(predictions: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """One row per date and industry: means, and the date's slope and quality."""
    date = [*by, "asof_date"]
    c = F.col
    industries = predictions.filter(_complete()).groupBy(*date, INDUSTRY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(score).alias("_score_mean"),
        F.avg(CAP).alias("_cap_mean"),
        (F.var_pop(CAP) * F.count(F.lit(1))).alias("_cap_within"),
        (F.covar_pop(CAP, score) * F.count(F.lit(1))).alias("_cross_within"),
        F.min(CAP).alias("_cap_min"),
        F.max(CAP).alias("_cap_max"),
    )
    # From here on one row per date and industry.
    whole = Window.partitionBy(*date)
    centre = F.try_divide(F.sum(c("_n") * c("_cap_mean")).over(whole), F.sum("_n").over(whole))
    shifted = industries.withColumn("_off_centre", c("_cap_mean") - centre)
    total = c("_cap_within") + c("_n") * c("_off_centre") * c("_off_centre")
    dated = shifted.select(
        *date,
        INDUSTRY,
        "_score_mean",
        "_cap_mean",
        F.sum("_n").over(whole).alias("_rows"),
        F.count(F.lit(1)).over(whole).alias("_industries"),
        F.sum("_cap_within").over(whole).alias("_within"),
        F.sum("_cross_within").over(whole).alias("_cross"),
        F.sum(total).over(whole).alias("_total"),
        (F.max("_cap_max").over(whole) > F.min("_cap_min").over(whole)).alias("_varies"),
    )
    width = c("_industries") + c("_varies").cast("int")
    full_rank = ~c("_varies") | (c("_within") > MIN_RANK_SHARE * c("_total"))
    quality = (
        F.when(c("_rows") < MIN_ROWS, MISSING)
        .when((c("_rows") <= width) | ~full_rank, INSUFFICIENT)
        .otherwise(AVAILABLE)
    )
    slope = F.when(c("_varies"), F.try_divide(c("_cross"), c("_within"))).otherwise(0.0)
    # Stored: its true size then decides between a broadcast and a skew-split shuffle join.
    return materialize(
        dated.select(
            *date,
            INDUSTRY,
            "_score_mean",
            "_cap_mean",
            slope.alias("_slope"),
            quality.alias("quality"),
        ),
        "industry-terms",
    )


def neutralize(
    predictions: DataFrame, by: Sequence[str] = (), score: str = "score_raw"
) -> DataFrame:
    """Add ``score_neutralized``; rows without exposures or on unfit dates stay NULL."""
    date = [*by, "asof_date"]
    terms = _industry_terms(predictions, by, score)
    residual = (F.col(score) - F.col("_score_mean")) - F.col("_slope") * (
        F.col(CAP) - F.col("_cap_mean")
    )
    usable = _complete() & (F.col("quality") == AVAILABLE)
    return (
        predictions.drop("score_neutralized")
        .join(terms, [*date, INDUSTRY], "left")
        .withColumn("score_neutralized", F.when(usable, residual))
        .drop("_score_mean", "_cap_mean", "_slope", "quality")
    )


def neutralization_quality(
    predictions: DataFrame, by: Sequence[str] = (), score: str = "score_raw"
) -> DataFrame:
    """Quality label of every date."""
    date = [*by, "asof_date"]
    rated = _industry_terms(predictions, by, score).groupBy(*date).agg(
        F.max("quality").alias("quality")
    )
    return (
        predictions.select(*date)
        .distinct()
        .join(rated, date, "left")
        .withColumn("quality", F.coalesce("quality", F.lit(MISSING)))
    )


def neutralization_audit(neutralized: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Dates per quality label, with rows and rows that received a neutralised score."""
    date = [*by, "asof_date"]
    rows = neutralized.groupBy(*date).agg(
        F.count(F.lit(1)).alias("_rows"), F.count("score_neutralized").alias("_available")
    )
    return (
        neutralization_quality(neutralized, by)
        .join(rows, date)
        .groupBy("quality")
        .agg(
            F.count(F.lit(1)).alias("dates"),
            F.sum("_rows").alias("rows"),
            F.sum("_available").alias("available_rows"),
        )
    )
