"""The seven price/volume channels and their train-only robust scaling."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import (
    CHANNELS,
    IQR_TO_SIGMA,
    ContractError,
    by_security,
    finite_or_null,
    full_window,
    log_ratio,
    trailing,
)
from factorloom.functions.quantiles import order_statistics
from factorloom.operators.quality import one_per_key

MIN_SCALE = 1e-12


def feature_panel(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """The universe grid with adjusted prices; sessions without a bar stay as NULL rows.

    One bar and one state of a security and session: a repeated key on either side stops the job.
    """
    prices = bars.select(
        "security_id",
        "trade_date",
        *[(F.col(p) * F.col("adj_factor")).alias(f"adj_{p}") for p in ("open", "high", "low", "close")],
        "volume",
        "dollar_volume",
    )
    grid = universe.select("security_id", "symbol", "trade_date")
    # Both sides are laid out by security, which the join and all later windows share.
    keys = ["security_id", "trade_date"]
    bars_once = one_per_key(prices.repartition("security_id"), keys, "bars")
    return one_per_key(grid.repartition("security_id"), keys, "universe").join(bars_once, keys, "left")


def with_returns(panel: DataFrame) -> DataFrame:
    """r_close, r_gap, r_intraday, range and dlog_volume, against the previous grid row."""
    c = F.col
    lagged = panel.withColumns(
        {
            "_previous_close": F.lag("adj_close").over(by_security()),
            "_log_volume": F.log1p("volume"),
            "_previous_log_volume": F.lag(F.log1p("volume")).over(by_security()),
        }
    )
    return lagged.withColumns(
        {
            "r_close": log_ratio(c("adj_close"), c("_previous_close")),
            "r_gap": log_ratio(c("adj_open"), c("_previous_close")),
            "r_intraday": log_ratio(c("adj_close"), c("adj_open")),
            "range": log_ratio(c("adj_high"), c("adj_low")),
            "dlog_volume": c("_log_volume") - c("_previous_log_volume"),
        }
    ).drop("_previous_close", "_log_volume", "_previous_log_volume")


def with_dollar_volume_z(
    panel: DataFrame, sessions: int = 20, interpolation: str = "nearest"
) -> DataFrame:
    """Robust z-score of dollar volume over a full trailing window.

    The quartiles take the nearest sorted element by default, or are interpolated.
    """
    frame = trailing(sessions)
    value = F.col("dollar_volume")
    full = F.count(value).over(frame) == sessions
    if interpolation == "linear":
        listed = panel.withColumn("_q", F.percentile(value, [0.25, 0.5, 0.75]).over(frame))
        q25, median, q75 = (F.col("_q")[i] for i in range(3))
    else:
        listed = panel.withColumn("_w", F.collect_list(value).over(frame)).withColumn(
            "_q", F.when(F.size("_w") == sessions, F.sort_array("_w"))
        )
        middle = [(sessions - 1) // 2, sessions // 2]
        median = (F.get("_q", F.lit(middle[0])) + F.get("_q", F.lit(middle[1]))) / 2
        q25, q75 = (F.get("_q", F.lit(round((sessions - 1) * q))) for q in (0.25, 0.75))
    score = F.try_divide((value - median) * IQR_TO_SIGMA, q75 - q25)
    return listed.withColumn("dollar_volume_z20", F.when(full, score)).drop("_w", "_q")


def with_volatility(panel: DataFrame, sessions: int = 20) -> DataFrame:
    return panel.withColumn("vol20", full_window(F.stddev_pop, F.col("r_close"), sessions))


def observed_mask(panel: DataFrame, channels: Sequence[str] = CHANNELS) -> DataFrame:
    """Non-finite values become NULL; a flag per channel records presence."""
    finite = panel.withColumns({c: finite_or_null(F.col(c)) for c in channels})
    return finite.withColumns({f"observed_{c}": F.col(c).isNotNull() for c in channels})


def build_features(
    bars: DataFrame, universe: DataFrame, interpolation: str = "nearest"
) -> DataFrame:
    panel = with_returns(feature_panel(bars, universe))
    panel = with_volatility(with_dollar_volume_z(panel, interpolation=interpolation))
    return observed_mask(panel).select(
        "security_id",
        "symbol",
        "trade_date",
        *CHANNELS,
        *[f"observed_{c}" for c in CHANNELS],
    )


def fit_robust_scaler(
    features: DataFrame,
    train_end: dt.date,
    channels: Sequence[str] = CHANNELS,
    winsor_lower: float = 0.005,
    winsor_upper: float = 0.995,
) -> DataFrame:
    """One row per channel, from rows up to ``train_end`` only.

    Clipping keeps the order of values, so the quartiles of the clipped values come from the
    clipped order statistics of the raw ones: one selection serves all five quantiles.
    """
    training = features.filter(F.col("trade_date") <= F.lit(train_end))
    return _robust_parameters(training, (), channels, winsor_lower, winsor_upper)


def fit_robust_scalers(
    features: DataFrame,
    train_ends: dict[str, dt.date],
    channels: Sequence[str] = CHANNELS,
    winsor_lower: float = 0.005,
    winsor_upper: float = 0.995,
) -> DataFrame:
    """The same parameters per fold_id, all folds in one pass over the features."""
    ends = F.array(
        *[
            F.struct(F.lit(fold).alias("fold_id"), F.lit(end).alias("train_end"))
            for fold, end in train_ends.items()
        ]
    )
    inside = F.filter(ends, lambda f: F.col("trade_date") <= f["train_end"])
    training = features.withColumn("_fold", F.explode(inside)).withColumn(
        "fold_id", F.col("_fold.fold_id")
    )
    return _robust_parameters(training, ("fold_id",), channels, winsor_lower, winsor_upper)


def _robust_parameters(
    training: DataFrame,
    by: Sequence[str],
    channels: Sequence[str],
    winsor_lower: float,
    winsor_upper: float,
) -> DataFrame:
    if not 0 <= winsor_lower < winsor_upper <= 1:
        raise ValueError("winsor quantiles must satisfy 0 <= lower < upper <= 1")
    group = [*by, "channel"]
    long = training.unpivot(list(by), list(channels), "channel", "value")
    names = {"lower": winsor_lower, "q25": 0.25, "median": 0.5, "q75": 0.75, "upper": winsor_upper}
    stats = order_statistics(long, group, "value", sorted(set(names.values())))

    def pick(probability: float):
        row = F.when(F.col("probability") == probability, F.struct("low", "high", "fraction"))
        return F.max(row)

    wide = stats.groupBy(*group).agg(
        F.first("n").alias("train_observations"), *[pick(p).alias(k) for k, p in names.items()]
    )

    def between(low, high, fraction):
        return low + fraction * (high - low)

    def raw(name: str):
        return between(*[F.col(f"{name}.{part}") for part in ("low", "high", "fraction")])

    bounds = wide.withColumns(
        {"winsor_lower_value": raw("lower"), "winsor_upper_value": raw("upper")}
    )

    def clipped(name: str):
        low, high = (
            F.least(F.greatest(F.col(f"{name}.{p}"), "winsor_lower_value"), "winsor_upper_value")
            for p in ("low", "high")
        )
        return between(low, high, F.col(f"{name}.fraction"))

    scale = (clipped("q75") - clipped("q25")) / IQR_TO_SIGMA
    return bounds.select(
        *group,
        "winsor_lower_value",
        "winsor_upper_value",
        clipped("median").alias("median"),
        F.when(scale > MIN_SCALE, scale).otherwise(1.0).alias("scale"),
        "train_observations",
    )


def apply_robust_scaler(
    features: DataFrame, parameters: DataFrame, channels: Sequence[str] = CHANNELS
) -> DataFrame:
    """(clip(x) - median) / scale per channel; NULL stays NULL.

    The parameters (one row per channel) enter the plan as constants.
    """
    fitted = {row["channel"]: row for row in parameters.collect()}
    missing = [c for c in channels if c not in fitted]
    if missing:
        raise ContractError(f"no training observations for channels {missing}")

    def scaled(channel: str):
        p = fitted[channel]
        value = F.col(channel)
        clip = F.least(
            F.greatest(value, F.lit(p["winsor_lower_value"])), F.lit(p["winsor_upper_value"])
        )
        # greatest and least skip NULL, so a missing value must not reach them.
        return F.when(value.isNotNull(), (clip - p["median"]) / p["scale"])

    return features.withColumns({c: scaled(c) for c in channels})
