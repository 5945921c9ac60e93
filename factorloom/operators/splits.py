"""Chronological splits with purge and embargo, walk-forward folds, inner splits."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import CHANNELS, ContractError
from factorloom.functions.session import materialize
from factorloom.operators.features import apply_robust_scaler, fit_robust_scalers
from factorloom.operators.indexes import sample_index
from factorloom.operators.tabular import WINDOWS, multiscale_features


@dataclass(frozen=True)
class SplitDates:
    train_end: dt.date
    valid_end: dt.date
    test_end: dt.date
    embargo_sessions: int = 5
    fold_id: str = "base"

    def __post_init__(self):
        if not self.train_end < self.valid_end < self.test_end:
            raise ValueError("require train_end < valid_end < test_end")
        if self.embargo_sessions < 0:
            raise ValueError("embargo_sessions cannot be negative")


def _fold_structs(folds: Sequence[SplitDates]):
    return F.array(
        *[
            F.struct(
                F.lit(f.fold_id).alias("fold_id"),
                F.lit(f.train_end).alias("train_end"),
                F.lit(f.valid_end).alias("valid_end"),
                F.lit(f.test_end).alias("test_end"),
                F.lit(f.embargo_sessions).alias("embargo_sessions"),
            )
            for f in folds
        ]
    )


def session_dates(frame: DataFrame, column: str = "trade_date") -> DataFrame:
    return frame.select(F.col(column).alias("trade_date")).distinct()


def embargo_start(calendar: DataFrame, folds: Sequence[SplitDates]) -> DataFrame:
    """Per fold: the first valid and test sessions after the embargo.

    NULL where the calendar is too short. Works on distinct dates only.
    """
    rows = calendar.select("trade_date", F.explode(_fold_structs(folds)).alias("f"))

    def later_than(boundary: str):
        past = F.when(F.col("trade_date") > F.col(f"f.{boundary}"), F.col("trade_date"))
        return F.sort_array(F.collect_list(past))

    starts = rows.groupBy("f").agg(
        later_than("train_end").alias("_after_train"), later_than("valid_end").alias("_after_valid")
    )
    return starts.select(
        "f.*",
        F.get("_after_train", F.col("f.embargo_sessions")).alias("valid_start"),
        F.get("_after_valid", F.col("f.embargo_sessions")).alias("test_start"),
    )


def assign_splits(labels: DataFrame, calendar: DataFrame, *folds: SplitDates) -> DataFrame:
    """Label rows with their split per fold; NULL where purged or embargoed.

    A calendar that ends inside an embargo stops the job, as does a label that starts at or
    before its asof date.
    """
    bounds = embargo_start(calendar, folds)
    per_fold = labels.withColumn("fold_id", F.explode(F.array(*[F.lit(f.fold_id) for f in folds])))
    c = F.col
    split = (
        F.when(c("label_end") <= c("train_end"), "train")
        .when((c("asof_date") >= c("valid_start")) & (c("label_end") <= c("valid_end")), "valid")
        .when((c("asof_date") >= c("test_start")) & (c("label_end") <= c("test_end")), "test")
    )
    short = F.raise_error(F.lit("calendar does not extend beyond the split embargoes"))
    ahead = F.raise_error(F.lit("a label starts at or before its asof date"))
    checked = (
        F.when(c("valid_start").isNull() | c("test_start").isNull(), short.cast("string"))
        .when(c("asof_date") >= c("label_start"), ahead.cast("string"))
        .otherwise(split)
    )
    # One row per fold.
    joined = per_fold.join(F.broadcast(bounds), "fold_id")
    result = joined.select(*labels.columns, "fold_id", checked.alias("split"))
    return result if len(folds) > 1 else result.drop("fold_id")


def walk_forward_splits(
    labels: DataFrame, calendar: DataFrame, folds: Sequence[SplitDates]
) -> DataFrame:
    """All folds' split assignments in one table keyed by fold_id."""
    if len(folds) == 1:
        return assign_splits(labels, calendar, *folds).withColumn("fold_id", F.lit(folds[0].fold_id))
    return assign_splits(labels, calendar, *folds)


def walk_forward_scalers(
    features: DataFrame, folds: Sequence[SplitDates], channels: Sequence[str] = CHANNELS
) -> DataFrame:
    """Scaler parameters refitted on each fold's own training rows."""
    return fit_robust_scalers(features, {f.fold_id: f.train_end for f in folds}, channels)


@dataclass(frozen=True)
class FoldData:
    """What one fold trains and is judged on, built with its own scaler and split."""

    fold_id: str
    features: DataFrame
    samples: DataFrame
    tabular: DataFrame


def walk_forward_datasets(
    raw_features: DataFrame,
    labels: DataFrame,
    universe: DataFrame,
    folds: Sequence[SplitDates],
    *,
    context_length: int,
    windows: Sequence[int] = WINDOWS,
    channels: Sequence[str] = CHANNELS,
) -> list[FoldData]:
    """Features, sample index and tabular features of every fold.

    ``labels`` have no split yet. The scalers of all folds come from one pass over the raw
    features, each from rows up to its own train_end; folds are few.
    """
    scalers = materialize(walk_forward_scalers(raw_features, folds, channels), "fold-scalers")
    split = walk_forward_splits(labels, session_dates(universe), folds)
    datasets = []
    for fold in folds:
        own = scalers.filter(F.col("fold_id") == fold.fold_id)
        features = apply_robust_scaler(raw_features, own, channels)
        rows = split.filter(F.col("fold_id") == fold.fold_id).drop("fold_id")
        samples = sample_index(features, rows, universe, context_length)
        tabular = multiscale_features(
            features, samples, channels=channels, windows=windows, context_length=context_length
        )
        datasets.append(FoldData(fold.fold_id, features, samples, tabular))
    return datasets


def stack_folds(datasets: Sequence[FoldData], table: str) -> DataFrame:
    """One table of all folds, keyed by fold_id."""
    parts = [getattr(d, table).withColumn("fold_id", F.lit(d.fold_id)) for d in datasets]
    return reduce(DataFrame.unionByName, parts)


def _tail_start(sample_index: DataFrame, fraction: float, keep: int) -> DataFrame:
    """One row: number of train dates and the first date of the chronological tail."""
    dates = sample_index.filter("split = 'train'").select("asof_date").distinct()
    # Distinct dates only: bounded by the calendar.
    numbered = dates.select(
        "asof_date",
        F.row_number().over(Window.orderBy(F.desc("asof_date"))).alias("_from_end"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_dates"),
    )
    wanted = F.least(
        F.greatest(F.lit(1), F.ceil(F.col("_dates") * F.lit(float(fraction)))),
        F.col("_dates") - keep,
    )
    tail = F.when(F.col("_from_end") <= wanted, F.col("asof_date"))
    return numbered.agg(F.max("_dates").alias("dates"), F.min(tail).alias("tail_start"))


def _checked_start(sample_index: DataFrame, fraction: float, keep: int):
    start = _tail_start(sample_index, fraction, keep)
    few = F.raise_error(F.lit(f"at least {keep + 1} train dates are required")).cast("date")
    enough = F.coalesce(F.col("dates"), F.lit(0)) > keep
    return start.select(F.when(enough, F.col("tail_start")).otherwise(few)).scalar()


def inner_selection_split(sample_index: DataFrame, fraction: float) -> DataFrame:
    """Split train rows into train_fit and inner_selection; overlapping labels are purged.

    An empty part, or fit labels that reach the selection, stop the job.
    """
    if not 0 < fraction < 0.5:
        raise ValueError("fraction must satisfy 0 < fraction < 0.5")
    start = _checked_start(sample_index, fraction, 2)
    train = F.col("split") == "train"
    part = (
        F.when(train & (F.col("asof_date") >= start), "inner_selection")
        .when(train & (F.col("label_end") < start), "train_fit")
        .when(~train, F.col("split"))
    )
    protocol = sample_index.withColumn("split", part).filter("split IS NOT NULL")
    audit = inner_selection_audit(sample_index, protocol).first()
    if not audit["fit_rows"] or not audit["selection_rows"]:
        raise ContractError("the inner split leaves an empty fit or selection part")
    if not audit["disjoint"]:
        raise ContractError("fit labels reach into the inner selection")
    return protocol


def inner_selection_audit(sample_index: DataFrame, protocol: DataFrame) -> DataFrame:
    """One row: row counts, date ranges and whether fit labels end before the selection."""
    before = sample_index.agg(
        F.count_if(F.col("split") == "train").alias("official_train_rows")
    ).scalar()
    after = protocol.agg(
        F.count_if(F.col("split") == "train_fit").alias("fit_rows"),
        F.count_if(F.col("split") == "inner_selection").alias("selection_rows"),
        *_range("train_fit", "fit"),
        F.max(F.when(F.col("split") == "train_fit", F.col("label_end"))).alias("fit_max_label_end"),
        *_range("inner_selection", "selection"),
        F.count_if(F.col("split") == "valid").alias("outer_validation_rows"),
        F.count_if(F.col("split") == "test").alias("outer_test_rows"),
    )
    return after.withColumn("official_train_rows", before).withColumns(
        {
            "purged_rows": F.col("official_train_rows") - F.col("fit_rows") - F.col("selection_rows"),
            "disjoint": F.col("fit_max_label_end") < F.col("selection_min_asof_date"),
        }
    )


def _range(split: str, prefix: str):
    dates = F.when(F.col("split") == split, F.col("asof_date"))
    return [
        F.min(dates).alias(f"{prefix}_min_asof_date"),
        F.max(dates).alias(f"{prefix}_max_asof_date"),
    ]


def pretraining_split(sample_index: DataFrame, fraction: float) -> DataFrame:
    """Train rows only: the last dates become pretrain_selection, the others pretrain_train.

    An empty part, or a selection that reaches valid or test dates, stops the job.
    """
    start = _checked_start(sample_index, fraction, 1)
    protocol = sample_index.filter("split = 'train'").withColumn(
        "split",
        F.when(F.col("asof_date") >= start, "pretrain_selection").otherwise("pretrain_train"),
    )
    audit = pretraining_audit(sample_index, protocol).first()
    if not audit["pretrain_rows"] or not audit["selection_rows"]:
        raise ContractError("the pretraining split leaves an empty part")
    if not audit["disjoint"]:
        raise ContractError("the pretraining selection reaches the formal valid or test part")
    return protocol


def pretraining_audit(sample_index: DataFrame, protocol: DataFrame) -> DataFrame:
    """One row: counts, date ranges, and whether the selection precedes valid and test."""
    formal = sample_index.agg(
        F.struct(
            F.count_if(F.col("split") == "train").alias("rows"),
            F.min(F.when(F.col("split") == "valid", F.col("asof_date"))).alias("valid_start"),
            F.min(F.when(F.col("split") == "test", F.col("asof_date"))).alias("test_start"),
        ).alias("formal")
    ).scalar()
    parts = protocol.agg(
        F.count_if(F.col("split") == "pretrain_train").alias("pretrain_rows"),
        F.count_if(F.col("split") == "pretrain_selection").alias("selection_rows"),
        *_range("pretrain_train", "pretrain"),
        *_range("pretrain_selection", "selection"),
    ).withColumn("_f", formal)
    last = F.col("selection_max_asof_date")
    return parts.select(
        F.col("_f.rows").alias("official_train_rows"),
        "pretrain_rows",
        "selection_rows",
        "pretrain_min_asof_date",
        "pretrain_max_asof_date",
        "selection_min_asof_date",
        "selection_max_asof_date",
        F.col("_f.valid_start").alias("formal_valid_min_asof_date"),
        F.col("_f.test_start").alias("formal_test_min_asof_date"),
        (
            F.coalesce(last < F.col("_f.valid_start"), F.lit(True))
            & F.coalesce(last < F.col("_f.test_start"), F.lit(True))
        ).alias("disjoint"),
    )
