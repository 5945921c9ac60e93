"""Deterministic batch plans: every sample gets a batch number per seed and epoch."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import seeded_draw
from factorloom.functions.ranking import with_position


def _shuffle_key(seed: int, epoch: int, column: str) -> Column:
    return seeded_draw(f"{seed}:{epoch}", column)


def sequence_batches(
    index: DataFrame,
    *,
    batch_size: int,
    seed: int,
    epoch: int = 0,
    shuffle: bool = True,
    drop_last: bool = False,
) -> DataFrame:
    """Fixed-size batches over one seeded order of all samples."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    order = ["asof_date", "security_id"]
    if shuffle:
        order = [_shuffle_key(seed, epoch, "sample_id"), "sample_id"]
    placed = with_position(index, "_position", order, size="_size")
    batch = F.floor((F.col("_position") - 1) / batch_size)
    result = placed.withColumn("batch_id", batch.cast("long"))
    if drop_last:
        result = result.filter((F.col("batch_id") + 1) * batch_size <= F.col("_size"))
    return result.drop("_position", "_size")


def date_grouped_batches(
    index: DataFrame,
    *,
    batch_size: int,
    seed: int,
    epoch: int = 0,
    shuffle: bool = True,
    drop_last: bool = False,
) -> DataFrame:
    """Batches that keep a date's cross-section together whenever it fits.

    Dates are taken in a seeded order; a date above ``batch_size`` is cut into chunks; a
    chunk that does not fit into the open batch starts the next one.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    sizes = index.groupBy("asof_date").agg(F.count(F.lit(1)).alias("rows"))
    position = _shuffle_key(seed, epoch, "asof_date") if shuffle else F.lit("")
    dates = sizes.withColumns({"_order": position, "_all": F.lit(1)})

    def pack(table: pd.DataFrame) -> pd.DataFrame:
        batch, filled, first, last = 0, 0, [], []
        for rows in table.sort_values(["_order", "asof_date"])["rows"]:
            whole, rest = divmod(rows, batch_size)
            if whole and filled:
                batch, filled = batch + 1, 0
            first.append(batch)
            batch += whole
            if rest and filled + rest > batch_size:
                batch, filled = batch + 1, 0
            last.append(batch)
            filled += rest
            if filled == batch_size:
                batch, filled = batch + 1, 0
        plan = table.sort_values(["_order", "asof_date"])[["asof_date", "rows"]]
        open_batch = batch if filled else -1
        return plan.assign(first_batch=first, last_batch=last, open_batch=open_batch)

    # One row per date: the packing order is sequential, its table bounded by the calendar.
    plan = dates.groupBy("_all").applyInPandas(
        pack, "asof_date date, rows long, first_batch long, last_batch long, open_batch long"
    )
    order = [_shuffle_key(seed, epoch, "sample_id"), "sample_id"] if shuffle else ["security_id"]
    placed = with_position(index, "_position", order, ["asof_date"])
    chunk = F.floor((F.col("_position") - 1) / batch_size)
    batch = F.when(
        chunk < F.floor(F.col("rows") / batch_size), F.col("first_batch") + chunk
    ).otherwise(F.col("last_batch"))
    result = placed.join(F.broadcast(plan), "asof_date").withColumn("batch_id", batch.cast("long"))
    if drop_last:
        result = result.filter(F.col("batch_id") != F.col("open_batch"))
    return result.drop("_position", "rows", "first_batch", "last_batch", "open_batch")
