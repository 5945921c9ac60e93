"""Fixed-length context windows, their patches, and the masked reconstruction loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import CHANNELS, by_security, is_finite, seeded_draw
from factorloom.functions.session import materialize


def pack_series(
    features: DataFrame,
    *,
    context_length: int,
    channels: Sequence[str] = CHANNELS,
    chunk_length: int | None = None,
) -> DataFrame:
    """The grid as a store of series: one row per security and chunk of its sessions.

    A row holds ``dates``, ``values`` and ``observed_mask`` in step order: ``home`` steps carried
    over from before, then the chunk's own (four contexts of them unless ``chunk_length`` is given).
    Every window of up to ``context_length`` rows that ends in a chunk lies inside its row, so a
    sample is cut out by its offset. Rows are bounded by the lengths, the store is the grid once
    and a quarter. Unobserved values are 0; keys of ``features`` are unique.
    """
    if context_length < 1:
        raise ValueError("context_length must be positive")
    size, overlap = chunk_length or 4 * context_length, context_length - 1
    if size < max(1, overlap):
        raise ValueError("a chunk must hold at least context_length - 1 rows")

    def observed(channel: str) -> Column:
        seen = F.coalesce(is_finite(F.col(channel).cast("float")), F.lit(False))
        flag = f"observed_{channel}"
        return seen & F.col(flag) if flag in features.columns else seen

    place = F.row_number().over(by_security()) - 1
    steps = features.select(
        "security_id",
        F.col("trade_date").alias("date"),
        place.alias("place"),
        F.array(
            *[F.when(observed(c), F.col(c).cast("float")).otherwise(F.lit(0.0).cast("float")) for c in channels]
        ).alias("values"),
        F.array(*[observed(c) for c in channels]).alias("mask"),
    )
    home = F.floor(F.col("place") / size).cast("int")
    carried = F.col("place") % size >= size - overlap
    dealt = steps.withColumn("chunk", F.explode(F.when(carried, F.array(home, home + 1)).otherwise(F.array(home))))
    packed = dealt.groupBy("security_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("place", "date", "values", "mask"))).alias("steps")
    )
    return packed.select(
        "security_id",
        "chunk",
        (F.col("chunk") * size - F.get("steps", F.lit(0))["place"]).alias("home"),
        F.col("steps.date").alias("dates"),
        F.col("steps.values").alias("values"),
        F.col("steps.mask").alias("observed_mask"),
    ).filter(F.size("dates") > F.col("home"))


def cut_windows(
    packed: DataFrame, index: DataFrame, *, context_length: int, split: str | None = None
) -> DataFrame:
    """Per sample of ``index`` its window out of the packed series; arrays for samples only.

    Samples find chunk and offset by security and date, in a narrow join; each is then cut from
    its chunk's arrays. A sample without a full window that starts at ``feature_start`` stops the
    job.
    """
    rows = index if split is None else index.filter(F.col("split") == split)
    carried = [c for c in ("sample_id", "feature_start", "target") if c in rows.columns]
    marks = rows.select("security_id", "asof_date", *carried)
    places = packed.select("security_id", "chunk", "home", F.posexplode("dates").alias("_at", "asof_date")).filter(
        F.col("_at") >= F.col("home")
    )
    placed = marks.join(places.drop("home"), ["security_id", "asof_date"], "left")
    met = placed.join(packed.drop("home"), ["security_id", "chunk"], "left")
    first = F.col("_at") - (context_length - 1)
    matches = F.coalesce((first >= 0) & (F.get("dates", first) == F.col("feature_start")), F.lit(False))
    broken = F.raise_error(F.concat(F.lit("window bounds disagree: "), "sample_id"))

    def window(name: str) -> Column:
        return F.slice(F.col(name), first + 1, F.lit(context_length)).alias(name)

    return met.select(
        "security_id",
        "asof_date",
        *[
            F.when(matches, F.col(c)).otherwise(broken.cast("string")).alias(c) if c == "sample_id" else c
            for c in carried
        ],
        *[window(c) for c in ("values", "observed_mask")],
    )


def context_windows(
    features: DataFrame,
    index: DataFrame,
    *,
    channels: Sequence[str] = CHANNELS,
    context_length: int,
    split: str | None = None,
) -> DataFrame:
    """Per sample the last ``context_length`` rows as ``values`` and ``observed_mask`` arrays.

    Packs the series, stores them and cuts the samples out; use ``pack_series`` and
    ``cut_windows`` to read one store for several indexes or epochs.
    """
    packed = pack_series(features, context_length=context_length, channels=channels)
    return cut_windows(
        materialize(packed, "packed-series"), index, context_length=context_length, split=split
    )


def patch_count(context_length: int, length: int, stride: int) -> int:
    return (context_length - length) // stride + 1


def patchify(
    windows: DataFrame,
    *,
    channels: Sequence[str] = CHANNELS,
    context_length: int,
    length: int,
    stride: int,
) -> DataFrame:
    """One row per sample and channel with its list of patches, and any-observed flags."""
    starts = F.sequence(F.lit(0), F.lit(patch_count(context_length, length, stride) - 1))

    def channel_row(position: int, name: str) -> Column:
        return F.struct(
            F.lit(name).alias("channel"),
            F.transform("values", lambda v: v[position]).alias("series"),
            F.transform("observed_mask", lambda m: m[position]).alias("mask"),
        )

    # Series first, patches after the explode: a series is built once, not once per patch.
    rows = F.array(*[channel_row(i, c) for i, c in enumerate(channels)])
    series = windows.select("sample_id", F.explode(rows).alias("r")).select("sample_id", "r.*")

    def patch(p: Column) -> Column:
        seen = F.slice("mask", p * stride + 1, length)
        return F.struct(
            p.alias("patch_index"),
            F.slice("series", p * stride + 1, length).alias("patch_values"),
            seen.alias("patch_mask"),
            F.array_contains(seen, True).alias("patch_observed"),
        )

    return series.select(
        "sample_id",
        "channel",
        F.array_contains("mask", True).alias("channel_observed"),
        F.transform(starts, patch).alias("patches"),
    )


def explode_patches(patches: DataFrame) -> DataFrame:
    kept = [c for c in patches.columns if c != "patches"]
    return patches.select(*kept, F.explode("patches").alias("p")).select(*kept, "p.*")


def masked_patch_sample(patches: DataFrame, *, ratio: float, seed: int, epoch: int = 0) -> DataFrame:
    """One row per patch; a fixed share of each row's patches is masked, by a seeded draw."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must satisfy 0 < ratio < 1")
    total = F.size("patches")
    masked = total - F.floor(total * F.lit(1.0 - ratio)).cast("int")

    def draw(p: Column) -> Column:
        place = seeded_draw(f"{seed}:{epoch}", "sample_id", "channel", p)
        return F.struct(place.alias("place"), p.alias("patch"))

    drawn = F.sort_array(F.transform(F.sequence(F.lit(0), total - 1), draw))
    # Chosen before the explode, so that it is worked out once per row.
    chosen = patches.withColumn("_chosen", F.slice(drawn, F.lit(1), masked)["patch"])
    return explode_patches(chosen).withColumn(
        "masked", F.array_contains(F.col("_chosen"), F.col("patch_index"))
    ).drop("_chosen")


LOSSES = ("mse", "huber")


def masked_reconstruction_loss(
    patches: DataFrame,
    *,
    prediction: str = "prediction",
    losses: Sequence[str] = LOSSES,
    huber_delta: float = 1.0,
) -> DataFrame:
    """One row per loss: its mean over masked and observed elements, and their number.

    Input rows hold arrays ``prediction``, ``patch_values``, ``patch_mask`` and a flag
    ``masked``. Elements are unrolled inside each task and combined map-side.
    """
    if not losses or not set(losses) <= set(LOSSES):
        raise ValueError(f"losses must be among {LOSSES}")
    pairs = F.arrays_zip(
        F.col(prediction).alias("p"), F.col("patch_values").alias("a"), F.col("patch_mask").alias("o")
    )
    elements = patches.filter("masked").select(F.inline(pairs)).filter("o")
    gap = F.col("p").cast("double") - F.col("a").cast("double")
    outer = huber_delta * (F.abs(gap) - 0.5 * huber_delta)
    element = {
        "mse": gap * gap,
        "huber": F.when(F.abs(gap) <= huber_delta, 0.5 * gap * gap).otherwise(outer),
    }
    # All losses in one pass over the elements.
    wide = elements.agg(
        F.count(F.lit(1)).alias("valid_elements"), *[F.avg(element[name]).alias(name) for name in losses]
    )
    return wide.unpivot(["valid_elements"], list(losses), "loss_name", "loss").select(
        "loss_name", "loss", "valid_elements"
    )
