"""Walk-forward aggregation of a fold x seed x model matrix into decisions.

Input is a long table of daily cell metrics: fold_id, seed, model_key, asof_date, metric,
value. Cells are rows; nothing loops over them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import ContractError
from factorloom.operators.metrics import net_name
from factorloom.operators.quality import matrix_completeness, matrix_scope, unequal_cells
from factorloom.operators.statistics import panel_mean_inference

# Model keys and the comparisons the decisions rest on (left minus right).
MODEL_KEYS = ("e0", "e1", "e2", "e3")
PAIRED_COMPARISONS = {
    "architecture_e1_vs_e0": ("e1", "e0"),
    "external_transfer_e2_vs_e1": ("e2", "e1"),
    "financial_pretraining_e3_vs_e2": ("e3", "e2"),
    "overall_e3_vs_e1": ("e3", "e1"),
}
OVERALL = "overall_e3_vs_e1"

RAW, NEUTRALIZED = "raw_rank_ic", "neutralized_rank_ic"


@dataclass(frozen=True)
class Protocol:
    hac_lags: int = 5
    stride: int = 5
    offset: int = 0
    cost_bps: float = 20.0
    minimum_positive_cell_ratio: float = 0.5
    require_neutralized_positive: bool = True
    require_source_ready: bool = True

    @property
    def inference(self) -> dict[str, int]:
        return {"lags": self.hac_lags, "stride": self.stride, "offset": self.offset}


def seed_average(cells: DataFrame) -> DataFrame:
    """Mean over seeds per model, metric, fold and date; missing values are left out."""
    return (
        cells.filter("value IS NOT NULL")
        .groupBy("model_key", "metric", "fold_id", "asof_date")
        .agg(F.avg("value").alias("value"))
    )


def model_inference(cells: DataFrame, protocol: Protocol = Protocol()) -> DataFrame:
    return panel_mean_inference(
        seed_average(cells), by=["model_key", "metric"], **protocol.inference
    )


def paired_days(
    cells: DataFrame, comparisons: Mapping[str, Sequence[str]] = PAIRED_COMPARISONS
) -> DataFrame:
    """Left minus right on the dates both models share, per comparison, fold and seed.

    Each row is tagged with the comparisons its model takes part in; one grouping then
    pairs the sides of all comparisons at once.
    """
    roles = [
        (model, name, side)
        for name, pair in comparisons.items()
        for side, model in enumerate(pair)
    ]
    role = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(n).alias("comparison"), F.lit(s).alias("side"))
            for m, n, s in roles
        ]
    )
    tagged = (
        cells.filter((F.col("metric") == RAW) & F.col("value").isNotNull())
        .withColumn("r", F.explode(role))
        .filter(F.col("r.model") == F.col("model_key"))
    )

    def of_side(side: int) -> Column:
        return F.max(F.when(F.col("r.side") == side, F.col("value")))

    return (
        tagged.groupBy(F.col("r.comparison").alias("comparison"), "fold_id", "seed", "asof_date")
        .agg((of_side(0) - of_side(1)).alias("value"))
        .filter("value IS NOT NULL")
    )


def cell_deltas(days: DataFrame) -> DataFrame:
    return days.groupBy("comparison", "fold_id", "seed").agg(F.avg("value").alias("mean_delta"))


def paired_delta(
    cells: DataFrame,
    protocol: Protocol = Protocol(),
    comparisons: Mapping[str, Sequence[str]] = PAIRED_COMPARISONS,
) -> DataFrame:
    """Per comparison: cells, share of cells with a positive mean, pooled daily inference.

    A fold and seed without common dates stops the job.
    """
    days = paired_days(cells, comparisons)
    planned = cells.select("fold_id", "seed").distinct().agg(F.count(F.lit(1))).scalar()
    positive = (F.col("mean_delta") > 0).cast("double")
    share = cell_deltas(days).groupBy("comparison").agg(
        F.count(F.lit(1)).alias("_cells"), F.avg(positive).alias("positive_cell_ratio")
    )
    gap = F.raise_error(F.lit("a paired comparison has no common dates")).cast("long")
    counted = share.select(
        "comparison",
        F.when(F.col("_cells") == planned, F.col("_cells")).otherwise(gap).alias("cell_count"),
        "positive_cell_ratio",
    )
    averaged = days.groupBy("comparison", "fold_id", "asof_date").agg(F.avg("value").alias("value"))
    pooled = panel_mean_inference(averaged, by=["comparison"], **protocol.inference)
    return counted.join(pooled, "comparison")


# The texts of reasons below are fixed values: they are part of the decision tables.


def _verdict(frame: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    none = F.array().cast("array<string>")
    reasons = F.concat(
        *[F.when(broken, F.array(F.lit(text))).otherwise(none) for broken, text in rules]
    )
    return frame.withColumn("reasons", reasons).withColumns(
        {
            "passed": F.size("reasons") == 0,
            "status": F.when(F.size("reasons") == 0, "go").otherwise("no_go"),
        }
    )


# The reasons that the decision tables print.
DELTA_NOT_POSITIVE = "paired mean Rank IC delta is not positive"
RATIO_BELOW = "positive fold/seed cell ratio is below the configured threshold"
SOURCE_NOT_READY = "source provenance is missing or not explicitly research-ready"
RAW_NOT_POSITIVE = "E3 raw Rank IC is not positive"
NEUTRALIZED_NOT_POSITIVE = "E3 neutralized Rank IC is unavailable or not positive"
NET_NOT_POSITIVE = "E3 net Q5-Q1 at {cost:g} bps is not positive"
TOO_FEW_CELLS = "E3 does not beat E1 in enough fold/seed cells"


def _not_positive(value: str) -> Column:
    return ~F.coalesce(F.col(value) > 0, F.lit(False))


def decide(
    deltas: DataFrame, source_gate_failed: Column, protocol: Protocol = Protocol()
) -> DataFrame:
    """Go or no-go per comparison, with the reasons against."""
    rules = [
        (_not_positive("mean"), DELTA_NOT_POSITIVE),
        (
            F.col("positive_cell_ratio") < protocol.minimum_positive_cell_ratio,
            RATIO_BELOW,
        ),
        (
            source_gate_failed & F.lit(protocol.require_source_ready),
            SOURCE_NOT_READY,
        ),
    ]
    return _verdict(deltas, rules).select(
        "comparison",
        "passed",
        "status",
        "reasons",
        F.col("mean").alias("mean_delta"),
        "positive_cell_ratio",
        F.lit(protocol.minimum_positive_cell_ratio).alias("minimum_positive_cell_ratio"),
    )


def overall_decision(
    models: DataFrame,
    deltas: DataFrame,
    source_gate_failed: Column,
    protocol: Protocol = Protocol(),
    model: str = "e3",
) -> DataFrame:
    """One row: does the final model clear every criterion?"""
    net = net_name(protocol.cost_bps)

    def mean_of(metric: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.col("mean")))

    ratio = deltas.filter(F.col("comparison") == OVERALL).agg(F.max("positive_cell_ratio")).scalar()
    summary = (
        models.filter(F.col("model_key") == model)
        .agg(
            mean_of(RAW).alias("raw_rank_ic_mean"),
            mean_of(NEUTRALIZED).alias("neutralized_rank_ic_mean"),
            mean_of(net).alias(f"{net}_mean"),
        )
        .withColumn("e3_vs_e1_positive_cell_ratio", ratio)
    )
    rules = [
        (_not_positive("raw_rank_ic_mean"), RAW_NOT_POSITIVE),
        (
            F.lit(protocol.require_neutralized_positive)
            & _not_positive("neutralized_rank_ic_mean"),
            NEUTRALIZED_NOT_POSITIVE,
        ),
        (
            _not_positive(f"{net}_mean"),
            NET_NOT_POSITIVE.format(cost=protocol.cost_bps),
        ),
        (
            F.col("e3_vs_e1_positive_cell_ratio") < protocol.minimum_positive_cell_ratio,
            TOO_FEW_CELLS,
        ),
        (
            source_gate_failed & F.lit(protocol.require_source_ready),
            SOURCE_NOT_READY,
        ),
    ]
    return _verdict(summary, rules)


def source_readiness(cells: DataFrame) -> DataFrame:
    """One row over the matrix cells: all explicitly ready, any blocked, gate failed."""
    ready = F.col("source_research_ready")
    return cells.agg(
        F.bool_and(F.coalesce(ready, F.lit(False))).alias("all_cells_explicitly_ready"),
        F.bool_or(~F.coalesce(ready, F.lit(True))).alias("explicitly_blocked"),
    ).withColumn("gate_failed", ~F.col("all_cells_explicitly_ready"))


def aggregate_research(
    cells: DataFrame,
    daily: DataFrame,
    *,
    folds: Sequence[str],
    seeds: Sequence[int],
    models: Sequence[str] = MODEL_KEYS,
    protocol: Protocol = Protocol(),
    predictions: DataFrame | None = None,
    split: str | None = None,
) -> dict[str, DataFrame]:
    """Check the matrix, then infer, compare and decide.

    ``cells`` has one row per run (with dataset_id, evaluation_split and
    source_research_ready), ``daily`` the long daily metrics. With the stacked ``predictions``,
    all cells of a fold must hold the same keys and targets; with ``split``, all runs must have
    been evaluated on it.
    """
    problems = matrix_completeness(cells, folds, seeds, models)
    mixed = matrix_scope(cells).filter("datasets != 1 OR splits != 1")
    if not problems.isEmpty() or not mixed.isEmpty():
        raise ContractError("the research matrix is incomplete or mixes datasets or splits")
    if split is not None and not cells.filter(F.col("evaluation_split") != split).isEmpty():
        raise ContractError(f"a cell was not evaluated on the {split} split")
    if predictions is not None and not unequal_cells(predictions).isEmpty():
        raise ContractError("cells of a fold differ in their samples or targets")
    readiness = source_readiness(cells)
    gate = readiness.select("gate_failed").scalar()
    inferred = model_inference(daily, protocol)
    deltas = paired_delta(daily, protocol)
    return {
        "models": inferred,
        "paired_deltas": deltas,
        "decisions": decide(deltas.filter(F.col("comparison") != OVERALL), gate, protocol),
        "overall": overall_decision(inferred, deltas, gate, protocol),
        "source_readiness": readiness,
    }
