"""Independent evaluation of a stored prediction table against a snapshot's index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import ContractError
from factorloom.operators.metrics import COSTS_BPS, evaluate_predictions
from factorloom.operators.quality import (
    prediction_coverage,
    readiness_gate,
    require_predictions,
    verify_targets,
)


def evaluate_prediction_table(
    predictions: DataFrame,
    index: DataFrame,
    dataset_id: str,
    *,
    source_ready: bool | None = None,
    costs_bps: Sequence[float] = COSTS_BPS,
    minimum_coverage: float = 1.0,
) -> dict[str, DataFrame]:
    """Check contract, dataset, split, targets and coverage, then compute all metrics."""
    require_predictions(predictions)
    scope = predictions.agg(
        F.min("dataset_id").alias("dataset_id"),
        F.min("split").alias("split"),
        F.max("split").alias("last_split"),
    ).first()
    if scope["dataset_id"] != dataset_id:
        raise ContractError("prediction dataset_id does not match the snapshot")
    split = scope["split"]
    if split != scope["last_split"] or split not in ("train", "valid", "test"):
        raise ContractError("predictions must hold exactly one recognised split")
    if not verify_targets(predictions, index).isEmpty():
        raise ContractError("prediction keys or targets differ from the snapshot")
    coverage = prediction_coverage(predictions, index, split, minimum_coverage)
    if not coverage.first()["passed"]:
        raise ContractError("prediction coverage is below the minimum")
    result = evaluate_predictions(predictions, costs_bps)
    source = F.lit(source_ready).cast("boolean")
    result["coverage"] = coverage
    result["cross_section"] = result["cross_section"].withColumns(
        {
            "statistical_ready": F.col("research_ready"),
            "source_research_ready": source,
            "research_ready": readiness_gate(F.col("research_ready"), source),
        }
    )
    return result
