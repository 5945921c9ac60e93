"""Baseline models on the tabular features, distributed scoring, prediction tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import is_finite
from factorloom.functions.session import materialize
from factorloom.operators.neutralize import neutralize
from factorloom.operators.quality import one_per_key, require_predictions

# When a signal is known and when it can first be traded.
SIGNAL_AVAILABLE = "after_close"
EARLIEST_EXECUTION = "next_session_open"


def prediction_frame(
    rows: DataFrame,
    metadata: DataFrame,
    scores: DataFrame,
    *,
    model_id: str,
    checkpoint_hash: str,
    dataset_id: str,
) -> DataFrame:
    """Samples with score, exposures and lineage, neutralised per date.

    ``scores`` holds (sample_id, score_raw). A sample without a score stays NULL, which breaks
    the prediction contract and stops here, as does a sample with two scores or exposures.
    """
    keys = ["sample_id", "security_id", "symbol", "asof_date", "split", "target"]
    exposures = metadata.select("sample_id", "eligible", "industry_code", "log_float_market_cap")
    found = scores.select("sample_id", F.col("score_raw").cast("double"))
    joined = (
        rows.select(*keys)
        .join(one_per_key(found, ["sample_id"], "scores"), "sample_id", "left")
        .join(one_per_key(exposures, ["sample_id"], "metadata"), "sample_id", "left")
        .drop("sample_id")
    )
    # Stored once: the neutralisation reads it for its sums and for the residuals.
    stored = materialize(_with_lineage(joined, model_id, checkpoint_hash, dataset_id), "scored")
    return require_predictions(materialize(neutralize(stored), "predictions"))


def live_factor_frame(
    rows: DataFrame, scores: DataFrame, *, model_id: str, checkpoint_hash: str, dataset_id: str
) -> DataFrame:
    """Target-free factors of the inference index; a missing or non-finite score stops the job."""
    score = F.col("score_raw").cast("double")
    bad = F.raise_error(F.concat(F.lit("factor score is not finite: "), "sample_id")).cast("double")
    joined = (
        rows.select(
            "sample_id",
            "security_id",
            "symbol",
            "asof_date",
            "eligible",
            "industry_code",
            "log_float_market_cap",
        )
        .join(one_per_key(scores.select("sample_id", "score_raw"), ["sample_id"], "scores"), "sample_id", "left")
        .withColumn(
            "score_raw", F.when(F.coalesce(is_finite(score), F.lit(False)), score).otherwise(bad)
        )
        .drop("sample_id")
    )
    factors = _with_execution(_with_lineage(joined, model_id, checkpoint_hash, dataset_id))
    return neutralize(materialize(factors, "live-scored"))


def factor_frame(predictions: DataFrame) -> DataFrame:
    """The target-free part of a prediction table."""
    return _with_execution(
        predictions.select(
            "security_id",
            "symbol",
            "asof_date",
            "score_raw",
            "score_neutralized",
            "split",
            "model_id",
            "checkpoint_hash",
            "dataset_id",
        )
    )


def _with_lineage(
    frame: DataFrame, model_id: str, checkpoint_hash: str, dataset_id: str
) -> DataFrame:
    return frame.withColumns(
        {
            "score_neutralized": F.lit(None).cast("double"),
            "model_id": F.lit(model_id),
            "checkpoint_hash": F.lit(checkpoint_hash),
            "dataset_id": F.lit(dataset_id),
        }
    )


def _with_execution(frame: DataFrame) -> DataFrame:
    return frame.withColumns(
        {
            "signal_available": F.lit(SIGNAL_AVAILABLE),
            "earliest_execution": F.lit(EARLIEST_EXECUTION),
        }
    )


def _as_vector(tabular: DataFrame) -> DataFrame:
    return tabular.withColumn("features", array_to_vector("vector"))


def fit_linear_baseline(
    tabular: DataFrame,
    *,
    epsilon: float = 1.35,
    penalty: float = 1e-3,
    iterations: int = 100,
    tolerance: float = 1e-4,
) -> Model:
    """Linear baseline with Huber loss on the train_fit rows of a transformed table."""
    train = _as_vector(tabular.filter("split = 'train_fit'"))
    return LinearRegression(
        labelCol="target",
        predictionCol="score_raw",
        loss="huber",
        epsilon=epsilon,
        regParam=penalty,
        maxIter=iterations,
        tol=tolerance,
    ).fit(train)


def fit_tree_baseline(
    tabular: DataFrame,
    *,
    seed: int,
    rounds: int = 500,
    patience: int = 30,
    depth: int = 3,
    learning_rate: float = 0.05,
) -> Model:
    """Boosted trees on train_fit, cut at the round with the least selection error.

    Boosting stops once ``patience`` rounds bring no better error on inner_selection. Trees are
    grown in stretches that double, each judged by its staged predictions on the selection
    rows; a seeded fit of k rounds holds the first k trees of a longer one, so the result is
    what one fit stopped at its best round gives. Without selection rows all rounds are kept.
    """
    if rounds < 1 or patience < 1:
        raise ValueError("rounds and patience must be positive")
    rows = _as_vector(tabular.filter("split IN ('train_fit', 'inner_selection')"))
    train = rows.filter("split = 'train_fit'").select("features", "target")
    selection = rows.filter("split = 'inner_selection'").select("features", "target")

    def boosted(trees: int) -> Model:
        return GBTRegressor(
            labelCol="target",
            predictionCol="score_raw",
            maxIter=trees,
            maxDepth=depth,
            stepSize=learning_rate,
            seed=seed,
        ).fit(train)

    if selection.isEmpty():
        return boosted(rounds)
    grown = min(rounds, 2 * patience)
    while True:
        model = boosted(grown)
        best, stopped = best_round(model.evaluateEachIteration(selection, "squared"), patience)
        if stopped or grown == rounds:
            return model if best == grown else boosted(best)
        grown = min(rounds, 2 * grown)


def best_round(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) of the least error seen before patience runs out, and whether it did."""
    best = 0
    for number, error in enumerate(errors):
        if error < errors[best]:
            best = number
        elif number - best >= patience:
            return best + 1, True
    return best + 1, False


def score_table(model: Model, tabular: DataFrame) -> DataFrame:
    """Scores of a fitted model for every row, computed on the executors."""
    return model.transform(_as_vector(tabular)).select("sample_id", F.col("score_raw"))


def score_with(tabular: DataFrame, predict, columns: Sequence[str] = ("vector",)) -> DataFrame:
    """Scores of any picklable ``predict(pandas.DataFrame) -> sequence``, batch by batch."""
    wanted = list(columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"sample_id": batch["sample_id"], "score_raw": predict(batch[wanted])})

    rows = tabular.select("sample_id", *wanted)
    return rows.mapInPandas(run, "sample_id string, score_raw double")


def momentum_score(column: str, digits: int = 9) -> Column:
    """A deterministic score from one feature: rounded, 0 where the feature is missing."""
    return F.round(F.coalesce(F.col(column), F.lit(0.0)), digits)
