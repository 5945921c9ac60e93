"""Contract checks and audits: violating rows or a one-row report each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import ContractError, is_finite
from factorloom.functions.session import materialize
from factorloom.sources.tables import StandardTables

# Keys and columns that may not be NULL, per table contract.
KEYS = {
    "bars": ["security_id", "trade_date"],
    "universe": ["security_id", "trade_date"],
    "corporate_actions": [],
    "delistings": ["security_id"],
}
NOT_NULL = {
    "bars": ["security_id", "symbol", "trade_date", "source_revision"],
    "universe": [
        "security_id",
        "symbol",
        "trade_date",
        "exchange",
        "security_type",
        "is_primary_listing",
        "is_listed",
        "is_delisted",
        "is_halted",
        "eligible",
    ],
    "corporate_actions": ["security_id", "ex_date", "action_type", "known_at", "source_revision"],
    "delistings": ["security_id", "delist_date", "last_trade_date", "known_at", "source_revision"],
}
# Prediction columns that may not be NULL.
PREDICTION_NOT_NULL = [
    "security_id",
    "symbol",
    "asof_date",
    "score_raw",
    "target",
    "split",
    "model_id",
    "checkpoint_hash",
    "dataset_id",
    "eligible",
]


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def duplicate_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)
    )


def null_counts(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    return frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def bar_rules() -> Column:
    c = F.col
    prices = ("open", "high", "low", "close")
    numbers = (*prices, "volume", "dollar_volume", "adj_factor")
    return any_of(
        [
            *[c(p) <= 0 for p in prices],
            c("high") < F.greatest("open", "close", "low"),
            c("low") > F.least("open", "close", "high"),
            c("volume") < 0,
            c("dollar_volume") < 0,
            c("adj_factor") <= 0,
            *[~is_finite(c(n)) for n in numbers],
        ]
    )


def universe_rules() -> Column:
    c = F.col
    return c("eligible") & any_of(
        [
            ~c("is_listed"),
            c("is_delisted"),
            c("is_halted"),
            ~c("is_primary_listing"),
            c("security_type") != "common_stock",
        ]
    )


def action_rules() -> Column:
    c = F.col
    return any_of(
        [
            c("price_factor") <= 0,
            c("volume_factor") <= 0,
            c("cash_amount") < 0,
            c("known_at") > c("ex_date"),
        ]
    )


def delisting_rules() -> Column:
    c = F.col
    return any_of(
        [
            c("last_trade_date") > c("delist_date"),
            c("delisting_return").isNull() & c("terminal_value").isNull(),
            c("delisting_return") < -1,
            c("terminal_value") < 0,
        ]
    )


RULES = {
    "bars": bar_rules,
    "universe": universe_rules,
    "corporate_actions": action_rules,
    "delistings": delisting_rules,
}


def bar_violations(bars: DataFrame) -> DataFrame:
    return bars.filter(bar_rules())


def universe_violations(universe: DataFrame) -> DataFrame:
    return universe.filter(universe_rules())


def action_violations(actions: DataFrame) -> DataFrame:
    return actions.filter(action_rules())


def delisting_violations(delistings: DataFrame) -> DataFrame:
    return delistings.filter(delisting_rules())


def contract_report(frame: DataFrame, table: str) -> DataFrame:
    """One row: NULL keys, duplicate keys and broken rules of a standard table."""
    nulls = any_of([F.col(c).isNull() for c in NOT_NULL[table]])
    if not KEYS[table]:
        return frame.agg(
            F.count_if(nulls).alias("null_rows"),
            F.lit(0).cast("long").alias("duplicate_keys"),
            F.count_if(RULES[table]()).alias("rule_rows"),
        )
    # One exchange on the key serves the duplicate check and, pre-aggregated, the rules.
    keyed = frame.groupBy(*KEYS[table]).agg(
        F.count(F.lit(1)).alias("_copies"),
        F.count_if(nulls).alias("_nulls"),
        F.count_if(RULES[table]()).alias("_rules"),
    )
    return keyed.agg(
        F.coalesce(F.sum("_nulls"), F.lit(0)).alias("null_rows"),
        F.count_if(F.col("_copies") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum("_rules"), F.lit(0)).alias("rule_rows"),
    )


def require_contract(frame: DataFrame, table: str) -> DataFrame:
    """The table itself, if one report over it finds no broken rule."""
    found = {k: v for k, v in contract_report(frame, table).first().asDict().items() if v}
    if found:
        raise ContractError(f"{table} breaks its contract: {found}")
    return frame


def checked(frame: DataFrame, table: str) -> DataFrame:
    """Store a built table once and check its contract on the stored rows."""
    return require_contract(materialize(frame, f"checked-{table}"), table)


def require_unique(frame: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    if not duplicate_keys(frame, keys).isEmpty():
        raise ContractError(f"{what} repeats {list(keys)}")
    return frame


def table_audit(frame: DataFrame, date_column: str, table: str) -> DataFrame:
    """One row: rows, distinct securities, date range, NULLs per column (non-zero only)."""
    # A first exchange on security_id replaces a distinct count over all rows.
    per_security = frame.groupBy("security_id").agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min(date_column).alias("_min"),
        F.max(date_column).alias("_max"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in frame.columns],
    )
    totals = per_security.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.count("security_id").alias("securities"),
        F.min("_min").alias("date_min"),
        F.max("_max").alias("date_max"),
        *[F.coalesce(F.sum(f"_null_{c}"), F.lit(0)).alias(f"_null_{c}") for c in frame.columns],
    )
    listed = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"_null_{c}").alias("nulls"))
            for c in sorted(frame.columns)
        ]
    )
    return totals.select(
        F.lit(table).alias("table"),
        "rows",
        "securities",
        "date_min",
        "date_max",
        F.filter(listed, lambda e: e["nulls"] > 0).alias("null_counts"),
    )


def bundle_audit(tables: StandardTables) -> DataFrame:
    dates = {
        "bars": "trade_date",
        "universe": "trade_date",
        "corporate_actions": "ex_date",
        "delistings": "delist_date",
    }
    reports = [table_audit(frame, dates[name], name) for name, frame in tables.items()]
    return reduce(DataFrame.unionByName, reports)


def prediction_report(predictions: DataFrame) -> DataFrame:
    """One row of violation counts of a prediction table; all zero when it is valid.

    ``models`` and ``datasets`` count distinct values and must both be 1; an empty table has 0.
    """
    c = F.col
    nulls = any_of([c(n).isNull() for n in PREDICTION_NOT_NULL])
    finite = any_of(
        [~is_finite(c(n)) for n in ("score_raw", "target", "score_neutralized")]
    )
    keyed = predictions.groupBy("model_id", "security_id", "asof_date").agg(
        F.count(F.lit(1)).alias("_copies"),
        F.count_if(nulls).alias("_nulls"),
        F.count_if(finite).alias("_bad"),
    )
    datasets = predictions.agg(F.count_distinct("dataset_id")).scalar()
    return keyed.agg(
        F.coalesce(F.sum("_nulls"), F.lit(0)).alias("null_rows"),
        F.count_if(c("_copies") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("non_finite_rows"),
        F.count_distinct("model_id").alias("models"),
    ).withColumn("datasets", datasets)


def require_predictions(predictions: DataFrame) -> DataFrame:
    found = prediction_report(predictions).first().asDict()
    expected = {"models": 1, "datasets": 1}
    broken = {k: v for k, v in found.items() if v != expected.get(k, 0)}
    if broken:
        raise ContractError(f"predictions break their contract: {broken}")
    return predictions


def prediction_coverage(
    predictions: DataFrame, index: DataFrame, split: str, minimum: float = 1.0
) -> DataFrame:
    """One row: expected, present, missing and unexpected keys of a split, and the gate."""
    keys = ["security_id", "asof_date"]
    tagged = (
        index.filter(F.col("split") == split)
        .select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_a"))
        .unionByName(
            predictions.filter(F.col("split") == split).select(
                *keys, F.lit(0).alias("_e"), F.lit(1).alias("_a")
            )
        )
    )
    # Grouping both sides at once answers both anti joins with one exchange.
    sides = tagged.groupBy(*keys).agg(F.sum("_e").alias("e"), F.sum("_a").alias("a"))
    counts = sides.agg(
        F.coalesce(F.sum("e"), F.lit(0)).alias("expected_rows"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("prediction_rows"),
        F.coalesce(F.sum(F.when(F.col("a") == 0, F.col("e"))), F.lit(0)).alias("missing_rows"),
        F.coalesce(F.sum(F.when(F.col("e") == 0, F.col("a"))), F.lit(0)).alias("unexpected_rows"),
    )
    ratio = F.coalesce(
        F.try_divide(F.col("prediction_rows").cast("double"), F.col("expected_rows")), F.lit(0.0)
    )
    return counts.select(
        F.lit(split).alias("split"),
        "*",
        ratio.alias("coverage"),
        F.lit(float(minimum)).alias("minimum_required"),
        ((F.col("unexpected_rows") == 0) & (ratio >= minimum)).alias("passed"),
    )


def feature_audit(features: DataFrame) -> DataFrame:
    """Share of observed rows per channel."""
    observed = [c for c in features.columns if c.startswith("observed_")]
    wide = features.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in observed],
    )
    long = wide.unpivot(["rows"], observed, "channel", "observed_ratio")
    return long.withColumn("channel", F.regexp_replace("channel", "^observed_", ""))


def label_audit(labels: DataFrame) -> DataFrame:
    """One row; ``invalid_exit`` counts delistings at a terminal value of zero or less."""
    return labels.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("target").alias("target_non_null"),
        F.count_if("crosses_delisting").alias("crosses_delisting"),
        F.count_if(F.col("crosses_delisting") & F.col("raw_return").isNull()).alias(
            "invalid_exit"
        ),
    )


def split_counts(sample_index: DataFrame) -> DataFrame:
    return sample_index.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def index_audit(inference_index: DataFrame) -> DataFrame:
    daily = inference_index.groupBy("asof_date").agg(F.count(F.lit(1)).alias("_n"))
    return daily.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.min("asof_date").alias("minimum_asof_date"),
        F.max("asof_date").alias("maximum_asof_date"),
        F.max_by("_n", "asof_date").alias("latest_cross_section_rows"),
    ).withColumn("contains_target", F.lit("target" in inference_index.columns))


def looks_ahead(index: DataFrame) -> Column:
    """Whether a row looks ahead; for a target-free index, whether its window misses asof."""
    c = F.col
    if "label_start" in index.columns:
        ahead = c("asof_date") >= c("label_start")
        if "feature_end" in index.columns:
            ahead = ahead | (c("feature_end") > c("asof_date"))
        return ahead
    return c("feature_end") != c("asof_date")


def temporal_violations(index: DataFrame) -> DataFrame:
    return index.filter(looks_ahead(index))


def join_cardinality(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: duplicated keys on each side of a join, and the widest valid kind."""
    counted = (
        left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
        .agg(
            F.count_if(F.col("_l") > 1).alias("left_duplicates"),
            F.count_if(F.col("_r") > 1).alias("right_duplicates"),
        )
    )
    one_left, one_right = F.col("left_duplicates") == 0, F.col("right_duplicates") == 0
    return counted.withColumn(
        "cardinality",
        F.when(one_left & one_right, "1:1")
        .when(one_right, "m:1")
        .when(one_left, "1:m")
        .otherwise("m:m"),
    )


def one_per_key(frame: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """The one side of a join: the same rows, stopping the job where a key repeats.

    Rows are grouped by the keys that the join needs them laid out by anyway, so the check is
    part of the join's own pass. Rows with a NULL key meet nothing and are left out.
    """
    others = [c for c in frame.columns if c not in keys]
    known = frame.dropna("any", subset=list(keys))
    row = F.struct(*others) if others else F.lit(True)
    grouped = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), F.any_value(row).alias("_row"))
    text = F.concat_ws(" ", F.lit(f"{what} repeats a key:"), *[F.col(k).cast("string") for k in keys])
    single = F.when(F.col("_copies") == 1, True).otherwise(F.raise_error(text).cast("boolean"))
    kept = grouped.filter(single)
    return kept.select(*keys, "_row.*") if others else kept.select(*keys)


_CARDINALITIES = {"1:1": ("1:1",), "m:1": ("1:1", "m:1"), "1:m": ("1:1", "1:m")}


def checked_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    validate: str,
    how: str = "inner",
    names: tuple[str, str] = ("left", "right"),
) -> DataFrame:
    """A join that stops the job unless it is ``validate``: 1:1, m:1 or 1:m.

    Each one side is gated in the pass that joins it.
    """
    if validate not in _CARDINALITIES:
        raise ValueError(f"validate must be one of {sorted(_CARDINALITIES)}")
    ones = validate.split(":")
    sides = [
        one_per_key(side, keys, name) if one == "1" else side
        for side, name, one in zip((left, right), names, ones)
    ]
    return sides[0].join(sides[1], list(keys), how)


def assert_join_cardinality(
    left: DataFrame, right: DataFrame, keys: Sequence[str], validate: str
) -> None:
    """The same question in a pass of its own, before a join that is planned elsewhere."""
    found = join_cardinality(left, right, keys).first()["cardinality"]
    if found not in _CARDINALITIES[validate]:
        raise ContractError(f"join on {list(keys)} is {found}, expected {validate}")


def verify_targets(predictions: DataFrame, index: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Prediction rows whose key is not in the index split or whose target differs."""
    expected = index.select(
        "security_id", "asof_date", "split", F.col("target").alias("expected_target")
    )
    checked = predictions.select("security_id", "asof_date", "split", "target").join(
        expected, ["security_id", "asof_date", "split"], "left"
    )
    gap = F.abs(F.col("target") - F.col("expected_target"))
    return checked.withColumn(
        "reason",
        F.when(F.col("expected_target").isNull(), "missing_key").when(
            ~F.coalesce(gap <= tolerance, F.lit(False)), "target_differs"
        ),
    ).filter("reason IS NOT NULL")


def same_samples(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """Keys on which runs disagree: absent from some run, repeated in one, or with another target.

    ``runs`` stacks the prediction tables of all runs; NULL targets count as equal.
    """
    # NULL runs cannot occur; the run list is read once as a scalar.
    total = runs.select(run).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    per_run = runs.groupBy("security_id", "asof_date", run).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("target").alias("_known"),
        F.min("target").alias("_low"),
        F.max("target").alias("_high"),
    )
    per_key = per_run.groupBy("security_id", "asof_date").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("rows").alias("rows"),
        F.sum("_known").alias("_known"),
        F.min("_low").alias("target_min"),
        F.max("_high").alias("target_max"),
    )
    known = (F.col("_known") == 0) | (
        (F.col("_known") == F.col("rows")) & (F.col("target_min") == F.col("target_max"))
    )
    once_each = (F.col("runs") == total) & (F.col("rows") == total)
    return per_key.filter(~once_each | ~known).drop("_known")


def require_comparable(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """The runs, if they share dataset, split, keys and targets."""
    scope = same_run_scope(runs, run).first()
    if not scope["comparable"]:
        raise ContractError(f"runs are not comparable: {scope.asDict()}")
    if not same_samples(runs, run).isEmpty():
        raise ContractError("runs differ in their samples or targets")
    return runs


def unequal_cells(cells: DataFrame) -> DataFrame:
    """Keys of a fold that some seed and model lacks, repeats, or gives another target.

    ``cells`` stacks the predictions of all runs of a matrix.
    """
    planned = cells.select("fold_id", "seed", "model_key").distinct().groupBy("fold_id").agg(
        F.count(F.lit(1)).alias("planned")
    )
    per_key = cells.groupBy("fold_id", "security_id", "asof_date").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("seed", "model_key").alias("cells"),
        F.count("target").alias("_known"),
        F.min("target").alias("_low"),
        F.max("target").alias("_high"),
    )
    same_target = (F.col("_known") == 0) | (
        (F.col("_known") == F.col("rows")) & (F.col("_low") == F.col("_high"))
    )
    complete = (F.col("rows") == F.col("planned")) & (F.col("cells") == F.col("planned"))
    # One row per fold.
    return (
        per_key.join(F.broadcast(planned), "fold_id")
        .filter(~complete | ~same_target)
        .select("fold_id", "security_id", "asof_date", "cells", "planned")
    )


def same_run_scope(runs: DataFrame, run: str = "run_id") -> DataFrame:
    """One row: runs compared, and whether they share one dataset and one split."""
    scopes = runs.select(run, "dataset_id", "split").distinct()
    return scopes.agg(
        F.countDistinct(run).alias("runs"),
        F.countDistinct("dataset_id").alias("datasets"),
        F.countDistinct("split").alias("splits"),
    ).withColumn("comparable", (F.col("datasets") == 1) & (F.col("splits") == 1))


def verify_replay(
    original: DataFrame, replayed: DataFrame, rtol: float = 1e-6, atol: float = 1e-8
) -> DataFrame:
    """One row: keys and targets that differ, score differences, and the verdict."""
    keys = ["security_id", "asof_date"]
    left = original.select(
        *keys,
        F.col("target").alias("_lt"),
        F.col("score_raw").alias("_l"),
        F.lit(True).alias("_in_l"),
    )
    right = replayed.select(
        *keys,
        F.col("target").alias("_rt"),
        F.col("score_raw").alias("_r"),
        F.lit(True).alias("_in_r"),
    )
    both = left.join(right, keys, "full")
    gap = F.abs(F.col("_l") - F.col("_r"))
    close = F.coalesce(gap <= atol + rtol * F.abs(F.col("_r")), F.lit(False))
    paired = F.col("_in_l") & F.col("_in_r")
    differs = ~F.coalesce(paired, F.lit(False)) | ~F.col("_lt").eqNullSafe(F.col("_rt"))
    return both.agg(
        F.count("_in_l").alias("rows"),
        F.count_if(differs).alias("key_or_target_differences"),
        F.coalesce(F.max(gap), F.lit(0.0)).alias("maximum_absolute_difference"),
        F.coalesce(F.avg(gap), F.lit(0.0)).alias("mean_absolute_difference"),
        F.coalesce(F.bool_and(close & ~differs), F.lit(True)).alias("matched"),
    )


def matrix_completeness(
    cells: DataFrame, folds: Sequence[str], seeds: Sequence[int], models: Sequence[str]
) -> DataFrame:
    """Cells of the fold x seed x model plan that are missing, and cells not in the plan."""
    spark = cells.sparkSession
    planned = (
        spark.range(1)
        .select(F.explode(F.array(*[F.lit(f) for f in folds])).alias("fold_id"))
        .select("fold_id", F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
        .select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model_key"))
        .withColumn("seed", F.col("seed").cast("long"))
    )
    keys = ["fold_id", "seed", "model_key"]
    actual = cells.select(*keys).distinct()
    missing = planned.join(actual, keys, "left_anti").withColumn("problem", F.lit("missing"))
    surplus = actual.join(planned, keys, "left_anti").withColumn("problem", F.lit("unexpected"))
    return missing.unionByName(surplus)


def matrix_scope(cells: DataFrame) -> DataFrame:
    """Per fold: datasets and evaluation splits in use; both must be 1."""
    return cells.groupBy("fold_id").agg(
        F.countDistinct("dataset_id").alias("datasets"),
        F.countDistinct("evaluation_split").alias("splits"),
    )


def universe_coverage(universe: DataFrame, folds: DataFrame) -> DataFrame:
    """Universe rows and date range, and whether it reaches each fold's test end."""
    stats = universe.agg(
        F.count(F.lit(1)).alias("universe_rows"),
        F.min("trade_date").alias("date_min"),
        F.max("trade_date").alias("date_max"),
    )
    # Joining the one-row aggregate on a constant keeps this a broadcast hash join.
    return (
        folds.select("fold_id", "test_end", F.lit(1).alias("_one"))
        .join(F.broadcast(stats.withColumn("_one", F.lit(1))), "_one")
        .drop("_one")
        .withColumn("covers", F.coalesce(F.col("date_max") >= F.col("test_end"), F.lit(False)))
    )


def readiness_gate(statistical: Column, source: Column) -> Column:
    """Statistical readiness, unless the source explicitly says it is not ready."""
    return F.coalesce(statistical, F.lit(False)) & F.coalesce(source, F.lit(True))
