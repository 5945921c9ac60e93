"""The standard tables: schemas, the input bundle, and its Parquet reader."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.functions.columns import ContractError, require_columns

# Required columns of each standard table.
BARS = (
    T.StructType()
    .add("security_id", "string")
    .add("symbol", "string")
    .add("trade_date", "date")
    .add("open", "double")
    .add("high", "double")
    .add("low", "double")
    .add("close", "double")
    .add("volume", "double")
    .add("dollar_volume", "double")
    .add("adj_factor", "double")
    .add("source_revision", "string")
)
UNIVERSE = (
    T.StructType()
    .add("security_id", "string")
    .add("symbol", "string")
    .add("trade_date", "date")
    .add("listed_days", "long")
    .add("exchange", "string")
    .add("security_type", "string")
    .add("is_primary_listing", "boolean")
    .add("is_listed", "boolean")
    .add("is_delisted", "boolean")
    .add("is_halted", "boolean")
    .add("industry_code", "string")
    .add("float_market_cap", "double")
    .add("close", "double")
    .add("adv20_usd", "double")
    .add("eligible", "boolean")
)
CORPORATE_ACTIONS = (
    T.StructType()
    .add("security_id", "string")
    .add("ex_date", "date")
    .add("action_type", "string")
    .add("price_factor", "double")
    .add("volume_factor", "double")
    .add("cash_amount", "double")
    .add("known_at", "date")
    .add("source_revision", "string")
)
DELISTINGS = (
    T.StructType()
    .add("security_id", "string")
    .add("delist_date", "date")
    .add("last_trade_date", "date")
    .add("delisting_return", "double")
    .add("terminal_value", "double")
    .add("known_at", "date")
    .add("source_revision", "string")
)
PREDICTIONS = (
    T.StructType()
    .add("security_id", "string")
    .add("symbol", "string")
    .add("asof_date", "date")
    .add("score_raw", "double")
    .add("score_neutralized", "double")
    .add("target", "double")
    .add("split", "string")
    .add("model_id", "string")
    .add("checkpoint_hash", "string")
    .add("dataset_id", "string")
    .add("eligible", "boolean")
    .add("industry_code", "string")
    .add("log_float_market_cap", "double")
)

# Columns of the sample index and of the target-free inference index.
SAMPLE_INDEX = (
    T.StructType()
    .add("sample_id", "string")
    .add("security_id", "string")
    .add("symbol", "string")
    .add("asof_date", "date")
    .add("feature_start", "date")
    .add("feature_end", "date")
    .add("label_start", "date")
    .add("label_end", "date")
    .add("split", "string")
    .add("target", "double")
    .add("raw_return", "double")
    .add("benchmark_return", "double")
    .add("crosses_delisting", "boolean")
)
INFERENCE_INDEX = (
    T.StructType()
    .add("sample_id", "string")
    .add("security_id", "string")
    .add("symbol", "string")
    .add("asof_date", "date")
    .add("feature_start", "date")
    .add("feature_end", "date")
    .add("eligible", "boolean")
    .add("industry_code", "string")
    .add("float_market_cap", "double")
    .add("log_float_market_cap", "double")
)

STANDARD = {
    "bars": BARS,
    "universe": UNIVERSE,
    "corporate_actions": CORPORATE_ACTIONS,
    "delistings": DELISTINGS,
}


@dataclass(frozen=True)
class StandardTables:
    bars: DataFrame
    universe: DataFrame
    corporate_actions: DataFrame | None = None
    delistings: DataFrame | None = None

    def items(self):
        return [(name, getattr(self, name)) for name in STANDARD if getattr(self, name) is not None]


def coerce_date(frame: DataFrame, column: str) -> DataFrame:
    """Turn a column into a DATE; text that is no date becomes NULL."""
    kind = frame.schema[column].dataType
    if isinstance(kind, T.DateType):
        return frame
    if isinstance(kind, T.StringType):
        return frame.withColumn(column, F.try_to_date(column, "yyyy-MM-dd"))
    return frame.withColumn(column, F.col(column).try_cast("date"))


def conform(frame: DataFrame, table: str) -> DataFrame:
    """Check required columns and bring dates into shape; extra columns pass through."""
    schema = STANDARD[table]
    require_columns(frame, schema.fieldNames(), table)
    for field in schema.fields:
        if isinstance(field.dataType, T.DateType):
            frame = coerce_date(frame, field.name)
    return frame


def read_standard_tables(
    spark: SparkSession,
    bars: str,
    universe: str,
    corporate_actions: str | None = None,
    delistings: str | None = None,
    *,
    check: bool = True,
) -> StandardTables:
    """Read the standard tables from Parquet and, unless told otherwise, check each contract."""
    paths = {
        "bars": bars,
        "universe": universe,
        "corporate_actions": corporate_actions,
        "delistings": delistings,
    }
    bundle = StandardTables(
        **{name: conform(spark.read.parquet(path), name) for name, path in paths.items() if path}
    )
    if check:
        from factorloom.operators.quality import require_contract

        for name, frame in bundle.items():
            require_contract(frame, name)
    return bundle
